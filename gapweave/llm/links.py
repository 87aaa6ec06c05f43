"""Links between documents whose shingle sets are alike, and their components, from lists that hold every link.

What finds the lists differs (shared prefixes, equal bands of a signature); what follows is the same. Equal sets
are one node (`sid`), with the set's size and a parity bitmap. `settle` starts from some verified
links, merges them to components and looks only at lists that still hold several of them: first, in rounds, each node
with its closest ones of a few other components, so that components at least halve where their closest nodes link, then
all pairs of different components that no filter rules out.
So no link between components is missed, and a group of near copies is merged without its pairs being listed.

Whole sets are compared for every link. A node's partners are dealt to tasks by counted degree, a list's nodes to
blocks by count and bytes, so neither a hot node nor a long list is one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import _arrow
from .components import components

BLOCK, BLOCK_BYTES = 4096, 4 << 20  # nodes of a list that travel together, and bytes of their bitmaps
ROUNDS = 3  # of closest nodes before all pairs that are left
DEALT = 512  # partners of a node that meet it in one task
SIZE_SCALE, PLACE_SCALE = 2048, 256  # steps of a size's logarithm, and of a place as a share of the size
MOST_BITS = 1 << 17  # of a bitmap, times its scale; smaller sets have as many bits for each shingle as the scale, or up to twice as many
BROADCAST_ROWS = 200_000  # rows of up to 28 bytes


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sets(part: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each document of a slice."""
    h, at = _arrow.shingle_hashes(*_arrow.utf8(part.column("text")), width)
    for k in range(part.num_rows):
        u = np.sort(h[at[k] : at[k + 1]])
        if len(u) > 1:
            keep = np.empty(len(u), bool)
            keep[0] = True
            np.not_equal(u[1:], u[:-1], out=keep[1:])
            u = u[keep]
        yield u


def set_id(u: np.ndarray) -> int:
    return signed(xxhash.xxh3_64_intdigest(u.tobytes()))


def bitmap(u: np.ndarray, scale: int = 1) -> bytes:
    """Parities of the numbers of shingles that fall on each place."""
    size = min(scale * MOST_BITS, max(64, scale << (len(u) - 1).bit_length()))
    return np.packbits(np.bincount((u >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1 != 0).tobytes()


def _apart(x: bytes, y: bytes) -> int:
    """The distance of two bitmaps, the longer one folded to the length of the shorter one."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = (int.from_bytes(x[:half], "big") ^ int.from_bytes(x[half:], "big")).to_bytes(half, "big")
    return (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count()


def size_code(n: int) -> int:
    return min(65535, int(math.log(n) * SIZE_SCALE))


class Filter:
    """Which pairs of a list's groups can link, by size and by place; lenient by more than the codes' rounding.

    A shared shingle at places i and j of two sets in one order leaves at most min(i, j) shared
    shingles before it and min(n - i, m - j) from it on.
    """

    def __init__(self, code: np.ndarray, place: np.ndarray, percent: int):
        self.code, self.percent = code.astype(np.int64), percent
        self.n = np.exp(self.code / SIZE_SCALE)
        self.before, self.after = self.n * (place + 1.0) / PLACE_SCALE, self.n * (1 - place / PLACE_SCALE)
        self.slack = math.ceil(SIZE_SCALE * math.log(100 / percent)) + 2

    def __call__(self, k, other) -> np.ndarray:
        shared = np.minimum(self.before[k], self.before[other]) + 1 + np.minimum(self.after[k], self.after[other])
        need = self.percent * (self.n[k] + self.n[other]) / (100 + self.percent)
        return (np.abs(self.code[k] - self.code[other]) <= self.slack) & (shared * 1.002 + 1 >= need * 0.999)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of nodes whose sizes and bitmaps allow a link."""
    one = nodes.select(F.col("sid").alias("a"), "n", F.col("bits").alias("x"))
    other = nodes.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_numpy(), batch.column("m").to_numpy()
            x, y, good = batch.column("x"), batch.column("y"), np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                # intersection <= (n + m - apart) / 2, and it must reach percent * (n + m) / (100 + percent)
                total = int(n[k] + m[k])
                good[k] = (total - _apart(x[k].as_py(), y[k].as_py())) * (100 + percent) >= 2 * percent * total
            yield batch.select(["a", "b"]).filter(pa.array(good))

    met = pairs.select("a", "b").join(one, "a").join(other, "b").filter(fits)
    return met.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, base: DataFrame, nodes: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs a, b of nodes that link, by their whole sets, which are built anew from the texts.

    A set meets up to DEALT of its partners in one task, one after another; one with more partners goes to several
    tasks. Texts outside the pairs do not reach Python. The rows that tell where a set must go are broadcast only if
    they were counted to be no more than BROADCAST_ROWS; otherwise both sides are shuffled.
    """
    sent = F.broadcast if 2 * pairs.count() <= BROADCAST_ROWS else (lambda df: df)
    many = pairs.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") > DEALT).select("a", F.ceil(F.col("c") / F.lit(DEALT)).alias("salts"))
    dealt = pairs.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1).cast("long"))).alias("salt"))
    to = dealt.select("a", "salt", F.col("b").alias("sid"), F.lit(1).alias("role")).union(dealt.select("a", "salt", F.col("a").alias("sid"), F.lit(0)).distinct())
    keys = nodes.select("sid", "key").join(sent(to.select("sid").distinct()), "sid", "left_semi").select("key").distinct()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                found = [u for u in sets(part, width) if len(u)]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_id, found), pa.int64()), pa.array([u.tobytes() for u in found], pa.binary())], ["sid", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pivot = None, None
        for batch in batches:
            left, right = [], []
            for a, salt, sid, role, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "sid", "role")), batch.column("shingles")):
                if not role:
                    now, pivot = (a, salt), np.frombuffer(raw.as_py(), np.uint64)
                elif (a, salt) == now:
                    u = np.frombuffer(raw.as_py(), np.uint64)
                    both = np.sort(np.concatenate([pivot, u]))
                    shared = int((both[1:] == both[:-1]).sum())
                    if 100 * shared >= percent * (len(both) - shared):
                        left.append(a)
                        right.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    texts = base.join(sent(keys), "key", "left_semi").select("text").mapInArrow(take, "sid long, shingles binary")
    met = texts.join(sent(to), "sid").select("a", "salt", "sid", "role", "shingles")
    return met.repartition(partitions(base.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each key after another from batches that are sorted by key."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        edge = np.zeros(batch.num_rows, bool)
        edge[0] = True
        for c in columns:
            edge[1:] |= c[1:] != c[:-1]
        starts = np.append(np.flatnonzero(edge), batch.num_rows)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            key = tuple(int(c[a]) for c in columns)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _block_pairs(table: pa.Table, percent: int, closest: bool, most: int | None = None) -> list[tuple[int, int]]:
    """Pairs of nodes of one block pair: groups are filtered first, then their nodes by component and bitmap."""
    p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
    gid, sid, comp, n, i = (table.column(c).to_numpy() for c in ("gid", "sid", "comp", "n", "i"))
    raw = table.column("bits").to_pylist()
    longs = np.array([len(x) for x in raw])
    kinds = {}
    for length in np.unique(longs).tolist():
        at = np.flatnonzero(longs == length)
        kinds[length] = at, np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.uint64).reshape(len(at), length // 8)
    row = np.zeros(len(sid), np.int64)
    for at, _ in kinds.values():
        row[at] = np.arange(len(at))
    _, first, group = np.unique(gid, return_index=True, return_inverse=True)
    allowed = Filter(table.column("code").to_numpy()[first], table.column("place").to_numpy()[first], percent)
    out: list[tuple[int, int]] = []
    everyone = np.arange(len(first))
    order = np.argsort(group, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
    for g in range(len(first)):
        passes = allowed(g, everyone)[group]
        for k in order[ends[g] : ends[g + 1]].tolist():
            # within one block each pair once; between two blocks from the first to the second
            if p != q and i[k] != p:
                continue
            at = np.flatnonzero(passes & (comp != comp[k]) & (np.minimum(n[k], n) * 100 >= np.maximum(n[k], n) * percent) & ((sid > sid[k]) if p == q else (i == q)))
            if not len(at):
                continue
            margin = np.zeros(len(at), np.int64)
            for length in np.unique(longs[at]).tolist():
                here = longs[at] == length
                x, y = kinds[longs[k]][1][row[k]], kinds[length][1][row[at[here]]]
                while x.shape[-1] > y.shape[-1]:
                    x = x[: len(x) // 2] ^ x[len(x) // 2 :]
                while y.shape[-1] > x.shape[-1]:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                total = n[at[here]] + n[k]
                margin[here] = (total - np.bitwise_count(y ^ x).sum(1, dtype=np.int64)) * (100 + percent) - 2 * percent * total
            at, margin = at[margin >= 0], margin[margin >= 0]
            if closest and len(at) > 1:
                at = at[np.lexsort((sid[at], -margin))]
                at = at[np.sort(np.unique(comp[at], return_index=True)[1])[:most]]
            out += [(min(x, sid[k]), max(x, sid[k])) for x in sid[at].tolist()]
    return out


def across(members: DataFrame, nodes: DataFrame, percent: int, closest: bool, most: int | None = None) -> DataFrame:
    """Pairs of nodes of different components of the same list that no filter rules out; with `closest` for each node the closest one of every other component of a block, or of the `most` closest components.

    members: sig, gid, code, place, sid, comp. Lists with one component are left out. The nodes of a
    list's largest component are dealt to blocks and meet only the nodes outside it;
    those are few where a list is long, and are dealt to blocks that meet each other too.
    """
    sizes = members.groupBy("sig", "comp").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("m"))
    sizes = sizes.filter(F.col("m") > F.col("top.c")).select("sig", F.col("top.comp").alias("top"))
    m = members.join(sizes, "sig").join(nodes.select("sid", "n", "bits"), "sid").withColumn("h", F.xxhash64("sid", "sig"))
    inside, size = F.col("comp") == F.col("top"), F.length("bits")
    blocks = lambda c: F.ceil(F.greatest(F.count(F.when(c, 1)) / F.lit(BLOCK), F.coalesce(F.sum(F.when(c, size)), F.lit(0)) / F.lit(BLOCK_BYTES))).cast("int")
    m = m.join(m.groupBy("sig").agg(blocks(~inside).alias("others"), blocks(inside).alias("tops")), "sig")
    m = m.withColumn("i", F.when(inside, F.col("others") + F.pmod("h", F.col("tops"))).otherwise(F.pmod("h", F.col("others"))).cast("int"))
    m = m.withColumn("j", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1)))
    m = m.select("sig", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "gid", "code", "place", "sid", "comp", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()

        def out():
            x = np.array(sorted(found), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

        for table in _runs(batches, ("sig", "p", "q")):
            found.update(_block_pairs(table, percent, closest, most))
            if len(found) > 200_000:
                yield out()
                found.clear()
        yield out()

    return m.repartition(partitions(members.sparkSession), "sig", "p", "q").sortWithinPartitions("sig", "p", "q").mapInArrow(run, "a long, b long").distinct()


def settle(tested: DataFrame, listed: DataFrame, nodes: DataFrame, base: DataFrame, percent: int, width: int, table: _arrow.Tables, most: int | None = None) -> DataFrame:
    """node and root of every node that links, from tested pairs a, b and the lists (sig, gid, code, place, sid) whose pairs are not all among them.

    `most` other components are met by a node in each of ROUNDS rounds of closest nodes; without it there is one round, over all of them.
    """
    links = table(verified(tested, base, nodes, percent, width))
    comp = components(links, table)
    rounds, closest = 0, True
    while True:
        members = table(listed.join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid")).drop("root"))
        more = table(across(members, nodes, percent, closest, most).join(tested, ["a", "b"], "left_anti"))
        found = None if more.isEmpty() else table(verified(more, base, nodes, percent, width))
        if found is None or found.isEmpty():
            if not closest:
                return comp
            closest = False
        else:
            links = links.union(found)
            comp = components(links, table)
            if not closest:
                return comp
            rounds += 1
            closest = most is not None and rounds < ROUNDS
        tested = tested.union(more)


def labelled(rows: DataFrame, nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with a set (sid) and the least doc_id (component_id) and first row (stands) of their component; nodes: sid, least, first."""
    full = nodes.select("sid", "least", "first").join(comp.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = full.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("stands"))
    return rows.join(full.join(least, "root").select("sid", "component_id", "stands"), "sid", "left")
