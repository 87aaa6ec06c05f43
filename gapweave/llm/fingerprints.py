"""One-permutation MinHash fingerprints with DataFrame functions alone.

Shingles of WIDTH words (runs of characters other than space and tab to carriage return,
lower-cased; a shorter text is one shingle) are hashed once. The top bits of a hash name its bin
and each bin keeps its least hash. An empty bin j takes the value of the first filled bin among
PROBES hashed ones, and after these that of the filled bin b with the least hash of (j, b): each
empty bin probes in a random order of its own until one is filled, which is optimal
densification. The low 8 bits of the BINS values are stored. Likeness is the share of equal values, corrected for chance agreement.

Cases: null is an empty text; a text without words has the empty fingerprint, whose likeness is
1 with itself and 0 with others; equal texts have equal fingerprints; null doc_ids stand behind
all others in the order of documents; rows with the same doc_id have the same next document, of
several rows with the next doc_id the one with the least text hash; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import _arrow

WIDTH = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
LOW_BITS = 8
PROBES = 6
RANGE_ROWS, MOST_RANGES = 50_000, 1024  # key ranges in which the order of documents is found


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, as a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), "")


def shingles(text: Column) -> Column:
    """The shingle hashes of a text, with repeats; empty without words."""

    def hashed(w: Column) -> Column:
        last = F.greatest(F.size(w) - WIDTH, F.lit(0))
        # get() is null behind the end, and the hash skips nulls
        every = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH))))
        return F.when(F.size(w) > 0, every).otherwise(F.array().cast("array<bigint>"))

    return _let(words(text), hashed)


def _bin(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS)


_REST = (1 << 64 - BIN_BITS) - 1  # all low bits: the value that stands in each bin for no hash
_NONE = [((j << 64 - BIN_BITS | _REST) + (1 << 63)) % (1 << 64) - (1 << 63) for j in range(BINS)]


def codes(text: Column) -> Column:
    """The low bits of all BINS values as array<tinyint> (128 less than the unsigned code); empty without words.

    A stand-in for every bin is sorted in with the hashes, so the first value of each bin makes
    an array of BINS values in the order of bins, and an empty bin shows its stand-in.
    """
    low = lambda h: (h.bitwiseAND(F.lit((1 << LOW_BITS) - 1)) - F.lit(128)).cast("tinyint")
    filled = lambda h: h.bitwiseAND(F.lit(_REST)) != F.lit(_REST)

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(s, i - 1))))

    def dense(v: Column) -> Column:
        def of(h: Column, j: Column) -> Column:
            probes = []
            for t in range(PROBES):
                # lazily evaluated: the next probe runs only if this bin is empty
                at = F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int")
                probes.append(_let(F.get(v, at), lambda x: F.when(filled(x), x)))
            rest = F.array_min(F.transform(F.filter(v, filled), lambda x: F.struct(F.xxhash64(j, _bin(x)).alias("p"), x.alias("h"))))["h"]
            return low(F.when(filled(h), h).otherwise(F.coalesce(*probes, rest)))

        return F.transform(v, of)

    def whole(s: Column) -> Column:
        return F.when(F.size(s) > 0, _let(_let(F.sort_array(F.concat(s, F.array(*map(F.lit, _NONE)))), firsts), dense)).otherwise(F.array().cast("array<tinyint>"))

    return _let(shingles(text), whole)


def packed(code: Column) -> Column:
    """The codes as lowercase hex, two digits a bin."""
    table = "".join(f"{k:02x}" for k in range(256))
    return F.array_join(F.transform(code, lambda c: F.substring(F.lit(table), (c.cast("int") + 128) * 2 + 1, F.lit(2))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two code arrays."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(BINS))
    chance = 2.0**-LOW_BITS
    full = F.greatest((equal - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), (F.size(a) == F.size(b)).cast("double")).otherwise(full)


def following(docs: DataFrame) -> DataFrame:
    """(doc_id, next struct<doc_id>, need): the next smaller doc_id, the largest after the last; need from n.

    docs has doc_id and n. Ids are put in key ranges of about RANGE_ROWS rows by approximate quantiles
    (MOST_RANGES of them at most) and ordered within each; only the ranges' largest ids reach the
    driver.
    """
    ids = docs.groupBy("doc_id").agg(F.max("n").alias("n"))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / MOST_RANGES for k in range(1, MOST_RANGES)], 10_000).alias("q"), F.count("*").alias("rows")).first()
    ranges = min(MOST_RANGES, cuts["rows"] // RANGE_ROWS + 1)
    cuts = sorted({(cuts["q"] or [None] * MOST_RANGES)[k * MOST_RANGES // ranges - 1] for k in range(1, ranges)} - {None})
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    placed = ids.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(place))
    tops = {r["range"]: r["top"] for r in placed.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}  # MOST_RANGES + 1 rows at most
    order = sorted(tops, reverse=True)
    after = dict(zip(order, [*order[1:], *order[:1]]))
    table = F.array(*(F.lit(tops[after[r]] if r in after else None).cast("long") for r in range(-1, max(order, default=-1) + 1)))
    entry = F.struct(F.get(table, F.col("range") + 1).alias("doc_id"))
    w = Window.partitionBy("range").orderBy(F.desc("doc_id"))
    return placed.select("doc_id", F.coalesce(F.lead(F.struct("doc_id")).over(w), entry).alias("next"), F.floor(F.col("n") / 3).cast("int").alias("need"))


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    The last third of a text's code points gives way to the first as many of the next
    document's. Codes of the texts are computed once and kept in the shared folder; both joins
    of texts read the same exchange, and where an id has one text, codes are joined on the id alone.
    Texts of an id that has several, and of null ids, are joined on the id and the text's hash, so
    that many texts under one id are spread and meet no other's codes.
    """
    _arrow.shared_dir(docs.sparkSession)
    # ids as keys without nulls, so that aggregations and joins on them share one partitioning
    key = lambda c, p="": [F.coalesce(c, F.lit(0)).alias(f"{p}k"), F.col(c).isNull().alias(f"{p}z")]
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    code = base.select(*key("doc_id"), F.xxhash64("text").alias("h"), codes(F.col("text")).alias("codes")).groupBy("k", "z", "h").agg(F.first("codes").alias("codes")).checkpoint()
    near = following(base.select("doc_id", F.length("text").alias("n"))).select(*key("doc_id", "to_"), *key("next.doc_id"), "need").checkpoint()
    crowd = code.groupBy("k", "z").agg(F.count("*").alias("texts")).filter("texts > 1 or z").select("k", "z", F.lit(True).alias("crowded")).checkpoint()
    texts = base.select(*key("doc_id"), "text").join(crowd, ["k", "z"], "left")

    def coded(rows: DataFrame, name: str) -> DataFrame:
        """rows with the codes of their text; rows of ids with one text stay where k and z put them."""
        c = code.select("k", "z", "h", F.col("codes").alias(name))
        alone = rows.filter("crowded is null").join(c.drop("h"), ["k", "z"])
        return alone.unionByName(rows.filter("crowded is not null").join(c, ["k", "z", "h"]).select(*alone.columns))

    heads = texts.join(near, ["k", "z"]).select("k", "z", "crowded", "to_k", "to_z", F.xxhash64("text").alias("h"), F.left("text", "need").alias("head"))
    heads = coded(heads, "next_codes").groupBy(F.col("to_k").alias("k"), F.col("to_z").alias("z")).agg(F.min(F.struct("h", "head", "next_codes")).alias("donor"))
    both = texts.join(heads, ["k", "z"]).select("k", "z", "crowded", "text", "donor", F.length("text").alias("n_chars"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    both = both.withColumn("edited", F.concat(F.left("text", F.col("n_chars") - cut), F.left(F.col("donor.head"), cut)))
    both = both.select("k", "z", "crowded", F.col("n_chars").cast("long").alias("n_chars"), F.xxhash64("text").alias("h"), "edited", F.col("donor.next_codes").alias("next_codes"))
    both = coded(both, "codes").select(F.when(~F.col("z"), F.col("k")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "codes", codes(F.col("edited")).alias("edited_codes"), "next_codes")
    return both.select("doc_id", "n_chars", "edited_sha256", packed(F.col("codes")).alias("fingerprint"), packed(F.col("edited_codes")).alias("edited_fingerprint"), likeness(F.col("codes"), F.col("edited_codes")).alias("near_edited"), likeness(F.col("codes"), F.col("next_codes")).alias("near_next"))
