"""Language identification by a bidirectional gated recurrent network over bytes.

Two gated recurrent units read windows of WINDOW bytes, one from either end, and a softmax over
both states labels every position with a language. A document's probabilities are the mean
over its letter positions. The network is trained in numpy by backpropagation through time on a
bounded sample: at most PER_LANGUAGE documents of a language, from each of which a
passage at a place that the document's hash fixes. Every byte of every text is read in scoring;
state starts anew at each window, so tasks hold a bounded number of windows at a time.

Cases: `und` with score 0 for null, empty and letterless texts, and for all if there is nothing to
learn from; with one language, it is every lettered text's label; more than MAX_LANGUAGES
languages to learn are an error, as those left out would get other languages' labels; repeated rows and
null doc_ids are scored like any row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship
from . import _arrow

HIDDEN = 8
WINDOW = 64
PER_LANGUAGE = 800
PASSAGE = 192  # characters of a sampled document
MAX_LANGUAGES = 256
STEPS, BATCH, RATE, SEED = 500, 192, 0.02, 11
LANES = 2048  # windows read at once

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


@dataclass
class Net:
    """Parameters: for both directions byte inputs E (256, 3h) and recurrences U (h, 3h), then the softmax."""

    languages: list[str]
    E: list[np.ndarray]
    U: list[np.ndarray]
    V: np.ndarray
    c: np.ndarray

    def all(self) -> list[np.ndarray]:
        return [*self.E, *self.U, self.V, self.c]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Net:
    rng = np.random.default_rng(seed)
    f = lambda *s, k: (rng.normal(size=s) * k).astype(np.float32)
    return Net(languages, [f(256, 3 * hidden, k=0.3) for _ in "fb"], [f(hidden, 3 * hidden, k=hidden**-0.5) for _ in "fb"], f(2 * hidden, len(languages), k=0.3), np.zeros(len(languages), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def states(E: np.ndarray, U: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, B, h) of a gated recurrent unit over bytes x (T, B); keep gets what backpropagation needs."""
    h = U.shape[0]
    out = np.empty((*x.shape, h), np.float32)
    s = np.zeros((x.shape[1], h), np.float32)
    for t in range(len(x)):
        a = E[x[t]]
        g = s @ U
        zr = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
        n = zr[:, h:] * g[:, 2 * h :]
        n += a[:, 2 * h :]
        np.tanh(n, out=n)
        before = s
        s = out[t]
        np.subtract(before, n, out=s)
        s *= zr[:, :h]
        s += n
        if keep is not None:
            keep.append((before, zr, n, g[:, 2 * h :]))
    return out


def gradients(U: np.ndarray, x: np.ndarray, kept: list, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of E and U by backpropagation through time; dout is that of the states."""
    h = U.shape[0]
    dU, da = np.zeros_like(U), np.empty((*x.shape, 3 * h), np.float32)
    back = np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        before, zr, n, gn = kept[t]
        z, r = zr[:, :h], zr[:, h:]
        d = dout[t] + back
        dn = d * (1 - z) * (1 - n * n)
        da[t, :, :h] = d * (before - n) * z * (1 - z)
        da[t, :, h : 2 * h] = dn * gn * r * (1 - r)
        da[t, :, 2 * h :] = dn
        dg = np.concatenate([da[t, :, : 2 * h], dn * r], 1)
        dU += before.T @ dg
        back = d * z + dg @ U.T
    flat, codes = da.reshape(-1, 3 * h), x.reshape(-1)
    order = np.argsort(codes, kind="stable")
    kinds, first = np.unique(codes[order], return_index=True)
    dE = np.zeros((256, 3 * h), np.float32)
    dE[kinds] = np.add.reduceat(flat[order], first)
    return dE, dU


def loss_and_gradients(net: Net, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy over the positions of x (T, B) with their weights, languages y (B), and its gradients."""
    kept: list[list] = [[], []]
    h = net.U[0].shape[0]
    both = np.concatenate([states(net.E[0], net.U[0], x, kept[0]), states(net.E[1], net.U[1], x[::-1], kept[1])[::-1]], 2)
    p = both @ net.V + net.c
    p = np.exp(p - p.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    w = weight / max(weight.sum(), 1e-9)
    loss = -(np.log(np.take_along_axis(p, y[None, :, None], 2)[..., 0] + 1e-9) * w).sum()
    np.put_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2) - 1, 2)
    p *= w[..., None]
    dboth = (p @ net.V.T).astype(np.float32)
    fE, fU = gradients(net.U[0], x, kept[0], dboth[..., :h])
    bE, bU = gradients(net.U[1], x[::-1], kept[1], dboth[::-1, :, h:])
    flat = p.reshape(-1, p.shape[2])
    return float(loss), [fE, bE, fU, bU, both.reshape(-1, 2 * h).T @ flat, flat.sum(0)]


def windows(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as windows (n, WINDOW), filled up with spaces, and the text each window is of."""
    counts = -(-np.diff(at) // WINDOW)
    owner = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    place = at[owner] + within * WINDOW
    grid = place[:, None] + np.arange(WINDOW)
    inside = grid < at[owner + 1][:, None]
    return np.where(inside, buf[np.minimum(grid, max(len(buf) - 1, 0))], 32).astype(np.uint8) if len(owner) else np.zeros((0, WINDOW), np.uint8), owner


def fit(net: Net, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Net:
    """Adam on random batches of windows; classes weigh the same."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    x, owner = windows(np.frombuffer(b"".join(texts), np.uint8), at)
    full = LETTER[x].sum(1) >= 8
    x, y = x[full], labels[owner[full]]
    if not len(x):
        return net
    share = 1 / np.maximum(np.bincount(y, minlength=len(net.languages)), 1)
    chance = share[y] / share[y].sum()
    rng = np.random.default_rng(seed)
    m = [np.zeros_like(p) for p in net.all()]
    v = [np.zeros_like(p) for p in net.all()]
    for k in range(1, steps + 1):
        pick = rng.choice(len(x), BATCH, p=chance)
        xb = np.ascontiguousarray(x[pick].T)
        _, grads = loss_and_gradients(net, xb, y[pick], LETTER[xb].astype(np.float32))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - k / (steps + 1)))
        for p, g, a, b in zip(net.all(), grads, m, v):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return net


def probabilities(net: Net, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Pooled probabilities (texts, languages); rows of 0 where no letter position is."""
    x, owner = windows(buf, at)
    n = len(at) - 1
    out, weight = np.zeros((n, len(net.languages))), np.zeros(n)
    h = net.U[0].shape[0]
    for k in range(0, len(x), LANES):
        xb = np.ascontiguousarray(x[k : k + LANES].T)
        p = states(net.E[0], net.U[0], xb).reshape(-1, h) @ net.V[:h]
        p = p.reshape(*xb.shape, -1)
        p += (states(net.E[1], net.U[1], xb[::-1]).reshape(-1, h) @ net.V[h:]).reshape(p.shape)[::-1]
        p += net.c
        p -= p.max(2, keepdims=True)
        np.exp(p, out=p)
        letters = LETTER[xb]
        p *= (letters / p.sum(2))[..., None]
        mine = owner[k : k + LANES]
        np.add.at(out, mine, p.sum(0))
        np.add.at(weight, mine, letters.sum(0))
    return out / np.maximum(weight, 1)[:, None]


def _lettered(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Net:
    """Learn from text and lang of the rows for which `learn` holds; a hash of doc_id and text samples them."""
    ship(docs.sparkSession)
    rows = docs.filter(learn).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), F.col("text")).alias("h"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"the network labels at most {MAX_LANGUAGES} languages")
    if not counts:
        return fresh([])
    languages = sorted(counts)
    chance = F.create_map(*(x for c in languages for x in (F.lit(c), F.lit(min(1.0, 1.3 * per_language / counts[c])))))
    place = 1 + F.pmod("h", F.greatest(F.length("text") - PASSAGE, F.lit(1)))
    sample = rows.filter(F.pmod("h", F.lit(1 << 30)) < F.get(F.array(F.element_at(chance, F.col("lang"))), F.lit(0)) * (1 << 30)).select("lang", "h", F.substring("text", place.cast("int"), F.lit(PASSAGE)).alias("passage"))
    # bounded: per_language rows of each of at most MAX_LANGUAGES languages
    got = sample.orderBy("h", "lang").limit(2 * per_language * len(languages)).collect()
    seen: dict[tuple[str, str], None] = dict.fromkeys((r["lang"], r["passage"]) for r in got)
    net = fresh(languages)
    return fit(net, [t.encode() for _, t in seen], np.array([languages.index(c) for c, _ in seen]))


def identify(docs: DataFrame, net: Net, keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns, the predicted language and its pooled probability of every whole text."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{out[0]}` string, `{out[1]}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _arrow.slices(batch, "text"):
                buf, at = _arrow.utf8(part.column("text"))
                found, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if net.languages:
                    p = probabilities(net, buf, at)
                    best = p.argmax(1)
                    ascii_letters = np.concatenate([[0], np.cumsum(LETTER[buf] & (buf < 128))])
                    sure = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
                    for k in range(part.num_rows):
                        if sure[k] or at[k + 1] > at[k] and _lettered(buf[at[k] : at[k + 1]].tobytes()):
                            found[k], score[k] = net.languages[best[k]], min(1.0, p[k, best[k]])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(found), pa.array(score)], [*keep, *out])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
