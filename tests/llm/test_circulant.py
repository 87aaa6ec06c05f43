"""Circulant MinHash against all pairs of whole sets, and its signatures against plain ones."""

import re

import numpy as np
import pytest

from gapweave.llm import _arrow, circulant


def shingled(text, width=circulant.WIDTH):
    w = re.findall("[^\\x20\\x09-\\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85):
    sets = [shingled(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min((x for x in (least.get(find(k)), i) if x is not None), default=None)
    out = [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, *_) in enumerate(rows)]
    return sorted([(*x, x[0] == x[2]) for x in out], key=str)


def found(df, **more):
    return sorted((tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in circulant.dedup(df, **more).collect()), key=str)


def test_dedup_equals_all_pairs(docs, rows, none):
    assert found(docs) == brute(rows)
    assert circulant.dedup(none).count() == 0


def edited(rng, base, edits, tag):
    w = list(base)
    for at in rng.choice(len(w), edits, replace=False):
        w[at] = f"{tag}x{at}"
    return " ".join(w)


@pytest.mark.parametrize("words, most", [(12, 1), (60, 2), (300, 9)])
def test_groups_of_near_copies_around_the_threshold(spark, monkeypatch, words, most):
    # copies lie on both sides of 85 % from each other: components hang on single links
    monkeypatch.setattr(circulant, "CELLS", 1000)
    rng = np.random.default_rng(words)
    rows = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(words)]
        for k in range(12):
            rows.append((len(rows), edited(rng, base, int(rng.integers(0, most + 1)), f"c{k % 9}"), "en", "s"))
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(r[0]), str(r[1])) for r in rows], "doc_id long, text string").repartition(5)
    assert found(df) == brute([(int(r[0]), str(r[1])) for r in rows])


def test_signatures_are_minima_over_shifted_cells():
    rng = np.random.default_rng(1)
    cells = rng.integers(0, 1 << 32, 700, dtype=np.uint64).astype(np.uint32)
    starts = np.array([0, 1, 5, 300, 699])
    got = circulant.signatures(circulant.scatter(cells), starts, 20)

    def stirred(x, a, b, shifts):
        x ^= x >> shifts[0]
        x = x * a % 2**32
        x ^= x >> shifts[1]
        x = x * b % 2**32
        return x ^ x >> shifts[2]

    ends = [*starts[1:], len(cells)]
    for d, (s, e) in enumerate(zip(starts, ends)):
        spread = [stirred(int(c), 0x9E3779B1, 0x7FEB352D, (15, 16, 15)) for c in cells[s:e]]
        assert got[d].tolist() == [min(stirred((c - k) % 2**32, 0x85EBCA6B, 0xC2B2AE35, (16, 13, 16)) for c in spread) for k in range(20)]


def test_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    shared, one, other = (rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) for n in (1700, 150, 150))
    x = circulant.signatures(circulant.scatter(np.concatenate([shared, one, shared, other])), np.array([0, 1850]), 2000)
    assert abs((x[0] == x[1]).mean() - 0.85) < 0.03


def test_both_permutations_are_one_to_one_and_bands_differ():
    some = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(circulant.scatter(some))) == len(np.unique(circulant.order(some.copy()))) == len(some)
    same = circulant.bands(np.zeros((2, circulant.ROWS * circulant.BANDS), np.uint32))
    assert len(np.unique(same[0])) == circulant.BANDS and (same[0] == same[1]).all()


def test_a_lower_threshold_is_refused(docs):
    with pytest.raises(ValueError):
        circulant.dedup(docs, 80)


def test_rows_without_an_id_are_kept_only_alone(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (5, text), (None, "alone here stands"), (5, text + " end"), (None, None)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == sorted([(None, 38, 5, False), (5, 38, 5, True), (None, 1, None, True), (5, 39, 5, True), (None, 0, None, True)], key=str)
