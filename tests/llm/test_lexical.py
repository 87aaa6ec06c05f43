"""Ranked lexical search against a plain scan of all documents for every item."""

import math
import re
from collections import Counter

import pytest

from gapweave.llm import lexical, queries

from ..compare import difference, views

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    """(item, rank, doc, score) of all items; docs and items are (id, text)."""
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in asked.items():
        scored = []
        for at, (d, bag, size) in enumerate(bags):
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in ts if bag[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, at, d))
        out += [(i, r, x[-1], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return out


@pytest.mark.parametrize("k", [1, 5, 50])
def test_search_equals_a_scan(spark, docs, rows, k):
    items = [(1, "The LIGHT of the river, token7!"), (2, "schule Straße über wasser"), (2, "token5"), (3, None), (4, "..."), (5, "nothing heresuch"), (None, "日本語 edit3x2"), (6, rows[5][1]), (7, "the the the")]
    table = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = sorted(map(tuple, lexical.search(docs, table, k).collect()), key=str)
    assert got == sorted(plain([(r[0], r[1]) for r in rows], items, k), key=str)


def test_wanted_flags_hold_every_term(spark):
    h = [0, 1, -1, 32767, 32768, 1 << 40 | 5, -(1 << 63)]
    flags = lexical.wanted_flags(spark.createDataFrame([(x,) for x in h], "term long"))
    assert set(flags.nonzero()[0].tolist()) == {x & lexical.FILTER_BITS - 1 for x in h}


def test_empty_tables(spark, docs, none):
    items = spark.createDataFrame([(1, "the river")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_a_bound_below_the_top_keeps_ties_and_small_lists(spark):
    # every document holds one frequent term equally often: ties cross the bound, ids decide
    docs = [(k, f"common word{k % 3} filler") for k in range(300, 0, -1)] + [(None, "common word1 filler")]
    items = [(1, "common word1"), (2, "common"), (3, "word0 word1 word2 common filler")]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, lexical.search(table, spark.createDataFrame(items, "item_id long, text string"), 20).collect()))
    assert got == sorted(plain(docs, items, 20))


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert difference(queries.op11_lexical_search(spark, sf), views(sf), queries.LEXICAL_SQL) == ""
