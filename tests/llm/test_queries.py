import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from gapweave.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [*range(1, 11), 12])
def test_each_operator_has_one_query_over_all_documents(spark, n):
    names = [k for k in __spark_entry__.queries() if re.match(rf"op{n}_", k)]
    assert len(names) == 1
    got = queries.queries()[names[0]](spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    if "doc_id" in got.columns:
        assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    else:
        assert 0 < got.agg(F.sum("n_docs")).first()[0] <= docs.count()


def test_pipeline_stages(spark, docs, none, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    source = spark.read.parquet(f"{SF}/documents.parquet")
    now = source
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns and 0 < out.count() <= now.count()
        if name == "near_duplicates":
            from gapweave.llm import jaccard

            assert jaccard.join(out).filter("doc_id <> component_id").count() == 0
        now = out
    assert now.select("doc_id").distinct().count() == spark.read.parquet(str(tmp_path / "secrets")).count()
    assert corpus_pipeline.run(spark, SF).count() == now.count()


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_and_empty_tables(spark, docs, none, k):
    _, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, none, SF).count() == 0
    got = stage(spark, docs, SF)
    assert got.count() > 0
    if k < 4:
        assert got.columns == docs.columns


def test_near_duplicates_are_decided_by_row(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("river", "stone", "light"))
    rows = [(3, a), (7, a + " end"), (7, b), (8, c), (8, c + " end"), (None, b + " end"), (None, "green " + c), (None, "house " * 9), (None, "house " * 9), (9, ""), (9, None)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.without_near_duplicates(spark, df, SF).collect()]
    eight = [t for i, t in got if i == 8]
    assert len(eight) == 1 and eight[0] in (c, c + " end")
    assert sorted(map(str, got)) == sorted(map(str, [(3, a), (7, b), (8, eight[0]), (None, "house " * 9), (9, ""), (9, None)]))


def test_stages_equal_brute_force(spark):
    """On sf0.001: rows kept by the models' scores, by all pairs of sets, redaction by spans, pieces by the tokenizer."""
    import zlib
    from collections import Counter

    import numpy as np

    from tokenizers import Tokenizer

    from gapweave.llm import _tokens, language, quality, secrets
    from .test_operators import brute

    source = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns = source.columns
    rows = lambda df: Counter((r["doc_id"], r["text"], r["n_chars"]) for r in df.collect())

    model = quality.train(source, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    scored = quality.score(source, model, tuple(columns)).collect()
    assert rows(corpus_pipeline.good_quality(spark, source, SF)) == Counter((r["doc_id"], r["text"], r["n_chars"]) for r in scored if r["score"] >= 0.5)

    named = language.identify(source, language.train(source, F.lit(True)), tuple(columns)).collect()
    assert rows(corpus_pipeline.known_language(spark, source, SF)) == Counter((r["doc_id"], r["text"], r["n_chars"]) for r in named if r["lang_pred"] != "und" and r["score"] >= 0.4)

    plain = [(r["doc_id"], r["text"]) for r in source.select("doc_id", "text").collect()]
    ids = {i for i, _, least in brute(plain) if i == least}
    assert len(ids) < len(plain) == len(dict(plain))
    kept = {(i, t) for i, t in plain if i in ids}
    got = corpus_pipeline.without_near_duplicates(spark, source, SF).collect()
    assert len(got) == len(kept) and {(r["doc_id"], r["text"]) for r in got} == kept

    said = 'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ends.'
    told = source.union(spark.createDataFrame([(10**9, said, "en", "src1", len(said))], source.schema))
    want = Counter()
    for r in secrets.scan(told, secrets.train(secrets.labelled_findings()), ("doc_id", "text", "n_chars")).collect():
        text, spans = r["text"], [f for f in r["findings"] if f["secret"]]
        for f in reversed(spans):
            text = text[: f["start"]] + "[SECRET]" + text[f["end"] :]
        want[r["doc_id"], text, len(text) if spans else r["n_chars"]] += 1
    assert rows(corpus_pipeline.without_secrets(spark, told, SF)) == want and any("[SECRET]" in (t or "") for _, t, _ in want)

    tokenizer, pieces = Tokenizer.from_file(_tokens.tokenizer_path("word_bpe_49k.json")), {}
    for r in corpus_pipeline.packed(spark, source, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    assert set(pieces) == set(dict(plain))
    for i, t in plain:
        ids, at = tokenizer.encode(t or "", add_special_tokens=False).ids + [2], 0
        for start, n, crc in sorted(pieces[i]):
            assert start == at and zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()) == crc
            at += n
        assert at == len(ids)


def test_stages_take_few_documents_to_an_arrow_batch(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    source, before = spark.read.parquet(f"{SF}/documents.parquet"), spark.conf.get(name)
    try:
        for rows, then in (("10000", 1000), ("0", 1000), ("64", 64)):  # 0: no bound
            spark.conf.set(name, rows)
            corpus_pipeline.packed(spark, source, SF)
            assert int(spark.conf.get(name)) == then
    finally:
        spark.conf.set(name, before)

    def stop(spark):
        raise InterruptedError

    monkeypatch.setattr(corpus_pipeline._arrow, "small_batches", stop)  # each stage begins with it
    for _, stage in corpus_pipeline.STAGES:
        with pytest.raises(InterruptedError):
            stage(spark, source, SF)
