"""Quoting in CSV files, and checks over all stored selections."""

import json

import pytest
from pyspark.sql import types as T

from gapweave.errors import ConfigError
from gapweave.sources import tables


def test_header_and_lenient_rows_with_quotes(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('name,"a, b",x\n"Ada, ""B""",k,1.5\nname,"a, b",x\nplain,k,nan\nbad,k,many\nfew\n')
    assert tables.header(spark, str(p)) == ["name", "a, b", "x"]
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("b", T.StringType()), T.StructField("x", T.DoubleType())])
    good, bad = tables.csv_lenient(spark, str(p), schema)
    assert sorted(map(tuple, good.collect()), key=str) == [('Ada, "B"', "k", 1.5), ("plain", "k", None)]
    assert good.select("name").count() == 2 and bad.count() == 3
    assert sorted(r["line"] for r in bad.collect()) == ["bad,k,many", "few", 'name,"a, b",x']


def test_a_row_like_the_header_stays_and_quoted_line_ends(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text('name,b\nname,b\n"two\nlines",k\n')
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("b", T.StringType())])
    good, bad = tables.csv_lenient(spark, str(p), schema, multi_line=True)
    assert sorted(map(tuple, good.collect())) == [("name", "b"), ("two\nlines", "k")] and bad.count() == 0


def test_ragged_rows_with_quoted_commas(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('method,error_msg,entropy_7,psnr\nidw,"a, b",1.5,20\nidw,"said ""no"", left",1.5,2.5,3.5,30\n')
    got = {r["psnr"]: r for r in tables.csv_ragged(spark, str(p)).collect()}
    assert got[20.0]["error_msg"] == "a, b" and got[30.0]["error_msg"] == 'said "no", left' and got[30.0]["entropy_31"] == 3.5


def test_every_files_metadata_is_checked(spark, tmp_path):
    for k in (7, 7, 9):
        (tmp_path / f"{len(list(tmp_path.iterdir()))}.json").write_text(json.dumps({"metadata": {"window": k}, "selections": {"s2": {"42": [1, 2]}}}))
    with pytest.raises(ConfigError):
        tables.selections(spark, str(tmp_path), {"window": 7})
    (tmp_path / "2.json").unlink()
    assert tables.selections(spark, str(tmp_path), {"window": 7}).count() == 4
