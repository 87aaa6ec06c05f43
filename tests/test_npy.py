"""Array files: scans that open only what they need, writes that leave all files or none."""

import io
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapweave.sources import npy


def files(root) -> list[str]:
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(root) for f in fs)


@pytest.fixture()
def table(spark):
    rows = [(k, v, f"train/s{k % 2}", [2, 3], [float(k * 10 + i) for i in range(6)]) for k in range(20) for v in ("clean", "mask")]
    return spark.createDataFrame(rows, "patch_id long, variant string, folder string, shape array<int>, values array<float>").repartition(5)


def test_written_arrays_are_numpy_files_and_come_back(spark, table, tmp_path):
    npy.write(table, f"file://{tmp_path}/a")
    assert len(files(tmp_path / "a")) == 40 and "train/s1/0000007_clean.npy" in files(tmp_path / "a")
    assert np.load(tmp_path / "a/train/s1/0000007_clean.npy").tolist() == [[70, 71, 72], [73, 74, 75]]
    got = npy.arrays(spark, str(tmp_path / "a")).select(*table.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, table.collect()))


def test_a_task_that_dies_leaves_no_file(spark, table, tmp_path):
    bad = F.when((F.col("patch_id") == 13) & (F.col("variant") == "mask"), F.array(F.lit(7), F.lit(9))).otherwise(F.col("shape"))
    with pytest.raises(Exception, match="reshape"):
        npy.write(table.withColumn("shape", bad), str(tmp_path / "b"))
    assert files(tmp_path / "b") == [] and os.listdir(tmp_path / "b") == []
    npy.write(table.filter("patch_id < 5"), str(tmp_path / "b"))
    before = files(tmp_path / "b")
    with pytest.raises(Exception, match="reshape"):
        npy.write(table.withColumn("shape", bad), str(tmp_path / "b"), overwrite=True)
    assert files(tmp_path / "b") == before


def test_stored_files_are_not_replaced_unless_asked(spark, table, tmp_path):
    root = str(tmp_path / "c")
    npy.write(table.filter("patch_id < 3"), root)
    with pytest.raises(Exception, match="there already"):
        npy.write(table, root)
    assert len(files(root)) == 6
    npy.write(table.withColumn("values", F.transform("values", lambda v: -v)), root, overwrite=True)
    assert len(files(root)) == 40 and np.load(f"{root}/train/s0/0000002_clean.npy")[0, 1] == -21
    with pytest.raises(Exception, match="same file"):
        npy.write(table.union(table), str(tmp_path / "d"))
    assert files(tmp_path / "d") == []
    npy.write(table.limit(0), str(tmp_path / "e"))


def test_only_chosen_files_and_parts_are_opened(spark, table, tmp_path):
    root = str(tmp_path / "f")
    npy.write(table, root)
    for f in os.listdir(f"{root}/train/s1"):  # whatever opens these fails or shows an error
        with open(f"{root}/train/s1/{f}", "wb") as out:
            out.write(b"no array")
    got = npy.arrays(spark, root).filter((F.col("folder") == "train/s0") & F.col("patch_id").isin(2, 3, 4) & (F.col("variant") == "clean"))
    assert [(r["patch_id"], r["error"]) for r in got.orderBy("patch_id").collect()] == [(2, None), (4, None)]
    assert npy.arrays(spark, root).filter("error is not null").count() == 20
    names = npy.arrays(spark, root, "patch_id long, variant string")
    assert names.count() == 40 and names.filter("variant = 'mask'").count() == 20
    # a header with no body behind it
    raw = io.BytesIO()
    np.lib.format.write_array_header_1_0(raw, {"descr": "<f8", "fortran_order": False, "shape": (1000, 1000)})
    os.makedirs(tmp_path / "g")
    (tmp_path / "g/0000001_clean.npy").write_bytes(raw.getvalue())
    assert npy.arrays(spark, str(tmp_path / "g"), "patch_id long, shape array<int>, dtype string, error string").collect()[0] == (1, [1000, 1000], "<f8", None)
    assert "ends before" in npy.arrays(spark, str(tmp_path / "g")).first()["error"]


def test_slices_orders_versions_and_other_names(spark, tmp_path):
    a = np.arange(60, dtype=np.float64).reshape(10, 3, 2)
    np.save(tmp_path / "0000001_clean.npy", a)
    np.save(tmp_path / "0000002_clean.npy", np.asfortranarray(a))
    np.save(tmp_path / "12345678.npy", np.float32(5))
    np.save(tmp_path / "note.npy", np.zeros(0))
    with open(tmp_path / "0000003_x.npy", "wb") as f:
        np.lib.format.write_array(f, np.arange(3, dtype=np.int16), version=(2, 0))
    np.save(tmp_path / "0000004_o.npy", np.array([{}], object), allow_pickle=True)
    got = npy.arrays(spark, str(tmp_path), slice_rows=4, partition_bytes=600).collect()
    by = {}
    for r in got:
        by.setdefault(os.path.basename(r["path"]), []).append(r)
    assert [(r["first"], len(r["values"])) for r in by["0000001_clean.npy"]] == [(0, 24), (4, 24), (8, 12)]
    assert sum((r["values"] for r in by["0000001_clean.npy"]), []) == a.ravel().tolist() == by["0000002_clean.npy"][0]["values"]
    assert by["12345678.npy"][0]["values"] == [5.0] and by["12345678.npy"][0]["patch_id"] == 12345678 and by["12345678.npy"][0]["variant"] is None
    assert by["note.npy"][0]["patch_id"] is None and by["0000003_x.npy"][0]["values"] == [0, 1, 2] and "objects" in by["0000004_o.npy"][0]["error"]
