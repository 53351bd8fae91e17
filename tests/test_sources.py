"""Sources: results that are reused only while they hold, listings, archives and contracts."""

import pytest
from pyspark.sql import functions as F

from tessera.contracts import ContractError
from tessera.sources import io


def test_scan_or_compute_follows_inputs_parameters_and_rows(spark, tmp_path):
    path, source = f"file://{tmp_path}/out", f"file://{tmp_path}/in"
    calls = []

    def run(parameters):
        df = spark.read.parquet(source)

        def compute():
            calls.append(parameters)
            return df.groupBy((F.col("id") % parameters["mod"]).alias("k")).count()

        out, reused = io.scan_or_compute(spark, path, df, parameters, compute)
        return sorted(tuple(r) for r in out.collect()), reused

    spark.range(10).write.parquet(source)
    assert run({"mod": 2}) == ([(0, 5), (1, 5)], False) and run({"mod": 2}) == ([(0, 5), (1, 5)], True)
    assert run({"mod": 5})[1] is False and run({"mod": 5})[1] is True and run({"mod": 2})[1] is False
    spark.range(10, 12).write.mode("append").parquet(source)  # the input changes
    assert run({"mod": 2}) == ([(0, 6), (1, 6)], False) and run({"mod": 2})[1] is True
    spark.range(1).selectExpr("id AS k", "id AS count").write.mode("overwrite").parquet(path)  # rows are lost
    assert run({"mod": 2}) == ([(0, 6), (1, 6)], False) and len(calls) == 5


def test_a_computation_that_breaks_off_leaves_no_marker(spark, tmp_path):
    path, df = f"file://{tmp_path}/out", spark.range(3)
    io.scan_or_compute(spark, path, df, {"a": 1}, lambda: df)
    with pytest.raises(ZeroDivisionError):
        io.scan_or_compute(spark, path, df, {"a": 2}, lambda: 1 / 0)
    assert io.done_rows(spark, path) is None and io.scan_or_compute(spark, path, df, {"a": 1}, lambda: df)[1] is False


def test_listing_matches_names_of_files_and_folders(spark, tmp_path):
    for name in ("run-1.eos", "run-2", "other"):
        spark.range(4).repartition(2).write.json(f"file://{tmp_path}/{name}")
    (tmp_path / "run-3.txt").write_text("x")
    root = f"file://{tmp_path}"
    names = lambda **k: sorted(r["name"] for r in io.list_files(spark, root, **k).select("name").distinct().collect())
    assert names(glob="*.json", keep="^run-") == ["run-1.eos", "run-2"] and names(keep="^run-", drop=r"\.eos$") == ["run-2", "run-3.txt"]
    assert io.list_files(spark, root, glob="*.json", keep="^run-2").count() == 2 and io.list_files(spark, root, keep="^run-3").first()["bytes"] == 1


def test_shards_must_be_contiguous(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "row_start long, row_end long")
    assert io.contiguous(frame((5, 9), (0, 5), (9, 10)), 10).count() == 3
    for rows, total in (([(0, 5), (6, 9)], None), ([(0, 5), (5, 9), (5, 9)], None), ([(0, 5)], 6), ([(1, 5)], None), ([(0, 5), (3, 5), (5, 8)], None)):
        with pytest.raises(ContractError):
            io.contiguous(frame(*rows), total)


def test_archives_come_back(spark, tmp_path):
    rows = [(k, [float(k), -float(k) / 3]) for k in range(25)]
    df = spark.createDataFrame(rows, "k long, v array<double>").withColumn("shard", F.floor(F.col("k") / 10))
    io.write_matrices(df, "shard", "k", "v", "m", f"file://{tmp_path}/npz")
    back = io.read_matrices(spark.read.parquet(f"file://{tmp_path}/npz"), "m", "shard").collect()
    assert sorted((r["shard"] * 10 + r["row"], r["vector"]) for r in back) == rows


def test_strict_lines_raise_and_tolerant_ones_drop(spark, tmp_path):
    path = f"file://{tmp_path}/lines"
    io.write_lines(spark.createDataFrame([('{"question_id": "a"}',), ('{"question_id": "b"',), ("",)], "line string"), path)
    assert [r["question_id"] for r in io.read_jsonl(spark, path).collect()] == ["a"]
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_jsonl(spark, path, strict=True).collect()
