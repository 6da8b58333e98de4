import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.experiments import stopping
from tidemark.sources.files import append_history, numbered_splits, read_history, refuse_existing, split_parts, write_splits
from tidemark.streaming.metrics import once_per_image, running_scores, windowed_confusion
from tidemark.streaming.runs import drained
from tidemark.streaming.stopping import stopping_stream

REPO = Path(__file__).resolve().parents[1]


def test_early_stopping_stream_takes_epochs_in_any_order(spark, tmp_path):
    scores = {"a": [0.5, 0.4, 0.4, 0.9], "b": [0.1, 0.2, 0.3, 0.4]}
    rows = [(r, n + 1, s) for r, v in scores.items() for n, s in enumerate(v)]
    table = spark.createDataFrame(rows, "run_id string, epoch int, safety_score double")
    for part in (rows[::-2], rows[::-2][:1], rows[-2::-2]):  # late epochs first, one delivered twice
        spark.createDataFrame(part, table.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.run_id: (r.best_epoch, r.stopped) for r in drained(stopping_stream(stream, 2), "update", ["run_id"], "epoch").collect()}
    want = {r.run_id: (r.best_epoch, r.stop_epoch is not None) for r in stopping(table, 2).collect()}
    assert got == want == {"a": (1, True), "b": (4, False)}


def test_a_missing_epoch_is_waited_for_and_then_passed_over(spark, tmp_path):
    """Epoch 2 of run a never comes; that of b comes in time; c waits still at the end, as its gap is younger than the wait."""
    batches = [
        [("a", 1, 0.5, 0), ("a", 3, 0.4, 0), ("a", 4, 0.9, 0), ("b", 1, 0.1, 0), ("b", 3, 0.3, 0)],
        [("b", 2, 0.7, 50), ("c", 1, 0.2, 50)],
        [("clock", 1, 0.0, 500), ("c", 3, 0.8, 480)],
        [("clock", 2, 0.0, 510)],
    ]
    for rows in batches:
        frame = spark.createDataFrame(rows, "run_id string, epoch int, safety_score double, s int")
        frame.select("run_id", "epoch", "safety_score", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("seen")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, epoch int, safety_score double, seen timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states = drained(stopping_stream(stream, 5, 0.0, "seen", "1 second", wait=100), "update", ["run_id"], "epoch")
    got = {r.run_id: (r.epoch, r.best_epoch, r.best_score) for r in states.collect()}
    assert got == {"a": (4, 4, 0.9), "b": (3, 2, 0.7), "c": (1, 1, 0.2), "clock": (2, 1, 0.0)}
    with pytest.raises(ValueError, match="event time"):
        stopping_stream(stream, 5, wait=3)


def test_waiting_epochs_are_few_values_of_the_state(spark, tmp_path):
    """Epochs of many runs in any order, one of them missing: the state holds one value a bucket, and the folds are those of the whole table."""
    table = spark.range(60 * 30).select((F.col("id") % 60).cast("string").alias("run_id"), (F.floor(F.col("id") / 60) + 1).cast("int").alias("epoch"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("safety_score"))
    arrived = table.withColumn("safety_score", F.when(F.col("safety_score") > 0.1, F.col("safety_score"))).withColumn("part", F.pmod(F.xxhash64("run_id", "epoch"), F.lit(3)))
    seen = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("part"))
    for part in range(3):
        arrived.filter((F.col("part") == part) & (F.col("epoch") != 7)).select("run_id", "epoch", "safety_score", seen.alias("seen")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id string, epoch int, safety_score double, seen timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    states, held = stopping_stream(stream, 5, 0.0, "seen", "0 seconds", wait=100, buckets=4), []
    q = states.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda batch, n: held.append(batch.count())).start()
    q.awaitTermination()
    assert held[0] == 60 and q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    clock = spark.createDataFrame([("0", 31, 0.0, 1_700_009_999)], "run_id string, epoch int, safety_score double, s int")
    clock.select("run_id", "epoch", "safety_score", F.timestamp_seconds("s").alias("seen")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r.run_id: (r.best_epoch, r.best_score, r.stopped) for r in drained(states, "update", ["run_id"], "epoch").collect()}
    whole = arrived.filter("epoch <> 7").withColumn("real", F.col("epoch")).withColumn("epoch", F.when(F.col("epoch") > 7, F.col("epoch") - 1).otherwise(F.col("epoch")))
    want = {r.run_id: (r.best_epoch + (r.best_epoch > 6), r.best_score, r.stop_epoch is not None) for r in stopping(whole.drop("part", "real"), 5).collect()}
    assert got == want and len(got) == 60


def test_history_takes_a_batch_once(spark, tmp_path, rows):
    path, schema = f"file://{tmp_path}/history", "run_id string, epoch int, score double"
    make = lambda *r: spark.createDataFrame(list(r), schema)
    assert read_history(spark, path, schema).count() == 0
    assert append_history(make(("a", 1, 0.1), ("a", 2, 0.2)), path, 0) and append_history(make(("a", 2, 0.5), ("b", 1, None)), path, 1)
    want = [("a", 1, 0.1), ("a", 2, 0.5), ("b", 1, None)]
    assert rows(read_history(spark, path, schema)) == want
    assert not append_history(make(("a", 1, 9.0)), path, 0)
    assert rows(read_history(spark, path, schema)) == want
    make(("a", 1, 7.0)).write.parquet(f"{path}/batch=2")  # a job that failed before its marker
    assert rows(read_history(spark, path, schema)) == want
    assert append_history(make(("a", 1, 8.0)), path, 2)
    assert rows(read_history(spark, path, schema)) == [("a", 1, 8.0), *want[1:]]


def test_late_and_repeated_images(spark, tmp_path):
    """Repeats inside the watermark are dropped, rows later than it too; windows close with their sums."""
    for n, part in enumerate(([("x", 0, 10), ("y", 1, 20)], [("x", 0, 15), ("z", 0, 4000)], [("v", 1, 4050)], [("old", 1, 30), ("w", 1, 4100)])):
        frame = spark.createDataFrame(part, "image string, pred int, s int").withColumn("target", F.lit(0))
        frame.withColumn("seen", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = drained(once_per_image(stream, ["image"], "seen", "60 seconds"), "append", ["image"])
    assert sorted(r.image for r in once.collect()) == ["v", "w", "x", "y", "z"]
    sums = windowed_confusion(stream, "seen", "1 hour", "60 seconds")
    got = drained(sums.select(F.unix_timestamp("window.start").alias("start"), "c_00", "c_01"), "update", ["start"]).collect()
    assert {(r.start, r.c_00, r.c_01) for r in got} == {(0, 2, 1), (3600, 1, 2)}


def test_results_are_not_overwritten(spark, tmp_path):
    refuse_existing(spark, f"file://{tmp_path}", ("config.json", "best"))
    (tmp_path / "best").mkdir()
    with pytest.raises(FileExistsError, match="best"):
        refuse_existing(spark, f"file://{tmp_path}", ("config.json", "best"))
    refuse_existing(spark, f"file://{tmp_path}", ("config.json", "best"), overwrite=True)


def test_split_lists_in_parts(spark, tmp_path):
    split = spark.range(3000).select(F.lpad(F.col("id").cast("string"), 5, "0").alias("stem"), F.when(F.col("id") % 10 == 0, "val").otherwise("train").alias("split"))
    path = f"file://{tmp_path}/lists"
    write_splits(split.repartition(7), path, parts=5)
    parts = split_parts(spark, path).orderBy("split", "part").collect()
    assert sum(r.split == "train" for r in parts) > 1 and sum(r.lines for r in parts) == 3000
    for name in ("train", "val"):
        own = [r for r in parts if r.split == name]
        lines = [x for r in own for x in next((tmp_path / "lists" / f"split={name}").glob(r.part)).read_text().splitlines()]
        assert lines == sorted(lines) and [r.first_line for r in own] == [1 + sum(q.lines for q in own[:k]) for k in range(len(own))]
        numbered = {r.stem: r.line_no for r in numbered_splits(spark, path).filter(F.col("split") == name).collect()}
        assert numbered == {x: n + 1 for n, x in enumerate(lines)}


def test_running_scores_equal_batch_scores(spark, tmp_path, rows):
    px = spark.createDataFrame([("r", t, p) for t, p in [(0, 0), (0, 1), (1, 1), (2, 0), (4, 0), (2, 2)]], "run string, target int, pred int")
    px.repartition(3).write.parquet(str(tmp_path / "px"))
    stream = spark.readStream.schema(px.schema).parquet(str(tmp_path / "px"))
    assert rows(drained(running_scores(stream, "run"), "complete", ["run"])) == rows(running_scores(px, "run"))


def test_entry_runs(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert {r.split for r in out.collect()} == {"train", "val", "test"}
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_entry_imports_without_the_optional_subpackage(tmp_path):
    shutil.copytree(REPO, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'metric_report' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={"PATH": "/usr/bin:/bin"})
