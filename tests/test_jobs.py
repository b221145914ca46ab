"""The jobs: two runs over growing input, runs again after a failure, and the command line."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import grow_collection, map_fragments
from jobs.common import settings_of

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def settings(tmp_path, **more):
    return grow_collection.Settings(records=str(tmp_path / "in"), output=str(tmp_path / "out"), checkpoint=str(tmp_path / "mark"), id="doc_id", label="source", min_length=5, max_length=50, **more)


def deliver(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, source string, text string, other string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


FIRST = [(1, "a", "first text", "x"), (1, "a", "first text", "y"), (2, "b", "First Text", "x"), (3, "a", None, "x"), (4, "a", "", "x"), (None, "a", "nobody's text", "x"), (5, "a", "abc", "x"), (6, None, "w" * 51, "x"), (7, None, "second text", "x"), (7, "b", "second text", "x")]
SECOND = [(0, "a", "first text", "x"), (1, "a", "first text", "x"), (8, "c", "third text", "x"), (9, "c", "THIRD text", "x"), (3, "a", "now with text", "x")]
RESULT_OF_FIRST = {(1, "a", "kept", None, 2, 0), (2, "b", "duplicate", 1, 1, 0), (3, "a", "no_content", None, 1, 0), (4, "a", "no_content", None, 1, 0), (None, "a", "no_id", None, 1, 0), (5, "a", "too_short", None, 1, 0), (6, None, "too_long", None, 1, 0), (7, None, "kept", None, 1, 0), (7, "b", "duplicate", 7, 1, 0)}
RESULT_OF_SECOND = {(0, "a", "duplicate", 1, 1, 1), (1, "a", "duplicate", 1, 1, 1), (8, "c", "kept", None, 1, 1), (9, "c", "duplicate", 8, 1, 1), (3, "a", "kept", None, 1, 1)}


def records_of(spark, s):
    rows = grow_collection.collection(spark, s).collect()
    assert all((r["text"] is not None) == (r["decision"] == "kept") for r in rows)
    return Counter((r["id"], r["label"], r["decision"], r["kept_id"], r["times"], r["batch"]) for r in rows)


def files(path):
    return sorted(p.relative_to(path) for p in path.rglob("*.parquet"))


def test_growing_collection(spark, tmp_path):
    s = settings(tmp_path)
    deliver(spark, tmp_path, FIRST)
    assert grow_collection.run(spark, s) == {"batches": 1, "kept": 2, "duplicate": 2, "no_id": 1, "no_content": 2, "too_short": 1, "too_long": 1}
    assert records_of(spark, s) == Counter(RESULT_OF_FIRST)
    before = files(tmp_path / "out" / "records")
    assert grow_collection.run(spark, s)["batches"] == 0  # nothing is new
    assert files(tmp_path / "out" / "records") == before
    deliver(spark, tmp_path, SECOND)
    done = grow_collection.run(spark, s)
    assert (done["batches"], done["kept"], done["duplicate"]) == (1, 2, 3)
    assert records_of(spark, s) == Counter(RESULT_OF_FIRST | RESULT_OF_SECOND)
    assert set(before) < set(files(tmp_path / "out" / "records"))  # what the first run wrote is left alone
    summary = {(r["label"], r["decision"]): (r["records"], r["deliveries"]) for r in spark.read.parquet(f"{s.output}/summary").collect()}
    assert summary["a", "kept"] == (2, 3) and summary["c", "duplicate"] == (1, 1)
    assert sum(d for _, d in summary.values()) == len(FIRST + SECOND)


def test_batch_that_fails_after_its_write(spark, tmp_path, monkeypatch):
    s = settings(tmp_path)
    deliver(spark, tmp_path, FIRST)
    grow_collection.run(spark, s)
    deliver(spark, tmp_path, SECOND)
    with monkeypatch.context() as m:
        m.setattr(grow_collection.log, "info", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            grow_collection.run(spark, s)
    assert grow_collection.run(spark, s)["batches"] == 1
    assert records_of(spark, s) == Counter(RESULT_OF_FIRST | RESULT_OF_SECOND)


def test_file_by_file_keeps_the_same_contents(spark, tmp_path):
    """As many small batches keep one record of each content, as one batch does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("other", F.lit("x")).select("doc_id", "source", "text", "other")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    s = settings(tmp_path, files_per_batch=2, digits=2)
    s.max_length = 10**9
    assert grow_collection.run(spark, s)["batches"] == 3
    contents = lambda df, c: Counter(r[0] for r in df.select(F.md5(F.upper(c))).collect())
    kept = contents(grow_collection.collection(spark, s).where("decision = 'kept'"), "text")
    assert kept == Counter(set(contents(docs.where("length(text) >= 5"), "text")))


def test_no_records(spark, tmp_path):
    deliver(spark, tmp_path, [])
    s = settings(tmp_path)
    grow_collection.run(spark, s)
    assert not (records := grow_collection.collection(spark, s)) or records.count() == 0


def test_buckets_of_the_batch_only(spark, tmp_path):
    s = settings(tmp_path)
    deliver(spark, tmp_path, FIRST)
    grow_collection.run(spark, s)
    known = grow_collection.known_contents(grow_collection.collection(spark, s), ["0", "c"], 5)
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "text" not in plan.split("ReadSchema")[1]


def test_mapping_written_twice(spark, tmp_path):
    config = ROOT / "jobs" / "map_fragments.json"
    s = settings_of(map_fragments.Settings, str(config), {"fragments": f"{SF}/benchmark.parquet", "references": f"{SF}/documents.parquet", "output": str(tmp_path / "out")})
    first = map_fragments.run(spark, s)
    rows = lambda part: sorted(map(repr, spark.read.parquet(f"{s.output}/{part}").collect()))
    told = {p: rows(p) for p in ("mapping", "summary")}
    assert map_fragments.run(spark, s) == first and {p: rows(p) for p in told} == told
    assert sum(first.values()) == len(told["mapping"]) == 40 and told["summary"]


def test_unknown_setting():
    with pytest.raises(ValueError, match="colour"):
        settings_of(map_fragments.Settings, None, {"colour": "red"})


def test_command_line(tmp_path):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"id": "doc_id", "label": "source", "min_length": 10}))
    args = ["--master", "local[2]", "--config", str(config), "--records", f"{SF}/documents.parque[t]", "--output", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark")]
    done = subprocess.run([sys.executable, str(ROOT / "jobs" / "grow_collection.py"), *args], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "batch 0: read" in done.stderr and (tmp_path / "out" / "summary").is_dir()
