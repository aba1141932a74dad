from datetime import datetime

import pytest
from pyspark.sql import functions as F

from factweave.operators.incremental import BatchStore, IncrementalJob, RecordJob, changed_records, latest_state, pending, run_fingerprint, stale_rows
from tests.helpers import rows

LOG = "dep_seq long, fingerprint string, engine_version string, operation_key string, file_path string, file_hash string, recorded_at timestamp, ingested_at timestamp"


def t(day, hour=0):
    return datetime(2025, 1, day, hour)


def case(spark, log, runs, repo="r"):
    snapshots = spark.createDataFrame([("f1", "v1", repo, "{}"), ("f1", "v1", repo, None), ("f2", "v1", repo, "{}")], "fingerprint string, engine_version string, repo string, graph_json string")
    run_log = spark.createDataFrame(runs, "repo string, started_at timestamp, outcome string")
    return rows(changed_records(spark.createDataFrame(log, LOG), snapshots, run_log))


def test_new_changed_late_and_failed(spark):
    a = (1, "f1", "v1", "get /a/", "./x.go", "SHA256:AA", t(1), t(1))
    same = (2, "f2", "v1", "GET /a", "x.go", "aa", t(2), t(5))
    assert case(spark, [a, a, same], [("r", t(3), "Succeeded")]) == []
    changed = (3, "f2", "v1", "GET //a", "x.go", "bb", t(2), t(5))
    assert case(spark, [a, changed], [("r", t(3), "succeeded"), ("r", t(9), "failed"), ("r", t(8), "RUNNING")]) == [("r", "GET /a", "x.go", "bb")]
    late = (4, "f1", "v1", "GET /b", "y\\z.go", None, t(1), t(6))
    assert case(spark, [a, late], [("r", t(3), "succeeded")]) == [("r", "GET /b", "y/z.go", None)]
    assert case(spark, [a], [("other", t(3), "succeeded")]) == [("r", "GET /a", "x.go", "aa")]


def test_null_hash_equals_null_and_unknown_fingerprints(spark):
    n1 = (1, "f1", "v1", "GET /a", "x.go", None, t(1), t(1))
    n2 = (2, "f1", "v1", "GET /a", "x.go", None, t(4), t(4))
    assert case(spark, [n1, n2], [("r", t(3), "succeeded")]) == []
    assert case(spark, [(1, "zz", "v1", "GET /a", "x", "h", t(1), t(1)), (1, "f1", "v9", "GET /a", "x", "h", t(1), t(1))], []) == []
    assert case(spark, [], []) == []


def test_order_of_equal_times(spark):
    log = [(2, "f1", "v1", "GET /a", "x", "old", t(1), t(1)), (3, "f1", "v1", "GET /a", "x", "new", t(1), t(9))]
    assert case(spark, log, [("r", t(3), "succeeded")]) == [("r", "GET /a", "x", "new")]


def test_pending_null_keys(spark):
    a = spark.createDataFrame([(None, "x"), ("k", None), ("k2", "y")], "k string, s string")
    assert rows(pending(a, a.where("s = 'y' OR k IS NULL"), ["k"], ["s"])) == [("k", None)]
    assert rows(latest_state(spark.createDataFrame([("k", "b", 1), ("k", "a", 1), ("k", "z", None)], "k string, v string, o int"), ["k"], "v", ["o"])) == [("k", "b")]


def test_job_survives_failures(spark, tmp_path):
    source, work = tmp_path / "in", tmp_path / "work"
    source.mkdir()
    work.mkdir()
    (source / "a.txt").write_text("1\n2")
    job = IncrementalJob(spark, str(source), str(work))
    read = lambda todo: todo.select(F.col("path"), F.col("checksum"))

    def broken(todo):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        job.run(broken)
    with pytest.raises(ValueError):
        job.run(lambda todo: todo.select("checksum"))
    assert job.committed() == [] and job.read() is None
    first = job.run(read)
    assert job.run(read) is None and job.committed() == [first]
    (source / "b.txt").write_text("3")
    (source / "a.txt").write_text("1\n2\n9")
    second = job.run(read)
    assert job.read().count() == 2 and set(job.committed()) == {first, second}  # of a, the newest version
    (source / "b.txt").touch()  # another time, the same content
    assert job.run(read) is None
    (source / "b.txt").unlink()
    assert job.run(read) and job.read().count() == 1 and job.run(read) is None
    (source / "b.txt").write_text("3")
    assert job.run(read) and job.read().count() == 2


def test_listing_reads_no_contents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1")
    job = IncrementalJob(spark, str(tmp_path / "in"), str(tmp_path / "work"))
    plan = job.listing()._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan.split("Relation")[0] and job.listing().count() == 1
    assert job.manifest().count() == 0


@pytest.mark.parametrize("step", ["output", "manifest", "rename"])
def test_records_survive_failures_at_each_step(spark, tmp_path, monkeypatch, step):
    a = (1, "f1", "v1", "GET /a", "x.go", "aa", t(1), t(1))
    changed = (2, "f1", "v1", "GET /a", "x.go", "bb", t(2), t(5))
    new = (3, "f1", "v1", "GET /b", None, None, t(2), t(5))
    log = spark.createDataFrame([a, changed, new, new], LOG)
    snapshots = spark.createDataFrame([("f1", "v1", "r")], "fingerprint string, engine_version string, repo string")
    runs = spark.createDataFrame([("r", t(3), "succeeded")], "repo string, started_at timestamp, outcome string")
    go = lambda: rows(changed_records(log, snapshots, runs, str(tmp_path)))
    real, calls = BatchStore.commit, []

    def dies(self, batch, manifest, output=None):
        calls.append(batch)
        if len(calls) == 2:  # the run after the adopted one
            if step != "output":
                output.write.parquet(f"{self.work}/output/{batch}")
            else:
                (tmp_path / "output" / batch).mkdir(parents=True)  # half of an output
            if step == "rename":
                manifest.write.parquet(f"{self.work}/manifest/_{batch}")
            raise RuntimeError("killed")
        real(self, batch, manifest, output)

    monkeypatch.setattr(BatchStore, "commit", dies)
    with pytest.raises(RuntimeError):
        go()
    store = BatchStore(spark, str(tmp_path))
    assert len(store.committed()) == 1 and store.output() is None
    want = [("r", "GET /a", "x.go", "bb"), ("r", "GET /b", None, None)]
    assert go() == want and len(store.committed()) == 2 and calls[1] == calls[2]
    assert go() == want and len(store.committed()) == 2


def test_records_over_several_runs(spark, tmp_path):
    job = RecordJob(spark, str(tmp_path), ["k"], "v", ["o"], "k string, o int, v string")
    make = lambda *x: spark.createDataFrame(list(x), "k string, o int, v string")
    last = lambda batch: rows(job.store.output().where(F.col("batch") == batch), "k", "v")
    assert last(job.run(make(("a", 1, "x"), ("a", 2, "y"), (None, 1, "n")))) == [(None, "n"), ("a", "y")]
    assert last(job.run(make(("a", 1, "late"), ("b", 1, None)))) == [("b", None)]
    assert last(job.run(make(("a", 3, "y"), ("b", 2, None), ("a", 0, "z")))) == []
    assert last(job.run(make(("a", 4, "z"), (None, 2, None)))) == [(None, None), ("a", "z")]
    assert last(job.run(make())) == []


def test_fingerprint_and_staleness(spark):
    f = spark.createDataFrame([("r", "b", "2"), ("r", "a", "1"), ("q", "a", None)], "repo string, p string, h string")
    assert rows(run_fingerprint(f, ["repo"], "p", "h")) == rows(run_fingerprint(f.orderBy("p").repartition(3), ["repo"], "p", "h"))
    deps = spark.createDataFrame([("k1", "a", "1"), ("k2", "a", "2"), ("k3", "gone", "1"), ("k4", "n", None)], "op string, file_path string, file_hash string")
    cur = spark.createDataFrame([("a", "1"), ("n", None)], "file_path string, file_hash string")
    assert rows(stale_rows(deps, cur, "op")) == [("k2",), ("k3",)]
