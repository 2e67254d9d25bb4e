import os

import pytest
from pyspark.sql import functions as F

from docloom.plans import extraction, publication
from docloom.plans import package as pk
from docloom.plans.progress import Progress, StreamProgress, percent
from docloom.sources import files


def store(spark, tmp_path):
    return publication.Store(spark, str(tmp_path / "out"))


def write(spark, n):
    return lambda folder: spark.range(n).write.parquet(f"{folder}/rows")


def rows(spark, s):
    return spark.read.parquet(f"{s.current()}/rows").count()


def test_readers_see_whole_versions(spark, tmp_path):
    s = store(spark, tmp_path)
    assert s.current() is None and s.manifests() == {} and s.clean() == []
    seen = []

    def slow(folder):
        seen.append(s.current())  # nothing yet
        write(spark, 3)(folder)
        seen.append(s.current())

    first = s.publish(slow)
    assert seen == [None, None] and s.current() == first and rows(spark, s) == 3
    second = s.publish(write(spark, 5))
    assert s.current() == second != first and rows(spark, s) == 5 and sorted(s.manifests()) == [1, 2]


def test_a_crash_leaves_the_old_version_and_its_folder_goes(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path)
    s.publish(write(spark, 3))

    def crash(folder):
        write(spark, 9)(folder)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        s.publish(crash)
    with monkeypatch.context() as m:
        m.setattr(publication.Store, "put", lambda *a: (_ for _ in ()).throw(OSError))
        with pytest.raises(OSError):
            s.publish(write(spark, 7))
    assert rows(spark, s) == 3 and len(os.listdir(tmp_path / "out" / "versions")) == 3
    assert s.clean() == [] and len(s.clean(orphaned_after=0)) == 2
    assert rows(spark, s) == 3 and len(os.listdir(tmp_path / "out" / "versions")) == 1
    with pytest.raises(RuntimeError):
        s.publish(lambda folder: None)
    assert rows(spark, s) == 3


def test_half_a_manifest_is_none(spark, tmp_path):
    s = store(spark, tmp_path)
    s.publish(write(spark, 3))
    (tmp_path / "out" / "manifests" / f"{2:012d}.json").write_text('{"vers')
    (tmp_path / "out" / "manifests" / "notes.txt").write_text("x")
    assert rows(spark, s) == 3
    s.publish(write(spark, 4))
    assert sorted(s.manifests()) == [1, 3] and rows(spark, s) == 4


def test_two_publishers(spark, tmp_path, monkeypatch):
    """One that listed before the other took the number takes the next."""
    s, other = store(spark, tmp_path), store(spark, tmp_path)
    listed = s._listed
    stale = [[]]
    monkeypatch.setattr(s, "_listed", lambda folder: stale.pop() if stale and folder == "manifests" else listed(folder))
    other.publish(write(spark, 1))
    s.publish(write(spark, 2))
    assert sorted(other.manifests()) == [1, 2] and rows(spark, other) == 2


def test_old_versions_go(spark, tmp_path):
    s = store(spark, tmp_path)
    for n in range(1, 5):
        s.publish(write(spark, n))
    assert len(s.clean(keep=2)) == 2 and sorted(s.manifests()) == [3, 4] and rows(spark, s) == 4
    assert s.publish(write(spark, 9)) and sorted(s.manifests()) == [3, 4, 5]


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    for i in range(6):
        (root / f"f{i}.txt").write_text(f"text {i} " * (i + 1))
    return root


def run(spark, folder, tmp_path):
    p = Progress()
    got = extraction.extracted(files.scan(files.listed(spark, str(folder)), str(folder)), str(folder), str(tmp_path / "cache"), p)
    return {r.relative_path: r.text for r in got.collect()}, p.metric("opened", "rows")


@pytest.mark.parametrize("by_path", [10_000, 1])
def test_only_changed_files_are_opened(spark, folder, tmp_path, monkeypatch, by_path):
    monkeypatch.setattr(extraction, "BY_PATH", by_path)
    first, opened = run(spark, folder, tmp_path)
    assert opened == 6 and first["f2.txt"].startswith("text 2")
    assert run(spark, folder, tmp_path) == (first, 0)
    (folder / "f1.txt").write_text("changed")
    (folder / "new.txt").write_text("new")
    (folder / "f5.txt").unlink()
    os.utime(folder / "f3.txt", (1, 1))
    again, opened = run(spark, folder, tmp_path)
    assert opened == 3 and again == {k: v for k, v in first.items() if k != "f5.txt"} | {"f1.txt": "changed", "new.txt": "new"}
    assert run(spark, folder, tmp_path) == (again, 0)
    assert extraction.cache_name("/a/b/") == extraction.cache_name("/a/b") != extraction.cache_name("/a/c")


def test_progress_of_a_package(spark, folder, tmp_path):
    options = pk.Options(str(folder), str(tmp_path / "out"), cache=str(tmp_path / "cache"), dedupe="off")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("watched", "")
    p = Progress()
    got = pk.build(spark, options, p)
    with_progress = len(jobs.getJobIdsForGroup("watched"))
    spark.sparkContext.setJobGroup("again", "")
    chars = got.chunks.agg(F.sum("text_length")).first()[0]
    assert p.metric("opened", "rows") == 6 and p.metric("extract", "ok") == 6 and p.metric("chunk", "rows") == 6 and p.metric("chunk", "chars") == chars
    p.finish()
    table = p.table(spark).collect()
    assert [r.kind for r in table if r.stage == "chunk"] == ["current", "done", "done"] and table[-1].kind == "finish" and [r.nth for r in table] == list(range(1, len(table) + 1))
    assert with_progress > 0 and [r[0] for r in spark.range(201).select(percent(F.col("id"))).collect()][-1] == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_progress_of_a_stream(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    listener = StreamProgress()
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).observe("seen", F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(60)
        assert listener.wait(str(query.id))
        told = [b for b in listener.batches if b["query"] == str(query.id)]
        assert sum(b["rows"] for b in told) == 10 and max(b["seen.top"] for b in told) == 9 and listener.ended[str(query.id)] is None
    finally:
        spark.streams.removeListener(listener)
