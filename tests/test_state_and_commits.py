"""Expiring state, replayed batches, graceful stops and the client's memo."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from veilframe.sources import client, commits
from veilframe.streaming import resume, state


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_expired_keys_leave_and_come_again(spark, tmp_path):
    """Three runs: within the time to live a key is held back, after it the key comes through again."""
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "sample_hash string, n int"

    def run(rows):
        put(spark, rows, schema, src)
        resume.run_available(resume.read_files(spark, src, schema), lambda d: d, out, check, "sample_hash", seconds=20)
        return sorted((r["sample_hash"] or "", r["n"]) for r in spark.read.parquet(out).collect())

    first = run([("a", 1), ("b", 1), ("a", 1), (None, 1), (None, 1)])
    assert first == [("", 1), ("a", 1), ("b", 1)]
    assert run([("a", 2), ("c", 2)]) == sorted([*first, ("c", 2)])
    time.sleep(21)
    assert run([("a", 3), ("d", 3)]) == sorted([*first, ("c", 2), ("a", 3), ("d", 3)])


def test_cache_of_a_stream(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "request_id int, cache_key string, payload string, is_put boolean"

    def run(rows):
        put(spark, rows, schema, src)
        told = state.cache(resume.read_files(spark, src, schema), 600)
        state.append_available(told, out, check)
        return {r["request_id"]: (r["cache_key"], r["payload"], r["hit"]) for r in spark.read.parquet(out).collect()}

    got = run([(0, "k", "v", True), (1, "k", None, False), (0, "none", None, True), (2, "other", None, False)])
    assert got == {1: ("k", "v", True), 2: ("other", None, False)}
    got = run([(3, "k", None, False), (4, "none", None, False), (5, "other", None, False)])
    assert {k: got[k] for k in (3, 4, 5)} == {3: ("k", "v", True), 4: ("none", None, True), 5: ("other", None, False)}


def test_files_of_a_batch(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(5):
        put(spark, [(k,)], "n int", src)
    sizes = []
    source = resume.read_files(spark, src, "n int", files_per_batch=2)
    source.writeStream.foreachBatch(lambda b, _: sizes.append(b.count())).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [2, 2, 1] and out


def test_stop_while_input_keeps_coming(spark, tmp_path):
    """The rate source never ends: stopping must not wait for it."""
    done = []
    query = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.foreachBatch(lambda b, k: done.append((k, b.count()))).option("checkpointLocation", str(tmp_path / "c")).start()
    time.sleep(3)
    began = time.monotonic()
    assert resume.stop_gracefully(query, 30) is False
    assert time.monotonic() - began < 30 and not query.isActive and done
    assert resume.stop_gracefully(query) is True


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    frame = lambda *rows: spark.createDataFrame(rows, "id int, v string, at int")
    assert commits.read(spark, path, "id", "at") is None
    assert commits.commit(frame((1, "a", 1), (2, "b", 1)), path, 0)
    assert not commits.commit(frame((1, "a", 1), (2, "b", 1)), path, 0)  # a replay
    assert commits.commit(frame((2, "c", 0), (3, "d", 1), (3, "e", 2)), path, 1)
    want = [(1, "a", 1), (2, "c", 0), (3, "e", 2)]
    rows = lambda: sorted(tuple(r) for r in commits.read(spark, path, "id", "at").collect())
    assert rows() == want
    # a batch whose writer fell over before it published isn't seen, and goes by vacuum
    frame((9, "lost", 9)).write.parquet(f"{path}/batch-2-lost")
    assert rows() == want
    commits.compact(spark, path, "id", "at")
    assert rows() == want and len(commits.manifest(spark, path).folders) == 1
    assert len(commits.vacuum(spark, path)) == 3 and rows() == want
    assert not commits.commit(frame((7, "late", 1)), path, 1) and commits.commit(frame((7, "other stream", 1)), path, 0, "b")
    assert len(rows()) == 4


def test_two_writers_take_one_number(spark, tmp_path):
    path = str(tmp_path / "table")
    now = commits.manifest(spark, path)
    commits._publish(spark, path, commits.Manifest(now.number + 1, ["x"], {}))
    with pytest.raises(commits.Conflict):
        commits._publish(spark, path, commits.Manifest(now.number + 1, ["y"], {}))
    assert commits.manifest(spark, path).folders == ["x"]


def test_stream_of_commits(spark, tmp_path):
    """A stream whose checkpoint is lost after its batches replays them: still one row a key."""
    src, path, check = (str(tmp_path / x) for x in ("in", "table", "check"))
    put(spark, [(1, "a", 1), (2, "b", 1)], "id int, v string, at int", src)
    source = lambda: resume.read_files(spark, src, "id int, v string, at int")
    commits.run_commits(source(), path, check)
    commits.run_commits(source(), path, check + "2")
    put(spark, [(2, "c", 2)], "id int, v string, at int", src)
    commits.run_commits(source(), path, check)
    assert sorted(tuple(r) for r in commits.read(spark, path, "id", "at").collect()) == [(1, "a", 1), (2, "c", 2)]


def service(log):
    def call(text):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text == "slow":
            time.sleep(3)
        if text == "bad":
            raise RuntimeError("refused")
        return text.upper() if text else None

    return call


def test_client_and_its_memo(spark, tmp_path):
    log, memo = str(tmp_path / "log"), str(tmp_path / "memo")
    df = spark.createDataFrame([(1, "one"), (2, "one"), (3, "bad"), (4, "slow"), (5, None), (6, "")], "id int, text string").withColumn("other", F.lit(1))
    how = {"timeout": 0.5, "retries": 1, "wait": 0.01}
    got = {r["id"]: (r["reply"], r["error"]) for r in client.ask(df, service(log), memo, **how).collect()}
    assert got == {1: ("ONE", None), 2: ("ONE", None), 3: (None, "RuntimeError: refused"), 4: (None, "no answer in 0.5 s"), 5: (None, None), 6: (None, None)}
    asked = open(log).read().split("\n")
    assert asked.count("one") == 1 and asked.count("bad") == 2
    again = {r["id"]: (r["reply"], r["error"]) for r in client.ask(df.union(spark.createDataFrame([(7, "new", 1)], df.schema)), service(log), memo, **how).collect()}
    assert again == got | {7: ("NEW", None)}
    asked = open(log).read().split("\n")
    assert asked.count("one") == 1 and asked.count("bad") == 4 and asked.count("new") == 1
    assert client.ask(df.where("false"), service(log), memo, **how).count() == 0
    assert threading.active_count() < 200
