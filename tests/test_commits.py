"""Writers that commit: old or new state after a failed task, a lost driver or a second writer; answers that are remembered."""

import glob
import os

import pytest
from granary.agents import client, memo
from granary.sources import named_files, records, sinks, snapshots
from pyspark.sql import functions as F

SCHEMA = "id long, n long"


def rows(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], SCHEMA)


def state(spark, path):
    return sorted(r.n for r in records.read_state(spark, path, SCHEMA).collect())


def failing(column):
    return F.when(F.col("id") == 1, F.raise_error(F.lit("lost")).cast("long")).otherwise(column)


def test_state_is_the_old_one_or_the_new_one(spark, tmp_path):
    path = str(tmp_path / "state")
    assert state(spark, path) == []
    sinks.write_state(rows(spark, 1, 2), path)
    sinks.write_state(records.read_state(spark, path, SCHEMA).withColumn("n", F.col("n") + 1), path)  # from the state itself
    assert state(spark, path) == [2, 3]
    with pytest.raises(Exception, match="lost"):
        sinks.write_state(rows(spark, 5, 6).withColumn("n", failing(F.col("n"))), path)
    assert state(spark, path) == [2, 3]


def test_a_driver_lost_between_stage_and_commit_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "state")
    sinks.write_state(rows(spark, 1), path)

    def lost(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_commit", lost)
        with pytest.raises(KeyboardInterrupt):
            sinks.write_state(rows(spark, 7), path)
    assert state(spark, path) == [1]
    # lost while the manifest is written: its last line is missing
    with open(f"{path}/{snapshots.MANIFESTS}/{2:010d}", "w") as f:
        f.write("rows-gone\n")
    assert state(spark, path) == [1]
    sinks.write_state(rows(spark, 8), path)
    assert state(spark, path) == [8]


def test_old_versions_go_and_the_last_ones_stay(spark, tmp_path):
    path = str(tmp_path / "table")
    for k in range(4):
        assert snapshots.write_snapshot(rows(spark, k), path) == k + 1
    assert len(glob.glob(f"{path}/rows-*")) == 2
    snapshots.write_snapshot(rows(spark, 9), path, append=True)
    assert sorted(r.n for r in snapshots.read_snapshot(spark, path, SCHEMA).collect()) == [3, 9]


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """One that replaces fails if the table changed meanwhile and leaves no rows; those that append both stay."""
    path = str(tmp_path / "table")
    snapshots.write_snapshot(rows(spark, 1), path)
    whole, raced = snapshots._manifests, []

    def meanwhile(session, place):
        if not raced and len(glob.glob(f"{path}/rows-*")) == 2:
            raced.append(True)
            snapshots.write_snapshot(rows(spark, 2), path, append=True)
        return whole(session, place)

    monkeypatch.setattr(snapshots, "_manifests", meanwhile)
    with pytest.raises(snapshots.Conflict):
        snapshots.write_snapshot(rows(spark, 3), path)
    assert raced and len(glob.glob(f"{path}/rows-*")) == 2
    snapshots.write_snapshot(rows(spark, 4), path, append=True)
    assert sorted(r.n for r in snapshots.read_snapshot(spark, path, SCHEMA).collect()) == [1, 2, 4]
    with pytest.raises(snapshots.Conflict):
        snapshots._commit(spark, path, 2, [])


def files(root):
    return {os.path.relpath(f, root): open(f, "rb").read() for f in glob.glob(f"{root}/**/*", recursive=True) if os.path.isfile(f)}


def named(spark, root, values):
    frame = spark.createDataFrame(values, "name string, text string").repartition(3)
    named_files.write_files(frame, str(root), F.col("name"), F.col("text"))


def test_files_have_their_own_names_and_bytes(spark, tmp_path):
    named(spark, tmp_path, [("a/b.java", "class B\n}"), ("a/c/d.java", "é\n"), ("e", None)])
    assert files(tmp_path) == {"a/b.java": b"class B\n}", "a/c/d.java": "é\n".encode(), "e": b""}
    named(spark, tmp_path, [("a/b.java", "new")])
    assert files(tmp_path)["a/b.java"] == b"new" and len(files(tmp_path)) == 3
    for bad in ("../x", "/x", "", None, "a//b", "a/./b"):
        with pytest.raises(Exception, match="relative path"):
            named(spark, tmp_path, [("ok", "1"), (bad, "2")])
    with pytest.raises(Exception, match="twice"):
        named(spark, tmp_path, [("x", "1"), ("x", "2")])
    assert len(files(tmp_path)) == 3  # tasks that ended after the abort may leave staged files, which nobody sees
    assert named_files.recover(str(tmp_path)) == 0 and not glob.glob(f"{tmp_path}/.staging-*")


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    frame = spark.range(20, numPartitions=4).withColumn("text", F.when(F.col("id") == 17, F.raise_error(F.lit("lost"))).otherwise("x"))
    with pytest.raises(Exception, match="lost"):
        named_files.write_files(frame, str(tmp_path), F.col("id").cast("string"), F.col("text"))
    assert files(tmp_path) == {}


def test_a_driver_lost_while_files_are_moved(tmp_path, monkeypatch):
    writer = named_files.NamedFilesWriter(str(tmp_path))
    message = writer.write(iter([type("R", (), {"name": f"d/{k}", "content": b"x"})() for k in range(3)]))
    move, done = named_files._move, []

    def lost(fs, root, staging, moves):
        done.append(moves)
        fs.create_dir(f"{root}/d", recursive=True)
        fs.move(f"{root}/{moves[0][0]}", f"{root}/{moves[0][1]}")
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(named_files, "_move", lost)
        with pytest.raises(KeyboardInterrupt):
            writer.commit([message])
    assert "d/0" in files(tmp_path) and "d/1" not in files(tmp_path)
    assert named_files.recover(str(tmp_path)) == 1 and move
    assert files(tmp_path) == {f"d/{k}": b"x" for k in range(3)}
    other = named_files.NamedFilesWriter(str(tmp_path))
    other.write(iter([type("R", (), {"name": "never", "content": b"x"})()]))
    assert named_files.recover(str(tmp_path)) == 0 and len(files(tmp_path)) == 3


def counting(folder):
    """A model that leaves a file a call, and fails for questions with a question mark in the first run."""

    def say(member, history, row):
        text = history[-1]["content"] or ""
        with open(os.path.join(folder, f"{os.getpid()}-{len(os.listdir(folder))}-{os.urandom(4).hex()}"), "w") as f:
            f.write(text)
        if "?" in text and not os.path.exists(os.path.join(folder, "second")):
            raise OSError("busy")
        return f"{member}:{text}"

    return client.scripted(say)


def test_a_second_run_asks_nothing_and_a_repeated_question_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    asked = [(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "a", "y?"), (5, "a", None), (6, "a", ""), (7, None, "x")] + [(k, "a", "x") for k in range(10, 40)]
    frame = spark.createDataFrame(asked, "id long, member string, text string").select("id", "member", F.array(client.user(F.col("text"))).alias("history"))
    path, model = str(tmp_path / "memo"), counting(str(calls))
    first = {r.id: r for r in memo.remembered(frame, model, path).collect()}
    assert len(list(calls.iterdir())) == 5 + 2  # a call each for five questions, two for the one that fails
    assert len(first) == len(asked) and first[2].history[-1].content == "a:x" and first[3].history[-1].content == "b:x" and first[4].err_msg and first[4].history[-1].content == ""
    (calls / "second").touch()
    n = len(list(calls.iterdir()))
    second = {r.id: r for r in memo.remembered(frame, model, path).collect()}
    assert len(list(calls.iterdir())) == n + 1  # only what failed is asked again
    assert second[4].history[-1].content == "a:y?" and not second[4].known and second[1].known and second[1].history == first[1].history
    third = memo.remembered(frame.filter("id > 3"), model, path).collect()
    assert all(r.known for r in third) and len(list(calls.iterdir())) == n + 1
    assert memo.remembered(frame.limit(0), model, path).count() == 0


def test_line_numbers_hold_however_files_are_cut(spark, tmp_path):
    for k in range(3):
        with open(tmp_path / f"part-{k}.txt", "w") as f:
            f.writelines(f"{k} line {i} {'x' * (i % 50)}\n" for i in range(300))
    want = [f"{k} line {i} {'x' * (i % 50)}" for k in range(3) for i in range(300)]
    try:
        for size in ("1k", "7k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = {r.line_no: r.value for r in records.read_lines(spark, str(tmp_path)).collect()}
            assert got == dict(enumerate(want))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
