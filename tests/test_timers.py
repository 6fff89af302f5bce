"""State with timers, tables that are always whole, hand-offs that count once, archives of job folders."""

import datetime
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from colloquy.sources import files, versions
from colloquy.streaming import jobs, timers

EVENTS = "job_id string, ts timestamp, state string"
ACTIVITY = "model string, job_id string, ts timestamp, active boolean"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


@pytest.fixture(params=["UTC", "Asia/Taipei"])
def zoned(spark, request):
    """The RocksDB store, in a session east of UTC too."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.PROVIDER)
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield spark
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, path, make, schema, *batches):
    """Feeds batches one after the other; all rows that come out, in order."""
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path / "in"))
        stream = make(jobs.watch(spark, str(path / "in"), schema))
        q = stream.writeStream.outputMode("append").foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    return out


def test_changes_wait_for_late_events(zoned, tmp_path):
    make = lambda s: timers.state_changes(s, most=3, delay="10 minutes", idle="2 hours")
    got = run(
        zoned, tmp_path, make, EVENTS,
        [("a", at(0), "scanning"), ("a", at(6), "writing"), ("b", at(1), "done")],
        [("a", at(3), "scanning"), ("a", at(4), "awaiting_answers"), ("a", at(7), "writing")],  # late, but not later than the watermark
        [("z", at(60), "x")],
        [("a", at(5), "error"), ("z", at(61), "x")],  # too late
        [("b", at(62), "done"), ("z", at(400), "y")],
        [("b", at(401), "done"), ("z", at(800), "x")],  # forgotten since, so the same state is a change again
        [("z", at(1200), "x")],
    )
    a = [(r["state"], r["changes"], r["history"]) for r in got if r["job_id"] == "a"]
    assert a == [("scanning", 1, ["scanning"]), ("awaiting_answers", 2, ["scanning", "awaiting_answers"]), ("writing", 3, ["scanning", "awaiting_answers", "writing"])]
    assert [(r["state"], r["changes"]) for r in got if r["job_id"] == "b"] == [("done", 1), ("done", 1)]


def test_ejects_wait_for_active_jobs(zoned, tmp_path):
    make = lambda s: timers.idle_ejects(s, idle="10 minutes", delay="1 minute")
    got = run(
        zoned, tmp_path, make, ACTIVITY,
        [("m", "j1", at(0), True), ("m", "j1", at(2), False), ("n", "k1", at(0), True)],
        [("m", "j2", at(9), True), ("m", "j2", at(10), False)],  # newer activity: the first timer says nothing
        [("q", "x", at(15), False)],
        [("q", "x", at(40), False)],
        [("n", "k1", at(41), False), ("q", "x", at(43), False)],  # the job that held the timer ends
        [("q", "x", at(100), False)],
        [("q", "x", at(101), False)],
    )
    assert [(r["action"], r["jobs"]) for r in got if r["model"] == "m"] == [("eject", [])]
    assert [(r["action"], r["jobs"]) for r in got if r["model"] == "n"] == [("held", ["k1"]), ("eject", [])]


def test_latest_status_in_any_zone(zoned, tmp_path):
    make = lambda: jobs.latest_status(jobs.watch(zoned, str(tmp_path / "in"), EVENTS), idle="1 hour", delay="10 minutes")
    out = []
    for rows in ([("a", at(0), "scanning")], [("c", at(300), "done")], [("a", at(299), "writing")], [("c", at(301), "done")]):
        zoned.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        q = make().writeStream.outputMode("update").foreachBatch(lambda df, n: out.extend(df.select("job_id", "state", F.unix_millis("updated_at").alias("ms")).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)
    want = zoned.createDataFrame([(at(0),), (at(299),)], "t timestamp").select(F.unix_millis("t")).collect()
    assert [(r["state"], r["ms"]) for r in out if r["job_id"] == "a"] == [("scanning", want[0][0]), ("writing", want[1][0])]


def test_readers_always_find_a_table(spark, tmp_path):
    """A reader in a loop beside a writer that replaces: every read is one whole version."""
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    versions.replace(spark.range(100).withColumn("v", F.lit(0)), path)
    stop, seen, wrong = threading.Event(), [], []

    def look():
        while not stop.is_set():
            try:
                rows = versions.read(spark, path).groupBy("v").count().collect()
                seen.append(rows[0]["v"])
                if len(rows) != 1 or rows[0]["count"] != 100:
                    wrong.append(rows)
            except Exception as e:  # noqa: BLE001
                wrong.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(1, 6):
        versions.replace(spark.range(100).withColumn("v", F.lit(n)), path)
    time.sleep(1)
    stop.set()
    reader.join()
    assert not wrong and seen == sorted(seen) and seen[-1] == 5
    assert versions.clean(spark, path, older=0) == 5 and versions.read(spark, path).count() == 100


def test_batches_count_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.add(spark.range(3), path, 0) and versions.add(spark.range(2), path, 1)
    assert not versions.add(spark.range(3), path, 0)
    spark.range(7).write.parquet(f"{path}/v-{'0' * 32}")  # what a writer left that died before it could enter it
    assert versions.read(spark, path).count() == 5
    versions._enter(spark, path, "a", 1, versions._written(spark.range(2), path))  # two writers of one batch met
    assert versions.read(spark, path).count() == 5
    versions.replace(spark.range(4), path)
    assert versions.add(spark.range(1), path) and versions.read(spark, path).count() == 5


def test_hand_off_that_is_killed(spark, tmp_path):
    """A stream that dies between the write and the commit of its batch gives each bundle once."""
    path, schema = str(tmp_path / "bundles"), "job_id string, n long"
    source = lambda: jobs.watch(spark, str(tmp_path / "in"), schema)
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    feed([("a", 1), ("b", 2)])

    def dies(df, n):
        versions.add(df, path, n)
        raise RuntimeError("killed")

    q = source().writeStream.foreachBatch(dies).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        q.awaitTermination(120)
    for rows in ([("c", 3)], [("d", 4)]):
        feed(rows)
        q = versions.hand_off(source(), path, str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted(r["job_id"] for r in versions.read(spark, path).collect()) == ["a", "b", "c", "d"]


def test_transcripts_as_markdown(spark, tmp_path):
    t = spark.createDataFrame([("j", 1, "李", "00:00:10", "好"), ("j", 0, "王", "00:00:00", "你好")], "job_id string, index int, speaker string, stamp string, text string")
    versions.write_transcripts(t, str(tmp_path / "t"))
    r = versions.read(spark, str(tmp_path / "t")).first()
    assert r["text"] == "你好\n好" and r["markdown"] == "**── 王 ──** `[00:00:00]`\n你好\n\n**── 李 ──** `[00:00:10]`\n好\n" and len(r["turns"]) == 2
    from colloquy.operators import lines

    back = lines.parse_transcript(spark.createDataFrame([("j", r["markdown"])], "job_id string, text string"), "job_id").orderBy("index").collect()
    assert [(x["speaker"], x["text"]) for x in back] == [("王", "你好"), ("李", "好")]


def test_archive_of_job_folders(spark, tmp_path):
    top = tmp_path / "arch ive+1"
    for job, held in {"2024 a+b": {"job.json": json.dumps({"state": "done", "title": "T", "date": "2024-01-01", "x": 1}), "note.md": "abc"}, "broken": {"job.json": "{no"}, "list": {"job.json": "[1]"}, "bare": {"x.md": "12345"}, ".hidden": {"job.json": "{}"}}.items():
        (top / job).mkdir(parents=True)
        for name, text in held.items():
            (top / job / name).write_text(text)
    (top / "2024 a+b" / "deep").mkdir()
    (top / "2024 a+b" / "deep" / "z.bin").write_text("1234567")
    got = {r["job_id"]: r for r in files.archive(spark, str(top), "state string, title string, date string").collect()}
    assert set(got) == {"2024 a+b", "broken", "list", "bare"}
    r = got["2024 a+b"]
    assert (r["state"], r["title"], r["date"], r["error"], r["names"]) == ("done", "T", "2024-01-01", None, ["job.json", "note.md", "z.bin"]) and r["bytes"] == 10 + len(json.dumps({"state": "done", "title": "T", "date": "2024-01-01", "x": 1}))
    assert [(got[j]["state"], got[j]["title"], got[j]["error"]) for j in ("broken", "list", "bare")] == [("error", "broken", "unreadable"), ("error", "list", "unreadable"), ("error", "bare", "missing")]
    one = files.json_files(spark, str(top / "*" / "job.json"), "state string, _corrupt_record string").where("state is not null").collect()
    assert [r["state"] for r in one] == ["done"]
