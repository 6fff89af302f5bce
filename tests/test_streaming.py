from pyspark.sql import functions as F

from colloquy.operators.jobs import writer_problem
from colloquy.sources import files
from colloquy.streaming import jobs


def test_loose_json(spark):
    rows = [('{"a": 1}',), ('x ```json\n{"a": 2}\n``` y',), ('so: {"a": 3} ok',), ("[1]",), ("{broken",), (None,)]
    d = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in d.select(F.try_variant_get(files.loads_loose(F.col("t")), "$.a", "int")).collect()] == [1, 2, 3, None, None, None]


def drained(stream, path, mode, file):
    """The rows of a stream of files, batch by batch; the sink is a list."""
    out = []
    q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: out.append([r.asDict() for r in df.collect()])).option("checkpointLocation", str(path / file)).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return out


EVENTS = "job_id string, ts timestamp, state string"


def feed(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(path / "in"))


def at(minute):
    import datetime

    return datetime.datetime(2024, 1, 1, minute // 60, minute % 60)


def test_latest_status_forgets(spark, tmp_path):
    stream = lambda: jobs.latest_status(jobs.watch(spark, str(tmp_path / "in"), EVENTS), idle="1 hour", delay="10 minutes")
    feed(spark, tmp_path, [("a", at(0), "scanning"), ("a", at(2), "writing"), ("b", at(1), "done")])
    first = drained(stream(), tmp_path, "update", "c")
    assert {(r["job_id"], r["state"]) for b in first for r in b} == {("a", "writing"), ("b", "done")}
    feed(spark, tmp_path, [("a", at(1), "scanning"), ("c", at(300), "done")])  # late, and long after
    second = drained(stream(), tmp_path, "update", "c")
    assert ("a", "writing") in {(r["job_id"], r["state"]) for b in second for r in b}
    feed(spark, tmp_path, [("b", at(299), "scanning")])  # forgotten, so an older time than the first would count too
    third = drained(stream(), tmp_path, "update", "c")
    assert [(r["job_id"], r["state"]) for b in third for r in b] == [("b", "scanning")]


def test_parts_count_once(spark, tmp_path):
    schema = "upload_id string, index int, arrived timestamp, body string"
    stream = lambda: jobs.deduplicated_parts(jobs.watch(spark, str(tmp_path / "in"), schema))
    feed(spark, tmp_path, [("u", 0, at(0), "x"), ("u", 0, at(1), "x"), ("u", 1, at(1), "y")], schema)
    feed(spark, tmp_path, [("u", 1, at(2), "y"), ("v", 1, at(2), "z")], schema)
    got = [(r["upload_id"], r["index"], r["body"]) for b in drained(stream(), tmp_path, "append", "c") for r in b]
    assert sorted(got) == [("u", 0, "x"), ("u", 1, "y"), ("v", 1, "z")]


def test_sessions_close(spark, tmp_path):
    stream = lambda: jobs.sessions(jobs.watch(spark, str(tmp_path / "in"), EVENTS))
    feed(spark, tmp_path, [("a", at(0), "x"), ("a", at(20), "x"), ("a", at(100), "x"), ("b", at(5), "x")])
    feed(spark, tmp_path, [("z", at(900), "x")])
    got = [r for b in drained(stream(), tmp_path, "append", "c") for r in b]
    feed(spark, tmp_path, [("z", at(901), "x")])
    got += [r for b in drained(stream(), tmp_path, "append", "c") for r in b]
    assert sorted((r["job_id"], r["events"], r["idle_from"]) for r in got) == [("a", 1, at(130)), ("a", 2, at(50)), ("b", 1, at(35))]


def test_polling(spark, tmp_path):
    (tmp_path / "in").mkdir()
    feed(spark, tmp_path, [("a", at(0), "x")])
    q = jobs.polled(jobs.watch(spark, str(tmp_path / "in"), EVENTS), "progress").format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("polled").count() == 1 and set(jobs.POLL.values()) == {2.5, 5.0, 15.0}
    finally:
        q.stop()


def test_command_line(spark, tmp_path, capsys):
    import json

    from colloquy import __main__ as cli

    for job, note in (("j1", "# n\n> 王：「你好」\n> 王：「沒說」"), ("j2", "> 「abc」")):
        for kind, text in (("t", "# T\n**王** [00:10]\n你好 嗎\n\n**李** [00:20]\nabc\n"), ("n", note)):
            (tmp_path / kind / job).mkdir(parents=True)
            (tmp_path / kind / job / "x.md").write_text(text)
    cli.main(["chunk", str(tmp_path / "t/*/*.md"), "--max-chars", "1"])
    rows = [json.loads(r) for r in capsys.readouterr().out.splitlines()]
    assert [(r["job_id"], r["chunk"], r["turns"], r["context"]) for r in rows] == [("j1", 0, 1, 0), ("j1", 1, 1, 1), ("j2", 0, 1, 0), ("j2", 1, 1, 1)]
    cli.main(["verify", str(tmp_path / "t/*/*.md"), str(tmp_path / "n/*/*.md"), "--fix", str(tmp_path / "fixed")])
    assert [json.loads(r) for r in capsys.readouterr().out.splitlines()] == [{"job_id": "j1", "line_no": 3, "quote": "沒說"}]
    assert {r["job_id"]: r["quotes_removed"] for r in spark.read.parquet(str(tmp_path / "fixed")).collect()} == {"j1": 1, "j2": 0}
    cli.main(["queries"])
    assert "turn_chunks" in capsys.readouterr().out
    cli.main(["run", "fallback_plan", "/root/testdata/sf0.001", "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    out = lambda: [json.loads(r) for r in capsys.readouterr().out.splitlines()]
    out()
    cli.main(["evaluate", str(tmp_path / "t/*/*.md"), str(tmp_path / "n/*/*.md"), "--worst", "j2"])
    rows = out()
    assert [r["job"] for r in rows[:2]] == sorted(("j1", "j2"), key=lambda j: -next(r["score"] for r in rows[:2] if r["job"] == j)) and rows[2]["rank"] in (1, 2)
    cli.main(["export", str(tmp_path / "t/*/*.md"), str(tmp_path / "bundles")])
    from colloquy.sources import versions

    bundles = {r["job_id"]: json.loads(r["document"]) for r in versions.read(spark, str(tmp_path / "bundles")).collect()}
    assert set(bundles) == {"j1", "j2"} and [s["text"] for s in bundles["j1"]["transcript"]["segments"]] == ["你好 嗎", "abc"]
    (tmp_path / "archive" / "j9").mkdir(parents=True)
    (tmp_path / "archive" / "j9" / "job.json").write_text('{"state": "done", "title": "T"}')
    cli.main(["jobs", str(tmp_path / "archive")])
    assert [(r["job_id"], r["state"], r["names"]) for r in out()] == [("j9", "done", ["job.json"])]
    for state in ("scanning", "scanning", "done"):
        cli.main(["state", str(tmp_path / "states"), "j1", "--set", state, "--note", "n"])
    out()
    cli.main(["state", str(tmp_path / "states")])
    assert [(r["state"], r["back"]) for r in out()] == [("done", 1), ("scanning", 2)]


def test_a_reply_is_read_once(spark):
    """Whatever of a reply the checks look at, its text is cut and parsed in one place of the plan; keys in any order, nulls and fences."""
    rows = [('so: {"files": {"b.md": "x", "INDEX.md": 1, "action_items.json": {}, "agent_report.json": "{}"}}', "wrong: INDEX.md"), ('```json\n{"files": {"z": 1, "a": null}}\n```', "unknown: a, z"), ('﻿ {"files": 1}', "no files"), (None, "no files")]
    d = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(writer_problem(files.loads_loose(F.col("t")), F.array(F.lit("b"))).alias("p"))
    assert [r[0] for r in d.collect()] == [p for _, p in rows]
    assert d._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
