"""SNK01, SNK02, SNK04, STR06: tables that readers always find whole, and batches that count once.

A version is a folder of Parquet files that nothing changes once it is written. What a table holds is told by the names of empty
files in its folder `_current`, numbered in order: one that replaces (r) starts anew, one that adds (a) goes with those
before it, up to the last that replaced. Creating such a file is one step, so there is no
moment without a table; what a writer left that died before that step has no entry and is never read. A batch that
comes again finds its number among the entries and adds nothing; should two writers of one batch meet, the first entry counts.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = re.compile(r"([0-9]{12})-([ra])-(?:b([0-9]+)-)?([0-9a-f]{32})")


def _fs(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def entries(spark: SparkSession, path: str) -> list[tuple[int, str, int | None, str]]:
    """(number, kind, batch, version) of the entries in order, a batch's first one only."""
    at, fs = _fs(spark, f"{path}/_current")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    out, seen = [], set()
    found = ((int(m[1]), m[2], -1 if m[3] is None else int(m[3]), m[4]) for m in map(ENTRY.fullmatch, names) if m)
    for number, kind, batch, version in sorted(found):
        if batch < 0 or batch not in seen:
            out.append((number, kind, None if batch < 0 else batch, version))
        seen.add(batch)
    return out


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders that make up the table now."""
    all_ = entries(spark, path)
    last = max((i for i, e in enumerate(all_) if e[1] == "r"), default=0)
    return [f"{path}/v-{e[3]}" for e in all_[last:]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as it is now; a reader keeps what it began with, whatever writers do."""
    held = folders(spark, path)
    if not held:
        raise FileNotFoundError(path)
    return spark.read.parquet(*held)


def _enter(spark: SparkSession, path: str, kind: str, batch: int | None, version: str) -> None:
    """The step that makes a version count. Two writers may take one number: all readers then order them by the rest of the name."""
    known = entries(spark, path)
    name = f"{known[-1][0] + 1 if known else 0:012d}-{kind}-" + (f"b{batch}-" if batch is not None else "") + version
    at, fs = _fs(spark, f"{path}/_current/{name}")
    fs.mkdirs(at.getParent())
    if not fs.createNewFile(at):
        raise OSError(f"could not enter {name}")


def _written(df: DataFrame, path: str) -> str:
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/v-{version}")
    return version


def replace(df: DataFrame, path: str) -> None:
    """SNK02, SNK04: what the table holds from now on."""
    _enter(df.sparkSession, path, "r", None, _written(df, path))


def add(df: DataFrame, path: str, batch: int | None = None) -> bool:
    """Rows beside those that the table holds; False, and nothing is added, if this batch was added before."""
    spark = df.sparkSession
    if batch is not None and any(e[2] == batch for e in entries(spark, path)):
        return False
    _enter(spark, path, "a", batch, _written(df, path))
    return True


def clean(spark: SparkSession, path: str, older: float = 86_400.0) -> int:
    """Removes folders that aren't in the table and are older than so many seconds, which readers and writers don't need any more."""
    at, fs = _fs(spark, path)
    held, gone = set(folders(spark, path)), 0
    for f in fs.listStatus(at) if fs.exists(at) else []:
        name = f.getPath().getName()
        if name.startswith("v-") and f"{path}/{name}" not in held and time.time() - f.getModificationTime() / 1000 > older:
            gone += fs.delete(f.getPath(), True)
    return gone


def write_transcripts(turns: DataFrame, path: str) -> None:
    """SNK01: turns (job_id, index, speaker, stamp, text) as rows, as Markdown and as text, a line a job in the latter two columns."""
    ordered = F.array_sort(F.collect_list(F.struct("index", "speaker", "stamp", "text")))
    block = lambda t: F.concat(F.lit("**── "), t["speaker"], F.lit(" ──** `["), t["stamp"], F.lit("]`\n"), t["text"], F.lit("\n"))
    rows = turns.groupBy("job_id").agg(ordered.alias("turns"))
    markdown, text = F.array_join(F.transform("turns", block), "\n"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n")
    replace(rows.select("job_id", "turns", markdown.alias("markdown"), text.alias("text")), path)


def hand_off(stream: DataFrame, path: str, checkpoint: str):
    """STR06: a writer of a stream of bundles into a table; a batch that is run again after a failure adds nothing."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: add(df, path, n) and None)
