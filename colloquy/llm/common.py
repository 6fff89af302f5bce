"""What the operators share: shared storage, shipped code, scans and short-lived helpers."""

from __future__ import annotations

import atexit
import hashlib
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Keys that hold more than this share of all rows are hot; there are fewer than its inverse of them.
HOT = 1 / 1000

_own: list[str] = []


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors, through the shared folder, and make checkpoints possible."""
    context = spark.sparkContext
    folder = shared_dir(spark)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(PACKAGE.parent))), f.read_bytes())
    name = f"{PACKAGE.name}-{hashlib.sha256(held.getvalue()).hexdigest()[:16]}.zip"
    if name in context._python_includes:
        return
    path = f"{folder}/{name}"
    at, fs = _file(spark, path)
    if not fs.exists(at):
        new, _ = _file(spark, f"{path}.{uuid.uuid4().hex}")
        out = fs.create(new)
        out.write(held.getvalue())
        out.close()
        if not fs.rename(new, at):  # another session was first
            fs.delete(new, False)
    context.addPyFile(path)


def _file(spark: SparkSession, path: str) -> tuple:
    """A path of the JVM and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, without a final slash.

    It is the one that the cluster names in spark.checkpoint.dir. Only on one machine, as in
    tests, a temporary folder stands in for one that isn't named; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="colloquy-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        named = _own[0]
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, for a table that a job writes; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    at, fs = _file(spark, path)
    fs.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _file(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file(spark, path)
    return fs.exists(at)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and drop the lineage."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """An inner join on keys that are unique in right, whose column count tells the rows of left that have them.

    total is the number of rows of left. Hot keys are broadcast, 1 / HOT of them at most, so that their
    rows stay where they are; the rest is shuffled and has no key above the share HOT. count is dropped.
    """
    hot = F.col(count) > int(total * HOT)
    often, seldom = F.broadcast(right.where(hot).drop(count)), right.where(~hot).drop(count)
    return left.join(often, keys).unionByName(left.join(often.select(*keys), keys, "left_anti").join(seldom, keys))


def free_name(df: DataFrame, what: str) -> str:
    """A column name that df doesn't have yet, upper and lower case being one."""
    taken = {c.lower() for c in df.columns}
    while what.lower() in taken:
        what += "_"
    return what


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of a key's text, modulo; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus
