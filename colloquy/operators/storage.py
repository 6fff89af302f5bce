"""Tables that a job leaves in the shared folder on its way, so that lost executors don't cost what came before."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame

_own: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the folder of spark.checkpoint.dir and drop the lineage; only a local master may go without that setting."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            if not _own:
                _own.append(tempfile.mkdtemp(prefix="colloquy-"))
                atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
            named = _own[0]
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)
