"""Tables between the rounds of an iteration, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder, without the plan that made it; it survives lost executors. spark.checkpoint.dir
    names the folder; unset, it is one of our own where driver and executors are one process, and else an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="panelscope-")
        context.setCheckpointDir(found)
    return df.checkpoint()
