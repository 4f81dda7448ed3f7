"""What the operators share: unused column names, row keys, and where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names that clash with none of columns (Spark compares without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """A new folder name in the shared folder that the session names; where a local session names none (tests), in a folder of its own, which is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and known.isDefined():
        base = known.get()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmill-")
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quillmill-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept reliably in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def text_key(text: Column) -> Column:
    """Together with the document's id it names a row; rows alike in both are one document."""
    return F.xxhash64(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
