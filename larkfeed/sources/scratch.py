"""Intermediate tables in the shared folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_KEY = "spark.larkfeed.scratch"
_made: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. A temporary one is taken only where none is set and all tasks run in this process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="larkfeed-")
        spark.conf.set(_KEY, root)
    _made.append(f"{root}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def kept(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: its rows don't change however often they are read, and a lost executor costs
    no recomputation."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def seen_of(seen: Observation, rows: DataFrame, metrics: list[Column]) -> dict:
    """What was observed; of a plan that the optimizer found to be empty nothing is, so that is computed from the rows."""
    try:
        return seen.get
    except Py4JJavaError:
        return rows.agg(*metrics).first().asDict()


def kept_seen(df: DataFrame, name: str, *metrics: list[Column]) -> tuple[DataFrame, list[dict]]:
    """df as of `kept`, and each list of aggregates as observed while it was written."""
    seen = [Observation() for _ in metrics]
    for s, m in zip(seen, metrics, strict=True):
        df = df.observe(s, *m)
    back = kept(df, name)
    return back, [seen_of(s, back, m) for s, m in zip(seen, metrics, strict=True)]


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may not have it, before the first of its functions runs there."""
    sc = spark.sparkContext
    if not getattr(sc, "_larkfeed_shipped", False):
        package = Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp()}/larkfeed.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in package.rglob("*.py"):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(path)
        sc._larkfeed_shipped = True


def mark() -> int:
    """Where `dropped` begins."""
    return len(_made)


def dropped(spark: SparkSession, since: int) -> None:
    """Delete the tables that were made since `mark`, when nothing reads them any more."""
    for path in _made[since:]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _made[since:]
