"""Session settings and the few driver-side helpers every operator shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only below this many rows, counted beforehand.
BROADCAST_ROWS = 400_000
#: A key is hot from this share of all rows on: one in so many. There can't be more hot keys than that.
HOT = 1000

_local_dir: str | None = None
_written: list[str] = []


def local_dir() -> str:
    """A folder of this process for sessions on one machine, removed when the process ends."""
    global _local_dir
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="lexspark-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return "file://" + _local_dir


def build_session(app: str = "lexspark", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use; its shared folder is on this machine."""
    return (
        SparkSession.builder.appName(app)
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", local_dir())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a session on one machine may leave it unset."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return local_dir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Write to Parquet in the shared folder and read it again: as materialize(), but columnar and prunable.

    The table stays until release(): lazy results read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables written so far, once the results that read them are stored; returns how many."""
    n = len(_written)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, else df itself (a shuffle join then).

    Pass a materialized frame: it is counted here.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined to right, whose keys are distinct or few rows each; keys that hold a large share of left are split off.

    Rows of hot keys, HOT keys at most, stay where they are and meet a broadcast of those keys' rows of right; the rest
    is an ordinary join. Null keys match nothing: a left join keeps their rows without a shuffle. Pass written frames:
    both are read twice. how: inner or left.
    """
    known = left.dropna(subset=on)
    counts = known.groupBy(*on).agg(F.count("*").alias("_n"))
    total = known.count()
    hot = written(counts.filter(F.col("_n") * HOT > total).filter(F.col("_n") > HOT).select(*on))
    if hot.isEmpty():
        out = known.join(right, on, how)
    else:
        out = known.join(F.broadcast(hot), on, "left_anti").join(right, on, how).unionByName(known.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), on, "left_semi")), on, how))
    if how == "left":
        absent = left.filter(" or ".join(f"`{c}` is null" for c in on))
        out = out.unionByName(absent.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c not in on]).select(*out.columns))
    return out
