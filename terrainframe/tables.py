"""Reading input tables and writing intermediate ones to the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own, removed at exit; a cluster is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="terrainframe-")
        atexit.register(shutil.rmtree, _OWN_DIR[app], ignore_errors=True)
    return _OWN_DIR[app]


def session_dir(spark: SparkSession) -> str:
    """This session's folder of intermediate tables."""
    return f"{shared_dir(spark)}/terrainframe/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once and read back: iteration lineage is cut, and a lost executor loses nothing."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._terrainframe_path = path
    return out


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for joins that shuffle both sides. Spark estimates sizes from compressed files and knows nothing of what ``explode`` adds, so it would
    broadcast, through the driver, tables many times the size it allows."""
    return df.hint("merge")


def shuffle_parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, *keys: str, join: str = "merge") -> DataFrame:
    """``df`` by keys in as many partitions as a shuffle has: few rows may make very many in a join, so small partitions must not be put together.
    ``join`` is the kind of shuffled join; "shuffle_hash" holds this side's partition in memory and spares the sort."""
    return df.repartition(shuffle_parts(df), *keys).hint(join)


def written(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for tables that grow with the input: joins with them shuffle."""
    out = materialise(df, name)
    hinted = shuffled(out)
    hinted._terrainframe_path = out._terrainframe_path
    return hinted


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialise`` gave, once nothing reads it any more: a round that the next has taken over."""
    path = getattr(df, "_terrainframe_path", None)
    if path:
        _remove(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Remove all intermediate tables of the session; results that were not written read from them."""
    _remove(spark, session_dir(spark))
