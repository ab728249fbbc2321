"""Session helpers: a default session, reliable materialisation, checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast if it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: The same for sides whose rows may be long: at most so many bytes.
BROADCAST_BYTES = 64 << 20


def session(name: str = "quillspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and AQE; ``conf`` overrides, with ``__`` for dots."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset on one machine, as in tests, an own temporary one is set and
    removed when Python ends; on a cluster the setting is required, since executors can't see the driver's folders."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.conf.get("spark.master", "") or "").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        where = tempfile.mkdtemp(prefix="quillspark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def own_path(spark: SparkSession, kind: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quillspark/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def discard(spark: SparkSession) -> None:
    """Remove what this application wrote to the shared folder; for the end of a job, when no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/quillspark/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = own_path(spark, "table")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """``F.broadcast(df)`` if a count shows at most ``rows`` rows, else ``df`` as it is (AQE then picks the join). ``size``: an
    estimate of a row's bytes, where rows may be long; their sum must be at most ``BROADCAST_BYTES`` then."""
    if size is None:
        return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and total <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, if the plan's estimate of their bytes fills fewer splits than there are cores; a larger
    input has a task a split as it is read, and isn't shuffled. Only where rows are worked on depends on it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * split else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
