"""Session helpers: configuration, shared-folder tables, partition spreading, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow lookup table counts as small enough to broadcast.
BROADCAST_ROWS = 50_000
#: Whether a written table's shuffle files are deleted at once instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: list[str] = []


def build_session(name: str = "kgflow", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (AQE on, UTC)."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset in local mode (tests) a temporary one. On a cluster it must be set."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="kgflow-shared-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, lost executors cost nothing, the shuffles it took leave no files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kgflow-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kgflow_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize has written, as soon as nothing will read them again."""
    for df in tables:
        _delete(df.sparkSession, df._kgflow_path)
        _WRITTEN.remove(df._kgflow_path)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """Give Python-heavy stages at least `factor` tasks a core; large inputs already have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * factor) if df.rdd.getNumPartitions() < cores * factor else df


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, computed once and written, with a broadcast hint if it has at most `rows` rows, without one (a shuffle join) beyond."""
    written = materialize(df, "small")
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def release(spark: SparkSession) -> None:
    """Deletes the tables this session has written into the shared folder; results that still read them must be saved before."""
    for path in _WRITTEN:
        _delete(spark, path)
    _WRITTEN.clear()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
