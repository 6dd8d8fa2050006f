"""Session helpers: a configured SparkSession and the shared materialisation folder.

Stage tables that several products read are written as parquet under the folder the cluster
names in ``spark.checkpoint.dir``; lineage is cut there, and a lost executor only costs the
tasks it held.  In local mode, where one machine is the whole cluster, the warehouse folder
serves when nothing is named; anywhere else a missing setting is an error.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import uuid
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def _default_driver_memory() -> str:
    """Local mode runs every task in the driver JVM: give it 60 % of RAM, at most 16 GB."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6) >> 30))}g"


def get_spark(
    master: str = "local[*]", shuffle_partitions: int = 8, app: str = "spendlens", driver_memory: str | None = None
) -> SparkSession:
    driver_memory = driver_memory or os.environ.get("SPENDLENS_DRIVER_MEMORY") or _default_driver_memory()
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for materialised tables (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return root.rstrip("/")


PACKAGE_ROOT = str(Path(__file__).resolve().parents[1])


def ship_package(df: DataFrame) -> DataFrame:
    """``df``; Python workers that Spark starts from now on find this package where the driver did."""
    env = df.sparkSession.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, have)])
    return df


_CLEANED: set[str] = set()
_TABLES: list[str] = []  # bucketed tables of this application, dropped with its folder


def application_folder(spark: SparkSession, name: str) -> str:
    """This application's folder under the shared root; it is removed when the driver ends."""
    folder = f"{checkpoint_root(spark)}/{name}/{spark.sparkContext.applicationId}"
    if folder not in _CLEANED:
        _CLEANED.add(folder)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def remove() -> None:
            while _TABLES:
                label = _TABLES.pop()
                try:
                    spark.sql(f"DROP TABLE IF EXISTS {label}")
                except Exception:  # noqa: BLE001 - a stopped session has no catalogue of its own left
                    break
            path = jvm.org.apache.hadoop.fs.Path(folder)
            try:
                path.getFileSystem(conf).delete(path, True)
            except Exception:  # noqa: BLE001 - the JVM may be gone already; nothing else is left to do
                pass

        atexit.register(remove)
    return folder


def table_path(spark: SparkSession, name: str, *parts: str) -> str:
    """Deterministic location for a materialised table of this application."""
    key = hashlib.sha1("|".join(parts).encode()).hexdigest()[:12]
    return f"{application_folder(spark, 'spendlens')}/{name}-{key}"


def materialize(
    df: DataFrame, name: str, *parts: str, partition_by: list[str] | None = None, cluster_key: list[str] | None = None,
    ranges: str | None = None,
) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it (cuts lineage).

    ``ranges`` names a column of range numbers that hashing deals evenly (``ordered.part_codes``), where ranges of the
    partition columns are known already; it is not written.

    Re-running a task after an executor loss rewrites only that task's file; the
    committed table is durable and later jobs read it instead of recomputing.
    """
    spark = df.sparkSession
    path = table_path(spark, name, *parts)
    if partition_by:
        # range-cluster on the partition columns plus a unique key: equal-sized tasks even
        # under a skewed partition value, and each task writes one or two folders
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df = df.repartition(n, ranges).drop(ranges) if ranges else df.repartitionByRange(n, *partition_by, *(cluster_key or []))
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, None if there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise  # only a table that does not exist yet counts as none
        return None


def materialize_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write ``df`` once as a table bucketed by ``column``; grouping by it reads the buckets without a shuffle.

    Buckets are known from the catalogue only, so the table is registered under a name of its own, with its files in
    the application's folder.
    """
    spark = df.sparkSession
    label = f"spendlens_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = table_path(spark, name, label)
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(label)
    _TABLES.append(label)
    return spark.table(label)
