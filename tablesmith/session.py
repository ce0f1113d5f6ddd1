"""Session helpers: a configured local session for tests/bench, and the
shared checkpoint folder taken from the cluster configuration."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                app: str = "tablesmith") -> SparkSession:
    """Local session for tests and the benchmark. On a cluster, build your own
    session; every operator only needs ``spark.sql.session.timeZone=UTC``."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that setting names a shared, durable folder and is used as is.
    Only where it is unset on a local master (tests) do we create one ourselves; on a
    cluster without it this is an error, as a machine's own folder would lose files.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        return current
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="tablesmith-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


SMALL_ROWS = 100_000        # a table that one task reads well enough
ROWS_PER_TASK = 50_000
TASKS_PER_CORE = 4


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK, small_rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, a checkpointed table, dealt anew over more partitions where its partitions are too few for its rows: a
    Parquet row group is read by one task, and every later pass over the table would run in that one task."""
    parts = df.rdd.getNumPartitions()
    most = TASKS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    if parts >= most:
        return df
    rows = df.count()
    wanted = min(most, -(-rows // rows_per_task))
    return df if rows <= small_rows or parts >= wanted else cut_lineage(df.repartition(wanted))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tablesmith`` importable in the Python workers (Pandas UDF code
    refers to its modules): zip the package once and ``addPyFile`` it, as
    ``--py-files`` would on a cluster submit."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    zpath = os.path.join(tempfile.mkdtemp(prefix="tablesmith-pkg-"), "tablesmith.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)
