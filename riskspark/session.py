"""Session helpers: a local session for tests/bench and the shared work folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


# Settings for a large cluster (set by the launcher; listed here as the design point).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",                      # runtime re-plan: join strategy, coalescing
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",  # shuffle partitions sized to executor memory
    "spark.sql.adaptive.skewJoin.enabled": "true",             # split skewed join partitions
    "spark.sql.shuffle.partitions": "8000",                    # initial; AQE coalesces down
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",             # size-checked broadcasts only
    "spark.sql.execution.arrow.pyspark.enabled": "true",       # mapInPandas batches
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskspark") -> SparkSession:
    """Session for tests and the bench. A cluster session comes from the launcher."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder named by ``spark.checkpoint.dir``.

    On a cluster the launcher sets it (HDFS/S3/ABFS path). Only when it is
    unset -- local tests -- do we create one, and register it so that
    ``DataFrame.checkpoint()`` uses the same place.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="riskspark-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared folder for an intermediate table."""
    base = f"{shared_dir(spark).rstrip('/')}/riskspark/scratch-{spark.sparkContext.applicationId}"
    if base not in _SCRATCH:
        _SCRATCH.add(base)
        atexit.register(_remove, spark.sparkContext, base)
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


_SCRATCH: set[str] = set()


def _remove(sc, path: str) -> None:
    """Delete this application's intermediates when the driver ends (a stopped context leaves them to the next clean-up)."""
    if sc._jsc is None or sc._jsc.sc().isStopped():
        return
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def model_dir(spark: SparkSession) -> str:
    """Where fitted models stay between sessions: ``riskspark.model.dir`` if set, else a fixed folder
    below the configured shared folder (not the random one that a SparkContext makes below it)."""
    given = spark.conf.get("riskspark.model.dir", None)
    if given:
        return given.rstrip("/")
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or shared_dir(spark)
    return f"{base.rstrip('/')}/riskspark/models"


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as Parquet to the shared folder and reading it back.

    Survives executor loss (the files live on shared storage), keeps Parquet
    statistics for later pushdown, and stops later fits from re-running the
    upstream plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def is_plain_scan(df) -> bool:
    """True when the optimized plan has only projections and filters over one file scan (cheap to re-read)."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return node.children().isEmpty() and node.nodeName().startswith(("LogicalRelation", "Relation"))


def reusable(df, name: str, materialize: bool | None = None):
    """Input for an operator that reads it several times: a derived plan is written once
    to the shared folder (auto), a plain file scan is used as is."""
    if materialize is None:
        materialize = not is_plain_scan(df)
    return globals()["materialize"](df, name) if materialize else df


#: Bytecode that the JVM still compiles in one method; a larger one is interpreted, many times slower.
COMPILED_BYTES = "8000"


def spread(df, name: str):
    """``df`` written once to the shared folder in at least as many files as there are cores: costly work on its rows
    runs on all of them. Only a table of fewer partitions than cores is shuffled. While it is written, expressions of many columns
    are split into methods that the JVM compiles."""
    spark, limit = df.sparkSession, "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, COMPILED_BYTES)
    try:
        out = materialize(df, name)
    finally:
        spark.conf.set(limit, before)
    cores = spark.sparkContext.defaultParallelism
    return out if out.rdd.getNumPartitions() >= cores else materialize(out.repartition(cores), name)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskspark`` importable in Python workers (executors) via ``addPyFile``.

    Needed only where executor-side Python runs our code (``mapInPandas``).
    The zip is written to the shared folder once per SparkContext.
    """
    import io
    import pathlib
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for p in root.rglob("*.py"):
            zf.write(p, str(p.relative_to(root.parent)))
    target = scratch_path(spark, "pyfiles") + "/riskspark.zip"
    jvm_path = sc._jvm.org.apache.hadoop.fs.Path(target)
    fs = jvm_path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(jvm_path, True)
    out.write(bytearray(buf.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
