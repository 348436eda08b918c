"""Sessions, the shared folder for intermediate tables, and table loading."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOTS: list[str] = []
#: Whether a job's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Give the package to the session's Python workers, once, where they would not find it themselves.

    They do if PYTHONPATH names its folder, or, on one machine, if the driver was started there.
    """
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    found = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if (sc.master or "").startswith("local["):
        found.add(os.getcwd())
    if root in found or "site-packages" in root or any(os.path.basename(f).startswith("millrace-") for f in sc._python_includes):
        return
    folder = tempfile.mkdtemp(prefix="millrace-")  # read by the driver only, which serves the file to the workers
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, f"millrace-{uuid.uuid4().hex}"), "zip", root, "millrace"))


def local_session(cores: int = 8, shuffle: int | None = None, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("millrace")
        .config("spark.sql.shuffle.partitions", str(shuffle or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process, a temporary folder is made and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOTS:
        _LOCAL_ROOTS.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _LOCAL_ROOTS[0], ignore_errors=True)
    return "file://" + _LOCAL_ROOTS[0]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to a new table of the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a recomputation, and lets a plan use an expensive
    stage several times while it runs once. The shuffle files of the job are removed when the table is written: else
    they would stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a compressed table that are worth a task of their own.
TASK_BYTES = 256 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of that name. One in fewer pieces than the session has cores, such as a single small file, is dealt out
    to as many tasks as its size is worth; a large table, which is read in many pieces, is left as it is."""
    ship(spark)
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    tasks = min(spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    return df.repartition(tasks) if tasks > 1 and df.rdd.getNumPartitions() < tasks else df
