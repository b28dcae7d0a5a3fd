"""Session settings shared by every job."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

# Runtime settings the column rules rely on. All of them can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # The last value of a repeated attribute key wins.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # The last value of a repeated JSON key wins.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Wide chains of derived text columns make the inferred-constraint sets explode at plan time.
    "spark.sql.constraintPropagation.enabled": "false",
    # Methods above this size are not compiled by HotSpot; wide projections then run per operator,
    # in methods that are split and compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to Python workers, once for each application; they may run in any folder of any machine."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spanloom-")) / "spanloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings above to an existing session, and ship the package to its workers."""
    ship(spark)
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "spanloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session. On a cluster leave ``master`` out and let spark-submit decide."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """Shared folder for checkpoints: the one the cluster names, else ``fallback``."""
    path = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return path.rstrip("/")


def once(df: DataFrame) -> DataFrame:
    """The same rows through a generator of one row, so that their columns are computed once.

    The optimizer moves a later filter down to the scan, together with all that makes the columns it reads, and computes them
    there a second time, in as few tasks as the scan has; it never moves a filter on what a generator makes.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


TASKS_PER_CORE = 4
MANY_SPLITS = 16  # splits of a file for each core
TASK_ROWS = 50_000  # rows of one task at most, so that a larger table has more tasks and not longer ones


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over several tasks for each core; a frame of many splits stays as it is.

    Decoding JSON is CPU-bound, so one small file should not keep it on one core. Nor do a few splits for each core say that the rows
    are spread: a split without the start of a row group is empty. Inputs of many splits are not shuffled, unless these hold many rows.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits, wanted = df.rdd.getNumPartitions(), -(-df.count() // TASK_ROWS)
    if splits >= max(MANY_SPLITS * cores, wanted):
        return df
    return once(df.repartition(max(TASKS_PER_CORE * cores, wanted)))


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, so that any folder is shared."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def stage(df: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Write a frame once to the shared checkpoint folder and read it back.

    For frames that are costly to make and used more than once: it cuts the lineage, survives lost
    executors, and later reads take only the columns they need.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or root
    if base is None:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="spanloom-")
    path = f"{base.rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
