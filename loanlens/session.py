"""Session for local runs, and where intermediate tables may be written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Paths that this process has given out, so that ``scratch`` can remove them.
_given: list[str] = []


def local_session(cores: str | int = 8, name: str = "loanlens") -> SparkSession:
    """Session for tests and the bench. On a cluster, pass the cluster's own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back on a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path under the shared folder."""
    _given.append(f"{work_dir(spark).rstrip('/')}/loanlens-{name}-{uuid.uuid4().hex}")
    return _given[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at the end of the block, the tables that were written inside it. Results
    are lazy and may read them, so consume or save results inside, too."""
    before = len(_given)
    try:
        yield
    finally:
        for path in _given[before:]:
            remove(spark, path)
        del _given[before:]


def settle(df: DataFrame, evenly: bool = False) -> DataFrame:
    """Write the frame once to the shared folder and go on from the written table.

    For frames that several jobs read: later jobs neither repeat the work nor
    lose it with an executor, and they read only the columns they use. ``evenly`` deals the
    rows over all tasks first, for tables that very many passes read: a pass takes as long as
    its largest task, and adaptive execution leaves few files of unequal size.
    """
    path = new_path(df.sparkSession, "settled")
    if evenly:
        spark = df.sparkSession
        df = df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A report of a few driver-side rows (per feature, setting or component).

    Passed as Arrow it becomes a local relation, which needs no job to be read.
    """
    fields = T.StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    arrow = pa.table(
        [pa.array(list(values), type=to_arrow_type(f.dataType)) for values, f in zip(columns, fields)],
        names=fields.names,
    )
    return spark.createDataFrame(arrow, fields)
