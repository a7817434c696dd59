"""Session settings, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Broadcasts are made only of tables whose rows were counted and found below this.
BROADCAST_ROWS = 200_000


def local_session(name: str = "tallyloom", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); a temporary one in local mode where none is set, as in tests.

    Elsewhere a missing folder is an error: executors would each write to a disk of their own.
    """
    context = spark.sparkContext
    at = context.getCheckpointDir()
    if at:
        return at
    wanted = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not wanted and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="tallyloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder; its lineage ends there, so a lost executor costs a read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """cut(df) and the number of its rows."""
    done = cut(df)
    return done, done.count()


def at_once(spark: SparkSession, *tasks: Callable[[], object]) -> list:
    """Results of tasks that don't depend on each other, run side by side so that their small jobs fill the cluster."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path within the shared one."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else as it is. df should be cheap to count (a file or a cut)."""
    n = df.limit(rows + 1).count()
    return F.broadcast(df) if n <= rows else df


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df.withColumns as a plan node that later filters and projections are not merged into.

    Catalyst would copy a long chain of derived columns into each later use; a generator of one row a row keeps them computed once.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
