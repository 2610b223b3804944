"""Settings that tie iterative jobs to the cluster they run on.

Two things are decided here: where cut lineage is written, and how many
partitions a loop uses for a given amount of data.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROWS_PER_PARTITION = 2_000_000
MIN_ROWS_PER_PARTITION = 65_536


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that holds checkpoints.

    ``spark.checkpoint.dir`` is taken from the session.  Only a local session
    that names no folder gets one of its own; a cluster session without the
    setting is an error, because a folder on one machine is lost with it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="sparkgas-")
        sc.setCheckpointDir(named)
    return named or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder for a table written on the way."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table or text written on the way."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """The tables that :func:`cut` wrote in a ``with`` block: all are deleted at its end, but for those kept.

    Also if the block fails.  What is kept belongs to the block around, if there
    is one, else to the caller.  A result that is evaluated later keeps the tables
    it is read from; Spark deletes them with it if
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """

    _open: ContextVar[tuple[Scratch, ...]] = ContextVar("scratch", default=())

    def __init__(self):
        self.written: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        self._token = self._open.set((*self._open.get(), self))
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.written = [w for w in self.written if not any(w is t for t in tables)]
        outer = self._open.get()[:-1]
        if outer:
            outer[-1].written += tables

    def __exit__(self, *failure) -> None:
        self._open.reset(self._token)
        for table in self.written:
            drop(table)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from the written rows.

    The written rows keep their partitioning and ordering, so the next join on
    the same key needs no exchange on this side.
    """
    checkpoint_dir(df.sparkSession)
    written = df.checkpoint(eager=True)
    if scopes := Scratch._open.get():
        scopes[-1].written.append(written)
    return written


def cut_counting(df: DataFrame, flag: str) -> tuple[DataFrame, int]:
    """:func:`cut`, and the number of rows whose ``flag`` is true, counted while they are written."""
    seen = Observation()
    written = cut(df.observe(seen, F.count_if(F.col(flag)).alias("n")))
    return _without_estimates(written), seen.get["n"]


def cut_in_loop(df: DataFrame) -> DataFrame:
    """:func:`cut`, for a table that the next round's joins are made of."""
    return _without_estimates(cut(df))


def _without_estimates(written: DataFrame) -> DataFrame:
    """The same written rows, without the size estimate and constraints of the plan that made them.

    The estimate for a join is a product, so in a loop its digits double from round
    to round, until planning a round takes minutes and then fails.
    """
    spark = written.sparkSession
    java, rows = spark._jvm, written._jdf.queryExecution().analyzed()
    none = java.scala.Option.empty()
    fresh = java.org.apache.spark.sql.execution.LogicalRDD(
        rows.output(), rows.rdd(), rows.outputPartitioning(), rows.outputOrdering(), False, none, spark._jsparkSession, none, none
    )
    out = DataFrame(java.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, fresh), spark)
    for scope in Scratch._open.get()[-1:]:
        scope.written = [out if w is written else w for w in scope.written]
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the rows that :func:`cut` wrote for ``df``, once nothing reads them any more."""
    if df is None:
        return
    spark = df.sparkSession
    written = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if written.isDefined():
        delete_path(spark, written.get())


def partitions_for(spark: SparkSession, rows: int) -> int:
    """Number of shuffle partitions for a loop over ``rows`` rows, of its larger table.

    The number grows with the rows, without an upper limit.  It is at least the
    configured one, unless that would leave partitions of hardly any rows.
    """
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_size = math.ceil(rows / ROWS_PER_PARTITION)
    return max(1, by_size, min(configured, math.ceil(rows / MIN_ROWS_PER_PARTITION)))


@contextmanager
def fixed_layout(spark: SparkSession, n: int):
    """Plan the body for tables that rest in ``n`` partitions, then restore the settings.

    All exchanges then agree with the layout of the edges.  Adaptive planning is
    off meanwhile: it would forget how checkpointed rows are partitioned, and
    every round would exchange its vertices twice.  So are broadcasts that nobody
    asked for: they would send resting edges through the driver in every round.
    """
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
    }
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
