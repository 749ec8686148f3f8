"""Session helpers: reliable checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a reference table is held small enough to broadcast.
BROADCAST_ROWS = 100_000


def build_session(app: str = "clipweave", cores: str = "8", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of ``spark.checkpoint.dir``; make one up only where none is named."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(named)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="clipweave-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which outlives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``rows`` rows; otherwise leave the join to Catalyst.

    The check itself reads at most ``rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def broadcast_hint(df: DataFrame, rows: int = BROADCAST_ROWS) -> Callable[[DataFrame], DataFrame]:
    """``broadcast`` for tables derived from ``df`` by a constant factor, if it has at most ``rows`` rows; one check for all."""
    return F.broadcast if df.limit(rows + 1).count() <= rows else lambda derived: derived


#: Keys that count as hot in ``join_unique``: the most frequent ones above a number of rows.
HOT_KEYS, HOT_ROWS = 1000, 10_000


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has each key at most once, with the rows of hot keys left in place.

    The most frequent keys of ``left``, at most ``HOT_KEYS`` and only those of more than ``HOT_ROWS`` rows, are
    counted first (summed up before the shuffle); their rows of ``right``, as many at most, are broadcast. Any
    other key has less than a thousandth of the rows. Without hot keys this is the plain join. ``left`` is
    read twice, or three times where keys are hot, so it should be a scan or have been cut off.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT_ROWS)
    hot = counts.orderBy(F.desc("_n")).limit(HOT_KEYS).drop("_n").collect()
    if not hot:
        return left.join(right, keys, how)
    few = F.broadcast(left.sparkSession.createDataFrame(hot, counts.drop("_n").schema))
    here = left.join(few, keys, "left_semi").join(F.broadcast(right.join(few, keys, "left_semi")), keys, how)
    rest = left.join(few, keys, "left_anti").join(right, keys, how)
    return here.unionByName(rest)
