"""Session helpers shared by operators and plans."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Held while a checkpoint is taken under settings of its own, so that two threads do not undo each other's.
_SETTINGS = threading.RLock()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of checkpoints, as the session names it.

    Only a local master may go without the setting, and gets a temporary folder of its own; on a cluster a folder of one machine would lose
    intermediate results, so its absence is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quarrion-ckpt-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def durable(df: DataFrame, broadcast: bool = True) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    The folder comes from the session (``checkpoint_folder``). Neither
    constraints nor size estimates are carried over: through the rounds of an iterative operator the ones multiply and
    the others square on the driver, to numbers of millions of digits. Adaptive execution knows the true sizes. Without
    ``broadcast`` no join below is broadcast: the driver keeps some megabytes of each.
    """
    checkpoint_folder(df.sparkSession)
    conf, own = df.sparkSession.conf, {"spark.sql.constraintPropagation.enabled": "false"}
    if not broadcast:
        own |= {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    with _SETTINGS:
        before = {k: conf.get(k, None) for k in own}
        for k, v in own.items():
            conf.set(k, v)
        try:
            kept = df.checkpoint()
            jvm = kept.sparkSession._jsparkSession
            return DataFrame(jvm.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False), kept.sparkSession)
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of a caller cannot clash with working names."""
    return df.select(*names)
