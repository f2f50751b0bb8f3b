"""Broadcasting with a checked size, and cutting lineage."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                 limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join, broadcasting ``small`` only once its row count is known to be within ``limit``.

    Beyond the limit the join is left to the planner, where adaptive execution
    splits skewed partitions.
    """
    small = small.persist(StorageLevel.MEMORY_AND_DISK)  # counted here, joined below
    within = len(small.select(*on).take(limit + 1)) <= limit
    return big.join(F.broadcast(small) if within else small, on, how)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from there.

    The folder is the session's ``spark.checkpoint.dir``. Only a purely local
    session without one gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="riskset-"))
    return df.checkpoint(eager=True)


def shared_folder(spark) -> str:
    """The folder the cluster names for intermediate tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    import tempfile

    return tempfile.mkdtemp(prefix="riskset-")
