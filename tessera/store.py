"""Tables written once where a plan reads the same rows several times.

The folder is the one the session names in ``spark.checkpoint.dir``, which all
executors share.  Where that is unset, a session in one process (tests, a laptop)
gets a folder of its own, and a cluster an error: each executor would write to
its own disk.  A written table survives lost executors, is pruned by column when
it is read, and is removed when Python ends or when ``drop`` is called.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SENT = 128 << 20
MOST_ROWS = 500_000
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="evidence-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df's rows as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/evidence/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._written_path = path
    return back


def drop(*tables: DataFrame) -> None:
    """Remove written tables that no later plan reads."""
    for df in tables:
        _delete(getattr(df, "_written_path", None))


def size(df: DataFrame, lists: tuple[str, ...] = ()) -> int:
    """About the bytes that df's rows take once broadcast as a hash table: 64 a row
    and 16 for each value, with each entry of the named array columns."""
    row = F.lit(64 + 16 * len(df.columns))
    for c in lists:
        row = row + 16 * F.greatest(F.size(c), F.lit(0))
    return df.agg(F.sum(row)).first()[0] or 0


def sent(df: DataFrame, most: int = MOST_SENT, lists: tuple[str, ...] = ()) -> DataFrame:
    """df marked for broadcast if its rows take at most ``most`` bytes; otherwise
    df, which then joins as Spark decides.  Text columns are not expected here."""
    return F.broadcast(df) if size(df, lists) <= most else df


def parts(*tables: DataFrame, rows: int = 0) -> int:
    """Partitions that hold at most about ``rows`` (``MOST_ROWS``) of the tables' rows.

    An exchange of that number isn't merged again by size, as short rows that
    compress well would be, so a task's memory stays the same with any input.
    """
    return max(1, -(-sum(t.count() for t in tables) // (rows or MOST_ROWS)))


def _delete(path: str | None) -> None:
    spark = _written.pop(path, None) if path else None
    if spark is None:
        return
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the session has ended already
            _written.clear()
