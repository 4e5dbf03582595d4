"""What the operators of this subpackage share: tables, the shared folder, lineage cuts, batch bounds."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to a Python worker. Texts may be long, so batches are small.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``; where that is unset a temporary folder is made and set in
    local mode (tests on one machine), and an error raised on a cluster.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not found and context.getCheckpointDir().isDefined():
        found = context.getCheckpointDir().get()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomgraph-shared-')}"
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def work_dir(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, it is computed once, and its
    size is known to the planner, which broadcasts it only below its threshold."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` once all that reads them is written; their writers' shuffle files go too,
    which Spark removes when its driver collects garbage."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.cut_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        jvm.System.gc()


def join_counted(rows: DataFrame, one: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join on ``key`` with ``one``, which has a row of each key and in ``weight`` the number of its ``rows``.

    ``total`` bounds the number of all rows. Keys of more than a 10,000th of them are 10,000 at most, so what
    ``one`` has for them is broadcast and their rows stay where they are; other keys are too small for skew.
    """
    bound = max(64, total // 10_000)
    hot = F.broadcast(one.where(F.col(weight) > bound))
    rest = rows.join(hot.select(key), key, "left_anti").join(one.where(F.col(weight) <= bound), key)
    return rows.join(hot, key).unionByName(rest)


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, unless the session asks for even less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


_FILLED: list[dict] = []


def use_worker(*caches: dict) -> None:
    """To be called where a task begins in a Python worker; ``caches`` are what its operator keeps there.

    Spark gives a worker to the tasks of any operator in turn, so what another one kept goes first, and its memory
    back to the system: a worker holds the caches of one operator, not of all that ran before.
    """
    left = [c for c in _FILLED if c and not any(c is x for x in caches)]
    _FILLED[:] = caches
    for c in left:
        c.clear()
    if left:
        gc.collect()
        give_back()


def give_back() -> None:
    """Free memory of this process goes back to the system; else an idle worker keeps what its last task took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def texts(column) -> list[str]:
    """The strings of an Arrow column, null as empty."""
    return [x or "" for x in column.to_pylist()]


def pieces_of(rows: Iterable, most: int) -> Iterator[list]:
    """Lists of at most ``most`` rows."""
    held: list = []
    for x in rows:
        held.append(x)
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held
