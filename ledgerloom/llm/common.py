"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of one Arrow batch handed to a Python worker; one longer row travels alone.
BATCH_BYTES = 4 << 20
#: Most keys that a join treats as hot.
HOT_KEYS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for rows here range from nothing to whole books.

    A value that the session already sets below the default stays.
    """
    if int(spark.conf.get(_BATCH_CONF, str(2**31 - 1))) > 1 << 30:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def give_back_memory() -> None:
    """Return freed memory to the system after a large computation on the driver, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


_slot: list = [None, None]


def worker_cache(key, make):
    """What ``make`` gives for ``key``, kept until another key is asked for.

    Python workers outlive tasks and stages; with one slot a worker holds the tables of
    the operator it works for, and not those of all the operators it once worked for.
    """
    if _slot[0] != key:
        _slot[:] = [None, None]
        _slot[:] = [key, make()]
    return _slot[1]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only on a single machine, as in tests, a temporary folder is set where the session
    names none; a cluster without a shared folder is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        context = spark.sparkContext
        named = context.getCheckpointDir()
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
            named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def durable(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder.

    Spark deletes the shuffle files behind a checkpoint when the driver's JVM finds that
    nothing refers to them; it is asked to look, for else they pile up over the rounds.
    """
    shared_dir(frame.sparkSession)
    out = frame.checkpoint(eager=True)
    frame.sparkSession.sparkContext._jvm.System.gc()
    return out


def split_join(rows: DataFrame, unique: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, which has one row a key and in ``weight`` the number of its rows.

    Keys of more than one in ``HOT_KEYS`` of ``total`` rows are broadcast: there can be no
    more than ``HOT_KEYS`` of them, whatever the size.  The rest is shuffled, and no key of
    it fills a task.  ``total`` is the number of ``rows`` or more; keys are not null.
    """
    mark = fresh("hot", [*rows.columns, *unique.columns])
    hot = unique.where(F.col(weight) * HOT_KEYS > total).withColumn(mark, F.lit(True))
    met = rows.join(F.broadcast(hot), keys, "left")
    own = [c for c in unique.columns if c not in keys]
    cold = met.where(F.col(mark).isNull()).drop(mark, *own).join(unique.where(F.col(weight) * HOT_KEYS <= total), keys)
    return met.where(F.col(mark)).drop(mark).unionByName(cold)


def id_bucket(key: Column, modulus: int) -> Column:
    """``crc32(key as text) mod modulus``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list, limit: int):
    """Split ``texts`` into runs of about ``limit`` characters: (first, past last)."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def fresh(name: str, taken) -> str:
    """``name``, with underscores added until no column of ``taken`` has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
