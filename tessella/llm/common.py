"""Pieces shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import re
import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java's, RE2's and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
SPACE = r"[\x20\x09-\x0D]+"

#: Lower-cases A-Z only, as the contracts of the word-based operators ask.
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: A side of a join is broadcast only if it was counted and has no more rows.
BROADCAST_ROWS = 20_000

#: Bytes of a table, as its files have them, in a hash range: what a worker sorts at once is a few times that.
RANGE_BYTES = 8 << 20
#: Rows of a written table of small rows in one of its files, where their number is known.
FILE_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; one of our own where that is unset and one machine does everything."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file:///tmp/checkpoints/tessella"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: a cut of lineage that outlives executors.

    rows: the most rows it can have, if known and small each; then it takes no more files than these need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if counting shows at most `most` rows; else Spark plans a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def looked_up(many: DataFrame, one: DataFrame, on: list[str]) -> DataFrame:
    """many with the columns of one, whose keys are unique; null where it doesn't have the key.

    A key may hold any share of many: its rows are dealt by a hash of the whole row, and each share looks the key up for itself.
    """
    shares = int(many.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = many.withColumn("__share", F.pmod(F.xxhash64(*many.columns), F.lit(shares)))
    known = dealt.select(*on, "__share").distinct().join(one, on)
    return dealt.join(known, [*on, "__share"], "left").drop("__share")


def _bytes(df: DataFrame) -> int | None:
    """Bytes of what df is read from; None if Spark doesn't know."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 60 else None


def of_known_size(df: DataFrame, name: str) -> DataFrame:
    """df; written as a table and read back if Spark doesn't know how large it is."""
    return materialise(df, name) if _bytes(df) is None else df


def hash_ranges(df: DataFrame, size: int = RANGE_BYTES) -> int:
    """Into how many ranges hashes of df are dealt: as many as there are shuffle partitions, and more for a
    table so large that a range of it would not fit a worker. df: of known size."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-_bytes(df) // size))


def in_fold(doc_id, modulus: int, remainder: int):
    """True where crc32 of the id as text has that remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def worker_memory(name: str, key: object, make: Callable[[], Any]) -> Any:
    """make(), kept in the Python worker for its later tasks. It keeps one object, so another name or key replaces it.

    What is kept must be a pure memory of results: a worker may start empty at any time.
    """
    kept = sys.modules.setdefault("tessella_worker_memory", types.ModuleType("tessella_worker_memory"))
    if getattr(kept, "slot", (None, None))[0] != (name, key):
        kept.slot = (None, None)  # the old one goes first
        kept.slot = ((name, key), make())
    return kept.slot[1]


def give_back() -> None:
    """Returns memory that this Python worker has freed to the machine, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy_driver(spark: SparkSession) -> None:
    """Collects what ended queries left in the driver: plans, generated classes and broadcasts, which Spark's cleaner then drops everywhere."""
    spark.sparkContext._jvm.System.gc()


def tidy(f: Callable) -> Callable:
    """f of a group's table, after which memory is given back."""

    @functools.wraps(f)
    def of_group(table):
        out = f(table)
        give_back()
        return out

    return of_group


def tidy_pair(f: Callable) -> Callable:
    """f of the tables of two groups of one key, after which memory is given back."""

    @functools.wraps(f)
    def of_groups(left, right):
        out = f(left, right)
        give_back()
        return out

    return of_groups


def tidy_batches(f: Callable) -> Callable:
    """f of a task's batches, after which memory is given back."""

    @functools.wraps(f)
    def of_batches(batches):
        yield from f(batches)
        give_back()

    return of_batches
