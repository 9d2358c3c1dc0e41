"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Everything that is not a word character, after A-Z are lower-cased: ASCII save digits and a-z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A run of what is not ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"
HASH_RANGE = 2.0**64
#: Rows from which a row that many others meet is broadcast: at most HOT_GROUPS of them have as many.
HOT_ROWS, HOT_GROUPS = 10_000, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a temporary folder is made
    and set for a session on one machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="silvatrack-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder: it cuts the lineage, and outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Gives the machine what this Python worker's allocators hold and do not use. A worker outlives its tasks, and so would what the
    largest of them took; it counts against the executor while others, or the JVM alone, work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # not glibc
        pass


def tidy(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """each, a function of a task's batches, that gives back memory after every batch and when the task ends."""

    def between(batches: Iterable) -> Iterator:
        for b in batches:
            yield b
            del b
            give_back()

    @functools.wraps(each)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from each(between(batches))
        finally:
            give_back()

    return run


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone. Texts that are all ASCII take the much faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def words(text: Column) -> Column:
    """The lower-cased words of a text, in order; a null text has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores until no column of df has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(*cols: Column | str) -> Column:
    """A number from 0 to 1 that depends on the values alone."""
    return F.xxhash64(*cols).cast("double") / HASH_RANGE + 0.5


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _has_map(kind.elementType)
    return isinstance(kind, MapType) or (isinstance(kind, StructType) and any(_has_map(f.dataType) for f in kind.fields))


def row_hash(df: DataFrame, number: int = 0) -> Column:
    """A hash of all columns of a row; of maps, which have none, as their JSON. Rows that are equal have equal hashes of each number."""
    columns = [F.to_json(F.struct(F.col(f"`{f.name}`").alias("x"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*([F.lit(number)] if number else []), *columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def meet(rows: DataFrame, known: DataFrame, on: list[str], weight: str, hot_rows: int | None = None) -> DataFrame:
    """rows joined with known, a kept table with one row for each value of on, and in weight how many rows meet it. Rows of
    known that very many meet are broadcast, so that no value is one task's; weight is dropped."""
    total, top = known.agg(F.coalesce(F.sum(weight), F.lit(0)), F.coalesce(F.max(weight), F.lit(0))).first()
    limit = max(HOT_ROWS if hot_rows is None else hot_rows, math.ceil(total / HOT_GROUPS))
    if top < limit:
        return rows.join(known, on).drop(weight)
    hot = F.col(weight) >= limit
    added = [c for c in known.columns if c not in on and c != weight]
    few = F.broadcast(known.filter(hot).select(*on, F.struct(*added).alias("hot_")))
    met = rows.join(few, on, "left")
    cold = met.filter("hot_ IS NULL").drop("hot_").join(known.filter(~hot).drop(weight), on)
    return cold.unionByName(met.filter("hot_ IS NOT NULL").select(*rows.columns, *[F.col(f"hot_.{c}").alias(c) for c in added]))
