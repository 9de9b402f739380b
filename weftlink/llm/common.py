"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.lineage import cut_lineage, shared_dir  # noqa: F401  the operators' too

#: Tasks over which a hot key of a join is dealt. A key is hot with over HOT_ROWS rows and over one in MOST_HOT of all.
SALTS = 16
HOT_ROWS, MOST_HOT = 1000, 10_000
#: Texts are handed to numpy in groups of about this many bytes, so memory follows this and the longest text.
GROUP_BYTES = 1 << 20
#: Rows of documents that Python gets at once.
BATCH_ROWS = 2000
#: Rows of wide tables that the reader of Parquet holds at once.
READ_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def rank_hash(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) by which a bounded sample is drawn; the same for a doc_id on every run."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(doc_id)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], weight: str, how: str = "inner", salts: int = SALTS, sizes: DataFrame | None = None) -> DataFrame:
    """left joined to right, unique by keys, where a key may hold a large part of left. weight: right's column with about how many rows of left a key has.

    Hot keys, of which there are MOST_HOT at most by their definition, are dealt over several tasks by the columns in
    spread, and right's rows for them are repeated that often. right is written first, as it is read twice; not so if
    sizes (keys, weight), a written table, is given.
    """
    if sizes is None:
        right = cut_lineage(right)
        sizes = right.select(*keys, weight)
    total, most = sizes.agg(F.sum(weight), F.max(weight)).first()
    least = max(HOT_ROWS, (total or 0) // MOST_HOT)
    if (most or 0) <= least:
        return left.join(right.drop(weight), keys, how)
    marked = sizes.where(F.col(weight) > least).select(*keys).withColumn("_hot", F.lit(True))
    many = right.drop(weight).join(F.broadcast(marked), keys, "left")
    many = many.withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int")).otherwise(0)
    return left.join(F.broadcast(marked), keys, "left").withColumn("_salt", salt).drop("_hot").join(many, [*keys, "_salt"], how).drop("_salt")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once, also where the optimizer puts the whole into a filter or a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session hands Python at most so many rows at once, which bounds what a task holds outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, min(rows, int(spark.conf.get(name))))


def small_reads(spark: SparkSession, rows: int = READ_ROWS) -> None:
    """From now on the session reads Parquet in batches of at most so many rows: with whole pages the usual 4,096 are arrays of tens of MB in the heap, made anew as they grow."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(name, min(rows, int(spark.conf.get(name))))


def groups(batch: pa.RecordBatch, text: int = 1, limit: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `limit` bytes of text."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def give_back() -> None:
    """Returns what the process has freed to the system. A worker waits for other tasks after its own, and beside it other operators need room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
