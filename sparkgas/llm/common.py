"""What several operators share: reading tables, plain columns, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
BATCH_BYTES = 16 << 20
SCANNED = 256  # elements that a running value is carried through at a time
CHUNK = 512  # code points of a text that are looked through for a place in it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` of every row, a null text as an empty one.  Other columns are left behind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return df.select(F.col(id_col).alias("doc_id"), text)


def bounded_batches(spark: SparkSession) -> None:
    """Limit what one Arrow batch holds, so that a worker's memory does not grow with the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_remainder(column: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where a lambda function reads it again and again."""
    return F.transform(F.array(value), body)[0]


def scan(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each of some whole numbers, all numbers before it added up (or joined otherwise, from 0 on).

    Arrays cannot grow in place, so the running value goes through runs of
    ``SCANNED`` elements, and then through the runs.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))

    def run(part: Column) -> Column:
        step = lambda s, x: F.struct(join(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        return F.aggregate(part, zero, step)

    def of(every: Column) -> Column:
        last = F.floor(F.size(every) / SCANNED).cast("int")
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: run(F.slice(every, k * SCANNED + 1, F.lit(SCANNED))))
        shifted = lambda parts, before: F.flatten(
            F.zip_with(parts, before, lambda p, b: F.transform(p["out"], lambda x: join(x, b)))
        )
        return let(runs, lambda parts: let(run(F.transform(parts, lambda p: p["at"]))["out"], lambda before: shifted(parts, before)))

    return let(values.cast("array<bigint>"), of)


def chunked(text: Column) -> Column:
    """A text in chunks of ``CHUNK`` code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def part_of(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` up to ``end`` of a chunked text, found without walking through all before them."""
    first = F.floor(start / CHUNK).cast("int")
    own = F.slice(chunks, first + 1, F.floor(end / CHUNK).cast("int") - first + 1)
    return F.substring(F.array_join(own, ""), (start - first * CHUNK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
