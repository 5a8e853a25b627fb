"""Chunks of documents, and tables that a job writes for its later steps.

Corpus-wide lookups (how often does this key occur?) are asked chunk by chunk: a chunk of a few MB
of text sends each distinct key once, packed per bucket of keys, and gets the answers back in the
same order. A hot key therefore costs one entry per chunk, whatever its number of rows, and no key
table is broadcast or collected.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uptake.sources.sinks import shared_folder

CHUNK_BYTES = 4 << 20
KEYS_PER_BUCKET = 1 << 20
_RECORDS: list[list[str]] = []


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps neither recompute it nor
    depend on the executors that made it. The files lie below the application's id; ``sweep``
    removes them."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for made in _RECORDS:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def recorded():
    """The paths that ``written`` makes inside, in their order."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS.pop()


def remove(spark: SparkSession, paths) -> None:
    """Delete tables that nothing reads any more."""
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder. Results that were not stored
    elsewhere cannot be computed any more after it."""
    remove(spark, [_own_folder(spark)])


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0


def in_chunks(
    docs: DataFrame, total_bytes: int, chunk_bytes: int = CHUNK_BYTES, carry: bool = False,
) -> DataFrame:
    """(chunk, row_key, doc_id, text): rows dealt evenly to chunks of about ``chunk_bytes``.

    The chunk depends on id and text, so rows that share an id or a text spread out. Rows equal in
    both are interchangeable. ``carry`` adds all columns of ``docs`` but the text as the struct ``carried``.
    """
    count = max(1, -(-total_bytes // chunk_bytes))
    key = F.xxhash64("doc_id", "text")
    return docs.select(
        F.pmod(key, F.lit(count)).cast("int").alias("chunk"), key.alias("row_key"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("carried")] if carry else []),
    )


def ordered(table):
    """A chunk's rows in an order that does not depend on how the shuffle delivered them."""
    return table.sort_by([("doc_id", "ascending"), ("row_key", "ascending")])


def map_rows(docs: DataFrame, function, added=()) -> DataFrame:
    """``mapInArrow`` that keeps all columns of ``docs`` and appends those of ``added``, whatever
    their names: Spark's own cannot take names with dots."""
    plain = [c.replace(".", "\u2024").replace("`", "\u2018") for c in docs.columns]
    fields = [T.StructField(name, f.dataType) for name, f in zip(plain, docs.schema.fields)]
    out = docs.toDF(*plain).mapInArrow(function, T.StructType([*fields, *added]))
    return out.toDF(*docs.columns, *[f.name for f in added])
