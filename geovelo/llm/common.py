"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the operators' contracts define it; bytes.split() splits on the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one where it is unset and the master is local. What is stored there stays until the folder is cleared."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="geovelo-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for small tables that loops replace again and again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that Python objects of long texts exist for a slice only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary()).to_pylist()


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Texts compressed one by one, so that a shuffle of whole texts moves and stores less. Null stays null."""
    from zstandard import ZstdCompressor

    squeeze = ZstdCompressor(level=3).compress
    return pa.array([None if x is None else squeeze(x) for part in range(0, len(texts), 256) for x in utf8(texts[part : part + 256])], pa.binary())


def unpacked(column: pa.Array) -> list[bytes | None]:
    """What packed() was given, as UTF-8."""
    from zstandard import ZstdDecompressor

    spread = ZstdDecompressor().decompress
    return [None if x is None else spread(x) for x in column.to_pylist()]


def unused(df: DataFrame, name: str) -> str:
    """name, or name behind as many underscores as it takes for df to have no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_row(df: DataFrame, *without: str) -> Column:
    """All columns of df as one struct, so that names made on the way can't clash; without: names in lower case to leave out."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in without])


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, all other characters unchanged."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bounded_ids(ids: DataFrame, key: str, bound: int) -> DataFrame:
    """At most bound ids, those with the smallest hash: the same ones in each run. A merge of each task's smallest, so nothing is sorted as a whole."""
    return ids.orderBy(F.xxhash64(key), F.col(key)).limit(bound)
