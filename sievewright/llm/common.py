"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, 0x20 and 0x09-0x0D: what bytes.split() splits at.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="sievewright-")
        spark.conf.set("spark.checkpoint.dir", shared)
    folder = f"{shared.rstrip('/')}/sievewright-{spark.sparkContext.applicationId}"
    if folder not in _SCRATCH:
        _SCRATCH.add(folder)
        atexit.register(_forget, spark, folder)
    return folder


_SCRATCH: set[str] = set()
_TABLES: list[str] = []


def _forget(spark: SparkSession, folder: str) -> None:
    """Delete what a session has written, when its driver ends before the session was stopped."""
    with contextlib.suppress(Exception):
        for name in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    with contextlib.suppress(Exception):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Cut the lineage of df by writing it to the shared folder and reading it back.

    Survives the loss of any executor; reading it again never recomputes df.
    """
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
    return df.sparkSession.read.schema(nullable).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df written to the shared folder in buckets of a column, so that grouping by it again moves nothing."""
    name = f"sievewright_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, key).option("path", f"{scratch_dir(df.sparkSession)}/{name}").saveAsTable(name)
    _TABLES.append(name)
    return df.sparkSession.table(name)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo `modulus`, is `remainder`; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def py_fold(doc_id: object, modulus: int) -> int:
    """The same remainder in Python."""
    return zlib.crc32(str(doc_id).encode()) % modulus


#: Longer words stand for themselves by a digest in tables of words.
WHOLE_WORD = 64


def word_key(word: bytes) -> bytes:
    """The word, or a digest of a long one, so that tables of words are bounded by their rows."""
    return word if len(word) <= WHOLE_WORD else b"\0" + xxhash.xxh3_128_digest(word)


def word_keys(words: list[bytes]) -> list[bytes]:
    return words if not words or max(map(len, words)) <= WHOLE_WORD else [word_key(w) for w in words]


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(value: str | None) -> bytes:
    return value.encode("utf-8", "replace") if value else b""


def blank_words(value: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of [^\\x20\\x09-\\x0D]+; a null text has none."""
    return value.encode("utf-8", "replace").lower().split() if value else []


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def arrays(**columns: object) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def pieces(values: list, size: int):
    """Slices of a list, each of at most `size` elements."""
    for at in range(0, len(values), size):
        yield values[at : at + size]


def min_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of n nodes over the edges (a, b)."""
    label = np.arange(n, dtype=np.int64)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        keep = label[a] != label[b]
        if not keep.any() and (label[label] == label).all():
            break
        a, b = a[keep], b[keep]
    while not (label[label] == label).all():
        label = label[label]
    return label
