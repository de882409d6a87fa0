"""Files in and out: source tables with exact headers, checksums, packed vectors, snapshots, JSON lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTES = "text string, note_id string, hadm_id string, criterion string, question_type string, question string, answer string, not_specified string"


def read_notes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Source rows of a CSV file whose header must be exactly NOTES' columns; quoted fields may hold line ends."""
    wanted = [c.split()[0] for c in NOTES.split(", ")]
    first = spark.read.text(path).limit(1).collect()
    header = [h.strip().strip('"') for h in (first[0]["value"].removeprefix("﻿") if first else "").split(",")]
    if header != wanted:
        raise ValueError(f"header {header} is not {wanted}")
    return spark.read.schema(NOTES).csv(path, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', mode="FAILFAST")


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, length, sha256) of the files of a folder, hashed by the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def checksum_violations(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that a manifest (name, sha256) lacks, that are missing, or that differ; names are the paths' last parts."""
    a = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("have"))
    why = F.when(F.col("have").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.col("have") != F.col("sha256"), "differs")
    return a.join(manifest, "name", "full_outer").select("name", why.alias("problem")).where("problem is not null")


def read_float32(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """Packed little-endian float32 rows as (path, row, vec). A file's length must be a multiple of a row's."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(raw) % (4 * dim):
                    raise ValueError(f"{name}: {len(raw)} bytes are no rows of {dim}")
                x = np.frombuffer(raw, "<f4").reshape(-1, dim)
                if not np.isfinite(x).all():
                    raise ValueError(f"{name}: a component is not finite")
                for at in range(0, len(x), 4096):
                    some = x[at : at + 4096]
                    yield pa.RecordBatch.from_pydict({"path": pa.array([name] * len(some)), "row": pa.array(range(at, at + len(some)), pa.int64()), "vec": pa.array(some.tolist(), pa.list_(pa.float32()))})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(unpack, "path string, row long, vec array<float>")


def packed_float32(vec: F.Column | str) -> F.Column:
    """A vector's bytes as read_float32 takes them."""

    @F.pandas_udf("binary")
    def pack(s):
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(vec)


def write_new(df: DataFrame, path: str) -> None:
    """Parquet that must not exist yet; the committer makes it appear as a whole."""
    df.write.mode("errorifexists").parquet(path)


def write_json_lines(df: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a total order over all files, nulls written; alike in every run."""
    df.orderBy(*order).write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Several tables under one folder, and a manifest (name, rows, digest) that closes it; written last."""
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in sorted(tables.items()):
        write_new(df, f"{path}/{name}")
        row = snapshot_row(spark.read.parquet(f"{path}/{name}"), name)
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.coalesce(1).write.mode("errorifexists").json(f"{path}/_manifest")
    return spark.read.schema("name string, rows long, digest string").json(f"{path}/_manifest")


def snapshot_row(df: DataFrame, name: str) -> DataFrame:
    """Name, rows and a digest that does not depend on the rows' order."""
    columns = sorted(df.columns)
    h = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def read_snapshot(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a snapshot, after all of them were held against its manifest."""
    manifest = {r["name"]: r for r in spark.read.schema("name string, rows long, digest string").json(f"{path}/_manifest").collect()}
    out = {}
    for name in names:
        df = spark.read.parquet(f"{path}/{name}")
        have = snapshot_row(df, name).first()
        if name not in manifest or (have["rows"], have["digest"]) != (manifest[name]["rows"], manifest[name]["digest"]):
            raise ValueError(f"{name} is not what the manifest says")
        out[name] = df
    return out
