"""CSV, JSON, manifests and keyed embeddings (A6-A12), and layered configuration files (A10)."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def csv_scan(spark: SparkSession, path: str, schema: StructType | str, required: list[str] = (), **options) -> DataFrame:
    """CSV with a header under a given schema; fails if a required column isn't in the header. options: of Spark's
    reader."""
    head = spark.read.csv(path, header=True).columns
    missing = sorted(set(required) - set(head))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return spark.read.options(**options).csv(path, header=True, schema=schema, enforceSchema=False)


def json_cells(df: DataFrame) -> DataFrame:
    """Array columns as JSON texts, so that they fit CSV cells; null arrays stay null."""
    return df.withColumns({f.name: F.to_json(F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, ArrayType)})


def six_decimals(df: DataFrame, *columns: str) -> DataFrame:
    """Columns as text with six decimals."""
    return df.withColumns({c: F.format_string("%.6f", F.col(c).cast("double")) for c in columns})


def json_rows(df: DataFrame, *columns: str) -> Column:
    """A row's columns as one JSON object."""
    return F.to_json(F.struct(*columns))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, records) of files; records are lines that start with a header sign."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.decode(F.col("content"), "UTF-8")
    n = F.size(F.split(F.concat(F.lit("\n"), text), "\n>")) - 1
    return raw.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), n.alias("records"))


def cache_key(model: str, pooling: str, sequences: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-256 of model, pooling and the sequences joined by |."""
    return F.substring(F.sha2(F.concat(F.lit(model), F.lit(pooling), F.array_join(sequences, "|")), 256), 1, 16)


def layered(path: str | Path, load: Callable[[str], Any], key: str = "extends", seen: tuple[Path, ...] = ()) -> dict:
    """A10: a configuration file over the one that it extends, maps merged deeply; fails on a cycle."""
    path = Path(path).resolve()
    if path in seen:
        raise ValueError(f"configuration cycle at {path}")
    own = dict(load(path.read_text()) or {})
    parent = own.pop(key, None)
    return own if parent is None else merged(layered(path.parent / parent, load, key, (*seen, path)), own)


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
