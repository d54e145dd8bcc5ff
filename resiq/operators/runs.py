"""Predicting, checking and recording runs."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.functions import text as X
from resiq.session import cut, write_bytes

log = logging.getLogger("resiq")

#: A model file of fewer bytes is a pointer to a file that was not fetched.
LEAST_BYTES = 1_000_000


def unfetched(files: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The rows of (path, bytes) whose file is too small to be what it stands for. A null size is too small."""
    return files.where(F.coalesce("bytes", F.lit(0)) < least)


def one_hot(c: Column, known: list[str], default: str, like: str | None = None, unlike: str | None = None) -> Column:
    """array<int>, one place for each known category. A null or unknown value counts as `default`; if that isn't
    known either, as the first category that holds `like` and not `unlike`; else all places are 0."""
    rest = [k for k in known if like and like in k and not (unlike and unlike in k)]
    fall = default if default in known else rest[0] if rest else None
    value = F.when(c.isin(*known), c).otherwise(F.lit(fall)) if known else c
    return F.array(*(F.coalesce(value == k, F.lit(False)).cast("int") for k in known)) if known else F.array().cast("array<int>")


def predicted(df: DataFrame, seq: str, predict: Callable[[DataFrame], DataFrame], strict: bool = False) -> DataFrame:
    """Df with a cleaned sequence, an error, and the predictions for it.

    Sequences are normalised, each different one is predicted once, and predictions are joined back to every row.
    predict: (sequence) -> (sequence, columns of its own). Rows with an error have null predictions; with `strict`
    the first twenty errors are raised instead. Columns of df that clash with predictions are replaced."""
    rows = df.select("*", X.normalized(F.col(seq)).alias("__n")).select("*", F.col("__n.seq").alias("__seq"), F.col("__n.err").alias("error")).drop("__n")
    if strict:
        bad = rows.where("error is not null").select(F.coalesce(F.col(seq), F.lit("null")).alias("s"), "error").limit(20).collect()
        if bad:
            raise ValueError("invalid sequences: " + "; ".join(f"{r.s}: {r.error}" for r in bad))
    told = cut(predict(rows.where("error is null").select(F.col("__seq").alias("sequence")).distinct()))
    new = [c for c in told.columns if c != "sequence"]
    kept = rows.drop(*(c for c in df.columns if c in new))
    return kept.join(told.withColumnRenamed("sequence", "__of"), kept["__seq"] == F.col("__of"), "left").drop("__of").withColumnRenamed("__seq", "clean")


def verify(library: DataFrame, top: DataFrame, reference: DataFrame, size: int, top_size: int, lo: int = 8, hi: int = 50) -> DataFrame:
    """(check, n): how often each check of a submission fails; checks that hold are left out. library, top: (header,
    sequence); reference: (sequence). Repeats count from the second on. Nulls are empty texts."""
    s, h = F.coalesce("sequence", F.lit("")), F.trim(F.coalesce("header", F.lit("")))
    one = library.select(h.alias("h"), s.alias("s"))
    kinds = {
        "header": F.col("h") == "",
        "empty": F.col("s") == "",
        "alphabet": (F.col("s") != "") & ~F.col("s").rlike("^[ACDEFGHIKLMNPQRSTVWY]*$"),
        "short": (F.col("s") != "") & (F.length("s") < lo),
        "long": F.length("s") > hi,
    }
    counts = one.agg(*(F.count_if(c).alias(k) for k, c in kinds.items()), F.abs(F.count("*") - size).alias("size"))
    told = counts.select(F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in [*kinds, "size"])), F.array(*(F.col(k) for k in [*kinds, "size"])))).alias("check", "n"))
    again = lambda d, name: d.where("s <> ''").groupBy("s").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n")).select(F.lit(name).alias("check"), "n")
    best = top.select(s.alias("s"))
    texts = one.where("s <> ''").select("s").distinct()
    number = lambda d, name: d.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    parts = [
        again(one, "duplicate"),
        again(best, "top_duplicate"),
        number(best.join(texts, "s", "left_anti"), "top_unknown"),
        number(texts.join(reference.select(F.col("sequence").alias("s")).distinct(), "s", "left_semi"), "overlap"),
        best.agg(F.abs(F.count("*") - top_size).alias("n")).select(F.lit("top_size").alias("check"), "n"),
    ]
    for p in parts:
        told = told.unionAll(p)
    return told.where("n > 0").select("check", F.col("n").cast("long").alias("n"))


def digest(df: DataFrame, *columns: str) -> DataFrame:
    """One row (n, digest) that two runs share exactly if they gave the same rows, in whatever order."""
    row = F.conv(F.substring(F.md5(F.to_json(F.struct(*(columns or df.columns)), {"ignoreNullFields": "false"})), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("digest"))


def run_manifest(name: str, config: dict, inputs: list[str], started: datetime | None = None, **more) -> dict:
    """What a run was: its name, resolved configuration, inputs and start, as UTC in ISO 8601."""
    return {"name": name, "config": config, "inputs": sorted(inputs), "started_at": (started or datetime.now(UTC)).isoformat(), "status": "running", **more}


def finish(spark: SparkSession, path: str, manifest: dict, **result) -> dict:
    """The manifest with its end, elapsed seconds and results, written as one JSON file, whole or not at all."""
    end = datetime.now(UTC)
    seconds = (end - datetime.fromisoformat(manifest["started_at"])).total_seconds()
    out = manifest | {"status": "done", "finished_at": end.isoformat(), "seconds": round(seconds, 3), **result}
    write_bytes(spark, path, json.dumps(out, indent=1, sort_keys=True).encode())
    return out


@contextmanager
def stage(name: str) -> Iterator[None]:
    """Log lines at the start and end of a stage, with its seconds."""
    log.info("STAGE %s", name)
    began = time.monotonic()
    yield
    log.info("DONE %s seconds=%.3f", name, time.monotonic() - began)
