"""Accepting draws from a stream (7.6): screened, not in the reference, each sequence once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.functions import text as X
from resiq.plans.registry import AA, query, tidy
from resiq.session import cut, drop_path, shared_dir, table


def accepted(draws: DataFrame, reference: DataFrame, seq: str = "seq", time: str | None = None, horizon: str = "7 days") -> DataFrame:
    """Sequences of a stream (or table) that pass the screen, are not in the static reference and were not seen before.

    Without a time column the state keeps every sequence seen, as a set of all seen ones must; with one, sequences
    are remembered within the watermark's horizon only, which bounds the state."""
    s = X.tidy(F.col(seq))
    keep = draws.withColumn("s", s).where(X.is_peptide(F.col("s")))
    keep = keep.join(reference.select(F.col("seq").alias("s")), "s", "left_anti")
    if time is None:
        return keep.select("s").dropDuplicates(["s"])
    return keep.select("s", time).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["s"])


def drain(stream: DataFrame, path: str) -> None:
    """Everything that has arrived, written as parquet, exactly once; the stream goes on from there at the next call."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start()
    q.awaitTermination()


@query("s1_stream_accept", f"WITH r AS (SELECT {tidy('sequence')} AS s FROM conditioned_peptides WHERE sequence IS NOT NULL) SELECT DISTINCT {tidy('seq')} AS s FROM scored_candidates WHERE length({tidy('seq')}) BETWEEN 8 AND 50 AND regexp_full_match({tidy('seq')}, '[{AA}]+') AND {tidy('seq')} NOT IN (SELECT s FROM r)")
def s1(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates table read as a stream of files."""
    schema = table(spark, sf, "scored_candidates").schema
    draws = spark.readStream.schema(schema).parquet(f"{sf}/scored_candidate[s].parquet")
    ref = table(spark, sf, "conditioned_peptides").where("sequence is not null").select(X.tidy(F.col("sequence")).alias("seq"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    drain(accepted(draws, ref), path)
    out = cut(spark.read.schema("s string").parquet(f"{path}/out"))
    drop_path(spark, path)
    return out
