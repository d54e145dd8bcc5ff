"""FASTA as a source and a sink (A1-A5), for plain and gzipped files.

A file is read as text records between header signs, so a file of any number of records is split by Spark's text
source; `ord` numbers the records of all files in the order of (file, position)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from resiq.operators.ranks import positions
from resiq.session import cut


def parsed(record: Column) -> Column:
    """struct (header, sequence) of a record without its sign: first line, then the other lines joined in upper case.
    Blank lines and white space around lines are dropped."""
    lines = F.transform(F.split(F.regexp_replace(record, "\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    body = F.filter(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), lambda x: x != "")
    return F.struct(F.element_at(lines, 1).alias("header"), F.upper(F.array_join(body, "")).alias("sequence"))


def fasta_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """A1 on a column of whole FASTA texts: (order, pos, header, sequence). Text before the first header is ignored;
    null and empty texts give no rows."""
    pieces = F.split(F.concat(F.lit("\n"), F.regexp_replace(text, "\r\n?", "\n")), "\n>")
    return df.select(order, F.posexplode(pieces).alias("pos", "piece")).where("pos > 0").select(order, "pos", parsed(F.col("piece")).alias("r")).select(order, "pos", "r.*")


def fasta_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A1: (ord, header, sequence) of FASTA files. An empty file gives no rows."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    raw = cut(raw.withColumn("n", F.monotonically_increasing_id()))  # in a block of a file, in its order
    # The first piece of a file holds a record only if it has a header sign itself
    heads = raw.groupBy("file").agg(F.min(F.struct("at", "n")).alias("head"))
    own = raw.join(heads, "file")
    v = F.col("value")
    lead = F.when((F.col("at") != F.col("head.at")) | (F.col("n") != F.col("head.n")), v).when(v.rlike(r"^\s*>"), F.regexp_replace(v, r"^\s*>", "")).when(v.rlike(r"\n\s*>"), F.regexp_replace(v, r"(?s)^.*?\n\s*>", ""))
    rows = own.select("file", "at", "n", lead.alias("piece")).where("piece is not null")
    ranked = positions(rows, [F.col("file"), F.col("at"), F.col("n")], "ord")
    return ranked.select("ord", parsed(F.col("piece")).alias("r")).select("ord", "r.*")


def fasta_scan_strict(spark: SparkSession, path: str) -> DataFrame:
    """A2: as the scan, but it fails on text before the first header and on files without a record."""
    lead = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"^\s*[^>\s]"))
    if lead.limit(1).count():
        raise ValueError("sequence before the first header")
    out = fasta_scan(spark, path)
    if not out.limit(1).count():
        raise ValueError("no FASTA records")
    return out


def first_records(df: DataFrame, n: int) -> DataFrame:
    """A4: the first n records."""
    return df.orderBy("ord").limit(n)


def fasta_lines(df: DataFrame, seq: str = "sequence", prefix: str | None = None, header: str = "header", order: str = "ord") -> DataFrame:
    """A5: (order, line) with the record's two lines: its own header, or the prefix and the record's number."""
    title = F.col(header) if prefix is None else F.concat(F.lit(prefix), F.col(order).cast("string"))
    return df.select(order, F.concat(F.lit(">"), title, F.lit("\n"), F.col(seq)).alias("line"))


def write_fasta(df: DataFrame, path: str, **how: str) -> None:
    """A5: one folder of text files in the order of the records; a file for each range of them."""
    order = how.get("order", "ord")
    fasta_lines(df, **how).orderBy(order).select("line").write.mode("overwrite").text(path)
