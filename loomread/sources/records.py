"""Multi-line records as text: FASTQ, nine-line barcoded pairs, loci, read names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomread.storage import scratch


def _marked(c: Column) -> Column:
    r"""A field as one line that is never empty: \s for a backslash, \n for a line break, \E for empty, \N for null."""
    c = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n"))
    return F.when(c.isNull(), F.lit("\\N")).when(c == "", F.lit("\\E")).otherwise(c)


def _unmarked(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))
    return F.when(c == "\\N", F.lit(None).cast("string")).when(c == "\\E", F.lit("")).otherwise(plain)


def write_records(df: DataFrame, fields: list[Column], path: str) -> None:
    """A record per row, its fields on lines of their own, two empty lines after each record; gzip, a file per task."""
    df.select(F.concat_ws("\n", *map(_marked, fields)).alias("value")).write.option("lineSep", "\n\n\n").option("compression", "gzip").text(path)


def read_records(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The fields of write_records(), as strings; nulls and empty fields as they were."""
    raw = spark.read.option("lineSep", "\n\n\n").text(path)
    parts = raw.select(F.split("value", "\n", len(names)).alias("p"))
    return parts.select(*[_unmarked(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(names)])


def line_records(spark: SparkSession, path: str | list[str], names: list[str]) -> DataFrame:
    """(file, record, names): records of as many lines as there are names, by line numbers within each file; records of empty lines only are left out.

    Lines are counted within each split of a file, and the counts of the splits before it are added.
    """
    n = len(names)
    raw = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    blocks = raw.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")  # over splits, not lines
    lines = raw.join(blocks.withColumn("before", before), ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")
    field = lambda i: F.coalesce(F.max(F.when(F.col("line") % n == i, F.rtrim("value", F.lit("\r")))), F.lit(""))
    r = lines.groupBy("file", F.floor(F.col("line") / n).alias("record")).agg(*[field(i).alias(x) for i, x in enumerate(names)])
    return r.where(F.concat(*names) != "")


#: The nine lines of a barcoded pair.
FASTH = ["name", "r1", "q1", "r2", "q2", "key", "key_q", "index", "index_q"]


def write_fasth(df: DataFrame, path: str) -> None:
    """Nine lines for each barcoded pair (FASTH); nulls are written as empty, names start with @."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in FASTH]
    df.select(F.concat_ws("\n", F.concat(F.lit("@"), text[0]), *text[1:]).alias("value")).write.text(path)


def read_fasth(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The pairs of write_fasth(); a record whose first line lacks @ is an error."""
    r = line_records(spark, path, FASTH)
    bad = F.raise_error(F.concat(F.lit("no nine-line record: "), "file", F.lit(", "), F.col("record").cast("string")))
    return r.select(F.when(F.col("name").startswith("@"), F.expr("substring(name, 2)")).otherwise(bad).alias("name"), *FASTH[1:])


def read_listed(spark: SparkSession, listing: str) -> list[str]:
    """The file names in a listing, one to a line; empty lines are skipped."""
    return [r.value for r in spark.read.text(listing).where("trim(value) <> ''").collect()]


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of four-line records; one whose first line lacks @ or whose third lacks + is an error.

    Qualities may start with '@' or '+', so records are told by line numbers, not by marks. Empty lines after the last
    record are no record.
    """
    r = line_records(spark, path, ["name", "seq", "plus", "qual"])
    name = F.when(F.col("name").startswith("@") & F.col("plus").startswith("+"), F.expr("substring(name, 2)")).otherwise(F.raise_error(F.concat(F.lit("no four-line record: "), "file", F.lit(", "), F.col("record").cast("string"))))
    return r.select(name.alias("name"), "seq", "qual")


def write_fastq(df: DataFrame, path: str) -> None:
    """Four-line records of (name, seq, qual); nulls are written as empty."""
    name, seq, qual = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "seq", "qual"))
    df.select(F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), qual).alias("value")).write.text(path)


def parse_locus(c: Column) -> Column:
    """struct(chrom, start, stop) of 'chrom:start-stop'; null parts where it doesn't fit."""
    part = lambda i: F.regexp_extract(c, r"^(\w+):(\d+)-(\d+)$", i)
    number = lambda i: F.when(part(i) != "", part(i)).cast("long")
    return F.struct(F.when(part(1) != "", part(1)).alias("chrom"), number(2).alias("start"), number(3).alias("stop"))


def fastq_roundtrip(df: DataFrame) -> DataFrame:
    """df (name, seq, qual) written as FASTQ in the shared folder and read back."""
    path = scratch(df.sparkSession, "fastq")
    write_fastq(df, path)
    return read_fastq(df.sparkSession, path)


def records_roundtrip(df: DataFrame, fields: list[Column], names: list[str]) -> DataFrame:
    path = scratch(df.sparkSession, "records")
    write_records(df, fields, path)
    return read_records(df.sparkSession, path, names)
