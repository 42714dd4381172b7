"""Text formats of loci: BED regions and VCF variants, as Spark's own text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VCF_HEAD = "#CHROM"


def write_bed(df: DataFrame, path: str) -> None:
    """(chrom, start, stop) as tab-separated lines, a file per task."""
    df.select("chrom", "start", "stop").write.option("sep", "\t").csv(path)


def read_bed(spark: SparkSession, path: str, locus: tuple[str, int, int] | None = None) -> DataFrame:
    """(chrom, start, stop) of BED lines; comments, ``browser`` and ``track`` lines are skipped.

    With a locus, only regions of its chrom with start at or after its start and stop before its stop.
    """
    r = spark.read.option("sep", "\t").option("comment", "#").schema("chrom string, start long, stop long").csv(path)
    r = r.where(~F.col("chrom").rlike("^-?(browser|track)"))
    return r if locus is None else r.where((F.col("chrom") == locus[0]) & (F.col("start") >= locus[1]) & (F.col("stop") < locus[2]))


def write_vcf(df: DataFrame, path: str) -> None:
    """(chrom, pos, ref, alt) as VCF lines below a header in each file; a null alt is a dot."""
    dot = F.lit(".")
    df.select(F.col("chrom").alias(VCF_HEAD), F.col("pos").alias("POS"), dot.alias("ID"), F.col("ref").alias("REF"), F.coalesce("alt", dot).alias("ALT"), dot.alias("QUAL"), dot.alias("FILTER"), dot.alias("INFO")
              ).write.option("sep", "\t").option("header", True).csv(path)


def read_vcf(spark: SparkSession, path: str, kind: str | None = None, locus: tuple[str, int, int] | None = None) -> DataFrame:
    """(chrom, pos, ref, alt, kind) of VCF lines, of one kind or of one locus (0-based, half-open) if asked for."""
    r = spark.read.option("sep", "\t").option("comment", "#").schema("chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string").csv(path)
    r = r.where(~F.col("chrom").startswith("#"))  # a quoted header
    r = r.select("chrom", "pos", "ref", F.when(F.col("alt") != ".", F.col("alt")).alias("alt")).withColumn("kind", variant_kind(F.col("ref"), F.col("alt")))
    if kind is not None:
        r = r.where(F.col("kind") == kind)
    return r if locus is None else r.where((F.col("chrom") == locus[0]) & (F.col("pos") > locus[1]) & (F.col("pos") <= locus[2]))


def variant_kind(ref: Column, alt: Column) -> Column:
    """X no change, S one letter for another, D or I where one is the other's beginning, else C."""
    return (F.when(alt.isNull() | (ref == alt), "X").when((F.length(ref) == 1) & (F.length(alt) == 1), "S")
            .when((F.length(ref) > F.length(alt)) & ref.startswith(alt), "D").when((F.length(ref) < F.length(alt)) & alt.startswith(ref), "I").otherwise("C"))
