"""Contiguous shards of near-equal bytes, from global prefix sums (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 200_000  # of a broadcast table of large groups


def contiguous_shards(df: DataFrame, size: Column, group: Column, row_key: Column, n_shards: int = 24, part_rows: int = 50_000) -> DataFrame:
    """``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows are laid out in the order of (md5(group), md5(row_key)). They are dealt into parts by the leading digits of
    those hashes; only the totals of the parts are summed across the whole table, and each part adds its own offset to
    the prefix sums of its rows. A row goes to shard floor(bytes before it * n_shards / all bytes). Equal groups are
    neighbours; a group no larger than the largest single row stays whole (it goes where its first row goes), so that
    cuts are never coarser than rows force them to be. A larger group is cut like other rows.

    A group of more than ``part_rows`` rows is dealt on by the digits of md5(row_key), so no part holds much more than
    that. Null sizes count 0; a null group or key is the empty string; repeated rows take slots in any order among
    themselves; an empty table gives an empty result; texts are only hashed, however long they are. Columns of df named
    shard or slot are replaced; names starting with ``_s_`` are refused.
    """
    if any(c.startswith("_s_") for c in df.columns):
        raise ValueError("names starting with _s_ are taken")
    n = df.count()
    digits = max(1, math.ceil(math.log(max(1, n) / part_rows, 16)))
    rows = df.withColumns({
        "_s_size": F.coalesce(size.cast("long"), F.lit(0)),
        "_s_group": F.md5(F.coalesce(group.cast("string"), F.lit(""))),
        "_s_key": F.md5(F.coalesce(row_key.cast("string"), F.lit(""))),
    })
    hot = rows.groupBy("_s_group").count().where(F.col("count") > part_rows).select(
        "_s_group", F.ceil(F.log(16.0, F.col("count") / part_rows)).cast("int").alias("_s_deal"))
    hot = F.broadcast(hot) if n // part_rows <= HOT_ROWS else hot  # so many rows at most
    part = F.substring("_s_group", 1, digits)
    rows = rows.join(hot, "_s_group", "left").withColumn(
        "_s_part", F.when(F.col("_s_deal").isNull(), part).otherwise(F.concat(part, F.lit("|"), "_s_group", F.expr("left(_s_key, _s_deal)"))))

    totals = rows.groupBy("_s_part").agg(F.sum("_s_size").alias("bytes"), F.count("*").alias("rows"), F.max("_s_size").alias("most"))
    before, all_parts = Window.orderBy("_s_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = totals.select(
        "_s_part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_s_bytes0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_s_rows0"),
        F.greatest(F.sum("bytes").over(all_parts), F.lit(1)).alias("_s_all"), F.max("most").over(all_parts).alias("_s_most"))

    order = Window.partitionBy("_s_part").orderBy("_s_group", "_s_key")
    own = Window.partitionBy("_s_part", "_s_group")
    laid = (rows
            .withColumns({"_s_to": F.sum("_s_size").over(order.rowsBetween(Window.unboundedPreceding, 0)), "_s_row": F.row_number().over(order) - 1})
            .withColumn("_s_from", F.col("_s_to") - F.col("_s_size"))
            .withColumns({"_s_first": F.min("_s_from").over(own), "_s_gbytes": F.sum("_s_size").over(own)})
            .join(offsets, "_s_part"))
    whole = F.col("_s_deal").isNull() & (F.col("_s_gbytes") <= F.col("_s_most"))
    at = F.col("_s_bytes0") + F.when(whole, F.col("_s_first")).otherwise(F.col("_s_from"))
    laid = laid.withColumns({
        "shard": F.least(F.lit(n_shards - 1), F.floor(at.cast("decimal(38,0)") * n_shards / F.col("_s_all"))).cast("int"),
        "_s_index": F.col("_s_rows0") + F.col("_s_row"),
    })
    firsts = laid.groupBy("shard").agg(F.min("_s_index").alias("_s_shard0"))  # n_shards rows at most
    out = laid.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_s_index") - F.col("_s_shard0"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")], "shard", "slot")


def op10_sharding(spark, sf_dir):
    """Every document's shard under the law ``bytes``; size is the text's UTF-8 bytes plus 8."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(text).alias("text_md5"))
    out = contiguous_shards(docs, F.col("size"), F.col("text_md5"), F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL_SHARDING = """
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
docs AS (
  SELECT doc_id, coalesce(text, '') AS text, md5(md5(coalesce(text, ''))) AS g, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         strlen(coalesce(text, '')) + 8 AS size FROM documents),
laid AS (
  SELECT *, sum(size) OVER (ORDER BY g, k) - size AS pos0, row_number() OVER (ORDER BY g, k) - 1 AS idx,
         sum(size) OVER () AS total, max(size) OVER () AS most, sum(size) OVER (PARTITION BY g) AS gbytes FROM docs),
placed AS (
  SELECT *, least(23, (CASE WHEN gbytes <= most THEN min(pos0) OVER (PARTITION BY g) ELSE pos0 END) * 24 // total) AS shard FROM laid)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(text)), lambda i: ('0x' || substr(hex(text), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, shard::INTEGER AS shard, (idx - min(idx) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed, crc_table
"""
