"""Benchmark decontamination by winnowed fingerprints (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomread.storage import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Runs of digits, a-z and characters beyond ASCII, after lowering A-Z; none for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # lower() is ASCII-only on ASCII
    return F.filter(F.split(low, WORDS), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """64-bit hashes of the n-word runs; empty where there are fewer words."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))


def _placed(hashes: Column, m: int) -> Column:
    """(m, print, at) of each hash and its place."""
    return F.transform(hashes, lambda x, i: F.struct(F.lit(m).alias("m"), x.alias("print"), i.alias("at")))


def _winnowed(hashes: Column, w: int) -> Column:
    """The distinct minima of windows of w neighbouring hashes; empty where there are fewer hashes."""
    at = F.when(F.size(hashes) >= w, F.sequence(F.lit(0), F.size(hashes) - w)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.least(*[F.get(hashes, i + j) for j in range(w)])))


def _near(df: DataFrame, rows: int) -> DataFrame:
    """df for a broadcast join if it has at most so many (short) rows, as counted now; else for any join Spark plans."""
    return F.broadcast(df) if df.count() <= rows else df


def benchmark_hits(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   window: int = 10, k: int = 5, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_key, n_hit, items) of each text that shares a window of words with an item; doc_key is struct(id, sha2 of the text).

    Windows are runs of ``window`` words of an item; an item of fewer words, but not none, is one window. Winnowing keeps
    the least hash of every window - k + 1 neighbouring k-grams on both sides, so a shared window always gives a shared
    fingerprint inside it. A fingerprint that a text shares is extended where it lies: of the text's windows around it,
    those that are windows of an item as strings are hits, and the words that they cover are counted once. The
    fingerprint of a short item is the hash of all of it, sought by length, of which there are fewer than ``window``. Benchmark tables above broadcast_rows rows are joined by shuffle instead of broadcast.
    Null texts have no words; equal rows have one key; long texts are one row; an empty docs or bench gives an empty
    result; clashing column names do no harm, as only the named ones are read.
    """
    item_words = bench.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    windows = item_words.select("item", F.explode_outer(F.when(n <= window, F.array(F.array_join("w", " "))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, window), " ")))).alias("gram"), F.least(n, F.lit(window)).alias("n")).distinct()
    grams = windows.select("gram", "n").distinct()
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most ``window`` numbers

    size_of = {m: k if m == window else m for m in lengths}  # words of a fingerprint, by words of a window

    # columns for words and hashes: inside a lambda they would be computed anew for each element
    def prints(df, key, m):
        """(key, m, print) of the rows' words: winnowed k-grams for m = window, all m-grams for shorter m."""
        df = df.withColumn("h", _grams(F.col("w"), size_of[m]))
        return df.select(key, F.lit(m).alias("m"), F.explode_outer(_winnowed(F.col("h"), window - k + 1) if m == window else F.array_distinct("h")).alias("print"))

    texts = docs.select(F.struct(F.col(doc_id).alias("id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("text")).alias("doc_key"), F.col(text).alias("t"))
    words = texts.select("doc_key", words_of(F.col("t")).alias("w"))
    if not lengths:
        return words.select("doc_key", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items")).limit(0)
    known = [prints(item_words.where(n >= m if m == window else n == m), "item", m).select("m", "print").where("print is not null").distinct() for m in lengths]
    found = [prints(words, "doc_key", m).join(_near(x, broadcast_rows), ["m", "print"], "left_semi").select("doc_key") for m, x in zip(lengths, known)]
    every, keys = known[0], found[0]
    for x, f in zip(known[1:], found[1:]):
        every, keys = every.unionByName(x), keys.unionByName(f)
    keys = stored(keys.distinct(), "leak-candidates")

    # where the fingerprints lie, in those few texts
    some = texts.join(_near(keys, broadcast_rows), "doc_key", "left_semi").select("doc_key", words_of(F.col("t")).alias("w"))
    places = some.withColumns({f"h{m}": _placed(_grams(F.col("w"), size_of[m]), m) for m in lengths}).select("doc_key", F.explode_outer(F.concat(*[f"h{m}" for m in lengths])).alias("x"))
    met = places.select("doc_key", "x.m", "x.print", "x.at").join(_near(every, broadcast_rows), ["m", "print"], "left_semi")
    met = stored(met.groupBy("doc_key").agg(F.collect_list(F.struct("m", "at")).alias("met")), "leak-prints")  # places of one text

    # texts, not words, meet the places, and are split after that
    some = texts.join(_near(met, broadcast_rows), "doc_key").select("doc_key", "met", words_of(F.col("t")).alias("w"))
    around = F.when(F.col("x.m") < window, F.array("x.at")).otherwise(F.sequence(F.greatest(F.col("x.at") + k - window, F.lit(0)), F.least(F.col("x.at"), F.size("w") - window)))
    runs = some.select("doc_key", "w", F.explode("met").alias("x")).select("doc_key", "w", F.col("x.m").alias("m"), F.explode(around).alias("at"))
    runs = runs.select("doc_key", "m", (F.col("at") + 1).alias("at"), F.array_join(F.slice("w", F.col("at") + 1, F.col("m")), " ").alias("gram"))
    hits = stored(runs.join(_near(grams, broadcast_rows), "gram", "left_semi").distinct(), "leak-hits")
    covered = hits.select("doc_key", F.explode_outer(F.sequence(F.col("at"), F.col("at") + F.col("m") - 1)).alias("word")).distinct().groupBy("doc_key").agg(F.count("*").alias("n_hit"))
    items = hits.select("doc_key", "gram").distinct().join(_near(windows.select("item", "gram"), broadcast_rows), "gram").groupBy("doc_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return covered.join(items, "doc_key")


def decontaminate(docs: DataFrame, bench: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` without the texts that share a window with an item of ``bench`` (see benchmark_hits); all columns stay, whatever their names."""
    bad = benchmark_hits(docs, bench, doc_id, text, **how).select(F.col("doc_key.id").alias("id"), F.col("doc_key.text").alias("sha")).alias("bad")
    return docs.join(bad, docs[doc_id].eqNullSafe(F.col("bad.id")) & (F.sha2(F.coalesce(docs[text], F.lit("")), 256) == F.col("bad.sha")), "left_anti")


def op8_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = benchmark_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    hits = hits.select(F.col("doc_key.id").alias("id"), F.col("doc_key.text").alias("sha"), "n_hit", "items")
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (rows["sha"] == hits["sha"]), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


_SQL_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'), lambda x: x <> '')"""
SQL_DECONTAMINATION = f"""
WITH items AS (SELECT item_id::VARCHAR AS item, {_SQL_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
            FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
word AS (SELECT r, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM docs),
ahead AS (SELECT r, i, list(x) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS l FROM word),
runs AS (SELECT r, m, i, array_to_string(l[1:m], ' ') AS g FROM ahead, (SELECT DISTINCT m FROM windows) WHERE len(l) >= m),
hits AS (SELECT r, x.m, i, item FROM runs x JOIN windows y ON x.g = y.g AND x.m = y.m),
hit AS (SELECT r, count(DISTINCT i + j) AS n FROM hits, unnest(range(m)) t(j) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
