"""Queries on k-mers of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomread.functions.sequences import IUPAC, IUPAC_COMPLEMENT, ascii_upper, characters, masked, reverse_complement
from loomread.operators import kmers as K


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _totals(spark, d, k):
    return K.kmer_totals(_docs(spark, d).select("text"), "text", k)


def kmer_doc_support(spark, d):
    return K.key_support(_docs(spark, d).select("doc_id", "text"), "doc_id", "text", 8).withColumnRenamed("key", "doc_id")


def rev_comp(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(reverse_complement(F.coalesce("text", F.lit("")))).alias("rc_md5"))


def seq_mask(spark, d):
    m = masked(F.coalesce("text", F.lit("")), 10, 60)
    return _docs(spark, d).select("doc_id", F.md5(m).alias("masked_md5"), F.length(m).cast("long").alias("n"))


def sub_slices(spark, d):
    """Barcode, trimmed part and rest of each text, as reads are cut: 16 characters, 7 dropped, the rest."""
    t = F.coalesce("text", F.lit(""))
    return _docs(spark, d).select("doc_id", F.substring(t, 1, 16).alias("barcode"), F.substring(t, 17, 7).alias("trim"), F.greatest(F.length(t) - 23, F.lit(0)).cast("long").alias("rest_chars"), F.md5(F.expr("substring(coalesce(text, ''), 24)")).alias("rest_md5"))


def base_encode(spark, d):
    """A, C, G, T as 0 to 3, anything else 0: counts by document."""
    c = F.transform(characters(ascii_upper(F.col("text"))), lambda x: F.when(x == "C", 1).when(x == "G", 2).when(x == "T", 3).otherwise(0))
    rows = _docs(spark, d).select("doc_id", c.alias("c"))
    n = lambda v: F.size(F.filter("c", lambda x: x == v)).cast("long")
    return rows.select("doc_id", *[n(v).alias(f"n{v}") for v in range(4)])


def ext_mask_or(spark, d):
    """Bit masks of the vowels that follow each vowel, OR-ed over all documents."""
    pairs = _totals(spark, d, 2).where(F.col("kmer").rlike("^[AEIOU]{2}$"))
    code = F.when(F.expr("right(kmer, 1)") == "A", 1).when(F.expr("right(kmer, 1)") == "E", 2).when(F.expr("right(kmer, 1)") == "I", 4).when(F.expr("right(kmer, 1)") == "O", 8).otherwise(16)
    return pairs.groupBy(F.expr("left(kmer, 1)").alias("base")).agg(F.bit_or(code).cast("int").alias("mask"), F.sum("n").alias("n"))


QUERIES = {
    "kmer_filter": lambda s, d: K.supported_kmers(K.kmer_support(_docs(s, d).select("doc_id", "text"), "doc_id", "text", 8)),
    "kmer_spectrum": lambda s, d: K.spectrum(_totals(s, d, 8)),
    "kmer_canonical": lambda s, d: K.canonical_counts(_totals(s, d, 3)),
    "kmer_doc_support": kmer_doc_support,
    "kmer_best_middle_base": lambda s, d: K.best_middle(_totals(s, d, 5)),
    "minimizer_partition": lambda s, d: K.partition_by_minimizer(_totals(s, d, 6), 4),
    "pmer_permutation": lambda s, d: K.inverse_frequency_rank(_totals(s, d, 3)),
    "graph_extensions": lambda s, d: K.extensions(_totals(s, d, 5)),
    "rev_comp": rev_comp,
    "seq_mask": seq_mask,
    "sub_slices": sub_slices,
    "base_encode": base_encode,
    "ext_mask_or": ext_mask_or,
}

_UP = "translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


def _k(k: int) -> str:
    return f"""chars AS (SELECT doc_id, generate_subscripts(c, 1) AS i, unnest(c) AS x FROM (SELECT doc_id, string_split({_UP}, '') AS c FROM documents WHERE text <> '')),
joined AS (SELECT doc_id AS key, {" || ".join(f"lead(x, {j}) OVER w" if j else "x" for j in range(k))} AS kmer FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
rows AS (SELECT key, kmer FROM joined WHERE kmer IS NOT NULL)"""


ORACLE_SQL = {
    "kmer_filter": f"WITH {_k(8)} SELECT kmer, count(*) AS n_obs, count(DISTINCT key) AS n_keys FROM rows GROUP BY kmer HAVING count(*) >= 3 AND count(DISTINCT key) >= 2",
    "kmer_spectrum": f"WITH {_k(8)} SELECT n AS multiplicity, count(*) AS n_kmers FROM (SELECT count(*) AS n FROM rows GROUP BY kmer) GROUP BY n",
    "kmer_canonical": f"WITH {_k(3)}, f AS (SELECT kmer, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM rows WHERE regexp_full_match(kmer, '[ACGT]+')) SELECT least(kmer, rc) AS kmer, count(*) AS n, sum((kmer >= rc)::INT)::BIGINT AS n_flipped FROM f GROUP BY 1",
    "kmer_doc_support": f"WITH {_k(8)} SELECT key AS doc_id, sum(n)::BIGINT AS n_kmers, count(*) AS n_distinct, max(n) AS most FROM (SELECT key, kmer, count(*) AS n FROM rows GROUP BY key, kmer) GROUP BY key",
    "kmer_best_middle_base": f"""WITH {_k(5)}, c AS (SELECT kmer, count(*) AS n, substr(kmer, 1, 2) || chr(1) || substr(kmer, 4) AS flank FROM rows GROUP BY kmer),
b AS (SELECT *, first_value(kmer) OVER w AS top, first_value(n) OVER w AS top_n FROM c WINDOW w AS (PARTITION BY flank ORDER BY n DESC, kmer))
SELECT kmer, n, CASE WHEN n >= 3 THEN kmer ELSE top END AS best, CASE WHEN n >= 3 THEN n ELSE top_n END AS best_n FROM b""",
    "minimizer_partition": f"""WITH {_k(6)}, c AS (SELECT kmer, count(*) AS n FROM rows GROUP BY kmer),
m AS (SELECT kmer, n, substr(list_min([md5(substr(kmer, 1, 4)) || substr(kmer, 1, 4), md5(substr(kmer, 2, 4)) || substr(kmer, 2, 4), md5(substr(kmer, 3, 4)) || substr(kmer, 3, 4)]), 33) AS minimizer FROM c)
SELECT minimizer, sum(n)::BIGINT AS n_kmers, count(*) AS n_distinct FROM m GROUP BY minimizer""",
    "pmer_permutation": f"WITH {_k(3)} SELECT kmer, n, row_number() OVER (ORDER BY n, kmer) - 1 AS rank FROM (SELECT kmer, count(*) AS n FROM rows GROUP BY kmer)",
    "graph_extensions": f"""WITH {_k(5)}, p AS (SELECT substr(kmer, 2, 3) AS kmer, substr(kmer, 1, 1) AS l, substr(kmer, 5, 1) AS r FROM rows)
SELECT kmer, count(*) AS n, array_to_string(list_sort(list_distinct(list(l))), '') AS "left", array_to_string(list_sort(list_distinct(list(r))), '') AS "right" FROM p GROUP BY kmer""",
    "rev_comp": f"SELECT doc_id, md5(reverse(translate(coalesce(text, ''), '{IUPAC}', '{IUPAC_COMPLEMENT}'))) AS rc_md5 FROM documents",
    "seq_mask": """WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS (SELECT doc_id, t, array_to_string(list_transform(string_split(t, ''), lambda x, i: CASE WHEN i > 10 AND i <= 60 THEN x ELSE 'N' END), '') AS s FROM t)
SELECT doc_id, md5(CASE WHEN t = '' THEN '' ELSE s END) AS masked_md5, length(t) AS n FROM m""",
    "sub_slices": "SELECT doc_id, substr(coalesce(text, ''), 1, 16) AS barcode, substr(coalesce(text, ''), 17, 7) AS trim, greatest(length(coalesce(text, '')) - 23, 0) AS rest_chars, md5(substr(coalesce(text, ''), 24)) AS rest_md5 FROM documents",
    "base_encode": f"""WITH c AS (SELECT doc_id, {_UP} AS u FROM documents), n AS (SELECT doc_id, length(u) AS n, length(regexp_replace(u, '[^C]', '', 'g')) AS n1, length(regexp_replace(u, '[^G]', '', 'g')) AS n2, length(regexp_replace(u, '[^T]', '', 'g')) AS n3 FROM c)
SELECT doc_id, n - n1 - n2 - n3 AS n0, n1, n2, n3 FROM n""",
    "ext_mask_or": f"""WITH {_k(2)}, p AS (SELECT * FROM rows WHERE regexp_full_match(kmer, '[AEIOU][AEIOU]'))
SELECT substr(kmer, 1, 1) AS base, bit_or((1 << (strpos('AEIOU', substr(kmer, 2, 1)) - 1)))::INTEGER AS mask, count(*) AS n FROM p GROUP BY 1""",
}
