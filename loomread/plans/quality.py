"""Queries on qualities, samples, orders, alerts and record formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomread.functions.sequences import characters, micros, phred, trim_length
from loomread.operators import rules as R
from loomread.sources import records as IO


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _quals(s, d):
    """Characters of each text as qualities."""
    return _t(s, d, "documents").select("doc_id", characters(F.col("text")).alias("c")).select("doc_id", F.transform("c", phred).alias("q"))


def quality_histogram(s, d):
    return _quals(s, d).select(F.posexplode_outer("q").alias("cycle", "q")).where("q is not null").groupBy("cycle", "q").agg(F.count("*").alias("n"))


def bad_cycles(s, d):
    """Positions where more than 5 % of over 200 texts have quality 0."""
    r = _quals(s, d).select(F.posexplode_outer("q").alias("cycle", "q")).where("q is not null").groupBy("cycle").agg(F.count("*").alias("n"), F.sum((F.col("q") == 0).cast("int")).alias("bad"))
    return r.where((F.col("n") > 200) & (F.col("bad") > 0.05 * F.col("n")))


def phred_decode(s, d):
    return _quals(s, d).select("doc_id", F.array_min("q").alias("lo"), F.array_max("q").alias("hi"), F.coalesce(F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).alias("sum"))


def expected_errors(s, d):
    e = F.aggregate("q", F.lit(0.0), lambda a, x: a + F.pow(F.lit(10.0), -x / 10.0))
    return _quals(s, d).select("doc_id", F.when(F.size("q") > 0, F.round(e, 4)).alias("ee"))


def q30_fraction(s, d):
    n = F.size(F.filter("q", lambda x: x >= 30))
    return _quals(s, d).select("doc_id", F.round(F.try_divide(n, F.size("q")), 6).alias("q30"))


def _h(*cols):
    """A sampling hash of 16 bits that any engine can compute."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *cols)), 1, 4), 16, 10).cast("long")


def range_bucket(s, d):
    """Rows dealt into 8 half-open time ranges of equal width."""
    t = (micros(F.col("ts")) / 1000000).cast("long")
    e = _t(s, d, "events").select("event_id", t.alias("t"))
    ends = e.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    r = e.crossJoin(F.broadcast(ends)).withColumn("bucket", F.expr("least(7, (t - lo) * 8 div greatest(hi - lo, 1))"))
    return r.groupBy("bucket").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))


def sort_by_key(s, d):
    """Each event's place in its key's run of a table sorted by key and time, without ranking the whole table in one task."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(s, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("ord"))


def sort_by_pos(s, d):
    """Events in the order of time within a day."""
    e = _t(s, d, "events").select("event_id", micros(F.col("ts")).alias("us"))
    e = e.withColumn("day", F.floor(F.col("us") / 86400000000))
    return e.select("event_id", "day", F.row_number().over(Window.partitionBy("day").orderBy("us", "event_id")).alias("ord"))


def _metrics(s, d):
    m = _t(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.round(F.avg("l_quantity"), 6).alias("mean_q"), F.round(F.avg("l_discount"), 6).alias("disc"), F.count("*").cast("double").alias("rows"))
    return m.select("stage", F.explode(F.create_map(F.lit("mean_q"), "mean_q", F.lit("disc"), "disc", F.lit("rows"), "rows")).alias("metric", "value"))


RULES = [("low_rows", "rows", "<", 20000.0, "alarm", None), ("high_q", "mean_q", ">", 25.0, "alarm", None), ("very_high_q", "mean_q", ">", 20.0, "exit", "high_q"), ("disc", "disc", ">", 0.04, "alarm", "very_high_q"), ("none", "missing", ">", 0.0, "alarm", None)]


def _rules(s):
    return s.createDataFrame(RULES, "name string, metric string, compare string, threshold double, action string, parent string")


def stat_report(s, d):
    """Metrics of a stage as report lines."""
    return _metrics(s, d).groupBy("stage").agg(F.concat_ws("; ", F.array_sort(F.collect_list(F.concat("metric", F.lit("="), F.format_number("value", 2))))).alias("line"))


def _reads(s, d):
    return _t(s, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("name"), F.md5("html").alias("seq"), F.md5(F.concat("url", F.lit("q"))).alias("qual"))


def fasth_roundtrip(s, d):
    """Each turn as a record of four lines, written and read back; digest by conversation."""
    c = _t(s, d, "conversations")
    got = IO.records_roundtrip(c, [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("text")], ["conv_id", "turn", "role", "text"])
    return got.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5("text").alias("text_md5"))


def locus_parse(s, d):
    locus = F.concat(F.lit("chr"), F.col("l_suppkey"), F.lit(":"), F.col("l_partkey"), F.lit("-"), (F.col("l_partkey") + F.col("l_quantity").cast("int")).cast("string"))
    p = _t(s, d, "lineitem").select(IO.parse_locus(locus).alias("x"))
    return p.groupBy("x.chrom").agg(F.count("*").alias("n"), F.min("x.start").alias("start"), F.max("x.stop").alias("stop"))


def header_regex(s, d):
    p = _t(s, d, "pages").select("page_id", F.regexp_extract("url", r"^([a-z]+)://([^/]+)/?(.*)$", 1).alias("scheme"), F.regexp_extract("url", r"^([a-z]+)://([^/]+)/?(.*)$", 2).alias("host"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))
    return p


QUERIES = {
    "phred_decode": phred_decode,
    "expected_errors": expected_errors,
    "quality_trim": lambda s, d: _quals(s, d).select("doc_id", trim_length(F.col("q"), 5, 30).cast("long").alias("kept")),
    "quality_histogram": quality_histogram,
    "bad_cycles": bad_cycles,
    "q30_fraction": q30_fraction,
    "sort_by_key": sort_by_key,
    "sort_by_pos": sort_by_pos,
    "range_bucket": range_bucket,
    "key_sample": lambda s, d: _t(s, d, "events").where(_h("user_id") < 16384).select("event_id", "user_id"),
    "group_sample": lambda s, d: _t(s, d, "events").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string"))))).where("r <= 5").select("user_id", "event_id"),
    "take_n": lambda s, d: _t(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100),
    "alert_eval": lambda s, d: R.evaluate(_metrics(s, d), _rules(s)),
    "alert_suppress": lambda s, d: R.suppress(R.evaluate(_metrics(s, d), _rules(s))).select("stage", "name", "action"),
    "stat_report": stat_report,
    "fastq_parse": lambda s, d: IO.fastq_roundtrip(_reads(s, d)),
    "fasth_roundtrip": fasth_roundtrip,
    "locus_parse": locus_parse,
    "header_regex": header_regex,
}

_Q = "c AS (SELECT doc_id, generate_subscripts(c, 1) - 1 AS cycle, least(greatest(ascii(unnest(c)) - 33, 0), 60) AS q FROM (SELECT doc_id, string_split(text, '') AS c FROM documents WHERE text <> ''))"
_M = """w AS (SELECT l_returnflag AS stage, round(avg(l_quantity), 6) AS mean_q, round(avg(l_discount), 6) AS disc, count(*)::DOUBLE AS rows FROM lineitem GROUP BY 1),
m AS (SELECT stage, 'mean_q' AS metric, mean_q AS value FROM w UNION ALL SELECT stage, 'disc', disc FROM w UNION ALL SELECT stage, 'rows', rows FROM w)"""
_R = "r(name, metric, compare, threshold, action, parent) AS (VALUES " + ", ".join("({})".format(", ".join("NULL" if x is None else repr(x) for x in r)) for r in RULES) + "), e AS (SELECT stage, name, r.metric, action, parent, value, coalesce((compare = '>') <> (value < threshold), false) AS raised FROM r LEFT JOIN m ON r.metric = m.metric)"
ORACLE_SQL = {
    "phred_decode": f"WITH {_Q} SELECT d.doc_id, min(q)::INTEGER AS lo, max(q)::INTEGER AS hi, coalesce(sum(q), 0)::BIGINT AS sum FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id",
    "expected_errors": f"WITH {_Q} SELECT d.doc_id, round(sum(pow(10.0, -q / 10)), 4) AS ee FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id",
    "quality_trim": f"""WITH {_Q}, w AS (SELECT doc_id, cycle, min(q) OVER (PARTITION BY doc_id ORDER BY cycle ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS lo FROM c)
SELECT d.doc_id, coalesce(max(CASE WHEN lo >= 30 AND cycle >= 4 THEN cycle + 1 END), 0)::BIGINT AS kept FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id""",
    "quality_histogram": f"WITH {_Q} SELECT cycle::INTEGER AS cycle, q::INTEGER AS q, count(*) AS n FROM c GROUP BY 1, 2",
    "bad_cycles": f"WITH {_Q} SELECT cycle::INTEGER AS cycle, count(*) AS n, sum((q = 0)::INT)::BIGINT AS bad FROM c GROUP BY 1 HAVING count(*) > 200 AND sum((q = 0)::INT) > 0.05 * count(*)",
    "q30_fraction": f"WITH {_Q} SELECT d.doc_id, round(avg((q >= 30)::INT), 6) AS q30 FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id",
    "sort_by_key": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS ord FROM events",
    "sort_by_pos": "SELECT event_id, epoch_us(ts) // 86400000000 AS day, row_number() OVER (PARTITION BY epoch_us(ts) // 86400000000 ORDER BY ts, event_id)::INTEGER AS ord FROM events",
    "range_bucket": """WITH e AS (SELECT epoch_us(ts) // 1000000 AS t FROM events), r AS (SELECT t, least(7, (t - min(t) OVER ()) * 8 // greatest(max(t) OVER () - min(t) OVER (), 1)) AS bucket FROM e)
SELECT bucket, count(*) AS n, min(t) AS lo, max(t) AS hi FROM r GROUP BY 1""",
    "key_sample": "SELECT event_id, user_id FROM events WHERE ('0x' || substr(md5(user_id::VARCHAR), 1, 4))::BIGINT < 16384",
    "group_sample": "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR)) AS r FROM events) WHERE r <= 5",
    "take_n": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "alert_eval": f"WITH {_M}, {_R} SELECT * FROM e",
    "alert_suppress": f"""WITH RECURSIVE {_M}, {_R}, a AS (SELECT DISTINCT name, parent AS anc FROM e WHERE parent IS NOT NULL UNION SELECT a.name, e.parent FROM a JOIN e ON e.name = a.anc WHERE e.parent IS NOT NULL)
SELECT stage, name, action FROM e WHERE raised AND NOT EXISTS (SELECT 1 FROM a JOIN e p ON p.name = a.anc WHERE a.name = e.name AND p.stage = e.stage AND p.raised)""",
    "stat_report": f"WITH {_M} SELECT stage, string_agg(metric || '=' || format('{{:,.2f}}', value), '; ' ORDER BY metric) AS line FROM m GROUP BY 1",
    "fastq_parse": "SELECT 'p' || page_id AS name, md5(html) AS seq, md5(url || 'q') AS qual FROM pages",
    "fasth_roundtrip": "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations",
    "locus_parse": "SELECT 'chr' || l_suppkey AS chrom, count(*) AS n, min(l_partkey) AS start, max(l_partkey + l_quantity::BIGINT) AS stop FROM lineitem GROUP BY 1",
    "header_regex": r"SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)/?(.*)$', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/]+)/?(.*)$', 2) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages",
}
