"""Queries on paired and listed files, file names, sheets, checks and positions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomread.functions.sequences import reverse_complement
from loomread.operators import intervals as I
from loomread.plans.relations import _a, _A, _merge, _t
from loomread.sources import records as IO
from loomread.storage import scratch


def _reads(s, d, mate):
    letters = F.translate(F.md5(F.concat("url", F.lit(mate))), "0123456789abcdef", "ACGTACGTACGTACGN")
    return _t(s, d, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(f"/{mate}")).alias("name"), letters.alias("seq"), F.md5(F.concat("html", F.lit(mate))).alias("qual"))


def paired_reads(s, d, without_n=False):
    """Mates of two files of reads, joined by the name before the slash; without_n leaves out pairs with an N."""
    both = []
    for mate in "12":
        path = scratch(s, "mates")
        IO.write_fastq(_reads(s, d, mate), path)
        both.append(IO.read_fastq(s, path).select(F.substring_index("name", "/", 1).alias("name"), F.col("seq").alias(f"r{mate}"), F.col("qual").alias(f"q{mate}")))
    r = both[0].join(both[1], "name")
    return r.where("not contains(r1, 'N') and not contains(r2, 'N')") if without_n else r


def interleaved_reads(s, d):
    """Pairs written one after the other into one file, read back as pairs by the number of the record."""
    path = scratch(s, "interleaved")
    a, b = _reads(s, d, "1"), _reads(s, d, "2")
    pairs = a.select(F.substring_index("name", "/", 1).alias("k"), F.struct("*").alias("a")).join(b.select(F.substring_index("name", "/", 1).alias("k"), F.struct("*").alias("b")), "k")
    line = lambda x: F.concat(F.lit("@"), f"{x}.name", F.lit("\n"), f"{x}.seq", F.lit("\n+\n"), f"{x}.qual")
    pairs.select(F.concat_ws("\n", line("a"), line("b")).alias("value")).write.text(path)
    r = IO.line_records(s, path, ["n1", "r1", "p1", "q1", "n2", "r2", "p2", "q2"])
    return r.select(F.substring_index(F.expr("substring(n1, 2)"), "/", 1).alias("name"), "r1", "q1", "r2", "q2")


def _pairs(s, d):
    a, b = _reads(s, d, "1"), _reads(s, d, "2")
    k = F.substring_index("name", "/", 1).alias("name")
    r = a.select(k, F.col("seq").alias("r1"), F.col("qual").alias("q1")).join(b.select(k, F.col("seq").alias("r2"), F.col("qual").alias("q2")), "name")
    return r.select("*", F.substring("r1", 1, 16).alias("key"), F.substring("q1", 1, 16).alias("key_q"), F.substring("r2", 1, 8).alias("index"), F.substring("q2", 1, 8).alias("index_q"))


def fasth_pairs(s, d):
    path = scratch(s, "fasth")
    IO.write_fasth(_pairs(s, d), path)
    return IO.read_fasth(s, path)


def listed_files(s, d):
    """Pairs of the files that a list of file names holds: all parts of a written table."""
    path = scratch(s, "parts")
    IO.write_fasth(_pairs(s, d), path)
    found = s.read.text(path).select(F.col("_metadata.file_path").alias("value")).distinct()
    listing = scratch(s, "list")
    found.write.text(listing)
    return IO.read_fasth(s, IO.read_listed(s, listing)).select("name", "key")


def discovered_files(s, d):
    """Lines by lane and sample of files found by a pattern below a folder whose subfolders name them."""
    path = scratch(s, "found")
    t = _t(s, d, "supplier").select(F.concat(F.lit("lane-"), F.lpad((F.col("s_nationkey") % 4).cast("string"), 3, "0")).alias("lane"), F.concat(F.lit("S"), (F.col("s_suppkey") % 5).cast("string")).alias("sample"), F.col("s_name").alias("value"))
    t.write.partitionBy("sample", "lane").text(path)
    raw = s.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return raw.groupBy(F.regexp_extract("file", r"sample=(S\d+)/", 1).alias("sample"), F.regexp_extract("file", r"lane=lane-(\d+)/", 1).cast("long").alias("lane")).agg(F.count("*").alias("n"))


def filename_parse(s, d):
    """Prefix, sample, lane, read and group of file names."""
    name = F.concat(F.replace("s_name", F.lit("#"), F.lit("_")), F.lit("_S"), "s_nationkey", F.lit("_L00"), F.col("s_suppkey") % 8 + 1, F.lit("_R"), F.col("s_suppkey") % 2 + 1, F.lit("_"), F.lpad((F.col("s_suppkey") % 20).cast("string"), 3, "0"), F.lit(".fastq.gz"))
    x = lambda i: F.regexp_extract("file", r"^(.+)_S(\d+)_L(\d{3})_([RI])(\d)_(\d{3})\.fastq(\.gz)?$", i)
    return _t(s, d, "supplier").select("s_suppkey", name.alias("file")).select("s_suppkey", x(1).alias("prefix"), x(2).cast("long").alias("sample"), x(3).cast("long").alias("lane"), F.concat(x(4), x(5)).alias("read"), x(6).cast("long").alias("group"))


def sample_sheet(s, d):
    """Rows of a sheet with sections: a line in brackets names the section of the lines after it.

    A sheet is one short file; the running section is taken in the order of its lines.
    """
    n, r = _t(s, d, "nation"), _t(s, d, "region")
    lines = r.select((F.col("r_regionkey") * 1000).cast("long").alias("at"), F.concat(F.lit("["), "r_name", F.lit("]")).alias("line")).unionAll(
        n.select((F.col("n_regionkey") * 1000 + F.col("n_nationkey") + 1).cast("long"), F.concat_ws(",", "n_nationkey", "n_name")))
    named = lines.withColumn("section", F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), F.expr("substring(line, 2, length(line) - 2)")), True).over(Window.orderBy("at")))
    cells = F.split("line", ",")
    return named.where(~F.col("line").startswith("[")).select("section", cells[0].cast("long").alias("key"), cells[1].alias("name"))


def stats_csv(s, d):
    """Metrics by flag, one column each, as CSV with a header, written and read back."""
    path = scratch(s, "stats")
    r = _t(s, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.max("l_quantity").alias("most"), F.min("l_extendedprice").alias("least"))
    r.write.option("header", True).csv(path)
    return s.read.option("header", True).schema("l_returnflag string, rows long, most double, least double").csv(path)


def safe_json(s, d):
    """Ratios as JSON lines, with null for what is not a number or has no end."""
    r = _t(s, d, "lineitem").groupBy("l_linenumber").agg(F.round(F.try_divide(F.sum(F.when(F.col("l_tax") > 0.07, F.col("l_quantity"))), F.count_if(F.col("l_tax") > 0.07)), 2).alias("a"), F.lit(float("inf")).alias("b"))
    text = lambda c: F.when(F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")), "null").otherwise(F.format_string("%.2f", c))
    return r.select("l_linenumber", F.concat(F.lit('{"a":'), text("a"), F.lit(',"b":'), text("b"), F.lit("}")).alias("line"))


#: Rules to be checked: name, compare, threshold and action; some lack what a rule must have.
SHAKY = [("a", "<", 1.0, "alarm"), ("b", "=", 1.0, "alarm"), ("c", ">", None, "exit"), ("d", None, 2.0, "alarm"), (None, "<", 2.0, None)]


def rule_check(s, d):
    """What is wrong with each rule that a table's metrics would be held against: a missing key or another comparison."""
    rules = s.createDataFrame(SHAKY, "name string, compare string, threshold double, action string")
    stages = _t(s, d, "lineitem").select(F.col("l_returnflag").alias("stage")).distinct()
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("name", "compare", "threshold", "action")])
    return stages.crossJoin(F.broadcast(rules)).select("stage", "name", missing.alias("missing"), F.coalesce(F.col("compare").isin("<", ">"), F.lit(False)).alias("comparable"))


def line_positions(s, d, view=None):
    """Where each line of an order starts: the quantity of the lines before it; with ``view`` only lines that start so near to an end."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    r = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce(F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).cast("long").alias("pos"),
                                    F.sum("l_quantity").over(Window.partitionBy("l_orderkey")).cast("long").alias("size"))
    return r if view is None else r.where((F.col("pos") < view) | (F.col("size") - F.col("pos") <= view))


def gap_statistics(s, d):
    """Gaps between merged intervals of suppliers: how many are short (7 days at most), and their share of the days between."""
    w = Window.partitionBy("k").orderBy("start")
    g = I.merge(_a(s, d), "k").select("k", (F.lead("start").over(w) - F.col("stop")).alias("gap")).where("gap > 0")
    return g.groupBy("k").agg(F.count("*").alias("gaps"), F.count_if(F.col("gap") <= 7).alias("short"), F.round(F.sum(F.when(F.col("gap") <= 7, F.col("gap")).otherwise(0)) / F.sum("gap"), 6).alias("share"))


def final_rate_sample(s, d, wanted=300):
    """About ``wanted`` events: each is kept if its hash is below wanted / all."""
    e = _t(s, d, "events").select("event_id", F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 6), 16, 10).cast("long").alias("h"))
    return e.crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).where(F.col("h") * F.col("n") < wanted * 16777216).select("event_id")


def _masks(s, d):
    """Per supplier a run's reads: template of length, index, template."""
    return _t(s, d, "supplier").select("s_suppkey", F.array(F.struct((F.col("s_nationkey") + 90).cast("long").alias("n"), F.lit(False).alias("index")), F.struct(F.lit(8).cast("long").alias("n"), F.lit(True).alias("index")), F.struct((F.col("s_suppkey") % 7 + 80).alias("n"), F.lit(False).alias("index"))).alias("reads"))


QUERIES = {
    "paired_reads": paired_reads,
    "n_filter": lambda s, d: paired_reads(s, d, True).select("name"),
    "interleaved_reads": interleaved_reads,
    "fasth_pairs": fasth_pairs,
    "listed_files": listed_files,
    "discovered_files": discovered_files,
    "filename_parse": filename_parse,
    "record_counts": lambda s, d: s.createDataFrame([(t,) for t in ("orders", "lineitem", "documents")], "name string").join(
        _t(s, d, "orders").agg(F.lit("orders").alias("name"), F.count("*").alias("n")).unionAll(_t(s, d, "lineitem").agg(F.lit("lineitem"), F.count("*"))).unionAll(_t(s, d, "documents").agg(F.lit("documents"), F.count("*"))), "name"),
    "sample_sheet": sample_sheet,
    "stats_csv": stats_csv,
    "safe_json": safe_json,
    "rule_check": rule_check,
    "mean_length": lambda s, d: _t(s, d, "documents").groupBy("lang").agg(F.round(F.avg(F.length("text")), 6).alias("mean"), F.count("*").alias("n")),
    "palindromes": lambda s, d: _pairs(s, d).select("name", F.substring("r1", 1, 4).alias("kmer")).where(F.col("kmer") == reverse_complement(F.col("kmer"))),
    "kmer_extend": lambda s, d: _pairs(s, d).select("name", F.concat(F.substring("r1", 2, 15), F.substring("r1", 17, 1)).alias("right"), F.concat(F.substring("r2", 1, 1), F.substring("r1", 1, 15)).alias("left")),
    "key_of_id": lambda s, d: _t(s, d, "events").select("event_id", "user_id").join(_t(s, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name"), "user_id", "left").select("event_id", "c_name"),
    "line_positions": line_positions,
    "end_positions": lambda s, d: line_positions(s, d, 40),
    "gap_statistics": gap_statistics,
    "final_rate_sample": final_rate_sample,
    "bases_mask": lambda s, d: _masks(s, d).select("s_suppkey", F.array_join(F.transform("reads", lambda r: F.concat(F.when(r["index"], "I").otherwise("Y"), r["n"].cast("string"))), ",").alias("mask")),
    "slice_quality": lambda s, d: _reads(s, d, "1").select("name", F.aggregate(F.transform(F.slice(F.split("qual", ""), 1, 16), lambda c: F.ascii(c) - 33), F.lit(0), lambda a, x: a + x).cast("long").alias("key_sum"), F.aggregate(F.transform(F.slice(F.split("qual", ""), 17, 16), lambda c: F.ascii(c) - 33), F.lit(0), lambda a, x: a + x).cast("long").alias("read_sum")),
    "metric_names": lambda s, d: _t(s, d, "part").withColumnsRenamed({"p_name": "name", "p_retailprice": "price"}).groupBy("p_brand").agg(F.count("name").alias("n"), F.max("price").alias("price")),
}

_LETTERS = "translate(md5(url || '{0}'), '0123456789abcdef', 'ACGTACGTACGTACGN')"
_R = f"r AS (SELECT 'p' || page_id AS name, {_LETTERS.format(1)} AS r1, md5(html || '1') AS q1, {_LETTERS.format(2)} AS r2, md5(html || '2') AS q2 FROM pages)"
_POS = """p AS (SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
sum(l_quantity) OVER (PARTITION BY l_orderkey)::BIGINT AS size FROM lineitem)"""
ORACLE_SQL = {
    "paired_reads": f"WITH {_R} SELECT * FROM r",
    "n_filter": f"WITH {_R} SELECT name FROM r WHERE NOT contains(r1, 'N') AND NOT contains(r2, 'N')",
    "interleaved_reads": f"WITH {_R} SELECT * FROM r",
    "fasth_pairs": f"""WITH {_R} SELECT name, r1, q1, r2, q2, substr(r1, 1, 16) AS key, substr(q1, 1, 16) AS key_q, substr(r2, 1, 8) AS "index", substr(q2, 1, 8) AS index_q FROM r""",
    "listed_files": f"WITH {_R} SELECT name, substr(r1, 1, 16) AS key FROM r",
    "discovered_files": "SELECT 'S' || (s_suppkey % 5) AS sample, (s_nationkey % 4)::BIGINT AS lane, count(*) AS n FROM supplier GROUP BY 1, 2",
    "filename_parse": """SELECT s_suppkey, replace(s_name, '#', '_') AS prefix, s_nationkey::BIGINT AS sample, s_suppkey % 8 + 1 AS lane, 'R' || (s_suppkey % 2 + 1) AS read, s_suppkey % 20 AS "group" FROM supplier""",
    "record_counts": "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'documents', count(*) FROM documents",
    "sample_sheet": "SELECT r_name AS section, n_nationkey::BIGINT AS key, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "stats_csv": "SELECT l_returnflag, count(*) AS rows, max(l_quantity) AS most, min(l_extendedprice) AS least FROM lineitem GROUP BY 1",
    "safe_json": """WITH r AS (SELECT l_linenumber, round(sum(l_quantity) FILTER (l_tax > 0.07) / nullif(count(*) FILTER (l_tax > 0.07), 0), 2) AS a FROM lineitem GROUP BY 1)
SELECT l_linenumber, '{"a":' || CASE WHEN a IS NULL THEN 'null' ELSE format('{:.2f}', a) END || ',"b":null}' AS line FROM r""",
    "rule_check": """WITH r(name, compare, threshold, action) AS (VALUES ('a', '<', 1.0, 'alarm'), ('b', '=', 1.0, 'alarm'), ('c', '>', NULL, 'exit'), ('d', NULL, 2.0, 'alarm'), (NULL, '<', 2.0, NULL))
SELECT l_returnflag AS stage, name, concat_ws(',', CASE WHEN name IS NULL THEN 'name' END, CASE WHEN compare IS NULL THEN 'compare' END, CASE WHEN threshold IS NULL THEN 'threshold' END, CASE WHEN action IS NULL THEN 'action' END) AS missing,
  coalesce(compare IN ('<', '>'), false) AS comparable FROM (SELECT DISTINCT l_returnflag FROM lineitem), r""",
    "mean_length": "SELECT lang, round(avg(length(text)), 6) AS mean, count(*) AS n FROM documents GROUP BY 1",
    "palindromes": f"WITH {_R} SELECT name, substr(r1, 1, 4) AS kmer FROM r WHERE substr(r1, 1, 4) = reverse(translate(substr(r1, 1, 4), 'ACGT', 'TGCA'))",
    "kmer_extend": f"""WITH {_R} SELECT name, substr(r1, 2, 15) || substr(r1, 17, 1) AS "right", substr(r2, 1, 1) || substr(r1, 1, 15) AS "left" FROM r""",
    "key_of_id": "SELECT event_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey",
    "line_positions": f"WITH {_POS} SELECT * FROM p",
    "end_positions": f"WITH {_POS} SELECT * FROM p WHERE pos < 40 OR size - pos <= 40",
    "gap_statistics": f"""WITH {_A}, {_merge('a')}, g AS (SELECT k, lead(start) OVER (PARTITION BY k ORDER BY start) - stop AS gap FROM am)
SELECT k, count(*) AS gaps, count(*) FILTER (gap <= 7) AS short, round(coalesce(sum(gap) FILTER (gap <= 7), 0) / sum(gap), 6) AS share FROM g WHERE gap > 0 GROUP BY 1""",
    "final_rate_sample": "SELECT event_id FROM events, (SELECT count(*) AS n FROM events) WHERE ('0x' || substr(md5(event_id::VARCHAR), 1, 6))::BIGINT * n < 300 * 16777216::BIGINT",
    "bases_mask": "SELECT s_suppkey, 'Y' || (s_nationkey + 90) || ',I8,Y' || (s_suppkey % 7 + 80) AS mask FROM supplier",
    "slice_quality": f"WITH {_R} SELECT name || '/1' AS name, list_sum(list_transform(string_split(substr(q1, 1, 16), ''), lambda c: ascii(c) - 33))::BIGINT AS key_sum, list_sum(list_transform(string_split(substr(q1, 17, 16), ''), lambda c: ascii(c) - 33))::BIGINT AS read_sum FROM r",
    "metric_names": "SELECT p_brand, count(p_name) AS n, max(p_retailprice) AS price FROM part GROUP BY 1",
}
