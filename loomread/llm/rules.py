"""Quality rules as a short-circuit cascade, ordered by measured rejection per cost."""

from __future__ import annotations

import re
import time
from collections import Counter
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.llm.words import extended, with_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTER = re.compile(r"[A-Za-z]|[^\x00-\x7F]")
SYMBOLS = "#*$%&|<>"


class Signals:
    """Counts of one text, each computed on first use only, so that a cascade pays for what it asks."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        if len(w) < 5:
            return 0
        spans = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        seen = Counter(spans)
        if len(seen) == len(spans):
            return 0
        covered, end = 0, 0
        for i, s in enumerate(spans):
            if seen[s] > 1:
                covered += i + 5 - max(i, end)
                end = i + 5
        return covered

    @cached_property
    def n_lettered(self) -> int:
        return sum(1 for w in self.words if LETTER.search(w))


#: Each rule rejects where its function is true. The verdict is their disjunction, so their order only sets the cost.
RULES = {
    "short": lambda s: s.n_words < 10,
    "repeated_words": lambda s: 100 * s.n_repeat_words > 20 * s.n_words,
    "symbols": lambda s: 10 * s.n_symbols > s.n_words,
    "word_length": lambda s: not 2 * s.n_words <= s.word_chars <= 20 * s.n_words,
    "repeated_lines": lambda s: 10 * s.n_dup_lines > 3 * len(s.lines),
    "few_letters": lambda s: 2 * s.n_lettered < s.n_words,
}


def rule_order(docs: DataFrame, text_col: str = "text", sample_rows: int = 512, seed: int = 7) -> list[str]:
    """Names of RULES by falling rejections per second, measured on a sample of about ``sample_rows`` rows.

    Only counts and seconds of each rule come to the driver. An empty table keeps the order of RULES.
    """
    n = docs.count()
    few = docs.select(F.col(text_col).alias("text")).sample(min(1.0, sample_rows / max(n, 1)), seed)

    def measure(batches):
        import pyarrow as pa

        cost, hits = Counter(), Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for name, rule in RULES.items():
                    s, at = Signals(t), time.perf_counter()  # alone: what the rule costs when it runs first
                    hits[name] += bool(rule(s))
                    cost[name] += time.perf_counter() - at
        yield pa.RecordBatch.from_pydict({"rule": list(RULES), "hits": [float(hits[r]) for r in RULES], "cost": [float(cost[r]) for r in RULES]})

    found = {r["rule"]: r["hits"] / max(r["cost"], 1e-9) for r in
             few.mapInArrow(measure, "rule string, hits double, cost double").groupBy("rule").agg(F.sum("hits").alias("hits"), F.sum("cost").alias("cost")).collect()}
    return sorted(RULES, key=lambda r: -found.get(r, 0.0))


def quality_cascade(docs: DataFrame, text_col: str = "text", report: bool = False, order: list[str] | None = None) -> DataFrame:
    """``docs`` with kept and rejected_by: rules run in ``rule_order`` and stop at the first that rejects.

    report=True adds the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every
    text (which computes all signals). A null text counts as empty and is rejected as short; equal texts get equal
    verdicts; columns of docs with one of the new names are replaced; an empty table gives an empty result.
    rejected_by depends on the measured order where several rules reject; kept does not.
    """
    order = order or rule_order(docs, text_col)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if report else []
    new = "".join(f"{c} bigint, " for c in counts) + "base_failed boolean, " * report + "kept boolean, rejected_by string"
    full, arrow = extended(docs.schema, new)
    at, named = docs.columns.index(text_col), set(full.names[len(full.names) - (len(counts) + report + 2):])

    def run(batches):
        for b in batches:
            out = {c: [] for c in [*counts, *["base_failed"] * report, "kept", "rejected_by"]}
            for t in b.column(at).to_pylist():
                s = Signals(t)
                why = next((r for r in order if RULES[r](s)), None)
                for c in counts:
                    out[c].append(getattr(s, c))
                if report:
                    out["base_failed"].append(RULES["short"](s) or RULES["repeated_words"](s))
                out["kept"].append(why is None)
                out["rejected_by"].append(why)
            yield with_columns(b, named, out, arrow)

    return docs.mapInArrow(run, full)


def op4_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_cascade(docs, report=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL_RULES = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x{20}\x{09}-\x{0D}]+') AS w FROM docs),
grams AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5),
keyed AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM grams),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM keyed) WHERE n > 1),
repeats AS (SELECT r, count(DISTINCT i + j) AS n FROM twice, range(5) t(j) GROUP BY r),
line AS (SELECT r, unnest(string_split(text, chr(10))) AS l FROM docs),
lines AS (SELECT r, count(*) AS n, count(DISTINCT l) AS u FROM line WHERE regexp_matches(l, '[^\x{20}\x{09}-\x{0D}]') GROUP BY r),
counts AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x{00}-\x{7F}]'))) AS n_lettered FROM words)
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(l.n - l.u, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(p.n, 0) > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * coalesce(p.n, 0) > 20 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR 10 * coalesce(l.n - l.u, 0) > 3 * coalesce(l.n, 0) OR 2 * n_lettered < n_words) AS kept
FROM counts c LEFT JOIN repeats p USING (r) LEFT JOIN lines l USING (r)
"""
