"""Edge cases of the operators that the tables don't hold."""

from pyspark.sql import functions as F

from loomread.functions.sequences import canonical, is_flipped, masked, reverse_complement
from loomread.operators import intervals, kmers, rules, sessions, stats
from loomread.operators.components import connected_components
from loomread.sources import records
from loomread.storage import scratch


def test_sequences(spark):
    df = spark.createDataFrame([("ACGT",), ("AAA",), ("acgN",), ("",), (None,)], "s string")
    got = df.select(reverse_complement(F.col("s")), canonical(F.col("s")), is_flipped(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("ACGT", "ACGT", True), ("TTT", "AAA", False), ("Ncgt", "Ncgt", True), ("", "", True), (None, None, None)]
    assert spark.range(1).select(masked(F.lit("ABCDEFGH"), 2, 5)).first()[0] == "NNCDENNN"


def test_short_texts_have_no_kmers(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, ""), (4, "abc")], "id long, t string")
    assert [tuple(r) for r in kmers.kmer_rows(df, "id", "t", 3).collect()] == [(4, "ABC")]


def test_n50_tie_takes_the_mean(spark):
    df = spark.createDataFrame([("a", 2), ("a", 2), ("a", 4), ("b", 5)], "k string, v long")
    assert {r.k: r.n50 for r in stats.n50(df, ["k"], "v").collect()} == {"a": 3, "b": 5}


def test_constant_histogram_is_one_bin(spark):
    df = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "k string, v double")
    assert [tuple(r) for r in stats.fixed_histogram(df, ["k"], "v", 7.0).collect()] == [("a", 0, 2.0, 2)]
    small = spark.createDataFrame([("a", 0.0), ("a", 0.5)], "k string, v double")
    assert sorted(r.bin for r in stats.fixed_histogram(small, ["k"], "v", 7.0).collect()) == [0, 7]


def test_touching_intervals_stay_apart(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 6, 7), (1, 20, 20)], "k long, start long, stop long")
    assert sorted((r.start, r.stop) for r in intervals.merge(df, "k").collect()) == [(0, 5), (5, 8), (20, 20)]
    cut = spark.createDataFrame([(1, 2, 3)], "k long, start long, stop long")
    assert sorted((r.start, r.stop) for r in intervals.subtract(df, cut, "k").collect()) == [(0, 2), (3, 8)]


def test_components_with_loops_and_chains(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 30), (41, 40), (40, 42), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 40: 40, 41: 40, 42: 40}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_rules_at_the_threshold(spark):
    m = spark.createDataFrame([("s", "x", 5.0)], "stage string, metric string, value double")
    r = spark.createDataFrame([("over", "x", ">", 5.0, "a", None), ("under", "x", "<", 5.0, "a", None)], "name string, metric string, compare string, threshold double, action string, parent string")
    assert {x.name: x.raised for x in rules.evaluate(m, r).collect()} == {"over": True, "under": False}


def test_close_pairs_counts_without_making_pairs(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0, 0, 5, 10, 100])], "k long, id long, t long")
    assert sessions.close_pairs(df, ["k"], "t", "id", 5).first().pairs == 4


def test_fastq_qualities_with_marks(spark):
    rows = [("a", "ACGT", "@III"), ("b", "AC", "+@"), ("c", "GGG", "III"), ("d", "", ""), ("@e", "T", "@"), ("f", "ACG", "@@@")] * 50
    df = spark.createDataFrame([(f"{n}{i}", s, q) for i, (n, s, q) in enumerate(rows)], "name string, seq string, qual string").coalesce(2)
    path = scratch(spark, "fastq-test")
    records.write_fastq(df, path)
    want = sorted(map(tuple, df.collect()), key=repr)
    assert sorted(map(tuple, records.read_fastq(spark, path).collect()), key=repr) == want
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")  # many splits a file
    try:
        assert sorted(map(tuple, records.read_fastq(spark, path).collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_with_empty_and_null_fields(spark):
    rows = [("1", "a", ""), ("2", None, None), ("3", "", ""), ("", "", ""), (None, "x", "y"), ("4", "back\\slash \\n \\N", "two\n\n\nlines\n"), ("5", "\\E", "u v")]
    df = spark.createDataFrame(rows, "a string, b string, c string").coalesce(1)
    got = records.records_roundtrip(df, [F.col("a"), F.col("b"), F.col("c")], ["a", "b", "c"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_suppression_goes_up_any_number_of_generations(spark):
    from loomread.operators.rules import suppress

    rows = [("s", n, p, n in "af") for n, p in zip("bcdefg", "abcdef")] + [("s", "a", None, True), ("t", "f", "e", True), ("s", "x", "y", True), ("s", "y", "x", False)]
    got = suppress(spark.createDataFrame(rows, "stage string, name string, parent string, raised boolean")).select("stage", "name").collect()
    assert sorted(tuple(r) for r in got) == [("s", "a"), ("s", "x"), ("t", "f")]


def test_graph_rounds_against_plain_python(spark):
    import random

    from loomread.operators import graphs as G

    rng = random.Random(6)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(55)} | {(100 + k, 101 + k) for k in range(9)}
    edges = {(u, v) for u, v in edges if u != v}
    df = spark.createDataFrame(sorted(edges), "u long, v long")
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    while True:
        new = {n: r | {v for u, v in edges if u in r} for n, r in reach.items()}
        if new == reach:
            break
        reach = new
    strong = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    assert {r.node: r.component for r in G.strong_components(df).collect()} == strong
    depth, front = {100: 0}, [100]
    while front:
        front = [v for u, v in edges if u in front and v not in depth and not depth.__setitem__(v, depth[u] + 1)]
    assert {r.node: r.depth for r in G.breadth_first(df, spark.createDataFrame([(100,)], "node long")).collect()} == depth
    assert {tuple(r) for r in G.reachable(df, "u", "v").collect()} == {(u, w) for u, v in edges for w in reach[v]}
    core = set(edges)
    while True:
        left = {(u, v) for u, v in core if any(y == u for _, y in core) and any(x == v for x, _ in core)}
        if left == core:
            break
        core = left
    assert {tuple(r) for r in G.cyclic_core(df).collect()} == core
    assert G.strong_components(df.limit(0)).collect() == [] and G.reachable(df.limit(0), "u", "v").collect() == []


def test_ordinals_and_totals(spark):
    from loomread.operators.ordinals import ordinals, running_totals

    rows = [(k * 7 % 101, k) for k in range(101)] + [(None, 500)]
    df = spark.createDataFrame(rows, "a long, n long").repartition(5)
    got = sorted((r.i, r.a) for r in ordinals(df, ["a"], "i", 1).collect())
    assert got == [(k + 1, a) for k, a in enumerate([None, *range(101)])]
    sums = {r.a: r.before for r in running_totals(df, ["a"], "n", "before").collect()}
    at = 0
    for a, n in sorted(rows, key=lambda x: -1 if x[0] is None else x[0]):
        assert sums[a] == at
        at += n
    assert ordinals(df.limit(0), ["a"], "i").collect() == []


def test_kmers_of_odd_characters(spark):
    from collections import Counter

    from loomread.operators.kmers import kmer_rows

    rows = [(1, "﻿﻿ab"), (2, "é日😀x"), (3, "ab"), (4, ""), (5, None), (6, "abcabc")]
    got = Counter((r.key, r.kmer) for r in kmer_rows(spark.createDataFrame(rows, "id long, text string"), "id", "text", 3).collect())
    up = lambda t: "".join(c.upper() if "a" <= c <= "z" else c for c in t or "")
    assert got == Counter((i, up(t)[k:k + 3]) for i, t in rows for k in range(len(t or "") - 2))


def test_variant_kinds_and_files(spark):
    from pyspark.sql import functions as F

    from loomread.sources import variants as V
    from loomread.storage import scratch

    rows = [("1", 5, "A", "C"), ("1", 6, "AC", "A"), ("2", 7, "A", "ACG"), ("2", 8, "AC", "GT"), ("2", 9, "A", "A"), ("2", 9, "A", None)]
    path = scratch(spark, "vcf")
    V.write_vcf(spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string"), path)
    got = V.read_vcf(spark, path)
    assert sorted((r.chrom, r.pos, r.kind) for r in got.collect()) == [("1", 5, "S"), ("1", 6, "D"), ("2", 7, "I"), ("2", 8, "C"), ("2", 9, "X"), ("2", 9, "X")]
    assert V.read_vcf(spark, path, locus=("2", 6, 8)).count() == 2 and got.where(F.col("alt").isNull()).count() == 1


def test_kmers_are_counted_in_tasks(spark, monkeypatch):
    from collections import Counter

    rows = [(1, "abcabcab"), (2, "ABCAB\nT"), (2, "abcabé€"), (None, "abcabc"), (None, "xyzabc"), (3, "\0\0\0\0\0"), (4, "é€é€é€"), (5, "ab"), (6, None), (7, "漢字漢字漢字"), (8, "ſtraßeſtraße")]
    upper = lambda t: "".join(c.upper() if "a" <= c <= "z" else c for c in t or "")
    each = [(key, upper(t)[i:i + 3]) for key, t in rows for i in range(len(t or "") - 2)]
    df = spark.createDataFrame(rows, "id long, t string")
    obs, keys = Counter(m for _, m in each), Counter(m for key, m in set(each) if key is not None)
    for windows in (kmers.WINDOWS, 1):
        monkeypatch.setattr(kmers, "WINDOWS", windows)
        assert {r.kmer: r.n for r in kmers.kmer_totals(df, "t", 3).collect()} == obs
        assert {r.kmer: (r.n_obs, r.n_keys) for r in kmers.kmer_support(df, "id", "t", 3).collect()} == {m: (n, keys[m]) for m, n in obs.items()}
    per = {key: Counter(m for x, m in each if x == key) for key, _ in each}
    assert {r.key: (r.n_kmers, r.n_distinct, r.most) for r in kmers.key_support(df, "id", "t", 3).collect()} == {key: (sum(c.values()), len(c), max(c.values())) for key, c in per.items()}
    long = spark.createDataFrame([(1, "abcdefghijkl" * 2)], "id long, t string")
    assert {r.kmer: r.n for r in kmers.kmer_totals(long, "t", 12).collect()}["ABCDEFGHIJKL"] == 2
    # no (kmer, key) is sent where keys have one row
    one = kmers.kmer_support(df.where("id > 2"), "id", "t", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("Aggregate") == 1


def test_a_line_end_is_no_base(spark):
    df = spark.createDataFrame([("AT\n", 1), ("ATA", 2)], "kmer string, n long")
    assert [tuple(r) for r in kmers.canonical_counts(df).collect()] == [("ATA", 2, 0)]


def test_shared_counts_in_blocks(spark, monkeypatch):
    from itertools import combinations

    from loomread.operators import neighbors as N

    rows = [(g * 7, i) for g in range(150) for i in range(40) if (g * 31 + i * i) % 5 == 0 or i == 3] + [(0, 1), (0, 1), (None, 3), (7, None), (14, None)]
    sets = {}
    for g, i in set(rows):
        sets.setdefault(g, set()).add(i)
    want = set()
    for a, b in combinations(sorted(g for g in sets if g is not None), 2):
        n = len(sets[a] & sets[b] - {None})
        if n >= 2:
            want.add((a, b, n, len(sets[a]), len(sets[b])))
    df = spark.createDataFrame(rows, "g long, i long")
    for block in (N.BLOCK, 2):
        monkeypatch.setattr(N, "BLOCK", block)
        got = N.shared_counts(df, "g", "i", 2)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert N.shared_counts(df.limit(0), "g", "i", 2).collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(x" in plan and "hashpartitioning(a" not in plan.split("Aggregate")[-1]  # pairs are counted where they are made


def test_edges_of_components_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b")).mapInArrow(seen, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == {i: i % 3 for i in range(63)} and made.value == 60


def test_pairs_of_blocks_and_bands(spark, monkeypatch):
    from itertools import combinations

    import pyarrow as pa

    from loomread.operators import neighbors as N

    sets = {f"i{i}": [r for r in range(60) if (r * 7 + i * i) % (i + 2) < 2] for i in range(20)} | {"every": list(range(60)), "one": [8]}
    want = {}
    for l in sets.values():
        for p in combinations(l, 2):
            want[p] = want.get(p, 0) + 1
    rows = sorted(((i, r) for i, l in sets.items() for r in l), key=lambda c: (c[0], c[1] * 37 % 60))
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([c[0] for c in part], pa.string()), pa.array([c[1] for c in part], pa.int32())], ["i", "r"])
    for held, of, width, band in ((4_000_000, 1000, 512, 16), (5, 7, 4, 2), (50, 1, 3, 3), (9, 25, 1, 1)):
        monkeypatch.setattr(N, "HELD", held)
        sent = [m for b in N._deal(width, band, 60)(batch(rows[k:k + of]) for k in range(0, len(rows), of)) for m in b.to_pylist()]
        assert all(len([r for r in m["l"] if r // width == m["x"]]) <= width and len(m["l"]) <= width * (band + 1) for m in sent)
        sent = sorted(sent, key=lambda m: (m["x"], m["y"]))
        parts = [pa.RecordBatch.from_pylist(sent[k:k + of], pa.schema([("x", pa.int32()), ("y", pa.int32()), ("l", pa.list_(pa.int32()))])) for k in range(0, len(sent), of)]
        got = [tuple(p.values()) for b in N._count(width, band, 60, 3)(parts) for p in b.to_pylist()]
        assert sorted(got) == sorted((*p, n) for p, n in want.items() if n >= 3)
    assert list(N._deal(4, 2, 60)(iter([batch([])]))) == [] and list(N._count(4, 2, 60, 1)(iter([]))) == []
    df = spark.createDataFrame([(r, i) for i, r in rows], "g long, i string")
    monkeypatch.undo()
    monkeypatch.setattr(N, "BLOCK", 1)
    monkeypatch.setattr(N, "BAND", 3)
    made = N.shared_counts(df, "g", "i", 3)
    assert sorted((r.a, r.b, r.n) for r in made.collect()) == sorted((*p, n) for p, n in want.items() if n >= 3)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()  # no row for a pair before it is counted


def test_percentiles_by_ranges(spark):
    rows = [("a", float(i * i % 37)) for i in range(101)] + [("b", 2.5), ("c", None), (None, 1.0), (None, 2.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = [0.0, 0.05, 0.5, 0.77, 1.0]
    want = {r.k: r.p for r in df.groupBy("k").agg(F.array(*[F.percentile("v", x) for x in shares]).alias("p")).collect()}
    frame = stats.percentiles(df, "k", "v", shares)
    got = {r.k: r.p for r in frame.collect()}
    assert got.keys() == want.keys()
    assert all([x and round(x, 9) for x in got[k]] == [x and round(x, 9) for x in want[k]] for k in got)
    assert "percentile" not in frame._jdf.queryExecution().optimizedPlan().toString()  # whose state is all values of a key


def test_sketch_runs_over_distinct_pairs(spark):
    from loomread.plans.stats import approx_distinct

    plan = approx_distinct(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "distinct l_partkey" not in plan


def test_bridging_pairs_stay_in_their_block(spark):
    from loomread.plans.keys import bridging_test

    df = bridging_test(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_distinct_variants_are_dealt_before_they_are_held(spark):
    from loomread.plans import loci

    plan = loci._variants(spark, "/root/testdata/sf0.001", "A", "R")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "HashAggregate" not in plan[plan.index("REPARTITION_BY_NUM"):]


def test_graph_rounds_send_no_large_side_through_the_driver(spark, monkeypatch):
    from loomread.operators import graphs as G

    plans, stored = [], G.stored
    monkeypatch.setattr(G, "FEW", 0, raising=False)
    monkeypatch.setattr(G, "stored", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, name))
    df = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 3)], "u long, v long")
    root = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.depth for r in G.breadth_first(df, root).collect()} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}
    out = G.strong_components(df)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.node: r.component for r in out.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)
