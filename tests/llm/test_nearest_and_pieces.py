"""Near groups and piece encodings against brute force; the pipeline's stages one after another."""

import itertools
import os
import random

import pytest

from loomread.llm import pieces
from loomread.llm.nearest import near_groups
from loomread.llm.words import lowered_words

SF = "/root/testdata/sf0.001"
needs_model = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no model file here")


def brute_groups(rows, k, percent):
    sets = [(i, {tuple(w[j:j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} if w else set()) for i, t in rows for w in [lowered_words(t)]]
    root = {i: i for i, _ in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


@pytest.mark.parametrize("most", [256, 4])
def test_groups_against_all_pairs(spark, most):
    rng = random.Random(2)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100, None), (101, ""), (102, "One two"), (103, "one  TWO"), (104, "one"), (None, rows[0][1]), (105, rows[3][1]), (105, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component string")
    got = near_groups(df, k=3, percent=85, most=most).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups(rows, 3, 85)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    assert near_groups(df.limit(0)).collect() == []


def test_large_regions_lose_no_links(spark):
    """One template, 240 pairs of variants: a pair is just over the threshold, the variants of different pairs are under it."""
    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(400)], []
    for g in range(240):
        own = [f"g{g}" if k % 40 == 0 else w for k, w in enumerate(base)]
        for v in range(2):
            w = list(own)
            for at in rng.sample(range(3, 400, 11), 5):
                w[at] = f"v{g}x{v}x{at}"
            rows.append((len(rows), " ".join(w)))
    want = brute_groups(rows, 3, 85)
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85, most=16).collect()
    assert len({c for _, _, c in want}) > 100
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want


def test_pairs_with_unlucky_signatures_are_linked(spark):
    """Pairs exactly at the threshold of which fewer hashes agree than 0.12 below it."""
    rows = []
    for seed in (3790, 5557, 6447, 8330):
        for v in "xy":
            rows.append((len(rows), " ".join([f"s{seed}c{k}" for k in range(80)] + [f"s{seed}{v}{k}" for k in range(10)])))
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(8)}


def test_repeated_ids_link_what_either_text_links(spark):
    text = lambda g, v="": " ".join(f"g{g}w{k}" if k != 30 else f"g{g}x{v}" for k in range(60))
    rows = [(1, text(1, "a")), (2, text(2, "a")), (5, text(1, "b")), (5, text(2, "b")), (6, text(3)), (7, text(3)), (7, text(4)), (8, text(4)), (9, text(5)), (9, ""), (9, None), (4, text(5)), (10, ""), (None, text(6))]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_groups(rows, 3, 85)
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 5: 1, 6: 6, 7: 6, 8: 6, 9: 4, 4: 4, 10: 10, None: None}


@needs_model
def test_n_best_against_all_paths():
    v = pieces.Vocabulary(pieces.MODEL)

    def paths(s):
        if not s:
            return [(0.0, ())]
        edges = v.edges(s)
        return [(a + score, ids + own) for i, score, own in edges[len(s)] for a, ids in paths(s[:i])]

    for s in (" hello", "tion", "  a", "日é", "\n", " x.y", "▁a"):
        want = sorted((round(a, 6) for a, _ in paths(s)), reverse=True)[:4]
        assert [round(a, 6) for a, _ in v.n_best(s, 4)] == want
        score, gap, n, ids = v.segment([s])
        assert round(score[0], 6) == want[0] and (round(gap[0], 6) == round(want[0] - want[1], 6) if len(want) > 1 else gap[0] == float("inf"))
        assert n[0] == len(ids) and b"".join(v.bytes_of[i] for i in ids).decode() == s


@needs_model
def test_n_best_of_whole_texts_against_all_paths(spark):
    v = pieces.Vocabulary(pieces.MODEL)

    def paths(s):
        if not s:
            return [(0.0, ())]
        edges = v.edges(s)
        return [(a + score, ids + own) for i, score, own in edges[len(s)] for a, ids in paths(s[:i])]

    texts = ["a b", "the cat", "日é a", "x\ny", " ▁a b", "", None, "q", "aa aa", "to be 😀"]
    got = pieces.encode_texts(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), n_best=5).collect()
    for r in got:
        want = sorted(paths(" " + r.text), reverse=True, key=lambda p: p[0])[:5] if r.text else [(0.0, ())]
        assert [round(x, 6) for x in r.scores] == [round(a, 6) for a, _ in want]
        known = {tuple(ids): round(a, 6) for a, ids in (paths(" " + r.text) if r.text else want)}
        assert len({tuple(p.ids) for p in r.n_best}) == len(want) and all(known[tuple(p.ids)] == round(p.score, 6) for p in r.n_best)


@needs_model
def test_segments_side_by_side_and_long_runs():
    v = pieces.Vocabulary(pieces.MODEL)
    rng = random.Random(4)
    tokens = sorted({" " * rng.randrange(3) + "".join(rng.choice("aeinrst日é😀▁.") for _ in range(rng.randrange(1, 30))) for _ in range(500)}, key=len)
    score, gap, n, ids = v.segment(tokens)
    at = 0
    for t, a, g, m in zip(tokens, score, gap, n):
        best = v.n_best(t, 2)
        assert round(best[0][0], 6) == round(a, 6) and (round(best[0][0] - best[1][0], 6) == round(g, 6) if len(best) > 1 else g == float("inf"))
        assert b"".join(v.bytes_of[i] for i in ids[at:at + m]).decode() == t
        at += m
    found = v.n_best("a" * 20_000, 3)  # many ties, no blow-up
    assert [len(found), found[0][0]] == [3, v.segment(["a" * 20_000])[0][0]] and len({ids for _, ids in found}) == 3


@needs_model
def test_encoding_round_trip(spark):
    rows = [(1, "Hello  world.\n\nNew line ▁ mark"), (2, None), (3, ""), (4, " "), (5, "é日本語 \t tab"), (5, "é日本語 \t tab"), (6, "word " * 5000), (7, "\n"), (8, "a\u0000b")]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_pieces int")
    got = pieces.encode_texts(df).collect()
    v = pieces.Vocabulary(pieces.MODEL)
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for r in got:
        assert r.scores == sorted(r.scores, reverse=True) and len(r.scores) <= 3 and len(r.n_best) == len(r.scores)
        for path in r.n_best:
            assert pieces.decode(pieces.np.array(path.ids), v.bytes_of) == (r.text or "")
    assert pieces.encode_texts(df.limit(0)).collect() == []


@needs_model
def test_digests_are_of_all_segmentations(spark, tmp_path):
    """The query and the pipeline's stage have a digest of each of the three best segmentations, put together over whole texts."""
    import hashlib

    import corpus_pipeline as P

    rows = [(1, "the cat sat on the mat " * 60_000), (2, None), (3, ""), (4, "a b"), (5, "é日本語 \t tab\nx"), (6, "q")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want = {r.doc_id: [hashlib.sha256(pieces.np.array(p.ids, "<i4").tobytes()).hexdigest() for p in r.n_best] for r in pieces.encode_texts(df).collect()}
    assert len(want[1]) == 3 and len(set(want[1])) == 3 and len(want[2]) == len(want[3]) == 1
    for got in (pieces.op3_sentencepiece_nbest(spark, str(tmp_path)).collect(), P.sentencepiece(spark, df, str(tmp_path)).collect()):
        assert {r.doc_id: r.n_best_sha256 for r in got} == want
        assert all(r.round_trip and len(r.scores) == len(r.n_best_sha256) and r.ids_sha256 == r.n_best_sha256[0] for r in got)


@needs_model
def test_pipeline_stages(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = P.quality_rules(spark, docs, SF)
    near = P.near_dedup(spark, kept, SF)
    inside = [(r.doc_id, r.text) for r in kept.collect()]
    groups = brute_groups(inside, 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, _, c in groups if i == c)
    cut = P.suffix_dedup(spark, near, SF)
    assert cut.columns == docs.columns and all(len(r.text) <= len(rows[r.doc_id]) and r.n_chars == len(r.text) for r in cut.collect())
    out = P.run(spark, SF).collect()
    assert all(r.round_trip for r in out) and {r.doc_id for r in out} <= {r.doc_id for r in near.collect()}


def test_star_of_a_template_is_one_group(spark):
    """Variants of a template link to it but not to each other; the template has the largest id, so no variant's smaller neighbour is it."""
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(400)], []
    for v in range(500):
        w = list(base)
        for at in rng.sample(range(3, 400, 9), 7):
            w[at] = f"v{v}x{at}"
        rows.append((v, " ".join(w)))
    rows.append((9999, " ".join(base)))
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85, most=32).collect()
    assert {r.component_id for r in got} == {0}


def test_a_very_long_text_is_one_set(spark):
    long = " ".join(f"t{k}" for k in range(120_000))
    rows = [(3, long), (4, long + " more"), (5, "t1 t2 t3")]
    got = near_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=5, percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 119_996, 3), (4, 119_997, 3), (5, 1, 5)]
