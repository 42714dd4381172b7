"""Rules, chats, archives, shards, licences and decontamination on edge cases, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomread.llm import chat, decontamination, licenses, rules, sharding, warc
from loomread.storage import scratch

CLEAN = "A plain sentence with enough different words to stand on its own, said once and not said again."


def test_rules_on_edges(spark):
    rep = "one two three four five six " * 4
    rows = [(1, CLEAN), (2, None), (3, ""), (4, rep), (5, "# $ % & | < > * # $ % & " + CLEAN), (6, "line of words here\n" * 9), (1, CLEAN), (7, "w" * 50_000 + " " + CLEAN), (8, "1 2 3 4 5 6 7 8 9 10 11 12")]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, rejected_by string, kept boolean")
    got = rules.quality_cascade(df, report=True).collect()
    kept = defaultdict(list)
    for r in got:
        kept[r.doc_id].append(r.kept)
    assert kept == {1: [True, True], 2: [False], 3: [False], 4: [False], 5: [False], 6: [False], 7: [False], 8: [False]}
    by = {r.doc_id: r for r in got}
    assert by[4].n_repeat_words == 24 and by[6].n_dup_lines == 8 and by[2].n_words == 0 and by[4].base_failed and not by[5].base_failed
    assert by[1].word_chars == sum(map(len, CLEAN.split()))
    assert rules.quality_cascade(df.limit(0), report=True).collect() == []


def test_chat_round_trip(spark):
    odd = ["\\", "### user: </turn>\n", "</turn>", "\\</turn>\\", "####", "", None, "a:b\n\n", "é日" * 50, "\\### Assistant: </turn> ok"]
    rows = [(1, 0, "system", "be kind")] + [(1, k + 1, ("user", "assistant")[k % 2], odd[k % len(odd)]) for k in range(60)] + [(2, 0, "assistant", "x " * 900), (2, 1, "assistant", "y"), (3, 0, None, None), (None, 0, "us:er\n", "t"), (2, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_chats(df, budget=60)
    got = {r.conv_id: r for r in chat.read_chats(windows).collect()}
    for c in (1, 2, 3, None):
        own = sorted(((t or 0, r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = sorted((w for w in windows.collect() if w.conv_id == 1), key=lambda w: w.window)
    assert len(one) > 3 and all(w.formatted.startswith("### system: be kind</turn>") for w in one)
    assert all(w.n_repeated > 1 for w in one[1:]) or any(w.n_repeated == 1 for w in one[1:])
    assert chat.read_chats(chat.format_chats(df.limit(0))).collect() == []


def test_warc_round_trip(spark):
    long = "<p>é\r\n\r\nWARC/1.1\r\n日</p>" * 3000
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, None, None), (4, "u\r\nx", ""), (5, "http://c/", "\r\n\r\n"), (5, "http://c/", "\r\n\r\n"), (6, "http://d/", "x\r\n\r"), (None, "http://e/", "only"), (7, "http://f/", "0\r\n\r\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int").repartition(3)
    path = scratch(spark, "warc-test")
    warc.write_warc(df, path, segment_bytes=1000, chunk_bytes=300)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) and all(r.valid for r in got if r.record_type == "response")
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    for r in got:
        html = next(h or "" for i, _, h in rows if i == r.page_id)
        if r.record_type == "response":
            assert bytes(r.payload).decode() == html and r.payload_digest == warc.base32_sha1(html.encode())
            assert best[html] == (-1 if r.page_id is None else r.page_id)
        else:
            assert [x.page_id for x in got if x.record_id == r.refers_to_record and x.record_type == "response"] == [best[html]]
    assert Counter(r.record_type for r in got) == {"response": len(best), "revisit": len(rows) - len(best)}  # one response of equal rows, too
    assert len({r.record_id for r in got}) == len(rows)
    warc.write_warc(df.limit(0), path + "-none")
    assert warc.read_warc(spark, path + "-none").collect() == []


def test_segments_are_checked(spark, tmp_path):
    payload = b"abc" * 200
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<urn:a>", "WARC-Date": "2024-01-01T00:00:00Z", "Page-ID": 1, "WARC-Payload-Digest": "sha1:" + warc.base32_sha1(payload)}
    whole = warc.segments(fields, warc.HTTP_HEAD + warc.chunked(payload, 90), 100)
    assert len(whole) > 5
    number = lambda k, n: whole[k].replace(b"WARC-Segment-Number: %d" % (k + 1), b"WARC-Segment-Number: %d" % n)
    total = re.sub(rb"Total-Length: (\d+)", lambda m: b"Total-Length: %d" % (int(m[1]) + 1), whole[-1])
    cases = {"good": whole, "any order": whole[::-1], "missing": whole[:2] + whole[3:], "swapped": [whole[0], number(1, 3), number(2, 2), *whole[3:]], "number twice": [whole[0], number(1, 3), *whole[2:]],
             "wrong total": [*whole[:-1], total], "no last": whole[:-1], "no first": whole[1:]}
    for name, records in cases.items():
        home = tmp_path / name.replace(" ", "-")
        home.mkdir()
        (home / "a.warc").write_bytes(b"".join(r + warc.BREAK for r in records))
        got = warc.read_warc(spark, f"file://{home}").collect()
        assert [(r.record_id, r.valid) for r in got] == [("<urn:a>", name in ("good", "any order"))], name
        assert (bytes(got[0].payload) == payload) if got[0].valid else got[0].payload is None


def test_broken_framing_is_not_valid():
    body = warc.chunked(b"abc" * 100, 64)
    assert warc.dechunked(body) == b"abc" * 100 and warc.dechunked(warc.chunked(b"", 5)) == b""
    for cut in (10, len(body) - 3):
        assert warc._finished(1, "response", "r", None, "", warc.HTTP_HEAD + body[:cut], True)[-1] is False


def test_shards_against_a_plain_loop(spark):
    rows = [(k, "same" if k % 3 == 0 else f"text {k}" * (k % 17)) for k in range(400)] + [(5, None), (5, None), (None, "z" * 300)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").repartition(5)
    for part_rows in (50_000, 40):
        got = sharding.contiguous_shards(df, F.octet_length(F.coalesce("text", F.lit(""))) + 8, F.col("text"), F.col("doc_id"), 6, part_rows).collect()
        sizes, slots = Counter(), defaultdict(list)
        for r in got:
            sizes[r.shard] += len((r.text or "").encode()) + 8
            slots[r.shard].append(r.slot)
        assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        most = max(len((t or "").encode()) + 8 for _, t in rows)
        assert max(sizes.values()) - min(sizes[k] for k in range(6)) <= 2 * most
    assert sharding.contiguous_shards(df.limit(0), F.lit(1), F.col("text"), F.col("doc_id")).collect() == []


def test_op10_crc(spark):
    got = sharding.op10_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.size == len(texts[r.doc_id].encode()) + 8 for r in got)


def test_licences(spark):
    rows = [(1, "Released under the MIT License."), (2, "intro words\nLicensed under the Apache License, Version 2.0.\nmore"), (3, None), (4, ""), (5, CLEAN), (2, "RELEASED UNDER THE MIT LICENSE"), (6, "mit"), (7, licenses.TEMPLATES[4][1] + " extra words at the end")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = {(r.doc_id, r.license): r.dice for r in licenses.license_matches(df).collect()}
    assert set(got) == {(1, "MIT"), (2, "Apache-2.0"), (2, "MIT"), (7, "MIT")} and got[1, "MIT"] == 1.0
    assert licenses.license_matches(df, templates=[]).collect() == []


def test_licences_over_lines(spark):
    import textwrap

    code = "\n".join(f"value_{k} = compute({k}, other={k * 3})" for k in range(300))
    by_name = {name: body for name, body in licenses.TEMPLATES}  # the longest of each name comes last

    def comment(name, mark):
        return "\n".join(mark + x for x in textwrap.wrap(by_name[name], 60))

    rows = [(1, "# Copyright 2020 Someone\n#\n" + comment("MIT", "# ") + "\n\n" + code), (2, "/*\n" + comment("ISC", " * ") + "\n */\n" + code), (3, code), (4, comment("GPL-3.0", "// ") + "\n" + code + "\n" + comment("GPL-2.0", "// ")),
            (5, by_name["GPL-3.0"]), (6, by_name["GPL-2.0"]), (7, comment("BSD-3-Clause", "") + "\n" + CLEAN), (8, "word " * 40_000 + "\n" + comment("MIT", "") + "\n" + code)]
    got = defaultdict(set)
    for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert 0.8 <= r.dice <= 1.0
        got[r.doc_id].add(r.license)
    assert got == {1: {"MIT"}, 2: {"ISC"}, 4: {"GPL-3.0", "GPL-2.0"}, 5: {"GPL-3.0"}, 6: {"GPL-2.0"}, 7: {"BSD-3-Clause"}, 8: {"MIT"}}


def test_markers_are_in_every_match():
    known = [licenses.template_bigrams(t) for _, t in licenses.TEMPLATES]
    found = set(licenses.markers(known, 0.8))
    for grams in known:  # bigrams without a marker can't make up a match
        rest = sum(1 for g in grams if not found & set(g.split()))
        assert 2 * rest / (rest + len(grams)) < 0.8


def _words(t):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]


def test_decontamination_against_all_windows(spark):
    base = [f"w{k}" for k in range(40)]
    items = [("b", " ".join(base[:10])), ("a", " ".join(base[5:30])), ("s", "short Item here"), ("n", None), ("e", "..."), ("d", "É über straße"), ("d2", " ".join(base[:10]))]
    docs = [(1, " ".join(base[:10])), (2, " ".join(base[:9])), (3, "x " + " ".join(base[4:31]) + " y"), (4, "a SHORT item, here!"), (5, None), (6, ""), (7, "é über straße"), (8, "É über straße " * 3), (8, "other text"), (None, " ".join(base)), (9, " ".join(base[:10] + base[:10])), (10, "short item")]
    df = spark.createDataFrame([(*r, "q") for r in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = _words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins[tuple(w[k:k + 10])].add(i)
    want = []
    for i, t in docs:
        w, hit, found = _words(t), set(), set()
        for g, who in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k:k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= who
        if hit:
            want.append((i, len(hit), sorted(found)))
    got = decontamination.benchmark_hits(df, bench).collect()
    assert sorted(((r.doc_key.id, r.n_hit, r.items) for r in got), key=repr) == sorted(want, key=repr)
    assert decontamination.benchmark_hits(df, bench, broadcast_rows=0).count() == len(want)
    clean = decontamination.decontaminate(df, bench)
    assert sorted((r.doc_id, r.text) for r in clean.where("doc_id is not null").collect() if r.text is not None) == [(2, docs[1][1]), (6, ""), (7, docs[6][1]), (8, "other text"), (10, "short item")]
    assert decontamination.benchmark_hits(df, bench.limit(0)).collect() == []
