import hashlib
import random

import numpy as np
import pytest

from loomread.llm.suffixes import anchors, least_owner, remove_repeats, suffix_array

SF = "/root/testdata/sf0.001"


def brute(rows, length=50):
    """{index: (n_bytes, n_removed, n_spans, sha)} by a dictionary of all windows."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            w = b[k:k + length]
            key = float("inf") if i is None else i
            first[w] = min(first.get(w, key), key)
    out = []
    for i, t in rows:
        b, key = (t or "").encode(), float("inf") if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < key:
                gone[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_array_sorts():
    rng = random.Random(1)
    for alphabet in (2, 3, 20):
        strings = [bytes(rng.randrange(1, alphabet + 1) for _ in range(rng.randrange(1, 60))) for _ in range(20)] + [b"\1" * 40]
        s = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        got = suffix_array(s, 64)
        assert sorted(got.tolist()) == list(range(len(s)))
        text = s.tobytes()
        keys = [text[i:text.index(b"\0", i)] for i in got]
        assert keys == sorted(keys)


def test_least_owner():
    a, b = b"x" * 3 + b"abcdefghij" * 6, b"abcdefghij" * 6 + b"y" * 4
    own = least_owner([a, b], np.array([5, 2]), 50)
    assert own[1].tolist() == [2] * (len(b) - 49)
    assert own[0].tolist() == [5] * 3 + [2] * (len(a) - 49 - 3)
    dealt = least_owner([a, b], np.array([5, 2]), 50, most=60)
    assert [x.tolist() for x in dealt] == [x.tolist() for x in own]


def test_anchors_cover_each_window_once():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([10, 700, 700, 5000])
    first, last, text, _ = anchors(data, ends, 50, part=256)
    have = sorted(w for a, b in zip(first, last) for w in range(a, b + 1))
    assert have == [i for i in range(5000) if i + 50 <= ends[np.searchsorted(ends, i, "right")]]


@pytest.mark.parametrize("ids", ["plain", "odd"])
def test_against_all_windows(spark, ids):
    if ids == "plain":
        rows = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    else:
        rng = random.Random(5)
        base = ["".join(rng.choice("abcdeé日 ") for _ in range(rng.randrange(30, 400))) for _ in range(12)]
        rows = [(k, "".join(rng.choice(base)[rng.randrange(20):] for _ in range(3))) for k in range(40)]
        rows += [(3, rows[3][1]), (7, rows[9][1]), (None, rows[0][1]), (None, rows[0][1] + "tail"), (50, None), (51, ""), (52, "a" * 3000), (53, "a" * 2000), (54, rows[1][1]), (55, rows[1][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(df, with_text=False).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute(rows)


def test_text_stays_utf8_and_columns_stay(spark):
    shared = "é" * 40
    rows = [(1, shared + "a", "x", 5), (2, "b" + shared[:30] + "ç", None, None), (3, None, "z", 1)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_spans long")).collect()}
    assert got[2].text == "bç" and got[2].n_spans == 1 and got[1].n_removed == 0 and got[3].text is None and got[3].lang == "z"
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
