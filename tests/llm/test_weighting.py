import math
from collections import Counter

import pytest

from loomread.llm.weighting import score_texts


def brute(rows, depth):
    """Scores by plain recursion over contexts, bit by bit, from counts of the training rows."""
    from loomread.llm.words import lowered_words

    streams = [(i, b" ".join(lowered_words(t)) + b"\n", h) for i, t, h in rows]
    counts, below = Counter(), {}

    def contexts(s, k):
        return [tuple((b"\0" * depth + s)[k + depth - 1 - j] for j in range(d)) for d in range(depth + 1)]

    for _, s, h in streams:
        if not h:
            for k, x in enumerate(s):
                for j in range(8):
                    node, bit = (256 | x) >> (8 - j), x >> (7 - j) & 1
                    for c in contexts(s, k):
                        counts[c, node, bit] += 1
                        if c:
                            below.setdefault((c[:-1], node), set()).add(c)

    def pe(c, n):
        a, b = counts[c, n, 0], counts[c, n, 1]
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def pw(c, n):
        if (c, n) not in memo:
            own = pe(c, n)
            if len(c) < depth:
                kids = sum(pw(k, n) for k in below.get((c, n), ()))
                m = max(own, kids)
                own = m + math.log(math.exp(own - m) + math.exp(kids - m)) - math.log(2)
            memo[c, n] = own
        return memo[c, n]

    def p(cs, n, bit):
        value = .5
        for c in reversed(cs):
            a, b = counts[c, n, 0], counts[c, n, 1]
            if a + b == 0:
                value = .5
                continue
            est = ((b if bit else a) + .5) / (a + b + 1)
            w = 1 if len(c) == depth else math.exp(pe(c, n) - math.log(2) - pw(c, n))
            value = w * est + (1 - w) * value
        return value

    return {i: sum(math.log10(p(contexts(s, k), (256 | x) >> (8 - j), x >> (7 - j) & 1)) for k, x in enumerate(s) for j in range(8)) for i, s, _ in streams}


def test_against_recursion(spark):
    rows = [(1, "the cat sat on the mat", False), (2, "The  cat\tsat", True), (3, None, False), (4, "", True), (5, "zé日 the", True), (6, "the cat sat on the mat", False), (7, "cat " * 40, False)]
    got = {r.doc_id: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), depth=3).collect()}
    for i, s in brute(rows, 3).items():
        assert got[i].score == pytest.approx(s, rel=1e-5), i
    words = [w for _, t, h in rows if not h for w in [*(t or "").lower().split(), ""]]
    c, n, v = Counter(words), len(words), len(set(words))
    assert got[2].train_tokens == n and got[2].n_tokens == 4 and got[2].n_known == 4 and got[3].n_tokens == 1 and got[5].n_known == 2
    assert got[2].base_score == pytest.approx(sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in ["the", "cat", "sat", ""]))


def test_empty_and_probabilities(spark):
    assert score_texts(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).collect() == []
    rows = [(k, "abra cadabra " * 5, k == 9) for k in range(10)]
    got = score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()
    assert all(0 < r.bits_per_byte < 8 and r.score < 0 for r in got)
