"""Entities that share keys: exact overlap, Jaccard, distance, strongest links, MinHash, merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomread.operators.ordinals import ordinals
from loomread.storage import stored, tasks_for

BLOCK = 512         # groups of a block, at most
BAND = 16           # blocks of a band
PAIRS = 16_000_000  # pairs that a task counts, about
HELD = 4_000_000    # numbers or pairs made at once in a task


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each span, n of them, one span after another."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of rows that are equal in all columns begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def _cuts(sizes: np.ndarray) -> list[int]:
    """Bounds of runs of rows whose sizes sum up to about HELD, or of one larger row."""
    at = np.searchsorted(np.cumsum(sizes), np.arange(HELD, sizes.sum(), HELD), "right")
    return np.unique(np.concatenate([[0], at, [len(sizes)]])).tolist()


def _messages(item: np.ndarray, r: np.ndarray, width: int, band: int):
    """Batches of (x, y, l) for whole items, r rising in each: an item's groups of block x, then those after them of band y."""
    block = r // width
    of = block // band
    first, bands = _starts(item, block), _starts(item, of)
    last, ends = np.append(first[1:], len(r)), np.append(bands[1:], len(r))
    own = np.searchsorted(bands, first, "right") - 1
    n = np.searchsorted(item[bands], item[first], "right") - own
    run, to = np.repeat(np.arange(len(first)), n), _spans(own, n)
    more = np.maximum(last[run], bands[to])
    at, size = np.stack([first[run], more], 1), np.stack([(last - first)[run], ends[to] - more], 1)
    paired = size.sum(1) > 1
    at, size, x, y = at[paired], size[paired], block[first][run][paired], of[bands][to][paired]
    cuts = _cuts(size.sum(1))
    for i, j in zip(cuts, cuts[1:]):
        l = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[i:j].sum(1))]), pa.int32()), pa.array(r[_spans(at[i:j].ravel(), size[i:j].ravel())], pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(x[i:j], pa.int32()), pa.array(y[i:j], pa.int32()), l], ["x", "y", "l"])


def _deal(width: int, band: int, groups: int):
    """Messages of rows (item, r) that are sorted by item; an item may go over any number of batches."""
    def whole(rows):
        t = pa.Table.from_batches(rows).combine_chunks()
        i = t.column(0).combine_chunks()
        item = np.concatenate([[0], np.cumsum(pc.not_equal(i[1:], i[:-1]).to_numpy(zero_copy_only=False))])
        yield from _messages(item, np.sort(item * groups + t.column(1).to_numpy()) - item * groups, width, band)

    def run(batches):
        rows = []
        for b in batches:
            if not b.num_rows:
                continue
            if not rows or b.column(0)[-1] == rows[-1].column(0)[-1]:
                rows.append(b)  # its last item may go on, and may be the only one
                continue
            lasts = pc.equal(b.column(0), b.column(0)[-1])
            cut = pc.index(lasts, True).as_py()
            yield from whole([*rows, b.slice(0, cut)])
            rows = [b.slice(cut)]
        if rows:
            yield from whole(rows)

    return run


def _merged(held: list):
    """Sorted (pairs, counts) of several such."""
    pairs, n = (np.concatenate(c) for c in zip(*held))
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = _starts(pairs)
    return pairs[first], np.add.reduceat(n, first)


def _count(width: int, band: int, groups: int, least: int):
    """(a, b, n) of messages sorted by (x, y), where n is ``least`` or more; what is held at once is of one (x, y), or of one batch."""
    def made(x, y, l):
        """Sorted (pairs, counts) of runs of messages; a pair is the number a * groups + b."""
        size = l.value_lengths().to_numpy().astype(np.int64)
        r, row = l.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(size)), size)
        end = np.cumsum(size)
        own = r // width == x[row]
        i = np.flatnonzero(own)
        of = row[i]
        after = (end - size + np.bincount(of, minlength=len(size)))[of]  # past the row's groups of block x
        first = np.where(x[of] // band == y[of], i + 1, after)
        n = end[of] - first
        cuts = _cuts(n)
        for j, k in zip(cuts, cuts[1:]):
            pairs = np.repeat(r[i[j:k]] * groups, n[j:k]) + r[_spans(first[j:k], n[j:k])]
            pairs.sort()
            at = _starts(pairs)
            yield pairs[at], np.diff(np.append(at, len(pairs)))

    def named(pairs, n):
        pairs, n = pairs[n >= least], n[n >= least]
        for i in range(0, len(pairs), 1 << 20):
            a, b = np.divmod(pairs[i:i + (1 << 20)], groups)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(n[i:i + (1 << 20)], pa.int64())], ["a", "b", "n"])

    def run(batches):
        held, size, before, at = [], 0, 0, None
        for m in batches:
            if not m.num_rows:
                continue
            x, y = (m.column(c).to_numpy().astype(np.int64) for c in (0, 1))
            ends, at = at is not None and at != (x[-1], y[-1]) or (x[0], y[0]) != (x[-1], y[-1]), (x[-1], y[-1])
            for some in made(x, y, m.column(2)):
                held.append(some)
                size += len(some[0])
                if size > 2 * before + HELD:
                    held = [_merged(held)]
                    size = before = len(held[0][0])
            if ends and held:  # all before the last (x, y) are complete
                pairs, n = _merged(held)
                a, b = np.divmod(pairs, groups)
                open_ = (a // width == at[0]) & (b // (width * band) == at[1])
                yield from named(pairs[~open_], n[~open_])
                held = [(pairs[open_], n[open_])]
                size = before = len(held[0][0])
        if held:
            yield from named(*_merged(held))

    return run


def shared_counts(members: DataFrame, group: str, item: str, least: int) -> DataFrame:
    """(a, b, n, na, nb) with a < b: groups that share ``least`` items or more; members are made distinct first.

    Groups are numbered in their order and cut into blocks, and blocks into bands. An item sends its groups of each block with those after them of
    each band, as a list of numbers; pairs of a block and a band are made and counted as sorted numbers in one task, and never sent.
    """
    m = stored(members.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct(), "members")
    size = stored(ordinals(m.groupBy("g").agg(F.count("*").alias("n")), ["g"], "r").select("g", "n", F.col("r").cast("int").alias("r")), "groups")
    made = m.where("g is not null and i is not null").groupBy("i").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1.0) / 2)).first()[0] or 0
    groups = size.count()
    width = min(BLOCK, groups // 64 + 1)
    rows = m.where("i is not null").join(size.select("g", "r"), "g").select("i", "r").repartition(tasks_for(m, 1_000_000), "i").sortWithinPartitions("i")
    sent = rows.mapInArrow(_deal(width, BAND, groups), "x int, y int, l array<int>").repartition(min(4096, 32 + int(made // PAIRS)), "x", "y")
    pairs = sent.sortWithinPartitions(F.expr("cast(x as bigint) << 32 | y")).mapInArrow(_count(width, BAND, groups, least), "a int, b int, n long")
    named = lambda own: size.select(F.col("r").alias(own), F.col("g").alias(f"g{own}"), F.col("n").alias(f"n{own}"))
    return pairs.join(named("a"), "a").join(named("b"), "b").select(F.col("ga").alias("a"), F.col("gb").alias("b"), "n", "na", "nb")


def jaccard(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 6).alias("jaccard"))


def overlap_distance(pairs: DataFrame, universe: float, most: float) -> DataFrame:
    """-ln(max(1, n - na nb / universe) (na + nb - n) / (na nb)), where it is below ``most``."""
    d = -F.log(F.greatest(F.lit(1.0), F.col("n") - F.col("na") * F.col("nb") / universe) * (F.col("na") + F.col("nb") - F.col("n")) / (F.col("na") * F.col("nb")))
    return pairs.select("a", "b", F.round(d, 6).alias("distance")).where(F.col("distance") < most)


def top_links(pairs: DataFrame, k: int) -> DataFrame:
    """(node, other, n, rank): each node's k strongest partners, ties by partner."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "n").unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "n"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.col("n").desc(), "other"))).where(F.col("rank") <= k)


def within_share_of_best(pairs: DataFrame, share: float) -> DataFrame:
    """(node, other, n): partners with at least ``share`` of the node's best count."""
    both = pairs.select(F.col("a").alias("node"), F.col("b").alias("other"), "n").unionAll(pairs.select(F.col("b").alias("node"), F.col("a").alias("other"), "n"))
    return both.withColumn("best", F.max("n").over(Window.partitionBy("node"))).where(F.col("n") >= share * F.col("best")).select("node", "other", "n")


def minhash(members: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """(group, h0 ... h{n-1}): least md5 of each item under n seeds; each value is hashed on its own."""
    return members.groupBy(group).agg(*[F.min(F.md5(F.concat(F.lit(f"{k}/"), F.col(item).cast("string")))).alias(f"h{k}") for k in range(n)])


def minhash_matches(members: DataFrame, group: str, item: str, n: int, least: float) -> DataFrame:
    """(a, b, n) with a < b: groups of which more than ``least`` of ``n`` seeded minima agree.

    Minima are joined by (seed, value); groups with equal signatures meet as one and are told apart at the end, so that
    copies of a set are not multiplied in the join.
    """
    signs = minhash(members, group, item, n)
    signs = signs.select(F.col(group).alias("g"), F.array(*[f"h{k}" for k in range(n)]).alias("sig"))
    classes = signs.groupBy("sig").agg(F.min("g").alias("c"))
    rows = classes.select("c", F.posexplode("sig").alias("k", "h"))
    met = rows.join(rows.select(F.col("c").alias("d"), "k", "h"), ["k", "h"]).where("c <= d").groupBy("c", "d").agg(F.count("*").alias("n")).where(F.col("n") > least * n)
    named = signs.join(classes, "sig").select("g", "c")
    both = met.join(named.select("c", F.col("g").alias("x")), "c").join(named.select(F.col("c").alias("d"), F.col("g").alias("y")), "d")
    return both.where("c <> d or x < y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")
