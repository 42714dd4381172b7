"""k-mer tables: occurrences, support by groups, spectra, adjacency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.functions.sequences import ascii_upper, canonical, is_flipped
from loomread.operators.ordinals import ordinals
from loomread.storage import stored

WINDOWS = 1 << 23  # k-mers that a task counts at once


def kmer_rows(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, kmer): every k-character substring of the upper-cased text, with repeats.

    Characters are taken as four bytes each, so that a substring is found at once, however long the text, in generated code; a mark of the byte order goes before them, which decoding takes off.
    """
    wide = F.encode(ascii_upper(F.coalesce(F.col(text), F.lit(""))), "UTF-32")
    at = df.select(F.col(key).alias("key"), wide.alias("u")).where(F.octet_length("u") >= 4 * k)
    at = at.select("key", "u", F.explode(F.sequence(F.lit(0), F.expr(f"octet_length(u) div 4 - {k}").cast("int"))).alias("i"))
    return at.select("key", F.decode(F.expr(f"concat(X'0000FEFF', substring(u, 4 * i + 1, {4 * k}))"), "UTF-32").alias("kmer"))


def _wide(text: str):
    """Characters of four bytes each, most significant byte first."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-32")


def _upper(wide: bytes) -> np.ndarray:
    codes = np.frombuffer(wide, ">u4").astype(np.uint32)
    codes[(codes >= 97) & (codes <= 122)] -= 32
    return codes


def _packed(codes: np.ndarray, k: int):
    """(k-mers of ASCII as numbers of 7 bits a character, starts of the other k-mers); all are others if 64 bits don't hold k characters."""
    n = len(codes) - k + 1
    if k > 9:
        return np.zeros(0, np.uint64), np.arange(n)
    number = np.zeros(n, np.uint64)
    for j in range(k):
        number = number << np.uint64(7) | codes[j:j + n]
    foreign = np.concatenate([[0], np.cumsum(codes > 127)])
    foreign = foreign[k:] > foreign[:n]
    return (number[~foreign], np.flatnonzero(foreign)) if foreign.any() else (number, np.zeros(0, np.int64))


def _runs(ordered: np.ndarray):
    """(distinct values, their counts) of a sorted array."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def _distinct(windows: np.ndarray):
    """(distinct rows, number of the row of each) of k-mers as rows of characters: grouped by a hash, compared with one of the group."""
    h = np.zeros(len(windows), np.uint64)
    for j in range(windows.shape[1]):
        h = (h ^ windows[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    _, at, group = np.unique(h, return_index=True, return_inverse=True)
    if (windows != windows[at[group]]).any():  # two k-mers with one hash
        return np.unique(windows, axis=0, return_inverse=True)
    return windows[at], group


def _names(numbers: np.ndarray, k: int) -> pa.Array:
    """Strings of packed k-mers."""
    letters = np.empty((len(numbers), k), np.uint8)
    for j in range(k):
        letters[:, j] = (numbers >> np.uint64(7 * (k - 1 - j))) & np.uint64(127)
    offsets = np.arange(0, (len(numbers) + 1) * k, k, dtype=np.int32)
    return pa.StringArray.from_buffers(len(numbers), pa.py_buffer(offsets), pa.py_buffer(letters))


def _spelled(windows: np.ndarray) -> pa.Array:
    k = windows.shape[1]
    whole = np.ascontiguousarray(windows, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([whole[i:i + k] for i in range(0, len(whole), k)], pa.string())


def _counter(k: int):
    """Counts of runs of rows (text, counted) as batches of (kmer, n_obs, n_keys); a row is a key of its own where it is counted."""
    def batch(names, n_obs, n_keys):
        return pa.RecordBatch.from_arrays([names, pa.array(n_obs, pa.int64()), pa.array(n_keys, pa.int64())], ["kmer", "n_obs", "n_keys"])

    def totals(every, own, odd, rows):
        every, own = np.concatenate(every), np.concatenate(own)
        every.sort()
        own.sort()
        numbers, n_obs = _runs(every)
        known, n = _runs(own)
        n_keys = np.zeros(len(numbers), np.int64)
        n_keys[np.searchsorted(numbers, known)] = n
        for i in range(0, len(numbers), 1 << 20):
            few = slice(i, i + (1 << 20))
            yield batch(_names(numbers[few], k), n_obs[few], n_keys[few])
        if odd:
            windows, row = np.concatenate(odd), np.repeat(rows, [len(o) for o in odd])
            kinds, group = _distinct(windows)
            group = group.reshape(-1)
            held = np.unique(group[row >= 0].astype(np.int64) * (int(row.max()) + 2) + row[row >= 0])
            n_keys = np.bincount(held // (int(row.max()) + 2), minlength=len(kinds))
            yield batch(_spelled(kinds), np.bincount(group, minlength=len(kinds)), n_keys)

    def run(batches):
        every, own, odd, rows, held, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [], [], 0, 0
        for b in batches:
            for wide, counted in zip(b.column(0), b.column(1).to_pylist()):
                codes = _upper(wide.as_buffer())
                if len(codes) < k:
                    continue
                numbers, others = _packed(codes, k)
                every.append(numbers)
                if counted:
                    own.append(_runs(np.sort(numbers))[0])
                if len(others):
                    odd.append(codes[others[:, None] + np.arange(k)])
                    rows.append(row if counted else -1)
                held, row = held + len(codes) - k + 1 + 3 * len(others), row + 1  # rows of characters are larger than numbers
                if held >= WINDOWS:
                    yield from totals(every, own, odd, rows)
                    every, own, odd, rows, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [], [], 0
        yield from totals(every, own, odd, rows)

    return run


def kmer_totals(df: DataFrame, text: str, k: int) -> DataFrame:
    """(kmer, n): how often each k-mer of the upper-cased texts occurs. Tasks count runs of texts as sorted numbers, so only their distinct k-mers are sent."""
    part = df.select(_wide(text).alias("u"), F.lit(False).alias("counted")).mapInArrow(_counter(k), "kmer string, n_obs long, n_keys long")
    return part.groupBy("kmer").agg(F.sum("n_obs").alias("n"))


def _repeated(df: DataFrame, key: str):
    """The keys of more than one row, or None where there are none."""
    more = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    return None if more.isEmpty() else more


def kmer_support(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(kmer, n_obs, n_keys): occurrences of each k-mer and the different keys that hold it; a null key is none.

    A row with a key of its own is made distinct in its task; (kmer, key) is grouped for keys of several rows only.
    """
    more = _repeated(df, key)
    one = df if more is None else df.join(more, key, "left_anti")
    part = one.select(_wide(text).alias("u"), F.col(key).isNotNull().alias("counted")).mapInArrow(_counter(k), "kmer string, n_obs long, n_keys long")
    if more is not None:
        each = kmer_rows(df.join(more, key, "left_semi"), key, text, k).groupBy("kmer", "key").agg(F.count("*").alias("n"))
        part = part.unionAll(each.select("kmer", F.col("n").alias("n_obs"), F.lit(1).cast("long").alias("n_keys")))
    return part.groupBy("kmer").agg(F.sum("n_obs").alias("n_obs"), F.sum("n_keys").alias("n_keys"))


def key_support(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(key, n_kmers, n_distinct, most): of each key with a k-mer, its k-mers, the different ones and the count of the most frequent one.

    Rows are counted in their tasks; (kmer, key) is grouped only for null and for keys of several rows.
    """
    more = _repeated(df, key)
    one = df.where(F.col(key).isNotNull())
    one = one if more is None else one.join(more, key, "left_anti")

    def run(batches):
        for b in batches:
            at, out = [], []
            for i, wide in enumerate(b.column(1)):
                codes = _upper(wide.as_buffer())
                if len(codes) < k:
                    continue
                numbers, others = _packed(codes, k)
                n = _runs(np.sort(numbers))[1]
                if len(others):
                    n = np.append(n, np.bincount(_distinct(codes[others[:, None] + np.arange(k)])[1].reshape(-1)))
                at.append(i)
                out.append((int(n.sum()), len(n), int(n.max())))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], ["key", "n_kmers", "n_distinct", "most"])

    of = df.schema[key].dataType.simpleString()
    r = one.select(F.col(key).alias("key"), _wide(text).alias("u")).mapInArrow(run, f"key {of}, n_kmers long, n_distinct long, most long")
    rest = df.where(F.col(key).isNull())
    rest = rest if more is None else rest.unionAll(df.join(more, key, "left_semi").select(df.columns))
    each = kmer_rows(rest, key, text, k).groupBy("kmer", "key").agg(F.count("*").alias("n"))
    return r.unionAll(each.groupBy("key").agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_distinct"), F.max("n").alias("most")))


def supported_kmers(support: DataFrame, min_obs: int = 3, min_keys: int = 2) -> DataFrame:
    """(kmer, n_obs, n_keys) of k-mers seen min_obs times or more, under min_keys different keys, of a kmer_support()."""
    return support.where((F.col("n_obs") >= min_obs) & (F.col("n_keys") >= min_keys))


def spectrum(totals: DataFrame) -> DataFrame:
    """(multiplicity, n_kmers): how many distinct k-mers occur so often."""
    return totals.groupBy(F.col("n").alias("multiplicity")).agg(F.count("*").alias("n_kmers"))


def canonical_counts(totals: DataFrame) -> DataFrame:
    """(kmer, n, n_flipped): counts by canonical form of k-mers of ACGT."""
    acgt = totals.where(F.col("kmer").rlike(r"\A[ACGT]+\z"))  # $ would let a line end follow
    return acgt.select(canonical(F.col("kmer")).alias("kmer"), "n", is_flipped(F.col("kmer")).alias("f")).groupBy("kmer").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("f"), F.col("n")).otherwise(0)).alias("n_flipped"))


def extensions(totals: DataFrame) -> DataFrame:
    """(kmer, n, left, right): distinct characters before and after each inner run of (k+2)-mers, sorted and joined."""
    k = F.length("kmer") - 2
    parts = totals.select(F.expr("substring(kmer, 2, length(kmer) - 2)").alias("kmer"), F.substring("kmer", 1, 1).alias("l"), F.expr("substring(kmer, length(kmer), 1)").alias("r"), "n").where(k > 0)
    return parts.groupBy("kmer").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("l")), "").alias("left"), F.array_join(F.array_sort(F.collect_set("r")), "").alias("right"))


def best_middle(totals: DataFrame, seen: int = 3) -> DataFrame:
    """(kmer, n, best, best_n): the most frequent k-mer that differs at most in the middle; itself where counted ``seen`` times.

    Ties go to the lesser k-mer.
    """
    counts = stored(totals, "kmers")  # read twice
    flanks = counts.withColumn("flank", F.concat(F.expr("left(kmer, int(floor(length(kmer) / 2)))"), F.lit("\u0001"), F.expr("substring(kmer, int(floor(length(kmer) / 2)) + 2)")))
    best = flanks.groupBy("flank").agg(F.max_by(F.struct("kmer", "n"), F.struct("n", F.transform(F.split("kmer", ""), lambda c: -F.ascii(c)))).alias("b"))
    joined = flanks.join(best, "flank")
    keep = F.col("n") >= seen
    return joined.select("kmer", "n", F.when(keep, F.col("kmer")).otherwise(F.col("b.kmer")).alias("best"), F.when(keep, F.col("n")).otherwise(F.col("b.n")).alias("best_n"))


def partition_by_minimizer(totals: DataFrame, p: int) -> DataFrame:
    """(minimizer, n_kmers, n_distinct): k-mers by their least p-character substring by md5, which shards them."""
    ps = F.transform(F.sequence(F.lit(1), F.length("kmer") - p + 1), lambda i: F.substring("kmer", i, p))
    least = F.array_min(F.transform(ps, lambda x: F.struct(F.md5(x).alias("h"), x.alias("x"))))
    return totals.select(least["x"].alias("minimizer"), "n").groupBy("minimizer").agg(F.sum("n").alias("n_kmers"), F.count("*").alias("n_distinct"))


def inverse_frequency_rank(totals: DataFrame) -> DataFrame:
    """(kmer, n, rank): k-mers by rising count, the rarest first from 0."""
    return ordinals(totals, ["n", "kmer"], "rank")
