"""Language-model scores by context-tree weighting over bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.llm.blocks import blocked, total_bytes, unpack, with_answers
from loomread.llm.words import lowered_words
from loomread.storage import stored

END = b""  # the end token; no word is empty
DEAL_BYTES, LEAST_DEALS, MOST_DEALS = 8 << 20, 64, 8192  # text for a deal of strings and words, and the number of deals


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x > 0: shifted to 8 and above, then Stirling's series."""
    x = np.asarray(x, float)
    low = x < 8
    off = np.zeros_like(x)
    y = x[low]
    prod = np.ones_like(y)
    for _ in range(8):
        step = y < 8
        prod = np.where(step, prod * y, prod)
        y = np.where(step, y + 1, y)
    off[low] = np.log(prod)
    z = x.copy()
    z[low] = y
    i = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + i / 12 - i**3 / 360 + i**5 / 1260 - off


def kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


class Level:
    """Nodes of one depth and one bit: sorted ids (context << 8 | bits so far with a leading 1), counts and ln P_w."""

    def __init__(self, ids, n0, n1, below):
        self.ids, self.n0, self.n1 = ids, n0, n1
        own = kt(n0, n1)
        self.weighted = own if below is None else np.logaddexp(own, below) - np.log(2)
        self.share = np.ones(len(ids)) if below is None else np.exp(own - np.log(2) - self.weighted)  # of the node's own estimate

    def mixed(self, ids: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """The probability of ``bit``: own estimate and that of deeper contexts, as weighted here; 1/2 where nothing was counted."""
        at = np.minimum(np.searchsorted(self.ids, ids), max(len(self.ids) - 1, 0))
        if not len(self.ids):
            return np.full(len(ids), 0.5)
        known = self.ids[at] == ids
        est = (np.where(bit, self.n1[at], self.n0[at]) + 0.5) / (self.n0[at] + self.n1[at] + 1)
        return np.where(known, self.share[at] * est + (1 - self.share[at]) * deeper, 0.5)


def leaf_level(keys: np.ndarray, counts: np.ndarray, bit: int) -> Level:
    """Counts of one bit at full depth from sorted distinct keys (context << 8 | byte)."""
    byte = keys & np.uint64(255)
    ids = keys & ~np.uint64(255) | (byte | np.uint64(256)) >> np.uint64(8 - bit)
    one = (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1
    head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
    n1 = np.add.reduceat(np.where(one, counts, 0.0), head) if len(ids) else np.zeros(0)
    n0 = np.add.reduceat(np.where(one, 0.0, counts), head) if len(ids) else np.zeros(0)
    some = n0 + n1 > 0
    return Level(ids[head][some], n0[some], n1[some], None)


def parents(level: Level) -> Level:
    """The level one context byte shorter."""
    up = level.ids >> np.uint64(16) << np.uint64(8) | level.ids & np.uint64(255)
    ids, to = np.unique(up, return_inverse=True)
    n = len(ids)
    return Level(ids, np.bincount(to, level.n0, n), np.bincount(to, level.n1, n), np.bincount(to, level.weighted, n))


def code_lengths(keys: np.ndarray, counts: np.ndarray, depth: int, top: dict | None, keep: int = 2):
    """Bits that each key's byte takes in its context; without ``top`` the level at depth ``keep`` of each bit instead.

    ``keys`` hold whole subtrees below ``keep`` context bytes; ``top`` has the levels above, by (depth, bit).
    """
    bits, found = np.zeros(len(keys)), []
    byte = keys & np.uint64(255)
    for bit in range(8):
        levels = [leaf_level(keys, counts, bit)]
        for _ in range(depth - keep):
            levels.append(parents(levels[-1]))
        if top is None:
            found.append(levels[-1])
            continue
        node, value, p = (byte | np.uint64(256)) >> np.uint64(8 - bit), (byte >> np.uint64(7 - bit)) & np.uint64(1) == 1, np.full(len(keys), 0.5)
        for d, level in zip(range(depth, -1, -1), [*levels, *(top[d, bit] for d in range(keep - 1, -1, -1))]):
            p = level.mixed((keys >> np.uint64(8 * (depth - d)) & ~np.uint64(255)) | node, value, p)
        bits -= np.log2(p)
    return found if top is None else bits


def top_levels(rows: list[tuple], keep: int = 2) -> dict:
    """Levels above ``keep`` bytes from (bit, id at depth keep - 1, n0, n1, summed ln P_w of its children)."""
    out = {}
    for bit in range(8):
        own = sorted(x[1:] for x in rows if x[0] == bit)
        ids = np.array([x[0] for x in own], np.uint64)
        level = Level(ids, *(np.array([x[k] for x in own], float) for k in (1, 2, 3)))
        for d in range(keep - 1, -1, -1):
            out[d, bit] = level
            level = parents(level)
    return out


def stream(words: list[bytes]) -> bytes:
    """What is scored of a text: its words with a space between, then a line end."""
    return b" ".join(words) + b"\n"


def grams(streams: list[bytes], depth: int, part: int = 1 << 18) -> np.ndarray:
    """For each byte of each stream: the depth bytes before it, latest first (0 before the start), and the byte; depth up to 7."""
    data = np.frombuffer(b"".join(b"\0" * 7 + s for s in streams), np.uint8)
    n = len(data) - 7
    if n < 1:
        return np.zeros(0, np.uint64)
    words = np.ndarray(n, "<u8", data.data, strides=(1,))  # ends with the byte itself, which is the highest
    key = np.empty(n, np.uint64)
    for i in range(0, n, part):
        w = words[i:i + part]
        key[i:i + part] = (w << np.uint64(8)) >> np.uint64(64 - 8 * depth) << np.uint64(8) | w >> np.uint64(56)
    sizes = np.array([len(s) + 7 for s in streams])
    real = np.ones(n + 7, bool)
    real[(np.cumsum(sizes) - sizes)[:, None] + np.arange(7)] = False
    return key[real[7:]]


class Table:
    """Places of distinct 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(4, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)
        self.by_slot = np.where(self.slots < 0, np.uint64(1 << 63), keys[self.slots])  # no key has the highest bit

    def _slot(self, keys):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def laid(self, values: np.ndarray) -> np.ndarray:
        """Values of the keys in the order of the slots."""
        return values[self.slots]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; all are there."""
        slot = self._slot(keys)
        wrong = np.flatnonzero(self.by_slot[slot] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            wrong = wrong[self.by_slot[slot[wrong]] != keys[wrong]]
        return slot


def _packed(a: np.ndarray) -> bytes:
    """The array with all first bytes first, compressed."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def _unpacked(b: bytes, kind) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed_steps(a: np.ndarray) -> bytes:
    """A rising array, as its steps."""
    return _packed(np.diff(a, prepend=a.dtype.type(0)))


def _unpacked_steps(b: bytes, kind) -> np.ndarray:
    return np.cumsum(_unpacked(b, kind), dtype=kind)


def _deal(keys: np.ndarray, depth: int, deals: int) -> np.ndarray:
    """Which deal has the key: by its two latest context bytes, so that a deal has whole subtrees below them."""
    pair = (keys >> np.uint64(8 * (depth - 1))) & np.uint64(0xFFFF)
    return ((pair * np.uint64(40503) & np.uint64(0xFFFF)) * np.uint64(deals) >> np.uint64(16)).astype(np.int32)


def _dealt_words(words, deals: int) -> tuple[list[bytes], np.ndarray]:
    """The words by deal and in order, and where each deal begins."""
    import zlib

    words = sorted(words)
    deal = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % deals
    by = np.argsort(deal, kind="stable")
    return [words[i] for i in by.tolist()], np.searchsorted(deal[by], np.arange(deals + 1))


def _block(payload, text_col, held_col):
    table = unpack(payload)
    words = [lowered_words(t) for t in table.column(text_col).to_pylist()]
    return table, words, [stream(w) for w in words], [bool(h) for h in table.column(held_col).to_pylist()]


def _distinct(streams, held, depth, deals):
    """Distinct grams of a block in the order of _deal() and key, with their counts in streams that are not held out."""
    key = grams(streams, depth)
    key <<= np.uint64(1)
    key |= np.repeat(np.array([not h for h in held], np.uint64), [len(s) for s in streams])  # the lowest bit: it counts
    key.sort()
    train = np.cumsum(key & np.uint64(1), dtype=np.int64)
    key >>= np.uint64(1)
    last = np.flatnonzero(np.append(key[1:] != key[:-1], len(key) > 0))
    u, n = key[last], np.diff(train[last], prepend=0).astype(np.uint32)
    deal = _deal(u, depth, deals)
    by = np.argsort(deal, kind="stable")
    return u[by], n[by], deal[by]


def _settled(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts, sorted, and the sums of their counts."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str = "held_out", depth: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of each text.

    The model learns from all rows that are not held out. Scored is the stream of the text's words (A-Z lowered) with a
    space between and a line end after, byte by byte: a byte is eight binary decisions, and each decision's probability
    mixes the Krichevsky-Trofimov estimates of the contexts of 0 to ``depth`` bytes, weighted as context-tree weighting
    does for the counts of the whole training corpus. score is log10 of the product, base_score that of the smoothed
    unigram model of words and text ends.

    Counts cover the whole corpus and are never gathered in one place: blocks send their distinct byte strings and
    words, compressed, once; strings are dealt by their two latest context bytes, words by a hash. There are as many
    deals as the data need (up to MOST_DEALS), so a task holds what blocks sent of one deal. It merges the strings to the
    counts of the deal, and keeps where each block's are among them; so a block learns its code
    lengths and counts without sending strings again. Only the levels of up to one context byte, at most 65,536
    nodes, pass through the driver.
    Null and empty texts are one end token; null held_out counts as training; a null doc_id stays null; repeated rows
    count each time; a long text is a block of its own; an empty table gives an empty result. Other columns are not
    read, so clashing names do no harm.
    """
    spark = docs.sparkSession
    blocks = blocked(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(held_col).cast("boolean").alias("held")))
    deals = min(MOST_DEALS, max(LEAST_DEALS, -(-total_bytes(blocks) // DEAL_BYTES)))

    def ask(batches):
        from collections import Counter

        import pyarrow as pa
        import zstandard

        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, words, streams, held = _block(payload, "text", "held")
                count, other = Counter(), {END}
                for w, h in zip(words, held):
                    if h:
                        other.update(w)
                    else:
                        count.update(w)
                        count[END] += 1
                mine, at = _dealt_words(other.union(count), deals)
                n_words = np.fromiter(map(count.__getitem__, mine), np.int64, len(mine))
                keys, n, deal = _distinct(streams, held, depth, deals)
                cut = np.searchsorted(deal, np.arange(deals + 1))
                rows = [(r, block, _packed_steps(keys[a:c]), _packed(n[a:c]), zstandard.compress(b"\n".join(mine[v:w]), 3), _packed(n_words[v:w]))
                        for r, (a, c, v, w) in enumerate(zip(cut, cut[1:], at, at[1:])) if c > a or w > v]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64()] + [pa.binary()] * 4)], ["r", "block", "keys", "counts", "words", "n_words"])

    def merge(batches):
        from collections import Counter

        import pyarrow as pa
        import zstandard

        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]

        def row(r, sent):
            parts, fresh = [], 0
            for _, k, c, _, _ in sent:
                parts.append((_unpacked_steps(k, np.uint64), _unpacked(c, np.uint32).astype(np.int64)))
                fresh += len(parts[-1][0])
                if fresh > max(1 << 20, len(parts[0][0])):
                    parts, fresh = [_settled(parts)], 0
            keys, counts = _settled(parts)
            places = [_packed_steps(np.searchsorted(keys, _unpacked_steps(k, np.uint64)).astype(np.uint32)) for _, k, _, _, _ in sent]
            cut = lambda w: zstandard.decompress(w).split(b"\n")
            total = Counter()
            for _, _, _, w, n in sent:
                for x, m in zip(cut(w), _unpacked(n, np.int64).tolist()):
                    total[x] += m
            told = [_packed(np.fromiter(map(total.__getitem__, cut(w)[:len(m)]), np.int64, len(m))) for _, _, _, w, n in sent for m in [_unpacked(n, np.int64)]]
            values = [r, _packed_steps(keys), _packed(counts), sum(total.values()), sum(1 for v in total.values() if v), [x[0] for x in sent], places, told]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["r", "keys", "counts", "train", "kinds", "blocks", "places", "totals"])

        now, sent = None, []
        for b in batches:
            for r, *x in zip(*(b.column(i).to_pylist() for i in range(6))):
                if r != now and sent:
                    yield row(now, sent)
                    sent = []
                now = r
                sent.append(x)
        if sent:
            yield row(now, sent)

    def summit(batches):
        import pyarrow as pa

        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows = []
                for bit, level in enumerate(code_lengths(_unpacked_steps(k, np.uint64), _unpacked(c, np.int64).astype(float), depth, None)):
                    up = level.ids >> np.uint64(16) << np.uint64(8) | level.ids & np.uint64(255)
                    rows += zip([bit] * len(up), up.astype(np.int64).tolist(), level.n0.tolist(), level.n1.tolist(), level.weighted.tolist())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64()])], ["bit", "id", "n0", "n1", "below"])

    asked = blocks.select("block", "payload").mapInArrow(ask, "r int, block long, keys binary, counts binary, words binary, n_words binary")
    model = stored(asked.repartition(deals, "r").sortWithinPartitions("r", "block").mapInArrow(
        merge, "r int, keys binary, counts binary, train long, kinds long, blocks array<long>, places array<binary>, totals array<binary>"), "context-model")
    top = model.select("keys", "counts").mapInArrow(summit, "bit int, id long, n0 double, n1 double, below double").groupBy("bit", "id").agg(F.sum("n0"), F.sum("n1"), F.sum("below"))
    top = spark.sparkContext.broadcast(top_levels([tuple(r) for r in top.collect()]))  # 8 bits x 256 contexts x up to 128 nodes
    train, kinds = model.agg(F.coalesce(F.sum("train"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    def answer(batches):
        import pyarrow as pa

        for b in batches:
            for r, k, c, to, places, totals in zip(*(b.column(i).to_pylist() for i in range(6))):
                bits = code_lengths(_unpacked_steps(k, np.uint64), _unpacked(c, np.int64).astype(float), depth, top.value).astype(np.float32)
                mine = [_packed(bits[_unpacked_steps(p, np.uint32)]) for p in places]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array([r] * len(to), pa.int32()), pa.array(mine, pa.binary()), pa.array(totals, pa.binary())], ["block", "r", "bits", "totals"])

    told = model.select("r", "keys", "counts", "blocks", "places", "totals").mapInArrow(answer, "block long, r int, bits binary, totals binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"

    def score(key, texts, told):
        import pyarrow as pa

        told = told.sort_by("r")
        total = np.concatenate([_unpacked(x, np.int64) for x in told.column("totals").to_pylist()] or [np.zeros(0, np.int64)])
        bits = np.concatenate([_unpacked(x, np.float32) for x in told.column("bits").to_pylist()] or [np.zeros(0, np.float32)]).astype(float)
        term, known = np.log10((total + 0.5) / (train + 0.5 * (kinds + 1))), total > 0
        out = []
        for payload in texts.column("payload").to_pylist():
            table, words, streams, held = _block(payload, "text", "held")
            mine, _ = _dealt_words({END}.union(*words), deals)
            place = {w: i for i, w in enumerate(mine)}
            keys, _, _ = _distinct(streams, held, depth, deals)
            find = Table(keys)
            laid, part = find.laid(bits), []
            for i in range(0, len(streams), 256):  # some texts at a time
                few = streams[i:i + 256]
                each = laid[find.find(grams(few, depth))]
                part.append(np.add.reduceat(each, np.cumsum([0, *map(len, few[:-1])])))
            code = np.concatenate(part)
            for d, w, s, h, c in zip(table.column("doc_id").to_pylist(), words, streams, held, code.tolist()):
                at = np.fromiter(map(place.__getitem__, [*w, END]), np.int64, len(w) + 1)
                out.append((d, h, len(at), int(known[at].sum()), train, float(term[at].sum()), -c * np.log10(2), len(s), c / len(s)))
        kinds_ = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds_)], [f.split()[0] for f in schema.split(", ")])

    return with_answers(blocks, told, score, schema)


def op1_context_weighting(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs.withColumn("held_out", F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 1))
