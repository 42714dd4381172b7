"""Suffix-array dedup: bytes covered by a long string that an earlier document has too."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomread.llm.blocks import blocked, total_bytes, unpack, with_answers
from loomread.storage import stored

GRAM = 16
NO_ID = np.iinfo(np.int64).max  # stands for a null id: after all others


def words_at(data: np.ndarray, step: str) -> np.ndarray:
    """The 8 bytes that start at each position (a view; data ends with 8 bytes of padding at least)."""
    return np.ndarray(len(data) - 7, step, data.data, strides=(1,))


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes of ``s`` in order, compared up to ``depth`` symbols or the next 0; two-stage sorting.

    s is uint8 and ends with 0; 0 stands after each string. Suffixes smaller than their successors are sorted directly,
    some symbols at a time; the others are induced, bucket by bucket of first symbols: when a suffix has its place, the
    one that starts a symbol earlier, if larger than it, takes the next free place of its bucket.
    """
    n = len(s)
    step = np.sign(np.diff(s.astype(np.int16)))
    at = np.where(step != 0, np.arange(n - 1), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # of the next change
    small = np.zeros(n, bool)
    small[:-1] = np.append(step, -1)[nearest] > 0
    ends = s == 0
    small[ends] = False

    words = words_at(np.concatenate([s, np.zeros(depth + 16, np.uint8)]), ">u8")
    order = np.flatnonzero(small)
    group = np.zeros(len(order), np.int64)
    live = np.arange(len(order))  # places of suffixes that are still tied
    bits = max(1, len(order).bit_length())
    step = (64 - 2 * bits) // 8  # symbols that fit beside the group and the place, so that plain numbers are sorted
    for d in range(0, depth, step):
        key = group[live].astype(np.uint64) << np.uint64(64 - bits)
        key |= (words[order[live] + d] >> np.uint64(64 - 8 * step)).astype(np.uint64) << np.uint64(bits)
        key |= np.arange(len(live), dtype=np.uint64)
        key.sort()
        order[live] = order[live][(key & np.uint64((1 << bits) - 1)).astype(np.int64)]
        key >>= np.uint64(bits)
        new = np.ones(len(live), bool)
        new[1:] = key[1:] != key[:-1]
        group[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        live = live[tied]
        if not len(live):
            break

    large: list[list] = [[] for _ in range(256)]
    cut = np.searchsorted(s[order], np.arange(257))
    out = [np.flatnonzero(ends)]

    def induce(placed: np.ndarray, c: int) -> np.ndarray:
        """Deals what ``placed`` (a run of the array, in bucket c) induces; returns what falls in bucket c itself."""
        before = placed[placed > 0] - 1
        before = before[~small[before] & ~ends[before]]
        first = s[before]
        by = np.argsort(first, kind="stable")
        before, first = before[by], first[by]
        for x in np.unique(first):
            got = before[first == x]
            if x == c:
                same = got
            else:
                large[x].append(got)
        return same if c in first else before[:0]

    induce(out[0], 0)
    for c in range(1, 256):
        run = np.concatenate(large[c]) if large[c] else order[:0]
        while len(run):
            out.append(run)
            run = induce(run, c)
        if len(own := order[cut[c]:cut[c + 1]]):
            out.append(own)
            induce(own, c)
    return np.concatenate(out)


def _least_by_shares(s, sizes, owners, length, most):
    """least_owner() where one anchor has very many pieces: windows are dealt by a hash, and each share is sorted alone."""
    starts = np.cumsum(np.append(0, sizes[:-1] + 1))
    counts = sizes - length + 1
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    owner = np.repeat(owners, counts)
    words = words_at(np.concatenate([s, np.zeros(length, np.uint8)]), "<u8")
    h = (words[at] * np.uint64(0x9E3779B97F4A7C15) + words[at + length // 2]) * np.uint64(0xC2B2AE3D27D4EB4F) + words[at + length - 8]
    shares = -(-len(at) * length // most)
    share = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)) % np.uint64(shares)
    least = np.empty(len(at), np.int64)
    for k in range(shares):
        own = np.flatnonzero(share == k)
        if len(own):
            _, to = np.unique(s[at[own][:, None] + np.arange(length)].view(f"V{length}").ravel(), return_inverse=True)
            found = np.full(to.max() + 1, NO_ID, np.int64)
            np.minimum.at(found, to, owner[own])
            least[own] = found[to]
    return np.split(least, np.cumsum(counts)[:-1])


def least_owner(pieces: list[bytes], owners: np.ndarray, length: int, most: int = 1 << 20) -> list[np.ndarray]:
    """For each piece and each of its windows of ``length`` bytes, the least owner of a piece that has that window too."""
    s = np.frombuffer(b"\0".join(p.translate(_UP) for p in pieces) + b"\0", np.uint8)
    sizes = np.array([len(p) for p in pieces])
    if len(s) > most:
        return _least_by_shares(s, sizes, owners, length, most)
    starts = np.cumsum(np.append(0, sizes[:-1] + 1))
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    fits = (starts + sizes)[piece] - np.arange(len(s)) >= length
    sa = suffix_array(s, length)
    sa = sa[fits[sa]]
    padded = np.concatenate([s, np.zeros(length + 16, np.uint8)])
    same = np.ones(len(sa) - 1, bool)  # adjacent suffixes with a common prefix of ``length``
    words = words_at(padded, "<u8")
    for d in [*range(0, length - 8, 8), length - 8]:
        same &= words[sa[1:] + d] == words[sa[:-1] + d]
    heads = np.flatnonzero(np.append(True, ~same))
    least = np.minimum.reduceat(owners[piece[sa]], heads)
    at = np.empty(len(s), np.int64)
    at[sa] = np.repeat(least, np.diff(np.append(heads, len(sa))))
    return [at[a:a + n - length + 1] for a, n in zip(starts, sizes)]


#: 0 is the end of a string in suffix_array(); 255, which UTF-8 never has, stays.
_UP = bytes(min(b + 1, 255) for b in range(256))


def anchors(data: np.ndarray, ends: np.ndarray, length: int, part: int = 1 << 18):
    """Runs of windows (first, last start) of ``length`` bytes, and the hash of the leftmost least GRAM-gram that they share.

    ``ends`` has the end of each text; a window lies in one text. Whether windows are equal shows in their anchors:
    equal windows have equal hashes. Worked off in parts, so memory doesn't grow with a long text.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 24, np.uint8)])
    words = words_at(padded, "<u8")
    span = length - GRAM + 1
    found = []
    for a in range(0, n, part):
        b = min(n, a + part)
        h = words[a:b + span - 1] * np.uint64(0x9E3779B97F4A7C15)
        h += words[a + 8:b + span + 7] * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        least, at, have = h, np.arange(len(h), dtype=np.int32), 1
        while have < span:
            by = min(have, span - have)
            nearer = least[by:] < least[:-by]
            least, at, have = np.where(nearer, least[by:], least[:-by]), np.where(nearer, at[by:], at[:-by]), have + by
        least, at = least[:b - a], at[:b - a]
        start = np.arange(a, b)
        text = np.searchsorted(ends, start, "right")
        valid = start + length <= ends[np.minimum(text, len(ends) - 1)]
        new = np.ones(b - a, bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], b - a) - 1
        ok = valid[first]
        first, last = first[ok], last[ok]
        found.append((first + a, last + a, text[first], least[first] >> np.uint64(24)))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found))


class _Block:
    """A block's distinct texts as one array of bytes, with their anchors."""

    def __init__(self, payload, id_col: str, text_col: str, length: int):
        self.table = unpack(payload)
        ids = [NO_ID if i is None else i for i in self.table.column(id_col).to_pylist()]
        self.ids, seen, texts, low, high = ids, {}, [], [], []
        self.text_of = []
        for i, t in zip(ids, self.table.column(text_col).cast("binary").to_pylist()):
            k = seen.setdefault(t or b"", len(texts))
            if k == len(texts):
                texts.append(t or b"")
                low.append(i)
                high.append(i)
            else:
                low[k], high[k] = min(low[k], i), max(high[k], i)
            self.text_of.append(k)
        self.texts, self.low, self.high, self.length = texts, np.array(low, np.int64), np.array(high, np.int64), length
        self.data = b"".join(texts)
        self.ends = np.cumsum([len(t) for t in texts]) if texts else np.zeros(0, np.int64)
        first, last, text, key = anchors(np.frombuffer(self.data, np.uint8), self.ends, length)
        by = np.argsort(key, kind="stable")
        self.first, self.last, self.text, self.key = first[by], last[by], text[by], key[by]
        self.head = np.flatnonzero(np.append(True, self.key[1:] != self.key[:-1])) if len(key) else np.zeros(0, np.int64)
        self.distinct = self.key[self.head]

    def parts(self, keys: np.ndarray, n: int):
        """(r, from, to) of the sorted 40-bit keys that fall in each of n equal ranges."""
        cut = np.searchsorted(keys, np.array([(r << 40) // n for r in range(n + 1)], np.uint64))
        return [(r, a, b) for r, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]

    def shared(self, masks: dict[int, bytes], n: int):
        """Anchors whose key another document has too: their rows, and which distinct piece (numbered by key) each one is."""
        flag = np.zeros(len(self.distinct), bool)
        for r, a, b in self.parts(self.distinct, n):
            flag[a:b] = np.unpackbits(np.frombuffer(masks[r], np.uint8), count=b - a)
        rows = np.flatnonzero(np.repeat(flag, np.diff(np.append(self.head, len(self.key)))))
        number, piece, keys = {}, np.empty(len(rows), np.int64), []
        for i, (a, b, k) in enumerate(zip(self.first[rows].tolist(), (self.last[rows] + self.length).tolist(), self.key[rows].tolist())):
            piece[i] = number.setdefault(self.data[a:b], len(number))
            if len(keys) < len(number):
                keys.append(k)
        return rows, piece, list(number), np.array(keys, np.uint64)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_text: bool = True) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 and, with_text, the text without its repeats (else no text).

    A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id,
    overlaps included, as judged on the whole input. Work is dealt by content, in four steps over blocks of documents:

    1. Each window of ``length`` bytes has an anchor, the leftmost least hash of its 16-byte grams. Blocks send their
       distinct anchors (40 bits each, packed, by range of the hash) and learn which ones two documents have.
    2. Of those, blocks send the pieces of text whose windows have that anchor, each distinct piece once with its least
       id; so copies meet as one piece, however many there are.
    3. Pieces with the same anchor get a suffix array by two-stage sorting; adjacent common prefixes of ``length``
       give the least id of each window.
    4. Blocks learn these ids and drop the bytes of windows that a smaller id has.

    Ranges of the hash are as many as the data need, so no task holds more than some millions of anchors or pieces'
    bytes. A false match of 40-bit hashes only sends a piece in vain. Null texts are empty; a null id comes after all
    others and takes nothing from them; rows with equal ids take nothing from each other. With with_text, cuts move
    inwards to ends of characters, so the text stays UTF-8 (kept_sha256 is of the exact bytes). Names of new columns
    replace columns of docs. Empty tables give empty results.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in new and (with_text or f.name != text_col)] + T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string").fields)
    blocks = blocked(docs, text_col, 2 << 20)
    n_keys = max(1, -(-total_bytes(blocks) * 6 // 100 // 500_000))

    def ask(batches):
        import pyarrow as pa

        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = _Block(payload, id_col, text_col, length)
                if not len(x.key):
                    continue
                multi = np.minimum.reduceat(x.low[x.text], x.head) != np.maximum.reduceat(x.high[x.text], x.head)
                rows = [(r, block, x.distinct[a:c].astype(np.uint32).tobytes() + (x.distinct[a:c] >> np.uint64(32)).astype(np.uint8).tobytes(), np.packbits(multi[a:c]).tobytes()) for r, a, c in x.parts(x.distinct, n_keys)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), pa.int64(), pa.binary(), pa.binary()])], ["r", "block", "keys", "multi"])

    def answer(table):
        import pyarrow as pa

        keys, many = [], []
        for k, m in zip(table.column("keys").to_pylist(), table.column("multi").to_pylist()):
            n = len(k) // 5
            keys.append(np.frombuffer(k, np.uint32, n) | np.frombuffer(k, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))
            many.append(keys[-1][np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool)])
        every = np.sort(np.concatenate(keys))
        both = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *many]))
        both = np.append(both, np.uint64(1 << 63))  # so that a search always ends at an entry
        masks = [both[np.searchsorted(both, k)] == k for k in keys]
        return pa.table({"block": table.column("block"), "r": table.column("r"), "n": pa.array([int(m.sum()) for m in masks], pa.int64()), "mask": pa.array([np.packbits(m).tobytes() for m in masks], pa.binary())})

    masks = stored(blocks.select("block", "payload").mapInArrow(ask, "r int, block long, keys binary, multi binary").groupBy("r").applyInArrow(answer, "block long, r int, n long, mask binary"), "repeat-masks")
    n_pieces = max(1, -(-(masks.agg(F.sum("n")).first()[0] or 0) // 30_000))

    def send(key, texts, known):
        import pyarrow as pa

        kinds = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("pieces", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("owners", pa.binary())])
        masks_ = dict(zip(known.column("r").to_pylist(), known.column("mask").to_pylist()))
        rows = []
        for block, payload in zip(texts.column("block").to_pylist(), texts.column("payload").to_pylist()):
            x = _Block(payload, id_col, text_col, length)
            at, piece, pieces, keys = x.shared(masks_, n_keys)
            owner = np.full(len(pieces), NO_ID, np.int64)
            np.minimum.at(owner, piece, x.low[x.text[at]])
            for r, a, b in x.parts(keys, n_pieces):
                rows.append((r, block, b"".join(pieces[a:b]), np.array([len(p) for p in pieces[a:b]], np.uint16).tobytes(), keys[a:b].tobytes(), owner[a:b].tobytes()))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)] if rows else [pa.array([], f.type) for f in kinds], schema=kinds)

    def judge(table):
        import pyarrow as pa

        sent, least, by_key = [], {}, {}
        for pieces, sizes, keys, owners in zip(*(table.column(c).to_pylist() for c in ("pieces", "sizes", "keys", "owners"))):
            ends = np.cumsum(np.frombuffer(sizes, np.uint16).astype(np.int64)).tolist()
            sent.append([pieces[a:b] for a, b in zip([0, *ends], ends)])
            for p, k, o in zip(sent[-1], np.frombuffer(keys, np.uint64).tolist(), np.frombuffer(owners, np.int64).tolist()):
                if p not in least:
                    least[p] = o
                    by_key.setdefault(k, []).append(p)
                elif o < least[p]:
                    least[p] = o
        # a piece that is the only one with its anchor shares its windows with no other piece; pieces of one anchor stay in one batch
        runs = {p: (b"\x01", bytes([len(p) - length + 1]), o.to_bytes(8, "little")) for p, o in least.items()}
        for met in _batches([ps for ps in by_key.values() if len(ps) > 1]):
            for p, own in zip(met, least_owner(met, np.array([least[p] for p in met], np.int64), length)):
                heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                runs[p] = (bytes([len(heads)]), np.diff(np.append(heads, len(own))).astype(np.uint8).tobytes(), own[heads].tobytes())
        out = [[b"".join(runs[p][k] for p in ps) for ps in sent] for k in range(3)]
        return pa.table({"block": table.column("block"), "r": table.column("r"), "runs": pa.array(out[0], pa.binary()), "lengths": pa.array(out[1], pa.binary()), "owners": pa.array(out[2], pa.binary())})

    pieces = with_answers(blocks, masks.select("block", "r", "mask"), send, "r int, block long, pieces binary, sizes binary, keys binary, owners binary")
    owners = pieces.groupBy("r").applyInArrow(judge, "block long, r int, runs binary, lengths binary, owners binary")
    known = masks.select("block", F.lit(0).alias("step"), "r", "mask", *[F.lit(None).cast("binary").alias(c) for c in ("runs", "lengths", "owners")]).unionByName(
        owners.select("block", F.lit(1).alias("step"), "r", F.lit(None).cast("binary").alias("mask"), "runs", "lengths", "owners"))

    def cut(key, texts, known):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        rows = known.select(["step", "r", "mask", "runs", "lengths", "owners"]).to_pylist()
        masks_ = {x["r"]: x["mask"] for x in rows if x["step"] == 0}
        told = sorted((x for x in rows if x["step"] == 1), key=lambda x: x["r"])
        out = []
        for payload in texts.column("payload").to_pylist():
            x = _Block(payload, id_col, text_col, length)
            at, piece, _, _ = x.shared(masks_, n_keys)
            n = np.frombuffer(b"".join(t["runs"] for t in told), np.uint8).astype(np.int64)
            size = np.frombuffer(b"".join(t["lengths"] for t in told), np.uint8).astype(np.int64)
            owner = np.frombuffer(b"".join(t["owners"] for t in told), np.int64)
            run0 = np.cumsum(n) - n
            into = np.cumsum(size) - size
            into -= np.repeat(into[run0] if len(n) else into, n)  # from the start of the piece
            times = n[piece]
            run = np.repeat(run0[piece] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            row = np.repeat(at, times)
            gone = owner[run] < x.low[x.text[row]]
            start = x.first[row[gone]] + into[run[gone]]
            step = np.bincount(start, minlength=len(x.data) + 1) - np.bincount(start + size[run[gone]] + length - 1, minlength=len(x.data) + 1)
            cover = np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8)])
            change = np.flatnonzero(np.diff(cover, append=np.int8(0)))
            out.append(_results(x, cover[1:].astype(bool), change, schema, kinds, text_col, with_text, new))
        return pa.concat_tables(out)

    return with_answers(blocks, known, cut, schema)


def _batches(groups: list[list[bytes]], most: int = 1 << 19):
    """The groups' pieces in batches of about ``most`` bytes, a group whole."""
    out, size = [], 0
    for g in groups:
        if size > most:
            yield out
            out, size = [], 0
        out += g
        size += sum(map(len, g))
    if out:
        yield out


def _results(x: _Block, gone: np.ndarray, change, schema, kinds, text_col, with_text, new):
    import pyarrow as pa

    stats, short = [], []
    start = 0
    for t in x.texts:
        g = gone[start:start + len(t)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))).tolist()
        spans = list(zip(edges[::2], edges[1::2]))
        stats.append(_digest(t, spans))
        short.append(_characters(t, spans) if with_text else None)
        start += len(t)
    cols = {c: [] for c in new}
    texts = []
    for i, k in zip(x.ids, x.text_of):
        t = x.texts[k]
        every = len(t) >= x.length and i > x.low[k]  # an equal text with a smaller id is in this very block
        for c, v in zip(new, _digest(t, [(0, len(t))]) if every else stats[k]):
            cols[c].append(v)
        texts.append("" if every else short[k])
    table = x.table.drop_columns([c for c in new if c in x.table.column_names])
    arrays = []
    for i, f in enumerate(kinds):
        if f.name in new:
            arrays.append(pa.array(cols[f.name], f.type))
        elif f.name == text_col:
            was = table.column(text_col).is_null().to_pylist()
            arrays.append(pa.array([None if w else t for w, t in zip(was, texts)], f.type))
        else:
            arrays.append(table.column(f.name).cast(f.type))
    return pa.table(arrays, schema=kinds)


def _digest(t: bytes, spans: list) -> tuple:
    sha, at = hashlib.sha256(), 0
    for a, b in spans:
        sha.update(t[at:a])
        at = b
    sha.update(t[at:])
    return len(t), sum(b - a for a, b in spans), len(spans), sha.hexdigest()


def _characters(t: bytes, spans: list) -> str:
    """The text without the spans, which are first narrowed to whole characters."""
    out, at = [], 0
    for a, b in spans:
        while a < b and t[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(t) and t[b] & 0xC0 == 0x80:
            b -= 1
        out.append(t[at:a])
        at = b
    return b"".join([*out, t[at:]]).decode("utf-8", "replace")


def op7_suffix_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, with_text=False)


SQL_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
bytes AS (SELECT r, doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS b FROM (SELECT r, doc_id, regexp_extract_all(h, '..') AS l FROM d)),
spans AS (SELECT *, string_agg(b, '') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS s FROM bytes),
first AS (SELECT *, length(s) = 100 AND doc_id > min(doc_id) OVER (PARTITION BY s) AS hit FROM spans),
gone AS (SELECT r, i, b, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS g FROM first),
runs AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY r ORDER BY i), false) AS starts FROM gone),
each AS (SELECT r, count(*) AS n, count(*) FILTER (g) AS n_removed, count(*) FILTER (starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT g) AS kept FROM runs GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN each USING (r)
"""
