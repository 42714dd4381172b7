"""SentencePiece encoding and decoding: N-best segmentation by A* over the piece lattice."""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomread.llm.words import extended, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TOKEN = re.compile(r" *[^ \n]+| +|\n")
SLOT_BITS = 18       # of the table of pieces and their beginnings
CELLS = 1 << 18      # places of tokens that go through the lattice together
KEPT = 300_000       # tokens that a task keeps


class Vocabulary:
    """Pieces of a model file, with plain spaces for the mark that stands for them."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.bytes_of, self.byte_id = {}, [], {}
        for i in range(m.get_piece_size()):
            p = m.id_to_piece(i)
            if m.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes_of.append(bytes([int(p[3:5], 16)]))
            elif m.is_control(i) or m.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                p = p.replace("▁", " ")
                self.pieces[p] = (m.get_score(i), i)
                self.bytes_of.append(p.encode())
        if any("\n" in p or " " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("pieces across words are not supported")
        self.inner = {p[k:k + 2] for p in self.pieces for k in range(len(p) - 1)}
        least = min(s for s, _ in self.pieces.values() if s > -1e8)
        self.pieces = {p: (max(s, least - 1), (i,)) for p, (s, i) in self.pieces.items()}  # -1e9 marks pieces that merges never make
        self.unknown = least - 10  # of a character that is no piece: its bytes
        self.starts = dict.fromkeys(p[:k] for p in self.pieces for k in range(1, len(p))) | self.pieces  # a string that isn't here starts no piece
        self.longest = max(map(len, self.pieces))
        self._tables()

    def _tables(self):
        """Arrays for segment(): entries are the strings of ``starts``, found by the hash of their characters."""
        names = list(self.starts)
        codes, sizes = _codes(names)
        hashes, at = np.zeros(len(names), np.uint64), np.cumsum(sizes) - sizes
        for k in range(self.longest):
            live = sizes > k
            hashes[live] = _hashed(hashes[live], codes[at[live] + k])
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two strings with one hash")
        # slots by the highest bits, then the next free one; the last two entries stand for an unknown character and for nothing
        self.hashes = np.append(hashes, np.zeros(2, np.uint64))
        self.score = np.array([-np.inf if (v := self.starts[x]) is None else v[0] for x in names] + [self.unknown, -np.inf])
        self.id = np.array([-1 if (v := self.starts[x]) is None else v[1][0] for x in names] + [-1, -1], np.int32)
        self.slots, left = np.full(1 << SLOT_BITS, len(names) + 1, np.int32), np.arange(len(names), dtype=np.int32)
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(left):
            free = self.slots[slot] > len(names)
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << SLOT_BITS) - 1)

    def _entries(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash; the last one where there is none."""
        none = len(self.id) - 1
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        out = self.slots[slot]
        wrong = np.flatnonzero((out != none) & (self.hashes[out] != hashes))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << SLOT_BITS) - 1)
            out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[(out[wrong] != none) & (self.hashes[out[wrong]] != hashes[wrong])]
        return out

    def segment(self, tokens: list[str]):
        """(best score, gap to the second best score or infinity, number of ids, ids of all) of tokens by rising length, by forward Viterbi.

        Tokens of similar length go through the lattice side by side, place by place. On the way back along the best
        path, the gap is the least loss of another edge into a place of it: what A* would take from its agenda next.
        """
        size, out, begun = np.fromiter(map(len, tokens), np.int64, len(tokens)), [], 0
        while begun < len(tokens):
            most = max(4, int(size[begun] * 5 // 4))
            end = min(int(np.searchsorted(size, most, "right")), begun + max(1, CELLS // (most + 1)))
            out.append(self._side_by_side(tokens[begun:end]))
            begun = end
        kinds = (float, float, np.int64, np.int32)
        return tuple(np.concatenate(x).astype(k) for x, k in zip(zip(*out), kinds)) if out else tuple(np.zeros(0, k) for k in kinds)

    def _side_by_side(self, tokens: list[str]):
        codes, size = _codes(tokens)
        width, most = len(tokens), int(size.max())
        first = np.cumsum(size) - size
        column = np.repeat(np.arange(width), size)
        place = np.arange(len(codes)) - first[column]
        left = size[column] - place
        none = len(self.id) - 1
        edges = np.full((most + 1, min(self.longest, most), width), none, np.int32)  # [end, length - 1, token]
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for k in range(edges.shape[1]):
            fits = left[at] > k
            at = at[fits]
            h = _hashed(h[fits], codes[at + k])
            entry = self._entries(h)
            edges[place[at] + k + 1, k, column[at]] = entry
            if k == 0:
                single = self.id[entry] < 0
                edges[place[at[single]] + 1, 0, column[at[single]]] = none - 1
            goes = entry != none
            at, h = at[goes], h[goes]
        best, gaps, by = np.full((most + 1, width), -np.inf), np.full((most + 1, width), np.inf), np.zeros((most + 1, width), np.int32)
        best[0], every = 0.0, np.arange(width)
        for j in range(1, most + 1):
            n = min(j, edges.shape[1])
            score = self.score[edges[j, :n]]
            score += best[j - n:j][::-1]
            by[j] = score.argmax(axis=0)
            best[j] = score[by[j], every]
            score[by[j], every] = -np.inf
            with np.errstate(invalid="ignore"):
                gaps[j] = best[j] - score.max(axis=0)
        gap, at, live, path = np.full(width, np.inf), size.copy(), every, []
        while len(live):
            here = at[live]
            gap[live] = np.minimum(gap[live], gaps[here, live])
            k = by[here, live]
            entry = edges[here, k, live]
            step = np.full(width, -1, np.int64)
            step[live] = np.where(entry < none - 1, self.id[entry], -2 - codes[first[live] + here - 1].astype(np.int64))
            path.append(step)
            at[live] -= k + 1
            live = live[at[live] > 0]
        path = np.array(path[::-1]).T
        used = path != -1
        flat, n = path[used], used.sum(axis=1)
        odd = np.flatnonzero(flat < -1)  # a character that is no piece
        if len(odd):
            own = [[self.byte_id[b] for b in chr(-2 - x).encode("utf-8", "surrogatepass")] for x in flat[odd].tolist()]
            more = np.ones(len(flat), np.int64)
            more[odd] = [len(x) for x in own]
            n = np.bincount(np.repeat(every, n), more, width).astype(np.int64)
            at = np.repeat(flat < -1, more)
            flat = np.repeat(flat, more)
            flat[at] = [y for x in own for y in x]
        return best[size, every], gap, n, flat

    def edges(self, s: str, best: list | None = None) -> list[list]:
        """For each end in s: (start, score, ids) of the pieces that end there; fills in the best scores to each place."""
        size, starts = len(s), self.starts
        best = best or [0.0] + [-np.inf] * size
        out = [[] for _ in range(size + 1)]
        for i in range(size):
            here = best[i]
            for j in range(i + 1, size + 1):
                part = s[i:j]
                found = starts.get(part, 0)
                if found:
                    score = found[0]
                    out[j].append((i, score, found[1]))
                    if here + score > best[j]:
                        best[j] = here + score
                elif found == 0:
                    break
            if s[i] not in self.pieces:
                out[i + 1].append((i, self.unknown, tuple(self.byte_id[b] for b in s[i].encode("utf-8", "surrogatepass"))))
                best[i + 1] = max(best[i + 1], here + self.unknown)
        return out

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple]]:
        """(score, ids) of the n best segmentations of s, best first.

        Forward Viterbi gives the best score from the start to each place; backward A* from the end takes it as its
        heuristic, which is exact, so paths come off the agenda in the order of their whole score. No place is left
        more than n times, as n paths are no worse than a later one through it; of ties the last one made goes on.
        """
        best = [0.0] + [-np.inf] * len(s)
        edges = self.edges(s, best)
        agenda, made, out, left = [(-best[-1], 0, len(s), 0.0, None)], 0, [], [n] * (len(s) + 1)
        pop, push = heapq.heappop, heapq.heappush
        while agenda:
            cost, _, at, after, path = pop(agenda)
            if at == 0:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                out.append((-cost, tuple(ids)))
                if len(out) == n:
                    break
                continue
            left[at] -= 1
            if left[at] < 0:
                continue
            for i, score, own in edges[at]:
                if left[i]:
                    made -= 1
                    push(agenda, (-(best[i] + score + after), made, i, score + after, (own, path)))
        return out


def _codes(strings: list[str]):
    """Characters of all strings as numbers, and the strings' sizes."""
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, strings), np.int64, len(strings))


def _hashed(before: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (before ^ code) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def tokens(text: str | None) -> list[str]:
    """The text after a space (as the model's dummy prefix), cut before spaces and around line ends; none for empty text."""
    return TOKEN.findall(" " + text) if text else []


def best_texts(found: dict[int, list[tuple[float, tuple]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """(loss against the best, {place of a token: rank} but for best ones) of the n best texts, given n-best lists of some tokens."""
    out = [(0.0, {})]
    for i, f in found.items():
        out = heapq.nsmallest(n, ((loss + f[0][0] - x[0], {**at, i: k} if k else at) for loss, at in out for k, x in enumerate(f)), key=lambda x: x[0])
    return out


class Tokens:
    """Segmentations of the tokens seen last, by number."""

    def __init__(self, v: Vocabulary, n: int):
        self.v, self.n, self.ranked = v, n, {}
        self._clear()

    def _clear(self):
        self.number, self.held = {}, 0
        self.score, self.gap, self.size, self.at, self.ids = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of each text, the number of each of its tokens; numbers hold until the next call."""
        if len(self.number) > KEPT:
            self._clear()
        new = sorted(set().union(*texts).difference(self.number), key=len)
        score, gap, size, ids = self.v.segment(new)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))
        self.at = np.append(self.at, len(self.ids) + np.cumsum(size) - size)
        self.score, self.gap, self.size, self.ids = np.append(self.score, score), np.append(self.gap, gap), np.append(self.size, size), np.append(self.ids, ids)
        return [np.fromiter(map(self.number.__getitem__, t), np.int64, len(t)) for t in texts]

    def n_best(self, token: str) -> list[tuple[float, tuple]]:
        if token not in self.ranked:
            if len(self.ranked) > 20_000:
                self.ranked.clear()
            self.ranked[token] = self.v.n_best(token, self.n)
        return self.ranked[token]

    def encode(self, own: np.ndarray) -> np.ndarray:
        """The ids of a text's tokens, one after another."""
        n = self.size[own]
        return self.ids[np.repeat(self.at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def decode(ids: np.ndarray, bytes_of: list[bytes]) -> str:
    """The text of ids, without the prefix."""
    return b"".join(map(bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def _some(texts: list, most: int = 1 << 20):
    """The texts in runs of about ``most`` characters."""
    begun = size = 0
    for k, t in enumerate(texts, 1):
        size += len(t or "")
        if size > most or k == len(texts):
            yield texts[begun:k]
            begun, size = k, 0


def _replaced(ids: np.ndarray, ends: np.ndarray, other: dict[int, tuple]) -> np.ndarray:
    """The ids with those of some tokens replaced; ends has the end of each token."""
    out, at = [], 0
    for i in sorted(other):
        out += [ids[at:ends[i - 1] if i else 0], np.array(other[i], np.int32)]
        at = ends[i]
    return np.concatenate([*out, ids[at:]])


def encode_texts(docs: DataFrame, text_col: str = "text", model: str = MODEL, n_best: int = 3, ids: bool = True) -> DataFrame:
    """``docs`` with n_pieces, best_score, scores, ids_sha256, round_trip, n_best_sha256 and, with ids, n_best (array of score and ids).

    scores has the sums of piece scores, best first, of the n_best segmentations of the whole text, or of all if there
    are fewer; n_pieces, best_score and ids_sha256 are of the best. Scores are as the model file gives them, where
    pieces with the file's -1e9 count just below the least other one; a character that is no piece
    is encoded as its bytes, at less than the least score. No piece goes over the start of a token, so the lattice falls
    apart there: forward Viterbi runs over the tokens that a task has not seen lately, many side by side, and gives
    each one's best segmentation and how much its second best loses. The n best texts differ from the best one only
    in the n - 1 tokens that lose least; those get their n best by A*, and the texts are the least sums of losses.
    All n segmentations of the whole text are put together and decoded, with ids or without: n_best_sha256 has a digest
    of each one's ids as little-endian 32-bit numbers, in the order of scores, and round_trip says that decoding each gives the
    text; ids_sha256 is the digest of the best. Null and empty texts have no pieces and score 0;
    a text or token may be long (time grows in proportion); repeated rows get equal results; columns of docs with one
    of the new names are replaced; an empty table gives an empty result.
    """
    new = "n_pieces long, best_score double, scores array<double>, ids_sha256 string, round_trip boolean, n_best_sha256 array<string>" + ", n_best array<struct<score: double, ids: array<int>>>" * ids
    schema, arrow = extended(docs.schema, new)
    names = [f.name for f in T.StructType.fromDDL(new).fields]
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))  # as large as the model file, whatever the corpus
    at = docs.columns.index(text_col)

    def run(batches):
        v = vocabulary.value
        seen = Tokens(v, n_best)
        for b in batches:
            begun = 0
            for few in _some(b.column(at).to_pylist()):
                cols = {c: [] for c in names}
                cut = [tokens(t) for t in few]
                for t, parts, own in zip(few, cut, seen.numbers(cut)):
                    best, score = seen.encode(own), float(seen.score[own].sum())
                    near = np.argpartition(seen.gap[own], min(n_best, len(own)) - 1)[:n_best - 1] if len(own) else own
                    ranked = best_texts({i: seen.n_best(parts[i]) for i in near.tolist()}, n_best)
                    ends = np.cumsum(seen.size[own])
                    paths = [best] + [_replaced(best, ends, {i: seen.n_best(parts[i])[k][1] for i, k in pick.items()}) for _, pick in ranked[1:]]
                    digests = [hashlib.sha256(path.tobytes()).hexdigest() for path in paths]
                    cols["n_pieces"].append(len(best))
                    cols["best_score"].append(score)
                    cols["scores"].append([score - loss for loss, _ in ranked])
                    cols["ids_sha256"].append(digests[0])
                    cols["round_trip"].append(all(decode(path, v.bytes_of) == (t or "") for path in paths))
                    cols["n_best_sha256"].append(digests)
                    if ids:
                        cols["n_best"].append([{"score": score - loss, "ids": path} for (loss, _), path in zip(ranked, paths)])
                yield with_columns(b.slice(begun, len(few)), set(names), cols, arrow)
                begun += len(few)

    return docs.mapInArrow(run, schema)


def op3_sentencepiece_nbest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, ids=False)
