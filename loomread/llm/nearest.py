"""MinHash near-dedup by an LSH forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomread.llm.words import lowered_words
from loomread.operators.components import connected_components
from loomread.storage import stored

TREES, DEPTH = 16, 8  # sorted orders, and hashes of each
SHALLOW = 4           # depth at which regions start
COPIES = 4096         # copies of a set that make it hot


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240611)
    return rng.integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


class WordHashes(dict):
    """64-bit hash of a word, kept while the table is small."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


def shingle_set(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter; empty without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j:n - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lower 16 bits of the least 32-bit value of the set under each of the hash functions."""
    s, least = (s >> np.uint64(32)).astype(np.uint32), None
    for i in range(0, len(s), 256):  # some at a time, which stay in the cache
        part = ((s[i:i + 256, None] ^ b) * a).min(axis=0)
        least = part if least is None else np.minimum(least, part)
    return least.astype(np.uint16)


def _signed(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig): set_key is a 128-bit digest of the set, null where it is empty."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        hashes, (a, b) = WordHashes(), _multipliers(TREES * DEPTH)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for x in batches:
            rows = []
            for i, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                s = shingle_set(lowered_words(t), k, hashes)
                rows.append((i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), signature(s, a, b).tobytes()) if len(s) else (i, 0, None, None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)


class _Order:
    """One task's share of the sorted orders, as it streams by: neighbours with their common prefix, and the members of regions.

    A region is a run of rows of a tree with SHALLOW equal first hashes. One that ends within the share with at most
    ``most`` members is named by its members, so that equal regions of several trees become one; a larger one, or
    one at an edge of the share, is named by its prefix.
    """

    def __init__(self, most: int):
        self.most, self.out = most, []
        self.tree, self.hashes, self.doc = np.zeros(0, np.int64), np.zeros((0, DEPTH), np.uint16), np.zeros(0, np.int64)
        self.edge, self.told = True, False  # of the run still open: it began with the share; its members so far are out

    def _members(self, key, doc, large):
        self.out.append((np.full(len(doc), 1, np.int8), np.broadcast_to(key, doc.shape).astype(np.uint64).view(np.int64), doc, np.full(len(doc), large, np.int32)))

    def _prefix_key(self, i):
        word = np.ascontiguousarray(self.hashes[i, :SHALLOW]).view(np.uint64).ravel()
        return _mixed(word + _mixed(self.tree[i].astype(np.uint64) + np.uint64(1)))

    def add(self, tree: np.ndarray, hashes: np.ndarray, doc: np.ndarray):
        old = len(self.doc)
        self.tree, self.hashes, self.doc = np.concatenate([self.tree, tree]), np.concatenate([self.hashes, hashes]), np.concatenate([self.doc, doc])
        common = np.cumprod(self.hashes[1:] == self.hashes[:-1], axis=1).sum(axis=1)
        common[self.tree[1:] != self.tree[:-1]] = 0
        i = np.flatnonzero(common >= SHALLOW)
        i = i[i + 1 >= old]  # neighbours among the rows held back have been told
        x, y = self.doc[i], self.doc[i + 1]
        self.out.append((np.zeros(len(i), np.int8), np.minimum(x, y), np.maximum(x, y), common[i].astype(np.int32)))
        start = np.flatnonzero(np.append(True, common < SHALLOW))
        n = np.diff(start)  # of the runs that have ended
        if len(n):
            first = 0
            if self.edge or self.told:
                own = np.arange(int(self.told), n[0])
                self._members(self._prefix_key(own), self.doc[own], 1)
                first = 1
            for large, runs in ((0, np.flatnonzero((n > 1) & (n <= self.most))), (1, np.flatnonzero(n > self.most))):
                runs = runs[runs >= first]
                if len(runs):
                    size = n[runs]
                    own = np.repeat(start[runs] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    name = np.repeat(_mixed(np.add.reduceat(_mixed(self.doc[own].astype(np.uint64)), np.cumsum(size) - size)), size)
                    self._members(self._prefix_key(own) if large else name, self.doc[own], large)
            self.edge = self.told = False
        held = np.arange(start[-1], len(self.doc))
        if self.told or len(held) > self.most:
            own = held[int(self.told):]
            self._members(self._prefix_key(own), self.doc[own], 1)
            self.told, held = True, held[-1:]
        self.tree, self.hashes, self.doc = self.tree[held], self.hashes[held], self.doc[held]

    def end(self):
        if not self.told:
            own = np.arange(len(self.doc))
            self._members(self._prefix_key(own), self.doc[own], 1)

    def taken(self):
        import pyarrow as pa

        cols = [np.concatenate(c) for c in zip(*self.out)]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "x", "y", "n"])


def _forest(rep: DataFrame, most: int) -> DataFrame:
    """(kind, x, y, n) from the sorted orders of ``rep`` (doc, sig): pairs x < y with n common hashes (kind 0), and members y of regions x (kind 1).

    Each tree is an order of the documents by DEPTH hashes of their own; all orders are one table, dealt by range and
    sorted, so that a task has a run of an order (a long run of equal hashes is cut by doc). The pairs are the
    neighbours with the longest common prefixes, SHALLOW at least; of a region, see _Order; n of a member tells that its
    region may be large.
    """
    slices = F.array(*[F.expr(f"substring(sig, {2 * DEPTH * t + 1}, {2 * DEPTH})") for t in range(TREES)])
    order = rep.select("doc", F.posexplode(slices).alias("tree", "hashes")).select(F.col("tree").cast("byte").alias("tree"), "hashes", "doc")
    order = order.repartitionByRange("tree", "hashes", "doc").sortWithinPartitions("tree", "hashes", "doc")

    def run(batches):
        share = _Order(most)
        for b in batches:
            if b.num_rows:
                share.add(b.column(0).to_numpy().astype(np.int64), np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, DEPTH), b.column(2).to_numpy())
                yield share.taken()
        if len(share.doc):
            share.end()
            if share.out:
                yield share.taken()

    return stored(order.mapInArrow(run, "kind byte, x long, y long, n int"), "forest")


def _nearest_pairs(forest: DataFrame) -> DataFrame:
    """(a, b) with a < b: each document and its nearest smaller neighbour, by the sum of common prefixes over all orders."""
    near = forest.where("kind = 0 and x <> y").groupBy("x", "y").agg(F.sum("n").alias("common"))
    return near.groupBy("y").agg(F.max(F.struct("common", -F.col("x"))).alias("best")).select((-F.col("best.col2")).alias("a"), F.col("y").alias("b"))


def _few(df: DataFrame, most: int) -> DataFrame:
    """df for a broadcast join if it has at most so many rows, as counted now; else for any join Spark plans."""
    return F.broadcast(df) if df.count() <= most else df


def _hub_pairs(large: DataFrame, low: DataFrame, sample: int = 512) -> DataFrame:
    """(a, b): each member b of a large region, and the member a whose signature is nearest to what most of the region have.

    ``large`` has (key, doc). What most members have is told, hash by hash, by about ``sample`` members of a region, taken
    by a hash; the nearest member is sought among all. So copies of a template, each with changes of its own, meet the
    template.
    """
    sizes = large.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = stored(large.join(sizes, "key").join(low, "doc"), "large-members")

    def usual(table):
        import pyarrow as pa

        low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        most = np.array([np.bincount(c).argmax() for c in low.T], np.uint8)
        return pa.table({"key": table.column("key")[:1], "usual": pa.array([most.tobytes()], pa.binary())})

    some = rows.where(F.pmod(F.xxhash64("doc", "key"), F.ceil(F.col("m") / sample)) == 0).select("key", "low")
    some = stored(some.groupBy("key").applyInArrow(usual, "key long, usual binary"), "usual")

    def nearness(batches):
        import pyarrow as pa

        for x in batches:
            p, q = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(x.num_rows, TREES * DEPTH) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array((p == q).sum(axis=1).astype(np.int32))], ["key", "doc", "same"])

    near = rows.join(_few(some, 50_000), "key").select("key", "doc", "low", "usual").mapInArrow(nearness, "key long, doc long, same int")
    hubs = stored(near.groupBy("key").agg(F.max(F.struct("same", -F.col("doc"))).alias("hub")).select("key", (-F.col("hub.col2")).alias("a")), "hubs")
    return rows.select("key", F.col("doc").alias("b")).join(_few(hubs, 50_000), "key").where("a <> b").select("a", "b").distinct()


def _with_company(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``members`` without documents of whose shingles fewer than percent / 100 are found in another member too, so that they can't be linked.

    ``texts`` has the texts of the members; each shingle is sent and counted once per text.
    """

    def items(batches):
        import pyarrow as pa
        import xxhash

        hashes = WordHashes()
        for x in batches:
            for doc, packed in zip(x.column(0).to_pylist(), x.column(1).to_pylist()):
                s = shingle_set(lowered_words(_unpacked(packed)), k, hashes)
                row = xxhash.xxh64_intdigest(packed) >> 1
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(np.full(len(s), doc)), pa.array(np.full(len(s), row)), pa.array(np.full(len(s), len(s)))], ["item", "doc", "row", "n"])

    own = texts.mapInArrow(items, "item long, doc long, row long, n long")
    own = own.groupBy("item").agg(F.count("*").alias("rows"), F.min(F.struct("doc", "row", "n")).alias("x"))
    alone = own.where("rows = 1").groupBy("x").agg(F.count("*").alias("alone")).where(F.expr(f"100 * (x.n - alone) < {percent} * x.n")).select(F.col("x.doc").alias("doc"), F.col("x.row").alias("row"))
    # a document of several texts goes if all of them do
    n_texts = texts.groupBy("doc").agg(F.count("*").alias("texts"))
    gone = alone.groupBy("doc").agg(F.count("*").alias("gone")).join(n_texts, "doc").where("gone = texts").select("doc")
    return members.join(gone, "doc", "left_anti")


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """``members`` (key, doc, component, ...) of large regions with ``side``, once per pair of blocks; key becomes the pair's.

    A region's members are dealt into blocks of about ``block`` by hashes: components of that many members or more have
    blocks of their own, the others share some. Any two members of different components meet in exactly one pair of blocks,
    side 0 and 1 (a block with itself has only side 0); two blocks of one component are no pair, so a region costs what its
    components have not settled yet.
    """
    sizes = members.groupBy("key", "component").agg(F.count("*").alias("m")).withColumn("alone", F.col("m") >= block)
    rest = sizes.where("not alone").groupBy("key").agg(F.sum("m").alias("rest"))
    sizes = _few(sizes.join(rest, "key", "left"), 200_000)
    own = F.xxhash64("component", F.pmod(F.xxhash64("doc"), F.ceil(F.col("m") / block)))
    shared = F.pmod(F.xxhash64("component"), F.ceil(F.col("rest") / block))
    dealt = stored(members.join(sizes, ["key", "component"]).withColumn("block", F.when(F.col("alone"), own).otherwise(shared)).withColumn("one", F.when(F.col("alone"), F.col("component"))).drop("m", "rest"), "dealt")
    blocks = dealt.select("key", "alone", "block", "one").distinct()
    x, y = blocks.select("key", F.struct("alone", "block").alias("x"), F.col("one").alias("x1")), blocks.select("key", F.struct("alone", "block").alias("y"), F.col("one").alias("y1"))
    pairs = x.join(y, "key").where("x <= y and (x1 is null or y1 is null or x1 <> y1)").select("key", "x", "y")
    ends = pairs.select("key", F.xxhash64("key", "x.alone", "x.block", "y.alone", "y.block").alias("pair"), F.explode(
        F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("b")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("b")), F.struct(F.lit(1).alias("side"), F.col("y").alias("b"))))).alias("e"))
    ends = ends.select("key", "pair", "e.side", F.col("e.b.alone").alias("alone"), F.col("e.b.block").alias("block"))
    return dealt.join(ends, ["key", "alone", "block"]).drop("alone", "block", "one").withColumn("region", F.col("key")).withColumn("key", F.col("pair")).drop("pair")


def _similar(low: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, least: float, percent: int):
    """(i, j, agreeing hashes) with i < j: pairs of different components whose signatures agree in a share of ``least``, and whose sizes allow the similarity.

    Rows are sorted by side; where there is a side 1, pairs have an end on either side.
    """
    found, ones = [(np.zeros(0, np.int64),) * 3], int((side == 0).sum())
    for i in range(ones if ones < len(low) else len(low) - 1):
        at = ones if ones < len(low) else i + 1
        near = (low[at:] == low[i]).sum(axis=1)
        small, large = np.minimum(n[at:], n[i]), np.maximum(n[at:], n[i])
        j = np.flatnonzero((near >= least * low.shape[1]) & (comp[at:] != comp[i]) & (100 * small >= percent * large))
        found.append((np.full(len(j), i), j + at, near[j]))
    return map(np.concatenate, zip(*found))


class _Union:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[x] = y
        return x != y


def _columns(table):
    """Members of a region by side and rising doc: doc, low bytes of the signature, set size, component, side."""
    table = table.sort_by([("side", "ascending"), ("doc", "ascending")])
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(table.num_rows, -1)
    return table, table.column("doc").to_numpy(), low, table.column("n").to_numpy(), table.column("component").to_numpy(), table.column("side").to_numpy()


def _open_members(members: DataFrame, least: float, percent: int) -> DataFrame:
    """(key, doc, component, low, n): the members of regions that have a similar partner in another component; key is the region."""

    def run(table):
        table, _, low, n, comp, side = _columns(table)
        i, j, _ = _similar(low, n, comp, side, least, percent)
        return table.take(np.unique(np.concatenate([i, j]))).select(["region", "doc", "component", "low", "n"])

    return members.select("key", "region", "doc", "component", "low", "n", "side").groupBy("key").applyInArrow(run, "region long, doc long, component long, low binary, n long").withColumnRenamed("region", "key")


def _closing_links(members: DataFrame, least: float, percent: int, k: int) -> DataFrame:
    """(a, b): links between components of a region, tested on full sets inside the region; pairs never leave it."""

    def run(table):
        import pyarrow as pa

        table, doc, low, n, comp, side = _columns(table)
        texts, sets, hashes = table.column("packed").to_pylist(), {}, WordHashes()
        i, j, near = _similar(low, n, comp, side, least, percent)
        _, place = np.unique(comp, return_inverse=True)
        union, out = _Union(len(doc)), []
        for at in np.argsort(-near, kind="stable").tolist():
            x, y = int(i[at]), int(j[at])
            if union.find(int(place[x])) == union.find(int(place[y])):
                continue
            for z in (x, y):
                if z not in sets:
                    sets[z] = shingle_set(lowered_words(_unpacked(texts[z])), k, hashes)
            if _linked(sets[x], sets[y], percent):
                union.join(int(place[x]), int(place[y]))
                out.append((int(doc[x]), int(doc[y])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return members.groupBy("key").applyInArrow(run, "a long, b long").distinct()


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    met = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * met >= percent * (len(p) + len(q) - met)


def _low_bytes(batches):
    import pyarrow as pa

    for x in batches:
        yield pa.RecordBatch.from_arrays([x.column(0), pa.array([s[::2] for s in x.column(1).to_pylist()], pa.binary()), x.column(2)], ["doc", "low", "n"])


def _unpacked(packed: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(packed)


def _texts(named: DataFrame, docs: DataFrame, id_col: str, text_col: str, repeated: bool) -> DataFrame:
    """(doc, packed): the texts of the documents ``named`` (doc), compressed, as they are smaller than their shingle sets.

    Texts are compressed where they are read, before they meet the names. ``repeated``: docs may have a row more than
    once, of which one stays.
    """

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in x.column(1).to_pylist()], pa.binary())], ["doc", "packed"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("length(text) > 0").mapInArrow(run, "doc long, packed binary")
    texts = texts.hint("merge").join(named.distinct(), "doc", "left_semi")  # the names grow with the data
    return texts.dropDuplicates(["doc", "packed"]) if repeated else texts


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int, hubs: bool = False) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union; with ``hubs``, many pairs share an a."""
    a_texts = texts.select(F.col("doc").alias("a"), F.col("packed").alias("a_text"))
    if hubs:
        a_texts = _few(a_texts.join(pairs.select("a").distinct(), "a", "left_semi"), 2_000)
    both = pairs.join(texts.select(F.col("doc").alias("b"), F.col("packed").alias("b_text")), "b").join(a_texts, "a")

    def test(batches):
        import pyarrow as pa

        hashes = WordHashes()
        full = lambda packed: shingle_set(lowered_words(_unpacked(packed)), k, hashes)
        for x in batches:
            keep, last, p = [], None, None
            for a, b in zip(x.column("a_text").to_pylist(), x.column("b_text").to_pylist()):
                if a != last:  # rows of one a come together
                    last, p = a, full(a)
                keep.append(_linked(p, full(b), percent))
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_text", "b_text").mapInArrow(test, "a long, b long").distinct()


def _slack(percent: int) -> float:
    """How far below the threshold a pair's share of agreeing hashes may be: five deviations of that estimate, 0.15 at least."""
    p = min(max(percent / 100, 0.0), 1.0)
    return max(0.15, 5 * (p * (1 - p) / (TREES * DEPTH)) ** 0.5)


def _repeated_ids(signed: DataFrame, rep: DataFrame) -> DataFrame:
    """(a, b): links from each id that has different texts to the documents that stand for its sets."""
    ids = signed.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi"), F.count("set_key").alias("sets"), F.count("*").alias("rows"))
    ids = ids.where("lo <> hi or (sets > 0 and sets < rows)").select("doc_id")
    named = signed.where("set_key is not null").select("doc_id", "set_key").join(ids, "doc_id", "left_semi").distinct()
    return named.join(rep.select("set_key", "doc"), "set_key").select(F.col("doc_id").alias("a"), F.col("doc").alias("b")).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, most: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``: groups linked by word-shingle Jaccard >= percent / 100.

    Sets are of distinct k-word shingles (lower-cased A-Z; shorter texts: the whole sequence), as 64-bit hashes; equal
    sets are one node before anything else, so copies cost nothing. Candidates come from the forest: first each
    document's nearest smaller neighbour in the sorted orders, by common prefixes, and for members of large regions (more
    than ``most``) the one nearest to what most of the region have; once those are confirmed on full sets
    and components are known, members of regions (of SHALLOW common hashes) that still hold more than one component are
    compared inside the region on their full sets, in large regions by pairs of blocks of about most / 2 members, so
    that no two components of a region go untested, however large it is. Of a large region those members are
    left out before of whose shingles too few are in any other, which is exact. The second step
    looks at pairs whose signatures agree in a share of hashes at most _slack() below the threshold, five deviations of
    that estimate or more, and whose sizes allow the similarity.
    component_id is the smallest doc_id reachable, kept is doc_id = component_id. Empty and null texts and rows with a
    null id link nothing (null ids: null component, kept); rows with equal ids and texts get equal results; a
    repeated id with different texts links what either text links. An empty table gives an empty result; columns other
    than the two named are not read, so clashing names do no harm; a text may be long, as it is one set.
    """
    signed = stored(_signed(docs, id_col, text_col, k), "signatures")
    rep = stored(signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "distinct-sets")
    repeated = not signed.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    least = max(0.0, percent / 100 - _slack(percent))
    forest = _forest(rep.select("doc", "sig"), most)
    low = rep.select("doc", "sig", "n").mapInArrow(_low_bytes, "doc long, low binary, n long")  # a byte of each hash is enough to compare
    regions = {large: forest.where(f"kind = 1 and n = {large}").select(F.col("x").alias("key"), F.col("y").alias("doc")).distinct() for large in (0, 1)}
    pairs = stored(_nearest_pairs(forest), "near-pairs")
    to_hubs = stored(_hub_pairs(regions[1], low), "hub-pairs")
    # of all that have a neighbour, as any of them may be asked for
    near = forest.select(F.when(F.col("kind") == 0, F.col("x")).otherwise(F.col("y")).alias("doc")).union(forest.where("kind = 0").select("y"))
    texts = stored(_texts(near, docs, id_col, text_col, repeated), "near-texts")
    links = _confirmed(pairs, texts, k, percent).unionByName(_confirmed(to_hubs, texts, k, percent, hubs=True))
    links = stored(links.unionByName(_repeated_ids(signed, rep)) if repeated else links, "links")
    groups = stored(connected_components(links, "a", "b"), "groups")

    # regions in which documents are not in one component yet: small ones as they are, large ones by pairs of blocks
    def open_only(members):
        open_ = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        return members.join(open_, "key", "left_semi")

    def unsettled(large):
        named = regions[large].join(groups.withColumnRenamed("node", "doc"), "doc", "left")
        return open_only(named.withColumn("component", F.coalesce("component", "doc")))

    whole = lambda members: members.withColumn("region", F.col("key")).withColumn("side", F.lit(0))
    left = stored(_open_members(whole(unsettled(0).join(low, "doc")), least, percent), "open-members")
    large = stored(unsettled(1), "open-large")
    large = stored(open_only(_with_company(large, texts.join(large.select("doc").distinct(), "doc", "left_semi"), k, percent)).join(low, "doc"), "open-large")
    left_large = stored(_open_members(_block_pairs(large, most // 2), least, percent).distinct(), "open-members")
    both = whole(left).unionByName(_block_pairs(left_large, most // 2))
    more = stored(_closing_links(both.join(texts, "doc"), least, percent, k), "more-links")
    if not more.isEmpty():
        groups = stored(connected_components(links.unionByName(more), "a", "b"), "groups")
    named = groups.withColumnRenamed("node", "doc")
    sets = rep.join(named, "doc", "left").select("set_key", F.coalesce("component", "doc").alias("component"), "copies")
    rows = signed.select("doc_id", "n_shingles", "set_key")
    some = rows.where("set_key is not null")
    # sets with many copies are few, at most a row for COPIES rows of docs, and meet their rows by broadcast
    hot = F.broadcast(sets.where(F.col("copies") >= COPIES).drop("copies"))
    out = some.join(hot, "set_key").unionByName(some.join(hot, "set_key", "left_anti").join(sets.where(F.col("copies") < COPIES).drop("copies"), "set_key", "left")).drop("set_key")
    # an empty text goes with the other texts of its id, if any
    out = out.unionByName(rows.where("set_key is null").drop("set_key").join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op6_minhash_forest(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs, k=3, percent=85)


SQL_NEAR = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{20}\x{09}-\x{0D}]+') AS w FROM documents),
word AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x, len(w) AS n FROM docs),
ahead AS (SELECT doc_id, n, list(x) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l FROM word),
items AS (SELECT DISTINCT doc_id, array_to_string(l, ' ') AS s FROM ahead WHERE len(l) = least(n, 3)),
sizes AS (SELECT doc_id, count(*) AS n FROM items GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * met.n >= 85 * (x.n + y.n - met.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) c USING (doc_id)
"""
