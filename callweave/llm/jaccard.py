"""N-gram Jaccard join: which documents have word-shingle sets of Jaccard similarity 0.8 or more.

Without pairs of copies and without all pairs of a group:

1. `sketch` gives each document its set's size, a 128-bit class (equal sets, equal class), a bitmap signature and its
   prefix: the n - ceil(0.8 n) + 1 first shingles in one global order. Two sets that link share a prefix shingle. In
   that order shingles seen in several sets of some batch come last, by their counts (`frequent`), so passages that
   many documents share open no tiles.
2. One document stands for a class. Its prefix shingles are postings; those of one shingle, sorted by size, are a tile.
   In a tile only sizes within the band n..n/0.8 are compared: all pairs of a small tile, and in a large one each
   document with its band's first one and its neighbour in an order of the tile's own (near copies that drift apart
   share many tiles, so their neighbours differ from tile to tile).
3. Pairs pass the bit-count bound on the overlap, then the exact intersection of the sorted sets. First only one pair
   a document is verified, then those that still join two components.
4. In large tiles that hold several components, only pairs of different components are still open: of each tile, those
   with a stray, a document outside the tile's largest component. The tile is dealt into cells, every cell gets the
   strays, and pairs are compared by signature; what the bound leaves is verified like any other pair. As long as
   strays are few (`Limits.strays`), this grows with the tile. Tiles of more strays, strangers that share a passage,
   are split by another shared shingle: sets that link share two shingles of prefixes one longer, three of prefixes two
   longer; the parts are compared as in steps 2 and 4. So no link between texts is lost.

Shingles are told apart by 128 bits: two independent 64-bit hashes with a random number for each place and letter of a
word, so no pair of texts has equal ones by its structure. Components come from label propagation with pointer
jumping. Every step is written to the shared folder, and joins with tables that grow are shuffled ones.

Defined cases: null or empty text has no shingles and links with nothing; a text of fewer than five words has one
shingle, the whole sequence; rows that share a doc_id are one document; rows without doc_id link with nothing and have
a null component; ids must be whole numbers (others raise); columns beside id and text are not read, so their names
don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .hashing import column_bytes, mixed, slices, words_hash

WORDS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
@dataclass(frozen=True)
class Limits:
    """Sizes that steer the work and never a result."""

    #: Shingles that the global order puts last, at most, and the count from which they are.
    frequent: int = 1 << 18
    often: int = 8
    #: Tiles up to this size are compared pair by pair.
    small: int = 64
    #: Pairs that a task holds back to report each once.
    held: int = 1 << 18
    #: Documents of a cell when a mixed tile is compared by signature.
    cell: int = 512
    #: Strays of a mixed tile up to which it is compared in cells; they are copied to every cell.
    strays: int = 2048
    #: How often a mixed tile of more strays is split by another shingle: up to twice.
    splits: int = 2


LIMITS = Limits()
#: Bits a shingle of the signatures in cells (four elsewhere), and of a signature there at most.
WIDE, WIDEST = 16, 1 << 17
#: Weights of a shingle's words, by place.
_WEIGHTS = mixed(np.arange(2 * WORDS, dtype=np.uint64), 55).reshape(2, WORDS) | np.uint64(1)

Shingles = tuple[np.ndarray, np.ndarray]


def _shingles(texts: pa.Array) -> Iterator[Shingles]:
    """The distinct shingles of each text as two hashes, sorted by the first."""
    data, offsets = column_bytes(texts)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    inner = ~space
    starts = np.flatnonzero(inner & (np.r_[True, space[:-1]] | first[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inner & (np.r_[space[1:], True] | first[1:])) + 1 if len(data) else starts
    words = words_hash(data, starts, ends)
    at = np.searchsorted(starts, offsets)
    whole = [np.zeros(0, np.uint64)] * 2
    runs = len(starts) - WORDS + 1
    if runs > 0:
        whole = [mixed(sum((w[j : runs + j] * c[j] for j in range(1, WORDS)), w[:runs] * c[0]), 1 + 2 * k) for k, (w, c) in enumerate(zip(words, _WEIGHTS))]
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= WORDS:
            p, q = (x[s : e - WORDS + 1] for x in whole)
            order = np.argsort(p)
            p, q = p[order], q[order]
            fresh = np.r_[True, p[1:] != p[:-1]]
            if (q[1:][~fresh[1:]] != q[:-1][~fresh[1:]]).any():  # one first hash, two shingles
                order = np.lexsort((q, p))
                p, q = p[order], q[order]
                fresh = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            yield p[fresh], q[fresh]
        elif e > s:
            c = _WEIGHTS[:, : e - s]
            yield tuple(mixed(np.array([(w[s:e] * k).sum(dtype=np.uint64)]), 30 + e - s) for w, k in zip(words, c))
        else:
            yield np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def _signature(found: np.ndarray, share: int = 4, most: int = 1 << 62) -> bytes:
    """A bitmap of at least `share` bits a shingle, a power of two long, so that a longer one folds onto a shorter one."""
    width = min(most, max(64, 1 << int(share * len(found) - 1).bit_length())) if len(found) else 64
    bits = np.zeros(width, bool)
    bits[(found & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_or.reduce(bits.reshape(-1, size)) if len(bits) > size else bits


def overlap_bound(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> int:
    """No intersection is larger: a bit that only one side has stands for an element that the other side lacks."""
    size = min(len(a), len(b))
    a, b = _fold(a, size), _fold(b, size)
    return min(na - int(np.bitwise_count(a & ~b).sum()), nb - int(np.bitwise_count(b & ~a).sum()))


def needed(na: int, nb: int) -> int:
    """The least intersection of linked sets: 100 i >= p (na + nb - i)."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def frequent(docs: DataFrame, text_col: str = "text", limits: Limits = LIMITS) -> np.ndarray:
    """The most frequent shingles, most frequent last, by what batches report of those in two or more of their sets.

    Whatever this finds, the join is exact.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple[int, int]] = set()
            sets = []
            for s, e in slices(b.column(0)):
                for found, _ in _shingles(b.column(0).slice(s, e - s)):
                    kind = (len(found), int(mixed(found, 3).sum(dtype=np.uint64)))
                    if len(found) and kind not in seen:
                        seen.add(kind)
                        sets.append(found)
            every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            cuts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, np.int64)
            n = np.diff(np.r_[cuts, len(every)])
            many = n >= 2
            yield pa.RecordBatch.from_arrays([pa.array(every[cuts[many]].view(np.int64)), pa.array(n[many], pa.int64())], names=["shingle", "n"])

    rows = docs.select(text_col).mapInArrow(tidy(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = rows.filter(F.col("n") >= limits.often).orderBy(F.desc("n"), "shingle").limit(limits.frequent).toPandas()
    return top["shingle"].to_numpy(np.int64)[::-1].copy().view(np.uint64)


class Order:
    """The global order of shingles: rare ones by hash, then those of `hot` as they stand there."""

    def __init__(self, hot: np.ndarray):
        self.ranks = np.argsort(hot)
        self.keys = hot[self.ranks]

    def first(self, found: np.ndarray, take: int) -> np.ndarray:
        """The `take` first shingles of a sorted set."""
        if not len(self.keys) or not take:
            return found[:take]
        at = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        common = self.keys[at] == found
        cold = found[~common][:take]
        if len(cold) < take:
            warm = at[common]
            cold = np.concatenate([cold, self.keys[warm[np.argsort(self.ranks[warm])]][: take - len(cold)]])
        return cold


def prefix_size(n: int, more: int = 0) -> int:
    """Shingles of which two linked sets share at least 1 + more."""
    return min(n, n + 1 + more - -(-PERCENT * n // 100)) if n else 0


def sketch(docs: DataFrame, hot: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, c1, c2, prefix array<long>, bits binary) of each row."""
    order = Order(hot)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in slices(b.column(1)):
                n, c1, c2, prefix, bits = [], [], [], [], []
                for found, other in _shingles(b.column(1).slice(s, e - s)):
                    size = len(found)
                    n.append(size)
                    c1.append(int(mixed(found, 5).sum(dtype=np.uint64).view(np.int64)))
                    c2.append(int(mixed(other, 7).sum(dtype=np.uint64).view(np.int64)))
                    prefix.append(order.first(found, prefix_size(size)).view(np.int64))
                    bits.append(_signature(found))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(s, e - s), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["id", "n", "c1", "c2", "prefix", "bits"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(stage), f"id {kind}, n long, c1 long, c2 long, prefix array<long>, bits binary")


TILES = "tile long, a long, na long, la long, b long, nb long"


def tiled(postings: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """From postings (key, n, id, label): pairs (tile null) of different labels and the members of large tiles (b null)."""
    small_, held_ = limits.small, limits.held

    def work(key: np.ndarray, n: np.ndarray, node: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
        key, n, node, label = (x[own] for x in (key, n, node, label))
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[cuts, len(key)])
        first, second = [], []
        small = (sizes > 1) & (sizes <= small_)
        for gap in range(1, small_):  # the i-th and the (i + gap)-th member of every small tile at once
            start, size = cuts[small & (sizes > gap)], sizes[small & (sizes > gap)]
            if not len(start):
                break
            reps = size - gap
            i = np.repeat(start - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
            first.append(i)
            second.append(i + gap)
        members = []
        for start, size in zip(cuts[sizes > small_].tolist(), sizes[sizes > small_].tolist()):
            i = np.arange(start, start + size)
            members.append(i)
            heads, head = np.empty(size, np.int64), 0
            while head < size:
                after = int(np.searchsorted(n[i], n[i[head]] * 100 // PERCENT, "right"))
                heads[head:after] = start + head
                head = after
            near = i[np.argsort(mixed(node[i].view(np.uint64) ^ np.uint64(key[start] & 0x7FFFFFFFFFFFFFFF)))]
            first += [heads, np.minimum(near[:-1], near[1:])]  # places follow sizes
            second += [i, np.maximum(near[:-1], near[1:])]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
        fits = (label[a] != label[b]) & (100 * n[a] >= PERCENT * n[b])
        a, b = a[fits], b[fits]
        swap = node[a] > node[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        large = np.concatenate(members) if members else np.zeros(0, np.int64)
        return np.stack([node[a], n[a], node[b], n[b]]), np.stack([key[large], node[large], n[large], label[large]])

    def distinct(found: np.ndarray) -> np.ndarray:
        found = found[:, np.lexsort((found[2], found[0]))]
        return found[:, np.r_[True, (np.diff(found[0]) != 0) | (np.diff(found[2]) != 0)]] if found.shape[1] else found

    def sent(found: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
        none = lambda k: pa.nulls(k, pa.int64())
        few, many = found.shape[1], large.shape[1]
        columns = [(none(few), pa.array(large[0])), (pa.array(found[0]), pa.array(large[1])), (pa.array(found[1]), pa.array(large[2])), (none(few), pa.array(large[3])), (pa.array(found[2]), none(many)), (pa.array(found[3]), none(many))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["tile", "a", "na", "la", "b", "nb"])

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 4
        held = np.zeros((4, 0), np.int64)
        for b in _and_last(batches):
            if b is None:
                now, rest = rest, None
                pairs, large = work(*now)
            else:
                now = [np.concatenate([r, c.to_numpy(zero_copy_only=False)]) for r, c in zip(rest, b.columns)]
                edge = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last tile may go on
                rest = [x[edge:] for x in now]
                pairs, large = work(*(x[:edge] for x in now))
            held = np.concatenate([held, pairs], axis=1)
            if held.shape[1] > held_:
                held = distinct(held)
            if b is None or held.shape[1] > held_ // 2 or large.shape[1]:
                out, held = (distinct(held), held[:, :0]) if b is None or held.shape[1] > held_ // 2 else (held[:, :0], held)
                yield sent(out, large)

    return postings.select("key", "n", "id", "label").repartition("key").sortWithinPartitions("key", "n", "id").mapInArrow(tidy(stage), TILES)


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        a, na, sa, c, nc, sc = (b.column(i) for i in range(6))
        keep = [overlap_bound(np.frombuffer(x.as_buffer(), np.uint8), m, np.frombuffer(y.as_buffer(), np.uint8), k) >= needed(m, k) for x, m, y, k in zip(sa, na.to_pylist(), sc, nc.to_pylist())]
        yield pa.RecordBatch.from_arrays([a, c], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column(1), b.column(3)):
            (p, v), (q, w) = (np.frombuffer(z.as_buffer(), np.uint64).reshape(2, -1) for z in (x, y))
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            both = (q[at] == p) & (w[at] == v)
            keep.append(int(np.count_nonzero(both)) >= needed(len(p), len(q)))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, made: Callable[[Shingles], object], name: str, kind: str, arrow: pa.DataType) -> DataFrame:
    """(id, made from its shingles) of the documents in `ids` that have any."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in slices(b.column(1)):
                found = [made(x) if len(x[0]) else None for x in _shingles(b.column(1).slice(s, e - s))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(found, arrow)], names=["id", name])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(ids.hint("shuffle_hash"), "id", "left_semi")
    return rows.mapInArrow(tidy(stage), f"id long, {name} {kind}").filter(F.col(name).isNotNull())


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles binary): both hashes of the sets of the documents in `ids`."""
    return _sets_of(docs, ids, id_col, text_col, lambda x: x[0].tobytes() + x[1].tobytes(), "shingles", "binary", pa.binary())


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(left.hint("shuffle_hash"), "a").join(right.hint("shuffle_hash"), "b").select("a", "sa", "b", "sb").mapInArrow(tidy(_exact), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, label) of every id in links (a, b): the smallest id it is connected with."""
    both = stored(links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("label")), "labels")
    while True:
        near = both.join(labels.hint("shuffle_hash"), F.col("y") == F.col("id")).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near.hint("shuffle_hash"), F.col("id") == F.col("x")).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = stored(step, "labels")
        jump = step.select(F.col("id").alias("k"), F.col("label").alias("far"))
        done = step.filter(F.col("old") != F.col("label")).isEmpty()
        if done:
            return step.select("id", "label")
        labels = stored(step.join(jump.hint("shuffle_hash"), F.col("label") == F.col("k")).select("id", F.least("label", "far").alias("label")), "labels")


def _labelled(rows: DataFrame, labels: DataFrame | None, col: str, name: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(name, F.col(col))
    own = labels.select(F.col("id").alias(col), F.col("label").alias("_l"))
    return rows.join(own.hint("shuffle_hash"), col, "left").withColumn(name, F.coalesce("_l", col)).drop("_l")


def _mixed(large: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(tile, id, n, label, stray, size, strays): the members of large tiles that hold several components.

    A stray is outside the largest component of its tile.
    """
    rows = stored(_labelled(large.select("tile", F.col("a").alias("id"), F.col("na").alias("n")).distinct(), labels, "id", "label"), "tiles")
    parts = rows.groupBy("tile", "label").agg(F.count("*").alias("k"))
    tiles = parts.groupBy("tile").agg(F.sum("k").alias("size"), F.max(F.struct("k", "label")).alias("most"))
    tiles = tiles.select("tile", "size", (F.col("size") - F.col("most.k")).alias("strays"), F.col("most.label").alias("main")).filter("strays > 0")
    return rows.join(tiles.hint("shuffle_hash"), "tile").select("tile", "id", "n", "label", (F.col("label") != F.col("main")).alias("stray"), "size", "strays")


def _split(members: DataFrame, prefixes: DataFrame, more: int) -> DataFrame:
    """Postings of mixed tiles under their key and another shingle of prefixes `more` longer.

    A key is the XOR of its shingles' hashes: tiles that meet again by another way become one. Of a key of two
    shingles, each is the one whose hash the key turns into that of the other.
    """
    own = members.join(prefixes.hint("shuffle_hash"), "id").withColumn("parts", F.transform("prefix", lambda p: F.xxhash64(p)))
    key = F.xxhash64("tile") if more == 1 else F.col("tile")
    used = F.array(key) if more == 1 else F.array_intersect(F.transform("parts", lambda p: p.bitwiseXOR(key)), "parts")
    return own.select(key.alias("key"), "n", "id", "label", F.explode(F.array_except("parts", used)).alias("part")).withColumn("key", F.col("key").bitwiseXOR(F.col("part")))


def _cells(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, limits: Limits) -> DataFrame:
    """Pairs (a, b) of a stray and another component's document in one tile that signatures leave open."""
    if rows.isEmpty():
        return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
    cells, blocks = F.ceil(F.col("size") / limits.cell), F.ceil(F.col("strays") / limits.strays)
    every = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    own = F.transform(every(blocks), lambda k: F.struct(F.pmod(F.xxhash64("id"), cells).alias("cell"), k.alias("block"), F.lit(False).alias("sent")))
    sent = F.transform(every(cells), lambda k: F.struct(k.alias("cell"), F.pmod(F.xxhash64("id", F.lit(1)), blocks).alias("block"), F.lit(True).alias("sent")))
    signs = _sets_of(docs, rows.select("id").distinct(), id_col, text_col, lambda x: _signature(x[0], WIDE, WIDEST), "bits", "binary", pa.binary()).dropDuplicates(["id"])
    dealt = rows.withColumn("to", F.when(F.col("stray"), F.concat(own, sent)).otherwise(own)).join(signs.hint("shuffle_hash"), "id")
    dealt = dealt.select("tile", "id", "n", "label", "stray", "bits", F.explode("to").alias("to")).select("tile", "to.*", "id", "n", "label", "stray", "bits")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sent", "n", "id"], ignore_index=True)
        width = min(map(len, pdf["bits"]))
        bits = np.stack([_fold(np.frombuffer(raw, np.uint64), width // 8) for raw in pdf["bits"]])
        n, node, label, stray = (pdf[c].to_numpy() for c in ("n", "id", "label", "stray"))
        own = int(np.searchsorted(pdf["sent"].to_numpy(), True))
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        low, high = np.searchsorted(n[:own], -(-PERCENT * n[own:] // 100)), np.searchsorted(n[:own], n[own:] * 100 // PERCENT, "right")
        out = [np.zeros((2, 0), np.int64)]
        for i, s, e in zip(range(own, len(n)), low.tolist(), high.tolist()):
            both = np.bitwise_count(bits[i] & bits[s:e]).sum(axis=1, dtype=np.int64)
            most = np.minimum(n[i] - (ones[i] - both), n[s:e] - (ones[s:e] - both))
            hit = (label[s:e] != label[i]) & (most >= -(-PERCENT * (n[s:e] + n[i]) // (100 + PERCENT))) & (~stray[s:e] | (node[s:e] > node[i]))
            other = node[s:e][hit]
            out.append(np.stack([np.minimum(other, node[i]), np.maximum(other, node[i])]))
        return pd.DataFrame(np.concatenate(out, axis=1).T, columns=["a", "b"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tile", "cell", "block"]
    return dealt.repartition(tasks, *keys).groupBy(*keys).applyInPandas(compare, "a long, b long").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of id, n, rep; labels of class representatives or None if nothing links)."""
    hot = frequent(docs, text_col, limits)
    rows = stored(sketch(docs, hot, id_col, text_col), "sketch")
    # a table of its own: then both sides of the join are dealt anew, and Spark can split a class of very many copies
    classes = stored(rows.filter("n > 0 AND id IS NOT NULL").groupBy("c1", "c2").agg(F.min("id").alias("rep")), "classes")
    sized = stored(rows.select("id", "n", "c1", "c2").join(classes, ["c1", "c2"], "left").select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("rep")).alias("rep")), "classes")
    heads = sized.filter(F.col("id") == F.col("rep")).select("id").distinct()
    reps = rows.filter("n > 0").join(heads.hint("shuffle_hash"), "id", "left_semi")
    long_id = F.col("id").cast("long")
    postings = reps.select(F.explode("prefix").alias("key"), "n", long_id.alias("id"), long_id.alias("label"))
    tiles = stored(tiled(postings, limits), "tiles")
    signs = rows.filter("n > 0 AND id IS NOT NULL").select(F.col("id").cast("long").alias("id"), "bits")
    left = signs.select(F.col("id").alias("a"), F.col("bits").alias("sa"))
    right = signs.select(F.col("id").alias("b"), F.col("bits").alias("sb"))

    def near(found: DataFrame) -> DataFrame:
        """Pairs of tiles that pass the bound."""
        pairs = found.filter("tile IS NULL").select("a", "na", "b", "nb").distinct()
        bound = pairs.join(left.hint("shuffle_hash"), "a").join(right.hint("shuffle_hash"), "b").select("a", "na", "sa", "b", "nb", "sb").mapInArrow(tidy(_bounded), "a long, b long")
        return stored(bound.distinct(), "pairs")

    ids = lambda p: p.select(F.col("a").alias("id")).unionByName(p.select(F.col("b").alias("id"))).distinct()
    pairs = near(tiles)
    sets = stored(shingle_sets(docs, ids(pairs), id_col, text_col), "sets")
    one = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = stored(_linked(one, sets), "linked")
    labels = None if found.isEmpty() else components(found)
    parted = lambda p: _labelled(_labelled(p, labels, "a", "la"), labels, "b", "lb").filter("la <> lb").select("a", "b")
    more = stored(_linked(parted(pairs).join(one, ["a", "b"], "left_anti"), sets), "linked")

    def joined() -> DataFrame | None:
        """The labels after `more` has been added to the links found."""
        nonlocal found
        if more.isEmpty():
            return labels
        found = found.unionByName(more)
        return components(found)

    labels = joined()
    members = _mixed(tiles.filter("tile IS NOT NULL"), labels)
    for split in range(1, limits.splits + 2):
        members = stored(members, "tiles")
        few = F.lit(split > limits.splits) | (F.col("strays") <= limits.strays)
        late = stored(_cells(members.filter(few), docs, id_col, text_col, limits), "pairs")
        rest = members.filter(~few)
        if split <= limits.splits and not rest.isEmpty():
            order = Order(hot)
            longer = lambda x, k=split: order.first(x[0], prefix_size(len(x[0]), k)).view(np.int64)
            prefixes = _sets_of(docs, rest.select("id").distinct(), id_col, text_col, longer, "prefix", "array<long>", pa.list_(pa.int64())).dropDuplicates(["id"])
            tiles = stored(tiled(_split(rest, prefixes, split), limits), "tiles")
            late = late.unionByName(near(tiles))
        else:
            tiles = None
        late = stored(parted(late.distinct()), "pairs")
        if not late.isEmpty():
            more = stored(_linked(late, shingle_sets(docs, ids(late), id_col, text_col)), "linked")
            labels = joined()
        if tiles is None:
            break
        members = _mixed(tiles.filter("tile IS NOT NULL"), labels)
    return sized, labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    sized, labels = links(docs, id_col, text_col, limits)
    own = sized.select("id", "n", F.coalesce("rep", "id").alias("rep"))
    return _labelled(own, labels, "rep", "component_id").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, the one with the smallest id; of repeated rows of an id, one row."""
    found = stored(jaccard_components(docs, id_col, text_col), "components")
    losers = found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    kept = docs.join(losers.hint("shuffle_hash"), id_col, "left_anti")
    repeated = found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(kept.filter(F.col(id_col).isNull()))
