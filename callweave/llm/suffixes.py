"""Suffix-array dedup: remove every byte covered by a 50-byte string that also starts in a document with a smaller id.

Over whole texts, without moving every suffix:

1. Each 50-byte window has an anchor, the least of its 20-byte grams in a hashed order in which grams of very common
   passages come last (`common_grams`). Neighbouring windows with one anchor form a context. Equal windows have equal
   anchors, so only contexts of one anchor can share windows.
2. Contexts that are equal as a whole are one string to the suffix array: the smallest document stands for them, the
   others lose it. Within a batch that happens before the shuffle, so a passage in a third of all documents is sent
   once a batch. What a bucket has settled goes to the homes of the documents in packed pieces, not as rows.
3. Where one anchor has several different contexts in several documents, their texts are fetched and sorted by a
   two-stage suffix array (`suffix_order`), neighbours are compared by common prefix, and windows that agree in 50 bytes
   form a group whose smallest document keeps them. Only suffixes with a whole window, and those that place them, are
   sorted.
4. The removed intervals of a document are merged and cut out.

Equal contexts are told by 126 bits: the anchor's hash, and two polynomials of the whole context modulo a prime with
random bases, whose values no structure of a text can make equal. Texts are shuffled only where a join needs them.
Buckets of anchors grow in number with the input. Everything between the steps lies in the shared folder.

Defined cases: null text counts as empty; a row without doc_id neither loses bytes nor makes others lose any; rows of
one doc_id are judged each by its own text (told by 60 bits of its MD5) and never against each other; texts under 50 bytes lose nothing; ids must be
whole numbers (others raise); a column of docs that has an output's name gives way to it; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, tag_of, tidy, unused, without
from .hashing import Fingerprints, column_bytes, grams_hash, mixed, prefix_sums, slices, spans_hash

LENGTH = 50
GRAM = 20
_PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Limits:
    """Sizes that steer the work and never a result."""

    #: Grams that the anchor order puts last, at most, and in how many documents of a batch a context must be for it.
    common: int = 1 << 16
    often: int = 8
    #: Bytes of text whose anchors share a bucket, about; up to `few` buckets there are four for each shuffle partition.
    bucket: int = 16 << 20
    few: int = 1 << 10
    #: Bytes of text whose contexts are settled and sent together, to each bucket in a piece of its own; it bounds what a
    #: worker holds (25 bytes a context).
    sent: int = 1 << 24
    #: Bytes whose anchors are found at once, about; some twenty numbers a byte are in the core's cache meanwhile.
    run: int = 1 << 15
    #: Contexts whose texts are cut out of documents at once.
    cut: int = 1 << 14
    #: Longest run of bytes whose anchors are found at once; a longer text is taken in pieces that overlap by a window.
    piece: int = (1 << 19) - 64


LIMITS = Limits()


class Anchors:
    """Contexts of a run of texts: first window, number of windows, anchor hash, context hash, row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, common: np.ndarray, decides: bool = True, marks: np.ndarray | None = None):
        """decides: context hashes tell texts apart; without, they only count. marks: of the common grams, if known."""
        none = np.zeros(0, np.int64)
        self.data, self.start, self.run, self.row = data, none, none, none
        self.gram = self.context = np.zeros(0, np.uint64)
        if len(data) < LENGTH:
            return
        sums = prefix_sums(data)
        grams = self.grams = mixed(grams_hash(sums, GRAM))
        # order: 39 bits of the hash, the top one set for common grams; ties go to the leftmost place
        value = grams >> np.uint64(1)
        value &= ~_PLACE
        value |= np.arange(len(grams), dtype=np.uint64) & _PLACE
        if len(common):
            maybe = marks_of(common) if marks is None else marks
            places = np.flatnonzero(maybe.take((grams & np.uint64(len(maybe) - 1)).view(np.int64)))
            near = np.minimum(np.searchsorted(common, grams[places]), len(common) - 1)
            value[places[common[near] == grams[places]]] |= np.uint64(1 << 63)
        width, span, least = LENGTH - GRAM + 1, 1, value
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
        # a window that reaches beyond its text's end has none; a context begins where another anchor or a text does
        across = (offsets[1:, None] - np.arange(1, LENGTH)).ravel()
        inside = np.ones(len(data), bool)
        inside[across[across >= 0]] = False
        inside = inside[: len(least)]
        fresh = np.ones(len(least), bool)
        np.logical_or(least[1:] != least[:-1], inside[1:] != inside[:-1], out=fresh[1:])
        heads = np.flatnonzero(fresh)
        kept = inside[heads]
        self.start = heads[kept]
        if not len(self.start):
            return
        last = np.append(heads[1:], len(least))[kept] - 1
        self.run = last - self.start + 1
        self.gram = grams[(least[self.start] & _PLACE).astype(np.int64)]
        whole = Fingerprints(data).of(self.start, last + LENGTH) if decides else spans_hash(sums, self.start, last + LENGTH)
        self.context = mixed(whole ^ mixed(self.run.astype(np.uint64), 9), 11)
        self.row = np.searchsorted(offsets, self.start, "right") - 1


def marks_of(common: np.ndarray) -> np.ndarray:
    """Which values the last bits of sorted hashes take, of so many bits that most other hashes show none of them."""
    marks = np.zeros(1 << min(22, (32 * len(common) | 4096).bit_length()), bool)
    marks[(common & np.uint64(len(marks) - 1)).view(np.int64)] = True
    return marks


def _runs(texts: pa.Array, limits: Limits = LIMITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int, bool]]:
    """(first row, row after the last, bytes, offsets, place of the bytes in the text, whether the rows are done)."""
    for s, e in slices(texts, limits.run):
        data, offsets = column_bytes(texts.slice(s, e - s))
        if len(data) <= limits.piece or e - s > 1:
            yield s, e, data, offsets, 0, True
            continue
        for at in range(0, len(data) - LENGTH + 1, limits.piece):
            part = data[at : at + limits.piece + LENGTH - 1]
            yield s, e, part, np.array([0, len(part)]), at, at + limits.piece > len(data) - LENGTH


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    return np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(keys[0]) else np.zeros(0, np.int64)


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the wanted ones, which are sorted."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    marks = marks_of(wanted)
    found = marks[(values & np.uint64(len(marks) - 1)).view(np.int64)]
    at = np.flatnonzero(found)
    found[at] = wanted[np.minimum(np.searchsorted(wanted, values[at]), len(wanted) - 1)] == values[at]
    return found


def cut_out(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of stretches of data one after another, and their sizes."""
    sizes = sizes.astype(np.int64)
    heads = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - heads, sizes) + np.arange(int(sizes.sum()))], sizes


def common_grams(docs: DataFrame, text_col: str = "text", limits: Limits = LIMITS) -> tuple[np.ndarray, int]:
    """Grams of contexts that at least 1 in 100 documents (and `often`) of some batch hold, sorted, at most `common`; bytes of all texts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = column_bytes(b.column(0))
            held: list[list[np.ndarray]] = []
            for s, _, part, at, shift, _ in _runs(b.column(0), limits):
                a = Anchors(part, at, np.zeros(0, np.uint64), False)
                held.append([a.context, (a.row + s).astype(np.int32), a.start + (offsets[s] + shift), a.run.astype(np.uint8)])
            context, row, start, run = [np.concatenate(x) for x in zip(*held)] if held else [np.zeros(0, k) for k in (np.uint64, np.int32, np.int64, np.uint8)]
            least = max(limits.often, b.num_rows // 100)
            c = np.sort(context)
            at = _groups(c)
            often = c[at[np.diff(np.r_[at, len(c)]) >= least]]  # of that many contexts; now by documents
            near = np.flatnonzero(_among(context, often))
            near = near[np.argsort(context[near], kind="stable")]  # rows ascend within a context
            c, r = context[near], row[near]
            own = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])]) if len(c) else near
            at = _groups(c[own])
            times = np.diff(np.r_[at, len(own)])
            many = times >= least
            first, times = near[own[at[many]]], times[many]
            text, sizes = cut_out(data, start[first], run[first] + np.int64(LENGTH - 1))
            grams = mixed(grams_hash(prefix_sums(text), GRAM)) if len(text) >= GRAM else np.zeros(0, np.uint64)
            which = np.repeat(np.arange(len(sizes)), sizes)[: len(grams)]
            whole = np.arange(len(grams)) + GRAM <= np.cumsum(sizes)[which]
            found = pa.array(np.append(grams[whole].view(np.int64), 0), mask=np.append(np.zeros(int(whole.sum()), bool), True))
            yield pa.RecordBatch.from_arrays([found, pa.array(np.append(times[which[whole]], len(data)))], names=["gram", "n"])  # no gram: bytes

    rows = docs.select(text_col).mapInArrow(tidy(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.col("gram").isNotNull(), F.desc("n"), "gram").limit(limits.common + 1).collect()
    return np.sort(np.array([r.gram for r in top[1:]], np.int64).view(np.uint64)), top[0].n if top else 0


_PRESS, _UNPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
_HASHES = (np.uint64, np.uint64)
_REST = (np.int64, np.int64, np.int32, np.uint8)


def _packed(columns: list[np.ndarray]) -> bytes:
    """gram, context, doc, tag, start, run as bytes: hashes as they are, the rest compressed (doc and tag as differences)."""
    gram, context, doc, tag, start, run = columns
    raw = b"".join(np.ascontiguousarray(x, k).tobytes() for x, k in zip((np.diff(doc, prepend=0), np.diff(tag, prepend=0), start, run), _REST))
    return b"".join((len(gram).to_bytes(4, "little"), gram.tobytes(), context.tobytes(), _PRESS.compress(raw)))


def _unpacked(blobs: list[bytes]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[] for _ in range(6)]
    for blob in blobs:
        n, at = int.from_bytes(blob[:4], "little"), 4
        for out, kind in zip(parts, _HASHES):
            out.append(np.frombuffer(blob, kind, n, at))
            at += 8 * n
        raw, at = _UNPRESS.decompress(blob[at:]), 0
        for out, kind in zip(parts[2:], _REST):
            out.append(np.frombuffer(raw, kind, n, at))
            at += n * np.dtype(kind).itemsize
        for k in (2, 3):
            parts[k][-1] = np.cumsum(parts[k][-1])
    return [np.concatenate(p) if p else np.zeros(0, k) for p, k in zip(parts, (*_HASHES, *_REST))]


def _contexts(docs: DataFrame, common: np.ndarray, buckets: int, id_col: str, text_col: str, limits: Limits) -> DataFrame:
    """(bucket, blob, settled): contexts by bucket of their anchor, and intervals settled within a batch."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = marks_of(common)
        for b in batches:
            known, whole = np.array(b.column(0).is_valid()), not b.column(0).null_count
            docs_ = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            tags = b.column(2).to_numpy()
            held: list[list[np.ndarray]] = []
            size = 0
            for s, e, data, offsets, shift, done in _runs(b.column(1), limits):
                a = Anchors(data, offsets, common, marks=marks)
                keep = slice(None) if whole else known[a.row + s]
                held.append([x[keep].astype(k) for x, k in zip((a.gram, a.context, a.row + s, a.start - offsets[a.row] + shift, a.run), (*_HASHES, np.int32, np.int32, np.uint8))])
                size += len(data)
                if size >= limits.sent or (e == b.num_rows and done):
                    gram, context, row, start, run = (np.concatenate(x) for x in zip(*held))
                    held, size = [], 0
                    yield from _sent(gram, context, row, start, run, docs_, tags, buckets)

    return docs.select(F.col(id_col).cast("long"), text_col, tag_of(F.col(text_col))).mapInArrow(tidy(stage), "bucket int, blob binary, settled binary")


def _alike(hashes: np.ndarray) -> np.ndarray:
    """Places of all hashes that occur twice, equal ones together, and of few others: by as many first bits as leave room for the place."""
    bits = np.uint64(len(hashes).bit_length())
    keys = hashes >> bits << bits
    keys |= np.arange(len(hashes), dtype=np.uint64)
    keys.sort()
    same = keys[1:] >> bits == keys[:-1] >> bits
    twice = np.zeros(len(keys), bool)
    twice[1:], twice[:-1] = same, same
    twice[1:] |= same
    return (keys[twice] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _settled(gram: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which contexts lie in a larger document than an equal context."""
    gone = np.zeros(len(gram), bool)
    near = _alike(mixed(gram, 3) ^ context)
    near = near[np.lexsort((doc[near], context[near], gram[near]))]
    at = _groups(gram[near], context[near])
    if len(at):
        gone[near] = doc[near] > np.repeat(doc[near[at]], np.diff(np.r_[at, len(near)]))
    return gone


def cut_of(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """An interval of removed windows as one long: first byte and number of bytes."""
    return start.astype(np.int64) << 32 | (windows.astype(np.int64) + LENGTH - 1)


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of intervals sorted by start; touching ones become one."""
    reach = np.maximum.accumulate(end)
    fresh = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]]) if len(start) else np.zeros(0, np.int64)
    return start[fresh], reach[np.r_[fresh[1:], len(start)] - 1] if len(start) else end


def stretch_of(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and number of bytes."""
    return cut >> 32, cut & 0xFFFFFFFF


def _sent(gram: np.ndarray, context: np.ndarray, row: np.ndarray, start: np.ndarray, run: np.ndarray, docs: np.ndarray, tags: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row a bucket: contexts left, and intervals settled already (they go the same way, to be read once)."""
    gone = _settled(gram, context, docs[row])
    first = row[gone].astype(np.int64) << 32 | start[gone]
    first, end = _merged(first, first + run[gone] + (LENGTH - 1))
    cuts = np.stack([docs[first >> 32], tags[first >> 32], (first & 0xFFFFFFFF) << 32 | end - first])
    left = np.flatnonzero(~gone)
    bucket = gram[left] % np.uint64(buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # rows and places ascend within a bucket
    bucket, left = bucket[order].astype(np.int64), left[order]
    rest = [gram[left], context[left], docs[row[left]], tags[row[left]], start[left], run[left]]
    at = _groups(bucket).tolist()
    blobs = [_packed([x[i:j] for x in rest]) for i, j in zip(at, [*at[1:], len(bucket)])]
    target = bucket[at]
    if cuts.shape[1] and not len(target):
        target, blobs = np.zeros(1, np.int64), [_packed([x[:0] for x in rest])]
    ends = (np.arange(len(target) + 1) * cuts.shape[1] // max(1, len(target))).tolist()
    settled = [_PRESS.compress(np.ascontiguousarray(cuts[:, i:j]).tobytes()) for i, j in zip(ends, ends[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(blobs, pa.binary()), pa.array(settled, pa.binary())], names=["bucket", "blob", "settled"])


def _by_hash(table: pa.Table, homes: int) -> pa.Table:
    """A bucket's contexts by home of their documents: intervals settled by equal contexts, and contexts left for the suffix array."""
    columns = _unpacked(table.column("blob").to_pylist())
    near = _alike(columns[0])  # an anchor of one context has nothing to settle
    gram, context, doc, tag, start, run = (x[near] for x in columns)
    gone = _settled(gram, context, doc)
    # an anchor is open if its smallest documents differ between contexts
    keep = np.flatnonzero(~gone)
    keep = keep[np.argsort(gram[keep], kind="stable")]
    g, d = gram[keep], doc[keep]
    at = _groups(g)
    differ = np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at) if len(at) else np.zeros(0, bool)
    left = keep[np.repeat(differ, np.diff(np.r_[at, len(g)]))]
    before = [np.frombuffer(_UNPRESS.decompress(x), np.int64).reshape(3, -1) for x in table.column("settled").to_pylist()]
    parts = [x[np.concatenate([np.flatnonzero(gone), left])] for x in (doc, tag, cut_of(start, run))]
    rows = np.concatenate([*before, np.stack(parts)], axis=1)
    grams = np.zeros(rows.shape[1], np.int64)
    grams[len(grams) - len(left) :] = gram[left].view(np.int64)
    open_ = np.arange(len(grams)) >= len(grams) - len(left)
    home = (mixed(rows[0].view(np.uint64), 5) % np.uint64(homes)).astype(np.int64)
    order = np.lexsort((open_, home))
    home, rows, grams, open_ = home[order], rows[:, order], grams[order], open_[order]
    at = _groups(home).tolist()
    blobs = []
    for i, j in zip(at, [*at[1:], len(home)]):
        settled = j - i - int(open_[i:j].sum())
        blobs.append(_PRESS.compress(b"".join((settled.to_bytes(8, "little"), np.ascontiguousarray(rows[:, i:j]).tobytes(), grams[i + settled : j].tobytes()))))
    return pa.table({"home": pa.array(home[at], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _by_home(table: pa.Table) -> pa.Table:
    """Each document's settled intervals, merged, and its contexts left: their grams and places."""
    closed: list[np.ndarray] = []
    opened: list[np.ndarray] = []
    for blob in map(_UNPRESS.decompress, table.column("blob").to_pylist()):
        settled, numbers = int.from_bytes(blob[:8], "little"), np.frombuffer(blob, np.int64, offset=8)
        n = (len(numbers) + settled) // 4  # three numbers for each settled interval, four for each other
        rows = numbers[: 3 * n].reshape(3, n)
        closed.append(rows[:, :settled])
        opened.append(np.concatenate([rows[:, settled:], numbers[None, 3 * n :]]))
    one, two = np.concatenate(closed, axis=1), np.concatenate(opened, axis=1)
    doc, tag, cut = np.concatenate([one, two[:3]], axis=1)
    gram = np.concatenate([np.zeros(one.shape[1], np.int64), two[3]])
    order = np.lexsort((cut, tag, doc))
    doc, tag, cut, gram, open_ = doc[order], tag[order], cut[order], gram[order], order >= one.shape[1]
    at = _groups(doc, tag)
    whose = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(doc)]))
    start, size = stretch_of(cut[~open_])
    start += whose[~open_] << 32
    start, end = _merged(start, start + size)
    listed = lambda own, values: pa.ListArray.from_arrays(np.cumsum(np.r_[0, np.bincount(own, minlength=len(at))], dtype=np.int32), pa.array(values))
    cuts = listed(start >> 32, (start & 0xFFFFFFFF) << 32 | end - start)
    return pa.table({"doc": doc[at], "tag": tag[at], "cuts": cuts, "grams": listed(whose[open_], gram[open_]), "places": listed(whose[open_], cut[open_])})


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """At each place the eight bytes from there on, to be read as big-endian numbers; beyond the text's end zeros."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)])
    return np.ndarray(len(text) + depth + 8, ">u8", padded, strides=(1,))


def _direct(words: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in order of the `depth` bytes from there on: by a word, then those that tie by the next one."""
    limit = -(-depth // 8)

    def word(j: int, at: np.ndarray) -> np.ndarray:
        found = words[at + 8 * j].astype(np.uint64)
        return found >> np.uint64(8 * (8 - depth % 8)) if depth % 8 and j == limit - 1 else found

    first = word(0, places)
    order = np.argsort(first)
    out, key = places[order], first[order]
    fresh = np.r_[True, key[1:] != key[:-1]]  # where places begin that differ from those before
    for j in range(1, limit):
        alone = fresh & np.r_[fresh[1:], True]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        at, group = out[tied], np.cumsum(fresh[tied]).astype(np.uint64)
        key = word(j, at)
        # group and rank of the word in one number
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]]).astype(np.uint64)
        both = group << np.uint64(32) | rank
        order = np.argsort(both)
        out[tied], both = at[order], both[order]
        fresh[tied] = np.r_[True, both[1:] != both[:-1]]
    return out


def suffix_order(text: np.ndarray, depth: int = LENGTH, wanted: np.ndarray | None = None) -> np.ndarray:
    """The suffixes of `text` (uint8, 64 zeros at its end), or those wanted, in order of their first `depth` bytes, by two-stage sorting.

    Stage one sorts directly only suffixes smaller than their successors (type B). Stage two scans the buckets of
    first letters upwards and places every other suffix (type A) by the rank of its successor, which lies in a lower
    bucket, or in the same one for runs of a letter, taken by the length of the run. Of suffixes that are not wanted
    only those take part by which a wanted one is placed.
    """
    n, kind = len(text), np.int32 if len(text) < 1 << 31 else np.int64
    ascending = np.append(text[:-1] < text[1:], True)
    reach = np.zeros(n, kind)  # letters of the run that follow
    same = np.flatnonzero(text[:-1] == text[1:])
    if len(same):  # as the run's last place
        at = np.flatnonzero(np.diff(same, prepend=-2) > 1)
        end = np.repeat(same[np.r_[at[1:], len(same)] - 1] + 1, np.diff(np.r_[at, len(same)]))
        ascending[same], reach[same] = ascending[end], end - same
    part = np.ones(n, bool) if wanted is None else wanted.copy()
    more = np.flatnonzero(part & ~ascending)  # of which the next one is needed
    while len(more := more[~part[more + 1]] + 1):
        part[more] = True
        more = more[~ascending[more]]
    direct = _direct(_words(text, depth), np.flatnonzero(ascending & part), depth)
    induced = np.flatnonzero(part & ~ascending)
    letters, reach = text[induced], reach[induced]
    behind = np.bincount(letters, minlength=256)  # type A suffixes come first in their bucket
    ahead = np.bincount(text[direct], minlength=256)
    below = np.concatenate([[0], np.cumsum(behind + ahead)])
    rank = np.empty(n, kind)
    # direct suffixes are in order, so their letters ascend
    rank[direct] = np.arange(len(direct)) + np.repeat(np.cumsum(behind), ahead)

    order = np.argsort(letters.astype(np.uint16) << 8 | reach.astype(np.uint16), kind="stable") if not len(reach) or reach.max() < 256 else np.lexsort((reach, letters))
    induced, letters, reach = induced[order], letters[order], reach[order]
    heads = np.concatenate([[0], np.cumsum(behind)])
    at = _groups(letters, reach)
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(induced)]):
        some, letter = induced[i:j], letters[i]
        some = some[np.argsort(rank[some + 1])]
        rank[some] = below[letter] + (i - heads[letter]) + np.arange(len(some))
    out = np.empty(len(direct) + len(induced), np.int64)
    for places in (direct, induced):
        out[rank[places]] = places
    return out if wanted is None else out[wanted[out]]


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """The common prefix length, up to depth, of each suffix in `order` with the one before it (the first: 0)."""
    words, out = _words(text, depth), np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for j in range(-(-depth // 8)):
        x = (words[order[going] + 8 * j] ^ words[order[going - 1] + 8 * j]).astype(np.uint64)
        same = np.where(x == 0, 8, 0)
        some = x != 0
        same[some] = 7 - (np.frexp(x[some].astype(np.float64))[1] - 1).clip(0, 63) // 8
        out[going] += same
        going = going[~some]
    return np.minimum(out, depth)


def _by_text(table: pa.Table) -> pa.Table:
    """Contexts with their text: windows that agree in LENGTH bytes go to the smallest document; the rest is cut."""
    table = table.combine_chunks()
    doc, tag, start = (table.column(c).to_numpy() for c in ("doc", "tag", "start"))
    data, offsets = column_bytes(table.column("context").combine_chunks().cast(pa.large_binary()).view(pa.large_string()))
    sizes = np.diff(offsets)
    # contexts one after another, a zero byte behind each
    end = offsets[1:] + np.arange(len(sizes))
    begin, n = end - sizes, len(data) + len(sizes)
    inside = np.ones(n, bool)
    inside[end] = False
    text = np.zeros(n + 64, np.uint8)
    text[:n][inside] = data
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    wanted = np.zeros(n + 64, bool)
    wanted[:n] = np.arange(LENGTH, LENGTH + n) <= np.repeat(end, sizes + 1)
    order = suffix_order(text, wanted=wanted)
    group = np.cumsum(common_prefixes(text, order) < LENGTH) - 1
    docs_ = doc[owner[order]]
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    least = np.minimum.reduceat(docs_, at)[group - group[0]] if len(at) else docs_
    gone = np.sort(order[docs_ > least])
    heads = np.flatnonzero(np.r_[True, (np.diff(gone) > 1)]) if len(gone) else gone  # contexts are apart by more than a window
    first = gone[heads]
    who = owner[first]
    return pa.table({"doc": doc[who], "tag": tag[who], "cut": cut_of(start[who] + first - begin[who], np.diff(np.r_[heads, len(gone)]))})


def dealt(total: int, parts: int, limits: Limits = LIMITS) -> tuple[int, int]:
    """Buckets of anchors and homes of documents; each batch of texts sends a piece to each bucket, so more cost more."""
    homes = max(total // limits.bucket, parts)
    return max(homes, min(4 * parts, limits.few)), homes


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = LIMITS) -> DataFrame:
    """(doc, tag, cuts array<long>): the removed intervals of each document that loses bytes."""
    common, total = common_grams(docs, text_col, limits)
    buckets, homes = dealt(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), limits)
    tagged = docs.select(F.col(id_col).cast("long").alias("doc"), tag_of(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))

    contexts = _contexts(docs, common, buckets, id_col, text_col, limits)
    hashed = contexts.groupBy("bucket").applyInArrow(lambda t: _by_hash(t, homes), "home int, blob binary")
    told = hashed.groupBy("home").applyInArrow(_by_home, "doc long, tag long, cuts array<long>, grams array<long>, places array<long>")
    told = stored(told, "settled")
    places = told.filter(F.size("places") > 0).select("doc", "tag", "grams", "places")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = column_bytes(b.column(2))
            doc, tag = (b.column(i).to_numpy() for i in (0, 1))
            gram, cut = (b.column(i).flatten().to_numpy() for i in (3, 4))
            row = np.repeat(np.arange(len(doc)), np.diff(b.column(3).offsets.to_numpy()))
            for i in range(0, len(row), limits.cut):
                own = slice(i, i + limits.cut)
                r, (start, size) = row[own], stretch_of(cut[own])
                text, sizes = cut_out(data, offsets[r] + start, size)
                context = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(np.cumsum(np.r_[0, sizes], dtype=np.int32)), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (gram[own], doc[r], tag[r], start)), context], names=["gram", "doc", "tag", "start", "context"])

    fetched = tagged.join(places.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "grams", "places").mapInArrow(tidy(fetch), "gram long, doc long, tag long, start long, context binary")
    texts = fetched.withColumn("bucket", F.pmod("gram", F.lit(buckets))).groupBy("bucket").applyInArrow(_by_text, "doc long, tag long, cut long")
    cuts = told.filter(F.size("cuts") > 0).select("doc", "tag", "cuts").unionByName(stored(texts, "by-text").select("doc", "tag", F.array("cut").alias("cuts")))
    return stored(cuts.groupBy("doc", "tag").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "cuts")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """Each row's columns with n_bytes, n_removed, n_spans, kept_sha256; with_text: and kept_text.

    Bytes are cut wherever the windows end; kept_text leaves out the pieces of letters that a cut has split.
    """
    found = removed(docs, id_col, text_col, limits)
    tag = tag_of(F.col(text_col))
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
    kept = without(docs, made) if with_text else [id_col]
    doc_, tag_, cuts_, text_ = (unused(docs, x) for x in ("own_doc", "own_tag", "own_cuts", "own_text"))
    own = found.select(F.col("doc").alias(doc_), F.col("tag").alias(tag_), F.col("cuts").alias(cuts_)).hint("shuffle_hash")
    rows = docs.join(own, (F.col(id_col).cast("long") == F.col(doc_)) & (tag == F.col(tag_)), "left").select(*kept, F.col(text_col).alias(text_), cuts_)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = column_bytes(b.column(len(kept)))
            cuts = b.column(len(kept) + 1)
            out = []
            for k, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                raw = data[i:j]
                if cuts[k].is_valid:
                    start, size = stretch_of(np.sort(cuts[k].values.to_numpy()))
                    start, end = _merged(start, start + size)
                    stay = np.ones(len(raw), bool)
                    for x, y in zip(start.tolist(), end.tolist()):
                        stay[x:y] = False
                    left, gone, spans = raw[stay].tobytes(), int((end - start).sum()), len(start)
                else:
                    left, gone, spans = raw.tobytes(), 0, 0
                out.append((j - i, gone, spans, hashlib.sha256(left).hexdigest(), *[left.decode("utf-8", "ignore")] * with_text))
            cols = list(zip(*out)) or [()] * len(made)
            kinds = [pa.int64()] * 3 + [pa.string()] * (len(made) - 3)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*kept, *made])

    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(c, T.LongType()) for c in made[:3]), *(T.StructField(c, T.StringType()) for c in made[3:])])
    return rows.mapInArrow(tidy(stage), schema)
