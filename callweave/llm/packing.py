"""Hierarchical multi-length packing.

Documents become token ids, whole windows of the largest size go out at once, and what is left of a document is
routed to the smallest context tier that holds it. Each tier's windows are packed from the longest down: a window
opens with a piece of its own tier, and its gap is filled from shorter tiers, best fit first; only the last gap of a
window cuts a piece. What fills no window when a partition ends is put end to end into windows of the largest size;
less than one window stays. Those rests of all partitions, POOLED partitions at a time, are packed the same way in a
second stage, and only what then stays, less than a window for POOLED partitions, is cut at powers of two. So no
sequence needs padding, and the share of short sequences does not depend on how the input is split.

Sequences of a tier are numbered over all partitions (by counts, not by collecting them), and every `step_group` of a
tier but its last holds the same number of tokens (STEP_TOKENS), so that steps cost alike.

Packing runs inside the partitions that the scan already has: ids are not shuffled (but for the rests) and don't pass
the driver; memory is bounded by POOL_TOKENS, however many rows share a key. A partition's result depends on its rows in
order only, so a task that is run again gives the same pieces.

Defined cases: null text counts as empty, so the document is its end id alone; repeated rows are packed as often as
they occur; rows without id are packed with a null one; very long texts are cut into whole windows as they come; columns
beside id and text are not read, so their names don't matter; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters
from .common import stored, tidy
from .hashing import column_bytes, slices

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32 * 2048
POOL_TOKENS = 1 << 20
#: Partitions whose rests, less than a window each, meet in one task.
POOLED = 1024
#: Rows of the table of sequence counts (partitions times tiers) that are sent to all tasks, at most.
BROADCAST = 1 << 20
END_ID = 1
#: Words that the library has encoded and a task remembers, and bytes of text that are encoded together, so that each of their words is merged once; only speed depends on them.
CACHE, TOGETHER = 100_000, 1 << 23

_TOKENIZERS: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Ids of texts under a vocabulary that drops white space and never joins over it (word_bpe kind).

    Such a tokenizer encodes each blank-separated word by itself, so each word of the texts given is encoded once. Plain
    Latin words, with or without marks after them, are merged here, all at once; any other word goes to the library,
    once for as long as it is remembered.
    """

    #: Letters that lower-casing and composing leave one letter each (no dotted capital I), then plain marks.
    PLAIN = "^(?P<body>[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u0148\u014A-\u017E]+)(?P<marks>[.,!?;:]*)$"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        spec = whole["model"]
        kinds = [x["type"] for x in (whole["normalizer"] or {}).get("normalizers", [])]
        if kinds != ["NFC", "Replace", "Lowercase"] or not spec.get("end_of_word_suffix") or spec.get("unk_token") or any(x[k] for x in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is not a word BPE vocabulary that lower-cases and drops white space")
        vocab, letters = spec["vocab"], byte_letters()
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["merges"]]
        self.merges = MergeTable([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.final = np.array([vocab[c + spec["end_of_word_suffix"]] for c in letters], np.int32)
        if max(self.inner.max(), self.final.max()) >= _LETTERS:
            raise ValueError(f"{path} does not begin with its letters")
        self.cache: dict[str, bytes] = {}

    def _merge(self, words: pa.Array) -> pa.Array:
        """Ids of words, none of them empty, as bytes."""
        if not len(words):
            return pa.array([], pa.binary())
        _, at, data = words.buffers()
        bounds = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data, ends = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds[1:] - bounds[0]
        ids = self.inner[data]
        ids[ends - 1] = self.final[data[ends - 1]]
        merged, ends = self.merges.apply(ids, np.diff(bounds))
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(np.r_[0, ends * 4].astype(np.int32)), pa.py_buffer(merged)])

    def _known(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, as bytes. Words that differ in case or marks alone share the work on their letters."""
        parts = pc.extract_regex(words, self.PLAIN)
        plain = parts.is_valid()
        found = parts.filter(plain)
        body, marks = pc.utf8_lower(found.field("body")).dictionary_encode(), found.field("marks").dictionary_encode()
        heads = self._merge(body.dictionary).take(body.indices)
        ends = marks.dictionary
        some = pc.not_equal(ends, "")
        tails = pc.replace_with_mask(pa.array([b""] * len(ends), pa.binary()), some, self._merge(ends.filter(some))).take(marks.indices)
        other = words.filter(pc.invert(plain)).to_pylist()
        strange = [w for w in other if w not in self.cache]
        if len(self.cache) + len(strange) > CACHE:
            self.cache, strange = {}, other
        for e, w in zip(self.library.encode_batch_fast(strange, add_special_tokens=False), strange):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()
        known = self.cache
        whole = pc.binary_join_element_wise(heads, tails, pa.scalar(b"", pa.binary()))
        both = pa.concat_arrays([whole, pa.array([known[w] for w in other], pa.binary())])
        mask = plain.to_numpy(zero_copy_only=False)
        at = np.empty(len(words), np.int64)
        at[mask], at[~mask] = np.arange(len(whole)), np.arange(len(whole), len(words))
        return both.take(pa.array(at))

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, END_ID last."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        found = self._known(coded.dictionary).take(coded.indices)
        bounds = np.asarray(split.offsets).astype(np.int64)
        bounds = bounds - bounds[0]
        _, at, data = found.buffers()
        ends = np.frombuffer(at, np.int32)[: len(found) + 1][bounds] // 4 if len(found) else np.zeros(len(bounds), np.int64)
        ids = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
        last = np.array([END_ID], "<u4")
        return [np.concatenate([ids[s:e], last]) for s, e in zip(ends.tolist(), ends[1:].tolist())]


#: Ids of letters, inside and at the end of a word, are the first ones of such a vocabulary.
_LETTERS = 512


class MergeTable:
    """BPE merges by sweeps: each applies, in every word, the word's lowest active rank to all its places."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        codes = np.array([a << 17 | b for a, b, _ in merges], np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks, self.made = codes[order], order.astype(np.int32), np.array([c for *_, c in merges], np.int32)
        self.none = len(merges)
        letters = np.arange(_LETTERS, dtype=np.int32)
        self.of_letters = self.rank(*(x.ravel() for x in np.meshgrid(letters, letters, indexing="ij"))).astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        codes = left.astype(np.int64) << 17 | right
        at = np.minimum(np.searchsorted(self.codes, codes), self.none - 1)
        return np.where(self.codes[at] == codes, self.ranks[at], self.none)

    def apply(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of the ids of words of these sizes, and where each word ends there. Ids of letters are below _LETTERS."""
        n, word = len(ids), np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = n  # n: none
        before[ends - sizes] = -1
        ids = np.append(ids, 0)
        rank = np.full(n + 1, self.none, np.int32)
        inner = np.flatnonzero(after < n)
        rank[inner] = self.of_letters[ids[inner] * _LETTERS + ids[inner + 1]]
        gone = np.zeros(n, bool)
        active = inner[rank[inner] < self.none]
        while len(active):
            lowest = np.full(len(sizes), self.none, np.int32)
            np.minimum.at(lowest, word[active], rank[active])
            p = active[rank[active] == lowest[word[active]]]
            if len(p) > 1:  # in a run like aaaa every second place counts, from the left
                chained = np.r_[False, (after[p[:-1]] == p[1:]) & (ids[p[:-1]] == ids[after[p[:-1]]])]
                index = np.arange(len(p))
                p = p[(index - np.maximum.accumulate(np.where(chained, 0, index))) % 2 == 0]
            j = after[p]
            ids[p] = self.made[rank[p]]
            gone[j] = True
            rank[j] = self.none
            k = after[j]
            after[p] = k
            inside = k < n
            before[k[inside]] = p[inside]
            rank[p] = np.where(inside, self.rank(ids[p], ids[k]), self.none)
            q = p[before[p] >= 0]
            h = before[q]
            rank[h] = self.rank(ids[h], ids[q])
            active = np.concatenate([active, h, p])
            active = np.sort(active[rank[active] < self.none])
            active = active[np.diff(active, prepend=-1) > 0]
        left = ~gone
        return ids[:n][left].astype("<u4"), np.cumsum(np.add.reduceat(left, ends - sizes, dtype=np.int64))


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class Piece:
    __slots__ = ("doc", "ids", "start", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids)

    def split(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Packer:
    """Packs one partition; `out` collects (sequence number, tier, number in its tier, pieces), `rest` what fills no window."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, pool_tokens: int = POOL_TOKENS):
        self.tiers, self.pool_tokens = tiers, pool_tokens
        self.pools: dict[int, list[tuple[int, int, Piece]]] = {t: [] for t in tiers}  # sorted by (length, arrival)
        self.pending = self.arrivals = self.sequences = 0
        self.per_tier: dict[int, int] = {}
        self.out: list[tuple[int, int, int, list[Piece]]] = []
        self.rest: list[Piece] = []

    def add(self, piece: Piece) -> None:
        most = self.tiers[-1]
        while len(piece) >= most:
            window, piece = piece.split(most)
            self._emit(most, [window])
        self._route(piece)
        if self.pending > self.pool_tokens:
            self.pack()

    def finish(self, cut: bool) -> None:
        """Pack everything; what is left goes end to end into the largest windows, and the rest of that is cut or kept."""
        self.pack()
        most, window, room = self.tiers[-1], [], self.tiers[-1]
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                piece = self._take(tier, -1)
                if len(piece) >= room:
                    head, piece = piece.split(room)
                    self._emit(most, [*window, head])
                    window, room = [], most
                if len(piece):
                    window.append(piece)
                    room -= len(piece)
        self.rest = window
        if cut:
            self._cut_down(most - room)

    def pack(self) -> None:
        for tier in reversed(self.tiers):
            waiting: list[Piece] = []
            while self.pools[tier]:
                piece = self._take(tier, -1)
                window, gap = [piece], tier - len(piece)
                while gap and (more := self._fill(tier, gap)) is not None:
                    window.append(more)
                    gap -= len(more)
                if gap:  # nothing shorter is left: wait for more documents
                    waiting += window
                    break
                self._emit(tier, window)
            for piece in waiting:
                self._route(piece)

    def _fill(self, tier: int, gap: int) -> Piece | None:
        """The longest whole piece of a shorter tier (or the lowest tier itself) that fits, else the head of a longer one."""
        lower = [t for t in self.tiers if t < tier] or [tier]
        for t in reversed(lower):
            if (at := bisect_right(self.pools[t], gap, key=lambda x: x[0])) > 0:
                return self._take(t, at - 1)
        for t in lower:
            if self.pools[t]:
                head, rest = self._take(t, -1).split(gap)
                self._route(rest)
                return head
        return None

    def _cut_down(self, left: int) -> None:
        """The rest, end to end, as one sequence for each power of two in its length."""
        pieces, self.rest = self.rest[::-1], []
        while left:
            size = room = 1 << (left.bit_length() - 1)
            sequence = []
            while room:
                piece = pieces.pop()
                if len(piece) > room:
                    piece, later = piece.split(room)
                    pieces.append(later)
                sequence.append(piece)
                room -= len(piece)
            self._emit(size, sequence)
            left -= size

    def _route(self, piece: Piece) -> None:
        if len(piece):
            tier = next(t for t in self.tiers if len(piece) <= t)
            self.arrivals += 1
            insort(self.pools[tier], (len(piece), self.arrivals, piece))
            self.pending += len(piece)

    def _take(self, tier: int, at: int) -> Piece:
        n, _, piece = self.pools[tier].pop(at)
        self.pending -= n
        return piece

    def _emit(self, tier: int, pieces: list[Piece]) -> None:
        k = self.per_tier[tier] = self.per_tier.get(tier, -1) + 1
        self.out.append((self.sequences, tier, k, pieces))
        self.sequences += 1


#: Sequence ids of the second stage start here.
_LATER = 1 << 22


class _Rows:
    """Pieces as Arrow rows; rests carry their ids and no sequence."""

    NAMES = ("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "part", "serial", "rest")
    KINDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, part long, serial long, rest binary"

    def __init__(self, part: int, with_ids: bool):
        self.part, self.with_ids = part, with_ids

    def of(self, packer: Packer, doc_type: pa.DataType) -> pa.RecordBatch:
        part, base, found = self.part, self.part << 40, []
        for number, tier, k, pieces in packer.out:
            offset = 0
            for p in pieces:
                raw = p.ids.tobytes()
                found.append((p.doc, p.start, len(raw) // 4, zlib.crc32(raw), p.total, base | number, offset, tier, part, k, None, *[p.ids] * self.with_ids))
                offset += len(raw) // 4
        for k, p in enumerate(packer.rest):
            found.append((p.doc, p.start, len(p), 0, p.total, None, 0, 0, part, k, p.ids.tobytes(), *[None] * self.with_ids))
        packer.out, packer.rest = [], []
        names = [*self.NAMES, *["ids"] * self.with_ids]
        kinds = [doc_type, *[pa.int64()] * 6, pa.int32(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int32())] * self.with_ids]
        columns = list(zip(*found)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _gathered(batches: Iterator[pa.RecordBatch], together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows in order, so many in a batch that their texts have about `together` bytes, however Spark has dealt them."""
    held, size = [], 0
    for b in batches:
        for s, e in slices(b.column(1), together):
            part = b.slice(s, e - s)
            n = len(column_bytes(part.column(1))[0])
            if held and size + n > together:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, pooled: int = POOLED) -> DataFrame:
    """One row per piece: doc, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (and ids).

    step_group is unique within its tier; sequence_id is unique in the result.
    """
    schema = f"doc {docs.schema[id_col].dataType.simpleString()}, {_Rows.KINDS}" + ", ids array<int>" * with_ids

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer, rows = word_tokenizer(path), Packer(), _Rows(TaskContext.get().partitionId(), with_ids)
        doc_type = None
        for b in _gathered(batches):
            doc_type = b.column(0).type
            for doc, tokens in zip(b.column(0).to_pylist(), tokenizer.encode(b.column(1))):
                packer.add(Piece(doc, 0, tokens, len(tokens)))
            if packer.out:
                yield rows.of(packer, doc_type)
        packer.finish(cut=False)
        if packer.out or packer.rest:
            yield rows.of(packer, doc_type)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, rows, doc_type = Packer(), _Rows(_LATER + TaskContext.get().partitionId(), with_ids), None
        for b in batches:
            doc_type = b.column(0).type
            for doc, start, total, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                packer.add(Piece(doc, start, np.frombuffer(raw, "<u4"), total))
            if packer.out:
                yield rows.of(packer, doc_type)
        packer.finish(cut=True)
        if packer.out:
            yield rows.of(packer, doc_type)

    first = stored(docs.select(id_col, text_col).mapInArrow(tidy(stage), schema), "pieces")
    rests = first.filter(F.col("rest").isNotNull())
    parts = rests.agg(F.max("part")).first()[0]
    pieces = first.filter(F.col("rest").isNull())
    if parts is not None:
        block = F.floor(F.col("part") / pooled)
        dealt = rests.repartition(parts // pooled + 1, block).sortWithinPartitions("part", "serial").select("doc", "start", "doc_tokens", "rest")
        pieces = pieces.unionByName(stored(dealt.mapInArrow(tidy(later), schema), "rest-pieces"))
    counts = stored(pieces.filter("offset = 0").groupBy("tier", "part").agg(F.count("*").alias("n")), "sequence-counts")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select("tier", "part", before.alias("before")).hint("broadcast" if counts.count() <= BROADCAST else "shuffle_hash")
    group = (F.floor((F.col("before") + F.col("serial")) / F.greatest(F.floor(F.lit(STEP_TOKENS) / F.col("tier")), F.lit(1)))).cast("long")
    placed = pieces.join(places, ["tier", "part"]).withColumn("step_group", F.shiftleft(F.col("tier").cast("long"), 40).bitwiseOR(group))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
    return placed.select(F.col("doc").alias(id_col), *names, *["ids"] * with_ids)
