"""Substring dedup by suffix automata: remove every word covered by a window of 13 words that also starts in a document with a smaller id.

1. Candidates. Each window's anchor is the least hash of its 5-word grams; neighbouring windows with one anchor form a
   context. Contexts equal as a whole (128 bits with the anchor) name the smallest document as their reference. Where one
   anchor has several contexts in several documents, the smallest document of each gives the hashes of its single windows
   (128 bits), and those name references in the same way. Within a batch this happens before the shuffle, so a passage in a
   third of all documents is sent once a batch. This decides only what is held against what.
2. Reference shards. The stretches of documents that others refer to are dealt into shards by document, of about
   `Limits.shard` words, and each shard becomes one suffix automaton whose states know the smallest document they occur in.
3. Matching statistics. The stretches that have a reference are streamed, word by word, through the automaton of its
   shard: it is sent to every task that streams against the shard, and a shard that many documents refer to is streamed
   by as many tasks as its words need. Where the match is 13 words long and its state lies in a smaller document, the window
   goes. So every removed word has been read in both texts; hashes only miss a window if 128 bits collide.
4. Windows of a document are merged and cut.

Whole texts are joined by id and a 60-bit digest of the text, so rows of one id are judged each by its own text. Nothing
passes the driver but the number of reference words. Everything between the steps lies in the shared folder.

Defined cases: null and empty texts have no words; a row without doc_id neither loses words nor makes others lose any; rows
of one doc_id are never judged against each other; texts of fewer than 13 words lose nothing; ids must be whole numbers
(others raise); columns beside id and text are not read, so their names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, tag_of
from .hashing import column_bytes, mixed, slices, words_hash

WINDOW, GRAM = 13, 5


@dataclass(frozen=True)
class Limits:
    """Sizes that steer the work and never a result."""

    #: Words of an automaton, and words that one task streams through it, about.
    shard: int = 1 << 16
    stream: int = 1 << 18
    #: Windows of a piece of text at most.
    piece: int = 1 << 9
    #: Bytes of text that are hashed at once, and whose contexts are settled together.
    run: int = 1 << 19
    sent: int = 1 << 22


LIMITS = Limits()

_DEALT = "one long, two long, doc long, tag long, at long, ref long, ref_tag long, ref_at long"


def _word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts one after another, and the number of words before each text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(~space & (np.r_[True, space[:-1]][: len(data)] | edge[:-1]))
    ends = np.flatnonzero(~space & (np.r_[space[1:], True][: len(data)] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _rolled(words: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A hash of the `size` words from each place on."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, salt, np.uint64)
    for j in range(size):
        out = mixed(out + words[j : j + n], salt)
    return out


class Contexts:
    """Windows of a run of texts: two hashes each, and contexts of windows with one anchor: anchor, hash, row, first window, windows."""

    def __init__(self, texts: pa.Array):
        data, offsets = column_bytes(texts)
        starts, ends, before = _word_bounds(data, offsets)
        one, two = words_hash(data, starts, ends)
        row = np.repeat(np.arange(len(texts)), np.diff(before))
        n = max(0, len(starts) - WINDOW + 1)
        inside = np.flatnonzero(row[:n] == row[WINDOW - 1 :]) if n else np.zeros(0, np.int64)
        self.window = [_rolled(x, WINDOW, 3 + k)[inside] for k, x in enumerate((one, two))]
        self.row, self.place = row[inside], inside - before[row[inside]]
        grams = _rolled(one, GRAM, 7)
        span = WINDOW - GRAM + 1
        near = np.lib.stride_tricks.sliding_window_view(grams, span)[inside] if n else np.zeros((0, span), np.uint64)
        anchor = inside + near.argmin(axis=1) if n else inside
        fresh = np.ones(len(inside), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (np.diff(inside) > 1)
        self.first = np.flatnonzero(fresh)
        self.run = np.diff(np.r_[self.first, len(inside)])
        self.gram = grams[anchor[self.first]]
        at = np.arange(len(inside)) - np.repeat(self.first, self.run)
        terms = mixed(self.window[1] + mixed(at.astype(np.uint64), 5), 6)
        self.context = np.add.reduceat(terms, self.first) if len(terms) else terms


def _settled(one: np.ndarray, two: np.ndarray, doc: np.ndarray, tag: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """Rows by (one, two): what a smaller document of the batch has already refers to it and is dealt by its own document."""
    order = np.lexsort((at, doc, two, one))
    one, two, doc, tag, at = (x[order] for x in (one, two, doc, tag, at))
    fresh = np.ones(len(one), bool)
    fresh[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(one)), 0))
    refers = doc > doc[head]
    one, two = np.where(refers, mixed(doc.astype(np.uint64)), one), np.where(refers, at.astype(np.uint64), two)
    refs = [pa.array(x[head], pa.int64(), mask=~refers) for x in (doc, tag, at)]
    return pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (one, two)), *(pa.array(x.astype(np.int64)) for x in (doc, tag, at)), *refs], names=[x.split()[0] for x in _DEALT.split(", ")])


def _dealt(batches: Iterator[pa.RecordBatch], limits: Limits, rows_of) -> Iterator[pa.RecordBatch]:
    """Rows of (doc, tag, text, ...) batches by rows_of(batch slice), settled after some MB of text."""
    for b in batches:
        held, size = [], 0
        for s, e in slices(b.column(2), limits.run):
            part = b.slice(s, e - s)
            held.append(rows_of(part))
            size += int(column_bytes(part.column(2))[1][-1])
            if size >= limits.sent or e == b.num_rows:
                yield _settled(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0


def _contexts(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Contexts of texts; at: first window << 8 | number of windows."""
    c = Contexts(part.column(2))
    doc, tag = (part.column(i).to_numpy() for i in (0, 1))
    row = c.row[c.first]
    return c.gram, c.context, doc[row], tag[row], c.place[c.first] << 8 | c.run


def _windows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The single windows of texts that lie in the contexts listed in the last column."""
    c = Contexts(part.column(2))
    doc, tag = (part.column(i).to_numpy() for i in (0, 1))
    lists = part.column(3)
    counts = np.diff(lists.offsets.to_numpy())
    at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    texts = np.searchsorted(c.row, np.arange(part.num_rows + 1))  # the windows of each text are its places 0, 1, ...
    first, run = np.repeat(texts[:-1], counts) + (at >> 8), at & 255
    chosen = np.repeat(first, run) + np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)
    row = c.row[chosen]
    return c.window[0][chosen], c.window[1][chosen], doc[row], tag[row], c.place[chosen] << 8 | 1


def _firsts(dealt: DataFrame) -> DataFrame:
    """dealt with the smallest document of each (one, two) as `first`."""
    return dealt.withColumn("first", F.first(F.struct("doc", "tag", "at")).over(Window.partitionBy("one", "two").orderBy("doc", "tag", "at")))


_QUERY = ("doc", "tag", "at", "ref", "ref_tag", "ref_at")


def _referring(rows: DataFrame) -> DataFrame:
    """(doc, tag, at, ref, ref_tag, ref_at) of rows of `_firsts` that a smaller document has; ref is null for the others."""
    later = F.col("ref").isNull() & (F.col("doc") > F.col("first.doc"))
    pick = lambda own, of: F.when(later, F.col(f"first.{of}")).otherwise(F.col(own)).alias(own)
    return rows.select("doc", "tag", "at", pick("ref", "doc"), pick("ref_tag", "tag"), pick("ref_at", "at"))


def references(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(doc, tag, at, ref, ref_tag, ref_at): contexts and windows that a smaller document has, and where; rows: (doc, tag, text)."""
    dealt = rows.mapInArrow(lambda batches: _dealt(batches, limits, _contexts), _DEALT).repartition("one")
    by_gram = Window.partitionBy("one")
    several = (F.min("two").over(by_gram) != F.max("two").over(by_gram)) & (F.min("doc").over(by_gram) != F.max("doc").over(by_gram))
    found = _referring(_firsts(dealt).withColumn("several", several).filter("ref IS NOT NULL OR doc > first.doc OR several"))
    found = stored(found, "contexts")
    still = found.filter("ref IS NULL").groupBy("doc", "tag").agg(F.collect_list("at").alias("places"))
    texts = rows.join(still.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "places")
    windows = _referring(_firsts(texts.mapInArrow(lambda batches: _dealt(batches, limits, _windows), _DEALT)))
    return found.filter("ref IS NOT NULL").unionByName(stored(windows.filter("ref IS NOT NULL"), "windows"))


class Automaton:
    """A suffix automaton of word lists, each with a document; states know the smallest document they occur in."""

    def __init__(self, link: np.ndarray, length: np.ndarray, least: np.ndarray, states: np.ndarray, words: np.ndarray, nexts: np.ndarray, vocabulary: dict[bytes, int]):
        """states, words, nexts: transitions in order of state, then word."""
        self.link, self.length, self.least, self.words, self.nexts, self.vocabulary = link, length, least, words, nexts, vocabulary
        self.first = np.searchsorted(states, np.arange(len(link) + 1))
        self.width = len(vocabulary) + 1
        self.keys = states * self.width + words

    @staticmethod
    def of(texts: list[list[bytes]], docs: list[int]) -> Automaton:
        vocabulary: dict[bytes, int] = {}
        link, length, nexts, least = [-1], [0], [{}], [docs[0] if docs else 0]
        last, mark = 0, 1 << 40  # behind each text stands a mark of its own, so no match runs over an end
        for text, doc in zip(texts, docs):
            mark += 1
            for w in [*(vocabulary.setdefault(x, len(vocabulary)) for x in text), mark]:
                state = len(link)
                length.append(length[last] + 1)
                nexts.append({})
                link.append(0)
                least.append(doc)
                at = last
                while at >= 0 and w not in nexts[at]:
                    nexts[at][w] = state
                    at = link[at]
                if at >= 0:
                    to = nexts[at][w]
                    if length[to] == length[at] + 1:
                        link[state] = to
                    else:
                        twin = len(link)
                        length.append(length[at] + 1)
                        nexts.append(dict(nexts[to]))
                        link.append(link[to])
                        least.append(least[to])
                        link[to] = link[state] = twin
                        while at >= 0 and nexts[at].get(w) == to:
                            nexts[at][w] = twin
                            at = link[at]
                last = state
        for state in np.argsort(-np.array(length), kind="stable").tolist()[:-1]:  # a state occurs wherever those it is the suffix of do
            if least[state] < least[link[state]]:
                least[link[state]] = least[state]
        moves = np.array([(s, w, t) for s, x in enumerate(nexts) for w, t in sorted(x.items()) if w < 1 << 40], np.int64).reshape(-1, 3)
        return Automaton(np.array(link), np.array(length), np.array(least), *moves.T, vocabulary)

    def packed(self) -> bytes:
        """All arrays and the vocabulary, compressed."""
        states = np.repeat(np.arange(len(self.link)), np.diff(self.first))
        arrays = [x.astype(k) for x, k in ((self.link, np.int32), (self.length, np.int32), (self.least, np.int64), (np.diff(states, prepend=0), np.int32), (self.words, np.int32), (self.nexts - states, np.int32))]
        head = np.array([len(self.link), len(states)], np.int64)
        return zstandard.compress(b"".join(x.tobytes() for x in (head, *arrays)) + b" ".join(self.vocabulary), 1)

    @staticmethod
    def unpacked(blob: bytes) -> Automaton:
        raw = zstandard.decompress(blob)
        (n, m), at, parts = np.frombuffer(raw, np.int64, 2).tolist(), 16, []
        for kind, size in ((np.int32, n), (np.int32, n), (np.int64, n), (np.int32, m), (np.int32, m), (np.int32, m)):
            parts.append(np.frombuffer(raw, kind, size, at).astype(np.int64))
            at += size * np.dtype(kind).itemsize
        link, length, least, steps, words, ahead = parts
        states = np.cumsum(steps)
        return Automaton(link, length, least, states, words, ahead + states, {w: i for i, w in enumerate(raw[at:].split())})

    def _move(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is no transition."""
        if not len(self.keys):
            return np.full(len(state), -1)
        at = np.minimum(np.where(self.first[state + 1] - self.first[state] == 1, self.first[state], np.searchsorted(self.keys, state * self.width + word)), len(self.keys) - 1)
        return np.where(self.keys[at] == state * self.width + word, self.nexts[at], -1)

    def windows(self, texts: list[list[bytes]], docs: np.ndarray) -> list[np.ndarray]:
        """For each text the places of windows that a document smaller than its own has, by matching statistics; all texts at once, a word a step."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        missing = len(self.vocabulary)
        words = np.fromiter((self.vocabulary.get(w, missing) for k in order.tolist() for w in texts[k]), np.int64, int(sizes.sum()))
        sizes, docs = sizes[order], docs[order]
        offsets = np.cumsum(sizes) - sizes
        state, length = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        hits: list[tuple[np.ndarray, int]] = []
        for step in range(int(sizes.max(initial=0))):
            n = int(np.searchsorted(-sizes, -step, "left"))  # texts longer than step come first
            going = np.arange(n)
            while len(going):
                word = words[offsets[going] + step]
                to = self._move(state[going], word)
                went = to >= 0
                state[going[went]], length[going[went]] = to[went], length[going[went]] + 1
                going = going[~went]
                length[going[state[going] == 0]] = 0
                going = going[state[going] != 0]
                state[going] = self.link[state[going]]
                length[going] = self.length[state[going]]
            long = np.flatnonzero(length[:n] > WINDOW)  # a match counts up to its last WINDOW words
            while len(long):
                shorter = self.length[self.link[state[long]]] >= WINDOW
                length[long[~shorter]] = WINDOW
                long = long[shorter]
                state[long] = self.link[state[long]]
            hit = np.flatnonzero((length[:n] >= WINDOW) & (self.least[state[:n]] < docs[:n]))
            if len(hit):
                hits.append((hit, step - WINDOW + 1))
        found: list[list[int]] = [[] for _ in texts]
        for hit, at in hits:
            for k in order[hit].tolist():
                found[k].append(at)
        return [np.array(x, np.int64) for x in found]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals that cover the same; touching ones become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[fresh], reach[np.r_[fresh[1:], len(start)] - 1]


def _cut_out(batches: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """(shard, refers, doc, tag, start, n_words, words): the stretches that places name, in pieces that overlap by less than a window."""
    names = ["shard", "refers", "doc", "tag", "start", "n_words", "words"]
    for b in batches:
        for i in range(b.num_rows):
            words = (b.column(2)[i].as_py() or "").encode().split()
            places = b.column(3)[i].values
            at, shard, refers = (places.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            out = []
            for kind in sorted(set(zip(shard.tolist(), refers.tolist()))):
                own = at[(shard == kind[0]) & (refers == kind[1])]
                for s, e in zip(*(x.tolist() for x in _merged(own >> 8, (own >> 8) + (own & 255)))):
                    for a in range(s, e, limits.piece):
                        piece = words[a : min(a + limits.piece, e) + WINDOW - 1]
                        out.append((*kind, a, len(piece), b" ".join(piece)))
            cols = list(zip(*out))
            doc, tag = (pa.array([b.column(k)[i].as_py()] * len(out), pa.int64()) for k in (0, 1))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            shard_, refers_, start_, n_, words_ = (pa.array(c, k) for c, k in zip(cols, kinds))
            yield pa.RecordBatch.from_arrays([shard_, refers_, doc, tag, start_, n_, words_], names=names)


def _build(table: pa.Table) -> pa.Table:
    """One shard's automaton."""
    table = table.sort_by([("doc", "ascending"), ("tag", "ascending"), ("start", "ascending")])
    built = Automaton.of([w.split() for w in table.column("words").to_pylist()], table.column("doc").to_pylist())
    return pa.table({"shard": table.column("shard").slice(0, 1), "automaton": pa.array([built.packed()], pa.binary())})


def _stream(queries: pa.Table, automata: pa.Table) -> pa.Table:
    """(doc, tag, start, n): runs of windows that go, of the stretches dealt to one task."""
    out = [np.zeros((4, 0), np.int64)]
    if queries.num_rows:
        automaton = Automaton.unpacked(automata.column("automaton")[0].as_py())
        doc, tag, start = (queries.column(c).to_numpy() for c in ("doc", "tag", "start"))
        for k, at in enumerate(automaton.windows([w.split() for w in queries.column("words").to_pylist()], doc)):
            if len(at):
                heads = np.flatnonzero(np.r_[True, np.diff(at) > 1])
                n = np.diff(np.r_[heads, len(at)])
                out.append(np.stack([np.full(len(heads), doc[k]), np.full(len(heads), tag[k]), start[k] + at[heads], n]))
    return pa.table(dict(zip(("doc", "tag", "start", "n"), np.concatenate(out, axis=1))))


def removed(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(doc, tag, cuts array<struct<start,n>>): the runs of windows that each document loses; rows: (doc, tag, text) without null ids."""
    found = references(rows, limits)
    refs = found.select(F.col("ref").alias("doc"), F.col("ref_tag").alias("tag"), F.col("ref_at").alias("at")).distinct()
    n_words = refs.agg(F.sum(F.col("at").bitwiseAND(F.lit(255)))).first()[0] or 0
    shard = lambda doc, tag: F.pmod(F.xxhash64(doc, tag), F.lit(max(1, -(-n_words // limits.shard))))
    told = lambda df, where, refers: df.select("doc", "tag", F.struct("at", where.alias("shard"), F.lit(refers).alias("refers")).alias("place"))
    places = told(found, shard("ref", "ref_tag"), True).unionByName(told(refs, shard("doc", "tag"), False)).groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))
    texts = rows.join(places.hint("shuffle_hash"), ["doc", "tag"]).select("doc", "tag", "text", "places")
    pieces = stored(texts.mapInArrow(lambda batches: _cut_out(batches, limits), "shard long, refers boolean, doc long, tag long, start long, n_words long, words binary"), "pieces")

    automata = stored(pieces.filter("NOT refers").groupBy("shard").applyInArrow(_build, "shard long, automaton binary"), "automata")
    asked = pieces.filter("refers")
    tasks = stored(asked.groupBy("shard").agg(F.ceil(F.sum("n_words") / limits.stream).cast("long").alias("tasks")), "tasks")
    queries = asked.join(tasks, "shard").select("shard", F.pmod(F.xxhash64("doc", "tag", "start"), F.col("tasks")).alias("salt"), "doc", "tag", "start", "words")
    each = tasks.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"))
    sent = automata.join(each, "shard").select("shard", "salt", "automaton")
    schema = "doc long, tag long, start long, n long"
    cuts = queries.groupBy("shard", "salt").cogroup(sent.groupBy("shard", "salt")).applyInArrow(_stream, schema)
    return stored(cuts.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("cuts")), "word-cuts")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row; with_text: and kept_text, the kept words joined by one space."""
    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids must be whole numbers")
    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("long").alias("doc"), tag_of(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    found = removed(rows.filter("doc IS NOT NULL").select("doc", "tag", "text"), limits)
    rows = rows.join(found.hint("shuffle_hash"), ["doc", "tag"], "left").select("id", "text", "cuts")
    names = [id_col, "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, cuts in zip(b.column(1).to_pylist(), b.column(2)):
                words = (text or "").encode().split()
                kept, at = [], 0
                if cuts.is_valid:
                    start, n = (cuts.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                    for s, e in zip(*(x.tolist() for x in _merged(start, start + n + WINDOW - 1))):
                        kept += words[at:s]
                        at = e
                left = b" ".join([*kept, *words[at:]])
                out.append((len(words), len(words) - len(kept) - len(words[at:]), hashlib.sha256(left).hexdigest(), *[left.decode()] * with_text))
            cols = list(zip(*out)) or [()] * (len(names) - 1)
            kinds = [pa.int64()] * 2 + [pa.string()] * (len(names) - 3)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(stage, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
