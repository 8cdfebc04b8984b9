"""Periodic run detection: all maximal repetitions of words in each text, by LCE queries on a harmonic grid.

A run is a stretch of words with smallest period q, at least max(LEAST, 2 q) long, that cannot be made longer. In it at
least m(q) = max(q, LEAST - q) neighbouring words equal the word q further on, so one of every m(q) words is enough: the
grid has the places 0, m, 2m, ... for every period, in all n log n of them (`grid`). Where a grid word equals its partner,
the longest common extensions of both places to the right and to the left give the whole stretch.

`Extensions` answers them from a difference cover: residues modulo COVER such that for any two places some step of less
than COVER words leads both to sampled ones. Only suffixes at sampled places are sorted, by doubling over blocks of COVER
words; neighbours in that order are compared through the same doubling, and a sparse table gives minima over any range.
A query compares the few words before the sampled places and then asks the table. To the left the same is done with the
text reversed. Texts of a batch are read together, with a word of its own behind each, and only those in which some
stretch is longer than the few words that are compared directly are sorted at all.

Each text is one task's own work: nothing is shuffled. Memory is in proportion to a text, or to PIECE bytes of short ones.

Defined cases: null and empty texts have no words and no runs; a document without id is judged as it stands; a run that
has a smaller period is told under the smaller one alone; equal texts of different ids may differ (the id seeds the
planted repetitions of `planted`), repeated rows don't; an empty table gives no rows; columns beside id and text are not
read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices

LEAST = 12
#: A difference cover modulo 13: every residue is a difference of two of its members.
COVER, MEMBERS = 13, (0, 1, 3, 9)
#: Bytes of text that are read together, and grid places that are looked at together.
PIECE, PLACES = 1 << 20, 1 << 20

#: By residues of two places: how far on both are sampled.
_STEPS = np.array([[next(d for d in range(COVER) if (a + d) % COVER in MEMBERS and (b + d) % COVER in MEMBERS) for b in range(COVER)] for a in range(COVER)])
_MEMBER = np.isin(np.arange(COVER), MEMBERS)


def _names(*keys: np.ndarray) -> np.ndarray:
    """Numbers in the order of the keys (first key first), equal keys with equal numbers."""
    order = np.lexsort(keys[::-1])
    fresh = np.zeros(len(order), np.int64)
    for k in keys:
        fresh[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


class Extensions:
    """Longest common extensions to the right in a text of word numbers (not negative), by a difference cover."""

    def __init__(self, text: np.ndarray):
        n = self.n = len(text)
        self.text = np.concatenate([text, -1 - np.arange(2 * COVER)])  # what lies behind the end equals nothing
        places = np.flatnonzero(_MEMBER[np.arange(n + 1) % COVER])
        self.index = np.full(n + 1 + COVER, -1)
        self.index[places] = np.arange(len(places))
        # blocks of COVER words, three words to a key where numbers are small; places behind the end sort below all words
        words = np.maximum(self.text, -1) + 1
        by = 3 if int(words.max()) < 1 << 21 else 1
        keys = [sum((words[places + j + k] << (21 * (by - 1 - k)) for k in range(min(by, COVER - j))), np.zeros(len(places), np.int64)) for j in range(0, COVER, by)]
        names, levels, reach = _names(*keys), [], 1
        while True:
            levels.append(names)
            if names.max(initial=0) == len(names) - 1 or reach * COVER > n:
                break
            ahead = np.where(places + reach * COVER <= n, places + reach * COVER, n + 1)
            behind = np.where(ahead <= n, names[self.index[np.minimum(ahead, n)]] + 1, 0)
            names, reach = _names(names, behind), 2 * reach
        self.rank = levels[-1]
        order = np.argsort(self.rank, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        # common prefixes of neighbours: whole blocks by levels, then the words of one block
        a, b = places[order[:-1]].copy(), places[order[1:]].copy()
        common = np.zeros(len(a), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            size = COVER << level
            same = (a + size <= n) & (b + size <= n)
            same[same] = levels[level][self.index[a[same]]] == levels[level][self.index[b[same]]]
            common[same] += size
            a[same] += size
            b[same] += size
        common += self._direct(a, b, np.full(len(a), COVER))
        self.table = [common]
        while 2 << (len(self.table) - 1) <= len(common):
            below, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(below[:-half], below[half:]))

    def _direct(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from places a and b on, up to `most` (COVER at most)."""
        out, going = np.zeros(len(a), np.int64), np.arange(len(a))
        for j in range(int(most.max(initial=0))):
            going = going[j < most[going]]
            going = going[self.text[a[going] + j] == self.text[b[going] + j]]
            if not len(going):
                break
            out[going] += 1
        return out

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on; a and b differ."""
        near = _STEPS[a % COVER, b % COVER]
        out = self._direct(a, b, near)
        far = np.flatnonzero((out == near) & (a + near <= self.n) & (b + near <= self.n))
        ranks = np.sort(self.rank[self.index[np.stack([a[far] + near[far], b[far] + near[far]])]], axis=0)
        low, width = ranks[0], ranks[1] - ranks[0]
        level = np.frexp(width.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            left, right = self.table[k][low[at]], self.table[k][low[at] + width[at] - (1 << k)]
            out[far[at]] += np.minimum(left, right)
        return out


def grid(sizes: np.ndarray, places: int = PLACES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place, period) of every grid place, so many at a time: periods up to half a text, places max(q, LEAST - q) apart."""
    halves = np.where(sizes >= LEAST, sizes // 2, 0)
    first = np.cumsum(halves) - halves
    total = int(halves.sum())
    start = 0
    while start < total:
        end = min(start + places // 4, total)
        at = np.arange(start, end)
        text = np.searchsorted(first + halves, at, "right")
        period = at - first[text] + 1
        apart = np.maximum(period, LEAST - period)
        counts = (sizes[text] - period - 1) // apart + 1
        # few periods have many places, so a piece is cut where it grows too large
        reach = np.cumsum(counts)
        cut = max(1, int(np.searchsorted(reach, places, "right")))
        text, period, apart, counts = text[:cut], period[:cut], apart[:cut], counts[:cut]
        k = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        yield np.repeat(text, counts), k * np.repeat(apart, counts), np.repeat(period, counts)
        start += cut


def meetings(words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, place among all words, period) of grid words that equal their partner, without those whose stretch ends too early nearby."""
    for text, place, period in grid(np.diff(offsets)):
        at = offsets[text] + place
        same = words[at] == words[at + period]
        text, at, period = text[same], at[same], period[same]
        sides = []
        for step, inside in ((1, at + period), (-1, at)):  # most chance meetings end within four words on both sides
            equal, going = np.zeros(len(at), np.int64), np.arange(len(at))
            for j in range(step, 5 * step, step):
                here = inside[going] + j
                going = going[here < offsets[text[going] + 1] if step > 0 else here >= offsets[text[going]]]
                going = going[words[at[going] + j] == words[at[going] + period[going] + j]]
                equal[going] += 1
            sides.append(equal)
        right, left = sides
        open_ = (right == 4) | (left == 4) | (1 + right + left >= np.maximum(period, LEAST - period))
        yield text[open_], at[open_], period[open_]


def runs_of(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, sorted by text, start, period; words: numbers of texts one after another."""
    none = np.zeros((0, 4), np.int64)
    held, size, seen = [], 0, np.zeros(len(offsets) - 1, bool)
    for found in meetings(words, offsets):
        seen[found[0]] = True
        size += len(found[0])
        held = [*held, found] if size <= PLACES else []  # too many are found again below
    if not size:
        return none
    # only texts with a meeting are sorted, a word of its own behind each
    sizes, which = np.diff(offsets), np.flatnonzero(seen)
    lengths = sizes[which] + 1
    begin = np.cumsum(lengths) - lengths
    joined = np.empty(int(lengths.sum()), np.int64)
    stops = begin + lengths - 1
    joined[stops] = int(words.max()) + 1 + np.arange(len(which))
    inner = np.ones(len(joined), bool)
    inner[stops] = False
    joined[inner] = words[np.arange(int(sizes[which].sum())) + np.repeat(offsets[which] - (np.cumsum(sizes[which]) - sizes[which]), sizes[which])]
    joined = np.unique(joined, return_inverse=True)[1]
    n = len(joined)
    forth, back = Extensions(joined), Extensions(np.r_[joined[::-1], n])
    out = []
    for text, at, period in held if size <= PLACES else meetings(words, offsets):
        own = begin[np.searchsorted(which, text)]
        i = own + at - offsets[text]
        right, left = forth.query(i, i + period), np.zeros(len(i), np.int64)
        some = i > own  # reversed, the word before place p is at n - p
        left[some] = np.minimum(back.query(n - i[some], n - (i[some] + period[some])), (i - own)[some])
        length = left + right + period
        good = length >= np.maximum(LEAST, 2 * period)
        out.append(_told(np.stack([text, i - left - own, length, period], axis=1)[good]))
    found = _told(np.concatenate([none, *out]))
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def _told(found: np.ndarray) -> np.ndarray:
    """Each stretch once, under its smallest period."""
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    return found[fresh]


def planted(n: int, seed: int) -> np.ndarray | None:
    """Word numbers of a text with a planted repetition, as the contract wants it; None for a text that stays."""
    h = zlib.crc32(b"%d" % seed)
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % period)


class Numbers(dict):
    """Words to numbers, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _batch(ids: list[int | None], texts: list[str | None], plant: bool) -> Iterator[tuple]:
    split = [(t or "").encode().split() for t in texts]
    if plant:
        for k, (doc, words) in enumerate(zip(ids, split)):
            if doc is not None and (at := planted(len(words), doc)) is not None:
                split[k] = [words[i] for i in at.tolist()]
    offsets = np.r_[0, np.cumsum([len(w) for w in split])].astype(np.int64)
    numbers = Numbers()
    words = np.fromiter((numbers[w] for t in split for w in t), np.int64, int(offsets[-1]))
    found = runs_of(words, offsets)
    first = np.searchsorted(found[:, 0], np.arange(len(split) + 1))
    for k, (doc, own) in enumerate(zip(ids, split)):
        runs = found[first[k] : first[k + 1], 1:]
        if len(runs):
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            start, length, period = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist()
            top = (start, length, period, 1000 * length // period)
        else:
            kept, top = own, (None,) * 4
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
        collapsed = b" ".join(kept)
        yield doc, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), len(own), len(kept), runs, collapsed


_DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_kept long"


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False, with_text: bool = False) -> DataFrame:
    """Per row of docs: id, number of runs, the longest one, digests of all runs and of the text without repetitions.

    plant: put the contract's repetitions into the texts first. with_text: also `runs`, an array of structs, and
    `collapsed`, the text in which every run is cut to its first period.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    if plant and kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError("ids must be whole numbers")
    whole = ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" if with_text else ""
    names = [id_col, *(x.split()[0] for x in _DIGEST.split(", "))]
    run_kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in slices(b.column(1), PIECE):
                part = b.slice(s, e - s)
                rows = list(zip(*_batch(part.column(0).to_pylist(), part.column(1).to_pylist(), plant)))
                arrays = [part.column(0), *(pa.array(rows[i], pa.string() if i in (6, 7) else pa.int64()) for i in range(1, 10))]
                if with_text:
                    arrays.append(pa.array([[dict(zip(("start", "length", "period"), r)) for r in runs.tolist()] for runs in rows[10]], run_kind))
                    arrays.append(pa.array([x.decode() for x in rows[11]], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=[*names, *["runs", "collapsed"] * with_text])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(stage, f"`{id_col}` {kind}, {_DIGEST}{whole}")
