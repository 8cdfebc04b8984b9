"""Byte-level BPE encoding and decoding with a pair occurrence index.

A task cuts the texts of an Arrow batch into pre-tokens, takes the distinct ones it has not met, and encodes them
together: `pair -> positions` over all of them, active ranks from a heap in ascending order, and at each merge only
the lists of the touched neighbours change. Texts are then put together from a bounded cache of pre-tokens.

The result equals the tokenizers library's for vocabularies of this kind (byte level, every token made by one merge;
`load` checks that). Added tokens found in a text become their ids, as the library does by default.

No shuffle; memory is one Arrow batch and the cache. Defined cases: null text counts as empty and gives no ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed by the format: the pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a task remembers; beyond it the cache starts anew. Only speed depends on it.
CACHE = 500_000
#: From this many positions on, a pair's list is applied with numpy.
LONG = 48
#: Marks in the id array: behind a word, and where a merge has taken the letter.
WALL, GONE = (1 << 17) - 1, (1 << 17) - 2


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the rest take 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Ranks of pairs, in a dictionary and as sorted arrays; a pair's code is left << 17 | right."""

    def __init__(self, merges: dict[tuple[int, int], int], of_byte: list[int], as_bytes: dict[int, bytes], added: dict[str, int]):
        self.pair_of = [(a, b, new) for (a, b), new in merges.items()]  # by rank
        self.rank_of = {a << 17 | b: r for r, (a, b, _) in enumerate(self.pair_of)}
        self._codes = np.array(sorted(self.rank_of), np.int64)
        self._ranks = np.array([self.rank_of[c] for c in self._codes.tolist()], np.int64)
        self.of_byte_v = np.array(of_byte, np.int32)
        self.as_bytes, self.added = as_bytes, added

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it is none."""
        codes = left.astype(np.int64) << 17 | right
        at = np.minimum(np.searchsorted(self._codes, codes), len(self._codes) - 1)
        return np.where(self._codes[at] == codes, self._ranks[at], -1)


_LOADED: dict[str, Vocabulary] = {}
_ENCODERS: dict[str, Encoder] = {}


def load(path: str) -> Vocabulary:
    """A byte-level BPE vocabulary in the tokenizers library's JSON format; kept per process."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec["normalizer"] and model["type"] == "BPE"
        odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges", "dropout") if model.get(k)]
        if not plain or odd or any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is not a plain byte-level BPE vocabulary")
        vocab, letters = model["vocab"], byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        merges: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            merges[vocab[a], vocab[b]] = vocab[a + b]
        if len(set(merges.values())) != len(merges) or len(vocab) >= WALL:
            raise ValueError("two merges make the same token: ascending ranks alone don't give the library's result")
        as_bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        as_bytes |= {i: t.encode() for t, i in added.items()}
        _LOADED[path] = Vocabulary(merges, [vocab[c] for c in letters], as_bytes, added)
    return _LOADED[path]


class Encoder:
    """Encodes texts of one task; remembers up to CACHE pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.cache: dict[str, tuple[str, bytes]] = {}  # ids joined, and what they decode to
        self.cut = regex.compile(PRE_TOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))) + ")") if vocabulary.added else None

    def merge_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word, all words at once by the pair occurrence index.

        index maps the rank of a pair to every position where that pair starts. The lowest active rank is applied to
        all its positions, then the pairs that the merges have made to the left and right join their own lists.
        Long lists are applied with numpy, short ones in a plain loop; both work on the same memory.
        """
        v = self.v
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes + 1)  # one more: a wall after each word that no pair crosses
        n = int(ends[-1]) if len(raw) else 0
        ids, after, before = array("i", bytes(4 * n)), array("i", bytes(4 * n)), array("i", bytes(4 * n))
        if not n:
            return []
        ids_v, after_v, before_v = (np.frombuffer(x, np.int32) for x in (ids, after, before))
        wall = np.zeros(n, bool)
        wall[ends - 1] = True
        ids_v[~wall] = v.of_byte_v[np.frombuffer(b"".join(raw), np.uint8)]
        ids_v[wall] = WALL
        after_v[:] = np.arange(1, n + 1)
        before_v[:] = np.arange(-1, n - 1)

        index: dict[int, list] = {}
        heap: list[int] = []

        def add(ranks: np.ndarray, places: np.ndarray) -> None:
            found = ranks >= 0
            ranks, places = ranks[found], places[found]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(places, cuts)):
                if r in index:
                    index[r].extend(part.tolist())
                else:
                    index[r] = part.tolist()
                    heapq.heappush(heap, r)

        add(v.ranks(ids_v[:-1], ids_v[1:]), np.arange(n - 1))
        rank_of, pair_of = v.rank_of, v.pair_of
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank)
            a, b, new = pair_of[rank]
            if len(places) >= LONG and a != b:
                p = np.array(places)
                p = p[ids_v[p] == a]
                j = after_v[p]
                live = ids_v[j] == b  # after a word's last letter comes its wall
                p, j = p[live], j[live]
                ids_v[p], ids_v[j] = new, GONE
                k = after_v[j]
                after_v[p], before_v[k] = k, p
                add(v.ranks(ids_v[p], ids_v[k]), p)
                h = before_v[p]
                h = h[h >= 0]
                add(v.ranks(ids_v[h], ids_v[after_v[h]]), h)
                continue
            places.sort()  # left to right, so that runs of equal letters merge as the library merges them
            for i in places:
                if ids[i] != a:
                    continue
                j = after[i]
                if ids[j] != b:
                    continue  # an earlier merge took one of the two
                ids[i], ids[j] = new, GONE
                k = after[j]
                after[i], before[k] = k, i
                h = before[i]
                for at, code in ((i, new << 17 | ids[k]), (h, ids[h] << 17 | new)) if h >= 0 else ((i, new << 17 | ids[k]),):
                    r = rank_of.get(code)
                    if r is not None:
                        if r in index:
                            index[r].append(at)
                        else:
                            index[r] = [at]
                            heapq.heappush(heap, r)
        kept = ids_v != GONE
        flat = ids_v[kept].tolist()
        bounds = np.cumsum(np.add.reduceat(kept, np.r_[0, ends[:-1]])).tolist()
        return [tuple(flat[s : e - 1]) for s, e in zip([0, *bounds], bounds)]

    def _pieces(self, text: str) -> list[str]:
        if self.special is None or not any(t in text for t in self.v.added):
            return self.cut.findall(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.v.added else self.cut.findall(part)
        return out

    def _known(self, words: list[str]) -> list[tuple[str, bytes]]:
        """(ids joined, what they decode to) of distinct pre-tokens."""
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE:
            self.cache, new = {}, words
        plain = [w for w in new if w not in self.v.added]
        for w, got in zip(plain, self.merge_all(plain)):
            self.cache[w] = (",".join(map(str, got)), self.decode_bytes(got))
        for w in new:
            if w in self.v.added:
                self.cache[w] = (str(i := self.v.added[w]), self.decode_bytes((i,)))
        return [self.cache[w] for w in words]

    def encode_joined(self, texts: list[str | None]) -> tuple[list[str], list[bytes]]:
        """Per text: the decimal ids joined by commas, and the bytes they decode to."""
        flat: list[str] = []
        offsets = [0]
        for t in texts:
            flat += self._pieces(t or "")
            offsets.append(len(flat))
        coded = pa.array(flat, pa.string()).dictionary_encode()
        found = self._known(coded.dictionary.to_pylist())
        ids = pa.array([x[0] for x in found], pa.string()).take(coded.indices)
        raw = pa.array([x[1] for x in found], pa.binary()).take(coded.indices)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids), ",").to_pylist()
        _, at, data = raw.buffers()
        ends = np.frombuffer(at, np.int32)[: len(flat) + 1] if at is not None and len(flat) else np.zeros(1, np.int32)
        whole = memoryview(data) if data is not None else memoryview(b"")
        return joined, [bytes(whole[ends[s] : ends[e]]) for s, e in zip(offsets, offsets[1:])]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [[int(i) for i in j.split(",")] if j else [] for j in self.encode_joined(texts)[0]]

    def decode_bytes(self, ids: list[int] | tuple[int, ...]) -> bytes:
        return b"".join(map(self.v.as_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load(path))
    return _ENCODERS[path]


def _small(texts: list, limit: int = 4_000_000) -> Iterator[list]:
    """texts in runs of about `limit` characters, so that ids of a batch of long texts stay small in memory."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            at = 0
            for run in _small(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(run)), pa.array(enc.encode(run), pa.list_(pa.int32()))], names=[id_col, "ids"])
                at += len(run)

    return docs.select(id_col, text_col).mapInArrow(stage, T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids; null ids give null text."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = [enc.decode(x) if x is not None else None for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(stage, T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())]))


def bpe_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids again, and report digests of both."""
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            at = 0
            for run in _small(b.column(1).to_pylist()):
                rows = [(j.count(",") + 1 if j else 0, hashlib.sha256(j.encode()).hexdigest(), hashlib.sha256(d.decode("utf-8", "replace").encode()).hexdigest()) for j, d in zip(*enc.encode_joined(run))]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(run)), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string())))], names=names)
                at += len(run)

    schema = T.StructType([docs.schema[id_col], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(stage, schema)
