"""A tagger of person names: hashed features, weights by an averaged perceptron over partitions, decoding by Viterbi.

Training goes in rounds. In each, every partition starts from the common weights, learns from its own examples and gives back
the average of its weights on the way; these are averaged over partitions by the number of their examples. What comes to
the driver is one number a feature bucket and tag, whatever the size of the examples.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spans import title_case
from ..scratch import kept

#: Outside a name, at its first word, at a later one.
TAGS = ("O", "B", "I")
BUCKETS = 1 << 16
#: Rows that a model is fitted on, at most: those with the smallest hash of their id.
EXAMPLES = 6_000
WORD = re.compile(r"(?:[^\W_]|['’])+")
_NEVER = -1e9


class _Signs(dict):
    """What stands for each letter, by code point, filled as letters are met."""

    def __missing__(self, code: int) -> str:
        self[code] = re.sub(r"\d", "9", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", chr(code)))
        return self[code]


_SIGNS = _Signs()


@lru_cache(maxsize=1 << 12)
def _shortened(signs: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", signs)


def _shape(word: str) -> str:
    """Upper case, lower case and digits as one sign each, runs shortened."""
    return _shortened(word.translate(_SIGNS))


def features(words: list[str]) -> np.ndarray:
    """Buckets of each word's features: itself, its shape and end, its neighbours, and pairs of these."""
    low = ["<<<", "<<", "<", *(w.lower() for w in words), ">", ">>"]
    shape = ["<<<", "<<", "<", *map(_shape, words), ">", ">>"]
    rows = []
    for i in range(3, len(words) + 3):
        said = (
            "b", f"w{low[i]}", f"s{shape[i]}", f"e{low[i][-3:]}", f"p{low[i - 1]}", f"q{low[i - 2]}|{low[i - 1]}", f"n{low[i + 1]}", f"m{low[i + 1]}|{low[i + 2]}",
            f"ps{low[i - 1]}|{shape[i]}", f"qs{low[i - 2]}|{low[i - 1]}|{shape[i]}", f"sn{shape[i]}|{shape[i + 1]}", f"sp{shape[i - 1]}|{shape[i]}", f"ns{shape[i]}|{low[i + 1]}",
            f"r{low[i - 3]}|{low[i - 2]}", f"rs{low[i - 3]}|{low[i - 2]}|{shape[i - 1]}|{shape[i]}",
        )
        rows.append([zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS for x in said])
    return np.array(rows, np.int64) if rows else np.zeros((0, 1), np.int64)


#: Signs that stand for the words before and behind a text; bytes of a word up to which `buckets` reckons with it.
_BEFORE, _AFTER, LONGEST = ("<<<", "<<", "<"), (">", ">>"), 256


def _moved() -> np.ndarray:
    """CRC-32 is linear: what each byte of a checksum (256 values for each of four places) becomes by so many zero bytes behind it."""
    one = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    one ^= one[0]
    rows = [(np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()]
    for _ in range(LONGEST + 1):
        rows.append(one[rows[-1] & 255] ^ (rows[-1] >> 8))
    return np.concatenate(rows)


class _Pieces:
    """Distinct words or shapes: checksums of each alone and behind the start of a feature."""

    _moves = None

    def __init__(self, words: Iterable[str]):
        self.bytes = [w.encode("utf-8", "replace") for w in words]
        self.sizes = np.array([len(b) for b in self.bytes], np.int64) << 10
        self.crcs = self.with_("", "")

    def with_(self, head: str, tail: str = "|") -> np.ndarray:
        first, tail = zlib.crc32(head.encode()), tail.encode()
        return np.array([zlib.crc32(b + tail, first) for b in self.bytes], np.uint32)

    @cached_property
    def barred(self) -> np.ndarray:
        return self.with_("")

    def behind(self, done: np.ndarray, at: np.ndarray, bar: bool = False) -> np.ndarray:
        """Checksums of texts with these checksums and a piece, and a bar if asked for, behind each."""
        if _Pieces._moves is None:
            _Pieces._moves = _moved()
        moves, size = _Pieces._moves, self.sizes[at] + (1024 if bar else 0)
        out = (self.barred if bar else self.crcs)[at]
        for k in range(4):
            out = out ^ moves[size + (256 * k) + ((done >> np.uint32(8 * k)) & np.uint32(255))]
        return out


def buckets(texts: list[list[str]]) -> Iterator[np.ndarray]:
    """`features` of the words of many texts one after another, a column at a time; words are up to LONGEST bytes long."""
    ids: dict[str, int] = {}
    flat = [ids.setdefault(w, len(ids)) for words in texts for w in (*_BEFORE, *words, *_AFTER)]
    signs = {*_BEFORE, *_AFTER}
    lows, shapes = ({}, {})
    low = np.array([lows.setdefault(w.lower(), len(lows)) for w in ids], np.int64)
    shape = np.array([shapes.setdefault(w if w in signs else _shape(w), len(shapes)) for w in ids], np.int64)
    flat, word, look = np.array(flat, np.int64), _Pieces(lows), _Pieces(shapes)
    sizes = np.array([len(words) for words in texts], np.int64)
    at = np.arange(sizes.sum()) + 3 + 5 * np.repeat(np.arange(len(texts)), sizes)
    w = {k: low[flat[at + k]] for k in range(-3, 3)}
    s = {k: shape[flat[at + k]] for k in (-1, 0, 1)}
    ends = np.array([zlib.crc32(b"e" + x[-3:].encode("utf-8", "replace")) for x in lows], np.uint32)
    yield np.full(len(at), zlib.crc32(b"b"), np.uint32)
    yield word.with_("w", "")[w[0]]
    yield look.with_("s", "")[s[0]]
    yield ends[w[0]]
    yield word.with_("p", "")[w[-1]]
    yield word.behind(word.with_("q")[w[-2]], w[-1])
    yield word.with_("n", "")[w[1]]
    yield word.behind(word.with_("m")[w[1]], w[2])
    yield look.behind(word.with_("ps")[w[-1]], s[0])
    yield look.behind(word.behind(word.with_("qs")[w[-2]], w[-1], True), s[0])
    yield look.behind(look.with_("sn")[s[0]], s[1])
    yield look.behind(look.with_("sp")[s[-1]], s[0])
    yield word.behind(look.with_("ns")[s[0]], w[1])
    yield word.behind(word.with_("r")[w[-3]], w[-2])
    yield look.behind(look.behind(word.behind(word.with_("rs")[w[-3]], w[-2], True), s[-1], True), s[0])


def _short(words: list[str]) -> bool:
    return max(map(len, words), default=0) * 4 <= LONGEST


class Tagger:
    """weights: by bucket and tag; moves: from the tag before (the last row: none) to a tag."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        n = len(TAGS)
        self.weights = np.zeros((BUCKETS, n)) if weights is None else weights
        self.moves = np.zeros((n + 1, n)) if moves is None else moves

    def decode(self, found: np.ndarray) -> tuple[list[int], float]:
        """The best tags of words with these features, by Viterbi; no name begins with a later word."""
        if not len(found):
            return [], 0.0
        return self._best(self.weights[found].sum(axis=1))

    def _allowed(self) -> np.ndarray:
        moves = self.moves.copy()
        moves[0, 2] = moves[-1, 2] = _NEVER
        return moves

    def _best(self, score: np.ndarray) -> tuple[list[int], float]:
        *moves, first = self._allowed().tolist()
        rows, back = score.tolist(), []
        best = [m + x for m, x in zip(first, rows[0])]
        into = [*zip(*moves)]
        for row in rows[1:]:
            ways = [[b + m for b, m in zip(best, ms)] for ms in into]
            tops = [max(w) for w in ways]
            back.append([w.index(t) for w, t in zip(ways, tops)])
            best = [t + x for t, x in zip(tops, row)]
        tags = [best.index(max(best))]
        for way in reversed(back):
            tags.append(way[tags[-1]])
        return tags[::-1], max(best)

    def _best_of_many(self, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The tags of many texts, each with one word at least, a step of all of them at a time."""
        order = np.argsort(-sizes, kind="stable")
        sizes, begin = sizes[order], (np.cumsum(sizes) - sizes)[order]
        moves = self._allowed()
        going = [int(x) for x in np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")]  # texts with a word at each step
        best, back = moves[-1] + score[begin], np.zeros((len(score), len(TAGS)), np.int8)
        for i in range(1, len(going)):
            now = begin[: going[i]] + i
            ways = best[: going[i], :, None] + moves[:-1]
            back[now] = ways.argmax(axis=1)
            best[: going[i]] = ways.max(axis=1) + score[now]
        tags, last = np.zeros(len(score), np.int64), best.argmax(axis=1)
        for i in range(len(going) - 1, -1, -1):
            now = begin[: going[i]] + i
            tags[now] = last[: going[i]]
            last[: going[i]] = back[now, last[: going[i]]]
        return tags

    def many(self) -> Callable[[list[str]], list[list[tuple[str, float, str]]]]:
        """`model` over many texts at once, with the same tags."""
        one = self.model()
        names = ["O", *(f"{t}-PER" for t in TAGS[1:])]

        def run(texts: list[str]) -> list[list[tuple[str, float, str]]]:
            read = [WORD.findall(t) for t in texts]
            out = [[] if _short(words) else one(t) for t, words in zip(texts, read)]
            short = [i for i, words in enumerate(read) if words and _short(words)]
            if not short:
                return out
            columns = buckets([read[i] for i in short])
            score = self.weights[next(columns) % BUCKETS]
            for column in columns:
                score += self.weights[column % BUCKETS]
            sizes = np.array([len(read[i]) for i in short], np.int64)
            tags = self._best_of_many(score, sizes)
            chosen = tags[:, None] == np.arange(len(TAGS))
            sure = 1 / (1 + np.exp(-np.clip(score[chosen] - np.where(chosen, -np.inf, score).max(axis=1) + 2, -30, 30)))
            said = zip([names[t] for t in tags.tolist()], sure.tolist())
            for i in short:
                out[i] = [(name, p, w) for w, (name, p) in zip(read[i], islice(said, len(read[i])))]
            return out

        return run

    def model(self) -> Callable[[str], list[tuple[str, float, str]]]:
        """As a token model: text -> (entity, score, word) of each word; the score is the odds of its tag against the next best."""
        def run(text: str) -> list[tuple[str, float, str]]:
            words = WORD.findall(text)
            found = features(words)
            tags, _ = self.decode(found)
            score = self.weights[found].sum(axis=1) if words else np.zeros((0, len(TAGS)))
            rest = np.where(np.arange(len(TAGS)) == np.array(tags, np.int64)[:, None], -np.inf, score).max(axis=1) if words else []
            sure = 1 / (1 + np.exp(-np.clip([s[t] - r + 2 for s, t, r in zip(score, tags, rest)], -30, 30))) if words else []
            return [("O" if t == 0 else f"{TAGS[t]}-PER", float(p), w) for t, p, w in zip(tags, sure, words)]

        return run


def tagged(text: str, names: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """The words of a text and their tags, from the places of its names."""
    words, tags, begun = [], [], set()
    for m in WORD.finditer(text):
        name = next((s for s, e in names if s <= m.start() and m.end() <= e), None)
        words.append(m[0])
        tags.append(0 if name is None else 2 if name in begun else 1)
        begun |= {name} - {None}
    return words, tags


def disguised(words: list[str], tags: list[int]) -> list[str]:
    """The words with other letters in the names: what is learned is where names stand and how they look, not which they are."""
    dice = random.Random(zlib.crc32(" ".join(words).encode("utf-8", "replace")))
    other = lambda m: dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ" if m[0].isupper() else "abcdefghijklmnopqrstuvwxyz")
    return [re.sub(r"[^\W\d_]", other, w) if t else w for w, t in zip(words, tags)]


#: Examples whose features are worked out together.
_TOGETHER = 256


def _featured(rows: Iterator[tuple[list[str], list[int]]]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Tags and features of each example."""
    while part := [(disguised(words, tags), tags) for words, tags in islice(rows, _TOGETHER)]:
        if not all(_short(words) for words, _ in part):
            yield from ((tags, features(words)) for words, tags in part)
            continue
        whole = np.stack([(column % BUCKETS).astype(np.int64) for column in buckets([words for words, _ in part])], axis=1)
        begin = 0
        for words, tags in part:
            yield tags, whole[begin : begin + len(words)]
            begin += len(words)


def _learned(weights: np.ndarray, moves: np.ndarray, rows: Iterator[tuple[list[str], list[int]]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Averages of weights and moves over the examples of a partition, from the given ones on, and their number."""
    now = Tagger(weights.copy(), moves.copy())
    drift_w, drift_m, n = np.zeros_like(weights), np.zeros_like(moves), 0
    for tags, found in _featured(rows):
        n += 1
        guess, _ = now.decode(found)
        if guess == tags:
            continue
        for sign, said in ((1, tags), (-1, guess)):
            path = [-1, *said]
            for i, tag in enumerate(said):
                np.add.at(now.weights, (found[i], tag), sign)
                np.add.at(drift_w, (found[i], tag), sign * n)  # changes weigh by the examples that come after them
                now.moves[path[i], tag] += sign
                drift_m[path[i], tag] += sign * n
    return now.weights - drift_w / (n + 1), now.moves - drift_m / (n + 1), n


def train(examples: DataFrame, rounds: int = 8, most: int = EXAMPLES, parts: int = 8) -> Tagger:
    """Fit on (id, text, names array<struct<start,end>>), each text as it is and in title case, as texts are read; without examples, a tagger that finds nothing."""
    chosen = kept(examples.orderBy(F.xxhash64("id", "text"), "id", "text").limit(most), "tagger-examples").repartition(parts, "id").sortWithinPartitions(F.xxhash64("id", F.lit(7)), "id", "text")
    tagger = Tagger()
    for _ in range(rounds):
        weights, moves = tagger.weights, tagger.moves
        size = weights.size

        def learn(frames: Iterator[pd.DataFrame], weights=weights, moves=moves) -> Iterator[pd.DataFrame]:
            rows = (tagged(read, [(x["start"], x["end"]) for x in (names if names is not None else [])]) for f in frames for t, names in zip(f["text"], f["names"]) for read in (t or "", title_case(t or "")))
            new_w, new_m, n = _learned(weights, moves, rows)
            flat = np.concatenate([new_w.ravel(), new_m.ravel()])
            at = np.flatnonzero(flat)
            yield pd.DataFrame({"at": np.r_[at, -1], "total": np.r_[flat[at] * n, n]})

        found = chosen.mapInPandas(learn, "at long, total double").groupBy("at").agg(F.sum("total").alias("total")).toPandas()  # a row a bucket and tag at most
        total = dict(zip(found["at"], found["total"])).get(-1, 0)
        if not total:
            break
        flat = np.zeros(size + moves.size)
        found = found[found["at"] >= 0]
        flat[found["at"].to_numpy(np.int64)] = found["total"].to_numpy() / total
        tagger = Tagger(flat[:size].reshape(weights.shape), flat[size:].reshape(moves.shape))
    return tagger
