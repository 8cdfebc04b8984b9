"""Hard-negative mining by a vertical scan with branch-and-bound (BOND).

1. `prepared` keeps the rows that take part, with whole-number components.
2. Rows are laid out in blocks by column: one array a dimension, with its least and largest value, rows ordered by label.
   Anchors are packed into chunks. Every chunk meets every block, dealt by (chunk, salt), so a task holds one chunk and
   one block at a time, however many there are; nothing goes through the driver.
3. In a block each anchor reads the dimensions in descending order of its own magnitudes. What the unread dimensions can
   still add lies between sums of least and largest contributions; a row stays a candidate only while its bounds allow
   it. First for the positives: bounds against the fifth best so far. Then, with all positives known, for the negatives:
   a row must be able to fall into the window of some positive, and to beat the fifth best that is certain there.
4. Best lists are kept over the blocks of a task and merged by (anchor, positive) with a window.

Bounds only decide what is read further; every score that is returned is a whole inner product.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of different
lengths are padded with zeros; components beyond +-2^26 count as that much, so that scores fit a long; rows that share an
id are never each other's positives, and anchors that repeat as a whole count once; ties go to the smaller id; a positive
with no row in its window gives no row; an empty table, or one without anchors, gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SCALE, MOST = 256, 1 << 26
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between these percentages of the positive's.
LOWEST, HIGHEST = 80, 100


@dataclass(frozen=True)
class Limits:
    """Sizes that steer the work and never a result."""

    #: Rows of a block, anchors of a chunk (about), dimensions read between two looks at the bounds.
    block: int = 8192
    chunk: int = 1024
    step: int = 8


LIMITS = Limits()


def prepared(rows: DataFrame, label: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id long, label long, q array<long>) of the rows that take part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(float(-MOST))), F.lit(float(MOST))).cast("long"))
    own = F.col(label_col) if label is None else label
    return rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), own.cast("long").alias("label"), whole.alias("q"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of longs as rows of one matrix, shorter ones padded with zeros."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    at = np.arange(int(sizes.sum())) - np.repeat(offsets[:-1] - offsets[0], sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def blocks(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """(ids, labels, width, columns): rows of `prepared`, some thousands together, ordered by label, one dimension after another."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, limits.block):
                part = b.slice(at, limits.block)
                ids, labels = (part.column(i).to_numpy() for i in (0, 1))
                order = np.lexsort((ids, labels))
                columns = np.ascontiguousarray(_matrix(part.column(2))[order].T)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.tobytes()], pa.binary()) for x in (ids[order], labels[order])] + [pa.array([len(columns)], pa.int32()), pa.array([columns.astype(np.int32).tobytes()], pa.binary())],
                    names=["ids", "labels", "width", "columns"],
                )

    return rows.mapInArrow(stage, "ids binary, labels binary, width int, columns binary")


class Block:
    """A block as arrays."""

    def __init__(self, ids: bytes, labels: bytes, width: int, columns: bytes):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.columns = np.frombuffer(columns, np.int32).reshape(width, len(self.ids)).astype(np.int64)
        self.least, self.largest = (f(self.columns, axis=1, initial=0) for f in (np.min, np.max))

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Dimensions by descending magnitude of q, its values there, and what the dimensions from each on can add at least and at most."""
        q = q[: len(self.columns)] if len(q) >= len(self.columns) else np.r_[q, np.zeros(len(self.columns) - len(q), np.int64)]
        dims = np.argsort(-np.abs(q), kind="stable")
        q = q[dims]
        ends = np.stack([q * self.least[dims], q * self.largest[dims]])
        rest = [np.r_[np.cumsum(x[::-1])[::-1], 0] for x in (ends.min(axis=0), ends.max(axis=0))]
        return dims, q, *rest

    def scan(self, q: np.ndarray, rows: np.ndarray, step: int, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows that `keep`(rows, lower bounds, upper bounds) lets through to the end, and their scores."""
        dims, q, low, high = self.order(q)
        score = np.zeros(len(rows), np.int64)
        for at in range(0, len(dims), step):
            if not len(rows):
                break
            for d, x in zip(dims[at : at + step].tolist(), q[at : at + step].tolist()):
                if x:
                    score += self.columns[d][rows] * x
            end = min(at + step, len(dims))
            alive = keep(rows, score + low[end], score + high[end])
            if not alive.all():
                rows, score = rows[alive], score[alive]
        return rows, score


def _kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value; below everything where there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -(1 << 63)


def _best(found: list[tuple[int, int]], score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best of (score, id) so far and of a block: higher scores, then smaller ids."""
    if len(score) > k:
        near = score >= _kth(score, k)
        score, ids = score[near], ids[near]
    return sorted([*found, *zip(score.tolist(), ids.tolist())], key=lambda x: (-x[0], x[1]))[:k]


def positives_in(block: Block, key: int, label: int, q: np.ndarray, found: list[tuple[int, int]], step: int) -> list[tuple[int, int]]:
    """The best rows of an anchor's label, over the block and those found before."""
    rows = np.arange(*np.searchsorted(block.labels, [label, label + 1]))
    rows = rows[block.ids[rows] != key]
    before = found[-1][0] if len(found) == POSITIVES else -(1 << 63)
    rows, score = block.scan(q, rows, step, lambda _, low, high: high >= max(before, _kth(low, POSITIVES)))
    return _best(found, score, block.ids[rows], POSITIVES)


def windows_of(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score of a negative, by positive score."""
    return -(-LOWEST * scores // 100), HIGHEST * scores // 100


def negatives_in(block: Block, label: int, q: np.ndarray, windows: tuple[np.ndarray, np.ndarray], found: list[list[tuple[int, int]]], step: int) -> list[list[tuple[int, int]]]:
    """For each window the best rows of other labels, over the block and those found before."""
    a, b = np.searchsorted(block.labels, [label, label + 1])
    rows = np.r_[np.arange(a), np.arange(b, len(block.ids))]

    def keep(_, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        alive = np.zeros(len(low), bool)
        for least, most, before in zip(*(x.tolist() for x in windows), found):
            sure = low[(low >= least) & (high <= most)]
            beat = max(least, before[-1][0] if len(before) == NEGATIVES else least, _kth(sure, NEGATIVES))
            alive |= (high >= beat) & (low <= most)
        return alive

    rows, score = block.scan(q, rows, step, keep)
    out = []
    for least, most, before in zip(*(x.tolist() for x in windows), found):
        inside = (score >= least) & (score <= most)
        out.append(_best(before, score[inside], block.ids[rows[inside]], NEGATIVES))
    return out


_ANCHOR = "key long, id long, label long, q array<long>, scores array<long>"


def _meet(laid: DataFrame, anchors: DataFrame, n_anchors: int, negative: bool, limits: Limits) -> DataFrame:
    """(key, place, other, score): the best rows by task of each anchor (and place among its positives)."""
    spark = laid.sparkSession
    chunks = max(1, -(-n_anchors // limits.chunk))
    salts = 2 * spark.sparkContext.defaultParallelism
    packed = anchors.groupBy(F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("key", "id", "label", "q", "scores")).alias("anchors"))
    packed = packed.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    dealt = laid.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    pairs = dealt.join(packed.hint("merge"), ["chunk", "salt"]).sortWithinPartitions("chunk").select("chunk", "ids", "labels", "width", "columns", "anchors")

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            rows = [(a[0], place, other, score) for a in held for place, best in enumerate(a[4]) for score, other in best]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000])], names=["key", "place", "other", "score"])

        for b in batches:
            for i in range(b.num_rows):
                if (now := b.column(0)[i].as_py()) != chunk:
                    yield from told()
                    chunk, held = now, []
                    for x in b.column(5)[i].as_py():
                        scores = np.array(x["scores"] or [], np.int64)
                        held.append([x["key"], x["id"], x["label"], np.array(x["q"], np.int64), [[] for _ in scores] if negative else [[]], windows_of(scores)])
                block = Block(*(b.column(k)[i].as_py() for k in range(1, 5)))
                for a in held:
                    a[4] = negatives_in(block, a[2], a[3], a[5], a[4], limits.step) if negative else [positives_in(block, a[1], a[2], a[3], a[4][0], limits.step)]
        yield from told()

    return pairs.mapInArrow(stage, "key long, place long, other long, score long")


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The best rows of each group with their rank: higher scores first, then smaller ids."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "other"))).filter(F.col("rank") <= most)


def hard_negatives(rows: DataFrame, is_anchor: Column, limits: Limits = LIMITS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) from rows of `prepared`.

    is_anchor: a condition on `id`.
    """
    laid = stored(blocks(rows, limits), "vector-blocks")
    anchors = stored(rows.filter(is_anchor).distinct().withColumn("key", F.xxhash64("id", "label", "q")), "anchors")
    n = anchors.count()
    none = F.array().cast("array<long>")
    first = _ranked(_meet(laid, anchors.withColumn("scores", none), n, False, limits), ["key"], POSITIVES)
    first = stored(first.select("key", F.col("rank").alias("positive_rank"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = first.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    second = _ranked(_meet(laid, anchors.join(scores, "key"), n, True, limits), ["key", "place"], NEGATIVES)
    named = second.select("key", (F.col("place") + 1).cast("int").alias("positive_rank"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    whole = named.join(first, ["key", "positive_rank"]).join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return whole.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")
