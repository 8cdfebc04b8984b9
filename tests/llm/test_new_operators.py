"""Hard negatives, periodic runs and repeated word windows, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from callweave.llm import automata, negatives, periodic

# -- hard negatives -----------------------------------------------------------


def plain_negatives(rows):
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id % 7 == 0 else label
        kept.setdefault((vec_id, moved, tuple(int(np.floor(256 * float(x))) for x in vector)), []).append(1)
    every = [k for k, n in kept.items() for _ in n]
    out = []
    for vec_id, label, q in [k for k in kept if k[0] % 100 == 0]:
        score = lambda other: sum(a * b for a, b in zip(q, other))
        best = lambda found: sorted(found, key=lambda x: (-x[0], x[1]))[:5]
        for ps, positive in best([(score(v), i) for i, own, v in every if own == label and i != vec_id]):
            found = best([(s, i) for i, own, v in every if own != label and 80 * ps <= 100 * (s := score(v)) <= 100 * ps])
            out += [(vec_id, positive, k, i, ps, s) for k, (s, i) in enumerate(found, 1)]
    return sorted(out)


def mined(spark, rows, limits=negatives.LIMITS):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("q", F.lit(1)).repartition(3)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(negatives.prepared(df, moved), F.col("id") % 100 == 0, limits)
    return sorted(tuple(r)[:6] for r in found.collect())


@pytest.mark.parametrize("limits", [negatives.LIMITS, negatives.Limits(block=16, chunk=2, step=1)])
def test_hard_negatives_equal_brute_force(spark, limits):
    rnd = np.random.default_rng(3)
    centre = rnd.normal(0, 0.4, (4, 12))
    rows = [(i, (centre[(k := int(rnd.integers(4)))] + rnd.normal(0, 0.2, 12)).astype(np.float32).tolist(), k if i % 9 else int(rnd.integers(4))) for i in range(500)]
    rows += [(1000 + i, rows[100][1], 2) for i in range(9)] + [rows[5], rows[6], rows[200]]  # ties and repeated rows
    rows += [(None, [0.1] * 12, 1), (3000, None, 1), (3001, [0.1] * 11 + [None], 1), (3002, [float("nan")] * 12, 1), (3003, [float("inf")] * 12, 1), (3004, [0.5] * 12, None), (3100, [], 1), (3101, [0.5, 0.5], 2), (3200, [-0.5] * 12, 77)]
    want = plain_negatives(rows)
    assert want and mined(spark, rows, limits) == want


def test_hard_negatives_of_empty_and_plain_tables(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1)]) == [] and mined(spark, [(100, [0.5], 1), (101, [0.5], 1), (102, [1e30], 2)]) == []
    assert mined(spark, [(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2), (103, [0.79], 2)]) == plain_negatives([(100, [1.0], 1), (101, [1.0], 1), (102, [0.9], 2), (103, [0.79], 2)]) != []


# -- periodic runs ------------------------------------------------------------


def plain_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def plain_periodic(doc, text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def wordy(seed):
    rnd = random.Random(seed)
    out = []
    for i in range(120):
        base = [rnd.choice("ab cé d e f".split()) for _ in range(rnd.randrange(1, 40))]
        words = [base[k % len(base)] for k in range(rnd.randrange(160))] if i % 2 else [rnd.choice("ab") for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            if words:
                words[rnd.randrange(len(words))] = "odd"
        out.append((i, rnd.choice([" ", "\n", " \t"]).join(words)))
    return out + [(None, "a b " * 20), (None, None), (500, ""), (501, None), (502, "x " * 4000), (503, "  a b " * 9), (5, out[5][1]), (5, "z z"), (24, "y " * 50), (33, "u v w " * 30)]


@pytest.mark.parametrize("places", [periodic.PLACES, 64])
def test_periodic_runs_equal_brute_force(spark, places, monkeypatch):
    docs = wordy(places % 7)
    if places != periodic.PLACES:  # what is found again, piece by piece
        monkeypatch.setattr(periodic, "PLACES", places)
        monkeypatch.setattr(periodic.grid, "__defaults__", (places,))
        got = [tuple(x[:8]) for x in periodic._batch(*map(list, zip(*docs)), True)]
    else:
        df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("x")).repartition(3)
        got = [tuple(r)[:8] for r in periodic.periodic_runs(df, plant=True).collect()]
        assert periodic.periodic_runs(df.limit(0), plant=True).count() == 0
        whole = periodic.periodic_runs(df.filter("doc_id = 502"), with_text=True).first()
        assert [tuple(r) for r in whole.runs] == [(0, 4000, 1)] and whole.collapsed == "x"
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 and t for d, t in docs if d is not None)
    assert sorted(map(repr, got)) == sorted(repr(plain_periodic(*d)) for d in docs)


def test_extensions_equal_brute_force():
    rnd = random.Random(4)
    for size in (1, 5, 40, 300):
        text = np.array([rnd.randrange(2) if size < 300 else k % 7 // 6 for k in range(size)] + [9])
        a = np.array([i for i in range(size) for _ in range(size)])
        b = np.array([i for _ in range(size) for i in range(size)])
        a, b = a[a != b], b[a != b]
        plain = [next(k for k in range(size + 2) if max(i, j) + k > size or text[i + k] != text[j + k]) for i, j in zip(a.tolist(), b.tolist())]
        if len(a):
            assert periodic.Extensions(text).query(a, b).tolist() == plain


def test_very_long_texts_have_their_runs():
    n = 200_000
    assert periodic.runs_of(np.zeros(n, np.int64), np.array([0, n])).tolist() == [[0, 0, n, 1]]
    assert periodic.runs_of(np.arange(n) % (n // 3), np.array([0, n])).tolist() == [[0, 0, n, n // 3]]


# -- repeated word windows ----------------------------------------------------


def passages(seed):
    rnd = random.Random(seed)
    bits = [" ".join(rnd.choice(["a", "b", "né", "dd"]) for _ in range(rnd.choice((8, 12, 13, 14, 30, 60)))) for _ in range(12)]
    docs = [(i, rnd.choice([" ", "\n"]).join(rnd.choice(bits) for _ in range(rnd.randrange(7)))) for i in range(60)]
    own = " ".join(f"w{k}" for k in range(40))
    return docs + [(100, "z " * 300), (101, "z " * 300), (102, "z " * 12 + "y"), (103, None), (None, docs[0][1]), (0, docs[0][1]), (1, docs[2][1]), (1, own), (104, own), (104, f"q {own}"), (105, own.replace(" ", "  ").upper())]


def plain_windows(docs):
    split = [(d, (t or "").split()) for d, t in docs]
    least = {}
    for d, words in split:
        for i in range(len(words) - 12) if d is not None else ():
            w = tuple(words[i : i + 13])
            least[w] = min(least.get(w, d), d)
    out = []
    for d, words in split:
        gone = {i + k for i in range(len(words) - 12) if d is not None and least[tuple(words[i : i + 13])] < d for k in range(13)}
        out.append((str(d), len(words), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_substring_dedup_equals_brute_force(spark, seed):
    docs = passages(seed)
    limits = [automata.LIMITS, automata.Limits(shard=40, stream=60, piece=7, run=128, sent=256)][seed]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("doc", F.lit("x")).withColumn("tag", F.lit(1)).withColumn("at", F.lit(2)).repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in automata.substring_dedup(df, limits=limits).collect())
    assert got == plain_windows(docs)
    if seed:
        assert automata.substring_dedup(df.limit(0)).count() == 0
        with pytest.raises(TypeError):
            automata.substring_dedup(df.withColumn("doc_id", F.lit("x")))


def test_one_passage_in_every_document(spark):
    line = " ".join(f"w{k}" for k in range(30))
    docs = [(i, f"start{i} {line} " + " ".join(f"{i}x{k}" for k in range(i % 40))) for i in range(300)] + [(400, " ".join(f"v{k}" for k in range(150_000)) + " " + line)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    found = automata.substring_dedup(df, with_text=True, limits=automata.Limits(stream=500, sent=1 << 12))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()) == plain_windows(docs)
    assert {r.n_removed for r in found.filter("doc_id > 0").collect()} == {30} and found.filter("doc_id = 2").first().kept_text == "start2 2x0 2x1"


def test_automaton_statistics():
    rnd = random.Random(2)
    texts = [[rnd.choice([b"a", b"b"]) for _ in range(rnd.randrange(1, 60))] for _ in range(30)]
    docs = [rnd.randrange(20) for _ in texts]
    least = {}
    for d, t in zip(docs, texts):
        for i in range(len(t) - 12):
            least[tuple(t[i : i + 13])] = min(least.get(tuple(t[i : i + 13]), d), d)
    automaton = automata.Automaton.unpacked(automata.Automaton.of(texts, docs).packed())
    asked = [[rnd.choice([b"a", b"b"]) for _ in range(rnd.randrange(200))] + rnd.choice(texts) + [b"new"] * (k % 2) for k in range(40)]
    own = np.array([rnd.randrange(25) for _ in asked])
    for text, d, got in zip(asked, own.tolist(), automaton.windows(asked, own)):
        assert got.tolist() == [i for i in range(len(text) - 12) if least.get(tuple(text[i : i + 13]), d) < d]
