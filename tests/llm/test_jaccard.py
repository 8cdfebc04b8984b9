"""The shingle join against brute force, with every path forced by small limits."""

import random
import re

import pytest

from callweave.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sets_of(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(docs):
    sets = [(d, sets_of(t)) for d, t in docs]
    root = {d: d for d, _ in docs if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if None not in (a, b) and both and 100 * both >= 80 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((str(d), len(s), str(None if d is None else find(d))) for d, s in sets)


def drifting(seed, groups=6, size=14, length=60):
    """Near copies of near copies, so that similarities lie on both sides of the limit; and a common passage."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [rnd.choice(vocabulary) for _ in range(25)]
    docs, n = [], 0
    for _ in range(groups):
        text = [rnd.choice(vocabulary) for _ in range(length)]
        for _ in range(size):
            text = list(text)
            for _ in range(rnd.choice((0, 1, 1, 2))):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            docs.append((n, " ".join(text + (common if rnd.random() < 0.3 else []))))
            n += 1
    docs += [(n, ""), (n + 1, None), (None, docs[0][1]), (n + 2, "Two words"), (n + 3, "two  WORDS"), (n + 4, docs[0][1]), (0, docs[0][1]), (n + 5, "a " * 4000), (n + 6, "a " * 9)]
    rnd.shuffle(docs)
    return docs


SETTINGS = [
    jaccard.LIMITS,
    jaccard.Limits(small=3, cell=1 << 20),  # one cell a tile
    jaccard.Limits(small=3, cell=4, splits=0),  # many cells
    jaccard.Limits(small=3, cell=4, strays=2, splits=0),  # and blocks of strays
    jaccard.Limits(small=3, cell=4, strays=2, splits=1),
    jaccard.Limits(small=3, cell=4, strays=1, splits=2, held=8, frequent=10, often=2),
]


@pytest.mark.parametrize("k", range(len(SETTINGS)))
def test_components_equal_brute_force(spark, monkeypatch, k):
    limits, seen = SETTINGS[k], {"cells": 0, "splits": 0}
    cells, split = jaccard._cells, jaccard._split

    def counted_cells(rows, *args):
        seen["cells"] += rows.count()
        return cells(rows, *args)

    def counted_split(members, *args):
        seen["splits"] += members.count()
        return split(members, *args)

    monkeypatch.setattr(jaccard, "_cells", counted_cells)
    monkeypatch.setattr(jaccard, "_split", counted_split)
    docs = drifting(67 + k)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, id string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df, limits=limits).collect())
    assert got == brute(docs)
    assert (seen["cells"] > 0) == (limits.small < 64) and (seen["splits"] > 0) == (limits.strays < 2048 and limits.splits > 0)


def test_links_that_only_a_split_tile_finds(spark):
    """One common passage that opens a large tile of strangers, and pairs in it that nothing else brings together."""
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(3000)]
    passage = [rnd.choice(words) for _ in range(12)]
    docs = []
    for i in range(120):
        own = [rnd.choice(words) for _ in range(20)]
        docs.append((2 * i, " ".join(passage + own)))
        if i % 3 == 0:
            docs.append((2 * i + 1, " ".join([*passage, *own[:-1], rnd.choice(words)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for limits in (jaccard.Limits(small=3, cell=4, strays=4, frequent=0), jaccard.Limits(small=8, cell=16, frequent=0)):
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.jaccard_components(df, limits=limits).collect()) == brute(docs)


def test_texts_made_to_collide_do_not_link(spark):
    """Thue-Morse words have one hash under every polynomial modulo 2^64."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    docs = [(1, "".join("ab"[x] for x in bits)), (2, "".join("ba"[x] for x in bits)), (3, "".join("ab"[x] for x in bits))]
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 1}


def test_very_long_text_and_clashing_names(spark):
    rnd = random.Random(8)
    long = " ".join(f"u{rnd.randrange(10**6)}" for _ in range(150_000))  # over 1 MB
    docs = [(1, long), (2, long + " more"), (3, long), (4, "x" * 1_000_000), (5, "x" * 1_000_000), (6, "x" * 999_999)]
    df = spark.createDataFrame([(d, t, 1, "a", 2, "b", 3) for d, t in docs], "doc_id long, text string, n int, label string, key int, bits string, component_id int")
    got = jaccard.jaccard_components(df).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert jaccard.one_of_each(df).columns == df.columns and sorted(r.doc_id for r in jaccard.one_of_each(df).collect()) == [1, 4, 6]


def test_empty_table_and_one_of_each(spark):
    df = spark.createDataFrame([(1, "x y z"), (2, "X y z"), (2, "X y z"), (None, "x y z"), (3, None)], "doc_id long, text string")
    assert jaccard.jaccard_components(df.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in jaccard.one_of_each(df).collect()) == ["1", "3", "None"]


def test_bound_is_never_below_the_overlap():
    import numpy as np

    rnd = np.random.default_rng(3)
    for _ in range(200):
        pool = rnd.integers(0, 1 << 62, 300).astype(np.uint64)
        a, b = (np.unique(rnd.choice(pool, rnd.integers(1, 200))) for _ in range(2))
        bits = [np.frombuffer(jaccard._signature(x), np.uint8) for x in (a, b)]
        assert jaccard.overlap_bound(bits[0], len(a), bits[1], len(b)) >= len(np.intersect1d(a, b))
