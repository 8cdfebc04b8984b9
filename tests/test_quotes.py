"""The quote gate over tables against brute force over all pairs."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from callweave.functions import spans as S
from callweave.operators import redaction as X
from callweave.plans import texts as plan


class Given:
    def __init__(self, benchmark, clean_transcripts):
        self.benchmark, self.clean_transcripts = benchmark, clean_transcripts


def test_quotes_equal_brute_force(spark):
    dice = random.Random(7)
    word = lambda: "".join(dice.choice("abcdef") for _ in range(dice.choice((1, 2, 2, 3))))
    said = lambda n: [word() for _ in range(n)]
    heads = {i: said(dice.choice((1, 2, 3, 3, 4, 5, 7, 10, 13, 20))) for i in range(40)} | {40: ["ab"] * 9, 41: ["kg", "ab", "ab", "cd"]}
    texts = {}
    for d in range(150):
        body = said(dice.choice((0, 3, 15, 40)))
        for i in dice.sample(sorted(heads), 2):
            part = list(heads[i])
            for _ in range(dice.choice((0, 0, 1, 2, 3, 4))):
                at = dice.randrange(len(part) + 1)
                part[at : at + dice.choice((0, 1, 1))] = dice.choice(([], said(1)))
            at = dice.randrange(len(body) + 1)
            body[at:at] = [*dice.choice(([], ["x" + part[0]] if part else [])), *part]
        texts[d] = " ".join(w.title() if dice.random() < 0.2 else w + dice.choice((",", ".", "", "", "")) for w in body)
    texts |= {1000: "so Kg ab ab cd", 1001: "kg İ ab ab, cd", 1002: "", 1003: "pre" + " ".join(heads[5]) + "post"}
    want = {}
    for i, head in heads.items():
        for d, text in texts.items():
            kept, exact, snapped, _ = S.verbatim_gate([" ".join(head)], text)
            if exact + snapped:
                want[i, d] = (kept, exact, snapped)
    given = Given(
        spark.createDataFrame([(i, " ".join(h)) for i, h in heads.items()], "item_id long, text string"),
        spark.createDataFrame(list(texts.items()), "call_id long, text string"),
    )
    got = {(r.item_id, r.call_id): (r.phrases, r.exact, r.snapped) for r in plan._quoted(given).collect()}
    assert got == want
    assert sum(x[1] for x in want.values()) > 50 and sum(x[2] for x in want.values()) > 50


def test_several_automata_and_shuffled_probes_give_the_same_pairs(spark):
    dice = random.Random(9)
    said = lambda n: " ".join(dice.choice(("ab", "cd", "ef", "gh", "ij")) for _ in range(n))
    phrases = spark.createDataFrame([(i, said(dice.choice((1, 2, 5, 9)))) for i in range(30)] + [(30, ""), (31, None), (32, "ab cd"), (33, "AB, cd!")], "item_id long, phrase string")
    texts = spark.createDataFrame([(i, said(dice.randrange(60))) for i in range(60)] + [(None, "ab cd"), (61, None)], "call_id long, text string")
    pairs = lambda **limits: sorted(map(str, X.quote_pairs(phrases, texts, **limits).collect()))
    plain = {(i.item_id, t.call_id) for i in phrases.collect() for t in texts.collect() if S.verbatim(i.phrase or "") in S.verbatim(t.text or "")}
    assert {(r.item_id, r.call_id) for r in X.exact_pairs(phrases, texts, 20).collect()} == plain
    assert pairs() == pairs(automaton=20, broadcast=0)


def test_a_long_text_is_gated_in_time():
    dice = random.Random(1)
    head = [f"w{k}" for k in range(60)]
    shuffled = " ".join(w for _ in range(4000) for w in dice.sample(head, 60))
    began = time.perf_counter()
    assert S.verbatim_gate([" ".join(head)], shuffled)[3] == 1 and S.verbatim_gate([" ".join(head)], f"{shuffled} {' '.join(head[:-2])} x y")[2] == 1
    assert len(shuffled) > 900_000 and time.perf_counter() - began < 20


def test_windows_in_step_equal_one_by_one():
    dice = random.Random(2)
    for size in (1, 5, 63, 64, 65, 130):
        a, b = ([dice.randrange(9) for _ in range(n)] for n in (size, 300))
        b = [x if x < 8 else -1 for x in b]
        starts = np.arange(len(b) - size + 1)
        got = S.lcs_windows(np.array(a), np.array(b), starts, size).tolist()
        assert got == [S.lcs(list(map(str, a)), list(map(str, b[s : s + size]))) for s in starts.tolist()] == [plain_lcs(a, b[s : s + size]) for s in starts.tolist()]


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_passage_inside_a_sentence_is_found(spark):
    phrase = "The boiler has leaked since monday. Nobody came to fix it."
    texts = [(1, "They said the boiler has leaked since monday nobody came to fix it and left."), (2, "The boiler has dripped since monday. Nobody rushed to fix it."), (3, "All is well.")]
    given = Given(spark.createDataFrame([(1, phrase)], "item_id long, text string"), spark.createDataFrame(texts, "call_id long, text string"))
    assert {(r.call_id, r.exact, r.snapped) for r in plan._quoted(given).select("call_id", "exact", F.col("snapped")).collect()} == {(1, 1, 0), (2, 0, 1)}


def test_snap_skips_only_what_cannot_reach(spark):
    dice = random.Random(3)
    for _ in range(300):
        phrase, text = (" ".join(dice.choice("abcd") for _ in range(n)) for n in (dice.randrange(1, 7), dice.randrange(0, 20)))
        free, bound = S.snap(phrase, text), S.snap(phrase, text, 0.7)
        wanted, words = phrase.split(), text.split()
        each = [(S.lcs(wanted, words[i : i + n]) / max(len(wanted), n), " ".join(words[i : i + n])) for n in (len(wanted) - 1, len(wanted), len(wanted) + 1) if n > 0 for i in range(len(words) - n + 1)]
        best = max((e[0] for e in each), default=None)
        assert free == (None if best is None else next((w, x) for x, w in each if x == best))
        if best is not None and best >= 0.7:
            assert bound == free


def test_words_of_texts_are_counted_by_batch(spark):
    texts = spark.createDataFrame([(i, "the the cat's k " * 50) for i in range(40)], "call_id long, text string").coalesce(1)
    rows, n = X._word_counts(texts, frozenset(["the", "cats", "k"])).collect(), {}
    for r in rows:
        n[r.word] = n.get(r.word, 0) + r.n
    assert n == {"the": 4000, "cats": 2000, "k": 2000} and len(rows) <= 3 * 40
    words = texts.selectExpr("CAST(call_id AS STRING) AS word")
    assert X._few(words, 39) is None and len(X._few(words, 40)) == 40
