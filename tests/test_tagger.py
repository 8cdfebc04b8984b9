"""Names in held-out documents: recall and precision of the trained tagger; decoding against all taggings."""

import itertools
import random

import numpy as np

from callweave.functions import spans as S
from callweave.operators import tagger as T
from callweave.plans import texts as plan

SF = "/root/testdata/sf0.001"


def test_viterbi_equals_all_taggings():
    dice = np.random.default_rng(1)
    for n in range(1, 6):
        found = dice.integers(0, T.BUCKETS, (n, 4))
        one = T.Tagger(np.zeros((T.BUCKETS, 3)), dice.normal(size=(4, 3)))
        one.weights[found.ravel()] = dice.normal(size=(found.size, 3))
        score = one.weights[found].sum(axis=1)
        total = lambda tags: sum(one.moves[b, t] + score[i, t] for i, (b, t) in enumerate(zip([-1, *tags], tags)))
        allowed = [t for t in itertools.product(range(3), repeat=n) if all(x != 2 or (i and t[i - 1] != 0) for i, x in enumerate(t))]
        tags, best = one.decode(found)
        assert tuple(tags) == max(allowed, key=total) and abs(best - total(tags)) < 1e-9


def test_names_in_documents_that_training_has_not_seen(spark):
    dice = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) BETWEEN 100 AND 3000").orderBy("doc_id").collect()]
    first, last = plan.GIVEN_NAMES, ["Algeria", "Brazil", "Canada", "Egypt", "France", "Peru", "Russia", "Kenya", "Japan", "China"]

    def document(text, a, b):
        name, at = f"{dice.choice(a)} {dice.choice(b)}", dice.randrange(len(text) // 2)
        at = text.find(" ", at) + 1
        head, tail = dice.choice(plan.INTRODUCED)
        whole = f"{text[:at]}{head}{name}{tail}{text[at:]}"
        return whole, [(at + len(head), at + len(head) + len(name))]

    seen = [document(t, first[:8], last[:5]) for t in texts[:100] for _ in range(3)]
    held = [document(t, first[8:], last[5:]) for t in texts[100:]]  # other texts, other names
    rows = spark.createDataFrame([(i, t, [{"start": s, "end": e} for s, e in n]) for i, (t, n) in enumerate(seen)], "id long, text string, names array<struct<start:int,end:int>>")
    fitted = T.train(rows.unionByName(spark.createDataFrame([(900 + i, t, []) for i, t in enumerate(texts[:100])], rows.schema)))
    model = fitted.model()
    found = [{(s.start, s.end) for s in S.ner(t, model)[0] if s.kind == "name"} for t, _ in held]
    hits = sum(set(n) <= f for f, (_, n) in zip(found, held))
    recall, precision = hits / len(held), hits / max(1, sum(map(len, found)))
    assert len(held) >= 40 and recall >= 0.9 and precision >= 0.9, (recall, precision)
    again = T.train(rows.unionByName(spark.createDataFrame([(900 + i, t, []) for i, t in enumerate(texts[:100])], rows.schema)).repartition(5))
    assert np.allclose(again.weights, fitted.weights)  # whatever the layout of the table
    nothing = T.train(rows.limit(0))
    assert nothing.model()("my name is Ada Byron") == [("O", p, w) for w, p in zip("my name is Ada Byron".split(), [x[1] for x in nothing.model()("my name is Ada Byron")])]
    assert nothing.model()("") == []


def test_the_query_finds_the_names_it_was_not_trained_on(spark):
    rows = plan._introduced(plan.Tables(spark, SF)).select("call_id", "text", "start", "end").collect()
    got: dict = {}
    for r in plan._names(plan.Tables(spark, SF)).filter("call_id >= 0").collect():
        got.setdefault(r.call_id, set()).add((r.start, r.end))
    hits = sum((r.start, r.end) in got.get(r.call_id, ()) for r in rows)
    assert hits >= 0.9 * len(rows) and sum(map(len, got.values())) <= hits / 0.9
