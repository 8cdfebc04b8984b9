"""Scans over large tables: rows over all cores, hints that hide no match, work that is done once."""

import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from callweave import plans
from callweave.functions import patterns as P
from callweave.functions import spans as S
from callweave.operators import tagger as G

SF = "/root/testdata/sf0.001"
BITS = [
    "five", "Double", "oh", "nine", "KONE", "İ", "K", "3", "555 123 4567", "4111 1111 1111 1111", "123-45-6789", "SSN: ", "passport no 9912345", "@", "＠", " at ", "DOT", ".com", "bob", "my name is ",
    "this is ", "it's ", "Ada", "Byron Lee", "ask for", "Main", "and", "&", "near", "cross of", "12th", "Oak", "Ave", "way", "12 Old Oak Street, apt 4B", "zip", "Suite 5", "\n", "　", ",", "é", "seven", "six",
]


def test_hints_hide_no_match():
    dice = random.Random(5)
    patterns = {S.phones: P.PHONES, S.street_addresses: [P.STREET_ADDRESS], S.cross_streets: P.CROSS_STREETS}
    found = dict.fromkeys(patterns, 0)
    for _ in range(4000):
        text = "".join(dice.choice(BITS) + dice.choice(["", " ", " "]) for _ in range(dice.randrange(1, 12)))
        for find, tried in patterns.items():
            want = {s.start for p in tried for s in S._hits(text, p, "")}
            assert {s.start for s in find(text)} <= want and bool(find(text)) == bool(want)
            found[find] += bool(want)
        assert S.greeted_names(text) == [s for p in P.GREETED_NAMES for s in S._hits(text, p, "name", 1)]
        assert {s.start for s in S._hits(text, P.EMAIL_LIKE[1], "")} <= {s.start for s in S.email_like(text)}
        assert S.squeezed(text) == S._OTHER.sub("", text.lower()) == S.Squeezed(text).text and len(S.Squeezed(text).places) == len(S.squeezed(text))
    assert min(found.values()) > 5


def test_a_sanitised_export_uses_all_cores(spark):
    assert plans.queries()["op_22"](spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_names_of_many_texts_are_those_of_each():
    dice = np.random.default_rng(4)
    words = ["Ada", "said", "that", "Byron", "LEE", "it", "İ", "x9", "é", "don't", "calls", "\ud800", "a_b", "12"]
    texts = [" ".join(dice.choice(words, n)) for n in [*dice.integers(0, 400, 40)]] + ["", " ", "a " * 900, "w" * 70 + " said Ada"]
    read = [w for w in map(G.WORD.findall, texts) if G._short(w)]
    assert len(read) > 5 and np.array_equal(np.concatenate([G.features(w) for w in read if w]), np.stack([c % G.BUCKETS for c in G.buckets(read)], axis=1))
    one = G.Tagger(dice.normal(size=(G.BUCKETS, 3)), dice.normal(size=(4, 3)))
    one.weights[:, 0] += 1
    rounded = lambda found: [s._replace(confidence=round(s.confidence, 6)) for s in found]
    each = [rounded(S.ner(t, one.model())[0]) for t in texts]
    assert [rounded(found) for found in S.ner_of_many(texts, one.many(), together=5000)] == each and any(each)


def test_names_of_customers_use_all_cores(spark, monkeypatch):
    monkeypatch.setattr(plans.texts.G, "train", lambda *_: G.Tagger())
    got = plans.texts._names(plans.texts.Tables(spark, SF))
    assert got.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism, got.rdd.getNumPartitions()


def test_workers_get_few_texts_at_once(spark):
    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for given in ("10000", "0", "7"):
            spark.conf.set(key, given)
            plans.queries()["pii_07"](spark, SF)
            seen.append(int(spark.conf.get(key)))
    finally:
        spark.conf.set(key, before)
    assert seen == [500, 500, 7]


def test_client_terms_count_as_spans_of_a_dense_text(spark, tmp_path):
    said = {1: "1234567 . x . thonou . x . thonou . x . thonou . x . thonou . x . general public license", 2: "thonou " * 4, 3: "thonou " * 5, 4: "1234567 " + "x " * 400}
    for name in ("customer", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0 if name == "documents" else 5).createOrReplaceTempView(f"few_{name}")
    rows = spark.createDataFrame(list(said.items()), "doc_id long, text string")
    have = spark.table("few_documents")
    rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(have.schema[c].dataType).alias(c) for c in have.columns)).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.table("few_customer").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    for t in Path(SF).glob("*.parquet"):
        mine = tmp_path / t.name
        con.sql(f"CREATE VIEW {t.stem} AS SELECT * FROM '{mine}/*.parquet'" if mine.exists() else f"CREATE VIEW {t.stem} AS SELECT * FROM '{t}'")
    want = con.execute(f"SELECT call_id, short, dense, denied FROM ({plans.oracle_sql()['pii_26']}) AS q").fetchall()
    got = [tuple(r) for r in plans.queries()["pii_26"](spark, str(tmp_path)).select("call_id", "short", "dense", "denied").collect()]
    assert sorted(got) == sorted(want) and {i for i, _, dense, _ in got if dense and i > 0 and i < 10} == {1, 3}


def test_a_filter_of_the_nearest_stretch_does_not_find_it_twice(spark):
    plan = plans.queries()["txt_02"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [run(phrase") == 1


def test_texts_that_are_no_suspects_hold_nothing():
    dice = random.Random(11)
    bits, seen = [*BITS, "General", "Public", "license", "aB", "triple", "cat", "(dot)", "[ dot ]", "com", "org", "host"], Counter()
    deny = ["general public license", "AB", "İx-ray", " "]
    texts = ["".join(dice.choice(bits) + dice.choice(["", " ", " ", "-"]) for _ in range(dice.randrange(1, 7))) for _ in range(6000)]
    for terms in ([], deny):
        for text, suspect in zip(texts, S.suspects(pa.array(texts), terms)):
            seen[suspect] += 1
            if not suspect:
                assert S.redact(text, terms) == S.untouched(text) and not S.residual(text, (), terms) and not S.address_like(text), text
    assert min(seen.values()) > 500 and S.suspects(pa.array(["", None], pa.string()), deny) == [False, False]


def test_digit_patterns_are_tried_in_digit_runs_alone():
    dice = random.Random(12)
    bits = ["+1", "(", ")", "555", "4111", "12", "7", "İ", "K", "é", "·", "-", " ", "x", ",", ".", "0000", "1 2"]
    for _ in range(4000):
        text = "".join(dice.choice(bits) for _ in range(dice.randrange(4, 24)))
        for find, patterns in ((S.phones, P.PHONES), (S.government_ids, P.GOVERNMENT_IDS)):
            assert {s[:2] for s in find(text)} == {s[:2] for s in S.uncontained(s for p in patterns for s in S._hits(text, p, ""))}
        assert [s[:2] for s in S._in_runs(text, P.CARD, "")] == [s[:2] for s in S._hits(text, P.CARD, "")]


def test_a_clean_text_is_asked_once(monkeypatch):
    asked = []

    class Asked:
        def search(self, text):
            asked.append(text)

    monkeypatch.setattr(P, "LIKE_HINT", Asked())
    assert not S.redact("a text without anything in it, long enough to be no short one", ["thonou"]).spans and len(asked) == 1


def test_a_report_deals_out_no_texts(spark):
    plan = plans.queries()["op_42"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [at for at, line in enumerate(plan.splitlines()) if "Join" in line]
    scans = [at for at, line in enumerate(plan.splitlines()) if "EvalPython" in line]
    assert len(scans) == 2 and scans[0] < joins[0] < scans[1], plan
