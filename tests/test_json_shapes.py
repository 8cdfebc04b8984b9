"""JSON over variants against plain Python."""

import json
import random

from pyspark.sql import functions as F

from callweave.operators import redaction as X


def plain_leaves(node, path=""):
    if isinstance(node, dict):
        return {p for k, v in node.items() for p in plain_leaves(v, f"{path}.{k}" if path else k)} or {f"{path}:object"}
    if isinstance(node, list):
        return {p for v in node for p in plain_leaves(v, f"{path}[]")} or {f"{path}[]:empty"}
    return {f"{path}:{'null' if node is None else 'boolean' if isinstance(node, bool) else 'string' if isinstance(node, str) else 'number'}"}


def made(dice, depth):
    kind = dice.randrange(8 if depth else 5)
    if kind < 5:
        return (None, dice.random() < 0.5, dice.randrange(-5, 10**12), dice.choice((1.5, -0.25)), dice.choice(("", "é\"x", "3")))[kind]
    if kind < 7:
        return {dice.choice("abcdé"): made(dice, depth - 1) for _ in range(dice.randrange(4))}
    return [made(dice, depth - 1) for _ in range(dice.randrange(4))]


def test_leaves_and_canonical_texts(spark):
    dice = random.Random(1)
    nodes = [made(dice, 4) for _ in range(150)]
    rows = [(i, json.dumps(n, ensure_ascii=dice.random() < 0.5, indent=dice.choice((None, 2)))) for i, n in enumerate(nodes)] + [(900, None), (901, ""), (902, "{"), (903, "[]"), (904, "{}"), (905, "{}")]
    df = spark.createDataFrame(rows, "id long, body string").repartition(3)
    got = sorted((r.id, r.leaf) for r in X.json_leaves(df, "id", "body").collect())
    want = sorted((i, leaf) for i, n in [*enumerate(nodes), (903, []), (904, {}), (905, {})] for leaf in plain_leaves(n))
    assert got == want
    texts = {r.id: r.v for r in df.select("id", X.canonical_json(F.col("body")).alias("v")).collect()}
    assert all(texts[i] == json.dumps(n, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, n in enumerate(nodes))
    assert texts[900] is None and texts[902] is None and X.json_leaves(df.limit(0), "id", "body").count() == 0
