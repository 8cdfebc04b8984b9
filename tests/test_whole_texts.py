"""Detectors and nearest windows over whole texts of documents, against plain Python over every text."""

import pytest

from callweave.functions import spans as S
from callweave.plans import registry, texts

FILL = "nothing to see here, the weather was fine. " * 400
SAID = ["We live at 77 Old Mill Road, apt 4B, thanks. ", "dial five five five oh one two nine please. ", "Hello, my name is Ada Byron and so on. ", "the address has 412 in it. ", "Bob came. "]
TEXTS = {1: FILL + "".join(SAID), 2: FILL + SAID[0] + FILL + SAID[2], 3: SAID[1] + FILL + SAID[3], 4: FILL, 5: ""}
FOUND = {"street_address": S.street_addresses, "spelled_digits": S.spelled_digits, "greeted_name": S.greeted_names, "address_digits": S.address_digits, "composite": S.detect}


class Given:
    def __init__(self, spark, texts, heads=()):
        self.clean_transcripts = spark.createDataFrame(list(texts.items()), "call_id long, text string")
        self.benchmark = spark.createDataFrame(list(heads), "item_id long, text string")


@pytest.mark.parametrize("name", FOUND)
def test_documents_are_scanned(spark, name):
    want = sorted((d, s.start, s.end, s.kind) for d, text in TEXTS.items() for s in FOUND[name](text))
    got = texts._found(name)(Given(spark, TEXTS)).select("call_id", "start", "end", "kind").collect()
    assert sorted(map(tuple, got)) == want and any(start > len(FILL) // 2 for _, start, *_ in want)


def test_stand_in_model_over_documents(spark):
    want = sorted((d, s.start, s.end, s.kind) for d, text in TEXTS.items() for s in S.align(text, texts.stub_model(text))[0])
    got = registry.REGISTRY["pii_18"][0](Given(spark, TEXTS)).select("call_id", "start", "end", "kind").collect()
    assert sorted(map(tuple, got)) == want != []


def test_nearest_windows_of_documents(spark):
    heads = [(1, "the boiler has leaked since monday and nobody came"), (2, "five five five oh one two nine please"), (3, "zebra lion tiger bear")]
    said = TEXTS | {6: "so The boiler has dripped since monday, and nobody came. Zebra"}
    want = set()
    for i, head in heads:
        for d, text in said.items():
            if (near := S.snap(head, text)) is not None and near[1] >= 0.7:
                want.add((i, d, *near))
    got = {tuple(r) for r in registry.REGISTRY["txt_02"][0](Given(spark, said, heads)).select("item_id", "call_id", "span", "likeness").collect()}
    assert got == want and {(i, d) for i, d, *_ in want} >= {(1, 6), (2, 1), (2, 3)}
