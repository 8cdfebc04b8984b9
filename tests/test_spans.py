"""Text operators: detectors, merge, tokens, repair, scan, phrases."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.functions import patterns as P
from callweave.functions import spans as S


def cut(text, spans):
    return [text[s.start : s.end] for s in spans]


@pytest.mark.parametrize(
    "find, text, expected",
    [
        (S.phones, "ring (212) 555-0199 or 212.555.0198 x", ["(212) 555-0199", "212.555.0198"]),
        (S.phones, "it is 5 5 5, 0 1 4 4 now", ["5 5 5, 0 1 4 4"]),
        (S.phones, "order 12345 of 6789", []),
        (S.emails, "to ann.lee@mail.example.org.", ["ann.lee@mail.example.org", "lee@mail.example.org."]),
        (S.emails, "ann dot lee at example dot com", ["ann dot lee at example dot com"]),
        (S.street_addresses, "at 77 Old Mill Road, apt 4B today", ["77 Old Mill Road, apt 4B"]),
        (S.cross_streets, "meet Oak and 3rd Avenue please", ["Oak and 3rd Avenue"]),
        (S.cross_streets, "Ann and Bob", []),
        (S.cards, "pay 4539 1488 0343 6467 or 4539 1488 0343 6468", ["4539 1488 0343 6467"]),
        (S.government_ids, "ssn is 078-05-1120; passport number: X1234567", ["078-05-1120", "X1234567"]),
        (S.long_numbers, "no 12-34 5678 ok", ["12-34 5678"]),
        (S.long_numbers, "123 and 4567", []),
        (S.spelled_digits, "double five three oh one two nine end", ["double five three oh one two nine"]),
        (S.spelled_digits, "one two three", []),
        (S.greeted_names, "my name is Ada Byron here", ["Ada Byron"]),
        (S.greeted_names, "this is Ada", []),
        (S.address_digits, "my address is 4410 somewhere near the old mill and the wide river, 55 far", ["4410"]),
    ],
)
def test_detectors(find, text, expected):
    assert cut(text, find(text)) == expected


def test_deny_terms_and_values():
    text = "We called Blue Door-Plumbing and BlueDoorPlumbing; Al met Al-ice"
    assert cut(text, S.denied(text, ["blue door plumbing"])) == ["Blue Door-Plumbing"]
    assert cut(text, S.denied_anywhere(text, ["blue door plumbing", "x"])) == ["Blue Door-Plumbing", "BlueDoorPlumbing"]
    assert S.value_occurrences(text, "Al") == []
    assert cut(text, S.value_occurrences(text, "met")) == ["met"]


def test_merge_labels_and_flags():
    a = S.Span(0, 5, "name", "ner", 0.9)
    b = S.Span(3, 9, "phone")
    merged, mixed = S.merge([a, b, S.Span(9, 12, "phone"), S.Span(12, 14, "email")])
    assert merged == [S.Span(0, 12, "phone", "regex", 0.9), S.Span(12, 14, "email")] and mixed


def test_tokens_are_shared_and_numbered():
    text = "Ann Lee, ann  lee. Bob"
    done = S.tokenize(text, [S.Span(0, 7, "name"), S.Span(9, 17, "name"), S.Span(19, 22, "name")])
    assert done.text == "[NAME_1], [NAME_1]. [NAME_2]"
    assert done.vault == [("[NAME_1]", "Ann Lee"), ("[NAME_2]", "Bob")]


def test_residual_categories():
    found = S.residual("my name is Ada, zip 99; one two three four five six seven; a@b 1234567 [PHONE_12345678]", ["secret value"], ["zip"])
    assert found == {"digit_run": 1, "spelled_out_digits": 1, "email_like": 1, "address_like": 1, "name_like_after_greeting": 1, "deny_list_term": 1}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["Ann Lee", "my name is", "212 555 0199", "five", "double", "@", "x@y.com", "12", "Main Street", "and", "apt", "zip code", "é", "blue door", "\n", "4539148803436467"]), max_size=25))
def test_redaction_invariants(words):
    text = " ".join(words)
    done = S.redact(text, ["blue door"])
    assert done.residual == {}
    starts = [s.start for s in done.spans]
    assert starts == sorted(starts) and all(a.end <= b.start for a, b in zip(done.spans, done.spans[1:]))
    back, at = [], 0
    rebuilt = S.tokenize(text, done.spans)
    assert rebuilt.text == done.tokenized.text
    for s in done.spans:
        back += [text[at : s.start], text[s.start : s.end]]
        at = s.end
    assert "".join(back) + text[at:] == text


def test_model_alignment_and_scope():
    text = "we saw mr jon vance at 44 Willow Park"
    tokens = [("O", 1.0, "we"), ("O", 1.0, "saw"), ("O", 1.0, "mr"), ("B-PER", 0.8, "jon"), ("B-PER", 1.0, "van"), ("I-PER", 0.6, "##c"), ("O", 1, "at"), ("O", 1, "44"), ("B-LOC", 0.9, "Willow"), ("I-LOC", 0.9, "Park")]
    spans, failed, cut_off = S.align(text, tokens)
    assert [(text[s.start : s.end], s.kind) for s in spans] == [("jon vance", "name"), ("Willow Park", "location")] and not failed and not cut_off
    assert S.align(text, [("B-PER", 1.0, "[UNK]")])[1]
    found, reasons = S.ner(text, lambda t: tokens, least=0.5)
    assert [text[s.start : s.end] for s in found] == ["jon vance", "44 Willow Park"] and reasons == []
    assert S.ner(text, lambda t: tokens, least=0.95)[1] == ["ner_low_confidence"]
    assert S.title_case("it's ann o'neil") == "It's Ann O'neil"
    assert S.chunks(10, 4, 1) == [0, 3, 6]


def test_verbatim_gate():
    text = "The heater’s leaking since Monday and nobody came to fix it."
    kept, exact, snapped, dropped = S.verbatim_gate(["heaters leaking", "since monday nobody came to fix it", "blue sky", ""], text)
    assert kept == ["heaters leaking", "since Monday and nobody came to fix it", ""] and (exact, snapped, dropped) == (2, 1, 1)
    assert S.lcs("a b c d".split(), "b x d".split()) == 2


PARTS = ["at", "AT", "dot", "(dot)", "[at]", "( at )", "com", "net", "org", "a", "bob", "x1", "-", "%", "+", ".", "@", "＠", " ", "  ", "\n", "_", "double", "five", "Ada", "7", "é", "K", "blue", "&"]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PARTS), st.sampled_from(["", "", " ", "  "])), max_size=16))
def test_emails_equal_a_search_from_the_left(parts):
    text = "".join(a + b for a, b in parts)
    hits = lambda p: [S.Span(*m.span(), "email") for m in p.finditer(text)]
    like = hits(P.EMAIL_LIKE[0]) + hits(P.EMAIL_LIKE[1])
    assert S.email_like(text) == like
    assert S.emails(text) == S.uncontained([*hits(P.EMAIL), *hits(P.EMAIL_SPOKEN_OUT), *like])


def folded(spans):
    """merge() by taking one span after the other into the last one."""
    out, mixed = [], False
    strength = lambda s: (S.PRIORITY[s.detector], s.end - s.start)
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        last = out[-1] if out else None
        if last is None or s.start > last.end or (s.start == last.end and s.kind != last.kind):
            out.append(s)
            continue
        mixed |= s.kind != last.kind
        name = s if strength(s) > strength(last) else last
        sure = [c for c in (last.confidence, s.confidence) if c is not None]
        out[-1] = S.Span(last.start, max(last.end, s.end), name.kind, name.detector, min(sure) if sure else None)
    return out, mixed


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from(["phone", "name", "email"]), st.sampled_from(["regex", "ner", "deny_list"]), st.sampled_from([None, 0.5, 0.9])), max_size=9))
def test_merge_equals_a_fold(raw):
    spans = [S.Span(a, a + n, kind, detector, sure) for a, n, kind, detector, sure in raw]
    assert S.merge(spans) == folded(spans)


@pytest.mark.parametrize("text", ["x" * 1_000_000 + "@", "@" * 300_000, "a." * 500_000 + "@b", "ab " * 300_000, "9" * 1_000_000, "A" * 1_000_000 + " at b dot"])
def test_long_texts_take_no_longer_than_they_are(text):
    began = time.perf_counter()
    S.redact(text)
    assert time.perf_counter() - began < 20


def test_runs_of_spoken_digits():
    assert S.spoken("double five triple one nine") == 6 and S.spoken("") == 0
    text = "oh double one two, triple three end one"
    assert cut(text, S.spelled_digits(text)) == ["oh double one two, triple three"]


def test_vaulted_values_that_reappear():
    assert S.reappearing(["Ann Lee", "al", "Bo Xi", "General Public"], "the GENERAL-public said bo xi [NAME_1]") == [False, False, True, True]
    assert S.reappears("Ann", "[ANN_1] anne") is False


# -- long texts ---------------------------------------------------------------


def growth(work, sizes=(10_000, 20_000, 40_000)):
    """How many times longer each doubling takes, by the best of three."""
    times = []
    for n in sizes:
        each = []
        for _ in range(3):
            began = time.perf_counter()
            work(n)
            each.append(time.perf_counter() - began)
        times.append(min(each))
    return [b / a for a, b in zip(times, times[1:])]


PHONES = " ".join(f"212 555 {1000 + i % 9000}" for i in range(8000))


@pytest.mark.parametrize(
    "work",
    [lambda n: S.address_digits("zip 1 " * n), lambda n: S.detect(PHONES[: 13 * n // 10]), lambda n: S.redact(PHONES[: 13 * n // 10]), lambda n: S.merge([S.Span(i, i + 1, "a") for i in range(n)]),
     lambda n: S.tokenize("ab " * n, [S.Span(3 * i, 3 * i + 2, "name") for i in range(n)]), lambda n: S.Masked("ab " * n, [S.Span(3 * i, 3 * i + 2, "name") for i in range(n)])],
)
def test_work_grows_with_the_text(work):
    assert sum(growth(work)) / 2 < 2.8


def test_ten_thousand_values_in_a_long_text():
    dice = random.Random(1)
    values = ["".join(dice.choice("abcdefghij") for _ in range(dice.randrange(3, 14))) for _ in range(10_000)]
    words = [dice.choice(values) if dice.random() < 0.2 else "".join(dice.choice("abcdefghij") for _ in range(6)) for _ in range(140_000)]
    text, began = " ".join(words), time.perf_counter()
    found = S.Values(values).occurrences(S.Read(text), ["other"] * len(values))
    assert time.perf_counter() - began < 5
    flat = text.replace(" ", "")
    for value, spans in zip(values[:300], found):
        assert len(spans) == (flat.count(value) if len(value) >= P.VALUE_COLLAPSED else words.count(value)), value


def test_very_long_needles():
    text = "b" + "a" * 300_000 + "b" + "a" * 900 + "xy" * 700 + "c"
    needles = ["a" * 200_000, "a" * 1500, "a" * 1000, "xy" * 600, "xy" * 701, text, "b" + "a" * 300_000 + "b", "a" * 300_001]
    found = S.Needles(needles)
    plain = {n: [] for n in needles if n in text}
    for n in plain:
        at = text.find(n)
        while at >= 0:
            plain[n].append((at, at + len(n)))
            at = text.find(n, at + len(n))
    assert found.disjoint(text) == plain and found.present(text) == set(plain)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=12), st.integers(0, 30), st.integers(1, 9))
def test_cover_equals_any(pairs, start, size):
    intervals = [(s, s + n) for s, n in pairs]
    cover, end = S.Cover(intervals), start + size
    assert cover.contains(start, end) == any(s <= start and end <= e for s, e in intervals)
    assert cover.touches(start, end) == any(start < e and end > s for s, e in intervals)


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=30), st.lists(st.tuples(st.integers(0, 3), st.integers(1, 4)), max_size=6))
def test_masked_places_come_back(text, steps):
    spans, at = [], 0
    for gap, size in steps:
        if at + gap + size <= len(text):
            spans.append(S.Span(at + gap, at + gap + size, "name"))
            at += gap + size
    masked = S.Masked(text, spans)
    places, at = [], 0
    for s in spans:
        places += [*range(at, s.start), None]
        at = s.end
    places += range(at, len(text))
    assert masked.text == "".join(" " if p is None else text[p] for p in places)
    for i in range(len(places)):
        for j in range(i + 1, len(places) + 1):
            real = [p for p in places[i:j] if p is not None]
            assert masked.back(S.Span(i, j, "x")) == (S.Span(real[0], real[-1] + 1, "x") if real else None)
