"""Detecting, merging, replacing and auditing personal data in one text.

Plain functions over a string; operators/redaction.py runs them on columns. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property, lru_cache, wraps
from itertools import accumulate, groupby, islice, pairwise
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import patterns as P


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    detector: str = "regex"
    confidence: float | None = None


PRIORITY = {"deny_list": 3, "regex": 2, "ner": 1}
_ALNUM = re.compile(r"[A-Za-z0-9]+", re.ASCII)
_LETTERS = re.compile(r"[A-Za-z]+", re.ASCII)
_OTHER = re.compile(r"[^a-z0-9]+")


def _table(keep: str, other: bytes) -> bytes:
    """A translation of bytes: what `keep` matches to lower case, anything else to `other`."""
    return b"".join(bytes([b]).lower() if re.match(keep.encode(), bytes([b])) else other for b in range(256))


#: ASCII letters in lower case, blanks for all other bytes; the same with digits; and bytes that are no digit, and neither letter nor digit.
_TO_LETTERS, _TO_ALNUM = _table("[A-Za-z]", b" "), _table("[A-Za-z0-9]", b" ")
_NO_DIGIT, _NO_ALNUM = (bytes(b for b in range(256) if not re.match(keep, bytes([b]))) for keep in (b"[0-9]", b"[A-Za-z0-9]"))
#: The only letters outside ASCII whose lower case holds an ASCII letter.
_ODD = {"\u0130": "i", "\u212a": "k"}
_ODDS = re.compile("[\u0130\u212a]")


#: Whether a code point, 128 for all outside ASCII, is a letter or a digit.
_IS_ALNUM = np.array([bool(re.match("[A-Za-z0-9]", chr(c))) for c in range(128)] + [False])


def _alnum(text: str) -> np.ndarray:
    """Whether each code point of a text is an ASCII letter or digit."""
    if text.isascii():
        return _IS_ALNUM[np.frombuffer(text.encode("ascii"), np.uint8)]
    return _IS_ALNUM[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def squeezed(text: str) -> str:
    """Lower case, letters and digits only (ASCII)."""
    if not text.isascii():
        for letter, plain in _ODD.items():
            text = text.replace(letter, plain)
    return _bytes(text).translate(_TO_ALNUM, _NO_ALNUM).decode("ascii")


def uncontained(spans: Iterable[Span]) -> list[Span]:
    """Spans by start, longest first, without those inside the one kept before."""
    kept: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if not kept or s.start < kept[-1].start or s.end > kept[-1].end:
            kept.append(s)
    return kept


class Cover:
    """What intervals cover together: sorted by start, with the furthest end so far, so that each question is one search."""

    def __init__(self, intervals: Iterable[tuple[int, int]]):
        ordered = sorted(intervals)
        self.starts = [s for s, _ in ordered]
        self.reach = list(accumulate((e for _, e in ordered), max))

    def _furthest(self, n: int) -> int:
        return self.reach[n - 1] if n else -1

    def contains(self, start: int, end: int) -> bool:
        """Whether one interval holds the whole of start to end."""
        return self._furthest(bisect_right(self.starts, start)) >= end

    def touches(self, start: int, end: int) -> bool:
        """Whether one interval begins before `end` and ends behind `start`."""
        return self._furthest(bisect_left(self.starts, end)) > start


def _outside(spans: Iterable[Span], others: Iterable[Span]) -> list[Span]:
    """The spans that none of the others contains."""
    cover = Cover((o.start, o.end) for o in others)
    return [s for s in spans if not cover.contains(s.start, s.end)]


def _hits(text: str, pattern: re.Pattern[str], kind: str, group: int = 0) -> list[Span]:
    return [Span(*m.span(group), kind) for m in pattern.finditer(text)]


class Squeezed:
    """squeezed(text) with the place in the text of each letter, worked out when first asked for."""

    def __init__(self, text: str):
        self.whole, self.text = text, squeezed(text)

    @cached_property
    def places(self) -> np.ndarray:
        good = _alnum(self.whole)
        for m in _ODDS.finditer(self.whole) if not self.whole.isascii() else ():
            good[m.start()] = True
        return np.flatnonzero(good)

    def span(self, start: int, end: int, kind: str, detector: str = "regex") -> Span:
        return Span(int(self.places[start]), int(self.places[end - 1]) + 1, kind, detector)

class Words:
    """The letter and digit words of a text in lower case, one blank round each, and where each stands."""

    def __init__(self, text: str):
        self.whole, self.text = text, f" {b' '.join(_bytes(text).translate(_TO_ALNUM).split()).decode('ascii')} "

    @cached_property
    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where in the text each word begins, and where each ends."""
        turns = np.flatnonzero(np.diff(_alnum(self.whole), prepend=False, append=False))
        return turns[::2], turns[1::2]

    @cached_property
    def starts(self) -> list[int]:
        """Where each word of `text` begins; at last its end."""
        return (np.flatnonzero(np.frombuffer(self.text.encode(), np.uint8) == ord(" ")) + 1).tolist()

    def span(self, start: int, end: int, kind: str, detector: str = "regex") -> Span:
        """The span of a stretch of `text` that begins and ends with a blank."""
        first, last = bisect_left(self.starts, start + 1), bisect_left(self.starts, end) - 1
        return Span(int(self.places[0][first]), int(self.places[1][last]), kind, detector)


class Read:
    """A text and its readings, each made once when asked for."""

    def __init__(self, text: str):
        self.text, self.found = text, {}

    @cached_property
    def letters(self) -> Squeezed:
        return Squeezed(self.text)

    @cached_property
    def words(self) -> Words:
        return Words(self.text)

    @cached_property
    def plain(self) -> bool:
        """Whether lower case puts no ASCII letter in place of another one."""
        return self.text.isascii() or not any(letter in self.text for letter in _ODD)

    @cached_property
    def low(self) -> str:
        """Letter by letter in lower case; what is not ASCII stays so."""
        text = self.text
        for letter in () if self.plain else _ODD:
            text = text.replace(letter, "\u0131")
        return text.lower()

    @cached_property
    def digits(self) -> int:
        """How many ASCII digits the text has."""
        return len(_bytes(self.text).translate(None, _NO_DIGIT))

    @cached_property
    def said(self) -> list[bytes]:
        """The words of ASCII letters alone, in lower case."""
        return _bytes(self.text).translate(_TO_LETTERS).split()


#: The readings of the last texts: detectors ask one after another for those of one text.
_read = lru_cache(maxsize=4)(Read)


def _once(scan: Callable) -> Callable:
    """A question about a text that is answered once, beside its readings: the detectors, the repair and the audit ask it in turn."""
    @wraps(scan)
    def run(text: str, *kind: str):
        found, key = _read(text).found, (scan, *kind)
        if key not in found:
            found[key] = scan(text, *kind)
        return found[key]

    return run


# -- single detectors ---------------------------------------------------------


# Each detector begins with a cheap question about what any match must have: so many digits, a word, a sign.
_SIGN, _AT, _DIGIT = re.compile("[@＠﹫]"), re.compile(r"\bat\b", re.I | re.ASCII), re.compile(r"\d", re.ASCII)


def _around(text: str, sign: re.Pattern[str], before: re.Pattern[str], after: re.Pattern[str]) -> list[Span]:
    """Disjoint e-mails, each found from its sign outwards: what `before` takes in backwards and `after` forwards.

    The same as a search for the whole from the left, without trying every start of a long unbroken text.
    """
    out, done = [], 0
    if not any(x in text for x in sign.pattern.strip("[]")):
        return out
    back = text[::-1]
    for m in sign.finditer(text):
        if m.start() < done or (right := after.match(text, m.end())) is None:
            continue
        left = before.match(back, len(text) - m.start())
        start, end = (max(done, len(text) - left.end()), len(text) - left.start(left.lastindex or 0))
        if start < end:
            out.append(Span(start, right.end(), "email"))
            done = right.end()
    return out


_WRITTEN = re.compile("@")


@_once
def email_like(text: str) -> list[Span]:
    return _around(text, _SIGN, P.LIKE_BEFORE, P.LIKE_AFTER) + (_hits(text, P.EMAIL_LIKE[1], "email") if P.LIKE_HINT.search(_read(text).low) else [])


_DIGITS = re.compile(rf"\d{{{P.LONG_RUN},}}", re.ASCII)


@_once
def long_numbers(text: str, kind: str = "number") -> list[Span]:
    """Runs of seven or more digits with nothing but marks and blanks between them."""
    if _read(text).digits < P.LONG_RUN:
        return []
    letters = _read(text).letters
    return [letters.span(m.start(), m.end(), kind) for m in _DIGITS.finditer(letters.text)]


def _in_runs(text: str, pattern: re.Pattern[str], kind: str) -> list[Span]:
    """Matches of a pattern of LONG_RUN digits or more with marks between them, and a mark before them: each lies in one such run."""
    return [Span(*m.span(), kind) for s in long_numbers(text) for m in pattern.finditer(text, max(0, s.start - 1), s.end)]


def phones(text: str) -> list[Span]:
    return uncontained(s for p in P.PHONES for s in _in_runs(text, p, "phone"))


def spoken_emails(text: str) -> list[Span]:
    """`name at host dot com`: looked for only where a host follows an `at`, from where its name can begin."""
    if "dot" not in _read(text).low or not _AT.search(text):
        return []
    out, done, back = [], 0, text[::-1]
    for m in _AT.finditer(text):
        if m.start() < done or (right := P.SPOKEN_AFTER.match(text, m.start())) is None:
            continue
        left = P.SPOKEN_BEFORE.match(back, len(text) - m.start())
        whole = P.EMAIL_SPOKEN_OUT.search(text, max(done, len(text) - left.end()), right.end())
        if whole is not None:
            out.append(Span(*whole.span(), "email"))
            done = whole.end()
    return out


def emails(text: str) -> list[Span]:
    return uncontained([*_around(text, _WRITTEN, P.EMAIL_LOCAL, P.EMAIL_DOMAIN), *spoken_emails(text), *email_like(text)])


@_once
def street_addresses(text: str) -> list[Span]:
    return uncontained(_hits(text, P.STREET_ADDRESS, "street_address")) if _read(text).digits and P.STREET_HINT.search(text) else []


_BLANKS = re.compile(P.SPACE + r"+\Z")


def cross_streets(text: str) -> list[Span]:
    found = [s for p in P.CROSS_STREETS for s in _hits(text, p, "cross_street")] if P.CONNECTED.search(text) else []
    return uncontained(s._replace(end=s.start + len(_BLANKS.sub("", text[s.start : s.end]))) for s in found)


def luhn(digits: str) -> bool:
    """Whether a run of digits passes the mod-10 check."""
    if not digits or not (digits.isascii() and digits.isdigit()):
        return False
    values = [int(d) for d in reversed(digits)]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(values)) % 10 == 0


def cards(text: str) -> list[Span]:
    found = _in_runs(text, P.CARD, "credit_card") if _read(text).digits >= P.CARD_LEAST else []
    return uncontained(s for s in found if luhn(re.sub("[ -]", "", text[s.start : s.end])))


def government_ids(text: str) -> list[Span]:
    read = _read(text)
    if not read.digits:
        return []
    bare = [s for p in P.GOVERNMENT_IDS for s in _in_runs(text, p, "government_id")] if read.digits >= P.ID_LEAST else []
    return uncontained([*bare, *(_hits(text, P.CONTEXTUAL_ID, "government_id", 1) if any(w in read.low for w in P.ID_WORDS) else [])])


_DIGIT_WORDS, _RUN_WORDS = ({w.encode() for w in words} for words in (P.DIGIT_WORDS, (*P.DIGIT_WORDS, *P.MULTIPLIERS)))


def _weights(words: list[str]) -> list[int]:
    """How many digits each word of a run says: a digit as often as the multiplier before it tells."""
    return [P.MULTIPLIERS.get(before, 1) if word in P.DIGIT_WORDS else 0 for before, word in pairwise(["", *words])]


def spoken(run: str) -> int:
    """Digits that a run of digit words says."""
    return sum(_weights(_LETTERS.findall(run.lower())))


@_once
def spelled_digits(text: str, kind: str = "phone") -> list[Span]:
    """Runs of seven or more spoken digits; `double` and `triple` multiply the next one."""
    least, said = -(-P.LONG_RUN // max(P.MULTIPLIERS.values())), _read(text).said
    if _DIGIT_WORDS.isdisjoint(said):
        return []
    at = [i for i, w in enumerate(said) if w in _RUN_WORDS]
    if not any(b - a == least - 1 for a, b in zip(at, at[least - 1 :])):  # so few words in a row can't say enough digits
        return []
    words = [(m[0].lower(), *m.span()) for m in _LETTERS.finditer(text)]
    out = []
    for said, run in groupby(words, lambda w: w[0] in P.DIGIT_WORDS or w[0] in P.MULTIPLIERS):
        run = list(run) if said else []
        weights = _weights([w for w, *_ in run])
        if sum(weights) >= P.LONG_RUN:
            out.append(Span(run[0][1], max(end for (*_, end), n in zip(run, weights) if n), kind))
    return out


@_once
def _greeted(text: str) -> bool:
    """Whether an introduction stands before a capital letter."""
    return any(word in text and p.search(text) is not None for word, p in P.GREETINGS)


@_once
def greeted_names(text: str) -> list[Span]:
    return [s for p in P.GREETED_NAMES for s in _hits(text, p, "name", 1)] if _greeted(text) else []


def _spaced(words: Iterable[str]) -> str:
    return f" {' '.join(words)} "


#: Letters of a needle in the automaton, which is freed by recursion and so must not be deep; and places of a longer
#: needle's head up to which they are tried one by one.
_HEAD, _TRIED = 1000, 64
#: Needles that are looked for one by one: so few passes are shorter than one through an automaton.
_FEW = 8


class Needles:
    """Many strings looked for at once: an automaton that reads a text one time, however many there are."""

    def __init__(self, needles: Iterable[str]):
        self.found = dict.fromkeys(needles)
        self.few = len(self.found) <= _FEW and "" not in self.found
        self.longer: dict[str, list[str]] = {}
        if self.few:
            return
        self.automaton = ahocorasick.Automaton()
        for n in self.found:
            if len(n) > _HEAD:
                self.longer.setdefault(n[:_HEAD], []).append(n)
            self.automaton.add_word(n[:_HEAD], n[:_HEAD])
        self.automaton.make_automaton()

    def disjoint(self, text: str, shared: int = 0) -> dict[str, list[tuple[int, int]]]:
        """The occurrences of each needle from the left, none over another of its own but for `shared` letters."""
        free: dict[str, int] = {}
        out: dict[str, list[tuple[int, int]]] = {}

        def keep(n: str, start: int) -> None:
            if start >= free.get(n, 0):
                out.setdefault(n, []).append((start, start + len(n)))
                free[n] = start + len(n) - shared

        for n in self.found if self.few else ():
            at = text.find(n)
            while at >= 0:
                keep(n, at)
                at = text.find(n, free[n])
        for head, starts in self._heads(text, keep).items():
            for n in self.longer[head]:
                if len(starts) <= _TRIED:
                    for start in starts:
                        if text.startswith(n, start):
                            keep(n, start)
                else:
                    at = text.find(n)
                    while at >= 0:
                        keep(n, at)
                        at = text.find(n, free[n])
        return out

    def _heads(self, text: str, keep: Callable[[str, int], None]) -> dict[str, list[int]]:
        """Tells `keep` every place of a whole needle; the places of longer needles' heads."""
        heads: dict[str, list[int]] = {}
        for end, head in self.automaton.iter(text) if not self.few else ():
            if head in self.found:
                keep(head, end + 1 - len(head))
            if head in self.longer:
                heads.setdefault(head, []).append(end + 1 - len(head))
        return heads

    def present(self, text: str) -> set[str]:
        """The needles that the text holds."""
        seen: set[str] = {n for n in self.found if n in text} if self.few else set()
        for head, starts in self._heads(text, lambda n, _: seen.add(n)).items():
            seen |= {n for n in self.longer[head] if (any(text.startswith(n, s) for s in starts) if len(starts) <= _TRIED else n in text)}
        return seen


class Values:
    """Known values looked for again: long ones in the squeezed text, short ones as whole words; all in one pass of either."""

    def __init__(self, values: Iterable[str]):
        self.values = list(values)
        flat = [squeezed(v) for v in self.values]
        self.long = [n if len(n) >= P.VALUE_COLLAPSED else "" for n in flat]
        self.short = [_spaced(w for w in _OTHER.split(v.lower()) if w) if P.VALUE_LEAST <= len(n) < P.VALUE_COLLAPSED else "" for v, n in zip(self.values, flat)]
        self.letters, self.words = Needles(n for n in self.long if n), Needles(n for n in self.short if n)

    def occurrences(self, read: Read, kinds: Iterable[str]) -> list[list[Span]]:
        """Spans of each value, of its kind."""
        long = self.letters.disjoint(read.letters.text) if self.letters.found else {}
        short = self.words.disjoint(read.words.text, 1) if self.words.found else {}
        return [
            [read.letters.span(*x, kind) for x in long.get(n, ())] if n else [read.words.span(*x, kind) for x in short.get(w, ())]
            for n, w, kind in zip(self.long, self.short, kinds)
        ]

    def present(self, read: Read) -> list[bool]:
        """Whether each value occurs."""
        seen = self.letters.present(read.letters.text) if self.letters.found else set()
        said = self.words.present(read.words.text) if self.words.found else set()
        return [n in seen if n else w in said for n, w in zip(self.long, self.short)]


@lru_cache(maxsize=8)
def _spaced_terms(terms: tuple[str, ...]) -> Needles:
    return Needles(_spaced(words) for t in terms if (words := [m[0].lower() for m in _ALNUM.finditer(t)]))


@lru_cache(maxsize=8)
def _bare_terms(terms: tuple[str, ...]) -> Needles:
    """What the squeezed text of each text has in which a deny term stands as whole words."""
    return Needles(bare for t in terms if (bare := "".join(_ALNUM.findall(t)).lower()))


@lru_cache(maxsize=8)
def _squeezed_terms(terms: tuple[str, ...]) -> tuple[list[str], Needles]:
    """Deny terms of three or more letters, squeezed."""
    flat = [n for t in terms if len(n := squeezed(t)) >= P.VALUE_LEAST]
    return flat, Needles(flat)


def denied(text: str, terms: Iterable[str]) -> list[Span]:
    """Deny terms as whole words of the text, whatever stands between the words."""
    terms = tuple(terms)
    needles = [_spaced(words) for t in terms if (words := [m[0].lower() for m in _ALNUM.finditer(t)])]
    if not needles or (_read(text).plain and not _bare_terms(terms).present(_read(text).letters.text)):
        return []
    if not (found := _spaced_terms(terms).disjoint(_read(text).words.text, 1)):
        return []
    words = _read(text).words
    return sorted((words.span(*x, "deny_list", "deny_list") for n in needles for x in found.get(n, ())), key=lambda s: s.start)


def denied_anywhere(text: str, terms: Iterable[str], letters: Squeezed | None = None) -> list[Span]:
    """Deny terms of three or more letters in the squeezed text."""
    flat, needles = _squeezed_terms(tuple(terms))
    if not flat:
        return []
    letters = letters or _read(text).letters
    found = needles.disjoint(letters.text)
    return [letters.span(*x, "deny_list", "deny_list") for n in flat for x in found.get(n, ())]


def suspects(texts: pa.Array, deny: Iterable[str] = ()) -> list[bool]:
    """Which texts any detector, scan or risk question could find something in, so that all others need not be read again."""
    terms = tuple(deny)
    needles = [n for n in (_bare_terms(terms), _squeezed_terms(terms)[1]) if n.found]
    known = lambda t: any(n.present(flat) for flat in [squeezed(t)] for n in needles)
    met = pc.fill_null(pc.match_substring_regex(texts, P.SUSPECT), False).to_pylist()
    return [hit or (bool(needles) and bool(t) and known(t)) for hit, t in zip(met, texts.to_pylist())]


def value_occurrences(text: str, value: str, kind: str = "other") -> list[Span]:
    """A known value again: long ones in the squeezed text, short ones as whole words."""
    return Values([value]).occurrences(Read(text), [kind])[0]


_NUMBER = re.compile(r"\d+", re.ASCII)


@_once
def _near_digits(text: str) -> bool:
    """Whether a text has both digits and words of an address."""
    read = _read(text)
    return read.digits > 0 and any(w in read.low for w in P.ADDRESS_WORDS)


@_once
def address_digits(text: str, kind: str = "number") -> list[Span]:
    """Digit runs that touch a window round an address word."""
    if not _near_digits(text):
        return []
    near = Cover((m.start() - P.ADDRESS_WINDOW, m.end() + P.ADDRESS_WINDOW) for m in P.ADDRESS_WORD.finditer(text))
    return [Span(*m.span(), kind) for m in _NUMBER.finditer(text) if near.touches(*m.span())]


# -- composites ---------------------------------------------------------------


def detect(text: str) -> list[Span]:
    """All pattern detectors together; bare numbers give way to phones, cards and ids that cover them."""
    calls, ids = phones(text), [*cards(text), *government_ids(text)]
    numbers = _outside(long_numbers(text), [*calls, *ids])
    return uncontained([*calls, *spelled_digits(text), *greeted_names(text), *emails(text), *street_addresses(text), *cross_streets(text), *ids, *numbers])


def address_like(text: str) -> bool:
    """A number before capitalised words that no street address covers."""
    return _read(text).digits > 1 and bool(_outside(_hits(text, P.ADDRESS_LIKE, "street_address"), street_addresses(text)))


class _Joined:
    """A growing union of spans: its reach, the span that names it, its kinds and least confidence.

    The higher detector names it, then the longer span (one that outgrows the union so far), then the earlier one.
    """

    def __init__(self, first: Span):
        self.start, self.end, self.name, self.kinds, self.sure = first.start, first.end, first, {first.kind}, first.confidence

    def add(self, s: Span) -> None:
        rank, best = PRIORITY[s.detector], PRIORITY[self.name.detector]
        if rank > best or (rank == best and s.end - s.start > self.end - self.start):
            self.name = s
        self.end = max(self.end, s.end)
        self.kinds.add(s.kind)
        self.sure = min((x for x in (self.sure, s.confidence) if x is not None), default=None)

    def span(self) -> Span:
        return Span(self.start, self.end, self.name.kind, self.name.detector, self.sure)


def merge(spans: Iterable[Span]) -> tuple[list[Span], bool]:
    """Disjoint spans, and whether different kinds overlapped, in one sweep.

    Overlapping spans always join: a union ends where the next start has passed every end so far. A span that begins just
    there joins too if it is of the union's kind.
    """
    out: list[_Joined] = []
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if out and (s.start < out[-1].end or (s.start == out[-1].end and s.kind == out[-1].name.kind)):
            out[-1].add(s)
        else:
            out.append(_Joined(s))
    return [j.span() for j in out], any(len(j.kinds) > 1 for j in out)


class Tokenized(NamedTuple):
    text: str
    vault: list[tuple[str, str]]  # token, first surface
    findings: list[tuple[str, str, str]]  # kind, token, normalised value


def label(kind: str, n: int) -> str:
    return f"[{kind.upper()}_{n}]"


def tokenize(text: str, spans: Iterable[Span]) -> Tokenized:
    """Disjoint spans replaced by tokens numbered per kind; surfaces equal once squeezed share a token."""
    spans = sorted(spans, key=lambda s: s.start)
    keys = [(s.kind, squeezed(text[s.start : s.end])) for s in spans]
    place = {key: i for i, key in reversed([*enumerate(keys)])}  # where each key comes first
    by_place = sorted(place, key=place.__getitem__)
    rank = {kind: {key: n for n, key in enumerate((k for k in by_place if k[0] == kind), 1)} for kind in {k for k, _ in by_place}}
    token = {key: label(key[0], rank[key[0]][key]) for key in by_place}
    gaps = [text[a:b] for a, b in zip([0, *(s.end for s in spans)], [*(s.start for s in spans), len(text)])]
    whole = "".join(x for pair in zip(gaps, [*(token[k] for k in keys), ""]) for x in pair)
    return Tokenized(whole, [(token[k], text[slice(*spans[place[k]][:2])]) for k in by_place], [(k[0], token[k], k[1]) for k in by_place])


def reappears(value: str, redacted: str) -> bool:
    """Whether a vaulted value can be read in a redacted text."""
    return any(reappearing([value], redacted))


def reappearing(values: Iterable[str], redacted: str) -> list[bool]:
    """For each vaulted value whether it can be read in a redacted text."""
    return Values(known).present(Read(P.TOKEN.sub(" ", redacted).lower())) if (known := list(values)) else []


def residual(redacted: str, vaulted: Iterable[str] = (), deny: Iterable[str] = ()) -> dict[str, int]:
    """What personal data a redacted text still seems to hold: count by category, without zeros."""
    text = P.TOKEN.sub(" ", redacted) if "[" in redacted else redacted
    read, (terms, needles), vaulted = _read(text), _squeezed_terms(tuple(deny)), list(vaulted)
    met = needles.present(read.letters.text) if terms else ()
    near = lambda m: _DIGIT.search(text, max(0, m.start() - P.ADDRESS_WINDOW), min(len(text), m.end() + P.ADDRESS_WINDOW))
    counts = {
        "vault_value_reintroduced": sum(Values(vaulted).present(Read(text.lower()))) if vaulted else 0,
        "digit_run": len(_DIGITS.findall(read.letters.text)) if read.digits >= P.LONG_RUN else 0,
        "spelled_out_digits": len(spelled_digits(text if read.plain else text.lower())),
        "email_like": len(email_like(text)),
        "address_like": sum(near(m) is not None for m in P.ADDRESS_WORD.finditer(text)) if _near_digits(text) else 0,
        "name_like_after_greeting": sum(len(p.findall(text)) for p in P.GREETED_NAMES_SCAN) if _greeted(text) else 0,
        "deny_list_term": sum(n in met for n in terms),
    }
    return {k: n for k, n in counts.items() if n}


class Masked:
    """A text with a blank for each of its disjoint spans.

    A letter behind k blanks stands as much further right in the text as these k spans are longer than their blanks.
    """

    def __init__(self, text: str, spans: Iterable[Span]):
        spans = sorted(spans, key=lambda s: s.start)
        self.shifts = [0, *accumulate(s.end - s.start - 1 for s in spans)]
        self.blanks = [s.start - shift for s, shift in zip(spans, self.shifts)]
        self.text = " ".join(text[a:b] for a, b in zip([0, *(s.end for s in spans)], [*(s.start for s in spans), len(text)]))

    def back(self, s: Span) -> Span | None:
        """A stretch of the masked text as one of the text, without blanks at its ends; None for blanks alone."""
        first, last = s.start, s.end - 1
        low, high = bisect_left(self.blanks, first), bisect_right(self.blanks, last)
        while low < high and self.blanks[low] == first:
            first, low = first + 1, low + 1
        while low < high and self.blanks[high - 1] == last:
            last, high = last - 1, high - 1
        return s._replace(start=first + self.shifts[low], end=last + self.shifts[high] + 1) if first <= last else None


class Repaired(NamedTuple):
    spans: list[Span]
    tokenized: Tokenized
    disagreement: bool
    converged: bool
    rounds: int


def _missed(text: str, spans: list[Span], done: Tokenized, deny: list[str]) -> list[Span]:
    """What the residual scan would find outside the spans, as spans of the text."""
    read = _read((masked := Masked(text, spans)).text)
    scans = (long_numbers, spelled_digits, greeted_names, email_like, address_digits)
    found = [s for scan in scans for s in scan(read.text)] + (denied_anywhere(read.text, deny, read.letters) if deny else [])
    kinds = {token: kind for kind, token, _ in done.findings}
    again = Values(value for _, value in done.vault).occurrences(read, [kinds[token] for token, _ in done.vault])
    back = map(masked.back, [*found, *(s for each in again for s in each)])
    return _outside((s for s in back if s is not None), spans)


def _widening(text: str, spans: list[Span], deny: list[str]) -> Iterator[tuple[list[Span], Tokenized, bool]]:
    """Spans, replacement and clash after each round that has added something, beginning with none."""
    done, mixed = tokenize(text, spans), False
    yield spans, done, mixed
    while new := _missed(text, spans, done, deny):
        spans, clash = merge([*spans, *new])
        done, mixed = tokenize(text, spans), mixed or clash
        yield spans, done, mixed


def _widened(text: str, spans: list[Span], deny: Iterable[str], rounds: int) -> list[tuple[list[Span], Tokenized, bool]]:
    return list(islice(_widening(text, spans, list(deny)), rounds + 1))


def repair(text: str, spans: list[Span], deny: Iterable[str] = (), rounds: int = P.REPAIR_ROUNDS) -> Repaired:
    """Add spans until nothing that the residual scan looks for is left outside them."""
    states = _widened(text, spans, deny, rounds)
    spans, done, mixed = states[-1]
    settled = len(states) <= rounds
    return Repaired(spans, done, mixed, settled and not any(reappearing([v for _, v in done.vault], done.text)), min(len(states), rounds))


class Redaction(NamedTuple):
    spans: list[Span]
    tokenized: Tokenized
    disagreement: bool
    residual: dict[str, int]


def redact(text: str, deny: Iterable[str] = (), more: Iterable[Span] = ()) -> Redaction:
    """Detect, merge, repair, tokenize and audit. more: spans of other detectors."""
    deny = list(deny)
    spans, mixed = merge([*detect(text), *denied(text, deny), *more])
    spans, done, clash = _widened(text, spans, deny, P.REPAIR_ROUNDS)[-1]
    left = residual(done.text, [v for _, v in done.vault], deny)
    return Redaction(spans, done, mixed or clash, left)


def untouched(text: str) -> Redaction:
    """The redaction of a text that is no suspect."""
    return Redaction([], Tokenized(text, [], []), False, {})


def signals(text: str, spans: list[Span], disagreement: bool, residual_hit: bool = False) -> list[str]:
    """Risk reasons that a redaction raises, in a fixed order."""
    raised = {
        "short_transcript": len(text) < P.SHORT_TEXT,
        "detector_disagreement": disagreement,
        "deny_list_hit": any(s.kind == "deny_list" for s in spans),
        "high_entity_density": len(spans) >= P.DENSITY_SPANS and len(spans) / max(1, len(text)) * 1000 > P.DENSITY_PER_1000,
        "address_like_ambiguous": address_like(text),
        "residual_scan_hit": residual_hit,
    }
    return [r for r, on in raised.items() if on]


# -- model tokens to spans ----------------------------------------------------

#: Labels of the token model.
NER_KINDS = {"PER": "name", "LOC": "location", "ORG": "organization", "MISC": "other"}
NER_WINDOW = 510
#: Chunks that a model of many texts gets at once.
MODEL_TEXTS = 1 << 10
_WORD = re.compile(r"[A-Za-z0-9'’-]*")
_HOUSE = re.compile(r"(?<!\d)\d{1,6}[ \t]+\Z", re.ASCII)
_WORD_START = re.compile(r"(?<![A-Za-z'])[a-z]")


def title_case(text: str) -> str:
    """Every word's first letter in upper case, nothing else changed."""
    return _WORD_START.sub(lambda m: m[0].upper(), text)


def house_number(text: str, start: int) -> int | None:
    """Where a house number right before `start` begins."""
    low = max(0, start - 12)
    m = _HOUSE.search(text[low:start])
    return low + m.start() if m else None


def chunks(length: int, size: int, overlap: int) -> list[int]:
    """Starts of overlapping chunks that cover a text."""
    step, out = max(1, size - overlap), [0]
    while out[-1] + size < length:
        out.append(out[-1] + step)
    return out


def _places(text: str, pieces: Iterable[str]) -> Iterator[tuple[int, int] | None]:
    """Where each piece stands, each behind the last one found; None for a piece that isn't there."""
    end = 0
    for piece in pieces:
        start = text.find(piece, end) if piece else -1
        end = end if start < 0 else start + len(piece)
        yield None if start < 0 else (start, end)


def align(text: str, tokens: Iterable[tuple[str, float, str]], offset: int = 0) -> tuple[list[Span], bool, bool]:
    """Spans of a token model's (entity, score, word piece) list; whether an entity got lost; whether it was cut off.

    Pieces are placed one after another; neighbours of one kind form a span, which grows to whole words.
    """
    tokens = list(tokens)
    if all(entity == "O" for entity, *_ in tokens):
        return [], False, len(tokens) >= NER_WINDOW
    places = list(_places(text.lower(), ("" if word in ("[UNK]", "##[UNK]") else word.removeprefix("##").lower() for *_, word in tokens)))
    kinds = [None if entity == "O" or place is None else NER_KINDS.get(entity.partition("-")[2], "other") for (entity, *_), place in zip(tokens, places)]
    near = lambda i: tokens[i][2].startswith("##") or places[i][0] - places[i - 1][1] <= 1
    goes_on = lambda i: i > 0 and kinds[i] is not None and kinds[i] == kinds[i - 1] and near(i)
    runs = accumulate(not goes_on(i) for i in range(len(tokens)))
    spans, back = [], text[::-1]
    for _, run in groupby(zip(runs, kinds, places, tokens), lambda x: x[0]):
        _, (kind, *_), at, scored = zip(*run)
        if kind is not None:
            start, end = len(text) - _WORD.match(back, len(text) - at[0][0]).end(), _WORD.match(text, at[-1][1]).end()
            spans.append(Span(start + offset, end + offset, kind, "ner", sum(x for _, x, _ in scored) / len(scored)))
    lost = any(entity != "O" and place is None for (entity, *_), place in zip(tokens, places))
    return spans, lost, len(tokens) >= NER_WINDOW


def ner(text: str, model, scope: Iterable[str] = ("person", "numbered_location"), least: float = 0.8, size: int = 1000, overlap: int = 100) -> tuple[list[Span], list[str]]:
    """Spans and risk reasons of a token model, called as model(text) -> [(entity, score, piece), ...].

    Each chunk is read as it is and in title case, of which only names count. Equal spans keep the highest score.
    """
    return _scoped(text, ((*part, model(part[2])) for part in _parts(text, size, overlap)), set(scope), least)


def ner_of_many(texts: Iterable[str], models, scope: Iterable[str] = ("person", "numbered_location"), least: float = 0.8, size: int = 1000, overlap: int = 100, together: int = 1 << 18) -> Iterator[list[Span]]:
    """The spans of `ner` for each text, by a model of many texts at once: models([text, ...]) -> [[(entity, score, piece), ...], ...]."""
    texts, scope = iter(texts), set(scope)
    while first := [*islice(texts, 1)]:
        group, letters = first, len(first[0])
        while letters < together and (more := [*islice(texts, 1)]):
            group, letters = group + more, letters + len(more[0])
        parts = [[*_parts(text, size, overlap)] for text in group]
        flat = [part[2] for each in parts for part in each]
        read = (tokens for at in range(0, len(flat), MODEL_TEXTS) for tokens in models(flat[at : at + MODEL_TEXTS]))
        for text, each in zip(group, parts):
            yield _scoped(text, [(*part, tokens) for part, tokens in zip(each, read)], scope, least)[0]


def _parts(text: str, size: int, overlap: int) -> Iterator[tuple[int, bool, str]]:
    """Each chunk as it is and in title case: its start, whether only names count, and its text."""
    for start in chunks(len(text), size, overlap):
        part = text[start : start + size]
        yield start, False, part
        yield start, True, title_case(part)


def _scoped(text: str, parts: Iterable[tuple[int, bool, str, list]], scope: set[str], least: float) -> tuple[list[Span], list[str]]:
    best, reasons = {}, set()
    for start, names_only, variant, tokens in parts:
        found, failed, cut = align(variant, tokens, start)
        reasons |= {r for r, on in (("ner_offset_alignment_failed", failed), ("transcript_chunking_truncated", cut)) if on}
        for s in found:
            key = (s.start, s.end, s.kind)
            if (not names_only or s.kind == "name") and (key not in best or s.confidence > best[key].confidence):
                best[key] = s
    scoped = []
    for s in best.values():
        own = {"name": "person", "location": "location", "organization": "organization"}.get(s.kind, "misc")
        wide = house_number(text, s.start) if s.kind == "location" and own not in scope and "numbered_location" in scope else None
        if own in scope:
            scoped.append(s)
        elif wide is not None:
            scoped.append(s._replace(start=wide))
    kept = [s for s in scoped if s.confidence >= least]
    if len(kept) < len(scoped):
        reasons.add("ner_low_confidence")
    return sorted(kept, key=lambda s: (s.start, s.end)), sorted(reasons)


# -- phrases ------------------------------------------------------------------

_MARKS = "'‘’"
_QUOTES = str.maketrans("", "", _MARKS)


def verbatim(text: str) -> str:
    """Lower case, quote marks left out, one blank for all else that is no ASCII letter or digit, none at the ends."""
    for mark in _MARKS:
        text = text.replace(mark, "")
    if not text.isascii():
        text = text.replace("\u0130", "i ").replace("\u212a", "k")  # in lower case an i with a mark of its own, and a k
    return b" ".join(_bytes(text).translate(_TO_ALNUM).split()).decode("ascii")


def spoken_words(text: str) -> list[str]:
    """The words of `verbatim`; behind them, where they differ, those that `snap` sees."""
    return verbatim(text).split() + (_said(text) if any(x in text for x in _ODD) else [])


_SPOKEN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9'‘’]*[A-Za-z0-9])?[‘’']*")


@lru_cache(maxsize=2)
def _said(text: str) -> list[str]:
    """The words of a text that _SPOKEN finds: the two other letters with an ASCII lower case part words there."""
    return verbatim(text.replace("\u0130", " ").replace("\u212a", " ")).split()


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of words, a bit of one number for each word of a."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for w in b:
        met = row & masks.get(w, 0)
        row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


#: Windows whose common subsequences are found together.
_TOGETHER = 1 << 15


def lcs_windows(a: np.ndarray, b: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """lcs(a, b[start : start + size]) for each start, all windows in step: the bits of a fill columns of 64-bit words.

    a: word numbers; b: word numbers, of which those that a lacks are negative.
    """
    n_words = -(-len(a) // 64)
    masks = np.zeros((int(max(a.max(initial=-1), b.max(initial=-1))) + 2, n_words), np.uint64)  # the last row, of -1, stays empty
    for i, w in enumerate(a.tolist()):
        masks[w, i // 64] |= np.uint64(1 << i % 64)
    out = np.empty(len(starts), np.int64)
    for at in range(0, len(starts), _TOGETHER):
        part = starts[at : at + _TOGETHER]
        rows = [np.full(len(part), np.uint64((1 << min(64, len(a) - 64 * k)) - 1)) for k in range(n_words)]
        full = [r[0] if len(r) else np.uint64(0) for r in rows]
        for step in range(size):
            words, carry = b[part + step], None
            for k, row in enumerate(rows):
                mask = masks[words, k]
                met = row & mask
                total = row + met
                over = total < row
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
                rows[k] = (total | (row & ~mask)) & full[k]
        out[at : at + len(part)] = len(a) - sum(np.bitwise_count(r).astype(np.int64) for r in rows)
    return out


def snap(phrase: str, text: str, least: float = 0.0) -> tuple[str, float] | None:
    """The stretch of the text nearest to a phrase: windows of its length and one word less or more, first best wins.

    Windows that cannot reach the least likeness, by the words they share in any order, are passed over.
    """
    wanted = verbatim(phrase).split()
    if not wanted:
        return None
    numbers = {w: i for i, w in enumerate(dict.fromkeys(wanted))}
    if least:
        need = math.ceil(least * len(wanted) - 1e-9)
        at = [j for j, w in enumerate(_said(text)) if w in numbers]
        if not any(b - a <= len(wanted) for a, b in zip(at, at[need - 1 :])):  # no window has enough of the words
            return None
    words = [(m.start(), m.end(), m[0].lower().translate(_QUOTES)) for m in _SPOKEN.finditer(text)]
    a = np.array([numbers[w] for w in wanted])
    b = np.fromiter((numbers.get(w, -1) for *_, w in words), np.int64, len(words))
    best: tuple[float, int, int] | None = None
    for n in (len(wanted) - 1, len(wanted), len(wanted) + 1):
        if n < 1 or len(b) < n:
            continue
        shared = _shared(a, b, n) / max(len(wanted), n)
        starts = np.flatnonzero(shared >= max(least, 0.0 if best is None else best[0]))
        if best is not None:
            starts = starts[shared[starts] > best[0]]
        if not len(starts):
            continue
        likeness = lcs_windows(a, b, starts, n) / max(len(wanted), n)
        top = int(likeness.argmax())
        if best is None or likeness[top] > best[0]:
            best = (float(likeness[top]), int(starts[top]), n)
    return None if best is None else (text[words[best[1]][0] : words[best[1] + best[2] - 1][1]], best[0])


def _shared(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each window of n words of b how many of them a can match in any order, each word of a once."""
    out = np.zeros(len(b) - n + 1, np.int64)
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], np.arange(int(a.max()) + 2))
    for w, most in enumerate(np.bincount(a).tolist()):
        places = order[at[w] : at[w + 1]]
        if not len(places):
            continue
        # a word counts as long as fewer than `most` of its kind stand before it in the window
        earlier = np.full(len(places), -1)
        earlier[most:] = places[:-most] if len(places) > most else places[:0]
        first, last = np.maximum(earlier + 1, places - n + 1), np.minimum(places, len(b) - n)
        good = first <= last
        change = np.bincount(np.maximum(first[good], 0), minlength=len(out) + 1) - np.bincount(last[good] + 1, minlength=len(out) + 1)
        out += np.cumsum(change)[: len(out)]
    return out


def verbatim_gate(phrases: Iterable[str], text: str) -> tuple[list[str], int, int, int]:
    """Phrases that the text has, or their nearest stretch; counts of exact, snapped and dropped ones."""
    flat, kept, counts = verbatim(text), [], [0, 0, 0]
    for phrase in phrases:
        wanted = verbatim(phrase)
        if not wanted or wanted in flat:
            kept.append(phrase)
            counts[0] += 1
        elif (near := snap(phrase, text, P.SNAP_LEAST)) is not None and near[1] >= P.SNAP_LEAST:
            kept.append(near[0])
            counts[1] += 1
        else:
            counts[2] += 1
    return kept, *counts


def contexts(text: str, value: str, radius: int = 48, most: int = 5) -> list[str]:
    """Stretches round the first occurrences of a value."""
    found = value_occurrences(text, value)[:most]
    return [text[max(0, s.start - radius) : s.end + radius] for s in found]
