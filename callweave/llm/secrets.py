"""Secret scans through a trigram inverted index.

1. `trigram_query` derives from each rule's regex a Boolean query: clauses (OR) of trigrams (AND) that any match must
   contain in lower case. Rules without mandatory trigrams have none and scan every text.
2. `postings` lists, for the trigrams that the queries name, the documents that contain them.
3. `candidates` intersects the postings of each clause: per document a bit mask of the rules worth trying.
4. `scan` verifies: a rule's regex runs only where its bit is set (or where it has no query).

All of it is built-in expressions. Candidates are few beside the documents: up to BROADCAST of them (ids and a mask) are
sent to every task, so texts stay where they are; beyond that the join is a hash join on the small side that shuffles
texts once and sorts none. doc_id is near unique, and postings are combined before the shuffle, so no key is hot; rows
without id take part in no join and try every rule.

Defined cases: null text counts as empty; rows with the same doc_id share candidates, and rows with a null one are
candidates of every rule, which only means that a rule may be tried in vain; spans are code points with the end
exclusive; columns of docs named `spans` or `rule_bits` give way to the results, any other name may occur; very long
texts are scanned whole; an empty table gives no rows.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_blocks, let, running, stored, stretch, unused, without


@dataclass(frozen=True)
class Rule:
    """A kind of secret: regex, the group whose length counts, and its least length in code points."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.regex


#: Fixed by the result contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # as a run of 32 or more: shorter runs are dropped anyway
)
#: Further kinds; their spans are added to the base ones. No group is repeated: Java's matcher recurses once a turn.
ADDED = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,200}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),  # a bounded head: a run without a dot is not read again from each of its places
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + ADDED

#: Candidates that are sent to all tasks, at most: some 16 MB.
BROADCAST = 1 << 20

Clauses = frozenset[frozenset[str]]  # OR of ANDs; one empty clause: always true
ALWAYS: Clauses = frozenset({frozenset()})
#: Longest set of exact strings that the derivation carries on.
EXACT = 24


def _and(a: Clauses, b: Clauses) -> Clauses:
    return _least({x | y for x in a for y in b})


def _least(clauses: set[frozenset[str]]) -> Clauses:
    """Without clauses that another one implies."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _of(strings: set[str]) -> Clauses:
    return _least({_grams(s) for s in strings})


def _walk(items) -> Clauses:
    """The query of a sequence. `exact` is the set of strings that the part since the last break can match."""
    query, exact = ALWAYS, {""}

    def flush() -> None:
        nonlocal query, exact
        query, exact = _and(query, _of(exact)), {""}

    def literal(options: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(options) > EXACT:
            flush()
        exact = {a + b for a in exact for b in options}

    for op, arg in items:
        strings = _strings(op, arg)
        if strings is not None and len(strings) <= EXACT:
            literal(strings)
            continue
        flush()
        if op is sre.BRANCH:
            query = _and(query, _least({c for part in arg[1] for c in _walk(part)}))
        elif op is sre.SUBPATTERN:
            query = _and(query, _walk(arg[3]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
            query = _and(query, _walk(arg[2]))
    flush()
    return query


def _strings(op, arg) -> set[str] | None:
    """The lower-case strings that an element matches, where they are few; None otherwise."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(k is sre.LITERAL for k, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        inner = _sequence(arg[2])
        if inner is None:
            return None
        found: set[str] = set()
        for n in range(arg[0], arg[1] + 1):
            runs = {""}
            for _ in range(n):
                runs = {a + b for a in runs for b in inner}
            found |= runs
        return found
    return None


def _sequence(items) -> set[str] | None:
    found = {""}
    for op, arg in items:
        strings = _strings(op, arg)
        if strings is None or len(found) * len(strings) > EXACT:
            return None
        found = {a + b for a in found for b in strings}
    return found


def trigram_query(pattern: str) -> Clauses:
    """Clauses of lower-case trigrams: every match's lower-case text contains all trigrams of one clause."""
    return _walk(sre_parser.parse(pattern))


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, trigram): the inverted index over the trigrams that are asked for."""
    folded = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    present = let(folded, lambda t: F.filter(F.array(*(F.when(t.contains(g), F.lit(g)) for g in trigrams)), lambda g: g.isNotNull()))
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(present).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, rule_bits): bit i is set where some clause of rule i has all its trigrams posted for the document."""
    clauses = [(i, c) for i, r in enumerate(rules) for c in sorted(map(sorted, trigram_query(r.regex)))]
    if not any(c for _, c in clauses):
        return docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("rule_bits")).limit(0)
    trigrams = sorted({g for _, c in clauses for g in c})
    index = postings(docs, trigrams, id_col, text_col)
    # which clauses a trigram belongs to: (clause, its bit there); as many rows as the rules spell out
    members = [(g, k, 1 << c.index(g)) for k, (_, c) in enumerate(clauses) for g in c]
    found = F.create_map(*(x for g in trigrams for x in (F.lit(g), F.array(*(F.struct(F.lit(k).alias("clause"), F.lit(b).cast("long").alias("bit")) for h, k, b in members if h == g)))))
    hits = index.select("id", F.inline(found[F.col("trigram")])).groupBy("id", "clause").agg(F.bit_or("bit").alias("seen"))
    whole = F.create_map(*(x for k, (_, c) in enumerate(clauses) for x in (F.lit(k), F.lit((1 << len(c)) - 1).cast("long"))))
    rule_of = F.create_map(*(x for k, (i, _) in enumerate(clauses) for x in (F.lit(k), F.lit(1 << i).cast("long"))))
    return hits.filter(F.col("seen") == whole[F.col("clause")]).groupBy("id").agg(F.bit_or(rule_of[F.col("clause")]).alias("rule_bits"))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start,rank,end>> of a rule's leftmost non-overlapping matches that are long enough.

    The pieces between matches (split) and the matches themselves alternate, so positions are running lengths.
    """
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def place(matches: Column) -> Column:
        gaps = F.slice(F.split(text, rule.java, -1), 1, F.size(matches))
        sized = matches if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group))
        ends = running(F.zip_with(gaps, matches, lambda gap, hit: F.char_length(gap) + F.char_length(hit)))
        steps = F.arrays_zip(ends.alias("end"), F.transform(matches, F.char_length).alias("n"), F.transform(sized, F.char_length).alias("sized"))
        spans = F.transform(F.filter(steps, lambda x: x["sized"] >= rule.least), lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))
        return F.when(F.size(matches) == 0, none).otherwise(spans)

    return let(F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)), place)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """docs with `spans` added: array<struct<start,rank,end>> of all rules, by start, then rule."""
    docs = docs.select(*without(docs, ["spans", "rule_bits"]))
    found = stored(candidates(docs, rules, id_col, text_col), "secret-candidates")
    other, mask = unused(docs, "candidate"), unused(docs, "rule_mask")
    bits = found.select(F.col("id").alias(other), F.col("rule_bits").alias(mask)).hint("broadcast" if found.count() <= broadcast else "shuffle_hash")
    rows = docs.join(bits, F.col(id_col) == F.col(other), "left").drop(other)
    tried = F.when(F.col(id_col).isNull(), F.lit(-1).cast("long")).otherwise(F.coalesce(F.col(mask), F.lit(0).cast("long")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    parts = []
    for i, rule in enumerate(rules):
        spans = spans_of(text, rule, i)
        always = trigram_query(rule.regex) == ALWAYS
        parts.append(spans if always else F.when(tried.bitwiseAND(F.lit(1 << i)) != 0, spans).otherwise(none))
    return rows.withColumn("spans", F.sort_array(F.flatten(F.array(*parts)))).drop(mask)


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans, from scan()."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["rank"] == i)).cast("long").alias(f"n_{BASE[i].kind}")
    return found.select(id_col, *(count(i) for i in range(len(BASE))), F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def redact(found: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """The texts of scan() with every span replaced; overlapping and touching spans become one mask."""
    def masked(blocks: Column, reach: Column, last: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(reach, i - 1), F.lit(0))  # how far the spans before this one go
            return F.when(s["start"] > before, F.concat(stretch(blocks, before, s["start"]), F.lit(mask))).when((s["start"] == 0) & (before == 0), F.lit(mask)).otherwise("")

        return F.concat(F.array_join(F.transform("spans", piece), ""), stretch(blocks, F.element_at(reach, -1), last))

    text = F.coalesce(F.col(text_col), F.lit(""))
    reach = running(F.transform("spans", lambda s: s["end"]), greatest=True)
    clean = let(in_blocks(text), lambda blocks: let(reach, lambda r: masked(blocks, r, F.char_length(text))))
    return found.withColumn(text_col, F.when(F.size("spans") == 0, F.col(text_col)).otherwise(clean))
