"""Quality rules as a bitmask ledger.

`measure` computes every measurement once per document, `ledger` turns them into one long of failure bits
(bit i: rule i failed), and policies are named sets of rules applied to the stored bits: a new policy, or an
ablation of an old one, never touches a text again.

Everything is built-in expressions over one row; the only shuffle is the small aggregate of `ablation`.

Defined cases: null or empty text has no words, so all counts are 0 and rule `few_words` fails. Rows with a
null doc_id or repeated rows are measured like any other; very long texts are measured whole (their length alone fails
only rule `many_words`, which no policy of `keeps` has). Columns that clash with an output name, in letters of either
case, are replaced; any other name may occur. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, let, unused, without

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters")

#: Rule name -> failure predicate in integer arithmetic. A rule's place is its bit; append only, so that stored
#: ledgers stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_words": "n_words > 100000",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "duplicate_lines": "n_dup_lines >= 5 AND 100 * n_dup_lines > 30 * n_lines",
    "few_letters": "100 * n_letters < 60 * word_chars",
}

#: Versioned policies: the rules each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_words"),
    "v1": tuple(RULES),
    "v1_lenient": ("few_words", "repeated_words", "many_words", "duplicate_lines"),
    # for corpora that keep all that is not plainly junk: length alone is no reason
    "keeps": ("few_words", "repeated_words", "short_words", "long_words", "symbols", "duplicate_lines", "few_letters"),
}


def mask_of(policy: str | tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window whose content occurs at least twice in the text.

    Windows are compared by a 64-bit hash of the three words within one document: sort (hash, place), keep the
    places with an equal neighbour, and add up how far the kept windows reach.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")),
    )

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, b: a + b)

    def repeated(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        marked = F.transform(ordered, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
        return let(F.sort_array(F.filter(marked, lambda i: i.isNotNull())), covered)

    return F.when(F.size(words) >= 3, let(F.sort_array(windows), repeated)).otherwise(0)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the MEASURES added (all long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stripped = F.regexp_replace(text, f"[{WORD_BREAKS}]+", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{WORD_BREAKS}]"))
    words = F.filter(F.split(text, f"[{WORD_BREAKS}]+", -1), lambda x: x != "")
    by_word = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    kept, made = without(docs, MEASURES), unused(docs, "measured")
    found = docs.select(
        *kept,
        F.struct(
            by_word.alias("w"),
            by_line.alias("l"),
            F.char_length(stripped).alias("c"),
            (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).alias("s"),
            F.char_length(F.regexp_replace(stripped, r"[^\p{L}]+", "")).alias("a"),
        ).alias(made),
    )
    x = F.col(made)
    values = {
        "n_words": x["w"]["n"], "word_chars": x["c"], "n_symbols": x["s"], "n_dup_lines": x["l"]["n"] - x["l"]["d"],
        "n_repeat_words": x["w"]["r"], "n_lines": x["l"]["n"], "n_letters": x["a"],
    }
    return found.select(*kept, *(values[m].cast("long").alias(m) for m in MEASURES))


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """measure() plus fail_bits: bit i is set when rule i of RULES fails. Every rule is evaluated once."""
    bits = sum((F.expr(f"CASE WHEN {p} THEN {1 << i}L ELSE 0L END") for i, p in enumerate(RULES.values())), F.lit(0).cast("long"))
    return measure(docs, text_col).withColumn("fail_bits", bits)


def passes(policy: str | tuple[str, ...]) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(policy))) == 0


def ablation(book: DataFrame, policy: str = "v1") -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that fail only it (kept if it were dropped), rows in all.

    One pass: rows are counted per distinct bit pattern (at most 2^rules groups, combined before the shuffle),
    and each rule's figures are bit tests over those few counts.
    """
    names, mask = list(RULES), mask_of(policy)
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [(r, 1 << names.index(r)) for r in POLICIES[policy]]
    hit = lambda bit: F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit)) != 0, F.col("n")).otherwise(0))
    alone = lambda bit: F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0))
    figures = patterns.agg(
        F.array(*(F.struct(F.lit(r).alias("rule"), F.coalesce(hit(b), F.lit(0)).alias("n_failed"), F.coalesce(alone(b), F.lit(0)).alias("n_only"),
                           F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")) for r, b in rules)).alias("x")
    )
    return figures.select(F.inline("x"))


def judged(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """ledger() plus base_failed and kept under the policy (which always enforces the base rules)."""
    return ledger(docs, text_col).withColumn("base_failed", ~passes("base")).withColumn("kept", passes("base") & passes(policy))
