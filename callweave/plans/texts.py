"""Text operators over whole texts. Lookaround patterns have no SQL here; tests hold them against examples."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import patterns as P
from ..functions import vocab as V
from ..operators import redaction as X
from ..operators import tagger as G
from ..spread import spread
from .registry import query
from .standins import Tables

c = F.col
#: Client terms of the queries: words that occur in the documents.
DENY = ["general public license", "thonou"]


def _found(name: str):
    return lambda t: t.clean_transcripts.select("call_id", X.detect(c("text"), name).alias("spans")).select("call_id", F.inline("spans"))


for key, name in (("pii_01", "phone"), ("pii_02", "email"), ("pii_04", "cross_street"), ("pii_05", "credit_card"), ("pii_06", "government_id"), ("pii_16", "composite")):
    query(key)(_found(name))

#: Shapes that the documents lack, said by customers: id -> (detector, text, first offset, end, kind, where there is one).
_NO = "CAST(c_custkey % 900 + 1 AS STRING)"
_WORD = "CASE c_custkey % 3 WHEN 0 THEN 'nine' WHEN 1 THEN 'double four' ELSE 'blue' END"
SAID = {
    "pii_03": ("street_address", f"concat('We live at ', {_NO}, ' Old Oak Street, thanks')", 11, f"11 + length({_NO}) + 15", "street_address", "true"),
    "pii_08": ("spelled_digits", f"concat('dial five five five oh one two ', {_WORD})", 5, f"31 + length({_WORD})", "phone", "c_custkey % 3 <> 2"),
    "pii_09": ("greeted_name", f"concat('Hello, my name is Ada Byron, number ', {_NO})", 18, "27", "name", "true"),
    "pii_13": ("address_digits", f"concat('the address has ', {_NO}, ' in it')", 16, f"16 + length({_NO})", "number", "true"),
}
for key, same in (("pii_03", ()), ("pii_08", ("op_28",)), ("pii_09", ("op_29",)), ("pii_13", ())):
    name, text, start, end, kind, where = SAID[key]
    for one in (key, *same):
        query(f"{one}_said", f"SELECT c_custkey AS call_id, {start} AS start, {end} AS end, '{kind}' AS kind, 'regex' AS detector, CAST(NULL AS DOUBLE) AS confidence FROM customer WHERE {where}".replace(" AS end,", ' AS "end",'))(
            lambda t, name=name, text=text: t.customer.select(c("c_custkey").alias("call_id"), F.expr(text).alias("text")).select("call_id", X.detect(c("text"), name).alias("spans")).select("call_id", F.inline("spans"))
        )


def _said_too(t):
    """Every document, and every customer's sentences behind them: whole texts in which each shape occurs."""
    said = F.concat_ws(". ", *(F.expr(text) for _, text, *_ in SAID.values()))
    return t.clean_transcripts.select("call_id", "text").unionByName(t.customer.select((-1 - c("c_custkey")).alias("call_id"), said.alias("text")))


def _surfaces(name: str):
    """The stretches that a detector finds, in order, with a bar between them."""
    cut = lambda s: F.substring(c("text"), s["start"] + 1, s["end"] - s["start"])
    return lambda t: _said_too(t).select("call_id", "text", X.detect(c("text"), name).alias("spans")).select("call_id", F.array_join(F.transform("spans", cut), "|").alias("found"))


_SAID_SQL = "(SELECT doc_id AS call_id, text FROM documents UNION ALL SELECT -1 - c_custkey, concat_ws('. ', " + ", ".join(text for _, text, *_ in SAID.values()) + ") FROM customer)"
#: A pattern of ours for the SQL, which knows no blanks outside ASCII by \\s.
_re2 = lambda p: re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", p.pattern).replace("'", "''")
query("pii_03", f"SELECT call_id, coalesce(array_to_string(regexp_extract_all(text, '(?i){_re2(P.STREET_ADDRESS)}'), '|'), '') AS found FROM {_SAID_SQL} AS x")(_surfaces("street_address"))
_NAMES = " || ".join(f"regexp_extract_all(text, '{_re2(p)}', 1)" for p in P.GREETED_NAMES)
for key in ("pii_09", "op_29"):
    query(key, f"SELECT call_id, coalesce(array_to_string({_NAMES}, '|'), '') AS found FROM {_SAID_SQL} AS x")(_surfaces("greeted_name"))
_ONE_WORD = "regexp_extract_all(lower(text), '[a-z]+')"
for key in ("pii_08", "op_28"):
    # runs of digit words by numbering the breaks, and each digit with the multiplier before it
    query(
        key,
        f""", w AS (SELECT call_id, list_filter({_ONE_WORD}, lambda x: x <> '') AS ws FROM {_SAID_SQL} AS x),
e AS (SELECT call_id, i, ws[i] AS word, CASE WHEN i > 1 THEN ws[i - 1] END AS before FROM (SELECT call_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
k AS (SELECT call_id, i, word IN {(*P.DIGIT_WORDS,)} AS digit, word IN {(*P.MULTIPLIERS,)} AS times, CASE before WHEN 'double' THEN 2 WHEN 'triple' THEN 3 ELSE 1 END AS n FROM e),
r AS (SELECT *, sum(CASE WHEN digit OR times THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY i) AS run FROM k),
g AS (SELECT call_id, run, sum(CASE WHEN digit THEN n ELSE 0 END) AS n FROM r GROUP BY call_id, run)
SELECT w.call_id, count(g.n)::INT AS runs, coalesce(sum(g.n), 0)::INT AS digits FROM w LEFT JOIN g ON g.call_id = w.call_id AND g.n >= {P.LONG_RUN} GROUP BY w.call_id""",
    )(
        lambda t: _said_too(t).select("call_id", X.spelled_runs(c("text")).alias("r")).select("call_id", F.size("r").alias("runs"), F.aggregate("r", F.lit(0), lambda a, x: a + x).alias("digits"))
    )
query("pii_13")(lambda t: _said_too(t).select("call_id", X.detect(c("text"), "address_digits").alias("spans")).select("call_id", F.inline("spans")))
_DIGITS = "SELECT doc_id AS call_id, len(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '[0-9]{7,}'))::INT AS n FROM documents"
for key in ("pii_07", "op_27"):
    query(key, _DIGITS)(lambda t: t.clean_transcripts.select("call_id", F.size(X.detect(c("text"), "number")).alias("n")))
_LIKE = " + ".join(f"len(regexp_extract_all(text, '(?i){_re2(p)}'))" for p in P.EMAIL_LIKE)
query("pii_10", f"SELECT call_id, coalesce(({_LIKE}), 0)::INT AS n FROM (SELECT call_id, text FROM {_SAID_SQL} AS y UNION ALL SELECT 1000000000 + c_custkey, concat('write to ', lower(c_mktsegment), ' at post', CAST(c_custkey AS STRING), ' dot com or a', CAST(c_custkey AS STRING), '@b.org') FROM customer) AS x")(
    lambda t: _said_too(t).unionByName(t.customer.select((c("c_custkey") + 1000000000).alias("call_id"), F.expr("concat('write to ', lower(c_mktsegment), ' at post', CAST(c_custkey AS STRING), ' dot com or a', CAST(c_custkey AS STRING), '@b.org')").alias("text")))
    .select("call_id", F.size(X.detect(c("text"), "email_like")).alias("n"))
)
_TERM = "regexp_replace(lower(text), '[^a-z0-9]', '', 'g')"
_TERMS = f"((length({_TERM}) - length(replace({_TERM}, 'generalpubliclicense', ''))) // 20 + (length({_TERM}) - length(replace({_TERM}, 'thonou', ''))) // 6)"
query("pii_11", f"SELECT doc_id AS call_id, {_TERMS}::INT AS n FROM documents")(
    lambda t: t.clean_transcripts.select("call_id", F.size(X.deny_list(c("text"), DENY, anywhere=True)).alias("n"))
)
query("pii_12", f"SELECT doc_id AS call_id, ((length({_TERM}) - length(replace({_TERM}, 'generalpublic', ''))) // 13)::INT AS n FROM documents WHERE text IS NOT NULL")(
    lambda t: t.clean_transcripts.filter("text IS NOT NULL").select("call_id", F.size(X.span_udf(lambda text: X.S.value_occurrences(text, "General Public"))(c("text"))).alias("n"))
)
query("pii_14", r"SELECT doc_id AS call_id, (len(regexp_extract_all(' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' general public license ')))::INT AS n FROM documents")(
    lambda t: t.clean_transcripts.select("call_id", F.size(X.deny_list(c("text"), DENY[:1])).alias("n"))
)
query("pii_15")(lambda t: t.clean_transcripts.select("call_id", X.span_udf(lambda text: X.S.uncontained([*X.S.long_numbers(text), *X.S.phones(text), *X.S.cards(text)]))(c("text")).alias("s")).select("call_id", F.inline("s")))


def stub_model(text: str) -> list[tuple[str, float, str]]:
    """A token model for plumbing: capitalised words after the first are persons with a fixed score."""
    return [("B-PER" if i and w[:1].isupper() else "O", 0.9, w) for i, w in enumerate(text.split())]


#: Names and introductions of the labelled sentences; a document's speaker has one of the later names, a customer one of the first eight.
GIVEN_NAMES = ["Ada", "Boris", "Clara", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Katya", "Lars", "Mina", "Nils", "Olga", "Pavel"]
INTRODUCED = [(". My name is ", ". "), (". This is ", " speaking. "), (". I am ", " and I call about it. "), (". You speak with ", ", hello. "), (". Please ask for ", " there. ")]


#: Letters of a document, from a place that its id tells, that are an example of a text without names.
PLAIN = 400


def _named(rows, first: int, n: int):
    """rows (id, before, after) with `name`, of given names first to first + n and nations, and an introduction round it: id, text, start, end."""
    pick = lambda xs, x: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(x, F.lit(len(xs))) + 1).cast("int"))
    mixed = F.xxhash64("id")
    name = F.concat(pick(GIVEN_NAMES[first : first + n], mixed), F.lit(" "), F.initcap(F.regexp_replace("n_name", "[^A-Za-z]+", "")))
    head, tail = (pick([x[k] for x in INTRODUCED], F.shiftright(mixed, 8)) for k in (0, 1))
    start = F.char_length("before") + F.char_length(head)
    return rows.select("id", F.concat("before", head, name, tail, "after").alias("text"), start.alias("start"), (start + F.char_length(name)).alias("end"))


def _introduced(t):
    """Every document in which its speaker says a name half way: call_id, text, start, end."""
    nations = t.nation.select("n_nationkey", "n_name")  # 25 rows
    text, n = F.coalesce("text", F.lit("")), t.nation.count()
    half = F.floor(F.char_length(text) / 2).cast("int")
    rows = t.clean_transcripts.filter("call_id IS NOT NULL").select(c("call_id").alias("id"), F.substring(text, F.lit(1), half).alias("before"), F.substring(text, half + 1, F.char_length(text)).alias("after"), F.pmod(F.xxhash64("call_id", F.lit(1)), F.lit(n)).alias("n_nationkey"))
    return _named(rows.join(nations, "n_nationkey"), 8, 8).withColumnRenamed("id", "call_id")


def _names(t):
    """Names by a tagger that is fitted on passages in which customers say one and on plain stretches of documents, over every document with its speaker's introduction, and over the customers' sentences."""
    nation = t.nation.select("n_nationkey", "n_name")
    # a customer says it half way into a passage of the benchmark
    passages = t.benchmark.filter("text IS NOT NULL").select((F.row_number().over(Window.orderBy("item_id", "text")) - 1).cast("long").alias("nth"), c("text").alias("passage"))  # a few hundred rows
    half = F.floor(F.char_length("passage") / 2).cast("int")
    asked = t.customer.withColumn("nth", F.pmod(c("c_custkey"), F.lit(passages.count()))).join(passages, "nth").join(nation, c("c_nationkey") == c("n_nationkey"))
    said = _named(asked.select((-1 - c("c_custkey")).alias("id"), F.substring("passage", F.lit(1), half).alias("before"), F.substring("passage", half + 1, F.char_length("passage")).alias("after"), "n_name"), 0, 8)
    labelled = said.select("id", "text", F.array(F.struct("start", "end")).alias("names"))
    plain = t.clean_transcripts.filter("call_id IS NOT NULL").select(c("call_id").alias("id"), F.substring("text", F.pmod(F.xxhash64("call_id", F.lit(2)), F.greatest(F.char_length("text") - PLAIN, F.lit(1))).cast("int") + 1, F.lit(PLAIN)).alias("text"), F.array().cast("array<struct<start:int,end:int>>").alias("names"))
    models = G.train(labelled.unionByName(plain)).many()
    texts = _introduced(t).select("call_id", "text").unionByName(spread(said.select(c("id").alias("call_id"), "text"), t.customer))
    return texts.select("call_id", X.names(c("text"), models).alias("s")).select("call_id", F.inline("s")).withColumn("confidence", F.round("confidence", 6))


query("pii_17")(_names)
_WS = r"[^ \t\n\x0B\f\r]+"
query(
    "pii_18",
    f"""
, w AS (SELECT doc_id AS call_id, regexp_extract_all(text, '{_WS}') AS ws, regexp_split_to_array(text, '{_WS}') AS gaps FROM documents WHERE text IS NOT NULL),
t AS (SELECT call_id, i, ws[i] AS word, length(gaps[i]) AS gap, i > 1 AND regexp_matches(ws[i], '^\\p{{Lu}}') AS cap FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w) AS x),
p AS (SELECT *, sum(gap + length(word)) OVER o AS stop, cap AND coalesce(lag(cap) OVER o, false) AND gap <= 1 AS goes_on FROM t WINDOW o AS (PARTITION BY call_id ORDER BY i)),
g AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY call_id ORDER BY i) AS run FROM p)
SELECT call_id, min(stop - length(word))::INT AS start, max(stop)::INT AS "end", 'name' AS kind, 0.9::DOUBLE AS confidence FROM g WHERE cap GROUP BY call_id, run""",
)(
    lambda t: t.clean_transcripts.select("call_id", X.span_udf(lambda text: X.S.align(text, stub_model(text))[0])(c("text")).alias("s")).select("call_id", F.inline("s"))
    .select("call_id", "start", "end", "kind", F.round("confidence", 6).alias("confidence"))
)
# Where a house number begins right before the first word behind digits and blanks.
_BEFORE = "length(regexp_extract(text, '(?s)^.*?[0-9][ \\t]+'))"
_HEAD = f"substr(text, greatest({_BEFORE} - 12, 0) + 1, least({_BEFORE}, 12))"
query("pii_19", f"SELECT call_id, CASE WHEN regexp_matches({_HEAD}, '(?:^|[^0-9])[0-9]{{1,6}}[ \\t]+$') THEN {_BEFORE} - length(regexp_extract({_HEAD}, '[0-9]{{1,6}}[ \\t]+$')) ELSE -1 END AS start FROM {_SAID_SQL} AS x WHERE text IS NOT NULL")(
    lambda t: _said_too(t).filter("text IS NOT NULL").select("call_id", F.coalesce(X.house_numbers(c("text"), F.char_length(F.regexp_extract("text", r"(?s)^.*?[0-9][ \t]+", 0))), F.lit(-1)).alias("start"))
)
query("pii_20")(lambda t: t.clean_transcripts.select("call_id", X.merged(F.concat(X.detect(c("text"), "phone"), X.detect(c("text"), "number"), X.deny_list(c("text"), DENY))).alias("m")).select("call_id", "m.disagreement", F.inline("m.spans")))
for key, cols in (("pii_21", ["redaction.text", "redaction.vault"]), ("pii_22", ["redaction.spans"]), ("pii_23", ["redaction.residual"]), ("pii_24", ["redaction.disagreement", "redaction.findings"])):
    query(key)(lambda t, cols=cols: t.clean_transcripts.select("call_id", X.redacted(c("text"), DENY).alias("redaction")).select("call_id", *(F.col(x).cast("string") if x.endswith("residual") else F.col(x) for x in cols)))
query("pii_25")(lambda t: t.clean_transcripts.select("call_id", X.redacted(c("text"), DENY)["signals"].alias("r")).select("call_id", C.risk_score(c("r")).alias("score"), C.risk_forced(c("r")).alias("forced"), C.risk_safe(c("r")).alias("safe")))
_NUMBERS = "len(regexp_extract_all(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '[0-9]{7,}'))"
query(
    "pii_26",
    f"SELECT call_id, length(text) < {P.SHORT_TEXT} AS short, {_NUMBERS} + {_TERMS} >= {P.DENSITY_SPANS} AND ({_NUMBERS} + {_TERMS}) / greatest(1, length(text)) * 1000 > {P.DENSITY_PER_1000} AS dense, contains({_TERM}, 'generalpubliclicense') OR contains({_TERM}, 'thonou') AS denied "
    f"FROM (SELECT call_id, text FROM {_SAID_SQL} AS y UNION ALL SELECT 1000000000 + c_custkey, concat_ws(' . x . ', '1234567', '2345678', '3456789', '4567890', CAST(5000000 + c_custkey AS STRING)) FROM customer) AS x WHERE text IS NOT NULL",
)(
    # the signals that the span list itself raises, with long numbers and client terms as spans
    lambda t: _said_too(t).unionByName(t.customer.select((c("c_custkey") + 1000000000).alias("call_id"), F.expr("concat_ws(' . x . ', '1234567', '2345678', '3456789', '4567890', CAST(5000000 + c_custkey AS STRING))").alias("text"))).filter("text IS NOT NULL")
    .select("call_id", X.span_signals(c("text"), DENY).alias("s"))
    .select("call_id", *(F.array_contains("s", reason).alias(name) for name, reason in (("short", "short_transcript"), ("dense", "high_entity_density"), ("denied", "deny_list_hit"))))
)
query("pii_27")(lambda t: X.decided(t.clean_transcripts, "text", DENY).select("call_id", "decision", "risk"))


def _pairs(t):
    """Each benchmark passage beside every document that can quote it, whole or nearly, anywhere in its text."""
    heads, texts = t.benchmark.select("item_id", c("text").alias("phrase")), t.clean_transcripts.select("call_id", "text")
    pairs = X.quote_pairs(heads, texts).join(heads, "item_id")
    return pairs.join(texts.withColumnRenamed("call_id", "_id"), c("call_id").eqNullSafe(c("_id")))


def _quoted(t):
    """Passages that documents quote; of all other pairs the gate drops the passage."""
    return _pairs(t).select("item_id", "call_id", X.verbatim(F.array("phrase"), c("text")).alias("v")).select("item_id", "call_id", "v.*").filter("dropped = 0")


query("txt_01")(_quoted)
query("txt_02")(lambda t: _pairs(t).select("item_id", "call_id", X.nearest(c("phrase"), c("text")).alias("v")).select("item_id", "call_id", "v.*").filter("likeness IS NOT NULL"))
query("txt_03", "SELECT item_id, text FROM benchmark WHERE NOT regexp_matches(text, '\\[[A-Z_]+_[0-9]+\\]')")(lambda t: t.benchmark.select("item_id", F.explode(C.without_tokens(F.array("text"))).alias("text")))
_any = lambda xs: "(?:^|\\W)(?:" + "|".join(xs).replace("'", "''") + ")(?:$|\\W)"
_LIGHT = "trim(regexp_replace(translate(lower(text), '‘’', ''''''), '\\s+', ' ', 'g'))"
query(
    "txt_04",
    f"SELECT doc_id AS call_id, CASE WHEN regexp_matches({_LIGHT}, '{_any(V.EMERGENCY_PHRASES)}') THEN 'emergency' WHEN regexp_matches({_LIGHT}, '{_any(V.AMBIGUOUS_PHRASES)}') THEN CASE WHEN doc_id % 2 = 0 THEN 'urgent' ELSE 'emergency' END ELSE CASE WHEN doc_id % 2 = 0 THEN 'routine' ELSE 'urgent' END END AS urgency FROM documents",
)(lambda t: t.clean_transcripts.select("call_id", C.urgency_rule(F.when(c("call_id") % 2 == 0, "routine").otherwise("urgent"), F.lit("general"), c("text")).alias("urgency")))
query("txt_05", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'truncated' WHEN event_type = 'signup' THEN 'schema_invalid' END AS failure FROM events")(
    lambda t: t.events.select("event_id", F.when(c("event_type") == "error", "max_tokens").otherwise("end_turn").alias("stop"),
                              F.when(c("event_type") == "signup", c("props")).otherwise(F.to_json(F.struct(c("event_type").alias("bucket")))).alias("answer"))
    .select("event_id", X.strict_record(c("answer"), c("stop"), {"bucket": ("view", "click", "purchase", "error")})["failure"].alias("failure"))
)
query("txt_06")(lambda t: t.clean_transcripts.select("call_id", X.sanitized(C.first_line(c("text")), DENY).alias("line")))
query("op_24")(lambda t: t.clean_transcripts.select("call_id", "lang", C.first_line(c("text")).alias("first")).select("call_id", "lang", X.sanitized(c("first"), DENY).alias("line"), (F.length("first") > 0).alias("stated")))
for key in ("txt_08",):
    query(key)(lambda t: t.clean_transcripts.select("call_id", X.residual(c("text"), DENY).alias("r")).select("call_id", (F.size(F.map_keys("r")) == 0).alias("safe"), F.array_join(F.array_sort(F.map_keys("r")), ",").alias("categories")))
query("op_23")(lambda t: t.clean_transcripts.select("call_id", F.explode(X.residual(c("text"), DENY)).alias("category", "n")))
query("op_37")(
    # what a redaction has left behind, held against the scan once more: nothing may be
    lambda t: t.clean_transcripts.select("call_id", X.residual(X.redacted(c("text"), DENY)["text"], DENY).alias("r")).select("call_id", (F.size("r") == 0).alias("safe"), F.array_join(F.array_sort(F.map_keys("r")), ",").alias("categories"))
)
#: Values of a vault that the documents hold: a long one, met in the squeezed text, and a short one, met as a whole word.
VAULT = ("General Public", "Thonou")
_STRIPPED = r"regexp_replace(text, '\[[A-Z_]+_[0-9]+\]', ' ', 'g')"
query(
    "op_31",
    f"SELECT doc_id AS call_id, contains(regexp_replace(lower({_STRIPPED}), '[^a-z0-9]', '', 'g'), 'generalpublic') AS first, "
    f"contains(' ' || regexp_replace(lower({_STRIPPED}), '[^a-z0-9]+', ' ', 'g') || ' ', ' thonou ') AS second FROM documents WHERE text IS NOT NULL",
)(lambda t: t.clean_transcripts.filter("text IS NOT NULL").select("call_id", X.reintroduced(c("text"), VAULT).alias("r")).select("call_id", c("r")[0].alias("first"), c("r")[1].alias("second")))
query("txt_09")(
    lambda t: t.clean_transcripts.select("call_id", X.residual(c("text"), DENY).alias("r"), "text")
    .select("call_id", F.when(F.size(F.map_keys("r")) > 0, "residual_pii").when(c("text").rlike(r"\[[A-Z_]+_[0-9]+\]"), "tokened_phrase").otherwise("passed").alias("result"))
)
query("op_44")(lambda t: t.clean_transcripts.select("call_id", X.residual(c("text"), DENY).cast("string").alias("categories"), X.contexts(c("text"), "general public license").alias("contexts")))
