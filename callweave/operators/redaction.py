"""Text operators on columns: span functions run as Arrow UDFs, everything else as expressions."""

from __future__ import annotations

import functools
import hashlib
import hmac
import json
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import spans as S
from ..scratch import kept

SPANS = "array<struct<start:int,end:int,kind:string,detector:string,confidence:double>>"
REDACTION = (
    "text string, vault array<struct<token:string,value:string>>, findings array<struct<kind:string,token:string,value:string>>, "
    f"spans {SPANS}, disagreement boolean, residual map<string,int>, signals array<string>"
)


def _rows(spans: Iterable[S.Span]) -> list[dict]:
    return [s._asdict() for s in spans]


def _judged(texts: Iterable[str | None], deny: list[str]) -> Iterator[tuple[str, bool]]:
    """Each text, an empty one for null, and whether a detector or scan could find something in it."""
    known = [t or "" for t in texts]
    return zip(known, S.suspects(pa.array(known, pa.large_string()), deny))


def span_udf(find: Callable[[str], list[S.Span]]) -> Callable[[Column], Column]:
    """A span function as a column function; null text gives no spans.

    Marked as not deterministic so that it runs once: Spark would else infer from `inline` that there must be a span, and
    test that by the same function where the table is read.
    """
    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _rows(find(t)) if t else [])

    return run.asNondeterministic()


def names(text: Column, models: Callable[[list[str]], list[list[tuple[str, float, str]]]]) -> Column:
    """Spans of a token model that reads many texts at once."""
    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_rows(found) for found in S.ner_of_many((t or "" for t in texts), models)], dtype=object)

    return run.asNondeterministic()(text)


#: Detectors by name: anything that maps a text to spans can be added.
DETECTORS: dict[str, Callable[[str], list[S.Span]]] = {
    "phone": S.phones, "email": S.emails, "street_address": S.street_addresses, "cross_street": S.cross_streets, "credit_card": S.cards,
    "government_id": S.government_ids, "number": S.long_numbers, "spelled_digits": S.spelled_digits, "greeted_name": S.greeted_names,
    "email_like": S.email_like, "address_digits": S.address_digits, "composite": S.detect,
}


def detect(text: Column, name: str = "composite") -> Column:
    return span_udf(DETECTORS[name])(text)


def spelled_runs(text: Column) -> Column:
    """Digits of each run of seven or more spoken ones."""
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [S.spoken(t[s.start : s.end]) for s in S.spelled_digits(t or "")])

    return run(text)


def house_numbers(text: Column, start: Column) -> Column:
    """Where a house number right before a place of the text begins."""
    @F.pandas_udf("int")
    def run(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([S.house_number(t or "", int(s)) for t, s in zip(texts, starts)], dtype="Int32")

    return run(text, start)


def span_signals(text: Column, deny: list[str]) -> Column:
    """The risk signals of a text whose spans are its long numbers and client terms."""
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: S.signals(t or "", [*S.long_numbers(t or ""), *S.denied_anywhere(t or "", deny)], False))

    return run(text)


def reintroduced(text: Column, values: Iterable[str]) -> Column:
    """For each vaulted value whether it can be read in a redacted text."""
    known = list(values)

    @F.pandas_udf("array<boolean>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: S.reappearing(known, t or ""))

    return run(text)


def deny_list(text: Column, terms: list[str], anywhere: bool = False) -> Column:
    find = S.denied_anywhere if anywhere else S.denied
    return span_udf(lambda t: find(t, terms))(text)


def merged(spans: Column) -> Column:
    """struct<spans,disagreement> of a span column."""
    @F.pandas_udf(f"spans {SPANS}, disagreement boolean")
    def run(found: pd.Series) -> pd.DataFrame:
        rows = [S.merge(S.Span(**s) for s in (x if x is not None else [])) for x in found]
        return pd.DataFrame({"spans": [_rows(r) for r, _ in rows], "disagreement": [d for _, d in rows]})

    return run(spans)


def redacted(text: Column, deny: list[str] | None = None) -> Column:
    """The whole redaction of a text: detect, merge, repair, tokenize, scan, and its risk signals."""
    terms = list(deny or [])

    @F.pandas_udf(REDACTION)
    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t, suspect in _judged(texts, terms):
            r = S.redact(t, terms) if suspect else S.untouched(t)
            out.append({
                "text": r.tokenized.text, "vault": [{"token": k, "value": v} for k, v in r.tokenized.vault],
                "findings": [{"kind": k, "token": t_, "value": v} for k, t_, v in r.tokenized.findings], "spans": _rows(r.spans),
                "disagreement": r.disagreement, "residual": r.residual, "signals": S.signals(t, r.spans, r.disagreement, bool(r.residual)),
            })
        return pd.DataFrame(out, columns=["text", "vault", "findings", "spans", "disagreement", "residual", "signals"])

    return run(text)


def residual(text: Column, deny: list[str] | None = None) -> Column:
    """map<category,count> of what a text still seems to hold."""
    terms = list(deny or [])

    @F.pandas_udf("map<string,int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([S.residual(t, (), terms) if suspect else {} for t, suspect in _judged(texts, terms)], dtype=object)

    return run(text)


def decided(df: DataFrame, text_col: str = "text", deny: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """df with `redaction` and `decision`: write, or the hold reason. The UDF runs once: its column is materialised by the map."""
    from ..functions import columns as C

    one = df.withColumn("redaction", redacted(F.coalesce(F.col(text_col), F.lit("")), deny))
    signals = F.col("redaction.signals")
    left = F.map_values("redaction.residual")
    return one.withColumn("risk", C.risk_score(signals)).withColumn(
        "decision",
        F.when(F.size(left) > 0, "residual_pii_detected").when(C.risk_forced(signals) | (F.col("risk") >= threshold), "redaction_failed").otherwise("write"),
    )


def sanitized(value: Column, deny: list[str] | None = None) -> Column:
    """A scalar, or null if the scan finds anything in it."""
    return F.when(F.size(F.map_keys(residual(value, deny))) == 0, value)


#: Texts of a batch whose verdicts are remembered.
JUDGED = 1 << 12


def sanitized_rows(df: DataFrame, scalars: list[str], arrays: list[str], deny: list[str] | None = None) -> DataFrame:
    """Every free text of every row held against the scan: an unsafe scalar becomes null, an unsafe element leaves its array.

    All texts of a row go through one UDF call; what a batch has met lately, such as the name of a category, is not scanned again.
    """
    terms = list(deny or [])

    @F.pandas_udf(", ".join([*(f"{x} string" for x in scalars), *(f"{x} array<string>" for x in arrays)]))
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        safe = functools.lru_cache(maxsize=JUDGED)(lambda t: t is None or not S.residual(t, (), terms))
        one = {x: [t if safe(t) else None for t in rows[x]] for x in scalars}
        return pd.DataFrame(one | {x: [None if a is None else [t for t in a if safe(t)] for a in rows[x]] for x in arrays})

    clean = df.withColumn("_clean", run(F.struct(*scalars, *arrays)))
    return clean.select(*(F.col(f"_clean.{x}").alias(x) if x in (*scalars, *arrays) else F.col(x) for x in df.columns))


def verbatim(phrases: Column, text: Column) -> Column:
    """struct<phrases,exact,snapped,dropped>: phrases held against a text."""
    @F.pandas_udf("phrases array<string>, exact int, snapped int, dropped int")
    def run(wanted: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([S.verbatim_gate(p if p is not None else [], t or "") for p, t in zip(wanted, texts)], columns=["phrases", "exact", "snapped", "dropped"])

    return run.asNondeterministic()(phrases, text)  # so that a filter of its result does not run it once more


def nearest(phrase: Column, text: Column) -> Column:
    """struct<span,likeness>: the stretch of a text nearest to a phrase, null below the gate's likeness."""
    @F.pandas_udf("span string, likeness double")
    def run(wanted: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [S.snap(p or "", t or "", P.SNAP_LEAST) for p, t in zip(wanted, texts)]
        return pd.DataFrame([f if f is not None and f[1] >= P.SNAP_LEAST else (None, None) for f in found], columns=["span", "likeness"])

    return run.asNondeterministic()(phrase, text)


#: Letters of phrases that one automaton holds, and rows of probes that are sent to all tasks, at most.
AUTOMATON, PROBES = 1 << 24, 1 << 20


def exact_pairs(phrases: DataFrame, texts: DataFrame, most: int = AUTOMATON) -> DataFrame:
    """(item_id, call_id): every pair in which the text has the phrase as it is, but for case and marks.

    One automaton over all phrases reads each text once, where it lies. Phrases of more than `most` letters together are
    dealt into several automata, which read the texts one after another. An empty phrase is in every text.
    """
    size = phrases.agg(F.sum(F.char_length("phrase"))).first()[0] or 0
    passes = max(1, -(-size // most))
    schema = f"item_id {phrases.schema['item_id'].dataType.simpleString()}, call_id {texts.schema['call_id'].dataType.simpleString()}"

    def one(k: int) -> DataFrame:
        items: dict[str, list] = {}
        for r in phrases.filter(F.pmod(F.xxhash64("item_id", "phrase"), F.lit(passes)) == k).select("item_id", "phrase").collect():
            items.setdefault(S.verbatim(r.phrase or ""), []).append(r.item_id)
        everywhere = items.pop("", [])

        def met(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            needles = S.Needles(items)
            for f in frames:
                rows = []
                for call, text in zip(f["call_id"], f["text"]):
                    found = needles.present(S.verbatim(text or ""))
                    rows += [(i, call) for i in [*everywhere, *(i for n in found for i in items[n])]]
                yield pd.DataFrame(rows, columns=["item_id", "call_id"])

        return texts.select("call_id", "text").mapInPandas(met, schema)

    parts = [one(k) if passes == 1 else kept(one(k), "exact-quotes") for k in range(passes)]
    return functools.reduce(DataFrame.unionByName, parts)


#: Words of phrases that a task looks for by itself, at most; of more, all words of the texts go on.
WORDS = 1 << 17


def _few(words: DataFrame, most: int) -> frozenset[str] | None:
    """The words, if they are so few that every task can have them."""
    found = words.limit(min(most, WORDS) + 1).collect()
    return frozenset(r.word for r in found) if len(found) <= min(most, WORDS) else None


def _word_counts(texts: DataFrame, only: frozenset[str] | None) -> DataFrame:
    """(word, n): how often each batch of texts has each of its words, or of those in `only`."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            n = Counter(w for t in b.column(0).to_pylist() for w in S.spoken_words(t or "") if only is None or w in only)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    return texts.select("text").mapInArrow(count, "word string, n long")


def _word_places(text: Column, only: frozenset[str] | None) -> Column:
    """The text's words, or those in `only`, and where each stands among all of them."""
    @F.pandas_udf("array<struct<pos:int,word:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"pos": i, "word": w} for i, w in enumerate(S.spoken_words(t or "")) if only is None or w in only])

    return run.asNondeterministic()(text)


def quote_pairs(phrases: DataFrame, texts: DataFrame, shared: int = 4, automaton: int = AUTOMATON, broadcast: int = PROBES) -> DataFrame:
    """(item_id, call_id): every pair in which the gate keeps the phrase, and few others. No pair is missed.

    phrases: item_id, phrase. texts: call_id, text. Exact quotes come from `exact_pairs`. A snapped quote has `least` of the
    phrase's m words in m + 1 words of the text, so of any m - least + n inner words of the phrase at least n stand within
    m + 1 words of the text. The rarest ones are taken, for n up to `shared`. Phrases of one or two words, of which nothing
    is inside, can only be exact. Up to `broadcast` words of the phrases are sent to all tasks, so that the words of the
    texts, many times more, are met where they are read; beyond that both are shuffled.
    """
    from ..functions import columns as C

    split = lambda x: F.split(x, " ")
    flat, text, m = F.col("flat"), F.col("text"), F.col("m")
    wanted = phrases.select("item_id", C.normal_verbatim(F.col("phrase")).alias("flat")).withColumn("m", F.when(flat == "", 0).otherwise(F.size(split(flat))))
    least = F.ceil(m * P.SNAP_LEAST - 1e-9).cast("int")
    inner = wanted.filter(m > 2).select("item_id", "m", least.alias("least"), F.posexplode(split(flat)).alias("pos", "word")).filter((F.col("pos") > 0) & (F.col("pos") < m - 1))
    known = inner.select("word").distinct()
    often = _word_counts(texts, _few(known, broadcast)).join(known, "word").groupBy("word").agg(F.sum("n").alias("count"))
    rarest = Window.partitionBy("item_id").orderBy(F.col("count").asc_nulls_first(), "word", "pos")
    ranked = inner.join(often, "word", "left").withColumn("rank", F.row_number().over(rarest)).withColumn("n", F.least(F.lit(shared), F.col("least") - 2))
    probes = kept(ranked.filter(F.col("rank") <= m - F.col("least") + F.col("n")).select("item_id", "m", "n", "word").distinct(), "quote-probes")
    said = _word_places(text, _few(probes.select("word").distinct(), broadcast))
    hits = texts.select("call_id", F.inline(said)).join(probes.hint("broadcast" if probes.count() <= broadcast else "shuffle_hash"), "word").drop("word")
    onward = Window.partitionBy("item_id", "call_id").orderBy("pos")
    nth = F.coalesce(*(F.when(F.col("n") == i, F.lead("pos", i - 1).over(onward)) for i in range(1, shared + 1)))
    long = hits.withColumn("nth", nth).filter(F.col("nth") - F.col("pos") <= m).select("item_id", "call_id")
    return long.unionByName(exact_pairs(phrases, texts, automaton)).distinct()


def keyed_hash(secret: bytes, *parts: Column) -> Column:
    """HMAC-SHA-256 of the parts with a zero byte between them, in hex."""
    @F.pandas_udf("string")
    def run(joined: pd.Series) -> pd.Series:
        return joined.map(lambda x: hmac.new(secret, x.encode(), hashlib.sha256).hexdigest() if x is not None else None)

    return run(F.concat_ws("\0", *parts))


def title_case(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: S.title_case(t) if t is not None else None)

    return run(text)


def contexts(text: Column, value: str, radius: int = 48, most: int = 5) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: S.contexts(t or "", value, radius, most))

    return run(text)


def canonical_json(x: Column) -> Column:
    """JSON text with sorted keys and no blanks; what does not parse, or names a key twice, gives null. A variant keeps its keys sorted."""
    return F.to_json(F.try_parse_json(x))


def json_leaves(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, leaf): the distinct `path:type` of every leaf of each row's JSON, array places as []; what does not parse has none.

    One level of all rows at a time: objects and arrays are opened by `variant_explode`, anything else is a leaf. There are as
    many rounds as the deepest payload has levels; each is written, so none is computed twice.
    """
    spark = df.sparkSession
    open_ = df.select(F.col(id_col).alias("id"), F.lit("").alias("path"), F.try_parse_json(json_col).alias("v")).filter("v IS NOT NULL")
    found = []
    while True:
        shape = F.schema_of_variant("v")
        kind = F.when((shape == "ARRAY<VOID>") & (F.to_json("v") == "[]"), "ARRAY<>").otherwise(shape)  # an array of nulls has that shape, too
        rows = kept(open_.select("id", "path", "v", kind.alias("kind")).withColumn("nested", F.col("kind").rlike("^(OBJECT|ARRAY)<") & ~F.col("kind").isin("OBJECT<>", "ARRAY<>")), "json-level")
        empty = F.when(F.col("kind") == "OBJECT<>", F.concat("path", F.lit(":object"))).when(F.col("kind") == "ARRAY<>", F.concat("path", F.lit("[]:empty")))
        plain = F.when(F.col("kind") == "VOID", "null").when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind") == "STRING", "string").otherwise("number")
        found.append(rows.filter("NOT nested").select("id", F.coalesce(empty, F.concat_ws(":", "path", plain)).alias("leaf")).distinct())
        nested = rows.filter("nested")
        if nested.isEmpty():
            return functools.reduce(DataFrame.unionByName, found).distinct()
        open_ = spark.sql("SELECT id, CASE WHEN e.key IS NULL THEN path || '[]' WHEN path = '' THEN e.key ELSE path || '.' || e.key END AS path, e.value AS v FROM {rows}, LATERAL variant_explode(v) AS e", rows=nested)


#: Keys of a payload, in lower case, whose values are personal.
LABELS = {
    "phones": ("phone", "phone_number", "external_number", "internal_number", "from_number", "to_number", "caller_number", "callee_number", "contact_phone", "number"),
    "names": ("name", "contact_name", "display_name", "first_name", "last_name", "customer_name"),
    "emails": ("email", "email_address", "contact_email", "customer_email"),
}


def labelled_values(x: Column) -> Column:
    """struct<phones,names,emails>: every text or number below a key of LABELS, at any depth, each once and in order of place."""
    of = {key: kind for kind, keys in LABELS.items() for key in keys}

    def below(node) -> list[str]:
        inner = node.values() if isinstance(node, dict) else node if isinstance(node, list) else None
        if inner is not None:
            return [v for x in inner for v in below(x)]
        text = "" if node is None or isinstance(node, bool) else str(node).strip()
        return [text] if text else []

    def one(t: str | None) -> dict[str, list[str]]:
        found: dict[str, list[str]] = {kind: [] for kind in LABELS}
        try:
            open_ = [json.loads(t)] if t else []
        except ValueError:
            open_ = []
        while open_:
            node = open_.pop(0)
            for key, v in node.items() if isinstance(node, dict) else ():
                if (kind := of.get(key.lower())) is not None:
                    found[kind] += below(v)
            if isinstance(node, dict | list):
                open_ += [v for k, v in (node.items() if isinstance(node, dict) else enumerate(node)) if not (isinstance(k, str) and k.lower() in of)]
        return {kind: list(dict.fromkeys(values)) for kind, values in found.items()}

    @F.pandas_udf(", ".join(f"{kind} array<string>" for kind in LABELS))
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=list(LABELS))

    return run(x)


def strict_record(response: Column, stop_reason: Column, fields: dict[str, tuple[str, ...] | None]) -> Column:
    """struct<record map, failure>: a model's JSON answer, all fields and no others, each in its domain.

    The first failure counts, in the order stop reason, empty, JSON, schema.
    """
    def one(text: str | None, stop: str | None) -> tuple[dict | None, str | None]:
        if stop == "max_tokens":
            return None, "truncated"
        if stop == "refusal":
            return None, "refusal"
        if stop not in ("end_turn", "stop_sequence"):
            return None, "unexpected_stop_reason"
        if not text or not text.strip():
            return None, "empty"
        try:
            node = json.loads(text)
        except ValueError:
            return None, "non_json"
        good = isinstance(node, dict) and set(node) == set(fields) and all(isinstance(v, str) and (fields[k] is None or v in fields[k]) for k, v in node.items())
        return (node, None) if good else (None, "schema_invalid")

    @F.pandas_udf("record map<string,string>, failure string")
    def run(texts: pd.Series, stops: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t, s) for t, s in zip(texts, stops)], columns=["record", "failure"])

    return run(response, stop_reason)
