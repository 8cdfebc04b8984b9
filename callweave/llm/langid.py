"""Language identification by Bayesian evidence fusion.

Text likelihoods come from a naive Bayes model over character trigrams, trained on a bounded sample of labelled
documents (SAMPLE_DOCS, a parameter). They are combined with the language that the markup declares, with the address
suffix where it is a country's, and with a prior for the host. Host priors are smoothed through the hierarchy host ->
domain -> all pages: counts are sums of first-pass posteriors, by grouped aggregation over all pages, and a page never
counts for itself.

Posteriors are summed in whole millionths, so results do not depend on the order of rows. A hot host is combined
before the shuffle; the join back to its pages is an ordinary one that Spark can split.

Defined cases: null or empty html has no text evidence; null url counts as a page of the host ''; a declared language
that the model does not know is no evidence; equal posteriors go to the language that sorts first; repeated rows are
judged as often as they occur; very long pages are read whole, in one pass; columns of pages beside id, url and html are
not read, so their names don't matter; with no labelled documents, or no pages, there are no rows; documents with more
than LABELS distinct labels raise ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE_DOCS = 4000
#: Trigrams are hashed into this many buckets.
BUCKETS = 1 << 15
#: Distinct labels at most: the model has BUCKETS numbers for each.
LABELS = 256
#: A weight of the model: neighbouring trigrams say much the same, so a text of any length, read whole, weighs as much as
#: this many independent ones at most.
EVIDENCE = 60
#: Chance that markup declares the true language, that a country suffix fits it, and the weight of a parent prior.
DECLARED, SUFFIX, PARENT = 0.9, 0.8, 5.0
UNIT = 1_000_000
#: Languages of country suffixes where one language is spoken by most.
COUNTRIES = {
    "de": "de", "at": "de", "li": "de", "fr": "fr", "mc": "fr", "es": "es", "mx": "es", "ar": "es", "co": "es", "cl": "es", "pe": "es", "ve": "es", "uy": "es", "ec": "es", "bo": "es", "py": "es",
    "cr": "es", "pa": "es", "gt": "es", "hn": "es", "ni": "es", "sv": "es", "do": "es", "cu": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "gb": "en", "it": "it", "sm": "it",
    "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "cz": "cs", "sk": "sk", "hu": "hu", "ro": "ro", "bg": "bg", "gr": "el", "tr": "tr", "ru": "ru", "ua": "uk", "se": "sv", "dk": "da", "no": "no",
    "fi": "fi", "ee": "et", "lv": "lv", "lt": "lt", "si": "sl", "hr": "hr", "rs": "sr", "is": "is", "jp": "ja", "cn": "zh", "tw": "zh", "kr": "ko", "vn": "vi", "th": "th", "id": "id", "ir": "fa", "il": "he",
}
#: Second-level names under which countries register hosts; a domain there has three parts.
REGISTRIES = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "ltd", "me", "mil", "net", "nhs", "nom", "or", "org", "plc", "sch")

_OPENS = re.compile(r"<(?:(script|style)\b|(!--))?", re.I)
_CLOSES = {"script": re.compile(r"</script\s*>", re.I), "style": re.compile(r"</style\s*>", re.I), "!--": re.compile("-->")}
_OTHER = re.compile(r"[\W\d_]+")


_HTML, _LANG = re.compile(r"<html\b", re.I), re.compile(r"""\blang\s*=\s*["']?([a-z]+)""", re.I)


def read(html: str | None) -> tuple[str, str]:
    """The text without tags, comments, scripts and styles, a blank for each, and the language that the first html tag with one declares.

    One pass; what is never closed is text or a tag. A tag inside a comment, script or style declares nothing.
    """
    html, parts, at, endless, declared = html or "", [], 0, set(), ""
    for m in _OPENS.finditer(html):
        if m.start() < at:
            continue
        kind = (m[1] or m[2] or "").lower()
        close = _CLOSES[kind].search(html, m.end()) if kind and kind not in endless else None
        if close is None:
            endless.add(kind)
            end = html.find(">", m.end()) + 1
            if not declared and _HTML.match(html, m.start()) and (said := _LANG.search(html, m.start(), end or len(html))):
                declared = said[1].lower()
            if not end:
                break
        else:
            end = close.end()
        parts.append(html[at : m.start()])
        at = end
    return " ".join([*parts, html[at:]]), declared


def visible(html: str | None) -> str:
    return read(html)[0]


def domain(host: Column) -> Column:
    """The part of a host that is registered: its last two names, or three under a country's registry (`x.co.uk`)."""
    second = F.substring_index(F.substring_index(host, ".", -2), ".", 1)
    country = F.char_length(F.substring_index(host, ".", -1)) == 2
    return F.when(country & second.isin(*REGISTRIES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the text's letter trigrams, words padded with a blank."""
    letters = " " + _OTHER.sub(" ", text.lower()).strip() + " "
    codes = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:] * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
    return ((mixed * np.uint64(0x27D4EB2F) >> np.uint64(13)) % np.uint64(BUCKETS)).astype(np.int64)


class Model:
    """Log probabilities of buckets by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True))

    def score(self, text: str) -> list[float]:
        found = trigrams(text)
        if not len(found):
            return [0.0] * len(self.langs)
        mean = self.logs[:, found].mean(axis=1) * min(len(found), EVIDENCE)
        return (mean - mean.max()).tolist()


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> Model | None:
    """Fit on the sample_docs labelled documents with the smallest hash of their id; None if there are none."""
    labelled = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = labelled.select(id_col).filter(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(sample_docs)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, rows in pdf.groupby("label"):
                n = np.bincount(np.concatenate([trigrams(t) for t in rows["text"]]), minlength=BUCKETS)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"label": lang, "bucket": at, "n": n[at]})

    rows = labelled.join(chosen, id_col, "left_semi").select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    if rows.select("label").distinct().limit(LABELS + 1).count() > LABELS:
        raise ValueError(f"more than {LABELS} labels")
    found = rows.mapInPandas(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    table = found.toPandas()  # at most BUCKETS rows for each of LABELS languages
    if table.empty:
        return None
    langs = sorted(table["label"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    np.add.at(counts, (table["label"].map(langs.index).to_numpy(), table["bucket"].to_numpy()), table["n"].to_numpy())
    return Model(langs, counts)


def evidence(pages: DataFrame, model: Model, id_col: str = "page_id") -> DataFrame:
    """(id, host, domain, declared, suffix, logs array<double>): everything that one page says."""
    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = [read(h) for h in pdf["html"]]
            yield pd.DataFrame({id_col: pdf[id_col], "url": pdf["url"], "declared": [d for _, d in texts], "logs": [model.score(t) for t, _ in texts]})

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(id_col, "url", "html").mapInPandas(stage, f"{id_col} {kind}, url string, declared string, logs array<double>")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    return rows.withColumn("host", host).select(
        id_col, "host", domain(F.col("host")).alias("domain"), F.coalesce("declared", F.lit("")).alias("declared"), F.substring_index("host", ".", -1).alias("suffix"), "logs"
    )


def _softmax(logs: list[Column]) -> list[Column]:
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = [F.exp(x - top) for x in logs]
    total = sum(weights[1:], weights[0])
    return [w / total for w in weights]


def identify(pages: DataFrame, docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "page_id") -> DataFrame:
    """(id, lang, millionths, text_lang, declared, host): the language of each page and its posterior."""
    model = train(docs, sample_docs)
    if model is None:
        return pages.select(id_col, F.lit("").alias("lang"), F.lit(0).cast("long").alias("millionths"), F.lit("").alias("text_lang"), F.lit("").alias("declared"), F.lit("").alias("host")).limit(0)
    langs, n = model.langs, len(model.langs)
    said = evidence(pages, model, id_col)
    country = F.create_map(*(F.lit(x) for pair in COUNTRIES.items() for x in pair))

    def factor(seen: Column, lang: str, right: float) -> Column:
        known = seen.isin(langs)
        return F.when(~known | seen.isNull() | F.lit(n < 2), 0.0).when(seen == lang, float(np.log(right))).otherwise(float(np.log((1 - right) / max(n - 1, 1))))

    logs = [F.col("logs")[i] + factor(F.col("declared"), x, DECLARED) + factor(country[F.col("suffix")], x, SUFFIX) for i, x in enumerate(langs)]
    rows = said.select("*", *(x.alias(f"e{i}") for i, x in enumerate(logs)))
    rows = rows.select("*", *(F.round(p * UNIT).cast("long").alias(f"p{i}") for i, p in enumerate(_softmax([F.col(f"e{i}") for i in range(n)]))))
    rows = stored(rows, "page-evidence")

    sums = lambda names: [F.sum(c).alias(c) for c in names]
    own = [f"p{i}" for i in range(n)]
    hosts = rows.groupBy("domain", "host").agg(*sums(own))
    domains = hosts.groupBy("domain").agg(*(F.sum(c).alias(f"d{i}") for i, c in enumerate(own)))
    total = domains.agg(*sums(f"d{i}" for i in range(n))).first()  # n numbers
    whole = [float(x or 0) + UNIT for x in total]
    everywhere = [x / sum(whole) for x in whole]
    add = lambda cols: sum(cols[1:], cols[0])
    in_domain = [(F.col(f"d{i}") + PARENT * UNIT * everywhere[i]) / (add([F.col(f"d{j}") for j in range(n)]) + PARENT * UNIT) for i in range(n)]
    parents = hosts.join(domains, "domain").select("host", *(F.col(c).alias(f"h{i}") for i, c in enumerate(own)), *(x.alias(f"q{i}") for i, x in enumerate(in_domain)))

    joined = rows.join(parents, "host")
    rest = [F.col(f"h{i}") - F.col(f"p{i}") for i in range(n)]
    prior = [(rest[i] + PARENT * UNIT * F.col(f"q{i}")) / (add(rest) + PARENT * UNIT) for i in range(n)]
    final = _softmax([F.col(f"e{i}") + F.log(prior[i]) for i in range(n)])
    best = lambda values: F.array_max(F.array(*(F.struct(v.alias("v"), F.lit(-i).alias("k"), F.lit(x).alias("lang")) for i, (v, x) in enumerate(zip(values, langs)))))
    scored = joined.select(id_col, best([F.round(p * UNIT).cast("long") for p in final]).alias("b"), best([F.col("logs")[i] for i in range(n)]).alias("t"), "declared", "host")
    return scored.select(id_col, F.col("b.lang").alias("lang"), F.col("b.v").alias("millionths"), F.col("t.lang").alias("text_lang"), "declared", "host")
