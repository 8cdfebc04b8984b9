"""Column expressions: everything here stays in built-in, generated code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V


def normal_token(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def normal_light(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(F.lower(x), "‘’", "''"), r"\s+", " "))


def normal_verbatim(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), "['‘’]", ""), "[^a-z0-9]+", " "))


def phone_key(x: Column) -> Column:
    """Digits alone; a leading 1 of eleven digits goes."""
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)


def name_key(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def email_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def humanized(x: Column) -> Column:
    """snake_case as a sentence; null and '' give null."""
    spaced = F.replace(x, F.lit("_"), F.lit(" "))
    return F.when(x != "", F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1 << 30)))


def first_line(x: Column, most: int = 240) -> Column:
    """The first sentence or line, at most `most` characters with an ellipsis."""
    whole = F.trim(x)
    line = F.trim(F.regexp_extract(whole, r"(?s)^(.*?[.!?](?=\s|$)|[^\n]*)", 1))
    return F.when(whole != "", F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most - 1)), F.lit("…"))).otherwise(line))


def luhn(x: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(x, "[ -]", ""))


def utc_day(ts: Column) -> Column:
    return F.to_date(ts)


def shown_in_zone(ts: Column, zone: str = "America/Chicago") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm")


def sla_state(due: Column, now: Column, lead_minutes: int = 15) -> Column:
    soon = due - F.expr(f"INTERVAL {lead_minutes} MINUTES")
    return F.when(due.isNull(), "ok").when(now >= due, "breached").when(now >= soon, "due_soon").otherwise("ok")


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: float, rate_out: float) -> Column:
    """Dollars at rates per million tokens, rounded to six places as every stored amount is."""
    rate = lambda x: F.lit(str(x)).cast("decimal(10,4)")
    return F.round((tokens_in.cast("decimal(18,0)") * rate(rate_in) + tokens_out.cast("decimal(18,0)") * rate(rate_out)) / F.lit(1_000_000), 6).cast("decimal(12,6)")


def payload_tokens(parts: Iterable[Column], overhead: int) -> Column:
    return sum((F.octet_length(p) for p in parts), F.lit(overhead))


def job_id(prefix: str, key: Column) -> Column:
    """A deterministic id: base64url of SHA-256, without padding."""
    raw = F.base64(F.unhex(F.sha2(F.concat(F.lit(prefix), key.cast("string")), 256)))
    return F.translate(F.replace(raw, F.lit("="), F.lit("")), "+/", "-_")


def epoch_ms(x: Column) -> Column:
    """Milliseconds from an epoch number or an ISO string, null otherwise."""
    number = x.try_cast("double")
    return F.coalesce(number.cast("long"), F.unix_millis(F.try_to_timestamp(x)))


def present_scalar(json: Column, paths: Iterable[str]) -> Column:
    """The first path that holds a scalar: objects and arrays are passed over."""
    def scalar(path: str) -> Column:
        x = F.get_json_object(json, path)
        return F.when(~x.rlike(r"^\s*[\[{]"), x)

    return F.coalesce(*(scalar(p) for p in paths))


def duration_ms(json: Column, path: str = "$.duration") -> Column:
    """A finite number of at least zero, else null."""
    x = F.get_json_object(json, path).try_cast("double")
    return F.when((x >= 0) & ~F.isnan(x) & (x < float("inf")), x)


def outcome(status: Column, drop: Column, held: Column) -> Column:
    """struct<key,label,reason> of a call's state."""
    row = lambda key, label, reason=None: F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), (F.lit(None).cast("string") if reason is None else humanized(reason)).alias("reason"))
    return (
        F.when(status == "completed", row("customer_completed", "Customer"))
        .when((status == "skipped") & drop.eqNullSafe(F.lit("classified_non_customer")), row("non_customer", "Non-customer"))
        .when(status == "skipped", row("filtered", "Filtered", drop))
        .when((status == "held") & held.eqNullSafe(F.lit("classified_spam")), row("spam", "Spam"))
        .when(status == "held", row("held", "Held", held))
        .when(status == "review_closed", row("review_closed", "Review closed", held))
        .otherwise(row("processing", "Processing"))
    )


def outcome_filter(name: str | None, status: Column, drop: Column, held: Column) -> Column:
    """The predicate of a named outcome preset; unknown names filter nothing."""
    differs = lambda x, v: ~x.eqNullSafe(F.lit(v))
    return {
        "customer": status == "completed",
        "non_customer": (status == "skipped") & (drop == "classified_non_customer"),
        "spam": held == "classified_spam",
        "filtered": (status == "skipped") & differs(drop, "classified_non_customer"),
        "held": (status == "held") & differs(held, "classified_spam"),
        "processing": status == "processing",
    }.get(name or "", F.lit(True))


def prefilter(duration: Column, state: Column, internal: Column, operator_call: Column, direction: Column, call_id: Column, silent_states: Iterable[str], least_ms: float = 0) -> Column:
    """The first drop reason that applies, in order, or null. Anything missing passes."""
    short = (duration <= least_ms) if least_ms > 0 else F.lit(False)
    return (
        F.when(duration <= 0, "zero_duration")
        .when(F.lower(state).isin(*silent_states), "non_conversation_call_state")
        .when(short, "below_minimum_duration")
        .when(internal & (operator_call != call_id), "internal_transfer_non_operator_leg")
        .when(internal & (F.lower(direction) == "outbound"), "outbound_no_customer_conversation")
    )


def dedup_key(code: Column, scopes: dict[str, Column]) -> Column:
    """code:scope:value of the first scope present, or code:global."""
    return F.coalesce(*(F.when(scopes[s].isNotNull(), F.concat_ws(":", code, F.lit(s), scopes[s].cast("string"))) for s in V.DEDUP_SCOPES if s in scopes), F.concat(code, F.lit(":global")))


def backoff(base_seconds: float, attempts: Column) -> Column:
    return F.lit(float(base_seconds)) * F.pow(F.lit(2.0), F.least(attempts, F.lit(20)))


def tristate(x: Column) -> Column:
    """yes/no as booleans, anything else null."""
    return F.when(x == "yes", True).when(x == "no", False)


def unset_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def is_fresh(ts: Column, now: Column, skew_seconds: int) -> Column:
    return F.abs(F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(now.cast("timestamp"))) <= skew_seconds


def csv_cell(x: Column) -> Column:
    """One CSV cell: formulas disarmed with an apostrophe, quoted where the format asks for it; null is empty."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^(?:[\t\r\n]| *[=+\-@])"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def csv_row(cells: Iterable[Column]) -> Column:
    return F.concat_ws(",", *(csv_cell(c) for c in cells))


def rank_in(values: Iterable[str], x: Column) -> Column:
    """Place of x in a declared order (vocabularies sort so, not by spelling)."""
    return F.array_position(F.array(*(F.lit(v) for v in values)), x)


def risk_score(reasons: Column) -> Column:
    """min(1, sum of the weights of distinct reasons), rounded to four places."""
    weights = F.create_map(*(F.lit(x) for r, (w, *_) in V.RISK.items() for x in (r, w)))
    total = F.aggregate(F.array_distinct(reasons), F.lit(0.0), lambda a, r: a + F.coalesce(weights[r], F.lit(0.0)))
    return F.round(F.least(F.lit(1.0), total), 4)


def risk_forced(reasons: Column) -> Column:
    return F.arrays_overlap(reasons, F.array(*(F.lit(r) for r, (_, forced, _) in V.RISK.items() if forced)))


def risk_safe(reasons: Column) -> Column:
    return F.forall(reasons, lambda r: r.isin([x for x, (*_, safe) in V.RISK.items() if safe]))


def urgency_rule(urgency: Column, intent: Column, text: Column) -> Column:
    """Urgency after the keyword rule: emergencies win, ambiguous phrases lift by one level.

    A text that lacks the longest word of every phrase holds none of them: only the others are normalised and searched.
    """
    low, plain = F.lower(text), normal_light(text)
    longest = lambda phrases: sorted({max(p.replace("'", " ").split(), key=len) for p in phrases})
    stems = lambda phrases: [w for w in longest(phrases) if not any(x != w and x in w for x in longest(phrases))]
    any_stem = lambda phrases: reduce(lambda a, b: a | b, (low.contains(w) for w in stems(phrases)))
    any_of = lambda phrases: any_stem(phrases) & plain.rlike("(?:^|\\W)(?:" + "|".join(phrases) + ")(?:$|\\W)")
    up = F.when(urgency == "routine", "urgent").when(urgency == "urgent", "emergency").otherwise(urgency)
    fired = (urgency == "emergency") | (intent == "emergency") | any_of(V.EMERGENCY_PHRASES)
    return F.when(fired, "emergency").when(any_of(V.AMBIGUOUS_PHRASES), up).otherwise(urgency)


def without_tokens(phrases: Column) -> Column:
    """Phrases that hold no redaction token."""
    return F.filter(phrases, lambda p: ~p.rlike(r"\[[A-Z_]+_[0-9]+\]"))


def severity_of(code: Column) -> Column:
    """The usual severity of a failure code; one that the catalogue lacks raises."""
    known = F.create_map(*(F.lit(x) for pair in V.FAILURES.items() for x in pair))
    return F.when(code.isNotNull(), F.coalesce(known[code], F.raise_error(F.concat(F.lit("no such failure code: "), code))))
