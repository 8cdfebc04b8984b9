"""Request parameters and output guards: checked in Python before a plan is made."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from ..functions import spans as S
from ..functions import vocab as V
from .rows import day_bounds, search_filter

#: Longest free text, largest and default page.
TEXT_MOST, PAGE_MOST, PAGE_DEFAULT = 200, 200, 50


@dataclass(frozen=True)
class ListQuery:
    """A checked list query. Texts are trimmed, '' counts as unset, pages are clamped, anything unknown is an error."""

    service_category: str | None = None
    call_intent: str | None = None
    urgency: str | None = None
    start: str | None = None
    end: str | None = None
    text: str | None = None
    page: int = 1
    size: int = PAGE_DEFAULT

    @classmethod
    def parse(cls, given: Mapping[str, str], domains: Mapping[str, Iterable[str]] | None = None) -> ListQuery:
        domains = domains or {"service_category": V.SERVICE_CATEGORIES, "call_intent": V.CALL_INTENTS, "urgency": V.URGENCIES}
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        clean: dict = {k: v.strip() for k, v in given.items() if v is not None and v.strip()}
        for name, allowed in domains.items():
            if name in clean and clean[name] not in allowed:
                raise ValueError(f"{name} has no value {clean[name]!r}")
        if len(clean.get("text", "")) > TEXT_MOST:
            raise ValueError("the text is too long")
        for name, least, most in (("page", 1, 1 << 30), ("size", 1, PAGE_MOST)):
            if name in clean:
                clean[name] = min(most, max(least, int(clean[name])))
        day_bounds(clean.get("start"), clean.get("end"))
        if "text" in clean:
            gate(clean["text"])
        return cls(**clean)

    def where(self, **more) -> Column:
        equal = {k: getattr(self, k) for k in ("service_category", "call_intent", "urgency")}
        return search_filter(equal, start=self.start, end=self.end, text=self.text, **more)


def gate(text: str, deny: Iterable[str] = ()) -> str:
    """The text, if the scan finds no personal data in it."""
    found = S.residual(text, (), deny)
    if found:
        raise ValueError(f"the search text looks like personal data: {sorted(found)}")
    return text


#: Fixed value: keys that must not occur in outputs without content.
CONTENT_KEYS = ("transcript", "raw_transcript", "redacted_text", "plaintext", "phone", "email", "customer_name")


def without_content(df: DataFrame, forbidden: Iterable[str] = CONTENT_KEYS) -> DataFrame:
    """df, if no field of its schema at any depth has a forbidden name. A schema check: rows are not read."""
    bad = set(forbidden)

    def walk(kind: T.DataType) -> set[str]:
        if isinstance(kind, T.StructType):
            return {f.name for f in kind.fields} & bad | {x for f in kind.fields for x in walk(f.dataType)}
        if isinstance(kind, T.ArrayType):
            return walk(kind.elementType)
        return walk(kind.keyType) | walk(kind.valueType) if isinstance(kind, T.MapType) else set()

    if found := walk(df.schema):
        raise ValueError(f"fields with content: {sorted(found)}")
    return df
