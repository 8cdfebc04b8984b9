"""Readers. Each gives a DataFrame with a declared schema; nothing is inferred."""

from __future__ import annotations

import base64
import hashlib
import hmac
import itertools
import json
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, GreaterThan, InputPartition

from ..scratch import kept

TRANSCRIPT = "struct<call_id:string,status:string,state:string,lines:array<struct<content:string,type:string,name:string>>,transcript:string>"


def term_lines(spark: SparkSession, path: str) -> DataFrame:
    """(term): the lines of a list, trimmed, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#"))


def transcript_text(raw: Column) -> Column:
    """The text of a transcript payload: `name: content` a line without moments, else the flat transcript, else the payload itself."""
    node = F.from_json(raw, TRANSCRIPT)
    said = F.filter(node["lines"], lambda x: ~x["type"].eqNullSafe(F.lit("moment")) & x["content"].isNotNull())
    text = F.array_join(F.transform(said, lambda x: F.concat_ws(": ", x["name"], x["content"])), "\n")
    return F.coalesce(F.when(F.size(said) > 0, text), node["transcript"], raw)


def transcript_state(raw: Column) -> Column:
    """ready, not_ready or error, by the shape of the payload."""
    node = F.from_json(raw, TRANSCRIPT)
    waiting = F.lower(F.coalesce(node["status"], node["state"])).isin("pending", "processing", "not_ready")
    return F.when(node.isNull() | F.try_parse_json(raw).isNull(), "error").when(waiting, "not_ready").when((F.size(node["lines"]) > 0) | (node["transcript"] != ""), "ready").otherwise("not_ready")


def fixture(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(calls, transcripts) of JSON fixture files; lines: a fixture a line."""
    schema = "calls array<struct<callId:string,startedAt:double,endedAt:double,state:string,direction:string,duration:double>>, transcripts map<string,string>"
    whole = spark.read.schema(schema).json(path, multiLine=not lines)
    return whole.select(F.inline("calls")), whole.select(F.explode("transcripts").alias("call_id", "text"))


def verified_claims(token: Column, secrets: list[bytes]) -> Column:
    """The claims (JSON text) of an HS256 token that one of the secrets has signed, else null."""
    def one(t: str | None) -> str | None:
        try:
            head, body, sign = (t or "").split(".")
            pad = lambda x: base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))
            if json.loads(pad(head)).get("alg") != "HS256":
                return None
            given = pad(sign)
            good = any(hmac.compare_digest(given, hmac.new(s, f"{head}.{body}".encode(), hashlib.sha256).digest()) for s in secrets)
            return json.dumps(json.loads(pad(body)), sort_keys=True) if good else None
        except (ValueError, AttributeError):
            return None

    @F.pandas_udf("string")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(one)

    return run(token)


def landed_pages(spark: SparkSession, path: str, started_after: float | None = None) -> DataFrame:
    """(call_id, started_at, state) of a landed call listing: JSON lines of page, cursor of the next page, and items.

    A cursor that leads to its own page, or that two pages give, does not advance: ValueError.
    """
    pages = spark.read.schema("page string, cursor string, items array<struct<call_id:string,started_at:double,state:string>>").json(path)
    stuck = pages.filter("cursor IS NOT NULL").groupBy("cursor").agg(F.count("*").alias("n"), F.bool_or(F.col("page") == F.col("cursor")).alias("own"))
    if not stuck.filter("n > 1 OR own").isEmpty():
        raise ValueError("a cursor does not advance")
    items = pages.select(F.inline("items"))
    return items if started_after is None else items.filter(F.col("started_at") > started_after)


def land_listing(calls: DataFrame, path: str, page_items: int = 1000) -> None:
    """Land (call_id, started_at, state) as a cursor-paged listing that `PagedCalls` reads, oldest calls first.

    items/: a line of JSON a page, in a folder of the page's cursor. pages/: of each page its cursor, the next page's, and
    the latest start in it. Calls are dealt by range of their start, so no page and no task grows with the table.
    """
    spark = calls.sparkSession
    total = calls.count()
    n = max(1, -(-total // page_items))
    ranged = calls.repartitionByRange(min(n, 2 * spark.sparkContext.defaultParallelism), "started_at", "call_id").sortWithinPartitions("started_at", "call_id")

    def paged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held, k = TaskContext.get().partitionId(), pd.DataFrame(), 0
        for f in itertools.chain(frames, [None]):
            held = held if f is None else pd.concat([held, f])
            while len(held) >= page_items or (f is None and len(held)):
                page, held = held.iloc[:page_items], held.iloc[page_items:]
                items = [{"call_id": str(i), "started_at": float(at), "state": state} for i, at, state in zip(page["call_id"], page["started_at"], page["state"])]
                yield pd.DataFrame({"part": [part], "k": [k], "latest": [float(page["started_at"].max())], "value": [json.dumps({"items": items})]})
                k += 1

    pages = kept(ranged.select(F.col("call_id").cast("string"), F.col("started_at").cast("double"), "state").mapInPandas(paged, "part int, k int, latest double, value string"), "listing-pages")
    cursor = F.concat(F.lit("c"), F.col("part").cast("string"), F.lit("-"), F.col("k").cast("string"))
    # a row a page: what one task sorts here is a thousandth of the calls
    after = F.lead("cursor").over(Window.orderBy("part", "k"))
    chain = pages.select("part", "k", cursor.alias("cursor"), "latest").withColumn("after", after).withColumn("first", (F.col("part") == F.min("part").over(Window.partitionBy())) & (F.col("k") == 0))
    pages.select(cursor.alias("cursor"), "value").write.partitionBy("cursor").text(f"{path}/items")
    chain.select("cursor", "after", "latest", "first").coalesce(1).write.json(f"{path}/pages")


class _Page(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


def _lines(folder: str) -> Iterator[dict]:
    """The JSON lines of a folder that Spark has written, in any store that Arrow reads."""
    store, at = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    for f in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda f: f.path):
        if f.base_name.startswith("part-") and f.size:
            with store.open_input_stream(f.path) as lines:
                yield from (json.loads(x) for x in lines.read().decode().splitlines() if x)


class _PagedReader(DataSourceReader):
    """Follows the cursor chain on the driver (a row a page), leaves out pages before the bound, reads the others in tasks."""

    def __init__(self, options: dict):
        self.folder, self.since = options["path"].rstrip("/"), float(options.get("started_after", "-inf"))

    def pushFilters(self, filters: list) -> Iterator:
        """A lower bound on started_at is the listing's own parameter; all other filters stay with Spark."""
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("started_at",) and f.value is not None:
                self.since = max(self.since, float(f.value))
            else:
                yield f

    def partitions(self) -> list[_Page]:
        rows = {r["cursor"]: r for r in _lines(f"{self.folder}/pages")}
        cursor, seen, wanted = next((c for c, r in rows.items() if r["first"]), None), set(), []
        while cursor:
            if cursor in seen:
                raise ValueError(f"the cursor {cursor} does not advance")
            seen.add(cursor)
            if rows[cursor]["latest"] > self.since:
                wanted.append(_Page(f"{self.folder}/items/cursor={cursor}"))
            cursor = rows[cursor].get("after")
        return wanted

    def read(self, partition: _Page) -> Iterator[tuple]:
        for page in _lines(partition.folder) if partition is not None else ():
            for row in page["items"]:
                if row["started_at"] > self.since:
                    yield (str(row["call_id"]), float(row["started_at"]), row.get("state"))


class PagedCalls(DataSource):
    """A landed, cursor-paged call listing (`land_listing`). A filter `started_at > x`, or the option started_after, skips pages."""

    @classmethod
    def name(cls) -> str:
        return "paged_calls"

    def schema(self) -> str:
        return "call_id string, started_at double, state string"

    def reader(self, schema) -> _PagedReader:
        return _PagedReader(self.options)


def paged_calls(spark: SparkSession, path: str) -> DataFrame:
    """The listing, with filters pushed to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedCalls)
    return spark.read.format("paged_calls").option("path", path).load()
