"""Main text of web pages, without what a site repeats.

Pages are parsed once, where they are read: elements that HTML or their names
mark as something else go, an article or main element is preferred where there
is one, and what stays are text blocks with the hashes of the subtrees that
they come from.  Spark counts the hashes of a host over its different pages;
a subtree that recurs on many of them is the site's template and is deleted.

Paragraphs, headings and items inside an article or a main element are never
a template: documents of one site share passages.  Only whole containers are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import by_documents, written
from .markup import Page

#: A template's subtree is on at least so many of a host's different pages, and on this share of them.
LEAST_PAGES = 5
SHARE = 0.5
#: Pages whose blocks are handed on at once.
ROWS = 64

PARSED = "page_id bigint, url string, host string, page bigint, blocks array<string>, subtrees array<struct<hash: bigint, lo: int, hi: int>>"
_TYPE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.int64()), ("blocks", pa.list_(pa.string())), ("subtrees", pa.list_(pa.struct([("hash", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])))])


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next /, ? or #, in small letters; null without."""
    host = F.lower(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1))
    return F.when(host != "", host)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, len(batch), ROWS):
            part = batch.slice(i, ROWS)
            pages, keys = [], []
            for html in part.column(3):
                text = html.as_py() or ""
                pages.append(Page(text))
                keys.append(xxhash.xxh3_64_intdigest(text.encode(errors="replace")) - (1 << 63))
            subtrees = [[{"hash": h, "lo": lo, "hi": hi} for h, lo, hi in p.subtrees] for p in pages]
            columns = [part.column(0), part.column(1), part.column(2), pa.array(keys, pa.int64()), pa.array([p.blocks for p in pages], _TYPE.field("blocks").type), pa.array(subtrees, _TYPE.field("subtrees").type)]
            yield pa.record_batch(columns, schema=_TYPE)


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Blocks and subtrees of every page; null html is empty."""
    given = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    return by_documents(given).mapInArrow(_parse, PARSED)


def templates(blocks: DataFrame, share: float = SHARE, least: int = LEAST_PAGES) -> DataFrame:
    """(host, hash) of the subtrees on at least ``least`` and ``share`` of a host's different pages.

    Equal html counts once.  Counts and totals are summed before they are
    shuffled, so a host with a third of all pages is no task of its own; on
    one page of a host there are, by the share, at most 1 / share times as
    many templates as a page has subtrees.
    """
    different = blocks.where(F.col("host").isNotNull()).groupBy("host", "page").agg(F.first(F.array_distinct(F.col("subtrees.hash"))).alias("hashes"))
    totals = different.groupBy("host").agg(F.count("*").alias("pages"))
    counts = different.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return counts.join(totals, "host").where(F.col("n") >= share * F.col("pages")).select("host", "hash")


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_removed): the main text of every row of ``pages``.

    Blocks are joined by one line feed; n_removed counts blocks that were a
    template's.  Null or empty html gives an empty text; a null url has no
    host, so nothing recurs on it; rows with equal or null ids are pages of
    their own, as are repeated rows, which count once among a host's pages.
    Other columns are ignored; an empty table gives no rows.
    """
    table = written(parsed(pages, id_col, url_col, html_col)).withColumn("row", F.monotonically_increasing_id())
    open_rows = table.where(F.size("subtrees") > 0)
    found = open_rows.select("row", "host", F.explode(F.array_distinct(F.col("subtrees.hash"))).alias("hash"))
    hits = found.join(templates(table, share, least), ["host", "hash"]).groupBy("row").agg(F.collect_list("hash").alias("hits"))
    ranges = F.filter("subtrees", lambda s: F.array_contains("hits", s["hash"]))
    left = F.filter("blocks", lambda b, i: ~F.exists("ranges", lambda r: (r["lo"] <= i) & (i < r["hi"])))
    judged = open_rows.join(hits, "row", "left").withColumn("ranges", ranges).withColumn("left", F.when(F.col("hits").isNull(), F.col("blocks")).otherwise(left))
    kept = judged.select("page_id", "url", "blocks", "left").unionByName(table.where(F.size("subtrees") == 0).select("page_id", "url", "blocks", F.col("blocks").alias("left")))
    text = F.array_join("left", "\n")
    return kept.select("page_id", "url", text.alias("text"), F.length(text).cast("bigint").alias("n_chars"), (F.size("blocks") - F.size("left")).alias("n_removed"))
