"""Pages of parsed documents: which source gives a page's blocks, where headers and footers go, and how they are split."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page_blocks(layout: DataFrame, listed: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, place, type, text, origin of the blocks of each page: those of layout where it has the page, else those of the content
    list. layout and listed have doc_id, page, place, type, text; pages(doc_id, n_pages) says which pages there are. A block of a page that
    there isn't, or of none, has origin quarantined; it isn't dropped."""
    has = layout.select("doc_id", "page").distinct().withColumn("has", F.lit(True))
    first = layout.withColumn("origin", F.lit("layout"))
    second = listed.join(has, ["doc_id", "page"], "left").where("has is null").drop("has").withColumn("origin", F.lit("list"))
    both = first.unionByName(second).join(pages, "doc_id", "left")
    there = F.coalesce((F.col("page") >= 1) & (F.col("page") <= F.col("n_pages")), F.lit(False))
    return both.select("doc_id", "page", "place", "type", "text", F.when(there, F.col("origin")).otherwise("quarantined").alias("origin"))


def layout_findings(layout: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """doc_id, repeated (places that several blocks have), unknown (blocks of types that aren't known), blank pages' count."""
    per = layout.groupBy("doc_id", "page", "place").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("type").isin(*known)).alias("unknown"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("said"))
    page = per.groupBy("doc_id", "page").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.sum("unknown").alias("unknown"), F.sum("said").alias("said"))
    return page.groupBy("doc_id").agg(F.sum("repeated").alias("repeated"), F.sum("unknown").alias("unknown"), F.count_if(F.col("said") == 0).alias("blank_pages"))


def with_margins_in_order(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, page, place, type, y0, y1, ...) with reading_place: a page's header first and its footer last, if there is one of the
    kind only and no other block of the page lies beyond it; else all stay where they are."""
    page = Window.partitionBy("doc_id", "page")
    body = ~F.col("type").isin("header", "footer")
    rows = blocks.withColumns({
        "headers": F.count_if(F.col("type") == "header").over(page), "footers": F.count_if(F.col("type") == "footer").over(page),
        "top": F.min(F.when(body, F.col("y0"))).over(page), "bottom": F.max(F.when(body, F.col("y1"))).over(page),
    })
    up = (F.col("type") == "header") & (F.col("headers") == 1) & (F.col("y1") <= F.coalesce("top", F.col("y1")))
    down = (F.col("type") == "footer") & (F.col("footers") == 1) & (F.col("y0") >= F.coalesce("bottom", F.col("y0")))
    order = F.row_number().over(page.orderBy(F.when(up, 0).when(down, 2).otherwise(1), "place"))
    return rows.withColumn("reading_place", order).drop("headers", "footers", "top", "bottom")


# Pages, bytes and parts of a split.
PAGES, BYTES, PARTS = 180, 200_000_000, 128


def split_plan(pages: DataFrame, most_pages: int = PAGES, most_bytes: int = BYTES, most_parts: int = PARTS) -> DataFrame:
    """doc_id, part (from 1), first, last, bytes, reason of pages(doc_id, page, bytes), numbered from 1: each part takes as many pages as fit both
    limits. reason is null, or for all parts of a document why it can't be split: a page over the limit, too many parts, or pages that
    aren't numbered from 1 without gaps, or have no size above 0.

    Pages of a document pass by in order; of a part only its sums are held, and of a document most_parts parts at most."""
    kind = pages.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts, reason, out, doc_type = object(), [], None, [], None

        def close() -> None:
            why = reason or ("too many parts" if len(parts) > most_parts else None)
            out.extend((last, i, *p, why) for i, p in enumerate(parts[: most_parts if why is None else 1], 1))

        def table() -> pa.RecordBatch:
            of = list(zip(*out)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(of, (doc_type, pa.int32(), *[pa.int64()] * 3, pa.string()))], ["doc_id", "part", "first", "last", "bytes", "reason"])

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for doc, page, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "bytes"))):
                if doc != last:
                    if parts:
                        close()
                    last, parts, reason, due = doc, [], None, 1
                if page != due or n is None or n <= 0:
                    reason = reason or "pages out of order"
                elif n > most_bytes:
                    reason = reason or "a page is too large"
                due = (page or 0) + 1
                if parts and len(parts) <= most_parts and parts[-1][1] - parts[-1][0] + 1 < most_pages and parts[-1][2] + (n or 0) <= most_bytes:
                    parts[-1] = (parts[-1][0], page, parts[-1][2] + (n or 0))
                elif len(parts) <= most_parts:
                    parts.append((page, page, n or 0))
            if len(out) > 8192:
                yield table()
                out.clear()
        if parts:
            close()
        if doc_type is not None:
            yield table()

    rows = pages.select("doc_id", F.col("page").cast("long").alias("page"), F.col("bytes").cast("long").alias("bytes"))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "page").mapInArrow(run, f"doc_id {kind}, part int, first long, last long, bytes long, reason string")
