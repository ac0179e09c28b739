"""What a page break or a second parser has taken apart, put together again as rows: paragraphs, tables, blocks of two parsers.

Chains are found by windows over a document's items in order, islands between items that end them; only a chain's few texts meet in one
row, where a merged text is cut along an offset map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Characters that markup escapes, kinds of items that a paragraph may go on behind, and how many of them and of its parts.
ESCAPED = frozenset("\\`*_{}[]()#+-.!$<>|")
GAPS = ("header", "footer", "page_number", "image", "chart", "table", "code", "aside_text", "page_footnote")
MOST = 64
#: Texts that are Python's strings at once.
TEXTS = 256


def offset_map(raw: str) -> tuple[str, np.ndarray]:
    """raw without the backslashes that escape a character, and where each character of that, and its end, stands in raw."""
    keep, skip = np.ones(len(raw), bool), -1
    at = raw.find("\\")
    while 0 <= at < len(raw) - 1:
        if at != skip and raw[at + 1] in ESCAPED:
            keep[at], skip = False, at + 1
        at = raw.find("\\", at + 1)
    places = np.flatnonzero(keep)
    return "".join(raw[i] for i in places) if len(places) < len(raw) else raw, np.append(places, len(raw))


def slices(raw: str, parts: list[str], hyphens: bool = False) -> list[str] | None:
    """raw cut into one slice for each part, which cover it: the part's text, escapes apart, and the white space around it. With hyphens, a part
    may have lost a hyphen at its end between two ASCII letters, where the next goes on at once. None if raw isn't made of the parts."""
    plain, places = offset_map(raw)
    wanted = [offset_map(p.strip())[0] for p in parts]
    if not wanted or not all(wanted):
        return None

    def space(at: int) -> int:
        while at < len(plain) and plain[at].isspace():
            at += 1
        return at

    letter = lambda c: c.isascii() and c.isalpha()
    at, cuts = 0, [0]
    for i, part in enumerate(wanted):
        at = space(at)
        if not plain.startswith(part, at):
            after = wanted[i + 1] if i + 1 < len(wanted) else ""
            whole = part[:-1]
            broken = hyphens and part.endswith("-") and after and letter(after[0]) and whole and letter(whole[-1])
            if not broken or not plain.startswith(whole + after[0], at):
                return None
            part = whole
        at = space(at + len(part))
        cuts.append(int(places[at - 1]) + 1)  # behind the character before, so an escape goes with the next
    # A backslash that the map took for an escape is one that raw has at least as often as the part.
    found = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
    return found if at == len(plain) and all(f.count("\\") >= p.count("\\") for f, p in zip(found, parts)) else None


@F.arrow_udf(ArrayType(StringType()))
def merged_slices(texts: pa.Array, parts: pa.Array) -> pa.Array:
    """slices() with hyphens, of texts that are merged from parts; null where it has none. A batch stays in Arrow but for TEXTS of it."""
    out = [pa.array([], pa.list_(pa.string()))]
    for first in range(0, len(texts), TEXTS):
        rows = zip(texts.slice(first, TEXTS).to_pylist(), parts.slice(first, TEXTS).to_pylist())
        out.append(pa.array([None if t is None or p is None or None in p else slices(t, p, True) for t, p in rows], out[0].type))
    return pa.concat_arrays(out)


def restored_paragraphs(items: DataFrame) -> DataFrame:
    """items(doc_id, place, page, type, text, deleted, source) with restored and reason: the text of paragraphs that were merged into their
    first part, given back to the parts.

    A part is a text item without text whose layout says that its lines were deleted; source is what the layout had there before, and for a first
    part what it had itself. Parts belong to the last item before them that isn't a part or of a kind that may lie between; that must
    be a text, and its text the sources of all, in order, cut by slices(). reason is null for what needs nothing or is restored, else for all of
    a chain: no target, target without text, too many parts, too many between, pages out of order, or text differs; their texts stay as
    they are. Places are different within a document."""
    order = Window.partitionBy("doc_id").orderBy("place")
    blank = F.coalesce("text", F.lit("")) == ""
    part = (F.col("type") == "text") & blank & F.coalesce("deleted", F.lit(False))
    gap = F.col("type").isin(*GAPS)
    rows = items.withColumn("_part", part).withColumn("_chain", F.sum((~part & ~gap).cast("int")).over(order))
    chain = Window.partitionBy("doc_id", "_chain")
    upto = chain.orderBy("place")
    # Items between: those with a part of the chain after them.
    last = F.max(F.when(F.col("_part"), F.col("place"))).over(chain)
    rows = rows.withColumn("_between", gap & (F.col("place") < last)).withColumn("_member", F.col("_part") | (~gap & (F.row_number().over(upto) == 1) & (F.col("_chain") > 0)))
    first = rows.where("_member").groupBy("doc_id", "_chain").agg(
        F.count_if("_part").alias("_parts"), F.min_by(F.struct("type", "text", "page", "_part"), "place").alias("_t"),
        F.min("page").alias("_low"), F.count_if(F.col("_part") & F.col("page").isNull()).alias("_lost"),
    ).where("_parts > 0")
    between = rows.where("_between").groupBy("doc_id", "_chain").agg(F.count(F.lit(1)).alias("_n"))
    said = F.trim(F.regexp_replace(F.coalesce("_t.text", F.lit("")), r"\s", " ")) != ""
    why = F.when(F.col("_t._part") | (F.col("_chain") == 0), "no target").when((F.col("_t.type") != "text") | ~said, "target without text").when(F.col("_parts") > MOST, "too many parts").when(F.coalesce("_n", F.lit(0)) > MOST, "too many between").when((F.col("_lost") > 0) | (F.col("_low") < F.col("_t.page")), "pages out of order")
    first = first.join(between, ["doc_id", "_chain"], "left").select("doc_id", "_chain", F.col("_t.text").alias("_merged"), why.alias("_why"))
    # MOST parts and the first meet in one row, of sound chains only.
    sound = rows.where("_member").join(first.where("_why is null"), ["doc_id", "_chain"])
    cut = sound.groupBy("doc_id", "_chain").agg(F.first("_merged").alias("_merged"), F.array_sort(F.collect_list(F.struct("place", "source"))).alias("_x"))
    cut = cut.select("doc_id", "_chain", F.transform("_x", lambda x: x["place"]).alias("_places"), merged_slices("_merged", F.transform("_x", lambda x: x["source"])).alias("_texts"))
    texts = cut.where("_texts is not null").select("doc_id", F.explode(F.arrays_zip("_places", "_texts")).alias("z")).select("doc_id", F.col("z._places").alias("place"), F.col("z._texts").alias("_text"))
    bad = first.join(cut.where("_texts is null").select("doc_id", "_chain", F.lit("text differs").alias("_other")), ["doc_id", "_chain"], "left").select("doc_id", "_chain", F.coalesce("_why", "_other").alias("_reason")).where("_reason is not null")
    out = rows.join(texts, ["doc_id", "place"], "left").join(bad, ["doc_id", "_chain"], "left")
    return out.select(*items.columns, F.coalesce("_text", "text").alias("restored"), F.when(F.col("_member"), F.col("_reason")).alias("reason"))


def continued_tables(cells: DataFrame) -> DataFrame:
    """doc_id, place, page, chain, row_offset, dropped of the tables of cells(doc_id, place, page, first, last, row, col, span, text): which tables go
    on from the page before, and where their rows are in the whole.

    first and last say whether a table is its page's first or last item. A table goes on if it is the first of its page, the one before it in the
    document the last of the page before, and both have the same grid: the same columns begin and end in their rows. Its first row is dropped if
    it repeats that of the chain's first table, cell by cell; row_offset is added to the numbers (from 0) of the other rows. chain is the place of
    the first table. Rows are numbered from 0 without gaps; a table without cells isn't here."""
    text = F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " ")
    cell = F.struct("col", "span", text.alias("text"))
    head = F.array_sort(F.collect_list(F.when(F.col("row") == 0, cell)))
    per = cells.groupBy("doc_id", "place").agg(F.first("page").alias("page"), F.bool_or("first").alias("first"), F.bool_or("last").alias("last"), (F.max("row") + 1).alias("rows"), F.array_sort(F.collect_set(F.struct("col", "span"))).alias("grid"), F.sha2(F.to_json(head), 256).alias("head"))
    order = Window.partitionBy("doc_id").orderBy("place")
    before = lambda c: F.lag(c).over(order)
    goes_on = F.col("first") & before("last") & (before("page") + 1 == F.col("page")) & (before("grid") == F.col("grid"))
    rows = per.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_chain", F.sum("_new").over(order))
    inside = Window.partitionBy("doc_id", "_chain").orderBy("place")
    lead = F.first(F.struct("place", "head")).over(inside)
    rows = rows.withColumn("_lead", lead).withColumn("dropped", ((F.col("_new") == 0) & (F.col("head") == F.col("_lead.head"))).cast("int"))
    ahead = F.coalesce(F.sum(F.col("rows") - F.col("dropped")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("doc_id", "place", "page", F.col("_lead.place").alias("chain"), (ahead - F.col("dropped")).cast("int").alias("row_offset"), "dropped")


def ordered_union(native: DataFrame, other: DataFrame) -> DataFrame:
    """doc_id, sheet, origin, place, anchor, place_in_sheet, conflict of native(doc_id, sheet, place, anchor, text) and other (the same columns): one
    order of the blocks of two parsers.

    Each block of other comes after the native block of its sheet with the nearest anchor (a row) at or above its own, before all where there is
    none; native blocks keep the order of their places, and others behind one block that of their anchors, then places. A block whose sheet has
    no native block is unplaced: place_in_sheet is null, conflict no sheet. One without an anchor comes last, conflict no anchor. One that
    says the same, white space apart, as the native block it is put behind is kept apart, conflict same text."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "")
    both = native.select("doc_id", "sheet", F.lit("native").alias("origin"), "place", "anchor", bare.alias("_text")).unionByName(other.select("doc_id", "sheet", F.lit("other").alias("origin"), "place", "anchor", bare.alias("_text")))
    is_native = F.col("origin") == "native"
    sheet = Window.partitionBy("doc_id", "sheet")
    # The nearest native block: of several with one anchor the last.
    as_of = sheet.orderBy(F.col("anchor").asc_nulls_last(), F.when(is_native, 0).otherwise(1), "place")
    rows = both.withColumn("_behind", F.last(F.when(is_native, F.struct("place", "_text")), ignorenulls=True).over(as_of)).withColumn("_some", F.count_if(is_native).over(sheet) > 0)
    at = F.when(is_native, F.col("place")).when(F.col("anchor").isNotNull(), F.col("_behind.place"))
    order = F.struct(F.when(is_native | F.col("anchor").isNotNull(), 0).otherwise(1).alias("a"), F.coalesce(at, F.lit(-1)).alias("b"), F.when(is_native, 0).otherwise(1).alias("c"), F.when(is_native, F.lit(None)).otherwise(F.col("anchor")).alias("d"), F.col("place").alias("e"))
    conflict = F.when(is_native, None).when(~F.col("_some"), "no sheet").when(F.col("anchor").isNull(), "no anchor").when((F.col("_text") != "") & (F.col("_text") == F.col("_behind._text")), "same text")
    return rows.withColumn("_at", F.row_number().over(sheet.orderBy(order))).select("doc_id", "sheet", "origin", "place", "anchor", F.when(F.col("_some"), F.col("_at")).alias("place_in_sheet"), conflict.alias("conflict"))
