"""Document analytics: profile, complexity, quality, outline, routing, geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points of the complexity factors from their thresholds, and the states a document moves through.
FACTORS = {"pages": ((200, 25), (50, 15), (10, 5)), "tables": ((20, 20), (1, 8)), "formulas": ((10, 15), (1, 5)), "images": ((5, 10), (1, 3)), "columns": ((1, 15),), "chars": ((1_000_000, 15), (100_000, 8))}
TRANSITIONS = (
    ("UPLOADED", "PARSING"), ("PARSING", "OCR_PROCESSING"), ("PARSING", "CHUNKING"), ("OCR_PROCESSING", "CHUNKING"), ("CHUNKING", "EMBEDDING"), ("EMBEDDING", "INDEXING"),
    ("INDEXING", "READY"), ("INDEXING", "PARTIAL_READY"), ("UPLOADED", "FAILED"), ("PARSING", "FAILED"), ("OCR_PROCESSING", "FAILED"), ("CHUNKING", "FAILED"), ("EMBEDDING", "FAILED"), ("INDEXING", "FAILED"), ("FAILED", "UPLOADED"),
)


def profile(blocks: DataFrame) -> DataFrame:
    """One row for each doc_id of blocks(doc_id, block_index, page, block_type, text, confidence): counts, pages, characters, page
    regressions in block order, low confidences, replacement characters."""
    before = F.lag("page").over(Window.partitionBy("doc_id").orderBy("block_index"))
    rows = blocks.withColumn("back", F.col("page") < before)
    kind = lambda k: F.count_if(F.col("block_type") == k)
    return rows.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"), F.count_distinct("page").alias("pages"), F.sum(F.length("text")).alias("chars"),
        kind("table").alias("tables"), kind("formula").alias("formulas"), kind("image_text").alias("images"),
        F.count_if(F.col("block_index").isNull()).alias("order_unknown"), F.count_if(F.col("back")).alias("regressions"),
        F.count_if(F.col("confidence") < 0.6).alias("low_confidence"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("�"), F.lit("")))).alias("replacements"),
    )


def complexity(profiles: DataFrame) -> DataFrame:
    """profiles with score and level (low, medium from 20, high from 50); a factor whose column is missing scores 0."""
    score = F.lit(0)
    for name, steps in FACTORS.items():
        if name in profiles.columns:
            points = F.lit(0)
            for least, p in reversed(steps):
                points = F.when(F.col(name) >= least, p).otherwise(points)
            score = score + points
    out = profiles.withColumn("score", F.least(F.lit(100), score))
    return out.withColumn("level", F.when(F.col("score") >= 50, "high").when(F.col("score") >= 20, "medium").otherwise("low"))


def findings(profiles: DataFrame) -> DataFrame:
    """profiles with findings (codes in order) and status by their worst severity."""
    rules = (("BLOCK_ORDER_UNKNOWN", F.col("order_unknown") > 0), ("PAGE_ORDER_REGRESSION", F.col("regressions") > 0), ("LOW_REPORTED_CONFIDENCE", F.col("low_confidence") > 0), ("REPLACEMENT_CHARACTER", F.col("replacements") > 0))
    codes = F.array_compact(F.array(*[F.when(rule, code) for code, rule in rules], F.when(F.col("blocks") == 0, "NO_BLOCKS")))
    out = profiles.withColumn("findings", codes)
    return out.withColumn("status", F.when(F.array_contains("findings", "NO_BLOCKS"), "attention").when(F.size("findings") > 0, "review").otherwise("no_observed_issue"))


def missing_pages(declared: Column, required: Column, covered: Column) -> Column:
    return F.array_sort(F.array_union(declared, F.array_except(required, covered)))


def outline_parents(headings: DataFrame) -> DataFrame:
    """parent of each row of headings(doc_id, place, level): the nearest earlier place of a lower level. One running maximum for each
    of the six levels in one window."""
    w = Window.partitionBy("doc_id").orderBy("place")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == n, F.col("place")), ignorenulls=True).over(before) for n in range(1, 7)]
    rows = headings.withColumns({f"_l{n}": c for n, c in enumerate(last, 1)})
    parent = F.array_max(F.array(*[F.when(F.col("level") > n, F.col(f"_l{n}")) for n in range(1, 7)]))
    return rows.withColumn("parent", parent).drop(*[f"_l{n}" for n in range(1, 7)])


def section_paths(headings: DataFrame, separator: str = " / ") -> DataFrame:
    """path of each row of headings(doc_id, place, level, title): its title behind those of the open headings above. A heading of a level
    stays open until one of that level or a lower one follows, so what counts is the last of each level, if no lower one came since."""
    w = Window.partitionBy("doc_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of = lambda rule, value: F.last(F.when(rule, value), ignorenulls=True).over(w)
    rows = headings.withColumns({f"_t{n}": of(F.col("level") == n, F.struct("place", "title")) for n in range(1, 7)} | {f"_b{n}": of(F.col("level") < n, F.col("place")) for n in range(2, 7)})
    open_ = [F.when((F.col("level") >= n) & (F.col(f"_t{n}.place") > F.coalesce(F.col(f"_b{n}") if n > 1 else F.lit(None).cast("int"), F.lit(-1))), F.col(f"_t{n}.title")) for n in range(1, 7)]
    return rows.withColumn("path", F.concat_ws(separator, *open_)).drop(*[f"_t{n}" for n in range(1, 7)], *[f"_b{n}" for n in range(2, 7)])


# Formats by how they are parsed, names of routes, reasons and risks.
_VISUAL, _OFFICE = ("doc", "ppt", "pptx", "xls", "jpg", "jpeg", "png"), ("doc", "docx", "ppt", "pptx", "xls", "xlsx")
_CLOUD = (*_VISUAL, "pdf", "docx", "xlsx")


def route(kind: Column, mode: Column, risks: Column, uncertain: Column | None = None, snapshots: Column | None = None, hybrid: bool = True) -> Column:
    """struct strategy, reasons: how a file is parsed (native, mineru_whole, hybrid_bundle or failed) and why, by its format, the mode asked
    for (auto, native, mineru), the names of what an inspection found that native parsing may lose, whether that is uncertain, and how many
    saved snapshots of outside data a workbook has."""
    nothing = F.array().cast("array<string>")
    unsure = F.lit(False) if uncertain is None else F.coalesce(uncertain, F.lit(True))
    found, snapshot = F.coalesce(risks, nothing), F.lit(False) if snapshots is None else F.coalesce(snapshots, F.lit(0)) > 0
    has, some = (lambda name: F.array_contains(found, name)), F.size(found) > 0
    first = lambda name: F.concat(F.array(name if isinstance(name, Column) else F.lit(name)), found)
    then = lambda name: F.concat(found, F.array(F.lit(name)))
    to = lambda strategy, reasons: F.struct((strategy if isinstance(strategy, Column) else F.lit(strategy)).alias("strategy"), F.array_distinct(reasons).alias("reasons"))
    sheet, cloud = kind == "xlsx", kind.isin(*_CLOUD)
    lost = has("XLSX_EXTERNAL_ASSET_MISSING") | has("XLSX_HAS_EXTERNAL_LINK") & ~snapshot
    rules = (
        (unsure, to("failed", F.when(some, found).otherwise(F.array(F.lit("PREFLIGHT_UNCERTAIN"))))),
        ((mode != "native") & has("EXTERNAL_ATTACHMENT_MISSING"), to("failed", found)),
        (sheet & (mode != "native") & lost, to("failed", then("XLSX_EXTERNAL_ASSET_MISSING"))),
        (mode == "native", to("native", first("EXPLICIT_NATIVE"))),
        (sheet & snapshot, to("mineru_whole", first(F.when(mode == "mineru", "EXPLICIT_MINERU").otherwise("XLSX_WHOLE_WITH_NATIVE_PRIMARY")))),
        ((mode == "mineru") & cloud, to("mineru_whole", first("EXPLICIT_MINERU"))),
        (mode == "mineru", to("failed", first("MINERU_UNSUPPORTED_FORMAT"))),
        (kind.isin(*_VISUAL), to("mineru_whole", first("VISUAL_OR_LEGACY_FORMAT"))),
        (sheet & some & F.lit(hybrid), to("hybrid_bundle", first("XLSX_HYBRID_ENABLED"))),
        (sheet & some, to("mineru_whole", then("XLSX_WHOLE_WITH_NATIVE_PRIMARY"))),
        ((kind == "md") & some, to("failed", found)),
        (kind.isin("docx", "pdf") & some, to("mineru_whole", found)),
    )
    out = to("native", then("NATIVE_COVERAGE_SUPPORTED"))
    for rule, value in reversed(rules):
        out = F.when(rule, value).otherwise(out)
    return out


def fallback(kind: Column, mode: Column, decided: Column, times: Column) -> Column:
    """The route after native parsing has been found incomplete: the whole file once, with the reason added; null where that isn't allowed, which
    is in all modes but auto, for other routes than native, formats that can only be parsed natively, and a second time."""
    allowed = (mode == "auto") & (decided["strategy"] == "native") & (F.coalesce(times, F.lit(0)) == 0) & kind.isin(*_CLOUD)
    return F.when(allowed, F.struct(F.lit("mineru_whole").alias("strategy"), F.concat(decided["reasons"], F.array(F.lit("NATIVE_COMPLETENESS_FALLBACK"))).alias("reasons")))


def guarded(decisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, reason, content, missing_pages, warnings: whether what was parsed of a document may be stored.

    decisions has doc_id, kind, mode, strategy, reasons, n_pages, required (pages that aren't empty), sheets (that aren't), snapshots, and parsed_kind
    and has_quality of the result; blocks has doc_id, page, text, source, section, bbox. reason is the first rule that is broken, else null;
    content is then COMPLETE or PARTIAL, missing_pages are the required ones without text, where the route lets them be missing. Blocks are folded
    to a row a document; a document's pages and sheets are held there, as many as it has."""
    said = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", " ")) != ""
    per = blocks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.when(said, F.col("page")))).alias("pages"), F.count("bbox").alias("boxes"),
        F.count_if(~F.col("source").eqNullSafe("native_parser")).alias("not_native"), F.count_if(~F.col("source").eqNullSafe("mineru_cloud")).alias("not_cloud"),
        F.count_if(F.coalesce("section", F.lit("")) == "").alias("unnamed"), F.count_distinct("section").alias("sections"),
    )
    both = decisions.join(per, "doc_id", "left")
    pages, native, whole = F.col("pages"), F.col("strategy") == "native", F.col("strategy") == "mineru_whole"
    required = F.coalesce("required", F.array().cast("array<int>"))
    missing = F.array_sort(F.array_except(required, pages))
    pdf, office = F.col("kind") == "pdf", F.col("kind").isin(*_OFFICE)
    most = F.array_max(pages)
    short = (F.size(missing) > 0) & (pdf | office & whole & F.col("n_pages").isNotNull())
    rules = (
        (~F.col("parsed_kind").eqNullSafe(F.col("kind")), "kind differs"),
        (F.coalesce(F.size(pages), F.lit(0)) <= 0, "no text"),
        (pdf & F.col("n_pages").isNull(), "no page count"),
        (pdf & (most > F.col("n_pages")), "page out of range"),
        (pdf & short & ~(whole & F.coalesce("has_quality", F.lit(False))), "pages missing"),
        (office & (F.col("boxes") > 0), "boxes of an office file"),
        (native & (F.col("mode") == "auto") & (F.col("reasons") != F.array(F.lit("NATIVE_COVERAGE_SUPPORTED"))), "structure not covered"),
        (native & (F.col("not_native") > 0), "source differs"),
        (native & ~pdf & (pages != F.array(F.lit(1))), "page isn't 1"),
        (native & (F.col("kind") == "xlsx") & ((F.col("n") != F.coalesce("sheets", F.lit(-1))) | (F.col("unnamed") > 0) | (F.col("sections") != F.col("n"))), "sheets differ"),
        (whole & (F.col("not_cloud") > 0), "source differs"),
        (whole & F.col("kind").isin("jpg", "jpeg", "png") & (pages != F.array(F.lit(1))), "page isn't 1"),
        (whole & office & (most > F.coalesce("n_pages", F.lit(200))), "page out of range"),
        (office & short & ~F.coalesce("has_quality", F.lit(False)), "pages missing"),
        (~native & ~whole, "route not allowed"),
        ((F.coalesce("snapshots", F.lit(0)) > 0) & ~F.col("kind").isin("docx", "xlsx", "pptx"), "snapshot of another format"),
    )
    reason = F.lit(None).cast("string")
    for rule, name in reversed(rules):
        reason = F.when(rule, name).otherwise(reason)
    saved = F.coalesce("snapshots", F.lit(0)) > 0
    warnings = F.concat(F.when(short, F.array(F.lit("MISSING_REQUIRED_PAGES"))).otherwise(F.array().cast("array<string>")), F.when(saved, F.array(F.lit("OFFICE_SAVED_SNAPSHOT"), F.lit("EXTERNAL_SOURCE_UNVERIFIED"))).otherwise(F.array().cast("array<string>")))
    out = both.select("doc_id", reason.alias("reason"), F.when(short | saved, "PARTIAL").otherwise("COMPLETE").alias("content"), F.when(short, missing).otherwise(F.array().cast("array<int>")).alias("missing_pages"), warnings.alias("warnings"))
    good = F.col("reason").isNull()
    return out.select("doc_id", "reason", *[F.when(good, F.col(c)).alias(c) for c in ("content", "missing_pages", "warnings")])


def invalid_transitions(events: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Steps of events whose state doesn't follow from the one before; staying is allowed."""
    legal = events.sparkSession.createDataFrame(list(TRANSITIONS), "_from string, _to string")
    steps = events.withColumn("_before", F.lag(state).over(Window.partitionBy(key).orderBy(*order))).where(F.col("_before").isNotNull() & (F.col("_before") != F.col(state)))
    return steps.join(F.broadcast(legal), (F.col("_before") == F.col("_from")) & (F.col(state) == F.col("_to")), "left_anti")
