"""Text, chunk, outline, quality, routing, formula and event queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formula as M
from ..functions import text as T
from ..operators import audit as A
from ..operators import binding as B
from ..operators import boxes as X
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import order as O
from ..operators import pages as P
from ..operators import restore as RS
from ..sources.readers import shared_folder
from ..streaming import events as S
from ..streaming import stages as G
from .registry import query


def _count():
    return F.count(F.lit(1))


@query("token_estimate", r"SELECT doc_id, CAST(coalesce(list_sum([(length(x) + 3) // 4 for x in regexp_extract_all(text, '[A-Za-z0-9_]+')]), 0) AS BIGINT) + length(regexp_replace(text, '[A-Za-z0-9_]+|\s', '', 'g')) AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query("script_language", "SELECT doc_id, CASE WHEN n < 24 THEN 'unknown' ELSE 'en' END AS language FROM (SELECT doc_id, length(regexp_replace(regexp_replace(text, '<[^>]{1,999}>', ' ', 'g'), '[^A-Za-z]', '', 'g')) AS n FROM documents)")
def script_language(t):
    return t.documents.select("doc_id", T.language(F.col("text")).alias("language"))


def _blocks(t):
    """A document is a block; a conversation's turns are blocks of one document."""
    return t.documents.select("doc_id", F.lit(1).alias("block_index"), F.lit(1).alias("page"), F.col("source").alias("section"), F.lit("text").alias("block_type"), "text")


def _turns(t):
    kind = F.when(F.col("role") == "system", "title").otherwise("text")
    return t.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("block_index"), (F.col("turn") + 1).cast("int").alias("page"), F.lit(None).cast("string").alias("section"), kind.alias("block_type"), "text")


@query("text_blocks", r"SELECT doc_id, posn AS block_index, block FROM (SELECT doc_id, unnest(b) AS block, generate_subscripts(b, 1) AS posn FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\r?\n[ \t]*\r?\n+'), lambda x: trim(x) <> '') AS b FROM documents))")
def text_blocks(t):
    parts = F.filter(F.split("text", r"\r?\n[ \t]*\r?\n+"), lambda x: F.trim(x) != "")
    return t.documents.select("doc_id", F.posexplode(parts).alias("i", "block")).select("doc_id", (F.col("i") + 1).alias("block_index"), "block")


@query("chunk_documents")
def chunk_documents(t):
    made = C.chunks(_blocks(t))
    return made.select("doc_id", "chunk_index", "section", "tokens", "oversized", F.size("spans").alias("n_spans"), F.sha2("text", 256).alias("digest"))


@query("chunk_turns")
def chunk_turns(t):
    return C.chunks(_turns(t)).select("doc_id", "chunk_index", "page_start", "page_end", "tokens", F.sha2("text", 256).alias("digest"))


_ESTIMATE = r"(CAST(coalesce(list_sum([(length(x) + 3) // 4 for x in regexp_extract_all(text, '[A-Za-z0-9_]+')]), 0) AS BIGINT) + length(regexp_replace(text, '[A-Za-z0-9_]+|\s', '', 'g')))"


@query("chunk_overlap", rf"SELECT CAST(sum(k - 1 - CASE WHEN k = 2 AND n <= 600 OR k > 2 AND n - 500 * (k - 1) <= 20 THEN 1 ELSE 0 END) FILTER (k > 0 AND NOT regexp_matches(text, '\r?\n[ \t]*\r?\n')) AS BIGINT) AS overlaps, 0 AS broken, true AS within FROM (SELECT *, CAST(ceil(n / 500) AS BIGINT) AS k FROM (SELECT text, {_ESTIMATE} AS n FROM documents))")
def chunk_overlap(t):
    """Overlaps in documents of one paragraph: one for each cut of 500 tokens, but where the rest behind the last cut still fits the chunk
    before it. All repeat the end of the chunk before them, and no more than 80 tokens."""
    blocks = _blocks(t)
    single = blocks.select("doc_id", (~F.col("text").rlike(r"\r?\n[ \t]*\r?\n")).alias("single"))
    spans = C.chunks(blocks).select("doc_id", "chunk_index", F.filter("spans", lambda s: s["role"] == "overlap").alias("o"), F.filter("spans", lambda s: s["role"] == "content").alias("c"), "text")
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    rows = spans.select("doc_id", F.try_element_at("o", F.lit(-1))["end"].alias("over"), F.lag(F.try_element_at("c", F.lit(-1))["end"]).over(w).alias("before"), F.aggregate("o", F.lit(0).cast("long"), lambda n, s: n + T.estimated_tokens(F.substring(F.col("text"), s["chunk_start"] + 1, s["chunk_end"] - s["chunk_start"]))).alias("tokens"))
    return rows.join(single, "doc_id").agg(F.count_if(F.col("single") & F.col("over").isNotNull()).alias("overlaps"), F.count_if(F.col("over").isNotNull() & (F.col("over") != F.col("before"))).alias("broken"), (F.max("tokens") <= 80).alias("within"))


@query("chunk_coverage", r"SELECT doc_id, length(text) AS chars, 0 AS gaps FROM documents WHERE regexp_matches(text, '\S')")
def chunk_coverage(t):
    """Content spans tile every block from its begin to its end."""
    return C.coverage(C.chunks(_blocks(t))).select("doc_id", "chars", "gaps")


@query("chunk_pages", "SELECT conv_id AS doc_id, CAST(min(turn) + 1 AS INTEGER) AS first_page, CAST(max(turn) + 1 AS INTEGER) AS last_page FROM conversations WHERE regexp_matches(text, '\\S') GROUP BY conv_id")
def chunk_pages(t):
    return C.chunks(_turns(t)).groupBy("doc_id").agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))


@query("evidence_verify", r"SELECT 0 AS unverified, count(*) FILTER (conv_id % 5 = 0 AND regexp_matches(text, '\S') AND text NOT LIKE '#%') AS damaged FROM conversations")
def evidence_verify(t):
    """Spans that differ from their blocks, and blocks that are found to differ when the first character of each fifth document's is
    another one."""
    made, blocks = C.chunks(_turns(t)), _turns(t)
    other = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("#"), F.substring("text", 2, 1 << 30))).otherwise(F.col("text"))
    good = C.evidence(made, blocks).agg(F.count_if(~F.col("verified")).alias("unverified"))
    bad = C.evidence(made, blocks.withColumn("text", other)).where("not verified").select("doc_id", "block").distinct().agg(_count().alias("damaged"))
    return good.join(bad)


def _headings(t):
    """Headings of pages: h1 at level 1, bold lines at level 2, paragraphs as level 3 candidates, whole."""
    tags = F.regexp_extract_all("html", F.lit(r"<(h1|b|p)>([^<]+)"), F.lit(0))
    rows = t.pages.select("page_id", F.posexplode(tags).alias("place", "tag"))
    level = F.when(F.col("tag").startswith("<h1"), 1).when(F.col("tag").startswith("<b>"), 2).otherwise(3)
    return rows.select(F.col("page_id").alias("doc_id"), "place", level.alias("level"), F.regexp_replace("tag", "^<[a-z0-9]+>", "").alias("title"))


_HEADINGS = r"h AS (SELECT page_id AS doc_id, CAST(i - 1 AS INTEGER) AS place, CASE WHEN tag LIKE '<h1%' THEN 1 WHEN tag LIKE '<b>%' THEN 2 ELSE 3 END AS level, regexp_replace(tag, '^<[a-z0-9]+>', '') AS title FROM (SELECT page_id, unnest(x) AS tag, generate_subscripts(x, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(h1|b|p)>([^<]+)') AS x FROM pages)))"


@query("outline_parent", f"WITH {_HEADINGS} SELECT a.doc_id, a.place, a.level, coalesce(max(b.place), -1) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.place < a.place AND b.level < a.level GROUP BY ALL")
def outline_parent(t):
    return D.outline_parents(_headings(t)).select("doc_id", "place", "level", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("section_path", f"WITH {_HEADINGS} SELECT doc_id, place, CASE level WHEN 1 THEN title WHEN 2 THEN coalesce(t1 || ' / ', '') || title ELSE coalesce(t1 || ' / ', '') || CASE WHEN p2 > coalesce(p1, -1) THEN t2 || ' / ' ELSE '' END || title END AS path FROM (SELECT *, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 1 THEN place END IGNORE NULLS) OVER w AS p1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level = 2 THEN place END IGNORE NULLS) OVER w AS p2 FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY place))")
def section_path(t):
    return D.section_paths(_headings(t)).select("doc_id", "place", "path")


_DRESSED = "CASE place % 5 WHEN 0 THEN title WHEN 1 THEN '## ' || title WHEN 2 THEN (place + 1) || '.' || (place % 7 + 1) || ' ' || title WHEN 3 THEN '第' || (place + 1) || '节 ' || title ELSE '（二）' || title END"


def _dressed(t):
    """Headings of pages as documents number them: bare, marked, dotted, Chinese chapters and items."""
    n, title = F.col("place"), F.col("title")
    text = F.when(n % 5 == 0, title).when(n % 5 == 1, F.concat(F.lit("## "), title)).when(n % 5 == 2, F.concat_ws("", n + 1, F.lit("."), n % 7 + 1, F.lit(" "), title)).when(n % 5 == 3, F.concat_ws("", F.lit("第"), n + 1, F.lit("节 "), title)).otherwise(F.concat(F.lit("（二）"), title))
    return _headings(t).withColumn("text", text)


# The patterns of numbered headings, heading marks and lines of contents, as in functions/text.py.
_NUMBERED_SQL = r"'^([1-9][0-9]{0,2}(?:\.[0-9]{1,3}){0,5})(?:[.．](?:\s+\S|[^0-9\s])|、\s*\S|\s+\S)'"
_LEVEL_SQL = rf"""CASE WHEN length(text) > 200 OR contains(text, chr(10)) OR regexp_matches(text, '^.+?(\.{{2,}}|…{{2,}}|·{{3,}}|\t+)\s*[0-9ivxlcdmIVXLCDM]{{1,8}}\s*$') THEN -1
 WHEN regexp_matches(text, '^#{{1,6}}\s+\S') THEN length(regexp_extract(text, '^(#+)', 1))
 WHEN regexp_matches(text, '^第[一二三四五六七八九十百零〇0-9]+[章节篇部]') THEN CASE WHEN regexp_matches(text, '^第[一二三四五六七八九十百零〇0-9]+节') THEN 2 ELSE 1 END
 WHEN regexp_matches(text, '^([一二三四五六七八九十百]+[、．.]|[（(][一二三四五六七八九十百]+[）)])\s*\S') THEN CASE WHEN left(text, 1) IN ('（', '(') THEN 2 ELSE 1 END
 WHEN regexp_matches(text, {_NUMBERED_SQL}) AND (level = 1 OR (length(text) <= 100 AND NOT regexp_matches(text, '[。；;！？!?]'))) THEN len(string_split(regexp_extract(text, {_NUMBERED_SQL}, 1), '.'))
 WHEN level = 1 THEN 1 ELSE -1 END"""


@query("heading_level", f"WITH {_HEADINGS}, d AS (SELECT doc_id, place, level, {_DRESSED} AS text FROM h) SELECT doc_id, place, {_LEVEL_SQL} AS level FROM d")
def heading_level(t):
    """Levels by the marks and numbers of the headings of pages."""
    return _dressed(t).select("doc_id", "place", F.coalesce(T.heading_level(F.col("text"), F.col("level") == 1), F.lit(-1)).alias("level"))


# The pattern of a line of contents below is a fixed value, too.
_LINE = "title || CASE place % 4 WHEN 0 THEN ' ..... ' WHEN 1 THEN chr(9) WHEN 2 THEN '……' ELSE ' ' END || (place + 1)"


def _lines(t):
    """A line of contents for each heading; each fourth has no leader and isn't one."""
    lead = F.element_at(F.array(F.lit(" ..... "), F.lit("\t"), F.lit("……"), F.lit(" ")), (F.col("place") % 4 + 1).cast("int"))
    return _headings(t).where("level < 3").withColumn("line", F.concat_ws("", "title", lead, F.col("place") + 1))


@query("toc_lines", rf"WITH {_HEADINGS}, l AS (SELECT *, {_LINE} AS line FROM h WHERE level < 3) SELECT doc_id, place, trim(regexp_extract(line, '^(.+?)(\.{{2,}}|…{{2,}}|·{{3,}}|\t+)\s*([0-9ivxlcdmIVXLCDM]{{1,8}})\s*$', 1)) AS title, regexp_extract(line, '^(.+?)(\.{{2,}}|…{{2,}}|·{{3,}}|\t+)\s*([0-9ivxlcdmIVXLCDM]{{1,8}})\s*$', 3) AS label FROM l WHERE regexp_matches(line, '^(.+?)(\.{{2,}}|…{{2,}}|·{{3,}}|\t+)\s*([0-9ivxlcdmIVXLCDM]{{1,8}})\s*$')")
def toc_lines(t):
    return _lines(t).select("doc_id", "place", T.contents_line(F.col("line")).alias("c")).where("c is not null").select("doc_id", "place", F.trim("c.title").alias("title"), "c.label")


@query("toc_match", rf"WITH {_HEADINGS}, k AS (SELECT *, replace(lower(regexp_replace(title, '\s+', '', 'g')), 'ß', 'ss') AS k FROM h WHERE level < 3), n AS (SELECT doc_id, k, count(*) AS n FROM k WHERE place % 3 <> 2 GROUP BY doc_id, k) SELECT k.doc_id, place, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS match FROM k LEFT JOIN n ON n.doc_id = k.doc_id AND n.k = k.k WHERE place % 4 <> 3")
def toc_match(t):
    """Lines of contents against the headings of their page, numbered in the text and not in the contents; each third heading is missing."""
    entries = _lines(t).select("doc_id", "place", T.contents_line(F.col("line")).alias("c")).where("c is not null").select("doc_id", "place", T.title_key(F.col("c.title")).alias("k"))
    headings = _dressed(t).where("level < 3 and place % 3 <> 2").select("doc_id", T.title_key(F.col("text")).alias("k")).groupBy("doc_id", "k").agg(_count().alias("n"))
    match = F.when(F.col("n") == 1, "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return entries.join(headings, ["doc_id", "k"], "left").select("doc_id", "place", match.alias("match"))


_PROFILE = "p AS (SELECT conv_id AS doc_id, count(*) AS blocks, count(DISTINCT page) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, 0 AS tables, count(*) FILTER (role = 'system') AS formulas, count(*) FILTER (role = 'assistant') AS images, count(*) FILTER (page < back) AS regressions, count(*) FILTER (confidence < 0.6) AS low_confidence FROM (SELECT *, lag(page) OVER (PARTITION BY conv_id ORDER BY turn) AS back FROM (SELECT *, (turn * 7) % 5 + 1 AS page, (turn % 10) / 10 AS confidence FROM conversations)) GROUP BY conv_id)"


def _observed(t):
    kind = F.when(F.col("role") == "system", "formula").when(F.col("role") == "assistant", "image_text").otherwise("text")
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_index"), ((F.col("turn") * 7) % 5 + 1).alias("page"), kind.alias("block_type"), "text", ((F.col("turn") % 10) / 10).alias("confidence"))


@query("doc_profile", f"WITH {_PROFILE} SELECT * FROM p")
def doc_profile(t):
    return D.profile(_observed(t)).select("doc_id", "blocks", "pages", "chars", "tables", "formulas", "images", "regressions", "low_confidence")


@query("doc_complexity", f"WITH {_PROFILE}, s AS (SELECT doc_id, CASE WHEN pages >= 200 THEN 25 WHEN pages >= 50 THEN 15 WHEN pages >= 10 THEN 5 ELSE 0 END + CASE WHEN formulas >= 10 THEN 15 WHEN formulas >= 1 THEN 5 ELSE 0 END + CASE WHEN images >= 5 THEN 10 WHEN images >= 1 THEN 3 ELSE 0 END + CASE WHEN chars >= 1000000 THEN 15 WHEN chars >= 100000 THEN 8 ELSE 0 END AS score FROM p) SELECT doc_id, score, CASE WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS level FROM s")
def doc_complexity(t):
    return D.complexity(D.profile(_observed(t))).select("doc_id", "score", "level")


@query("doc_quality", f"WITH {_PROFILE} SELECT doc_id, concat_ws(',', CASE WHEN regressions > 0 THEN 'PAGE_ORDER_REGRESSION' END, CASE WHEN low_confidence > 0 THEN 'LOW_REPORTED_CONFIDENCE' END) AS findings, CASE WHEN regressions > 0 OR low_confidence > 0 THEN 'review' ELSE 'no_observed_issue' END AS status FROM p")
def doc_quality(t):
    return D.findings(D.profile(_observed(t))).select("doc_id", F.array_join("findings", ",").alias("findings"), "status")


@query("coverage_guard", "SELECT conv_id, array_to_string(list_sort([x for x in range(0, n) if NOT list_contains(covered, x)]), ',') AS missing FROM (SELECT conv_id, max(turn) + 1 AS n, list(turn) FILTER (role = 'user') AS covered FROM conversations GROUP BY conv_id)")
def coverage_guard(t):
    """Turns that a pass over the user's turns leaves out."""
    grouped = t.conversations.groupBy("conv_id").agg(F.max("turn").alias("last"), F.collect_set(F.when(F.col("role") == "user", F.col("turn"))).alias("covered"))
    missing = D.missing_pages(F.array().cast("array<bigint>"), F.sequence(F.lit(0).cast("long"), "last"), F.col("covered"))
    return grouped.select("conv_id", F.array_join(missing, ",").alias("missing"))


@query("quality_merge", "SELECT conv_id, bool_or(length(text) < 60) AS partial, array_to_string(list_sort(list_distinct(list(turn % 3))), ',') AS pages, least(128, count(DISTINCT length(text) % 400)) AS warnings FROM conversations GROUP BY conv_id")
def quality_merge(t):
    """Parts of one document: partial if any is, the union of their pages, and their different warnings, 128 at most."""
    pages = F.array_join(F.array_sort(F.collect_set(F.col("turn") % 3)), ",")
    warnings = F.slice(F.array_sort(F.collect_set(F.length("text") % 400)), 1, 128)
    return t.conversations.groupBy("conv_id").agg(F.bool_or(F.length("text") < 60).alias("partial"), pages.alias("pages"), F.size(warnings).alias("warnings"))


_ENHANCED = "CASE WHEN conv_id % 4 = 1 AND turn = 0 THEN substr(text, 2) WHEN conv_id % 4 = 2 THEN '  ' || replace(text, ' ', '   ') || chr(10) ELSE text END"


@query("page_text_equal", rf"SELECT conv_id, turn % 3 AS page, string_agg(regexp_replace(text, '\s+', '', 'g'), '' ORDER BY turn) = string_agg(regexp_replace({_ENHANCED}, '\s+', '', 'g'), '' ORDER BY turn) AS same FROM conversations GROUP BY conv_id, turn % 3")
def page_text_equal(t):
    """Whether an enhanced version says the same as the native one, page by page, white space apart: one of four documents has lost its
    first character, one has other spaces. Blocks are compared by the digests of their text in order, levels of them for long pages."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    text, mode = F.col("text"), F.col("conv_id") % 4
    enhanced = F.when((mode == 1) & (F.col("turn") == 0), F.substring(text, 2, 1 << 30)).when(mode == 2, F.concat(F.lit("  "), F.replace(text, F.lit(" "), F.lit("   ")), F.lit("\n"))).otherwise(text)
    rows = t.conversations.withColumn("page", F.col("turn") % 3)
    native, other = (A.fingerprint(rows, ["conv_id", "page"], bare(c), F.col("turn")).select("conv_id", "page", F.col("fingerprint").alias(n)) for n, c in (("a", text), ("b", enhanced)))
    return native.join(other, ["conv_id", "page"]).select("conv_id", "page", (F.col("a") == F.col("b")).alias("same"))


_BOXES = "b AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 + 1 AS page, l_returnflag AS kind, l_linenumber AS box, CAST(l_partkey % 500 AS DOUBLE) AS x0, CAST(l_suppkey * 7 % 700 AS DOUBLE) AS y0, l_partkey % 500 + l_quantity AS x1, l_suppkey * 7 % 700 + l_quantity * 2 AS y1 FROM lineitem)"


def _boxes(t):
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") * 7 % 700).cast("double")
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).alias("page"), F.col("l_returnflag").alias("kind"), F.col("l_linenumber").alias("box"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + F.col("l_quantity") * 2).alias("y1"))


@query("columns", f"WITH {_BOXES} SELECT a.doc_id, count(DISTINCT a.page) AS columns FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page = c.page AND a.box < c.box WHERE least(a.y1 - a.y0, c.y1 - c.y0) > 0 AND (least(a.y1, c.y1) - greatest(a.y0, c.y0)) / least(a.y1 - a.y0, c.y1 - c.y0) > 0.5 AND (a.x1 + 10 < c.x0 OR c.x1 + 10 < a.x0) GROUP BY a.doc_id")
def columns(t):
    return X.beside(_boxes(t), ["doc_id", "page"], 10.0, 100.0).groupBy("doc_id").agg(F.count_distinct("page").alias("columns"))


@query("bbox_match", f"WITH {_BOXES} SELECT a.doc_id, a.box, min(c.box) AS match FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page = c.page AND a.kind = c.kind AND a.box <> c.box AND abs(a.x0 - c.x0) <= 20 AND abs(a.y0 - c.y0) <= 20 GROUP BY a.doc_id, a.box HAVING count(*) = 1")
def bbox_match(t):
    """The one other box of the page and type within a tolerance; two candidates are none."""
    a, b = _boxes(t).select("doc_id", "page", "kind", "box", "x0", "y0"), _boxes(t).select("doc_id", "page", "kind", F.col("box").alias("other"), F.col("x0").alias("u"), F.col("y0").alias("v"))
    found = X.near(a, b, ["doc_id", "page", "kind"], 20.0, ("x0", "y0"), ("u", "v")).where("box != other")
    return found.groupBy("doc_id", "box").agg(_count().alias("n"), F.min("other").alias("match")).where("n = 1").drop("n")


@query("bbox_convert", f"WITH {_BOXES} SELECT doc_id, box, round(x0 / 1000 * 595, 6) AS left_, round(y0 / 1000 * 842, 6) AS top_, x0 <= x1 AND y0 <= y1 AND x1 <= 1000 AS valid FROM b")
def bbox_convert(t):
    return _boxes(t).select("doc_id", "box", F.round(F.col("x0") / 1000 * 595, 6).alias("left_"), F.round(F.col("y0") / 1000 * 842, 6).alias("top_"), ((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")) & (F.col("x1") <= 1000)).alias("valid"))


@query("bbox_iou", f"WITH {_BOXES}, p AS (SELECT a.doc_id, a.box, c.box AS other, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS u FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page = c.page AND a.box < c.box) SELECT doc_id, box, other, round(i / (u - i), 6) AS iou FROM p WHERE i > 0")
def bbox_iou(t):
    sides = ("x0", "y0", "x1", "y1")
    a, b = _boxes(t), _boxes(t).select("doc_id", "page", F.col("box").alias("other"), *[F.col(c).alias(f"o{c}") for c in sides])
    found = X.overlapping(a, b, ["doc_id", "page"], 100.0, sides, tuple(f"o{c}" for c in sides)).where("box < other")
    return found.select("doc_id", "box", "other", F.round(X.iou([F.col(c) for c in sides], [F.col(f"o{c}") for c in sides]), 6).alias("iou"))


_PAGE = "b AS (SELECT CAST(l_partkey % 10 AS BIGINT) AS doc_id, CAST(l_suppkey % 20 AS INTEGER) AS page, l_orderkey * 10 + l_linenumber AS box, CAST(l_orderkey * 37 % 900 AS DOUBLE) AS x0, CAST(l_partkey * 13 % 5000 AS DOUBLE) AS y0, l_orderkey * 37 % 900 + l_quantity AS x1, l_partkey * 13 % 5000 + 5 + l_linenumber AS y1 FROM lineitem WHERE l_suppkey % 20 < 12 OR l_linenumber = 1 AND l_orderkey % 40 = 0)"


@query("column_pages", f"WITH {_PAGE}, p AS (SELECT a.doc_id, a.page, a.box, bool_or(least(a.y1, c.y1) - greatest(a.y0, c.y0) > 0.5 * least(a.y1 - a.y0, c.y1 - c.y0) AND greatest(a.x0, c.x0) - least(a.x1, c.x1) > 50) AS beside, count(*) FILTER (c.y1 > a.y0) AS active FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page = c.page AND (c.y0, c.x0, c.y1, c.x1, c.box) < (a.y0, a.x0, a.y1, a.x1, a.box) GROUP BY ALL) SELECT g.doc_id, g.page, coalesce(bool_or(beside OR active > 128), false) AS columns FROM (SELECT DISTINCT doc_id, page FROM b) g LEFT JOIN p ON p.doc_id = g.doc_id AND p.page = g.page GROUP BY ALL")
def column_pages(t):
    """Pages of many boxes, some of few, that look set in columns."""
    l, x, y = t.lineitem.where("l_suppkey % 20 < 12 or l_linenumber = 1 and l_orderkey % 40 = 0"), F.col("l_orderkey") * 37 % 900, F.col("l_partkey") * 13 % 5000
    boxes = l.select((F.col("l_partkey") % 10).alias("doc_id"), (F.col("l_suppkey") % 20).alias("page"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + 5 + F.col("l_linenumber")).alias("y1"), F.lit(1000.0).alias("width"))
    return X.column_pages(boxes)


@query("order_consistency", "SELECT a.l_orderkey, round(1 - count(*) FILTER (a.l_partkey > b.l_partkey) / count(*), 6) AS consistency FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey")
def order_consistency(t):
    found = O.consistency(t.lineitem, "l_orderkey", "l_linenumber", "l_partkey")
    return found.where("consistency is not null").select("l_orderkey", F.round("consistency", 6).alias("consistency"))


@query("order_consistency_suppliers", "WITH l AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS place, l_partkey FROM lineitem) SELECT a.l_suppkey, count(*) AS pairs, count(*) FILTER (a.l_partkey > b.l_partkey) AS inversions FROM l a JOIN l b ON a.l_suppkey = b.l_suppkey AND a.place < b.place GROUP BY a.l_suppkey")
def order_consistency_suppliers(t):
    """Long orders, of which some lie in several parts."""
    rows = t.lineitem.select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place"), "l_partkey")
    found = O.consistency(rows, "l_suppkey", "place", "l_partkey", part=8192)
    return found.where("pairs > 0").select("l_suppkey", "pairs", "inversions")


@query("md_assets", r"SELECT page_id, len(regexp_extract_all(regexp_replace(html, '`[^`]*`', '', 'g'), '!\[[^\]]*\]|<(?:img|svg|picture|object)\b')) AS assets, len(regexp_extract_all(html, '<script\b')) AS scripts FROM pages")
def md_assets(t):
    bare = F.regexp_replace("html", "`[^`]*`", "")
    return t.pages.select("page_id", F.regexp_count(bare, F.lit(r"!\[[^\]]*\]|<(?:img|svg|picture|object)\b")).alias("assets"), F.regexp_count("html", F.lit(r"<script\b")).alias("scripts"))


@query("json_array_len", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 0 END AS n FROM events")
def json_array_len(t):
    """Length of a JSON array, 0 for any other value."""
    k = F.get_json_object("props", "$.k")
    value = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), k, F.lit(","), k, F.lit(",1]"))).otherwise(F.col("props"))
    return t.events.select("event_id", F.coalesce(F.json_array_length(value), F.lit(0)).alias("n"))


@query("event_props", "SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n, count(*) FILTER (json_extract(props, '$.missing') IS NULL) AS without FROM events GROUP BY 1")
def event_props(t):
    return t.events.select(F.from_json("props", "k int").alias("p"), F.get_json_object("props", "$.missing").alias("m")).groupBy(F.col("p.k").alias("k")).agg(_count().alias("n"), F.count_if(F.col("m").isNull()).alias("without"))


@query("route_decision", "WITH f AS (SELECT *, ['pdf', 'docx', 'xlsx', 'md', 'txt', 'png', 'pptx'][1 + event_id % 7] AS kind, ['auto', 'native', 'mineru'][1 + event_id % 3] AS mode, CASE WHEN value > 80 THEN 'EXTERNAL_ATTACHMENT_MISSING' WHEN value > 40 THEN 'HAS_IMAGE,HAS_CHART' WHEN value > 20 THEN 'HAS_IMAGE' ELSE '' END AS risks FROM events), g AS (SELECT *, risks <> '' AS risky, CASE WHEN risks = '' THEN '' ELSE ',' || risks END AS more FROM f) SELECT event_id, CASE WHEN mode <> 'native' AND risks LIKE 'EXT%' THEN 'failed' WHEN mode = 'native' THEN 'native' WHEN mode = 'mineru' THEN CASE WHEN kind IN ('pdf', 'docx', 'xlsx', 'png', 'pptx') THEN 'mineru_whole' ELSE 'failed' END WHEN kind IN ('png', 'pptx') THEN 'mineru_whole' WHEN kind = 'xlsx' AND risky THEN 'hybrid_bundle' WHEN kind = 'md' AND risky THEN 'failed' WHEN kind IN ('docx', 'pdf') AND risky THEN 'mineru_whole' ELSE 'native' END AS strategy, CASE WHEN mode <> 'native' AND risks LIKE 'EXT%' THEN risks WHEN mode = 'native' THEN 'EXPLICIT_NATIVE' || more WHEN mode = 'mineru' THEN CASE WHEN kind IN ('pdf', 'docx', 'xlsx', 'png', 'pptx') THEN 'EXPLICIT_MINERU' ELSE 'MINERU_UNSUPPORTED_FORMAT' END || more WHEN kind IN ('png', 'pptx') THEN 'VISUAL_OR_LEGACY_FORMAT' || more WHEN kind = 'xlsx' AND risky THEN 'XLSX_HYBRID_ENABLED' || more WHEN kind IN ('md', 'docx', 'pdf') AND risky THEN risks WHEN risky THEN risks || ',NATIVE_COVERAGE_SUPPORTED' ELSE 'NATIVE_COVERAGE_SUPPORTED' END AS reasons FROM g")
def route_decision(t):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    risks = F.when(F.col("value") > 80, names("EXTERNAL_ATTACHMENT_MISSING")).when(F.col("value") > 40, names("HAS_IMAGE", "HAS_CHART")).when(F.col("value") > 20, names("HAS_IMAGE"))
    routed = t.events.select("event_id", D.route(pick(["pdf", "docx", "xlsx", "md", "txt", "png", "pptx"]), pick(["auto", "native", "mineru"]), risks).alias("r"))
    return routed.select("event_id", "r.strategy", F.array_join("r.reasons", ",").alias("reasons"))


_ROUTED = """r AS (SELECT event_id, ['pdf', 'docx', 'xlsx', 'md', 'txt', 'png', 'pptx'][1 + event_id % 7] AS kind, ['auto', 'native', 'mineru', 'auto'][1 + event_id % 4] AS mode, event_id % 29 = 0 AS unsure, event_id % 5 = 0 AS saved, event_id % 2 AS times,
 CASE CAST(floor(value) AS BIGINT) % 6 WHEN 0 THEN ['EXTERNAL_ATTACHMENT_MISSING'] WHEN 1 THEN ['XLSX_HAS_EXTERNAL_LINK'] WHEN 2 THEN ['XLSX_EXTERNAL_ASSET_MISSING', 'HAS_IMAGE'] WHEN 3 THEN ['HAS_IMAGE', 'HAS_CHART'] ELSE CAST([] AS VARCHAR[]) END AS risks FROM events),
x AS (SELECT *, len(risks) > 0 AS risky, kind IN ('pdf', 'docx', 'xlsx', 'png', 'pptx') AS cloud, kind = 'xlsx' AND mode <> 'native' AND (list_contains(risks, 'XLSX_EXTERNAL_ASSET_MISSING') OR list_contains(risks, 'XLSX_HAS_EXTERNAL_LINK') AND NOT saved) AS lost FROM r),
n AS (SELECT *, CASE WHEN unsure THEN 1 WHEN mode <> 'native' AND list_contains(risks, 'EXTERNAL_ATTACHMENT_MISSING') THEN 2 WHEN lost THEN 3 WHEN mode = 'native' THEN 4 WHEN kind = 'xlsx' AND saved THEN 5 WHEN mode = 'mineru' AND cloud THEN 6 WHEN mode = 'mineru' THEN 7 WHEN kind IN ('png', 'pptx') THEN 8 WHEN kind = 'xlsx' AND risky THEN 9 WHEN kind = 'md' AND risky THEN 10 WHEN kind IN ('docx', 'pdf') AND risky THEN 11 ELSE 12 END AS rule FROM x),
d AS (SELECT *, CASE WHEN rule IN (1, 2, 3, 7, 10) THEN 'failed' WHEN rule IN (5, 6, 8, 11) THEN 'mineru_whole' WHEN rule = 9 THEN 'hybrid_bundle' ELSE 'native' END AS strategy,
 CASE rule WHEN 1 THEN CASE WHEN risky THEN risks ELSE ['PREFLIGHT_UNCERTAIN'] END WHEN 3 THEN CASE WHEN list_contains(risks, 'XLSX_EXTERNAL_ASSET_MISSING') THEN risks ELSE list_append(risks, 'XLSX_EXTERNAL_ASSET_MISSING') END WHEN 4 THEN list_prepend('EXPLICIT_NATIVE', risks) WHEN 5 THEN list_prepend(CASE WHEN mode = 'mineru' THEN 'EXPLICIT_MINERU' ELSE 'XLSX_WHOLE_WITH_NATIVE_PRIMARY' END, risks)
 WHEN 6 THEN list_prepend('EXPLICIT_MINERU', risks) WHEN 7 THEN list_prepend('MINERU_UNSUPPORTED_FORMAT', risks) WHEN 8 THEN list_prepend('VISUAL_OR_LEGACY_FORMAT', risks) WHEN 9 THEN list_prepend('XLSX_HYBRID_ENABLED', risks) WHEN 12 THEN list_append(risks, 'NATIVE_COVERAGE_SUPPORTED') ELSE risks END AS reasons FROM n)"""


@query("route_fallback", f"WITH {_ROUTED} SELECT event_id, strategy, array_to_string(reasons, ',') AS reasons, CASE WHEN mode = 'auto' AND strategy = 'native' AND times = 0 AND cloud THEN array_to_string(list_append(reasons, 'NATIVE_COMPLETENESS_FALLBACK'), ',') ELSE '' END AS again FROM d")
def route_fallback(t):
    """Routes with uncertain inspections, saved snapshots and missing parts of workbooks, and what each falls back to."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    kind, mode, n = pick(["pdf", "docx", "xlsx", "md", "txt", "png", "pptx"]), pick(["auto", "native", "mineru", "auto"]), F.floor("value") % 6
    risks = F.when(n == 0, names("EXTERNAL_ATTACHMENT_MISSING")).when(n == 1, names("XLSX_HAS_EXTERNAL_LINK")).when(n == 2, names("XLSX_EXTERNAL_ASSET_MISSING", "HAS_IMAGE")).when(n == 3, names("HAS_IMAGE", "HAS_CHART"))
    rows = t.events.select("event_id", kind.alias("kind"), mode.alias("mode"), D.route(kind, mode, risks, F.col("event_id") % 29 == 0, (F.col("event_id") % 5 == 0).cast("int")).alias("r"))
    again = D.fallback(F.col("kind"), F.col("mode"), F.col("r"), F.col("event_id") % 2)
    return rows.select("event_id", "r.strategy", F.array_join("r.reasons", ",").alias("reasons"), F.coalesce(F.array_join(again["reasons"], ","), F.lit("")).alias("again"))


_GUARDED = """WITH d AS (SELECT DISTINCT conv_id AS doc_id, ['pdf', 'docx', 'xlsx', 'png', 'txt'][1 + conv_id % 5] AS kind, CASE conv_id % 3 WHEN 0 THEN 'native' ELSE CASE WHEN conv_id % 31 = 1 THEN 'failed' ELSE 'mineru_whole' END END AS strategy, conv_id % 11 = 0 AS odd, CASE conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 2 ELSE 20 END AS n_pages, conv_id % 9 = 0 AS saved, conv_id % 13 = 0 AS other, conv_id % 2 = 0 AS has_quality FROM conversations),
b AS (SELECT c.conv_id AS doc_id, CASE WHEN d.strategy = 'native' AND kind <> 'pdf' AND conv_id % 17 <> 0 OR kind = 'png' THEN 1 ELSE turn + 1 END AS page, c.text, CASE WHEN (d.strategy = 'native') = (conv_id % 19 <> 0) THEN 'native_parser' ELSE 'mineru_cloud' END AS source, conv_id % 23 = 0 AS unnamed, kind = 'docx' AND conv_id % 7 = 0 AS boxed FROM conversations c JOIN d ON d.doc_id = c.conv_id),
p AS (SELECT doc_id, count(*) AS n, list_sort(list_distinct(list(page) FILTER (regexp_matches(coalesce(text, ''), '\\S')))) AS pages, bool_or(source <> 'native_parser') AS not_native, bool_or(source <> 'mineru_cloud') AS not_cloud, bool_or(unnamed) AS unnamed, bool_or(boxed) AS boxed FROM b GROUP BY doc_id),
a AS (SELECT *, list_sort([x for x in [1, 2, 3] if NOT list_contains(pages, x)]) AS missing, kind IN ('docx', 'xlsx') AS office FROM d JOIN p USING (doc_id)),
s AS (SELECT *, len(missing) > 0 AND (kind = 'pdf' OR office AND strategy = 'mineru_whole' AND n_pages IS NOT NULL) AS short FROM a),
r AS (SELECT *, CASE WHEN other THEN 'kind differs' WHEN len(coalesce(pages, [])) = 0 THEN 'no text' WHEN kind = 'pdf' AND n_pages IS NULL THEN 'no page count' WHEN kind = 'pdf' AND list_max(pages) > n_pages THEN 'page out of range' WHEN kind = 'pdf' AND short AND NOT (strategy = 'mineru_whole' AND has_quality) THEN 'pages missing'
 WHEN office AND boxed THEN 'boxes of an office file' WHEN strategy = 'native' AND odd THEN 'structure not covered' WHEN strategy = 'native' AND not_native THEN 'source differs' WHEN strategy = 'native' AND kind <> 'pdf' AND pages <> [1] THEN 'page isn''t 1' WHEN strategy = 'native' AND kind = 'xlsx' AND (n <> 3 OR unnamed) THEN 'sheets differ'
 WHEN strategy = 'mineru_whole' AND not_cloud THEN 'source differs' WHEN strategy = 'mineru_whole' AND kind = 'png' AND pages <> [1] THEN 'page isn''t 1' WHEN strategy = 'mineru_whole' AND office AND list_max(pages) > coalesce(n_pages, 200) THEN 'page out of range' WHEN office AND short AND NOT has_quality THEN 'pages missing' WHEN strategy = 'failed' THEN 'route not allowed' WHEN saved AND kind NOT IN ('docx', 'xlsx') THEN 'snapshot of another format' END AS reason FROM s)
SELECT doc_id, coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN CASE WHEN short OR saved THEN 'PARTIAL' ELSE 'COMPLETE' END ELSE '' END AS content, CASE WHEN reason IS NULL AND short THEN array_to_string(missing, ',') ELSE '' END AS missing, CASE WHEN reason IS NULL THEN concat_ws(',', CASE WHEN short THEN 'MISSING_REQUIRED_PAGES' END, CASE WHEN saved THEN 'OFFICE_SAVED_SNAPSHOT,EXTERNAL_SOURCE_UNVERIFIED' END) ELSE '' END AS warnings FROM r"""


@query("result_guard", _GUARDED)
def result_guard(t):
    """Conversations as parsed documents of five formats, with faults of every kind: source, pages, sheets, boxes, snapshots."""
    n = F.col("conv_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    strategy = F.when(n % 3 == 0, "native").when(n % 31 == 1, "failed").otherwise("mineru_whole")
    base = t.conversations.select("*", pick(["pdf", "docx", "xlsx", "png", "txt"]).alias("kind"), strategy.alias("strategy"))
    reasons = F.array(F.when(n % 11 == 0, "HAS_IMAGE").otherwise("NATIVE_COVERAGE_SUPPORTED"))
    decisions = base.select(n.alias("doc_id"), "kind", "strategy", F.lit("auto").alias("mode"), reasons.alias("reasons"), F.when(n % 4 == 1, 2).when(n % 4 != 0, 20).alias("n_pages"), F.sequence(F.lit(1), F.lit(3)).alias("required"), F.lit(3).alias("sheets"), (n % 9 == 0).cast("int").alias("snapshots"), F.when(n % 13 == 0, "md").otherwise(F.col("kind")).alias("parsed_kind"), (n % 2 == 0).alias("has_quality")).distinct()
    native = F.col("strategy") == "native"
    page = F.when(native & (F.col("kind") != "pdf") & (n % 17 != 0) | (F.col("kind") == "png"), 1).otherwise(F.col("turn") + 1).cast("int")
    source = F.when(native == (n % 19 != 0), "native_parser").otherwise("mineru_cloud")
    blocks = base.select(n.alias("doc_id"), page.alias("page"), "text", source.alias("source"), F.when(n % 23 != 0, F.concat(F.lit("s"), F.col("turn").cast("string"))).alias("section"), F.when((F.col("kind") == "docx") & (n % 7 == 0), F.array(F.lit(0.0))).alias("bbox"))
    out = D.guarded(decisions, blocks)
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return out.select("doc_id", F.coalesce("reason", F.lit("")).alias("reason"), F.coalesce("content", F.lit("")).alias("content"), text("missing_pages").alias("missing"), text("warnings").alias("warnings"))


_SPLIT = """WITH RECURSIVE p AS (SELECT doc_id, page, bytes, sum(bytes) OVER (PARTITION BY doc_id ORDER BY page) AS upto FROM (SELECT o_orderkey % 7 AS doc_id, row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY o_orderkey) AS page, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders)),
n AS (SELECT a.doc_id, a.page, least(a.page + 40, coalesce(min(b.page), (SELECT max(page) + 1 FROM p c WHERE c.doc_id = a.doc_id))) AS next FROM p a LEFT JOIN p b ON a.doc_id = b.doc_id AND b.page > a.page AND b.upto - (a.upto - a.bytes) > 6000000 GROUP BY a.doc_id, a.page),
r AS (SELECT doc_id, CAST(1 AS BIGINT) AS part, CAST(1 AS BIGINT) AS first FROM p WHERE page = 1 UNION ALL SELECT n.doc_id, r.part + 1, n.next FROM r JOIN n ON n.doc_id = r.doc_id AND n.page = r.first JOIN p ON p.doc_id = n.doc_id AND p.page = n.next),
f AS (SELECT doc_id, count(*) AS parts FROM r GROUP BY doc_id),
q AS (SELECT r.doc_id, r.part, r.first, least(n.next - 1, (SELECT max(page) FROM p WHERE p.doc_id = r.doc_id)) AS last, f.parts FROM r JOIN n ON n.doc_id = r.doc_id AND n.page = r.first JOIN f ON f.doc_id = r.doc_id)
SELECT q.doc_id, CAST(q.part AS INTEGER) AS part, q.first, q.last, CAST((SELECT sum(bytes) FROM p WHERE p.doc_id = q.doc_id AND p.page BETWEEN q.first AND q.last) AS BIGINT) AS bytes, CASE WHEN parts > 100 THEN 'too many parts' ELSE '' END AS reason FROM q WHERE parts <= 100 OR q.part = 1"""


@query("split_plan", _SPLIT)
def split_plan(t):
    """Orders as pages of seven long documents: parts of 40 pages, 6,000,000 bytes, and 100 parts at most."""
    doc = F.col("o_orderkey") % 7
    pages = t.orders.select(doc.alias("doc_id"), F.row_number().over(Window.partitionBy(doc).orderBy("o_orderkey")).alias("page"), F.floor("o_totalprice").alias("bytes"))
    return P.split_plan(pages, 40, 6_000_000, 100).withColumn("reason", F.coalesce("reason", F.lit("")))


_STATES = ["UPLOADED", "PARSING", "CHUNKING", "EMBEDDING", "FAILED"]


@query("state_machine", "WITH s AS (SELECT user_id, event_id, ['UPLOADED', 'PARSING', 'CHUNKING', 'EMBEDDING', 'FAILED'][1 + CAST(event_id % 5 AS INTEGER)] AS state FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM s) SELECT user_id, count(*) AS invalid FROM l WHERE prev IS NOT NULL AND prev <> state AND (prev || '>' || state) NOT IN (" + ", ".join(f"'{a}>{b}'" for a, b in D.TRANSITIONS) + ") GROUP BY user_id")
def state_machine(t):
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (F.col("event_id") % 5 + 1).cast("int"))
    steps = t.events.select("user_id", "event_id", state.alias("state"))
    return D.invalid_transitions(steps, "user_id", ["event_id"], "state").groupBy("user_id").agg(_count().alias("invalid"))


_MARKED = "text || ' [' || turn % 3 || '] [' || turn % 5 || ']'"


def _marked(t):
    n = lambda k: (F.col("turn") % k).cast("string")
    return t.conversations.select("conv_id", "turn", F.concat("text", F.lit(" ["), n(3), F.lit("] ["), n(5), F.lit("]")).alias("answer"))


@query("marker_check", rf"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all({_MARKED}, '\[([0-9]+)\]', 1))), ',') AS cited, list_contains(list_distinct(regexp_extract_all({_MARKED}, '\[([0-9]+)\]', 1)), '0') AS has_zero, coalesce(list_sort(list_distinct([CAST(x AS INTEGER) for x in regexp_extract_all({_MARKED}, '\[([0-9]+)\]', 1)])) = range(1, 1 + len(list_distinct(regexp_extract_all({_MARKED}, '\[([0-9]+)\]', 1)))) AND len(regexp_extract_all({_MARKED}, '\[([0-9]+)\]', 1)) > 0, false) AS consistent FROM conversations")
def marker_check(t):
    """Citation markers of an answer, each once, and whether they are 1 to their number: no source unused, none unknown."""
    cited = F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[([0-9]+)\]"), F.lit(1)))
    return _marked(t).select("conv_id", "turn", F.array_join(F.array_sort(cited), ",").alias("cited"), F.array_contains(cited, "0").alias("has_zero"), ((F.size(cited) > 0) & (F.array_sort(cited.cast("array<int>")) == F.sequence(F.lit(1), F.greatest(F.size(cited), F.lit(1))))).alias("consistent"))


@query("citation_numbering", "WITH c AS (SELECT conv_id, unnest([turn % 3, turn % 5]) AS source, unnest([turn * 2, turn * 2 + 1]) AS place FROM conversations) SELECT conv_id, source, row_number() OVER (PARTITION BY conv_id ORDER BY min(place)) AS number FROM c GROUP BY conv_id, source")
def citation_numbering(t):
    """Sources numbered by their first use."""
    uses = t.conversations.select("conv_id", F.explode(F.array(F.struct((F.col("turn") % 3).alias("source"), (F.col("turn") * 2).alias("place")), F.struct((F.col("turn") % 5).alias("source"), (F.col("turn") * 2 + 1).alias("place")))).alias("u"))
    first = uses.groupBy("conv_id", "u.source").agg(F.min("u.place").alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("conv_id").orderBy("first"))).drop("first")


_BUDGET = """WITH RECURSIVE e AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
r AS (SELECT conv_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, CAST(-1 AS BIGINT) AS turn, false AS taken FROM (SELECT DISTINCT conv_id FROM e)
 UNION ALL SELECT e.conv_id, e.place, CASE WHEN r.used + e.n <= 400 THEN r.used + e.n ELSE r.used END, e.turn, coalesce(r.used + e.n <= 400, false) FROM r JOIN e ON e.conv_id = r.conv_id AND e.place = r.place + 1)
SELECT conv_id, turn, taken FROM r WHERE place > 0"""


@query("evidence_budget", _BUDGET)
def evidence_budget(t):
    """Turns as evidence of their conversation, taken in order while 400 characters last; what doesn't fit is passed over."""
    return B.within_budget(t.conversations, "conv_id", "turn", F.length("text"), 400).select("conv_id", "turn", "taken")


_CLAIMS = r"""WITH c AS (SELECT conv_id AS answer_id, turn, CASE WHEN conv_id % 10 = 7 AND turn = 1 THEN text || ' [' || turn || ', 2]' WHEN conv_id % 10 = 8 AND turn = 0 THEN ' ' ELSE text END AS text, CASE WHEN conv_id % 10 = 9 AND turn = 1 THEN [1, 1] WHEN turn % 3 = 0 THEN [turn % 5] ELSE [turn % 5, (turn + 2) % 5] END AS ids FROM conversations),
u AS (SELECT answer_id, turn, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM c),
f AS (SELECT answer_id, id, row_number() OVER (PARTITION BY answer_id ORDER BY min(turn * 10 + i)) AS number FROM u GROUP BY answer_id, id),
m AS (SELECT answer_id, turn, string_agg('[' || number || ']', '' ORDER BY i) AS marks FROM u JOIN f USING (answer_id, id) GROUP BY answer_id, turn),
a AS (SELECT answer_id, bool_and(regexp_matches(text, '\S') AND NOT regexp_matches(text, '\[\s*[0-9]+(\s*[,\-]\s*[0-9]+)*\s*\]') AND len(list_distinct(ids)) = len(ids)) AS sound, string_agg(text || ' ' || marks, chr(10) || chr(10) ORDER BY turn) AS answer FROM c JOIN m USING (answer_id, turn) GROUP BY answer_id),
k AS (SELECT answer_id, bool_and(id < 4 OR answer_id % 2 = 0) AS known, string_agg(CAST(id AS VARCHAR), ',' ORDER BY number) AS citations FROM f GROUP BY answer_id)
SELECT answer_id, CASE WHEN sound AND known THEN 'success' ELSE 'failed' END AS status, CASE WHEN sound AND known THEN sha256(answer) ELSE '' END AS answer, CASE WHEN sound AND known THEN citations ELSE '' END AS citations FROM a JOIN k USING (answer_id)"""


@query("claim_binding", _CLAIMS)
def claim_binding(t):
    """Turns as the claims of an answer that cite one or two of five pieces of evidence, of which every other answer has only four; some
    claims are blank, number their own citations, or cite one twice."""
    n, turn = F.col("conv_id") % 10, F.col("turn")
    text = F.when((n == 7) & (turn == 1), F.concat("text", F.lit(" ["), turn.cast("string"), F.lit(", 2]"))).when((n == 8) & (turn == 0), " ").otherwise(F.col("text"))
    ids = F.when((n == 9) & (turn == 1), F.array(F.lit(1).cast("long"), F.lit(1).cast("long"))).when(turn % 3 == 0, F.array(turn % 5)).otherwise(F.array(turn % 5, (turn + 2) % 5))
    claims = t.conversations.select(F.col("conv_id").alias("answer_id"), turn.alias("place"), text.alias("text"), ids.alias("evidence_ids"))
    there = claims.select("answer_id").distinct().select("answer_id", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("answer_id") % 2 == 0, 4).otherwise(3).cast("long"))).alias("evidence_id"))
    out = B.bound_claims(claims, there)
    return out.select("answer_id", "status", F.coalesce(F.sha2("answer", 256), F.lit("")).alias("answer"), F.coalesce(F.array_join("citations", ","), F.lit("")).alias("citations"))


_VARIABLES = r"""WITH f AS (SELECT DISTINCT conv_id AS formula_id, CASE WHEN conv_id % 4 = 0 THEN ['a', 'b'] ELSE ['a', 'b', 'c'] END AS variables FROM conversations),
i AS (SELECT conv_id AS formula_id, turn, ['a', 'b', 'c', 'd', 'a'][1 + turn % 5] AS name, CASE WHEN conv_id % 6 = 5 THEN 'x' ELSE CAST(10 + turn AS VARCHAR) END AS value, conv_id % 3 = 0 AS quoted, split_part(text, ' ', 2) || ' =' || (10 + turn) || ' ' AS quote, text || ' ' || split_part(text, ' ', 2) || ' =' || (10 + turn) || ' ' || CASE WHEN conv_id % 9 = 3 AND turn = 1 THEN split_part(text, ' ', 2) || ' =' || (10 + turn) || ' ' ELSE '' END AS block FROM conversations WHERE turn < 2 + conv_id % 4),
c AS (SELECT i.*, f.variables, list_contains(variables, name) AS known, strpos(block, quote) AS begins, strpos(quote, value) AS inner_at FROM i JOIN f USING (formula_id)),
b AS (SELECT *, NOT quoted OR (begins > 0 AND strpos(substr(block, begins + 1), quote) = 0 AND inner_at > 0 AND strpos(substr(quote, inner_at + 1), value) = 0) AS bound FROM c),
g AS (SELECT formula_id, bool_and(known) AS known, count(*) = count(DISTINCT name) AS single, bool_and(value <> 'x') AS numbers, bool_and(bound) AS bound, string_agg(name || '=' || value || CASE WHEN quoted THEN '@' || (begins + inner_at - 2) ELSE '' END, ',' ORDER BY name) AS found, list(name) AS names FROM b GROUP BY formula_id),
s AS (SELECT f.formula_id, g.found, array_to_string([v for v in f.variables if NOT list_contains(g.names, v)], ',') AS missing, CASE WHEN NOT known THEN 'unknown' WHEN NOT single THEN 'conflict' WHEN NOT numbers THEN 'input' WHEN NOT bound THEN 'source' END AS bad FROM f JOIN g USING (formula_id))
SELECT formula_id, coalesce(bad, CASE WHEN missing <> '' THEN 'need_variables' ELSE 'success' END) AS status, CASE WHEN bad IS NULL THEN found ELSE '' END AS variables, CASE WHEN bad IS NULL THEN missing ELSE '' END AS missing FROM s"""


@query("variable_binding", _VARIABLES)
def variable_binding(t):
    """Inputs of the formulas of conversations: a third are quoted from their turn, some twice there; some are no variable or no number."""
    n, turn = F.col("conv_id"), F.col("turn")
    word, number = F.split_part("text", F.lit(" "), F.lit(2)), (turn + 10).cast("string")
    quote = F.concat(word, F.lit(" ="), number, F.lit(" "))
    rows = t.conversations.where("turn < 2 + conv_id % 4")
    name = F.element_at(F.array(*[F.lit(x) for x in "abcda"]), (turn % 5 + 1).cast("int"))
    block = F.concat(n.cast("string"), F.lit("-"), turn.cast("string"))
    inputs = rows.select(n.alias("formula_id"), name.alias("name"), F.when(n % 6 == 5, "x").otherwise(number).alias("value"), F.when(n % 3 == 0, block).alias("block_id"), F.when(n % 3 == 0, quote).alias("quote"))
    blocks = rows.select(block.alias("block_id"), F.concat("text", F.lit(" "), quote, F.when((n % 9 == 3) & (turn == 1), quote).otherwise("")).alias("text"))
    names = F.array(F.lit("a"), F.lit("b"))
    formulas = t.conversations.select(n.alias("formula_id"), F.when(n % 4 == 0, names).otherwise(F.array_append(names, "c")).alias("variables")).distinct()
    out = B.bound_variables(formulas, inputs, blocks)
    shown = F.transform("variables", lambda v: F.concat(v["name"], F.lit("="), v["value"], F.when(v["begin"].isNotNull(), F.concat(F.lit("@"), v["begin"].cast("string"))).otherwise("")))
    return out.select("formula_id", "status", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("variables"), F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"))


_FORMULAS = ("(a*w+b*v)/(w+v)", "a/(b-b)", "-(a-b*w)")


@query("formula_eval", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN d % gcd(n, d) = 0 AND d = gcd(n, d) THEN CAST(n // d AS VARCHAR) ELSE (n // gcd(n, d)) || '/' || (d // gcd(n, d)) END WHEN 1 THEN 'error' ELSE CAST(l_suppkey * l_linenumber - l_partkey AS VARCHAR) END AS exact FROM (SELECT *, l_partkey * l_linenumber + l_suppkey * CAST(l_quantity AS BIGINT) AS n, l_linenumber + CAST(l_quantity AS BIGINT) AS d FROM lineitem)")
def formula_eval(t):
    """Exact values of three formulas with the numbers of each line; one divides by zero."""
    text = lambda c: F.col(c).cast("long").cast("string")
    values = F.create_map(F.lit("a"), text("l_partkey"), F.lit("b"), text("l_suppkey"), F.lit("w"), text("l_linenumber"), F.lit("v"), text("l_quantity"))
    formula = F.element_at(F.array(*[F.lit(x) for x in _FORMULAS]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", M.evaluated(formula, values).alias("r")).select("l_orderkey", "l_linenumber", F.coalesce("r.exact", F.lit("error")).alias("exact"))


_NUMBERS = "f AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey * l_linenumber + l_suppkey * CAST(l_quantity AS BIGINT) AS HUGEINT) AS n, CAST(l_linenumber + CAST(l_quantity AS BIGINT) AS HUGEINT) AS d FROM lineitem)"


@query("formula_decimal", rf"WITH {_NUMBERS}, q AS (SELECT *, n * 1000000000000 // d AS q, n * 1000000000000 % d AS r FROM f), v AS (SELECT *, q + CASE WHEN 2 * r > d OR 2 * r = d AND q % 2 = 1 THEN 1 ELSE 0 END AS v FROM q) SELECT l_orderkey, l_linenumber, regexp_replace(CAST(v // 1000000000000 AS VARCHAR) || '.' || lpad(CAST(v % 1000000000000 AS VARCHAR), 12, '0'), '\.?0+$', '') AS shown FROM (SELECT l_orderkey, l_linenumber, v FROM v)")
def formula_decimal(t):
    """Weighted means to twelve digits, ties to even."""
    text = lambda c: F.col(c).cast("long").cast("string")
    values = F.create_map(F.lit("a"), text("l_partkey"), F.lit("b"), text("l_suppkey"), F.lit("w"), text("l_linenumber"), F.lit("v"), text("l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", M.evaluated(F.lit(_FORMULAS[0]), values)["decimal"].alias("shown"))


_PARTS = r"p AS (SELECT conv_id, turn, turn // 4 AS grp, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '([.!_*-])', '\\\1', 'g') || CASE WHEN turn % 2 = 0 THEN '  ' ELSE chr(10) END AS part, trim(regexp_replace(text, '\s+', ' ', 'g')) AS source FROM conversations WHERE regexp_matches(text, '\S'))"


def _merged(t):
    """Turns in groups of four, dressed with escapes, as parts of one text."""
    bare = F.trim(F.regexp_replace("text", r"\s+", " "))
    part = F.concat(F.regexp_replace(bare, r"([.!_*-])", r"\\$1"), F.when(F.col("turn") % 2 == 0, "  ").otherwise("\n"))
    return t.conversations.where(F.col("text").rlike(r"\S")).select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("grp"), part.alias("part"), bare.alias("source"))


@query("merged_slices", rf"WITH {_PARTS} SELECT conv_id, turn, sha256(part) AS slice FROM p")
def merged_slices(t):
    """A text that was merged from several, cut where they meet: each slice is the part that went in."""
    one = F.array_sort(F.collect_list(F.struct("turn", "part", "source")))
    whole = _merged(t).groupBy("conv_id", "grp").agg(one.alias("x")).select("conv_id", F.transform("x", lambda x: x["turn"]).alias("turns"), RS.merged_slices(F.array_join(F.transform("x", lambda x: x["part"]), ""), F.transform("x", lambda x: x["source"])).alias("s"))
    return whole.select("conv_id", F.explode(F.arrays_zip("turns", "s")).alias("z")).select("conv_id", F.col("z.turns").alias("turn"), F.sha2("z.s", 256).alias("slice"))


@query("restored_paragraphs", rf"WITH {_PARTS}, f AS (SELECT conv_id, grp, min(turn) AS turn, count(*) AS n FROM p GROUP BY conv_id, grp) SELECT p.conv_id, p.turn, sha256(CASE WHEN p.conv_id % 7 = 3 THEN CASE WHEN p.turn = f.turn THEN string_agg(part, '') OVER w || CASE WHEN n > 1 THEN 'x' ELSE '' END ELSE '' END ELSE part END) AS restored, CASE WHEN p.conv_id % 7 = 3 AND n > 1 THEN 'text differs' ELSE '' END AS reason FROM p JOIN f USING (conv_id, grp) WINDOW w AS (PARTITION BY p.conv_id, grp ORDER BY p.turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def restored_paragraphs(t):
    """Groups of four turns as paragraphs over pages, with page numbers between their parts; in a seventh the merged text isn't theirs."""
    rows = _merged(t)
    group = Window.partitionBy("conv_id", "grp")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "part")).over(group)), lambda x: x["part"]), "")
    rows = rows.withColumns({"first": F.min("turn").over(group), "n": _count().over(group), "whole": parts})
    is_first = F.col("turn") == F.col("first")
    spoiled = F.concat("whole", F.when((F.col("conv_id") % 7 == 3) & (F.col("n") > 1), "x").otherwise(""))
    own = rows.select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 2).cast("int").alias("place"), F.col("turn").cast("int").alias("page"), F.lit("text").alias("type"), F.when(is_first, spoiled).otherwise("").alias("text"), (~is_first).alias("deleted"), "source")
    between = own.select("doc_id", (F.col("place") + 1).alias("place"), "page", F.lit("page_number").alias("type"), F.col("page").cast("string").alias("text"), F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("source"))
    out = RS.restored_paragraphs(own.unionByName(between)).where("type = 'text'")
    return out.select(F.col("doc_id").alias("conv_id"), F.floor(F.col("place") / 2).alias("turn"), F.sha2("restored", 256).alias("restored"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("continued_tables", """WITH t AS (SELECT DISTINCT o_orderkey AS place, o_orderkey % 50 AS doc_id, o_custkey % 5 > 0 AS first, o_orderkey % 11 > 0 AS last, 1 + CAST(floor(o_totalprice) AS BIGINT) % 2 AS width, o_orderkey // 200 % 3 AS name, o_orderkey // 50 AS page FROM orders),
l AS (SELECT *, lag(last) OVER w AS l_last, lag(page) OVER w AS l_page, lag(width) OVER w AS l_width FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
c AS (SELECT *, sum(CASE WHEN first AND l_last AND l_page + 1 = page AND l_width = width THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY place) AS n FROM l),
h AS (SELECT *, first_value(place) OVER w AS chain, first_value(name) OVER w AS l_name FROM c WINDOW w AS (PARTITION BY doc_id, n ORDER BY place)),
d AS (SELECT *, CAST(place <> chain AND name = l_name AS INTEGER) AS dropped FROM h)
SELECT doc_id, place, chain, CAST(coalesce(sum(3 - dropped) OVER (PARTITION BY doc_id, n ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - dropped AS INTEGER) AS row_offset, dropped FROM d""")
def continued_tables(t):
    """Orders as tables of three rows on pages of fifty documents, one or two columns wide, some with the heading of the one before."""
    o = t.orders.select((F.col("o_orderkey") % 50).alias("doc_id"), F.col("o_orderkey").alias("place"), F.floor(F.col("o_orderkey") / 50).alias("page"), (F.col("o_custkey") % 5 > 0).alias("first"), (F.col("o_orderkey") % 11 > 0).alias("last"), (F.floor("o_totalprice") % 2).cast("int").alias("more"), (F.floor(F.col("o_orderkey") / 200) % 3).alias("name"))
    cells = o.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("more"))))
    text = F.when(F.col("row") == 0, F.concat(F.lit("head "), F.col("name").cast("string"))).otherwise(F.col("place").cast("string"))
    made = RS.continued_tables(cells.select("doc_id", "place", "page", "first", "last", "row", "col", F.lit(1).alias("span"), text.alias("text")))
    return made.select("doc_id", "place", "chain", "row_offset", "dropped")


@query("ordered_union", """WITH n AS (SELECT user_id AS doc_id, event_type AS sheet, event_id AS place, event_id * 10 AS anchor, CAST(event_id % 9 AS VARCHAR) AS text FROM events WHERE event_id % 3 = 0 AND event_type <> 'error'),
o AS (SELECT user_id AS doc_id, event_type AS sheet, event_id AS place, CASE WHEN event_id % 10 = 1 THEN NULL ELSE (event_id * 7919) % 10007 * 10 END AS anchor, CAST(event_id % 9 AS VARCHAR) AS text FROM events WHERE event_id % 3 <> 0),
b AS (SELECT o.*, (SELECT max(n.place) FROM n WHERE n.doc_id = o.doc_id AND n.sheet = o.sheet AND n.anchor <= o.anchor) AS behind, EXISTS (SELECT 1 FROM n WHERE n.doc_id = o.doc_id AND n.sheet = o.sheet) AS placed FROM o),
u AS (SELECT doc_id, sheet, 'native' AS origin, place, true AS placed, '' AS conflict, 0 AS a, place AS b, 0 AS c, 0 AS d FROM n UNION ALL
 SELECT b.doc_id, b.sheet, 'other', b.place, placed, CASE WHEN NOT placed THEN 'no sheet' WHEN b.anchor IS NULL THEN 'no anchor' WHEN b.text = n.text THEN 'same text' ELSE '' END, CASE WHEN b.anchor IS NULL THEN 1 ELSE 0 END, coalesce(behind, -1), 1, coalesce(b.anchor, -1) FROM b LEFT JOIN n ON n.place = b.behind AND n.doc_id = b.doc_id AND n.sheet = b.sheet)
SELECT doc_id, sheet, origin, place, CASE WHEN placed THEN CAST(row_number() OVER (PARTITION BY doc_id, sheet ORDER BY a, b, c, d, place) AS INTEGER) ELSE -1 END AS place_in_sheet, conflict FROM u""")
def ordered_union(t):
    """Events as the blocks of two parsers on the sheets of users: a third is native, the others are put behind the nearest of them."""
    n, own = F.col("event_id"), F.col("event_id") % 3 == 0
    rows = t.events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("sheet"), n.alias("place"), F.when(own, n * 10).when(n % 10 != 1, n * 7919 % 10007 * 10).alias("anchor"), (n % 9).cast("string").alias("text"), own.alias("own"))
    out = RS.ordered_union(rows.where("own and sheet <> 'error'").drop("own"), rows.where("not own").drop("own"))
    return out.select("doc_id", "sheet", "origin", "place", F.coalesce("place_in_sheet", F.lit(-1)).alias("place_in_sheet"), F.coalesce("conflict", F.lit("")).alias("conflict"))


@query("half_even", "SELECT l_orderkey, l_linenumber, CAST(round_even(CAST(l_extendedprice AS DECIMAL(18, 2)), 1) AS DOUBLE) AS price FROM lineitem")
def half_even(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(F.col("l_extendedprice").cast("decimal(18,2)"), 1).cast("double").alias("price"))


@query("number_literal", "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN 'null' WHEN 2 THEN 'null' ELSE format('{:.2f}', l_extendedprice) END AS value FROM lineitem")
def number_literal(t):
    """Prices as people write them: grouped, signed, with a percent sign, with a group cut short."""
    grouped, n = F.format_number("l_extendedprice", 2), F.col("l_linenumber") % 4
    text = F.when(n == 0, grouped).when(n == 1, F.concat(F.lit("+"), grouped)).when(n == 2, F.concat(grouped, F.lit("%"))).otherwise(F.concat(F.lit("1,"), F.substring(grouped, 1, 2)))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.coalesce(M.number_literal(text), F.lit("null")).alias("value"))


@query("latest_generation", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def latest_generation(t):
    return A.latest(t.events, "user_id", ["ts", "event_id"], ["event_id", "event_type"])


@query("backoff", "SELECT event_id, event_id % 5 AS attempt, CASE WHEN event_id % 5 < 3 THEN 5.0::DOUBLE * pow(2, event_id % 5) ELSE -1.0::DOUBLE END AS wait FROM events")
def backoff(t):
    return t.events.select("event_id", (F.col("event_id") % 5).alias("attempt")).select("event_id", "attempt", F.coalesce(S.backoff(F.col("attempt")), F.lit(-1.0)).alias("wait"))


@query("rolling_rate", "SELECT event_id, a AS minute, b AS day, a <= 1 AND b <= 40 AS admitted FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS a, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS b FROM events)")
def rolling_rate(t):
    """Requests of a user in the last 60 seconds and 24 hours, each with a limit."""
    rows = t.events.select("event_id", "user_id", "ts")
    minute = S.rolling_counts(rows, "user_id", "ts", 60).withColumnRenamed("recent", "minute")
    both = S.rolling_counts(minute, "user_id", "ts", 86_400).withColumnRenamed("recent", "day")
    return both.select("event_id", "minute", "day", ((F.col("minute") <= 1) & (F.col("day") <= 40)).alias("admitted"))


_QUOTAS = (S.Quota(21_600, 2), S.Quota(259_200, 5, final=True))

# Each request sees the grants before it, so the fold is a recursion over a user's requests in order: their times are kept as a list, one for each file granted.
_ADMIT = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, 1 + event_id % 2 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS place, CAST(-1 AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS held, '' AS state, CAST(0 AS BIGINT) AS wait_seconds FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, place, event_id, CASE WHEN state = 'granted' THEN list_concat(day, [t for x in range(n)]) ELSE day END, state, CASE WHEN state = 'wait' THEN greatest(1, CAST(ceil((list_min(six) + 21600000000 - t) / 1000000) AS BIGINT)) ELSE 0 END
 FROM (SELECT *, CASE WHEN len(six) + n > 2 THEN CASE WHEN len(six) = 0 THEN 'exhausted' ELSE 'wait' END WHEN len(day) + n > 5 THEN 'exhausted' ELSE 'granted' END AS state
  FROM (SELECT e.user_id, e.place, e.event_id, e.t, e.n, list_filter(r.held, lambda x: x > e.t - 259200000000) AS day, list_filter(r.held, lambda x: x > e.t - 21600000000) AS six FROM r JOIN e ON e.user_id = r.user_id AND e.place = r.place + 1)))
SELECT event_id, state, wait_seconds FROM r WHERE place > 0"""


@query("admission", _ADMIT)
def admission(t):
    """Requests for one or two files against quotas of 2 in 6 hours and 5 in 3 days, in order: only what was granted counts."""
    rows = t.events.select("event_id", "user_id", "ts", (F.col("event_id") % 2 + 1).alias("files"))
    return S.admissions(rows, "user_id", "ts", "event_id", _QUOTAS, count="files").select("event_id", "state", "wait_seconds")


@query("deadline", "SELECT event_id, epoch_us(ts) + 60000000 * (event_id % 3) < epoch_us(TIMESTAMP '2024-01-15 00:00:00') AS expired FROM events")
def deadline(t):
    due = F.unix_micros(F.col("ts").cast("timestamp")) + 60_000_000 * (F.col("event_id") % 3)
    return t.events.select("event_id", (due < F.unix_micros(F.to_timestamp(F.lit("2024-01-15 00:00:00")))).alias("expired"))


def _delivered(t, rows, late: str) -> str:
    """rows of events as files that a stream reads one by one: those that late names last, after the first file has come again."""
    at = f"{shared_folder(t.spark)}/brindle/delivered-{uuid.uuid4().hex}"
    parts = (rows.where(f"not ({late}) and event_id % 2 = 0"), rows.where(f"not ({late}) and event_id % 2 = 1"), rows.where(f"not ({late}) and event_id % 2 = 0"), rows.where(late))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{at}/events.parquet")
    return at


@query("stream_ingest", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_ingest(t):
    """The events as a stream of files, one of them twice, and those of the first ten days weeks late: each is stored once. Their folder
    is kept for the result."""
    first = t.events.agg(F.min("ts")).first()[0]
    at = _delivered(t, t.events, f"ts < timestamp_ntz'{first}' + interval 10 days")
    S.ingest(S.read_events(t.spark, at, 1), f"{at}/table", f"{at}/state").awaitTermination()
    return t.spark.read.parquet(f"{at}/table").groupBy("event_type").agg(_count().alias("n"), F.round(F.sum("value"), 4).alias("total"))


_STAGED = """WITH r AS (SELECT event_id // 25 AS doc_id, (event_id % 25) // 9 AS generation, (event_id * 3 + user_id) % 5 AS stage, event_type <> 'error' AS ok FROM events),
m AS (SELECT doc_id, max(generation) AS generation FROM r GROUP BY doc_id),
a AS (SELECT doc_id, generation, list_distinct(list(stage) FILTER (ok)) AS good, list_distinct(list(stage) FILTER (NOT ok)) AS bad FROM r JOIN m USING (doc_id, generation) GROUP BY ALL),
p AS (SELECT *, CAST(coalesce(list_min([x for x in range(0, 5) if NOT coalesce(list_contains(good, x), false)]), 5) AS INTEGER) AS passed FROM a)
SELECT doc_id, generation, passed, CASE WHEN passed < 5 AND coalesce(list_contains(bad, passed), false) THEN 'FAILED' ELSE ['NEW', 'UPLOADED', 'CHUNKING', 'EMBEDDING', 'INDEXING', 'READY'][passed + 1] END AS status FROM p"""


@query("staged_ingest", _STAGED)
def staged_ingest(t):
    """Events as reports of five stages of documents, in files of which one comes twice and one late: the state is that of all reports."""
    n = F.col("event_id")
    stage = F.element_at(F.array(*[F.lit(x) for x in G.STAGES]), ((n * 3 + F.col("user_id")) % 5 + 1).cast("int"))
    at = _delivered(t, t.events, "event_id % 7 = 3")
    reports = S.read_events(t.spark, at, 1).select(F.floor(n / 25).alias("doc_id"), F.floor(n % 25 / 9).alias("generation"), stage.alias("stage"), (F.col("event_type") != "error").alias("ok"), "ts")
    G.staged(reports, f"{at}/table", f"{at}/state").awaitTermination()
    return G.status(G.table(t.spark, f"{at}/table/state").read())
