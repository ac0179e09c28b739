"""Deterministic selections: questions that balance categories, documents that cover gaps, candidates without repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(seed: str, *columns: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns]), 256)


def balanced_questions(questions: DataFrame, n: int, seed: str) -> DataFrame:
    """n rows of questions(doc, category, id): one of each document first, then one after another from the category that has fewest.

    A row's level is the number its category will have when it is taken: those of the first round, then its place among the rest of its
    category. Rows in the order of their levels are what taking them one by one gives. Ties go by a seeded hash.
    """
    order = seeded(seed, F.col("doc"), F.col("id"))
    first = questions.withColumn("h", order).withColumn("of_doc", F.row_number().over(Window.partitionBy("doc").orderBy("h", "id")))
    begun = first.where("of_doc = 1").orderBy("h", "id").limit(n)
    held = begun.groupBy("category").agg(F.count(F.lit(1)).alias("begun"))
    rest = first.join(begun.select("doc", "id"), ["doc", "id"], "left_anti").join(held, "category", "left")
    place = F.row_number().over(Window.partitionBy("category").orderBy("h", "id"))
    later = rest.withColumn("level", F.coalesce("begun", F.lit(0)) + place)
    both = begun.withColumn("level", F.lit(0).cast("long")).unionByName(later.drop("begun"))
    return both.orderBy("level", "h", "id").limit(n).select("doc", "category", "id", "level")


def covering_documents(questions: DataFrame, documents: DataFrame, count: int, seed: str, *, wanted: int = 2, most_pages: int | None = None) -> DataFrame:
    """count documents, one after another: that with most categories not seen yet, then of a domain not seen yet, then with most questions
    that a category still lacks (up to wanted), then with fewer pages (in tens), fewer megabytes, and the smaller seeded hash. The order is a fixed value.

    questions(doc, category), documents(doc, domain, pages, bytes, content_hash). Of equal contents one is taken; a document that would
    exceed most_pages altogether is passed over. Each step is one job over a row for each document; the driver holds the counts of
    categories and the chosen documents, count at most.
    """
    per = questions.groupBy("doc", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("category", "n"))).alias("has"))
    pool = documents.join(per, "doc").withColumn("h", seeded(seed, F.col("doc"))).cache()
    taken: list = []
    counts: dict[str, int] = {}
    pages = 0
    while len(taken) < count:
        have = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]) if counts else F.create_map().cast("map<string,int>")
        held = lambda k: F.coalesce(F.try_element_at(have, k), F.lit(0))
        new = F.size(F.filter(F.map_keys("has"), lambda k: held(k) == 0))
        fresh = ~F.col("domain").isin([r.domain for r in taken]) if taken else F.lit(True)
        gain = F.aggregate(F.map_entries("has"), F.lit(0).cast("long"), lambda n, e: n + F.least(F.greatest(F.lit(0), F.lit(wanted) - held(e["key"])).cast("long"), e["value"]))
        left = pool.where(~F.col("content_hash").isin([r.content_hash for r in taken])) if taken else pool
        left = left if most_pages is None else left.where(F.col("pages") <= most_pages - pages)
        best = left.orderBy(F.desc(new), F.desc(fresh), F.desc(gain), F.floor(F.col("pages") / 10), F.floor(F.col("bytes") / (1 << 20)), "h", "doc").limit(1).collect()
        if not best:
            break
        taken.append(best[0])
        pages += best[0].pages
        for k, n in best[0].has.items():
            counts[k] = counts.get(k, 0) + n
    pool.unpersist()
    rows = [(i, r.doc, r.domain, r.pages) for i, r in enumerate(taken, 1)]
    return documents.sparkSession.createDataFrame(rows, documents.select(F.lit(1).alias("place"), "doc", "domain", "pages").schema)


def formula_candidates(hits: DataFrame, most: int = 100) -> DataFrame:
    """The formula spans of hits(rank, chunk_id, spans: array of block_id, block_type, text), each block once, at its best rank, in the order
    of retrieval; candidates beyond most are counted in omitted."""
    spans = hits.select("rank", "chunk_id", F.posexplode("spans").alias("at", "s")).where("s.block_type = 'formula'")
    once = spans.groupBy("s.block_id").agg(F.min(F.struct("rank", "at", "chunk_id", F.col("s.text").alias("text"))).alias("b"))
    total = once.agg(F.count(F.lit(1)).alias("total"))
    first = once.orderBy("b.rank", "b.at", "block_id").limit(most)  # at most most rows from here on
    place = F.row_number().over(Window.orderBy("b.rank", "b.at", "block_id"))
    return first.select(place.alias("place"), "block_id", "b.rank", "b.chunk_id", "b.text", F.sha2("b.text", 256).alias("text_hash")).join(F.broadcast(total)).withColumn("omitted", F.greatest(F.lit(0), F.col("total") - most)).drop("total")


def merged(base: Column, over: Column) -> Column:
    """Two maps as one; where both have a key, over's value counts. A null map is empty."""
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(base, empty), F.coalesce(over, empty), lambda k, a, b: F.coalesce(b, a))


def safe_members(asked: DataFrame, members: DataFrame, most: int = 200_000_000, ratio: float = 100.0) -> DataFrame:
    """asked(wanted) with path and reason: the one member of an archive whose path is wanted or ends with it, behind a slash. members has path,
    size and packed (bytes in the archive). reason is null, or none, several, unsafe path (absolute, with a backslash or a step up), too large,
    or packed too tightly. Paths meet by their last name, so nothing is compared with all members."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    rows = asked.withColumn("_name", last("wanted")).join(members.withColumn("_name", last("path")), "_name", "left")
    fits = (F.col("path") == F.col("wanted")) | F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("wanted")))
    per = rows.groupBy("wanted").agg(F.count_if(F.coalesce(fits, F.lit(False))).alias("n"), F.min(F.when(fits, F.struct("path", "size", "packed"))).alias("m"))
    unsafe = F.col("m.path").startswith("/") | F.contains(F.col("m.path"), F.lit("\\")) | F.array_contains(F.split("m.path", "/"), "..")
    reason = F.when(F.col("n") == 0, "none").when(F.col("n") > 1, "several").when(unsafe, "unsafe path").when(F.col("m.size") > most, "too large").when(F.col("m.size") > F.greatest(F.col("m.packed"), F.lit(1)) * ratio, "packed too tightly")
    return per.select("wanted", F.when(reason.isNull(), F.col("m.path")).alias("path"), reason.alias("reason"))
