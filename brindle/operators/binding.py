"""What an answer or a calculation is bound to: evidence within a budget, claims to citations, variables to quotes. All joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formula import number_literal


def within_budget(evidence: DataFrame, by: str, order: str, size: Column, limit: int, most: int = 100) -> DataFrame:
    """evidence with taken: in order (a number), what still fits beside all that was taken before it; what doesn't fit is passed over. Only
    the first most of each by are looked at, as search returns no more; the others aren't taken. A null size doesn't fit."""
    rows = evidence.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(order)))
    asked = rows.where(F.col("_place") <= most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_place", size.cast("long").alias("n")))).alias("x"))
    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("places"))

    def take(held, x):
        fits = F.coalesce(held["used"] + x["n"] <= limit, F.lit(False))
        return F.when(fits, F.struct((held["used"] + x["n"]).alias("used"), F.array_append(held["places"], x["_place"]).alias("places"))).otherwise(held)

    taken = asked.select(F.col(by).alias("_by"), F.explode(F.aggregate("x", none, take)["places"]).alias("_taken"))
    joined = rows.join(taken, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_place") == F.col("_taken")), "left")
    return joined.withColumn("taken", F.col("_taken").isNotNull()).drop("_place", "_by", "_taken")


# What a claim's text may not hold, control characters and citation numbers of its own.
_CONTROL, _NUMBERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", r"\[\s*[0-9]+(?:\s*[,\-]\s*[0-9]+)*\s*\]"


def bound_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, status, answer, citations of claims(answer_id, place, text, evidence_ids) and evidence(answer_id, evidence_id).

    A claim is sound if its text isn't blank and has no control characters or citation numbers, and its ids are different and all among the
    answer's evidence; one that isn't fails its answer. Ids are numbered by their first use, in claims and in them; the answer is the claims, each
    with its markers, and citations the ids by number. A claim without ids has no marker; an answer without claims isn't returned. Places are
    different within an answer."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sound = (F.trim(F.regexp_replace(text, r"\s", " ")) != "") & ~text.rlike(_CONTROL) & ~text.rlike(_NUMBERS) & (F.size(F.array_distinct("evidence_ids")) == F.size("evidence_ids"))
    rows = claims.select("answer_id", "place", text.alias("text"), F.coalesce("evidence_ids", F.array().cast(claims.schema["evidence_ids"].dataType)).alias("evidence_ids")).withColumn("sound", sound)
    uses = rows.select("answer_id", "place", F.posexplode("evidence_ids").alias("i", "evidence_id"))
    there = evidence.select("answer_id", "evidence_id").distinct().withColumn("known", F.lit(True))
    first = uses.groupBy("answer_id", "evidence_id").agg(F.min(F.struct("place", "i")).alias("at")).join(there, ["answer_id", "evidence_id"], "left")
    first = first.withColumn("number", F.row_number().over(Window.partitionBy("answer_id").orderBy("at")))
    named = uses.join(first.select("answer_id", "evidence_id", "number"), ["answer_id", "evidence_id"])
    marks = named.groupBy("answer_id", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "number"))), lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("]"))), "").alias("marks"))
    said = rows.join(marks, ["answer_id", "place"], "left").withColumn("said", F.concat("text", F.lit(" "), F.coalesce("marks", F.lit(""))))
    whole = said.groupBy("answer_id").agg(F.bool_and("sound").alias("sound"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "said"))), lambda x: x["said"]), "\n\n").alias("answer"))
    cited = first.groupBy("answer_id").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("known"), F.transform(F.array_sort(F.collect_list(F.struct("number", "evidence_id"))), lambda x: x["evidence_id"]).alias("citations"))
    good = F.col("sound") & F.coalesce("known", F.lit(True))
    both = whole.join(cited, "answer_id", "left").withColumn("good", good)
    return both.select("answer_id", F.when(F.col("good"), "success").otherwise("failed").alias("status"), F.when(F.col("good"), F.col("answer")).alias("answer"), F.when(F.col("good"), F.coalesce("citations", F.array().cast(claims.schema["evidence_ids"].dataType))).alias("citations"))


def once(text: Column, part: Column) -> Column:
    """Where part begins in text, from 0, if it occurs exactly once, else null. Overlapping places count."""
    at = F.call_function("locate", part, text)
    return F.when((F.length(part) > 0) & (at > 0) & (F.call_function("locate", part, text, at + 1) == 0), at - 1)


def bound_variables(formulas: DataFrame, inputs: DataFrame, blocks: DataFrame) -> DataFrame:
    """formula_id, status, variables, missing of formulas(formula_id, variables) and inputs(formula_id, name, value, block_id, quote).

    An input of a user has a value only; one from a document also a block and a quote, which must occur exactly once in the text of
    blocks(block_id, text), and the value exactly once in the quote. Statuses, the first that holds: unknown (a name isn't a variable of the
    formula), conflict (a name has two inputs), input (a value isn't a number), source (a quote isn't bound), need_variables, success. variables
    are name, value (as a canonical number), begin and end of it in the block (null for users'), sorted by name, for the last two statuses only;
    missing the names without input, sorted. Inputs of formulas that aren't there are left out."""
    text = blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("block_text")).where("n = 1")
    rows = inputs.join(formulas.select("formula_id", "variables"), "formula_id").join(text.select("block_id", "block_text"), "block_id", "left")
    quoted = F.col("quote").isNotNull() | F.col("block_id").isNotNull()
    begin = once(F.col("block_text"), F.col("quote")) + once(F.col("quote"), F.col("value"))
    rows = rows.withColumns({"number": number_literal(F.col("value")), "begin": F.when(quoted, begin), "known": F.array_contains("variables", F.col("name")), "bound": ~quoted | begin.isNotNull()})
    one = F.struct("name", F.col("number").alias("value"), "begin", (F.col("begin") + F.length("value")).alias("end"))
    per = rows.groupBy("formula_id").agg(
        F.bool_and(F.coalesce("known", F.lit(False))).alias("known"), (F.count(F.lit(1)) == F.count_distinct("name")).alias("single"),
        F.bool_and(F.col("number").isNotNull()).alias("numbers"), F.bool_and(F.coalesce("bound", F.lit(False))).alias("bound"),
        F.array_sort(F.collect_list(one)).alias("found"), F.collect_set("name").alias("names"),
    )
    both = formulas.select("formula_id", "variables").join(per, "formula_id", "left")
    missing = F.array_sort(F.array_except("variables", F.coalesce("names", F.array().cast("array<string>"))))
    yes = lambda c: F.coalesce(c, F.lit(True))
    status = F.when(~yes("known"), "unknown").when(~yes("single"), "conflict").when(~yes("numbers"), "input").when(~yes("bound"), "source").when(F.size(missing) > 0, "need_variables").otherwise("success")
    done = both.withColumn("status", status).withColumn("ok", F.col("status").isin("need_variables", "success"))
    return done.select("formula_id", "status", F.when(F.col("ok"), F.coalesce("found", F.expr("cast(array() as array<struct<name:string,value:string,begin:int,end:int>>)"))).alias("variables"), F.when(F.col("ok"), missing).alias("missing"))
