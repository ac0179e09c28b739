"""Which texts hold which passages, literally: one pass over the texts for each part of the passages of bounded size."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of passages in one pass; a longer passage is a pass of its own.
PASS_BYTES = 16 << 20


def flat(text: str) -> str:
    """Composed characters, runs of white space as one space, none at the ends."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()


def _parts(passages: DataFrame, limit: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of passages(item, text), in lists of at most limit bytes and one passage."""
    size = F.octet_length("text") + 16
    n = max(1, -(-(passages.agg(F.sum(size)).first()[0] or 0) // limit))
    dealt = passages.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    upto = F.sum(size).over(Window.partitionBy("bucket").orderBy("item", "text"))
    rows = dealt.withColumn("part", F.floor(upto / F.lit(limit))).orderBy("bucket", "part", "item", "text").toLocalIterator()
    for _, own in groupby(rows, key=lambda r: (r.bucket, r.part)):
        held = list(own)
        yield [r.item for r in held], [r.text for r in held]


def contained(texts: DataFrame, passages: DataFrame, *, by: str, item: str, text: str = "text", flatten: bool = False, limit: int = PASS_BYTES) -> DataFrame:
    """by, item: each row of texts(by, text) with the different rows of passages(item, text) that it holds; with flatten both are compared
    flat(). Nulls hold nothing and aren't held; an empty passage is in every text. Passages go to the tasks as a search tree; texts
    stay where they are, of any length and letters."""
    wanted = passages.select(F.col(item).alias("item"), F.col("text")).where("text is not null").distinct()
    there = texts.select(F.col(by).alias("_by"), F.col(text).alias("_text")).where("_text is not null")
    kinds = f"_by {there.schema['_by'].dataType.simpleString()}, _item {wanted.schema['item'].dataType.simpleString()}"
    context, out = texts.sparkSession.sparkContext, None
    for ids, words in _parts(wanted, limit):
        sent = context.broadcast((ids, [flat(w) for w in words] if flatten else words))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            import ahocorasick

            ids, words = sent.value
            tree, of = ahocorasick.Automaton(), {}
            for i, w in zip(ids, words):
                of.setdefault(w, []).append(i)
            for w in of:
                if w:
                    tree.add_word(w, w)
            tree.make_automaton()
            for batch in batches:
                rows = []
                for key, value in zip(batch["_by"], batch["_text"]):
                    value = flat(value) if flatten else value
                    held = {w for _, w in tree.iter(value)} if len(tree) else set()
                    rows += [(key, i) for w in (held | {""} if "" in of else held) for i in of[w]]
                yield pd.DataFrame(rows, columns=["_by", "_item"])

        found = there.mapInPandas(run, kinds)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = texts.sparkSession.createDataFrame([], kinds)
    return out.select(F.col("_by").alias(by), F.col("_item").alias(item))
