"""Text functions as column expressions: search tokens, token estimate, language, headings."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The search token (a number that isn't glued to letters, a word with inner signs, a run of Chinese characters), the
# Chinese ranges, and what numbered headings, Chinese chapters and items, and lines of contents look like.
TOKEN = r"[+-]?(?:\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?|\.\p{Nd}+)%?(?![a-z0-9_]|[-./+][a-z0-9])|[a-z0-9]+(?:[-_./+][a-z0-9]+)*%?|[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]"
NUMBERED = r"^([1-9]\p{Nd}{0,2}(?:\.\p{Nd}{1,3}){0,5})(?:[.．](?!\p{Nd})\s*|、\s*|\s+)(\S.*)$"
CHAPTER = r"^第[一二三四五六七八九十百零〇\p{Nd}]+([章节篇部])\s*"
ITEM = r"^(?:[一二三四五六七八九十百]+[、．.]|[（(][一二三四五六七八九十百]+[）)])\s*"
CONTENTS = r"^(.+?)(?:\.{2,}|…{2,}|·{3,}|\t+)\s*([0-9ivxlcdmIVXLCDM]{1,8})\s*$"


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def folded(text: Column) -> Column:
    """Compatibility forms resolved, case folded. Texts of ASCII never leave the JVM."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _folded(F.when(odd, text))).otherwise(F.lower(text))


def tokens(text: Column, most: int | None = None) -> Column:
    """Search tokens in order. Numbers lose their commas; a run of Chinese characters gives its characters, then its pairs. Null: null.
    A text of more than most tokens is an error, never cut."""
    found = F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0))
    bare = lambda t: F.replace(t, F.lit(","), F.lit(""))
    characters = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.lit(1)))
    pairs = lambda t: F.when(F.length(t) > 1, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    chinese = lambda t: t.between("\u3400", "\u9fff\uffff")
    split = F.flatten(F.transform(found, lambda t: F.when(chinese(t), F.concat(characters(t), pairs(t))).otherwise(F.array(bare(t)))))
    out = F.when(text.rlike(CJK), split).otherwise(F.transform(found, bare))
    return out if most is None else F.when(F.size(out) > most, F.raise_error(F.lit(f"over {most} tokens"))).otherwise(out)


def estimated_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and _ count a token for each 4 characters begun, any other visible character one."""
    runs = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+"), F.lit(0))
    inside = F.aggregate(runs, F.lit(0).cast("long"), lambda n, t: n + F.ceil(F.length(t) / 4))
    return inside + F.length(F.regexp_replace(text, r"[A-Za-z0-9_]+|\s", ""))


def language(text: Column, question: bool = False) -> Column:
    """zh, en, mixed or unknown by counts of Chinese and Latin letters, marks of HTML resolved; questions have lower thresholds."""
    plain = F.regexp_replace(text, r"<[^>]{1,2048}>", " ")
    escaped = plain.contains("&")
    plain = F.when(escaped, _unescaped(F.when(escaped, plain))).otherwise(plain)
    chinese, latin = F.regexp_count(plain, F.lit(CJK)), F.regexp_count(plain, F.lit("[A-Za-z]"))
    total = chinese + latin
    least, some, share = (8, 4, 0.2) if question else (24, 12, 0.5)
    return F.when(total < least, "unknown").when((chinese >= some) & (chinese / total >= share), "zh").when(latin / total >= 0.8, "en").otherwise("mixed")


def title_key(text: Column) -> Column:
    """What headings and lines of contents are matched by: without marks, chapter and item numbers, white space and case."""
    value = F.regexp_replace(F.trim(text), r"^#{1,6}\s+", "")
    value = F.regexp_replace(value, CHAPTER, "")
    value = F.regexp_replace(value, NUMBERED, "$2")
    value = F.regexp_replace(value, ITEM, "")
    return folded(F.regexp_replace(value, r"\s+", ""))


def heading_level(text: Column, is_title: Column) -> Column:
    """Level of a heading, null for other text: # marks, Chinese chapters and items, dotted numbers, or 1 for a title of the parser."""
    number = F.regexp_extract(text, NUMBERED, 1)
    short = is_title | ((F.length(text) <= 100) & ~text.rlike("[。；;！？!?]"))
    chapter = F.regexp_extract(text, CHAPTER, 1)
    return (
        F.when((F.length(text) == 0) | (F.length(text) > 200) | text.contains("\n") | text.rlike(CONTENTS), None)
        .when(text.rlike(r"^#{1,6}\s+\S"), F.length(F.regexp_extract(text, r"^(#{1,6})\s", 1)))
        .when(chapter != "", F.when(chapter == "节", 2).otherwise(1))
        .when(text.rlike(ITEM + r"\S"), F.when(F.substring(text, 1, 1).isin("（", "("), 2).otherwise(1))
        .when((number != "") & short, F.size(F.split(number, r"\.")))
        .when(is_title, 1)
    )


def contents_line(line: Column) -> Column:
    """title and label of a line of contents: leader dots, ellipses, middle dots or a tab, then a page label; null for other lines."""
    return F.when(line.rlike(CONTENTS), F.struct(F.regexp_extract(line, CONTENTS, 1).alias("title"), F.regexp_extract(line, CONTENTS, 2).alias("label")))


def markdown_assets(text: Column) -> Column:
    """Targets of the pictures of a Markdown text, in order; what stands in fences or between back ticks is code and doesn't count."""
    bare = F.regexp_replace(text, r"(?ms)^[ ]{0,3}(```|~~~).*?(?:^[ ]{0,3}\1[^\n]*$|\z)", "")
    bare = F.regexp_replace(bare, r"(`+)[^`]+\1", "")
    return F.regexp_extract_all(bare, F.lit(r"!\[[^\]]*\]\(\s*<?([^)>\s]+)"), F.lit(1))
