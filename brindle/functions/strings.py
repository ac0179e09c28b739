"""Identifiers, comparison forms and guards of texts as column expressions; strict JSON as an Arrow-batched check."""

from __future__ import annotations

import json
import math
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Longest texts and largest tables of cells that an edit distance is computed for.
EDIT_CHARS, EDIT_CELLS = 10_000, 2_000_000


def name_uuid(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name: the first 16 bytes of a SHA-1, with the bits of version and variant set. Null: null."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda at, n: F.substring(digest, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), F.substring(variant, -1, 1), part(18, 3), F.lit("-"), part(21, 12))


def bounded_distance(a: Column, b: Column) -> Column:
    """Edit distance of characters; null where a text or the product of both lengths is beyond the bounds."""
    n, m = F.length(a).cast("long"), F.length(b).cast("long")
    return F.when((F.greatest(n, m) <= EDIT_CHARS) & (n * m <= EDIT_CELLS), F.levenshtein(a, b))


def bare_latex(text: Column) -> Column:
    """A formula without the signs around it and without white space, for exact comparison."""
    inner = F.regexp_replace(F.trim(text), r"^(\$\$|\$|\\\[|\\\()|(\$\$|\$|\\\]|\\\))$", "")
    return F.regexp_replace(inner, r"\s+", "")


def query_reason(text: Column, most: int = 32_768) -> Column:
    """Why a search text is refused, null if it isn't: it stays as it is, white space at its ends too."""
    return F.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.length(text) > most, "too long").when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"), "control characters")


def allowed_fields(fields: Column, kinds: dict[str, int]) -> Column:
    """Of a map of strings, the keys in kinds, their values cut to the length that stands there."""
    most = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    kept = F.map_filter(fields, lambda k, v: F.array_contains(F.map_keys(most), k) & v.isNotNull())
    return F.transform_values(kept, lambda k, v: F.substring(v, F.lit(1), F.try_element_at(most, k)))


def _strict(text: str | None) -> str | None:
    def unique(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    def finite(text: str) -> float:
        value = float(text)
        if not math.isfinite(value):
            raise ValueError("not finite")
        return value

    def refused(text: str):
        raise ValueError("not finite")

    if text is None:
        return "null"
    try:
        text.encode("utf-8")
        json.dumps(json.loads(text, object_pairs_hook=unique, parse_float=finite, parse_constant=refused), ensure_ascii=False).encode("utf-8")
    except (ValueError, RecursionError) as e:
        said = str(e)
        return said if said in ("repeated key", "not finite") else "not JSON"
    return None


@F.pandas_udf(StringType())
def json_reason(texts: pd.Series) -> pd.Series:
    """Why a text is no strict JSON, null if it is one: repeated keys, numbers that aren't finite, broken characters."""
    return texts.map(_strict, na_action=None)
