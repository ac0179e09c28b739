"""Readers and writers: explicit schemas, nothing inferred, bad input rejected as a whole."""

from __future__ import annotations

import csv
import io
import re
import tempfile
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The accepted formats and what their files begin with; Office packages by their main part.
FORMATS = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "csv", "txt", "md", "jpg", "jpeg", "png")
MAGIC = {"pdf": b"%PDF-", "png": b"\x89PNG\r\n\x1a\n", "jpg": b"\xff\xd8\xff", "jpeg": b"\xff\xd8\xff", "doc": b"\xd0\xcf\x11\xe0", "xls": b"\xd0\xcf\x11\xe0", "ppt": b"\xd0\xcf\x11\xe0"}
MAIN_PART = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml"}
#: An Office package may unpack to this many times its size, and hold this many parts.
UNPACKED, PARTS = 100, 10_000


#: Folders of sessions on one machine that name none, by application.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, which only a session on one machine may leave it, a new one for the
    session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        found = _own.setdefault(app, _own.get(app) or f"file://{tempfile.mkdtemp(prefix='brindle-')}")
    return found.rstrip("/")


def content_reason(content: bytes, kind: str) -> str | None:
    """Why these bytes aren't a file of this kind; null if they are."""
    if kind not in FORMATS:
        return "unknown format"
    if not content:
        return "empty"
    if kind in MAGIC:
        return None if content.startswith(MAGIC[kind]) else "wrong signature"
    if kind in MAIN_PART:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as package:
                parts = package.infolist()
        except zipfile.BadZipFile:
            return "not a package"
        if len(parts) > PARTS or sum(p.file_size for p in parts) > UNPACKED * max(1 << 20, len(content)):
            return "unpacks too large"
        return None if any(p.filename == MAIN_PART[kind] for p in parts) else "main part missing"
    return None if decoded(content) is not None else "not text"


def decoded(content: bytes) -> str | None:
    """Text by its byte order mark, else as UTF-8, else as GB18030; null with control characters or no valid reading."""
    marks = ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
    tried = [e for m, e in marks if content.startswith(m)][:1] or ["utf-8", "gb18030"]
    for encoding in tried:
        try:
            text = content.decode(encoding)
        except UnicodeDecodeError:
            continue
        return None if any(ord(c) < 32 and c not in "\t\n\r\f" for c in text) else text
    return None


def files(spark: SparkSession, path: str, kinds: Sequence[str] = FORMATS) -> DataFrame:
    """path, kind, length, content of the accepted files below a folder."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", kind.alias("kind"), "length", "content").where(F.col("kind").isin(*kinds))


def checked(found: DataFrame) -> DataFrame:
    """files() with the reason a file is rejected for."""

    @F.pandas_udf("string")
    def reason(content: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([content_reason(c, k) for c, k in zip(content, kind)], dtype=object)

    return found.withColumn("reason", reason("content", "kind"))


def text_of(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        return pd.Series([decoded(c) for c in contents], dtype=object)

    return run(content)


def paragraphs(found: DataFrame) -> DataFrame:
    """path, block_index, text of the blank-line separated blocks of text files."""
    parts = F.filter(F.split(text_of(F.col("content")), r"\r?\n[ \t]*\r?\n+"), lambda x: F.trim(x) != "")
    return found.where(F.col("kind").isin("txt", "md")).select("path", F.posexplode(parts).alias("i", "text")).select("path", (F.col("i") + 1).alias("block_index"), "text")


def markdown_blocks(text: str) -> list[tuple[str, str, str]]:
    """(block type, section path, text) of a Markdown text: # and underlined headings open sections, fences are text."""
    out: list[tuple[str, str, str]] = []
    stack: list[str] = []
    held: list[str] = []
    fence = ""

    def flush() -> None:
        if "".join(held).strip():
            out.append(("text", " / ".join(x for x in stack if x), "\n".join(held).strip("\n")))
        held.clear()

    def heading(level: int, title: str) -> None:
        flush()
        del stack[level - 1 :]
        stack.extend([""] * (level - 1 - len(stack)) + [title])
        out.append(("title", " / ".join(x for x in stack if x), title))

    for line in text.splitlines():
        mark = line.lstrip()[:3]
        if fence or mark in ("```", "~~~"):
            fence = "" if fence == mark else fence or mark
            held.append(line)
        elif (n := len(line) - len(line.lstrip("#"))) and n <= 6 and line[n : n + 1] in (" ", "\t") and line[n:].strip():
            heading(n, line[n:].strip().rstrip("#").strip())
        elif held and held[-1].strip() and line.strip() and set(line.strip()) in ({"="}, {"-"}):
            title = held.pop().strip()
            heading(1 if line.strip()[0] == "=" else 2, title)
        elif not line.strip():
            flush()
        else:
            held.append(line)
    flush()
    return out


def markdown(found: DataFrame) -> DataFrame:
    """path, block_index, block_type, section, text of Markdown files."""

    def run(parts):
        for part in parts:
            rows = [(p, i, *b) for p, c in zip(part["path"], part["content"]) for i, b in enumerate(markdown_blocks(decoded(c) or ""), 1)]
            yield pd.DataFrame(rows, columns=["path", "block_index", "block_type", "section", "text"])

    return found.where("kind = 'md'").select("path", "content").mapInPandas(run, "path string, block_index int, block_type string, section string, text string")


def strict_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file of exactly this schema; a row that doesn't fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("header", "true").option("enforceSchema", "false").csv(path)


def csv_table(text: str, separator: str = ",", rows: int = 100_000, columns: int = 1_024) -> tuple[str | None, int, int, str | None]:
    """A strict CSV text as a quoted tab-separated table, its rows and columns; or a reason: open quotes, rows of different lengths, limits."""
    out, wide, n = io.StringIO(), None, 0
    made = csv.writer(out, delimiter="\t", lineterminator="\n")
    try:
        for row in csv.reader(io.StringIO(text, newline=""), delimiter=separator, strict=True):
            wide = len(row) if wide is None else wide
            n += 1
            if len(row) != wide:
                return None, 0, 0, f"row {n} has {len(row)} cells, not {wide}"
            if n > rows or wide > columns:
                return None, 0, 0, "too many rows or columns"
            made.writerow(row)
    except csv.Error as e:
        return None, 0, 0, str(e)
    return (None, 0, 0, "empty") if not n else (out.getvalue(), n, wide, None)


def csv_blocks(found: DataFrame) -> DataFrame:
    """path, text (a quoted tab-separated table), rows, columns, reason of the CSV files of files(); a file is one table block or a reason."""

    def run(parts):
        for part in parts:
            made = [(p, *(csv_table(t) if (t := decoded(c)) is not None else (None, 0, 0, "not text"))) for p, c in zip(part["path"], part["content"])]
            yield pd.DataFrame(made, columns=["path", "text", "rows", "columns", "reason"])

    return found.where("kind = 'csv'").select("path", "content").mapInPandas(run, "path string, text string, rows int, columns int, reason string")


def benchmark_rows(spark: SparkSession, path: str, kind: str, schema: str, rows: int = 1_000_000, most_bytes: int = 1 << 30) -> DataFrame:
    """Rows of a benchmark file (json: one array or object, jsonl, parquet) of exactly this schema. ValueError beyond rows, or beyond most_bytes of
    decoded text (json and jsonl: all lines; parquet: strings and binaries), never a part."""
    if kind == "parquet":
        found = spark.read.parquet(path)
        missing = [f.name for f in StructType.fromDDL(schema) if f.name not in found.columns]
        if missing:
            raise ValueError(f"no columns {missing}")
        found = found.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(schema)])
    else:
        found = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", str(kind == "json").lower()).json(path)
    if found.limit(rows + 1).count() > rows:
        raise ValueError(f"over {rows} rows")
    wide = [f.name for f in found.schema if f.dataType.simpleString() in ("string", "binary")] if kind == "parquet" else ["value"]
    text = found if kind == "parquet" else spark.read.text(path)
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in wide), F.lit(0))
    if (text.agg(F.sum(size)).first()[0] or 0) > most_bytes:
        raise ValueError(f"over {most_bytes} bytes")
    return found


def strict_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions of path that df has rows of, and no others, in one commit."""
    df.write.partitionBy(by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def report(df: DataFrame, path: str, kind: str = "json") -> None:
    """One small file of a report: json or csv."""
    getattr(df.coalesce(1).write.mode("overwrite").option("header", "true"), kind)(path)
