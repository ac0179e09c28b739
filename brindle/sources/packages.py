"""What Office packages hold, part by part, and the risks that follow for native parsing. A task lists a package's parts as rows; what they
mean is counted in SQL functions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a part is by its place in the package, and kinds that are rendered as a whole or can't be read natively.
PARTS = {"images": r"/media/", "drawings": r"/drawings/drawing", "charts": r"/charts/chart", "embedded": r"/embeddings/", "macros": r"vbaProject\.bin$", "formulas": r"/calcChain\.xml$", "notes": r"/(footnotes|endnotes|comments)\.xml$"}
VISUAL = ("doc", "ppt", "pptx", "xls", "jpg", "jpeg", "png")
NATIVE = ("docx", "xlsx", "csv", "txt", "md")

_RELATIONS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def parts(found: DataFrame) -> DataFrame:
    """path, part, bytes, of the parts of found(path, kind, content), and target, external of the relations they list. A package that doesn't
    open is one row with a null part."""

    def of(path: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as package:
            for info in package.infolist():
                yield path, info.filename, info.file_size, None, None
                if info.filename.endswith(".rels") and info.file_size < 1 << 24:
                    data = package.read(info)
                    for r in ElementTree.fromstring(data).iter(_RELATIONS) if b"<!" not in data else ():
                        yield path, info.filename, 0, r.get("Target"), r.get("TargetMode") == "External"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += list(of(path, bytes(content)))
                except (zipfile.BadZipFile, ElementTree.ParseError, OSError, RuntimeError, NotImplementedError):
                    rows.append((path, None, 0, None, None))
            yield pd.DataFrame(rows, columns=["path", "part", "bytes", "target", "external"])

    office = found.where(F.col("kind").isin("docx", "xlsx", "pptx")).select("path", "content")
    return office.mapInPandas(run, "path string, part string, bytes long, target string, external boolean")


def signals(listed: DataFrame) -> DataFrame:
    """path, a count for each kind of part, external (links that the package needs to be whole: pictures, sheets), links (web addresses and
    mail, which it doesn't), snapshots (external books whose last values are kept inside), broken."""
    kind = lambda pattern: F.count_if(F.col("target").isNull() & F.col("part").rlike(pattern))
    web = F.col("target").rlike(r"^(?i)(https?|mailto|ftp):") & ~F.col("target").rlike(r"(?i)\.(png|jpe?g|gif|bmp|emf|wmf|svg|xlsx?|docx?)([?#].*)?$")
    away = F.col("external") & ~web
    return listed.groupBy("path").agg(
        *[kind(p).alias(n) for n, p in PARTS.items()], F.count_if(away).alias("external"), F.count_if(F.col("external") & web).alias("links"),
        F.count_if(F.col("target").isNull() & F.col("part").rlike(r"/externalLinks/externalLink[0-9]+\.xml$")).alias("snapshots"), F.count_if(F.col("part").isNull()).alias("broken"),
    )


def risks(kind: Column) -> Column:
    """Names of the risks of a row of signals(), in order."""
    named = lambda name, rule: F.when(rule, name)
    has = lambda c: F.col(c) > 0
    upper = F.upper(kind)
    return F.array_compact(F.array(
        named("PACKAGE_BROKEN", has("broken")), F.when(has("external") & ~has("snapshots"), "EXTERNAL_ATTACHMENT_MISSING"), F.when(has("snapshots"), "XLSX_HAS_EXTERNAL_LINK"),
        *[F.when(has(c), F.concat(upper, F.lit(f"_HAS_{name}"))) for c, name in (("images", "IMAGE"), ("drawings", "DRAWING"), ("charts", "CHART"), ("embedded", "EMBEDDED_OBJECT"))],
        F.when(has("notes") & (kind == "docx"), "DOCX_HAS_NOTES"),
    ))


def dispatch(kind: Column, content_reason: Column) -> Column:
    """struct reader, refused: which reader takes a file (text, markdown, csv, docx, xlsx), or why none does."""
    refused = F.when(content_reason.isNotNull(), content_reason).when(kind.isin(*VISUAL), "no native reader").when(kind == "pdf", "PDF text isn't read here").when(~kind.isin(*NATIVE), "unknown format")
    return F.struct(F.when(refused.isNull(), F.when(kind == "txt", "text").when(kind == "md", "markdown").otherwise(kind)).alias("reader"), refused.alias("refused"))


def same_document(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of asked(doc_id, kind) with whole: whether exactly one envelope of parsed(doc_id, kind) names the document and its kind."""
    one = parsed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("found"))
    return asked.join(one, "doc_id", "left").withColumn("whole", F.coalesce((F.col("n") == 1) & (F.col("found") == F.col("kind")), F.lit(False))).drop("n", "found")
