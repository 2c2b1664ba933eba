"""Files that the operators read and write, as tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLOSSARY = "source string, target string, target_language string"


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """SRC-GLOSS, SRC-GLOSS-EPUB: source, target, target_language of CSV files with a header; a byte order mark,
    blanks around values and an absent language column are tolerated; rows without a source or target go."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    names = {c.replace("﻿", "").strip().lower(): c for c in raw.columns}
    if not {"source", "target"} <= names.keys():
        raise ValueError(f"a glossary needs the columns source and target, not {raw.columns}")
    clean = lambda n: F.trim(F.regexp_replace(F.col(f"`{names[n]}`"), "^\\uFEFF", ""))
    language = next((names[n] for n in ("target_language", "tgt_lng") if n in names), None)
    out = raw.select(clean("source").alias("source"), clean("target").alias("target"), (F.nullif(F.trim(F.col(f"`{language}`")), F.lit("")) if language else F.lit(None).cast("string")).alias("target_language"))
    return out.where("source <> '' and target <> ''")


def write_glossary(entries: DataFrame, path: str) -> None:
    """SNK-GLOSS, SNK-TERMS: CSV files with a header."""
    entries.select("source", "target", F.coalesce("target_language", F.lit("")).alias("tgt_lng")).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_trackers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-TRACK: JSON files of a tree of folders; bytes after the object are tolerated, bad files give null."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("tracker"))


def write_trackers(rows: DataFrame, path: str) -> None:
    """SNK-TRACK, SNK-IL: one JSON object a line."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def read_document_xml(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """SRC-IL: pages of document XML."""
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


_CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
_OPF = "{http://www.idpf.org/2007/opf}"


def epub_items(data: bytes) -> Iterator[dict]:
    """Manifest items of an EPUB with their place in the reading order (null if they have none)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = root.find(f".//{_CONTAINER}rootfile").attrib["full-path"]
        folder = opf.rpartition("/")[0]
        package = ElementTree.fromstring(z.read(opf))
        spine = {r.attrib["idref"]: (k, r.attrib.get("linear", "yes")) for k, r in enumerate(package.iter(f"{_OPF}itemref"))}
        for item in package.iter(f"{_OPF}item"):
            href = f"{folder}/{item.attrib['href']}".lstrip("/")
            at, linear = spine.get(item.attrib["id"], (None, None))
            try:
                content = z.read(href)
            except KeyError:
                content = None
            yield {"id": item.attrib["id"], "href": href, "media_type": item.attrib.get("media-type"), "at": at, "linear": linear, "content": content}


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """SRC-EPUB: path, id, href, media_type, at, linear, content of the members of EPUB files."""

    def run(batches):
        for pdf in batches:
            rows = [{"path": p} | item for p, data in zip(pdf["path"], pdf["content"], strict=True) for item in epub_items(bytes(data))]
            yield pd.DataFrame(rows, columns=["path", "id", "href", "media_type", "at", "linear", "content"]).astype({"at": "Int64"})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, id string, href string, media_type string, at long, linear string, content binary")


def epub_spine(items: DataFrame) -> DataFrame:
    """SRC-EPUB-spine: XHTML members in reading order, without those marked as not linear."""
    return items.where((F.col("media_type") == "application/xhtml+xml") & F.col("at").isNotNull() & (F.coalesce("linear", F.lit("yes")) != "no"))


def write_epub(items: list[tuple[str, bytes]]) -> bytes:
    """SNK-EPUB: an archive with its type first and uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", b"application/epub+zip", zipfile.ZIP_STORED)
        for name, data in items:
            if name != "mimetype":
                z.writestr(name, data)
    return out.getvalue()


def merge_parts(parts: DataFrame, part: str = "part") -> DataFrame:
    """SNK-MERGE: results of parts in order; parts without a result are left out."""
    return parts.where(F.col("result").isNotNull()).orderBy(part)
