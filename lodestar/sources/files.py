"""Document files: JSON, YAML and XML, as one document each or as a tree by path; change detection by content."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("json", "yaml", "yml", "xml")


def _yaml(text: str) -> Any:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML files need pyyaml") from e
    return yaml.safe_load(text)


def xml_document(text: str) -> Any:
    """Elements as objects: attributes under ``-name``, text under ``#text``, repeated children as arrays."""

    def convert(e: ElementTree.Element) -> Any:
        out: dict[str, Any] = {f"-{k}": v for k, v in e.attrib.items()}
        for child in e:
            value = convert(child)
            if child.tag in out:
                out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
            else:
                out[child.tag] = value
        text = (e.text or "").strip()
        if not out:
            return text
        return out | ({"#text": text} if text else {})

    root = ElementTree.fromstring(text)
    return {root.tag: convert(root)}


def parse_document(name: str, text: str) -> Any:
    """By extension. Other extensions raise ``ValueError``."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind == "json":
        return json.loads(text)
    if kind in ("yaml", "yml"):
        return _yaml(text)
    if kind == "xml":
        return xml_document(text)
    raise ValueError(f"{name}: not a document file")


def parse_any(text: str) -> Any:
    """A body of unknown type: XML if it is, else JSON, else YAML."""
    if text.lstrip().startswith("<"):
        try:
            return xml_document(text)
        except ElementTree.ParseError:
            pass
    try:
        return json.loads(text)
    except ValueError:
        return _yaml(text)


def read_documents(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """One row per document file below a path: path, document (JSON text), sha256, error.

    Files are read and parsed on the executors; other extensions are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    wanted = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*EXTENSIONS))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, errors = [], []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    docs.append(json.dumps(parse_document(name, bytes(content).decode()), sort_keys=True, separators=(",", ":"), default=str))
                    errors.append(None)
                except (ValueError, ElementTree.ParseError, RuntimeError) as e:
                    docs.append(None)
                    errors.append(str(e))
            yield pd.DataFrame({"path": pdf["path"], "document": docs, "sha256": pdf["sha256"], "error": errors})

    return wanted.select("path", "content", F.sha2("content", 256).alias("sha256")).mapInPandas(parse, "path string, document string, sha256 string, error string")


def document_tree(rows: list[tuple[str, Any]], root: str = "") -> Any:
    """Documents nested by their path below ``root``; a single one is the document itself."""
    if len(rows) == 1:
        return rows[0][1]
    out: dict = {}
    for path, doc in rows:
        parts = [p for p in path.removeprefix(root).strip("/").split("/") if p]
        at = out
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = doc
    return out


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Paths whose content differs: path, change (added, removed, changed)."""
    a, b = before.select("path", F.col("sha256").alias("old")), now.select("path", F.col("sha256").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change IS NOT NULL")


def load_bundle(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Multi-line JSON documents with a schema (given, or inferred)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)
