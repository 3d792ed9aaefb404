"""Connectors that poll another system and mount what they find at a path of the catalog.

A connector has a client (a callable the caller gives: network code stays out of plans), turns its answer into
documents, transforms them, and replaces the subtree at its path. Nothing is written where nothing changed.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from lodestar.operators.catalog import Catalog
from lodestar.sources.files import document_tree, parse_any, parse_document


def interval_seconds(text: str | float | None, default: float = 30.0, least: float = 1.0) -> float:
    """``"30s"``, ``"5m"``, ``"1h30m"`` or a number; never below ``least``."""
    if text is None:
        return default
    if isinstance(text, int | float):
        return max(least, float(text))
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return max(least, sum(float(a) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[b] for a, b in parts))


@dataclass
class Connector:
    """``poll()`` gives new documents or None for no change; ``mount`` writes them."""

    name: str
    path: str
    poll: Callable[[], Any]
    transform: Callable[[Any, Any], Any] | None = None
    interval: str | float | None = None
    state: Any = None
    status: str = "NOT_READY"
    error: str | None = None

    @property
    def seconds(self) -> float:
        return interval_seconds(self.interval)

    def refresh(self) -> bool:
        """Whether the state changed. A failing poll keeps the last state."""
        try:
            found = self.poll()
        except Exception as e:  # noqa: BLE001 - a connector reports any failure of its client
            self.status, self.error = "ERROR", str(e)
            return False
        self.status, self.error = "OK", None
        if found is None:
            return False
        new = self.transform(found, self.state) if self.transform else found
        if new is None:  # an empty transform leaves the state as it is
            return False
        self.state = new
        return True

    def mount(self, spark: SparkSession, catalog: Catalog, to_frame: Callable[[SparkSession, Any], DataFrame]) -> bool:
        if not self.refresh():
            return False
        catalog.mount(self.path, to_frame(spark, self.state), owner=self.name)
        return True


def http(fetch: Callable[[Mapping[str, str]], tuple[int, Mapping[str, str], str]], headers: Mapping[str, str] | None = None) -> Callable[[], Any]:
    """``fetch(headers)`` answers (status, headers, body). Uses the entity tag; 304 is no change, 400 and more fail."""
    tag: list[str] = []

    def poll() -> Any:
        status, answer, body = fetch({**(headers or {}), **({"If-None-Match": tag[0]} if tag else {})})
        if status == 304:
            return None
        if status >= 400:
            raise RuntimeError(f"HTTP status {status}")
        tag[:] = [v for k, v in answer.items() if k.lower() == "etag"]
        return parse_any(body)

    return poll


def objects(list_keys: Callable[[], Sequence[str]], read: Callable[[str], str], prefix: str = "") -> Callable[[], Any]:
    """Object stores and checkouts: one key is its document, several are a tree by key. Other files are skipped."""
    last: list[Any] = []

    def poll() -> Any:
        rows = []
        for key in sorted(list_keys()):
            try:
                rows.append((key, parse_document(key, read(key))))
            except ValueError:
                continue
        if not rows:
            return None
        tree = document_tree(rows, prefix)
        if last and last[0] == tree:
            return None
        last[:] = [tree]
        return tree

    return poll


def git_ref(refs: Mapping[str, str], commit: str | None = None, branch: str | None = None, reference: str | None = None) -> str:
    """The commit to read: commit before branch before reference before main or master."""
    if commit:
        return commit
    for name in ([f"refs/heads/{branch}"] if branch else []) + ([reference] if reference else []) + ["refs/heads/main", "refs/heads/master"]:
        if name in refs:
            return refs[name]
    raise RuntimeError("no such reference")


def ldap_documents(entries: Sequence[tuple[str, Mapping[str, Sequence[str]]]]) -> list[dict]:
    """Attributes as arrays; the name split by type, with the raw text."""
    out = []
    for dn, attributes in entries:
        parts: dict[str, Any] = {"_raw": dn}
        for part in re.split(r"(?<!\\),", dn):
            kind, _, value = part.strip().partition("=")
            parts.setdefault(kind.lower(), []).append(value)
        out.append({"dn": parts} | {k: list(v) for k, v in attributes.items()})
    return out


def mongodb_documents(docs: Sequence[Mapping]) -> dict[str, dict]:
    """By ``_id`` (as JSON text where it is no string); documents without one are skipped."""
    return {d["_id"] if isinstance(d["_id"], str) else json.dumps(d["_id"], default=str): {k: v for k, v in d.items() if k != "_id"} for d in docs if "_id" in d}


def okta_documents(client: Mapping[str, Callable], wanted: Sequence[str] = ("users", "groups", "roles", "apps")) -> dict:
    """All collections, or an error: nothing is replaced by half an answer."""
    out = {name: list(client[name]()) for name in wanted}
    if "groups" in out and "group_members" in client:
        out["group-members"] = {g["id"]: list(client["group_members"](g["id"])) for g in out["groups"]}
    return out


class ClientSource(DataSource):
    """A batch source over a client that every executor can build: ``option("client", "module:function")``.

    ``function(options)`` returns an object with ``slices()`` (how many parts) and ``rows(number)`` (its tuples)."""

    @classmethod
    def name(cls) -> str:
        return "client"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _ClientReader(self.options)


class _ClientReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str]):
        self.options = dict(options)

    def _client(self) -> Any:
        module, _, name = self.options["client"].partition(":")
        return getattr(importlib.import_module(module), name)(self.options)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self._client().slices())]

    def read(self, partition: InputPartition):
        yield from self._client().rows(partition.value)


class MessageSource(DataSource):
    """A stream over a message client (such as a Pulsar consumer): ``option("client", "module:function")``.

    ``function(options)`` returns an object with ``read(after, most)``: messages after a position (id, key, topic,
    producer, timestamp, value), at most so many, and the new position. Positions are numbers that only grow, so that a
    batch can be read again after a failure."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "id string, key string, topic string, producer string, timestamp long, value string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802 - Spark's name
        return _MessageReader(self.options)


class _MessageReader(SimpleDataSourceStreamReader):
    def __init__(self, options: Mapping[str, str]):
        module, _, name = options["client"].partition(":")
        self.client = getattr(importlib.import_module(module), name)(dict(options))
        self.most = int(options.get("batch", "200"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"position": 0}

    def read(self, start: dict):
        rows, position = self.client.read(start["position"], self.most)
        return iter(rows), {"position": position}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        at = start["position"]
        while at < end["position"]:
            rows, at = self.client.read(at, end["position"] - at)
            yield from rows


def kafka_messages(raw: DataFrame) -> DataFrame:
    """Messages as rules see them: key and value as text, headers with text values, topic, unix seconds."""
    headers = "transform(headers, h -> named_struct('key', h.key, 'value', cast(h.value AS string))) AS headers"
    return raw.selectExpr("cast(key AS string) AS key", "cast(value AS string) AS value", headers, "topic", "unix_seconds(timestamp) AS timestamp")


def kafka_stream(spark: SparkSession, servers: str, topics: Sequence[str], start: str = "earliest", options: Mapping[str, str] | None = None) -> DataFrame:
    """A stream of ``kafka_messages`` (needs Spark's connector on the class path)."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("includeHeaders", "true")
    return kafka_messages(source.option("startingOffsets", start).options(**(options or {})).load())
