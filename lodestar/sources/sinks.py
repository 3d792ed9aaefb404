"""Sinks of decision events: files by time, consoles, and anything that takes batches of JSON lines."""

from __future__ import annotations

import gzip
import json
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Sink = Callable[[DataFrame, int], None]


def batches(lines: Sequence[str], count: int = 0, size: int = 0) -> list[list[str]]:
    """Lines in order, cut at ``count`` lines or ``size`` bytes (0: no limit); a longer line stands alone."""
    out: list[list[str]] = []
    held = 0
    for line in lines:
        n = len(line.encode())
        if not out or (count and len(out[-1]) >= count) or (size and out[-1] and held + n > size):
            out.append([])
            held = 0
        out[-1].append(line)
        held += n
    return out


def body(lines: Sequence[str], form: str = "lines", compress: bool = False) -> bytes:
    """``lines``, ``array`` or ``none`` (one event), gzipped if asked."""
    data = ("[" + ",".join(lines) + "]" if form == "array" else "\n".join(lines) + "\n" * (form == "lines")).encode()
    return gzip.compress(data, mtime=0) if compress else data


def with_retry(send: Callable[[bytes], None], tries: int = 3, wait: float = 0.1, sleep: Callable[[float], None] = time.sleep) -> Callable[[bytes], None]:
    def run(data: bytes) -> None:
        for i in range(tries):
            try:
                return send(data)
            except Exception:
                if i + 1 == tries:
                    raise
                sleep(wait * 2**i)

    return run


def limited(send: Callable[[bytes], None], per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable[[bytes], None]:
    """At most so many sends a second."""
    last = [-1e18]

    def run(data: bytes) -> None:
        wait = last[0] + 1 / per_second - clock()
        if wait > 0:
            sleep(wait)
        last[0] = clock()
        send(data)

    return run


def sender_sink(make_send: Callable[[], Callable[[bytes], None]], count: int = 500, size: int = 1 << 20, form: str = "lines", compress: bool = False) -> Sink:
    """Each executor sends its own partitions in batches (at least once; the batch id helps the receiver to drop repeats)."""

    def write(df: DataFrame, batch_id: int) -> None:
        def run(rows) -> None:
            send = make_send()
            for b in batches([r[0] for r in rows], count, size):
                send(body(b, form, compress))

        df.select(F.to_json(F.struct("*"))).foreachPartition(run)

    return write


def file_sink(path: str, time_column: str = "timestamp", compression: str = "gzip", per_file: int = 100_000) -> Sink:
    """JSON lines by date below ``path/batch=<id>``: writing a batch again replaces it."""

    def write(df: DataFrame, batch_id: int) -> None:
        dated = df.withColumn("date", F.to_date(F.col(time_column)))
        dated.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("compression", compression).partitionBy("date").json(f"{path}/batch={batch_id}")

    return write


def kafka_records(df: DataFrame, key: Column | None = None, topic: Column | None = None) -> DataFrame:
    """Rows as Kafka records: the row as JSON text, with a key and a topic of its own where given."""
    named = [("key", key), ("topic", topic)]
    return df.select(F.to_json(F.struct("*")).alias("value"), *[c.cast("string").alias(n) for n, c in named if c is not None])


def kafka_sink(servers: str, topic: str, key: Column | None = None, options: Mapping[str, str] | None = None) -> Sink:
    """Each batch to a topic, at least once (needs Spark's connector on the class path)."""

    def write(df: DataFrame, batch_id: int) -> None:
        kafka_records(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).options(**(options or {})).save()

    return write


def index_lines(index: str, ident: Column | None = None) -> Callable[[DataFrame], DataFrame]:
    """Rows as the two lines of a search index's bulk request (action, document) in one column, for a sender."""

    def run(df: DataFrame) -> DataFrame:
        target = F.struct(F.lit(index).alias("_index"), *([ident.cast("string").alias("_id")] if ident is not None else []))
        return df.select(F.concat(F.to_json(F.struct(target.alias("index"))), F.lit("\n"), F.to_json(F.struct("*")), F.lit("\n")).alias("lines"))

    return run


def splunk_envelope(time_column: str = "timestamp") -> Callable[[DataFrame], DataFrame]:
    """{event, time} objects."""
    return lambda df: df.select(F.struct("*").alias("event"), F.unix_timestamp(F.col(time_column).cast("timestamp")).alias("time"))


def console_sink(show: Callable[[str], None] = print, rows: int = 20) -> Sink:
    def write(df: DataFrame, batch_id: int) -> None:
        for line in df.select(F.to_json(F.struct("*"))).limit(rows).collect():
            show(json.dumps({"batch": batch_id, "event": json.loads(line[0])}))

    return write


def fan_out(sinks: Sequence[tuple[Sink, Callable[[DataFrame], DataFrame] | None]]) -> Sink:
    """Several sinks over one cached batch, each with its own processing."""

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            for sink, process in sinks:
                sink(process(df) if process else df, batch_id)
        finally:
            df.unpersist()

    return write


def object_name(prefix: str, first: Column, last: Column, ident: Column) -> Column:
    """Names of batch objects by first and last time and id."""
    return F.concat(F.lit(prefix), F.date_format(first, "yyyy/MM/dd/HH/"), F.unix_seconds(first).cast("string"), F.lit("-"), F.unix_seconds(last).cast("string"), F.lit("-"), ident, F.lit(".jsonl.gz"))
