"""Benchmark decontamination with DataFrame functions only (no Python on the executors).

Every benchmark item is compared with every window of a document: the part of any span of as many words as the item
that lies in the document. Similarity is ``2 * sum(min) / (sum + sum)`` over shingle multisets; for equally long
windows that is the share of common shingles.

1. Laying windows. A shingle of the document that the item holds too enters the window that ends with it and leaves
   ``m`` places on (``m``: the item's shingles), or sooner, where as many later ones of its kind as the item has follow.
   So a running sum of entries and exits over positions is the shared count of every window, and only hits
   can begin or end the best one. A window is laid for each document and item whose best one reaches the similarity.
2. Each window and item has a SimHash fingerprint of 128 bits over its (shingle, occurrence number) pairs: a repeated
   shingle votes as so many distinct ones, so that the angle follows the multiset similarity. Fingerprints are cut
   into ``radius + 1`` blocks: two within ``radius`` bits agree in one block at least, so an equi-join on the item
   and the blocks finds all of them.
3. Survivors are compared by exact weighted-shingle similarity on the text.

At similarity 0.8 a fingerprint of 128 bits differs in about 26 bits (deviation 4.6), unrelated ones in 64 (5.7): a
radius of 46 leaves less than 2e-5 of the former outside and lets less than 1e-3 of the latter in.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.storage import discard, materialize

BROADCAST_ROWS = 300_000  # item shingles of 24 bytes each


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column, size: Column | int) -> Column:
    """Hashes of all runs of ``size`` words, in order (repeats stay)."""
    size = F.lit(size) if isinstance(size, int) else size
    last = F.size(w) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(w, i + 1, size)))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: str) -> Column:
    """Two longs of 64 bits; a bit is set if shingles with that bit outweigh those without."""
    vote = lambda h: f"aggregate({h}, 0, (n, h) -> n + 2 * cast(shiftright(h, b) & 1 AS int) - 1)"
    bits = lambda h: F.expr(f"aggregate(sequence(0, 63), 0L, (f, b) -> f | shiftleft(cast({vote(h)} > 0 AS bigint), b))")
    return F.struct(bits(hashes).alias("a"), bits(f"transform({hashes}, h -> xxhash64(h, 1))").alias("b"))


def occurrences(hashes: str) -> Column:
    """Hashes of (shingle, occurrence number) pairs of sorted shingles: as many as there are shingles."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, i - F.array_position(hashes, h)))


def block_bounds(radius: int, words: int = 2) -> list[tuple[int, int, int]]:
    """(long, first bit, width) of radius + 1 blocks that cover all bits; none spans two longs."""
    out = []
    for word in range(words):
        n = (radius + 1 + word) // words
        edges = [64 * i // n for i in range(n + 1)]
        out += [(word, a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


def _block(fp: str, word: int, first: int, width: int) -> str:
    return f"(shiftrightunsigned({fp}.{'ab'[word]}, {first}) & {(1 << width) - 1}L)"


def blocks(fp: str, radius: int) -> Column:
    """An array of (block, value) of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.expr(_block(fp, *at)).alias("value")) for i, at in enumerate(block_bounds(radius))])


def first_common_block(x: str, y: str, radius: int) -> Column:
    """The first block in which two fingerprints agree."""
    return F.coalesce(*[F.when(F.expr(f"{_block(x, *at)} = {_block(y, *at)}"), F.lit(i)) for i, at in enumerate(block_bounds(radius))])


def lay_windows(hits: DataFrame, percent: int) -> DataFrame:
    """The best window of each (doc_id, text_hash, item) that reaches ``percent``, with its start and shingles.

    ``hits``: doc_id, text_hash, last (the document's last shingle), item, m, h, times (of h in the item), pos. Of equally
    good windows the first counts. Everything of one document and item is sorted once; sums run over positions.
    """
    pair = ["doc_id", "text_hash", "item"]
    placed = hits.groupBy(*pair, "last", "m", "times", "h").agg(F.array_sort(F.collect_list("pos")).alias("q"))
    placed = placed.select(*pair, "last", "m", "times", "q", F.posexplode("q").alias("j", "pos"))
    placed = placed.select(*pair, "last", "m", "pos", F.get("q", F.col("j") + F.col("times")).alias("later"))
    leaves = F.least(F.col("pos") + F.col("m"), F.coalesce("later", F.col("pos") + F.col("m")))
    event = lambda at, step, to_end: F.struct(at.alias("at"), F.lit(step).alias("step"), to_end.cast("int").alias("to_end"))
    events = placed.select(*pair, "last", "m", F.explode(F.array(event(F.col("pos"), 1, F.col("later").isNull()), event(leaves, -1, F.lit(0)))).alias("e")).select(*pair, "last", "m", "e.*")
    order = Window.partitionBy(*pair).orderBy("at", "step")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = F.sum("to_end").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - F.sum("to_end").over(so_far) + F.col("to_end")
    counted = events.select(*pair, "last", "m", "at", "step", F.sum("step").over(so_far).alias("ends"), rest.alias("begins")).filter("step > 0")
    window = lambda shared, start, size: F.struct((2.0 * shared / (size + F.col("m"))).alias("similarity"), (-start).alias("before"), shared.alias("shared"), size.alias("size"))
    ends = window(F.col("ends"), F.greatest(F.col("at") - F.col("m") + 1, F.lit(0)), F.least(F.col("at") + 1, F.col("m")))
    begins = window(F.col("begins"), F.col("at"), F.col("last") - F.col("at") + 1)
    best = F.greatest(ends, F.when(F.col("at") + F.col("m") - 1 > F.col("last"), begins))
    top = counted.groupBy(*pair, "m").agg(F.max(best).alias("w")).filter(F.expr(f"200 * w.shared >= {percent} * (w.size + m)"))
    return top.select(*pair, (-F.col("w.before")).alias("start"), F.col("w.size").alias("size"))


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 46) -> DataFrame:
    """One row per contaminated text and item: doc_id, text_hash, item_id, similarity, start_word, shared.

    The window is the most similar one of the document, of equals the first. Items of fewer words than ``shingle`` are
    one shingle as a whole; items without words match nothing. Null and empty texts match nothing. Rows with a null
    doc_id are compared too (doc_id null, text_hash tells the text); repeated documents or items give one row. Empty
    tables give an empty table. Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    own = own.withColumn("text_hash", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter("size(w) > 0")
    items = items.select("item_id", F.least(F.size("w"), F.lit(shingle)).alias("k"), "w")
    # items of equal words are one item with several ids
    items = items.groupBy("k", "w").agg(F.collect_set("item_id").alias("item_ids"), F.max(F.col("item_id").isNull()).alias("nameless"))
    items = items.select(F.xxhash64("w").alias("item"), "k", "item_ids", "nameless", shingles(F.col("w"), F.col("k")).alias("sh"))
    items = items.withColumn("sh", F.array_sort("sh")).withColumn("item_votes", occurrences("sh"))
    items = materialize(items.withColumn("item_fp", simhash("item_votes")), "decontam-items")
    held = items.select("item", "k", F.size("sh").alias("m"), F.explode("sh").alias("h")).groupBy("item", "k", "m", "h").agg(F.count("*").cast("int").alias("times"))
    held = materialize(held, "decontam-shingles")
    seeds = held.select("k", "h").distinct()
    sizes = sorted(r[0] for r in seeds.select("k").distinct().collect())  # at most ``shingle`` values
    if seeds.count() <= BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    split = own.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    found = []
    for k in sizes or [shingle]:
        grams = split.select("doc_id", "text_hash", (F.size("w") - k).alias("last"), F.posexplode(shingles(F.col("w"), k)).alias("pos", "h"))
        found.append(grams.join(seeds.filter(F.col("k") == k), "h"))
    hits = materialize(reduce(DataFrame.unionByName, found).distinct(), "decontam-hits")
    windows = materialize(lay_windows(hits.join(held, ["k", "h"]), percent), "decontam-windows")
    # the written table's size decides whether this join broadcasts the windows or shuffles the texts
    at = own.withColumnRenamed("doc_id", "own_id").withColumnRenamed("text_hash", "own_hash")
    cut = at.join(windows, (F.col("own_hash") == F.col("text_hash")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    cut = cut.join(items.select("item", "k"), "item").select("doc_id", "text_hash", "item", "start", "size", "k", words(F.col("text")).alias("w"))
    cut = cut.select("doc_id", "text_hash", "item", "start", "k", F.slice("w", F.col("start") + 1, F.col("size") + F.col("k") - 1).alias("w"))
    cut = cut.select("doc_id", "text_hash", "item", "start", shingles(F.col("w"), F.col("k")).alias("sh")).distinct()
    cut = cut.withColumn("sh", F.array_sort("sh")).withColumn("votes", occurrences("sh"))
    cut = materialize(cut.withColumn("fp", simhash("votes")).drop("sh"), "decontam-cut")
    name = ["doc_id", "text_hash", "item"]
    left = cut.select(*name, "fp", F.explode(blocks("fp", radius)).alias("b")).select(*name, "fp", "b.*")
    right = items.select("item", "item_fp", F.explode(blocks("item_fp", radius)).alias("b")).select("item", "item_fp", "b.*")
    near = left.join(right, ["item", "block", "value"])
    bits = F.bit_count(F.expr("fp.a ^ item_fp.a")) + F.bit_count(F.expr("fp.b ^ item_fp.b"))
    near = near.filter((bits <= radius) & (first_common_block("fp", "item_fp", radius) == F.col("block")))
    near = near.select(F.col("doc_id").alias("near_id"), F.col("text_hash").alias("near_hash"), F.col("item").alias("near_item"))
    same = F.col("near_id").eqNullSafe(F.col("doc_id")) & (F.col("near_hash") == F.col("text_hash")) & (F.col("near_item") == F.col("item"))
    pairs = cut.join(near, same, "left_semi").join(items.select("item", "item_ids", "nameless", "item_votes"), "item")
    pairs = pairs.withColumn("shared", F.size(F.array_intersect("votes", "item_votes")).cast("long")).withColumn("both", F.size("votes") + F.size("item_votes"))
    sure = pairs.filter(F.expr(f"200 * shared >= {percent} * both")).withColumn("similarity", 2.0 * F.col("shared") / F.col("both"))
    ids = F.when(F.col("nameless"), F.concat("item_ids", F.array(F.lit(None).cast("long")))).otherwise(F.col("item_ids"))
    out = sure.select("doc_id", "text_hash", F.explode(ids).alias("item_id"), "similarity", F.col("start").cast("long").alias("start_word"), "shared")
    out = materialize(out, "decontam-matches")
    discard(held, hits, windows, cut)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text matches an item; all columns stay, null texts stay."""
    hit = matches(docs, benchmark, **options).select(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).distinct()
    clean = (F.xxhash64(docs["text"].cast("string")) == F.col("hit_hash")) & docs["doc_id"].cast("long").eqNullSafe(F.col("hit_id"))
    return docs.join(hit, clean, "left_anti")
