"""The queries of this subpackage: thin contracts over the operators, each on its whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontam, hmm, kneser_ney, minhash, packing, pii, pstable, suffix, warc, wordpiece
from lodestar.llm.storage import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pstable_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op2_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7))
    return hmm.score_documents(table(spark, sf_dir, "documents"), held_out=remainder == 2)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return minhash.near_duplicates(docs, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op4_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "shared", F.round("similarity", 9).alias("similarity"), "start_word")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), length=400, passage=51)
    return found.drop("spans")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), target)
    read = warc.read_archive(spark, target)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op9_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), seq_len=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), min_count=1)
    return judged.select("doc_id", "lang", "n_tokens", "log10_prob", "perplexity", "threshold", "keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pstable_neardup": op1_pstable_neardup,
    "op2_hmm_lm": op2_hmm_lm,
    "op3_minhash_neardup": op3_minhash_neardup,
    "op4_simhash_decontam": op4_simhash_decontam,
    "op5_wordpiece_counts": op5_wordpiece_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_warc": op7_warc,
    "op8_pii": op8_pii,
    "op9_ffd_packing": op9_ffd_packing,
    "op10_kneser_ney_quality": op10_kneser_ney_quality,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_NORMAL = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"

_NIBBLES = "0000000100100011010001010110011110001001101010111100110111101111"
_SHA1_BITS = f"array_to_string(list_transform(range(1, 41), lambda i: substr('{_NIBBLES}', 4 * strpos('0123456789abcdef', sha1(payload)[i]) - 3, 4)), '')"
_BASE32 = (
    "array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + "
    + " + ".join(f"{16 >> k} * bits[5 * j + {k + 1}]::INT" for k in range(5))
    + ", 1)), '')"
)

ORACLES: dict[str, str] = {
    "op1_pstable_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
         ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, link.y FROM reach r JOIN link ON r.y = link.x)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE x = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = e.vec_id
""",
    "op4_simhash_decontam": f"""
WITH i AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM (SELECT item_id, {_NORMAL} AS w FROM benchmark) WHERE len(w) > 0),
d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
ish AS (SELECT item_id, n, k, unnest(list_transform(range(0, n - k + 1), lambda p: struct_pack(p := p, s := array_to_string(w[p + 1:p + k], ' '))), recursive := true) FROM i),
dsh AS (SELECT doc_id, k, unnest(list_transform(range(0, greatest(len(w) - k + 1, 0)), lambda p: struct_pack(p := p, s := array_to_string(w[p + 1:p + k], ' '))), recursive := true)
        FROM d, (SELECT DISTINCT k FROM i)),
last AS (SELECT doc_id, k, max(p) AS last FROM dsh GROUP BY ALL),
icount AS (SELECT item_id, n, k, n - k + 1 AS m, s, count(*) AS times FROM ish GROUP BY ALL),
hit AS (SELECT DISTINCT dsh.doc_id, icount.item_id, icount.m, icount.times, last.last, s, dsh.p
        FROM dsh JOIN icount USING (k, s) JOIN last ON last.doc_id = dsh.doc_id AND last.k = dsh.k),
inside AS (SELECT doc_id, item_id, m, last, w, s, least(count(*), any_value(times)) AS c
           FROM (SELECT *, unnest(range(p - m + 1, p + 1)) AS w FROM hit) GROUP BY doc_id, item_id, m, last, w, s),
sim AS (SELECT doc_id, item_id, greatest(w, 0) AS start, sum(c)::BIGINT AS shared, any_value(least(w + m - 1, last) - greatest(w, 0) + 1 + m) AS total
        FROM inside GROUP BY doc_id, item_id, w)
SELECT doc_id, item_id, shared, round(2.0 * shared / total, 9) AS similarity, start::BIGINT AS start_word
FROM sim WHERE 200 * shared >= 80 * total
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, start, shared DESC) = 1
""",
    "op6_suffix_dedup": f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, s, hash(substr(h, 2 * s + 1, 800)) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 399, 0))) AS s FROM d)),
hit AS (SELECT doc_id, s FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
step AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, min(s) AS a, max(s) + 400 AS b
        FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM step) GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM run
        UNION ALL SELECT d.doc_id, coalesce(r.b, 0), n FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM run GROUP BY doc_id) r USING (doc_id)),
ws AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
ww AS (SELECT doc_id, p, hash(ws[p + 1:p + 51]) AS m FROM (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 50, 0))) AS p FROM ws)),
wp AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(p, p + 51)) AS p FROM ww WHERE m IN (SELECT m FROM ww GROUP BY m HAVING count(*) > 1)) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (b - a))::BIGINT), '' ORDER BY a) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(r.removed, 0)::BIGINT AS n_removed, coalesce(r.spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256, coalesce(wp.n, 0)::BIGINT AS n_passage_words
FROM d JOIN kept USING (doc_id) LEFT JOIN wp USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM run GROUP BY doc_id) r USING (doc_id)
""",
    "op7_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
b AS (SELECT page_id, payload, {_SHA1_BITS} AS bits, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
""",
    "op3_minhash_neardup": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
                               WHEN len(ws) = 1 THEN ws ELSE [] END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT s FROM sh GROUP BY s HAVING count(*) > 1),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM (SELECT * FROM sh JOIN n USING (doc_id) WHERE s IN (SELECT s FROM common)) a
  JOIN (SELECT * FROM sh JOIN n USING (doc_id) WHERE s IN (SELECT s FROM common)) b
    ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY 1, 2),
link AS (
  SELECT x, y FROM inter JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp USING (doc_id) LEFT JOIN n USING (doc_id)
""",
}
