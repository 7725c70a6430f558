"""The ten queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, language, neardup, packing, pii, quality, toolcalls, topk, warc


#: Scores from here on count as label 1.
PREDICTED = 0.3


#: Rows and bytes of texts that travel to Python at once: workers hold a few copies of a batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; from now on the session, which plans a query only when it runs, sends rows to Python in batches of BATCH_ROWS and BATCH_BYTES at most."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated")
    )


REPLY_SCHEMA = [("reply", "prompt", "string", True), ("reply", "turn", "integer", True)]


def op5_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.from_turns(read(spark, sf_dir, "conversations"))
    schemas = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{n}', '{p}', '{k}', {str(r).lower()})" for n, p, k, r in REPLY_SCHEMA) + " AS t(name, param, kind, required)")
    linked = toolcalls.link(calls, results, schemas)
    return linked.select("conv_id", "call_id", "seq", "level", "status", "n_results", F.concat_ws(",", "violations").alias("violations"), "json")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= PREDICTED).cast("int"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.grouped(read(spark, sf_dir, "documents"), k=3, percent=85)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_packing, op2_warc, op3_html, op4_decontamination, op5_toolcalls, op6_quality, op7_pii, op8_topk, op9_neardup, op10_language)}


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM m
"""


OP4_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
o AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM o) GROUP BY r),
t AS (SELECT r, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM o WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""


OP5_SQL = """
WITH RECURSIVE c AS (SELECT conv_id, turn, text, conv_id || '-' || turn AS call_id, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1 AS first FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n, min({'t': turn, 'x': text}).x AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL),
l AS (SELECT conv_id, turn, 0 AS level FROM c x WHERE first AND NOT EXISTS (SELECT 1 FROM c y WHERE y.first AND y.conv_id = x.conv_id AND y.turn = x.turn - 2)
      UNION ALL SELECT c.conv_id, c.turn, l.level + 1 FROM l JOIN c ON c.first AND c.conv_id = l.conv_id AND c.turn = l.turn + 2),
r AS (SELECT c.*, level, CASE WHEN first THEN coalesce(n, 0) ELSE 0 END AS n_results, content,
             CASE WHEN NOT first THEN 'duplicate' WHEN n IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
             CASE WHEN first AND c.turn >= 2 AND level = 0 THEN 'after:' || conv_id || '-' || (turn - 2) END AS lost
      FROM c LEFT JOIN l USING (conv_id, turn) LEFT JOIN a USING (conv_id, turn))
SELECT conv_id, call_id, turn AS seq, level, status, n_results, concat_ws(',', CASE WHEN text IS NULL THEN 'missing:prompt' END, lost) AS violations,
       CAST(to_json({'arguments': {'prompt': text, 'turn': turn}, 'call_id': call_id, 'level': level, 'name': 'reply', 'result': CASE WHEN first THEN content END, 'status': status}) AS VARCHAR) AS json
FROM r
"""

OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(b) AS component_id, w.doc_id = min(b) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n
"""


def oracle_sql() -> dict:
    return {"op9_neardup": OP9_SQL, "op2_warc": OP2_SQL, "op4_decontamination": OP4_SQL, "op5_toolcalls": OP5_SQL, "op8_topk": OP8_SQL}
