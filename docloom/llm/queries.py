"""The queries of the operators in this subpackage over the supplied tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate as leaks
from docloom.llm import divergence, hd_langid, importance, line_dedup, maxent_lm, mixing, mtree, secret_scan, sharding, simhash, token_count, warc


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc_words),
found AS (
  SELECT p.doc_id, p.i, s.n, x.item_id
  FROM places p JOIN sizes s ON p.i + s.n - 1 <= len(p.w)
  JOIN windows x ON x.n = s.n AND x.win = array_to_string(p.w[p.i:p.i + s.n - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN items t USING (doc_id)
"""

def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(read(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
placed AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place, 3 * source_size AS cap,
         ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1 AS weight FROM sources),
rated AS (SELECT *, cap::DOUBLE / weight AS ratio FROM placed),
levels AS (
  SELECT *, ((sum(source_size) OVER ()) - (sum(cap) OVER o - cap))::DOUBLE / ((sum(weight) OVER ()) - (sum(weight) OVER o - weight))::DOUBLE AS level
  FROM rated WINDOW o AS (ORDER BY ratio, place ROWS UNBOUNDED PRECEDING)),
final AS (SELECT ratio AS fr, place AS fp, level AS fl FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN fr IS NOT NULL AND (ratio > fr OR (ratio = fr AND place >= fp)) THEN weight * fl ELSE cap::DOUBLE END AS target
  FROM levels LEFT JOIN final ON TRUE),
units AS (
  SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END * 4294967296), 3 * 4294967296::BIGINT)::BIGINT AS units,
         ('0x' || substr(md5('mix/offset/' || coalesce(source, '-')), 1, 8))::BIGINT AS off FROM targets),
ranked AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.units, u.off,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5('mix/order/' || coalesce(d.doc_id::VARCHAR, '-')), d.doc_id NULLS LAST) - 1 AS r
  FROM docs d JOIN units u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       ((((r + 1) * units + off) >> 32) - ((r * units + off) >> 32)) * size AS taken
FROM ranked
"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd_langid.identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(read(spark, sf_dir, "pages"))
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
f AS (SELECT d, min(page_id) AS original FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN original IS NOT NULL AND original IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_count.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumnRenamed("id", "doc_id")


def _joined(spans: str) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(read(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [number(k).alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, bit by bit."""
    step = "lambda d, k: xor(d >> 1, 3988292384 * (d & 1))"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, x: list_reduce(range(8), {step}, xor(c, x)), 4294967295::BIGINT))"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = "unnest(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))))"
OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
doc_runs AS (SELECT r, run, count(*) AS c FROM (SELECT r, {_RUNS} AS run FROM docs) GROUP BY r, run),
item_runs AS (SELECT run, count(*) AS c FROM (SELECT {_RUNS} AS run FROM items) GROUP BY run),
hashed AS (SELECT run, {_crc32('run')} % 10000 AS bucket FROM (SELECT run FROM doc_runs UNION SELECT run FROM item_runs)),
s AS (SELECT bucket, sum(c) AS n FROM doc_runs JOIN hashed USING (run) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS n FROM item_runs JOIN hashed USING (run) GROUP BY bucket),
gains AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE
         / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) b(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
weights AS (SELECT r, sum(c) AS n_features, sum(c * gain) AS weight FROM doc_runs JOIN hashed USING (run) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (r)
"""


def op12_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


OP12_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents),
records AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || text_crc32), 1, 8))::BIGINT % 16384)::INTEGER AS virtual_slot FROM docs),
slots AS (SELECT virtual_slot, virtual_slot % 24 AS old, sum(size)::BIGINT AS bytes FROM records GROUP BY virtual_slot),
passed AS (SELECT *, sum(bytes) OVER (PARTITION BY old ORDER BY bytes DESC, virtual_slot ROWS UNBOUNDED PRECEDING) * 24 <= (sum(bytes) OVER ()) AS stays FROM slots),
moved AS (SELECT virtual_slot, bytes, row_number() OVER (ORDER BY bytes DESC, virtual_slot) AS step FROM passed WHERE NOT stays),
loads AS (SELECT list(load ORDER BY s) AS loads FROM (SELECT s, coalesce(sum(bytes), 0)::BIGINT AS load FROM range(24) x(s) LEFT JOIN passed ON old = s AND stays GROUP BY s)),
dealt AS (
  SELECT 0::BIGINT AS step, loads, NULL::INTEGER AS virtual_slot, NULL::INTEGER AS shard FROM loads
  UNION ALL
  SELECT m.step, list_transform(d.loads, lambda x, i: CASE WHEN i = list_position(d.loads, list_min(d.loads)) THEN x + m.bytes ELSE x END),
         m.virtual_slot, (list_position(d.loads, list_min(d.loads)) - 1)::INTEGER
  FROM dealt d JOIN moved m ON m.step = d.step + 1),
slot_map AS (SELECT virtual_slot, shard FROM dealt WHERE step > 0 UNION ALL SELECT virtual_slot, old FROM passed WHERE stays)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, virtual_slot,
       row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, doc_id NULLS LAST, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM records JOIN slot_map USING (virtual_slot)
"""


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT r, lang, source, unnest(w) AS term FROM docs) GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM counts GROUP BY lang, term HAVING sum(docs) >= 30),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM kept GROUP BY lang),
groups_ AS (SELECT DISTINCT lang, source FROM docs),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n FROM groups_ g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
totals AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM dense GROUP BY lang, source),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM dense JOIN totals USING (lang, source) JOIN langs USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups_ a JOIN groups_ b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_fuzzy_line_dedup": op3_fuzzy_line_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_language_id": op6_language_id,
    "op7_warc_round_trip": op7_warc_round_trip,
    "op8_token_counts": op8_token_counts,
    "op9_secret_scan": op9_secret_scan,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_virtual_slot_sharding": op12_virtual_slot_sharding,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {"op2_benchmark_decontamination": OP2_SQL, "op4_source_mixing": OP4_SQL, "op7_warc_round_trip": OP7_SQL, "op10_exact_top_k": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_virtual_slot_sharding": OP12_SQL, "op13_source_divergence": OP13_SQL}
