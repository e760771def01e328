"""Queries on chunking, vectors, keywords and fusion (inventory C1-C7, E1-E11, F1-F7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import ann, chunking, fusion, keyword, postings, rerank, vectors
from docloom.plans.registry import PAGES, TRIM, crc32, query, read, shared
from docloom.plans.texts import pages
from docloom.sources.tables import spread


@query("c01_split_flat")
def flat(spark, sf_dir):
    return chunking.split_flat(pages(spark, sf_dir))


@query("c01_split_sql")
def flat_by_sql(spark, sf_dir):
    """The flat splitter as a table function in a lateral join."""
    chunking.register_splitter(spark)
    pages(spark, sf_dir).createOrReplaceTempView("docloom_pages")
    return spark.sql("SELECT p.doc_id, p.page_number, s.chunk_index, s.content FROM docloom_pages p, LATERAL split_text(p.content, 1000, 200) s")


@query("c02_split_adaptive")
def adaptive(spark, sf_dir):
    return chunking.split_adaptive(pages(spark, sf_dir))


@query("c03_split_hierarchical")
def hierarchical(spark, sf_dir):
    return chunking.split_hierarchical(pages(spark, sf_dir)).select("doc_id", "page_number", "parent_id", "parent_index", "child_id", "child_index", F.length("parent").alias("parent_chars"), "child")


@query("c04_repair_boundaries")
def repaired(spark, sf_dir):
    return chunking.split_adaptive(pages(spark, sf_dir), repair=True)


COS = "list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})))"
VECS = "vecs_ AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


# Every hundred vectors of a label are one section.
@query("c05_split_semantic", f"""WITH {VECS}, d_ AS (SELECT label, section, vec_id, round(1 - list_inner_product(v, nv) / sqrt(list_inner_product(v, v) * list_inner_product(nv, nv)), 9) AS distance FROM (SELECT *, vec_id // 100 AS section, lead(v) OVER (PARTITION BY label, vec_id // 100 ORDER BY vec_id) AS nv FROM vecs_)),
  t_ AS (SELECT label, section, quantile_cont(distance, 0.5) AS t FROM d_ GROUP BY label, section),
  b_ AS (SELECT d_.*, (distance > t)::INTEGER AS br FROM d_ JOIN t_ USING (label, section))
  SELECT label, vec_id, distance, coalesce(sum(br) OVER (PARTITION BY label, section ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS semantic_chunk FROM b_""")
def semantic(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("label", F.floor(F.col("vec_id") / 100).alias("section"), "vec_id", F.col("embedding").alias("vector"))
    return chunking.split_semantic(rows, ["label", "section"], "vec_id", percentile=50.0).select("label", "vec_id", "distance", "semantic_chunk")


def semantic_sql(percentile: float) -> str:
    """Sentences with their neighbours, hashed word counts by place, distances, and what stands between breaks."""
    return rf"""WITH {PAGES}, s_ AS (SELECT doc_id, page_number, list_filter(string_split(regexp_replace(content, '([.?!])[\t-\r\x1C-\x20\x{{85}}\pZ]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, {TRIM}) <> '') AS s FROM pages_),
  n_ AS (SELECT doc_id, page_number, s, unnest(range(1, len(s) + 1)) AS i FROM s_),
  w_ AS (SELECT doc_id, page_number, i, unnest(regexp_extract_all(lower(array_to_string(s[greatest(i - 1, 1):i + 1], ' ')), '[\p{{L}}\p{{N}}_]+')) AS w FROM n_),
  h_ AS (SELECT w, {crc32("w")} % 64 AS place FROM (SELECT DISTINCT w FROM w_)),
  v_ AS (SELECT doc_id, page_number, i, place, count(*)::DOUBLE AS n FROM w_ JOIN h_ USING (w) GROUP BY ALL),
  o_ AS (SELECT doc_id, page_number, i, sum(n * n) AS own FROM v_ GROUP BY ALL),
  p_ AS (SELECT a.doc_id, a.page_number, a.i, sum(a.n * b.n) AS both_ FROM v_ a JOIN v_ b ON a.doc_id = b.doc_id AND a.page_number = b.page_number AND b.i = a.i + 1 AND a.place = b.place GROUP BY ALL),
  d_ AS (SELECT n_.doc_id, n_.page_number, n_.i, 1 - CASE WHEN a.own * b.own > 0 THEN coalesce(both_, 0) / sqrt(a.own * b.own) ELSE 0 END AS far FROM n_
    LEFT JOIN o_ a USING (doc_id, page_number, i) LEFT JOIN o_ b ON b.doc_id = n_.doc_id AND b.page_number = n_.page_number AND b.i = n_.i + 1
    LEFT JOIN p_ ON p_.doc_id = n_.doc_id AND p_.page_number = n_.page_number AND p_.i = n_.i WHERE n_.i < len(n_.s)),
  l_ AS (SELECT doc_id, page_number, list(far ORDER BY far) AS r, (count(*) - 1) * ({percentile}::DOUBLE / 100) AS k FROM d_ GROUP BY ALL),
  t_ AS (SELECT doc_id, page_number, r[floor(k)::INT + 1] + (r[least(floor(k)::INT + 2, len(r))] - r[floor(k)::INT + 1]) * (k - floor(k)) AS t FROM l_),
  b_ AS (SELECT n_.doc_id, n_.page_number, n_.i, n_.s[n_.i] AS sentence, coalesce(d_.far > t, FALSE)::INT AS br FROM n_ LEFT JOIN d_ USING (doc_id, page_number, i) LEFT JOIN t_ USING (doc_id, page_number)),
  g_ AS (SELECT *, coalesce(sum(br) OVER (PARTITION BY doc_id, page_number ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS chunk_index FROM b_)
  SELECT doc_id, page_number, chunk_index, string_agg(sentence, ' ' ORDER BY i) AS content, count(*)::INT AS n_sentences FROM g_ GROUP BY ALL"""


# The setting of 0.5 on the scale of 100, and one at which chunks of several sentences come.
for _name, _percentile in (("c05_semantic_pages", 0.5), ("c05_semantic_pages_p80", 80.0)):
    query(_name, semantic_sql(_percentile))(lambda s, d, p=_percentile: chunking.split_semantic_pages(pages(s, d), percentile=p))


@query("c06_all_chunks", f"WITH {PAGES} SELECT doc_id, page_number, 'text' AS chunk_type, content FROM pages_ UNION ALL SELECT doc_id, 1, 'image', 'Image on page 1: ' || source FROM documents UNION ALL SELECT doc_id, 1, 'table', 'Table on page 1: ' || lang FROM documents")
def all_kinds(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    text = pages(spark, sf_dir).withColumn("chunk_type", F.lit("text"))
    one = lambda kind, label, c: docs.select("doc_id", F.lit(1).alias("page_number"), F.lit(kind).alias("chunk_type"), F.concat(F.lit(f"{label} on page 1: "), c).alias("content"))
    return chunking.all_chunks(text, one("image", "Image", "source"), one("table", "Table", "lang")).select("doc_id", "page_number", "chunk_type", "content")


@query("c07_attach_embeddings", f"WITH {PAGES} SELECT doc_id || ':' || page_number AS chunk_id, content, 64::INTEGER AS dim FROM pages_")
def attached(spark, sf_dir):
    embed = vectors.hashed_embedder()
    chunks = pages(spark, sf_dir).withColumn("chunk_id", F.concat_ws(":", "doc_id", "page_number"))
    return chunking.attach_embeddings(chunks, chunks.select("chunk_id", embed("content").alias("embedding"))).select("chunk_id", "content", F.size("embedding").alias("dim"))


@query("e01_cosine", f"WITH {VECS} SELECT a.vec_id, round({COS.format(a='a.v', b='b.v')}, 6) AS similarity FROM vecs_ a JOIN vecs_ b ON b.vec_id = a.vec_id + 1")
def cosines(spark, sf_dir):
    a = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


def vector_chunks(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding")


def vector_queries(spark, sf_dir, shift: int = 0):
    """Every fiftieth vector asks within its own document; ``shift`` takes the vector that many ids on, as a variation."""
    rows = vector_chunks(spark, sf_dir)
    asked = rows.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id", F.col("embedding").alias("query_vector"))
    if not shift:
        return asked
    moved = rows.select((F.col("chunk_id") - shift).alias("query_id"), F.col("embedding").alias("query_vector"))
    return asked.drop("query_vector").join(moved, "query_id")


def knn_sql(k: int, where: str = "TRUE", query: str = "q.v", name: str = "knn") -> str:
    return f"""{name}_ AS (SELECT query_id, chunk_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM (
  SELECT q0.vec_id AS query_id, c.vec_id AS chunk_id, round({COS.format(a=query, b='c.v')}, 9) AS similarity FROM vecs_ q0 JOIN vecs_ q ON q.vec_id = q0.vec_id + {{shift}} JOIN vecs_ c ON c.label = q0.label WHERE q0.vec_id % 50 = 0 AND {where})) WHERE rank <= {k})"""


def _knn(name: str, k: int, where: str = "TRUE", spark_where: str = "TRUE"):
    def run(spark, sf_dir):
        return vectors.knn(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir).where(spark_where), k)

    query(name, f"WITH {VECS}, {knn_sql(k, where).format(shift=0)} SELECT * FROM knn_")(run)


_knn("e02_knn", 10)
# Every third vector stands for a sentence, every other third for a child chunk.
_knn("e03_knn_sentences", 10, "c.vec_id % 3 = 0", "chunk_id % 3 = 0")
_knn("e04_knn_children", 20, "c.vec_id % 3 = 1", "chunk_id % 3 = 1")


def knn_multi(spark, sf_dir, k: int):
    """Hits of the question (set 0) and of one variation (set 1)."""
    sets = [vectors.knn(vector_queries(spark, sf_dir, s), vector_chunks(spark, sf_dir), k).withColumn("set_id", F.lit(s)) for s in (0, 1)]
    return sets[0].unionByName(sets[1])


MULTI = f"{VECS}, {knn_sql(10, name='k0').format(shift=0)}, {knn_sql(10, name='k1').format(shift=1)}, multi_ AS (SELECT 0 AS set_id, * FROM k0_ UNION ALL SELECT 1, * FROM k1_)"


@query("e05_knn_multi", f"WITH {MULTI} SELECT * FROM multi_")
def multi(spark, sf_dir):
    return knn_multi(spark, sf_dir, 10)


@query("e06_ann")
def approximate(spark, sf_dir):
    return ann.ann(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir), 10)


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in keyword.STOP) + "]"
WORDS_SQL = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"
KEYED = f"""{PAGES}, q_ AS (SELECT doc_id AS query_id, doc_id, list_filter(list_distinct({WORDS_SQL.format(t="text")}[2:4]), lambda x: NOT list_contains({STOP_SQL}, x)) AS t FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
  post_ AS (SELECT doc_id, doc_id * 1000 + page_number AS chunk_id, term, count(*) AS n FROM (SELECT doc_id, page_number, unnest({WORDS_SQL.format(t="content")}) AS term FROM pages_) GROUP BY ALL),
  match_ AS (SELECT query_id, chunk_id, len(t)::INTEGER AS n_terms, sum(n)::BIGINT AS occurrences, count(*) AS found FROM (SELECT query_id, doc_id, t, unnest(t) AS term FROM q_ WHERE len(t) > 0) JOIN post_ USING (doc_id, term) GROUP BY query_id, chunk_id, t HAVING count(*) = len(t))"""


def keyword_queries(spark, sf_dir, first: int = 2, n: int = 3):
    docs = read(spark, sf_dir, "documents").where("doc_id % 50 = 0 AND text IS NOT NULL")
    words = F.slice(keyword.terms(F.col("text")), first, n)
    return docs.select(F.col("doc_id").alias("query_id"), "doc_id", F.array_join(words, " ").alias("query"))


def keyword_chunks(spark, sf_dir):
    return pages(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("page_number")).alias("chunk_id"), "doc_id", "content")


@query("e07_keyword_match", f"WITH {KEYED} SELECT query_id, chunk_id, n_terms, occurrences FROM match_")
def matched(spark, sf_dir):
    return keyword.keyword_match(keyword_queries(spark, sf_dir), keyword_chunks(spark, sf_dir))


# A cover ends at a term and begins at the earliest of the terms' last places before that; of those with one beginning the shortest counts.
COVERS = f"""{KEYED}, w_ AS (SELECT doc_id * 1000 + page_number AS chunk_id, {WORDS_SQL.format(t="content")} AS w FROM pages_),
  p_ AS (SELECT query_id, chunk_id, nt, i AS pos, w[i] AS term FROM (SELECT m.query_id, m.chunk_id, q_.t, len(q_.t) AS nt, w, unnest(range(1, len(w) + 1)) AS i FROM match_ m JOIN q_ ON q_.query_id = m.query_id JOIN w_ ON w_.chunk_id = m.chunk_id) WHERE list_contains(t, w[i])),
  l_ AS (SELECT a.query_id, a.chunk_id, a.nt, a.pos, b.term, max(b.pos) AS last FROM p_ a JOIN p_ b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.pos <= a.pos GROUP BY ALL),
  s_ AS (SELECT query_id, chunk_id, nt, pos, min(last) AS start FROM l_ GROUP BY query_id, chunk_id, nt, pos HAVING count(*) = nt),
  c_ AS (SELECT query_id, chunk_id, nt, start, min(pos) AS stop FROM s_ GROUP BY query_id, chunk_id, nt, start),
  d_ AS (SELECT query_id, chunk_id, round(sum(0.1::DOUBLE / (1 + (stop - start + 1 - nt))), 9) AS score FROM c_ GROUP BY query_id, chunk_id)"""


MATCH_SQL = f"WITH {KEYED} SELECT query_id, chunk_id, n_terms, occurrences FROM match_"
COVER_SQL = f"WITH {COVERS}, best_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM d_) WHERE rank <= 10) SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, rank FROM best_"


@query("e08_keyword_rank", COVER_SQL)
def cover_ranked(spark, sf_dir):
    return keyword.keyword_rank(keyword_queries(spark, sf_dir), keyword_chunks(spark, sf_dir))


@query("e08_occurrence_rank", f"WITH {KEYED}, best_ AS (SELECT * FROM (SELECT query_id, chunk_id, 0.1::DOUBLE * occurrences AS score, row_number() OVER (PARTITION BY query_id ORDER BY 0.1::DOUBLE * occurrences DESC, chunk_id)::INTEGER AS rank FROM match_) WHERE rank <= 10) SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, rank FROM best_")
def occurrence_ranked(spark, sf_dir):
    return keyword.occurrence_rank(keyword_queries(spark, sf_dir), keyword_chunks(spark, sf_dir))


def stored_postings(spark, chunks, by: str = "doc_id"):
    """The index of all chunks, written and opened again."""
    path = shared(spark)
    postings.save_postings(postings.build_postings(chunks, by), path, by)
    return postings.open_postings(spark, path)


@query("e07_posting_match", MATCH_SQL)
def matched_by_postings(spark, sf_dir):
    return postings.match(keyword_queries(spark, sf_dir), stored_postings(spark, keyword_chunks(spark, sf_dir)))


@query("e08_posting_rank", COVER_SQL)
def ranked_by_postings(spark, sf_dir):
    return postings.top_matches(keyword_queries(spark, sf_dir), stored_postings(spark, keyword_chunks(spark, sf_dir)))


@query("e10_rerank", f"""WITH {VECS}, {knn_sql(40, name="k1").format(shift=1)}, r_ AS (SELECT k.query_id, k.chunk_id, k.similarity AS original_similarity, round({COS.format(a='q.v', b='c.v')}, 9) AS similarity FROM k1_ k JOIN vecs_ q ON q.vec_id = k.query_id JOIN vecs_ c ON c.vec_id = k.chunk_id)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM r_) WHERE rank <= 15""")
def reranked(spark, sf_dir):
    found = vectors.knn(vector_queries(spark, sf_dir, 1), vector_chunks(spark, sf_dir), 40)
    full = found.join(vector_queries(spark, sf_dir).drop("document_id"), "query_id").join(vector_chunks(spark, sf_dir).drop("document_id"), "chunk_id")
    return vectors.rerank(full).select("query_id", "chunk_id", "original_similarity", "similarity", "rank")


# Words as the counts of their character trigrams by hash; each question word is given its most similar word of the text.
@query("e10_rerank_texts", f"""WITH {PAGES}, q_ AS (SELECT doc_id AS query_id, doc_id, list_distinct({WORDS_SQL.format(t="text")}[2:4]) AS q FROM documents WHERE doc_id % 50 = 0 AND text IS NOT NULL),
  c_ AS (SELECT query_id, doc_id * 1000 + page_number AS chunk_id, q, list_distinct({WORDS_SQL.format(t="content")}) AS t FROM q_ JOIN pages_ USING (doc_id)),
  w_ AS (SELECT DISTINCT unnest(list_concat(q, t)) AS w FROM c_),
  g_ AS (SELECT w, unnest(list_transform(range(1, length(w) + 1), lambda i: substr('^' || w || '$', i, 3))) AS g FROM w_),
  v_ AS (SELECT w, {crc32("g")} % 256 AS place, count(*)::DOUBLE AS n FROM g_ GROUP BY ALL),
  o_ AS (SELECT w, sum(n * n) AS own FROM v_ GROUP BY w),
  p_ AS (SELECT DISTINCT a, b FROM (SELECT a, unnest(t) AS b FROM (SELECT unnest(q) AS a, t FROM c_))),
  s_ AS (SELECT a, b, sum(x.n * y.n) AS both_ FROM p_ JOIN v_ x ON x.w = a JOIN v_ y ON y.w = b AND y.place = x.place GROUP BY a, b),
  m_ AS (SELECT a, b, coalesce(both_, 0) / sqrt(i.own * j.own) AS near FROM p_ LEFT JOIN s_ USING (a, b) JOIN o_ i ON i.w = a JOIN o_ j ON j.w = b),
  r_ AS (SELECT query_id, chunk_id, len(q) AS n, a, max(near) AS best FROM (SELECT query_id, chunk_id, q, a, unnest(t) AS b FROM (SELECT query_id, chunk_id, q, t, unnest(q) AS a FROM c_)) JOIN m_ USING (a, b) GROUP BY ALL),
  f_ AS (SELECT c_.query_id, c_.chunk_id, round(coalesce(sum(best) / any_value(n), 0), 9) AS similarity FROM c_ LEFT JOIN r_ ON r_.query_id = c_.query_id AND r_.chunk_id = c_.chunk_id GROUP BY ALL)
  SELECT * FROM (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id)::INTEGER AS rank FROM f_) WHERE rank <= 15""")
def reranked_texts(spark, sf_dir):
    """All pages of a question's document, scored by question text and page text."""
    asked = keyword_queries(spark, sf_dir)
    pairs = asked.join(keyword_chunks(spark, sf_dir), "doc_id").select("query_id", "chunk_id", "query", "content")
    return rerank.rerank_texts(pairs).select("query_id", "chunk_id", "similarity", "rank")


@query("e11_embed")
def embedded(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", vectors.hashed_embedder()("text").alias("embedding"))


RRF = "rrf_ AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM multi_ GROUP BY query_id, chunk_id)"


@query("f01_rrf", f"WITH {MULTI}, {RRF} SELECT query_id, chunk_id, score FROM rrf_")
def fused_ranks(spark, sf_dir):
    return fusion.rrf(knn_multi(spark, sf_dir, 10).withColumnRenamed("similarity", "score"))


# Keyword hits on the texts whose document id is the chunk id; only some queries have any.
HITS = f"""texts_ AS (SELECT vec_id, label, text, {WORDS_SQL.format(t="text")} AS w FROM embeddings JOIN documents ON doc_id = vec_id),
  qt_ AS (SELECT vec_id AS query_id, label, list_filter(list_distinct(w[2:3]), lambda x: NOT list_contains({STOP_SQL}, x)) AS t FROM texts_ WHERE vec_id % 50 = 0),
  kp_ AS (SELECT vec_id AS chunk_id, label, term, count(*) AS n FROM (SELECT vec_id, label, unnest(w) AS term FROM texts_) GROUP BY ALL),
  km_ AS (SELECT query_id, chunk_id, 0.1::DOUBLE * sum(n) AS s FROM (SELECT query_id, label, t, unnest(t) AS term FROM qt_ WHERE len(t) > 0) JOIN kp_ USING (label, term) GROUP BY query_id, chunk_id, t HAVING count(*) = len(t)),
  kw_ AS (SELECT query_id, chunk_id, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r FROM km_) WHERE r <= 20)"""


def keyword_hits(spark, sf_dir, stored: bool = False):
    docs = spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")))
    chunks = vector_chunks(spark, sf_dir).drop("embedding").join(docs, "chunk_id")
    asked = chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "document_id", F.array_join(F.slice(keyword.terms(F.col("content")), 2, 2), " ").alias("query"))
    if stored:
        return postings.top_matches(asked, stored_postings(spark, chunks, "document_id"), 20, "document_id", density=False)
    return keyword.occurrence_rank(asked, chunks, 20, "document_id")


FUSED = f"""{MULTI}, {RRF}, {HITS}, both_ AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(a.score, 0) AS semantic_score, coalesce(b.score, 0) AS keyword_score, b.score IS NOT NULL AS kw FROM rrf_ a FULL JOIN kw_ b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
  fused_ AS (SELECT query_id, chunk_id, semantic_score, keyword_score, round(CASE WHEN max(kw) OVER (PARTITION BY query_id) THEN 0.7::DOUBLE * semantic_score + 0.3::DOUBLE * keyword_score ELSE semantic_score END, 9) AS score FROM both_)"""


def fused(spark, sf_dir, stored: bool = False):
    return fusion.hybrid_fuse(fusion.rrf(knn_multi(spark, sf_dir, 10).withColumnRenamed("similarity", "score")), keyword_hits(spark, sf_dir, stored))


query("f02_hybrid_fuse", f"WITH {FUSED} SELECT query_id, chunk_id, semantic_score, keyword_score, score FROM fused_")(fused)
query("d04_hybrid_join", f"WITH {FUSED} SELECT query_id, chunk_id, semantic_score, keyword_score, kw AS is_keyword FROM both_")(
    lambda spark, sf_dir: fusion.hybrid_join(fusion.rrf(knn_multi(spark, sf_dir, 10).withColumnRenamed("similarity", "score")), keyword_hits(spark, sf_dir))
)

# Contents repeat on purpose: ten texts serve all chunks of a document.
SHOWN = "shown_ AS (SELECT vec_id AS chunk_id, '  Chunk ' || label || ' ' || (vec_id % 7) || ' ' AS content FROM embeddings)"
MERGE_SQL = """merged_ AS (SELECT query_id, item_id, content, score, source, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source, item_id)::INTEGER AS rank FROM (
   SELECT *, row_number() OVER (PARTITION BY query_id, substr(lower(trim(content)), 1, 100) ORDER BY score DESC, source, item_id) AS n FROM parts_) WHERE n = 1)"""


def shown(spark, sf_dir):
    text = F.concat(F.lit("  Chunk "), F.col("label").cast("string"), F.lit(" "), (F.col("vec_id") % 7).cast("string"), F.lit(" "))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), text.alias("content"))


def with_content(spark, sf_dir, hits, score: str = "similarity"):
    return hits.join(shown(spark, sf_dir), "chunk_id").select("query_id", F.col("chunk_id").alias("item_id"), "content", F.col(score).alias("score"))


@query("f03_merge_sentences", f"""WITH {VECS}, {knn_sql(10).format(shift=0)}, {knn_sql(10, "c.vec_id % 3 = 0", name="sent").format(shift=0)}, {SHOWN},
  parts_ AS (SELECT query_id, chunk_id AS item_id, content, round(similarity, 9) AS score, 0 AS source FROM knn_ JOIN shown_ USING (chunk_id) UNION ALL SELECT query_id, chunk_id, content, round(similarity * 1.2::DOUBLE, 9), 1 FROM sent_ JOIN shown_ USING (chunk_id)), {MERGE_SQL}
  SELECT * FROM merged_ WHERE rank <= 12""")
def merged(spark, sf_dir):
    chunks = vectors.knn(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir), 10)
    sentences = vectors.knn(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir).where("chunk_id % 3 = 0"), 10)
    return fusion.merge_sentences(with_content(spark, sf_dir, chunks), with_content(spark, sf_dir, sentences), limit=12)


@query("f05_multi_step_merge", f"""WITH {MULTI}, {SHOWN}, cut_ AS (SELECT query_id, set_id AS sub, rank, chunk_id, (chunk_id % 3)::BIGINT AS page_number, content FROM multi_ JOIN shown_ USING (chunk_id) WHERE rank <= greatest(3, 15 // 2)),
  once_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, page_number, content ORDER BY sub, rank) AS n FROM cut_) WHERE n = 1)
  SELECT query_id, sub, rank, chunk_id, page_number, content, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sub, rank, chunk_id)::INTEGER AS position FROM once_) WHERE position <= 15""")
def steps(spark, sf_dir):
    hits = knn_multi(spark, sf_dir, 10).withColumnRenamed("set_id", "sub").join(shown(spark, sf_dir), "chunk_id").withColumn("page_number", F.col("chunk_id") % 3)
    return fusion.multi_step_merge(hits, 15).select("query_id", "sub", "rank", "chunk_id", "page_number", "content", "position")


@query("f06_content_hash_groups", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def same_content(spark, sf_dir):
    return fusion.content_hash_groups(read(spark, sf_dir, "documents"), "doc_id", "text")


RETRIEVE_SQL = f"""WITH {FUSED}, top_ AS (SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM fused_) WHERE r <= 40),
  re_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS r FROM (SELECT t.query_id, t.chunk_id, round({COS.format(a='q.v', b='c.v')}, 9) AS similarity FROM top_ t JOIN vecs_ q ON q.vec_id = t.query_id JOIN vecs_ c ON c.vec_id = t.chunk_id)) WHERE r <= 15),
  {knn_sql(10, "c.vec_id % 3 = 0", name="sent").format(shift=0)}, {SHOWN},
  parts_ AS (SELECT query_id, chunk_id AS item_id, content, round(similarity, 9) AS score, 0 AS source FROM re_ JOIN shown_ USING (chunk_id) UNION ALL SELECT query_id, chunk_id, content, round(similarity * 1.2::DOUBLE, 9), 1 FROM sent_ JOIN shown_ USING (chunk_id)), {MERGE_SQL}
  SELECT * FROM merged_ WHERE rank <= 10"""


@query("f07_retrieve", RETRIEVE_SQL)
def retrieve(spark, sf_dir, stored: bool = False):
    """The whole chain: two vector searches fused by rank, keywords mixed in, 40 reranked to 15, sentences merged, ten kept."""
    best = vectors.top(fused(spark, sf_dir, stored), ["query_id"], "score", "chunk_id", 40).select("query_id", "chunk_id", F.col("score").alias("similarity"))
    full = best.join(vector_queries(spark, sf_dir).drop("document_id"), "query_id").join(vector_chunks(spark, sf_dir).drop("document_id"), "chunk_id")
    again = vectors.rerank(full)
    sentences = vectors.knn(vector_queries(spark, sf_dir), vector_chunks(spark, sf_dir).where("chunk_id % 3 = 0"), 10)
    return fusion.merge_sentences(with_content(spark, sf_dir, again), with_content(spark, sf_dir, sentences), limit=10)


query("f07_retrieve_postings", RETRIEVE_SQL)(lambda s, d: retrieve(s, d, stored=True))
