"""Full-text and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import cosine
from ..operators import search, vectors
from .core import query

_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x NOT IN (" + _STOP + "))"


@query(f"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_all, len({_TOKENS}) AS n_kept FROM documents")
def fts_tokenize(db):
    text = F.col("text")
    return db.table("documents").select("doc_id", F.size(search.tokens(text)).cast("long").alias("n_all"), F.size(search.tokens(text, stop=True)).cast("long").alias("n_kept"))


@query(f"SELECT doc_id FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE len(list_filter(t, lambda x: x IN ('and', 'of'))) / nullif(len(t), 0) > 0.1")
def fts_match(db):
    return db.table("documents").where(search.match(F.col("text"), "of the AND")).select("doc_id")


@query(
    f"""WITH base AS (SELECT doc_id, {_TOKENS} AS t FROM documents), stats AS (SELECT count(*) AS n, avg(len(t)) AS avg_len FROM base),
    tf AS (SELECT doc_id, len(t) AS l, term, len(list_filter(t, lambda x: x = term)) AS tf FROM base, (VALUES ('idiot'), ('thea'), ('anin')) AS q(term)), hit AS (SELECT * FROM tf WHERE tf > 0),
    df AS (SELECT term, count(*) AS df FROM hit GROUP BY term)
    SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / avg_len))), 6) AS score FROM hit JOIN df USING (term), stats GROUP BY doc_id"""
)
def bm25(db):
    return search.bm25(db.table("documents"), "doc_id", "text", "the idiot thea anin").select("doc_id", F.round("score", 6).alias("score"))


_MARKED = "SELECT doc_id, regexp_replace(text, '(the)', '<b>\\1</b>', 'gi') AS marked FROM documents"


@query(_MARKED, name="fts_highlight_whole")
@query(_MARKED)
def fts_highlight(db):
    return db.table("documents").select("doc_id", search.highlight_all(F.col("text"), ["the"]).alias("marked"))


@query(
    """SELECT item_id, CASE WHEN found = 0 THEN CASE WHEN n > 40 THEN left(text, 40) || '...' ELSE text END
       ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || substring(text, CAST(s + 1 AS BIGINT), 40) || (CASE WHEN s + 40 < n THEN '...' ELSE '' END) END AS part
       FROM (SELECT *, greatest(least(found - 1 - 10, n - 40), 0) AS s FROM (SELECT item_id, text, length(text) AS n, strpos(lower(text), 'heat') AS found FROM benchmark))"""
)
def fts_snippet(db):
    return db.table("benchmark").select("item_id", search.snippet(F.col("text"), ["heat"], 40).alias("part"))


@query("SELECT conv_id, turn FROM conversations WHERE list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the') AND list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'and')")
def inverted_and_search(db):
    rows = db.table("conversations").withColumn("key", F.struct("conv_id", "turn"))
    return search.having_all(search.inverted(rows, "key", "text"), "key", ["the", "and"]).select("key.conv_id", "key.turn")


_COSINE = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


_NEAREST = f"""SELECT query, vec_id, rank FROM (SELECT q.vec_id AS query, a.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COSINE}, 9) DESC, a.vec_id) AS rank
    FROM embeddings a, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 10"""


@query(_NEAREST, name="vector_cosine_topk_each")
@query(_NEAREST)
def vector_cosine_topk(db):
    """All query vectors against all rows."""
    rows = db.table("embeddings")
    return vectors.nearest_each(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), 10).select("query", "vec_id", "rank")


@query("SELECT a.vec_id AS x, b.vec_id AS y, round(list_cosine_similarity(a.embedding, b.embedding), 3) > 0.2 AS alike FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_pairs(db):
    a = db.table("embeddings").select(F.col("vec_id").alias("x"), F.col("embedding").alias("e"))
    b = db.table("embeddings").select(F.col("vec_id").alias("y"), F.col("embedding").alias("f"))
    return a.join(b, F.col("y") == F.col("x") + 1).select("x", "y", (F.round(cosine(F.col("e"), F.col("f")), 3) > 0.2).alias("alike"))


_ALIKE = f"SELECT q.vec_id AS query, a.vec_id FROM embeddings a, embeddings q WHERE q.vec_id % 50 = 0 AND {_COSINE} > 0.7"


@query(_ALIKE, name="semantic_match_vectors_each")
@query(_ALIKE)
def semantic_match_vectors(db):
    """All query vectors against all rows."""
    rows = db.table("embeddings")
    return vectors.alike_each(rows, "vec_id", "embedding", rows.where("vec_id % 50 = 0"), 0.7).select("query", "vec_id")


@query("SELECT item_id, 64 AS dimension, TRUE AS unit FROM benchmark")
def embed_text(db):
    vector = vectors.embed(F.col("text"))
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    return db.table("benchmark").select("item_id", vector.alias("v")).select("item_id", F.size("v").alias("dimension"), (F.abs(norm - 1) < 1e-9).alias("unit"))
