"""Full-text search: tokens, term-frequency match, BM25 and highlighting, all in built-in functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Words that search ignores.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "need", "it", "its", "he", "she", "they", "we", "you", "i", "me", "my",
)
#: Fixed values of BM25.
K1, B = 1.2, 0.75


def tokens(text: Column, stop: bool = False) -> Column:
    """Runs of a-z and 0-9 in lower case, with or without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS)) if stop else found


def query_terms(query: str) -> list[str]:
    return [t for t in re.findall("[a-z0-9]+", query.lower()) if t not in STOP_WORDS]


def match(text: Column, query: str, least: float = 0.1) -> Column:
    """Whether the query's terms make up more than a share of the text's; a query without terms matches all."""
    terms = query_terms(query)
    if not terms:
        return F.lit(True)
    found = tokens(text, stop=True)
    hits = F.transform(F.array(found), lambda t: F.struct(F.size(F.filter(t, lambda x: x.isin(*sorted(set(terms))))).alias("n"), F.size(t).alias("all")))[0]
    return F.coalesce(hits["n"] / F.nullif(hits["all"], F.lit(0)) > least, F.lit(False))


def bm25(documents: DataFrame, key: str, column: str, query: str) -> DataFrame:
    """Score of each document that holds a term of the query.

    The texts are read once: lengths and the terms that are asked for go to a table in the shared folder, from which the
    corpus statistics and the counts come; only (term, document) rows of the query's few terms are counted, and
    document frequencies come back as a table of at most that many rows.
    """
    terms = sorted(set(query_terms(query)))
    base = documents.select(key, tokens(F.col(column), stop=True).alias("t_")).select(key, F.size("t_").alias("len_"), F.filter("t_", lambda x: x.isin(*terms)).alias("hits_"))
    base = Scratch(documents.sparkSession, "bm25").save(base, "base")
    stats = base.agg(F.struct(F.count("*").alias("n_docs"), F.avg("len_").alias("avg_len")).alias("s")).scalar()
    n, avg = stats["n_docs"], stats["avg_len"]
    tf = base.where(F.size("hits_") > 0).select(key, "len_", F.explode("hits_").alias("term")).groupBy(key, "len_", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len_") / avg))
    # at most one row for each term of the query
    return tf.join(F.broadcast(df), "term").groupBy(key).agg(F.sum(weight).alias("score"))


def highlight_all(text: Column, terms: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Every occurrence of a term, in either case, between marks."""
    found = text
    for term in terms:
        if term:
            found = F.regexp_replace(found, f"(?i)({re.escape(term)})", f"{before}$1{after}")
    return found


def snippet(text: Column, terms: list[str], most: int) -> Column:
    """About ``most`` characters around the first occurrence of any term, with dots where text is left out."""
    places = F.array(*[F.locate(t, F.lower(text)) for t in terms]) if terms else F.array(F.lit(0))
    at = F.array_min(F.filter(places, lambda p: p > 0))
    size = F.char_length(text)
    start = F.greatest(F.least(at - 1 - most // 4, size - most), F.lit(0))
    part = F.concat(F.when(start > 0, "...").otherwise(""), F.substr(text, start + 1, F.lit(most)), F.when(start + most < size, "...").otherwise(""))
    plain = F.when(size > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return F.when(at.isNull(), plain).otherwise(part)


def inverted(documents: DataFrame, key: str, column: str) -> DataFrame:
    """The inverted table (term, key, tf)."""
    return documents.select(key, F.explode(tokens(F.col(column))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def having_all(index: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """Keys whose documents hold every term, from the inverted table."""
    wanted = sorted(set(terms))
    return index.where(F.col("term").isin(*wanted)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key)
