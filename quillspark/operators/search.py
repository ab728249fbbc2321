"""Ranked retrieval: TF-IDF, BM25, entity search, boosted multi-field search."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators.index import FIELDS, KEYWORDS, Field, FieldIndex, Index, build_field_index
from quillspark.plans.query_lang import AttributeQuery, FilterQuery, parse_attributes, parse_filters, text_tokens
from quillspark.session import broadcast_if_small

DIGITS = 6


def driver_tokens(query: str) -> list[str]:
    """Query words, folded as ``tx.query_tokens`` does."""
    return re.findall(r"\w+", tx.fold_text(query))


def query_terms(spark, query: str) -> DataFrame:
    """(term, qtf): a repeated word counts repeatedly."""
    return spark.createDataFrame(sorted(Counter(driver_tokens(query)).items()), "term string, qtf long")


def bm25_weight(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def of_terms(index: Index, words: Sequence[str]) -> Index:
    """The part of an index that a query's words need; the filter reaches the scan of a saved index."""
    few = F.col("term").isin(*words) if words else F.lit(False)
    return Index(index.postings.where(few), index.terms.where(few), index.docs, index.stats)


def scores(index: Index, terms: DataFrame, by: Sequence[str] = (), rank: str = "bm25", k1: float = 1.2, b: float = 0.75, few: bool = False) -> DataFrame:
    """(*by, doc_id, score) for query terms (*by, term, qtf): every document with some term; unknown terms do nothing.

    The terms of one query (``few``) are broadcast, those of a table of queries if a count shows that they are few;
    postings are filtered by them before anything is shuffled, and scores are summed map-side first."""
    terms = F.broadcast(terms) if few else broadcast_if_small(terms)
    hits = index.postings.join(terms, "term")
    wanted = index.terms.join(terms.select("term").distinct() if not few else F.broadcast(terms.select("term")), "term", "left_semi")
    hits = hits.join(wanted, "term")
    if rank == "tfidf":
        w = F.col("tf") * F.col("idf")
    else:
        hits = hits.join(index.docs, "doc_id").crossJoin(F.broadcast(index.stats.select("avgdl")))  # one row
        w = bm25_weight(F.col("idf"), F.col("tf"), F.col("doc_len"), F.col("avgdl"), k1, b)
    return hits.groupBy(*by, "doc_id").agg(F.round(F.sum(F.col("qtf") * w), DIGITS).alias("score"))


def search_text(index: Index, query: str, rank: str = "bm25", k: int = 10, urls: DataFrame | None = None) -> DataFrame:
    """(rank, doc_id, score[, url]): the k best documents; equal scores by doc_id. No words: no rows."""
    index = of_terms(index, sorted(set(driver_tokens(query))))
    top = scores(index, query_terms(index.postings.sparkSession, query), rank=rank, few=True).orderBy(F.desc("score"), "doc_id").limit(k)
    if urls is not None:
        top = top.join(urls, "doc_id", "left").withColumn("url", F.coalesce("url", F.lit("")))
    return numbered(top)


def numbered(top: DataFrame) -> DataFrame:
    """Ranks of an already cut result (k rows)."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))


def search_many(index: Index, queries: DataFrame, query_id: str, text: str, rank: str = "bm25", k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score) for a table of query texts."""
    terms = queries.select(query_id, F.explode(tx.query_tokens(F.col(text))).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("qtf"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), "doc_id")
    return scores(index, terms, (query_id,), rank).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# Entities by attributes

_COMPARE = {">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v, "==": lambda c, v: c == v}


def same_folded(c: Column, value: str) -> Column:
    return tx.fold(F.coalesce(c, F.lit(""))) == F.lit(tx.fold_text(value))


def attribute_filter(q: AttributeQuery) -> Column:
    """Country, sport and every medal comparison must hold; the name doesn't filter. A missing count is 0."""
    cond = F.lit(True)
    for column in ("country", "sport"):
        if getattr(q, column):
            cond = cond & same_folded(F.col(column), getattr(q, column))
    for column, op, value in q.medals:
        cond = cond & _COMPARE[op](F.coalesce(F.col(column), F.lit(0)), value)
    return cond


def attribute_score(q: AttributeQuery) -> Column:
    fixed = (1.0 if q.country else 0.0) + (1.0 if q.sport else 0.0) + 0.25 * len(q.medals)
    named = F.when(tx.contains_folded(F.col("name"), q.name), 2.0).otherwise(0.0) if q.name else F.lit(0.0)
    return named + F.lit(fixed)


def search_entities(entities: DataFrame, query: str | AttributeQuery, key: str, k: int = 10) -> DataFrame:
    """The k best entities of an attribute query, all their columns and ``score``; equal scores by ``key``. Rows of score
    0 go unless the query has a filter."""
    q = parse_attributes(query) if isinstance(query, str) else query
    hits = entities.where(attribute_filter(q)).withColumn("score", attribute_score(q))
    if not (q.country or q.sport or q.medals):
        hits = hits.where(F.col("score") != 0)
    return hits.orderBy(F.desc("score"), key).limit(k)


# Entities by fields

def range_filter(ranges) -> Column:
    cond = F.lit(True)
    for r in ranges:
        cond = cond & F.col(f"i_{r.column}").between(r.low, r.high)
    return cond


def quantize_length(dl: Column) -> Column:
    """Lengths as one byte keeps them: exact up to 40, then four leading bits."""
    rest = dl - 24
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(rest, F.lit(1)))) - 3, F.lit(0)))
    return F.when(dl < 40, dl.cast("double")).otherwise(24 + F.floor(rest / step) * step)


def field_scores(index: FieldIndex, terms: Sequence[str], fields: Sequence[Field] = FIELDS, quantize_norms: bool = False) -> DataFrame:
    """(doc_id, score): BM25 over fields, each with its boost; a term counts as often as it is given."""
    spark = index.postings.sparkSession
    q = spark.createDataFrame(sorted(Counter(terms).items()), "term string, qtf long")
    boosts = spark.createDataFrame([(f.name, f.boost) for f in fields], "field string, boost double")
    hits = index.postings.join(F.broadcast(q), "term")  # the words of one query
    df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    per = df.join(index.stats, "field").join(F.broadcast(boosts), "field")  # one row a field
    dl = quantize_length(F.col("dl")) if quantize_norms else F.col("dl")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = F.col("boost") * F.col("qtf") * idf * F.col("tf") / (F.col("tf") + 1.2 * (0.25 + 0.75 * dl / F.col("avgdl")))
    return hits.join(per, ["field", "term"]).groupBy("doc_id").agg(F.sum(w).alias("score"))


def keyword_scores(docs: DataFrame, phrase: str) -> DataFrame:
    """(doc_id, score) of entities with a keyword column equal to ``phrase``: idf/2.2 of each equal column."""
    cols = [f"k_{k}" for k in KEYWORDS if f"k_{k}" in docs.columns]
    stats = docs.agg(*[F.count_if(F.col(c) == phrase).alias(f"n{i}") for i, c in enumerate(cols)], F.count("*").alias("n"))
    hit = docs.where(F.lit(False) if not cols else " OR ".join(f"{c} = '{_sql(phrase)}'" for c in cols))
    total = F.lit(0.0)
    for i, c in enumerate(cols):
        total = total + F.when(F.col(c) == phrase, F.log(1 + (F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)) / 2.2).otherwise(0.0)
    return hit.crossJoin(F.broadcast(stats)).select("doc_id", total.alias("score"))  # one row


def _sql(s: str) -> str:
    return s.replace("\\", "\\\\").replace("'", "\\'")


def search_fields(entities: DataFrame | FieldIndex, query: str | FilterQuery, key: str, k: int = 100, fields: Sequence[Field] = FIELDS, quantize_norms: bool = False) -> DataFrame:
    """The k best entities of a filter query: their columns, ``doc_id`` and ``score``; equal scores by doc_id. A saved
    ``FieldIndex`` in place of the entities is read for the query's words only.

    Every word should occur in some field; each phrase must equal a keyword column. With integer ranges words only rank
    (each range adds 1); without, at least one word must occur. An empty query has no hits."""
    q = parse_filters(query) if isinstance(query, str) else query
    tokens = text_tokens(q.text) if q.text else []
    words = [w for t in tokens for w in tx.standard_words(t.text)]
    if isinstance(entities, FieldIndex):
        index = FieldIndex(entities.postings.where(F.col("term").isin(*set(words)) if words else F.lit(False)), entities.stats, entities.docs)
    else:
        index = build_field_index(entities, key, fields, terms=sorted(set(words)) or ["\u0000"])
    spark = index.docs.sparkSession
    docs = index.docs.where(range_filter(q.ranges))
    text_hits = None
    if q.text is not None:
        text_hits = field_scores(index, words, fields, quantize_norms) if words else spark.createDataFrame([], "doc_id " + dict(index.docs.dtypes)["doc_id"] + ", score double")
        for t in tokens:
            if t.phrase:
                exact = keyword_scores(index.docs, t.text).withColumnRenamed("score", "exact")
                text_hits = text_hits.join(exact, "doc_id").select("doc_id", (F.col("score") + F.col("exact")).alias("score"))
    if not q.ranges:
        if text_hits is None:
            return docs.withColumn("score", F.lit(0.0)).limit(0)
        scored = docs.join(text_hits, "doc_id")
    elif text_hits is None:
        scored = docs.withColumn("score", F.lit(float(len(q.ranges))))
    else:
        scored = docs.join(text_hits.withColumnRenamed("score", "__s"), "doc_id", "left").withColumn("score", F.coalesce("__s", F.lit(0.0)) + len(q.ranges)).drop("__s")
    return scored.withColumn("score", F.round("score", DIGITS)).orderBy(F.desc("score"), "doc_id").limit(k)


def stored_fields(hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(doc_id, score, fields): JSON of the stored columns that aren't NULL."""
    return hits.select("doc_id", "score", F.to_json(F.struct(*columns)).alias("fields"))


def result_view(hits: DataFrame, bio: int = 300, links: int = 20) -> DataFrame:
    """What a result page shows: defaults for missing values, the opening of the biography, the first links."""
    shown = [F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in ("name", "country", "sport") if c in hits.columns]
    medals = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gold", "silver", "bronze") if c in hits.columns]
    return hits.select("doc_id", *shown, *medals, F.substring(F.coalesce("wiki_bio", F.lit("")), 1, bio).alias("bio"), F.array_join(F.slice(F.coalesce("lookup_urls", F.array()), 1, links), " ").alias("links"))


def console_view(hits: DataFrame, links: int = 3) -> DataFrame:
    """Console lines: first links, dots if there are more, and medals."""
    urls = F.coalesce("lookup_urls", F.array().cast("array<string>"))
    more = F.when(F.size(urls) > links, " ...").otherwise("")
    return hits.select("doc_id", "name", F.concat(F.array_join(F.slice(urls, 1, links), " "), more).alias("links"), F.format_string("gold %d, silver %d, bronze %d", *[F.coalesce(F.col(c), F.lit(0)) for c in ("gold", "silver", "bronze")]).alias("medals"))


def search(index: Index, entities: DataFrame, query: str, key: str, rank: str = "bm25", k: int = 10, urls: DataFrame | None = None) -> DataFrame | None:
    """Console dispatch: ``q:`` ends (None), ``ath:`` searches entities by attributes, anything else is full text."""
    query = query.strip()
    if query.startswith("q:"):
        return None
    if query.startswith("ath:"):
        return search_entities(entities, query[4:].strip(), key, k)
    return search_text(index, query, rank, k, urls)
