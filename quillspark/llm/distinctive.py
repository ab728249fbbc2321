"""How distinctive a term is per record: log-odds of record against rest with an informative Dirichlet prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small, materialize


def postings(index: DataFrame) -> DataFrame:
    """(doc_id, term, tf) of an index kept in segments. Copied rows of a (segment, term) count once; a page that several
    segments hold for a term keeps its largest count. Rows with NULL term or postings give nothing."""
    flat = index.where(F.col("term").isNotNull()).select("term", F.explode("postings").alias("doc_id", "tf"))
    return flat.where("tf > 0").groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))


def distinctiveness(posts: DataFrame, prior: float = 500.0) -> DataFrame:
    """For each (doc_id, term, tf): ``df`` pages with the term, ``n_docs`` pages in all, ``idf`` = ln(n_docs/df),
    ``weight`` = tf x idf, and ``z``: the log-odds of the term in the page against all other pages, with a Dirichlet
    prior of ``prior`` pseudo-counts spread as the collection's counts, divided by its standard error.

    Everything is counted over all rows. Shuffles are keyed by (term, doc_id), term sums and page sums are aggregated
    before they are joined back, so neither a hot term nor a long page is gathered in one task. Empty input: no rows."""
    posts = materialize(posts.select("doc_id", "term", F.col("tf").cast("double").alias("tf")))
    terms = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("__w"))
    docs = posts.groupBy("doc_id").agg(F.sum("tf").alias("__n"))
    total = docs.agg(F.count("*").alias("n_docs"), F.sum("__n").alias("__all"))
    return _scored(posts.join(terms, "term").join(docs, "doc_id").crossJoin(F.broadcast(total)), prior)  # one row


def _scored(t: DataFrame, prior: float) -> DataFrame:
    a = F.col("__w") / F.col("__all") * F.lit(prior)
    inside, rest = F.col("tf") + a, F.col("__w") - F.col("tf") + a
    odds: Column = F.log(inside / (F.col("__n") + prior - inside)) - F.log(rest / (F.col("__all") - F.col("__n") + prior - rest))
    idf = F.log(F.col("n_docs") / F.col("df"))
    return t.select("doc_id", "term", F.col("tf").cast("int").alias("tf"), "df", "n_docs", idf.alias("idf"), (F.col("tf") * idf).alias("weight"), (odds / F.sqrt(1 / inside + 1 / rest)).alias("z"))


def index_distinctiveness(index: DataFrame, prior: float = 500.0) -> DataFrame:
    """``distinctiveness(postings(index))``, but postings stay in their maps until they are scored: copied rows are
    dropped as whole maps, sums of terms and pages are aggregated before they are shuffled, and join the postings by
    broadcast as long as a count shows them to be few.

    Only pages that several segments hold, or that stand in different maps of one (segment, term), can have a posting
    twice. Their postings, and no others, are brought together by (term, page), where the largest count stays."""
    kept = index.where(F.col("term").isNotNull() & F.col("postings").isNotNull())
    entries = F.array_sort(F.map_entries(F.map_filter("postings", lambda _, n: n > 0)))
    maps = materialize(kept.select("segment", "term", entries.alias("e")).groupBy("segment", "term", "e").agg(F.lit(1).alias("__1")).drop("__1"))
    several = maps.groupBy("segment", "term").count().where("count > 1").select(F.col("segment").alias("__s"), F.col("term").alias("__t"), F.lit(True).alias("__several"))
    one = maps.join(broadcast_if_small(several), F.col("segment").eqNullSafe(F.col("__s")) & (F.col("term") == F.col("__t")), "left").select("segment", "term", F.explode("e").alias("p"), "__several")
    seen = materialize(one.groupBy(F.col("p.key").alias("doc_id")).agg(F.min("segment").alias("__a"), F.max("segment").alias("__b"), F.count_if(F.col("segment").isNull()).alias("__null"), F.count("*").alias("__all"), F.max("__several").alias("__several")))
    twice = broadcast_if_small(seen.where("NOT __a <=> __b OR __null NOT IN (0, __all) OR __several").select("doc_id"))
    flat = maps.select("term", F.explode("e").alias("p")).select("term", F.col("p.key").alias("doc_id"), F.col("p.value").alias("tf"))
    again = flat.join(twice, "doc_id", "left_semi").groupBy("term", "doc_id").agg(F.max("tf").alias("tf"))
    posts = flat.join(twice, "doc_id", "left_anti").unionByName(again).withColumn("tf", F.col("tf").cast("double"))
    terms = posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("__w"))
    docs = materialize(posts.groupBy("doc_id").agg(F.sum("tf").alias("__n")))
    total = docs.agg(F.count("*").alias("n_docs"), F.sum("__n").alias("__all"))
    return _scored(posts.join(broadcast_if_small(materialize(terms)), "term").join(broadcast_if_small(docs), "doc_id").crossJoin(F.broadcast(total)), prior)  # one row


def top_term(scored: DataFrame, by: str = "weight") -> DataFrame:
    """(doc_id, term) with the largest ``by`` of each page; the first term in code-point order if equal."""
    return scored.groupBy("doc_id").agg(F.min_by("term", F.struct(-F.col(by), "term")).alias("term"))
