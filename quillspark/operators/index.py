"""Inverted indexes as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.session import materialize


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, tf), terms (term, df, idf), docs (doc_id, doc_len), stats: one row (n_docs, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame


def tokenized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, tokens) of documents with at least one token. Repeated keys count once, NULL keys and texts not at all."""
    one = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("__t")).dropDuplicates(["doc_id"])
    return one.select("doc_id", tx.index_tokens(F.coalesce("__t", F.lit(""))).alias("tokens")).where(F.size("tokens") > 0)


def idf(df: Column, n: Column, method: str = "") -> Column:
    """``ln(n/df)``, or with ``bm25`` ``ln((n-df+.5)/(df+.5))``, at least 0.01; 0 where df or n isn't positive."""
    value = F.greatest(F.log((n - df + 0.5) / (df + 0.5)), F.lit(0.01)) if method == "bm25" else F.log(n / df)
    return F.when((df > 0) & (n > 0), value).otherwise(0.0)


def index_of(tokens: DataFrame, method: str = "") -> Index:
    postings = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    docs = tokens.select("doc_id", F.size("tokens").alias("doc_len"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avgdl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats.select("n_docs")))  # one row
    return Index(postings, terms.select("term", "df", idf(F.col("df"), F.col("n_docs"), method).alias("idf")), docs, stats)


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", method: str = "", keep: bool = True) -> Index:
    """Index a collection. ``keep``: tokens are written once, so that every table of the index reads them."""
    tokens = tokenized(docs, key, text)
    return index_of(materialize(tokens) if keep else tokens, method)


def save_index(index: Index, path: str) -> None:
    """Parquet tables; postings range-partitioned and sorted by term, so that a term filter skips row groups."""
    index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("terms", "docs", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "docs", "stats")))


def export_json(index: Index) -> DataFrame:
    """JSON lines {"term", "part", "df", "idf", "postings": {doc: tf}} for other programs; a term has a line for each of 64
    parts of the documents that it occurs in, so that a common term isn't gathered in one row."""
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    lists = index.postings.groupBy("term", part.alias("part")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("d"), "tf")))).alias("postings"))
    return lists.join(index.terms, "term").select(F.to_json(F.struct("term", "part", "df", "idf", "postings")).alias("json"))


# Per-field index of entities

@dataclass(frozen=True)
class Field:
    name: str
    source: str
    boost: float


#: Searched fields, the columns they come from, and their weights.
FIELDS = (
    Field("name", "name", 5.0), Field("sport_text", "sport", 3.0), Field("country_text", "country", 3.0), Field("wiki_sport", "wiki_sport", 2.0), Field("wiki_birth_place", "wiki_birth_place", 2.0),
    Field("wiki_position", "wiki_position", 1.5), Field("wiki_club", "wiki_club", 1.2), Field("wiki_bio", "wiki_bio", 1.1), Field("lookup_texts", "lookup_texts", 1.05),
)
#: Columns kept whole, and those that ranges are searched in.
KEYWORDS = ("name", "country", "sport", "first_games")
INTEGERS = ("gold", "silver", "bronze", "yob", "participations")


def field_text(entities: DataFrame, source: str) -> Column:
    c = F.col(source)
    return F.array_join(c, " ") if dict(entities.dtypes)[source].startswith("array") else c.cast("string")


@dataclass(frozen=True)
class FieldIndex:
    """postings (field, term, doc_id, tf, dl), stats (field, n_docs, avgdl), docs: the entities with their keys and integers."""

    postings: DataFrame
    stats: DataFrame
    docs: DataFrame


def entity_docs(entities: DataFrame, key: str) -> DataFrame:
    """Entities with ``doc_id``, keyword columns as they are ('' if NULL) and integers that default to 0."""
    cols = set(entities.columns)
    keep = [F.col(key).alias("doc_id"), *[F.coalesce(F.col(k), F.lit("")).alias(f"k_{k}") for k in KEYWORDS if k in cols], *[F.coalesce(F.col(i).cast("string").try_cast("int"), F.lit(0)).alias(f"i_{i}") for i in INTEGERS if i in cols]]
    return entities.dropDuplicates([key]).select(*keep, *[c for c in entities.columns if c not in ("doc_id", key)])


def save_field_index(index: FieldIndex, path: str) -> None:
    """Parquet tables; postings range-partitioned and sorted by term, so that a query's words skip row groups."""
    index.postings.repartitionByRange("term", "field", "doc_id").sortWithinPartitions("term", "field", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("stats", "docs"):
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_field_index(spark, path: str) -> FieldIndex:
    return FieldIndex(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "stats", "docs")))


def build_field_index(entities: DataFrame, key: str, fields: Sequence[Field] = FIELDS, terms: Sequence[str] | None = None) -> FieldIndex:
    """Index of several fields. With ``terms`` only their postings are made, lengths and statistics stay complete."""
    docs = entity_docs(entities, key)
    parts = [F.struct(F.lit(f.name).alias("field"), tx.standard_tokens(F.coalesce(field_text(entities, f.source), F.lit(""))).alias("tokens")) for f in fields]
    long = docs.select("doc_id", F.explode(F.array(*parts)).alias("p")).select("doc_id", "p.field", "p.tokens").where(F.size("tokens") > 0).withColumn("dl", F.size("tokens"))
    stats = long.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tokens = F.col("tokens") if terms is None else F.filter("tokens", lambda t: t.isin(*terms))
    postings = long.select("doc_id", "field", "dl", F.explode(tokens).alias("term")).groupBy("field", "term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    return FieldIndex(postings, stats, docs)
