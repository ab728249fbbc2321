"""Driver queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import abuse, boilerplate, confusables, distinctive, leakage, linkage, markup, packing, survivor
from quillspark.llm.oracle import SQL  # noqa: F401
from quillspark.session import spread, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "athletes"), table(spark, d, "wiki_df")).select("ath_id", "wiki_id").distinct()


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    return linkage.link(table(spark, d, "athletes"), table(spark, d, "wiki_df")).withColumn("confidence", F.round("confidence", 3))


WIKI_FIELDS = ("wiki_bio", "wiki_club", "wiki_birth_place")


def _wiki_values(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "wiki_df").select("wiki_id", *WIKI_FIELDS).distinct()
    return w.select("wiki_id", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in WIKI_FIELDS])).alias("v")).select("wiki_id", "v.field", "v.value").where("value IS NOT NULL")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean(_wiki_values(spark, d), "field", "value", "clean", flag="marked").where("marked").select("wiki_id", "field").distinct()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean(_wiki_values(spark, d), "field", "value", "clean").select("wiki_id", "field", "clean")


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "lookups").select("doc_id", "site", "raw_html").where("raw_html IS NOT NULL").distinct()
    return markup.clean(pages, "site", "raw_html", "clean").select("doc_id", "site", "clean")


_FITTED: dict[tuple, object] = {}


def fitted(spark: SparkSession, d: str, kind: str, fit: Callable[[], object]) -> object:
    """A model fitted once a session and folder; queries that need the same one share it."""
    key = spark.sparkContext.applicationId, d, kind
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "lookups")
    return boilerplate.boilerplate_lines(pages, fitted(spark, d, "p4", lambda: boilerplate.train(pages)))


def p4_content(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "lookups")
    return boilerplate.label_lines(pages, fitted(spark, d, "p4", lambda: boilerplate.train(pages))).select("doc_id", "content").distinct()


def p4_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each page, counted from both parts it was split into: none is lost, none is in both."""
    pages = table(spark, d, "lookups")
    parts = boilerplate.label_lines(pages, fitted(spark, d, "p4", lambda: boilerplate.train(pages)))
    kept = F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", "\n", -1)))
    return parts.select("doc_id", (F.size("boilerplate") + kept).cast("long").alias("n_lines")).where("n_lines IS NOT NULL").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    won = survivor.wiki_survivors(table(spark, d, "final_entities"), table(spark, d, "wiki_df"), ("recency",))  # by its definition the latest usable value
    return won.where("usable").select("name_norm", "field", F.col("record").alias("wiki_id"))


def p5_heights(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).where("field = 'wiki_height'").select("name_norm", "wiki_id")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    won = survivor.wiki_survivors(table(spark, d, "final_entities"), table(spark, d, "wiki_df")).where("usable")
    return won.groupBy("name_norm").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in ("wiki_bio", "wiki_height")])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "athletes").select(F.lit("athletes").alias("tbl"), F.col("ath_id").alias("row_id"), "name").unionByName(table(spark, d, "wiki_df").select(F.lit("wiki_df").alias("tbl"), F.col("wiki_id").alias("row_id"), "name"))
    return confusables.odd_names(both, "name").select("tbl", "row_id").distinct()


def p3_unified(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "athletes").select(F.lit("athletes").alias("tbl"), F.col("ath_id").alias("row_id"), "name").unionByName(table(spark, d, "wiki_df").select(F.lit("wiki_df").alias("tbl"), F.col("wiki_id").alias("row_id"), "name"))
    return confusables.unify(both, "name", "unified").select("tbl", "row_id", "unified").distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.top_term(distinctive.index_distinctiveness(table(spark, d, "index_terms"))).select("doc_id", "term")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    s = distinctive.index_distinctiveness(table(spark, d, "index_terms"))
    return s.select("doc_id", "term", "tf", "df", "n_docs", F.round("weight", 4).alias("weight"), F.round("z", 4).alias("z"))


def p7_top_z(spark: SparkSession, d: str) -> DataFrame:
    return distinctive.top_term(distinctive.index_distinctiveness(table(spark, d, "index_terms")).withColumn("z", F.round("z", 9)), by="z").select("doc_id", "term")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p8_packed(spark, d))


def p8_faults(spark: SparkSession, d: str) -> DataFrame:
    return packing.faults(p8_packed(spark, d), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(spread(table(spark, d, "documents")), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    model = fitted(spark, d, "p10", lambda: abuse.train(docs, table(spark, d, "tox_labels"), table(spark, d, "abuse_terms")))
    return abuse.score_documents(docs, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("score > 0").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumn("score", F.round("score", 3))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


QUERIES = {"p1_found": p1_found, "p1_confidence": p1_confidence, "p4_found": p4_found, "p4_content": p4_content, "p4_lines": p4_lines, "p2_found": p2_found, "p2_clean": p2_clean, "p2_pages": p2_pages, "p5_found": p5_found, "p5_records": p5_records, "p5_heights": p5_heights, "p3_found": p3_found, "p3_unified": p3_unified, "p7_found": p7_found, "p7_scores": p7_scores, "p7_top_z": p7_top_z, "p8_packed": p8_packed, "p8_fill": p8_fill, "p8_faults": p8_faults, "p9_found": p9_found, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
