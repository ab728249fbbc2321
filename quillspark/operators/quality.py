"""Reports on a crawl: status counts, reasons for skipped rows, incomplete pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx


def status_histogram(meta: DataFrame) -> DataFrame:
    """(status, n) of rows that are not 200, and their sum as the status ``TOTAL``; NULL counts as blank."""
    bad = meta.select(tx.strip(F.coalesce("status", F.lit(""))).alias("status")).where("status <> '200'")
    return bad.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("status")).alias("status"), "n")


def classified(meta: DataFrame, files: DataFrame | None = None, file: str = "file") -> DataFrame:
    """Rows with ``reason``: NULL if usable, else status, empty path, or missing file, in this order of checks."""
    m = meta.withColumns({"status": tx.strip(F.coalesce("status", F.lit(""))), "path": tx.strip(F.translate(F.coalesce(file, F.lit("")), "\\", "/"))})
    if files is None:
        missing = F.lit(False)
    else:
        known = files.select(F.col(file).alias("path"), F.lit(True).alias("__there")).distinct()
        m = m.join(known, "path", "left")
        missing = F.col("__there").isNull()
    m = m.withColumn("reason", F.when(F.col("status") != "200", "status").when(F.col("path") == "", "empty path").when(missing, "missing file"))
    return m.drop("__there")


def skip_reasons(meta: DataFrame, files: DataFrame | None = None) -> DataFrame:
    return classified(meta, files).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def skipped_rows(meta: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The skipped rows themselves: (reason, url, path), as the lists a report prints."""
    return classified(meta, files).where("reason IS NOT NULL").select("reason", "url", "path")


def malformed_count(entities: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, rows without any of the columns, rows that lack some."""
    blanks = [F.coalesce(F.length(tx.strip(F.col(c).cast("string"))), F.lit(0)) == 0 for c in columns]
    all_, some = F.lit(True), F.lit(False)
    for b in blanks:
        all_, some = all_ & b, some | b
    return entities.agg(F.count("*").alias("n"), F.count_if(all_).alias("malformed"), F.count_if(some).alias("incomplete"))


def url_map(meta: DataFrame) -> DataFrame:
    """(doc_id, url): the latest URL of each article that was fetched; by fetch time, then log number."""
    m = meta.withColumns({c: tx.strip(F.coalesce(c, F.lit(""))) for c in ("doc_id", "status", "url")})
    ok = m.where("status = '200' AND doc_id NOT IN ('', '-1')")
    return ok.groupBy("doc_id").agg(F.max_by("url", F.struct(F.coalesce("fetched_at", F.to_timestamp(F.lit("0001-01-01"))).alias("t"), "log_id")).alias("url"))
