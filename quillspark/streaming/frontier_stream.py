"""Incremental frontier: a stream of fetched pages feeds the frontier tables, one step a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillspark.functions.urls import CrawlRules
from quillspark.operators import frontier


def run(pages: DataFrame, path: str, root: str, rules: CrawlRules, checkpoint: str, source_cap: int = 2000, html: str = "html", order: str = "page_id") -> StreamingQuery:
    """Start the query. State lives in versioned folders below ``path`` (one a batch), so a batch that runs again after
    a failure reads the version before it and writes the same one; the stream's own state stays empty."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        state = frontier.load(spark, f"{path}/v{number - 1}", root) if number else frontier.seed(spark, root)
        frontier.save(frontier.add(state, frontier.extract_links(batch, html, order), rules, source_cap), f"{path}/v{number}")

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
