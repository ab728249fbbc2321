"""Crawl frontier as state tables: links in, next pages out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import markup as mk
from quillspark.functions import urls as ur
from quillspark.session import broadcast_if_small, materialize

STATE = "url string, tier int, seq long"


@dataclass(frozen=True)
class Frontier:
    """``pending`` (url, tier, seq): tier 0 before 1, first in first out; ``seen`` (url)."""

    pending: DataFrame
    seen: DataFrame


def seed(spark: SparkSession, root: str) -> Frontier:
    return Frontier(spark.createDataFrame([(root, 1, 0)], STATE), spark.createDataFrame([(root,)], "url string"))


def extract_links(pages: DataFrame, html: str = "html", order: str = "page_id") -> DataFrame:
    """(link, seq): links of all pages, in order of page and place."""
    found = pages.where(F.col(html).isNotNull()).select(F.col(order).alias("__o"), F.posexplode(mk.links(F.col(html))).alias("__p", "link"))
    return found.select("link", F.struct("__o", "__p").alias("seq"))


def new_links(links: DataFrame, seen: DataFrame, rules: ur.CrawlRules) -> DataFrame:
    """(url, tier, seq) of links that are accepted and not seen: normalised, once each, at their first place."""
    u = links.select(ur.normalize(F.col("link")).alias("url"), "seq").where((F.col("url") != "") & rules.accepts(F.col("url")))
    return u.groupBy("url").agg(F.min("seq").alias("seq")).join(seen, "url", "left_anti").select("url", rules.tier(F.col("url")).alias("tier"), "seq")


def add(state: Frontier, links: DataFrame, rules: ur.CrawlRules, source_cap: int = 2000) -> Frontier:
    """The frontier with the links' new URLs. Sources beyond ``source_cap`` pending ones are dropped and not seen, so that
    they may come again; entity pages have no cap. New URLs are made once and numbered over all tasks (``numbered``)."""
    sources, last = state.pending.agg(F.count_if(F.col("tier") == 1), F.coalesce(F.max("seq"), F.lit(-1))).first()
    new = numbered(materialize(new_links(links, state.seen, rules)), "tier", ["seq", "url"], "k").where((F.col("tier") == 0) | (F.col("k") <= max(0, source_cap - sources)))
    new = new.select("url", "tier", (F.col("k") + F.lit(last)).cast("long").alias("seq"))
    return Frontier(state.pending.unionByName(new), state.seen.unionByName(new.select("url")))


def numbered(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Add ``out``: 1, 2, ... within each ``group`` by ``order``. Rows are range-partitioned and sorted, so groups of any size
    spread over tasks; a row's number is its place in its task and the sum of its group's rows in earlier tasks."""
    cut = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    cut = materialize(cut)  # the places stay as they are
    runs = cut.groupBy(group, "__p").agg(F.count("*").alias("__n"), F.min("__i").alias("__first"))  # a row a task and group
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    return cut.join(broadcast_if_small(runs), [group, "__p"]).withColumn(out, F.col("__before") + F.col("__i") - F.col("__first") + 1).drop("__p", "__i", "__before", "__first")


def take(state: Frontier, n: int) -> tuple[DataFrame, Frontier]:
    """The next ``n`` pages, and the frontier without them."""
    batch = state.pending.orderBy("tier", "seq", "url").limit(n)
    return batch, Frontier(state.pending.join(batch.select("url"), "url", "left_anti"), state.seen)


def budget(pages: DataFrame, done: int, most: int) -> tuple[DataFrame, int]:
    """The fetched pages (status, seq) that still count, and how many pages are done then: only those with status 200 use
    the budget of ``most``, and nothing after the page that uses it up, or after a 403, is taken."""
    w = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # one batch of ``take``
    good, stop = F.count_if(F.col("status") == "200").over(w), F.coalesce(F.count_if(F.col("status") == "403").over(w), F.lit(0))
    kept = materialize(pages.withColumn("__ok", (F.coalesce(good, F.lit(0)) + done < most) & (stop == 0)).where("__ok").drop("__ok"))
    return kept, done + kept.where("status = '200'").count()


def save(state: Frontier, path: str) -> None:
    state.pending.write.mode("overwrite").parquet(f"{path}/pending")
    state.seen.write.mode("overwrite").parquet(f"{path}/seen")


def load(spark: SparkSession, path: str, root: str | None = None) -> Frontier:
    """A saved frontier; one with ``root`` alone if nothing was saved or all is empty."""
    try:
        got = Frontier(spark.read.parquet(f"{path}/pending"), spark.read.parquet(f"{path}/seen"))
        if root is None or not (got.pending.isEmpty() and got.seen.isEmpty()):
            return got
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) or root is None:
            raise
    return seed(spark, root)


def read_json_state(spark: SparkSession, path: str) -> Frontier:
    """A frontier kept as one JSON object with the arrays queue, sources and seen; missing ones are empty."""
    j = spark.read.schema("queue array<string>, sources array<string>, seen array<string>").option("multiLine", True).json(path)

    def part(column: str, tier: int) -> DataFrame:
        return j.select(F.posexplode(F.coalesce(column, F.array())).alias("seq", "url")).select("url", F.lit(tier).alias("tier"), F.col("seq").cast("long").alias("seq"))

    return Frontier(part("queue", 0).unionByName(part("sources", 1)), j.select(F.explode(F.coalesce("seen", F.array())).alias("url")).distinct())
