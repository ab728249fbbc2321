"""Sources and sinks: crawl log, page files, wiki dump, entities, articles. Schemas are given, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.functions import urls as ur

METADATA = "doc_id string, status string, file string, date string, url string"
ATHLETES = "file string, name string, country string, sport string, participations string, first_games string, yob string, gold string, silver string, bronze string, url string"
#: How CSV files are written: values keep their outer blanks, quotes are doubled.
CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
WIKI = "title string, revision struct<text: struct<_VALUE: string>>"


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The crawl log, all strings, as it is."""
    return spark.read.schema(METADATA).option("header", True).option("escape", '"').csv(path)


def clean_metadata(meta: DataFrame) -> DataFrame:
    """The crawl log with outer white space gone and forward slashes."""
    return meta.withColumns({c: tx.strip(F.col(c)) for c in ("doc_id", "status", "url")} | {"file": tx.path_norm(F.col("file"))})


def article_ids(meta: DataFrame) -> DataFrame:
    """doc_id of every row that is no entity page, whatever its status, repeated ones repeated."""
    return meta.select(tx.strip(F.coalesce("doc_id", F.lit(""))).alias("doc_id")).where("doc_id <> '-1'")


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """(file, raw_html) of all files below a folder; file is the path from ``html/`` on, broken bytes are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(ur.file_suffix(F.col("path")).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("raw_html"))


def read_wiki(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of a wiki dump, plain or bz2; one pass, since the schema is given."""
    x = spark.read.format("xml").option("rowTag", "page").option("ignoreNamespace", "true").schema(WIKI).load(path)
    return x.select("title", F.col("revision.text._VALUE").alias("text"))


def read_athletes(spark: SparkSession, path: str) -> DataFrame:
    """Entities of a CSV file: strings stripped, medals as integers (NULL where they are none)."""
    raw = spark.read.schema(ATHLETES).option("header", True).option("escape", '"').csv(path)
    return raw.select(*[tx.strip(F.coalesce(c, F.lit(""))).alias(c) if c not in ("gold", "silver", "bronze") else tx.strip(F.col(c)).try_cast("int").alias(c) for c in raw.columns])


def read_articles(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, text) of a folder of DOC_ID.txt files."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(root)
    return raw.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def write_athletes(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**CSV).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to the crawl log; paths are normalised, rows without a date get today's."""
    day = F.coalesce("date", F.date_format(F.current_date(), "yyyy-MM-dd")) if "date" in df.columns else F.date_format(F.current_date(), "yyyy-MM-dd")
    df.select(F.col("doc_id"), F.col("status"), tx.path_norm(F.col("file")).alias("file"), day.alias("date"), F.col("url")).write.mode("append").options(**CSV).csv(path)


def init_log(spark: SparkSession, path: str) -> None:
    """An empty crawl log with its header, if there is none."""
    spark.createDataFrame([], METADATA).coalesce(1).write.mode("ignore").options(**CSV).csv(path)


def write_articles(articles: DataFrame, path: str) -> None:
    """Articles (doc_id, text) with text as Parquet sorted by doc_id, one row each; ``read_saved_articles`` reads them."""
    articles.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite").parquet(path)


def read_saved_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id string, text string").parquet(path)


def write_pages(pages: DataFrame, path: str, root: str = "") -> None:
    """Pages (url, tier, html) as Parquet, a folder for entities and one for the rest; ``root``: the page of all entities,
    which is no entity."""
    pages.withColumns({"folder": ur.route(F.col("tier"), F.col("url"), root), "file": ur.filename(F.col("url"))}).write.mode("overwrite").partitionBy("folder").parquet(path)


def write_entities(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def entity_json(df: DataFrame, path: str) -> None:
    df.select("name", "country", "sport", "gold", "silver", "bronze", "url").write.mode("overwrite").json(path)
