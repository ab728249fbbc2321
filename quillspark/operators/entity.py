"""Building merged entities: joins, collection, completeness, one row a key."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import markup as mk
from quillspark.functions import text as tx
from quillspark.session import materialize

WIKI_COLUMNS = ("wiki_sport", "wiki_birth_place", "wiki_position", "wiki_club", "wiki_height", "wiki_bio")


def live(meta: DataFrame) -> DataFrame:
    return meta.where(F.col("status") == "200")


def split_pages(meta: DataFrame, marker: str = "-1") -> tuple[DataFrame, DataFrame]:
    """(entity pages, article pages); rows with a NULL doc_id are in neither."""
    return meta.where(F.col("doc_id") == marker), meta.where(F.col("doc_id") != marker)


def extract_entities(pages: DataFrame) -> DataFrame:
    """One row a page with ``raw_html`` and ``url``: attributes (NULL if missing) and medal counts (0 if there are none)."""
    found = pages.withColumns({k: mk.attribute(F.col("raw_html"), v) for k, v in mk.ATTRIBUTES.items()} | mk.medal_counts(F.col("raw_html")))
    return found.select("name", F.col("noc").alias("country"), "sport", "participations", "first_games", "yob", "gold", "silver", "bronze", F.col("url").alias("athlete_url"))


def extract_articles(pages: DataFrame, minlen: int = 30) -> DataFrame:
    """(doc_id, url, text, text_norm) of the pages that have text. Each regex runs once, in its own projection."""
    c = pages.withColumn("__c", mk.without_junk(F.col("raw_html")))
    c = c.withColumns({"__b": mk.text_blocks(F.col("__c"), minlen), "__m": mk.main_text(F.col("__c")), "__p": mk.paragraphs(F.col("__c"))})
    c = c.withColumn("text", mk.article_text(F.col("__b"), F.col("__m"), F.col("__p"), minlen)).where(F.length("text") > 0)
    return c.select("doc_id", "url", "text", tx.text_key(F.col("text")).alias("text_norm"))


def extract_wiki(dump: DataFrame) -> DataFrame:
    """Wiki entities of pages (title, text): articles with an infobox of a person of sports."""
    pages = dump.where(F.col("title").isNotNull() & ~F.col("title").rlike(mk.NAMESPACES) & ~F.col("text").rlike("(?i)#redirect"))
    heads = pages.withColumn("__h", mk.infobox_head(F.col("text"))).where(mk.is_candidate(F.col("__h")))
    values = {c: mk.infobox_value(F.col("__h"), names) for c, names in mk.INFOBOX.items()}
    return heads.select(mk.title_name(F.col("title")).alias("name"), *[v.alias(c) for c, v in values.items()], mk.biography(F.col("text")).alias("wiki_bio"))


#: Names held against all texts in one pass: a nested loop in the JVM up to the first bound, an automaton up to the second.
LOOP_NAMES, BLOCK_NAMES = 500, 200_000


def substring_join(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Pairs where a text contains a name, anywhere, not only at words. An empty name is in every text, NULL in none.

    A theta-join: the names are the query set and are held against all texts in blocks, whose number follows from a
    count, so nothing unbounded is broadcast and texts are not shuffled. Few names make a broadcast nested loop; more
    are found in one pass over each text by an automaton of all names of the block. Repeated names give repeated pairs."""
    known = names.where(F.col(name).isNotNull())
    one = materialize(known.select(name).distinct())
    n, rows = one.count(), known.count()
    if n <= LOOP_NAMES:
        out = texts.join(F.broadcast(one), F.contains(F.col(text), F.col(name)))  # counted
    else:
        blocks = -(-n // BLOCK_NAMES)
        out = None
        for i in range(blocks):
            block = one.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == i)
            part = texts.withColumn(name, F.explode(_names_in(text, [r[0] for r in block.collect()])))  # at most about BLOCK_NAMES
            out = part if out is None else out.unionByName(part)
    return out if len(names.columns) == 1 and rows == n else out.join(known, name)


def _names_in(text: str, names: list[str]) -> Column:
    """The names that each text contains, as an array."""
    kept: dict = {}

    @F.pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        if "a" not in kept:
            import ahocorasick

            kept["a"] = ahocorasick.Automaton()
            for w in names:
                if w:
                    kept["a"].add_word(w, w)
            kept["a"].make_automaton()
        blank = [""] if "" in names else []
        auto = kept["a"] if len(kept["a"]) else None
        return texts.map(lambda t: None if t is None else sorted({w for _, w in auto.iter(t)} if auto else ()) + blank, na_action=None)

    return find(F.col(text))


def substring_join_tokens(texts: DataFrame, names: DataFrame, text: str, name: str, key: str) -> DataFrame:
    """The same pairs without a broadcast, for names of three or more words: an inner word of the name must be a whole
    word of the text, so texts and names meet on it, and ``contains`` decides. Shorter names go through ``substring_join``."""
    words = F.split(F.trim(F.regexp_replace(F.col(name), r"\s+", " ")), " ")
    long = names.where(F.size(words) >= 3)
    inner = long.withColumn("__w", F.slice(words, 2, F.size(words) - 2)).withColumn("__w", F.array_max(F.transform("__w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"])
    tokens = texts.select("*", F.explode(F.array_distinct(F.split(F.col(text), r"\s+"))).alias("__w"))
    met = tokens.join(inner, "__w").where(F.contains(F.col(text), F.col(name))).drop("__w")
    return met.unionByName(substring_join(texts, names.where(F.coalesce(F.size(words), F.lit(0)) < 3), text, name))


def collect_articles(pairs: DataFrame, key: str, text: str = "text", url: str = "url") -> DataFrame:
    """(key, lookup_texts, lookup_urls): aligned arrays in order of url, then text."""
    got = pairs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(url).alias("u"), F.col(text).alias("t")))).alias("__a"))
    return got.select(key, F.col("__a.t").alias("lookup_texts"), F.col("__a.u").alias("lookup_urls"))


def merge(entities: DataFrame, wiki: DataFrame, articles: DataFrame | None = None, key: str = "name_norm") -> DataFrame:
    """Entities with wiki columns and articles by ``key``; several wiki rows of a key give several rows. Only wiki rows of
    known keys are joined; AQE picks the join by their size."""
    known = wiki.join(entities.select(key).distinct(), key, "left_semi").select(key, *[c for c in WIKI_COLUMNS if c in wiki.columns])
    out = entities.join(known, key, "left")
    return out if articles is None else out.join(articles, key, "left")


def completeness(columns: Sequence[str]) -> Column:
    """How many of the columns hold a text that isn't empty."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.length(F.col(c)) > 0, F.lit(False)).cast("int")
    return total


def best_per_key(df: DataFrame, key: str, columns: Sequence[str], ties: Sequence[Column]) -> DataFrame:
    """One row a key: the most complete, then by ``ties``. NULL keys are one key.

    ``max_by`` keeps one row a key before the shuffle, so a key with any share of the rows is no hot group, which a
    window over it would be."""
    packed = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(completeness(columns).alias("s"), *[t.alias(f"t{i}") for i, t in enumerate(ties)])).alias("__r"))
    return packed.select(*[F.col(key) if c == key else F.col("__r")[c].alias(c) for c in df.columns])


def build_entities(meta: DataFrame, files: DataFrame, dump: DataFrame, minlen: int = 30) -> DataFrame:
    """The whole build: crawl log, files (file, raw_html) and wiki pages to merged entities, one row a name key."""
    ent_meta, art_meta = split_pages(live(meta))
    entities = extract_entities(ent_meta.join(files, "file", "left")).withColumn("name_norm", tx.name_key(F.col("name")))
    articles = extract_articles(art_meta.join(files, "file", "left"), minlen)
    names = entities.select("name_norm").distinct()
    hits = substring_join(articles, names, "text_norm", "name_norm")
    wiki = extract_wiki(dump).withColumn("name_norm", tx.name_key(F.col("name")))
    merged = merge(entities, wiki, collect_articles(hits, "name_norm"))
    return best_per_key(merged, "name_norm", WIKI_COLUMNS, [F.length(F.coalesce("wiki_bio", F.lit(""))), F.col("athlete_url")])
