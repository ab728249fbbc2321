"""Driver queries of the core. Each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import markup as mk
from quillspark.functions import text as tx
from quillspark.functions import urls as ur
from quillspark.operators import entity, frontier, index, quality, search, units
from quillspark.plans.query_lang import to_range
from quillspark.session import exists, own_path, spread, table
from quillspark.sources import readers

QUERY = "injury night train protest final protest"
RULES = ur.CrawlRules("arena-results.example")
ATTRIBUTE_QUERIES = {
    "attr_search_country": 'country:"great britain" gold>=1', "attr_search_sport": 'sport:ROWING silver>0 bronze<3', "attr_search_name": "maria",
    "attr_search_medals": "gold>=1 silver=1 bronze<=2", "attr_search_mixed": "sport:judo country:chile anna",
}
FIELD_QUERIES = {
    "multifield_search": "croatian rower swimming", "phrase_exact_search": '"Rowing" coach', "filtered_search": "canoe sprint gold>=1 born>1980",
    "filter_only_search": "born<1990 participations>=2 silver>0", "phrase_filter_search": '"Kaukora 2010" sweden yob>=1985', "decimal_search": "1.80 olympic rower", "stored_fields": "judo germany",
}


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def _index(spark, d, method="", keep=True) -> index.Index:
    return index.build_index(docs(spark, d), method=method, keep=keep)


_SAVED: dict[tuple, str] = {}


def saved(spark, d, kind: str, save) -> str:
    """Where the index of a collection is saved: built on the first search of a session, read by all others; built again if
    its last file is gone."""
    key = spark.sparkContext.applicationId, d, kind
    if key not in _SAVED or not exists(spark, f"{_SAVED[key]}/docs/_SUCCESS"):
        path = own_path(spark, kind)
        save(path)
        _SAVED[key] = path
    return _SAVED[key]


def _saved_index(spark, d, method) -> index.Index:
    return index.load_index(spark, saved(spark, d, "index" + method, lambda path: index.save_index(_index(spark, d, method), path)))


def _saved_fields(spark, d) -> index.FieldIndex:
    e = table(spark, d, "final_entities").drop("wiki_id")
    return index.load_field_index(spark, saved(spark, d, "fields", lambda path: index.save_field_index(index.build_field_index(e, "entity_id"), path)))


def index_build(spark, d):
    """Builds and saves the index that the searches read."""
    path = own_path(spark, "built")
    index.save_index(_index(spark, d, "bm25"), path)
    return index.load_index(spark, path).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def field_index_build(spark, d):
    """Builds and saves the index of the entities' fields."""
    path = own_path(spark, "built")
    index.save_field_index(index.build_field_index(table(spark, d, "final_entities").drop("wiki_id"), "entity_id"), path)
    return index.load_field_index(spark, path).postings.select("field", "term", "doc_id", "tf", "dl")


def tokenize_docs(spark, d):
    return index.tokenized(docs(spark, d)).select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def query_tokens(spark, d):
    q = table(spark, d, "heldout_items").select("item_id", tx.query_tokens(F.col("text")).alias("t"))
    return q.select("item_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def postings(spark, d):
    return _index(spark, d, keep=False).postings


def doc_freq(spark, d):
    return index.index_of(index.tokenized(docs(spark, d))).postings.groupBy("term").agg(F.count("*").alias("df"))


def doc_stats(spark, d):
    return _index(spark, d, keep=False).docs


def vocab_size(spark, d):
    i = _index(spark, d)
    return i.terms.agg(F.count("*").alias("n_terms")).crossJoin(i.stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")))


def _idf(method):
    return lambda spark, d: _index(spark, d, method).terms.select("term", F.round("idf", 6).alias("idf"))


def _topk(rank, method):
    return lambda spark, d: search.search_text(_saved_index(spark, d, method), QUERY, rank, 10).select("rank", "doc_id", "score")


def multi_query_topk(spark, d):
    return search.search_many(_saved_index(spark, d, "bm25"), table(spark, d, "heldout_items"), "item_id", "text", k=5).select("item_id", "rank", "doc_id", "score")


def fold_equality_filter(spark, d):
    a = table(spark, d, "athletes").where(search.same_folded(F.col("country"), "COTE D'IVOIRE"))
    return a.select("ath_id", "country").distinct()


def normalize_key(spark, d):
    return table(spark, d, "athletes").select("ath_id", tx.name_key(F.col("name")).alias("k"), tx.name_key(F.col("name"), True).alias("k1")).distinct()


def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(tx.text_key(F.col("text"))).alias("text_md5"))


def pages(spark, d) -> DataFrame:
    return table(spark, d, "lookups").select("doc_id", "url", "raw_html").where("raw_html IS NOT NULL").dropDuplicates(["doc_id"])


def html_strip_text(spark, d):
    return pages(spark, d).select("doc_id", F.md5(mk.plain(F.col("raw_html"))).alias("text_md5"))


def html_unescaped(spark, d):
    return pages(spark, d).select("doc_id", F.md5(mk.plain_unescaped(F.col("raw_html"))).alias("text_md5"))


def html_junk_removed(spark, d):
    return pages(spark, d).select("doc_id", F.md5(mk.without_junk(F.col("raw_html"))).alias("html_md5"))


def html_blocks(spark, d):
    b = pages(spark, d).select("doc_id", mk.text_blocks(mk.without_junk(F.col("raw_html")), 30).alias("b"))
    return b.select("doc_id", F.size("b").alias("n"), F.md5(F.array_join("b", "\n\n")).alias("text_md5"))


def html_paragraph_fallback(spark, d):
    return pages(spark, d).select("doc_id", F.md5(mk.paragraphs(mk.without_junk(F.col("raw_html")))).alias("text_md5"))


def html_fallback_cascade(spark, d):
    return entity.extract_articles(pages(spark, d)).select("doc_id", "url", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), F.md5("text_norm").alias("norm_md5"))


def _entity_pages(spark, d) -> DataFrame:
    """Entity pages as a site would show them, made of the athletes."""
    a = table(spark, d, "athletes").dropDuplicates(["ath_id"])
    shown = [F.concat(F.lit(f'<div class="x" data-cy="{m}"> <span class="t">'), F.regexp_replace(F.col(c), "[<>]", " "), F.lit("</span></div>")) for c, m in (("country", "nocs"), ("sport", "disciplines"))]
    spans = [F.concat(F.lit(f"<p><span data-cy='{m}'><b>"), F.col(c), F.lit("</b></span></p>")) for c, m in (("participations", "games-participations"), ("first_games", "first-olympic-game"), ("yob", "year-of-birth"))]
    medals = [F.when(F.col(c.lower()).isNotNull(), F.concat(F.lit(f'<div data-cy="medal-module" title="{c}"><span data-cy="ocs-text-module" class="n">'), F.col(c.lower()).cast("string"), F.lit("</span></div>"))) for c in mk.MEDALS]
    head = F.concat(F.lit('<div data-cy="display-name"><h1 class="big">'), F.col("name"), F.lit("</h1></div>"))
    return a.select("ath_id", "url", F.concat_ws("\n", head, *shown, *spans, *medals).alias("raw_html"))


def entity_extract(spark, d):
    e = entity.extract_entities(_entity_pages(spark, d))
    return e.select("athlete_url", "name", "country", "sport", "participations", "first_games", "yob")


def medal_array_sum(spark, d):
    return entity.extract_entities(_entity_pages(spark, d)).select("athlete_url", "gold", "silver", "bronze")


def link_explode(spark, d):
    return pages(spark, d).select("doc_id", F.explode(mk.links(F.col("raw_html"))).alias("link"))


def url_normalize(spark, d):
    return table(spark, d, "metadata").select("log_id", ur.normalize(F.col("url")).alias("url")).distinct()


def url_filter_tier(spark, d):
    u = table(spark, d, "metadata").select(ur.normalize(F.col("url")).alias("url")).distinct()
    return u.select("url", RULES.accepts(F.col("url")).alias("accepted"), RULES.tier(F.col("url")).alias("tier"))


def doc_id_hash(spark, d):
    return table(spark, d, "lookups").select("doc_id", ur.doc_id(F.col("url")).alias("hash")).distinct()


def url_filename(spark, d):
    return table(spark, d, "metadata").select("url", ur.filename(F.col("url")).alias("filename"), ur.file_suffix(F.concat(F.lit("/x/"), F.coalesce("file", F.lit("")))).alias("suffix")).distinct()


def _frontier(spark, d) -> frontier.Frontier:
    """One step: what the log links to, by the crawl's rules, without pages that are there."""
    seen = table(spark, d, "lookups").select("url").distinct()
    links = table(spark, d, "metadata").select(F.col("url").alias("link"), F.struct(F.col("log_id").alias("a"), F.lit(0).alias("b")).alias("seq"))
    empty = spark.createDataFrame([], frontier.STATE)
    return frontier.add(frontier.Frontier(empty, seen), links, RULES)


def frontier_step(spark, d):
    return _frontier(spark, d).pending.select("url", "tier", "seq")


def frontier_take(spark, d):
    """The next 100 pages of the frontier."""
    return frontier.take(_frontier(spark, d), 100)[0].select("url", "tier", "seq")


def frontier_reload(spark, d):
    """The frontier saved after a step of 100 pages, and loaded."""
    path = own_path(spark, "frontier")
    frontier.save(frontier.take(_frontier(spark, d), 100)[1], path)
    return frontier.load(spark, path).pending.select("url", "tier", "seq")


def substring_join(spark, d):
    a = table(spark, d, "athletes").select(tx.name_key(F.col("name"), True).alias("name_norm")).distinct()
    t = table(spark, d, "lookups").where("text IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "url", tx.text_key(F.col("text")).alias("text_norm"))
    return entity.substring_join(t, a.where("length(name_norm) > 0"), "text_norm", "name_norm").select("doc_id", "url", "name_norm")


def substring_collect(spark, d):
    hits = substring_join(spark, d).withColumn("text", F.col("doc_id"))
    return entity.collect_articles(hits, "name_norm").select("name_norm", F.size("lookup_urls").alias("n"), F.array_join("lookup_urls", " ").alias("urls"), F.array_join("lookup_texts", " ").alias("ids"))


def entity_left_join(spark, d):
    m = entity.live(readers.clean_metadata(table(spark, d, "metadata"))).select("log_id", "doc_id", "url").distinct()
    files = table(spark, d, "lookups").select("doc_id", F.length("raw_html").cast("string").alias("size")).dropDuplicates(["doc_id"])
    return m.join(files, "doc_id", "left").select("log_id", "doc_id", "size")


def entity_merge(spark, d):
    a = table(spark, d, "athletes").dropDuplicates(["ath_id"]).withColumn("name_norm", tx.name_key(F.col("name")))
    w = table(spark, d, "wiki_df").dropDuplicates(["wiki_id"]).withColumn("name_norm", tx.name_key(mk.title_name(F.col("name"))))
    return entity.merge(a.select("ath_id", "name_norm"), w).select("ath_id", "name_norm", "wiki_sport", "wiki_height")


def url_lookup_join(spark, d):
    ids = table(spark, d, "lookups").select("doc_id").distinct()
    got = ids.join(quality.url_map(table(spark, d, "metadata")), "doc_id", "left")
    return got.select("doc_id", F.coalesce("url", F.lit("")).alias("url"))


def missing_semi(spark, d):
    m = readers.article_ids(table(spark, d, "metadata")).distinct()
    return m.join(table(spark, d, "lookups").select("doc_id"), "doc_id", "left_semi")


def missing_anti(spark, d):
    m = readers.article_ids(table(spark, d, "metadata")).distinct()
    return m.join(table(spark, d, "lookups").select("doc_id"), "doc_id", "left_anti")


def completeness_dedup(spark, d):
    e = table(spark, d, "final_entities").select("name_norm", "entity_id", "wiki_id", *entity.WIKI_COLUMNS).distinct()
    best = entity.best_per_key(e, "name_norm", entity.WIKI_COLUMNS, [F.length(F.coalesce("wiki_bio", F.lit(""))), -F.col("entity_id")])
    return best.select("name_norm", "entity_id", entity.completeness(entity.WIKI_COLUMNS).alias("score"))


def status_histogram(spark, d):
    return quality.status_histogram(table(spark, d, "metadata"))


def skip_reasons(spark, d):
    m = table(spark, d, "metadata")
    return quality.skip_reasons(m, _known_files(spark, d))


def _known_files(spark, d) -> DataFrame:
    """Files of the pages that are there."""
    there = table(spark, d, "lookups").select("doc_id").distinct()
    return table(spark, d, "metadata").join(there, "doc_id", "left_semi").select("file")


def skipped_rows(spark, d):
    return quality.skipped_rows(table(spark, d, "metadata"), _known_files(spark, d)).groupBy("reason", "url", "path").agg(F.count("*").alias("n"))


def page_split(spark, d):
    e, a = entity.split_pages(readers.clean_metadata(table(spark, d, "metadata")))
    return e.select("log_id", F.lit("entity").alias("kind")).unionByName(a.select("log_id", F.lit("article").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"), F.min("log_id").alias("first"))


def page_routes(spark, d):
    u = table(spark, d, "metadata").select("url").distinct()
    return u.select("url", ur.route(RULES.tier(F.col("url")), F.col("url"), "https://arena-results.example/en/athletes").alias("folder"))


def path_norm(spark, d):
    return table(spark, d, "metadata").select("log_id", tx.path_norm(F.col("file")).alias("path")).distinct()


def global_count(spark, d):
    return table(spark, d, "final_entities").agg(F.count("*").alias("n"), F.count_distinct("name_norm").alias("n_names"), F.count_if(F.col("wiki_bio").isNull()).alias("no_bio"))


def article_left_join(spark, d):
    """Articles of the log with the text of their files, found by file."""
    _, a = entity.split_pages(entity.live(readers.clean_metadata(table(spark, d, "metadata"))))
    pages_ = table(spark, d, "lookups").where("raw_html IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "raw_html")
    files = readers.clean_metadata(table(spark, d, "metadata")).where("file <> ''").join(pages_, "doc_id").select("file", "raw_html").dropDuplicates(["file"])
    return entity.extract_articles(a.select("doc_id", "url", "file").distinct().join(files, "file", "left")).select("doc_id", "url", F.md5("text").alias("text_md5"))


def entity_articles(spark, d):
    """Entities with their collected articles; those without any have none."""
    a = table(spark, d, "athletes").dropDuplicates(["ath_id"]).select("ath_id", tx.name_key(F.col("name"), True).alias("name_norm"))
    none = spark.createDataFrame([], "name_norm string")
    return entity.merge(a, none, entity.collect_articles(substring_join(spark, d).withColumn("text", F.col("doc_id")), "name_norm")).select("ath_id", "name_norm", F.array_join("lookup_urls", " ").alias("urls"))


def entity_extract_strict(spark, d):
    """The older readings of the same pages; medals stand in a span after their module."""
    medals = [F.when(F.col(c.lower()).isNotNull(), F.concat(F.lit(f'<div data-cy="medal-module" title="{c}"></div> <span data-cy="medal-main"><b>'), F.col(c.lower()).cast("string"), F.lit("</b></span>"))) for c in mk.MEDALS]
    p = _entity_pages(spark, d).join(table(spark, d, "athletes").dropDuplicates(["ath_id"]).select("ath_id", F.concat_ws("\n", *medals).alias("medal_html")), "ath_id")
    wanted = {k: mk.attribute_strict(F.col("raw_html"), m) for k, m in mk.ATTRIBUTES.items()}
    return p.select("ath_id", *[v.alias(k) for k, v in wanted.items()], *[v.alias(k) for k, v in mk.medal_counts_strict(F.col("medal_html")).items()])


def html_main(spark, d):
    """Pages whose article element is a main element: the second of the fallbacks."""
    p = pages(spark, d).withColumn("raw_html", F.regexp_replace("raw_html", "<(/?)article", "<$1main"))
    return entity.extract_articles(p).select("doc_id", F.md5("text").alias("text_md5"))


def html_paragraph_strict(spark, d):
    return pages(spark, d).select("doc_id", F.md5(mk.paragraphs_strict(mk.without_junk(F.col("raw_html"), True))).alias("text_md5"))


# Sources and sinks: written to the shared folder and read again

def log_round_trip(spark, d):
    path = own_path(spark, "log")
    readers.init_log(spark, path)
    readers.append_log(table(spark, d, "metadata").where("NOT coalesce(url, '') LIKE '%\\\\%'"), path)
    return readers.read_metadata(spark, path).groupBy(*[F.coalesce(c, F.lit("")).alias(c) for c in ("doc_id", "status", "file", "date", "url")]).agg(F.count("*").alias("n"))


def athletes_round_trip(spark, d):
    path = own_path(spark, "athletes")
    columns = [c.split(" ")[0] for c in readers.ATHLETES.split(", ")]
    readers.write_athletes(table(spark, d, "athletes").select(*[F.col(c).cast("string").alias(c) for c in columns]), path)
    return readers.read_athletes(spark, path).select("file", "country", "sport", "gold", "silver", "bronze", "url").groupBy("file", "country", "sport", "gold", "silver", "bronze", "url").agg(F.count("*").alias("n"))


def articles_round_trip(spark, d):
    path = own_path(spark, "articles")
    readers.write_articles(entity.extract_articles(pages(spark, d)), path)
    return readers.read_saved_articles(spark, path).select("doc_id", F.md5("text").alias("text_md5"))


def entities_round_trip(spark, d):
    path = own_path(spark, "entities")
    readers.write_entities(table(spark, d, "final_entities"), path)
    return spark.read.parquet(path).select("entity_id", "name_norm", F.size("lookup_urls").alias("n_urls"))


def athlete_json(spark, d):
    path = own_path(spark, "json")
    readers.entity_json(table(spark, d, "athletes"), path)
    return spark.read.schema("name string, country string, sport string, gold int, silver int, bronze int, url string").json(path).groupBy("country", "sport").agg(F.count("*").alias("n"), F.sum("gold").alias("gold"), F.count_distinct("url").alias("n_urls"))


def index_json(spark, d):
    """The exported index, its parts counted by term."""
    path = own_path(spark, "index_json")
    index.export_json(_saved_index(spark, d, "bm25")).write.text(path)
    j = spark.read.schema("term string, part int, df long, idf double, postings map<string,long>").json(path)
    return j.groupBy("term").agg(F.max("df").alias("df"), F.round(F.max("idf"), 6).alias("idf"), F.sum(F.size("postings")).alias("n"), F.sum(F.aggregate(F.map_values("postings"), F.lit(0).cast("long"), lambda a, b: a + b)).alias("tf"))


def dispatch_text(spark, d):
    return search.search(_saved_index(spark, d, "bm25"), table(spark, d, "athletes"), f"  {QUERY} ", "ath_id").select("rank", "doc_id", "score")


def dispatch_attributes(spark, d):
    a = table(spark, d, "athletes").dropDuplicates(["ath_id"])
    return search.search(_saved_index(spark, d, "bm25"), a, "ath: " + ATTRIBUTE_QUERIES["attr_search_mixed"], "ath_id", k=20).select("ath_id", "name", "score")


def malformed_count(spark, d):
    return quality.malformed_count(table(spark, d, "athletes"), ("country", "sport", "yob", "first_games"))


def article_ids(spark, d):
    return readers.article_ids(table(spark, d, "metadata"))


def _attributes(q):
    def run(spark, d):
        a = table(spark, d, "athletes").dropDuplicates(["ath_id"])
        return search.search_entities(a, q, "ath_id", 20).select("ath_id", "name", "score")

    return run


def range_filters(spark, d):
    a = table(spark, d, "athletes").select("ath_id", "gold", "yob").distinct().select("ath_id", F.coalesce("gold", F.lit(0)).alias("i_gold"), F.coalesce(F.col("yob").try_cast("int"), F.lit(0)).alias("i_yob"))
    cases = [("gold", op, 1) for op in (">", ">=", "<", "<=", "=", "==")] + [("yob", "<", 1990), ("yob", ">=", 1990)]
    return a.agg(*[F.count_if(search.range_filter([to_range(*c)])).alias(f"c{i}") for i, c in enumerate(cases)])


def _fields(q, k=100):
    return lambda spark, d: search.search_fields(_saved_fields(spark, d), q, "entity_id", k).select("doc_id", "score")


def stored_fields(spark, d):
    hits = search.search_fields(_saved_fields(spark, d), FIELD_QUERIES["stored_fields"], "entity_id", 20)
    return search.stored_fields(hits, ("name", "country", "sport", "gold", "wiki_sport")).select("doc_id", "fields")


def result_projection(spark, d):
    e = table(spark, d, "final_entities").dropDuplicates(["entity_id"]).withColumnRenamed("entity_id", "doc_id")
    return search.result_view(e).select("doc_id", "name", "country", "sport", "gold", "bio", "links")


def console_projection(spark, d):
    return search.console_view(table(spark, d, "final_entities").dropDuplicates(["entity_id"]).withColumnRenamed("entity_id", "doc_id"))


def _dump(spark, d) -> DataFrame:
    w = table(spark, d, "wiki_df").dropDuplicates(["wiki_id"])
    lines = [F.concat(F.lit(f"\n| {k} = "), F.regexp_replace(F.coalesce(c, F.lit("")), r"\n", " ")) for k, c in (("sport", "wiki_sport"), ("birth_place", "wiki_birth_place"), ("curling_club", "wiki_club"), ("height", "wiki_height"))]
    return w.select("wiki_id", F.col("name").alias("title"), F.concat(F.lit("{{Infobox person"), *lines, F.lit("\n}}\n"), F.coalesce("wiki_bio", F.lit(""))).alias("text"))


def infobox_extract(spark, d):
    return entity.extract_wiki(_dump(spark, d)).select("name", *[c for c in entity.WIKI_COLUMNS if c != "wiki_bio"])


def bio_extract(spark, d):
    return entity.extract_wiki(_dump(spark, d)).select("name", "wiki_bio")


def p6_found(spark, d):
    return units.series_heights(table(spark, d, "wiki_df"), "wiki_id").select("wiki_id", "height_cm").distinct()


def p6_series(spark, d):
    """Readings of all pages by sport, each in the order of its pages: a long series a device, some with most readings."""
    w = table(spark, d, "wiki_df").select("wiki_id", F.coalesce("wiki_sport", F.lit("")).alias("device"), "wiki_height").distinct()
    r = units.readings(w, "wiki_height").withColumn("at", F.col("wiki_id") * 16 + F.col("pos"))
    return units.decode_series(r, "device", "at", "value", "hint", entry="wiki_id").select("device", "at", "unit", F.round("canonical", 2).alias("canonical"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs, query_tokens, postings, doc_freq, doc_stats, vocab_size, multi_query_topk, fold_equality_filter, normalize_key, normalize_text, html_strip_text, html_unescaped, html_junk_removed, html_blocks,
        html_paragraph_fallback, html_fallback_cascade, entity_extract, medal_array_sum, link_explode, url_normalize, url_filter_tier, doc_id_hash, url_filename, frontier_step, substring_join, substring_collect,
        entity_left_join, entity_merge, url_lookup_join, missing_semi, missing_anti, completeness_dedup, status_histogram, skip_reasons, malformed_count, article_ids, range_filters, stored_fields, result_projection,
        console_projection, infobox_extract, bio_extract, p6_found, p6_series, index_build, field_index_build, frontier_take, frontier_reload, skipped_rows, page_split, page_routes, path_norm, global_count,
        article_left_join, entity_articles, entity_extract_strict, html_main, html_paragraph_strict, log_round_trip, athletes_round_trip, articles_round_trip, entities_round_trip, athlete_json, index_json,
        dispatch_text, dispatch_attributes,
    )
} | {
    "idf_classic": _idf(""), "idf_bm25": _idf("bm25"), "tfidf_topk": _topk("tfidf", ""), "tfidf_bm25idf_topk": _topk("tfidf", "bm25"), "bm25_topk": _topk("bm25", "bm25"), "bm25_classicidf_topk": _topk("bm25", ""),
} | {k: _attributes(q) for k, q in ATTRIBUTE_QUERIES.items()} | {k: _fields(q) for k, q in FIELD_QUERIES.items() if k != "stored_fields"}
