import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions.urls import CrawlRules
from quillspark.operators import entity, frontier, index, quality, search
from quillspark.plans.query_lang import parse_attributes, parse_filters, text_tokens, to_range
from quillspark.sources import readers
from quillspark.streaming import frontier_stream

DOCS = [("a", "Judo final in Trondheim, judo again"), ("b", "The judo team"), ("c", "Rowing final rowing"), ("d", "12 34 the"), ("e", None), ("a", "Judo final in Trondheim, judo again"), (None, "judo")]


def plain_bm25(docs, query, k1=1.2, b=0.75):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    out = {}
    for d, ts in docs.items():
        s, hit = 0.0, False
        for q in query:
            df = sum(q in x for x in docs.values())
            if q in ts:
                hit = True
                idf = max(math.log((n - df + 0.5) / (df + 0.5)), 0.01)
                s += idf * ts.count(q) * (k1 + 1) / (ts.count(q) + k1 * (1 - b + b * len(ts) / avg))
        if hit:
            out[d] = round(s, 6)
    return out


def test_index_and_search(spark):
    df = spark.createDataFrame(DOCS, "doc_id string, text string")
    i = index.build_index(df, method="bm25")
    toks = {r["doc_id"]: r["tokens"] for r in index.tokenized(df).collect()}
    assert set(toks) == {"a", "b", "c"}
    assert {r["doc_id"]: r["score"] for r in search.search_text(i, "judo final judo nowhere").collect()} == plain_bm25(toks, ["judo", "final", "judo"])
    assert sum(r["tf"] for r in i.postings.collect()) == sum(map(len, toks.values()))
    assert search.search_text(i, "nowhere").count() == 0 and search.search_text(i, "").count() == 0
    urls = spark.createDataFrame([("a", "u")], "doc_id string, url string")
    assert {r["doc_id"]: r["url"] for r in search.search_text(i, "judo", urls=urls).collect()} == {"a": "u", "b": ""}
    many = search.search_many(i, spark.createDataFrame([(1, "judo"), (2, "rowing"), (3, None)], "q int, t string"), "q", "t").collect()
    assert {(r["q"], r["doc_id"]) for r in many} == {(1, "a"), (1, "b"), (2, "c")}
    empty = index.build_index(spark.createDataFrame([], "doc_id string, text string"))
    assert empty.postings.count() == 0 and empty.stats.first()["avgdl"] is None
    assert sum(r["json"].count(":1") + r["json"].count(":2") for r in index.export_json(i).collect()) >= i.postings.count()


def test_idf(spark):
    df = spark.createDataFrame([(1, 4), (2, 4), (4, 4), (0, 4)], "df int, n int")
    got = df.select(F.round(index.idf(F.col("df"), F.col("n")), 6), F.round(index.idf(F.col("df"), F.col("n"), "bm25"), 6)).collect()
    assert [tuple(r) for r in got] == [(1.386294, 0.847298), (0.693147, 0.01), (0.0, 0.01), (0.0, 0.0)]


def test_saved_index(spark, tmp_path):
    i = index.build_index(spark.createDataFrame(DOCS, "doc_id string, text string"))
    index.save_index(i, str(tmp_path))
    back = index.load_index(spark, str(tmp_path))
    assert search.search_text(back, "judo", "tfidf").collect() == search.search_text(i, "judo", "tfidf").collect()


ATHLETES = [(1, "Ann Phelps", "United States", "Swimming", 6, 1, None, "1985"), (2, "Bo Lee", "UNITED STATES", "Judo", 7, 0, 0, None), (3, "José Ñu", "Spain", "Judo", 0, 0, 0, "x"), (4, None, None, None, None, None, None, "")]
SCHEMA = "ath_id int, name string, country string, sport string, gold int, silver int, bronze int, yob string"


def test_attribute_search(spark):
    q = parse_attributes('gold>5 country:"United States" phelps')
    assert (q.country, q.name, q.medals) == ("United States", "phelps", [("gold", ">", 5)])
    assert parse_attributes("gold > 5").name == "gold > 5" and parse_attributes("sport:judo name:x y").name == "x"
    with pytest.raises(ValueError):
        parse_attributes('"open')
    df = spark.createDataFrame(ATHLETES, SCHEMA)
    run = lambda s: [(r["ath_id"], r["score"]) for r in search.search_entities(df, s, "ath_id").collect()]
    assert run('gold>5 country:"united states" phelps') == [(1, 3.25), (2, 1.25)]
    assert run("jose") == [(3, 2.0)] and run("") == [] and run("silver=0 bronze=0") == [(2, 0.5), (3, 0.5), (4, 0.5)]


def test_filter_language():
    f = parse_filters("swimmer gold>=2")
    assert f.text.strip() == "swimmer" and (f.ranges[0].low, f.ranges[0].high) == (2, 10000)
    f = parse_filters('"Tokyo 2020" born<1990')
    assert (f.ranges[0].column, f.ranges[0].low, f.ranges[0].high) == ("yob", 0, 1989)
    assert parse_filters("born 1990").ranges[0].low == 1990 and parse_filters("").text is None
    assert to_range("a", "<=", 3).low == 0
    assert [(t.text, t.phrase) for t in text_tokens('"A b" c "')] == [("A b", True), ("c", False), ("", True)]


def test_field_search(spark):
    rows = [(1, "Ann Lee", "Norway", "Rowing", "Oslo 1990", 2, 0, 0, "1970", "2", "rower of rowing", ["rowing news"], ["u1"]), (2, "Bo Rowing", "Norway", "Judo", "Oslo 1990", 0, 0, 0, None, "1", None, [], []), (3, None, None, None, None, None, None, None, "n", None, None, None, None)]
    cols = "entity_id int, name string, country string, sport string, first_games string, gold int, silver int, bronze int, yob string, participations string, wiki_bio string, lookup_texts array<string>, lookup_urls array<string>"
    blank = [c for c in ("wiki_sport", "wiki_birth_place", "wiki_position", "wiki_club")]
    df = spark.createDataFrame(rows, cols).withColumns({c: F.lit(None).cast("string") for c in blank})
    ids = lambda q, **k: [r["doc_id"] for r in search.search_fields(df, q, "entity_id", **k).collect()]
    assert set(ids("rowing")) == {1, 2} and ids("") == [] and ids("   ") == []
    assert ids('"Rowing"') == [1]  # exact on a keyword column
    assert ids('"Oslo 1990"') == []  # exact, but no word in a searched field
    assert ids('"Oslo 1990" norway') == [1, 2]
    assert set(ids("yob<1990")) == {1, 2, 3}  # an unknown year is 0
    assert ids("rowing gold>=1") == [1] and set(ids("nothing gold>=0")) == {1, 2, 3}
    assert search.search_fields(df, "born 1970", "entity_id").first()["score"] == 1.0
    assert ids("rowing", quantize_norms=True)


def test_entities(spark):
    texts = spark.createDataFrame([(1, "ann lee won"), (2, "joann leeds lost"), (3, None)], "d int, t string")
    names = spark.createDataFrame([("ann lee",), ("",), (None,), ("bo",)], "n string")
    got = {(r["d"], r["n"]) for r in entity.substring_join(texts, names, "t", "n").collect()}
    assert got == {(1, "ann lee"), (2, "ann lee"), (1, ""), (2, "")}
    entity.LOOP_NAMES, bound = 0, entity.LOOP_NAMES  # the automaton finds the same
    again = entity.substring_join(texts, names.unionByName(names), "t", "n").collect()
    entity.LOOP_NAMES = bound
    assert {(r["d"], r["n"]) for r in again} == got and len(again) == 2 * len(got)
    long = spark.createDataFrame([("ann b lee",), ("n b le",), ("bo",)], "n string")
    t2 = spark.createDataFrame([(1, "joann b leeds"), (2, "ann c lee"), (3, "ann bb lee")], "d int, t string")
    by_tokens = {(r["d"], r["n"]) for r in entity.substring_join_tokens(t2, long, "t", "n", "n").collect()}
    assert by_tokens == {(r["d"], r["n"]) for r in entity.substring_join(t2, long, "t", "n").collect()}
    rows = [("k", "x", None, 1), ("k", "x", "y", 2), (None, None, None, 3), (None, "z", None, 4), ("k", "x", "y", 5)]
    best = entity.best_per_key(spark.createDataFrame(rows, "name_norm string, a string, b string, id int"), "name_norm", ["a", "b"], [-F.col("id")]).collect()
    assert {(r["name_norm"], r["id"]) for r in best} == {("k", 2), (None, 4)}
    assert entity.best_per_key(spark.createDataFrame([], "k string, a string"), "k", ["a"], []).count() == 0


def test_whole_build(spark, tmp_path):
    html = '<div data-cy="display-name"><h1>Jane Doe</h1></div><span data-cy="nocs">Norway</span>'
    (tmp_path / "html/athletes").mkdir(parents=True)
    (tmp_path / "html/athletes/jane.html").write_text(html)
    (tmp_path / "html/n.html").write_bytes(b"<p>On Monday Jane Doe won the \xff final again</p>")
    (tmp_path / "meta.csv").write_text("doc_id,status,file,date,url\n-1,200,html/athletes/jane.html,d,ua\n7,200,html/n.html,d,un\n8,404,,d,ux\n-1,200,html/gone.html,d,ug\n")
    (tmp_path / "wiki.xml").write_text("<mediawiki><page><title>Jane Doe (rower)</title><revision><text bytes='9'>{{Infobox\n| sport = Rowing\n| birth_place = Oslo\n}}\nJane Doe is a rower. A. B. C. D.</text></revision></page><page><title>List: x</title><revision><text>y</text></revision></page></mediawiki>")
    meta = readers.read_metadata(spark, str(tmp_path / "meta.csv"))
    files = readers.read_pages(spark, str(tmp_path / "html"))
    got = entity.build_entities(meta, files, readers.read_wiki(spark, str(tmp_path / "wiki.xml"))).collect()
    jane = next(r for r in got if r["name_norm"] == "jane doe")
    assert (jane["country"], jane["wiki_sport"], jane["lookup_urls"], jane["athlete_url"]) == ("Norway", "Rowing", ["un"], "ua")
    assert any(r["name"] is None and r["athlete_url"] == "ug" for r in got)
    assert {r["reason"]: r["n"] for r in quality.skip_reasons(meta, files).collect()} == {"status": 1, "missing file": 1}
    readers.write_athletes(spark.createDataFrame([("f", " n ", "1")], "file string, name string, gold string"), str(tmp_path / "out"))
    readers.append_log(meta.select("doc_id", "status", "file", "date", "url"), str(tmp_path / "log"))
    assert readers.read_metadata(spark, str(tmp_path / "log")).count() == 4


RULES = CrawlRules("games.example")


def test_frontier(spark, tmp_path):
    root = "https://games.example/en/athletes"
    state = frontier.seed(spark, root)
    html = "".join(f'<a href="{u}">' for u in ("https://games.example/en/news/b", "https://www.games.example/en/athletes/x?q=1", "https://games.example/en/news/a", "https://games.example/en/news/b#f", "/en/news/rel", root))
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    state = frontier.add(state, frontier.extract_links(pages), RULES, source_cap=2)
    assert [(r["url"], r["tier"]) for r in state.pending.orderBy("tier", "seq").collect()] == [("https://games.example/en/athletes/x", 0), (root, 1), ("https://games.example/en/news/b", 1)]
    again = frontier.add(state, frontier.extract_links(pages), RULES, source_cap=2)
    assert again.pending.count() == state.pending.count()  # seen links change nothing, dropped ones stay out at the cap
    batch, rest = frontier.take(again, 1)
    assert batch.first()["tier"] == 0 and rest.pending.count() == 2
    frontier.save(rest, str(tmp_path / "s"))
    assert frontier.load(spark, str(tmp_path / "s"), root).pending.count() == 2
    assert frontier.load(spark, str(tmp_path / "none"), root).pending.first()["url"] == root
    (tmp_path / "u.json").write_text('{"queue": ["q"], "seen": ["q", "r"]}')
    j = frontier.read_json_state(spark, str(tmp_path / "u.json"))
    assert j.pending.count() == 1 and j.seen.count() == 2


def test_frontier_stream(spark, tmp_path):
    src = str(tmp_path / "pages")
    spark.createDataFrame([(1, '<a href="https://games.example/en/athletes/a">')], "page_id int, html string").write.parquet(src)
    q = frontier_stream.run(spark.readStream.schema("page_id int, html string").parquet(src), str(tmp_path / "f"), "https://games.example/en", RULES, str(tmp_path / "c"))
    q.awaitTermination(120)
    assert frontier.load(spark, str(tmp_path / "f/v0")).pending.count() == 2


def test_plans(spark):
    df = spark.createDataFrame(DOCS, "doc_id string, text string")
    plan = search.search_text(index.build_index(df, keep=False), "judo")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_reports(spark):
    m = spark.createDataFrame([(" 404 ", "a", "1"), ("200", "", "2"), (None, None, None), ("404", "b", "-1")], "status string, file string, doc_id string")
    assert {r["status"]: r["n"] for r in quality.status_histogram(m).collect()} == {"404": 2, "": 1, "TOTAL": 3}
    assert [r["doc_id"] for r in readers.article_ids(m).collect()] == ["1", "2", ""]
    e = spark.createDataFrame([("a", None), (" ", ""), ("b", "c")], "x string, y string")
    assert tuple(quality.malformed_count(e, ["x", "y"]).first()) == (3, 1, 2)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_over_tasks(spark):
    rows = [(i % 3 == 0, (i * 7919) % 500, f"u{i:04d}") for i in range(700)]
    df = spark.createDataFrame(rows, "g boolean, o int, u string").repartition(5)
    got = frontier.numbered(df, "g", ["o", "u"], "k")
    assert "Window" not in _plan(got.select("u").where("g")) or "__p" in _plan(got)  # a window over tasks, none over rows
    for g in (True, False):
        want = [u for _, _, u in sorted(r for r in rows if r[0] == g)]
        assert [r["u"] for r in sorted((r for r in got.collect() if r["g"] == g), key=lambda r: r["k"])] == want
        assert sorted(r["k"] for r in got.collect() if r["g"] == g) == list(range(1, len(want) + 1))
    assert frontier.numbered(df.limit(0), "g", ["o"], "k").count() == 0


def test_budget_counts_good_pages(spark):
    pages = spark.createDataFrame([("200", 1), ("404", 2), ("200", 3), ("ERR", 4), ("200", 5), ("200", 6)], "status string, seq int")
    kept, done = frontier.budget(pages, 1, 3)
    assert sorted(r["seq"] for r in kept.collect()) == [1, 2, 3] and done == 3
    kept, done = frontier.budget(pages.withColumn("status", F.when(F.col("seq") == 2, "403").otherwise(F.col("status"))), 0, 9)
    assert sorted(r["seq"] for r in kept.collect()) == [1, 2] and done == 1
    assert frontier.budget(pages.limit(0), 0, 2)[1] == 0 and frontier.budget(pages, 3, 3)[0].count() == 0


def test_saved_fields(spark, tmp_path):
    cols = "entity_id int, name string, country string, sport string, wiki_bio string, gold int"
    df = spark.createDataFrame([(1, "Ann Lee", "Norway", "Rowing", "rower of 1.80 m, l'équipe", 2), (2, "Bo", None, "Judo", "rower", 0), (2, "Bo", None, "Judo", "rower", 0)], cols)
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("wiki_sport", "wiki_birth_place", "wiki_position", "wiki_club", "lookup_texts")})
    index.save_field_index(index.build_field_index(df, "entity_id"), str(tmp_path))
    back = index.load_field_index(spark, str(tmp_path))
    for q in ("rower", "1.80", "L'ÉQUIPE", "rower gold>1", "nowhere", "", '"Rowing" norway'):
        assert [tuple(r) for r in search.search_fields(back, q, "entity_id").select("doc_id", "score").collect()] == [tuple(r) for r in search.search_fields(df, q, "entity_id").select("doc_id", "score").collect()]
    assert [r["doc_id"] for r in search.search_fields(back, "1.80", "entity_id").collect()] == [1] and [r["doc_id"] for r in search.search_fields(back, "l'équipe", "entity_id").collect()] == [1]
    assert "term" in _plan(search.field_scores(index.FieldIndex(back.postings.where(F.col("term").isin("rower")), back.stats, back.docs), ["rower"])).split("PushedFilters")[1]


def test_copies_of_few_names(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = spark.range(250_000).select(F.concat(F.lit("name "), F.col("id") % 10).alias("n"), F.col("id").alias("other"))
        texts = spark.createDataFrame([(1, "of name 3 and name 4"), (2, None)], "d int, t string")
        got = entity.substring_join(texts, names, "t", "n")
        assert "CartesianProduct" not in _plan(got) and got.count() == 50_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sinks(spark, tmp_path):
    readers.init_log(spark, str(tmp_path / "log"))
    assert readers.read_metadata(spark, str(tmp_path / "log")).count() == 0
    row = [("1", " 200", 'a "b"\\c', "d", 'say "u", v')]
    readers.append_log(spark.createDataFrame(row, readers.METADATA), str(tmp_path / "log"))
    readers.init_log(spark, str(tmp_path / "log"))  # changes nothing
    assert tuple(readers.read_metadata(spark, str(tmp_path / "log")).first())[1:] == (" 200", 'a "b"/c', "d", 'say "u", v')
    readers.write_articles(spark.createDataFrame([("b", "x\ny"), ("a", "z"), ("c", ""), (None, "q")], "doc_id string, text string"), str(tmp_path / "art"))
    assert {tuple(r) for r in readers.read_saved_articles(spark, str(tmp_path / "art")).collect()} == {("a", "z"), ("b", "x\ny")}
    root = "https://games.example/en/athletes"
    pages = spark.createDataFrame([(root + "/x", 0, "h"), (root + "/", 0, "h"), ("https://games.example/en/news", 1, "h")], "url string, tier int, html string")
    readers.write_pages(pages, str(tmp_path / "pages"), root)
    assert {r["url"]: r["folder"] for r in spark.read.parquet(str(tmp_path / "pages")).collect()} == {root + "/x": "athletes", root + "/": "lookup", "https://games.example/en/news": "lookup"}
    m = spark.createDataFrame([("200", "", "u1"), ("404", "x", "u2"), ("200", "y", "u3")], "status string, file string, url string")
    assert {tuple(r) for r in quality.skipped_rows(m, spark.createDataFrame([("y",)], "file string")).collect()} == {("empty path", "u1", ""), ("status", "u2", "x")}
