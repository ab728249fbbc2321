import unicodedata

from pyspark.sql import functions as F

from quillspark.functions import markup as mk
from quillspark.functions import text as tx
from quillspark.functions import urls as ur


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_tokens_and_keys(spark):
    rows = ["The 3 Äpfel of Straße, x2 a 2024!", "", None, "ŞİŞLİ ﬁnal Ｗｉｄｅ café ́ ẍy", "word " * 20000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, x string")
    got = {r["i"]: r for r in df.select("i", tx.index_tokens(F.col("x")).alias("t"), tx.query_tokens(F.col("x")).alias("q"), tx.fold(F.col("x")).alias("f")).collect()}
    assert got[0]["t"] == ["apfel", "strasse", "x2"] and got[0]["q"][:3] == ["the", "3", "apfel"]
    assert got[1]["t"] == [] and got[2]["t"] is None and len(got[4]["t"]) == 20000
    assert got[3]["f"] == tx.fold_text(rows[3])
    keys = [("John J. Smith", "john j  smith", "john j smith"), ("Zdeněk O'Hara", "zdenek o hara", "zdenek o hara"), ("Ana (swimmer)", "ana", "ana"), ("Ćosić Ivan", "osi  ivan", "osi ivan")]
    k = spark.createDataFrame([(a,) for a, _, _ in keys], "x string").select(tx.name_key(F.col("x")), tx.text_key(F.col("x"))).collect()
    assert [tuple(r) for r in k] == [(b, c) for _, b, c in keys]


def test_fold_equals_python(spark):
    letters = [chr(c) for c in range(0x20, 0x250) if unicodedata.category(chr(c)) != "Cn"]
    df = spark.createDataFrame([(c,) for c in letters], "x string").select("x", tx.fold(F.col("x")).alias("f"), tx.fold_exact(F.col("x")).alias("e"))
    for r in df.collect():
        assert r["f"] == tx.fold_text(r["x"]) == r["e"], hex(ord(r["x"]))


def test_urls(spark):
    rules = ur.CrawlRules("games.example")
    cases = [
        ("HTTPS://WWW.Games.example:443/en/athletes/foo?x=1#y", "https://games.example/en/athletes/foo", True, 0), ("https://games.example/en/sports/judo", "https://games.example/en/sports/judo", False, 1),
        ("https://games.example/en/sports/judo/news", "https://games.example/en/sports/judo/news", True, 1), ("https://games.example/en/news/live/x", "https://games.example/en/news/live/x", False, 1),
        ("/en/athletes/foo", "/en/athletes/foo", False, 1), ("https://games.example/en", "https://games.example/en", False, 1), ("https://games.example", "https://games.example/", False, 1), ("https://other.example/en/news/a", "https://other.example/en/news/a", False, 1),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "x string").withColumn("n", ur.normalize(F.col("x")))
    got = [tuple(r) for r in df.select("x", "n", rules.accepts(F.col("n")), rules.tier(F.col("n"))).collect()]
    assert got == cases
    assert one(spark, "https://a.example/x", ur.doc_id) == "16073527254490693265"
    assert one(spark, "https://games.example/en/athletes/foo/", ur.filename) == "athletes_foo.html"
    assert one(spark, "https://games.example/", ur.filename) == "ex.html"
    assert one(spark, None, rules.accepts) is False


def test_html(spark):
    assert one(spark, '<span data-cy="nocs"><b>Slovakia</b></span>', lambda c: mk.attribute(c, "nocs")) == "Slovakia"
    assert one(spark, "<p>no key</p>", lambda c: mk.attribute(c, "nocs")) is None
    assert one(spark, "<p>no key</p>", lambda c: mk.attribute_strict(c, "nocs")) == ""
    m = "".join(f'<div data-cy="medal-module" title="{t}"><span data-cy="ocs-text-module">{n}</span></div>' for t, n in (("Gold", 2), ("Gold", 1), ("Bronze", 4)))
    df = spark.createDataFrame([(m,), ('<div data-cy="medal-module" title="Gold"></div>',), ("",)], "x string").select(*mk.medal_counts(F.col("x")).values())
    assert [tuple(r) for r in df.collect()] == [(3, 0, 4), (None, 0, 0), (0, 0, 0)]
    strict = '<div data-cy="medal-module" title="gold"><span data-cy="medal-main"><i>x</i><b>5</b></span></div>'
    assert one(spark, strict, lambda c: mk.medal_counts_strict(c)["gold"]) == 5
    block = f'<div data-cy="second-block">{"a" * 29}</div><section class="q" data-cy="text-block-container"><b>{"b" * 30}</b></section>'
    assert one(spark, block, mk.text_blocks) == ["b" * 30]
    page = f"<main>short</main><script>if (a) '</p>'</script><p>{'x' * 20}</p><p>{'y' * 20}</p>"
    clean = lambda c: mk.without_junk(c)
    assert one(spark, page, lambda c: mk.article_text(mk.text_blocks(clean(c)), mk.main_text(clean(c)), mk.paragraphs(clean(c)))) == "x" * 20 + "\n" + "y" * 20
    assert one(spark, """<A class=1 HREF = '/a'><a href="/b">""", mk.links) == ["/a", "/b"]
    assert one(spark, "a&nbsp;<b>b</b>&amp;lt; c", mk.plain_unescaped) == "a b &lt; c"


def test_wiki(spark):
    get = lambda text, names: one(spark, text, lambda c: mk.infobox_value(mk.infobox_head(c), names))
    assert get("{{Infobox\n| club = [[SK Slavia]]\n}}", mk.INFOBOX["wiki_club"]) == "SK Slavia"
    assert get("{{Infobox\n| sport = [[Swimming (sport)|Swimming]]\n}}", mk.INFOBOX["wiki_sport"]) == "[[Swimming (sport)"
    assert get("{{Infobox\n| height = {{height|m=1.8}}\n}}", mk.INFOBOX["wiki_height"]) == ""
    assert one(spark, "Jane Doe (rower)", mk.title_name) == "Jane Doe"
    text = "{{Infobox\n| a = b\n}}\n'''Jane Doe''' is a rower.<ref>x</ref> She won. She lost. She left. More."
    assert one(spark, text, mk.biography) == "Jane Doe is a rower. She won. She lost. She left."
    assert one(spark, "Jane Doe is a rower. She won.", mk.biography) == ""


def test_entities_and_older_paragraphs(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import markup, text

    df = spark.createDataFrame([("<b>a</b>&#233;&#x41;&nbsp;&copy;&frac12; &bogus; &lt;i&gt;",), ("plain",), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(markup.plain_unescaped(F.col("h"))).collect()] == ["a éA ©½ &bogus; <i>", "plain", None, ""]
    p = spark.createDataFrame([("<p>one</p><p> two <b>x</b></p>",)], "h string")
    assert p.select(markup.paragraphs(F.col("h")), markup.paragraphs_strict(F.col("h"))).first() == ("one\ntwo x", "one two x")
    k = spark.createDataFrame([("A\\b (c) d",), ("x\\s y",)], "n string")
    assert [r[0] for r in k.select(text.name_key(F.col("n"))).collect()] == ["a\\b d", "x  y"]
    assert text.standard_words("Of 1.80 m, l'équipe é!") == ["of", "1.80", "m", "l'équipe", "é"]
