import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import abuse, boilerplate, confusables, distinctive, leakage, linkage, markup, packing, survivor

LONG = "plain words " * 20_000


# p1

def test_names_and_edits():
    assert linkage.page_names("Ceidrac, Pavel", "") == ["pavel ceidrac"]
    assert linkage.page_names("BLAGNERSEN Eduard", "")[0] == "eduard blagnersen"
    assert "jakob n daurowick" in linkage.page_names("Милош Петако (Jakob N. Daurowick)", "")
    assert linkage.page_names(None, "") == [] and linkage.fold("Тоmáš Łuc ") == "tomas luc"
    assert linkage.near("riagero", "riaegro") == 1 and linkage.near("abc", "abc") == 0 and linkage.near("a", "xyzw") == 3
    rnd = random.Random(2)
    for _ in range(200):  # words within one edit share a variant
        w = "".join(rnd.choice("abcde") for _ in range(rnd.randint(4, 8)))
        i = rnd.randrange(len(w))
        v = rnd.choice([w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "z" + w[i + 1 :], w[: i] + w[i : i + 2][::-1] + w[i + 2 :]])
        if len(v) > 3:
            assert linkage.variants(w) & linkage.variants(v)


def test_label_model():
    rnd, patterns, truth = random.Random(4), {}, {}
    for _ in range(4000):
        y = rnd.random() < 0.4
        v = tuple((1 if (rnd.random() < 0.9) == y else -1) if rnd.random() < 0.8 else 0 for _ in linkage.VOTERS)
        patterns[v] = patterns.get(v, 0) + 1
        truth.setdefault(v, []).append(y)
    m = linkage.LabelModel(patterns)
    right = sum(sum((p > 0.5) == y for y in truth[tuple(v)]) for v, p in zip(m.votes.tolist(), m.post))
    assert right > 0.97 * 4000 and abs(m.prior - 0.4) < 0.05
    assert len(linkage.LabelModel({}).post) == 0


def people(spark, extra=0):
    rnd = random.Random(7)
    first, sport, country = ["Anna", "Boris", "Carla", "Dimitri", "Emma"], [("Rowing", "rower"), ("Judo", "judoka"), ("Archery", "archer")], [("Norway", "Norwegian"), ("Chile", "Chilean"), ("Spain", "Spanish")]
    a, w, true = [], [], set()
    for i in range(240):
        last = "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)).capitalize()
        f, s, c, y = rnd.choice(first), rnd.choice(sport), rnd.choice(country), rnd.randint(1950, 2000)
        a.append((i, f"{f} {last}", c[0], s[0], str(y) if i % 9 else None, f"Town {y + 20}"))
        if i % 2 == 0:
            name = [f"{f} {last}", f"{last}, {f}", f"{f[0]}. {last}", f"{f} {last[:2]}{last[3:]}"][i // 2 % 4]
            w.append((1000 + i, name, s[0], f"Town, {c[0]}", f"{f} {last} (born 3 May {y}) is a {c[1]} {s[1]}."))
            true.add((i, 1000 + i))
        if i % 6 == 0:  # a namesake of another age, sport and country
            o = (country.index(c) + 1) % 3, (sport.index(s) + 1) % 3
            w.append((2000 + i, f"{f} {last}", sport[o[1]][0], f"Town, {country[o[0]][0]}", f"{f} {last} (born {y - 17}) is a {country[o[0]][1]} {sport[o[1]][1]}."))
    a += [a[0], a[1], (900, None, None, None, "unknown", None), (901, "", "", "", "", "")]
    w += [w[0], (3000, None, None, None, None), (3001, "", "", "", LONG)]
    A = spark.createDataFrame(a, "ath_id long, name string, country string, sport string, yob string, first_games string").withColumn("wiki_id", F.lit("clash"))
    W = spark.createDataFrame(w, "wiki_id long, name string, wiki_sport string, wiki_birth_place string, wiki_bio string").withColumn("confidence", F.lit(1))
    return A, W, true


def test_linkage(spark):
    a, w, true = people(spark)
    rows = linkage.link(a.repartition(3), w).collect()
    got = {(r["ath_id"], r["wiki_id"]) for r in rows}
    assert len(rows) == len(got) and len(got & true) >= 0.95 * len(true) and len(got - true) <= 0.03 * len(true)
    assert all(0.5 <= r["confidence"] <= 1 for r in rows)
    assert linkage.link(a.limit(0), w).count() == 0 and linkage.link(a, w.limit(0)).count() == 0


def test_any_number_of_associations(spark):
    sure = spark.createDataFrame([(f"sport{i}", [f"r:s{i}", "r:all"]) for i in range(300) for _ in range(3)] + [("", ["r:s1"]), ("sport2", ["r:s1"]), ("x", None)], "sport string, sports array<string>")
    known = linkage.associations(sure, "sports", "sport")
    assert {(r["p"], r["v"]) for r in known.collect()} == {(f"r:s{i}", f"sport{i}") for i in range(300)}
    pages = spark.createDataFrame([(1, ["r:s1", "r:new"]), (2, ["r:new"]), (3, None), (4, [])], "wiki_id long, said array<string>")
    got = {r["wiki_id"]: r["h"] for r in linkage.hear(pages, "said", known, "h").collect()}
    assert got == {1: ["sport1"], 2: None, 3: None, 4: None}
    assert [linkage._heard(*x) for x in ((["a"], "a"), (["a"], "b"), (None, "a"), (["a"], None), (["a"], ""))] == [1, -1, 0, 0, 0]


def test_descriptions_differ_by_their_keys(spark):
    side = spark.createDataFrame([(3, "anna b", ["k1"]), (2, "anna b", ["k1"]), (4, "anna b", ["k2"]), (5, None, ["k1"])], "ath_id long, name string, keys array<string>")
    one, of = linkage._classes(side, "ath_id")
    assert {(r["ath_id"], tuple(r["keys"])) for r in one.collect()} == {(2, ("k1",)), (4, ("k2",)), (5, ("k1",))}
    assert {tuple(r) for r in of.select("__a", "ath_id").collect()} == {(2, 2), (2, 3), (4, 4), (5, 5)}


def test_double_surnames(spark):
    assert linkage.halves("Nadia Klotsac-Frianenko") == ["nadia klotsac", "nadia frianenko"]
    assert linkage.halves("Kim Min-jung") == linkage.halves("Jean-Pierre Martin") == linkage.halves("Klotsac-Frianenko") == linkage.halves("") == []
    assert linkage.halves("Omar El-Sabir") == ["omar sabir"]
    whole = ["nadia klotsacfrianenko"]
    assert linkage.name_votes("nadia klotsac", whole)[0] == -1 and linkage.name_votes("nadia klotsac", whole, [], linkage.halves("Nadia Klotsac-Frianenko")) == (1, 1, 0)
    assert linkage.name_votes("nadia klotsacpetrova", whole, linkage.halves("Nadia Klotsac-Petrova"), linkage.halves("Nadia Klotsac-Frianenko"))[0] == -1
    a, w, true = people(spark)
    more = [(5000, "Nadia Klotsac", "Norway", "Rowing", "1963", None), (5001, "Petra Zubrin-Halvik", "Chile", "Judo", "1971", None), (5002, "Lena Morvat", "Spain", "Archery", "1980", None)]
    pages = [(6000, "Nadia Klotsac-Frianenko", "Rowing", "Town, Norway", "Nadia Klotsac-Frianenko (born 3 May 1963) is a Norwegian rower."), (6001, "Petra Halvik", "Judo", "Town, Chile", "Petra Halvik (born 1971) is a Chilean judoka."), (6002, "Morvat-Tesk, Lena", "Archery", "Town, Spain", None), (6003, "Lena Ostvik-Tesk", "Archery", "Town, Spain", None)]
    a = a.drop("wiki_id").unionAll(spark.createDataFrame(more, a.drop("wiki_id").schema))
    w = w.drop("confidence").unionAll(spark.createDataFrame(pages, w.drop("confidence").schema))
    got = {(r["ath_id"], r["wiki_id"]) for r in linkage.link(a, w).collect()}
    assert {x for x in got if x[0] >= 5000 or x[1] >= 6000} == {(5000, 6000), (5001, 6001), (5002, 6002)}
    assert len({x for x in got if x[0] < 5000} & true) >= 0.95 * len(true)


# p2

MARKED = ["**Club**", "''x''", "{{nowrap|Club}}", "[[A (b)|A]]", "a&nbsp;b", "AC <!-- sic -->", "x<br />", "Club]]", "[[Club", r"\textsc{A}", "$$s = x$$", "`code`", "[A](https://a.example/x)", "== H ==", "# Head", "* item one", "<small>x</small>", "| a | b |\n|---|---|\n| 1 | 2 |", r"y~\cite{k}", "<ref>q</ref>x", "__NOTOC__a", "{\\it x}", "&amp;nbsp;"]
PLAIN = markup.Node("root", "", [markup.Node("text")])
UNMARKED = ["Club #7 Town", "A <30 Squad", "R&D Racing", "A & B", "rose from $5,000 to $12,000", "$5,000 to $", "4 * 100 relay", "user_7_official", "[sic]", "was > 4 s ahead", "< 1 s", "50 % luck", "[...]", "a/b", "O'Brien's", "2 ^ 3", LONG, ""]


def test_markup():
    bad = [x for x in MARKED if markup.parse(x).size() == markup.match(markup.parse(x), PLAIN)]
    assert not bad
    bad = [x[:40] for x in UNMARKED if markup.parse(x).size() > markup.match(markup.parse(x), PLAIN)]
    assert not bad
    assert markup.strip("<h2>Early</h2><p>A [[b|c]] {{convert|3|m}}</p><ul><li>one</li><li>two</li></ul><pre>x = 1\ny</pre> $$e=1$$") == "## Early\n\nA c 3 m\n\n- one\n- two\n\n```\nx = 1\ny\n```\n $e=1$"
    assert markup.strip(None) is None and markup.strip("") == "" and len(markup.strip("{{" * 3000 + "x")) < 10_000


def test_tree_matching_is_best():
    def brute(a, b):
        if a.tag != b.tag:
            return 0
        best, n = 0, min(len(a.kids), len(b.kids))
        for k in range(n + 1):
            for x in itertools.combinations(a.kids, k):
                for y in itertools.combinations(b.kids, k):
                    best = max(best, sum(brute(i, j) for i, j in zip(x, y)))
        return 1 + best

    rnd = random.Random(3)

    def tree(d):
        return markup.Node(rnd.choice("ab"), "", [tree(d - 1) for _ in range(rnd.randint(0, 3))] if d else [])

    for _ in range(60):
        a, b = tree(2), tree(2)
        assert markup.match(a, b) == brute(a, b)
        assert sum("~" not in p for _, p in markup.align(a, b)) >= (markup.match(a, b) if a.tag == b.tag else 0)


def test_wrapper(spark):
    rows = [("h", f"<div>Menu</div><p>Story {i} tells &amp; more</p>") for i in range(30)] + [("h", None), (None, "a **b**"), ("g", "")]
    df = spark.createDataFrame(rows, "site string, html string").withColumn("clean", F.lit("old"))
    got = [r["clean"] for r in markup.clean(df, "site", "html", "clean").collect()]
    assert len(got) == 33 and sum(x is None for x in got) == 1 and "a b" in got
    stories = [x for x in got if x and "Story" in x]
    assert len(stories) == 30 and all("Menu" not in x and "& more" in x for x in stories)
    assert markup.clean(df.limit(0), "site", "html", "clean").count() == 0
    flags = {r["html"]: (r["clean"], r["m"]) for r in markup.clean(df.withColumn("m", F.lit("old")), "site", "html", "clean", flag="m").collect()}
    assert flags[None] == (None, False) and flags[""] == ("", False) and flags["a **b**"] == ("a b", True) and all(m for x, (_, m) in flags.items() if x and "Story" in x)


def test_flags_of_columns(spark):
    rows = [(i, "c", x) for i, x in enumerate(MARKED + UNMARKED)] + [(500 + i, "plain", x) for i, x in enumerate(UNMARKED)] + [(900 + i, "c", f"**Club {i}**") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, field string, value string")
    got = {r["id"] for r in markup.clean(df, "field", "value", "clean", flag="marked").where("marked").collect()}
    assert got == {*range(len(MARKED)), *range(900, 930)}


def test_markup_of_any_depth():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert markup.strip(deep) == "x" and markup.parse(deep).size() == 3002
    quoted = "> " * 400 + "said *so*"
    assert markup.strip(quoted) == "said so"
    nested = "".join(f"\\begin{{box{'a' * i}}}" for i in range(40)) + "in **the** middle" + "".join(f"\\end{{box{'a' * i}}}" for i in reversed(range(40)))
    assert markup.strip(nested) == "in the middle"
    assert markup.match(markup.parse(deep), markup.parse(deep)) == 3002 and len(markup.align(markup.parse(deep), markup.parse(deep))) == 3002
    assert markup.match(markup.parse(deep), markup.parse(deep.replace("x", "<b>y</b>"))) == 3001
    assert markup.strip("<b></i>" * 20_000 + "end") == "end"


def test_wrapper_compares_whole_texts(spark):
    menu = "".join(f"<a>Menu entry {i} of this site</a>" for i in range(20))  # over 200 characters ahead of the article
    rows = [(i, f"<html><body><div>{menu}<p>Story {i} tells more</p></div></body></html>") for i in range(12)]
    same = [(100 + i, f"<html><body><div>{menu}</div><p>Note {i}</p></body></html>") for i in range(12)]
    for part in (rows, same):
        df = spark.createDataFrame(part, "id int, html string").withColumn("site", F.lit("h"))
        got = {r["id"]: r["clean"] for r in markup.clean(df, "site", "html", "clean").collect()}
        assert all((f"Story {i}" if i < 100 else f"Note {i - 100}") in x and "Menu" not in x for i, x in got.items()) and len(got) == 12


def test_reference_of_any_length(spark):
    story = "She rowed for ten years and won twice. " * 600
    long = [("long", f"<div>Menu</div><div>Story {i} {story}</div><div>By {i}</div>") for i in range(6)]  # the nodes share a tag path, so only the alignment tells them apart
    head = "<p>x</p>" * 400  # the shapes differ after 2,000 characters only
    deep = [("deep", head + (f"<div>Menu</div><div>Note {i}</div><div>By {i}</div>" if i < 6 else f"<b>{i}</b><i>y</i>")) for i in range(10)]
    assert all(len(t) > 20_000 for _, t in long) and all(len(t) > 2000 for _, t in deep)
    df = spark.createDataFrame(long + deep, "site string, html string")
    got = markup.clean(df, "site", "html", "clean").collect()
    stories = [r["clean"] for r in got if r["site"] == "long"]
    assert len(got) == 16 and all("Menu" not in x and "Story" in x and x.count("twice.") == 600 for x in stories)
    assert all("Menu" not in r["clean"] and "Note" in r["clean"] for r in got if "Note" in r["html"])
    a, b = (markup.parse(head + x).shape() for x in ("<b>1</b>", "<i>1</i>"))
    assert a[:2000] == b[:2000] and markup._short(a, 2000) != markup._short(b, 2000) and markup._short(a[:2000], 2000) == a[:2000]


def test_prose():
    ok = "She rowed for ten years and won twice."
    assert markup.complete_prose(ok) and markup.complete_prose(ok + "\n[[Category:x]]") and markup.complete_prose("'''" + ok + "'''</p>")
    for bad in (None, "", "TBC", "Biography to follow", ok[:-1] + "...", ok + " Then she wen…", ok + " [...]", ok + " She also", "(no text)"):
        assert not markup.complete_prose(bad)


# p3

def test_union_find_and_rewriter():
    u = confusables.UnionFind()
    for a, b in (("a", "b"), ("c", "d"), ("b", "c"), ("x", "y")):
        u.join(a, b)
    assert sorted(map(tuple, u.classes())) == [("a", "b", "c", "d"), ("x", "y")]
    r = confusables.Rewriter({c: 9 for c in "abcdefghijklmnopqrstuvwxyzáéîí"})
    cases = {"Ｂｅｎｏîｔ Mástini": "Benoît Mástini", "Fíaler": "Fíaler", "Τhéo": "Théo", "Β. Τeiber": "B. Teiber", "Tob​ias X": "Tobias X", "Sara‐Slaber": "Sara-Slaber", "Νίκος Περεης": "Νίκος Περεης", "Тарас Тикеев": "Тарас Тикеев", "Милош Петако (Jakob N. Daurowick)": "Милош Петако (Jakob N. Daurowick)", "Łukasz O'Brien": "Łukasz O'Brien", "": "", None: None, "e" + "​" + "́": "é"}
    assert {k: r(k) for k in cases} == cases
    long = "Аnna " * 20_000 + "Smith"
    assert r(long) == "Anna " * 20_000 + "Smith"
    assert all(r(r(k)) == r(k) for k in cases)


def test_representatives_are_no_compatibility_forms(spark):
    names = [(i, f"Christina Ost{i}") for i in range(40)] + [(100, "Christina Öst"), (101, "Chri\ufb06ina Ost7"), (102, "Ru\ufb00o"), (103, "Ruffo"), (104, "N\u2116 1\u2026")]
    df = spark.createDataFrame(names, "id int, name string")
    got = {r["id"]: r["unified"] for r in confusables.unify(df, "name", "unified").collect()}
    assert all(got[i] == n for i, n in names if i < 101) and got[101] == got[7] and got[102] == got[103] == "Ruffo" and got[104] == "NNo 1..."
    assert sorted(r["id"] for r in confusables.odd_names(df, "name").collect()) == [101, 102, 104]
    # one word has one form, be it ASCII or not, and whichever form prevails
    for counts in ({}, {"\ufb06": 99, "\ufb00": 99, "а": 999, "\u00a0": 999, "\u2010": 999, "ｓ": 999}):
        r = confusables.Rewriter(counts)
        for word in ("Christina-Ost ab", "Ruffo kilo"):
            forms = {r(x) for x in (word, word.replace("st", "\ufb06").replace("ff", "\ufb00"), word.replace("-", "\u2010"), word.replace(" ", "\u00a0"), word.replace("a", "а"), word.replace("s", "ｓ"), word[:3] + "\u200b" + word[3:], word[:3] + "\U000e0101" + word[3:])}
            assert len(forms) == 1
    assert not any(len(v) > 1 for v in _able_strings())


def _able_strings():
    """Strings of several code points that could represent a class beside another member."""
    for g in confusables.classes():
        able = [m for m in g if confusables._settled(m)]
        if "" not in g and len(able) > 1:
            yield [m for m in able if len(m) > 1]


def test_unify(spark):
    df = spark.createDataFrame([(1, "José"), (1, "José"), (2, "José"), (3, None), (4, "")], "id int, name string").withColumn("unified", F.lit(1))
    got = {r["id"]: r["unified"] for r in confusables.unify(df, "name", "unified").collect()}
    assert got == {1: "José", 2: "José", 3: None, 4: ""}
    assert [r["id"] for r in confusables.odd_names(df, "name").collect()] == [2]
    assert confusables.odd_names(df.limit(0), "name").count() == 0


# p4

def test_min_cut_is_least():
    rnd = random.Random(5)
    for _ in range(80):
        n = rnd.randint(1, 8)
        odds = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 1.5)) for i in range(n) for j in range(i) if rnd.random() < 0.5]

        def cost(x):
            return sum(-o if k and o < 0 else o if not k and o > 0 else 0 for o, k in zip(odds, x)) + sum(w for i, j, w in edges if x[i] != x[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(boilerplate.min_cut(odds, edges)) - best) < 1e-9
        spots = [None] * n
        decided = boilerplate.cut_page(odds, spots)
        near = [(i - 1, i, boilerplate.TIE_NEAR) for i in range(1, n)]

        def chain(x):
            return sum(-o if k and o < 0 else o if not k and o > 0 else 0 for o, k in zip(odds, x)) + sum(w for i, j, w in near if x[i] != x[j])

        assert abs(chain(decided) - min(map(chain, itertools.product([False, True], repeat=n)))) < 1e-9


def page(i, rnd):
    body = [f"The team number {rnd.randint(1, 99)} rowed across the lake and came back before the rain on day {i}." for _ in range(rnd.randint(2, 5))]
    parts = [("nav", "Home | News | Shop"), ("h1", f"Crew {i} wins again"), *[("p", b) for b in body], ("footer", "Terms of use | Privacy")]
    html = "<html><body><nav>Home | News | Shop</nav><article><h1>%s</h1>%s<span class='x'>Share this: Mail</span></article><footer>Terms of use | Privacy</footer></body></html>" % (parts[1][1], "".join(f"<p>{b}</p>" for b in body))
    lines = ["Home | News | Shop", parts[1][1], *body, "Share this: Mail", "Terms of use | Privacy"]
    return html, "\n".join(lines), {1, len(lines) - 1, len(lines)}


def test_boilerplate(spark):
    rnd = random.Random(1)
    made = [page(i, rnd) for i in range(60)]
    rows = [(str(i), h if i % 5 else None, t, "clash") for i, (h, t, _) in enumerate(made)]
    rows += [rows[3], ("n", "<p>x</p>", None, ""), ("e", None, "", ""), ("s", "", "\n\n", "")]
    df = spark.createDataFrame(rows, "doc_id string, raw_html string, text string, content string")
    model = boilerplate.train(df)
    got = {}
    found = boilerplate.boilerplate_lines(df, model).collect()
    for r in found:
        got.setdefault(r["doc_id"], set()).add(r["line_no"])
    assert len(found) == len({(r["doc_id"], r["line_no"]) for r in found})
    right = sum(got.get(str(i), set()) == m[2] for i, m in enumerate(made))
    assert right >= 57 and "n" not in got and got["s"] == {1, 2, 3} and got["e"] == {1}
    assert boilerplate.label_lines(df.limit(0), model).count() == 0


def test_sample_has_no_copies(spark, monkeypatch):
    df = spark.createDataFrame([("a", "<p>x</p>", "x")] * 50 + [("a", "<p>x</p>", "y"), ("b", "<p>z</p>", "z" * 100), ("c", None, "x"), ("d", "x", None)], "doc_id string, raw_html string, text string")
    monkeypatch.setattr(boilerplate, "fit", lambda pages: pages)
    assert boilerplate.train(df) == [("<p>x</p>", "y"), ("<p>z</p>", "z" * 100)]
    assert len(boilerplate.train(df, chars=20)) <= 1 and len(boilerplate.train(df, limit=1)) == 1 and boilerplate.train(df.limit(0)) == []


# p5

def test_survivors(spark):
    rnd = random.Random(8)
    rows = [(f"k{rnd.randint(0, 6)}", i, rnd.randint(0, 8), rnd.choice([None, "v%d" % i]), rnd.choice([None, 3, 7, 9]), rnd.choice([None, 0, 1, 2])) for i in range(120)]
    rows += [rows[0], ("one", 500, 1, "x", 1, 1), (None, 501, 1, "x", 1, 1), (None, 502, 2, "x", 1, 1), ("none", 503, 1, None, 1, 1), ("none", 504, 2, None, 1, 1)]
    df = spark.createDataFrame(rows, "k string, entity int, rec int, value string, day int, trust int").withColumn("at", F.timestamp_seconds("day")).withColumn("ok", F.col("value").isNotNull())
    got = {r["k"]: (r["record"], r["usable"]) for r in survivor.survivors(df, "k", "rec", {"value": "ok"}, "at", "trust").collect()}
    want = {}
    for k in {r[0] for r in rows if r[0]}:
        own = [r for r in rows if r[0] == k]
        if len({r[1] for r in own}) > 1:
            best = max(own, key=lambda r: (r[3] is not None, r[4] if r[4] is not None else -1, r[5] if r[5] is not None else -1, -r[2]))
            want[k] = (best[2], best[3] is not None)
    assert got == want and got["none"][1] is False
    assert survivor.survivors(df.limit(0), "k", "rec", {"value": "ok"}, "at", "trust").count() == 0


def test_layers_decide(spark):
    # (key, entity, record, bio, height, day, trust): A beats C, D beats neither and isn't beaten
    a, c, d, e = (1, 10, None, "hA", 24, 5), (2, 11, "bC", None, 22, 0), (3, 12, "bD", "hD", 19, 9), (4, 13, None, None, 30, 7)
    rows = [("acd", *r) for r in (a, c, d)] + [("ac", *r) for r in (a, c)] + [("e", *e), ("e", 5, 14, "bF", None, 20, 6), ("e", 6, 15, "bG", None, 21, 1)]
    df = spark.createDataFrame(rows, "k string, entity int, rec int, bio string, height string, day int, trust int").withColumn("at", F.timestamp_seconds("day")).withColumn("b", F.col("bio").isNotNull()).withColumn("h", F.col("height").isNotNull())

    def run(*dimensions):
        got = survivor.survivors(df, "k", "rec", {"bio": "b", "height": "h"}, "at", "trust", dimensions=dimensions or survivor.DIMENSIONS).collect()
        return {(r["k"], r["field"]): (r["value"], r["layer"]) for r in got if r["usable"]}

    whole = run()
    assert whole["acd", "bio"] == ("bD", 1)  # not the later bC, whose record is beaten by A
    assert whole["acd", "height"] == ("hA", 1) and whole["ac", "height"] == ("hA", 1)
    assert whole["ac", "bio"] == ("bC", 2)  # the skyline has no bio
    assert whole["e", "bio"] == ("bG", 1) and ("e", "height") not in whole
    latest = run("recency")
    assert latest["acd", "bio"] == ("bC", 2) and latest["e", "bio"] == ("bG", 2) and latest["acd", "height"] == ("hA", 1)


def test_layers_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randint(0, 9)}", i, i, rnd.choice([None, f"v{i}"]), rnd.choice([None, f"w{i}"]), rnd.randint(1, 6), rnd.randint(0, 3)) for i in range(160)]
    df = spark.createDataFrame(rows, "k string, entity int, rec int, x string, y string, day int, trust int").withColumn("at", F.timestamp_seconds("day")).withColumn("a", F.col("x").isNotNull()).withColumn("b", F.col("y").isNotNull())
    got = {(r["k"], r["field"]): (r["record"], r["usable"], r["layer"]) for r in survivor.survivors(df, "k", "rec", {"x": "a", "y": "b"}, "at", "trust").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        best = {}
        for r in rows:
            if r[0] == k:
                c = (r[3] is not None, r[4] is not None, r[6])
                best[c] = max(best.get(c, r), r, key=lambda r: (r[5], -r[2]))
        left, layer, layers = list(best.values()), 0, []
        point = lambda r: ((r[3] is not None) + (r[4] is not None), r[5], r[6])
        while left:
            layer += 1
            top = [r for r in left if not any(point(q) != point(r) and all(x >= y for x, y in zip(point(q), point(r))) for q in left)]
            layers.append(top)
            left = [r for r in left if r not in top]
        for f, at in (("x", 3), ("y", 4)):
            n = next((n for n, rs in enumerate(layers) if any(r[at] is not None for r in rs)), None)
            own = layers[0] if n is None else [r for r in layers[n] if r[at] is not None]
            want[k, f] = (max(own, key=lambda r: (r[5], r[6], -r[2]))[2], n is not None, 1 if n is None else n + 1)
    assert got == want


def test_wiki_survivors(spark):
    ok = "She rowed for ten years and won two medals."
    e = [("a  b", 1, 10, ok, "180 cm", []), ("a b ", 2, 11, ok + " Then", "tall", ["u"]), ("a b", 3, 12, "TBC", "1.70", []), ("a b", 3, 12, "TBC", "1.70", []), (" ", 4, 10, ok, "1.80", []), (" ", 5, 10, ok, "1.80", []), ("c", 6, None, None, None, None), ("c", 7, None, None, None, None)]
    ents = spark.createDataFrame(e, "name_norm string, entity_id int, wiki_id long, wiki_bio string, wiki_height string, lookup_urls array<string>")
    wiki = spark.createDataFrame([(10, "2020-01-01"), (11, "2024-01-01"), (12, None), (12, None)], "wiki_id long, t string").select("wiki_id", F.to_timestamp("t").alias("revised_at"))
    got = {(r["name_norm"], r["field"]): (r["record"], r["usable"]) for r in survivor.wiki_survivors(ents, wiki).collect()}
    assert got == {("a b", "wiki_bio"): (10, True), ("a b", "wiki_height"): (10, True)}


# p7

def test_distinctive(spark):
    rows = [(0, "x", {"a": 2, "b": 1}), (0, "x", {"a": 2, "b": 1}), (0, "y", {"a": 1}), (1, "x", {"c": 5}), (1, "z", {"c": 1, "d": 1}), (1, None, {"a": 9}), (1, "q", None), (1, "w", {"d": 0})]
    df = spark.createDataFrame(rows, "segment int, term string, postings map<string,int>").withColumn("tf", F.lit(1))
    s = distinctive.distinctiveness(distinctive.postings(df))
    got = {(r["doc_id"], r["term"]): (r["tf"], r["df"], r["n_docs"]) for r in s.collect()}
    assert got == {("a", "x"): (2, 3, 4), ("b", "x"): (1, 3, 4), ("a", "y"): (1, 1, 4), ("c", "x"): (5, 3, 4), ("c", "z"): (1, 2, 4), ("d", "z"): (1, 2, 4)}
    same = distinctive.index_distinctiveness(df)  # pages in several segments
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, s.collect()))
    maps = [(0, "x", {"a": 2, "b": 1}), (0, "x", {"a": 3}), (0, "x", {"c": 1}), (0, "y", {"a": 1, "f": 2}), (None, "y", {"f": 5}), (None, "y", {"g": 1}), (2, "w", {"h": 3})]
    differing = spark.createDataFrame(maps, "segment int, term string, postings map<string,int>")  # rows of one (segment, term) that are no copies
    two = sorted(map(tuple, distinctive.index_distinctiveness(differing).collect()))
    assert two == sorted(map(tuple, distinctive.distinctiveness(distinctive.postings(differing)).collect()))
    assert {r[:3] for r in two} == {("a", "x", 3), ("b", "x", 1), ("c", "x", 1), ("a", "y", 1), ("f", "y", 5), ("g", "y", 1), ("h", "w", 3)}
    assert {r["doc_id"]: r["term"] for r in distinctive.top_term(distinctive.index_distinctiveness(differing), by="z").collect()}["a"] == "x"
    apart = df.where("segment = 0 OR term = 'z' AND 1 = 0 OR segment IS NULL").unionByName(spark.createDataFrame([(None, "x", {"e": 4}, 1)], df.schema))
    one, two = distinctive.index_distinctiveness(apart), distinctive.distinctiveness(distinctive.postings(apart))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == 4
    assert {r["doc_id"]: r["term"] for r in distinctive.top_term(s).collect()} == {"a": "y", "b": "x", "c": "x", "d": "z"}
    z = {(r["doc_id"], r["term"]): r["z"] for r in s.collect()}
    a = lambda w: 500.0 * w / 11
    i, rest = 1 + a(1), 0 + a(1)
    want = (np.log(i / (3 + 500 - i)) - np.log(rest / (11 - 3 + 500 - rest))) / np.sqrt(1 / i + 1 / rest)
    assert abs(z["a", "y"] - want) < 1e-9
    ties = spark.createDataFrame([("d", t, 1) for t in ("é", "b", "ab", "a")], "doc_id string, term string, weight int")
    assert distinctive.top_term(ties).first()["term"] == "a"
    assert distinctive.distinctiveness(distinctive.postings(df.limit(0))).count() == 0 and distinctive.index_distinctiveness(df.limit(0)).count() == 0


# p8

@pytest.mark.parametrize("seed", range(12))
def test_plan_fits(seed):
    rnd = random.Random(seed)
    cap = rnd.choice([10, 50, 2048])
    hist = {s: rnd.randint(1, 40) for s in rnd.sample(range(1, cap + 1), min(cap, rnd.randint(1, 30)))}
    placed, bins = packing.plan(hist, cap)
    used, large = {}, {}
    for s, runs in placed.items():
        runs_sorted = sorted(runs)
        assert runs_sorted == runs and [r[0] for r in runs] == [sum(x[1] for x in runs[:i]) for i in range(len(runs))] and sum(r[1] for r in runs) == hist[s]
        for _, n, at in runs:
            for b in range(at, at + n):
                used[b] = used.get(b, 0) + s
                large[b] = large.get(b, 0) + (3 * s > cap)
    assert set(used) == set(range(bins)) and max(used.values()) <= cap and max(large.values()) <= 2
    least = -(-sum(s * n for s, n in hist.items()) // cap)
    assert bins <= max(least, sum(n for s, n in hist.items() if 2 * s > cap)) * 1.25 + 2


def test_pack(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([5, 5, 5, 40, 77, 0, None, 250])) for i in range(500)] + [(1, 5), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, n int").withColumn("size", F.lit("clash"))
    got = packing.pack(df, "doc_id", "n", 100).collect()
    used = {}
    for r in got:
        used[r["container"]] = used.get(r["container"], 0) + r["size"]
    assert max(used.values()) <= 100 and sum(used.values()) == sum(n or 0 for _, n in rows)
    assert sum(r["size"] == 100 for r in got) == 2 * sum(n == 250 for _, n in rows) and {r["piece"] for r in got if r["size"] < 100 and r["piece"]} == {2}
    assert tuple(packing.faults(packing.pack(df.where("doc_id <> 1"), "doc_id", "n", 100), "doc_id", 100).first())[1:] == (0, 0, 0)
    bad = spark.createDataFrame([(1, 0, 0, 60, 0), (1, 1, 60, 30, 0), (2, 0, 0, 20, 0), (3, 1, 100, 5, 2)], "doc_id long, piece int, from_token long, size int, container long")
    assert tuple(packing.faults(bad, "doc_id", 100).first()) == (3, 1, 1, 1)
    report = packing.fill_report(packing.pack(df, "doc_id", "n", 100), 100).first()
    assert report["filled"] > 0.9
    assert packing.pack(df.limit(0), "doc_id", "n", 100).count() == 0
    t = spark.createDataFrame([("a", LONG), ("b", ""), ("c", None), ("d", "one two")], "doc_id string, text string")
    n = {r["doc_id"]: r["n_tokens"] for r in packing.count_tokens(t, "text").collect()}
    assert n["b"] == n["c"] == 0 and n["d"] == 2 and n["a"] == 40_001


# p9

def altered(ws, rnd, rate):
    out = []
    for w in ws:
        x = rnd.random()
        if x < rate / 3:
            continue
        out.append(w if x > 2 * rate / 3 else "other")
        if rnd.random() < rate / 3:
            out.append("perhaps")
    return out


def leak_case(seed=1, n_items=40, n_docs=150):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(900)]
    items = [(i, (["True or false? ", ""][i % 2]) + " ".join(rnd.choice(vocab) for _ in range(rnd.randint(40, 90)))) for i in range(n_items)]
    docs, true = [], set()
    for d in range(n_docs):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(20, 300))]
        if d % 3 == 0:
            i = rnd.randrange(n_items)
            ws = items[i][1].replace("True or false? ", "").split()
            k = int(len(ws) * rnd.uniform(0.6, 1))
            at = rnd.randint(0, len(ws) - k)
            part = altered(ws[at : at + k], rnd, 0.12 if d % 2 else 0.0)
            p = rnd.randint(0, len(words))
            words[p:p] = part
            true.add((d, i))
        docs.append((d, rnd.choice([" ", "\n", "  "]).join(words).upper() if d % 7 == 0 else ", ".join(words)))
    return docs, items, true


def test_leaks(spark):
    docs, items, true = leak_case()
    docs += [(900, None), (901, ""), (902, LONG), (903, docs[0][1])]
    true |= {(903, i) for d, i in true if d == 0}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    it = spark.createDataFrame([*items, items[0], (99, None), (98, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(df, it).collect()}
    assert got <= true and len(got) >= 0.97 * len(true)
    assert leakage.find_leaks(df.limit(0), it).count() == 0 and leakage.find_leaks(df, it.limit(0)).count() == 0


def test_recall_against_brute_force():
    docs, items, _ = leak_case(3, 30, 60)
    prefixes = leakage.task_prefixes([t for _, t in items])
    h = leakage._Hasher()
    syms = {i: h(leakage.words(leakage.passage(t, prefixes))) for i, t in items}
    brute = set()
    for d, t in docs:
        s = np.concatenate([h(leakage.words(t)), np.zeros((leakage.WINDOW, 4), np.uint64)])
        for i, x in syms.items():
            if leakage.local_scores(s, np.array([0]), len(s), x, np.array([0]), np.array([len(s)]))[0] / len(x) >= leakage.SHARE:
                brute.add((d, i))
    import pandas as pd

    scan = leakage._scan([i for i, _ in items], [t for _, t in items], prefixes, leakage.SHARE, "doc_id", "item_id", "text")
    got = {(r.doc_id, r.item_id) for p in scan(iter([pd.DataFrame(docs, columns=["doc_id", "text"])])) for r in p.itertuples()}
    assert got <= brute and len(got) >= 0.97 * len(brute)


def test_short_items_and_neighbours(spark):
    items = [(1, "zebra quartz lantern"), (2, " ".join(f"alpha{i}" for i in range(15))), (3, "solo"), (4, " ".join(f"beta{i}" for i in range(40)))]
    docs = [(10, "we saw a zebra near the quartz lantern"), (11, "x " * 50 + " ".join(f"alpha{i}" for i in range(0, 15, 2))), (12, "nothing of it"), (13, "he went solo"), (14, "only a zebra"), (15, "y " * 30 + " ".join(f"beta{i}" for i in range(5, 30)))]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(10, 1), (11, 2), (13, 3), (15, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(df, it).collect()} == want
    for x in items:  # an item is found alike whatever items stand beside it
        alone = spark.createDataFrame([x], "item_id long, text string")
        assert {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(df, alone).collect()} == {w for w in want if w[1] == x[0]}


def test_pruned_walks_lose_no_meeting():
    rng = np.random.default_rng(2)
    symbols = np.concatenate([rng.integers(1, 60, 3000), np.zeros(leakage.WINDOW)]).astype(np.uint64)
    known = (symbols % np.uint64(3) == 0) & (symbols > 0)
    full = list(leakage.signatures(symbols))
    for (pos, key), (p, k) in zip(full, leakage.signatures(symbols, known=known)):
        every = dict(zip(pos.tolist(), key.tolist()))
        assert all(every[i] == x for i, x in zip(p.tolist(), k.tolist())) and len(p) < len(pos)
    # a key of an item made of known words is met wherever it stands in full
    item = symbols[100:140].copy()
    mine = np.isin(symbols, item)
    for (pos, key), (p, k) in zip(full, leakage.signatures(symbols, known=mine)):
        at = (pos >= 100) & (pos <= 124)
        assert set(pos[at].tolist()) <= set(p.tolist())


def test_passage_and_words():
    assert leakage.words("The ﬁnal was Vlaufber-\ng's [see note] DAY") == ["the", "final", "was", "vlaufbergs", "day"]
    p = leakage.task_prefixes(["Read on: a b.", "Read on: c d.", "Read on: e", "Once. x"])
    assert leakage.passage("Read on: a b.", p) == "a b." and leakage.passage("Once. x", p) == "Once. x"


# p10

BAD = ["You {0} {1}, you cost us the race!", "Shut up, you {1}, nobody likes {0} people.", "Every {1} like {0} should vanish."]
GOOD = ["The {0} team arrived late on {1}.", "Rain stopped play near {0} for {1} minutes.", "The coach of {0} praised {1} and the crew.", "I was a fool to start so fast, {0} laughed with {1}."]


def abusive(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    out = []
    for i in range(n):
        s = [rnd.choice(GOOD).format(word(), word()) for _ in range(rnd.randint(2, 6))]
        y = rnd.random() < 0.3
        if y:
            x = rnd.choice(BAD).format(word(), rnd.choice(["moron", "filthy rat", "scumbag"]))
            if rnd.random() < 0.3:
                x = x.replace("moron", "m​o​r​o​n").replace("rat", "r a t").replace("scumbag", "5cumb@g")
            s.insert(rnd.randint(0, len(s)), x)
        out.append((i, " ".join(s), y))
    return out


def test_fold():
    assert abuse.fold("m​o​ron") == "moron" and abuse.fold("cеrdо") == "cerdo" and abuse.fold("nuuuudes") == "nudes"
    assert abuse.fold("p i e c e of") == "piece of" and abuse.fold("5p1n3l355 r@7") == "spineless rat" and abuse.fold("l-o-s-e-r") == "loser" and abuse.fold("xxxxx") == "xxx"
    assert abuse.fold("in 1998 at 4.20, 3-2") == "in 1998 at 4.20, 3-2"


def test_folded_model_equals_kernel():
    text = [abuse.fold(t) for _, t, _ in abusive(1, 12)]
    m = abuse._Matrix(text)
    dense = np.zeros((len(text), abuse.CHAR_DIMS + abuse.WORD_DIMS))
    for i in range(len(text)):
        dense[i, m[i][0]] = m[i][1]
    v = np.random.default_rng(0).normal(size=dense.shape[1])
    got = abuse._score(text, (v[: abuse.CHAR_DIMS], v[abuse.CHAR_DIMS :]), 0.25, abuse.Features())
    assert np.allclose(got, dense @ v + 0.25, atol=1e-4)
    s = "abcdefg"  # subsequences of three, by brute force
    want = {}
    for i, j, k in itertools.combinations(range(len(s)), 3):
        if k - i < abuse.SPAN:
            want[s[i] + s[j] + s[k]] = abuse.DECAY ** (k - i - 2)
    idx, val, _ = abuse._rows([s])
    code = lambda g: (abuse._CODES[ord(g[0])] * 32 + abuse._CODES[ord(g[1])]) * 32 + abuse._CODES[ord(g[2])]
    norm = np.sqrt(sum(x**2 for x in want.values()))
    own = dict(zip(idx.tolist(), val.tolist()))
    assert all(abs(own[code(g)] - x / norm) < 1e-5 for g, x in want.items())


def test_abuse_held_out(spark):
    train, test = abusive(1, 500), abusive(2, 300)
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in train], "doc_id long, text string, source string")
    labels = [(i, int(y if rnd.random() > 0.05 else not y), "r", None) for i, _, y in train] + [(0, None, "r", None), (None, 1, "r", None), (9999, 1, "r", None)]
    lab = spark.createDataFrame([*labels, labels[0]], "doc_id long, toxic int, rater string, rated_at timestamp")
    terms = spark.createDataFrame([("moron", 3), ("fool", 3), (None, 3)], "term string, weight int")
    model = abuse.train(docs, lab, terms)
    held = spark.createDataFrame([(i, t, "a" if i % 2 else None, 1) for i, t, _ in test] + [(900, None, "a", 1), (901, "", "a", 1), (902, LONG, "a", 1)], "doc_id long, text string, source string, score int")
    scored = abuse.score_documents(held, model)
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert got[900] is None and got[901] is None and got[902] < 0 and len(got) == 303
    right = sum((got[i] > 0) == y for i, _, y in test)
    assert right >= 0.96 * len(test)
    rates = {r["source"]: r for r in abuse.rates(scored).collect()}
    assert rates["a"]["documents"] + rates[None]["documents"] == 303
    assert abuse.train(docs.limit(0), lab, terms) is None
    assert abuse.score_documents(held, None).where("score IS NOT NULL").count() == 0


def test_bounded_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c. " * 100) for i in range(40)] + [(1, "a b c. " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1, 1) for i in range(40)], "doc_id long, toxic int, rater int, rated_at int")
    monkeypatch.setattr(abuse, "fit", lambda data, words, weight: data)
    assert len(abuse.train(docs, labels)) == 40 and len(abuse.train(docs, labels, chars=7000)) == 10 and len(abuse.train(docs, labels, limit=5, clean=3)) == 8


def test_sample_stands_for_both_labels(spark, monkeypatch):
    train, test = abusive(1, 6000), abusive(2, 300)
    rnd = random.Random(9)
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in train], "doc_id long, text string, source string")
    lab = spark.createDataFrame([(i, int(y if rnd.random() > 0.1 else not y), "r", None) for i, _, y in train], "doc_id long, toxic int, rater string, rated_at timestamp")
    model = abuse.train(docs, lab, limit=150, clean=200)
    got = {r["doc_id"] for r in abuse.score_documents(spark.createDataFrame([(i, t, "s") for i, t, _ in test], "doc_id long, text string, source string"), model).where("score > 0").collect()}
    assert sum(i in got for i, _, y in test if y) >= 0.96 * sum(y for _, _, y in test)
    monkeypatch.setattr(abuse, "fit", lambda data, words, weight: weight)
    few = lab.where("doc_id < 40").withColumn("toxic", (F.col("doc_id") % 4 == 0).cast("int"))
    assert abuse.train(docs, few, limit=5, clean=6) == (30 / 6) / (10 / 5) and abuse.train(docs, few) == 1


def test_least_weight_of_terms(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c."), (2, "d e f.")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1, 1), (2, 0, 1, 1)], "doc_id long, toxic int, rater int, rated_at int")
    terms = spark.createDataFrame([("low", 1), ("mid", 2), ("high", 3), ("none", None), (None, 3)], "term string, weight int")
    monkeypatch.setattr(abuse, "fit", lambda data, words, weight: words)
    assert abuse.train(docs, labels, terms) == ["high", "mid"]
    assert abuse.train(docs, labels, terms, least_weight=1) == ["high", "low", "mid"] and abuse.train(docs, labels, terms, least_weight=3) == ["high"]
