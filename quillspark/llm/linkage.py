"""Matching entities across sources without keys: label-model linkage.

Candidates share a blocking key (a surname up to one letter, with an initial or a year). Matching functions vote on
each candidate for, against or not at all. A generative model learns the functions' accuracies from the counts of vote
patterns by EM, models the most correlated pairs of functions jointly, and gives each candidate its posterior.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import confusables, markup
from quillspark.session import broadcast_if_small, materialize

VOTERS = ("last", "first", "middle", "yob", "sport", "nation", "place", "career")
#: An association between a phrase of a page and a value of an athlete counts if it was seen so often and is this share
#: of the phrase's; a phrase is heard at all if its best value has this share.
SEEN, SHARE, CLEAR = 3, 0.12, 0.3

#: Letters without a decomposition.
_LETTERS = str.maketrans({"ł": "l", "đ": "d", "ø": "o", "æ": "ae", "œ": "oe", "ß": "ss", "ı": "i", "ð": "d", "þ": "th", "ħ": "h"})
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_BORN = re.compile(rf"\bborn\b[^.;()]{{0,40}}?\b(1[89]\d\d|20[0-3]\d)\b|\b\*\s*(1[89]\d\d|20[0-3]\d)\b|\b(?:\d{{1,2}} )?{_MONTH} (1[89]\d\d|20[0-3]\d)\b")
_IS_A = re.compile(r"\bis an? (?:retired |former )?((?:[A-Z][\w’'-]*\s){1,3})((?:[\w-]+ ?){1,3}?)(?= from\b|[.,;(]|$)")
_REPRESENTED = re.compile(r"\brepresented ([A-Z][\w’' -]*?) as an? ((?:[\w-]+ ?){1,3}?)(?=[.,;(]|$)")
_LEAD = re.compile(r"^\W*((?:[^\W\d_][\w.’'-]*\s+){0,4}[^\W\d_][\w.’'-]*)\s*(?:\(born|,? born| is a)")


def fold(name: str | None) -> str:
    """Plain lower-case letters, digits and spaces: look-alikes, accents, widths and invisible characters don't matter."""
    if not name:
        return ""
    t = name.translate(confusables.plain_table()) if not name.isascii() else name
    t = unicodedata.normalize("NFKD", t.lower().translate(_LETTERS))
    t = "".join(c for c in t if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", t.replace("'", "").replace("’", "").replace("-", "")).strip()


def variants(word: str) -> set[str]:
    """The word and what is left of it without one letter: words within one edit share a variant."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) > 3 else {word}


@lru_cache(maxsize=1 << 18)
def near(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours, 3 if more than 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    old, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if old and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, old[j - 2] + 1)
            new.append(v)
        old, row = row, new
    return min(row[-1], 3)


def split_name(tokens: list[str]) -> tuple[str, str, str]:
    """(first, middle, last) of a folded name in given order."""
    return (tokens[0] if len(tokens) > 1 else "", " ".join(tokens[1:-1]), tokens[-1]) if tokens else ("", "", "")


def halves(raw: str) -> list[str]:
    """Folded names with one part of a hyphenated surname (the last word) each, as before or after a marriage."""
    *given, last = raw.translate(confusables.plain_table()).split() or [""]
    parts = re.split(r"[-‐‑‒–]", last)
    whole = len(parts) > 1 and all(x[:1].isalpha() and not x[0].islower() for x in parts)
    return [fold(" ".join([*given, x])) for x in parts if len(fold(x)) > 2] if given and whole else []


def page_names(name: str | None, bio: str) -> list[str]:
    """Folded names a page goes by, in the order first to last: its title, a second name in brackets, the opening of its prose."""
    return all_names(name, bio)[0]


def all_names(name: str | None, bio: str) -> tuple[list[str], list[str]]:
    """``page_names``, and beside them the names with a part of a hyphenated surname."""
    out: list[str] = []
    half: list[str] = []

    def add(raw: str) -> None:
        raw = re.sub(r"[\"“”„«»]\S+[\"“”„«»]", " ", raw)
        if "," in raw:
            last, _, first = raw.partition(",")
            raw = f"{first} {last}"
        words = raw.split()
        if len(words) > 1 and words[0].isupper() and len(words[0]) > 2 and not words[-1].isupper():
            words = words[1:] + words[:1]
        f = fold(" ".join(words))
        if f and f not in out:
            out.append(f)
        half.extend(x for x in halves(" ".join(words)) if x not in half)

    title = name or ""
    for inner in re.findall(r"\(([^()]*)\)", title):
        if len(inner.split()) > 1 and inner[:1].isupper():
            add(inner)
    add(re.sub(r"\([^()]*\)", " ", title))
    m = _LEAD.match(bio)
    if m:
        add(m[1])
    return out, [x for x in half if x not in out]


def _keys(names: list[str], year: int | None, titled: bool) -> set[str]:
    out: set[str] = set()
    for n in names:
        t = n.split()
        for i, w in enumerate(t):
            if len(w) < 3 or (titled and i != len(t) - 1):
                continue
            if year:
                out.add(f"{w}|{year}")
            for f in {t[0][0], t[-1][0]} if len(t) > 1 else ():
                if (f == t[0][0] and i > 0) or (f == t[-1][0] and i == 0):
                    out.update(f"{v}|{f}" for v in variants(w))
    return out


def athlete_side(df: DataFrame) -> DataFrame:
    """One row an athlete: (ath_id, name, halved, yob, sport, country, games, keys). Copies count once; NULL ids are left out."""
    one = df.where("ath_id IS NOT NULL").select("ath_id", "name", "country", "sport", "yob", "first_games").dropDuplicates(["ath_id"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for r in p.itertuples(index=False):
                names, halved = all_names(r.name, "")
                y = re.search(r"\b(1[89]\d\d|20[0-3]\d)\b", r.yob or "")
                g = re.search(r"\b(1[89]\d\d|20[0-3]\d)\b", r.first_games or "")
                year = int(y[0]) if y else None
                rows.append((r.ath_id, names[-1] if names else "", halved, year, fold(r.sport), fold(r.country), int(g[0]) if g else None, sorted(_keys(names + halved, year, True))))
            out = pd.DataFrame(rows, columns=["ath_id", "name", "halved", "yob", "sport", "country", "games", "keys"])
            yield out.astype({"yob": "Int32", "games": "Int32"})

    return one.mapInPandas(read, "ath_id long, name string, halved array<string>, yob int, sport string, country string, games int, keys array<string>")


def page_side(df: DataFrame) -> DataFrame:
    """One row a page: (wiki_id, names, halves, year, sports, nations, place, keys); facts come from the prose without its markup."""
    one = df.where("wiki_id IS NOT NULL").select("wiki_id", "name", "wiki_sport", "wiki_birth_place", "wiki_bio").dropDuplicates(["wiki_id"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for r in p.itertuples(index=False):
                lines = (markup.strip(r.wiki_bio) or "").replace("`", "").split("\n")
                bio = " ".join(" ".join(x for x in lines if not x.lstrip().startswith(("#", "- "))).split())
                names, half = all_names(r.name, bio)
                b = _BORN.search(bio)
                year = next((int(x) for x in b.groups() if x), None) if b else None
                is_a, rep = _IS_A.search(bio), _REPRESENTED.search(bio)
                nations, sports = [], []
                if is_a:
                    nations.append("d:" + fold(is_a[1]))
                    sports.append("r:" + fold(is_a[2]))
                elif rep:
                    nations.append("c:" + fold(rep[1]))
                    sports.append("r:" + fold(rep[2]))
                sports += ["s:" + fold(x) for x in re.split(r"[,;/]\s*(?![^()]*\))", markup.strip(r.wiki_sport) or "") if fold(x)]
                place = (markup.strip(r.wiki_birth_place) or "").replace("`", "").split(",")
                rows.append((r.wiki_id, names, half, year, sports, nations, "p:" + fold(place[-1]) if len(place) > 1 else None, sorted(_keys(names + half, year, False))))
            out = pd.DataFrame(rows, columns=["wiki_id", "names", "halves", "year", "sports", "nations", "place", "keys"])
            yield out.astype({"year": "Int32"})

    return one.mapInPandas(read, "wiki_id long, names array<string>, halves array<string>, year int, sports array<string>, nations array<string>, place string, keys array<string>")


def pair_up(athletes: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct (ath_id, wiki_id) that share a blocking key; only hashes and ids are shuffled."""
    a = athletes.select("ath_id", F.explode("keys").alias("k")).select("ath_id", F.xxhash64("k").alias("k"))
    w = pages.select("wiki_id", F.explode("keys").alias("k")).select("wiki_id", F.xxhash64("k").alias("k"))
    return a.join(w, "k").select("ath_id", "wiki_id").distinct()


def associations(sure: DataFrame, phrases: str, value: str) -> DataFrame:
    """(p, v): the values that a phrase stands for, learned from pairs that names and years make sure. A table of any size."""
    each = sure.where(F.col(value) != "").select(F.explode(phrases).alias("p"), F.col(value).alias("v")).groupBy("p", "v").count()
    sums = each.groupBy("p").agg(F.sum("count").alias("n"), F.max("count").alias("top")).where(F.col("top") >= CLEAR * F.col("n"))
    return each.join(sums, "p").where((F.col("count") >= SEEN) & (F.col("count") >= SHARE * F.col("n")) & (F.col("top") >= SEEN)).select("p", "v")


def hear(pages: DataFrame, phrases: str, known: DataFrame, out: str) -> DataFrame:
    """Add ``out``: the values that the phrases of a page stand for; NULL if none of its phrases is known. A phrase has at
    most 1 / SHARE values, so a page's values are bounded by its text."""
    said = pages.select("wiki_id", F.explode(phrases).alias("p")).where("p IS NOT NULL").join(broadcast_if_small(known), "p")
    return pages.join(said.groupBy("wiki_id").agg(F.collect_set("v").alias(out)), "wiki_id", "left")


def _heard(values, value: str | None) -> int:
    return 0 if not value or values is None else 1 if value in values else -1


def name_votes(a: str, names: list[str], halved: list[str] = (), half: list[str] = ()) -> tuple[int, int, int]:
    """(last, first, middle) of the names that fit best; a missing part doesn't vote, an initial fits. ``halved`` and ``half``
    are the names with a part of the athlete's or the page's surname; they are held against whole names only."""
    best = (-1, -1, -1)
    for a, n in [*((a, n) for n in [*names, *half]), *((x, n) for x in halved for n in names)]:
        first, middle, last = split_name(a.split())
        t = n.split()
        for order in (t, t[1:] + t[:1]) if len(t) > 1 else (t,):
            f, m, s = split_name(order)
            d = near(last, s)
            vl = 1 if d == 0 else 0 if d == 1 or (d == 2 and len(last) > 7) else -1
            if not f or not first:
                vf = 0
            elif len(f) == 1 or len(first) == 1:
                vf = 0 if f[0] == first[0] else -1
            else:
                vf = 1 if near(first, f) <= (1 if len(first) > 4 else 0) else -1
            vm = 0 if not m or not middle else 1 if m[0] == middle[0] else -1
            best = max(best, (vl, vf, vm), key=lambda v: (v[0] + v[1] if min(v[:2]) >= 0 else -3 + v[0] + v[1], v))
    return best


def vote(pairs: DataFrame, athletes: DataFrame, pages: DataFrame) -> DataFrame:
    """(ath_id, wiki_id, votes ARRAY<INT>) in the order of VOTERS; pages with what was heard of sports, nations and places."""
    rows = pairs.join(athletes.drop("keys"), "ath_id").join(pages.select("wiki_id", "names", "halves", "year", "heard_sports", "heard_nations", "heard_places"), "wiki_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                year, yob = (None if pd.isna(x) else int(x) for x in (r.year, r.yob))
                games = None if pd.isna(r.games) else int(r.games)
                career = 0 if year is None or games is None else 1 if 12 <= games - year <= 45 else -1
                out.append((r.ath_id, r.wiki_id, [*name_votes(r.name, list(r.names), list(r.halved), list(r.halves)), 0 if year is None or yob is None else 1 if year == yob else -1, _heard(r.heard_sports, r.sport), _heard(r.heard_nations, r.country), _heard(r.heard_places, r.country), career]))
            yield pd.DataFrame(out, columns=["ath_id", "wiki_id", "votes"])

    return rows.mapInPandas(read, "ath_id long, wiki_id long, votes array<int>")


class LabelModel:
    """Generative model of vote patterns: a class prior, and for each group of functions the chance of its joint vote
    given match and no match. Groups hold one function, or two whose votes depend on each other within the classes."""

    def __init__(self, patterns: dict[tuple[int, ...], float], joint: int = 3, steps: int = 60):
        self.k = len(VOTERS)
        self.groups: list[tuple[int, ...]] = [(i,) for i in range(self.k)]
        self.votes = np.array(sorted(patterns), dtype=int).reshape(-1, self.k)
        self.count = np.array([patterns[tuple(v)] for v in self.votes.tolist()], dtype=float)
        weight = np.array([2.0, 2.0, 1.0, 3.0, 1.5, 1.0, 0.5, 0.5])
        self.post = 1 / (1 + np.exp(-(self.votes @ weight - 3.5)))
        self._em(steps)
        for a, b in self._dependent()[:joint]:
            if (a,) in self.groups and (b,) in self.groups:
                self.groups = [g for g in self.groups if g not in ((a,), (b,))] + [(a, b)]
        self._em(steps)

    def _code(self, v: np.ndarray, g: tuple[int, ...]) -> np.ndarray:
        return sum((v[:, i] + 1) * 3**j for j, i in enumerate(g))

    def _fit(self) -> None:
        self.prior = float((self.count * self.post).sum() / max(self.count.sum(), 1e-9))
        self.tables = []
        for g in self.groups:
            code, size = self._code(self.votes, g), 3 ** len(g)
            t = [np.bincount(code, self.count * p, size) + 0.5 / size for p in (1 - self.post, self.post)]
            self.tables.append([np.log(x / x.sum()) for x in t])

    def posterior(self, v: np.ndarray) -> np.ndarray:
        odds = np.log(max(self.prior, 1e-9)) - np.log(max(1 - self.prior, 1e-9)) + np.zeros(len(v))
        for g, (no, yes) in zip(self.groups, self.tables):
            c = self._code(v, g)
            odds += yes[c] - no[c]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def _em(self, steps: int) -> None:
        self._fit()
        for _ in range(steps if len(self.votes) else 0):
            old = self.post
            self.post = self.posterior(self.votes)
            self._fit()
            if np.abs(self.post - old).max() < 1e-6:
                break

    def _dependent(self) -> list[tuple[int, int]]:
        """Pairs of functions by their mutual information within the classes, the most dependent first."""
        found = []
        for a, b in itertools.combinations(range(self.k), 2):
            info = 0.0
            for p in (self.post, 1 - self.post):
                t = np.bincount(self._code(self.votes, (a, b)), self.count * p, 9).reshape(3, 3) + 1e-9
                t /= t.sum()
                info += float((t * np.log(t / (t.sum(0) * t.sum(1)[:, None]))).sum() * (self.count * p).sum())
            found.append((info / max(self.count.sum(), 1e-9), (a, b)))
        return [pair for info, pair in sorted(found, reverse=True) if info > 0.002]


def _classes(side: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Distinct descriptions (all columns but ``key``, blocking keys included) under their smallest ``key``, and the
    membership: (that key, key). Candidates and votes are made between descriptions, so that copies under other ids add no
    pairs before the result."""
    rest = [c for c in side.columns if c != key]
    number = "__" + key[0]
    side = materialize(side.withColumn("__h", F.md5(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}))))
    one = materialize(side.groupBy("__h").agg(F.min(key).alias(key), *[F.first(c).alias(c) for c in rest]))
    return one.drop("__h"), side.select("__h", key).join(one.select("__h", F.col(key).alias(number)), "__h").drop("__h")


def link(athletes: DataFrame, wiki: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(ath_id, wiki_id, confidence): pairs judged to be one person, their posterior at least ``threshold``.

    A page has one person: of several athletes above the threshold the most likely one stays, and all that are equally
    likely if they can't be told apart. An athlete may have several pages or none. NULL and empty names never match on
    the name; empty tables give no rows; equal descriptions under several ids are one candidate until the result. Only vote patterns (at most 3^8) reach the driver."""
    a, of_a = _classes(athlete_side(athletes), "ath_id")
    w, of_w = _classes(page_side(wiki), "wiki_id")
    pairs = materialize(pair_up(a, w))
    full = pairs.join(a, "ath_id").join(w.drop("keys"), "wiki_id").where(F.array_contains("names", F.col("name")) & F.col("name").contains(" "))
    sure = materialize(full.where("yob = year").select("sport", "country", "sports", "nations", F.array("place").alias("places")))
    told = hear(hear(w, "sports", associations(sure, "sports", "sport"), "heard_sports"), "nations", associations(sure, "nations", "country"), "heard_nations")
    told = hear(told.withColumn("places", F.array("place")), "places", associations(sure, "places", "country"), "heard_places")
    votes = materialize(vote(pairs, a, told))
    patterns = {tuple(r["votes"]): float(r["count"]) for r in votes.groupBy("votes").count().collect()}
    model = LabelModel(patterns)

    @F.pandas_udf("double")
    def posterior(v: pd.Series) -> pd.Series:
        return pd.Series(model.posterior(np.stack(v.to_numpy()).astype(int)) if len(v) else np.zeros(0))

    scored = votes.withColumn("confidence", F.round(posterior("votes"), 6)).where(F.col("confidence") >= threshold)
    best = Window.partitionBy("wiki_id")
    kept = scored.withColumn("__b", F.max("confidence").over(best)).where("confidence = __b")
    named = kept.select(F.col("ath_id").alias("__a"), F.col("wiki_id").alias("__w"), "confidence")
    return named.join(of_a, "__a").join(of_w, "__w").select("ath_id", "wiki_id", "confidence")
