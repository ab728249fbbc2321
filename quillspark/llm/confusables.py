"""Visually identical text with different characters: one form for all text.

Look-alike classes are built by union-find over strings and code points (compatibility forms, composed and loose
accents, spaces, hyphens, letters of other scripts); a class is represented by its most frequent member in the
collection; text is rewritten greedily, longest match first, by a multi-pattern automaton.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the Cyrillic, Greek, Armenian and Cherokee blocks whose printed form is that of a Latin letter, read off
#: the code charts. Their accented forms, and the classes of all other code points, follow by rule (``classes``).
LOOK_ALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СᏟ", "E": "ЕΕᎬ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аα", "c": "с", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ",
    "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү",
}
#: Hyphens.
HYPHENS = "‐‑‒–—−﹣－⁃֊᠆"
_INVISIBLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}\u17B4\u17B5\uFFA0]")


class UnionFind:
    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.up:
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values() if len(v) > 1]


def letter_script(c: str) -> str:
    """The script of a letter by its Unicode name; '' for what is no letter."""
    return unicodedata.name(c, "").split(" ")[0].split("-")[0] if c.isalpha() else ""


@lru_cache(maxsize=2)
def classes(look_alikes: bool = True) -> tuple[tuple[str, ...], ...]:
    """All look-alike classes; '' is the member that stands for nothing at all. Hangul syllables are left to the
    composition at the end of the rewriting, which has a rule for all of them."""
    u = UnionFind()
    latin_of = {c: latin for latin, others in LOOK_ALIKES.items() for c in others} if look_alikes else {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        kind = unicodedata.category(c)
        if kind in ("Cs", "Co", "Cn") or 0xAC00 <= cp <= 0xD7A3:
            continue
        if kind == "Zs":
            u.join(c, " ")
            continue
        if _INVISIBLE.fullmatch(c):
            u.join(c, "")
            continue
        flat = unicodedata.normalize("NFKC", c)
        if flat != c and flat and " " not in flat and c not in HYPHENS:
            u.join(c, flat)
        loose = unicodedata.normalize("NFD", c)
        if loose != c and unicodedata.normalize("NFC", loose) == c:
            u.join(loose, c)
            if loose[0] in latin_of and len(same := unicodedata.normalize("NFC", latin_of[loose[0]] + loose[1:])) == 1:
                u.join(c, same)
    for c in HYPHENS:
        u.join(c, "-")
    for c, latin in latin_of.items():
        u.join(c, latin)
    return tuple(tuple(x) for x in u.classes())


def _settled(member: str) -> bool:
    """Whether a member is in composed form and no compatibility form."""
    return unicodedata.normalize("NFKC", member) == member


def representatives(counts: dict[str, int], look_alikes: bool = True) -> dict[str, str]:
    """Member -> representative: the most frequent member; plain ASCII, then the shorter and smaller member if equal.

    Invisible members stand for nothing. Compatibility forms and loose accents never represent a class, however often they
    occur, and a class with a Latin letter is represented by a Latin one, since it is used in Latin words only; so every
    class of several strings has one that can represent it, and ``counts`` decides between code points."""
    out = {}
    for group in classes(look_alikes):
        able = [m for m in group if _settled(m)] or list(group)
        able = [m for m in able if len(m) == 1 and letter_script(m) == "LATIN"] or able
        best = "" if "" in group else min(able, key=lambda m: (-counts.get(m, 0), not m.isascii(), len(m), m))
        out.update({m: best for m in group if m != best})
    return out


@lru_cache(maxsize=1)
def plain_table() -> dict[int, str]:
    """Single code points to their plain form, whatever stands beside them."""
    return {ord(m): r for m, r in representatives({}).items() if len(m) == 1}


def count_members(texts: DataFrame, column: str) -> dict[str, int]:
    """How often each code point occurs in a text column, over all rows. At most one entry a code point comes to the
    driver (Unicode bounds it)."""
    chars = texts.select(F.explode(F.split(F.col(column), "")).alias("c")).where("c != ''").groupBy("c").count()
    return {r["c"]: r["count"] for r in chars.collect()}


class Rewriter:
    """Greedy leftmost-longest rewriting by an Aho-Corasick automaton over all class members."""

    def __init__(self, counts: dict[str, int]):
        import ahocorasick

        self.rep = representatives(counts)
        self.plain = representatives(counts, look_alikes=False)
        self.alike = {m for m, r in self.rep.items() if self.plain.get(m, m) != r}  # rewritten for their looks only
        self.auto = ahocorasick.Automaton()
        for m, r in self.rep.items():
            self.auto.add_word(m, (m, r))
        self.plain_ascii = not any(m.isascii() for m in self.rep)  # then ASCII texts hold no member to rewrite
        self.auto.make_automaton()

    @staticmethod
    def _segments(text: str) -> list[str]:
        out, start = [], 0
        for i, c in enumerate(text):
            if c in "()[]{}（）":
                out += [text[start:i], c]
                start = i + 1
        return [*out, text[start:]]

    def _one(self, segment: str) -> str:
        """Letters of other scripts are replaced only beside real Latin letters, and only where every letter of their
        word looks like a Latin one or the word itself mixes scripts."""
        latin = any(letter_script(c) in ("LATIN", "FULLWIDTH") for c in segment)
        foreign: set[int] = set()
        if latin:
            at = 0
            for word in segment.split(" "):
                if any(letter_script(c) == "LATIN" for c in word) or all(c in self.alike or not c.isalpha() for c in word):
                    foreign.update(range(at, at + len(word)))
                at += len(word) + 1
        out, end = [], 0
        for last, (member, rep) in self.auto.iter_long(segment):
            start = last - len(member) + 1
            out.append(segment[end:start])
            if member in self.alike and start not in foreign:
                rep = self.plain.get(member, member)
            out.append(rep)
            end = last + 1
        out.append(segment[end:])
        return "".join(out)

    def __call__(self, text: str | None) -> str | None:
        if text is None or self.plain_ascii and text.isascii():
            return text
        while (new := "".join(map(self._one, self._segments(text)))) != text:  # a rewritten string may complete another member, as a letter and its accent after an invisible one
            text = new
        return unicodedata.normalize("NFC", text)


def unify(df: DataFrame, column: str, out: str, counts: dict[str, int] | None = None) -> DataFrame:
    """Add ``out``: ``column`` in one form. NULL stays NULL, empty stays empty, texts of any length are rewritten whole,
    an existing column ``out`` is replaced, other columns stay. ``counts``: of ``count_members``; counted here if not given."""
    counts = count_members(df, column) if counts is None else counts
    kept = {}

    @F.pandas_udf("string")
    def rewrite(texts: pd.Series) -> pd.Series:
        if "r" not in kept:
            kept["r"] = Rewriter(counts)
        return texts.map(kept["r"], na_action="ignore")

    return df.withColumn(out, rewrite(F.col(column)))


def odd_names(df: DataFrame, column: str, counts: dict[str, int] | None = None) -> DataFrame:
    """Rows whose text changes when brought to one form, with the new form in ``unified``."""
    return unify(df, column, "unified", counts).where(~F.col("unified").eqNullSafe(F.col(column)))
