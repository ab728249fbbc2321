"""Text functions as Column expressions: folding, keys, tokens, trimming. All return NULL for NULL."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that an index leaves out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()
#: Letters of name keys and the plain letters they become.
KEY_FROM = "áäàâãåçčďéěèêëíìîïñńňóôöòõřŕśšťúůüùûýÿžÁÄÀÂÃÅÇČĎÉĚÈÊËÍÌÎÏÑŃŇÓÔÖÒÕŘŔŚŠŤÚŮÜÙÛÝŸŽłĺľŁĹĽ"
KEY_TO = "aaaaaaccdeeeeeiiiinnnooooorrsstuuuuuyyzAAAAAACCDEEEEEIIIINNNOOOOORRSSTUUUUUYYZlllLLL"
WORD = r"[\p{L}\p{N}_]+"
#: Words as a standard analyser finds them: letters and digits, joined by an apostrophe, dot or digit separator inside.
STANDARD_WORD = r"[\p{L}\p{M}\p{Nd}_]+(?:(?:['’.·][\p{L}]|[.,;'][\p{Nd}])[\p{L}\p{M}\p{Nd}_]*)*"


@lru_cache(maxsize=1)
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to, longer): single characters for ``translate`` and Latin ones that fold to several characters.

    Built by rule: case folding, then compatibility decomposition without combining marks, over the BMP."""
    one, gone, longer = [], [], []
    for cp in range(0x80, min(0xFFFF, sys.maxunicode) + 1):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        c = chr(cp)
        f = fold_text(c)
        if f == c:
            continue
        if len(f) == 1:
            one.append((c, f))
        elif not f:
            gone.append(c)
        elif cp < 0x250 or 0xFB00 <= cp <= 0xFB06 or cp == 0x1E9E:
            longer.append((c, f))
    return "".join(c for c, _ in one) + "".join(gone), "".join(f for _, f in one), tuple(longer)


def fold_text(s: str | None) -> str:
    """The folding of ``fold`` for a driver-side string, such as a query."""
    return "".join(c for c in unicodedata.normalize("NFKD", (s or "").casefold()) if not unicodedata.combining(c))


def fold(c: Column) -> Column:
    """Case and accents removed (casefold, compatibility decomposition, no combining marks), inside the JVM. Scripts
    whose characters decompose into several, such as Hangul, keep them; ``fold_exact`` covers those."""
    src, dst, longer = fold_tables()
    low = F.lower(c)
    many = low
    for a, b in longer:
        many = F.replace(many, F.lit(a), F.lit(b))
    few = "[" + "".join(a for a, _ in longer) + "]"
    return F.translate(F.when(low.rlike(few), many).otherwise(low), src, dst)


def fold_exact(c: Column) -> Column:
    """``fold_text`` for every character there is, through an Arrow UDF; off the main path."""

    @F.pandas_udf("string")
    def exact(s: pd.Series) -> pd.Series:
        return s.map(fold_text, na_action="ignore")

    return exact(c)


def name_key(c: Column, collapse_ws: bool = False) -> Column:
    """Entity key: plain letters, lower case, bracketed parts gone, other characters but backslashes to single spaces each,
    a backslash with the letters s after it to one. White space isn't made one unless ``collapse_ws``."""
    c = F.lower(F.trim(F.translate(c, KEY_FROM, KEY_TO)))
    c = F.regexp_replace(c, r"\s*\([^(]*\)\s*", " ")
    c = F.regexp_replace(c, r"\s*\[[^]]*\]\s*", " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9\\]", " "), r"\\s+", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " ") if collapse_ws else c)


def text_key(c: Column) -> Column:
    """Text key: as ``name_key``, but the shortest bracketed parts go, brackets of either kind, and white space is one."""
    c = F.lower(F.trim(F.translate(c, KEY_FROM, KEY_TO)))
    c = F.regexp_replace(c, r"\s*[\(\[].*?[\)\]]\s*", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^a-z0-9\s]", " "), r"\s+", " "))


def query_tokens(c: Column) -> Column:
    """Folded words, nothing left out."""
    return F.regexp_extract_all(fold(c), F.lit(WORD), F.lit(0))


def index_tokens(c: Column) -> Column:
    """Folded words but stop words, numbers and single characters."""
    return F.filter(query_tokens(c), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS) & ~t.rlike(r"^\p{N}+$"))


def standard_words(s: str) -> list[str]:
    """The words of ``standard_tokens`` for a driver-side string, such as a query."""
    return regex.findall(STANDARD_WORD, s.lower())


def standard_tokens(c: Column) -> Column:
    """Lower-cased words of a standard analyser; accents stay."""
    return F.regexp_extract_all(F.lower(c), F.lit(STANDARD_WORD), F.lit(0))


def strip(c: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def path_norm(c: Column) -> Column:
    """Forward slashes, without leading dots and slashes."""
    return F.ltrim(F.translate(strip(c), "\\", "/"), F.lit("./"))


def contains_folded(c: Column, query: str) -> Column:
    return F.contains(fold(F.coalesce(c, F.lit(""))), F.lit(fold_text(query)))
