"""Extraction from HTML and wiki text as Column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Attribute -> marker of the element that shows it.
ATTRIBUTES = {"name": "display-name", "noc": "nocs", "sport": "disciplines", "participations": "games-participations", "first_games": "first-olympic-game", "yob": "year-of-birth"}
#: How the element of a marker shows its text, the first form that is there.
SHOWN_BY = (r"<div[^>]*data-cy=['\"]{marker}['\"][^>]*>.*?<(?:h1|span)[^>]*>(.*?)</(?:h1|span)>", r"<span[^>]*data-cy=['\"]{marker}['\"][^>]*>(.*?)</span>")
SHOWN_BY_STRICT = r"(?is)<div[^>]*\bdata-cy\s*=\s*['\"]{marker}['\"][^>]*>.*?<(h1|span)[^>]*>(.*?)</\1>.*?</div>|<span[^>]*\bdata-cy\s*=\s*['\"]{marker}['\"][^>]*>(.*?)</span>"
#: Medal modules of a page, their colour and count, and the older form of both.
MEDAL_MODULE, MEDAL_COLOUR, MEDAL_COUNT = r"(?is)<div[^>]*data-cy=[\"']medal-module[\"'][^>]*>.*?</div>", r"title=[\"'](Gold|Silver|Bronze)[\"']", r"data-cy=[\"']ocs-text-module[\"'][^>]*>(\d+)</"
MEDAL_STRICT = r"(?i)<div[^>]*data-cy=[\"']medal-module[\"'][^>]*title=[\"'](Gold|Silver|Bronze)[\"'][\s\S]*?<span[^>]*data-cy=[\"']medal-main[\"'][^>]*>[\s\S]*?>(\d+)<"
#: Marked blocks, the main element, paragraphs, anchors.
BLOCK = r"(?is)<(div|section)(?=[^>]*data-cy=[\"'](?:text-block-container|second-block)[\"'])[^>]*>(.*?)</\1>"
MAIN, PARAGRAPH, ANCHOR = r"(?is)<main[^>]*>(.*?)</main>", r"(?is)<p[^>]*>(.*?)</p>", r"(?is)<a\b[^>]*?\bhref\s*=\s*(['\"])(.*?)\1"
#: Elements without text, medal colours.
JUNK_TAGS = ("script", "style", "noscript", "template", "svg", "picture", "source")
MEDALS = ("Gold", "Silver", "Bronze")


def plain(c: Column) -> Column:
    """Tags to spaces, white space one. Entities stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def plain_unescaped(c: Column) -> Column:
    """``plain`` with entities, named and numeric, as characters; NBSP is white space."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, r"<[^>]+>", " ")), r"[\s\u00a0]+", " "))


def unescaped(c: Column) -> Column:
    """HTML entities as characters. Only texts with an ampersand go through Python."""

    @F.pandas_udf("string")
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return F.coalesce(unescape(F.when(c.contains("&"), c)), c)


def without_junk(c: Column, word_end: bool = False) -> Column:
    """Elements that hold no text to spaces. ``word_end``: their names must end there."""
    end = r"\b" if word_end else ""
    return F.regexp_replace(c, rf"(?is)<({'|'.join(JUNK_TAGS)}){end}[^>]*>.*?</\1>", " ")


def attribute(html: Column, marker: str) -> Column:
    """Text of the element with a ``data-cy`` marker: its first heading or span if a div, itself if a span; NULL if empty."""
    forms = [F.regexp_extract(html, "(?is)" + f.format(marker=re.escape(marker)), 1) for f in SHOWN_BY]
    found = F.coalesce(*[F.when(f != "", f) for f in forms], F.lit(""))
    return F.nullif(plain(found), F.lit(""))


def attribute_strict(html: Column, marker: str) -> Column:
    """The older reading: whichever form comes first, spaces around the equals sign allowed, the heading's own closing
    tag and a closing div required; '' if missing."""
    both = SHOWN_BY_STRICT.replace("{marker}", re.escape(marker))
    shown = [F.regexp_extract(html, both, i) for i in (2, 3)]
    return F.coalesce(plain_unescaped(F.concat(*shown)), F.lit(""))  # one form matches at a time


def medal_counts(html: Column) -> dict[str, Column]:
    """Medals by colour, summed over the page's medal modules; a module without digits makes its colour NULL."""
    modules = F.regexp_extract_all(html, F.lit(MEDAL_MODULE), F.lit(0))

    def total(colour: str) -> Column:
        own = F.filter(modules, lambda m: F.regexp_extract(m, MEDAL_COLOUR, 1) == colour)
        count = F.transform(own, lambda m: F.regexp_extract(m, MEDAL_COUNT, 1).try_cast("int"))
        return F.aggregate(count, F.lit(0), lambda a, n: a + n)

    return {m.lower(): total(m) for m in MEDALS}


def medal_counts_strict(html: Column) -> dict[str, Column]:
    """The older reading: the count stands in a medal-main span after the module; colours in any case; 0 if missing."""
    pairs = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(MEDAL_STRICT), F.lit(i)).alias(k) for i, k in ((1, "c"), (2, "n"))])
    return {m.lower(): F.coalesce(F.aggregate(F.filter(pairs, lambda p: F.lower(p["c"]) == m.lower()), F.lit(0), lambda a, p: a + p["n"].cast("int")), F.lit(0)) for m in MEDALS}


def text_blocks(html: Column, minlen: int = 30) -> Column:
    """Texts of the marked blocks of at least ``minlen`` characters, in page order."""
    return F.filter(F.transform(F.regexp_extract_all(html, F.lit(BLOCK), F.lit(2)), plain), lambda b: F.length(b) >= minlen)


def main_text(html: Column) -> Column:
    return plain(F.regexp_extract(html, MAIN, 1))


def paragraphs(html: Column) -> Column:
    """Paragraph texts joined by line breaks; whatever begins like <p opens one."""
    return F.array_join(F.transform(_paragraphs(html), plain), "\n")


def paragraphs_strict(html: Column) -> Column:
    """The older reading: paragraphs are joined before they are cleaned, so that white space between them is one blank."""
    return plain_unescaped(F.array_join(_paragraphs(html), " \n "))


def _paragraphs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1))


def article_text(blocks: Column, main: Column, paras: Column, minlen: int = 30) -> Column:
    """Blocks if there are any, else the main element, else the paragraphs, each of at least ``minlen``; else ''."""
    whole = [F.when(F.length(c) >= minlen, c) for c in (main, paras)]
    return F.coalesce(F.when(F.size(blocks) > 0, F.array_join(blocks, "\n\n")), *whole, F.lit(""))


def links(html: Column) -> Column:
    """Quoted href values of anchors, in page order."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2))


# Wiki text

#: Title prefixes of pages that are no articles; infobox lines; what shows a person of sports.
NAMESPACES = r"^(Category|List|Template|Module|Portal|Draft|Help|Wikipedia):"
INFOBOX = {"wiki_sport": "(?:sport|sports|event|discipline)", "wiki_birth_place": "(?:birth_place|birthplace)", "wiki_position": "(?:position|positions)", "wiki_club": "[a-z_ ]*clubs?", "wiki_height": "(?:height|height_cm|height_m)"}


PERSON = (r"(?mi)^\|\s*(birth_place|birth_date)\s*=", r"(?i)(sport|sports|event|discipline|team|club|position)\s*=")
#: What an infobox value, and the text of a biography, lose, in this order.
VALUE_STEPS = (
    (r"(?s)<ref[^>]*>.*?</ref>", " "), (r"(?i)<ref[^/>]*>", " "), (r"(?i)<ref[^/>]*/>", " "), (r"(?s)\{\{.*?\}\}", " "), (r"\{\{.*", " "),
    (r"\[\[[^|\]]*\|([^\]]+)\]\]", "$1"), (r"\[\[([^\]]+)\]\]", "$1"), (r"&[a-z]+;", " "), ("[•]", " "), (r"\s+", " "),
)
BIOGRAPHY_STEPS = (
    (r"(?s)\{\{Infobox[^}]*\}\}", " "), (r"(?m)^\|.*$", " "), (r"<ref[^>]*>.*?</ref>", " "), (r"<ref[^/>]*/>", " "), (r"(?i)<small[^>]*>.*?</small>", " "),
    (r"(?i)</?small[^>]*>", " "), (r"(?s)\{\{.*?\}\}", " "), (r"<!--.*?-->", " "), (r"&[a-z]+;", " "), (r"(?m)^\s*={1,6}\s*[^=]+?\s*={1,6}\s*$", " "),
    (r"\[\[([^|\]]+)\|([^\]]+)\]\]", "$2"), (r"\[\[([^\]]+)\]\]", "$1"), (r"[{}'\"|]+", " "), (r"\s+", " "),
)
#: Fixed value: two capitalised words and what follows up to the fourth sentence end.
BIOGRAPHY = r"(?s)[A-ZÁ-Ž][a-zá-ž]+ [A-ZÁ-Ž][a-zá-ž]+.*?[.!?](?:\s*.*?[.!?]){3}"


def infobox_head(text: Column, chars: int = 3000) -> Column:
    """The opening of a page, one-line comments gone, breaks as line ends."""
    c = F.regexp_replace(F.substring(text, 1, chars), r"<!--.*?-->", " ")
    return F.replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " \n "), F.lit("&nbsp;"), F.lit(" "))


def is_candidate(head: Column) -> Column:
    return head.rlike(PERSON[0]) | head.rlike(PERSON[1])


def _cleaned(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    return F.trim(reduce(lambda x, step: F.regexp_replace(x, *step), steps, c))


def wiki_value(c: Column) -> Column:
    """An infobox value as plain text; the order of the steps matters."""
    return _cleaned(c, VALUE_STEPS)


def infobox_value(head: Column, names: str) -> Column:
    """Value of the first infobox line of one of these names, up to a pipe or line end, cleaned; '' if there is none."""
    return wiki_value(F.regexp_extract(head, rf"(?im)^\|\s*{names}\s*=\s*(?!\s*$)([^\|\n]+)", 1))


def biography(text: Column) -> Column:
    """From the first pair of capitalised words to the fourth sentence end of the cleaned text; '' if it has fewer."""
    return F.regexp_extract(_cleaned(text, BIOGRAPHY_STEPS), BIOGRAPHY, 0)


def title_name(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"\s*\(.*?\)$", ""))
