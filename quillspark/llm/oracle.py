"""SQL for DuckDB of the queries of this subpackage that SQL can state. Nothing is imported from the operators."""

from __future__ import annotations

import unicodedata

from quillspark.plans import oracle as core

#: Foreign letters and the Latin letters they print like; hyphens.
LOOK_ALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СᏟ", "E": "ЕΕᎬ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аα", "c": "с", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ",
    "u": "υս", "v": "νѵ", "w": "ԝω", "x": "хχ", "y": "уγү",
}
HYPHENS = "‐‑‒–—−﹣－⁃֊᠆"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _look_alikes() -> tuple[str, str]:
    """Foreign letters, plain and accented, and the Latin letters in their place."""
    to = {c: latin for latin, cs in LOOK_ALIKES.items() for c in cs}
    for c in map(chr, range(0x370, 0x2000)):
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and d[0] in to and unicodedata.normalize("NFC", d) == c and len(same := unicodedata.normalize("NFC", to[d[0]] + d[1:])) == 1:
            to[c] = same
    return "".join(to), "".join(to.values())


def _one_form(x: str) -> str:
    """Compatibility forms, spaces, hyphens and characters without a width in their plain form, composed."""
    single, several = {}, []
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]):
        flat = unicodedata.normalize("NFKC", c)
        if unicodedata.category(c) == "Zs":
            single[c] = " "
        elif c in HYPHENS:
            single[c] = "-"
        elif flat != c and " " not in flat and unicodedata.category(c) not in ("Cn", "Cs", "Co"):
            if len(flat) == 1:
                single[c] = flat
            elif flat:
                several.append((c, flat))
    x = f"regexp_replace({x}, '[\\x{{AD}}\\x{{34F}}\\x{{61C}}\\x{{115F}}\\x{{1160}}\\x{{17B4}}\\x{{17B5}}\\x{{180B}}-\\x{{180F}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{206F}}\\x{{3164}}\\x{{FE00}}-\\x{{FE0F}}\\x{{FEFF}}\\x{{FFA0}}\\x{{E0000}}-\\x{{E0FFF}}]', '', 'g')"
    rare = "".join(c for c, _ in several)
    known = "MAP {" + ", ".join(f"{q(c)}: {q(flat)}" for c, flat in several) + "}"
    long = f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce({known}[c], c)), '')"
    return f"nfc_normalize(translate(CASE WHEN regexp_matches({x}, {q('[' + rare + ']')}) THEN {long} ELSE {x} END, {q(''.join(single))}, {q(''.join(single.values()))}))"


def unified(x: str) -> str:
    """``x`` in one form. Foreign letters are replaced in a part between brackets that has Latin letters too, in words that
    mix scripts or have no other letters than those that print like Latin ones."""
    src, dst = _look_alikes()
    only = f"NOT regexp_matches(regexp_replace(w, {q('[' + src + ']')}, '', 'g'), '\\p{{L}}')"
    words = f"array_to_string(list_transform(string_split(s, ' '), lambda w: CASE WHEN regexp_matches(w, '\\p{{Latin}}') OR {only} THEN translate(w, {q(src)}, {q(dst)}) ELSE w END), ' ')"
    parts = "regexp_extract_all(y, '[()\\[\\]{}]|[^()\\[\\]{}]+')"
    return f"(SELECT CASE WHEN y IS NULL THEN NULL ELSE nfc_normalize(array_to_string(list_transform({parts}, lambda s: CASE WHEN regexp_matches(s, '\\p{{Latin}}') THEN {words} ELSE s END), '')) END FROM (SELECT {_one_form(x)} AS y))"


_NAMES = "names AS (SELECT 'athletes' AS tbl, ath_id AS row_id, name FROM athletes UNION ALL SELECT 'wiki_df', wiki_id, name FROM wiki_df), u AS (SELECT DISTINCT tbl, row_id, name, replace(" + unified("name") + ", 'ɡ', 'g') AS unified FROM (SELECT DISTINCT * FROM names))"
#: Names of two or more entities, and the pages of their rows that state a height.
_HEIGHTS = f"""e AS (SELECT trim(regexp_replace(name_norm, '[\\s ]+', ' ', 'g')) AS name_norm, entity_id, wiki_id, wiki_height, coalesce(len(lookup_urls), -1) AS trust FROM final_entities),
  g AS (SELECT name_norm FROM e WHERE name_norm <> '' GROUP BY 1 HAVING count(DISTINCT entity_id) > 1), r AS (SELECT wiki_id, max(revised_at) AS revised FROM wiki_df GROUP BY 1),
  s AS (SELECT name_norm, wiki_id, trust, revised FROM e JOIN g USING (name_norm) LEFT JOIN r USING (wiki_id) WHERE wiki_id IS NOT NULL AND {core.height_cm('wiki_height')} BETWEEN 120 AND 230)"""
_POSTINGS = """
  WITH rows AS (SELECT DISTINCT segment, term, unnest(map_entries(postings)) AS e FROM index_terms WHERE term IS NOT NULL),
  p AS (SELECT term, e.key AS doc_id, max(e.value) AS tf FROM rows WHERE e.value > 0 GROUP BY 1, 2),
  t AS (SELECT term, count(*) AS df, sum(tf) AS w FROM p GROUP BY 1), d AS (SELECT doc_id, sum(tf) AS n FROM p GROUP BY 1),
  g AS (SELECT count(*) AS n_docs, sum(n) AS total FROM d)"""

SQL = {
    "p3_found": f"WITH {_NAMES} SELECT DISTINCT tbl, row_id FROM u WHERE unified <> name",
    "p3_unified": f"WITH {_NAMES} SELECT DISTINCT tbl, row_id, unified FROM u",
    "p4_lines": "SELECT DISTINCT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines FROM lookups WHERE text IS NOT NULL",
    "p5_heights": f"WITH {_HEIGHTS} SELECT name_norm, wiki_id FROM s QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY revised DESC NULLS LAST, trust DESC, wiki_id) = 1",
    "p8_faults": "SELECT count(DISTINCT doc_id) AS items, 0::BIGINT AS torn, 0::BIGINT AS lost, 0::BIGINT AS overfull FROM documents",
    "p7_found": _POSTINGS + """,
  s AS (SELECT doc_id, term, tf * ln(n_docs::DOUBLE / df) AS w FROM p JOIN t USING (term), g)
  SELECT doc_id, term FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) = 1""",
    "p7_top_z": _POSTINGS + """,
  x AS (SELECT doc_id, term, tf, w, n, total, 500.0::DOUBLE * w / total AS a FROM p JOIN t USING (term) JOIN d USING (doc_id), g),
  s AS (SELECT doc_id, term,
    round((ln((tf + a) / (n + 500.0::DOUBLE - tf - a)) - ln((w - tf + a) / (total - n + 500.0::DOUBLE - w + tf - a))) / sqrt(1 / (tf + a) + 1 / (w - tf + a)), 9) AS z FROM x)
  SELECT doc_id, term FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, term) = 1""",
    "p7_scores": _POSTINGS + """,
  x AS (SELECT doc_id, term, tf, df, n_docs, w, n, total, 500.0::DOUBLE * w / total AS a FROM p JOIN t USING (term) JOIN d USING (doc_id), g)
  SELECT doc_id, term, tf, df, n_docs, round(tf * ln(n_docs::DOUBLE / df), 4) AS weight,
    round((ln((tf + a) / (n + 500.0::DOUBLE - tf - a)) - ln((w - tf + a) / (total - n + 500.0::DOUBLE - w + tf - a))) / sqrt(1 / (tf + a) + 1 / (w - tf + a)), 4) AS z FROM x""",
}
