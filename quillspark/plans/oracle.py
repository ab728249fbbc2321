"""SQL for DuckDB that states what the driver queries of the core return.

Nothing is imported from the engine: word lists, patterns and what a query string means are stated here once more."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: What the query texts of the catalog ask for.
TEXT_QUERY = {"injury": 1, "night": 1, "train": 1, "protest": 2, "final": 1}
ATTRIBUTE_QUERIES: dict[str, tuple[dict[str, str], list[tuple[str, str, int]]]] = {
    "attr_search_country": ({"country": "great britain"}, [("gold", ">=", 1)]), "attr_search_sport": ({"sport": "rowing"}, [("silver", ">", 0), ("bronze", "<", 3)]), "attr_search_name": ({"name": "maria"}, []),
    "attr_search_medals": ({}, [("gold", ">=", 1), ("silver", "=", 1), ("bronze", "<=", 2)]), "attr_search_mixed": ({"sport": "judo", "country": "chile", "name": "anna"}, []),
}
#: Words with how often they are asked, whole phrases, closed ranges.
FIELD_QUERIES: dict[str, tuple[dict[str, int], list[str], list[tuple[str, int, int]]]] = {
    "multifield_search": ({"croatian": 1, "rower": 1, "swimming": 1}, [], []), "phrase_exact_search": ({"rowing": 1, "coach": 1}, ["Rowing"], []),
    "filtered_search": ({"canoe": 1, "sprint": 1}, [], [("gold", 1, 10000), ("yob", 1981, 10000)]), "filter_only_search": ({}, [], [("yob", 0, 1989), ("participations", 2, 10000), ("silver", 1, 10000)]),
    "phrase_filter_search": ({"kaukora": 1, "2010": 1, "sweden": 1}, ["Kaukora 2010"], [("yob", 1985, 10000)]), "decimal_search": ({"1.80": 1, "olympic": 1, "rower": 1}, [], []), "stored_fields": ({"judo": 1, "germany": 1}, [], []),
}
#: Searched fields, the columns they come from, and their weights; columns kept whole.
FIELDS = (
    ("name", "name", 5.0), ("sport_text", "sport", 3.0), ("country_text", "country", 3.0), ("wiki_sport", "wiki_sport", 2.0), ("wiki_birth_place", "wiki_birth_place", 2.0),
    ("wiki_position", "wiki_position", 1.5), ("wiki_club", "wiki_club", 1.2), ("wiki_bio", "wiki_bio", 1.1), ("lookup_texts", "array_to_string(lookup_texts, ' ')", 1.05),
)
KEYWORDS = ("name", "country", "sport", "first_games")
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
#: Elements without text; entities that occur in the pages.
JUNK = ("script", "style", "noscript", "template", "svg", "picture", "source")
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#x27;": "'", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&eacute;": "é", "&amp;": "&"}
#: Words of a standard analyser; parts of URLs.
STANDARD = "[\\p{L}\\p{M}\\p{Nd}_]+(?:(?:['’.·][\\p{L}]|[.,;'][\\p{Nd}])[\\p{L}\\p{M}\\p{Nd}_]*)*"
SITE = "^https?://(?:www\\.)?arena-results\\.example/en"
SECTIONS = ("^(?:news|athletes|olympic-games)(?:/.*)?$", "^sports/[^/]+/.+$")
BLOCKED = ("/sign-?in(?:/|[?#]|$)", "/videos?(?:/|[?#]|$)", "/films?(?:/|[?#]|$)", "/podcast(?:/|[?#]|$)", "/live(?:/|[?#]|$)")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@lru_cache(maxsize=1)
def _folded() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Case folding, compatibility decomposition, no marks: what becomes one character or none, and Latin ligatures."""
    single, none, many = {}, "", []
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xD7A4, 0xD800), *range(0xE000, 0x10000)]):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.casefold()) if not unicodedata.combining(x))
        if len(plain) == 1 and plain != c:
            single[c] = plain
        elif not plain:
            none += c
        elif len(plain) > 1 and (c < "ɐ" or "ﬀ" <= c <= "ﬆ" or c == "ẞ"):
            many.append((c, plain))
    return "".join(single) + none, "".join(single.values()), tuple(many)


def fold(x: str) -> str:
    src, dst, longer = _folded()
    x = f"lower({x})"
    for a, b in longer:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"translate({x}, {q(src)}, {q(dst)})"


STOP = ", ".join(q(w) for w in STOP_WORDS)
QTOK = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}_]+')"


def query_tok(x: str) -> str:
    return QTOK.format(fold(x))


def index_tok(x: str) -> str:
    return f"list_filter({query_tok(x)}, lambda t: length(t) > 1 AND t NOT IN ({STOP}) AND NOT regexp_full_match(t, '\\p{{N}}+'))"


TOKENS = f"tok AS (SELECT doc_id, {index_tok('text')} AS t FROM documents WHERE text IS NOT NULL), d AS (SELECT doc_id, t, len(t) AS dl FROM tok WHERE len(t) > 0)"
POSTINGS = TOKENS + ", p AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2), s AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM d), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1)"
IDF = {"": "ln(n::DOUBLE / df)", "bm25": "greatest(ln((n - df + 0.5) / (df + 0.5)), 0.01)"}


def topk(rank: str, method: str) -> str:
    terms = ", ".join(f"({q(t)}, {n})" for t, n in TEXT_QUERY.items())
    w = "tf * idf" if rank == "tfidf" else "idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))"
    return f"""WITH {POSTINGS}, q(term, qtf) AS (VALUES {terms}), x AS (SELECT p.doc_id, round(sum(qtf * {w}), 6) AS score FROM q JOIN p USING (term)
      JOIN (SELECT term, {IDF[method]} AS idf FROM f, s) USING (term) JOIN d USING (doc_id), s GROUP BY 1)
      SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x ORDER BY score DESC, doc_id LIMIT 10"""


def name_key(x: str, collapse: bool = False) -> str:
    x = f"lower(trim(translate({x}, {q(KEY_FROM)}, {q(KEY_TO)})))"
    x = f"regexp_replace(regexp_replace({x}, '\\s*\\([^(]*\\)\\s*', ' ', 'g'), '\\s*\\[[^]]*\\]\\s*', ' ', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[^a-z0-9\\\\]', ' ', 'g'), '\\\\s+', ' ', 'g')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))" if collapse else f"trim({x})"


def text_key(x: str) -> str:
    x = f"lower(trim(translate({x}, {q(KEY_FROM)}, {q(KEY_TO)})))"
    x = f"regexp_replace({x}, '\\s*[\\(\\[].*?[\\)\\]]\\s*', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({x}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


PAGES = "pages AS (SELECT doc_id, any_value(url) AS url, any_value(raw_html) AS raw_html FROM lookups WHERE raw_html IS NOT NULL GROUP BY 1)"


def plain(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def junk(x: str, end: str = "") -> str:
    for t in JUNK:
        x = f"regexp_replace({x}, '(?is)<{t}{end}[^>]*>.*?</{t}>', ' ', 'g')"
    return x


def _all(x: str, form: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(form)}, 1), lambda b: {plain('b')})"


BLOCKS = "list_filter(list_concat(" + ", ".join(_all("h", f"(?is)<{t}[^>]*data-cy=[\"'](?:text-block-container|second-block)[\"'][^>]*>(.*?)</{t}>") for t in ("div", "section")) + "), lambda b: length(b) >= 30)"
MAIN = plain("regexp_extract(h, '(?is)<main[^>]*>(.*?)</main>', 1)")
PARAS = "coalesce(array_to_string(" + _all("h", "(?is)<p[^>]*>(.*?)</p>") + ", chr(10)), '')"
CLEANED = f"WITH {PAGES}, c AS (SELECT doc_id, url, {junk('raw_html')} AS h FROM pages)"
CASCADE = CLEANED + f""", b AS (SELECT doc_id, url, {BLOCKS} AS b, {MAIN} AS m, {PARAS} AS p FROM c),
  t AS (SELECT doc_id, url, CASE WHEN len(b) > 0 THEN array_to_string(b, chr(10) || chr(10)) WHEN length(m) >= 30 THEN m WHEN length(p) >= 30 THEN p ELSE '' END AS text FROM b)"""


def unescaped(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in ENTITIES.items():
        x = f"replace({x}, {q(a)}, {q(b)})"
    return f"trim(regexp_replace({x}, '[\\s\u00a0]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def norm_url(x: str) -> str:
    part = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://(?:[^/?#]*@)?([^/?#:]*)(?::[0-9]*)?)?([^?#]*)"
    s, h, p = (f"regexp_extract({x}, {q(part)}, {i})" for i in (1, 2, 3))
    host = f"regexp_replace(lower({h}), '^www\\.', '')"
    return f"(CASE WHEN {s} <> '' THEN lower({s}) || ':' ELSE '' END || CASE WHEN {host} <> '' THEN '//' || {host} ELSE '' END || CASE WHEN {p} = '' THEN '/' ELSE {p} END)"


def accepts(x: str) -> str:
    rest = f"regexp_replace({x}, '^(?s:.*?)/en/', '')"
    return f"(regexp_matches({x}, {q(SITE + '(?:/|$)')}) AND (" + " OR ".join(f"regexp_matches({rest}, {q(s)})" for s in SECTIONS) + ")" + "".join(f" AND NOT regexp_matches({x}, {q(b)})" for b in BLOCKED) + ")"


def tier(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, {q(SITE + '/athletes/[a-z0-9-]+/?$')}) THEN 0 ELSE 1 END"


def attributes(name: str) -> str:
    equal, medals = ATTRIBUTE_QUERIES[name]
    filters = {k: v for k, v in equal.items() if k != "name"}
    cond = ["true"] + [f"{fold(f'coalesce({k}, {chr(39) * 2})')} = {q(v)}" for k, v in filters.items()] + [f"coalesce({m}, 0) {op} {v}" for m, op, v in medals]
    fixed = 1.0 * len(filters) + 0.25 * len(medals)
    named = f"CASE WHEN contains({fold('name')}, {q(equal['name'])}) THEN 2.0 ELSE 0.0 END" if "name" in equal else "0.0"
    keep = "true" if filters or medals else "score <> 0"
    return f"""WITH a AS (SELECT DISTINCT ON (ath_id) * FROM athletes), s AS (SELECT ath_id, name, ({named} + {fixed})::DOUBLE AS score FROM a WHERE {' AND '.join(cond)})
      SELECT ath_id, name, score FROM s WHERE {keep} ORDER BY score DESC, ath_id LIMIT 20"""


ENTITIES_ONCE = "e AS (SELECT DISTINCT ON (entity_id) *, entity_id AS doc_id FROM final_entities)"
FIELD_TOKENS = " UNION ALL ".join(f"SELECT doc_id, {q(name)} AS field, {boost}::DOUBLE AS boost, regexp_extract_all(lower(coalesce({source}, '')), {q(STANDARD)}) AS t FROM e" for name, source, boost in FIELDS)
FIELD_POSTINGS = f"{ENTITIES_ONCE}, l AS (SELECT *, len(t) AS dl FROM ({FIELD_TOKENS}) WHERE len(t) > 0), p AS (SELECT doc_id, field, boost, dl, term, count(*) AS tf FROM (SELECT doc_id, field, boost, dl, unnest(t) AS term FROM l) GROUP BY ALL)"


def field_search(name: str, k: int = 100, select: str = "doc_id, score") -> str:
    words, phrases, ranges = FIELD_QUERIES[name]
    where = " AND ".join([f"coalesce(TRY_CAST({column} AS INT), 0) BETWEEN {low} AND {high}" for column, low, high in ranges]) or "true"
    if not words:
        return f"WITH {ENTITIES_ONCE} SELECT {select} FROM (SELECT *, {len(ranges)}::DOUBLE AS score FROM e WHERE {where}) ORDER BY score DESC, doc_id LIMIT {k}"
    exact = ""
    for i, phrase in enumerate(phrases):
        same = [f"coalesce({kw}, '') = {q(phrase)}" for kw in KEYWORDS]
        one = " + ".join(f"CASE WHEN {x} THEN ln(1 + ((SELECT count(*) FROM e) - n{j} + 0.5) / (n{j} + 0.5)) / 2.2 ELSE 0 END" for j, x in enumerate(same))
        exact += f", x{i} AS (SELECT doc_id, {one} AS ex FROM e, (SELECT " + ", ".join(f"count(*) FILTER ({x}) AS n{j}" for j, x in enumerate(same)) + f" FROM e) WHERE {' OR '.join(same)})"
    n = range(len(phrases))
    hits = "SELECT h.doc_id, score" + "".join(f" + x{i}.ex" for i in n) + " AS score FROM h" + "".join(f" JOIN x{i} USING (doc_id)" for i in n)
    values = ", ".join(f"({q(w)}, {m})" for w, m in words.items())
    final = f"SELECT e.*, coalesce(hits.score, 0) + {len(ranges)} AS score FROM e {'LEFT' if ranges else 'INNER'} JOIN hits USING (doc_id) WHERE {where}"
    return f"""WITH {FIELD_POSTINGS}, st AS (SELECT field, count(*) AS n, avg(dl) AS avgdl FROM l GROUP BY 1), q(term, qtf) AS (VALUES {values}),
      m AS (SELECT * FROM p JOIN q USING (term)), df AS (SELECT field, term, count(*) AS df FROM m GROUP BY 1, 2),
      h AS (SELECT doc_id, sum(boost * qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM m JOIN df USING (field, term) JOIN st USING (field) GROUP BY 1){exact},
      hits AS ({hits}), r AS (SELECT * REPLACE (round(score, 6) AS score) FROM ({final}))
      SELECT {select} FROM (SELECT * FROM r ORDER BY score DESC, doc_id LIMIT {k})"""


def json_of(columns: dict[str, bool]) -> str:
    """A JSON object of the columns that aren't NULL; True: strings."""
    parts = ", ".join(f"CASE WHEN {k} IS NOT NULL THEN '\"{k}\":' || to_json({k}){'' if text else '::VARCHAR'} END" for k, text in columns.items())
    return f"'{{' || array_to_string(list_filter([{parts}], lambda x: x IS NOT NULL), ',') || '}}'"


#: Infobox lines, and what their values lose.
INFOBOX = {"wiki_sport": "(?:sport|sports|event|discipline)", "wiki_birth_place": "(?:birth_place|birthplace)", "wiki_position": "(?:position|positions)", "wiki_club": "[a-z_ ]*clubs?", "wiki_height": "(?:height|height_cm|height_m)"}
VALUE_STEPS = [
    ("(?s)<ref[^>]*>.*?</ref>", " "), ("(?i)<ref[^/>]*>", " "), ("(?i)<ref[^/>]*/>", " "), ("(?s)\\{\\{.*?\\}\\}", " "), ("\\{\\{.*", " "),
    ("\\[\\[[^|\\]]*\\|([^\\]]+)\\]\\]", "\\1"), ("\\[\\[([^\\]]+)\\]\\]", "\\1"), ("&[a-z]+;", " "), ("[•]", " "), ("\\s+", " "),
]
BIO_STEPS = [
    ("(?s)\\{\\{Infobox[^}]*\\}\\}", " "), ("(?m)^\\|.*$", " "), ("<ref[^>]*>.*?</ref>", " "), ("<ref[^/>]*/>", " "), ("(?i)<small[^>]*>.*?</small>", " "),
    ("(?i)</?small[^>]*>", " "), ("(?s)\\{\\{.*?\\}\\}", " "), ("<!--.*?-->", " "), ("&[a-z]+;", " "), ("(?m)^\\s*={1,6}\\s*[^=]+?\\s*={1,6}\\s*$", " "),
    ("\\[\\[([^|\\]]+)\\|([^\\]]+)\\]\\]", "\\2"), ("\\[\\[([^\\]]+)\\]\\]", "\\1"), ("[{}'\"|]+", " "), ("\\s+", " "),
]
BIO = "(?s)[A-ZÁ-Ž][a-zá-ž]+ [A-ZÁ-Ž][a-zá-ž]+.*?[.!?](?:\\s*.*?[.!?]){3}"


def steps(x: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, by in pairs:
        x = f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"
    return f"trim({x})"


def infobox(name: str) -> str:
    """The value of the first line of a name that has one."""
    return steps(f"regexp_extract(h, {q(f'(?im)^[|]\\s*{INFOBOX[name]}\\s*=\\s*([^|\\s][^|\n]*)')}, 1)", VALUE_STEPS)


DUMP = "dump AS (SELECT DISTINCT ON (wiki_id) wiki_id, name AS title, '{{Infobox person' || " + " || ".join(f"chr(10) || '| {k} = ' || replace(coalesce({c}, ''), chr(10), ' ')" for k, c in (("sport", "wiki_sport"), ("birth_place", "wiki_birth_place"), ("curling_club", "wiki_club"), ("height", "wiki_height"))) + " || chr(10) || '}}' || chr(10) || coalesce(wiki_bio, '') AS text FROM wiki_df)"
HEADS = DUMP + """, heads AS (SELECT *, replace(regexp_replace(regexp_replace(substr(text, 1, 3000), '<!--.*?-->', ' ', 'g'), '(?i)<br\\s*/?>', ' ' || chr(10) || ' ', 'g'), '&nbsp;', ' ') AS h FROM dump
  WHERE title IS NOT NULL AND NOT regexp_matches(title, '^(Category|List|Template|Module|Portal|Draft|Help|Wikipedia):') AND NOT regexp_matches(text, '(?i)#redirect')),
  people AS (SELECT trim(regexp_replace(title, '\\s*\\(.*?\\)$', ''), ' ') AS name, * FROM heads WHERE regexp_matches(h, '(?mi)^\\|\\s*(birth_place|birth_date)\\s*=') OR regexp_matches(h, '(?i)(sport|sports|event|discipline|team|club|position)\\s*='))"""


_META = f"SELECT *, {strip(f'coalesce(status, {q(chr(32))})')} AS st FROM metadata"
_COMPLETE = " + ".join(f"(coalesce(length({w}), 0) > 0)::INT" for w in ("wiki_sport", "wiki_birth_place", "wiki_position", "wiki_club", "wiki_height", "wiki_bio"))

SQL = {
    "tokenize_docs": f"WITH {TOKENS} SELECT doc_id, dl AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM d",
    "query_tokens": f"SELECT item_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT item_id, {query_tok('text')} AS t FROM heldout_items)",
    "postings": f"WITH {POSTINGS} SELECT term, doc_id, tf FROM p",
    "doc_freq": f"WITH {POSTINGS} SELECT term, df FROM f",
    "doc_stats": f"WITH {TOKENS} SELECT doc_id, dl AS doc_len FROM d",
    "vocab_size": f"WITH {POSTINGS} SELECT (SELECT count(*) FROM f) AS n_terms, n AS n_docs, round(avgdl, 6) AS avgdl FROM s",
    **{f"idf_{k or 'classic'}": f"WITH {POSTINGS} SELECT term, round({v}, 6) AS idf FROM f, s" for k, v in IDF.items()},
    "tfidf_topk": topk("tfidf", ""), "tfidf_bm25idf_topk": topk("tfidf", "bm25"), "bm25_topk": topk("bm25", "bm25"), "bm25_classicidf_topk": topk("bm25", ""),
    "multi_query_topk": f"""WITH {POSTINGS}, q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({query_tok('text')}) AS term FROM heldout_items) GROUP BY 1, 2),
      x AS (SELECT item_id, p.doc_id, round(sum(qtf * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN p USING (term) JOIN (SELECT term, {IDF['bm25']} AS idf FROM f, s) USING (term) JOIN d USING (doc_id), s GROUP BY 1, 2),
      r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x) SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 5""",
    "fold_equality_filter": f"SELECT DISTINCT ath_id, country FROM athletes WHERE {fold('country')} = 'cote d''ivoire'",
    "normalize_key": f"SELECT DISTINCT ath_id, {name_key('name')} AS k, {name_key('name', True)} AS k1 FROM athletes",
    "normalize_text": f"SELECT doc_id, md5({text_key('text')}) AS text_md5 FROM documents",
    "html_strip_text": f"WITH {PAGES} SELECT doc_id, md5({plain('raw_html')}) AS text_md5 FROM pages",
    "html_unescaped": f"WITH {PAGES} SELECT doc_id, md5({unescaped('raw_html')}) AS text_md5 FROM pages",
    "html_junk_removed": CLEANED + " SELECT doc_id, md5(h) AS html_md5 FROM c",
    "html_blocks": CLEANED + f", b AS (SELECT doc_id, {BLOCKS} AS b FROM c) SELECT doc_id, len(b) AS n, md5(coalesce(array_to_string(b, chr(10) || chr(10)), '')) AS text_md5 FROM b",
    "html_paragraph_fallback": CLEANED + f" SELECT doc_id, md5({PARAS}) AS text_md5 FROM c",
    "html_fallback_cascade": CASCADE + f" SELECT doc_id, url, length(text) AS n_chars, md5(text) AS text_md5, md5({text_key('text')}) AS norm_md5 FROM t WHERE length(text) > 0",
    "entity_extract": "SELECT athlete_url, " + ", ".join(f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '') AS {x}" for x in ("name", "country", "sport", "participations", "first_games", "yob")) + " FROM (SELECT DISTINCT ON (ath_id) url AS athlete_url, * FROM athletes)",
    "medal_array_sum": "SELECT url AS athlete_url, coalesce(gold, 0) AS gold, coalesce(silver, 0) AS silver, coalesce(bronze, 0) AS bronze FROM (SELECT DISTINCT ON (ath_id) * FROM athletes)",
    "link_explode": f"WITH {PAGES} SELECT doc_id, unnest(regexp_extract_all(raw_html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1)) AS link FROM pages",
    "url_normalize": f"SELECT DISTINCT log_id, {norm_url('url')} AS url FROM metadata",
    "url_filter_tier": f"WITH u AS (SELECT DISTINCT {norm_url('url')} AS url FROM metadata) SELECT url, coalesce({accepts('url')}, false) AS accepted, {tier('url')} AS tier FROM u",
    "doc_id_hash": "SELECT DISTINCT doc_id, ('0x' || substr(sha1(url), 1, 16))::UBIGINT::VARCHAR AS hash FROM lookups",
    "url_filename": """SELECT DISTINCT url, replace(substr(CASE WHEN p = '' THEN 'index' ELSE p END, 4), '/', '_') || '.html' AS filename, regexp_extract('/x/' || coalesce(file, ''), '.*?(html/.*)$', 1) AS suffix
      FROM (SELECT url, file, trim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/') AS p FROM metadata)""",
    "frontier_step": f"""WITH u AS (SELECT {norm_url('url')} AS url, min(log_id) AS seq FROM metadata WHERE url IS NOT NULL GROUP BY 1), n AS (SELECT url, seq, {tier('url')} AS tier FROM u WHERE {accepts('url')} AND url NOT IN (SELECT url FROM lookups WHERE url IS NOT NULL)),
      r AS (SELECT url, tier, row_number() OVER (PARTITION BY tier ORDER BY seq, url) AS k FROM n) SELECT url, tier, k - 1 + 0 AS seq FROM r WHERE tier = 0 OR k <= 2000""",
    "substring_join": f"""WITH a AS (SELECT DISTINCT {name_key('name', True)} AS name_norm FROM athletes), t AS (SELECT doc_id, any_value(url) AS url, any_value({text_key('text')}) AS text_norm FROM lookups WHERE text IS NOT NULL GROUP BY 1)
      SELECT doc_id, url, name_norm FROM t JOIN a ON contains(text_norm, name_norm) WHERE length(name_norm) > 0""",
    "entity_left_join": f"WITH m AS (SELECT DISTINCT log_id, {strip('doc_id')} AS doc_id FROM metadata WHERE {strip('status')} = '200'), f AS (SELECT doc_id, any_value(length(raw_html)::VARCHAR) AS size FROM lookups GROUP BY 1) SELECT log_id, m.doc_id, size FROM m LEFT JOIN f ON m.doc_id = f.doc_id",
    "entity_merge": f"""WITH a AS (SELECT DISTINCT ath_id, {name_key('name')} AS name_norm FROM athletes), w AS (SELECT DISTINCT ON (wiki_id) wiki_id, {name_key("trim(regexp_replace(name, '\\s*\\(.*?\\)$', '', 'g'))")} AS name_norm, wiki_sport, wiki_height FROM wiki_df)
      SELECT ath_id, a.name_norm, wiki_sport, wiki_height FROM a LEFT JOIN w USING (name_norm)""",
    "url_lookup_join": f"""WITH m AS (SELECT {strip("coalesce(doc_id, '')")} AS doc_id, {strip("coalesce(url, '')")} AS url, coalesce(fetched_at, TIMESTAMP '0001-01-01') AS t, log_id FROM metadata WHERE {strip("coalesce(status, '')")} = '200'),
      l AS (SELECT doc_id, url FROM m WHERE doc_id NOT IN ('', '-1') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY t DESC, log_id DESC) = 1) SELECT i.doc_id, coalesce(l.url, '') AS url FROM (SELECT DISTINCT doc_id FROM lookups) i LEFT JOIN l USING (doc_id)""",
    "missing_semi": f"SELECT DISTINCT doc_id FROM (SELECT {strip("coalesce(doc_id, '')")} AS doc_id FROM metadata) WHERE doc_id <> '-1' AND doc_id IN (SELECT doc_id FROM lookups)",
    "missing_anti": f"SELECT DISTINCT doc_id FROM (SELECT {strip("coalesce(doc_id, '')")} AS doc_id FROM metadata) WHERE doc_id <> '-1' AND doc_id NOT IN (SELECT doc_id FROM lookups WHERE doc_id IS NOT NULL)",
    "completeness_dedup": f"""SELECT name_norm, entity_id, {_COMPLETE} AS score FROM (SELECT DISTINCT name_norm, entity_id, wiki_id, wiki_sport, wiki_birth_place, wiki_position, wiki_club, wiki_height, wiki_bio FROM final_entities)
      QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY {_COMPLETE} DESC, length(coalesce(wiki_bio, '')) DESC, entity_id) = 1""",
    "status_histogram": f"WITH b AS (SELECT {strip("coalesce(status, '')")} AS status FROM metadata) SELECT coalesce(status, 'TOTAL') AS status, count(*) AS n FROM b WHERE status <> '200' GROUP BY ROLLUP (status)",
    "skip_reasons": f"""WITH m AS (SELECT {strip("coalesce(status, '')")} AS status, {strip("replace(coalesce(file, ''), chr(92), '/')")} AS path FROM metadata), k AS (SELECT DISTINCT file AS path FROM metadata WHERE doc_id IN (SELECT doc_id FROM lookups)),
      r AS (SELECT CASE WHEN status <> '200' THEN 'status' WHEN path = '' THEN 'empty path' WHEN path NOT IN (SELECT path FROM k WHERE path IS NOT NULL) THEN 'missing file' END AS reason FROM m) SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "malformed_count": "SELECT count(*) AS n, count(*) FILTER (" + " AND ".join(f"coalesce({strip(x)}, '') = ''" for x in ("country", "sport", "yob", "first_games")) + ") AS malformed, count(*) FILTER (" + " OR ".join(f"coalesce({strip(x)}, '') = ''" for x in ("country", "sport", "yob", "first_games")) + ") AS incomplete FROM athletes",
    "article_ids": f"SELECT doc_id FROM (SELECT {strip("coalesce(doc_id, '')")} AS doc_id FROM metadata) WHERE doc_id <> '-1'",
    **{k: attributes(k) for k in ATTRIBUTE_QUERIES},
    "range_filters": "WITH a AS (SELECT DISTINCT ath_id, coalesce(gold, 0) AS g, CASE WHEN regexp_full_match(trim(yob), '[+-]?\\d+') THEN TRY_CAST(yob AS INT) END AS y0 FROM athletes), b AS (SELECT g, coalesce(y0, 0) AS y FROM a) SELECT "
    + ", ".join(f"count(*) FILTER ({x} BETWEEN {lo} AND {hi}) AS c{i}" for i, (x, lo, hi) in enumerate([("g", 2, 10000), ("g", 1, 10000), ("g", 0, 0), ("g", 0, 1), ("g", 1, 1), ("g", 1, 1), ("y", 0, 1989), ("y", 1990, 10000)])) + " FROM b",
    **{k: field_search(k) for k in FIELD_QUERIES if k != "stored_fields"},
    "result_projection": """SELECT entity_id AS doc_id, coalesce(name, 'Unknown') AS name, coalesce(country, 'Unknown') AS country, coalesce(sport, 'Unknown') AS sport, coalesce(gold, 0) AS gold, substr(coalesce(wiki_bio, ''), 1, 300) AS bio,
      coalesce(array_to_string(lookup_urls[1:20], ' '), '') AS links FROM (SELECT DISTINCT ON (entity_id) * FROM final_entities)""",
    "console_projection": """SELECT entity_id AS doc_id, name, coalesce(array_to_string(lookup_urls[1:3], ' '), '') || CASE WHEN len(lookup_urls) > 3 THEN ' ...' ELSE '' END AS links,
      'gold ' || coalesce(gold, 0) || ', silver ' || coalesce(silver, 0) || ', bronze ' || coalesce(bronze, 0) AS medals FROM (SELECT DISTINCT ON (entity_id) * FROM final_entities)""",
}
SQL["substring_collect"] = f"WITH h AS ({SQL['substring_join']}) SELECT name_norm, count(*) AS n, string_agg(url, ' ' ORDER BY url, doc_id) AS urls, string_agg(doc_id, ' ' ORDER BY url, doc_id) AS ids FROM h GROUP BY 1"

_FRONTIER = SQL["frontier_step"]
_SKIPPED = SQL["skip_reasons"]
_CLEAN = f"SELECT log_id, {strip('doc_id')} AS doc_id, {strip('status')} AS status, {strip('url')} AS url, ltrim(replace({strip('file')}, chr(92), '/'), './') AS file FROM metadata"
_ATHLETES = "(SELECT DISTINCT ON (ath_id) * FROM athletes)"


def _show(x: str) -> str:
    return f"coalesce(trim(regexp_replace({unescaped(x)}, '\\s+', ' ', 'g')), '')"


SQL |= {
    "index_build": f"WITH {POSTINGS} SELECT term, df, round({IDF['bm25']}, 6) AS idf FROM f, s",
    "field_index_build": f"WITH {FIELD_POSTINGS} SELECT field, term, doc_id, tf, dl FROM p",
    "frontier_take": f"SELECT * FROM ({_FRONTIER}) ORDER BY tier, seq, url LIMIT 100",
    "frontier_reload": f"SELECT * FROM ({_FRONTIER}) ORDER BY tier, seq, url OFFSET 100",
    "skipped_rows": _SKIPPED.replace("AS status, ", f"AS status, {strip('url')} AS u0, url, ", 1).replace("THEN 'missing file' END AS reason FROM m", "THEN 'missing file' END AS reason, url, path FROM m").replace("SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1", "SELECT reason, url, path, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1, 2, 3"),
    "page_split": f"WITH m AS ({_CLEAN}) SELECT CASE WHEN doc_id = '-1' THEN 'entity' ELSE 'article' END AS kind, count(*) AS n, min(log_id) AS first FROM m WHERE doc_id IS NOT NULL GROUP BY 1",
    "page_routes": f"SELECT DISTINCT url, CASE WHEN {tier('url')} = 0 AND rtrim(url, '/') <> 'https://arena-results.example/en/athletes' THEN 'athletes' ELSE 'lookup' END AS folder FROM metadata",
    "path_norm": f"SELECT DISTINCT log_id, ltrim(replace({strip('file')}, chr(92), '/'), './') AS path FROM metadata",
    "global_count": "SELECT count(*) AS n, count(DISTINCT name_norm) AS n_names, count(*) FILTER (wiki_bio IS NULL) AS no_bio FROM final_entities",
    "article_left_join": CASCADE.replace(f"WITH {PAGES}, c AS (SELECT doc_id, url, {junk('raw_html')} AS h FROM pages)", f"""WITH m AS ({_CLEAN}), g AS (SELECT doc_id, any_value(raw_html) AS raw_html FROM lookups WHERE raw_html IS NOT NULL GROUP BY 1), fs AS (SELECT DISTINCT ON (file) file, raw_html FROM m JOIN g USING (doc_id) WHERE file <> ''),
      a AS (SELECT DISTINCT doc_id, url, file FROM m WHERE status = '200' AND doc_id <> '-1'), c AS (SELECT a.doc_id, a.url, {junk('raw_html')} AS h FROM a LEFT JOIN fs ON a.file = fs.file)""") + " SELECT doc_id, url, md5(text) AS text_md5 FROM t WHERE length(text) > 0",
    "entity_articles": f"WITH a AS (SELECT ath_id, {name_key('name', True)} AS name_norm FROM {_ATHLETES}), h AS ({SQL['substring_collect']}) SELECT ath_id, a.name_norm, h.urls FROM a LEFT JOIN h USING (name_norm)",
    "entity_extract_strict": "SELECT ath_id, " + ", ".join(f"{_show(x)} AS {k}" for k, x in (("name", "name"), ("noc", "regexp_replace(country, '[<>]', ' ', 'g')"), ("sport", "regexp_replace(sport, '[<>]', ' ', 'g')"), ("participations", "participations"), ("first_games", "first_games"), ("yob", "yob"))) + f", coalesce(gold, 0) AS gold, coalesce(silver, 0) AS silver, coalesce(bronze, 0) AS bronze FROM {_ATHLETES}",
    "html_main": CASCADE.replace("FROM pages)", "FROM (SELECT doc_id, url, regexp_replace(raw_html, '<(/?)article', '<\\1main', 'g') AS raw_html FROM pages))", 1) + " SELECT doc_id, md5(text) AS text_md5 FROM t WHERE length(text) > 0",
    "html_paragraph_strict": f"WITH {PAGES}, c AS (SELECT doc_id, {junk('raw_html', chr(92) + 'b')} AS h FROM pages) SELECT doc_id, md5({unescaped("array_to_string(regexp_extract_all(h, '(?is)<p[^>]*>(.*?)</p>', 1), ' ' || chr(10) || ' ')")}) AS text_md5 FROM c",
    "log_round_trip": f"SELECT coalesce(doc_id, '') AS doc_id, coalesce(status, '') AS status, coalesce(ltrim(replace({strip('file')}, chr(92), '/'), './'), '') AS file, coalesce(date, '') AS date, coalesce(url, '') AS url, count(*) AS n FROM metadata WHERE NOT contains(coalesce(url, ''), chr(92)) GROUP BY ALL",
    "athletes_round_trip": "SELECT " + ", ".join(f"{strip(f"coalesce({k}, '')")} AS {k}" for k in ("file", "country", "sport", "url")) + ", gold, silver, bronze, count(*) AS n FROM athletes GROUP BY ALL",
    "articles_round_trip": CASCADE + " SELECT doc_id, md5(text) AS text_md5 FROM t WHERE length(text) > 0",
    "entities_round_trip": "SELECT entity_id, name_norm, len(lookup_urls) AS n_urls FROM final_entities",
    "athlete_json": "SELECT country, sport, count(*) AS n, sum(gold) AS gold, count(DISTINCT url) AS n_urls FROM athletes GROUP BY 1, 2",
    "index_json": f"WITH {POSTINGS} SELECT term, df, round({IDF['bm25']}, 6) AS idf, count(*) AS n, sum(tf) AS tf FROM p JOIN f USING (term), s GROUP BY ALL",
    "dispatch_text": SQL["bm25_topk"], "dispatch_attributes": SQL["attr_search_mixed"],
    "stored_fields": field_search("stored_fields", 20, f"doc_id, {json_of({'name': True, 'country': True, 'sport': True, 'gold': False, 'wiki_sport': True})} AS fields"),
    "infobox_extract": f"WITH {HEADS} SELECT name, " + ", ".join(f"{infobox(k)} AS {k}" for k in INFOBOX) + " FROM people",
    "bio_extract": f"WITH {HEADS}, c AS (SELECT name, {steps('text', BIO_STEPS)} AS c FROM people) SELECT name, regexp_extract(c, {q(BIO)}, 0) AS wiki_bio FROM c",
}


def _measure(t: str, pattern: str, factor: str) -> str:
    """The first number of a form, in centimetres; NULL if there is none. A comma before three digits groups, another is a point."""
    n = f"regexp_extract({t}, {q('(?i)' + pattern)}, 1)"
    return f"(TRY_CAST(replace(regexp_replace({n}, ',([0-9]{{3}})$', '\\1'), ',', '.') AS DECIMAL(18, 6)) * {factor}::DECIMAL(9, 3))"


def _inches(t: str) -> str:
    form = q("(?i)([0-9]+) ?-?(?:feet|foot|ft|'')[ -]*([0-9]+(?:[.][0-9]+)?)( ?½| [0-9]/[0-9])?".replace("''", "'"))
    foot, inch, part = (f"regexp_extract({t}, {form}, {i})" for i in (1, 2, 3))
    fraction = f"CASE WHEN contains({part}, '½') THEN 0.5 WHEN contains({part}, '/') THEN TRY_CAST(substr(trim({part}), 1, 1) AS DECIMAL(9, 6)) / TRY_CAST(substr(trim({part}), 3, 1) AS INT) ELSE 0 END"
    return f"((TRY_CAST({foot} AS INT) * 12 + TRY_CAST({inch} AS DECIMAL(18, 6)) + ({fraction})::DECIMAL(9, 6)) * 2.54::DECIMAL(9, 3))"


def height_cm(column: str) -> str:
    """The height a text states, in whole centimetres: templates and quotes are brought to plain form, then metric measures are
    looked for before feet and inches, then bare numbers."""
    t = f"regexp_replace(regexp_replace(translate({column}, '’′”″ ', '''''\"\" '), '[{{][{{](?:height|convert)[|](?:(m|cm)=)?([0-9.]+)(?:[|](cm|m))?[^{{}}]*[}}][}}]', '\\2 \\1\\3'), '[{{][{{][^{{}}]*[}}][}}]', '')"
    forms = [
        ("([0-9]+(?:[.,][0-9]+)?) ?(?:cm|centimet)", "1"), ("([0-9],?[0-9]{3}) ?mm", "0.1"), ("([0-9]+[.,][0-9]+) ?(?:m\\b|met)", "100"), None,
        ("([0-9]+[.][0-9]+) ?ft", "30.48"), ('^ *([0-9]+) ?(?:"|in)', "2.54"), ("^ *([0-9]{3}) *$", "1"), ("^ *([12][.][0-9]+) *$", "100"),
    ]
    return f"floor(coalesce({', '.join(_inches(t) if f is None else _measure(t, *f) for f in forms)}) + 0.5)::BIGINT"


SQL["p6_found"] = f"""WITH h AS (SELECT wiki_id, {height_cm('wiki_height')} AS height_cm FROM (SELECT DISTINCT wiki_id, wiki_height FROM wiki_df WHERE wiki_height IS NOT NULL))
  SELECT DISTINCT wiki_id, height_cm FROM h WHERE height_cm BETWEEN 120 AND 230"""
