"""Markup residue in text: HTML, Markdown, wiki and LaTeX markup to clean text that keeps its structure.

Every value is parsed into one kind of tree, whatever the markup. The values of one host (a site, or a column of short
texts) are aligned by simple tree matching with the host's most frequent tree: nodes whose text is the same wherever
they occur are template and go, nodes that vary are slots and stay as content. Headings, lists, code and formulas are
structure and always stay. A value carries markup if nodes beside running text are left in its aligned tree.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import re
import sys
from collections import Counter
from collections.abc import Container, Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import broadcast_if_small, materialize

#: Element names, block elements, elements whose content is no text.
TAGS = set(
    "a abbr address article aside b big blockquote body br caption center cite code col dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd label li link main mark math meta nav noscript nowiki ol p pre q ref references s samp script section small source span strike strong style sub sup svg syntaxhighlight table tbody td template tfoot th thead title tr tt u ul var wbr gallery includeonly poem blink".split()
)
VOID = {"br", "hr", "img", "input", "link", "meta", "source", "wbr", "col", "references"}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "center", "dl", "dt", "dd", "main", "header", "footer", "nav", "aside"}
SILENT = {"script", "style", "noscript", "template", "svg", "head", "references", "gallery"}
STRUCTURE = {"heading", "item", "code", "formula"}
#: Templates that stand for nothing in running text.
NO_TEXT_TEMPLATES = {"flagicon", "flag", "efn", "ref", "refn", "sfn", "cn", "citation needed", "fact", "cite web", "cite news", "cite book", "infobox", "reflist", "defaultsort", "short description", "use dmy dates"}


class Node:
    __slots__ = ("kids", "tag", "text")

    def __init__(self, tag: str, text: str = "", kids: list | None = None):
        self.tag, self.text, self.kids = tag, text, kids if kids is not None else []

    def walk(self) -> Iterator[Node]:
        """The node and all nodes below it, in text order; trees may be of any depth."""
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(reversed(n.kids))

    def size(self) -> int:
        return sum(1 for _ in self.walk())

    def words(self) -> str:
        return "".join(n.text for n in self.walk())

    def shape(self) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
                continue
            out.append(n.tag)
            if n.kids:
                todo.append(")")
                for i, k in enumerate(reversed(n.kids)):
                    todo += [",", k] if i else [k]
                out.append("(")
        return "".join(out)


_ENTITY = r"&(?:amp;)*(?:\#\d{1,7}|\#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,10});"
_GRAMMAR = re.compile(
    rf"""
    (?P<comment><!--.*?(?:-->|\Z)|<!DOCTYPE[^<>]*>)
  | (?P<fence>^[ \t]*(?P<fmark>```|~~~)[^\n]*\n(?P<fbody>.*?)(?:^[ \t]*(?P=fmark)[ \t]*$|\Z))
  | <(?P<raw>pre|code|nowiki|math|syntaxhighlight|script|style|tt|kbd|samp)\b[^<>]*(?<!/)>(?P<rbody>.*?)</(?P=raw)\s*>
  | (?P<ref><ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>|<sup\b[^<>]*>\s*\[\w{{1,12}}\]\s*</sup>)
  | (?P<tag></?(?P<tname>[a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>)
  | (?P<entity>{_ENTITY})
  | (?P<ttable>^\{{\|.*?(?:^\|\}}|\Z))
  | (?P<mtable>^[ \t]*\|[^\n]+\|[ \t]*\n[ \t]*\|[ \t:|-]*-[ \t:|-]*\|[ \t]*(?:\n[ \t]*\|[^\n]+\|[ \t]*)*)
  | \{{\{{(?P<template>(?:[^{{}}]|\{{(?!\{{)|\}}(?!\}})|\{{\{{(?:[^{{}}]|\{{\{{[^{{}}]*\}}\}})*\}}\}})*)\}}\}}
  | \[\[(?P<link>(?:[^\[\]]|\[[^\[\]]*\]|\[\[[^\[\]]*\]\])+)\]\]
  | (?P<mdimage>!\[[^\[\]]*\]\([^()\s]*(?:\s"[^"]*")?\))
  | \[(?P<mdtext>[^\[\]\n]+)\]\((?P<mdurl>[^()\s]+(?:\s"[^"]*")?)\)
  | \[(?P<exturl>(?:https?:)?//[^\s\[\]]+)(?:\s(?P<exttext>[^\[\]]*))?\]
  | (?P<broken>\{{\{{|\}}\}}|\[\[|\]\])
  | (?P<magic>__[A-Z]{{4,}}__|\#REDIRECT\b)
  | (?P<display>\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\))
  | (?P<inline>(?<![\w$\\])\$(?=[^\s$])(?:[^$\n]*[\\^_={{}}+][^$\n]*|[a-zA-Z])(?<=[^\s$])\$(?![\w$]))
  | \\begin\{{(?P<env>[a-zA-Z*]+)\}}(?:\[[^\]]*\])?(?P<ebody>.*?)\\end\{{(?P=env)\}}
  | \\(?P<command>[a-zA-Z]+)\*?(?:\[[^\]\n]*\])?(?P<cargs>(?:\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}})*)
  | \{{\\(?P<switch>it|bf|em|tt|sc|sl|rm|sf|small|large|itshape|bfseries|scshape)\b\s*(?P<sbody>[^{{}}]*)\}}
  | (?P<escape>\\[%&$\#_{{}}])
  | (?P<latexquote>``(?P<lq>[^`'\n]+)'')
  | ^[ \t]*(?P<wh>={{1,6}})[ \t]*(?P<whead>[^=\n][^\n]*?)[ \t]*(?P=wh)[ \t]*$
  | ^[ \t]*(?P<mh>\#{{1,6}})[ \t]+(?P<mhead>[^\n]*\S)[ \t]*\#*[ \t]*$
  | ^[ \t]*(?P<rule>-{{4,}}|\*{{3,}}|_{{3,}})[ \t]*$
  | ^[ \t]*(?P<bullet>[*\-+]|\*{{2,}}|\#\#?[*:])[ \t]+(?=\S)(?P<item>[^\n]+)
  | ^(?P<wbullet>\*+|:+|;+)(?=[^\W_])(?P<witem>[^\n*]+)$
  | ^>[ \t]+(?P<quote>[^\n]+)$
  | '''(?P<wbold>[^'\n](?:[^'\n]|'(?!''))*)'''
  | ''(?P<wital>[^'\n](?:[^'\n]|'(?!'))*)''
  | \*\*(?P<mbold>[^\s*](?:[^*\n]*[^\s*])?)\*\*
  | (?<!\w)__(?P<ubold>[^\s_](?:[^\n]*?[^\s_])?)__(?!\w)
  | (?<![\w*])\*(?P<mital>[^\s*](?:[^*\n]*[^\s*])?)\*(?![\w*])
  | (?<![\w_])_(?P<uital>[^\s_](?:[^_\n]*[^\s_])?)_(?![\w_])
  | ~~(?P<strike>[^\s~](?:[^~\n]*[^\s~])?)~~
  | `(?P<mcode>[^`\n]+)`
  | (?P<stray>'{{3}}|\*\*(?=\S)|(?<=\S)\*\*)
    """,
    re.X | re.S | re.M,
)
_FORMULA_ENVS = {"equation", "align", "math", "displaymath", "gather", "eqnarray", "multline"}
_LIST_ENVS = {"itemize", "enumerate", "description"}
_CODE_ENVS = {"verbatim", "lstlisting", "minted"}
_NO_TEXT_COMMANDS = {"cite", "citep", "citet", "footnote", "label", "ref", "pageref", "vspace", "hspace", "index", "thanks", "usepackage", "documentclass", "includegraphics", "noindent", "par", "newpage", "footnotemark", "bibliography"}
_HEAD_COMMANDS = {"section", "subsection", "subsubsection", "paragraph", "chapter", "part", "title"}
#: Where a match of the grammar can begin.
_START = re.compile(r"^[ \t]*[`~|=#\-*_+:;>]|[<&{\[_#$\\*`~]|!\[|\]\]|\}\}|''", re.M)
_TAG = re.compile(r"</?(?P<tname>[a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>")
#: Elements that the grammar reads in other ways too; all others can be matched by their tag alone.
_OWN_RULES = {"pre", "code", "nowiki", "math", "syntaxhighlight", "script", "style", "tt", "kbd", "samp", "ref", "sup"}
_HEADINGS = {f"h{i}": "#" * i for i in range(1, 7)}
Todo = list[tuple[str, list]]


def _fields(body: str) -> list[str]:
    """The parts of a template or link, cut at its own pipes."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"\{\{|\[\[|\}\}|\]\]|\|", body):
        if m[0] == "|":
            if depth == 0:
                out.append(body[start : m.start()])
                start = m.end()
        else:
            depth += 1 if m[0] in ("{{", "[[") else -1
    return [*out, body[start:]]


def _is_entity(s: str) -> bool:
    name = s[1:].split("amp;")[-1] if s.startswith("&amp;") and s != "&amp;" else s[1:]
    return name.startswith("#") or name in html5


def _template(body: str, todo: Todo) -> Node:
    parts = [p.strip() for p in _fields(body)]
    name = parts[0].lower().split(":")[0].strip()
    if name in ("convert", "cvt") and len(parts) > 2:
        return Node("template", "", [Node("text", f"{parts[1]} {parts[2]}")])
    if name in ("height", "infobox") or name in NO_TEXT_TEMPLATES or name.startswith("cite "):
        return Node("template:" + name, "", [])
    if name in ("math", "mvar"):
        return Node("formula", parts[-1])
    plain = [p for p in parts[1:] if not re.match(r"[\w -]+=", p)]
    if name in ("ubl", "plainlist", "unbulleted list", "hlist"):
        return Node("template", "", _kids(", ".join(dict.fromkeys(plain)), todo))
    return Node("template:" + name, "", _kids(plain[-1], todo) if plain else [])


def _link(body: str, todo: Todo) -> Node:
    parts = _fields(body)
    head = parts[0].strip().lower()
    if head.startswith(("file:", "image:", "category:", "datei:", "bild:", "kategorie:", "fichier:", "catégorie:", "archivo:", "categoría:")):
        return Node("link:" + head.split(":")[0], "", [])
    return Node("link", "", _kids(parts[-1] if parts[-1].strip() else re.sub(r"\s*\([^()]*\)$", "", parts[0]), todo))


def _command(m: re.Match, todo: Todo) -> Node:
    name, args = m["command"], re.findall(r"\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}", m["cargs"])
    if name in _NO_TEXT_COMMANDS:
        return Node("command:" + name)
    if name in _HEAD_COMMANDS and args:
        return Node("heading", "#", _kids(args[-1], todo))
    if name in ("texttt", "verb") and args:
        return Node("code", args[-1])
    if name in ("frac", "sqrt", "sum", "int", "alpha", "beta", "gamma", "cdot", "times", "leq", "geq"):
        return Node("formula", m[0])
    return Node("command", "", _kids(args[-1], todo) if args else [])


def _node(m: re.Match, todo: Todo) -> Node | None:
    """The node of one match; None if it is plain use of the same characters."""
    kind = m.lastgroup
    g = m.groupdict()
    if g["comment"] is not None:
        return Node("comment")
    if g["fence"] is not None:
        return Node("code", g["fbody"].strip("\n"))
    if g["raw"] is not None:
        raw = g["raw"].lower()
        return Node("element:" + raw) if raw in ("script", "style") else Node("formula" if raw == "math" else "code" if raw != "nowiki" else "text", html.unescape(g["rbody"])) if raw != "nowiki" else Node("element:nowiki", "", [Node("text", g["rbody"])])
    if g["ref"] is not None:
        return Node("note")
    if g["entity"] is not None:
        return Node("entity", html.unescape(html.unescape(m[0])).replace("\xa0", " ")) if _is_entity(m[0]) else None
    if g["ttable"] is not None:
        rows = re.split(r"^\|-.*$", g["ttable"][2:].removesuffix("|}"), flags=re.M)
        cells = [[c.split("|")[-1].strip() for c in re.split(r"^[|!]|\|\||!!", r, flags=re.M)[1:]] for r in rows]
        return Node("table", "", [Node("row", "", [Node("cell", "", _kids(c, todo)) for c in r]) for r in cells if r])
    if g["mtable"] is not None:
        lines = [x.strip().strip("|").split("|") for x in g["mtable"].split("\n")]
        return Node("table", "", [Node("row", "", [Node("cell", "", _kids(c.strip(), todo)) for c in r]) for i, r in enumerate(lines) if i != 1])
    if g["template"] is not None:
        return _template(g["template"], todo)
    if g["link"] is not None:
        return _link(g["link"], todo)
    if g["mdimage"] is not None:
        return Node("image")
    if g["mdtext"] is not None:
        return Node("link", "", _kids(g["mdtext"], todo)) if re.match(r"[\w+.-]+:|/|#|\w+\.\w|\w+/", g["mdurl"]) else None
    if g["exturl"] is not None:
        return Node("link", "", _kids(g["exttext"] or "", todo))
    if g["broken"] is not None or g["stray"] is not None:
        return Node("broken")
    if g["magic"] is not None:
        return Node("magic")
    if g["display"] is not None:
        return Node("formula", m[0].strip("$") if m[0][0] == "$" else m[0][2:-2])
    if g["inline"] is not None:
        return Node("formula", m[0][1:-1])
    if g["env"] is not None:
        env = g["env"].rstrip("*").lower()
        if env in _FORMULA_ENVS:
            return Node("formula", g["ebody"].strip())
        if env in _CODE_ENVS:
            return Node("code", g["ebody"].strip("\n"))
        if env in _LIST_ENVS:
            return Node("list", "", [Node("item", "", _kids(x.strip(), todo)) for x in re.split(r"\\item\b(?:\[[^\]]*\])?", g["ebody"])[1:]])
        return Node("environment", "", _kids(g["ebody"], todo))
    if g["command"] is not None:
        return _command(m, todo)
    if g["switch"] is not None:
        return Node("style", "", _kids(g["sbody"], todo))
    if g["escape"] is not None:
        return Node("escape", m[0][1:])
    if g["latexquote"] is not None:
        return Node("style", "", [Node("text", "“" + g["lq"] + "”")])
    if g["whead"] is not None:
        return Node("heading", "#" * len(g["wh"]), _kids(g["whead"], todo))
    if g["mhead"] is not None:
        return Node("heading", g["mh"], _kids(g["mhead"], todo))
    if g["rule"] is not None:
        return Node("rule")
    if g["item"] is not None:
        return Node("item", "", _kids(g["item"], todo)) if len(g["item"]) > 1 else None
    if g["witem"] is not None:
        return Node("item", "", _kids(g["witem"], todo))
    for k in ("quote", "wbold", "wital", "mbold", "ubold", "mital", "uital", "strike"):
        if g[k] is not None:
            return Node("style", "", _kids(g[k], todo))
    if g["mcode"] is not None:
        return Node("code", g["mcode"])
    raise AssertionError(kind)


def _kids(s: str, todo: Todo) -> list[Node]:
    """The nodes of a string inside a node: an empty list that is filled when its turn comes."""
    kids: list[Node] = []
    if s:
        todo.append((s, kids))
    return kids


def _fill(s: str, top: list[Node], todo: Todo) -> None:
    """Parse a string into ``top``; elements nest by their tags, an end tag without a start is a node of its own."""
    stack: list[tuple[str, list[Node]]] = [("", top)]
    opened: Counter = Counter()
    at = pos = 0

    def text(upto: int) -> None:
        if upto > at:
            stack[-1][1].append(Node("text", s[at:upto]))

    while start := _START.search(s, pos):
        begin = start.start()
        m = _TAG.match(s, begin) if s[begin] == "<" else None
        is_tag = m is not None and m["tname"].lower() not in _OWN_RULES
        if not is_tag:
            m = _GRAMMAR.match(s, begin)
            if m is None:
                pos = begin + 1
                continue
            is_tag = m.lastgroup == "tag"
        if is_tag:
            name = m["tname"].lower()
            if name not in TAGS:
                pos = begin + 1
                continue
            text(begin)
            if s[begin + 1] == "/":
                if opened[name]:
                    while True:
                        closed, _ = stack.pop()
                        opened[closed] -= 1
                        if closed == name:
                            break
                else:
                    stack[-1][1].append(Node("element:/" + name))
            else:
                if name == stack[-1][0] and name in ("li", "p"):
                    opened[stack.pop()[0]] -= 1
                n = Node("heading", _HEADINGS[name]) if name in _HEADINGS else Node("item" if name == "li" else "element:" + name)
                stack[-1][1].append(n)
                if name not in VOID and s[m.end() - 2] != "/":
                    stack.append((name, n.kids))
                    opened[name] += 1
            at = pos = m.end()
            continue
        n = _node(m, todo)
        if n is None or m.end() == m.start():
            pos = m.start() + 1
            continue
        text(m.start())
        stack[-1][1].append(n)
        at = pos = m.end()
    text(len(s))


def parse(value: str | None) -> Node:
    """The tree of a text, however deep it nests; plain text is a root with at most one text node."""
    root = Node("root")
    todo: Todo = [(value or "", root.kids)]
    while todo:
        _fill(*todo.pop(), todo)
    return root


class Shapes:
    """Numbers of subtree shapes (equal for equal shapes), and the sizes of the best mappings between them."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.best: dict[tuple[int, int], int] = {}
        self.maps: dict[tuple[int, int], dict[int, int]] = {}

    def of(self, tree: Node) -> dict[int, int]:
        """id of each node of the tree -> number of its shape."""
        out: dict[int, int] = {}
        for n in reversed(list(tree.walk())):
            key = (n.tag, *[out[id(k)] for k in n.kids]) if n.kids else (n.tag,)
            got = self.number.get(key)
            if got is None:
                got = self.number[key] = len(self.tags)
                self.tags.append(n.tag)
                self.kids.append(key[1:])
                self.sizes.append(1 + sum(self.sizes[k] for k in key[1:]))
            out[id(n)] = got
        return out

    def match(self, a: int, b: int) -> int:
        """Simple tree matching: the size of the largest top-down, order-keeping mapping of equal tags."""
        todo = [(a, b)]
        while todo:  # pairs of kids first; no recursion, since trees may be of any depth
            x, y = todo[-1]
            if self.known(x, y) is None:
                head, xs, ys, tail = self._ends(x, y)
                new = [(p, q) for p in set(xs) for q in set(ys) if self.known(p, q) is None]
                if new:
                    todo += new
                    continue
                same = sum(self.sizes[k] for k in (*self.kids[x][:head], *self.kids[x][len(self.kids[x]) - tail :]))
                self.best[x, y] = 1 + same + (self._rows(xs, ys)[-1][-1] if xs and ys else 0)
            todo.pop()
        return self.known(a, b)

    def known(self, x: int, y: int) -> int | None:
        if x == y:
            return self.sizes[x]
        if self.tags[x] != self.tags[y]:
            return 0
        if not self.kids[x] or not self.kids[y]:
            return 1
        return self.best.get((x, y))

    def _rows(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> list[list[int]]:
        rows = [[0] * (len(ys) + 1)]
        weights: dict[int, list[int]] = {}
        for p in xs:
            if p not in weights:
                weights[p] = [self.known(p, q) for q in ys]
            old, best, new = rows[-1], 0, [0]
            for above, diagonal, w in zip(old[1:], old, weights[p]):
                if above > best:
                    best = above
                if diagonal + w > best:
                    best = diagonal + w
                new.append(best)
            rows.append(new)
        return rows

    def pairs(self, x: int, y: int) -> dict[int, int]:
        """Places of the kids of x -> places of the kids of y they are mapped to. Equal kids at either end are mapped to
        each other, which a best mapping always can."""
        if (x, y) in self.maps:
            return self.maps[x, y]
        out = self.maps[x, y] = self._pairs(x, y)
        return out

    def _pairs(self, x: int, y: int) -> dict[int, int]:
        head, xs, ys, tail = self._ends(x, y)
        n, k = len(self.kids[x]), len(self.kids[y])
        out = {i: i for i in range(head)} | {n - i: k - i for i in range(1, tail + 1)}
        if not xs or not ys:
            return out
        for p in set(xs):
            for q in set(ys):
                self.match(p, q)
        rows = self._rows(xs, ys)
        i, j = len(xs), len(ys)
        while i and j:
            w = self.known(xs[i - 1], ys[j - 1])
            if w and rows[i][j] == rows[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                out[head + i] = head + j
            elif rows[i][j] == rows[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return out

    def _ends(self, x: int, y: int) -> tuple[int, tuple[int, ...], tuple[int, ...], int]:
        """How many kids of x and y are equal at the start, the kids between, and how many are equal at the end."""
        xs, ys = self.kids[x], self.kids[y]
        head, n, k = 0, len(xs), len(ys)
        while head < n and head < k and xs[head] == ys[head]:
            head += 1
        while n > head and k > head and xs[n - 1] == ys[k - 1]:
            n, k = n - 1, k - 1
        return head, xs[head:n], ys[head:k], len(xs) - n


def match(a: Node, b: Node) -> int:
    """The size of the largest top-down, order-keeping mapping of equal tags between two trees."""
    s = Shapes()
    return s.match(s.of(a)[id(a)], s.of(b)[id(b)])


def align(a: Node, b: Node, shapes: Shapes | None = None, of_b: dict[int, int] | None = None) -> list[tuple[Node, str]]:
    """Each node of ``a``, in text order, with its slot: the path of the node of ``b`` it is matched with, else a path of its own tags."""
    s = shapes or Shapes()
    of_a, of_b = s.of(a), of_b or s.of(b)
    out: list[tuple[Node, str]] = []
    todo: list[tuple[Node, Node | None, str]] = [(a, b, a.tag) if a.tag == b.tag else (a, None, "~/" + a.tag)]
    while todo:
        x, y, path = todo.pop()
        out.append((x, path))
        if y is None:
            todo += [(k, None, f"{path}/{k.tag}") for k in reversed(x.kids)]
            continue
        if not x.kids:
            continue
        mapped = s.pairs(of_a[id(x)], of_b[id(y)])
        for i in range(len(x.kids) - 1, -1, -1):
            k, j = x.kids[i], mapped.get(i)
            todo.append((k, None, f"{path}/~/{k.tag}") if j is None else (k, y.kids[j], f"{path}/{k.tag}[{j}]"))
    return out


def render(n: Node, drop: frozenset = frozenset()) -> str:
    """The clean text of a tree; ``drop``: ids of nodes that are template."""
    if id(n) in drop:
        return " " if n.tag == "text" else ""
    tag = n.tag
    if tag in ("text", "entity", "escape"):
        return n.text
    if tag in ("comment", "note", "broken", "magic", "image") or tag.startswith(("link:", "command:")):
        return ""
    inner = "".join([render(k, drop) for k in n.kids])
    if tag == "code":
        return f"\n```\n{n.text}\n```\n" if "\n" in n.text else f"`{n.text}`"
    if tag == "formula":
        return f"${n.text}$"
    if tag == "heading":
        return f"\n{n.text or '#'} {inner.strip()}\n"
    if tag == "item":
        return f"\n- {inner.strip()}"
    if tag == "row":
        return " | ".join([render(k, drop).strip() for k in n.kids]) + "\n"
    if tag in ("list", "table"):
        return f"\n{inner}\n"
    if tag.startswith("element:"):
        name = tag[8:]
        return "" if name in SILENT else "\n" if name in ("br", "hr", "/p") else f"\n{inner}\n" if name in BLOCKS else inner
    return inner


def rendered(n: Node, drop: frozenset = frozenset()) -> str:
    """``render`` for trees of any depth."""
    before = sys.getrecursionlimit()
    deep = max((d for _, d in _depths(n)), default=0) * 2 + 1000
    if deep <= before:
        return render(n, drop)
    sys.setrecursionlimit(deep)  # frames of plain functions take no stack of the process
    try:
        return render(n, drop)
    finally:
        sys.setrecursionlimit(before)


def _depths(n: Node) -> Iterator[tuple[Node, int]]:
    todo = [(n, 1)]
    while todo:
        x, d = todo.pop()
        yield x, d
        todo += [(k, d + 1) for k in x.kids]


def tidy(s: str) -> str:
    """Spaces and line breaks in order, outside of code blocks."""
    parts = re.split(r"(\n```\n.*?\n```\n)", s, flags=re.S)
    for i in range(0, len(parts), 2):
        p = re.sub(r"[^\S\n]+", " ", parts[i].replace("\u200b", ""))
        parts[i] = re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", p))
    return "".join(parts).strip()


def strip(value: str | None) -> str | None:
    """Clean text of one value alone, without the wrapper of its host."""
    return None if value is None else tidy(rendered(parse(value)))


def _short(s: str, n: int) -> str:
    """The text, or its first ``n`` characters and a hash of the whole: equal only for equal texts."""
    return s if len(s) <= n else s[:n] + hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def clean(df: DataFrame, host: str, text: str, out: str, share: float = 0.5, least: int = 5, flag: str | None = None) -> DataFrame:
    """Add ``out``: ``text`` without markup and without the template of its host; and ``flag``, if given: whether the
    text carries markup, that is, whether its aligned tree has nodes beside running text.

    The wrapper of a host is induced from all its rows: the most frequent tree is the reference, of any length, each tree is aligned
    with it, and a slot whose most frequent text makes up ``share`` of at least ``least`` occurrences is template; that
    text in that slot, compared as a whole, is dropped, unless it is structure or running text of the value. Counts are aggregated before
    they are shuffled, and only slots below markup nodes are counted, so a host with any share of the rows is no hot
    group. References and wrappers meet the rows in one join, after which nothing is shuffled. NULL texts stay NULL (flag: false), NULL
    hosts are one host, empty tables give no rows; an existing ``out`` or ``flag`` is replaced."""
    base = df.withColumn("__host", F.coalesce(F.col(host).cast("string"), F.lit("")))

    @F.pandas_udf("string")
    def shape(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: _short(parse(s).shape(), 2000))

    shapes = base.select("__host", F.col(text).alias("t")).where("t != ''").withColumn("shape", shape("t")).groupBy("__host", "shape").agg(F.count("*").alias("n"), F.min("t").alias("t"))
    refs = materialize(shapes.withColumn("marked", F.col("shape").contains(",")).groupBy("__host").agg(F.max_by("t", F.struct("marked", "n", "shape")).alias("__ref")))

    @F.pandas_udf("array<struct<slot:string,text:string>>")
    def slots(texts: pd.Series, refs: pd.Series) -> pd.Series:
        known = _References()
        return pd.Series([[(p, w) for _, p, w in known.slots(known.aligned(parse(s), r))] if s else [] for s, r in zip(texts, refs)])

    each = base.join(broadcast_if_small(refs, size=F.length("__ref") * 2), "__host", "left").select("__host", F.explode(slots(F.col(text), F.col("__ref"))).alias("s")).groupBy("__host", "s.slot", "s.text").count()
    fixed = each.groupBy("__host", "slot").agg(F.sum("count").alias("n"), F.max(F.struct("count", "text")).alias("top")).where((F.col("n") >= least) & (F.col("top.count") >= share * F.col("n")))
    wrapper = fixed.groupBy("__host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "top.text"))).alias("__wrapper"))
    hosts = materialize(refs.join(wrapper, "__host", "left"))
    hosts = broadcast_if_small(hosts, size=F.coalesce(F.length("__ref") + F.length(F.to_json("__wrapper")), F.lit(0)) * 2)

    @F.pandas_udf("struct<clean:string,marked:boolean>")
    def finish(texts: pd.Series, refs: pd.Series, wrappers: pd.Series) -> pd.DataFrame:
        known = _References()

        def one(s, r, w):
            if not s:
                return s, False
            w = dict(w) if w is not None else {}
            tree = parse(s)
            gone = frozenset(id(n) for n, p, x in known.slots(known.aligned(tree, r), w) if w[p] == x) if w else frozenset()
            return tidy(rendered(tree, gone)), any(n.tag not in ("root", "text") for n in tree.walk())

        return pd.DataFrame([one(*x) for x in zip(texts, refs, wrappers)], columns=["clean", "marked"])

    done = base.join(hosts, "__host", "left").withColumn("__done", finish(F.col(text), F.col("__ref"), F.col("__wrapper"))).withColumn(out, F.col("__done.clean"))
    return (done.withColumn(flag, F.col("__done.marked")) if flag else done).drop("__host", "__ref", "__wrapper", "__done")


class _References:
    """Parsed references of the hosts of a batch, and the alignment of trees with them."""

    def __init__(self) -> None:
        self.trees: dict[str | None, tuple[Node, dict[int, int]]] = {}
        self.shapes = Shapes()

    def aligned(self, tree: Node, ref: str | None) -> list[tuple[Node, str]]:
        if len(self.shapes.best) + len(self.shapes.maps) + len(self.shapes.number) > 300_000:  # a memo, not a bound
            self.trees, self.shapes = {}, Shapes()
        if ref not in self.trees:
            of = parse(ref)
            self.trees[ref] = of, self.shapes.of(of)
        of, numbers = self.trees[ref]
        return align(tree, of, self.shapes, numbers)

    @staticmethod
    def slots(aligned: list[tuple[Node, str]], among: Container[str] | None = None) -> list[tuple[Node, str, str]]:
        """Nodes that may be template, each with its slot and its whole text: markup nodes that are neither structure nor
        inside of it; of slots ``among`` only, if given."""
        flat = "".join(n.text for n, _ in aligned)
        ends = list(itertools.accumulate(len(n.text) for n, _ in aligned))
        last: dict[int, int] = {}  # place of the last node below each node
        for i in range(len(aligned) - 1, -1, -1):
            n = aligned[i][0]
            last[id(n)] = last[id(n.kids[-1])] if n.kids else i
        return [
            (n, p, _short(flat[ends[i] - len(n.text) : ends[last[id(n)]]], 200))
            for i, (n, p) in enumerate(aligned)
            if n.tag not in STRUCTURE and n.tag not in ("root", "text", "entity", "escape", "style") and (among is None or p in among) and not any(x in p for x in ("heading", "item", "list"))
        ]


#: Entries that stand for a missing text.
PLACEHOLDERS = {"", "-", "—", "–", "?", "n/a", "na", "none", "null", "unknown", "tbc", "tba", "tbd", "todo", "no text", "(no text)", "stub", "see text", "biography to follow", "coming soon", "lorem ipsum"}
_END = re.compile(r"[.!?。]['\"”’»)\]]*$")
_CUT = re.compile(r"(\.\.\.|…|\[\s*(\.\.\.|…)\s*\])['\"”’)\]]*$")


def complete_prose(value: str | None, words: int = 5) -> bool:
    """Whether a text is prose of at least ``words`` words whose last sentence is complete; markup doesn't matter."""
    if value is None:
        return False
    lines = [x for x in (strip(value) or "").split("\n") if x.strip() and not re.match(r"\s*(#|- |```)", x)]
    text = " ".join(lines).strip()
    if text.lower().strip(" .") in PLACEHOLDERS or len(re.findall(r"\w+", text)) < words or _CUT.search(text):
        return False
    return bool(_END.search(text))
