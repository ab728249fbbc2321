"""Page boilerplate and main content: minimum-cut labelling of page lines.

A classifier, trained here on bounded weakly labelled pages, gives each line a cost for either label (the terminal
capacities); neighbouring lines, and lines that are close in the DOM, are tied by smoothness edges; a minimum cut
separates content from boilerplate on each page. Lines whose own cost outweighs all their edges are decided at once
(they take that side in every minimum cut); max-flow runs on what is left.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the fitted sample: pages, the first by hash of their id.
SAMPLE = 1500
#: Characters (text and markup) of the fitted sample at most; a bound of the driver's memory.
SAMPLE_CHARS = 40_000_000
TIE_NEAR, TIE_SAME, TIE_FAR = 0.5, 0.8, 0.1

_TOKEN = re.compile(r"<(script|style|template|noscript)\b.*?</\1\s*>|<!--.*?-->|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|([^<]+)", re.S)
_VOID = {"br", "hr", "img", "input", "meta", "link", "wbr", "source"}
_INLINE = {"b", "i", "em", "strong", "u", "sup", "sub", "mark", "abbr"}
_WORD = re.compile(r"[^\W\d_]+|\d+|[|·»/©:]")


def blocks(raw: str | None) -> list[tuple[str, int, str]]:
    """The text runs of a page's body in order: (text, number of the top-level container, tags down to it)."""
    if not raw:
        return []
    start = raw.find("<body")
    out: list[tuple[str, int, str]] = []
    path: list[str] = []
    top = -1
    for m in _TOKEN.finditer(raw, max(start, 0)):
        text = m[5]
        if text is not None:
            text = text.strip()
            if text:
                out.append((html.unescape(text) if "&" in text else text, top, "/".join(path[1:])))
            continue
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if m[2]:
            for i in range(len(path) - 1, -1, -1):
                if path[i].split(".")[0] == name:
                    del path[i:]
                    break
        elif name not in _VOID and name not in _INLINE:
            if len(path) == 1:
                top += 1
            path.append(name + ".c" if "class" in m[4] and len(path) > 1 else name)
    return out


def place(lines: list[str], runs: list[tuple[str, int, str]]) -> list[tuple[int, str] | None]:
    """For each line the container and tags of its text run; None where the page's markup doesn't have it."""
    if len(lines) == len(runs) and all(a.strip() == b[0] for a, b in zip(lines, runs)):
        return [(t, s) for _, t, s in runs]
    where: dict[str, list[int]] = {}
    for i, (t, _, _) in enumerate(runs):
        where.setdefault(t, []).append(i)
    out, last = [], -1
    for line in lines:
        i = next((k for k in where.get(line.strip(), ()) if k > last), None)
        out.append(None if i is None else runs[i][1:])
        last = last if i is None else i
    return out


def line_words(line: str) -> list[str]:
    return ["0" if w.isdigit() else w for w in _WORD.findall(line.lower())]


def _main(spots: list[tuple[int, str] | None], lines: list[str]) -> tuple[int | None, str | None]:
    """The container with the headline (else the one with most text), and the tags that hold most of its text."""
    main = next((s[0] for s in spots if s and s[1].rsplit("/", 1)[-1].split(".")[0] == "h1"), None)
    if main is None:
        size = Counter()
        for s, t in zip(spots, lines):
            if s:
                size[s[0]] += len(t)
        main = max(size, key=lambda k: (size[k], -k)) if size else None
    size = Counter()
    for s, t in zip(spots, lines):
        if s and s[0] == main and not s[1].endswith(("h1", "a")):
            size[s[1]] += len(t)
    return main, max(size, key=lambda k: (size[k], k)) if size else None


def weak_labels(lines: list[str], spots: list[tuple[int, str] | None]) -> list[int]:
    """1 content, 0 boilerplate, -1 unknown: from the headline's container and its main run of text."""
    if not any(s and s[1].rsplit("/", 1)[-1].split(".")[0] == "h1" for s in spots):
        return [-1] * len(lines)
    main, body = _main(spots, lines)
    return [-1 if s is None else int(s[0] == main and (s[1] == body or s[1].endswith("h1"))) for s in spots]


class Classifier:
    """Log-odds of content for a line: word evidence, form of the line, its neighbours, and its place in the DOM."""

    def __init__(self, words: dict[str, float], text: np.ndarray, full: np.ndarray):
        self.words, self.text, self.full = words, text, full

    def evidence(self, line: str) -> tuple[float, float, int]:
        ws = line_words(line)
        get = self.words.get
        total = sum([get(w, 0.0) for w in ws]) + sum([get(a + " " + b, 0.0) for a, b in zip(ws, ws[1:])])
        return total / math.sqrt(len(ws) + 1), total / (len(ws) + 1), len(ws)

    def features(self, lines: list[str], spots: list) -> list[list[float]]:
        ev = [self.evidence(x) for x in lines]
        prose = [e[0] > 0 and e[2] >= 8 and x.rstrip()[-1:] in (".", "!", "?", '"', "”", "“", "»", "…") for e, x in zip(ev, lines)]
        first = prose.index(True) if any(prose) else -1
        last = len(prose) - 1 - prose[::-1].index(True) if any(prose) else -1
        main, body = _main(spots, lines)
        rows = []
        n = len(lines)
        for i, (x, e, s) in enumerate(zip(lines, ev, spots)):
            near = ev[i - 1][0] if i else -2.0, ev[i + 1][0] if i + 1 < n else -2.0
            t = [
                1.0, max(min(e[0], 8.0), -8.0) / 2, max(min(e[1], 3.0), -3.0), min(math.log1p(len(x)), 7.0) - 4, float(prose[i]), float(x.rstrip()[-1:] in ".!?"),
                float(first >= 0 and i + 1 == first), float(first <= i <= last), max(min(near[0], 4.0), -4.0) / 4, max(min(near[1], 4.0), -4.0) / 4,
                float("|" in x or " · " in x or " / " in x or "©" in x), float(":" in x[:24]),
            ]
            if s is None:
                d = [0.0] * 5
            else:
                inside, tag = s[0] == main, s[1].rsplit("/", 1)[-1]
                d = [1.0, float(inside), float(inside and s[1] == body), float(inside and tag.startswith("h1")), float(tag.endswith(".c") or tag in ("a", "span", "small"))]
            rows.append(t + d)
        return rows

    def odds(self, x: np.ndarray) -> np.ndarray:
        k = len(self.text)
        return np.where(x[:, k] > 0, x @ self.full, x[:, :k] @ self.text)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit(pages: list[tuple[str | None, str]]) -> Classifier:
    """Train on pages (markup, text): word log-odds from one half of the pages, weights from the other and the first."""
    data = []
    for raw, text in pages:
        lines = text.split("\n")
        spots = place(lines, blocks(raw))
        data.append((lines, spots, weak_labels(lines, spots)))
    counts = (Counter(), Counter())
    for lines, _, labels in data[::2]:
        for x, y in zip(lines, labels):
            if y >= 0:
                ws = line_words(x)
                counts[y].update({*ws, *(a + " " + b for a, b in zip(ws, ws[1:]))})
    n = [sum(c.values()) + 1 for c in counts]
    words = {w: round(v, 4) for w in {*counts[0], *counts[1]} if counts[0][w] + counts[1][w] >= 3 and abs(v := math.log((counts[1][w] + 0.5) / n[1]) - math.log((counts[0][w] + 0.5) / n[0])) > 0.3}
    model = Classifier(words, np.zeros(12), np.zeros(17))
    xs, ys = [], []
    for lines, spots, labels in data:
        f = model.features(lines, spots)
        for r, y in zip(f, labels):
            if y >= 0:
                xs.append(r)
                ys.append(y)
    if not xs or min(ys) == max(ys):
        model.text[:] = [0, 1, 1, 1, 2, 0, 2, 1, 0, 0, -1, 0]
        model.full[:12] = model.text
        return model
    x, y = np.array(xs), np.array(ys, dtype=float)
    return Classifier(words, _logistic(x[:, :12], y), _logistic(x, y))


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: -odds for each content line below zero and odds for each other line above,
    plus the weight of every edge between unlike lines. Max-flow by shortest augmenting paths."""
    n = len(odds)
    s, t = n, n + 1
    cap: list[dict[int, float]] = [{} for _ in range(n + 2)]
    for i, o in enumerate(odds):
        a, b = (s, i) if o > 0 else (i, t)
        cap[a][b] = abs(o)
        cap[b].setdefault(a, 0.0)
    for i, j, w in edges:
        cap[i][j] = cap[i].get(j, 0.0) + w
        cap[j][i] = cap[j].get(i, 0.0) + w
    while True:
        back = {s: s}
        queue = [s]
        for u in queue:
            for v, c in cap[u].items():
                if c > 1e-9 and v not in back:
                    back[v] = u
                    queue.append(v)
            if t in back:
                break
        if t not in back:
            return [i in back for i in range(n)]
        flow, v = math.inf, t
        while v != s:
            flow, v = min(flow, cap[back[v]][v]), back[v]
        v = t
        while v != s:
            cap[back[v]][v] -= flow
            cap[v][back[v]] += flow
            v = back[v]


def page_edges(spots: list) -> list[tuple[int, int, float]]:
    """Ties between neighbouring lines, and between each line and the next one with the same place in the DOM."""
    out = []
    seen: dict[tuple, int] = {}
    for i, s in enumerate(spots):
        if i:
            p = spots[i - 1]
            out.append((i - 1, i, TIE_NEAR if p is None or s is None or p == s else TIE_FAR))
        if s is not None:
            if s in seen and seen[s] < i - 1:
                out.append((seen[s], i, TIE_SAME))
            seen[s] = i
    return out


def cut_page(odds: list[float], spots: list) -> list[bool]:
    """``min_cut`` of a page, after lines whose odds outweigh their ties are decided."""
    edges = page_edges(spots)
    weight = [0.0] * len(odds)
    for i, j, w in edges:
        weight[i] += w
        weight[j] += w
    open_lines = [i for i, o in enumerate(odds) if abs(o) <= weight[i]]
    label = [o > 0 for o in odds]
    if open_lines:
        number = {i: k for k, i in enumerate(open_lines)}
        own = [odds[i] for i in open_lines]
        inner = []
        for i, j, w in edges:
            if i in number and j in number:
                inner.append((number[i], number[j], w))
            elif i in number:
                own[number[i]] += w if label[j] else -w
            elif j in number:
                own[number[j]] += w if label[i] else -w
        for i, v in zip(open_lines, min_cut(own, inner)):
            label[i] = v
    return label


def train(pages: DataFrame, doc_id: str = "doc_id", raw: str = "raw_html", text: str = "text", limit: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Classifier:
    """Fit on at most ``limit`` pages that have markup, the first by hash of their id; of copies of a page one is taken before
    any reaches the driver. ``chars``: pages of the sample beyond so many characters in all are left out of it."""
    whole = pages.where(F.col(raw).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(doc_id).alias("h"), F.col(doc_id).alias("id"), F.struct(F.col(text).alias("text"), F.col(raw).alias("raw")).alias("page"))
    few = whole.select("h", "id").distinct().orderBy("h", "id").limit(limit)
    one = whole.drop("h").join(F.broadcast(few), "id").groupBy("h", "id").agg(F.max("page").alias("page"))  # at most ``limit`` pages
    so_far = F.sum(F.length("page.text") + F.length("page.raw")).over(Window.orderBy("h", "id"))
    rows = one.withColumn("__n", so_far).where(F.col("__n") <= chars).collect()
    return fit([(r["page"]["raw"], r["page"]["text"]) for r in sorted(rows, key=lambda r: r["id"])])


def label_lines(pages: DataFrame, model: Classifier, doc_id: str = "doc_id", raw: str = "raw_html", text: str = "text") -> DataFrame:
    """(doc_id, boilerplate ARRAY<INT>, content STRING): the numbers, from 1, of the lines that are neither headline nor
    body, and the text without them. Whole pages, one row a page row; copies of a page give equal rows. NULL text: no
    lines and NULL content; empty lines are boilerplate; NULL markup: words, form and neighbours decide."""
    kind = pages.schema[doc_id].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                part = pdf.iloc[lo : lo + 500]
                pages_, rows = [], []
                for r, t in zip(part[raw], part[text]):
                    lines = t.split("\n") if t is not None else []
                    spots = place(lines, blocks(r)) if lines else []
                    pages_.append((lines, spots))
                    rows += model.features(lines, spots) if lines else []
                odds = model.odds(np.array(rows)).tolist() if rows else []
                out, at = [], 0
                for (lines, spots), d, t in zip(pages_, part[doc_id], part[text]):
                    own = [o if x.strip() else -50.0 for o, x in zip(odds[at : at + len(lines)], lines)]
                    at += len(lines)
                    keep = cut_page(own, spots) if lines else []
                    out.append((d, [i for i, k in enumerate(keep, 1) if not k], None if t is None else "\n".join(x for x, k in zip(lines, keep) if k)))
                yield pd.DataFrame(out, columns=[doc_id, "boilerplate", "content"])

    return pages.select(doc_id, raw, text).mapInPandas(scan, f"{doc_id} {kind}, boilerplate array<int>, content string")


def boilerplate_lines(pages: DataFrame, model: Classifier, doc_id: str = "doc_id", raw: str = "raw_html", text: str = "text") -> DataFrame:
    """(doc_id, line_no), one row a line of boilerplate; copies of a page count once."""
    got = label_lines(pages, model, doc_id, raw, text).select(doc_id, "boilerplate").dropDuplicates()
    return got.select(doc_id, F.explode("boilerplate").alias("line_no")).withColumn("line_no", F.col("line_no").cast("long")).distinct()
