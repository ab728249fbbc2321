"""Evaluation texts leaking into training text: CGK embedding, bit-sampling LSH over windows, exact verification.

Words are the symbols. The CGK random walk maps a window of words to a longer string such that few edits become few
differing places; tables sample places of it, so windows that agree in a table's places meet. A pair that met is
verified by an exact local alignment of the whole item with the whole document around the meeting place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16
WALKS = 4
TABLES = 6
PLACES = 4
#: Share of an item's words that must be aligned in one stretch.
SHARE = 0.34
BLOCK = 5000
#: Characters of documents that are scanned at once.
PIECE_CHARS = 2_500_000

_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=\w)[-­‐]\s*\n\s*(?=\w)")
_REMARK = re.compile(r"\[[^\[\]\n]{1,40}\]")
_JOINED = re.compile(r"(?<=\w)['’`´](?=\w)")
_GONE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x80, 0x10000) if unicodedata.combining(chr(c)) or unicodedata.category(chr(c)) == "Cf") + "]+")
_CUTS = re.compile(r"[.:?!]\s+")


def words(text: str | None) -> list[str]:
    """Folded words: compatibility forms, case, accents, line-end hyphens, apostrophes and bracketed remarks don't matter."""
    if not text:
        return []
    t = unicodedata.normalize("NFKD", _JOINED.sub("", _REMARK.sub(" ", _BROKEN.sub("", text))))
    if not t.isascii():
        t = _GONE.sub("", t)
    return _WORD.findall(t.lower())


def task_prefixes(texts: list[str], least: int = 3) -> set[str]:
    """Opening lines that several items share: up to a sentence mark within the first 80 characters."""
    seen: dict[str, int] = {}
    for t in texts:
        for m in _CUTS.finditer(t[:80]):
            seen[t[: m.end()].strip()] = seen.get(t[: m.end()].strip(), 0) + 1
        if "\n" in t[:80]:
            head = t[: t.index("\n")].strip()
            seen[head] = seen.get(head, 0) + 1
    return {k for k, n in seen.items() if n >= least}


def passage(text: str, prefixes: set[str]) -> str:
    """An item without its task line."""
    t = text.strip()
    own = [p for p in prefixes if p and t.startswith(p)]
    return t[max(map(len, own)) :].strip() if own else t


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class _Hasher:
    """Words to 64-bit symbols: the whole word, and three parts that survive a letter error."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int, int]] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        import xxhash

        h, known = xxhash.xxh64_intdigest, self.known
        if len(known) > 500_000:
            known.clear()
        out = np.empty((len(ws), 4), dtype=np.uint64)
        for i, w in enumerate(ws):
            got = known.get(w)
            if got is None:
                long = len(w) >= 5
                got = known[w] = (h(w), h("<" + w[:4]) if long else 0, h(">" + w[-4:]) if long else 0, h(w[:2] + "|" + w[-3:]) if long else 0)
            out[i] = got
        return out


def _places(seed: int) -> list[list[list[int]]]:
    """For each walk and table the sampled places, at least three apart, within twice the window."""
    rnd = np.random.default_rng(seed)
    out = []
    for _ in range(WALKS):
        out.append([])
        for _ in range(TABLES):
            while True:
                p = np.sort(rnd.choice(2 * WINDOW - 4, PLACES, replace=False))
                if (np.diff(p) >= 3).all():
                    break
            out[-1].append(p.tolist())
    return out


def signatures(symbols: np.ndarray, pos: np.ndarray | None = None, seed: int = 11, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each table, windows by their first word (of ``pos``) and their keys. ``symbols`` must end with a window of zeros.
    ``known``: whether a symbol occurs in any item. Only windows with known symbols in all sampled places of a table can
    meet there; the others are left out, and a walk goes on only for windows that may still meet in one of its tables."""
    pos = np.arange(len(symbols) - WINDOW) if pos is None else pos
    for r, tables in enumerate(_places(seed)):
        bits = _mix(symbols, 1000 + r)
        wanted = sorted({j for p in tables for j in p})
        own, at = pos, pos.copy()  # windows that are still walked, and the word each has come to
        keys = [np.zeros(len(pos), dtype=np.uint64) for _ in tables]
        able = [np.ones(len(pos), dtype=bool) for _ in tables]
        for j in range(wanted[-1] + 1):
            if j in wanted:
                seen = symbols[at]
                good = known[at] if known is not None else None
                for t, p in enumerate(tables):
                    if j in p:
                        keys[t] = _mix(keys[t] ^ seen, 77 + t)
                        if good is not None:
                            able[t] &= good
                if good is not None and j in wanted[1::3]:
                    keep = np.logical_or.reduce(able)
                    if keep.mean() < 0.8 if len(keep) else False:
                        own, at, keys, able = own[keep], at[keep], [k[keep] for k in keys], [x[keep] for x in able]
            at = np.minimum(at + ((bits[at] >> np.uint64(j)) & np.uint64(1)).astype(np.int64), own + WINDOW - 1)
        for key, x in zip(keys, able):
            yield (own, key) if known is None else (own[x], key[x])


class Items:
    """Index of a block of items: their symbols, and for each table the sorted keys of their windows."""

    def __init__(self, ids: list, texts: list[str], prefixes: set[str]):
        h = _Hasher()
        self.ids = ids
        self.symbols = [h(words(passage(t or "", prefixes))) for t in texts]
        pad = np.zeros((WINDOW, 4), dtype=np.uint64)
        flat = np.concatenate([x for s in self.symbols for x in (s, pad)] or [pad])  # no window reaches into the next item
        firsts = np.cumsum([0, *(len(s) + WINDOW for s in self.symbols)])[:-1]
        long = [i for i, s in enumerate(self.symbols) if len(s) >= WINDOW]
        owner = np.concatenate([np.full(len(self.symbols[i]) - WINDOW + 1, i) for i in long] or [np.zeros(0, np.int64)])
        start = np.concatenate([np.arange(len(self.symbols[i]) - WINDOW + 1) for i in long] or [np.zeros(0, np.int64)])
        words_ = flat[:, 0]
        self.words = np.unique(words_)
        self.tables = []
        for _, key in signatures(words_, firsts[owner] + start if len(owner) else np.zeros(0, np.int64)):
            order = np.argsort(key, kind="stable")
            self.tables.append((key[order], owner[order], start[order]))
        # items shorter than a window meet wherever one of their words, whole or nearly, stands
        short = [(x, i, k) for i, s in enumerate(self.symbols) if len(s) < WINDOW for k, four in enumerate(s.tolist()) for x in four if x]
        short.sort()
        self.short = tuple(np.array([x[c] for x in short], dtype=np.uint64 if c == 0 else np.int64) for c in range(3))


def candidates(symbols: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, word of the document where the item would begin, word met) of all windows that meet, and of all words of short items.
    ``symbols``: words x 4, ending with a window of zeros."""
    got: list[tuple] = []
    first = symbols[:, 0]

    def meet(keys: np.ndarray, owner: np.ndarray, start: np.ndarray, key: np.ndarray, pos: np.ndarray) -> None:
        a, b = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        hit = np.flatnonzero(b > a)
        if len(hit):
            n = (b - a)[hit]
            idx = np.repeat(a[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = np.repeat(pos[hit], n)
            got.append((owner[idx], w - start[idx], w))

    known = items.words[np.minimum(np.searchsorted(items.words, first), len(items.words) - 1)] == first
    known &= first != 0
    total = np.concatenate([[0], np.cumsum(known)])
    some = np.flatnonzero(total[WINDOW:-1] > total[: -WINDOW - 1])  # windows with an item word at all
    for (keys, owner, start), (pos, key) in zip(items.tables, signatures(first, some, known=known)):
        if len(keys):
            meet(keys, owner, start, key, pos)
    if len(items.short[0]):
        for k in range(4):
            pos = np.flatnonzero(symbols[:-WINDOW, k])
            meet(*items.short, symbols[pos, k], pos)
    if not got:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*got))


def local_scores(doc: np.ndarray, lows: np.ndarray, width: int, item: np.ndarray, first: np.ndarray, end: np.ndarray, need: float = 0.0, gap: float = 0.3, miss: float = 0.4) -> np.ndarray:
    """Best local alignment of ``item`` with each stretch doc[low : low + width] within [first, end): a word found counts 1, one with a letter
    error 0.8, a lost or added word -gap, an altered one -miss. Stretches whose words can't reach ``need`` score 0."""
    cols = np.minimum(lows[:, None] + np.arange(width)[None, :], len(doc) - 1)
    d = doc[cols]
    d[(cols < first[:, None]) | (cols >= end[:, None])] = 0
    if need > 0:
        # a stretch scores at most its words that occur in the item, and at most the item's words that occur in it
        like, have = np.zeros(d.shape[:2], dtype=bool), np.zeros((len(lows), len(item)), dtype=bool)
        rows = np.broadcast_to(np.arange(len(lows))[:, None], d.shape[:2])
        for k in range(4):
            vocabulary, own = np.unique(item[:, k], return_inverse=True)
            at = np.minimum(np.searchsorted(vocabulary, d[:, :, k]), len(vocabulary) - 1)
            hit = (vocabulary[at] == d[:, :, k]) & (d[:, :, k] != 0)
            like |= hit
            there = np.zeros((len(lows), len(vocabulary)), dtype=bool)
            there[rows[hit], at[hit]] = True
            have |= there[:, own]
        able = np.minimum(like.sum(1), have.sum(1)) >= need
        if not able.all():
            best = np.zeros(len(lows))
            if able.any():
                best[able] = local_scores(doc, lows[able], width, item, first[able], end[able], 0.0, gap, miss)
            return best
    ramp = gap * np.arange(width)
    h = np.zeros((len(lows), width + 1))
    best = np.zeros(len(lows))
    for w in item:
        like = np.full(d.shape[:2], -miss)
        for k in (3, 2, 1):
            if w[k]:
                like[d[:, :, k] == w[k]] = 0.8
        like[d[:, :, 0] == w[0]] = 1.0
        new = np.maximum(np.maximum(h[:, :-1] + like, h[:, 1:] - gap), 0.0)
        new = np.maximum.accumulate(new + ramp, axis=1) - ramp
        best = np.maximum(best, new.max(1))
        h = np.concatenate([np.zeros((len(lows), 1)), new], axis=1)
    return best


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, score): documents that hold a stretch of an item; score is the aligned share of the item.

    The items are the query set: in blocks of ``BLOCK`` they are held against all documents, so documents are read once
    a block and never shuffled. Whole texts and all windows take part. NULL or empty texts have no leaks; equal
    documents are reported each; items shorter than a window are held against every place where one of their words stands."""
    q = items.where(F.col(text).isNotNull()).select(item_id, text).dropDuplicates([item_id])
    kind = docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"{doc_id} {kind[0]}, {item_id} {kind[1]}, score double"
    rows = sorted((tuple(r) for r in q.toLocalIterator()), key=lambda r: r[0])  # the stated query set
    prefixes = task_prefixes([r[1] for r in rows])
    out = None
    for i in range(0, max(len(rows), 1), BLOCK):
        part = docs.select(doc_id, text).mapInPandas(_scan([r[0] for r in rows[i : i + BLOCK]], [r[1] for r in rows[i : i + BLOCK]], prefixes, share, doc_id, item_id, text), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(doc_id, item_id).agg(F.max("score").alias("score"))


def _scan(ids: list, texts: list[str], prefixes: set[str], share: float, doc_id: str, item_id: str, text: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, h = Items(ids, texts, prefixes), _Hasher()
        pad = np.zeros((WINDOW, 4), dtype=np.uint64)
        for pdf in batches:
            sizes = pdf[text].str.len().fillna(0).cumsum().to_numpy()
            piece = (sizes // PIECE_CHARS).astype(int) if len(pdf) else np.zeros(0, int)
            for lo, hi in zip(np.flatnonzero(np.r_[True, np.diff(piece) > 0]) if len(pdf) else [], [*np.flatnonzero(np.diff(piece) > 0) + 1, len(pdf)]):
                own, keys = [], pdf[doc_id].iloc[lo:hi].tolist()
                for t in pdf[text].iloc[lo:hi]:
                    own += [h(words(t)), pad]
                if not own:
                    continue
                flat = np.concatenate(own)
                ends = np.cumsum([len(x) for x in own])[1::2]
                firsts = np.concatenate([[0], ends[:-1]])
                item, begin, at = candidates(flat, index)
                doc = np.searchsorted(ends, at, "right")
                found: dict[tuple, float] = {}
                for i in np.unique(item):
                    s = index.symbols[i]
                    width = int(len(s) * 1.6) + 24
                    mine = item == i
                    lows = np.maximum(begin[mine] - len(s) // 4 - 8, firsts[doc[mine]]) // 16 * 16
                    pairs = np.unique(np.stack([doc[mine], lows], 1), axis=0)
                    for a in range(0, len(pairs), 512):
                        p = pairs[a : a + 512]
                        for (k, _), v in zip(p, local_scores(flat, p[:, 1], width, s, firsts[p[:, 0]], ends[p[:, 0]], share * len(s)) / max(len(s), 1)):
                            if v >= share:
                                found[k, i] = max(found.get((k, i), 0.0), v)
                yield pd.DataFrame([(keys[k], ids[i], round(float(v), 4)) for (k, i), v in found.items()], columns=[doc_id, item_id, "score"])

    return scan
