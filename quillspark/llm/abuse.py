"""Abusive, hateful or sexual content: a subsequence string-kernel SVM with Nyström landmarks on labelled sentences.

The kernel counts common subsequences of three characters (span of up to SPAN, each place of span weighted by DECAY)
and of one or two words. With a bounded span its feature map is finite, so the weights that the SVM gives to Nyström
landmarks fold into one weight a subsequence, and a sentence is scored by adding weights, without kernel evaluations.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm import confusables

SPAN = 6
DECAY = 0.75
WORD_SPAN = 4
WORD_DIMS = 1 << 16
CHAR_DIMS = 32**3
#: Bounds of the fitted sample: toxic and clean labelled documents (by hash of their id), their characters in all, which
#: bound the sentences and so the memory and time of the fit whatever the length of documents, and landmarks
#: with the sentences of either label that they are chosen from.
LABELLED = 1500
CLEAN = 2000
SAMPLE_CHARS = 6_000_000
LANDMARKS = 440
POOL = 2000
ROUNDS = 3
PIECE = 1000
#: Cosine above which two sentences count as near.
NEAR = 0.55

_PLAIN = re.compile(r"[^\x00-ɏ‘-”«»…–—]")
_LEET = str.maketrans("013457@$", "oieastas")
_MIXED = re.compile(r"\S*(?:[^\W\d_][0134579@$]|[0134579@$][^\W\d_])\S*")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_·-]{1,2}){2,}[^\W\d_](?![^\W_])")
_RUN = re.compile(r"([^\W\d_])\1{2,}")
_SENTENCE = re.compile(r"(?<=[.!?…])['\"”’»)]*\s+|\n+")


def fold(text: str) -> str:
    """Look-alikes, widths, invisible characters, accents, case, digits for letters, spaced-out and stretched words."""
    if _PLAIN.search(text) or "­" in text:
        text = text.translate(confusables.plain_table())
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = text.lower()
    text = _MIXED.sub(lambda m: m[0].translate(_LEET) if sum(c.isalpha() for c in m[0]) * 3 >= len(m[0].strip(".,!?;:")) else m[0], text)
    text = _SPACED.sub(lambda m: re.sub(r"[ .*_·-]", "", m[0]), text)
    return _RUN.sub(lambda m: m[1] * 3 if m[1] == "x" else m[1], text)


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()] if text else []


_CODES = np.full(256, 28, dtype=np.int64)
_CODES[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CODES[ord(" ")] = 27
_CODES[ord("0") : ord("9") + 1] = 29
_CODES[[ord("!"), ord("?")]] = 30
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_WORD = re.compile(r"[a-z0-9]+")


def _word_hash(w: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest("0" if w.isdigit() else w)


class Features:
    """The explicit kernel features of a batch of folded sentences: index, weight and sentence of each occurrence."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, folded: list[str]) -> Iterator[tuple[int, np.ndarray, float | np.ndarray, np.ndarray]]:
        raw = [s.encode("latin-1", "replace") for s in folded]
        lengths = np.array([len(r) for r in raw], dtype=np.int64)
        chars = _CODES[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        own = np.repeat(np.arange(len(raw)), lengths)
        for a, b in _OFFSETS:
            n = len(chars) - b
            if n > 0:
                same = own[:n] == own[b:]
                idx = (chars[:n] * 32 + chars[a : a + n]) * 32 + chars[b:]
                yield 0, idx[same], DECAY ** (b - 2), own[:n][same]
        known = self.known
        if len(known) > 300_000:
            known.clear()
        words, owner = [], []
        for i, s in enumerate(folded):
            for w in _WORD.findall(s):
                h = known.get(w)
                if h is None:
                    h = known[w] = _word_hash(w)
                words.append(h)
                owner.append(i)
        w, o = np.array(words, dtype=np.uint64), np.array(owner, dtype=np.int64)
        yield 1, (w % WORD_DIMS).astype(np.int64), 1.0, o
        for k in range(1, WORD_SPAN):
            n = len(w) - k
            if n > 0:
                same = o[:n] == o[k:]
                pair = (w[:n] * np.uint64(0x9E3779B1) + w[k:] * np.uint64(0x85EBCA77) + np.uint64(7)) % WORD_DIMS
                yield 1, pair.astype(np.int64)[same], DECAY ** (k - 1), o[:n][same]


def _score(folded: list[str], weights: tuple[np.ndarray, np.ndarray], bias: float, features: Features) -> np.ndarray:
    n = len(folded)
    top, norm = np.zeros((2, n)), np.zeros((2, n))
    for block, idx, weight, own in features(folded):
        top[block] += weight * np.bincount(own, weights[block][idx], n)
        norm[block] += weight**2 * np.bincount(own, minlength=n)
    return (top / np.sqrt(np.maximum(norm, 1e-9))).sum(0) + bias


def _landmarks(pool: _Matrix, m: int, dims: int) -> list[int]:
    """The ``m`` sentences of a pool that span the kernel best: greedily the one that those before explain least."""
    n, idx, val = len(pool), pool.idx, pool.val
    own = np.repeat(np.arange(n), np.diff(pool.cut))
    left = np.bincount(own, val.astype(np.float64) ** 2, n)
    g = np.zeros((n, m), dtype=np.float32)
    chosen: list[int] = []
    for j in range(min(m, n)):
        i = int(left.argmax())
        if left[i] < 1e-3:
            break
        chosen.append(i)
        pivot = np.zeros(dims, dtype=np.float32)
        pivot[pool[i][0]] = pool[i][1]
        col = np.bincount(own, pivot[idx] * val, n) - g[:, :j] @ g[i, :j]
        g[:, j] = col / np.sqrt(left[i])
        left = np.maximum(left - g[:, j].astype(np.float64) ** 2, 0.0)
        left[i] = 0.0
    return chosen


class _Matrix:
    """Sparse normalised feature vectors in three arrays; word features follow the character features."""

    def __init__(self, folded: list[str]):
        parts = [_rows(folded[lo : lo + 1000]) for lo in range(0, len(folded), 1000)]
        self.cut = np.concatenate([[0], np.cumsum(np.concatenate([p[2] for p in parts]))]) if parts else np.zeros(1, int)
        self.idx = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int32)
        self.val = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.float32)

    def __len__(self) -> int:
        return len(self.cut) - 1

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.idx[self.cut[i] : self.cut[i + 1]], self.val[self.cut[i] : self.cut[i + 1]]


def _rows(folded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(folded)
    parts, norm = [], np.zeros((2, n))
    for block, idx, weight, own in Features()(folded):
        parts.append((idx + block * CHAR_DIMS, np.full(len(idx), weight, dtype=np.float32), own, block))
        norm[block] += weight**2 * np.bincount(own, minlength=n)
    idx, val, own = (np.concatenate([p[i] for p in parts]) for i in range(3))
    block = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
    val = val / np.sqrt(np.maximum(norm[block, own], 1e-9)).astype(np.float32)
    key = own * (CHAR_DIMS + WORD_DIMS) + idx
    order = np.argsort(key, kind="stable")
    key, val = key[order], val[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    val, key = np.add.reduceat(val, first), key[first]
    return (key % (CHAR_DIMS + WORD_DIMS)).astype(np.int32), val.astype(np.float32), np.bincount(key // (CHAR_DIMS + WORD_DIMS), minlength=n)


def _svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the active set."""
    x = np.hstack([z, np.ones((len(z), 1), dtype=z.dtype)])
    w = np.zeros(x.shape[1])
    reg = ridge * np.eye(x.shape[1])
    reg[-1, -1] = 1e-3
    for _ in range(25):
        active = y * (x @ w.astype(x.dtype)) < 1
        a = x[active] * np.sqrt(cost[active, None]).astype(x.dtype)
        new = np.linalg.solve((a.T @ a).astype(np.float64) + reg, (a.T @ (y[active] * np.sqrt(cost[active])).astype(x.dtype)).astype(np.float64))
        if np.abs(new - w).max() < 1e-4:
            break
        w = new
    return w[:-1], float(w[-1])


class Model:
    """Weights of all kernel features, folded from the landmarks."""

    def __init__(self, chars: np.ndarray, words: np.ndarray, bias: float):
        self.weights, self.bias = (chars, words), bias

    def score(self, raw: list[str], features: Features) -> np.ndarray:
        return _score([fold(s) for s in raw], self.weights, self.bias, features) if raw else np.zeros(0)


def fit(documents: list[tuple[list[str], float]], terms: list[str], clean_weight: float = 1.0) -> Model | None:
    """Train on labelled documents as bags of sentences: (sentences, label of 0 or 1 or a share between).

    A document's label says that some sentence is abusive, not which, and raters err. A sentence of a toxic document is
    positive if most sentences near it in kernel space stand in other toxic documents, negative if they stand in clean
    ones as well; of a toxic document's sentences without near ones the best may be positive: first by how particular
    its words are to toxic documents and by the word list, then by the model. ``clean_weight``: how many times as many
    documents a clean one of the sample stands for as a toxic one. None if either label is missing."""
    bags = [([fold(s) for s in ss], label) for ss, label in documents if ss and label != 0.5]
    if not any(v > 0.5 for _, v in bags) or not any(v < 0.5 for _, v in bags):
        return None
    text: list[str] = []
    bag: list[int] = []
    for i, (ss, _) in enumerate(bags):
        text += ss
        bag += [i] * len(ss)
    bag_of, label = np.array(bag), np.array([v > 0.5 for _, v in bags])
    toxic = label[bag_of]
    n = len(text)
    rnd = np.random.default_rng(5)
    dims = CHAR_DIMS + WORD_DIMS
    # words particular to toxic documents; features are made in pieces and not kept
    seen = np.zeros((2, dims))
    for lo in range(0, n, PIECE):
        idx, _, size = _rows(text[lo : lo + PIECE])
        own = np.repeat(toxic[lo : lo + PIECE], size)
        word = idx >= CHAR_DIMS
        for t in (0, 1):
            seen[t] += np.bincount(idx[word & (own == bool(t))], minlength=dims)
    odds = np.log((seen[1] + 0.2) / (seen[1].sum() + 1)) - np.log((seen[0] + 0.2) / (seen[0].sum() + 1))
    novelty = np.full(n, -9.0)
    for lo in range(0, n, PIECE):
        idx, _, size = _rows(text[lo : lo + PIECE])
        word, own = idx >= CHAR_DIMS, np.repeat(np.arange(len(size)), size)
        many = np.bincount(own[word], minlength=len(size))
        mean = np.bincount(own[word], odds[idx[word]], len(size)) / np.maximum(many, 1)
        novelty[lo : lo + PIECE] = np.where(many > 0, mean, -9.0)
    listed = re.compile(r"\b(?:" + "|".join(re.escape(fold(t)) for t in terms) + r")") if terms else None
    hit = np.array([bool(listed and listed.search(t)) for t in text])
    current = novelty + hit

    def best_of_bags(score: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The best sentence of each bag that ``among`` has sentences of."""
        order = among[np.lexsort((among, -score[among], bag_of[among]))]
        return order[np.r_[True, np.diff(bag_of[order]) > 0]] if len(order) else order

    in_toxic, in_clean = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    first = best_of_bags(current, np.flatnonzero(toxic))
    rest = np.setdiff1d(np.arange(n), first)
    pools = [rnd.permutation(p)[:POOL] for p in (first, rest)]
    marked = [_Matrix([text[i] for i in p]) for p in pools]
    picked = [_landmarks(m, LANDMARKS // 2, dims) for m in marked]
    chosen = [m[i] for m, p in zip(marked, picked) for i in p]
    used = np.unique(np.concatenate([c[0] for c in chosen]))
    at = np.zeros(dims, dtype=np.int32)  # row of a feature among those that landmarks have; row 0 is empty
    at[used] = np.arange(1, len(used) + 1)
    marks = np.zeros((len(used) + 1, len(chosen)), dtype=np.float32)
    for i, (idx, val) in enumerate(chosen):
        marks[at[idx], i] = val
    among = np.stack([val @ marks[at[idx]] for idx, val in chosen]).astype(np.float64)
    del marked, chosen
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    keep = values > 1e-4 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.empty((n, root.shape[1]), dtype=np.float32)
    for lo in range(0, n, PIECE):
        idx, val, size = _rows(text[lo : lo + PIECE])
        cut = np.concatenate([[0], np.cumsum(size)])
        k = np.stack([val[a:b] @ marks[at[idx[a:b]]] for a, b in zip(cut, cut[1:])])
        z[lo : lo + PIECE] = k @ root.astype(np.float32)
    # of a sentence's nearest sentences in other documents, the share in toxic ones: high for abuse, low for decoys
    length = np.maximum(np.linalg.norm(z, axis=1), 1e-6)
    share, near = np.zeros(n), np.zeros(n, dtype=int)
    for lo in range(0, n, 250):
        like = (z[lo : lo + 250] / length[lo : lo + 250, None]) @ z.T > NEAR * length[None, :]
        like &= bag_of[lo : lo + 250, None] != bag_of[None, :]
        bad = like[:, toxic].sum(1)
        near[lo : lo + 250] = like.sum(1)
        share[lo : lo + 250] = bad / np.maximum(bad + clean_weight * (near[lo : lo + 250] - bad), 1e-9)
    known = near >= 3
    y = np.where(toxic, 0.0, -1.0)
    y[known & (share < 0.6)] = -1.0
    y[known & (share >= 0.75)] = np.where(toxic[known & (share >= 0.75)], 1.0, 0.0)
    rare = best_of_bags(current, np.flatnonzero(toxic & ~known & (current > 0.5)))
    has = np.zeros(len(bags), bool)
    has[bag_of[y > 0]] = True
    y[rare[~has[bag_of[rare]]]] = 1.0
    w, b = np.zeros(z.shape[1]), 0.0
    for step in range(ROUNDS):
        pos, neg = np.flatnonzero(y > 0), np.flatnonzero(y < 0)
        if not len(pos) or not len(neg):
            return None
        use = np.concatenate([pos, neg])
        cost = np.where(y[use] > 0, len(use) / (2 * len(pos)), len(use) / (2 * len(neg))) ** 0.5
        w, b = _svm(z[use], y[use], cost)
        score = z @ w + b
        has[:] = False
        has[bag_of[(y > 0) | (toxic & (score > 0.3) & ~(known & (share < 0.6)))]] = True
        loose = toxic & ~known
        y[loose] = np.where(score[loose] > 0.3, 1.0, np.where(score[loose] < -0.6, -1.0, 0.0))
        more = best_of_bags(score, np.flatnonzero(loose & ~has[bag_of] & (score > -0.3)))
        y[more] = 1.0
    v = np.zeros(dims)
    v[used] = (marks @ (root @ w).astype(np.float32))[1:]
    return Model(v[:CHAR_DIMS], v[CHAR_DIMS:], b)


def train(documents: DataFrame, labels: DataFrame, terms: DataFrame | None = None, limit: int = LABELLED, clean: int = CLEAN, least_weight: float = 2, chars: int = SAMPLE_CHARS) -> Model | None:
    """Fit on at most ``limit`` toxic and ``clean`` clean labelled documents, the first by hash of their id, as far as they have ``chars``
    characters in all. Copied ratings count once, a document's label is the majority of its raters, ties and NULL ratings don't count.
    Either label's documents of the sample stand for all of that label, so the share of toxic ones near a sentence is that of the whole table.
    ``terms`` only mark which sentences start as positive; those with a weight below ``least_weight`` or NULL aren't used."""
    votes = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "toxic", "rater", "rated_at").distinct().groupBy("doc_id").agg(F.avg("toxic").alias("y"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    few = votes.where("y > 0.5").orderBy(*order).limit(limit).unionAll(votes.where("y < 0.5").orderBy(*order).limit(clean))
    one = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.max("text").alias("text"))  # at most ``limit`` + ``clean`` rows
    rows = one.withColumn("__n", F.sum(F.length("text")).over(Window.orderBy(*order))).where(F.col("__n") <= chars).collect()
    data = [(sentences(r["text"]), float(r["y"])) for r in sorted(rows, key=lambda r: r["doc_id"])]
    words = [r["term"] for r in terms.where(F.col("term").isNotNull() & (F.col("weight") >= least_weight)).select("term").distinct().collect()] if terms is not None else []
    every = votes.agg(F.count_if(F.col("y") > 0.5), F.count_if(F.col("y") < 0.5)).first()
    toxic_for, clean_for = (n / max(k, 1) for n, k in zip(every, (sum(v > 0.5 for _, v in data), sum(v < 0.5 for _, v in data))))
    return fit(data, sorted(words), clean_for / toxic_for if toxic_for else 1.0)


def score_documents(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id", "source")) -> DataFrame:
    """Add to ``keep``: ``score`` (of the worst sentence; positive: abusive), ``sentence`` (that sentence) and ``n_bad``
    (sentences above 0). Whole texts are scored. NULL and empty texts, and no model: score NULL, sentence NULL, 0."""
    from pyspark.sql import types as T

    out = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("sentence", T.StringType()), T.StructField("n_bad", T.IntegerType())])
    features = Features()

    @F.pandas_udf(out)
    def score(texts: pd.Series) -> pd.DataFrame:
        rows: list[tuple] = []
        for lo in range(0, len(texts), 200):
            split = [sentences(t) for t in texts.iloc[lo : lo + 200]]
            flat = [s for ss in split for s in ss]
            got, at = model.score(flat, features) if model else np.zeros(0), 0
            for ss in split:
                own = got[at : at + len(ss)]
                at += len(ss)
                rows.append((float(own.max()), ss[int(own.argmax())], int((own > 0).sum())) if len(own) else (None, None, 0))
        return pd.DataFrame(rows, columns=["score", "sentence", "n_bad"])

    return documents.select(*keep, score("text").alias("s")).select(*keep, "s.*")


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """(``by``, documents, abusive, rate); NULL ``by`` is a group of its own."""
    return scored.groupBy(by).agg(F.count("*").alias("documents"), F.count_if(F.col("score") > 0).alias("abusive")).withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))


