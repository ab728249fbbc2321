"""Quantities recorded in different units: a hidden Markov model with the unit as hidden state.

Two forms share one model. ``decode_series`` decodes the readings of each device as one series, of any length: series are
cut by range and joined again by max-plus transfer matrices. Readings may be grouped in entries, as the measures of one
text: ``series_heights`` decodes the texts of a source so. ``decode_text`` decodes each text alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.session import materialize

OTHER = "other"


@dataclass(frozen=True)
class UnitModel:
    """``factors``: unit -> size in canonical units. ``mean``, ``spread``: level of the quantity, spread on a log scale.
    ``jump``: spread of the log level between neighbouring readings; between readings of different entries, which are of
    different things and often of different hands, the ``entry_`` values hold. Costs are negative log probabilities."""

    factors: dict = field(default_factory=lambda: {"m": Fraction(100), "cm": Fraction(1), "mm": Fraction(1, 10), "ft": Fraction(3048, 100), "in": Fraction(254, 100)})
    mean: float = 173.0
    spread: float = 0.12
    jump: float = 0.02
    wrong_hint: float = 16.0
    no_hint: float = 2.0
    off_level: float = 7.0
    switch: float = 0.7
    most_jump: float = 5.0
    entry_jump: float = 0.1
    entry_switch: float = 0.1
    entry_most_jump: float = 1.0
    entry_other: float = 0.3

    @property
    def states(self) -> list[str]:
        return [*self.factors, OTHER]


HEIGHT = UnitModel()

#: The words that name a unit.
UNIT_WORDS = {
    "m": "m", "metre": "m", "metres": "m", "meter": "m", "meters": "m", "mètre": "m", "mètres": "m", "metro": "m", "metros": "m",
    "cm": "cm", "centimetre": "cm", "centimetres": "cm", "centimeter": "cm", "centimeters": "cm", "zentimeter": "cm", "centimètres": "cm", "centímetros": "cm",
    "mm": "mm", "millimetre": "mm", "millimetres": "mm", "millimeter": "mm", "millimeters": "mm",
    "ft": "ft", "feet": "ft", "foot": "ft", "'": "ft", "in": "in", "inch": "in", "inches": "in", '"': "in",
    "kg": OTHER, "kgs": OTHER, "kilogram": OTHER, "kilograms": OTHER, "lb": OTHER, "lbs": OTHER, "pounds": OTHER, "st": OTHER, "stone": OTHER, "g": OTHER, "km": OTHER, "s": OTHER, "%": OTHER,
}
FRACTIONS = {"½": Fraction(1, 2), "¼": Fraction(1, 4), "¾": Fraction(3, 4)}

_QUOTES = str.maketrans({"’": "'", "‘": "'", "′": "'", "”": '"', "“": '"', "″": '"', " ": " ", " ": " "})
_NUM = r"\d{1,3}(?:,\d{3})+(?![\d])|\d+(?:[.,]\d+)?"
_FRACTION = r"\s*(?:[½¼¾]|(?<=\s)\d/\d)"
_FEET = re.compile(rf"(\d+)(?:[\s-]*(?:feet|foot|ft)\.?|')[\s-]*(?:and\s+)?(\d+(?:\.\d+)?)?({_FRACTION})?\s*(?:inches|inch|in\b|\"|'')?", re.I)
_TEMPLATE = re.compile(r"\{\{\s*(?:height|convert|cvt)\s*\|([^{}]*)\}\}", re.I)
_DROP = re.compile(r"\{\{[^{}]*\}\}|<ref[^>]*>.*?</ref>|<[^>]*>|\[\d+\]", re.S)
_METRE_CM = re.compile(r"(?<![\d.,])([12])\s*m\s*(\d{2})(?!\d)", re.I)
_PLAIN = re.compile(rf"(?<![\d.,])({_NUM})({_FRACTION})?\s*-?\s*([^\W\d_]+|'|\"|%)?")


def _number(s: str) -> Fraction:
    if re.fullmatch(r"\d{1,3}(?:,\d{3})+", s):
        return Fraction(s.replace(",", ""))
    return Fraction(s.replace(",", "."))


def _fraction(s: str | None) -> Fraction:
    s = (s or "").strip()
    return FRACTIONS[s] if s in FRACTIONS else Fraction(s) if "/" in s and s[-1] != "0" else Fraction(0)


def _unfold(m: re.Match) -> str:
    """A height or convert template as plain text."""
    parts = [p.strip() for p in m[1].split("|")]
    named = dict(p.split("=", 1) for p in parts if "=" in p)
    out = [f"{named[k].strip()} {k}" for k in ("m", "cm", "mm", "ft", "in") if k in named and k not in ("ft", "in")]
    if "ft" in named:
        out.append(f"{named['ft'].strip()} ft {named.get('in', '0').strip()} in")
    elif "in" in named:
        out.append(f"{named['in'].strip()} in")
    plain = [p for p in parts if "=" not in p]
    if not out and len(plain) >= 2:
        out.append(f"{plain[0]} {plain[1]}")
    return " " + ", ".join(out) + " "


def measures(text: str | None) -> list[tuple[Fraction, str]]:
    """The numbers of a text in order, each with the unit named beside it (``''``: none). Feet and inches are one measure in inches."""
    if not text:
        return []
    t = "".join(c if c in FRACTIONS else unicodedata.normalize("NFKC", c) for c in text.translate(_QUOTES))
    t = _DROP.sub(" ", _TEMPLATE.sub(_unfold, t))
    found: list[tuple[int, Fraction, str]] = []

    def take(at: int, value: Fraction, unit: str) -> str:
        found.append((at, value, unit))
        return ""

    def feet(m: re.Match) -> str:
        if m[2] is None and not (m[3] or "").strip():
            return m[0]
        take(m.start(), int(m[1]) * 12 + (Fraction(m[2]) if m[2] else 0) + _fraction(m[3]), "in")
        return " " * len(m[0])

    def metres(m: re.Match) -> str:
        take(m.start(), Fraction(int(m[1]) * 100 + int(m[2])), "cm")
        return " " * len(m[0])

    t = _METRE_CM.sub(metres, _FEET.sub(feet, t))
    for m in _PLAIN.finditer(t):
        word = (m[3] or "").lower()
        take(m.start(), _number(m[1]) + _fraction(m[2]), UNIT_WORDS.get(word, ""))
    return [(v, u) for _, v, u in sorted(found, key=lambda x: x[0])]


class _Kernel:
    """Costs of one model as arrays."""

    def __init__(self, model: UnitModel):
        self.m = model
        self.states = model.states
        self.logf = np.array([math.log(float(f)) for f in model.factors.values()])
        k = len(self.states)
        self.base = np.full((k, k), model.switch)
        np.fill_diagonal(self.base, 0.0)
        self.base[-1, :] = self.base[:, -1] = 0.0

    def emit(self, value: float, hint: str | None) -> np.ndarray:
        """Score of each state for one reading; a value of zero or less, or NaN, can only be the other state."""
        m, k = self.m, len(self.states)
        out = np.full(k, -1e9)
        out[-1] = -m.off_level
        if value > 0 and math.isfinite(value):
            out[:-1] = -((math.log(value) + self.logf - math.log(m.mean)) ** 2) / (2 * m.spread**2)
        if hint in self.states:  # a unit beside a number is rarely wrong, but may belong to another quantity
            at = self.states.index(hint)
            out[:-1] -= np.where(np.arange(k - 1) == at, 0.0, m.wrong_hint)
            out[-1] -= 0.0 if at == k - 1 else 1.0
        else:
            out -= m.no_hint
        return out

    def move(self, a: float, b: float) -> np.ndarray:
        """Score of each pair of states between readings a and b: unit switches, and jumps of the level."""
        out = -self.base.copy()
        if a > 0 and b > 0:
            jump = (math.log(b) + self.logf)[None, :] - (math.log(a) + self.logf)[:, None]
            out[:-1, :-1] -= np.minimum(jump**2 / (2 * self.m.jump**2), self.m.most_jump)
        return out

    def forward(self, values: list[float], hints: list, start: np.ndarray | None = None, before: float | None = None) -> np.ndarray:
        a, rows = start, []
        for i, (v, h) in enumerate(zip(values, hints)):
            e = self.emit(v, h)
            a = e if a is None else e + (a[:, None] + self.move(before if i == 0 else values[i - 1], v)).max(0)
            rows.append(a)
        return np.array(rows)

    def backward(self, values: list[float], hints: list, end: np.ndarray | None = None, after: tuple | None = None) -> np.ndarray:
        n, k = len(values), len(self.states)
        rows = np.zeros((n, k))
        if end is not None:
            rows[-1] = (self.move(values[-1], after[0]) + end[None, :]).max(1)
        for i in range(n - 2, -1, -1):
            rows[i] = (self.move(values[i], values[i + 1]) + (self.emit(values[i + 1], hints[i + 1]) + rows[i + 1])[None, :]).max(1)
        return rows

    def emissions(self, values: np.ndarray, hints: list) -> np.ndarray:
        """``emit`` of many readings at once, readings x states."""
        m, k = self.m, len(self.states)
        at = np.array([self.states.index(h) if h in self.states else -1 for h in hints], dtype=int)
        out = np.full((len(values), k), -1e9)
        out[:, -1] = -m.off_level
        real = (values > 0) & np.isfinite(values)
        out[real, :-1] = -((np.log(values[real])[:, None] + self.logf - math.log(m.mean)) ** 2) / (2 * m.spread**2)
        hinted = at >= 0
        out[hinted, :-1] -= np.where(np.arange(k - 1) == at[hinted, None], 0.0, m.wrong_hint)
        out[hinted, -1] -= np.where(at[hinted] == k - 1, 0.0, 1.0)
        out[~hinted] -= m.no_hint
        return out

    def moves(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray, other: np.ndarray) -> np.ndarray:
        """``move`` between each reading of ``a`` and of ``b``; ``apart``: they are of different entries, ``other``: of different
        devices, which have nothing to do with each other."""
        m, k = self.m, len(self.states)
        loose = np.full((k, k), m.entry_switch)
        np.fill_diagonal(loose, 0.0)
        loose[-1, :] = loose[:, -1] = m.entry_other
        out = np.where(apart[:, None, None], -loose, -self.base)
        both = (a > 0) & (b > 0)
        jump = (np.log(b[both])[:, None, None] + self.logf) - (np.log(a[both])[:, None, None] + self.logf[:, None])
        wide = apart[both, None, None]
        out[both, :-1, :-1] -= np.minimum(jump**2 / (2 * np.where(wide, m.entry_jump, m.jump) ** 2), np.where(wide, m.entry_most_jump, m.most_jump))
        out[other] = 0.0
        return out

    def best(self, values: list[float], hints: list) -> list[str]:
        score = self.forward(values, hints) + self.backward(values, hints)
        return [self.states[i] for i in score.argmax(1)]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of matrices."""
    return (a[..., :, :, None] + b[..., None, :, :]).max(-2)


def _product(steps: np.ndarray) -> np.ndarray:
    """The max-plus product of a row of matrices, by halves."""
    k = steps.shape[-1]
    if not len(steps):
        return np.where(np.eye(k) > 0, 0.0, -np.inf)
    while len(steps) > 1:
        odd = steps[len(steps) // 2 * 2 :]
        steps = np.concatenate([_times(steps[0 : len(steps) // 2 * 2 : 2], steps[1::2]), odd])
    return steps[0]


def _chain(steps: np.ndarray, start: np.ndarray) -> np.ndarray:
    """start, start x steps[0], start x steps[0] x steps[1] and so on, worked out for many stretches at once."""
    n, k = len(steps), len(start)
    length = max(1, math.isqrt(n))
    many = -(-n // length) if n else 0
    pad = np.broadcast_to(np.where(np.eye(k) > 0, 0.0, -np.inf), (many * length - n, k, k))
    parts = np.concatenate([steps, pad]).reshape(many, length, k, k)
    whole = parts[:, 0] if many else parts.reshape(0, k, k)
    for j in range(1, length):
        whole = _times(whole, parts[:, j])
    heads = [start]
    for w in whole[:-1]:
        heads.append((heads[-1][:, None] + w).max(0))
    at, rows = np.array(heads), []
    for j in range(length):
        at = (at[:, :, None] + parts[:, j]).max(1) if many else at
        rows.append(at)
    return np.concatenate([start[None], np.stack(rows, 1).reshape(-1, k)[:n]]) if many else start[None]


#: The numbers of a text with the unit beside each and, for each unit of the model, the whole canonical number.
_READINGS = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("hint", T.StringType()), T.StructField("rounded", T.ArrayType(T.LongType()))]))


def readings(df: DataFrame, text: str, model: UnitModel = HEIGHT) -> DataFrame:
    """One row a number of the text, in text order: adds ``pos``, ``value``, ``hint`` (the unit beside it, '' for none) and
    ``rounded``, for each unit of the model the canonical number in halves up, worked out in exact fractions (NULL above
    10^12). NULL, empty and number-free texts give no rows; existing columns of these names are replaced."""

    @F.pandas_udf(_READINGS)
    def found(texts: pd.Series) -> pd.Series:
        known: dict = {}

        def one(s):
            if s not in known:
                known[s] = [(float(v), u, [math.floor(v * f + Fraction(1, 2)) if v < 10**12 else None for f in model.factors.values()]) for v, u in measures(s) if v < 10**300]
            return known[s]

        return texts.map(one, na_action=None)

    rest = [c for c in df.columns if c not in ("pos", "value", "hint", "rounded")]
    return df.select(*rest, F.posexplode(found(F.col(text).cast("string"))).alias("pos", "__r")).select(*rest, "pos", "__r.value", "__r.hint", "__r.rounded")


def decode_text(df: DataFrame, text: str, out: str = "measures", model: UnitModel = HEIGHT) -> DataFrame:
    """Add ``out``, an array of (value, unit, canonical, rounded) with one entry a measure of the text, in text order.

    ``unit`` is the decoded unit, ``other`` for what isn't this quantity; ``canonical`` is in canonical units and
    ``rounded`` the whole number, halves up, worked out in exact fractions; both NULL for ``other``. NULL, empty and
    number-free texts give an empty array. Other columns and rows stay as they are; an existing ``out`` is replaced."""
    schema = T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("canonical", T.DoubleType()), T.StructField("rounded", T.LongType())]))

    @F.pandas_udf(schema)
    def decode(texts: pd.Series) -> pd.Series:
        kernel, known = _Kernel(model), {}

        def one(s):
            if s not in known:
                found = measures(s)
                units = kernel.best([float(v) for v, _ in found], [u for _, u in found]) if found else []
                known[s] = [(float(v), u, *((float(c := v * model.factors[u]), math.floor(c + Fraction(1, 2))) if u != OTHER else (None, None))) for (v, _), u in zip(found, units)]
            return known[s]

        return texts.map(one, na_action=None)

    return df.withColumn(out, decode(F.col(text).cast("string")))


#: Readings a task of ``decode_series`` holds at once.
TASK_ROWS = 25_000


def decode_series(df: DataFrame, device: str, order: str | Sequence[str], value: str, hint: str | None = None, model: UnitModel = HEIGHT, entry: str | None = None) -> DataFrame:
    """Decode the unit of every reading: adds ``unit`` and ``canonical`` (NULL for ``other``) to each row.

    One hidden Markov model a device, over its readings by ``order``; neighbours of different ``entry``, if given, are
    tied more loosely. Rows are range-partitioned by (device, order), ties by their place in the input, into as many
    tasks as ``TASK_ROWS`` asks for, so a device of any size spreads over tasks and none grows with the data; each task
    sends one max-plus transfer matrix and gets back the best scores that reach it from either side. NULL devices form
    one device, NULL or non-positive values decode to ``other``, rows equal in order keep an arbitrary order. Nothing is
    dropped; existing columns ``unit`` and ``canonical`` are replaced."""
    by = [order] if isinstance(order, str) else list(order)
    src = df.drop("unit", "canonical").withColumns({
        "__v": F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))), "__h": F.col(hint).cast("string") if hint else F.lit(None).cast("string"), "__d": F.coalesce(F.col(device).cast("string"), F.lit("\u0000")),
        "__e": F.coalesce(F.col(entry).cast("string"), F.lit("")) if entry else F.lit(""), "__t": F.monotonically_increasing_id(),
    })
    tasks = max(1, -(-src.count() // TASK_ROWS))
    cut = src.repartitionByRange(tasks, "__d", *by, "__t").sortWithinPartitions("__d", *by, "__t").withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()}).drop("__t")
    cut = materialize(cut)  # the cuts stay the same for both passes
    kernel = _Kernel(model)

    def steps(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        v, d, e = pdf["__v"].fillna(float("nan")).to_numpy(dtype=float), pdf["__d"].to_numpy(), pdf["__e"].to_numpy()
        first = kernel.emissions(v, pdf["__h"].tolist())
        return v, first, kernel.moves(v[:-1], v[1:], e[1:] != e[:-1], d[1:] != d[:-1]) + first[1:, None, :]

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i", kind="stable")
        v, first, s = steps(pdf)
        row = [int(pdf["__p"].iloc[0]), *pdf["__d"].iloc[[0, -1]], *pdf["__e"].iloc[[0, -1]], v[0], v[-1], (first[0][:, None] + _product(s)).ravel().tolist()]
        return pd.DataFrame([row], columns=["p", "d0", "d1", "e0", "e1", "v0", "v1", "mat"])

    need = cut.select("__p", "__i", "__v", "__h", "__d", "__e")
    got = sorted((r.asDict() for r in need.groupBy("__p").applyInPandas(ends, "p int, d0 string, d1 string, e0 string, e1 string, v0 double, v1 double, mat array<double>").collect()), key=lambda r: r["p"])
    k = len(kernel.states)
    for r in got:
        r["mat"] = np.array(r["mat"]).reshape(k, k)
        r.update({x: float("nan") if r[x] is None else r[x] for x in ("v0", "v1")})
    between = [kernel.moves(np.array([a["v1"]]), np.array([b["v0"]]), np.array([a["e1"] != b["e0"]]), np.array([a["d1"] != b["d0"]]))[0] for a, b in zip(got, got[1:])]
    fore, back = {}, {}
    reach = np.zeros(k)
    for i, r in enumerate(got):  # scores that reach the first reading of each task, before its own
        fore[r["p"]] = reach
        if i < len(between):
            out = (reach[:, None] + r["mat"]).max(0)
            reach = (out[:, None] + between[i]).max(0)
            reach = reach - reach.max()
    reach = np.zeros(k)
    for i in range(len(got) - 1, -1, -1):  # scores that the last reading of each task leads to
        back[got[i]["p"]] = reach
        if i:
            into = (got[i]["mat"] + reach[None, :]).max(1)
            reach = (between[i - 1] + into[None, :]).max(1)
            reach = reach - reach.max()
    schema = T.StructType([*cut.schema.fields, T.StructField("unit", T.StringType()), T.StructField("canonical", T.DoubleType())])
    factor = np.array([*map(float, model.factors.values()), float("nan")])

    def decode(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i", kind="stable")
        p = int(pdf["__p"].iloc[0])
        v, first, s = steps(pdf)
        score = _chain(s, first[0] + fore[p]) + _chain(s[::-1].transpose(0, 2, 1), back[p])[::-1]
        best = score.argmax(1)
        canonical = v * factor[best]
        return pdf.assign(unit=[kernel.states[i] for i in best], canonical=pd.Series(np.where(np.isnan(canonical), None, canonical), index=pdf.index, dtype=object))

    return cut.groupBy("__p").applyInPandas(decode, schema).drop("__v", "__h", "__d", "__e", "__p", "__i")


def series_heights(df: DataFrame, entry: str, text: str = "wiki_height", device: str = "wiki_sport", low: int = 120, high: int = 230, model: UnitModel = HEIGHT) -> DataFrame:
    """(``entry``, ``text``, height_cm): entries whose text states a body height, decoded in the series of their ``device``.

    The measures of all texts of a device, in order of entry and text, are one series; its level tells the unit where the
    text doesn't. Which of a text's measures is the height follows ``heights``. Copied rows count once; texts without a
    height give no row; NULL devices are one device."""
    r = readings(df.select(entry, text, device).distinct(), text, model).withColumn("__entry", F.concat_ws("\u0001", F.col(entry).cast("string"), F.col(text)))
    done = decode_series(r, device, [entry, text, "pos"], "value", "hint", model, "__entry")
    units = list(model.factors)
    rounded = F.coalesce(*[F.when(F.col("unit") == u, F.get("rounded", F.lit(i))) for i, u in enumerate(units)])
    m = done.groupBy(entry, text, device).agg(F.array_sort(F.collect_list(F.struct("pos", "unit", "canonical", rounded.alias("rounded")))).alias("__m"))  # one text's measures
    return _stated(m, low, high).where("height_cm IS NOT NULL").select(entry, text, "height_cm").distinct()


def _stated(df: DataFrame, low: int, high: int) -> DataFrame:
    """``height_cm`` from the decoded measures ``__m`` of a text, which are dropped."""
    ok = df.withColumn("__m", F.filter("__m", lambda x: x["rounded"].between(low, high)))
    pick = F.coalesce(F.get(F.filter("__m", lambda x: x["unit"].isin("m", "cm", "mm")), F.lit(0))["rounded"], F.get("__m", F.lit(0))["rounded"])
    agree = F.array_max(F.transform("__m", lambda x: x["canonical"])) - F.array_min(F.transform("__m", lambda x: x["canonical"])) <= 2.0
    return ok.withColumn("height_cm", F.when(agree, pick)).drop("__m")


def heights(df: DataFrame, text: str = "wiki_height", low: int = 120, high: int = 230) -> DataFrame:
    """Add ``height_cm`` (BIGINT): the body height a text states, whole centimetres, halves up; NULL if none.

    Measures come from ``decode_text``; metric ones go first. Several heights in one text must agree within 2 cm,
    otherwise the result is NULL, as it is for NULL, empty and placeholder texts, weights and other lengths."""
    return _stated(decode_text(df, text, "__m"), low, high)
