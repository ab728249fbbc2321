import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import units
from quillspark.operators.units import HEIGHT, _Kernel, decode_series, heights, measures


CASES = [
    ("1.75 m (5 ft 9 in)", 175), ("104 kg, 1.91 m", 191), ("1,750 mm", 175), ("17.84 m", None), ("5-foot-10", 178), ("5’ 8”", 173), ('67"', 170),
    ("5 ft 2 1/2 in", 159), ("5'10½\"", 179), ("{{height|m=1.70}}", 170), ("{{convert|168|cm|ftin|abbr=on}}", 168), ("163 cm{{ref|1}}", 163), (" 183 ", 183),
    ("1.77", 177), ("20 cm", None), ("48 cm", None), ("0", None), ("192 lb", None), ("5.23 ft", 159), ("1 m 82", 182), ("tall", None), ("", None), (None, None),
    ("1.755 m", 176), ("180 cm / 5'0\"", None), ("x" * 50_000 + " 1.80 m", 180),
]


def test_heights(spark):
    df = spark.createDataFrame([(i, t, "kept") for i, (t, _) in enumerate(CASES)], "wiki_id long, wiki_height string, height_m string")
    got = {r["wiki_id"]: r["height_cm"] for r in heights(df).filter("height_m = 'kept'").collect()}
    assert [(t[:50], got[i]) for i, (t, _) in enumerate(CASES) if t] == [(t[:50], c) for t, c in CASES if t]
    assert got[21] is None and got[22] is None


def test_empty(spark):
    assert heights(spark.createDataFrame([], "wiki_height string")).count() == 0
    assert decode_series(spark.createDataFrame([], "d string, t long, v double"), "d", "t", "v").count() == 0


@pytest.mark.parametrize("rows_a_task", [37, 100_000])
def test_series_equals_one_viterbi(spark, monkeypatch, rows_a_task):
    monkeypatch.setattr(units, "TASK_ROWS", rows_a_task)
    rnd, rows = random.Random(1), []
    for d, n in (("hot", 400), ("b", 7), (None, 3), ("c", 1)):
        unit, level = "cm", 175.0
        for t in range(n):
            if rnd.random() < 0.05:
                unit = rnd.choice(["m", "cm", "mm", "in"])
            level *= 1 + rnd.gauss(0, 0.002)
            rows.append((d, t, None if rnd.random() < 0.02 else level / float(HEIGHT.factors[unit]), unit))
    df = spark.createDataFrame(rows, "d string, t long, v double, truth string").repartition(5)
    got = {(r["d"], r["t"]): r["unit"] for r in decode_series(df, "d", "t", "v").collect()}
    assert len(got) == len(rows)
    kernel = _Kernel(HEIGHT)
    for d in ("hot", "b", None, "c"):
        own = [r for r in rows if r[0] == d]
        want = kernel.best([float("nan") if r[2] is None else r[2] for r in own], [None] * len(own))
        assert [got[(d, r[1])] for r in own] == want
    assert sum(got[(r[0], r[1])] == r[3] for r in rows if r[2]) > 0.95 * len(rows)


def test_measures_order():
    assert [u for _, u in measures("5 ft 4 in (163 cm), 50 kg")] == ["in", "cm", "other"]


def test_only_the_level_tells_the_unit(spark):
    """Numbers without a unit that are a height in centimetres by one reading and in inches by another: the device decides."""
    model = units.UnitModel(factors={"cm": units.Fraction(1), "in": units.Fraction(254, 100)}, mean=110.0, spread=0.6, off_level=9.0)
    rows = [(d, t, 60.0 + t % 3 / 4, d if t in (0, 5) else None, "x") for d in ("cm", "in") for t in range(6)]
    df = spark.createDataFrame(rows, "device string, at long, value double, beside string, unit string")
    got = decode_series(df, "device", "at", "value", "beside", model=model).collect()
    assert len(got) == 12 and all(r["unit"] == r["device"] and abs(r["canonical"] - r["value"] * (1 if r["unit"] == "cm" else 2.54)) < 1e-9 for r in got)
    alone = decode_series(df.where("beside IS NULL"), "device", "at", "value", model=model).collect()  # without a level to hold on to
    assert {r["unit"] for r in alone if r["device"] == "cm"} == {"in"}


def test_scans_equal_single_steps():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 50):
        steps, start = rng.normal(size=(n, 3, 3)), rng.normal(size=3)
        rows = [start]
        for x in steps:
            rows.append((rows[-1][:, None] + x).max(0))
        assert np.allclose(units._chain(steps, start), np.array(rows))
        assert np.allclose((start[:, None] + units._product(steps)).max(0), rows[-1])


def test_heights_of_a_source(spark, monkeypatch):
    rows = [(i, t, ["rowing", None, "judo"][i % 3], 1) for i, (t, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, rows[0], (None, "1.80 m", "judo", 1), (90, "1.80 m", "x", 1), (90, "1.80 m", "y", 1)], "wiki_id long, wiki_height string, wiki_sport string, value int")
    want = {(i, c) for i, (_, c) in enumerate(CASES) if c} | {(None, 180), (90, 180)}
    for n in (5, 100_000):
        monkeypatch.setattr(units, "TASK_ROWS", n)
        found = units.series_heights(df, "wiki_id").collect()
        assert {(r["wiki_id"], r["height_cm"]) for r in found} == want and len(found) == len(want)
    assert units.series_heights(df.limit(0), "wiki_id").count() == 0
    flat = spark.createDataFrame([("a", i, 170.0) for i in [1] * 300], "d string, t long, v double")  # all readings tie
    monkeypatch.setattr(units, "TASK_ROWS", 50)
    tied = decode_series(flat, "d", "t", "v")
    assert tied.count() == 300 and {r["unit"] for r in tied.collect()} == {"cm"}
