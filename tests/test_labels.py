"""Number texts equal Python's formatting."""

import random

from liftlens.functions.labels import number_text, two_digits


def test_two_digits_equals_python(spark):
    rng = random.Random(1)
    values = [i / 100 for i in range(0, 10_001)]  # every two-decimal percentage
    values += [rng.uniform(0, 100) for _ in range(2000)] + [10 ** rng.uniform(-6, 15) for _ in range(2000)]
    # texts just between two results, below and above, exact and not
    values += [(10 * n + 5) * 10.0**e for n in range(10, 100) for e in range(-7, 12)]
    values += [float(f"{n}5e{e}") for n in range(10, 100) for e in range(-7, 12)]
    values += [-31.25, -0.0, 0.0, 9.96, 99.5, 100.0, 123456.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    wrong = [(r.v, r.t) for r in df.select("v", two_digits("v").alias("t")).collect() if r.t != (None if r.v is None else f"{abs(r.v) if r.v == 0 else r.v:.2g}")]
    assert not wrong, wrong[:10]


def test_number_text_equals_python(spark):
    rng = random.Random(2)
    values = [10 ** rng.uniform(-12, 6) * rng.choice([1, -1]) for _ in range(3000)] + [round(rng.random(), 9) for _ in range(2000)]
    values += [0.0, 1.0, 0.05, 0.001, 0.0001, 1e-05, 0.00012, 1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [(r.v, r.t) for r in df.select("v", number_text("v").alias("t")).collect() if r.t != repr(r.v)]
    assert not wrong, wrong[:10]
    assert spark.createDataFrame([(None,)], "v double").select(number_text("v")).first()[0] == "nan"
