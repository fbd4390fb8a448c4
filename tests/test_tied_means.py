"""Means that are equal, though sums of doubles in another order are not."""

import math

import duckdb
from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.plans import registry

from .compare import connect, duck_rows, spark_rows

registry.load()


def test_exact_mean(spark):
    rows = {"a": [0.1, 0.2, 0.3], "b": [0.3, 0.2, 0.1], "c": [0.1, 0.2, 0.3] * 7, "d": [0.5, None], "e": [None], "f": [0.25, math.inf], "g": [0.25, math.nan], "h": [4e10, 2e10], "i": [-0.5, 0.25]}
    df = spark.createDataFrame([(k, x) for k, values in rows.items() for x in values], "k string, x double").coalesce(1)
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(M.exact_mean(F.col("x")).alias("m")).collect()}
    assert math.isnan(got.pop("g"))
    assert got == {"a": 0.2, "b": 0.2, "c": 0.2, "d": 0.5, "e": None, "f": math.inf, "h": 3e10, "i": -0.125}


def transfer(spark, path, d0, d1, d2, d3):
    """Transfer by query and by SQL over four domains of three values each, whose accuracies are 1/3, 2/3, 1 and 0."""
    users = (8, 24, 0), (1, 17, 9), (2, 10, 2), (3, 19, 3)  # of domain user % 8; right where user % 5 < 3, as k is 0
    rows = [(u, 200 * x) for line, values in zip(users, (d0, d1, d2, d3)) for u, x in zip(line, values)]
    data = ", ".join(f"({n + 1}, timestamp '2024-01-01', {u}, 'view', {x}::double, '{{\"k\": 0}}')" for n, (u, x) in enumerate(rows))
    path.mkdir()
    duckdb.sql(f"copy (select * from (values {data}) t(event_id, ts, user_id, event_type, value, props)) to '{path}/events.parquet'")
    return spark_rows(registry.QUERIES["transfer_scores"](spark, str(path))), duck_rows(connect(str(path)), registry.ORACLES["transfer_scores"])


def test_transfer_ties(spark, tmp_path):
    # ranks of means 2.5, 2.5, 4, 1 against ranks of accuracies 2, 3, 4, 1
    want = (["channels", "model", "transfer"], [(1, "view", round(4.5 / math.sqrt(22.5), 8))])
    # binary fractions: sums of doubles are exact and SQL has the ties
    got, sql = transfer(spark, tmp_path / "exact", (0.125, 0.25, 0.375), (0.375, 0.25, 0.125), (0.5, 0.5, 0.5), (0.125, 0.125, 0.125))
    assert got == want == sql
    # tenths: 0.1 + 0.2 + 0.3 is not 0.3 + 0.2 + 0.1 in doubles, and SQL depends on the order of its sums
    got, _ = transfer(spark, tmp_path / "tenths", (0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (0.5, 0.5, 0.5), (0.1, 0.1, 0.1))
    assert got == want
