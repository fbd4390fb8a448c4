"""Queries that must take every measurement into account."""

import math
import os

import pytest

from plumbline.plans import frames, registry

FOLDER = "/root/testdata/sf0.001"
registry.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def by_model(spark):
    out = {}
    for r in frames.frame(spark, FOLDER, "measurements").collect():
        out.setdefault(r["model"], []).append(r)
    return out


def test_tau_over_all_pairs(spark, by_model):
    sign = lambda x: (x > 0) - (x < 0)
    got = {r["model"]: r["tau"] for r in registry.QUERIES["kendall_tau"](spark, FOLDER).collect()}
    assert set(got) == set(by_model)
    for model, rows in by_model.items():
        pairs = [(sign(a["bet"] - b["bet"]), sign(a["n_hedges"] - b["n_hedges"])) for i, a in enumerate(rows) for b in rows[:i]]
        want = sum(x * y for x, y in pairs) / math.sqrt(sum(x * x for x, _ in pairs) * sum(y * y for _, y in pairs))
        assert got[model] == pytest.approx(want, abs=1e-7)


def test_quantiles_over_all_rows(spark, by_model):
    got = {r["model"]: r for r in registry.QUERIES["quantile_definitions"](spark, FOLDER).collect()}
    assert set(got) == set(by_model)
    for model, rows in by_model.items():
        line = sorted(r["conf"] for r in rows)
        n, h = len(line), (len(line) - 1) * 0.3
        low = math.floor(h)
        want = (line[low] + (h - low) * (line[min(low + 1, n - 1)] - line[low]), line[round(h)], line[low], line[math.ceil(n * 0.3) - 1])
        assert [got[model][k] for k in ("linear", "nearest", "lower", "upper")] == pytest.approx(list(want), abs=1e-8)
