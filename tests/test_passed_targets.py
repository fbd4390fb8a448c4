"""Progress past its target, which the smallest tables do not reach."""

import duckdb
import pandas as pd

from plumbline.plans import registry
from plumbline.streaming import progress as T

from .compare import connect, differing, duck_rows, spark_rows

registry.load()


def test_minutes_left_go_below_zero(spark):
    rows = spark.createDataFrame(pd.DataFrame({"k": ["a", "a", "a", "b", "b", "c"], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:01", "2024-01-01 00:03", "2024-01-01 00:00", "2024-01-01 00:04", "2024-01-01 00:00"])}))
    got = {r["k"]: (r["n"], r["per_minute"], r["minutes_left"]) for r in T.rate(rows, ["k"], "ts", 2).collect()}
    assert got == {"a": (3, 1.0, -1.0), "b": (2, 0.5, 0.0), "c": (1, None, None)}


def test_rate_against_sql(spark, tmp_path):
    kind = "case when i < 5003 then 'past' when i < 10003 then 'there' else 'before' end"
    duckdb.sql(f"copy (select i as event_id, timestamp '2024-01-01' + to_seconds(i * 7) as ts, {kind} as event_type from range(10010) t(i)) to '{tmp_path}/events.parquet'")
    got, want = spark_rows(registry.QUERIES["progress_rate"](spark, str(tmp_path))), duck_rows(connect(str(tmp_path)), registry.ORACLES["progress_rate"])
    assert got[0] == want[0] and len(got[1]) == 3
    assert not differing(got[1], want[1])
