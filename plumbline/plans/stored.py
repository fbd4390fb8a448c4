"""Queries on records that pass through files: written to the shared folder by the sinks, read back by the sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files as S
from ..sources.models import registry
from ..sources.schemas import numbers
from .frames import frame, table
from .registry import query


def fresh(spark: SparkSession) -> str:
    """A folder of its own for each run, so that runs side by side do not meet."""
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


def _lines(df: DataFrame) -> DataFrame:
    """JSON lines, every seventh cut short and every eleventh blank."""
    line = F.to_json(F.struct("*"))
    broken = F.when(F.col("event_id") % 7 == 0, F.expr("left(line, length(line) - 2)")).when(F.col("event_id") % 11 == 0, "").otherwise(F.col("line"))
    return df.withColumn("line", line).select(broken.alias("value"))


@query("jsonl_lenient", "SELECT event_id, model, conf, correct FROM {measurements} m WHERE event_id % 7 <> 0 AND event_id % 11 <> 0")
def lenient(spark, d):
    path = fresh(spark)
    _lines(frame(spark, d, "measurements").select("event_id", "model", "conf", "correct")).write.text(path)
    return S.read_jsonl(spark, path, "event_id long, model string, conf double, correct boolean")


@query("jsonl_append", "SELECT event_id, model, CASE WHEN event_id % 13 <> 0 THEN conf END AS conf FROM {measurements} m")
def append(spark, d):
    """Two writes to one log, the second appended; numbers that JSON lacks become null."""
    path = fresh(spark)
    m = frame(spark, d, "measurements").select("event_id", "model", F.when(F.col("event_id") % 13 != 0, F.col("conf")).otherwise(float("nan")).alias("conf"))
    S.write_jsonl(m.where("event_id % 2 = 0"), path)
    S.write_jsonl(m.where("event_id % 2 = 1"), path, append=True)
    return S.read_jsonl(spark, path, "event_id long, model string, conf double", strict=True)


_TRIAL = "model string, task_id long, condition int, paradigm int, is_false_score_control boolean, api_success boolean, timestamp string, run string"


def _runs(spark, d):
    """All trials in a first run; every third and all that failed again in a second, later one."""
    t = frame(spark, d, "trials").select("model", "task_id", "condition", "paradigm", F.col("false_score").alias("is_false_score_control"), "api_success", F.col("ts").cast("string").alias("timestamp"))
    path = fresh(spark)
    S.write_jsonl(t.withColumn("run", F.lit("first")), f"{path}/first")
    S.write_jsonl(t.where("task_id % 3 = 0 or not api_success").withColumn("api_success", F.lit(True)).withColumn("run", F.lit("second")), f"{path}/second")
    return [f"{path}/first", f"{path}/second"]


@query("trial_files", "SELECT model, task_id, condition, CASE WHEN api_success THEN 'first' ELSE 'second' END AS run FROM {trials} t")
def trial_files(spark, d):
    return S.read_trials(spark, _runs(spark, d), _TRIAL).select("model", "task_id", "condition", "run")


@query("latest_files", "SELECT model, task_id, condition, CASE WHEN api_success AND task_id % 3 <> 0 THEN 'first' ELSE 'second' END AS run FROM {trials} t")
def latest_files(spark, d):
    return S.latest_measurements(spark, _runs(spark, d), _TRIAL, ("model", "task_id", "condition")).select("model", "task_id", "condition", "run")


def _documents(spark, d):
    """Two documents of nested maps; the later one has two models only, and one domain less for each. One row a model and domain, so they are small."""
    path, c = fresh(spark), frame(spark, d, "capability")
    later = c.where("model in ('1-URGENT', '2-HIGH') and domain <> 'd3'").withColumn("natural_acc", F.col("wagering_acc"))
    for name, part in (("a", c), ("b", later)):
        domains = part.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("domain", F.struct("natural_acc", "wagering_acc")))).alias("m"))
        domains.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "m")))).alias("value")).coalesce(1).write.text(f"{path}/{name}")
    return [f"{path}/a", f"{path}/b"]


_LATER = "model IN ('1-URGENT', '2-HIGH')"


@query("capability_newest", f"SELECT model, domain, CASE WHEN {_LATER} THEN wagering_acc ELSE natural_acc END AS natural_acc, wagering_acc FROM {{capability}} c WHERE NOT ({_LATER} AND domain = 'd3')")
def capability_newest(spark, d):
    return S.read_capability(spark, _documents(spark, d))


@query("capability_coverage", "SELECT model, domain, natural_acc, wagering_acc FROM {capability} c")
def capability_coverage(spark, d):
    return S.read_capability(spark, _documents(spark, d), best="coverage")


@query("csv_packet", "SELECT o_orderkey::VARCHAR AS request_id, o_orderstatus AS resolver, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS cost FROM orders")
def csv(spark, d):
    """Text columns with a header; what is no number becomes null."""
    path = fresh(spark)
    cost = F.when(F.col("o_orderkey") % 3 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    S.write_csv(table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_orderstatus").alias("resolver"), cost.alias("cost")), path)
    return numbers(S.read_csv(spark, path, "request_id string, resolver string, cost string"), ["cost"])


@query("domain_taxonomy", "SELECT r_name AS domain, n_name AS subcategory FROM nation JOIN region ON n_regionkey = r_regionkey")
def taxonomy(spark, d):
    """A configuration file of domains and their subcategories; regions and nations do not grow with the data."""
    path = fresh(spark)
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list("n_name")), lambda x: F.concat(F.lit("      - '"), x, F.lit("'"))), "\n")
    blocks = n.groupBy("r_name").agg(F.concat(F.lit("  "), F.col("r_name"), F.lit(":\n    subcategories:\n"), items).alias("b"))
    blocks.agg(F.concat(F.lit("domains:\n"), F.array_join(F.array_sort(F.collect_list("b")), "\n")).alias("value")).coalesce(1).write.text(path)
    return S.read_domains(spark, path)


@query("model_registry", "SELECT c_custkey AS model, c_mktsegment AS role FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey % 3 = 1")
def models(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("model"), F.col("c_mktsegment").alias("role"), (F.col("c_nationkey") % 3).cast("string").alias("provider"))
    return registry(c, "BUILDING", "1").select("model", "role")
