"""Conditional failure and deferral rates, routing policies and escalation trade-offs over component rows.

A component has model, condition, domain, strength, decision, correct and routed. A null label counts as wrong, a null decision as no decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


WEAK = lambda: F.col("strength") == "weak"
STRONG = lambda: F.col("strength") == "strong"
PROCEED = lambda: F.col("decision") == "proceed"
WRONG = lambda: ~F.coalesce(F.col("correct"), F.lit(False))


def failure(kind: str = "proceed", weak: Column | None = None) -> Column:
    """Conditional failure rate (aggregate) in one of its three definitions.

    proceed: proceeded and wrong over weak. unrouted: not externally routed and wrong over weak. autonomous: proceeded and wrong over all.
    """
    weak = WEAK() if weak is None else weak
    if kind == "proceed":
        return ratio(F.count_if(weak & PROCEED() & WRONG()), F.count_if(weak))
    if kind == "unrouted":
        return ratio(F.count_if(weak & ~F.col("routed") & WRONG()), F.count_if(weak))
    if kind == "autonomous":
        return ratio(F.count_if(PROCEED() & WRONG()), F.count("*"))
    raise ValueError(f"no failure rate {kind!r}")


def deferral(strong: Column | None = None) -> Column:
    """Unnecessary deferral rate (aggregate): deferred or used a tool and would have been right, over strong."""
    strong = STRONG() if strong is None else strong
    return ratio(F.count_if(strong & F.col("decision").isin("defer", "use_tool") & ~WRONG()), F.count_if(strong))


def failure_rates(components: DataFrame, by: list[str]) -> DataFrame:
    return components.groupBy(*by).agg(F.count("*").alias("n"), failure().alias("cfr"), deferral().alias("udr"))


def escalation_curve(components: DataFrame) -> DataFrame:
    """Failure rate by condition: mean over models of the models' rates, each model counting once; models without weak components are skipped."""
    per = components.groupBy("model", "condition").agg(failure().alias("cfr"))
    return per.groupBy("condition").agg(F.avg("cfr").alias("mean_cfr"), F.stddev_samp("cfr").alias("sd"), F.count("cfr").alias("models"))


def policies(gap: str = "gap", acc: str = "natural_acc", accuracy_cut: float = 0.5, gap_cut: float = 0.3) -> dict[str, Column]:
    """Routing policies as conditions under which a component is sent away; what a policy knows nothing about is sent away."""
    return {
        "none": F.lit(False),
        "accuracy": F.coalesce(F.col(acc) < accuracy_cut, F.lit(True)),
        "gap": F.coalesce(F.col(gap) > gap_cut, F.lit(True)),
        "oracle": F.coalesce(F.col(acc) < 0.5, F.lit(True)),
    }


def routing(components: DataFrame, by: list[str], masks: dict[str, Column]) -> DataFrame:
    """Conditional failure rate of weak components under several routing policies, in one pass."""
    weak = components.where(WEAK()).select(*by, (PROCEED() & WRONG()).alias("__bad"), F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), m.alias("m")) for k, m in masks.items()])).alias("__p"))
    return weak.groupBy(*by, F.col("__p.policy").alias("policy")).agg(F.count("*").alias("n"), ratio(F.count_if(F.col("__bad") & ~F.col("__p.m")), F.count("*")).alias("cfr"))


def strategy(escalated: Column, weak: Column, correct: Column) -> dict[str, Column]:
    """What a boolean escalation mask achieves (aggregates)."""
    wrong = ~F.coalesce(correct, F.lit(False))
    return {
        "n": F.count("*"),
        "escalation": F.avg(F.when(escalated, 1.0).otherwise(0.0)),
        "autonomy": F.avg(F.when(escalated, 0.0).otherwise(1.0)),
        "failure": ratio(F.count_if(~escalated & wrong), F.count("*")),
        "weak_failure": ratio(F.count_if(weak & ~escalated & wrong), F.count_if(weak)),
        "weak_escalation": ratio(F.count_if(weak & escalated), F.count_if(weak)),
    }


def compare(df: DataFrame, by: list[str], masks: dict[str, Column], weak: Column, correct: Column) -> DataFrame:
    """:func:`strategy` of several masks in one pass, a row for each group and mask."""
    long = df.select(*by, weak.alias("__weak"), correct.alias("__ok"), F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), m.alias("m")) for k, m in masks.items()])).alias("__p"))
    parts = strategy(F.col("__p.m"), F.col("__weak"), F.col("__ok"))
    return long.groupBy(*by, F.col("__p.policy").alias("policy")).agg(*[c.alias(k) for k, c in parts.items()])


def tradeoff(four: DataFrame, one: DataFrame, key: list[str]) -> DataFrame:
    """Escalation of weak components under condition 4 against how the same components came out under condition 1.

    Left join on ``key``; components of unknown strength are left out, escalations without a counterpart are counted as unknown. By model: sizes,
    escalation rate, shares of the matched escalations that were needed (condition 1 was wrong) and needless, failures prevented and successes blocked
    a hundred weak components with their difference, weak accuracy under either condition, success and share of the weak components not
    escalated, unnecessary deferral and accuracy of strong components, and accuracy of everything not escalated.
    """
    joined = four.where(F.coalesce("strength", F.lit("unknown")) != "unknown").join(one.select(*key, F.col("correct").alias("__was")), key, "left")
    ok, esc = ~WRONG(), F.coalesce("routed", F.lit(False)) | ~F.coalesce(PROCEED(), F.lit(True))
    we, wn = WEAK() & esc, WEAK() & ~esc
    needed, needless = we & ~F.col("__was"), we & F.col("__was")
    count = {
        "weak": WEAK(), "escalated": we, "needed": needed, "needless": needless, "unknown": we & F.col("__was").isNull(), "kept_right": wn & ok, "kept": wn, "right": WEAK() & ok, "strong": STRONG(), "strong_right": STRONG() & ok,
        "strong_lost": STRONG() & F.col("decision").isin("use_tool", "defer") & F.col("__was"), "auto": wn | STRONG() | (F.col("strength") == "medium"), "auto_right": (wn | STRONG() | (F.col("strength") == "medium")) & ok,
    }
    g = joined.groupBy("model").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{k}") for k, c in count.items()])
    n = lambda k: F.col(f"n_{k}")
    matched = n("needed") + n("needless")
    return g.where(n("weak") > 0).select(
        "model", n("weak").alias("n_weak"), n("escalated").alias("n_escalated"), n("unknown").alias("n_unknown"), ratio(n("escalated"), n("weak")).alias("escalation"), ratio(n("needed"), matched).alias("right_escalation"), ratio(n("needless"), matched).alias("false_escalation"),
        ratio(n("needless"), matched).alias("weak_accuracy_1"), ratio(n("right"), n("weak")).alias("weak_accuracy_4"), ratio(n("kept_right"), n("kept")).alias("kept_success"), ratio(n("kept"), n("weak")).alias("autonomy"),
        ratio(n("needed") * 100, n("weak")).alias("prevented"), ratio(n("needless") * 100, n("weak")).alias("blocked"), ratio((n("needed") - n("needless")) * 100, n("weak")).alias("utility"),
        ratio(n("strong_lost"), n("strong")).alias("strong_udr"), ratio(n("strong_right"), n("strong")).alias("strong_accuracy"), ratio(n("auto_right"), n("auto")).alias("autonomous_accuracy"),
    )


def control_finding(real: Column, false: Column) -> Column:
    """What false scores do to the deferral of weak components."""
    return F.when(real.isNull() | false.isNull(), "INSUFFICIENT_DATA").when(false > real + 0.10, "A_PROCESSES_SCORES").when(F.abs(false - real) <= 0.05, "B_IGNORES_CONTEXT").when(false < real - 0.10, "C_WORSENED").otherwise("D_AMBIGUOUS")


def quality_status(failed: Column) -> Column:
    return F.when(failed >= 0.30, "partial").when(failed >= 0.10, "acceptable").otherwise("clean")


def resolver_quality(components: DataFrame, by: list[str], grid: list[float], weak: Column) -> DataFrame:
    """Expected success of routed components whose resolver is right with probability q, for each q of a grid.

    Success and weak failure are linear in q, so the grid is applied to a group's counts, not to its rows."""
    ok, ext = ~WRONG(), F.coalesce("routed", F.lit(False))
    g = components.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~ext).alias("__a"), F.count_if(~ext & ok).alias("__ac"), F.count_if(ext).alias("__e"), F.count_if(weak).alias("__w"), F.count_if(weak & ext).alias("__we"), F.count_if(weak & ~ext & ~ok).alias("__wf"))
    g = g.select("*", F.explode(F.array(*[F.lit(float(q)) for q in grid])).alias("q"))
    return g.select(*by, "q", "n", ratio(F.col("__a"), F.col("n")).alias("autonomy"), ratio(F.col("__ac"), F.col("__a")).alias("autonomous_correct"), ratio(F.col("__ac") + F.col("q") * F.col("__e"), F.col("n")).alias("success"), ratio(F.col("__wf") + (1 - F.col("q")) * F.col("__we"), F.col("__w")).alias("weak_failure"))


def summarize(df: DataFrame, measures: list[str]) -> DataFrame:
    """Mean, extremes and count over groups of each measure, in long form; nulls are skipped."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])).alias("x")).select("x.*")
    return long.groupBy("measure").agg(F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"))
