"""Projections, filters and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

SLOT_FIELDS = ("domain", "subcategory", "strength", "decision", "correct", "routed", "hedges", "decomps", "tokens", "error")


def unpivot_slots(trials: DataFrame, fields=SLOT_FIELDS, slots=("a", "b"), require: str | None = "domain") -> DataFrame:
    """Rows of two slots (``x_a``, ``x_b``) as one row a slot; slots whose ``require`` field is null or empty are left out."""
    wide = {f"{f}_{s}" for f in fields for s in slots}
    keep = [c for c in trials.columns if c not in wide]
    parts = F.array(*[F.struct(F.lit(s).alias("slot"), *[F.col(f"{f}_{s}").alias(f) for f in fields]) for s in slots])
    long = trials.select(*keep, F.explode(parts).alias("__slot")).select(*keep, "__slot.*")
    return long.where(F.coalesce(F.col(require), F.lit("")) != "") if require else long


def trial_filter(conditions=None, paradigms=None, circularity_free: bool = True, false_score: bool | None = None, models=None, success: bool | None = None) -> Column:
    """Conjunction of the usual trial filters; every part reaches the scan."""
    parts = [F.lit(True)]
    if conditions:
        parts.append(F.col("condition").isin(*conditions))
    if paradigms:
        parts.append(F.col("paradigm").isin(*paradigms))
    if circularity_free:
        parts.append(F.col("circularity_free"))
    if false_score is not None:
        parts.append(F.col("false_score") == false_score)
    if models:
        parts.append(F.col("model").isin(*models))
    if success is not None:
        parts.append(F.col("api_success") == success)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def channel_signal(scale: str = "raw") -> Column:
    """Confidence of a measurement by its channel.

    raw: bet, 1 - skipped, chose hard ('A'), 1/(1 + tools), 1/(1 + hedges). unit: all in [0, 1] with (bet - 1)/9,
    no tool 1, some tool 0.5, and 1 - hedges/5 floored at 0.
    """
    ch = F.col("channel")
    chosen = F.when(F.col("choice") == "A", 1.0).when(F.col("choice") == "B", 0.0)
    stay = F.when(F.col("skipped"), 0.0).otherwise(1.0)
    if scale == "raw":
        return F.when(ch == "1", F.col("bet").cast("double")).when(ch == "2", stay).when(ch == "3", chosen).when(ch == "4", 1.0 / (1 + F.col("n_tools"))).when(ch == "5", 1.0 / (1 + F.col("n_hedges")))
    hedge = F.greatest(F.lit(0.0), 1 - F.col("n_hedges") / 5)
    return F.when(ch == "1", F.when(F.col("bet").between(1, 10), (F.col("bet") - 1) / 9)).when(ch == "2", stay).when(ch == "3", chosen).when(ch == "4", F.when(F.col("n_tools") > 0, 0.5).otherwise(1.0)).when(ch == "5", hedge)


def tool_signal(names: Column, experts=("expert", "flag_review", "human_review")) -> Column:
    """Confidence from an array of tool names: none 1, any expert 0, else 0.5."""
    expert = F.exists(names, lambda n: F.lower(n).isin(*experts))
    return F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, 1.0).when(expert, 0.0).otherwise(0.5)


def minmax(df: DataFrame, value: str, by: list[str], out: str, constant: float = 0.5, tiny: float = 1e-12) -> DataFrame:
    """Scale ``value`` to [0, 1] within ``by``; a constant group gives ``constant``, null stays null.

    Extremes are grouped first and joined back, so a hot group is combined before the shuffle.
    """
    ends = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    joined = df.join(ends, by)
    flat = (F.col("__hi") - F.col("__lo")) < tiny
    return joined.withColumn(out, F.when(F.col(value).isNull(), None).when(flat, F.lit(constant)).otherwise((F.col(value) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0)))).drop("__lo", "__hi")


def strength(acc: Column, strong: float = 0.6, weak: float = 0.4) -> Column:
    return F.when(acc.isNull(), "unknown").when(acc >= strong, "strong").when(acc <= weak, "weak").otherwise("medium")


def patch_strength(components: DataFrame, capability: DataFrame) -> DataFrame:
    """Fill strengths marked unknown from the capability table; others stay."""
    cap = capability.select("model", "domain", F.col("natural_acc").alias("__acc"))
    return components.join(cap, ["model", "domain"], "left").withColumn("strength", F.when(F.col("strength") == "unknown", strength(F.col("__acc"))).otherwise(F.col("strength"))).drop("__acc")


def length_bin(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n <= 200, "1-200").when(n <= 500, "201-500").when(n <= 1000, "501-1000").when(n <= 2000, "1001-2000").otherwise("2001+")


def difficulty_bin(p: Column) -> Column:
    return F.when(p >= 0.5, "easy").when(p >= 0.2, "medium").otherwise("hard")


def pair_stratum(weak_a: Column, weak_b: Column) -> Column:
    return F.when(weak_a & weak_b, "weak_weak").when(~weak_a & ~weak_b, "strong_strong").otherwise("strong_weak")


# Synonyms of decisions, of machines and of people.
DECISIONS = {
    "proceed": ("proceed", "answer", "continue"),
    "use_tool": ("use_tool", "tool", "delegate", "defer_tool"),
    "flag_for_review": ("flag_for_review", "review", "escalate", "defer", "human_review"),
}
HUMAN_DECISIONS = {"PROCEED": ("proceed",), "USE_TOOL": ("use_tool",), "FLAG_FOR_REVIEW": ("flag_for_review", "defer", "flag", "flag_review")}


def normalize_decision(text: Column, table=DECISIONS, other: Column | None = None) -> Column:
    """Canonical decision of a free spelling, else ``other`` or the trimmed lower-case text; null counts as empty."""
    clean = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    out = clean if other is None else other
    for canonical, words in table.items():
        out = F.when(clean.isin(*words), canonical).otherwise(out)
    return out


def composite(hedge: Column, decomp: Column, tokens: Column, weights=(0.5, 0.3, 0.2)) -> Column:
    return hedge * weights[0] + decomp * weights[1] + tokens * weights[2]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def issues(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition holds, as an array in the rules' order."""
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]), lambda x: x.isNotNull())


def task_rules(domains: list[str], difficulties=("easy", "medium", "hard"), types=("fixed", "tailored")) -> dict[str, Column]:
    """Rules that a task record must not break; see :func:`issues`."""
    out: dict[str, Column] = {"bad_type": ~F.coalesce(F.col("task_type").isin(*types), F.lit(False)), "no_flag": F.col("circularity_free").isNull()}
    for s in "ab":
        kind, answer = F.col(f"answer_type_{s}"), F.trim(F.coalesce(F.col(f"answer_{s}"), F.lit("")))
        out |= {
            f"bad_domain_{s}": ~F.coalesce(F.col(f"domain_{s}").isin(*domains), F.lit(False)),
            f"bad_difficulty_{s}": ~F.coalesce(F.col(f"difficulty_{s}").isin(*difficulties), F.lit(False)),
            f"bad_answer_type_{s}": ~F.coalesce(kind.isin("exact_numeric", "multiple_choice", "boolean", "short_text"), F.lit(False)),
            f"no_answer_{s}": answer == "",
            f"not_a_letter_{s}": (kind == "multiple_choice") & ~F.upper(answer).isin("A", "B", "C", "D"),
            f"not_boolean_{s}": (kind == "boolean") & ~F.lower(answer).isin("yes", "no", "true", "false"),
            f"not_numeric_{s}": (kind == "exact_numeric") & F.replace(answer, F.lit(","), F.lit("")).try_cast("double").isNull(),
        }
    return out | {"no_text": F.trim(F.coalesce(F.col("task_text"), F.lit(""))) == "", "no_target": (F.col("task_type") == "tailored") & F.col("target_model").isNull()}


def issue_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.select(F.explode(issues(rules)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def adaptive_thresholds(acc: DataFrame, strong: float = 0.6, weak: float = 0.4, need: int = 2, step: float = 0.05, steps: int = 20) -> DataFrame:
    """Per model the least relaxed (strong, weak) cut-offs with ``need`` domains on either side.

    In each step the side that is short moves by ``step``. When the cut-offs meet or cross, the last step is taken back on both sides.
    Counts change at the steps only, so a side's first sufficient step is a grouped minimum over a small grid, and so is the step of crossing.
    """
    grid = acc.select("model", "natural_acc", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    s, w = F.round(F.lit(strong) - F.col("k") * step, 10), F.round(F.lit(weak) + F.col("k") * step, 10)
    per = grid.groupBy("model", "k").agg(F.count_if(F.col("natural_acc") >= s).alias("ns"), F.count_if(F.col("natural_acc") <= w).alias("nw"))
    first = per.groupBy("model").agg(F.coalesce(F.min(F.when(F.col("ns") >= need, F.col("k"))), F.lit(steps)).alias("ks"), F.coalesce(F.min(F.when(F.col("nw") >= need, F.col("k"))), F.lit(steps)).alias("kw"))
    at = lambda t: (F.round(strong - F.least(t, F.col("ks")) * step, 10), F.round(weak + F.least(t, F.col("kw")) * step, 10))
    met = F.filter(F.sequence(F.lit(1), F.lit(steps)), lambda t: (t <= F.greatest("ks", "kw")) & (at(t)[0] <= at(t)[1]))
    ended = first.withColumn("t", F.get(met, F.lit(0)))
    back, last = at(F.col("t")), at(F.greatest("ks", "kw"))
    return ended.select("model", F.when(F.col("t").isNull(), last[0]).otherwise(F.round(back[0] + step, 10)).alias("strong_cut"), F.when(F.col("t").isNull(), last[1]).otherwise(F.round(back[1] - step, 10)).alias("weak_cut"))


def relabel_difficulty(solved: Column, source: Column) -> Column:
    """What a solver's success says about the source's difficulty label: a solved item is easy, or medium if said to be hard; a missed one is hard,
    or medium if said to be easy."""
    return F.when(solved, F.when(source == "hard", "medium").otherwise("easy")).when(source == "easy", "medium").otherwise("hard")


def triage(agree: Column, ambiguous: Column) -> Column:
    """Verdict of three verifiers from how many agree and whether any sees ambiguity."""
    return F.when((agree == 3) & ~ambiguous, "PASS").when((agree == 2) & ~ambiguous, "PASS_WITH_NOTE").when((agree >= 2) & ambiguous, "FLAG_AMBIGUOUS").otherwise("FLAG_WRONG_ANSWER")


def round_robin(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def repair_monotone(df: DataFrame, first: str = "correct_a", second: str = "correct_b") -> DataFrame:
    """A solved second part implies a solved first part."""
    return df.withColumn(first, F.col(first) | F.col(second))


def first_n(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    w = W.Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
