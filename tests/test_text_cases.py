"""Text extractors and matchers on literal cases with known outcomes."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions.calculator import calculator, evaluate

CASES = {}


def case(name, columns, rows):
    def add(f):
        CASES[name] = (columns.split(", "), rows, f)
        return f

    return add


def inputs(spark, columns, rows):
    structs = [F.struct(*[F.lit(v).cast("string").alias(c) if v is None else F.lit(v).alias(c) for c, v in zip(columns, r)]) for r in rows]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


_MATCH = [
    # predicted, correct, type, right
    ("3.14", "3.14159", "exact_numeric", True), ("42.01", "42", "exact_numeric", True), ("42.02", "42", "exact_numeric", False), ("3/4", "0.75", "exact_numeric", True), ("$1,234", "1234", "exact_numeric", True),
    ("75%", "75", "exact_numeric", True), ("approximately 42", "42", "exact_numeric", True), ("1000", "1001", "exact_numeric", True), ("1000", "1002", "exact_numeric", False), ("30 feet", "30", "exact_numeric", True), ("1/0", "1", "exact_numeric", False),
    ("none", "5", "exact_numeric", False), ("I cannot say 5", "5", "exact_numeric", False), ("The total, after all the steps, is this: so, the result is 12", "12", "exact_numeric", True), ("(B) because", "b", "multiple_choice", True), ("The answer is C", "C", "multiple_choice", True),
    ("A", "B", "multiple_choice", False), ("PARIS", "A", "multiple_choice", False), ("D.", "D", "multiple_choice", True), ("Yes, it is", "true", "boolean", True), ("incorrect", "correct", "boolean", False), ("No", "false", "boolean", True), ("perhaps", "true", "boolean", False),
    ("Paris", "Paris, France", "short_text", True), ("  rome ", "Rome", "short_text", True), ("", "Rome", "short_text", False), ("Lyon", "Rome", "short_text", False), ("7", "7.005", "other", True), ("b)", "B", "other", True), ("true", "yes", "other", True), ("I refuse", "yes", "other", False),
]


@case("match_answer", "predicted, correct, kind, ok", _MATCH)
def match(spark, d):
    rows = inputs(spark, ["predicted", "correct", "kind"], [r[:3] for r in _MATCH])
    return rows.select("predicted", "correct", "kind", X.match_answer(F.col("predicted"), F.col("correct"), F.col("kind")).alias("ok"))


_BASE = [("$1,000", "1000.005", "exact_numeric", True), ("x", "X ", "exact_numeric", True), ("it is (C)", "c", "multiple_choice", True), ("incorrect", "correct", "boolean", True), ("no", "false", "boolean", True), ("Big Apple", "New York", "short_text", True), ("york", "New York", "short_text", False), ("a", "A", "none", True)]


@case("match_base", "predicted, correct, kind, ok", _BASE)
def base(spark, d):
    rows = inputs(spark, ["predicted", "correct", "kind"], [r[:3] for r in _BASE])
    return rows.select("predicted", "correct", "kind", X.match_base(F.col("predicted"), F.col("correct"), F.col("kind"), F.array(F.lit(" big apple"))).alias("ok"))


_EXTRACT = [
    ("ANSWER: 12 apples\nBET: 3", "short_text", "1", "12 apples"), ("I will skip it", "short_text", "2", "SKIP"), ("The answer is blue. Surely", "short_text", "1", "blue"), ("Therefore, the sum is 9.", "exact_numeric", "1", "9"), ("2 + 2\nx = 4", "exact_numeric", "1", "4"),
    ("She is 31 years old.", "exact_numeric", "1", "31"), ("It weighs approximately 7 units now", "exact_numeric", "1", "7"), ("I pick C of them", "multiple_choice", "1", "C"), ("first 1,200 then 1,300 of it", "exact_numeric", "1", "1300"), ("  just words  ", "short_text", "1", "just words"), ("   ", "short_text", "1", None),
]


@case("extract_answer", "text, kind, channel, answer", _EXTRACT)
def extract(spark, d):
    rows = inputs(spark, ["text", "kind", "channel"], [r[:3] for r in _EXTRACT])
    return rows.select("text", "kind", "channel", X.extract_answer(F.col("text"), F.col("kind"), F.col("channel")).alias("answer"))


_LOOSE = [("CONFIDENCE = 80\nCOMPARISON: Harder\nWEAK_LINK: Logic\nPREDICTION: 85%", 80, "harder", "logic", 85), ("about 70% confidence; it seems easier; I struggle with spatial work; I predict 60% of them", 70, "easier", "spatial", 60), ("more challenging, 55/100", 55, "harder", None, None), ("nothing", None, None, None, None)]


@case("parse_report_loosely", "text, confidence, comparison, weak_link, prediction", [(r[0], *[None if x is None else str(x) for x in r[1:]]) for r in _LOOSE])
def loose(spark, d):
    rows = inputs(spark, ["text"], [(r[0],) for r in _LOOSE]).withColumn("p", X.parse_report_loosely(F.col("text")))
    return rows.select("text", F.col("p.confidence").cast("string").alias("confidence"), "p.comparison", "p.weak_link", F.col("p.prediction").cast("string").alias("prediction"))


_AGENT = [
    ("PART 1: 4\nPART 2: I defer to you", "proceed", "defer"), ("[USE_TOOL: calculator | 2]\n**PART 2**\n[FLAG_FOR_REVIEW: b]", "use_tool", "defer"), ("plain text", "proceed", "proceed"),
]


@case("paradigm_decisions", "text, a, b", _AGENT)
def paradigm(spark, d):
    rows = inputs(spark, ["text"], [(r[0],) for r in _AGENT]).withColumn("s", X.split_parts(F.col("text")))
    return rows.select("text", X.free_decision(F.col("s.a")).alias("a"), X.free_decision(F.col("s.b")).alias("b"))


_STEPS = [
    ("STEP 1\nYOUR DECISION: proceed\nYOUR ANSWER: 5\nSTEP 2\nDECISION: USE_TOOL calc\nANSWER: 6", "proceed", "5", "use_tool", "6"), ("STEP 1 flag for review, thus 3\nSTEP 2 DECISION: Needs review", "defer", "3", "defer", ""), ("no steps", "proceed", "", "proceed", ""),
]


@case("checkpoint_decisions", "text, a, answer_a, b, answer_b", _STEPS)
def checkpoint(spark, d):
    rows = inputs(spark, ["text"], [(r[0],) for r in _STEPS]).withColumn("s", X.split_steps(F.col("text")))
    return rows.select("text", X.checkpoint_decision(F.col("s.a")).alias("a"), X.checkpoint_answer(F.col("s.a")).alias("answer_a"), X.checkpoint_decision(F.col("s.b")).alias("b"), X.checkpoint_answer(F.col("s.b")).alias("answer_b"))


_SIGNAL = [("First, I think it is about 5.\nANSWER 1: 5\nREASONING 2: then step by step\nANSWER 2 - 7", 2, 1, "5", 0, 2, "7"), ("Perhaps x = 3", 1, 0, "Perhap", 0, 0, "s x = 3")]


@case("behaviour_signals", "text, hedges_a, steps_a, answer_a, hedges_b, steps_b, answer_b", [("First, I think it is about 5.\nANSWER 1: 5\nREASONING 2: then step by step\nANSWER 2 - 7", 2, 1, "5", 0, 3, "7"), ("Perhaps x = 3", 0, 0, "Perhap", 0, 0, "3")])
def behaviour(spark, d):
    rows = inputs(spark, ["text"], [(r[0],) for r in _SIGNAL]).withColumn("s", X.split_reasoning(F.col("text")))
    n = lambda c: c.cast("int")
    a, b = F.col("s.a"), F.col("s.b")
    return rows.select("text", n(X.count_phrases(a, X.TASK_HEDGES)).alias("hedges_a"), n(X.count_steps(a)).alias("steps_a"), X.numbered_answer(a, "1").alias("answer_a"), n(X.count_phrases(b, X.TASK_HEDGES)).alias("hedges_b"), n(X.count_steps(b)).alias("steps_b"), X.numbered_answer(b, "2").alias("answer_b"))


_BURN = [("Approach: 3\n[USE_TOOL: calculator | 1] I think so [FLAG_FOR_REVIEW]\n\nANSWER: 12\n\nbye", "3", 2, 1, True, "12"), ("(7) nope\n\nlast words", None, 0, 0, False, "last words")]


@case("parse_burn", "text, approach, tools, hedges, flagged, answer", _BURN)
def burn(spark, d):
    rows = inputs(spark, ["text"], [(r[0],) for r in _BURN]).withColumn("p", X.parse_burn(F.col("text")))
    return rows.select("text", F.col("p.approach").cast("string").alias("approach"), F.size("p.tools_used").alias("tools"), F.col("p.hedge_count").alias("hedges"), F.col("p.flagged_for_review").alias("flagged"), "p.answer")


_PHASE = [("BET_1: 7.\nANSWER_2: OPT_OUT\nDIFFICULTY_3: Hard\nACTION_4: USE_TOOL\nANSWER_5: I think it might be so\n\nend", "7", True, True, "hard", 2, 6), ("BET_1: eleven", None, False, False, None, 0, 0)]


@case("parse_phase", "text, wager, opted_out, used_tool, difficulty, hedges, words", _PHASE)
def phase(spark, d):
    rows = inputs(spark, ["text"], [(r[0],) for r in _PHASE]).withColumn("p", X.parse_phase(F.col("text")))
    return rows.select("text", F.col("p.wager").cast("string").alias("wager"), "p.opted_out", "p.used_tool", F.col("p.difficulty_self_report").alias("difficulty"), F.col("p.natural_hedge_count").alias("hedges"), F.col("p.natural_length").cast("int").alias("words"))


_PRINT = [("First, I verify. Second, instead of the last time", "the schedule was wrong", True, True, True, True, False, True), ("I might be wrong; less confident about the order", "step order", False, True, False, False, False, False), ("this particular step", "procedure", False, True, False, False, True, False)]


@case("strategy_fingerprint", "response, feedback, prior, skill, decomposed, verified, uncertain, alternative", _PRINT)
def fingerprint(spark, d):
    rows = inputs(spark, ["response", "feedback"], [r[:2] for r in _PRINT]).withColumn("p", X.fingerprint(F.col("response"), F.col("feedback")))
    return rows.select("response", "feedback", *[F.col(f"p.{a}").alias(b) for a, b in (("referenced_prior_failure", "prior"), ("flagged_specific_skill", "skill"), ("decomposed_more", "decomposed"), ("requested_verification", "verified"), ("expressed_calibrated_uncertainty", "uncertain"), ("suggested_alternative", "alternative"))])


_JSON = [('so {"a": {"b": 1}} done', '{"a": {"b": 1}}'), ("[1, [2]] x", "[1, [2]]"), ('{"open": 1', '{"open": 1'), ("  none ", "none"), ("a ] b { c }", "{ c }")]


@case("extract_json", "text, json", _JSON)
def json(spark, d):
    return inputs(spark, ["text"], [(r[0],) for r in _JSON]).select("text", X.extract_json(F.col("text")).alias("json"))


_RANK = [("1. Logic\n2) arithmetic work\n3. social", "logic,arith,social"), ("1. logic\n2. social", None), ("intro\n1. social\n1. social\n2. logic\n3. arithmetic", "social,logic,arith")]


@case("parse_ranking", "text, ranking", _RANK)
def ranking(spark, d):
    rows = inputs(spark, ["text"], [(r[0],) for r in _RANK])
    return rows.select("text", F.array_join(X.parse_ranking(F.col("text"), {"arith": "arithmetic", "logic": "logic", "social": "social"}), ",").alias("ranking"))


_LINK = [("WEAK_LINK: **spatial**", "spatial", "logic", "spatial"), ("spatial and logic\nmore likely to struggle with logic here", "spatial", "logic", "logic"), ("fine", "spatial", "logic", None), ("I am weak in logic", "spatial", "logic", "logic")]


@case("weak_link", "text, a, b, link", _LINK)
def link(spark, d):
    return inputs(spark, ["text", "a", "b"], [r[:3] for r in _LINK]).select("text", "a", "b", X.weak_link(F.col("text"), F.col("a"), F.col("b")).alias("link"))


_TYPE = [(" Yes", "boolean"), ("b", "multiple_choice"), ("about -3", "exact_numeric"), ("Paris", "short_text")]


@case("infer_answer_type", "expected, kind", _TYPE)
def kind(spark, d):
    return inputs(spark, ["expected"], [(r[0],) for r in _TYPE]).select("expected", X.infer_answer_type(F.col("expected")).alias("kind"))


_SUMS = ["1+2*3", "2**-1", "-2**2", "7//2", "sqrt(16)", "1/0", "import os", "(1+2", "10/4", "abs(-3)+int(2.9)", ""]


@case("calculator", "expression, result", [("1+2*3", "7"), ("2**-1", "0.5"), ("-2**2", "-4"), ("7//2", "3"), ("sqrt(16)", "4"), ("1/0", "Error: division by zero"), ("import os", "Error: expression contains disallowed operations"), ("(1+2", "Error: invalid expression '(1+2'"), ("10/4", "2.5"), ("abs(-3)+int(2.9)", "5"), ("", "Error: empty expression")])
def sums(spark, d):
    assert evaluate("1") == "1"
    return inputs(spark, ["expression"], [(s,) for s in _SUMS]).select("expression", calculator()("expression").alias("result"))


@pytest.mark.parametrize("name", sorted(CASES))
def test_case(spark, name):
    columns, rows, f = CASES[name]
    got = sorted(repr(tuple(r[c] for c in columns)) for r in f(spark, None).collect())
    assert got == sorted(repr(tuple(r)) for r in rows)
