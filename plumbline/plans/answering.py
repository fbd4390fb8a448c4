"""Queries on answer extraction and matching: each order becomes a response whose outcome SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.calculator import calculator
from .frames import table
from .registry import query

# what an order lends to its response, in SQL that Spark and DuckDB read alike
NL = " || chr(10) || "
K = "CAST(o_custkey AS STRING)"
SECOND = "CAST(o_orderkey % 7 AS STRING)"
L = "substr('ABCD', CAST(o_custkey % 4 + 1 AS INT), 1)"
M = "substr('ABCD', CAST(o_orderkey % 4 + 1 AS INT), 1)"
SAME_LETTER = "o_custkey % 4 = o_orderkey % 4"
EVEN, NONE = "o_orderkey % 2 = 0", "NULL"


def _pick(options: list[str]) -> str:
    """One of the expressions by order; the orders go through them in turn."""
    return f"CASE o_orderkey % {len(options)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(options)) + " END"


def cases(name: str, inputs: tuple[str, ...], outputs: tuple[str, ...], rows: list[tuple[str, ...]]):
    """Register a query over all orders. A row gives an expression for each input, read by both engines, and one for each output, read
    by DuckDB alone; order number n follows row n modulo their count."""
    n = len(inputs)
    want = {o: _pick([r[n + i] for r in rows]) for i, o in enumerate(outputs)}
    sql = "SELECT o_orderkey, " + ", ".join(f"{e} AS {o}" for o, e in want.items()) + " FROM orders"

    def add(f: Callable[[], dict[str, Column]]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            texts = {c: F.expr(_pick([r[i] for r in rows]).replace("chr(10)", "'\\n'")) for i, c in enumerate(inputs)}
            orders = table(spark, sf_dir, "orders").select("o_orderkey", *[e.alias(c) for c, e in texts.items()])
            return orders.select("o_orderkey", *[c.alias(o) for o, c in f().items()])

        query(name, sql)(run)
        return f

    return add


_NEAR = "o_orderkey % {by} <= CASE WHEN {number} >= 1000 THEN 1 ELSE 0 END"


@cases("match_answer", ("predicted", "correct", "kind"), ("ok",), [
    (K, "CAST(o_custkey + o_orderkey % 3 AS STRING)", "'exact_numeric'", _NEAR.format(by=3, number="o_custkey + o_orderkey % 3")),
    (f"'$' || {K} || ',000'", "CAST(o_custkey * 1000 + o_orderkey % 4 AS STRING)", "'exact_numeric'", _NEAR.format(by=4, number="o_custkey * 1000 + o_orderkey % 4")),
    ("CAST(o_custkey * 4 + o_orderkey % 2 AS STRING) || '/4'", K, "'exact_numeric'", f"{EVEN} OR o_custkey >= 1000"),
    ("'approximately ' || CAST(o_custkey + o_orderkey % 2 AS STRING) || ' feet'", f"{K} || '%'", "'exact_numeric'", f"{EVEN} OR o_custkey >= 1000"),
    ("'The total, after all the steps, is this: so, the result is ' || CAST(o_custkey + o_orderkey % 2 * 2 AS STRING)", K, "'exact_numeric'", EVEN),
    (f"'(' || {L} || ') because'", f"lower({M})", "'multiple_choice'", SAME_LETTER),
    (f"'The answer is ' || {L}", M, "'multiple_choice'", SAME_LETTER),
    ("CASE o_custkey % 3 WHEN 0 THEN 'Yes, it is' WHEN 1 THEN 'No' ELSE 'perhaps' END", "CASE o_orderkey % 2 WHEN 0 THEN 'true' ELSE 'incorrect' END", "'boolean'", "o_custkey % 3 = o_orderkey % 2 AND o_custkey % 3 < 2"),
    ("o_orderpriority", "CASE o_custkey % 2 WHEN 0 THEN '  ' || lower(o_orderpriority) || ', or so' ELSE 'none of them' END", "'short_text'", "o_custkey % 2 = 0"),
    (K, f"{K} || '.0' || CAST(o_orderkey % 3 * 3 AS STRING)", "'other'", "o_orderkey % 3 = 0"),
    (f"'I cannot say ' || {K}", K, "'exact_numeric'", "false"),
])
def match():
    return {"ok": X.match_answer(F.col("predicted"), F.col("correct"), F.col("kind"))}


@cases("match_base", ("predicted", "correct", "kind"), ("ok",), [
    (f"'$' || {K} || ',000'", "CAST(o_custkey * 1000 + o_orderkey % 2 AS STRING) || '.005'", "'exact_numeric'", EVEN),
    ("o_orderstatus", "CASE o_custkey % 2 WHEN 0 THEN lower(o_orderstatus) || ' ' ELSE 'z' END", "'exact_numeric'", "o_custkey % 2 = 0"),
    (f"'it is (' || {L} || ')'", f"lower({M})", "'multiple_choice'", SAME_LETTER),
    ("CASE o_custkey % 2 WHEN 0 THEN 'incorrect' ELSE 'no' END", "CASE o_orderkey % 2 WHEN 0 THEN 'correct' ELSE 'false' END", "'boolean'", "o_custkey % 2 = o_orderkey % 2"),
    ("CASE o_custkey % 3 WHEN 0 THEN 'Big Apple' WHEN 1 THEN o_orderpriority ELSE substr(o_orderpriority, 1, 3) END", "o_orderpriority", "'short_text'", "o_custkey % 3 < 2"),
    ("lower(o_orderpriority)", "CASE o_custkey % 2 WHEN 0 THEN o_orderpriority || '  ' ELSE o_orderstatus END", "'none'", "o_custkey % 2 = 0"),
])
def base():
    return {"ok": X.match_base(F.col("predicted"), F.col("correct"), F.col("kind"), F.array(F.lit(" big apple")))}


_SKIP = f"'I will skip ' || {K}"


@cases("extract_answer", ("text", "kind", "channel"), ("answer",), [
    (f"'ANSWER: ' || {K} || ' apples'{NL}'BET: 3'", "'short_text'", "'1'", f"{K} || ' apples'"),
    (_SKIP, "'short_text'", "CASE o_custkey % 2 WHEN 0 THEN '1' ELSE '2' END", f"CASE o_custkey % 2 WHEN 0 THEN {_SKIP} ELSE 'SKIP' END"),
    ("'The answer is ' || o_orderpriority || '. Surely'", "'short_text'", "'1'", "o_orderpriority"),
    (f"'Therefore, the sum is ' || {K} || '.'", "'exact_numeric'", "'1'", K),
    (f"'2 + 2'{NL}'x = ' || {K}", "'exact_numeric'", "'1'", K),
    (f"'She is ' || {K} || ' years old.'", "'exact_numeric'", "'1'", K),
    (f"'It weighs approximately ' || {K} || ' units now'", "'exact_numeric'", "'1'", K),
    (f"'I pick ' || {L} || ' of them'", "'multiple_choice'", "'1'", L),
    (f"'first ' || {K} || ',200 then ' || {K} || ',300 of it'", "'exact_numeric'", "'1'", f"{K} || '300'"),
    ("'  just ' || o_orderpriority || '  '", "'short_text'", "'1'", "'just ' || o_orderpriority"),
    ("'   '", "'short_text'", "'1'", NONE),
])
def extract():
    return {"answer": X.extract_answer(F.col("text"), F.col("kind"), F.col("channel"))}


_SURE, _GUESS = "CAST(o_custkey % 101 AS STRING)", "CAST(o_orderkey % 97 AS STRING)"


@cases("parse_report_loosely", ("text",), ("confidence", "comparison", "weak_link", "prediction"), [
    (f"'CONFIDENCE = ' || {_SURE}{NL}'COMPARISON: Harder'{NL}'WEAK_LINK: Logic'{NL}'PREDICTION: ' || {_GUESS} || '%'", _SURE, "'harder'", "'logic'", _GUESS),
    (f"'about ' || {_SURE} || '% confidence; it seems easier; I struggle with spatial work; I predict ' || {_GUESS} || '% of them'", _SURE, "'easier'", "'spatial'", _GUESS),
    (f"'more challenging, ' || {_SURE} || '/100'", _SURE, "'harder'", NONE, NONE),
    ("'nothing of ' || o_orderstatus", NONE, NONE, NONE, NONE),
])
def loose():
    p = X.parse_report_loosely(F.col("text"))
    return {"confidence": p["confidence"].cast("string"), "comparison": p["comparison"], "weak_link": p["weak_link"], "prediction": p["prediction"].cast("string")}


@cases("paradigm_decisions", ("text",), ("a", "b"), [
    (f"'PART 1: ' || {K}{NL}'PART 2: I defer to you'", "'proceed'", "'defer'"),
    (f"'[USE_TOOL: calculator | ' || {K} || ']'{NL}'**PART 2**'{NL}'[FLAG_FOR_REVIEW: ' || o_orderstatus || ']'", "'use_tool'", "'defer'"),
    (f"'plain text ' || {K}", "'proceed'", "'proceed'"),
    (f"'PART 1: fine'{NL}'Part 2: [use_tool : lookup | ' || {K} || ']'", "'proceed'", "'use_tool'"),
])
def paradigm():
    s = X.split_parts(F.col("text"))
    return {"a": X.free_decision(s["a"]), "b": X.free_decision(s["b"])}


@cases("checkpoint_decisions", ("text",), ("a", "answer_a", "b", "answer_b"), [
    (f"'STEP 1'{NL}'YOUR DECISION: proceed'{NL}'YOUR ANSWER: ' || {K}{NL}'STEP 2'{NL}'DECISION: USE_TOOL calc'{NL}'ANSWER: ' || o_orderpriority", "'proceed'", K, "'use_tool'", "o_orderpriority"),
    (f"'STEP 1 flag for review, thus ' || {K}{NL}'STEP 2 DECISION: Needs review'", "'defer'", K, "'defer'", "''"),
    (f"'no steps ' || {K}", "'proceed'", "''", "'proceed'", "''"),
])
def checkpoint():
    s = X.split_steps(F.col("text"))
    return {"a": X.checkpoint_decision(s["a"]), "answer_a": X.checkpoint_answer(s["a"]), "b": X.checkpoint_decision(s["b"]), "answer_b": X.checkpoint_answer(s["b"])}


_TWO = "lpad(CAST(o_custkey % 100 AS STRING), 2, '0')"


@cases("behaviour_signals", ("text",), ("hedges_a", "steps_a", "answer_a", "hedges_b", "steps_b", "answer_b"), [
    (f"'First, I think it is about ' || {K} || '.'{NL}'ANSWER 1: ' || {K}{NL}'REASONING 2: then step by step'{NL}'ANSWER 2 - ' || o_orderpriority", "2", "1", K, "0", "3", "o_orderpriority"),
    (f"'Perhaps x = ' || {_TWO}", "1", "0", "'Perhaps'", "0", "0", _TWO),
])
def behaviour():
    s = X.split_reasoning(F.col("text"))
    a, b, n = s["a"], s["b"], lambda c: c.cast("int")
    return {
        "hedges_a": n(X.count_phrases(a, X.TASK_HEDGES)), "steps_a": n(X.count_steps(a)), "answer_a": X.numbered_answer(a, "1"),
        "hedges_b": n(X.count_phrases(b, X.TASK_HEDGES)), "steps_b": n(X.count_steps(b)), "answer_b": X.numbered_answer(b, "2"),
    }


_DIGIT = "CASE WHEN o_custkey % 8 BETWEEN 1 AND 5 THEN CAST(o_custkey % 8 AS STRING) END"


@cases("parse_burn", ("text",), ("approach", "tools", "hedges", "flagged", "answer"), [
    (f"'Approach: ' || CAST(o_custkey % 8 AS STRING){NL}'[USE_TOOL: calculator | 1] I think so [FLAG_FOR_REVIEW]'{NL}''{NL}'ANSWER: ' || {K}{NL}''{NL}'bye'", _DIGIT, "2", "1", "true", K),
    (f"'(' || CAST(o_custkey % 8 AS STRING) || ') nope'{NL}''{NL}'last words ' || o_orderstatus", _DIGIT, "0", "0", "false", "'last words ' || o_orderstatus"),
])
def burn():
    p = X.parse_burn(F.col("text"))
    return {"approach": p["approach"].cast("string"), "tools": F.size(p["tools_used"]), "hedges": p["hedge_count"], "flagged": p["flagged_for_review"], "answer": p["answer"]}


_BET = "CASE WHEN o_custkey % 13 BETWEEN 1 AND 10 THEN CAST(o_custkey % 13 AS STRING) END"


@cases("parse_phase", ("text",), ("wager", "opted_out", "used_tool", "difficulty", "hedges", "words"), [
    (f"'BET_1: ' || CAST(o_custkey % 13 AS STRING) || '.'{NL}'ANSWER_2: OPT_OUT'{NL}'DIFFICULTY_3: Hard'{NL}'ACTION_4: USE_TOOL'{NL}'ANSWER_5: I think it might be ' || {K}{NL}''{NL}'end'", _BET, "true", "true", "'hard'", "2", "6"),
    (f"'BET_1: eleven ' || {K}", NONE, "false", "false", NONE, "0", "0"),
])
def phase():
    p = X.parse_phase(F.col("text"))
    return {"wager": p["wager"].cast("string"), "opted_out": p["opted_out"], "used_tool": p["used_tool"], "difficulty": p["difficulty_self_report"], "hedges": p["natural_hedge_count"], "words": p["natural_length"].cast("int")}


_TRAITS = {"prior": "referenced_prior_failure", "skill": "flagged_specific_skill", "decomposed": "decomposed_more", "verified": "requested_verification", "uncertain": "expressed_calibrated_uncertainty", "alternative": "suggested_alternative"}


@cases("strategy_fingerprint", ("response", "feedback"), tuple(_TRAITS), [
    (f"'First, I verify ' || {K} || '. Second, instead of the last time'", "'the schedule was wrong'", "true", "true", "true", "true", "false", "true"),
    (f"'I might be wrong; less confident about the order ' || {K}", "'step order'", "false", "true", "false", "false", "false", "false"),
    (f"'this particular step ' || {K}", "CASE o_custkey % 2 WHEN 0 THEN 'procedure' ELSE 'nothing' END", "false", "o_custkey % 2 = 0", "false", "false", "true", "false"),
])
def fingerprint():
    p = X.fingerprint(F.col("response"), F.col("feedback"))
    return {short: p[trait] for short, trait in _TRAITS.items()}


@cases("extract_json", ("text",), ("json",), [
    ("'so {\"a\": {\"b\": ' || " + K + " || '}} done'", "'{\"a\": {\"b\": ' || " + K + " || '}}'"),
    (f"'[' || {K} || ', [2]] x'", f"'[' || {K} || ', [2]]'"),
    ("'{\"open\": ' || " + K, "'{\"open\": ' || " + K),
    (f"'  none ' || {K} || ' '", f"'none ' || {K}"),
    ("'a ] b { ' || o_orderstatus || ' }'", "'{ ' || o_orderstatus || ' }'"),
])
def json():
    return {"json": X.extract_json(F.col("text"))}


_ONE, _OTHER = "CASE o_custkey % 2 WHEN 0 THEN 'logic' ELSE 'social' END", "CASE o_custkey % 2 WHEN 0 THEN 'social' ELSE 'logic' END"


@cases("parse_ranking", ("text",), ("ranking",), [
    (f"'1. ' || {_ONE}{NL}'2) arithmetic work ' || {K}{NL}'3. ' || {_OTHER}", f"{_ONE} || ',arith,' || {_OTHER}"),
    (f"'1. logic'{NL}'2. social ' || {K}", NONE),
    (f"'intro ' || {K}{NL}'1. ' || {_ONE}{NL}'1. ' || {_ONE}{NL}'2. ' || {_OTHER}{NL}'3. Arithmetic'", f"{_ONE} || ',' || {_OTHER} || ',arith'"),
])
def ranking():
    return {"ranking": F.array_join(X.parse_ranking(F.col("text"), {"arith": "arithmetic", "logic": "logic", "social": "social"}), ",")}


_WEAK = "CASE o_custkey % 2 WHEN 0 THEN 'spatial' ELSE 'logic' END"


@cases("weak_link", ("text",), ("link",), [
    (f"'WEAK_LINK: **' || {_WEAK} || '**'", _WEAK),
    (f"'spatial and logic ' || {K}{NL}'more likely to struggle with ' || {_WEAK} || ' here'", _WEAK),
    (f"'fine ' || {K}", NONE),
    (f"'I am weak in ' || {_WEAK}", _WEAK),
])
def link():
    return {"link": X.weak_link(F.col("text"), F.lit("spatial"), F.lit("logic"))}


@cases("weak_link_accuracy", ("text", "actual"), ("named", "right"), [
    (f"'WEAK_LINK: **' || {_WEAK} || '**'", "CASE o_custkey % 3 WHEN 0 THEN 'spatial' ELSE 'logic' END", "true", "(o_custkey % 2 = 0) = (o_custkey % 3 = 0)"),
    (f"'fine ' || {K}", "'logic'", "false", NONE),
])
def link_accuracy():
    named = X.weak_link(F.col("text"), F.lit("spatial"), F.lit("logic"))
    return {"named": named.isNotNull(), "right": named == F.col("actual")}


@cases("infer_answer_type", ("expected",), ("kind",), [
    ("CASE o_custkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'TRUE ' ELSE 'false' END", "'boolean'"),
    (f"lower({L})", "'multiple_choice'"),
    (f"'about -' || {K}", "'exact_numeric'"),
    ("'Paris ' || o_orderstatus", "'short_text'"),
])
def kind():
    return {"kind": X.infer_answer_type(F.col("expected"))}


@cases("calculator", ("expression",), ("result",), [
    (f"{K} || '+2*' || {SECOND}", "CAST(o_custkey + 2 * (o_orderkey % 7) AS STRING)"),
    (f"'2**-1*' || {K}", "CAST(o_custkey // 2 AS STRING) || CASE o_custkey % 2 WHEN 1 THEN '.5' ELSE '' END"),
    (f"'-(' || {K} || '+1)**2'", "CAST(-(o_custkey + 1) * (o_custkey + 1) AS STRING)"),
    (f"{K} || '//7'", "CAST(o_custkey // 7 AS STRING)"),
    ("'sqrt(' || CAST(o_custkey * o_custkey AS STRING) || ')'", K),
    (f"{K} || '/0'", "'Error: division by zero'"),
    (f"'eval(' || {K} || ')'", "'Error: expression contains disallowed operations'"),
    (f"'(' || {K} || '+2'", f"'Error: invalid expression ''(' || {K} || '+2'''"),
    (f"{K} || ' % 9 / 4'", "CASE o_custkey % 9 WHEN 0 THEN '0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' WHEN 3 THEN '0.75' WHEN 4 THEN '1' WHEN 5 THEN '1.25' WHEN 6 THEN '1.5' WHEN 7 THEN '1.75' ELSE '2' END"),
    (f"'abs(-' || {K} || ')+int(2.9)'", "CAST(o_custkey + 2 AS STRING)"),
    ("''", "'Error: empty expression'"),
])
def sums():
    return {"result": calculator()("expression")}
