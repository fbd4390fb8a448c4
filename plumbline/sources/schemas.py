"""Declared types of the record kinds, and normalisers that apply defaults once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARSED = """struct<answer:string,bet:int,skipped:boolean,choice:string,selected_question_id:string,tools_used:array<struct<tool_name:string,tool_input:string>>,
 response_length:int,hedging_count:int,caveat_count:int,confidence:double,sub_skills:array<string>,weakest_skill:string,verify:boolean,approach:string,refused:boolean,parse_success:boolean>"""
MEASUREMENT = f"question_id string, model string, channel string, channel_name string, layer int, domain string, difficulty string, answer_correct boolean, parse_success boolean, raw_response string, latency_ms double, timestamp string, parsed {PARSED}"
QUESTION = "question_text string, correct_answer string, answer_type string, source string, source_id string, domain string, subcategory string, difficulty string, metadata map<string,string>, transformation string, parent_id string"


def _slot(s: str) -> str:
    return (
        f"domain_{s} string, subcategory_{s} string, difficulty_{s} string, strength_{s} string, component_{s}_decision string, component_{s}_correct boolean, component_{s}_answer string, component_{s}_tool_used boolean, component_{s}_deferred boolean, "
        f"component_{s}_externally_routed boolean, exp1_accuracy_{s} double, calibration_gap_{s} double, hedge_count_{s} int, decomp_count_{s} int, token_count_{s} int, error_type_{s} string"
    )


TRIAL = f"model string, task_id string, condition int, paradigm int, is_false_score_control boolean, task_type string, circularity_free boolean, {_slot('a')}, {_slot('b')}, raw_response string, api_success boolean, timestamp string"
PACKET = {
    "traffic": "request_id string, timestamp_utc string, workflow string, risk_tier string, input_text string, model_decision string, model_answer string",
    "outcomes": "request_id string, final_correct string, resolver_type string, resolver_decision string, resolved_at_utc string",
    "cost_latency": "request_id string, model_latency_ms string, resolver_latency_ms string, total_latency_ms string, cost_usd string, tokens_in string, tokens_out string",
}


def trials(raw: DataFrame, success_default: bool = True) -> DataFrame:
    """Trial records with plain slot names and defaults: api_success as given, flags false, a missing label wrong."""
    out = raw
    for s in "ab":
        out = out.withColumnsRenamed({f"component_{s}_decision": f"decision_{s}", f"component_{s}_correct": f"correct_{s}", f"component_{s}_externally_routed": f"routed_{s}", f"hedge_count_{s}": f"hedges_{s}", f"decomp_count_{s}": f"decomps_{s}", f"token_count_{s}": f"tokens_{s}", f"error_type_{s}": f"error_{s}"})
        out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in ((f"correct_{s}", False), (f"routed_{s}", False), (f"strength_{s}", "unknown"), (f"hedges_{s}", 0), (f"decomps_{s}", 0), (f"tokens_{s}", 0))})
    return out.withColumnRenamed("is_false_score_control", "false_score").withColumns({"api_success": F.coalesce("api_success", F.lit(success_default)), "false_score": F.coalesce("false_score", F.lit(False)), "circularity_free": F.coalesce("circularity_free", F.lit(False))})


def numbers(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Text columns as numbers; what is no number is null."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c in columns})
