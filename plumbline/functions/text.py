"""Text extractors and matchers as Columns. Null or unmatched text gives null unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import let

# Phrase lists and unit words.
REFUSALS = (
    "i cannot", "i can't", "i am unable", "i'm unable", "i must decline", "i apologize", "i won't", "i will not", "not able to",
    "cannot assist", "cannot help", "inappropriate", "against my", "not appropriate",
)
ANSWER_REFUSALS = (*REFUSALS, "i refuse")
HEDGES = (
    "i think", "probably", "i'm not sure", "i am not sure", "i believe", "this might be", "it's possible", "its possible", "if i recall",
    "i'm not certain", "i am not certain", "perhaps", "likely", "arguably", "it seems",
)
CAVEATS = ("however", "but note that", "although", "it's worth noting", "its worth noting", "keep in mind", "caveat", "disclaimer", "i should note", "to be fair")
TASK_HEDGES = (
    "approximately", "roughly", "about", "around", "i think", "i believe", "probably", "maybe", "perhaps", "might be", "not entirely sure", "not sure",
    "unclear", "unsure", "uncertain", "could be", "possibly", "it seems", "i'm not certain", "hard to say",
)
BURN_HEDGES = (*HEDGES, "appears to be", "could be", "may be", "might be", "possibly", "uncertain")
PHASE_HEDGES = ("i think", "probably", "i'm not sure", "i believe", "perhaps", "likely", "might be", "could be", "possibly", "uncertain", "it seems", "appears to be")
SIGNAL_HEDGES = (
    "i think", "probably", "i'm not sure", "might be", "perhaps", "i believe", "not certain", "unclear", "it seems", "possibly", "i'm uncertain", "i guess",
    "maybe", "could be", "appears to",
)
SIGNAL_CAVEATS = ("however", "although", "but note", "caveat", "keep in mind", "worth noting", "it's important to", "that said", "on the other hand")
FLAWS = ("flawed", "false assumption", "incorrect premise", "invalid", "impossible", "not possible", "not true", "wrong", "i cannot", "can't", "i would not", "should not", "unsafe")
TOOLS = ("calculator", "web_search", "ask_expert", "flag_review")
APPROACHES = ("direct-solve", "decompose", "tool-use", "ask-for-help")
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "correct", "t", "y", "1", "right"), ("false", "no", "incorrect", "f", "n", "0", "wrong")
BASE_TRUE, BASE_FALSE = ("true", "yes", "correct", "t", "y", "1"), ("false", "no", "incorrect", "f", "n", "0")
_MEASURES = (
    r"feet|foot|meters?|kilometres?|kilometers?|km|miles?|kilograms?|kg|grams?|gr?|pounds?|lbs?|ounces?|oz|inches?|centimeters?|cm|millimeters?|mm|"
    r"hours?|minutes?|seconds?|days?|weeks?|months?|years?|dollars?|cents?|euros?|degrees?|radians?|units?|percent|pct"
)
_STEPS = r"(?i)\b(step|first(?:ly)?|second(?:ly)?|third(?:ly)?|then|next|finally|sub-?problem|break(?:ing)?\s+down|identify|let\s+me\s+consider)\b"
_FLAG = r"(?i)\[FLAG_FOR_REVIEW[^\]]*\]|I\s+defer\b|FLAG\s+FOR\s+REVIEW|flagging\s+for\s+review"
FINGERPRINT = {
    "referenced_prior_failure": ("earlier mistake", "previous task", "last time", "given my", "similar to the", "i should be more careful", "learning from", "based on the feedback", "after getting it wrong"),
    "decomposed_more": ("first,", "second,", "third,", "step 1", "step 2", "let me break", "break this down", "breaking it down"),
    "requested_verification": ("verify", "check", "confirm", "validate", "review", "double-check", "should be checked"),
    "specific": ("less confident about", "uncertain about the", "not sure about the specific", "this particular", "might need to check the"),
    "generic": ("i might be wrong", "i could be mistaken", "not entirely sure"),
    "suggested_alternative": ("alternative", "instead", "different approach", "another way", "better to", "should probably"),
}
SKILL_WORDS = {
    "procedural": ("procedure", "step", "order", "sequence"),
    "social": ("social", "interpersonal", "emotion", "communication"),
    "temporal": ("time", "schedule", "temporal", "timezone"),
    "spatial": ("spatial", "location", "distance", "direction"),
    "logical": ("logical", "reasoning", "argument"),
    "linguistic": ("linguistic", "language", "grammar"),
}


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def grab(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null if there is none or the group is empty. The match is made once."""
    return let(F.regexp_extract(x, pattern, group), blank)


def blank(x: Column) -> Column:
    return F.when(F.length(x) > 0, x)


def count_phrases(x: Column, phrases) -> Column:
    """Sum of the phrases' non-overlapping occurrences in the lower-cased text; null counts 0."""
    low = F.lower(F.coalesce(x, F.lit("")))
    out = F.lit(0)
    for p in phrases:
        out = out + ((F.length(low) - F.length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return out


def present(x: Column, phrases) -> Column:
    """How many of the phrases occur in the lower-cased text; null has none."""
    low = F.lower(F.coalesce(x, F.lit("")))
    out = F.lit(0)
    for p in phrases:
        out = out + F.contains(low, F.lit(p)).cast("int")
    return out


def refuses(x: Column, phrases=REFUSALS) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def word_count(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"\S+"))


def unbracket(x: Column) -> Column:
    return F.when(x.startswith("[") & x.endswith("]") & (F.length(x) > 1), strip(F.substr(x, F.lit(2), F.length(x) - 2))).otherwise(x)


def strip_markdown(x: Column) -> Column:
    """Text without emphasis marks, backquotes and heading marks, for labels that a model has decorated."""
    return F.regexp_replace(F.regexp_replace(x, r"(?m)^#{1,6}\s+", ""), r"\*{1,3}|_{2}|`+", "")


def labeled(x: Column, label: str) -> Column:
    """What follows ``LABEL:`` up to the next label or the end, without brackets around it; else the rest of the label's line."""
    q = re.escape(label)
    clean = lambda pattern: let(let(strip(F.regexp_extract(x, pattern, 1)), unbracket), blank)
    return F.coalesce(clean(rf"(?is){q}\s*:\s*(.+?)(?=\n[A-Z_]{{2,}}\s*:|$)"), clean(rf"(?i){q}\s*:\s*(.+)"))


def strip_thinking(x: Column) -> Column:
    """(cleaned, thinking): text without ``<think>`` blocks, and the blocks' stripped contents joined by blank lines."""
    blocks = F.regexp_extract_all(x, F.lit(r"(?is)<think>(.*?)</think>"), F.lit(1))
    return F.struct(
        strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)<think>(.*?)</think>", "")).alias("cleaned"),
        F.when(F.size(blocks) > 0, F.array_join(F.transform(blocks, strip), "\n\n")).alias("thinking"),
    )


def parse_wager(x: Column) -> Column:
    """answer, bet (1-10, or a lone number in the last line of a text that never says BET), refused, parse_success."""
    said = grab(x, r"(?i)BET\s*:\s*(\d+)").try_cast("int")
    tail = F.element_at(F.split(strip(x), "\n"), -1)
    lone = F.when(~F.contains(F.upper(x), F.lit("BET")), grab(tail, r"\b([1-9]|10)\b").cast("int"))
    found = F.struct(refuses(x).alias("no"), labeled(x, "ANSWER").alias("answer"), said.alias("said"), lone.alias("lone"))

    def out(f: Column) -> Column:
        answer = F.when(~f["no"], f["answer"])
        bet = F.when(~f["no"], F.coalesce(F.when(f["said"].between(1, 10), f["said"]), f["lone"]))
        return F.struct(answer.alias("answer"), bet.alias("bet"), f["no"].alias("refused"), (answer.isNotNull() & bet.isNotNull()).alias("parse_success"))

    return let(found, out)


def parse_optout(x: Column) -> Column:
    skips = F.coalesce(F.regexp_like(x, F.lit(r"(?i)\bSKIP\b")) & ~F.regexp_like(x, F.lit(r"(?i)(don'?t|not|no)\s+skip")), F.lit(False))
    found = F.struct(refuses(x).alias("no"), skips.alias("skips"), labeled(x, "ANSWER").alias("own"), F.left(strip(x), F.lit(500)).alias("all"))

    def out(f: Column) -> Column:
        skipped, tried = ~f["no"] & f["skips"], ~f["no"] & ~f["skips"]
        answer = F.when(tried, F.coalesce(f["own"], blank(f["all"])))
        return F.struct(answer.alias("answer"), skipped.alias("skipped"), f["no"].alias("refused"), (skipped | (tried & f["own"].isNotNull())).alias("parse_success"))

    return let(found, out)


def parse_choice(x: Column) -> Column:
    choice = F.upper(F.coalesce(grab(x, r"(?i)CHOICE\s*:\s*([AB])"), grab(x, r"\b([AB])\b")))
    found = F.struct(refuses(x).alias("no"), choice.alias("choice"), labeled(x, "ANSWER").alias("answer"))

    def out(f: Column) -> Column:
        choice, answer = F.when(~f["no"], f["choice"]), F.when(~f["no"], f["answer"])
        return F.struct(choice.alias("choice"), answer.alias("answer"), f["no"].alias("refused"), (choice.isNotNull() & answer.isNotNull()).alias("parse_success"))

    return let(found, out)


_CALL = r"(?i)\[USE_TOOL\s*:\s*(\w+)\s*\|\s*([^\]]+)\]"


def parse_tools(x: Column, tools=TOOLS) -> Column:
    """answer and tools_used, an array of (tool_name, tool_input) for the known tools."""
    names, inputs = (F.regexp_extract_all(x, F.lit(_CALL), F.lit(i)) for i in (1, 2))
    calls = F.zip_with(names, inputs, lambda n, i: F.struct(F.lower(n).alias("tool_name"), strip(i).alias("tool_input")))
    used = F.filter(calls, lambda c: c["tool_name"].isin(*tools))
    none = F.array().cast("array<struct<tool_name:string,tool_input:string>>")
    answer = F.coalesce(labeled(x, "ANSWER"), let(F.left(strip(F.regexp_replace(x, _CALL, "")), F.lit(1000)), blank))
    found = F.struct(refuses(x).alias("no"), answer.alias("answer"), F.coalesce(used, none).alias("used"))

    def out(f: Column) -> Column:
        answer = F.when(~f["no"], f["answer"])
        return F.struct(answer.alias("answer"), F.when(f["no"], none).otherwise(f["used"]).alias("tools_used"), f["no"].alias("refused"), answer.isNotNull().alias("parse_success"))

    return let(found, out)


def parse_natural(x: Column, hedges=HEDGES, caveats=CAVEATS) -> Column:
    answer = F.coalesce(labeled(x, "ANSWER"), blank(F.left(strip(x), F.lit(500))))
    return F.struct(answer.alias("answer"), word_count(x).alias("response_length"), count_phrases(x, hedges).alias("hedging_count"), count_phrases(x, caveats).alias("caveat_count"), refuses(x).alias("refused"), F.lit(True).alias("parse_success"))


def _edges(x: Column) -> Column:
    return F.regexp_replace(x, r"^[\[\]]+|[\[\]]+$", "")


def parse_report(x: Column) -> Column:
    """The structured self-report: confidence (clamped to 0-100), sub_skills, weakest_skill, verify, approach, answer."""
    line = lambda label: strip(grab(x, rf"(?i){label}\s*:\s*(.+?)(?:\n|$)"))
    skills = F.filter(F.transform(F.split(_edges(line("SUB_SKILLS")), ","), strip), lambda s: s != "")

    def way(raw: Column) -> Column:
        out = F.left(raw, F.lit(50))
        for name in reversed(APPROACHES):
            out = F.when(F.contains(raw, F.lit(name)) | F.contains(raw, F.lit(name.replace("-", " "))), F.lit(name)).otherwise(out)
        return out

    found = F.struct(
        refuses(x).alias("no"), F.least(grab(x, r"(?i)CONFIDENCE\s*:\s*(\d{1,3})").cast("int"), F.lit(100)).alias("confidence"), skills.alias("skills"), _edges(line("WEAKEST_SKILL")).alias("weakest"),
        F.lower(grab(x, r"(?i)VERIFY\s*:\s*(\w+)")).isin("yes", "true", "1", "y").alias("verify"), let(F.lower(_edges(line("APPROACH"))), way).alias("approach"), labeled(x, "ANSWER").alias("answer"),
    )

    def out(f: Column) -> Column:
        ok = lambda c: F.when(~f["no"], f[c])
        return F.struct(
            ok("confidence").alias("confidence"), F.coalesce(ok("skills"), F.array().cast("array<string>")).alias("sub_skills"), ok("weakest").alias("weakest_skill"), ok("verify").alias("verify"), ok("approach").alias("approach"),
            ok("answer").alias("answer"), f["no"].alias("refused"), (ok("confidence").isNotNull() & ok("answer").isNotNull()).alias("parse_success"),
        )

    return let(found, out)


#: Parsers by channel; more can be added.
PARSERS = {"1": parse_wager, "2": parse_optout, "3": parse_choice, "4": parse_tools, "5": parse_natural, "layer2": parse_report}


def parse_report_loosely(x: Column) -> Column:
    """Confidence, comparison, weak_link and prediction by the first of several spellings."""
    first = lambda *ps: F.coalesce(*[grab(x, p) for p in ps])
    confidence = first(r"(?i)CONFIDENCE[:\s=-]+(\d+)", r"(?i)confidence\s+(?:is|at|level)[:\s]+(\d+)", r"(?i)(\d+)%?\s*confidence", r"(?i)rate.*?confidence.*?(\d+)", r"(?i)(\d+)\s*/\s*100")
    plain = F.lower(first(r"(?i)COMPARISON[:\s=-]+(easier|same|harder)", r"(?i)(?:will be|would be|is|seems)\s+(easier|same|harder)", r"(?i)(easier|harder|same)\s+than"))
    hard = F.when(F.regexp_like(x, F.lit(r"(?i)(more|less)\s+(difficult|challenging)")), F.lit("harder"))
    link = F.lower(first(r"(?i)WEAK[_\s-]?LINK[:\s=-]+(\w+)", r"(?i)(?:struggle|difficulty|weaker|weakness)\s+(?:with|at|in)\s+(\w+)", r"(?i)(\w+)\s+(?:is|will be)\s+(?:weaker|harder|more difficult)", r"(?i)more\s+likely\s+to\s+struggle\s+with\s+(\w+)"))
    prediction = first(r"(?i)PREDICTION[:\s=-]+(\d+)%?", r"(?i)predict.*?(\d+)%", r"(?i)estimate.*?(\d+)%", r"(?i)(\d+)%\s+(?:accuracy|correct)", r"(?i)accuracy.*?(\d+)%")
    return F.struct(confidence.cast("int").alias("confidence"), F.coalesce(plain, hard).alias("comparison"), link.alias("weak_link"), prediction.cast("int").alias("prediction"))


# -- agentic paradigms ------------------------------------------------------------------------------------


def split_at(x: Column, pattern: str) -> Column:
    """The text before and from the first match of ``pattern``, else its two halves."""
    at = F.regexp_instr(x, F.lit(pattern))
    mid = F.floor(F.length(x) / 2).cast("int")
    cut = F.when(at > 0, at - 1).otherwise(mid)
    return F.struct(F.left(x, cut).alias("a"), F.substr(x, cut + 1, F.length(x)).alias("b"))


def split_parts(x: Column) -> Column:
    return split_at(x, r"(?im)(?:^|\n)\s*(?:PART\s*2|Part\s*2|\*\*PART\s*2\*\*|2\.\s)")


def split_reasoning(x: Column) -> Column:
    return split_at(x, r"(?im)(?:^|\n)\s*(?:PART\s*2|REASONING\s*2|ANSWER\s*2)")


def split_steps(x: Column) -> Column:
    return F.struct(F.coalesce(grab(x, r"(?is)(STEP\s*1.*?(?=STEP\s*2|$))"), F.lit("")).alias("a"), F.coalesce(grab(x, r"(?is)(STEP\s*2.*)"), F.lit("")).alias("b"))


def free_decision(x: Column) -> Column:
    return F.when(F.regexp_like(x, F.lit(_FLAG)), "defer").when(F.regexp_like(x, F.lit(r"(?i)\[USE_TOOL\s*:")), "use_tool").otherwise("proceed")


def checkpoint_decision(x: Column) -> Column:
    d = F.upper(strip(grab(x, r"(?i)(?:YOUR\s+)?DECISION\s*:\s*([^\n]+)")))
    scan = F.when(F.regexp_like(x, F.lit(r"(?i)FLAG_FOR_REVIEW|FLAG\s+FOR\s+REVIEW")), "defer").when(F.regexp_like(x, F.lit(r"(?i)\bUSE_TOOL\b|USE TOOL")), "use_tool").otherwise("proceed")
    said = F.when(F.contains(d, F.lit("FLAG")) | F.contains(d, F.lit("REVIEW")), "defer").when(F.contains(d, F.lit("TOOL")), "use_tool").otherwise("proceed")
    return F.when(d.isNull(), scan).otherwise(said)


def checkpoint_answer(x: Column) -> Column:
    return F.coalesce(strip(grab(x, r"(?i)(?:YOUR\s+)?ANSWER\s*:\s*([^\n]+)")), strip(grab(x, r"(?i)(?:therefore|thus|so|result)[,:\s]+([^\n.]{1,100})")), F.lit(""))


def last_line(x: Column) -> Column:
    lines = F.filter(F.transform(F.split(x, "\n"), strip), lambda s: s != "")
    return F.when(F.size(lines) > 0, F.element_at(lines, -1))


def free_answer(x: Column) -> Column:
    """After ``answer:``, else after ``=`` at the end of the last line, else the last line's first 120 characters."""
    end = last_line(x)
    return F.coalesce(strip(grab(x, r"(?i)(?:final\s+)?answer\s*[:\-]\s*([^\n]{1,300})")), strip(grab(end, r"=\s*([\d,.\-+]+(?:\.\d+)?)\s*$")), F.left(end, F.lit(120)), F.lit(""))


def numbered_answer(x: Column, number: str) -> Column:
    return F.coalesce(strip(grab(x, rf"(?i)ANSWER\s*{number}\s*[:\-]\s*([^\n]{{1,300}})")), free_answer(x))


def count_steps(x: Column) -> Column:
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(_STEPS))


def error_type(answer: Column, correct: Column, hedges: Column, least: int = 1) -> Column:
    precise = F.regexp_like(answer, F.lit(r"\b\d+(?:[.,]\d+)?\b")) | (word_count(answer) <= 6)
    return F.when(correct, None).when(hedges >= least, "cautious_approximate").when(precise, "overconfident_precise").otherwise("cautious_approximate")


def parse_burn(x: Column) -> Column:
    """approach (1-5), tools_used, hedge_count, length_tokens, flagged_for_review and answer of a multi-phase response."""
    digits = [grab(x, p).cast("int") for p in (r"(?im)approach[:\s]+(\d)", r"(?im)option[:\s]+(\d)", r"(?im)select[:\s]+(\d)", r"(?im)choose[:\s]+(\d)", r"(?im)^\s*\((\d)\)")]
    approach = F.coalesce(*[F.when(d.between(1, 5), d) for d in digits])
    flagged = F.contains(x, F.lit("[FLAG_FOR_REVIEW]"))
    tools = F.concat(F.regexp_extract_all(x, F.lit(r"(?i)\[USE_TOOL:\s*(\w+)"), F.lit(1)), F.when(flagged, F.array(F.lit("flag_review"))).otherwise(F.array().cast("array<string>")))
    paragraphs = F.filter(F.transform(F.split(x, "\n\n"), strip), lambda s: s != "")
    answer = F.coalesce(strip(grab(x, r"(?is)ANSWER:\s*(.+?)(?:\n\n|$)")), strip(grab(x, r"(?is)(?:final answer|solution|result):\s*(.+?)(?:\n\n|$)")), F.when(F.size(paragraphs) > 0, F.element_at(paragraphs, -1)), F.lit(""))
    return F.struct(approach.alias("approach"), tools.alias("tools_used"), count_phrases(x, BURN_HEDGES).alias("hedge_count"), word_count(x).alias("length_tokens"), flagged.alias("flagged_for_review"), answer.alias("answer"))


def section(x: Column, marker: str) -> Column:
    pattern = rf"(?is){re.escape(marker)}[:\s]*(.*?)(?=TASK \d|$)"
    return F.when(F.regexp_like(x, F.lit(pattern)), F.regexp_extract(x, pattern, 1)).otherwise(x)


def parse_phase(x: Column) -> Column:
    """Signals of a numbered-format phase: wager, opted_out, used_tool, difficulty, natural hedges and length."""
    take = lambda p: strip(grab(x, p))
    bet = F.regexp_replace(take(r"(?is)BET_1[:\s]+(\S+)"), r"\.+$", "").try_cast("double").cast("int")
    five = take(r"(?is)ANSWER_5[:\s]+(.+?)(?:\n\n|$|TASK\d)")
    has = lambda c, w: F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False))
    return F.struct(
        F.when(bet.between(1, 10), bet).alias("wager"), has(take(r"(?is)ANSWER_2[:\s]+(.+?)(?:\n|CONFIDENCE_2|$)"), "opt_out").alias("opted_out"), has(take(r"(?is)ACTION_4[:\s]+(\w+)"), "use_tool").alias("used_tool"),
        F.lower(take(r"(?is)DIFFICULTY_3[:\s]+(\w+)")).alias("difficulty_self_report"), count_phrases(five, PHASE_HEDGES).alias("natural_hedge_count"), word_count(five).alias("natural_length"),
    )


def implicit_signals(x: Column, hedges=SIGNAL_HEDGES, caveats=SIGNAL_CAVEATS) -> Column:
    return F.struct(F.length(F.coalesce(x, F.lit(""))).alias("response_length"), present(x, hedges).alias("hedging_count"), (present(x, caveats) > 0).alias("caveat_present"))


def fingerprint(response: Column, feedback: Column) -> Column:
    """Seven boolean traits of a response after feedback."""
    has = {k: present(response, v) for k, v in FINGERPRINT.items()}
    skill = F.lit(False)
    for words in SKILL_WORDS.values():
        skill = skill | ((present(feedback, words) > 0) & (present(response, words) > 0))
    return F.struct(
        (has["referenced_prior_failure"] > 0).alias("referenced_prior_failure"), skill.alias("flagged_specific_skill"), (has["decomposed_more"] >= 2).alias("decomposed_more"), (has["requested_verification"] > 0).alias("requested_verification"),
        ((has["specific"] > 0) & (has["generic"] == 0)).alias("expressed_calibrated_uncertainty"), (has["suggested_alternative"] > 0).alias("suggested_alternative"), (word_count(response) > 200).alias("increased_detail"),
    )


def parse_ranking(x: Column, names: dict[str, str]) -> Column:
    """Places of ``names`` (key to display name) in a numbered list, as an array of keys; null unless it is a full permutation."""
    lines = F.transform(F.filter(F.transform(F.split(strip(x), "\n"), strip), lambda s: F.regexp_like(s, F.lit(r"^\d+[.)]\s*.+$"))), lambda s: F.lower(F.regexp_replace(s, r"^\d+[.)]\s*", "")))

    def key_of(line: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, name in reversed(names.items()):
            out = F.when(F.contains(line, F.lit(k)) | F.contains(line, F.lit(name)), F.lit(k)).otherwise(out)
        return out

    keys = F.array_distinct(F.filter(F.transform(lines, key_of), lambda k: k.isNotNull()))
    return F.when(F.size(keys) == len(names), keys)


def extract_json(x: Column) -> Column:
    """From the first { or [ to its matching bracket of the same kind, by depth; unmatched: to the end; none: the stripped text."""

    def body(t: Column) -> Column:
        at = F.regexp_instr(t, F.lit(r"[\{\[]"))
        rest = F.substr(t, F.greatest(at, F.lit(1)), F.length(t))
        opener = F.left(rest, F.lit(1))
        closer = F.when(opener == "{", "}").otherwise("]")
        start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(0).alias("end"))

        def step(s: Column, c: Column) -> Column:
            depth = s["depth"] + F.when(c == opener, 1).when(c == closer, -1).otherwise(0)
            i = s["i"] + 1
            return F.struct(depth.alias("depth"), i.alias("i"), F.when(s["end"] > 0, s["end"]).when((depth == 0) & (c == closer), i).otherwise(0).alias("end"))

        end = F.aggregate(F.split(rest, ""), start, step, lambda s: s["end"])
        return F.when(at == 0, t).when(end > 0, F.left(rest, end)).otherwise(rest)

    return let(strip(x), body)


def weak_link(x: Column, a: Column, b: Column) -> Column:
    """Which of two domains the text names as its weak link: on a weak-link line, after a weak-link label, or on any line about weakness."""
    low = F.replace(F.lower(x), F.lit("*"), F.lit(" "))
    lines = F.transform(F.split(low, "\n"), strip)

    def one(cue: str) -> Column:
        hits = F.filter(lines, lambda s: F.regexp_like(s, F.lit(cue)))
        name = F.transform(hits, lambda s: F.when(F.contains(s, a) & ~F.contains(s, b), a).when(F.contains(s, b) & ~F.contains(s, a), b))
        return F.get(F.filter(name, lambda n: n.isNotNull()), F.lit(0))

    labels = (r"weak[_\s-]*link\s*[:=\-]\s*([a-z][a-z\s_\-]{0,40})", r"weakest\s+skill\s*[:=\-]\s*([a-z][a-z\s_\-]{0,40})", r"more\s+likely\s+to\s+struggle\s+with\s+([a-z][a-z\s_\-]{0,40})")
    near = [F.when(F.contains(grab(low, p), a), a).when(F.contains(grab(low, p), b), b) for p in labels]
    return F.coalesce(one("weak_link|weak link|weakest"), *near, one("weak|struggle"))


def infer_answer_type(expected: Column) -> Column:
    e = F.lower(strip(expected))
    return F.when(e.isin("yes", "no", "true", "false"), "boolean").when(F.regexp_like(e, F.lit("^[abcd]$")), "multiple_choice").when(F.regexp_like(e, F.lit(r"-?\d")), "exact_numeric").otherwise("short_text")


# -- answers ----------------------------------------------------------------------------------------------


def parse_number(x: Column) -> Column:
    """A number from text: $, commas, % and unit words are dropped, ``approximately`` leads to it, a/b is divided."""

    def body(t: Column) -> Column:
        t = F.coalesce(grab(t, r"(?i)approximately\s+([\d,.\-+/]+)"), t)
        t = strip(F.regexp_replace(t, rf"(?i)\b({_MEASURES})\b", " "))
        return let(strip(F.regexp_replace(t, r"[,%$]", "")), value)

    def value(t: Column) -> Column:
        fraction = r"^(-?\d+)\s*/\s*(-?\d+)$"
        ratio = F.try_divide(grab(t, fraction, 1).try_cast("double"), grab(t, fraction, 2).try_cast("double"))
        return F.when(F.regexp_like(t, F.lit(fraction)), ratio).otherwise(grab(t, r"([-+]?\d*\.?\d+)").try_cast("double"))

    return let(strip(F.regexp_replace(x, r"\$", "")), body)


def choice_letter(x: Column) -> Column:
    patterns = (r"(?i)^\s*([A-D])\s*$", r"(?i)^\s*\(([A-D])\)", r"(?i)^\s*([A-D])[.)\s]", r"(?i)\bTHE ANSWER IS ([A-D])\b", r"(?i)\bANSWER[: ]+([A-D])\b", r"\b([A-D])\b")
    return F.upper(F.coalesce(*[grab(x, p) for p in patterns]))


def match_number(p: Column, c: Column) -> Column:
    a, b = parse_number(p), parse_number(c)
    wide = (F.abs(b) >= 1000) & (b == F.floor(b))
    return F.coalesce(F.round(F.abs(a - b), 9) <= F.when(wide, 1.0).otherwise(0.01), F.lit(False))


def match_choice(p: Column, c: Column) -> Column:
    return F.coalesce(choice_letter(F.upper(strip(p))) == choice_letter(F.upper(strip(c))), F.lit(False))


def as_boolean(x: Column) -> Column:
    """By whole words, the true ones first."""
    words = F.split(F.regexp_replace(F.lower(x), r"[^\w]", " "), r"\s+")
    among = lambda ws: F.arrays_overlap(words, F.array(*[F.lit(w) for w in ws]))
    return F.when(among(TRUE_WORDS), True).when(among(FALSE_WORDS), False)


def base_boolean(x: Column) -> Column:
    """By substrings, the true ones first: 'incorrect' holds 'correct'."""
    return F.when(present(x, BASE_TRUE) > 0, True).when(present(x, BASE_FALSE) > 0, False)


def match_boolean(p: Column, c: Column) -> Column:
    return F.coalesce(as_boolean(p) == as_boolean(c), F.lit(False))


def match_text(p: Column, c: Column, aliases: Column | None = None) -> Column:
    a, b = F.lower(strip(p)), F.lower(strip(c))
    out = (a == b) | ((F.length(a) > 0) & (F.contains(b, a) | F.contains(a, b)))
    if aliases is not None:
        out = out | F.coalesce(F.exists(aliases, lambda x: F.lower(strip(x)) == a), F.lit(False))
    return F.coalesce(out, F.lit(False))


def match_inferred(p: Column, c: Column, aliases: Column | None = None) -> Column:
    a, b = parse_number(p), parse_number(c)
    letter = choice_letter(F.upper(p))
    single = F.regexp_like(F.upper(strip(c)), F.lit("^[A-D]$"))
    x, y = base_boolean(p), base_boolean(c)
    return F.when(a.isNotNull() & b.isNotNull(), F.round(F.abs(a - b), 9) <= 0.01).when(single & letter.isNotNull(), letter == F.upper(strip(c))).when(x.isNotNull() & y.isNotNull(), x == y).otherwise(match_text(p, c, aliases))


def extract_answer(x: Column, kind: Column, channel: Column | None = None) -> Column:
    """The answer of a response by the first strategy that applies; see the body for their order."""
    skip = F.when((channel == "2") & F.regexp_like(x, F.lit(r"(?i)\bSKIP\b")), F.lit("SKIP")) if channel is not None else F.lit(None).cast("string")
    conclusion = strip(grab(x, r"(?i)(?:therefore|so|thus|hence)[,\s]+(?:the\s+\w+\s+(?:is|are|was|were)\s+)?([^\n.]{1,80})"))
    end = last_line(x)
    numbers = F.regexp_extract_all(x, F.lit(r"(?<![.\d])(-?\d[\d,]*(?:\.\d+)?)(?![.\d])"), F.lit(1))
    out = F.coalesce(
        labeled(x, "ANSWER"),
        skip,
        strip(grab(x, r"(?i)(?:the\s+answer\s+is|answer\s*[:=])\s*([^\n.]+)")),
        F.when(F.length(conclusion) <= 60, conclusion),
        strip(grab(end, r"=\s*([^\n=]{1,50})$")),
        strip(grab(x, r"(?i)\b([\d,.\-+/]+)\s*(?:years?\s+old|feet|foot|meters?|miles?|kg|pounds?|lbs?|dollars?|cents?|hours?|days?|weeks?|months?|inches?|cm)\b[^a-zA-Z0-9]*$")),
        strip(grab(x, r"(?i)approximately\s+([\d,.\-+/]+)")),
        F.when(kind == "multiple_choice", grab(x, r"\b([A-D])\b")),
        F.when(F.coalesce(kind == "exact_numeric", F.lit(True)) & (F.size(numbers) > 0), F.replace(F.element_at(numbers, -1), F.lit(","), F.lit(""))),
        F.left(strip(x), F.lit(200)),
    )
    return F.when(F.length(strip(x)) > 0, out)


def match_answer(predicted: Column, correct: Column, kind: Column, aliases: Column | None = None) -> Column:
    """Whether a predicted answer is right: refusals never are, long ones are cut to their answer, then by type, else by inference."""
    p0, c = strip(predicted), strip(correct)
    cut = strip(extract_answer(p0, kind))
    p = F.when((F.length(p0) > 30) & (F.length(cut) > 0) & (F.length(cut) < F.length(p0)), cut).otherwise(p0)

    def typed(p: Column) -> Column:
        return (
            F.when(kind == "exact_numeric", match_number(p, c)).when(kind == "multiple_choice", match_choice(p, c)).when(kind == "boolean", match_boolean(p, c))
            .when(kind == "short_text", match_text(p, c, aliases)).otherwise(match_inferred(p, c, aliases))
        )

    return ~refuses(predicted, ANSWER_REFUSALS) & F.coalesce(let(p, typed), F.lit(False))


def match_base(predicted: Column, correct: Column, kind: Column, aliases: Column | None = None) -> Column:
    """The plain matcher: first numbers within 0.01, first lone letters, substring booleans, equal or aliased texts; unparsable: equal texts."""
    a, b = F.lower(strip(predicted)), F.lower(strip(correct))
    number = lambda x: grab(F.regexp_replace(x, "[,$%]", ""), r"([-+]?\d*\.?\d+)").try_cast("double")
    letter = lambda x: F.coalesce(grab(F.upper(strip(x)), r"\b([A-Z])\b"), F.upper(strip(x)))
    alias = F.coalesce(F.exists(aliases, lambda x: F.lower(strip(x)) == a), F.lit(False)) if aliases is not None else F.lit(False)
    return (
        F.when(kind == "exact_numeric", F.coalesce(F.round(F.abs(number(predicted) - number(correct)), 9) <= 0.01, a == b)).when(kind == "multiple_choice", letter(predicted) == letter(correct))
        .when(kind == "boolean", F.coalesce(base_boolean(predicted) == base_boolean(correct), a == b)).when(kind == "short_text", (a == b) | alias).otherwise(a == b)
    )


def hash_range(x: Column, mod: int) -> Column:
    return F.pmod(F.conv(F.substring(F.sha1(x), 1, 8), 16, 10).cast("bigint"), F.lit(mod))


def slug(x: Column) -> Column:
    return F.translate(x, "./", "--")


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def correlation_label(r: Column, cut: float = 0.1) -> Column:
    return F.when(r.isNull(), "undefined").when(F.abs(r) < cut, "none").when(r > 0, "positive").otherwise("negative")


def difference_label(a: Column, b: Column, na: Column, nb: Column, least: int = 5, cut: float = 0.5) -> Column:
    return F.when((na < least) | (nb < least), "too_few").when(a - b > cut, "higher").when(a - b < -cut, "lower").otherwise("similar")


def prompt(question: Column, lines: list[str]) -> Column:
    """A question followed by instruction lines."""
    return F.concat_ws("\n", F.concat(question, F.lit("\n")), *[F.lit(x) for x in lines])


def condition_prefix(condition: Column, domain_a: Column, domain_b: Column, score_a: Column, score_b: Column) -> Column:
    """What a task tells of earlier scores: nothing (1), that they exist (2), the scores (3), the scores and to act on them (4)."""
    pct = lambda s: F.concat(F.format_number(s * 100, 0), F.lit("%"))
    scores = F.concat(F.lit("Your measured accuracy: "), domain_a, F.lit(" "), pct(score_a), F.lit(", "), domain_b, F.lit(" "), pct(score_b), F.lit(".\n\n"))
    return F.when(condition == 1, "").when(condition == 2, "Your accuracy in each domain has been measured.\n\n").when(condition == 3, scores).otherwise(F.concat(scores, F.lit("Use a tool or flag what falls in a weak domain.\n\n")))


def fill(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template
