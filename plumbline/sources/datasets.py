"""Normalisers of public question sets to one question schema. Each takes the set's raw columns; downloading is not part of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

COLUMNS = ("question_text", "correct_answer", "answer_type", "source", "source_id", "domain", "subcategory", "difficulty", "metadata")


def _letters(options: Column) -> Column:
    """Options as lines 'A. first', 'B. second', ..."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def _row(df: DataFrame, question: Column, answer: Column, kind: str | Column, source: str, ident: Column, domain: str | Column, subcategory: str | Column | None = None, difficulty: str | Column = "medium", metadata: Column | None = None) -> DataFrame:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    values = (question, answer, lit(kind), F.lit(source), ident, lit(domain), lit(subcategory), lit(difficulty), metadata if metadata is not None else none)
    return df.select(*[v.cast("string").alias(c) if c != "metadata" else v.alias(c) for c, v in zip(COLUMNS, values)])


def gsm8k(df: DataFrame) -> DataFrame:
    """id, question, answer: the answer follows ####, without commas."""
    return _row(df, F.col("question"), F.replace(strip(F.regexp_extract("answer", r"####\s*(.+)", 1)), F.lit(","), F.lit("")), "exact_numeric", "gsm8k", F.concat(F.lit("gsm8k_"), F.col("id")), "arithmetic", "word_problems")


#: Problem types of the MATH set and where they belong.
MATH_TYPES = {"Algebra": ("arithmetic", "algebra"), "Geometry": ("spatial", "geometry"), "Number Theory": ("arithmetic", "number_theory"), "Counting & Probability": ("logical", "counting"), "Precalculus": ("arithmetic", "precalculus")}


def math_set(df: DataFrame) -> DataFrame:
    """id, problem, solution, type, level: the answer is what the last \\boxed{ holds."""
    boxed = F.regexp_extract("solution", r"(?s)^.*\\boxed\{(.*?)\}", 1)
    pick = lambda k: F.coalesce(*[F.when(F.col("type") == t, v[k]) for t, v in MATH_TYPES.items()], F.lit(("arithmetic", "other")[k]))
    level = F.regexp_extract("level", r"(\d)", 1).try_cast("int")
    hard = F.when(level <= 2, "easy").when(level == 3, "medium").otherwise("hard")
    return _row(df, F.col("problem"), boxed, F.when(boxed.try_cast("double").isNotNull(), "exact_numeric").otherwise("short_text"), "math", F.concat(F.lit("math_"), F.col("id")), pick(0), pick(1), hard)


def logiqa(df: DataFrame) -> DataFrame:
    """id, context, question, options, label: lettered options; a missing or zero label is A, another stays a number."""
    answer = F.when(F.coalesce("label", F.lit(0)) == 0, "A").otherwise(F.col("label").cast("string"))
    return _row(df, F.concat_ws("\n", "context", "question", _letters(F.col("options"))), answer, "multiple_choice", "logiqa", F.concat(F.lit("logiqa_"), F.col("id")), "logical", "deduction")


def social_iqa(df: DataFrame) -> DataFrame:
    """id, context, question, answer_a, answer_b, answer_c, label ('1' to '3'; else A)."""
    answer = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in ("1", "A", "2", "B", "3", "C")]), F.col("label")), F.lit("A"))
    return _row(df, F.concat_ws("\n", "context", "question", _letters(F.array("answer_a", "answer_b", "answer_c"))), answer, "multiple_choice", "social_iqa", F.concat(F.lit("siqa_"), F.col("id")), "social", "intent")


def triviaqa(df: DataFrame) -> DataFrame:
    """id, question, value, aliases."""
    return _row(df, F.col("question"), F.col("value"), "short_text", "triviaqa", F.concat(F.lit("trivia_"), F.col("id")), "factual", "trivia", "medium", F.create_map(F.lit("aliases"), F.to_json("aliases")))


def arc(df: DataFrame) -> DataFrame:
    """id, question, labels, texts, answer: labels and texts are zipped into the question."""
    options = F.array_join(F.zip_with("labels", "texts", lambda a, b: F.concat(a, F.lit(". "), b)), "\n")
    return _row(df, F.concat_ws("\n", "question", options), F.col("answer"), "multiple_choice", "arc", F.concat(F.lit("arc_"), F.col("id")), "factual", "science")


def bigbench(df: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """id, task, inputs, target: the task's domain comes from ``tasks``; unknown tasks are left out."""
    known = df.where(F.col("task").isin(*tasks))
    domain = F.element_at(F.create_map(*[F.lit(x) for kv in tasks.items() for x in kv]), F.col("task"))
    return _row(known, F.col("inputs"), F.col("target"), "short_text", "bigbench", F.concat(F.lit("bb_"), F.col("id")), domain, F.col("task"))


def folio(df: DataFrame) -> DataFrame:
    """id, premises, conclusion, label: a true label is True, else False."""
    return _row(df, F.concat_ws("\n", F.array_join("premises", "\n"), "conclusion"), F.when(F.lower(F.col("label").cast("string")) == "true", "True").otherwise("False"), "boolean", "folio", F.concat(F.lit("folio_"), F.col("id")), "logical", "entailment")


def reclor(df: DataFrame) -> DataFrame:
    """id, context, question, options, label: index to letter, out of range A."""
    answer = F.when(F.col("label").between(0, 3), F.char(F.col("label") + 65)).otherwise("A")
    return _row(df, F.concat_ws("\n", "context", "question", _letters(F.col("options"))), answer, "multiple_choice", "reclor", F.concat(F.lit("reclor_"), F.col("id")), "logical", "reading")


def generic(df: DataFrame, source: str, domain: str, mapping: dict[str, str], kind: str = "short_text") -> DataFrame:
    """Any other set: ``mapping`` names its question, answer and id columns."""
    return _row(df, F.col(mapping["question"]), F.col(mapping["answer"]), kind, source, F.concat(F.lit(source + "_"), F.col(mapping["id"])), domain)


def union(parts: dict[str, Callable[[], DataFrame]]) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the loaders that work, and why the others do not."""
    out, failed = None, {}
    for name, load in parts.items():
        try:
            df = load()
        except Exception as problem:  # a missing source leaves the others usable
            failed[name] = str(problem).splitlines()[0]
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out, failed
