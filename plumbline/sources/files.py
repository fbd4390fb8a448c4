"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import first_wins, last_wins


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = False, origin: bool = False) -> DataFrame:
    """JSON lines under a declared schema. Blank and malformed lines are skipped, or raise if ``strict``.

    ``origin`` adds _path, _name and _modified of the file, by which later operators can tell the newer record."""
    df = spark.read.schema(schema).json(paths, mode="FAILFAST" if strict else "DROPMALFORMED")
    if origin:
        df = df.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"), F.col("_metadata.file_modification_time").alias("_modified"))
    return df


def newest_file(df: DataFrame) -> DataFrame:
    """Rows of the file that was modified last; ties go to the larger name. Needs ``origin`` columns."""
    newest = df.agg(F.max(F.struct("_modified", "_name")).alias("n"))
    return df.crossJoin(F.broadcast(newest)).where((F.col("_modified") == F.col("n._modified")) & (F.col("_name") == F.col("n._name"))).drop("n")


def files_in_order(df: DataFrame) -> DataFrame:
    """The distinct files of a read, with their place by time, then name."""
    from pyspark.sql import window as W

    return df.select("_path", "_name", "_modified").distinct().withColumn("place", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy("_modified", "_name", "_path")))


def read_trials(spark: SparkSession, paths, schema: str, exclude: str = "SYNTHETIC", key=("model", "task_id", "condition", "paradigm", "is_false_score_control")) -> DataFrame:
    """Successful records of several files, those named like ``exclude`` left out, the first of each key by (time, name, content)."""
    df = read_jsonl(spark, paths, schema, origin=True).where(~F.col("_name").contains(exclude) & F.coalesce("api_success", F.lit(True)))
    return first_wins(df, list(key), [F.col("_modified"), F.col("_name"), F.coalesce("timestamp", F.lit(""))]).drop("_path", "_name", "_modified")


def latest_measurements(spark: SparkSession, paths, schema: str, key=("model", "question_id", "channel")) -> DataFrame:
    """Measurements of several files, the last of each key by (time, name, timestamp)."""
    return last_wins(read_jsonl(spark, paths, schema, origin=True), list(key), [F.col("_modified"), F.col("_name"), F.coalesce("timestamp", F.lit(""))]).drop("_path", "_name", "_modified")


def read_capability(spark: SparkSession, paths, best: str = "newest") -> DataFrame:
    """(model, domain, natural_acc, wagering_acc) from documents of nested maps.

    A later file overrides a whole model, or, with ``best='coverage'``, the file with most known domains does."""
    kind = T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField(f"{c}_acc", T.DoubleType()) for c in ("natural", "wagering")])))
    docs = spark.read.text(paths, wholetext=True).select(F.from_json("value", kind).alias("m"), F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("n"))
    models = docs.select(F.explode("m").alias("model", "domains"), "t", "n").withColumn("known", F.size(F.map_filter("domains", lambda k, v: v["natural_acc"].isNotNull())))
    order = F.struct("known", "t", "n") if best == "coverage" else F.struct("t", "n")
    # maps cannot be compared, so the winner's entries travel as an array
    won = models.withColumn("e", F.map_entries("domains")).groupBy("model").agg(F.max_by("e", order).alias("e"))
    return won.select("model", F.explode("e").alias("e")).select("model", F.col("e.key").alias("domain"), "e.value.natural_acc", "e.value.wagering_acc")


def read_csv(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """CSV with a header, all columns text unless a schema is given."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_packet(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    from .schemas import PACKET

    return {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in PACKET.items()}


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """(domain, subcategory) from a YAML file of ``domain:`` blocks with ``subcategories:`` lists.

    The small subset of YAML that such a file needs is read line by line: indentation gives the nesting."""
    lines = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    rows, domain, listing = [], None, False
    for line in "\n".join(lines).splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.strip().startswith("#"):
            continue
        depth, item = len(bare) - len(bare.lstrip()), bare.strip()
        if item.startswith("- ") and listing:
            rows.append((domain, item[2:].split(":")[-1].strip().strip("'\"")))
        elif item.endswith(":") and item[:-1] == "subcategories":
            listing = True
        elif item.endswith(":") and depth <= 2 and item != "domains:":
            domain, listing = item[:-1], False
        else:
            listing = False
    return spark.createDataFrame(rows, "domain string, subcategory string")


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, for sinks that have no such numbers."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    clean_numbers(df).write.mode("append" if append else "overwrite").json(path)


def as_documents(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, numbers cleaned."""
    return clean_numbers(df).select(F.to_json(F.struct("*")).alias("document"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


PROVENANCE = ("source_id", "source", "domain", "subcategory", "difficulty", "answer_type", "transformation", "parent_id", "verified", "question_text", "correct_answer")


def provenance(bank: DataFrame) -> DataFrame:
    """The provenance table of a question bank: its eleven columns, missing ones null."""
    return bank.select(*[F.col(c) if c in bank.columns else F.lit(None).cast("string").alias(c) for c in PROVENANCE])


def compile_bank(verified: DataFrame, counterfactual: DataFrame) -> DataFrame:
    return verified.unionByName(counterfactual, allowMissingColumns=True)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed_files(stored: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """Entries whose hash differs or that only one side has, with a reason."""
    a, b = stored.select(key, F.col("sha256").alias("__a")), now.select(key, F.col("sha256").alias("__b"))
    reason = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "new").otherwise("changed")
    return a.join(b, key, "full").where(~F.col("__a").eqNullSafe(F.col("__b"))).select(key, reason.alias("reason"))
