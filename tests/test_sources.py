import json
import os

import pytest

from plumbline.sources import datasets as D
from plumbline.sources import files as S
from plumbline.sources import models as M
from plumbline.sources import schemas

SCHEMA = "model string, task_id string, condition int, paradigm int, is_false_score_control boolean, api_success boolean, timestamp string, v int"


def write(path, rows, at):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    os.utime(path, (at, at))


def test_jsonl_modes(spark, tmp_path):
    write(tmp_path / "a.jsonl", [{"model": "m", "v": 1}, "", "{broken", {"model": "n", "v": 2}], 1000)
    assert S.read_jsonl(spark, str(tmp_path), SCHEMA).count() == 2
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path), SCHEMA, strict=True).collect()


def test_files_and_winners(spark, tmp_path):
    key = {"task_id": "t", "condition": 1, "paradigm": 1, "is_false_score_control": False}
    write(tmp_path / "b.jsonl", [{"model": "m", "v": 1, **key}, {"model": "m", "v": 9, "api_success": False, **key}], 2000)
    write(tmp_path / "a.jsonl", [{"model": "m", "v": 2, **key}], 3000)
    write(tmp_path / "SYNTHETIC.jsonl", [{"model": "s", "v": 3, **key}], 1000)
    assert [(r["model"], r["v"]) for r in S.read_trials(spark, str(tmp_path), SCHEMA).collect()] == [("m", 1)]
    last = S.latest_measurements(spark, str(tmp_path), SCHEMA, key=("model", "task_id")).where("model = 'm'").first()
    assert last["v"] == 2
    df = S.read_jsonl(spark, str(tmp_path), SCHEMA, origin=True)
    assert {r["v"] for r in S.newest_file(df).collect()} == {2}
    assert [r["_name"] for r in S.files_in_order(df).orderBy("place").collect()] == ["SYNTHETIC.jsonl", "b.jsonl", "a.jsonl"]


def test_capability(spark, tmp_path):
    cell = lambda a: {"natural_acc": a, "wagering_acc": a}
    for name, doc, at in (("x.json", {"m": {"d": cell(0.1), "e": cell(0.2)}, "n": {"d": cell(0.3)}}, 100), ("y.json", {"m": {"d": cell(0.9)}}, 200)):
        (tmp_path / name).write_text(json.dumps(doc))
        os.utime(tmp_path / name, (at, at))
    new = {(r["model"], r["domain"]): r["natural_acc"] for r in S.read_capability(spark, str(tmp_path)).collect()}
    assert new == {("m", "d"): 0.9, ("n", "d"): 0.3}
    best = {(r["model"], r["domain"]): r["natural_acc"] for r in S.read_capability(spark, str(tmp_path), "coverage").collect()}
    assert best == {("m", "d"): 0.1, ("m", "e"): 0.2, ("n", "d"): 0.3}


def test_csv_yaml_packet(spark, tmp_path):
    (tmp_path / "d.yaml").write_text("domains:\n  arith:\n    name: x # note\n    subcategories:\n      - add\n      - 'mul'\n  logic:\n    subcategories:\n    - sets\n")
    assert [tuple(r) for r in S.read_domains(spark, str(tmp_path / "d.yaml")).collect()] == [("arith", "add"), ("arith", "mul"), ("logic", "sets")]
    S.write_csv(spark.createDataFrame([("a", "1.5"), ("b", "x")], "id string, n string").coalesce(1), str(tmp_path / "out"))
    back = schemas.numbers(S.read_csv(spark, str(tmp_path / "out")), ["n"]).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("a", 1.5), ("b", None)]
    for name, columns in schemas.PACKET.items():
        (tmp_path / f"{name}.csv").write_text(",".join(c.split()[0] for c in columns.split(", ")) + "\n" + ",".join("1" for _ in columns.split(", ")) + "\n")
    assert {k: v.count() for k, v in S.read_packet(spark, str(tmp_path)).items()} == {"traffic": 1, "outcomes": 1, "cost_latency": 1}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 0.5)], "i int, x double")
    S.write_jsonl(df, str(tmp_path / "o"))
    S.write_jsonl(df, str(tmp_path / "o"), append=True)
    assert spark.read.schema("i int, x double").json(str(tmp_path / "o")).where("x is not null").count() == 2
    assert [r["document"] for r in S.as_documents(df).collect()][2] == '{"i":3,"x":0.5}'
    first = S.manifest(spark, str(tmp_path / "o"))
    stored = first.collect()
    assert S.changed_files(first, spark.createDataFrame(stored, first.schema)).count() == 0


def test_trial_defaults(spark):
    raw = spark.createDataFrame([{"model": "m"}], schemas.TRIAL)
    r = schemas.trials(raw).first()
    assert (r["api_success"], r["correct_a"], r["strength_b"], r["hedges_a"]) == (True, False, "unknown", 0)


def test_bucket_and_completion(spark):
    now = [0.0]
    b = M.Bucket(60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert sum(b.acquire() for _ in range(90)) == pytest.approx(30)
    df = spark.createDataFrame([(i, "m", f"q{i}") for i in range(12)], "request_id long, model string, prompt string")

    def call(model, prompt):
        if prompt == "q3":
            raise ValueError("no")
        return prompt.upper()

    got = {r["request_id"]: (r["response"], r["error"], r["attempts"]) for r in M.complete(df, call, "google_ai", parallel=2, retries=2, backoff=0.01).collect()}
    assert got[3] == (None, "no", 2) and got[5] == ("Q5", None, 1) and len(got) == 12
    models = spark.createDataFrame([("b", "core", "x"), ("a", "core", "y"), ("c", "extra", "x")], "model string, role string, provider string")
    assert [r["model"] for r in M.registry(models, role="core").collect()] == ["a", "b"] and M.limit_of("nvidia_nim") == 30


def test_generic_set(spark):
    raw = spark.createDataFrame([("1", "q", "a")], "i string, q string, a string")
    r = D.generic(raw, "extra", "logical", {"question": "q", "answer": "a", "id": "i"}).first()
    assert (r["source_id"], r["correct_answer"], r["domain"]) == ("extra_1", "a", "logical")


