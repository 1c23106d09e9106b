"""Nested documents against a plain walk, and bounds on what a stream takes in."""

import json
import random

import pytest
from pyspark.sql import functions as F

from changeflow.functions import nested
from changeflow.session import work_path
from changeflow.streaming import intake, jobs


def random_document(rng, depth=0):
    draw = rng.random()
    if depth == 0 or (draw < 0.35 and depth < 3):
        doc = {"a": rng.choice([None, 1, 2]), "b": rng.choice(["x", "y"]), "n": random_document(rng, depth + 1), "l": [random_document(rng, 3) for _ in range(rng.randrange(3))]}
        return {k: v for k, v in doc.items() if rng.random() < 0.85}
    return {"v": rng.choice([1, 2, None]), "w": {"z": rng.randrange(3)}} if rng.random() < 0.7 else None


def changed(b, a, kind, path=""):
    from pyspark.sql import types as T
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in changed((b or {}).get(f.name), (a or {}).get(f.name), f.dataType, f"{path}.{f.name}" if path else f.name)]
    if isinstance(kind, T.ArrayType):
        n = max(len(b or []), len(a or []))
        at = lambda v, i: v[i] if v is not None and i < len(v) else None
        within = [p for i in range(n) for p in changed(at(b, i), at(a, i), kind.elementType, f"{path}[{i}]")]
        lengths = [-1 if v is None else len(v) for v in (b, a)]
        return within or ([path] if lengths[0] != lengths[1] else [])
    return [path] if b != a else []


@pytest.mark.parametrize("seed", [1, 2])
def test_differences(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, random_document(rng), random_document(rng)) for i in range(120)]
    rows = spark.createDataFrame([(i, json.dumps(b), json.dumps(a)) for i, b, a in pairs] + [(998, None, "{}"), (999, "{broken", "{}")], "i long, before string, after string")
    kind = nested.document_type(rows, "before", "after")
    found = {r["i"]: r["d"] for r in nested.parsed(rows, kind, "before", "after").select("i", nested.diff_nested(F.col("before"), F.col("after"), kind).alias("d")).collect()}
    assert found[998] == []
    for i, b, a in pairs:
        assert found[i] == sorted(changed(b, a, kind)), (b, a)


def test_masks(spark):
    docs = ['{"c":{"mail":"a@b","n":1},"l":[{"card":"4111222233334444","p":1},{"p":2},null],"t":["x","y"]}', '{"c":null,"l":[]}', "{}", None]
    rows = spark.createDataFrame([(d,) for d in docs], "doc string")
    kind = nested.document_type(rows, "doc")
    assert set(nested.paths_of(kind)) == {"c.mail", "c.n", "l[].card", "l[].p", "t[]"}
    masks = {"c.mail": lambda v: F.lit("M"), "l[].card": lambda v: F.right(v, F.lit(4)), "t[]": lambda v: F.upper(v)}
    got = nested.parsed(rows, kind, "doc").select(F.to_json(nested.mask_nested(F.col("doc"), kind, masks)).alias("d")).collect()
    assert [json.loads(r["d"]) if r["d"] else None for r in got] == [
        {"c": {"mail": "M", "n": 1}, "l": [{"card": "4444", "p": 1}, {"p": 2}, None], "t": ["X", "Y"]}, {"l": []}, {}, None]
    with pytest.raises(ValueError, match="no such path"):
        nested.mask_nested(F.col("doc"), kind, {"c.other": F.upper})
    assert nested.document_type(spark.createDataFrame([(None,)], "doc string"), "doc").fields == []


def test_intake_is_bounded_and_measured(spark):
    rows = spark.range(0, 1050, 1, 3).withColumn("t", F.lit("x"))
    path, out, seen = intake.cut_files(rows, "cut", 100), work_path(spark, "intake"), []
    listener = intake.IntakeListener()
    spark.streams.addListener(listener)
    try:
        stream = intake.bounded_stream(spark, path, rows.schema, 100, 250)
        jobs.finish(intake.measured(stream, out, work_path(spark, "ck"), lambda df, i: seen.append((i, df.count(), df.columns))))
    finally:
        spark.streams.removeListener(listener)
    taken = sorted(spark.read.parquet(out).collect(), key=lambda r: r["batch_id"])
    assert sum(r["rows"] for r in taken) == 1050 and max(r["rows"] for r in taken) <= 200 and len(taken) == 6
    assert all(r["files"] <= 2 and r["bytes"] > 0 for r in taken)
    assert [s[:2] for s in seen] == [(r["batch_id"], r["rows"]) for r in taken] and seen[0][2] == ["id", "t"]
    with pytest.raises(ValueError, match="whole files"):
        intake.bounded_stream(spark, path, rows.schema, 100, 50)
