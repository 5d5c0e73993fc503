import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from stratamem.operators import resolve
from stratamem.sources import datasets, exports
from stratamem.streaming import resolver


def test_cases(spark, tmp_path):
    p = tmp_path / "cases.json"
    p.write_text(json.dumps([{"id": "c", "sessions": [{"date": "2025-01-02T00:00:00Z", "turns": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}], "questions": [{"question": "q", "answer": "a"}]}]))
    cases = datasets.read_cases(spark, str(p))
    assert cases.first()["questions"][0]["abstention"] is False
    assert datasets.session_texts(cases).first()["content"] == "user: hi\nassistant: yo"


def test_long_cases(spark, tmp_path):
    base = {"question_id": "q1_abs", "question_type": "t", "question": "q", "answer": 7, "haystack_dates": ["2019/11/04 (Mon) 06:15"], "haystack_sessions": [[{"role": "user", "content": "x"}]]}
    good, uneven, odd = tmp_path / "g.json", tmp_path / "u.json", tmp_path / "o.json"
    good.write_text(json.dumps([base]))
    uneven.write_text(json.dumps([base | {"haystack_dates": []}]))
    odd.write_text(json.dumps([base | {"answer": [1]}]))
    row = datasets.read_long_cases(spark, str(good)).first()
    assert str(row["sessions"][0]["date"]) == "2019-11-04 06:15:00"
    assert row["questions"][0]["abstention"] and row["questions"][0]["answer"] == "7"
    for bad in (uneven, odd):
        with pytest.raises(Exception, match="in case q1_abs"):
            datasets.read_long_cases(spark, str(bad)).collect()


def test_export(spark):
    df = spark.createDataFrame([("t", "u", 2, 5, [1.0]), ("t", "u", 1, 5, None), ("t", "v", 3, 1, None)], "tenant_id string, actor_id string, id long, at long, embedding array<float>")
    rows = json.loads(exports.actor_export(df, "t", "u", "at").first()["rows"])
    assert [r["id"] for r in rows] == [1, 2] and "embedding" not in rows[0]
    assert exports.actor_export(df, "t", "nobody", "at").first()["rows"] == "[]"


def test_stream_equals_fold(spark, tmp_path):
    rng = random.Random(4)
    facts = [(i, rng.choice("kl"), rng.randrange(30), rng.choice("abc"), rng.random() < 0.8) for i in range(80)]
    cols = "id long, key string, at long, val string, single boolean"
    for n, part in enumerate((facts[:30], facts[30:55], facts[25:])):  # rows 25 to 54 come twice
        spark.createDataFrame(part, cols).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = resolver.resolve_stream(stream, ["key"], "id", "at", "val", "id", "single")
    resolver.run_available(out, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = resolver.latest_rows(spark.read.schema(out.schema).parquet(f"{tmp_path}/out/*"), ["key"])
    # Files come in order of their folders' age, ids in order within them: as the fold sees them.
    want = resolve.resolve_by_fold(spark.createDataFrame(facts, cols), ["key"], "id", "at", "val", "id", "single")
    names = sorted(want.columns)
    assert got.select(*names).exceptAll(want.select(*names)).count() == 0
    assert want.select(*names).exceptAll(got.select(*names)).count() == 0


def test_entry_points():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60
    assert all(callable(f) for f in queries.values())
