"""What is stored, exported and deleted: published stages, training exports without secrets, deletion from tables."""

import json
import os
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapework.functions import redaction
from tapework.operators import governance
from tapework.sources import stages

SECRET = "S3CRET"


# -- published stages

def publish(spark, place, rows, version="1", slots=4):
    df = spark.createDataFrame(rows, "item string, v long, input string")
    return stages.publish_stage(df, place, "s", version, ["item"], F.col("input"), slots)


def read(spark, place, version="1"):
    return sorted(((r["item"], r["v"]) for r in stages.read_stage(spark, place, "s", version).collect()), key=str)


def test_reuse_and_replacement(spark, tmp_path):
    place = str(tmp_path / "t")
    assert publish(spark, place, [("a", 1, "x"), ("b", 2, "x"), (None, 3, None)]) == 3
    assert publish(spark, place, [("a", 9, "x"), (None, 9, None)]) == 0
    assert publish(spark, place, [("a", 10, "y"), ("c", 4, "x"), ("b", 9, "x")]) == 2
    assert publish(spark, place, [("a", 5, "x")], version="2") == 1
    assert read(spark, place) == [("a", 10), ("b", 2), ("c", 4), (None, 3)] and read(spark, place, "2") == [("a", 5)]
    with pytest.raises(ValueError):
        stages.read_stage(spark, place, "other", "1")
    stages.clean(spark, place)
    assert read(spark, place) == [("a", 10), ("b", 2), ("c", 4), (None, 3)] and len(os.listdir(f"{place}/manifests")) <= 2


def test_an_empty_stage_and_one_without_input(spark, tmp_path):
    place, df = str(tmp_path / "t"), spark.createDataFrame([("a", 1)], "item string, v long")
    assert stages.publish_stage(df.limit(0), place, "s", "1", ["item"]) == 0 and stages.read_stage(spark, place, "s", "1").count() == 0
    assert stages.publish_stage(df, place, "s", "1", ["item"]) == 1 and stages.publish_stage(df.withColumn("v", F.lit(7).cast("long")), place, "s", "1", ["item"]) == 0
    assert [tuple(r) for r in stages.read_stage(spark, place, "s", "1").collect()] == [("a", 1)]


def test_a_run_that_comes_second(spark, tmp_path, monkeypatch):
    """Another run publishes between this one's look and its commit: the key is stored once, and both keep what only they have."""
    place, looked = str(tmp_path / "t"), []
    publish(spark, place, [("old", 0, "x")])
    latest = stages._latest

    def slow(session, path):
        found = latest(session, path)
        if not looked:
            looked.append(True)
            assert publish(spark, place, [("a", 1, "x"), ("b", 1, "x")]) == 2
        return found

    monkeypatch.setattr(stages, "_latest", slow)
    assert publish(spark, place, [("a", 2, "x"), ("c", 2, "x")]) == 1
    assert read(spark, place) == [("a", 1), ("b", 1), ("c", 2), ("old", 0)]
    named = {f"run={r}" for e in latest(spark, place)[1].values() for r in e["slots"].values()}
    assert named <= set(os.listdir(place))


def test_runs_at_once(spark, tmp_path):
    place = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        stored = list(pool.map(lambda k: publish(spark, place, [(f"i{n}", k, "x") for n in range(k, k + 10)]), range(0, 20, 5)))
    assert sum(stored) == 25 and [item for item, _ in read(spark, place)] == sorted(f"i{n}" for n in range(25))


def test_forgetting_published_rows(spark, tmp_path):
    place = str(tmp_path / "t")
    publish(spark, place, [(f"i{n}", n, "x") for n in range(40)], slots=8)
    publish(spark, place, [("i1", 5, "x")], version="2")
    before = set(stages._latest(spark, place)[1]['["s", "1"]']["slots"].items())
    assert stages.forget_published(spark, place, spark.createDataFrame([("i1",), ("none",)], "item string")) == 2
    after = set(stages._latest(spark, place)[1]['["s", "1"]']["slots"].items())
    assert len(before & after) == len(before) - 1  # one slot was rewritten
    assert "i1" not in dict(read(spark, place)) and len(read(spark, place)) == 39 and read(spark, place, "2") == []
    everything = spark.read.option("recursiveFileLookup", "true").parquet(*[f"{place}/{d}" for d in os.listdir(place) if d.startswith("run=") and any(f.endswith(".parquet") for _, _, fs in os.walk(f"{place}/{d}") for f in fs)])
    assert everything.where("item = 'i1'").count() == 0


# -- redaction

@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ('{"api_key":"S3CRET"}', "{}"), ('{"a":{"b":[{"Source_PATH":"S3CRET","n":1.50,"m":1e5,"big":123456789012345678901}]}}', '{"a":{"b":[{"n":1.50,"m":1e5,"big":123456789012345678901}]}}'),
        ('{"api\\u005fkey":"S3CRET","b":null}', '{"b":null}'), ('{"s":"{\\"authorization\\":\\"S3CRET\\",\\"k\\":1}"}', '{"s":"{\\"k\\":1}"}'), ('"{\\"api_key\\":\\"S3CRET\\"}"', '"{}"'),
        ('{"api_key":"S3CRET"', None), ('{"x":NaN,"api_key":"S3CRET"}', None), ('note: {"access_token": "S3CRET"}', None), ("[" * 50_000 + '"api_key":"S3CRET"', None), ('{"a":1,"a":{"api_key":2}}', '{"a":1,"a":{}}'),
        ("an api_key is a thing", "an api_key is a thing"), ('{ "a" : [1, 2.50] }', '{ "a" : [1, 2.50] }'), ("[laughs] the _path", "[laughs] the _path"), ("", ""), ('{"ü":"日本","api_key":1}', '{"ü":"日本"}'),
    ],
)
def test_clean_text(text, clean):
    assert redaction.clean_text(text) == clean


def test_arrow_arrays_of_any_type():
    kind = pa.struct([("m", pa.map_(pa.string(), pa.list_(pa.string()))), ("n", pa.int64())])
    rows = [{"m": [("a", ['{"api_key":1}', None, "x"]), ("b", None)], "n": 1}, None, {"m": None, "n": 2}, {"m": [], "n": None}]
    got = redaction.clean_array(pa.array(rows, kind).slice(0))
    got.validate(full=True)
    assert got.to_pylist() == [{"m": [("a", ["{}", None, "x"]), ("b", None)], "n": 1}, None, {"m": None, "n": 2}, {"m": [], "n": None}]
    assert redaction.clean_array(pa.array(rows, kind).slice(2)).to_pylist() == got.to_pylist()[2:]


def test_redact_every_type(spark):
    nested = json.dumps({"keep": [1, {"x_path": SECRET, "API_KEY": {"deep": SECRET}}], "text": json.dumps({"authorization": SECRET, "ok": 1})})
    df = spark.createDataFrame([(1, nested, "{broken", None), (2, None, "plain words", nested)], "id long, a string, b string, c string")
    df = df.select("id", "a", "b", F.parse_json("c").alias("v"), F.array(F.struct(F.col("a").alias("j"), F.lit(SECRET).alias("current_video"), F.parse_json("a").alias("w"))).alias("list"), F.create_map(F.lit("k"), F.col("c"), F.lit("render_source_video"), F.lit(SECRET)).alias("m"), F.lit(SECRET).alias("My_Path"))
    out = governance.redact(df, json_columns=["b"])
    assert out.columns == ["id", "a", "b", "v", "list", "m"]
    rows = out.select("id", "a", "b", F.to_json("v").alias("v"), F.col("list")[0]["j"].alias("j"), F.to_json(F.col("list")[0]["w"]).alias("w"), F.to_json("m").alias("m")).orderBy("id").collect()
    clean = '{"keep":[1,{}],"text":"{\\"ok\\":1}"}'
    assert tuple(rows[0]) == (1, clean, None, None, clean, clean, "{}" if rows[0]["m"] == "{}" else '{"k":null}')
    assert rows[1]["a"] is None and rows[1]["b"] is None and rows[1]["v"] == clean and json.loads(rows[1]["m"]) == {"k": clean}
    assert SECRET not in str(rows)


def test_export_counts_and_leaks(spark, tmp_path):
    """As the reference's own case: one record with consent, one without, and a broken file."""
    files = [
        json.dumps({"job_id": f"job-{k}", "item_id": "001", "updated_at": "2026-01-01T00:00:00", "data_policy": {"training_consent": bool(k)}, "raw_transcript": [{"text": "测试"}], "ai_decision": {"corrections": [], "api_key": SECRET}, "initial_result": {"current_video": SECRET, "sentences": []}, "final_result": {"sentences": [{"clip_path": SECRET}]}}, ensure_ascii=False)
        for k in (0, 1)
    ]
    records = governance.feedback_records(spark.createDataFrame([(f,) for f in [*files, "{broken", "[]", None]], "value string"))
    assert governance.write_training_export(records, str(tmp_path / "out")) == (1, 1)
    (line,) = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
    record = json.loads(line)
    assert SECRET not in line and "job-1" not in line and "测试" in line and len(record["id"]) == 24
    assert record["chosen"] == {"sentences": [{}]} and record["rejected"] == {"sentences": []} and record["prompt"]["auto_edit_mode"] == "standard" and record["ai_decision"]["delete_ranges"] == [] and record["user_changes"] == {}


# -- deletion from tables

def test_forget_in_tables(spark, tmp_path):
    rows = [(f"i{n}", f"0{n % 3}", "a b/c" if n % 2 else None, n) for n in range(12)] + [("only", "09", "x", 1), (None, "00", "x", 2)]
    place, other = str(tmp_path / "one"), str(tmp_path / "two")
    df = spark.createDataFrame(rows, "item_id string, day string, part string, v long")
    df.write.partitionBy("day", "part").parquet(place)
    df.write.partitionBy("day").parquet(other)
    untouched = {os.path.join(d, f) for d, _, fs in os.walk(other) for f in fs if f.endswith(".parquet") and "day=01" in d}
    keys = spark.createDataFrame([("i0",), ("i3",), ("only",), ("nobody",), (None,)], "item_id string")
    report = {r["path"]: r.asDict() for r in governance.forget_in_tables(spark, {place: ["day", "part"], other: ["day"]}, keys).collect()}
    assert report[other] == {"path": other, "partitions": 4, "rewritten": 2, "emptied": 1, "deleted": 3, "left": 0}
    assert report[place]["deleted"] == 3 and report[place]["left"] == 0 and report[place]["emptied"] == 1 and not os.path.exists(f"{place}/day=09/part=x")
    want = sorted(((r[0], r[3]) for r in rows if r[0] not in ("i0", "i3", "only")), key=str)
    for path in (place, other):
        assert sorted(((r["item_id"], r["v"]) for r in spark.read.parquet(path).collect()), key=str) == want
    assert untouched == {os.path.join(d, f) for d, _, fs in os.walk(other) for f in fs if f.endswith(".parquet") and "day=01" in d}
    again = governance.forget_in_tables(spark, {other: ["day"]}, keys).first()
    assert (again["rewritten"], again["deleted"], again["left"]) == (0, 0, 0)
