"""Arrays read in tiny ranges give what a parser gives for the whole file; written ones equal json.dump byte for byte."""

import json
import random

import pytest

from siftwell.sources import json_array, json_files

TEXTS = ['a "quoted" }{][', "back\\slash\\\\", 'end\\"', "line\nbreak\r\n\ttab", "漢字 é \U0001f600", "{", "}", "[{}]", "", " ", '"}, {"', "x" * 300, " ", "\\u007d"]


@pytest.fixture
def tiny_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def some_rows(seed, n):
    rng = random.Random(seed)
    return [{"ID": str(i), "Question": rng.choice(TEXTS) + rng.choice(TEXTS), "Answer": rng.choice([None, *TEXTS]), "Nested": {"a": [{"b": rng.choice(TEXTS)}] * rng.randint(0, 2), "c": {}}} for i in range(n)]


ELEMENT = "struct<ID:string,Question:string,Answer:string,Nested:struct<a:array<struct<b:string>>,c:map<string,string>>>"


@pytest.mark.parametrize("style", [{"indent": 2}, {}, {"separators": (",", ":")}, {"indent": "\t", "ensure_ascii": False}])
def test_tiny_ranges(spark, tmp_path, tiny_ranges, style):
    rows = some_rows(1, 25)
    path = tmp_path / "a.json"
    path.write_text(" \n" + json.dumps(rows, **style) + "\n ", "utf-8", newline="")
    got = json_array.read_array(spark, str(path), ELEMENT).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(25))
    assert [r.item.asDict(True) for r in got] == rows
    assert json_array.segments(spark, str(path)).select("range").distinct().count() > 20


@pytest.mark.parametrize("text,n", [("[]", 0), (" [ \n ] ", 0), ('[{}]', 1), ('[{"a": 1}]\n', 1), ('[{"a":1},{"a":2}]', 2)])
def test_small_arrays(spark, tmp_path, text, n):
    path = tmp_path / "a.json"
    path.write_text(text)
    assert json_array.read_array(spark, str(path), "map<string,string>").count() == n


@pytest.mark.parametrize("text", ['{"a": 1}', '[{"a": 1}', '[{"a": 1} {"a": 2}]', '[{"a": 1},, {"a": 2}]', "[1, 2]", '["x", {"a": 1}]', '[{"a": 1}] x', '[{"a": tru}]', '[[{"a": 1}]]', "x", '[{"a": "x}]', '[{"a": 1}]]', '[{"a": 1},]'])
def test_no_arrays(spark, tmp_path, text):
    path = tmp_path / "a.json"
    path.write_text(text)
    with pytest.raises(Exception, match="JSON"):
        json_array.read_array(spark, str(path), "map<string,string>").collect()


def test_written_as_by_dump(spark, tmp_path):
    rows = [{"id": i, "question": q, "score": 0.1 * i, "none": None, "flag": i % 2 == 0, "answers": [{"id": str(i), "text": q}] * (i % 3)} for i, q in enumerate(TEXTS * 4)]
    schema = "id long, question string, score double, none string, flag boolean, answers array<struct<id:string,text:string>>"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(5, "question")
    path = tmp_path / "out" / "a.json"
    for _ in range(2):  # the second one replaces the first
        json_files.write_json_array(df, str(path), ["id"])
        assert path.read_bytes() == (json.dumps(rows, ensure_ascii=False, indent=2) + "\n").encode()
    json_files.write_json_array(df.where("id < 0"), str(path), ["id"])
    assert path.read_bytes() == b"[]\n"
    json_files.write_json_array(df.orderBy("id").limit(1), str(path), ["id"])
    assert json.loads(path.read_text()) == rows[:1]


def test_lines_to_array(spark, tmp_path, tiny_ranges):
    rows = [{"id": i, "question": q} for i, q in enumerate(TEXTS)]
    (tmp_path / "in.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n", newline="")
    json_files.lines_to_array(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out.json"), "struct<id:long,question:string>")
    assert (tmp_path / "out.json").read_text(newline="") == json.dumps(rows, ensure_ascii=False, indent=2) + "\n"
    (tmp_path / "in.jsonl").write_text('{"id": 1\n')
    with pytest.raises(Exception, match="(?i)malformed|json"):
        json_files.lines_to_array(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out.json"), "struct<id:long,question:string>")


def test_read_again(spark, tmp_path, tiny_ranges):
    df = spark.createDataFrame([(str(i), q, None) for i, q in enumerate(TEXTS)], "ID string, Question string, Answer string")
    json_files.write_json_array(df, str(tmp_path / "a.json"), ["ID"])
    docs = json_files.load_documents(spark, str(tmp_path / "a.json"), limit=5).orderBy("doc_index").collect()
    ordered = sorted((str(i), q) for i, q in enumerate(TEXTS))
    assert [(r.doc_index, r.ID, r.Question, r.Answer) for r in docs] == [(k, i, q, "None") for k, (i, q) in enumerate(ordered[:5])]
