import json

import pytest
from pyspark.sql import functions as F

from granary.sources import records, schemas, sinks


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_jsonl_keeps_broken_lines_and_missing_paths_are_empty(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", ['{"id": "1"}', "", '{"id": "2"'])
    rows = records.read_jsonl(spark, path, "id string").cache()
    assert rows.filter("id = '1'").count() == 1
    assert rows.filter("_corrupt_record is not null").count() == 1
    assert records.read_jsonl(spark, str(tmp_path / "none"), "id string").count() == 0


def test_last_line_of_a_key_wins(spark, tmp_path):
    path = write(tmp_path / "k.jsonl", [json.dumps({"id": i % 3, "v": i}) for i in range(10)])
    assert sorted(map(tuple, records.read_keyed(spark, path, "id long, v long").collect())) == [(0, 9), (1, 7), (2, 8)]
    assert records.read_keyed(spark, str(tmp_path / "none"), "id long, v long").count() == 0


def test_line_numbers_are_dense_over_splits(spark, tmp_path):
    path = write(tmp_path / "t.txt", [f"line {i}" for i in range(5000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        rows = records.read_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {r.line_no: r.value for r in rows} == {i: f"line {i}" for i in range(5000)}


def test_paired_files_skip_blank_lines_and_need_equal_lengths(spark, tmp_path):
    a = write(tmp_path / "a", ["assertTrue(x)", "", "assertNull(y)"])
    b = write(tmp_path / "b", ['t1 { "<AssertPlaceHolder>" } "<FocalMethod>" int f()', 't2 "<FocalMethod>" ', ""])
    rows = records.split_methods(records.read_paired(spark, a, b)).collect()
    assert [(r.line_no, r.test_case, r.focal_method) for r in rows] == [(0, "t1 { assertTrue(x) }", "int f()")]
    short = write(tmp_path / "c", ["one"])
    with pytest.raises(Exception, match="differ in length"):
        records.read_paired(spark, a, short).collect()


def test_files_fall_back_to_latin_1_and_skip_package_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "A.java").write_bytes("é".encode())
    (tmp_path / "d" / "e" / "B.java").write_bytes("é".encode("latin-1"))
    (tmp_path / "d" / "package-info.java").write_text("x")
    rows = {r.name: r.text for r in records.read_files(spark, str(tmp_path / "d"), ".java").collect()}
    assert rows == {"A.java": "é", "B.java": "é"}


def test_coverage_xml(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<report><package name="a"><class name="a/B"><method name="f" desc="(I)V"/><method name="g" desc="()V"/></class></package></report>')
    rows = records.read_coverage(spark, str(tmp_path / "r.xml")).collect()
    assert {tuple(r) for r in rows} == {("a", "a/B", "f", "(I)V"), ("a", "a/B", "g", "()V")}


def test_record_files_and_csv_and_registry(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "7_12.json").write_text(json.dumps({"focal_method": {"identifier": "f", "body": "x"}, "test_case": {"body": "y", "invocations": ["a"]}}))
    row = records.open_dataset("Record_Files", spark, str(tmp_path / "m")).first()
    assert (row.id, row.project, row.focal_method.identifier) == ("7_12", "7", "f")
    assert records.open_dataset("unknown") is None
    path = write(tmp_path / "b.csv", ["project_id,version_id,test_suite_source,test_id,test_classification,num_trigger", "P,1,s,1,Pass,-", "P,2,s,1,Fail,3"])
    assert [r.num_trigger for r in records.read_csv(spark, path, schemas.BUG_DETECTION).orderBy("version_id").collect()] == [None, 3]


def test_member_folders_and_shards(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "member string, id long")
    sinks.write_by_member(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r.member, r.id) for r in back.collect()} == {("a", 1), ("b", 2)}
    assert sinks.union_shards([rows, rows.select("id").withColumn("x", F.lit(1))]).count() == 4
    sinks.write_texts(spark.createDataFrame([("T", "class T {}")], "name string, text string"), str(tmp_path / "texts"))
    assert spark.read.text(str(tmp_path / "texts")).filter("value = 'class T {}'").count() == 1
    assert sinks.write_result(rows.agg(F.count("*").alias("n")), str(tmp_path / "in.jsonl")).endswith("in-res.json")


def test_positional_and_nested_maps(spark):
    rows = spark.createDataFrame([("t", [("a", None, 0.5), (None, "b", 0.25)])], schemas.RETRIEVED)
    assert [tuple(r) for r in records.retrieval_map(rows, 1).collect()] == [("t", 1, "a", 0.5)]
    assert [r.src for r in records.retrieval_map(rows, 5).orderBy("rank").collect()] == ["a", "b"]


def test_settings_and_broken_state(spark, tmp_path):
    pytest.importorskip("yaml")
    assert records.read_settings(spark, write(tmp_path / "c.yaml", ["a:", "  b: 1", "c: [x, y]"])) == {"a": {"b": 1}, "c": ["x", "y"]}
    assert records.read_settings(spark, str(tmp_path / "none.yaml")) == {}
    state = write(tmp_path / "s.json", ['{"id": 1}', '{"id": '])
    assert [r.id for r in records.read_state(spark, state, "id long").collect()] == [1]


def test_archives_of_null_contents_and_names(spark):
    files = spark.createDataFrame([("g", "b", None), ("g", "a", b"x"), ("g", None, b"y"), (None, "c", b"z")], "`group` string, name string, content binary")
    packed = sinks.archives(files).cache()
    assert [r.archive for r in packed.collect()] == ["g.tar.bz2"]
    assert [(r.name, bytes(r.content)) for r in records.read_archives(packed).collect()] == [("a", b"x"), ("b", b"")]
    assert sinks.archives(files.limit(0)).count() == 0
