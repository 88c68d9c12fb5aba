"""Sources, sinks and streams on files."""

import json

import pytest
from pyspark.sql import functions as F

from auditspark.sources import readers as R
from auditspark.sources import writers as W
from auditspark.streaming import progress as P


def test_source_tree(spark, tmp_path):
    for name in ("src/a.c", "src/b.HPP", "vendor/c.c", "src/deps/d.c", "notes.txt", ".audit-index-1/e.c"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"int x;\nint y\xff;\r\nint z;")
    files = R.source_files(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"src/a.c", "src/b.HPP"}
    lines = R.text_lines(files.filter("path = 'src/a.c'")).orderBy("line").collect()
    assert [(r.line, r.text) for r in lines] == [(1, "int x;"), (2, "int y�;"), (3, "int z;")]


def test_tool_outputs(spark, tmp_path):
    (tmp_path / "tags.json").write_text('{"_type": "tag", "name": "f", "line": 6, "end": 8}\n{"_type": "ptag"}\nnot json\n')
    assert [(r.name, r.line, r.end) for r in R.read_tags(spark, str(tmp_path / "tags.json")).collect()] == [("f", 6, 8)]
    match = {"path": "a.c", "check_id": "r.x", "start": {"line": 3}, "extra": {"message": "m", "lines": "requires login", "metavars": {"$P": {"abstract_content": "p"}}, "metadata": {"k": "v"}}}
    (tmp_path / "m.json").write_text(json.dumps({"results": [match, match]}))
    rows = R.read_matches(spark, str(tmp_path / "m.json")).collect()
    assert len(rows) == 2 and rows[0].metavars == {"$P": "p"} and rows[0].lines == "" and rows[0].severity == "WARNING"
    (tmp_path / "e.xml").write_text('<results><errors><error id="memleak" severity="error" msg="m"><location file="a.c" line="4"/></error><error id="style" severity="x" msg="n"/></errors></results>')
    assert {(r.id, r.line) for r in R.read_leak_errors(spark, str(tmp_path / "e.xml")).collect()} == {("memleak", 4), ("style", None)}
    (tmp_path / "log").write_text("c1\x1ffix: a\nbroken\nc2\x1fadd b\x1fc\n")
    assert [tuple(r) for r in R.read_git_log(spark, str(tmp_path / "log")).collect()] == [("c1", "fix: a"), ("c2", "add b\x1fc")]


def test_manifests_and_artifacts(spark, tmp_path):
    for name, body in (("a", {"name": "npd"}), ("b", {"name": "npd"}), ("c", {"name": "off", "enabled": False})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "checker.json").write_text(json.dumps(body))
    assert [r.name for r in R.read_manifests(spark, str(tmp_path)).collect()] == ["npd"]
    paths = spark.createDataFrame([("x", "a/checker.json")], "key string, path string")
    assert json.loads(R.read_artifacts(spark, str(tmp_path), paths).first().json) == {"name": "npd"}
    with pytest.raises(ValueError):
        R.read_artifacts(spark, str(tmp_path), spark.createDataFrame([("x", "../y")], "key string, path string"))


def test_git_log_filters(spark, tmp_path):
    lines = [f"c{i}\x1f2024-01-{i:02d}\x1f{p}\x1fs{i}\x1fx" for i, p in ((9, "src/a.c\tdoc"), (7, "srcs/a.c"), (5, "src"), (3, "src/b.c"), (1, "doc"))]
    (tmp_path / "log").write_text("\n".join(lines) + "\n")
    read = lambda **k: [tuple(r) for r in R.read_git_log(spark, str(tmp_path / "log"), **k).collect()]
    assert read(since="2024-01-02", paths=["src/"]) == [("c9", "s9\x1fx"), ("c5", "s5\x1fx"), ("c3", "s3\x1fx")]
    assert read(limit=2, paths=["src"]) == [("c9", "s9\x1fx"), ("c5", "s5\x1fx")] and len(read(limit=0, since="2024-01-05")) == 3


def test_yaml_manifests(spark, tmp_path):
    texts = {"a": "# c\nname: npd  # rule\nlabel: \"x \\\"y\\\"\"\ndescription: >-\n  one\n  two\n\nfamily: 'it''s'\nnested:\n  name: no\n", "b": "name: npd\nlabel: later\n", "c": "name: off\nenabled: No\n", "d": "label: plain\n", "e": "name: null\nuser_created: true\n"}
    for folder, text in texts.items():
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "checker.yaml").write_text(text)
    found = {r.name: (r.label, r.description, r.family, r.user_created) for r in R.read_manifests(spark, str(tmp_path)).collect()}
    assert found == {"npd": ('x "y"', "one two", "it's", None), "d": ("plain", None, None, None), "e": (None, None, None, True)}


def test_index_survives_a_crash(spark, tmp_path):
    path = str(tmp_path / "index")
    W.write_index({"files": spark.range(3)}, path, "v1")
    (tmp_path / "index").rename(tmp_path / "index.old")  # as if it had stopped between the two moves
    W.recover_index(spark, path)
    assert W.index_complete(spark, path, "v1") and spark.read.parquet(f"{path}/files").count() == 3


def test_replacement_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "findings")
    rows = spark.createDataFrame([(s, n) for s in "stuv" for n in range(3)], "scan_id string, line int")
    W.replace_scan(rows, path, ["line"], buckets=2)
    scans = spark.createDataFrame([("s",), ("t",), ("u",)], "scan_id string")
    W.replace_scan(rows.filter("scan_id = 't' AND line = 2"), path, ["line"], scans, buckets=2)
    assert {tuple(r) for r in spark.read.parquet(path).select("scan_id", "line", "idx").collect()} == {("t", 2, 0), ("v", 0, 0), ("v", 1, 1), ("v", 2, 2)}


def test_json_array(spark, tmp_path):
    rows = spark.createDataFrame([(2, 'q "é"\n', ["a", "b"], None), (1, "x", [], {"k": "v"})], "seq int, name string, related array<string>, metadata map<string,string>")
    text = "\n".join(r.value for r in W.candidates_json(rows).collect())
    assert json.loads(text) == [{"name": "x", "related": [], "metadata": {"k": "v"}}, {"name": 'q "é"\n', "related": ["a", "b"], "metadata": None}] and "é" in text and '\n    "name"' in text


def test_index_and_replacement(spark, tmp_path):
    path = str(tmp_path / "index")
    assert not W.index_complete(spark, path, "v1")
    W.write_index({"files": spark.range(3)}, path, "v1")
    W.write_index({"files": spark.range(4)}, path, "v1")
    assert W.index_complete(spark, path, "v1") and not W.index_complete(spark, path, "v2")
    assert spark.read.parquet(f"{path}/files").count() == 4
    found = str(tmp_path / "findings")
    rows = spark.createDataFrame([("s", 5), ("s", 9), ("t", 1)], "scan_id string, line int")
    W.replace_scan(rows, found, ["line"])
    W.replace_scan(rows.filter("line = 9"), found, ["line"])
    assert {tuple(r) for r in spark.read.parquet(found).select("scan_id", "line", "idx").collect()} == {("s", 9, 0), ("t", 1, 0)}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(0, "npd", "f/g", "a.c", 3, "high", "confirmed", "uses ```x```")], "idx int, vuln_type string, function string, file string, line int, severity string, ai_verdict string, description string")
    page = W.markdown(rows).first()
    assert page.file_name == "0000-npd-f_g.md" and "````\nuses ```x```\n````" in page.content
    W.export_markdown(rows, str(tmp_path / "md"))
    W.export_candidates(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 1


def test_streams_equal_batches(spark, tmp_path):
    data = [("s", 1, "init"), ("s", 2, "auditing"), ("s", 3, "completed"), ("s", 4, "auditing"), ("t", 1, "static_analysis")]
    rows = spark.createDataFrame([(a, b, p) for a, b, p in data], "scan_id string, seq long, phase string").withColumns({"timestamp": F.lit("2024-01-01").cast("timestamp"), "message": F.lit(""), "candidate_index": F.lit(0)})
    rows.write.parquet(str(tmp_path / "in"))
    log = P.append_events(P.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    log.awaitTermination(120)
    assert P.replay(spark, str(tmp_path / "out")).count() == 5
