import json
from datetime import datetime

from weftline.operators import nested

REPORTS = "report_no bigint, received_at timestamp, payload string, value string, name string"
T = [datetime(2025, 1, n) for n in range(1, 5)]


def run(spark, reports, wanted=("file", "capability", "fact_name")):
    df = spark.createDataFrame([(*r, "a", "b") for r in reports], REPORTS)
    return {(r.record_kind, r.root_no, r.file_pos, r.item_pos, r.name, r.value) for r in nested.shred_reports(df, wanted).collect()}


def test_children_keep_their_links(spark):
    doc = {"files": [None, {"path": "a", "capabilities": {"declarations": {"status": "partial"}, "x": None}, "facts": {"kind": "k", "span": {"startLine": "7"}}},
                     {"capabilities": {"declarations": "complete"}, "facts": [None, {"span": None}, {"span": {"startLine": 12.0}}, {"span": {"startLine": None}}]}]}
    old = {"files": [{"path": "old"}]}
    got = run(spark, [(1, T[0], json.dumps(old)), (1, T[1], json.dumps(doc)), (1, T[1], json.dumps(doc))])
    assert {g for g in got if g[0] == "fact" and g[5] is not None} == {("fact", 1, 1, 0, "k", "7"), ("fact", 1, 2, 2, None, "12")}
    assert {g for g in got if g[0] == "capability"} == {("capability", 1, 1, -1, "declarations", "partial"), ("capability", 1, 1, -1, "x", None), ("capability", 1, 2, -1, "declarations", "complete")}
    assert {g[2] for g in got if g[0] == "file"} == {0, 1, 2}
    assert {g for g in got if g[0] == "fact"} >= {("fact", 1, 2, 0, None, None)}


def test_what_is_not_valid_gives_nothing(spark):
    good = json.dumps({"files": [{"path": "a"}]})
    cases = [None, "", "null", "[]", good[:-1], good + "x", '{"files": {"path": 1}}', '{"files": null}', '{"files": [1, "s"]}', "{'files': []}"]
    got = run(spark, [(i, T[0], x) for i, x in enumerate(cases)])
    assert {g[1] for g in got} == {8}  # entries that are no objects still have their position
    # a correction that is cut takes the earlier report away
    assert run(spark, [(1, T[0], good), (1, T[1], good[:-2])]) == set()
    assert run(spark, []) == set()


def test_long_payload_and_repeated_keys(spark):
    doc = '{"files": [], "files": [{"path": "p", "facts": [' + ",".join('{"span": {"startLine": %d}}' % i for i in range(50_000)) + "]}]}"
    got = run(spark, [(5, T[0], doc)], ("declarations",))
    assert len(got) == 50_000 and ("fact", 5, 0, 49_999, None, "49999") in got


def test_decimal_text():
    assert [nested.decimal_text(x) for x in ("12", "12.0", "1e2", "x", None, "1.5", "-3")] == ["12", "12", "100", "x", None, "1.5", "-3"]


def test_subjects(spark):
    schema = "envelope_no bigint, evidence_id string, subject struct<authority: string, namespace: string, value: string, repository: struct<owner: string, name: string, commit: string>>, received_at timestamp"
    rows = [
        (1, "e", ("a", "n", "v", ("o", "r", "c1")), T[0]), (1, "e", ("a", "n", "v", ("o", "r", "c2")), T[1]), (2, "e", None, T[0]),
        (3, "e", ("a", None, "v", None), T[0]), (4, "e", (None, None, None, (None, None, "c")), None),
    ]
    got = nested.subjects(spark.createDataFrame(rows, schema))
    assert {(r.envelope_no, r.commit) for r in got.collect()} == {(1, "c2"), (4, "c")}
