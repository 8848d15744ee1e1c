"""Catalog, logs, dataset files, replies and critical hits on worked cases."""

import json

from pyspark.sql import functions as F

from fathomry.functions import replies
from fathomry.operators import audit, catalog, chunking
from fathomry.sources import datasets
from fathomry.streaming import events

USER = "username string, display_name string, role string, first_login long, last_login long, is_revoked boolean, promoted_by string"


def test_logins_keep_roles_and_changes_name_who_made_them(spark):
    users = spark.createDataFrame([("a", "A", "admin", 1, 1, False, "root"), ("b", "B", "pending", 1, 2, True, "")], USER)
    seen = spark.createDataFrame([("a", "Anna", "pending", 9, 9, False, ""), ("c", "C", "pending", 9, 9, False, "")], USER)
    now = {r.username: r for r in catalog.signed_in(users, seen).collect()}
    assert tuple(now["a"]) == ("a", "Anna", "admin", 1, 9, False, "root") and now["b"].is_revoked and now["c"].role == "pending"
    changed = {r.username: r for r in catalog.change_users(users, F.col("username") == "b", role="admin", is_revoked=False, by="root").collect()}
    assert tuple(changed["b"])[2:] == ("admin", 1, 2, False, "root") and tuple(changed["a"]) == tuple(users.first())
    assert catalog.change_users(users, F.col("username") == "b").collect() == users.collect()
    assert [r.username for r in catalog.pending(users.unionByName(seen)).collect()] == ["a", "c", "b"]
    assert [r.username for r in catalog.without(users, F.col("username") == "a").collect()] == ["b"]
    assert catalog.signed_in(users.limit(0), seen.limit(0)).count() == 0


def test_new_roles_replace_the_whole_row(spark):
    schema = "user_id string, role string, name string, allowed_categories array<string>, api_key string"
    roles = spark.createDataFrame([("a", "clerk", "A", ["x"], "k1"), ("b", "chief", "B", [], "k2")], schema)
    now = catalog.register_roles(roles, spark.createDataFrame([("a", "chief", None, ["y", "z"], "k3")], schema))
    assert tuple(catalog.role_of(now, api_key="k3").first()) == ("a", "chief", None, ["y", "z"], "k3")
    assert catalog.role_of(now, api_key="k1").count() == 0 and catalog.role_of(now, user_id="b").count() == 1


def test_roles_of_claims(spark):
    rows = [(["x", "root"], None), (None, [["y"], None, ["boss"]]), ([], []), (None, None)]
    got = spark.createDataFrame(rows, "realm array<string>, clients array<array<string>>").select(catalog.role_from_claims(F.col("realm"), F.col("clients"), ["root"], ["boss"]).alias("r"))
    assert [r.r for r in got.collect()] == ["superuser", "admin", "pending", "pending"]


def test_requests_and_documents(spark):
    asked = spark.createDataFrame([(None, ["a"]), ("", None), ("a", ["a"]), ("b", ["a"]), ("b", None)], "c string, allowed array<string>")
    assert [r.ok for r in asked.select(catalog.may_ask(F.col("c"), F.col("allowed")).alias("ok")).collect()] == [True, True, True, False, False]
    docs = spark.createDataFrame([("/a/x.txt", "Pay"), ("/a/y.txt", None)], "path string, category string")
    now, fresh = catalog.add_documents(docs, spark.createDataFrame([("/a/x.txt", "Leave"), ("/b/z.txt", "Pay")], docs.schema))
    assert sorted(map(tuple, now.collect())) == [("/a/x.txt", "Leave"), ("/a/y.txt", None), ("/b/z.txt", "Pay")] and [r.path for r in fresh.collect()] == ["/b/z.txt"]
    hits = spark.createDataFrame([("/a/x.txt",), ("x.txt",), ("/a/xx.txt",), (None,)], "file string")
    assert {r.file for r in catalog.in_files(hits, docs).collect()} == {"/a/x.txt", "x.txt"}
    paths = spark.createDataFrame([("/c",), ("/c/x",), ("/cc/x",), (None,)], "p string")
    assert [r.i for r in paths.select(chunking.in_folder(F.col("p"), "/c/").alias("i")).collect()] == [True, True, False, False]


def test_critical_hits_come_first_within_the_candidates(spark):
    hits = spark.createDataFrame([(1, d, d, c) for d, c in ((1, False), (2, None), (3, True), (4, True))], "qid int, doc_id int, rank int, is_critical boolean")
    assert [(r.doc_id, r.rank) for r in chunking.critical_first(hits, 3).orderBy("rank").collect()] == [(3, 1), (4, 2), (1, 3)]


def test_dataset_files(spark, tmp_path):
    def put(name, rows):
        (tmp_path / name).write_text("".join(json.dumps(r) + "\n" for r in rows))
        return str(tmp_path / name)

    corpus = put("c.jsonl", [{"doc_id": 4, "title": "Bones.", "abstract": ["One, two.", "Three."]}, {"doc_id": 5, "title": "T", "abstract": "[plain"}, {"doc_id": 6, "title": "Only"}])
    assert {r.doc_id: r.text for r in datasets.scifact_corpus(spark, corpus).collect()} == {"4": "Bones.. One, two. Three", "5": "T. [plain", "6": "Only"}
    claims = put("q.jsonl", [{"id": 1, "claim": "a", "evidence": {"4": [{"sentences": [0]}], "5": []}}, {"id": 2, "claim": "b", "evidence": {}}, {"id": 3, "claim": "c"}])
    asked, grades = datasets.scifact_claims(spark, claims)
    assert [tuple(r) for r in asked.collect()] == [("1", "a")] and sorted(map(tuple, grades.collect())) == [("1", "4", 1), ("1", "5", 1)]
    page = {"evidence_page_num": 7, "evidence_text": "short", "evidence_text_full_page": "whole"}
    bench = put("f.jsonl", [{"financebench_id": "f1", "doc_name": "D", "question": "q", "evidence": [page, {"evidence_page_num": 7, "evidence_text": "bare"}, {"evidence_page_num": 2, "evidence_text": ""}]}, {"financebench_id": "f2", "doc_name": "D", "question": "q", "evidence": [{"evidence_text": "no page"}]}, {"financebench_id": "f3", "doc_name": "D", "question": "q", "evidence": []}])
    assert [tuple(r) for r in datasets.financebench(spark, bench).collect()] == [("f1", "D", "q", [2, 7], ["whole", "bare"])]


def test_replies_end_where_they_say(spark):
    lines = ['{"message":{"content":"Hel"}}', "", "not json", '{"message":{"content":"lo"},"done":false}', '{"message":{"content":"!"},"done":true}', '{"message":{"content":"late"}}', None]
    schema = "reply_id int, line_no int, line string"
    assert [tuple(r) for r in replies.from_ndjson(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], schema)).collect()] == [(1, "Hello!")]
    lines = [": ping", 'data: {"choices":[{"delta":{"role":"assistant"}}]}', 'data:{"choices":[{"delta":{"content":"Hi "}}]}', 'data: {"choices":[{"delta":{},"message":{"content":"you"}}]}', "data: {broken", 'data: {"choices":[]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']
    assert [tuple(r) for r in replies.from_events(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], schema)).collect()] == [(1, "Hi you")]


ANSWER = "user_id string, role string, query string, category string, answer string, grounded double, abstained boolean, sources array<string>, confidence double, ts timestamp"


def test_answers_leave_rows_counters_and_open_questions(spark, tmp_path):
    rows = [("u", "r", "Q?", None, "x" * 1500, 0.5, False, ["a"], 0.9, 1), ("u", "r", "q? ", "pay", None, None, True, None, None, 2)]
    answers = spark.createDataFrame(rows, ANSWER.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts"))
    logged, asked, left = (x.collect() for x in audit.answer_logs(answers))
    by = {r.category: r for r in logged}
    assert len(by["general"].answer) == 1000 and by["general"].sources == '["a"]' and tuple(by["pay"])[5:] == ("", 0.0, True, "[]", 0.0)
    assert [(r["count"], r.query) for r in asked] == [(2, "Q?")] and [(r.category, r.status) for r in left] == [("pay", "open")]
    answers.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(answers.schema).parquet(str(tmp_path / "in"))
    events.log_answers(stream, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/audit")).count() == 2 and spark.read.parquet(str(tmp_path / "out/open")).count() == 1


def test_violations_are_clipped(spark):
    v = "violations array<struct<layer:string,rule:string,severity:string,matched:string>>"
    rows = [("u", "r", 1, "q" * 600, [("input", "jailbreak", "high", "m" * 300), ("input", "pii_in_query", "low", None)]), ("u", "r", 2, "q", [])]
    got = audit.violation_rows(spark.createDataFrame(rows, f"username string, role string, ts long, sanitised string, {v}")).collect()
    assert [(r.rule, len(r.matched), len(r.query)) for r in got] == [("jailbreak", 200, 500), ("pii_in_query", 0, 500)]
