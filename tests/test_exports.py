import json

from turnstone.sources import exports as X


def put(path, name, value):
    (path / name).write_text(value if isinstance(value, str) else json.dumps(value))


def test_three_exports(spark, tmp_path):
    a, b, c = tmp_path / "a", tmp_path / "b", tmp_path / "c"
    for p in (a, b, c):
        p.mkdir()
    put(a, "1.json", {"conversation_id": "x", "create_time": 1.0, "messages": [{"role": "user", "create_time": 1700000000.5, "text": "hi"}, {"role": "assistant", "create_time": None, "text": "yes"}]})
    put(a, "2.json", "{broken")
    put(a, "3.json", {"conversation_id": "empty", "messages": []})
    put(b, "1.json", {"uuid": "y", "messages": [{"role": "human", "created_at": "2024-01-02T03:04:05Z", "text": "q"}]})
    put(c, "1.json", {"conversation": {"id": "z"}, "responses": [{"response": {"sender": "Human", "message": "m", "create_time": {"$date": {"$numberLong": "1700000000123"}}}}, {"response": {"sender": "ASSISTANT", "message": "n", "create_time": None}}]})
    got = X.load(spark, str(a), "chatgpt").orderBy("ordinal").collect()
    assert [(r.conversation_id, r.role, r.content) for r in got] == [("x", "user", "hi"), ("x", "assistant", "yes")]
    assert got[0].timestamp.isoformat() == "2023-11-14T22:13:20.500000"
    assert X.load(spark, str(b), "claude").first().role == "user"
    got = X.load(spark, str(c), "grok").orderBy("ordinal").collect()
    assert [(r.role, r.content) for r in got] == [("user", "m"), ("assistant", "n")] and got[0].timestamp.microsecond == 123000


def test_payloads(spark):
    bodies = [
        {"messages": [{"role": "user", "content": "a"}]},
        {"system": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "b"}, {"type": "image"}]}]},
        {"input": [{"role": "user", "content": "c"}]},
        {"contents": [{"role": "model", "parts": [{"text": "d"}, {"text": "e"}]}]},
        {"other": 1},
    ]
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(9, "{broken")], "id int, body string")
    assert [r.f for r in df.select("id", X.detect_format("body").alias("f")).orderBy("id").collect()] == ["openai", "anthropic", "openai_responses", "gemini", None, None]
    assert sorted(map(tuple, X.payload_messages(df).collect())) == [(0, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "c"), (3, 0, "assistant", "de")]


def test_evaluation_sets(spark, tmp_path):
    put(tmp_path, "l.json", [{"question_id": "q", "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": "user", "content": "b"}]], "haystack_dates": ["d1"]}])
    assert [(r.session, r.session_date, r.content) for r in X.longmemeval(spark, f"{tmp_path}/l.json").orderBy("session").collect()] == [(0, "d1", "a"), (1, None, "b")]
    spark.createDataFrame([(1, '[{"role":"user","content":"x"}]'), (2, "no")], "id int, prompt string").write.parquet(f"{tmp_path}/m")
    assert [tuple(r) for r in X.mrcr(spark, f"{tmp_path}/m").collect()] == [(1, 0, "user", "x")]
    e = spark.createDataFrame([("q", ["D1:3", "D12:4"])], "question_id string, evidence array<string>")
    assert [tuple(r) for r in X.locomo_evidence(e).collect()] == [("q", 1, 3), ("q", 12, 4)]
    assert spark.createDataFrame([("hello ->-> 1,2",)], "t string").select(X.beam_text("t")).first()[0] == "hello"
    s = spark.createDataFrame([(1, "[Session from May] a [Session from June] b")], "id int, content string")
    assert [(r.part, r.session_label, r.content) for r in X.split_sessions(s).collect()] == [(0, "May", "a"), (1, "June", "b")]
