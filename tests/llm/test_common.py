from turnstone.llm.common import in_ids, materialize, not_in_ids, shared_dir


def test_ids_by_broadcast_and_by_shuffle_agree(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (5, "e")], "k long, v string")
    ids = spark.createDataFrame([(2,), (5,), (9,)], "k long")
    for most in (10, 1):
        assert sorted(r.v for r in in_ids(df, ids, "k", most).collect()) == ["b", "c", "e"]
        assert sorted(r.v for r in not_in_ids(df, ids, "k", most).collect()) == ["a", "d"]
    assert in_ids(df, ids.limit(0), "k").count() == 0 and not_in_ids(df, ids.limit(0), "k").count() == 5


def test_tables_are_written_to_the_shared_folder(spark):
    df = spark.range(5)
    out = materialize(df, "numbers")
    assert out.count() == 5 and shared_dir(spark).split(":")[-1].lstrip("/") in out.inputFiles()[0]
    assert materialize(df.where("id < 0"), "none").count() == 0
