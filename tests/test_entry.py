import __spark_entry__ as entry


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40
    df = entry.entry(spark)
    assert df.columns == ["qid", "rank", "score", "docid", "title", "body_snippet", "num_results"]
