import importlib.util

import __spark_entry__


def test_names():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 60


def test_without_the_training_data_operators(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("evoframe.llm", "corpus_pipeline")) else find(name, *a))
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and "bm25_top3" in queries and not any(n.startswith("op1_") or n == "pipeline" for n in queries)


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
