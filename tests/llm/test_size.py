"""What must hold whatever the size of the input."""

from tessera.llm import simhash


def test_op1_sends_no_table_that_grows_through_the_driver(spark, monkeypatch):
    plans, save = [], simhash.Scratch.save
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash.Scratch, "save", lambda self, df: (plans.append(plan(df)), save(self, df))[1])
    docs = spark.createDataFrame([(i, f"one two three four five {i % 7} six seven eight nine {i % 3}") for i in range(40)], "doc_id long, text string")
    for out in (simhash.near_duplicates(docs), simhash.keep_one(docs)):
        plans.append(plan(out))
        assert out.count() > 0
    assert sum("SortMergeJoin" in p for p in plans) > 4 and not any("Broadcast" in p for p in plans)
