"""The cascade normalises a text once, and pairs of classes turn into pairs of records without a join of that size."""

import duckdb

from tessera import queries
from tessera.operators import blocking, classes
from tessera.sources import records


def test_texts_are_normalised_once_and_ids_come_in_lists(spark, monkeypatch):
    monkeypatch.setattr(classes, "HELD", 2)
    rows = [(f"S1-{i}", "Café Sol Ltd.", "4 Main Rd", "FR") for i in range(5)] + [(f"S{2 + i % 2}-{i}", "Cafe Sol", "4 main road" if i else None, "FR") for i in range(7)]
    rows += [("S1-x", "Café Sol Ltd.", "4 Main Rd", None), ("S2-2", "Cafe Sol", "4 main road", "FR"), ("S1-e", "", None, "FR"), ("S2-e", "", None, "FR")]
    df = spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string")
    seen = []
    made = lambda x: (seen.append(x.count()), records.derived(x))[1]
    plain, got = records.preprocess(df), blocking.cascade(df.filter("entity_id like 'S1-%'"), df.filter("entity_id not like 'S1-%'"), made)
    assert seen == [3, 3]
    got = sorted(tuple(r) for r in got.collect())
    assert got == sorted(tuple(r) for r in blocking.cascade(plain.filter("src = 'S1'"), plain.filter("src <> 'S1'")).collect())
    # an id that occurs twice is two records
    assert len(got) == 5 * 7 and sum(t == "S2-2" for _, t, _ in got) == 10 and {s for _, _, s in got} == {0.9}


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view part as select * from '{d}/part.parquet'")
    want = sorted(db.execute(queries.SQL["cascade_v2"]).fetchall())
    assert want and sorted(tuple(r) for r in queries.QUERIES["cascade_v2"](spark, d).collect()) == want
