from tessera.llm import decontaminate


def test_null_ids_and_short_items(spark):
    item = " ".join(f"item{i}" for i in range(30))
    items = spark.createDataFrame([(None, item), (2, "Rare word here"), (3, "lone"), (4, "word here rare")], "item_id long, text string")
    texts = [(1, f"before {item} after"), (2, "it says: rare WORD here, and goes on for long"), (3, "a lone one"), (4, "rare word, not here at all"), (5, "rare word here"), (6, None), (7, "alone")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.window, r.similarity) for r in decontaminate.leaks(df, items).collect()}
    assert got == {(1, None): (1, 1.0), (2, 2): (2, 1.0), (5, 2): (0, 1.0), (3, 3): (1, 1.0)}
    assert sorted(r.doc_id for r in decontaminate.clean(df, items).collect()) == [4, 6, 7]
