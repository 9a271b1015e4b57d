from symgrid.llm import simhash


def test_one_row_of_each_group(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and kept.exceptAll(odd).count() == 0
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.select("doc_id").collect()) == [(False, 1), (False, 2), (False, 4), (True, 0)]


def test_repeated_and_null_keys(spark):
    one, two = ("a text of its own " * 9, "another one that is quite unlike the first of them")
    rows = [(5, one, "x"), (5, one, "x"), (5, one, "y"), (None, one, "x"), (None, two, "x"), (None, two, "x")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, two), (5, one)]
