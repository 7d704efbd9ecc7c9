"""Words and names that meet texts inside the text's row: results, and what is shuffled."""

from plinth.operators import texts as O


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_overlap_is_counted_in_the_row_of_the_slide(spark):
    titles = spark.createDataFrame(
        [("q", f"a{i}", f"Word{i} orders ORDERS ab") for i in range(200)] + [("q", "none", None), ("other", "a0", "orders")], "request_id string, asset_id string, title string"
    )
    slides = spark.createDataFrame([("q", 1, "preorders", None), ("q", 2, "", "word17 Word3")], "request_id string, number int, purpose string, cited string")
    got = O.word_overlap_score(titles, slides)
    assert exchanges(got) <= 4
    rows = {(r.number, r.asset_id): r.overlap for r in got.collect()}
    assert len(rows) == got.count() == 402 and rows[1, "none"] == rows[2, "none"] == 0
    assert all(rows[1, f"a{i}"] == 1 for i in range(200))
    assert {a for (n, a), k in rows.items() if n == 2 and k} == {"a1", "a3", "a17"}


def test_names_are_found_in_the_row_of_the_text(spark):
    names = [f"name {i:04}" for i in range(1500)]
    asked = spark.createDataFrame([("q", n) for n in [*names, "ab", ""]], "request_id string, needle string")
    texts = spark.createDataFrame([("q", k, f"xname {k:04}y ab"[: 11 + k]) for k in range(4)] + [("r", 9, "name 0001")], "request_id string, seq int, text string")
    got = O.found_inside(asked, texts, ["seq"])
    assert exchanges(got) <= 3
    want = {("q", k, f"name {k:04}") for k in range(4)} | {("q", k, "") for k in range(4)} | {("q", 3, "ab")}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_chunks_of_profiles_are_cut_once(spark):
    profiles = spark.createDataFrame([("q", 1, "people", 0, "Anna", ["brief"], None)], "request_id string, number int, slot_id string, item_ix int, name string, source_refs array<string>, max_chars int")
    sources = spark.range(2).selectExpr("'q' AS request_id", "'content_00' || id AS source_id", "CAST(id AS INT) AS seq", "'Anna has experience: marked; no ' || id AS text")
    got = O.enrich_profiles(profiles, sources)
    assert "marked" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.detail_ix, r.detail, r.source_id) for r in got.orderBy("detail_ix").collect()] == [(1, "Anna has experience: marked", "content_000"), (2, "Anna has experience: marked", "content_001")]
