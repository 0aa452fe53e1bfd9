from chronocell.llm.mixture import mix_sources, mixed_rows


def table(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{min(i % 10, 3)}", "clash") for i in range(4000)] + [(5000, None, None, ""), (5001, "a b", None, ""), (None, "c", "s0", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")


def test_taken_words_come_near_targets(spark):
    got = mix_sources(table(spark)).collect()
    assert len(got) == 4003
    sums, target, size = {}, {}, {}
    for r in got:
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values()) or all(target[s] == 2 * size[s] for s in size)
    for s in sums:
        assert abs(sums[s] - target[s]) <= 8 and target[s] <= 2 * size[s] + 1e-9


def test_rows_and_reruns_agree(spark):
    df = table(spark)
    copies = {(r["doc_id"], r["copies"]) for r in mix_sources(df).collect() if r["copies"]}
    rows = mixed_rows(df.repartition(7)).collect()
    # The table has a column of the count's name, which stays; the count is beside it.
    assert {(r["doc_id"], r["copies_1"]) for r in rows} == copies and len(rows) == len(copies)
    assert rows[0].asDict().keys() == {"doc_id", "text", "source", "copies", "copies_1"} and {r["copies"] for r in rows} == {"clash", ""}
    assert mix_sources(df.limit(0)).count() == 0 and mixed_rows(df.limit(0)).count() == 0


def test_a_hot_source_and_rows_of_one_place(spark):
    # Most rows are one source's; another's rows all have one id, so one place, and go together.
    rows = [(i, "w " * (1 + i % 9), "hot") for i in range(3000)] + [(7, "a b c", "same")] * 200 + [(None, "x y", None)] * 50
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sums, target, copies = {}, {}, {}
    for r in got:
        sums[r["source"]] = sums.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        copies.setdefault(r["source"], set()).add(r["copies"])
        assert r["taken"] <= 2 * r["size"]
    assert len(got) == len(rows) and len(copies["same"]) == 1 and len(copies[None]) == 1
    assert abs(sums["hot"] - target["hot"]) <= 10
    assert abs(sums["same"] - target["same"]) <= 300 and abs(sums[None] - target[None]) <= 50


def test_very_long_texts(spark):
    rows = [(1, "word " * 400_000, "s"), (2, "a b c", "s"), (3, "x" * 2_000_000, "t")]
    got = {r["doc_id"]: r for r in mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i: r["size"] for i, r in got.items()} == {1: 400_000, 2: 3, 3: 1} and all(r["taken"] <= 2 * r["size"] for r in got.values())
