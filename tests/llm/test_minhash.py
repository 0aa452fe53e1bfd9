import random

from chronocell.llm.minhash import near_duplicates

SCHEMA = "doc_id long, text string"


def brute(rows, threshold=75, words=5):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus(seed, groups=30, copies=6):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Été", "ÀB", "Ab"]
    rows, i = [], 0
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 40, 120]))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
            i += 1
    rng.shuffle(rows)
    return rows


def test_groups_equal_brute_force(spark):
    rows = corpus(1) + [(9001, None), (9002, ""), (9003, " \n\t"), (9004, None)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)


def test_chain_within_one_bucket(spark):
    # Each text is near the next one only: the bucket's head does not reach the far end.
    words = [f"t{k}" for k in range(200)]
    rows = [(k, " ".join(words[4 * k : 4 * k + 100])) for k in range(20)]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert len({r[2] for r in got}) == 1


def test_repeated_rows_null_ids_and_other_columns(spark):
    text = " ".join(f"x{k}" for k in range(30))
    rows = [(5, text, 1, 2), (5, text, 3, 4), (7, text.upper(), 0, 0), (None, text, 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, component long")
    got = sorted(((r[0], r[2], r[3]) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (7, 5, False), (None, None, True)], key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hubs_and_all_pairs_agree(spark, monkeypatch):
    # One large group in which many pairs are near, many are not, and none is through a fixed head.
    rng = random.Random(6)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = f"z{rng.randrange(1000)}"
        rows.append((i, " ".join(text)))
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for pairs, looks, part, largest in ((0, 0, 9, 10**6), (0, 10**6, 7, 10**6), (10**6, 10**6, 10**6, 10**6), (10**6, 10**6, 7, 5)):
        monkeypatch.setattr("chronocell.llm.minhash.BUCKET_PART", part)
        monkeypatch.setattr("chronocell.llm.minhash.LARGEST_BUCKET", largest)
        monkeypatch.setattr("chronocell.llm.minhash.PAIRS_A_MEMBER", pairs)
        monkeypatch.setattr("chronocell.llm.minhash.LOOKS_A_MEMBER", looks)
        assert {tuple(r) for r in near_duplicates(df).collect()} == want


def test_unlike_texts_that_share_bands(spark, monkeypatch):
    # Boilerplate puts unlike texts into one bucket; hubs connect none, and some pairs among them are near.
    rng = random.Random(8)
    shared = [f"s{k}" for k in range(45)]
    rows = []
    for i in range(60):
        own = [f"o{i // 3 if i % 4 else i}-{k}" for k in range(40)]
        if i % 4:
            own[rng.randrange(40)] = f"z{i}"
        rows.append((i, " ".join(shared + own)))
    rows += [(200, rows[1][1]), (200, rows[50][1]), (201, None)]
    want = brute([r for r in rows if r[0] != 200])
    df = spark.createDataFrame(rows[:60] + rows[-1:], SCHEMA)
    monkeypatch.setattr("chronocell.llm.minhash.PAIRS_A_MEMBER", 0)
    monkeypatch.setattr("chronocell.llm.minhash.LOOKS_A_MEMBER", 0)
    assert {tuple(r) for r in near_duplicates(df).collect()} == want
    # The one bucket in parts that meet in tasks of their own.
    with monkeypatch.context() as m:
        m.setattr("chronocell.llm.minhash.LOOKS_A_MEMBER", 10**6)
        m.setattr("chronocell.llm.minhash.BUCKET_PART", 8)
        assert {tuple(r) for r in near_duplicates(df).collect()} == want
    # An id of two texts links what either is near to.
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == got[50] == got[200]


def test_ids_beyond_the_filter_are_joined(spark, monkeypatch):
    rows = corpus(3, groups=12)
    monkeypatch.setattr("chronocell.llm.minhash.BITS", 8)
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_filter_passes_every_key(spark):
    from chronocell.llm.presence import may_be_in, presence

    rows = spark.range(2000).selectExpr("id AS k", "'t' AS text").union(spark.createDataFrame([(None, "t")], "k long, text string"))
    flagged, there = may_be_in(rows, "k", presence(spark.range(0, 2000, 40)))
    got = [(r["k"], r["there"]) for r in flagged.withColumn("there", there).collect()]
    assert len(got) == 2001 and {k for k, yes in got if yes} >= set(range(0, 2000, 40))
    assert sum(yes for _, yes in got) < 60
    flagged, there = may_be_in(rows, "k", presence(spark.range(0)))
    assert flagged.where(there).count() == 0 and flagged.count() == 2001


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = [f"l{rng.randrange(5000)}" for _ in range(60_000)]
    near = list(long)
    for _ in range(1500):
        near[rng.randrange(len(near))] = "changed"
    rows = [(3, " ".join(long)), (8, " ".join(near)), (9, " ".join(long[:30_000]))]
    assert {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_whole_table_against_brute_force(spark):
    """Every document of a given table, links and set sizes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {tuple(r) for r in near_duplicates(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(not r[3] for r in got)
