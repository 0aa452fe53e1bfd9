import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from chronocell.llm import langid, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STEMS = {"en": ["the", "wind", "over", "hills", "brought", "rain", "and", "people", "walked", "home"], "de": ["über", "straße", "ging", "der", "mann", "nach", "hause", "müde", "und", "spät"]}


@pytest.fixture(autouse=True)
def one_run(monkeypatch):
    """One training run is enough for such texts."""
    monkeypatch.setattr(langid, "RATES", (0.02,))


def prose(rng, lang, n):
    stems = STEMS[lang]
    return " ".join(rng.choice(stems) + (rng.choice(stems) if rng.random() < 0.3 else "") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(k, prose(rng, "de" if k % 3 == 0 else "en", rng.choice([12, 40, 90])), "de" if k % 3 == 0 else "en", f"s{k % 4}" if k % 7 else None) for k in range(1, 241)]
    out += [(300 + k, "$$$ WIN !!! CLICK >>> " * 15 + str(k), "en", "s0") for k in range(40)]
    base = out[0][1]
    out += [(400, base, "de", "s1"), (401, base + " nachsatz", "de", "s1"), (401, base + " nachsatz", "de", "s1"), (7, out[6][1], "en", "s3")]
    out += [(500, None, "en", "s1"), (501, "", "en", "s1"), (502, "123 456 !!", "en", "s1"), (503, out[1][1], None, None), (None, prose(rng, "en", 40), "en", "s2"), (None, prose(rng, "en", 50), "en", "s2")]
    out += [(504, prose(rng, "en", 30_000), "en", "s2")]
    passage = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo"
    out += [(505, prose(rng, "en", 40) + " " + passage + " " + prose(rng, "en", 40), "en", "s2"), (None, passage, "en", "s2")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{where}/documents.parquet")
    items = [("b1", "Alpha bravo charlie delta echo, foxtrot golf hotel india juliett."), (None, None)]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def listed(df, *columns):
    return sorted([tuple(r) for r in df.select(*(columns or df.columns)).collect()], key=repr)


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_language_stage_judges_each_row_as_the_network_does(spark, docs, rows):
    net = langid.fit(docs.select("doc_id", "text", "lang"))
    kept = []
    for r in rows:
        if langid.has_letter(r[1]):
            p = langid.document_probabilities(net, [r[1].encode()])[0]
            if p.max() >= P.LEAST_LANGUAGE:
                kept.append((r[0], r[1]))
    found = P.language_id(spark, docs, "")
    assert found.schema == docs.schema
    assert listed(found, "doc_id", "text") == sorted(kept, key=repr)
    assert {500, 501, 502}.isdisjoint({k for k, _ in kept}) and len(kept) == len(rows) - 3


def test_quality_stage_judges_each_row_as_the_scorer_does(spark, docs, rows):
    fitted = quality.fit(docs.select("doc_id", "text"))
    kept = sorted([(r[0], r[1]) for r in rows if fitted[1].score(r[1]) >= P.LEAST_QUALITY], key=repr)
    found = P.quality_classifier(spark, docs, "")
    assert listed(found, "doc_id", "text") == kept
    assert not {k for k, _ in kept if k and 300 <= k < 340} and {1, 2, 504} <= {k for k, _ in kept}


def test_near_dedup_stage_keeps_the_smallest_id_of_each_group(spark, docs, rows):
    sets = [(r[0], shingles(r[1])) for r in rows]
    group = {k: k for k, _ in sets if k is not None}

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                group[high] = low
    kept = sorted([(r[0], r[1]) for r in rows if r[0] is None or root(r[0]) == r[0]], key=repr)
    assert listed(P.near_dedup(spark, docs, ""), "doc_id", "text") == kept
    assert {400, 401, 503}.isdisjoint({k for k, _ in kept}) and [k for k, _ in kept].count(7) == 2


def test_decontamination_stage_takes_ids_with_a_window(spark, docs, rows, folder):
    needle = "alpha bravo charlie delta echo foxtrot golf hotel india juliett"
    gone = {r[0] for r in rows if needle in (r[1] or "")}
    assert gone == {505, None}
    assert listed(P.decontamination(spark, docs, folder), "doc_id", "text") == sorted([(r[0], r[1]) for r in rows if r[0] not in gone], key=repr)


def test_mixture_stage_takes_what_the_plan_says(spark, docs, rows):
    found = P.source_mixture(spark, docs, "")
    assert found.columns == [*docs.columns, "copies"]
    size, taken, copies = {}, {}, {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len((r[1] or "").split())
    for r in found.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * len((r["text"] or "").split())
        copies.setdefault(r["doc_id"], set()).add(r["copies"])
        assert 1 <= r["copies"] <= 2
    assert all(len(c) == 1 for c in copies.values())
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, rest = {}, set(order)
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in order if s not in rest)
        target = {s: left * weight[s] / sum(weight[x] for x in rest) if s in rest else 2 * size[s] for s in order}
        over = {s for s in rest if target[s] > 2 * size[s]}
        if not over:
            break
        rest -= over
    # A document goes as a whole, so the sum may miss the target by about the largest of its source.
    for s in order:
        largest = max(len((r[1] or "").split()) for r in rows if r[3] == s)
        assert abs(taken.get(s, 0) - target[s]) <= largest + 100


AWKWARD = ["gone", "hit", "Copies", "a.b", "a`b", "stays", "score", "lang_pred", "votes", "kept", "h", "s", "rounds", "c0", "key", "words"]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_leave_columns_of_any_name_alone(spark, docs, folder, stage, tmp_path):
    few = docs.where("doc_id is null or doc_id < 60 or doc_id > 330 and doc_id <> 504")
    plain = stage(spark, few, folder)
    wide = few.select("*", *[F.concat(F.lit(f"{n}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in AWKWARD])
    found = stage(spark, wide, folder)
    assert found.columns[: len(wide.columns)] == wide.columns
    found.write.parquet(str(tmp_path / "out"))
    names = docs.columns
    assert listed(found.toDF(*names, *[f"x{k}" for k in range(len(found.columns) - len(names))]), *names) == listed(plain, *names)
    for r in found.collect():
        assert r["a`b"] == f"a`b/{'none' if r['doc_id'] is None else r['doc_id']}"


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES], ids=[n for n, _ in P.STAGES])
def test_stages_take_tables_that_are_empty_or_all_null(spark, docs, folder, stage):
    assert stage(spark, docs.limit(0), folder).count() == 0
    blank = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None)], SCHEMA)
    stage(spark, blank, folder).collect()


def test_run_applies_the_stages_in_turn(spark, folder):
    want = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        want = stage(spark, want, folder)
    assert [n for n, _ in P.STAGES] == ["language_id", "quality_classifier", "near_dedup", "decontamination", "source_mixture"]
    assert listed(P.run(spark, folder)) == listed(want)
