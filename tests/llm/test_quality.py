import random
from math import exp
from zlib import crc32

import numpy as np

from chronocell.llm import quality as Q


def texts(seed, n):
    rng = random.Random(seed)
    parts = ["al", "pha", "be", "ta", "gam", "ma", "del", "riv", "er", "sto", "ne", "light", "un", "der", "ov", "walk"]
    words = [a + b for a in parts for b in parts]  # prose repeats words, but not most of them
    out = []
    for i in range(n):
        body = [rng.choice(words) + rng.choice(["", "", "", ",", "."]) for _ in range(rng.randint(30, 200))]
        kind = rng.choice(["good"] * 5 + ["marks", "caps", "echo"])
        if kind == "marks":
            body = [w + rng.choice(["***", "&&&", "%%%"]) for w in body]
        elif kind == "caps":
            body = [w.upper() + "!!" for w in body]
        elif kind == "echo":
            body = [body[0]] * len(body)
        out.append((i, " ".join(body), kind == "good"))
    return out


def test_accuracies_are_recovered_without_labels():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8, 0.75]
    votes = [np.where(rng.random(len(truth)) < 0.2, 0, np.where((rng.random(len(truth)) < a) == truth, 1, 2)) for a in accuracy]
    patterns, counts = np.unique(["".join(map(str, v)) for v in zip(*votes, strict=True)], return_counts=True)
    model = Q.fit_labels(list(patterns), counts.tolist())
    assert abs(model.prior - 0.8) < 0.05 and np.abs(model.accuracies - accuracy).max() < 0.05


def test_held_out_texts_and_defined_cases(spark):
    rows = texts(1, 1500)
    edge = [(9001, None), (9002, ""), (9003, " \n"), (None, "alpha beta under the river."), (9004, "Short and clean."), (9004, "Short and clean.")]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(*e, "y") for e in edge], "doc_id long, text string, score string")
    fitted = Q.fit(df.where("doc_id < 1000"), sample=500)
    got = {r["doc_id"]: r for r in Q.classify(df, fitted=fitted).collect()}
    out = [(got[i]["kept"], good) for i, _, good in rows if i >= 1000]
    assert sum(k == g for k, g in out) >= 0.98 * len(out)
    assert [(got[i]["score"], got[i]["kept"], got[i]["weak_label"], got[i]["votes"]) for i in (9001, 9002, 9003)] == [(0.0, False, None, None)] * 3
    assert got[None]["kept"] and got[9004]["kept"]


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None), (2, " ")], "doc_id long, text string")
    assert [r["kept"] for r in Q.classify(df).collect()] == [False, False]
    assert Q.classify(df.limit(0)).count() == 0


def slow_score(scorer, text):
    """A text's score, gram by gram; statistics as the labellers take them."""
    stats = Q.statistics(text)
    if not stats["words"]:
        return 0.0
    data, total, n = text.encode(), 0.0, 0
    for k in range(len(data) - Q.GRAM + 1):
        h = 0
        for j, byte in enumerate(data[k : k + Q.GRAM]):
            h = byte if not j else (h * 0x9E3779B1 + byte) % 2**32
        total += float(scorer.weights[h * 0x85EBCA6B % 2**32 >> 20])
        n += 1
    named = sum(float(scorer.weights[crc32(f"{k.name}={min(int(stats[k.name] / k.bad * 3), 4)}".encode()) % Q.DIMENSIONS]) for k in Q.LABELLERS)
    return 1 / (1 + exp(-(float(scorer.bias) + named + (Q.SCALE * total / n if n else 0.0))))


def slow_votes(text):
    stats = Q.statistics(text)
    if not stats["words"]:
        return None
    return "".join("0" if stats["words"] < k.words else "2" if stats[k.name] >= k.bad else "1" if stats[k.name] <= k.good else "0" for k in Q.LABELLERS)


def test_whole_output_equals_a_slow_scorer(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.choice([3, 30, 200])))) for i in range(120)]
    rows += [(i, "$$ BUY !! NOW ## " * rng.randint(1, 30) + str(i)) for i in range(200, 240)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "a"), (None, rows[0][1]), (None, None), (3, rows[3][1]), (304, "очень длинное слово " * 30), (305, "long prose of few words " * 9000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, votes string")
    model, scorer = fitted = Q.fit(df.select("doc_id", "text"))
    got = sorted([tuple(r) for r in Q.classify(df, fitted=fitted).collect()], key=repr)
    want = []
    for key, text in rows:
        votes, score = slow_votes(text), slow_score(scorer, text)
        label = None
        if votes:
            odds = model.prior / (1 - model.prior)
            for k, v in enumerate(votes):
                if v != "0":
                    odds *= model.said[0, k, int(v)] / model.said[1, k, int(v)]
            label = odds / (1 + odds)
        want.append((key, votes, label, score, score >= 0.5))
    want.sort(key=repr)
    assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[3] - w[3]) < 1e-4 and (g[2] is None) == (w[2] is None) and (w[2] is None or abs(g[2] - w[2]) < 1e-6)
    assert Q.classify(df.limit(0)).count() == 0


def test_the_sample_is_bounded_whatever_the_ids(spark):
    # Rows of one id, and rows of one text: both once brought all or none to the driver.
    same_id = spark.range(4000).selectExpr("cast(null as long) AS doc_id", "concat('some words of text number ', id) AS text")
    assert len(Q.training_rows(same_id, 100)[0]) == 100
    same_text = spark.range(4000).selectExpr("id AS doc_id", "'one and the same text' AS text")
    assert len(Q.training_rows(same_text, 100)[0]) == 1


def test_length_is_in_characters_and_sameness_by_stretches():
    russian = Q.statistics("небольшие слова этого текста обычной длины для языка и страны")
    assert russian["length"] < 7
    rng = random.Random(1)
    words = [f"w{rng.randrange(300)}" for _ in range(20_000)]
    assert Q.statistics(" ".join(words))["sameness"] < 0.5 < 1 - len(set(words)) / len(words)
    assert Q.statistics("again and again " * 4000)["sameness"] > 0.9
