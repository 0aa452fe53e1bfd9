import random
import re

import pytest

from chronocell.llm import winnow
from chronocell.llm.winnow import contamination

DOCS, ITEMS = "doc_id long, text string, words string, h int", "item_id long, text string"


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    out = []
    item_words = {i: words_of(t) for i, t in items}
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for j, iw in item_words.items():
            n = min(window, len(iw))
            if not n:
                continue
            wins = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(j)
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(60)] + ["É", "é", "naïve", "9"]
    items = [(j, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 5, 6, 9, 10, 11, 14, 30])))) for j in range(40)]
    items += [(100, "aa " * 25), (101, None), (102, "-- !!"), (103, items[5][1]), (104, "aa bb " * 9)]
    docs = []
    for i in range(60):
        body = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 30, 80]))]
        for _ in range(rng.randint(0, 3)):
            source = words_of(rng.choice(items)[1])
            if source:
                a = rng.randrange(len(source))
                at = rng.randint(0, len(body))
                body[at:at] = source[a : a + rng.randint(1, 20)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(x.upper() if x.isascii() and rng.random() < 0.2 else x for x in body)))
    docs += [(200, None), (201, ""), (202, "aa " * 40), (203, "aa bb " * 30), (203, "aa bb " * 30), (None, "aa " * 12), (204, "-.-")]
    return docs, items


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_equal_to_brute_force(spark, limit):
    docs, items = corpus(3)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    got = contamination(df, spark.createDataFrame(items, ITEMS), broadcast_bytes=limit).collect()
    assert sorted(((r[0], r[1], r[2], sorted(r[4])) for r in got), key=str) == brute(docs, items)
    for r in got:
        assert r["n_hit"] == len(set().union(*[range(s["start"], s["end"]) for s in r["spans"]], set()))


def test_fingerprint_of_many_items_and_documents(spark, monkeypatch):
    """A passage that most items and documents have: its places in items come in rows of bounded length."""
    passage = " ".join(f"p{k}" for k in range(14))
    docs = [(i, f"d{i} " + passage + f" e{i}", "x", 0) for i in range(60)] + [(100, "clean text " * 20, "x", 0)]
    items = [(f"i{j}", f"j{j} " + passage) for j in range(25)]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string, h string, pos int"), spark.createDataFrame(items, "item_id string, text string")
    want = sorted((r["doc_id"], r["n_hit"], sorted(r["items"])) for r in contamination(docs, items).collect())
    assert want[0] == (0, 14, sorted(f"i{j}" for j in range(25))) and want[-1] == (100, 0, [])
    for n in (1, 4, 64):
        monkeypatch.setattr(winnow, "PLACES_A_ROW", n)
        assert sorted((r["doc_id"], r["n_hit"], sorted(r["items"])) for r in contamination(docs, items, broadcast_bytes=0).collect()) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contamination(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b", "", 0)], DOCS)
    assert [tuple(r)[:3] for r in contamination(some, items).collect()] == [(1, 2, 0)]
    assert contamination(docs, spark.createDataFrame([(1, "a b")], ITEMS)).count() == 0


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_repeated_and_null_item_ids(spark, limit):
    rng = random.Random(8)
    start, tails = [f"s{k}" for k in range(10)], [[f"t{j}x{k}" for k in range(10)] for j in range(6)]
    variants = [" ".join(start + t) for t in tails]
    items = [(7, variants[0]), (7, variants[1]), (7, variants[1]), (None, variants[2]), (None, variants[3]), (8, variants[4]), (None, "n1 n2"), (9, "n1 n2"), (9, "N1, n2")]
    docs = [(j, " ".join(["before", *(start + t)[2:12], "after"])) for j, t in enumerate(tails)]
    docs += [(20, variants[0] + " " + variants[3]), (21, "here n1 n2"), (22, " ".join(start)), (23, " ".join(start[1:]))]
    docs += [(30 + i, " ".join(rng.choice(start + tails[0] + tails[2]) for _ in range(40))) for i in range(5)]
    expected = {}
    for i, t in docs:
        w, hit, found = words_of(t), set(), set()
        for j, text in items:
            iw = words_of(text)
            n = min(10, len(iw))
            for a in range(len(w) - n + 1):
                if any(w[a : a + n] == iw[b : b + n] for b in range(len(iw) - n + 1)):
                    hit |= set(range(a, a + n))
                    found.add(j)
        expected[i] = (len(w), len(hit), sorted(found, key=str))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)
    got = contamination(df, spark.createDataFrame(items, ITEMS), broadcast_bytes=limit).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], sorted(r["items"], key=str)) for r in got} == expected
    assert [expected[i][1] for i in range(6)] == [10, 10, 10, 10, 10, 0] and expected[2][2] == [None] and expected[22][2] == [7, 8, None]


def test_very_long_texts(spark):
    passage = " ".join(f"q{k}" for k in range(12))
    long = " ".join(f"w{k % 977}" for k in range(150_000))
    docs = spark.createDataFrame([(1, f"{long} {passage} {long}"), (2, long)], "doc_id long, text string")
    items = spark.createDataFrame([("i", passage)], "item_id string, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in contamination(docs, items).collect()} == {1: (300_012, 12), 2: (150_000, 0)}
