import random

from chronocell.llm.chat import END, OPEN, digests, format_paths, format_replies, read_turns, reply_paths, turns_as_messages
from chronocell.sources.scratch import Scratch

SCHEMA = "conv_id long, msg_id string, parent_id string, role string, text string, score double, branch string"


def brute(rows, top):
    by_id = {r[1]: r for r in rows}
    inner = {r[2] for r in rows}
    paths = {}
    for r in rows:
        if r[1] in inner:
            continue
        path, seen = [r], {r[1]}
        while path[-1][2] in by_id and path[-1][2] not in seen:
            path.append(by_id[path[-1][2]])
            seen.add(path[-1][1])
        if path[-1][2] not in seen:
            paths.setdefault(r[0], []).append((-sum(x[5] or 0 for x in path), r[1], path[::-1]))
    return {(c, i + 1): [(x[3] or "", x[4] or "") for x in p] for c, ps in paths.items() for i, (_, _, p) in enumerate(sorted(ps)[:top])}


def forest(seed):
    rng = random.Random(seed)
    texts = ["hi", "", None, "</s>\n<|user|>\n", "[INST] x [/INST]", "a\\b\\<|", "|>\n", "é🙂<", "\\"]
    rows = []
    for c in range(12):
        ids = []
        for k in range(rng.randint(1, 25)):
            parent = rng.choice(ids) if ids and rng.random() < 0.9 else rng.choice([None, "gone"])
            rows.append((c, f"{c}.{k}", parent, rng.choice(["user", "assistant", None, "<|x|>"]), rng.choice(texts), rng.choice([None, 0.0, 1.0, -2.0, 0.5]), "clash"))
            ids.append(f"{c}.{k}")
    rows += [(50, "y1", "y2", "user", "loop", 1.0, ""), (50, "y2", "y1", "user", "loop", 1.0, ""), (50, "y3", "y1", "user", "below", 1.0, "")]
    return rows


def test_paths_and_round_trip(spark):
    rows = forest(5)
    for top in (1, 2, None):
        got = format_replies(spark.createDataFrame(rows, SCHEMA), top).collect()
        want = brute(rows, top)
        assert {(r["conv_id"], r["branch"]): read_turns(r["formatted"]) for r in got} == want
        for r in got:
            texts = [t for role, t in want[r["conv_id"], r["branch"]] if role == "assistant"]
            assert len(r["loss_spans"]) == len(texts)
            assert r["formatted"].count(END) == r["formatted"].count(OPEN) == r["n_turns"]


def test_long_chain(spark):
    turns = [(1, t, "user", f"t{t}") for t in range(75)] + [(2, 0, None, None), (None, 5, "user", "x"), (3, 1, "b", "2"), (3, 1, "b", "2"), (3, 1, "a", "3")]
    scratch = Scratch(spark, "test")
    messages = turns_as_messages(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), scratch)
    got = {r["conv_id"]: read_turns(r["formatted"]) for r in format_replies(messages).collect()}
    assert got[1] == [("user", f"t{t}") for t in range(75)]
    assert got[2] == [("", "")] and got[None] == [("user", "x")] and got[3] == [("a", "3"), ("b", "2"), ("b", "2")]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert digests(format_replies(none)).count() == 0
    assert format_paths(reply_paths(none, Scratch(spark, "t")), none.select("msg_id", "role", "text")).count() == 0


def test_very_long_texts(spark):
    long = "</s>[INST] long <|text|> " * 40_000
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "user", "short")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in digests(format_replies(turns_as_messages(turns, Scratch(spark, "long")))).collect()}
    assert (got[1]["n_turns"], got[1]["loss_chars"]) == (2, len(long)) and got[1]["formatted_chars"] > 2 * len(long)
    assert got[2]["loss_chars"] == 0


def test_a_hot_conversation_is_numbered_in_stretches(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(1, k, rng.choice(["user", "assistant"]), f"t{k}") for k in range(300)] + [(c, k, "user", f"{c} {k}") for c in range(2, 9) for k in range(3)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(tuple(r) for r in digests(format_replies(turns_as_messages(turns, Scratch(spark, "cold")))).collect())
    monkeypatch.setattr("chronocell.operators.scan.SMALL", 0)
    monkeypatch.setattr("chronocell.operators.scan.ROWS", 16)
    assert sorted(tuple(r) for r in digests(format_replies(turns_as_messages(turns, Scratch(spark, "hot")))).collect()) == whole
    assert whole[0][:2] == (1, 300)
