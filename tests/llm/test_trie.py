import hashlib
import random
import zlib

import pytest

from chronocell.llm import ordered, queries, trie
from chronocell.sources.tables import table


def nodes_of(rows):
    """The contract of the query by plain dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: (*x[:2], x[2][:64], x[3][:64], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()))] for c, v in own.items()}
    whole = {}
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns.get(c - c % 5, [])[:h] + mine[h:])
    members = {}
    for c, said in whole.items():
        for d in range(len(said) + 1):
            members.setdefault(said[:d], []).append(c)
    children, sums = {}, {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    for key in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children.get(key, [])]
        saved = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        sums[key] = sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below)
    out = set()
    for key, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(whole[c]) == len(key))
        above = min(members[key[:-1]]) if key else None
        out.add((min(own), len(key), above, len(own), len(children.get(key, [])), *sums[key], hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, depth string, parent int")


def found(frame):
    got = [tuple(r) for r in trie.prefix_trie(frame).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(rng, convs, longest):
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c * rng.choice([1, 1, 3]), rng.choice([turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, "longer text"])))
    return rows


@pytest.mark.parametrize("chunk", [1, 1024])
def test_nodes_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = corpus(rng, 40, 6)
    # One long conversation, copies of it, and one that leaves it late.
    long = [("user" if k % 2 == 0 else "assistant", f"t{k % 4}") for k in range(30)]
    for c in (100, 101, 102, 103, 110):
        rows += [(c, k, *t) for k, t in enumerate(long)]
    rows += [(111, k, *t) for k, t in enumerate(long[:20] + [("user", "away")])]
    rows += [(None, 0, "user", "of none"), (500, 0, "user", "same"), (500, 0, "user", "same"), (502, 0, "u" * 100 + "1", "x" * 70 + "1"), (502, 0, "u" * 100 + "2", "x" * 70 + "2")]
    rng.shuffle(rows)
    assert found(as_frame(spark, rows)) == nodes_of(rows)


def test_caterpillar_of_light_paths(spark, monkeypatch):
    """Each conversation leaves the one before a turn later: one heavy path and a light one at every node."""
    monkeypatch.setattr(ordered, "CHUNK", 4)
    monkeypatch.setattr(trie, "MOST", 1)
    rows = []
    for c in range(12):
        rows += [(c, k, "user", f"t{k}") for k in range(c)] + [(c, c, "user", f"away {c}")]
    got = found(as_frame(spark, rows))
    monkeypatch.setattr(zlib, "crc32", lambda b: 0)
    assert got == nodes_of(rows)


def test_long_texts_and_empty_tables(spark):
    rows = [(5, 0, "user", "é" * 400_000), (6, 0, "user", "é" * 400_000), (7, 0, None, None)]
    frame = as_frame(spark, rows)
    assert found(frame) == nodes_of(rows)
    assert found(frame.limit(0)) == set()
    assert found(frame.where("conv_id = 7")) == nodes_of(rows[2:])


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf, "conversations").collect()]
    assert {tuple(r) for r in queries.op13_prefix_trie(spark, sf).collect()} == nodes_of(rows)
