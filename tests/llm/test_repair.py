import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from chronocell.llm import ordered, queries, repair
from chronocell.sources.tables import table

BLANKS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def in_order(rows):
    def key(r):
        digest = hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()
        return r[1] is not None, r[1] or 0, r[2][:64], r[3][:64], digest

    return sorted(rows, key=key)


def faults_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(BLANKS)
        out.append("b" if not bare else "d" if (role, text) in seen else "." if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    return out


def cheapest(rows, faults):
    """The least cost and the ASCII-least audit by a search over all ways, forward."""
    best = {(0, ""): (0, "", ())}  # (rows done, initials so far up to what matters) -> cost, audit, turns

    def better(a, b):
        return b is None or a[:2] < b[:2]

    def spread(front):
        # Insertions: at most three in a row are ever of use.
        for _ in range(3):
            for (i, end), (cost, audit, turns) in list(front.items()):
                for name in ("user", "assistant"):
                    if (nxt := follow(end, name[0])) is not None:
                        new = (cost + 2, audit + "I", (*turns, (name, "")))
                        if better(new, front.get((i, nxt))):
                            front[(i, nxt)] = new
        return front

    def follow(end, initial):
        return {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}[end].get(initial)

    front = spread(best)
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for (i, end), (cost, audit, turns) in front.items():
            ways = [(end, 3, "D", ())]
            if fault not in "bd":
                stay = fault == "t"
                ways += [(follow(end, role[:1]), stay, "K", ((role, text),))]
                ways += [(follow(end, name[0]), 2 + stay, "R", ((name, text),)) for name in ("user", "assistant")]
            for nxt, more, letter, turn in ways:
                if nxt is not None:
                    new = (cost + more, audit + letter, (*turns, *turn))
                    if better(new, after.get((i + 1, nxt))):
                        after[(i + 1, nxt)] = new
        front = spread(after)
    return min(v for (_, end), v in front.items() if end in ("", "a"))


def report(rows):
    rows = in_order(rows)
    faults = faults_of(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, out = cheapest(rows, faults)
    pairs = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    said = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *[faults.count(f) for f in "bdt"], pairs, cost, audit, said


def reports(rows):
    convs = {r[0] for r in rows}
    hurt = damage(rows)
    return {c: report([r for r in hurt if r[0] == c]) for c in convs}


def as_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, place string, chunk int")


def found(frame):
    got = repair.repair_reports(repair.damaged(frame)).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def corpus(rng, convs, longest, ids=range(1, 10_000)):
    rows = []
    for c in rng.sample(list(ids), convs):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "ü"])
            text = rng.choice(["Fine.", "no end", "", " \t", None, "What? \n", "ok!", f"{c} {turn}.", "x" * rng.randint(1, 300) + "."])
            rows.append((c, rng.choice([turn, turn, turn, None, turn // 2]), role, text))
    return rows


def test_search_of_the_test_itself():
    """Against every sequence of edits of short conversations."""
    rng = random.Random(1)
    for _ in range(40):
        rows = in_order([(1, t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", "c!"])) for t in range(rng.randint(0, 3))])
        faults = faults_of(rows)
        best = None
        for n in range(len(rows), len(rows) + 4):
            for letters in product("DIKR", repeat=n):
                if len(letters) - letters.count("I") != len(rows):
                    continue
                for cost, names in spelled("".join(letters), rows, faults):
                    if re.fullmatch("(s?(ua)+)?", names) and (best is None or (cost, "".join(letters)) < best):
                        best = cost, "".join(letters)
        assert cheapest(rows, faults)[:2] == best


def spelled(letters, rows, faults):
    ways = [(0, "")]
    left = iter(zip(rows, faults, strict=True))
    for letter in letters:
        if letter == "I":
            ways = [(c + 2, n + x) for c, n in ways for x in "ua"]
            continue
        (_, _, role, _), fault = next(left)
        stay = int(fault == "t")
        if letter == "D":
            ways = [(c + 3, n) for c, n in ways]
        elif fault in "bd":
            return []
        elif letter == "K":
            ways = [(c + stay, n + role[:1]) for c, n in ways]
        else:
            ways = [(c + 2 + stay, n + x) for c, n in ways for x in "ua"]
    return ways


@pytest.mark.parametrize("chunk", [1, 3, 1024])
def test_reports_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ordered, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = corpus(rng, 25, 9) + corpus(rng, 1, 60, [20_001]) + [(None, 0, "user", "Hi."), (None, None, None, None)]
    rows += [(7, 1, "user", "Same.")] * 5 + [(8, None, "user", "Same.")] * 3
    rng.shuffle(rows)
    assert found(as_frame(spark, rows)) == reports(rows)


def test_conversation_that_goes_altogether(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = found(as_frame(spark, [(gone, 0, "user", "Hi.")]))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_empty_table_and_long_text(spark):
    frame = as_frame(spark, [(1, 5, "user", "word " * 200_000 + "."), (1, 6, "assistant", "é" * 300_000)])
    assert found(frame) == reports([tuple(r)[:4] for r in frame.collect()])
    assert repair.repair_reports(repair.damaged(frame.limit(0))).count() == 0


def test_turns_are_what_the_digest_is_of(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CHUNK", 4)
    rows = corpus(random.Random(9), 6, 20)
    frame = repair.damaged(as_frame(spark, rows))
    turns = repair.repaired_turns(frame).orderBy("conv_id", "chunk", "place").collect()
    for conv, *_, want in ((c, *v) for c, v in reports(rows).items()):
        said = "\n".join(f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == conv)
        assert hashlib.sha256(said.encode()).hexdigest() == want


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf, "conversations").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_structure_repair(spark, sf).collect()}
    assert got == reports(rows)
