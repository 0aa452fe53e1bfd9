import random
from collections import Counter
from math import exp, isclose, log

import numpy as np

from chronocell.llm import urls as U


def parts(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(x.lower() if "A" <= x <= "Z" else x for x in host), path


def rule(host, path):
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


def test_host_path_and_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Org", "http://a.ORG/", "x://É.Com/fr/\n?q", "a://b://c.org/x", "http://example.org/en/12#f", "http://example.org/es/", "http://notexample.org/es/1", "http://my.example.org/es/?x", "http://com/de/", "http://a.com?x/fr/", "http://acom/de/", "http://u@h.com:80/fr/"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in U.filter_urls(df).collect()}
    for i, u in enumerate(urls):
        host, path = parts(u)
        r = rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, r and r.text), u
        assert r is None or got[i]["verdict"] == ("allow" if r.allow else "block")


def test_model_equals_a_plain_one():
    rng = random.Random(1)
    texts = ["http://" + "".join(rng.choice("ab/.1Z%é") for _ in range(rng.randint(0, 12))) for _ in range(40)]
    codes, lengths = U.grams(texts + [None, ""])
    assert lengths.tolist() == [len(t.encode()) for t in texts] + [0, 0]
    logs = U.log_probabilities(np.bincount(codes, minlength=U.BASE ** (U.ORDER + 1)))
    seqs = [[0] * U.ORDER + [int(U._SYMBOL[b]) for b in t.encode()] for t in texts]
    counts = Counter((tuple(s[i - k : i]), s[i]) for s in seqs for i in range(U.ORDER, len(s)) for k in range(U.ORDER + 1))

    def p(context, c):
        lower = p(context[1:], c) if context else 1 / U.LETTERS
        seen = {d: n for (x, d), n in counts.items() if x == context}
        return (seen.get(c, 0) + len(seen) * lower) / (sum(seen.values()) + len(seen)) if seen else lower

    for context, c in list(counts)[:60]:
        if len(context) == U.ORDER:
            code = 0
            for x in (*context, c):
                code = code * U.BASE + x
            assert isclose(exp(logs[code]), p(context, c), rel_tol=1e-4)
    # A context never seen falls back, and characters after one sum to 1.
    row = np.exp(logs.reshape(-1, U.BASE)[12345].astype(float))
    assert isclose(row.sum(), 1.0, rel_tol=1e-4)


def test_verdicts_follow_the_models(spark):
    rng = random.Random(7)
    good, bad = ["garden", "school", "library"], ["casino", "pillz", "xxfree"]
    rows = []
    for i in range(600):
        kind = rng.random() < 0.5
        word = "".join(rng.choice(good if kind else bad) for _ in range(2))
        rows.append((i, f"http://{word}{i}.example.com/{'fr' if kind else 'de'}/{word}"))
    rows += [(1000 + i, f"http://{rng.choice(good if i % 2 else bad)}{i}.test.net/p/{rng.choice(good if i % 2 else bad)}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.filter_urls(df).collect()}
    right = sum(got[1000 + i] == ("allow" if i % 2 else "block") for i in range(200))
    assert right >= 190


def test_calibration_and_edges(spark):
    scored = spark.createDataFrame([(-3.0, False), (-1.0, False), (0.5, True), (2.0, True), (9.0, True)], "score double, allow boolean")
    assert -1.0 < U.calibrate(scored) <= 0.5
    assert U.calibrate(scored.where("allow")) == 0.0
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(none).count() == 0
    twice = spark.createDataFrame([(1, "http://q.net/"), (1, "http://q.net/"), (None, None)], "page_id long, url string")
    assert sorted(r["verdict"] for r in U.filter_urls(twice).collect()) == ["allow"] * 3
    assert log(1) == 0
