import random
import zlib

import numpy as np
import pytest

from chronocell.llm import langid as L

WORDS = {"aa": ["the", "ing", "and", "of", "was"], "bb": ["der", "und", "ßich", "für", "keit"], "cc": ["ción", "que", "ñor", "los", "está"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(i, sentence(rng, lang, rng.choice([3, 10, 60])), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(900))]


def test_gradients_follow_finite_differences():
    rng = np.random.default_rng(3)
    net = L.Network.fresh(["a", "b", "c"], hidden=4)
    for p in net.parameters():
        p *= np.float32(0.3)
    net.forward.x[0] += np.float32(0.3)
    x = rng.integers(97, 101, (7, 5)).astype(np.uint8)
    x[5:, 2] = L.PAD
    y = np.array([0, 1, 2, 1, 0])
    grads = net.gradients(x, y)[1]
    for p, g in zip(net.parameters(), grads, strict=True):
        flat = p.reshape(-1)
        for k in np.argsort(-np.abs(g).ravel())[:3]:
            old, step = flat[k], np.float32(2e-3)
            flat[k] = old + step
            up = net.gradients(x, y)[0]
            flat[k] = old - step
            down = net.gradients(x, y)[0]
            flat[k] = old
            assert abs((up - down) / (2 * step) - g.ravel()[k]) < 2e-3 + 0.05 * abs(g.ravel()[k])


def test_filling_and_batching_change_nothing():
    net = L.Network.fresh(["a", "b"], hidden=4)
    texts = [b"short", b"x" * 300, "é".encode() * 200, b"", b"short"]
    together = L.document_probabilities(net, texts)
    for t, p in zip(texts, together, strict=True):
        assert np.allclose(L.document_probabilities(net, [t])[0], p, atol=1e-5)
    assert not together[3].any() and np.allclose(together[[0, 1, 2, 4]].sum(axis=1), 1, atol=1e-4)
    assert len(L.position_labels(net, "é" * 100)) == 200


def test_held_out_accuracy_and_defined_cases(spark, rows):
    edge = [(10_000, None, "aa"), (10_001, "", "aa"), (10_002, "123 !? ²", "bb"), (10_003, sentence(random.Random(9), "cc", 5), None), (None, "the and of", "zz"), (10_003, sentence(random.Random(9), "cc", 5), None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + edge], "doc_id long, text string, lang string, score string")
    got = L.identify(df).collect()
    assert len(got) == len(rows) + len(edge)
    truth = {i: lang for i, _, lang in rows}
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 150 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) > 0.97 * len(out)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (10_000, 10_001, 10_002, 10_003)] == ["und", "und", "und", "cc"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words here", None), (2, None, "aa")], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in L.identify(df).collect()] == [("und", 0.0)] * 2
    assert L.identify(df.limit(0)).count() == 0


def test_every_language_is_learned_however_many(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L.Network, "train", lambda self, windows, y, steps, rate, held: seen.append((self.labels, self.v.shape[0] // 2, steps, sorted(set(y.tolist())))) or 0.0)
    for n in (3, 100):
        L.fit(spark.createDataFrame([(i, "some words", f"l{i % n:02d}") for i in range(40 * n)], "doc_id long, text string, lang string"))
    assert [s[0] for s in seen] == [[f"l{k:02d}" for k in range(n)] for n in (3, 100)]
    assert [s[1:] for s in seen] == [(8, 300, [0, 1, 2]), (40, 7500, list(range(100)))]


def test_batches_in_parts_have_the_same_gradients(monkeypatch):
    rng = np.random.default_rng(5)
    net = L.Network.fresh(["a", "b", "c"], hidden=4)
    x, y = rng.integers(97, 120, (9, 10)).astype(np.uint8), rng.integers(0, 3, 10)
    x[4:, 3] = L.PAD
    whole = net.gradients(x, y)
    monkeypatch.setattr(L, "CELLS", 9 * 3 * 4)
    parts = net.batch_gradients(x, y)
    assert abs(whole[0] - parts[0]) < 1e-5 and all(np.allclose(a, b, atol=1e-5) for a, b in zip(whole[1], parts[1], strict=True))


def slow_probabilities(net, text):
    """Mean label probabilities of a text, byte by byte and unit by unit."""
    data, sums = text.encode(), np.zeros(len(net.labels))
    squash = lambda v, low: np.minimum(np.maximum(v, low), 1)
    for at in range(0, len(data), L.WINDOW):
        part = data[at : at + L.WINDOW]
        states = []
        for layer, read in ((net.forward, part), (net.backward, part[::-1])):
            h, seen = np.zeros(len(layer.u[0])), []
            for byte in read:
                z = squash(layer.x[0][byte] + h @ layer.u[0], 0)
                r = squash(layer.x[1][byte] + h @ layer.u[1], 0)
                h = h + z * (squash(layer.x[2][byte] + (r * h) @ layer.u[2], -1) - h)
                seen.append(h)
            states.append(seen)
        for ahead, back in zip(states[0], states[1][::-1], strict=True):
            e = np.exp((scores := np.concatenate([ahead, back]) @ net.v + net.bias) - scores.max())
            sums += e / e.sum()
    return sums / max(1, len(data))


def test_whole_output_equals_a_slow_forward_pass(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, lang, rng.choice([1, 4, 70])), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(150))]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 !?", "bb"), (503, "x", None), (None, rows[0][1], None), (None, None, None), (504, sentence(rng, "cc", 4000), "cc")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, lang string, score string")
    net = L.fit(df.select("doc_id", "text", "lang"), steps=60)
    got = sorted([tuple(r) for r in L.identify(df, net).collect()], key=repr)
    want = []
    for key, text, _ in rows:
        held = zlib.crc32(b"" if key is None else str(key).encode()) % 4 == 2
        if not L.has_letter(text):
            want.append((key, held, "und", 0.0))
            continue
        p = slow_probabilities(net, text)
        want.append((key, held, net.labels[int(p.argmax())], float(p.max())))
    want.sort(key=repr)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-3)


@pytest.mark.parametrize("n", [200, 1000, 10_000])
def test_uneven_languages_are_told_apart_at_every_size(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(n):
        lang = "aa" if rng.random() < 0.6 else "bb" if rng.random() < 0.8 else "cc"
        rows.append((i, sentence(rng, lang, rng.choice([5, 20, 60])), lang))
    got = L.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
    right = [r["lang_pred"] == rows[r["doc_id"]][2] for r in got]
    assert len(right) > n / 6 and sum(right) >= 0.97 * len(right)


def test_sampling_is_by_text_not_by_id(spark):
    rng = random.Random(2)
    texts = [(sentence(rng, lang, 20), lang) for lang in WORDS for _ in range(300)]
    rows = [(None, t, lang) for t, lang in texts] + [(None, texts[0][0], "aa")] * 3000
    labels, windows, y, _ = L.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 50, 6, 64)
    assert labels == sorted(WORDS) and np.bincount(y).tolist() == [300] * 3 and windows.shape == (900, 64)


def test_every_language_is_a_label(spark):
    rows = [(i, f"{chr(0x4E00 + i % 70)}{chr(0x4E00 + i % 70)} words", f"l{i % 70:02d}") for i in range(700)]
    labels = L.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 600, 6, 64)[0]
    assert len(labels) == 70


def test_train_keeps_the_best_weights():
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 123, (64, 16)).astype(np.uint8)
    windows[:32, ::2] = 65
    y = np.repeat([0, 1], 32)
    net = L.Network.fresh(["a", "b"], hidden=4)
    least = net.train(windows, y, steps=100, batch=32, rate=5.0)
    assert least <= np.log(2) * 1.2 and abs(net.loss(windows, y) - least) < 1e-6
