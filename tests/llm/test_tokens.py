import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from chronocell.llm.tokens import PrefixCounter, prefix_tables, token_counts  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "   b", "a  \n\n x", "it's we'll 've 're 'l '", "''re !'s", "naïve café ñandú ß 你好 🙂 x²½", "word" * 80, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext",
    "x\x1cy\x1d z\xa0 w\u3000", "12345 678,90", "\t\tif x:\n\t\t\treturn  'd", "don't  'S 'lol", "Ꙁ\u0301e\u0301", "a\u2028b \u200b c",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tables():
    return PrefixCounter(PATH)


def noise(rng):
    parts = ["the ", "Ünd", " ", "\n", "'re", "'", "l", "l ", "1", "²", "?!", "ing", "tion ", "é", "🙂", "\t", "<|endoftext|>", "  "]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))


def test_totals_equal_the_library(library, tables):
    rng = random.Random(2)
    for text in TEXTS + [noise(rng) for _ in range(400)]:
        assert tables.count(text) == len(library.encode(text or "", add_special_tokens=False).ids), repr(text)


def test_every_prefix_equals_the_library(library, tables):
    rng = random.Random(3)
    for text in TEXTS + [noise(rng) for _ in range(60)]:
        t = text or ""
        want = [len(library.encode(t[:p], add_special_tokens=False).ids) for p in range(len(t) + 1)]
        assert tables.prefixes(text).tolist() == want, repr(text)


def test_truncation_equals_reencoding(library, tables):
    rng = random.Random(4)
    for _ in range(60):
        text, budget = noise(rng), rng.randint(0, 25)
        fits = [p for p in range(len(text) + 1) if len(library.encode(text[:p], add_special_tokens=False).ids) <= budget]
        assert tables.truncate(text, budget) == fits[-1], (text, budget)


def test_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts(df, PATH, limit=5).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "a b" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 5)
    lengths = {r["doc_id"]: len(r["counts"]) for r in prefix_tables(df.where("doc_id is not null"), PATH).collect()}
    assert lengths == {i: len(t or "") + 1 for i, t in enumerate(TEXTS)}
    assert token_counts(df.limit(0), PATH).count() == 0


def test_very_long_texts(tables, library):
    rng = random.Random(7)
    text = "".join(noise(rng) for _ in range(2500)) + "z" * 20_000
    assert tables.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    cut = tables.truncate(text, 5000)
    assert len(library.encode(text[:cut], add_special_tokens=False).ids) <= 5000 < len(library.encode(text[: cut + 12], add_special_tokens=False).ids)
