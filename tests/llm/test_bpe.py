import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from chronocell.llm import bpe, queries  # noqa: E402
from chronocell.sources.tables import table  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "   b", "a  \n\n x", "it's we'll 've 're 'l '", "''re !'s", "naïve café ñandú ß 你好 🙂 x²½", "word" * 80, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|", "<|endoftext",
    "x\x1cy\x1d z\xa0 w\u3000", "12345 678,90", "\t\tif x:\n\t\t\treturn  'd", "don't  'S 'lol", "Ꙁ\u0301e\u0301", "a\u2028b \u200b c", "\x00\x01\x7f\ufffd\U0010ffff",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(PATH)


def noise(rng, n=40):
    parts = ["the ", "Ünd", " ", "\n", "'re", "'", "l", "l ", "1", "²", "?!", "ing", "tion ", "é", "🙂", "\t", "<|endoftext|>", "  ", "aaaa", "=="]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))


def unpacked(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_tokens_and_texts_equal_the_library(library, own):
    rng = random.Random(2)
    for text in TEXTS + [noise(rng) for _ in range(600)]:
        want = library.encode(text or "", add_special_tokens=False).ids
        ids = own.encode(text)
        assert unpacked(ids) == want, repr(text)
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False) == (text or "")


def test_tokens_that_are_no_text_decode_as_the_library(library, own):
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(50257), rng.randrange(256), 50256]) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False), ids


def test_both_forms_of_a_word_agree(own, library):
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("aabeinst") for _ in range(rng.randint(1, 200))).encode()
        assert own._scanned(word) == own._heaped(word) == library.encode(word.decode(), add_special_tokens=False).ids


def test_very_long_texts_and_words(library, own):
    rng = random.Random(5)
    for text in ("a" * 60_000, "ab" * 20_000 + " " * 3000 + "é" * 5000, "".join(noise(rng) for _ in range(3000))):
        assert unpacked(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(own.encode(text)) == text


def test_what_a_worker_remembers_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    own, rng = bpe.Codec(PATH), random.Random(6)
    for _ in range(50):
        text = noise(rng)
        assert unpacked(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
        assert len(own._known) <= 5


def test_table(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "y"), (None, "a b", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    tokens = bpe.encoded(df, PATH)
    got = tokens.select("*", bpe.n_tokens(F.col("ids")).alias("n"), bpe.token_at(F.col("ids"), F.lit(1)).alias("second"))
    assert got.count() == len(rows)
    for r in got.collect():
        want = library.encode("a b" if r["doc_id"] is None else TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (unpacked(r["ids"]), r["n"], r["second"]) == (want, len(want), want[1] if len(want) > 1 else None)
    back = {r["doc_id"]: r["text"] for r in bpe.decoded(tokens.where("doc_id is not null"), PATH).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).first()["text"] == ""
    assert bpe.round_trip(df.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    got = queries.op11_bpe_codec(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
