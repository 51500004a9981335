"""Exactness of tree concatenation, whatever the leaf and the text."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marlstone.llm import tokens

PATH = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"
REFERENCE = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
REFERENCE.encode_special_tokens = True


def plain(texts):
    """The same vocabulary by the other library, each text in one piece."""
    return [e.ids for e in REFERENCE.encode_batch(texts, add_special_tokens=False)]


def encode(texts, leaf, start):
    enc = tokens.TreeEncoder(PATH, leaf, start)
    return [list(map(int, enc.encode(t))) for t in texts]


TEXTS = [
    "", " ", "a", "a" * 3000, "ab" * 2000, " " * 2500 + "x", "'" * 1500, "日本語テキスト" * 400, "😀👍🏽" * 500, "don'tll've " * 400, "AAAAAAAAaaaaaa" * 200, "<|endoftext|> is text", "1234567890" * 300, "\n\n\t \r\n" * 300,
    "é́" * 700,
]


@pytest.mark.parametrize("leaf,start", [(2, 1), (3, 4), (17, 1), (100, 16), (4096, 16)])
def test_fixed(leaf, start):
    assert encode(TEXTS, leaf, start) == plain(TEXTS)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'lvredst\n\t1é日😀-."), max_size=300), st.integers(2, 40), st.integers(1, 8))
def test_random(text, leaf, start):
    assert encode([text], leaf, start) == plain([text])


def test_corpus(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("etaoin shrdlu'\n") for _ in range(20000))
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (4, long, "w"), (5, "hello world", "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = sorted((d, plain([t or ""])[0]) for d, t, _ in rows)
    for spread in (4_000_000, 5000, 600):  # in one task, and cut over many, joined in more than one level
        got = sorted((r["doc_id"], list(r["ids"])) for r in tokens.encode_corpus(df, leaf_chars=512, spread_chars=spread).collect())
        assert got == want
    assert tokens.encode_corpus(df.limit(0)).count() == 0
    assert [r["n_tokens"] for r in tokens.token_counts(df, ["doc_id"]).orderBy("doc_id", "n_tokens").collect()] == [2, 2, 0, 0, len(plain([long])[0]), 2]
