import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmere.llm.bpe import ForcedBoundaryBPE, bpe_encode_decode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return ForcedBoundaryBPE(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    mine, theirs = both
    ids, decoded, n = mine.encode(text)
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids == " ".join(map(str, want)), repr(text)
    assert decoded == theirs.decode(want, skip_special_tokens=False)
    assert n == len(want)


@pytest.mark.parametrize("text", ["", " ", "Hello  World's café 123 <|endoftext|>x<|startoftext|>", "naïveİ ẞ ΣΣ é́", "a b c\x1cd\x85e​f", "don't DON'T we'll '''s", "\U0001f600\U0001f468‍\U0001f469 中文 กำ", "<|endoftext|", "x" * 3000, "***$$$ %%%,"])
def test_same_as_library(both, text):
    same(both, text)


def test_every_character(both):
    for start in range(0, 0x30000, 64):
        same(both, "".join(f"a{chr(c)}b {chr(c)} " for c in range(start, start + 64) if not 0xD800 <= c <= 0xDFFF))


def test_random_strings(both):
    rng = random.Random(5)
    for _ in range(300):
        same(both, "".join(rng.choice("abcdefgh tionéßñ'.,!0123456789\n\t*$%<|>") for _ in range(rng.randrange(200))))


def test_cuts_never_change_a_merge(both):
    mine, _ = both
    rng = random.Random(1)
    for _ in range(500):
        word = "".join(rng.choice("etaoinshrdluqxzj") for _ in range(rng.randrange(1, 24)))
        assert mine.word_ids(word) == mine._merge("whole " + word, [*word[:-1], word[-1] + mine.end])


def test_frame(spark, both):
    rows = [(1, "Hello there", "x"), (2, None, None), (3, "", "y"), (1, "Hello there", "x"), (None, "Z" * 50_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe_encode_decode(df, PATH).collect()
    assert len(out) == 5
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.ids_sha256 for r in out if r.doc_id in (2, 3)} == {empty} and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
    assert bpe_encode_decode(df.limit(0), PATH).count() == 0


def test_long_runs_take_no_square_of_time(both):
    import time

    began = time.time()
    for text in ("a" * 1_000_000, "ab" * 200_000, "hahaha" * 50_000):
        same(both, text)
    assert time.time() - began < 90


def test_both_merges_agree(both):
    mine, _ = both
    rng = random.Random(6)
    for n in (1, 2, 3, 10, 47, 48, 49, 200):
        for letters in ("a", "ab", "thein", "etaoinshrdlu"):
            word = [rng.choice(letters) for _ in range(n)]
            word[-1] += mine.end
            assert mine._merge_short(list(word)) == mine._merge_long(list(word))


def test_decodes_from_ids_alone(both):
    mine, theirs = both
    ids = theirs.encode("Hello World, naïve 123!", add_special_tokens=False).ids
    assert mine.decode(" ".join(map(str, ids))) == theirs.decode(ids, skip_special_tokens=False) and mine.decode("") == ""
