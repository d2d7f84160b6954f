import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftline.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
REAL = Tokenizer.from_file(PATH)
OURS = bpe.Encoder(open(PATH, encoding="utf-8").read())


def ids(text):
    import numpy as np

    return np.frombuffer(OURS.encode_batch([text])[0], dtype="<u4").tolist()


CASES = [
    "", " ", "\n\t ", "Hello, World!", "don't they'll I'M we'Ve 's 't", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|END|> <| <",
    "naïve café ÑANDÚ ΑΣ ΌΣΟΣ İstanbul ſtraße", "é ̈x ä", "\x1c\x1d a\x1eb \x1f", "12345 ½ ²", "日本語 テスト 😀😃 👩‍👩‍👧", " a　b\u0085c\xa0d",
    "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 5000, "ab" * 3000, "!" * 1000, "#%%% word&&&", "\x00\x01", "the" * 400,
]


@pytest.mark.parametrize("text", CASES)
def test_known_cases(text):
    want = REAL.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert OURS.decode(OURS.encode_batch([text])[0]) == REAL.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert ids(text) == REAL.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdeilmnorstghv'é -1²Ñİ.\n", max_size=80))
def test_mergeable_text(text):
    assert ids(text) == REAL.encode(text, add_special_tokens=False).ids


def test_every_letter_below_latin_end():
    for letter in map(chr, range(ord(bpe.LATIN_END))):
        for text in (letter, f"{letter}li {letter}{letter} a{letter} 1{letter}"):
            assert ids(text) == REAL.encode(text, add_special_tokens=False).ids, hex(ord(letter))


def test_batches_and_long_texts(monkeypatch):
    texts = ["", "The first. ", None, "thé" * 3000, "a'll b've 're'd", "Ünion " * 4000, "x y", "日本", *(f"word{i} " * (i % 90) for i in range(400))]
    small = bpe.Encoder.__new__(bpe.Encoder)
    small.BLOCK = 1 << 12
    small.__init__(open(PATH, encoding="utf-8").read())
    want = [REAL.encode(t or "", add_special_tokens=False).ids for t in texts]
    for coder in (OURS, small):
        assert [len(b) // 4 for b in coder.encode_batch(texts)] == list(map(len, want))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_that_hash_alike(n):
    from test_jaccard import thue_morse

    texts = [f"z{w}{'c' * 1027}" for w in thue_morse(n)]
    want = [REAL.encode(t, add_special_tokens=False).ids for t in texts]
    for order in (texts, texts[::-1], texts[:1], texts[1:], texts):
        assert [len(b) // 4 for b in OURS.encode_batch(order)] == [len(want[texts.index(t)]) for t in order]
        assert [b"".join(x.to_bytes(4, "little") for x in want[texts.index(t)]) for t in order] == OURS.encode_batch(order)


def merged(words):
    return [OURS.vocabulary.merge(w) for w in words]


def test_every_token_string_again():
    v = OURS.vocabulary
    back = {c: b for b, c in v.letters.items()}
    words = [bytes(back[c] for c in t.removesuffix(v.end)) for t in list(v.ids)[:6000]]
    assert v.encode_words(words) == merged(words)


def test_speculation_fails_sometimes_and_is_mended(monkeypatch):
    v = OURS.vocabulary
    words = [(a + b).encode() for a in ("there", "ing", "tion", "ndth", "hest") for b in ("ation", "erest", "hing", "ndre", "ther")]
    assert v.encode_words(words) == merged(words)
    monkeypatch.setattr(v, "clash", lambda a, b: a < 0)
    assert v.encode_words(words) != merged(words)


def test_operator(spark):
    rows = [(1, "Hello there"), (2, None), (None, ""), (4, "x " * 50_000), (4, "x " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = sorted(map(tuple, bpe.bpe_digest(docs, PATH).collect()), key=str)
    want = []
    for i, text in rows:
        e = REAL.encode(text or "", add_special_tokens=False).ids
        raw = b"".join(x.to_bytes(4, "little") for x in e)
        want.append((i, len(e), hashlib.sha256(raw).hexdigest(), hashlib.sha256(REAL.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    full = bpe.bpe_encode(docs.limit(0), PATH).collect()
    assert full == []
    one = bpe.bpe_encode(docs.filter("doc_id = 1"), PATH).first()
    assert one.ids == REAL.encode("Hello there", add_special_tokens=False).ids and one.decoded.startswith("hello")
