import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tablecraft.llm.rank_bpe import Bpe, decode, encode, token_digests

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return Bpe(f.read(), memory=50)


PIECES = st.sampled_from(
    ["the", " The", "'s", "'LL", " ", "  ", "\n", "\r\n", "\t", "\xa0", " ", "　", "\x85", "\x1c", "\x1f", "é", "ß", "日本", "😀", "12", " 3", "²",
     "_", "--", "<|endoftext|>", "<|end", "á", "​", "Ⅻ", "x" * 70])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=14).map("".join))
def test_ids_and_decoding_are_those_of_the_library(library, bpe, text):
    expected = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode(text) == expected
    assert bpe.decode(expected) == library.decode(expected, skip_special_tokens=False) == text


def test_long_words_take_the_heap(library, bpe):
    rng = random.Random(1)
    for letters in ("ab", "etaoin", "e", "0123456789", "-=", "é日"):
        word = "".join(rng.choice(letters) for _ in range(3000))
        assert bpe.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_broken_bytes_decode_to_marks(library, bpe):
    ids = [i for i in range(0, 50257, 977)]
    assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_odd_rows(odd_documents, no_documents, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = odd_documents.select("doc_id", "text").collect()
    found = sorted(map(tuple, token_digests(odd_documents).collect()), key=str)
    expected = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(text or "")))
    assert found == sorted(expected, key=str)
    assert token_digests(no_documents).count() == 0
    wide = decode(encode(odd_documents), text="back")
    assert wide.columns == [*odd_documents.columns, "ids", "back"]
    for row in wide.collect():
        assert row["back"] == (row["text"] or "")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(PIECES, max_size=14).map("".join)), max_size=6))
def test_parts_of_a_batch_make_whole_texts(library, bpe, texts):
    found = []
    for first, last, ids, tokens, backs in bpe.whole_texts(pa.array(texts, pa.string())):
        assert last - first == len(ids) == len(tokens) == len(backs)
        found += zip(ids, tokens.tolist(), backs)
    expected = []
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((",".join(map(str, ids)).encode(), len(ids), (text or "").encode()))
    assert found == expected
