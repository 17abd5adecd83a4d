import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import bpe

PATHS = {n: public_tokenizers.path(n) for n in (bpe.WORD_VOCABULARY, bpe.BYTE_VOCABULARY)}
OWN = {n: bpe.BpeTokenizer(p) for n, p in PATHS.items()}
THEIRS = {n: Tokenizer.from_file(p) for n, p in PATHS.items()}
ALPHABET = list("aAbBtheéÉßΣσςİıſK'sSt're  \n\t\x0b\x1c\x85_.,!?<|>0½²一二あ🙂é̀") + ["<|endoftext|>", "<|startoftext|>", "'ll", "aaaaaaa", "\x00"]


@pytest.mark.parametrize("name", PATHS)
@settings(max_examples=150, deadline=None)
@given(parts=st.lists(st.one_of(st.sampled_from(ALPHABET), st.text(max_size=5)), max_size=30))
def test_equals_the_library(name, parts):
    text = "".join(parts)
    ids = OWN[name].encode_batch([text])[0].tolist()
    assert ids == THEIRS[name].encode(text, add_special_tokens=False).ids
    assert OWN[name].decode(ids) == THEIRS[name].decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("name", PATHS)
def test_every_latin_letter(name):
    # U+0181 and U+023E are Latin letters whose lower case is not among the safe ones
    texts = [f"{c} a{c}B" for c in map(chr, range(0x300))]
    for text, ids in zip(texts, OWN[name].encode_batch(texts), strict=True):
        assert ids.tolist() == THEIRS[name].encode(text, add_special_tokens=False).ids, ascii(text)


@pytest.mark.parametrize("name", PATHS)
def test_long_words_and_store_resets(name, monkeypatch):
    monkeypatch.setattr(bpe, "STORE_WORDS", 5)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    random.seed(1)
    texts = ["a" * 4000, "ab" * 1500, "".join(random.choice("etaoin") for _ in range(3000)), "", "the the cat", "the dog's 12345"] * 2
    own = bpe.BpeTokenizer(PATHS[name])
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert ids.tolist() == THEIRS[name].encode(text, add_special_tokens=False).ids


def test_merged_symbols_rank_after_their_parts():
    # what lets a whole round merge one pair at all its places in a word
    for own in OWN.values():
        rank_of = {int(m): int(r) for m, r in zip(own.made, own.ranks, strict=True)}
        for key, rank in zip(own.keys.tolist(), own.ranks.tolist(), strict=True):
            a, b = divmod(key, own.size)
            assert rank_of.get(a, -1) < rank and rank_of.get(b, -1) < rank


def test_digests(odd_docs, no_docs):
    t = THEIRS[bpe.WORD_VOCABULARY]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(odd_docs).collect()}
    want = set()
    for r in odd_docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want.add((r.doc_id, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.encode_digests(odd_docs).count() == odd_docs.count()
    assert bpe.encode_digests(no_docs).collect() == []
    rows = bpe.encode_columns(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(isinstance(r.ids, list) for r in rows)
