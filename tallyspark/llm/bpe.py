"""BPE encoding and decoding in batched numpy merge rounds.

Texts are split into words; each distinct word of a batch is encoded once. The symbols of all new
words lie in one flat array. A round forms the key of every adjacent pair, finds the keys among the
sorted keys of the merge table by binary search, takes the lowest rank of each word, and merges
that pair wherever it stands in the word, left to right. Words without a mergeable pair leave the
array. Word results are kept in a store of bounded size; texts are then gathered from it.

The vocabulary file is a ``tokenizers`` JSON given by path and read on the executors.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm.common import map_rows, slices

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"
NO_RANK = np.iinfo(np.int64).max
STORE_WORDS = 300_000
SLICE_CHARS = 2_000_000

# Characters whose classes Python's re and the splitting patterns agree on: ASCII, Latin letters
# without U+0130, and common punctuation. Texts of these only take the fast patterns, others are split by the library.
_LETTERS = "a-zA-ZÀ-ÖØ-öø-įı-ƿǍ-ɏ"
_MARKS = "!-/:-@\\[-`{-~¡£«»¿×÷–—‘’“”…€"
# The lower case of some letters, such as U+0181 and U+023E, lies beyond these; they are not safe either.
_SAFE_LETTERS = "".join(c for c in map(chr, range(0x250)) if re.fullmatch(f"[{_LETTERS}]{{2}}", c + c.lower()))
UNSAFE = re.compile(f"[^\t\n\r {_SAFE_LETTERS}0-9{_MARKS}]")
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORDS = {
    True: re.compile(f"{_ENDINGS}|[{_LETTERS}]+|[0-9]|[{_MARKS}]+"),
    False: re.compile(rf"{_ENDINGS}| ?[{_LETTERS}]+| ?[0-9]+| ?[{_MARKS}]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"),
}


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class BpeTokenizer:
    """A byte-level BPE vocabulary. With an end-of-word suffix, text is normalised to lower-case NFC
    and white space dropped; without, words keep the space before them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.size = len(vocab) + len(spec["added_tokens"]) + 1
        self.lower = bool(self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.tokens = np.empty(self.size, dtype=object)
        self.tokens[:] = ""
        for token, i in chain(vocab.items(), self.special.items()):
            self.tokens[i] = token
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.fast = _WORDS[self.lower]
        self.path = path
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {s: i for i, s in enumerate(self.special)}
        self.flat = np.array(list(self.special.values()), dtype=np.int64)
        self.start = np.arange(len(self.special), dtype=np.int64)
        self.length = np.ones(len(self.special), dtype=np.int64)

    @functools.cached_property
    def library(self) -> Tokenizer:
        return Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        if "<|" in text and self.split_special.search(text):
            parts = self.split_special.split(text)
            return [w for p in parts for w in ([p] if p in self.special else self._plain_words(p))]
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if UNSAFE.search(text) is None:
            return self.fast.findall(text.lower() if self.lower else text)
        # which other characters are letters depends on the library's Unicode tables, so it splits
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        pieces = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in pieces]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.first[raw]
        ends = np.cumsum(sizes)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        while len(symbols):
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.full(len(symbols), NO_RANK)
            hit = (self.keys[at] == keys) & (word[:-1] == word[1:])
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(symbols)])
            open_word = least != NO_RANK
            live = np.repeat(open_word, counts)
            if not live.all():
                done_ids.append(symbols[~live])
                done_word.append(word[~live])
            chosen = np.flatnonzero((rank == np.repeat(least, counts)) & live)
            if not len(chosen):
                break
            # in a run of one symbol, pairs overlap: every second one from the left is merged
            run = np.r_[True, chosen[1:] != chosen[:-1] + 1]
            first = np.maximum.accumulate(np.where(run, np.arange(len(chosen)), 0))
            chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            live[chosen + 1] = False
            symbols, word = symbols[live], word[live]
        ids, owner = np.concatenate(done_ids or [symbols]), np.concatenate(done_word or [word])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words)).astype(np.int64)

    def _learn(self, new: list[str]) -> None:
        ids, lengths = self.merge([w.encode("utf-8", "replace") for w in new])
        starts = np.r_[0, np.cumsum(lengths)[:-1]] + len(self.flat)
        self.index.update(zip(new, range(len(self.start), len(self.start) + len(new)), strict=True))
        self.flat = np.concatenate([self.flat, ids])
        self.start = np.concatenate([self.start, starts])
        self.length = np.concatenate([self.length, lengths])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit little-endian arrays."""
        out: list[np.ndarray] = []
        for a, b in slices([len(t) for t in texts], SLICE_CHARS):
            split = [self.words(t) for t in texts[a:b]]
            if len(self.index) > STORE_WORDS:
                self._reset()
            new = list(set(chain.from_iterable(split)).difference(self.index))
            if new:
                self._learn(new)
            at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=sum(map(len, split)))
            lengths = self.length[at]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            ids = self.flat[np.repeat(self.start[at] - (ends - lengths), lengths) + np.arange(total)].astype("<u4")
            text_ends = np.cumsum([len(w) for w in split])
            bounds = np.r_[0, np.r_[0, ends][text_ends]]
            out += [ids[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def decode(self, ids) -> str:
        """Text of ids. A vocabulary with an end-of-word suffix has no decoder: its tokens are put
        side by side with spaces, as they are. Else bytes are put together as UTF-8."""
        tokens = self.tokens[ids].tolist()
        if self.suffix:
            return " ".join(tokens)
        out = bytearray()
        for t in tokens:
            out += t.encode() if t in self.special else bytes(map(self.byte_of.__getitem__, t))
        return out.decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> BpeTokenizer:
    return BpeTokenizer(path)


def encode_columns(df: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) per row; a null text is empty and has no ids."""
    path = path or public_tokenizers.path(WORD_VOCABULARY)

    def run(batches):
        own = tokenizer(path)
        for b in batches:
            ids = own.encode_batch([t or "" for t in b["text"]])
            yield pd.DataFrame({"id": b["id"], "ids": [x.astype(np.int32) for x in ids], "decoded": [own.decode(x) for x in ids]})

    return map_rows(df, id_column, {"text": F.col(text_column)}, run, "ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no
    ids; null and repeated doc_ids and repeated rows stay as they are."""
    path = path or public_tokenizers.path(WORD_VOCABULARY)

    def run(batches):
        own = tokenizer(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in batches:
            ids = own.encode_batch([t or "" for t in b["text"]])
            yield pd.DataFrame(
                {
                    "id": b["id"],
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [sha(x.tobytes()) for x in ids],
                    "decoded_sha256": [sha(own.decode(x).encode()) for x in ids],
                }
            )

    out = map_rows(df, "doc_id", {"text": F.col("text")}, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", "doc_id")
