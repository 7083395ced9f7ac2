"""Exact byte-pair encoding in linear time, and decoding by an offset table.

A token sequence is the merge-order encoding of a word if each neighbouring
pair of it is what encoding that pair's own bytes would give. So the encoder
walks the word with the longest token at each place (found with an Aho-Corasick
automaton over the vocabulary), accepts a token if it is compatible with the one
before it, else takes the next shorter token there, and steps back when none is
left; places from which no way leads on are marked and never tried twice, which
bounds the work by the word's length times the longest chain of prefix tokens.

Defined results: a null text is empty and has no ids; each input row gives one row,
repeated rows and rows with a null doc_id included; texts of any length are encoded in
whole; no order is asked for, so there are no ties; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from tesserae.llm.common import documents

#: Words kept with their ids; the memo is emptied beyond.
MEMO = 400_000
#: Stands for the end of a word in the automaton: the vocabulary's bytes never map to it.
END = "\x00"


def byte_letters() -> list[str]:
    """The printable letter for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, n = {b: chr(b) for b in own}, 0
    for b in range(256):
        if b not in letters:
            letters[b], n = chr(0x100 + n), n + 1
    return [letters[b] for b in range(256)]


class WordBpe:
    """A vocabulary with word ends, read from a tokenizer file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.end = END if self.suffix else ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        names = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.size = max(names) + 1
        # the offset table: token i is blob[at[i] : at[i + 1]], followed by the space that joins tokens
        each = [names.get(i, "").encode() + b" " for i in range(self.size)]
        self.at = np.zeros(self.size + 1, np.int64)
        np.cumsum([len(x) for x in each], out=self.at[1:])
        self.blob = np.frombuffer(b"".join(each), np.uint8)

        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = c  # merges are listed as their results are numbered, so the result's id ranks the merge
            self.parts.setdefault(c, (a, b))
        self.letters = byte_letters()
        self.spelt = {i: self._spelling(s) for s, i in vocab.items()}
        self.automaton = ahocorasick.Automaton()
        for i, s in self.spelt.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        by_spelling = {s: i for i, s in self.spelt.items()}
        self.shorter = {i: next((by_spelling[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in by_spelling), -1) for i, s in self.spelt.items()}
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.prose = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
        self.unusual = re.compile(r"[^\t-\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]|<\|")
        self.reader = Tokenizer.from_file(path)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def _spelling(self, token: str) -> str:
        ends = self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix)
        return token[: -len(self.suffix)] + END if ends else token

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding the bytes of a and b together leaves exactly the tokens a, b."""
        known = self.fits.get((a, b))
        if known is None:
            known = self.fits[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Take the later of both tokens apart again and again; if the tokens that touch at
        # the border could ever have merged before the merge undone last, they would have.
        undone = self.size + 1
        while True:
            joined = self.rank.get((a, b))
            if joined is not None and joined < undone:
                return False
            # of equal merges the left one goes first, so b's counts half a step later
            if a > b or b not in self.parts:
                if a not in self.parts:
                    if b not in self.parts:
                        return True
                    undone, b = b + 1, self.parts[b][0]
                    continue
                undone, a = a, self.parts[a][1]
            else:
                undone, b = b + 1, self.parts[b][0]

    def encode_word(self, word: str) -> tuple[int, ...]:
        """The ids of one pre-token."""
        known = self.memo.get(word)
        if known is not None:
            return known
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(self.fits) >= 4 * MEMO:
            self.fits.clear()
        known = self.memo[word] = self._walk("".join(map(self.letters.__getitem__, word.encode())) + self.end)
        return known

    def _longest(self, s: str) -> list[int]:
        """For each place, the longest token that starts there, or -1."""
        best = [-1] * len(s)
        for end, i in self.automaton.iter(s):
            start = end + 1 - len(self.spelt[i])
            if best[start] < 0 or len(self.spelt[best[start]]) < len(self.spelt[i]):
                best[start] = i
        return best

    def _walk(self, s: str) -> tuple[int, ...]:
        longest, spelt, shorter = self._longest(s), self.spelt, self.shorter
        n, place, out = len(s), 0, []
        dead = bytearray(n + 1)
        token = longest[0] if n else -1
        while place < n:
            while token >= 0:
                end = place + len(spelt[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place += len(spelt[token])
                token = longest[place] if place < n else -1
            elif out:
                dead[place] = 1
                last = out.pop()
                place -= len(spelt[last])
                token = shorter[last]
            else:
                raise ValueError("no encoding: the vocabulary lacks a byte")
        return tuple(out)

    def spelt_words(self, text: str) -> list[str]:
        """Pre-tokens of a text with rare letters, in byte letters.

        Which code points are letters, and how they are lowered, depends on the
        Unicode version of the tokenizer's own library, so that library reads them.
        """
        normal = self.reader.normalizer.normalize_str(text)
        return [word for word, _ in self.reader.pre_tokenizer.pre_tokenize_str(normal)]

    def segments(self, text: str) -> Iterator[str | int]:
        """Runs of words, and the ids of special tokens between them."""
        place = 0
        if "<|" in text:
            for m in self.marks.finditer(text):
                yield text[place : m.start()]
                yield self.special[m.group()]
                place = m.end()
        yield text[place:]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, add = self.memo.get, out.extend
        for piece in self.segments(text):
            if isinstance(piece, int):
                out.append(piece)
                continue
            if self.unusual.search(piece):
                for word in self.spelt_words(piece):
                    add(self._walk(word + self.end))
            else:
                for word in self.prose.findall(piece.lower()):
                    add(known(word) or self.encode_word(word))
        return out

    def decode(self, ids) -> bytes:
        """UTF-8 of the tokens' names joined by spaces; special tokens are kept."""
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        start, length = self.at[ids], self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(length)
        index = np.arange(ends[-1]) + np.repeat(start - (ends - length), length)
        return self.blob[index][:-1].tobytes()


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """Each document's ids and its decoded text: doc_id, ids array<int>, decoded string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(path)
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.iloc[i : i + 64]
                ids = [bpe.encode(x) for x in part["text"]]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": ids, "decoded": [bpe.decode(x).decode() for x in ids]})

    return documents(docs).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encoding and decoding of every document, as doc_id, n_tokens, ids_sha256, decoded_sha256.

    Ids and decoded texts are hashed where they are made, so neither leaves its task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = word_bpe(path)
        names = [str(i) for i in range(bpe.size)]
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = bpe.encode(text)
                said = " ".join(map(names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": list(n), "ids_sha256": list(a), "decoded_sha256": list(b)})

    return documents(docs).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
