"""Token ids of whole texts by a public tokenizer file, with a bounded cache of words."""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import regex

from courtside.llm.common import TABLES, hold

#: The parts of a tokenizer file under which the ids of a text are those of its words one by one.
WORDWISE_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDWISE_PRETOKENIZERS = ["Split", "ByteLevel"]

#: Letters, digits, marks and white space whose Unicode classes all versions agree on; words with others go through the library.
SETTLED = regex.compile(r"[\s\x21-\u036f\u0391-\u03a1\u03a3-\u0481\u048a-\u052f\u2010-\u203a\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*+")
#: Marks that end words; each is a piece of its own after a letter.
ENDINGS = frozenset(".,;:!?")

#: Where str.split() and the file's white space differ.
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")


class Words(dict):
    """Lower-case word in composed form to its ids as little-endian 32-bit bytes; emptied when it holds ``most`` words."""

    def __init__(self, spec: dict, most: int = 120_000):
        import tiktoken

        super().__init__()
        self.most, vocabulary = most, spec["model"]["vocab"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # whether the file's own pattern takes a word's letters as one piece and a mark after them as another
        self.plain_marks = all(self.pattern.findall("word" + mark) == ["word", mark] for mark in ENDINGS)
        added = {x["id"] for x in spec["added_tokens"]}
        end, alphabet = spec["model"]["end_of_word_suffix"], byte_alphabet()
        ranks = {}
        for token, number in vocabulary.items():
            if number not in added:
                # byte 255 never occurs in UTF-8: it marks the end of a word
                closed = token.endswith(end) and token != end
                ranks[bytes(alphabet[c] for c in (token[: -len(end)] if closed else token)) + b"\xff" * closed] = number
        self.merge = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, word: str) -> bytes:
        if not (self.plain_marks and word.isalpha()):
            if self.plain_marks and word[-1] in ENDINGS and word[:-1].isalpha():
                return self[word[:-1]] + self[word[-1]]
            ids = [number for piece in self.pattern.findall(word) for number in self.merge(piece.encode() + b"\xff")]
        else:
            ids = self.merge(word.encode() + b"\xff")
        value = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) < 100:
            if len(self) >= self.most:
                self.clear()
            self[word] = value
        return value


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + k): byte for k, byte in enumerate(other)}


class Encoder:
    """Ids of texts, the same as ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Where the file's rules work word by word, words are looked up in a bounded cache, words with unsettled characters go
    through the library; so does a text that holds one of the file's special tokens or odd white space, and every text under other rules.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.words = Words(spec) if wordwise(spec) else None

    @cached_property
    def whole(self):
        """The library's tokenizer, loaded with the first text that needs it: it takes more memory than all words held here."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit bytes."""
        text = text or ""
        if self.words is None or ODD_SPACE.search(text) or any(x in text for x in self.special):
            return self.by_library(text)
        if text.isascii() or SETTLED.fullmatch(text):
            return self.by_words(text)
        return b"".join(self.by_words(word) if SETTLED.fullmatch(word) else self.by_library(word) for word in text.split())

    def by_words(self, text: str) -> bytes:
        plain = text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self.words.__getitem__, plain.lower().split()))

    def by_library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def wordwise(spec: dict) -> bool:
    model = spec["model"]
    kinds = lambda x, many: [y["type"] for y in (x or {}).get(many, [])]
    merges = ["".join(x) if isinstance(x, list) else x.replace(" ", "") for x in model.get("merges", [])]
    first = model.get("vocab", {}).get(merges[0]) if merges else None
    return (
        model["type"] == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and kinds(spec["normalizer"], "normalizers") == WORDWISE_NORMALIZERS
        and kinds(spec["pre_tokenizer"], "pretokenizers") == WORDWISE_PRETOKENIZERS
        and spec["pre_tokenizer"]["pretokenizers"][0]["invert"]
        and all(model["vocab"][x] == first + k for k, x in enumerate(merges))
    )


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    hold("tokens")
    return Encoder(path)


TABLES["tokens"] += [encoder.cache_clear]
