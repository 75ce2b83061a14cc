"""Fill-in-the-middle: whole texts cut at two places between tokens and put into another order.

A token is a run of other characters with the white space before it; white space at the text's end is a token too.
Each text's characters are put into four classes (white space or not, last of its run or not), held in a wavelet matrix.
The tokens up to a place are the ends of runs of non-space before it, and the end of the text where white space ends it:
rank queries count them, select queries find the place of a token's end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Classes of characters, two bits each: white space inside and at the end of its run, other characters likewise.
SPACE, SPACE_END, OTHER, OTHER_END = range(4)


class Bits:
    """A bit vector with rank and select, 64 bits to a word and a running count per word."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, place: int, bit: int = 1) -> int:
        """How many of the first ``place`` bits are ``bit``."""
        word, rest = divmod(place, 64)
        ones = int(self.before[word]) + (int(self.words[word]) & ((1 << rest) - 1)).bit_count()
        return ones if bit else place - ones

    def select(self, nth: int, bit: int = 1) -> int:
        """The place of the ``nth`` bit (from 0) that is ``bit``: bisection on the words' ranks, then within the word."""
        counts = self.before if bit else 64 * np.arange(len(self.before)) - self.before
        word = int(np.searchsorted(counts, nth, side="right")) - 1
        left, bits = nth - int(counts[word]), int(self.words[word])
        if not bit:
            bits ^= (1 << 64) - 1
        low, high = 0, 63
        while low < high:
            middle = (low + high) // 2
            if (bits & ((2 << middle) - 1)).bit_count() > left:
                high = middle
            else:
                low = middle + 1
        return 64 * word + low


class WaveletMatrix:
    """A sequence of small numbers: one bit vector per bit, each level ordered by the bits above it, zeros first."""

    def __init__(self, values: np.ndarray, n_bits: int):
        self.n, self.levels = len(values), []
        for level in reversed(range(n_bits)):
            bits = (values >> level) & 1
            self.levels.append((level, Bits(bits), int(len(bits) - bits.sum())))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def rank(self, value: int, place: int) -> int:
        """How often ``value`` occurs in the first ``place`` entries."""
        start = 0
        for level, bits, zeros in self.levels:
            if value >> level & 1:
                start, place = zeros + bits.rank(start), zeros + bits.rank(place)
            else:
                start, place = bits.rank(start, 0), bits.rank(place, 0)
        return place - start

    def select(self, value: int, nth: int) -> int:
        """The place of the ``nth`` entry (from 0) that is ``value``."""
        start = 0
        for level, bits, zeros in self.levels:
            start = zeros + bits.rank(start) if value >> level & 1 else bits.rank(start, 0)
        at = start + nth
        for level, bits, zeros in reversed(self.levels):
            at = bits.select(at - zeros) if value >> level & 1 else bits.select(at, 0)
        return at


def classes(text: str) -> np.ndarray:
    """The class of each code point of ``text``."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    other = ~((points == 0x20) | ((points >= 0x09) & (points <= 0x0D)))
    last = np.ones(len(points), bool)
    last[:-1] = other[1:] != other[:-1]
    return 2 * other.astype(np.uint8) + last


class Tokens:
    """A text's tokens, by place only: how many there are and where each ends."""

    def __init__(self, text: str):
        self.length = len(text)
        self.matrix = WaveletMatrix(classes(text), 2)
        self.words = self.matrix.rank(OTHER_END, self.length)
        # runs of white space that end: one more than words follow them where the text ends in white space
        space_runs = self.matrix.rank(SPACE_END, self.length)
        starts_in_space = int(self.length > 0 and self.matrix.rank(SPACE, 1) + self.matrix.rank(SPACE_END, 1))
        inner = max(0, self.words - 1 + starts_in_space) if self.words else 0
        self.n = self.words + int(space_runs > inner)

    def end(self, tokens: int) -> int:
        """The number of characters in the first ``tokens`` tokens."""
        if tokens == 0:
            return 0
        return self.matrix.select(OTHER_END, tokens - 1) + 1 if tokens <= self.words else self.length


def choices(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits that follow from the seed and the id (null: no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def transform(text: str, doc_id: int | None, seed: int = 42, rate: int = 50, spm_share: int = 80) -> dict:
    """The text's form, its cuts and the output: prefix, middle and suffix are whole tokens.

    ``rate`` percent of the texts are cut, ``spm_share`` percent of these with the suffix first. Empty texts and
    those that hold one of the marks stay as they are.
    """
    tokens = Tokens(text)
    first, second, chance, order = choices(doc_id, seed)
    cuts = sorted((first % (tokens.n + 1), second % (tokens.n + 1)))
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or chance % 100 >= rate:
        return {"n": tokens.n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    a, b = map(tokens.end, cuts)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if order % 100 < spm_share else "psm"
    parts = [SUFFIX, suffix, PREFIX, prefix] if form == "spm" else [PREFIX, prefix, SUFFIX, suffix]
    return {"n": tokens.n, "form": form, "prefix_chars": a, "middle_chars": b - a, "output": "".join([*parts, MIDDLE, middle])}


def restore(output: str, form: str) -> str:
    """The text that ``output`` was made of, from the output and its form alone."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    head, _, middle = output.removeprefix(first).partition(MIDDLE)
    one, _, two = head.partition(second)
    return f"{two}{middle}{one}" if form == "spm" else f"{one}{middle}{two}"


COLUMNS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}


def _mapped(docs: DataFrame, more: dict[str, pa.DataType], row, seed: int, rate: int, spm_share: int) -> DataFrame:
    columns = {**COLUMNS, **more}
    schema = pa.schema(list(columns.items()))

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # outputs are as long as texts: a few at a time
                some = batch.slice(at, 256)
                found = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                    made = transform(text.as_py() or "", doc_id, seed, rate, spm_share)
                    found.append({"doc_id": doc_id, **{k: v for k, v in made.items() if k in columns}, **row(made)})
                yield pa.RecordBatch.from_pylist(found, schema)

    kinds = {pa.int64(): "long", pa.string(): "string"}
    return docs.select("doc_id", "text").mapInArrow(cut, ", ".join(f"{name} {kinds[kind]}" for name, kind in columns.items()))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_share: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    Null texts count as empty; empty texts are plain with no tokens. A null id draws as an id without digits. Repeated rows
    draw alike. Empty tables give no rows; further columns are ignored. There is no shuffle: each text is cut where it lies,
    and memory follows the longest text.
    """
    return _mapped(docs, {"output": pa.string()}, lambda made: {}, seed, rate, spm_share)


def fill_in_middle_digests(docs: DataFrame, seed: int = 42, rate: int = 50, spm_share: int = 80) -> DataFrame:
    """As :func:`fill_in_middle`, with hashes in place of texts: output_sha256, and restored_sha256 of the text read back."""

    def digests(made: dict) -> dict:
        texts = {"output_sha256": made["output"], "restored_sha256": restore(made["output"], made["form"])}
        return {name: hashlib.sha256(text.encode()).hexdigest() for name, text in texts.items()}

    return _mapped(docs, {"output_sha256": pa.string(), "restored_sha256": pa.string()}, digests, seed, rate, spm_share)
