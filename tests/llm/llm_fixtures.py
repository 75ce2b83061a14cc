"""Small tables for the operators of courtside.llm: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random
import zlib

SF = "/root/testdata/sf0.001"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    syllables = ["an", "be", "co", "du", "en", "fi", "gra", "ho", "is", "ka", "lo", "mi", "no", "or", "pa", "qui", "ro", "su", "te", "vi"]
    out = []
    for k in range(words):
        word = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        out.append((word.capitalize() if k % 11 == 0 else word) + ("." if k % 11 == 10 else ""))
    return " ".join(out)


def edited(text: str, places: list[int]) -> str:
    words = text.split()
    for k in places:
        words[k] = f"changed{k}"
    return " ".join(words)


def documents(spark, rows, extra: bool = True):
    """(doc_id, text) rows as a documents table, with further columns whose names clash with the operators' own."""
    full = [(i, t, "en", "src", len(t or ""), 0.5, "x", 1) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, root string, key int"
    df = spark.createDataFrame(full, schema)
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


EDGES = [(None, None), (None, ""), (None, "Null id."), (900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "!!!"), (904, "!!!"), (905, "É ß 日本 \U0001f600")]
