"""Quality by a factorisation machine over hashed words, statistics of the text's structure and its metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pair sum in linear time as
half of the sum over factors of (sum v x)^2 - sum (v x)^2.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.common import HASHES, TABLES, hashed_words, mix, span_hashes
from courtside.llm.labels import MOST_BROADCAST, held_out, training_labels

WORD_SLOTS = 1 << 14
STAT_LEVELS = 12
FACTORS = 8
#: Labelled rows that are learnt from: at most this many of each class, by the smallest hashes of their ids.
MOST_PER_CLASS = 4_000

STATISTICS = [
    "letters", "capitals", "digits", "symbols", "stops", "spaces", "word_size", "first_capitals", "end_symbols",
    "distinct_words", "repeated_pairs", "top_word", "repeated_lines", "line_words", "bare_words", "words", "chars", "metadata_chars",
]
SLOTS = WORD_SLOTS + STAT_LEVELS * len(STATISTICS)


#: Kinds of characters, a bit each.
SPACE, LETTER, CAPITAL, DIGIT, SYMBOL, STOP, UPPER, ALNUM = (1 << k for k in range(8))
SYMBOLS, STOPS, COMMA = "#*$%&|<>{}[]\\/=~^_@+", ".!?;:", ord(",")
COUNTED = np.array([[k & bit > 0 for k in range(256)] for bit in (LETTER, CAPITAL, DIGIT, SYMBOL, STOP)], np.int64)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kinds of every code point."""

    def of(c: str) -> int:
        alnum, digit = c.isalnum(), c.isdecimal()
        return (
            SPACE * c.isspace() | LETTER * (alnum and not digit) | DIGIT * digit | SYMBOL * (c in SYMBOLS) | STOP * (c in STOPS) | UPPER * c.isupper() | ALNUM * alnum
            | CAPITAL * ("A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×")
        )

    return np.fromiter(map(of, map(chr, range(0x110000))), np.uint8, 0x110000)


def repeats(values: np.ndarray) -> np.ndarray:
    """How often each different value occurs."""
    if not len(values):
        return np.zeros(0, np.int64)
    ordered = np.sort(values)
    return np.diff(np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]]))


def statistics(text: str, n_chars: int | None) -> list[float]:
    """The text's structure, each value from 0 to 1; ``n_chars`` is the row's own metadata and may be missing.

    Words are what white space separates, lines what line ends separate, without blank ones. Equal ones have equal
    differences of one running sum over the characters, see :func:`~courtside.llm.common.span_hashes`.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds()[points]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (kind & SPACE) == 0, [0]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    n, chars = max(1, len(starts)), max(1, len(text))
    letters, capitals, digits, symbols, stops = (COUNTED @ np.bincount(kind, minlength=256)).tolist()
    breaks = np.flatnonzero(points == 10)
    line_starts, line_ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(points)]])
    filled = np.concatenate([[0], np.cumsum((kind & SPACE) == 0)])
    known = np.concatenate([[0], np.cumsum((kind & ALNUM) > 0)])
    full = filled[line_ends] > filled[line_starts]
    words, lines = span_hashes(points, [(starts, ends), (line_starts[full], line_ends[full])])
    counted = repeats(words)
    pairs = repeats(mix(words[:-1]) + words[1:])
    n_lines = int(full.sum())
    last = points[ends - 1]
    odd_end = (kind[ends - 1] & (ALNUM | STOP) == 0) & (last != COMMA)
    size = lambda x: min(1.0, np.log2(1 + x) / 20)
    return [
        letters / chars,
        capitals / max(1, letters),
        digits / chars,
        min(1.0, 5 * symbols / chars),
        min(1.0, stops / n),
        text.count(" ") / chars,
        min(1.0, int((ends - starts).sum()) / n / 20),
        int(((kind[starts] & UPPER) > 0).sum()) / n,
        int(odd_end.sum()) / n,
        len(counted) / n,
        int(pairs[pairs > 1].sum()) / n,
        int(counted.max(initial=0)) / n,
        1 - len(repeats(lines)) / max(1, n_lines),
        size(n / max(1, n_lines)),
        int((known[ends] == known[starts]).sum()) / n,
        size(len(starts)),
        size(len(text)),
        size(n_chars or 0),
    ]


#: Slots of words that this worker has seen, by the words' hashes; emptied when it holds too many.
SEEN: dict[int, int] = {}
TABLES["words"] += [SEEN.clear, kinds.cache_clear]


def word_slots(text: str, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The slot of each word of ``text``, given by hash and place."""
    if len(SEEN) > 100_000:
        SEEN.clear()
    out = list(map(SEEN.get, words.tolist()))
    for k, slot in enumerate(out):
        if slot is None:
            SEEN[int(words[k])] = out[k] = HASHES[text[starts[k] : ends[k]].lower()] % WORD_SLOTS
    return np.array(out, np.int64)


def features(text: str | None, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values: words' log counts scaled to unit length, and each statistic as two neighbouring levels."""
    text = text or ""
    values = np.clip(np.array(statistics(text, n_chars)), 0, 1) * (STAT_LEVELS - 1)
    low = np.minimum(values.astype(np.int64), STAT_LEVELS - 2)
    base = WORD_SLOTS + STAT_LEVELS * np.arange(len(values))
    part = values - low
    hashes, starts, ends = hashed_words(text)
    words, first, times = np.unique(hashes, return_index=True, return_counts=True)
    found = word_slots(text, words, starts[first], ends[first])
    slots, place = np.unique(found, return_inverse=True)
    counts = np.bincount(place, times, len(slots))
    weights = np.log1p(counts)
    weights /= max(1e-9, np.sqrt((weights**2).sum()))
    scale = 1 / np.sqrt(len(values))
    return np.concatenate([slots, base + low, base + low + 1]), np.concatenate([weights, (1 - part) * scale, part * scale])


@dataclass
class FactorisationMachine:
    constant: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, slots: np.ndarray, values: np.ndarray) -> float:
        moved = self.factors[slots] * values[:, None]
        return float(self.constant + self.linear[slots] @ values + 0.5 * ((moved.sum(0) ** 2).sum() - (moved**2).sum()))


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 8, rate: float = 0.1, seed: int = 7) -> FactorisationMachine:
    """Adagrad on the logistic loss, one row at a time; each class weighs the same in sum."""
    random = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(SLOTS), random.normal(0, 0.05, (SLOTS, FACTORS)))
    positive = sum(y for *_, y in rows)
    if not 0 < positive < len(rows):
        model.constant = 0.0 if not rows else (4.0 if positive else -4.0)
        model.factors[:] = 0
        return model
    weight = {1: len(rows) / (2 * positive), 0: len(rows) / (2 * (len(rows) - positive))}
    seen_w, seen_v, seen_0 = np.full(SLOTS, 1e-2), np.full((SLOTS, FACTORS), 1e-2), 1e-2
    for _ in range(rounds):
        for k in random.permutation(len(rows)):
            slots, x, y = rows[k]
            v = model.factors[slots]
            moved = v * x[:, None]
            total = moved.sum(0)
            margin = model.constant + model.linear[slots] @ x + 0.5 * ((total**2).sum() - (moved**2).sum())
            slope = weight[y] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
            if abs(slope) < 1e-4:
                continue
            gw = slope * x + 1e-5 * model.linear[slots]
            gv = slope * (x[:, None] * (total - moved)) + 1e-5 * v
            seen_0 += slope**2
            seen_w[slots] += gw**2
            seen_v[slots] += gv**2
            model.constant -= rate * slope / np.sqrt(seen_0)
            model.linear[slots] -= rate * gw / np.sqrt(seen_w[slots])
            model.factors[slots] -= rate * gv / np.sqrt(seen_v[slots])
    return model


def metadata(docs: DataFrame) -> Column:
    """The row's own n_chars where it has one that is a number."""
    return F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def fit_quality(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> FactorisationMachine:
    """Learn from at most ``most_per_class`` labelled rows of each class outside fold 0, whole texts.

    The chosen ids are bounded by that number, so they are broadcast; slots and values of their texts come to the driver.
    """
    assert 2 * most_per_class <= MOST_BROADCAST
    known = training_labels(labels, "quality").select("doc_id", "label")
    take = lambda y: known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class)
    chosen = docs.select("doc_id", "text", metadata(docs).alias("n_chars")).join(F.broadcast(take(0).union(take(1))), "doc_id")

    def read(batches):
        for batch in batches:
            found = [features(t.as_py(), n) for t, n in zip(batch.column("text"), batch.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([s.astype(np.int32) for s, _ in found], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in found], pa.list_(pa.float32()))],
                ["doc_id", "label", "slots", "values"],
            )

    schema = "doc_id long, label int, slots array<int>, values array<float>"
    frame = chosen.select("doc_id", "label", "text", "n_chars").mapInArrow(read, schema).toArrow().to_pylist()
    frame.sort(key=lambda row: (row["doc_id"], row["slots"]))
    return fit_machine([(np.array(row["slots"]), np.array(row["values"], float), row["label"]) for row in frame])


def scored(docs: DataFrame, labels: DataFrame, name: str, at_least: float = 0.0) -> DataFrame:
    """``docs`` with the score of quality, 0 to 1, in the new column ``name``; rows that score under ``at_least`` are left out.

    Inputs of a score are the text and n_chars only; null texts count as empty, a missing n_chars as 0.
    Without labels of both classes the score is a constant: 0.5 without any, else near that class.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    names, text_at = docs.columns, docs.columns.index("text")

    def score(batches):
        machine = shared.value
        for batch in batches:
            n_chars = batch.column(len(names)).to_pylist()
            margins = [machine.margin(*features(t.as_py(), n)) for t, n in zip(batch.column(text_at), n_chars, strict=True)]
            scores = 1 / (1 + np.exp(-np.clip(np.array(margins, float), -30, 30)))
            out = pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(scores)], [*names, name])
            yield out.filter(pa.array(scores >= at_least)) if at_least else out

    # the row's own n_chars comes last, as a number, under a name that no column of the row can have
    own = metadata(docs).alias("/".join([name, *names]))
    return docs.select(*[F.col(f"`{c}`") for c in names], own).mapInArrow(score, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``, null ids and repeated rows included: doc_id, held_out, score, predicted (score >= ``threshold``)."""
    found = scored(docs.select("doc_id", "text", *["n_chars"] * ("n_chars" in docs.columns)), labels, "score")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with their columns."""
    name = "/".join(["quality", *docs.columns])
    return scored(docs, labels, name, threshold).drop(name)
