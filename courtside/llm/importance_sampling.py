"""Importance resampling towards a target corpus: documents are scored by arrays of bucket gains, and the draw is an exact
parallel sort by regular sampling.

Scoring: one- and two-word features are hashed into buckets; a bucket's gain is the logarithm of its share among the target's
features over its share among the documents'. A document's weight is the mean gain of its features; noise of
a Gumbel distribution, fixed by the id, makes the highest scores a draw without replacement.

Sorting: each file split of the scores is sorted where it lies (a run); every run gives every ``stride``-th key; the sorted
samples give splitters; the rows are exchanged by segment, each segment is sorted by itself, and the counts of
the segments before it turn places into ranks. Segments behind the last drawn rank are neither exchanged nor sorted.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import stage

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Samples per segment; the driver sees this many keys per segment, and one more per run at most.
SAMPLES = 32
#: Segments at most: with it, the samples on the driver stay under 40 MB.
MOST_SEGMENTS = 4_000

#: Bytes to features' bytes: A-Z to a-z, and everything below 128 that is neither letter nor digit to a space.
PLAIN = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if byte >= 0x80 or 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A else 0x20 for byte in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8: runs of ASCII letters in lower case, digits, and all other code points from 128 on."""
    return text.translate(PLAIN).split()


def buckets_of(words: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every feature: each word, and each two neighbours joined by a space (the first's checksum carried on)."""
    single = list(map(crc32, words))
    double = map(crc32, [b" " + word for word in words[1:]], single)
    return np.fromiter([*single, *double], np.int64, max(0, 2 * len(words) - 1)) % buckets


def _bytes(text: pa.StringScalar) -> bytes:
    held = text.as_buffer()
    return held.to_pybytes() if held is not None else b""


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` (text) fall into each bucket: at most one row per task and bucket is exchanged."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in batch.column(0):
                held.append(buckets_of(words_of(_bytes(text)), buckets))
                size += len(held[-1])
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / source share)) of each bucket, with one added to every count."""
    size, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    ratio = lambda s, t: float(t + 1) * float(all_source + size) / (float(s + 1) * float(all_target + size))
    return np.array([math.floor(1000 * math.log(ratio(int(s), int(t)))) for s, t in zip(source, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """floor(1000 g), g a standard Gumbel number that follows from the seed and the id (null: no digits)."""
    drawn = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((drawn + 0.5) / 4294967296)))


def scored(docs: DataFrame, gained: np.ndarray, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score."""
    shared = docs.sparkSession.sparkContext.broadcast(gained)

    def score(batches):
        gained = shared.value
        for batch in batches:
            n_words, features, weights, scores = [], [], [], []
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1), strict=True):
                words = words_of(_bytes(text))
                buckets = buckets_of(words, len(gained))
                weight = int(gained[buckets].sum()) // len(buckets) if len(buckets) else 0
                n_words.append(len(words))
                features.append(len(buckets))
                weights.append(weight)
                scores.append(weight + noise(doc_id, seed))
            columns = [pa.array(x, pa.int64()) for x in (ids, n_words, features, weights, scores)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def splitters(rows: DataFrame, keys: list[str], n_rows: int, segments: int, samples: int = SAMPLES) -> list[tuple]:
    """At most ``segments`` - 1 keys that cut the rows into segments of nearly equal size: regular samples of sorted runs."""
    stride = max(1, n_rows // (segments * samples))
    # the place in the run: the lower bits of the id that counts rows within a partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    runs = rows.select(*keys).sortWithinPartitions(*keys).withColumn("__place", place)
    found = sorted(tuple(row)[: len(keys)] for row in runs.where(F.col("__place") % stride == stride // 2).collect())
    return [found[k * len(found) // segments] for k in range(1, segments)] if len(found) >= segments else found


def ranked(rows: DataFrame, keys: list[str], most: int, segments: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3, ... by rising ``keys`` up to ``most``, null beyond.

    ``rows`` is a staged table; ``keys`` are long columns without nulls that no two rows share all of, so no value of one of them
    can gather rows in a segment.
    """
    n_rows = rows.count()
    cuts = splitters(rows, keys, n_rows, min(segments, MOST_SEGMENTS)) if n_rows else []
    shared = rows.sparkSession.sparkContext.broadcast(cuts)
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", segment int"

    def deal(batches):
        cuts = shared.value
        for batch in batches:
            found = [bisect.bisect_right(cuts, key) for key in zip(*(batch.column(names.index(k)).to_pylist() for k in keys), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*names, "segment"])

    dealt = rows.mapInArrow(deal, schema)
    sizes = {row["segment"]: row["n"] for row in dealt.groupBy("segment").agg(F.count("*").alias("n")).collect()}
    before, base = 0, []
    for segment in sorted(sizes):
        if before < most:
            base.append((segment, before))
        before += sizes[segment]
    bases = F.broadcast(rows.sparkSession.createDataFrame(base, "segment int, base long"))
    drawn = dealt.join(bases, "segment")
    place = F.row_number().over(Window.partitionBy("segment").orderBy(*keys)) + F.col("base")
    drawn = drawn.select(*names, place.cast("long").alias("rank"))
    rest = dealt.where(F.col("segment") > (base[-1][0] if base else -1)).select(*names, F.lit(None).cast("long").alias("rank"))
    return drawn.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).union(rest)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_features, weight, score, rank, n_words.

    Of the N rows with ``least_words`` words or more the floor(``percent`` N / 100) highest scores are drawn; rank counts them from 1,
    ties to the smaller doc_id (null last), rows that repeat an id in the order of the scores' file. Null and empty texts
    have no features, weight 0 and are never drawn. Repeated rows count each time, in the buckets too. Without a target
    every bucket's target count is one. An empty table gives no rows; further columns are ignored.
    """
    gained = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    named = scored(docs, gained, seed)
    keyed = named.select(
        "*",
        (-F.col("score")).alias("k_score"),
        F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("k_id"),
        F.monotonically_increasing_id().alias("k_row"),
    )
    table = stage(keyed, "scores")
    long_enough = table.where(F.col("n_words") >= least_words)
    most = percent * long_enough.count() // 100
    segments = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = ranked(long_enough, ["k_score", "k_id", "k_row"], most, segments)
    rest = table.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return found.union(rest).select("doc_id", "n_features", "weight", "score", "rank", "n_words")
