"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles, each labelled with how often it occurred before. A sketch takes the
``ORDER`` labelled shingles with the smallest hashes under one permutation and keeps them in text order, so two
texts share a sketch if they share those shingles and their order: this follows edit similarity, not only
the set of shingles. Texts that share one of ``SKETCHES`` sketches are candidates.

Similarity of two texts is m / (a + b - m), m the length of their longest common subsequence of shingles, a and b
their numbers of shingles. It is computed exactly wherever it can reach the threshold, by a bit-parallel
alignment within the band that the threshold leaves.

A large bucket is not compared pair by pair. Its texts are compared with two of them, and where that leaves them in several
classes a prefix filter finds every pair that can still be similar: two texts of similarity s share one of the first
n - ceil(s n) + 1 of their labelled shingles in any order common to all texts, here rarest first, and the first they share
leaves enough shingles after it in both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import components, hashed_words, mix, rolling, signed, stage

SHINGLE = 5
ORDER = 2
SKETCHES = 16
SIMILARITY = 0.8
#: A bucket of at most this many different texts compares all of them; a larger one goes through ``bucket_links``, then ``missed_links``.
SMALL_BUCKET = 8
#: Counters of the table that orders shingles by frequency: its size (8 bytes each) does not depend on the corpus.
COUNTERS = 1 << 20

SEEDS = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(text: str | None) -> np.ndarray:
    """32-bit hashes of the text's words."""
    return hashed_words(text or "")[0].astype(np.uint32)


def shingles(words: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of SHINGLE words; of all words where there are fewer."""
    return rolling(words.astype(np.uint64), SHINGLE)


def labelled(values: np.ndarray) -> np.ndarray:
    """Each shingle with the number of its earlier occurrences."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return values
    first = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    nth = np.empty(len(values), np.uint64)
    nth[order] = np.arange(len(values)) - first
    return mix(values + nth * np.uint64(0x9E3779B97F4A7C15))


def sketch(values: np.ndarray) -> np.ndarray:
    """One 64-bit hash per permutation: its ORDER smallest labelled shingles, in text order."""
    named = labelled(values)
    take = min(ORDER, len(named))
    hashed = mix(named[None, :] ^ SEEDS[:, None])
    at = np.sort(np.argpartition(hashed, take - 1, axis=1)[:, :take], axis=1)
    out = SEEDS.copy()
    for x in np.take_along_axis(hashed, at, axis=1).T:
        out = mix(out * np.uint64(31) + x)
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences if it is ``least`` or more, else some value below it.

    Common ends are matched first. The rest is aligned in the band of 2k + 1 diagonals that an alignment
    of the threshold can use, k = (a + b)(1 - least) / (1 + least): a window of bits of one sequence moves along the
    other (longest common subsequence with one addition per row).
    """
    n, m = len(a), len(b)
    if n > m:
        a, b, n, m = b, a, m, n
    if n < least * m:
        return 0.0
    band = int((n + m) * (1 - least) / (1 + least) + 1e-9) + 1
    same = a == b[:n]
    head = n if same.all() else int(np.argmin(same))
    a, b = a[head:], b[head:]
    tail = 0
    if len(a):
        same = a[::-1] == b[::-1][: len(a)]
        tail = len(a) if same.all() else int(np.argmin(same))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    common = head + tail
    if len(a) and len(b):
        places: dict[int, list[int]] = {}
        for at, x in enumerate(b.tolist()):
            places.setdefault(x, []).append(at)
        width = 2 * band + 1
        full, top = (1 << width) - 1, 1 << (width - 1)
        window, low, gone = full, -band, 0  # bit i stands for place low + i of b; a zero is one more match
        for x in a.tolist():
            match = 0
            for at in places.get(x, ()):
                if 0 <= at - low < width:
                    match |= 1 << (at - low)
            kept = window & match
            window = ((window + kept) | (window - kept)) & full
            gone += 1 - (window & 1)
            window = (window >> 1) | top
            low += 1
        common += gone + width - window.bit_count()
    return common / (n + m - common)


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text_id, n, words, sketches) per row of ``docs``; texts without words have no sketches.

    text_key hashes the text (null: empty), text_id its words: texts that differ only in case, marks and space share
    the latter. ``n`` is the number of shingles, ``words`` has the words' hashes.
    """

    def read(batches):
        for batch in batches:
            ids, sizes, all_words, all_sketches = [], [], [], []
            for text in batch.column(2):
                words = word_hashes(text.as_py())
                values = shingles(words)
                ids.append(xxhash.xxh3_64_intdigest(words.tobytes()))
                sizes.append(len(values))
                all_words.append(words.tobytes())
                all_sketches.append(signed(sketch(values)) if len(values) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(signed(np.array(ids, np.uint64))),
                    pa.array(sizes, pa.int32()),
                    pa.array(all_words, pa.binary()),
                    pa.array(all_sketches, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_key", "text_id", "n", "words", "sketches"],
            )

    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    return keyed.mapInArrow(read, "doc_id long, text_key long, text_id long, n int, words binary, sketches array<long>")


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def align(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) of text ids; ``texts`` (text_id, words), one row per id."""

    def verify(batches):
        for batch in batches:
            found = [
                similarity(shingles(np.frombuffer(x.as_buffer(), np.uint32)), shingles(np.frombuffer(y.as_buffer(), np.uint32)), least)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    left = texts.select(F.col("text_id").alias("a"), F.col("words").alias("x"))
    right = texts.select(F.col("text_id").alias("b"), F.col("words").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, similarity double")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def bucket_links(rows: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Buckets (sketch, text_id, n, leader, size), their texts (text_id, words) and compared pairs (a, b, similarity).

    ``rows`` is a staged table of ``sketched``. Buckets (texts with one sketch in common) of at most SMALL_BUCKET texts
    compare all their pairs. In a larger one all are compared with its smallest id. Then the texts that are not linked to
    it are compared with the bucket's text nearest to it, and so are the linked ones: in a group of edited copies that is
    the text in the middle, to which the others are nearest. So a bucket costs a multiple of its texts, never their
    square, and copies of one text are one text.
    """
    members = rows.select("text_id", "n", F.explode("sketches").alias("sketch")).distinct()
    # written first: a join can split a hot key only where both sides come straight from a shuffle
    leaders = stage(members.groupBy("sketch").agg(F.min("text_id").alias("leader"), F.count("*").alias("size")).where("size > 1"), "leaders")
    buckets = stage(members.join(leaders, "sketch"), "buckets")
    # the words of the texts in buckets, one row each: gathered once, small next to the corpus
    needed = buckets.select("text_id").distinct()
    texts = stage(rows.select("text_id", "words").join(needed, "text_id").groupBy("text_id").agg(F.first("words").alias("words")), "texts")
    small = buckets.where(F.col("size") <= SMALL_BUCKET)
    within = small.join(small.select("sketch", F.col("text_id").alias("other"), F.col("n").alias("m")), "sketch").where("text_id < other").where(close(least))
    stars = buckets.where((F.col("size") > SMALL_BUCKET) & (F.col("text_id") != F.col("leader")))
    first = (
        within.select(*ordered(F.col("text_id"), F.col("other")))
        .union(stars.select(*ordered(F.col("text_id"), F.col("leader"))))
        .distinct()
    )
    known = stage(align(first, texts, least), "aligned")
    judged = stars.withColumns({"a": F.least("text_id", "leader"), "b": F.greatest("text_id", "leader")}).join(known, ["a", "b"])
    best = judged.groupBy("sketch").agg(F.max(F.struct("similarity", "text_id")).alias("best"), F.min("similarity").alias("worst"))
    middle = stage(best.where(F.col("worst") < least).select("sketch", F.col("best.text_id").alias("middle")), "middles")
    second = judged.join(middle, "sketch").where("text_id != middle").select(*ordered(F.col("text_id"), F.col("middle"))).distinct()
    fresh = second.join(known.select("a", "b"), ["a", "b"], "left_anti")
    return buckets, texts, stage(known.union(align(fresh, texts, least)), "compared")


def close(least: float) -> Column:
    """Whether texts of n and m shingles can be similar."""
    return F.least("n", "m") >= least * F.greatest("n", "m")


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many labelled shingles of ``texts`` (words) fall to each of COUNTERS counters."""

    def count(batches):
        found = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for words in batch.column(0):
                values = labelled(shingles(np.frombuffer(words.as_buffer(), np.uint32)))
                np.add.at(found, (values % np.uint64(COUNTERS)).astype(np.int64), 1)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["counter", "found"])

    counted = texts.select("words").mapInArrow(count, "counter long, found long").groupBy("counter").agg(F.sum("found").alias("found")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[counted["counter"].to_numpy()] = counted["found"].to_numpy()
    return out


def prefixes(texts: DataFrame, least: float) -> DataFrame:
    """(text_id, root, n, at, key): of each of ``texts`` (text_id, root, words) the shingles of which similar texts share one.

    ``at`` is the shingle's place in the order of the text's shingles; ``enough_left`` tells what a first shared one must leave.
    The order is by the counter of ``shingle_counts``, then by the shingle's own hash: shingles that fall to one counter
    make a prefix less rare, never wrong.
    """
    counts = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts))

    def cut(batches):
        for batch in batches:
            keys, sizes = [], []
            for words in batch.column(2):
                values = labelled(shingles(np.frombuffer(words.as_buffer(), np.uint32)))
                take = len(values) - math.ceil(least * len(values) - 1e-9) + 1
                order = np.lexsort((values, counts.value[(values % np.uint64(COUNTERS)).astype(np.int64)]))
                keys.append(values[order[:take]])
                sizes.append(len(values))
            many = [len(k) for k in keys]
            columns = [np.repeat(x, many) for x in (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.array(sizes, np.int32))]
            columns.append(np.concatenate([np.arange(k, dtype=np.int32) for k in many] or [np.zeros(0, np.int32)]))
            columns.append(signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["text_id", "root", "n", "at", "key"])

    return texts.select("text_id", "root", "words").mapInArrow(cut, "text_id long, root long, n int, at int, key long")


def enough_left(least: float) -> Column:
    """Whether texts of n and m shingles whose first shared one has places at and other_at can be similar.

    Similar texts share least / (1 + least) of all their shingles, none of them before the first.
    """
    return F.least(F.col("n") - F.col("at"), F.col("m") - F.col("other_at")) >= (F.col("n") + F.col("m")) * (least / (1 + least)) - 1e-9


def of_several_classes(members: DataFrame, key: str) -> DataFrame:
    """The values of ``key`` whose ``members`` have more than one root; written, as a hot key is joined with them."""
    ends = members.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    return stage(ends.where("lo != hi").select(key), f"several-{key}")


def missed_links(buckets: DataFrame, texts: DataFrame, compared: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of classes of ``roots`` (node, root) that a similar pair of texts in a large bucket connects.

    Only buckets whose texts are in several classes are looked at, and in them only pairs of texts of different classes,
    of fitting length, that share a shingle of their prefixes with enough left after it: all similar pairs are among these.
    """
    large = buckets.where(F.col("size") > SMALL_BUCKET).select("sketch", "text_id")
    rooted = large.join(roots.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    rooted = stage(rooted, "rooted")
    open_ids = rooted.join(of_several_classes(rooted, "sketch"), "sketch").select("text_id", "root").distinct()
    keys = stage(prefixes(stage(texts.join(open_ids, "text_id"), "open"), least), "prefixes")
    alive = stage(keys.join(of_several_classes(keys, "key"), "key"), "alive")
    others = alive.select("key", F.col("text_id").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"), F.col("at").alias("other_at"))
    pairs = alive.join(others, "key").where("text_id < other and root != other_root").where(close(least) & enough_left(least))
    fresh = pairs.select(*ordered(F.col("text_id"), F.col("other"))).distinct().join(compared.select("a", "b"), ["a", "b"], "left_anti")
    found = align(fresh, texts, least).where(F.col("similarity") >= least).select("a", "b")
    of = rooted.select("text_id", "root").distinct()
    named = found.join(of.toDF("a", "left"), "a").join(of.toDF("b", "right"), "b")
    return named.select(F.col("left").alias("a"), F.col("right").alias("b")).distinct()


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_key, n, root) for each row of ``docs``: rows of one root are near-duplicates, in one or more links.

    Links are all similar pairs of texts that share a sketch, however many share it. Texts without words have n = 0.
    Sketches are probable, not certain: at similarity 0.8 one is shared with probability 0.6 or so, and at least one of
    sixteen with more than 0.999999.
    """
    rows = stage(sketched(docs), "sketches")
    buckets, texts, compared = bucket_links(rows, least)
    roots = stage(components(compared.where(F.col("similarity") >= least).select("a", "b")), "roots")
    merged = components(stage(missed_links(buckets, texts, compared, roots, least), "missed")).toDF("root", "merged")
    slim = rows.select("doc_id", "text_key", "text_id", "n")
    joined = slim.join(roots.withColumnRenamed("node", "text_id"), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    return stage(joined.join(merged, "root", "left").select("doc_id", "text_key", "n", F.coalesce("merged", "root").alias("root")), "classes")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id, class_size.

    class_id is the smallest doc_id of the class. Documents without words (null, empty, marks only) are each a class of
    their own, as is a document without id, whose class_id is null unless others with ids share its class. Repeated rows
    of a document are one document. An empty table gives no rows.
    """
    found = classes(docs, least).distinct()
    sized = found.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    some = found.where("n > 0").join(sized, "root").select("doc_id", "class_id", "class_size")
    none = found.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return some.union(none)


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, all columns of ``docs``: the one with the smallest doc_id (null last), then text hash.

    Documents without words all stay. Rows that repeat a kept document's id and text are left out.
    """
    found = classes(docs, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k")
    kept = found.where("n > 0").groupBy("root").agg(first).select("k.doc_id", "k.text_key")
    bare = found.where("n = 0").select("doc_id", "text_key").distinct()
    copies = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("__copies")).toDF("__d", "__t", "__copies")
    same = lambda a, b: F.col(a).eqNullSafe(F.col("__d")) & (F.col(b) == F.col("__t"))
    keys = kept.union(bare).join(copies, same("doc_id", "text_key")).select("__d", "__t", "__copies")
    joined = docs.withColumn("__k", text_key()).join(keys, same("doc_id", "__k"))
    # nearly all documents occur in one row; only the others are gathered by key
    once = joined.where("__copies = 1").select(*docs.columns)
    again = joined.where("__copies > 1").dropDuplicates(["__d", "__t"]).select(*docs.columns)
    return once.union(again)
