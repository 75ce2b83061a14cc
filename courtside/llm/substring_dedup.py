"""Substring dedup by paragraphs: MinHash bands propose like paragraphs, the edit distance verifies the passage around them, and
components of the removals say which document keeps it.

Passages do not respect line ends, so a paragraph here is any PARAGRAPH consecutive words. Its band is one minimum over its
five-word shingles. Neighbouring paragraphs mostly share their minimum, so a text of n words has about n / 10
different ones: its seeds, each with its place. Equal paragraphs share their seed with certainty, like ones with the
probability of their Jaccard similarity, and a passage of 50 words holds 27 paragraphs.

A seed that a later document shares with an earlier one is a place where both texts may run alike. Seeds of two documents at
nearly the same shift form a chain; the words around it are aligned in a band of shifts, edits are bridged, and the
passage found is removed from the later document if it has LEAST_WORDS words and the edit similarity of both
sides is at least SIMILARITY. Every removal follows one earlier document, so text that repeats nowhere is left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import components, hashed_words, mix, rolling, signed, stage
from courtside.llm.near_dedup import similarity

SHINGLE = 5
PARAGRAPH = 24
SIMILARITY = 0.8
LEAST_WORDS = 50

#: Words on either side of a chain in which the passage's ends are looked for, in each step.
AROUND = 80
#: Seeds of two documents whose shifts lie in the same span of this many words are one chain.
SHIFTS = 64
#: How far the shift may move beyond the chain's seeds, the longest edit that is bridged, and the shortest run that counts.
DRIFT, BRIDGE, RUN = 8, 10, 3
#: Words of earlier documents are fetched in blocks of this many.
BLOCK = 64
#: Characters of text whose results are held at once.
HELD = 4_000_000

PLACE_BITS = 24
LATEST = (1 << 63) - 1


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each run of ``width`` values (all of them where there are fewer)."""
    width, size = min(width, len(values)), 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return values if size == width else np.minimum(values[: len(values) - (width - size)], values[width - size :])


def seeds(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the smallest shingle of each paragraph, every place once."""
    hashes = rolling(words, SHINGLE)
    places = []
    step, width, low = 1 << (PLACE_BITS - 1), PARAGRAPH - SHINGLE + 1, np.uint64((1 << PLACE_BITS) - 1)
    for start in range(0, len(hashes), step):  # the place in a section shares 64 bits with the hash
        part = hashes[start : start + step + width - 1]
        packed = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        places.append((sliding_minima(packed, width) & low).astype(np.int64) + start)
    found = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
    return hashes[found], found


def document_key() -> Column:
    """A document is its id and text: repeated rows are one document (a null text counts as empty)."""
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def portions(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in portions of about HELD characters of the texts in ``column``, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, before + HELD, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def all_seeds(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, m, place): the seeds of every text that is long enough to hold a passage; a null id counts as the last."""

    def cut(batches):
        for batch in batches:
            for some in portions(batch, 2):
                kept, counts, hashes, places = [], [], [], []
                for k, text in enumerate(some.column(2)):
                    words = hashed_words(text.as_py() or "")[0]
                    if len(words) >= LEAST_WORDS:
                        m, at = seeds(words)
                        kept.append(k)
                        counts.append(len(m))
                        hashes.append(m)
                        places.append(at)
                owner = pa.array(np.repeat(np.array(kept, np.int64), np.array(counts, np.int64)))
                join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(owner), some.column(1).take(owner), pa.array(signed(join(hashes, np.uint64))), pa.array(join(places, np.int64).astype(np.int32))],
                    ["doc", "doc_id", "m", "place"],
                )

    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(LATEST)).alias("doc_id")
    return docs.select(document_key().alias("doc"), order, "text").mapInArrow(cut, "doc long, doc_id long, m long, place int")


def chains(docs: DataFrame) -> DataFrame:
    """(doc, source, low, high, source_low, source_high): places of a document's seeds that an earlier document, the source, has as well.

    A seed's source is the first document that holds it, by doc_id. A seed that most documents hold (a common line)
    costs a row for each, never a pair: counts and minima are partial aggregates, the joins are ones that Spark splits.
    """
    found = stage(all_seeds(docs), "seeds")
    # written first: a join can split a hot key only where both sides come straight from a shuffle
    shared = stage(found.groupBy("m").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1").select("m", "least"), "repeated-seeds")
    # dealt by document again, so that a seed with very many rows is spread over the files, and its joins can be split
    held = stage(found.join(shared, "m").repartition("doc"), "shared-seeds")
    firsts = held.where("doc_id = least").groupBy("m").agg(F.min("doc").alias("source"))
    # the first document may hold a seed more than once: its first place counts
    places = held.where("doc_id = least").select("m", F.col("doc").alias("source"), "place").join(firsts, ["m", "source"])
    first = stage(places.groupBy("m", "source").agg(F.min("place").alias("source_place")), "first-seeds")
    pairs = held.select("m", "doc", "place").join(first, "m").where("doc != source")
    shift = F.floor((F.col("place") - F.col("source_place")) / SHIFTS)
    return pairs.groupBy("doc", "source", shift.alias("shift")).agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.min("source_place").alias("source_low"), F.max("source_place").alias("source_high"),
        F.min(F.col("place") - F.col("source_place")).alias("least_shift"), F.max(F.col("place") - F.col("source_place")).alias("most_shift"),
    )


def texts_of(keys: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, text) of the documents in ``keys`` (doc, distinct), one row each."""
    return docs.select(document_key().alias("doc"), "text").join(keys, "doc").dropDuplicates(["doc"])


def blocks_of(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(source, block, words) of the distinct ``asked`` (source, block): the hashes of those words, nothing past the text's end.

    A document's list of blocks is bounded by its own length.
    """

    def fetch(batches):
        for batch in batches:
            for some in portions(batch, 1):
                owners, numbers, found = [], [], []
                for k, (text, blocks) in enumerate(zip(some.column(1), some.column(2), strict=True)):
                    words = hashed_words(text.as_py() or "")[0]
                    for block in blocks.as_py():
                        part = words[block * BLOCK : (block + 1) * BLOCK]
                        if len(part):
                            owners.append(k)
                            numbers.append(block)
                            found.append(part.astype("<u4").tobytes())
                owner = pa.array(owners, pa.int64())
                yield pa.RecordBatch.from_arrays([some.column(0).take(owner), pa.array(numbers, pa.int32()), pa.array(found, pa.binary())], ["source", "block", "words"])

    lists = asked.groupBy("source").agg(F.collect_list("block").alias("blocks")).withColumnRenamed("source", "doc")
    joined = texts_of(lists, docs).select("doc", "text", "blocks")
    return joined.mapInArrow(fetch, "source long, block int, words binary")


def passages(b: np.ndarray, a: np.ndarray, shifts: tuple[int, int], least_words: int, least: float) -> list[tuple[int, int, int, int]]:
    """(b_low, b_high, a_low, a_high): stretches of ``b`` that run along ``a`` at a shift (place in b less place in a) near ``shifts``.

    A word counts if it is in a run of RUN equal words at one shift; stretches between such words of at most BRIDGE words are edits.
    """
    low, high = shifts[0] - DRIFT, shifts[1] + DRIFT
    n = len(b)
    # column k compares b[i] with a[i - low - k]; places outside of a match nothing
    at = np.arange(n)[:, None] - np.arange(low, high + 1)[None, :]
    equal = (at >= 0) & (at < len(a))
    equal &= a[np.clip(at, 0, max(0, len(a) - 1))] == b[:, None] if len(a) else False
    if n < RUN:
        return []
    run = equal[RUN - 1 :].copy()
    for k in range(RUN - 1):
        run &= equal[k : n - RUN + 1 + k]
    matched = np.zeros(equal.shape, bool)
    for k in range(RUN):
        matched[k : n - RUN + 1 + k] |= run
    places = np.flatnonzero(matched.any(1))
    if not len(places):
        return []
    shift = matched[places].argmax(1) + low
    breaks = np.flatnonzero((np.diff(places) > BRIDGE + 1) | (np.abs(np.diff(shift)) > BRIDGE)) + 1
    out = []
    for first, last in zip([0, *breaks], [*(breaks - 1), len(places) - 1], strict=True):
        b_low, b_high = int(places[first]), int(places[last]) + 1
        a_low, a_high = b_low - int(shift[first]), b_high - int(shift[last])
        if b_high - b_low < least_words or a_high <= a_low:
            continue
        whole = last - first + 1 == b_high - b_low and shift[first] == shift[last] and (shift[first : last + 1] == shift[first]).all()
        if whole or similarity(b[b_low:b_high].astype(np.uint64), a[a_low:a_high].astype(np.uint64), least) >= least:
            out.append((b_low, b_high, a_low, a_high))
    return out


def removals(docs: DataFrame, least_words: int = LEAST_WORDS, least: float = SIMILARITY) -> DataFrame:
    """(doc, low, high, source, source_low, source_high): words low..high of a document run along those of an earlier one."""
    linked = stage(chains(docs), "chains")
    first = F.greatest(F.col("source_low") - AROUND, F.lit(0))
    block = F.explode(F.sequence(F.floor(first / BLOCK).cast("int"), F.floor((F.col("source_high") + SHINGLE + AROUND) / BLOCK).cast("int")))
    wanted = linked.select("*", block.alias("block"))
    blocks = stage(blocks_of(wanted.select("source", "block").distinct(), docs), "source-words")
    sent = F.struct("source", "shift", "low", "high", "least_shift", "most_shift", "block", "words")
    gathered = wanted.join(blocks, ["source", "block"]).groupBy("doc").agg(F.collect_list(sent).alias("sent"))

    def align(batches):
        for batch in batches:
            for some in portions(batch, 1):
                rows = []
                for doc, text, sent in zip(some.column(0).to_pylist(), some.column(1), some.column(2), strict=True):
                    words = hashed_words(text.as_py() or "")[0].astype(np.uint32)
                    by_chain: dict[tuple, list] = {}
                    for x in sent.as_py():
                        by_chain.setdefault((x["source"], x["shift"]), []).append(x)
                    for (source, _), parts in by_chain.items():
                        parts.sort(key=lambda x: x["block"])
                        start = parts[0]["block"] * BLOCK
                        a = np.frombuffer(b"".join(x["words"] for x in parts), "<u4")
                        x = parts[0]
                        left = max(0, x["low"] - AROUND)
                        b = words[left : x["high"] + SHINGLE + AROUND]
                        moved = start - left
                        for b_low, b_high, a_low, a_high in passages(b, a, (x["least_shift"] + moved, x["most_shift"] + moved), least_words, least):
                            rows.append((doc, left + b_low, left + b_high, source, start + a_low, start + a_high))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "low", "high", "source", "source_low", "source_high"])

    schema = "doc long, low long, high long, source long, source_low long, source_high long"
    return texts_of(gathered, docs).select("doc", "text", "sent").mapInArrow(align, schema)


def keepers(removed: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, kept_by): for each document that loses passages the ids of the documents that keep them.

    A removal whose source loses that passage itself, at least half of it, is linked with that removal. A component of
    linked removals is one passage; it is kept by the first of the sources that do not lose it.
    """
    name = F.xxhash64("doc", "low", "high", "source", "source_low")
    named = stage(removed.withColumn("id", name), "removals")
    there = named.select(F.col("doc").alias("source"), F.col("low").alias("o_low"), F.col("high").alias("o_high"), F.col("id").alias("other"))
    overlap = F.least("source_high", "o_high") - F.greatest("source_low", "o_low")
    links = stage(
        named.join(there, "source").where(2 * overlap >= F.col("source_high") - F.col("source_low")).select(F.col("id").alias("a"), F.col("other").alias("b")), "removal-links"
    )
    roots = stage(components(links), "passage-classes")
    classed = named.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lost = links.select(F.col("a").alias("id")).distinct()
    ids = docs.select(document_key().alias("source"), F.col("doc_id").alias("kept")).dropDuplicates(["source"])
    sources = classed.join(lost, "id", "left_anti").join(ids, "source")
    kept = sources.groupBy("root").agg(F.min("kept").alias("kept"))
    return classed.select("doc", "root").distinct().join(kept, "root").groupBy("doc").agg(F.sort_array(F.collect_set("kept")).alias("kept_by"))


def cut_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Character spans to remove and their words, for runs of words that may overlap."""
    _, starts, _ = hashed_words(text)
    merged: list[list[int]] = []
    for a, b in sorted(runs):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    # the marks and spaces after the last word go with it
    return [(int(starts[a]), int(starts[b]) if b < len(starts) else len(text), b - a) for a, b in merged]


def _without(docs: DataFrame, least_words: int, least: float) -> DataFrame:
    """(row, text, removed, kept_by) for each row of ``docs``; ``row`` holds its columns."""
    slim = docs.select("doc_id", "text")
    found = stage(removals(slim, least_words, least), "passages")
    runs = found.groupBy("doc").agg(F.collect_set(F.struct("low", "high")).alias("runs")).join(keepers(found, slim), "doc", "left")

    schema = "struct<text string, removed array<struct<start:int,end:int,n_words:int>>>"
    removed_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32())]))

    # over Arrow arrays: with pandas every Python worker of an executor would hold that library as well
    @F.arrow_udf(schema)
    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        new, gone = [], []
        for text, some in zip(texts, runs, strict=True):
            old = text.as_py()
            spans = cut_spans(old, [(x["low"], x["high"]) for x in some.as_py()])
            kept, end = [], 0
            for a, b, _ in spans:
                kept.append(old[end:a])
                end = b
            new.append("".join([*kept, old[end:]]).rstrip())
            gone.append([{"start": a, "end": b, "n_words": n} for a, b, n in spans])
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(gone, removed_type)], ["text", "removed"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), document_key().alias("doc"))
    joined = rows.join(runs, "doc", "left")
    done = joined.where("runs is not null").select("row", cut("row.text", "runs").alias("cut"), F.coalesce("kept_by", F.array()).alias("kept_by"))
    none = joined.where("runs is null").select(
        "row", F.col("row.text").alias("text"), F.lit(None).cast("array<struct<start:int,end:int,n_words:int>>").alias("removed"), F.lit(None).cast(done.schema["kept_by"].dataType).alias("kept_by")
    )
    return done.select("row", "cut.text", "cut.removed", "kept_by").union(none)


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with its repeated passages removed from ``text``, and two columns: removed (spans), first_doc_ids.

    ``removed`` has (start, end, n_words) in code points of the old text and is null for documents that keep all of it;
    ``first_doc_ids`` has the documents that keep the passages. A passage stays in the document with the smallest
    doc_id (null last) and is removed from all others; repeats within one document stay. Each row of ``docs`` gives one row;
    rows alike in id and text are one document and are treated alike. Null, empty and short texts stay as they are, an
    empty table gives no rows. Columns of ``docs`` that are named as the two new ones are replaced.
    """
    found = _without(docs, least_words, least)
    others = [c for c in docs.columns if c not in ("text", "removed", "first_doc_ids")]
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in others], "text", "removed", F.col("kept_by").alias("first_doc_ids"))


def passages_removed(docs: DataFrame) -> DataFrame:
    """doc_id, removed_words, kept_chars, removed, first_doc_ids of the documents that lose a passage; repeated rows once each."""
    found = deduplicated(docs.select("doc_id", "text")).where("removed is not null")
    words = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["n_words"])
    return found.select("doc_id", words.alias("removed_words"), F.length("text").alias("kept_chars"), "removed", "first_doc_ids")


def without_repeats(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, repeated passages removed; documents of which nothing but marks is left go."""
    found = _without(docs, LEAST_WORDS, SIMILARITY)
    left = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", "")) > 0
    kept = found.where(F.col("removed").isNull() | left)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
