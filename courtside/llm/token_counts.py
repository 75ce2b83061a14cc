"""Token counts from flat token files without an index: the file is only ids, each document ended by an end id.

A file is cut into blocks of equal size wherever they fall. Within a block numpy finds all end ids at once; a prefix
scan over the blocks' small summaries then gives each block the number of ends before it and the place of the last one,
which closes the documents that cross blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import checkpoint_dir
from courtside.llm.tokens import encoder

#: Ids are unsigned little-endian 16-bit; 0 ends a document, so the tokenizer's ids are stored plus one.
ITEM, END = 2, 0
LINE_SEP = "\x00" * ITEM
BLOCK_TOKENS = 1 << 16
#: Bytes of one file, unless a single document has more: binaryFile reads a file as one value.
FILE_BYTES = 32 << 20
#: The kinds of files, a folder each.
IDS, ORDER = 0, 1


def document_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")))


def write_flat(docs: DataFrame, path: str, tokenizer: str, files: int | None = None) -> DataFrame:
    """Write the ids of all texts to flat files and return the order of documents: doc_id, shard, ordinal.

    Each task writes the documents of its own partition, so that no ids are shuffled; it starts a new file when one is full.
    Which document stands where is written by the same task beside the ids, so both come from the same attempt. With
    ``files`` the documents are dealt over that many tasks first, by a hash of id and text. The text writer is used as a
    writer of bytes: its line separator is the end id.
    """

    most = FILE_BYTES

    def encode(batches):
        ids_of = encoder(tokenizer).ids
        first = TaskContext.get().partitionId() << 20
        part = ordinal = held = 0
        for batch in batches:
            shards, places, values, lines = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.frombuffer(ids_of(text.as_py()), "<u4")
                if len(ids) and ids.max() >= (1 << 16) - 1:
                    raise ValueError("the tokenizer's ids do not fit into 16 bits")
                # what the order's line takes counts too: both files stay within the bound
                size = ITEM * len(ids) + 32
                if held and held + size > most:
                    part, ordinal, held = part + 1, 0, 0
                shards.append(first + part)
                places.append(ordinal)
                values.append((ids + 1).astype("<u2").tobytes())
                lines.append(f"{ordinal} {doc_id}".encode())
                ordinal, held = ordinal + 1, held + size
            for kind, found in ((IDS, values), (ORDER, lines)):
                kinds = pa.array(np.full(len(found), kind, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [kinds, pa.array(shards, pa.int64()), pa.array(places, pa.int64()), pa.array(found, pa.binary())], ["kind", "shard", "place", "value"]
                )

    dealt = docs.select("doc_id", "text") if files is None else docs.select("doc_id", "text").repartition(files, document_key())
    placed = dealt.mapInArrow(encode, "kind int, shard long, place long, value binary").sortWithinPartitions("kind", "shard", "place")
    written = placed.select("kind", "shard", F.col("value").cast("string").alias("value"))
    written.write.partitionBy("kind", "shard").option("lineSep", LINE_SEP).text(path)
    lines = docs.sparkSession.read.schema("value string, shard long").option("lineSep", LINE_SEP).text(f"{path}/kind={ORDER}")
    place, doc_id = F.split("value", " ")[0], F.split("value", " ")[1]
    return lines.select(doc_id.try_cast("long").alias("doc_id"), "shard", place.cast("long").alias("ordinal"))


def read_blocks(spark: SparkSession, path: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The blocks of the files of ids under ``path``, one file for each shard: shard, block, content."""
    size = block_tokens * ITEM
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/kind={IDS}").where("length > 0")
    last = F.floor((F.col("length") - 1) / size).cast("int")
    return found.select(F.col("shard").cast("long").alias("shard"), "content", F.explode(F.sequence(F.lit(0), last)).alias("block")).select(
        "shard", "block", F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("content")
    )


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """Per block: tokens, ends, the places of the first and last end (null without), tokens between its own ends."""

    def scan(batches):
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                ends = np.flatnonzero(ids == END)
                some = len(ends) > 0
                rows.append((len(ids), len(ends), int(ends[0]) if some else None, int(ends[-1]) if some else None, np.diff(ends) - 1))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("shard"), batch.column("block"), *[pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)]],
                ["shard", "block", "tokens", "ends", "first", "last", "inner"],
            )

    shard = blocks.schema["shard"].dataType.simpleString()
    return blocks.mapInArrow(scan, f"shard {shard}, block int, tokens long, ends long, first long, last long, inner array<long>")


def stitch(scanned: DataFrame) -> DataFrame:
    """Lengths of all documents from the blocks' summaries: shard, ordinal, n_tokens, closed.

    Prefix sums over a file's blocks; ids after a file's last end are a last document with closed = false.
    """
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = scanned.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn(
        "ordinal", F.coalesce(F.sum("ends").over(before), F.lit(0))
    )
    open_ = at.withColumn("previous", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1)))
    own = open_.where("ends > 0").select(
        "shard", "ordinal", F.posexplode(F.concat(F.array(F.col("start") + F.col("first") - F.col("previous") - 1), "inner")).alias("i", "n_tokens")
    )
    whole = scanned.groupBy("shard").agg(F.sum("tokens").alias("t"), F.sum("ends").alias("ordinal"))
    last = open_.groupBy("shard").agg(F.max(F.col("start") + F.col("last")).alias("last"))
    tail = whole.join(last, "shard").select("shard", "ordinal", (F.col("t") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"))
    return own.select("shard", (F.col("ordinal") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed")).union(
        tail.where("n_tokens > 0").select("shard", "ordinal", "n_tokens", F.lit(False).alias("closed"))
    )


def count_tokens(docs: DataFrame, tokenizer: str, files: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write the tokens of ``docs`` to flat files in the shared folder, scan them, and return doc_id, n_tokens, shard, ordinal.

    One row per row of ``docs``; null and empty texts count 0 tokens; null ids and repeated rows stay. The end id is
    not counted. Each partition of ``docs`` gives its own files; ``files`` deals the rows over that many first. No rows give no rows.
    """
    spark = docs.sparkSession
    if docs.limit(1).count() == 0:
        return docs.select("doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_tokens", "shard", "ordinal")])
    path = f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    order = write_flat(docs, path, tokenizer, files)
    counts = stitch(scan_blocks(read_blocks(spark, path, block_tokens)))
    return order.join(counts, ["shard", "ordinal"]).select("doc_id", "n_tokens", "shard", "ordinal")
