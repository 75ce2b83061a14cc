"""Best-fit packing by a histogram of lengths: the plan is made over counts, documents then take planned slots."""

from __future__ import annotations

import bisect
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import stage
from courtside.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"
#: Pieces of one length that are numbered in one group, about; a length that most pieces have is cut into as many groups as that takes.
GROUP = 500_000
LEAST_GROUPS = 64


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Cut each document's ids, followed by ``end_id``, into pieces of at most ``capacity``.

    Rows: doc_id, piece, start, length, ids_crc32, salt. Null texts are empty: one piece with the end id alone.
    Every row of ``docs`` is a document of its own, so repeated rows and null ids stay.
    """

    def cut(batches):
        ids_of, width = encoder(tokenizer).ids, 4 * capacity
        end = end_id.to_bytes(4, "little")
        made = 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    crc = zlib.crc32(part)
                    made += 1  # repeated rows get salts of their own
                    rows.append((doc_id, piece, at // 4, len(part) // 4, crc, (crc ^ 0x9E3779B1 * made) & 0x7FFFFFFF))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")]
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over counts: (number of sequences, [(length, pieces of it in each)]).

    Lengths are taken from the longest down; all pieces of one length are placed at once. Open sequences are kept as
    classes of equal content, by free room; each length fills the tightest class that takes it. The work depends on the
    number of lengths, not of pieces.
    """
    room: dict[int, list[list]] = {}  # free room -> classes [sequences, content]
    order: list[int] = []  # the free rooms in use, ascending
    done = []

    def put(free: int, number: int, content: list) -> None:
        if free == 0:
            done.append((number, content))
            return
        if free not in room:
            room[free] = []
            bisect.insort(order, free)
        room[free].append([number, content])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (at := bisect.bisect_left(order, length)) < len(order):
            free = order[at]
            number, content = room[free].pop()
            if not room[free]:
                del room[free]
                order.pop(at)
            each = min(free // length, left)
            take = min(number, left // each)
            if number > take:
                put(free, number - take, content)
            put(free - each * length, take, [*content, (length, each)])
            left -= each * take
        each = capacity // length
        if left >= each:
            put(capacity - each * length, left // each, [(length, each)])
        if left % each:
            put(capacity - left % each * length, 1, [(length, left % each)])
    return done + [tuple(x) for classes in room.values() for x in classes]


def slot_runs(plans: list[tuple[int, list[tuple[int, int]]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots (length, first rank, sequences, first sequence, each, first offset) that cover every rank once."""
    runs, ranks, sequence = [], {}, 0
    for number, content in plans:
        offset = 0
        for length, each in content:
            rank = ranks.get(length, 0)
            runs.append((length, rank, number, sequence, each, offset))
            ranks[length] = rank + number * each
            offset += length * each
        sequence += number
    return runs


def runs_by_length(spark: SparkSession, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """(length, runs): the runs of each length by rising first rank. One row per length, and as many runs as the plan has classes."""
    held: dict[int, list] = {}
    for length, *run in runs:
        held.setdefault(length, []).append(tuple(run))
    schema = "length long, runs array<struct<first:long,number:long,sequence:long,each:long,offset:long>>"
    return spark.createDataFrame([(length, sorted(found)) for length, found in held.items()], schema)


def placed(ranked: DataFrame, runs: DataFrame) -> DataFrame:
    """``ranked`` (length, rank) with sequence_id and offset: the run that holds the rank, then arithmetic.

    No slot is ever listed, so a run may hold any number of pieces.
    """
    # a run that starts at rank 0 comes first, so at least one starts at or before any rank
    run = F.element_at("runs", F.size(F.filter("runs", lambda x: x["first"] <= F.col("rank"))))
    found = ranked.join(F.broadcast(runs), "length").withColumn("run", run)
    into = F.col("rank") - F.col("run.first")
    sequence, nth = F.expr("run.sequence + (rank - run.first) div run.each"), into % F.col("run.each")
    return found.withColumns({"sequence_id": sequence, "offset": F.col("run.offset") + nth * F.col("length")}).drop("runs", "run")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Give each row of ``pieces`` (with length and salt, at most ``capacity`` long) a sequence_id and an offset.

    The histogram has at most ``capacity`` rows, whatever the input: it alone goes to the driver, and the plan's runs of
    slots, one row per length, are all that is broadcast. A piece's rank within its length is its rank within a group of
    the length (by salt) plus what the groups before it hold; there are as many groups as keep each small, so a length
    that a third of the pieces share is spread. ``pieces`` must be a staged or otherwise repeatable table: it is read
    several times. An empty table gives no rows.
    """
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    groups = max([LEAST_GROUPS, *(-(-n // GROUP) for n in counts.values())])
    dealt = pieces.withColumn("salt", F.pmod(F.col("salt"), F.lit(groups)))
    counted = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        dealt.withColumn("place", F.row_number().over(within))
        .join(first, ["length", "salt"])
        .withColumn("rank", F.col("base") + F.col("place") - 1)
    )
    runs = runs_by_length(pieces.sparkSession, slot_runs(plan(counts, capacity)))
    return placed(ranked, runs).drop("base", "place", "rank", "salt")


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """All documents, tokenised and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The pieces (without ids) are staged, so texts are tokenised once.
    """
    pieces = stage(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
