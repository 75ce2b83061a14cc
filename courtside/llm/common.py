"""What several operators share: staged tables, hashes of words, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master only."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="llm-")
        context.setCheckpointDir(found)
    return found


#: Bytes of one batch of rows that goes to a Python worker, at most (one row where that is more).
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Let the session cut batches for Python workers by bytes: texts differ too much in length to count rows.

    A batch lies in memory several times, in the JVM and in the worker. A smaller setting of the session's own stays.
    """
    found = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(BATCH_SETTING).lower())
    current = int(found[1]) << 10 * ["", "k", "m", "g"].index(found[2]) if found else 0
    if not 0 < current <= BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back.

    What follows starts from that table: an executor that is lost later costs no recomputation, and each
    later read takes only the columns it needs.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: What frees the tables that a Python worker builds for words, and those for a tokenizer. Workers outlive an operator.
TABLES: dict[str, list[Callable[[], None]]] = {"words": [], "tokens": []}


def hold(kind: str) -> None:
    """Called where a table of ``kind`` is built: frees those of the other kinds, so that a worker never keeps all of them."""
    for other, frees in TABLES.items():
        if other != kind:
            for free in frees:
                free()


class WordHashes(dict):
    """64-bit hashes of words, whatever their case. It forgets all when it holds ``most`` words, which bounds its memory."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One cache per Python worker, shared by all operators.
HASHES = WordHashes()


@lru_cache(maxsize=1)
def code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point: whether it is part of a word (what WORD matches), and a random number for its lower case."""
    hold("words")
    every = range(0x110000)
    lower = (ord(low) if len(low := c.lower()) == 1 else ord(c) for c in map(chr, every))
    numbers = np.fromiter(lower, np.uint64, len(every))
    return np.fromiter(map(str.isalnum, map(chr, every)), bool, len(every)), mix(numbers + np.uint64(1))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as the longest text so far needs."""

    base = np.uint64(0x9E3779B97F4A7C15)
    inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            cls.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, cls.base))])
            cls.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, cls.inverse))])
        return cls.up[:n], cls.down


@lru_cache(maxsize=1)
def exact_numbers() -> np.ndarray:
    """A random number for every code point."""
    return mix(np.arange(1, 0x110001, dtype=np.uint64))


TABLES["words"] += [HASHES.clear, code_points.cache_clear, exact_numbers.cache_clear]


def span_hashes(points: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]], numbers: np.ndarray | None = None) -> list[np.ndarray]:
    """64-bit hashes of spans (starts, ends) of a text's code points; ``numbers`` gives each point's own.

    A span's hash is a polynomial in its characters' numbers: one running sum over the text holds them all, a
    span's is the difference at its ends divided by the power at its start.
    """
    up, down = Powers.of(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((exact_numbers() if numbers is None else numbers)[points] * up[: len(points)], out=sums[1:])
    return [mix((sums[ends] - sums[starts]) * down[starts]) for starts, ends in spans]


def hashed_words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the text's words whatever their case, and the places where each starts and ends; the words are those of WORD."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    in_word, numbers = code_points()
    inside = np.zeros(len(points) + 2, np.int8)
    inside[1:-1] = in_word[points]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    return span_hashes(points, [(starts, ends)], numbers)[0], starts, ends


def words_of(text: str | None) -> list[str]:
    """The words of a text: runs of letters and digits, in lower case."""
    return WORD.findall((text or "").lower())


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words; of the whole where there are fewer, none where there are no words."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    width = min(width, len(hashes))
    out = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for step in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[step : step + len(out)] + np.uint64(1)
    return mix(out)


def signed(values: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return np.ascontiguousarray(values, np.uint64).view(np.int64)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) per node, root the smallest node.

    Alternates large-star and small-star steps, each a grouped minimum and a join: no neighbour list is ever
    gathered, so a node with a third of all edges is a partial aggregate and a join that Spark can split.
    Each round is cut by ``checkpoint``. Raises when ``most_rounds`` do not settle the labels: no partial result.
    """
    checkpoint_dir(edges.sparkSession)

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # both directions for the large star, each edge from its larger end for the small star
        seen = pairs.union(pairs.select("b", "a")).toDF("a", "b") if large else pairs
        least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        joined = seen.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    ends = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = mark(ends)
    for _ in range(most_rounds):
        ends = star(star(ends, True), False).checkpoint()
        now = mark(ends)
        if now == before:
            roots = ends.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return ends.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
