"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of the templates
are joined by hash, and what stands in the placeholders must map one to one, so a question with other numbers
and names is found as well, and a chance likeness of templates is not.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import code_points, rolling, signed, span_hashes

#: Units of measure that a number may stand before.
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg lb lbs oz t ml l gal s sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months "
    "year years meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres dollar dollars euro "
    "euros cent cents percent % € $ £ °".split()
)
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"

WINDOW = 8
#: A window needs this many literal words: placeholders alone say nothing.
LITERALS = 4
#: Items without such a window are looked for in their own words, from this many tokens on anywhere in a text; shorter ones must be the whole text.
LEAST_TOKENS = 4
#: The share of an item's windows that one alignment must hold.
COVERAGE = 0.5
#: Windows of the benchmark whose hashes are broadcast at most (8 bytes each) to leave out other windows early.
MOST_HASHES = 4_000_000
#: Windows of the benchmark that are broadcast whole at most (some 100 bytes each); beyond it the hash join is a shuffle.
MOST_BROADCAST = 100_000


#: Kinds of characters, a bit each.
LETTER, DIGIT, CAPITAL, WORD_CHARACTER, SIGN = (1 << k for k in range(5))
LITERAL, IS_NUMBER, IS_NAME, IS_UNIT = range(4)


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kinds of every code point: capitals are those of the Latin-1, Greek and Cyrillic alphabets."""

    def of(c: str) -> int:
        alnum, digit = c.isalnum(), c.isdecimal()
        capital = "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" or "Α" <= c <= "Ω" or "А" <= c <= "Я"
        return LETTER * (alnum and not digit) | DIGIT * digit | CAPITAL * capital | WORD_CHARACTER * alnum | SIGN * (c in "%€$£°")

    return np.fromiter(map(of, map(chr, range(0x110000))), np.uint8, 0x110000)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of true flags start and end."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[::2], edges[1::2]


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the placeholders, by kind, and of the units, sorted."""
    word = lambda x: span_hashes(np.array([ord(c) for c in x], "<u4"), [(np.array([0]), np.array([len(x)]))], code_points()[1])[0][0]
    return np.array([0, word(NUMBER), word(NAME), word(UNIT)], np.uint64), np.array(sorted(map(word, UNITS)), np.uint64)


class Template:
    """A text's tokens: their kinds, places, hashes of the template and of the words themselves.

    Tokens are runs of letters, numbers (with points and commas inside) and the signs %, €, $, £, °. A number is a placeholder,
    and so is a unit that follows one. A name is a capitalised run, not all in capitals, that follows another word in its
    sentence. All others are literal, whatever their case.
    """

    def __init__(self, text: str | None):
        self.text = text or ""
        points = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = kinds()[points]
        starts, ends = runs_of((kind & LETTER) > 0)
        numbers, number_ends = runs_of((kind & DIGIT) > 0)
        if len(numbers) > 1:
            between = points[number_ends[:-1]]
            apart = np.concatenate([[True], ~((numbers[1:] - number_ends[:-1] == 1) & ((between == 0x2E) | (between == 0x2C)))])
            numbers, number_ends = numbers[apart], number_ends[np.concatenate([np.flatnonzero(apart)[1:] - 1, [len(number_ends) - 1]])]
        signs = np.flatnonzero(kind & SIGN)
        before = lambda k: points[np.maximum(starts - k, 0)] * (starts >= k)
        kind_before = lambda k: kind[np.maximum(starts - k, 0)] * (starts >= k)
        follows = (before(1) == 0x20) & (((kind_before(2) & WORD_CHARACTER) > 0) | ((before(2) == 0x2C) & ((kind_before(3) & WORD_CHARACTER) > 0)))
        second = kind[np.minimum(starts + 1, max(0, len(kind) - 1))] * (starts + 1 < len(kind))
        names = follows & ((kind[starts] & CAPITAL) > 0) & ((second & CAPITAL) == 0)
        every = np.concatenate([starts, numbers, signs])
        order = np.argsort(every, kind="stable")
        self.starts, self.ends = every[order], np.concatenate([ends, number_ends, signs + 1])[order]
        self.kinds = np.concatenate([np.where(names, IS_NAME, LITERAL), np.full(len(numbers), IS_NUMBER), np.zeros(len(signs), np.int64)])[order]
        self.plain = span_hashes(points, [(self.starts, self.ends)], code_points()[1])[0]
        placeholders, units = constants()
        after_number = np.flatnonzero((self.kinds[1:] == LITERAL) & (self.kinds[:-1] == IS_NUMBER)) + 1
        if len(after_number):
            self.kinds[after_number[np.isin(self.plain[after_number], units)]] = IS_UNIT
        self.hashes = np.where(self.kinds == LITERAL, self.plain, placeholders[self.kinds])

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows, and which of them have enough literal words; none in a shorter text."""
        if len(self.hashes) < WINDOW:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        held = np.concatenate([[0], np.cumsum(self.kinds != LITERAL)])
        return rolling(self.hashes, WINDOW), WINDOW - (held[WINDOW:] - held[:-WINDOW]) >= LITERALS

    def slots(self, at: int) -> list[dict]:
        """The (place, value) of the placeholders in the window at token ``at``."""
        stop = min(at + WINDOW, len(self.kinds))
        return [{"place": k - at, "value": self.text[self.starts[k] : self.ends[k]].lower()} for k in range(at, stop) if self.kinds[k] != LITERAL]


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` are in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(hashes), bool)
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def template_windows(rows: DataFrame, key: str, only: object = None) -> DataFrame:
    """(key, at, n_windows, hash, slots) of every window of each text in ``rows`` (key, text).

    ``slots`` has the (place in the window, value) of placeholders. ``only`` is a broadcast of sorted hashes: windows
    outside it are left out before they reach the join.
    """
    schema = f"{key} long, at int, n_windows int, hash long, slots array<struct<place:int,value:string>>"

    def cut(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Template(text.as_py())
                hashes, good = found.windows()
                n_windows = int(good.sum())
                if only is not None:
                    good = good & among(hashes, only.value)
                for at in np.flatnonzero(good).tolist():
                    out[0].append(owner)
                    out[1].append(at)
                    out[2].append(n_windows)
                    out[3].append(hashes[at])
                    out[4].append(found.slots(at))
            kinds_ = [pa.int64(), pa.int32(), pa.int32()]
            columns = [pa.array(x, k) for x, k in zip(out, kinds_, strict=False)]
            columns.append(pa.array(signed(np.array(out[3], np.uint64))))
            columns.append(pa.array(out[4], pa.list_(pa.struct([("place", pa.int32()), ("value", pa.string())]))))
            yield pa.RecordBatch.from_arrays(columns, [key, "at", "n_windows", "hash", "slots"])

    return rows.select(key, "text").mapInArrow(cut, schema)


def exact_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, n, hash) of the items that have no window: the number of their tokens, and a hash of their own words."""

    def cut(batches):
        for batch in batches:
            ids, sizes, hashes = [], [], []
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = Template(text.as_py())
                if len(found.plain) and not found.windows()[1].any():
                    ids.append(owner)
                    sizes.append(len(found.plain))
                    hashes.append(rolling(found.plain, len(found.plain))[0])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signed(np.array(hashes, np.uint64)))], ["item_id", "n", "hash"])

    return benchmark.where("item_id is not null").select("item_id", "text").mapInArrow(cut, "item_id long, n int, hash long").distinct()


def exact_leaks(keyed: DataFrame, items: DataFrame) -> DataFrame:
    """(text_key, item_id): texts of ``keyed`` (text_key, text) that hold an exact item, word for word.

    Items of fewer than LEAST_TOKENS tokens must be the whole text: a word or two say nothing elsewhere. The lengths of the items,
    and in the usual case their hashes, are all that is sent along; without such items the texts are not read.
    """
    lengths = sorted(row["n"] for row in items.select("n").distinct().collect())
    if not lengths:
        return keyed.where("false").select("text_key", F.lit(None).cast("long").alias("item_id"))
    known = items.select("hash").distinct().limit(MOST_HASHES + 1).toPandas()["hash"].to_numpy(np.int64)
    only = keyed.sparkSession.sparkContext.broadcast(np.sort(known.view(np.uint64))) if len(known) <= MOST_HASHES else None

    def cut(batches):
        for batch in batches:
            owners, sizes, hashes = [], [], []
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                plain = Template(text.as_py()).plain
                for n in lengths:
                    if n == len(plain) or LEAST_TOKENS <= n < len(plain):
                        found = np.unique(rolling(plain, n))
                        found = found if only is None else found[among(found, only.value)]
                        owners += [owner] * len(found)
                        sizes += [n] * len(found)
                        hashes += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signed(np.array(hashes, np.uint64)))], ["text_key", "n", "hash"])

    found = keyed.select("text_key", "text").mapInArrow(cut, "text_key long, n int, hash long")
    return found.join(items, ["n", "hash"]).select("text_key", "item_id").distinct()


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(text_key, item_id, coverage): texts of ``docs`` that hold an item of ``benchmark``, in its words or re-parameterised.

    Joined windows are gathered by text, item and alignment (place in the text less place in the item), at most an
    item's length each. An alignment counts if it holds at least ``coverage`` of the item's windows and its placeholders
    map one to one: the same value of the item always meets the same value of the text, and the other way
    round. The key is a hash of the text: equal texts share one row, and a null text is empty.
    Short items (fewer than five tokens) match nothing. Items that repeat an item_id are one item.
    """
    spark = docs.sparkSession
    items = template_windows(benchmark.where("item_id is not null"), "item_id").dropDuplicates(["item_id", "at", "hash"])
    hashes = items.select("hash").distinct()
    only = None
    known = hashes.limit(MOST_HASHES + 1).toPandas()["hash"].to_numpy(np.int64)
    if len(known) <= MOST_HASHES:
        only = spark.sparkContext.broadcast(np.sort(known.view(np.uint64)))
    keyed = docs.select(text_key(F.col("text")).alias("text_key"), "text")
    found = template_windows(keyed, "text_key", only).select("text_key", F.col("at").alias("t_at"), "hash", F.col("slots").alias("t_slots"))
    small = items.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    joined = found.join(F.broadcast(items) if small else items, "hash").where(F.size("slots") == F.size("t_slots"))
    pairs = F.transform(F.arrays_zip("slots", "t_slots"), lambda z: F.struct(z["slots"]["value"].alias("a"), z["t_slots"]["value"].alias("b")))
    aligned = joined.select("text_key", "item_id", (F.col("t_at") - F.col("at")).alias("shift"), "at", "n_windows", pairs.alias("pairs"))
    gathered = aligned.groupBy("text_key", "item_id", "shift").agg(
        F.countDistinct("at").alias("hits"), F.max("n_windows").alias("n_windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")
    )
    one_to_one = (F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"])))) & (
        F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["b"])))
    )
    share = F.col("hits") / F.greatest(F.col("n_windows"), F.lit(1))
    held = gathered.where(one_to_one & (share >= coverage))
    exact = exact_leaks(keyed, exact_items(benchmark)).select("text_key", "item_id", F.lit(1.0).alias("coverage"))
    return held.select("text_key", "item_id", share.alias("coverage")).union(exact).groupBy("text_key", "item_id").agg(F.max("coverage").alias("coverage"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage) for each document and each item it holds; repeated rows of a document count once."""
    found = leaks(docs, benchmark, coverage)
    ids = docs.select("doc_id", text_key(F.col("text")).alias("text_key")).distinct()
    return ids.join(found, "text_key").select("doc_id", "item_id", "coverage")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item of ``benchmark``; all columns, null and empty texts and ids stay."""
    found = leaks(docs, benchmark, coverage).select(F.col("text_key").alias("key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_key(F.col("text")).alias("key"))
    return rows.join(found, "key", "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
