"""Quality rules as weak supervision: rules vote or abstain, EM learns how far each can be trusted.

Only DataFrame functions touch the rows. The driver sees one row per combination of votes, at most
3 ** len(RULES), however many documents there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import stage

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rule:
    """Votes +1 where ``good`` holds, else -1 where ``bad`` holds, else 0."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]

    def vote(self) -> Column:
        chosen = F.when(self.good(), 1).when(self.bad(), -1).otherwise(0)
        return F.coalesce(chosen, F.lit(0)).cast("int").alias(self.name)


def share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


RULES = [
    Rule("v_length", lambda: F.col("n_words").between(80, 20_000), lambda: F.col("n_words") < 40),
    Rule("v_word_size", lambda: share("word_chars", "n_words").between(3, 9), lambda: ~share("word_chars", "n_words").between(2, 14)),
    Rule("v_symbols", lambda: share("n_symbols", "n_words") < 0.03, lambda: share("n_symbols", "n_words") > 0.2),
    Rule("v_lines", lambda: share("n_dup_lines", "n_lines") < 0.05, lambda: share("n_dup_lines", "n_lines") > 0.3),
    Rule("v_repeats", lambda: share("n_repeat_words", "n_words") < 0.15, lambda: share("n_repeat_words", "n_words") > 0.35),
    Rule("v_capitals", lambda: share("n_upper", "n_letters") < 0.2, lambda: share("n_upper", "n_letters") > 0.5),
    Rule("v_letters", lambda: share("n_letters", "word_chars") > 0.85, lambda: share("n_letters", "word_chars") < 0.65),
    Rule("v_marks", lambda: share("n_stops", "n_words").between(0.01, 0.3), lambda: share("n_stops", "n_words") > 0.6),
]


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts per document: the base columns, and letters, capitals, lines and stops for further rules.

    A word is a run of characters other than the space and U+0009-U+000D. Null texts count as empty.
    Repeated words: a text's windows of three words are sorted, equal neighbours are windows found twice or more,
    and the positions under such windows are counted once each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text")).withColumn("w", F.array_remove(F.split("text", SPACE), ""))
    n = F.size("w")
    windows = F.when(
        n >= 3,
        F.transform(
            F.arrays_zip(
                F.slice("w", 1, n - 2).alias("a"), F.slice("w", 2, n - 2).alias("b"), F.slice("w", F.lit(3), n - 2).alias("c")
            ),
            lambda x, i: F.struct(F.concat_ws(" ", x["a"], x["b"], x["c"]).alias("g"), i.alias("p")),
        ),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    letters = F.regexp_replace("text", r"\P{L}+", "")
    counted = read.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(letters, r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        (F.length("text") - F.length(F.translate("text", ".!?", ""))).cast("long").alias("n_stops"),
        F.sort_array(windows).alias("s"),
    )
    paired = counted.withColumn(
        "pairs", F.when(F.size("s") >= 2, F.arrays_zip(F.col("s").alias("x"), F.slice("s", F.lit(2), F.size("s") - 1).alias("y")))
    )
    covered = F.flatten(
        F.transform(
            F.filter("pairs", lambda z: z["x"]["g"] == z["y"]["g"]),
            lambda z: F.array(*[z[k]["p"] + step for k in "xy" for step in range(3)]),
        )
    )
    return paired.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.size(F.array_distinct(covered)), F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_letters",
        "n_upper",
        "n_stops",
    )


@dataclass
class VoteModel:
    """The share of good documents and, per rule, how often its votes are right."""

    prior: float
    accuracy: dict[str, float]

    def posterior(self) -> Column:
        """Probability of good quality from the vote columns."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, right in self.accuracy.items():
            odds = odds + F.col(name) * math.log(right / (1 - right))
        return 1 / (1 + F.exp(-odds))


def fit_votes(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = 200) -> VoteModel:
    """EM over vote patterns and their counts, abstentions taken as no evidence.

    Starts from accuracies of 0.8 and a prior of 0.8; accuracies stay within 0.55 and 0.99 (a rule is never
    read against its meaning), the prior within 0.05 and 0.95. Each accuracy is smoothed by ten votes at 0.8.
    """
    prior, right = 0.8, [0.8] * len(names)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good, hits, votes = 0.0, [8.0] * len(names), [10.0] * len(names)
        for pattern, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(v * math.log(r / (1 - r)) for v, r in zip(pattern, right, strict=True))
            p = 1 / (1 + math.exp(-odds))
            good += n * p
            for k, v in enumerate(pattern):
                if v:
                    votes[k] += n
                    hits[k] += n * (p if v > 0 else 1 - p)
        new = min(0.95, max(0.05, good / total)), [min(0.99, max(0.55, h / v)) for h, v in zip(hits, votes, strict=True)]
        moved = abs(new[0] - prior) + sum(abs(a - b) for a, b in zip(new[1], right, strict=True))
        prior, right = new
        if moved < 1e-9:
            break
    return VoteModel(prior, dict(zip(names, right, strict=True)))


def quality_rules(docs: DataFrame, rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, votes, p_good, base_failed, kept.

    ``base_failed``: under 50 words, or more than half of the words in repeated windows. ``kept``: not failed
    and p_good >= ``least``. Null and empty texts have no words and fail. The counts are staged: texts are
    read once, then the votes are counted and, with the learnt weights, scored from the stage.
    """
    rules = RULES if rules is None else rules
    names = [rule.name for rule in rules]
    votes = stage(text_statistics(docs), "statistics").select("*", *[rule.vote() for rule in rules])
    patterns = [(tuple(row[:-1]), row[-1]) for row in votes.groupBy(*names).count().collect()]
    model = fit_votes(sorted(patterns), names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return votes.select("doc_id", *BASE, *names, model.posterior().alias("p_good"), failed.alias("base_failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("p_good") >= least)
    )
