"""URL filter: short allow and block rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The list may be long. Its Bloom filter is a table of blocks, one row of eight 64-bit words each, built by a grouped OR. A
URL's key sets one bit in each word of a single block, so one lookup by block number decides whether the URL can be
listed. Only possible hits reach the exact hash join with the list, which removes the false positives: the
verdicts are those of the list alone, whatever the filter's size. Everything is a Spark expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import stage

WORDS = 8
#: Bits of the filter per listed URL: about one false positive in a thousand.
BITS = 16
#: Blocks that are broadcast at most, of some 100 bytes each; a larger filter is joined by a shuffle on the block.
MOST_BROADCAST = 200_000
#: Rules are part of the query's plan; longer lists belong into the list of URLs.
MOST_RULES = 200

# Query parameters that follow a visit and do not choose a page.
TRACKING = ["ref", "fbclid", "gclid", "sessionid"]
TRACKING_PREFIX = "utm_"


@dataclass(frozen=True)
class Rule:
    """``verdict`` ("allow" or "block") for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in ("allow", "block") or not self.host:
            raise ValueError(f"a rule needs a host and allows or blocks: {self}")

    @property
    def text(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """The URL behind its first ``://``; empty for null and where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling of a page's URL; empty for null and text without ``://``.

    The scheme, ``www.`` or ``m.`` before the host, a default port, slashes that repeat or end the path, the fragment and
    parameters that only follow visits go; the other parameters are sorted.
    """
    plain_host = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    plain_path = F.regexp_replace(F.regexp_replace(path(url), r"/+", "/"), r"/$", "")
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    name = lambda x: F.lower(F.substring_index(x, "=", 1))
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~name(x).isin(TRACKING) & ~F.startswith(name(x), F.lit(TRACKING_PREFIX)))
    parameters = F.array_join(F.array_sort(kept), "&")
    return F.concat(plain_host, plain_path, F.when(parameters != "", F.concat(F.lit("?"), parameters)).otherwise(F.lit("")))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(text, verdict) of the longest rule that fits, null for none. Of equal texts a block comes before an allow."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules; list URLs instead")
    found = F
    for rule in sorted(rules, key=lambda x: (-len(x.text), -len(x.host), x.text, x.verdict != "block")):
        here = (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
        found = found.when(here & F.startswith(path, F.lit(rule.path)), F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict")))
    return found if rules else F.lit(None).cast("struct<text:string,verdict:string>")


def block_of(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def bits_of(key: Column) -> list[Column]:
    """The bit that a key sets in each word of its block: six bits of a second hash for each."""
    second = F.xxhash64(key, F.lit("bits"))
    return [F.shiftrightunsigned(second, 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(WORDS)]


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """(block, words) of the filter over ``keys`` (key); blocks without a key have no row."""
    ones = [F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(f"w{k}") for k, bit in enumerate(bits_of(F.col("key")))]
    set_bits = keys.select(block_of(F.col("key"), n_blocks).alias("block"), *ones)
    words = [F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)]
    return set_bits.groupBy("block").agg(*words).select("block", F.array(*[f"w{k}" for k in range(WORDS)]).alias("words"))


def possible(key: Column, words: Column) -> Column:
    """Whether all the key's bits are set; false where the block has no row."""
    found = F.lit(True)
    for k, bit in enumerate(bits_of(key)):
        found = found & (F.getbit(words[k], bit) == 1)
    return F.coalesce(found, F.lit(False))


def url_verdicts(
    pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = (), most_broadcast: int = MOST_BROADCAST, bits: int = BITS
) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict.

    A rule decides where one fits; the verdict for other pages is "block" if their canonical URL is among those of
    ``listed`` (url), else "allow". Null URLs and text without ``://`` have an empty host and path and are never listed.
    Null page_ids and repeated rows stay, empty tables give no rows, an empty list blocks nothing, further
    columns are ignored. A URL that very many rows share is no group here: its rows are probed where they are, and the join
    of possible hits is one that Spark splits.
    """
    canon = canonical(F.col("url"))
    keys = stage(listed.select(canon.alias("key")).where("key != ''").distinct(), "listed-urls")
    n_blocks = max(1, -(-keys.count() * bits // (64 * WORDS)))
    blocks = bloom_filter(keys, n_blocks)
    parsed = pages.select(
        "page_id",
        host(F.col("url")).alias("host"),
        path(F.col("url")).alias("path"),
        canon.alias("key"),
        F.xxhash64("page_id", "url").alias("spread"),
    ).withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    # pages that a rule decides ask for no block; negative numbers spread them where the join is a shuffle
    asks = F.col("found").isNull() & (F.col("key") != "")
    parsed = parsed.withColumn("block", F.when(asks, block_of(F.col("key"), n_blocks)).otherwise(-1 - F.pmod(F.col("spread"), F.lit(1_000_000))))
    probed = parsed.join(F.broadcast(blocks) if n_blocks <= most_broadcast else blocks, "block", "left")
    probed = probed.withColumn("maybe", possible(F.col("key"), F.col("words")))
    given = [F.col("page_id"), F.col("host"), F.col("path"), F.col("found.text").alias("rule")]
    decided = probed.where(~F.col("maybe")).select(*given, F.coalesce("found.verdict", F.lit("allow")).alias("verdict"))
    hits = probed.where("maybe").join(keys.withColumn("listed", F.lit(True)), "key", "left")
    return decided.union(hits.select(*given, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict")))


def on_listed_hosts(pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """(url) of the pages whose host has one of ``words`` in it, between dots and hyphens."""
    names = F.split(host(F.col("url")), r"[.\-]")
    return pages.where(F.arrays_overlap(names, F.array(*[F.lit(x) for x in words]))).select("url")
