"""URL filters: rules over hosts and paths, and a list of canonical URLs.

The list is held twice: as a blocked Bloom filter, a table of 256-bit blocks, and as the list itself. Each
distinct URL looks at one block. What the filter lets through meets the list in an exact hash join, so the
filter only saves work and never decides. All of it is column work.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 256
WORDS = 4  # longs in a block
PROBES = 6  # bits a key sets in its block
BITS_PER_KEY = 16


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(text: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#``; empty without ``://`` or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?`` or ``#``; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """The form the list is kept in: host without ``www.`` or ``m.``, path without a closing slash or ``.html``."""
    return F.concat(
        F.regexp_replace(host, r"^(?:www|m)\.", ""), F.regexp_replace(path, r"(?:/|\.html)$", "")
    )


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(name, verdict) of the longest rule that fits, null if none does. Rules are a short configuration.

    Rules of equal length that fit one URL can differ only in where the host ends; the longer host wins.
    """
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        here = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, here).otherwise(found)
    return found


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _masks(key: Column) -> list[Column]:
    """The bits a key sets in its block, as one long for each word of the block."""
    drawn = F.xxhash64(key, F.lit("bits"))
    masks = [F.lit(0).cast("long")] * WORDS
    for probe in range(PROBES):
        bit = F.shiftrightunsigned(drawn, probe * 8).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
        for word in range(WORDS):
            here = F.when(F.shiftright(bit, 6) == word, F.expr("1L")).otherwise(F.lit(0).cast("long"))
            masks[word] = masks[word].bitwiseOR(F.call_function("shiftleft", here, bit.bitwiseAND(F.lit(63))))
    return masks


def bloom_filter(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The blocked Bloom filter of the non-null keys, as a table (block, w0..w3), and its number of blocks.

    Its size follows the number of rows in ``keys``, which is counted first. Blocks without keys have no row.
    """
    blocks = max(1, -(-keys.where(F.col(key).isNotNull()).count() * BITS_PER_KEY // BLOCK_BITS))
    held = keys.where(F.col(key).isNotNull()).select(
        _block(F.col(key), F.lit(blocks)).alias("block"),
        *[mask.alias(f"w{i}") for i, mask in enumerate(_masks(F.col(key)))],
    )
    return held.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible_hits(keys: DataFrame, key: str, filter_table: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``keys`` that the filter cannot rule out. ``keys`` holds each key once."""
    probe = keys.withColumn("_block", _block(F.col(key), F.lit(blocks)))
    for i, mask in enumerate(_masks(F.col(key))):
        probe = probe.withColumn(f"_m{i}", mask)
    passes = [F.col(f"w{i}").bitwiseAND(F.col(f"_m{i}")) == F.col(f"_m{i}") for i in range(WORDS)]
    both = probe.join(filter_table, F.col("_block") == F.col("block"))
    for test in passes:
        both = both.where(test)
    return both.select(*keys.columns)


def judge_urls(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """A verdict for each row of ``pages(page_id, url)``; other columns are ignored.

    ``listed(canonical)`` names the canonical URLs to block where no rule speaks; repeats and nulls in it
    are harmless, and an empty list blocks nothing. Returns page_id, host, path, rule (name or null),
    verdict. Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and no
    list entry and is allowed; repeated rows each keep their own result; no rows give no rows.
    """
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn(
        "_url", F.when(F.col("_rule").isNull() & (F.col("host") != ""), canonical(F.col("host"), F.col("path")))
    )
    names = listed.select(F.col("canonical").alias("_url")).where(F.col("_url").isNotNull()).distinct()
    table, blocks = bloom_filter(names, "_url")
    asked = ruled.where(F.col("_url").isNotNull()).select("_url").distinct()
    hits = possible_hits(asked, "_url", table, blocks).join(names, "_url", "left_semi")
    # Rows that ask nothing get a key of their own, else they would all meet as nulls in one task.
    own = F.coalesce("_url", F.xxhash64("page_id", "host", "path").cast("string"))
    keyed = ruled.withColumn("_key", own).withColumn("_asked", F.col("_url").isNotNull())
    found = hits.select(F.col("_url").alias("_key"), F.lit(True).alias("_asked"), F.lit(True).alias("_hit"))
    return keyed.join(found, ["_key", "_asked"], "left").select(
        "page_id",
        "host",
        "path",
        F.col("_rule.name").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("_hit"), "block"), F.lit("allow")).alias("verdict"),
    )
