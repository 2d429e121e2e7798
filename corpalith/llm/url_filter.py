"""URL filter: host and path rules first, then a blocked Bloom filter and an exact hash join.

The filter is a table of 512-bit blocks (eight 64-bit words). A key sets one bit in each word of
one block. Its size follows the number of listed URLs up to ``MAX_BLOCKS``, so the broadcast is
bounded (16 MB of bits at most); beyond that only the share of false positives grows, and the
exact join of possible hits against the listed URLs removes every one of them.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpalith.llm.common import ascii_lower, durable, hot_join, like

WORDS = 8
KEYS_PER_BLOCK = 32
MAX_BLOCKS = 1 << 18

#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` and default port, path without index file and last ``/``, the query's
    parameters sorted without tracking ones; scheme and fragment don't count. Null for no URL."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.html?$", "/"), r"/+$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s)[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (host, path prefix, verdict) that fits; null for none."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _bits(key: str) -> list[Column]:
    """A mask with one bit for each word of a block."""
    return [F.expr(f"shiftleft(1L, cast(pmod(xxhash64({key}, {i}), 64) as int))") for i in range(WORDS)]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7) of the hashes ``keys(h)``."""
    masks = _bits("h")
    rows = keys.select(F.pmod("h", F.lit(blocks)).alias("block"), *(m.alias(f"w{i}") for i, m in enumerate(masks)))
    return rows.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url") -> DataFrame:
    """(page_id, host, path, canonical, rule, possible, verdict) for every row.

    A rule decides first. Otherwise a URL whose canonical form is listed is blocked and any other
    is allowed. ``possible`` is what the filter alone says. Null and malformed URLs have empty host
    and path and are allowed; an empty list blocks nothing by itself. Repeated rows stay.
    """
    known = like(listed, listed_col).select(canonical(F.col(f"`{listed_col}`")).alias("c")).where("c is not null").groupBy("c").agg(F.xxhash64(F.first("c")).alias("h"))
    known = durable(known)
    blocks = min(MAX_BLOCKS, max(1, ceil(known.count() / KEYS_PER_BLOCK)))
    bits = bloom_filter(known.select("h"), blocks)

    rows = like(pages, id_col, url_col).toDF("page_id", "url")
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("ruled"), F.xxhash64(F.coalesce("canonical", F.lit(""))).alias("h"))
    rows = rows.withColumn("at", F.pmod("h", F.lit(blocks)))
    probed = rows.join(F.broadcast(bits), F.col("at") == F.col("block"), "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(m) != 0 for i, m in enumerate(_bits("h"))])
    # Kept once, as both kinds of rows are taken from it: the pages are read and cut up a single time.
    probed = durable(probed.select("page_id", "host", "path", "canonical", "rule", "ruled", "h", F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False)).alias("possible")))

    out = ["page_id", "host", "path", "canonical", "rule", "possible"]
    clear = probed.where("not possible").select(*out, F.coalesce("ruled", F.lit("allow")).alias("verdict"))
    exact = known.select(F.col("c"), F.col("h").alias("kh"))
    maybe = hot_join(probed.where("possible"), exact, [("h", "kh"), ("canonical", "c")], "left")
    return clear.union(maybe.select(*out, F.coalesce("ruled", F.when(F.col("c").isNotNull(), "block").otherwise("allow")).alias("verdict")))
