"""URL rules by a blocked Bloom filter and an exact hash join, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each listed key, words of a block, bits of a word.
BITS_A_KEY, WORDS, WORD_BITS = 16, 8, 32
#: The filter is broadcast up to so many blocks (of 64 bytes); a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 17
MULTIPLIERS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


def canonical(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null or without ``://``. Only A-Z of the host are lower-cased."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    given = F.coalesce(at > 0, F.lit(False))
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(given, lower).otherwise(""), F.when(given, path).otherwise("")


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """One bit number in each word of the key's block."""
    low = F.xxhash64(key).bitwiseAND(F.lit(0x7FFFFFFF))  # products stay below 2**63
    return [F.shiftrightunsigned((low * F.lit(m)).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for m in MULTIPLIERS]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, w0 .. w7): a block's words have one bit set by each key, so a probe reads one row."""
    one = F.lit(1).cast("long")
    marks = keys.select(_block(F.col("key"), blocks).alias("block"), *[F.call_function("shiftleft", one, b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])
    return marks.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def passes(key: Column) -> Column:
    """Whether all of the key's bits are set in the block joined to it."""
    out = F.lit(True)
    for i, b in enumerate(_bits(key)):
        out = out & (F.call_function("getbit", F.col(f"w{i}"), b) == 1)
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    ``rules`` (host, path, verdict) list canonical urls: a rule fits its host and all subdomains where the url's path
    starts with its own; the longest of host and path wins (then the greater text). A url that no rule fits has a null
    rule and the ``default`` verdict: it isn't listed. Null urls and urls without ``://`` have an empty host and path
    and fit none. Repeated rows are judged alike; repeated rules count once, with their least verdict.

    Distinct (host tail, path head) pairs are probed, not rows: a hot host costs one probe, and rows come back by a
    join that adaptive execution can split. Of a host only as many last labels matter as the longest rule has, of a
    path only as many characters; of these, the lengths that occur in rules. So candidates of a url are bounded by the
    rules, not by its length.
    """
    key = F.concat_ws("\n", "host", "path")
    listed = rules.filter("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("key", key)
    facts = listed.agg(F.count("*"), F.max(F.size(F.split("host", r"\."))), F.collect_set(F.length("path"))).first()
    count, labels, lengths = facts[0], facts[1] or 1, sorted(facts[2])
    host, path = canonical(F.col("url"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    if not count:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rows = rows.withColumns({"tail": F.substring_index("host", ".", -labels), "head": F.substring("path", 1, lengths[-1])})
    probes = rows.filter("host <> ''").select("tail", "head").distinct()
    # Suffixes of the tail's labels, and prefixes of the head of each listed length.
    suffixes = F.array(*[F.substring_index("tail", ".", -n) for n in range(1, labels + 1)])
    prefixes = F.array(*[F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in lengths])
    probes = probes.withColumn("host", F.explode(F.array_distinct(suffixes))).withColumn("path", F.explode(prefixes)).filter("path is not null").withColumn("key", key)
    blocks = 1
    while blocks * WORDS * WORD_BITS < count * BITS_A_KEY:
        blocks *= 2
    bloom = bloom_filter(listed, blocks)
    if blocks <= BROADCAST_BLOCKS:
        bloom = F.broadcast(bloom)
    probes = probes.withColumn("block", _block(F.col("key"), blocks)).join(bloom, "block").filter(passes(F.col("key")))
    rule = F.concat("host", "path")
    hits = probes.select("tail", "head", "key").join(listed, "key")
    best = hits.groupBy("tail", "head").agg(F.max(F.struct(F.length(rule).alias("size"), rule.alias("rule"), F.col("verdict"))).alias("best"))
    out = rows.join(best, ["tail", "head"], "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
