"""URL filters: prefix rules, and a list of URLs behind a blocked Bloom filter with an exact join.

Listed URLs are brought to a canonical form and hashed. The hash names one block of the filter (256 bits in
four longs) and `PROBES` bits in it; `or` of the bits per block is the filter, a table with one row per block
that has bits. A page whose bits are all set in its block is a possible hit; only possible hits go on to the
hash join with the list itself, which removes false positives. So the result is exact, whatever the filter's
rate of false positives.

Scale: the filter is broadcast up to `BROADCAST_BLOCKS` blocks (40 bytes each); a longer list has a larger filter, which
pages meet in a shuffled join, so it filters as well for any length. Distinct canonical URLs of the possible hits are
formed per task before they are shuffled to the list; where pages join, the rows of one URL are dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh
from ._graph import salted

#: Bits per listed URL, bits per block, bits set per URL.
BITS_PER_URL, BLOCK, PROBES = 16, 256, 6
BROADCAST_BLOCKS = 1 << 18
#: Query parameters that say how a reader came, not what the page is.
TRACKING = r"utm_[a-z]+|ref|fbclid|gclid"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? or # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. and default port, path without a last slash, and the query's parameters but for tracking
    ones, sorted; scheme and fragment don't count. Null without ://."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    path = F.rtrim(path_of(url), F.lit("/"))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)"))
    asked = F.concat_ws("&", F.array_sort(kept))
    whole = F.concat(host, path, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(F.lit("")))
    return F.when(url.contains("://"), whole)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host + path prefix, its verdict) of the longest of the (verdict, host, path) rules that fits."""
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _block_and_bits(url: Column, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL, and its bits there as four longs."""
    block = F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")
    more = F.xxhash64(url, F.lit(1))  # PROBES bytes of it say which bits
    places = [F.shiftrightunsigned(more, 8 * i).bitwiseAND(BLOCK - 1) for i in range(PROBES)]
    words = []
    for w in range(BLOCK // 64):
        word = F.lit(0).cast("long")
        for at in places:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
            word = word.bitwiseOR(F.when(F.shiftright(at, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return block, words


def bloom(listed: DataFrame, url_col: str, blocks: int) -> DataFrame:
    """The blocked filter of a column of canonical URLs: block, w0..w3."""
    block, words = _block_and_bits(F.col(url_col), blocks)
    names = [f"w{i}" for i in range(len(words))]
    bits = listed.select(block.alias("block"), *[w.alias(n) for w, n in zip(words, names, strict=True)])
    return bits.groupBy("block").agg(*[F.bit_or(n).alias(n) for n in names])


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: list[tuple[str, str, str]],
    url_col: str = "url",
    listed_col: str = "url",
    listed_rows: int | None = None,
) -> DataFrame:
    """`pages` with host, path, rule, verdict, possible (passed the filter) and listed (is on the list).

    The verdict is the longest fitting rule's; else `block` for a listed URL and `allow` for any other. A null
    URL, or one without ://, has empty host and path, fits no rule, is never listed and is allowed. Rows that
    repeat are each judged. New columns get names that don't clash. `listed_rows` is a known count of the list
    (else it is counted).
    """
    n = listed.count() if listed_rows is None else listed_rows
    blocks = max(1, -(-n * BITS_PER_URL // BLOCK))
    c_host, c_path, c_rule, c_verdict, c_possible, c_listed, c_canon, c_block, on_list, *c_words = fresh(
        pages, "host", "path", "rule", "verdict", "possible", "listed", "canon", "block", "on_list", "w0", "w1", "w2", "w3"
    )
    canon_list = listed.select(canonical(F.col(listed_col)).alias("key")).filter("key is not null").distinct()
    table = bloom(canon_list, "key", blocks).toDF(c_block, *c_words)
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    rule, said = longest_rule(F.col(c_host), F.col(c_path), rules)
    seen = pages.withColumns({c_host: host, c_path: path, c_canon: canonical(url)})
    seen = seen.withColumns({c_rule: rule, c_verdict: said})
    block, words = _block_and_bits(F.col(c_canon), blocks)
    seen = seen.withColumn(c_block, block)
    if blocks <= BROADCAST_BLOCKS:
        seen = seen.join(F.broadcast(table), c_block, "left")
    else:  # pages without a URL are in no block; by number, so that they and those of one URL are in no single task
        none = -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1 << 30)).cast("int")
        seen = salted(seen.withColumn(c_block, F.coalesce(c_block, none)), table, c_block, F.monotonically_increasing_id(), "left")
    all_set = F.lit(True)
    for have, want in zip(c_words, words, strict=True):
        all_set = all_set & (F.col(have).bitwiseAND(want) == want)
    seen = seen.withColumn(c_possible, F.coalesce(all_set & F.col(c_canon).isNotNull(), F.lit(False)))
    seen = seen.drop(c_block, *c_words)
    hits = seen.filter(c_possible).select(F.col(c_canon).alias("key")).distinct()
    true_hits = hits.join(canon_list, "key", "left_semi").select(F.col("key").alias(c_canon), F.lit(True).alias(on_list))
    checked = salted(seen.filter(c_possible), true_hits, c_canon, F.monotonically_increasing_id(), "left")
    checked = checked.withColumn(c_listed, F.coalesce(on_list, F.lit(False))).drop(on_list)
    rest = seen.filter(~F.col(c_possible)).withColumn(c_listed, F.lit(False))
    both = checked.unionByName(rest).select(*pages.columns, c_host, c_path, c_rule, c_verdict, c_possible, c_listed)
    return both.withColumn(
        c_verdict, F.coalesce(c_verdict, F.when(F.col(c_listed), F.lit("block")).otherwise(F.lit("allow")))
    )
