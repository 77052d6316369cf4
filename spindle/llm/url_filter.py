r"""URL filters: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact join.

Only DataFrame functions run here. The filter is a table of 256-bit blocks (four longs); a URL sets or
tests eight bits of one block. URLs that pass are joined exactly with the list, so a false positive of the
filter costs a row of that join and never a verdict.

Nulls and empties: a null url, or one without `://`, has empty host and path, fits no rule and is allowed.
Repeated urls and repeated ids each keep their own row. An empty list blocks nothing. Extra columns
are kept by `judge_urls`; a column of the input that clashes with an output name keeps the input's
values under `_name`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, require, table

#: The rules (host, path, verdict) of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: The list of the registered query: pages of hosts that have one of these labels, and, as a stand-in for single reported pages, pages whose id is
#: divisible by REPORTED.
LISTED_LABELS, REPORTED = ("spam-farm", "cheap-pills", "casino-win", "adult-x"), 100
BITS_PER_URL, BLOCK_BITS, PROBES, SALTS = 16, 256, 8, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased; empty without `://`."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for addresses of one page: no `www.` or `m.`, no default port, no closing `/`,
    `index.html` or `.html`; scheme, query and fragment are not part of it. A line feed at the end is a character like others."""
    h = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)\z", "")
    p = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?\z", ""), r"/+\z", "")
    return F.when(host == "", F.lit(None)).otherwise(F.concat(h, p))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host and path together) that fits; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long")


def _words(key: Column) -> list[Column]:
    """The four longs of a block with this key's eight bits set."""
    second = F.xxhash64(key, F.lit("bits"))
    bits = [F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(255)) for i in range(PROBES)]
    out = []
    for w in range(BLOCK_BITS // 64):
        mask = F.lit(0).cast("long")
        for b in bits:
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))
            mask = mask.bitwiseOR(F.when(F.shiftright(b, 6) == w, bit).otherwise(F.lit(0).cast("long")))
        out.append(mask)
    return out


def bloom_blocks(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter as a table (block, w0..w3): bits are or-ed within a block, first on each map side."""
    parts = listed.where(F.col(key).isNotNull()).select(
        _block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_words(F.col(key)))]
    )
    return parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_BITS // 64)])


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url", max_broadcast_mb: int = 32, bits_per_url: float = BITS_PER_URL
) -> DataFrame:
    """Adds host, path, rule and verdict. listed: one column of canonical URLs, the list to block.

    The filter is broadcast only if its number of blocks, counted from the list, proves it under
    max_broadcast_mb; beyond that it is joined by a shuffle on the block number. The exact join goes through
    distinct URLs of the possible hits, so a URL that many rows repeat is tested once; its rows are dealt
    over SALTS keys when they get its verdict."""
    require(pages, url)
    names = ("host", "path", "rule", "verdict")
    clash = [c for c in pages.columns if c.lower() in names]
    for c in clash:
        pages = pages.withColumnRenamed(c, fresh(pages, "_" + c)[0])
    block, key, hit, salt, bloom_words = fresh(pages, "block", "canon", "on_list", "salt", "bloom")
    want = listed.select(F.col(listed.columns[0]).alias(key)).where(F.col(key).isNotNull()).distinct()
    blocks = max(1, int(-(-want.count() * bits_per_url // BLOCK_BITS)))
    words = [f"w{i}" for i in range(BLOCK_BITS // 64)]
    bloom = bloom_blocks(want, key, blocks).select(F.col("block").alias(block), F.struct(*words).alias(bloom_words))
    small = blocks * (8 + 8 * len(words)) <= max_broadcast_mb << 20
    bloom = F.broadcast(bloom) if small else bloom

    seen = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": name, "verdict": says, key: canonical(F.col("host"), F.col("path"))})
    # only rows that no rule decides need the list
    open_key = F.when(F.col("verdict").isNull(), F.col(key))
    keys = seen.select(open_key.alias(key)).where(F.col(key).isNotNull()).distinct()
    passes = F.lit(True)
    for i, mask in enumerate(_words(F.col(key))):
        passes = passes & (F.col(f"{bloom_words}.w{i}").bitwiseAND(mask) == mask)
    possible = keys.withColumn(block, _block(F.col(key), blocks)).join(bloom, block).where(passes).select(key)
    hits = possible.join(want, key, "left_semi").select(key, F.lit(True).alias(hit), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    # rows that a rule decides get keys of their own that no host can have, so that they don't all meet in one task
    mixed = F.xxhash64(*[F.col(c) for c in pages.columns])
    own = F.coalesce(open_key, F.concat(F.lit("#"), mixed.cast("string")))
    out = seen.withColumns({key: own, salt: F.pmod(mixed, F.lit(SALTS)).cast("int")}).join(hits, [key, salt], "left")
    verdict = F.coalesce(F.col("verdict"), F.when(F.col(hit), F.lit("block")), F.lit("allow"))
    return out.withColumn("verdict", verdict).drop(key, hit, salt)


def listed_urls(pages: DataFrame, labels=LISTED_LABELS, reported: int = REPORTED, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Canonical URLs of the pages that hosts with a listed label serve, under any domain, and of the reported pages."""
    dotted = F.concat(F.lit("."), host_of(F.col(url)), F.lit("."))
    on = F.coalesce(F.col(id_col) % reported == 0, F.lit(False))
    for x in labels:
        on = on | dotted.contains(f".{x}.")
    return pages.where(on).select(canonical(host_of(F.col(url)), path_of(F.col(url))).alias("canonical")).distinct()


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, listed_urls(pages)).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
c AS (
  SELECT *, CASE WHEN host = '' THEN NULL ELSE
      regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') ||
      regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') END AS canon,
    '.' || host || '.' AS dotted,
    CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p),
listed AS (
  SELECT DISTINCT canon FROM c
  WHERE dotted LIKE '%.spam-farm.%' OR dotted LIKE '%.cheap-pills.%' OR dotted LIKE '%.casino-win.%' OR dotted LIKE '%.adult-x.%' OR page_id % 100 = 0)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN canon IN (SELECT canon FROM listed WHERE canon IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM c
"""
