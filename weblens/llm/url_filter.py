"""Page URLs against a list of canonical URL prefixes, by a blocked Bloom filter and a hash join.

A list entry is a host and the beginning of a path; it fits a URL of its host or of any subdomain
whose path starts so, and the longest entry decides. A URL is turned into the few keys that an
entry could have: its host cut to as many labels, its path cut to as many characters as entries
have. A blocked Bloom filter, one 64-bit word per key, drops nearly all keys that are not listed;
the possible hits meet the list in an exact join on the whole key, which removes false positives.
Only DataFrame functions are used. The filter has a fixed number of words, whatever the list.

Cases: a NULL url and one without `://` have an empty host and an empty path, which nothing fits.
Of entries of equal length the one with the longer host decides, then `block`. Repeated entries
count once. Equal URLs are judged once and every row gets its verdict. An empty list allows all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weblens.llm.store import again

#: Words of the filter and bits set per key. A list of n keys lets about (4n / (64 * WORDS))**4
#: of the others pass, the join none.
WORDS, BITS = 1 << 13, 4
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?` or `#`; A to Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to `?` or `#`."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(WORDS)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key within its word, taken from a second hash, six bits each."""
    h = F.xxhash64(F.lit("bits"), key)
    # shiftleft() takes no column as its second argument in the function API.
    bits = (F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function(
        "shiftright", h, F.lit(6 * k)).bitwiseAND(F.lit(63)).cast("int")) for k in range(BITS))
    return reduce(Column.bitwiseOR, bits)


def bloom(listed: DataFrame) -> DataFrame:
    """One row with the filter of all keys, an array of WORDS longs."""
    words = listed.groupBy(_word(F.col("key")).alias("at")).agg(F.bit_or(_mask(F.col("key"))).alias("bits"))
    every = listed.sparkSession.range(WORDS).select(F.col("id").cast("int").alias("at"))
    filled = every.join(words, "at", "left").select("at", F.coalesce("bits", F.lit(0)).alias("bits"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "bits"))), lambda x: x["bits"]).alias("words"))


def _labels(name: Column) -> Column:
    return F.length(name) - F.length(F.replace(name, F.lit("."), F.lit(""))) + 1


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule and verdict; of like-named columns only these stay.

    `rules` has host, path and verdict (`allow` or `block`).
    """
    added = ("host", "path", "rule", "verdict")
    given = [F.col(f"`{c}`") for c in pages.columns if c not in added]
    address = F.col(f"`{url}`").cast("string")
    listed = rules.where("host is not null and path is not null").select(
        F.concat("host", "path").alias("key"), F.length("host").alias("host_length"), F.length("path").alias("path_length"),
        _labels(F.col("host")).alias("labels"), (F.col("verdict") == "block").alias("blocks"))
    listed = listed.groupBy("key", "host_length", "path_length", "labels").agg(F.max("blocks").alias("blocks"))

    words = bloom(listed).scalar()
    labels = listed.agg(F.collect_set("labels")).scalar()
    lengths = listed.agg(F.collect_set("path_length")).scalar()
    urls = (
        pages.where(address.contains("://")).groupBy(address.alias("url")).agg(F.lit(0).alias("_"))
        .select("url", host(F.col("url")).alias("h"), path(F.col("url")).alias("p"),
                labels.alias("labels"), lengths.alias("lengths"))
    )
    keys = F.flatten(F.transform(
        F.filter("labels", lambda k: k <= _labels(F.col("h"))),
        lambda k: F.transform(
            F.filter("lengths", lambda n: n <= F.length("p")),
            lambda n: F.concat(F.call_function("substring_index", F.col("h"), F.lit("."), -k), F.left(F.col("p"), n)))))
    mask = _mask(F.col("key"))
    hits = urls.select("url", F.explode(F.array_distinct(keys)).alias("key")).where(
        F.get(words, _word(F.col("key"))).bitwiseAND(mask) == mask)
    decided = hits.join(listed, "key").groupBy("url").agg(
        F.max(F.struct(F.length("key").alias("length"), "host_length", "blocks", "key")).alias("best"))
    verdicts = decided.select(
        again("url").alias("key"), F.col("best.key").alias("rule"),
        F.when(F.col("best.blocks"), "block").otherwise("allow").alias("verdict"))
    keyed = pages.select(F.struct(*given).alias("row"), host(address).alias("host"), path(address).alias("path"),
                         F.xxhash64(F.lit("again"), address).alias("key"))
    return keyed.join(verdicts, "key", "left").select(
        "row.*", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict"))


#: The list that the registered query judges by.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)


def judged_pages(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    rules = pages.sparkSession.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge(pages.select("page_id", "url"), rules).drop("url")


def _fits(name: str, start: str) -> str:
    return f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{start}')"


_LONGEST_FIRST = sorted(RULES, key=lambda r: -len(r[0] + r[1]))

SQL = f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), ruled AS (
  SELECT page_id, host, path,
    CASE {' '.join(f"WHEN {_fits(h, p)} THEN '{h}{p}'" for h, p, _ in _LONGEST_FIRST)} END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
  CASE {' '.join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in _LONGEST_FIRST)}
    ELSE '{DEFAULT}' END AS verdict
FROM ruled
"""
