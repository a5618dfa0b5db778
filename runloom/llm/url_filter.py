"""URL filter: longest path rule, else exact list membership by a Bloom filter cascade.

The cascade's first level holds the listed keys. The second holds the keys of
the corpus's whole key universe that the first lets through though they are
not listed, the third the listed keys that the second lets through, and so on
until a level lets none through. For every key of the universe the answer is
exact, and no join is needed: each level is a literal.

The first level has as many bits a key as let about as many keys of the
universe through as are listed, so all levels together take about
1.44 log2(universe / listed) + 13 bits a listed key, whatever the universe's
size. A list whose level would pass MAX_BITS is refused with an error.

Only DataFrame functions are used. Null urls and urls without "://" have an
empty host and path, fit no rule and are not listed. Of a host only as many
labels are looked at as the longest listed key has, so hosts and urls of any
length take time in proportion. Repeated rows are judged each; an empty table
gives no rows; further columns of the input don't matter.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm.common import ascii_lower, cut, let


@dataclass(frozen=True)
class Level:
    """One Bloom filter: bits as 64-bit words, a JSON array."""

    words: str
    bits: int
    hashes: int
    salt: int

    def holds(self, key: Column) -> Column:
        def all_set(words: Column) -> Column:
            found = None
            for j in range(self.hashes):
                at = _position(key, self.salt, j, self.bits)
                bit = F.getbit(F.element_at(words, F.shiftright(at, 6).cast("int") + 1), at.bitwiseAND(F.lit(63)).cast("int")) == 1
                found = bit if found is None else found & bit
            return found

        return let(F.from_json(F.lit(self.words), "array<bigint>"), all_set)


def _position(key: Column, salt: int, j: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt), F.lit(j)), F.lit(bits).cast("bigint"))


def suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains of at most so many labels, each a key."""

    def ends(labels: Column) -> Column:
        n = F.size(labels)
        return F.transform(F.sequence(F.greatest(n - (most - 1), F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n), "."))

    return let(F.split(host, r"\.", -1), ends)


def most_labels(listed: DataFrame) -> int:
    return listed.agg(F.max(F.size(F.split("key", r"\.", -1))).alias("n")).first().n or 1


def key_universe(hosts: DataFrame, most: int) -> DataFrame:
    """Distinct keys of the column host. Hosts are made distinct first, so a hot host is one row."""
    return hosts.select("host").where("host <> ''").distinct().select(F.explode(suffixes(F.col("host"), most)).alias("key")).distinct()


MAX_BITS = 1 << 28


def _level(keys: DataFrame, n: int, salt: int, bits_per_key: float) -> Level:
    bits = 64 * max(1, math.ceil(n * bits_per_key / 64))
    if bits > MAX_BITS:
        raise ValueError(f"a filter level of {bits} bits: the list is too long for a cascade of literals")
    hashes = max(1, round(bits / n * math.log(2)))
    at = F.explode(F.array(*[_position(F.col("key"), salt, j, bits) for j in range(hashes)]))
    rows = (
        keys.select(at.alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("v"))
        .collect()  # bits / 64 rows at most
    )
    words = [0] * (bits // 64)
    for r in rows:
        words[r.w] = r.v
    return Level(json.dumps(words), bits, hashes, salt)


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: float = 6.0) -> list[Level]:
    """Levels for exact membership in listed over universe, frames of a column key.

    The first level has bits_per_key or more, as its number of false positives
    wants; of each later one about a twentieth of the keys before are left.
    """
    inside, outside = listed.select("key").where("key is not null").distinct(), cut(universe.join(listed.select("key"), "key", "left_anti"))
    turn, other, levels = inside, outside, []
    ratio = max(2.0, outside.count() / max(1, inside.count()))
    each = max(bits_per_key, math.log2(ratio) / math.log(2))
    while (n := turn.count()) and len(levels) < 64:
        levels.append(_level(turn, n, len(levels) + 1, each))
        turn, other = cut(other.where(levels[-1].holds(F.col("key")))), turn
        each = bits_per_key
    return levels


def in_cascade(key: Column, levels: Sequence[Level]) -> Column:
    """Exact for keys of the universe: listed if the walk stops after an odd number of levels."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        answer = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(answer)
    return answer


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, nulls if none fits. rules: (verdict, "host/path")."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], blocked: Sequence[str] | DataFrame, url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """keep..., host, path, rule, verdict, listed.

    blocked: domains, as a list or a frame with a column key; a host is listed
    if it or a parent domain is.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    judged = pages.select(*keep, host.alias("host"), path.alias("path"))
    listed = cut(_keys(spark, blocked))
    most = most_labels(listed)
    levels = build_cascade(cut(key_universe(judged, most)), listed)
    hit = F.exists(suffixes(F.col("host"), most), lambda s: in_cascade(s, levels)) if levels else F.lit(False)
    judged = judged.withColumn("listed", (F.col("host") != "") & hit)
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def _keys(spark: SparkSession, blocked: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(blocked, DataFrame):
        return blocked.select(ascii_lower(F.col("key")).alias("key"))
    return spark.range(1).select(F.explode(F.array(*[F.lit(x.lower()) for x in blocked]) if blocked else F.array().cast("array<string>")).alias("key"))


#: Production parameters: fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BLOCKED = tuple(f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills", "casino-win") for top in ("com", "net", "org"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages, RULES, BLOCKED)


SQL = (
    """
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), cut AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(verdict, rule) AS (VALUES %s
), blocked(key) AS (VALUES %s
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM cut JOIN rules ON (host = split_part(rule, '/', 1) OR host LIKE '%%.' || split_part(rule, '/', 1))
    AND starts_with(path, substr(rule, instr(rule, '/')))
  GROUP BY page_id
), hit AS (
  SELECT DISTINCT host FROM cut JOIN blocked ON host = key OR ends_with(host, '.' || key)
)
SELECT page_id, host, path, fit.rule AS rule,
       coalesce(fit.verdict, CASE WHEN hit.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       hit.host IS NOT NULL AS listed
FROM cut LEFT JOIN fit USING (page_id) LEFT JOIN hit USING (host)
"""
    % (", ".join(f"('{v}', '{r}')" for v, r in RULES), ", ".join(f"('{b}')" for b in BLOCKED))
)
