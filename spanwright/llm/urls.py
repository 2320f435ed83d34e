"""URL filters: a Bloom filter cascade, in DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: (rule, verdict): a host, and the beginning of its path from the first slash on.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words that name a kind of unwanted host, by category. What is listed is a table of hosts: `listed_hosts` makes one from
#: hosts that carry such a word as a label, or as a part of one between hyphens; a list from elsewhere can take its place.
CATEGORIES = {
    "adult": ["adult", "porn", "sex", "xxx"],
    "gambling": ["bet", "bets", "betting", "casino", "gambling", "poker", "slots"],
    "malware": ["malware", "phish", "phishing", "virus", "warez"],
    "pharmacy": ["pharmacy", "pills", "viagra"],
    "spam": ["spam", "spammy"],
    "tracking": ["ads", "adserver", "doubleclick", "track", "tracker", "tracking"],
}
WORDS = sorted(w for own in CATEGORIES.values() for w in own)
LISTED_HOST = r"(?:^|[.\-])(?:" + "|".join(WORDS) + r")(?:$|[.\-])"
#: From the last such label on.
LISTED_DOMAIN = r"(?s)^(?:.*\.)?((?:[^.]*-)?(?:" + "|".join(WORDS) + r")(?:-[^.]*)?(?:\..*)?)$"
#: Bits of one level that go into a query plan at most; beyond, keys are judged shard by shard.
MOST_BITS = 1 << 23
#: Levels of a cascade at most; each leaves half of the rest or fewer, so this is never met in practice.
LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? or #. Otherwise both empty."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def domains(host: Column, labels: list[int]) -> Column:
    """Of the host and the domains above it those with so many labels as one of `labels`: what a rule or a list of hosts
    with those numbers of labels could name. A host costs a few passes over it, however many labels it has."""
    size = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    own = F.array(*(F.when(size >= n, F.substring_index(host, ".", -n)) for n in labels)) if labels else F.array().cast("array<string>")
    return F.filter(own, lambda h: h.isNotNull())


def rule_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """Every rule that could fit: each domain with as many labels as some rule's, with each beginning of the path that is as
    long as some rule's."""
    lengths, labels = sorted({len(r) - r.index("/") for r in rules}), sorted({r[: r.index("/")].count(".") + 1 for r in rules})
    beginnings = F.array(*(F.when(F.length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in lengths))
    keys = F.transform(domains(host, labels), lambda h: F.transform(beginnings, lambda p: F.concat(h, p)))
    return F.filter(F.flatten(keys), lambda k: k.isNotNull())


class Level:
    """A Bloom filter as one literal: the bits, how many, and how many hashes."""

    def __init__(self, bits: bytearray, size: int, hashes: int, number: int):
        self.bits, self.size, self.hashes, self.number = bits, size, hashes, number

    def positions(self, key: Column) -> list[Column]:
        return bit_positions(key, self.number, self.size, self.hashes)

    def passes(self, key: Column) -> Column:
        bits = F.lit(self.bits)

        def bit(p: Column) -> Column:
            byte = F.conv(F.hex(F.substr(bits, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, (p % 8).cast("int")) == 1

        return reduce(lambda a, b: a & b, map(bit, self.positions(key)))


def bit_positions(key: Column, number: int, size: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(number), F.lit(k)), F.lit(size)) for k in range(hashes)]


def build_level(keys: DataFrame, count: int, rate: float, number: int) -> Level:
    """A filter of `count` keys that passes about `rate` of the others. Only its bits, bounded by the count, come to the driver."""
    size = max(64, math.ceil(count * math.log(1 / rate) / math.log(2) ** 2))
    hashes = max(1, round(size / max(1, count) * math.log(2)))
    at = keys.select(F.explode(F.array(*bit_positions(F.col("key"), number, size, hashes))).alias("p"))
    words = at.groupBy(F.shiftright("p", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 32).cast("int"))).alias("v"))
    bits = bytearray(4 * (size // 32 + 1))
    for w, v in words.toLocalIterator():
        bits[4 * w : 4 * w + 4] = int(v).to_bytes(4, "little")
    return Level(bits, size, hashes, number)


class Cascade:
    """Levels that encode by turns the listed keys and the others that pass so far: exact over the universe they were built on."""

    def __init__(self, shards: list[list[Level]]):
        self.shards = shards

    def holds(self, key: Column, shard: int = 0) -> Column:
        """Whether the key is listed: it is iff the first level that it fails has an even number."""
        out = F.lit(len(self.shards[shard]) % 2 == 1)
        for level in reversed(self.shards[shard]):
            out = F.when(~level.passes(key), level.number % 2 == 1).otherwise(out)
        return out

    def test(self, shard: int) -> Callable[[Column], Column]:
        """Whether a key belongs to the shard and is listed."""
        n = len(self.shards)
        return lambda key: self.holds(key, shard) if n == 1 else (F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(n)) == shard) & self.holds(key, shard)


def build_cascade(universe: DataFrame, listed: int, total: int) -> list[Level]:
    """(key, listed boolean) distinct: the whole universe. The first level passes about as many other keys as are
    listed, so all levels together take some bits a listed key. Each level is judged on all keys that are still open."""
    ins, outs = universe.filter("listed").select("key"), universe.filter(~F.col("listed")).select("key")
    levels, count, rate = [], listed, min(0.5, max(1e-9, listed / max(1, total - listed) / 2))
    while count:
        level = build_level(ins, count, rate, len(levels))
        levels.append(level)
        wrong = stage(outs.filter(level.passes(F.col("key"))), "passed")
        if len(levels) == LEVELS:
            raise ValueError("the cascade does not end")
        ins, outs, count, rate = wrong, ins, wrong.count(), 0.5
    return levels


def cascade(universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade:
    """A cascade over (key, listed); beyond `most_bits` for its first level, keys are dealt over shards by hash, each with a cascade of its own."""
    listed, total = universe.agg(F.count_if("listed"), F.count("*")).first()
    bits = listed * math.log2(max(2, 2 * total / max(1, listed))) * 1.5
    shards = max(1, math.ceil(bits / most_bits))
    if shards == 1:
        return Cascade([build_cascade(universe, listed, total)])
    out = []
    for k in range(shards):
        own = stage(universe.filter(F.pmod(F.xxhash64("key", F.lit("shard")), F.lit(shards)) == k), "shard")
        out.append(build_cascade(own, *own.agg(F.count_if("listed"), F.count("*")).first()))
    return Cascade(out)


def filter_keys(rows: DataFrame, keys: str, found: Cascade, to: str) -> DataFrame:
    """rows with `to`: those of the array `keys` that are listed. Each shard's filters are used in a projection of their own."""
    out, shards = rows.withColumn(to, F.array().cast("array<string>")), len(found.shards)
    for k in range(shards):
        out = out.withColumn(to, F.concat(to, F.filter(keys, found.test(k))))
        out = stage(out, "judged") if shards > 1 else out
    return out


def listed_hosts(pages: DataFrame) -> DataFrame:
    """(host): the block list of a corpus: of each host with a word of CATEGORIES the shortest domain that has one."""
    hosts = pages.select(host_and_path(F.col("url"))[0].alias("host")).distinct()
    return hosts.select(F.regexp_extract("host", LISTED_DOMAIN, 1).alias("host")).filter("host <> ''").distinct()


def judge(pages: DataFrame, rules: list[tuple[str, str]], listed: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(page_id, url, ...) and listed (host) -> page_id, host, path, rule, verdict: one row per page, all pages.

    Allow rules, block rules and listed hosts are keys of three cascades over one staged universe of the corpus's keys
    (every rule that could fit some page, and every host or domain above it with as many labels as some listed one), so
    membership is exact and no page is joined. Of the rules that fit, the longest wins and gives the verdict; without a
    rule a page is blocked iff its host or a domain above it is listed. A null url or one without :// has empty host and
    path, and is allowed if no rule fits; very long urls and hosts of very many labels give no more keys than others.
    The numbers of labels that listed hosts have come to the driver. Repeated rows stay; hosts listed twice or null count once or not at all;
    other columns are left out; an empty table gives no rows."""
    named = stage(listed.select(F.col("host").alias("key")).dropna().distinct().withColumn("listed", F.lit(True)), "listed")
    labels = sorted(r[0] for r in named.select(F.size(F.split("key", r"\."))).distinct().collect())
    host, path = host_and_path(F.col("url"))
    work = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    work = work.withColumn("_rules", rule_keys(F.col("host"), F.col("path"), [r for r, _ in rules])).withColumn("_hosts", domains(F.col("host"), labels))
    # the keys of a page's host and path; a domain has no slash, a rule has one
    every = stage(work.select(F.explode(F.concat("_rules", "_hosts")).alias("key")).distinct(), "keys")
    of_rules = {v: [r for r, x in rules if x == v] for v in ("allow", "block")}
    is_rule = F.contains("key", F.lit("/"))
    hosts = stage(every.filter(~is_rule).join(named, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False))), "hosts")
    found = {v: cascade(every.filter(is_rule).withColumn("listed", F.col("key").isin(own)), most_bits) for v, own in of_rules.items()}
    found["listed"] = cascade(hosts, most_bits)
    for name, keys in (("allow", "_rules"), ("block", "_rules"), ("listed", "_hosts")):
        work = filter_keys(work, keys, found[name], f"_{name}")

    def fitting(verdict: str) -> Column:
        return F.transform(f"_{verdict}", lambda k: F.struct((-F.length(k)).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict")))

    both = F.array_sort(F.concat(fitting("allow"), fitting("block")))
    best = F.try_element_at(both, F.lit(1))
    plain = F.when(F.size("_listed") > 0, "block").otherwise("allow")
    return work.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], plain).alias("verdict"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, RULES, listed_hosts(pages))


OP1_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rule, host, path, verdict) AS (VALUES {", ".join(f"('{r}', '{r[: r.index('/')]}', '{r[r.index('/') :]}', '{v}')" for r, v in RULES)}),
j AS (SELECT page_id, h.host, h.path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules ON (h.host = rules.host OR ends_with(h.host, '.' || rules.host)) AND starts_with(h.path, rules.path))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '{LISTED_HOST}') THEN 'block' ELSE 'allow' END) AS verdict
FROM j WHERE k = 1
"""
