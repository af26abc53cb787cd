"""URL filter by a cascade of Bloom filters.

Level 1 holds the listed keys.  Keys of the corpus that it wrongly contains are
held by level 2, listed keys that level 2 wrongly contains by level 3, and so on
until a level is wrong about nothing.  For every key of the corpus, the first
level that does not contain it then tells membership exactly, without a join.

Filters hold 64-bit hashes.  A corpus key that shares its hash with a listed one,
or an allowed rule with a blocked one, would be told wrongly by every level, so
such pairs are looked for and the hash takes another seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.storage import Scratch, prepare_workers


@dataclass(frozen=True)
class Rule:
    """A rule fits a host and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: see ``judge_urls``."""
    after = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


class Bloom:
    """A Bloom filter over 64-bit hashes; positions by double hashing per level."""

    def __init__(self, hashes: np.ndarray, rate: float, level: int):
        n = max(1, len(hashes))
        self.level = level
        self.k = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(n * self.k / math.log(2)))
        self.bits = np.zeros((self.size + 7) // 8, np.uint8)
        if len(hashes):
            at = self._at(hashes).ravel()
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        x = hashes + np.uint64(self.level * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        step = (x >> np.uint64(32)) | np.uint64(1)
        return ((x[:, None] + np.arange(self.k, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(self.size)).astype(np.int64)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        at = self._at(hashes)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


class Cascade:
    """Levels of Bloom filters; exact for listed keys and the universe it was built on."""

    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        inside = np.zeros(len(hashes), bool)
        open_ = np.arange(len(hashes))
        for depth, bloom in enumerate(self.levels):
            held = bloom.contains(hashes[open_])
            inside[open_[~held]] = depth % 2 == 1
            open_ = open_[held]
        inside[open_] = len(self.levels) % 2 == 1
        return inside

    @property
    def nbytes(self) -> int:
        return sum(b.bits.nbytes for b in self.levels)


def key_hash(keys: Sequence[str], seed: int = 0) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64)


#: Seeds that are tried before rules are given up; each try makes collisions unlikely anew.
_SEEDS = range(16)


class HashCollision(ValueError):
    """Keys that must be told apart share their hash under every seed."""


def _candidates(host: str, path: str, labels: int, slashes: int) -> list[str]:
    """Keys that could be listed for a URL: host suffixes times path prefixes.

    Suffixes of more labels, and prefixes of more slashes, than any rule has
    cannot be listed.
    """
    parts = host.split(".")
    hosts = [".".join(parts[-n:]) for n in range(1, min(labels, len(parts)) + 1)]
    cuts, at = [], -1
    while len(cuts) < slashes and (at := path.find("/", at + 1)) >= 0:
        cuts.append(path[: at + 1])
    return [h + p for h in hosts for p in cuts]


def _levels(cascade: Cascade, inside: np.ndarray, outside: np.ndarray, first: int) -> Cascade:
    """Levels that alternate between two sides of hashes until one is wrong about nothing."""
    if len(np.intersect1d(inside, outside)):
        raise HashCollision("a key inside and one outside share a hash")
    sides = [inside, outside]
    while len(sides[0]):
        bloom = Bloom(sides[0], 0.5, first + len(cascade.levels))
        cascade.levels.append(bloom)
        sides = [sides[1][bloom.contains(sides[1])], sides[0]]
    return cascade


def build_cascade(urls: DataFrame, keys: Sequence[str], labels: int, slashes: int, scratch: Scratch, name: str, seed: int = 0) -> Cascade:
    """Cascade over the candidate keys of ``urls(host, path)``, its whole universe.

    Sizes follow the first level's rate r / (sqrt(2) s) for r listed and s other
    keys and 1/2 below, so all levels take about 1.44 log2(s/r) + 4 bits a listed
    key: false positives, and so what reaches the driver, are fewer than the
    listed keys on average, however large the corpus is.  What goes to the tasks
    is the first level and eight bytes of each listed key.  Raises
    ``HashCollision`` where a corpus key shares its hash with a listed one.
    """
    listed_hashes = np.unique(key_hash(keys, seed))
    cascade = Cascade()
    if not len(keys):
        cascade.levels.append(Bloom(listed_hashes, 0.5, 0))
        return cascade
    spark = urls.sparkSession
    universe = urls.count() * labels * max(1, slashes)
    first_rate = min(0.5, len(keys) / (math.sqrt(2) * max(1, universe)))
    cascade.levels.append(Bloom(listed_hashes, first_rate, 0))
    shared = spark.sparkContext.broadcast((cascade.levels[0], listed_hashes))

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, listed = shared.value
        for batch in batches:
            found = sorted({k for h, p in zip(*batch.columns, strict=True) for k in _candidates(h.as_py(), p.as_py(), labels, slashes)})
            hashes = key_hash(found, seed)
            held = bloom.contains(hashes) if found else np.zeros(0, bool)
            place = np.minimum(np.searchsorted(listed, hashes), len(listed) - 1)
            columns = [pa.array([k for k, x in zip(found, held, strict=True) if x], pa.string()), pa.array((listed[place] == hashes)[held])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "met"])

    # Keys with a listed hash are the listed ones, unless hashes collide: they are compared as text.
    seen = scratch.table(urls.mapInArrow(wrong, "key string, met boolean").distinct(), f"{name}{seed}")
    rules = scratch.table(spark.createDataFrame([(k,) for k in keys], "key string"), f"{name}{seed}rules")
    if not seen.where("met").join(rules, "key", "left_anti").isEmpty():
        raise HashCollision("a key of the corpus has the hash of a listed one")
    others = key_hash([r[0] for r in seen.where("not met").select("key").collect()], seed)
    return _levels(cascade, others, listed_hashes, 0)


def _small_cascade(inside: Sequence[str], outside: Sequence[str], seed: int) -> Cascade:
    """Cascade of two key sets that are at hand, such as allowed and blocked rules."""
    cascade = _levels(Cascade(), key_hash(inside, seed), key_hash(outside, seed), 64)
    if not cascade.levels:
        cascade.levels.append(Bloom(np.empty(0, np.uint64), 0.5, 64))
    return cascade


def _chunks(rules: Sequence[Rule], max_filter_bytes: int) -> list[list[Rule]]:
    """Rules in parts of which hashes and filters stay within the bound: a key takes
    eight bytes, 64 bits at most in the first level, four in the others, two in the
    cascade of verdicts."""
    rows = max(1, max_filter_bytes // 18)
    return [list(rules[i : i + rows]) for i in range(0, len(rules), rows)] or [[]]


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], default: str = "allow", max_filter_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; path: from there up to ``?``, ``#`` or the end.  A null url, or
    one without ``://``, has both empty.  Rule paths end in ``/``.  Of the rules
    that fit, the longest wins (of equally long ones, that with the longer host);
    where none fits, ``rule`` is null and the verdict is ``default``.  Of two rules
    for one host and path, the first counts.

    Two cascades go to the executors: listed keys over the corpus's candidates,
    and allowed keys over the listed ones.  Their size grows with the rules only;
    rules whose filters would pass ``max_filter_bytes`` are taken in parts, each
    with cascades of its own, and the longest rule of all parts wins.  Repeated
    rows each get a verdict, other columns are ignored, and an empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    prepare_workers(spark)
    scratch = Scratch(spark, "urlfilter")
    for rule in rules:
        if not rule.path.endswith("/"):
            raise ValueError(f"a rule's path must end in '/': {rule.key}")
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    distinct = sorted({r.key: r for r in reversed(rules)}.values(), key=lambda r: r.key)
    parts = _chunks(distinct, max_filter_bytes)
    for i, part in enumerate(parts):
        urls = _judge(urls, part, scratch, f"part{i}")
        if i + 1 < len(parts):  # one part's filters at a time
            urls = scratch.table(urls, f"judged{i}")
    return urls.withColumnRenamed("id", id_col)


def _judge(urls: DataFrame, rules: list[Rule], scratch: Scratch, name: str) -> DataFrame:
    """``urls(id, host, path, rule, verdict)`` with the longest fitting rule of these, where it beats the one there."""
    spark = urls.sparkSession
    labels = max([r.host.count(".") + 1 for r in rules], default=1)
    slashes = max([r.path.count("/") for r in rules], default=1)
    allowed, blocked = [r.key for r in rules if r.verdict == "allow"], [r.key for r in rules if r.verdict != "allow"]
    for seed in _SEEDS:
        try:
            listed = build_cascade(urls.select("host", "path"), [r.key for r in rules], labels, slashes, scratch, name, seed)
            verdicts = _small_cascade(allowed, blocked, seed)
            break
        except HashCollision:
            if seed == _SEEDS[-1]:
                raise
    shared = spark.sparkContext.broadcast((listed, verdicts))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member, allow = shared.value
        for batch in batches:
            hosts, paths, rule, verdict = (batch.column(i).to_pylist() for i in range(1, 5))
            tried = [_candidates(h, p, labels, slashes) for h, p in zip(hosts, paths, strict=True)]
            flat = [k for t in tried for k in t]
            hashes = key_hash(flat, seed)
            hit, good = (member.contains(hashes), allow.contains(hashes)) if flat else ([], [])
            at = 0
            for row, t in enumerate(tried):
                best = max((i for i in range(at, at + len(t)) if hit[i]), key=lambda i: _weight(flat[i]), default=None)
                if best is not None and (rule[row] is None or _weight(flat[best]) > _weight(rule[row])):
                    rule[row], verdict[row] = flat[best], "allow" if good[best] else "block"
                at += len(t)
            columns = [*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "host", "path", "rule", "verdict"])

    kind = urls.schema["id"].dataType.simpleString()
    return urls.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string")


def _weight(key: str) -> tuple[int, int]:
    """Longer rules win; of equally long ones, that with the longer host."""
    return len(key), key.find("/")


#: Rules of the registered query.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)

ORACLE_SQL = r"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES
  ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
split AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule_host || r.rule_path AS rule, r.verdict,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST) AS rn
  FROM split s LEFT JOIN rules r
    ON (s.host = r.rule_host OR suffix(s.host, '.' || r.rule_host)) AND prefix(s.path, r.rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE rn = 1
"""
