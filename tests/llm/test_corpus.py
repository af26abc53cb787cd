"""Operators against brute force on small tables, and on odd rows."""

import base64
import gzip
import hashlib
import itertools
import json
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from kvlake.llm import exactdedup, graph, langid, media, mixing, packing, pii, queries, simhash, toxicity, urlfilter, warc
from kvlake.llm.storage import Scratch

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def documents():
    return pd.read_parquet(f"{SF}/documents.parquet")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


# ---------------------------------------------------------------- exact dedup


def test_exact_duplicates_match_brute_force(spark, odd_docs, no_docs):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows = frame.select("doc_id", "text").collect()
        groups = defaultdict(list)
        for r in rows:
            groups[SPACE.sub(" ", r.text or "")].append(r.doc_id)
        low = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
        want = Counter()
        for r in rows:
            k = SPACE.sub(" ", r.text or "")
            want[(r.doc_id, low[k], len(groups[k]), r.doc_id == low[k], hashlib.sha256(k.encode()).hexdigest())] += 1
        got = Counter(tuple(r) for r in exactdedup.exact_duplicates(frame).collect())
        assert got == want
    assert exactdedup.exact_duplicates(no_docs).count() == 0


def test_digest_collisions_are_parted_by_bytes(spark, monkeypatch):
    rows = [(1, "one"), (2, "two"), (3, "two"), (4, "one"), (5, "three")]
    real = F.sha2
    monkeypatch.setattr(exactdedup.F, "sha2", lambda c, n: real(F.substring(c, 1, 0) if n == 256 else c, n))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exactdedup.exact_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: (1, 2), 4: (1, 2), 2: (2, 2), 3: (2, 2), 5: (5, 1)}


def test_index_runs_merge_to_the_smallest_id(spark):
    scratch = Scratch(spark, "test")
    rows = spark.range(100).select(F.col("id"), F.unhex(F.sha2((F.col("id") % 7).cast("string"), 256)).alias("digest"))
    first = exactdedup.flush_runs(rows.where("id >= 50"), 3, scratch, "a")
    second = exactdedup.flush_runs(rows.where("id < 50"), 3, scratch, "b")
    merged = exactdedup.compact(first.unionByName(second), scratch).collect()
    assert sorted((r.low, r.n) for r in merged) == [(i, len(range(i, 100, 7))) for i in range(7)]


def test_tiers_lookups_and_filters_of_the_index(spark):
    scratch = Scratch(spark, "test")
    rows = spark.range(500).select("id", F.unhex(F.sha2((F.col("id") % 90).cast("string"), 256)).alias("digest"))
    index = exactdedup.build_index(rows, scratch, memtable_rows=20, fan_in=3)  # 25 runs, three tiers
    assert sorted((r.low, r.n) for r in index.collect()) == [(i, len(range(i, 500, 90))) for i in range(90)]
    probes = spark.range(80, 120).select("id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    assert sorted((r.id, r.low) for r in exactdedup.lookup(index, probes, scratch).collect()) == [(i, i) for i in range(80, 90)]
    assert exactdedup.may_hold(probes, "digest", exactdedup.key_filter(index, "digest", scratch, "f")).count() < 12
    digest = hashlib.sha256(b"7").digest()
    assert [tuple(r) for r in exactdedup.point_lookup(index, digest).select("low", "n").collect()] == [(7, 6)]
    assert "PushedFilters: [IsNotNull(digest), EqualTo(digest" in exactdedup.point_lookup(index, digest)._jdf.queryExecution().toString()


def test_small_memtables_give_the_same_rows(spark, odd_docs):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        assert Counter(exactdedup.exact_duplicates(frame, memtable_rows=3, fan_in=2).collect()) == Counter(exactdedup.exact_duplicates(frame).collect())


# -------------------------------------------------------------------- simhash


def brute_fingerprint(text, k):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    parent = {f: f for f in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    return {f: find(f) for f in parent}


def test_simhash_matches_brute_force(spark, odd_docs, no_docs):
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows = frame.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r.text, 3) for r in rows]
        root = brute_components(prints, 2)
        low = {}
        for r, f in zip(rows, prints):
            if r.doc_id is not None:
                low[root[f]] = min(low.get(root[f], r.doc_id), r.doc_id)
        want = Counter((r.doc_id, f"{f:016x}", low.get(root[f])) for r, f in zip(rows, prints))
        assert Counter(tuple(r) for r in simhash.simhash_components(frame).collect()) == want
    assert simhash.simhash_components(no_docs).count() == 0


@pytest.mark.parametrize("crowded", [1, 4, 2048])
def test_hamming_links_lose_no_group(spark, crowded):
    rng = np.random.default_rng(3)
    seeds = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    values = set(seeds)
    for s in seeds[:15]:
        x = s
        for _ in range(12):  # chains and clusters
            for b in rng.integers(0, 64, int(rng.integers(1, 4))):
                x ^= 1 << int(b)
            values.add(x)
    values = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp bigint")
    links = [(r.u & simhash._MASK, r.v & simhash._MASK) for r in simhash.hamming_links(frame, 2, Scratch(spark, "t"), crowded).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    want = brute_components(values, 2)
    assert len({(find(v), want[v]) for v in values}) == len({find(v) for v in values}) == len(set(want.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(chain, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}, 201: 200}


# --------------------------------------------------------------------- mixing


def brute_mix(docs, limit):
    n = defaultdict(int)
    for r in docs:
        n[r.source] += len(words(r.text))
    total = sum(n.values())
    p = {s: c / total for s, c in n.items() if c}

    def top(a):
        z = sum(x**a for x in p.values())
        return max(x**a / z / x for x in p.values())

    low, high = 0.0, 1.0
    if top(low) <= limit:
        high = low
    else:
        for _ in range(40):
            mid = (low + high) / 2
            low, high = (low, mid) if top(mid) <= limit else (mid, high)
    z = sum(x**high for x in p.values())
    return high, {s: x**high / z * total for s, x in p.items()}, n


@pytest.mark.parametrize("limit", [1.01, 1.5, 4.0])
def test_mixing_meets_the_limit_and_the_budgets(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    rows = docs.collect()
    exponent, budgets, held = brute_mix(rows, limit)
    mixed = mixing.temperature_mix(docs, repetition_limit=limit, block_tokens=500).collect()
    assert mixed[0].mix_exponent == pytest.approx(exponent, abs=1e-6)
    longest = max(len(words(r.text)) for r in rows)
    for source, budget in budgets.items():
        drawn = [r for r in mixed if r.source == source]
        assert budget - 1 <= sum(r.mix_tokens for r in drawn) <= budget + longest
        passes = Counter(r.doc_id for r in drawn)
        assert max(passes.values()) - min([passes.get(r.doc_id, 0) for r in rows if r.source == source]) <= 1
        assert all(sorted(x.mix_epoch for x in drawn if x.doc_id == d) == list(range(c)) for d, c in passes.items())


def test_mixing_realises_a_permutation_of_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    mixed = mixing.temperature_mix(docs, repetition_limit=1.5, block_tokens=2000).collect()
    for source in {r.source for r in mixed}:
        drawn = sorted((r for r in mixed if r.source == source), key=lambda r: r.mix_position)
        assert [r.mix_position for r in drawn] == list(range(len(drawn)))
        assert [r.mix_epoch for r in drawn] == sorted(r.mix_epoch for r in drawn)
        passes = [[r.doc_id for r in drawn if r.mix_epoch == e] for e in range(drawn[-1].mix_epoch + 1)]
        assert all(p == passes[0][: len(p)] and len(set(p)) == len(p) for p in passes)  # later passes follow the same order
        assert len(passes[0]) < 6 or passes[0] != sorted(passes[0])


def test_mixing_keeps_columns_named_like_its_own(spark):
    names = ["_s", "_h", "_b", "_passes", "rank", "mix_weight"]
    docs = spark.createDataFrame([(i, f"a b {i}", "xy"[i % 2], *[f"{n}{i}" for n in names]) for i in range(20)], "doc_id bigint, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for positions in (True, False):
        mixed = mixing.temperature_mix(docs, positions=positions)
        assert mixed.columns[:8] == docs.columns[:8] and mixed.schema["mix_weight"].dataType.simpleString() == "double"
        assert all(r["_s"] == f"_s{r.doc_id}" and r["rank"] == f"rank{r.doc_id}" for r in mixed.collect()) and mixed.count() == 20


def test_mixing_meets_a_target_entropy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))
    mixed = mixing.temperature_mix(docs, target_entropy=1.3, repetition_limit=None, block_tokens=500)
    weights = [r.mix_weight for r in mixed.select("source", "mix_weight").distinct().collect()]
    assert -sum(w * math.log(w) for w in weights) == pytest.approx(1.3, abs=1e-6)


def test_mixing_that_keeps_all_rows_holds_the_limit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 25)))
    drawn = Counter((r.source, r.doc_id) for r in mixing.temperature_mix(docs, keep_all=True, repetition_limit=3.0, block_tokens=500).collect())
    assert len(drawn) == docs.count() and max(drawn.values()) == 3
    assert {n for (s, _), n in drawn.items() if s == "hot"} == {1}


def test_mixing_keeps_all_rows_when_asked(spark, odd_docs, no_docs):
    mixed = mixing.temperature_mix(odd_docs, keep_all=True, block_tokens=10).where("mix_epoch = 0")
    assert Counter(mixed.select("doc_id", "text").collect()) == Counter(odd_docs.select("doc_id", "text").collect())
    assert mixing.temperature_mix(no_docs).count() == 0
    assert mixing.temperature_mix(odd_docs).count() > 0


# -------------------------------------------------------------------- packing


def padding(histogram, ends):
    total, low = 0, -1
    for e in ends:
        total += sum(c * (e - n) for n, c in histogram if low < n <= e)
        low = e
    return total


def test_boundaries_are_optimal():
    rng = np.random.default_rng(5)
    for trial in range(60):
        lengths = sorted(set(rng.integers(0, 40, 9).tolist()))
        histogram = [(n, int(rng.integers(1, 9))) for n in lengths]
        for k in (1, 2, 3, 4):
            best = min(padding(histogram, [*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
            ends = packing.optimal_boundaries(histogram, k)
            assert len(ends) <= k and ends[-1] == lengths[-1] and padding(histogram, ends) == best, (trial, k)


def test_packing_covers_every_word_within_the_budget(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ROWS", 7)
    for frame in (spark.read.parquet(f"{SF}/documents.parquet"), odd_docs):
        rows = packing.pack_buckets(frame, buckets=4, batch_tokens=1000, max_length=300).collect()
        held = Counter()
        for r in rows:
            assert r.padding == r.bucket_length - r.tokens >= 0 and r.start == 300 * r.piece
            held[r.doc_id] += r.tokens
        want = Counter()
        for r in frame.collect():
            want[r.doc_id] += len(words(r.text))
        assert held == want
        batches = defaultdict(list)
        for r in rows:
            batches[r.bucket, r.batch].append(r)
        for (bucket, batch), got in batches.items():
            room = max(1, 1000 // max(1, got[0].bucket_length))
            last = max(b for k, b in batches if k == bucket)
            assert len(got) == room or batch == last and len(got) <= room
        assert {b for k, b in batches if k == 0} == set(range(1 + max(b for k, b in batches if k == 0)))
    assert packing.pack_buckets(no_docs).count() == 0


# ------------------------------------------------------------------ url filter


def brute_judge(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_urls_match_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://net/", "http://x.net/?a/b", "http://example.net/en", "http://example.net/en/1",
            "http://a.example.com/de/x#y", "http://notexample.com/de/", "http://a.org/fr/", "http://a.org/FR/", "x://y://z.net/", "http://é.net/ü/",
            "http://a.net\n/b", "http://" + "a." * 5000 + "net/" + "b/" * 5000]
    rows = [(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://a.net/", "clash")]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = Counter(tuple(r) for r in urlfilter.judge_urls(frame, urlfilter.RULES).collect())
    want = Counter((i, *brute_judge(u)) for i, u, _ in rows)
    assert got == want
    parts = Counter(tuple(r) for r in urlfilter.judge_urls(frame, urlfilter.RULES, max_filter_bytes=0).collect())  # a rule at a time
    assert parts == want
    assert urlfilter.judge_urls(frame.limit(0), urlfilter.RULES).count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    urls = spark.range(4000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".com")).alias("host"), F.lit("/a/").alias("path"))
    keys = [f"h{i}.com/a/" for i in range(0, 4000, 9)]
    cascade = urlfilter.build_cascade(urls, keys, 2, 2, Scratch(spark, "t"), "k")
    universe = [f"h{i}.com/a/" for i in range(4000)]
    assert cascade.contains(urlfilter.key_hash(universe)).tolist() == [k in set(keys) for k in universe]
    assert len(cascade.levels) > 1 and cascade.nbytes < 8 * len(keys)


def test_colliding_hashes_take_another_seed(spark, monkeypatch):
    import xxhash as real

    def weak(key, seed):  # under seed 0 a listed key has the hash of h1, under 1 an allowed rule that of a blocked one
        if seed == 0 and key == "h0.com/a/":
            key = "h1.com/a/"
        if seed == 1 and key == "h2.com/a/":
            key = "h3.com/a/"
        return real.xxh64_intdigest(key, seed)

    monkeypatch.setattr(urlfilter, "xxhash", type("weak", (), {"xxh64_intdigest": staticmethod(weak)}))
    urls = spark.range(50).selectExpr("id as page_id", "concat('http://h', id, '.com/a/b') as url")
    hashes = urlfilter.key_hash(["h0.com/a/", "h1.com/a/"])
    assert hashes[0] == hashes[1]
    with pytest.raises(urlfilter.HashCollision):
        urlfilter._levels(urlfilter.Cascade(), hashes[:1], hashes[1:], 0)
    with pytest.raises(urlfilter.HashCollision):
        urlfilter._small_cascade(["h2.com/a/"], ["h3.com/a/"], 1)
    rules = [urlfilter.Rule("h0.com", "/a/", "block"), urlfilter.Rule("h2.com", "/a/", "allow"), urlfilter.Rule("h3.com", "/a/", "block")]
    assert urlfilter._small_cascade(["h2.com/a/"], ["h3.com/a/"], 2).contains(urlfilter.key_hash(["h2.com/a/", "h3.com/a/"], 2)).tolist() == [True, False]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(urls, rules).collect()}
    assert {i: v for i, v in got.items() if v[0]} == {0: ("h0.com/a/", "block"), 2: ("h2.com/a/", "allow"), 3: ("h3.com/a/", "block")}
    assert len(got) == 50


# ------------------------------------------------------------------------ warc


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ü", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c", None), (4, "http://d", ""), (None, "http://e", "<p>x</p>"),
             (6, "http://f", "ü" * 300_000), (7, "http://g\\n", "only"), (7, "http://g\\n", "only"), (None, "http://h", "lost"), (None, "http://i", "lost")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, payload string")
    archives = warc.archive_pages(frame, archive_bytes=1000)
    got = Counter()
    for r in warc.read_archives(archives).collect():
        got[r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to] += 1
    top = {}
    for i, _, h in pages:
        if i is not None:
            top[h or ""] = max(top.get(h or "", i), i)
    want = Counter()
    for i, u, h in pages:
        raw, first = (h or "").encode(), top.get(h or "")
        again = first is not None and i != first
        want[i, u, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    for row in archives.collect():  # every member stands alone at its offset, and together they are the file
        entries = [json.loads(x) for x in row["index"].split("\n")]
        assert entries[-1]["offset"] + entries[-1]["length"] == len(row["data"])
        whole = gzip.decompress(row["data"])
        assert whole == b"".join(gzip.decompress(row["data"][e["offset"] : e["offset"] + e["length"]]) for e in entries)
    assert warc.read_archives(warc.archive_pages(frame.limit(0))).count() == 0
    assert warc.read_archives(archives, payloads=False).where("payload is not null").count() == 0
    full = {r.page_id: r.payload for r in warc.read_archives(archives).where("record_type = 'response'").collect()}
    assert bytes(full[6]) == ("ü" * 300_000).encode()
    odd = spark.createDataFrame([("a", None), (None, bytearray(b"")), ("a", None)], "archive string, data binary")
    again = warc.normalise_archives(odd)
    assert again.count() == 3 and warc.read_archives(again).count() == 0


def test_least_bytes_leaves_short_payloads_alone(spark):
    frame = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id bigint, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.read_archives(warc.archive_pages(frame, least_bytes=3)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_files_are_normalised_by_tasks(spark, tmp_path):
    for k in range(3):
        records = [warc.page_record(10 * k + i, "http://x", b"p%d" % i * 50, "response", None) for i in range(4)]
        (tmp_path / f"{k}.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    archives = warc.normalise_archives(warc.archive_files(spark, f"file://{tmp_path}/*.warc.gz"))
    got = warc.read_archives(archives).collect()
    assert sorted(r.page_id for r in got) == sorted(10 * k + i for k in range(3) for i in range(4)) and archives.count() == 3
    assert {r.archive.rsplit("/", 1)[1] for r in got} == {"0.warc.gz", "1.warc.gz", "2.warc.gz"}


def test_normalise_file_and_broken_archives(tmp_path):
    records = [warc.page_record(i, "http://x", b"p%d" % i * 50, "response", None) for i in range(20)]
    (tmp_path / "in.gz").write_bytes(gzip.compress(b"".join(records)))
    assert warc.normalise_file(str(tmp_path / "in.gz"), str(tmp_path / "out.gz"), str(tmp_path / "out.idx"), chunk=100) == 20
    data = (tmp_path / "out.gz").read_bytes()
    assert gzip.decompress(data) == b"".join(records)
    entry = json.loads((tmp_path / "out.idx").read_text().split("\n")[13])
    assert warc.read_member(data, entry["offset"], entry["length"])[1].endswith(b"p13" * 50)
    for bad in (gzip.compress(b"".join(records)[:-9]), gzip.compress(b"".join(records))[:-20], gzip.compress(b"HTTP/1.1 200\r\n\r\n")):
        with pytest.raises((warc.WarcError, zlib.error)):
            list(warc.normalise([bad]))


# ----------------------------------------------------------------------- media


def test_media_round_trip(spark, odd_docs, no_docs):
    got = {(r.doc_id, r.n_bytes): r for r in media.text_media(odd_docs).collect()}
    for d in odd_docs.collect():
        raw = (d.text or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[d.doc_id, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert np.load(__import__("io").BytesIO(r.tile)).shape == (32, 32) and len(r.feature) == 16
    assert media.text_media(no_docs).count() == 0


def test_netpbm_and_bmp_decode():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4) * 20
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    assert (media.decode(b"P2 # c\n4 3\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (media.decode(b"P6\n4 2\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P3\n4 2\n255\n" + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    assert (media.decode(b"P1\n3 2\n101\n0 1 0") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    assert (media.decode(b"P4\n3 2\n\xa0\x40") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    deep = np.array([[1, 500], [65535, 7]], ">u2")
    assert (media.decode(b"P5\n2 2\n65535\n" + deep.tobytes()) == deep).all()
    head = lambda depth, size, off: b"BM" + (off + size).to_bytes(4, "little") + bytes(4) + off.to_bytes(4, "little") + (40).to_bytes(4, "little")
    import struct

    row = b"".join(bytes(px[::-1]) for px in rgb[1]) + b"".join(bytes(px[::-1]) for px in rgb[0])
    assert (media.decode(head(24, 24, 54) + struct.pack("<iiHHIIiiII", 4, 2, 1, 24, 0, 24, 0, 0, 0, 0) + row) == rgb).all()
    palette = b"\x01\x02\x03\x00\x0a\x0b\x0c\x00"
    small = head(8, 8, 62) + struct.pack("<iiHHIIiiII", 2, -2, 1, 8, 0, 8, 0, 0, 2, 0) + palette + b"\x00\x01\0\0\x01\x00\0\0"
    assert (media.decode(small) == np.array([[[3, 2, 1], [12, 11, 10]], [[12, 11, 10], [3, 2, 1]]])).all()
    for bad in (b"", b"P5\n4 4\n255\n123", b"P9\n1 1\n1\n0", b"BM" + bytes(60), b"P5\n0 1\n255\n"):
        with pytest.raises(media.MediaError):
            media.decode(bad)


def test_area_resize_is_the_mean_over_areas():
    rng = np.random.default_rng(2)
    image = rng.random((10, 7))
    fine = np.kron(image, np.ones((3, 5)))  # 30 x 35 samples of equal area
    assert np.allclose(media.area_resize(image, 6, 5), fine.reshape(6, 5, 5, 7).mean(axis=(1, 3)))


# ------------------------------------------------------- language and toxicity


def test_languages_are_told_apart(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = langid.identify_languages(docs, ~held).join(docs.select("doc_id", "lang", held.alias("held")), "doc_id").where("held").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify_languages(odd_docs, F.lit(True)).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (3, 4, 5, 10)) and odd[9].lang_pred == "es"
    assert langid.identify_languages(no_docs, F.lit(True)).count() == 0


def test_toxic_rows_score_high(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang = 'en'")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    bad = F.lower("text").rlike("trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron")
    got = toxicity.score_toxicity(docs, labels).join(docs.select("doc_id", bad.alias("bad")), "doc_id").where("held_out").collect()
    tp = sum(r.bad and r.predicted for r in got) / sum(r.bad for r in got)
    fp = sum(not r.bad and r.predicted for r in got) / sum(not r.bad for r in got)
    assert tp > 0.9 and fp < 0.02, (tp, fp)
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 0), (8, 0)], "doc_id bigint, toxic int")
    odd = toxicity.score_toxicity(odd_docs, marks).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd)
    assert toxicity.score_toxicity(no_docs, marks.limit(0)).count() == 0
    assert toxicity.score_toxicity(odd_docs, marks.limit(0)).count() == odd_docs.count()


# ------------------------------------------------------------------------- pii

PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else 0,
                  "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


TRICKY = [
    "a@b.c+d@e.f@g.h", "x@y@z.com", "..a%@-.-", "1.2.3.4.5.6.7.8 1.2.3.256 0001.2.3.4", "😀 1.1.1.1 a@b.co", "4111 1111 1111 1111 4111-1111-1111-1112",
    "41111111111111114111111111111111", "+1 (234) 555-0101 +12 +1-2 ++1 23456789. +49.30.123456.", "\x01a@b.cc\x02 \x01", "a@b.c" * 50, "1" * 5000, "a" * 5000 + "@", "1 " * 4000,
    "+" * 3000 + "1234567890", "a@" * 2000 + "b.c", "tel +1 234 567 8901-", "１２３ ٣٤٥ 1.1.1.1",
]


def test_base_spans_match_brute_force(spark, odd_docs, no_docs):
    tricky = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id bigint, text string")
    for frame in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), odd_docs, tricky):
        got = pii.find_personal_data(frame).collect()
        want = Counter()
        for r in frame.select("doc_id", "text").collect():
            spans = brute_pii(r.text)
            n = Counter(s.split(":")[0] for s in spans)
            want[(r.doc_id, *(n[k] for k in PII), hashlib.sha256(",".join(spans).encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
        for r in got:
            assert r.n_learned > 0 or hashlib.sha256(r.spans.encode()).hexdigest() == r.base_sha256
    assert pii.find_personal_data(no_docs).count() == 0


def test_contexts_that_seeds_teach_find_unseen_identifiers(spark):
    rows = [(i, f"please dial: +1 234 555 01{i:02d} today, room {1000 + i}x") for i in range(20)]
    rows += [(50, "or dial: 0049-30-99-1234567x now"), (51, "room 555555x"), (50, "or dial: 0049-30-99-1234567x now")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[50].spans == "phone:9:28" and got[50].n_learned == 1 and got[50].n_phone == 0
    assert got[51].spans == "" and got[3].spans.startswith("phone:13:")


# --------------------------------------------------------------------- queries


def test_registered_queries_match_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SF)
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == sorted(got.columns)
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(cursor.fetchall()), name
