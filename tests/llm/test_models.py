"""Classifiers and media features against plain computations of the same results."""

import hashlib
import io
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlake.llm import langid, media, ngrams, toxicity
from kvlake.llm.storage import Scratch

SF = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- language


def grams(text, order, bits):
    """Buckets of the n-grams that begin at each byte, one at a time."""
    data = ngrams.plain(text) + bytes(order - 1)
    out = []
    for i in range(len(data) - order + 1):
        h = order
        for j in range(order):
            h = ((h ^ data[i + j]) * int(ngrams._STEP[j])) & 0xFFFFFFFF
            h ^= h >> 15
        out.append(h >> (32 - bits))
    return out


def test_counts_and_nearest_centroids_match_brute_force():
    texts = ["the cat sat on the mat", "der hund ist im haus", "le chat est sur la table", "the dog is in the house", "die katze und der hund", "la maison est la"]
    langs = ["en", "de", "fr", "en", "de", "fr"]
    counted = np.array([langid.counts(t) for t in texts])
    for text, row in zip(texts, counted):
        want = Counter((i, b) for i, order in enumerate((1, 2, 3)) for b in grams(text, order, langid.BITS))
        got = {(at >> langid.BITS, at & ((1 << langid.BITS) - 1)): round(float(row[at]) ** 2) for at in np.flatnonzero(row)}
        assert got == want
    model = langid.fit(langs, counted, 2)
    df = (counted > 0).sum(axis=0)
    for text, row in zip([*texts, "the house", "das haus"], [*counted, langid.counts("the house"), langid.counts("das haus")]):
        weighted = {i: float(row[i]) * (math.log((1 + len(texts)) / (1 + int(df[i]))) + 0.05) for i in np.flatnonzero(row)}
        size = math.sqrt(sum(x * x for x in weighted.values()))
        cosines = [sum(x * float(c[i]) for i, x in weighted.items()) / size for c in model.vectors]
        own, score = model.nearest(row[None, :])
        assert own[0] == model.owner[int(np.argmax(cosines))] and score[0] == pytest.approx(max(cosines), abs=1e-5)
    assert model.languages == ["de", "en", "fr"] and [model.languages[i] for i in model.nearest(counted)[0]] == langs


def test_rejection_is_calibrated_and_fires(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = [(10**9 + i, t, None) for i, t in enumerate(["zzz qqq xxx jjj kkk", "ЖЖЖ щщщ ъъъ ыыы эээ юююю", "qxzj " * 400])]
    both = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = langid.identify_languages(both, ~held & (F.col("doc_id") < 10**9), reject_share=0.02).collect()
    assert all(r.rejected for r in rows if r.doc_id >= 10**9)
    normal = [r.rejected for r in rows if r.doc_id < 10**9]
    assert 0 < sum(normal) < 0.1 * len(normal)


def test_bounds_of_learning_rows_hold(spark):
    rows = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 3)).alias("lang"))
    got = langid.bounded_sample(rows, "lang", 50, Scratch(spark, "t")).collect()
    want = defaultdict(list)
    for r in rows.select("id", "lang", F.xxhash64(F.lit(5), "id").alias("h")).collect():
        want[r.lang].append((r.h, r.id))
    assert {(r.id, r.lang) for r in got} == {(i, k) for k, v in want.items() for _, i in sorted(v)[:50]} and len(got) == 50 * len(want)
    few = langid.identify_languages(spark.read.parquet(f"{SF}/documents.parquet"), F.lit(True), max_samples=2).select("lang_pred").distinct().collect()
    assert len([r for r in few if r.lang_pred != "und"]) <= 2


# ---------------------------------------------------------------- toxicity


def test_scores_are_means_over_all_subwords_of_whole_texts(monkeypatch):
    texts = ["you are all fine people of this town", "idiot", "", None, "a", "7 8 9", "a very long and calm text " * 90 + "with scum inside of it " + "and more calm words " * 50]
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 1, 1 << toxicity.BITS), -0.3)
    together = model.scores(texts)
    for text, score in zip(texts, together):
        data = ngrams.plain(text)
        value = [float(model.value[b]) for n in toxicity.ORDERS for b in grams(text, n, toxicity.BITS)[: max(0, len(data) - n + 1)]]
        mean = sum(value) / len(value) if value else 0.0
        assert score == pytest.approx(1 / (1 + math.exp(0.3 - mean)), abs=1e-9)
    monkeypatch.setattr(toxicity, "_TOGETHER", 10)
    assert model.scores(texts).tolist() == together.tolist() and model.scores([]).tolist() == []


def test_shares_of_common_subwords_match_counts(monkeypatch):
    monkeypatch.setattr(toxicity, "_TOGETHER", 30)  # several groups
    texts = ["the cat sat on the mat", "the mat", "", "on the mat the cat", "cats"]
    own = [Counter(b for n in toxicity.ORDERS for b in grams(t, n, toxicity.BITS)[: max(0, len(ngrams.plain(t)) - n + 1)]) for t in texts]
    held = Counter(b for c in own for b in c)
    names, blocks = toxicity._shares(texts)
    assert len(blocks) > 1
    place, share, counts = (np.concatenate(part) for part in zip(*blocks))
    assert set(names.tolist()) == {b for b, n in held.items() if n >= 3} and counts.sum() == len(place) == len(share)
    for c, p, x in zip(own, np.split(place, np.cumsum(counts)[:-1]), np.split(share, np.cumsum(counts)[:-1])):
        assert {int(names[i]): pytest.approx(float(v)) for i, v in zip(p, x)} == {b: n / sum(c.values()) for b, n in c.items() if held[b] >= 3}


def test_training_learns_telling_subwords_and_shares_them_with_misspellings():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghklmnoprstu"), rng.integers(3, 8))) for _ in range(150)]
    clean = [" ".join(rng.choice(words, rng.integers(5, 120))) for _ in range(240)]
    bad = [f"{t} wretched{' wretched' * (len(t) // 100)} {t[::-1]}" for t in clean[:120]]
    texts, labels = [*bad, *clean[120:]], [1] * len(bad) + [0] * 120
    model = toxicity.train(texts, labels)
    assert all(model.scores(["wretched", "so wretched you are", "wretchedly", "wretchad", "wretcheed"]) >= 0.5)
    assert all(model.scores(["", None, "12", "friendly", *clean[:1]]) < 0.5)
    again = toxicity.train(texts, labels, epochs=60, shrink=40.0)  # leaves no embedding, so it is halved
    assert again.value.any() and again.scores([""])[0] < 0.5
    for only in (0, 1):
        assert (toxicity.train(["a text", "b"], [only, only]).scores(["x", ""]) >= 0.5).tolist() == [bool(only)] * 2
    assert toxicity.train([], []).scores(["x"])[0] < 0.5


def test_held_out_labels_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    got = toxicity.score_toxicity(docs, labels).where("held_out").join(labels, "doc_id").collect()
    bad, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in bad) / len(bad) > 0.85 and sum(r.predicted for r in clean) / len(clean) < 0.03
    order = sorted(got, key=lambda r: r.score)
    ranks = sum(i + 1 for i, r in enumerate(order) if r.toxic == 1)
    assert (ranks - len(bad) * (len(bad) + 1) / 2) / (len(bad) * len(clean)) > 0.93  # area under the curve


# ------------------------------------------------------------------- media


def cells(grid, height, width):
    """Means over exact areas, from samples cut in equal parts."""
    rows, columns = math.lcm(len(grid), height), math.lcm(len(grid[0]), width)
    fine = np.kron(np.array(grid, float), np.ones((rows // len(grid), columns // len(grid[0]))))
    return fine.reshape(height, rows // height, width, columns // width).mean(axis=(1, 3))


def test_stored_images_tiles_and_hashes_match_plain_computations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "ü" * 700)], "doc_id bigint, text string")
    docs = docs.select("doc_id", "text").unionByName(more)
    texts = {r.doc_id: r.text for r in docs.collect()}
    tiled = media.text_media(docs)
    means = {r.doc_id: r.tile_mean for r in media.tile_means(tiled).collect()}
    rows = tiled.collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        stored = b"P5\n24 %d\n255\n" % (len(payload) // 24) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        grid = np.frombuffer(payload, np.uint8).reshape(-1, 24).tolist()
        tile = np.load(io.BytesIO(r.tile))
        assert tile.dtype == np.uint8 and np.abs(tile - cells(grid, 32, 32)).max() <= 0.5 + 1e-6
        assert means[r.doc_id] == pytest.approx(tile.mean())
        small = np.round(cells(grid, 8, 9), 6)
        bits = "".join("1" if a < b else "0" for row in small for a, b in zip(row, row[1:]))
        assert sum(a != b for a, b in zip(f"{int(r.feature, 16):064b}", bits)) <= 1 and re.fullmatch("[0-9a-f]{16}", r.feature)
    with pytest.raises(Exception, match="MediaError"):
        media.media_features(spark.createDataFrame([(1, 0, None)], "id bigint, n_bytes bigint, media binary")).collect()


def test_learning_texts_stay_within_their_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w" * (10 * i + 1)) for i in range(60)], "doc_id bigint, text string")
    marks = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels: seen.append((texts, labels)))
    toxicity.fit_labels(docs, marks, 1200, "doc_id", "text", "toxic", 0, 5, 2000)
    toxicity.fit_labels(docs, marks, 1200, "doc_id", "text", "toxic", 0, 5, 1 << 20)
    (few, marked), (every, _) = seen
    assert 0 < len(few) < len(every) and set(few) <= set(every)
    for label in (0, 1):
        assert 1400 < sum(len(t) for t, y in zip(few, marked) if y == label) <= 2000


def test_columns_named_like_the_working_ones_stay(spark, odd_docs):
    marks = spark.createDataFrame([(1, 1), (7, 0), (8, 0)], "doc_id bigint, toxic int")
    odd = odd_docs.withColumnRenamed("key", "score").withColumnRenamed("digest", "_score")
    kept = toxicity.clean_rows(odd, marks)
    assert kept.columns == odd.columns and {r["score"] for r in kept.collect()} <= {"z", None}
