import difflib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.operators import cluster, components, intervals, ranking, search, segments, store


def merged(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("bucket", [1, 7, 600])
def test_periods_against_a_sweep(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for key in ("hot", "cold", None):
        for _ in range(300 if key == "hot" else 40):
            s = rng.randrange(0, 60000)
            rows.append((key, s, s + rng.choice([0, -5, 1, 50, 400, 9000 if rng.random() < 0.05 else 30])))
    rows += rows[:50] + [("hot", None, 5), ("hot", 5, None), ("touch", 0, 10), ("touch", 10, 20), ("nest", 0, 9000), ("nest", 10, 20), ("nest", 9500, 9501)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "k string, s long, e long, kind string").repartition(4)
    got = {tuple(r) for r in intervals.periods_and_gaps(df, ["k"], "s", "e", bucket).collect()}
    expected = set()
    for key in {r[0] for r in rows}:
        own = merged([(s, e) for k, s, e in rows if k == key and s is not None and e is not None and e > s])
        expected |= {(key, "period", s, e) for s, e in own}
        expected |= {(key, "gap", a[1], b[0]) for a, b in zip(own, own[1:])}
    assert got == expected


def test_periods_of_nothing(spark):
    assert intervals.periods_and_gaps(spark.createDataFrame([], "k string, s long, e long"), ["k"], "s", "e").count() == 0


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*links, (5, None), (7, 7)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbering_of_hot_keys(spark):
    rows = [("a" if i % 3 else None, i * 37 % 1000, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, i long")
    got = ranking.numbered(df, ["k"], ["t", "i"], F.floor(F.col("t") / 50)).collect()
    for key in ("a", None):
        own = sorted((t, i) for k, t, i in rows if k == key)
        assert [(r.t, r.i) for r in sorted((r for r in got if r.k == key), key=lambda r: r.number)] == own


def fold(words):
    out, held, start = [], [], words[0][1]
    for word, _, end in words:
        held.append(word)
        if end - start > 6.0 or word.strip().endswith(("?", ".", "!")):
            out.append(("".join(held).strip(), start, end))
            held, start = [], end
    if held:
        out.append(("".join(held).strip(), start, words[-1][2]))
    return out


def test_sentences_against_a_loop(spark):
    rng = random.Random(1)
    words, segs, expected = [], [], {}
    for k in range(30):
        t, own = rng.random(), []
        for i in range(rng.choice([0, 1, 5, 40])):
            word = " " + rng.choice(["a", "bb", "end.", "what?", "no!"])
            own.append((word, t, t + rng.random()))
            t = own[-1][2] + rng.choice([0, 0.5, 4])
            words.append((k, i, *own[-1]))
        segs.append((k, " whole ", 0.0, 9.0))
        expected[k] = fold(own) if own else [("whole", 0.0, 9.0)]
    w = spark.createDataFrame(words, "seg int, word_idx int, word string, start double, end double").repartition(3)
    got = segments.sentences(w, spark.createDataFrame(segs, "seg int, text string, start double, end double"), ["seg"]).collect()
    for k, rows in expected.items():
        assert [(r.text, r.start, r.end) for r in sorted((r for r in got if r.seg == k), key=lambda r: r.sentence_no)] == rows


@pytest.mark.parametrize(("length", "bins"), [(8.0, 1), (8.5, 3), (16.1, 4)])
def test_split_of_long_chunks(spark, length, bins):
    said = " ".join(f"w{i}" for i in range(11))
    rows = segments.split_long(spark.createDataFrame([(1, said, 2.0, 2.0 + length)], "id int, text string, start double, end double")).orderBy("piece_no").collect()
    assert len(rows) == bins
    assert " ".join(r.text for r in rows) == said
    assert rows[-1].end == pytest.approx(2.0 + length)


def test_split_of_odd_chunks(spark):
    rows = [(1, None, 0.0, 99.0), (2, "  ", 0.0, 99.0), (3, "two words", 0.0, 99.0), (4, "kept", None, 99.0), (5, "kept", 1.0, None)]
    got = segments.split_long(spark.createDataFrame(rows, "id int, text string, start double, end double")).collect()
    assert sorted((r.id, r.text) for r in got) == [(3, "two"), (3, "words"), (4, "kept"), (5, "kept")]


def test_preparation(spark):
    rows = [(" a ", 1.0, None, "x"), ("\t\n", 1.0, 2.0, None), (None, 1.0, 2.0, None), ("b", None, 2.0, None), ("c", 1.0, 1.5, None)]
    got = segments.prepared(spark.createDataFrame(rows, "text string, start double, end double, type string")).collect()
    assert [(r.text, r.start, r.end, r.type) for r in got] == [("a", 1.0, 3.0, "dialogue"), ("c", 1.0, 1.5, "dialogue")]


def test_voices(spark):
    rows = [(0.0, 0.79, [1.0]), (0.0, 0.8, [2.0]), (0.0, 50.0, [3.0, 4.0]), (0.0, 5.0, None)]
    got = segments.voice_segments(spark.createDataFrame(rows, "start double, end double, embedding array<float>")).collect()
    assert [(r.end, [round(x, 6) for x in r.embedding]) for r in got] == [(0.8, [1.0]), (30.0, [0.6, 0.8])]


def points(spark, n=200, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(dim)], f"t{i % 3}") for i in range(n)], "id long, embedding array<float>, type string")


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_top_k_is_a_prefix_and_exact(spark, metric):
    df = points(spark)
    rows = {r.id: r.embedding for r in df.collect()}
    q = rows[5]
    value = (lambda v: -sum(a * b for a, b in zip(v, q)) / math.hypot(*v) / math.hypot(*q)) if metric == "cosine" else (lambda v: math.dist(v, q))
    order = sorted(rows, key=lambda i: (round(value(rows[i]), 6), i))
    for k in (1, 7, 20):
        assert [r.id for r in search.top_k(df, q, k, metric=metric).collect()] == order[:k]
    asked = df.where("id in (5, 6)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    many = search.top_k_batched(df, asked, 7, metric=metric).where("query_id = 5").orderBy("rank").collect()
    assert [r.id for r in many] == order[:7]


def test_search_filters_and_odd_vectors(spark):
    df = points(spark).unionByName(spark.createDataFrame([(900, None, "t0"), (901, [1.0], "t0"), (902, [0.0] * 6, "t0"), (903, [float("nan")] * 6, "t0")], "id long, embedding array<float>, type string"))
    q = [1.0] * 6
    assert {r.type for r in search.top_k(search.payload_filter(df, type="t1", id=""), q, 50).collect()} == {"t1"}
    assert not {900, 901, 902, 903} & {r.id for r in search.top_k(df, q, 500).collect()}
    assert all(r.score >= 0.5 for r in search.top_k(df, q, 500, threshold=0.5).collect())
    assert all(r.score <= 2.0 for r in search.top_k(df, q, 500, metric="euclid", threshold=2.0).collect())
    assert search.top_k(df.where("id < 0"), q, 5).count() == 0
    for bad in (0, 51):
        with pytest.raises(ValueError):
            search.checked_limit(bad)


def test_close_names_equal_difflib(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) + ".mkv" for _ in range(80)]
    asked = [(i, names[i][:-1] + "x") for i in range(10)] + [(99, None)]
    got = search.close_names(spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame([(n,) for n in names + [None]], "name string")).collect()
    for i, query in asked[:-1]:
        found = [r.name for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)]
        assert found == difflib.get_close_matches(query, sorted(set(names)), n=5, cutoff=0.3)


def plain_dbscan(rows, eps, least):
    ids = sorted(rows)
    near = {i: [j for j in ids if math.dist(rows[i], rows[j]) <= eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= least}
    label, n = {}, 0
    for i in ids:
        if i in core and i not in label:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in label:
                    label[x] = n
                    stack += [y for y in near[x] if y in core]
            n += 1
    for i in ids:
        if i not in core:
            label[i] = min((label[j] for j in near[i] if j in core), default=-1)
    return label


@pytest.mark.parametrize(("eps", "block"), [(0.5, 4096), (0.5, 12), (0.25, 5)])
def test_dbscan_against_plain(spark, monkeypatch, eps, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = {}
    for c in range(6):
        for _ in range(rng.integers(1, 25)):
            rows[len(rows)] = [float(x) for x in np.float32(rng.uniform(0, 3, 2) * 0 + [c % 3, c // 3] + rng.normal(0, 0.18, 2))]
    for i in range(8):
        rows[len(rows)] = rows[i]
    df = spark.createDataFrame(list(rows.items()), "id long, embedding array<float>").repartition(3)
    got = {r.id: r.cluster for r in cluster.dbscan(df, eps=eps).collect()}
    assert got == plain_dbscan(rows, eps, 3)


def test_dbscan_edges(spark):
    kind = "id long, embedding array<float>"
    assert cluster.dbscan(spark.createDataFrame([], kind)).count() == 0
    assert {r.cluster for r in cluster.dbscan(spark.createDataFrame([(1, [0.0]), (2, [9.0]), (3, None)], kind)).collect()} == {-1}
    with pytest.raises(ValueError):
        cluster.dbscan(spark.createDataFrame([(1, [0.0]), (2, [9.0, 1.0])], kind))


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 1, "z"), ("b", None, "w")], "k string, seq long, v string")
    assert sorted((str(r.k), r.seq, r.v) for r in store.latest(df, ["k"], ["seq"]).collect()) == [("None", 1, "z"), ("a", 2, "y"), ("b", None, "w")]


def test_batches(spark):
    sizes = [len(b) for b in search.batches(spark.range(40), 16)]
    assert sizes == [16, 16, 8]


def test_blocks_far_apart_do_not_meet(spark, monkeypatch):
    monkeypatch.setattr(cluster, "BLOCK", 10)
    rows = [(i, float(i), [float(i), 0.0]) for i in range(200)]
    points = spark.createDataFrame([(i, 1, v) for i, _, v in rows], "id long, weight long, v array<double>")
    dealt = cluster._pairs_of_blocks(points, 1.5, 1)
    blocks = dealt.select("i").distinct().count()
    assert blocks >= 15 and dealt.select("i", "j").distinct().count() <= 3 * blocks
    assert dealt.groupBy("i", "j").count().agg(F.max("count")).first()[0] <= 60


@pytest.mark.parametrize("metric", ["cosine", "euclid"])
def test_batched_search_in_passes(spark, monkeypatch, metric):
    rng = np.random.default_rng(6)
    base = np.round(rng.standard_normal((120, 4)), 1)
    rows = [(f"p{i:03d}", [float(x) for x in base[i % 90]]) for i in range(120)] + [("null", None), ("short", [1.0]), ("zero", [0.0] * 4), ("nan", [float("nan")] * 4)]
    points = spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in range(0, 120, 7)] + [(900, [1.0]), (901, None)], "query_id int, vector array<float>")
    whole = {(r.query_id, r["rank"]): (r.id, r.score) for r in search.top_k_batched(points, asked, 4, metric=metric, block=3).collect()}
    monkeypatch.setattr(search, "SENT_NUMBERS", 20)
    assert whole == {(r.query_id, r["rank"]): (r.id, r.score) for r in search.top_k_batched(points, asked, 4, metric=metric).collect()}
    for query_id, vector in asked.where("query_id < 900").collect():
        one = search.top_k(points, vector, 4, metric=metric).collect()
        assert [(r.id, r.score) for r in one] == [whole[query_id, k] for k in range(1, 5)]
    assert whole[900, 1][0] == "short" and (901, 1) not in whole
    assert search.top_k_batched(points.limit(0), asked, 2).count() == 0 and search.top_k_batched(points, asked.limit(0), 2).count() == 0


def test_names_without_a_match_get_the_first(spark):
    names = spark.createDataFrame([(f"n{i:02d}.mkv",) for i in range(30)] + [(None,)], "name string")
    got = search.close_names(spark.createDataFrame([(1, "####"), (2, "n07.mkv")], "query_id int, query string"), names, n=3, cutoff=0.6, first=10)
    rows = got.orderBy("query_id", "rank").collect()
    assert [r.name for r in rows if r.query_id == 1] == [f"n{i:02d}.mkv" for i in range(10)] and all(r.ratio is None for r in rows if r.query_id == 1)
    assert rows[10].name == "n07.mkv" and rows[10].ratio == 1.0 and len(rows) == 13


def test_few_ratios_are_computed_and_the_best_names_found(monkeypatch):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("AEIOU" if i % 2 else "BDKLMNRST") for i in range(7))
    words = [word() for _ in range(60)]
    pool = sorted({" ".join(rng.sample(words, 4)) + rng.choice([".MKV", ".AVI", " É\x00", "z" * 300]) for _ in range(1500)} | {""})
    have, size = search.letter_counts(pool), np.array([len(x) for x in pool])
    plain, counted = difflib.SequenceMatcher.ratio, []
    for query in [pool[700].lower().upper()[:-1], " ".join(words[:4]) + ".MKV", pool[3] + words[5] * 40, "####", ""]:
        m = difflib.SequenceMatcher(b=query)
        every = []
        for x in pool:
            m.set_seq1(x)
            every.append((plain(m), x))
        with monkeypatch.context() as patch:
            counted.append(0)
            patch.setattr(difflib.SequenceMatcher, "ratio", lambda self: (counted.__setitem__(-1, counted[-1] + 1), plain(self))[1])
            found = search.closest(query, pool, have, size, 5, 0.3)
        assert sorted(found, reverse=True) == sorted((r for r in every if r[0] >= 0.3), reverse=True)[:5]
    assert counted[1] < 150  # the letters alone leave 690 names to compare


def test_close_names_in_blocks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(search, "NAMES", 40)
    monkeypatch.setattr(search, "PAIRS", 500)
    rng = random.Random(3)
    names = ["".join(rng.choice("abcdeAB") for _ in range(rng.randint(0, 9))) + ".mkv" for _ in range(150)]
    asked = [(i, names[i % 20][:-1]) for i in range(30)]
    got = search.close_names(spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    for i, query in asked:
        found = [r.name for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])]
        assert found == difflib.get_close_matches(query, sorted(set(names)), n=5, cutoff=0.3)
