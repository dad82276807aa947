import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import cuewright.llm.spectral as spectral
from cuewright.llm.spectral import face_group_report, face_groups, face_vectors, similarity_clusters


def people(seed, groups, spread=0.025):
    rng = np.random.default_rng(seed)
    rows = []
    for size in groups:
        centre = rng.standard_normal(128)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            v = centre + spread * rng.standard_normal(128)
            rows.append(v / np.linalg.norm(v) * rng.choice([1, 1, 7]))
    order = rng.permutation(len(rows))
    return [[float(x) for x in np.float32(rows[i])] for i in order]


def plain(rows, radius=0.5):
    ids = [i for i, v in rows if v is not None and len(v) == 128 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    v = np.array([dict(rows)[i] for i in ids], float)
    v /= np.linalg.norm(v, axis=1)[:, None]
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(v @ v.T > 1 - radius * radius / 2)):
        x, y = find(ids[a]), find(ids[b])
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def frames(spark, faces, other=()):
    a = spark.createDataFrame(faces, "face_id long, embedding array<float>").repartition(3)
    b = spark.createDataFrame([(*r,) for r in other], "cluster_id long, face_encoding array<float>, occurrence_count int")
    return a, b


@pytest.mark.parametrize("block", [2048, 64])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(spectral, "BLOCK", block)  # small: hot buckets are split and joined again
    rows = list(enumerate(people(1, [150, 40, 9, 5, 4, 3, 3, 2, 2, *[1] * 40]), 1))
    rows += [(1000 + i, rows[0][1]) for i in range(80)]
    rows += [(2000, None), (2001, [1.0]), (2002, [0.0] * 128), (2003, [float("nan")] * 128), (2004, [None] * 128), (None, rows[1][1])]
    expected = plain([r for r in rows if r[0] is not None])
    sizes = {}
    for root in expected.values():
        sizes[root] = sizes.get(root, 0) + 1
    a, b = frames(spark, rows)
    got = {(r.first_id, r.member_id) for r in face_groups(a, b).collect()}
    assert got == {(root, i) for i, root in expected.items() if sizes[root] >= 3 and i != root}


def test_chains_are_one_group(spark):
    rng = np.random.default_rng(3)
    a, b = np.linalg.qr(rng.standard_normal((128, 2)))[0].T
    rows = [(i, [float(x) for x in np.cos(t) * a + np.sin(t) * b]) for i, t in enumerate(np.arange(0, 1.5, 0.15), 1)]
    members = similarity_clusters(face_vectors(*frames(spark, rows))).collect()
    assert {(r.id, r.cluster, r.size) for r in members} == {(i, 1, 10) for i, _ in rows}


def test_report_and_empty(spark):
    rows = list(enumerate(people(2, [6, 4, 1]), 1))
    a, b = frames(spark, rows, [(1, rows[0][1], 5), (2, rows[0][1], None), (3, rows[0][1], -4)])
    report = {(r.origin, r.faces): r for r in face_group_report(a, b).collect()}
    assert report["unresolved_faces", 3].occurrences == 7
    assert len(report["detected_faces", 6].typical_ids) == 3
    a, b = frames(spark, [])
    assert face_groups(a, b).count() == 0


@pytest.mark.parametrize("part", [4096, 7])
def test_typical_members_are_the_most_central(spark, monkeypatch, part):
    monkeypatch.setattr(spectral, "PART", part)  # small: groups are summed in parts
    rows = list(enumerate(people(5, [60, 20, 9, 6, 5]), 1))
    rows += [(1000 + i, rows[i][1]) for i in range(4)]
    report = face_group_report(*frames(spark, rows)).collect()
    expected = plain(rows)
    v = {i: np.array(x) / np.linalg.norm(x) for i, x in rows}
    assert len(report) == 5
    for r in report:
        group = [i for i, root in expected.items() if root == r.first_id]
        score = {i: round(float(np.mean([v[i] @ v[j] for j in group])), 6) for i in group}
        assert r.typical_ids == sorted(group, key=lambda i: (-score[i], i))[:3]


def test_border_members_of_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK", 64)
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x)
    centre = unit(rng.standard_normal(128))
    core = [unit(centre + 0.012 * rng.standard_normal(128)) for _ in range(500)]
    border = []
    for _ in range(40):  # a member at the rim, a face that only it is near, and one that only that is near
        out = rng.standard_normal(128)
        out = unit(out - centre * (centre @ out))
        border += [unit(centre + x * out) for x in (0.42, 0.88, 1.45)]
    v = [core[i] if i < 500 else border[i - 500] for i in rng.permutation(620)]
    rows = [(i, [float(x) for x in np.float32(x)]) for i, x in enumerate(v, 1)]
    expected = plain(rows)
    assert len(set(expected.values())) == 1
    got = {(r.first_id, r.member_id) for r in face_groups(*frames(spark, rows)).collect()}
    assert got == {(root, i) for i, root in expected.items() if i != root}


def test_k_means_decides_what_is_one_group(spark, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = np.linalg.qr(rng.standard_normal((128, 2)))[0].T
    rows = [(i, [float(x) for x in np.cos(t) * a + np.sin(t) * b]) for i, t in enumerate(np.arange(0, 3.1, 0.2), 1)]
    vectors = face_vectors(*frames(spark, rows))
    assert {r.cluster for r in similarity_clusters(vectors).collect()} == {1}
    monkeypatch.setattr(spectral, "kmeans", lambda points: points.select("hub", F.col("hub").alias("cluster")))
    assert len({r.cluster for r in similarity_clusters(vectors).collect()}) > 1


def test_parts_that_meet_by_chance_fall_apart(spark):
    label = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7)], "hub long, cluster long")
    between = spark.createDataFrame([(1, 2, 1.0)], "u long, v long, w double")
    points = spark.createDataFrame([(i, 1, [0.0]) for i in range(1, 5)], "hub long, n long, e array<double>")
    got = {r.hub: r.cluster for r in spectral._checked(label, between, points, True).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3


def test_dissimilar_rows_of_a_hot_bucket_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK", 32)
    rng = np.random.default_rng(9)
    axis = np.eye(128)[0]
    rows = []
    for i in range(300):  # one bucket, hardly any neighbours
        v = 0.75 * axis + 0.66 * (x := rng.standard_normal(128)) / np.linalg.norm(x)
        rows.append((i + 1, [float(y) for y in np.float32(v)]))
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(2000 + i, rows[i][1]) for i in range(30)]
    expected = plain(rows)
    sizes = {r: list(expected.values()).count(r) for r in set(expected.values())}
    got = {(r.first_id, r.member_id) for r in face_groups(*frames(spark, rows)).collect()}
    assert got == {(root, i) for i, root in expected.items() if sizes[root] >= 3 and i != root}


def test_buckets_of_a_few_blocks_are_compared_whole_and_larger_ones_in_parts(spark, monkeypatch):
    rows = list(enumerate(people(1, [150, 40, 9, 5, 4, 3, 3, 2, 2, *[1] * 40]), 1))
    rows += [(1000 + i, rows[0][1]) for i in range(80)]
    expected = plain(rows)
    sizes = {r: list(expected.values()).count(r) for r in set(expected.values())}
    faces = frames(spark, rows)
    for block, hot in ((64, False), (16, True)):  # the largest bucket has 150 to 340 rows
        monkeypatch.setattr(spectral, "BLOCK", block)
        assert (spectral.bucket_table(face_vectors(*faces))[1].count() > 0) == hot
        got = {(r.first_id, r.member_id) for r in face_groups(*faces).collect()}
        assert got == {(root, i) for i, root in expected.items() if sizes[root] >= 3 and i != root}


def test_passes_over_codes_give_the_same_links_and_leave_no_shuffle_files(spark, monkeypatch):
    blocks = lambda: {str(b) for b in _listed(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()) if str(b).startswith("shuffle_")}
    rows = list(enumerate(people(4, [60, 20, 9, 5, *[1] * 20]), 1))
    vectors = face_vectors(*frames(spark, rows))
    links, moved = {}, []
    plainly = spectral._compare
    for codes in (2, 100):
        monkeypatch.setattr(spectral, "PASS", codes)
        monkeypatch.setattr(spectral, "_compare", lambda radius: moved.append(codes) or plainly(radius))
        before = blocks()
        with spectral.shuffles_removed(spark):
            found = spectral.affinities(*spectral.bucket_table(vectors))
        for _ in range(50):
            if not blocks() - before:
                break
            time.sleep(0.2)
        assert not blocks() - before
        links[codes] = {(r.a, r.b, r.da, r.db): r.s for r in found.collect()}
    assert moved == [2, 2, 2, 100] and len(links[2]) > 90
    assert links[2].keys() == links[100].keys() and all(abs(links[2][k] - s) < 1e-6 for k, s in links[100].items())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_vectors_moved_at_once_take_little_more_disk_than_those_given(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 1000
    vectors = face_vectors(*frames(spark, [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 128)), 1)]))
    monkeypatch.setattr(spectral, "PER_BUCKET", 1)  # as of many rows: 12 codes each
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    sizes = lambda: {f.getName(): f.length() for f in _listed(manager.getAllFiles()) if f.getName().startswith("shuffle_")}
    rows, hot = spectral.bucket_table(vectors)
    moved, seen, plainly = [], sizes(), spectral.staged

    def watched(df, name, *args):
        out = plainly(df, name, *args)
        if name == "links":
            now = sizes()
            moved.append(sum(x for f, x in now.items() if f not in seen))
            seen.update(now)
        return out

    monkeypatch.setattr(spectral, "staged", watched)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"  # the files are there to be measured
    spectral.affinities(rows, hot)
    codes = spectral.moved(rows)[0]
    assert codes >= 12 and sum(moved) > n * codes * 150  # every code of every row
    assert max(moved) < 1.25 * n * 128 * 4


def _listed(seq):
    return [seq.apply(i) for i in range(seq.size())]
