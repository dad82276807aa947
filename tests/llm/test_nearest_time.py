import random

import pytest
from pyspark.sql import functions as F

from cuewright.llm.nearest_time import nearest_in_time, segments_with_frames


def run(spark, left, right, partitions, tolerance=2.0):
    kind = "id long, e string, t double, extra string"
    got = nearest_in_time(
        spark.createDataFrame(left, kind).repartition(3), spark.createDataFrame(right, kind).repartition(3), left_id="id", right_id="id",
        left_entity=F.col("e"), right_entity=F.col("e"), left_time=F.col("t"), right_time=F.col("t"), tolerance_s=tolerance, partitions=partitions,
    )
    return sorted((r.left_id, r.right_id, r.diff_ms) for r in got.collect())


def plain(left, right, tolerance=2.0):
    out = []
    ok = lambda r: r[0] is not None and r[1] is not None and r[2] is not None and r[2] == r[2] and 0 <= r[2] < 1e12
    for i, e, t, _ in filter(ok, left):
        near = [(abs(round(u * 1000) - round(t * 1000)), round(u * 1000) - round(t * 1000), j) for j, f, u, _ in filter(ok, right) if f == e]
        if near and (best := min(near))[0] <= tolerance * 1000:
            out.append((i, best[2], best[1]))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 16, 40])
def test_against_brute_force(spark, partitions):
    rng = random.Random(partitions)
    make = lambda n, base: [(base + i, rng.choice(["hot", "hot", "hot", "a", "b", "c"]), rng.randrange(0, 40000) / 1000 * rng.choice([1, 1, 30]), "x") for i in range(n)]
    left, right = make(300, 0), make(120, 1000)
    odd = [(None, "a", 1.0, ""), (900, None, 1.0, ""), (901, "a", None, ""), (902, "a", float("nan"), ""), (903, "a", -1.0, ""), (904, "a", float("inf"), "")]
    left += [*odd, *[(r[0] + 5000, *r[1:]) for r in left[:20]]]
    right += [*[(r[0] and r[0] + 7000, *r[1:]) for r in odd], *[(r[0] + 5000, *r[1:]) for r in right[:40]], *[(9000 + i, "hot", 7.0, "x") for i in range(50)]]
    assert run(spark, left, right, partitions) == plain(left, right)


def test_an_entity_over_many_ranges(spark):
    left = [(i, "one", float(i), "x") for i in range(0, 500)]
    right = [(1, "one", 0.25, "x"), (2, "one", 400.25, "x")]
    assert run(spark, left, right, 25, tolerance=1000.0) == plain(left, right, 1000.0)


def test_empty(spark):
    rows = [(1, "a", 1.0, "x")]
    assert run(spark, [], rows, 4) == run(spark, rows, [], 4) == run(spark, [], [], 4) == []


def test_tables(spark):
    s = spark.createDataFrame([(1, ' "/v" ', 1.0, "t"), (2, "/v", 9.0, None), (3, None, 1.0, "t")], "segment_id long, video_path string, start_s double, frame_ts string")
    f = spark.createDataFrame([(7, "/v", 2.5, 1), (6, "'/v'", 2.5, 1), (8, "/w", 1.0, 1)], "frame_id long, video_path string, frame_ts double, segment_id int")
    assert [(r.segment_id, r.frame_id) for r in segments_with_frames(s, f).collect()] == [(1, 6)]
