import random

import pytest

from cuewright.llm.containers import fill_report, nonnegative_least_squares, pack, plan


@pytest.mark.parametrize("seed", range(5))
def test_plan_uses_the_histogram_exactly(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 64, 256])
    h = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 60))}
    left = dict(h)
    for pattern, n in plan(h, capacity):
        assert n > 0
        assert sum(v * c for v, c in pattern) <= capacity
        for v, c in pattern:
            left[v] -= c * n
    assert not any(left.values())
    total = sum(k * v for k, v in h.items())
    assert sum(n for _, n in plan(h, capacity)) <= 2 * total / capacity + 1


def test_good_fits_are_found():
    h = {60: 100, 40: 100, 55: 30, 45: 30, 34: 40, 33: 80}
    used = sum(n for _, n in plan(h, 100))
    assert used <= 100 + 30 + 40 + 1


def test_least_squares():
    patterns = [((1, 2),), ((1, 1), (2, 1)), ((2, 1),)]
    x = nonnegative_least_squares(patterns, {1: 10, 2: 4})
    assert (x >= 0).all()
    assert 2 * x[0] + x[1] == pytest.approx(10, abs=0.01)
    assert x[1] + x[2] == pytest.approx(4, abs=0.01)


def test_packing(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([5, 9, 9, 9, 30, 64, 100, 129, 640])) for i in range(400)] + [(7, 9), (None, 9), (500, 0), (501, None), (502, 100000)]
    items = spark.createDataFrame(rows, "item_id long, tokens long").repartition(4)
    specs = [("a", 64), ("b", 1000)]
    got = pack(items, specs).collect()
    for name, capacity in specs:
        own = [r for r in got if r.spec_name == name]
        assert sum(r.tokens for r in own) == sum(n or 0 for _, n in rows)
        room = {}
        for r in own:
            room[r.container] = room.get(r.container, 0) + r.tokens
        assert max(room.values()) <= capacity
        assert len(room) <= sum(room.values()) / capacity * 1.05 + 2
        whole = [r for r in own if r.item_id == 30]
        assert len(whole) == -(-rows[30][1] // capacity) if rows[30][1] > capacity else len(whole) == 1
        big = sorted((r.start_token, r.tokens) for r in own if r.item_id == 502)
        assert [s for s, _ in big] == [k * capacity for k in range(-(-100000 // capacity))]
    table = spark.createDataFrame(specs, "spec_name string, capacity_tokens long")
    assert all(0.9 < r.fill <= 1 for r in fill_report(pack(items, specs), table).collect())


def test_odd_specs(spark):
    items = spark.createDataFrame([], "item_id long, tokens long")
    assert pack(items, [("a", 5)]).count() == 0
    with pytest.raises(ValueError):
        pack(items, [("a", 0)])
