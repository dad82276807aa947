import random

import pytest

from cuewright.llm.mixing import largest_total, mix, route, share_report


def test_flow_meets_quotas_with_overlap():
    sizes = {("a",): 100, ("a", "b"): 100, ("b",): 20}
    short, flows = route(sizes, {"a": (0.5, 1), "b": (0.5, 1)}, 200)
    assert short == 0
    assert sum(f for (_, s), f in flows.items() if s == "b") == 100
    assert flows[("a", "b"), "b"] >= 80
    assert largest_total(sizes, {"a": (0.5, 1), "b": (0.5, 1)}) in (219, 220, 221)


def test_repeats_are_spread():
    _, flows = route({("a",): 10, ("b",): 100}, {"a": (0.2, 3), "b": (0.8, 3)}, 100)
    assert flows == {(("a",), "a"): 20, (("b",), "b"): 80}


def test_mix(spark):
    rng = random.Random(2)
    rows = []
    for i in range(2000):
        source = rng.choice(["big"] * 8 + ["mid"] * 3 + ["small"])
        rows.append((i, source, f"k{i if rng.random() < 0.9 else i // 50}", rng.randint(1, 60)))
    rows += [(9001, "nowhere", "z", 5), (9002, "big", None, 5), (9003, "big", "q", 0), (9004, None, "r", 5)]
    items = spark.createDataFrame(rows, "item_id long, source string, key string, tokens long").repartition(4)
    targets = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("absent", 0.1, 2), ("none", 0.0, 2)]
    used = mix(items, targets, seed=3)
    got = used.collect()
    cap = {s: r for s, _, r in targets}
    assert all(1 <= r.uses <= cap[r.source] for r in got)
    assert not {r.item_id for r in got} & {9001, 9002, 9003, 9004}
    report = {r.source: r for r in share_report(used, spark.createDataFrame(targets, "source_name string, target_share double, max_repeats int")).collect()}
    for s, share, _ in targets[:3]:
        assert report[s].share == pytest.approx(share, abs=0.01)
    assert report["absent"].share == 0
    assert sorted(map(tuple, mix(items, targets, seed=3).collect())) == sorted(map(tuple, got))
    fixed = mix(items, targets, total=5000, seed=3).collect()
    assert {r.item_id for r in mix(items, targets, total=5000, seed=4).collect()} != {r.item_id for r in fixed}
    assert sum(r.total_tokens for r in fixed) == pytest.approx(5000, abs=200)
    assert mix(items.limit(0), targets).count() == 0


def test_texts_of_several_sources_fill_the_one_that_lacks(spark):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        tokens = rng.randint(5, 40)
        for source in (["a"], ["a", "b"], ["a", "b", "c"])[i % 3]:  # most of b and all of c are shared
            rows.append((len(rows), source, f"k{i}", tokens))
    items = spark.createDataFrame(rows, "item_id long, source string, key string, tokens long").repartition(5)
    targets = [("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.3, 2)]
    used = mix(items, targets, seed=1)
    got = used.collect()
    of = {r[0]: (r[1], r[2]) for r in rows}
    sources = {}
    for _, source, key, _ in rows:
        sources.setdefault(key, set()).add(source)
    assert all(r.source in sources[of[r.item_id][1]] for r in got)
    spent = {}
    for r in got:
        spent.setdefault(of[r.item_id][1], {})[r.source] = r.uses
    cap = {s: n for s, _, n in targets}
    assert all(n <= cap[s] for uses in spent.values() for s, n in uses.items())
    assert any(len(uses) > 1 or set(uses) != {min(sources[k])} for k, uses in spent.items())
    total = sum(r.total_tokens for r in got)
    for s, share, _ in targets:
        assert sum(r.total_tokens for r in got if r.source == s) / total == pytest.approx(share, abs=0.01)
