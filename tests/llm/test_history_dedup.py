import random
import re

from cuewright.llm.history_dedup import AcceptedHistory, Weights, find_repeats

KIND = "file_id long, path string, content_hash string, batch_no int, filename string"
H = [f"{i:04x}" * 10 for i in range(1, 60)]


def repeats(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND)
    return sorted(tuple(r) for r in find_repeats(df).collect())


def test_keys_and_slips(spark):
    rows = [
        (1, "/m/Duskborn.Otterquay.Kelnesh.1970.720p.mkv", H[1], 0),
        (2, "/m/The Frostlit Gatekeep Bamund Alkovo (1980).avi", H[2], 0),
        (3, "/m/Frostlit_Gatekeep_Bamund_Alkovo,_The_1980_480p.mp4", H[3], 0),
        (4, "/m/Frostlit Gatekeep Bamund Alkovo (1999).mp4", H[4], 0),
        (5, "/m/Frostlit Gatekeep Bamund Alkovo 2 (1980).mp4", H[5], 1),
        (6, "/m/frostlit gatekep bamund alkovo [1980].mp4", H[6], 1),
        (7, "/m/Frostlit Gatekeep Bamund Alkovo (1980) cd1.mp4", H[7], 1),
        (8, "/tv/Some Long Show - S01E02.mkv", H[8], 1),
        (9, "/tv/Some.Long.Show.1x02.avi", H[9], 2),
        (10, "/tv/Some Long Show - S01E03.mkv", H[10], 2),
        (11, "/inbox/x.bin", "SHA1:" + H[10].upper(), 2),
        (12, ' "/inbox/x.bin"', None, 3),
        (13, "/photos/IMG_1999_0001.jpg", "N/A", 3),
        (14, "/photos/IMG_1999_0002.jpg", "N/A", 3),
        (15, "/photos/IMG_3.jpg", "0" * 40, 3),
        (16, "/photos/IMG_4.jpg", "0" * 40, 3),
        (17, None, None, None),
        (18, None, "", 3),
        (19, "/m/Düskborn Öttérquay Kelnesh - 1970.mkv", None, 4),
        (20, "/music/01 Title 1970.mp3", H[20], 4),
        (21, "/other/01 Title 1970.mp3", H[21], 4),
    ]
    assert repeats(spark, rows) == [(1, 19), (2, 3), (2, 6), (8, 9), (10, 11), (10, 12)]


def test_a_late_file_joins_two_items(spark):
    rows = [(1, "/a.bin", H[1], 0), (2, "/b.bin", H[2], 0), (3, "/c.bin", H[2], 1), (4, "/b.bin", H[1], 2), (5, "/c.bin", None, 3), (6, "/d.bin", H[1], 4)]
    assert repeats(spark, rows) == [(1, 2), (1, 3), (1, 4), (1, 5), (1, 6)]


def test_against_union_find(spark):
    rng = random.Random(5)
    rows = [(i, f"/p/{rng.randrange(60)}.bin", rng.choice([*H[:25], None]), i // 40) for i in range(1, 161)]
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for i, path, h, _ in rows:
        for key in (path, h):
            if key is not None:
                a, b = find(i), find(seen.setdefault(key, i))
                parent[max(a, b)] = min(a, b)
    assert repeats(spark, rows) == sorted((find(i), i) for i in parent if find(i) != i)


def test_empty_and_hot_copies(spark):
    assert repeats(spark, []) == []
    assert repeats(spark, [(i, "/same", H[0], i % 2) for i in range(1, 90)]) == [(1, i) for i in range(2, 90)]


def test_history_is_not_read_again(spark):
    history = AcceptedHistory(spark)
    first = spark.createDataFrame([(1, "/a", H[1], 0, "")], KIND)
    history.accept(first)
    items = history.accept(spark.createDataFrame([(2, "/b", H[1], 1, "")], KIND))
    assert [tuple(r) for r in items.select("file_id", "item").collect()] == [(2, 1)]


def test_weights_are_learned():
    rows = [(0, 0, 0, 90), (0, 0, 1, 5), (3, 1, 1, 300), (3, 2, 1, 200), (2, 1, 0, 20)]
    learned = Weights().learn(rows)
    assert learned.m[0][0] > 0.8 > learned.u[0][0]
    assert 0.1 < learned.share < 0.25
    assert Weights().learn(rows[:0]) == Weights()


FILE = "file_id long, path string, content_hash string"


def test_a_second_process_goes_on_where_the_first_stopped(spark, tmp_path):
    folder = f"file://{tmp_path}/history"
    one = AcceptedHistory(spark, folder)
    one.accept(spark.createDataFrame([(1, "/a/Silver Lake (1999).mkv", H[1]), (2, "/b.bin", H[2]), (3, "/c.bin", H[3])], FILE))
    two = AcceptedHistory(spark.newSession(), folder)
    got = two.accept(spark.createDataFrame([(11, "/x.bin", H[1]), (12, "/b.bin", H[3])], FILE))
    assert {tuple(r) for r in got.collect()} == {(11, 1), (12, 2)}
    three = AcceptedHistory(spark, folder)
    assert three.batches == 2
    got = three.accept(spark.createDataFrame([(21, "/c.bin", None), (22, "/q/Silver Lkae 1999.avi", None)], FILE))
    assert {tuple(r) for r in got.collect()} == {(21, 2), (22, 1)}
    three.compact()
    four = AcceptedHistory(spark, folder)
    got = four.accept(spark.createDataFrame([(31, "/d.bin", H[3])], FILE))
    assert {tuple(r) for r in got.collect()} == {(31, 2)}


def test_a_batch_that_did_not_end_leaves_nothing(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/history"
    AcceptedHistory(spark, folder).accept(spark.createDataFrame([(1, "/a.bin", H[1])], FILE))
    broken = AcceptedHistory(spark, folder)
    monkeypatch.setattr(broken, "_commit", lambda state: (_ for _ in ()).throw(OSError("lost")))
    try:
        broken.accept(spark.createDataFrame([(2, "/b.bin", H[2])], FILE))
    except OSError:
        pass
    again = AcceptedHistory(spark, folder)
    assert again.batches == 1
    got = again.accept(spark.createDataFrame([(3, "/b.bin", H[2])], FILE))
    assert {tuple(r) for r in got.collect()} == {(3, 3)}


def test_only_the_buckets_touched_are_read(spark, tmp_path):
    history = AcceptedHistory(spark, f"file://{tmp_path}/history", buckets=64)
    history.accept(spark.createDataFrame([(i, f"/{i}.bin", f"{i:040x}") for i in range(1, 400)], FILE))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = history._read("keys", history.KEYS, [3, 5])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[p#\d+ IN \(3,5\)\]", plan)


def test_slips_in_short_titles(spark):
    titles = [("Silver Lake (1999)", "Silver Lkae (1999)"), ("Inception (2010)", "Incepton (2010)"), ("Harbour S01E02", "Harbuor S01E02"), ("Iron Man (2008)", "Iron Mam (2008)")]
    titles += [("Nightingale (1977)", "Nihgtingael (1977)"), ("Red Moon Rising (1980)", "Rad Moon Risng (1980)"), ("Silver Fox (1950)", "SilverFox (1950)")]
    apart = ["Silver Lake (2001)", "Harbour S01E03", "Iron Man 2 (2008)", "Iron Can (2009)", "Interception (2010)"]
    rows = [(2 * k + j + 1, f"/m/{t}.mkv", None, j) for k, pair in enumerate(titles) for j, t in enumerate(pair)]
    rows += [(100 + k, f"/m/{t}.mkv", None, 1) for k, t in enumerate(apart)]
    assert repeats(spark, rows) == [(2 * k + 1, 2 * k + 2) for k in range(len(titles))]
