import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuewright.llm.splitting import segment_items, split_oversized, split_text


def check(text, limit=600, overlap=80):
    cut = split_text(text, limit, overlap)
    stripped = text.strip()
    if not stripped:
        assert cut == []
        return cut
    assert "".join(text[o:e] for _, o, e in cut) == stripped
    assert all(e - s <= limit for s, _, e in cut)
    assert all(0 <= o - s <= overlap for s, o, _ in cut)
    assert cut[0][0] == cut[0][1]
    assert (len(cut) > 1) == (len(stripped) > limit)
    return cut


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n,-#éி中", max_size=400), st.integers(12, 60), st.integers(0, 11))
def test_exact_round_trip(text, limit, overlap):
    check(text, limit, overlap)


@pytest.mark.parametrize("text", ["", "  ", "x" * 600, "x" * 601, " " * 700, "word " * 5000, "One sentence here. " * 200, "\n\n".join(["- item"] * 400), "क्षि" * 900, "# H\ntext\n" * 200, "。".join(["句子"] * 500)])
def test_shapes(text):
    check(text)


def test_boundaries():
    text = ("A sentence of some words here. " * 12 + "\n\n") * 4
    cut = check(text)
    assert all(text[o:e].rstrip().endswith(".") for _, o, e in cut)
    assert all(text[s - 1].isspace() for s, _, _ in cut[1:])
    assert all(40 <= o - s <= 80 for s, o, _ in cut[1:])
    words = check("word " * 1000)
    assert all(o - s >= 40 for s, o, _ in words[1:])


def test_limits_must_fit():
    with pytest.raises(ValueError):
        split_text("x" * 700, 50, 50)


def test_tables(spark):
    long = "A sentence of words. " * 60
    s = spark.createDataFrame([(1, f"  {long}"), (2, None), (3, "short"), (4, " " * 900), (5, long), (5, long)], "segment_id long, seg_text string")
    t = spark.createDataFrame([(9, [("short", 0.0), (long, 1.0), (None, 2.0)]), (10, None), (11, [])], "transcription_id long, segments array<struct<seg_text: string, start_s: double>>")
    rows = split_oversized(segment_items(s, t)).collect()
    assert {(r.origin, r.item_id, r.item_no) for r in rows} == {("media_segments", 1, 0), ("media_segments", 5, 0), ("transcriptions", 9, 1)}
    own = [r for r in rows if r.item_id == 9]
    assert "".join(r.piece[r.own_start - r.start :] for r in sorted(own, key=lambda r: r.piece_no)) == long.strip()
    assert len([r for r in rows if r.item_id == 5]) == 2 * len(own)
    assert split_oversized(segment_items(s.limit(0), t.limit(0))).count() == 0


def own(text, limit=600, overlap=0):
    return [text[o:e] for _, o, e in check(text, limit, overlap)]


def test_sections_stay_with_their_heading():
    body = lambda n: ("Some words in a sentence here. " * 40)[:n].strip() + "\n\n"
    text = f"# A\n\n{body(120)}## A1\n\n{body(300)}## A2\n\n{body(250)}# B\n\n{body(40)}## B1\n\n{body(330)}"
    pieces = own(text)
    assert [p.split("\n")[0] for p in pieces] == ["# A", "## A2", "# B"]
    assert not any("## A2" in p and "# B\n" in p for p in pieces)
    assert "## B1" in pieces[2]
    setext = f"Title\n=====\n\n{body(300)}Part\n----\n\n{body(320)}Other\n=====\n\n{body(100)}"
    assert [p.split("\n")[0] for p in own(setext)] == ["Title", "Part", "Other"]


def test_nested_lists():
    item = lambda mark, n: f"{mark} " + ("word " * 60)[:n].strip() + "\n"
    one = item("-", 100) + "".join(item("  -", 90) for _ in range(4))
    two = item("-", 100) + "".join(item("  1.", 90) for _ in range(4))
    pieces = own(one + two)
    assert [p.strip() for p in pieces] == [one.strip(), two.strip()]  # an item and what is below it
    spaced = (one + two).replace("\n", "\n\n")
    assert [p.strip() for p in own(spaced)] == [one.replace("\n", "\n\n").strip(), two.replace("\n", "\n\n").strip()]
    big = item("-", 100) + "".join(item("  -", 200) for _ in range(5)) + item("-", 50)
    pieces = own(big)
    assert all(p.lstrip().startswith("-") for p in pieces) and pieces[-1].startswith("- word")


def test_markup():
    row = lambda n: "<p>" + ("Some <i>words</i> here. " * 20)[:n].rsplit(" ", 1)[0] + "</p>"
    text = f"<div id='a'>{row(240)}\n{row(240)}</div><div>{row(200)}{row(330)}{row(300)}</div><br/><div>{row(100)}</div>"
    pieces = own(text)
    assert pieces[0].startswith("<div id='a'>") and pieces[0].endswith("</div>")
    assert all(p.startswith("<") for p in pieces)
    assert pieces[-1].startswith("<br/><div>")
    assert own("<a>" * 400 + "x" * 700 + "</b>" * 50)


def test_deep_and_long_texts_end():
    import time

    began = time.perf_counter()
    check("<div>" * 300 + "word " * 2000 + "</div>" * 300)
    check("".join(f"{'#' * (i % 6 + 1)} h{i}\ntext {i}\n" for i in range(8000)))
    check("".join(f"{' ' * (i % 40)}- item {i}\n" for i in range(8000)))
    assert time.perf_counter() - began < 20
