"""Splitting of oversized texts at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 600, 80

#: Where a text without structure is cut, from the coarsest boundary to the finest.
LEVELS = (
    regex.compile(r"\n\s*"),  # lines
    regex.compile(r"(?<=[.!?…।॥。！？][\"'”’)\]]*)\s+|(?<=[。！？])"),  # sentences
    regex.compile(r"(?<=[;:,،、，；—–-])\s+|\s+(?=[—–-]\s)"),  # clauses
    regex.compile(r"\s+"),  # words
)
HEADING = regex.compile(r"(?m)^[ \t]*(?:(#{1,6})[ \t]|<h([1-6])\b|(?=\S[^\n]*\n[ \t]*(={3,}|-{3,})[ \t]*$))")
PARAGRAPH = regex.compile(r"\n[ \t]*\n\s*")
LINE = regex.compile(r"(?m)^([ \t]*)([-*+•‣◦–][ \t]+|\(?(?:\d{1,3}|[A-Za-z])[.)][ \t]+)?(?=\S)")
TAG = regex.compile(r"<(/?)([A-Za-z][\w:.-]*)\b[^<>]*?(/?)>")
#: Elements within a line of text, which are no structure, and elements that have no end.
INLINE = frozenset("a abbr b bdi bdo big cite code del em font i ins kbd mark q s samp small span strike strong sub sup u v c".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SPACE = regex.compile(r"\s+")
CHARACTER = regex.compile(r"\X")

Span = tuple[int, int]


def _cut_at(span: Span, cuts: list[int]) -> list[Span]:
    """The parts of a span between cuts; each holds the separator that follows it, so parts leave no gap."""
    cuts = sorted({c for c in cuts if span[0] < c < span[1]})
    return list(zip([span[0], *cuts], [*cuts, span[1]]))


def _sections(text: str, span: Span) -> list[Span]:
    """The sections under the highest headings but one that opens the span."""
    found = []
    opening = SPACE.match(text, *span)
    opening = opening.end() if opening else span[0]
    for m in HEADING.finditer(text, *span):
        if m.start() > opening:
            depth = len(m[1]) if m[1] else int(m[2]) if m[2] else 1 if m[3][0] == "=" else 2
            found.append((depth, m.start()))
    top = min((d for d, _ in found), default=0)
    return _cut_at(span, [at for d, at in found if d == top])


def _elements(text: str, span: Span) -> list[Span]:
    """The outermost elements of markup that divide the span."""
    cuts: dict[int, list[int]] = {}
    stack: list[str] = []
    for m in TAG.finditer(text, *span):
        name = m[2].lower()
        if name in INLINE:
            continue
        after = SPACE.match(text, m.end(), span[1])
        after = after.end() if after else m.end()
        if m[1]:
            if name in stack:
                while stack.pop() != name:
                    pass
                cuts.setdefault(len(stack), []).append(after)
        else:
            cuts.setdefault(len(stack), []).append(m.start())
            if m[3] or name in VOID:
                cuts[len(stack)].append(after)
            else:
                stack.append(name)
    for depth in sorted(cuts):
        if len(parts := _cut_at(span, cuts[depth])) > 1:
            return parts
    return [span]


def _items(text: str, span: Span) -> list[Span]:
    """The items of the outermost list, each with what is indented below it, if the span is a list."""
    lines = [(m.start(), len(m[1].expandtabs(4)), bool(m[2])) for m in LINE.finditer(text, *span) if m.end() < span[1]]
    marked = [indent for _, indent, item in lines if item]
    if not marked or not lines[0][2]:
        return [span]
    top = min(marked)
    if any(indent <= top and not item for _, indent, item in lines):
        return [span]
    return _cut_at(span, [at for at, indent, item in lines if item and indent <= top])


def _structure(text: str, span: Span) -> list[Span]:
    """The subtrees of a span: sections, elements, list items or paragraphs; the span itself if it has none."""
    for parts in (_sections, _elements, _items):
        if len(found := parts(text, span)) > 1:
            return found
    found = _cut_at(span, [m.end() for m in PARAGRAPH.finditer(text, *span)])
    if len(found) > 1:
        return found
    # A line that leads into a list is a sibling of the items.
    lines = [(m.start(), bool(m[2])) for m in LINE.finditer(text, *span)]
    first = next((at for at, item in lines if item and at > span[0]), None)
    return _cut_at(span, [first]) if first is not None and sum(item for _, item in lines) > 1 else [span]


def _plain(text: str, span: Span, level: int, limit: int) -> list[Span]:
    """Parts within the limit of a span without structure, at the coarsest boundaries, merged as far as they fit."""
    if span[1] - span[0] <= limit:
        return [span]
    children = [span]
    while level < len(LEVELS) and len(children := _cut_at(span, [m.end() for m in LEVELS[level].finditer(text, *span)])) < 2:
        level += 1
    if level == len(LEVELS):  # no boundary is left: cut between characters, marks stay with their letter
        cuts, last = [], span[0]
        for m in CHARACTER.finditer(text, *span):
            if m.end() - last > limit:
                cut = m.start() if m.start() > last else last + limit
                while cut < m.end():
                    cuts.append(cut)
                    last = cut
                    cut = last + limit
        return _cut_at(span, cuts)
    packed: list[Span] = []
    for child in children:
        for a, b in _plain(text, child, level + 1, limit):
            if packed and b - packed[-1][0] <= limit:
                packed[-1] = (packed[-1][0], b)
            else:
                packed.append((a, b))
    return packed


def _is_heading(text: str, span: Span) -> bool:
    return bool(HEADING.match(text, *span)) and len(text[slice(*span)].strip().split("\n")) <= 2


def _pack(text: str, span: Span, limit: int) -> list[Span]:
    """Subtrees of at most ``limit`` characters that cover ``span``.

    Sibling subtrees that fit are merged from left to right; one that does not is opened, and what comes
    out of it is merged with none of its siblings, except that a heading stays with what follows it.
    """
    packed: list[Span] = []
    todo = [(span, 0)]  # a stack, as markup may be nested deeply
    parent_of: list[int] = []
    opened = 0
    while todo:
        node, parent = todo.pop()
        if node[1] - node[0] > limit:
            children = _structure(text, node)
            if len(children) > 1:
                opened += 1  # names the parent of these children
                todo += [(child, opened) for child in reversed(children)]
                continue
            parts, parent = _plain(text, node, 0, limit), -1
        else:
            parts = [node]
        for a, b in parts:
            joined = packed and b - packed[-1][0] <= limit
            if joined and (parent_of[-1] == parent != -1 or _is_heading(text, packed[-1])):
                packed[-1] = (packed[-1][0], b)
                parent_of[-1] = parent
            else:
                packed.append((a, b))
                parent_of.append(parent)
    return packed


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces ``(start, own_start, end)`` of the text as offsets in code points.

    ``text[start:own_start]`` repeats the end of the piece before, ``text[own_start:end]`` is new;
    the new parts follow each other without a gap, so joining them gives back the text without the
    white space at its ends. A text within the limit is one piece, an empty one none.
    """
    if not text or not text.strip():
        return []
    first = len(text) - len(text.lstrip())
    last = len(text.rstrip())
    if last - first <= limit:
        return [(first, first, last)]
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    pieces = []
    for a, b in _pack(text, (first, last), limit - overlap):
        start = a
        if pieces and overlap:
            low = max(a - overlap, pieces[-1][1])
            # Begin the repeated part at a word, if one begins in its first half; else at a whole character.
            starts = [m.end() for m in SPACE.finditer(text, max(low - 1, 0), a) if low <= m.end() <= low + overlap // 2]
            start = starts[0] if starts else low
            while start < a and regex.match(r"\p{M}", text[start]):
                start += 1
        pieces.append((start, a, b))
    return pieces


def trimmed(text: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def oversized(items: DataFrame, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Rows whose text, white space at its ends not counted, has more than ``limit`` code points."""
    return items.where((F.length(text) > limit) & (F.length(trimmed(F.col(text))) > limit))


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each oversized text of ``items`` (origin, item_id, item_no, text).

    A text is read as a tree of sections by the depth of their headings, elements of markup, list items by
    their indentation and paragraphs; what has no structure is cut at lines, sentences, clauses, words or
    characters. Sibling subtrees are merged as long as they fit; only nodes above the limit are opened. Each piece but the first repeats about the last ``overlap`` characters of the one before,
    cut at a word. Columns: origin, item_id, item_no, piece_no (from 0), n_pieces, start, own_start,
    end (offsets in code points in the text as stored) and piece. Null, blank and short texts give no
    rows; rows that occur twice are each split. No shuffle: a text is split where it is read.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for origin, item, no, text in zip(pdf["origin"], pdf["item_id"], pdf["item_no"], pdf["text"]):
                cut = split_text(text, limit, overlap)
                rows += [(origin, item, no, k, len(cut), a, o, b, text[a:b]) for k, (a, o, b) in enumerate(cut)]
            yield pd.DataFrame(rows, columns=["origin", "item_id", "item_no", "piece_no", "n_pieces", "start", "own_start", "end", "piece"])

    schema = "origin string, item_id bigint, item_no int, piece_no int, n_pieces int, start int, own_start int, end int, piece string"
    return oversized(items, "text", limit).select("origin", "item_id", "item_no", "text").mapInPandas(pieces, schema)


def segment_items(segments: DataFrame, transcriptions: DataFrame) -> DataFrame:
    """The texts of segments and of the segments inside transcriptions, in one form."""
    own = segments.select(
        F.lit("media_segments").alias("origin"), F.col("segment_id").alias("item_id"), F.lit(0).alias("item_no"), F.col("seg_text").alias("text")
    )
    nested = transcriptions.select(
        F.lit("transcriptions").alias("origin"), F.col("transcription_id").alias("item_id"), F.posexplode("segments").alias("item_no", "s")
    ).select("origin", "item_id", "item_no", F.col("s.seg_text").alias("text"))
    return own.unionByName(nested)
