"""Speaker labels and the marks inside transcribed text, as column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that introduce a numbered speaker, and number words.
ROLES = ("speaker", "spkr", "spk", "sprecher", "sprekerin", "spreker", "locuteur", "hablante", "falante", "parlante")
NUMBER_WORDS = (
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty",
)

_ROLE = "|".join(ROLES)
_WORDS = "|".join(sorted(NUMBER_WORDS, key=len, reverse=True))
_NUMBER = rf"(?:[0-9o]{{1,6}}|{_WORDS})"
_LABEL = rf"(?:(?:{_ROLE})[\s_#.:\-–]*|s[\s_#-]?(?=[0-9]))({_NUMBER})"
TIME_MARK = r"[\[(<]?(?<![0-9:])(?:[0-9]{1,2}:)?[0-9]{1,2}:[0-9]{2}(?:[.,][0-9]{1,3})?(?![0-9:])[\])>]?"
SOUND_NOTE = r"\[[^\]]*+\]|\([^)]*+\)|<[^>]*+>|\{[^}]*+\}|【[^】]*+】|\*[^*\n]++\*|[♪♫♬]+"
HESITATION = (
    r"(?<![\p{L}\p{M}'’-])(?:u+h+-h+u+h+|m+-?h+m+|u+h+m*|u+m+|e+r+m*|e+u+h+|e+h+m*|a+h+m*|ä+h+m*|ö+h+m*|h+m+|m{2,})"
    r"(?![\p{L}\p{M}'’]|-\p{L})"
)
OPENER = (
    rf"^\s*(?:{TIME_MARK}\s*)?(?:>>+\s*)?[\[(<]?\s*{_LABEL}(?:\s*[\])>]\s*:?|\s*[:>]|\s+[-–—](?=\s))"
)

_WIDE = "０１２３４５６７８９"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _narrow(text: Column) -> Column:
    return F.translate(text, _WIDE, "0123456789")


def _number(token: Column) -> Column:
    """The number a lower-case token stands for, as digits (with o for 0) or as a word."""
    words = F.create_map(*[x for i, w in enumerate(NUMBER_WORDS) for x in (F.lit(w), F.lit(i))])
    digits = F.when(token.rlike("^[0-9o]+$"), F.translate(token, "o", "0").cast("int"))
    return F.coalesce(digits, F.try_element_at(words, token))


def label_key(label: Column) -> Column:
    """A label in lower case without brackets, colons and notes of continuation; null if blank."""
    low = F.lower(_narrow(label))
    low = F.regexp_replace(low, r"\((?:cont(?:'d|’d|inued|\.)?)\)", "")
    return F.nullif(F.regexp_replace(low, r"^[\s\[(<{>*\"']+|[\s\])>}:*\"'.\-]+$", ""), F.lit(""))


def label_number(label: Column) -> Column:
    """The speaker number that a label names, from 0; null if it names none."""
    return let(F.regexp_extract(label_key(label), f"^{_LABEL}$", 1), _number)


def opener_token(text: Column) -> Column:
    """The speaker name that opens a text, as a label; null if none does."""
    found = F.regexp_extract(F.lower(_narrow(text)), OPENER, 1)
    return F.concat(F.lit("speaker "), F.nullif(found, F.lit("")))


def speaker_number(label: Column, text: Column) -> Column:
    """The number from the label, else from a speaker name that opens the text; null if unknown."""
    return F.coalesce(label_number(label), label_number(opener_token(text)))


def spoken(text: Column) -> Column:
    """The text without an opening speaker name, time marks, sound notes and hesitation sounds."""
    t = F.regexp_replace(_narrow(text), f"(?i){OPENER}", " ")
    t = F.regexp_replace(t, TIME_MARK, " ")
    t = F.regexp_replace(t, SOUND_NOTE, " ")
    return F.regexp_replace(t, f"(?iu){HESITATION}", " ")


def has_word(text: Column) -> Column:
    """True if anything but marks, notes, hesitations and punctuation is left of the text."""
    return F.coalesce(spoken(text).rlike(r"[\p{L}\p{N}]"), F.lit(False))


def clean_speech(text: Column) -> Column:
    """The spoken words: no names, marks, notes, hesitations, filler phrases or words said twice.

    ``er`` and ``um`` stay where the text has words of a language in which they are words.
    """
    t = F.regexp_replace(_narrow(text), f"(?i){OPENER}", " ")
    t = F.regexp_replace(t, TIME_MARK, " ")
    t = F.regexp_replace(t, SOUND_NOTE, " ")
    words = r"(?iu)(?<!\p{L})(?:ich|und|nicht|ist|hat|dass|een|het|niet|não|uma|que|para|com|você)(?!\p{L})"
    gap = r"\s*(?:[—–]\s*)?"
    tail = r"(?:\.{3}|…|,)?(?:\s*[—–](?=\s|$))?"
    some = HESITATION.replace("u+m+|e+r+m*", "e+r+m+|u+m{2,}")

    def strip(x: Column, sounds: str) -> Column:
        return F.regexp_replace(x, f"(?iu){gap}{sounds}{tail}", " ")

    t = let(t, lambda x: F.when(x.rlike(words), strip(x, some)).otherwise(strip(x, HESITATION)))
    t = F.regexp_replace(t, r"(?i)(?<!\p{L})(?:you know|i mean|like),(?=\s|$)", " ")
    t = F.regexp_replace(t, r"(?iu)(?<![\p{L}\p{M}'’])([\p{L}\p{M}'’]+)((?:\s+\1)+)(?![\p{L}\p{M}'’])", "$1")
    t = F.regexp_replace(t, r"\s+([,.;:!?…])", "$1")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[\s,;:.!?…—–-]+(?=[\p{L}\p{N}])|\s+$|^\s+", "")
