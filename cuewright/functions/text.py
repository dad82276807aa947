"""Column functions on titles, times and model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuewright.functions.speakers import let

#: All white space that Python's strip() removes and the JVM's trim() keeps.
WHITE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0"

#: Marks of releases in file names, taken out of titles in this order.
JUNK_PATTERNS = (
    r"\b\d{3,4}p\b",
    r"\b\d{3,4}x\d{3,4}\b",
    r"\b(?:x|h|hevc)?26[45]\b",
    r"\b(?:hdrip|webrip|web[-_. ]?dl|bluray|b[dr]rip|dvdrip)\b",
    r"\b(?:dts|aac|ac3|flac|ddp? ?5[.\s]?1)\b",
    r"\b(?:repack|proper|extended|remastered|unrated|uncut)\b",
    r"\b(?:esub[s]?|subs?)\b",
    r"\b(?:multi|dual[ -]?audio)\b",
    r"\b(?:yts|yify|rarbg|evo|hive|lol|ettv|ntb)\b",
    r"\b(?:hc)?camrip\b",
    r"\b(?:hdr|dolby[ -]?vision|atmos)\b",
)
EPISODE_PATTERN = r"[sS]\d{2}[eE]\d{2}"
_YEAR_IN_BRACKETS = r"^(.*?)\((\d{4})\)"
_YEAR_ALONE = r"^(.*?)\b(19\d{2}|20\d{2})\b"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE))


def clean_title(raw: Column, junk: tuple[str, ...] = JUNK_PATTERNS) -> Column:
    """A title without bracketed parts, release marks and surrounding punctuation."""
    t = F.regexp_replace(F.regexp_replace(raw, r"\[.*?\]", " "), r"\(.*?\)", " ")
    for pattern in junk:
        t = F.regexp_replace(t, f"(?i){pattern}", " ")
    return F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(" -_."))


def title_and_year(stem: Column, junk: tuple[str, ...] = JUNK_PATTERNS) -> Column:
    """Struct of title and year from a file name without extension.

    The year is the first of four digits in round brackets, else the first whole word 19xx or 20xx;
    the title is what stands before it, cleaned, and may be empty. Null for null.
    """

    def parsed(name: Column) -> Column:
        bracketed = name.rlike(r"\(\d{4}\)")
        pattern = lambda i: F.when(bracketed, F.regexp_extract(name, _YEAR_IN_BRACKETS, i)).otherwise(F.regexp_extract(name, _YEAR_ALONE, i))
        year = pattern(2).try_cast("int")
        before = F.when(year.isNotNull(), pattern(1)).otherwise(name)
        return F.struct(clean_title(before, junk).alias("title"), year.alias("year"))

    return F.when(stem.isNotNull(), let(F.translate(stem, "._", "  "), parsed))


def title_or_stem(title: Column, stem: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), stem)


def seconds_of(timestamp: Column) -> Column:
    """Seconds of ``HH:MM:SS.mmm``; 0 for anything else."""
    parts = F.split(timestamp, ":")
    number = lambda i: strip(F.try_element_at(parts, F.lit(i))).try_cast("double")
    whole = F.floor(number(1)) == number(1)
    minutes = F.floor(number(2)) == number(2)
    value = F.when((F.size(parts) == 3) & whole & minutes, number(1) * 3600 + number(2) * 60 + number(3))
    return F.coalesce(value, F.lit(0.0))


def timestamp_of(seconds: Column) -> Column:
    """``HH:MM:SS,mmm`` of seconds, rounded to whole milliseconds, carried into the seconds."""

    def shown(ms: Column) -> Column:
        two = lambda x: F.lpad(x.cast("string"), 2, "0")
        hours = F.floor(ms / 3600000)
        padded = F.when(hours < 100, two(hours)).otherwise(hours.cast("string"))
        minutes, secs = F.floor(F.pmod(ms, F.lit(3600000)) / 60000), F.floor(F.pmod(ms, F.lit(60000)) / 1000)
        return F.concat(padded, F.lit(":"), two(minutes), F.lit(":"), two(secs), F.lit(","), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))

    return let(F.bround(seconds * 1000).cast("bigint"), shown)


def actors_of(names: Column) -> Column:
    """Names of a comma list, without blanks."""
    return F.filter(F.transform(F.split(names, ","), strip), lambda x: x != "")


def json_part(answer: Column) -> Column:
    """The outermost braces of a model's answer, without code fences; the bare answer if there are none."""
    bare = F.regexp_replace(answer, r"```(?:json)?", "")
    return let(strip(bare), lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")), t))


def parsed_json(answer: Column, schema: str) -> Column:
    """The answer as a struct of ``schema``; null if it holds no valid JSON object."""
    part = json_part(answer)
    good = part.startswith("{") & F.try_parse_json(part).isNotNull()
    return F.when(good, F.from_json(part, schema))


def filled_prompt(template: Column, schema_json: Column, examples: Column | None = None) -> Column:
    """A prompt with its schema and examples filled in; the schema is appended where it has no place."""
    examples = F.lit("") if examples is None else F.coalesce(examples, F.lit(""))
    has = F.contains(template, F.lit("{{JSON_SCHEMA}}"))
    placed = F.replace(template, F.lit("{{JSON_SCHEMA}}"), schema_json)
    footer = F.concat(template, F.lit("\n\n## JSON Output Schema\n"), schema_json)
    return F.replace(F.when(has, placed).otherwise(footer), F.lit("{{FEW_SHOT}}"), examples)


def preview(text: Column, length: int = 100) -> Column:
    return F.substring(text, 1, length)


def model_folder(model_id: Column) -> Column:
    return F.replace(model_id, F.lit("/"), F.lit("_"))


def joined_parts(parts: Column) -> Column:
    """The text parts of a message, a line each, without white space at both ends."""
    return strip(F.array_join(F.filter(parts, lambda p: p.isNotNull()), "\n"))
