"""Speaker numbers of all spellings of a label within a transcript."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions.speakers import NUMBER_WORDS, label_key, label_number, opener_token
from cuewright.session import staged

FORM = r"^(\p{L}{1,20})[\s_#.:\-–]*(\p{L}{2,14}|[0-9]{1,6})$"
NO = 100.0  #: cost of a number that a name cannot stand for


def named(rows: DataFrame, label: str, text: str) -> DataFrame:
    """Adds the name a row gives its speaker (the label, else one that opens the text) and the number it reads as."""
    read = label_number(F.col(label))
    rows = rows.withColumns({"_key": label_key(F.col(label)), "_read": read, "_opener": opener_token(F.col(text))})
    name = F.when(F.col("_read").isNotNull(), F.col("_key")).otherwise(F.coalesce("_opener", "_key"))
    return rows.withColumns({"name": name, "number": F.coalesce("_read", label_number(F.col("_opener")))}).drop("_key", "_read", "_opener")


def assign(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of least total cost (rows <= columns)."""
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0] = i
        least = np.full(m + 1, np.inf)
        used = np.zeros(m + 1, dtype=bool)
        way = np.zeros(m + 1, dtype=int)
        j = 0
        while match[j]:
            used[j] = True
            row = match[j]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(np.argmin(free)) + 1
            delta = free[nxt - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nxt
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = np.zeros(n, dtype=int)
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def roster(names: DataFrame, keys: list[str]) -> DataFrame:
    """The speakers that unreadable names may stand for: the keys, name, candidate number and cost.

    ``names`` has the distinct names of every transcript (keys, name, number). The roster across
    transcripts holds the roles that readable names begin with, in how many transcripts each occurs,
    and the number words. A name that is not readable, such as one with a slip, is compared only with
    the roster entries of its phonetic blocks: number words of its Soundex code, and roles of that or, as a
    slip may change the code, of the same first or last two letters. Digits stand for themselves.
    """
    spark = names.sparkSession
    roles = names.where("number is not null").select(*keys, F.regexp_extract("name", r"^(\p{L}+?)(?=[\s_#.:\-–0-9]|$)", 1).alias("role"))
    roles = roles.where("length(role) > 2").distinct().groupBy("role").agg(F.count("*").alias("transcripts"))
    blocks = lambda c: F.explode(F.array_distinct(F.array(F.soundex(c), F.concat(F.lit("<"), F.substring(c, 1, 2)), F.concat(F.lit(">"), F.substring(c, -2, 2)))))
    roles = roles.withColumn("block", blocks(F.col("role")))
    words = spark.createDataFrame([(w, i) for i, w in enumerate(NUMBER_WORDS)], "word string, candidate int")
    words = words.withColumn("word_block", F.soundex("word"))
    odd = names.where("number is null").withColumns({"r": F.regexp_extract("name", FORM, 1), "w": F.regexp_extract("name", FORM, 2)}).where("r <> ''")
    forms = odd.select("name", "r", "w", F.soundex("w").alias("word_block")).distinct().withColumn("block", blocks(F.col("r")))
    near = forms.join(roles, "block").withColumn("slips", F.levenshtein("r", "role")).where("slips <= 2")
    best = near.groupBy("name", "w", "word_block").agg(F.max_by(F.struct("role", "slips"), F.struct(F.col("transcripts") - F.col("slips"), "role")).alias("b"))
    best = best.select("name", "w", "word_block", "b.slips")
    spelled = best.where(~F.col("w").rlike("^[0-9]")).join(F.broadcast(words), "word_block").withColumn("cost", F.levenshtein("w", "word"))
    spelled = spelled.where("cost <= 2").select("name", "candidate", (F.col("cost") + F.col("slips")).cast("double").alias("cost"))
    digits = best.where(F.col("w").rlike("^[0-9]")).select("name", F.col("w").cast("int").alias("candidate"), F.col("slips").cast("double").alias("cost"))
    return odd.select(*keys, "name").join(spelled.unionByName(digits), "name")


def assigned(odd: dict[str, dict[int, float]], taken: set[int]) -> dict[str, int]:
    """The number of each unreadable name (name: candidates and their costs) at least total cost.

    No two names get one number as long as their candidates allow; those left over, further spellings of
    one speaker, take their cheapest. A number that readable names of the transcript have is the likelier one.
    """
    names = sorted(odd)
    numbers = sorted({c for costs in odd.values() for c in costs})
    cost = np.full((len(names), len(numbers) + len(names)), NO)
    for i, name in enumerate(names):
        for c, value in odd[name].items():
            cost[i, numbers.index(c)] = value + (0.0 if c in taken else 0.5)
    out = {}
    for i, j in enumerate(assign(cost)):
        best = int(cost[i, : len(numbers)].argmin())
        out[names[i]] = numbers[j] if cost[i, j] < NO else numbers[best]
    return out


def speaker_numbers(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, name, number, ...) with ``speaker_no`` in place of name and number; unknown speakers are left out.

    Readable names have their number; the others are compared with the roster across transcripts and
    assigned within theirs. Rows with a null name are left out. ``rows`` is read twice: give a staged table.
    """
    names = staged(rows.where("name is not null").groupBy(*keys, "name").agg(F.first("number").alias("number")), "names")
    known = rows.withColumn("speaker_no", F.col("number")).where("speaker_no is not null").drop("name", "number")
    if names.where("number is null").isEmpty():
        return known
    odd = staged(roster(names, keys), "odd")
    if odd.isEmpty():
        return known
    # Gathered are the distinct unreadable names of a transcript and its numbers, not its rows.
    groups = odd.groupBy(*keys).agg(F.collect_set(F.struct("name", "candidate", "cost")).alias("odd"))
    taken = names.where("number is not null").join(odd.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.collect_set("number").alias("taken"))
    kinds = [f"{k} {groups.schema[k].dataType.simpleString()}" for k in keys]

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for *at, found, numbers in zip(*(pdf[k] for k in keys), pdf["odd"], pdf["taken"]):
                costs: dict[str, dict[int, float]] = {}
                for o in found:
                    costs.setdefault(o["name"], {})[int(o["candidate"])] = o["cost"]
                out += [(*at, name, no) for name, no in assigned(costs, {int(x) for x in numbers} if numbers is not None else set()).items()]
            yield pd.DataFrame(out, columns=[*keys, "name", "resolved"])

    resolved = staged(groups.join(taken, keys, "left").mapInPandas(resolve, f"{', '.join(kinds)}, name string, resolved int"), "resolved")
    out = rows.join(resolved, [*keys, "name"], "left").withColumn("speaker_no", F.coalesce("number", "resolved"))
    return out.where("speaker_no is not null").drop("name", "number", "resolved")

