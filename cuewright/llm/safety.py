"""Scores of abusive, hateful and sexually explicit language."""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.language_words import SEEDS
from cuewright.llm.offence_words import CLASSES, SEED_HARMLESS, SEED_OFFENSIVE

BITS = 20  #: the hash space has 2^BITS weights
SAMPLE = 6000  #: labelled documents to learn from, at most
SAMPLE_CHARS = 50_000_000  #: characters of these together, at most: no document is left out for its length alone
WEIGHT = 3.0  #: of an offending passage, as these are few beside the harmless ones
NOVELTY = 5.0  #: how much a passage unlike those of harmless documents is the likelier to offend
WINDOW, STEP = 16, 5  #: words scored together, and how far the next window is

INVISIBLE = {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, 0x180E)}
HIDDEN = re.compile("[" + "".join(map(chr, INVISIBLE)) + "]")
INDIC = regex.compile(r"[\p{Devanagari}\p{Tamil}]")
#: Letters that look like Latin ones, and signs that stand for letters inside words.
LOOKALIKE = str.maketrans("аеорсухіјѕԁвкмнтАЕОРСХІЈВКМНТαορετικνυ", "aeopcyxijsdbkmhtAEOPCXIJBKMHTaopetikvu")
SIGNS = str.maketrans("013457$@!", "oieastsai")
SPACED = regex.compile(r"(?<![\p{L}\p{M}\p{N}$@*])(?:[\p{Latin}0-9$@*]([ .\-_*]))(?:[\p{Latin}0-9$@*]\1)+[\p{Latin}0-9$@*](?![\p{L}\p{M}\p{N}$@*])")


@lru_cache(maxsize=None)
def vocabulary() -> dict[str, str]:
    return {word: name for name, words in CLASSES.items() for word in words.split()}


@lru_cache(maxsize=None)
def _pieces() -> frozenset[str]:
    """Words that a run of single letters may be made of."""
    seeds = regex.findall(r"\p{Latin}+", f"{SEED_OFFENSIVE} {SEED_HARMLESS}".lower())
    return frozenset({_squeeze(w) for w in seeds if len(w) > 2} | {w for w in vocabulary() if w.isascii()} | {"a", "i", "is", "an", "my", "to", "of", "in"})


def _squeeze(word: str) -> str:
    return regex.sub(r"(\p{L})\1+", r"\1", word)


@lru_cache(maxsize=1 << 18)
def normal_token(token: str) -> str:
    """A word without disguise: case, marks, look-alike letters, signs for letters, stretched letters."""
    if INDIC.search(token):
        return token
    t = token.translate(LOOKALIKE) if regex.search(r"\p{Latin}|[$@0-9*]", token) or regex.fullmatch(r"[\p{Cyrillic}\p{Greek}]+", token) else token
    t = "".join(c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", t).lower()) if not unicodedata.combining(c))
    if regex.search(r"\p{L}|[$@*]", t) and regex.search(r"[0-9$@!]", t) and not regex.fullmatch(r"[0-9]+\p{L}{0,2}", t):
        t = t.rstrip("!").translate(SIGNS)
    t = _squeeze(t)
    if "*" in t:  # hidden letters: the one known word that fits, if any
        pattern = regex.compile(regex.sub(r"\*+", lambda m: ".{1,%d}" % (len(m[0]) + 1), t))
        fits = sorted(w for w in _pieces() if len(w) > 2 and abs(len(w) - len(t)) <= 2 and pattern.fullmatch(w)) if t.strip("*") else []
        t = fits[0] if fits else t.replace("*", "")
    return t


def _join(run: str) -> str:
    """The words that a run of single letters spells, as far as they are known."""
    letters = _squeeze(normal_token("".join(regex.findall(r"[\p{L}0-9$@*]", run))))
    best: list[tuple[int, list[str]] | None] = [(0, [])] + [None] * len(letters)
    for end in range(1, len(letters) + 1):
        for start in range(max(0, end - 16), end):
            if best[start] is not None and letters[start:end] in _pieces():
                cost = best[start][0] + 1
                if best[end] is None or cost < best[end][0]:
                    best[end] = (cost, best[start][1] + [letters[start:end]])
    return " ".join(best[-1][1]) if best[-1] else letters


@lru_cache(maxsize=None)
def _patterns() -> tuple[tuple[re.Pattern, re.Pattern], tuple]:
    """How runs of single letters and words are found: for texts of plain ASCII, and for all others."""
    ascii_part, part = "A-Za-z0-9$@*", r"\p{L}\p{M}\p{N}$@*"
    word = r"[{0}](?:[{0}]|!(?=[{0}]))*(?:['’][{1}]+)*"
    plain = re.compile(word.format(ascii_part, "A-Za-z").replace("’", "") + r"|[.!?]+(?=\s|\Z)|\n")
    plain_run = re.compile(rf"(?<![{ascii_part}])[{ascii_part}]([ .\-_*])(?:[{ascii_part}]\1)+[{ascii_part}](?![{ascii_part}])")
    return (plain_run, plain), (SPACED, regex.compile(word.format(part, r"\p{L}\p{M}") + r"|[.!?…।]+(?=\s|\Z)|\n"))


ENDS = frozenset(".!?…।\n")


class _Words(dict):
    """Numbers of words as written: their place in the tables of hashes; -1 for a word that is nothing once freed of disguise."""

    def __init__(self) -> None:
        self.hashes: list[tuple[int, int]] = []
        self.places: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        word = "" if token[0] in ENDS else normal_token(token)
        at = -2 if token[0] in ENDS else -1
        if word:
            at = self.places.get(word, -1)
            if at < 0:
                at = self.places[word] = len(self.hashes)
                self.hashes.append(_hash(word))
        if len(self) < 1 << 20:
            self[token] = at
        return at


def _found(text: str) -> list[str]:
    """The words of a text as written, and the marks that end its sentences."""
    if text.isascii():
        spaced, words = _patterns()[0]
    else:
        spaced, words = _patterns()[1]
        if HIDDEN.search(text):
            text = text.translate(INVISIBLE)
    return words.findall(spaced.sub(lambda m: _join(m[0]), text))


def _windows(n: np.ndarray) -> np.ndarray:
    """How many windows a passage of n words is cut into."""
    return np.where(n <= WINDOW, 1, -(-(n - WINDOW + STEP) // STEP))


def passages(text: str) -> list[list[str]]:
    """The text as passages of words; long ones become overlapping windows."""
    out, words = [], []
    for token in [*_found(text), "\n"]:
        if token[0] not in ENDS:
            if word := normal_token(token):
                words.append(word)
        elif words:
            out += [words[i * STEP : i * STEP + WINDOW] for i in range(int(_windows(np.array(len(words)))))]
            words = []
    return out


@lru_cache(maxsize=1 << 18)
def _hash(word: str) -> tuple[int, int]:
    """Hashes of the word and of its class, or of the word again."""
    import xxhash

    name = vocabulary().get(word)
    a = xxhash.xxh64_intdigest(word)
    return a, xxhash.xxh64_intdigest(f"<{name}>") if name else a


def _grams(both: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Hashed features of words in passages: the features, where their first word is, and how far the last is.

    Words, pairs and triples of neighbours, and pairs with one or two words left out between, over
    the words as they are and with words of a class replaced by it.
    """
    mask = np.uint64((1 << BITS) - 1)

    def placed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) & mask).astype(np.int64)

    with np.errstate(over="ignore"):
        special = both[:, 0] != both[:, 1]
        for kind in (0, 1):
            h = both[:, kind]
            salt = np.uint64(kind * 77 + 1)
            at = np.nonzero(special)[0] if kind else np.arange(len(h))
            yield placed(h[at] * salt), at, 0
            for gap in (1, 2, 3):
                same = owner[:-gap] == owner[gap:] if gap < len(h) else np.zeros(0, bool)
                if kind and len(same):
                    same = same & (special[:-gap] | special[gap:])
                at = np.nonzero(same)[0]
                yield placed(h[at] * np.uint64(31) + h[at + gap] * np.uint64(17) + np.uint64(gap) * np.uint64(0x9E3779B97F4A7C15) + salt), at, gap
            if len(h) > 2:
                same = owner[:-2] == owner[2:]
                if kind:
                    same = same & (special[:-2] | special[1:-1] | special[2:])
                at = np.nonzero(same)[0]
                yield placed(h[at] * np.uint64(131) + h[at + 1] * np.uint64(37) + h[at + 2] * np.uint64(7) + salt), at, 2


def features(parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of passages: the feature and the passage of each."""
    sizes = np.array([len(p) for p in parts])
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    found = [(f, owner[at]) for f, at, _ in _grams(np.array([_hash(w) for p in parts for w in p], np.uint64), owner)]
    return np.concatenate([f for f, _ in found]), np.concatenate([o for _, o in found])


class Ftrl:
    """FTRL-proximal logistic regression: a learning rate for each weight, and L1 that leaves most at zero."""

    def __init__(self, alpha: float = 0.25, beta: float = 1.0, l1: float = 0.6, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, target: float, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
        g = (p - target) * weight
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


BIAS = 1 << BITS


def _split(parts: list[list[str]]) -> list[np.ndarray]:
    at, owner = features(parts)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(parts)))
    return [np.r_[np.unique(x), BIAS] for x in np.split(at[order], cuts)]


def train(labelled: list[tuple[str, bool]], rounds: int = 5, seed: int = 5, weight: float = WEIGHT) -> np.ndarray:
    """Weights from labelled texts and the seed passages.

    A labelled document tells only that some passage offends. Each round takes the passages of an
    offending document that score highest, by the weights so far and by how much of them no harmless
    document has, as its offending ones, and all of a harmless document as harmless.
    """
    rng = random.Random(seed)
    model = Ftrl()
    seeds = [(x, True) for x in _split([w for line in SEED_OFFENSIVE.strip().split("\n") for w in passages(line.replace(".", " "))])]
    calm_lines = [*SEED_HARMLESS.strip().split("\n"), *(line for text in SEEDS.values() for line in text.split("|"))]
    seeds += [(x, False) for x in _split([w for line in calm_lines for w in passages(line)])]
    for _ in range(6):
        rng.shuffle(seeds)
        for x, y in seeds:
            model.update(x, float(y))
    harmless: dict[bytes, np.ndarray] = {}
    offending = []
    for text, bad in labelled:
        split = _split(p) if (p := passages(text)) else []
        if bad:
            offending.append(split)
        else:
            harmless.update((x.tobytes(), x) for x in split)
    calm = list(harmless.values())
    seen = np.zeros(BIAS + 1, bool)
    for x in calm:
        seen[x] = True
    novel = [np.array([1 - seen[x].mean() for x in split]) for split in offending]
    for k in range(rounds):
        rows = list(seeds)
        w = model.weights()
        for split, new in zip(offending, novel):
            scores = np.array([w[x].sum() for x in split]) if split else np.zeros(0)
            if len(scores):
                top = int((scores + NOVELTY * new).argmax())
                rows += [(split[i], True) for i in range(len(split)) if i == top or (scores[i] > 1.5 and new[i] > 0.3)]
        rows += [(x, False) for x in calm]
        rng.shuffle(rows)
        for x, y in rows:
            model.update(x, float(y), weight if y else 1.0)
    return model.weights()


def text_scores(texts: list[str | None], w: np.ndarray, known: _Words | None = None) -> tuple[np.ndarray, list[str | None]]:
    """The score of each text, that of its worst passage, and that passage's words.

    Words are looked up once as written; features are hashed once for each word, and only those with a
    weight are handed to the windows they lie in.
    """
    known = _Words() if known is None else known
    tokens = [_found(t) if t else [] for t in texts]
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(tokens)), np.int64)
    text_of = np.repeat(np.arange(len(texts)), [len(p) for p in tokens])
    score = np.full(len(texts), -30.0)
    worst: list[str | None] = [None] * len(texts)
    # A passage ends with its text or at a mark; marks and empty words are then left out.
    passage = np.cumsum(np.r_[0, (flat[:-1] == -2) | (text_of[1:] != text_of[:-1])]) if len(flat) else flat
    use = flat >= 0
    if not use.any():
        return 1 / (1 + np.exp(-score)), worst
    place = np.nonzero(use)[0]
    flat, text_of, passage = flat[use], text_of[use], passage[use]
    both = np.array(known.hashes, np.uint64)[flat]
    _, first, size = np.unique(passage, return_index=True, return_counts=True)
    owner = np.repeat(np.arange(len(first)), size)
    count = _windows(size)
    base = np.r_[0, np.cumsum(count)[:-1]]  # the number of each passage's first window
    keys = []
    for f, at, span in _grams(both, owner):
        pick = w[f] != 0
        f, at = f[pick], at[pick]
        k = owner[at]
        i = at - first[k]
        low = np.maximum(0, -(-(i + span - WINDOW + 1) // STEP))
        high = np.minimum(i // STEP, count[k] - 1)
        times = np.maximum(high - low + 1, 0)
        window = np.repeat(base[k] + low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys.append(window * (BIAS + 1) + np.repeat(f, times))
    own, at = np.divmod(np.unique(np.concatenate(keys)), BIAS + 1)  # a feature counts once in a passage
    total = np.bincount(own, weights=w[at], minlength=int(count.sum())) + w[BIAS]
    owners = np.repeat(text_of[first], count)
    np.maximum.at(score, owners, total)
    starts = np.repeat(first, count) + (np.arange(len(owners)) - np.repeat(base, count)) * STEP
    ends = np.repeat(first + size, count)
    offset = np.r_[0, np.cumsum([len(p) for p in tokens])]
    for j in np.nonzero(total >= score[owners])[0]:
        t = owners[j]
        if worst[t] is None:
            worst[t] = " ".join(normal_token(tokens[t][x - offset[t]]) for x in place[starts[j] : min(starts[j] + WINDOW, ends[j])])
    return 1 / (1 + np.exp(-np.clip(score, -30, 30))), worst


def offence_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Each document with its score: doc_id, source, score (0 to 1) and the passage that scores highest.

    The classifier is FTRL-proximal logistic regression over hashed word n-grams and skip-grams, fitted
    on at most ``SAMPLE`` labelled documents of ``SAMPLE_CHARS`` characters in all (chosen by a hash of the id,
    whatever their length) and the seed passages; its
    sparse weights are sent to all tasks, as many as their number of non-zero weights, at most 2^BITS.
    Every document is scored over its whole text. Defined cases: a null or empty text, or one without
    words, scores next to 0; rows that occur twice are each scored; labels of unknown documents or with
    a null category are not used; without labels the seeds alone decide.
    """
    spark = documents.sparkSession
    known = labels.where("doc_id is not null and category is not null").groupBy("doc_id").agg(F.max("category").alias("category"))
    sample = documents.select("doc_id", "text").join(known, "doc_id").where("text <> ''").withColumn("order", F.xxhash64("doc_id"))
    sample = sample.dropDuplicates(["doc_id"]).orderBy("order", "doc_id").limit(SAMPLE)
    before = F.sum(F.length("text")).over(Window.orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1))  # of SAMPLE rows
    sample = sample.withColumn("before", before).where(F.coalesce("before", F.lit(0)) + F.length("text") <= SAMPLE_CHARS)
    rows = sorted(sample.select("doc_id", "text", "category").collect())
    weights = train([(r.text, r.category.strip().lower() != "none") for r in rows])
    at = np.nonzero(weights)[0]
    sent = spark.sparkContext.broadcast((at.astype(np.int32), weights[at].astype(np.float32)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, values = sent.value
        w = np.zeros((1 << BITS) + 1)
        w[where] = values
        known = _Words()
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part = pdf.iloc[start : start + 500]
                s, worst = text_scores(part["text"].tolist(), w, known)
                yield pd.DataFrame({"doc_id": part["doc_id"], "source": part["source"], "score": s, "passage": worst})

    return documents.select("doc_id", "source", "text").mapInPandas(score, "doc_id bigint, source string, score double, passage string")


THRESHOLD = 0.5


def source_name(source: Column | str = "source") -> Column:
    """A source's name in one spelling; missing ones are ``unknown``."""
    name = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def offence_rates(scores: DataFrame) -> DataFrame:
    """Documents, offending documents and their rate by source."""
    flagged = F.sum((F.col("score") >= THRESHOLD).cast("bigint"))
    rows = scores.groupBy(source_name().alias("source")).agg(F.count("*").alias("documents"), flagged.alias("offending"))
    return rows.withColumn("rate", F.col("offending") / F.col("documents"))
