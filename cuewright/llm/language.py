"""Languages of transcriptions and of the segments in them, by a linear-chain conditional random field."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewright.llm.language_words import LANGUAGES, LEXICON, NOTATIONS, PLACEHOLDERS, SEEDS

L = len(LANGUAGES)
BITS = 17
LONG, CHUNK = 24, 12  #: letters from which a word is a run without spaces, and of the chunks it is judged in
SURE = 0.9  #: lead over the main language that a segment of one or two words needs
SAMPLE, SAMPLE_CHARS = 3000, 20_000_000  #: transcriptions to learn from, whole, and characters of these together, at most
RUN = 4  #: words in a row of each of two languages that show a sentence learned from to be mixed
PER_LANGUAGE = 700  #: sentences of one language learned from in a pass, at most
NOTE = re.compile(r"\[[^\]]*\]|\([^)]*\)|<[^>]*>|\{[^}]*\}|【[^】]*】|\*[^*\n]+\*|[♪♫]|\S+://\S+")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}]+)*")
DIGIT = regex.compile(r"\p{N}+")
TURN = re.compile(r"[a-z][A-Z]")  #: where case changes: in encoded bytes every few letters
NOTED = re.compile(r"[\[(<{【*♪♫]|://")
MARKED = re.compile("[\u0300-\u036f\u0900-\u1cff\ua800-\uabff]")  #: marks that follow their letter
SIMPLE = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
ODD = re.compile(r"\d|[a-z][A-Z]|[^\W_]{%d}" % (LONG + 1))
DRAWN = regex.compile(r"(.)\1{3,}")
SENTENCE = regex.compile(r"(?<=[.!?…।])\s+|\n+")
_LEXICON = {w: tuple(i for i, lang in enumerate(LANGUAGES) if w in set(LEXICON[lang].split())) for words in LEXICON.values() for w in words.split()}


def language_code(claimed: Column) -> Column:
    """The two-letter code of a language in any notation; null for none and for placeholders.

    Unknown notations stay as they are, so that they differ from every language.
    """
    low = F.lower(F.regexp_replace(claimed, r"^\s+|\s+$", ""))
    names = F.create_map(*[F.lit(x) for code, words in NOTATIONS.items() for w in words.split() for x in (w, code)])
    base = F.regexp_extract(low, r"^([^\-_.]*)", 1)
    known = F.coalesce(F.try_element_at(names, low), F.try_element_at(names, base))
    return F.when(~low.isin(*PLACEHOLDERS), F.coalesce(known, low))


def words_of(text: str | None) -> list[str]:
    """The spoken words of a text in lower case, without sound notes, addresses, numbers and encoded bytes.

    What mixes digits and letters is no word, unless it is a run without spaces with few digits in it.
    """
    if not text:
        return []
    if NOTED.search(text):
        text = NOTE.sub(" ", text)
    if not ODD.search(text) and not MARKED.search(text):  # the same for plain texts, in one step
        return SIMPLE.findall(text.lower().replace("’", "'"))
    out = []
    for token in WORD.findall(text):
        if not token.isalpha():
            if found := DIGIT.findall(token):
                if len(token) <= LONG or 10 * sum(map(len, found)) > len(token):
                    continue
                out += [w.lower() for w in DIGIT.split(token) if w]
                continue
            token = token.replace("’", "'")
        if len(token) >= 8 and not token.islower() and 5 * len(TURN.findall(token)) >= len(token):
            continue
        out.append(token.lower())
    return out


def chunks_of(words: list[str]) -> list[str]:
    """The words, with runs of more than ``LONG`` letters cut into chunks that are all labelled.

    A cry such as "nooooo" is the word without the drawn-out letter.
    """
    if max(map(len, words), default=0) <= LONG:
        return words
    words = [DRAWN.sub(r"\1", w) if len(w) > LONG else w for w in words]
    return [c for w in words for c in ([w] if len(w) <= LONG else [w[i : i + CHUNK] for i in range(0, len(w), CHUNK)])]


@lru_cache(maxsize=1 << 18)
def word_features(word: str) -> tuple[int, ...]:
    """Hashed features: the word, its affixes, its n-grams, its script and the lexicons it is in."""
    import xxhash

    w = f"^{word}$"
    names = [f"w{word}"]
    names += [f"p{w[:n]}" for n in (2, 3, 4)] + [f"s{w[-n:]}" for n in (2, 3, 4, 5)]
    names += [f"g{w[i : i + 2]}" for i in range(len(w) - 1)] + [f"h{w[i : i + 3]}" for i in range(len(w) - 2)]
    names += [f"l{i}" for i in _LEXICON.get(word, ())]
    names.append("t" if regex.search(r"\p{Tamil}", word) else "d" if regex.search(r"\p{Devanagari}", word) else "a" if word.isascii() else "m")
    mask = (1 << BITS) - 2
    return tuple(sorted({1 + xxhash.xxh32_intdigest(n) % mask for n in names}))


class Crf:
    """Chain over the words of a text: features of the word, and a transition between neighbours."""

    def __init__(self) -> None:
        self.w = np.zeros((1 << BITS, L), np.float32)
        self.t = np.full((L, L), -1.5)
        np.fill_diagonal(self.t, 1.5)
        self.gw = np.full((1 << BITS, L), 1e-6, np.float32)
        self.gt = np.full((L, L), 1e-2)
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, L))

    @staticmethod
    def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The features of words, one after the other, and where those of each word begin."""
        lists = [word_features(w) for w in words]
        return np.array([f for fs in lists for f in fs], np.int64), np.cumsum([0, *[len(fs) for fs in lists[:-1]]])

    def emissions(self, flat: list[str]) -> np.ndarray:
        """Scores of words by language; each distinct word is worked out once for a model."""
        if len(self.known) > 300_000:
            self.known, self.rows = {}, np.zeros((0, L))
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            at, starts = self._features(new)
            self.known.update((w, len(self.rows) + i) for i, w in enumerate(new))
            self.rows = np.concatenate([self.rows, np.add.reduceat(self.w[at], starts, axis=0)])
        return self.rows[np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))]

    def marginals(self, flat: np.ndarray, lengths: np.ndarray, expect: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Forward-backward: each word's chances, and the expected transitions if asked for.

        ``flat`` has the scores of the words of texts of these lengths, one after the other.
        """
        b, m = len(lengths), int(lengths.max())
        mask = np.arange(m) < lengths[:, None]
        e = np.zeros((b, m, L))
        e[mask] = flat
        p = np.exp(e - e.max(2, keepdims=True))
        t = np.exp(self.t - self.t.max())
        alpha, beta = np.empty((b, m, L)), np.ones((b, m, L))
        alpha[:, 0] = p[:, 0] / p[:, 0].sum(1, keepdims=True)
        for k in range(1, m):
            a = (alpha[:, k - 1] @ t) * p[:, k]
            alpha[:, k] = np.where(mask[:, k, None], a / a.sum(1, keepdims=True), alpha[:, k - 1])
        for k in range(m - 2, -1, -1):
            x = (beta[:, k + 1] * p[:, k + 1]) @ t.T
            beta[:, k] = np.where(mask[:, k + 1, None], x / x.sum(1, keepdims=True), 1.0)
        g = alpha * beta
        g /= g.sum(2, keepdims=True)
        expected = None
        if expect:
            expected = np.zeros((L, L))
            if m > 1:
                after = beta[:, 1:] * p[:, 1:]
                total = np.einsum("bki,ij,bkj->bk", alpha[:, :-1], t, after, optimize=True)
                share = np.where(mask[:, 1:], 1 / total, 0.0)
                expected = t * np.einsum("bki,bkj->ij", alpha[:, :-1] * share[:, :, None], after, optimize=True)
        return g[mask], expected

    def fit(self, rows: list[tuple[list[str], np.ndarray]], rounds: int = 4, rate: float = 0.35, seed: int = 3) -> None:
        """Maximise the likelihood of labelled words by gradients with a rate for each weight."""
        rng = random.Random(seed)
        rows = [r for r in rows if r[0]]
        for _ in range(rounds):
            rng.shuffle(rows)
            for start in range(0, len(rows), 64):
                batch = rows[start : start + 64]
                flat = [w for words, _ in batch for w in words]
                words = list(dict.fromkeys(flat))
                place = {w: i for i, w in enumerate(words)}
                of = np.fromiter(map(place.__getitem__, flat), np.int64, len(flat))
                at, starts = self._features(words)
                got, expected = self.marginals(np.add.reduceat(self.w[at], starts, axis=0)[of], np.array([len(w) for w, _ in batch]), True)
                grad = np.eye(L)[np.concatenate([y for _, y in batch])] - got
                by_word = np.stack([np.bincount(of, weights=grad[:, k], minlength=len(words)) for k in range(L)], 1)
                own = np.repeat(np.arange(len(words)), np.diff([*starts, len(at)]))
                keys, inverse = np.unique(at, return_inverse=True)
                total = np.stack([np.bincount(inverse, weights=by_word[own, k], minlength=len(keys)) for k in range(L)], 1)
                total -= 2e-3 * self.w[keys]
                self.gw[keys] += total * total
                self.w[keys] += rate * total / np.sqrt(self.gw[keys])
                seen = np.zeros((L, L))
                for _, y in batch:
                    np.add.at(seen, (y[:-1], y[1:]), 1)
                step = seen - expected - 1e-2 * self.t
                self.gt += step * step
                self.t += rate * step / np.sqrt(self.gt)
        self.known, self.rows = {}, np.zeros((0, L))

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Chances of the words of many texts; texts of like length are computed together."""
        out: list[np.ndarray] = [np.zeros((0, L))] * len(texts)
        order = sorted((i for i in range(len(texts)) if texts[i]), key=lambda i: len(texts[i]))
        start = 0
        while start < len(order):
            end = start
            while end < len(order) and len(texts[order[end]]) * (end - start + 1) <= 20000:
                end += 1
            end = max(end, start + 1)
            part = order[start:end]
            lengths = np.array([len(texts[i]) for i in part])
            got, _ = self.marginals(self.emissions([w for i in part for w in texts[i]]), lengths)
            for i, g in zip(part, np.split(got, np.cumsum(lengths)[:-1])):
                out[i] = g
            start = end
        return out


def runs_of(chances: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Runs of words of one language: language, first word, number of words, mean chance."""
    if not len(chances):
        return []
    best = chances.argmax(1)
    cuts = [0, *(np.nonzero(np.diff(best))[0] + 1).tolist(), len(best)]
    return [(int(best[a]), a, b - a, float(chances[a:b, best[a]].mean())) for a, b in zip(cuts, cuts[1:])]


def _mixed(rows: list[tuple[list[str], int]], rng: random.Random, count: int) -> list[tuple[list[str], np.ndarray]]:
    """Texts that change language, from runs of texts of one: what teaches the transitions."""
    out = []
    for _ in range(count if rows else 0):
        words, tags = [], []
        for _ in range(rng.randint(2, 3)):
            text, lang = rng.choice(rows)
            a = rng.randrange(len(text))
            run = text[a : a + rng.randint(3, 12)]
            words += run
            tags += [lang] * len(run)
        out.append((words, np.array(tags)))
    return out


def train(labelled: list[tuple[str, str | None]], seed: int = 3) -> Crf:
    """A model from the seed sentences and word lists, then from texts with claimed languages.

    Claims may be wrong: a sentence counts for the language that the model so far gives it, with a
    bonus of one half for the claimed one; other languages only where the model is sure.
    """
    rng = random.Random(seed)
    seeds = [(words_of(s), i) for i, lang in enumerate(LANGUAGES) for s in SEEDS[lang].split("|")]
    for i, lang in enumerate(LANGUAGES):
        own = [w for w in LEXICON[lang].split() if len(_LEXICON[w]) == 1]
        seeds += [(own[k : k + 6], i) for k in range(0, len(own), 6)]
    whole = lambda rows: [(w, np.full(len(w), i)) for w, i in rows]
    model = Crf()
    model.fit(whole(seeds) + _mixed(seeds, rng, 150), rounds=8)
    sentences = [(words_of(s), claimed) for text, claimed in labelled for s in SENTENCE.split(text)]
    sentences = [(chunks_of(w), c) for w, c in sentences if len(w) >= 3]
    for _ in range(2 if sentences else 0):
        rows = []
        for (w, claimed), g in zip(sentences, model.tag([w for w, _ in sentences])):
            share = g.mean(0)
            own = LANGUAGES.index(claimed) if claimed in LANGUAGES else -1
            best = own if own >= 0 and share[own] + 0.5 >= share.max() else int(share.argmax())
            if len({x for x, _, n, p in runs_of(g) if n >= RUN and p >= SURE}) > 1:
                rows.append((w, best, g.argmax(1)))  # of several languages: each word for its own
            elif share[best] > (0.1 if best == own else 0.9):
                rows.append((w, best, np.full(len(w), best)))
        # At most PER_LANGUAGE of each, so that rare languages are learned as well.
        rng.shuffle(rows)
        count: Counter[int] = Counter()
        kept = []
        for w, i, tags in rows:
            count[i] += 1
            if count[i] <= PER_LANGUAGE:
                kept.append((w, i, tags))
        one = [(w, i) for w, i, tags in kept if (tags == i).all()]
        model.fit([(w, tags) for w, _, tags in kept] + whole(seeds) + _mixed(one, rng, 600), rounds=2)
    return model


def judge(model: Crf, texts: list[list[str]]) -> list[tuple[int, float, int, int, np.ndarray, np.ndarray]]:
    """Language, confidence and number of words of each text, how many were labelled, the mean chances and those of each word."""
    tagged = model.tag([chunks_of(words) for words in texts])
    some = [g for g in tagged if len(g)]
    sizes = np.array([len(g) for g in some])
    mean = np.add.reduceat(np.concatenate(some), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None] if some else np.zeros((0, L))
    best, sure = (mean.argmax(1).tolist(), mean.max(1).tolist()) if some else ([], [])
    out, at = [], 0
    for words, g in zip(texts, tagged):
        if len(g):
            out.append((best[at], sure[at], len(words), len(g), mean[at], g))
            at += 1
        else:
            out.append((-1, 0.0, 0, 0, NONE, g))
    return out


NONE = np.zeros(L)
SCHEMA = (
    "transcription_id bigint, segment_no int, lang string, confidence double, words int, kind string, "
    "spans array<struct<lang string, first_word int, words int, confidence double>>, claimed string"
)


def languages(transcriptions: DataFrame) -> DataFrame:
    """The language of each transcription, of each segment of it that is in another, and of the runs of mixed segments.

    Columns: transcription_id, segment_no (-1 for the whole), lang, confidence (the mean chance of the
    language over the words), words, kind (``whole``, ``foreign`` or ``mixed``), spans (the runs of words of
    one language in a segment, with first word, number of words and mean chance), claimed (the stored label as a code, null if missing). The language
    of the whole is that of most segments, by words where as many segments are in two; without segments
    the sentences of the full text stand for them. Defined cases: texts without words (null, blank,
    music, encoded bytes) give no row; a segment counts as in another language if the model is surer of it than of the
    main language, with one or two words by ``SURE``; it is mixed if it is in the main language but has a run in
    another with a mean chance of ``SURE``; runs without spaces are judged in chunks over their
    whole length; an empty table gives none. The model is learned from
    at most ``SAMPLE`` transcriptions of ``SAMPLE_CHARS`` characters in all, chosen by a hash of the id, and the seeds; all rows are judged
    over their whole texts.
    """
    spark = transcriptions.sparkSession
    claimed = language_code(F.col("lang_code"))
    text = F.coalesce("full_text", F.array_join(F.transform("segments", lambda s: s["seg_text"]), "\n"))
    sample = transcriptions.select(F.col("transcription_id").alias("i"), text.alias("t"), claimed.alias("c"), F.xxhash64("transcription_id").alias("order"))
    sample = sample.where("t is not null and i is not null").orderBy("order", "i").limit(SAMPLE)
    before = F.sum(F.length("t")).over(Window.orderBy("order", "i").rowsBetween(Window.unboundedPreceding, -1))  # of SAMPLE rows
    rows = sample.withColumn("before", before).where(F.coalesce("before", F.lit(0)) + F.length("t") <= SAMPLE_CHARS).collect()
    model = train(sorted((r.t, r.c) for r in rows if r.c is not None) + sorted((r.t, r.c) for r in rows if r.c is None))
    used = np.nonzero(np.abs(model.w).max(1) > 1e-3)[0]
    sent = spark.sparkContext.broadcast((used.astype(np.int32), model.w[used].astype(np.float16), model.t))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, w, t = sent.value
        crf = Crf()
        crf.w[at] = w
        crf.t = t
        spans = lambda runs: [(LANGUAGES[x], a, n, p) for x, a, n, p in runs]
        for pdf in batches:
            for start in range(0, len(pdf), 200):
                part = pdf.iloc[start : start + 200]
                texts, owner = [], []
                for k, (segs, full) in enumerate(zip(part["segs"], part["full_text"])):
                    if segs is not None and any(s and s.strip() for s in segs):
                        texts += [words_of(s) for s in segs]
                        owner += [(k, n) for n in range(len(segs))]
                    elif full:
                        pieces = [words_of(s) for s in SENTENCE.split(full)]
                        texts += pieces
                        owner += [(k, -2)] * len(pieces)
                found: dict[int, list] = {}
                for (k, n), got in zip(owner, judge(crf, texts)):
                    found.setdefault(k, []).append((n, *got))
                out = []
                for k, parts in found.items():
                    parts = [p for p in parts if p[3]]
                    if not parts:
                        continue
                    count = Counter(lang for _, lang, *_ in parts)
                    size: Counter[int] = Counter()
                    for _, lang, _, n_words, *_ in parts:
                        size[lang] += n_words
                    main = max(count, key=lambda x: (count[x], size[x], -x))
                    own = [p for p in parts if p[1] == main]
                    weight = sum(p[3] for p in own)
                    i, claim = part["transcription_id"].iloc[k], part["claimed"].iloc[k]
                    out.append((i, -1, LANGUAGES[main], sum(p[2] * p[3] for p in own) / weight, weight, "whole", None, claim))
                    for n, lang, sure, n_words, labelled, share, g in parts:
                        if n < 0:
                            continue
                        if lang != main and (labelled >= 3 or sure - share[main] >= SURE):
                            out.append((i, n, LANGUAGES[lang], sure, n_words, "foreign", spans(runs_of(g)), claim))
                        elif lang == main and g[:, main].min() < 0.5:
                            runs = runs_of(g)
                            if any(x != main and p >= SURE for x, _, _, p in runs):
                                out.append((i, n, LANGUAGES[lang], sure, n_words, "mixed", spans(runs), claim))
                yield pd.DataFrame(out, columns=["transcription_id", "segment_no", "lang", "confidence", "words", "kind", "spans", "claimed"])

    rows = transcriptions.select(
        "transcription_id", "full_text", F.transform("segments", lambda s: s["seg_text"]).alias("segs"), claimed.alias("claimed")
    )
    return rows.mapInPandas(work, SCHEMA)


def language_cases(found: DataFrame) -> DataFrame:
    """Of ``languages``: labels that are missing or wrong, and segments in another language."""
    wrong = (F.col("segment_no") >= 0) | F.col("claimed").isNull() | (F.col("claimed") != F.col("lang"))
    return found.where(wrong & (F.col("kind") != "mixed")).select("transcription_id", "segment_no", "lang")
