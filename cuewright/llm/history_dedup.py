"""Deduplication of new batches of media files against everything accepted before."""

from __future__ import annotations

import json
import math
import unicodedata
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuewright.functions.paths import clean_path, extension, stem
from cuewright.functions.speakers import let
from cuewright.operators.components import components
from cuewright.session import release, shared_dir, staged

#: Containers of films and episodes.
VIDEO = ("mp4", "mkv", "avi", "mov", "webm", "m4v", "wmv", "flv", "mpg", "mpeg", "ts")
EPISODE = r"(?:s([0-9]{1,2})[ ._-]?e([0-9]{1,3})|(?<![0-9])([0-9]{1,2})x([0-9]{2,3})(?![0-9])|season[ ._]*([0-9]+)[ ._-]*episode[ ._]*([0-9]+))"
YEAR = r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9px])"
DISC = r"(?<![a-z])(?:cd|disc|disk|dvd|part|pt)[ ._-]?([0-9]{1,2})(?![0-9])"
ROMAN = {"ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
ARTICLES = ("the", "a", "an")


def _plain_letters() -> tuple[str, str]:
    """Latin letters with marks and the plain letters they come from."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(c, base) for c, base in pairs if base.isascii() and base != c]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


MARKED, PLAIN = _plain_letters()


def content_key(content_hash: Column) -> Column:
    """The hash in lower case without a prefix of its kind; null for placeholders."""
    h = F.regexp_replace(F.lower(F.trim(F.regexp_replace(content_hash, r"\s+", " "))), r"^(?:sha-?[0-9]+|md5|blake2b?)[:=]\s*", "")
    return let(h, lambda x: F.when(x.rlike("^[0-9a-f]{16,128}$") & ~x.rlike(r"^(.)\1+$"), x))


def work_fields(files: DataFrame, path: str) -> DataFrame:
    """Adds what a file name tells of the film or episode: kind, n1, n2, number, words.

    Films: n1 is the year, n2 the disc (0 without one). Episodes: n1 the season, n2 the episode.
    ``number`` is the part of a series of films (1 if none is named), ``words`` the title without
    articles, marks and case. Files that are neither have a null ``kind``.
    """
    name = F.translate(stem(F.col(path)), MARKED, PLAIN)
    name = F.lower(F.regexp_replace(name, r"\p{M}", ""))
    name = F.regexp_replace(name, r"^\[[^\]]*\]\s*", "")
    df = files.withColumn("_name", name)
    episode = [F.regexp_extract("_name", EPISODE, i) for i in range(1, 7)]
    season = F.concat(episode[0], episode[2], episode[4])
    number = F.concat(episode[1], episode[3], episode[5])
    df = df.withColumns(
        {
            "_season": season.try_cast("int"),
            "_episode": number.try_cast("int"),
            "_year": F.regexp_extract("_name", rf"^.*{YEAR}", 1).try_cast("int"),
            "_after": F.regexp_extract("_name", rf"^.*{YEAR}(.*)$", 2),
        }
    )
    film_title = F.regexp_extract("_name", rf"^(.*){YEAR}", 1)
    show_title = F.regexp_extract("_name", rf"^(.*?){EPISODE}", 1)
    folder = F.lower(F.regexp_replace(F.translate(F.regexp_extract(F.col(path), r"([^/\\]+)[/\\](?:[Ss]eason[ ._]*[0-9]+[/\\])?[^/\\]*$", 1), MARKED, PLAIN), r"\p{M}", ""))
    show_title = let(show_title, lambda x: F.when(x.rlike("[a-z0-9]"), x).otherwise(folder))
    video = extension(F.col(path)).isin(*VIDEO)
    kind = F.when(video & F.col("_episode").isNotNull(), "episode").when(video & F.col("_year").isNotNull(), "film")
    df = df.withColumn("_kind", kind)
    title = F.when(F.col("_kind") == "episode", show_title).when(F.col("_kind") == "film", film_title)
    df = df.withColumn("_words", F.filter(F.split(F.regexp_replace(title, r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != ""))
    first = F.try_element_at("_words", F.lit(1)).isin(*ARTICLES)
    df = df.withColumn("_words", F.when(first & (F.size("_words") > 1), F.slice("_words", 2, 1000)).otherwise(F.col("_words")))
    last = F.try_element_at("_words", F.lit(-1)).isin(*ARTICLES)
    df = df.withColumn("_words", F.when(last & (F.size("_words") > 1), F.slice("_words", F.lit(1), F.size("_words") - 1)).otherwise(F.col("_words")))
    roman = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    tail = F.try_element_at("_words", F.lit(-1))
    part = F.coalesce(F.try_element_at(roman, tail), F.when(tail.rlike("^[1-9]$"), tail))
    df = df.withColumn("_part", F.when((F.col("_kind") == "film") & (F.size("_words") > 1), part))
    words = F.when(F.col("_part").isNotNull(), F.slice("_words", F.lit(1), F.size("_words") - 1)).otherwise(F.col("_words"))
    personal = F.try_element_at("_words", F.lit(1)).isin("img", "vid", "dsc", "pxl", "mvi")
    ok = F.col("_kind").isNotNull() & (F.size("_words") > 0) & ~F.coalesce(personal, F.lit(False))
    episode_kind = F.col("_kind") == "episode"
    df = df.withColumns(
        {
            "kind": F.when(ok, F.col("_kind")),
            "n1": F.when(ok, F.when(episode_kind, F.col("_season")).otherwise(F.col("_year"))),
            "n2": F.when(ok, F.when(episode_kind, F.col("_episode")).otherwise(F.coalesce(F.regexp_extract("_after", DISC, 1).try_cast("int"), F.lit(0)))),
            "number": F.when(ok, F.coalesce(F.col("_part").cast("int"), F.lit(1))),
            "words": F.when(ok, words),
        }
    )
    return df.drop("_name", "_season", "_episode", "_year", "_after", "_kind", "_words", "_part")


@dataclass
class Weights:
    """Weights of the agreement patterns of two titles, learned by expectation maximisation.

    Each field has the chance of its values in pairs that match (m) and that do not (u). The chances
    below are where learning starts, and what holds where there are fewer than ``least`` pairs.
    """

    share: float = 0.3
    m: list[list[float]] = field(default_factory=lambda: [[0.95, 0.04, 0.009, 0.001], [0.9, 0.09, 0.01], [0.9, 0.1]])
    u: list[list[float]] = field(default_factory=lambda: [[0.005, 0.02, 0.075, 0.9], [0.1, 0.3, 0.6], [0.15, 0.85]])
    least: int = 20

    def learn(self, patterns: list[tuple[int, int, int, int]], rounds: int = 25) -> Weights:
        """Fit to counts of patterns; these are at most 24, whatever the number of pairs."""
        total = sum(p[-1] for p in patterns)
        if total < self.least:
            return self
        share, m, u = self.share, self.m, self.u
        for _ in range(rounds):
            post = []
            for *values, _ in patterns:
                a, b = share, 1 - share
                for i, v in enumerate(values):
                    a, b = a * m[i][v], b * u[i][v]
                post.append(a / (a + b))
            good = sum(p * row[-1] for p, row in zip(post, patterns))
            share = min(max(good / total, 0.01), 0.99)
            fit = lambda base, i, v, own: (
                sum((p if own else 1 - p) * r[-1] for p, r in zip(post, patterns) if r[i] == v) + 2 * base[i][v]
            ) / ((good if own else total - good) + 2)
            m = [[fit(self.m, i, v, True) for v in range(len(x))] for i, x in enumerate(self.m)]
            u = [[fit(self.u, i, v, False) for v in range(len(x))] for i, x in enumerate(self.u)]
        return Weights(share, m, u, self.least)

    def score(self, fields: list[Column]) -> Column:
        total = F.lit(math.log(self.share / (1 - self.share)))
        for i, column in enumerate(fields):
            steps = F.array(*[F.lit(math.log(a / b)) for a, b in zip(self.m[i], self.u[i])])
            total = total + F.element_at(steps, column + 1)
        return total


def _compare(pairs: DataFrame) -> DataFrame:
    """Adds the fields compared of titles t and o_t: edits (letters that changed places count once), words that differ, and whether all initials agree.

    Titles of more than eight edits are far apart in all fields.
    """
    words = lambda c: F.split(F.col(c), " ")
    letters = lambda c: F.array_sort(F.split(F.replace(F.col(c), F.lit(" "), F.lit("")), ""))
    initials = lambda c: F.transform(words(c), lambda w: F.substring(w, 1, 1))
    pairs = pairs.withColumn("edits", F.levenshtein("t", "o_t", 8))
    near = F.col("edits") >= 0
    swapped = F.when(F.col("edits").between(2, 8), letters("t") == letters("o_t")).otherwise(False)
    pairs = pairs.withColumn("edits", F.when(~near, 9).when(swapped, F.ceil(F.col("edits") / 2).cast("int")).otherwise(F.col("edits")))
    near = F.col("edits") < 9
    differ = F.greatest(F.size(F.array_except(words("t"), words("o_t"))), F.size(F.array_except(words("o_t"), words("t"))))
    return pairs.withColumns(
        {
            "f0": F.when(F.col("edits") <= 2, 0).when(F.col("edits") <= 4, 1).when(near, 2).otherwise(3),
            "f1": F.when(near, F.greatest(F.least(differ, F.lit(3)) - 1, F.lit(0))).otherwise(2),
            "f2": F.when(near, F.when(initials("t") == initials("o_t"), 0).otherwise(1)).otherwise(1),
        }
    )


def _block_keys() -> Column:
    """Keys under which two spellings of a title meet if few slips part them, as hashes with kind, year and so on.

    Titles of four words and more meet by two words at most three apart, of which two slips leave some; those
    of three also by single words, those of two by each word less one letter, those of one by the word
    less one or two letters. All meet as well by their letters without spaces.
    """
    meta = ("kind", "n1", "n2", "number")
    n = F.size("words")
    key = lambda tag, *parts: F.xxhash64(*meta, F.lit(tag), *parts)
    less = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    near = lambda w: F.array_union(F.array(w), F.filter(less(w), lambda x: x != ""))
    twos = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda i: F.transform(F.filter(F.sequence(i, F.least(i + 3, n)), lambda j: j > i), lambda j: key("two", F.element_at("words", i), F.element_at("words", j))),
        )
    )
    single = F.transform("words", lambda w: key("one", w))
    each = F.transform(F.flatten(F.transform("words", near)), lambda x: key("less", x))
    alone = F.transform(F.array_distinct(F.flatten(F.transform(near(F.element_at("words", 1)), near))), lambda x: key("least", x))
    whole = F.array(key("whole", F.array_join("words", "")))
    return F.array_distinct(F.concat(whole, F.when(n == 1, alone).when(n == 2, each).when(n == 3, F.concat(twos, single)).otherwise(twos)))


class AcceptedHistory:
    """What has been accepted so far, kept as tables in a folder and found again by whoever opens it.

    ``keys``: a row for each content hash, path and work, with the item it belongs to; ``titles``: blocking
    keys of each spelling of a work; both are cut into ``buckets`` by a hash of the key, a generation for
    each batch. ``links``: items that a later file showed to be part of an earlier item, and that item:
    the representatives of union-find. A manifest, written last, names the tables that count, with the
    learned weights, so a batch that did not end leaves nothing behind.

    A batch reads the buckets its keys fall into, never the accepted files, and moves only its own rows: up
    to ``SENT`` keys they are sent to the tasks that read the buckets; beyond, both sides are shuffled. It
    changes only the items it touches. After ``GENERATIONS`` batches the generations are made one.
    """

    KEYS = "k1 bigint, k2 bigint, item bigint, p int"
    TITLES = "b bigint, k1 bigint, k2 bigint, t string, size int, digits bigint, item bigint, p int"
    LINKS = "node bigint, root bigint"
    SENT = 50_000  #: keys (some 100 bytes) of a batch that are sent to all tasks at most
    GENERATIONS = 16
    LEARNED_FROM = 1000  #: pairs after which the weights stay

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.folder = (folder or f"{shared_dir(spark)}/history-{uuid.uuid4().hex}").rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._manifest() or {"batches": 0, "buckets": buckets, "keys": [], "titles": [], "links": None, "weights": None, "seen": []}

    @property
    def batches(self) -> int:
        return self.state["batches"]

    @property
    def weights(self) -> Weights:
        known = self.state["weights"]
        return Weights(*known) if known else Weights()

    def _manifest(self) -> dict | None:
        where = self._path(f"{self.folder}/manifest")
        if not self._fs.exists(where):
            return None
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(where) if f.getPath().getName().endswith(".json"))
        if not names:
            return None
        rows = self.spark.read.option("wholetext", "true").text(f"{self.folder}/manifest/{names[-1]}").collect()
        return json.loads(rows[0].value)

    def _commit(self, state: dict) -> None:
        """Write the manifest beside the old ones and make it count by one rename."""
        state = dict(state, serial=self.state.get("serial", 0) + 1)
        name = f"{self.folder}/manifest/{state['serial']:08d}"
        out = self._fs.create(self._path(f"{name}.tmp"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self._fs.rename(self._path(f"{name}.tmp"), self._path(f"{name}.json")):
            raise RuntimeError(f"{name} exists: another batch was accepted meanwhile")
        self.state = state

    def _read(self, name: str, schema: str, touched: list[int] | None = None) -> DataFrame:
        where = self.state[name]
        if not where:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema)
        if isinstance(where, str):
            return read.parquet(where)
        rows = read.option("basePath", f"{self.folder}/{name}").parquet(*where).drop("g")
        return rows if touched is None or len(touched) == self.state["buckets"] else rows.where(F.col("p").isin(touched))

    def _write(self, df: DataFrame, name: str) -> list[str]:
        path = f"{self.folder}/{name}/g={self.batches:08d}-{uuid.uuid4().hex[:8]}"
        bucket = F.pmod(F.xxhash64("b" if name == "titles" else "k1", F.lit(7)), F.lit(self.state["buckets"])).cast("int")
        df.withColumn("p", bucket).repartition("p").write.partitionBy("p").parquet(path)
        return [path] if self._fs.exists(self._path(path)) else []  # nothing is written of an empty table

    def _buckets_of(self, df: DataFrame, key: str) -> tuple[int, list[int]]:
        """How many rows there are and which buckets they fall into, of which there is a fixed number."""
        if not self.state["buckets"]:
            self.state["buckets"] = max(8, min(4096, df.count() // 100_000))  # as large as the first batch asks for
        got = df.agg(F.count("*").alias("n"), F.collect_set(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(self.state["buckets"])).cast("int")).alias("p")).first()
        return got.n, sorted(got.p)

    def accept(self, batch: DataFrame) -> DataFrame:
        """Accept files (file_id, content_hash, path); gives file_id and the item each belongs to."""
        held: list[DataFrame] = []

        def hold(df: DataFrame, name: str) -> DataFrame:
            held.append(staged(df, name))
            return held[-1]

        rows = batch.where("file_id is not null").select(
            F.col("file_id").cast("bigint").alias("file_id"), content_key(F.col("content_hash")).alias("h"), clean_path(F.col("path")).alias("p")
        )
        work = F.concat_ws("|", "kind", "n1", "n2", "number", F.concat_ws(" ", "words"))
        rows = work_fields(rows, "p").withColumn("w", F.when(F.col("kind").isNotNull(), work))
        pair = lambda kind, c: F.when(c.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), c).alias("k1"), F.xxhash64(c, F.lit(kind)).alias("k2")))
        rows = hold(
            rows.select(
                "file_id", "kind", "n1", "n2", "number", "words",
                F.filter(F.array(pair("h", F.col("h")), pair("p", F.col("p")), pair("w", F.col("w"))), lambda x: x.isNotNull()).alias("ks"),
            ),
            "files",
        )
        keyed = rows.select("file_id", "kind", "n1", "n2", "number", "words", F.explode("ks").alias("k")).select("*", "k.k1", "k.k2", F.col("k.kind").alias("key_kind")).drop("k")
        count, touched = self._buckets_of(keyed, "k1")
        first = keyed.groupBy("k1", "k2").agg(F.min("file_id").alias("id"), F.min_by(F.when(F.col("key_kind") == "w", F.struct("kind", "n1", "n2", "number", "words")), "file_id").alias("work"))
        old = self._read("keys", self.KEYS, touched)
        asked = keyed.select("k1", "k2").distinct()
        hits = old.join(F.broadcast(asked) if count <= self.SENT else asked, ["k1", "k2"]).select("k1", "k2", "item")
        links = self._read("links", self.LINKS).select(F.col("node").alias("item"), "root")
        hits = hits.join(links, "item", "left").groupBy("k1", "k2").agg(F.min(F.coalesce("root", "item")).alias("item"))
        probed = hold(first.join(hits, ["k1", "k2"], "left"), "probed")

        edges = keyed.select("file_id", "k1", "k2").join(probed.select("k1", "k2", F.coalesce("item", "id").alias("to")), ["k1", "k2"])
        edges = edges.select(F.col("file_id").alias("a"), F.col("to").alias("b"))

        # New spellings of titles are compared with all spellings in the same block.
        fresh = probed.where("item is null and work is not null").select("k1", "k2", "id", "work.*")
        title, digits = F.array_join("words", " "), F.xxhash64(F.filter("words", lambda w: w.rlike("[0-9]")))
        fresh = fresh.select("k1", "k2", F.col("id").alias("item"), title.alias("t"), F.length(title).alias("size"), digits.alias("digits"), F.explode(_block_keys()).alias("b"))
        fresh = hold(fresh, "titles")
        count, touched = self._buckets_of(fresh, "b")
        other = lambda df: df.select("b", "digits", *[F.col(c).alias(f"o_{c}") for c in ("k1", "k2", "t", "size", "item")])
        close = F.abs(F.col("size") - F.col("o_size")) <= 8
        apart = (F.col("k1") < F.col("o_k1")) | ((F.col("k1") == F.col("o_k1")) & (F.col("k2") < F.col("o_k2")))  # each pair once
        wanted = F.broadcast(fresh) if count <= self.SENT else fresh
        pairs = other(self._read("titles", self.TITLES, touched)).join(wanted, ["b", "digits"]).where(close & ((F.col("k1") != F.col("o_k1")) | (F.col("k2") != F.col("o_k2"))))
        pairs = pairs.unionByName(other(fresh).join(wanted, ["b", "digits"]).where(close & apart))
        # Only hashes and what was compared are moved, not the titles.
        found = _compare(pairs).select("k1", "k2", "o_k1", "o_k2", "item", "o_item", "edits", "f0", "f1", "f2", "size")
        pairs = hold(found.dropDuplicates(["k1", "k2", "o_k1", "o_k2"]), "pairs")
        seen = {tuple(x[:3]): x[3] for x in self.state["seen"]}
        if sum(seen.values()) < self.LEARNED_FROM:
            for r in pairs.groupBy("f0", "f1", "f2").count().collect():  # at most 24 rows
                seen[r.f0, r.f1, r.f2] = seen.get((r.f0, r.f1, r.f2), 0) + r["count"]
            learned = Weights().learn([(*k, n) for k, n in sorted(seen.items())])
            self.state["weights"] = [learned.share, learned.m, learned.u]
        same = pairs.where((self.weights.score([F.col("f0"), F.col("f1"), F.col("f2")]) > 0) & (F.col("edits") * 4 <= F.col("size")))
        same = same.select(F.col("item").alias("a"), F.col("o_item").alias("item")).join(links, "item", "left")
        edges = edges.unionByName(same.select("a", F.coalesce("root", "item").alias("b")))

        # Union-find over the items touched: files of the batch, and items of old by their representatives.
        found = hold(components(edges), "found")
        items = rows.select("file_id").join(found.select(F.col("node").alias("file_id"), "root"), "file_id", "left")
        items = staged(items.select("file_id", F.coalesce("root", "file_id").alias("item")), "items")
        merged = found.where("node <> root").join(rows.select(F.col("file_id").alias("node")), "node", "left_anti").select("node", "root")
        merged = hold(merged, "merged")

        state = dict(self.state, batches=self.batches + 1, seen=[[*k, n] for k, n in sorted(seen.items())])
        if not merged.isEmpty():
            before = self._read("links", self.LINKS).join(merged.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
            state["links"] = f"{self.folder}/links/g{self.batches:08d}-{uuid.uuid4().hex[:8]}"
            before.select("node", F.coalesce("to", "root").alias("root")).unionByName(merged).write.parquet(state["links"])
        own = items.select(F.col("file_id").alias("id"), F.col("item").alias("to"))
        state["keys"] = [*self.state["keys"], *self._write(probed.where("item is null").select("k1", "k2", "id").join(own, "id").select("k1", "k2", F.col("to").alias("item")), "keys")]
        titles = fresh.join(own.withColumnRenamed("id", "item"), "item").select("b", "k1", "k2", "t", "size", "digits", F.col("to").alias("item"))
        state["titles"] = [*self.state["titles"], *self._write(titles, "titles")]
        self._commit(state)
        release(*held)
        if len(state["keys"]) >= self.GENERATIONS:
            self.compact()
        return items

    def compact(self) -> None:
        """Make the generations one, with each item under its representative, after which no links are needed."""
        links = self._read("links", self.LINKS).select(F.col("node").alias("item"), "root")
        old = dict(self.state)
        state = dict(old, links=None)
        for name, schema in (("keys", self.KEYS), ("titles", self.TITLES)):
            rows = self._read(name, schema).join(links, "item", "left").withColumn("item", F.coalesce("root", "item")).drop("root", "p")
            state[name] = self._write(rows, name)
        # Items that were handed out are still resolved by the links, which stay a table of their own.
        state["links"] = old["links"]
        self._commit(state)
        for path in (*old["keys"], *old["titles"]):
            self._fs.delete(self._path(path), True)

    def resolve(self, items: DataFrame) -> DataFrame:
        """``items`` as returned by ``accept`` with the items as of now."""
        links = self._read("links", self.LINKS).select(F.col("node").alias("item"), "root")
        return items.join(links, "item", "left").select("file_id", F.coalesce("root", "item").alias("item"))


def find_repeats(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Accept files batch by batch; gives each file that repeats an item with the item's first file.

    Files are the same item if they have the same content hash or path, or name the same film (title,
    year, part, disc) or episode (show, season, episode), small slips in the title included, directly
    or through other files. Columns: first_file_id, file_id. Defined cases: null or placeholder hashes,
    null or blank paths and null words are no keys; a null batch counts as the first; rows of one id
    are one file; an empty table gives an empty result. ``folder`` is where the history is kept.
    """
    spark = files.sparkSession
    rows = files.select("file_id", "content_hash", "path", "batch_no")
    batches = sorted({r[0] or 0 for r in rows.select("batch_no").distinct().collect()})
    history = AcceptedHistory(spark, folder)
    parts = [history.accept(rows.where((F.col("batch_no") == b) | F.col("batch_no").isNull() if b == 0 else F.col("batch_no") == b).drop("batch_no")) for b in batches]
    if not parts:
        return spark.createDataFrame([], T.StructType([T.StructField("first_file_id", T.LongType()), T.StructField("file_id", T.LongType())]))
    items = parts[0]
    for part in parts[1:]:
        items = items.unionByName(part)
    return history.resolve(items).where("item <> file_id").select(F.col("item").alias("first_file_id"), "file_id").distinct()
