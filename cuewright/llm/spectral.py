"""Clusters of mutually similar vectors by power-iteration spectral clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuewright.operators.components import components
from cuewright.session import release, shuffles_removed, staged

BLOCK = 2048  #: rows aimed at, at most, in a part of a bucket that is too large to be compared whole
WIDE = 8  #: blocks of rows up to which a bucket is compared whole
PASS = 2  #: codes of each row whose vectors are moved at once: those of one table, about as many bytes as the vectors given
PER_BUCKET = 1500  #: rows aimed at in a hash bucket
VECTORS = 10  #: of the power iteration
ROUNDS, BLOCKS = 12, 40  #: rounds of the iteration in one job, and jobs at most
DAMPED = 0.9  #: eigenvalues of the normalised affinities that a round damps by half
TOLERANCE, WIDTH = 1e-6, 0.01  #: how near linked hubs must come, and the cells where k-means starts
RIDGE = 1e-3  #: added to the products of the vectors, which have no rank where few parts are linked
PART_BYTES = 1 << 24  #: of vectors aimed at in a task that compares buckets
BROADCAST_ROWS = 100_000  #: hot buckets (20 bytes each) sent to all tasks; more are joined by a shuffle
SCALE = 0.35  #: distance over which affinity falls off
PART = 4096  #: members of a cluster whose vectors are added up at once
REPRESENTATIVES = 16  #: rows of a large piece that stand for it across the parts of a hot bucket


def rotations(dim: int, tables: int, extra: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Random rotations of cross-polytope hashing; ``extra`` columns of a second one refine each code."""
    rng = np.random.default_rng(seed)
    turn = lambda: np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
    return np.stack([turn() for _ in range(tables)]), np.stack([turn()[:, : max(extra, 1)] for _ in range(tables)])


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and these scaled to length one."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.nonzero(sizes == dim)[0]
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    flat = pc.list_flatten(column.take(pa.array(at)))
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)  # null becomes NaN
    with np.errstate(all="ignore"):
        norm = np.sqrt((v * v).sum(1))
        ok = np.isfinite(norm) & (norm > 0)
    at, v, norm = at[ok], v[ok], norm[ok]
    return at, (v / norm[:, None]).astype(np.float32)


def hashed(vectors: DataFrame, dim: int, tables: int, extra: int, probes: int = 2) -> DataFrame:
    """Unit vectors in half precision with their bucket codes: origin, id, v, codes.

    A row is put into the buckets of its ``probes`` largest rotated coordinates in each table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = rotations(dim, tables, extra)
        for batch in batches:
            at, v = _unit(batch.column("v"), dim)
            n = len(at)
            codes = np.zeros((n, tables * probes), np.int64)
            for t in range(tables if n else 0):
                y = v @ first[t]
                a = np.abs(y)
                top = np.argpartition(-a, probes, axis=1)[:, :probes]
                code = top * 2 + (np.take_along_axis(y, top, 1) > 0)
                if extra:
                    z = v @ second[t]
                    j = np.abs(z).argmax(1)
                    code = code * (2 * extra) + (j * 2 + (z[np.arange(n), j] > 0))[:, None]
                codes[:, t * probes : (t + 1) * probes] = code * tables + t
            halves = v.astype(np.float16)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("origin").take(take),
                    batch.column("id").take(take),
                    pa.array([x.tobytes() for x in halves], type=pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (tables * probes)), pa.array(codes.ravel())),
                ],
                names=["origin", "id", "v", "codes"],
            )

    return vectors.select("origin", "id", "v").mapInArrow(work, "origin string, id bigint, v binary, codes array<bigint>")


def _links(v: np.ndarray, ids: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Links that connect what direct links connect, far fewer than all pairs: rows a and b, their cosine,
    the number of neighbours of each; and each row's piece.

    Every row is linked to its neighbour of most neighbours; rows that have none such are roots. Of
    the direct links between the trees of two roots one is kept.
    """
    n = len(ids)
    chunks = [(i, min(i + 1024, n)) for i in range(0, n, 1024)]
    degree = np.concatenate([(v[a:b] @ v.T > least).sum(1) for a, b in chunks])
    order = np.lexsort((ids, -degree))
    v, ids, degree = v[order], ids[order], degree[order]
    parent = np.arange(n)
    busy = np.nonzero(degree > 1)[0]  # all others stand alone
    m = int(busy[-1]) + 1 if len(busy) else 0
    v = v[:m]
    weight = np.ones(n, np.float32)
    for a in range(0, m, 1024):
        s = v[a : a + 1024] @ v.T
        parent[a : a + len(s)] = np.minimum((s > least).argmax(1), np.arange(a, a + len(s)))
        weight[a : a + len(s)] = s[np.arange(len(s)), parent[a : a + len(s)]]
    root = parent.copy()
    while (nxt := root[root]).tolist() != root.tolist():
        root = nxt
    child = np.nonzero(parent[:m] != np.arange(m))[0]
    out_a, out_b, out_w = [child], [parent[child]], [weight[child]]
    if len(np.unique(root[:m])) > 1:
        seen: set[int] = set()
        for a in range(0, m, 1024):
            s = v[a : a + 1024] @ v.T
            i, j = np.nonzero((s > least) & (root[a : a + len(s), None] != root[None, :m]))
            key = np.minimum(root[a + i], root[j]) * n + np.maximum(root[a + i], root[j])
            key, first = np.unique(key, return_index=True)
            new = np.array([k not in seen for k in key.tolist()], bool)
            seen.update(key.tolist())
            first = first[new]
            out_a.append(a + i[first])
            out_b.append(j[first])
            out_w.append(s[i[first], j[first]])
    a, b, w = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_w)
    piece = root.copy()
    for x, y in zip(root[a], root[b]):  # roots joined by the links between trees
        x, y = _find(piece, x), _find(piece, y)
        if x != y:
            piece[max(x, y)] = min(x, y)
    pieces = np.array([_find(piece, r) for r in root]) if n else piece
    back = np.empty(n, int)
    back[order] = np.arange(n)
    return order[a], order[b], w, degree[a], degree[b], order[pieces[back]]


def _find(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        x = parent[x]
    return x


def _runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of rows with equal keys, and where in them the runs start."""

    def cut(t: pa.Table) -> list[int]:
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            column = t.column(k).combine_chunks()
            column = column.dictionary_encode().indices if pa.types.is_string(column.type) else column
            k = column.to_numpy(zero_copy_only=False)
            new |= k[1:] != k[:-1]
        return (np.nonzero(new)[0] + 1).tolist()

    held: list[pa.Table] = []
    for batch in batches:
        t = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
        cuts = cut(t)
        if cuts:
            yield t.slice(0, cuts[-1]), [0, *cuts[:-1]]
        held = [t.slice(cuts[-1] if cuts else 0)]
    if held and held[0].num_rows:
        yield held[0].combine_chunks(), [0]


BUCKETED = "origin string, code bigint, salt int, hot boolean, id bigint, v binary"
LINKED = "origin string, code bigint, a bigint, b bigint, s float, da int, db int, v binary"


def _compare(radius: float):
    """Compares the rows of each bucket; a hot bucket's parts also give the rows that stand for them."""
    least = 1 - radius * radius / 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket(t: pa.Table) -> pa.RecordBatch | None:
            ids = t.column("id").to_numpy()
            v = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float16).reshape(len(ids), -1).astype(np.float32)
            a, b, s, da, db, piece = _links(v, ids, least)
            origin, code = t.column("origin")[0].as_py(), t.column("code")[0].as_py()
            rows_a, rows_b, sims, vs = ids[a], ids[b], s, [None] * len(a)
            if t.column("hot")[0].as_py():
                keep = []
                by = np.argsort(piece, kind="stable")
                for group in np.split(by, np.nonzero(np.diff(piece[by]))[0] + 1):
                    if len(group) > REPRESENTATIVES:  # the root and rows from all over the piece
                        far = group[np.argsort(v[group] @ v[piece[group[0]]])]
                        group = np.unique(np.r_[piece[group[0]], far[np.linspace(0, len(far) - 1, REPRESENTATIVES - 1).astype(int)]])
                    keep.append(group)
                keep = np.concatenate(keep)
                rows_a, rows_b = np.r_[rows_a, ids[keep]], np.r_[rows_b, ids[keep]]
                sims = np.r_[sims, np.ones(len(keep), np.float32)]
                da, db = np.r_[da, np.zeros(len(keep), int)], np.r_[db, np.zeros(len(keep), int)]
                vs += [t.column("v")[int(i)].as_py() for i in keep]
            if not len(rows_a):
                return None
            n = len(rows_a)
            return pa.RecordBatch.from_arrays(
                [pa.array([origin] * n), pa.array(np.full(n, code)), pa.array(rows_a), pa.array(rows_b), pa.array(sims.astype(np.float32)), pa.array(da.astype(np.int32)), pa.array(db.astype(np.int32)), pa.array(vs, pa.binary())],
                names=["origin", "code", "a", "b", "s", "da", "db", "v"],
            )

        for t, starts in _runs(batches, "code", "salt", "origin"):
            for x, y in zip(starts, [*starts[1:], t.num_rows]):
                if y - x > 1 or t.column("hot")[x].as_py():
                    if (out := bucket(t.slice(x, y - x))) is not None:
                        yield out

    return work


def bucket_table(vectors: DataFrame, dim: int = 128) -> tuple[DataFrame, DataFrame]:
    """The hashed rows of vectors (origin, id, v), and the buckets above ``WIDE`` blocks of rows with their parts: o, c, parts."""
    total = vectors.count()
    bits = max(0, math.ceil(math.log2(max(total, 1) / (256 * PER_BUCKET))))
    extra = min(2 ** max(bits - 1, 0), dim) if bits else 0
    tables = 3 * (1 + math.ceil(bits / 3))
    rows = staged(hashed(vectors.where("id is not null"), dim, tables, extra), "hashed")
    exploded = rows.select("origin", "id", F.explode("codes").alias("code"))
    sizes = exploded.groupBy("origin", "code").count().where(F.col("count") > WIDE * BLOCK)
    # As many parts as keep each below the block size; this table has a row for each hot bucket only.
    sizes = sizes.select(F.col("origin").alias("o"), F.col("code").alias("c"), F.ceil(F.col("count") / (BLOCK * 3 // 4)).cast("int").alias("parts"))
    return rows, staged(sizes, "hot")


def moved(rows: DataFrame) -> tuple[int, int]:
    """The codes of a row, and the bytes that are moved for one code of each row."""
    size = rows.agg(F.max(F.size("codes")).alias("codes"), F.sum(F.length("v") + 40).alias("bytes")).first()
    return size.codes or 1, size.bytes or 0


def tasks_for(rows: DataFrame, size: int) -> int:
    """Tasks over so many bytes of bucketed rows: as many as keep each near ``PART_BYTES``, at least those of the session."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def affinities(rows: DataFrame, sizes: DataFrame, radius: float = 0.5) -> DataFrame:
    """A sparse affinity graph of hashed rows: origin, a, b, s with s the cosine, and
    the neighbours of a and of b in a bucket, da and db.

    Rows that share a bucket of cross-polytope hashing are compared. A link is kept only
    between rows nearer than ``radius``, and of these so many that whatever the direct links of a
    bucket connect stays connected. A bucket above ``WIDE`` blocks of rows, such as that of one person with a
    great share of all rows or of many copies, is split into parts at random; rows that stand for the
    pieces of each part are compared again across the parts. What these miss, ``missed_links`` finds.
    The more rows, the more codes each has: their vectors are moved in passes of ``PASS`` codes, so that what lies on
    disk at once follows the rows alone: beside the hashed rows and the links, each vector twice in half precision.
    """
    hot = sizes.count()
    sizes = F.broadcast(sizes) if hot <= BROADCAST_ROWS else sizes
    salt = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id", "code"), F.col("parts")).cast("int")).otherwise(0)
    codes, size = moved(rows)
    passes = []
    for low in range(0, codes, PASS):
        bucketed = rows.select("origin", "id", "v", F.explode(F.slice("codes", low + 1, PASS)).alias("code")).join(sizes, (F.col("origin") == F.col("o")) & (F.col("code") == F.col("c")), "left")
        bucketed = bucketed.select("origin", "code", salt.alias("salt"), F.col("parts").isNotNull().alias("hot"), "id", "v")
        spread = bucketed.repartition(tasks_for(rows, size * min(PASS, codes)), "origin", "code", "salt").sortWithinPartitions("origin", "code", "salt")
        passes.append(staged(spread.mapInArrow(_compare(radius), LINKED), "links"))
    found = reduce(DataFrame.unionByName, passes)
    links = found.where("v is null").unionByName(_again(found, tasks_for(rows, size * codes), radius)) if hot else found
    turn = F.col("a") < F.col("b")
    links = links.where("a <> b").select("origin", F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "s", F.when(turn, F.col("db")).otherwise(F.col("da")).alias("da"), F.when(turn, F.col("da")).otherwise(F.col("db")).alias("db"))
    links = links.groupBy("origin", "a", "b").agg(F.max("s").alias("s"), F.max("da").alias("da"), F.max("db").alias("db"))
    links = staged(links, "affinities")
    release(*passes)
    return links


def _again(found: DataFrame, n: int, radius: float) -> DataFrame:
    """Links between the rows kept of the parts of hot buckets."""
    again = found.where("v is not null").select("origin", "code", F.col("a").alias("id"), "v")
    # Rows kept of a bucket above the block size, as of many dissimilar rows, are split again.
    kept = again.groupBy(F.col("origin").alias("o"), F.col("code").alias("c")).agg(F.ceil(F.count("*") / (BLOCK * 3 // 4)).cast("int").alias("parts"))
    kept = F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
    again = again.join(kept, (F.col("origin") == F.col("o")) & (F.col("code") == F.col("c")))
    again = again.select("origin", "code", F.pmod(F.xxhash64("id", "code", F.lit(1)), F.col("parts")).cast("int").alias("salt"), F.lit(False).alias("hot"), "id", "v")
    again = again.repartition(n, "origin", "code", "salt").sortWithinPartitions("origin", "code", "salt")
    return again.mapInArrow(_compare(radius), LINKED)


MISSED = "origin string, a bigint, b bigint"


def _compare_sides(radius: float):
    """Compares the rows of each block that are outside their bucket's main cluster with all of another cluster."""
    least = 1 - radius * radius / 2

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches, "code", "i", "j", "origin"):
            for x, y in zip(starts, [*starts[1:], t.num_rows]):
                part = t.slice(x, y - x)
                v = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float16).reshape(y - x, -1).astype(np.float32)
                label, rest = part.column("label").to_numpy(), part.column("rest").to_numpy(zero_copy_only=False)
                v0, l0, v1, l1 = v[rest], label[rest], v[~rest], label[~rest]
                pairs = []
                for a in range(0, len(v0), 1024):
                    for b in range(0, len(v1), 2048):
                        near = (v0[a : a + 1024] @ v1[b : b + 2048].T > least) & (l0[a : a + 1024, None] != l1[None, b : b + 2048])
                        i, j = np.nonzero(near)
                        if len(i):
                            pairs.append(np.unique(np.sort(np.stack([l0[a + i], l1[b + j]], 1), 1), axis=0))
                if pairs:
                    pairs = np.unique(np.concatenate(pairs), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array([part.column("origin")[0].as_py()] * len(pairs)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["origin", "a", "b"])

    return work


def missed_links(rows: DataFrame, sizes: DataFrame, members: DataFrame, radius: float = 0.5) -> DataFrame:
    """Pairs of clusters (origin, a, b) that a link below ``radius`` within a hot bucket joins; a row in no cluster is its own.

    Rows of one cluster need no comparing. All rows of a bucket outside its largest cluster are compared
    with all rows of the bucket, in pairs of blocks: whatever the direct links of a bucket connect comes out.
    """
    wide = WIDE * BLOCK
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    key = (F.col("origin") == F.col("o")) & (F.col("code") == F.col("c"))
    hot = rows.select("origin", "id", F.explode("codes").alias("code")).join(sizes, key).select("origin", "code", "id")
    hot = hot.join(members.select("origin", "id", "cluster"), ["origin", "id"], "left").select("origin", "code", "id", F.coalesce("cluster", "id").alias("label"))
    hot = staged(hot.distinct(), "labels")
    shares = hot.groupBy("origin", "code", "label").count()
    main = shares.groupBy("origin", "code").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"))
    main = main.where("n > m.count").select("origin", "code", F.col("m.label").alias("main"), F.ceil(F.col("n") / wide).cast("int").alias("blocks"), F.ceil((F.col("n") - F.col("m.count")) / wide).cast("int").alias("rests"))
    main = staged(main, "main")
    # Of the vectors only those in such buckets are moved.
    there = main.select(F.col("origin").alias("o"), F.col("code").alias("c"), "main", "blocks", "rests")
    there = F.broadcast(there) if main.count() <= BROADCAST_ROWS else there
    v = rows.select("origin", "id", "v", F.explode("codes").alias("code")).join(there, (F.col("origin") == F.col("o")) & (F.col("code") == F.col("c"))).drop("o", "c")
    hot = v.join(hot, ["origin", "code", "id"])
    block = lambda c: F.pmod(F.xxhash64("id", "code"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = hot.where("label <> main").select("origin", "code", block("rests").alias("i"), every("blocks").alias("j"), F.lit(True).alias("rest"), "label", "v")
    whole = hot.select("origin", "code", every("rests").alias("i"), block("blocks").alias("j"), F.lit(False).alias("rest"), "label", "v")
    codes, size = moved(rows)
    spread = rest.unionByName(whole).repartition(tasks_for(rows, codes * size), "origin", "code", "i", "j").sortWithinPartitions("origin", "code", "i", "j")
    return spread.mapInArrow(_compare_sides(radius), MISSED).distinct()


def joined_clusters(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members (origin, id, cluster, size) once the clusters or single rows of ``pairs`` (origin, a, b) are one."""
    name = lambda c: F.xxhash64("origin", c)
    merged = components(pairs.select(name("a").alias("a"), name("b").alias("b")))
    ends = pairs.select("origin", F.col("a").alias("c")).union(pairs.select("origin", "b")).distinct()
    known = members.where("id = cluster").select("origin", F.col("cluster").alias("c"), "size").distinct()
    ends = ends.join(known, ["origin", "c"], "left").withColumn("node", name("c")).join(merged, "node")
    whole = ends.groupBy("root").agg(F.min("c").alias("whole"), F.sum(F.coalesce("size", F.lit(1))).alias("total"))
    ends = staged(ends.join(whole, "root").select("origin", "c", "whole", "total", F.col("size").isNull().alias("single")), "joined")
    moved = members.join(ends.where("not single").select("origin", F.col("c").alias("cluster"), "whole", "total"), ["origin", "cluster"], "left")
    moved = moved.select("origin", "id", F.coalesce("whole", "cluster").alias("cluster"), F.coalesce("total", "size").alias("size"))
    return moved.unionByName(ends.where("single").select("origin", F.col("c").alias("id"), F.col("whole").alias("cluster"), F.col("total").alias("size")))


def graph(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their hub, and the affinities between hubs.

    Affinities are exp(-d^2 / (2 SCALE^2)). The graph is coarsened once: each node joins its hub, the node
    of most neighbours that it is linked to as the one of fewer, or else is a hub itself. Gives the nodes
    (x, origin, id, hub) and the summed affinities (u, v, w) of different hubs, each pair once.
    """
    w = F.exp(-(1 - F.col("s").cast("double")) / (SCALE * SCALE))
    name = lambda c: F.xxhash64("origin", c)
    one = links.select("origin", F.col("a").alias("id"), F.col("b").alias("y"), F.col("da").alias("own"), F.col("db").alias("n"))
    two = links.select("origin", F.col("b").alias("id"), F.col("a").alias("y"), F.col("db").alias("own"), F.col("da").alias("n"))
    up = (F.col("n") > F.col("own")) | ((F.col("n") == F.col("own")) & (F.col("y") < F.col("id")))  # the smaller id of equals
    nodes = one.unionByName(two).groupBy("origin", "id").agg(F.min(F.when(up, F.struct((-F.col("n")).alias("n"), "y"))).alias("best"))
    nodes = nodes.withColumn("x", name("id")).withColumn("hub", F.when(F.col("best").isNull(), F.col("x")).otherwise(name("best.y")))
    nodes = staged(nodes.select("x", "origin", "id", "hub"), "nodes")
    hub = nodes.select("x", "hub")
    ends = links.select(name("a").alias("x"), name("b").alias("y"), w.alias("w"))
    across = ends.join(hub.withColumnRenamed("hub", "u"), "x")
    across = across.join(hub.select(F.col("x").alias("y"), F.col("hub").alias("v")), "y").where("u <> v")
    between = across.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("w").alias("w"))
    return nodes, staged(between, "between")


AXES = [f"e{i}" for i in range(VECTORS)]


def _largest_step(between: DataFrame, v: DataFrame) -> float:
    """The greatest difference of any vector between two linked hubs."""
    there = v.select(F.col("x").alias("v"), *[F.col(c).alias(f"o{c}") for c in AXES])
    steps = between.join(v.withColumnRenamed("x", "u"), "u").join(there, "v")
    return steps.agg(F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"o{c}")) for c in AXES])).alias("m")).first().m or 0.0


def power_iteration(between: DataFrame, start: DataFrame) -> tuple[DataFrame, bool]:
    """Iterate the vectors of ``start`` (x and AXES) with affinities (u, v, w) divided by each row's sum.

    The operator is P v = (v + D^-1 W v) / 2; half of the old value keeps two-coloured graphs from
    swinging. Its eigenvectors to the eigenvalue one are those that are constant on what is linked, one
    for each linked part, so none of the vectors can become a multiple of another; the powers are
    combined by Chebyshev's recurrence, which damps all eigenvalues up to ``DAMPED`` in far fewer rounds.
    It ends when no two linked hubs differ by more than ``TOLERANCE``. Hubs without a neighbour keep their values.
    Gives the vectors, and whether they settled in ``BLOCKS`` blocks of ``ROUNDS`` rounds.
    """
    both = between.select(F.col("u").alias("x"), F.col("v").alias("y"), "w").union(between.select("v", "u", "w"))
    degree = both.groupBy("x").agg(F.sum("w").alias("d"))
    steps = both.join(degree, "x").select(F.col("y").alias("src"), F.col("x").alias("dst"), (F.col("w") / F.col("d") / 2).alias("p"), F.lit(0.0).alias("own"))
    steps = staged(steps.unionByName(degree.select(F.col("x").alias("src"), F.col("x").alias("dst"), F.lit(0.5).alias("p"), F.lit(1.0).alias("own"))), "steps")
    linked = degree.select("x")
    alone = start.join(linked, "x", "left_anti")
    v = staged(start.join(linked, "x", "left_semi"), "vectors")
    sent = F.broadcast if v.count() <= BROADCAST_ROWS else lambda df: df  # some 170 bytes each
    reach = (2 - DAMPED) / DAMPED
    settled = False
    for _ in range(BLOCKS):
        at, before = v.select(F.col("x").alias("src"), *AXES, *[F.lit(0.0).alias(f"b{c}") for c in AXES]), (0.0, 1.0)
        for k in range(ROUNDS):
            # T(k-1) and T(k) of Chebyshev's polynomials at ``reach``; the first round is a plain one.
            following = reach if k == 0 else 2 * reach * before[1] - before[0]
            new, old = (1.0, 0.0) if k == 0 else (2 * before[1] / following, before[0] / following)
            scale = 1.0 / reach if k == 0 else new
            moved = steps.join(sent(at), "src").groupBy("dst")
            mixed = [
                (scale * (2 / DAMPED * F.sum(F.col("p") * F.col(c)) - F.sum(F.col("own") * F.col(c))) - old * F.sum(F.col("own") * F.col(f"b{c}"))).alias(c) for c in AXES
            ]
            at = moved.agg(*mixed, *[F.sum(F.col("own") * F.col(c)).alias(f"b{c}") for c in AXES]).withColumnRenamed("dst", "src")
            before = (before[1], following)
        v = staged(at.select(F.col("src").alias("x"), *AXES), "vectors")
        if _largest_step(between, v) <= TOLERANCE:
            settled = True
            break
    return v.unionByName(alone), settled


def spectral_embedding(hubs: DataFrame, between: DataFrame) -> tuple[DataFrame, bool]:
    """The embedding of the hubs (hub, n): hub, n and e; and whether the iteration settled.

    The vectors start as hashes of the hubs, so runs agree. Afterwards they are made orthogonal with
    length one, by the Cholesky factor of their products over all hubs: a matrix of VECTORS by VECTORS.
    """
    start = [(F.pmod(F.xxhash64("x", F.lit(i)), F.lit(1 << 40)) / float(1 << 40) - 0.5).alias(c) for i, c in enumerate(AXES)]
    v, settled = power_iteration(between, hubs.select(F.col("hub").alias("x")).select("x", *start)) if not between.isEmpty() else (hubs.select(F.col("hub").alias("x")).select("x", *start), True)
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[: i + 1]]
    sums = v.agg(F.count("*").alias("n"), *[F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]).first()
    gram = np.eye(VECTORS)
    for a, b in pairs:
        i, j = AXES.index(a), AXES.index(b)
        gram[i, j] = gram[j, i] = (sums[f"{a}_{b}"] or 0.0) + (RIDGE if i == j else 0.0)
    turn = np.linalg.inv(np.linalg.cholesky(gram)) if sums.n > VECTORS else np.eye(VECTORS)
    e = F.array(*[sum((F.col(AXES[j]) * float(turn[i, j]) for j in range(i)), F.col(AXES[i]) * float(turn[i, i])) for i in range(VECTORS)])
    return hubs.join(v.select(F.col("x").alias("hub"), e.alias("e")), "hub").select("hub", "n", "e"), settled


def kmeans(points: DataFrame, width: float = WIDTH, rounds: int = 20) -> DataFrame:
    """K-means of weighted points (hub, n, e) with as many centres as there are dense places: hub, cluster.

    Centres start at the occupied cells of three grids, each shifted by a third of a cell. A point has one
    candidate in each grid; it takes the heaviest first and then, after each update of the means, the
    nearest, until no point changes its centre.
    """
    cell = lambda shift: F.xxhash64(F.lit(shift), F.transform("e", lambda v: F.floor(v / width + shift / 3)))
    near = staged(points.select("hub", "n", "e", F.explode(F.array(*[cell(i) for i in range(3)])).alias("c")), "candidates")
    size = near.groupBy("c").agg(F.sum("n").alias("size"))
    label = near.join(size, "c").groupBy("hub").agg(F.max_by(F.struct("c", "n", "e"), F.struct("size", "c")).alias("m"))
    label = staged(label.select("hub", "m.*"), "labels")
    for _ in range(rounds):
        weight = F.sum("n")
        centres = label.groupBy("c").agg(F.array(*[F.sum(F.col("e")[i] * F.col("n")) / weight for i in range(VECTORS)]).alias("centre"))
        far = F.aggregate(F.zip_with("e", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
        chosen = near.join(centres, "c").groupBy("hub").agg(F.min_by(F.struct("c", "n", "e"), F.struct(F.round(far, 12), "c")).alias("m"))
        following = staged(chosen.select("hub", "m.*"), "labels")
        same = following.join(label.select("hub", F.col("c").alias("old")), "hub").where("c <> old").isEmpty()
        release(label)
        label = following
        if same:
            break
    return label.select("hub", F.col("c").alias("cluster"))


def _checked(label: DataFrame, between: DataFrame, points: DataFrame, settled: bool) -> DataFrame:
    """The clusters of hubs after an exact check: hub, cluster.

    What k-means has put together stays together unless its links are too few to connect it, which shows
    two parts that met by chance; it then falls apart into its linked parts. Linked clusters whose hubs
    the iteration has not brought within ``TOLERANCE`` are joined; where it settled there are none.
    """
    u, v = label.select(F.col("hub").alias("u"), F.col("cluster").alias("a")), label.select(F.col("hub").alias("v"), F.col("cluster").alias("b"))
    ends = between.select("u", "v").join(u, "u").join(v, "v")
    inner = ends.where("a = b").groupBy(F.col("a").alias("cluster")).agg(F.count("*").alias("links"))
    wide = label.groupBy("cluster").agg(F.count("*").alias("hubs")).where("hubs > 1")
    weak = staged(wide.join(inner, "cluster", "left").where("coalesce(links, 0) < hubs - 1").select("cluster"), "weak")
    if not weak.isEmpty():
        parts = components(ends.where("a = b").join(weak.withColumnRenamed("cluster", "a"), "a", "left_semi").select("u", "v"), "u", "v")
        apart = label.join(weak, "cluster", "left_semi").join(parts.withColumnRenamed("node", "hub"), "hub", "left").select("hub", F.coalesce("root", "hub").alias("cluster"))
        label = staged(label.join(weak, "cluster", "left_anti").select("hub", "cluster").unionByName(apart), "apart")
    if not settled:
        e = points.select("hub", "e")
        far = ends.where("a <> b").join(e.toDF("u", "eu"), "u").join(e.toDF("v", "ev"), "v")
        far = far.where(F.exists(F.zip_with("eu", "ev", lambda x, y: F.abs(x - y) > TOLERANCE), lambda x: x)).select("a", "b")
        roots = components(far).withColumnRenamed("node", "cluster")
        label = label.join(roots, "cluster", "left").select("hub", F.coalesce("root", "cluster").alias("cluster"))
    return label


def similarity_clusters(vectors: DataFrame, radius: float = 0.5, dim: int = 128) -> DataFrame:
    """Clusters of vectors (origin, id, v): origin, id, cluster and size of each member.

    The graph of sparse affinities is coarsened to hubs, whose power iteration, run until linked hubs
    agree, gives the embedding; k-means of this gives the clusters. An exact check follows, see ``_checked``
    and ``missed_links``. ``cluster`` is the smallest id. Defined cases: vectors that are null, of
    another length, all zero, or with a null, NaN or infinity are left out, as are null ids; repeated
    vectors are near each other and count each; rows near no other are in no cluster; an empty table
    gives none. Origins are never mixed.
    """
    with shuffles_removed(vectors.sparkSession):
        rows, sizes = bucket_table(vectors, dim)
        links = affinities(rows, sizes, radius)
        nodes, between = graph(links)
        release(links)
        hubs = staged(nodes.groupBy("hub").agg(F.min("id").alias("least"), F.count("*").alias("n")), "hubs")
        points, settled = spectral_embedding(hubs.select("hub", "n"), between)
        points = staged(points, "points")
        final = staged(_checked(kmeans(points), between, points, settled), "clusters")
        # Sizes and smallest ids by hub first, so that the members themselves are moved only once.
        parts = hubs.join(final.withColumnRenamed("cluster", "label"), "hub")
        whole = parts.groupBy("label").agg(F.min("least").alias("cluster"), F.sum("n").alias("size"))
        whole = parts.select("hub", "label").join(whole, "label").drop("label")
        members = nodes.join(whole, "hub").select("origin", "id", "cluster", "size")
        if not sizes.isEmpty():
            members = staged(members, "kept")
            pairs = staged(missed_links(rows, sizes, members, radius), "missed")
            if not pairs.isEmpty():
                members = staged(joined_clusters(members, pairs), "whole")
        release(rows)
    return members.select("origin", "id", "cluster", "size")


def _pack(v: np.ndarray) -> pa.Array:
    """Vectors of length one with 24 bits a number, as exact as single precision near one."""
    q = np.round(v.astype(np.float64) * (2**23 - 1)).astype("<i4").view(np.uint8).reshape(*v.shape, 4)
    return pa.array([x.tobytes() for x in q[:, :, :3]], pa.binary())


def _unpack(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    q = np.zeros((len(column), dim, 4), np.uint8)
    q[:, :, 1:] = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), dim, 3)
    return (q.view("<i4")[:, :, 0] >> 8) / (2**23 - 1)


RATED = "origin string, cluster bigint, id bigint, n bigint, typical double, v binary"


def typicality(members: DataFrame, vectors: DataFrame, dim: int = 128) -> DataFrame:
    """How typical members (origin, id, cluster, size) are: their mean cosine with all members of the cluster.

    This is the product of a member's unit vector with the mean of all of them, so every member counts
    and no pairs are formed. A cluster above ``PART`` rows is summed in parts, whose sums are added up.
    Seven decimals, so that the order of summation does not matter. Rows of one id give the greatest.
    """

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = _unit(batch.column("v"), dim)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column("origin").take(take), batch.column("id").take(take), _pack(v)], names=["origin", "id", "v"])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _runs(batches, "cluster", "part", "origin"):
            v = _unpack(t.column("v"), dim)
            sums, n = np.add.reduceat(v, starts), np.diff([*starts, t.num_rows])
            whole = t.column("parts").to_numpy() == 1
            typical = np.round((v * np.repeat(sums / n[:, None], n, 0)).sum(1), 7)
            first = t.select(["origin", "cluster"])
            columns = [pa.array(np.ones(len(v), int)), pa.array(typical, mask=~whole), pc.if_else(pa.array(whole), pa.scalar(None, pa.binary()), t.column("v").combine_chunks())]
            yield from pa.table([*first.columns, t.column("id"), *columns], names=["origin", "cluster", "id", "n", "typical", "v"]).to_batches()
            if len(cut := np.nonzero(~whole[starts])[0]):  # sums of parts, without id
                first = first.take(pa.array(np.array(starts)[cut]))
                columns = [pa.nulls(len(cut), pa.int64()), pa.array(n[cut]), pa.nulls(len(cut), pa.float64()), pa.array([x.tobytes() for x in sums[cut]], pa.binary())]
                yield from pa.table([*first.columns, *columns], names=["origin", "cluster", "id", "n", "typical", "v"]).to_batches()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = [np.frombuffer(b"".join(x), np.float64).reshape(-1, dim).sum(0) / n for x, n in zip(batch.column("sums").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("o"), batch.column("c"), pa.array([m.tobytes() for m in means], pa.binary())], names=["o", "c", "mean"])

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unpack(batch.column("v"), dim)
            m = np.frombuffer(b"".join(batch.column("mean").to_pylist()), np.float64).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("origin", "cluster", "id")], pa.array(np.round((v * m).sum(1), 7))], names=["origin", "cluster", "id", "typical"])

    units = vectors.where("id is not null").select("origin", "id", "v").mapInArrow(unit, "origin string, id bigint, v binary")
    parts = F.ceil(F.col("size") / PART).cast("int")
    rows = members.select("origin", "id", "cluster", parts.alias("parts")).join(units.hint("merge"), ["origin", "id"])  # one plan at every size
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartition(n, "origin", "cluster", "part").sortWithinPartitions("origin", "cluster", "part")
    rated = staged(spread.mapInArrow(rate, RATED), "rated")
    sums = rated.where("id is null").groupBy(F.col("origin").alias("o"), F.col("cluster").alias("c")).agg(F.sum("n").alias("n"), F.collect_list("v").alias("sums"))
    means = sums.mapInArrow(add_up, "o string, c bigint, mean binary")  # a row for each cluster above PART rows only
    large = rated.where("id is not null and v is not null").join(F.broadcast(means), (F.col("origin") == F.col("o")) & (F.col("cluster") == F.col("c")))
    large = large.select("origin", "cluster", "id", "v", "mean").mapInArrow(against, "origin string, cluster bigint, id bigint, typical double")
    rated = rated.where("typical is not null").select("origin", "cluster", "id", "typical").unionByName(large)
    return rated.groupBy("origin", "cluster", "id").agg(F.max("typical").alias("typical"))


def face_vectors(detected: DataFrame, unresolved: DataFrame) -> DataFrame:
    """The vectors of both tables of faces in one form."""
    one = detected.select(F.lit("detected_faces").alias("origin"), F.col("face_id").alias("id"), F.col("embedding").alias("v"))
    return one.unionByName(unresolved.select(F.lit("unresolved_faces").alias("origin"), F.col("cluster_id").alias("id"), F.col("face_encoding").alias("v")))


def face_groups(detected: DataFrame, unresolved: DataFrame, least: int = 3) -> DataFrame:
    """Each member of a group of at least ``least`` faces, but for the first, after the first."""
    members = similarity_clusters(face_vectors(detected, unresolved))
    members = members.where((F.col("size") >= least) & (F.col("id") != F.col("cluster")))
    return members.select("origin", F.col("cluster").alias("first_id"), F.col("id").alias("member_id"))


def face_group_report(detected: DataFrame, unresolved: DataFrame, typical: int = 3) -> DataFrame:
    """Each group with its size, its occurrences and its most typical members, by ``typicality``.

    Occurrences add up ``occurrence_count`` of unresolved faces; a count that is null, zero or negative
    stands for the one row, as does each detected face; rows of one id are one member whose counts add up.
    """
    vectors = face_vectors(detected, unresolved)
    members = staged(typicality(staged(similarity_clusters(vectors), "members"), vectors), "typical")
    counts = unresolved.select(F.col("cluster_id").alias("id"), F.greatest(F.coalesce("occurrence_count", F.lit(1)), F.lit(1)).alias("n"))
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    counted = members.where("origin = 'unresolved_faces'").join(counts, "id").select("origin", "id", "typical", "cluster", "n")
    rows = counted.unionByName(members.where("origin <> 'unresolved_faces'").select("origin", "id", "typical", "cluster", F.lit(1).alias("n")))
    # The best of each part of a cluster first, then of these: never more than ``typical`` rows a part meet.
    rows = rows.withColumn("part", F.pmod("id", F.lit(64)))
    rank = F.row_number().over(Window.partitionBy("origin", "cluster", "part").orderBy(F.col("typical").desc(), "id"))
    best = rows.withColumn("r", rank).where(F.col("r") <= typical).groupBy("origin", "cluster")
    best = best.agg(F.sort_array(F.collect_list(F.struct("typical", (-F.col("id")).alias("k"))), asc=False).alias("t"))
    sizes = rows.groupBy("origin", "cluster").agg(F.count("*").alias("faces"), F.sum("n").alias("occurrences"))
    out = sizes.join(best, ["origin", "cluster"]).withColumn("typical_ids", F.transform(F.slice("t", 1, typical), lambda x: -x["k"]))
    return out.select("origin", F.col("cluster").alias("first_id"), "faces", "occurrences", "typical_ids")
