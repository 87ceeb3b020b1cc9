"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations (operator 7).

A pseudo-random rotation is three rounds of random signs and a Walsh-Hadamard transform; a vector's code is the axis
(with its sign) of largest size, and a table's key joins the codes of some rotations, more of them the more vectors
there are. Besides its own key a vector goes to the next best ones. How many tables and further keys there are follows from
the rotations: `plan` hashes made-up pairs at the threshold and takes the fewest keys by which RECALL of them meet,
so recall doesn't fall as tables grow. Vectors that meet under a key are candidates; their cosine is computed in double
precision, by one formula where it is close to the threshold, and a pair counts under the least key that it shares, so once.

Keys travel with ids alone until it is known which of them hold two vectors or more. A key with many vectors is cut into blocks
(found out over parts of the key, so that none sits in one task), and tasks compare pairs of blocks; no pair leaves a task, only
counts and a forest of links. So n_links is exact for the links found, and the work for a group of g near copies, g squared
products, is spread over tasks of a fixed size. Equal vectors are one vector with a multiplicity.

Cases: vectors that are null, zero or hold null or non-finite components link with nothing; vectors of different lengths
don't link; rows that share a vec_id each get a row and count each; rows without a vec_id get the component of
equal vectors, and a vector that only such rows hold links with nothing else; an empty table gives an empty result; further columns don't pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.llm.common import lean, mix, table, written
from cellsift.llm.components import components

#: Least share of pairs at the threshold that must meet; axes that a rotation's code may take; keys of a table at most.
COSINE, RECALL, ALTERNATIVES, KEYS = 0.95, 0.98, 4, 6
#: Vectors that a key should hold if they were random, those of a key that one task compares with each other, and pairs that it computes at once.
CROWD, BLOCK, PAIRS = 2048, 4096, 1 << 18
#: Parts of a key that are counted and cut apart from each other; made-up pairs at most (a fifth of it at least); cosines so close to the threshold are computed anew.
PARTS, TRIED, CLOSE = 16, 1500, 1e-9


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row; the width is a power of two."""
    width, h = x.shape[1], 1
    while h < width:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), width)
        h *= 2
    return x / math.sqrt(width)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """One of the pseudo-random rotations; rows are padded to a power of two before."""
    for k in range(3):
        signs = mix(np.arange(x.shape[1], dtype=np.uint64) + np.uint64((seed * 3 + k + 1) << 32)) >> np.uint64(63)
        x = hadamard(x * np.where(signs > 0, 1.0, -1.0))
    return x


def width_of(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


def keys_of(x: np.ndarray, joined: int, tables: int, keys: int) -> np.ndarray:
    """So many keys of unit vectors for each table (vectors, tables, keys): the best combinations of the best axes of each rotation, best first."""
    n, d = x.shape
    width = width_of(d)
    padded = np.zeros((n, width))
    padded[:, :d] = x
    best = min(ALTERNATIVES, width)
    out = np.empty((n, tables, keys), np.uint64)
    for t in range(tables):
        cost, code = np.zeros((n, 1)), np.zeros((n, 1), np.uint64)
        for k in range(joined):
            r = rotate(padded, t * joined + k)
            size = np.abs(r)
            axis = np.argpartition(-size, best - 1, axis=1)[:, :best]
            axis = np.take_along_axis(axis, np.argsort(-np.take_along_axis(size, axis, 1), axis=1, kind="stable"), 1)
            top = np.take_along_axis(size, axis, 1)
            signed = (2 * axis + (np.take_along_axis(r, axis, 1) < 0)).astype(np.uint64)
            cost = (cost[:, :, None] + ((top[:, :1] - top) ** 2)[:, None, :]).reshape(n, -1)
            code = mix(code[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + signed[:, None, :] + np.uint64(1)).reshape(n, -1)
            keep = np.argsort(cost, axis=1, kind="stable")[:, :keys]
            cost, code = np.take_along_axis(cost, keep, 1), np.take_along_axis(code, keep, 1)
        if code.shape[1] < keys:
            code = np.concatenate([code, np.repeat(code[:, :1], keys - code.shape[1], 1)], 1)
        out[:, t] = mix(code ^ np.uint64((t + 1) << 40) ^ np.uint64(d << 48))
    return out


def made_up(d: int, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of random unit vectors with this cosine."""
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine * cosine) * b


def meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether two vectors share a key, by table; a, b: (vectors, tables, keys)."""
    return (a[:, :, :, None] == b[:, :, None, :]).any((2, 3))


@once
def plan(n: int, d: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, int]:
    """Rotations of a key, tables, and keys of a table for n vectors of d components: as few keys in all as let the made-up pairs meet."""
    if d < 2:
        return 1, 1, 1
    joined = max(1, math.ceil(math.log(max(2, n * KEYS / 2 / CROWD)) / math.log(2 * width_of(d))))
    x, y = made_up(d, min(cosine, 1 - 1e-12), max(TRIED // 5, min(TRIED, TRIED * 128 // width_of(d))), d)
    tried = 4
    a, b = (keys_of(v, joined, tried, KEYS) for v in (x, y))
    best = None
    for keys in range(1, KEYS + 1):
        hit = min(max(float(meet(a[:, :, :keys], b[:, :, :keys]).mean()), 1e-3), 1 - 1e-9)
        tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit)))
        if best is None or tables * keys < best[0]:
            best = tables * keys, tables, keys
    return joined, best[1], best[2]


def hashed(vectors: DataFrame, n: int, cosine: float) -> DataFrame:
    """vec_id, m, x (the components as they are, as bytes) and keys, of rows vec_id, m, embedding."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 4096):
                b = whole.slice(a, 4096)
                column = b.column(2)
                length = np.array(column.value_lengths())
                for d in np.unique(length).tolist():
                    rows = np.flatnonzero(length == d)
                    raw = np.array(column.take(pa.array(rows)).flatten(), kind).reshape(len(rows), d)
                    keys = keys_of(unit(raw), *plan(n, d, cosine)).reshape(len(rows), -1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array([v.tobytes() for v in raw], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["vec_id", "m", "x", "keys"])

    return vectors.mapInArrow(lean(run), "vec_id bigint, m bigint, x binary, keys array<bigint>")


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def first_shared(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether no key less than this one is common to both; the same for (a, b) as for (b, a)."""
    alive = np.arange(len(a))
    good = np.ones(len(a), bool)
    for k in range(a.shape[1]):
        own = a[alive, k]
        less = np.flatnonzero(own < key[alive])
        shared = less[(b[alive[less]] == own[less, None]).any(1)]
        good[alive[shared]] = False
        alive = np.delete(alive, shared)
        if not len(alive):
            break
    return good


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index that each of n nodes is connected to by the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def across(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a group compares rows of these sides: all if it is one block (-1), else those of different blocks."""
    return (a < 0) | (a != b)


def compare(cosine: float, kind: str = "<f8"):
    """Counts of links and a forest of links, over the candidates of a partition's keys. kind: of the vectors' components."""

    def linked(v: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Whether pairs whose cosine was computed somehow link: close to the threshold one formula decides, whatever the group's size."""
        out = value >= cosine
        close = np.flatnonzero(np.abs(value - cosine) < CLOSE)
        out[close] = (v[i[close]] * v[j[close]]).sum(1) >= cosine
        return out

    def judge(key: np.ndarray, ids: np.ndarray, m: np.ndarray, keys: np.ndarray, i: np.ndarray, j: np.ndarray, out: list) -> None:
        for a in range(0, len(i), PAIRS):
            p, q = i[a : a + PAIRS], j[a : a + PAIRS]
            own = first_shared(key[p], keys[p], keys[q])
            p, q = p[own], q[own]
            if len(p):
                count = np.bincount(p, m[q], len(ids)) + np.bincount(q, m[p], len(ids))
                rows = np.flatnonzero(count)
                out.append((ids[rows], count[rows].astype(np.int64), ids[forest(p, q, len(ids))[rows]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Compare all groups that are whole; rows come in order of group."""
            nonlocal held, size
            if not held:
                return
            wide = max(h[6].shape[1] for h in held)
            held = [(*h[:6], np.pad(h[6], ((0, 0), (0, wide - h[6].shape[1])), "edge")) for h in held]
            group, key, side, ids, m, x, keys = (np.concatenate([h[k] for h in held]) if k != 5 else [v for h in held for v in h[5]] for k in range(7))
            end = len(group) if last else int(np.searchsorted(group, group[-1])) if (group[1:] >= group[:-1]).all() else 0
            if not end:
                return
            held = [(group[end:], key[end:], side[end:], ids[end:], m[end:], x[end:], keys[end:])] if end < len(group) else []
            size = len(group) - end
            out: list[tuple] = []
            starts = np.flatnonzero(np.concatenate([[True], group[1:end] != group[: end - 1]]))
            stops = np.append(starts[1:], end)
            length = np.array([len(v) for v in x[:end]])
            little: list[tuple[int, int]] = []
            for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
                if b - a < 2 or (length[a:b] != length[a]).any():
                    continue
                if b - a <= 64:
                    little.append((a, b))
                    continue
                v = unit(np.frombuffer(b"".join(x[a:b]), kind).reshape(b - a, -1))
                for p in range(0, b - a, 1024):
                    for q in range(p, b - a, 1024):
                        products = v[p : p + 1024] @ v[q : q + 1024].T
                        i, j = np.nonzero(products >= cosine - CLOSE)
                        value = products[i, j]
                        i, j = i + p, j + q
                        good = (i < j) & across(side[a + i], side[a + j])
                        i, j, value = i[good], j[good], value[good]
                        good = linked(v, i, j, value)
                        judge(key[a:b], ids[a:b], m[a:b], keys[a:b], i[good], j[good], out)
            if little:
                sizes = np.array([b - a for a, b in little])
                for d in np.unique(length[[a for a, _ in little]]).tolist():
                    own = [(a, b) for a, b in little if length[a] == d]
                    rows = np.concatenate([np.arange(a, b) for a, b in own])
                    v = unit(np.frombuffer(b"".join([x[r] for r in rows]), kind).reshape(len(rows), -1))
                    sizes = np.array([b - a for a, b in own])
                    begin = np.cumsum(sizes) - sizes
                    for s in np.unique(sizes).tolist():
                        i0, j0 = np.triu_indices(s, 1)
                        base = begin[sizes == s]
                        step = max(1, PAIRS // len(i0))
                        for c in range(0, len(base), step):
                            i, j = (base[c : c + step, None] + i0).ravel(), (base[c : c + step, None] + j0).ravel()
                            near = linked(v, i, j, np.einsum("pd,pd->p", v[i], v[j])) & across(side[rows[i]], side[rows[j]])
                            judge(key[rows], ids[rows], m[rows], keys[rows], i[near], j[near], out)
            if out:
                ids_, count, root = (np.concatenate([o[k] for o in out]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(ids_), pa.array(count), pa.array(root)], names=["vec_id", "n", "root"])

        for b in batches:
            count = np.array(b.column(6).value_lengths())  # by the vectors' lengths; the last key again where there are fewer
            keys = np.array(b.column(6).flatten(), np.int64)[(np.cumsum(count) - count)[:, None] + np.minimum(np.arange(count.max()), count[:, None] - 1)]
            held.append((*(np.array(b.column(k), np.int64) for k in range(5)), b.column(5).to_pylist(), keys))
            size += b.num_rows
            if size > 40_000:
                yield from flush(False)
        yield from flush(True)

    return run


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each of df's rows."""
    e = F.col("embedding")
    single = df.schema[embedding].dataType.simpleString() == "array<float>"
    plain = df.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("embedding"))
    finite = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(e.isNotNull() & finite & F.exists(e, lambda v: v != 0), F.lit(False))
    marked = plain.withColumn("f1", F.when(good, F.xxhash64(e))).withColumn("f2", F.when(good, F.xxhash64(F.lit(7), e)))
    # Equal vectors are a class, known by a hash as other vectors may have the same vec_id.
    classes = marked.where("f1 is not null").groupBy("f1", "f2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("m"))
    classes = written(classes.withColumn("class", F.xxhash64("f1", "f2")), "classes")
    n = classes.count()
    one = marked.join(classes.where("rep is not null"), ["f1", "f2"]).where("vec_id = rep").groupBy("class").agg(F.first("m").alias("m"), F.first("embedding").alias("embedding"))
    vectors = written(hashed(one.select(F.col("class").alias("vec_id"), "m", "embedding"), n, cosine), "vectors")

    # Which keys hold how many vectors, a part of a key at a time.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)).alias("part")
    at = vectors.select("vec_id", part, F.explode(F.array_distinct("keys")).alias("key"))
    sizes = at.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part"))
    at = at.join(sizes, ["key", "part"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int"))
    rows = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    group = F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other"))
    side = F.when((F.col("block") == F.col("other")) | (F.col("blocks") == 1), F.lit(-1)).otherwise(F.col("block"))
    rows = rows.select(group.alias("group"), "key", side.cast("bigint").alias("side"), "vec_id").join(vectors, "vec_id").select("group", "key", "side", "vec_id", "m", "x", "keys")
    found = written(rows.repartition(F.col("group")).sortWithinPartitions("group").mapInArrow(lean(compare(cosine, "<f4" if single else "<f8")), "vec_id bigint, n bigint, root bigint"), "found")

    counts = found.groupBy(F.col("vec_id").alias("class")).agg(F.sum("n").alias("n"))
    rep = lambda of, name: classes.select(F.col("class").alias(of), F.col("rep").alias(name))
    comps = components(found.select("vec_id", "root").distinct().join(rep("vec_id", "a"), "vec_id").join(rep("root", "b"), "root").select("a", "b"))
    named = classes.join(counts, "class", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("f1", "f2", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("comp", "rep").alias("component_id"))
    out = marked.join(named, ["f1", "f2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op7_cross_polytope": op7_cross_polytope}
SQL: dict[str, str] = {}
