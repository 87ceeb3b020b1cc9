"""N-gram Jaccard join (operator 1): documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more.

1. Workers hash each text's n-grams. A chunk of texts sends its hashes, sorted and cut by hash range, as byte blobs to
   the range's task, which counts how many sets hold each. Only those in two sets or more go back to the chunk; what
   many texts of a chunk share is sent once with its count.
2. Rare first: a set's n-grams are ordered by falling rarity, and two sets that link share one of the first
   n - ceil(0.8 n) + 1. A set whose n-grams found nowhere else fill that prefix links with nothing and is done.
3. Sets join on prefix n-grams. First each is compared with one leader, of most of its lists the set that has least of its own; those
   that link form a cluster with a known distance to the leader. Lists then pair clusters, not documents, after length
   and positional filters; a suffix filter bounds what leaders share after their prefixes by counts of hash ranges. What
   was verified once, as leader and member or in a first try of members, isn't verified again.
   The Jaccard distance is a metric, so leaders that are further apart than 0.2 and their clusters' radii rule out all
   pairs between the clusters; where they don't, and the clusters aren't linked yet, the members are joined themselves.
4. Components of the links.

So no group of copies is expanded into its pairs, and no link between different texts is lost.

Hashes: 64 bits a set's size and identity (two such sums and the size), 48 bits an n-gram in the joins.

Cases: a null text, or one without words, has an empty set and links with nothing; one of fewer words than n has one
element, all its words; repeated rows have equal sets; rows of one doc_id count as one vertex and each get a row;
rows without a doc_id get the component of rows with an equal set, and a set that only such rows hold links with nothing
(null); an empty table gives an empty result; further columns don't pass. The input must read the same on each attempt of a task, as a table does.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsift.llm.common import buffers, lean, mix, partitions, spans, table, written
from cellsift.llm.components import components

WORDS, PERCENT = 5, 80
SPAN = 1 << 18
#: Hashes and texts of a chunk at most (but for its last text), and texts of a chunk from which on an n-gram is sent once.
CHUNK_HASHES, CHUNK_TEXTS, COMMON = 1_000_000, 60_000, 32
#: Member pairs tried first for two clusters that may touch.
TRIES = 12
#: Classes of equal sets with a share of the documents of one over this, which are so many at most.
HOT = 1000
#: Hash ranges of the suffix filter.
RANGES = 16
ONES, SET_BITS = np.uint64((1 << 16) - 1), np.uint64(16)
BASE = 0x9E3779B97F4A7C15 | 1

_lower = np.arange(256, dtype=np.uint64)
_lower[65:91] += np.uint64(32)
LETTER = mix(_lower + np.uint64(0x5851F42D4C957F2D))
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base & (1 << 64) - 1))
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Hashes of word n-grams. Words are hashed by sums of powers, so that one pass over the bytes serves all texts."""

    def __init__(self, words: int):
        self.words, self.up, self.down = words, powers(BASE, 1), powers(BASE, 1)

    def word_hashes(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and its text."""
        if len(self.up) <= len(data):
            self.up, self.down = powers(BASE, len(data) + SPAN), powers(pow(BASE, -1, 1 << 64), len(data) + SPAN)
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = ~SEPARATOR[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[begin[begin <= len(data)]] = True
        starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
        ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTER[data] * self.up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))), (np.searchsorted(begin, starts, "right") - 1)

    def sets(self, data: np.ndarray, begin: np.ndarray, texts: int) -> list[np.ndarray]:
        """Sorted distinct hashes of each text's n-grams."""
        word, of = self.word_hashes(data, begin)
        n, k = len(word), self.words
        factor = np.uint64(0xD1342543DE82EF95)
        cut = np.searchsorted(of, np.arange(texts + 1))
        gram = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            gram = gram * factor + word[j : n - k + 1 + j]
        gram = mix(gram ^ np.uint64(k))
        out = []
        for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            if b - a >= k:
                own = np.sort(gram[a : b - k + 1])
                out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif b > a:
                h = np.zeros(1, np.uint64)
                for j in range(a, b):
                    h = h * factor + word[j]
                out.append(mix(h ^ np.uint64(b - a)))
            else:
                out.append(word[:0])
        return out


class Chunk:
    """Texts whose hashes are sent together."""

    def __init__(self):
        self.ids, self.sizes, self.prints, self.hashes, self.same, self.total = [], [], [], [], {}, 0

    def add(self, doc_id: int | None, own: np.ndarray) -> None:
        k = len(self.ids)
        key = (len(own), int(np.add.reduce(mix(own ^ np.uint64(0x2545F4914F6CDD1D)))), int(np.bitwise_xor.reduce(mix(own ^ np.uint64(0x632BE59BD9B4E019)))) if len(own) else 0)
        self.ids.append(doc_id)
        self.sizes.append(len(own))
        self.prints.append(key[1:])
        if len(own) and (first := self.same.setdefault(key, k)) == k:
            self.hashes.append((np.unique(own >> SET_BITS) << SET_BITS) | np.uint64(k))
            self.total += len(own)
        elif len(own) and doc_id is not None and (self.ids[first] is None or doc_id < self.ids[first]):
            self.same[key] = k  # the least doc_id of equal sets stands for them; their hashes stay under the first one's number

    def rows(self, chunk: int, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
        """part, chunk, kind, blob. 0: hashes for counting; 1: hashes that many texts here share, with counts; 2 and 3: to this chunk itself, passed on: who holds the latter, and the texts."""
        home = chunk % parts
        stands = np.arange(len(self.ids))
        for (key, k) in self.same.items():
            stands[k] = -1 - k  # marks the one that stands for its class
        valid = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        prints = np.array([(a, b) for a, b in self.prints], np.uint64).reshape(-1, 2)
        yield home, chunk, 3, np.int64(len(ids)).tobytes() + ids.tobytes() + np.array(self.sizes, np.int64).tobytes() + prints[:, 0].tobytes() + prints[:, 1].tobytes() + (stands < 0).astype(np.uint8).tobytes() + valid.tobytes()
        if not self.hashes:
            return
        entries = np.sort(np.concatenate(self.hashes))
        h = entries >> SET_BITS
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(np.append(starts, len(h)))
        many = counts >= COMMON
        if many.any():
            often = np.repeat(many, counts)
            yield home, chunk, 2, entries[often].tobytes()
            pairs = np.stack([h[starts[many]], counts[many].astype(np.uint64)], 1)
            for part, a, b in cuts(pairs[:, 0], parts):
                yield part, chunk, 1, pairs[a:b].tobytes()
            entries = entries[~often]
            h = h[~often]
        for part, a, b in cuts(h, parts):
            yield part, chunk, 0, entries[a:b].tobytes()


def cuts(h: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """Slices of sorted 48-bit hashes by range, the whole span cut into so many equal parts."""
    edges = (np.arange(parts + 1, dtype=np.float64) * (float(1 << 48) / parts)).astype(np.uint64)
    at = np.searchsorted(h, edges)
    at[0], at[-1] = 0, len(h)
    for k in np.flatnonzero(at[1:] > at[:-1]).tolist():
        yield k, int(at[k]), int(at[k + 1])


def batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


SENT = [("part", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())]


def send(words: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, chunk = Shingler(words), Chunk()
        number = TaskContext.get().partitionId() << 24

        def out() -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for r in chunk.rows(number, parts):
                held.append(r)
                size += len(r[3])
                if size > 8 << 20:
                    yield batch(held, SENT)
                    held, size = [], 0
            if held:
                yield batch(held, SENT)

        for b in batches:
            ids = b.column(0).to_pylist()
            data, offsets = buffers(b.column(1))
            for i, j in spans(offsets, SPAN):
                for k, own in enumerate(shingler.sets(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], j - i)):
                    chunk.add(ids[i + k], own)
                    if chunk.total >= CHUNK_HASHES or len(chunk.ids) >= CHUNK_TEXTS:
                        yield from out()
                        chunk, number = Chunk(), number + 1
        if chunk.ids:
            yield from out()

    return run


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the blobs of one hash range: sends back what is in two sets or more, with the number of sets."""
    single: list[tuple[int, np.ndarray]] = []
    shared: list[tuple[int, np.ndarray]] = []
    for b in batches:
        on = []
        for chunk, kind, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if kind > 1:
                on.append((chunk, kind, blob))
            elif kind == 1:
                shared.append((chunk, np.frombuffer(blob, np.uint64).reshape(-1, 2)))
            else:
                single.append((chunk, np.frombuffer(blob, np.uint64)))
        if on:
            yield batch(on, SENT[1:])
    ones = np.sort(np.concatenate([e >> SET_BITS for _, e in single] or [np.zeros(0, np.uint64)]))
    starts = np.flatnonzero(np.concatenate([[True], ones[1:] != ones[:-1]])) if len(ones) else np.zeros(0, np.int64)
    df = np.diff(np.append(starts, len(ones)))
    h = ones[starts]
    del ones
    if shared:
        more = np.concatenate([p for _, p in shared])
        every = np.union1d(h, more[:, 0])
        total = np.zeros(len(every), np.int64)
        total[np.searchsorted(every, h)] = df
        np.add.at(total, np.searchsorted(every, more[:, 0]), more[:, 1].astype(np.int64))
        h, df = every, total
    h, df = h[df > 1], df[df > 1]
    held, size = [], 0
    for chunk, e in single:
        if len(h):
            own = e >> SET_BITS
            at = np.minimum(np.searchsorted(h, own), len(h) - 1)
            found = h[at] == own
            if found.any():
                held.append((chunk, 0, e[found].tobytes() + df[at[found]].astype(np.uint64).tobytes()))
                size += len(held[-1][2])
        if size > 8 << 20:
            yield batch(held, SENT[1:])
            held, size = [], 0
    for chunk, p in shared:
        held.append((chunk, 1, p[:, 0].tobytes() + df[np.searchsorted(h, p[:, 0])].astype(np.uint64).tobytes()))
    if held:
        yield batch(held, SENT[1:])


SETS = "doc_id bigint, n bigint, f1 bigint, f2 bigint, stands boolean, ph array<bigint>, pp array<int>, hs array<bigint>, ranges array<int>, after array<int>"


def settle(percent: int):
    """Each chunk's texts with the n-grams that others hold too, where those reach into the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[bytes]]] = defaultdict(lambda: defaultdict(list))
        for b in batches:
            for chunk, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held[chunk][kind].append(blob)
        for chunk in sorted(held):
            yield from settled(held.pop(chunk), percent)

    return run


def settled(blobs: dict[int, list[bytes]], percent: int) -> Iterator[pa.RecordBatch]:
    texts = blobs[3][0]
    m = int(np.frombuffer(texts, np.int64, 1)[0])
    ids, n = np.frombuffer(texts, np.int64, m, 8), np.frombuffer(texts, np.int64, m, 8 + 8 * m)
    f1, f2 = np.frombuffer(texts, np.int64, m, 8 + 16 * m), np.frombuffer(texts, np.int64, m, 8 + 24 * m)
    stands, valid = np.frombuffer(texts, np.uint8, m, 8 + 32 * m).astype(bool), np.frombuffer(texts, np.uint8, m, 8 + 33 * m).astype(bool)
    halves = [np.frombuffer(x, np.uint64).reshape(2, -1) for x in blobs[0]]
    entries, df = [x[0] for x in halves], [x[1] for x in halves]
    if blobs[2]:
        common = np.frombuffer(b"".join(blobs[2]), np.uint64)
        known = np.concatenate([np.frombuffer(x, np.uint64).reshape(2, -1) for x in blobs[1]], 1)
        known = known[:, np.argsort(known[0])]
        entries.append(common)
        df.append(known[1][np.searchsorted(known[0], common >> SET_BITS)])
    entry = np.concatenate(entries or [np.zeros(0, np.uint64)])
    df = np.concatenate(df or [np.zeros(0, np.uint64)])
    # Hashes lie under the number of the first of equal sets; they belong to the one that stands for them.
    keys = np.stack([f1, f2, n], 1)
    owner = np.arange(m)
    _, klass = np.unique(keys, axis=0, return_inverse=True)
    standing = np.flatnonzero(stands)
    of_class = np.full(int(klass.max()) + 1 if m else 0, -1)
    of_class[klass.ravel()[standing]] = standing
    owner = of_class[klass.ravel()] if m else owner
    doc, h = owner[(entry & ONES).astype(np.int64)], (entry >> SET_BITS)
    order = np.lexsort((h, df, doc))
    doc, h = doc[order], h[order]
    shared = np.bincount(doc, minlength=m)
    start = np.cumsum(shared) - shared
    alone = n - shared
    prefix = n - (percent * n + 99) // 100 + 1
    lives = stands & (shared > 0) & (alone < prefix)
    rank = np.arange(len(doc)) - start[doc]
    first = lives[doc] & (rank < (prefix - alone)[doc])
    ph, pp = h[first].astype(np.int64), (alone[doc] + rank)[first].astype(np.int32)
    whole = lives[doc]
    hd, hh = doc[whole], h[whole]
    by = np.lexsort((hh, hd))
    hd, hh = hd[by], hh[by]
    # Counts by hash range, of all n-grams and of those after the prefix.
    late = whole & ~first
    ranges, after = (np.bincount(d * RANGES + (x >> np.uint64(44)).astype(np.int64), minlength=m * RANGES).reshape(m, RANGES).astype(np.int32) for d, x in ((hd, hh), (doc[late], h[late])))
    at = lambda c: np.concatenate([[0], np.cumsum(c)])
    n_pre, n_set = at(np.bincount(doc[first], minlength=m)), at(np.bincount(hd, minlength=m))
    n_range = at(lives * RANGES)
    flat, flat_after = ranges[lives].ravel(), after[lives].ravel()
    for a in range(0, m, 2048):
        b = min(m, a + 2048)

        def some(edges: np.ndarray, values: np.ndarray, kind: pa.DataType, a: int = a, b: int = b) -> pa.Array:
            rows = pa.ListArray.from_arrays(pa.array(edges[a : b + 1] - edges[a], pa.int32()), pa.array(values[edges[a] : edges[b]], kind))
            return pa.ListArray.from_buffers(rows.type, len(rows), [pa.array(lives[a:b]).buffers()[1], rows.buffers()[1]], children=[rows.values])

        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[a:b], mask=~valid[a:b]), pa.array(n[a:b]), pa.array(f1[a:b]), pa.array(f2[a:b]), pa.array(stands[a:b]), some(n_pre, ph, pa.int64()), some(n_pre, pp, pa.int32()), some(n_set, hh.astype(np.int64), pa.int64()), some(n_range, flat, pa.int32()), some(n_range, flat_after, pa.int32())],
            names=["doc_id", "n", "f1", "f2", "stands", "ph", "pp", "hs", "ranges", "after"],
        )


def document_sets(df: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: set size and identity; for those that may link, prefix n-grams with positions, n-grams that others hold too, and counts by hash range."""
    spark = df.sparkSession
    narrow = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = partitions(spark, narrow)
    sent = narrow.mapInArrow(lean(send(words, parts)), "part int, chunk bigint, kind int, blob binary")
    counted = sent.repartitionById(parts, "part").mapInArrow(lean(count), "chunk bigint, kind int, blob binary")
    return written(counted.repartition(parts, "chunk").mapInArrow(lean(settle(percent)), SETS), "sets")


def verified(pairs: DataFrame, sets: DataFrame, *more: str) -> DataFrame:
    """a, b and more's columns of pairs, with both sizes and the size of the intersection."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", *more, "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("bigint").alias("both"))


def links(percent: int) -> Column:
    return F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent


def distance() -> Column:
    return 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))


def similar_sizes(a_most: Column, b_least: Column, percent: int) -> Column:
    return a_most * 100 >= b_least * percent


def least_overlap(na: Column, nb: Column, percent: int) -> Column:
    """Two sets of these sizes share at least so many elements if they link."""
    return F.ceil((na + nb) * percent / (100 + percent) - 1e-9)


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Those pairs (a, b) that aren't in one component yet."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias("in_" + c))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select(*pairs.columns)


def sampled(placed: DataFrame) -> DataFrame:
    """Two members of each cluster in each list, by hashes of their ids."""
    member = F.struct("doc", "n", "pos", "d")
    two = placed.groupBy("h", "cid").agg(*(F.min(F.struct(F.xxhash64("doc", F.lit(k)), member.alias("m"))).alias(f"m{k}") for k in range(2)))
    return two.select("h", "cid", F.explode(F.array_distinct(F.array("m0.m", "m1.m"))).alias("m")).select("h", "cid", "m.*")


def member_pairs(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """a, b, x, y: members of the clusters a and b that a list brings together, after the filters. pairs has the larger cluster as a."""
    y = pairs.join(lists.select(F.col("cid").alias("b"), "h", F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("d").alias("dy")), "b")
    x = lists.select(F.col("cid").alias("a"), "h", F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("d").alias("dx"))
    both = y.join(x, ["a", "h"]).where(F.col("apart") <= F.col("dx") + F.col("dy") + (1 - percent / 100 + 1e-9))
    both = both.where(similar_sizes(F.col("nx"), F.col("ny"), percent) & similar_sizes(F.col("ny"), F.col("nx"), percent))
    both = both.where(F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= least_overlap(F.col("nx"), F.col("ny"), percent))
    return both.select("a", "b", "x", "y")


def jaccard_components(df: DataFrame, words: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each of df's rows."""
    base = document_sets(df, words, percent, doc_id, text)
    ids = base.select("doc_id", "n", "f1", "f2")
    classes = ids.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    limit = 1 - percent / 100

    live = base.where("hs is not null")
    # By the representative's id too, so that a class of many copies is no key of many rows.
    alone = ((F.col("n") - F.size("hs")) / F.col("n")).alias("alone")
    stand = live.select("doc_id", "n", "f1", "f2", "ph", "pp", alone).join(classes.select("f1", "f2", "n", F.col("rep").alias("doc_id")), ["doc_id", "f1", "f2", "n"])
    posts = written(stand.select(F.col("doc_id").alias("doc"), "n", "alone", F.explode(F.arrays_zip("ph", "pp")).alias("p")).select(F.col("p.ph").alias("h"), "doc", "n", "alone", F.col("p.pp").alias("pos")), "posts")
    sets = live.select("doc_id", "n", "hs")

    # Each set and its leader: the set of a list with the least share of n-grams of its own, as an original among edited copies has.
    heads = posts.groupBy("h").agg(F.min(F.struct("alone", "doc", "n")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").select("h", F.col("head.doc").alias("lead"), F.col("head.n").alias("ln"))
    tried = posts.join(heads, "h").where(F.col("doc") != F.col("lead")).where(similar_sizes(F.col("n"), F.col("ln"), percent) & similar_sizes(F.col("ln"), F.col("n"), percent))
    best = tried.groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("c")).groupBy("doc").agg(F.max_by("lead", F.struct("c", -F.col("lead"))).alias("lead"))
    checked = written(verified(best.select(F.col("doc").alias("a"), F.col("lead").alias("b")), sets), "checked")
    members = checked.where(links(percent)).select(F.col("a").alias("doc"), F.col("b").alias("lead"), distance().alias("d"))
    failed = checked.where(~links(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both").distinct()

    # Pairs of clusters that a list brings together.
    placed = posts.join(members, "doc", "left").select("h", "doc", "n", "pos", F.coalesce("lead", "doc").alias("cid"), F.coalesce("d", F.lit(0.0)).alias("d"))
    listed = placed.groupBy("h", "cid").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.max("d").alias("r"))
    left, right = (listed.select("h", *(F.col(c).alias(c + side) for c in ("cid", "least", "most", "rest", "r"))) for side in "ab")
    met = left.join(right, "h").where("cida < cidb")
    met = met.where(similar_sizes(F.col("mosta"), F.col("leastb"), percent) & similar_sizes(F.col("mostb"), F.col("leasta"), percent))
    met = met.where(F.least("resta", "restb") >= least_overlap(F.col("leasta"), F.col("leastb"), percent))
    pairs = met.groupBy(F.col("cida").alias("a"), F.col("cidb").alias("b")).agg(F.max("ra").alias("ra"), F.max("rb").alias("rb")).withColumn("reach", F.col("ra") + F.col("rb") + limit)
    info = live.select("doc_id", "n", F.size("ph").alias("p"), "ranges", "after")
    side = lambda x: info.select(F.col("doc_id").alias(x), *(F.col(c).alias(c + x) for c in ("n", "p", "ranges", "after")))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    common = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: F.least(a, b)), F.lit(0), lambda s, x: s + x)
    # The set whose prefix ends first shares no more of it than either prefix holds, and of the rest what the ranges allow.
    suffix = F.least("pa", "pb") + F.greatest(common("aftera", "rangesb"), common("rangesa", "afterb"))
    bound = F.least(common("rangesa", "rangesb"), suffix)
    near = near.where(bound + 1e-6 >= (1 - F.col("reach")) / (2 - F.col("reach")) * (F.col("na") + F.col("nb"))).select("a", "b", "ra", "rb", "reach", "na", "nb")
    near = near.join(failed, ["a", "b"], "left")
    fresh = verified(near.where("both is null").select("a", "b", "ra", "rb", "reach"), sets, "ra", "rb", "reach")
    judged = written(near.where("both is not null").unionByName(fresh).select("a", "b", "ra", "rb", "reach", links(percent).alias("link"), distance().alias("d")), "judged")

    found = members.select(F.col("doc").alias("a"), F.col("lead").alias("b")).union(judged.where("link").select("a", "b"))
    comps = written(components(found), "components")

    # Clusters that may still touch: first a few of their members that share most lists, then all members that do.
    open_ = judged.where(~F.col("link") & (F.col("reach") > limit) & (F.col("d") <= F.col("reach") + 1e-9))
    swap = F.col("ra") < F.col("rb")  # the wider cluster as a
    open_ = open_.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.col("d").alias("apart"))
    before = None
    for every in (False, True):
        open_ = written(apart(open_, comps), "open")
        if open_.isEmpty():
            break
        lists = placed if every else sampled(placed)
        tried = member_pairs(open_, lists, percent)
        if not every:
            most = Window.partitionBy("a", "b").orderBy(F.desc("c"), "x", "y")
            tried = tried.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("c")).withColumn("k", F.row_number().over(most)).where(F.col("k") <= TRIES)
        tried = tried.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        tried = before = written(tried if before is None else tried.join(before, ["a", "b"], "left_anti"), "tried")
        more = written(verified(tried, sets).where(links(percent)).select("a", "b"), "more")
        if more.isEmpty():
            continue
        comps = written(components(comps.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more)), "components")

    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("comp", "rep").alias("component"), "copies")
    # At most HOT classes hold so large a share of the documents; no task gets one of them as a key.
    key = ["f1", "f2", "n"]
    large = F.col("copies") * HOT >= base.count()
    hot = F.broadcast(named.where(large).drop("copies"))
    rest = ids.join(F.broadcast(named.where(large).select(key)), key, "left_anti").join(named.where(~large).drop("copies"), key, "left")
    all_ = ids.join(hot, key).unionByName(rest)
    return all_.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """One document of each component, with all its columns: of least doc_id, those without one last.

    Each (doc_id, text) is a vertex of its own, so different texts under one doc_id are judged apart; rows that agree in both
    are one document. Documents without words link with nothing and stay.
    """
    known = documents.withColumn("__vertex", F.xxhash64("doc_id", "text"))
    own = written(jaccard_components(known, doc_id="__vertex").where("n_shingles > 0").groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("rows")), "vertices")
    named = known.select("__vertex", F.col("doc_id").alias("id")).join(own.withColumnRenamed("doc_id", "__vertex"), "__vertex")
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__vertex", "rows")).alias("best"))
    keep = written(best.select("best.__vertex", "best.rows"), "kept")
    alone = known.join(keep.where("rows = 1"), "__vertex", "left_semi")
    repeated = known.join(keep.where("rows > 1"), "__vertex", "left_semi").dropDuplicates(["__vertex"])
    empty = known.where(~has_words(F.col("text")))
    return alone.unionByName(repeated).unionByName(empty).select(*documents.columns)


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
SQL: dict[str, str] = {}
