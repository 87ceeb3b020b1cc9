"""Byte-level BPE encoding and decoding without a regular expression (operator 10).

A table gives each code point its class; with the next code point it becomes one of nine symbols. Each symbol is a
transition function over the states of the splitting automaton. Functions compose associatively, so a blocked scan finds
the state before every code point of a whole batch of texts at once, and state and symbol say whether a piece begins
there. The pieces are byte slices; a cache holds the ids of each, and those it lacks are merged together, a matrix
row each. Token offsets are the running lengths of the tokens, so decoding can go back to any part of a text.

Classes are those of Unicode 16, which the library's patterns use: this Python's tables where they are of 15.0 or 15.1, and
what came after them by range. So results don't depend on a worker's Python; one with later tables is refused.

Cases: a null text counts as empty and has no ids; repeated rows and equal ids give equal rows; an empty table gives an
empty result; other columns pass untouched unless they have a name of the result, in which case the result's column wins.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellsift.llm.common import buffers, lean, spans, table

# The white space of Unicode (White_Space).
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 15.1 (the first range) and 16.0 added, first and last code point.
NEW_LETTERS = [
    (0x2EBF0, 0x2EE5D), (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Symbols. W: white space; G, X: a space and any other white space right before something else; H2, H3: the apostrophe of a contraction of so many code points.
L, N, O, W, G, X, H2, H3 = range(8)
#: States: what the open piece consists of. C1, C2: so many letters of a contraction are still to come. D: nothing is open.
SL, SN, SO, SW, SG, SX, C1, C2, D = range(9)
CHUNK = 1 << 18
CACHED = 200_000
SHORT = 32


@once
def classes() -> np.ndarray:
    if unicodedata.unidata_version not in ("15.0.0", "15.1.0", "16.0.0"):
        raise RuntimeError(f"token classes are of Unicode 16.0, this Python has {unicodedata.unidata_version}")
    kinds = np.full(sys.maxunicode + 1, O, np.uint8)
    for k in range(sys.maxunicode + 1):
        c = unicodedata.category(chr(k))[0]
        if c == "L":
            kinds[k] = L
        elif c == "N":
            kinds[k] = N
    for kind, ranges in ((L, NEW_LETTERS), (N, NEW_NUMBERS)):
        for first, last in ranges:
            kinds[first : last + 1] = kind
    kinds[WHITE_SPACE] = W
    return kinds


@once
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code of each symbol's function, codes of composed functions, state after each function from each state, and whether a piece begins at a symbol in a state."""
    step = np.empty((8, 9), np.uint8)
    for symbol, state in ((L, SL), (N, SN), (O, SO), (W, SW), (G, SG), (X, SX), (H2, C1), (H3, C2)):
        step[symbol] = state
    step[L, C2], step[L, C1] = C1, D
    step[H2, [SO, SG]] = step[H3, [SO, SG]] = SO
    functions = {tuple(range(9)): 0}
    for f in step.tolist():
        functions.setdefault(tuple(f), len(functions))
    todo = list(functions)
    while todo:
        f = todo.pop()
        for g in list(functions):
            for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                if h not in functions:
                    functions[h] = len(functions)
                    todo.append(h)
    assert len(functions) < 256
    every = np.array(list(functions), np.uint8)
    compose = np.array([[functions[tuple(g[f])] for g in every] for f in every], np.uint8)
    begins = np.ones((9, 8), bool)
    begins[[SL, SG, C1, C2], L] = begins[[SN, SG], N] = begins[SW, W] = False
    for symbol in (O, H2, H3):
        begins[[SO, SG], symbol] = False
    return np.array([functions[tuple(f)] for f in step.tolist()], np.uint8), compose, every, begins


def states_before(functions: np.ndarray, compose: np.ndarray, every: np.ndarray) -> np.ndarray:
    """The state before each position, D before the first: a scan within blocks, all blocks at a time, then over the blocks' totals."""
    n = len(functions)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.uint8)
    padded[:n] = functions
    block = np.ascontiguousarray(padded.reshape(rows, width).T)
    flat, k = compose.ravel(), len(compose)
    for j in range(1, width):
        block[j] = flat[block[j - 1].astype(np.int32) * k + block[j]]
    heads = np.empty(rows, np.uint8)
    state = D
    for r, total in enumerate(block[-1].tolist()):
        heads[r] = state
        state = every[total, state]
    after = every.ravel()[block.astype(np.int32) * 9 + heads]
    return np.concatenate([[np.uint8(D)], after.T.ravel()[: n - 1]])


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin. points: the code points of several texts; first: where a text begins."""
    if not len(points):
        return np.zeros(0, bool)
    symbols = classes()[points]
    white = symbols == W
    follows = np.zeros(len(points), bool)  # by something that isn't white space, in the same text
    follows[:-1] = ~white[1:] & ~first[1:]
    symbols[white & follows] = X
    symbols[(points == 0x20) & follows] = G
    heads = np.flatnonzero(points == 0x27)
    if len(heads):
        ahead = np.concatenate([points, [0, 0]])
        last = np.concatenate([first, [True, True]])
        one, two, ends1, ends2 = ahead[heads + 1], ahead[heads + 2], last[heads + 1], last[heads + 2]
        pair = lambda a, b: (one == ord(a)) & (two == ord(b))
        symbols[heads[~ends1 & np.isin(one, [ord(c) for c in "stmd"])]] = H2
        symbols[heads[~ends1 & ~ends2 & (pair("r", "e") | pair("v", "e") | pair("l", "l"))]] = H3
    function, compose, every, begins = automaton()
    functions = function[symbols]
    # At the start of a text the state is D, whatever came before: the function from there on is constant.
    lead = np.flatnonzero(first)
    constant = {s: int(np.flatnonzero((every == s).all(1))[0]) for s in {int(x) for x in every[functions[lead], D]}}
    functions[lead] = [constant[int(x)] for x in every[functions[lead], D]]
    return begins[states_before(functions, compose, every), symbols] | first


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class ByteBPE:
    """Encoder and decoder of one rank file. Pairs that merge are found in a table with open addressing."""

    FACTOR = np.int64(0x9E3779B97F4A7C15 - (1 << 64))

    def __init__(self, data: bytes):
        self.ranks = read_ranks(data)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.none = np.int32(len(self.tokens))
        self.first = np.array([[self.ranks.get(bytes([a, b]), self.none) for b in range(256)] for a in range(256)], np.int32)
        pairs = {self.ranks[a] * len(self.tokens) + self.ranks[b]: rank for token, rank in self.ranks.items() for k in range(1, len(token)) if (a := token[:k]) in self.ranks and (b := token[k:]) in self.ranks}
        self.slots, self.values = np.full(1 << (4 * len(pairs)).bit_length(), -1, np.int64), np.zeros(1 << (4 * len(pairs)).bit_length(), np.int32)
        keys, values = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        slot = self.place(keys)
        while len(keys):
            free = self.slots[slot] < 0
            taken, which = np.unique(slot[free], return_index=True)
            self.slots[taken], self.values[taken] = keys[free][which], values[free][which]
            rest = self.slots[slot] != keys
            keys, values, slot = keys[rest], values[rest], slot[rest]
            slot = np.where(self.slots[slot] >= 0, slot + 1 & (len(self.slots) - 1), slot)
        self.old: dict[bytes, bytes] = {}
        self.cache: dict[bytes, bytes] = {b"": b""}

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.FACTOR >> 20) & (len(self.slots) - 1)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; none where there is no such merge. Ids under 0 stand for nothing."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * len(self.tokens) + b, -1)
        slot = self.place(key)
        found = np.full(len(key), self.none, np.int32)
        todo = np.flatnonzero(key >= 0)
        while len(todo):
            there = self.slots[slot[todo]]
            hit = there == key[todo]
            found[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
            slot[todo] = slot[todo] + 1 & (len(self.slots) - 1)
        return found

    def merge_short(self, pieces: list[bytes]) -> Iterator[bytes]:
        """All pieces at once, a row each; every step merges each row's first pair of least rank."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(length.max())
        column = np.arange(width + 1)
        filled = column < length[:, None]
        raw = np.zeros((len(pieces), width + 1), np.uint8)
        raw[filled] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(filled, self.single[raw], np.int32(-1))
        rank = np.where(filled[:, 1:], self.first[raw[:, :-1], raw[:, 1:]], self.none)
        done, rows = ids.copy(), np.arange(len(pieces))
        while True:
            at = rank.argmin(1)
            least = rank[np.arange(len(rows)), at]
            live = least < self.none
            if not live.all():
                done[rows[~live], : ids.shape[1]] = ids[~live]
                done[rows[~live], ids.shape[1] :] = -1
                rows, ids, rank, at, least = rows[live], ids[live], rank[live], at[live], least[live]
            if not len(rows):
                break
            each, place = np.arange(len(rows)), column[: ids.shape[1] - 1]
            ids[each, at] = least
            kept = place + (place > at[:, None])
            kept += (each * ids.shape[1])[:, None]
            ids = ids.ravel()[kept]  # one column less: what stood after the pair moves to the left
            last = rank.shape[1] - 1
            kept = place[:last] + (place[:last] > at[:, None])
            rank = rank.ravel()[kept + (each * (last + 1))[:, None]]
            ahead = at < last
            rank[each[ahead], at[ahead]] = self.pair_ranks(ids[each[ahead], at[ahead]], ids[each[ahead], at[ahead] + 1])
            before = at > 0
            rank[each[before], at[before] - 1] = self.pair_ranks(ids[each[before], at[before] - 1], ids[each[before], at[before]])
            if not rank.shape[1]:
                rank = np.full((len(rows), 1), self.none, np.int32)
                ids = np.concatenate([ids, np.full((len(rows), 1), -1, np.int32)], 1)
        some = done >= 0
        packed, ends = done[some].astype("<u4").tobytes(), (np.cumsum(some.sum(1)) * 4).tolist()
        return (packed[a:b] for a, b in zip([0, *ends], ends, strict=False))

    def merge_long(self, piece: bytes) -> bytes:
        """One piece by a heap of its pairs, for pieces whose rows would be wide."""
        n = len(piece)
        ids, left, right = self.single[np.frombuffer(piece, np.uint8)].tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        text, ranks = [self.tokens[i] for i in ids], self.ranks
        heap = [(r, k, k + 1, 1, 1) for k in range(n - 1) if (r := ranks.get(text[k] + text[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, a, b, la, lb = heapq.heappop(heap)
            if right[a] != b or ids[a] < 0 or len(text[a]) != la or b >= n or len(text[b]) != lb:
                continue
            text[a], ids[a], ids[b] = text[a] + text[b], r, -1
            right[a] = c = right[b]
            if c < n:
                left[c] = a
                if (s := ranks.get(text[a] + text[c])) is not None:
                    heapq.heappush(heap, (s, a, c, len(text[a]), len(text[c])))
            if (z := left[a]) >= 0 and (s := ranks.get(text[z] + text[a])) is not None:
                heapq.heappush(heap, (s, z, a, len(text[z]), len(text[a])))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def learn(self, pieces: Iterable[bytes]) -> None:
        """Put what the cache lacks into it."""
        short: list[bytes] = []
        for p in pieces:
            if (rank := self.ranks.get(p)) is not None:
                self.cache[p] = rank.to_bytes(4, "little")
            elif len(p) > SHORT:
                self.cache[p] = self.merge_long(p)
            else:
                short.append(p)
        short.sort(key=len)
        for k in range(0, len(short), 8192):
            part = short[k : k + 8192]
            self.cache.update(zip(part, self.merge_short(part), strict=True))

    def encode(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        data, offsets = buffers(column)
        for i, j in spans(offsets, CHUNK):
            part = data[offsets[i] : offsets[j]]
            raw, begin = part.tobytes(), (offsets[i : j + 1] - offsets[i])
            filled = begin[:-1][begin[1:] > begin[:-1]]
            if raw.isascii():
                places, points = None, part
                first = np.zeros(len(points), bool)
                first[filled] = True
            else:
                places = np.flatnonzero((part & 0xC0) != 0x80)
                points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
                first = np.zeros(len(points), bool)
                first[np.searchsorted(places, filled)] = True
            starts = np.flatnonzero(piece_starts(points, first))
            starts = starts if places is None else places[starts]
            edges = [*starts.tolist(), len(raw)]
            pieces = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            if len(self.cache) > CACHED:  # what was used since the last time stays findable until the next
                self.old, self.cache = self.cache, {}
            new = set(pieces).difference(self.cache)
            if known := new & self.old.keys():
                self.cache.update(zip(known, map(self.old.__getitem__, known), strict=True))
                new -= known
            self.learn(new)
            found = list(map(self.cache.__getitem__, pieces))
            cut = np.searchsorted(starts, begin).tolist()
            for a, b in zip(cut, cut[1:], strict=False):
                yield b"".join(found[a:b])

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text."""
        length = self.lengths[ids]
        return np.cumsum(length) - length


@once
def encoder(data: bytes) -> ByteBPE:
    return ByteBPE(data)


def rank_bytes(spark: SparkSession, path: str):
    """The rank file, read by the driver and sent to the executors; a vocabulary has a fixed size."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _with(df: DataFrame, text: str, fields: list[tuple[str, pa.DataType, str]], work, ranks, keep: list[str]) -> DataFrame:
    """keep's columns and those that work(encoder, ids) gives for each row."""
    keep = [c for c in keep if c not in {name for name, _, _ in fields}]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{name} {kind}" for name, _, kind in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rows = [work(bpe, np.frombuffer(ids, "<u4")) for ids in bpe.encode(part.column(part.num_columns - 1))]
                made = [pa.array([r[i] for r in rows], kind) for i, (_, kind, _) in enumerate(fields)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *made], names=[*keep, *(name for name, _, _ in fields)])

    return df.select(*(df[f"`{c}`"] for c in keep), df[text].cast("string").alias("__text")).mapInArrow(lean(run), schema)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with token_ids and token_offsets (bytes into the text's UTF-8). Columns of those names are replaced."""
    fields = [("token_ids", pa.list_(pa.int32()), "array<int>"), ("token_offsets", pa.list_(pa.int64()), "array<bigint>")]
    return _with(df, text, fields, lambda bpe, ids: (ids.astype(np.int32), bpe.offsets(ids)), rank_bytes(df.sparkSession, path), df.columns)


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """df with decoded, the bytes of the ids; null for null ids."""
    ranks = rank_bytes(df.sparkSession, path)
    keep = [c for c in df.columns if c != "decoded"]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks.value)
        for batch in batches:
            made = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=[*keep, "decoded"])

    return df.select(*(df[f"`{c}`"] for c in keep), df[ids].alias("__ids")).mapInArrow(lean(run), schema)


def digests(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep's columns (doc_id) and n_tokens, ids_sha256, decoded_sha256: what encode and decode give, as digests, without the ids leaving the worker."""

    def work(bpe: ByteBPE, ids: np.ndarray) -> tuple[int, str, str]:
        return len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

    fields = [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return _with(df, text, fields, work, rank_bytes(df.sparkSession, path), keep or ["doc_id"])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
SQL: dict[str, str] = {}
