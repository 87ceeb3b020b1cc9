"""Language identification by rank-order n-gram profiles (operator 4).

A profile is a text's most frequent character n-grams (1 to 3, within words, the word's end marked) in order of
falling count. A document's profile is compared with each language's by the out-of-place distance: the sum over the
document's n-grams of the difference of ranks, and the profile's length for an n-gram that the language lacks. The
least distance names the language; the score is 1 minus it, over the greatest possible.

Learning: from all rows given, LANGUAGES labels at most (those with most n-grams); others are never predicted.

Cases: a text that is null or has no letter is `und` with score 0, as is every text if nothing was learned; equal
counts are ranked by the n-gram's code and equal distances by the language's name, so results don't depend on order;
repeated rows get equal results; very long texts are read whole; an empty table gives an empty result; of further columns only those asked for pass.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellsift.llm.common import buffers, lean, mix, spans, table, written
from cellsift.llm.sample import fold

ORDERS = (1, 2, 3)
#: N-grams of a document's and of a language's profile.
OF_DOCUMENT, OF_LANGUAGE = 300, 1000
CHUNK = 1 << 19
#: Distinct n-grams that a partition of learning texts keeps exact counts of between two writes.
KEPT = 200_000
#: Languages that are learned at most, so that a column of dirt can't make the profiles grow without end; bits of an n-gram's code.
LANGUAGES, CODE_BITS = 256, 44


@once
def letters() -> np.ndarray:
    """Lower-case code point of each letter; 0 for what isn't a letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for k in range(sys.maxunicode + 1):
        if unicodedata.category(c := chr(k))[0] == "L":
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def grams(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of several texts (CODE_BITS of a hash), and each one's text."""
    places = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = letters()[points]
    owner = (np.searchsorted(begin, places, "right") - 1).astype(np.int32)
    # Words, each with a mark (1) after it; a word ends at a non-letter or where its text ends.
    is_letter = low > 0
    after = np.ones(len(low), bool)
    after[:-1] = ~is_letter[1:] | (owner[1:] != owner[:-1])
    ends = is_letter & after
    at = np.cumsum(is_letter.astype(np.int64) + ends) - 1
    total = int(at[-1]) + 1 if len(at) else 0
    marked, own = np.ones(total, np.uint64), np.zeros(total, np.int32)
    inside = at[is_letter] - ends[is_letter]
    marked[inside], own[inside] = low[is_letter], owner[is_letter]
    own[at[ends]] = owner[ends]
    # An n-gram must not reach over the border between two words.
    border = np.zeros(total, np.int64)
    border[at[ends]] = 1
    word = np.cumsum(border) - border
    codes, of = [], []
    for n in ORDERS:
        m = total - n + 1
        if m <= 0:
            continue
        whole = word[:m] == word[n - 1 : n - 1 + m]
        if n == 1:
            whole &= marked[:m] > 1
        key = np.full(m, n, np.uint64)
        for k in range(n):
            key = (key << np.uint64(21)) ^ (key >> np.uint64(43)) ^ marked[k : k + m]
        codes.append(mix(key[whole]) >> np.uint64(64 - CODE_BITS))
        of.append(own[:m][whole])
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(codes), np.concatenate(of)


def counted(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, code) and the count of each, in order of text and code."""
    key = np.sort((of.astype(np.uint64) << np.uint64(CODE_BITS)) | codes)  # a text and a code in one number
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    key = key[start]
    return (key >> np.uint64(CODE_BITS)).astype(np.int64), key & np.uint64((1 << CODE_BITS) - 1), np.diff(np.append(start, len(new)))


def learn(df: DataFrame, text: str, label: str, length: int = OF_LANGUAGE) -> list[tuple[str, np.ndarray]]:
    """Each label's profile, best first: counts over all rows whose label isn't null. Profiles have a bounded length, and so has their number: LANGUAGES, those with most n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                code, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], names=["label", "code", "n"])
            held.clear()

        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            data, offsets = buffers(batch.column(1))
            for i, j in spans(offsets, CHUNK):
                codes, of = grams(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
                for name in sorted(set(names[i:j])):
                    own = codes[(names[i:j] == name)[of]]
                    held.setdefault(name, []).append(np.unique(own, return_counts=True))
                    if len(held[name]) >= 16:
                        held[name] = [merged(held[name])]
            if sum(len(c) for parts in held.values() for c, _ in parts) > KEPT:
                for name in held:
                    held[name] = [merged(held[name])]
                if sum(len(c) for parts in held.values() for c, _ in parts) > KEPT:
                    yield from out()
        yield from out()

    counts = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string"), F.col(text).cast("string")).mapInArrow(lean(run), "label string, code bigint, n bigint")
    total = written(counts.groupBy("label", "code").agg(F.sum("n").alias("n")), "grams")
    most = total.groupBy("label").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "label").limit(LANGUAGES).select("label")
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "code"))
    best = total.join(F.broadcast(most), "label").withColumn("place", place).where(F.col("place") <= length).select("label", "place", "code").collect()
    profiles: dict[str, list[tuple[int, int]]] = {}
    for r in best:
        profiles.setdefault(r.label, []).append((r.place, r.code))
    return [(name, np.array([code for _, code in sorted(profiles[name])], np.uint64)) for name in sorted(profiles)]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(code)).astype(np.int64)


class Profiles:
    """Ranks of the languages' n-grams, one row a code."""

    def __init__(self, profiles: list[tuple[str, np.ndarray]], length: int = OF_LANGUAGE):
        self.names = [name for name, _ in profiles]
        self.length = length
        self.codes = np.unique(np.concatenate([c for _, c in profiles] or [np.zeros(0, np.uint64)]))
        self.ranks = np.full((len(self.codes) + 1, len(profiles)), -1, np.int16)
        for k, (_, code) in enumerate(profiles):
            self.ranks[np.searchsorted(self.codes, code), k] = np.arange(len(code))

    def predict(self, column: pa.Array, top: int = OF_DOCUMENT) -> tuple[list[str], np.ndarray]:
        data, offsets = buffers(column)
        named, score = ["und"] * len(column), np.zeros(len(column))
        if not self.names:
            return named, score
        for i, j in spans(offsets, CHUNK):
            of, codes, n = counted(*grams(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i]))
            if not len(of):
                continue
            order = np.argsort((of << 40) | ((1 << 40) - 1 - n), kind="stable")  # equal counts stay in order of codes
            of, codes = of[order], codes[order]
            start = np.searchsorted(of, np.arange(j - i))
            rank = np.arange(len(of)) - start[of]
            best = rank < top
            of, codes, rank = of[best], codes[best], rank[best]
            at = np.searchsorted(self.codes, codes)
            known = (at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == codes) if len(self.codes) else np.zeros(len(at), bool)
            theirs = self.ranks[np.where(known, at, len(self.codes))]
            out = np.where(theirs < 0, self.length, np.abs(theirs - rank[:, None].astype(np.int32)))
            size = np.bincount(of, minlength=j - i)
            far = np.stack([np.bincount(of, out[:, k], j - i) for k in range(len(self.names))], 1)
            least = far.argmin(1)
            for d in np.flatnonzero(size):
                named[i + d] = self.names[least[d]]
            has = size > 0
            score[i:j][has] = 1 - far[has, least[has]] / (size[has] * self.length)
        return named, np.clip(score, 0.0, 1.0)


def identify(df: DataFrame, profiles: list[tuple[str, np.ndarray]], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred and score."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(Profiles(profiles))  # of a bounded size: so many codes for each language
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, score = sent.value.predict(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(named, pa.string()), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return df.select(*(df[c] for c in keep), df[text].cast("string").alias("__text")).mapInArrow(lean(run), schema)


def op4_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    profiles = learn(documents.where(~held_out), "text", "lang")
    found = identify(documents, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_rank_order": op4_rank_order}
SQL: dict[str, str] = {}
