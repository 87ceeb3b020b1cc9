"""Benchmark decontamination by templates (operator 6).

A text becomes a row of tokens: words in lower case, and typed placeholders for numbers (digits and number words), for
names (a capitalised word that isn't a function word, wherever it stands) and for units (a unit's word after a number).
Names, and numbers, that follow each other with only blanks between are one placeholder, so "Tom" meets "Tom Brown". Windows
of LENGTH template tokens are hashed and joined with those of the benchmark, so a question with other numbers and names
still meets its original. What the placeholders stood for decides: along one alignment each value of the item must always
stand for the same value of the document, and names and units the other way round too; alignments that break this are
dropped. Beside the template each window is hashed as it is, in lower case and without placeholders, so that an exact copy
is found whatever its tokens' types and however few of them are words. A pair is reported if the windows that remain cover
TOKENS tokens of the item or SHARE of it; it is `exact` if windows with equal values cover as much, else `reparameterised`.

Workers send only windows whose hash is in a bitmap of the benchmark's, of a bounded size however large the benchmark; the
join itself is by hash, for any size.

Cases: null and empty texts have no windows; an item shorter than a window has one window, all its tokens; a window with
fewer than LITERALS words that aren't placeholders is searched for as it is only, without other values; repeated documents each get their
pairs (rows that share a doc_id get them once); repeated items each get theirs; an empty table gives an empty result;
very long texts are read whole; rows without an id are left out of the pairs, but `clean` judges each row by its text, with an id
or without; further columns don't pass (`clean` passes all).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache as once

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.llm.common import buffers, lean, mix, spans, table, written
from cellsift.llm.langid import letters
from cellsift.llm.quality import DIGIT, LOWER, SPACE, UPPER, kinds

LENGTH, LITERALS, TOKENS, SHARE = 8, 4, 12, 0.6
#: Bits of a hash that the bitmap looks at: at least and at most, and slots for each window between.
FEWEST_BITS, MOST_BITS, SLOTS = 16, 28, 32
SPAN = 1 << 19
WORD, NUMBER, NAME, UNIT = range(4)
# Words that begin sentences without being names, number words, names of units.
FUNCTION_WORDS = (
    "a about after all although an and any are as assume at because before both but by calculate can compute could describe did do does during each estimate evaluate every explain find finally first for from given "
    "had has have he her here his how i if in into is it its let list many may more most my name next no not now of on once one only or other our over prove select she should show simplify since so solve some suppose than that the their then there "
    "these they this those through to under until was we were what when where whether which while who whom whose why will with without would write you your "
    "das dem den der des die ein eine es er ist sie und was welche wer wie wo le la les un une des et est il elle que qui quel quelle comment où el los las una y es cuál qué quién cómo dónde"
).split()
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen "
    "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig hundert tausend deux trois quatre cinq sept huit neuf dix onze douze vingt cent mille dos tres cuatro cinco seis siete ocho nueve diez once doce veinte cien mil"
).split()
UNITS = (
    "m cm mm km nm um ft feet foot inch inches yard yards mile miles g kg mg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds ounce ounces oz l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent degree degrees celsius fahrenheit kelvin dollar dollars euro euros cent cents hz khz mhz ghz w kw kwh mw joule joules watt watts volt volts amp amps byte bytes kb mb gb tb bit bits kph mph pascal bar acre acres hectare hectares "
    "meter kilometer gramm stunde stunden tag tage woche wochen monat monate jahr jahre prozent grad mètre mètres kilomètre kilomètres heure heures jour jours semaine semaines mois an ans metro metros kilómetro kilómetros hora horas minuto minutos día días semana semanas mes meses año años"
).split()


def hashed(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice."""
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(points), np.uint64(0x9E3779B97F4A7C15))]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(points), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))]))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(points.astype(np.uint64)) * up[:-1])])
    return mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


@once
def listed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the function words, number words and units."""
    one = lambda w: hashed(np.array([ord(c) for c in w]), np.array([0]), np.array([len(w)]))[0]
    return tuple(np.array([one(w) for w in words], np.uint64) for words in (FUNCTION_WORDS, NUMBERS, UNITS))


class Tokens:
    """Type, value and text of each token of several texts, and the template: the same with runs of names and of numbers as one."""

    def __init__(self, data: np.ndarray, begin: np.ndarray):
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        of = np.searchsorted(begin, np.flatnonzero((data & 0xC0) != 0x80), "right") - 1
        kind = kinds()[points].copy()
        n = len(points)
        if n > 2:  # a point or comma between digits belongs to the number
            inner = np.flatnonzero(((points[1:-1] == 46) | (points[1:-1] == 44)) & (kind[:-2] == DIGIT) & (kind[2:] == DIGIT) & (of[:-2] == of[2:])) + 1
            kind[inner] = DIGIT
        group = np.where((kind == LOWER) | (kind == UPPER), 1, np.where(kind == DIGIT, 2, 0))
        change = np.ones(n + 1, bool)
        change[1:-1] = (group[1:] != group[:-1]) | (of[1:] != of[:-1])
        edges = np.flatnonzero(change)
        starts, ends = edges[:-1], edges[1:]
        keep = group[starts] > 0
        starts, ends = starts[keep], ends[keep]
        low = np.where(letters()[points] > 0, letters()[points], points)
        self.value, self.of = hashed(low, starts, ends), of[starts]
        functions, numbers, units = listed()
        word = group[starts] == 1
        self.kind = np.where(word & ~np.isin(self.value, numbers), WORD, NUMBER)
        second = np.minimum(starts + 1, max(n - 1, 0))
        capital = (kind[starts] == UPPER) & (ends - starts > 1) & (kind[second] == LOWER)
        self.kind[(self.kind == WORD) & capital & ~np.isin(self.value, functions)] = NAME
        after_number = np.zeros(len(word), bool)
        after_number[1:] = (self.kind[:-1] == NUMBER) & (self.of[1:] == self.of[:-1])
        self.kind[word & after_number & (self.kind != NUMBER) & np.isin(self.value, units)] = UNIT
        # A token goes with the one before it if both are names with blanks between, or numbers with blanks or hyphens.
        other = np.concatenate([[0], np.cumsum(kind != SPACE)])
        sign = np.concatenate([[0], np.cumsum((kind != SPACE) & (points != 45))])
        joined = np.zeros(len(word), bool)
        same = (self.kind[1:] == self.kind[:-1]) & (self.of[1:] == self.of[:-1]) & (starts[1:] > ends[:-1])
        joined[1:] = same & ((self.kind[1:] == NAME) & (other[starts[1:]] == other[ends[:-1]]) | (self.kind[1:] == NUMBER) & (sign[starts[1:]] == sign[ends[:-1]]))
        #: First token of each of the template's, and the one after its last.
        self.first = np.flatnonzero(~joined)
        self.last = np.append(self.first[1:], len(word)) if len(word) else self.first
        place = np.arange(len(word)) - np.repeat(self.first, self.last - self.first)
        self.run_value = np.add.reduceat(mix(self.value + place.astype(np.uint64)), self.first) if len(word) else self.value
        self.run_value = np.where(self.kind[self.first] == WORD, self.value[self.first], self.run_value)

    def stream(self, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Type, value and text of the tokens as they are, or of the template's."""
        return (self.kind, self.value, self.of) if plain else (self.kind[self.first], self.run_value, self.of[self.first])


def windows(token: np.ndarray, value: np.ndarray, of: np.ndarray, length: int, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of each window of so many tokens of one text: plain ones of the tokens themselves, else those with enough words that aren't placeholders."""
    m = len(token) - length + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = value if plain else np.where(token == WORD, value, token.astype(np.uint64))
    h = np.full(m, length + plain * (1 << 32), np.uint64)
    for k in range(length):
        h = h * np.uint64(0xD1342543DE82EF95) + code[k : k + m]
    good = of[:m] == of[length - 1 :]
    if not plain:
        literal = np.concatenate([[0], np.cumsum(token == WORD)])
        count = literal[length:] - literal[:m]
        good &= (count >= min(LITERALS, length)) & (count < length)  # without a placeholder it is what a plain one is
    good = np.flatnonzero(good)
    return good, mix(h[good])


def slots(token: np.ndarray, value: np.ndarray, first: np.ndarray, length: int, plain: bool) -> tuple[list, list]:
    """Types and values of the placeholders of each window; a plain one has none."""
    if plain:
        return [[]] * len(first), [[]] * len(first)
    types, values = [], []
    for a in first.tolist():
        own = token[a : a + length]
        at = np.flatnonzero(own != WORD)
        types.append(own[at].tolist())
        values.append(value[a : a + length][at].astype(np.int64).tolist())
    return types, values


def item_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """h, item_id, at, length, begin, upto, size, plain, types, values: the windows of each item; begin and upto in tokens as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            data, offsets = buffers(b.column(1))
            for k, item in enumerate(b.column(0).to_pylist()):
                t = Tokens(data[offsets[k] : offsets[k + 1]], np.zeros(1, np.int64))
                size = len(t.value)
                for plain in (False, True) if size else ():
                    token, value, of = t.stream(plain)
                    length = min(LENGTH, len(token))
                    first, h = windows(token, value, of, length, plain)
                    begin, upto = (first, first + length) if plain else (t.first[first], t.last[first + length - 1])
                    for row in zip(h.astype(np.int64).tolist(), [item] * len(h), first.tolist(), [length] * len(h), begin.tolist(), upto.tolist(), [size] * len(h), [plain] * len(h), *slots(token, value, first, length, plain), strict=True):
                        rows.append(row)
            kinds_ = [pa.int64(), b.column(0).type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds_)], names=["h", "item_id", "at", "length", "begin", "upto", "size", "plain", "item_types", "item_values"])

    schema = "h bigint, item_id bigint, at bigint, length int, begin bigint, upto bigint, size bigint, plain boolean, item_types array<int>, item_values array<bigint>"
    narrow = benchmark.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null")
    return written(narrow.mapInArrow(lean(run), schema), "items")


class Bitmap:
    """Which hashes may be among the windows'; of a bounded size."""

    def __init__(self, windows_: int):
        self.width = min(MOST_BITS, max(FEWEST_BITS, int(windows_ * SLOTS).bit_length()))
        self.bits = np.zeros(1 << (self.width - 3), np.uint8)

    def place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = h >> np.uint64(64 - self.width)
        return (top >> np.uint64(3)).astype(np.int64), np.uint8(1) << (top & np.uint64(7)).astype(np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        byte, bit = self.place(h)
        return self.bits[byte] & bit > 0


def bitmap(items: DataFrame) -> Bitmap:
    out = Bitmap(items.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            byte, bit = out.place(np.array(b.column(0), np.int64).view(np.uint64))
            np.bitwise_or.at(out.bits, byte, bit)
        yield pa.RecordBatch.from_arrays([pa.array([out.bits.tobytes()], pa.binary())], names=["bits"])

    merged = Bitmap(0)
    merged.width, merged.bits = out.width, out.bits.copy()
    for p in items.select("h").coalesce(2).mapInArrow(lean(run), "bits binary").toLocalIterator():
        merged.bits |= np.frombuffer(p.bits, np.uint8)
    return merged


def document_windows(documents: DataFrame, lengths: list[tuple[int, bool]], bits: Bitmap, doc_id: str, text: str) -> DataFrame:
    """h, doc_id, place, length, plain, types, values of the windows whose hash the bitmap has."""
    sent = documents.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            ids = np.array(b.column(0), np.int64)
            data, offsets = buffers(b.column(1))
            for i, j in spans(offsets, SPAN):
                t = Tokens(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
                for length, plain in lengths:
                    token, value, of = t.stream(plain)
                    first, h = windows(token, value, of, length, plain)
                    hit = known.has(h)
                    first, h = first[hit], h[hit]
                    if not len(first):
                        continue
                    types, values = slots(token, value, first, length, plain)
                    start = np.searchsorted(of, of[first])
                    same = [pa.array(np.full(len(first), length, np.int32)), pa.array(np.full(len(first), plain))]
                    yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(ids[i:j][of[first]]), pa.array(first - start), *same, pa.array(types, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))], names=["h", "doc_id", "place", "length", "plain", "types", "values"])

    narrow = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    return narrow.mapInArrow(lean(run), "h bigint, doc_id bigint, place bigint, length int, plain boolean, types array<int>, values array<bigint>")


def covered(ranges):
    """Tokens within ranges of begin and upto."""
    zero = F.lit(0).cast("bigint")
    more = lambda s, r: F.struct(F.greatest(s["last"], r["upto"]).alias("last"), (s["n"] + F.greatest(zero, r["upto"] - F.greatest(s["last"], r["begin"]))).alias("n"))
    return F.aggregate(F.sort_array(ranges), F.struct(zero.alias("last"), zero.alias("n")), more, lambda s: s["n"])


def leaks(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", tokens_: int = TOKENS, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, covered, item_tokens, kind: pairs of a document and a benchmark item that it holds."""
    items = item_windows(benchmark, item_id, item_text)
    lengths = sorted((r[0], r[1]) for r in items.select("length", "plain").distinct().collect())  # at most LENGTH of either kind
    hits = document_windows(documents, lengths, bitmap(items), doc_id, text)
    met = hits.join(items, ["h", "length", "plain"]).where(F.col("types") == F.col("item_types"))
    pair = F.transform(F.arrays_zip("types", "item_values", "values"), lambda z: F.struct(z["types"].alias("t"), z["item_values"].alias("a"), z["values"].alias("b")))
    along = met.groupBy("doc_id", "item_id", "size", "length", "plain", (F.col("place") - F.col("at")).alias("shift")).agg(F.collect_set(F.struct("begin", "upto")).alias("ranges"), F.array_distinct(F.flatten(F.collect_set(pair))).alias("pairs"))
    forth = F.size(F.array_distinct(F.transform("pairs", lambda z: F.struct(z["t"], z["a"]))))
    named = F.filter("pairs", lambda z: z["t"] != NUMBER)
    back = F.size(F.array_distinct(F.transform(named, lambda z: F.struct(z["t"], z["b"]))))
    consistent = along.where((forth == F.size("pairs")) & (back == F.size(named)))
    same = F.forall("pairs", lambda z: z["a"] == z["b"])
    of_same = F.when(same, F.col("ranges")).otherwise(F.array().cast("array<struct<begin:bigint,upto:bigint>>"))
    whole = consistent.groupBy("doc_id", "item_id", "size").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.flatten(F.collect_list(of_same)).alias("equal"))
    enough = lambda n: (n >= tokens_) | (n >= F.col("item_tokens") * share)
    out = whole.select("doc_id", "item_id", covered(F.col("ranges")).alias("covered"), F.col("size").alias("item_tokens"), covered(F.col("equal")).alias("equal"))
    return out.where(enough(F.col("covered"))).withColumn("kind", F.when(F.col("equal") == F.col("covered"), "exact").otherwise("reparameterised")).drop("equal")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a benchmark item. Each row is judged by its text, whatever its doc_id."""
    known = documents.withColumn("__text", F.xxhash64("text"))
    found = leaks(known.select("__text", "text"), benchmark, "__text").select(F.col("doc_id").alias("__text")).distinct()
    return known.join(found, "__text", "left_anti").select(*documents.columns)


def op6_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op6_templates": op6_templates}
SQL: dict[str, str] = {}
