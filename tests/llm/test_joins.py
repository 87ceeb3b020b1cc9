"""Near-duplicate texts and vectors, leaks and components against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest

from cellsift.llm import decontaminate, ngram_join, polytope
from cellsift.llm.components import components
from tests.llm import brute
from tests.llm.brute import jaccard_components, roots


def corpus(seed, n=500):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 6, 20, 60, 150]))] for _ in range(8)]
    shared = [rng.choice(words) for _ in range(30)]
    docs = []
    for k in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.3:
            text = shared + text
        docs.append((k, None if rng.random() < 0.03 else "" if rng.random() < 0.03 else rng.choice([" ", "\t", "\n "]).join(text)))
    return docs


def test_ngram_join_finds_the_components(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK_HASHES", 3000)
    monkeypatch.setattr(ngram_join, "COMMON", 4)
    docs = [*corpus(1), (900, "Ä B c d e f"), (901, "Ä b C D e f"), (902, "ä b c d e f"), (903, "x " * 30000)]
    spark.createDataFrame([(*d, "other") for d in docs], "doc_id long, text string, component_id string").repartition(3).write.parquet(str(tmp_path / "d"))
    got = ngram_join.jaccard_components(spark.read.parquet(str(tmp_path / "d")))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == jaccard_components(docs)


def test_ngram_join_with_repeated_rows_and_no_rows(spark, tmp_path):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (None, "zz"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(df).collect()), key=key)
    assert got == sorted([(5, 2, 3), (5, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 0, 9)], key=key)
    assert ngram_join.jaccard_components(df.where("doc_id = 77")).count() == 0
    kept = ngram_join.one_of_each(df)
    assert sorted((tuple(r) for r in kept.collect()), key=key) == sorted([rows[2], rows[4], rows[5]], key=key)


def test_one_of_each_judges_texts_not_ids(spark, tmp_path):
    rows = [(1, "a b c d e f g", 1), (1, "totally other words stand here now", 2), (1, "a b c d e f g", 3), (2, "a b c d e f g", 4), (3, "", 5), (3, "", 6), (None, " \t", 7), (None, None, 8), (0, "totally other words stand here now", 9), (None, "only this one has no id", 10)]
    spark.createDataFrame(rows, "doc_id long, text string, rows long").repartition(3).write.parquet(str(tmp_path / "d"))
    kept = ngram_join.one_of_each(spark.read.parquet(str(tmp_path / "d")))
    got = sorted(r.rows for r in kept.collect())
    assert kept.columns == ["doc_id", "text", "rows"] and got in ([1, 5, 6, 7, 8, 9, 10], [3, 5, 6, 7, 8, 9, 10])
    assert ngram_join.one_of_each(kept.where("false")).count() == 0


@pytest.mark.parametrize("block", [2048, 40])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(polytope, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    x = [base[rng.integers(60)] * rng.uniform(0.5, 2) + rng.standard_normal(24) * 0.12 for _ in range(250)] + [base[0] + rng.standard_normal(24) * 0.05 for _ in range(120)]
    rows = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(x)]
    odd = [(400, None), (401, [0.0] * 24), (402, [float("nan"), *[1.0] * 23]), (403, [None, *[1.0] * 23]), (404, [float("inf")] * 24), (405, [1.0]), (406, rows[0][1]), (407, rows[0][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in polytope.near_duplicates(df).collect()}
    good = [*rows, odd[6], odd[7]]
    m = np.array([v for _, v in good], np.float64)
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.95
    ids = [k for k, _ in good]
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    links = {k: 0 for k in ids}
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    comp = roots(ids, pairs)
    assert sum(got[k].n_links for k in ids) >= 0.97 * sum(links.values())
    assert all(got[k].n_links <= links[k] for k in ids)
    assert sum(got[k].component_id == comp[k] for k in ids) >= 0.97 * len(ids)
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in range(400, 406))
    assert polytope.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("d", [8, 24, 64, 384])
@pytest.mark.parametrize("n", [10**4, 10**6, 10**9])
def test_recall_does_not_fall_with_the_number_of_vectors(d, n):
    """Pairs just over the threshold, other ones than the plan was made with."""
    joined, tables, keys = polytope.plan(n, d)
    a, b = polytope.made_up(d, 0.951, 600, 12345)
    assert polytope.meet(polytope.keys_of(a, joined, tables, keys), polytope.keys_of(b, joined, tables, keys)).any(1).mean() >= 0.95


def test_vectors_of_many_lengths_repeated_ids_and_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], "x", 9), (1, [0.0, 1.0], "x", 9), (2, [2.0, 0.0], "x", 9), (3, [1.0, 0.0, 0.0], "x", 9), (None, [3.0, 0.0], "x", 9), (None, [0.0, 0.0, 5.0], "x", 9), (4, [5.0], "x", 9), (5, [7.0], "x", 9), (6, [-7.0], "x", 9), (7, [], "x", 9), (8, [1e300, 1e300], "x", 9), (9, [1.0, 1.0], "x", 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string, n long")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in polytope.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (3, 0, 3, True), (None, 0, None, True), (None, 0, None, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False)], key=str)


def test_a_pair_counts_once_in_whatever_order_its_rows_come():
    names = ["group", "key", "side", "vec_id", "m", "x", "keys"]
    x = np.array([1.0, 0.0]).tobytes()
    held = {1: [10, 20, 30], 2: [20, 10, 40]}
    for orders in ([(1, 2), (1, 2)], [(1, 2), (2, 1)], [(2, 1), (1, 2)], [(2, 1), (2, 1)]):
        rows = [(key, key, -1, v, 1, x, held[v]) for key, order in zip((10, 20), orders, strict=True) for v in order]
        out = list(polytope.compare(0.95)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)])))
        links = [(v, n) for b in out for v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert sorted(links) == [(1, 1), (2, 1)]


def test_leaks(spark):
    items = [(1, "At noon Tom walks 12 km to meet Anna and then he takes Anna back 30 km home."), (2, "short item here now"), (3, None), (4, "")]
    docs = [
        (1, "Well. At noon Paul walks 99 km to meet Mary and then he takes Mary back 7 km home."),
        (2, "Well. At noon Paul walks 99 km to meet Mary and then he takes Fred back 7 km home."),
        (3, "At noon Tom walks 12 km to meet Anna and then he takes Anna back 30 km home. And so on."),
        (4, None), (5, "a short item here now b"), (6, "nothing of the kind"), (7, ""),
    ]
    d, b = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(d, b).collect()} == {(1, 1, "reparameterised"), (3, 1, "exact"), (5, 2, "exact")}
    assert sorted(r.doc_id for r in decontaminate.clean(d, b).collect()) == [2, 4, 6, 7]
    assert decontaminate.leaks(d.where("false"), b).count() == decontaminate.leaks(d, b.where("false")).count() == 0


def test_exact_copies_of_items_with_few_words(spark):
    items = [(1, "What is 12 * 34 + 56 * 78?"), (2, "Who wrote the novel Emma"), (3, "Who Was The First King Of Old Spain"), (4, "Anna 3, Bert 5, Carl 7, Dora 9, Emil 11"), (5, "At noon Tom walks to meet Anna")]
    docs = [(1, "So, what is 12 * 34 + 56 * 78? I ask."), (2, "asked, Who wrote the novel Emma then"), (3, "x who was the first king of old spain y"), (4, "List: Anna 3, Bert 5, Carl 7, Dora 9, Emil 11."), (5, "AT NOON TOM WALKS TO MEET ANNA"), (6, "What is 12 * 34 + 56 * 79?")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(d, b).collect()} == {(k, k, "exact") for k in range(1, 6)}


def test_reparameterised_questions_are_found(spark):
    items = [(1, "James has 5 apples now. James eats 2 apples and gives the rest to a friend. How many apples does the friend get?"), (2, "Tom walks twelve miles to the old town and takes a bus back to the station"), (3, "There are five red balls and nine blue balls in the box under the table"), (4, "12 + 34 * 56 - 7 = x")]
    docs = [
        (1, "Mary has 7 apples now. Mary eats 3 apples and gives the rest to a friend. How many apples does the friend get?"), (2, "So Tom Brown walks thirty five miles to the old town and takes a bus back to the station."),
        (3, "There are nine red balls and four blue balls in the box under the table"), (4, "Now 12 + 34 * 56 - 7 = x, they say."), (5, "Mary has 7 apples now. John eats 3 apples."),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.kind) for r in decontaminate.leaks(d, b).collect()} == {(1, 1, "reparameterised"), (2, 2, "reparameterised"), (3, 3, "reparameterised"), (4, 4, "exact")}


def test_leaks_are_those_of_every_window_against_every_window(spark):
    rng = random.Random(12)
    words = ["the", "red", "Ball", "rolls", "down", "a", "hill", "and", "Tom", "Anna", "Brown", "5", "7.5", "km", "hours", "five", "nine", "When", "stops", "near", "it.", "James,", "twenty-two", "Straße", "x"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([2, 5, 9, 16, 25])))) for k in range(14)]
    docs = []
    for k in range(120):
        text = rng.choices(words, k=rng.randint(0, 10))
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = rng.choice(["Bob", "9", "three", "Mary", "red", "12"])
            text += own + rng.choices(words, k=rng.randint(0, 4))
        docs.append((k, " ".join(text)))
    docs += [(200, docs[3][1]), (200, docs[3][1]), (None, items[4][1]), (201, "word " * 20000 + items[4][1]), (202, None), (203, "")]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item_id string, h int").repartition(3)
    b = spark.createDataFrame([*items, (50, items[4][1]), (None, items[4][1]), (51, None)], "item_id long, text string")
    expected = {}
    for doc, text in docs:
        for item, other in [*items, (50, items[4][1])]:
            if text is not None and (p := brute.pair_of(text if len(text) < 9000 else text[-300:], other)):
                expected[doc, item] = p
    got = {(r.doc_id, r.item_id): (r.covered, r.kind) for r in decontaminate.leaks(d, b).collect()}
    assert got == {k: v for k, v in expected.items() if k[0] is not None} and len(got) > 40
    kept = decontaminate.clean(d, b)
    leaky = {doc for doc, _ in expected}
    assert kept.columns == d.columns and sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(k) for k, _ in docs if k not in leaky)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = roots({x for p in links for x in p}, links)
    touched = {x for p in links if p[0] != p[1] for x in p}
    assert got == {n: expected[n] for n in touched}
