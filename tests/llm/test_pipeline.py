"""The corpus pipeline, end to end against plain versions of its stages, and each stage on odd tables."""

import base64
import hashlib
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from cellsift.llm import bpe, quality, shards, toxicity
from cellsift.llm.common import table
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, score string, rows long"


def corpus():
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    items = [(k, " ".join(rng.choices(words, k=14))) for k in range(3)] + [(3, "James has 5 apples now and gives the rest of the apples to a friend")]
    docs, labels = [], []
    for k in range(260):
        text = rng.choices(words, k=rng.randint(8, 90))
        bad, junk = k % 5 == 0, k % 7 == 0
        if bad:
            text[rng.randrange(len(text))] = "vilex" + rng.choice(["o", "ung", "ant"])
        text = " ".join(w.upper() + "!!" if junk else w for w in text)
        if k % 41 == 3:
            text += " " + rng.choice(items[:3])[1]
        if k % 41 == 4:
            text += " Mary has 9 apples now and gives the rest of the apples to a friend"
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(not junk), int(bad)))
    for k in (1, 2, 8, 11):  # exact copies, and near ones of long texts
        docs.append((300 + k, docs[k][1], "en", "s1", 5))
        docs.append((400 + k, docs[k][1] + " more", "en", "s1", 5))
    docs += [(500, None, None, None, None), (501, "", "en", None, 0), (None, docs[9][1], "en", "s", 3), (502, docs[13][1], "en", "s", 3), (502, docs[16][1], "en", "s", 3), (17, docs[17][1], *docs[17][2:])]
    return docs, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    docs, labels, items = corpus()
    spark.createDataFrame([(*d, 7, "clash", 1) for d in docs], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([*items, (9, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_the_pipeline_gives_what_plain_stages_give(spark, folder):
    import public_tokenizers
    import tiktoken

    _, labels, items = corpus()
    docs = [tuple(r) for r in table(spark, folder, "documents").collect()]
    marks = table(spark, folder, "labels")
    frame = lambda rows: spark.createDataFrame(rows, DOCS)

    judge = quality.train(frame(docs), marks, quality.may_learn())
    views = quality.features(pa.array([d[1] for d in docs], pa.string()), *([d[c] for d in docs] for c in (2, 3, 4)))
    kept = [d for d, s in zip(docs, judge.score(*views)[0], strict=True) if s >= 0.5]
    assert 150 < len(kept) < len(docs)
    net = toxicity.train(frame(kept), marks, toxicity.may_learn())
    kept = [d for d, s in zip(kept, net.score(pa.array([d[1] for d in kept], pa.string())), strict=True) if s < 0.5]
    assert sum(x for k, _, x in labels if k in {d[0] for d in kept}) <= 6
    sets = [brute.shingles(d[1]) for d in kept]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and 100 * len(a & b) >= 80 * len(a | b)]
    root = brute.roots(range(len(kept)), near)
    best = {}
    for i, d in enumerate(kept):
        if sets[i]:
            key = (d[0] is None, d[0] or 0, i)
            best[root[i]] = min(best.get(root[i], key), key)
    chosen = {k[2] for k in best.values()}
    kept = [d for i, d in enumerate(kept) if i in chosen or not sets[i]]
    kept = [d for d in kept if not any(brute.pair_of(d[1] or "", item) for _, item in items)]
    with open(bpe.vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for d in kept:
        ids = np.array(other.encode_ordinary(d[1] or ""), "<u4").tobytes()
        expected.append((d[0], len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((d[1] or "").encode()).hexdigest()))
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))


def test_every_stage_takes_odd_tables(spark, folder):
    docs = table(spark, folder, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, "", None, None, None, 1, "x", 1), (1, "", None, None, None, 1, "x", 1), (2, "a plain and short text of words", "en", "s", 5, 1, "x", 1), (2, "another text under the same id here", "en", "s", 5, 1, "x", 1)], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        out = stage(spark, odd, folder)
        assert out.count() <= 5, name
        if name != "byte_bpe":
            assert out.columns == docs.columns, name
        if name in ("near_duplicates", "decontamination"):
            assert {2} <= {r.doc_id for r in out.collect()} and out.where("doc_id = 2").count() == 2, name


def test_all_documents_that_a_view_is_sure_of_teach_the_other(spark, folder):
    docs, marks = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.train(docs, marks, rounds=0)
    rows = docs.collect()
    views = quality.features(pa.array([r.text for r in rows], pa.string()), *([r[c] for r in rows] for c in ("lang", "source", "n_chars")))
    handed = model.handed(*views)
    got = quality.lessons(docs, model)
    for v in (0, 1):
        for k in (0, 1):
            n = sum(m.n for m in got[v][k])
            assert n == handed[v][k].sum()
            if n:
                assert np.allclose(got[v][k][0].m, quality.Moments(quality.WIDTH[v]).add(views[v][handed[v][k]]).m, rtol=1e-6)
    assert handed[1][0].any() and handed[1][1].sum() > 100  # what is written tells more than a record does


def test_the_metadata_view_sees_no_text():
    record = (["en", None], ["s", "t"], [7, None])
    a, b = (quality.features(pa.array(texts, pa.string()), *record) for texts in (["one text", "x" * 5000], [None, "Other!"]))
    assert (a[1] == b[1]).all() and not (a[0] == b[0]).all()


def test_a_discriminant_is_the_textbook_one():
    rng = np.random.default_rng(0)
    bad, good = rng.standard_normal((40, 5)), rng.standard_normal((30, 5)) + 0.7
    made = quality.Discriminant([quality.Moments(5).add(bad)], [quality.Moments(5).add(good)])
    inner = (np.cov(bad.T, bias=True) + np.cov(good.T, bias=True)) / 2 + quality.RIDGE * np.eye(5)
    w = np.linalg.inv(inner) @ (good.mean(0) - bad.mean(0))
    assert np.allclose(made.w / np.linalg.norm(made.w), w / np.linalg.norm(w)) and abs(made.w @ (good.mean(0) + bad.mean(0)) / 2 + made.b) < 1e-9


def fall(key, tree):
    """The shard of a key, by the least draw at each node."""
    path = ""
    while not isinstance(tree, float):
        def draw(name, path=path, tree=tree):
            seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), 42).intdigest()
            bits = xxhash.xxh64(f"{path}/{name}".encode(), seed).intdigest() >> 11
            return -math.log((bits + 0.5) / (1 << 53)) / shards.weight(tree[name])

        name = min(tree, key=draw)
        path, tree = f"{path}/{name}", tree[name]
    return int(path.rsplit("/", 1)[1])


def test_shards_are_those_of_a_descent_in_python(spark):
    rows = [(k * 7919 - 300, "é" * (k % 40), "clash") for k in range(300)] + [(5, "dup", "x"), (5, "dup", "x"), (None, "x", "x"), (6, "long " * 50000, "x"), (7, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(4)
    got = shards.shard_rows(df, shards.EIGHT, shards.NINE).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.grown_shard) == (fall(r.doc_id, shards.EIGHT), fall(r.doc_id, shards.NINE)), r.doc_id
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(k), len((t or "").encode()) + 1) for k, t, _ in rows)
