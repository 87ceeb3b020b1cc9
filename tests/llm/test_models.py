"""Toxicity and quality: gradients, held-out accuracy on made-up texts, degenerate inputs; and the pipeline's stages."""

import random

import numpy as np
import pyarrow as pa

from cellsift.llm import quality, toxicity


def test_gradients_of_the_network():
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = "one two three four five six".encode()
    words = toxicity.Words(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), 1)
    index = np.array([[0, 1, 2, -1], [3, 4, 5, 2]])
    x, target, weight = net.inputs(words.row, words.gram, words.gram_start), np.array([1.0, 0.0]), np.array([1.0, 2.0])

    def loss():
        out = net.logits(net.projected(x), index)
        return float(np.mean(weight * (np.log1p(np.exp(out)) - target * out)))

    grads, by_word = net.gradients(x, index, target, weight)
    rng = np.random.default_rng(0)
    for name, g in [*grads.items(), (None, by_word)]:
        values = x if name is None else net.p[name]
        at = tuple(rng.integers(0, s) for s in values.shape)
        old, eps = values[at], 1e-3
        values[at] = old + eps
        up = loss()
        values[at] = old - eps
        down = loss()
        values[at] = old
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-4, name


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 48, 56, 57, 200):
        data = " ".join(f"w{'x' * k}" for k in range(n)).encode()
        words = toxicity.Words(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), 1)
        index, text = words.windows()
        assert len(index) == max(1, -(-(n - 32) // 24) + 1) and set(index[index >= 0].tolist()) == set(range(n)) and not text.any()
        assert all(set(a) & set(b) - {-1} for a, b in zip(index.tolist(), index.tolist()[1:], strict=False))


def test_inputs_of_a_word_are_its_vectors():
    net = toxicity.Network(2)
    words = toxicity.Words(np.frombuffer(b"ab abc", np.uint8), np.zeros(1, np.int64), 1)
    count = sorted(np.diff(np.append(words.gram_start, len(words.gram))).tolist())
    assert count == [3, 6]  # of #ab#: two of three characters, one of four; of #abc#: three, two, one
    x = net.inputs(words.row, words.gram, words.gram_start)
    for k, (a, b) in enumerate(zip(words.gram_start, [*words.gram_start[1:], len(words.gram)], strict=True)):
        assert np.allclose(x[k, : toxicity.WORD_DIM], net.p["words"][words.row[k]]) and np.allclose(x[k, toxicity.WORD_DIM :], net.p["grams"][words.gram[a:b]].mean(0), atol=1e-6)


def test_the_network_survives_being_packed():
    net = toxicity.Network(3)
    net.slope, net.shift = 2.0, -1.0
    texts = pa.array(["one two three", "", None, "x " * 5000])
    assert (toxicity.Network.unpacked(net.packed()).score(texts) == net.score(texts)).all()


def test_long_training_documents_give_a_bounded_number_of_windows():
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([0, 1, 0], pa.int32()), pa.array(["word " * 9000, "a b", ""])], names=["doc_id", "label", "text"])
    out = next(toxicity.pack(iter([rows]))).to_pylist()
    assert [len(r["windows"]) // (4 * toxicity.WINDOW) for r in out] == [toxicity.LESSONS, 1, 1] and [len(r["codes"]) // 8 for r in out] == [1, 2, 0]


def made(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        bad, junk = k % 4 == 0, k % 5 == 0
        if bad:
            text[rng.randrange(len(text))] = "vilex" + rng.choice(["o", "ung", "ant", "isse"])
        text = " ".join(w.upper() + "!!" if junk else w for w in text)
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        labels.append((k, int(not junk), int(bad)))
    return docs, labels


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_finds_word_forms_it_never_saw(spark):
    docs, labels = made(1, 400)
    df = spark.createDataFrame([*docs, (900, None, None, None, None), (901, "", "en", "s", 0), (902, "12 ?", "en", "s", 4)], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    net = toxicity.train(df, lab.where("doc_id < 300"))
    rows = {r.doc_id: r for r in toxicity.score(df, net).collect()}
    late = [(rows[k].predicted, t) for k, _, t in labels if k >= 300]
    assert sum(p == t for p, t in late) >= 0.95 * len(late)
    assert all(0 <= r.score <= 1 for r in rows.values()) and [rows[k].predicted for k in (900, 901, 902)] == [0, 0, 0]
    assert sorted(r.doc_id for r in toxicity.accepted(df, net).collect()) == sorted(k for k, r in rows.items() if not r.predicted)
    assert toxicity.score(df.where("false"), net).count() == 0
    assert {r.score for r in toxicity.score(df, toxicity.train(df, lab.where("false"))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(df, toxicity.train(df, lab.where("toxic = 1"))).collect()} == {1.0}


def test_quality_by_two_views(spark):
    docs, labels = made(2, 500)
    df = spark.createDataFrame([*docs, (900, None, None, None, None), (901, "", "en", None, 0)], DOCS)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(df, lab.where("doc_id < 250"))
    rows = {r.doc_id: r for r in quality.score(df, model).collect()}
    late = [(rows[k].predicted, q) for k, q, _ in labels if k >= 250]
    assert sum(p == q for p, q in late) >= 0.97 * len(late)
    assert len(rows) == 502 and all(0 <= r.score <= 1 for r in rows.values())
    kept = quality.accepted(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in rows.items() if r.predicted}
    assert quality.score(df.where("false"), model).count() == 0
    assert {r.score for r in quality.score(df.drop("lang"), quality.train(df, lab.where("false"))).collect()} == {1.0}


def test_views_are_whole_text_statistics():
    content, meta = quality.features(pa.array(["a b\na b", None, "X" * 70000]), ["en", None, "en"], ["s", "s", None], [7, None, 70000])
    stats = content[:, quality.SHAPES + quality.WORDS :]
    assert abs(stats[0, 0] - 0.5) < 1e-6 and stats[1, -1] == 1 and stats[2, 0] == 1
    assert content.shape == (3, quality.CONTENT) and meta.shape == (3, quality.META) and np.isfinite(content).all() and np.isfinite(meta).all()
