"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 2), written and trained in numpy.

Inputs of a word: a learned vector of the hashed word, and the mean of the learned vectors of its hashed character n-grams
(3 to 6 characters, the word's ends marked). Nothing else, no count and no odds of the training rows, reaches the network.
Two gated recurrent layers read a window of WINDOW words forwards and backwards, attention pools their states, and a
logistic unit gives the window's logit. A document's windows overlap; all are scored, over the whole text, and the largest
logit is calibrated to the document's score.

Training: at most PER_CLASS labelled documents of each class, of a longer one LESSONS windows chosen by a hash (documented
bounds). Workers turn the documents into packed windows; one task fits the network and gives back its parameters, so the
driver sees neither texts nor windows. A fifth of the documents, by a hash, is kept for calibration and never fitted on.
First the inputs are trained alone, as a soft maximum over a document's words; then the network learns from each
toxic document's most toxic window and each clean one's most toxic and some other windows, which it chooses anew each round.

Cases: a null or empty text, or one without letters, is scored as an empty window; without training rows of both classes
the score is the share of toxic ones (0 if there are none); repeated rows get equal scores; an empty table gives an empty
result; further columns don't pass.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellsift.llm.common import ROWS, buffers, filtered, lean, mix, spans, table
from cellsift.llm.langid import letters
from cellsift.llm.sample import fold, labelled

WINDOW, STRIDE = 32, 24
WORD_ROWS, GRAM_ROWS, GRAMS = 1 << 15, 1 << 16, (3, 4, 5, 6)
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 8, 8, 12, 12
INPUT = WORD_DIM + GRAM_DIM
#: Bounds of the training sample: documents of each class, windows of a document.
PER_CLASS, LESSONS = 2000, 64
#: Share kept for calibration; documents that a row of a table needs to be learned.
KEPT, SUPPORT = 0.2, 4
#: Of the inputs alone: steps over all documents, rate, decay, and the weight of n-grams beside words.
STEPS, FIRST_RATE, DECAY, GRAM_WEIGHT = 120, 0.4, 1e-5, 4.0
#: Of the network: rounds of choosing windows, windows of a step, least steps of a round, rates, share of words left out, windows of a clean document: the most toxic ones and others.
ROUNDS, BATCH, LEAST_STEPS, RATE, TABLE_RATE, LEFT_OUT, WORST, OTHERS = 2, 128, 60, 0.05, 0.02, 0.1, 2, 2
SPAN, AT_ONCE, WORDS_AT_ONCE = 1 << 19, 1024, 1 << 14


class Words:
    """Words of several texts: for each distinct word its row of the word table and its n-grams; the words in order."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, texts: int):
        places = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        low = letters()[points].astype(np.uint64)
        is_letter = np.zeros(len(low) + 2, bool)
        is_letter[1:-1] = low > 0
        edge = np.zeros(len(low) + 1, bool)
        edge[np.searchsorted(places, begin)] = True
        starts = np.flatnonzero(is_letter[1:-1] & (~is_letter[:-2] | edge[:-1]))
        ends = np.flatnonzero(is_letter[1:-1] & (~is_letter[2:] | edge[1:])) + 1
        self.cut = np.searchsorted(starts, np.append(np.searchsorted(places, begin), len(low)))[: texts + 1]
        up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(low), np.uint64(0x9E3779B97F4A7C15))]))
        down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(low), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)))]))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(low) * up[:-1])])
        code = mix((total[ends] - total[starts]) * down[starts])
        distinct, at, self.word = np.unique(code, return_index=True, return_inverse=True)
        self.code, self.word = distinct, self.word.ravel()
        self.row = word_rows(distinct)
        # N-grams of the distinct words, a mark (1) on either side.
        first, length = starts[at], ends[at] - starts[at]
        size = length + 2
        self.gram, self.gram_start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(size):
            return
        begins = np.cumsum(size) - size
        own = np.repeat(np.arange(len(size)), size)
        inner = np.arange(int(size.sum())) - begins[own]
        marked = np.ones(len(own), np.uint64)
        body = (inner > 0) & (inner <= length[own])
        marked[body] = low[(first[own] + inner - 1)[body]]
        grams, at = [], []
        for n in GRAMS:
            m = len(marked) - n + 1
            if m <= 0:
                continue
            whole = np.flatnonzero(own[:m] == own[n - 1 :])
            h = np.full(len(whole), n, np.uint64)
            for k in range(n):
                h = h * np.uint64(0xD1342543DE82EF95) + marked[whole + k]
            grams.append((mix(h) >> np.uint64(40)).astype(np.int64) & (GRAM_ROWS - 1))
            at.append(own[whole])
        gram, at = np.concatenate(grams), np.concatenate(at)
        self.gram = gram[np.argsort(at, kind="stable")]
        count = np.bincount(at, minlength=len(size))  # a letter and two marks have one n-gram at least
        self.gram_start = np.cumsum(count) - count

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words of each window (-1 beyond the text's end), and each window's text. An empty text has one empty window."""
        m = np.diff(self.cut)
        count = np.maximum(1, -(-(m - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(m)), count)
        k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        inside = (k * STRIDE)[:, None] + np.arange(WINDOW)
        index = np.where(inside < m[text][:, None], self.cut[:-1][text][:, None] + inside, -1)
        return np.where(index >= 0, self.word[index], -1) if len(self.word) else np.full(index.shape, -1), text


def word_rows(code: np.ndarray) -> np.ndarray:
    return (code >> np.uint64(40)).astype(np.int64) & (WORD_ROWS - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, logits and gradients. Arrays of both directions lead with an axis of two, the second one reversed in time."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        f = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        h = HIDDEN
        self.p = {
            "words": f(WORD_ROWS, WORD_DIM, scale=0.05), "grams": f(GRAM_ROWS, GRAM_DIM, scale=0.05),
            "W": f(2, INPUT, 3 * h, scale=INPUT**-0.5), "c": np.zeros((2, 1, 3 * h), np.float32), "U": f(2, h, 3 * h, scale=h**-0.5),
            "A": f(2 * h, ATTEND, scale=(2 * h) ** -0.5), "a": np.zeros(ATTEND, np.float32), "v": f(ATTEND, scale=ATTEND**-0.5), "o": f(2 * h, scale=(2 * h) ** -0.5), "k": np.full(1, -1, np.float32),
        }
        self.slope, self.shift, self.constant = 1.0, 0.0, None

    def inputs(self, row: np.ndarray, gram: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Vectors of distinct words, from their rows and n-grams."""
        if not len(row):
            return np.zeros((0, INPUT), np.float32)
        count = np.diff(np.append(start, len(gram)))
        return np.concatenate([self.p["words"][row], np.add.reduceat(self.p["grams"][gram], start) / count[:, None]], 1).astype(self.p["W"].dtype)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """Inputs of the gates by word, for either direction; the last row is for no word."""
        out = np.zeros((2, len(inputs) + 1, 3 * HIDDEN), self.p["W"].dtype)
        out[:, :-1] = inputs @ self.p["W"] + self.p["c"]
        return out

    def logits(self, projected: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows (indices of words, -1 for none)."""
        p, h, at = self.p, HIDDEN, index.T
        there = (at >= 0).astype(projected.dtype)
        mask = np.stack([there, there[::-1]])[..., None]
        state, states, kept = np.zeros((2, len(index), h), there.dtype), np.empty((2, *at.shape, h), there.dtype), []
        for k in range(len(at)):
            x = np.stack([projected[0][at[k]], projected[1][at[-1 - k]]])
            g = state @ p["U"]
            zr = 1 / (1 + np.exp(-(x[..., : 2 * h] + g[..., : 2 * h])))
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(x[..., 2 * h :] + r * g[..., 2 * h :])
            if keep:
                kept.append((state, z, r, n, g[..., 2 * h :]))
            state = state + mask[:, k] * (1 - z) * (n - state)
            states[:, k] = state
        s = np.concatenate([states[0], states[1][::-1]], 2)
        act = np.tanh(s @ p["A"] + p["a"])
        e = act @ p["v"] - 1e4 * (1 - there)
        w = np.exp(e - e.max(0)) * there
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[..., None] * s).sum(0)
        out = pooled @ p["o"] + p["k"][0]
        return (out, (mask, kept, s, act, w, pooled)) if keep else out

    def gradients(self, inputs: np.ndarray, index: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the mean weighted logistic loss by parameter, and by the words' vectors."""
        p, h = self.p, HIDDEN
        out, (mask, kept, s, act, w, pooled) = self.logits(self.projected(inputs), index, keep=True)
        d = ((sigmoid(out) - target) * weight / len(target)).astype(p["W"].dtype)
        g = {"o": pooled.T @ d, "k": np.array([d.sum()])}
        dpool = d[:, None] * p["o"]
        dw = (s * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        dact = de[..., None] * p["v"] * (1 - act * act)
        g |= {"v": np.einsum("tb,tba->a", de, act), "A": s.reshape(-1, 2 * h).T @ dact.reshape(-1, ATTEND), "a": dact.sum((0, 1))}
        ds = w[..., None] * dpool + dact @ p["A"].T
        ds = np.stack([ds[..., :h], ds[::-1, :, h:]])
        carry, dx, du, back = np.zeros_like(ds[:, 0]), np.empty((*ds.shape[:3], 3 * h), ds.dtype), np.zeros_like(p["U"]), p["U"].transpose(0, 2, 1)
        for k in range(ds.shape[1] - 1, -1, -1):
            state, z, r, n, gn = kept[k]
            carry = carry + ds[:, k]
            dm = carry * mask[:, k]
            dn, dz = dm * (1 - z) * (1 - n * n), dm * (state - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dx[:, k] = np.concatenate([dz, dr, dn], 2)
            dg = np.concatenate([dz, dr, dn * r], 2)
            du += state.transpose(0, 2, 1) @ dg
            carry = carry * (1 - mask[:, k]) + dm * z + dg @ back
        dx *= mask
        by_word = np.zeros((2, len(inputs) + 1, 3 * h), dx.dtype)
        for j, at in enumerate((index.T, index.T[::-1])):
            rows, total = summed(at.ravel(), dx[j].reshape(-1, 3 * h))
            by_word[j][rows] = total
        by_word = by_word[:, :-1]
        g |= {"U": du, "W": inputs.T @ by_word, "c": by_word.sum(1, keepdims=True)}
        return g, (by_word @ p["W"].transpose(0, 2, 1)).sum(0)

    def window_logits(self, projected: np.ndarray, index: np.ndarray) -> np.ndarray:
        return np.concatenate([self.logits(projected, index[a : a + AT_ONCE]) for a in range(0, len(index), AT_ONCE)] or [np.zeros(0, np.float32)])

    def document_logits(self, column: pa.Array) -> np.ndarray:
        """The largest logit of each text's windows."""
        data, offsets = buffers(column)
        out = np.full(len(column), -np.inf, np.float32)
        for i, j in spans(offsets, SPAN):
            words = Words(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i], j - i)
            index, text = words.windows()
            np.maximum.at(out, i + text, self.window_logits(self.projected(self.inputs(words.row, words.gram, words.gram_start)), index))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return sigmoid(self.document_logits(column).astype(np.float64) * self.slope + self.shift)

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, curve=np.array([self.slope, self.shift]), **self.p)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Network:
        net = Network()
        with np.load(io.BytesIO(data)) as held:
            net.p = {k: held[k] for k in net.p}
            net.slope, net.shift = map(float, held["curve"])
        return net


def summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places (-1 last, as an index has it) and the sum of the values at each."""
    rows, inverse = np.unique(at, return_inverse=True)
    return rows, np.stack([np.bincount(inverse.ravel(), values[:, k], len(rows)) for k in range(values.shape[1])], 1).astype(values.dtype)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each training document (doc_id, label, text) its windows as bytes: distinct words' codes, n-grams and how many, indices of words."""
    for batch in batches:
        rows = []
        data, offsets = buffers(batch.column(2))
        for d, (doc, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            w = Words(data[offsets[d] : offsets[d + 1]], np.zeros(1, np.int64), 1)
            index, _ = w.windows()
            if len(index) > LESSONS:
                index = index[np.argsort(mix(np.arange(len(index), dtype=np.uint64) + np.uint64((doc & 0xFFFFFFFF) << 24)))[:LESSONS]]
            used = np.unique(index[index >= 0])
            count = np.diff(np.append(w.gram_start, len(w.gram)))
            gram = w.gram[np.repeat(np.isin(np.arange(len(count)), used), count)]
            index = np.where(index >= 0, np.searchsorted(used, index), -1)
            rows.append((doc, label, w.code[used].tobytes() if len(used) else b"", count[used].astype(np.int32).tobytes(), gram.astype(np.int32).tobytes(), index.astype(np.int32).tobytes()))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "label", "codes", "counts", "grams", "windows"])


class Lessons:
    """The windows of all training documents over one table of distinct words."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: (r[0], r[1], r[2], r[5]))
        self.label = np.array([r[1] for r in rows], np.float64)
        self.held = mix(np.array([r[0] & (1 << 62) - 1 for r in rows], np.uint64) + np.uint64(77)) % np.uint64(1000) < np.uint64(int(1000 * KEPT))
        joined = lambda k, kind: np.concatenate([np.frombuffer(r[k], kind) for r in rows])
        code, count, gram, index = joined(2, np.uint64), joined(3, np.int32).astype(np.int64), joined(4, np.int32), joined(5, np.int32).reshape(-1, WINDOW)
        size = np.array([len(r[2]) // 8 for r in rows])
        self.doc = np.repeat(np.arange(len(rows)), [len(r[5]) // (4 * WINDOW) for r in rows])
        distinct, at, of = np.unique(code, return_index=True, return_inverse=True)
        own = (np.cumsum(size) - size)[self.doc][:, None] + index
        self.index = np.where(index >= 0, of.ravel()[np.where(index >= 0, own, 0)] if len(of) else -1, -1).astype(np.int32)
        self.row, self.count = word_rows(distinct), count[at]
        self.start = np.cumsum(self.count) - self.count
        self.gram = gram[np.repeat((np.cumsum(count) - count)[at] - self.start, self.count) + np.arange(int(self.count.sum()))]

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, n-grams and where they start, of some of the words."""
        count = self.count[words]
        start = np.cumsum(count) - count
        return self.row[words], self.gram[np.repeat(self.start[words] - start, count) + np.arange(int(count.sum()))], start


class Training:
    def __init__(self, lessons: Lessons, fitted: np.ndarray, seed: int = 3):
        """fitted: which documents the network is fitted on."""
        self.l, self.fitted, self.net, self.rng = lessons, fitted, Network(), np.random.default_rng(seed)
        self.windows = np.flatnonzero(fitted[lessons.doc])
        self.acc = {k: np.full_like(v, 1e-8) for k, v in self.net.p.items()}
        index = lessons.index[self.windows]
        there = index >= 0
        pairs = np.unique(np.repeat(lessons.doc[self.windows], WINDOW).reshape(index.shape)[there].astype(np.int64) * len(lessons.row) + index[there])
        self.of_doc, self.word = np.divmod(pairs, max(1, len(lessons.row)))
        times = np.bincount(self.word, minlength=len(lessons.row))
        self.known = {"words": np.bincount(lessons.row, times, WORD_ROWS) >= SUPPORT, "grams": np.bincount(lessons.gram, np.repeat(times, lessons.count), GRAM_ROWS) >= SUPPORT}
        for name, known in self.known.items():
            self.net.p[name] *= known[:, None]

    def first(self) -> np.ndarray:
        """Train the first coordinate of the inputs alone: a document's logit is a soft maximum over its words. Returns the words' values."""
        l = self.l  # noqa: E741
        own = np.unique(self.word)
        row, gram, start = l.of(own)
        count = l.count[own]
        of_word, at = np.repeat(np.arange(len(own), dtype=np.int32), count), np.searchsorted(own, self.word)
        docs, doc = np.unique(self.of_doc, return_inverse=True)
        begin, size = np.searchsorted(doc, np.arange(len(docs))), np.bincount(doc)
        y = l.label[docs]
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)
        value = {"words": np.zeros(WORD_ROWS), "grams": np.zeros(GRAM_ROWS)}
        acc, shift, shift_acc = {k: np.full_like(v, 1e-6) for k, v in value.items()}, -1.0, 1e-6
        for _ in range(STEPS):
            score = (value["words"][row] + GRAM_WEIGHT * np.bincount(of_word, value["grams"][gram], len(own)) / count)[at]
            most = np.maximum.reduceat(score, begin)
            e = np.exp(score - most[doc])
            total = np.add.reduceat(e, begin)
            d = (sigmoid(most + np.log(total) - 0.5 * np.log(size) + shift) - y) * weight
            by_word = np.bincount(at, (d / total)[doc] * e, len(own))
            for name, places, grad in (("words", row, by_word), ("grams", gram, (GRAM_WEIGHT * by_word / count)[of_word])):
                g = (np.bincount(places, grad, len(value[name])) + DECAY * value[name]) * self.known[name]
                acc[name] += g * g
                value[name] -= FIRST_RATE * g / np.sqrt(acc[name])
            shift_acc += d.sum() ** 2
            shift -= FIRST_RATE * d.sum() / shift_acc**0.5
        self.net.p["words"][:, 0], self.net.p["grams"][:, 0] = value["words"] / 2, value["grams"] * GRAM_WEIGHT / 2
        out = np.full(len(l.row) + 1, -np.inf)
        out[own] = value["words"][row] + GRAM_WEIGHT * np.bincount(of_word, value["grams"][gram], len(own)) / count
        return out

    def chosen(self, value: np.ndarray) -> np.ndarray:
        """Of each toxic document its window of greatest value, of each clean one the WORST greatest and about OTHERS others."""
        doc = self.l.doc[self.windows]
        order = np.lexsort((-value, doc))
        doc = doc[order]
        rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
        toxic = self.l.label[doc] > 0
        other = ~toxic & (self.rng.random(len(doc)) * np.bincount(doc)[doc] < OTHERS)
        return self.windows[order[(rank < np.where(toxic, 1, WORST)) | other]]

    def step(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        net, index = self.net, self.l.index[windows]
        index = np.where(self.rng.random(index.shape) < LEFT_OUT, -1, index)
        used, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape) - int(used[0] < 0)
        used = used[used >= 0]
        row, gram, start = self.l.of(used)
        count = self.l.count[used]
        grads, by_word = net.gradients(net.inputs(row, gram, start), local, target, weight)
        for name, g in grads.items():
            self.acc[name] += g * g
            net.p[name] -= RATE * g / np.sqrt(self.acc[name] + 1e-3)
        for name, at, g in (("words", row, by_word[:, :WORD_DIM]), ("grams", gram, np.repeat(by_word[:, WORD_DIM:] / count[:, None], count, axis=0))):
            rows, total = summed(at, g)
            total *= self.known[name][rows, None]
            self.acc[name][rows] += total * total
            net.p[name][rows] -= TABLE_RATE * total / np.sqrt(self.acc[name][rows] + 1e-4)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        l = self.l  # noqa: E741
        parts = [self.net.inputs(*l.of(np.arange(a, min(a + WORDS_AT_ONCE, len(l.row))))) for a in range(0, len(l.row), WORDS_AT_ONCE)]
        return self.net.window_logits(self.net.projected(np.concatenate(parts or [np.zeros((0, INPUT), np.float32)])), l.index[windows])

    def run(self) -> Network:
        l = self.l  # noqa: E741
        value = self.first()[l.index[self.windows]].max(1)
        for r in range(ROUNDS):
            if r:
                value = self.logits(self.windows)
            windows = self.chosen(value)
            target = l.label[l.doc[windows]].astype(np.float32)
            weight = np.where(target > 0, 0.35 / max(target.mean(), 1e-9), 0.65 / max(1 - target.mean(), 1e-9)).astype(np.float32)
            for _ in range(max(2 if r == 0 else 1, -(-LEAST_STEPS * BATCH // len(windows)))):
                order = self.rng.permutation(len(windows))
                for a in range(0, len(order), BATCH):
                    part = order[a : a + BATCH]
                    self.step(windows[part], target[part], weight[part])
        return self.net


def fitted(lessons: Lessons, share: tuple[float, float]) -> Network:
    """A network from packed documents. share: how many labelled documents there are for each one of the sample, by class."""
    held = lessons.held.copy()
    for k in (0, 1):  # both parts need both classes; one document alone serves for both
        own = np.flatnonzero(lessons.label == k)
        if held[own].all() or not held[own].any():
            held[own] = False
            held[own[: len(own) // 2]] = True
    if len({*lessons.label[held]}) < 2:
        held[:] = False
    net = Training(lessons, ~held).run()
    judged = held if held.any() else ~held
    rows_ = np.flatnonzero(judged[lessons.doc])
    most = np.full(len(lessons.label), -np.inf)
    training = object.__new__(Training)
    training.l, training.net = lessons, net
    np.maximum.at(most, lessons.doc[rows_], training.logits(rows_))
    label = lessons.label[judged]
    net.slope, net.shift = calibrate(most[judged], label, np.where(label > 0, share[1], share[0]))
    return net


def calibrate(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the logits, by Newton steps on a penalised likelihood."""
    x = np.stack([logit, np.ones_like(logit)], 1).astype(np.float64)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        q = sigmoid(x @ beta)
        grad = x.T @ (weight * (q - label)) + 1e-2 * (beta - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2), grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 1e-3)), float(beta[1])


def train(documents: DataFrame, labels: DataFrame, keep=None, per_class: int = PER_CLASS) -> Network:
    """A network from labelled documents; keep: which rows of labels may be learned from."""
    net = Network()
    rows = labelled(documents.where(F.col("text").isNotNull()), labels, "toxic", per_class, ["text"], keep)
    taken = {r.label: (r.n, r.all) for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max("of_label").alias("all")).collect()}
    if len(taken) < 2:
        net.constant = float(1 in taken)
        return net
    share = tuple(taken[k][1] / taken[k][0] for k in (0, 1))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lessons = Lessons([r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array([fitted(lessons, share).packed()], pa.binary())], names=["network"])

    windows = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "text").mapInArrow(lean(pack), "doc_id bigint, label int, codes binary, counts binary, grams binary, windows binary")
    return Network.unpacked(windows.repartition(1).mapInArrow(lean(fit), "network binary").first().network)  # a bounded sample: one task


def score(documents: DataFrame, net: Network, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, score and predicted."""
    sent = documents.sparkSession.sparkContext.broadcast(net)  # of a fixed size
    schema = ", ".join([*(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                part = whole.slice(k, ROWS)
                s = sent.value.score(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return documents.select(*(documents[c] for c in keep), documents[text].cast("string").alias("__text")).mapInArrow(lean(run), schema)


def accepted(documents: DataFrame, net: Network, below: float = 0.5) -> DataFrame:
    """The documents whose score is below that, with all their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(net)
    return filtered(documents, {"text": "string"}, lambda text: sent.value.score(text) < below)


def may_learn(key: str = "doc_id"):
    return F.coalesce(fold(key, 5) != 0, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    net = train(documents, table(spark, sf_dir, "labels"), may_learn())
    return score(documents, net).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
