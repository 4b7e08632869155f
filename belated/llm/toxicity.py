"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the embedding of its hash (word input) and the mean embedding
of its hashed character 5-grams, word boundaries included (character input).
Each holds trained dimensions and fixed ones, the smoothed log odds of the word,
of its best gram and of its first eight characters in toxic documents of the
fitting sample, so that rare but telling words count from the first step; in
fitting a document's odds are those of the other documents, so that no word
tells its own label.  Forward and backward gated recurrent units read windows of
``WINDOW`` words; attention weights pool the states to one vector, a logistic
unit scores it.  Windows start every ``STRIDE`` words, half a window, so every
word but those at the ends stands in two, and a phrase of up to ``STRIDE`` words
is in one as a whole.  All are scored; a document's score is that of its worst
window.

Labels belong to documents, so fitting is multiple-instance learning: a toxic
document teaches by its worst window, a clean one by its worst and a random one,
chosen anew each round.  Fitted in numpy (Adam) on a bounded sample: at most
about ``PER_CLASS`` labelled toxic documents and ``CLEAN`` times as many clean
ones, of at most ``MAX_CHARS`` code points.  Null and empty texts have one empty window.  Without labels of both
classes every score is 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

PER_CLASS, CLEAN, SPARE, MAX_CHARS, WINDOW, STRIDE, THRESHOLD = 800, 2, 3, 4000, 32, 16, 0.7
WORD_SLOTS, GRAM_SLOTS, DIMS, HIDDEN, ROUNDS = 1 << 16, 1 << 16, 3, 6, 12
BLOCK, LEAST_STEPS = 1 << 19, 800
SHRINK = 6.0  # documents that a slot needs for half of its log odds
POSITIVE = 0.5  # share of the loss that toxic documents have
EMBED = 1.0  # rate of the embeddings, in steps of the other parameters
INPUTS = 2 * (DIMS + 1) + 1


def read(data: np.ndarray, offsets: np.ndarray):
    """Word slots, per-row word counts, gram slots, the first gram of each word and
    the number of its grams, and slots of word starts of eight characters.  The text is lower case; edge punctuation is dropped from words."""
    x = _FOLD[data]
    starts, ends, per = kernels.words(x, offsets)
    word = (kernels.span_hash(kernels.prefix_hash(x), starts, ends) & np.uint64(WORD_SLOTS - 1)).astype(np.uint16) if len(starts) else np.zeros(0, np.uint16)
    # grams over the squeezed words with a blank at each side
    size = ends - starts + 2
    first = np.concatenate(([0], np.cumsum(size)))
    y = np.full(first[-1] + 8, 0x20, np.uint32)
    at = np.arange(int((ends - starts).sum()))
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts) if len(starts) else at
    put = np.repeat(first[:-1] + 1 - np.concatenate(([0], np.cumsum(ends - starts)[:-1])), ends - starts) if len(starts) else at
    y[at + put] = x[at + shift]
    h = y[:-8] * np.uint32(0x9E3779B1) + y[1:-7] * np.uint32(0x85EBCA77) + y[2:-6] * np.uint32(0xC2B2AE3D) + y[3:-5] * np.uint32(0x27D4EB2F) + y[4:-4] * np.uint32(0x165667B1)
    # the longer gram at the same place: a word's start and the next letters
    far = h + y[5:-3] * np.uint32(0x7FEB352D) + y[6:-2] * np.uint32(0x846CA68B) + y[7:-1] * np.uint32(0x9E3779B9)

    def slot(x):
        x = x ^ (x >> np.uint32(15))
        return ((x * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.uint16)

    # a word's grams start and end in it (its size - 4), or there is one that runs on
    return word, per, slot(h), first[:-1], np.maximum(size - 4, 1), slot(far[first[:-1]])


_FOLD = np.arange(256, dtype=np.uint8)
for _c in range(128):
    if not chr(_c).isalnum():
        _FOLD[_c] = 0x20


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``count`` of them."""
    return (np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))).astype(np.int32)


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters p and the passes over windows.  Inputs are (windows, WINDOW)
    arrays of word numbers into a table of word vectors; -1 is padding."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        d, h = INPUTS, HIDDEN

        def normal(*shape, s):
            return (r.standard_normal(shape) * s).astype(np.float32)

        self.p = {"word": normal(WORD_SLOTS, DIMS, s=0.02), "gram": normal(GRAM_SLOTS, DIMS, s=0.02), "att": normal(2 * h, s=0.3), "out": normal(2 * h, s=0.5), "bias": np.full(1, -2.0, np.float32)}
        for k in "fb":
            self.p |= {f"w{k}": normal(d, 3 * h, s=0.5 / d**0.5 * 2), f"u{k}": normal(h, 3 * h, s=1 / h**0.5), f"c{k}": np.zeros(3 * h, np.float32)}
        self.word_odds, self.gram_odds, self.start_odds = np.zeros(WORD_SLOTS, np.float32), np.zeros(GRAM_SLOTS, np.float32), np.zeros(GRAM_SLOTS, np.float32)
        self.fitted = False

    def vectors(self, word, gram, first, count, start, own=None):
        """Inputs of words: trained word part and odds, character part and odds of
        its grams and its start.  own: the labels of the words' documents, in fitting:
        odds are then those of the other documents."""
        odds = [self.word_odds, self.gram_odds, self.start_odds] if own is None else self.others
        out = np.zeros((len(word) + 1, INPUTS), np.float32)
        if len(word):
            cut = np.cumsum(count) - count
            g = gram[_runs(first, count)]
            out[:-1, :DIMS] = self.p["word"][word]
            pick = (lambda table, slot, by=None: table[slot]) if own is None else (lambda table, slot, by=own: table[by, slot])
            out[:-1, DIMS] = pick(odds[0], word)
            for k in range(DIMS):
                out[:-1, DIMS + 1 + k] = np.add.reduceat(self.p["gram"][:, k].take(g), cut) / count
            out[:-1, -2] = np.maximum.reduceat(pick(odds[1], g) if own is None else pick(odds[1], g, np.repeat(own, count)), cut)
            out[:-1, -1] = pick(odds[2], start)
        return out  # the last row is padding

    def forward(self, index, vec, keep=False):
        p, h = self.p, HIDDEN
        n, t = index.shape
        mask = (index >= 0).astype(np.float32)
        states, tape = [], []
        for k, steps in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            x = vec @ p[f"w{k}"] + p[f"c{k}"]  # once a word, not once a window
            s = np.zeros((n, h), np.float32)
            all_s = np.empty((n, t, h), np.float32)
            u = p[f"u{k}"]
            for j in steps:
                xj = x[index[:, j]]
                zr = _sigmoid(xj[:, : 2 * h] + s @ u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(xj[:, 2 * h :] + (r * s) @ u[:, 2 * h :])
                m = mask[:, j : j + 1]
                new = s + m * z * (c - s)
                if keep:
                    tape.append((k, j, s, z, r, c))
                s = new
                all_s[:, j] = s
            states.append(all_s)
        a = np.concatenate(states, 2)
        e = a @ p["att"]
        e = np.where(mask > 0, e, -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        w = e / e.sum(axis=1, keepdims=True)
        pooled = (a * w[:, :, None]).sum(axis=1)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (mask, tape, a, w, pooled)) if keep else logit

    def backward(self, index, vec, saved, d_logit):
        """Gradients of all parameters but the embeddings, and of the vectors."""
        p, h = self.p, HIDDEN
        mask, tape, a, w, pooled = saved
        g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_pool = d_logit[:, None] * p["out"]
        d_w = (a * d_pool[:, None, :]).sum(axis=2)
        d_e = w * (d_w - (w * d_w).sum(axis=1, keepdims=True)) * mask
        g["att"] = np.einsum("nth,nt->h", a, d_e)
        d_a = w[:, :, None] * d_pool[:, None, :] + d_e[:, :, None] * p["att"]
        d_vec = np.zeros_like(vec)
        d_s, at = {}, {"f": 0, "b": h}
        for k in "fb":
            g |= {f"u{k}": np.zeros_like(p[f"u{k}"])}
            d_s[k] = np.zeros((len(index), h), np.float32)
        d_x = {k: np.zeros((len(vec), 3 * h), np.float32) for k in "fb"}
        for k, j, s, z, r, c in reversed(tape):
            u, m = p[f"u{k}"], mask[:, j : j + 1]
            d = d_s[k] + d_a[:, j, at[k] : at[k] + h]
            dz = d * m * (c - s) * z * (1 - z)
            dc = d * m * z * (1 - c * c)
            d_rs = dc @ u[:, 2 * h :].T
            dr = d_rs * s * r * (1 - r)
            g[f"u{k}"][:, 2 * h :] += (r * s).T @ dc
            zr = np.concatenate((dz, dr), 1)
            g[f"u{k}"][:, : 2 * h] += s.T @ zr
            d_s[k] = d * (1 - m * z) + d_rs * r + zr @ u[:, : 2 * h].T
            np.add.at(d_x[k], index[:, j], np.concatenate((zr, dc), 1))
        for k in "fb":
            d_x[k][-1] = 0
            g[f"w{k}"] = vec.T @ d_x[k]
            g[f"c{k}"] = d_x[k].sum(axis=0)
            d_vec += d_x[k] @ p[f"w{k}"].T
        return g, d_vec

    def fit(self, texts: list[str], toxic: np.ndarray, seed: int = 5) -> None:
        y = toxic.astype(np.float32)
        if not len(y) or y.min() == y.max():
            return
        data, offsets = kernels.utf8(pa.array(texts, pa.large_string()), lower=True)
        word, per, gram, first, count, start = read(data, offsets)
        row = np.repeat(np.arange(len(y)), per)
        # smoothed log odds by documents: in how many toxic and clean ones a slot occurs
        own = toxic.astype(np.int64)[row]

        def odds(pos, all_):
            p1, p0 = (pos + 1.0) / (y.sum() + 2), (all_ - pos + 1.0) / ((1 - y).sum() + 2)
            return np.clip(np.log(p1 / p0) * (all_ / (all_ + SHRINK)), -2, 4).astype(np.float32)

        self.others = []
        for name, slot, of in (("word_odds", word, row), ("gram_odds", gram[_runs(first, count)], np.repeat(row, count)), ("start_odds", start, row)):
            pos, all_ = (np.zeros(len(getattr(self, name)), np.int64) for _ in range(2))
            edge = np.searchsorted(of, np.arange(len(y) + 1))
            for a, b, mark in zip(edge[:-1].tolist(), edge[1:].tolist(), y.tolist(), strict=True):
                s = np.unique(slot[a:b])
                all_[s] += 1
                pos[s] += int(mark)
            setattr(self, name, odds(pos, all_))
            # without the document itself: a clean one, a toxic one
            rest = np.maximum(all_ - 1, 0)
            self.others.append(np.stack([odds(np.minimum(pos, rest), rest), odds(np.maximum(pos - 1, 0), rest)]))
        index, doc = windows(per)
        rng = np.random.default_rng(seed)
        moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step, peak = 0, None
        order_doc = np.searchsorted(doc, np.arange(len(y) + 1))
        per_round = -(-(len(y) + int((y == 0).sum())) // 256)
        rounds = max(ROUNDS, -(-LEAST_STEPS // per_round))
        for epoch in range(rounds):
            if epoch % max(1, rounds // 15):
                pass  # with many short rounds the windows are chosen anew 15 times
            elif peak is None:
                vec = self.vectors(word, gram, first, count, start, own)
                best = np.concatenate((vec[:, DIMS] + vec[:, -2] + vec[:, -1], [-9]))[index].max(axis=1)
            else:
                vec = self.vectors(word, gram, first, count, start, own)
                best = np.concatenate([self.forward(index[k : k + 8192], vec) for k in range(0, len(index), 8192)])
            rank = np.lexsort((-best, doc))
            peak = rank[order_doc[:-1]]
            extra = order_doc[:-1] + (rng.random(len(y)) * np.diff(order_doc)).astype(np.int64)
            use = np.concatenate((peak, extra[y == 0]))
            rng.shuffle(use)
            weight = np.where(y > 0, POSITIVE / y.mean(), (1 - POSITIVE) / (1 - y.mean())).astype(np.float32)
            for k in range(0, len(use), 256):
                b = use[k : k + 256]
                words_, inv = np.unique(index[b], return_inverse=True)
                ids = words_[words_ >= 0]
                local = inv.reshape(len(b), -1) - int(words_[0] < 0)
                v = self.vectors(word[ids], gram, first[ids], count[ids], start[ids], own[ids])
                logit, saved = self.forward(local, v, keep=True)
                target, wt = y[doc[b]], weight[doc[b]]
                d_logit = ((_sigmoid(logit) - target) * wt / len(b)).astype(np.float32)
                g, d_vec = self.backward(local, v, saved, d_logit)
                step += 1
                rate = 0.02 * min(1, step / 20) * (0.3 if epoch > 0.7 * rounds else 1)
                self._adam(g, moments, step, rate)
                np.add.at(self.p["word"], word[ids], -EMBED * rate * d_vec[:-1, :DIMS])
                c, f = count[ids], first[ids]
                np.add.at(self.p["gram"], gram[_runs(f, c)], -EMBED * rate * np.repeat(d_vec[:-1, DIMS + 1 : -2] / c[:, None], c, axis=0))
        del self.others
        self.fitted = True

    def _adam(self, g, moments, step, rate):
        for k, v in g.items():
            v = v + 1e-4 * self.p[k]
            m, s = moments[k]
            m += 0.1 * (v - m)
            s += 0.001 * (v * v - s)
            self.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def logits(self, column: pa.Array) -> np.ndarray:
        """That of each text's worst window."""
        out = np.zeros(len(column))
        data, offsets = kernels.utf8(column, lower=True)
        for i, j, part, at in kernels.blocks(data, offsets, BLOCK):
            word, per, gram, first, count, start = read(part, at)
            vec = self.vectors(word, gram, first, count, start)
            index, doc = windows(per)
            logit = np.concatenate([self.forward(index[k : k + 4096], vec) for k in range(0, len(index), 4096)])
            out[i:j] = np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(j - i)))
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(column))
        return _sigmoid(self.logits(column))


def windows(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (-1: none) of the overlapping windows of rows of ``per`` words,
    and the row of each window; a row has one at least."""
    many = 1 + np.maximum(0, -(-(per - WINDOW) // STRIDE))
    doc = np.repeat(np.arange(len(per)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    begin = np.cumsum(per) - per
    index = (k * STRIDE)[:, None] + np.arange(WINDOW)
    return np.where(index < per[doc][:, None], index + begin[doc][:, None], -1), doc


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Network:
    """Learn from at most about ``per_class`` toxic documents outside the held-out fold
    and ``CLEAN`` times as many clean ones.  Ids are drawn from the labels first, ``SPARE`` times as many
    for those that have no document or a long one; they are bounded by a limit, so
    they are broadcast and no text is shuffled."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~common.is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = (F.xxhash64(F.lit("sample"), F.col("doc_id")), "doc_id")
    most = {1: per_class, 0: CLEAN * per_class}
    ids = [marked.filter(F.col("toxic") == value).orderBy(*order).limit(SPARE * n) for value, n in most.items()]
    pool = docs.select("doc_id", "text").join(F.broadcast(common.stage(ids[0].unionByName(ids[1]), "drawn")), "doc_id")
    rows = common.bounded_sample(pool, "doc_id", "toxic", most, MAX_CHARS).collect()
    net = Network()
    net.fit([r["text"] for r in rows], np.array([int(r["toxic"]) for r in rows]))
    del rows
    common.give_back()
    return net


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    net = fit(docs, common.table(spark, sf_dir, "labels"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(batch.column(1)))], ["doc_id", "score"])

    out = common.arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double")
    return out.select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score ``THRESHOLD`` or more go."""
    net = fit(docs, common.table(spark, sf_dir, "labels"))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(net.score(batch.column(at)) < THRESHOLD))

    return common.arrow_map(docs, run, docs.schema)
