"""Language identification: family first, then one-versus-one linear SVMs.

Features are relative frequencies of hashed byte n-grams (1 to 4 bytes) of the
lower-cased text with every run of non-letters as one space.  Linear SVMs
(squared hinge loss, L2) separate each pair of families, then each pair of
languages of one family; a logistic curve turns a margin into a probability and
pairs are averaged where there are more than two classes.  Linear models on
frequencies are sums over positions, so a text of any length is scored whole.

Fitted on a bounded sample: ``PER_LANGUAGE`` labelled rows of each language of
at most ``MAX_CHARS`` code points (1000 rows of 4 languages: some 10 MB on the
driver), and on one random short span of each, so that short texts are judged
by what they hold.  Null texts and texts without a letter are ``und`` with score
0; without any labelled row every text is.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

#: Families of languages that are easily taken for one another.
#: A language not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "da", "sv", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "pl", "cs", "sk", "sr", "hr", "sl"),
}
PER_LANGUAGE, MAX_CHARS, DIMS, ORDERS, MAX_FIT_BYTES = 600, 8000, 4096, (1, 2, 3, 4), 1 << 19

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[128:] = np.arange(128, 256)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the hashed n-gram at each position of the squeezed text
    (``DIMS`` where it would leave the row), the rows' new offsets and the
    number of n-grams of each row."""
    x = _LETTER[data]
    blank = x == 0x20
    keep = np.ones(len(x), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    x = x[keep].astype(np.uint32)
    left = np.repeat(at[1:], np.diff(at)) - np.arange(len(x))
    out, h, count = [], np.zeros(len(x), np.uint32), np.zeros(len(at) - 1, np.int64)
    for n in range(1, max(ORDERS) + 1):
        h = h * np.uint32(0x01000193)
        h[: len(x) - n + 1] += x[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            g = h * np.uint32(2654435761)
            out.append(np.where(left >= n, (g >> np.uint32(20)).astype(np.int32), DIMS))
            count += np.maximum(np.diff(at) - n + 1, 0)
    return out, at, count


def frequencies(texts: list[str]) -> np.ndarray:
    rows = np.empty((len(texts), DIMS), np.float32)
    data, offsets = kernels.utf8(pa.array(texts, pa.large_string()), lower=True)
    for i, j, part, at in kernels.blocks(data, offsets, MAX_FIT_BYTES):
        found, where, count = grams(part, at)
        m = np.zeros((j - i, DIMS + 1), np.float32)
        row = np.repeat(np.arange(j - i), np.diff(where))
        for g in found:
            m += np.bincount(row * (DIMS + 1) + g, minlength=m.size).reshape(m.shape)
        rows[i:j] = m[:, :DIMS] / np.maximum(count, 1)[:, None]
    return rows


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 150) -> tuple[np.ndarray, float]:
    """min |w|²/2 + c/n · Σ a · max(0, 1 - y(wx + b))², classes weighted alike, by
    accelerated gradient descent; y is +1 or -1."""
    a = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    v, b = np.ones(x.shape[1], np.float32), np.float32(1)  # the bias is one more input, always 1
    for _ in range(12):
        m = x @ v + b
        v, b = x.T @ m, m.sum()
        norm = float(np.sqrt(v @ v + b * b))
        v /= norm
        b /= norm
    step = 1.0 / (1e-3 + 2 * c * float(a.max()) * norm / len(y) * 1.05)
    w = np.zeros(x.shape[1] + 1, np.float32)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        r = (a * y * np.maximum(0, 1 - y * (x @ z[:-1] + z[-1]))).astype(np.float32)
        g = 1e-3 * z - (2 * c / len(y)) * np.append(x.T @ r, r.sum())
        new = z - step * g
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + ((t - 1) / t_new) * (new - w)
        w, t = new.astype(np.float32), t_new
        z = z.astype(np.float32)
    return w[:-1], float(w[-1])


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of margins (Newton's method)."""
    t = (y > 0).astype(float)
    t = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / ((1 - t).sum() + 2))
    p = np.array([2.0, 0.0])
    m = np.stack([margin, np.ones_like(margin)], 1).astype(float)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(m @ p, -30, 30)))
        h = (m * (q * (1 - q) + 1e-9)[:, None]).T @ m + 1e-4 * np.eye(2)
        p = p - np.linalg.solve(h, m.T @ (q - t) + 1e-4 * p)
    return float(max(p[0], 1e-3)), float(p[1])


class LanguageModel:
    """``families``: lists of languages; ``pairs``: what each column of ``w``
    separates, as (family or None, first class, second class)."""

    def __init__(self, rows: list[tuple[str, str]], seed: int = 7):
        languages = sorted({lang for _, lang in rows})
        named = {x: name for name, members in FAMILIES.items() for x in members}
        groups: dict[str, list[str]] = {}
        for lang in languages:
            groups.setdefault(named.get(lang, lang), []).append(lang)
        self.families = [groups[k] for k in sorted(groups)]
        self.pairs: list[tuple[int | None, int, int]] = [(None, a, b) for a, b in combinations(range(len(self.families)), 2)]
        self.pairs += [(f, a, b) for f, members in enumerate(self.families) for a, b in combinations(range(len(members)), 2)]
        self.w = np.zeros((DIMS + 1, max(1, len(self.pairs))), np.float32)
        self.b, self.curve = np.zeros(len(self.pairs)), [(1.0, 0.0)] * len(self.pairs)
        if not self.pairs:
            return
        rng, texts, labels = np.random.default_rng(seed), [], []
        for text, lang in rows:
            texts.append(text)
            labels.append(lang)
            if (parts := text.split()) and len(parts) > 12:
                at = int(rng.integers(0, len(parts) - 8))
                texts.append(" ".join(parts[at : at + int(rng.integers(3, 9))]))
                labels.append(lang)
        x = frequencies(texts)
        scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
        x *= scale
        place = {lang: (f, k) for f, members in enumerate(self.families) for k, lang in enumerate(members)}
        family, member = np.array([place[v] for v in labels]).T
        for k, (f, a, b) in enumerate(self.pairs):
            of = family if f is None else np.where(family == f, member, -1)
            use = (of == a) | (of == b)
            y = np.where(of[use] == a, 1.0, -1.0)
            mine = x if use.all() else x[use]
            w, bias = linear_svm(mine, y)
            self.w[:DIMS, k], self.b[k] = w * scale, bias
            self.curve[k] = platt(mine @ w + bias, y)
            del mine

    def margins(self, column: pa.Array) -> np.ndarray:
        data, offsets = kernels.utf8(column, lower=True)
        out = np.zeros((len(offsets) - 1, len(self.pairs)))
        for i, j, part, at in kernels.blocks(data, offsets, MAX_FIT_BYTES):
            found, where, count = grams(part, at)
            full = np.flatnonzero(np.diff(where))
            if len(full):
                for g in found:
                    for k in range(len(self.pairs)):
                        out[i + full, k] += np.add.reduceat(self.w[:, k].take(g), where[full], dtype=np.float64)
            out[i:j] /= np.maximum(count, 1)[:, None]
        return out + self.b

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        n = len(column)
        lang, score = np.full(n, "und", object), np.zeros(n)
        if not self.families:
            return lang, score
        m = self.margins(column) if self.pairs else np.zeros((n, 0))
        p = np.stack([1 / (1 + np.exp(-np.clip(s * m[:, k] + c, -30, 30))) for k, (s, c) in enumerate(self.curve)], 1) if self.pairs else m

        def shares(f, size):
            if size == 1:
                return np.ones((n, 1))
            out = np.zeros((n, size))
            for k, (of, a, b) in enumerate(self.pairs):
                if of == f:
                    out[:, a] += p[:, k]
                    out[:, b] += 1 - p[:, k]
            return out / (size * (size - 1) / 2)

        family = shares(None, len(self.families))
        best = family.argmax(axis=1)
        has = np.array([bool(t) and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
        for f, members in enumerate(self.families):
            inner = shares(f, len(members))
            rows = np.flatnonzero(has & (best == f))
            pick = inner[rows].argmax(axis=1)
            lang[rows] = np.array(members, object)[pick]
            score[rows] = family[rows, f] * inner[rows, pick]
        return lang, score


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from text and non-null lang of the rows outside the held-out fold."""
    pool = docs.select("doc_id", "text", "lang").filter(~common.is_held_out(F.col("doc_id")))
    rows = common.bounded_sample(pool, "doc_id", "lang", per_language, MAX_CHARS).collect()
    model = LanguageModel([(r["text"], r["lang"]) for r in rows])
    del rows
    common.give_back()
    return model


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of each row; other columns are not read."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = model.predict(batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    out = common.arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")), run, "id long, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs))
    return out.select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told go, that is ``und``
    and a score no better than drawing one of the learned languages."""
    model = fit(docs)
    floor = 1.0 / max(1, sum(map(len, model.families)))
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = model.predict(batch.column(at))
        return batch.filter(pa.array((lang != "und") & (score >= floor)))

    return common.arrow_map(docs, run, docs.schema)
