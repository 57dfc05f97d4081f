"""Toxicity by a convolutional text classifier.

Words are hashed to embeddings (a word's vector mixes its own bucket and those of two prefixes), filters of several widths
slide over the text, max pooling keeps the strongest response of each filter, and a logistic layer scores the
document. All of it is trained in numpy on a bounded sample of labelled rows that are not held out. Thresholds are
calibrated by language, which a naive Bayes model guesses from the text alone; the score is shifted so that 0.5 is
the threshold of that language.

Defined cases: a null or empty text pools to zeros and gets the score of the bias; a text of any length is scored whole; with
no labelled rows every score is 0; null labels teach nothing; repeated rows give repeated results; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, bound_batches, collected, map_texts, remainder, sample_rows, texts

SCHEMA = "doc_id long, score double, predicted int"
FOLDS, HELD_OUT = 5, 0
BITS, DIM, FILTERS = 16, 16, 12
#: Shares of the word, its eight-letter and its six-letter prefix in a vector.
SHARES = (0.5, 0.3, 0.2)
WIDTHS = (1, 2, 3)
GAP = max(WIDTHS)
#: Characters of the words whose vectors are kept, and bytes of text scored at once: a Python worker's memory follows both.
CACHE_CHARS, SLICE_BYTES = 1_500_000, 500_000
WORD = re.compile(r"\w+")


def buckets(word: str) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    return tuple(crc32(x.encode()) & mask for x in (word, f"^8{word[:8]}", f"^6{word[:6]}"))


class Words:
    """Numbers for words and their buckets. Number 0 is the gap between texts."""

    def __init__(self):
        self.index: dict[str, int] = {"": 0}
        self.flat = array("i", (-1,) * len(SHARES))  # the buckets of all words, one after another
        self.held = 0

    def buckets(self) -> np.ndarray:
        """A row of buckets for each word."""
        return np.array(self.flat, np.int32).reshape(-1, len(SHARES))

    def number(self, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all texts with gaps after each, and where each text starts and ends."""
        index, parts, gap = self.index, [], np.zeros(GAP, np.int64)
        ends, starts, at = [], [], 0
        for text in all_texts:
            words = WORD.findall(text.lower())
            parts += [np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)), gap]
            starts.append(at)
            ends.append(at + len(words))
            at += len(words) + GAP
        for w in islice(index, len(self.flat) // len(SHARES), None):
            self.flat.extend(buckets(w))
            self.held += len(w) + 10
        return np.concatenate(parts) if parts else gap, np.array(starts), np.array(ends)


class ToxicModel:
    def __init__(self, langs: list[str]):
        rng = np.random.default_rng(3)
        self.langs = langs
        self.emb = (rng.standard_normal((1 << BITS, DIM)) * 0.1).astype(np.float32)
        self.conv = {w: (rng.standard_normal((w, DIM, FILTERS)) * (0.5 / np.sqrt(w * DIM))).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.out_bias = np.array([-2.0], np.float32)
        self.lang_table = np.zeros((1 << BITS, max(1, len(langs))), np.float32)
        self.threshold = np.zeros(max(1, len(langs)))
        self.trained = False

    def vectors(self, pairs: np.ndarray) -> np.ndarray:
        """A vector for each word; the gap has none."""
        rows = sum(np.float32(share) * self.emb[pairs[:, k]] for k, share in enumerate(SHARES))
        rows[pairs[:, 0] < 0] = 0
        return rows

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        n = len(x) - width + 1
        z = x[:n] @ self.conv[width][0]
        for j in range(1, width):
            z += x[j : j + n] @ self.conv[width][j]
        return z + self.bias[width]

    def pooled(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Strongest response of each filter in each text; windows run over the end of a text into its gap only."""
        out, full = np.zeros((len(starts), FILTERS * len(WIDTHS)), np.float32), np.flatnonzero(ends > starts)
        if len(full):
            edges = np.stack([starts[full], ends[full]], axis=1).ravel()
            for i, width in enumerate(WIDTHS):
                out[full, i * FILTERS : (i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(self.responses(x, width), edges, axis=0)[::2], 0)
        return out

    def logits(self, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.pooled(x, starts, ends) @ self.out + self.out_bias[0]).astype(np.float64)

    def guess(self, first: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The language of each text, from the first bucket of each of its words."""
        sums = np.zeros((len(starts), self.lang_table.shape[1]))
        full = np.flatnonzero(ends > starts)
        if len(full):
            rows = self.lang_table[first]
            rows[first < 0] = 0
            sums[full] = np.add.reduceat(rows, np.stack([starts[full], ends[full]], axis=1).ravel(), axis=0)[::2]
        return sums.argmax(axis=1)

    # training

    @classmethod
    def train(cls, docs: list[tuple[str, str | None, int]], steps: int = 500, batch: int = 48, clean_weight: float = 1.0) -> ToxicModel:
        """docs: text, language (for the calibration) and label; clean_weight: clean rows that each clean one stands for, against toxic ones."""
        model = cls(sorted({d[1] for d in docs if d[1]}))
        label = np.array([d[2] for d in docs])
        if not len(docs) or label.min() == label.max():
            return model
        words, rng = Words(), np.random.default_rng(11)
        tokens, starts, ends = words.number([d[0] or "" for d in docs])
        pairs = words.buckets()
        n = len(docs)
        lang = np.array([model.langs.index(d[1]) if d[1] else -1 for d in docs])
        # languages: naive Bayes over buckets
        count = np.full((1 << BITS, max(1, len(model.langs))), 0.5)
        for d in np.flatnonzero(lang >= 0):  # document by document: all tokens at once would take much memory
            np.add.at(count[:, lang[d]], pairs[tokens[starts[d] : ends[d]], 0], 1)
        model.lang_table = np.log(count / count.sum(axis=0)).astype(np.float32)
        model.lang_table -= model.lang_table.mean(axis=1, keepdims=True)
        # a quarter of the rows calibrates, the others train
        turn = rng.permutation(n)
        hold = np.zeros(n, bool)
        hold[turn[: n // 4]] = True
        # warm start: the first dimension holds how much likelier a bucket is in toxic documents
        pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for d in np.flatnonzero(~hold):
            (pos if label[d] else neg)[np.unique(pairs[tokens[starts[d] : ends[d]]])] += 1
        p, q = (pos + 0.2) / (label[~hold].sum() + 1), (neg + 0.6) / ((1 - label[~hold]).sum() + 1)
        model.emb[:, 0] = np.where(pos + neg >= 4, np.clip(np.log(p / q), -2, 3), 0)
        for w in WIDTHS:
            model.conv[w][0, 0, : FILTERS // 2] = 1.0
            model.bias[w][:] = -0.5
        model.out[:] = np.abs(model.out)
        arrays = {"out": model.out, "out_bias": model.out_bias} | {f"c{w}": model.conv[w] for w in WIDTHS} | {f"b{w}": model.bias[w] for w in WIDTHS}
        adam, squares = Adam(0.01), np.full((1 << BITS, 1), 1e-3, np.float32)
        pool = [np.flatnonzero(~hold & (label == k)) for k in (0, 1)]
        for _ in range(steps):
            pick = np.concatenate([rng.choice(p, batch // 2) for p in pool if len(p)])
            model._step(pick, label, tokens, pairs, starts, ends, arrays, adam, squares)
        model.trained = True
        model._calibrate(docs, np.flatnonzero(hold) if hold.sum() >= 40 else np.arange(n), clean_weight)
        return model

    def _step(self, pick, label, tokens, pairs, starts, ends, arrays, adam, squares) -> None:
        ids = np.concatenate([tokens[starts[d] : ends[d] + GAP] for d in pick])
        size = ends[pick] - starts[pick]
        s = np.cumsum(size + GAP) - size - GAP
        e = s + size
        x = self.vectors(pairs[ids])
        pooled, where = np.zeros((len(pick), FILTERS * len(WIDTHS)), np.float32), np.zeros((len(pick), FILTERS * len(WIDTHS)), np.int64)
        for i, width in enumerate(WIDTHS):
            z, cols = self.responses(x, width), slice(i * FILTERS, (i + 1) * FILTERS)
            for d in np.flatnonzero(size > 0):
                best = z[s[d] : e[d]].argmax(axis=0)
                pooled[d, cols], where[d, cols] = z[s[d] + best, np.arange(FILTERS)], s[d] + best
        active = pooled > 0
        pooled = np.maximum(pooled, 0)
        prob = 1 / (1 + np.exp(-(pooled @ self.out + self.out_bias[0])))
        d_logit = ((prob - label[pick]) / len(pick)).astype(np.float32)
        grads = {"out": pooled.T @ d_logit + 1e-3 * self.out, "out_bias": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * self.out * active
        d_x = np.zeros_like(x)
        for i, width in enumerate(WIDTHS):
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            g, at = d_pool[:, cols], where[:, cols]
            grads[f"b{width}"] = g.sum(axis=0)
            d_conv = np.zeros_like(self.conv[width])
            for j in range(width):
                d_conv[j] = np.einsum("dfk,df->kf", x[at + j], g)
                np.add.at(d_x, (at + j).ravel(), (g[:, :, None] * self.conv[width][j].T[None]).reshape(-1, DIM))
            grads[f"c{width}"] = d_conv + 1e-4 * self.conv[width]
        adam.step(arrays, grads)
        used = np.flatnonzero(np.abs(d_x).sum(axis=1))
        for column, part in enumerate(SHARES):
            rows, inverse = np.unique(pairs[ids[used], column], return_inverse=True)
            g = np.zeros((len(rows), DIM), np.float32)
            np.add.at(g, inverse, np.float32(part) * d_x[used])
            g[rows < 0] = 0
            squares[rows] += (g * g).mean(axis=1, keepdims=True)
            self.emb[rows] -= 0.05 * g / np.sqrt(squares[rows])

    def _calibrate(self, docs, rows: np.ndarray, clean_weight: float) -> None:
        """For each guessed language the threshold with the best balance of recall and precision; all rows where it has few."""
        logits, langs = [], []
        for lo in range(0, len(rows), 100):
            words = Words()
            tokens, starts, ends = words.number([docs[i][0] or "" for i in rows[lo : lo + 100]])
            pairs = words.buckets()
            logits.append(self.logits(self.vectors(pairs)[tokens], starts, ends))
            langs.append(self.guess(pairs[tokens, 0], starts, ends))
        logit, lang = np.concatenate(logits), np.concatenate(langs)
        label = np.array([docs[i][2] for i in rows])
        overall = best_threshold(logit, label, clean_weight)
        for k in range(len(self.threshold)):
            own = lang == k
            enough = min(label[own].sum(), (1 - label[own]).sum()) >= 8
            self.threshold[k] = best_threshold(logit[own], label[own], clean_weight) if enough else overall


def best_threshold(logit: np.ndarray, label: np.ndarray, clean_weight: float = 1.0) -> float:
    """The middle of the gap between scores at which F1 is greatest, in the proportion in which rows come."""
    order = np.argsort(-logit, kind="stable")
    z, y = logit[order], label[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (hits + clean_weight * np.cumsum(1 - y) + max(1, y.sum()))
    f1[np.append(z[:-1] == z[1:], False)] = -1
    best = int(f1.argmax())
    return float((z[best] + z[best + 1]) / 2) if best + 1 < len(z) else float(z[best] - 0.5)


class Scorer:
    """Scores of texts; the vectors of the words seen so far are kept, until the words hold CACHE_CHARS characters."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.words, self.pairs, self.vectors = Words(), np.zeros((0, len(SHARES)), np.int32), np.zeros((0, DIM), np.float32)

    def __call__(self, all_texts: list[str]) -> np.ndarray:
        if not self.model.trained or not all_texts:
            return np.zeros(len(all_texts))
        if self.words.held > CACHE_CHARS:
            self.clear()
        tokens, starts, ends = self.words.number(all_texts)
        if len(self.words.flat) > self.pairs.size:
            new = np.array(self.words.flat[self.pairs.size :], np.int32).reshape(-1, len(SHARES))
            self.pairs, self.vectors = np.concatenate([self.pairs, new]), np.concatenate([self.vectors, self.model.vectors(new)])
        lang = self.model.guess(self.pairs[tokens, 0], starts, ends)
        return 1 / (1 + np.exp(-(self.model.logits(self.vectors[tokens], starts, ends) - self.model.threshold[lang])))


def apply(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, score, predicted."""
    held: list[Scorer] = []

    def work(part: pa.RecordBatch) -> dict:
        if not held:
            held.append(Scorer(model))
        score = held[0](texts(part))
        return {"doc_id": part.column("doc_id"), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    bound_batches(docs.sparkSession)
    out = map_texts(docs.select("doc_id", "text"), work, SCHEMA, most=SLICE_BYTES)
    return out.withColumn("held_out", F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)))


def keep_clean(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """The rows of docs that are not predicted toxic, all columns."""
    held: list[Scorer] = []

    def work(part: pa.RecordBatch) -> dict:
        if not held:
            held.append(Scorer(model))
        keep = pa.array(held[0](texts(part)) < 0.5)
        return {c: part.column(c).filter(keep) for c in part.schema.names}

    bound_batches(docs.sparkSession)
    return map_texts(docs, work, docs.schema, most=SLICE_BYTES)


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = 1200, sample_clean: int = 2000, sample_bytes: int = 32_000_000) -> ToxicModel:
    """Train on at most sample_toxic + sample_clean labelled documents that are not held out: whole texts, sample_bytes in all at most.

    Of labels that contradict each other the greatest counts.
    """
    marked = labels.select("doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(remainder("doc_id", FOLDS) != HELD_OUT)
    ids = sample_rows(marked.where("toxic = 1"), "doc_id", sample_toxic).union(sample_rows(marked.where("toxic = 0"), "doc_id", sample_clean))
    rows = collected(docs, ids, ["text", "lang"], sample_bytes)
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = {k: sum(r.toxic == k for r in rows) for k in (0, 1)}
    weight = counts.get(0, 0) / max(1, taken[0]) / max(1e-9, counts.get(1, 0) / max(1, taken[1])) if taken[0] and taken[1] else 1.0
    return ToxicModel.train([(r.text, r.lang, int(r.toxic)) for r in rows], clean_weight=weight)
