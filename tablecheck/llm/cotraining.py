"""Quality by co-training.

Two views of a document have a classifier each: the text view sees hashed words and shapes of the text, the metadata
view sees source, language, length and the page that shows the document (its host and its path's depth). Both start
from a bounded sample of the labelled rows. In each round, each classifier is calibrated on rows held back, scores all documents
without a label and hands those of which it is surest (SURE at least, a bounded number) to the other; a view that cannot
tell hands nothing on. In the end the log-odds of the calibrated views are added, each weighted by how well it
separates, to score every document.

Defined cases: null text is empty, null metadata is a value of its own, a negative length counts as 0; a text of any length is
read whole; without labels of both kinds every score is 0.5 and everything is kept; of labels that contradict each other
the least counts; rows without doc_id are scored, but have no page and teach nothing; repeated rows give repeated results;
of several pages of one document the least url counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Adam, collected, forget, map_texts, sample_rows, written

SCHEMA = "doc_id long, text_score double, meta_score double, score double, kept boolean"
BITS = 13
#: Part of the documents without a label that a view hands on in a round at most.
SHARE = 0.05
#: Calibrated log-odds from which a view is sure: 19 to 1.
SURE = float(np.log(19))
DENSE = 10


def _hash(x: str) -> int:
    return crc32(x.encode()) & (1 << BITS) - 1


def text_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Dense shapes of a text, and the buckets of its distinct words."""
    raw = text.encode()
    words = raw.split()
    n, chars = len(words), max(1, len(raw))
    less = lambda drop: (len(raw) - len(raw.translate(None, drop))) / chars
    distinct = set(words)
    dense = [
        less(b"#*$%&<>") * 10,
        less(b"|") * 20,
        less(b"!") * 20,
        less(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 5,
        less(b"0123456789") * 10,
        less(b".") * 20,
        np.log1p(n) / 5,
        len(distinct) / max(1, n),
        sum(map(len, words)) / max(1, n) / 8,
        1.0 if n < 10 else 0.0,
    ]
    return np.array(dense), np.fromiter({crc32(w.lower()) & (1 << BITS) - 1 for w in distinct}, np.int64)


def meta_features(source, lang, n_chars, url) -> np.ndarray:
    """Buckets of the metadata."""
    host = (url or "").partition("://")[2].partition("/")[0].lower()
    names = [f"source={source}", f"lang={lang}", f"size={int(np.log2(max(n_chars or 0, 0) + 1))}", f"host={'.'.join(host.split('.')[-3:])}", f"page={bool(url)}", f"top={host.rpartition('.')[2]}"]
    return np.array([_hash(x) for x in names])


class View:
    """A logistic classifier over dense values and hashed buckets."""

    def __init__(self, dense: int):
        self.w, self.d, self.b = np.zeros(1 << BITS), np.zeros(dense), np.zeros(1)
        self.mean, self.spread = np.zeros(dense), np.ones(dense)
        self.slope, self.shift, self.weight = 1.0, 0.0, 1.0

    def logit(self, dense: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(sizes)), sizes)
        sums = np.bincount(row, self.w[flat], minlength=len(sizes)) / np.sqrt(np.maximum(sizes, 1))
        return sums + ((dense - self.mean) / self.spread) @ self.d + self.b[0]

    def fit(self, dense: np.ndarray, flat: np.ndarray, sizes: np.ndarray, y: np.ndarray, rounds: int = 150) -> None:
        self.w[:], self.d[:], self.b[:] = 0, 0, 0
        if dense.shape[1]:
            self.mean, self.spread = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        row, adam = np.repeat(np.arange(len(sizes)), sizes), Adam(0.05)
        weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
        arrays, x = {"w": self.w, "d": self.d, "b": self.b}, (dense - self.mean) / self.spread
        scale = 1 / np.sqrt(np.maximum(sizes, 1))
        for _ in range(rounds):
            g = (1 / (1 + np.exp(-self.logit(dense, flat, sizes))) - y) * weight
            adam.step(arrays, {"w": np.bincount(flat, (g * scale)[row], minlength=1 << BITS) + 1e-5 * self.w, "d": x.T @ g + 1e-4 * self.d, "b": g.sum(keepdims=True)})

    def calibrate(self, logit: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling, and how much better than the base rate the view predicts, as its weight."""
        a = np.array([1.0, 0.0])
        adam = Adam(0.05)
        for _ in range(300):
            p = 1 / (1 + np.exp(-(a[0] * logit + a[1])))
            adam.step({"a": a}, {"a": np.array([((p - y) * logit).mean() + 1e-3 * a[0], (p - y).mean()])})
        self.slope, self.shift = float(max(a[0], 0.0)), float(a[1])
        p = np.clip(1 / (1 + np.exp(-(self.slope * logit + self.shift))), 1e-6, 1 - 1e-6)
        rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        base = -(rate * np.log(rate) + (1 - rate) * np.log(1 - rate))
        self.weight = float(np.clip(1 + (y * np.log(p) + (1 - y) * np.log(1 - p)).mean() / base, 0, 1))

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return self.slope * logit + self.shift


def features(k: int, row: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Dense values and buckets of one view; row: the text, or source, lang, n_chars and url."""
    return (np.zeros(0), meta_features(*row)) if k else text_features(row[0] or "")


def gathered(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense values, all buckets, and how many each row has."""
    return np.array([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.array([len(r[1]) for r in rows], np.int64)


class Pair:
    """Both views, and the prior log-odds that both of them hold."""

    def __init__(self):
        self.text, self.meta, self.prior, self.trained = View(DENSE), View(0), 0.0, False

    @classmethod
    def train(cls, rows: list[tuple], pool=None, rounds: int = 2, handed: int = 100) -> Pair:
        """rows: text, source, lang, n_chars, url, label (1 good, 0 bad). pool: gives the surest documents of a view, as Pool does."""
        pair = cls()
        label = np.array([int(r[5] != 0) for r in rows], np.int64)
        if not ((label == 0).any() and (label == 1).any()):
            return pair
        both = [[features(0, r[:1]) for r in rows], [features(1, r[1:5]) for r in rows]]
        hold = np.random.default_rng(7).permutation(len(rows))[: len(rows) // 4]
        learn = np.setdiff1d(np.arange(len(rows)), hold)
        taught: list[list[tuple]] = [[], []]  # features and label, from the other view
        good = max(1, round(handed * label.mean()))
        at = hold if len(set(label[hold].tolist())) == 2 else np.arange(len(rows))
        for turn in range(rounds + 1):
            for k, view in enumerate(pair.views):
                y = np.concatenate([label[learn], [t[1] for t in taught[k]]]).astype(float)
                if len(set(y.tolist())) == 2:
                    view.fit(*gathered([both[k][i] for i in learn] + [t[0] for t in taught[k]]), y)
                view.calibrate(view.logit(*gathered([both[k][i] for i in at])), label[at].astype(float))
            if turn == rounds or pool is None:
                break
            for k in (0, 1):
                taught[1 - k] += pool.surest(pair, k, good, max(1, handed - good))
        rate = label.mean()
        pair.prior, pair.trained = float(np.log(rate / (1 - rate))), True
        return pair

    @property
    def views(self) -> tuple[View, View]:
        return self.text, self.meta

    def logits(self, k: int, rows: list[tuple]) -> np.ndarray:
        """Calibrated log-odds of one view; rows: the text, or source, lang, n_chars and url."""
        if not rows:
            return np.zeros(0)
        return self.views[k].calibrated(self.views[k].logit(*gathered([features(k, r) for r in rows])))

    def text_logits(self, all_texts: list[str | None]) -> np.ndarray:
        return self.logits(0, [(t,) for t in all_texts]) if self.trained else np.zeros(len(all_texts))

    def combine(self, a: np.ndarray, metadata: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text, metadata and combined probabilities, from the text view's log-odds and (source, lang, n_chars, url)."""
        if not self.trained or not metadata:
            return tuple(np.full(len(metadata), 0.5) for _ in range(3))
        b = self.logits(1, metadata)
        both = self.prior + self.text.weight * (a - self.prior) + self.meta.weight * (b - self.prior)
        return tuple(1 / (1 + np.exp(-np.clip(z, -40, 40))) for z in (a, b, both))

    def score(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.combine(self.text_logits([r[0] for r in rows]), [tuple(r[1:5]) for r in rows])


def with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """rows with the url of the page that shows the document: its path's last number is the document's."""
    number = F.regexp_extract(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1), r"/(\d{1,18})(?:\.html?|/)?$", 1)
    urls = pages.where(number != "").select(number.cast("long").alias("_page"), "url").groupBy("_page").agg(F.min("url").alias("_url"))
    return rows.join(urls, F.col("doc_id") == F.col("_page"), "left").withColumn("url", F.col("_url")).drop("_page", "_url")


class Pool:
    """All documents without a label."""

    def __init__(self, docs: DataFrame, pages: DataFrame, marked: DataFrame, sample_bytes: int):
        known = docs.where("doc_id is not null").select("doc_id", "source", "lang", "n_chars")
        self.docs, self.bytes, self.taken = docs, sample_bytes, ([], [])
        self.marked = marked.select("doc_id")
        self.meta = written(with_pages(known.join(self.marked, "doc_id", "left_anti"), pages))

    def scored(self, pair: Pair, k: int) -> DataFrame:
        """doc_id and log-odds of all documents of the pool in one view."""
        columns, schema = (["source", "lang", "n_chars", "url"] if k else ["text"]), "doc_id long, logit double"

        def work(part: pa.RecordBatch) -> dict:
            rows = list(zip(*(part.column(c).to_pylist() for c in columns), strict=True))
            return {"doc_id": part.column("doc_id"), "logit": pair.logits(k, rows)}

        if k:
            return map_texts(self.meta.select("doc_id", *columns), work, schema, column="url")
        scored = map_texts(self.docs.where("doc_id is not null").select("doc_id", "text"), work, schema)
        return scored.where(F.abs("logit") > SURE).join(self.marked, "doc_id", "left_anti")

    def surest(self, pair: Pair, k: int, good: int, bad: int) -> list[tuple]:
        """Features for the other view, and labels, of at most good and bad documents that view k has not handed on before."""
        spark = self.docs.sparkSession
        scored = written(self.scored(pair, k).where(F.abs("logit") > SURE))
        left = scored
        if self.taken[k]:
            left = scored.join(F.broadcast(spark.createDataFrame([(i,) for i in self.taken[k]], "doc_id long")), "doc_id", "left_anti")
        tie = F.xxhash64(F.col("doc_id").cast("string"), F.lit(17))
        top = [left.where(f"logit * {sign} > 0").orderBy(F.col("logit") * -sign, tie, "doc_id").limit(n) for sign, n in ((1, good), (-1, bad))]
        chosen = {r.doc_id: int(r.logit > 0) for r in top[0].union(top[1]).collect()}
        forget(scored)
        if not chosen:
            return []
        self.taken[k].extend(chosen)
        ids = spark.createDataFrame(list(chosen.items()), "doc_id long, label int")
        if k:
            return [(features(0, (r.text,)), r.label) for r in collected(self.docs, ids, ["text"], self.bytes)]
        columns = ["source", "lang", "n_chars", "url"]
        rows = self.meta.select("doc_id", *columns).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(*columns)).alias("row")).orderBy("doc_id").collect()
        return [(features(1, tuple(r.row)), r.label) for r in rows]


def fit(docs: DataFrame, pages: DataFrame, labels: DataFrame, sample_labelled: int = 2000, sample_bytes: int = 32_000_000, rounds: int = 2, handed: int = 100) -> Pair:
    """Train on at most sample_labelled labelled documents (whole texts, sample_bytes in all at most) and on what the views hand each other:
    in each of the rounds, of all documents without a label, the `handed` ones of which a view is surest, SHARE of them at most."""
    docs = docs.select("doc_id", "text", "source", "lang", "n_chars")
    marked = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = sample_rows(marked, "doc_id", sample_labelled)
    rows = collected(with_pages(docs.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi"), pages), ids, ["text", "source", "lang", "n_chars", "url"], sample_bytes)
    pool = Pool(docs, pages, marked, sample_bytes)
    most = min(handed, int(SHARE * pool.meta.count()))
    pair = Pair.train([(r.text, r.source, r.lang, r.n_chars, r.url, r.quality) for r in rows], pool if most > 1 else None, rounds, most)
    forget(pool.meta)
    return pair


def apply(docs: DataFrame, pages: DataFrame, pair: Pair, least: float = 0.5) -> DataFrame:
    """doc_id, text_score, meta_score, score, kept for each row of docs. Texts are read where they lie: only scores and metadata meet the pages."""

    def read(part: pa.RecordBatch) -> dict:
        kept = {c: part.column(c) for c in ("doc_id", "source", "lang", "n_chars")}
        return kept | {"text_logit": pair.text_logits(part.column("text").to_pylist())}

    def judge(part: pa.RecordBatch) -> dict:
        metadata = list(zip(*(part.column(c).to_pylist() for c in ("source", "lang", "n_chars", "url")), strict=True))
        a, b, both = pair.combine(part.column("text_logit").to_numpy(zero_copy_only=False), metadata)
        return {"doc_id": part.column("doc_id"), "text_score": a, "meta_score": b, "score": both, "kept": both >= least}

    logits = map_texts(docs.select("doc_id", "text", "source", "lang", "n_chars"), read, "doc_id long, source string, lang string, n_chars long, text_logit double")
    return map_texts(with_pages(logits, pages), judge, SCHEMA, column="url")
