"""Quality rules by line labelling.

A linear-chain CRF over the lines of a document marks each line as content or boilerplate; Viterbi decoding gives
the labels and the share of words in content lines decides whether the document stays. The CRF is trained in numpy on
a bounded sample of labelled documents (`sample_docs`, `sample_bytes`). No line carries a label, so two sources teach it, in any
language: a line of a document labelled low in quality is junk, and a line that many different documents of the sample
begin or end with, while most lines of those documents are rare, is a notice; both are boilerplate, the others content.
Features are shapes of a line, its place, repeats in its document, and its first and last words, hashed.

Words are `[^\\x20\\x09-\\x0D]+`. Defined cases: a null or empty text has no words, fails the base rules and is not
kept; a line without words is labelled with its neighbours but has no weight; a text of any length is labelled whole;
repeated rows give repeated results; with no labels at all every line is content; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .common import Adam, collected, map_texts, sample_rows, texts

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
)
SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
#: Boilerplate has two labels, so that a notice after prose and a page of junk are learned as different transitions.
CONTENT, JUNK, NOTICE = 0, 1, 2
N_LABELS = 3
#: Documents that have a line at least before it counts as a notice, how much more often it comes than a usual line of theirs, and its words.
NOTICE_DOCS, NOTICE_TIMES, NOTICE_WORDS = 5, 3, 3
BITS = 12


def _level(x: float, *steps: float) -> int:
    return sum(x >= s for s in steps)


#: Indicator features of a line: the width of each block.
_BLOCKS = {"words": 6, "mean": 5, "upper": 4, "symbols": 4, "digits": 3, "bars": 3, "bangs": 3, "end": 3, "seen": 2, "repeat": 4, "edge": 3, "opening": 1 << BITS, "closing": 1 << BITS}
_AT = dict(zip(_BLOCKS, np.cumsum([0, *_BLOCKS.values()][:-1]).tolist(), strict=True))
N_FEATURES = sum(_BLOCKS.values())


def line_features(lines: list[bytes]) -> tuple[list[list[int]], list[int]]:
    """For each line of a document the active features, and its number of words."""
    seen: set[bytes] = set()
    out, counts = [], []
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        chars = sum(map(len, words))
        upper = len(line) - len(line.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        digits = len(line) - len(line.translate(None, b"0123456789"))
        per = 1 / max(chars, 1)
        last = line.rstrip()[-1:]
        values = (
            _level(n, 1, 3, 6, 15, 40),
            _level(chars / max(n, 1), 3, 5, 8, 14),
            _level(upper * per, 0.05, 0.2, 0.5),
            _level(symbols * per, 0.005, 0.05, 0.15),
            _level(digits * per, 0.02, 0.15),
            _level(line.count(b"|") / max(n, 1), 0.02, 0.2),
            _level(line.count(b"!") / max(n, 1), 0.05, 0.3),
            0 if last in b"." and last else 1 if last in b"!?:;\"'" and last else 2,
            int(n > 0 and line in seen),
            _level(1 - len(set(words)) / max(n, 1), 0.3, 0.5, 0.7) if n >= 8 else 0,
            0 if i == 0 else 1 if i == len(lines) - 1 else 2,
            *(crc32(b" ".join(part).lower()) & (1 << BITS) - 1 for part in (words[:2], words[-2:])),
        )
        seen.add(line)
        out.append([at + v for at, v in zip(_AT.values(), values, strict=True)])
        counts.append(n)
    return out, counts


def notices(docs: list[list[bytes]]) -> set[bytes]:
    """Lines that many different documents have, at their edges mostly, and far more often than those documents' lines usually come: copies do not count."""
    distinct = {tuple(s for x in lines if (s := x.strip())) for lines in docs}
    count = Counter(x for lines in distinct for x in set(lines))
    edge = Counter(x for lines in distinct if lines for x in {lines[0], lines[-1]})
    usual: Counter[bytes] = Counter()
    for lines in distinct:
        if lines:
            middle = sorted(count[x] for x in lines)[(len(lines) - 1) // 2]
            usual.update({x for x in lines if count[x] >= NOTICE_TIMES * middle})
    return {x for x, n in count.items() if n >= NOTICE_DOCS and len(x.split()) >= NOTICE_WORDS and 2 * usual[x] >= n and 5 * edge[x] >= 4 * n}


class LineModel:
    """Weights of the CRF: features to the three labels, transitions, start."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.weights, self.trans, self.start = weights, trans, start

    @classmethod
    def blank(cls) -> LineModel:
        return cls(np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), np.zeros(N_LABELS))

    @classmethod
    def train(cls, docs: list[tuple[str, int]], rounds: int = 80, decay: float = 1e-4) -> LineModel:
        """docs: text and quality, 1 good and 0 bad."""
        model = cls.blank()
        feats, gold, lens = [], [], []
        split = [(text or "").encode().split(b"\n") for text, _ in docs]
        common = notices(split)
        for lines, (_, quality) in zip(split, docs, strict=True):
            f, counts = line_features(lines)
            feats += f
            lens.append(len(lines))
            gold += [NOTICE if x.strip() in common else JUNK if not quality and n else CONTENT for x, n in zip(lines, counts, strict=True)]
        if len(set(gold)) < 2:
            return model
        x, y, n = np.array(feats), np.array(gold), np.array(lens)
        arrays, adam = {"w": model.weights, "t": model.trans, "s": model.start}, Adam(0.1)
        for _ in range(rounds):
            _, d_em, d_t, d_s = crf.loss_and_gradient(arrays["w"][x].sum(axis=1), n, y, model.trans, model.start)
            d_w = np.zeros_like(model.weights)
            for k in range(N_LABELS):
                d_w[:, k] = np.bincount(x.ravel(), np.repeat(d_em[:, k], x.shape[1]), minlength=N_FEATURES)
            adam.step(arrays, {"w": d_w + decay * model.weights, "t": d_t, "s": d_s})
        return model

    def decode(self, feats: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return crf.viterbi(self.weights[feats].sum(axis=1), lens, self.trans, self.start)


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words in windows of `width` words that occur twice or more, first occurrence included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    two = np.unique(ids[:-1].astype(np.int64) << 32 | ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2].astype(np.int64) << 32 | two[2:], return_inverse=True)[1]
    _, inverse, count = np.unique(four[:n].astype(np.int64) << 32 | ids[width - 1 :], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[inverse] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n > 5:
        index: dict[bytes, int] = {}
        ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
        if len(index) < n:
            repeat = repeated_words(ids)
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeat


def apply(docs: DataFrame, model: LineModel, min_content: float = 0.4, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""

    def work(part: pa.RecordBatch) -> dict:
        all_texts = texts(part)
        base = [base_counts(x) for x in all_texts]
        feats, counts, lens = [], [], []
        for x in all_texts:
            lines = x.encode().split(b"\n")
            f, c = line_features(lines)
            feats += f
            counts += c
            lens.append(len(lines))
        n = np.array(lens)
        content = model.decode(np.array(feats), n) == CONTENT
        words = np.array(counts)
        at = np.cumsum(n) - n
        total = np.add.reduceat(words, at)
        good = np.add.reduceat(words * content, at)
        share = np.where(total > 0, good / np.maximum(total, 1), 0.0)
        failed = np.array([b[0] < min_words or 100 * b[4] > max_repeat_percent * b[0] for b in base])
        cols = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), zip(*base, strict=True), strict=True))
        return cols | {
            "doc_id": part.column("doc_id"),
            "base_failed": failed,
            "kept": ~failed & (share >= min_content),
            "content_share": share,
            "n_lines": n,
            "n_content_lines": np.add.reduceat(content.astype(np.int64), at),
        }

    return map_texts(docs.select("doc_id", "text"), work, SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_bytes: int = 32_000_000) -> LineModel:
    """Train on at most `sample_docs` labelled documents in the proportion in which labels come: whole texts, sample_bytes in all at most.

    Of labels that contradict each other the least counts.
    """
    marked = labels.select("doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = collected(docs, sample_rows(marked, "doc_id", sample_docs), ["text"], sample_bytes)
    return LineModel.train([(r.text, r.quality) for r in rows])
