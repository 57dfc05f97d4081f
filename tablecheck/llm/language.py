"""Language identification of whole, possibly code-switched texts.

A linear-chain CRF labels each word: affix, character n-gram and lexicon features give a word's scores, learned
transitions tie neighbours, and forward-backward gives posteriors. A document takes the language with the largest
posterior mass over its words that have a letter; a word of any length counts with all its characters. Training runs in
numpy on a bounded sample (`sample_docs`, `sample_bytes`) of documents that are not held out; sequences with switches are
spliced from runs of words of several documents.

Defined cases: a null text and a text without a letter give `und` with score 0; so does every text when no document
teaches a language; a null lang teaches nothing; a null doc_id is not held out; a text of any length counts whole;
repeated rows give repeated results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import crf
from .common import Adam, collected, map_texts, remainder, texts

SCHEMA = "doc_id long, lang_pred string, score double, n_letter_words long, n_switches long"
FOLDS, HELD_OUT = 4, 2
BITS = 15
#: Characters of the words whose scores are kept.
CACHE_CHARS = 8_000_000
EDGES = " .,;:!?()[]{}<>\"'|*#$%&/+=~^`_-0123456789"


def _mixed(x: np.ndarray, kind: int) -> np.ndarray:
    """A bucket for each hash of a kind of feature."""
    x = (x ^ np.uint64(kind * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    return ((x >> np.uint64(32)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def word_hashes(words: list[str]) -> np.ndarray:
    """A hash of each word as a whole."""
    codes, starts, lens, place = _codes(words)
    return _whole(codes, starts, place) if len(words) else np.zeros(0, np.uint64)


_BASE = np.uint64(0x100000001B3)
_STEP = np.uint64(0x5851F42D4C957F2D)


def _codes(words: list[str]):
    edged = [f"^{w}$" for w in words]
    codes = np.frombuffer("".join(edged).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lens = np.array([len(w) for w in edged], np.int64)
    starts = np.cumsum(lens) - lens
    return codes, starts, lens, np.arange(len(codes)) - np.repeat(starts, lens)


def _whole(codes, starts, place) -> np.ndarray:
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    return np.add.reduceat((codes + np.uint64(7)) * powers[place], starts)


def word_features(words: list[str], lexicon: np.ndarray, lexicon_lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all words, and the word that each belongs to.

    Features are the word, its prefixes and suffixes of one to four letters, its 2- and 3-grams with its edges, and
    the language whose lexicon holds it. lexicon: sorted hashes of words, with their languages.
    """
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, starts, lens, place = _codes(words)
    owner = np.repeat(np.arange(len(words)), lens)
    every = np.arange(len(words))
    whole = _whole(codes, starts, place)
    ids, owners = [_mixed(whole, 1)], [every]
    left = lens[owner] - place  # characters from here to the end of the word
    gram = codes.copy()
    for k in (2, 3):
        gram = gram[:-1] * _STEP + codes[k - 1 :]
        at = np.flatnonzero(left[: len(gram)] >= k)
        ids.append(_mixed(gram[at], k))
        owners.append(owner[at])
    head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for k in range(1, 5):
        at = np.flatnonzero(lens - 2 >= k)
        head[at] = head[at] * _STEP + codes[starts[at] + k]
        tail[at] = tail[at] * _STEP + codes[starts[at] + lens[at] - 1 - k]
        ids += [_mixed(head[at], 10 + k), _mixed(tail[at], 20 + k)]
        owners += [at, at]
    if len(lexicon):
        near = np.minimum(np.searchsorted(lexicon, whole), len(lexicon) - 1)
        at = np.flatnonzero(lexicon[near] == whole)
        ids.append(_mixed(lexicon_lang[near[at]].astype(np.uint64), 30))
        owners.append(at)
    return np.concatenate(ids), np.concatenate(owners)


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def cleaned(word: str) -> str:
    return word.lower().strip(EDGES)


class LanguageModel:
    def __init__(self, langs: list[str], lexicon: dict[str, int]):
        k = len(langs)
        self.langs = langs
        hashes, lang = word_hashes(list(lexicon)), np.array(list(lexicon.values()), np.int64)
        order = np.argsort(hashes, kind="stable")
        self.lexicon, self.lexicon_lang = hashes[order], lang[order]
        self.weights, self.trans, self.start = np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k)

    @classmethod
    def train(cls, docs: list[tuple[str, str]], sequences: int = 1200, rounds: int = 40, per_lexicon: int = 200) -> LanguageModel:
        """docs: text and language."""
        by = defaultdict(list)
        for text, lang in docs:
            if words := (text or "").split():
                by[lang].append(words)
        langs = sorted(by)
        often = [Counter(cleaned(w) for words in by[x] for w in words if has_letter(w)) for x in langs]
        lexicon: dict[str, int] = {}
        for k, count in enumerate(often):
            for word, n in count.most_common(per_lexicon):
                if word and n * 2 > sum(c[word] for c in often):
                    lexicon[word] = k
        model = cls(langs, lexicon)
        if not langs:
            return model
        rng, index, flat, gold, lens = np.random.default_rng(5), {}, [], [], []
        for i in range(sequences):
            # one sequence in three switches language, the others hold one document's run
            parts, total = rng.integers(2, 5) if i % 3 == 0 and len(langs) > 1 else 1, 0
            for _ in range(parts):
                k = int(rng.integers(len(langs)))
                words = by[langs[k]][int(rng.integers(len(by[langs[k]])))]
                n = int(rng.integers(8, 60))
                at = int(rng.integers(max(1, len(words) - n + 1)))
                run = words[at : at + n]
                flat += [index.setdefault(w, len(index)) for w in run]
                gold += [k] * len(run)
                total += len(run)
            lens.append(total)
        letter = np.array([has_letter(w) for w in index])
        ids, owner = word_features([cleaned(w) for w in index], model.lexicon, model.lexicon_lang)
        ids, owner = ids[letter[owner]], owner[letter[owner]]
        tokens, y, n = np.array(flat), np.array(gold), np.array(lens)
        arrays, adam = {"w": model.weights, "t": model.trans, "s": model.start}, Adam(0.05)

        def pooled(values: np.ndarray, by_row: np.ndarray, rows: int) -> np.ndarray:
            return np.stack([np.bincount(by_row, values[:, k], minlength=rows) for k in range(len(langs))], axis=1)

        for _ in range(rounds):
            word_scores = pooled(model.weights[ids], owner, len(index))
            _, d_em, d_t, d_s = crf.loss_and_gradient(word_scores[tokens], n, y, model.trans, model.start)
            d_word = pooled(d_em, tokens, len(index))
            adam.step(arrays, {"w": pooled(d_word[owner], ids, 1 << BITS) + 1e-6 * model.weights, "t": d_t, "s": d_s})
        return model

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word and whether it has a letter."""
        letter = np.array([has_letter(w) for w in words], bool)
        out = np.zeros((len(words), len(self.langs)))
        lo = 0
        while lo < len(words):  # features of so many words or characters are held at a time; a longer word stands alone
            hi, total = lo, 0
            while hi < len(words) and (hi == lo or hi - lo < 20_000 and total + len(words[hi]) <= 1_200_000):
                total += len(words[hi])
                hi += 1
            ids, owner = word_features([cleaned(w) for w in words[lo:hi]], self.lexicon, self.lexicon_lang)
            for k in range(len(self.langs)):
                out[lo:hi, k] = np.bincount(owner, self.weights[ids, k], minlength=hi - lo) * letter[lo:hi]
            lo = hi
        return out, letter


class Scorer:
    """Keeps the scores of the words seen so far, until they hold CACHE_CHARS characters."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        k = len(self.model.langs)
        self.index: dict[str, int] = {}
        self.held = 0
        self.scores, self.letter = np.zeros((0, k)), np.zeros(0, bool)

    def __call__(self, all_texts: list[str]) -> tuple[list[str], list[float], list[int], list[int]]:
        if self.held > CACHE_CHARS:
            self.clear()
        index, tokens, lens = self.index, [], []
        for text in all_texts:
            words = text.split()
            tokens.append(np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)))
            lens.append(len(words))
        if len(index) > len(self.letter):
            new = list(index)[len(self.letter) :]
            scores, letter = self.model.word_scores(new)
            self.held += sum(map(len, new)) + 10 * len(new)
            self.scores, self.letter = np.concatenate([self.scores, scores]), np.concatenate([self.letter, letter])
        ids, n = np.concatenate(tokens), np.array(lens)
        post, _, _ = crf.forward_backward(self.scores[ids], n, self.model.trans, self.model.start)
        has = self.letter[ids]
        row = np.repeat(np.arange(len(n)), n)
        mass = np.stack([np.bincount(row, post[:, k] * has, minlength=len(n)) for k in range(post.shape[1])], axis=1)
        total = np.bincount(row, has, minlength=len(n)).astype(np.int64)
        best = mass.argmax(axis=1)
        label = np.where(has, post.argmax(axis=1), -1)[has] if len(has) else np.zeros(0, int)
        at = row[has]
        turns = np.bincount(at[1:][(label[1:] != label[:-1]) & (at[1:] == at[:-1])], minlength=len(n)) if len(at) else np.zeros(len(n), int)
        share = np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0)
        names = [self.model.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        return names, np.clip(share, 0, 1), total, turns


def apply(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""
    held: list[Scorer] = []

    def work(part: pa.RecordBatch) -> dict:
        if not model.langs:
            n = part.num_rows
            return {"doc_id": part.column("doc_id"), "lang_pred": ["und"] * n, "score": [0.0] * n, "n_letter_words": [0] * n, "n_switches": [0] * n}
        if not held:
            held.append(Scorer(model))
        names, share, total, turns = held[0](texts(part))
        return {"doc_id": part.column("doc_id"), "lang_pred": names, "score": share, "n_letter_words": total, "n_switches": turns}

    out = map_texts(docs.select("doc_id", "text"), work, SCHEMA, most=4_000_000)
    return out.withColumn("held_out", F.coalesce(remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)))


def fit(docs: DataFrame, sample_docs: int = 600, sample_bytes: int = 32_000_000) -> LanguageModel:
    """Train on at most `sample_docs` documents that are not held out: whole texts, sample_bytes in all at most.

    Languages take turns in the sample, so that a rare one is learned as well.
    """
    pool = docs.select("doc_id", "text", "lang").where((remainder("doc_id", FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(17)), "doc_id"))
    ids = pool.select("doc_id", "lang").withColumn("turn", turn).where(F.col("turn") <= sample_docs).orderBy("turn", "lang", "doc_id").limit(sample_docs)
    rows = collected(pool, ids.select("doc_id").distinct(), ["text", "lang"], sample_bytes)
    return LanguageModel.train([(r.text, r.lang) for r in rows])
