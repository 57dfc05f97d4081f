"""Packing in the order of a space-filling curve.

A document's vector counts its hashed byte trigrams; projected to three coordinates, squashed to a grid and read along
the Hilbert curve it gives a key that keeps similar documents near each other. Documents are dealt to
ranges of that key and sorted, and each range is packed as one stream: documents follow each other with their ids, an
end id after each, cut wherever a sequence is full. Only the last sequence of a range is padded, and there are at most as
many ranges as hold MIN_SEQUENCES sequences each, so that padding stays under about half a percent.

The grid is fixed, so the key of a document depends on its text alone. Range boundaries follow the data and include
the doc_id, so that copies, which share a key, spread over many ranges. Rows that repeat a document (as mixing makes
them) are held back until APART ids of others have been packed, so that no sequence holds a document twice unless
nothing else is left, or HELD_BYTES of them wait; `copy` tells them apart. Defined cases: a null text counts as empty and has the end id alone; rows
without doc_id are packed with a null doc_id; repeated rows are packed each; a text of any length is packed whole, over as
many sequences as it takes; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heappop, heappush, heapreplace
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts, written

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, copy long"
SEQUENCE = 2048
END = 1
AXES, ORDER = 3, 10
HASHED = 4096
#: Bytes of text that a range takes, where that gives more ranges than there are shuffle partitions; sequences that it holds at least.
RANGE_BYTES, MIN_SEQUENCES = 64 << 20, 100
#: Bytes of text that an id stands for at most, on average, in any language.
ID_BYTES = 6
#: Ids between copies of a document, and bytes of copies that wait at most.
APART, HELD_BYTES = 2 * SEQUENCE, 32 << 20
#: Characters of the words, and of the pieces, whose ids are kept.
CACHE_CHARS = 16_000_000
SPACE = re.compile(r"[ \t\n\v\f\r]+")
#: Texts of these characters are lower-cased and cut here as the tokenizer does it: no marks that combine, no digits but 0 to 9.
SIMPLE = re.compile(r"[\t\n\v\f\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")
PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def hilbert(points: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Index along the Hilbert curve of points on a grid of 2**order steps an axis (Skilling's transform)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    step = 1 << (order - 1)
    while step > 1:
        low = step - 1
        for i in range(n):
            high = (x[i] & step) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, step = np.zeros(x.shape[1], np.int64), 1 << (order - 1)
    while step > 1:
        turn = np.where((x[n - 1] & step) != 0, turn ^ (step - 1), turn)
        step >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(order - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> bit) & 1
    return key


def projection() -> np.ndarray:
    """A row for each bucket of the hashed vector, a column for each axis."""
    return np.random.default_rng(31).standard_normal((HASHED, AXES))


def curve_keys(all_texts: list[str], project: np.ndarray) -> np.ndarray:
    """Curve keys of texts; project is projection()."""
    out = np.zeros((len(all_texts), AXES))
    for i, text in enumerate(all_texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        if len(raw) < 3:
            continue
        mixed = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)
        count = np.bincount(mixed >> np.uint32(20), minlength=HASHED)
        # the square root: a trigram that comes often counts for less than its number
        out[i] = np.sqrt(count) @ project / np.sqrt(len(raw))
    grid = ((np.tanh(out / 1.5) + 1) / 2 * ((1 << ORDER) - 1)).round().astype(np.int64)
    return hilbert(np.clip(grid, 0, (1 << ORDER) - 1))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, curve_key, n_bytes."""
    project = projection()

    def work(part: pa.RecordBatch) -> dict:
        text = part.column("text")
        return {"doc_id": part.column("doc_id"), "text": text, "curve_key": curve_keys(texts(part), project), "n_bytes": pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())}

    return map_texts(docs.select("doc_id", "text"), work, "doc_id long, text string, curve_key long, n_bytes long")


class Known(dict):
    """Ids of words; a word that is asked for and not known is noted."""

    def __init__(self):
        super().__init__()
        self.asked: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.asked.append(word)
        return b""


class Encoder:
    """Token ids of texts, piece by piece.

    This tokenizer lower-cases, drops white space and never joins tokens over the pieces that it cuts a text into. Words
    of a text of plain Latin characters are cut the same way here, by PIECE; other words are left to the tokenizer.
    Ids of words and pieces are kept, those of CACHE_CHARS characters at most.
    """

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)  # tokens that end a piece
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, bytes] = {}
        self.simple, self.other, self.held = Known(), Known(), 0

    def __call__(self, text: str) -> bytes:
        if SIMPLE.fullmatch(text) and "<|" not in text:
            words, known = text.lower().split(), self.simple
        else:
            words, known = [w for w in SPACE.split(text) if w], self.other
        out = b"".join(map(known.__getitem__, words))
        if known.asked:
            new, known.asked = list(dict.fromkeys(known.asked)), []
            if known is self.simple:
                self.add_simple(new)
            else:
                self.add_words(new, known)
            out = b"".join(map(known.__getitem__, words))
            self.held += sum(map(len, new)) + 60 * len(new)
            if self.held > CACHE_CHARS:
                self.clear()
        return out

    def add_simple(self, new: list[str]) -> None:
        cut = [PIECE.findall(w) for w in new]
        if pieces := list(dict.fromkeys([p for parts in cut for p in parts if p not in self.pieces])):
            self.add_pieces(pieces)
        for w, parts in zip(new, cut, strict=True):
            self.simple[w] = b"".join([self.pieces[p] for p in parts])

    def add_words(self, new: list[str], known: dict[str, bytes]) -> None:
        for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()

    def add_pieces(self, new: list[str]) -> None:
        """All in one text, parted by blanks, and cut where a piece ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(new):
            self.add_words(new, self.pieces)
            return
        raw, lo = ids.tobytes(), 0
        for w, hi in zip(new, (4 * stops).tolist(), strict=True):
            self.pieces[w] = raw[lo:hi]
            lo = hi


def encoder(vocabulary: bytes) -> Encoder:
    """One for each Python process: tasks that follow each other in it share what it has learned."""
    import sys
    from types import ModuleType

    held = sys.modules.setdefault("_tablecheck_encoders", ModuleType("_tablecheck_encoders")).__dict__
    name = f"encoder_{crc32(vocabulary)}"
    if name not in held:
        held[name] = Encoder(vocabulary)
    return held[name]


def n_ranges(n_bytes: int, partitions: int) -> int:
    """As many ranges as partitions, or as the texts ask for, but none of fewer than about MIN_SEQUENCES sequences."""
    return max(1, min(max(partitions, -(-n_bytes // RANGE_BYTES)), n_bytes // (ID_BYTES * SEQUENCE * MIN_SEQUENCES)))


def in_turn(rows: Iterator[tuple], apart: int, held_bytes: int) -> Iterator[tuple]:
    """(doc_id, text, copy) of sorted rows (doc_id, text), repeated ones held back; the caller sends how many ids it has packed."""
    last, n, packed, size, order = None, 0, 0, 0, count()
    waiting: list[list] = []  # a heap of when, order, document, next copy, how many
    entry = None
    for row in rows:
        if row != last:
            last, n, entry = row, 1, None
            packed = yield (*row, 1)
        else:
            n += 1
            if entry is not None and entry[4]:
                entry[4] += 1
            else:
                entry = [packed + apart, next(order), row, n, 1]
                heappush(waiting, entry)
                size += len(row[1] or "") + 200
        while waiting and (waiting[0][0] <= packed or size > held_bytes):
            packed = yield (*waiting[0][2], waiting[0][3])
            size -= _turned(waiting, packed + apart)
    while waiting:
        packed = yield (*waiting[0][2], waiting[0][3])
        _turned(waiting, packed + apart)


def _turned(waiting: list[list], when: int) -> int:
    """Put the first document behind, for its next copy; bytes that are free if it has none."""
    entry = waiting[0]
    entry[4] -= 1
    if entry[4]:
        entry[0], entry[3] = when, entry[3] + 1
        heapreplace(waiting, entry)
        return 0
    heappop(waiting)
    return len(entry[2][1] or "") + 200


def pack(docs: DataFrame, vocabulary: str, ranges: int | None = None) -> DataFrame:
    """Pieces of the sequences; vocabulary is the path of a tokenizer file on the driver."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        words = spark.sparkContext.broadcast(f.read())
    # written: dealing by range reads its input twice
    rows = written(keyed(docs))
    total = rows.agg(F.sum("n_bytes").alias("n")).first().n or 0
    n = ranges or n_ranges(total, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select("doc_id", "text", "curve_key")
    dealt = rows.repartitionByRange(n, "curve_key", F.xxhash64("doc_id")).sortWithinPartitions("curve_key", "doc_id", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(words.value)
        first = TaskContext.get().partitionId() << 40
        at = 0  # ids of this range so far
        end = np.array([END], "<u4").tobytes()
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        rows = (row for batch in batches for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True))
        turn, out = in_turn(rows, APART, HELD_BYTES), [[] for _ in names]
        row = next(turn, None)
        while row is not None:
            doc_id, text, copy = row
            ids = encode(text or "") + end
            total, start = len(ids) // 4, 0
            while start < total:
                offset = at % SEQUENCE
                length = min(SEQUENCE - offset, total - start)
                for column, value in zip(out, (doc_id, start, length, crc32(ids[4 * start : 4 * (start + length)]), total, first + at // SEQUENCE, offset, copy), strict=True):
                    column.append(value)
                start += length
                at += length
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
                out = [[] for _ in names]
            try:
                row = turn.send(at)
            except StopIteration:
                row = None
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)

    return dealt.mapInArrow(work, SCHEMA)
