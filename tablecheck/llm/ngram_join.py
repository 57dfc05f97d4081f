"""Join of near copies: word 5-gram Jaccard similarity of 0.8 or more, by a MinHash LSH forest.

Words are lower-cased runs of word characters; texts with the same words are one node (a 128-bit hash of the words)
and are compared once. A node has a signature in each tree: `depth` MinHash values in order, so the sorted signatures of
a tree are a prefix trie, and nodes below one trie node share a prefix. One exchange deals all nodes by the shortest
prefix (the floor, where the modelled recall at the threshold meets the target) and leaves those that share one. In
each shared prefix all pairs are screened with 1-bit signatures, and a forest of edges is kept, each with the length of
the prefix that its ends share.

Edges are then taken from the longest prefixes first: connected groups are verified exactly on their whole sets of 5-grams,
and the share of links found is estimated by capture and recapture between the two halves of the trees, in bins of
similarity, without a model of the hashes. While too few are found, prefixes are shortened by one value and only groups
that grew are verified again; beyond the floor the exchange is repeated with shorter prefixes. The estimate looks
at ESTIMATE_LINKS links of a cell at most; every link is counted. With fewer than BIN_LINKS links in all there is
nothing to estimate from, and prefixes of the floor are taken.

Large prefixes and large groups are dealt out as a grid of blocks, so no task holds more than two blocks; pairs are
counted inside the tasks and never written out.

Result: one row for each row of docs, with class_id (the least doc_id of the connected texts), n_links (other texts
at or above the threshold) and n_copies (rows with the same words). Defined cases: a text with fewer than five words
is one gram of all its words; a null text, a text without words and a row without doc_id link with nothing
and are classes of their own; repeated rows are copies; rows that share a doc_id and differ in text are different
texts; a text of any length is compared as a whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, map_texts, texts, unused, written
from .components import connected

GRAM = 5
#: Characters hashed at a time.
STRETCH = 1 << 18
#: Nodes in a block of a prefix.
SCREEN_BLOCK = 1024
#: A group to verify has blocks of VERIFY_BLOCK nodes, but no more than VERIFY_BLOCKS of them until they hold VERIFY_LARGE; and of VERIFY_CHARS characters at most.
VERIFY_BLOCK, VERIFY_BLOCKS, VERIFY_LARGE, VERIFY_CHARS = 256, 16, 1536, 6_000_000
#: So many ids at most are broadcast to the texts; more are joined by key.
MAX_BROADCAST_ROWS = 200_000
#: Standard deviations below the expected agreement of 1-bit signatures at which a pair is screened out.
SCREEN_SIGMA = 4.5
#: Bins of similarity of the estimate, as parts of what lies between threshold and 1; a bin with fewer links only counts with all others.
BINS, BIN_LINKS, ESTIMATE_LINKS = (0.25, 0.5), 100, 200
MIX, BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


def recall(similarity: np.ndarray | float, trees: int, depth: int):
    """The chance that a pair shares a prefix of that depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def first_depth(threshold: float, trees: int, target: float, most: int) -> int:
    return next((d for d in range(most, 1, -1) if recall(threshold, trees, d) >= target), 1)


class Shingler:
    """Hashes of the words and 5-grams of texts, by array operations over many texts at once."""

    def __init__(self):
        self.is_word = np.array([chr(c).isalnum() for c in range(0x110000)])  # what \w of a regular expression finds
        self.is_word[ord("_")] = True
        self.powers = self.inverse = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            with np.errstate(over="ignore"):
                self.powers, self.inverse = (np.cumprod(np.full(n, base, np.uint64)) for base in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))))

    def words(self, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        """Hashes of all words, how many each text has, and for each text a hash of its words in order (None: no words)."""
        raw = [(t.lower() + "\n").encode("utf-32-le", "surrogatepass") for t in all_texts]
        ends = np.cumsum([len(r) // 4 for r in raw])
        codes = np.frombuffer(b"".join(raw), "<u4")
        word = self.is_word[codes]
        after = np.concatenate([[False], word[:-1]])
        first, stop = np.flatnonzero(word & ~after), np.flatnonzero(after & ~word)
        hashes, lo = [], 0
        while lo < len(first):  # so many characters at a time; a longer word stands alone
            hi = max(lo + 1, int(np.searchsorted(stop, first[lo] + STRETCH, side="right")))
            a, b = first[lo], stop[hi - 1]
            self._powers(max(STRETCH, int(b - a)) + 1)
            x = (codes[a:b].astype(np.uint64) + np.uint64(1)) * MIX
            x = (x ^ (x >> np.uint64(29))) * BASE
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * self.powers[: len(x)])])
            h = (sums[stop[lo:hi] - a] - sums[first[lo:hi] - a]) * self.inverse[first[lo:hi] - a]
            hashes.append((h ^ (h >> np.uint64(32))) * MIX)
            lo = hi
        # each word with one mark after it
        kept = word | after & ~word
        plain, at = np.where(word, codes, 0)[kept], [0, *np.cumsum(kept)[ends - 1].tolist()]
        nodes = [blake2b(plain[s:e].tobytes(), digest_size=16).digest() if e > s else None for s, e in zip(at, at[1:], strict=False)]
        n = np.diff(np.searchsorted(first, ends), prepend=0)
        return np.concatenate([np.zeros(0, np.uint64), *hashes]), n, nodes

    def grams(self, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
        """Hashes of the 5-grams of all texts, how many each text has, and words()'s hash of each text; a text of fewer words is one gram."""
        words, n, nodes = self.words(all_texts)
        if not len(words):
            return words, n, nodes
        start = np.cumsum(n) - n
        width = np.minimum(n, GRAM)
        count = np.where(n > 0, n - width + 1, 0)
        row = np.repeat(np.arange(len(n)), count)
        at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        out = words[at] * MIX
        for j in range(1, GRAM):
            if (width >= GRAM).all():
                out = (out ^ words[at + j]) * MIX
            else:
                more = np.flatnonzero(width[row] > j)
                out[more] = (out[more] ^ words[at[more] + j]) * MIX
        out ^= out >> np.uint64(29)
        return (out + np.where(width < GRAM, width, 0).astype(np.uint64)[row]) * MIX, count, nodes


class Forest:
    """The hash functions of the trees."""

    def __init__(self, trees: int, depth: int):
        rng = np.random.default_rng(23)
        n = trees * depth
        self.a = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, n, np.uint64)

    def signatures(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """16 bits of the least value: a row for each text, a column for each hash function, tree by tree."""
        out, buffer = np.empty((len(self.a), len(starts)), np.uint64), np.empty_like(grams)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            np.bitwise_xor(grams, b, out=buffer)
            np.multiply(buffer, a, out=buffer)
            np.minimum.reduceat(buffer, starts, out=out[i])
        return ((out.T * MIX) >> np.uint64(48)).astype(">u2")  # the least values themselves are all small

    @staticmethod
    def bits(signatures: np.ndarray) -> np.ndarray:
        """1-bit signatures as bytes, whole 64-bit words of them."""
        packed = np.packbits((signatures & 1).astype(np.uint8), axis=1)
        return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))


def sign(docs: DataFrame, trees: int, depth: int) -> DataFrame:
    """doc_id, node, signature, bits, chars for each row with a doc_id; all but doc_id are null for a text without words."""
    forest, held = Forest(trees, depth), []

    def work(part: pa.RecordBatch) -> dict:
        shingler = held[0] if held else held.append(Shingler()) or held[0]
        all_texts = texts(part)
        grams, sizes, nodes = shingler.grams(all_texts)
        none = [None] * len(nodes)
        out = {"doc_id": part.column("doc_id"), "node": nodes, "signature": [*none], "bits": [*none], "chars": [None if n is None else len(t) for t, n in zip(all_texts, nodes, strict=True)]}
        full = np.flatnonzero(sizes)
        start, lo = np.cumsum(sizes) - sizes, 0
        ends = (start + sizes)[full]
        while lo < len(full):  # so much at a time as a processor's cache holds
            first = start[full[lo]]
            hi = max(lo + 1, int(np.searchsorted(ends, first + 40_000, side="right")))
            found = forest.signatures(grams[first : ends[hi - 1]], start[full[lo:hi]] - first)
            for i, signature, bits in zip(full[lo:hi].tolist(), found, forest.bits(found), strict=True):
                out["signature"][i], out["bits"][i] = signature.tobytes(), bits.tobytes()
            lo = hi
        return out

    return map_texts(docs.where("doc_id is not null").select("doc_id", "text"), work, "doc_id long, node binary, signature binary, bits binary, chars long")


def cells(rows: DataFrame, key: str, blocks: Column) -> DataFrame:
    """rows dealt to a grid of blocks: each meets its own block and every other one once; key, i, j name the cell, own the row's block."""
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")).otherwise(F.lit(0))
    dealt = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")}).drop("_other").repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def by_cell(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches sorted by keys."""
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            here = tuple(c[lo] for c in cols)
            if rest and here != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(lo, hi - lo))
            last = here
    if rest:
        yield pa.Table.from_batches(rest)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (the least member of each node's component) after edges a, b have been added."""
    root = root.copy()
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _in_charge(own: np.ndarray, i: int, j: int) -> np.ndarray | None:
    """Which rows of a cell of two blocks are of the first one; None if it holds one block."""
    return None if i == j else own == i


def _values(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """A row of numbers for each value of a column of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values from the first on are equal, row by row along the last axis."""
    return np.cumprod(a == b, axis=-1, dtype=np.int8).sum(axis=-1)


def screen(rows: DataFrame, n_bits: int, threshold: float) -> DataFrame:
    """Edges (a, b, depth) that connect the nodes of each prefix whose 1-bit signatures agree enough, the longest shared prefixes first."""
    expected = (1 + threshold) / 2
    most = int((1 - expected + SCREEN_SIGMA * np.sqrt(expected * (1 - expected) / n_bits)) * n_bits)
    kinds = (pa.int64(), pa.int64(), pa.int32())

    def batch(out: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["a", "b", "depth"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, list, list] = ([], [], [])
        for cell in by_cell(batches, ("key", "i", "j")):
            if cell.num_rows < 2:
                continue
            node, path = cell.column("id").to_numpy(), _values(cell.column("path"), ">u2")
            bits = _values(cell.column("bits"), "<u8")
            first = _in_charge(cell.column("own").to_numpy(), cell.column("i")[0].as_py(), cell.column("j")[0].as_py())
            left, right = (np.arange(len(node)),) * 2 if first is None else (np.flatnonzero(first), np.flatnonzero(~first))
            differ = sum(np.bitwise_count(bits[left, None, k] ^ bits[None, right, k]).astype(np.int16) for k in range(bits.shape[1]))
            a, b = np.nonzero(np.triu(differ <= most, 1) if first is None else differ <= most)
            a, b = left[a], right[b]
            if not len(a):
                continue
            depth, root = shared_prefix(path[a], path[b]), np.arange(len(node))
            for d in np.unique(depth)[::-1].tolist():
                now = _merge(root, a[depth == d], b[depth == d])
                at = np.flatnonzero((now != root) & (root == np.arange(len(node))))  # heads that have got another one above them
                for column, values in zip(out, (node[at], node[now[at]], np.full(len(at), d)), strict=True):
                    column.extend(values.tolist())
                root = now
            if len(out[0]) > 50_000:
                yield batch(out)
                out = ([], [], [])
        yield batch(out)

    return rows.select("key", "i", "j", "own", "id", "bits", "path").mapInArrow(work, "a long, b long, depth int")


def candidates(nodes: DataFrame, floor: int, trees: int, depth: int, threshold: float) -> DataFrame:
    """a, b, depth of pairs that share a prefix of floor values at least: one row for each pair, with its longest prefix."""
    keys = F.expr(f"transform(sequence(0, {trees - 1}), t -> xxhash64(t, substring(signature, t * {2 * depth} + 1, {2 * floor})))")
    entries = nodes.select("id", F.posexplode(keys).alias("tree", "key"))
    # sums that are joined by a key that may be hot are written: then both sides are dealt anew and Spark can split them
    shared = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    met = entries.join(shared.withColumnRenamed("key", "_key").hint("merge"), F.col("key") == F.col("_key"))
    hits = met.groupBy("id").agg(F.collect_list(F.struct("tree", "key", "size")).alias("hits"))  # one for each tree at most
    live = nodes.join(hits, "id").select("id", "bits", "signature", F.inline("hits"))
    rows = live.select("id", "bits", "key", "size", F.expr(f"substring(signature, tree * {2 * depth} + 1, {2 * depth})").alias("path"))
    found = screen(cells(rows, "key", F.ceil(F.col("size") / F.lit(SCREEN_BLOCK))), trees * depth, threshold)
    out = written(found.groupBy("a", "b").agg(F.max("depth").alias("depth")))
    forget(shared)
    return out


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets of distinct values."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    out = np.zeros((n, n), np.float32)  # exact up to 2**24 grams
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[owner[s:e], column[s:e] - lo] = 1
        out += m @ m.T
    return out


def captures(shared: np.ndarray, similar: np.ndarray, depth: int, threshold: float, weight: float) -> np.ndarray:
    """By depth and bin of similarity: how many links the first half of the trees finds, the second half, and both.

    shared: link, tree: the length of the prefix that its ends share. Each link stands for weight of them.
    """
    out = np.zeros((depth, len(BINS) + 1, 3))
    half = shared.shape[1] // 2
    one, two = shared[:, :half].max(axis=1), shared[:, half:].max(axis=1)
    which = np.searchsorted([threshold + x * (1 - threshold) for x in BINS], similar, side="right")
    for d in range(1, depth + 1):
        for k, met in enumerate((one >= d, two >= d, (one >= d) & (two >= d))):
            out[d - 1, :, k] = np.bincount(which[met], minlength=len(BINS) + 1) * weight
    return out


def missed(first: float, second: float, both: float) -> tuple[float, float]:
    """Links found by either of two halves, and about how many neither has found."""
    return first + second - both, (first - both) * (second - both) / both if both else first + second


def enough(counts: np.ndarray, target: float) -> bool | None:
    """Whether no more links are missed than the target allows, of all links and of each bin; None: too few links to tell.

    What chance may add to a number of that size (two deviations and one link) is no reason to go on.
    """
    told = [missed(*row) for row in (counts.sum(axis=0), *counts)]
    if told[0][0] < BIN_LINKS:
        return None
    allowed = [(1 - target) * found for found, _ in told]
    return all(lost <= most + 2 * most**0.5 + 1 for (found, lost), most in zip(told, allowed, strict=True) if found >= BIN_LINKS)


def verify(rows: DataFrame, threshold: float, trees: int, depth: int) -> DataFrame:
    """component, nodes, blocks, id, links, root, captures: a row for each node of each cell of the groups; captures on one row of a cell."""
    names = ["component", "nodes", "blocks", "id", "links", "root", "captures"]
    kinds = (pa.int64(),) * 6 + (pa.list_(pa.float64()),)

    def batch(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, forest = Shingler(), Forest(trees, depth)
        out: list[list] = [[] for _ in names]
        for cell in by_cell(batches, ("component", "i", "j")):
            grams, sizes, found = shingler.grams([t or "" for t in cell.column("text").to_pylist()])
            seen, at, sets, start = set(), [], [], np.cumsum(sizes) - sizes
            for r, (i, node) in enumerate(zip(cell.column("id").to_pylist(), cell.column("node").to_pylist(), strict=True)):
                if i not in seen and found[r] == node:  # else another row with the same doc_id
                    seen.add(i)
                    at.append(r)
                    sets.append(np.unique(grams[start[r] : start[r] + sizes[r]]))  # all that signatures depend on
            if len(at) < 2:
                continue
            cell = cell.take(at)
            ids, size = cell.column("id").to_numpy(), np.array([len(s) for s in sets])
            first = _in_charge(cell.column("own").to_numpy(), cell.column("i")[0].as_py(), cell.column("j")[0].as_py())
            both, found, similar = intersections(sets), [], []
            for lo in range(0, len(ids), 256):
                part = slice(lo, lo + 256)
                share = both[part] / (size[part, None] + size[None, :] - both[part])
                mine = np.arange(len(ids))[None, :] > np.arange(len(ids))[part, None] if first is None else first[part, None] & ~first[None, :]
                x, y = np.nonzero((share >= threshold - 1e-9) & mine)
                found.append((x + lo, y))
                similar.append(share[x, y])
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            root, told = _merge(np.arange(len(ids)), a, b), None
            if len(a):
                pick = np.unique(np.linspace(0, len(a) - 1, min(ESTIMATE_LINKS, len(a))).astype(np.int64))
                ends = np.unique([a[pick], b[pick]])
                counts = size[ends]
                paths = forest.signatures(np.concatenate([sets[x] for x in ends]), np.cumsum(counts) - counts).reshape(len(ends), trees, depth)
                shared = shared_prefix(paths[np.searchsorted(ends, a[pick])], paths[np.searchsorted(ends, b[pick])])
                told = captures(shared, np.concatenate(similar)[pick], depth, threshold, len(a) / len(pick)).ravel().tolist()
            links = np.bincount(np.concatenate([a, b]), minlength=len(ids))
            same = [cell.column(c)[0].as_py() for c in ("component", "nodes", "blocks")]
            for column, values in zip(out, (*([x] * len(ids) for x in same), ids.tolist(), links.tolist(), ids[root].tolist(), [told] + [None] * (len(ids) - 1)), strict=True):
                column.extend(values)
            if len(out[0]) > 50_000:
                yield batch(out)
                out = [[] for _ in names]
        yield batch(out)

    columns = ("component", "i", "j", "own", "nodes", "blocks", "id", "node", "text")
    return rows.select(*columns).mapInArrow(work, "component long, nodes long, blocks long, id long, links long, root long, captures array<double>")


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few."""
    return F.broadcast(ids) if ids.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else ids


def _verified(docs: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float, trees: int, depth: int) -> DataFrame:
    """verify() of groups (id, component)."""
    sizes = written(groups.join(nodes.select("id", "chars"), "id").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.sum("chars").alias("chars")))
    members = written(groups.join(sizes, "component").join(nodes.select("id", "doc_id", "node"), "id"))
    ids = members.select(F.col("doc_id").alias("_doc"), "id", "node", "component", "nodes", "chars")
    with_text = docs.join(_few(ids), F.col("doc_id") == F.col("_doc")).select("id", "node", "component", "nodes", "chars", "text")
    by_nodes = F.least(F.col("nodes") / VERIFY_BLOCK, F.greatest(F.lit(VERIFY_BLOCKS), F.col("nodes") / VERIFY_LARGE))
    found = written(verify(cells(with_text, "component", F.ceil(F.greatest(by_nodes, F.col("chars") / VERIFY_CHARS))), threshold, trees, depth))
    forget(sizes, members)
    return found


def _grown(groups: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Groups (id, component) that edges make of groups and single nodes, and the components that went into them; None if there are none."""
    at = lambda end: groups.select(F.col("id").alias(end), F.col("component").alias(f"_{end}"))
    ends = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    across = written(ends.where("a <> b").distinct())
    if not across.take(1):
        return None
    merged = written(connected(across).select(F.col("node").alias("_old"), F.col("component").alias("_new")))
    before = groups.join(merged, F.col("component") == F.col("_old"))
    single = merged.join(groups.select("component").distinct(), F.col("_old") == F.col("component"), "left_anti")
    out = written(before.select("id", F.col("_new").alias("component")).union(single.select("_old", "_new")))
    forget(across)
    return out, merged.select(F.col("_old").alias("component"))


def links(docs: DataFrame, nodes: DataFrame, threshold: float, trees: int, depth: int, target: float) -> DataFrame:
    """verify() of all groups, with prefixes as short as the target asks for."""
    lowest = first_depth(threshold, trees, target, depth)
    floor, now, last = lowest, depth, depth + 1
    groups = found = None
    while True:
        edges = candidates(nodes, floor, trees, depth, threshold)
        while True:
            fresh = edges.where((F.col("depth") >= now) & (F.col("depth") < last))
            if groups is None:
                groups = written(connected(fresh.select("a", "b")).withColumnRenamed("node", "id"))
                found = _verified(docs, nodes, groups, threshold, trees, depth)
            elif grown := _grown(groups, fresh):  # only groups that grew are verified again
                more = _verified(docs, nodes, grown[0], threshold, trees, depth)
                tables = groups, found, grown[0], more
                groups = written(groups.join(grown[1], "component", "left_anti").select("id", "component").union(grown[0]))
                found = written(found.join(grown[1], "component", "left_anti").select(*found.columns).union(more))
                forget(*tables)
            counts = np.zeros(depth * (len(BINS) + 1) * 3)
            for r in found.where("captures is not null").select(F.posexplode("captures")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # a few rows for each depth
                counts[r.pos] = r.n
            told = enough(counts.reshape(depth, len(BINS) + 1, 3)[now - 1], target)
            if told or told is None and now <= lowest or now == 1:
                forget(edges, groups)
                return found
            last, now = now, (min(now - 1, lowest) if told is None else now - 1)
            if now < floor:
                break
        forget(edges)
        floor = now


def classes(docs: DataFrame, threshold: float = 0.8, trees: int = 24, depth: int = 8, target: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of each row with a doc_id, written; and for each node: node, doc_id (the least), root, class_id, links, copies."""
    docs = docs.select("doc_id", "text")
    signed = written(sign(docs, trees, depth))
    kept = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("signature", "bits", "chars")])
    nodes = written(kept.withColumn("id", F.monotonically_increasing_id()))  # written: an id stays what it is
    found = links(docs, nodes, threshold, trees, depth, target)
    linked = found.groupBy("id").agg(F.sum("links").alias("links"), F.min("root").alias("root")).where("links > 0")
    # a group in one cell has its class already; those dealt over several are connected once more
    split = connected(found.where((F.col("blocks") > 1) & (F.col("id") != F.col("root"))).select(F.col("id").alias("a"), F.col("root").alias("b")))
    rooted = linked.join(split.select(F.col("node").alias("id"), F.col("component").alias("_c")), "id", "left").select("id", "links", F.coalesce("_c", "root").alias("root"))
    placed = written(
        nodes.select("id", "node", "doc_id", "copies").join(rooted, "id", "left").select("node", "doc_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "id").alias("root"))
    )
    least = written(placed.groupBy("root").agg(F.min("doc_id").alias("class_id")))
    out = written(placed.join(least, "root").select("node", "doc_id", "root", "class_id", "links", "copies"))
    forget(nodes, found, placed, least)
    return signed.select("doc_id", "node"), out


def join(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for each row of docs (doc_id, text); parameters as classes() has them."""
    signed, named = classes(docs, **parameters)
    named = named.select(F.col("node").alias("_node"), "class_id", F.col("links").alias("n_links"), F.col("copies").alias("n_copies"))
    out = signed.where("node is not null").join(named, F.col("node") == F.col("_node")).select("doc_id", "class_id", "n_links", "n_copies")
    # rows that took no part: no doc_id, or no words as sign() found
    alone = docs.where("doc_id is null").select("doc_id").union(signed.where("node is null").select("doc_id"))
    return out.union(alone.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long"), F.lit(1).cast("long")))


def with_node(docs: DataFrame, name: str) -> DataFrame:
    """docs with the hash of the words of each text."""
    held: list[Shingler] = []

    def work(part: pa.RecordBatch) -> dict:
        shingler = held[0] if held else held.append(Shingler()) or held[0]
        return {c: part.column(c) for c in part.schema.names} | {name: shingler.words(texts(part))[2]}

    return map_texts(docs, work, docs.withColumn(name, F.lit(None).cast("binary")).schema)


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each class: the least (doc_id, hash of words). Rows without doc_id or words stay."""
    columns = docs.columns
    doc, node, other = unused(columns, "doc"), unused(columns, "node"), unused(columns, "other")
    signed, named = classes(docs, **parameters)
    chosen = named.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("c")).select(F.col("c.doc_id").alias("doc_id"), F.col("c.node").alias("node"))
    pairs = written(signed.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n")))
    stay = written(pairs.join(chosen, ["doc_id", "node"]).select(F.col("doc_id").alias(doc), F.col("node").alias(other)))
    # an id that comes once stays or goes by itself; the rows of other ids are looked at one by one
    apart = written(pairs.groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 1").select(F.col("doc_id").alias(doc)))
    gone = pairs.where("node is not null").select(F.col("doc_id").alias(doc)).join(stay, doc, "left_anti")
    out = docs.join(_few(written(gone.union(apart).distinct())), F.col("doc_id") == F.col(doc), "left_anti")
    if apart.take(1):
        looked = with_node(docs.join(_few(apart), F.col("doc_id") == F.col(doc), "left_semi"), node)
        once = looked.join(stay, (F.col("doc_id") == F.col(doc)) & (F.col(node) == F.col(other)), "left_semi").dropDuplicates(["doc_id", node])
        out = out.union(once.select(*columns)).union(looked.where(F.col(node).isNull()).select(*columns))
    return out
