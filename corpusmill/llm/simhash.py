"""SimHash near-duplicates, searched exactly with vantage-point trees.

A fingerprint takes every shingle of a text (repeats included), hashes it with XXH64
and sets each bit that is set in over half of the hashes. Texts link if their
fingerprints differ in at most ``radius`` bits, and linked texts form components.

Equal fingerprints are first merged to one row, a node with a number of its own, so copies
cost nothing later and ids of any value, repeated or null, do no harm. The bits are parted into one block more than
``radius``: linked fingerprints agree on one of them, so each fingerprint goes to the bucket of
each of its blocks, ``radius + 1`` rows at any size of the table. A bucket of more than ``GRID``
rows is parted by blocks of the other bits in the same way, and by pairs of its own blocks if that is not enough.
In a bucket of more than ``leaf_load`` rows a vantage-point tree is grown: a node's
vantage point and distance part the fingerprints into an inner
and an outer half. Each fingerprint has one home leaf. By the triangle inequality
only inner fingerprints within ``radius`` of the border can link across it; those
also visit the outer half, and visitors go on to every half they may link in. A leaf
compares its homes with all its members in blocks; a task returns a forest of the links,
never all pairs. The forests join up to components by hash-min rounds with pointer
jumping, each round written to the shared folder. A component's id is the smallest id of its fingerprints' rows.

:func:`distinct_documents` keeps one document of each group of alike word shingles.
There a fingerprint has more blocks: one of single words, that the tree parts, and some
of shingles, that decide. Likeness of ``similarity`` needs sets of like size, so sizes
are banded and a document meets its own band and the next. A leaf names its members that
have a candidate; these come again with their shingle sets, and the leaf verifies its
candidates by the exact similarity, nearest first, skipping pairs that are linked
already. Verified links form the groups. Only documents with the same set of shingles, by
a hash of 128 bits that follows the fingerprint in ``_fp``, count as copies; others with
equal fingerprints are candidates like any. Blocks are made of distinct words and shingles.
Fingerprints are estimates, so leaves find only some of the pairs, and these without much
work. The others are found by :func:`signatures`, of which every pair so alike shares one:
:func:`all_links` verifies whatever shares a signature and isn't linked yet. So no pair is
lost, but for collisions of 64-bit hashes of shingles, and no pair less alike is ever linked.

Defined cases: a null or wordless text has fingerprint zero, linked like any other;
fewer words than a shingle: the whole sequence is the one shingle; repeated rows fall
in one component, rows that share an id alone do not link; a null id is never a component's id, and a component of null ids
alone has the null component; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate
from math import acos, ceil, exp, floor, log, pi, sqrt
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX, free_name, frugal, frugal_group, lean, mixed, stash, values

SEED, SAMPLE, LEAF_LOAD, BLOCK = 42, 4096, 12_000, 200_000
#: Members of a block of a leaf, and bytes of shingle sets that meet in one task.
GRID, SETS = 50_000, 1 << 26
#: Frequent shingles that signatures avoid, at most, and texts that tell them.
COMMON, COMMON_SAMPLE = 1 << 18, 1 << 15
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of 64 bits at the end of a document's node that are the hash of its set of shingles.
KEY = 2
#: Rows of a bucket beyond which it grows a tree.
BUCKET_LOAD = 2048


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    found = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return np.zeros(0, "<u8")
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    starts = list(accumulate((len(w) + 1 for w in found), initial=0))
    if len(found) <= words:
        return np.array([digest(joined, seed)], "<u8")
    return np.array([digest(joined[a : b - 1], seed) for a, b in zip(starts, starts[words:], strict=False)], "<u8")


def majority_bits(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = 4, bits: int = 64) -> str:
    """Hex digits of the fingerprint; 64 bits for each seed from SEED on."""
    return "".join(f"{majority_bits(shingle_hashes(text, words, SEED + i)):016x}" for i in range(bits // 64))


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _fp of every document."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t or "", words, bits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["_id", "_fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInArrow(run, "_id bigint, _fp string")


def unhex(column: Any) -> np.ndarray:
    """Rows of 64-bit words from hex strings of one length."""
    values = column.to_pylist()
    width = len(values[0]) // 16 if values else 1
    return np.frombuffer(bytes.fromhex("".join(values)), ">u8").astype(np.uint64).reshape(-1, width)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, over the last axis; the others broadcast."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0])
    for i in range(1, a.shape[-1]):
        out = out + np.bitwise_count(a[..., i] ^ b[..., i])
    return out


def halves(d: np.ndarray, home: np.ndarray, at: int, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Who goes to the inner and outer half of a node, and who is at home there."""
    d = d.astype(np.int32)
    inner_home, outer_home = home & (d <= at), home & (d > at)
    inner = inner_home | (~home & (d <= at + radius))
    outer = outer_home | (d > at - radius)
    return inner, inner_home, outer, outer_home


def depth_of(total: float, least: float) -> int:
    """Levels of a tree. A level makes visitors up to 1.68 times as many, so copies grow as the root of ``total`` at most."""
    return max(0, floor(log(max(total, 1) / least) / log(1.68**2)))


def grow(sample: np.ndarray, total: int, radius: int, leaf_load: int, levels: int) -> list:
    """Nodes [vantage point, distance, inner, outer] by number; a leaf is [None, leaf number]."""
    nodes: list = []
    leaves = 0
    scale = total / max(1, len(sample))

    def node(members: np.ndarray, home: np.ndarray, depth: int) -> int:
        nonlocal leaves
        here = len(nodes)
        nodes.append(None)
        best = None
        if len(members) * scale > leaf_load and depth < levels and home.sum() >= 16:
            homes = np.flatnonzero(home)
            for pick in homes[:: max(1, len(homes) // 4)][:4]:
                d = distance(sample[members], sample[members[pick]])
                for at in np.unique(np.quantile(d[home], [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]).astype(int)):
                    inner, _, outer, _ = halves(d, home, int(at), radius)
                    load = max(inner.sum(), outer.sum())
                    if best is None or load < best[0]:
                        best = (load, int(members[pick]), int(at), d)
        if best is None or best[0] > 0.97 * len(members):
            nodes[here] = [None, leaves]
            leaves += 1
            return here
        _, vantage, at, d = best
        inner, inner_home, outer, outer_home = halves(d, home, at, radius)
        left = node(members[inner], inner_home[inner], depth + 1)
        right = node(members[outer], outer_home[outer], depth + 1)
        nodes[here] = [sample[vantage].tolist(), at, left, right]
        return here

    node(np.arange(len(sample)), np.ones(len(sample), bool), 0)
    return nodes


def route(nodes: list, prints: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, row numbers, which of them are at home) for a batch of fingerprints."""
    todo = [(0, np.arange(len(prints)), np.ones(len(prints), bool))]
    while todo:
        here, rows, home = todo.pop()
        if not len(rows):
            continue
        if nodes[here][0] is None:
            yield nodes[here][1], rows, home
            continue
        vantage, at, left, right = nodes[here]
        d = distance(prints[rows], np.array(vantage, np.uint64))
        inner, inner_home, outer, outer_home = halves(d, home, at, radius)
        todo += [(left, rows[inner], inner_home[inner]), (right, rows[outer], outer_home[outer])]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of ``n`` nodes' components."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not (label[label] == label).all():
            label = label[label]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of ``n`` nodes that join what the links ``a``, ``b`` join, fewer than ``n``."""
    label = roots(n, a, b)
    a = np.flatnonzero(label != np.arange(n))
    return a, label[a]


def leaf_forest(prints: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between homes and members of a leaf."""
    n, homes = len(prints), np.flatnonzero(home)
    a = b = np.zeros(0, np.int64)
    step = max(1, (1 << 20) // max(1, n))
    for k in range(0, len(homes), step):
        block = homes[k : k + step]
        near = distance(prints[block][:, None, :], prints[None, :, :]) <= radius
        i, j = np.nonzero(near)
        i = block[i]
        apart = i != j
        a, b = np.concatenate([a, i[apart]]), np.concatenate([b, j[apart]])
        if len(a) > 4 * n + (1 << 20):
            a, b = forest(n, a, b)
    return forest(n, a, b)


def grid(hashes: np.ndarray, home: np.ndarray, side: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(block pair, row numbers, which of them are at home): homes of the first block meet all of the second.

    A leaf's rows are dealt into ``side`` blocks by hash. Every pair with a home meets in one block pair.
    """
    block = ((hashes >> np.uint64(33)) % np.uint64(side)).astype(np.int64)
    every = np.arange(len(block))
    for other in range(side):
        first = home | (block == other)
        yield block[first] * side + other, every[first], home[first]
        second = (other != block) & (~home | (other < block))
        yield other * side + block[second], every[second], np.zeros(int(second.sum()), bool)


def blocks_of_bits(within: np.ndarray, radius: int) -> list[np.ndarray]:
    """Masks that part the bits of a mask into one block more than ``radius``: fingerprints so near agree on one of them."""
    at = np.flatnonzero(np.unpackbits(within.view(np.uint8), bitorder="little"))
    bits = np.zeros((radius + 1, 64 * len(within)), np.uint8)
    for row, part in zip(bits, np.array_split(at, radius + 1), strict=True):
        row[part] = 1
    return list(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))


def bucket_keys(prints: np.ndarray, mask: np.ndarray, salt: int) -> np.ndarray:
    """Equal for fingerprints that agree on the bits of ``mask``."""
    out = np.full(len(prints), mixed(np.array([salt], np.uint64) * MIX)[0], np.uint64)
    for word, some in zip(prints.T, mask, strict=True):
        out = mixed(out ^ (word & some)) + np.uint64(1)
    return out


def buckets(prints: np.ndarray, radius: int, large: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(keys, row numbers, whether they are finer): every pair within ``radius`` has a key in common.

    Fingerprints that agree on a block have one key, and so ``radius + 1`` keys each. Where that is one of the keys
    ``large``, the other bits are parted into blocks again, on one of which a pair must agree too.
    """
    every = np.full(prints.shape[1], 2**64 - 1, np.uint64)
    for i, mask in enumerate(blocks_of_bits(every, radius)):
        key = bucket_keys(prints, mask, i + 1)
        much = np.isin(key, large)
        yield key[~much], np.flatnonzero(~much), False
        if much.any():
            rows = np.flatnonzero(much)
            for j, other in enumerate(blocks_of_bits(~mask, radius)):
                yield bucket_keys(prints[rows], mask | other, (i + 1 << 20) + j), rows, True


def bucket_links(key: np.ndarray, prints: np.ndarray, radius: int, leaf_load: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of equal keys, by row number. Many rows of one key are parted by a vantage-point tree."""
    n, order = len(key), np.argsort(key, kind="stable")
    key, sorted_prints = key[order], prints[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    many = np.diff(np.append(start, n))
    a = b = np.zeros(0, np.int64)

    def more(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal a, b
        a, b = np.concatenate([a, i]), np.concatenate([b, j])
        if len(a) > 4 * n + (1 << 20):
            a, b = forest(n, a, b)

    end = np.repeat(np.where(many > leaf_load, 0, start + many), many)
    at, step = np.arange(n), 0
    while len(at):  # each row with the one so many rows on
        step += 1
        at = at[at + step < end[at]]
        near = at[distance(sorted_prints[at], sorted_prints[at + step]) <= radius]
        more(near, near + step)
    for first, size in zip(start[many > leaf_load].tolist(), many[many > leaf_load].tolist(), strict=True):
        own = sorted_prints[first : first + size]
        nodes = grow(own[:: -(-size // SAMPLE)], size, radius, leaf_load, depth_of(size, leaf_load / 6))
        for _, rows, home in route(nodes, own, radius):
            i, j = leaf_forest(own[rows], home, radius)
            more(first + rows[i], first + rows[j])
    return order[a], order[b]


def links(distinct: DataFrame, radius: int, leaf_load: int = BUCKET_LOAD) -> DataFrame:
    """(_fp, _node) one row a fingerprint to (_a, _b): forests of links, by node."""
    total = distinct.count()
    sample = unhex(distinct.select("_fp").orderBy(F.xxhash64("_fp"), "_fp").limit(SAMPLE).toArrow().column(0)) if total else np.zeros((0, 1), np.uint64)
    scale, none = total / max(1, len(sample)), np.zeros(0, np.uint64)

    def loads(large: np.ndarray, finer: bool) -> tuple[np.ndarray, np.ndarray]:
        """Keys of more than ``GRID`` rows, as the sample tells, and how many."""
        found = [k for k, _, fine in buckets(sample, radius, large) if fine == finer]
        keys, many = np.unique(np.concatenate([none, *found]), return_counts=True)
        return keys[many * scale > GRID], many[many * scale > GRID] * scale

    large, _ = loads(none, False)
    sides = {k: ceil(n / GRID) for k, n in zip(*(x.tolist() for x in loads(large, True)), strict=True)}
    shards = np.uint64(max(1, -(-total * (radius + 1) // GRID)))

    def parted(key: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of a key that is large even so meet in pairs of blocks."""
        plain = ~np.isin(key, np.array(list(sides), np.uint64))
        yield key[plain], np.flatnonzero(plain)
        for k in np.unique(key[~plain]).tolist():
            rows, side = np.flatnonzero(key == k), np.int64(sides[k])
            for pair, which, _ in grid(mixed(prints[rows, -1]), np.ones(len(rows), bool), int(side)):
                once = pair // side < pair % side
                yield mixed(mixed(pair[once].astype(np.uint64) + np.uint64(1)) ^ np.uint64(k)), rows[which[once]]

    @lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 8192):
                some = batch.slice(k, 8192)
                if not some.num_rows:
                    continue
                prints = unhex(some.column(0))
                for keys, rows, finer in buckets(prints, radius, large):
                    for key, which in parted(keys, prints[rows]) if finer and sides else [(keys, np.arange(len(rows)))]:
                        yield pa.RecordBatch.from_arrays([pa.array((key % shards).astype(np.int64)), pa.array(key.view(np.int64)), *(some.column(c).take(pa.array(rows[which])) for c in (0, 1))], ["_shard", "_key", "_fp", "_node"])

    def compare(members: pa.Table) -> pa.Table:
        a, b = bucket_links(members.column("_key").to_numpy(), unhex(members.column("_fp")), radius, leaf_load)
        node, at = np.unique(members.column("_node").to_numpy(), return_inverse=True)
        a, b = forest(len(node), at[a], at[b])
        return pa.table({"_a": pa.array(node[a], pa.int64()), "_b": pa.array(node[b], pa.int64())})

    return distinct.select("_fp", "_node").mapInArrow(send, "_shard bigint, _key bigint, _fp string, _node bigint").groupBy("_shard").applyInArrow(compare, "_a bigint, _b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(_a, _b) to (_node, _label): the smallest node of each linked node's component."""
    both = stash(edges.select("_a", "_b").union(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b"))).distinct(), "edges")
    labels = stash(both.groupBy(F.col("_a").alias("_node")).agg(F.least(F.min("_b"), F.first("_a")).alias("_label")), "labels")
    while True:
        near = both.join(labels, both["_b"] == labels["_node"]).groupBy("_a").agg(F.min("_label").alias("_near"))
        hooked = labels.join(near, labels["_node"] == near["_a"]).select("_node", F.col("_label").alias("_old"), F.least("_label", "_near").alias("_label"))
        up = labels.select(F.col("_node").alias("_label"), F.col("_label").alias("_up"))
        new = stash(hooked.join(up, "_label", "left").select("_node", "_old", F.least("_label", F.coalesce("_up", "_label")).alias("_label")), "labels")
        labels = new.select("_node", "_label")
        if new.where("_old <> _label").isEmpty():
            return labels


class WordHashes(dict):
    """Word to its XXH64; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return found

    def shingles(self, text: str, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words and of the shingles of a text, repeats included."""
        return self.of(text.encode("utf-8", "surrogatepass"), words)

    def of(self, data: bytes, words: int) -> tuple[np.ndarray, np.ndarray]:
        found = data.translate(LOWER).split()
        single = np.fromiter(map(self.__getitem__, found), np.uint64, len(found))
        width = min(words, len(found))
        if not width:
            return single, single
        out = np.zeros(len(found) - width + 1, np.uint64)
        for i in range(width):
            out = mixed(out ^ single[i : i + len(out)]) + np.uint64(width)
        return single, out


def blocks_of(text: str, words: int, bits: int, memory: WordHashes) -> tuple[bytes, int]:
    """A block of single words, ``bits`` of shingles and the key of the set of shingles, as bytes; and the set's size."""
    single, shingles = memory.shingles(text, words)
    distinct = np.unique(shingles)
    prints = [majority_bits(np.unique(single)), *(majority_bits(mixed(distinct + np.uint64(2 * i + 1))) for i in range(bits // 64))]
    return np.array(prints, ">u8").tobytes() + blake2b(distinct.tobytes(), digest_size=8 * KEY).digest(), len(distinct)


def radius_of(similarity: float, bits: int, spare: float = 2.0) -> int:
    """Differing bits that sets of one size and this Jaccard similarity stay within, but for ``spare`` standard deviations."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return ceil(bits * share + spare * sqrt(bits * share * (1 - share)))


def candidates(prints: np.ndarray, home: np.ndarray, radius: int, shingle_radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance in shingles) of pairs of a leaf's homes and members within both radii, in blocks."""
    homes = np.flatnonzero(home)
    step = max(1, (1 << 21) // max(1, len(prints)))
    for k in range(0, len(homes), step):
        block = homes[k : k + step]
        i, j = np.nonzero(np.bitwise_count(prints[block, :1] ^ prints[None, :, 0]) <= radius)
        i = block[i]
        once = (i < j) | ((i != j) & ~home[j])
        i, j = i[once], j[once]
        apart = distance(prints[i, 1:-KEY], prints[j, 1:-KEY])
        near = apart <= shingle_radius
        yield i[near], j[near], apart[near]


def similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two ascending arrays of distinct hashes have this Jaccard similarity or more."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared)


def verified_forest(prints: np.ndarray, home: np.ndarray, sets: list[np.ndarray], radius: int, shingle_radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of a leaf's verified links: nearest first, and none within what is linked already."""
    n = len(prints)
    label = np.arange(n)
    for i, j, d in candidates(prints, home, radius, shingle_radius):
        order = np.argsort(d, kind="stable")
        for rows in np.split(order, np.union1d(np.flatnonzero(np.diff(d[order])) + 1, np.arange(4096, len(order), 4096))) if len(order) else ():
            rows = rows[label[i[rows]] != label[j[rows]]]
            linked = rows[[similar(sets[a], sets[b], similarity) for a, b in zip(i[rows].tolist(), j[rows].tolist(), strict=True)]] if len(rows) else rows
            if len(linked):
                label = roots(n, label[i[linked]], label[j[linked]])[label]
    a = np.flatnonzero(label != np.arange(n))
    return a, label[a]


class ShingleSets:
    """Distinct shingle hashes of compressed texts, which are a third of the size of their sets; the last one is remembered."""

    def __init__(self, words: int) -> None:
        self.memory, self.words, self.last = WordHashes(), words, (b"", np.zeros(0, np.uint64))

    def __call__(self, packed: bytes) -> np.ndarray:
        if packed != self.last[0]:
            self.last = packed, np.unique(self.memory.of(zstandard.decompress(packed), self.words)[1])
        return self.last[1]


def as_words(column: Any) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), ">u8").astype(np.uint64).reshape(len(values), -1) if values else np.zeros((0, 1), np.uint64)


def candidate_members(distinct: DataFrame, radius: int, shingle_radius: int, similarity: float, leaf_load: int = LEAF_LOAD) -> DataFrame:
    """(_fp, _n) one row a set of shingles to (_shard, _fp, _home): members of leaves with a candidate there.

    Leaves of more than ``BLOCK`` members, or ``SETS`` bytes of shingle sets, are parted into blocks
    that do not meet here; :func:`all_links` finds pairs across. How many is told by the tree's sample.
    """
    ratio = log(1 / similarity)
    total = distinct.count()
    sample = distinct.select("_fp", "_n").orderBy(F.xxhash64("_fp"), "_fp").limit(SAMPLE).toArrow()
    seen = as_words(sample.column(0))[:, :1]
    nodes = grow(seen, total, radius, leaf_load, depth_of(total, 3 * leaf_load / 8))
    bands = np.floor(np.log(np.maximum(sample.column(1).to_numpy(), 1)) / ratio).astype(int)
    scale = total / max(1, len(seen))
    load: dict[tuple[int, int], int] = {}
    for leaf, rows, _ in route(nodes, seen, radius):
        for band in bands[rows].tolist():
            load[band, leaf] = load.get((band, leaf), 0) + 1
            load[band - 1, leaf] = load.get((band - 1, leaf), 0) + 1

    def parts(b: int, leaf: int) -> int:
        return ceil(load.get((b, leaf), 1) * scale * max(1 / BLOCK, 8 * exp((b + 2) * ratio) / SETS))

    @frugal
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                some = batch.slice(k, 2048)
                prints = as_words(some.column(0))
                band = np.floor(np.log(np.maximum(some.column(1).to_numpy(), 1)) / ratio).astype(np.int64)
                block = (mixed(prints[:, -1]) >> np.uint64(33)).astype(np.int64)
                for leaf, rows, home in route(nodes, prints[:, :1], radius):
                    for down in (0, 1):  # in the own band, and a guest in the one below
                        at, own = band[rows] - down, home
                        for b in np.unique(at).tolist():
                            here = rows[at == b]
                            part = block[here] % parts(b, leaf)
                            yield pa.RecordBatch.from_arrays([pa.array((b + 1 << 40) | (leaf << 20) | part), some.column(0).take(pa.array(here)), pa.array(own[at == b])], ["_shard", "_fp", "_home"])

    def compare(members: pa.Table) -> pa.Table:
        prints, seen = as_words(members.column("_fp")), np.zeros(members.num_rows, bool)
        for i, j, _ in candidates(prints, members.column("_home").to_numpy(), radius, shingle_radius):
            seen[i] = seen[j] = True
        return members.filter(pa.array(seen))

    schema = "_shard bigint, _fp binary, _home boolean"
    return distinct.select("_fp", "_n").mapInArrow(send, schema).groupBy("_shard").applyInArrow(frugal_group(compare), schema)


def verified_links(members: DataFrame, sets: DataFrame, words: int, radius: int, shingle_radius: int, similarity: float) -> DataFrame:
    """(_a, _b): forests of the members' links, by node, whose texts, (_node, _fp, _set), are at least so alike."""

    def verify(rows: pa.Table) -> pa.Table:
        node, sets_of = rows.column("_node").to_numpy(), ShingleSets(words)
        shingles = [sets_of(x.as_py()) for x in rows.column("_set")]
        a, b = verified_forest(as_words(rows.column("_fp")), rows.column("_home").to_numpy(), shingles, radius, shingle_radius, similarity)
        return pa.table({"_a": pa.array(node[a], pa.int64()), "_b": pa.array(node[b], pa.int64())})

    return members.join(sets.drop("_counts"), "_fp").groupBy("_shard").applyInArrow(frugal_group(verify), "_a bigint, _b bigint")


def common_shingles(texts: DataFrame, words: int) -> np.ndarray:
    """Ascending hashes of shingles that several texts of a sample (about ``COMMON_SAMPLE``) have, ``COMMON`` at most. They only save work."""
    share = min(1.0, COMMON_SAMPLE / max(1, texts.count()))

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for t in values(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(memory.shingles(t or "", words)[1]).view(np.int64))], ["_at"])

    some = texts.where(F.pmod(F.xxhash64("_fp"), F.lit(1 << 30)) < int(share * (1 << 30))).select("_text")
    counted = some.mapInArrow(run, "_at bigint").groupBy("_at").count().where("count > 2").orderBy(F.desc("count"), "_at").limit(COMMON)
    return np.sort(counted.select("_at").toArrow().column(0).to_numpy().view(np.uint64))


def signatures(shingles: np.ndarray, similarity: float, common: np.ndarray = np.zeros(0, np.uint64)) -> tuple[np.ndarray, np.ndarray, int]:
    """Of an ascending set of distinct hashes, those of which two sets share one if their Jaccard similarity is
    ``similarity`` or more; which of these are ``common``; and how many of the set are.

    All sets order their shingles alike: common ones last, else by hash. Sets so alike share
    n * similarity at least of either's n shingles, so of the first n - n * similarity + 1 one is shared: the
    first that both have. If they share any that is not common, the first that they share is not.
    """
    n = len(shingles)
    at = np.searchsorted(common, shingles)
    known = np.take(common, at, mode="clip") == shingles if len(common) else np.zeros(n, bool)
    first = np.argsort(known, kind="stable")[: n - ceil(similarity * n - 1e-6) + 1 if n else 0]
    return shingles[first], known[first], int(known.sum())


def shared_signatures(texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(_node, _fp, _text) to (_sig, _node, _many, _c, _r, _p, _hub, _least): signatures that several nodes have.

    ``_many``: it is a common shingle; ``_c``, ``_r``: how many of the node's shingles are common, and are not; ``_p``: how many come before it;
    the hub is the node of fewest not common (of these, the least), and ``_least`` is how many.
    """
    common = common_shingles(texts, words)
    names = ["_sig", "_node", "_many", "_c", "_r", "_p"]
    schema = "_sig bigint, _node bigint, _many boolean, _c int, _r int, _p int"

    @frugal
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                sets = [np.unique(memory.shingles(t or "", words)[1]) for t in some.column(1).to_pylist()]
                made = [signatures(x, similarity, common) for x in sets]
                count = [len(m[0]) for m in made]
                c = np.array([m[2] for m in made], np.int32)
                columns = [np.concatenate([m[0] for m in made]).view(np.int64), np.repeat(some.column(0).to_numpy(), count), np.concatenate([m[1] for m in made])]
                columns += [np.repeat(c, count), np.repeat(np.array([len(x) for x in sets], np.int32) - c, count), np.concatenate([np.arange(n, dtype=np.int32) for n in count])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    @frugal
    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by signature; the last one of a batch waits for the next batch."""
        held: pa.RecordBatch | None = None  # the waiting row, and whether it goes on a run, of which hub
        follows, hub, least = False, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            sig, node = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            same = sig[1:] == sig[:-1]
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(sig)), 0))
            head, few = node[start], rows.column(4).to_numpy()[start]
            if follows:
                head[start == 0], few[start == 0] = hub, least
            keep = np.concatenate([[follows], same]) | np.concatenate([same, [False]])
            keep[-1] = False
            follows, hub, least, held = bool(same[-1]) if len(same) else follows, head[-1], few[-1], rows.slice(rows.num_rows - 1)
            yield pa.RecordBatch.from_arrays([*rows.filter(pa.array(keep)).columns, pa.array(head[keep]), pa.array(few[keep])], [*names, "_hub", "_least"])
        if follows:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([hub], pa.int64()), pa.array([least], pa.int32())], [*names, "_hub", "_least"])

    made = texts.select("_node", "_text").mapInArrow(sign, schema)
    return made.repartition("_sig").sortWithinPartitions("_sig", "_r", "_node").mapInArrow(several, schema + ", _hub bigint, _least int")


def shingle_counts(shingles: np.ndarray) -> bytes:
    """How many of a set's hashes begin with each of 64 values (65535 at most), and the set's size."""
    counts = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=64)
    return np.minimum(counts, 65535).astype("<u2").tobytes() + len(shingles).to_bytes(4, "little")


def may_be_alike(x: list[bytes], y: list[bytes], similarity: float) -> np.ndarray:
    """Whether sets of these counts can be so alike: counts differ in no more than the sets do."""
    a, b = (np.frombuffer(b"".join(v), np.uint8).reshape(-1, 132) for v in (x, y))
    h, g = (np.ascontiguousarray(v[:, :128]).view("<u2").astype(np.int32) for v in (a, b))
    n = sum(np.ascontiguousarray(v[:, 128:]).view("<u4")[:, 0].astype(np.int64) for v in (a, b))
    return np.abs(h - g).sum(1) <= (1 - similarity) / (1 + similarity) * n + 1e-6


def alike_pairs(pairs: DataFrame, sets: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (_a, _b) of nodes whose sets are at least so alike.

    Counts of their shingles by beginning, which are small, put out most pairs before the texts are fetched.
    A hub comes last, when the rows of its many pairs are wide enough for Spark to part them.
    """

    @frugal
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.select([0, 1]).filter(pa.array(may_be_alike(batch.column(2).to_pylist(), batch.column(3).to_pylist(), similarity)))

    @frugal
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = ShingleSets(words), ShingleSets(words)
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            yield batch.select([0, 1]).filter(pa.array([similar(first(a.as_py()), second(b.as_py()), similarity) for a, b in zip(x, y, strict=True)], pa.bool_()))

    a, b = (sets.select(F.col("_node").alias(c), F.col("_counts").alias(c + "counts")) for c in ("_a", "_b"))
    pairs = pairs.select("_a", "_b").join(b, "_b").join(a, "_a").select("_a", "_b", "_acounts", "_bcounts").mapInArrow(counted, "_a bigint, _b bigint")
    a, b = (sets.select(F.col("_node").alias(c), F.col("_set").alias(c + "set")) for c in ("_a", "_b"))
    return pairs.join(b, "_b").join(a, "_a").select("_a", "_b", "_aset", "_bset").mapInArrow(verify, "_a bigint, _b bigint")


def all_links(shared: DataFrame, sets: DataFrame, forest: DataFrame, words: int, similarity: float) -> DataFrame:
    """(_node, _label): components of all pairs of nodes so alike; ``forest`` has some of their links.

    First every node meets one hub, the least of its signatures' hubs. Then each node that is
    not linked to the hub of a signature meets others there that it isn't linked to: of
    two nodes without a link, one at least is not linked to the hub.

    A common shingle may be in any number of nodes. Pairs that share another shingle too meet there, so here
    only those count that are alike by their common shingles alone: the smaller number of common ones is ``similarity`` at least of
    the larger and all others of both. Where the common shingles are the same ones, whoever is like any node is like the
    hub, which has the fewest others; so nodes that are not like it are out before any pairs are made.

    A pair alike meets at the first signature that both have, in the order that all sets follow. Of what comes
    before it in either set they share nothing, so the rest of both must be enough. A pair that meets elsewhere is
    judged as if it were the first: what is alike has met there before.
    """
    met = shared.where("_node <> _hub").groupBy(F.col("_node").alias("_b")).agg(F.min("_hub").alias("_a"))
    edges = stash(alike_pairs(met, sets, words, similarity).union(forest), "links")
    labels = components(edges)
    hub = labels.select(F.col("_node").alias("_hub"), F.col("_label").alias("_main"))
    told = shared.join(labels, "_node", "left").join(hub, "_hub", "left").select("_sig", "_node", "_many", "_c", "_r", "_p", "_least", F.coalesce("_label", "_node").alias("_label"), F.coalesce("_main", "_hub").alias("_main"))
    told = stash(told, "told")
    hopeful = ~F.col("_many") | (F.col("_r") + F.col("_least") <= F.lit(1 / similarity - 1 + 1e-9) * F.col("_c"))  # no partner has fewer others than the hub
    apart = told.where((F.col("_label") != F.col("_main")) & hopeful).select("_sig", F.col("_node").alias("_a"), F.col("_label").alias("_from"), "_many", F.col("_c").alias("_ca"), F.col("_r").alias("_ra"), F.col("_p").alias("_pa"))
    others = told.select("_sig", F.col("_node").alias("_b"), F.col("_label").alias("_at"), (F.col("_label") == F.col("_main")).alias("_in"), F.col("_c").alias("_cb"), F.col("_r").alias("_rb"), F.col("_p").alias("_pb"))
    alike = F.least("_ca", "_cb") + F.when(F.col("_many"), 0).otherwise(F.least("_ra", "_rb")) >= F.lit(similarity - 1e-9) * (F.greatest("_ca", "_cb") + F.when(F.col("_many"), F.col("_ra") + F.col("_rb")).otherwise(F.greatest("_ra", "_rb")))
    left = F.least(F.col("_ca") + F.col("_ra") - F.col("_pa"), F.col("_cb") + F.col("_rb") - F.col("_pb"))
    enough = left >= F.lit(similarity / (1 + similarity)) * (F.col("_ca") + F.col("_ra") + F.col("_cb") + F.col("_rb")) - 1e-6
    rest = apart.join(others, ["_sig"]).where((F.col("_from") != F.col("_at")) & (F.col("_in") | (F.col("_a") < F.col("_b"))) & alike & enough)
    rest = rest.select(F.least("_a", "_b").alias("_a"), F.greatest("_a", "_b").alias("_b")).distinct()
    more = stash(alike_pairs(rest, sets, words, similarity), "more")
    return labels if more.isEmpty() else components(edges.union(more))


def distinct_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 256, radius: int = 12, id_col: str = "doc_id", text_col: str = "text", leaf_load: int = LEAF_LOAD) -> DataFrame:
    """The rows of ``docs``, one of each group: that of the smallest id, null ids last."""
    names = docs.columns
    text_at = names.index(text_col)
    row, fp, size = (free_name(docs, x) for x in ("~row", "~fp", "~n"))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            made = [blocks_of(t or "", words, bits, memory) for t in values(batch.column(text_at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.int64())], [*names, fp, size])

    @frugal
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, memory = zstandard.ZstdCompressor(level=1).compress, WordHashes()
        for batch in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in values(batch.column(2))]
            counts = [shingle_counts(np.unique(memory.of(d, words)[1])) for d in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(pack, data), pa.binary()), pa.array(counts, pa.binary())], ["_node", "_fp", "_set", "_counts"])

    printed = docs.mapInArrow(run, f"{schema}, `{fp}` binary, `{size}` bigint")
    printed = stash(printed.withColumn(row, F.monotonically_increasing_id()), "printed")
    rank = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(row).alias("row"))
    distinct = printed.groupBy(F.col(fp).alias("_fp")).agg(F.max(size).alias("_n"), F.min(rank).alias("_least"))
    distinct = stash(distinct.withColumn("_node", F.col("_least.row")), "distinct")
    texts = printed.select(F.col(row).alias("_node"), F.col(fp).alias("_fp"), F.col(f"`{text_col}`").cast("string").alias("_text")).join(distinct.select("_node"), "_node", "left_semi")
    shared = stash(shared_signatures(texts, words, similarity), "shared")
    some = stash(shared.select("_node").distinct(), "some")
    sets = stash(texts.join(some, "_node", "left_semi").select("_node", "_fp", "_text").mapInArrow(packed, "_node bigint, _fp binary, _set binary, _counts binary"), "sets")
    shingle_radius = radius_of(similarity, bits)
    near = distinct.join(some, "_node", "left_semi")  # no other has a document alike
    members = candidate_members(near, radius, shingle_radius, similarity, leaf_load)
    forest = verified_links(members, sets, words, radius, shingle_radius, similarity)
    labels = all_links(shared, sets, forest, words, similarity)
    grouped = distinct.join(labels, "_node", "left").groupBy(F.coalesce("_label", "_node")).agg(F.min("_least").alias("_least"))
    stay = grouped.select(F.col("_least.row").alias(row))
    return printed.join(stay, row, "left_semi").select(*(f"`{c}`" for c in names))


def near_duplicates(docs: DataFrame, words: int = 4, bits: int = 64, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", leaf_load: int = BUCKET_LOAD) -> DataFrame:
    """id, fingerprint and component_id (the smallest id reachable by links) of every document."""
    prints = stash(fingerprints(docs, words, bits, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("_fp").agg(F.min("_id").alias("_least")).withColumn("_node", F.monotonically_increasing_id())
    distinct = stash(distinct, "distinct")
    labels = components(links(distinct, radius, leaf_load))
    named = stash(distinct.join(labels, "_node", "left").select("_fp", "_least", F.coalesce("_label", "_node").alias("_label")), "named")
    least = named.groupBy("_label").agg(F.min("_least").alias("_id_of"))
    component = named.join(least, "_label").select("_fp", F.col("_id_of").alias("component_id"))
    return prints.join(component, "_fp").select(F.col("_id").alias(id_col), F.col("_fp").alias("fingerprint"), "component_id")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
