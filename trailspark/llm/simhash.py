"""SimHash near-duplicates with BK-trees.

Fingerprints that differ in at most ``radius`` of 64 bits are linked.  Cut into ``radius + 2`` blocks of bits, two such
fingerprints agree in at least two blocks, so every distinct fingerprint is dealt to one shard for each pair of blocks; a shard's key
is what must agree.  A shard builds a BK-tree (children keyed by their integer Hamming distance to the parent) and searches it
for each of its members, following only edges within the radius.  A shard links its members with a spanning forest, not with all
pairs, so a group of n copies makes fewer than n links.  Shards with more than ``HOT`` distinct fingerprints are dealt once more on the
bits that their key leaves free, by the same argument; every link is found either way.  Fingerprints go to their shard's tree by a shuffle: a
broadcast of the trees would hold every document's fingerprint on the driver.

Components come from alternating large-star and small-star passes over the links, a checkpoint apart, until nothing changes.

Defined results: a null text and one without words have fingerprint zero and link like any other; repeated rows and exact copies
share a fingerprint; empty input gives an empty result; other columns of the input play no part; a row without an id takes no part in linking and has no component.

``near_duplicates`` links by the 64 bits alone.  ``near_copies`` is for removal of near copies by the similarity of their shingle sets, which 64 bits and a radius of 2
don't measure: it takes longer fingerprints and a wide radius to find candidates, and compares the whole sets of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import cut, partitions, steps

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Distinct fingerprints under one key from which the key's rest is dealt again.
HOT = 2000
#: Links (16 bytes each) that one task joins; more take passes over distributed links.
ONE_TASK = 500_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.zeros(len(words), np.int64)
    np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
    ends = np.append(starts[1:] - 1, len(joined))
    n = len(words) - shingle + 1
    view = memoryview(joined)
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""
    source = docs.select(id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_column):
            fps = np.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    return source.mapInArrow(run, f"id {docs.schema[id_column].dataType.simpleString()}, fp long")


class BKTree:
    """Integer fingerprints under Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        self.values.append(value)
        self.children.append({})
        new = len(self.values) - 1
        at = 0
        while new:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                break
            at = nxt
        return new

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for k, child in self.children[at].items():
                if d - radius <= k <= d + radius:
                    stack.append(child)
        return found


class Sets:
    """Disjoint sets of indexes."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def top(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.top(i), self.top(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (indexes) that connect what is within the radius of each other, without a ring."""
    sets, links, tree = Sets(len(values)), [], BKTree()
    for i, v in enumerate(values):
        links += [(i, j) for j in tree.within(v, radius) if sets.join(i, j)]
        tree.add(v)
    return links


def _parts(fp: Column, bits: list[tuple[int, int]], band: int = 0) -> Column:
    """Structs (band, key) for each pair of bit ranges (from, to)."""
    out = []
    for k, (a, b) in enumerate(combinations(bits, 2)):
        piece = lambda r: F.shiftrightunsigned(fp, r[0]).bitwiseAND(F.lit((1 << (r[1] - r[0])) - 1))
        out.append(F.struct(F.lit(band + k).alias("band"), F.shiftleft(piece(a), b[1] - b[0]).bitwiseOR(piece(b)).alias("key")))
    return F.array(*out)


def _ranges(bits: list[int], blocks: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), blocks)]


def _gathered(fp: Column, positions: list[int]) -> Column:
    """The bits of fp at the positions, side by side."""
    out = F.lit(0).cast("long")
    for k, p in enumerate(positions):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, p).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): spanning links among the distinct fingerprints (node long, fp long)."""
    blocks = radius + 2
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = list(zip(edges[:-1], edges[1:], strict=True))
    pairs = list(combinations(range(blocks), 2))
    dealt = distinct.select("node", "fp", F.inline(_parts(F.col("fp"), bits)))
    counts = dealt.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shards = dealt.join(counts, ["band", "key"])
    plain = shards.filter(F.col("n") <= HOT).select("band", "key", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey"), "node", "fp")
    again = None
    for k, (i, j) in enumerate(pairs):
        free = [p for b in range(blocks) if b not in (i, j) for p in range(*bits[b])]
        own = [_gathered(F.col("fp"), x + y) for x, y in combinations(_ranges(free, blocks), 2)]
        subs = F.array(*[F.struct(F.lit(s).alias("sub"), c.alias("subkey")) for s, c in enumerate(own)])
        again = F.when(F.col("band") == k, subs) if again is None else again.when(F.col("band") == k, subs)
    hot = shards.filter(F.col("n") > HOT).select("band", "key", F.inline(again), "node", "fp").select("band", "key", "sub", "subkey", "node", "fp")
    key = ["band", "key", "sub", "subkey"]
    placed = plain.unionByName(hot).repartition(partitions(distinct.sparkSession), *key).sortWithinPartitions(*key, "node")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int]] = []
        last = None
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(held) > 1:
                nodes = [n for n, _ in held]
                out.extend((nodes[i], nodes[j]) for i, j in forest([f for _, f in held], radius))
            held.clear()

        for pdf in frames:
            for b, k, s, t, node, fp in zip(*(pdf[c].tolist() for c in (*key, "node", "fp")), strict=True):
                if (b, k, s, t) != last:
                    close()
                    last = (b, k, s, t)
                held.append((node, fp & 0xFFFFFFFFFFFFFFFF))
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out.clear()
        close()
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return placed.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches, by large-star and small-star passes; few links are joined in one task."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    if edges.count() <= ONE_TASK:

        def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pairs = np.concatenate([np.zeros((0, 2), np.int64), *(f[["a", "b"]].to_numpy(np.int64) for f in frames)])
            nodes, at = np.unique(pairs, return_inverse=True)  # in order, so the smallest index of a set is its smallest node
            sets = Sets(len(nodes))
            for i, j in at.reshape(-1, 2).tolist():
                sets.join(i, j)
            tops = nodes[[sets.top(i) for i in range(len(nodes))]] if len(nodes) else nodes
            yield pd.DataFrame({"node": nodes, "component": tops})[nodes != tops]

        return cut(edges.coalesce(1).mapInPandas(join, "node long, component long"))
    before = None
    while True:
        # large-star: every larger neighbour of u is tied to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: u and its smaller neighbours are tied to the smallest of them
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.unionByName(small_least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


# ---- near copies by similarity of shingle sets ------------------------------------------------------------------------

WORDS = 4  # of 64 bits, in a long fingerprint
BANDS, ROWS = 20, 4
#: Values that a leaf of a tree holds side by side before it becomes a node with children.
LEAF = 32
#: Members of one tree; more in one band are cut into blocks that meet.
SHARD = 20_000
#: Shingles of a block whose members bring their sets.
SHINGLES = 4 << 20
#: Rounds in which nodes are compared with a leader go on while more than SHARD of them are apart and a round leaves no more than this part of them so.
GAIN = 0.75
#: Rows of some 30 bytes that are broadcast; more are joined by a shuffle.
SENT = 500_000
#: Pairs that share one copy of a set.
HUB = 64


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The set of shingles as sorted 64-bit hashes; a text of no more words than a shingle is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.zeros(len(words), np.int64)
    np.cumsum([len(w) + 1 for w in words[:-1]], out=starts[1:])
    ends = np.append(starts[1:] - 1, len(joined))
    n = len(words) - shingle + 1
    view = memoryview(joined)
    return np.unique(np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n))


def long_fingerprint(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """256 SimHash bits over the set of shingles, and a key for each band of ROWS minimal hashes."""
    bits = []
    mixed = hashes
    for _ in range(WORDS):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(mixed), 1 << 16):
            counts += np.unpackbits(mixed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        bits.append(np.packbits(counts * 2 > len(mixed)))
        mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 1 << 12):
        part = hashes[at : at + (1 << 12)]
        np.minimum(least, [(part * np.uint64(2 * k * 0x5851F42D4C957F2D + 1 & 0xFFFFFFFFFFFFFFFF) ^ part >> np.uint64(17 + k % 13)).min() for k in range(BANDS * ROWS)], out=least)
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.concatenate(bits).tobytes(), np.array(keys, np.uint64).view(np.int64).tolist()


class LeafTree:
    """A BK-tree whose leaves hold up to LEAF values side by side, compared with one array operation; a fuller leaf becomes a node with children."""

    class Node:
        def __init__(self, words: int):
            self.pivot, self.children, self.size = None, {}, 0
            self.members, self.values = np.empty(16, np.int64), np.empty((16, words), np.uint64)

        def put(self, i: int, value: np.ndarray) -> None:
            if self.size == len(self.members):
                self.members, self.values = np.concatenate([self.members] * 2), np.concatenate([self.values] * 2)
            self.members[self.size], self.values[self.size] = i, value
            self.size += 1

        def distances(self, value: np.ndarray) -> np.ndarray:
            return np.bitwise_count(self.values[: self.size] ^ value).sum(axis=1, dtype=np.int64)

    def __init__(self, values: np.ndarray):
        self.values, self.words = values, values.shape[1]
        self.root = self.Node(self.words)

    def distance(self, i: int, j: int) -> int:
        return int(np.bitwise_count(self.values[i] ^ self.values[j]).sum())

    def add(self, i: int) -> None:
        node = self.root
        while node.pivot is not None:
            k = self.distance(i, node.pivot)
            if k not in node.children:
                node.children[k] = self.Node(self.words)
            node = node.children[k]
        node.put(i, self.values[i])
        if node.size > LEAF:
            d = node.distances(node.values[0])[1:]
            if d.min() == d.max():  # all at one distance: splitting wouldn't part them
                return
            node.pivot = int(node.members[0])
            for j, k in zip(node.members[1 : node.size].tolist(), d.tolist(), strict=True):
                if k not in node.children:
                    node.children[k] = self.Node(self.words)
                node.children[k].put(j, self.values[j])
            node.size, node.members, node.values = 0, node.members[:0], node.values[:0]

    def within(self, i: int, radius: int) -> np.ndarray:
        found, stack, value = [], [self.root], self.values[i]
        while stack:
            node = stack.pop()
            if node.pivot is not None:
                d = self.distance(i, node.pivot)
                if d <= radius:
                    found.append(np.array([node.pivot]))
                stack += [c for k, c in node.children.items() if d - radius <= k <= d + radius]
            elif node.size:
                found.append(node.members[: node.size][node.distances(value) <= radius])
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def radius_of(similarity: float, deviations: float = 7) -> int:
    """Differing bits that sets of this Jaccard similarity don't exceed: the expected number and so many deviations (small sets differ in more bits than expected)."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(64 * WORDS * p + deviations * (64 * WORDS * p * (1 - p)) ** 0.5)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets, neither empty."""
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


def _apart(a: Column, b: Column) -> Column:
    """Differing bits of two long fingerprints (columns of WORDS longs)."""
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, WORDS)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def _shards(frames: Iterator[pd.DataFrame], shard: list[str], columns: list[str]) -> Iterator[list[tuple]]:
    """The members of each shard that has two at least."""
    held: list[tuple] = []
    last = None
    for pdf in frames:
        keys = zip(*(pdf[c].tolist() for c in shard), strict=True)
        for at, member in zip(keys, zip(*(pdf[c] for c in columns), strict=True), strict=True):
            if at != last:
                if len(held) > 1:
                    yield held
                held, last = [], at
            held.append(member)
    if len(held) > 1:
        yield held


def _search(held: list[tuple], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links between members (node, fp, size, group, inner, x, and the set where links must be verified) of different groups, without a ring.

    Members that are marked inner come first; in a shard of x below 0 they share one group, and only the others are looked up.
    """
    nodes, sizes = [h[0] for h in held], np.array([h[2] for h in held])
    values = np.array([h[1] for h in held], np.int64).view(np.uint64)
    tree, joined, first, links_ = LeafTree(values), Sets(len(held)), {}, []
    whole = [np.frombuffer(h[6], np.uint64) for h in held] if len(held[0]) > 6 else None
    for i, h in enumerate(held):
        joined.join(first.setdefault(h[3], i), i)
    for i, h in enumerate(held):
        if not (h[4] and h[5] < 0):
            found = tree.within(i, radius)
            found = found[np.minimum(sizes[found], sizes[i]) >= similarity * np.maximum(sizes[found], sizes[i])]
            if whole is not None:  # the nearest first
                found = found[np.argsort(np.bitwise_count(values[found] ^ values[i]).sum(axis=1, dtype=np.int64), kind="stable")]
            for j in found.tolist():
                if joined.top(i) != joined.top(j) and (whole is None or jaccard(whole[i], whole[j]) >= similarity):
                    joined.join(i, j)
                    links_.append((nodes[i], nodes[j]))
        if h[4] or h[5] >= 0:
            tree.add(i)
    return links_


def apart_links(members: DataFrame, key: str, radius: int, similarity: float) -> DataFrame:
    """(a, b): links between members (key, node, fp, size, group, leader_group, and shingles where links must be verified) of one key and different groups,
    that connect all groups of which two members are within the radius (and similar).

    Most members of a large key share its leader's group: those are cut into blocks, each a tree that is searched for the others,
    which meet among themselves too.  So rows grow with the members and with those that are still apart, not with the square of the members, and no pair is ever a row.
    """
    verified = "shingles" in members.columns
    inner = F.col("group") == F.col("leader_group")
    blocks = lambda which: F.greatest(F.ceil(F.count(F.when(which, 1)) / F.lit(SHARD)), F.ceil(F.sum(F.when(which, F.col("size")).otherwise(0)) / F.lit(SHINGLES)) if verified else F.lit(0)).cast("int")
    counts = members.groupBy(key).agg(blocks(inner).alias("inner_blocks"), blocks(~inner).alias("outer_blocks")).filter("outer_blocks > 0")
    own = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1))).cast("int")
    place = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    count = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    to_inner = F.when(F.col("inner_blocks") > 0, F.transform(count("inner_blocks"), lambda j: place(F.lit(-1), j))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    to_outer = F.transform(count("outer_blocks"), lambda j: place(F.least(own("outer_blocks"), j), F.greatest(own("outer_blocks"), j)))
    places = F.when(inner, F.array(place(F.lit(-1), own("inner_blocks")))).otherwise(F.concat(to_inner, to_outer))
    shard = [key, "x", "y"]
    columns = ["node", "fp", "size", "group", "inner", "x", *(["shingles"] if verified else [])]
    met = members.join(counts, key).select(key, *[c for c in columns if c not in ("inner", "x")], inner.alias("inner"), F.inline(places)).select(*shard, *[c for c in columns if c != "x"])
    met = met.repartition(partitions(members.sparkSession), *shard).sortWithinPartitions(*shard, F.desc("inner"), "node")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _shards(frames, shard, columns):
            out = _search(held, radius, similarity)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return met.mapInPandas(search, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): documents whose shingle sets are similar share the smallest id of their group.

    Documents with the same set are one node.  Bands of minimal hashes, of which sets this similar share one at least (missed with a chance under
    one in thirty thousand), bring nodes together.  In each of some rounds every node is compared with the leader of one of its bands, so a group of n near copies, however
    large, makes n pairs; then BK-trees of 256 SimHash bits find what is still apart within a band but within a radius wider than sets this similar need, and the members of
    what that joins are searched once more, with their whole sets beside them.
    Fingerprints and bands only find candidates: two nodes are linked if the exact Jaccard similarity of their whole shingle sets is high enough.  A document without an id gets no row.
    """
    radius = radius_of(similarity)
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(id_column, text_column).filter(F.col(id_column).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_column):
            sets = [shingles(x, shingle) for x in batch.column(1).to_pylist()]
            made = [long_fingerprint(x) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([np.frombuffer(f, np.int64) for f, _ in made], pa.list_(pa.int64())), pa.array([k for _, k in made], pa.list_(pa.int64()))],
                names=["id", "digest", "size", "fp", "keys"],
            )

    prints = cut(source.mapInArrow(run, f"id {kind}, digest binary, size long, fp array<long>, keys array<long>"))
    nodes = cut(prints.groupBy("digest").agg(F.min("id").alias("node"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    every = nodes.select("node", F.explode("keys").alias("key"))  # a band's number is in its keys
    shared = every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    dealt = cut(every.join(shared, "key").join(nodes.select("node", "size", "fp"), "node"))
    met = cut(nodes.select("node", "digest").join(dealt.select("node").distinct(), "node", "left_semi"))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = [shingles(x, shingle).tobytes() for x in batch.column(1).to_pylist()]
            own = pa.array([xxhash.xxh3_128_digest(x) == d for x, d in zip(sets, batch.column(2).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"]).filter(own)

    # whole sets of the nodes that share a band, once each; few nodes are sent along, many are met by a shuffle
    wanted = met.select(F.col("node").alias(id_column), "digest")
    texts = source.join(F.broadcast(wanted) if met.count() <= SENT else wanted, id_column)
    sets = cut(texts.select(F.col(id_column).alias("node"), F.col(text_column).alias("text"), "digest").mapInArrow(collect, f"node {kind}, shingles binary"))

    def similar(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets are similar. The set of b goes to its pairs once for each HUB of them, that of a once for each pair."""
        pairs = cut(pairs)
        parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(HUB)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
        ends = pairs.join(F.broadcast(parts) if pairs.count() <= SENT else parts, "b").select(F.col("a").alias("node"), "b", part.alias("part"), F.lit(1).alias("end"))
        hubs = parts.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("end"))
        asked = cut(ends.unionByName(hubs))
        rows = sets.join(F.broadcast(asked) if asked.count() <= SENT else asked, "node")
        rows = rows.repartition(partitions(docs.sparkSession), "b", "part").sortWithinPartitions("b", "part", "end")

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, hub = None, []
            for batch in batches:
                out = []
                for node, b, k, end, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                    if (b, k) != at:
                        at, hub = (b, k), []
                    one = np.frombuffer(data.as_buffer(), np.uint64)
                    if end == 0:
                        hub.append(one.copy())
                    elif any(jaccard(one, x) >= similarity for x in hub):
                        out.append((node, b))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

        return rows.select("node", "b", "part", "end", "shingles").mapInArrow(verify, "a long, b long")

    def grouped(found: DataFrame | None) -> DataFrame:
        """The members of bands with their groups so far."""
        if found is None:
            return dealt.withColumn("group", F.col("node"))
        return dealt.join(found.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node"))

    def led(members: DataFrame, round_: int) -> DataFrame:
        """Members of bands that hold several groups, with a leader that changes from round to round."""
        one = F.min_by(F.struct("node", "group", "fp", "size"), F.xxhash64(F.lit(round_), "node"))
        leaders = members.groupBy("key").agg(one.alias("one"), F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high")
        return members.join(leaders.select("key", "one"), "key")

    links_, found, left, round_ = None, None, float("inf"), 0
    while True:
        members = led(grouped(found), round_)
        near = (F.col("group") != F.col("one.group")) & (_apart(F.col("fp"), F.col("one.fp")) <= radius)
        fits = F.least("size", "one.size") >= F.lit(similarity) * F.greatest("size", "one.size")
        chosen = F.min_by(F.col("one.node"), F.xxhash64(F.lit(round_), "one.node"))  # of a node's bands, as leaders are chosen
        pairs = members.filter(near & fits).groupBy(F.col("node").alias("a")).agg(chosen.alias("b"))
        new = cut(similar(pairs))
        links_ = new if links_ is None else links_.unionByName(new)
        found = components(links_)
        rest = led(grouped(found), round_).select("key", "node", "fp", "size", "group", F.col("one.group").alias("leader_group"))
        apart = rest.filter("`group` <> leader_group").select("node").distinct().count()
        round_ += 1
        if apart <= SHARD or apart > left * GAIN:
            break
        left = apart
    # what is still apart: bands join candidates to groups, whose members then meet once each with their whole sets
    candidates = components(links_.unionByName(apart_links(rest, "key", radius, similarity))).withColumnRenamed("component", "key")
    candidates = candidates.unionByName(candidates.select(F.col("key").alias("node"), "key").distinct())
    members = dealt.select("node", "fp", "size").dropDuplicates(["node"]).join(candidates, "node")
    members = led(members.join(found.withColumnRenamed("component", "group"), "node", "left").withColumn("group", F.coalesce("group", "node")), round_)
    members = members.select("key", "node", "fp", "size", "group", F.col("one.group").alias("leader_group")).join(sets, "node")
    links_ = links_.unionByName(apart_links(members, "key", radius, similarity))
    found = components(links_)
    merged = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return prints.select("id", "digest").join(merged, "digest").select(F.col("id").alias(id_column), "component_id")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id): component_id is the smallest id that the links reach, the document's own included."""
    fps = cut(fingerprints(docs, id_column, text_column, shingle))
    distinct = cut(fps.filter(F.col("id").isNotNull()).groupBy("fp").agg(F.min("id").alias("node")))
    found = components(links(distinct, radius))
    merged = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    placed = fps.join(merged, "fp", "left")
    return placed.select(F.col("id").alias(id_column), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
