"""Exact top-k inner products over a bit-sliced index.

Vectors are quantised to integers.  A block of the index holds, for each attribute (component), one bitmap for each bit of
its values, counted from the block's smallest value so that all are non-negative.  A query's score is a sum of attribute slices shifted by the
set bits of the query's components; the sum is made by bitmap arithmetic, slices of one weight going through full adders until one is left and
carries move on to the next weight.  Negative components use the complemented slices; what all this shifts is one number for each query and block.
The best rows of a block come from the sum's most significant slice downward; rows equal in all slices at the boundary are resolved
exactly, by the smaller id.

Queries are dealt to every route and blocks of the index to one route each, so each pair meets once; a task holds its route's blocks and streams the queries.

Defined results: rows without an id, and vectors that are null or hold a null or a number that isn't finite, take no part; with fewer than k other rows all are returned;
repeated ids are rows of their own, as candidates and as queries, each with ranks of its own (a query leaves out all rows of its id); vectors of another length than the query's aren't compared with it;
scores that leave 64 bits wrap around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import cut

SCALE = 1024
BLOCK = 4096


def usable(vector: Column) -> Column:
    """Whether a vector is there and all of its components are finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


class Index:
    """Bit slices of a block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], len(ids)
        x = vectors[order].astype(np.int64)
        self.low = x.min(axis=0)
        u = x - self.low
        self.width = max(1, int(u.max()).bit_length())
        self.words = -(-self.rows // 64)
        padded = np.zeros((self.words * 64, x.shape[1]), np.int64)
        padded[: self.rows] = u
        bits = np.stack([(padded >> b & 1).astype(np.uint8).T for b in range(self.width)], axis=1)  # attribute, bit, row
        self.slices = np.packbits(bits, axis=2, bitorder="little").view(np.uint64)
        self.valid = np.packbits(np.arange(self.words * 64) < self.rows, bitorder="little").view(np.uint64)

    def to_bytes(self) -> bytes:
        head = np.array([self.rows, self.width, self.slices.shape[0]], np.int64)
        return b"".join(x.tobytes() for x in (head, self.ids.astype(np.int64), self.low, self.slices))

    @staticmethod
    def from_bytes(data: bytes) -> Index:
        self = object.__new__(Index)
        self.rows, self.width, n = np.frombuffer(data, np.int64, 3).tolist()
        self.words = -(-self.rows // 64)
        at = 24
        self.ids = np.frombuffer(data, np.int64, self.rows, at)
        at += 8 * self.rows
        self.low = np.frombuffer(data, np.int64, n, at)
        at += 8 * n
        self.slices = np.frombuffer(data, np.uint64, n * self.width * self.words, at).reshape(n, self.width, self.words)
        self.valid = np.packbits(np.arange(self.words * 64) < self.rows, bitorder="little").view(np.uint64)
        return self

    def total(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices of the scores' sum, the least significant first, and the number to add to each."""
        top = (1 << self.width) - 1
        q = query.astype(object)
        shift = int(sum(int(a) * int(b) for a, b in zip(q, self.low, strict=True))) + sum(int(a) * top for a in q if a < 0)
        size = np.abs(query)
        longest = max(1, int(size.max()).bit_length())
        at = [[] for _ in range(self.width + longest)]
        for sign, flip in ((query > 0, False), (query < 0, True)):
            for j in range(longest):
                d = np.flatnonzero(sign & (size >> j & 1 == 1))
                if len(d):
                    s = self.slices[d]
                    s = ~s if flip else s
                    for i in range(self.width):
                        at[i + j].append(s[:, i])
        out = []
        carry: list[np.ndarray] = []
        level = 0
        while level < len(at) or carry:
            found = (at[level] if level < len(at) else []) + carry
            carry = []
            x = np.concatenate(found) if found else np.zeros((1, self.words), np.uint64)
            while len(x) > 1:
                if len(x) == 2:
                    carry.append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
                    break
                n = len(x) // 3
                a, b, c = x[:n], x[n : 2 * n], x[2 * n : 3 * n]
                ab = a ^ b
                carry.append((a & b) | (ab & c))
                x = np.concatenate([ab ^ c, x[3 * n :]])
            out.append(x[0])
            level += 1
        return np.stack(out), shift

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best rows other than the query's own, ties to the smaller id; all if fewer."""
        if len(query) != self.slices.shape[0]:
            return []
        slices, shift = self.total(query)
        even = self.valid.copy()
        a, b = np.searchsorted(self.ids, [query_id, query_id + 1])
        for r in range(a, b):
            even[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        sure = np.zeros_like(even)
        for s in slices[::-1]:
            x = even & s
            n = int(np.bitwise_count(sure | x).sum())
            if n > k:
                even = x
            elif n < k:
                sure |= x
                even &= ~s
            else:
                sure |= x
                even = np.zeros_like(even)
                break
        rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        rest = np.flatnonzero(np.unpackbits(even.view(np.uint8), bitorder="little"))[: max(0, k - len(rows))]
        rows = np.concatenate([rows, rest])
        bits = (slices[:, rows >> 6] >> (rows & 63).astype(np.uint64) & np.uint64(1)).astype(object)
        scores = [int(sum(int(v) << p for p, v in enumerate(col))) + shift for col in bits.T]
        wrap = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
        return [(int(self.ids[r]), wrap(v)) for r, v in zip(rows, scores, strict=True)]


def build(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block long, index binary) of (id, q): each task slices up its own rows, so nothing is shuffled and no block outgrows its size."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def close(n: int) -> pd.DataFrame:
            nonlocal made
            ids, xs = zip(*held.pop(n), strict=True)
            index = Index(np.concatenate(ids), np.concatenate(xs)).to_bytes()
            made += 1
            return pd.DataFrame({"block": [part << 32 | made - 1], "index": [index]})

        for pdf in frames:
            lengths = pdf["q"].map(len)
            for n, own in pdf.groupby(lengths):
                for at in range(0, len(own), block):
                    piece = own.iloc[at : at + block]
                    held.setdefault(n, []).append((piece["id"].to_numpy(np.int64), np.stack(piece["q"].to_numpy()).astype(np.int64)))
                    if sum(len(i) for i, _ in held[n]) >= block:
                        yield close(n)
        for n in list(held):
            yield close(n)

    return vectors.mapInPandas(run, "block long, index binary")


def search(vectors: DataFrame, is_query: Column, k: int = 10, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, id, score): the k rows with the highest inner product with each row for which ``is_query`` holds."""
    rows = vectors.filter(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
    base = rows.select(F.col(id_column).cast("long").alias("id"), quantised(F.col(vector_column), scale).alias("q"), is_query.alias("wanted"))
    blocks = -(-base.count() // block)
    index = cut(build(base.select("id", "q").coalesce(max(1, blocks)), block))
    routes = max(1, index.count())

    # each query goes along every route, each block of the index along one; a route's blocks come before its queries
    placed = index.select(F.pmod(F.xxhash64("block"), F.lit(routes)).cast("int").alias("route"), F.lit(0).cast("long").alias("kind"), F.col("block").alias("id"), F.lit(None).cast("array<long>").alias("q"), "index")
    queries = cut(base.filter("wanted").select("id", "q", F.monotonically_increasing_id().alias("row")))  # rows may repeat an id
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(routes - 1))).alias("route"), (F.col("row") + 1).alias("kind"), "id", "q", F.lit(None).cast("binary").alias("index"))
    met = placed.unionByName(asked).repartition(routes, "route").sortWithinPartitions("route", "kind")

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        route, held = None, []
        for pdf in frames:
            out = []
            for r, kind, i, q, data in zip(pdf["route"], pdf["kind"], pdf["id"], pdf["q"], pdf["index"], strict=True):
                if r != route:
                    route, held = r, []
                if kind == 0:
                    held.append(Index.from_bytes(data))
                else:
                    query = np.asarray(q, np.int64)
                    out += [(i, kind, v, s) for own in held for v, s in own.best(int(i), query, k)]
            yield pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"]).astype("int64")

    found = met.mapInPandas(answer, "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_column), "score")
