"""Repeated passages by a depth-limited radix sort of suffixes.

A suffix matters through its first ``window`` bytes only.  Suffixes are dealt by an anchor that equal windows share (the k-gram with the smallest hash
among those inside, a minimizer), then ordered by most-significant-digit passes over eight bytes at a time; a suffix that is alone in its
group leaves the sort.  Groups left after the last digit are exactly the repeated windows, compared byte by byte, and each group's smallest document id
decides what is removed: every byte of a window that also starts in a document with a smaller id.

How it scales: texts are packed into chunks of bounded size.  First, chunks send the sorted anchor hashes that they hold, and get a mark for those that others
hold too.  Then they send the windows around marked anchors (runs of neighbouring windows with one anchor travel as one record), each distinct record once with its smallest id, and
get each window's smallest id back.  A passage that a third of all documents share thus costs a record for each chunk, not for each document.  Anchors in over ``HOT_CHUNKS`` chunks are dealt by
their windows' bytes instead, so no task gets all contexts of one phrase.

Defined results: a null text is empty; texts shorter than the window keep all bytes; rows that repeat an id never remove each other's bytes; a null id counts as larger than all
others; matches never cross documents; a text of any length is a chunk of its own if it fills one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import cut

WINDOW = 50
GRAM = 24
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 8 << 20  # bytes of text for each bucket of anchors
HOT_CHUNKS = 1000
#: Bytes whose anchors are looked for at once: a place within them shares a 64-bit number with the hash.
PIECE = 1 << 26
_PLACE = np.uint64((1 << 28) - 1)
_M = 0x9E3779B97F4A7C15
NO_ID = (1 << 63) - 1


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def unsqueeze(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, equal bytes side by side."""
    d = np.diff(x, prepend=np.uint64(0))
    return squeeze(d.view(np.uint8).reshape(-1, 8).T)


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    d = np.ascontiguousarray(unsqueeze(data, np.uint8).reshape(8, -1).T)
    return np.cumsum(d.view(np.uint64).reshape(-1), dtype=np.uint64)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_M, n, 1 << 64))


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on, by doubling."""
    h = text.astype(np.uint64) + np.uint64(1)
    out, n, done = None, 1, 0
    while True:
        if gram & n:
            # what is done so far, followed by n bytes
            tail = h[done : done + len(text) - gram + 1]
            out = tail.copy() if out is None else out * _power(n) + tail
            done += n
        if 2 * n > gram:
            break
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


class Anchors:
    """Anchors of a chunk: place, hash, document, and the first and last window that each is the anchor of."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray, window: int, gram: int):
        ends = np.cumsum(lengths)
        starts = ends - lengths
        count = np.maximum(lengths - window + 1, 0)
        total = int(count.sum())
        if not total:
            self.place = self.first = self.last = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        h = gram_hashes(text, gram)
        nearest = np.empty(len(h) - (window - gram), np.int64)
        for at in range(0, len(nearest), PIECE):
            part = h[at : at + PIECE + window - gram]
            least = sliding_min((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), window - gram + 1)
            nearest[at : at + len(least)] = (least & _PLACE).astype(np.int64) + at
        inside = np.zeros(len(nearest) + 1, np.int8)
        has = count > 0
        np.add.at(inside, starts[has], 1)
        np.add.at(inside, starts[has] + count[has], -1)
        valid = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
        place = nearest[valid]
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        self.place = place[new]
        self.first = valid[new]
        self.last = valid[np.concatenate([new[1:], [len(valid)]]) - 1]
        self.hash = h[self.place] >> np.uint64(16)
        self.doc = np.searchsorted(ends, self.place, side="right")


def digits(rows: np.ndarray) -> np.ndarray:
    """Bytes as big-endian numbers of eight: a column for each digit."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = rows if rows.shape[1] == wide else np.pad(rows, ((0, 0), (0, wide - rows.shape[1])))
    return np.ascontiguousarray(padded).view(">u8").astype(np.uint64)


def radix_groups(first: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """A group number for each row; rows are in one group exactly if ``first`` and all columns are equal.

    Most significant digit first: each pass orders what shares a group so far by the next digit, and rows that are alone are done.
    """
    _, group = np.unique(first, return_inverse=True)
    group = group.astype(np.int64)
    fresh = int(group.max()) + 1 if len(group) else 0
    left = np.flatnonzero(np.bincount(group, minlength=fresh)[group] > 1) if fresh else np.zeros(0, np.int64)
    for c in range(columns.shape[1]):
        if not len(left):
            break
        g, d = group[left], columns[left, c]
        order = np.lexsort((d, g))
        g, d = g[order], d[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])])
        number = np.cumsum(new) - 1
        sizes = np.bincount(number)
        left = left[order]
        group[left] = fresh + number
        fresh += int(number[-1]) + 1
        left = left[sizes[number] > 1]
    return group


class Records:
    """Windows around marked anchors of a chunk, as records of equal length; equal ones once."""

    def __init__(self, text: np.ndarray, ids: np.ndarray, anchors: Anchors, marks: np.ndarray, window: int, gram: int):
        reach = window - gram
        pick = np.flatnonzero(marks > 0)
        place, low, high = anchors.place[pick], anchors.first[pick], anchors.last[pick]
        key, doc, hot = anchors.hash[pick], anchors.doc[pick], marks[pick] > 1
        if hot.any():  # one record for each window, dealt by its bytes
            n = np.where(hot, high - low + 1, 1)
            again = np.repeat(np.arange(len(pick)), n)
            step = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
            place, key, doc, was = place[again], key[again], doc[again], hot[again]
            low, high = np.where(was, low[again] + step, low[again]), np.where(was, low[again] + step, high[again])
            hot = was
        base = place - reach
        self.low, self.doc = low, doc
        self.a, self.b = low - base, high - base  # windows at these places of the record
        padded = np.concatenate([np.zeros(reach, np.uint8), text, np.zeros(window, np.uint8)])
        wide = 2 * reach + gram
        rows = np.lib.stride_tricks.sliding_window_view(padded, wide)[base + reach].copy()
        column = np.arange(wide)
        rows[(column[None, :] < self.a[:, None]) | (column[None, :] >= self.b[:, None] + window)] = 0
        if hot.any():
            d = digits(rows[hot])
            h = np.zeros(len(d), np.uint64)
            for c in range(d.shape[1]):
                h = (h ^ d[:, c]) * np.uint64(_M)
                h ^= h >> np.uint64(31)
            key = key.copy()
            key[hot] = h >> np.uint64(16)
        full = np.concatenate([rows, self.a[:, None].astype(np.uint8), self.b[:, None].astype(np.uint8)], axis=1)
        group = radix_groups(key, digits(full)) if len(full) else np.zeros(0, np.int64)
        # distinct records in the order of key and bytes' groups
        _, one, self.which = np.unique(group, return_index=True, return_inverse=True)
        order = np.argsort(key[one], kind="stable")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        self.which = back[self.which]
        self.key, self.rows = key[one][order], full[one][order]
        self.id = np.full(len(one), NO_ID, np.int64)
        np.minimum.at(self.id, self.which, ids[doc])


def smallest_ids(key: np.ndarray, rows: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For all windows of all records, one after the other: the smallest id of a record with that window; and where each record's begin."""
    a, b = rows[:, -2].astype(np.int64), rows[:, -1].astype(np.int64)
    n = b - a + 1
    ends = np.cumsum(n)
    group = radix_groups(key, digits(rows))
    _, one, which = np.unique(group, return_index=True, return_inverse=True)
    least = np.full(len(one), NO_ID, np.int64)
    np.minimum.at(least, which, ids)
    # only keys with several distinct records need their windows compared
    _, of_key, records = np.unique(key[one], return_inverse=True, return_counts=True)
    several = np.flatnonzero(records[of_key] > 1)
    own = np.repeat(least, n[one])
    own_start = np.cumsum(n[one]) - n[one]
    if len(several):
        m = n[one][several]
        again = np.repeat(several, m)
        at = a[one][again] + np.arange(len(again)) - np.repeat(np.cumsum(m) - m, m)
        body = rows[one][:, :-2]
        windows = np.empty((len(again), window), np.uint8)
        for from_ in range(0, len(again), 1 << 16):
            part = slice(from_, from_ + (1 << 16))
            windows[part] = np.take_along_axis(body[again[part]], at[part, None] + np.arange(window)[None, :], axis=1)
        w = radix_groups(of_key[again] * 256 + at, digits(windows))
        _, w = np.unique(w, return_inverse=True)
        low = np.full(int(w.max()) + 1, NO_ID, np.int64)
        np.minimum.at(low, w, least[again])
        own[own_start[again] + at - a[one][again]] = low[w]
    total = int(ends[-1]) if len(ends) else 0
    spread = np.repeat(own_start[which] - (ends - n), n) + np.arange(total)
    return own[spread], ends - n


def removed_bytes(text: np.ndarray, ids: np.ndarray, records: Records, mins: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which bytes of the chunk are covered by a window that also starts in a document with a smaller id."""
    n = records.b - records.a + 1
    again = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    earlier = mins[starts[records.which[again]] + step] < ids[records.doc[again]]
    edge = np.zeros(len(text) + 1, np.int32)
    at = records.low[again[earlier]] + step[earlier]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, gram: int = GRAM,
                   chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary), a row for each document."""
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal made, ids, texts, size
            made += 1
            out = pa.RecordBatch.from_arrays([
                pa.array([part << 32 | made]), pa.array([size]), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                pa.array([zstandard.ZstdCompressor(level=1).compress(b"".join(texts))], pa.binary()),
            ], names=["chunk", "size", "ids", "lengths", "data"])
            ids, texts, size = [], [], 0
            return out

        for batch in batches:
            column = batch.column(1)
            for i, id_ in enumerate(batch.column(0).to_pylist()):
                t = (column[i].as_py() or "").encode("utf-8", "surrogatepass")
                if size and size + len(t) > chunk_bytes:
                    yield close()
                ids.append(id_)
                texts.append(t)
                size += len(t)
        if ids:
            yield close()

    chunks = cut(source.mapInArrow(pack, "chunk long, size long, ids array<long>, lengths array<long>, data binary"))
    total = chunks.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))

    def opened(data: bytes, lengths, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, Anchors]:
        text = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        lengths = np.asarray(lengths, np.int64)
        own = np.array([NO_ID if i is None or i != i else int(i) for i in ids], np.int64)
        return text, lengths, own, Anchors(text, lengths, window, gram)

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(_M) >> np.uint64(20)) % np.uint64(buckets)

    def distinct_anchors(own: np.ndarray, anchors: Anchors) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes in the order of bucket and hash, each one's bucket, whether several documents hold it, and each anchor's place among them."""
        hashes, which = np.unique(anchors.hash, return_inverse=True)
        b = bucket_of(hashes)
        order = np.lexsort((hashes, b))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        which = back[which]
        low, high = np.full(len(hashes), NO_ID, np.int64), np.full(len(hashes), -NO_ID - 1, np.int64)
        np.minimum.at(low, which, own[anchors.doc])
        np.maximum.at(high, which, own[anchors.doc])
        return hashes[order], b[order], low < high, which

    def send_anchors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for chunk, ids, lengths, data in zip(pdf["chunk"], pdf["ids"], pdf["lengths"], pdf["data"], strict=True):
                _, _, own, anchors = opened(data, lengths, ids)
                hashes, b, many, _ = distinct_anchors(own, anchors)
                edges = np.concatenate([np.flatnonzero(np.diff(b, prepend=np.uint64(buckets))), [len(b)]]) if len(b) else np.zeros(1, np.int64)
                out = [(int(b[x]), chunk, squeeze_sorted(hashes[x:y]), squeeze(np.packbits(many[x:y]))) for x, y in zip(edges[:-1], edges[1:], strict=True)]
                yield pd.DataFrame(out, columns=["bucket", "chunk", "hashes", "many"])

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [unsqueeze_sorted(x) for x in pdf["hashes"]]
        sizes = [len(x) for x in lists]
        many = np.concatenate([np.unpackbits(unsqueeze(x, np.uint8), count=n) for x, n in zip(pdf["many"], sizes, strict=True)])
        _, which, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        repeated = count > 1
        repeated[which[many > 0]] = True
        marks = np.where(count > hot_chunks, 2, repeated.astype(np.int8)).astype(np.uint8)[which]
        parts = np.split(marks, np.cumsum(sizes)[:-1])
        return pd.DataFrame({"bucket": pdf["bucket"], "chunk": pdf["chunk"], "marks": [squeeze(p) for p in parts]})

    # big rows travel in small Arrow batches
    small = chunks.select("chunk", "ids", "lengths", "data")
    sent = small.mapInPandas(send_anchors, "bucket long, chunk long, hashes binary, many binary")
    marks = sent.groupBy("bucket").applyInPandas(mark, "bucket long, chunk long, marks binary")
    marked = cut(marks.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "marks"))).alias("marks")))
    known = small.join(marked, "chunk", "left")

    def records_of(ids, lengths, data, marks) -> tuple[np.ndarray, np.ndarray, np.ndarray, Records]:
        text, lengths, own, anchors = opened(data, lengths, ids)
        _, _, _, which = distinct_anchors(own, anchors)
        flat = np.concatenate([unsqueeze(m["marks"], np.uint8) for m in marks]) if marks is not None and len(marks) else np.zeros(0, np.uint8)
        return text, lengths, own, Records(text, own, anchors, flat[which] if len(which) else np.zeros(0, np.uint8), window, gram)

    def send_records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for chunk, ids, lengths, data, m in zip(pdf["chunk"], pdf["ids"], pdf["lengths"], pdf["data"], pdf["marks"], strict=True):
                _, _, _, r = records_of(ids, lengths, data, m)
                b = bucket_of(r.key)
                out = []
                order = np.argsort(b, kind="stable")
                edges = np.concatenate([np.flatnonzero(np.diff(b[order], prepend=np.uint64(buckets))), [len(b)]]) if len(b) else np.zeros(1, np.int64)
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    pick = order[x:y]
                    out.append((int(b[pick[0]]), chunk, squeeze(r.key[pick]), squeeze(r.rows[pick]), squeeze(r.id[pick])))
                yield pd.DataFrame(out, columns=["bucket", "chunk", "keys", "records", "ids"])

    wide = 2 * (window - gram) + gram + 2

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = [unsqueeze(x, np.uint64) for x in pdf["keys"]]
        rows = np.concatenate([unsqueeze(x, np.uint8) for x in pdf["records"]]).reshape(-1, wide)
        ids = np.concatenate([unsqueeze(x, np.int64) for x in pdf["ids"]])
        mins, starts = smallest_ids(np.concatenate(keys), rows, ids, window)
        edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        ends = np.append(starts, len(mins))
        return pd.DataFrame({"bucket": pdf["bucket"], "chunk": pdf["chunk"], "mins": [squeeze(mins[ends[x] : ends[y]]) for x, y in zip(edges[:-1], edges[1:], strict=True)]})

    sent_records = known.mapInPandas(send_records, "bucket long, chunk long, keys binary, records binary, ids binary")
    settled = sent_records.groupBy("bucket").applyInPandas(settle, "bucket long, chunk long, mins binary")
    answers = settled.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "mins"))).alias("mins"))

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for ids, lengths, data, m, answer in zip(pdf["ids"], pdf["lengths"], pdf["data"], pdf["marks"], pdf["mins"], strict=True):
                text, lengths, own, r = records_of(ids, lengths, data, m)
                gone = np.zeros(len(text), bool)
                if len(r.key):
                    mins = np.concatenate([unsqueeze(x["mins"], np.int64) for x in answer])
                    order = np.argsort(bucket_of(r.key), kind="stable")  # answers come in the order in which records were sent
                    n = (r.rows[:, -1].astype(np.int64) - r.rows[:, -2] + 1)[order]
                    starts = np.empty(len(order), np.int64)
                    starts[order] = np.cumsum(n) - n
                    gone = removed_bytes(text, own, r, mins, starts, window)
                ends = np.cumsum(lengths)
                rise = np.diff(gone.astype(np.int8), prepend=np.int8(0)) > 0
                if len(gone):
                    first = (ends - lengths)[lengths > 0]
                    rise[first] = gone[first]
                out = []
                for i, a, b in zip(ids, (ends - lengths).tolist(), ends.tolist(), strict=True):
                    g = gone[a:b]
                    k = int(g.sum())
                    kept = text[a:b].tobytes() if not k else text[a:b][~g].tobytes()
                    out.append((i, b - a, k, int(rise[a:b].sum()), kept))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"id": "Int64"})

    done = known.join(answers, "chunk", "left").select("ids", "lengths", "data", "marks", "mins")
    return done.mapInPandas(finish, "id long, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("id", id_column)


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
