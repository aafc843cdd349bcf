"""SentencePiece encoding and decoding by a max-plus scan over boundary states.

The vocabulary is a byte-pair model: a segmentation is its encoding exactly if every two neighbours u, v stay as they are when u + v is
encoded alone.  So a step from u to v has weight 0 if they do and minus infinity else, and the best path through the lattice
of pieces, by dynamic programming over (max, +), is the encoding.  (Summing the pieces' own scores, as for a unigram model, would not give
this model's encodings.)

Every text, of any size, is cut into chunks at any character; a text no longer than a chunk is one chunk.  The state at a cut is the last piece that
starts before it, with the number of characters it reaches beyond.  Each chunk yields the matrix of transfers from its entry states to its exit states; matrices are
combined associatively, and then every chunk is traced back on its own between the two states that the scan left it.

A place whose two characters are neighbours in no piece is a cut that no piece crosses: it has a single state, so the matrix of a stretch between two such
places is one number, and stretches are solved apart, each distinct one of a batch once.  What decides a chunk's matrix is its head (up to the
first such place) and its tail (from the last one); where a chunk holds none, it is one lattice.

Defined results: a null or empty text has no pieces; repeated rows get repeated results; characters outside the vocabulary become
byte pieces.  Decoding gives the text back, but that U+2581, which the model uses for the space, comes back as one.  Columns other than the id and the
text play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import cut, partitions, steps

SPACE = "▁"
#: Characters of a chunk.
CHUNK = 1 << 16
#: Solved stretches in each of the two generations that a worker keeps, and pairs: when the young one is full it becomes the old one.
KEPT_PARTS, KEPT_PAIRS = 120_000, 250_000
#: Characters of a stretch that is kept.
KEPT_LENGTH = 64
State = tuple[int, int]  # piece (or minus the code of a character outside the vocabulary), characters beyond the cut
START = 0  # the unknown piece's number, which no text holds; also the one state of a cut that no piece crosses


def default_model() -> str:
    """The public model's file: the installed package names it."""
    try:
        import public_tokenizers
    except ModuleNotFoundError as e:
        raise FileNotFoundError("no model file was given, and no package of public tokenizers is installed to take one from") from e
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    byte: list[int]  # piece of each byte
    normal: dict[str, int]
    longest: int
    trie: dict[str, int] = field(default_factory=dict)  # the piece of a string, or 0 where it only begins some
    inside: set[str] = field(default_factory=set)  # two characters that are neighbours in some piece
    parts: dict[bytes, bytes] = field(default_factory=dict)
    old_parts: dict[bytes, bytes] = field(default_factory=dict)
    pairs: dict[int, bool] = field(default_factory=dict)
    tables: dict[str, object] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"parts": {}, "old_parts": {}, "pairs": {}, "tables": {}}

    @staticmethod
    def load(model_file: str | None = None) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file or default_model())
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        plain = {p: i for i, p in enumerate(pieces) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        scores = [sp.get_score(i) for i in range(n)]
        v = Vocabulary(pieces, scores, byte, plain, max(map(len, plain)))
        v.normal = {p: i for p, i in plain.items() if len(p) == 1 or v.merge(p, plain) == [p]}
        v.longest = max(map(len, v.normal))
        v.trie = {p[:k]: 0 for p in v.normal for k in range(1, len(p))} | v.normal
        v.inside = {p[k : k + 2] for p in v.normal for k in range(len(p) - 1)}
        return v

    def merge(self, text: str, among: dict[str, int]) -> list[str]:
        """Byte-pair merges of a short string: the pair with the best score first, the leftmost of several."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = among.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    @property
    def shift(self) -> int:
        return len(self.pieces).bit_length()

    def stays(self, u: int, v: int) -> bool:
        """Whether u and v are neighbours in an encoding."""
        if u <= 0 or v <= 0:
            return True
        key = u << self.shift | v
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[u], self.pieces[v]
            known = self.pairs[key] = self.merge(a + b, self.normal) == [a, b]
        return known

    def at(self, text: str, i: int) -> list[tuple[int, int]]:
        """(piece, end) of all pieces that start at a place; a character outside the vocabulary stands for itself."""
        out, trie = [], self.trie
        for k in range(i + 1, min(len(text), i + self.longest) + 1):
            p = trie.get(text[i:k])
            if p is None:
                break
            if p:
                out.append((p, k))
        if not out or out[0][1] != i + 1:
            out.append((-ord(text[i]), i + 1))
        return out

    def length(self, piece: int) -> int:
        return 1 if piece < 0 else len(self.pieces[piece])

    def ids(self, path: list[int]) -> list[int]:
        if not path or min(path) > 0:
            return path
        out: list[int] = []
        for p in path:
            if p > 0:
                out.append(p)
            else:
                out += [self.byte[b] for b in chr(-p).encode("utf-8", "surrogatepass")]
        return out

    def solve(self, text: str) -> list[int]:
        """The best path through the lattice of a stretch between two cuts that no piece crosses: a forward pass over states and the way back.

        From the one state of such a cut, one path of weight 0 leads to each place (the encoding of what lies before it), so a place has
        one state, and what ends at a place that has its state needn't be weighed.
        """
        n, pairs, stays, root, shift, longest = len(text), self.pairs, self.stays, self.nodes(), self.shift, self.longest
        state = [START] * (n + 1)
        for i in range(n):
            u, node, end = state[i], root, i
            for c in text[i : i + longest]:
                found = node.get(c)
                if found is None:
                    break
                node, piece = found
                end += 1
                if piece and not state[end]:
                    if u > 0:
                        known = pairs.get(u << shift | piece)
                        if not (stays(u, piece) if known is None else known):
                            continue
                    state[end] = piece
            if not state[i + 1]:  # a character outside the vocabulary stands for itself
                state[i + 1] = -ord(text[i])
        path, at = [], n
        while at:
            path.append(state[at])
            at -= self.length(state[at])
        path.reverse()
        return path

    def nodes(self) -> dict:
        """The pieces as a tree: from each character to the next one's node and the piece that ends there, if any."""
        if "nodes" not in self.tables:
            grown: dict[str, tuple[dict, int]] = {"": ({}, 0)}
            for p in sorted(self.trie):  # a string comes after those that it begins with
                grown[p] = ({}, self.trie[p])
                grown[p[:-1]][0][p[-1]] = grown[p]
            self.tables["nodes"] = grown[""][0]
        return self.tables["nodes"]

    def part(self, key: bytes) -> bytes:
        """The pieces of a stretch (UTF-8, with spaces) as bytes of 32-bit numbers, from the kept ones or solved."""
        known = self.old_parts.get(key)
        if known is None:
            known = np.array(self.ids(self.solve(key.decode("utf-8", "surrogatepass").replace(" ", SPACE))), np.int32).tobytes()
        if len(key) <= KEPT_LENGTH:
            if len(self.parts) >= KEPT_PARTS:
                self.old_parts, self.parts = self.parts, {}
            self.parts[key] = known
        return known

    def kinds(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each character that has neighbours in pieces (0 for others), and whether two numbers are neighbours in some piece."""
        if "kinds" not in self.tables:
            number = {c: i + 1 for i, c in enumerate(sorted({c for pair in self.inside for c in pair}))}
            kind, joins = np.zeros(0x110000, np.uint16), np.zeros((len(number) + 1, len(number) + 1), bool)
            for c, i in number.items():
                kind[ord(c)] = i
            kind[ord(" ")] = kind[ord(SPACE)]
            for pair in self.inside:
                joins[number[pair[0]], number[pair[1]]] = True
            self.tables["kinds"] = kind, joins
        return self.tables["kinds"]

    def open_cuts(self, text: str) -> np.ndarray:
        """Places from 1 to the last but one at which no piece crosses."""
        kind, joins = self.kinds()
        k = kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return np.flatnonzero(~joins[k[:-1], k[1:]]) + 1

    def encode_stretches(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of texts that begin and end at cuts that no piece crosses, one after the other, and where each text's end."""
        joined = "".join(texts).replace(SPACE, " ")
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        is_start = np.zeros(len(joined) + 1, bool)
        is_start[self.open_cuts(joined)] = True
        is_start[0] = is_start[len(joined)] = True
        is_start[ends] = True
        starts = np.flatnonzero(is_start)
        data = joined.encode("utf-8", "surrogatepass")
        if len(data) == len(joined):
            places = starts
        else:
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            wide = np.ones(len(codes) + 1, np.int64)
            wide[0] = 0
            for least in (0x80, 0x800, 0x10000):
                wide[1:] += codes >= least
            places = np.cumsum(wide)[starts]
        cells = pa.Array.from_buffers(pa.large_binary(), len(places) - 1, [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        parts, part = self.parts, self.part
        solved = [parts.get(k) or part(k) for k in cells.dictionary.to_pylist()]
        which = cells.indices.to_numpy()
        sizes = np.fromiter(map(len, solved), np.int64, len(solved)) // 4
        flat = np.frombuffer(b"".join(solved), np.int32)
        n = sizes[which]
        upto = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - (upto - n), n) + np.arange(int(upto[-1]))]
        return ids, np.concatenate([[0], upto])[np.searchsorted(starts, ends)]

    def encode(self, text: str | None) -> list[int]:
        return self.encode_stretches([" " + text])[0].tolist() if text else []

    def decode_table(self) -> pa.Array:
        if "bytes" not in self.tables:
            raw = {p: bytes([b]) for b, p in enumerate(self.byte)}
            self.tables["bytes"] = pa.array([raw.get(i) or p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for i, p in enumerate(self.pieces)], pa.large_binary())
        return self.tables["bytes"]

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of lists of pieces that lie one after the other: their bytes side by side; bytes that are no UTF-8 are replaced."""
        taken = pc.take(self.decode_table(), pa.array(ids))
        places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        data = taken.buffers()[2] or pa.py_buffer(b"")
        offsets = places[np.concatenate([[0], ends])]
        texts = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(offsets), data])
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            raw = data.to_pybytes()
            texts = pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.large_string())
        return pc.if_else(pc.starts_with(texts, " "), pc.utf8_slice_codeunits(texts, 1), texts).cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int32), np.array([len(ids)]))[0].as_py()


class Lattice:
    """Which pieces each entry state reaches, at every place.

    ``text`` starts at the cut and may run on beyond ``length``, for the pieces that reach beyond its end.
    """

    def __init__(self, vocabulary: Vocabulary, text: str, entries: list[State], length: int):
        self.v, self.entries, self.length = vocabulary, entries, length
        reach: dict[int, dict[int, int]] = {}
        for k, (piece, beyond) in enumerate(entries):
            at = reach.setdefault(beyond, {})
            at[piece] = at.get(piece, 0) | 1 << k
        stays = vocabulary.stays
        for i in range(length):
            here = reach.get(i)
            if not here:
                continue
            for piece, end in vocabulary.at(text, i):
                mask = 0
                for u, m in here.items():
                    if m & ~mask and stays(u, piece):
                        mask |= m
                if mask:
                    at = reach.setdefault(end, {})
                    at[piece] = at.get(piece, 0) | mask
        self.reach = reach

    def exits(self) -> list[State]:
        return sorted((p, i - self.length) for i, at in self.reach.items() if i >= self.length for p in at)

    def weights(self, exit_: State) -> np.ndarray:
        """The (max, +) weight from each entry state to an exit state."""
        mask = self.reach.get(self.length + exit_[1], {}).get(exit_[0], 0)
        return np.array([0.0 if mask >> k & 1 else -np.inf for k in range(len(self.entries))])

    def reached(self) -> np.ndarray:
        """The weight from each entry state to the end, by whatever piece."""
        return np.max([self.weights((p, 0)) for p in self.reach.get(self.length, {})], axis=0, initial=-np.inf)

    def trace(self, entry: int, exit_: State | None) -> list[int]:
        """The pieces that start in the lattice, on the path between two states; without an exit, the path to the end."""
        if exit_ is None:
            at = self.length
            piece = next(p for p, m in self.reach[at].items() if m >> entry & 1)
        else:
            piece, at = exit_[0], self.length + exit_[1]
        path = []
        while True:
            start = at - self.v.length(piece)
            if piece == START or start < 0:
                break
            path.append(piece)
            before = next(u for u, m in self.reach[start].items() if m >> entry & 1 and self.v.stays(u, piece))
            piece, at = before, start
        return path[::-1]


def entry_states(v: Vocabulary, before: str, after: str) -> list[State]:
    """Pieces that start in ``before`` (the characters next to the cut) and end at the cut or beyond; at a cut that no piece crosses, START."""
    text, b = before + after, len(before)
    if not before or text[b - 1 : b + 1] not in v.inside:
        return [(START, 0)]
    return sorted({(p, end - b) for s in range(max(0, b - v.longest), b) for p, end in v.at(text, s) if end >= b})


class Chunk:
    """A chunk between two cuts: its head, the stretches between its first and last cut that no piece crosses, and its tail.

    ``before`` holds the characters next to the cut at its start, ``text`` its own and those that pieces may reach, ``length`` its own number.
    """

    def __init__(self, vocabulary: Vocabulary, before: str, text: str, length: int):
        self.v, self.text, self.length = vocabulary, text, length
        self.entries = entry_states(vocabulary, before, text)
        crossed = vocabulary.open_cuts(text[: length + 1])
        crossed = crossed[crossed <= length]
        cuts = [0] * (self.entries == [(START, 0)]) + crossed.tolist() + [length] * (len(text) == length)
        self.first, self.last = (cuts[0], cuts[-1]) if cuts else (length, None)
        self.head = Lattice(vocabulary, text, self.entries, self.first)
        self.tail = Lattice(vocabulary, text[self.last :], [(START, 0)], length - self.last) if cuts else None

    def transfer(self) -> Transfer:
        """Entry states, exit states, and the (max, +) weight from each to each."""
        if self.tail is None:
            exits = self.head.exits()
            return self.entries, exits, np.stack([self.head.weights(s) for s in exits], axis=1) if exits else np.zeros((len(self.entries), 0))
        exits = self.tail.exits()
        if self.first == 0:
            entered = np.zeros(len(self.entries))
        else:
            entered = self.head.reached()
        return self.entries, exits, entered[:, None] + np.concatenate([self.tail.weights(s) for s in exits])[None, :]

    def trace(self, entry: State, exit_: State) -> list[int]:
        """The ids of the pieces that start in the chunk, on the best path between two states."""
        v, k = self.v, self.entries.index(entry)
        if self.tail is None:
            return v.ids(self.head.trace(k, exit_))
        out = v.ids(self.head.trace(k, None)) if self.first else []
        out += v.encode_stretches([self.text[self.first : self.last]])[0].tolist()
        return out + v.ids(self.tail.trace(0, exit_))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=-np.inf)


Transfer = tuple[list[State], list[State], np.ndarray]


def joined(x: Transfer, y: Transfer) -> Transfer:
    """Two neighbouring transfers as one; the first one's exits are matched to the second one's entries."""
    place = {s: i for i, s in enumerate(y[0])}
    pick = [(j, place[s]) for j, s in enumerate(x[1]) if s in place]
    return x[0], y[1], combine(x[2][:, [j for j, _ in pick]], y[2][[i for _, i in pick]])


def scan(parts: list[Transfer]) -> list[State]:
    """The state at each chunk's end, from an associative scan: transfers of halves combine, and states go down again."""
    tree = [parts]
    while len(tree[-1]) > 1:
        level = tree[-1]
        tree.append([joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)])
    top = tree[-1][0]
    row = top[2][0]
    # the text's end: the one exit that a path reaches without characters beyond
    ends = {0: (top[0][0], next(s for s, w in zip(top[1], row, strict=True) if s[1] == 0 and w == 0))}
    for level in reversed(tree[:-1]):
        down = {}
        for k, (entry, exit_) in ends.items():
            i = 2 * k
            if i + 1 >= len(level):
                down[i] = (entry, exit_)
                continue
            x, y = level[i], level[i + 1]
            left = {s: w for s, w in zip(x[1], x[2][x[0].index(entry)], strict=True)}
            right = y[2][:, y[1].index(exit_)]
            middle = next(s for s, w in zip(y[0], right, strict=True) if w == 0 and left.get(s) == 0)
            down[i], down[i + 1] = (entry, middle), (middle, exit_)
        ends = down
    return [ends[i][1] for i in range(len(parts))]


def chunked(v: Vocabulary, text: str, size: int = CHUNK) -> list[tuple[str, str, int]]:
    """(characters before the cut, text from the cut on with what pieces may reach, length) of each chunk of the model's form of a text."""
    full = SPACE + text.replace(" ", SPACE)
    return [(full[max(0, a - v.longest) : a], full[a : min(a + size, len(full)) + v.longest], min(size, len(full) - a)) for a in range(0, len(full), size)]


def encode_chunked(v: Vocabulary, text: str, size: int = CHUNK) -> list[int]:
    """The encoding of one text through chunks, all in one place."""
    if not text:
        return []
    chunks = [Chunk(v, *c) for c in chunked(v, text, size)]
    out, entry = [], (START, 0)
    for chunk, end in zip(chunks, scan([c.transfer() for c in chunks]), strict=True):
        out += chunk.trace(entry, end)
        entry = end
    return out


def _schema(docs: DataFrame, id_column: str) -> str:
    return f"id {docs.schema[id_column].dataType.simpleString()}"


_WORKER: dict[int, Vocabulary] = {}


def _shared(sent) -> Vocabulary:
    """A worker's own copy, so that solved stretches outlast a task."""
    if sent.id not in _WORKER:
        _WORKER.clear()
        _WORKER[sent.id] = sent.value
    return _WORKER[sent.id]


class _Sent:
    """A broadcast of fixed size (the vocabulary), with the number that tells it from others."""

    def __init__(self, spark, vocabulary: Vocabulary):
        self.held, self.id = spark.sparkContext.broadcast(vocabulary), id(vocabulary)

    @property
    def value(self) -> Vocabulary:
        return self.held.value


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model_file: str | None = None, size: int = CHUNK) -> DataFrame:
    """(id, ids): the pieces of every whole text.

    A text of one chunk is done where it lies, since the scan of one matrix is that matrix; the chunks of longer ones are dealt out singly, so
    that one text keeps as many tasks busy as it has chunks, and only boundary states of a text ever meet in one task.
    """
    spark = docs.sparkSession
    sent = _Sent(spark, Vocabulary.load(model_file))
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = _schema(docs, id_column)
    several = F.coalesce(F.length("text") >= size, F.lit(False))  # the model's form is one character longer

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _shared(sent)
        for batch in steps(batches, "text"):
            ids, ends = v.encode_stretches([" " + x if x else "" for x in batch.column(1).to_pylist()])
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["id", "ids"])

    one = source.filter(~several).mapInArrow(whole, f"{kind}, ids array<int>")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _shared(sent)
        for batch in steps(batches, "text", 1 << 20):
            for row in range(batch.num_rows):
                for at, (before, text, n) in enumerate(chunked(v, batch.column(2)[row].as_py(), size)):
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([at]), pa.array([before]), pa.array([text]), pa.array([n]),
                    ], names=["row", "id", "chunk", "before", "text", "n"])

    # rows may repeat an id, so every row has a number of its own, fixed by the checkpoint
    numbered = source.filter(several).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    dealt = numbered.mapInArrow(split, f"row long, {kind}, chunk long, before string, text string, n long")
    chunks = cut(dealt.repartition(partitions(spark), "row", "chunk"))

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _shared(sent)
        for pdf in frames:
            out = []
            for row, at, before, text, n in zip(pdf["row"], pdf["chunk"], pdf["before"], pdf["text"], pdf["n"], strict=True):
                entries, exits, m = Chunk(v, before, text, n).transfer()
                out.append((row, at, [x for s in entries for x in s], [x for s in exits for x in s], (m.reshape(-1) == 0).tolist()))
            yield pd.DataFrame(out, columns=["row", "chunk", "entries", "exits", "open"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        pairs = lambda x: [(int(a), int(b)) for a, b in zip(x[::2], x[1::2], strict=True)]
        parts = []
        for entries, exits, open_ in zip(pdf["entries"], pdf["exits"], pdf["open"], strict=True):
            a, b = pairs(entries), pairs(exits)
            parts.append((a, b, np.where(np.array(open_, bool).reshape(len(a), len(b)), 0.0, -np.inf)))
        ends = scan(parts)
        starts = [(START, 0), *ends[:-1]]
        return pd.DataFrame({"row": pdf["row"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "entry": [list(s) for s in starts], "end": [list(s) for s in ends]})

    moves = chunks.mapInPandas(matrices, "row long, chunk long, entries array<long>, exits array<long>, open array<boolean>")
    placed = moves.groupBy("row").applyInPandas(states, "row long, chunk long, entry array<long>, `end` array<long>")

    def traced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = _shared(sent)
        for pdf in frames:
            ids = []
            for before, text, n, entry, end in zip(pdf["before"], pdf["text"], pdf["n"], pdf["entry"], pdf["end"], strict=True):
                ids.append(Chunk(v, before, text, n).trace(tuple(map(int, entry)), tuple(map(int, end))))
            yield pd.DataFrame({"row": pdf["row"], "id": pdf["id"], "chunk": pdf["chunk"], "ids": ids})

    parts = chunks.join(placed, ["row", "chunk"]).mapInPandas(traced, f"row long, {kind}, chunk long, ids array<int>")
    long_ = parts.groupBy("row").agg(F.first("id").alias("id"), F.sort_array(F.collect_list(F.struct("chunk", "ids"))).alias("parts"))
    return one.unionByName(long_.select("id", F.flatten("parts.ids").alias("ids"))).withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, ids_column: str = "ids", model_file: str | None = None) -> DataFrame:
    """The input with a column ``decoded`` (one of that name is replaced); a null list gives null."""
    sent = _Sent(encoded.sparkSession, Vocabulary.load(model_file))
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept) + ", decoded string"
    place = kept.index(ids_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _shared(sent)
        for batch in steps(batches, ids_column):
            lists = batch.column(place)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            texts = v.decode_all(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32), ends)
            if lists.null_count:
                texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(run, schema)
