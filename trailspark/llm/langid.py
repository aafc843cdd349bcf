"""Language identification with a linear-chain conditional random field over words.

Every word of a text has a label (a language).  Its score for each label sums the weights of affix, n-gram and lexicon features; learned
transitions tie neighbours, so code-switched texts get runs of labels.  Forward-backward gives each word's label probabilities,
and a document's language is the label with the largest share of letters.

Training uses about ``PER_LABEL`` labelled documents of each label (twice as many at most), chosen by a hash of their id, and a run of ``RUN`` words of each, which is cut at random into shorter ones that are
strung together to code-switched sequences.  Labels are learned from text and label alone; their number is the classifier's number of classes, a row each on the driver.

Defined results: a null text and one without letters is ``und`` with score 0, and so is every text if nothing labelled is there to learn from;
ties go to the first label in code point order; repeated rows get repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import steps, uniform

PER_LABEL = 250
#: Words of a labelled document that training sees (a run from a place chosen by a hash), and characters of such a word.
RUN, RUN_CHARS = 600, 100
SEQUENCES = 700
EPOCHS = 4
BATCH = 35
LEXICON = 400
BITS = 15
LONGEST = 24  # letters of a piece; longer runs of letters are several pieces, so that no letter is left out
PIECE = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
UNKNOWN = "und"


def pieces(text: str | None) -> list[str]:
    return PIECE.findall(text.lower()) if text else []


def _mix(*parts: np.ndarray | int) -> np.ndarray:
    h = np.uint32(0x811C9DC5)
    for p in parts:
        h = (h ^ np.asarray(p, np.uint32)) * np.uint32(0x9E3779B1)
        h = h ^ (h >> np.uint32(15))
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """Feature numbers of each word, a row each; what a word lacks is feature 0, whose weight stays 0."""
    codes = np.array(words, dtype=f"U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST)
    n = (codes > 0).sum(axis=1)
    at = np.arange(len(words))
    with np.errstate(over="ignore"):
        out = []
        a, b, c = codes[:, :-2], codes[:, 1:-1], codes[:, 2:]
        pair = np.where(codes[:, 1:] > 0, _mix(2, codes[:, :-1], codes[:, 1:]), 0)
        out += [pair, np.where(c > 0, _mix(3, a, b, c), 0)]
        last = [codes[at, np.maximum(n - k, 0)] * (n >= k) for k in (1, 2, 3)]
        out.append(np.stack([
            _mix(11, codes[:, 0]), _mix(12, codes[:, 0], codes[:, 1]), np.where(n >= 3, _mix(13, codes[:, 0], codes[:, 1], codes[:, 2]), 0),
            _mix(21, last[0]), np.where(n >= 2, _mix(22, last[1], last[0]), 0), np.where(n >= 3, _mix(23, last[2], last[1], last[0]), 0),
            _mix(31, np.minimum(n, 9)),
        ], axis=1))
    own = np.array([lexicon.get(w, -1) for w in words], np.int32)
    out.append(np.where(own >= 0, (1 << BITS) + own, 0)[:, None])
    return np.concatenate(out, axis=1)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # from x to, log
    first: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.labels)), np.float32)
        for i in range(0, len(words), 8192):
            f = features(words[i : i + 8192], self.lexicon)
            out[i : i + 8192] = self.weights[f].sum(axis=1)
        return out


class Layout:
    """Sequences side by side: step t holds the t-th word of each sequence that is longer than t, the longest sequence first."""

    def __init__(self, lengths: np.ndarray):
        order = np.argsort(-lengths, kind="stable")
        rank = np.empty(len(lengths), np.int64)
        rank[order] = np.arange(len(lengths))
        longest = int(lengths.max()) if len(lengths) else 0
        ending = np.bincount(lengths, minlength=longest + 1)
        self.active = len(lengths) - np.cumsum(ending)[:longest]
        self.start = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        self.sequence = np.repeat(np.arange(len(lengths)), lengths)
        t = np.arange(len(self.sequence)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = self.start[t] + rank[self.sequence]
        self.steps = longest


def forward_backward(emission: np.ndarray, model: Model, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of each word, and expected moves summed over all sequences; emission and result in the order of the words."""
    e = np.empty_like(emission)
    e[layout.place] = np.exp(emission - emission.max(axis=1, keepdims=True))
    move = np.exp(model.moves - model.moves.max()).astype(np.float32)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    s, n = layout.start, layout.active
    for t in range(layout.steps):
        x = e[s[t] : s[t + 1]]
        a = (alpha[s[t - 1] : s[t - 1] + n[t]] @ move) * x if t else np.exp(model.first - model.first.max()).astype(np.float32) * x
        alpha[s[t] : s[t + 1]] = a / a.sum(axis=1, keepdims=True)
    moved = np.zeros(move.shape)
    for t in range(layout.steps - 2, -1, -1):
        k = n[t + 1]
        y = e[s[t + 1] : s[t + 2]] * beta[s[t + 1] : s[t + 2]]
        b = y @ move.T
        total = b.sum(axis=1, keepdims=True)
        beta[s[t] : s[t] + k] = b / total
        a = alpha[s[t] : s[t] + k]
        norm = (a * b).sum(axis=1, keepdims=True)
        moved += (a / norm).T @ y * move
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    return p[layout.place], moved


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model | None:
    """A model from (text, label) rows by AdaGrad on the conditional likelihood."""
    rows = sorted((y, x) for x, y in rows if x and y is not None)
    by: dict[str, list[list[str]]] = {}
    for y, x in rows:
        if w := pieces(x):
            by.setdefault(y, []).append(w)
    if not by:
        return None
    labels = sorted(by)
    r = np.random.default_rng(seed)
    lexicon: dict[str, int] = {}
    for y in labels:
        seen = Counter(w for doc in by[y] for w in set(doc))
        for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[: LEXICON]:
            lexicon.setdefault(w, len(lexicon))
    sequences = []
    for _ in range(SEQUENCES):
        words, ys = [], []
        for _ in range(r.integers(1, 5)):
            y = int(r.integers(len(labels)))
            docs = by[labels[y]]
            doc = docs[r.integers(len(docs))]
            n = int(r.integers(4, 26))
            at = int(r.integers(max(1, len(doc) - n + 1)))
            words += doc[at : at + n]
            ys += [y] * len(doc[at : at + n])
        sequences.append((words, ys))
    k = len(labels)
    size = (1 << BITS) + len(lexicon)
    model = Model(labels, np.zeros((size, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    vocabulary = sorted({w for ws, _ in sequences for w in ws})
    number = {w: i for i, w in enumerate(vocabulary)}
    feats = features(vocabulary, lexicon)
    squares, move_squares, first_squares = np.full((size, k), 1e-3, np.float32), np.full((k, k), 1e-3), np.full(k, 1e-3)
    for epoch in range(EPOCHS):
        order = r.permutation(len(sequences))
        for at in range(0, len(order), BATCH):
            batch = [sequences[i] for i in order[at : at + BATCH]]
            ids = np.array([number[w] for ws, _ in batch for w in ws])
            ys = np.array([y for _, yy in batch for y in yy])
            layout = Layout(np.array([len(ws) for ws, _ in batch]))
            f = feats[ids]
            p, moved = forward_backward(model.weights[f].sum(axis=1), model, layout)
            error = -p
            error[np.arange(len(ids)), ys] += 1
            same = layout.sequence[1:] == layout.sequence[:-1]
            true = np.zeros((k, k))
            np.add.at(true, (ys[:-1][same], ys[1:][same]), 1)
            flat = f.reshape(-1)
            grad = np.stack([np.bincount(flat, np.repeat(error[:, j], f.shape[1]), size) for j in range(k)], axis=1) / len(batch)
            grad -= 1e-5 * model.weights
            grad[0] = 0
            squares += grad.astype(np.float32) ** 2
            model.weights += (0.1 * grad / np.sqrt(squares)).astype(np.float32)
            move_grad = (true - moved) / len(batch)
            move_squares += move_grad**2
            model.moves += 0.1 * move_grad / np.sqrt(move_squares)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            first_grad = error[starts].sum(axis=0) / len(batch)
            first_squares += first_grad**2
            model.first += 0.1 * first_grad / np.sqrt(first_squares)
    return model


def fit(docs: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id", per_label: int = PER_LABEL, usable: Column | None = None) -> Model | None:
    """A model of the labelled documents for which ``usable`` holds; it sees ``per_label`` of each label at most, however many there are."""
    rows = docs.filter(F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    if usable is not None:
        rows = rows.filter(usable)
    counts = {r[label_column]: r["n"] for r in rows.groupBy(label_column).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    u = uniform(F.col(id_column).cast("string"), seed=29)
    wanted = None
    for y, n in sorted(counts.items()):
        one = (F.col(label_column) == y) & (u < min(1.0, per_label / n))
        wanted = one if wanted is None else wanted | one
    # a run of words of each, cut where the row lies: the driver gets a bounded number of bounded texts, the same at every run
    every = F.regexp_extract_all(F.col(text_column), F.lit(rf"(?s)\S{{1,{RUN_CHARS}}}"), F.lit(0))
    at = (uniform(F.col(id_column).cast("string"), seed=31) * F.greatest(F.lit(1), F.size("words") - RUN + 1)).cast("int") + 1
    chosen = rows.filter(wanted).select(u.alias("u"), F.col(id_column), every.alias("words"), F.col(label_column).alias("label"))
    runs = chosen.select("u", F.array_join(F.slice("words", at, RUN), " ").alias("run"), "label")
    got = runs.orderBy("u", "label", "run").limit(2 * per_label * len(counts)).collect()
    return train([(r["run"], r["label"]) for r in got])


def label_words(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, letters, label probabilities) of each word."""
    lists = [pieces(x) for x in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = np.array([w for x in lists for w in x], object)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(model.labels)))
    ids, unique = pd.factorize(flat)
    emission = model.emissions(list(unique))[ids]
    letters = np.array([len(w) for w in unique])[ids]
    layout = Layout(lengths)
    p, _ = forward_backward(emission, model, layout)
    return layout.sequence, letters, p


def predict(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    sequence, letters, p = label_words(texts, model)
    shares = np.stack([np.bincount(sequence, letters * p[:, j], len(texts)) for j in range(len(model.labels))], axis=1)
    total = shares.sum(axis=1)
    best = shares.argmax(axis=1)
    score = np.where(total > 0, shares[np.arange(len(texts)), best] / np.maximum(total, 1e-9), 0.0)
    return [model.labels[b] if t > 0 else UNKNOWN for b, t in zip(best, total, strict=True)], np.clip(score, 0, 1)


def identify(docs: DataFrame, model: Model | None, text_column: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all but the text where not given), with ``lang_pred`` and ``score``; columns of those names are replaced."""
    kept = [c for c in (keep if keep is not None else [c for c in docs.columns if c != text_column]) if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by features x labels
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "lang_pred string, score double"])

    # a text that stays is sent once
    own = text_column in kept
    text_at, batch_text = (kept.index(text_column), text_column) if own else (len(kept), "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, batch_text):
            labels, scores = predict(batch.column(text_at).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.select(*kept, *([] if own else [F.col(text_column).alias("__text")])).mapInArrow(run, schema)
