"""Chat formatting: transcripts are parsed with a hidden Markov model, and turns rendered in one canonical form.

A transcript is plain text, with or without speaker markers.  Each line is an observation: the marker it starts with, and features of the
line (its length, a question mark, whether it is blank, looks like code or a list, or speaks as an instruction).  States are a role at the first line of a turn and a role
within one.  Emission and transition probabilities are counted on labelled transcripts, in the driver's bounded set made from a seed;
Viterbi recovers the states of a whole transcript, and with them roles and turns.

A long conversation lies in segments, so that no task gathers it.  Each segment yields the best weight from each state before it to each state at its end; those
matrices are combined in order, which fixes the states between segments, and each segment is traced back on its own between its two.  So states are those
of one Viterbi pass over the whole conversation.

Defined results: a null or empty transcript has no turns; blank lines between turns belong to the turn before and are trimmed; markers that name no known role
are text; ties go to the first state; repeated rows get repeated results; any length is read whole; a turn that runs on beyond a segment's end is rendered in parts.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import cut, steps

ROLES = ("system", "user", "assistant")
STATES = [(r, begins) for r in ROLES for begins in (True, False)]
# Words that name a speaker.
NAMES = {
    "system": "system sys instructions instruction context setup",
    "user": "user human me you question q customer client student asker prompt",
    "assistant": "assistant ai bot model answer a agent gpt reply support helper response",
}
SPEAKER = {name: role for role, names in NAMES.items() for name in names.split()}
MARKER = re.compile(
    r"^\s*(?:#{1,6}\s*|>\s*|[-*]\s+)?(?:\*\*|__)?"
    r"(?:\[\s*(?P<a>[A-Za-z]+)\s*\d{0,3}\s*\]|<\|?\s*(?P<b>[A-Za-z]+)\s*\|?>|\(\s*(?P<c>[A-Za-z]+)\s*\)|(?P<d>[A-Za-z]+)\s*\d{0,3}\s*(?=\**[:>]|\s[-—]\s))"
    r"(?:\*\*|__)?\s*[:>—-]{0,2}(?:\*\*|__)?\s*(?P<rest>.*)$",
    re.S,
)
SMOOTH = 0.5
#: A marker says more about the speaker than the shape of a line does, so what was never seen with a state counts for less there.
MARKER_SMOOTH = 1e-4


def marker(line: str) -> tuple[str | None, str]:
    """The role that a marker at the line's start names, if any, and the rest of the line."""
    m = MARKER.match(line)
    if m:
        role = SPEAKER.get((m["a"] or m["b"] or m["c"] or m["d"]).lower())
        if role:
            return role, m["rest"]
    return None, line


def observe(line: str, marked: bool) -> tuple[str, ...]:
    """``marked``: whether any line of the transcript has a marker; where none has, a line without one tells nothing."""
    role, rest = marker(line)
    words = rest.split()
    first = re.sub(r"\W", "", words[0].lower()) if words else ""
    return (
        f"marker:{role}" if marked else "unmarked",
        f"words:{min(5, len(words).bit_length())}",
        f"ask:{rest.rstrip().endswith('?')}",
        f"blank:{not words}",
        f"shape:{'code' if rest.startswith(('    ', chr(9), '```')) else 'list' if re.match(r'(?:[-*•]|[0-9]+[.)]) ', rest) else 'plain'}",
        f"tone:{'rule' if first in ('you', 'always', 'never', 'answer', 'be') else 'ask' if first in ('how', 'what', 'why', 'can', 'could', 'please', 'where', 'when', 'who', 'is', 'do') else 'say' if first in ('sure', 'yes', 'no', 'of', 'here', 'to', 'the', 'certainly') else 'none'}",
    )


@dataclass
class Model:
    first: np.ndarray
    moves: np.ndarray
    emissions: list[dict[str, np.ndarray]]  # for each feature, its values' log probabilities by state
    rare: list[np.ndarray]


Labelled = list[tuple[str, bool, str]]  # role, whether the line begins a turn, line


def fit(transcripts: list[Labelled]) -> Model:
    n = len(STATES)
    number = {s: i for i, s in enumerate(STATES)}
    first, moves = np.full(n, SMOOTH), np.full((n, n), 1e-3)
    counts: list[Counter] = []
    totals = np.zeros(n)
    for lines in transcripts:
        last = None
        marked = any(marker(line)[0] for _, _, line in lines)
        for role, begins, line in lines:
            s = number[role, begins]
            if last is None:
                first[s] += 1
            else:
                moves[last, s] += 1
            last = s
            totals[s] += 1
            for k, value in enumerate(observe(line, marked)):
                if k == len(counts):
                    counts.append(Counter())
                counts[k][value, s] += 1
    # a transcript begins with a turn's first line, and a line within a turn follows its own role
    for i, (r, begins) in enumerate(STATES):
        if not begins:
            first[i] = 1e-9
            for j, (q, _) in enumerate(STATES):
                if q != r:
                    moves[j, i] = 1e-9
    emissions, rare = [], []
    for k, c in enumerate(counts):
        values, smooth = {v for v, _ in c}, SMOOTH if k else MARKER_SMOOTH
        emissions.append({v: np.array([math.log((c[v, s] + smooth) / (totals[s] + smooth * (len(values) + 1))) for s in range(n)]) for v in values})
        rare.append(np.array([math.log(smooth / (totals[s] + smooth * (len(values) + 1))) for s in range(n)]))
    return Model(np.log(first / first.sum()), np.log(moves / moves.sum(axis=1, keepdims=True)), emissions, rare)


def labelled_transcripts(count: int = 400, seed: int = 13) -> list[Labelled]:
    """A bounded set of labelled transcripts in several styles, made from a seed; some without markers."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    styles = [("System: ", "User: ", "Assistant: "), ("[system] ", "[human] ", "[ai] "), ("### System: ", "### Human: ", "### Assistant: "), ("**System:** ", "**Q:** ", "**A:** "), ("<system> ", "<user> ", "<assistant> "), ("", "", "")]
    out = []
    for k in range(count):
        style = dict(zip(ROLES, styles[k % 6 if r.random() < 0.9 else 5], strict=True))
        turns = (["system"] if r.random() < 0.3 else []) + ["user" if i % 2 == 0 else "assistant" for i in range(r.randint(2, 8))]
        lines: Labelled = []
        for role in turns:
            body = {"system": [f"{r.choice(['You', 'Always', 'Answer', 'Be'])} {words(4, 40)}.", f"{words(3, 50).capitalize()}."][r.random() < 0.5 :][:1],
                    "user": [r.choice([f"{r.choice(['How', 'What', 'Can', 'Why'])} {words(3, 12)}?", f"{words(3, 60).capitalize()}."])],
                    "assistant": [r.choice([f"{r.choice(['Sure', 'Yes', 'Here', 'The'])}, {words(6, 30)}.", f"{words(10, 40).capitalize()}."])]}[role]
            body += [r.choice([f"{words(3, 25).capitalize()}.", f"- {words(2, 8)}", "", f"    {words(2, 5)}"]) for _ in range(r.choice((0, 0, 1, 2, 4)))]
            lines += [(role, i == 0, (style[role] if i == 0 else "") + x) for i, x in enumerate(body)]
        out.append(lines)
    return out


@lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled_transcripts())


def _emissions(lines: list[str], model: Model, marked: bool) -> Iterator[np.ndarray]:
    known: dict[tuple[str, ...], np.ndarray] = {}
    for line in lines:
        o = observe(line, marked)
        if o not in known:
            known[o] = sum(e.get(v, rare) for e, rare, v in zip(model.emissions, model.rare, o, strict=True))
        yield known[o]


def has_marker(lines: list[str]) -> bool:
    return any(marker(line)[0] for line in lines)


def transfer(lines: list[str], model: Model, marked: bool, begins: bool) -> np.ndarray:
    """The best weight from each state before the lines (rows; all alike where a transcript ``begins`` with them) to each state of the last one."""
    best = None
    for e in _emissions(lines, model, marked):
        if best is None:
            best = (np.tile(model.first, (len(STATES), 1)) if begins else model.moves) + e
        else:
            best = (best[:, :, None] + model.moves[None]).max(axis=1) + e
    return best


def between(transfers: list[np.ndarray]) -> list[int]:
    """The state at each segment's end on the best path through all."""
    ahead = [transfers[0][0]]
    for m in transfers[1:]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    ends = [int(ahead[-1].argmax())]
    for best, m in zip(reversed(ahead[:-1]), reversed(transfers[1:]), strict=True):
        ends.append(int((best + m[:, ends[-1]]).argmax()))
    return ends[::-1]


def decode(lines: list[str], model: Model, marked: bool | None = None, before: int | None = None, last: int | None = None) -> list[tuple[str, bool]]:
    """The most likely state of each line; of a segment, between the state ``before`` it and its ``last`` one."""
    if not lines:
        return []
    best, back = None, []
    for e in _emissions(lines, model, has_marker(lines) if marked is None else marked):
        if best is None:
            best = (model.first if before is None else model.moves[before]) + e
            continue
        x = best[:, None] + model.moves
        back.append(x.argmax(axis=0))
        best = x.max(axis=0) + e
    at = int(best.argmax()) if last is None else last
    path = [at]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return [STATES[s] for s in reversed(path)]


def turns_of(lines: list[str], states: list[tuple[str, bool]]) -> list[tuple[str, str]]:
    turns: list[tuple[str, list[str]]] = []
    for line, (role, begins) in zip(lines, states, strict=True):
        if begins or not turns:
            turns.append((role, [marker(line)[1] if begins else line]))
        else:
            turns[-1][1].append(line)
    return [(role, text) for role, ls in turns if (text := "\n".join(ls).strip())]


def parse(transcript: str | None, model: Model | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    if not transcript:
        return []
    lines = transcript.split("\n")
    return turns_of(lines, decode(lines, model or default_model()))


def canonical(turns: list[tuple[str, str]]) -> str:
    """Turns between fixed tags; a tag that the text itself holds is escaped, so rendering is never ambiguous."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '<\\|')}\n<|end|>\n" for role, text in turns)


TURNS = "array<struct<role:string,text:string>>"


def format_transcripts(transcripts: DataFrame, text_column: str = "text", model: Model | None = None) -> DataFrame:
    """The other columns, with ``turns`` and the canonical ``rendered`` text; columns of those names are replaced."""
    kept = [c for c in transcripts.columns if c not in (text_column, "turns", "rendered")]
    sent = transcripts.sparkSession.sparkContext.broadcast(model or default_model())  # of fixed size
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    schema = ", ".join([*(f"`{c}` {transcripts.schema[c].dataType.simpleString()}" for c in kept), f"turns {TURNS}", "rendered string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "__text"):
            turns = [parse(x, sent.value) for x in batch.column(len(kept)).to_pylist()]
            rows = [[{"role": r, "text": t} for r, t in ts] for ts in turns]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(rows, kind), pa.array([canonical(ts) for ts in turns], pa.string())], names=[*kept, "turns", "rendered"])

    return transcripts.select(*kept, F.col(text_column).alias("__text")).mapInArrow(run, schema)


SEGMENT = 512  # turn numbers


def as_transcripts(conversations: DataFrame, id_column: str = "conv_id", segment: int = SEGMENT) -> DataFrame:
    """(id, segment, text): the turns of each conversation in order, as plain transcripts with a marker for each turn, ``segment`` turn numbers to a row.

    Rows that repeat all of a turn are that turn once; rows with one turn number and different texts stay, in the order of their text; null turns come first, in
    a segment of their own; null roles get no marker, null texts are empty.
    """
    word = F.when(F.col("role").isNull(), F.lit("")).otherwise(F.concat(F.initcap("role"), F.lit(": ")))
    line = F.concat(word, F.coalesce("text", F.lit("")))
    turns = conversations.select(id_column, "turn", line.alias("line")).distinct()
    gathered = F.sort_array(F.collect_list(F.struct("turn", "line")))
    parts = turns.groupBy(id_column, F.floor(F.col("turn") / segment).alias("segment"))
    return parts.agg(F.array_join(F.transform(gathered, lambda t: t["line"]), "\n").alias("text"))


def format_conversations(segments: DataFrame, id_column: str = "conv_id", model: Model | None = None) -> DataFrame:
    """(id, segment, turns, rendered) of (id, segment, text): the segments of one id are one transcript, in the order of their numbers, a null one first."""
    sent = segments.sparkSession.sparkContext.broadcast(model or default_model())  # of fixed size
    kind = segments.schema[id_column].dataType.simpleString()
    rows = cut(segments.select(F.col(id_column).alias("id"), "segment", "text"))
    several = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("s_id"))
    same = F.col("id").eqNullSafe(F.col("s_id"))
    one = format_transcripts(rows.join(several, same, "left_anti"), model=model)
    long_ = cut(rows.join(several, same, "left_semi"))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            marks = [has_marker(x.split("\n")) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.bool_())], names=["id", "segment", "mark"])

    marks = long_.mapInArrow(seen, f"id {kind}, segment long, mark boolean")
    said = marks.groupBy("id").agg(F.max("mark").alias("marked"), F.min(F.struct("segment")).alias("low")).select(F.col("id").alias("s_id"), "marked", F.col("low.segment").alias("low"))
    known = cut(long_.join(said, same).select("id", "segment", "text", "marked", F.col("segment").eqNullSafe(F.col("low")).alias("begins")))

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            texts, marked, begins = (batch.column(i).to_pylist() for i in (2, 3, 4))
            found = [transfer(x.split("\n"), sent.value, m, b).reshape(-1).tolist() for x, m, b in zip(texts, marked, begins, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["id", "segment", "matrix"])

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment", na_position="first")
        ends = between([np.asarray(m).reshape(len(STATES), -1) for m in pdf["matrix"]])
        return pd.DataFrame({"id": pdf["id"], "segment": pdf["segment"].astype("Int64"), "before": [-1, *ends[:-1]], "last": ends})

    moves = known.mapInArrow(matrices, f"id {kind}, segment long, matrix array<double>")
    placed = moves.groupBy("id").applyInPandas(states, f"id {kind}, segment long, before int, last int")
    placed = placed.select(F.col("id").alias("p_id"), F.col("segment").alias("p_segment"), "before", "last")
    met = known.join(placed, F.col("id").eqNullSafe(F.col("p_id")) & F.col("segment").eqNullSafe(F.col("p_segment"))).select("id", "segment", "text", "marked", "before", "last")
    turns_kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            turns = []
            for text, marked, before, last in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                lines = text.split("\n")
                turns.append(turns_of(lines, decode(lines, sent.value, marked, None if before < 0 else before, last)))
            rows_ = [[{"role": r, "text": t} for r, t in ts] for ts in turns]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows_, turns_kind), pa.array([canonical(ts) for ts in turns], pa.string())], names=["id", "segment", "turns", "rendered"])

    both = one.select("id", "segment", "turns", "rendered").unionByName(met.mapInArrow(traced, f"id {kind}, segment long, turns {TURNS}, rendered string"))
    return both.withColumnRenamed("id", id_column)
