"""Mixing sources to target weights by Pareto order sampling.

Every source has a word target.  A document's expected number of copies is its source's target over
its source's words: the whole part is certain, and the rest is the source's share p of inclusions.
Documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with u a uniform number that depends on the
document's id and text and on the seed, and p the document's inclusion probability; the sample is the head of that ranking whose words come nearest to what is left of
the target, so its size in words is fixed while inclusion probabilities differ: by source, and within a source by ``preference``, if one is given (else all of a source's are equal,
which is what a mix wants: every document of a source is as likely to be repeated).

The cut is found digit by digit: words per leading digit of the rank, then per next digit of those ranks that share the digit of the cut, until the cut
holds one document.  So no task ever orders a source, however large, and what is taken is decided row by row.  Targets come from sums over the
table of sources, which stays distributed: no source needs a row on the driver.

Defined results: a null text has size 0 and is taken 0 times over; a null source is a source of its own, last in
order; repeated rows are documents of their own, and as many of them are taken as the words allow; rows without an id are told apart by their texts; empty input gives an empty result; documents without
words never change a target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailspark.llm.common import cut, partitions, uniform

#: Bits of a digit of a rank, and digits of a rank; a second rank of as many parts rows that share the first.
DIGIT, DIGITS = 8, 7
#: Sources whose table is broadcast (some 100 bytes each); beyond, documents are joined with it by a shuffle.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ordered(sources: DataFrame) -> DataFrame:
    """The sources with their place in code point order, null last: ranges are numbered apart, and only their sizes meet."""
    placed = sources.repartitionByRange(partitions(sources.sparkSession), F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id())
    placed = cut(placed)
    sizes = sorted((r["part"], r["n_part"]) for r in placed.groupBy("part").agg(F.count("*").alias("n_part")).collect())
    before, at = {}, 0
    for part, n in sizes:
        before[part] = at
        at += n
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("part")) if before else F.lit(0)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1 + offset).drop("part")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, n) with the word target: sources in code point order, null last, weigh ``weights`` in turn and share ``share`` of all words;
    what exceeds ``cap`` times a source's words is shared again among the others by weight.

    A target is the smaller of ``cap * n`` and ``level * weight``; the level rises, sum by sum, until no more sources are at their cap.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = cut(_ordered(sources.select("source", F.col("n").cast("long").alias("n"))).withColumn("weight", weight).drop("place"))
    total = placed.agg(F.sum("n")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.lit(cap) * F.col("n")
        row = placed.agg(F.count(F.when(over, 1)).alias("k"), F.sum(F.when(over, F.col("n"))).alias("held"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if row["k"] == capped or not row["open"]:
            break
        capped, level = row["k"], (share * total - cap * (row["held"] or 0)) / row["open"]
    return placed.withColumn("target", F.when(over, F.lit(cap) * F.col("n")).otherwise(F.lit(level) * F.col("weight"))).drop("weight")


def _joined(rows: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Rows with what the table of sources (source, s struct) says about theirs."""
    other = sources.withColumnRenamed("source", "s_source")
    return rows.join(F.broadcast(other) if small else other, F.col("source").eqNullSafe(F.col("s_source")), "inner").drop("s_source")


def _prefix(key: Column, digits: int) -> Column:
    return F.shiftright(key, DIGIT * (DIGITS - digits))


def _ranks(depth: int) -> tuple[Column, Column]:
    """The first ``depth`` digits of a row's two ranks."""
    return _prefix(F.col("key"), min(depth, DIGITS)), _prefix(F.col("row_key"), max(0, depth - DIGITS))


def _cuts(ranked: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """(source, depth, high, low, before): the digits of the rank that holds the source's cut, and the words ranked before it; ``before`` is null if all are taken.

    ``ranked``: source, key, row_key, size; ``sources``: source, rest.
    """
    state = cut(sources.select("source", "rest", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("before"), F.lit(2).cast("long").alias("rows")))
    for depth in range(2 * DIGITS):
        unsure = state.filter(F.col("before").isNotNull() & (F.col("rows") > 1))
        if not unsure.limit(1).count():
            break
        high, low = _ranks(depth)
        held = _joined(ranked, unsure.select("source", F.struct("high", "low").alias("s")), small).filter((high == F.col("s.high")) & (low == F.col("s.low")))
        high, low = _ranks(depth + 1)
        found = held.groupBy("source", high.alias("high"), low.alias("low")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("high", "low").rowsBetween(Window.unboundedPreceding, 0))
        found = found.join(unsure.select(F.col("source").alias("s_source"), "rest", F.col("before").alias("earlier")), F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
        reached = found.withColumn("upto", F.col("earlier") + upto).filter(F.col("upto") >= F.col("rest"))
        first = reached.groupBy("source").agg(F.min_by(F.struct("high", "low", (F.col("upto") - F.col("words")).alias("before"), "rows"), F.struct("high", "low")).alias("f"))
        first = first.select(F.col("source").alias("f_source"), "f")
        is_unsure = F.col("before").isNotNull() & (F.col("rows") > 1)
        state = cut(state.join(first, F.col("source").eqNullSafe(F.col("f_source")), "left").select(
            "source", "rest", F.when(is_unsure, F.lit(depth + 1)).otherwise(F.col("depth")).alias("depth"),
            *[F.when(is_unsure, F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in ("high", "low", "before", "rows")],
        ))
    return state.select("source", "depth", "high", "low", "before")


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
        cap: float = 2.0, seed: int = 17, preference: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """(id, size, source_size, target, copies, taken), a row for each document, and a struct ``kept`` of the columns in ``keep``, if any are named.

    ``id_column`` is kept under its own name; all else the documents hold is left out.  ``preference``: a positive number for each document to which its inclusion probability is
    proportional within its source.
    """
    u = uniform(F.col(id_column), F.xxhash64(F.col(text_column)), seed=seed)
    kept = [F.struct(*[docs[c] for c in keep]).alias("kept")] if keep else []
    base = docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), words(F.col(text_column)).alias("size"), u.alias("u"),
        (preference if preference is not None else F.lit(1.0)).cast("double").alias("wish"), F.monotonically_increasing_id().alias("row"), *kept,
    )
    base = cut(base)
    slim = cut(base.drop("kept", "id")) if keep else base
    sources = cut(slim.groupBy("source").agg(F.sum("size").alias("n"), F.sum(F.col("size") * F.col("wish")).alias("wishes")))
    small = sources.count() <= BROADCAST_SOURCES
    goals = source_targets(sources, weights, share, cap).withColumnRenamed("source", "g_source").withColumnRenamed("n", "g_n")
    times = F.when(F.col("n") > 0, F.col("target") / F.col("n")).otherwise(F.lit(0.0))
    whole = F.least(F.lit(int(cap)), F.floor(times + 1e-12)).cast("int")
    plan = sources.join(goals, F.col("source").eqNullSafe(F.col("g_source"))).select(
        "source", "n", "target", whole.alias("whole"), F.greatest(F.lit(0.0), times - whole).alias("p"), F.greatest(F.lit(0.0), F.col("target") - whole * F.col("n")).alias("rest"),
        F.try_divide("wishes", "n").alias("wish"),
    )
    plan = cut(plan)

    def ranked(rows: DataFrame) -> DataFrame:
        """The rows' ranks, as numbers of DIGITS digits; ``s`` says the rest of the plan."""
        own = F.least(F.try_divide(F.col("s.p") * F.col("wish"), F.col("s.wish")), F.lit(1 - 1e-9))
        odds = F.try_divide(F.col("u") / (1 - F.col("u")) * (1 - own), own)
        top = float(1 << DIGIT * DIGITS)
        number = lambda x: F.least(F.lit((1 << DIGIT * DIGITS) - 1), F.floor(x * F.lit(top)))
        return rows.withColumn("key", number(odds / (1 + odds))).withColumn("row_key", number(uniform("row", seed=seed)))

    said = plan.select("source", F.struct("n", "target", "whole", "p", "rest", "wish").alias("s"))
    open_ = (F.col("s.p") > 0) & (F.col("s.rest") > 0)
    slim_ranked = ranked(_joined(slim, said, small).filter(open_ & (F.col("size") > 0))).select("source", "key", "row_key", "size")
    cuts = _cuts(slim_ranked, plan.filter("p > 0 and rest > 0").select("source", "rest"), small)
    said = plan.join(cuts.withColumnRenamed("source", "c_source"), F.col("source").eqNullSafe(F.col("c_source")), "left").drop("c_source")
    said = said.select("source", F.struct("n", "target", "whole", "p", "rest", "wish", "depth", "high", "low", "before").alias("s"))
    rows = ranked(_joined(base, said, small))
    # a rank's first digits against those of the cut; at the cut, the one document that is nearer in than out
    by_depth = lambda which: reduce(lambda x, d: x.when(F.col("s.depth") == d, _ranks(d)[which]), range(1, 2 * DIGITS + 1), F.when(F.col("s.depth") == 0, _ranks(0)[which]))
    high, low = by_depth(0), by_depth(1)
    earlier = (high < F.col("s.high")) | ((high == F.col("s.high")) & (low < F.col("s.low")))
    at = (high == F.col("s.high")) & (low == F.col("s.low")) & (F.col("s.before") + F.col("size") / 2 < F.col("s.rest"))
    more = F.when(open_ & (F.col("s.before").isNull() | earlier | at), 1).otherwise(0)
    copies = (F.col("s.whole") + more).cast("int")
    return rows.select(
        F.col("id").alias(id_column), "size", F.col("s.n").alias("source_size"), F.col("s.target").alias("target"), copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"),
        *(["kept"] if keep else []),
    )
