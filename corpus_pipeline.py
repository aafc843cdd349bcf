"""The corpus pipeline: language ID, near-copies, personal data, mixing, tokens; each stage works on all that the stage before it kept.

All stages but the last return the columns of their documents, whatever else these hold: a stage numbers the columns before it calls an operator, so no name clashes
with one of the operator's own.  An empty table passes through all stages and stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import langid, mixing, pii, simhash, spm
from trailspark.llm.common import cut, table

#: A document goes if no letter is in it, or if no language has this share of its letters.
LEAST_SCORE = 0.35


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with columns c0, c1, ..., and each column's new name."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(rows: DataFrame, names: dict[str, str], **instead) -> DataFrame:
    return rows.select(*[instead.get(c, F.col(n)).alias(c) for c, n in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach.

    A null or empty text, and one without letters, is in none and goes; so does a text of which no language has the share LEAST_SCORE. Repeated rows
    stay or go together; where no row has a label there is nothing to tell languages by, and all documents go.
    """
    rows, names = _numbered(docs)
    model = langid.fit(rows, names["text"], names["lang"], names["doc_id"])
    found = langid.identify(rows, model, names["text"], keep=rows.columns)
    return _named(found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays, once if its row is repeated.

    A null text counts as an empty one, so all empty documents are copies of each other; a document without an id can't be told from others and stays.
    """
    rows, names = _numbered(docs)
    own = names["doc_id"]
    groups = cut(simhash.near_copies(rows, own, names["text"]))
    stays = groups.filter(F.col(own) == F.col("component_id")).select(own).distinct()
    kept = rows.join(stays, own, "left_semi")
    if groups.groupBy(own).count().filter("count > 1").limit(1).count():  # repeated rows of one id
        kept = kept.dropDuplicates([own])
    return _named(kept.unionByName(rows.filter(F.col(own).isNull())), names)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span's kind in its place; ``n_chars``, where there is such a column, is that of the new text. A null text stays null, an empty one empty."""
    rows, names = _numbered(docs)
    found = pii.detect(rows, names["text"], keep=[c for c in rows.columns if c != names["text"]])
    changed = {"text": F.col("redacted"), "n_chars": F.length("redacted").cast("long")}
    return _named(found, names, **{c: x for c, x in changed.items() if c in names})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: rows without an id and repeated rows too; a null or empty text has no words, and what of them is taken adds none."""
    rows, names = _numbered(docs)
    taken = mixing.mix(rows, names["doc_id"], names["text"], names["source"], keep=rows.columns).filter("copies > 0")
    return _named(taken.select("kept.*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")), names)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_pieces) of every document that the mix holds: one row for each copy; a null or empty text has no pieces."""
    tokens = spm.encode(docs)
    return tokens.select("doc_id", "ids", F.size("ids").alias("n_pieces"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing", mix_sources),
    ("SentencePiece", encode_tokens),
]

#: Trained models, fingerprints and byte-pair encodings are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
