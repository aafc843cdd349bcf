"""The registered queries of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailspark.llm import chat, html_extract, langid, media, mixing, pii, simhash, spm, suffix_dedup, topk
from trailspark.llm.common import steps, table


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = langid.fit(docs, usable=~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counted = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")
    counts = [counted(k) for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(said(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every whole text, and whether decoding gives the text back (U+2581 in it would come back as a space)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = spm.decode(spm.encode(docs))
    return decoded.select("doc_id", F.size("ids").alias("n_pieces"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = media.clips(media.store(docs))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "payload"):
            n, sha, crc = zip(*map(media.digest, batch.column("payload").to_pylist()), strict=True)
            feature = [";".join(f"{c['start_ms']}-{c['end_ms']}:{c['frames']}:{c['luminance']}" for c in cs) for cs in batch.column("clips").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()),
                batch.column("media_bytes"), batch.column("media_sha256"), pa.array(feature),
            ], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return read.mapInArrow(run, schema)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles in order (s, u, a), turns and the canonical rendering of each conversation."""
    found = chat.format_conversations(chat.as_transcripts(table(spark, sf_dir, "conversations")))
    roles = F.array_join(F.transform("turns", lambda t: F.substring(t["role"], 1, 1)), "")
    return found.select("conv_id", "segment", F.size("turns").cast("long").alias("n_turns"), roles.alias("roles"), "rendered")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


OP2 = """
WITH usable AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.row, a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


#: Windows as hexadecimal text; runs are windows that touch or overlap.
OP3 = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
    SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS k FROM d)
), m AS (
    SELECT s, min(doc_id) AS first FROM w GROUP BY s
), r AS (
    SELECT w.doc_id, w.k FROM w JOIN m USING (s) WHERE m.first < w.doc_id
), i AS (
    SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM r
), g AS (
    SELECT doc_id, k, sum(CASE WHEN p IS NULL OR k > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM i
), runs AS (
    SELECT doc_id, min(k) AS a, max(k) + 50 AS b FROM g GROUP BY doc_id, run
), gaps AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
), kept AS (
    SELECT gaps.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, concat(string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a), substr(any_value(h), 2 * max(b) + 1)) AS h
    FROM gaps JOIN d USING (doc_id) GROUP BY gaps.doc_id
)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(kept.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(kept.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_langid, op2_topk, op3_suffix_dedup, op4_pii, op5_sentencepiece, op6_mixing, op7_media, op8_simhash, op9_chat, op10_html)}


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2, "op3_suffix_dedup": OP3}
