"""Check queries: what the operators must hold on the whole of ``documents``, with the SQL that says so.

The tokenizers' ids themselves are no matter for SQL, but that they give the text back is; laws of packing and sharding
are stated for every document and shard; scores are computed again from counts, rounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load
from .queries import op4_piece_backtracking, op6_backoff_automaton, op8_mixture_packing, op9_virtual_slots, vocabulary
from .records import read_tokens, token_folder, write_tokens


def check_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding what was encoded gives the text."""
    return op4_piece_backtracking(spark, sf_dir).select("doc_id", "decoded_sha256")


def check_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids in the files, without the end id, decode to the text; they lie in the order of the documents."""
    path = vocabulary("byte_bpe_50k.json")
    manifest = write_tokens(load(spark, sf_dir, "documents"), path, 2, token_folder(spark))

    def work(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4") for x in batch.column(1).to_pylist()]
            last = pa.array([int(x[-1]) for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tokenizer.decode(x[:-1].tolist(), skip_special_tokens=False) for x in ids], pa.string()), last], names=["doc_id", "text", "last"])

    texts = read_tokens(manifest, with_ids=True).select("id", "ids").mapInArrow(work, "doc_id long, text string, last long")
    return texts.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "last")


def check_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the automaton, to four decimals."""
    return op6_backoff_automaton(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("base_score", "score")}).drop("left_out_score", "left_out_mean")


def check_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: do its pieces cover all its ids once, and are they gapless in sequences that are full?"""
    pieces = op8_mixture_packing(spark, sf_dir)
    place = F.col("sequence_id") * 2048 + F.col("offset")
    by_place = pieces.select("doc_id", "start", "length", "doc_tokens", place.alias("at")).repartitionByRange("at")
    by_document = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    told = by_place.withColumn("before", F.coalesce(F.sum("length").over(by_document), F.lit(0)))
    fits = F.bool_and((F.col("before") == F.col("start")) & (F.col("at") % 2048 + F.col("length") <= 2048) & (F.col("length") > 0))
    documents = told.groupBy("doc_id").agg(fits.alias("gapless"), (F.sum("length") == F.max("doc_tokens")).alias("whole"))
    # the pieces' places add up to all tokens, none twice: as many places as tokens, and the last one is the number of tokens
    total = pieces.agg((F.sum("length") == F.max(place + F.col("length"))).alias("full"), (F.countDistinct(place) == F.count(F.lit(1))).alias("apart"))
    return documents.crossJoin(F.broadcast(total))


def check_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every shard: are its slots gapless, and is its size within a hundredth of an equal share (or of the largest record)?"""
    rows = op9_virtual_slots(spark, sf_dir)
    gapless = (F.min("slot") == 0) & (F.max("slot") == F.count(F.lit(1)) - 1) & (F.countDistinct("slot") == F.count(F.lit(1)))
    shards = rows.groupBy("shard").agg(gapless.alias("gapless"), F.sum("size").alias("bytes"), F.max("size").alias("most"))
    total = rows.agg((F.sum("size") / 24).alias("share"), F.max("size").alias("largest"))
    near = F.abs(F.col("bytes") - F.col("share")) <= F.greatest(0.01 * F.col("share"), F.col("largest"))
    return shards.crossJoin(F.broadcast(total)).select("shard", "gapless", near.alias("near_equal"))


QUERIES = {f.__name__: f for f in (check_pieces, check_records, check_scores, check_packing, check_shards)}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = {
    "check_pieces": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
    "check_records": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, 2::BIGINT AS last FROM documents",
    "check_packing": "SELECT DISTINCT doc_id, true AS gapless, true AS whole, true AS full, true AS apart FROM documents",
    "check_shards": "SELECT range::INTEGER AS shard, true AS gapless, true AS near_equal FROM range(24)",
    "check_scores": rf"""
        WITH crc AS (
            SELECT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384)))) % 7 <> 2 AS learn, text
            FROM documents
        ), d AS (
            SELECT doc_id, learn, list_append(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^ 	-
]+'), '') AS ws FROM crc
        ), tok AS (
            SELECT doc_id, learn, ws[i] AS w, CASE WHEN i = 1 THEN ' ' ELSE ws[i - 1] END AS a, CASE WHEN i = 1 THEN NULL WHEN i = 2 THEN ' ' ELSE ws[i - 2] END AS b
            FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM d)
        ), c1 AS (SELECT w, count(*) AS c FROM tok WHERE learn GROUP BY w
        ), c2 AS (SELECT a, w, count(*) AS c FROM tok WHERE learn GROUP BY a, w
        ), c3 AS (SELECT b, a, w, count(*) AS c FROM tok WHERE learn AND b IS NOT NULL GROUP BY b, a, w
        ), h1 AS (SELECT w AS a, c FROM c1 UNION ALL SELECT ' ', count(*) FROM d WHERE learn
        ), z AS (
            SELECT (SELECT coalesce(sum(c), 0) FROM c1) AS n, (SELECT count(*) FROM c1) AS v,
                   (SELECT (count(*) FILTER (c = 1) + 1) / (2 * count(*) FILTER (c = 2) + 1)::DOUBLE FROM c2) AS k2, (SELECT (count(*) FILTER (c = 1) + 1) / (2 * count(*) FILTER (c = 2) + 1)::DOUBLE FROM c3) AS k3
        ), p AS (
            SELECT doc_id, learn, tok.b, c1.c AS known, (coalesce(c1.c, 0) + 1) / (n + v + 1)::DOUBLE AS p1, coalesce(c2.c, 0) AS x2, coalesce(h1.c, 0) AS y2, coalesce(c3.c, 0) AS x3, coalesce(h2.c, 0) AS y3, k2, k3, n
            FROM tok CROSS JOIN z LEFT JOIN c1 ON c1.w = tok.w LEFT JOIN c2 ON c2.a = tok.a AND c2.w = tok.w LEFT JOIN h1 ON h1.a = tok.a
                 LEFT JOIN c3 ON c3.b = tok.b AND c3.a = tok.a AND c3.w = tok.w LEFT JOIN c2 h2 ON h2.a = tok.b AND h2.w = tok.a
        ), q AS (SELECT *, (x2 + k2 * p1) / (y2 + k2) AS p2 FROM p)
        SELECT doc_id, NOT learn AS held_out, count(*) AS n_tokens, count(known) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10(p1)), 4) AS base_score,
               round(sum(log10(CASE WHEN b IS NULL THEN p2 ELSE (x3 + k3 * p2) / (y3 + k3) END)), 4) AS score
        FROM q GROUP BY doc_id, learn
    """,
}
