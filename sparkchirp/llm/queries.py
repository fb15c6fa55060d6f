"""The registered queries over the corpus operators, each on its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load
from .exact_dedup import duplicate_groups
from .lm import score_texts
from .neardup import near_duplicates
from .packing import pack, tokenise
from .pieces import round_trip
from .records import read_tokens, token_folder, write_tokens
from .sharding import shard
from .substrings import remove_repeats
from .threshold import quantised, top_k
from .toxicity import score, train


#: Sources are mixed by the square root of their tokens; where the small ones end, the others keep their proportions.
TEMPER = 0.5


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return duplicate_groups(docs, keep="largest", carry=[]).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_substring_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return remove_repeats(docs, carry=["doc_id"], digest=True).select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = train(docs, load(spark, sf_dir, "labels"), F.col("toxic"))
    return score(docs, model, carry=["doc_id"]).select("row.doc_id", "severity", "p_toxic", "grade", "rejected")


def op4_piece_backtracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    manifest = write_tokens(docs, vocabulary("byte_bpe_50k.json"), 2, token_folder(spark))
    return read_tokens(manifest).withColumnRenamed("id", "doc_id")


def op6_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    mark = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score_texts(docs, mark % 7 != 2, carry=["doc_id"]).select(
        "row.doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "left_out_score", "left_out_mean"
    )


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "kept")


def op8_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    tokens = tokenise(docs, vocabulary("word_bpe_49k.json"), 1)
    return pack(tokens, temper=TEMPER).withColumnRenamed("id", "doc_id")


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(load(spark, sf_dir, "documents"), 24).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "vslot",
        F.col("version").alias("map_version"),
    )


def op10_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(load(spark, sf_dir, "embeddings")), F.col("id") % 50 == 0, 5)


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_substring_automata": op2_substring_automata,
    "op3_ordinal_toxicity": op3_ordinal_toxicity,
    "op4_piece_backtracking": op4_piece_backtracking,
    "op5_token_records": op5_token_records,
    "op6_backoff_automaton": op6_backoff_automaton,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_mixture_packing": op8_mixture_packing,
    "op9_virtual_slots": op9_virtual_slots,
    "op10_threshold_top_k": op10_threshold_top_k,
}

SQL = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_threshold_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
            FROM usable q JOIN usable c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op2_substring_automata": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM w),
        win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS k FROM pos),
        rep AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
        gone AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN rep USING (k), range(35) r(o)),
        word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN kept USING (doc_id)
    """,
    "op7_dart_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), pos AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0
        ), sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM pos
        ), size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), near AS (
            SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9
            UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id < y.doc_id
        ), link AS (SELECT a, b FROM near UNION SELECT b, a FROM near
        ), reach(a, b) AS (
            SELECT doc_id, doc_id FROM w
            UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
        )
        SELECT a AS doc_id, min(b) AS class_id, min(b) = a AS kept FROM reach GROUP BY a
    """,
}
