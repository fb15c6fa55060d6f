"""Exact deduplication by a content sort (DataFrame functions only).

Rows are range-partitioned on their normalised text by sampled splitters (``repartitionByRange``), sorted
externally inside each partition, and adjacent rows are compared on the full text by the window that
follows: it needs no further shuffle, because the range partitioning already keeps equal keys together.
Splitters are the first ``PREFIX`` characters, a digest of the whole text for texts that start alike, and
the salt: the sample that reaches the driver holds no whole texts, however long they are.

Groups of more than ``hot`` copies get a salt in the sort key, one value for about ``hot``
rows, so that a group holding a third of all rows spreads over many tasks; their partial results (one row a
salt) are then added up.  Nothing is dropped or capped.

Defined cases: null text counts as empty; null ids sort as the least wanted (any other id stays before
them); several rows with the same id and text are one group and just one of them stays; an empty table gives
an empty result; other columns pass through whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fan_out, materialise, safe_name

PREFIX = 32
BROADCAST_ROWS = 100_000  # about 5 MB of (digest, count) rows


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise=None,
    carry: list[str] | None = None,
    hot: int = 128,
    heads: bool = False,
) -> DataFrame:
    """One row for each input row: ``row`` (struct of the carried columns), ``id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``; with ``heads``, only rows that may be kept, and their ``key``.

    ``normalise`` maps the text column to the compared column (none: unchanged); ``keep`` says whether the
    ``smallest`` or the ``largest`` id of a group stays.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep: smallest or largest")
    spark = docs.sparkSession
    best_of = F.min if keep == "smallest" else F.max
    order = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    same: Column = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = normalise(same) if normalise else same
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]) if carry != [] else F.struct(F.lit(0).alias("_"))
    base = docs.select(row.alias("row"), F.col(f"`{id_col}`").alias("id"), key.alias("key"))

    # one pass over the texts: copies of each text that has many, and in the row without a digest the bytes of all
    found = base.select(F.xxhash64("key").alias("digest"), F.octet_length("key").cast("long").alias("size"))
    found = found.rollup("digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    found = materialise(found.where((F.col("n") > hot) | F.col("digest").isNull()), "hot-texts")
    size = found.where("digest is null").agg(F.max("size")).first()[0] or 0
    copies = found.where("digest is not null").select("digest", "n")
    n_hot = copies.count()
    if n_hot:
        few = n_hot <= BROADCAST_ROWS
        base = base.withColumn("digest", F.xxhash64("key")).join(F.broadcast(copies) if few else copies, "digest", "left")
        salts = F.ceil(F.col("n") / F.lit(hot))
        base = base.withColumn("salt", F.when(F.col("n").isNull(), F.lit(-1).cast("long")).otherwise(F.pmod(F.xxhash64("id", "row"), salts)))
    else:
        base = base.withColumn("digest", F.xxhash64("key")).withColumn("salt", F.lit(-1).cast("long"))

    splitter = ["prefix", "digest", *(["salt"] if n_hot else [])]  # a constant would cost the window a shuffle of its own
    base = base.select("row", "id", "key", F.substring("key", 1, PREFIX).alias("prefix"), "digest", "salt")
    sorted_rows = base.repartitionByRange(fan_out(spark, size), *splitter)
    run = Window.partitionBy(*splitter, "key")
    runs = sorted_rows.select(
        "row",
        "id",
        "salt",
        F.sha2(F.col("key").cast("binary"), 256).alias("text_sha256"),
        *(["key"] if heads else []),
        F.row_number().over(run.orderBy(order)).alias("place"),
        F.count(F.lit(1)).over(run).alias("n"),
        best_of("id").over(run).alias("best"),
    )
    more = ["key"] if heads else []
    if heads:
        runs = runs.where("place = 1")
    done = [*more, "row", "id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"), (F.col("place") == 1).alias("kept"), "text_sha256"]
    if not n_hot:
        return runs.select(*done)
    runs = materialise(runs, "text-runs")
    winner = F.min_by("salt", F.struct(F.col("best").isNull(), "best", "salt")) if keep == "smallest" else F.max_by("salt", F.struct("best", "salt"))
    totals = (
        runs.where((F.col("salt") >= 0) & (F.col("place") == 1))
        .groupBy("text_sha256")
        .agg(F.sum("n").alias("all_n"), best_of("best").alias("all_best"), winner.alias("all_salt"))
    )
    few = n_hot <= BROADCAST_ROWS
    hot_rows = runs.where(F.col("salt") >= 0).join(F.broadcast(totals) if few else totals, "text_sha256")
    return runs.where(F.col("salt") < 0).select(*done).unionByName(
        hot_rows.select(
            *more,
            "row",
            "id",
            F.col("all_best").alias("keep_id"),
            F.col("all_n").alias("group_size"),
            ((F.col("place") == 1) & (F.col("salt") == F.col("all_salt"))).alias("kept"),
            "text_sha256",
        )
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged."""
    if normalise is not None:
        return duplicate_groups(docs, id_col, text_col, keep, normalise, heads=True).where("kept").select("row.*")
    # the sorted key is the text itself: it travels once
    blank = safe_name(docs, "_null")
    others = [c for c in docs.columns if c != text_col]
    marked = docs.withColumn(blank, F.col(f"`{text_col}`").isNull())
    kept = duplicate_groups(marked, id_col, text_col, keep, carry=[*others, blank], heads=True).where("kept")
    text = F.when(~F.col("row").getField(blank), F.col("key")).alias(text_col)
    return kept.select(*[text if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
