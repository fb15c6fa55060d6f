"""Mixture-controlled packing of token sequences.

Each source is a queue of documents, and output is made in windows by deficit round robin: in every window each queue
that is not empty gets a credit of tokens in proportion to its target share (``window_sequences`` sequences of
``length`` tokens for all of them), sends as many ``grain``s of tokens as its credit covers, cut wherever that is, and
carries the rest of the credit to its next window.  A queue with credit q that sends token e does so in the window k with
grain * floor(k q / grain) <= e < grain * floor((k + 1) q / grain): a closed form, so no window waits for another, and
deficits carry over windows and partitions alike.  A queue never is a grain or more away from its share.  Where a
queue ends, the others go on with their credits, which are the same proportions among them.

Target shares are given by name (``targets``), else they are tokens of the source to the power ``temper``, 1 being the
sources' own shares.  Sources without a target come after all others, by their own shares.  Windows are laid end to end
and cut into sequences; only the very last sequence may be shorter.

Positions are running sums in two levels: rows are range-partitioned and summed inside each task, then the sums of
tasks (a bounded number) are added up; rows of one source or one window are never gathered in a task.

Defined cases: null or empty text gives a document of the end id alone; null source is a source of its own; null ids
stay null; documents longer than a sequence are cut; rows that repeat are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fan_out, materialise, small_batches, text_blocks, tidied
from .tokens import encoder

GRAIN = 16  # tokens
BROADCAST_ROWS = 100_000  # about 5 MB of sources


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", remember: int = 1_200_000, block_chars: int = 1 << 23) -> DataFrame:
    """(row, id, source, n, ids) of every document, written to the shared folder; ``row`` numbers the rows.

    ``remember`` bounds the chunks a worker keeps the ids of (about 200 bytes each) and ``block_chars`` the text
    it encodes at a time: more memory, less time.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
    )
    schema = T.StructType([rows.schema["id"], rows.schema["source"], T.StructField("n", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def work(batches):
        enc = encoder(tokenizer)
        enc.memo.most = remember
        end = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            text = batch.column(2).to_pylist()
            for a, b in text_blocks(text, block_chars):
                ids = [x + end for x in enc.packed(text[a:b])]
                n = pa.array([len(x) // enc.width for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), n, pa.array([enc.width] * (b - a), pa.int32()), pa.array(ids, pa.binary())], names=schema.names
                )

    return materialise(small_batches(rows).mapInArrow(tidied(work), schema).withColumn("row", F.monotonically_increasing_id()), "token-ids")


def running(df: DataFrame, order: list[str], amount: str, out: str, name: str, rows: int) -> DataFrame:
    """``df`` (about ``rows`` rows, which differ in ``order``) with the sum of ``amount`` over all rows before in that order."""
    parts = fan_out(df.sparkSession, 64 * rows)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_in", T.LongType())])
    at = df.columns.index(amount)

    def add_up(batches):
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + np.cumsum(np.asarray(batch.column(at)))
            if len(ends):
                before = np.concatenate([[total], ends[:-1]])
                total = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ends), part, np.int32)), pa.array(before, pa.int64())], names=schema.names)

    table = materialise(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(add_up, schema), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task: MOST_PARTS at most
    sums = table.groupBy("_part").agg(F.sum(amount).alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    return table.join(F.broadcast(sums), "_part").withColumn(out, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def credits(queue: DataFrame, span: int, targets: dict[str, float] | None, temper: float) -> DataFrame:
    """(source, head, credit, late): where each source's queue begins in the order of all, its tokens a window, and the window
    that its first token may be sent in; ``queue`` has source, at and n."""
    sources = queue.groupBy("source").agg(F.min("at").alias("head"), F.sum("n").cast("double").alias("all_n"))
    if targets is None:
        weight = F.pow("all_n", F.lit(temper))
    else:
        named = F.create_map(*[x for s, w in targets.items() for x in (F.lit("s" + s), F.lit(float(w)))]) if targets else None
        weight = F.coalesce(F.element_at(named, F.col("source")), F.lit(0.0)) if targets else F.lit(0.0)
    sources = sources.withColumn("weight", weight)
    sums = sources.agg(F.sum("weight").alias("of_weight"), F.sum(F.when(F.col("weight") <= 0, F.col("all_n"))).alias("of_rest"))
    sources = sources.crossJoin(F.broadcast(sums))  # one row
    credit = F.when(F.col("weight") > 0, span * F.col("weight") / F.col("of_weight")).otherwise(span * F.col("all_n") / F.col("of_rest"))
    sources = sources.select("source", "head", "all_n", "weight", credit.alias("credit"))
    last = sources.agg(F.max(F.when(F.col("weight") > 0, F.ceil(F.col("all_n") / F.col("credit")) + 1)).alias("last"))
    return sources.crossJoin(F.broadcast(last)).select("source", "head", "credit", F.when(F.col("weight") > 0, F.lit(0)).otherwise(F.coalesce("last", F.lit(0))).cast("long").alias("late"))


def schedule(rows: DataFrame, length: int, window_sequences: int = 32, targets: dict[str, float] | None = None, temper: float = 1.0, grain: int = GRAIN) -> DataFrame:
    """(row, start, len, at): stretches of documents and their place in the output; ``rows`` has row, source and n."""
    queue = rows.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("source"), "row", "n")
    count = rows.count()
    queue = running(queue, ["source", "row"], "n", "at", "queues", count)
    sources = materialise(credits(queue, length * window_sequences, targets, temper), "credits")
    if sources.count() <= BROADCAST_ROWS:
        sources = F.broadcast(sources)
    q, g = F.col("credit"), F.lit(grain)
    a, b = F.col("at") - F.col("head"), F.col("at") - F.col("head") + F.col("n")
    long = lambda c: c.cast("long")
    edge = lambda k: long(F.floor(k * q / g)) * g
    # the windows that the document's tokens a to b - 1 may lie in, or where these are many, its grains
    windows = F.transform(F.sequence(F.greatest(long(F.floor(a / q)) - 1, F.lit(0)), long(F.floor(b / (q))) + 1 + long(F.ceil(g / q))), lambda k: F.struct(k.alias("k"), edge(k).alias("x"), edge(k + 1).alias("y")))
    grains = F.transform(F.sequence(long(F.floor(a / g)), long(F.floor((b - 1) / g))), lambda m: F.struct((long(F.ceil((m + 1) * g / q)) - 1).alias("k"), (m * g).alias("x"), ((m + 1) * g).alias("y")))
    cuts = queue.join(sources, "source").select("row", "source", "late", a.alias("a"), F.explode(F.when(q >= g, windows).otherwise(grains)).alias("c"), b.alias("b"))
    start, end = F.greatest("a", F.col("c.x")), F.least("b", F.col("c.y"))
    cuts = cuts.select((F.col("late") + F.col("c.k")).alias("window"), "source", start.alias("place"), "row", (start - F.col("a")).alias("start"), (end - start).alias("len")).where("len > 0")
    return running(cuts, ["window", "source", "place"], "len", "at", "chunks", 2 * count).select("row", "start", "len", "at")


def pack(
    tokens: DataFrame, length: int = 2048, window_sequences: int = 32, targets: dict[str, float] | None = None, temper: float = 1.0, grain: int = GRAIN, with_ids: bool = False
) -> DataFrame:
    """Pieces (id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of tokenised documents."""
    spark = tokens.sparkSession
    chunks = schedule(tokens.select("row", "source", "n"), length, window_sequences, targets, temper, grain)
    placed = chunks.groupBy("row").agg(F.collect_list(F.struct("start", "len", "at")).alias("chunks"))
    size = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    rows = tokens.select("row", "id", "source", "width", "ids").repartition(fan_out(spark, size), "row").join(placed, "row").select("id", "source", "width", "ids", "chunks")
    schema = T.StructType(
        [rows.schema["id"], rows.schema["source"]]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + ([T.StructField("ids", T.BinaryType())] if with_ids else [])
    )

    def work(batches):
        for batch in batches:
            keys, sources, width, ids, chunks = (batch.column(i) for i in range(5))
            take, out, blobs = [], [], []
            for i, (w, raw, cs) in enumerate(zip(width.to_pylist(), ids.to_pylist(), chunks.to_pylist(), strict=True)):
                wide = np.frombuffer(raw, f"<u{w}").astype("<u4")
                for c in cs:
                    start, left, at = c["start"], c["len"], c["at"]
                    while left:
                        n = min(left, length - at % length)
                        part = wide[start : start + n]
                        take.append(i)
                        out.append((start, n, zlib.crc32(part), len(wide), at // length, at % length))
                        if with_ids:
                            blobs.append(part.tobytes())
                        start, left, at = start + n, left - n, at + n
            if take:
                cols = [pa.array(c, pa.int64()) for c in np.array(out, np.int64).T]
                idx = pa.array(take, pa.int32())
                yield pa.RecordBatch.from_arrays([keys.take(idx), sources.take(idx), *cols, *([pa.array(blobs, pa.binary())] if with_ids else [])], names=schema.names)

    return rows.mapInArrow(tidied(work), schema)
