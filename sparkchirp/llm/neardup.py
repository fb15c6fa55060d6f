"""Near-duplicate detection with DartMinHash signatures, banded joining and exact checks.

Each word shingle of a text owns a region of weight; darts are thrown at it by a hash, as a Poisson process over
time and weight.  A text keeps for each of ``bands * rows`` coordinates the earliest dart that lands in its
regions, so two texts agree in a coordinate with the probability of their weighted Jaccard similarity;
only about k ln k darts a text are thrown, whatever its size.  Equal bands make candidates.
A shingle that occurs c times weighs 1 + ``REPEAT`` * (1 - 1/c): repeats count, but never so much that texts with the same
shingles stop being candidates.  Similarity itself is that of shingle sets, checked exactly.

1. Equal texts are collapsed by their SHA-256; one row of each text goes on.
2. Buckets of equal bands link each text to the bucket's smallest and largest; the components of
   these links are candidate clusters, so all true pairs that share a band lie in one cluster.
3. Each cluster is checked on its whole shingle sets: starting anywhere, texts of similarity ``least`` or more
   are reached step by step, each compared only with texts not reached yet; no pairs are listed.
   Clusters of more than ``block`` texts are split: every block also gets the cluster's pivots, whose
   components are joined up.  Texts outside the largest component are then, in chunks, compared with all texts that share
   a bucket with one of the chunk, in parts of ``block``: no candidate pair that could join two classes is lost, and a
   cluster that only hangs together by chance costs as much as its buckets, not the square of its size.
4. A class is a component of verified links, named by its smallest id.

With 25 bands of 5 rows a pair of similarity 0.8 shares no band with probability 5e-5, one of 0.9 with 2e-10, where
shingles repeat alike in both or not at all; if every shared shingle repeated without end in one text and not at all in
the other, weighted similarities would be 0.64 and 0.72, and these 6e-2 and 5e-3.

Defined cases: null text counts as empty; texts without words have no shingles and only equal ones share a
class; texts of fewer words than a shingle have one, all their words; null ids name no class unless all of
its ids are null; rows that repeat are members of the same class; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, fan_out, gram_starts, grams, materialise, mix, row_slices, small_batches, text_size, tidied, tidied_group
from .components import components

BLOCK_BYTES = 3 << 19  # text that is signed at a time
REPEAT = 0.25  # how much more than one a shingle can weigh
_STEP, _AIM, _BAND = U64(0x9E3779B97F4A7C15), U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB)


def shingles(column, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the distinct shingles of every text, by document and hash."""
    w = Words(column)
    h = w.hashes()
    n = np.diff(w.first)
    docs, keys = [], []
    if len(h) >= width:
        at = np.flatnonzero(gram_starts(w.first, width)[: len(h) - width + 1])
        keys.append(grams(h, width)[at])
        docs.append(np.searchsorted(w.first, at, "right") - 1)
    for k in range(1, width):
        d = np.flatnonzero(n == k)
        if len(d):
            keys.append(grams(h, k)[w.first[d]])
            docs.append(d)
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[first], key[first], np.diff(np.concatenate([first, [len(key)]]))


def dart_minhash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray | None, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs x k) of weighted sets: element ``key`` of set ``doc`` with ``weight`` (None: 1 each).

    An entry packs the dart's time (32-bit float) and 32 bits that name it; sets without elements have the
    largest value throughout.  Weights are met by cells [0, 1), [1, 2), [2, 4), ... of the weight axis, each
    with darts of its own; a dart counts if its place on the weight axis lies below the element's weight.
    """
    best = np.full(n_docs * k, ~U64(0))
    mass = np.bincount(doc, weights=weight, minlength=n_docs)
    until = np.zeros(n_docs)
    until[mass > 0] = k * (math.log(k) + 4) / mass[mass > 0]
    todo = np.flatnonzero(mass > 0)
    while len(todo):
        pick = np.isin(doc, todo) if len(todo) < n_docs else slice(None)
        d0, e0 = doc[pick], key[pick]
        w0 = None if weight is None else weight[pick]
        level, low, high = 0, 0.0, 1.0
        while True:
            if w0 is not None:
                inside = w0 > low
                if not inside.any():
                    break
                d, w = d0[inside], w0[inside]
                state = mix(e0[inside] + np.full(1, level, U64) * _BAND)
            else:
                d, w, state = d0, None, mix(e0)
            time = np.zeros(len(d))
            rate = high - low
            while len(d):
                state = mix(state + _STEP)
                time = time - np.log(((state >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
                go = time <= until[d]
                d, state, time = d[go], state[go], time[go]
                if not len(d):
                    break
                name = mix(state ^ _AIM)
                cell = d * k + ((name >> U64(32)) % U64(k)).astype(np.int64)
                packed = (time.astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (name & U64(0xFFFFFFFF))
                if w is not None:
                    w = w[go]
                    hit = low + rate * ((mix(name) >> U64(11)).astype(np.float64) * 2.0**-53) < w
                    cell, packed = cell[hit], packed[hit]
                np.minimum.at(best, cell, packed)
            if w0 is None:
                break
            level, low, high = level + 1, high, 2 * high
        open_ = (best.reshape(n_docs, k) == ~U64(0)).any(axis=1)
        todo = todo[open_[todo]]
        until[todo] *= 2
    return best.reshape(n_docs, k)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; keys of different bands do not mix."""
    bands = signature.shape[1] // rows
    out = np.empty((len(signature), bands), U64)
    for b in range(bands):
        key = np.full(len(signature), b, U64) * _BAND
        for c in range(b * rows, (b + 1) * rows):
            key = mix(key ^ signature[:, c] * _STEP)
        out[:, b] = key
    return out


class Sets:
    """Distinct shingle hashes of some texts, with an inverted index to intersect one with all."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        key = np.concatenate(sets)
        _, number = np.unique(key, return_inverse=True)
        self.offset = np.concatenate([[0], np.cumsum(self.size)])
        self.number = number
        doc = np.repeat(np.arange(len(sets)), self.size)
        order = np.argsort(number, kind="stable")
        self.post = doc[order]
        self.begin = np.searchsorted(number[order], np.arange(number.max() + 2 if len(number) else 1))

    def similar(self, v: int, least: float) -> np.ndarray:
        """Which texts have similarity ``least`` or more with text v."""
        e = self.number[self.offset[v] : self.offset[v + 1]]
        a, n = self.begin[e], self.begin[e + 1] - self.begin[e]
        ends = np.cumsum(n)
        at = np.repeat(a - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        common = np.bincount(self.post[at], minlength=len(self.size))
        return (common > 0) & (common >= least * (self.size + self.size[v] - common) - 1e-9)


def reach(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Component number of every text under links of similarity ``least`` or more."""
    n = len(sets)
    out = np.full(n, -1)
    index = Sets(sets)
    left = np.ones(n, np.bool_)
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        out[root] = root
        queue = [root]
        while queue and left.any():
            near = index.similar(queue.pop(), least) & left
            if near.any():
                left &= ~near
                found = np.flatnonzero(near)
                out[found] = root
                queue.extend(found.tolist())
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, weighted: bool) -> DataFrame:
    """(row, id, sha, bands) of every row, written to the shared folder; ``row`` numbers the rows."""
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    base = base.select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), "text")
    kind = base.schema["id"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for a, b in row_slices(batch.column(2), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                doc, key, count = shingles(part.column(2), width)
                sig = dart_minhash(doc, key, 1 + REPEAT * (1 - 1 / count) if weighted else None, b - a, bands * rows)
                keys = band_keys(sig, rows).view(np.int64)
                full = np.bincount(doc, minlength=b - a) > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel()))], names=["id", "sha", "bands"])

    out = small_batches(base).mapInArrow(tidied(work), f"id {kind}, sha binary, bands array<bigint>").withColumn("row", F.monotonically_increasing_id())
    return materialise(out, "signatures")


def _links(rows: DataFrame, parts: int, width: int, least: float) -> DataFrame:
    """(a, b, cluster): a spanning forest of the verified links inside every (cluster, part); ``rows`` has cluster, part, node, text.

    Clusters are dealt to ``parts`` bins by a hash, the parts of one cluster to bins one after the other.
    """
    part = F.col("part").cast("long")
    turn = F.shiftright(part, 31) + F.pmod(part, F.lit(1 << 31)) * 7919
    bins = rows.withColumn("bin", F.pmod(F.pmod(F.xxhash64("cluster"), F.lit(parts)) + F.pmod(turn, F.lit(parts)), F.lit(parts)).cast("int"))

    def work(table: pa.Table) -> pa.Table:
        cluster, part, node = (np.asarray(table.column(c)) for c in ("cluster", "part", "node"))
        order = np.lexsort((node, part, cluster))
        table = table.take(pa.array(order))
        cluster, part, node = cluster[order], part[order], node[order]
        doc, key, _ = shingles(table.column("text"), width)
        at = np.searchsorted(doc, np.arange(len(node) + 1))
        new = np.flatnonzero(np.concatenate([[True], (np.diff(cluster) != 0) | (np.diff(part) != 0)])) if len(node) else np.zeros(0, int)
        a, b, c = [], [], []
        for i, j in zip(new.tolist(), [*new[1:].tolist(), len(node)], strict=True):
            _, once = np.unique(node[i:j], return_index=True)
            if len(once) < 2:
                continue
            nodes = node[i:j][once]
            root = nodes[reach([key[at[i + k] : at[i + k + 1]] for k in once.tolist()], least)]
            far = root != nodes
            a += nodes[far].tolist()
            b += root[far].tolist()
            c += [int(cluster[i])] * int(far.sum())
        return pa.table([pa.array(x, pa.int64()) for x in (a, b, c)], names=["a", "b", "cluster"])

    found = bins.repartitionById(parts, "bin").groupBy("bin").applyInArrow(tidied_group(work), "a long, b long, cluster long")
    return found.hint("rebalance")  # a few numbers from each task: as many files as their size needs


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    least: float = 0.8,
    bands: int = 25,
    rows: int = 5,
    weighted: bool = True,
    block: int = 256,
) -> DataFrame:
    """(id, sha, class_id, kept) of every row: rows of one class are near duplicates, linked by steps of similarity
    ``least`` or more; one row of each class is kept, the one with the smallest id.

    Without ``weighted`` repeats do not count in signatures either.
    """
    spark = docs.sparkSession
    signed = signatures(docs, id_col, text_col, width, bands, rows, weighted)
    keeper = F.min_by("row", F.struct(F.col("id").isNull(), "id", "row"))
    texts = materialise(signed.groupBy("sha").agg(F.min("row").alias("node"), F.min("id").alias("id"), F.first("bands").alias("bands"), keeper.alias("keeper")), "texts")

    # every text with a bucket of its own bands that others share: the smallest and largest of these buckets
    keyed = texts.select("node", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high")).where("n > 1").drop("n")
    star = keyed.join(buckets, "key").groupBy("node").agg(F.min("low").alias("label"), F.array_union(F.collect_set("low"), F.collect_set("high")).alias("near"))
    star = materialise(star, "stars")
    # the component of each text's smallest neighbour: nearly all links end there already
    hubs = components(star.select(F.explode("near").alias("a"), F.col("label").alias("b")))
    clusters = star.select("node", "label").join(hubs.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("cluster"))
    clusters = materialise(clusters, "clusters")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    members = materialise(clusters.join(sizes, "cluster").join(texts.select("node", "sha", "id"), "node"), "members")

    # their texts: one pass over the documents, joined by a merge whatever the size, so that no side is gathered
    _, size = text_size(docs, f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("sha", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    found = members.alias("m").join(source.alias("s").hint("merge"), F.col("m.sha").eqNullSafe(F.col("s.sha")) & F.col("m.id").eqNullSafe(F.col("s.id")))
    found = materialise(found.select("m.node", "m.cluster", "m.blocks", "s.text"), "member-texts")
    split, held = found.agg(F.count(F.when(F.col("blocks") > 1, 1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = fan_out(spark, held, 4 << 20)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("node", F.lit(7)), 4 * F.col("blocks")) == 0)
    first = found.select("cluster", F.explode(F.when(pivot, every).otherwise(F.array(own))).alias("part"), "node", "text")
    links = materialise(_links(first, parts, width, least), "links")

    if split:
        big = members.where("blocks > 1").select("node", "cluster", "blocks")
        rooted = components(links.join(big.select("cluster").distinct(), "cluster", "left_semi").select("a", "b"))
        rooted = materialise(big.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        counts = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
        main = counts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        rest = materialise(rooted.join(main, "cluster").where("root <> main").select("node", "cluster"), "rest")
        if rest.limit(1).count():
            chunks = rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
            asked = rest.join(chunks, "cluster").select("cluster", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("c"))
            # the texts that share a bucket with any text of a chunk, in parts of ``block``
            keyed = big.join(texts.select("node", "bands"), "node").select("cluster", "node", F.explode("bands").alias("key"))
            wanted = keyed.join(asked.select("node", "c"), "node").select("cluster", "key", "c").distinct()
            met = materialise(keyed.join(wanted, ["cluster", "key"]).select("cluster", "c", "node").distinct(), "met")
            parts_of = met.groupBy("cluster", "c").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
            whole = met.join(parts_of, ["cluster", "c"]).select("cluster", "c", F.pmod(F.xxhash64("node"), F.col("parts")).alias("k"), "node")
            asked = asked.join(parts_of, ["cluster", "c"]).select("cluster", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("k"), "node")
            again = whole.unionByName(asked).select("node", (F.col("k") * (1 << 31) + F.col("c")).alias("part"))
            second = found.where("blocks > 1").select("cluster", "node", "text").join(again, "node").select("cluster", "part", "node", "text")
            links = links.unionByName(materialise(_links(second, parts, width, least), "links-again"))
        roots = components(links.select("a", "b"))
    else:
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))  # already stars on the smallest node
        roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())

    # classes of more than one text; every other text is a class of its own
    joined = roots.join(texts.select("node", "id"), "node")
    names = joined.groupBy("root").agg(F.min("id").alias("class_id"), F.min_by("node", F.struct(F.col("id").isNull(), "id", "node")).alias("best"))
    named = joined.join(names, "root").select("node", "class_id", (F.col("node") == F.col("best")).alias("best"))
    classes = texts.select("sha", "node", "id", "keeper").join(named, "node", "left")
    own_class = F.col("best").isNull()
    classes = classes.select("sha", F.when(own_class, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), (own_class | F.col("best")).alias("best"), "keeper")
    return signed.select("row", "id", "sha").join(classes, "sha").select("id", "sha", "class_id", (F.col("best") & (F.col("row") == F.col("keeper"))).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, columns unchanged."""
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col("id").alias("i"), F.col("sha").alias("s"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.coalesce(F.col("row").getField(text_col).cast("string"), F.lit("")).cast("binary"), 256)))
    found = rows.join(kept, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")), "left_semi")
    one = Window.partitionBy("id", "sha").orderBy(F.lit(0))
    return found.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")
