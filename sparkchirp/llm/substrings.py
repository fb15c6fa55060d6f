"""Substring deduplication with suffix automata of reference shards.

A window is ``width`` consecutive words of a document; words covered by a window that starts anywhere else too
are removed, all its occurrences alike, judged on the input.

Every part of the corpus is a reference for all others, so no automaton is broadcast to all documents: that would
be quadratic.  Automata are built for small reference shards, and text is only sent to those it can match:

1. A window's anchor is the run of ``width // 3`` words in it with the smallest hash (the leftmost of equal ones), so
   equal windows have equal anchors; neighbouring windows share theirs, one anchor serves about 13.  Groups of
   documents count anchors through buckets.  Only text around anchors that occur again goes on: a repeated window
   is never lost, whatever else passes is for the automata to decide.
2. The reference shard of an anchor is all stretches of words whose windows have it, equal stretches with their
   number.  A suffix automaton is built of it, the stretches are streamed through, and the matching statistics
   (the longest string that ends at each word and occurs at least twice) give the maximal spans of ``width`` or more.
3. An anchor that occurs more than ``HOT`` times (a line or passage of many documents) would make a large shard of
   mostly different stretches.  Its windows are counted too, each by itself, and those that occur again go on
   one by one, each with a shard of its own: the same automata decide, at any number of copies.
4. Groups remove the spans.

Groups send equal stretches once with all their places, so a passage common to many documents arrives once for each
group that has it, not once a document; shards are dealt by a hash of the anchor.  An automaton holds at most ``HOT``
stretches of an anchor, or the copies of one window.

Defined cases: null text has no words; documents shorter than a window lose nothing; rows that repeat are
further occurrences, so all their windows go; texts of any length are read whole; an empty table gives an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automaton import SuffixAutomaton, spans
from .common import MOST_PARTS, U64, Words, gram_starts, grams, mix, pieces, tidied_group
from .exchange import ANSWER, MESSAGE, Counted, Summed, deal, messages, ordered, totals

GROUP_BYTES, BUCKET_BYTES, SHARD_BYTES = 4 << 20, 32 << 20, 4 << 20
HOT = 256
_PLACE = U64((1 << 28) - 1)  # words of a group are numbered in 28 bits


class Anchored:
    """The windows of some texts by anchor: stretch i holds the windows that start at words begin[i] to last[i] of one
    document and share the anchor ``key[i]``."""

    def __init__(self, column, width: int):
        self.width, self.words = width, Words(column)
        w, size = self.words, max(1, width // 3)
        self.hashes = w.hashes()
        self.begin = self.last = np.zeros(0, np.int64)
        self.key = np.zeros(0, U64)
        if len(w) < width:
            return
        start = np.flatnonzero(gram_starts(w.first, width)[: len(w) - width + 1])
        if not len(start):
            return
        gram = grams(self.hashes, size)
        least = gram & ~_PLACE | np.arange(len(gram), dtype=U64)
        reach, many = 1, width - size + 1
        while reach < many:  # the smallest of ``reach`` neighbours, doubled until it covers a window
            step = min(reach, many - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        at = (least[start] & _PLACE).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)]))
        self.begin, self.last = start[new], start[np.append(new[1:], len(start)) - 1]
        self.key = mix(gram[at[new]] ^ U64(0x2545F4914F6CDD1D))

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, key) of every window of the stretches ``which``."""
        n = self.last[which] - self.begin[which] + 1
        start = np.repeat(self.begin[which] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return start, mix(grams(self.hashes, self.width)[start]) if len(start) else np.zeros(0, U64)


def repeated_spans(texts: list[bytes], times: list[int], width: int) -> list[list[tuple[int, int]]]:
    """For every distinct stretch of words, which occurs ``times`` times: the maximal spans of words covered by windows that
    occur at least twice among all of them."""
    number: dict[bytes, int] = defaultdict(lambda: len(number))
    sequences = [[number[w] for w in x.split(b" ")] for x in texts]
    automaton = SuffixAutomaton()
    for x, n in zip(sequences, times, strict=True):
        automaton.add(x, n)
    automaton.finish()
    return [spans(automaton.shared(x), width) for x in sequences]


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, carry: list[str] | None = None, digest: bool = False, untouched: bool = False
) -> DataFrame:
    """(row, n_words, n_removed, kept): the carried columns of each document in a struct, and its kept words
    joined by one space, or with ``digest`` the SHA-256 of that; with ``untouched``, texts that lose nothing as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    dealt = deal(docs, id_col, text_col, row, GROUP_BYTES, BUCKET_BYTES)
    rows, buckets = dealt.rows, dealt.buckets
    shards = pieces(dealt.size, SHARD_BYTES)

    def counted(keys: np.ndarray) -> tuple[Counted, np.ndarray]:
        """Distinct keys with their counts, and which of them each key is."""
        distinct, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        return Counted(distinct, times, buckets), back

    def over_all(keys: np.ndarray, answers: pa.Table, turn: int) -> np.ndarray:
        """How often each key occurs in all documents, by the answers of a turn."""
        one, back = counted(keys)
        mine = answers.filter(pc.equal(answers.column("turn"), turn))
        return totals([one], zip(mine.column("bucket").to_pylist(), mine.column("totals").to_pylist(), strict=True))[0][back]

    def send_anchors(table: pa.Table) -> pa.Table:
        found = Anchored(ordered(table).column("text"), width)
        return messages([counted(found.key)[0]], table.column("g")[0].as_py(), 1)

    def answer(table: pa.Table) -> pa.Table:
        return Summed(table, [False]).answers(table)

    def exchanged(sent: DataFrame, turn: int) -> DataFrame:
        return dealt.by_bucket(sent).groupBy("bucket").applyInArrow(tidied_group(answer), ANSWER).withColumn("turn", F.lit(turn))

    def send_hot(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return messages([], 0, 1)
        found = Anchored(ordered(table).column("text"), width)
        _, keys = found.windows(np.flatnonzero(over_all(found.key, answers, 1) > HOT))
        return messages([counted(keys)[0]], table.column("g")[0].as_py(), 1)

    anchors = exchanged(rows.groupBy("g").applyInArrow(tidied_group(send_anchors), MESSAGE), 1)
    hot = exchanged(dealt.by_group(anchors).applyInArrow(tidied_group(send_hot), MESSAGE), 2)

    names = ["shard", "g", "anchor", "words", "doc", "start"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def gather(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        table = ordered(table)
        found = Anchored(table.column("text"), width)
        times = over_all(found.key, answers, 1)
        some = np.flatnonzero((times > 1) & (times <= HOT))
        start, key = found.windows(np.flatnonzero(times > HOT))
        again = np.flatnonzero(over_all(key, answers, 2) > 1)
        begin = np.concatenate([found.begin[some], start[again]])
        end = np.concatenate([found.last[some], start[again]]) + width
        key = np.concatenate([found.key[some], key[again]])
        first = found.words.first
        doc = np.searchsorted(first, begin, "right") - 1
        order = np.argsort(doc, kind="stable")
        text, held, words = table.column("text").to_pylist(), -1, []
        places: dict[tuple[int, bytes], tuple[list, list]] = {}
        for d, a, b, k in zip(doc[order].tolist(), (begin - first[doc])[order].tolist(), (end - first[doc])[order].tolist(), key[order].tolist(), strict=True):
            if d != held:
                held, words = d, text[d].encode().split()
            at = places.setdefault((k, b" ".join(words[a:b])), ([], []))
            at[0].append(d)
            at[1].append(a)
        keys = np.array([k for k, _ in places], U64)
        shard = ((keys >> U64(32)) % U64(shards)).astype(np.int32)
        g = table.column("g")[0].as_py()
        cols = [shard, [g] * len(places), keys.view(np.int64), [x for _, x in places], [p[0] for p in places.values()], [p[1] for p in places.values()]]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    gathered = dealt.by_group(anchors.unionByName(hot)).applyInArrow(tidied_group(gather), "shard int, g int, anchor long, words binary, doc array<int>, start array<int>")

    def judge(table: pa.Table) -> pa.Table:
        anchor, g, text, doc, start = (table.column(c).to_pylist() for c in ("anchor", "g", "words", "doc", "start"))
        number: dict[int, dict[bytes, int]] = defaultdict(lambda: defaultdict(int))
        for k, x, d in zip(anchor, text, doc, strict=True):
            number[k][x] += len(d)
        cuts = {k: dict(zip(of, repeated_spans(list(of), list(of.values()), width), strict=True)) for k, of in number.items()}
        out: tuple[list, list, list, list] = ([], [], [], [])
        for k, gg, x, ds, ss in zip(anchor, g, text, doc, start, strict=True):
            cut = cuts[k][x]
            if cut:
                out[0].append(gg)
                out[1].append([d for d in ds for _ in cut])
                out[2].append([s + a for s in ss for a, _ in cut])
                out[3].append([s + b for s in ss for _, b in cut])
        lists = pa.list_(pa.int32())
        return pa.table([pa.array(out[0], pa.int32()), *(pa.array(c, lists) for c in out[1:])], names=["g", "doc", "begin", "end"])

    judged = gathered.repartitionById(min(shards, MOST_PARTS), "shard").groupBy("shard").applyInArrow(tidied_group(judge), "g int, doc array<int>, begin array<int>, end array<int>")

    schema = T.StructType([rows.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def finish(table: pa.Table, cuts: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t.type) for t in (table.schema.field("row"),)] + [pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string())], names=schema.names)
        table = ordered(table)
        gone: dict[int, list] = defaultdict(list)
        for d, a, b in zip(*(cuts.column(c).to_pylist() for c in ("doc", "begin", "end")), strict=True):
            for k, x, y in zip(d, a, b, strict=True):
                gone[k].append((x, y))
        n_words, n_removed, kept = [], [], []
        for k, t in enumerate(table.column("text").to_pylist()):
            words = t.encode().split()
            n = len(words)
            if k in gone:
                left, at = [], 0
                for a, b in sorted(gone[k]):
                    if a > at:
                        left += words[at:a]
                    at = max(at, b)
                words = left + words[at:]
            n_words.append(n)
            n_removed.append(n - len(words))
            if untouched and n == len(words):
                kept.append(t)
                continue
            x = b" ".join(words)
            kept.append(hashlib.sha256(x).hexdigest() if digest else x.decode())
        row = table.column("row").combine_chunks()
        return pa.table([row, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=schema.names)

    return dealt.by_group(judged).applyInArrow(tidied_group(finish), schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 35, chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated spans taken out of the text, other columns as they were; a column of text lengths follows the text."""
    others = [c for c in docs.columns if c != text_col]
    out = remove_repeats(docs, id_col, text_col, width, carry=others, untouched=True)
    fresh = {text_col: F.col("kept"), chars_col: F.char_length("kept").cast(docs.schema[chars_col].dataType) if chars_col in docs.columns else None}
    return out.select(*[fresh.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
