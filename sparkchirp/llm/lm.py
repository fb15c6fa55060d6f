"""Language-model scores from a weighted backoff automaton over all training text.

States are the contexts seen in training: the empty one, the begin of a text, and the last one or two (``order`` - 1)
tokens.  A state has an arc for each token that followed it in training, which leads to the longest context that
ends with that token, and a failure arc to its shorter context for all other tokens.  With c the training counts,
arcs and failure arcs weigh the log10 of

    P(w | h) = (c(h w) + K * P(w | shorter h)) / (c(h) + K)    and    K / (c(h) + K),

a hierarchical Dirichlet model; the empty context has P(w) = (c(w) + 1) / (N + V + 1), also for one word never
seen.  In every state the weights of all V words and the unseen one add up to 1.  K is estimated for each order
from the numbers n1, n2 of n-grams seen once and twice, so that a context seen once keeps about the share that an
absolute discount of n1 / (n1 + 2 n2) leaves: K = (n1 + 1) / (2 n2 + 1).  A text is read from left to right once;
the state is carried from token to token, and the weights passed are its score.

The automaton grows with the corpus, so no process holds all of it: documents are dealt into groups, each group
asks the buckets of the key space for the counts of its own n-grams over all training text, builds the states and
arcs that its documents can reach and runs them through.  N-grams of every order are counted by 64-bit keys: all
figures are exact while no two n-grams of an order share one (of a billion n-grams, one pair with a chance of 1 in 37).

Defined cases: null or empty text is the end token alone; a null ``train`` counts as false; rows that repeat are
learned and scored each; texts of any length are read whole; an empty table gives an empty result; with no training
rows N and V are 0 and the automaton has the empty context alone; carried columns may have any names.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, Words, mix, tidied_group
from .exchange import ANSWER, MESSAGE, Counted, Summed, deal, messages, ordered, totals, unzipped

GROUP_BYTES, BUCKET_BYTES = 8 << 20, 8 << 20
END, BEGIN = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)
_ROUND = U64(0x9E3779B97F4A7C15)


class Grams:
    """The n-grams of some texts: words and an end token each, a begin mark before the first.

    ``keys[m]`` are the distinct keys of order m + 1 and ``at[m]`` numbers, for every token, the n-gram that ends
    there (-1 where it would reach over the begin mark); they are numbered as they first appear.  The begin mark has a
    key of order 1, the last one.
    """

    def __init__(self, column, order: int):
        w = Words(column)
        n = np.diff(w.first) + 1
        self.first = np.concatenate([[0], np.cumsum(n)])
        token = np.full(int(self.first[-1]), END, U64)
        inside = np.ones(len(token), np.bool_)
        inside[self.first[1:] - 1] = False
        token[inside] = w.hashes(lower=True)
        self.place = np.arange(len(token)) - np.repeat(self.first[:-1], n)
        self.keys, self.at, self.seen = [], [], []
        run = token
        for m in range(order):
            if m:
                back = np.full(len(token), BEGIN, U64)
                far = np.flatnonzero(self.place >= m)
                back[far] = token[far - m]
                run = mix(run + _ROUND * back)
            here = np.flatnonzero(self.place >= m - 1)
            keys, seen, number = np.unique(run[here], return_index=True, return_inverse=True)
            order = np.argsort(seen)
            turn = np.empty_like(order)
            turn[order] = np.arange(len(order))
            at = np.full(len(token), -1, np.int32)
            at[here] = turn[number]
            self.keys.append(keys[order])
            self.at.append(at)
            self.seen.append(here[seen[order]])  # where each n-gram ends first
        self.keys[0] = np.append(self.keys[0], BEGIN)
        self.end = int(self.at[0][self.first[1] - 1]) if len(token) else -1

    def counts(self) -> list[np.ndarray]:
        """How often each n-gram occurs; the begin mark once a text."""
        out = [np.bincount(a[a >= 0], minlength=len(k)) for a, k in zip(self.at, self.keys, strict=True)]
        out[0][-1] = len(self.first) - 1
        return out


def concentration(once: int, twice: int) -> float:
    """K of an order by its numbers of n-grams seen once and twice."""
    return (once + 1) / (2 * twice + 1)


class BackoffAutomaton:
    """Numbered states and arcs for all that the texts of ``grams`` can reach.

    State 0 is the empty context.  ``first_arc`` is the arc of each state that its text takes first (-1: none), for the
    token ``first``; ``arcs`` maps state * tokens + token to its other arcs.  ``weight`` and ``target`` are those of
    arcs, ``fail_weight`` and ``fail`` those of the states' failure arcs; a token without an arc in state 0 costs
    ``unseen`` and stays there.  ``start`` is the state of the begin mark.
    """

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, types: int, strength: list[float]):
        self.tokens = len(grams.keys[0])
        self.unseen = -math.log10(tokens + types + 1)
        base = (counts[0] + 1.0) / (tokens + types + 1.0)
        self.base = np.log10(base)
        i4 = np.int32  # states, tokens and arcs of a group are counted in 32 bits
        fail, fail_weight, size = [np.zeros(1, i4)], [np.zeros(1)], 1
        begin = self.tokens - 1
        # the state of every n-gram that is a context: seen in training, not the end of a text, shorter than the order
        state = []
        for m, c in enumerate(counts[:-1]):
            last = grams.at[0][grams.seen[m]] if m else np.arange(self.tokens)
            context = (c > 0) & (last != grams.end)
            number = np.full(len(c), -1, i4)
            number[context] = size + np.arange(int(context.sum()))
            state.append(number)
            size += int(context.sum())
            shorter = np.zeros(len(c), i4) if m == 0 else state[m - 1][grams.at[m - 1][grams.seen[m]]]
            fail.append(shorter[context])
            fail_weight.append(np.log10(strength[m] / (c[context] + strength[m])))
        source, token, weight, target = [], [], [], []
        p = base
        for m, c in enumerate(counts):
            ends = grams.seen[m] if m else None
            last = grams.at[0][ends] if m else np.arange(self.tokens, dtype=i4)
            if m == 0:
                origin = np.zeros(len(c), i4)
                arc = (c > 0) & (last != begin)
            else:
                # the context before the last token: an n-gram one place earlier, or the begin mark
                held = np.where(grams.place[ends] == 0, begin, grams.at[m - 1][ends - 1])
                origin = state[m - 1][held]
                k = strength[m - 1]
                known = counts[m - 1][held]
                lower = p[grams.at[m - 1][ends]]
                p = np.where(known > 0, (c + k * lower) / (known + k), lower)
                arc = (c > 0) & (origin >= 0)
                del held, known, lower
            if m < len(state):
                to = state[m][arc]
            else:
                to = state[m - 1][grams.at[m - 1][ends]][arc] if m else np.zeros(int(arc.sum()), i4)
            source.append(origin[arc])
            token.append(last[arc])
            weight.append(np.log10(p[arc]))
            target.append(np.maximum(to, 0))
        del p, origin, arc, to, last, state[1:]
        source, token = np.concatenate(source), np.concatenate(token)
        number = np.arange(len(source), dtype=i4)
        first_arc = np.full(size, -1, i4)
        first_arc[source[::-1]] = number[::-1]
        other = np.flatnonzero(first_arc[source] != number)
        self.first_arc = array("i", first_arc.tobytes())
        self.first = array("i", np.where(first_arc < 0, -1, token[first_arc] if len(token) else -1).astype(i4).tobytes())
        self.arcs = {}
        for i in range(0, len(other), 1 << 16):  # lists of numbers take several times the room of arrays
            some = other[i : i + (1 << 16)]
            self.arcs.update(zip((source[some] * np.int64(self.tokens) + token[some]).tolist(), some.tolist(), strict=True))
        del source, token, other, first_arc, number
        self.weight, self.target = array("d", np.concatenate(weight).tobytes()), array("i", np.concatenate(target).tobytes())
        self.fail, self.fail_weight = array("i", np.concatenate(fail).tobytes()), array("d", np.concatenate(fail_weight).tobytes())
        self.start = max(0, int(state[0][begin])) if state else 0

    def score(self, text: list[int]) -> float:
        """log10 of the probability of one text (its token numbers, the end last): one pass that carries the state."""
        arcs, weight, target, tokens = self.arcs.get, self.weight, self.target, self.tokens
        first, first_arc, fail, fail_weight = self.first, self.first_arc, self.fail, self.fail_weight
        total, state = 0.0, self.start
        for x in text:
            while True:
                arc = first_arc[state] if first[state] == x else arcs(state * tokens + x)
                if arc is not None:
                    total += weight[arc]
                    state = target[arc]
                    break
                if not state:
                    total += self.unseen
                    break
                total += fail_weight[state]
                state = fail[state]
        return total


def left_out(grams: Grams, counts: list[np.ndarray], tokens: int, types: int, strength: list[float]) -> np.ndarray:
    """Scores of training texts by the model without the counts of the text itself."""
    begin, lengths = grams.first[:-1], np.diff(grams.first)
    text = np.repeat(np.arange(len(lengths)), lengths)
    p = before = None
    for m, (c, at) in enumerate(zip(counts, grams.at, strict=True)):
        here = np.flatnonzero(at >= 0)
        pair, number, own = np.unique(text[here] * len(c) + at[here], return_inverse=True, return_counts=True)
        rest = c[pair % len(c)] - own  # of each n-gram of each text
        left = np.zeros(len(at), np.int64)
        left[here] = rest[number]
        if m == 0:
            words = types - np.bincount(pair[rest == 0] // len(c), minlength=len(lengths))
            p = (left + 1.0) / np.repeat(tokens - lengths + words + 1.0, lengths)
        else:
            context = np.append(0, before[:-1])  # what is left of the n-gram that ends one token earlier
            if m == 1:
                context[begin] = counts[0][-1] - 1
            known = (at >= 0) & (context > 0)
            p = np.where(known, (left + strength[m - 1] * p) / (context + strength[m - 1]), p)
        before = left
    return np.add.reduceat(np.log10(p), begin)


def score_texts(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, carry: list[str] | None = None) -> DataFrame:
    """(row, train, n_tokens, n_known, train_tokens, base_score, score, left_out_score, left_out_mean) of every document.

    ``train`` says of each row whether the model learns from it; ``row`` is the struct of the carried columns.
    """
    if not 1 <= order <= 3:
        raise ValueError("order: 1 to 3")
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)])
    train = F.coalesce(train, F.lit(False))
    dealt = deal(docs, id_col, text_col, row, GROUP_BYTES, BUCKET_BYTES, apart=~train, zip_texts=True, train=train)
    rows, buckets = dealt.rows, dealt.buckets
    whole = [True] * order

    def asked(table: pa.Table) -> tuple[Grams, list[Counted], int]:
        """The n-grams of a group, what it sends of them, and 1 where the model learns from it, else 0."""
        grams, learn = Grams(table.column("text"), order), int(table.column("train")[0].as_py())
        return grams, [Counted(k, c * learn, buckets, w) for k, c, w in zip(grams.keys, grams.counts(), whole, strict=True)], learn

    def send(table: pa.Table) -> pa.Table:
        _, sets, learn = asked(unzipped(ordered(table)))
        return messages(sets, table.column("g")[0].as_py(), learn)

    sent = dealt.by_bucket(rows.groupBy("g").applyInArrow(tidied_group(send), MESSAGE))
    groups = dealt.groups

    def answer(table: pa.Table) -> pa.Table:
        """The answers to the groups, and in a row of its own what the bucket adds to the figures of the corpus."""
        got = Summed(table, whole)
        words = got.sums[0][got.keys[0] != BEGIN]
        figures = [words.sum(), (words > 0).sum()]
        for sums in got.sums[1:]:
            figures += [(sums == 1).sum(), (sums == 2).sum()]
        bucket = table.column("bucket")[0].as_py()
        own = pa.table([pa.array([bucket % groups], pa.int32()), pa.array([bucket], pa.int32()), pa.array([[int(x) for x in figures]], pa.list_(pa.int64()))], names=["g", "bucket", "figures"])
        return pa.concat_tables([got.answers(table), own], promote_options="default")

    answers = dealt.to_groups(sent.groupBy("bucket").applyInArrow(tidied_group(answer), f"{ANSWER}, figures array<bigint>"))

    def add_up(batches):
        """The figures of a task's rows.  It takes the answers as they are, so that they are computed and sent once."""
        total = np.zeros(2 * order, np.int64)
        for batch in batches:
            own = batch.column("figures").drop_null()
            total += np.asarray(own.flatten()).reshape(len(own), 2 * order).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total.tolist()], names=[f"f{i}" for i in range(2 * order)])

    sums = answers.mapInArrow(add_up, ", ".join(f"f{i} long" for i in range(2 * order)))
    sums = sums.agg(F.array(*[F.coalesce(F.sum(f"f{i}"), F.lit(0)) for i in range(2 * order)]).alias("corpus"))
    rows = rows.crossJoin(F.broadcast(sums))  # one row: the figures reach each group with its documents
    more = [("train", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType())]
    more += [(x, T.DoubleType()) for x in ("score", "left_out_score", "left_out_mean")]
    schema = T.StructType([rows.schema["row"], *[T.StructField(n, t) for n, t in more]])

    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            kinds = [table.schema.field("row").type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 4]
            return pa.table([pa.array([], k) for k in kinds], names=schema.names)
        table = unzipped(ordered(table))
        grams, sets, learn = asked(table)
        grams.keys = [k[:0] if m else k for m, k in enumerate(grams.keys)]  # the sets hold the others
        tokens, types, *seen = table.column("corpus")[0].as_py()
        replies = zip(replies.column("bucket").to_pylist(), replies.column("totals").to_pylist(), strict=True)
        counts = totals(sets, ((b, x) for b, x in replies if x is not None))
        del sets, replies
        strength = [concentration(*seen[i : i + 2]) for i in range(0, len(seen), 2)]
        automaton = BackoffAutomaton(grams, counts, tokens, types, strength)
        begin, word = grams.first[:-1], grams.at[0]
        scores = np.array([automaton.score(word[a:b].tolist()) for a, b in zip(begin.tolist(), grams.first[1:].tolist(), strict=True)])
        base = automaton.base
        del automaton
        fresh = left_out(grams, counts, tokens, types, strength) if learn else scores
        return pa.table(
            [
                table.column("row").combine_chunks(),
                table.column("train").combine_chunks(),
                pa.array(np.diff(grams.first)),
                pa.array(np.add.reduceat((counts[0] > 0)[word].astype(np.int64), begin)),
                pa.array(np.full(len(begin), tokens)),
                pa.array(np.add.reduceat(base[word], begin)),
                pa.array(scores),
                pa.array(fresh),
                pa.array(fresh / np.diff(grams.first)),
            ],
            names=schema.names,
        )

    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(tidied_group(run), schema)
