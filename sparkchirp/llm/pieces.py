"""Exact encoding and decoding with merge-type SentencePiece models.

Encoding works by backtracking.  An Aho-Corasick automaton over the reversed vocabulary finds the longest
token that starts at each position; tokens are laid from left to right, and a token may follow another only
if re-merging the two gives just these two (checked by undoing their merges step by step).  Where no token
fits, the position is marked failed in a bitfield and the previous token is shortened, so each position
fails at most once.  The result equals that of merging the best-scored pair again and again.

A text is first cut before each run of the space mark and around characters outside the vocabulary: no
token reaches over these places, so the parts can be encoded one by one and remembered within a bound.

Defined cases: null text counts as empty and gives only begin and end ids; text of any length is encoded
whole; characters outside the vocabulary become byte tokens, or the unknown id where the model has none;
rows that repeat are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import ChunkMemo, small_batches, text_blocks, tidied

MARK = "▁"
_NONE = -1


class PieceModel:
    """Tables of a merge-type SentencePiece model; tokens are numbered by merge rank, single characters first."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.size = n
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if any(re.search(f"[^{MARK}]{MARK}", names[i]) for i in normal):
            raise ValueError("the vocabulary has tokens that reach over a space")
        single = [i for i in normal if len(names[i]) == 1]
        longer = sorted((i for i in normal if len(names[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        order = single + longer
        self.id_of = order
        self.text = [names[i] for i in order]
        self.rank = {t: k for k, t in enumerate(self.text)}
        self.chars = frozenset(self.text[: len(single)])
        self.length = [len(t) for t in self.text]
        self._tables(len(single))
        # for decoding: bytes of each id; control ids have none
        self.bytes_of = [b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else names[i].replace(MARK, " ").encode() for i in range(n)]
        for value, i in self.byte_id.items():
            self.bytes_of[i] = bytes([value])
        self.silent = frozenset(i for i in range(n) if sp.is_control(i))
        self.marked = frozenset(i for i in normal if names[i].startswith(MARK))
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall
        known = "".join(sorted(self.chars)).replace("\\", "\\\\").replace("]", "\\]").replace("^", "\\^").replace("-", "\\-")
        self.parts = re.compile(f"[{known}]+|[^{known}]").findall

    def _tables(self, n_single: int) -> None:
        """How each token was last merged, which tokens merging can reach, and each token's next shorter prefix."""
        rank, text = self.rank, self.text
        self.left, self.right = list(range(len(text))), list(range(len(text)))
        reachable = [True] * len(text)
        for k in range(n_single, len(text)):
            if not all(c in self.chars for c in text[k]):
                reachable[k] = False
                continue
            parts = self.merge(text[k], stop=k)
            if len(parts) == 2:
                self.left[k], self.right[k] = parts
            else:
                reachable[k] = False
        self.pair = {}
        for k in range(n_single, len(text)):
            t = text[k]
            for i in range(1, len(t)):
                a, b = rank.get(t[:i]), rank.get(t[i:])
                if a is not None and b is not None and reachable[a] and reachable[b]:
                    self.pair[a, b] = k
        self.shorter = []
        for t in text:
            self.shorter.append(next((rank[t[:i]] for i in range(len(t) - 1, 0, -1) if t[:i] in rank and reachable[rank[t[:i]]]), _NONE))
        self.finder = ahocorasick.Automaton()
        for k, t in enumerate(text):
            if reachable[k]:
                self.finder.add_word(t[::-1], k)
        self.finder.make_automaton()
        self.compatible = functools.lru_cache(1 << 18)(self._compatible)

    def merge(self, segment: str, stop: int | None = None) -> list[int]:
        """Ranks after merging the best pair again and again; ``stop`` ends before that token would be made of all."""
        rank = self.rank
        have = [rank[c] for c in segment]
        names = list(segment)
        while len(have) > 1:
            best, at = None, -1
            for i in range(len(have) - 1):
                r = rank.get(names[i] + names[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or (best == stop and len(have) == 2):
                break
            names[at : at + 2] = [names[at] + names[at + 1]]
            have[at : at + 2] = [best]
        return have

    def _compatible(self, a: int, b: int) -> bool:
        """Would merging leave ``a`` followed by ``b`` as they are?

        Undoes the later of the two merges; if the parts that then touch could merge before that merge was
        made, the boundary would not have survived.
        """
        limit = len(self.text)
        pair, left, right = self.pair, self.left, self.right
        while True:
            made = pair.get((a, b))
            if made is not None and made < limit:
                return False
            undo_a = a > b
            if undo_a and right[a] == a:
                undo_a = False
                if left[b] == b:
                    return True
            elif not undo_a and left[b] == b:
                undo_a = True
                if right[a] == a:
                    return True
            if undo_a:
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def segment(self, text: str) -> list[int]:
        """Ranks of a text of vocabulary characters, by backtracking."""
        whole = self.rank.get(text)
        n = len(text)
        longest = [_NONE] * n
        length, last = self.length, n - 1
        for end, k in self.finder.iter(text[::-1]):
            at = last - end
            if longest[at] == _NONE or length[k] > length[longest[at]]:
                longest[at] = k
        if whole is not None and longest[0] == whole:
            return [whole]
        failed = bytearray((n >> 3) + 1)  # bit p: position p has failed
        out: list[int] = []
        at, token = 0, longest[0]
        shorter, compatible = self.shorter, self.compatible
        while True:
            before = out[-1] if out else _NONE
            while token != _NONE:
                end = at + length[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (before == _NONE or compatible(before, token)):
                    break
                token = shorter[token]
            if token != _NONE:
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            else:
                if not out:
                    raise ValueError("no segmentation")
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()
                at -= length[token]

    def chunk_ids(self, chunk: str) -> list[int]:
        """Ids of one chunk of marked text."""
        ids: list[int] = []
        for part in self.parts(chunk):
            if part[0] in self.chars:
                ids.extend(map(self.id_of.__getitem__, self.segment(part)))
            elif self.byte_id:
                ids.extend(self.byte_id[x] for x in part.encode())
            else:
                ids.append(self.unk)
        return ids

    def split(self, text: str) -> list[str]:
        """The chunks of a raw text: spaces become marks, one more mark leads."""
        return self.cut(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str, ends: bool = True) -> list[int]:
        ids = [i for c in self.split(text) for i in self.chunk_ids(c)]
        return [self.bos, *ids, self.eos] if ends else ids

    def pack(self, chunks: list[str]) -> list[bytes]:
        return [np.array(self.chunk_ids(c), "<u4").tobytes() for c in chunks]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: marks become spaces, the leading mark goes, control ids have no text."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        if any(map(self.silent.__contains__, ids[1:-1])):
            return self._lenient(ids, first)  # a control id ends a run of bytes
        if first in self.marked:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._lenient(ids, first)

    def _lenient(self, ids: list[int], first: int | None) -> str:
        """As decode; each byte that is no part of a character becomes a replacement character."""
        value = {i: v for v, i in self.byte_id.items()}
        out, run = [], bytearray()

        def flush():
            p = 0
            while p < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[p : p + k]).decode())
                        p += k
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    p += 1
            run.clear()

        for i in ids:
            if i in value:
                run.append(value[i])
            else:
                flush()
                out.append(self.bytes_of[i].decode())
        flush()
        text = "".join(out)
        return text[1:] if first in self.marked else text


@functools.lru_cache(4)
def model(path: str) -> PieceModel:
    """The tables of a model file, built once a process."""
    return PieceModel(path)


@functools.lru_cache(4)
def _memo(path: str) -> ChunkMemo:
    m = model(path)
    return ChunkMemo(m.pack, "<u4")


def encode_column(path: str, texts: list[str]) -> list[bytes]:
    """Packed ids (little-endian unsigned 32-bit) of texts, with begin and end ids."""
    m = model(path)
    begin, end = (np.array([i], "<u4").tobytes() for i in (m.bos, m.eos))
    memo = _memo(path)
    cut, runs, fast = [], [], []
    for x in texts:
        fast.append(not x.startswith(" ") and "  " not in x and MARK not in x and "\x00" not in x)
        if fast[-1]:
            cut.append((MARK + x).replace(" ", "\x00" + MARK).replace("\n", "\x00\n\x00") if x else "")
        else:
            runs.append(m.split(x))
    done = iter(memo.packed_lists(runs)), iter(memo.packed(cut))
    return [begin + next(done[f]) + end for f in fast]


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """Encode and decode every text: (id, ids, decoded) with ``texts``, else (id, n_tokens, ids_sha256, decoded_sha256)."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType
    tail = (
        [T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())]
        if texts
        else [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    )
    schema = T.StructType([T.StructField("id", kind), *tail])

    def work(batches):
        m = model(path)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1).to_pylist()
            for a, b in text_blocks(text):
                packed = encode_column(path, text[a:b])
                decoded = [m.decode(np.frombuffer(x, "<u4").tolist()) for x in packed]
                if texts:
                    cols = [pa.array(packed, pa.binary()), pa.array(decoded, pa.string())]
                else:
                    cols = [
                        pa.array([len(x) // 4 for x in packed], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string()),
                    ]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *cols], names=[f.name for f in schema])

    return small_batches(rows).mapInArrow(tidied(work), schema)
