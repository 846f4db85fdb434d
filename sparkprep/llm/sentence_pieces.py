"""SentencePiece encoding and decoding by a weighted finite-state transducer.

The model compiles into arcs over the characters of a text: the normaliser's
(one space before the text; the piece mark stands for a space), one per piece,
and byte-fallback arcs for characters that no piece spells. Composing them with
a text gives a lattice with a node per character boundary; the shortest path in
the tropical semiring is the encoding.

Weights follow the model's kind. A unigram model's arcs weigh minus the piece's
score. A BPE model orders merges, which sums of scores don't express; there an
arc weighs 0 if merging the arc before it and the arc itself afresh gives just
these two pieces, else it is cut (infinite weight). Merging has that property
locally, so exactly one path of finite weight leads to each node and it is the
model's own encoding.

Where no arc crosses (before a space and around a line end: the compiler checks
the pieces for that), the lattice falls apart into segments; these repeat, and a
task keeps the paths of those it has seen lately, in a table of bounded size.

Defined results: a null text has no pieces and decodes to null; an empty text
has no pieces and decodes to the empty text; decode(encode(text)) == text for
every other text, whatever its characters; repeated rows each give a row; an
empty table gives an empty result; further columns are kept, but for those of the
result's own names, which it replaces.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import wordhash as wh
from .common import arrow_map

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# segments, and pairs of pieces, whose results a task keeps
KEPT_SEGMENTS = 400_000
KEPT_PAIRS = 250_000
KEPT_LENGTH = 48
UNKNOWN_PENALTY = 10.0


class Kept(dict):
    """A table that fills itself. When it is full it starts anew, and what is
    asked for again comes from the last full one: at most twice ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.last = make, limit, {}

    def __missing__(self, key):
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.last = dict(self)
            self.clear()
        self[key] = value
        return value

    def rest(self) -> None:
        """Let the last full table go: workers outlive their tasks."""
        self.last = {}


class Transducer:
    """A compiled model: ``encode(text)`` gives ids as int32 bytes, ``decode(ids)`` the text."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto.FromString(proto)
        norm, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models whose normaliser keeps every character can be decoded exactly")
        self.prefix = " " if norm.add_dummy_prefix else ""
        self.is_bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids = [-1] * 256
        self.spelled: list[bytes] = []
        for i, p in enumerate(model.pieces):
            text = b""
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                text = bytes([int(p.piece[3:5], 16)])
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                piece = p.piece.replace(MARK, " ")
                text = piece.encode()
                self.ids[piece], self.score[piece] = i, p.score
            self.spelled.append(text)
        if -1 in self.byte_ids:
            raise ValueError("the model has no byte fallback")
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}  # the longest piece by its first three characters
        for p in self.ids:
            self.reach[p[:3]] = max(len(p), self.reach.get(p[:3], 0))
        self.segments = self._cutter()
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        self.pairs = Kept(self._stays, KEPT_PAIRS)
        self.paths = Kept(self._path, KEPT_SEGMENTS)

    def _cutter(self):
        """Cuts a text where no arc crosses: before a space behind something else,
        and around a line end."""
        pairs = {(a, b) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        if any(b == " " != a for a, b in pairs) or any("\n" in x for x in pairs):
            return lambda text: [text]
        return re.compile(" +[^ \n]*|[^ \n]+|\n").findall

    def _merged(self, text: str) -> list[str]:
        """``text`` after all merges, the best-scored and then leftmost pair first."""
        parts, score = list(text), self.score
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at: at + 2] = [parts[at] + parts[at + 1]]

    def _stays(self, pair: tuple[str, str]) -> bool:
        return self._merged(pair[0] + pair[1]) == [p for p in pair if p]

    def _spell(self, arcs: list[str]) -> bytes:
        try:
            return array("i", map(self.ids.__getitem__, arcs)).tobytes()
        except KeyError:
            out = array("i")
        for a in arcs:
            i = self.ids.get(a)
            if i is None:
                out.extend(self.byte_ids[b] for b in a.encode())
            else:
                out.append(i)
        return out.tobytes()

    def _path(self, segment: str) -> bytes:
        """Ids on the shortest path of a segment's lattice."""
        return self._spell(self._ordered(segment) if self.is_bpe else self._lightest(segment))

    def _ordered(self, s: str) -> list[str]:
        """The path of weight 0: longest arcs first, never twice from a node
        (paths of finite weight enter a node by one arc only, so a node from
        which the end can't be reached stays closed)."""
        ids, pairs, reach, n = self.ids, self.pairs, self.reach, len(s)
        arcs: list[str] = []
        closed: set[int] = set()
        at, before, to = 0, "", min(n, reach.get(s[:3], 2))
        while at < n:
            while to > at:
                arc = s[at:to]
                if (arc in ids or to == at + 1) and to not in closed and pairs[before, arc]:
                    break
                to -= 1
            if to > at:
                arcs.append(arc)
                at, before = to, arc
                to = min(n, at + reach.get(s[at:at + 3], 2))
            else:
                closed.add(at)
                to = at - 1
                at -= len(arcs.pop())
                before = arcs[-1] if arcs else ""
        return arcs

    def _lightest(self, s: str) -> list[str]:
        best, last = [0.0], [""]
        for i in range(1, len(s) + 1):
            weight, arc = min((best[j] - self.score[a], -len(a), a) if (a := s[j:i]) in self.ids else (best[j] - self.unknown, -1, a)
                              for j in range(max(0, i - self.longest), i) if s[j:i] in self.ids or j == i - 1)[::2]
            best.append(weight)
            last.append(arc)
        arcs, i = [], len(s)
        while i:
            arcs.append(last[i])
            i -= len(last[i])
        return arcs[::-1]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        paths = self.paths
        return b"".join([paths[s] if len(s) <= KEPT_LENGTH else self._path(s) for s in self.segments(self.prefix + text)])

    def decode(self, ids) -> str:
        spelled = self.spelled
        text = b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_COMPILED: dict[bytes, Transducer] = {}


def compiled(proto: bytes) -> Transducer:
    """One compiled model per Python worker."""
    if proto not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[proto] = Transducer(proto)
    return _COMPILED[proto]


def read_model(path: str = MODEL_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoded(df: DataFrame, model: bytes, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """``df`` (or its column ``id_col`` alone) with ``piece_ids`` array<int>,
    ``n_pieces`` and ``round_trip`` (decoding the ids gives the text)."""
    keep = [c for c in (df.columns if id_col is None else [id_col]) if c not in ("piece_ids", "n_pieces", "round_trip")]
    proto = df.sparkSession.sparkContext.broadcast(model)  # the model file, half a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wfst = compiled(proto.value)
        for whole in batches:
            for batch in wh.slices(whole, text_col):
                parts, same = [], []
                for text in batch.column(text_col).to_pylist():
                    ids = wfst.encode(text or "")
                    parts.append(ids)
                    same.append(wfst.decode(np.frombuffer(ids, np.int32).tolist()) == (text or ""))
                sizes = np.array([len(p) // 4 for p in parts], np.int64)
                flat = pa.array(np.frombuffer(b"".join(parts), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array(sizes), pa.array(same, pa.bool_())],
                                                 names=[*keep, "piece_ids", "n_pieces", "round_trip"])
        wfst.paths.rest()
        wfst.pairs.rest()

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return arrow_map(df.select(*dict.fromkeys([*keep, text_col])), run, schema)
