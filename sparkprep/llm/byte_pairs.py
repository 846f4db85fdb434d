"""Byte-level BPE encoding and decoding by a segment tree over adjacent pair ranks.

A text falls apart at its special tokens and then, by the tokenizer's pattern,
into words; merges never cross a word. Of a word, the leaves of a segment tree
hold the rank of each adjacent pair with its position (infinite where no merge is
known); a node holds the least of its 16 children. The root is thus the leftmost pair of the
lowest rank. Merging it changes at most three leaves, point updates of logarithmic cost; the word is done
when the root is infinite. A word of n bytes costs n log n, however repetitive.
Words repeat, so a task keeps the ids of those it has met, in a table of bounded size.

Defined results: a null text and an empty text have no tokens and decode to the
empty text; decode(encode(text)) == text for every text, whatever its characters;
the string of a special token in a text is that token; repeated rows each give
a row; an empty table gives an empty result; further columns are kept, but for
those of the result's own names, which it replaces.
"""

from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import wordhash as wh
from .common import arrow_map
from .sentence_pieces import Kept

MODEL_NAME = "byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# words whose ids a task keeps, and how long a word may be to be kept
KEPT_WORDS = 300_000
KEPT_LENGTH = 48
# texts over so many characters are cut into words a block at a time
LONG_TEXT = 1 << 20
WORD_BLOCK = 1 << 16
OUTPUTS = ("token_ids", "n_tokens", "decoded")

# Code points that the regex module takes for letters or numbers while the
# tokenizer's tables (Unicode 16) leave them without a class.
UNCLASSED = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
_UNCLASSED = regex.compile(f"[{UNCLASSED}]")
_NO_CLASS = "\u0378"  # assigned in no version

NEVER = 1 << 62
FEW = 1000  # symbols up to which plain lists serve
FAN = 16  # children of a node of the segment tree


def _is_latin(text: str) -> bool:
    """Whether all characters are below U+0100: a fast test that spares most texts a search."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairMerger:
    """A compiled vocabulary: ``encode(text)`` gives ids as int32 bytes, ``decode(ids)`` the text."""

    def __init__(self, spec: str):
        conf = json.loads(spec)
        model, pre = conf["model"], conf["pre_tokenizer"] or {}
        if (model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
                or conf.get("normalizer") or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))):
            raise ValueError("only plain byte-level BPE vocabularies are supported")
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        shown = byte_characters()
        self.first = [self.ids[c] for c in shown]
        special = {t["content"]: t["id"] for t in conf.get("added_tokens", [])}
        if any(t.get(k) for t in conf.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only special tokens matched as they are written are supported")
        byte_of = {c: b for b, c in enumerate(shown)}
        self.spelled = [b""] * (1 + max([*self.ids.values(), *special.values()]))
        for token, i in [*self.ids.items(), *special.items()]:
            self.spelled[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.special = {t: array("i", [i]).tobytes() for t, i in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.words = regex.compile(PATTERN)
        self.kept = Kept(self._encode_word, KEPT_WORDS)

    def merged(self, symbols: list[int]) -> list[int]:
        """``symbols`` after all merges, the lowest-ranked and then leftmost pair first."""
        n, known, made = len(symbols), self.rank.get, self.made
        if n < 2:
            return symbols
        shift = n.bit_length()
        place = (1 << shift) - 1
        # a leaf holds its pair's rank and, in the low bits, its own place; a node the least of its FAN children
        tree = [[NEVER if r is None else r << shift | i for i, r in enumerate(map(known, itertools.pairwise(symbols)))]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        if n >= FEW:  # compact: words may be as long as a text
            tree, after, before = [array("q", tree[0])], array("i", after), array("i", before)
        while len(below := tree[-1]) > FAN:
            tree.append([min(below[k:k + FAN]) for k in range(0, len(below), FAN)])
        leaves, top, last = tree[0], tree[-1], n - 1
        while (best := min(top)) != NEVER:
            i = best & place
            j = after[i]
            symbols[i] = s = made[best >> shift]
            symbols[j] = -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                r = known((s, symbols[k]))
                leaves[i] = NEVER if r is None else r << shift | i
            else:
                leaves[i] = NEVER
            if j < last:  # the last symbol has no leaf
                leaves[j] = NEVER
            if h >= 0:
                r = known((symbols[h], s))
                leaves[h] = NEVER if r is None else r << shift | h
            if top is not leaves:
                changed = {i, min(j, last - 1), max(h, 0)}
                for below, above in itertools.pairwise(tree):
                    changed = {c // FAN for c in changed}
                    for c in changed:
                        above[c] = min(below[c * FAN:c * FAN + FAN])
        return [s for s in symbols if s >= 0]

    def _encode_word(self, word: str) -> bytes:
        return array("i", self.merged(list(map(self.first.__getitem__, word.encode())))).tobytes()

    def _spelt(self, words: list[str]) -> bytes:
        kept = self.kept
        return b"".join([kept[w] if len(w) <= KEPT_LENGTH else self._encode_word(w) for w in words])

    def _encode_plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if not _is_latin(text) and _UNCLASSED.search(text):
            shape = _UNCLASSED.sub(_NO_CLASS, text)
            words = (text[m.start():m.end()] for m in self.words.finditer(shape))
        elif len(text) <= LONG_TEXT:
            return self._spelt(self.words.findall(text))
        else:
            words = (m.group() for m in self.words.finditer(text))
        out = []
        while block := list(itertools.islice(words, WORD_BLOCK)):
            out.append(self._spelt(block))
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.cut is None:
            return self._encode_plain(text)
        parts = self.cut.split(text)
        return b"".join([self.special[p] if i % 2 else self._encode_plain(p) for i, p in enumerate(parts)])

    def decode(self, ids) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")


_COMPILED: dict[str, PairMerger] = {}


def compiled(spec: str) -> PairMerger:
    """One compiled vocabulary per Python worker."""
    if spec not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[spec] = PairMerger(spec)
    return _COMPILED[spec]


def read_vocabulary(path: str | None = None) -> str:
    """The tokenizer file's JSON; by default the public byte-level vocabulary."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(MODEL_NAME)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(df: DataFrame, vocabulary: str, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """``df`` (or its column ``id_col`` alone) with ``token_ids`` array<int>,
    ``n_tokens`` and ``decoded``, the text that the ids decode to."""
    keep = [c for c in (df.columns if id_col is None else [id_col]) if c not in OUTPUTS]
    # positions instead of names: what the caller's columns are called doesn't matter
    rows = df.select(*(df[f"`{c.replace('`', '``')}`"].alias(f"k{i}") for i, c in enumerate(keep)),
                     df[f"`{text_col.replace('`', '``')}`"].cast("string").alias("text"))
    spec = df.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary file, a megabyte or two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = compiled(spec.value)
        for whole in batches:
            for batch in wh.slices(whole, "text"):
                parts, back = [], []
                for text in batch.column("text").to_pylist():
                    ids = merger.encode(text or "")
                    parts.append(ids)
                    back.append(merger.decode(np.frombuffer(ids, np.int32).tolist()))
                sizes = np.array([len(p) // 4 for p in parts], np.int64)
                flat = pa.array(np.frombuffer(b"".join(parts), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists, pa.array(sizes), pa.array(back, pa.string())],
                                                 names=[*batch.schema.names[:-1], *OUTPUTS])
        merger.kept.rest()

    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(OUTPUTS[0], T.ArrayType(T.IntegerType())),
                           T.StructField(OUTPUTS[1], T.LongType()), T.StructField(OUTPUTS[2], T.StringType())])
    return arrow_map(rows, run, schema).toDF(*keep, *OUTPUTS)


def ids_digest(ids: Column) -> Column:
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)
