"""Toxicity by gradient-boosted trees over dense features, isotonically calibrated.

A text's features are lexicon densities (of a fixed list of insults and of words
and word beginnings learned from labelled rows), lexicon hits near a
second-person pronoun, capitals, punctuation and obfuscation rates. Trees and
calibration are fitted on a bounded sample of labelled rows
(``MAX_TRAINING_ROWS``, those of least md5 of the id; a fifth of them is left to
the calibration); every text is scored whole.

Defined results: a null or empty text has features of 0 and gets the score of
such texts; if the sample lacks a class, each score is the sample's share of
toxic rows (0 without rows); labels without an id or a value are ignored, a
repeated label counts once, as toxic if any says so; repeated rows get equal
scores; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import arrow_map, reliable

MAX_TRAINING_ROWS = 20_000
MAX_LEXICON = 4_000
LEAST_ROWS, LEAST_PRECISION = 4, 0.45  # of a learned entry: toxic rows with it; lower bound of their share
STEMS = (4, 5, 6)
WINDOW = 3  # words
SEED = 11

# Insults and second-person pronouns of the four languages.
INSULTS = frozenset("""
arschloch asqueroso basura bastard clown connard cretin dirtbag disgusting dreckig dumb dummkopf estupido estúpido fool
garbage idiot idiota idiote imbecile imbécile jerk loser moron nutzlos pathetic patético salaud scum sinvergüenza stupid stupide
trash trottel ugly useless vermin worthless
""".split())
SECOND_PERSON = frozenset("""
du dein deine deinen deiner dich dir euch ihr te ti ton tes toi tu tus tú usted ustedes vos votre vous you your yours yourself youre
""".split())

FEATURES = ("insults", "learned", "hits", "near_you", "capitals", "punctuation", "symbols", "obfuscated", "plain_again", "words")
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})


def _bytes(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


# full-width forms and the ASCII characters that they stand for
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


def letters_only(text: Column) -> Column:
    """A text whose only characters beyond ASCII are letters and their marks: full-width forms become
    ASCII, dashes, typographic quotes, spaces and the like become spaces."""
    return F.regexp_replace(F.translate(text, _WIDE, _NARROW), r"[^\p{L}\p{M}\x00-\x7F]", " ")


_LETTER = _bytes("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER[128:] = True
_PUNCTUATION, _SYMBOL = _bytes("!?"), _bytes("#*$%&|<>@^~")
_STRONG, _WEAK = _bytes("0123456789@$"), _bytes("!|*.-_")  # signs in a word; weak ones only between its other characters


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Lexicon:
    """Words and word beginnings, all of four letters or more."""
    words: frozenset = frozenset()
    stems: frozenset = frozenset()
    heads: np.ndarray = field(default=None)

    def __post_init__(self):
        entries = self.words | self.stems | INSULTS
        # the first four bytes of all entries, also with a capital of more than one byte
        heads = {x.encode()[:4] for w in entries for x in (w, w.capitalize()) if x[0] == w[0] or ord(x[0]) > 127}
        self.heads = np.unique(np.frombuffer(b"".join(heads), "<u4"))

    def learned(self, word: str) -> bool:
        return word in self.words or any(word[:n] in self.stems for n in STEMS)


def _candidates(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Numbers of the words that begin like an entry."""
    long = np.flatnonzero(ends - starts >= 4)
    s = starts[long]
    low = lambda d: _LOWER[data[s + d]].astype(np.uint32)
    first = low(0) | low(1) << np.uint32(8)
    likely = np.zeros(1 << 16, bool)
    likely[heads & 0xFFFF] = True
    keep = likely[first]
    long, s, first = long[keep], s[keep], first[keep]
    value = first | low(2) << np.uint32(16) | low(3) << np.uint32(24)
    return long[heads[np.minimum(np.searchsorted(heads, value), len(heads) - 1)] == value]


def _disguised(data: np.ndarray, letter: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Of runs of letters and signs those with both, without weak signs at their ends (one in front may
    stand for a letter: ``!diot``)."""
    core = np.flatnonzero(letter | _STRONG[data])
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    n_letters, n_signs = sums(letter), sums(_STRONG[data] | _WEAK[data])
    first, last = np.searchsorted(core, begin), np.searchsorted(core, end) - 1
    some = first <= last
    a, b = core[first[some]], core[last[some]] + 1
    lead = (a > begin[some]) & (data[np.maximum(a - 1, 0)] == ord("!"))
    a = a - lead
    both = (n_letters[b] > n_letters[a]) & (n_signs[b] > n_signs[a])
    return list(zip(a[both].tolist(), b[both].tolist(), strict=True))


def features(batch: pa.RecordBatch, lexicon: Lexicon, column: str = "text") -> np.ndarray:
    """A row of FEATURES per text (as ``letters_only`` gives it; a column ``capitals`` counts its
    capitals). Words are runs of letters (bytes of A-Z, a-z and of all other scripts); only those that
    begin like an entry of the lexicon, and words with signs in them, are looked at one by one."""
    data, offsets = wh.text_buffers(batch.column(column))

    def count(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask)])
        return (run[offsets[1:]] - run[offsets[:-1]]).astype(np.float64)

    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True

    def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, finishes = mask.copy(), mask.copy()
        begins[1:] &= ~mask[:-1] | edge[1:-1]
        finishes[:-1] &= ~mask[1:] | edge[1:-1]
        return np.flatnonzero(begins), np.flatnonzero(finishes) + 1

    letter = _LETTER[data]
    starts, ends = runs(letter)
    at = np.searchsorted(starts, offsets)
    word = lambda k: data[starts[k]: ends[k]].tobytes().decode("utf-8", "replace").lower()
    n_words = np.diff(at)
    upper = batch.column("capitals").to_numpy(zero_copy_only=False).astype(np.float64)
    letters = np.maximum(count(letter & ((data & 0xC0) != 0x80)), 1)  # characters, not bytes
    marks, symbols = count(_PUNCTUATION[data]), count(_SYMBOL[data])
    fixed, learned, near, disguised, again = (np.zeros(batch.num_rows) for _ in range(5))
    for k in _candidates(data, starts, ends, lexicon.heads).tolist():
        w = word(k)
        a, b = w in INSULTS, lexicon.learned(w)
        if a or b:
            r = int(np.searchsorted(at, k, "right")) - 1
            fixed[r] += a
            learned[r] += b
            around = range(max(int(at[r]), k - WINDOW), min(int(at[r + 1]), k + WINDOW + 1))
            near[r] += any(word(j) in SECOND_PERSON for j in around)
    for a, b in _disguised(data, letter, *runs(letter | _STRONG[data] | _WEAK[data])):
        w = data[a:b].tobytes().decode("utf-8", "replace").lower().translate(_PLAIN)
        r = int(np.searchsorted(offsets, a, "right")) - 1
        disguised[r] += 1
        again[r] += w in INSULTS or lexicon.learned(w)
    n = np.maximum(n_words, 1)
    return np.stack([fixed / n, learned / n, np.log1p(fixed + learned + again), near / n, upper / letters, marks / n, symbols / n,
                     disguised / n, again / n, np.log1p(n_words)], axis=1)


def _rows_with_features(lexicon: Lexicon, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wh.slices(whole, "text"):
                x = features(batch, lexicon)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(x[:, j]) for j in range(len(FEATURES)))],
                                                 names=[*keep, *FEATURES])
    return run


def with_features(df: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    kinds = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), *(f"{f} double" for f in FEATURES)])
    rows = df.select(*keep, letters_only(F.col("text")).alias("text")).withColumn("capitals", F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"\P{Lu}+", "")))
    return arrow_map(rows, _rows_with_features(lexicon, keep), kinds)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, whole, toxic) once per text for its words of four letters and more and their beginnings."""
    for whole in batches:
        for batch in wh.slices(whole, "text"):
            entries, kinds, toxic = [], [], []
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = {w for w in _LETTERS.findall((text or "").lower()) if len(w) >= STEMS[0]}
                stems = {w[:n] for w in words for n in STEMS if len(w) > n}
                entries += [*words, *stems]
                kinds += [True] * len(words) + [False] * len(stems)
                toxic += [y] * (len(words) + len(stems))
            yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(kinds, pa.bool_()), pa.array(toxic, pa.int32())],
                                             names=["entry", "whole", "toxic"])


def learn_lexicon(training: DataFrame) -> Lexicon:
    """Words and beginnings whose share of toxic rows is surely high: the lower
    end of its 95 % Wilson interval is LEAST_PRECISION or more."""
    z = 1.96
    counts = (arrow_map(training.select("text", "toxic"), _entries, "entry string, whole boolean, toxic int")
              .groupBy("entry", "whole").agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).filter(F.col("k") >= LEAST_ROWS)
              .withColumn("p", F.col("k") / F.col("n"))
              .withColumn("low", (F.col("p") + z * z / 2 / F.col("n") - z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n") + z * z / 4 / F.col("n") ** 2))
                          / (1 + z * z / F.col("n"))))
    rows = counts.filter(F.col("low") >= LEAST_PRECISION).orderBy(F.desc("low"), "entry", "whole").limit(MAX_LEXICON).collect()
    return Lexicon(frozenset(r["entry"] for r in rows if r["whole"]), frozenset(r["entry"] for r in rows if not r["whole"]))


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None
    share: float = 0.0

    def score(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """``keep`` and ``score`` of every row of ``df``, which has a column text."""
        if self.trees is None:
            return df.select(*keep, F.lit(self.share).alias("score"))
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(with_features(df, self.lexicon, keep))
        rows = self.trees.transform(rows.select(*keep, "__x")).select(*keep, vector_to_array("__p")[1].alias("__raw"))
        if self.calibration is not None:
            rows = self.calibration.transform(rows)
        else:
            rows = rows.withColumn("__score", F.col("__raw"))
        return rows.select(*keep, F.least(F.greatest("__score", F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on the labelled rows of ``labels`` (id, toxic) that the caller lets it see."""
    labelled = (labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
                .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    order = F.md5(F.col("__id").cast("string").cast("binary"))
    labelled = labelled.orderBy(order, "__id").limit(max_rows)  # at most max_rows rows, so they may be broadcast
    training = docs.select(F.col(id_col).alias("__id"), letters_only(F.col(text_col)).alias("text")).join(F.broadcast(labelled), "__id")
    training = reliable(training.withColumn("part", F.expr("conv(substr(md5(cast(concat('part-', __id) as binary)), 1, 4), 16, 10) % 5")).repartition(12, "__id"))
    n, k = training.agg(F.count("*"), F.sum("toxic")).first()
    if not n or not k or k == n:
        return Model(Lexicon(), share=float(k or 0) / max(n, 1))
    lexicon = learn_lexicon(training.filter("part > 0"))  # the calibration's rows are new to the lexicon too
    rows = reliable(VectorAssembler(inputCols=list(FEATURES), outputCol="__x").transform(with_features(training, lexicon, ["toxic", "part"]))
                    .select("__x", F.col("toxic").cast("double").alias("toxic"), "part"))
    booster = GBTClassifier(featuresCol="__x", labelCol="toxic", predictionCol="__label", maxIter=15, maxDepth=4, stepSize=0.2, seed=SEED)
    trees = booster.setProbabilityCol("__p").setRawPredictionCol("__margin").fit(rows.filter("part > 0"))
    held = trees.transform(rows.filter("part = 0")).select(vector_to_array("__p")[1].alias("__raw"), "toxic")
    if held.select("toxic").distinct().count() < 2:
        return Model(lexicon, trees)
    calibration = IsotonicRegression(featuresCol="__raw", labelCol="toxic", predictionCol="__score").fit(held)
    return Model(lexicon, trees, calibration)
