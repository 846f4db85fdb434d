"""Quality rules as weak supervision.

Each rule looks at a text's measures and votes good (+1), bad (-1) or abstains
(0). Expectation-maximisation over the counts of vote patterns estimates, for
each rule, how often it votes either way on good and on bad texts, and the
share of good texts; no label is read. A text is kept if its posterior
probability of being good is at least 1/2 and the base rules pass it.

All measures are built-in expressions over the whole text. What the fit reads is
the table of distinct vote patterns, at most 3 ** (number of rules) rows
whatever the input; the posterior goes back into the plan as a sum of literals.

Defined results: a null or blank text has no words and fails the base rules; an
empty table gives an empty result; equal rows get equal results; measures of a
text without words are 0; further columns are kept, but for those called like one of
``RESULTS``, which the result replaces.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Packed, let, words_of, written

MIN_WORDS = 50
REPEAT_PERCENT = 50
MAX_ITERATIONS = 200
TOLERANCE = 1e-10
# pseudo-counts: a rule that never speaks keeps a likelihood ratio near 1
SMOOTH = 1.0
PRIOR_GOOD = 0.9
RESULTS = ("__m", "__votes", "__posterior", "__base_failed", "__kept")


@dataclass(frozen=True)
class Rule:
    """Votes on the ratio of two measures: bad at or over ``bad``, good at or
    under ``good``, else abstains (mirrored where ``bad`` is under ``good``)."""
    name: str
    over: str
    under: str
    good: float
    bad: float

    def vote(self) -> Column:
        x = F.col("__m")[self.over] / F.greatest(F.col("__m")[self.under], F.lit(1))
        low, high = (x <= self.good, x >= self.bad) if self.good < self.bad else (x >= self.good, x <= self.bad)
        return F.when(high, -1).when(low, 1).otherwise(0)


RULES = (
    Rule("symbols", "n_symbols", "n_words", 0.05, 0.4),
    Rule("repeats", "n_repeat_words", "n_words", 0.2, 0.5),
    Rule("variety", "n_distinct_words", "n_words", 0.25, 0.05),
    Rule("capitals", "n_upper", "n_letters", 0.2, 0.6),
    Rule("exclaims", "n_exclaims", "n_words", 0.1, 0.5),
    Rule("letters", "n_letters", "word_chars", 0.75, 0.5),
    Rule("cells", "n_cell_words", "n_words", 0.05, 0.25),
    Rule("dup_lines", "n_dup_lines", "n_lines", 0.1, 0.4),
)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that are found twice or more."""

    def of_hashes(h: Column) -> Column:
        n = F.size(h) - 2
        # position bits: a window's hash keeps the other 64 - bits; equal kept bits are
        # confirmed on the full hashes
        bits = F.ceil(F.log2(n.cast("double") + 1)).cast("int")

        def of_windows(win: Column) -> Column:
            kept_bits = lambda x: F.call_function("shiftleft", F.call_function("shiftrightunsigned", x, bits), bits)
            packed = F.transform(win, lambda x, i: kept_bits(x).bitwiseOR(i.cast("long")))

            def covered(s: Column) -> Column:
                mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
                at = lambda j: F.get(win, F.get(s, j).bitwiseAND(mask).cast("int"))
                same = lambda i, j: F.coalesce(at(i) == at(j), F.lit(False))
                twin = F.filter(s, lambda x, j: same(j, j + 1) | same(j, j - 1))
                spots = F.sort_array(F.transform(twin, lambda x: x.bitwiseAND(mask)))
                return let(spots, lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).otherwise(
                    F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-9).cast("long").alias("last")),
                                lambda a, x: F.struct((a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n"), x.alias("last")),
                                lambda a: a["n"])))

            return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0).cast("long")).otherwise(
                let(F.sort_array(packed), covered))

        return let(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))),
                   of_windows)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes))


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``__m``, a struct of measures of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    only = lambda keep: F.length(F.regexp_replace(t, f"[^{keep}]++", "")).cast("long")
    of_words = let(words_of(t), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        F.size(F.filter(w, lambda x: x == "|")).cast("long").alias("n_cell_words")))
    of_lines = let(F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda ls: F.struct(
        F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    parts = df.withColumns({"__w": of_words, "__l": of_lines})
    m = F.struct(*(F.col("__w")[c].alias(c) for c in ("n_words", "n_repeat_words", "n_distinct_words", "n_cell_words")),
                 *(F.col("__l")[c].alias(c) for c in ("n_lines", "n_dup_lines")),
                 (F.length(t).cast("long") - only("\\x20\\x09-\\x0D")).alias("word_chars"),
                 only("#*$%&|<>").alias("n_symbols"), only("!").alias("n_exclaims"),
                 only("\\p{L}").alias("n_letters"), only("\\p{Lu}").alias("n_upper"))
    return parts.select(*(F.col(c) for c in df.columns), m.alias("__m"))


@dataclass(frozen=True)
class Model:
    """``rates[j][y][v + 1]``: how often rule j votes v on class y (0 bad, 1 good)."""
    prior: float
    rates: tuple

    def log_odds(self, votes: Column) -> Column:
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, (bad, good) in enumerate(self.rates):
            r = [math.log(good[v] / bad[v]) for v in range(3)]
            total = total + F.when(votes[j] < 0, r[0]).when(votes[j] == 0, r[1]).otherwise(r[2])
        return total

    def accuracy(self, j: int) -> float:
        """Share of rule j's votes that name the class, abstentions aside."""
        bad, good = self.rates[j]
        right, wrong = self.prior * good[2] + (1 - self.prior) * bad[0], self.prior * good[0] + (1 - self.prior) * bad[2]
        return right / (right + wrong)


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int = len(RULES)) -> Model:
    """Expectation-maximisation over (votes, rows) pairs. The start calls a
    pattern bad if any rule does; a table without rows gives flat rates."""
    total = sum(n for _, n in patterns)
    good_of = [0.05 if min(v, default=0) < 0 else 0.95 for v, _ in patterns]
    prior, rates, last = PRIOR_GOOD, (((1 / 3,) * 3,) * 2,) * n_rules, -math.inf
    for _ in range(MAX_ITERATIONS if total else 0):
        mass = [[[SMOOTH] * 3 for _ in range(2)] for _ in range(n_rules)]
        for (votes, n), g in zip(patterns, good_of, strict=True):
            for j, v in enumerate(votes):
                mass[j][1][v + 1] += n * g
                mass[j][0][v + 1] += n * (1 - g)
        n_good = sum(n * g for (_, n), g in zip(patterns, good_of, strict=True))
        prior = (n_good + PRIOR_GOOD) / (total + 1)
        rates = tuple(tuple(tuple(x / sum(row) for x in row) for row in rule) for rule in mass)
        likelihood, good_of = 0.0, []
        for votes, n in patterns:
            good, bad = prior, 1 - prior
            for j, v in enumerate(votes):
                good *= rates[j][1][v + 1]
                bad *= rates[j][0][v + 1]
            good_of.append(good / (good + bad))
            likelihood += n * math.log(good + bad)
        if likelihood - last < TOLERANCE * abs(likelihood):
            break
        last = likelihood
    return Model(prior, rates)


def judged(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, Model]:
    """The columns ``keep`` (all; theirs of equal name are replaced) with ``__m``, ``__votes``, ``__posterior``,
    ``__base_failed`` and ``__kept``, and the fitted model. Measures are taken
    once and written to the shared folder; the fit reads the votes there."""
    packed = Packed(df, keep, text=text)
    base = (F.col("__m")["n_words"] < MIN_WORDS) | (100 * F.col("__m")["n_repeat_words"] > REPEAT_PERCENT * F.col("__m")["n_words"])
    rows = written(with_measures(packed.df, "text").select("__row", "__m")
                   .withColumn("__votes", F.array(*(r.vote().cast("tinyint") for r in RULES)))
                   .withColumn("__base_failed", base), "quality")
    # at most 3 ** len(RULES) rows
    model = fit(sorted((tuple(p["__votes"]), p["n"]) for p in rows.groupBy("__votes").agg(F.count("*").alias("n")).collect()))
    odds = model.log_odds(F.col("__votes"))
    rows = (rows.withColumn("__posterior", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
            .withColumn("__kept", ~F.col("__base_failed") & (odds >= 0)))
    return packed.unpacked(rows, RESULTS), model
