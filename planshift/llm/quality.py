"""Quality rules under weak supervision.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Rules are taken as independent given the unknown
quality, each with its own accuracy when it votes; expectation-maximisation over the counts of vote patterns estimates
the accuracies and the share of good documents, and the posterior probability of being good replaces the demand that
all rules pass. With J rules there are at most 3^J patterns, however many documents there are; each step is one small
aggregation over them.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planshift.llm.shared import stored

WHITE = " \t\n\v\f\r"
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words of a text: the runs of characters other than space and \\x09-\\x0D."""
    trimmed = F.btrim(text, F.lit(WHITE))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[ \\x09-\\x0D]+")
    )


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the document, the first finding included.

    Windows are compared by a 64-bit hash; the work and the memory grow with the words of one document (times its
    logarithm).
    """

    def covered(hashes: Column) -> Column:
        # (hash, place) sorted: equal windows stand side by side
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(p: Column) -> Column:
            same = lambda x, k: x["h"] == F.get(p, k)["h"]
            again = F.filter(
                p,
                lambda x, k: F.coalesce(same(x, k - 1), F.lit(False)) | F.coalesce(same(x, k + 1), F.lit(False)),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def length(at: Column) -> Column:
            # each window adds its words up to the next repeated window
            ahead = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.lit(2**31 - 1)))
            steps = F.zip_with(at, ahead, lambda a, b: F.least(b - a, F.lit(WINDOW)).cast("long"))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x)

        return let(let(pairs, places), length)

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def found(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(let(hashed, windows), found))


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts over each whole text: the inputs of the rules. A null text counts as an empty one."""
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda chars: F.length(F.translate(F.col("__text"), chars, ""))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    long = lambda c: c.cast("long")
    return (
        docs.select(F.col(key).alias("__key"), t.alias("__text"))
        .withColumns({"__words": words_of(F.col("__text")), "__lines": lines})
        .select(
            F.col("__key").alias(key),
            long(F.size("__words")).alias("n_words"),
            long(without(WHITE)).alias("word_chars"),
            long(F.length("__text") - without(SYMBOLS)).alias("n_symbols"),
            long(F.length("__text") - without("!")).alias("n_marks"),
            long(F.size("__lines")).alias("n_lines"),
            long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
            repeated_window_words(F.col("__words")).alias("n_repeat_words"),
        )
    )


def share_rule(part: str, whole: str, good_below: float, bad_above: float) -> str:
    """SQL vote: good if ``part`` is under one share of ``whole``, bad if it is over the other, else none."""
    return (
        f"CASE WHEN {whole} = 0 THEN 0 WHEN {part} > {bad_above} * {whole} THEN -1 "
        f"WHEN {part} < {good_below} * {whole} THEN 1 ELSE 0 END"
    )


# Votes as SQL over the columns of ``text_counts``; the same text runs in the checking SQL.
RULES: dict[str, str] = {
    "length": "CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 50 THEN 1 ELSE 0 END",
    "word_length": (
        "CASE WHEN n_words = 0 THEN 0 WHEN word_chars < 2.5 * n_words OR word_chars > 12.0 * n_words THEN -1 "
        "WHEN word_chars BETWEEN 3.0 * n_words AND 9.0 * n_words THEN 1 ELSE 0 END"
    ),
    "symbols": share_rule("n_symbols", "n_words", 0.05, 0.2),
    "marks": share_rule("n_marks", "n_words", 0.05, 0.3),
    "repeats": share_rule("n_repeat_words", "n_words", 0.05, 0.2),
    "lines": share_rule("n_dup_lines", "n_lines", 0.1, 0.3),
}
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and the accuracy of each rule when it votes."""

    good: float
    accuracy: Mapping[str, float]

    def posterior(self) -> Column:
        """Probability of being good, from vote columns named as the rules."""
        odds = F.lit(math.log(self.good / (1 - self.good)))
        for name, a in self.accuracy.items():
            odds = odds + F.col(name) * math.log(a / (1 - a))
        return 1 / (1 + F.exp(-odds))


def fit_votes(
    votes: DataFrame, rules: list[str], good: float = 0.8, accuracy: float = 0.8, rounds: int = 12
) -> VoteModel:
    """Expectation-maximisation over vote patterns; counts are smoothed by one right and one wrong vote per rule.

    Accuracies and the good share are kept within [0.01, 0.99]; without documents the starting values stay.
    """
    patterns = stored(votes.groupBy(*rules).agg(F.count(F.lit(1)).alias("__n")), "vote-patterns").coalesce(1)
    model = VoteModel(good, {r: accuracy for r in rules})
    bounded = lambda x: min(max(x, 0.01), 0.99)
    for _ in range(rounds):
        p, n = F.col("__p"), F.col("__n")
        agree = lambda r: F.when(F.col(r) > 0, p).when(F.col(r) < 0, 1 - p).otherwise(0.0)
        row = (
            patterns.withColumn("__p", model.posterior())
            .agg(
                F.sum("__n").alias("__all"), F.sum(n * p).alias("__good"),
                *[F.sum(n * agree(r)).alias(f"right_{r}") for r in rules],
                *[F.sum(n * F.abs(r)).alias(f"cast_{r}") for r in rules],
            )
            .first()
        )
        if not row["__all"]:
            break
        model = VoteModel(
            bounded(row["__good"] / row["__all"]),
            {r: bounded((row[f"right_{r}"] + 1) / (row[f"cast_{r}"] + 2)) for r in rules},
        )
    return model


def judged(
    docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Mapping[str, str] = RULES, keep_from: float = 0.5
) -> DataFrame:
    """Counts, ``base_failed``, ``p_good`` and ``kept`` of every document.

    ``kept`` is false where the base test fails, else whether the posterior reaches ``keep_from``. Null and empty texts
    have no words and fail the base test. Repeated rows are judged alike; other columns of ``docs`` are not read.
    """
    counts = stored(text_counts(docs, key, text), "text-counts")
    votes = counts.withColumns({name: F.expr(sql) for name, sql in rules.items()})
    model = fit_votes(votes, list(rules))
    failed = F.expr(BASE_FAILED)
    return votes.withColumn("p_good", model.posterior()).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.col("p_good") >= keep_from)).alias("kept"), "p_good",
    )
