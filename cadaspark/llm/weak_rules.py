"""Quality rules by weak supervision, in DataFrame expressions only.

Rules look at figures of a text and vote good, bad or abstain; most only speak up against a text, some only for it. Votes are
counted by pattern (at most 3 to the number of rules), and expectation-maximisation over the patterns estimates how often
each rule is right when it votes. A text is kept when the posterior probability of being good is at least one half and the base rule passes.

Edge cases: a null or empty text has no words and fails the base rule; an empty table gives an empty result; repeated rows are
judged each for itself; the figures take the whole text. Windows of three words are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadaspark.sources.scratch import keep

BLANK = r"[\x20\x09-\x0D]+"
ROUNDS = 20
KEEP_FROM = 0.5
# A text is good or bad with even chances before the votes: where single rules speak alone, as here, a share of good texts
# estimated together with the accuracies runs off to "all good". PRIOR is how many texts the starting accuracy is worth.
GOOD, START_ACCURACY, PRIOR = 0.5, 0.9, 4.0
VOCABULARY_GROWTH, FEW_WORDS = 0.7, 1.1


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs at least twice."""
    n = F.size(words)

    def marked(windows: Column) -> Column:
        places = F.zip_with(windows, F.sequence(F.lit(1), F.size(windows)), lambda h, p: F.struct(h.alias("h"), p.alias("p")))

        def twice(ordered: Column) -> Column:
            same = F.filter(
                ordered,
                lambda x, i: ((i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]))
                | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(same, lambda x: x["p"]))

        start = F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-3).alias("last"))
        covered = F.aggregate(
            let(F.sort_array(places), twice),
            start,
            lambda acc, p: F.struct(
                (acc["sum"] + F.least(F.lit(3), p - acc["last"])).cast("bigint").alias("sum"), p.alias("last")
            ),
            lambda acc: acc["sum"],
        )
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(covered)

    hashes = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)),
    )
    return F.when(n >= 4, let(hashes, marked)).otherwise(F.lit(0).cast("bigint"))


def figures(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns and the figures of each whole text."""
    keys = carry or ["doc_id"]
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
            repeated_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda s: s.rlike("[.!?\"]\\s*$"))).cast("bigint").alias("n_ended"),
        )

    words = F.array_remove(F.split(body, BLANK), "")
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    wide = df.select(
        *[F.col(f"`{k}`") for k in keys],
        let(words, of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
    )
    return wide.select(*[F.col(f"`{k}`") for k in keys], "w.*", "l.*", "n_symbols", "n_upper")


def vote(good: Column, bad: Column) -> Column:
    """1 good, 0 bad, -1 abstain; an undefined figure abstains."""
    return F.coalesce(F.when(bad, 0).when(good, 1), F.lit(-1)).cast("int")


def share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def rules() -> dict[str, Column]:
    """Votes by name over the figures."""
    length, symbols = share("word_chars", "n_words"), share("n_symbols", "n_words")
    twins, repeats = share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")
    upper, ended = share("n_upper", "word_chars"), share("n_ended", "n_lines")
    # different words grow more slowly than words: against this power the figure does not fall with the length of a text
    variety = F.when(F.col("n_words") > 0, F.col("n_distinct") / F.pow("n_words", F.lit(VOCABULARY_GROWTH)))
    never = F.lit(False)
    marks = (symbols <= 0.05) & (upper <= 0.2)
    return {
        "odd_word_length": vote(never, ~length.between(2, 14)),
        "many_symbols": vote(never, symbols > 0.3),
        "twin_lines": vote(never, twins > 0.3),
        "repeated_words": vote(never, repeats > 0.3),
        "shouting": vote(never, upper > 0.5),
        "few_words_over_and_over": vote(never, variety < FEW_WORDS),
        "plain_marks": vote(marks & length.between(3, 10), never),
        "running_text": vote(marks & (repeats <= 0.1) & (variety >= FEW_WORDS), never),
        "whole_sentences": vote(marks & (repeats <= 0.2) & (ended >= 0.7), never),
    }


def likelihood(names: list[str], accuracy: dict[str, float], kind: int) -> Column:
    """Chance of the votes that were cast on a text that is good (1) or bad (0)."""
    out = F.lit(1.0)
    for name in names:
        right = F.when(F.col(name) == kind, accuracy[name]).otherwise(1 - accuracy[name])
        out = out * F.when(F.col(name) < 0, 1.0).otherwise(right)
    return out


def posterior(names: list[str], accuracy: dict[str, float]) -> Column:
    good = likelihood(names, accuracy, 1) * GOOD
    bad = likelihood(names, accuracy, 0) * (1 - GOOD)
    return good / (good + bad)


def estimate(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Accuracies of the rules, by expectation-maximisation over counted vote patterns."""
    accuracy = dict.fromkeys(names, START_ACCURACY)
    patterns = keep(votes.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "vote-patterns")
    q, n = F.col("q"), F.col("n")
    sums = []
    for i, name in enumerate(names):
        right = F.when(F.col(name) == 1, n * q).when(F.col(name) == 0, n * (1 - q)).otherwise(0)
        sums += [F.sum(right).alias(f"right{i}"), F.sum(F.when(F.col(name) >= 0, n).otherwise(0)).alias(f"cast{i}")]
    for _ in range(rounds):
        row = patterns.withColumn("q", posterior(names, accuracy)).agg(*sums).first()
        accuracy = {
            name: ((row[f"right{i}"] or 0) + PRIOR * START_ACCURACY) / ((row[f"cast{i}"] or 0) + PRIOR) for i, name in enumerate(names)
        }
    return accuracy


def judge(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns, figures, a vote per rule, ``base_failed``, ``posterior`` and ``kept``."""
    keys = carry or ["doc_id"]
    votes = rules()
    measured = keep(figures(df, text, keys).select("*", *[c.alias(n) for n, c in votes.items()]), "text-figures")
    names = list(votes)
    accuracy = estimate(measured, names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    done = measured.withColumns({"base_failed": failed, "posterior": posterior(names, accuracy)})
    return done.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM))
