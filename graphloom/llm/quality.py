"""Document quality by weak supervision: rules vote, their accuracies are estimated, the posterior decides.

A rule votes good (1), votes bad (-1) or abstains (0); one rule for each kind of
damage votes bad where it sees it and otherwise abstains, two rules vote good on
texts that look regular throughout. Documents with equal votes are one pattern;
there are at most 2 to the number of rules. Expectation-maximisation runs on the
pattern counts: a pattern's posterior follows from the accuracies of the rules
that vote, and accuracies are the share of votes that the posterior agrees with.
Classes are taken as balanced beforehand (``BALANCE``), so a damage that only one
rule can see is not outvoted by how rare it is. No labels are used, and no rule
must pass.

Only DataFrame functions run here. Documents are read once; the estimation
aggregates the pattern table, whose sums are the only values that reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialize

ROUNDS = 12
#: Share of good documents among documents without votes; accuracies before the first round, and their range.
BALANCE, START_ACCURACY, ACCURACIES = 0.5, 0.85, (0.6, 0.99)
KEPT_FROM = 0.5
_BLANK = r"[\x20\x09-\x0D]"


def word_features(docs: DataFrame) -> DataFrame:
    """Counts of each row of ``docs`` (doc_id, text, any others) over its whole text; a null text has none of anything.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``),
    n_lines (with a word), n_dup_lines (equal to an earlier line),
    n_repeat_words (words inside three-word windows that occur twice or more),
    n_upper, n_shouts (exclamation marks), n_distinct (words).
    """
    text = F.coalesce("text", F.lit(""))
    count = lambda others: F.char_length(F.regexp_replace("text", others, "")).cast("long")
    base = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", F.array_remove(F.split("text", _BLANK + "+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.greatest(F.size("words") - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice("words", k + 1, n).alias(f"w{k}") for k in range(3)])
    counted = base.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count(r"[^#*$%&|<>]+").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        count("[^A-Z]+").alias("n_upper"), count("[^!]+").alias("n_shouts"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.transform(windows, lambda w: F.xxhash64(w["w0"], w["w1"], w["w2"])).alias("windows"))
    # only texts in which a window recurs are sorted
    recurs = F.size(F.array_distinct("windows")) < F.size("windows")
    sorted_windows = F.when(recurs, F.array_sort(F.transform("windows", lambda h, p: F.struct(h.alias("h"), p.alias("p")))))
    ordered = counted.withColumn("ordered", sorted_windows).drop("windows")
    same = lambda x, i: F.coalesce(F.get("ordered", i)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("ordered", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))
    ordered = ordered.withColumn("starts", starts).drop("ordered")
    covered = F.transform("starts", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("starts", i + 1) - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return ordered.withColumn("n_repeat_words", F.coalesce(total, F.lit(0)).cast("long")).drop("starts")


def rule_votes() -> dict[str, Column]:
    """Vote of each rule from the columns of ``word_features``."""
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    per_word, lines = lambda a: share(a, "n_words"), share("n_dup_lines", "n_lines")
    upper, length = share("n_upper", "word_chars"), per_word("word_chars")
    bad = {
        "short": F.col("n_words") < 20,
        "word_length": (length < 1.5) | (length > 25),
        "symbols": per_word("n_symbols") > 0.15,
        "dup_lines": lines > 0.3,
        "repeats": per_word("n_repeat_words") > 0.35,
        "upper": upper > 0.4,
        "shouts": per_word("n_shouts") > 0.25,
        "poor": (per_word("n_distinct") < 0.12) & (F.col("n_distinct") < 300),
    }
    clean = (per_word("n_symbols") < 0.05) & (per_word("n_shouts") < 0.1) & (upper < 0.2)
    good = {
        "prose": clean & (F.col("n_words") >= 40) & length.between(2.5, 14),
        "fresh": clean & (per_word("n_repeat_words") < 0.2) & (lines < 0.15),
    }
    votes = {k: F.when(v, -1) for k, v in bad.items()} | {k: F.when(v, 1) for k, v in good.items()}
    return {k: v.otherwise(0).cast("tinyint") for k, v in votes.items()}


def posterior(accuracies: dict[str, float]) -> Column:
    """Probability that a document is good, from its votes."""
    odds = F.lit(math.log(BALANCE / (1 - BALANCE)))
    for name, accuracy in accuracies.items():
        odds = odds + F.col(f"vote_{name}") * F.lit(math.log(accuracy / (1 - accuracy)))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> dict[str, float]:
    """Accuracy of each rule from a table of vote patterns (vote_*, n); a rule without votes keeps its first one."""
    accuracies = dict.fromkeys(names, START_ACCURACY)
    for _ in range(rounds):
        p, n, sums = posterior(accuracies), F.col("n"), []
        for name in names:
            vote = F.col(f"vote_{name}")
            sums += [F.sum(F.when(vote != 0, n)).alias(f"n_{name}"), F.sum(F.when(vote > 0, n * p).when(vote < 0, n * (1 - p))).alias(f"right_{name}")]
        row = patterns.agg(*sums).first()
        accuracies = {k: min(ACCURACIES[1], max(ACCURACIES[0], row[f"right_{k}"] / row[f"n_{k}"])) if row[f"n_{k}"] else accuracies[k] for k in names}
    return accuracies


def quality(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Counts, votes, ``quality`` (posterior), base_failed and kept for every row of ``docs`` (doc_id, text, any others).

    base_failed: fewer than 50 words, or more than half of the words repeated.
    kept: not base_failed and the posterior is at least ``KEPT_FROM``. Null and
    empty texts have no words and fail; repeated rows each get a row; an empty
    table gives none. Other columns are not read.
    """
    votes = rule_votes()
    rows = materialize(word_features(docs).withColumns({f"vote_{k}": v for k, v in votes.items()}), "quality")
    patterns = materialize(rows.groupBy(*[f"vote_{k}" for k in votes]).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    accuracies = estimate(patterns, list(votes), rounds)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = rows.withColumns({"quality": posterior(accuracies), "base_failed": failed})
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEPT_FROM))
