"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked in turn to the target
share of every source, language and topic until all margins hold.  The ratio of a cell's
fitted to its actual tokens, scaled so that the expected sample has the wanted size and
capped at one, is the probability with which its documents are kept; a hash of seed and
id decides, so that any machine decides alike.

Only the cell table, one row per combination that occurs, is iterated on.  Everything is
DataFrame expressions.  Defined results: null text counts one token; null source,
language or topic is a value of its own; rows of one id share a draw, each compared with
the probability of its own cell; a null id is hashed as the word null; targets for values that do not occur are ignored and the rest
scaled up; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.llm.common import discard, join_groups, materialize
from pixelweave.llm.text import spaced, whole, word_chars, word_count

DIMS = ("source", "lang", "topic")
#: Without given targets a value's share is its token share to this power, scaled to 1.
EXPONENT = 0.7
#: Expected tokens of the sample, as a part of all tokens.
BUDGET = 0.8
SEED = 17
#: Largest difference of a margin's share from its target that ends the fitting.
TOLERANCE = 1e-7
SWEEPS_PER_STEP = 4
MAX_STEPS = 15


def topic_of(text: Column, n_words: Column) -> Column:
    """A coarse topic from the text's form: licence, table, long, short or prose."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(text.rlike("(?i)licen[sc]e|copyright"), "licence").when(20 * bars >= n_words, "table").when(n_words >= 1000, "long").when(n_words < 100, "short").otherwise("prose")
    )


def weighed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (words, at least 1) and, unless there is one, ``topic``."""
    line = spaced(whole(text_col))
    rows = docs.withColumn("_line", line)
    rows = rows.withColumn("_words", word_count(F.col("_line"), word_chars(F.col("_line"))))
    if "topic" not in docs.columns:
        rows = rows.withColumn("topic", topic_of(F.col("_line"), F.col("_words")))
    return rows.withColumn("n_tokens", F.greatest("_words", F.lit(1)).cast("long")).drop("_line", "_words")


def target_shares(cells: DataFrame, dim: str, given: dict[str, float] | None, exponent: float) -> DataFrame:
    """``(dim, share)``: the wanted share of each value that occurs, summing to one."""
    totals = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    if given is None:
        wanted = totals.withColumn("raw", F.pow(F.col("t").cast("double"), F.lit(exponent)))
    else:
        table = F.create_map(*[x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))])
        wanted = totals.withColumn("raw", F.coalesce(F.try_element_at(table, F.col(dim)), F.lit(0.0)))
    norm = wanted.agg(F.sum("raw")).first()[0]
    return wanted.select(dim, (F.col("raw") / F.lit(norm or None).cast("double")).alias(f"share_{dim}"))


def fit(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, exponent: float = EXPONENT) -> DataFrame:
    """Cells ``(*DIMS, tokens)`` with their fitted tokens ``fitted``."""
    targets = targets or {}
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for dim in DIMS:
        shares = materialize(target_shares(cells, dim, targets.get(dim), exponent), f"mix-{dim}")
        now = join_groups(now, shares, [dim], "tokens")
    now = materialize(now, "mix-cells")
    for step in range(MAX_STEPS):
        swept = now
        for _ in range(SWEEPS_PER_STEP):
            for dim in DIMS:
                margin = F.sum("fitted").over(Window.partitionBy(dim))
                swept = swept.withColumn("fitted", F.when(margin > 0, F.col("fitted") * F.col(f"share_{dim}") * F.lit(float(total)) / margin).otherwise(0.0))
        swept = materialize(swept, f"mix-step{step}")
        off = 0.0
        for dim in DIMS:
            margins = swept.groupBy(dim).agg((F.sum("fitted") / F.lit(float(total or 1))).alias("is"), F.first(f"share_{dim}").alias("want"))
            off = max(off, margins.agg(F.max(F.abs(F.col("is") - F.col("want")))).first()[0] or 0.0)
        discard(now)
        now = swept
        if off <= TOLERANCE:
            break
    else:
        warnings.warn(f"margins are still {off:.2g} off their targets after {MAX_STEPS * SWEEPS_PER_STEP} sweeps; the targets may contradict each other", stacklevel=2)
    return now.select(*DIMS, "tokens", "fitted")


def probabilities(fitted: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Cells with ``weight`` (fitted over actual tokens) and keeping ``probability``.

    The scale is raised until the expected tokens reach ``budget`` of all, a cell that
    reaches probability one staying there.
    """
    cells = fitted.withColumn("weight", F.col("fitted") / F.col("tokens"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = float(budget)
    for _ in range(100):
        full = F.col("weight") * F.lit(scale) >= 1
        capped, rest = cells.agg(F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("fitted"))), F.lit(0.0))).first()
        following = max(scale, (budget * total - capped) / rest) if rest > 0 else scale
        if following <= scale * (1 + 1e-12):
            break
        scale = following
    else:
        warnings.warn("the budget is not reached: the cap moved in every round", stacklevel=2)
    return cells.select(*DIMS, "tokens", "fitted", "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)).alias("probability"))


def keep_draw(id_col: str, seed: int = SEED) -> Column:
    """A number in [0, 1) from seed and id."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def cell_probabilities(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, exponent: float = EXPONENT, budget: float = BUDGET) -> DataFrame:
    """The probability table (a scratch table) for rows with ``DIMS`` and ``n_tokens``."""
    cells = materialize(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "mix-tokens")
    return materialize(probabilities(fit(cells, targets, exponent), budget), "mix-probability")


def mixture(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, exponent: float = EXPONENT, budget: float = BUDGET, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens, weight, probability, selected`` per row."""
    topic = ["topic"] if "topic" in docs.columns else []
    rows = materialize(weighed(docs.select(F.col(id_col).alias("doc_id"), "source", "lang", *topic, F.col(text_col).alias("text")), "text").drop("text"), "mix-rows")
    table = cell_probabilities(rows, targets, exponent, budget)
    out = join_groups(rows, table.drop("tokens", "fitted"), list(DIMS), "doc_id")
    return out.select("doc_id", *DIMS, "n_tokens", "weight", "probability", (keep_draw("doc_id", seed) < F.col("probability")).alias("selected"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, exponent: float = EXPONENT, budget: float = BUDGET, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mixture selects, with their own columns.

    Every row is decided where it stands, by the probability of its cell; texts are not
    shuffled.
    """
    topic = ["topic"] if "topic" in docs.columns else []
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    rows = weighed(docs.select(own, F.col(id_col).alias("doc_id"), "source", "lang", *topic, F.col(text_col).alias("text")), "text")
    table = cell_probabilities(rows, targets, exponent, budget)
    out = join_groups(rows.select("row", "doc_id", *DIMS), table.select(*DIMS, "probability"), list(DIMS), "doc_id")
    return out.where(keep_draw("doc_id", seed) < F.col("probability")).select("row.*")
