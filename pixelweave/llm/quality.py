"""Quality rules: fixed base limits, then robust multivariate outliers.

Five statistics of each text are transformed and compared with the rest of its language
and source.  Location and scatter are minimum-covariance-determinant estimates: from
medians and absolute deviations, and from means and covariances, concentration steps keep
the part ``h`` of a group's texts nearest by Mahalanobis distance and estimate again from
these until the determinant falls no more; the estimate of least determinant stays.  A step is
one aggregate by group and distance bin, with map-side combine, so a group of any size
costs no more than its bins; the kept part ends at a bin's edge.  A group's estimate is
drawn towards that of all texts together: it weighs as many texts as the step keeps
beyond the five that five dimensions take up, the estimate of all weighs ``PRIOR``.  So a
small group is judged by the rule of all and a large one by its own, without a size at
which one turns into the other.  Texts farther than ``cutoff`` (a chi-square
quantile far in the tail, with floors under the scatter so that groups of very even texts
stay tolerant) are rejected.

Everything is DataFrame expressions.  Defined results: null text has no words and fails
the base limits; null language or source is a group value of its own; repeated rows are
judged each; a null id passes through; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pixelweave.llm.common import discard, join_groups, materialize
from pixelweave.llm.text import spaced, whole, word_chars, word_count

MIN_WORDS = 50
#: Part of a group that concentration steps keep, and the matching consistency factor
#: h / P(chi2 with 7 degrees <= its h-quantile with 5 degrees).
KEPT_PART = 0.75
CONSISTENCY = 1.412
#: Chi-square quantile with 5 degrees of freedom at one in a million.
CUTOFF = 35.9
#: Concentration steps at most; a group's end after PATIENCE steps in which the logarithm
#: of its determinant does not fall by SETTLED.
STEPS = 30
PATIENCE, SETTLED = 3, 1e-9
#: Texts of the estimate of all that a group's own is drawn by.
PRIOR = 50
#: Bins of log(1 + squared distance) in a concentration step.
BINS_PER_UNIT = 64
MAX_BIN = 64 * 30

#: name -> least standard deviation on the transformed scale.
FLOORS = {"x1": 0.12, "x2": 0.30, "x3": 0.15, "x4": 0.15, "x5": 0.08}
DIMS = list(FLOORS)


def _first(e: Column) -> Column:
    return F.element_at(e, 1)


def _repeat_words(hashes: str) -> Column:
    """Words in the 3-word windows whose hash occurs twice or more."""

    def marked(s: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(s, k)["h"], F.lit(False))
        hit = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]).otherwise(F.lit(-1)))
        return F.filter(hit, lambda i: i >= 0)

    def covered(p: Column) -> Column:
        return F.size(F.array_distinct(F.concat(p, F.transform(p, lambda i: i + 1), F.transform(p, lambda i: i + 2))))

    ordered = F.sort_array(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    positions = _first(F.transform(F.array(ordered), marked))
    count = _first(F.transform(F.array(positions), covered))
    repeats = F.size(F.array_distinct(F.col(hashes))) < F.size(F.col(hashes))
    return F.when(repeats, count).otherwise(F.lit(0)).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """Base statistics of every text, in one pass over it, and the columns to ``carry`` along."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), whole(text_col).alias("t"), *carry)
    rows = rows.withColumn("line", spaced(F.col("t")))
    lines = F.filter(F.split(F.col("t"), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    windows = F.regexp_extract_all(F.col("line"), F.lit("(?<![^ ])(?=([^ ]++ [^ ]++ [^ ]++))[^ ]++ "), F.lit(1))
    rows = rows.select(
        "doc_id", "lang", "source", "line", word_chars(F.col("line")).alias("word_chars"), lines.alias("lines"),
        F.length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.transform(windows, lambda w: F.xxhash64(w)).alias("windows"), *carry,
    )
    rows = rows.select(
        "doc_id", "lang", "source", word_count(F.col("line"), F.col("word_chars")).alias("n_words"), "word_chars", "n_symbols", "n_upper",
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words("windows").alias("n_repeat_words"), *carry,
    )
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _vector() -> dict[str, Column]:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "x1": F.log(F.greatest(part("word_chars", "n_words"), F.lit(0.1))),
        "x2": F.log(1 + 100 * part("n_symbols", "word_chars")),
        "x3": F.sqrt(part("n_dup_lines", "n_lines")),
        "x4": F.sqrt(part("n_repeat_words", "n_words")),
        "x5": F.asin(F.sqrt(F.least(part("n_upper", "word_chars"), F.lit(1.0)))),
    }


#: Groups as keys, with the number of the start, and the group of all texts.
GROUP = ["g_lang", "g_source"]
KEYS = [*GROUP, "g_start"]
ALL = "\x00all"
SQUARES = [(a, b) for i, a in enumerate(DIMS) for b in DIMS[: i + 1]]
ESTIMATE = [f"m_{a}" for a in DIMS] + [f"s_{a}_{b}" for a, b in SQUARES]


def _factors() -> list[str]:
    """The Cholesky factor ``l_i_j`` of the scatter ``s_i_j``, each line using those before
    it, and the logarithm of the determinant."""
    out = []
    for j, b in enumerate(DIMS):
        low = DIMS[:j]
        rest = " - ".join([f"s_{b}_{b}", *(f"l_{b}_{k} * l_{b}_{k}" for k in low)])
        out.append(f"sqrt(greatest({rest}, {FLOORS[b] ** 2!r}D)) AS l_{b}_{b}")
        for a in DIMS[j + 1 :]:
            rest = " - ".join([f"s_{a}_{b}", *(f"l_{a}_{k} * l_{b}_{k}" for k in low)])
            out.append(f"({rest}) / l_{b}_{b} AS l_{a}_{b}")
    return [*out, "2 * (" + " + ".join(f"ln(l_{a}_{a})" for a in DIMS) + ") AS logdet"]


def _distance() -> list[str]:
    """Squared Mahalanobis distance by forward substitution."""
    out = []
    for i, a in enumerate(DIMS):
        rest = " - ".join([f"{a} - m_{a}", *(f"l_{a}_{b} * z_{b}" for b in DIMS[:i])])
        out.append(f"({rest}) / l_{a}_{a} AS z_{a}")
    return [*out, " + ".join(f"z_{a} * z_{a}" for a in DIMS) + " AS d2"]


def _factored(params: DataFrame) -> DataFrame:
    return params.selectExpr("*", *_factors())


def _with_distance(rows: DataFrame, params: DataFrame, keys: list[str], groups: int | None = None) -> DataFrame:
    """``d2``, the squared Mahalanobis distance of each row from its group."""
    columns = rows.columns
    used = [f"m_{a}" for a in DIMS] + [f"l_{a}_{b}" for a, b in SQUARES]
    out = join_groups(rows, _scratch(params.select(*keys, *used), params), keys, "doc_id", size=groups)
    return out.selectExpr("*", *_distance()).select(*columns, "d2")


def _scratch(part: DataFrame, table: DataFrame) -> DataFrame:
    """Some columns of a scratch table, still counted as one."""
    part.scratch_path = table.scratch_path
    return part


def _starts(sound: DataFrame) -> DataFrame:
    """First estimates: medians with scaled absolute deviations, means with covariances."""
    medians = materialize(sound.groupBy(*GROUP).agg(*[F.percentile_approx(a, 0.5, 2000).alias(f"m_{a}") for a in DIMS]), "mcd-median")
    near = join_groups(sound, medians, GROUP, "doc_id")
    spread = near.groupBy(*GROUP).agg(
        *[F.first(f"m_{a}").alias(f"m_{a}") for a in DIMS], *[F.percentile_approx(F.abs(F.col(a) - F.col(f"m_{a}")), 0.5, 2000).alias(f"d_{a}") for a in DIMS]
    )
    own = {(a, b): F.pow(F.lit(1.4826) * F.col(f"d_{a}"), 2) + F.lit(FLOORS[a] ** 2) if a == b else F.lit(0.0) for a, b in SQUARES}
    robust = spread.select(*GROUP, F.lit(0).alias("g_start"), *[f"m_{a}" for a in DIMS], *[v.alias(f"s_{a}_{b}") for (a, b), v in own.items()])
    plain = _estimate(_sums(sound, GROUP), GROUP, 1.0).withColumn("g_start", F.lit(1))
    every = _factored(robust.unionByName(plain)).select("*", *[F.col(c).alias(f"k_{c}") for c in ESTIMATE], F.lit(float("inf")).alias("k_logdet"), F.lit(0).alias("stale"))
    out = materialize(every, "mcd-start")
    discard(medians)
    return out


TOTALS = [f"t_{a}" for a in DIMS] + [f"t_{a}_{b}" for a, b in SQUARES]


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"sum({a}) AS t_{a}") for a in DIMS], *[F.expr(f"sum({a} * {b}) AS t_{a}_{b}") for a, b in SQUARES])


def _estimate(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Means, and covariances times a factor with the floors added."""
    floor = lambda a, b: f" + {FLOORS[a] ** 2!r}D" if a == b else ""
    scatter = [f"{factor!r}D * (t_{a}_{b} / n - m_{a} * m_{b}){floor(a, b)} AS s_{a}_{b}" for a, b in SQUARES]
    return sums.selectExpr(*keys, *[f"t_{a} / n AS m_{a}" for a in DIMS], *scatter)


def _concentrate(rows: DataFrame, params: DataFrame, groups: int, turn: int) -> DataFrame:
    """One concentration step of the groups in ``params``, so many.  ``k_`` is a group's
    estimate of least determinant so far, ``stale`` the steps since there was a better one;
    as the kept part ends at a bin's edge, a group may go to and fro between estimates."""
    near = _with_distance(rows, params, KEYS, groups).where("d2 IS NOT NULL").withColumn("bin", F.least(F.floor(F.log(1 + F.col("d2")) * BINS_PER_UNIT), F.lit(MAX_BIN)).cast("int"))
    binned = _sums(near, [*KEYS, "bin"])
    group = Window.partitionBy(*KEYS)
    binned = binned.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all", F.sum("n").over(group))
    inner = binned.where(F.col("upto") - F.col("n") < F.ceil(KEPT_PART * F.col("all")))
    following = _factored(_estimate(inner.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n", *TOTALS)]), KEYS, CONSISTENCY))
    kept = [*[f"k_{c}" for c in ESTIMATE], "k_logdet", "stale"]
    both = join_groups(following, _scratch(params.select(*KEYS, *kept), params), KEYS, "g_start", size=groups)
    both = both.withColumn("better", F.col("logdet") < F.col("k_logdet") - SETTLED)
    rest = [c for c in both.columns if c not in (*kept, "better")]
    best = [f"if(better, {c}, k_{c}) AS k_{c}" for c in (*ESTIMATE, "logdet")]
    return materialize(both.selectExpr(*rest, *best, "if(better, 0, stale + 1) AS stale"), f"mcd-{turn}")


def outlier_distances(stats: DataFrame, steps: int = STEPS, prior: float = PRIOR) -> DataFrame:
    """``stats`` (a scratch table) with the squared robust distance ``d2`` of each row."""
    rows = stats.select("*", *[e.alias(a) for a, e in _vector().items()]).withColumns({"g_lang": F.col("lang"), "g_source": F.col("source")})
    sound = materialize(rows.where(~F.col("base_failed")).select("doc_id", *GROUP, *DIMS), "mcd-sound")
    grouped = sound.unionByName(sound.withColumns({k: F.lit(ALL) for k in GROUP}))
    params = _starts(grouped)
    groups, settled = params.count(), []
    tried = grouped.withColumn("g_start", F.explode(F.array(F.lit(0), F.lit(1))))
    for turn in range(steps):
        following = _concentrate(tried, params, groups, turn)
        moving = _scratch(following.where(F.col("stale") < PATIENCE), following)
        settled.append(_scratch(following.where(F.col("stale") >= PATIENCE), following))
        if turn == 0:
            discard(params)
        params = moving
        groups = moving.count()
        if not groups:
            break
    if groups:
        settled.append(params)
    used = [*GROUP, "g_start", F.col("k_logdet").alias("logdet"), *[F.col(f"k_{c}").alias(c) for c in ESTIMATE]]
    found = settled[0].select(*used)
    for part in settled[1:]:
        found = found.unionByName(part.select(*used))
    best = materialize(found.groupBy(*GROUP).agg(F.min_by(F.struct(*ESTIMATE), F.struct("logdet", "g_start")).alias("e")).select(*GROUP, "e.*"), "mcd-best")
    every = best.where((F.col("g_lang") == ALL) & (F.col("g_source") == ALL)).first()
    if every is None:
        return rows.drop(*DIMS, *GROUP).withColumn("d2", F.lit(None).cast("double"))
    sizes = rows.groupBy(*GROUP).agg(F.count_if(~F.col("base_failed")).alias("size"))
    sure = F.greatest(KEPT_PART * F.col("size") - len(DIMS), F.lit(0.0))
    own = sure / (sure + prior)
    drawn = [F.coalesce(own * F.col(c), F.lit(0.0)) + (1 - own) * F.lit(every[c]) for c in ESTIMATE]
    final = join_groups(sizes, best, GROUP, "size").select(*GROUP, *[v.alias(c) for c, v in zip(ESTIMATE, drawn)])
    out = _with_distance(rows, materialize(_factored(final), "mcd-final"), GROUP).drop(*DIMS, *GROUP)
    discard(*settled, sound, best)
    return out


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: base statistics, ``base_failed``, ``kept`` and ``distance``.

    Columns to ``carry`` are written beside the statistics and come out with the verdict, so
    that a caller who wants them need not join verdicts to documents.
    """
    stats = materialize(text_statistics(docs, id_col, text_col, lang_col, source_col, carry), "quality-stats")
    judged = outlier_distances(stats)
    near = F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & near).alias("kept"), F.sqrt("d2").alias("distance"), *carry,
    )
