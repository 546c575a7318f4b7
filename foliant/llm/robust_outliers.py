"""Quality rules with robust multivariate outliers, in DataFrame operations only.

Base rules fail a document of fewer than 50 words, or with more than half of its words in repeated 3-word windows.
For the rest, a vector of transformed statistics (STATISTICS) is compared to a minimum-covariance-determinant estimate
for its language and source: from three starts (medians and median deviations; the moments of all rows; those of the
half that is nearest the medians in its farthest statistic) concentration steps, each the moments of the CORE of the
rows that is nearest by the last, run until its determinant stands still; a start that has come to rest takes no further
part. (From RANKS rows on quantiles are exact to a RANKSth of the ranks only, and cores never quite stand still: there a
determinant whose logarithm moves by no more than STILL is at rest.) The start with the smallest determinant is kept, and its moments are taken once more from all rows within the quantile REWEIGHT. A document is rejected if its
squared Mahalanobis distance exceeds the chi-square quantile CUT.

A variance below the square of a statistic's least deviation is raised to it: of symbols, repeated lines and repeated
words most documents have none, and the covariance of the core would be singular. Every group of LEAST rows (five for
each statistic) has its own estimate; with fewer none exists, and its language's stands in, or that of all documents,
as the column level tells.

Every step is an aggregation, combined before the shuffle, of all groups and starts at once, and is written as a table
of a row for each. The rows themselves stay where they are: estimates are broadcast if there are few enough groups (a
count decides), and otherwise joined.

Windows are found within a document's own row: window hashes (64 bits) are sorted with their positions, equal
neighbours are repeats, and the words covered are counted from the sorted positions; nothing is exploded.

Null or empty text: no words, base_failed. Null lang or source: a group of its own. Null doc_id: kept. Very long texts:
an array of a word or a window's hash and place each, in the row. Ties: rows at the distance of the core's last belong
to the core, a document at the cut is kept, and of equal determinants the first start's. Repeated rows: each alike.
Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, sized, written

CORE, STEPS, RANKS, STILL, REWEIGHT, CUT = 0.75, 40, 10000, 1e-4, 0.975, 0.9999
#: name, least deviation: the last three can each pass the cut (a distance of 5.07) alone within the base rules (x_lines
#: is at most log 11, x_repeats log 6), while one line of three that is repeated is no outlier
STATISTICS = (("x_words", 0.05), ("x_word_length", 0.05), ("x_symbols", 0.25), ("x_lines", 0.4), ("x_repeats", 0.33))
LEAST, STARTS = 5 * len(STATISTICS), 3
_WHITE = r"[\x20\x09-\x0D]+"


def chi_square(p: float, k: int) -> float:
    """Quantile of a chi-square distribution with k degrees of freedom."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_square_cdf(mid, k) < p else (low, mid)
    return low


def _chi_square_cdf(x: float, k: int) -> float:
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-17:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("t"))
    rows = rows.select("doc_id", "lang", "source", F.filter(F.split("t", _WHITE), lambda w: w != "").alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"))
    rows = rows.select(
        "doc_id", "lang", "source", "n_symbols", F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") > 3, F.sort_array(F.transform(F.slice("w", F.lit(1), F.size("w") - 2), lambda x, i: F.struct(F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))))).alias("windows"),
    )
    same = lambda a, b: F.get("windows", a)["h"] == F.get("windows", b)["h"]
    again = F.filter("windows", lambda x, k: (F.coalesce(x["h"] == F.get("windows", k - 1)["h"], F.lit(False))) | (F.coalesce(x["h"] == F.get("windows", k + 1)["h"], F.lit(False))))
    rows = rows.withColumn("again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate("again", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")), lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows", "again")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def statistics(counts: DataFrame) -> DataFrame:
    """counts with the transformed statistics."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counts.withColumns({
        "x_words": F.log1p("n_words"),
        "x_word_length": F.col("word_chars") / words,
        "x_symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "x_lines": F.log1p(10 * F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
        "x_repeats": F.log1p(10 * F.col("n_repeat_words") / words),
    })


_NAMES = [n for n, _ in STATISTICS]
_P = len(STATISTICS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


_MEANS = [f"m{i}" for i in range(_P)]
_FACTOR = [f"l{i}_{j}" for i, j in _PAIRS]


def _with_cholesky(moments: DataFrame, keys: list[str], scale: float = 1.0) -> DataFrame:
    """m0.., c_ij (covariance) -> m0.., l_ij (the Cholesky factor of scale times it, no variance below the least), each
    a column, and det, the logarithm of the determinant."""
    factor = []
    for i, j in _PAIRS:
        c = f"(c{i}_{j} * {scale!r}D)" if i != j else f"greatest(c{i}_{j} * {scale!r}D, {STATISTICS[i][1] ** 2!r}D)"
        rest = " - ".join([c, *(f"l{i}_{k} * l{j}_{k}" for k in range(j))])
        # of its own variance a thousandth at least is not the others'
        factor.append(f"sqrt(greatest({rest}, {c} * 1e-3D)) AS l{i}_{j}" if i == j else f"({rest}) / l{j}_{j} AS l{i}_{j}")
    det = " + ".join(f"2 * ln(l{i}_{i})" for i in range(_P))
    return moments.selectExpr(*keys, *_MEANS, *factor, f"{det} AS det")  # each entry refers to those before it


def _distances(rows: DataFrame, estimate: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """rows (how left: also those of groups without one) for each estimate of their group, with its columns other than means and factors, and d2: the squared
    Mahalanobis distance, by forward substitution, each solved coordinate a column. small: of few enough rows."""
    z = [f"({' - '.join([f'{_NAMES[i]} - m{i}', *(f'l{i}_{k} * z{k}' for k in range(i))])}) / l{i}_{i} AS z{i}" for i in range(_P)]
    d2 = " + ".join(f"z{i} * z{i}" for i in range(_P))
    others = [c for c in estimate.columns if c not in ("grp", "det", *_MEANS, *_FACTOR)]
    out = rows.join(F.broadcast(estimate) if small else estimate, "grp", how)
    return out.selectExpr(*rows.columns, *others, *z, f"{d2} AS d2").drop(*[f"z{i}" for i in range(_P)])


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and covariances of each group's rows."""
    covs = [f"coalesce(covar_pop({_NAMES[i]}, {_NAMES[j]}), 0D) AS c{i}_{j}" for i, j in _PAIRS]
    return rows.groupBy(*keys).agg(*[F.expr(f"avg({n}) AS m{i}") for i, n in enumerate(_NAMES)], *map(F.expr, covs))


def consistency(core: float) -> float:
    """The covariance of the nearest core of normal rows, times this, is that of all."""
    return core / _chi_square_cdf(chi_square(core, _P), _P + 2)


def _quantile(column: Column | str, p: float) -> Column:
    """The smallest value that a share p of the rows does not exceed (its rank to a RANKSth)."""
    return F.percentile_approx(column, p, RANKS)


def _told(table: DataFrame, name: str, rows: int) -> DataFrame:
    """A table of about so many rows of a few numbers, written in as many files as it needs."""
    return written(table.coalesce(1 + rows // 500) if rows <= BROADCAST_ROWS else table, name)


def _few(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def _starts(rows: DataFrame, med: DataFrame, n: int) -> DataFrame:
    """grp, start, m*, l*, det, from the medians of n groups."""
    off = [F.abs(F.col(n) - F.col(f"m{i}")) for i, n in enumerate(_NAMES)]
    spread = rows.join(_few(med, n), "grp").groupBy("grp").agg(*[_quantile(o, 0.5).alias(f"a{i}") for i, o in enumerate(off)])
    spread = _told(spread.join(_few(med, n), "grp").select("grp", *_MEANS, *[F.greatest(F.col(f"a{i}") * 1.4826, F.lit(STATISTICS[i][1])).alias(f"s{i}") for i in range(_P)]), "deviations", n)
    by_median = spread.select("grp", *_MEANS, *[(F.pow(f"s{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _PAIRS])
    farthest = F.greatest(*[o / F.col(f"s{i}") for i, o in enumerate(off)])
    far = rows.join(_few(spread, n), "grp").select("grp", *_NAMES, farthest.alias("far"))
    half = _told(far.groupBy("grp").agg(_quantile("far", 0.5).alias("half")), "half", n)
    inner = far.join(_few(half, n), "grp").filter("far <= half")
    told = [x.withColumn("start", F.lit(k)) for k, x in enumerate((by_median, _moments(rows, ["grp"]), _moments(inner, ["grp"])))]
    return _with_cholesky(told[0].unionByName(told[1]).unionByName(told[2]), ["grp", "start"])


def estimates(rows: DataFrame) -> tuple[DataFrame, bool]:
    """grp, m*, l*, det: the estimate of each group of a written table of statistics with grp; and whether they are few
    enough to be broadcast."""
    keys, scale = ["grp", "start"], consistency(CORE)
    med = written(rows.groupBy("grp").agg(*[_quantile(n, 0.5).alias(f"m{i}") for i, n in enumerate(_NAMES)], F.when(F.count("*") < RANKS, 1e-9).otherwise(STILL).alias("still")), "medians")
    groups = med.count()
    n = STARTS * groups
    small, found = n <= BROADCAST_ROWS, [*_MEANS, *_FACTOR, "det"]
    begin = _starts(rows, med.drop("still"), n).join(_few(med.select("grp", "still"), groups), "grp")
    estimate = _told(begin.withColumn("live", F.lit(True)), "estimate", n)
    for _ in range(STEPS):
        live = estimate.filter("live").select(*keys, *found)
        far = _distances(rows, live, small).groupBy(*keys).agg(_quantile("d2", CORE).alias("q"))
        core = _distances(rows, live.join(_few(far, n), keys), small).filter("d2 <= q")
        was = estimate.filter("live").select(*keys, "still", F.col("det").alias("was"))
        now = _with_cholesky(_moments(core, keys), keys, scale).join(_few(was, n), keys)
        moved = now.withColumn("live", F.abs(F.col("det") - F.col("was")) > F.col("still")).drop("was")
        estimate = _told(moved.unionByName(estimate.filter(~F.col("live"))), "estimate", n)
        if estimate.filter("live").isEmpty():
            break
    # starts that end at the same rows differ by rounding alone
    best = F.min_by(F.struct(*_MEANS, *_FACTOR, "det"), F.struct(F.round("det", 6), "start"))
    estimate = _told(estimate.groupBy("grp").agg(best.alias("e")).select("grp", "e.*"), "estimate", groups)
    near = _distances(rows, estimate, small).filter(F.col("d2") <= chi_square(REWEIGHT, _P))
    return _told(_with_cholesky(_moments(near, ["grp"]), ["grp"], consistency(REWEIGHT)), "estimate", groups), small


def with_groups(stats: DataFrame) -> DataFrame:
    """stats with grp, that of the estimate used, and level: group (language and source), language or all, by how many
    rows have passed the base rules."""
    lang, source = F.coalesce("lang", F.lit("\x00")), F.coalesce("source", F.lit("\x00"))
    pair, single = F.concat(F.lit("2"), lang, F.lit("\x01"), source), F.concat(F.lit("1"), lang)
    n = written(stats.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    by_pair = n.filter(F.col("n") >= LEAST).select(pair.alias("pair"), F.lit(True).alias("own"))
    by_lang = n.groupBy("lang").agg(F.sum("n").alias("n_lang")).filter(F.col("n_lang") >= LEAST).select(single.alias("single"), F.lit(True).alias("of_lang"))
    pairs = n.count()
    by_pair, by_lang = _few(by_pair, pairs), _few(by_lang, pairs)
    out = stats.withColumn("pair", pair).withColumn("single", single).join(by_pair, "pair", "left").join(by_lang, "single", "left")
    grp = F.when(F.col("own"), F.col("pair")).when(F.col("of_lang"), F.col("single")).otherwise(F.lit(""))
    level = F.when(F.col("own"), "group").when(F.col("of_lang"), "language").otherwise("all")
    return out.withColumn("grp", grp).withColumn("level", level).drop("pair", "own", "of_lang")


def apply_rules(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2, level."""
    rows = written(with_groups(statistics(written(word_counts(docs), "counts"))), "statistics")
    passed = rows.filter(~F.col("base_failed"))
    # a row of a small group also counts towards its language's and the whole table's estimate, where one is used
    needed = written(rows.select("grp").distinct(), "groups")
    used = passed.select(F.explode(F.array_distinct(F.array("grp", "single", F.lit("")))).alias("grp"), *_NAMES)
    estimate, small = estimates(written(used.join(sized(needed), "grp", "left_semi"), "used"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    far = _distances(rows.select(*base, "level", "grp", *_NAMES), estimate, small, "left")
    # without any row that passes there is no estimate, and nothing to be kept
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi_square(cut, _P))
    return far.select(*base, kept.alias("kept"), F.col("d2").alias("distance2"), "level")
