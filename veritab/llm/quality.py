"""Quality rules: base rules, then robust multivariate outliers by the minimum covariance determinant.

Everything here is DataFrame and SQL functions. Each document gets a vector of transformed statistics; for each language and
source, concentration steps look for the half of the rows whose covariance has the least determinant, until no determinant changes
any more. The estimate is made anew from the rows near that half, and rows far from its centre by Mahalanobis distance are rejected.

Small groups: moments of n rows are averaged with those of their language with weights n and PRIOR, and those of a
language likewise with those of all rows. The weight is continuous in n, so no size changes the rule. FLOORS are standard deviations that are added
to every covariance; they keep statistics that hardly vary (few documents have symbols or repeated lines) from rejecting the first
document that differs. With them, a document differs by 5.6 floors at least before it is rejected for one statistic alone.

Defined results: a null text has no words (base_failed); null lang or source is a group of its own; rows are judged one by one, so
repeated ids and ties stay as they are; an empty table gives an empty result; other columns pass through `keep` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch, written

WS = r"[ \\x09-\\x0D]"
DIMS = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
#: Standard deviations that are added to the estimates: below such a spread a statistic does not count as varying.
FLOORS = (0.6, 0.12, 0.25, 0.3, 0.2)
#: Share of a group's rows whose covariance is sought: half of them stand most junk.
CORE = 0.5
#: The last estimate is that of the rows with squared distances up to the chi-square quantile for 5 dimensions at NEAR.
NEAR, NEAR_CUT = 0.975, 12.8325
#: Squared distances beyond this are outliers: the chi-square quantile for 5 dimensions at 1 - 1e-5.
CUT = 30.86
#: Rows that a group's language, or a language's whole table, counts as in the group's moments.
PRIOR = 50
#: Concentration steps at most, and the change of a log determinant below which a group counts as settled.
STEPS, SETTLED = 8, 1e-2
#: Estimates that are broadcast at most: of about 300 bytes each.
BROADCAST_GROUPS = 100_000
_BINS = 16


def _let(df: DataFrame, **cols: str | Column) -> DataFrame:
    """Adds columns behind a generator, so that the optimizer does not copy their expressions into later ones."""
    made = F.struct(*[(F.expr(c) if isinstance(c, str) else c).alias(k) for k, c in cols.items()])
    return df.select("*", F.inline(F.array(made)))


def statistics(docs: DataFrame) -> DataFrame:
    """docs, its columns as _o0, _o1, ..., with the counts of the base rules, base_failed and the vector x1 .. x5."""
    own = [f"_o{i}" for i in range(len(docs.columns))]
    d = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(docs.columns, own)], F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    d = _let(d, _w=f"filter(split(_t, '{WS}+'), x -> x <> '')")
    d = _let(d, _n="size(_w)", _g="zip_with(zip_with(_w, slice(_w, 2, greatest(size(_w), 1)), (a, b) -> xxhash64(a, b)), slice(_w, 3, greatest(size(_w), 1)), (h, c) -> if(c is null, null, xxhash64(h, c)))", _l=f"filter(split(_t, '\\n'), x -> x rlike '[^ \\\\x09-\\\\x0D]')")
    d = d.drop("_w")
    d = _let(d, _u="array_distinct(_g)", _lines="size(_l)", _dup="size(_l) - size(array_distinct(_l))")
    # the null that ends _g is one more distinct value whenever it is there, so equal sizes mean that no window repeats
    d = _let(
        d,
        _s="if(_n < 4 or size(_u) = _n - 2 + 1, array(), array_sort(filter(transform(_g, (h, i) -> struct(h, i)), x -> x.h is not null)))",
    ).drop("_g", "_u", "_l")
    d = _let(d, _p="array_sort(transform(filter(zip_with(zip_with(_s, concat(array(null), _s), (a, b) -> struct(a.h as h, a.i as i, a.h = b.h as e)), slice(_s, 2, greatest(size(_s), 1)), (a, b) -> struct(a.i as i, coalesce(a.e, false) or coalesce(a.h = b.h, false) as e)), x -> x.e), x -> x.i))").drop("_s")
    d = _let(
        d,
        n_words="cast(_n as bigint)",
        word_chars="cast(length(translate(_t, ' \\t\\n\\u000B\\u000C\\r', '')) as bigint)",
        n_symbols="cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as bigint)",
        n_dup_lines="cast(_dup as bigint)",
        n_repeat_words="aggregate(zip_with(_p, slice(_p, 2, greatest(size(_p), 1)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x)",
    )
    d = _let(
        d,
        base_failed="n_words < 50 or 100 * n_repeat_words > 50 * n_words",
        x1="ln(1D + n_words)",
        x2="ln(1D + word_chars / greatest(n_words, 1))",
        x3="ln(1D + 100D * n_symbols / greatest(word_chars, 1))",
        x4="n_dup_lines / greatest(_lines, 1)",
        x5="n_repeat_words / greatest(n_words, 1)",
    )
    return d.select(*own, *COUNTS, *[f"x{i}" for i in range(1, DIMS + 1)])


def _of(docs: DataFrame, column: str, otherwise: str | None = None) -> Column:
    """A column of docs in the statistics of docs."""
    c = F.col(f"_o{docs.columns.index(column)}")
    return c if otherwise is None else F.coalesce(c, F.lit(otherwise))


def _groups(s: DataFrame) -> DataFrame:
    """The rows of s, each once for its own group, its language and all rows: the levels at which estimates are made."""
    return s.select("*", F.explode(F.array(_name("s"), _name("l"), F.lit("a"))).alias("g"))


def _name(level: str) -> Column:
    return F.concat_ws("\x01", F.lit("s"), "lang", "source") if level == "s" else F.concat_ws("\x01", F.lit("l"), "lang")


def _tri() -> list[tuple[int, int]]:
    return [(i, j) for i in range(1, DIMS + 1) for j in range(1, i + 1)]


_SUMS = ["n", *[f"s{i}" for i in range(1, DIMS + 1)], *[f"s{i}{j}" for i, j in _tri()]]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n, sums s1.. and sums of products s11.. of each group."""
    sums = [F.count(F.lit(1)).cast("double").alias("n")] + [F.sum(f"x{i}").alias(f"s{i}") for i in range(1, DIMS + 1)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in _tri()]
    return rows.groupBy(*keys).agg(*sums)


def _estimates(p: DataFrame, keys: list[str]) -> DataFrame:
    """Means m1.., lower Cholesky factor l11.. and log determinant of the covariance of each row of moments."""
    p = _let(p, **{f"m{i}": f"s{i} / n" for i in range(1, DIMS + 1)})
    p = _let(p, **{f"c{i}{j}": f"greatest(s{i}{j} / n - m{i} * m{j}, {0.0 if i == j else -1e9}D)" + (f" + {FLOORS[i - 1] ** 2!r}D" if i == j else "") for i, j in _tri()})
    for j in range(1, DIMS + 1):
        before = "".join(f" - pow(l{j}{k}, 2)" for k in range(1, j))
        p = _let(p, **{f"l{j}{j}": f"sqrt(greatest(c{j}{j}{before}, 1e-9D))"})
        if j < DIMS:
            p = _let(p, **{f"l{i}{j}": f"(c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(1, j)) + f") / l{j}{j}" for i in range(j + 1, DIMS + 1)})
    return p.select(*keys, "n", *[f"m{i}" for i in range(1, DIMS + 1)], *[f"l{i}{j}" for i, j in _tri()], F.expr(" + ".join(f"2 * ln(l{i}{i})" for i in range(1, DIMS + 1))).alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the estimate in the row: a forward substitution."""
    for i in range(1, DIMS + 1):
        df = _let(df, **{f"y{i}": f"(x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(1, i)) + f") / l{i}{i}"})
    return df.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in range(1, DIMS + 1)))).drop(*[f"y{i}" for i in range(1, DIMS + 1)])


def _few(df: DataFrame) -> DataFrame:
    """df (written), to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def measured(docs: DataFrame, keys: list[str], keep: Scratch | None = None) -> DataFrame:
    """The statistics of docs with the columns `keys`, written: numbers only, so texts are read and cut into words once."""
    used = docs.select(*dict.fromkeys([*keys, "text", "lang", "source"]))
    s = statistics(used).select(*[_of(used, k).alias(k) for k in keys], _of(used, "lang", "\x02").alias("_lang"), _of(used, "source", "\x02").alias("_source"), *COUNTS, *[f"x{i}" for i in range(1, DIMS + 1)])
    return keep.written(s, "rows") if keep else written(s, "mcd-rows")


def fit(rows: DataFrame, steps: int = STEPS, core: float = CORE, prior: float = PRIOR) -> DataFrame:
    """The estimate for each language and source of rows (as of `measured`): columns _lang, _source, m1.., l11.., and steps, how many were taken.

    Two starts, all rows and the rows without symbols and repetition, take concentration steps until every log determinant is settled or `steps` are
    taken; the one with the lesser determinant wins, and rows near it give the last estimate (with no steps there is none). Order statistics come from
    histograms of the distance on a fixed logarithmic grid, so a group of any size meets as a bounded number of counts.
    """
    keep = Scratch(rows.sparkSession, "mcd")
    s = rows.where("not base_failed").select(F.col("_lang").alias("lang"), F.col("_source").alias("source"), *[f"x{i}" for i in range(1, DIMS + 1)])
    level = keep.written(s.select("lang", "source").distinct().select("lang", "source", _name("s").alias("gs"), _name("l").alias("gl"), F.lit("a").alias("ga")), "levels")
    grouped = keep.written(_groups(s).select("g", *[f"x{i}" for i in range(1, DIMS + 1)]), "grouped")
    starts = grouped.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("start")).where("start = 0 or (x3 < 0.1 and x4 < 0.1 and x5 < 0.2)")
    p = keep.written(_estimates(_moments(starts, ["g", "start"]), ["g", "start"]), "start")
    taken = 0
    while taken < steps:
        d = _distance(grouped.join(_few(p), "g")).withColumn("bin", F.expr(f"cast(floor(log2(d2 + 1e-6D) * {_BINS}) as int)"))
        upto = Window.partitionBy("g", "start").orderBy("bin")
        of_all = Window.partitionBy("g", "start")
        # rows of a bin are summed with it: the cut is then a choice among sums, and rows are read once a step
        bins = _moments(d, ["g", "start", "bin"]).select("*", (F.sum("n").over(upto) - F.col("n")).alias("below"), F.sum("n").over(of_all).alias("n_all"))
        within = bins.where((F.col("below") < (F.col("n_all") + DIMS + 1) * core) & (F.col("below") < F.col("n_all")))
        sums = within.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in _SUMS])
        after = keep.written(_estimates(sums, ["g", "start"]), "step")
        taken += 1
        moved = after.select("g", "start", "logdet").join(p.select("g", "start", F.col("logdet").alias("was")), ["g", "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("was")))).first()[0]
        p = after
        if moved is None or moved < SETTLED:
            break
    best = p.groupBy("g").agg(F.min(F.struct("logdet", "start", *[f"m{i}" for i in range(1, DIMS + 1)], *[f"l{i}{j}" for i, j in _tri()])).alias("b")).select("g", "b.*")
    near = grouped
    if steps:
        near = _distance(grouped.join(_few(keep.written(best, "best")), "g")).where(F.col("d2") / consistency(core) <= NEAR_CUT)
    m = keep.written(_moments(near, ["g"]), "moments")
    of = lambda name: m.select(F.col("g").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in _SUMS])
    j = level.join(_few(of("gs")), "gs").join(_few(of("gl")), "gl").join(_few(of("ga")), "ga")
    # each level's moments, and those of the next one as `prior` rows more
    j = _let(j, **{f"up_{c}": f"gl_{c} + {float(prior)!r}D * ga_{c} / ga_n" for c in _SUMS})
    j = _let(j, **{c: f"gs_{c} + {float(prior)!r}D * up_{c} / up_n" for c in _SUMS})
    out = _estimates(j.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *_SUMS), ["_lang", "_source"])
    out = written(out.drop("n", "logdet").withColumn("steps", F.lit(taken)), "mcd-fit")
    keep.drop()
    return out


def consistency(core: float = CORE) -> float:
    """What the core's covariance is multiplied by to estimate that of all rows, were they Gaussian in 5 dimensions."""
    lo, hi = 0.0, 60.0
    # chi-square with 5 and 7 degrees of freedom in closed form
    erf = lambda q: math.erf(math.sqrt(q / 2))
    five = lambda q: erf(q) - math.sqrt(2 * q / math.pi) * math.exp(-q / 2) * (1 + q / 3)
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if five(mid) < core else (lo, mid)
    seven = five(lo) - math.sqrt(2 * lo / math.pi) * math.exp(-lo / 2) * lo * lo / 15
    return core / seven


def _verdict(rows: DataFrame, estimates: DataFrame, cut: float) -> DataFrame:
    """Adds d2 and kept to rows with _lang, _source and the statistics."""
    j = _distance(rows.join(_few(estimates.drop("steps")), ["_lang", "_source"], "left"))
    far = F.coalesce(F.col("d2") / consistency(NEAR) > cut, F.lit(False))
    return j.withColumn("kept", ~F.col("base_failed") & ~far)


def report(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """For each row of docs (doc_id, text, lang, source): doc_id, the counts, base_failed, kept and d2."""
    rows = measured(docs, ["doc_id"])
    return _verdict(rows, fit(rows), cut).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def keep(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of docs that are kept, with their columns. Rows are written with their statistics, so texts are cut into words once and never shuffled."""
    s = statistics(docs).withColumn("_lang", _of(docs, "lang", "\x02")).withColumn("_source", _of(docs, "source", "\x02"))
    s = written(s, "quality-rows")
    return _verdict(s.where("not base_failed"), fit(s), cut).where("kept").select(*[_of(docs, c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def base_query(spark, sf_dir: str) -> DataFrame:
    """The counts and base rules alone, which SQL can express."""
    return query(spark, sf_dir).drop("kept", "d2")


_WORD = r"[^\x20\x09-\x0D]"
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 2], ' ')) AS k FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE k > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
 FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
