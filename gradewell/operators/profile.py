"""Profiles of wide feature tables.

Everything about a column that can be merged is taken in one wide aggregation and then turned into
one row per feature. Exact quantiles are found digit by digit from counts; dominant values from approximate medians, which
a second pass counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewell import constants as K
from gradewell.functions.numeric import finite
from gradewell.operators.ordering import cumulative_by_value
from gradewell.session import settle, store

QUANTILE_ACCURACY = 10_000


def feature_rows(aggregated: DataFrame, by: Sequence[str], features: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns ``<feature>__<name>`` as one row per feature with columns ``<name>``."""
    rows = [F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}__{n}`").alias(n) for n in names]) for f in features]
    return aggregated.select(*by, F.inline(F.array(*rows)))


def column_profile(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of missing, NaN and infinite cells, range and moments per feature, in one pass."""
    prepared = df.select(*by, *[F.col(f).cast("double").alias(f) for f in features]).select(
        "*", *[finite(F.col(f)).alias(f"{f}__clean") for f in features])
    aggregates = []
    for f in features:
        raw, clean = F.col(f), F.col(f"{f}__clean")
        aggregates += [
            F.count(raw).alias(f"{f}__raw"), F.count(clean).alias(f"{f}__n"), F.count_if(F.isnan(raw)).alias(f"{f}__nan"),
            F.min(clean).alias(f"{f}__minimum"), F.max(clean).alias(f"{f}__maximum"),
            F.avg(clean).alias(f"{f}__mean"), F.var_pop(clean).alias(f"{f}__var_pop"),
        ]
    grouped = prepared.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), *aggregates)
    stored = feature_rows(grouped.withColumns({f"{f}___rows": F.col("_rows") for f in features}), by, features,
                          ["_rows", "raw", "n", "nan", "minimum", "maximum", "mean", "var_pop"])
    n = F.col("n")
    return stored.select(
        *by, "feature", F.col("_rows").alias("n_rows"), "n", (F.col("_rows") - F.col("raw")).alias("n_null"),
        F.col("nan").alias("n_nan"), (F.col("raw") - F.col("nan") - n).alias("n_inf"), "minimum", "maximum",
        F.greatest(F.abs("minimum"), F.abs("maximum")).alias("max_abs"), "mean", "var_pop",
        F.when(n > 1, F.col("var_pop") * n / (n - 1)).alias("var_samp"))


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned 64-bit numbers in the same order; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def double_of(key: int) -> float:
    """The double that :func:`ordered_bits` turns into ``key``."""
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def exact_quantiles(df: DataFrame, features: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (feature, q, value); NULLs are ignored.

    ``percentile`` would gather every distinct value of a column in one task. Here the answers are found digit by
    digit: four passes count the cells per 16 bits of an order-preserving code, each only the cells that agree
    with an answer so far. What a task holds and sends does not grow with the rows, whatever the values. ``df`` is read
    four times. A column without values gives NULL.
    """
    found = quantiles_without(df, features, probabilities)
    rows = [(f, float(q), found[(None, f, float(q))]) for f in features for q in probabilities]
    return df.sparkSession.createDataFrame(rows, "feature string, q double, value double")


def quantiles_without(df: DataFrame, features: Sequence[str], probabilities: Sequence[float], part: str | None = None, parts: Sequence = (None,),
                      left_out: Sequence = (None,), filled: Mapping[tuple, tuple[float, int]] | None = None) -> dict[tuple, float | None]:
    """Quantiles as of :func:`exact_quantiles` of the rows outside each part ``left_out`` (None: of all parts), by (part, feature, q).

    A pass counts every row once, for its part; the counts without a part are those of all others. ``filled`` may add, by
    (part left out, feature), a number of cells of one value.
    """
    features, probabilities, parts = list(features), [float(q) for q in probabilities], list(parts)
    columns = [finite(F.col(f).cast("double")).alias(f"_{i}") for i, f in enumerate(features)]
    place = F.array_position(F.array(*[F.lit(p) for p in parts]), F.col(part)) - 1 if part else F.lit(0)
    cells = df.select(*columns, place.cast("int").alias("_part"))
    if part:
        cells = cells.filter("_part >= 0")
    without = [None if g is None else parts.index(g) for g in left_out]
    extra = {(w, features.index(f)): (int(ordered_bits(np.array([v], np.float64))[0]), n)
             for w, g in enumerate(left_out) for f in features for v, n in [(filled or {}).get((g, f), (0.0, 0))] if n}
    # Per feature and answer (two ranks per quantile and part left out) the leading bits and the rank among the cells that share them.
    heads = {(i, (w, a)): 0 for i in range(len(features)) for w in range(len(without)) for a in range(2 * len(probabilities))}
    ranks: dict[tuple, int] = {}
    sizes: dict[tuple[int, int], int] = {}
    for step in range(4):
        shift = 48 - 16 * step
        found = {(r["feature"], (r["left_out"], r["answer"])): r for r in next_digits(cells, len(parts), without, extra, heads, ranks, probabilities, shift).collect()}
        known, heads_before, ranks_before = {}, heads, ranks
        heads, ranks = {}, {}
        for key, head in heads_before.items():
            i, (w, _) = key
            if key in found:
                heads[key], ranks[key] = head << 16 | found[key]["digit"], found[key]["rank"]
                known[(w, i)] = found[key]["n"]
            elif (w, i) in extra:  # only added cells are left, all of one value
                heads[key], ranks[key] = extra[(w, i)][0] >> shift, ranks_before.get(key, 0)
                known[(w, i)] = extra[(w, i)][1]
        if step == 0:
            sizes = known
        if not heads:
            break
    out: dict[tuple, float | None] = {}
    for i, f in enumerate(features):
        for w, g in enumerate(left_out):
            for j, q in enumerate(probabilities):
                value = None
                if sizes.get((w, i)):
                    position = q * (sizes[(w, i)] - 1)
                    low, high = (double_of(heads[(i, (w, 2 * j + k))]) for k in (0, 1))
                    value = float(low + (high - low) * (position - np.floor(position)))
                out[(g, f, q)] = value
    return out


def next_digits(cells: DataFrame, parts: int, without: Sequence[int | None], extra: Mapping[tuple[int, int], tuple[int, int]], heads: Mapping[tuple, int],
                ranks: Mapping[tuple, int], probabilities: Sequence[float], shift: int) -> DataFrame:
    """The 16 bits above ``shift`` of every answer, its rank among the cells that share them, and n, the cells that shared ``heads``.

    Without ``ranks`` these are the lower and upper neighbour of each quantile among all cells of a feature.
    """
    known = {i: np.unique(np.array([h for (f, _), h in heads.items() if f == i], np.uint64)) for i in sorted({f for f, _ in heads})}
    answers: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for (i, wanted), head in heads.items():
        answers.setdefault((i, int(np.searchsorted(known[i], np.uint64(head)))), []).append(wanted)

    def counts_of(i: int, values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        head = values >> 16
        return pa.RecordBatch.from_pydict({"feature": np.full(len(n), i, np.int32), "part": (head % parts).astype(np.int32), "head": (head // parts).astype(np.int32),
                                           "digit": (values & 0xFFFF).astype(np.int32), "n": n})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros(parts << 16, np.int64) for i in known} if shift == 48 else {}
        waiting: dict[int, list[np.ndarray]] = {i: [] for i in known}

        def compact(i: int) -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(waiting[i]), return_counts=True)
            waiting[i].clear()
            return counts_of(i, values, n)

        for batch in batches:
            part = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, head in known.items():
                column = batch.column(i)
                ours = part[column.is_valid().to_numpy(zero_copy_only=False)] if column.null_count else part
                keys = ordered_bits(column.drop_null().to_numpy(zero_copy_only=False))
                digit = (keys >> np.uint64(shift) & np.uint64(0xFFFF)).astype(np.int64)
                if shift == 48:
                    np.add.at(sums[i], (ours << 16) + digit, 1)
                    continue
                leading = keys >> np.uint64(shift + 16)
                at = np.minimum(np.searchsorted(head, leading), len(head) - 1)
                inside = head[at] == leading
                waiting[i].append(((at[inside] * parts + ours[inside]) << 16) + digit[inside])
                if len(waiting[i]) >= 50:
                    yield compact(i)
        for i, values in sums.items():
            hit = np.flatnonzero(values)
            yield counts_of(i, hit, values[hit])
        for i in known:
            if waiting[i]:
                yield compact(i)

    def pick(table: pa.Table) -> pa.Table:
        i, head = table.column("feature")[0].as_py(), table.column("head")[0].as_py()
        digits, at = np.unique(table.column("digit").to_numpy(), return_inverse=True)
        held = np.zeros((parts, len(digits)), np.int64)
        held[table.column("part").to_numpy(), at] = table.column("n").to_numpy()
        everything, out = held.sum(axis=0), []
        for w, a in answers[(i, head)]:
            digit, n = digits, everything if without[w] is None else everything - held[without[w]]
            bits, more = extra.get((w, i), (0, 0))
            if more and (shift == 48 or bits >> (shift + 16) == int(known[i][head])):
                added = bits >> shift & 0xFFFF
                to = int(np.searchsorted(digit, added))
                if to == len(digit) or digit[to] != added:
                    digit, n = np.insert(digit, to, added), np.insert(n, to, 0)
                n = n + more * (digit == added)
            upto = np.cumsum(n)
            total = int(upto[-1])
            if not total:
                continue
            position = probabilities[a // 2] * (total - 1)
            rank = ranks[(i, (w, a))] if ranks else int(np.ceil(position) if a % 2 else np.floor(position))
            to = int(np.searchsorted(upto, rank, "right"))
            out.append((i, w, a, int(digit[to]), rank - (int(upto[to - 1]) if to else 0), total))
        names = ["feature", "left_out", "answer", "digit", "rank", "n"]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=names)

    counts = cells.mapInArrow(count, "feature int, part int, head int, digit int, n bigint").groupBy("feature", "part", "head", "digit").agg(F.sum("n").alias("n"))
    return counts.groupBy("feature", "head").applyInArrow(pick, "feature int, left_out int, answer int, digit int, rank bigint, n bigint")


def medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median per feature, 0 for a column without values."""
    return exact_quantiles(df, features, [0.5]).select("feature", F.coalesce("value", F.lit(0.0)).alias("median"))


def fill_medians(df: DataFrame, features: Sequence[str], fitted: DataFrame) -> DataFrame:
    """Replace missing and non-finite cells by the fitted medians (one value per feature)."""
    values = {row["feature"]: row["median"] for row in fitted.collect()}
    return df.withColumns({f: F.coalesce(finite(F.col(f).cast("double")), F.lit(float(values[f]))) for f in features})


def dominant_shares(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share of the most frequent value per feature among its non-missing rows; NULL where no value has over half of them.

    A value held by more than half of the rows is also the median, up to the error of the
    approximation; counting that one candidate gives its exact share.
    """
    candidates = df.agg(*[
        F.percentile_approx(finite(F.col(f).cast("double")), 0.5, QUANTILE_ACCURACY).alias(f) for f in features]).first()
    counted = df.agg(*[
        F.count_if(F.col(f).cast("double") == candidates[f]).alias(f"{f}__top") if candidates[f] is not None
        else F.lit(0).cast("bigint").alias(f"{f}__top") for f in features
    ], *[F.count(finite(F.col(f).cast("double"))).alias(f"{f}__n") for f in features])
    long = feature_rows(counted, [], features, ["top", "n"])
    share = F.when(F.col("n") > 0, F.col("top") / F.col("n")).otherwise(1.0)
    return long.select("feature", F.when(share > 0.5, share).alias("top_share"))


def distinct_ratio(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Distinct values / non-missing rows, exactly; meant for the few columns with a dominant value."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), finite(F.col(f).cast("double")).alias("v")) for f in features])))
    per_value = cells.filter("v is not null").groupBy("feature", "v").agg(F.count(F.lit(1)).alias("m"))
    return per_value.groupBy("feature").agg((F.count(F.lit(1)) / F.sum("m")).alias("distinct_ratio"))


def variance_audit(df: DataFrame, features: Sequence[str], variance_floor: float = 1e-8) -> DataFrame:
    """Definition 1: constant columns, and near-zero-variance ones (population variance, or few values with one dominant)."""
    profile = column_profile(df, features).select("feature", "n", "minimum", "maximum", "var_pop")
    shares = dominant_shares(df, features)
    joined = settle(profile.join(shares, "feature"))
    dominated = [r["feature"] for r in joined.filter("top_share > 0.95").collect()]
    if dominated:
        joined = joined.join(F.broadcast(distinct_ratio(df, dominated)), "feature", "left")
    else:
        joined = joined.withColumn("distinct_ratio", F.lit(None).cast("double"))
    constant = F.coalesce(F.col("minimum") == F.col("maximum"), F.lit(True))
    few = F.coalesce((F.col("distinct_ratio") < 0.01) & (F.col("top_share") > 0.95), F.lit(False))
    near = ~constant & ((F.col("var_pop") <= variance_floor) | few)
    return joined.select("feature", F.when(constant, 0.0).otherwise(F.col("var_pop")).alias("variance"),
                         constant.alias("is_constant"), near.alias("near_zero_variance"))


def filled_audit(df: DataFrame, features: Sequence[str], variance_floor: float = 1e-8, share: float = 0.995) -> DataFrame:
    """Definition 2, after median fill: sample variance, or one value in at least ``share`` of the rows."""
    filled = fill_medians(df, features, medians(df, features))
    profile = column_profile(filled, features).select("feature", "minimum", "maximum", "var_samp")
    joined = profile.join(F.broadcast(dominant_shares(filled, features)), "feature")
    constant = F.coalesce(F.col("minimum") == F.col("maximum"), F.lit(True))
    near = ~constant & ((F.col("var_samp") <= variance_floor) | F.coalesce(F.col("top_share") >= share, F.lit(False)))
    return joined.select("feature", F.col("var_samp").alias("variance"), constant.alias("is_constant"),
                         near.alias("near_constant"))


def quality_totals(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of cell counts and the range of the column variances."""
    profile = column_profile(df, features)
    spread = settle(profile.select("feature", F.when(F.col("minimum") == F.col("maximum"), 0.0)
                                   .otherwise(F.coalesce("var_pop", F.lit(0.0))).alias("variance"),
                                   "n_rows", "n_null", "n_nan", "n_inf"))
    return spread.agg(
        F.max("n_rows").alias("row_count"), F.count(F.lit(1)).alias("feature_count"),
        F.sum(F.col("n_null") + F.col("n_nan")).alias("nan_cells"), F.sum("n_inf").alias("inf_cells"),
        F.min("variance").alias("variance_min"), F.percentile("variance", 0.5).alias("variance_median"),
        F.max("variance").alias("variance_max"))


def extreme_features(df: DataFrame, features: Sequence[str], limit: float = 1e8) -> DataFrame:
    """Features with a magnitude beyond ``limit``, without variance, or with missing cells."""
    profile = column_profile(df, features)
    return profile.select("feature", (F.col("max_abs") > limit).alias("is_extreme"),
                          (F.col("var_samp") == 0).alias("zero_variance"),
                          (F.col("n_null") + F.col("n_nan")).alias("missing_cells"))


# -- relations between columns -----------------------------------------------------------------

def mean_ranks(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every column replaced by the rank of its value, ties by their mean rank; columns must be filled.

    A dictionary (column, value, rank) comes from counts per distinct value, combined on the map side and ranked over
    ranges of values. It is stored, so that Spark broadcasts a column's part when it is small; only columns with very
    many distinct values shuffle the rows.
    """
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("nr"), F.col(f).cast("double").alias("value"), F.lit(1).alias("n")) for i, f in enumerate(features)]))
    below = cumulative_by_value(df.select(cells), ["nr"], "value", ["n"])
    ranks = settle(below.select("nr", "value", (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank")))
    out = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    for i, f in enumerate(features):
        known = ranks.filter(F.col("nr") == i).select(F.col("value").alias(f), F.col("rank").alias("_rank"))
        out = out.join(known, f).withColumn(f, F.col("_rank")).drop("_rank")
    return out


def correlation_pairs(df: DataFrame, features: Sequence[str], method: str = "spearman") -> DataFrame:
    """|correlation| of every pair of features (left before right) that both vary; columns must be filled."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown correlation {method}")
    rows = store(mean_ranks(df, features)) if method == "spearman" else df
    return pairwise_pearson(rows, features).filter("correlation is not null")


def pairwise_pearson(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """|Pearson correlation| of every pair over the rows where both are present.

    Each task adds up the cross products of its rows as matrices and emits one row per pair; values
    are taken relative to the column mean, so that large offsets do not cancel.
    """
    features = list(features)
    names = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    schema = "feature_a string, feature_b string, correlation double"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    means = {r["feature"]: r["mean"] or 0.0 for r in column_profile(df, features).collect()}
    centred = df.select(*[(finite(F.col(f).cast("double")) - F.lit(means[f])).alias(f) for f in features])
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]

    def cross_products(batches):
        sums = None
        for batch in batches:
            values = batch.to_numpy(dtype="float64", na_value=np.nan)
            mask = ~np.isnan(values)
            x, m = np.where(mask, values, 0.0), mask.astype("float64")
            part = np.stack([m.T @ m, x.T @ m, m.T @ x, (x * x).T @ m, m.T @ (x * x), x.T @ x])
            sums = part if sums is None else sums + part
        if sums is not None:
            left, right = np.array(pairs).T
            cells = sums[:, left, right]
            yield pd.DataFrame({"i": left, "j": right, **{k: cells[n] for n, k in enumerate(("n", "sx", "sy", "sxx", "syy", "sxy"))}})

    partial = centred.mapInPandas(cross_products, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    total = partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    covariance = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    spread = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    name = F.array(*[F.lit(f) for f in features])
    return total.filter("n > 1").select(
        name[F.col("i")].alias("feature_a"), name[F.col("j")].alias("feature_b"),
        F.when(spread > 0, F.abs(covariance) / F.sqrt(spread)).alias("correlation"))


def feature_priority(feature: Column) -> Column:
    """0 acquisition, 1 colour, 2 texture, 3 the rest: lower classes are dropped first."""
    lower = F.lower(feature)

    def has(*tokens: str) -> Column:
        hit = F.lit(False)
        for token in tokens:
            hit = hit | lower.contains(token)
        return hit

    colour = has("color") | lower.startswith("rgb_") | lower.startswith("hsv_") | lower.startswith("lab_")
    return (F.when(has(*K.ACQUISITION_HINTS), 0).when(colour, 1).when(has("texture", "glcm", "lbp"), 2).otherwise(3))


def correlated_drops(pairs: DataFrame, variances: DataFrame, cut: float = 0.985) -> DataFrame:
    """Pairs at or above the cut with the member to drop: lower class, then lower variance, right on ties."""
    left = F.broadcast(variances.select(F.col("feature").alias("feature_a"), F.col("variance").alias("_va")))
    right = F.broadcast(variances.select(F.col("feature").alias("feature_b"), F.col("variance").alias("_vb")))
    a, b = feature_priority(F.col("feature_a")), feature_priority(F.col("feature_b"))
    drop = (F.when(a < b, F.col("feature_a")).when(a > b, F.col("feature_b"))
            .when(F.col("_va") < F.col("_vb"), F.col("feature_a")).otherwise(F.col("feature_b")))
    return pairs.filter(F.col("correlation") >= cut).join(left, "feature_a").join(right, "feature_b").select(
        "feature_a", "feature_b", "correlation", drop.alias("suggested_remove"))


def is_finding(feature: Column, word_match: bool = False) -> Column:
    """Rare finding columns by name token; ``word_match`` compares whole words, so "ma" misses "max"."""
    lower = F.lower(feature)
    hit = F.lit(False)
    for token in K.FINDING_TOKENS:
        hit = hit | (lower.rlike(f"(^|_){token}(_|$)") if word_match else lower.contains(token))
    return hit


def removed_features(audit: DataFrame, drops: DataFrame, exempt: Column | None = None) -> DataFrame:
    """Features to remove with the reason; near-constant ones under ``exempt`` are kept."""
    constant = audit.filter("is_constant").select("feature", F.lit("constant").alias("reason"))
    near = audit.filter("near_constant").select("feature", F.lit("near_constant").alias("reason"))
    if exempt is not None:
        near = near.filter(~exempt)
    flat = audit.filter("is_constant or near_constant").select("feature")
    correlated = (
        drops.select(F.col("suggested_remove").alias("feature")).distinct().join(F.broadcast(flat), "feature", "left_anti")
        .withColumn("reason", F.lit("highly_correlated_duplicate")))
    return constant.unionByName(near).unionByName(correlated)


def acquisition_risk(df: DataFrame, features: Sequence[str], label: str = "label",
                     positive_min: int = K.POSITIVE_MIN_GRADE, hinted_only: bool = True, limit: int = 20) -> DataFrame:
    """|mean of grade 0 - mean of positives| in pooled deviations, the largest ``limit`` gaps."""
    features = [f for f in features if not hinted_only or any(h in f for h in K.ACQUISITION_HINTS)]
    names = ["neg_mean", "pos_mean", "deviation"]
    aggregates = []
    for f in features:
        c = F.col(f)
        aggregates += [F.avg(F.when(F.col(label) == 0, c)).alias(f"{f}__neg_mean"),
                       F.avg(F.when(F.col(label) >= positive_min, c)).alias(f"{f}__pos_mean"),
                       F.stddev_samp(c).alias(f"{f}__deviation")]
    long = feature_rows(df.agg(*aggregates), [], features, names)
    pooled = F.when(F.col("deviation") == 0, 1.0).otherwise(F.col("deviation"))
    gap = F.abs(F.col("neg_mean") - F.col("pos_mean")) / pooled
    return long.select("feature", "neg_mean", "pos_mean", gap.alias("standardized_gap")).filter(
        "neg_mean is not null and pos_mean is not null").orderBy(F.desc("standardized_gap"), "feature").limit(limit)


def class_moments(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """Between and within sums of squares per feature, from moments per class.

    Cells are taken relative to the mean of their column: class means lie close together, and the difference of two long
    sums would lose the digits that tell them apart. ``df`` is read twice.
    """
    means = {r["feature"]: r["mean"] or 0.0 for r in column_profile(df, features).collect()}
    centred = df.select(label, *[(finite(F.col(f).cast("double")) - F.lit(means[f])).alias(f) for f in features])
    profile = column_profile(centred, features, [label]).filter("n > 0")
    flat = F.col("minimum") == F.col("maximum")  # merged moments of one value can differ from it by rounding
    per_class = profile.select("feature", label, "n", F.when(flat, F.col("minimum")).otherwise(F.col("mean")).alias("mean"),
                               F.when(flat, 0.0).otherwise(F.col("var_pop")).alias("var_pop"))
    overall = Window.partitionBy("feature")
    n = F.sum("n").over(overall)
    grand = F.sum(F.col("n") * F.col("mean")).over(overall) / n
    spread = per_class.withColumn("_between", F.col("n") * F.pow(F.col("mean") - grand, 2))
    return spread.groupBy("feature").agg(
        F.sum("_between").alias("between"), F.sum(F.col("n") * F.col("var_pop")).alias("within"),
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"))


def fisher_scores(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    return class_moments(df, features, label).select(
        "feature", (F.col("between") / F.greatest("within", F.lit(1e-9))).alias("score"))


def anova_f(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """(SSB / (k - 1)) / (SSW / (n - k)); NULL without spread inside the classes."""
    mean_between = F.col("between") / (F.col("classes") - 1)
    mean_within = F.col("within") / (F.col("n") - F.col("classes"))
    ok = (F.col("classes") > 1) & (F.col("n") > F.col("classes")) & (F.col("within") > 0)
    return class_moments(df, features, label).select("feature", F.when(ok, mean_between / mean_within).alias("score"))


def binned_mutual_information(df: DataFrame, features: Sequence[str], label: str = "label", bins: int = 10) -> DataFrame:
    """Mutual information (nats) between the label and each feature cut at its quantiles."""
    edges = exact_quantiles(df, features, [i / bins for i in range(1, bins)])
    known: dict[str, list[float]] = {}
    for row in edges.filter("value is not null").collect():
        known.setdefault(row["feature"], []).append(row["value"])
    cells = []
    for f in features:
        bin_no = F.lit(0)
        for edge in known.get(f, []):
            bin_no = bin_no + (F.col(f) > edge).cast("int")
        cells.append(F.struct(F.lit(f).alias("feature"), bin_no.alias("bin")))
    table = (df.select(label, F.inline(F.array(*cells))).filter("bin is not null")
             .groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("m")))
    whole = Window.partitionBy("feature")
    n = F.sum("m").over(whole)
    per_bin = F.sum("m").over(Window.partitionBy("feature", "bin"))
    per_label = F.sum("m").over(Window.partitionBy("feature", label))
    term = F.col("m") / n * F.log(F.col("m").cast("double") * n / (per_bin.cast("double") * per_label))
    return table.withColumn("_t", term).groupBy("feature").agg(F.sum("_t").alias("score"))


def distribution_shape(df: DataFrame, features: Sequence[str], bins: int = 16) -> DataFrame:
    """Histogram entropy (bits, equal-width bins over the range), its normalised form, skewness, excess kurtosis."""
    ranges = {r["feature"]: (r["minimum"], r["maximum"]) for r in column_profile(df, features).collect()}
    cells = []
    for f in features:
        lo, hi = ranges[f]
        if lo is None:
            continue
        if lo == hi:  # one value: the usual histogram widens the range by one half on both sides
            lo, hi = lo - 0.5, hi + 0.5
        place = F.floor((F.col(f) - lo) / (hi - lo) * bins)
        position = F.when(place.isNotNull(), F.least(place, F.lit(bins - 1)))  # least() alone skips NULL
        cells.append(F.struct(F.lit(f).alias("feature"), position.alias("bin")))
    histogram = (df.select(F.inline(F.array(*cells))).filter("bin is not null")
                 .groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("m")))
    share = F.col("m") / F.sum("m").over(Window.partitionBy("feature"))
    entropy = histogram.withColumn("_p", share).groupBy("feature").agg((-F.sum(F.col("_p") * F.log2("_p"))).alias("entropy"))
    shape = df.agg(*[a for f in features for a in (
        F.skewness(f).alias(f"{f}__skew"), F.kurtosis(f).alias(f"{f}__kurt"), F.stddev_pop(f).alias(f"{f}__std"))])
    long = feature_rows(shape, [], features, ["skew", "kurt", "std"])
    flat = F.coalesce(F.col("std") <= 1e-8, F.lit(True))
    return long.join(F.broadcast(entropy), "feature", "left").select(
        "feature", F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        (F.coalesce("entropy", F.lit(0.0)) / F.log2(F.lit(float(bins)))).alias("normalized_entropy"),
        F.when(flat, 0.0).otherwise(F.col("skew")).alias("skewness"),
        F.when(flat, 0.0).otherwise(F.col("kurt")).alias("kurtosis"))


def duplicate_columns(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """Columns with values identical to an earlier one: equal checksums first, then verified cell by cell.

    ``duplicate_of`` is the first column of the group.
    """
    sums = df.agg(*[F.sum(F.xxhash64(F.col(key), F.coalesce(F.col(f).cast("double"), F.lit(float("nan")))).cast("decimal(38,0)"))
                    .alias(f) for f in features]).first()
    groups: dict[object, list[str]] = {}
    for f in features:
        groups.setdefault(sums[f], []).append(f)
    pairs = [(g[0], other) for g in groups.values() for other in g[1:]]
    schema = "feature string, duplicate_of string"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    checks = df.agg(*[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(b).alias("feature"), F.lit(a).alias("duplicate_of"), F.col(f"d{i}").alias("_d"))
            for i, (a, b) in enumerate(pairs)]
    return checks.select(F.inline(F.array(*rows))).filter("_d = 0").drop("_d")


def version_audit(df: DataFrame, versions: dict[str, Sequence[str]], key: str) -> DataFrame:
    """Definition 3, one row per feature version: missing cells, constant, flat, duplicate and correlated columns.

    Profile, duplicate groups and correlated pairs are found once for the union of the columns and then counted per
    version. Of a group of equal columns a version holds, all but one are duplicates, whichever those are.
    """
    features = sorted({f for columns in versions.values() for f in columns})
    members = df.sparkSession.createDataFrame(
        [(v, f) for v, columns in versions.items() for f in dict.fromkeys(columns)], "feature_version string, feature string")
    profile = settle(column_profile(df, features))
    copies = settle(duplicate_columns(df, features, key))
    high = settle(pairwise_pearson(df, features).filter(F.col("correlation") > 0.995).select("feature_a", "feature_b"))
    has_value = F.col("minimum") == F.col("maximum")
    stats = members.join(profile, "feature").groupBy("feature_version").agg(
        F.count(F.lit(1)).alias("feature_count"),
        F.sum(F.col("n_null") + F.col("n_nan") + F.col("n_inf")).alias("missing_cells"),
        # A column of one value and some gaps has two distinct values here: gaps count as one.
        F.count_if((has_value & (F.col("n") == F.col("n_rows"))) | (F.col("n") == 0)).alias("constant_features"),
        F.count_if(F.sqrt("var_samp") < 1e-8).alias("near_constant_features"))
    grouped = copies.select("feature", F.col("duplicate_of").alias("group")).unionByName(
        copies.select(F.col("duplicate_of").alias("feature"), F.col("duplicate_of").alias("group")).distinct())
    copied = members.join(grouped, "feature").groupBy("feature_version", "group").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy(
        "feature_version").agg(F.sum("n").alias("duplicate_features"))
    left = members.select("feature_version", F.col("feature").alias("feature_a"))
    right = members.select("feature_version", F.col("feature").alias("feature_b"))
    correlated = high.join(left, "feature_a").join(right, ["feature_version", "feature_b"]).groupBy("feature_version").agg(
        F.count(F.lit(1)).alias("correlated_pairs"))
    return stats.join(copied, "feature_version", "left").join(correlated, "feature_version", "left").na.fill(
        0, ["duplicate_features", "correlated_pairs"])


# -- distributions over classes ----------------------------------------------------------------

def class_distribution(df: DataFrame, label: str, labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Count and share of every class, absent ones included, with the largest / smallest ratio."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(label) == k).alias(f"n_{k}") for k in labels])
    present = [F.when(F.col(f"n_{k}") > 0, F.col(f"n_{k}")) for k in labels]
    many = F.greatest(*present) if len(labels) > 1 else present[0]
    few = F.least(*present) if len(labels) > 1 else present[0]
    ratio = F.coalesce(many / few, F.lit(0.0))
    rows = [F.struct(F.lit(k).alias("label"), F.col(f"n_{k}").alias("n")) for k in labels]
    return counts.withColumn("max_to_min", ratio).select("total", "max_to_min", F.inline(F.array(*rows))).select(
        "label", "n", (F.col("n") / F.greatest("total", F.lit(1))).alias("share"), "max_to_min",
        (F.col("max_to_min") >= 1.5).alias("is_imbalanced"))


def class_table(df: DataFrame, row: str, label: str, labels: Sequence[int] = K.GRADES) -> DataFrame:
    """Counts per row value (source, split) and class as columns, with a row total."""
    counts = df.groupBy(row, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(row).agg(
        *[F.coalesce(F.sum(F.when(F.col(label) == k, F.col("_n"))), F.lit(0)).alias(f"n_{k}") for k in labels],
        F.sum("_n").alias("total"))


def class_cube(df: DataFrame, row: str, label: str) -> DataFrame:
    """Counts per (row value, class) with subtotals and the grand total (NULL marks a total)."""
    return df.cube(row, label).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def group_counts(sets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Features per set and group, as one JSON map per feature set; unknown names count as "unknown"."""
    exploded = sets.select("feature_set", F.explode("features").alias("feature"))
    tagged = exploded.join(F.broadcast(dictionary.select("feature", "feature_group")), "feature", "left")
    counts = tagged.groupBy("feature_set", F.coalesce("feature_group", F.lit("unknown")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature_set").agg(
        F.sum("n").alias("feature_count"),
        F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", "g", F.col("n").cast("string"))))).alias("feature_groups"))


# -- regions -----------------------------------------------------------------------------------

def region_statistics(regions: DataFrame, image: str, kind: str, reference: tuple[float, float],
                      centre: tuple[float, float], field_area: float, sector_minimum: float = 0.0) -> DataFrame:
    """Per image and kind: count, areas, density, distance to a reference point, counts per sector.

    The nasal side is the half of the image the reference point lies in. Quadrants over
    ``sector_minimum`` area count as occupied; the spread of the counts over the four sides is their
    entropy in units of log2(4).
    """
    px, py = reference
    cx, cy = centre
    x, y, area = F.col("x"), F.col("y"), F.col("area")
    distance = F.hypot(x - px, y - py)
    right, low = x >= cx, y >= cy
    nasal = right if px >= cx else ~right
    quadrants = [("top_left", ~right & ~low), ("top_right", right & ~low), ("bottom_left", ~right & low), ("bottom_right", right & low)]
    sides = [("superior", ~low), ("inferior", low), ("nasal", nasal), ("temporal", ~nasal)]
    grouped = regions.groupBy(image, kind).agg(
        F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), F.avg("area").alias("mean_area"),
        F.max("area").alias("max_area"), F.avg(distance).alias("distance_mean"), F.min(distance).alias("distance_min"),
        *[F.count_if(c).alias(f"n_{s}") for s, c in sides],
        *[F.sum(F.when(c, area).otherwise(0.0)).alias(f"_{q}") for q, c in quadrants])
    everything = F.col("n_superior") + F.col("n_inferior") + F.col("n_nasal") + F.col("n_temporal")
    entropy = F.lit(0.0)
    for side, _ in sides:
        p = F.col(f"n_{side}") / everything
        entropy = entropy - F.when(p > 0, p * F.log2(p)).otherwise(0.0)
    occupied = F.lit(0)
    for q, _ in quadrants:
        occupied = occupied + ((F.col(f"_{q}") > 0) & (F.col(f"_{q}") >= sector_minimum)).cast("int")
    return grouped.withColumns({
        "density": F.col("area") / max(field_area, 1.0), "occupied_quadrants": occupied,
        "sector_entropy": entropy / 2.0,
    }).drop(*[f"_{q}" for q, _ in quadrants])


def grid_occupancy(regions: DataFrame, image: str, width: float, height: float, cells: int = 4) -> DataFrame:
    """Regions per cell of a cells x cells grid, row by row, one array of fixed length per image."""
    column = F.least(F.floor(F.col("x") * cells / width), F.lit(cells - 1))
    row = F.least(F.floor(F.col("y") * cells / height), F.lit(cells - 1))
    counts = [F.count_if((row == r) & (column == c)) for r in range(cells) for c in range(cells)]
    return regions.groupBy(image).agg(F.array(*counts).alias("grid"))
