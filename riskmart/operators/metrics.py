"""Model evaluation on scored tables, always tie-grouped and distributed.

Every report starts from the score curve: one row per distinct score with the good
and bad counts and their running totals from the riskiest score down. The counts
are integers, so the results do not depend on the order of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart import constants as K
from riskmart.operators.running import range_cuts, row_positions, running_totals

BAD, GOOD = "bad", "good"


# --- validation --------------------------------------------------------------

def violations(scored: DataFrame, y: str, p: str, flag: str | None = None) -> DataFrame:
    """Counts of every broken input rule, in one row."""
    bad_binary = lambda c: F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1))
    aggs = [F.count("*").alias("n_rows"),
            F.count_if(F.col(y).isNull()).alias("y_null"), bad_binary(y).alias("y_not_binary"),
            F.count_if(F.col(p).isNull() | F.isnan(F.col(p).cast("double"))).alias("p_null")]
    if flag:
        aggs += [F.count_if(F.col(flag).isNull()).alias("flag_null"), bad_binary(flag).alias("flag_not_binary")]
    return scored.agg(*aggs)


def validate(scored: DataFrame, y: str, p: str, flag: str | None = None, threshold: float | None = None) -> None:
    """Raise on invalid inputs (one job, one result row)."""
    if threshold is not None and not 0 <= threshold <= 1:
        raise ValueError(f"threshold must be in [0, 1]: {threshold}")
    row = violations(scored, y, p, flag).first().asDict()
    broken = {k: v for k, v in row.items() if k != "n_rows" and v}
    if row["n_rows"] == 0:
        raise ValueError("empty scored table")
    if broken:
        raise ValueError(f"invalid scored table: {broken}")


# --- curve -------------------------------------------------------------------

def score_curve(scored: DataFrame, y: str, p: str, by: Sequence[str] = (), flag: str | None = None,
                ranges: int | None = None, rows: str | None = None) -> DataFrame:
    """Good/bad counts per distinct score and their running totals, riskiest first.

    With ``flag`` the counts of rows accepted by the current policy are carried too. ``rows`` names
    a column with the number of equal rows that each row stands for.
    """
    yes = F.col(y) == 1
    count = F.count_if if rows is None else lambda c: F.coalesce(F.sum(F.when(c, F.col(rows))), F.lit(0))
    aggs = {BAD: count(yes), GOOD: count(F.col(y) == 0)}
    if flag:
        kept = F.col(flag) == 1
        aggs["kept_bad"] = count(yes & kept)
        aggs["kept_good"] = count((F.col(y) == 0) & kept)
    known = scored.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    collapsed = known.groupBy(*by, p).agg(*[c.alias(n) for n, c in aggs.items()])
    return running_totals(collapsed, p, list(aggs), by=by, descending=True,
                          cuts=range_cuts(known, F.col(p), ranges))


def _rates() -> tuple[Column, Column]:
    return F.try_divide(F.col("cum_bad"), F.col("tot_bad")), F.try_divide(F.col("cum_good"), F.col("tot_good"))


def cumulative_rates(scored: DataFrame, y: str, p: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Cumulative good and bad rate and their gap at every score."""
    bad, good = _rates()
    return score_curve(scored, y, p, by, ranges=ranges).select(
        *by, p, BAD, GOOD, bad.alias("cum_bad_rate"), good.alias("cum_good_rate"), F.abs(bad - good).alias("gap"))


def ks_curve(scored: DataFrame, y: str, p: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """KS plot table: population %, cumulative good % and bad %, distance."""
    bad, good = _rates()
    population = (F.col("cum_bad") + F.col("cum_good")) / (F.col("tot_bad") + F.col("tot_good")) * 100
    return score_curve(scored, y, p, by, ranges=ranges).select(
        *by, p, population.alias("population_pct"), (bad * 100).alias("cum_bad_pct"),
        (good * 100).alias("cum_good_pct"), (F.abs(bad - good) * 100).alias("ks_distance"))


def roc_points(scored: DataFrame, y: str, p: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """False and true positive rate at every threshold."""
    tpr, fpr = _rates()
    return score_curve(scored, y, p, by, ranges=ranges).select(
        *by, F.col(p).alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))


def _curve_measures(curve: DataFrame, p: str, by: Sequence[str], carry: Sequence[str] = (),
                    fixed: float = 0.5) -> DataFrame:
    """KS with its threshold and AUC per group; ``at_`` running totals of the carried counts at
    that threshold, and ``fix_`` totals at a fixed one."""
    bad, good = _rates()
    gap = F.abs(bad - good)
    big = lambda c: F.col(c).cast("decimal(20,0)")
    # twice the number of (good, bad) pairs ranked correctly, ties counting one half
    pairs = (big(GOOD) * (big("cum_bad") * 2 - big(BAD))).cast("decimal(38,0)")
    best = F.max_by(F.struct(F.col(p).cast("double").alias("threshold"), gap.alias("gap"),
                             *[F.col(f"cum_{c}") for c in carry]),
                    F.struct(F.coalesce(gap, F.lit(-1.0)), F.col(p)))
    out = curve.groupBy(*by).agg(
        best.alias("best"), F.sum(pairs).alias("pairs"),
        *[F.max(f"tot_{c}").alias(f"tot_{c}") for c in dict.fromkeys([BAD, GOOD, *carry])],
        *[F.sum(F.when(F.col(p) >= fixed, F.col(c)).otherwise(0)).alias(f"fix_{c}") for c in carry])
    two = (F.col("tot_bad") > 0) & (F.col("tot_good") > 0)
    auc = F.when(two, F.col("pairs").cast("double") / (F.lit(2.0) * F.col("tot_bad") * F.col("tot_good")))
    return out.select(
        *by,
        F.when(two, F.col("best.gap") * 100).otherwise(0.0).alias("ks"),
        F.when(two, F.col("best.threshold")).otherwise(0.5).alias("ks_threshold"),
        auc.alias("auc"), ((F.lit(2.0) * auc - 1) * 100).alias("gini"),
        *[F.col(f"best.cum_{c}").alias(f"at_{c}") for c in carry], *[f"fix_{c}" for c in carry],
        *[f"tot_{c}" for c in dict.fromkeys([BAD, GOOD, *carry])])


def ks(scored: DataFrame, y: str, p: str, by: Sequence[str] = (), ranges: int | None = None, rows: str | None = None) -> DataFrame:
    """KS (0-100) and the highest threshold attaining it; (0, 0.5) with one class only."""
    return _curve_measures(score_curve(scored, y, p, by, ranges=ranges, rows=rows), p, by).select(*by, "ks", "ks_threshold")


def auc_gini(scored: DataFrame, y: str, p: str, by: Sequence[str] = (), ranges: int | None = None, rows: str | None = None) -> DataFrame:
    """AUC (ties count one half) and Gini; null with one class only."""
    return _curve_measures(score_curve(scored, y, p, by, ranges=ranges, rows=rows), p, by).select(*by, "auc", "gini")


def direction_free_auc(scored: DataFrame, y: str, scores: Sequence[str], ranges: int | None = None) -> DataFrame:
    """AUC of several raw scores, each turned around when it ranks the wrong way."""
    # the scores stand under each other as groups of one curve: one pass, one shuffle for all of them
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("p")) for s in scores]))
    long = scored.select(F.col(y).alias("y"), each.alias("s")).select("y", "s.score", "s.p").where("p is not null")
    return auc_gini(long, "y", "p", by=["score"], ranges=ranges).select(
        "score", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc"), (F.col("auc") < 0.5).alias("reversed"))


# --- threshold-based ---------------------------------------------------------

def confusion(scored: DataFrame, y: str, p: str, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp at ``p >= threshold``."""
    hit, bad = F.col(p) >= threshold, F.col(y) == 1
    good = F.col(y) == 0
    return scored.groupBy(*by).agg(
        F.count_if(good & ~hit).alias("tn"), F.count_if(good & hit).alias("fp"),
        F.count_if(bad & ~hit).alias("fn"), F.count_if(bad & hit).alias("tp"))


def _or_zero(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def rates_of_confusion(cm: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, specificity and F1, 0 on an empty denominator."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    out = cm.withColumns({
        "accuracy": _or_zero(tp + tn, tp + tn + fp + fn), "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn), "specificity": _or_zero(tn, tn + fp)})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1_score", _or_zero(F.lit(2.0) * F.col("precision") * F.col("recall"), both))


_SWAP = ["swap_in_total", "swap_in_good", "swap_in_bad", "swap_in_hit_pct", "swap_out_total", "swap_out_good",
         "swap_out_bad", "swap_out_hit_pct", "kept_approved", "kept_rejected", "n_rows", "policy_approved",
         "policy_rejected", "model_approved", "model_rejected"]


def _swap_columns(in_good: Column, in_bad: Column, out_good: Column, out_bad: Column,
                  kept_in: Column, kept_out: Column) -> dict[str, Column]:
    """Report columns from the quadrant counts (in = policy no / model yes, out = the reverse)."""
    ins, outs = in_good + in_bad, out_good + out_bad
    pct = lambda a, b: F.when(b > 0, a / b * 100).otherwise(F.lit(0.0))
    values = [ins, in_good, in_bad, pct(in_good, ins), outs, out_good, out_bad, pct(out_bad, outs),
              kept_in, kept_out, ins + outs + kept_in + kept_out, outs + kept_in, ins + kept_out,
              ins + kept_in, outs + kept_out]
    return dict(zip(_SWAP, values))


def swap(scored: DataFrame, y: str, predicted: str, flag: str, by: Sequence[str] = ()) -> DataFrame:
    """Swap-in / swap-out of the model against the current policy.

    ``predicted`` 1 rejects, ``flag`` 1 means the policy approved.
    """
    counts = scored.groupBy(*by).agg(*[
        F.count_if((F.col(flag) == f) & (F.col(predicted) == m) & (F.col(y) == t)).alias(f"q{f}{m}{t}")
        for f in (0, 1) for m in (0, 1) for t in (0, 1)])
    q = F.col
    cols = _swap_columns(q("q000"), q("q001"), q("q110"), q("q111"), q("q100") + q("q101"), q("q010") + q("q011"))
    return counts.select(*by, *[c.alias(n) for n, c in cols.items()])


# --- full record -------------------------------------------------------------

def evaluate(scored: DataFrame, y: str, p: str, flag: str | None = None, threshold: float = 0.5,
             use_ks_threshold: bool = True, by: Sequence[str] = (), benchmark: float = K.BENCHMARK_KS,
             ranges: int | None = None) -> DataFrame:
    """The complete evaluation as one row per group, from a single score curve.

    With the KS threshold the confusion counts and the swap quadrants are the running
    totals of the curve at that score, so the scored rows are read once.
    """
    if not 0 <= threshold <= 1:
        raise ValueError(f"threshold must be in [0, 1]: {threshold}")
    carry = [BAD, GOOD] + (["kept_bad", "kept_good"] if flag else [])
    curve = score_curve(scored, y, p, by, flag, ranges)
    base = _curve_measures(curve, p, by, carry, fixed=0.5 if use_ks_threshold else threshold)
    # with one class there is no KS threshold: the counts come from the fixed cut
    one = (F.col("tot_bad") == 0) | (F.col("tot_good") == 0) if use_ks_threshold else F.lit(True)
    at = {c: F.when(one, F.col(f"fix_{c}")).otherwise(F.col(f"at_{c}")) for c in carry}
    cm = base.withColumns({
        "tn": F.col("tot_good") - at[GOOD], "fp": at[GOOD], "fn": F.col("tot_bad") - at[BAD], "tp": at[BAD],
        "threshold": F.col("ks_threshold") if use_ks_threshold else F.lit(float(threshold))})
    out = rates_of_confusion(cm).withColumn("ks_vs_benchmark", F.col("ks") - F.lit(benchmark))
    names = [*by, "ks", "ks_vs_benchmark", "ks_threshold", "threshold", "gini", "auc", "tn", "fp", "fn", "tp",
             "accuracy", "precision", "recall", "specificity", "f1_score"]
    if not flag:
        return out.select(*names)
    # rejected by the model = at or above the threshold
    out_bad, out_good = at["kept_bad"], at["kept_good"]
    kept_in = F.col("tot_kept_bad") + F.col("tot_kept_good") - out_bad - out_good
    no_bad, no_good = at[BAD] - out_bad, at[GOOD] - out_good
    in_bad = F.col("tot_bad") - F.col("tot_kept_bad") - no_bad
    in_good = F.col("tot_good") - F.col("tot_kept_good") - no_good
    cols = _swap_columns(in_good, in_bad, out_good, out_bad, kept_in, no_bad + no_good)
    return out.select(*names, *[c.alias(n) for n, c in cols.items()])


def evaluate_step(scored: DataFrame, y: str, p: str, step: int, n_features: int, model: str,
                  flag: str | None = None, **options) -> DataFrame:
    """Evaluation record with the step's metadata in front."""
    record = evaluate(scored, y, p, flag, **options)
    return record.select(F.lit(model).alias("modelo"), F.lit(step).alias("etapa"),
                         F.lit(K.STEPS[step][0] if step in K.STEPS else str(step)).alias("nome_etapa"),
                         F.lit(n_features).alias("num_features"), "*")


# --- comparisons and reports -------------------------------------------------

def with_delta(results: DataFrame, order: str = "etapa", value: str = "ks", by: Sequence[str] = ("modelo",)) -> DataFrame:
    """Previous step's value (0 for the first) and the gain over it."""
    w = Window.partitionBy(*by).orderBy(order)
    previous = F.coalesce(F.lag(value).over(w), F.lit(0.0))
    return results.withColumns({f"{value}_anterior": previous, f"delta_{value}": F.col(value) - previous})


def stack_records(records: Mapping[str, DataFrame], name: str = "modelo") -> DataFrame:
    """Long table of evaluation records, one per model."""
    parts = [r.select(F.lit(k).alias(name), *[c for c in r.columns if c != name]) for k, r in records.items()]
    return reduce(DataFrame.unionByName, parts)


def compare_models(first: DataFrame, second: DataFrame, on: Sequence[str] = ("etapa",), value: str = "ks",
                   tags: tuple[str, str] = ("lr", "gb")) -> DataFrame:
    """Two result tables side by side, joined on the step, with the difference."""
    a, b = f"{value}_{tags[0]}", f"{value}_{tags[1]}"
    left = first.select(*on, F.col(value).alias(a))
    right = second.select(*on, F.col(value).alias(b))
    return left.join(right, list(on)).withColumn(f"diferenca_{value}", F.col(b) - F.col(a))


def model_table(records: Mapping[str, DataFrame]) -> DataFrame:
    """The main measures of several models under each other."""
    return stack_records(records).select("modelo", "ks", "gini", "auc", "accuracy", "precision", "recall", "f1_score")


def confusion_table(records: DataFrame) -> DataFrame:
    """Confusion counts of every model and step, nulls last."""
    return records.select(
        "modelo", "etapa", "nome_etapa", F.col("tn").alias("tn_real0_pred0"), F.col("fp").alias("fp_real0_pred1"),
        F.col("fn").alias("fn_real1_pred0"), F.col("tp").alias("tp_real1_pred1"),
    ).orderBy(F.col("etapa").asc_nulls_last(), F.col("modelo").asc_nulls_last())


def by_vintage(scored: DataFrame, y: str, p: str, vintage: str, oot_flag: str | None = None,
               ranges: int | None = None) -> DataFrame:
    """Volume, bad rate, KS and Gini of every vintage in one pass; single-class vintages are left out."""
    measures = _curve_measures(score_curve(scored, y, p, [vintage], ranges=ranges), p, [vintage]).where(
        (F.col("tot_bad") > 0) & (F.col("tot_good") > 0))
    volume = F.col("tot_bad") + F.col("tot_good")
    out = measures.select(vintage, volume.alias("volume"), (F.col("tot_bad") / volume * 100).alias("bad_rate_pct"),
                          "ks", "gini")
    if oot_flag:
        base = scored.groupBy(vintage).agg(
            F.when(F.avg(oot_flag) > 0.5, "OOT (Teste)").otherwise("Treino").alias("base"))
        out = out.join(base, vintage)
    return out.orderBy(vintage)


def reject_worst(scored: DataFrame, p: str, key: str, fraction: float) -> DataFrame:
    """Mark the worst ``fraction`` of the rows (floor of n times fraction) as rejected."""
    ranked = row_positions(scored, p, key, descending=True)
    limit = F.floor(F.col("n_rows") * F.lit(float(fraction)))
    return ranked.withColumn("rejected", (F.col("position") <= limit).cast("int"))


def simulate_cutoff(scored: DataFrame, y: str, p: str, key: str, fractions: Sequence[float],
                    baseline_rate: float) -> DataFrame:
    """Default rate of the approved and of the rejected part for each rejection rate."""
    ranked = row_positions(scored, p, key, descending=True)
    cells = []
    for f in fractions:
        out = F.col("position") <= F.floor(F.col("n_rows") * F.lit(float(f)))
        cells.append((f, F.avg(F.when(~out, F.col(y))) * 100, F.avg(F.when(out, F.col(y))) * 100, F.count_if(out)))
    row = ranked.agg(F.count("*").alias("n"), *[x for i, (_, a, r, n) in enumerate(cells) for x in
                                                (a.alias(f"a{i}"), r.alias(f"r{i}"), n.alias(f"n{i}"))])
    items = F.explode(F.array(*[
        F.struct(F.lit(float(f)).alias("rejected_share"), F.col(f"n{i}").alias("n_rejected"),
                 (F.col("n") - F.col(f"n{i}")).alias("n_approved"), F.col(f"a{i}").alias("approved_rate_pct"),
                 F.col(f"r{i}").alias("rejected_rate_pct"),
                 (F.lit(float(baseline_rate)) - F.col(f"a{i}")).alias("reduction_points"))
        for i, (f, *_rest) in enumerate(cells)]))
    return row.select(items.alias("s")).select("s.*")
