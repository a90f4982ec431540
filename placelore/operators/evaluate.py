"""Evaluation metrics. Everything is counted first and derived from counts, so one pass with map-side combine
serves each report, and rounding is done in whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from placelore.functions.numbers import ratio

NOT_STATED = "NOT_STATED"


def _f1(p: Column, r: Column) -> Column:
    """Harmonic mean of two values given in whole ten-thousandths, rounded the same way."""
    return F.when(p + r > 0, ratio(2 * p * r, p + r, 0)).otherwise(0.0)


def binary_counts(df: DataFrame, by: list[str], truth: Column, pred: Column) -> DataFrame:
    t, p = truth.cast("boolean"), pred.cast("boolean")
    return df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 (from the rounded two), accuracy and support, four digits, 0 where undefined."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    z = F.lit(0.0)
    out = counts.withColumns({"precision": F.coalesce(ratio(tp, tp + fp, 4), z), "recall": F.coalesce(ratio(tp, tp + fn, 4), z),
                              "accuracy": F.coalesce(ratio(tp + tn, tp + fp + fn + tn, 4), z), "support": tp + fn})
    p4, r4 = (F.round(F.col(c) * 10000).cast("bigint") for c in ("precision", "recall"))
    return out.withColumn("f1", _f1(p4, r4) / 10000)


def macro(metrics: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean precision and recall over classes; F1 of those means."""
    s = lambda c: F.sum(F.round(F.col(c) * 10000).cast("bigint"))
    m = metrics.groupBy(*by).agg(ratio(s("precision"), F.count("*"), 0).cast("bigint").alias("p"), ratio(s("recall"), F.count("*"), 0).cast("bigint").alias("r"))
    return m.select(*by, (F.col("p") / 10000).alias("macro_precision"), (F.col("r") / 10000).alias("macro_recall"), (_f1(F.col("p"), F.col("r")) / 10000).alias("macro_f1"))


def error_examples(df: DataFrame, by: list[str], truth: Column, pred: Column, order: list[str], n: int = 5) -> DataFrame:
    """First ``n`` false positives and false negatives per class."""
    kind = F.when(~truth & pred, "FP").when(truth & ~pred, "FN")
    w = W.partitionBy(*by, "error").orderBy(*order)
    return df.withColumn("error", kind).filter("error is not null").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def confusion(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Long confusion counts; a blank prediction counts as not stated."""
    blank = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(NOT_STATED))
    return df.groupBy(*by, blank(truth).alias("true_label"), blank(pred).alias("pred_label")).agg(F.count("*").alias("n"))


def categorical_metrics(conf: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over all rows, macro F1 over the labels seen, coverage, abstention, accuracy where produced."""
    t, p, n = F.col("true_label"), F.col("pred_label"), F.col("n")
    total = conf.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.when(t == p, n).otherwise(0)).alias("hit"), F.sum(F.when(p != NOT_STATED, n).otherwise(0)).alias("produced"),
                                  F.sum(F.when((p != NOT_STATED) & (t == p), n).otherwise(0)).alias("produced_hit"))
    side = lambda c, v: conf.select(*by, F.col(c).alias("label"), F.when(t == p, n).otherwise(0).alias("tp"), *[(n if k == v else F.lit(0)).alias(k) for k in ("nt", "np")])
    labels = side("true_label", "nt").unionByName(side("pred_label", "np").withColumn("tp", F.lit(0).cast("bigint"))).groupBy(*by, "label").agg(F.sum("tp").alias("tp"), F.sum("nt").alias("nt"), F.sum("np").alias("np"))
    f1 = labels.groupBy(*by).agg(F.avg(F.when(F.col("nt") + F.col("np") > 0, 2 * F.col("tp") / (F.col("nt") + F.col("np"))).otherwise(0.0)).alias("macro_f1"))
    return total.join(f1, by).select(*by, "n", ratio(F.col("hit"), F.col("n"), 4).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"), ratio(F.col("produced"), F.col("n"), 4).alias("coverage"),
                                     ratio(F.col("n") - F.col("produced"), F.col("n"), 4).alias("abstention"), F.coalesce(ratio(F.col("produced_hit"), F.col("produced"), 4), F.lit(0.0)).alias("accuracy_when_produced"))


def ordinal_metrics(df: DataFrame, by: list[str], truth: Column, pred: Column) -> DataFrame:
    """Exact share, mean absolute error and within-one share over rows where both are numbers."""
    t, p = truth.try_cast("int"), pred.try_cast("int")
    d = F.abs(t - p)
    both = df.withColumn("_d", d).groupBy(*by).agg(F.count("*").alias("n"), F.count("_d").alias("scored"), F.count_if(F.col("_d") == 0).alias("hit"), F.sum("_d").alias("err"), F.count_if(F.col("_d") <= 1).alias("near"))
    r = lambda c: ratio(F.col(c), F.col("scored"), 4)
    return both.select(*by, "n", "scored", r("hit").alias("exact"), r("err").alias("mae"), r("near").alias("within_one"))


def amount_metrics(df: DataFrame, by: list[str], truth: Column, pred: Column) -> DataFrame:
    """Exact match and coverage over rows with a true amount; thousands separators are dropped."""
    num = lambda c: F.regexp_replace(c, ",", "").try_cast("bigint")
    x = df.withColumn("_t", num(truth)).withColumn("_p", num(pred)).filter("_t is not null")
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("_t") == F.col("_p")).alias("hit"), F.count("_p").alias("given"))
    return g.select(*by, "n", ratio(F.col("hit"), F.col("n"), 4).alias("exact"), ratio(F.col("given"), F.col("n"), 4).alias("coverage"))


def kappa(df: DataFrame, by: list[str], a: Column, b: Column, quadratic: bool = False) -> DataFrame:
    """Percent agreement and Cohen's kappa over pairs where both are given (quadratic: both are digits).

    One count per (a, b) cell; marginals and their products come from the cells, which are few.
    """
    x = df.select(*by, a.cast("string").alias("_a"), b.cast("string").alias("_b")).filter("trim(coalesce(_a, '')) <> '' and trim(coalesce(_b, '')) <> ''")
    if quadratic:
        x = x.filter(F.col("_a").rlike("^[0-9]+$") & F.col("_b").rlike("^[0-9]+$"))
    cells = x.groupBy(*by, "_a", "_b").agg(F.count("*").alias("c"))
    agg = F.map_from_entries(F.collect_list(F.struct("k", "c")))
    row = cells.groupBy(*by, F.col("_a").alias("k")).agg(F.sum("c").alias("c")).groupBy(*by).agg(agg.alias("ma"))
    col = cells.groupBy(*by, F.col("_b").alias("k")).agg(F.sum("c").alias("c")).groupBy(*by).agg(agg.alias("mb"))
    weight = (lambda p, q: F.pow(p.cast("double") - q.cast("double"), F.lit(2))) if quadratic else (lambda p, q: F.when(p == q, 0.0).otherwise(1.0))
    obs = cells.groupBy(*by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("c")).otherwise(0)).alias("same"), F.sum(F.col("c") * weight(F.col("_a"), F.col("_b"))).alias("wo"))
    both = (obs.join(row, by).join(col, by) if by else obs.join(F.broadcast(row)).join(F.broadcast(col)))
    expected = F.aggregate(F.map_entries("ma"), F.lit(0.0), lambda acc, p: acc + F.aggregate(F.map_entries("mb"), F.lit(0.0), lambda a2, q: a2 + weight(p["key"], q["key"]) * p["value"] * q["value"]))
    return both.withColumn("we", expected / F.col("n")).select(*by, "n", ratio(F.col("same"), F.col("n"), 4).alias("agreement"),
                                                                 F.round(F.when(F.col("we") == 0, 1.0).otherwise(1 - F.col("wo") / F.col("we")), 6).alias("kappa"))


def threshold_sweep(df: DataFrame, by: list[str], score: Column, truth: Column, lo: float, step: float, steps: int) -> DataFrame:
    """Precision, recall and F1 at each threshold lo + k·step.

    Rows are counted once per score bin; a running sum from the top gives every threshold. Nothing is joined to
    the grid but the few bins.
    """
    bin_ = F.least(F.lit(steps), F.floor((score - lo) / step + 1e-9)).cast("int")
    hist = df.groupBy(*by, F.greatest(bin_, F.lit(-1)).alias("k")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    totals = hist.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    grid = totals.select(*by, "all_pos", "all_neg", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
    w = W.partitionBy(*by).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    run = grid.join(hist, [*by, "k"], "left").withColumn("tp", F.sum(F.coalesce("pos", F.lit(0))).over(w)).withColumn("fp", F.sum(F.coalesce("neg", F.lit(0))).over(w))
    counts = run.select(*by, F.round(lo + F.col("k") * step, 4).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))
    return binary_metrics(counts)


def best_threshold(sweep: DataFrame, by: list[str]) -> DataFrame:
    """Highest F1, the lowest threshold on ties."""
    w = W.partitionBy(*by).orderBy(F.desc("f1"), "threshold")
    return sweep.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent stated value and its share; the smallest value on ties."""
    c = df.filter(F.col(value).isNotNull() & (F.trim(F.col(value)) != "") & (F.col(value) != NOT_STATED)).groupBy(*by, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    ranked = c.withColumn("total", F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), value)))
    return ranked.filter("rn = 1").select(*by, F.col(value).alias("majority"), "n", "total", ratio(F.col("n"), F.col("total"), 4).alias("accuracy"))


def score_summary(df: DataFrame, by: list[str], metric: str, seconds: str) -> DataFrame:
    """Mean, min, max and sample deviation of the stated scores; answered of total; mean seconds."""
    m = F.col(metric)
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count(m).alias("answered"), F.round(F.avg(m), 6).alias("mean"), F.min(m).alias("min"), F.max(m).alias("max"),
                               F.round(F.stddev_samp(m), 6).alias("std"), F.round(F.avg(seconds), 6).alias("avg_seconds"))


def deltas(summary: DataFrame, setup: str, base: str, value: str = "mean") -> DataFrame:
    """Difference of every setup to the base one, and which is best. Setups are few."""
    ref = summary.filter(F.col(setup) == base).select(F.lit(1).alias("_k"), F.col(value).alias("_base"))
    best = summary.groupBy(F.lit(1).alias("_k")).agg(F.max_by(setup, value).alias("best_setup"))
    return summary.withColumn("_k", F.lit(1)).join(ref, "_k", "left").join(best, "_k").withColumn("delta", F.round(F.col(value) - F.col("_base"), 6)).drop("_k", "_base")


def band_report(df: DataFrame, by: list[str], amount: Column, cutoffs=(500, 1500, 5000)) -> DataFrame:
    """Shares of the bands below each cut-off, and exact 33/67/92 % points of the positive amounts.

    Percentiles are read off counts per value (running sum), so no group is ever collected.
    """
    lo, mid, hi = cutoffs
    v = df.select(*by, amount.alias("v")).filter("v > 0").groupBy(*by, "v").agg(F.count("*").alias("c"))
    w = W.partitionBy(*by).orderBy("v")
    run = v.withColumn("upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(W.partitionBy(*by)))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("n") * q, F.col("v"))).alias(f"p{q}")
    share = lambda cond, name: ratio(F.sum(F.when(cond, F.col("c")).otherwise(0)), F.max("n"), 4).alias(name)
    x = F.col("v")
    return run.groupBy(*by).agg(F.max("n").alias("n"), at(33), at(67), at(92), share(x < lo, "low"), share((x >= lo) & (x < mid), "moderate"), share((x >= mid) & (x < hi), "high"), share(x >= hi, "very_high"))
