"""Task metrics: classification, regression and survival, with their curves.

Rankings are first summed by distinct score or time, so that windows without a partition see one row per distinct value.
Undefined values are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.relational import running


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def confusion(predictions: DataFrame) -> DataFrame:
    """(y, yhat, n)."""
    return predictions.groupBy("y", "yhat").agg(F.count("*").alias("n"))


def classification(predictions: DataFrame) -> DataFrame:
    """accuracy, balanced_accuracy (mean recall of true classes), f1 (macro over all classes) of y and yhat."""
    cells = confusion(predictions)
    truth = cells.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("true"), F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)).alias("tp"))
    said = cells.groupBy(F.col("yhat").alias("c")).agg(F.sum("n").alias("said"))
    each = truth.join(said, "c", "full").na.fill(0)
    f1 = 2.0 * F.col("tp") / (F.col("true") + F.col("said"))
    return each.agg(
        _ratio(F.sum("tp"), F.sum("true")).alias("accuracy"), F.avg(F.when(F.col("true") > 0, F.col("tp") / F.col("true"))).alias("balanced_accuracy"), F.avg(f1).alias("f1")
    )


def binary(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """accuracy, balanced_accuracy, f1 of the positive class and Brier score of y (0, 1) and p; one pass."""
    said, y = (F.col("p") >= threshold).cast("int"), F.col("y")
    sums = predictions.agg(
        F.sum(said * y).alias("tp"), F.sum(said * (1 - y)).alias("fp"), F.sum((1 - said) * y).alias("fn"), F.sum((1 - said) * (1 - y)).alias("tn"), F.avg((F.col("p") - y) ** 2).alias("brier")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recalls = F.filter(F.array(_ratio(tp, tp + fn), _ratio(tn, tn + fp)), lambda x: x.isNotNull())
    balanced = F.aggregate(recalls, F.lit(0.0), lambda s, x: s + x) / F.size(recalls)
    return sums.select(((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"), balanced.alias("balanced_accuracy"), F.coalesce(_ratio(2.0 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"), "brier")


def by_score(predictions: DataFrame) -> DataFrame:
    """(p, pos, neg, tp, fp, positives, negatives): one row per distinct score, with running counts from the highest."""
    sums = predictions.groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    totals = F.broadcast(sums.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")))  # one row
    return running(sums, "p", {"tp": (F.col("pos"), "sum"), "fp": (F.col("neg"), "sum")}, descending=True).join(totals)


def ranking(predictions: DataFrame) -> DataFrame:
    """auroc, ties counting half, and average_precision without interpolation."""
    rows = by_score(predictions)
    area = F.col("pos") * (F.col("negatives") - F.col("fp") + F.col("neg") / 2.0)
    both = F.max("positives") * F.max("negatives")
    return rows.agg(_ratio(F.sum(area), both).alias("auroc"), _ratio(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.max("positives")).alias("average_precision"))


def one_vs_rest(predictions: DataFrame) -> DataFrame:
    """Macro AUROC over classes of rows (y, probs): each class against the others."""
    long = predictions.select("y", F.posexplode("probs").alias("c", "p"))
    sums = long.groupBy("c", "p").agg(F.sum((F.col("y") == F.col("c")).cast("long")).alias("pos"), F.sum((F.col("y") != F.col("c")).cast("long")).alias("neg"))
    up = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    area = F.col("pos") * (F.coalesce(F.sum("neg").over(up), F.lit(0)) + F.col("neg") / 2.0)
    each = sums.withColumn("area", area).groupBy("c").agg(_ratio(F.sum("area"), F.sum("pos") * F.sum("neg")).alias("auroc"))
    return each.agg(F.avg("auroc").alias("auroc"))


def roc(predictions: DataFrame) -> DataFrame:
    """(threshold, fpr, tpr), one point per distinct score."""
    return by_score(predictions).select(F.col("p").alias("threshold"), _ratio(F.col("fp"), F.col("negatives")).alias("fpr"), _ratio(F.col("tp"), F.col("positives")).alias("tpr"))


def precision_recall(predictions: DataFrame) -> DataFrame:
    return by_score(predictions).select(F.col("p").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("positives")).alias("recall"))


def calibration(predictions: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, predicted, observed, n) of equal-width bins of p; 1 belongs to the last."""
    bin_ = F.least(F.floor(F.col("p") * bins).cast("int"), F.lit(bins - 1))
    return predictions.groupBy(bin_.alias("bin")).agg(F.avg("p").alias("predicted"), F.avg(F.col("y").cast("double")).alias("observed"), F.count("*").alias("n"))


def regression(predictions: DataFrame) -> DataFrame:
    """mae, mse, rmse, r2 of y and yhat; r2 around the mean of y, in a second pass."""
    mean = F.broadcast(predictions.agg(F.avg("y").alias("mean")))
    e = F.col("y") - F.col("yhat")
    sums = predictions.join(mean).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("rest"), F.sum((F.col("y") - F.col("mean")) ** 2).alias("all"))
    return sums.select("mae", "mse", F.sqrt("mse").alias("rmse"), F.when(F.col("all") > 0, 1 - F.col("rest") / F.col("all")).alias("r2"))


def residuals(predictions: DataFrame) -> DataFrame:
    return predictions.select("y", "yhat", (F.col("y") - F.col("yhat")).alias("residual"))


def losses(predictions: DataFrame, delta: float = 1.0) -> DataFrame:
    """Mean MAE, MSE and Huber loss of y and yhat."""
    e = F.abs(F.col("y") - F.col("yhat"))
    return predictions.agg(F.avg(e).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.when(e <= delta, 0.5 * e * e).otherwise(delta * (e - 0.5 * delta))).alias("huber"))


def cross_entropy(predictions: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Mean binary cross entropy of y and p."""
    p = F.greatest(F.least(F.col("p"), F.lit(1 - eps)), F.lit(eps))
    return predictions.agg(F.avg(-(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).alias("log_loss"))


# Survival: subjects (id, time, event, risk)


def life_table(subjects: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, time, d, c, at_risk): per distinct time the events, the censorings, and the subjects not yet gone before it."""
    by = by or []
    sums = subjects.groupBy(*by, "time").agg(F.sum("event").alias("d"), F.sum(1 - F.col("event")).alias("c"))
    if not by:
        return running(sums, "time", {"at_risk": (F.col("d") + F.col("c"), "sum")}, descending=True)
    down = Window.partitionBy(*by).orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0)
    return sums.withColumn("at_risk", F.sum(F.col("d") + F.col("c")).over(down))


def kaplan_meier(subjects: DataFrame, by: list[str] | None = None, censoring: bool = False) -> DataFrame:
    """(by, time, survival) at the event times, from (0, 1); of the censoring distribution when asked."""
    by = by or []
    gone = F.col("c" if censoring else "d")
    left = 1 - gone / F.col("at_risk")
    steps = life_table(subjects, by).where(gone > 0)
    if by:
        up = Window.partitionBy(*by).orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        steps = steps.select(*by, "time", F.product(left).over(up).alias("survival"))
    else:
        steps = running(steps, "time", {"survival": (left, "product")}).select("time", "survival")
    start = (subjects.select(*by).distinct() if by else subjects.sparkSession.range(1).drop("id")).select(*by, F.lit(0.0).alias("time"), F.lit(1.0).alias("survival"))
    return start.unionByName(steps)


def by_risk(subjects: DataFrame) -> DataFrame:
    """Kaplan-Meier curves of the subjects above the median risk (high) and of the others (low)."""
    median = F.broadcast(subjects.agg(F.expr("percentile(risk, 0.5)").alias("median")))
    marked = subjects.join(median).withColumn("group", F.when(F.col("risk") > F.col("median"), "high").otherwise("low"))
    return kaplan_meier(marked, ["group"])


def event_times(subjects: DataFrame, most: int = 12) -> DataFrame:
    """(tau): distinct event times, thinned to `most` evenly spaced ones (half-even)."""
    times = subjects.where("event = 1").select("time").distinct()
    place = running(times, "time", {"i": (F.lit(1), "sum")}).withColumn("i", F.col("i") - 1)
    n = F.broadcast(place.agg(F.count("*").alias("n")))
    wanted = F.when(F.col("n") <= most, F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.rint(j * (F.col("n") - 1) / (most - 1.0)).cast("int"))
    )
    return place.join(n).where(F.array_contains(wanted, F.col("i").cast("int"))).select(F.col("time").alias("tau"))


def concordance(subjects: DataFrame, by: list[str] | None = None, buckets: int = 32) -> DataFrame:
    """(by, c_index, pairs): over pairs of time_i < time_j with an event at i, 1 for a higher risk of i, 1/2 for a tie.

    Subjects are summed by (time, risk), and times are numbered in order. Numbers are read as digits to a base of `buckets`: two
    times part at one digit, below the same higher digits. There a count by digit and risk, running over the risks,
    stands for all times of later digits, so each subject takes part in fewer than `buckets` counts for each digit and
    no two subjects are ever compared.
    """
    by = by or []
    cells = subjects.groupBy(*by, "time", "risk").agg(F.sum("event").alias("d"), F.count("*").alias("n"))
    times = running(cells.select("time").distinct(), "time", {"place": (F.lit(1), "sum")})
    most = times.agg(F.max("place")).first()[0] or 1
    digits = 1
    while buckets**digits < most:
        digits += 1
    base = F.lit(buckets).cast("long")
    cells = cells.join(times.withColumn("place", (F.col("place") - 1).cast("long")), "time").withColumn("digit", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))))
    unit = F.element_at(F.array(*(F.lit(buckets**i).cast("long") for i in range(digits))), F.col("digit") + 1)
    low = F.floor(F.col("place") / unit)
    at = ["digit", "above", "of"]
    cells = cells.withColumns({"bucket": low % base, "above": F.floor(low / base)})
    # every later bucket, once per earlier one: buckets are a fixed few
    later = cells.groupBy(*by, "digit", "above", "bucket", "risk").agg(F.sum("n").alias("n")).where("bucket > 0")
    later = later.withColumn("of", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bucket") - 1)))
    events = cells.where("d > 0").groupBy(*by, "digit", "above", F.col("bucket").alias("of"), "risk").agg(F.sum("d").alias("d"))
    rows = later.groupBy(*by, *at, "risk").agg(F.sum("n").alias("n")).join(events, [*by, *at, "risk"], "full").na.fill(0, ["n", "d"])
    up = Window.partitionBy(*by, *at).orderBy("risk").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"below": F.coalesce(F.sum("n").over(up), F.lit(0)), "all": F.sum("n").over(Window.partitionBy(*by, *at))})
    sums = rows.groupBy(*by).agg(F.coalesce(F.sum(F.col("d") * F.col("all")), F.lit(0)).cast("long").alias("pairs"), F.coalesce(F.sum(F.col("d") * (F.col("below") + F.col("n") / 2.0)), F.lit(0.0)).alias("score"))
    return sums.select(*by, _ratio(F.col("score"), F.col("pairs")).alias("c_index"), "pairs")


def concordance_curve(subjects: DataFrame, most: int = 12) -> DataFrame:
    """(tau, c_index, pairs) with follow-up cut at each evaluation time; later events count as censored."""
    rows = subjects.join(F.broadcast(event_times(subjects, most)))
    cut = rows.select("tau", F.least("time", "tau").alias("time"), F.when(F.col("time") <= F.col("tau"), F.col("event")).otherwise(0).alias("event"), "risk")
    return concordance(cut, ["tau"])


def _censoring_at(subjects: DataFrame, floor: float) -> DataFrame:
    """(time, g): survival of the censoring distribution at each distinct time, its own censorings included."""
    table = running(life_table(subjects), "time", {"g": (1 - F.col("c") / F.col("at_risk"), "product")})
    return table.select("time", F.greatest("g", F.lit(floor)).alias("g"))


def time_dependent_auc(subjects: DataFrame, most: int = 12, floor: float = 1e-6) -> DataFrame:
    """(tau, auc): cases had an event by tau, controls lived beyond it; a case weighs 1/G(time), G the censoring survival."""
    weighted = subjects.join(_censoring_at(subjects, floor), "time")
    rows = weighted.join(F.broadcast(event_times(subjects, most)))
    case, control = (F.col("time") <= F.col("tau")) & (F.col("event") == 1), F.col("time") > F.col("tau")
    sums = rows.groupBy("tau", "risk").agg(F.sum(F.when(case, 1 / F.col("g")).otherwise(0.0)).alias("w"), F.sum(F.when(control, 1).otherwise(0)).alias("n"))
    up = Window.partitionBy("tau").orderBy("risk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below", F.coalesce(F.sum("n").over(up), F.lit(0)))
    return sums.groupBy("tau").agg(_ratio(F.sum(F.col("w") * (F.col("below") + F.col("n") / 2.0)), F.sum("w") * F.sum("n")).alias("auc"))


def _last_step(steps: DataFrame, taus: DataFrame, value: str, before: float) -> DataFrame:
    """(tau, value): the value of the last step (time, value) not after each tau, or what holds before all steps.

    taus are evaluation times, a few; they are what is broadcast, and the steps stay where they are.
    """
    met = steps.join(F.broadcast(taus), F.col("time") <= F.col("tau")).groupBy("tau").agg(F.max_by(value, "time").alias(value))
    return taus.join(met, "tau", "left").select("tau", F.coalesce(value, F.lit(before)).alias(value))


def brier_curve(estimates: DataFrame, subjects: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(tau, brier) by inverse probability of censoring. estimates: id, tau, survival."""
    steps = _censoring_at(subjects, floor)
    at_tau = _last_step(steps, estimates.select("tau").distinct(), "g", 1.0).withColumnRenamed("g", "g_tau")
    rows = estimates.join(subjects, "id").join(steps, "time").join(F.broadcast(at_tau), "tau")
    gone = (F.col("time") <= F.col("tau")) & (F.col("event") == 1)
    loss = F.when(gone, F.col("survival") ** 2 / F.col("g")).when(F.col("time") > F.col("tau"), (1 - F.col("survival")) ** 2 / F.col("g_tau")).otherwise(0.0)
    return rows.groupBy("tau").agg(F.avg(loss).alias("brier"))


def breslow(subjects: DataFrame) -> DataFrame:
    """(time, cumulative): Breslow's baseline hazard for the risks as log hazard ratios."""
    sums = subjects.groupBy("time").agg(F.sum("event").alias("d"), F.sum(F.exp("risk")).alias("e"))
    hazard = running(sums, "time", {"at_risk": (F.col("e"), "sum")}, descending=True)
    return running(hazard, "time", {"cumulative": (F.col("d") / F.col("at_risk"), "sum")}).select("time", "cumulative")


def survival_at(subjects: DataFrame, taus: DataFrame) -> DataFrame:
    """(id, tau, survival) = exp(-H(tau) exp(risk)), H Breslow's hazard."""
    base = _last_step(breslow(subjects), taus, "cumulative", 0.0).withColumnRenamed("cumulative", "h")
    return subjects.select("id", "risk").join(F.broadcast(base)).select("id", "tau", F.exp(-F.col("h") * F.exp("risk")).alias("survival"))


def cox_loss(subjects: DataFrame) -> DataFrame:
    """Mean negative log partial likelihood over events (Breslow's ties)."""
    sums = subjects.groupBy("time").agg(F.sum("event").alias("d"), F.sum(F.col("event") * F.col("risk")).alias("r"), F.sum(F.exp("risk")).alias("e"))
    rows = running(sums, "time", {"at_risk": (F.col("e"), "sum")}, descending=True)
    return rows.agg(_ratio(F.sum(F.col("d") * F.log("at_risk") - F.col("r")), F.sum("d")).alias("cox_loss"))


def bin_widths(subjects: DataFrame, bin_: str = "bin", time: str = "time") -> DataFrame:
    """(bin, low, high, width): edges between bins half-way from the last time of one to the first of the next.

    Outer edges are the outermost times; a width that isn't positive becomes the median positive gap of the edges, or 1.
    """
    ends = subjects.groupBy(F.col(bin_).alias("bin")).agg(F.min(time).alias("first"), F.max(time).alias("last"))
    order = Window.orderBy("bin")
    low = F.coalesce((F.lag("last").over(order) + F.col("first")) / 2, F.col("first"))
    high = F.coalesce((F.col("last") + F.lead("first").over(order)) / 2, F.col("last"))
    edges = ends.withColumns({"low": low, "high": high}).withColumn("gap", F.col("high") - F.col("low"))
    usual = F.broadcast(edges.agg(F.coalesce(F.expr("percentile(CASE WHEN gap > 0 THEN gap END, 0.5)"), F.lit(1.0)).alias("usual")))
    return edges.join(usual).select("bin", "low", "high", F.when(F.col("gap") > 0, F.col("gap")).otherwise(F.col("usual")).alias("width"))


def survival_summary(subjects: DataFrame, most: int = 12) -> DataFrame:
    """c_index, mean, least and greatest td-AUC, and the number of evaluation times."""
    auc = time_dependent_auc(subjects, most).agg(F.avg("auc").alias("mean_auc"), F.min("auc").alias("min_auc"), F.max("auc").alias("max_auc"), F.count("*").alias("times"))
    return concordance(subjects).drop("pairs").join(F.broadcast(auc))


def long_form(metrics: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """(metric, value) of a one-row table; only the selected metrics when given."""
    names = [c for c in metrics.columns if selected is None or c in selected]
    return metrics.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))))
