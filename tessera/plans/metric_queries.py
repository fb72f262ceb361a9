"""Queries of the task metrics, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import task_metrics as tm
from tessera.plans.domain import classified, regressed, survival, table, with_views


def _round(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _multiclass(spark, sf_dir):
    """Truth and prediction of the segment of a customer: its nation's remainder."""
    names = F.array(*(F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("y"), F.element_at(names, F.col("c_nationkey") % 5 + 1).alias("yhat"))


def _scaled(spark, sf_dir):
    return survival(spark, sf_dir).withColumn("risk", F.col("risk") / 500000)


def _ovr(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("y"), F.transform(F.slice("embedding", 1, 10), lambda x: F.round(x.cast("double"), 6)).alias("probs"))


def _brier(spark, sf_dir):
    rows = _scaled(spark, sf_dir)
    return tm.brier_curve(tm.survival_at(rows, tm.event_times(rows)), rows)


def _bins(spark, sf_dir):
    rows = survival(spark, sf_dir)
    return tm.bin_widths(rows.withColumn("bin", F.floor(F.col("time") / 400)))


QUERIES = {
    "cls_confusion": lambda s, d: tm.confusion(_multiclass(s, d)),
    "cls_multiclass": lambda s, d: _round(tm.classification(_multiclass(s, d))),
    "cls_binary": lambda s, d: _round(tm.binary(classified(s, d))),
    "cls_auroc_ap": lambda s, d: _round(tm.ranking(classified(s, d))),
    "cls_auroc_ovr": lambda s, d: _round(tm.one_vs_rest(_ovr(s, d))),
    "cls_roc_points": lambda s, d: _round(tm.roc(classified(s, d))),
    "cls_pr_points": lambda s, d: _round(tm.precision_recall(classified(s, d))),
    "cls_calibration": lambda s, d: _round(tm.calibration(classified(s, d))),
    "cls_log_loss": lambda s, d: _round(tm.cross_entropy(classified(s, d).withColumn("p", F.col("p") * 0.9 + 0.05))),
    "reg_metrics": lambda s, d: _round(tm.regression(regressed(s, d)).withColumns({c: F.col(c) / 1e6 for c in ("mae", "rmse")} | {"mse": F.col("mse") / 1e12}), 5),
    "reg_losses": lambda s, d: _round(tm.losses(regressed(s, d).select((F.col("y") / 1e5).alias("y"), (F.col("yhat") / 1e5).alias("yhat")))),
    "reg_residuals": lambda s, d: _round(tm.residuals(regressed(s, d)).agg(F.avg(F.col("residual") / 1e5).alias("mean"), F.count("*").alias("n"))),
    "km_curve": lambda s, d: _round(tm.kaplan_meier(survival(s, d))),
    "km_censoring": lambda s, d: _round(tm.kaplan_meier(survival(s, d), censoring=True)),
    "km_by_risk": lambda s, d: _round(tm.by_risk(survival(s, d))),
    "surv_event_times": lambda s, d: tm.event_times(survival(s, d)),
    "surv_c_index": lambda s, d: _round(tm.concordance(survival(s, d))),
    "surv_c_index_curve": lambda s, d: _round(tm.concordance_curve(survival(s, d))),
    "surv_td_auc": lambda s, d: _round(tm.time_dependent_auc(survival(s, d))),
    "surv_brier_curve": lambda s, d: _round(_brier(s, d)),
    "surv_breslow": lambda s, d: _round(tm.breslow(_scaled(s, d))),
    "surv_cox_loss": lambda s, d: _round(tm.cox_loss(_scaled(s, d))),
    "surv_bin_widths": lambda s, d: _round(_bins(s, d)),
    "surv_summary": lambda s, d: _round(tm.survival_summary(survival(s, d))),
}

_MULTI = "m AS (SELECT c_mktsegment AS y, ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][c_nationkey % 5 + 1] AS yhat FROM customer)"
_SCORE = "s AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM classified GROUP BY p), c AS (SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS pp, sum(neg) OVER () AS nn FROM s)"
_LIFE = "life AS (SELECT time, sum(event) AS d, sum(1 - event) AS c, sum(count(*)) OVER (ORDER BY time DESC) AS n FROM survival GROUP BY time)"
_TAU = "et AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT time FROM survival WHERE event = 1)), tau AS (SELECT DISTINCT et.time AS tau FROM et, range(12) r(j) WHERE i = CASE WHEN n <= 12 THEN j ELSE round_even(j * (n - 1) / 11.0, 0) END)"
_G = "g AS (SELECT time, greatest(exp(sum(CASE WHEN c < n THEN ln(1 - c / n::DOUBLE) ELSE -1e9 END) OVER (ORDER BY time)), 1e-6) AS g FROM life)"
_KM = "SELECT 0.0::DOUBLE AS time, 1.0::DOUBLE AS survival UNION ALL SELECT time, round(CASE WHEN min(n - {x}) OVER w = 0 THEN 0 ELSE exp(sum(ln(greatest(1 - {x} / n::DOUBLE, 1e-300))) OVER w) END, 6) FROM life WHERE {x} > 0 WINDOW w AS (ORDER BY time)"
_AUC = "auc AS (SELECT tau, sum(CASE WHEN a.risk > b.risk THEN w WHEN a.risk = b.risk THEN w / 2 ELSE 0 END) / sum(w) AS auc FROM tau JOIN (SELECT s.*, 1 / g AS w FROM survival s JOIN g USING (time)) a ON a.time <= tau AND a.event = 1 JOIN survival b ON b.time > tau GROUP BY tau)"
_C = "SELECT sum(CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END)::DOUBLE / count(*) AS c_index, count(*) AS pairs FROM survival a JOIN survival b ON a.time < b.time AND a.event = 1"
_SCALED = "x AS (SELECT id, time, event, risk / 500000 AS risk FROM survival), h AS (SELECT time, d, r, sum(e) OVER (ORDER BY time DESC) AS at_ FROM (SELECT time, sum(event) AS d, sum(event * risk) AS r, sum(exp(risk)) AS e FROM x GROUP BY time)), b AS (SELECT time, sum(d / at_) OVER (ORDER BY time) AS cumulative FROM h)"

ORACLES = {
    "cls_confusion": f"WITH {_MULTI} SELECT y, yhat, count(*) AS n FROM m GROUP BY ALL",
    "cls_multiclass": f"WITH {_MULTI}, k AS (SELECT DISTINCT y AS c FROM m UNION SELECT DISTINCT yhat FROM m), e AS (SELECT c, count(*) FILTER (y = c) AS t, count(*) FILTER (yhat = c) AS s, count(*) FILTER (y = c AND yhat = c) AS tp FROM m, k GROUP BY c) SELECT round(sum(tp) / sum(t), 6) AS accuracy, round(avg(tp / t::DOUBLE) FILTER (t > 0), 6) AS balanced_accuracy, round(avg(2.0 * tp / (t + s)), 6)::DOUBLE AS f1 FROM e",
    "cls_binary": with_views("classified") + ", c AS (SELECT count(*) FILTER (p >= 0.5 AND y = 1)::DOUBLE AS tp, count(*) FILTER (p >= 0.5 AND y = 0)::DOUBLE AS fp, count(*) FILTER (p < 0.5 AND y = 1)::DOUBLE AS fn, count(*) FILTER (p < 0.5 AND y = 0)::DOUBLE AS tn, avg((p - y) ** 2) AS b FROM classified) SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(b, 6) AS brier FROM c",
    "cls_auroc_ap": with_views("classified", _SCORE) + "SELECT round((SELECT (sum(r) - any_value(p * (p + 1) / 2)) / any_value(p * n) FROM (SELECT y, avg(i) OVER (PARTITION BY s) AS r, sum(y) OVER ()::DOUBLE AS p, sum(1 - y) OVER ()::DOUBLE AS n FROM (SELECT y, p AS s, row_number() OVER (ORDER BY p) AS i FROM classified)) WHERE y = 1), 6) AS auroc, round(sum(pos::DOUBLE * tp / (tp + fp)) / any_value(pp), 6) AS average_precision FROM c",
    "cls_auroc_ovr": "WITH l AS (SELECT label AS y, c, round(embedding[c + 1]::DOUBLE, 6) AS p FROM embeddings, range(10) r(c)) SELECT round(avg(a), 6) AS auroc FROM (SELECT c, (sum(r) FILTER (y = c) - count(*) FILTER (y = c) * (count(*) FILTER (y = c) + 1) / 2.0) / (count(*) FILTER (y = c) * count(*) FILTER (y <> c))::DOUBLE AS a FROM (SELECT c, y, avg(i) OVER (PARTITION BY c, p) AS r FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p) AS i FROM l)) GROUP BY c)",
    "cls_roc_points": with_views("classified", _SCORE) + "SELECT round(p, 6) AS threshold, round(fp / nn, 6) AS fpr, round(tp / pp, 6) AS tpr FROM c",
    "cls_pr_points": with_views("classified", _SCORE) + "SELECT round(p, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall FROM c",
    "cls_calibration": with_views("classified") + "SELECT least(floor(p * 5)::INT, 4) AS bin, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed, count(*) AS n FROM classified GROUP BY 1",
    "cls_log_loss": with_views("classified") + "SELECT round(avg(-(y * ln(p * 0.9 + 0.05) + (1 - y) * ln(1 - (p * 0.9 + 0.05)))), 6)::DOUBLE AS log_loss FROM classified",
    "reg_metrics": with_views("regressed") + "SELECT round(avg(abs(y - yhat)) / 1e6, 5) AS mae, round(avg((y - yhat) ** 2) / 1e12, 5) AS mse, round(sqrt(avg((y - yhat) ** 2)) / 1e6, 5) AS rmse, round(1 - sum((y - yhat) ** 2) / sum((y - m) ** 2), 5) AS r2 FROM regressed, (SELECT avg(y) AS m FROM regressed)",
    "reg_losses": with_views("regressed") + "SELECT round(avg(e), 6) AS mae, round(avg(e * e), 6) AS mse, round(avg(CASE WHEN e <= 1 THEN 0.5 * e * e ELSE e - 0.5 END), 6) AS huber FROM (SELECT abs(y / 1e5 - yhat / 1e5) AS e FROM regressed)",
    "reg_residuals": with_views("regressed") + "SELECT round(avg((y - yhat) / 1e5), 6) AS mean, count(*) AS n FROM regressed",
    "km_curve": with_views("survival", _LIFE) + _KM.format(x="d"),
    "km_censoring": with_views("survival", _LIFE) + _KM.format(x="c"),
    "km_by_risk": with_views("survival") + ", m AS (SELECT *, CASE WHEN risk > (SELECT median(risk) FROM survival) THEN 'high' ELSE 'low' END AS \"group\" FROM survival), life AS (SELECT \"group\", time, sum(event) AS d, sum(count(*)) OVER (PARTITION BY \"group\" ORDER BY time DESC) AS n FROM m GROUP BY \"group\", time) SELECT DISTINCT \"group\", 0.0::DOUBLE AS time, 1.0::DOUBLE AS survival FROM m UNION ALL SELECT \"group\", time, round(CASE WHEN min(n - d) OVER w = 0 THEN 0 ELSE exp(sum(ln(greatest(1 - d / n::DOUBLE, 1e-300))) OVER w) END, 6) FROM life WHERE d > 0 WINDOW w AS (PARTITION BY \"group\" ORDER BY time)",
    "surv_event_times": with_views("survival", _TAU) + "SELECT tau FROM tau",
    "surv_c_index": with_views("survival") + f"SELECT round(c_index, 6) AS c_index, pairs FROM ({_C})",
    "surv_c_index_curve": with_views("survival", _TAU) + "SELECT tau, round(sum(CASE WHEN a.risk > b.risk THEN 1 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 6) AS c_index, count(*) AS pairs FROM tau JOIN survival a ON a.event = 1 AND a.time <= tau JOIN survival b ON a.time < least(b.time, tau) GROUP BY tau UNION ALL SELECT tau, NULL, 0 FROM tau WHERE NOT EXISTS (SELECT 1 FROM survival a, survival b WHERE a.event = 1 AND a.time <= tau AND a.time < least(b.time, tau))",
    "surv_td_auc": with_views("survival", _LIFE, _TAU, _G, _AUC) + "SELECT tau, round(auc, 6) AS auc FROM tau LEFT JOIN auc USING (tau)",
    "surv_brier_curve": with_views("survival", _LIFE, _TAU, _G, _SCALED) + ", t AS (SELECT tau, coalesce(max(cumulative), 0) AS h FROM tau LEFT JOIN b ON b.time <= tau GROUP BY tau), gt AS (SELECT tau, coalesce(arg_max(g, time), 1) AS gt FROM tau LEFT JOIN g ON g.time <= tau GROUP BY tau) SELECT tau, round(avg(CASE WHEN x.time <= tau AND event = 1 THEN exp(-h * exp(risk)) ** 2 / g WHEN x.time > tau THEN (1 - exp(-h * exp(risk))) ** 2 / gt ELSE 0 END), 6) AS brier FROM x JOIN g ON g.time = x.time CROSS JOIN t JOIN gt USING (tau) GROUP BY tau",
    "surv_breslow": with_views("survival", _SCALED) + "SELECT time, round(cumulative, 6) AS cumulative FROM b",
    "surv_cox_loss": with_views("survival", _SCALED) + "SELECT round(sum(d * ln(at_) - r) / sum(d), 6) AS cox_loss FROM h",
    "surv_bin_widths": with_views("survival") + ", e AS (SELECT floor(time / 400)::BIGINT AS bin, min(time) AS first, max(time) AS last FROM survival GROUP BY 1), l AS (SELECT bin, coalesce((lag(last) OVER (ORDER BY bin) + first) / 2, first) AS low, coalesce((last + lead(first) OVER (ORDER BY bin)) / 2, last) AS high FROM e) SELECT bin, round(low, 6) AS low, round(high, 6) AS high, round(CASE WHEN high > low THEN high - low ELSE coalesce((SELECT median(high - low) FROM l WHERE high > low), 1) END, 6) AS width FROM l",
    "surv_summary": with_views("survival", _LIFE, _TAU, _G, _AUC) + f", c AS ({_C}) SELECT round(any_value(c_index), 6) AS c_index, round(avg(auc), 6) AS mean_auc, round(min(auc), 6) AS min_auc, round(max(auc), 6) AS max_auc, count(*) AS times FROM tau LEFT JOIN auc USING (tau), c",
}
