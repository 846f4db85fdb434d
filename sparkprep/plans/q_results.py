"""Model-results (S16, S18, S19, L1-L7) and detection (D2-D6, J2) queries.

The ``model_results`` table is computed from the given tables: the three
threshold models of the events score (classification, train/test split by
user) and two order-price predictors (regression).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detections as DT
from ..operators import evaluate as E
from ..operators import results as RS
from ..session import scratch_path
from ..functions.scalar import sig_round, sig_round_sql, rnd
from .q_eval import D, LINE_TOTAL_SQL, MODELS_SQL, THRESHOLDS, _metrics_sql, _r, dec, line_total
from .registry import query
from .tables import t

CLS_METRICS = ["accuracy", "precision", "recall", "f1"]
REG_METRICS = ["r2", "rmse", "mae", "mse"]
CREATED = {"events": "2024-01-02 10:00:00", "orders": "2024-01-03 09:30:00"}


def model_results(spark, sf) -> DataFrame:
    ev = t(spark, sf, "events")
    mx = ev.agg(F.max("value")).first()[0]
    score = rnd(F.col("value") / F.lit(float(mx)), 4)
    thr = F.explode(F.array(*[F.struct(F.lit(f"thr_{x}").alias("model"), F.lit(x).alias("thr")) for x in THRESHOLDS]))
    base = ev.select(F.when(F.col("user_id") % 5 == 0, "test").otherwise("train").alias("split"),
                     (F.col("event_type") == "purchase").cast("int").alias("y_true"), score.alias("y_score"), thr.alias("m"))
    pred = base.select(F.col("m.model").alias("algorithm"), "split", "y_true",
                       (F.col("y_score") >= F.col("m.thr")).cast("int").alias("y_pred"))
    cm = _r(E.classification_metrics(pred, ["algorithm", "split"]))
    cls = RS.to_long(cm, ["algorithm", "split"], CLS_METRICS).select(
        F.lit("p_events").alias("project_id"), F.lit("m_events_thresholds").alias("model_id"), "algorithm",
        F.lit("classification").alias("problem_type"), "split", "metric", "value",
        F.lit(CREATED["events"]).alias("created_at"), F.lit(None).cast("string").alias("error"))
    li = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        line_total().alias("line_total"), F.sum(dec("l_extendedprice")).cast("double").alias("line_gross"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("y_true"))
    j = o.join(li, "l_orderkey")
    alg = F.explode(F.array(F.struct(F.lit("line_total").alias("a"), F.col("line_total").alias("p")),
                            F.struct(F.lit("line_gross").alias("a"), F.col("line_gross").alias("p"))))
    rp = j.select("y_true", alg.alias("x")).select(F.col("x.a").alias("algorithm"), "y_true", F.col("x.p").alias("y_pred"))
    rm = _r(E.regression_metrics(rp, ["algorithm"])).withColumn("mse", sig_round(F.col("mse")))
    reg = RS.to_long(rm, ["algorithm"], REG_METRICS).select(
        F.lit("p_orders").alias("project_id"), F.lit("m_orders_price").alias("model_id"), "algorithm",
        F.lit("regression").alias("problem_type"), F.lit("test").alias("split"), "metric", "value",
        F.lit(CREATED["orders"]).alias("created_at"), F.lit(None).cast("string").alias("error"))
    return cls.unionByName(reg)


def _results_sql() -> str:
    ms = MODELS_SQL.replace("SELECT model, y_true", "SELECT model, split, y_true").replace(
        "CAST(event_type = 'purchase' AS INTEGER) AS y_true,",
        "CAST(event_type = 'purchase' AS INTEGER) AS y_true, CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,")
    cm = _metrics_sql(f"(SELECT model AS algorithm, split, y_true, y_pred FROM {ms})", "algorithm, split")
    reg = f"""(SELECT algorithm, count(*) AS n, avg((y_true - y_pred) * (y_true - y_pred)) AS mse,
       avg(abs(y_true - y_pred)) AS mae, sum((y_true - y_pred) * (y_true - y_pred)) AS ss_res, var_pop(y_true) AS var_y
     FROM (SELECT o.o_totalprice AS y_true, x.algorithm, x.y_pred FROM orders o JOIN
       (SELECT l_orderkey, {LINE_TOTAL_SQL} AS lt, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS lg
        FROM lineitem GROUP BY l_orderkey) p ON o.o_orderkey = p.l_orderkey,
       LATERAL (SELECT * FROM (VALUES ('line_total', p.lt), ('line_gross', p.lg)) v(algorithm, y_pred)) x)
     GROUP BY algorithm)"""
    return f"""WITH cm AS ({cm}),
cl AS (SELECT 'p_events' AS project_id, 'm_events_thresholds' AS model_id, algorithm, 'classification' AS problem_type, split,
       metric, CAST(value AS DOUBLE) AS value, '{CREATED["events"]}' AS created_at, CAST(NULL AS VARCHAR) AS error
       FROM (UNPIVOT (SELECT algorithm, split, accuracy, precision, recall, f1 FROM cm) ON accuracy, precision, recall, f1
             INTO NAME metric VALUE value)),
rm AS (SELECT algorithm, round(CASE WHEN var_y * n = 0 THEN (CASE WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - ss_res / (var_y * n) END, {D}) AS r2,
       round(sqrt(mse), {D}) AS rmse, round(mae, {D}) AS mae, {sig_round_sql('mse')} AS mse FROM {reg} r),
rg AS (SELECT 'p_orders' AS project_id, 'm_orders_price' AS model_id, algorithm, 'regression' AS problem_type, 'test' AS split,
       metric, CAST(value AS DOUBLE) AS value, '{CREATED["orders"]}' AS created_at, CAST(NULL AS VARCHAR) AS error
       FROM (UNPIVOT rm ON r2, rmse, mae, mse INTO NAME metric VALUE value))
SELECT * FROM cl UNION ALL SELECT * FROM rg"""


RESULTS_SQL = _results_sql()


@query("model_results", RESULTS_SQL)
def q_model_results(spark, sf):
    """The long model_results table (one row per run, algorithm, split, metric)."""
    return model_results(spark, sf)


@query("results_sink", RESULTS_SQL)
def q_results_sink(spark, sf):
    """Two runs appended to the results table in the shared folder, and read back."""
    path, r = scratch_path(spark, "results-sink"), model_results(spark, sf)
    for run in ("m_events_thresholds", "m_orders_price"):
        RS.append_results(RS.load_results(r, run), path)
    return RS.read_results(spark, path)


@query("load_results", f"SELECT * FROM ({RESULTS_SQL}) WHERE model_id = 'm_orders_price'")
def q_load_results(spark, sf):
    """Results of one run by id."""
    return RS.load_results(model_results(spark, sf), "m_orders_price")


@query("display_score", f"""WITH r AS ({RESULTS_SQL})
SELECT project_id, model_id, problem_type, round(max(s), 1) AS display_score, any_value(label) AS score_label FROM (
  SELECT project_id, model_id, problem_type,
    CASE WHEN problem_type = 'classification' AND metric = 'accuracy' THEN value
         WHEN problem_type = 'regression' AND metric = 'r2' THEN greatest(value, 0.0) END * 100 AS s,
    CASE WHEN problem_type = 'classification' THEN 'Accuracy' WHEN problem_type = 'regression' THEN 'R2 Score' END AS label
  FROM r WHERE error IS NULL AND value IS NOT NULL AND (split IS NULL OR split = 'test'))
WHERE s IS NOT NULL GROUP BY ALL""")
def q_display_score(spark, sf):
    """L2: 0-100 display score per run (best algorithm)."""
    return RS.display_score(model_results(spark, sf))


@query("best_metric", f"""WITH r AS ({RESULTS_SQL}),
c AS (SELECT *, CASE WHEN problem_type = 'classification' THEN list_position(['accuracy','f1','precision','recall'], metric) - 1
                     WHEN problem_type = 'regression' THEN list_position(['r2','rmse','mae'], metric) - 1 END AS p,
             CASE WHEN metric IN ('rmse','mae','mse','log_loss','davies_bouldin_score','kl_divergence') THEN -value ELSE value END AS o
      FROM r WHERE error IS NULL AND value IS NOT NULL AND (split IS NULL OR split = 'test'))
SELECT project_id, model_id, problem_type, arg_min(metric, (p, -o, algorithm)) AS metric,
  round(arg_min(value, (p, -o, algorithm)), 4) AS value, arg_min(algorithm, (p, -o, algorithm)) AS algorithm
FROM c WHERE p IS NOT NULL GROUP BY ALL""")
def q_best_metric(spark, sf):
    """L3: headline metric of each run with ordered fallbacks."""
    return RS.best_metric(model_results(spark, sf))


@query("best_model", f"""WITH r AS ({RESULTS_SQL})
SELECT project_id, model_id, algorithm AS best_algorithm, value FROM r
WHERE metric = 'accuracy' AND split = 'test' AND error IS NULL
QUALIFY row_number() OVER (PARTITION BY project_id, model_id ORDER BY value DESC, algorithm) = 1""")
def q_best_model(spark, sf):
    """Best algorithm of each run by test accuracy (first wins ties)."""
    return RS.best_model(model_results(spark, sf), "accuracy")


@query("compare_models", f"""WITH r AS ({RESULTS_SQL}),
runs AS (SELECT *, CASE WHEN problem_type = 'regression' THEN 'm_orders_price' WHEN algorithm IN ('thr_0.05', 'thr_0.2') THEN 'm_a' ELSE 'm_b' END AS run
         FROM r WHERE split = 'test' AND error IS NULL AND value IS NOT NULL),
best AS (SELECT run, arg_min(algorithm, (-value, algorithm)) AS algorithm FROM runs WHERE metric = 'accuracy' GROUP BY run),
a AS (SELECT metric, value AS value_a FROM runs JOIN best USING (run, algorithm) WHERE run = 'm_a'),
b AS (SELECT metric, value AS value_b FROM runs JOIN best USING (run, algorithm) WHERE run = 'm_b')
SELECT metric, value_a, value_b, abs(value_a - value_b) AS difference,
  CASE WHEN value_a IS NULL OR value_b IS NULL THEN 'tie' WHEN abs(value_a - value_b) < 0.001 THEN 'tie'
       WHEN metric IN ('rmse','mae','mse','log_loss','davies_bouldin_score','kl_divergence') THEN CASE WHEN value_a < value_b THEN 'A' ELSE 'B' END
       ELSE CASE WHEN value_a > value_b THEN 'A' ELSE 'B' END END AS winner,
  CASE WHEN abs(value_a - value_b) > 0.15 THEN 'Significant' WHEN abs(value_a - value_b) > 0.08 THEN 'Moderate'
       WHEN abs(value_a - value_b) > 0.03 THEN 'Marginal' ELSE 'Minimal' END AS gap_level
FROM a FULL JOIN b USING (metric)""")
def q_compare_models(spark, sf):
    """Two runs' best algorithms, metric by metric: winner (direction, 0.001 tie band) and gap level."""
    run = F.when(F.col("problem_type") == "regression", F.col("model_id")).when(F.col("algorithm").isin("thr_0.05", "thr_0.2"), "m_a").otherwise("m_b")
    return RS.compare_models(model_results(spark, sf).withColumn("model_id", run), "m_a", "m_b")


@query("essential_metrics", f"""WITH r AS ({RESULTS_SQL})
SELECT * FROM r WHERE (problem_type = 'classification' AND metric IN ('accuracy','precision','recall','f1'))
  OR (problem_type = 'regression' AND metric IN ('r2','rmse','mae'))""")
def q_essential_metrics(spark, sf):
    """Essential metrics of each problem type."""
    return RS.essential_metrics(model_results(spark, sf))


@query("project_models", f"""WITH r AS ({RESULTS_SQL}),
runs AS (SELECT project_id, model_id, max(created_at) AS created_at, max(CAST(error IS NOT NULL AS INTEGER)) AS failed FROM r GROUP BY ALL)
SELECT project_id, count(*) AS models, CAST(sum(failed) AS BIGINT) AS failed_models, max(created_at) AS latest FROM runs GROUP BY project_id""")
def q_project_models(spark, sf):
    """L1: projects with model counts, newest first."""
    return RS.project_models(model_results(spark, sf))


# ------------------------------------------------------------------ detections
# The label table of the example detector (public COCO names).
CLASS_NAMES = {0: "person", 1: "bicycle", 2: "car", 3: "motorcycle", 4: "airplane", 5: "bus"}


def raw_detections(spark, sf) -> DataFrame:
    """One raw box per event: image = user, class from props.k, confidence = value / 500."""
    e = t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    x1 = ((F.col("event_id") * 37) % 640).cast("double") + 0.75
    y1 = ((F.col("event_id") * 53) % 480).cast("double") + 0.25
    return e.select(F.concat(F.lit("img_"), F.col("user_id").cast("string")).alias("image_id"),
                    F.col("event_id").alias("box_id"), (k % 8).alias("class_id"),
                    (F.col("value") / 500.0).alias("confidence"), x1.alias("x1"), y1.alias("y1"),
                    (x1 + 10.5 + F.col("value") % 100).alias("x2"), (y1 + 5.5 + k * 1.5).alias("y2"))


RAW_SQL = """(SELECT 'img_' || CAST(user_id AS VARCHAR) AS image_id, event_id AS box_id,
  CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS class_id, value / 500.0 AS confidence,
  CAST((event_id * 37) % 640 AS DOUBLE) + 0.75 AS x1, CAST((event_id * 53) % 480 AS DOUBLE) + 0.25 AS y1,
  CAST((event_id * 37) % 640 AS DOUBLE) + 0.75 + 10.5 + fmod(value, 100) AS x2,
  CAST((event_id * 53) % 480 AS DOUBLE) + 0.25 + 5.5 + CAST(json_extract_string(props, '$.k') AS INTEGER) * 1.5 AS y2
  FROM events)"""
NAMES_SQL = "(VALUES " + ", ".join(f"({k}, '{v}')" for k, v in CLASS_NAMES.items()) + ") n(class_id, class_name)"


def _post_sql(thr: float) -> str:
    return f"""(SELECT image_id, box_id, CASE WHEN confidence > {thr} THEN name ELSE name || ' (Low Confidence)' END AS name,
  round(confidence, 3) AS confidence, x, y, w, h FROM (
  SELECT d.*, coalesce(n.class_name, 'Class_' || CAST(d.class_id AS VARCHAR)) AS name,
    CAST(trunc(x1) AS INTEGER) AS x, CAST(trunc(y1) AS INTEGER) AS y, CAST(trunc(x2 - x1) AS INTEGER) AS w,
    CAST(trunc(y2 - y1) AS INTEGER) AS h,
    max(CAST(confidence > {thr} AS INTEGER)) OVER (PARTITION BY image_id) AS any_above,
    row_number() OVER (PARTITION BY image_id ORDER BY confidence DESC, box_id) AS rk
  FROM {RAW_SQL} d LEFT JOIN {NAMES_SQL} USING (class_id)) z
  WHERE confidence > {thr} OR (any_above = 0 AND rk = 1))"""


def _post(spark, sf, thr):
    names = DT.class_names_frame(spark, CLASS_NAMES)
    return DT.postprocess(raw_detections(spark, sf), names, thr)


@query("detections_filter", f"SELECT * FROM {_post_sql(0.25)} p")
def q_detections_filter(spark, sf):
    """Boxes above 0.25 with names, xywh and 3-dp confidence."""
    return _post(spark, sf, 0.25)


@query("detections_fallback", f"SELECT * FROM {_post_sql(0.8)} p")
def q_detections_fallback(spark, sf):
    """D3: images with no box above the threshold keep their best box (low confidence)."""
    return _post(spark, sf, 0.8)


@query("bbox_xywh", f"""SELECT box_id, CAST(trunc(x1) AS INTEGER) AS x, CAST(trunc(y1) AS INTEGER) AS y,
  CAST(trunc(x2 - x1) AS INTEGER) AS w, CAST(trunc(y2 - y1) AS INTEGER) AS h FROM {RAW_SQL} d""")
def q_bbox_xywh(spark, sf):
    """Xyxy -> truncated integer xywh."""
    return DT.to_xywh(raw_detections(spark, sf)).select("box_id", "x", "y", "w", "h")


@query("class_lookup", f"""SELECT box_id, coalesce(class_name, 'Class_' || CAST(class_id AS VARCHAR)) AS name
FROM {RAW_SQL} d LEFT JOIN {NAMES_SQL} USING (class_id)""")
def q_class_lookup(spark, sf):
    """Class name by id with the Class_<id> fallback (broadcast lookup)."""
    names = DT.class_names_frame(spark, CLASS_NAMES)
    return DT.resolve_names(raw_detections(spark, sf), names).select("box_id", "name")


@query("detections_summary", f"""SELECT image_id, CAST(count(*) AS BIGINT) AS total_objects,
  round(avg(confidence), 3) AS average_confidence FROM {_post_sql(0.5)} p GROUP BY image_id""")
def q_detections_summary(spark, sf):
    """Objects per image and mean confidence."""
    return DT.summary(_post(spark, sf, 0.5))
