"""Column names with dots and blanks over every public operator: same results as with plain names."""

import datetime

import pytest
from pyspark.sql import functions as F

from sparkprep.operators import anomaly as AN
from sparkprep.operators import clean as C
from sparkprep.operators import cluster as CL
from sparkprep.operators import correlate as R
from sparkprep.operators import evaluate as E
from sparkprep.operators import groupby as G
from sparkprep.operators import outliers as O
from sparkprep.operators import prep as PR
from sparkprep.operators import profile as P
from sparkprep.operators import reduce as RD
from sparkprep.operators import rules as RU
from sparkprep.operators import sampling as S
from sparkprep.operators import scan
from sparkprep.operators import supervised as SV
from sparkprep.operators import unsupervised as U
from sparkprep.sources import ingest as I

DOTTED, PLAIN = ["i.d", "g.r", "price.usd", "x y", "d.t", "f.l"], ["i_d", "g_r", "price_usd", "x_y", "d_t", "f_l"]
ROWS = [(i, f"g{i % 3}" if i % 4 else None, float(i % 7) if i % 5 else None, float((i * 37) % 11), datetime.date(2020, 1, 1 + i % 20), i % 2) for i in range(60)]


def operators(df, k, g, v, w, d, f):
    known = df.filter(F.col(f"`{v}`").isNotNull())
    return {
        "nan": lambda: I.nan_to_null(df),
        "peek": lambda: I.schema_peek(df, [k], 3),
        "schemaf": lambda: I.schema_frame(df),
        "describe": lambda: P.describe(df),
        "profile": lambda: P.feature_profile(df),
        "profile_o": lambda: P.feature_profile(df, order_by=[k]),
        "dsinfo": lambda: P.dataset_info(df),
        "dup": lambda: P.duplicate_rows(df),
        "missing": lambda: P.missing_by_column(df),
        "statsn": lambda: P.stats_numeric(df),
        "statsc": lambda: P.stats_categorical(df),
        "statsd": lambda: P.stats_date(df),
        "nuni": lambda: P.nunique(df),
        "colinfo": lambda: P.column_info(df, [k]),
        "problem": lambda: P.problem_type(df, v),
        "ddfirst": lambda: C.drop_duplicates(df, [g], "first", [k]),
        "ddnone": lambda: C.drop_duplicates(df, [g, f], "none"),
        "ddall": lambda: C.drop_duplicates(df),
        **{f"fill_{m}": (lambda m=m: C.fill_missing(df, v, m, order_by=[k])) for m in C.FILL_METHODS},
        "fillby": lambda: C.fill_missing(df, v,
        "forward_fill", order_by=[d, k], by=[g]),
        "fillmodet": lambda: C.fill_missing(df, g,
        "mode"),
        **{f"type_{m}": (lambda m=m: C.convert_type(df, v, m)) for m in C.TYPE_CHOICES},
        **{f"enc_{m}": (lambda m=m: C.encode(df, g, m)) for m in C.ENCODINGS},
        **{f"out_{m}": (lambda m=m: C.remove_outliers(df, v, m)) for m in C.OUTLIER_METHODS},
        "odetect": lambda: O.detect_outliers(df, v, "IQR"),
        "oflag": lambda: O.flag_outliers(df, v, "IQR", "is.out"),
        "osample": lambda: O.outlier_sample(df, v, [k]),
        "oover": lambda: O.outlier_overview(df),
        "ohist": lambda: O.histogram(df, v),
        "obox": lambda: O.box_stats(df, v),
        "oscat": lambda: O.index_scatter(df, v, [k]),
        "pear": lambda: R.correlate(df, [v, w], "pearson"),
        "spear": lambda: R.correlate(df, [v, w], "spearman"),
        "spear2": lambda: R.correlate(df, [k, w], "spearman"),
        "kend": lambda: R.correlate(df, [v, w], "kendall"),
        "samplen": lambda: S.sample_n(df, k, 5),
        "topk": lambda: S.top_k(df, v, 3, tiebreak=k),
        "argmax": lambda: S.argmax(df, g, v, k),
        "search": lambda: S.search(df, [g], "g1"),
        "page": lambda: S.page(df, [k], 1, 5),
        "glist": lambda: G.two_level_list(df, g, v, [k],
        "l"),
        "gagg": lambda: G.group_aggregate(df, g, v, "sum", [k]),
        "baskets": lambda: G.baskets(df, k, g),
        "impute": lambda: PR.impute(df, [v, g]),
        "scale": lambda: PR.standard_scale(df, [v, w]),
        "split": lambda: PR.stratified_split(df, k, g, 0.2, "42"),
        "folds": lambda: PR.assign_folds(df, k, g, 3, "42"),
        "avg_rank": lambda: scan.average_rank(df, v),
        "codes": lambda: scan.dense_codes(df, g),
        "prefix": lambda: scan.prefix_sums(df, [d, k], [w], [g]),
        "carry": lambda: scan.carry_fill(df, v, [d, k], [g]),
        "quant": lambda: scan.exact_quantiles(df, [v, w], [.5]),
        "dbscan": lambda: CL.dbscan_labels(df, k, [v, w], 2.0, 3),
        "pca": lambda: RD.variance_ratio(PR.impute(df, [v, w]), [v, w], 2),
        "iso": lambda: AN.isolation_forest(df, k, [v, w], 5),
        "svm": lambda: AN.one_class_svm(PR.impute(df, [v, w]), k, [v, w]),
        "train": lambda: SV.train_models(df, k, f, [v, w, g], "classification", ["logistic_regression", "knn", "random_forest"], {"random_forest": {"n_estimators": 2}})[1],
        "imp": lambda: SV.feature_importance(df, k, f, [v, w, g], "classification", "logistic_regression"),
        "cv": lambda: SV.cross_validate(df, k, f, [v, w, g], "classification", "logistic_regression", 2),
        "bin": lambda: RU.binarize(df, [v, f, g]),
        "unsup": lambda: U.train_unsupervised(df, k, [v, w], "clustering", ["kmeans", "agglomerative", "dbscan"]),
        "roc": lambda: E.roc_auc(known, y_true=f, y_score=v),
        "cm": lambda: E.classification_metrics(df, y_true=f, y_pred=f),
        "reg": lambda: E.regression_metrics(known, y_true=v, y_pred=w),
        "qq": lambda: E.qq_points(df, w),
        "rocby": lambda: E.roc_auc(known, by=[g], y_true=f, y_score=v),
    }


SPECIAL = {"train", "imp", "cv", "unsup", "iso", "svm"}  # trained: only run


def shown(result, names, to):
    rows = (result[0] if isinstance(result, tuple) else result)
    rows = rows.collect() if hasattr(rows, "collect") else [rows]
    text = sorted(str(tuple(r) if hasattr(r, "asDict") else r) for r in rows)
    for a, b in zip(names, to, strict=True):
        text = [t.replace(a, b) for t in text]
    return sorted(text)


def test_dotted_names_give_the_results_of_plain_ones(spark):
    frames = [spark.createDataFrame(ROWS, ", ".join(f"`{n}` {t}" for n, t in zip(names, ("long", "string", "double", "double", "date", "int"), strict=True))) for names in (DOTTED, PLAIN)]
    dotted, plain = (operators(frame, *names) for frame, names in zip(frames, (DOTTED, PLAIN), strict=True))
    assert len(dotted) > 70
    for name, run in dotted.items():
        got = shown(run(), DOTTED, PLAIN)
        assert got and not any("cannot be resolved" in t for t in got), name
        assert name in SPECIAL or got == shown(plain[name](), PLAIN, PLAIN), name


def test_schema_and_select_of_odd_names(spark):
    df = spark.createDataFrame([(1, 2.0)], "`a.b` int, `c``d` double")
    assert [tuple(r) for r in I.nan_to_null(spark.createDataFrame([(float("nan"), 1)], "`x.y` double, z int")).collect()] == [(None, 1)]
    assert [tuple(r) for r in C.fill_missing(df, "a.b", "mean").collect()] == [(1, 2.0)]
    with pytest.raises(ValueError):
        C.fill_missing(df, "a", "mean")
