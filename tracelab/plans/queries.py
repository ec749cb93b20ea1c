"""Registered queries: name -> callable(spark, folder) over the benchmark tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelab.operators import classifiers as cl
from tracelab.operators import evaluation as ev
from tracelab.operators import features as ft
from tracelab.operators import neighbours as nb
from tracelab.operators import sampling as sm
from tracelab.operators import scale as sc
from tracelab.operators import sites as st
from tracelab.operators import status, trees
from tracelab.operators import weights as wt
from tracelab.operators import world as wd
from tracelab.operators.ordered import OrderedGroups
from tracelab.plans import experiment as ex
from tracelab.plans.tree_oracle import EXTRA, SINGLE
from tracelab.session import durable, shared_folder
from tracelab.sources import adapters as src
from tracelab.sources import feature_files as ff
from tracelab.sources import results as rs
from tracelab.sources import tables as tb
from tracelab.sources import trace_log as tl
from tracelab.streaming.trace_stream import append_all_records, append_new_logs, stored_cells, stored_rejects

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded so that two engines agree on the printed value."""
    return df.selectExpr(
        *[f"round({f.name}, {digits}) as {f.name}" if f.dataType.typeName() == "double" else f.name for f in df.schema.fields]
    )


# --- features ------------------------------------------------------------------------


@query
def example_list(spark, folder):
    return ft.example_list(src.traces(spark, folder))


def numbered(spark, folder):
    return ft.number_cells(src.traces(spark, folder))


@query
def cell_positions(spark, folder):
    return numbered(spark, folder).select("exampleid", "cellid", "ingoing", "position")


@query
def outgoing_positions_long(spark, folder):
    n = numbered(spark, folder).where(~F.col("ingoing") & (F.col("outgoing_rank") <= ft.NUM_POSITIONS))
    return n.select("exampleid", F.col("outgoing_rank").alias("cell_order"), "position")


@query
def cell_numbers(spark, folder):
    return ft.cell_numbers(src.traces(spark, folder))


@query
def cell_timings(spark, folder):
    return ft.cell_timings(src.traces(spark, folder))


@query
def intercell_timings(spark, folder):
    return rounded(ft.intercell_timings(numbered(spark, folder)))


@query
def initial_directions(spark, folder):
    return ft.widen(ft.initial_directions(src.traces(spark, folder)))


@query
def outgoing_positions(spark, folder):
    return ft.widen(ft.outgoing_positions(numbered(spark, folder)))


@query
def position_differences(spark, folder):
    return ft.widen(ft.position_differences(numbered(spark, folder)))


@query
def windowed_counts(spark, folder):
    return ft.widen(ft.windowed_counts(numbered(spark, folder)))


@query
def bursts(spark, folder):
    return ft.bursts(numbered(spark, folder))


@query
def burst_aggregates(spark, folder):
    return rounded(ft.burst_aggregates(ft.bursts(numbered(spark, folder))))


@query
def burst_thresholds(spark, folder):
    return ft.widen(ft.burst_thresholds(ft.bursts(numbered(spark, folder))))


@query
def burst_lengths(spark, folder):
    return ft.widen(ft.burst_lengths(ft.bursts(numbered(spark, folder))))


@query
def master_matrix(spark, folder):
    return ft.widen(rounded(ft.feature_families(numbered(spark, folder))))


@query
def master_matrix_long(spark, folder):
    """The matrix of three traces of thousands of cells, so that all positions, windows and bursts are filled."""
    cells = src.traces(spark, folder).withColumn("exampleid", F.col("exampleid") % 3)
    return ft.widen(rounded(ft.feature_families(ft.number_cells(cells))))


# --- world, sites, status -------------------------------------------------------------

NOW = datetime(2001, 8, 2)
LOOKBACK = "52w"
LINK_PATTERN = 'href="([^"]+)"'
PARTIAL_PATTERN = 'href="/[a-c]'  # only some pages hold such a link
CLASS_RULES = [
    ("sd_fr", "contains(text, 'lang=\"fr\"')"),
    ("sd_de", "contains(text, 'lang=\"de\"')"),
    ("nonmonitored", "not contains(text, 'lang=\"en\"')"),
]


@query
def labelled_world(spark, folder):
    families = rounded(ft.feature_families(numbered(spark, folder)))
    return ft.widen(wd.labelled_world(families, src.examples(spark, folder), src.sites(spark, folder)))


@query
def labelled_world_open(spark, folder):
    features = ft.cell_numbers(src.traces(spark, folder))
    return wd.labelled_world(features, src.examples(spark, folder), src.sites(spark, folder), "open")


@query
def imputed_matrix(spark, folder):
    return ft.widen(ft.impute(rounded(ft.feature_families(numbered(spark, folder)))))


@query
def ordered_trace(spark, folder):
    return ft.ordered_cells(src.traces(spark, folder))


@query
def merged_cells(spark, folder):
    return wd.merged_cells(src.examples(spark, folder), src.sites(spark, folder), src.traces(spark, folder))


@query
def recent_sites(spark, folder):
    return st.recent_sites(src.sites_sorted(spark, folder), NOW, LOOKBACK)


@query
def site_classes(spark, folder):
    return st.site_classes(src.sites_sorted(spark, folder), NOW, LOOKBACK)


@query
def url_ids(spark, folder):
    return st.url_ids(st.recent_sites(src.sites_sorted(spark, folder), NOW, LOOKBACK))


@query
def url_ids_clash(spark, folder):
    """Ids of addresses that several sites share, of both classes."""
    shared = F.concat(F.lit("http://site"), F.col("hsid") % 97, F.lit(".onion"))
    return st.url_ids(st.recent_sites(src.sites_sorted(spark, folder).withColumn("hs_url", shared), NOW, LOOKBACK))


@query
def empty_pages_partly(spark, folder):
    """Pages without a link of a form that only some pages hold."""
    return st.empty_pages(src.table(spark, folder, "pages"), PARTIAL_PATTERN, 0)


@query
def page_links(spark, folder):
    return st.page_links(src.table(spark, folder, "pages"), LINK_PATTERN, 1, "http://directory")


@query
def empty_pages(spark, folder):
    return st.empty_pages(src.table(spark, folder, "pages"))


@query
def page_classes(spark, folder):
    return st.classified(src.table(spark, folder, "pages"), CLASS_RULES)


@query
def site_append(spark, folder):
    classes = st.classified(src.table(spark, folder, "pages"), CLASS_RULES)
    return st.site_rows(classes, NOW)


@query
def append_sites(spark, folder):
    """The classified pages of two rounds, appended with keys and read back."""
    path = _scratch(spark)
    rows = st.site_rows(st.classified(src.table(spark, folder, "pages"), CLASS_RULES), NOW)
    tb.append_sites(rows, path)
    return tb.append_sites(rows, path).select("hsid", "hs_url", "is_sd", "sorted_class")


@query
def append_crawls(spark, folder):
    """Suppliers as control records of crawls, appended with keys and read back."""
    path = _scratch(spark)
    rows = src.table(spark, folder, "supplier").select(
        F.col("s_name").alias("entry_node"), F.col("s_nationkey").cast("int").alias("asn"), F.lit("amd64").alias("os")
    )
    return tb.append_crawls(rows, path).select("crawlid", "entry_node", "asn", "os", "city")


@query
def daily_examples(spark, folder):
    return status.rows_per_day(src.examples(spark, folder), "t_scrape")


@query
def daily_distinct_sites(spark, folder):
    return status.sites_per_day(src.examples(spark, folder), "t_scrape")


@query
def distinct_sites(spark, folder):
    return status.distinct_sites(src.examples(spark, folder))


@query
def totals(spark, folder):
    return status.totals(
        {"examples": src.examples(spark, folder), "sites": src.sites(spark, folder), "traces": src.traces(spark, folder)}
    )


@query
def last_seen(spark, folder):
    return status.last_seen(src.sites_sorted(spark, folder), "t_sort")


# --- sampling ------------------------------------------------------------------------


def _dev_examples(spark, folder):
    return sm.row_slice(src.examples(spark, folder), "exampleid", 100, 200)


@query
def dev_sample(spark, folder):
    return _dev_examples(spark, folder)


@query
def semi_sites(spark, folder):
    return sm.restrict(src.sites(spark, folder), _dev_examples(spark, folder), "hsid")


@query
def semi_cells(spark, folder):
    return sm.restrict(src.traces(spark, folder), _dev_examples(spark, folder), "exampleid")


@query
def masked_sample(spark, folder):
    orders = src.table(spark, folder, "orders")
    # What stands in for the masked columns.
    return sm.masked(orders, {"o_orderstatus": "X", "o_orderpriority": "1A2B3C4D"})


@query
def pseudonymised_sites(spark, folder):
    words = src.table(spark, folder, "nation").select(F.col("n_nationkey").cast("bigint").alias("i"), F.lower("n_name").alias("word"))
    return sm.pseudonymised(src.sites(spark, folder), words, seed=7)


@query
def stratified_folds(spark, folder):
    labels = src.scores(spark, folder).select("exampleid", "label")
    return sm.stratified_folds(labels, "exampleid", k=10, seed=1)


@query
def interleave_plan(spark, folder):
    return sm.interleave_plan(src.sites(spark, folder), ratio=40, seed=3)


@query
def shuffled_sites(spark, folder):
    return sm.shuffled_rank(src.sites(spark, folder).select("hsid"), "hsid", [], seed=5)


@query
def open_world_split(spark, folder):
    world = src.examples(spark, folder).join(src.sites(spark, folder), "hsid")
    world = world.select("exampleid", "hs_url", F.col("is_sd").cast("int").alias("label"))
    return sm.open_world_split(world, 0.20, k=10, seed=2)


# --- evaluation ----------------------------------------------------------------------


def _fold_scores(spark, folder):
    return sm.stratified_folds(src.scores(spark, folder), "exampleid", k=10, seed=1)


@query
def roc_points(spark, folder):
    return rounded(ev.roc_points(src.scores(spark, folder)), 6)


@query
def roc_corners(spark, folder):
    return rounded(ev.roc_points(src.scores(spark, folder), drop_intermediate=True), 6)


@query
def auc(spark, folder):
    return rounded(ev.auc(src.scores(spark, folder)), 6)


@query
def precision_at_k(spark, folder):
    return rounded(ev.top_share(src.scores(spark, folder), [t / 100 for t in ev.THRESHOLDS]), 6)


@query
def fold_metrics(spark, folder):
    return rounded(ev.fold_metrics(_fold_scores(spark, folder), ["fold"]), 6)


@query
def fold_averages(spark, folder):
    folds = ev.fold_metrics(_fold_scores(spark, folder).withColumn("model_id", F.lit("n_chars")), ["model_id", "fold"])
    return rounded(ev.average_metrics(folds, ["model_id"]), 6)


@query
def mean_roc(spark, folder):
    return rounded(ev.mean_roc(_fold_scores(spark, folder)), 6)


# --- neighbours ----------------------------------------------------------------------

FIRST_OPEN_SITE = 8  # sites from here on act as the open world


def _knn_instances(spark, folder):
    i = src.instances(spark, folder)
    return i.select("id", nb.site_class(F.col("site"), FIRST_OPEN_SITE, F.col("site") >= FIRST_OPEN_SITE).alias("site"), "features")


def _flat_weights(dims=64):
    return [1.0] * dims


@query
def knn_neighbours(spark, folder):
    i = src.instances(spark, folder)
    return rounded(nb.nearest(i, i, 5).select("id", "rank", "neighbour", "dist"), 6)


@query
def knn_euclidean(spark, folder):
    i = src.instances(spark, folder)
    return rounded(nb.nearest(i, i, 5, metric="euclidean", missing=None).select("id", "rank", "neighbour", "dist"), 6)


@query
def knn_missing(spark, folder):
    """Neighbours where features are missing here and there."""
    i = src.instances(spark, folder)
    holes = F.transform("features", lambda x, j: F.when((F.col("id") * 7 + j * 5) % 11 == 0, F.lit(-1.0)).otherwise(x))
    i = i.withColumn("features", holes)
    return rounded(nb.nearest(i, i, 5).select("id", "rank", "neighbour", "dist"), 6)


@query
def knn_same_other(spark, folder):
    i = src.instances(spark, folder)
    found = nb.nearest(i, i, 5, relations=("same", "other"))
    return rounded(found.select("id", "relation", "rank", "neighbour", "dist"), 6)


@query
def knn_vote(spark, folder):
    i = _knn_instances(spark, folder)
    return nb.unanimous_vote(nb.nearest(i, i, 2), i, 2, FIRST_OPEN_SITE)


@query
def knn_accuracy(spark, folder):
    return rounded(nb.vote_accuracy(knn_vote(spark, folder), FIRST_OPEN_SITE), 6)


@query
def knn_stacked(spark, folder):
    i = src.instances(spark, folder).drop("features")
    closed = F.col("site") < FIRST_OPEN_SITE
    return nb.stacked(i.where(closed), i.where(~closed))


@query
def knn_distance(spark, folder):
    i = src.instances(spark, folder)
    first = i.groupBy("site").agg(F.min_by("features", "id").alias("first"))
    weights = F.transform("features", lambda x, j: F.lit(0.5) + j / F.lit(64.0))
    return rounded(
        i.join(first, "site").select("id", "site", nb.weighted_distance(F.col("features"), F.col("first"), weights).alias("dist")), 6
    )


@query
def knn_weights(spark, folder):
    closed = _knn_instances(spark, folder).where(F.col("site") < FIRST_OPEN_SITE)
    learned = wt.learn_weights(closed, rounds=10)
    return spark.createDataFrame(list(enumerate(learned)), "feature int, weight double")


# --- classifiers ---------------------------------------------------------------------


def world_rows(spark, folder, world="closed"):
    """(exampleid, label, features[, hs_url]) of all traces with a known site."""
    families = ft.feature_families(numbered(spark, folder))
    return wd.training_rows(wd.labelled_world(families, src.examples(spark, folder), src.sites(spark, folder), world))


def _instance_rows(spark, folder):
    """Instances as two classes: the first half of the sites against the others."""
    i = src.instances(spark, folder)
    return i.select(F.col("id").alias("exampleid"), (F.col("site") < 5).cast("int").alias("label"), "features")


def _model(name, model_type, **parameters):
    def run(spark, folder):
        rows = world_rows(spark, folder)
        return ex.train_eval_all_folds(rows, [ex.Experiment(model_type, parameters)], ex.Options(keep_models=False)).scores

    run.__name__ = name
    return query(run)


_FOREST = {"n_estimators": 25, "max_depth": 10, "max_features": "sqrt", "criterion": "gini", "min_samples_split": 2}

_model("model_random_forest", "RandomForest", **_FOREST)
_model("model_decision_tree", "DecisionTreeClassifier", max_depth=5, max_features="sqrt", criterion="gini", min_samples_split=2)
_model("model_gradient_boosting", "GradientBoostingClassifier", n_estimators=10, learning_rate=0.1, subsample=0.5, max_depth=3)
_model("model_logistic_regression", "LogisticRegression", C_reg=0.01, penalty="l2")
_model("model_svm", "SVM", C_reg=0.01, kernel="linear")
_model("model_sgd_log", "SGDClassifier", loss="log", penalty="elasticnet")
_model("model_sgd_modified_huber", "SGDClassifier", loss="modified_huber", penalty="l1")
_model("model_kneighbors", "KNeighborsClassifier", n_neighbors=5, weights="distance", algorithm="auto")
_model("model_gaussian_nb", "GaussianNB")
_model("model_ada_boost", "AdaBoost", algorithm="SAMME.R", n_estimators=10, learning_rate=0.1)
_model("model_extra_trees", "ExtraTrees", **{**_FOREST, "n_estimators": 10, "max_depth": 3, "max_features": "log2"})
_model(
    "model_bagging",
    "RandomForestBagging",
    **{**_FOREST, "n_estimators": 10, "max_depth": 5},
    max_samples=0.5,
    bootstrap=True,
    bootstrap_features=False,
    n_estimators_bag=10,
    max_features_bag=2,
)
_model(
    "model_boosting",
    "RandomForestBoosting",
    **{**_FOREST, "n_estimators": 100, "max_depth": 20, "max_features": 2},
    algorithm="SAMME",
    learning_rate=0.01,
    n_estimators_boost=10,
)


@query
def model_importances(spark, folder):
    """The features that matter most to a fitted forest."""
    run = ex.train_eval_all_folds(world_rows(spark, folder), [ex.Experiment("RandomForest", _FOREST)], ex.Options(keep_models=False))
    return ev.top_features(ex.importances(run, ft.feature_names()), 30)


@query
def model_records(spark, folder):
    rows = durable(world_rows(spark, folder))
    experiments = [
        ex.Experiment("GaussianNB", {}),
        ex.Experiment("DecisionTreeClassifier", {"max_depth": 5, "max_features": "sqrt", "criterion": "gini", "min_samples_split": 2}),
    ]
    return ex.model_records(ex.train_eval_all_folds(rows, experiments, ex.Options(keep_models=False)), rows)


@query
def model_open_world(spark, folder):
    rows = world_rows(spark, folder, "open")
    return ex.train_eval_all_folds(rows, [ex.Experiment("GaussianNB", {})], ex.Options(world="open", keep_models=False)).scores


# --- scaling, naive Bayes, rankings of models and features --------------------------------


def _folded_instances(spark, folder, k=5):
    return sm.stratified_folds(_instance_rows(spark, folder), "exampleid", "label", k=k, seed=4)


@query
def fold_stats(spark, folder):
    return rounded(sc.fold_stats(_folded_instances(spark, folder)), 6)


@query
def standardised(spark, folder):
    scaled = sc.standardised(_folded_instances(spark, folder))
    return rounded(scaled.select("exampleid", "fold", F.posexplode("features").alias("i", "x")), 6)


@query
def gaussian_nb_scores(spark, folder):
    rows = _instance_rows(spark, folder)
    return rounded(cl.fit("GaussianNB", {}, rows).score(rows), 4)


@query
def extra_tree_nodes(spark, folder):
    """Extra trees of depth 3, grown by aggregates over all rows alone: nodes by their path from the root."""
    rows = trees.grow(_instance_rows(spark, folder), EXTRA, local_values=1).nodes()
    kinds = "tree int, path string, feature int, threshold double, negative long, positive long"
    out = [(t, path, f, float(c), n, p) for t, _, path, f, c, _, _, n, p, _ in rows]
    return rounded(spark.createDataFrame(out, kinds), 6)


@query
def extra_tree_scores(spark, folder):
    """The same trees grown in the tasks of their roots, as scores of all rows."""
    rows = _instance_rows(spark, folder)
    return rounded(trees.grow(rows, EXTRA).score(rows), 6)


@query
def decision_tree_scores(spark, folder):
    """A single tree over histograms of cut points that splits no node of fewer than 40 rows."""
    rows = _instance_rows(spark, folder)
    return rounded(trees.grow(rows, SINGLE, local_values=20_000).score(rows), 6)


@query
def top_importances(spark, folder):
    """Features ranked by the difference of their class means."""
    x = _instance_rows(spark, folder).select("label", F.posexplode("features").alias("i", "x"))
    sign = F.when(F.col("label") == 1, F.col("x"))
    other = F.when(F.col("label") == 0, F.col("x"))
    means = x.groupBy("i").agg((F.avg(sign) - F.avg(other)).alias("importance"))
    named = means.select(F.concat(F.lit("feature_"), "i").alias("feature"), "importance")
    return rounded(ev.top_features(named, 30), 6)


@query
def best_model(spark, folder):
    base = src.scores(spark, folder)
    runs = {"longer": F.col("score"), "shorter": -F.col("score"), "later": F.col("exampleid").cast("double")}
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model_id"), c.alias("score")) for n, c in runs.items()]))
    scores = base.select("exampleid", "label", models.alias("m")).select("label", "m.model_id", "m.score")
    return rounded(ev.best_model(ev.auc(scores, ["model_id"])), 6)


@query
def fit_plan(spark, folder):
    """Every fit of the shipped grid with the number of rows it trains and tests on."""
    folded = sm.stratified_folds(src.scores(spark, folder), "exampleid", k=10, seed=1)
    return ex.fit_plan(folded, ex.generate_experiments())


# --- sources and sinks -------------------------------------------------------------------


def _scratch(spark):
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _odd_lines(spark, folder):
    """Traces as text records, by turns as written by default, without labels, with whole seconds, with negative
    numbers, and with a field missing."""
    lines = tl.log_lines(src.traces(spark, folder).withColumn("_turn", F.col("cellid") % 5), "_turn")
    turn, value = F.col("_turn"), F.col("value")
    value = (
        F.when(turn == 1, F.regexp_replace(value, "CIRC |STREAM |COMMAND |length |,", ""))
        .when(turn == 2, F.regexp_replace(value, r"^(\d+)\.\d+", "$1"))
        .when(turn == 3, F.regexp_replace(value, r"(STREAM|length) ", "$1 -"))
        .when(turn == 4, F.regexp_replace(value, r", length \d+$", ""))
        .otherwise(value)
    )
    return lines.select("exampleid", value.alias("value"))


@query
def log_ingest(spark, folder):
    """Odd records written as text logs, then read back by the log reader."""
    path = _scratch(spark)
    tl.write_log_lines(_odd_lines(spark, folder), path)
    return tl.read_trace_logs(spark, path)


@query
def log_stream(spark, folder):
    """The same logs through the streaming reader."""
    path = _scratch(spark)
    tl.write_trace_logs(src.traces(spark, folder), f"{path}/logs")
    append_new_logs(spark, f"{path}/logs", f"{path}/cells", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/cells")


def _odd_stream(spark, folder):
    """The table of a stream over odd records that arrive in two parts, with a run after each and one more."""
    path = _scratch(spark)
    lines = _odd_lines(spark, folder)
    for part in (0, 1, None):
        if part is not None:
            tl.write_log_lines(lines.where(F.col("exampleid") % 2 == part), f"{path}/logs/{part}")
        append_all_records(spark, f"{path}/logs", f"{path}/records", f"{path}/state").awaitTermination()
    return f"{path}/records"


@query
def log_stream_odd(spark, folder):
    """The whole records of that stream."""
    return stored_cells(spark, _odd_stream(spark, folder))


@query
def log_stream_rejected(spark, folder):
    """The rejected records of that stream, as they stand in the logs."""
    return stored_rejects(spark, _odd_stream(spark, folder))


@query
def feature_files(spark, folder):
    """Instances written as feature files, then read back; half of them start at number 5."""
    path = _scratch(spark)
    i = OrderedGroups(src.instances(spark, folder), ["site"], ["id"]).running(sums={"instance": F.lit(1)}).rows()
    ff.write_feature_files(i, path)
    read = ff.read_feature_files(spark, path, 5, 25)
    return rounded(read.select("site", "instance", F.posexplode("features").alias("i", "x")), 6)


@query
def csv_round_trip(spark, folder):
    path = _scratch(spark)
    tb.write_csv(src.examples(spark, folder), path)
    return tb.read_csv(spark, path, "exampleid bigint, hsid bigint, crawlid bigint, t_scrape timestamp_ntz")


@query
def append_examples(spark, folder):
    """Line items as new visits: ids follow those of the existing examples."""
    new = src.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("hsid"), F.col("l_linenumber").alias("crawlid"), "l_orderkey", "l_partkey", "l_shipdate",
        "l_extendedprice", "l_quantity",
    )
    order = ["l_orderkey", "crawlid", "l_partkey", "hsid", "l_shipdate", "l_extendedprice", "l_quantity"]
    out = tb.with_new_ids(new, src.examples(spark, folder), "exampleid", order)
    return out.select("exampleid", "hsid", "crawlid", F.col("l_shipdate").alias("t_scrape"))


@query
def stored_fold_curves(spark, folder):
    """ROC corners of each fold, appended as rows and read back."""
    path = _scratch(spark)
    scores = _fold_scores(spark, folder).withColumn("model_id", F.lit("n_chars"))
    rs.save_fold_curves(ev.roc_points(scores, ["model_id", "fold"], drop_intermediate=True), path)
    return rounded(spark.read.parquet(path), 6)


@query
def grid_records(spark, folder):
    """Every requested run of the shipped grid, how many runs share its fit, and the rows that its folds test on."""
    grid = spark.createDataFrame(ex.grid_records(ex.generate_experiments()), ex.GRID_SCHEMA)
    same = grid.groupBy("fitted_as").agg(F.count("*").alias("sharing"))
    tested = _fold_scores(spark, folder).agg(F.count("*").alias("tested"), F.countDistinct("fold").alias("folds")).first()
    rows = grid.join(same, "fitted_as").select("model_type", "sharing")
    return rows.withColumns({"tested": F.lit(tested["tested"]).cast("bigint"), "folds": F.lit(tested["folds"]).cast("bigint")})


@query
def stored_fold_records(spark, folder):
    path = _scratch(spark)
    folds = ev.fold_metrics(_fold_scores(spark, folder).withColumn("model_id", F.lit("n_chars")), ["model_id", "fold"])
    rs.save_fold_records(folds, path, NOW)
    return rounded(spark.read.parquet(path), 6)
