"""Sites, sampling, status, sources and sinks."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_DIR
from tracelab import schemas
from tracelab.functions.columns import lookback
from tracelab.operators import sampling as sm
from tracelab.operators import sites as st
from tracelab.operators import status
from tracelab.sources import adapters as src
from tracelab.sources import feature_files as ff
from tracelab.sources import results as rs
from tracelab.sources import tables as tb
from tracelab.sources import trace_log as tl
from tracelab.streaming.trace_stream import append_all_records, append_new_logs, stored_cells, stored_rejects

NOW = datetime(2016, 8, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lookback():
    assert lookback("1w") == timedelta(days=7) and lookback("4w") == timedelta(days=28)
    assert lookback("3d") == timedelta(days=3) and lookback("5h") == timedelta(hours=5)
    for bad in ("1m", "666", "w", ""):
        with pytest.raises(ValueError):
            lookback(bad)


def test_links_and_classes(spark):
    a, b = "0123456789abcdef.onion", "fedcba9876543210.onion"
    pages = spark.createDataFrame([("http://dir1", f"x {a} y {a} {b}"), ("http://dir2", f"<{b}>"), ("http://dir3", "none")], "url string, html string")
    assert rows(st.page_links(pages)) == sorted(
        [(f"http://{a}",), (f"http://{b}",), ("http://dir1",), ("http://dir2",), ("http://dir3",)]
    )
    assert rows(st.empty_pages(pages)) == [("http://dir3",)]
    rules = [("sd_1", "contains(text, 'x')"), ("nonmonitored", "not contains(text, '<')"), ("late", "contains(text, 'x')")]
    got = dict(rows(st.classified(pages, rules)))
    assert got == {"http://dir1": "sd_1", "http://dir2": None, "http://dir3": "nonmonitored"}


def test_site_rows(spark):
    classes = spark.createDataFrame([({"sd_038": ["http://ab.onion/path", "http://c.onion.onion"], "other": ["http://q.onion"]},)], "classes map<string,array<string>>")
    got = rows(st.site_rows(st.from_class_map(classes), NOW).drop("t_sort"))
    assert got == [
        ("http://ab.onion", True, "038", True, "sd_038"),
        ("http://c.onion", True, "038", True, "sd_038"),
        ("http://q.onion", False, "N/A", True, "other"),
    ]


def test_recent_sites(spark):
    data = [
        (1, "u1", True, "sd_a", NOW - timedelta(days=1)),
        (2, "u1", True, "sd_b", NOW),
        (3, "u2", False, "non_monitored", NOW - timedelta(days=7)),
        (4, "u3", False, "non_monitored", NOW - timedelta(days=8)),
        (5, "u1", False, "non_monitored", NOW),
    ]
    sites = spark.createDataFrame(data, "hsid bigint, hs_url string, is_sd boolean, sorted_class string, t_sort timestamp_ntz")
    recent = st.recent_sites(sites, NOW, "1w")
    assert rows(recent) == [(False, "u1", 5), (False, "u2", 3), (True, "u1", 2)]
    assert rows(st.site_classes(sites, NOW, timedelta(days=7))) == [("nonmonitored", "u1", 5), ("nonmonitored", "u2", 3), ("sd_b", "u1", 2)]
    assert rows(st.url_ids(recent)) == [("u1", 2), ("u2", 3)]


@pytest.mark.parametrize("group_rows", [20, 10_000_000])
def test_folds_are_even_per_class(spark, group_rows):
    labels = src.scores(spark, SF_DIR).select("exampleid", "label")
    folded = sm.stratified_folds(labels, "exampleid", k=4, seed=1, group_rows=group_rows)
    assert rows(folded) == rows(sm.stratified_folds(labels, "exampleid", k=4, seed=1))
    sizes = folded.groupBy("label", "fold").count().groupBy("label").agg((F.max("count") - F.min("count")).alias("d"))
    assert all(r.d <= 1 for r in sizes.collect())
    assert folded.count() == labels.count()


def test_interleave_plan(spark):
    sites = spark.createDataFrame([(i, i < 3) for i in range(26)], "hsid bigint, is_sd boolean")
    plan = sm.interleave_plan(sites, ratio=4, seed=1, group_rows=6)
    assert rows(plan) == rows(sm.interleave_plan(sites, ratio=4, seed=1))
    per_round = plan.groupBy("round").agg(F.count_if("is_sd").alias("m"), F.count_if(~F.col("is_sd")).alias("o"))
    assert rows(per_round) == [(r, 3, 5) for r in range(4)]
    others = plan.where("not is_sd")
    assert others.select("hsid").distinct().count() == 20
    assert sm.interleave_plan(sites, ratio=40).where("not is_sd").count() == 0


def test_open_world_split(spark):
    world = spark.createDataFrame([(i, f"u{i % 20}", int(i % 20 < 4)) for i in range(200)], "exampleid bigint, hs_url string, label int")
    parts = sm.open_world_split(world, 0.25, k=5)
    assert parts.count() == 200
    outside = parts.where("label = 0").groupBy("hs_url").agg(F.countDistinct("is_train").alias("n"), F.max("is_train").alias("t"))
    assert all(r.n == 1 for r in outside.collect()) and outside.where("t").count() == 4
    assert parts.where("label = 1 and not is_train").count() == 8


def test_status(spark):
    df = spark.createDataFrame([(datetime(2017, 1, 1, 5), 1), (datetime(2017, 1, 1, 7), 1), (datetime(2017, 1, 4, 1), 2)], "t timestamp_ntz, hsid int")
    assert [r.n for r in status.rows_per_day(df, "t").orderBy("day").collect()] == [2, 0, 0, 1]
    assert [r.n_sites for r in status.sites_per_day(df, "t").orderBy("day").collect()] == [1, 1]
    assert status.distinct_sites(df).first().n_sites == 2
    assert status.last_seen(df, "t").first().last_seen == datetime(2017, 1, 4, 1)


LOG = (
    "1472598678.735375 INCOMING CIRC 3725647749, STREAM 0, COMMAND EXTENDED2(15), length 66\n\n"
    "1472598678.909463 OUTGOING CIRC 3725647749, STREAM 0, COMMAND EXTEND2(14), length 119\n\n"
    "a broken record\n\n"
    "1472598679.262226 INCOMING CIRC 3725647749, STREAM 0, COMMAND EXTENDED2(15), length 66\n\n"
)
CELLS = [
    (9, True, 3725647749, 0, "EXTENDED2(15)", 66, 1472598678735375),
    (9, True, 3725647749, 0, "EXTENDED2(15)", 66, 1472598679262226),
    (9, False, 3725647749, 0, "EXTEND2(14)", 119, 1472598678909463),
]


def test_trace_log(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "trace-9.log").write_text(LOG)
    assert rows(tl.read_trace_logs(spark, str(tmp_path / "logs"))) == sorted(CELLS)
    run = lambda: append_new_logs(spark, str(tmp_path / "logs"), str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    run()
    (tmp_path / "logs" / "trace-11.log").write_text(LOG)
    run()
    got = rows(spark.read.parquet(str(tmp_path / "t")))
    assert got == sorted(CELLS + [(11, *c[1:]) for c in CELLS])


def test_odd_log_records(spark, tmp_path):
    records = [
        "17 INCOMING 4 5 RELAY 66",  # no labels, whole seconds
        "1.5e3 OUTGOING CIRC 1, STREAM -1, COMMAND X, length -7",
        "  0.1234567 INCOMING  CIRC 1,  STREAM 2,  COMMAND Y,  length 3 ",
        "1.0 INCOMING CIRC 1, STREAM 2, COMMAND Y",  # five fields
        "1.0 INCOMING CIRC x, STREAM 2, COMMAND Y, length 3",
        "soon INCOMING CIRC 1, STREAM 2, COMMAND Y, length 3",
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "8.log").write_text("\n\n".join(records))
    lines = tl.log_records(spark, str(tmp_path / "a"))
    got = rows(tl.parse_records(lines, F.col("_trace")))
    want = [(8, True, 4, 5, "RELAY", 66, 17_000_000), (8, False, 1, -1, "X", -7, 1_500_000_000), (8, True, 1, 2, "Y", 3, 123_457)]
    assert got == sorted(want)
    assert {r.value.strip() for r in tl.rejected_records(lines).collect()} == {r.strip() for r in records[3:]}
    (tmp_path / "a" / "b").mkdir()
    (tmp_path / "a" / "b" / "8.log").write_text(records[0])
    with pytest.raises(ValueError):
        tl.read_trace_logs(spark, str(tmp_path / "a"))


def test_stream_keeps_rejected_records(spark, tmp_path):
    logs, table = tmp_path / "logs", str(tmp_path / "t")
    run = lambda: append_all_records(spark, str(logs), table, str(tmp_path / "s")).awaitTermination()
    told = lambda: (rows(stored_cells(spark, table)), rows(stored_rejects(spark, table)))
    (logs / "a").mkdir(parents=True)
    (logs / "a" / "8.log").write_text("17 INCOMING 4 5 RELAY 66\n\n1.0 INCOMING CIRC 1\n\n \n\n")
    run()
    first = ([(8, True, 4, 5, "RELAY", 66, 17_000_000)], [(8, "1.0 INCOMING CIRC 1")])
    assert told() == first
    run()  # nothing is new
    assert told() == first
    (logs / "a" / "9.log").write_text("soon OUTGOING 4 5 RELAY 66\n\n2 OUTGOING 4 5 RELAY 66")
    run()
    assert told() == (first[0] + [(9, False, 4, 5, "RELAY", 66, 2_000_000)], first[1] + [(9, "soon OUTGOING 4 5 RELAY 66")])
    seen = told()
    (logs / "b").mkdir()
    (logs / "b" / "8.log").write_text("3 OUTGOING 4 5 RELAY 66")  # a trace of an earlier batch
    with pytest.raises(ValueError):
        run()
    assert told() == seen


def test_appends(spark, tmp_path):
    sites = spark.createDataFrame([("c", "u2"), ("c", "u1")], "sorted_class string, hs_url string").selectExpr(
        "*", "true as is_sd", "'v' as sd_version", "true as is_current", "timestamp_ntz '2017-01-01' as t_sort"
    )
    for n in (1, 2):
        stored = tb.append_sites(sites, str(tmp_path / "s"))
        assert sorted(r.hsid for r in stored.collect()) == list(range(1, 2 * n + 1))
    crawls = tb.append_crawls(spark.createDataFrame([("DE", 30)], "country string, page_load_timeout int"), str(tmp_path / "c"))
    assert [(r.crawlid, r.country, r.page_load_timeout, r.city) for r in crawls.collect()] == [(1, "DE", 30, None)]


def test_feature_files(spark, tmp_path):
    for name, text in {"0-0s": "1 'X' 2.5 ", "0-2s": "3 4  5", "0-7s": "6 7 8", "1-1s": "'X' 'X' 1", "12s": "9 9 9"}.items():
        (tmp_path / name).write_text(text)
    assert rows(ff.read_feature_files(spark, str(tmp_path)))[:2] == [(0, 0, [1.0, -1.0, 2.5]), (0, 2, [3.0, 4.0, 5.0])]
    got = rows(ff.read_feature_files(spark, str(tmp_path), 1, 3))
    assert [(r[0], r[1]) for r in got] == [(0, 2), (0, 7), (1, 1)]


def test_weights_line(spark):
    w = spark.createDataFrame([(1, 0.25), (0, 1.5)], "feature int, weight double")
    assert ff.weight_line(w).first().value == "1500.000000 250.000000 "


def test_raw_csv_and_tables(spark, tmp_path):
    sites = tmp_path / "sites"
    sites.mkdir()
    (sites / "a.csv").write_text(
        "hsid,hs_url,is_sd,sd_version,is_current,sorted_class,t_sort\n1,http://a.onion,True,038,True,sd_038,2016-07-30 16:42:02.298115\n"
    )
    r = tb.read_csv(spark, str(sites), schemas.SITES).first()
    assert (r.hsid, r.is_sd, r.sd_version, r.t_sort.microsecond) == (1, True, "038", 298115)
    raw = spark.createDataFrame([(1, "1472598678.735375")], "cellid int, t string").selectExpr("cellid", "cast(t as decimal(16,6)) as t_trace")
    assert tb.cells_from_raw(raw).first().t_us == 1472598678735375
    new = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    old = spark.createDataFrame([(41,), (7,)], "id bigint")
    assert rows(tb.with_new_ids(new, old, "id", ["v"], group_rows=1)) == [(42, "a"), (43, "b"), (44, "c")]
    path = tb.replace_table(old, str(tmp_path / "t"))
    tb.append_table(old, path)
    assert spark.read.parquet(path).count() == 4
    tb.replace_table(new, path)
    assert spark.read.parquet(path).columns == ["v"]


def test_pseudonyms_and_masks(spark):
    sites = src.sites(spark, SF_DIR)
    words = spark.createDataFrame([(0, "ash"), (1, "oak")], "i bigint, word string")
    got = sm.pseudonymised(sites, words, 3)
    assert got.count() == sites.count() and got.columns == sites.columns
    assert {r.hs_url for r in got.select("hs_url").distinct().collect()} == {"http://ash1234.onion", "http://oak1234.onion"}
    assert {tuple(r) for r in sm.masked(sites, {"hs_url": "x"}).select("hs_url").distinct().collect()} == {("x",)}


def test_saved_records(spark, tmp_path):
    from tracelab.operators import evaluation as ev

    data = spark.createDataFrame([("m", 0, i % 2, float(i)) for i in range(20)], "model_id string, fold int, label int, score double")
    folds = ev.fold_metrics(data, ["model_id", "fold"])
    path = rs.save_fold_records(folds, str(tmp_path / "f"))
    rs.save_fold_records(folds, path)
    assert spark.read.parquet(path).count() == 2
    rs.save_scores(data, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("fold = 0").count() == 20


def files_below(path):
    return [f for f in path.rglob("part-*") if f.suffix != ".crc"]


def test_logs_of_many_traces_share_files(spark, tmp_path):
    lines = spark.range(400, numPartitions=2).select(
        F.col("id").alias("exampleid"), F.concat("id", F.lit("\tINCOMING 4 5 RELAY 66")).alias("value")
    )
    odd = spark.createDataFrame([(3, None), (3, "broken\tone"), (4, "7 OUTGOING 4 5 RELAY 66")], "exampleid bigint, value string")
    logs = tmp_path / "logs"
    tl.write_log_lines(lines.unionByName(odd.coalesce(1)), str(logs))
    assert len(files_below(logs)) == 3
    (logs / "trace-900.log").write_text("1 INCOMING 4 5 RELAY 66")  # a log of one trace beside them
    want = [(i, True, 4, 5, "RELAY", 66, i * 1_000_000) for i in range(400)]
    want = sorted([*want, (4, False, 4, 5, "RELAY", 66, 7_000_000), (900, True, 4, 5, "RELAY", 66, 1_000_000)])
    assert rows(tl.read_trace_logs(spark, str(logs))) == want
    run = lambda: append_all_records(spark, str(logs), str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
    run()
    assert rows(stored_cells(spark, str(tmp_path / "t"))) == want
    assert rows(stored_rejects(spark, str(tmp_path / "t"))) == [(3, "broken\tone")]
    tl.write_log_lines(lines.where("exampleid = 7"), str(logs / "more"))  # trace 7 has two packed logs
    with pytest.raises(ValueError):
        run()
    with pytest.raises(ValueError):
        tl.read_trace_logs(spark, str(logs))


def test_a_trace_in_a_packed_and_a_plain_log_clashes(spark, tmp_path):
    lines = spark.createDataFrame([(8, "1 INCOMING 4 5 RELAY 66")], "exampleid bigint, value string")
    tl.write_log_lines(lines, str(tmp_path / "logs"))
    (tmp_path / "logs" / "8.log").write_text("3 OUTGOING 4 5 RELAY 66")
    assert [r.trace for r in tl.clashing_logs(spark, str(tmp_path / "logs")).collect()] == ["8"]


def test_features_of_many_instances_share_files(spark, tmp_path):
    data = [(s, i, [float(s), -1.0, i / 2]) for s in range(3) for i in range(1, 41)] + [(7, 1, None)]
    instances = spark.createDataFrame(data, "site int, instance int, features array<double>").coalesce(2)
    ff.write_feature_files(instances, str(tmp_path / "f"))
    assert len(files_below(tmp_path / "f")) == 2
    (tmp_path / "f" / "9-3s").write_text("1 'X'  2")  # a file of one instance beside them
    want = sorted([*data[:-1], (7, 1, []), (9, 3, [1.0, -1.0, 2.0])])
    assert rows(ff.read_feature_files(spark, str(tmp_path / "f"))) == want
    assert [(r[0], r[1]) for r in rows(ff.read_feature_files(spark, str(tmp_path / "f"), 39, 45))] == [(s, i) for s in range(3) for i in (39, 40)]
