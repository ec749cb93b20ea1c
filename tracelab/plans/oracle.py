"""DuckDB SQL that must give the same rows as the registered query of the same name."""

from __future__ import annotations

from tracelab.operators.features import (
    BURST_THRESHOLDS,
    NUM_BURSTS,
    NUM_DIFFERENCES,
    NUM_DIRECTIONS,
    NUM_POSITIONS,
    NUM_WINDOWS,
    WINDOW_SIZE,
)
from tracelab.plans.tree_oracle import tree_sql

TRACES = """traces as (
  select event_id as cellid, user_id as exampleid, event_type in ('view', 'click') as ingoing,
         user_id as circuit, event_id % 7 as stream, event_type as command,
         cast(json_extract_string(props, '$.k') as int) as length, epoch_us(ts) as t_us
  from events)"""

EXAMPLES = """examples as (
  select o_orderkey as exampleid, o_custkey as hsid, o_orderkey % 10 as crawlid, o_orderdate as t_scrape
  from orders)"""

SITES = """sites as (
  select c_custkey as hsid, concat('http://', c_name, '.onion') as hs_url,
         c_mktsegment = 'BUILDING' as is_sd,
         case when c_mktsegment = 'BUILDING' then 'sd_038' else 'non_monitored' end as sorted_class
  from customer)"""

POSITIONS = """positions as (
  select exampleid, cellid, ingoing, t_us,
         row_number() over (partition by exampleid order by t_us, cellid) as position,
         t_us - lag(t_us) over (partition by exampleid order by t_us, cellid) as gap_us
  from traces)"""

OUTGOING = """outgoing as (
  select exampleid, position, row_number() over (partition by exampleid order by position) as k
  from positions where not ingoing)"""

BURSTS = """bursts as (
  select exampleid, rank() over (partition by exampleid order by min(position)) as rank, count(*) as burst
  from (select exampleid, position,
               position - row_number() over (partition by exampleid, ingoing order by position) as island,
               ingoing
        from positions)
  group by exampleid, ingoing, island)"""

#: A link that only some pages hold: a path that begins with one of three letters.
PARTIAL_PATTERN = 'href="/[a-c]'

FEATURE_VIEWS = ",\n".join([TRACES, POSITIONS, OUTGOING, BURSTS])


def _with(*views: str) -> str:
    return "with " + ",\n".join(views) + "\n"


def _wide(table: str, key: str, value: str, names: list[str], extra: str = "") -> str:
    cols = ",\n".join(f"max(case when {key} = {i} then {value} end) as {n}" for i, n in enumerate(names, 1))
    return f"select exampleid, {cols} from {table} {extra} group by exampleid"


DIRECTIONS = _wide(
    "positions", "position", "case when ingoing then 0 else 1 end",
    [f"direction_cell_{i}" for i in range(1, NUM_DIRECTIONS + 1)],
)
OUT_POSITIONS = _wide(
    "outgoing", "k", "position", [f"outgoing_cell_position_{i}" for i in range(1, NUM_POSITIONS + 1)]
)
OUT_DIFFERENCES = _wide(
    "(select exampleid, k, lead(position) over (partition by exampleid order by k) - position as d from outgoing)",
    "k", "d", [f"outgoing_cell_position_difference_{i}" for i in range(1, NUM_DIFFERENCES + 1)],
)
WINDOWS = (
    "select exampleid, "
    + ",\n".join(
        f"nullif(count(*) filter (where not ingoing and position > {WINDOW_SIZE * (i - 1)}"
        f" and position <= {WINDOW_SIZE * i}), 0) as num_outgoing_cells_in_window_{i}_of_size_{WINDOW_SIZE}"
        for i in range(1, NUM_WINDOWS + 1)
    )
    + " from positions group by exampleid"
)
BURST_AGGREGATES = """select exampleid, {mean} as mean_burst_length,
  count(*) as num_bursts, max(burst) as max_burst_length from bursts group by exampleid"""
THRESHOLDS = (
    "select exampleid, "
    + ", ".join(
        f"nullif(count(*) filter (where burst > {x}), 0) as num_bursts_with_length_gt_{x}" for x in BURST_THRESHOLDS
    )
    + " from bursts group by exampleid"
)
LENGTHS = _wide("bursts", "rank", "burst", [f"length_burst_{i}" for i in range(1, NUM_BURSTS + 1)])
NUMBERS = """select exampleid, count(*) as total_number_cells,
  count(*) filter (where ingoing) as total_number_incoming_cells,
  count(*) filter (where not ingoing) as total_number_outgoing_cells
  from traces group by exampleid"""
TIMINGS = "select exampleid, {elapsed} as total_elapsed_time from traces group by exampleid"
_ELAPSED = "(max(t_us) - min(t_us)) / 1000000.0::double"
INTERCELL = """select exampleid, round(avg(gap_us / 1000000.0::double), 4) as mean_intercell_time,
  round(stddev_samp(gap_us / 1000000.0::double), 4) as standard_deviation_intercell_time
  from positions group by exampleid"""

_PER_FEATURE = [
    f"f_numbers as ({NUMBERS})",
    f"f_timings as ({TIMINGS.format(elapsed=f'round({_ELAPSED}, 4)')})",
    f"f_intercell as ({INTERCELL})",
    f"f_directions as ({DIRECTIONS})",
    f"f_positions as ({OUT_POSITIONS})",
    f"f_differences as ({OUT_DIFFERENCES})",
    f"f_windows as ({WINDOWS})",
    f"f_bursts as ({BURST_AGGREGATES.format(mean='round(avg(burst::double), 4)')})",
    f"f_thresholds as ({THRESHOLDS})",
    f"f_lengths as ({LENGTHS})",
]
MASTER_VIEWS = ",\n".join([FEATURE_VIEWS, *_PER_FEATURE]) + """,
master as (
  select * from f_numbers
  left join f_timings using (exampleid) left join f_intercell using (exampleid)
  left join f_directions using (exampleid) left join f_positions using (exampleid)
  left join f_differences using (exampleid) left join f_windows using (exampleid)
  left join f_bursts using (exampleid) left join f_thresholds using (exampleid)
  left join f_lengths using (exampleid))"""

ORACLE: dict[str, str] = {
    "example_list": "select distinct user_id as exampleid from events",
    "cell_positions": _with(TRACES, POSITIONS) + "select exampleid, cellid, ingoing, position from positions",
    "outgoing_positions_long": _with(TRACES, POSITIONS, OUTGOING)
    + f"select exampleid, k as cell_order, position from outgoing where k <= {NUM_POSITIONS}",
    "cell_numbers": _with(TRACES) + NUMBERS,
    "cell_timings": _with(TRACES) + TIMINGS.format(elapsed=_ELAPSED),
    "intercell_timings": _with(TRACES, POSITIONS) + INTERCELL,
    "initial_directions": _with(TRACES, POSITIONS) + DIRECTIONS,
    "outgoing_positions": _with(TRACES, POSITIONS, OUTGOING) + OUT_POSITIONS,
    "position_differences": _with(TRACES, POSITIONS, OUTGOING) + OUT_DIFFERENCES,
    "windowed_counts": _with(TRACES, POSITIONS) + WINDOWS,
    "bursts": _with(FEATURE_VIEWS) + "select exampleid, rank, burst from bursts",
    "burst_aggregates": _with(FEATURE_VIEWS) + BURST_AGGREGATES.format(mean="round(avg(burst::double), 4)"),
    "burst_thresholds": _with(FEATURE_VIEWS) + THRESHOLDS,
    "burst_lengths": _with(FEATURE_VIEWS) + LENGTHS,
    "master_matrix": _with(MASTER_VIEWS) + "select * from master",
    "master_matrix_long": _with(MASTER_VIEWS).replace("user_id as exampleid", "user_id % 3 as exampleid") + "select * from master",
}

# --- world, sites, status -------------------------------------------------------------

SITES_SORTED = """sorted as (
  select hsid, hs_url, is_sd, sorted_class, t_sort
  from sites join (select hsid, max(t_scrape) as t_sort from examples group by hsid) using (hsid))"""
RECENT = """recent as (
  select is_sd, hs_url, arg_max(hsid, (t_sort, hsid)) as hsid from sorted
  where t_sort >= timestamp '2001-08-02' - interval 364 day group by is_sd, hs_url)"""
CLASSES = """classes as (
  select url, case when contains(html, 'lang="fr"') then 'sd_fr'
                   when contains(html, 'lang="de"') then 'sd_de'
                   when not contains(html, 'lang="en"') then 'nonmonitored' end as class_name
  from pages)"""

_IMPUTED = "select exampleid, coalesce(columns(* exclude (exampleid)), 0) from master"

ORACLE |= {
    "labelled_world": _with(MASTER_VIEWS, EXAMPLES, SITES)
    + "select master.*, is_sd from master join examples using (exampleid) join sites using (hsid)",
    "labelled_world_open": _with(TRACES, EXAMPLES, SITES, f"f_numbers as ({NUMBERS})")
    + "select f_numbers.*, is_sd, hs_url from f_numbers join examples using (exampleid) join sites using (hsid)",
    "imputed_matrix": _with(MASTER_VIEWS) + _IMPUTED,
    "ordered_trace": _with(TRACES) + "select exampleid, ingoing, t_us from traces order by exampleid, t_us, cellid",
    "merged_cells": _with(TRACES, EXAMPLES, SITES)
    + """select exampleid, hsid, crawlid, t_scrape, hs_url, is_sd, sorted_class, cellid, ingoing, circuit, stream,
         command, length, t_us from examples join sites using (hsid) join traces using (exampleid)""",
    "recent_sites": _with(EXAMPLES, SITES, SITES_SORTED, RECENT) + "select is_sd, hs_url, hsid from recent",
    "site_classes": _with(EXAMPLES, SITES, SITES_SORTED, RECENT)
    + """select case when is_sd then 'sd_038' else 'nonmonitored' end as class_name, hs_url, hsid from recent""",
    "url_ids": _with(EXAMPLES, SITES, SITES_SORTED, RECENT)
    + "select hs_url, arg_max(hsid, (is_sd, hsid)) as hsid from recent group by hs_url",
    "url_ids_clash": _with(EXAMPLES, SITES.replace("concat('http://', c_name, '.onion')", "concat('http://site', c_custkey % 97, '.onion')"), SITES_SORTED, RECENT)
    + "select hs_url, arg_max(hsid, (is_sd, hsid)) as hsid from recent group by hs_url",
    "empty_pages_partly": f"select url from pages where not regexp_matches(html, '{PARTIAL_PATTERN}')",
    "page_links": """select distinct url from (
         select 'http://directory' || unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as url from pages
         union all select url from pages)""",
    "empty_pages": "select url from pages where not regexp_matches(html, '[0-9a-z]{16}\\.onion')",
    "page_classes": _with(CLASSES) + "select url, class_name from classes",
    "site_append": _with(CLASSES)
    + """select split_part(url, 'onion', 1) || 'onion' as hs_url, contains(class_name, 'sd') as is_sd,
         case when contains(class_name, 'sd') then split_part(class_name, '_', 2) else 'N/A' end as sd_version,
         true as is_current, class_name as sorted_class, timestamp '2001-08-02' as t_sort
         from classes where class_name is not null""",
    "daily_examples": _with(EXAMPLES)
    + """, counts as (select t_scrape::date as day, count(*) as n from examples group by 1),
         days as (select unnest(generate_series((select min(day) from counts), (select max(day) from counts),
                                                interval 1 day))::date as day)
         select day, coalesce(n, 0) as n from days left join counts using (day)""".replace(", counts", ",\ncounts", 1),
    "daily_distinct_sites": _with(EXAMPLES)
    + "select t_scrape::date as day, count(distinct hsid) as n_sites from examples group by 1",
    "distinct_sites": "select count(distinct o_custkey) as n_sites from orders",
    "totals": """select 'examples' as table_name, count(*) as n from orders
         union all select 'sites', count(*) from customer union all select 'traces', count(*) from events""",
    "last_seen": _with(EXAMPLES, SITES, SITES_SORTED) + "select max(t_sort) as last_seen from sorted",
}

# --- sampling ------------------------------------------------------------------------

DEV = "dev as (select * from examples order by exampleid limit 100 offset 100)"


def _shuffled(seed: int, key: str, by: str, table: str, extra: str = "*") -> str:
    part = f"partition by {by} " if by else ""
    return f"(select {extra}, row_number() over ({part}order by md5(concat('{seed}:', {key})), {key}) as r from {table})"


SCORES = """scores as (
  select l.doc_id as exampleid, quality as label, n_chars::double as score
  from labels l join documents d on l.doc_id = d.doc_id)"""
FOLDED = f"folded as (select exampleid, label, score, ((r - 1) % 10)::int as fold from {_shuffled(1, 'exampleid', 'label', 'scores')})"

ORACLE |= {
    "dev_sample": _with(EXAMPLES, DEV) + "select * from dev",
    "semi_sites": _with(EXAMPLES, SITES, DEV) + "select * from sites where hsid in (select hsid from dev)",
    "semi_cells": _with(TRACES, EXAMPLES, DEV) + "select * from traces where exampleid in (select exampleid from dev)",
    "masked_sample": "select * replace ('X' as o_orderstatus, '1A2B3C4D' as o_orderpriority) from orders",
    "pseudonymised_sites": _with(SITES)
    + """select hsid, 'http://' || lower(n_name) || '1234.onion' as hs_url, is_sd, sorted_class
         from sites join nation
         on n_nationkey = ('0x' || substr(md5(concat('7:', hsid)), 1, 8))::bigint % (select count(*) from nation)""",
    "stratified_folds": _with(SCORES, FOLDED) + "select exampleid, label, fold from folded",
    "interleave_plan": _with(SITES)
    + f""", ranked as (select * from {_shuffled(3, 'hsid', 'is_sd', 'sites')}),
         chunk as (select count(*) // 40 as c from sites where not is_sd)
         select i::int as round, is_sd, r as visit_order, hsid from ranked, range(40) t(i) where is_sd
         union all
         select ((r - 1) // c)::int, is_sd, r - ((r - 1) // c) * c, hsid from ranked, chunk
         where not is_sd and c > 0 and (r - 1) // c < 40""",
    "shuffled_sites": _with(SITES) + f"select hsid, r as rank from {_shuffled(5, 'hsid', '', 'sites')}",
    "open_world_split": _with(EXAMPLES, SITES)
    + f""", world as (select exampleid, hs_url, is_sd::int as label from examples join sites using (hsid)),
         outside as (select distinct hs_url from world where label = 0),
         seen as (select hs_url, r <= floor((select count(*) from outside) * 0.2::double) as is_train
                  from {_shuffled(2, 'hs_url', '', 'outside')})
         select exampleid, hs_url, label, is_train from world join seen using (hs_url) where label = 0
         union all
         select exampleid, hs_url, label, (r - 1) % 10 <> 0
         from {_shuffled(2, 'exampleid', '', '(select * from world where label = 1)')}""",
}

# --- evaluation ----------------------------------------------------------------------

# The shares of flagged rows, in percent, and the names of their metrics.
SHARES = [0.01, 0.05, 0.1, 0.5, 1, 5, 10]
SHARE_NAMES = [
    "0_point_01_percent", "0_point_05_percent", "0_point_1_percent", "0_point_5_percent", "1_percent", "5_percent",
    "10_percent",
]
SHARE_VIEW = (
    "shares as (select * from (values "
    + ", ".join(f"({t / 100!r}::double, '{n}')" for t, n in zip(SHARES, SHARE_NAMES))
    + ") v(share, name))"
)
# Every row is compared with the cut-off score found by rank, unlike the Spark query.
FLAGGED = """ranked as (
  select g, label, score, row_number() over (partition by g order by score desc) - 1 as idx,
         count(*) over (partition by g) as n from scored),
cutoffs as (
  select g, share, name, score as cutoff from ranked, shares
  where idx = least(floor(n * share)::bigint, n - 1)),
counted as (
  select g, share, name, cutoff, sum(label) filter (where score > cutoff) as tp,
         count(*) filter (where score > cutoff) as flagged, sum(label) as pos
  from cutoffs join scored using (g) group by all),
quality as (
  select g, share, name, cutoff, coalesce(tp / nullif(flagged, 0), 0)::double as precision,
         coalesce(tp / nullif(pos, 0), 0)::double as recall,
         coalesce(2 * tp / nullif(flagged + pos, 0), 0)::double as f1 from counted)"""
AREA = """area as (
  select g, sum(case when label = 1 then lower + tied / 2.0 end) / nullif(sum(label) * (count(*) - sum(label)), 0) as auc
  from (select g, label,
               coalesce(sum(1 - label) over (partition by g order by score groups between unbounded preceding and 1 preceding), 0) as lower,
               sum(1 - label) over (partition by g, score) as tied
        from scored) group by g)"""
_RECORD = ", ".join(
    f"round(max(case when name = '{n}' then {m} end), 6) as {m}_at_{n}" for m in ("precision", "recall", "f1") for n in SHARE_NAMES
)
_RAW_RECORD = ", ".join(
    f"max(case when name = '{n}' then {m} end) as {m}_at_{n}" for m in ("precision", "recall", "f1") for n in SHARE_NAMES
)
_AVERAGES = ", ".join(
    f"round(avg({m}_at_{n}), 6) as {m}_at_{n}" for m in ("precision", "recall", "f1") for n in SHARE_NAMES
)
CURVE = """curve as (
  select g, score, (sum(neg) over w)::bigint as fp, (sum(pos) over w)::bigint as tp,
         (sum(neg) over (partition by g))::bigint as n_neg, (sum(pos) over (partition by g))::bigint as n_pos
  from (select g, score, sum(label) as pos, sum(1 - label) as neg from scored group by g, score)
  window w as (partition by g order by score desc rows unbounded preceding)),
points as (
  select * from curve
  union all select g, max(score) + 1, 0, 0, max(n_neg), max(n_pos) from curve group by g)"""
_ONE = "scored as (select 0 as g, label, score from scores)"
_BY_FOLD = "scored as (select fold as g, label, score from folded)"

ORACLE |= {
    "roc_points": _with(SCORES, _ONE, CURVE)
    + "select score as threshold, round(fp / n_neg, 6) as fpr, round(tp / n_pos, 6) as tpr from points",
    "roc_corners": _with(SCORES, _ONE, CURVE)
    + """select score as threshold, round(fp / n_neg, 6) as fpr, round(tp / n_pos, 6) as tpr from (
           select *, fp - lag(fp) over w as dx, tp - lag(tp) over w as dy, row_number() over w as i,
                  lead(fp) over w - fp as next_dx, lead(tp) over w - tp as next_dy
           from points window w as (order by score desc))
         where i <= 2 or next_dx is null or next_dx <> dx or next_dy <> dy""",
    "auc": _with(SCORES, _ONE, AREA) + "select round(auc, 6) as auc from area",
    "precision_at_k": _with(SCORES, _ONE, SHARE_VIEW, FLAGGED)
    + """select share, cutoff, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1
         from quality""",
    "fold_metrics": _with(SCORES, FOLDED, _BY_FOLD, SHARE_VIEW, FLAGGED, AREA)
    + f"select g as fold, round(max(auc), 6) as auc, {_RECORD} from quality join area using (g) group by g",
    "fold_averages": _with(SCORES, FOLDED, _BY_FOLD, SHARE_VIEW, FLAGGED, AREA)
    + f"""select 'n_chars' as model_id, round(avg(auc), 6) as auc, {_AVERAGES} from (
           select g, max(auc) as auc, {_RAW_RECORD} from quality join area using (g) group by g)""",
    "mean_roc": _with(SCORES, FOLDED, _BY_FOLD, CURVE)
    + """, steps as (
           select *, lag(fp, 1, 0) over w as fp0, lag(tp, 1, 0) over w as tp0 from curve
           window w as (partition by g order by score desc)),
         grid as (
           select g, i, case when i = 0 then 0.0 when i = 299 then 1.0 else
                    (tp0 + (tp - tp0) * (i * n_neg / 299.0::double - fp0) / nullif(fp - fp0, 0)) / n_pos end as tpr
           from steps, range(300) t(i)
           where (fp0 * 299 <= i * n_neg and i * n_neg < fp * 299) or (i = 299 and fp = n_neg and tp = n_pos))
         select i, round(i / 299.0::double, 6) as fpr, round(avg(tpr), 6) as tpr from grid group by i""",
}

# --- neighbours ----------------------------------------------------------------------

INSTANCES = "instances as (select vec_id as id, label as site, embedding::double[] as f from embeddings)"
WORLDS = "worlds as (select id, least(site, 8) as site, f from instances)"
_L1 = "list_sum(list_transform(list_zip(a.f, b.f), lambda x: case when x[1] = -1 or x[2] = -1 then 0 else abs(x[1] - x[2]) end))"


def _neighbours(table: str, dist: str, k: int, relation: str = "'any'") -> str:
    return f"""near as (
  select * from (
    select *, row_number() over (partition by id, relation order by dist, neighbour) as rank from (
      select a.id, b.id as neighbour, b.site as neighbour_site, {relation} as relation, {dist} as dist
      from {table} a join {table} b on a.id <> b.id))
  where rank <= {k})"""


_VOTES = """votes as (
  select id, site, case when lo = hi and n = 2 then lo else 8 end as guess
  from worlds left join (
    select id, min(neighbour_site) as lo, max(neighbour_site) as hi, count(*) as n from near group by id) using (id))"""

ORACLE |= {
    "knn_neighbours": _with(INSTANCES, _neighbours("instances", _L1, 5))
    + "select id, rank, neighbour, round(dist, 6) as dist from near",
    "knn_euclidean": _with(INSTANCES, _neighbours("instances", "list_distance(a.f, b.f)", 5))
    + "select id, rank, neighbour, round(dist, 6) as dist from near",
    "knn_missing": _with(
        INSTANCES.replace(
            "embedding::double[] as f", "list_transform(embedding::double[], lambda x, j: case when (vec_id * 7 + (j - 1) * 5) % 11 = 0 then -1 else x end) as f"
        ),
        _neighbours("instances", _L1, 5),
    )
    + "select id, rank, neighbour, round(dist, 6) as dist from near",
    "knn_same_other": _with(
        INSTANCES, _neighbours("instances", _L1, 5, "case when a.site = b.site then 'same' else 'other' end")
    )
    + "select id, relation, rank, neighbour, round(dist, 6) as dist from near",
    "knn_vote": _with(INSTANCES, WORLDS, _neighbours("worlds", _L1, 2), _VOTES) + "select id, site, guess from votes",
    "knn_accuracy": _with(INSTANCES, WORLDS, _neighbours("worlds", _L1, 2), _VOTES)
    + """select round(avg((guess = site)::int) filter (where site <> 8), 6) as tp,
         round(avg((guess = site)::int) filter (where site = 8), 6) as tn from votes""",
    "knn_stacked": _with(INSTANCES)
    + "select id, site, case when site < 8 then 'closed' else 'open' end as world from instances",
    "knn_distance": _with(INSTANCES)
    + """select a.id, a.site, round(list_sum(list_transform(list_zip(a.f, b.f, range(64)),
           lambda x: case when x[1] = -1 or x[2] = -1 then 0 else abs(x[1] - x[2]) end * (0.5 + x[3] / 64.0::double))), 6) as dist
         from instances a join instances b using (site)
         where b.id = (select min(id) from instances c where c.site = a.site)""",
}

# --- scaling, naive Bayes, rankings of models and features --------------------------------

ROWS = """points as (select vec_id as exampleid, (label < 5)::int as label, embedding::double[] as f from embeddings)"""
FOLDED_ROWS = f"folded_points as (select exampleid, label, f, ((r - 1) % 5)::int as fold from {_shuffled(4, 'exampleid', 'label', 'points')})"
VALUES = """vals as (select exampleid, label, fold, unnest(f) as x, unnest(range(len(f))) as i from folded_points)"""
STATS = """stats as (
  select t.fold, i, avg(x) as mean, case when stddev_pop(x) = 0 then 1 else stddev_pop(x) end as std
  from vals v join (select distinct fold from vals) t on v.fold <> t.fold group by t.fold, i)"""
_SCALE = _with(ROWS, FOLDED_ROWS, VALUES, STATS)

ORACLE |= {
    "fold_stats": _SCALE + "select fold, i::int as i, round(mean, 6) as mean, round(std, 6) as std from stats",
    "standardised": _SCALE
    + """select exampleid, fold, i::int as i, round((x - mean) / std, 6) as x
         from vals join stats using (fold, i)""",
    "gaussian_nb_scores": _with(ROWS)
    + """, vals as (select exampleid, label, unnest(f) as x, unnest(range(len(f))) as i from points),
         wobble as (select 1e-9::double * max(v) as e from (select var_pop(x) as v from vals group by i)),
         stats as (select label as c, i, avg(x) as m, var_pop(x) + max(e) as v from vals, wobble group by label, i),
         prior as (select label as c, ln(count(*) / sum(count(*)) over ()) as p from points group by label),
         joint as (
           select exampleid, vals.label, stats.c,
                  sum(-0.5::double * ln(2 * pi() * v) - (x - m) * (x - m) / (2 * v)) as l
           from vals join stats using (i) group by exampleid, vals.label, stats.c),
         post as (select exampleid, label, max(case when c = 1 then l + p end) as a, max(case when c = 0 then l + p end) as b
                  from joint join prior using (c) group by exampleid, label)
         select exampleid, label, round(1 / (1 + exp(b - a)), 4) as score from post""",
    **tree_sql(_with(ROWS)),
    "top_importances": _with(ROWS)
    + """, vals as (select label, unnest(f) as x, unnest(range(len(f))) as i from points),
         means as (select 'feature_' || i as feature,
                          avg(x) filter (where label = 1) - avg(x) filter (where label = 0) as importance
                   from vals group by i)
         select feature, round(importance, 6) as importance from means order by abs(means.importance) desc, feature limit 30""",
    "best_model": _with(SCORES)
    + """, scored as (
           select 'longer' as g, label, score from scores union all select 'shorter', label, -score from scores
           union all select 'later', label, exampleid::double from scores),
         """
    + AREA
    + " select g as model_id, round(auc, 6) as auc from area order by area.auc desc limit 1",
    "fit_plan": _with(SCORES, FOLDED)
    + """, runs as (
           select 'RandomForest' as model_type, unnest(range(3 * 4 * 7 * 2 * 3)) as run
           union all select 'DecisionTreeClassifier', unnest(range(2 * 4 * 2 * 3))
           union all select unnest(['ExtraTrees', 'RandomForestBagging', 'RandomForestBoosting']), 0),
         sizes as (select fold, count(*) as n_test, (select count(*) from folded) - count(*) as n_train
                   from folded group by fold)
         select model_type, run::int as run, fold, n_train, n_test from runs, sizes""",
    "log_ingest": _with(TRACES)
    + """select exampleid, ingoing, circuit, case when cellid % 5 = 3 then -stream else stream end as stream, command,
                case when cellid % 5 = 3 then -length else length end as length,
                case when cellid % 5 = 2 then t_us // 1000000 * 1000000 else t_us end as t_us
         from traces where cellid % 5 <> 4""",
    "log_stream_rejected": _with(TRACES)
    + """select exampleid, printf('%d.%06d %s CIRC %d, STREAM %d, COMMAND %s', t_us // 1000000, t_us % 1000000,
                                  case when ingoing then 'INCOMING' else 'OUTGOING' end, circuit, stream, command) as value
         from traces where cellid % 5 = 4""",
    "append_sites": _with(CLASSES)
    + """, new as (select split_part(url, 'onion', 1) || 'onion' as hs_url, contains(class_name, 'sd') as is_sd, class_name as sorted_class
                   from classes where class_name is not null)
         select r * (select count(*) from new) + row_number() over (partition by r order by sorted_class, hs_url) as hsid,
                hs_url, is_sd, sorted_class from new, range(2) t(r)""",
    "append_crawls": """select row_number() over (order by s_name) as crawlid, s_name as entry_node, s_nationkey::int as asn, 'amd64' as os,
         null::varchar as city from supplier""",
    "stored_fold_curves": _with(SCORES, FOLDED, _BY_FOLD, CURVE)
    + """select 'n_chars' as model_id, g as fold, round(score, 6) as threshold, round(fp / n_neg, 6) as fpr, round(tp / n_pos, 6) as tpr from (
           select *, fp - lag(fp) over w as dx, tp - lag(tp) over w as dy, row_number() over w as i,
                  lead(fp) over w - fp as next_dx, lead(tp) over w - tp as next_dy
           from points window w as (partition by g order by score desc))
         where i <= 2 or next_dx is null or next_dx <> dx or next_dy <> dy""",
    "grid_records": _with(SCORES, FOLDED)
    + """, runs as (
           select 'RandomForest' as model_type, d * f as sharing
           from (select unnest([1, 1, 2, 2]) as d), (select unnest([2, 1, 1, 1, 1, 1, 2]) as f), range(2 * 3 * 3)
           union all select 'DecisionTreeClassifier', 1 from range(2 * 4 * 2 * 3)
           union all select unnest(['ExtraTrees', 'RandomForestBagging', 'RandomForestBoosting']), 1)
         select model_type, sharing::bigint as sharing, (select count(*) from folded) as tested,
                (select count(distinct fold) from folded) as folds from runs""",
    "log_stream": _with(TRACES) + "select exampleid, ingoing, circuit, stream, command, length, t_us from traces",
    "feature_files": _with(INSTANCES)
    + """, named as (select *, row_number() over (partition by site order by id) as instance from instances),
         kept as (select *, row_number() over (partition by site order by instance) as r from named where instance >= 5)
         select site, instance::int as instance, (unnest(range(len(f))))::int as i, round(unnest(f), 6) as x
         from kept where r <= 20""",
    "csv_round_trip": _with(EXAMPLES) + "select * from examples",
    "append_examples": """select (select max(o_orderkey) from orders)
           + row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as exampleid,
           l_suppkey as hsid, l_linenumber as crawlid, l_shipdate as t_scrape from lineitem""",
    "stored_fold_records": _with(SCORES, FOLDED, _BY_FOLD, SHARE_VIEW, FLAGGED, AREA)
    + f"""select 'n_chars' as model_id, g as fold, timestamp '2001-08-02' as fold_timestamp,
          round(max(auc), 6) as auc, {_RECORD} from quality join area using (g) group by g""",
}
ORACLE["log_stream_odd"] = ORACLE["log_ingest"]  # the same records by another reader
