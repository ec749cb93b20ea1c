"""Oracle SQL of the grown trees: the same draws and rules, one level after another, on long rows."""

from __future__ import annotations

from tracelab.operators import trees as tr
from tracelab.operators.trees import Spec

W, M = 4294967296, 1540483477
EXTRA = Spec(trees=4, features=4, max_depth=3, random=True, seed=7)
SINGLE = Spec(trees=1, features=8, max_depth=3, min_split=40, seed=11)


def _mix(h: str, x: str, name: str) -> str:
    """Columns <name>_a and <name>: a hash step. Later columns may use them."""
    return f"({h} + {x}) % {W} * {M} % {W} as {name}_a, xor({name}_a, {name}_a >> 15) as {name}"


def _drawn(salt: int, name: str) -> str:
    steps = [_mix("key", str(salt), f"{name}1"), _mix(f"{name}1", "i", f"{name}2"), _mix(f"{name}2", "9", name)]
    return ", ".join(steps)


def _keys(spec: Spec) -> str:
    rows, level = [], [(t, "", int(tr.root_key(spec, t))) for t in range(spec.trees)]
    for _ in range(spec.max_depth):
        rows += level
        level = [(t, p + "LR"[s], int(tr.child_key(k, s))) for t, p, k in level for s in (0, 1)]
    return "keys(tree, path, key) as (values " + ", ".join(f"({t}, '{p}', {k}::bigint)" for t, p, k in rows) + ")"


def _levels(spec: Spec) -> str:
    """CTEs in<d> (tree, exampleid, label, path), best<d> (the splits of a level)."""
    out = [
        "vals as (select exampleid, unnest(f) as v, unnest(range(len(f)))::bigint as i from points)",
        _keys(spec),
        f"in0 as (select tree::int as tree, exampleid, label, '' as path from points, range({spec.trees}) t(tree))",
    ]
    if not spec.random:
        q = tr.BINS
        out += [
            "ordered as (select i, v, row_number() over (partition by i order by v) - 1 as r, count(*) over (partition by i) as n from vals)",
            f"""picked as (select distinct i, v from ordered where r in (select floor(k::double / {q} * (n - 1)) from range({q + 1}) g(k)))""",
            "cuts as (select i, v as c from (select *, min(v) over w as lo, max(v) over w as hi from picked window w as (partition by i)) where v > lo and v < hi)",
        ]
    for d in range(spec.max_depth):
        ends = f"""select n.tree, n.path, key, x.i, min(v) as lo, max(v) as hi from in{d} n join open{d} using (tree, path)
          join keys using (tree, path) join vals x using (exampleid) group by all"""
        threshold = (
            f"unnest([case when lo + u / {W} * (hi - lo) >= hi then lo else lo + u / {W} * (hi - lo) end]) as c"
            if spec.random
            else "unnest((select list(c order by c) from cuts where cuts.i = tried.i)) as c"
        )
        out += [
            f"open{d} as (select tree, path from in{d} where length(path) = {d} group by tree, path having count(*) >= {spec.min_split} and sum(label) between 1 and count(*) - 1)",
            f"ends{d} as ({ends})",
            f"drawn{d} as (select *, {_drawn(7, 'h')}, {_drawn(11, 'u')} from ends{d} where {'lo < hi' if spec.random else 'exists (from cuts where cuts.i = ends' + str(d) + '.i and lo <= c and c < hi)'})",
            f"tried{d} as (select *, row_number() over (partition by tree, path order by h, i) as r from drawn{d} qualify r <= {spec.features})",
            f"cut{d} as (select tree, path, i, r, {threshold} from (select *, i as j from tried{d}) tried)",
            f"""counts{d} as (select n.tree, n.path, x.i, r, c, count(*) filter (v <= c and label = 0) as l0, count(*) filter (v <= c and label = 1) as l1,
              count(*) filter (v > c and label = 0) as r0, count(*) filter (v > c and label = 1) as r1
              from in{d} n join vals x using (exampleid) join cut{d} using (tree, path, i) group by all)""",
            f"""best{d} as (select * from counts{d} where l0 + l1 > 0 and r0 + r1 > 0
              qualify row_number() over (partition by tree, path order by (l0 * l1)::double / (l0 + l1) + (r0 * r1)::double / (r0 + r1), r, c) = 1)""",
            f"""in{d + 1} as (select n.tree, exampleid, n.label, n.path || case when b.i is null then '' when x.v <= b.c then 'L' else 'R' end as path
              from in{d} n left join best{d} b using (tree, path) left join vals x using (exampleid, i))""",
        ]
    return ", ".join(out)


def nodes_sql(start: str, spec: Spec) -> str:
    levels = range(spec.max_depth)
    splits = " union all ".join(f"select tree, path, i, c from best{d}" for d in levels)
    nodes = " union all ".join(f"select tree, substr(path, 1, {d}) as path, label from in{spec.max_depth} where length(path) >= {d}" for d in range(spec.max_depth + 1))
    return f"""{start}, {_levels(spec)}, splits as ({splits}), nodes as (select tree, path, sum((label = 0)::int)::bigint as negative, sum(label)::bigint as positive from ({nodes}) group by all)
      select tree, path, coalesce(i, -1)::int as feature, round(coalesce(c, 0), 6) as threshold, negative, positive from nodes left join splits using (tree, path)"""


def scores_sql(start: str, spec: Spec) -> str:
    last = f"in{spec.max_depth}"
    return f"""{start}, {_levels(spec)}, leaves as (select tree, path, sum(label)::double / count(*) as share from {last} group by all)
      select exampleid, label, round(sum(share) / {spec.trees}, 6) as score from {last} join leaves using (tree, path) group by all"""


def tree_sql(start: str, extra: Spec = EXTRA, single: Spec = SINGLE) -> dict[str, str]:
    return {
        "extra_tree_nodes": nodes_sql(start, extra),
        "extra_tree_scores": scores_sql(start, extra),
        "decision_tree_scores": scores_sql(start, single),
    }
