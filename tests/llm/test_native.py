"""Operators 4, 7 and 10: raking, credential linking, multiset hash."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import by_id, documents, rows
from tracelab.llm import credentials, multiset_hash, raking
from tracelab.session import durable

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


KEY, SECRET = "AKIA" + "Q7" * 8, "wJalrXUtnFEMIK7MDENGbPxRfiCYzEXAMPLEKEY"
TEXTS = [
    'password="hunter22" é secret=token:xyz12345 api_key: abc',
    f"id {KEY} and AKIAAKIA1 then " + "0a" * 12 + " ff " + "0b" * 11,
    f"AKIA{KEY}",
    f"client_id = bob77 {SECRET} https://db.example.org/x",
    f"client_id = bob77 {'.' * 300} {SECRET}",
    "https://example.org/page and nothing else",
    f"{'y' * 250} pw {SECRET} {'z' * 150} postgres://u@h/db",
    "PASSWD='ABCDEF' Token = a.b-c_d+e/f=",
]


def credential_rows():
    return [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)] + [(100 + r[0], *r[1:]) for r in rows()[::4]] + [(900, None, None, None, None), (None, TEXTS[0], "", "", 0)]


def test_base_spans_and_links(spark):
    data = credential_rows()
    out = {r["doc_id"]: r for r in credentials.scan(documents(spark, data + data[:2])).collect()}
    assert credentials.scan(documents(spark, data + data[:2])).count() == len(data) + 2
    for i, t, *_ in data:
        spans = base_spans(t or "")
        mark = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        assert out[i]["base_sha256"] == hashlib.sha256(mark.encode()).hexdigest()
        assert [out[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(mark.split(",")) - {""} <= set(out[i]["spans"].split(","))
    kinds = lambda i: sorted(s.split(":")[0] for s in out[i]["spans"].split(",") if s)
    assert kinds(3) == ["account", "endpoint", "mixed"]  # each is completed by another
    assert kinds(4) == [] and kinds(5) == []  # too far, or alone
    assert kinds(6) == ["endpoint", "mixed"]  # over the edge of a bucket
    assert credentials.scan(documents(spark, [])).count() == 0


def test_long_secrets_link_from_end_to_begin(spark):
    long, account, url = "aB3" * 100, "client_id = bob77", "https://db.example.org/x"
    texts = {
        1: f"{long} {url}", 2: f"{url} {long}", 3: f"{long} {account}", 4: f"secret={long} {url}", 5: f"{'0a' * 150} {account}",
        6: f"{long}{' ' * 256}{url}", 7: f"{long}{' ' * 257}{url}", 8: f"{url}{' ' * 257}{long}", 9: f"{url} {'.' * 200} {'aB3' * 900} {'.' * 200} {account}",
    }
    docs = documents(spark, [(i, t, "en", "s", len(t)) for i, t in texts.items()])
    kinds = {r["doc_id"]: sorted(s.split(":")[0] for s in r["spans"].split(",") if s) for r in credentials.scan(docs).collect()}
    both = ["endpoint", "mixed"]
    assert kinds == {
        1: both, 2: both, 3: ["account", "mixed"], 4: ["assign", "endpoint"], 5: ["account", "hex"], 6: both, 7: [], 8: [],
        9: ["account", "endpoint", "mixed"],
    }
    assert {r["doc_id"]: r["text"] for r in credentials.masked(docs, "#").collect()}[1] == "# #"


def test_links_equal_brute_force(spark):
    data = []
    for k in range(60):  # positions of parts that overlap, nest, touch and stand apart
        rng = random.Random(k)
        for _ in range(12):
            kind, begin = rng.choice(credentials.KINDS), rng.randrange(3000)
            data.append((k, k, k, kind, credentials.ROLE[kind], begin, begin + rng.choice([5, 40, 300, 900]), kind in credentials.BASE))
    found = spark.createDataFrame(data, "row long, doc_id long, content long, kind string, role string, begin long, end long, base boolean")
    pairs = {("id", "secret"), ("secret", "id"), ("secret", "endpoint"), ("endpoint", "secret")}
    bare = [p for p in data if p[7] or not any(q[7] and q[0] == p[0] and (q[5] <= p[5] < q[6] or (q[5] >= p[5] and q[5] < p[6])) for q in data)]
    want = {p for p in bare if not p[7] and any(q[0] == p[0] and (p[4], q[4]) in pairs and max(p[5], q[5]) - min(p[6], q[6]) <= credentials.SCOPE for q in bare)}
    got = credentials.linked(found).collect()
    assert {(r["row"], r["kind"], r["begin"], r["end"]) for r in got} == {(p[0], p[3], p[5], p[6]) for p in want} and want


def test_masked_texts(spark):
    data = credential_rows()
    docs = documents(spark, data)
    out = credentials.masked(docs, "#")
    assert out.columns == docs.columns and out.count() == len(data)
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    assert found[0] == TEXTS[0].replace('password="hunter22', "#")
    assert found[5] == TEXTS[5] and found[900] is None
    for i in range(len(TEXTS)):
        assert not base_spans(found[i])


def lanes(text):
    parts = [p for p in re.split(r"[\r\n]+|(?<=[.!?])\s+", text) if p]
    return sorted(hashlib.sha256(p.encode()).hexdigest() for p in parts)


def test_fingerprints(spark):
    data = rows() + [(2000 + 700 * k, t, "en", "s", 0) for k, t in enumerate(["a. b. c.", "c. a. b.", "a. b.", "c.", "q"])]
    out = {r["doc_id"]: r for r in multiset_hash.fingerprints(documents(spark, data)).collect()}
    assert len(out) == len(data)
    order = sorted(data, reverse=True, key=lambda r: r[0])
    for k, (i, t, *_) in enumerate(order):
        t, follows = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follows[:half]
        assert out[i]["n_chars"] == len(t)
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert (out[i]["fingerprint"] == out[i]["edited_fingerprint"]) == (lanes(t) == lanes(edited))
        if lanes(t) == lanes(follows):
            assert out[i]["near_next"] == 1.0
        assert 0 <= out[i]["near_edited"] <= 1 and 0 <= out[i]["near_next"] <= 1
    same = {}
    for i, t, *_ in data:
        same.setdefault(tuple(lanes(t or "")), set()).add(out[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_paragraphs_put_in_and_taken_out(spark):
    df = spark.createDataFrame([("a. b. c.", "b.\na.", "c.")], "x string, y string, z string")
    v = {c: multiset_hash.vector(F.col(c)) for c in "xyz"}
    row = df.select((multiset_hash.added(v["y"], v["z"]) == v["x"]).alias("a"), (multiset_hash.removed(v["x"], v["z"]) == v["y"]).alias("b"), multiset_hash.likeness(v["x"], v["y"]).alias("n")).first()
    assert row["a"] and row["b"] and row["n"] > 0.5


def test_fingerprints_of_few_rows(spark, monkeypatch):
    one = multiset_hash.fingerprints(documents(spark, [(5, "ab cd", "", "", 5)])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"ab ab").hexdigest()
    assert multiset_hash.fingerprints(documents(spark, [])).count() == 0
    monkeypatch.setattr(multiset_hash, "BROADCAST_ROWS", 0)  # the way for many buckets
    data = [(k * 300, str(k), "", "", 1) for k in range(8)] + [(None, "", "", "", 0), (3, "t", "", "", 1), (3, "t", "", "", 1)]
    assert multiset_hash.fingerprints(documents(spark, data)).count() == len(data)


def test_mixture_equals_sql_and_meets_its_targets(spark, tmp_path):
    data = rows(n=80) + [(5000 + i, f"the license and copyright {i} ab", "en", "src1", 0) for i in range(9)] + [(None, "z", None, None, None)]
    docs = documents(spark, data, extra=False)
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    out = raking.sampled(spark.read.parquet(path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/*.parquet'")
    columns = ["doc_id", "source", "lang", "topic", "tokens", "probability", "kept"]
    want = [tuple(r) for r in con.execute(f"select {', '.join(columns)} from ({raking.mixture_sql()})").fetchall()]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in out.collect()))) == sorted(map(str, want))
    cells = raking.cell_totals(raking.measured(docs)).where("tokens > 0")
    targets = {d: raking.tempered(cells, d) for d in raking.DIMENSIONS}
    raked = raking.rake(cells, targets, rounds=60)
    total = raked.agg(F.sum("weight")).first()[0]
    for d, target in targets.items():
        share = {r[d]: r["w"] / total for r in raked.groupBy(d).agg(F.sum("weight").alias("w")).collect()}
        for r in target.collect():
            assert share[r["value"]] == pytest.approx(r["share"], abs=0.02)


def test_achieved_shares_of_the_kept_sample(spark):
    rng = random.Random(4)
    data = []
    for i in range(6000):
        text = "a b c d e f g h " + ("license i" if rng.random() < 0.1 else "j k")
        data.append((i, text, rng.choice(["en", "en", "en", "de"]), rng.choices("abc", [6, 3, 1])[0], 0))
    docs = durable(documents(spark, data, extra=False))
    for share in (0.15, 0.8):  # with the rounds of the queries
        kept = raking.sampled(docs, share).where("kept").collect()
        all_kept = sum(r["tokens"] for r in kept)
        report = {(r["dimension"], r["value"]): r for r in raking.achieved(docs, share).collect()}
        assert len(report) == 3 + 2 + 2
        for (d, v), r in report.items():
            assert r["achieved"] == pytest.approx(sum(k["tokens"] for k in kept if k[d] == v) / all_kept)
            assert r["reachable"] == (r["target"] * share <= r["available"])
            if share == 0.15:  # no cell is kept whole
                assert r["reachable"] and r["achieved"] == pytest.approx(r["target"], abs=0.04)
    scarce = report["topic", "legal"]
    assert not scarce["reachable"] and scarce["available"] < scarce["achieved"] < 0.7 * scarce["target"]
    assert raking.achieved(documents(spark, [], extra=False)).count() == 0


def test_mixture_of_few_rows(spark):
    assert raking.sampled(documents(spark, [])).count() == 0
    assert by_id(raking.sampled(documents(spark, [(1, None, None, None, None)])), "doc_id", "tokens", "lang") == [(1, 0, "(none)")]
    docs = documents(spark, rows())
    kept = raking.kept_rows(docs, share=0.5)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
