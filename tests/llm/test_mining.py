"""Operators 11 to 13: phrase collocations, WARC archives, ranked lexical search."""

import hashlib
import math
import os
import random
import re
from collections import Counter
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, rows
from tracelab.llm import collocations, lexical, warc
from tracelab.llm.common import scratch_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 11 ------------------------------------------------------------------------------------------


def brute_phrases(data, least, keep):
    f = Counter()
    for _, text, lang, *_ in data:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            for k in range(1, 6):
                f.update(("und" if lang is None else lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    n = Counter()
    for (lang, w), c in f.items():
        n[lang] += c * (len(w) == 1)
    candidates = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= least}
    out = []
    for (lang, w), a in candidates.items():
        if any(m == lang and len(x) > len(w) and 100 * c >= 100 * a and any(x[i : i + len(w)] == w for i in range(len(x))) for (m, x), c in candidates.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.append((lang, score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    out.sort(key=lambda r: (r[0], -r[1], -r[2], r[3].encode()))
    return [(lang, i, p, a, left, right, total, score) for lang, own in groupby(out, key=lambda r: r[0]) for i, (_, score, a, p, left, right, total) in enumerate(own, 1) if i <= keep]


def phrase_rows():
    rng = random.Random(5)
    words = ["the", "The", "of", "été", "ab\x1cc", "x", "東京", "a", "a"]
    lines = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\r\n"]) for _ in range(60)), rng.choice(["en", "de", None, "und"]), "s", 0) for i in range(40)]
    return lines + lines[:7] + [(900, None, "en", "s", 0), (None, "", None, None, None), (901, "a " * 3000, "en", "s", 0), (902, "Foo Bar. Foo bar! foo", "", "s", 0)]


def test_collocations_equal_brute_force(spark):
    data = phrase_rows()
    want = brute_phrases(data, 5, 50)
    assert len({w[0] for w in want}) == 3 and max(w[1] for w in want) == 50
    for lookup in (collocations.LOOKUP_ROWS, 4):  # frequent groups sent along, and joined by a shuffle
        out = collocations.collocations(documents(spark, data), least=5, keep=50, lookup_rows=lookup)
        got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in out.collect())
        assert got == sorted(want)


def test_small_blocks_give_the_same_phrases(spark, monkeypatch):
    for name in ("BLOCK_WORDS", "HELD_WORDS", "HELD_PAIRS"):
        monkeypatch.setattr(collocations, name, 50)
    data = phrase_rows()[:20]
    out = collocations.collocations(documents(spark, data), least=3)
    assert sorted(tuple(r)[:8] for r in out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == sorted(brute_phrases(data, 3, 2000))


def test_collocations_of_nothing(spark):
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, "only these words", "en", "s", 0)])).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_007_199_254_740_993
    row = spark.range(1).select(F.lit(big).alias("n"), F.lit(3 * big).alias("total"), F.array(F.lit(10**12 + 1)).alias("heads"), F.array(F.lit(10**12 + 3)).alias("tails"))
    assert row.select(collocations._weakest_cut(2).alias("b")).first()["b"]["score"] == 1000 * big * 3 * big // ((10**12 + 1) * (10**12 + 3))


# --- 12 ------------------------------------------------------------------------------------------


def page_rows():
    rng = random.Random(3)
    texts = ["<p>é 東京</p>", "", None, "x" * 70_000, "<p>one</p>", "a\r\n\r\nb WARC/1.1\r\n\r\n", "\x00\x01"]
    data = [(i, f"http://example.org/{i % 7}", rng.choice(texts)) for i in range(60)]
    data += [(7, "http://a b/ü\n", "<p>one</p>")] * 3 + [(None, None, "<p>one</p>"), (None, "u%20", "none like it"), (-4, "", "<i>1</i>"), (3, None, "<i>1</i>")]
    rng.shuffle(data)
    return data


def pages(spark, data, parts=3):
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for name in ("row", "member", "size", "file", "digest", "content", "payload"):
        df = df.selectExpr("*", f"'own' AS {name}")
    return df.repartition(parts)


def brute_records(data, least):
    first, out = {}, []
    for page, url, html in sorted(data, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        body = (html or "").encode()
        again = len(body) >= least and body in first
        out.append((page, url, len(body), warc.sha1_text(body), "revisit" if again else "response", first[body] if again else None))
        first.setdefault(body, page)
    return sorted(out, key=repr)


FACTS = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


@pytest.mark.parametrize("least", [0, 20])
def test_archives_round_trip(spark, least):
    data, folder = page_rows(), scratch_path(spark)
    listed = warc.write(pages(spark, data), folder, file_bytes=2000, least=least, slice_rows=10).collect()
    back = warc.read(spark, folder).collect()
    assert sorted((tuple(r[c] for c in FACTS) for r in back), key=repr) == brute_records(data, least)
    texts = Counter((html or "").encode() for *_, html in data)
    assert {bytes(r["payload"]) for r in back if r["record_type"] == "response"} == set(texts)
    assert sum(r["records"] for r in listed) == len(data) and len(listed) > 2
    path = folder.removeprefix("file:")
    assert sorted(n for n in os.listdir(path) if n.endswith(".gz")) == sorted(r["name"] for r in listed)
    assert not os.path.exists(f"{path}/_temporary")
    for r in listed:
        with open(f"{path}/{r['name']}", "rb") as f:
            assert hashlib.sha256(f.read()).hexdigest() == r["sha256"]


def test_archives_do_not_depend_on_partitions(spark):
    data, seen = page_rows(), []
    for parts, slice_rows in ((1, 1000), (5, 7)):
        listed = warc.write(pages(spark, data[::-1] if parts > 1 else data, parts), scratch_path(spark), file_bytes=3000, slice_rows=slice_rows)
        seen.append(sorted(tuple(r) for r in listed.collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 1


def test_damage_is_found(spark):
    folder = scratch_path(spark)
    warc.write(pages(spark, page_rows()), folder)
    path = f"{folder.removeprefix('file:')}/00000000.warc.gz"
    with open(path, "rb") as f:
        whole = f.read()
    with open(path, "wb") as f:
        f.write(whole[:-30])
    with pytest.raises(Exception, match="ends within|not what|damaged|Error"):
        warc.read(spark, folder).collect()
    record = next(iter(warc.members(__import__("io").BytesIO(whole))))
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(record.replace(b"200 OK", b"404 OK"))


def test_no_pages(spark):
    folder = scratch_path(spark)
    assert warc.write(pages(spark, []), folder).count() == 0
    assert warc.read(spark, folder).count() == 0


# --- 13 ------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_ranks(docs, items, k):
    texts = [(d, TERM.findall((t or "").translate(LOWER))) for d, t, *_ in docs]
    n_docs, n_terms = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for at, (doc, words) in enumerate(texts):
            tf, score = Counter(words), 0
            for t in set(TERM.findall((text or "").translate(LOWER))) & set(tf):
                m = 100 - 90 + (90 * len(words) * n_docs) // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, at))
        out += [(item, i, None if none else doc, -s) for i, (s, none, doc, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search_data():
    data = rows(9, 60) + [(None, "abc de", "en", "s", 0), (12, "twice the id", "en", "s", 0), (12, "twice the id", "en", "s", 0), (3000, "A1é " * 9000, "en", "s", 0)]
    rng = random.Random(2)
    items = [(i, " ".join((rng.choice(data)[1] or "none").split()[:12])) for i in range(30)]
    return data, items + [(5, "twice ID the"), (77, None), (78, ""), (79, "zzzzzzzzzz"), (None, "ÉTÉ a1é 東京"), (80, data[3][1])]


def test_ranks_equal_brute_force(spark, monkeypatch):
    data, items = search_data()
    benchmark = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS row", "2 AS n").coalesce(1)
    want = brute_ranks(data, items, 10)
    for bits, bundle, owners, terms in ((12, 128, 4, 200_000), (2, 3, 3, 40), (1, 1, 1, 5)):
        monkeypatch.setattr(lexical, "BLOCK_BITS", bits)
        monkeypatch.setattr(lexical, "BLOCK_ROWS", 1 << bits)
        monkeypatch.setattr(lexical, "BUNDLE_ITEMS", bundle)
        if bits == 1:
            benchmark, want = benchmark.where("item_id = 5 OR item_id = 78"), brute_ranks(data, [i for i in items if i[0] in (5, 78)], 10)
        out = lexical.ranked(documents(spark, data), benchmark, owners=owners, slice_terms=terms)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == want


def test_ranks_of_nothing(spark):
    data, items = search_data()
    none, benchmark = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert lexical.ranked(documents(spark, []), benchmark).count() == 0
    assert lexical.ranked(documents(spark, data), none).count() == 0
