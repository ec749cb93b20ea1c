"""Operators 2 and 3: shingle join and suffix-array dedup, against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import by_id, documents, prose, rows
from tracelab.llm import components, shingle_join, suffix_dedup, suffix_sort


def brute_classes(data):
    sets = {}
    for i, t, *_ in data:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()
    up = {i: i for i in sets}
    links = Counter()

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 75 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i), links[i]) for i in ids]


def family(n, seed):
    """Many near copies that differ in a word or two, and documents that share a passage."""
    rng = random.Random(seed)
    base, line = prose(rng, 60).split(), prose(rng, 14)
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        out.append((1000 + k, " ".join(words), "en", "s", 0))
    return out + [(5000 + k, line + " " + prose(rng, rng.randint(2, 12)), "en", "s", 0) for k in range(n)]


@pytest.mark.parametrize("tokens", [1 << 20, 200])
def test_classes_equal_brute_force(spark, monkeypatch, tokens):
    monkeypatch.setattr(shingle_join, "GROUP_TOKENS", tokens)  # 200: families are cut into many groups
    monkeypatch.setattr(shingle_join, "QUERY_TOKENS", 4 * tokens)
    data = rows() + family(40, 2)
    out = shingle_join.shingle_links(documents(spark, data))
    assert by_id(out, "doc_id", "n_shingles", "component_id", "n_links") == brute_classes(data)


def test_stragglers_of_a_family_keep_their_links(spark, monkeypatch):
    """Heavily changed copies, so that many share too few least hashes with the family, and chains off its edge."""
    rng = random.Random(5)
    base, data = prose(rng, 90).split(), []
    for k in range(60):
        words = list(base) if k % 3 else data[rng.randrange(len(data))][1].split() if data else list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = prose(rng, 1)
        data.append((k, " ".join(words), "en", "s", 0))
    monkeypatch.setattr(shingle_join, "ROUNDS", 1)  # leaves more of them outside the large group
    out = shingle_join.shingle_links(documents(spark, data))
    assert by_id(out, "doc_id", "n_shingles", "component_id", "n_links") == brute_classes(data)


def test_classes_of_repeated_rows_and_of_none(spark):
    data = rows()
    twice = shingle_join.shingle_links(documents(spark, data + data[:5]))
    assert {r[:3] for r in by_id(twice, "doc_id", "n_shingles", "component_id")} == {r[:3] for r in brute_classes(data)}
    alone = shingle_join.shingle_links(documents(spark, [(None, "a b", "", "", 3)])).collect()
    assert [tuple(r) for r in alone] == [(None, 1, None, 0)]
    assert shingle_join.shingle_links(documents(spark, [])).count() == 0


def clashing():
    """Texts under one id, and without any; each text is a row of its own."""
    rng = random.Random(11)
    long = prose(rng, 120)
    near = long.rsplit(" ", 3)[0]
    data = [(1, long, "en", "s", 0), (1, prose(rng, 130), "en", "s", 0), (2, near, "en", "s", 0), (None, near + " and more", "en", "s", 0)]
    data += [(None, prose(rng, 140), "de", "s", 0), (None, "", "en", "s", 0), (None, None, "en", "s", 0), (5, "", "en", "s", 0), (1, "", "en", "s", 0)]
    return data + [(-7, data[1][1], "en", "s", 0), (9, prose(rng, 100), "en", "s", 0)]


def test_clashing_and_null_ids_keep_their_documents(spark):
    data = clashing()
    keys = [(k, t) for k, (_, t, *_) in enumerate(data)]
    brute = {k: (n, group) for k, n, group, _ in brute_classes(keys)}
    want = []
    for k, (i, *_) in enumerate(data):
        n, group = brute[k]
        ids = [data[m][0] for m in brute if brute[m][1] == group]
        want.append((i, n, min((x for x in ids if x is not None), default=None)))
    out = shingle_join.shingle_links(documents(spark, data)).collect()
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out)
    kept = shingle_join.one_of_each(documents(spark, data)).collect()
    groups = {}
    for k, (i, t, *_) in enumerate(data):
        groups.setdefault(brute[k][1] if brute[k][0] else k, []).append((i is None, i, t or ""))
    best = [min(g, key=lambda r: (r[0], r[1] or 0)) for g in groups.values()]
    assert sorted(repr((i, t)) for _, i, t in best) == sorted(repr((r["doc_id"], r["text"] or "")) for r in kept)
    cut = suffix_dedup.without_repeats(documents(spark, data), 60, 16).collect()
    want = [(data[k][0], *rest) for k, *rest in brute_removal(keys, 60)]
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in cut]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 20)] + [(7, 7)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert by_id(found, "node", "component") == [(i, 0) for i in range(1, 31)] + [(100 + k, 100) for k in range(1, 20)]


def test_suffix_order_is_the_sorted_order():
    rng = random.Random(4)
    for _ in range(60):
        parts = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(1, 50))) for _ in range(4)]
        data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
        order = suffix_sort.suffix_order(data, ends, 1000)
        stop = np.repeat(ends, [len(p) for p in parts])
        assert sorted(order.tolist()) == list(range(len(data)))
        keys = [data[p : stop[p]] for p in order]
        assert keys == sorted(keys)
        good = order[stop[order] - order >= 8]
        lcp = suffix_sort.common_prefixes(data, good[:-1], good[1:], 8)
        for a, b, n in zip(good, good[1:], lcp):
            x, y = data[a : a + 8], data[b : b + 8]
            assert n == next((k for k in range(8) if x[k] != y[k]), 8)
    assert len(suffix_sort.suffix_order(b"", np.zeros(0, np.int64), 10)) == 0


def brute_removal(data, length):
    texts = {i: (t or "").encode() for i, t, *_ in data}
    seen = Counter(t[k : k + length] for t in texts.values() for k in range(len(t) - length + 1))
    out = []
    for i, t in sorted(texts.items()):
        gone = np.zeros(len(t), np.int8)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = 1
        kept = np.frombuffer(t, np.uint8)[gone == 0].tobytes()
        out.append((i, len(t), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "gram", "hot", "piece"), [(400, 128, 512, 4 << 20), (60, 16, 512, 4 << 20), (60, 16, 2, 4 << 20), (60, 16, 512, 100)])
def test_removal_equals_brute_force(spark, monkeypatch, length, gram, hot, piece):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 5000)
    data = rows() + family(15, 3)
    monkeypatch.setattr(suffix_dedup, "_PIECE", piece)  # the driver's value goes along with the function
    out = suffix_dedup.without_repeats(documents(spark, data), length, gram)
    assert by_id(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removal(data, length)


def test_removal_of_repeated_rows_and_of_none(spark):
    data = rows()
    twice = suffix_dedup.without_repeats(documents(spark, data + data[:3]))
    got = {r["doc_id"]: r["n_removed"] for r in twice.collect()}
    for i, t, *_ in data[:3]:
        n = len((t or "").encode())
        assert got[i] == (n if n >= 400 else 0)
    assert suffix_dedup.without_repeats(documents(spark, [])).count() == 0


def test_groups_are_opened_in_bounded_rounds(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "ROUND_TOKENS", 4000)
    opened, kept = [], shingle_join._sets_of
    monkeypatch.setattr(shingle_join, "_sets_of", lambda docs: opened.append(1) or kept(docs))
    data = rows() + family(40, 2)
    out = shingle_join.shingle_links(documents(spark, data))
    assert by_id(out, "doc_id", "n_shingles", "component_id", "n_links") == brute_classes(data)
    assert len(opened) > 1
