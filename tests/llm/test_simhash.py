from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import xxhash
from trawlspark.llm import simhash
from trawlspark.llm.components import connected_components
from trawlspark.llm.golay import key_table


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def family(rng, n):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


def test_values_within_one_bit_share_an_index():
    keys, starts = key_table(12)
    lists = [set(keys[starts[v] : starts[v + 1]].tolist()) for v in range(1 << 12)]
    assert all(lists[v] & lists[v ^ 1 << b] for v in range(1 << 12) for b in range(12))


def test_three_errors_leave_a_shared_key():
    rng = random.Random(5)
    for _ in range(400):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 3)):
            y ^= 1 << b
        a, b = (set(simhash.keys_of(np.array([v], np.uint64))[0].tolist()) for v in (x, y))
        assert a & b


def check_links(spark, fps):
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
    near = [(signed(a), signed(b)) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    want = roots([signed(x) for x in fps], near)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups({**{signed(x): signed(x) for x in fps}, **got}) == groups(want)


def test_links_match_brute_force(spark):
    check_links(spark, family(random.Random(1), 400))


def test_hot_keys_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rng.sample(range(40, 64), rng.randint(0, 5))) for _ in range(150)}
    check_links(spark, sorted(fps | set(family(rng, 50))))


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 3 else [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_documents_with_nulls_copies_and_other_columns(spark):
    texts = ["a b c d e", "A b  c\td e", None, "", " \n", "one", "one two", "ü ß ü", "x " * 50000 + "y", "a b c d e"]
    rows = [(i if i != 7 else None, t, "f", 1) for i, t in enumerate(texts)] + [(1, texts[1], "f", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, root int")
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fp) for r in got) == sorted((str(i), signed(brute_fingerprint(t))) for i, t, *_ in rows)
    by = {r.doc_id: r.component_id for r in got}
    assert by[0] == by[1] == by[9] == 0 and by[2] == by[3] == by[4] == 2 and by[5] == 5
    kept = simhash.one_of_each(df).collect()
    assert {r.doc_id for r in kept} == {0, 2, 5, 6, 8, None} and len(kept) == 6 and kept[0].fp == "f"
    empty = df.limit(0)
    assert simhash.near_duplicates(empty).collect() == [] and simhash.one_of_each(empty).collect() == []
