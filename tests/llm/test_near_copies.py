from __future__ import annotations

import random
from itertools import combinations

import pytest

import corpus_pipeline
from trawlspark.llm import near_copies, simhash
from trawlspark.llm.common import table, written

from test_simhash import roots


def grams(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(x, y):
    return 9 * len(x & y) >= 4 * (len(x) + len(y))


def near_texts(rng):
    out = []
    for _ in range(40):
        w = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(1, 300))] + "one page has this same end as each of them".split()
        for _ in range(4):
            out.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(0, len(w) // 40 + 1)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("least, broadcast, small", [(8, 200_000, 256), (2, 0, 2)])
def test_links_are_near_copies_and_connect_all_of_them(spark, monkeypatch, least, broadcast, small):
    monkeypatch.setattr(near_copies, "LEAST", least)
    monkeypatch.setattr(near_copies, "BROADCAST", broadcast)
    monkeypatch.setattr(near_copies, "_SMALL", small)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    star = [" ".join(f"s{k}" if rng.random() < 0.02 else w for k, w in enumerate(base, 1000 * i)) for i in range(40)]
    texts = near_texts(rng) + star + [" ".join(base)] + star[:5] + ["", None]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id long, row long, text string")
    named = written(near_copies.nodes(rows), "test")
    node = {r.node: frozenset(grams(texts[r.id])) for r in named.collect()}
    assert all(r.n == len(grams(texts[r.id])) for r in named.collect()) and len(node) == len({frozenset(grams(t)) for t in texts})
    want = [p for p in combinations(node, 2) if near(node[p[0]], node[p[1]])]
    got = [(r.a, r.b) for r in near_copies.links(rows, named).collect()]
    assert all(near(node[a], node[b]) for a, b in got)
    assert roots(sorted(node), got) == roots(sorted(node), want) and len(want) > 60


def test_the_stage_leaves_one_of_each_near_copy(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    sets = {r.doc_id: grams(r.text) for r in docs.collect()}
    root = roots(sorted(sets), [(a, b) for a, b in combinations(sorted(sets), 2) if near(sets[a], sets[b])])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, sf).select("doc_id").collect()}
    assert kept == set(root.values())
    bits = {r.component_id for r in simhash.near_duplicates(docs, by="fingerprints").collect()}
    assert kept < bits


def test_the_stage_links_what_simhash_links(spark):
    end = lambda x: " ".join(f"{x}{i}" for i in range(20))
    spam = "cheap pills for you and your friends " * 30
    texts = [spam + end("a"), spam + end("b"), end("c")]
    fp = [simhash.fingerprint(t, near_copies.SIZE) for t in texts]
    assert (fp[0] ^ fp[1]).bit_count() <= simhash.MAX_BITS < (fp[0] ^ fp[2]).bit_count()
    assert not near(*map(grams, texts[:2]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()) == [0, 2]
