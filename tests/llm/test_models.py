from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from trawlspark.llm import ngram_lm, quality, suffix, toxicity
from trawlspark.llm.suffix import Shard, suffix_array

fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5


# toxicity


def brute_nearest(index, counts, k):
    at, q = index.vectors.unit(counts)
    scores = np.zeros(len(index.ids))
    for t, x in zip(at.tolist(), q.tolist()):
        scores[index.at[t]] += x * index.w[t]
    best = sorted((-round(s, 12), e) for e, s in enumerate(scores.tolist()) if s > 0)[:k]
    return [(e, -s) for s, e in best]


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    v = toxicity.Vectors({w: rng.uniform(1, 5) for w in words})
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 6)))
    index = toxicity.BlockMaxIndex(v, [(i, rng.randint(0, 1), v.counts(text())) for i in range(300)], 0.3)
    for _ in range(300):
        c = v.counts(text())
        assert index.nearest(c, 10) == (brute_nearest(index, c, 10) if c else [])


def test_scores_are_brute_force_votes_whatever_the_ids_are(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(8)]
    v = toxicity.Vectors({w: rng.uniform(1, 5) for w in words})
    text = lambda: " ".join(rng.choices(words, k=rng.randint(0, 3)))
    rows = [(rng.randint(0, 1), v.counts(text())) for _ in range(300)]

    def brute(counts):
        at, q = v.unit(counts)
        q, k, near = dict(zip(at.tolist(), q)), toxicity.NEIGHBOURS, []
        for y, c in rows:
            if c:
                a, w = v.unit(c)
                near.append((round(sum(q.get(t, 0) * x for t, x in zip(a.tolist(), w)), 12), y))
        near = sorted((n for n in near if n[0] > 0), reverse=True)
        last = near[k - 1][0] if len(near) >= k else 0
        above, tied = [n for n in near if n[0] > last], [n for n in near if n[0] == last]
        part = (k - len(above)) / len(tied) if tied else 0
        toxic = sum(s * y for s, y in above) + part * sum(s * y for s, y in tied)
        weight = sum(s for s, _ in above) + part * sum(s for s, _ in tied)
        return (toxic + (0.3 if weight else 0.1) * toxicity.PRIOR_WEIGHT) / (weight + toxicity.PRIOR_WEIGHT)

    scores = []
    for seed in range(3):
        ids = random.Random(seed).sample(range(1000), len(rows))
        index = toxicity.BlockMaxIndex(v, [(i, y, c) for i, (y, c) in zip(ids, rows)], 0.3, 0.1)
        scores.append({c: index.score(c)[0] for _, c in rows if c})
    assert scores[0] == scores[1] == scores[2]
    assert all(abs(s - brute(c)) < 1e-9 for c, s in scores[0].items())


def test_levels_count_as_features():
    v = toxicity.Vectors({"bad": 1.0, "bad@2": 1.0, "ba~": 1.0, "bad@4": 1.0})
    f = toxicity.features("Bad, bad! good")
    names = {v.names[i]: n for i, n in v.counts("Bad, bad! good")}
    assert names == {k: f[k] for k in ("bad", "bad@2")} and "bad@4" not in f


@pytest.fixture(scope="module")
def scores(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    return toxicity.scored(docs, labels).collect(), {r.doc_id: r.toxic for r in labels.collect()}


def test_held_out_accuracy_and_calibration(scores):
    rows, toxic = scores
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    hit = sum(s >= 0.5 and y == 1 for s, y in held)
    assert hit / sum(y for _, y in held) > 0.85
    assert hit / sum(s >= 0.5 for s, _ in held) > 0.95
    assert abs(sum(s for s, _ in held) - sum(y for _, y in held)) < 0.03 * len(held)
    assert sum((s - y) ** 2 for s, y in held) / len(held) < 0.03


def test_scores_of_odd_rows(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["tree", "house", "river"], k=20)) + (" awful awful" if i % 4 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 4 == 0), "x") for i in range(300)] + [(0, 0, "x"), (None, 1, "x"), (5, None, "x"), (9999, 1, "x")]
    docs += [(None, "awful"), (500, None), (501, ""), (502, "awful " * 20000), (0, docs[0][1])]
    d = spark.createDataFrame([(*r, 9) for r in docs], "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, y string")
    got = toxicity.scored(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (fold(r.doc_id) == 0) for r in got)
    by = {r.doc_id: r for r in got}
    assert by[502].predicted == 1 and by[500].score == by[501].score and by[500].evidence == []
    assert all(by[i].predicted == (i % 4 == 0) for i in range(400))
    assert set(by[8].evidence) <= {i for i in range(300) if fold(i) != 0}
    left = toxicity.without_toxic(d, lab)
    assert left.columns == d.columns and left.count() == sum(not r.predicted for r in got)
    assert toxicity.scored(d.limit(0), lab).collect() == []
    assert {r.score for r in toxicity.scored(d, lab.limit(0)).collect()} == {0.0}


# quality rules


def brute_base(text):
    t = text or ""
    words = [w for w in re.split("[ \t-\r]+", t) if w]
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search("[^ \t-\r]", x):
            dup += x in seen
            seen.add(x)
    win = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    c, hit = Counter(win), set()
    for i, w in enumerate(win):
        if c[w] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n)


TEXTS = [None, "", " ", "a\na\n \n \nb", "x " * 25, "é\U0001f600 ## <b> " * 9, "a b c d e f g h " * 3, "\n".join(["same line"] * 12), "a\x1fb　c " * 10, " ".join(f"w{i}" for i in range(30000)), "a b c d e f g h i j a b c d e f g h"]


def test_base_figures(spark):
    rows = [(i, t, "w") for i, t in enumerate(TEXTS)] + [(None, "q " * 30, "w"), (4, TEXTS[4], "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string, words string")
    lab = spark.createDataFrame([(9, 1), (9, 1), (None, 1), (3, None)], "doc_id long, quality int")
    got = quality.ruled(d, lab).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:7]) for r in got) == sorted((str(i), *brute_base(t)) for i, t, _ in rows)
    assert not any(r.kept for r in got if r.base_failed)
    kept = quality.without_bad(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.kept for r in got)
    assert quality.ruled(d.limit(0), lab).collect() == []
    assert all(r.kept != r.base_failed for r in quality.ruled(d, lab.limit(0)).collect())


def test_ratio_tells_junk_from_prose(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    good = {r.doc_id: r.quality for r in labels.collect()}
    got = [r for r in quality.ruled(docs, labels).collect() if not r.base_failed and r.doc_id in good]
    keep = [r for r in got if good[r.doc_id] == 1]
    junk = [r for r in got if good[r.doc_id] == 0]
    assert sum(r.kept for r in keep) / len(keep) > 0.995
    assert sum(r.kept for r in junk) / len(junk) < 0.1


def test_ratio_is_what_its_formula_says(spark):
    d = spark.createDataFrame([(1, "a b a b"), (2, "c c"), (3, "a b")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    w = quality.weights(d, lab)
    grams = lambda t: t.split() + [tuple(x) for x in zip(t.split(), t.split()[1:])]
    raw = Counter(g for t in ("a b a b", "c c", "a b") for g in grams(t))
    target = Counter(grams("a b a b"))
    share = sum(target.values()) / sum(raw.values())
    one = lambda g: round(quality.UNIT * math.log((target[g] + quality.SMOOTH) / (raw[g] * share + quality.SMOOTH)))
    assert Counter(x for x in w if x) == Counter(x for x in map(one, raw) if x)
    llr = {r.doc_id: r.llr for r in quality.ruled(d, lab).collect()}
    assert abs(llr[2] - sum(map(one, grams("c c"))) / 3 / quality.UNIT) < 1e-12


def test_plan_is_native(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    for df in (quality.ruled(docs, labels), quality.without_bad(docs, labels)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


# language model


def test_suffix_arrays_and_counts():
    rng = random.Random(1)
    for _ in range(150):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 4])
        t = np.array([rng.randint(-k, k) for _ in range(n)], np.int64)
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda p: t[p:].tolist())
        m = rng.randint(1, 25)
        q = np.array([rng.randint(-k, k) for _ in range(m)], np.int64)
        who, length, c = Shard(t).drops(q, np.arange(m), m - np.arange(m))
        for i in range(m):
            for size in range(2, m - i + 1):
                want = sum(t[p : p + size].tolist() == q[i : i + size].tolist() for p in range(n - size + 1))
                assert c[(who == i) & (length >= size)].sum() == want


def test_what_cannot_matter_is_left_out():
    rng = random.Random(6)
    for _ in range(200):
        n, k = rng.randint(1, 60), rng.choice([1, 2, 4])
        t = np.array([rng.randint(-k, k) for _ in range(n)], np.int64)
        lengths = [rng.randint(2, 30) for _ in range(4)]
        q = np.array([rng.randint(-k, k) for _ in range(sum(lengths))], np.int64)
        occurs = lambda a, m: sum(t[p : p + m].tolist() == q[a : a + m].tolist() for p in range(n - m + 1))
        at, room = ngram_lm.starts_of(lengths)
        at, room = at[room >= 2], room[room >= 2]
        order = np.argsort(ngram_lm.gram_keys(q, at, 2))
        who, length, c = Shard(t).drops(q, at, room, order)
        got = lambda a, m: c[(at[who] == a) & (length >= m)].sum()
        head = 0
        for size in lengths:
            for i in range(head + 1, head + size):
                s = next((s for s in range(head, i) if occurs(s, i - s)), i)
                if s < i:
                    assert i - s == 1 or got(s, i - s) == occurs(s, i - s)
                    assert got(s, i - s + 1) == occurs(s, i - s + 1)
            head += size


def brute_lm(rows):
    tok = lambda t: (t or "").encode().lower().split() + [b" end"]
    train = [tok(t) for i, t in rows if fold(i) != 1]
    count = Counter(w for x in train for w in x)
    total, distinct = sum(count.values()), len(count)
    grams = Counter(tuple(x[a:b]) for x in train for a in range(len(x)) for b in range(a + 1, len(x) + 1))
    out = []
    for i, t in rows:
        x, base, score = tok(t), 0.0, 0.0
        for k, w in enumerate(x):
            p0 = (count[w] + 0.5) / (total + 0.5 * (distinct + 1))
            base += math.log10(p0)
            s = next((s for s in range(k) if grams[tuple(x[s:k])]), k)
            n, c, a = grams[tuple(x[s:k])], grams[tuple(x[s : k + 1])], ngram_lm.STRENGTH / max(1, k - s) ** 2
            score += math.log10((c + a * p0) / (n + a) if s < k else p0)
        out.append((str(i), fold(i) == 1, len(x), sum(count[w] > 0 for w in x), total, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize(("shard", "unit"), [(10**7, 10**6), (150, 60)])
def test_scores_match_brute_force(spark, monkeypatch, shard, unit):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard)
    monkeypatch.setattr(ngram_lm, "UNIT_TOKENS", unit)
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCD"[: rng.choice([2, 5, 30])], k=rng.choice([0, 1, 2, 6, 40])))) for i in range(50)]
    rows += [(i, rows[rng.randrange(50)][1] + rng.choice(["", " a b", " zz"])) for i in range(50, 80)]
    rows += [(None, "a b c"), (91, None), (5, rows[5][1]), (92, "é É \t\x0b x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, unit int").repartition(3)
    got = sorted((str(r[0]), *tuple(r)[1:5], round(r[5], 6), round(r[6], 6)) for r in ngram_lm.scored(df).collect())
    assert got == brute_lm(rows)
    assert ngram_lm.scored(df.limit(0)).collect() == []


def test_all_held_out_and_context_helps(spark, sf):
    one = ngram_lm.scored(spark.createDataFrame([(7, "a b")], "doc_id long, text string"), held_fold=fold(7)).first()
    assert (one.train_tokens, one.n_known, one.base_score) == (0, 0, 0.0)
    rows = [r for r in ngram_lm.scored(spark.read.parquet(f"{sf}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_counts_from_the_neighbours_of_a_sorted_place(monkeypatch):
    rng = random.Random(8)
    for tokens in (8, 1):
        monkeypatch.setattr(suffix, "_TOKENS", tokens)
        for _ in range(100):
            texts = []
            for _ in range(rng.randint(1, 14)):
                x = rng.choice(texts)[rng.randint(0, 3) :] if texts and rng.random() < 0.4 else [rng.randint(1, rng.choice([1, 2, 5])) for _ in range(rng.randint(1, 20))] + [9]
                texts += [x] if x else []
            t = np.array(sum(texts, []), np.int32)
            _, room = ngram_lm.starts_of([len(x) for x in texts])
            at = np.flatnonzero(t != 9)
            places = at[at < sum(map(len, texts[: len(texts) // 2]))]
            left = np.where(t[at - 1] == 9, -2, t[at - 1]).astype(np.int64)
            shard = Shard.around(t, places, room[places], at, room[at])
            who, length, n = shard.drops(t, at, room[at])
            kept = set(shard.drops(t, at, room[at], left=left)[0].tolist())
            for i, a in enumerate(at.tolist()):
                share = [next((k for k in range(room[a]) if k == room[p] or t[p + k] != t[a + k]), room[a]) for p in places.tolist()]
                for m in range(2, room[a] + 1):
                    assert n[(who == i) & (length >= m)].sum() == sum(s >= m for s in share)
                most = max(share, default=0)
                if most >= 2 and i not in kept:
                    assert any(s == most and t[p - 1] == left[i] for p, s in zip(places.tolist(), share))


def test_a_place_is_looked_up_in_one_shard_only(tmp_path):
    rng = np.random.default_rng(2)
    store = ngram_lm._Store(str(tmp_path))
    for i in range(60):
        store.add(i, i % 5 == 1, np.append(rng.integers(0, 30, 40), 99))
    (unit, _, lengths, n_train, texts), words, _ = store.flush()

    class Vocabulary:
        def ids(self, x):
            return np.searchsorted(words, x)

    ngram_lm.encode_unit(str(tmp_path), unit, np.array(lengths), n_train, texts, Vocabulary(), 7)
    for kind, size in (("asked", 48 + 12 * 40), ("suffixes", 48 * 40)):
        places, cuts = np.fromfile(tmp_path / f"{unit}.{kind}", np.int32), np.fromfile(tmp_path / f"{unit}.{kind}-cuts", np.int64)
        assert len(set(places.tolist())) == len(places) == size and cuts[0] == 0 and cuts[-1] == size and len(cuts) == 8
        assert (np.diff(cuts) > size // 20).all()
