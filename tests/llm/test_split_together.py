"""A shard's suffixes are split only as far as something that is asked is beside them, and copies aren't counted one by one."""

import numpy as np

from trawlspark.llm import ngram_lm, suffix


def test_suffixes_near_nothing_that_is_asked_are_not_compared(monkeypatch):
    rng = np.random.default_rng(7)
    twins = [np.append(rng.integers(1, 4000, 80), 0) for _ in range(40)]
    texts = [*twins, *twins, np.append(rng.integers(1, 4000, 60), 0)]
    asked = [np.concatenate([[4001], twins[0][:30], [4002, 0]]), np.concatenate([[4003], twins[1][5:]])]
    t = np.concatenate([*texts, *asked, [0]]).astype(np.int32)
    ends = np.cumsum([len(x) for x in [*texts, *asked]])
    n_train = int(ends[-3])
    room = lambda x: ends[np.searchsorted(ends, x, side="right")] - x
    places = np.setdiff1d(np.arange(n_train), ends[:-2] - 1)
    at = np.setdiff1d(np.arange(n_train, int(ends[-1])), ends[-2:] - 1)
    pairs, plain = [], suffix.common
    monkeypatch.setattr(suffix, "common", lambda a, i, *x: pairs.append(len(i)) or plain(a, i, *x))
    shard = suffix.Shard.around(t, places, room(places), at, room(at))
    who, length, n = shard.drops(t, at, room(at))
    # each place of the copies is beside two suffixes, of 6499 in the shard; before, all were compared with the next
    assert len(places) > 6000 and sum(pairs) < 500
    for i, a in enumerate(at.tolist()):
        share = [next((k for k in range(room(a)) if k == room(p) or t[p + k] != t[a + k]), room(a)) for p in places[t[places] == t[a]].tolist()]
        for m in range(2, room(a) + 1):
            assert n[(who == i) & (length >= m)].sum() == sum(s >= m for s in share)
    # with the tokens to their left known, only the first places of the copies are compared and kept
    pairs.clear()
    shard = suffix.Shard.around(t, places, room(places), at, room(at))
    who, length, n = shard.drops(t, at, room(at), left=t[at - 1].astype(np.int64))
    own = length > 3
    assert sum(pairs) < 10
    assert sorted(zip(at[who[own]].tolist(), length[own].tolist(), n[own].tolist())) == [(n_train + 1, 30, 2), (int(ends[-2]) + 1, 76, 2)]


def test_copies_asked_for_are_not_counted_against_each_copy(monkeypatch):
    rng = np.random.default_rng(9)
    body = rng.integers(1, 40, 30)
    made = lambda k, first: [np.concatenate([[first + i], body[: rng.integers(12, 31)], rng.integers(50, 60, 3), [0]]) for i in range(k)]
    texts, asked = made(150, 100), made(120, 1000)
    t = np.concatenate([*texts, *asked, [0]]).astype(np.int32)
    ends = np.cumsum([len(x) for x in [*texts, *asked]])
    n_train = int(ends[149])
    room = lambda x: ends[np.searchsorted(ends, x, side="right")] - x
    places = np.setdiff1d(np.arange(n_train), ends[:150] - 1)
    at = ends[149:-1] + 1  # the bodies' first places
    work, plain = [], suffix.least_so_far
    monkeypatch.setattr(suffix, "least_so_far", lambda x, new: work.append(len(x)) or plain(x, new))
    shard = suffix.Shard.around(t, places, room(places), at, room(at))
    who, length, n = shard.drops(t, at, room(at), left=t[at - 1].astype(np.int64))
    assert sum(work) < 3 * len(at)  # not 150 * 120
    for i, a in enumerate(at.tolist()):
        share = [next(k for k in range(room(a) + 1) if k == room(a) or t[p + k] != t[a + k]) for p in (np.append(0, ends[:149]) + 1).tolist()]
        for m in range(2, room(a) + 1):
            assert n[(who == i) & (length >= m)].sum() == sum(s >= m for s in share)


def test_the_first_number_below_a_bound():
    rng = np.random.default_rng(4)
    for size in (1, 2, 3, 7, 8, 9, 50):
        x = np.append(rng.integers(0, 9, size - 1), 0)
        at, bound = (y.ravel() for y in np.meshgrid(np.arange(size), np.arange(1, 10)))
        want = [next(j for j in range(a, size) if x[j] < b) for a, b in zip(at.tolist(), bound.tolist())]
        assert suffix.Below(x).first(at, bound).tolist() == want


def test_a_unit_is_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 60, 90)
    size, texts = int(lengths.sum()), 50
    t = rng.integers(0, 9, size).astype(np.int32)
    at, room = ngram_lm.starts_of(lengths)
    key = np.unique(np.concatenate([at[room >= m] << 32 | m for m in (2, 3, 5, 8)]))
    key = np.sort(rng.choice(key, len(key) // 3, replace=False))
    drops = ngram_lm.Drops([np.stack([key >> 32, key & 0xFFFFFFFF, rng.integers(1, 5, len(key))])])

    class Vocabulary:
        total, distinct = 900, 9

        def count(self, ids):
            return 10 * ids

    whole = ngram_lm.score_texts(t, lengths, texts, drops, 10 * t.astype(np.int64), 900, 9)
    monkeypatch.setattr(ngram_lm, "PIECE_TOKENS", 100)
    assert max(lengths[i:j].sum() for i, j in ngram_lm.pieces(lengths)) < 160
    for x, y in zip(whole, ngram_lm.score_unit(t, lengths, texts, drops, Vocabulary())):
        assert np.allclose(x, y, rtol=1e-12, atol=0)


def test_parts_of_a_shard_leave_out_what_the_whole_does(monkeypatch):
    rng = np.random.default_rng(6)
    runs = [np.append(np.full(k, 1), 0) for k in (*range(20, 60), 90)]
    texts = [*runs, *(np.append(rng.integers(1, 4, 30), 0) for _ in range(20))]
    asked = [np.concatenate([[2], np.full(80, 1), [3, 0]]), texts[45][3:], np.append(rng.integers(1, 4, 30), 0)]
    t = np.concatenate([*texts, *asked, [0]]).astype(np.int32)
    ends = np.cumsum([len(x) for x in [*texts, *asked]])
    n_train = int(ends[len(texts) - 1])
    room = lambda x: ends[np.searchsorted(ends, x, side="right")] - x
    places = np.setdiff1d(np.arange(n_train), ends - 1)
    at = np.setdiff1d(np.arange(n_train, int(ends[-1])), ends - 1)
    left = t[at - 1].astype(np.int64)
    left[left == 0] = -2
    rows = lambda: sorted(zip(*ngram_lm.Drops([np.stack(ngram_lm.drops_of(t, places, room(places), at, room(at), left))]).packed().tolist()))
    whole = rows()
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", len(places) // 7)
    assert rows() == whole
    # the places within the run of 80 are left out; before, parts kept them all, each with all its lengths
    assert len(whole) < 500
