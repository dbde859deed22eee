"""A held-out copy of a text with many training copies: its places inside the copy aren't counted against all of them."""

import numpy as np

from trawlspark.llm import suffix


def test_places_inside_a_copy_are_left_out_before_copies_are_counted(monkeypatch):
    rng = np.random.default_rng(5)
    body, copies = np.append(rng.integers(1, 40, 60), 0), 200
    others = [np.append(rng.integers(1, 40, 30), 0) for _ in range(50)]
    texts = [body] * copies + others + [np.concatenate([[41], body])]
    t = np.concatenate([*texts, [0]]).astype(np.int32)
    ends = np.cumsum([len(x) for x in texts])
    n_train = int(ends[-2])
    room = lambda x: ends[np.searchsorted(ends, x, side="right")] - x
    places = np.setdiff1d(np.arange(n_train), ends[:-1] - 1)
    at = np.arange(n_train, int(ends[-1]) - 1)
    shard = suffix.Shard.around(t, places, room(places), at, room(at))
    work, plain = [], suffix.least_so_far
    monkeypatch.setattr(suffix, "least_so_far", lambda x, new: work.append(len(x)) or plain(x, new))
    found = shard.drops(t, at, room(at), left=t[at - 1].astype(np.int64))
    assert sum(work) < 3 * copies
    # the place where the copy begins has all of it, as often as it was learnt; those behind it are left out
    who, length, n = found
    own = length > 3
    assert set(zip(who[own].tolist(), length[own].tolist(), n[own].tolist())) == {(1, len(body), copies)}
