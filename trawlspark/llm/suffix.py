"""A suffix array over 64-bit tokens in NumPy, and how often each prefix of a query occurs in it."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Prefixes of 2, 3 and 4 tokens are looked up in tables of their hashes; longer ones by binary search.
TABLES = (2, 3, 4)
_CELLS = 1 << 21
#: Up to so many suffixes are compared with a query one by one; after some rounds of narrowing (a run
#: of one word loses few suffixes at each length) up to more.
_FEW, _ROUNDS, _MANY = 256, 16, 1 << 16
#: So many tokens are split one by one before suffixes are compared with each other.
_TOKENS = 8


def gram_keys(t: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n tokens from each place, all of which must be there."""
    out = np.empty(len(at), np.uint64)
    for s in range(0, len(at), 1 << 18):  # in parts, for the memory
        part = at[s : s + (1 << 18)].astype(np.int64)
        k = t[part].astype(np.int64).view(np.uint64)
        for i in range(1, n):
            k = k * _MIX + t[part + i].astype(np.int64).view(np.uint64)
        out[s : s + (1 << 18)] = k ^ (k >> np.uint64(29))
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Places of t (INT32) ordered by what follows; prefix doubling over the groups that are still tied."""
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    by = np.argsort(t).astype(np.int32)
    sorted_ = t[by]
    key = np.empty(n, np.int64)
    key[by] = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]]))
    del by, sorted_
    key <<= 32
    key[:-1] |= (key[1:] >> 32) + 1
    sa = np.argsort(key).astype(np.int32)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    del key
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), np.int32(0)))
    h = 2
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    del new
    while len(tied):
        sub = sa[tied].astype(np.int64)
        far = sub + h
        key = np.where(far < n, rank[np.minimum(far, n - 1)].astype(np.int64) + 1, 0) | rank[sub].astype(np.int64) << 32
        order = np.argsort(key, kind="stable")
        sub, key = sub[order], key[order]
        sa[tied] = sub
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[sub] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


def groups(new: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first member, members, learnt ones among them) of each group of a row; new: where one begins."""
    start = np.flatnonzero(new)
    if not len(start):
        return start, start, start
    return start, np.diff(np.append(start, len(new))), np.add.reduceat(learnt, start, dtype=np.int64)


def begins(key: np.ndarray) -> np.ndarray:
    """Where a sorted key differs from the one before."""
    return np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1])


def ordered(t: np.ndarray, places: np.ndarray, room: np.ndarray, learnt: np.ndarray, new: np.ndarray, known: int) -> tuple[np.ndarray, np.ndarray]:
    """(which of some places of t is the next by the room tokens from each, what it has in common with the one before).

    At the end of the room tokens, and only there, is one certain token. new: where a group begins; the places of a group
    have known tokens in common. Each group is ordered for itself, and only where learnt places and others are together:
    of those that are left together the others have the same in common with each, whatever their order.
    """
    order, near = np.arange(len(places)), np.where(new, 0, known)
    tied, of, known = order.copy(), np.cumsum(new), np.full(len(places), known)
    while len(tied):
        e = order[tied]
        own = learnt[e]
        start, size, some = groups(begins(of), own)
        # all are compared with one of the rarer kind: if it is the only one, its group is done
        rare = own == np.repeat(2 * some <= size, size)
        upto = np.cumsum(rare)
        at = np.searchsorted(upto, upto[start] - rare[start] + np.minimum(some, size - some) // 2 + 1)
        at = np.repeat(at, size)
        p, v, most = places[e], places[e[at]], np.minimum(room[e], room[e[at]])
        itself = p == v
        length = np.where(itself, most, common(t, v, t, p, np.where(itself, known, most), known))
        same, end = length >= most, np.minimum(length, most - 1)
        key = np.where(same, 1 << 31, np.where(t[p + end] < t[v + end], length, (1 << 32) - length))
        key |= np.repeat(np.arange(len(start)), size) << 33
        by = np.argsort(key)
        order[tied], key, same, length, own = e[by], key[by], same[by], length[by], own[by]
        within = np.ones(len(tied), bool)
        within[start] = False
        near[tied[within]] = np.minimum(length[1:], length[:-1])[within[1:]]
        new = begins(key)
        _, size, some = groups(new, own)
        more = np.repeat((some > 0) & (some < size), size) & ~same
        tied, of, known = tied[more], np.cumsum(new)[more], length[more]
    return order, near


def least_so_far(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The running minimum of numbers from 0 to 2^32 - 1, begun anew where new."""
    of = np.cumsum(new) << 32
    return np.minimum.accumulate(x - of) + of


class Below:
    """Finds the first of some numbers, the last of which is 0, that is below a bound."""

    def __init__(self, x: np.ndarray):
        x = x.astype(np.int32)
        self.least = [x]  # of 1, 2, 4... numbers
        while len(x) > 1:
            x = np.append(x, 0) if len(x) & 1 else x
            x = np.minimum(x[::2], x[1::2])
            self.least.append(x)

    def first(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """From each place at on, the first below a bound above 0."""
        at = at.copy()
        i = np.flatnonzero(self.least[0][at] >= bound)
        j, b, k, levels = at[i], bound[i], 0, []
        # up, past whole blocks, till one has it
        while len(i):
            odd = (j >> k) & 1 == 1
            here = self.least[k][j >> k] < b
            levels.append((i[here], j[here], b[here]))
            i, j, b = i[~here], (j + (odd << k))[~here], b[~here]
            k += 1
        # and down in it
        i, j, b = (np.zeros(0, np.int64) for _ in range(3))
        for k in range(len(levels) - 1, -1, -1):
            i, j, b = (np.concatenate(x) for x in zip((i, j, b), levels[k]))
            if k:
                j = j + ((self.least[k - 1][j >> (k - 1)] >= b).astype(np.int64) << (k - 1))
        at[i] = j
        return at


def common(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray, known: np.ndarray | int = 0) -> np.ndarray:
    """Length of the common prefix of a from each i and b from each j, most at the most; known tokens are known to agree.

    Pairs that run along one diagonal share their end, so only the last of such a run is compared.
    """
    if len(i) == 0:
        return np.zeros(0, np.int64)
    most = np.minimum(most, np.minimum(len(a) - i, len(b) - j))
    order = np.lexsort((j, i - j))
    i, j, most = i[order], j[order], most[order]
    run = np.append((np.diff(i) == 1) & (np.diff(j) == 1) & (a[i[:-1]] == b[j[:-1]]), False)
    last = np.flatnonzero(~run)
    known = np.minimum(np.broadcast_to(known, len(order))[order], most)
    length = known[last].astype(np.int64)
    open_, chunk = np.flatnonzero(length < most[last]), 8
    while len(open_):
        still = []
        for s in range(0, len(open_), max(1, _CELLS // chunk)):
            o = open_[s : s + max(1, _CELLS // chunk)]
            k = last[o]
            step = np.arange(chunk)
            x, y = i[k] + length[o], j[k] + length[o]
            left = np.minimum(len(a) - x, len(b) - y)
            same = a[np.minimum(x[:, None] + step, len(a) - 1)] == b[np.minimum(y[:, None] + step, len(b) - 1)]
            same &= step < left[:, None]
            whole = same.all(1)
            length[o] += np.where(whole, chunk, np.argmin(same, 1))
            still.append(o[whole & (length[o] < most[k])])  # most never reaches beyond either end
        open_ = np.concatenate(still)
        chunk *= 4 if chunk < 128 else 2
        if chunk > 1024:
            break
    # few pairs share more: these are compared slice by slice
    for o in open_.tolist():
        k = last[o]
        x, y, n, size = int(i[k]), int(j[k]), int(length[o]), 256
        stop = int(most[k])
        while n < stop:
            end = min(n + size, stop)
            differ = a[x + n : x + end] != b[y + n : y + end]
            at = int(differ.argmax())
            if differ[at]:
                n += at
                break
            n += len(differ)
            size *= 2
        length[o] = n
    # the end of each run, carried back to its members
    ends = np.searchsorted(last, np.arange(len(i)))
    out = np.minimum(length[ends] + (last[ends] - np.arange(len(i))), most)
    back = np.empty_like(out)
    back[order] = out
    return back


class Shard:
    """The suffix array of some training tokens; sa: that of some of their places only."""

    def __init__(self, tokens: np.ndarray, sa: np.ndarray | None = None):
        self.t = tokens
        self.sa = suffix_array(tokens) if sa is None else sa
        self.lcp: np.ndarray | None = None
        self._tables: dict[int, tuple] = {}

    @classmethod
    def around(cls, t: np.ndarray, places: np.ndarray, room: np.ndarray, at: np.ndarray, left_in: np.ndarray) -> Shard:
        """The suffixes at some places, see ordered(), of two tokens or more, for drops() of the places at, of which so much is left."""
        shard = cls(t, places)
        shard.room, shard.lcp = room, np.zeros(0, np.int64)
        return shard

    def longest(self, at: np.ndarray, room: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the longest match from each place, 0 where none of two tokens; whether a suffix that shares it is behind left), in an around() shard."""
        most, seen = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        self._together(at, room, left, seen, most)
        return most, seen

    def _together(self, at: np.ndarray, room: np.ndarray, left: np.ndarray | None, seen: np.ndarray, most: np.ndarray | None = None) -> list[tuple]:
        """drops() of an around() shard: suffixes and what is asked are split token by token, together.

        A group goes on only while it has both; most suffixes are near nothing that is asked and leave at once. What is asked
        leaves, too, where all suffixes of its group are behind its own left token: so is then the longest match. Those
        that stay for _TOKENS tokens (copies) are ordered, for _climb(). With most only longest() is found.
        """
        t, n, out = self.t, len(self.sa), []
        where, space = np.concatenate([self.sa, at]), np.concatenate([self.room, room]).astype(np.int64)
        behind = None if left is None else np.concatenate([t[self.sa - 1].astype(np.int64), left])
        key = (t[where].astype(np.int64) + 2) << 32 | (t[where + 1].astype(np.int64) + 2)
        count, of, e, d = None, None, np.arange(len(where)), 2
        while True:
            by = np.argsort(key)
            key, e = key[by], e[by]
            new, own = begins(key), e < n
            start, size, some = groups(new, own)
            if count is not None:
                # those that have a token less in common
                of = of[by]
                less = count[of] - np.repeat(some, size)
                last = np.flatnonzero(~own & np.repeat(some == 0, size))
                self._seen(e, of, last, own, behind, seen)
                if most is None:
                    leave = np.flatnonzero(~own & (less > 0))
                    out.append((e[leave] - n, np.full(len(leave), d - 1), less[leave]))
                else:
                    most[e[last] - n] = d - 1
            both = np.repeat((some > 0) & (some < size), size)
            e, own, of, count = e[both], own[both], np.cumsum(new)[both], some[(some > 0) & (some < size)]
            of = np.cumsum(begins(of)) - 1
            # texts that end here
            ends = space[e] == d
            last = np.flatnonzero(ends & ~own)
            self._seen(e, of, last, own, behind, seen)
            if most is None:
                out.append((e[last] - n, np.full(len(last), d), count[of[last]]))
            else:
                most[e[last] - n] = d
            stay = ~ends
            if behind is not None and most is None and len(e):
                x = behind[e]
                low, high = (f.reduceat(np.where(own, x, none), np.flatnonzero(begins(of)))[of] for f, none in ((np.minimum, 1 << 40), (np.maximum, -(1 << 40))))
                plain = stay & ~own & (low == x) & (high == x)
                seen[e[plain] - n] = True
                stay &= ~plain
                asked = np.zeros(len(count), bool)
                asked[of[stay & ~own]] = True
                stay &= asked[of]
            e, of = e[stay], of[stay]
            if not len(e):
                return out
            if d >= _TOKENS:
                break
            key = (of << 32) | (t[where[e] + d].astype(np.int64) + 2)
            d += 1
        by, near = ordered(t, where[e], space[e], e < n, begins(of), d)
        e = e[by]
        own = e < n
        rows, asked = np.flatnonzero(own), np.flatnonzero(~own)
        which = e[asked] - n
        rest = Shard(t, self.sa[e[rows]])
        rest.lcp = np.minimum.reduceat(near, np.append(0, rows[:-1] + 1))
        rest.lcp[-1] = near[(rows[-2] + 1 if len(rows) > 1 else 0) : rows[-1] + 1].min()  # the last segment has what follows too
        rest.spot = np.cumsum(own)[asked]
        rest.back = least_so_far(near[asked], np.append(True, own)[asked])
        rest.on = least_so_far(np.append(near, 0)[asked + 1][::-1], np.append(own, True)[asked + 1][::-1])[::-1]
        past, top = np.zeros(len(which), bool), None if most is None else np.zeros(len(which), np.int64)
        found = rest._climb(None if left is None else left[which], past, top)
        seen[which[past]] = True
        if most is not None:
            most[which] = top
        return out + [(which[i], length, n) for i, length, n in found]

    def _seen(self, e, of, who, own, behind, seen) -> None:
        """Set seen for those of e that have a suffix behind their own left token in their group."""
        if behind is None or not len(who):
            return
        some = np.zeros(int(of.max()) + 1, bool)
        some[of[who]] = True
        have = np.flatnonzero(own & some[of])
        keys = np.sort(of[have] << 32 | behind[e[have]] + 2)
        want = of[who] << 32 | behind[e[who]] + 2
        if len(keys):
            hit = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
            seen[e[who[hit]] - len(self.sa)] = True

    def table(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted keys of all n-grams, their first and end places in the suffix array)."""
        known = self._tables.get(n)
        if known is None:
            place = np.flatnonzero(self.sa <= len(self.t) - n).astype(np.int32)
            k = gram_keys(self.t, self.sa[place], n)
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])).astype(np.int32) if len(k) else np.zeros(0, np.int32)
            end = np.append(first[1:], len(k)) if len(k) else first
            k = k[first]
            order = np.argsort(k).astype(np.int32)
            # a suffix too short for the n-gram sorts before those with it, never among them
            known = k[order], place[first[order]], place[end[order] - 1] + 1
            self._tables[n] = known
        return known

    def find(self, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and end in the suffix array of each key's n-gram; equal where it doesn't occur. Sorted keys are fast."""
        own, first, end = self.table(n)
        if not len(own):
            z = np.zeros(len(keys), np.int64)
            return z, z
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        hit = own[at] == keys
        return np.where(hit, first[at], 0).astype(np.int64), np.where(hit, end[at], 0).astype(np.int64)

    def drops(self, q: np.ndarray, at: np.ndarray, room: np.ndarray, order: np.ndarray | None = None, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in at, length, n): n suffixes share exactly the first `length` tokens, two or more, with q from at.

        room: how many tokens of q count from there. So a prefix of m tokens occurs as often as the n
        of all lengths from m on add up to. order: at, which are all the places of some texts, by their
        first two tokens' keys; then what _advancing() says can't matter is left out. left: the token
        before each place, none of the shard's at the head of a text; then places whose longest match
        is seen behind that token too are left out: the match from the place before reaches as far.
        """
        if self.lcp is not None:
            seen = np.zeros(len(at), bool)
            out = [tuple(c[~seen[x[0]]] for c in x) for x in self._together(at, room, left, seen)]
            return tuple(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in zip(*out))
        who = np.flatnonzero(room >= 2) if order is None else order
        out: list[tuple] = []
        lo = hi = np.zeros(0, np.int64)
        count = None
        for n in TABLES:
            if n > 2:
                deep = room[who] >= n
                if (~deep).any():
                    out.append((who[~deep], np.full((~deep).sum(), n - 1), count[~deep]))
                who, count = who[deep], count[deep]
            keys = gram_keys(q, at[who], n)
            if n > 2 or order is None:
                by = np.argsort(keys)
                who, keys = who[by], keys[by]
                count = count[by] if count is not None else None
            lo, hi = self.find(keys, n)
            if count is not None:
                less = count - (hi - lo)
                some = less > 0
                out.append((who[some], np.full(some.sum(), n - 1), less[some]))
            keep = hi > lo
            who, lo, hi = who[keep], lo[keep], hi[keep]
            count = hi - lo
        if order is not None and len(who):
            by = np.argsort(at[who])
            who, lo, hi = who[by], lo[by], hi[by]
            keep, least = self._advancing(q, at[who], room[who], lo, hi)
            who, lo, hi = who[keep], lo[keep], hi[keep]
        else:
            least = np.zeros(len(who), np.int64)
        for i, length, n in self._spread(q, at[who], room[who], lo, hi, least):
            use = length > least[i]
            out.append((who[i[use]], length[use], n[use]))
        if not out:
            z = np.zeros(0, np.int64)
            return z, z, z
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out))

    def _place(self, x) -> np.ndarray:
        return self.sa[x].astype(np.int64)

    def _longest(self, q, at, room, lo, hi) -> np.ndarray:
        """The longest match of q from each place among the suffixes lo to hi: binary search for where q belongs, whose neighbours are the nearest."""
        longest, lo, hi = np.zeros(len(at), np.int64), lo.copy(), hi.copy()
        i = np.arange(len(at))
        while len(i):
            mid = (lo[i] + hi[i]) >> 1
            p = self._place(mid)
            length = common(self.t, p, q, at[i], room[i], TABLES[-1])
            longest[i] = np.maximum(longest[i], length)
            whole = length >= room[i]
            less = self._less(p + length, q, at[i], np.minimum(length, room[i] - 1))
            lo[i] = np.where(less, mid + 1, lo[i])
            hi[i] = np.where(less, hi[i], mid)
            i = i[~whole & (lo[i] < hi[i])]
        return longest

    def _less(self, p, q, at, length) -> np.ndarray:
        """Whether the token at p, nothing at the end, sorts before q's behind `length` tokens."""
        n = len(self.t)
        return (p >= n) | (self.t[np.minimum(p, n - 1)] < q[at + length])

    def _prefix(self, q, at, m, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """The part of the suffixes lo to hi that shares q's first m tokens from each place."""
        ends = []
        for above in (False, True):
            a, b = lo.copy() if not above else ends[0].copy(), hi.copy()
            i = np.flatnonzero(a < b)
            while len(i):
                mid = (a[i] + b[i]) >> 1
                p = self._place(mid)
                length = common(self.t, p, q, at[i], m[i], TABLES[-1])
                same = length >= m[i]
                less = (same & above) | (~same & self._less(p + length, q, at[i], np.minimum(length, m[i] - 1)))
                a[i] = np.where(less, mid + 1, a[i])
                b[i] = np.where(less, b[i], mid)
                i = i[a[i] < b[i]]
            ends.append(a)
        return ends[0], ends[1]

    def _spread(self, q, at, room, lo, hi, least) -> list[tuple]:
        """[(i, length, n)]: n of the suffixes lo to hi share just so many tokens with q from place i; lengths up to least may lack."""
        out, i = [], np.arange(len(at))
        deep = np.flatnonzero(least > TABLES[-1])
        lo, hi = lo.copy(), hi.copy()
        lo[deep], hi[deep] = self._prefix(q, at[deep], least[deep] + 1, lo[deep], hi[deep])
        rounds, known = 0, np.where(least > TABLES[-1], least + 1, TABLES[-1])
        while len(i):
            # all of a range share some prefix; what leaves q there is counted, the rest goes on
            first = common(self.t, self._place(lo), q, at[i], room[i], known)
            shared, many = first.copy(), hi - lo > 1
            shared[many] = common(self.t, self._place(lo[many]), self.t, self._place(hi[many] - 1), room[i[many]], known[many])
            done = ~many | (first < shared) | (shared >= room[i])
            out.append((i[done], first[done], (hi - lo)[done]))
            i, lo, hi, d = i[~done], lo[~done], hi[~done], shared[~done]
            rounds += 1
            size = hi - lo
            small = size <= (_FEW if rounds < _ROUNDS else _MANY)
            few = np.flatnonzero(small)
            part = np.cumsum(size[few]) // _MANY
            for f in np.split(few, np.flatnonzero(np.diff(part)) + 1) if len(few) else []:
                n = size[f]
                who = np.repeat(i[f], n)
                j = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[f], n)
                length = common(self.t, self._place(j), q, at[who], room[who], np.repeat(d[f], n))
                key, count = np.unique(who << 32 | length, return_counts=True)
                out.append((key >> 32, key & 0xFFFFFFFF, count))
            i, lo, hi, d = i[~small], lo[~small], hi[~small], d[~small]
            want = q[at[i] + d]
            start = self._bound(lo, hi, d, want, False)
            end = self._bound(start, hi, d, want, True)
            less = (hi - lo) - (end - start)
            out.append((i[less > 0], d[less > 0], less[less > 0]))
            keep = end > start
            i, lo, hi, known = i[keep], start[keep], end[keep], d[keep] + 1
        return out

    def _climb(self, left: np.ndarray | None, seen: np.ndarray, top: np.ndarray | None = None) -> list[tuple]:
        """[(i, length, n)] as _spread(): from a place's spot on, either way, what it shares with a suffix is the least of what neighbours share.

        lcp: what each suffix has in common with the one before; spot: how many suffixes lie before each place; back and on: what
        it has in common with the last of these and with the next one. A step takes in all suffixes that share as much as the next
        one on either side, so there are as many steps as lengths. Where left is given, seen is set if a suffix that shares most is behind left.
        Where top is given, it gets the longest lengths, and that is all.
        """
        out, n, i = [], len(self.sa), np.arange(len(self.spot))
        lo, hi, back, on = self.spot.copy(), self.spot.copy(), self.back.copy(), self.on.copy()
        lcp = np.append(self.lcp, 0)
        before, after = Below(self.lcp[::-1]), Below(lcp)
        if left is not None:
            behind = np.sort(self.t[self.sa - 1].astype(np.int64) << 32 | np.arange(n))
        while True:
            more = np.maximum(back, on) > 0
            i, lo, hi, back, on = (x[more] for x in (i, lo, hi, back, on))
            if not len(i):
                return out
            most, size = np.maximum(back, on), hi - lo
            w = np.flatnonzero(back == most)
            lo[w] = n - 1 - before.first(n - lo[w], most[w])
            back[w] = lcp[lo[w]]
            w = np.flatnonzero(on == most)
            hi[w] = after.first(hi[w] + 1, most[w])
            on[w] = lcp[hi[w]]
            if left is not None and not out:
                at = np.searchsorted(behind, left[i] << 32 | lo)
                hit = (at < n) & (behind[np.minimum(at, n - 1)] < (left[i] << 32 | hi))
                seen[i[hit]] = True
                if top is not None:
                    top[i] = most
                    return out
                i, lo, hi, back, on, most, size = (x[~hit] for x in (i, lo, hi, back, on, most, size))
            out.append((i, most, hi - lo - size))

    def _advancing(self, q, at, room, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """(which, least): the places whose longest match ends behind that of the place before, and how long a match ending there is.

        Ends of longest matches never go back from one place to the next, so where both ends of a run
        of places have the same, those between have it too: only where they differ is a run halved.
        A token's longest context starts at an advancing place, and no shorter match from there counts.
        """
        n = len(at)
        head = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(room) != -1)])
        first = np.flatnonzero(head)
        last = np.append(first[1:], n) - 1
        end = np.full(n, -1, np.int64)

        def know(i) -> None:
            i = np.unique(i)
            i = i[end[i] < 0]
            end[i] = at[i] + self._longest(q, at[i], room[i], lo[i], hi[i])

        know(np.concatenate([first, last]))
        while len(first):
            wide = (last - first > 1) & (end[first] != end[last])
            first, last = first[wide], last[wide]
            mid = (first + last) >> 1
            know(mid)
            first, last = np.concatenate([first, mid]), np.concatenate([mid, last])
        end = np.maximum.accumulate(end)
        before = np.concatenate([[0], end[:-1]])
        which = np.flatnonzero(head | (end > before))
        return which, np.where(head, 0, before - at)[which]

    def _bound(self, lo, hi, d, want, above: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        n = len(self.t)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            p = self._place(mid) + d[open_]
            have = self.t[np.minimum(p, n - 1)]
            less = (p >= n) | ((have <= want[open_]) if above else (have < want[open_]))
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
