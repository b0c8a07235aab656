"""Suffix arrays by induced sorting, and permuted common prefixes, in whole-array steps.

A suffix is of type S if it is smaller than the next one, else of type L; a leftmost S is one after an L. The
substrings between these are named in order; the string of names, about a third as long, is sorted recursively; and one pass over the character buckets upwards and one downwards induces all other
suffixes, each in time linear in the text. A bucket's own repeats of its character are induced in waves.
"""

from __future__ import annotations

import numpy as np

#: Bytes that UTF-8 doesn't have: between texts, and behind the end of a substring.
SEPARATOR, PAD = 0xFE, 0xFF


def words(t: np.ndarray, more: int = 8) -> np.ndarray:
    """The eight bytes from each place on as one integer, first byte lowest; zeros behind the end."""
    padded = np.concatenate([t, np.zeros(8 + more, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(t) + more, 8), (1, 1)).copy().view("<u8").ravel()


def classify(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is of type S, and the places of the leftmost S."""
    n = len(t)
    step = np.zeros(n, np.int8)
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    step[-1] = -1  # the end is smaller than anything
    at = np.where(step != 0, np.arange(n, dtype=np.int32), n - 1)
    smaller = step[np.minimum.accumulate(at[::-1])[::-1]] > 0
    return smaller, np.flatnonzero(smaller[1:] & ~smaller[:-1]).astype(np.int32) + 1


def renumber(order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Dense names by sorted order; new: whether an entry differs from the one before it in order."""
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new) - 1
    return names


def name_by_keys(length: np.ndarray, key, step: int) -> np.ndarray:
    """Dense names, in order, of strings of these lengths; key(which, skip): their next `step` characters from `skip` on as one integer."""
    k = key(np.arange(len(length)), 0)
    order = np.argsort(k, kind="stable")
    new = np.append(True, k[order][1:] != k[order][:-1])
    skip = step
    while True:
        # Only where equal keys include a longer string is there more to compare.
        group = np.cumsum(new) - 1
        sizes = np.bincount(group)
        longer = np.zeros(len(sizes), bool)
        longer[group[length[order] > skip]] = True
        active = np.flatnonzero((longer & (sizes > 1))[group])
        if not len(active):
            return renumber(order, new)
        part, g = order[active], group[active]
        k = key(part, skip)
        again = np.lexsort((k, g))
        order[active] = part[again]
        g, k = g[again], k[again]
        new[active] |= np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
        skip += step


def substring_lengths(lms: np.ndarray, n: int) -> np.ndarray:
    """From each leftmost S to the next, both included; the last reaches beyond the end, as no other does."""
    return np.append(lms[1:] + 1, n + 1).astype(np.int64) - lms


def name_substrings(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Names of the substrings of bytes from each leftmost S to the next, in their order.

    Where one is the beginning of another it is the larger: its last character is of type S, the other's there of type L.
    """
    length = substring_lengths(lms, len(t))
    text = words(np.concatenate([t, [0]]).astype(np.uint8))
    shift = np.uint64(8)

    def key(which: np.ndarray, skip: int) -> np.ndarray:
        left = np.clip(length[which] - skip, 0, 8).astype(np.uint64)
        k = text[np.minimum(lms[which] + skip, len(text) - 1)].byteswap()  # first byte highest
        fill = np.where(left < 8, ~np.uint64(0) >> np.minimum(left * shift, np.uint64(63)), np.uint64(0))
        fill = np.where(left == 0, ~np.uint64(0), fill)
        return k | fill

    return name_by_keys(length, key, 8)


def name_integers(s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for a string of integers below 2^31 - 2: two at a time."""
    length, beyond = substring_lengths(lms, len(s)), np.int64((1 << 31) - 1)
    text = np.concatenate([s + 1, np.zeros(3, np.int64)])

    def key(which: np.ndarray, skip: int) -> np.ndarray:
        left, at = length[which] - skip, np.minimum(lms[which] + skip, len(s) + 1)
        return np.where(left > 0, text[at], beyond) << 31 | np.where(left > 1, text[at + 1], beyond)

    return name_by_keys(length, key, 2)


def sort_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names, in order: as the names themselves where no two are equal, else by induced sorting again."""
    if names.max() + 1 == len(names):
        return np.argsort(names, kind="stable")
    smaller, lms = classify(names)
    order = lms[sort_names(name_integers(names, lms))] if len(lms) else lms
    return induce_one_by_one(names, smaller, order.tolist())


def induce_one_by_one(s: np.ndarray, smaller: np.ndarray, order: list[int]) -> np.ndarray:
    """The suffix array of a string of names from its leftmost S suffixes in order, one suffix after another: buckets are many and small here."""
    n = len(s)
    ends = np.cumsum(np.bincount(s)).tolist()
    small, s = smaller.tobytes(), s.tolist()
    sa, tail, head = [-1] * n, ends[:], [0, *ends[:-1]]
    for i in reversed(order):
        c = s[i]
        tail[c] -= 1
        sa[tail[c]] = i
    c = s[n - 1]  # the end is smaller than anything, so the last suffix leads its bucket
    sa[head[c]] = n - 1
    head[c] += 1
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = s[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends[:]
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = s[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The order of all suffixes of a non-empty byte array without the bytes SEPARATOR + 1."""
    n = len(t)
    smaller, lms = classify(t)
    sorted_lms = lms[sort_names(name_substrings(t, lms))] if len(lms) else lms
    chars = np.flatnonzero(np.bincount(t, minlength=256))
    starts: dict[int, np.ndarray] = {}
    by_char = t[sorted_lms]
    for c in chars:
        starts[c] = sorted_lms[by_char == c] if len(lms) else lms
    none = np.empty(0, np.int32)

    def induce(order, first: dict[int, list[np.ndarray]], beyond, rest) -> dict[int, np.ndarray]:
        """Bucket by bucket: what was pushed into it, then waves of its own character; both then push their predecessors."""
        done = {}
        for c in order:
            wave = np.concatenate(first[c]) if first[c] else none
            waves = [wave]
            while len(wave):
                before = wave[wave > 0] - 1
                wave = before[t[before] == c]
                waves.append(wave)
            done[c] = np.concatenate(waves)
            source = np.concatenate([done[c], rest(c)])
            before = source[source > 0] - 1
            head = t[before]
            before, head = before[beyond(head, c)], head[beyond(head, c)]
            if len(before):
                by = np.argsort(head, kind="stable")
                before, head = before[by], head[by]
                cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
                for d, piece in zip(head[np.append(0, cuts)], np.split(before, cuts), strict=True):
                    first[d].append(piece)
        return done

    into: dict[int, list[np.ndarray]] = {c: [] for c in chars}
    into[t[-1]].append(np.array([n - 1], np.int32))
    large = induce(chars, into, lambda head, c: head > c, lambda c: starts[c])
    into = {c: [] for c in chars}
    small = induce(chars[::-1], into, lambda head, c: head < c, lambda c: large[c][::-1])
    return np.concatenate([x for c in chars for x in (large[c], small[c][::-1])])


def permuted_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each place, the length of the common prefix of its suffix and the one before it in order (0 for the first).

    (Kaerkkaeinen, Manzini, Puglisi, Permuted Longest-Common-Prefix Array, 2009.) Where the characters before the two suffixes are equal the
    value is one less than the place before has; only the others, whose lengths add up to O(n log n), are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    own = (place == 0) | (before <= 0)
    own[1:] |= t[:-1] != t[np.maximum(before[1:], 1) - 1]
    own[1:] |= before[:-1] < 0
    heads = np.flatnonzero(own)
    value = np.zeros(len(heads), np.int64)
    w = words(t, 16)
    active = np.flatnonzero(before[heads] >= 0)
    while len(active):
        i, j, off = heads[active], before[heads[active]], value[active]
        differ = w[np.minimum(i + off, n)] ^ w[np.minimum(j + off, n)]
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
        room = n - np.maximum(i, j) - off
        value[active] += np.minimum(equal, room)
        active = active[(equal == 8) & (room > 8)]
    owner = np.maximum.accumulate(np.where(own, place, 0))
    of = np.searchsorted(heads, owner)
    return np.maximum(0, value[of] - (place - owner))
