"""Winnowing fingerprints of sequences of units, vectorised over many texts."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import regex

_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def unit_ids(units: list[str], seen: dict[str, int]) -> np.ndarray:
    """CRC-32 of each unit; `seen` remembers those computed before."""
    out = np.empty(len(units), dtype=np.uint64)
    for i, u in enumerate(units):
        if (h := seen.get(u)) is None:
            h = seen[u] = crc32(u.encode())
        out[i] = h
    return out


def unit_characters() -> np.ndarray:
    """For each code point whether it is a letter or a digit (1 MB; made once and sent to the tasks)."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, bool)
    for m in regex.finditer(r"[\p{L}\p{N}]+", every):
        a, b = (x + 0x800 * (x >= 0xD800) for x in (m.start(), m.end() - 1))
        out[a : b + 1] = True
    out[0xD800:0xE000] = False
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def hashed_units(texts: list[str], letters: bool, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every unit of the texts one after another, number of units of each text), in lower case.

    A unit is a longest run of letters and digits, or with `letters` each of them; `used` is unit_characters(). A word's hash is a polynomial of its characters,
    computed for all words at once.
    """
    low = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in low], dtype=np.int64)
    c = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(used[c])
    ends = np.cumsum(sizes)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    chars = c[at].astype(np.uint64) + np.uint64(1)
    first = np.ones(len(at), bool) if letters else np.concatenate([[True], np.diff(at) > 1])
    starts = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(place.max()) + 1, 0x100000001B3, np.uint64))
        h = np.add.reduceat(chars * power[place], starts)
    return _mixed(h), np.bincount(np.searchsorted(ends, at[starts], "right"), minlength=len(texts))


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Rolling 64-bit hash of the k units from each place on (the last k - 1 places have none)."""
    n = len(ids) - k + 1
    h = np.full(max(n, 0), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = (h ^ ids[j : j + n]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def winnow(ids: np.ndarray, sizes: np.ndarray, k: int, window: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in it, gram hash) of the selected k-grams of texts put one after another in `ids`.

    Of every `window` consecutive grams the least one is selected, ordered by (rank, hash); rank is a property of a unit and a
    gram has its least unit's. As the order depends on the gram alone, any `window + k - 1` units two texts share in a row
    give them a common fingerprint. Texts shorter than that select their least gram, ones of under k units none.
    """
    total = len(ids)
    if total < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = gram_hashes(ids, k)
    valid = owner[: total - k + 1] == owner[k - 1 :]
    order = h >> np.uint64(6)
    if rank is not None:
        r = rank[: total - k + 1].copy()
        for j in range(1, k):
            r = np.minimum(r, rank[j : j + len(r)])
        order |= r.astype(np.uint64) << np.uint64(58)
    order[~valid] = _LAST
    padded = np.concatenate([order, np.full(window, _LAST)])
    least = np.lib.stride_tricks.sliding_window_view(padded, window)[: len(order)].argmin(1) + np.arange(len(order))
    # a window counts if it lies in one text, or begins at its text's start
    n = len(order)
    end = np.minimum(np.arange(n) + window - 1, n - 1)
    inside = valid & (owner[:n] == owner[end]) & valid[end] & (np.arange(n) + window - 1 < n)
    first = np.zeros(n, bool)
    s = starts[:-1][(sizes >= k)]
    first[s] = True
    chosen = np.unique(least[inside | (first & valid)])
    chosen = chosen[valid[chosen]]
    return owner[chosen], chosen - starts[owner[chosen]], h[chosen]
