"""A probabilistic suffix tree over the bytes of texts, worked out in pieces.

A text is the stream of its lower-cased words, each followed by a space, and a
line feed at its end.  The context of a byte is what precedes it, at most
``DEPTH`` bytes and not beyond the text's start, where a space stands.  A run is a
context with its byte.

Contexts of up to ``ROOTS`` bytes are always states (at most 256 + 1 of them).  A longer one becomes a state
if it occurred ``least`` times and its next-byte distribution diverges from that of
its longest proper suffix, or if it is a suffix of a state.  So the tree grows
with the texts, and no part of it is bounded by a share of them.  Each distribution is
smoothed with that of the next shorter state, down to the uniform one, so the
probabilities of all texts sum to at most one; a byte is scored by the longest state that its context ends in.

All that a run's probability depends on are runs whose contexts end in the same ``ROOTS`` + 1 bytes,
and the counts of the roots: a tree of any size is worked out :func:`leaf by leaf <probabilities>`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np

DEPTH, ROOTS = 5, 1
SPACE, END = 0x20, 0x0A
_TAG = np.int64(56)
#: Mask of the lowest k bytes.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(DEPTH + 2)], dtype=np.int64)
WINDOW = 1 << 20


def stream(words: list[bytes]) -> bytes:
    """The bytes to predict, after a space that is given."""
    return b" ".join([*words, b"\n"])


def runs(streams: list[bytes]) -> Iterator[np.ndarray]:
    """The run of each byte of the streams in order, tagged with its length; a window at a time, however long a text is."""
    whole = np.frombuffer(b"\n " + b" ".join(streams), np.uint8)
    for start in range(1, len(whole), WINDOW):
        first = max(0, start - DEPTH - 1)
        a = whole[first : start + WINDOW].astype(np.int64)
        at = np.arange(len(a))
        last_end = np.maximum.accumulate(np.where(a == END, at, -DEPTH - 1))
        depth = np.zeros(len(a), np.int64)
        depth[1:] = np.minimum(at[:-1] - last_end[:-1], DEPTH)
        code = a.copy()
        for k in range(1, DEPTH + 1):
            code[k:] |= a[:-k] << np.int64(8 * k)
        own = slice(start - first, None)
        yield ((depth + 1) << _TAG | code & _LOW[depth + 1])[own][depth[own] > 0]


def counted(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    return code[first], np.add.reduceat(n, first) if len(first) else n[:0]


def count_runs(parts: Iterable[tuple[list[bytes], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of streams and how often they occur, from lists of streams and how often each list counts (0 or 1)."""
    codes, counts, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for streams, times in parts:
        for window in runs(streams) if streams else ():
            run = np.sort(window)
            first = np.flatnonzero(np.diff(run, prepend=-1))
            codes.append(run[first])
            counts.append(times * np.diff(np.append(first, len(run))))
            waiting += len(first)
            if waiting > 2 * len(codes[0]) + WINDOW:
                codes, counts = ([x] for x in counted(codes, counts))
                waiting = 0
    return counted(codes, counts)


def depth_of(run: np.ndarray) -> np.ndarray:
    return (run >> _TAG) - 1


def ending(run: np.ndarray) -> np.ndarray:
    """The last ``ROOTS`` + 1 bytes of the runs' contexts; runs of one leaf are worked out together."""
    return (run >> np.int64(8)) & _LOW[ROOTS + 1]


def roots(run: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The longest roots, from the counts of all runs' last ``ROOTS`` + 1 bytes (distinct, without tags)."""
    codes, counts = zip(*(counted([run & _LOW[d + 1]], [n.astype(float)]) for d in range(ROOTS + 1)), strict=True)
    return _levels(codes, counts, None, 0)[-1]


def _levels(codes: Sequence[np.ndarray], counts: Sequence[np.ndarray], below: dict[str, np.ndarray] | None, first: int, least: int = 0, min_gain: float = 0.0) -> list[dict[str, np.ndarray]]:
    """For contexts of ``first`` bytes and on: runs in order with count, their context's total, and probability.

    ``below``: the level of contexts one byte shorter; without one, all contexts are states.
    """
    out: list[dict[str, np.ndarray]] = []
    shorter = below
    for d, (code, n) in enumerate(zip(codes, counts, strict=True), first):
        contexts, owner = np.unique(code >> np.int64(8), return_inverse=True)
        total, kinds = np.bincount(owner, n, len(contexts)), np.bincount(owner, n > 0, len(contexts))
        level = {"run": code, "n": n, "owner": owner, "total": total[owner], "share": (kinds / np.maximum(total + kinds, 1))[owner], "state": np.ones(len(contexts), bool)}
        if shorter is not None:
            level["rest"] = rest = np.searchsorted(shorter["run"], code & _LOW[d])
        if below is not None:
            met = n > 0
            gain = np.zeros(len(code))
            gain[met] = n[met] * np.log(n[met] / level["total"][met] / (shorter["n"][rest[met]] / shorter["total"][rest[met]]))
            level["state"] = (np.bincount(owner, gain, len(contexts)) >= min_gain) & (total >= least)
        out.append(level)
        shorter = level
    for longer, level in zip(out[:0:-1], out[-2::-1], strict=True):  # suffixes of states are states
        level["state"][level["owner"][longer["rest"][longer["state"][longer["owner"]]]]] = True
    for level in out:
        rest = np.full(len(level["run"]), 1 / 256) if below is None else below["p"][level["rest"]]
        kept = level["state"][level["owner"]] & (level["total"] > 0)
        level["p"] = np.where(kept, level["share"] * rest + (1 - level["share"]) * level["n"] / np.maximum(level["total"], 1), rest)
        below = level
    return out


def probabilities(run: np.ndarray, n: np.ndarray, base: dict[str, np.ndarray], least: int, min_gain: float) -> np.ndarray:
    """log10 probability of each of a leaf's distinct runs, all with contexts of more than ``ROOTS`` bytes.

    ``n``: how often each occurred; ``base``: the longest roots.  A context diverges if n * KL(context || suffix) >= ``min_gain`` nats.
    """
    depth = depth_of(run)
    codes, counts = [], []
    for d in range(ROOTS + 1, DEPTH + 1):
        code, count = counted([run[depth >= d] & _LOW[d + 1]], [n[depth >= d].astype(float)])
        codes.append(code)
        counts.append(count)
    levels = _levels(codes, counts, base, ROOTS + 1, least, min_gain)
    out = np.empty(len(run))
    for d, level in enumerate(levels, ROOTS + 1):
        own = depth == d
        out[own] = level["p"][np.searchsorted(level["run"], run[own] & _LOW[d + 1])]
    return np.log10(out)
