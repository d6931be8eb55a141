"""Ordered steps of one sample: survivor fold, breakpoints, mosaics and the pair-connecting dynamic program."""

from __future__ import annotations

import numpy as np

SAME, SKIPPED = -1, -2


def survivor_fold(first: list[list[int]], second: list[list[int]]) -> tuple[list[int], list[int]]:
    """Labels of both strands from each window's sorted candidate haplotypes.

    A strand keeps the haplotypes that all windows of its run share; where none is left, the run is labelled by its
    least survivor and a new one begins. The two sets of a window cross over if that keeps more survivors.
    """
    out: tuple[list[int], list[int]] = ([], [])
    alive: list[set[int]] = [set(), set()]
    run = [0, 0]
    for w, (a, b) in enumerate(zip(first, second)):
        new = [set(a), set(b)]
        if w and sum(len(s & n) for s, n in zip(alive, new)) < len(alive[0] & new[1]) + len(alive[1] & new[0]):
            new.reverse()
        for strand in (0, 1):
            common = alive[strand] & new[strand]
            if common:
                alive[strand], run[strand] = common, run[strand] + 1
            else:
                if run[strand]:
                    out[strand].extend([min(alive[strand])] * run[strand])
                alive[strand], run[strand] = new[strand], 1
    for strand in (0, 1):
        if run[strand]:
            out[strand].extend([min(alive[strand])] * run[strand])
    return out


def single_breakpoint(x: np.ndarray, fixed: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[int, float]:
    """(b, error): one strand is fixed, the other is `before` for b positions, then `after`; the least b of least error. x: NaN where missing."""
    seen = ~np.isnan(x)
    d_before = np.where(seen, (np.nan_to_num(x) - fixed - before) ** 2, 0)
    d_after = np.where(seen, (np.nan_to_num(x) - fixed - after) ** 2, 0)
    errors = d_after.sum() + np.concatenate([[0], np.cumsum(d_before - d_after)])
    b = int(errors.argmin())
    return b, float(errors[b])


def double_breakpoint(x, before1, after1, before2, after2) -> tuple[int, int, float]:
    """((b1, b2), error): both strands change; the lexicographically first least pair."""
    seen, x, n = ~np.isnan(x), np.nan_to_num(x), len(x)

    def prefix(s1, s2):
        return np.concatenate([[0], np.cumsum(np.where(seen, (x - s1 - s2) ** 2, 0))])

    bb, ba, ab, aa = prefix(before1, before2), prefix(before1, after2), prefix(after1, before2), prefix(after1, after2)
    b1, b2 = np.meshgrid(np.arange(n + 1), np.arange(n + 1), indexing="ij")
    low, high = np.minimum(b1, b2), np.maximum(b1, b2)
    middle = np.where(b1 > b2, ba[high] - ba[low], ab[high] - ab[low])
    errors = bb[low] + middle + aa[n] - aa[high]
    at = int(errors.argmin())
    return at // (n + 1), at % (n + 1), float(errors.reshape(-1)[at])


def breakpoints(x, labels, alleles, double: bool = True) -> tuple[int, int]:
    """(b1, b2) between two windows; labels: i, j, then k, l; alleles: of each label over both windows."""
    i, j, k, l = labels
    if i == k and j == l:
        return SAME, SAME
    if i == k:
        return SAME, single_breakpoint(x, alleles[0], alleles[1], alleles[3])[0]
    if j == l:
        return single_breakpoint(x, alleles[1], alleles[0], alleles[2])[0], SAME
    if not double:
        return SKIPPED, SKIPPED
    return double_breakpoint(x, alleles[0], alleles[2], alleles[1], alleles[3])[:2]


def oriented(x, labels, alleles, double: bool = True) -> tuple[tuple[int, int], tuple[int, int]]:
    """((k, l), (b1, b2)) between two windows whose pairs are not in phase: the second pair is turned if that lets a strand go on.

    As breakpoints() if i = k, or if j = l and no strand goes on in the other orientation. With one strand kept in a turned pair, the other's break point is
    searched with the kept one fixed. If nothing matches, the pair stays as it is.
    """
    i, j, k, l = labels
    if (i, j) == (k, l) or (i == k and j != l):
        return (k, l), breakpoints(x, labels, alleles, double)
    if i == l or j == k:
        turned = [alleles[0], alleles[1], alleles[3], alleles[2]]
        return (l, k), breakpoints(x, (i, j, l, k), turned, double)
    return (k, l), breakpoints(x, labels, alleles, double)


def push(mosaic: list[tuple[int, int, int]], start: int, label: int, window: int) -> None:
    """Append a segment; the last one goes first if the new one doesn't begin after it."""
    if mosaic and start <= mosaic[-1][0]:
        mosaic.pop()
    mosaic.append((start, label, window))


def segments_by_label(labels, points, ranges) -> list[tuple[int, int, int]]:
    """Mosaic (start, label, window) of one strand in typed coordinates: a segment per change of label inside the two windows of a step."""
    out = [(1, labels[0], 1)]
    for w in range(1, len(labels)):
        start_before, end = ranges[w - 1][0], ranges[w][1]
        b = points[w - 1]
        if -1 < b < end - start_before + 1:
            push(out, start_before + b, labels[w], w + 1)
    return out


def segments_by_window(labels, points, ranges) -> list[tuple[int, int, int]]:
    """Mosaic of one strand in which every window begins a segment, so that labels can be looked up window by window."""
    out = [(1, labels[0], 1)]
    for w in range(1, len(labels)):
        (start_before, _), (start, end) = ranges[w - 1], ranges[w]
        before, now, b = labels[w - 1], labels[w], points[w - 1]
        if b < 0:
            push(out, start, now, w + 1)
        elif b == end - start_before + 1:
            push(out, start, before, w + 1)
        elif start_before + b >= start:
            push(out, start, before, w + 1)
            push(out, start_before + b, now, w + 1)
        else:
            push(out, start_before + b, now, w)
            push(out, start, now, w + 1)
    return out


def pair_error(a: tuple[int, int], b: tuple[int, int]) -> int:
    """Squared number of strands that change between two pairs, in the better orientation."""
    straight = (a[0] != b[0]) + (a[1] != b[1])
    crossed = (a[0] != b[1]) + (a[1] != b[0])
    return min(straight, crossed) ** 2


def connect_pairs(windows: list[list[tuple[int, int]]], penalty: float = 1.0) -> tuple[float, list[tuple[int, int]]]:
    """Least total pair_error of one pair per window, and its path; the first of equal choices."""
    arrays = [np.array(pairs) for pairs in windows]
    least = np.zeros(len(windows[-1]))
    step: list[np.ndarray] = []
    for p, q in zip(arrays[-2::-1], arrays[:0:-1]):
        a, b, c, d = p[:, :1], p[:, 1:], q[:, 0], q[:, 1]
        changes = np.minimum((a != c).astype(np.int8) + (b != d), (a != d).astype(np.int8) + (b != c))
        costs = penalty * changes.astype(float) ** 2 + least
        step.insert(0, costs.argmin(axis=1))
        least = costs.min(axis=1)
    at = int(least.argmin())
    path = [windows[0][at]]
    for w, nxt in enumerate(step):
        at = int(nxt[at])
        path.append(windows[w + 1][at])
    return float(least.min()), path


def fewest_flips(x: list, y: list) -> int:
    """Least number of places where either sequence changes, if the two may be swapped at any position: a two-state fold."""
    def change(a, b, c, d):
        return (a != c) + (b != d)

    kept, swapped = 0, 0
    for i in range(1, len(x)):
        straight, crossed = change(x[i - 1], y[i - 1], x[i], y[i]), change(x[i - 1], y[i - 1], y[i], x[i])
        kept, swapped = min(kept + straight, swapped + crossed), min(kept + crossed, swapped + straight)
    return min(kept, swapped)
