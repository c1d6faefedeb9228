"""The mix of sources by plain loops."""

import hashlib


def targets_by_hand(sizes, percent=150):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = percent / 100 * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in capped]
        if not rest:
            return {s: 2.0 * sizes[s] for s in names}
        share = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in rest)
        over = {s for s in rest if share * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share * weight[s] for s in names}
        capped |= over


def mix_by_hand(rows, target, whole=False):
    """Words taken of each of the rows (id, source, size): all copies by finish time, up to the budget."""
    key = lambda i: hashlib.md5(f"7|{'' if i is None else i}".encode()).hexdigest()[:16]
    copies, names = [], sorted((s for s in target if s is not None)) + [None] * (None in target)
    for place, source in enumerate(names):
        own = sorted((key(i), i is not None, i or 0, size, at) for at, (i, s, size) in enumerate(rows) if s == source)
        start, all_ = 0, sum(o[3] for o in own)
        for number in range(2):
            for k, known, i, size, at in own:
                start += size
                if size:
                    copies.append((start / target[source], k, known, i, place, size, number, at))
    left, taken = sum(int(t) for t in target.values()), [0] * len(rows)
    for *_, size, _, at in sorted(copies):
        if left > 0:
            taken[at] += (size if 2 * left >= size else 0) if whole else min(size, left)
        left -= size
    return taken
