"""A pair-by-pair evaluator in plain Python, independent of the Spark plans."""

import math
from itertools import combinations


def edit(a, b):
    a, b = a.replace(" ", ""), b.replace(" ", "")
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def within(atom, kinds, x, y):
    u, v = x[atom.attr], y[atom.attr]
    if any(w is None or (isinstance(w, str) and w != w.strip()) for w in (u, v)):
        return False
    d = edit(str(u), str(v)) if kinds[atom.attr] == "STRING" else abs(int(float(u)) - int(float(v)))
    return d <= atom.threshold


def violates(dd, kinds, x, y):
    if not all(within(a, kinds, x, y) == a.near for a in dd.left):
        return False
    return within(dd.right, kinds, x, y) != dd.right.near


def violations(rows, dds, kinds, n_old=None):
    """rows: _idx -> dict."""
    return {(k, i, j) for k, d in enumerate(dds) for i, j in combinations(sorted(rows), 2) if (n_old is None or j >= n_old) and violates(d, kinds, rows[i], rows[j])}


def errors(found, dds, p, taus, fallback="first"):
    """p: _idx -> attr -> probability or None."""
    out = set()
    for k, i, j in found:
        dd, flagged, first = dds[k], False, True
        cells = [(n, s) for n in dd.attrs for s in (i, j)]
        for n in dd.attrs:
            for s in (i, j):
                if p[s][n] is not None and p[s][n] < taus[n]:
                    out.add((s, n))
                    if first or fallback == "edge":
                        flagged = True
            first = False
        known = [(p[s][n], x, s, n) for x, (n, s) in enumerate(cells) if p[s][n] is not None]
        if not flagged and known:
            _, _, s, n = min(known, key=lambda c: (c[0], c[1]))
            out.add((s, n))
    return out


def joint(rows, target):
    """_idx -> probability, by the dense formula."""
    names = [n for n in next(iter(rows.values())) if n != target]
    n, m = len(rows), len(names)
    f = sum(len({r[a] for r in rows.values()}) for a in names)
    classes = {r[target] for r in rows.values()}
    out = {}
    for i, r in rows.items():
        scores = {}
        for c in classes:
            own = [q for q in rows.values() if q[target] == c]
            scores[c] = math.log(len(own) / n) + sum(math.log((sum(q[a] == r[a] for q in own) + 1) / (len(own) * m + f)) for a in names)
        top = max(scores.values())
        out[i] = math.exp(scores[r[target]] - top) / sum(math.exp(s - top) for s in scores.values())
    return out
