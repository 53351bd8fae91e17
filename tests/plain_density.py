"""Density clusters in memory, the plain form that the distributed one is compared with."""

import numpy as np


def density_clusters(x: np.ndarray, least: int) -> np.ndarray:
    """Density clusters by excess of mass over the tree of mutual reachability; -1 is noise."""
    n, near = len(x), max(2, least // 2)
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    core = np.partition(d, min(near, n - 1), axis=1)[:, min(near, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    best, link, inside = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    for _ in range(n - 1):  # Prim's tree
        inside[at] = True
        closer = ~inside & (reach[at] < best)
        best[closer], link[closer] = reach[at][closer], at
        nxt = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[nxt], link[nxt], nxt))
        at = nxt
    parent, members = list(range(n)), {i: [i] for i in range(n)}
    born: dict[int, float] = {}
    mass: dict[int, float] = {}
    kids: dict[int, list[int]] = {}
    cluster: dict[int, int | None] = {i: None for i in range(n)}
    held: dict[int, np.ndarray] = {}
    serial = 0

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def close(c, lam):  # a cluster ends going upwards: what stayed in it counts from here
        mass[c] += len(held[c]) * (0 - lam)
        born[c] = lam

    for w, a, b in sorted(edges):
        lam, ra, rb = 1 / max(w, 1e-12), root(a), root(b)
        ca, cb = cluster[ra], cluster[rb]
        joined = members[ra] + members[rb]
        if ca is not None and cb is not None:
            for c in (ca, cb):
                close(c, lam)
            kids[serial], mass[serial], held[serial] = [ca, cb], lam * len(joined), np.array(joined)
            new, serial = serial, serial + 1
        elif ca is not None or cb is not None:
            new = ca if ca is not None else cb
            small = members[rb] if ca is not None else members[ra]
            mass[new] += lam * len(small)
            held[new] = np.array(joined)
        elif len(joined) >= least:
            kids[serial], mass[serial], held[serial] = [], lam * len(joined), np.array(joined)
            new, serial = serial, serial + 1
        else:
            new = None
        parent[rb] = ra
        members[ra], cluster[ra] = joined, new
    pick: dict[int, bool] = {}
    value: dict[int, float] = {}
    for c in range(serial - 1):  # the last is the whole, which is no cluster
        below = sum(value[k] for k in kids[c])
        pick[c], value[c] = mass[c] >= below, max(mass[c], below)
    labels, count = np.full(n, -1), 0
    top = kids.get(serial - 1, []) if serial else []
    stack = list(top)
    while stack:
        c = stack.pop()
        if pick.get(c):
            labels[held[c]] = count
            count += 1
        else:
            stack += kids[c]
    return labels
