"""Plain versions of what the engine computes."""


def random_edges(r, n, m):
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def reach(edges, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        v = todo.pop()
        for a, b in edges:
            if a == v and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def closure_components(nodes, edges):
    to = {v: reach(edges, [v]) for v in nodes}
    return {v: min(w for w in to[v] if v in to[w]) for v in nodes}


def parts(year, edges):
    """gm, gsi or gr of each node, by following the definitions step by step."""
    gm = reach(edges, {t for s, t in edges if year[s] < year[t]})
    gsi = set()
    for s, t in edges:
        if year[s] == year[t] and t not in gm:
            gsi |= reach([(a, b) for a, b in edges if year[a] == year[b] == year[t] and b not in gm], [t])
    return {v: "gm" if v in gm else "gsi" if v in gsi else "gr" for v in year}
