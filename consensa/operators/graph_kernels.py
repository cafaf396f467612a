"""Graph measures without a relational form, one sample's graph a call: weighted betweenness, component impact.

Betweenness is split into batches of source vertices over one set of arrays a sample, so a large sample is spread over many tasks; partial
sums are added by Spark. Component impact is one depth-first search a sample, and joins where a sample is too large for that.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import keep, scope
from . import biconnected

EPS = 1e-9


def _near(a: float, b: float) -> bool:
    return abs(a - b) <= EPS * max(abs(a), abs(b), 1e-30)


def partial_betweenness(n: int, adj: list[list[tuple[int, float, int]]], sources) -> np.ndarray:
    """Dependency sums of the given sources; a neighbour is (vertex, length, number of parallel edges), and each of these is a path."""
    out = np.zeros(n)
    for s in sources:
        dist = {s: 0.0}
        sigma, preds = defaultdict(float), defaultdict(list)
        sigma[s] = 1.0
        heap, done, order = [(0.0, s)], set(), []
        while heap:
            d, u = heapq.heappop(heap)
            if u in done:
                continue
            done.add(u)
            order.append(u)
            for v, w, times in adj[u]:
                if v in done:
                    continue
                alt = d + w
                old = dist.get(v)
                if old is None or (alt < old and not _near(alt, old)):
                    dist[v], sigma[v], preds[v] = alt, sigma[u] * times, [(u, times)]
                    heapq.heappush(heap, (alt, v))
                elif _near(alt, old):
                    sigma[v] += sigma[u] * times
                    preds[v].append((u, times))
        delta = defaultdict(float)
        for v in reversed(order):
            for u, times in preds[v]:
                delta[u] += sigma[u] * times / sigma[v] * (1 + delta[v])
            if v != s:
                out[v] += delta[v]
    return out


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one after another."""
    return np.arange(count.sum()) + np.repeat(start - (np.cumsum(count) - count), count)


def _once(x: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Each value of ``x`` once; ``place`` is room for all values there are."""
    at = np.arange(len(x))
    place[x] = at
    return x[place[x] == at]


def _distances(start, to, length, sources: np.ndarray, width: float) -> np.ndarray:
    """Distances from each source, flat (source x vertex). All searches run together: each takes its nearest bucket of open vertices at a time."""
    n, many = len(start) - 1, len(sources)
    dist = np.full(many * n, np.inf)
    active = np.arange(many) * n + sources
    dist[active] = 0.0
    is_open, place = np.zeros(many * n, bool), np.empty(many * n, np.int64)
    while len(active):
        search, d = active // n, dist[active]
        low = np.full(many, np.inf)
        np.minimum.at(low, search, d)
        now = d <= low[search] + width
        here = active[now]
        v = here % n
        count = start[v + 1] - start[v]
        edge = _spread(start[v], count)
        target = np.repeat(here - v, count) + to[edge]
        reach = np.repeat(dist[here], count) + length[edge]
        better = reach < dist[target]
        target = target[better]
        np.minimum.at(dist, target, reach[better])
        is_open[here] = False
        target = _once(target, place)
        target = target[~is_open[target]]
        is_open[target] = True
        active = np.concatenate((active[~now], target))
    return dist


def dependencies(start: np.ndarray, to: np.ndarray, length: np.ndarray, times: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """As ``partial_betweenness``, over compressed rows: the neighbours of v are ``to[start[v]:start[v + 1]]``; all sources at once in arrays."""
    n, many, m = len(start) - 1, len(sources), len(to)
    out = np.zeros(n)
    if not m:
        return out
    width = float(np.median(length)) / 2
    dist = _distances(start, to, length, sources, width).reshape(many, n)
    tail = np.repeat(np.arange(n), np.diff(start))
    before, after = dist[:, tail], dist[:, to]
    with np.errstate(invalid="ignore"):
        alt = before + length
        tight = (before < after) & (alt - after <= EPS * alt)  # no sum is below its vertex's distance
    row, edge = np.nonzero(tight)  # by source, then tail
    u, v, t = row * n + tail[edge], row * n + to[edge], times[edge]
    ins = np.bincount(v, minlength=many * n)
    outs = np.bincount(u, minlength=many * n)
    first = np.cumsum(outs) - outs
    sigma, delta = np.zeros(many * n), np.zeros(many * n)
    front = np.arange(many) * n + sources
    sigma[front] = 1.0
    met = np.zeros(many * n, bool)
    met[front] = True
    levels, place = [], np.empty(many * n, np.int64)
    while len(front):
        e = _spread(first[front], outs[front])
        levels.append(e)
        np.add.at(sigma, v[e], sigma[u[e]] * t[e])
        np.subtract.at(ins, v[e], 1)
        front = _once(v[e], place)
        front = front[ins[front] == 0]
        met[front] = True
    for e in reversed(levels):
        np.add.at(delta, u[e], sigma[u[e]] * t[e] / sigma[v[e]] * (1 + delta[v[e]]))
    delta[np.arange(many) * n + sources] = 0.0
    delta = delta.reshape(many, n)
    # lengths too small beside a distance to tell its ends apart: these searches go one vertex at a time
    whole = (met.reshape(many, n) == np.isfinite(dist)).all(axis=1)
    out += delta[whole].sum(axis=0)
    if not whole.all():
        adj = [[(int(to[k]), float(length[k]), times[k]) for k in range(start[x], start[x + 1])] for x in range(n)]
        out += partial_betweenness(n, adj, sources[~whole].tolist())
    return out


WORK = 20_000_000  # sources x edges that one batch walks
AT_ONCE = 2_000_000  # sources x edges of searches that run together
SENT_BYTES = 64 << 20  # graphs of up to so many bytes are sent to each executor once


def compressed(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """One row a sample: names, and its graph in compressed rows, as bytes (start long, to int, length double, times double).

    Parallel edges of one weight are counted before the shuffle; of parallel edges only the shortest lie on shortest paths.
    """
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    parts = edges.filter("src <> dst and weight is not null").select(
        "sample_id", low.alias("src"), high.alias("dst"), (1.0 / F.greatest(F.abs(F.col("weight").cast("double")), F.lit(EPS))).alias("length"),
    )
    parts = parts.groupBy("sample_id", "src", "dst", "length").agg(F.count("*").cast("double").alias("times"))
    lone = vertices.select("sample_id", F.col("gene").alias("src")).distinct()
    kind = f"sample_id {edges.schema['sample_id'].dataType.simpleString()}, names array<string>, start binary, to binary, length binary, times binary, n long, m long"

    def run(key, pdf):
        import pandas as pd

        names, at = np.unique(np.concatenate((pdf["src"].to_numpy(), pdf["dst"].dropna().to_numpy())).astype(str), return_inverse=True)
        has = pdf["dst"].notna().to_numpy()
        a, b = at[: len(pdf)][has], at[len(pdf) :]
        length, times = pdf["length"].to_numpy(float)[has], pdf["times"].to_numpy(float)[has]
        order = np.lexsort((length, b, a))
        a, b, length, times = (x[order] for x in (a, b, length, times))
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.empty(0, int)
        least = np.repeat(length[new], np.diff(np.append(new, len(a))))
        near = np.abs(length - least) <= EPS * np.maximum(length, 1e-30)
        times = np.add.reduceat(np.where(near, times, 0.0), new) if len(new) else times[:0]
        a, b, length = a[new], b[new], length[new]
        tail, to = np.concatenate((a, b)), np.concatenate((b, a)).astype(np.int32)
        order = np.lexsort((to, tail))
        start = np.concatenate(([0], np.cumsum(np.bincount(tail, minlength=len(names))))).astype(np.int64)
        two = lambda x: np.concatenate((x, x))[order].tobytes()
        return pd.DataFrame({
            "sample_id": [key[0]], "names": [names.tolist()], "start": [start.tobytes()], "to": [to[order].tobytes()], "length": [two(length)], "times": [two(times)],
            "n": [len(names)], "m": [len(to)],
        })

    return parts.unionByName(lone, True).groupBy("sample_id").applyInPandas(run, kind)


def betweenness(edges: DataFrame, vertices: DataFrame, work: int = WORK) -> DataFrame:
    """(sample_id, gene, betweenness): lengths 1 / |weight|, undirected, over (n - 1)(n - 2) / 2 pairs, isolated vertices counted.

    A sample's graph is made once, as arrays. It gets as many batches of sources as its size asks (``work``); the graphs are sent to each executor
    once if they are small, and otherwise once a batch.
    """
    with scope(edges.sparkSession) as own:
        graphs = keep(compressed(edges, vertices), "graphs")
        own.spare(graphs)
    batches = graphs.select("sample_id", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("m") / work)).cast("int").alias("batches"))
    batches = batches.withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)))
    tasks = max(1, min(batches.count(), 4096))
    size = graphs.agg(F.sum(16 * F.col("m") + 40 * F.col("n"))).first()[0] or 0
    rows = batches.repartition(tasks, "sample_id", "batch").join(F.broadcast(graphs) if size <= SENT_BYTES else graphs, "sample_id")
    kind = f"sample_id {edges.schema['sample_id'].dataType.simpleString()}, gene string, part double"

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for g in pdf.itertuples():
                arrays = [np.frombuffer(x, k) for x, k in ((g.start, np.int64), (g.to, np.int32), (g.length, float), (g.times, float))]
                sources = np.arange(g.batch, g.n, g.batches)
                step = max(1, AT_ONCE // max(g.m, 1))
                got = sum((dependencies(*arrays, sources[k : k + step]) for k in range(0, len(sources), step)), np.zeros(g.n))
                scale = (g.n - 1) * (g.n - 2) or 1  # each pair is met from both ends
                yield pd.DataFrame({"sample_id": g.sample_id, "gene": g.names, "part": got / scale})

    return rows.mapInPandas(run, kind).groupBy("sample_id", "gene").agg(F.sum("part").alias("betweenness"))


def component_impact(n: int, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Per vertex: half the relative loss of the largest component's size plus half that of its weight, if the vertex goes.

    One depth-first search finds, for each vertex, the subtrees that it alone ties to the rest; sums of size, weight
    and least index over these, and over what is left, give the largest piece after deletion (ties: the least vertex).
    """
    adj: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for k, (a, b, _) in enumerate(edges):
        adj[a].append((b, k))
        adj[b].append((a, k))
    weight_at = np.zeros(n)
    for a, b, w in edges:
        weight_at[a] += abs(w)
        weight_at[b] += abs(w)
    disc, low, parent, order = [-1] * n, [0] * n, [-1] * n, []
    comp, comps = [-1] * n, []
    for root in range(n):
        if disc[root] >= 0:
            continue
        disc[root] = low[root] = len(order)
        order.append(root)
        comp[root] = len(comps)
        members, stack = [root], [(root, iter(adj[root]))]
        while stack:
            u, it = stack[-1]
            for v, _ in it:
                if disc[v] < 0:
                    parent[v] = u
                    disc[v] = low[v] = len(order)
                    order.append(v)
                    comp[v] = len(comps)
                    members.append(v)
                    stack.append((v, iter(adj[v])))
                    break
                if v != parent[u]:  # edges to the parent, parallel ones too, are tree edges
                    low[u] = min(low[u], disc[v])
            else:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[u])
        comps.append(members)
    # sums over subtrees: the edges' weight by their lower end (in search order), size, least index
    size, least, inner = [1] * n, list(range(n)), np.zeros(n)
    for a, b, w in edges:
        inner[a if disc[a] > disc[b] else b] += abs(w)  # belongs to its deeper end
    total = inner.copy()
    for v in reversed(order):
        if parent[v] >= 0:
            size[parent[v]] += size[v]
            total[parent[v]] += total[v]
            least[parent[v]] = min(least[parent[v]], least[v])
    weights = [float(total[m[0]]) for m in comps]
    tie = [min(m) for m in comps]
    rank = sorted(range(len(comps)), key=lambda c: (-len(comps[c]), tie[c]))
    out = np.zeros(n)
    if not comps:
        return out
    top = rank[0]
    big, mass, ordered = len(comps[top]), weights[top], sorted(comps[top])
    second = rank[1] if len(rank) > 1 else None
    children = defaultdict(list)
    for v in order:
        if parent[v] >= 0:
            children[parent[v]].append(v)
    left_edges = len(edges)
    degree = [len(x) for x in adj]
    # weight of edges from a subtree to vertex v itself, for each cut child
    for v in range(n):
        if left_edges - degree[v] == 0:
            out[v] = 1.0
            continue
        if comp[v] != top:
            continue
        to_v: dict[int, float] = defaultdict(float)
        cut = [c for c in children[v] if low[c] >= disc[v]]
        starts = [disc[c] for c in cut]
        for u, k in adj[v]:
            if disc[u] > disc[v]:
                i = int(np.searchsorted(starts, disc[u], side="right")) - 1
                if i >= 0 and disc[u] < disc[cut[i]] + size[cut[i]]:
                    to_v[cut[i]] += abs(edges[k][2])
        pieces = [(size[c], least[c], float(total[c]) - to_v[c]) for c in cut]
        rest = big - 1 - sum(p[0] for p in pieces)
        if rest > 0:
            low_rest = _least_outside(ordered, v, [(disc[c], disc[c] + size[c]) for c in cut], disc)
            pieces.append((rest, low_rest, mass - weight_at[v] - sum(p[2] for p in pieces)))
        if second is not None:
            pieces.append((len(comps[second]), tie[second], weights[second]))
        best = min(pieces, key=lambda p: (-p[0], p[1])) if pieces else (0, 0, 0.0)
        out[v] = 0.5 * (big - best[0]) / big + (0.5 * (mass - best[2]) / mass if mass else 0.0)
    return out


def _least_outside(ordered: list[int], v: int, ranges: list[tuple[int, int]], disc: list[int]) -> int:
    """Least vertex of the component that is neither ``v`` nor in one of the search-order ranges."""
    return next((m for m in ordered if m != v and not any(a <= disc[m] < b for a, b in ranges)), -1)


LOCAL_EDGES = 1_000_000  # edges and vertices of a graph that one task searches


def impact(edges: DataFrame, vertices: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(sample_id, gene, largest_component_impact). A graph of up to ``local`` edges and vertices is one search; larger ones go by joins (``biconnected``)."""
    parts = edges.select("sample_id", "src", "dst", F.col("weight").cast("double").alias("weight")).filter("src <> dst")
    rows = parts.unionByName(vertices.select(
        "sample_id", F.col("gene").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("double").alias("weight"),
    ))
    with scope(edges.sparkSession) as own:
        large = keep(rows.groupBy("sample_id").count().filter(F.col("count") > local).select("sample_id"), "impact-large")
        if large.isEmpty():
            return _searched(rows)
        # a number of samples
        few = _searched(rows.join(large, "sample_id", "left_anti"))
        many = biconnected.impact(edges.join(large, "sample_id", "left_semi"), vertices.join(large, "sample_id", "left_semi"))
        out = keep(few.unionByName(many), "impact")
        own.spare(out)
    return out


def _searched(rows: DataFrame) -> DataFrame:
    def run(key, pdf):
        import pandas as pd

        names = sorted(set(pdf["src"].dropna()) | set(pdf["dst"].dropna()))
        at = {g: i for i, g in enumerate(names)}
        es = [(at[a], at[b], w) for a, b, w in zip(pdf["src"], pdf["dst"], pdf["weight"]) if isinstance(b, str)]
        return pd.DataFrame({"sample_id": key[0], "gene": names, "largest_component_impact": component_impact(len(names), es)})

    kind = f"sample_id {rows.schema['sample_id'].dataType.simpleString()}, gene string, largest_component_impact double"
    return rows.groupBy("sample_id").applyInPandas(run, kind)
