"""Embedding near-duplicates with hierarchical navigable small-world graphs.

Equal vectors of a label are one vector with a count.  Vectors of one label and dimension are cut into shards of at most about
``SHARD`` distinct vectors; one task builds the graph of a shard, and the graphs are kept as rows of bounded size.
Every vector then asks its own shard and those of a higher number, in blocks of the same bound, so two shards meet once and a
link between them counts for both ends: a beam search leads to its neighbourhood, and from there the search goes on over all graph links between vectors above the threshold, in both directions.  Beams
start from the graph's upper levels and from doors, vectors that share a hash of signs with the query, so that a family far from all
others is met though greedy steps don't lead there.  In
each task samples of the queries are also answered by comparing all, until ``TRUE_LINKS`` true links to other vectors were seen or all
queries were compared; while the share of them found is below ``RECALL`` the beam is doubled and the sample is asked again.  A block that
fails at ``WIDEST`` is compared with all of the shard, as a beam that holds the whole shard would do.  A task returns the number of links of each query and
a spanning forest of the links, never all pairs; the forests are joined into components.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clozeframe.llm.common import attach, kept, ragged
from clozeframe.llm.graph import components

THRESHOLD = 0.98
SHARD = 10_000
NEIGHBOURS = 12
BEAM_BUILD = 48
BEAM, WIDEST = 24, 96
RECALL = 0.999
# Hash tables of doors; each has several times as many places as there are vectors.
DOORS = 24
# Queries that are compared with all at a time, and true links that an audit wants to see.
AUDITED, TRUE_LINKS = 64, 64
# Vectors of the first batch and of any batch, vectors of a beam that are expanded in one step, and pairs that are compared at a time.
FIRST_BATCH, BATCH, EXPANDED, PAIRS = 64, 256, 4, 8192
# Links that are followed at a time.
FOLLOWED = 1 << 18


class Graph:
    """A small-world graph over unit vectors in double precision.

    ``links[level]`` has a row of neighbours for every vector, padded with -1; rows of vectors that a level lacks are empty.  Vectors are
    inserted and queries are answered in batches: every step of the beams of a batch is one array operation.  ``doors`` holds the last
    inserted vector of each place of the hash tables, or -1.
    """

    def __init__(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS):
        self.vectors, self.m = vectors, neighbours
        self.links: list[np.ndarray] = []
        self.entry = -1
        bits = len(vectors).bit_length() + 2
        self.planes = np.random.default_rng(DOORS).normal(size=(vectors.shape[1], DOORS * bits))
        self.doors = np.full((DOORS, 1 << bits), -1, dtype=np.int32)
        self.walks: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def places(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each query's places in the doors: the signs of its products with the planes of each table."""
        signs = (queries @ self.planes > 0).reshape(len(queries), DOORS, -1)
        return np.arange(DOORS), (signs @ 2.0 ** np.arange(signs.shape[2])).astype(int)

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 7) -> Graph:
        graph = cls(vectors)
        height = np.random.default_rng(seed).exponential(1 / math.log(NEIGHBOURS), len(vectors)).astype(int)
        at = 0
        while at < len(vectors):
            size = min(max(at // 2, FIRST_BATCH), BATCH)
            graph.insert(np.arange(at, min(at + size, len(vectors))), height)
            at += size
        return graph

    def insert(self, new: np.ndarray, height: np.ndarray) -> None:
        """Each new vector gets links to those that its beam finds and to the nearest of its batch."""
        queries, top = self.vectors[new], len(self.links) - 1
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        starts, places = np.full((len(new), 1), self.entry), self.places(queries)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(top, -1, -1):
            here = height[new] >= level
            if level == 0:
                starts = np.concatenate([starts, self.doors[places]], axis=1)
            ids, sims = np.full((len(new), BEAM_BUILD), -1), np.full((len(new), BEAM_BUILD), -np.inf)
            ids[here], sims[here] = self.beams(queries[here], starts[here], BEAM_BUILD, level)
            ids[~here, :1], sims[~here, :1] = self.beams(queries[~here], starts[~here], 1, level)
            starts = ids
            found.append((ids, sims))
        found.reverse()
        for level in range(int(height[new].max()) + 1):
            if level > top:
                self.links.append(np.full((len(self.vectors), self.most(level)), -1, dtype=np.int32))
            here = np.flatnonzero(height[new] >= level)
            near = among[np.ix_(here, here)]
            best = np.argsort(-near, axis=1, kind="stable")[:, : self.most(0)]
            ids, sims = new[here][best], np.take_along_axis(near, best, axis=1)
            ids[sims == -np.inf] = -1
            if level <= top:
                ids = np.concatenate([found[level][0][here], ids], axis=1)
                sims = np.concatenate([found[level][1][here], sims], axis=1)
            self.connect(new[here], ids, sims, level)
        if int(height[new].max()) > top:
            self.entry = int(new[np.argmax(height[new])])
        self.doors[places] = new[:, None]

    def most(self, level: int) -> int:
        return self.m * (2 if level == 0 else 1)

    def connect(self, new: np.ndarray, ids: np.ndarray, sims: np.ndarray, level: int) -> None:
        links, most = self.links[level], self.most(level)
        chosen = self.spread(ids, sims, self.m)
        links[new, : chosen.shape[1]] = chosen
        rows, cols = np.nonzero(chosen >= 0)
        ends, back = chosen[rows, cols], new[rows]
        order = np.argsort(ends, kind="stable")
        ends, back = ends[order], back[order]
        # The number of an end among the links to the same vector; at most ``most`` are taken at a time.
        first = np.searchsorted(ends, ends)
        turn = np.arange(len(ends)) - first
        for at in range(0, int(turn.max(initial=-1)) + 1, most):
            now = (turn >= at) & (turn < at + most)
            nodes, row = np.unique(ends[now], return_inverse=True)
            more = np.full((len(nodes), most), -1, dtype=np.int32)
            more[row, turn[now] - at] = back[now]
            # A new vector may have chosen the one that chose it.
            more[(more[:, :, None] == links[nodes][:, None, :]).any(axis=2)] = -1
            both = np.concatenate([links[nodes], more], axis=1)
            row, col = np.nonzero(both >= 0)
            sims = np.full(both.shape, -np.inf)
            sims[row, col] = self.cosines(self.vectors[nodes], row, both[row, col])
            links[nodes] = self.spread(both, sims, most)

    def cosines(self, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        out = np.empty(len(rows))
        for at in range(0, len(rows), PAIRS):
            part = slice(at, at + PAIRS)
            out[part] = np.einsum("ij,ij->i", queries[rows[part]], self.vectors[ids[part]])
        return out

    def spread(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row the nearest ones that are nearer to the base than to one chosen before; then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        out = np.full((len(ids), most), -1, dtype=np.int32)
        out[:, : ids.shape[1]] = ids[:, :most]
        full = np.flatnonzero((ids >= 0).sum(axis=1) > most)
        for at in range(0, len(full), BATCH):
            part = full[at : at + BATCH]
            near, own = ids[part], sims[part]
            vectors = self.vectors[near]
            among = vectors @ vectors.transpose(0, 2, 1)
            nearest, chosen = np.full(near.shape, -np.inf), np.zeros(near.shape, dtype=bool)
            left = np.full(len(part), most)
            for k in range(near.shape[1]):
                take = (near[:, k] >= 0) & (left > 0) & (nearest[:, k] < own[:, k])
                chosen[:, k] = take
                left -= take
                nearest[take] = np.maximum(nearest[take], among[take, k])
            picked = np.argsort(np.where(chosen, 0, np.where(near >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
            out[part] = np.take_along_axis(near, picked, axis=1)
        return out

    def beams(self, queries: np.ndarray, starts: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``width`` vectors that each query finds on a level and their cosines, best first, padded with -1."""
        links, n, size = self.links[level], len(self.vectors), len(queries)
        seen = np.zeros(size * n, dtype=np.int32)
        stamp = 0

        def new(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
            """Which pairs were not met before; of equal ones the last."""
            nonlocal stamp
            keys = rows * n + ids
            marks = np.arange(stamp + 1, stamp + 1 + len(keys), dtype=np.int32)
            fresh = np.flatnonzero(seen[keys] == 0)
            seen[keys[fresh]] = marks[fresh]
            stamp += len(keys)
            return fresh[seen[keys[fresh]] == marks[fresh]]

        def scored(rows: np.ndarray, near: np.ndarray) -> np.ndarray:
            sims = np.full(near.shape, -np.inf)
            row, col = np.nonzero(near >= 0)
            kept = new(rows[row], near[row, col])
            row, col = row[kept], col[kept]
            sims[row, col] = self.cosines(queries, rows[row], near[row, col])
            return sims

        ids, sims = np.full((size, width), -1), np.full((size, width), -np.inf)
        done = np.ones((size, width), dtype=bool)

        def merge(rows: np.ndarray, near: np.ndarray) -> None:
            """The best of what the beams have and of what they see for the first time."""
            s = np.concatenate([sims[rows], scored(rows, near)], axis=1)
            i = np.concatenate([ids[rows], near], axis=1)
            d = np.concatenate([done[rows], np.zeros(near.shape, dtype=bool)], axis=1)
            best = np.argsort(-s, axis=1, kind="stable")[:, :width]
            s, i, d = (np.take_along_axis(x, best, axis=1) for x in (s, i, d))
            none = s == -np.inf
            i[none], d[none] = -1, True
            sims[rows], ids[rows], done[rows] = s, i, d

        rows = np.arange(size)
        merge(rows, starts)
        while True:
            rows = rows[~done[rows].all(axis=1)]
            if not len(rows):
                return ids, sims
            # Beams are sorted, so the first that are not done are the best.
            open_ = np.argsort(done[rows], axis=1, kind="stable")[:, :EXPANDED]
            at = ids[rows[:, None], open_]
            at[np.take_along_axis(done[rows], open_, axis=1)] = -1
            done[rows[:, None], open_] = True
            near = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(rows), -1)
            merge(rows, near)

    def within(self, queries: np.ndarray, own: np.ndarray, threshold: float, width: int) -> list[np.ndarray]:
        """Ids that each query of a batch finds with a cosine of at least the threshold.

        A beam leads to the neighbourhood, from the query's own place if it is in the graph, else from the entry, and from its doors; the
        search goes on from what it found over links between vectors above the threshold.
        """
        starts, far = own[:, None].copy(), own < 0
        if far.any():
            near = np.full((int(far.sum()), 1), self.entry)
            for level in range(len(self.links) - 1, 0, -1):
                near, _ = self.beams(queries[far], near, 1, level)
            starts[far] = near
        starts = np.concatenate([starts, self.doors[self.places(queries)]], axis=1)
        ids, sims = self.beams(queries, starts, width, 0)
        rows, cols = np.nonzero(sims >= threshold)
        n, front = len(self.vectors), rows * len(self.vectors) + ids[rows, cols]
        offsets, ends = self.walk(threshold)
        seen = np.zeros(len(queries) * n, dtype=bool)
        hits = np.zeros(len(queries) * n, dtype=bool)
        seen[front] = hits[front] = True
        while len(front):
            following = []
            count = np.cumsum(offsets[front % n + 1] - offsets[front % n])
            for part in np.split(front, np.unique(np.searchsorted(count, np.arange(FOLLOWED, count[-1], FOLLOWED)))):
                first, last = offsets[part % n], offsets[part % n + 1]
                keys = np.repeat(part // n * n, last - first) + ends[ragged(first, last - first)]
                keys = np.unique(keys[~seen[keys]])
                seen[keys] = True
                following.append(keys[self.cosines(queries, keys // n, keys % n) >= threshold])
            front = np.concatenate(following)
            hits[front] = True
        return [np.flatnonzero(h) for h in hits.reshape(len(queries), n)]

    def walk(self, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """The lowest level's links in both directions, as offsets and ends, but for those that no walk can take.

        Two vectors within the threshold's angle of a query are within twice that angle of each other.
        """
        if threshold not in self.walks:
            n = len(self.vectors)
            rows, cols = np.nonzero(self.links[0] >= 0)
            ends = self.links[0][rows, cols]
            close = self.cosines(self.vectors, rows, ends) >= 2 * max(threshold, 0.0) ** 2 - 1 - 1e-9
            rows, ends = rows[close], ends[close]
            keys = np.unique(np.concatenate([rows * n + ends, ends.astype(int) * n + rows]))
            self.walks[threshold] = np.searchsorted(keys, np.arange(n + 1) * n), keys % n
        return self.walks[threshold]

    def dumps(self) -> bytes:
        out = io.BytesIO()
        parts = {"entry": np.array([self.entry, len(self.links)])}
        for level, links in enumerate(self.links):
            ids = np.flatnonzero((links >= 0).any(axis=1)).astype(np.int32)
            parts[f"i{level}"], parts[f"l{level}"] = ids, links[ids]
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def loads(cls, vectors: np.ndarray, data: bytes) -> Graph:
        graph = cls(vectors)
        parts = np.load(io.BytesIO(data))
        graph.entry, levels = (int(x) for x in parts["entry"])
        for level in range(levels):
            links = np.full((len(vectors), graph.most(level)), -1, dtype=np.int32)
            links[parts[f"i{level}"]] = parts[f"l{level}"]
            graph.links.append(links)
        for at in range(0, len(vectors), BATCH):
            graph.doors[graph.places(vectors[at : at + BATCH])] = np.arange(at, min(at + BATCH, len(vectors)))[:, None]
        return graph


def unit(column: pd.Series) -> np.ndarray:
    vectors = np.array(column.tolist(), dtype=np.float64)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _build(key, shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("node")
    graph = Graph.build(unit(shard["embedding"])).dumps()
    return pd.DataFrame(
        {"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "nodes": [shard["node"].tolist()], "copies": [shard["copies"].tolist()], "vectors": [np.array(shard["embedding"].tolist(), dtype=np.float64).tobytes()], "graph": [graph]}
    )


class Forest:
    """Spanning forest of the links of a task: each node knows the least node it was joined to."""

    def __init__(self, size: int):
        self.root = list(range(size))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            x, y = self.find(a), self.find(b)
            self.root[max(x, y)] = min(x, y)


def answer(graph: Graph, queries: np.ndarray, threshold: float, own: np.ndarray, recall: float = RECALL) -> Iterator[np.ndarray]:
    """What each query finds but itself (``own``: its place in the graph, or -1), with a beam that passes the audit.

    If no beam up to ``WIDEST`` does, all queries are compared with all vectors.
    """
    order = np.random.default_rng(len(queries)).permutation(len(queries))
    true: dict[int, int] = {}
    # Without a true link nothing is audited, so samples are drawn until enough were seen.
    for at in range(0, len(order), AUDITED):
        sample = order[at : at + AUDITED]
        near = queries[sample] @ graph.vectors.T >= threshold
        inside = own[sample] >= 0
        near[np.flatnonzero(inside), own[sample][inside]] = False
        true.update(zip(sample.tolist(), near.sum(axis=1).tolist(), strict=True))
        if sum(true.values()) >= TRUE_LINKS:
            break
    linked = np.array([i for i, n in true.items() if n], dtype=int)
    wanted = recall * sum(true.values())

    def found(places: np.ndarray, width: int) -> Iterator[np.ndarray]:
        for at in range(0, len(places), BATCH):
            part = places[at : at + BATCH]
            for i, hits in zip(part.tolist(), graph.within(queries[part], own[part], threshold, width), strict=True):
                yield hits[hits != own[i]]

    def compared() -> Iterator[np.ndarray]:
        for at in range(0, len(queries), BATCH):
            for i, near in enumerate(queries[at : at + BATCH] @ graph.vectors.T >= threshold, at):
                hits = np.flatnonzero(near)
                yield hits[hits != own[i]]

    width = BEAM
    while sum(map(len, found(linked, width))) < wanted:
        if width >= WIDEST:
            return compared()
        width *= 2
    return found(np.arange(len(queries)), width)


def _ask(threshold: float):
    def run(key, graphs: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = {"node": [], "found": [], "other": []}
        if len(graphs) and len(block):
            g = graphs.iloc[0]
            nodes, copies = list(g["nodes"]), np.array(g["copies"])
            stored = np.frombuffer(g["vectors"], dtype=np.float64).reshape(len(nodes), -1)
            graph = Graph.loads(stored / np.sqrt((stored * stored).sum(axis=1, keepdims=True)), g["graph"])
            block = block.sort_values("node")
            queries, asking = unit(block["embedding"]), block["node"].tolist()
            place = {n: i for i, n in enumerate(nodes)}
            own = np.array([place.get(n, -1) for n in asking])
            # Nodes of the task: the shard's, then the queries that are not in the shard.
            names = nodes + [n for n, o in zip(asking, own, strict=True) if o < 0]
            new = iter(range(len(nodes), len(names)))
            forest, found, back = Forest(len(names)), [], np.zeros(len(nodes), dtype=np.int64)
            for o, c, hits in zip(own.tolist(), block["copies"].tolist(), answer(graph, queries, threshold, own), strict=True):
                forest.join(o if o >= 0 else next(new), hits)
                found.append(int(copies[hits].sum()))
                # A query of another shard is not asked by this one.
                if o < 0:
                    back[hits] += c
            roots = [forest.find(i) for i in range(len(names))]
            met = np.flatnonzero(back).tolist()
            asking += [nodes[i] for i in met]
            found += back[met].tolist()
            out = {
                "node": asking + [n for n, r in zip(names, roots, strict=True) if n != names[r]],
                "found": found + [0] * sum(r != i for i, r in enumerate(roots)),
                "other": [None] * len(asking) + [names[r] for i, r in enumerate(roots) if r != i],
            }
        return pd.DataFrame(out).astype({"node": "object", "found": "int64", "other": "object"})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, shard_size: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of equal label and dimension are compared.  NULL labels, NULL or empty vectors, zero vectors and vectors with a NULL
    or non-finite component have no links and are their own component.  Repeated rows count as other
    vectors.  component_id is the smallest vec_id of the component (NULL if all are NULL); kept marks it.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = F.coalesce(finite & F.col("label").isNotNull(), F.lit(False))
    node = F.concat(F.hex(F.xxhash64("label", "embedding")), F.lit("-"), F.hex(F.xxhash64("embedding", F.lit(SHARD))))
    rows = rows.withColumn("node", F.when(valid, node))
    distinct = (
        rows.where("node is not null").groupBy("node")
        .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
        .withColumn("dim", F.size("embedding"))
    )
    distinct = kept(distinct)
    groups = kept(distinct.groupBy("label", "dim").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / shard_size)).cast("int").alias("shards")))
    dealt = attach(distinct, groups, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    graphs = kept(
        dealt.select("label", "dim", "shard", "node", "copies", "embedding").groupBy("label", "dim", "shard")
        .applyInPandas(_build, f"label {dict(distinct.dtypes)['label']}, dim int, shard int, nodes array<string>, copies array<bigint>, vectors binary, graph binary")
    )
    keys = ["label", "dim", "shard", "block"]
    asked = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("shard"))))
    later = F.sequence(F.col("block"), F.col("shards") - 1)
    blocks = dealt.withColumnRenamed("shard", "block").withColumn("shard", F.explode(later)).select(*keys, "node", "copies", "embedding")
    found = kept(asked.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(_ask(threshold), "node string, found bigint, other string"))

    linked = found.where("other is null").groupBy("node").agg(F.sum("found").alias("found"))
    roots = kept(components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))))
    placed = distinct.join(roots, "node", "left").select("node", "first", "copies", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    result = kept(placed.join(least, "root").join(linked, "node").select("node", (F.col("found") + F.col("copies") - 1).alias("n_links"), "component_id"))
    joined = rows.join(result, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


SQL = r"""
with recursive good as (
  select row_number() over (order by vec_id) as r, vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pair as (
  select a.r as a, b.r as b from good a join good b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_cosine_similarity(a.v, b.v) >= 0.98
), walk as (
  select r as node, r as reach from good
  union
  select w.node, p.b from walk w join pair p on w.reach = p.a
), component as (
  select w.node, min(g.vec_id) as component_id from walk w join good g on g.r = w.reach group by w.node
), degree as (
  select a, count(*) as n from pair group by a
), linked as (
  select g.vec_id, c.component_id, coalesce(d.n, 0) as n from good g join component c on c.node = g.r left join degree d on d.a = g.r
)
select e.vec_id, coalesce(l.n, 0)::bigint as n_links, coalesce(l.component_id, e.vec_id) as component_id,
       coalesce(l.component_id, e.vec_id) = e.vec_id as kept
from embeddings e left join linked l on l.vec_id = e.vec_id
"""
