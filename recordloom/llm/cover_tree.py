"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors of one label link at a cosine of THRESHOLD or more; on unit vectors that
is a Euclidean distance of sqrt(2 - 2 * THRESHOLD) or less. Equal vectors are one
class before anything else, with its size as a weight.

The tree has two parts. Above, its levels are tables, made for all labels at once:
each node of more than BLOCK classes that still has an open pair is opened by up to
PIVOTS pivots, a net of half its radius among a few of its points, and every class
goes to its nearest pivot: to the pivot's inner child, if it lies within half the
radius, else to its outer one. The open pairs of nodes follow level by level: a pair
is closed if its centres lie too far apart for both radii, and linked as a whole,
by sums over its nodes, if all of it must link. What is left are pairs of nodes of
BLOCK classes at most; each such pair meets in one task, where the tree goes on below:
nested levels with halving radii, traversed in pairs in the same way. Meetings give
link counts and the edges of a spanning forest, never all pairs. Vectors that
no ball tells apart, like random directions, all have to meet: then the work
grows with the square of a label's classes, as in any exact tree.

Vectors that are null, zero, or hold null or non-finite components, and those
without a label, link with nothing: each is its own component. Vectors of different
lengths don't link. A null vec_id stays null and isn't kept. Repeated rows link with
each other. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import cut, table
from recordloom.llm.components import components

THRESHOLD = 0.98
#: Classes of a node that isn't opened in the tables; pivots of one that is, of so many of its points.
BLOCK, PIVOTS, SAMPLE = 8192, 64, 512
#: Classes that look for their pivots in one task.
PART = 16_384
#: A node of this radius can't be told apart by distance; its classes are dealt out evenly.
POINT = 1e-9
#: What rounding may add to a distance; pairs that near a bound are compared one by one.
SLACK = 1e-7
LEAF = 32
#: Children of a node after which, if most are single points, the rest become single points too.
TRIED = 64


@dataclass
class Node:
    """Points within radius of a centre; children cover them at half of it."""

    points: np.ndarray
    center: int
    radius: float
    children: list[Node] | None = field(default=None)
    grid: tuple[np.ndarray, np.ndarray, np.ndarray] | None = field(default=None)


def _grid(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres, radii, and which are single points."""
    return np.array([c.center for c in nodes]), np.array([c.radius for c in nodes]), np.array([len(c.points) == 1 for c in nodes])


class CoverTree:
    """A cover tree of unit vectors; nodes get their children when they are first visited."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.root = self._node(np.arange(len(x)), 0)

    def _far(self, points: np.ndarray, center: int) -> np.ndarray:
        return np.linalg.norm(self.x[points] - self.x[center], axis=1)

    def _node(self, points: np.ndarray, center: int) -> Node:
        return Node(points, center, float(self._far(points, center).max()) if len(points) > 1 else 0.0)

    def children(self, node: Node) -> list[Node]:
        if node.children is None:
            node.children, left, center, half, single = [], node.points, node.center, node.radius / 2, 0
            while len(left):
                if len(node.children) >= TRIED and 2 * single > len(node.children):
                    node.children += [Node(left[k : k + 1], int(left[k]), 0.0) for k in range(len(left))]
                    break
                inside = self._far(left, center) <= half
                inside |= left == center
                node.children.append(self._node(left[inside], center))
                left = left[~inside]
                single += len(node.children[-1].points) == 1
                center = int(left[0]) if len(left) else -1
            node.grid = _grid(node.children)
        return node.children


class Meeting:
    """Link counts, weighted, and a spanning forest of the links of one block or between two."""

    def __init__(self, a: CoverTree, b: CoverTree, size_a: np.ndarray, size_b: np.ndarray, threshold: float = THRESHOLD):
        self.a, self.b, self.size = a, b, (size_a, size_b)
        self.threshold, self.far = threshold, float(np.sqrt(2 - 2 * threshold))
        self.same = a is b
        self.links = (np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64))
        self.parent = np.arange(len(a.x) + (0 if self.same else len(b.x)))
        self.shift = 0 if self.same else len(a.x)
        self.edges: list[tuple[int, int]] = []
        self.visit(a.root, b.root)

    def _root(self, k: int) -> int:
        p = self.parent
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return k

    def _roots(self, k: np.ndarray) -> np.ndarray:
        k = self.parent[k]
        while ((up := self.parent[k]) != k).any():
            k = up
        return k

    def _join(self, i: int, j: int) -> None:
        u, v = self._root(i), self._root(j + self.shift)
        if u != v:
            self.parent[max(u, v)] = min(u, v)
            self.edges.append((i, j))

    def _count(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links of all points i with all points j."""
        self.links[0][i] += self.size[1][j].sum()
        (self.links[0] if self.same else self.links[1])[j] += self.size[0][i].sum()
        for k in i:
            self._join(int(k), int(j[0]))
        for k in j[1:]:
            self._join(int(i[0]), int(k))

    def _matrix(self, i: np.ndarray, j: np.ndarray, near: np.ndarray, itself: bool) -> None:
        """Links of points i with points j where near; of a set with itself, if so."""
        self.links[0][i] += near @ self.size[1][j]
        if not itself:
            (self.links[0] if self.same else self.links[1])[j] += self.size[0][i] @ near
        own, other = self._roots(i), self._roots(j + self.shift)
        p, q = np.nonzero(near & (own[:, None] != other[None, :]))
        # one link of each two trees is enough
        for k in np.unique(own[p] * len(self.parent) + other[q], return_index=True)[1]:
            self._join(int(i[p[k]]), int(j[q[k]]))

    def _each(self, m: Node, n: Node) -> None:
        """Points one by one, in blocks of bounded size."""
        for at in range(0, len(m.points), 1024):
            i = m.points[at : at + 1024]
            near = self.a.x[i] @ self.b.x[n.points].T >= self.threshold
            if m is n:
                near &= i[:, None] != n.points[None, :]
            self._matrix(i, n.points, near, m is n)

    def visit(self, m: Node, n: Node) -> None:
        pending = [(m, n)]
        while pending:
            m, n = pending.pop()
            if m is n:
                if 2 * m.radius + SLACK <= self.far:  # all of it links with all of it
                    if len(m.points) > 1:
                        size = self.size[0][m.points]
                        self.links[0][m.points] += size.sum() - size
                        for k in m.points:
                            if k != m.center:
                                self._join(int(m.center), int(k))
                    continue
                if len(m.points) <= LEAF:
                    self._each(m, m)
                    continue
            else:
                d = float(np.linalg.norm(self.a.x[m.center] - self.b.x[n.center]))
                if d > self.far + m.radius + n.radius + SLACK:
                    continue
                if d + m.radius + n.radius + SLACK <= self.far:
                    self._count(m.points, n.points)
                    continue
                if len(m.points) <= LEAF and len(n.points) <= LEAF or len(m.points) * len(n.points) <= LEAF * LEAF:
                    self._each(m, n)
                    continue
            # the wider node is opened; a node with itself in both places
            left = self.a.children(m) if m is n or m.radius >= n.radius else [m]
            right = left if m is n else [n] if m.radius >= n.radius else self.b.children(n)
            of = lambda node, nodes: node.grid if nodes is node.children else _grid(nodes)
            (ci, ri, one_i), (cj, rj, one_j) = of(m, left), of(n, right)
            for at in range(0, len(left), 1024):
                part = slice(at, at + 1024)
                cos = self.a.x[ci[part]] @ self.b.x[cj].T
                points = one_i[part, None] & one_j[None, :]
                link = points & (cos >= self.threshold)
                if m is n:
                    link &= ci[part, None] != cj[None, :]
                if link.any():
                    self._matrix(ci[part], cj, link, m is n)
                reach = self.far + ri[part, None] + rj[None, :] + SLACK
                # cos and distance: d^2 = 2 - 2 cos; rounding of cos near 1 is covered by the slack
                near = ~points & (np.sqrt(np.maximum(2 - 2 * cos, 0)) <= reach)
                for p, q in zip(*np.nonzero(near)):
                    if m is not n or p + at <= q:
                        pending.append((left[p + at], right[q]))


def _units(rows: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet(rows: pd.DataFrame) -> pd.DataFrame:
    """One meeting: rows (side, class, size, embedding), side 0 alone for a block with itself."""
    one, two = rows[rows["side"] == 0], rows[rows["side"] == 1]
    a = CoverTree(_units(one["embedding"]))
    b = CoverTree(_units(two["embedding"])) if len(two) else a
    size_a = one["size"].to_numpy(np.int64)
    size_b = two["size"].to_numpy(np.int64) if len(two) else size_a
    met = Meeting(a, b, size_a, size_b)
    ids_a = one["class"].to_numpy(np.int64)
    ids_b = two["class"].to_numpy(np.int64) if len(two) else ids_a
    out = [(int(c), None, int(n)) for ids, links in zip((ids_a, ids_b), met.links) for c, n in zip(ids, links) if n]
    out += [(int(ids_a[i]), int(ids_b[j]), 0) for i, j in met.edges]
    return pd.DataFrame(out, columns=["u", "v", "links"]).astype({"u": "int64", "v": "Int64", "links": "int64"})


def _net(rows: pd.DataFrame) -> pd.DataFrame:
    """Pivots (node, k, center) of one opened node, from rows (node, radius, class, embedding): each the point farthest from those before."""
    node, radius = rows["node"].iloc[0], float(rows["radius"].iloc[0])
    x = _units(rows.sort_values("class")["embedding"].head(SAMPLE))
    if radius <= POINT:
        chosen = [x[0]] * PIVOTS
    else:
        chosen, far = [x[0]], np.linalg.norm(x - x[0], axis=1)
        while len(chosen) < PIVOTS and far.max() > radius / 2:
            chosen.append(x[int(far.argmax())])
            far = np.minimum(far, np.linalg.norm(x - chosen[-1], axis=1))
    return pd.DataFrame({"node": node, "k": range(len(chosen)), "center": chosen})


def _dealt(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Some classes of one node with the child that they go to and their distance from its centre."""
    if not len(rows):
        return pd.DataFrame({"class": [], "size": [], "embedding": [], "node": [], "k": [], "outer": [], "far": []})
    pivots = pivots.sort_values("k")
    p, radius, out = np.stack(pivots["center"]), float(rows["radius"].iloc[0]), []
    for at in range(0, len(rows), 1024):
        some = rows.iloc[at : at + 1024]
        d = np.sqrt(np.maximum(2 - 2 * (_units(some["embedding"]) @ p.T), 0))
        if radius <= POINT:
            k = (some["class"].to_numpy(np.int64) * 0x9E3779B1 >> 16) % len(p)
        else:
            k = d.argmin(axis=1)
        far = np.linalg.norm(_units(some["embedding"]) - p[k], axis=1)
        out.append(pd.DataFrame({"class": some["class"].to_numpy(), "size": some["size"].to_numpy(), "embedding": some["embedding"].to_numpy(), "node": some["node"].to_numpy(), "k": k, "outer": (far > radius / 2) & (radius > POINT), "far": far}))
    return pd.concat(out)


def _apart(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [np.linalg.norm(np.stack(a.iloc[at : at + 1024]) - np.stack(b.iloc[at : at + 1024]), axis=1) for at in range(0, len(a), 1024)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of(a, b)


def _grown(classes: DataFrame, block: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The upper tree of all labels: members (class, size, embedding, node), open pairs (u, v), pairs that link as a whole (u, v), nodes (node, size, rep).

    A node's name is its parent's with a part more. An open pair of a node with itself has u = v.
    """
    far = float(np.sqrt(2 - 2 * threshold))
    root = F.concat_ws("x", "label", "dim")
    members = classes.select("class", "size", "embedding", root.alias("node"))
    stats = lambda rows, *more: rows.groupBy("node", *more).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("class").alias("rep"))
    nodes = cut(stats(members).withColumn("radius", F.lit(2.0)), "nodes")
    pairs = nodes.select(F.col("node").alias("u"), F.col("node").alias("v"))
    settled, known, open_pairs, whole = [], [nodes.select("node", "size", "rep")], [], []
    for level in count():
        live = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        big = cut(nodes.where(F.col("n") > block).join(live, "node").select("node", "n", "radius"), "big-nodes")
        if not big.limit(1).count():
            break
        settled.append(members.join(big, "node", "left_anti"))
        of_big = members.join(big, "node")
        few = F.pmod(F.xxhash64("class", F.lit(level)), F.lit(1 << 30)) < (1 << 30) * 2 * SAMPLE / F.col("n")
        pivots = cut(of_big.where(few).groupBy("node").applyInPandas(_net, "node string, k int, center array<double>"), "pivots")
        parted = F.ceil(F.col("n") / PART).cast("int")
        rows = of_big.withColumn("part", F.pmod(F.xxhash64("class"), parted).cast("int"))
        copies = pivots.join(big, "node").select("node", "k", "center", F.explode(F.sequence(F.lit(0), parted - 1)).alias("part"))
        found = rows.groupBy("node", "part").cogroup(copies.groupBy("node", "part"))
        dealt = found.applyInPandas(_dealt, "class bigint, size bigint, embedding array<double>, node string, k int, outer boolean, far double")
        name = F.concat("node", F.lit("/"), F.col("k").cast("string"), F.when(F.col("outer"), "+").otherwise(""))
        dealt = cut(dealt.select("class", "size", "embedding", F.col("node").alias("parent"), "k", "far", name.alias("node")), "members")
        members = dealt.select("class", "size", "embedding", "node")
        made = stats(dealt, "parent", "k").join(dealt.groupBy("node").agg(F.max("far").alias("radius")), "node")
        made = made.join(pivots.withColumnRenamed("node", "parent"), ["parent", "k"])
        # pairs of nodes of which neither is opened stay; the others are opened, a node that isn't stands for itself
        nodes_now = nodes if "center" in nodes.columns else nodes.withColumn("center", F.lit(None).cast("array<double>"))
        own = nodes_now.join(big, "node", "left_anti").select(F.col("node").alias("parent"), "node", "radius", "center", "n", "size", "rep", F.lit(False).alias("new"))
        below = cut(own.unionByName(made.select("parent", "node", "radius", "center", "n", "size", "rep", F.lit(True).alias("new"))), "below")
        known.append(below.where("new").select("node", "size", "rep"))
        flagged = lambda side: big.select(F.col("node").alias(side), F.lit(True).alias(f"{side}_big"))
        marked = cut(pairs.join(flagged("u"), "u", "left").join(flagged("v"), "v", "left"), "pairs")
        open_pairs.append(marked.where("u_big is null and v_big is null").select("u", "v"))
        side = lambda s: below.select(F.col("parent").alias(s), F.col("node").alias(f"{s}2"), F.col("radius").alias(f"r{s}"), F.col("center").alias(f"c{s}"))
        met = marked.where("u_big or v_big").join(side("u"), "u").join(side("v"), "v").where("u <> v or u2 <= v2")
        reach = F.col("ru") + F.col("rv")
        met = met.withColumn("d", F.when(F.col("u2") == F.col("v2"), F.lit(0.0)).otherwise(_apart(F.col("cu"), F.col("cv"))))
        met = cut(met.where(F.col("d") <= far + reach + SLACK).select(F.col("u2").alias("u"), F.col("v2").alias("v"), (F.col("d") + reach + SLACK <= far).alias("whole")), "node-pairs")
        whole.append(met.where("whole").select("u", "v"))
        pairs, nodes = met.where("not whole").select("u", "v"), below.select("node", "radius", "center", "n", "size", "rep")
    settled.append(members)
    open_pairs.append(pairs)
    join = lambda parts: reduce(DataFrame.unionByName, parts) if parts else pairs.limit(0)
    return join(settled), join(open_pairs), join(whole), join(known)


def _linked_whole(members: DataFrame, whole: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, links) and edges (u, v) that pairs of nodes give which link as a whole; a node with itself has u = v."""
    both = whole.union(whole.where("u <> v").select("v", "u"))
    one = nodes.select(F.col("node").alias("u"), F.col("rep").alias("rep_u"))
    two = nodes.select(F.col("node").alias("v"), F.col("rep").alias("rep_v"), F.col("size").alias("size_v"))
    named = cut(both.join(one, "u").join(two, "v"), "whole-pairs")
    more = named.groupBy(F.col("u").alias("node")).agg(F.sum("size_v").alias("more"), F.max((F.col("u") == F.col("v")).cast("int")).alias("self"), F.min("rep_v").alias("rep"))
    parts = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    under = cut(members.select("class", "size", F.explode(above).alias("node")).join(more, "node"), "under-whole")
    links = under.groupBy("class").agg(F.sum(F.col("more") - F.col("self") * F.col("size")).alias("links"))
    edges = named.select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")).union(under.select("class", "rep")).where("u <> v")
    return links, edges


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("bigint").alias("label"))
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    valid = F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(valid)
    grouped = good.groupBy("label", "embedding").agg(F.count("*").alias("size"), F.min("vec_id").alias("least"))
    classes = cut(grouped.select("label", "embedding", F.size("embedding").alias("dim"), "size", "least", F.monotonically_increasing_id().alias("class")), "classes")
    members, pairs, whole, nodes = _grown(classes, block, THRESHOLD)
    side = lambda k, s: pairs.where("u <> v" if k else "true").select(F.col(s).alias("node"), F.lit(k).alias("side"), F.struct("u", "v").alias("pair"))
    met = members.join(side(0, "u").union(side(1, "v")), "node").select("pair", "side", "class", "size", "embedding").groupBy("pair")
    found = cut(met.applyInPandas(_meet, "u bigint, v bigint, links bigint"), "links")
    links, edges = found.where("v is null").select(F.col("u").alias("class"), "links"), found.where("v is not null").select("u", "v")
    if whole.limit(1).count():
        more, joined = _linked_whole(members, whole, nodes)
        links, edges = links.union(more), edges.union(joined)
    links = links.groupBy("class").agg(F.sum("links").alias("links"))
    roots = components(edges).select(F.col("node").alias("class"), "root")
    named = classes.join(links, "class", "left").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    linked = good.join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS (
  SELECT * FROM rows
  WHERE label IS NOT NULL AND x IS NOT NULL
    AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(x, lambda c: c <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v
  FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= {THRESHOLD}
), reached AS (
  SELECT vec_id AS u, vec_id AS v FROM rows
  UNION
  SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u
), component AS (
  SELECT u, min(v) AS component_id FROM reached GROUP BY u
), counted AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT r.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, r.vec_id = c.component_id AS kept
FROM rows r JOIN component c ON c.u = r.vec_id LEFT JOIN counted n ON n.u = r.vec_id
"""


def op10_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector of its label; odd vectors and those without a label are alone."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
