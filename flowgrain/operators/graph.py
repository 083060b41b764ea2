"""Directed multigraphs: a driver-side class for networks of operators, and edge tables for large graphs."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GraphError(Exception):
    pass


@dataclass(eq=False)
class GraphNode:
    data: object = None
    edges_in: list = field(default_factory=list)
    edges_out: list = field(default_factory=list)

    def in_neighbors(self) -> list[GraphNode]:
        return [e.head for e in self.edges_in]

    def out_neighbors(self) -> list[GraphNode]:
        return [e.tail for e in self.edges_out]

    def neighbors(self) -> list[GraphNode]:
        return self.in_neighbors() + self.out_neighbors()

    @property
    def degree(self) -> int:
        return len(self.edges_in) + len(self.edges_out)


@dataclass(eq=False)
class GraphEdge:
    """An edge from ``head`` to ``tail``."""

    head: GraphNode
    tail: GraphNode
    data: object = None


class Graph:
    def __init__(self):
        self.nodes: list[GraphNode] = []
        self.edges: list[GraphEdge] = []

    def add_node(self, data=None) -> GraphNode:
        self.nodes.append(GraphNode(data))
        return self.nodes[-1]

    def add_edge(self, head: GraphNode, tail: GraphNode, data=None) -> GraphEdge:
        e = GraphEdge(head, tail, data)
        head.edges_out.append(e)
        tail.edges_in.append(e)
        self.edges.append(e)
        return e

    def remove_edge(self, e: GraphEdge) -> None:
        e.head.edges_out.remove(e)
        e.tail.edges_in.remove(e)
        self.edges.remove(e)

    def remove_node(self, n: GraphNode) -> None:
        for e in [*n.edges_in, *n.edges_out]:
            if e in self.edges:
                self.remove_edge(e)
        self.nodes.remove(n)

    def add_tree(self, tree) -> GraphNode:
        """Nested lists: the first element is the root's data, the others are subtrees or leaves."""
        root, *rest = tree if isinstance(tree, (list, tuple)) else [tree]
        node = self.add_node(root)
        for t in rest:
            self.add_edge(node, self.add_tree(t))
        return node

    def add_full_connectivity(self, heads, tails) -> None:
        for h in heads:
            for t in tails:
                self.add_edge(h, t)

    def topological_sort(self) -> list[GraphNode]:
        """First in, first out among the nodes without open predecessors; raises on a cycle."""
        left = {id(n): len(n.edges_in) for n in self.nodes}
        queue, out = deque(n for n in self.nodes if not left[id(n)]), []
        while queue:
            n = queue.popleft()
            out.append(n)
            for m in n.out_neighbors():
                left[id(m)] -= 1
                if not left[id(m)]:
                    queue.append(m)
        if len(out) < len(self.nodes):
            raise GraphError("the graph has a cycle")
        return out

    def _search(self, root: GraphNode, near: Callable, last_first: bool, visit=None) -> list[GraphNode]:
        seen, queue, out = {id(root)}, deque([root]), []
        while queue:
            n = queue.pop() if last_first else queue.popleft()
            out.append(n)
            if visit:
                visit(n)
            for m in near(n):
                if id(m) not in seen:
                    seen.add(id(m))
                    queue.append(m)
        return out

    def dfs(self, root, visit=None):
        return self._search(root, GraphNode.out_neighbors, True, visit)

    def undirected_dfs(self, root, visit=None):
        return self._search(root, GraphNode.neighbors, True, visit)

    def bfs(self, root, visit=None):
        return self._search(root, GraphNode.out_neighbors, False, visit)

    def undirected_bfs(self, root, visit=None):
        return self._search(root, GraphNode.neighbors, False, visit)

    def connected_components(self) -> list[list[GraphNode]]:
        seen, out = set(), []
        for n in self.nodes:
            if id(n) not in seen:
                part = self.undirected_dfs(n)
                seen |= {id(m) for m in part}
                out.append(part)
        return out

    def is_weakly_connected(self) -> bool:
        return len(self.connected_components()) <= 1


def component_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) of every node of a table (id) under edges (src, dst), the component being its smallest id.

    Minimum labels spread over the edges, and jump to the label's own label, until nothing changes; raises if ``rounds`` don't do.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().persist()
    labels, before = nodes.select("id", F.col("id").alias("component")).distinct(), None
    for _ in range(rounds):
        heard = both.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("component").alias("m"))
        new = labels.join(heard, F.col("id") == F.col("src"), "left").select("id", "component", F.least("component", F.coalesce("m", "component")).alias("m"))
        up = new.select(F.col("id").alias("i"), F.col("m").alias("mm"))
        new = new.join(up, F.col("m") == F.col("i"), "left").select("id", "component", F.least("m", F.coalesce("mm", "m")).alias("m")).persist()
        changed = new.where("m <> component").count()
        labels = new.select("id", F.col("m").alias("component"))
        if before is not None:
            before.unpersist()
        before = new
        if not changed:
            both.unpersist()
            return labels
    raise GraphError(f"components did not settle in {rounds} rounds")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level): the length of the longest path that ends at a node; raises on a cycle."""
    levels = nodes.select("id", F.lit(0).alias("level")).distinct()
    for _ in range(nodes.count() + 1):
        pushed = edges.join(levels, F.col("src") == F.col("id")).groupBy("dst").agg((F.max("level") + 1).alias("l"))
        new = levels.join(pushed, F.col("id") == F.col("dst"), "left").select("id", "level", F.greatest("level", F.coalesce("l", F.lit(0))).alias("l")).persist()
        changed = new.where("l <> level").limit(1).count()
        levels = new.select("id", F.col("l").alias("level"))
        if not changed:
            return levels
    raise GraphError("the graph has a cycle")
