"""Pipelines: linear flows with training stage by stage, checkpoints, inverse, message passing, caching, extensions."""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame

from ..core import Node, TrainingError


class FlowError(Exception):
    pass


class Flow(Node):
    """Operators one after the other; each is fitted on the output of those before. A flow is an operator itself.

    ``fit`` takes one DataFrame for all, or one for each operator (None for those that need no training). Where one
    frame serves all, the output of a fitted prefix is persisted once instead of being computed again for each stage.
    """

    trainable = True

    def __init__(self, nodes: Sequence[Node], column: str = "x"):
        super().__init__(column)
        self.nodes = list(nodes)

    def fit(self, data, checkpoints: Sequence[Callable] | Callable | None = None):
        frames = data if isinstance(data, (list, tuple)) else None
        if frames is not None and len(frames) != len(self.nodes):
            raise FlowError(f"{len(frames)} frames for {len(self.nodes)} operators")
        rows, held = data, []
        for i, node in enumerate(self.nodes):
            if frames is not None:
                rows = frames[i]
                if rows is not None:
                    for before in self.nodes[:i]:
                        rows = before.transform(rows)
            if node.trainable and not node.fitted or isinstance(node, Flow):
                if rows is None:
                    raise FlowError(f"operator {i} ({type(node).__name__}) needs training data")
                if frames is None and i:
                    rows = rows.persist()
                    held.append(rows)
                try:
                    node.fit(rows)
                except Exception as e:
                    raise FlowError(f"operator {i} ({type(node).__name__}) failed: {e}") from e
            if checkpoints is not None:
                call = checkpoints[i] if isinstance(checkpoints, (list, tuple)) else checkpoints
                got = call(node) if call else None
                if isinstance(got, dict):
                    self.__dict__.update(got)
            if frames is None and i + 1 < len(self.nodes):
                rows = node.transform(rows)
        for r in held:
            r.unpersist()
        self.fitted = True
        return self

    def transform(self, df: DataFrame, upto: int | None = None) -> DataFrame:
        for node in self.nodes[: None if upto is None else upto + 1]:
            df = node.transform(df)
        return df

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for node in reversed(self.nodes):
            df = node.inverse_transform(df)
        return df

    def __add__(self, other):
        return Flow(self.nodes + (other.nodes if isinstance(other, Flow) else [other]), self.column)

    def __len__(self) -> int:
        return len(self.nodes)

    def __getitem__(self, key):
        return Flow(self.nodes[key], self.column) if isinstance(key, slice) else self.nodes[key]

    def append(self, node: Node) -> None:
        self.nodes.append(node)

    def extend(self, nodes) -> None:
        self.nodes += list(nodes)

    def insert(self, i: int, node: Node) -> None:
        self.nodes.insert(i, node)

    def pop(self, i: int = -1) -> Node:
        return self.nodes.pop(i)

    def describe(self) -> str:
        """A small HTML page of the flow's operators and their settings."""
        rows = "".join(f"<tr><td>{i}</td><td>{type(n).__name__}</td><td>{html.escape(str({k: v for k, v in vars(n).items() if isinstance(v, (int, float, str, bool)) or v is None}))}</td></tr>" for i, n in enumerate(self.nodes))
        return f"<!DOCTYPE html><html><head><title>flow</title></head><body><table>{rows}</table></body></html>"


def checkpoint_to(path: str, suffix: str = ".json") -> Callable[[Node], None]:
    """A checkpoint function that saves each operator once it is fitted: path + position + suffix."""
    count = iter(range(1 << 30))

    def save(node: Node) -> None:
        node.save(f"{path}{next(count)}{suffix}")

    return save


class MessageNode:
    """An operator in a message flow: ``run(df, message)`` returns df, (df, message) or (df, message, target).

    A target is the id of another operator or a relative jump; messages are dicts whose keys may be addressed to one
    operator as ``id->key``.
    """

    def __init__(self, node: Node | None = None, node_id: str | None = None, run: Callable | None = None):
        self.node, self.node_id, self._run = node, node_id, run

    def run(self, df: DataFrame, message: dict):
        if self._run:
            return self._run(df, message)
        return self.node.transform(df)


class Sender(MessageNode):
    """Puts its input as ``recipient->x`` into the message."""

    def __init__(self, recipient: str, node_id: str | None = None):
        super().__init__(None, node_id, lambda df, m: (df, {f"{recipient}->x": df}))


class MessageFlow:
    """Runs operators in order or along the targets that they name; returns the last frame and the message."""

    def __init__(self, nodes: Sequence[MessageNode]):
        self.nodes = list(nodes)
        self.ids = {n.node_id: i for i, n in enumerate(nodes) if n.node_id}

    def fit(self, df: DataFrame) -> MessageFlow:
        for n in self.nodes:
            if n.node is not None:
                n.node.fit(df)
                df = n.node.transform(df)
        return self

    def _position(self, at: int, target) -> int:
        if isinstance(target, str):
            if target not in self.ids:
                raise FlowError(f"no operator has the id {target}")
            return self.ids[target]
        return at + target

    def execute(self, df: DataFrame, message: dict | None = None, target: str | int | None = None, most_steps: int = 10_000) -> tuple[DataFrame, dict]:
        message = dict(message or {})
        at = 0 if target is None else self._position(0, target)
        for _ in range(most_steps):
            if not 0 <= at < len(self.nodes):
                return df, message
            node = self.nodes[at]
            own = {k.split("->", 1)[1]: v for k, v in message.items() if "->" in k and k.split("->", 1)[0] == node.node_id}
            message = {k: v for k, v in message.items() if "->" not in k or k.split("->", 1)[0] != node.node_id}
            got = node.run(df, {k: v for k, v in message.items() if "->" not in k} | own)
            step = 1
            if isinstance(got, tuple):
                df, new, *rest = got
                message |= new or {}
                if rest and rest[0] is not None:
                    at = self._position(at, rest[0])
                    continue
            else:
                df = got
            at += step
        raise FlowError("the message flow does not end")


class CachePolicy:
    """Which operators' outputs are persisted: all, some classes, or some instances."""

    def __init__(self):
        self.active, self.classes, self.instances, self.held = False, None, None, {}

    def activate(self, classes=None, instances=None) -> None:
        self.active, self.classes, self.instances = True, classes, instances

    def deactivate(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.active, self.held = False, {}

    def wants(self, node: Node) -> bool:
        if not self.active:
            return False
        if self.classes is None and self.instances is None:
            return True
        return bool(self.classes and isinstance(node, tuple(self.classes))) or bool(self.instances and any(node is i for i in self.instances))

    def transform(self, node: Node, df: DataFrame) -> DataFrame:
        if not self.wants(node):
            return node.transform(df)
        key = (id(node), df.semanticHash())
        if key not in self.held:
            self.held[key] = node.transform(df).persist()
        return self.held[key]

    @contextmanager
    def cached(self, classes=None, instances=None):
        self.activate(classes, instances)
        try:
            yield self
        finally:
            self.deactivate()


class Extensions:
    """Methods that are added to operators by name while an extension is active."""

    def __init__(self):
        self.known: dict[str, dict[tuple[type, str], Callable]] = {}
        self.active: dict[str, dict] = {}
        self.hooks: dict[tuple[str, str], Callable] = {}

    def method(self, extension: str, cls: type, name: str | None = None):
        def add(f):
            key = (cls, name or f.__name__)
            if key in self.known.setdefault(extension, {}):
                raise FlowError(f"{extension} has {key} already")
            self.known[extension][key] = f
            return f

        return add

    def setup(self, extension: str):
        return lambda f: self.hooks.setdefault((extension, "setup"), f)

    def teardown(self, extension: str):
        return lambda f: self.hooks.setdefault((extension, "teardown"), f)

    def activate(self, *names: str) -> None:
        for n in names:
            if n in self.active:
                continue
            taken = {k for other in self.active.values() for k in other}
            clash = taken & set(self.known.get(n, {}))
            if clash:
                raise FlowError(f"extensions clash on {sorted(k[1] for k in clash)}")
            self.hooks.get((n, "setup"), lambda: None)()
            saved = {}
            for (cls, name), f in self.known.get(n, {}).items():
                saved[cls, name] = cls.__dict__.get(name)
                setattr(cls, name, f)
            self.active[n] = saved

    def deactivate(self, *names: str) -> None:
        for n in names:
            for (cls, name), old in self.active.pop(n, {}).items():
                if old is None:
                    delattr(cls, name)
                else:
                    setattr(cls, name, old)
            self.hooks.get((n, "teardown"), lambda: None)()

    @contextmanager
    def use(self, *names: str):
        before = set(self.active)
        self.activate(*names)
        try:
            yield self
        finally:
            self.deactivate(*[n for n in names if n not in before])


extensions, cache = Extensions(), CachePolicy()


def save_flow(flow: Flow, path: str) -> None:
    Path(path).write_text(json.dumps(flow.state()))


def load_flow(path: str) -> Flow:
    flow = Node.load(path)
    if not isinstance(flow, Flow):
        raise TrainingError(f"{path} holds no flow")
    return flow


def trace(flow: Flow, df: DataFrame) -> list[dict]:
    """For each operator its name, its output's schema and the plan by which Spark would compute it."""
    out = []
    for node in flow.nodes:
        df = node.transform(df)
        out.append({"operator": type(node).__name__, "columns": df.dtypes, "plan": df._jdf.queryExecution().simpleString()})
    return out
