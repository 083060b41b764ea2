"""Column routing: switchboards over vectors, 2-D receptive fields, layers of operators, and 2-D convolution."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import Node, TrainingError, batch_udf


class Switchboard(Node):
    """y = x[connections]; invertible if the connections are a permutation."""

    def __init__(self, input_dim: int, connections: Sequence[int], column: str = "x"):
        super().__init__(column)
        self.input_dim, self.connections = int(input_dim), [int(c) for c in np.ravel(connections)]
        if any(c < 0 or c >= self.input_dim for c in self.connections):
            raise ValueError("a connection lies outside the input")

    def _column(self, x):
        return F.array(*[F.get(F.col(x), F.lit(c)) for c in self.connections])

    def _inverse_column(self, y):
        if sorted(self.connections) != list(range(self.input_dim)):
            raise TrainingError("the connections are no permutation")
        return F.array(*[F.get(F.col(y), F.lit(self.connections.index(i))) for i in range(self.input_dim)])


class MeanInverseSwitchboard(Switchboard):
    """The inverse is the mean of all outputs fed by an input; inputs without outputs become 0."""

    def _inverse_column(self, y):
        out = []
        for i in range(self.input_dim):
            at = [k for k, c in enumerate(self.connections) if c == i]
            s = F.lit(0.0)
            for k in at:
                s = s + F.get(F.col(y), F.lit(k))
            out.append(s / F.lit(float(len(at))) if at else F.lit(0.0))
        return F.array(*out)


class ChannelSwitchboard(Switchboard):
    """A switchboard whose inputs and outputs come in channels of several variables."""

    def __init__(self, input_dim: int, connections, out_channel_dim: int, in_channel_dim: int = 1, column: str = "x"):
        super().__init__(input_dim, connections, column)
        self.out_channel_dim, self.in_channel_dim = out_channel_dim, in_channel_dim
        self.output_channels = len(self.connections) // out_channel_dim

    def field(self, channel: int) -> list[int]:
        """The input variables of an output channel."""
        return self.connections[channel * self.out_channel_dim : (channel + 1) * self.out_channel_dim]

    def input_channels(self, channels: Sequence[int]) -> list[int]:
        return sorted({v // self.in_channel_dim for c in channels for v in self.field(c)})


def _pair(v) -> tuple[int, int]:
    return (v, v) if np.ndim(v) == 0 else (int(v[0]), int(v[1]))


class Rectangular2dSwitchboard(ChannelSwitchboard):
    """Rectangular fields of an x/y grid (x fastest) at a spacing; without ``ignore_cover`` they must cover the grid."""

    def __init__(self, in_channels_xy, field_channels_xy, field_spacing_xy=1, in_channel_dim: int = 1, ignore_cover: bool = False, column: str = "x"):
        (nx, ny), (fx, fy), (sx, sy) = _pair(in_channels_xy), _pair(field_channels_xy), _pair(field_spacing_xy)
        if fx > nx or fy > ny:
            raise ValueError("a field is larger than the grid")
        if not ignore_cover and ((nx - fx) % sx or (ny - fy) % sy or sx > fx or sy > fy):
            raise ValueError("the fields do not cover the grid")
        self.out_channels_xy = ((nx - fx) // sx + 1, (ny - fy) // sy + 1)
        out = [
            (y0 * sy + y) * nx * in_channel_dim + (x0 * sx + x) * in_channel_dim + k
            for y0 in range(self.out_channels_xy[1])
            for x0 in range(self.out_channels_xy[0])
            for y in range(fy)
            for x in range(fx)
            for k in range(in_channel_dim)
        ]
        super().__init__(nx * ny * in_channel_dim, out, fx * fy * in_channel_dim, in_channel_dim, column)


class DoubleRect2dSwitchboard(ChannelSwitchboard):
    """Two interleaved coverings by rectangular fields of even size; the second one lies half a field off.

    Fields come row by row: those of the first covering in one row, those of the second in the next.
    """

    def __init__(self, in_channels_xy, field_channels_xy, in_channel_dim: int = 1, ignore_cover: bool = False, column: str = "x"):
        (nx, ny), (fx, fy) = _pair(in_channels_xy), _pair(field_channels_xy)
        if fx % 2 or fy % 2:
            raise ValueError("fields must be even")
        if not ignore_cover and (nx % fx or ny % fy):
            raise ValueError("the fields do not cover the grid")
        long_x, long_y = nx // fx, ny // fy
        self.long_out_channels_xy = (long_x, long_y)
        out = []
        for row in range(2 * long_y - 1):
            shift = fx // 2 if row % 2 else 0
            y0 = row * fy // 2
            for i in range(long_x - (row % 2)):
                for y in range(fy):
                    for x in range(fx):
                        out += [((y0 + y) * nx + shift + i * fx + x) * in_channel_dim + k for k in range(in_channel_dim)]
        super().__init__(nx * ny * in_channel_dim, out, fx * fy * in_channel_dim, in_channel_dim, column)


class DoubleRhomb2dSwitchboard(ChannelSwitchboard):
    """Rhombic fields over the two interleaved grids that a double rectangular layer puts out.

    A field of diagonal ``d`` holds d × d channels: from its top corner, steps down-right along one side and
    down-left along the other. Input rows alternate between ``long_x`` and ``long_x − 1`` channels.
    """

    def __init__(self, long_in_channels_xy, diag_field_channels: int, in_channel_dim: int = 1, column: str = "x"):
        (lx, ly), d = _pair(long_in_channels_xy), diag_field_channels
        if d % 2:
            raise ValueError("the diagonal must be even")
        rows = [lx - (r % 2) for r in range(2 * ly - 1)]
        starts = np.concatenate([[0], np.cumsum(rows)])

        def channel(r: int, x2: int) -> int | None:
            """The channel at row r and horizontal position x2 in half steps."""
            i, odd = divmod(x2 - (r % 2), 2)
            return None if odd or not 0 <= r < len(rows) or not 0 <= i < rows[r] else int(starts[r]) + i

        # Along the two diagonals fields are d channels apart; of the possible offsets the one with most fields counts.
        found: dict[tuple[int, int], list[list[int]]] = {}
        for top in range(len(rows)):
            for x2 in range(top % 2, 2 * lx, 2):
                cells = [channel(top + a + b, x2 + a - b) for a in range(d) for b in range(d)]
                if None not in cells:
                    found.setdefault(((top + x2) // 2 % d, (top - x2) // 2 % d), []).append(cells)
        fields = max(found.values(), key=len, default=[])
        if not fields:
            raise ValueError("no field fits the grid")
        self.fields = fields
        out = [c * in_channel_dim + k for f in fields for c in f for k in range(in_channel_dim)]
        super().__init__(int(starts[-1]) * in_channel_dim, out, d * d * in_channel_dim, in_channel_dim, column)


def image_switchboard(image_size_xy, column: str = "x") -> Rectangular2dSwitchboard:
    """One field for each pixel."""
    return Rectangular2dSwitchboard(image_size_xy, 1, 1, column=column)


def next_switchboard(kind: type, previous: ChannelSwitchboard, channel_dim: int, **how) -> ChannelSwitchboard:
    """The switchboard that reads the output channels of the one before (each of ``channel_dim`` variables)."""
    if kind is DoubleRhomb2dSwitchboard:
        return kind(previous.long_out_channels_xy, in_channel_dim=channel_dim, **how)
    return kind(previous.out_channels_xy, in_channel_dim=channel_dim, **({"ignore_cover": True} | how))


class CoordinateTranslator:
    """index ↔ (row, column) ↔ (x, y) of an image, for columns or numbers."""

    def __init__(self, width: int, height: int):
        self.width, self.height = width, height

    def index_to_array(self, i):
        return (F.floor(i / self.width), i % self.width) if isinstance(i, Column) else (i // self.width, i % self.width)

    def array_to_index(self, row, col):
        return row * self.width + col

    def index_to_image(self, i):
        row, col = self.index_to_array(i)
        return col, row

    def image_to_index(self, x, y):
        return y * self.width + x

    def image_to_array(self, x, y):
        return y, x

    def array_to_image(self, row, col):
        return col, row


class Layer(Node):
    """Disjoint blocks of variables go to different operators; their outputs are joined."""

    trainable = True

    def __init__(self, nodes: Sequence[Node], dims: Sequence[int], column: str = "x"):
        super().__init__(column)
        self.nodes, self.dims = list(nodes), [int(d) for d in dims]

    def _block(self, i: int) -> Column:
        return F.slice(F.col(self.column), sum(self.dims[:i]) + 1, self.dims[i])

    def _each(self, df: DataFrame, of) -> DataFrame:
        out = df
        for i, node in enumerate(self.nodes):
            node.column = "n__"
            out = of(node, out.withColumn("n__", self._block(i))).withColumnRenamed("n__", f"o{i}__")
        joined = F.concat(*[F.col(f"o{i}__") for i in range(len(self.nodes))])
        return out.withColumn(self.column, joined).drop(*[f"o{i}__" for i in range(len(self.nodes))])

    def _fit(self, df):
        for i, node in enumerate(self.nodes):
            node.column = "n__"
            node.fit(df.withColumn("n__", self._block(i)))

    def transform(self, df):
        self._ready()
        return self._each(df, lambda node, d: node.transform(d))

    def inverse_transform(self, df):
        """Blocks of the outputs go back; each operator must keep its width or be told apart by ``output_dims``."""
        sizes = getattr(self, "output_dims", self.dims)
        out, at = df, 0
        for i, node in enumerate(self.nodes):
            node.column = "n__"
            out = node.inverse_transform(out.withColumn("n__", F.slice(F.col(self.column), at + 1, sizes[i]))).withColumnRenamed("n__", f"o{i}__")
            at += sizes[i]
        joined = F.concat(*[F.col(f"o{i}__") for i in range(len(self.nodes))])
        return out.withColumn(self.column, joined).drop(*[f"o{i}__" for i in range(len(self.nodes))])


class SameInputLayer(Layer):
    """All operators see the whole input; their outputs are joined."""

    def __init__(self, nodes: Sequence[Node], column: str = "x"):
        super().__init__(nodes, [0] * len(nodes), column)

    def _block(self, i):
        return F.col(self.column)


class CloneLayer(Layer):
    """One operator for all blocks: it is fitted on the rows of all blocks together."""

    def __init__(self, node: Node, n_nodes: int, dim: int, column: str = "x"):
        super().__init__([node] * n_nodes, [dim] * n_nodes, column)

    def _fit(self, df):
        node = self.nodes[0]
        node.column = "n__"
        node.fit(df.select(F.explode(F.array(*[self._block(i) for i in range(len(self.nodes))])).alias("n__")))


class Convolution2D(Node):
    """2-D convolution of image rows (flattened, or array of arrays) with k filters; modes valid, same and full.

    approach ``fft`` pads with zeros; ``linear`` honours the boundary: fill (with a value), wrap or symm.
    """

    def __init__(self, filters: np.ndarray, input_shape: tuple[int, int], approach: str = "fft", mode: str = "full", boundary: str = "fill", fillvalue: float = 0.0, column: str = "x"):
        super().__init__(column)
        self.filters = np.asarray(filters, float)
        if self.filters.ndim != 3 or mode not in ("valid", "same", "full") or boundary not in ("fill", "wrap", "symm") or approach not in ("fft", "linear"):
            raise ValueError("filters must be k × height × width; check approach, mode and boundary")
        self.input_shape, self.approach, self.mode, self.boundary, self.fillvalue = tuple(input_shape), approach, mode, boundary, fillvalue

    @property
    def output_shape(self) -> tuple[int, int]:
        (h, w), (a, b) = self.input_shape, self.filters.shape[1:]
        return {"full": (h + a - 1, w + b - 1), "same": (h, w), "valid": (h - a + 1, w - b + 1)}[self.mode]

    def convolve(self, images: np.ndarray) -> np.ndarray:
        (h, w), (a, b) = self.input_shape, self.filters.shape[1:]
        if self.approach == "fft":
            size = (h + a - 1, w + b - 1)
            full = np.fft.irfft2(np.fft.rfft2(images, size)[:, None] * np.fft.rfft2(self.filters, size)[None], size)
        else:
            how = {"fill": {"mode": "constant", "constant_values": self.fillvalue}, "wrap": {"mode": "wrap"}, "symm": {"mode": "symmetric"}}[self.boundary]
            padded = np.pad(images, ((0, 0), (a - 1, a - 1), (b - 1, b - 1)), **how)
            windows = np.lib.stride_tricks.sliding_window_view(padded, (a, b), (1, 2))
            full = np.einsum("nijab,kab->nkij", windows, self.filters[:, ::-1, ::-1])
        if self.mode == "same":
            r, c = (a - 1) // 2, (b - 1) // 2
            full = full[:, :, r : r + h, c : c + w]
        elif self.mode == "valid":
            full = full[:, :, a - 1 : h, b - 1 : w]
        return full

    def _column(self, x):
        shape = self.input_shape
        return batch_udf(lambda m: self.convolve(m.reshape(len(m), *shape)).reshape(len(m), -1))(F.col(x))


def gradient(nodes: Sequence[Node], x: np.ndarray) -> np.ndarray:
    """Jacobian of a chain of fitted operators at one point, by the chain rule of central differences of each."""
    from ..functions.local import apply_locally

    jac, point = np.eye(len(x)), np.asarray(x, float)
    for node in nodes:
        step = 1e-5
        both = np.concatenate([point + step * np.eye(len(point)), point - step * np.eye(len(point)), point[None]])
        out = apply_locally(node, both)
        n = len(point)
        jac = ((out[:n] - out[n : 2 * n]) / (2 * step)).T @ jac
        point = out[-1]
    return jac
