"""A one-factor state-space model of a panel, by EM, with Kalman filter and smoother as associative scans over time.

Rows are periods; a block of BLOCK successive periods is one row of a written table. What a run of periods does to the state is an
element that joins with the next run's in any bracketing, so a task reduces its block to one element; those (a few numbers a block) are
joined on the driver and tell each block in which state it begins. The smoother's elements are joined the same way from the end. So a
round of EM is three passes in which no task waits for another's periods, whatever the length of the series; inside a block the scan is
made in as many steps as its length has bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from .sampling import numbered

#: Periods of a block.
BLOCK = 4096


@dataclass
class Model:
    """y = loadings * f + noise; f follows its own last two values with innovations of variance 1, from a standard normal start."""

    loadings: np.ndarray
    noise: np.ndarray
    ar: np.ndarray

    @property
    def step(self) -> np.ndarray:
        return np.array([[self.ar[0], self.ar[1]], [1.0, 0.0]])


_Q = np.diag([1.0, 1e-9])  # the second state is a copy of the first: a trace of noise keeps matrices regular
_I = np.eye(2)


def _t(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def forward(a, b):
    """The element of a run of periods followed by another's: (A, b, C, eta, J), each with a leading axis."""
    a1, b1, c1, e1, j1 = a
    a2, b2, c2, e2, j2 = b
    m = np.linalg.inv(_I + c1 @ j2)
    n = np.linalg.inv(_I + j2 @ c1)
    v = lambda x, y: (x @ y[..., None])[..., 0]
    return a2 @ m @ a1, v(a2 @ m, b1 + v(c1, e2)) + b2, a2 @ m @ c1 @ _t(a2) + c2, v(_t(a1) @ n, e2 - v(j2, b1)) + e1, _t(a1) @ n @ j2 @ a1 + j1


def backward(a, b):
    """The smoother's element (E, g, L) of a run of periods followed by another's."""
    e1, g1, l1 = a
    e2, g2, l2 = b
    return e1 @ e2, (e1 @ g2[..., None])[..., 0] + g1, e1 @ l2 @ _t(e1) + l1


def scan(elements: tuple, join, reverse: bool = False) -> tuple:
    """What the elements up to each one amount to (from each one to the end, if reversed), in about log2 of their number steps."""
    parts = tuple(x[::-1] for x in elements) if reverse else elements
    n, d = len(parts[0]), 1
    while d < n:
        early, late = tuple(x[:-d] for x in parts), tuple(x[d:] for x in parts)
        joined = join(late, early) if reverse else join(early, late)
        parts = tuple(np.concatenate([x[:d], y]) for x, y in zip(parts, joined, strict=True))
        d *= 2
    return tuple(x[::-1] for x in parts) if reverse else parts


def elements(y: np.ndarray, model: Model) -> tuple:
    """The filter's element of each period."""
    h = np.c_[model.loadings, np.zeros(len(model.loadings))]
    f = model.step
    s = np.linalg.inv(h @ _Q @ h.T + np.diag(model.noise))
    k = _Q @ h.T @ s
    n = len(y)
    each = lambda x: np.broadcast_to(x, (n, *x.shape)).copy()
    return each((_I - k @ h) @ f), y @ k.T, each((_I - k @ h) @ _Q), y @ (f.T @ h.T @ s).T, each(f.T @ h.T @ s @ h @ f)


def start() -> tuple:
    """The element of what is known before the first period."""
    return np.zeros((1, 2, 2)), np.zeros((1, 2)), _I[None].copy(), np.zeros((1, 2)), np.zeros((1, 2, 2))


def _one(parts: tuple, k: int) -> tuple:
    """The k-th of some elements, as elements."""
    return tuple(x[k:][:1] for x in parts)


def filtered(y: np.ndarray, model: Model, before: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the state after each period, given the element of all periods before the block."""
    run = scan(tuple(np.concatenate([p, e]) for p, e in zip(before, elements(y, model), strict=True)), forward)
    return run[1][1:], run[2][1:]


def smoothing(m: np.ndarray, p: np.ndarray, model: Model, last: bool) -> tuple:
    """The smoother's element of each period; `last` says whether the series ends here."""
    f = model.step
    ahead = f @ p @ f.T + _Q
    e = p @ f.T @ np.linalg.inv(ahead)
    g = m - (e @ (m @ f.T)[..., None])[..., 0]
    spread = p - e @ ahead @ _t(e)
    if last:
        e[-1], g[-1], spread[-1] = 0.0, m[-1], p[-1]
    return e, g, spread


def _expectations(y: np.ndarray, model: Model, before: tuple, after: tuple | None, first: bool):
    """Smoothed means of the block and the sums that the next model needs: y f, f f, y y, (s s') of the state before, f s' of both."""
    m, p = filtered(y, model, before)
    if first:  # the state before the first period belongs to the smoothed ones too
        m, p = np.r_[np.zeros((1, 2)), m], np.concatenate([_I[None], p])
    e, g, spread = smoothing(m, p, model, after is None)
    parts = (e, g, spread) if after is None else tuple(np.concatenate([x, z]) for x, z in zip((e, g, spread), after, strict=True))
    _, sm, sp = scan(parts, backward, True)
    n = len(m)
    own_m, own_p = sm[:n], sp[:n]
    second = own_p + own_m[:, :, None] * own_m[:, None]
    f_m, f_s = (own_m[1:], second[1:]) if first else (own_m, second)
    # pairs of successive states: from each one of this block to the next, which may be the next block's first
    pairs = len(sm) - 1
    lag = e[:pairs] @ sp[1 : pairs + 1]  # covariance of a state with the next
    both = _t(lag) + sm[1 : pairs + 1, :, None] * sm[:pairs, None]
    sums = {"yf": y.T @ f_m[:, 0], "ff": f_s[:, 0, 0].sum(), "yy": (y * y).sum(0), "before": second[:pairs].sum(0), "with": both[:, 0].sum(0), "n": len(y)}
    return f_m[:, 0], sums


def dynamic_factor(panel: DataFrame, key: str, columns: list[str], sign: str, rounds: int = 60, tolerance: float = 1e-4) -> tuple[DataFrame, Model]:
    """key and factor (smoothed, turned so that it goes with `sign`), and the model of the standardised columns; periods without all
    columns are left out."""
    spark = panel.sparkSession
    known = panel.dropna(subset=columns)
    s = known.agg(*(f(c).alias(f"{n}{k}") for k, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_samp)))).first()
    z = F.array(*((F.col(c).cast("double") - F.lit(float(s[f"m{k}"] or 0.0))) / F.lit(float(s[f"s{k}"] or 1.0)) for k, c in enumerate(columns)))
    placed = numbered(known.select(key, z.alias("z")), key, [F.col(key)], ["z"])
    block = F.floor((F.col("number") - 1) / BLOCK)
    blocks = saved(placed.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("number", key, "z"))).alias("rows")).coalesce(max(1, spark.sparkContext.defaultParallelism)), "factor-blocks")
    c = len(columns)
    import pyarrow as pa

    def unpack(batch):
        ends = batch.column("rows").offsets.to_pylist()
        inner = batch.column("rows").values
        for k, b in enumerate(batch.column("block").to_pylist()):
            part = inner.slice(ends[k], ends[k + 1] - ends[k])
            lists = part.field("z")
            yield b, part, np.asarray(lists.flatten(), float).reshape(len(part), c)

    def each_block(fn, schema):
        def run(batches):
            for batch in batches:
                made = [fn(*b) for b in unpack(batch)]
                yield pa.RecordBatch.from_pylist([r for rows in made for r in rows], schema=pa.schema(schema))

        return run

    wire = [("block", pa.int64()), ("x", pa.binary())]

    def collected(fn) -> dict[int, bytes]:
        """A few numbers a block."""
        return {r.block: r.x for r in blocks.mapInArrow(each_block(fn, wire), "block long, x binary").collect()}

    def packed(element: tuple) -> bytes:
        return np.concatenate([x.ravel() for x in element]).tobytes()

    def unpacked(raw: bytes, shapes: tuple) -> tuple:
        flat, out, at = np.frombuffer(raw), [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            out.append(flat[at : at + size].reshape(1, *shape))
            at += size
        return tuple(out)

    fore, back = ((2, 2), (2,), (2, 2), (2,), (2, 2)), ((2, 2), (2,), (2, 2))

    def passes(model: Model):
        """What comes before and after each block under a model."""
        own = collected(lambda b, part, y: [{"block": b, "x": packed(_one(scan(elements(y, model), forward), -1))}])
        order = sorted(own)
        before, now = {}, start()
        for b in order:
            before[b] = now
            now = forward(now, unpacked(own[b], fore))

        def smoother(b, part, y):
            m, p = filtered(y, model, before[b])
            return [{"block": b, "x": packed(_one(scan(smoothing(m, p, model, b == order[-1]), backward, True), 0))}]

        own = collected(smoother) if len(order) > 1 else {b: b"" for b in order}
        after, then = {}, None
        for b in reversed(order):
            after[b] = then
            if b != order[0]:
                mine = unpacked(own[b], back)
                then = mine if then is None else backward(mine, then)
        return before, after, order

    model = Model(np.full(c, 0.5), np.full(c, 0.5), np.array([0.5, 0.0]))
    state = passes(model) if c else ({}, {}, [])
    for _ in range(rounds if state[2] else 0):
        before, after, order = state

        def expect(b, part, y, before=before, after=after, order=order, model=model):
            s = _expectations(y, model, before[b], after[b], b == order[0])[1]
            return [{"block": b, "x": np.r_[s["yf"], s["ff"], s["yy"], s["before"].ravel(), s["with"], s["n"]].tobytes()}]

        t = np.sum([np.frombuffer(x) for x in collected(expect).values()], axis=0)
        yf, ff, yy, was, both, n = t[:c], t[c], t[c + 1 : 2 * c + 1], t[2 * c + 1 : 2 * c + 5].reshape(2, 2), t[2 * c + 5 : 2 * c + 7], t[-1]
        loadings = yf / ff
        new = Model(loadings, np.maximum((yy - loadings * yf) / n, 1e-6), np.linalg.solve(was + 1e-12 * _I, both))
        moved = max(np.abs(new.loadings - model.loadings).max(), np.abs(new.noise - model.noise).max(), np.abs(new.ar - model.ar).max())
        model, state = new, passes(new)
        if moved < tolerance:
            break
    turn = -1.0 if c and model.loadings[columns.index(sign)] < 0 else 1.0
    before, after, order = state
    def smooth(batches):
        for batch in batches:
            for b, part, y in unpack(batch):
                f = _expectations(y, model, before[b], after[b], b == order[0])[0]
                yield pa.RecordBatch.from_arrays([part.field(key), pa.array(turn * f)], names=[key, "factor"])

    return blocks.mapInArrow(smooth, f"{key} {panel.schema[key].dataType.simpleString()}, factor double"), Model(turn * model.loadings, model.noise, model.ar)


def wave_check(panel: DataFrame, key: str, columns: list[str], sign: str) -> DataFrame:
    """column, loading, noise, ar1, ar2, r (of the smoothed factor with the first component), n: the dynamic factor beside the component."""
    from .inference import first_component

    factor, model = dynamic_factor(panel, key, columns, sign)
    r = factor.join(first_component(panel, key, columns, sign), key).agg(F.corr("factor", "wave").alias("r"), F.count("*").alias("n"))
    told = panel.sparkSession.createDataFrame([(c, float(a), float(b), *map(float, model.ar)) for c, a, b in zip(columns, model.loadings, model.noise, strict=True)], "column string, loading double, noise double, ar1 double, ar2 double")
    return told.crossJoin(F.broadcast(r))  # one row
