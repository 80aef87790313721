"""Columns worked out by walking each series in order: ranks, quantiles and decayed means.

A window function that hands every row its whole frame costs the frame's length per row. Here a series is walked
once: values enter and leave a sorted structure, and each row asks it for counts and places, in logarithmic time.
``rolling`` hands out placeholders for such columns; ``with_columns`` finds the ones that a set of expressions
uses and works them all out in one Arrow pass per axis, shipping only their input columns."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right, insort
from collections import deque
from dataclasses import dataclass
from typing import Iterator, Tuple  # the forms that pandas_udf reads

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.axis import Axis

_PLACEHOLDER = re.compile(r"_walk_[0-9a-f]{16}")


@dataclass(frozen=True)
class Ask:
    """One column: ``kind`` of the value of ``column`` (a name or SQL expression) in the frame of rows first..last,
    relative to the row (first None: from the start of the series), with ``args`` of the kind."""

    kind: str
    column: str
    first: int | None
    last: int
    args: tuple[float, ...] = ()


_ASKED: dict[str, tuple[Ask, Axis]] = {}  # placeholder -> what it stands for


def ask(what: Ask, ax: Axis) -> Column:
    """A placeholder column; it has a value once ``with_columns`` has seen it."""
    name = "_walk_" + hashlib.md5(repr((what, ax)).encode()).hexdigest()[:16]
    _ASKED[name] = (what, ax)
    return F.col(name)


class OrderWindow:
    """Numbers in sorted blocks with a Fenwick tree over the blocks' sizes: adding, removing, counting below and
    finding the k-th take logarithmic time, with short moves inside a block."""

    __slots__ = ("blocks", "tops", "tree", "n", "most")

    def __init__(self, most: int = 512):
        self.blocks, self.tops, self.tree, self.n, self.most = [], [], [0], 0, most

    def _retree(self) -> None:
        t = [0, *map(len, self.blocks)]
        for i in range(1, len(t)):
            up = i + (i & -i)
            if up < len(t):
                t[up] += t[i]
        self.tree = t

    def _change(self, block: int, by: int) -> None:
        i, t = block + 1, self.tree
        while i < len(t):
            t[i] += by
            i += i & -i

    def _before(self, block: int) -> int:
        total, t = 0, self.tree
        while block > 0:
            total += t[block]
            block -= block & -block
        return total

    def add(self, x: float) -> None:
        self.n += 1
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            self._retree()
            return
        b = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        own = self.blocks[b]
        insort(own, x)
        if len(own) > self.most:
            half = len(own) // 2
            self.blocks[b : b + 1] = [own[:half], own[half:]]
            self.tops[b : b + 1] = [own[half - 1], own[-1]]
            self._retree()
        else:
            self.tops[b] = own[-1]
            self._change(b, 1)

    def remove(self, x: float) -> None:
        b = bisect_left(self.tops, x)
        own = self.blocks[b]
        del own[bisect_left(own, x)]
        self.n -= 1
        if own:
            self.tops[b] = own[-1]
            self._change(b, -1)
        else:
            del self.blocks[b], self.tops[b]
            self._retree()

    def below(self, x: float) -> int:
        b = bisect_left(self.tops, x)
        return self.n if b == len(self.tops) else self._before(b) + bisect_left(self.blocks[b], x)

    def upto(self, x: float) -> int:
        b = bisect_right(self.tops, x)
        return self.n if b == len(self.tops) else self._before(b) + bisect_right(self.blocks[b], x)

    def kth(self, k: int) -> float:
        at, t, step = 0, self.tree, 1 << (len(self.tree).bit_length() - 1)
        while step:
            if at + step < len(t) and t[at + step] <= k:
                at += step
                k -= t[at]
            step >>= 1
        return self.blocks[at][k]


def _rank(w: OrderWindow, x, need):
    if x is None or w.n < need:
        return None
    low = w.below(x)
    return (low + (w.upto(x) - low + 1) / 2) / w.n


def _below(w: OrderWindow, x, need, scale):
    return None if x is None or w.n < max(need, 1) else w.below(x) / w.n * scale


def _quantile(w: OrderWindow, x, q, need):
    if w.n < max(need, 1):
        return None
    at = (w.n - 1) * q
    lo = math.floor(at)
    first = w.kth(lo)
    if lo == at:
        return first
    second = w.kth(lo + 1)
    return first if first == second else (lo + 1 - at) * first + (at - lo) * second


_KINDS = {"rank": _rank, "below": _below, "quantile": _quantile}


class _Sorted:
    """A frame of a column, with all that is asked of it."""

    def __init__(self, first: int | None, last: int, asks: list[Ask]):
        self.rows = None if first is None else last - first + 1
        self.late = last == -1  # the row itself is not in its frame
        self.asks = [(_KINDS[a.kind], a.args) for a in asks]
        self.window, self.held = OrderWindow(), deque()

    def _enter(self, x) -> None:
        if x is not None:
            self.window.add(x)
        if self.rows is not None:
            self.held.append(x)
            if len(self.held) > self.rows:
                gone = self.held.popleft()
                if gone is not None:
                    self.window.remove(gone)

    def walk(self, values: list) -> list[list]:
        out = [[] for _ in self.asks]
        for x in values:
            if not self.late:
                self._enter(x)
            for o, (fn, args) in zip(out, self.asks):
                o.append(fn(self.window, x, *args))
            if self.late:
                self._enter(x)
        return out


class _Decayed:
    """Sum and weight of the values, each row's a fixed share of the next one's: plain recursion, nothing is cut off."""

    def __init__(self, asks: list[Ask]):
        self.part = [a.kind for a in asks]
        self.keep = 1.0 - 2.0 / (asks[0].args[0] + 1.0)
        self.num = self.den = 0.0
        self.gap, self.row, self.at = 0, -1, None

    def walk(self, values: list) -> list[list]:
        out = [[] for _ in self.part]
        for x in values:
            self.gap += 1
            self.row += 1
            if x is not None:
                fade = self.keep**self.gap
                self.num, self.den, self.gap, self.at = self.num * fade + x, self.den * fade + 1.0, 0, self.row
            seen = self.den > 0
            now = {"ewm": self.num / self.den if seen else None, "ewm_sum": self.num if seen else None, "ewm_weight": self.den if seen else None, "ewm_row": self.at}
            for o, part in zip(out, self.part):
                o.append(now[part])
        return out


def _walker(key: tuple, asks: list[Ask]):
    return _Decayed(asks) if key[0] == "ewm" else _Sorted(key[2], key[3], asks)


def _numbers(x: pd.Series) -> list:
    """Nulls as None. Spark's doubles arrive with null as NaN; a NaN of the data cannot be told from it."""
    v = x.to_numpy(np.float64, na_value=np.nan)
    out = v.tolist()
    for i in np.flatnonzero(np.isnan(v)).tolist():
        out[i] = None
    return out


def _pass(inputs: list[str], asks: list[Ask]):
    """A function of a row number and the inputs that walks the rows of a partition, series by series."""
    groups: dict[tuple, list[int]] = {}
    for i, a in enumerate(asks):
        key = ("ewm", a.column, a.args) if a.kind.startswith("ewm") else ("order", a.column, a.first, a.last)
        groups.setdefault(key, []).append(i)
    fields = [f"w{i}" for i in range(len(asks))]

    def walk(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        walkers, at = {}, None
        for number, *cols in batches:
            n = number.to_numpy()
            values = {c: _numbers(x) for c, x in zip(inputs, cols)}
            cut = [0, *(np.flatnonzero(n[1:] != n[:-1] + 1) + 1).tolist(), len(n)]
            out: list[list] = [[] for _ in asks]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if n[lo] == 1:
                    walkers = {key: _walker(key, [asks[i] for i in members]) for key, members in groups.items()}
                elif n[lo] != (at or 0) + 1:
                    raise RuntimeError("rows of a series did not arrive in order")
                at = int(n[hi - 1])
                for key, members in groups.items():
                    for i, got in zip(members, walkers[key].walk(values[key[1]][lo:hi])):
                        out[i] += got
            yield pd.DataFrame({f: np.array(o, np.float64) for f, o in zip(fields, out)})

    return walk, ", ".join(f"{f} double" for f in fields)


def walked(df: DataFrame, columns: dict[str, Ask], ax: Axis) -> DataFrame:
    """``df`` with the asked columns, in one pass over its series in order.

    Rows are numbered by a window over the axis, which is also what brings a series into one sorted stream; the
    pass checks the numbers. Only the numbers and the inputs go to Python."""
    asks = list(columns.values())
    inputs = list(dict.fromkeys(a.column for a in asks))
    walk, shape = _pass(inputs, asks)
    fn = F.pandas_udf(walk, shape).asNondeterministic()  # never evaluated twice, nor is the order before it dropped
    d = df.withColumn("_nth", F.row_number().over(ax.ordered()))
    d = d.withColumn("_walked", fn("_nth", *[F.expr(c).cast("double") for c in inputs]))
    return d.withColumns({name: F.col(f"_walked.w{i}") for i, name in enumerate(columns)}).drop("_nth", "_walked")


def with_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """``df.withColumns`` for expressions that may hold placeholders; a draft (``plans.draft``) only records them."""
    if not exprs or not isinstance(df, DataFrame):
        return df.withColumns(exprs) if exprs else df
    used = dict.fromkeys(name for e in exprs.values() for name in _PLACEHOLDER.findall(str(e)))
    for ax in dict.fromkeys(_ASKED[name][1] for name in used):
        df = walked(df, {name: _ASKED[name][0] for name in used if _ASKED[name][1] == ax}, ax)
    return df.withColumns(exprs).drop(*used)
