"""Rules of whole sheets on numpy arrays: the same functions that make Spark's columns, run in a Python worker on many sheets at once.

``F`` and ``Window`` stand for Spark's own in the operators. Inside ``running()`` they make expressions of this module instead, which a Frame, in the
place of a DataFrame, evaluates as Spark would: nulls, logic of three values and lambdas on arrays included. Strings are numbers of a pool, so what is asked
of one is computed once; an array of the whole sheet is a range of one column, so no row copies it. What looks at all pairs of a sheet goes
in blocks of PAIRS pairs, so a large sheet costs time, not memory.
"""

from __future__ import annotations

import re
import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from unicodedata import category

import numpy as np

#: Rows that a worker judges at once (more if a sheet has more), pairs of them at once, and strings that a worker remembers.
ROWS, PAIRS, STRINGS = 16_384, 262_144, 400_000

_mode = threading.local()


@contextmanager
def running():
    _mode.on = True
    try:
        yield
    finally:
        _mode.on = False


class _Own:
    """Spark's module or class of that name, or inside ``running()`` what this module has for it."""

    def __init__(self, own: type, spark: str, name: str):
        self._own, self._spark, self._name = own, spark, name

    def __getattr__(self, k: str):
        if getattr(_mode, "on", False):
            return getattr(self._own, k)
        from importlib import import_module

        found = import_module(self._spark)
        return getattr(getattr(found, self._name) if self._name else found, k)


# ---- strings

_pool: list[str] = []
_codes: dict[str, int] = {}
_known: dict = {}


def code(s: str) -> int:
    k = _codes.get(s)
    if k is None:
        k = _codes[s] = len(_pool)
        _pool.append(s)
    return k


def forget() -> None:
    """Begin a new pool if the old one is large; between two batches, as numbers of the old one mean nothing then."""
    if len(_pool) > STRINGS:
        _pool.clear(), _codes.clear(), _known.clear()


def _by_string(c: Vec, what, f: Callable[[str], object]) -> tuple[list, np.ndarray]:
    """What f gives for the distinct strings of c, and the place of each row's in that list."""
    seen = _known.setdefault(what, {})
    u, at = np.unique(c.v if c.m is None else np.where(c.m, c.v, 0), return_inverse=True)
    u = u.tolist()
    for k in u:
        if k not in seen:
            seen[k] = f(_pool[k]) if _pool else f("")
    return [seen[k] for k in u], at


def _by_strings(a: Vec, b: Vec, f: Callable[[str, str], object], dtype) -> tuple[np.ndarray, np.ndarray | None]:
    m = _both(a.m, b.m)
    av, bv = np.broadcast_arrays(a.v, b.v)
    key = av.astype(np.int64) << 31 | bv
    if m is not None:
        key = np.where(m, key, -1)
    u, at = np.unique(key, return_inverse=True)
    found = np.array([0 if k < 0 else f(_pool[k >> 31], _pool[k & 0x7FFFFFFF]) for k in u.tolist()], dtype=dtype)
    return found[at].reshape(key.shape), m


#: Fixed value: signs on which Python and Java agree whether they are part of a word; strings of them alone need no list of all words' signs.
PLAIN = re.compile("[\u0000-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u02ff\u0400-\u0482\u048a-\u052f\u2010-\u203e\u2116]*")


def word_signs() -> str:
    """All signs of words as Java's U knows them, as ranges: letters, marks, decimal numbers, connectors and joiners."""
    if "words" not in _known:
        kinds, spans = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc"}, []
        for k in range(sys.maxunicode + 1):
            if category(chr(k)) in kinds or 0x24B6 <= k <= 0x24E9 or 0x200C <= k <= 0x200D:
                if spans and spans[-1][1] == k - 1:
                    spans[-1][1] = k
                else:
                    spans.append([k, k])
        _known["words"] = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
    return _known["words"]


def pattern(java: str) -> Callable[[str], re.Pattern]:
    """What gives a pattern for a string, as Java reads it: with U words, blanks and cases are of all scripts, else of ASCII; numbers that aren't decimal are no part of a word, marks are."""
    flags, body = re.match(r"(?:\(\?([a-zA-Z]+)\))?(.*)", java, re.S).groups()
    flags = flags or ""
    how = (re.I if "i" in flags else 0) | (0 if "U" in flags else re.A)
    plain, odd = re.compile(body, how), []
    if "U" not in flags or (r"\b" not in body and r"\w" not in body):
        return lambda s: plain

    def exact() -> re.Pattern:
        if not odd:
            w = f"(?-i:[{word_signs()}])"
            odd.append(re.compile(body.replace(r"\w", w).replace(r"\b", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))"), how))
        return odd[0]

    return lambda s: plain if PLAIN.fullmatch(s) else exact()


# ---- columns


def _both(a, b):
    return b if a is None else a if b is None else a & b


class Vec:
    """Values of one kind (b, i, f, or s for strings) and which of them aren't null; one without a dimension stands for all rows."""

    __slots__ = ("v", "m", "t")

    def __init__(self, v, m, t: str):
        if m is not None and m.ndim < v.ndim:
            m = np.broadcast_to(m, v.shape)
        elif m is not None and m.ndim > v.ndim:
            v = np.broadcast_to(v, m.shape)
        self.v, self.m, self.t = v, m, t

    def take(self, i):
        return self if self.v.ndim == 0 else Vec(self.v[i], None if self.m is None else self.m[i], self.t)

    def full(self, n: int):
        return self if self.v.ndim else Vec(np.broadcast_to(self.v, n), None if self.m is None else np.broadcast_to(self.m, n), self.t)

    def valid(self):
        return np.ones(self.v.shape, bool) if self.m is None else self.m

    def masked(self, m):
        return Vec(self.v, _both(self.m, m), self.t)

    def true(self):
        return self.v if self.m is None else self.v & self.m


class Struct:
    """Fields by name; taken rows are looked up as a field is asked for."""

    def __init__(self, fields: dict | None, m, n: int, base=None, at=None):
        self.fields, self.m, self.n, self.base, self.at = {} if fields is None else fields, m, n, base, at
        self.names = list(fields) if base is None else base.names

    def field(self, k: str):
        if k not in self.fields:
            self.fields[k] = self.base.field(k).take(self.at)
        return self.fields[k]

    def take(self, i):
        i = np.arange(self.n)[i] if isinstance(i, slice) else i
        return Struct(None, None if self.m is None else self.m[i], len(i), self, i)

    def full(self, n: int):
        return self

    def valid(self):
        return np.ones(self.n, bool) if self.m is None else self.m

    def masked(self, m):
        out = Struct(dict(self.fields), _both(self.m, m), self.n, self.base, self.at)
        out.names = self.names
        return out


class Arr:
    """An array a row: a range of child."""

    __slots__ = ("start", "count", "child", "m", "_flat")

    def __init__(self, start, count, child, m=None):
        self.start, self.count, self.child, self.m, self._flat = start, count if m is None else np.where(m, count, 0), child, m, None

    def take(self, i):
        return Arr(self.start[i], self.count[i], self.child, None if self.m is None else self.m[i])

    def full(self, n: int):
        return self

    def valid(self):
        return np.ones(len(self.start), bool) if self.m is None else self.m

    def masked(self, m):
        return Arr(self.start, self.count, self.child, _both(self.m, m))

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each item its row, and its place in child."""
        if self._flat is None:
            rows = np.repeat(np.arange(len(self.count)), self.count)
            first = np.cumsum(self.count) - self.count
            self._flat = rows, np.arange(len(rows)) + np.repeat(self.start - first, self.count)
        return self._flat

    def items(self):
        return self.child.take(self.flat()[1])


def length(c) -> int:
    return len(c.v) if isinstance(c, Vec) else c.n if isinstance(c, Struct) else len(c.start)


def compact(count, child, m=None) -> Arr:
    return Arr(np.cumsum(count) - count, count, child, m)


def concat(cols: list):
    if len(cols) == 1:
        return cols[0]
    masks = None if all(c.m is None for c in cols) else np.concatenate([c.valid() for c in cols])
    first = cols[0]
    if isinstance(first, Struct):
        return Struct({k: concat([c.field(k).full(c.n) for c in cols]) for k in first.names}, masks, sum(c.n for c in cols))
    if isinstance(first, Arr):
        counts = np.concatenate([c.count for c in cols])
        if all(c.child is first.child for c in cols):
            return Arr(np.concatenate([c.start for c in cols]), counts, first.child, masks)
        cols = [c if length(c.child) <= 2 * int(c.count.sum()) else compact(c.count, c.items(), c.m) for c in cols]  # no items that nobody has
        at = np.cumsum([0] + [length(c.child) for c in cols[:-1]])
        return Arr(np.concatenate([c.start + k for c, k in zip(cols, at, strict=True)]), counts, concat([c.child for c in cols]), masks)
    return Vec(np.concatenate([c.v for c in cols]), masks, "f" if any(c.t == "f" for c in cols) else first.t)


def nulls(c, n: int):
    """n nulls of c's kind."""
    none = np.zeros(n, bool)
    if isinstance(c, Struct):
        return Struct({k: nulls(c.field(k), n) for k in c.names}, none, n)
    if isinstance(c, Arr):
        return Arr(np.zeros(n, np.int64), np.zeros(n, np.int64), c.child, none)
    return Vec(np.zeros(n, c.v.dtype), none, c.t)


def take_or_null(c, i, ok):
    """The rows i of c where ok, else null."""
    if not len(i) or not length(c):
        return nulls(c, len(i))
    out = c.take(np.where(ok, i, 0)).full(len(i))
    return out if ok.all() else out.masked(ok)


def any_of(flags, count) -> np.ndarray:
    return sum_of(flags, count) > 0


def sum_of(values, count) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(count)
    return total[end] - total[end - count]


def rank(c):
    """Numbers in c's order, nulls first."""
    v = c.v
    if c.t == "s":
        u, at = np.unique(v, return_inverse=True)
        names = [_pool[k] if _pool else "" for k in u.tolist()]
        order = np.empty(len(u), np.int64)
        order[sorted(range(len(u)), key=names.__getitem__)] = np.arange(len(u))
        v = order[at]
    v = v.astype(np.float64)
    return v if c.m is None else np.where(c.m, v, -np.inf)


def keys(c, n: int) -> list:
    """A column's fields, the first first, as numbers in their order; what can't be put in order ends them."""
    if isinstance(c, Vec):
        return [rank(c.full(n))]
    out = [] if c.m is None else [c.m.astype(np.float64)]
    if isinstance(c, Struct):
        for k in c.names:
            if isinstance(c.field(k), Arr):
                break
            out += keys(c.field(k), n)
    return out


# ---- expressions


class Env:
    """Rows of a frame, or the items of an array, with what they see of the rows around them."""

    def __init__(self, n: int, cols: dict | None = None, parent: Env | None = None, rep=None, var=None, items=None, groups=None):
        self.n, self.cols, self.parent, self.rep, self.var, self.items, self.groups = n, {} if cols is None else cols, parent, rep, var, items, groups

    def column(self, name: str):
        if name not in self.cols:
            if self.parent is None:
                raise KeyError(name)
            self.cols[name] = self.parent.column(name).take(self.rep)
        return self.cols[name]

    def bound(self, var):
        if self.var is var:
            return self.items
        if var not in self.cols:
            self.cols[var] = self.parent.bound(var).take(self.rep)
        return self.cols[var]

    def some(self, i) -> Env:
        return Env(len(i), parent=self, rep=i)


class Expr:
    def __init__(self, ev: Callable[[Env], object], *of, heavy: bool = False, name: str | None = None, window: bool = False):
        self.ev, self.name = ev, name
        self.heavy = heavy or any(o.heavy for o in of if isinstance(o, Expr))
        self.window = window or any(o.window for o in of if isinstance(o, Expr))

    def alias(self, name: str) -> Expr:
        return Expr(self.ev, self, name=name)

    def __getitem__(self, k: str) -> Expr:
        return Expr(lambda e: field(self.ev(e), k), self, name=k)

    def cast(self, to: str) -> Expr:
        return Expr(lambda e: cast(self.ev(e), to), self, name=self.name)

    try_cast = cast

    def isNull(self) -> Expr:
        return Expr(lambda e: Vec(~self.ev(e).valid(), None, "b"), self)

    def isNotNull(self) -> Expr:
        return Expr(lambda e: Vec(self.ev(e).valid(), None, "b"), self)

    def between(self, lo, hi) -> Expr:
        return (self >= lo) & (self <= hi)

    def isin(self, *values) -> Expr:
        out = self == values[0]
        for v in values[1:]:
            out = out | (self == v)
        return out

    def rlike(self, p: str) -> Expr:
        of = pattern(p)

        def ev(e):
            c = self.ev(e)
            found, at = _by_string(c, ("like", p), lambda s: of(s).search(s) is not None)
            return Vec(np.array(found, bool)[at].reshape(c.v.shape), c.m, "b")

        return Expr(ev, self, heavy=True)

    def over(self, window: tuple) -> Expr:
        return Expr(lambda e: self.ev(e, window), self, window=True)

    def when(self, cond, value) -> Expr:
        return _when([*self.cases, (cond, wrap(value))], None)

    def otherwise(self, value) -> Expr:
        return _when(self.cases, wrap(value))

    def __invert__(self):
        return Expr(lambda e: (lambda c: Vec(~c.v, c.m, "b"))(self.ev(e)), self)

    def __neg__(self):
        return Expr(lambda e: (lambda c: Vec(-c.v, c.m, c.t))(self.ev(e)), self)

    def __and__(self, other):
        return _logic(self, wrap(other), True)

    def __or__(self, other):
        return _logic(self, wrap(other), False)

    __rand__, __ror__ = __and__, __or__


def wrap(x) -> Expr:
    return x if isinstance(x, Expr) else Functions.lit(x)


def named(x) -> Expr:
    """A column by its name, or an expression."""
    return Functions.col(x) if isinstance(x, str) else x


def _logic(a: Expr, b: Expr, both: bool) -> Expr:
    def ev(e):
        x = a.ev(e)
        if b.heavy and x.v.ndim:
            ask = (x.v if both else ~x.v) if x.m is None else ((x.v if both else ~x.v) | ~x.m)
            if 3 * np.count_nonzero(ask) < 2 * len(ask):  # the others are settled
                i = np.flatnonzero(ask)
                part = b.ev(e.some(i)).full(len(i))
                v, m = np.full(len(ask), both), None
                v[i] = part.v
                if part.m is not None:
                    m = np.ones(len(ask), bool)
                    m[i] = part.m
                y = Vec(v, m, "b")
            else:
                y = b.ev(e)
        else:
            y = b.ev(e)
        if x.m is None and y.m is None:
            return Vec(x.v & y.v if both else x.v | y.v, None, "b")
        xm, ym = x.valid(), y.valid()
        if both:
            return Vec(x.v & y.v, (xm & ym) | (xm & ~x.v) | (ym & ~y.v), "b")
        xv, yv = x.v & xm, y.v & ym
        return Vec(xv | yv, (xm & ym) | xv | yv, "b")

    return Expr(ev, a, b)


def _binary(name: str, f, kind: str | None):
    def op(a, b) -> Expr:
        a, b = wrap(a), wrap(b)

        def ev(e):
            x, y = a.ev(e), b.ev(e)
            m = _both(x.m, y.m)
            if name in ("truediv", "mod"):
                zero = y.v == 0
                if zero.any():  # as in SQL, nothing is a part of nothing
                    m, y = _both(m, ~zero), Vec(np.where(zero, 1, y.v), y.m, y.t)
                t = "f" if name == "truediv" or "f" in (x.t, y.t) else "i"
            else:
                t = kind or ("f" if "f" in (x.t, y.t) else "i")
            return Vec(np.asarray(f(x.v, y.v)), m, t)

        return Expr(ev, a, b)

    return op


for _name, _f, _kind in (("add", np.add, None), ("sub", np.subtract, None), ("mul", np.multiply, None), ("truediv", np.true_divide, None), ("mod", np.fmod, None), ("eq", np.equal, "b"), ("ne", np.not_equal, "b"), ("lt", np.less, "b"), ("le", np.less_equal, "b"), ("gt", np.greater, "b"), ("ge", np.greater_equal, "b")):
    _op = _binary(_name, _f, _kind)
    setattr(Expr, f"__{_name}__", _op)
    if _kind is None:
        setattr(Expr, f"__r{_name}__", (lambda op: lambda a, b: op(b, a))(_op))
Expr.__hash__ = object.__hash__


def field(c, k: str):
    if isinstance(c, Arr):
        return Arr(c.start, c.count, field(c.child, k), c.m)
    out = c.field(k)
    return out if c.m is None else out.full(c.n).masked(c.m)


def empty(kind: str):
    """No values of a kind."""
    if kind.startswith("struct<"):
        return Struct({k: empty(t) for k, t in (f.split(":") for f in kind[7:-1].split(","))}, None, 0)
    t = {"string": "s", "boolean": "b", "double": "f"}.get(kind, "i")
    return Vec(np.zeros(0, {"b": bool, "f": np.float64}.get(t, np.int64)), None, t)


def cast(c, to: str):
    if to.startswith("array<"):
        return Arr(c.start, c.count, empty(to[6:-1]), c.m)  # of an array of nothing
    if to == "string":
        if c.t == "s":
            return c
        u, at = np.unique(c.v, return_inverse=True)
        return Vec(np.array([code(str(k)) for k in u.tolist()], np.int64)[at].reshape(c.v.shape), c.m, "s")
    if to == "double":
        return Vec(c.v.astype(np.float64), c.m, "f")
    if c.t == "s":
        top = 2**31 if to == "int" else 2**63

        def number(s: str):
            s = s.strip()
            k = int(s) if re.fullmatch(r"[+-]?[0-9]+", s, re.A) else None
            return k if k is not None and -top <= k < top else None

        found, at = _by_string(c, ("number", to), number)
        ok = np.array([k is not None for k in found], bool)[at].reshape(c.v.shape)
        return Vec(np.array([k or 0 for k in found], np.int64)[at].reshape(c.v.shape), _both(c.m, ok), "i")
    return Vec(c.v.astype(np.int64), c.m, "i")


def _when(cases: list, default) -> Expr:
    def ev(e):
        n = e.n
        free, parts = np.ones(n, bool), []
        for cond, value in cases:
            if cond.heavy and 3 * np.count_nonzero(free) < 2 * n:  # the others are settled
                i, on = np.flatnonzero(free), np.zeros(n, bool)
                on[i] = cond.ev(e.some(i)).true()
            else:
                on = free & cond.ev(e).true()
            parts.append((np.flatnonzero(on), value))
            free &= ~on
        rest = np.flatnonzero(free)
        if default is not None:
            parts.append((rest, default))
        got = [(i, v.ev(e.some(i)).full(len(i)) if len(i) < n else v.ev(e).full(n)) for i, v in parts]
        if all(isinstance(c, Vec) for _, c in got):
            t = "f" if any(c.t == "f" for _, c in got) else next((c.t for _, c in got if c.t != "n"), "n")
            v, m = np.zeros(n, {"f": np.float64, "b": bool}.get(t, np.int64)), None
            for i, c in got:
                v[i] = c.v
            if default is None or any(c.m is not None for _, c in got):
                m = np.zeros(n, bool)
                for i, c in got:
                    m[i] = c.valid()
            return Vec(v, m, t)
        got = [(i, c) for i, c in got if not (isinstance(c, Vec) and c.t == "n")]
        for i, c in got:
            if len(i) == n:
                return c
        all_of = concat([c for _, c in got])
        at, ok = np.zeros(n, np.int64), np.zeros(n, bool)
        at[np.concatenate([i for i, _ in got])] = np.arange(sum(len(i) for i, _ in got))
        for i, _ in got:
            ok[i] = True
        return take_or_null(all_of, at, ok)

    out = Expr(ev, *(x for c in cases for x in c), *([default] if default is not None else []))
    out.cases = cases
    return out


def _in_blocks(e: Env, a: Arr, run):
    """run on the rows of e, some at a time if their arrays have more than PAIRS items."""
    if int(a.count.sum()) <= PAIRS or e.n < 2:
        return run(e, a)
    cut = np.cumsum(a.count) // PAIRS
    ends = [*np.flatnonzero(np.diff(cut)) + 1, e.n]
    out, lo = [], 0
    for hi in ends:
        i = np.arange(lo, hi)
        out.append(run(e.some(i), a.take(i)))
        lo = hi
    return concat(out)


def _lambda(arr, f: Callable, run) -> Expr:
    """run(array, what f gives for its items), by row."""
    arr, var = named(arr), object()
    item = Expr(lambda e: e.bound(var))
    body = wrap(f(item))

    def one(e: Env, a: Arr):
        rows, at = a.flat()
        inner = Env(len(rows), parent=e, rep=rows, var=var, items=a.child.take(at))
        return run(a, body.ev(inner).full(len(rows)))

    return Expr(lambda e: _in_blocks(e, arr.ev(e), one), arr, heavy=True)


def _keep(a: Arr, on) -> Arr:
    """The items of a for which on holds."""
    return compact(sum_of(on, a.count), a.child.take(a.flat()[1][on]), a.m)


def _best(a: Arr, sign: int):
    """The largest (sign 1) or smallest item of each array, by its fields in order; null items don't count."""
    child = a.items()
    rows = a.flat()[0]
    alive = np.flatnonzero(child.valid()) if child.m is not None else np.arange(len(rows))
    child = child.take(alive)
    where, left = rows[alive], alive
    at = np.arange(len(alive))
    for k in keys(child, len(alive)):
        if len(at) == 0:
            break
        v, r = sign * k[at], where[at]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        if len(first) == len(at):
            break
        top = np.maximum.reduceat(v, first)
        at = at[v == np.repeat(top, np.diff(np.append(first, len(r))))]
    r = where[at]
    first = np.flatnonzero(np.diff(r, prepend=-1))
    pos, ok = np.zeros(len(a.count), np.int64), np.zeros(len(a.count), bool)
    pos[r[first]], ok[r[first]] = at[first], True
    return take_or_null(child, pos, ok)


def _unary_arr(x, f) -> Expr:
    x = named(x)
    return Expr(lambda e: f(x.ev(e)), x, heavy=True)


def _numeric(x, f) -> Expr:
    x = named(x)
    return Expr(lambda e: (lambda c: Vec(f(c.v.astype(np.float64)), c.m, "f"))(x.ev(e)), x)


def _string(x, name: str, f: Callable[[str], str]) -> Expr:
    x = named(x)

    def ev(e):
        c = x.ev(e)
        found, at = _by_string(c, name, lambda s: code(f(s)))
        return Vec(np.array(found, np.int64)[at].reshape(c.v.shape), c.m, "s")

    return Expr(ev, x, heavy=True)


def _extreme(f, *xs) -> Expr:
    xs = [named(x) for x in xs]

    def ev(e):
        out = xs[0].ev(e)
        for x in xs[1:]:
            c = x.ev(e)
            v = f(out.v, c.v)
            if out.m is None and c.m is None:
                out = Vec(v, None, "f" if "f" in (out.t, c.t) else c.t)
            else:
                a, b = out.valid(), c.valid()
                out = Vec(np.where(a & b, v, np.where(a, out.v, c.v)), a | b, "f" if "f" in (out.t, c.t) else c.t)
        return out

    return Expr(ev, *xs)


def _group(e: Env, window) -> tuple[np.ndarray, int]:
    """Of each row its group, by sheet or by sheet and further columns, and how many there are."""
    g, n = e.groups
    for name in () if window is None else [k for k in window if k != "sheet_no"]:
        c = e.column(name)
        g = np.unique(np.stack([g, np.where(c.valid(), c.v, 0), c.valid()]), axis=1, return_inverse=True)[1].ravel()
        n = int(g.max()) + 1 if len(g) else 0
    return g, n


def _over(x: Expr | None, f) -> Expr:
    """An aggregate of x by group: f(values, group, number of groups)."""

    def ev(e, window=None):
        g, n = _group(e, window)
        return f(None if x is None else x.ev(e).full(e.n), g, n)

    return Expr(ev, *([x] if x is not None else []), window=True)


def _listed(x) -> Expr:
    """All values of the sheet that aren't null; a set is not distinct here, as sets are only asked what they contain."""
    x = named(x)

    def ev(e, window=None):
        g, n = e.groups  # sheets only: their rows lie together
        c = x.ev(e).full(e.n)
        on = c.valid()
        count = np.bincount(g[on], minlength=n)
        start = np.cumsum(count) - count
        return Arr(start[g], count[g], c.take(np.flatnonzero(on)) if c.m is not None else c)

    return Expr(ev, x, window=True)


def _sum(c: Vec, g, n) -> Vec:
    on = c.valid()
    v = np.zeros(n, np.float64 if c.t == "f" else np.int64)
    np.add.at(v, g[on], c.v[on])
    return Vec(v[g], (np.bincount(g[on], minlength=n) > 0)[g], c.t)


def _max(c: Vec, g, n) -> Vec:
    on = c.valid()
    v = np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(v, g[on], c.v[on])
    return Vec(v[g], (np.bincount(g[on], minlength=n) > 0)[g], c.t)


def _once(f: Callable[[Arr], Arr]) -> Callable[[Arr], Arr]:
    """f on arrays of which rows that follow each other may be the same one, as those of a sheet are; it is done once then."""

    def g(a: Arr) -> Arr:
        new = np.ones(len(a.count), bool)
        new[1:] = (np.diff(a.start) != 0) | (np.diff(a.count) != 0)
        if a.m is not None or new.all():
            return f(a)
        return f(a.take(np.flatnonzero(new))).take(np.cumsum(new) - 1)

    return g


@_once
def _flatten(a: Arr) -> Arr:
    inner = a.items()
    child = inner.child.take(inner.flat()[1])
    return compact(sum_of(inner.count, a.count), child, a.m)


def _distinct(a: Arr) -> Arr:
    rows, c = a.flat()[0], a.items()
    v = c.v.astype(np.int64) if c.m is None else np.where(c.m, c.v.astype(np.int64), np.iinfo(np.int64).min)
    _, at = np.unique(v, return_inverse=True)
    on = np.zeros(len(rows), bool)
    on[np.unique(rows * (len(rows) + 1) + at.ravel(), return_index=True)[1]] = True
    return _keep(a, on)


@_once
def _sorted(a: Arr) -> Arr:
    c = a.items()
    order = np.lexsort((*reversed(keys(c, len(a.flat()[0]))), a.flat()[0]))
    return compact(a.count, c.take(order), a.m)


def _contains(a: Arr, x: Vec) -> Vec:
    rows, c = a.flat()[0], a.items()
    same = c.v == (x.v if x.v.ndim == 0 else x.v[rows])
    found = any_of(same if c.m is None else same & c.m, a.count)
    m = _both(a.m, x.m)
    if c.m is not None:
        m = _both(m, found | ~any_of(~c.m, a.count))
    return Vec(found, m, "b")


def _append(a: Arr, x) -> Arr:
    n = len(a.count)
    both = concat([a.items(), x.full(n)])
    end = np.cumsum(a.count)
    order = np.empty(int(a.count.sum()) + n, np.int64)
    last = end + np.arange(n)
    on = np.ones(len(order), bool)
    on[last] = False
    order[last], order[on] = len(order) - n + np.arange(n), np.arange(len(order) - n)
    return compact(a.count + 1, both.take(order), a.m)


class Functions:
    """What the operators use of Spark's functions."""

    @staticmethod
    def col(name: str) -> Expr:
        first, *rest = name.split(".")

        def ev(e):
            c = e.column(first)
            for k in rest:
                c = field(c, k)
            return c

        return Expr(ev, name=name.split(".")[-1])

    @staticmethod
    def lit(x) -> Expr:
        if x is None:
            return Expr(lambda e: Vec(np.array(0), np.array(False), "n"))
        if isinstance(x, str):
            return Expr(lambda e: Vec(np.array(code(x)), None, "s"))
        v = Vec(np.array(x), None, "b" if isinstance(x, bool) else "f" if isinstance(x, float) else "i")
        return Expr(lambda e: v)

    when = staticmethod(lambda cond, value: _when([(cond, wrap(value))], None))
    filter = staticmethod(lambda a, f: _lambda(a, f, lambda x, on: _keep(x, on.true())))
    transform = staticmethod(lambda a, f: _lambda(a, f, lambda x, c: compact(x.count, c, x.m)))
    sqrt = staticmethod(lambda x: _numeric(x, np.sqrt))
    abs = staticmethod(lambda x: (lambda c: Expr(lambda e: (lambda v: Vec(np.abs(v.v), v.m, v.t))(c.ev(e)), c))(named(x)))
    least = staticmethod(lambda *xs: _extreme(np.minimum, *xs))
    greatest = staticmethod(lambda *xs: _extreme(np.maximum, *xs))
    upper = staticmethod(lambda x: _string(x, "upper", str.upper))
    lower = staticmethod(lambda x: _string(x, "lower", str.lower))
    flatten = staticmethod(lambda x: _unary_arr(x, _flatten))
    array_distinct = staticmethod(lambda x: _unary_arr(x, _distinct))
    array_compact = staticmethod(lambda x: _unary_arr(x, lambda a: a if a.child.m is None else _keep(a, a.items().valid())))
    array_max = staticmethod(lambda x: _unary_arr(x, lambda a: _best(a, 1)))
    array_min = staticmethod(lambda x: _unary_arr(x, lambda a: _best(a, -1)))
    sort_array = staticmethod(lambda x: _unary_arr(x, _sorted))
    size = staticmethod(lambda x: _unary_arr(x, lambda a: Vec(a.count, a.m, "i")))
    slice = staticmethod(lambda x, start, n: _unary_arr(x, lambda a: Arr(a.start + start - 1, np.clip(a.count - start + 1, 0, n), a.child, a.m)))
    collect_list = collect_set = staticmethod(_listed)
    count = staticmethod(lambda x: _over(None if x == "*" else named(x), lambda c, g, n: Vec(np.bincount(g if c is None else g[c.valid()], minlength=n)[g], None, "i")))
    count_if = staticmethod(lambda x: _over(x, lambda c, g, n: Vec(np.bincount(g[c.true()], minlength=n)[g], None, "i")))
    sum = staticmethod(lambda x: _over(named(x), _sum))
    max = staticmethod(lambda x: _over(named(x), _max))

    @staticmethod
    def exists(a, f) -> Expr:
        def run(x: Arr, on: Vec):
            found, m = any_of(on.true(), x.count), x.m
            if on.m is not None:
                m = _both(m, found | ~any_of(~on.m, x.count))
            return Vec(found, m, "b")

        return _lambda(a, f, run)

    @staticmethod
    def coalesce(*xs) -> Expr:
        xs = [named(x) for x in xs]

        def ev(e):
            first = xs[0].ev(e)
            if first.m is None:
                return first
            memo = Expr(lambda e2: first if e2 is e else first.take(e2.rep))
            rest = Functions.coalesce(*xs[1:]) if len(xs) > 2 else xs[1]
            return _when([(memo.isNotNull(), memo)], rest).ev(e)

        return Expr(ev, *xs) if len(xs) > 1 else xs[0]

    @staticmethod
    def struct(*xs) -> Expr:
        xs = [named(x) for x in xs]
        return Expr(lambda e: Struct({x.name: x.ev(e).full(e.n) for x in xs}, None, e.n), *xs)

    @staticmethod
    def array(*xs) -> Expr:
        xs = [named(x) for x in xs]

        def ev(e):
            if not xs:
                return Arr(np.zeros(e.n, np.int64), np.zeros(e.n, np.int64), empty("int"))
            both = concat([x.ev(e).full(e.n) for x in xs])
            k = len(xs)
            return compact(np.full(e.n, k), both.take((np.arange(e.n)[:, None] + np.arange(k) * e.n).ravel()))

        return Expr(ev, *xs)

    @staticmethod
    def get(a, k) -> Expr:
        a, k = named(a), wrap(k)

        def ev(e):
            x, i = a.ev(e), k.ev(e)
            ok = (i.v >= 0) & (i.v < x.count)
            return take_or_null(x.child, x.start + i.v, ok if i.m is None else ok & i.m)

        return Expr(ev, a, k, heavy=True)

    @staticmethod
    def array_contains(a, x) -> Expr:
        a, x = named(a), wrap(x)
        return Expr(lambda e: _contains(a.ev(e), x.ev(e)), a, x, heavy=True)

    @staticmethod
    def arrays_overlap(a, b) -> Expr:
        b = named(b)
        return Functions.exists(a, lambda x: Functions.array_contains(b, x))

    @staticmethod
    def array_intersect(a, b) -> Expr:
        b = named(b)
        return Functions.array_distinct(Functions.filter(a, lambda x: Functions.array_contains(b, x)))

    @staticmethod
    def array_append(a, x) -> Expr:
        a, x = named(a), wrap(x)

        def ev(e):
            return _append(a.ev(e), x.ev(e))

        return Expr(ev, a, x, heavy=True)

    @staticmethod
    def array_join(a, by: str) -> Expr:
        a = named(a)

        def ev(e):
            x = a.ev(e)
            c = x.items()
            k, at = (c.v if c.m is None else np.where(c.m, c.v, -1)).tolist(), [0, *np.cumsum(x.count).tolist()]
            joined = [code(by.join([_pool[i] for i in k[lo:hi] if i >= 0])) for lo, hi in zip(at[:-1], at[1:], strict=True)]
            return Vec(np.array(joined, np.int64), x.m, "s")

        return Expr(ev, a, heavy=True)

    @staticmethod
    def aggregate(a, zero, step) -> Expr:
        a, zero, state, item = named(a), wrap(zero), object(), object()
        body = wrap(step(Expr(lambda e: e.bound(state)), Expr(lambda e: e.bound(item))))

        def ev(e):
            x, out = a.ev(e), zero.ev(e).full(e.n)
            for k in range(int(x.count.max()) if e.n else 0):
                i = np.flatnonzero(x.count > k)
                inner = Env(len(i), parent=e, rep=i, var=item, items=x.child.take(x.start[i] + k))
                inner.cols[state] = out.take(i)
                new = body.ev(inner).full(len(i))
                at = np.arange(e.n)
                at[i] = e.n + np.arange(len(i))
                out = concat([out, new]).take(at)
            return out if x.m is None else out.masked(x.m)

        return Expr(ev, a, zero, heavy=True)

    @staticmethod
    def contains(a, b) -> Expr:
        a, b = named(a), named(b)
        return Expr(lambda e: Vec(*_by_strings(a.ev(e), b.ev(e), lambda s, t: t in s, bool), "b"), a, b, heavy=True)

    @staticmethod
    def concat(*xs) -> Expr:
        xs = [named(x) for x in xs]

        def ev(e):
            out = xs[0].ev(e)
            for x in xs[1:]:
                out = Vec(*_by_strings(out, x.ev(e), lambda s, t: code(s + t), np.int64), "s")
            return out

        return Expr(ev, *xs, heavy=True)

    @staticmethod
    def regexp_extract_all(x, p: Expr, group: Expr) -> Expr:
        x = named(x)

        def ev(e):
            c, one = x.ev(e).full(e.n), Env(1)
            java, k = _pool[int(p.ev(one).v)], int(group.ev(one).v)
            of = pattern(java)
            found, at = _by_string(c, ("all", java, k), lambda s: [code(t) for t in of(s).findall(s)] if not of(s).groups else [code(m.group(k)) for m in of(s).finditer(s)])
            count = np.array([len(f) for f in found], np.int64)
            start = np.cumsum(count) - count
            return Arr(start[at], count[at], Vec(np.array([i for f in found for i in f], np.int64), None, "s"), c.m)

        return Expr(ev, x, heavy=True)


class Windows:
    @staticmethod
    def partitionBy(*names: str) -> tuple:
        return names


F = _Own(Functions, "pyspark.sql.functions", "")
Window = _Own(Windows, "pyspark.sql.window", "Window")


# ---- tables


class Frame:
    """Rows of whole sheets, which lie together, in the place of a DataFrame. Steps wait until a window asks for them, and run in blocks of rows then."""

    def __init__(self, cols: dict, groups: tuple, steps: tuple = (), names: list | None = None):
        self.cols, self.groups, self.steps, self.columns = cols, groups, steps, list(cols) if names is None else names

    def withColumns(self, new: dict) -> Frame:
        if any(x.window for x in new.values()):
            d = self.made()
            e = Env(len(d.groups[0]), d.cols, groups=d.groups)
            return Frame(d.cols | {k: x.ev(e).full(e.n) for k, x in new.items()}, d.groups)
        return Frame(self.cols, self.groups, (*self.steps, new), [*self.columns, *(k for k in new if k not in self.columns)])

    def withColumn(self, name: str, x: Expr) -> Frame:
        return self.withColumns({name: x})

    def drop(self, *names: str) -> Frame:
        left = [k for k in self.columns if k not in names]
        return Frame(self.cols, self.groups, (*self.steps, left), left)

    def select(self, *xs) -> Frame:
        xs = [named(k) for x in xs for k in (self.columns if isinstance(x, str) and x == "*" else [x])]
        d = self.withColumns({x.name: x for x in xs})
        return d.drop(*(k for k in d.columns if k not in {x.name for x in xs}))

    def filter(self, on: Expr) -> Frame:
        d = self.made()
        i = np.flatnonzero(on.ev(Env(len(d.groups[0]), d.cols)).true())
        return Frame({k: c.take(i) for k, c in d.cols.items()}, (d.groups[0][i], d.groups[1]))

    def groupBy(self, name: str) -> _Grouped:
        return _Grouped(self, name)

    def made(self) -> Frame:
        """All steps done."""
        if not self.steps:
            return self
        g, n = self.groups
        pairs = np.cumsum(np.bincount(g, minlength=n)[g])
        ends = [*(np.flatnonzero(np.diff(pairs // PAIRS)) + 1), len(g)] if len(g) else [0]
        out, lo = [], 0
        for hi in ends:
            cols = self.cols if len(ends) == 1 else {k: c.take(slice(lo, hi)) for k, c in self.cols.items()}
            for step in self.steps:
                if isinstance(step, list):
                    cols = {k: cols[k] for k in step}
                else:
                    e = Env(hi - lo, dict(cols))
                    cols = cols | {k: x.ev(e).full(hi - lo) for k, x in step.items()}
            out.append(cols)
            lo = hi
        return Frame({k: concat([c[k] for c in out]) for k in out[0]}, self.groups)


class _Grouped:
    def __init__(self, d: Frame, name: str):
        self.d, self.name = d, name

    def agg(self, *xs: Expr) -> Frame:
        """A row a sheet."""
        d = self.d.withColumns({f"agg_{x.name}": x for x in xs}).made()
        first = np.flatnonzero(np.diff(d.groups[0], prepend=-1))
        names = {self.name: self.name} | {x.name: f"agg_{x.name}" for x in xs}
        return Frame({k: d.cols[v].take(first) for k, v in names.items()}, (np.arange(len(first)), len(first)))


# ---- Arrow


def _column(a, n: int):
    import pyarrow as pa

    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    m = None if not a.null_count else a.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_string(a.type) or pa.types.is_large_string(a.type):
        d = a.dictionary_encode()
        names = np.array([code(s) for s in d.dictionary.to_pylist()] or [code("")], np.int64)
        return Vec(names[d.indices.fill_null(0).to_numpy(zero_copy_only=False)], m, "s")
    t = "b" if pa.types.is_boolean(a.type) else "f" if pa.types.is_floating(a.type) else "i"
    v = a.fill_null(False if t == "b" else 0).to_numpy(zero_copy_only=False)
    return Vec(v.astype({"b": bool, "f": np.float64, "i": np.int64}[t], copy=False), m, t)


def _arrow(c, kind):
    """A column as Arrow has it."""
    import pyarrow as pa

    gone = None if c.m is None else ~c.m
    if isinstance(c, Struct):
        return pa.StructArray.from_arrays([_arrow(c.field(f.name).full(c.n), f.type) for f in kind], fields=list(kind), mask=None if gone is None else pa.array(gone))
    if isinstance(c, Arr):
        ends = np.concatenate([[0], np.cumsum(c.count)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _arrow(c.items().full(int(ends[-1])), kind.value_type), type=kind, mask=None if gone is None else pa.array(gone))
    if c.t == "s":
        u, at = np.unique(c.v, return_inverse=True)
        names = pa.array([_pool[k] for k in u.tolist()], pa.string())
        return names.take(pa.array(at.ravel(), mask=gone))
    return pa.array(np.ascontiguousarray(c.v), mask=gone).cast(kind)


def _judged(table, rules: Callable[[Frame], Frame], schema):
    """One table of whole sheets, by the rules."""
    import pyarrow as pa

    forget()
    cols = {k: _column(table.column(k), table.num_rows) for k in table.column_names}
    sheet, place = cols["sheet_no"].v, cols["ord"].v
    if ((np.diff(sheet) == 0) & (np.diff(place) < 0)).any():
        first = np.cumsum(np.diff(sheet, prepend=sheet[0]) != 0)
        order = np.lexsort((place, first))
        cols = {k: c.take(order) for k, c in cols.items()}
        sheet = sheet[order]
    groups = np.cumsum(np.diff(sheet, prepend=sheet[:1]) != 0)
    with running(), np.errstate(all="ignore"):
        out = rules(Frame(cols, (groups, int(groups[-1]) + 1))).made()
    n = len(out.groups[0])
    return pa.RecordBatch.from_arrays([_arrow(out.cols[f.name].full(n), f.type) for f in schema], schema=schema)


def judge(batches: Iterator, rules: Callable[[Frame], Frame], schema) -> Iterator:
    """Batches whose rows lie by sheet, put together to whole sheets, about ROWS rows at a time."""
    import pyarrow as pa

    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < ROWS:
            continue
        sheet = b.column("sheet_no").to_numpy(zero_copy_only=False)
        if sheet[0] == sheet[-1]:
            continue  # one sheet goes on
        cut = len(sheet) - int(np.argmax(sheet[::-1] != sheet[-1]))
        held[-1], rest = b.slice(0, cut), b.slice(cut)
        yield _judged(pa.Table.from_batches(held), rules, schema)
        held, n = [rest], rest.num_rows
    if held:
        yield _judged(pa.Table.from_batches(held), rules, schema)


def over_sheets(d, rules: Callable[[Frame], Frame], schema: str):
    """rules on whole sheets of d, which has sheet_no (not null) and ord and whose rows of a sheet lie in one partition, in a Python worker; their columns by the schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from .session import ship

    ship(d.sparkSession)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return d.sortWithinPartitions("sheet_no").mapInArrow(lambda batches: judge(batches, rules, kinds), schema)
