"""A typed expression language over a panel keyed (instrument, date).

Expressions are small frozen trees. `to_columns` compiles them to Spark columns, one level of window functions after
another, so that equal sub-expressions are computed once and windows of one kind share a sort; `to_sql` compiles the
same trees to a chain of common table expressions for checking elsewhere. Missing values are NULL; a window is NULL
until it holds as many values as it is long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grouped import ROLLING, ranked, rolled

INSTRUMENT, DATE = "instrument", "date"


class Expression:
    """Base of all nodes: arithmetic, comparison, and what a tree needs."""

    def __add__(self, o):
        return Binary("+", self, lift(o))

    def __radd__(self, o):
        return Binary("+", lift(o), self)

    def __sub__(self, o):
        return Binary("-", self, lift(o))

    def __rsub__(self, o):
        return Binary("-", lift(o), self)

    def __mul__(self, o):
        return Binary("*", self, lift(o))

    def __rmul__(self, o):
        return Binary("*", lift(o), self)

    def __truediv__(self, o):
        return Binary("/", self, lift(o))

    def __rtruediv__(self, o):
        return Binary("/", lift(o), self)

    def __neg__(self):
        return Negative(self)

    def __lt__(self, o):
        return Compare("<", self, lift(o))

    def __le__(self, o):
        return Compare("<=", self, lift(o))

    def __gt__(self, o):
        return Compare(">", self, lift(o))

    def __ge__(self, o):
        return Compare(">=", self, lift(o))

    def children(self) -> tuple[Expression, ...]:
        return ()

    def walk(self) -> Iterator[Expression]:
        yield self
        for c in self.children():
            yield from c.walk()

    @property
    def required_inputs(self) -> frozenset[str]:
        got = {e.name for e in self.walk() if isinstance(e, Var)}
        return frozenset(got | {e.params[0] for e in self.walk() if isinstance(e, Call) and e.op == "group_rank"})

    @property
    def lookback(self) -> int:
        """Rows of an instrument before the current one that the value depends on."""
        own = max(0, OPERATORS[self.op].lookback(*self.params)) if isinstance(self, Call) else 0
        return own + max((c.lookback for c in self.children()), default=0)

    @property
    def point_in_time(self) -> bool:
        return not any(isinstance(e, Call) and e.op == "lead" for e in self.walk())


@dataclass(frozen=True)
class Var(Expression):
    name: str


@dataclass(frozen=True)
class Const(Expression):
    value: float


@dataclass(frozen=True)
class Negative(Expression):
    of: Expression

    def children(self):
        return (self.of,)


@dataclass(frozen=True)
class Binary(Expression):
    op: str
    left: Expression
    right: Expression

    def children(self):
        return self.left, self.right


@dataclass(frozen=True)
class Compare(Expression):
    op: str
    left: Expression
    right: Expression

    def children(self):
        return self.left, self.right


@dataclass(frozen=True)
class Where(Expression):
    condition: Expression
    yes: Expression
    no: Expression

    def children(self):
        return self.condition, self.yes, self.no


@dataclass(frozen=True)
class Call(Expression):
    op: str
    args: tuple[Expression, ...]
    params: tuple = field(default=())

    def children(self):
        return self.args


def lift(value: Expression | float) -> Expression:
    return value if isinstance(value, Expression) else Const(float(value))


def _time():
    return W.partitionBy(INSTRUMENT).orderBy(DATE)


def _rows(n: int):
    return _time().rowsBetween(-(n - 1), 0)


def _sql_rows(n: int) -> str:
    return f"OVER (PARTITION BY {INSTRUMENT} ORDER BY {DATE} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_SQL_TIME = f"OVER (PARTITION BY {INSTRUMENT} ORDER BY {DATE})"


@dataclass(frozen=True)
class Operator:
    """How an operator compiles; `windowed` ones are staged as columns of their own."""

    column: Callable[..., Column]
    sql: Callable[..., str]
    windowed: bool = True
    lookback: Callable[..., int] = lambda *p: 0


def _full(x: Column, value: Column, n: int) -> Column:
    return F.when(F.count(x).over(_rows(n)) == n, value)


def _sql_full(x: str, value: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_sql_rows(n)} = {n} THEN {value} END"


def _rolling(spark: Callable[[Column], Column], sql: str) -> Operator:
    return Operator(
        lambda x, n: _full(x, spark(x).over(_rows(n)), n),
        lambda x, n: _sql_full(x, f"{sql}({x}) {_sql_rows(n)}", n),
        lookback=lambda n: n - 1,
    )


def _part(spark: Callable[[Column], Column], sql: str) -> Operator:
    return Operator(lambda x, n: spark(x).over(_rows(n)), lambda x, n: f"{sql}({x}) {_sql_rows(n)}", lookback=lambda n: n - 1)


def _pair(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def _sql_pair(x: str, y: str) -> tuple[str, str]:
    return f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"


def _cov(x: Column, y: Column, n: int) -> Column:
    a, b = _pair(x, y)
    return _full(a, F.covar_samp(a, b).over(_rows(n)), n)


def _corr(x: Column, y: Column, n: int) -> Column:
    a, b = _pair(x, y)
    w = _rows(n)
    return _full(a, F.try_divide(F.covar_samp(a, b).over(w), F.stddev_samp(a).over(w) * F.stddev_samp(b).over(w)), n)


def _sql_cov(x: str, y: str, n: int) -> str:
    a, b = _sql_pair(x, y)
    return _sql_full(a, f"covar_samp({a}, {b}) {_sql_rows(n)}", n)


def _sql_corr(x: str, y: str, n: int) -> str:
    a, b = _sql_pair(x, y)
    w = _sql_rows(n)
    return _sql_full(a, f"covar_samp({a}, {b}) {w} / nullif(stddev_samp({a}) {w} * stddev_samp({b}) {w}, 0)", n)


def _ts_rank(x: Column, n: int) -> Column:
    held = F.collect_list(x).over(_rows(n))
    less = F.aggregate(held, F.lit(0.0), lambda acc, v: acc + F.when(v < x, 1.0).when(v == x, 0.5).otherwise(0.0))
    return _full(x, (less + 0.5) / n, n)


def _sql_ts_rank(x: str, n: int) -> str:
    held = f"list({x}) {_sql_rows(n)}"
    return _sql_full(x, f"(list_sum(list_transform({held}, lambda v: CASE WHEN v < {x} THEN 1.0 WHEN v = {x} THEN 0.5 ELSE 0.0 END))::DOUBLE + 0.5) / {n}", n)


def _argmax(x: Column, n: int) -> Column:
    held = F.collect_list(x).over(_rows(n))
    return _full(x, (n + 1 - F.array_position(held, F.array_max(held))).cast("double"), n)


def _sql_argmax(x: str, n: int) -> str:
    held = f"list({x}) {_sql_rows(n)}"
    return _sql_full(x, f"({n} + 1 - list_position({held}, list_max({held})))::DOUBLE", n)


def _decay(x: Column, n: int) -> Column:
    terms = [(F.lag(x, k).over(_time()) if k else x) * float(n - k) for k in range(n)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / (n * (n + 1) / 2)


def _sql_decay(x: str, n: int) -> str:
    terms = [f"{f'lag({x}, {k}) {_SQL_TIME}' if k else x} * {float(n - k)}::DOUBLE" for k in range(n)]
    return f"({' + '.join(terms)}) / {n * (n + 1) / 2}::DOUBLE"


def _moment(spark: Callable, factor: Callable[[Column, int], Column]) -> Callable[[Column, int], Column]:
    return lambda x, n: _full(x, factor(spark(x).over(_rows(n)), n), n)


def average_rank(x: Column, *by: str) -> Column:
    """Average rank (ties share it) from 1 within the partition; NULL for NULL."""
    order = W.partitionBy(*by).orderBy(x.asc_nulls_last())
    ties = F.count(F.lit(1)).over(W.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(order) + (ties - 1) / 2)


def percent_rank(x: Column, *by: str) -> Column:
    return average_rank(x, *by) / F.count(x).over(W.partitionBy(*by))


def sql_average_rank(x: str, *by: str) -> str:
    b = ", ".join(by)
    lead = f"PARTITION BY {b}" if b else ""
    return f"(CASE WHEN {x} IS NOT NULL THEN rank() OVER ({lead} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {b + ', ' if b else ''}{x}) - 1) / 2 END)"


def sql_percent_rank(x: str, *by: str) -> str:
    return f"{sql_average_rank(x, *by)} / count({x}) OVER (PARTITION BY {', '.join(by)})"


def _zscore(x: Column) -> Column:
    w = W.partitionBy(DATE)
    return F.try_divide(x - F.avg(x).over(w), F.stddev_pop(x).over(w))


def _ts_zscore(x: Column, n: int) -> Column:
    w = _rows(n)
    return _full(x, F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), n)


def _both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)


def _median3(a: Column, b: Column, c: Column) -> Column:
    v = F.sort_array(F.array_compact(F.array(a, b, c)))
    n = F.size(v)
    return F.when(n == 3, F.get(v, F.lit(1))).when(n == 2, (F.get(v, F.lit(0)) + F.get(v, F.lit(1))) / 2).when(n == 1, F.get(v, F.lit(0)))


OPERATORS: dict[str, Operator] = {
    "delay": Operator(lambda x, d: F.lag(x, d).over(_time()), lambda x, d: f"lag({x}, {d}) {_SQL_TIME}", lookback=lambda d: d),
    "lead": Operator(lambda x, d: F.lead(x, d).over(_time()), lambda x, d: f"lead({x}, {d}) {_SQL_TIME}"),
    "delta": Operator(lambda x, d: x - F.lag(x, d).over(_time()), lambda x, d: f"({x} - lag({x}, {d}) {_SQL_TIME})", lookback=lambda d: d),
    "ts_mean": _rolling(F.avg, "avg"),
    "ts_sum": _rolling(F.sum, "sum"),
    "ts_max": _rolling(F.max, "max"),
    "ts_min": _rolling(F.min, "min"),
    "ts_std": _rolling(F.stddev_samp, "stddev_samp"),
    "ts_std0": _rolling(F.stddev_pop, "stddev_pop"),
    "ts_var": _rolling(F.var_samp, "var_samp"),
    "part_mean": _part(F.avg, "avg"),
    "part_std": _part(F.stddev_samp, "stddev_samp"),
    "ts_skew": Operator(
        _moment(F.skewness, lambda s, n: s * ((n * (n - 1)) ** 0.5 / (n - 2))),
        lambda x, n: _sql_full(x, f"skewness({x}) {_sql_rows(n)}", n),
        lookback=lambda n: n - 1,
    ),
    "ts_kurt": Operator(
        _moment(F.kurtosis, lambda k, n: ((n + 1) * k + 6) * ((n - 1) / ((n - 2) * (n - 3)))),
        lambda x, n: _sql_full(x, f"kurtosis({x}) {_sql_rows(n)}", n),
        lookback=lambda n: n - 1,
    ),
    "ts_zscore": Operator(_ts_zscore, lambda x, n: _sql_full(x, f"({x} - avg({x}) {_sql_rows(n)}) / nullif(stddev_samp({x}) {_sql_rows(n)}, 0)", n), lookback=lambda n: n - 1),
    "ts_cov": Operator(_cov, _sql_cov, lookback=lambda n: n - 1),
    "ts_corr": Operator(_corr, _sql_corr, lookback=lambda n: n - 1),
    "ts_rank": Operator(_ts_rank, _sql_ts_rank, lookback=lambda n: n - 1),
    "ts_argmax": Operator(_argmax, _sql_argmax, lookback=lambda n: n - 1),
    "decay_linear": Operator(_decay, _sql_decay, lookback=lambda n: n - 1),
    "rank": Operator(lambda x: percent_rank(x, DATE), lambda x: sql_percent_rank(x, DATE)),
    "group_rank": Operator(
        lambda x, g: F.when(F.col(g).isNotNull(), percent_rank(x, DATE, g)), lambda x, g: f"CASE WHEN {g} IS NOT NULL THEN {sql_percent_rank(x, DATE, g)} END"
    ),
    "zscore": Operator(_zscore, lambda x: f"({x} - avg({x}) OVER (PARTITION BY {DATE})) / nullif(stddev_pop({x}) OVER (PARTITION BY {DATE}), 0)"),
    "abs": Operator(F.abs, lambda x: f"abs({x})", False),
    "sign": Operator(F.signum, lambda x: f"sign({x})::DOUBLE", False),
    "ln": Operator(F.ln, lambda x: f"(CASE WHEN {x} > 0 THEN ln({x}) END)", False),
    "exp": Operator(F.exp, lambda x: f"exp({x})", False),
    "sqrt": Operator(lambda x: F.when(x >= 0, F.sqrt(x)), lambda x: f"(CASE WHEN {x} >= 0 THEN sqrt({x}) END)", False),
    "power": Operator(lambda x, p: F.pow(x, F.lit(p)), lambda x, p: f"pow({x}, {p}::DOUBLE)", False),
    "signed_power": Operator(lambda x, p: F.signum(x) * F.pow(F.abs(x), F.lit(p)), lambda x, p: f"(sign({x}) * pow(abs({x}), {p}::DOUBLE))", False),
    "at_least": Operator(lambda x, y: _both(x, y, F.greatest(x, y)), lambda x, y: f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN greatest({x}, {y}) END)", False),
    "at_most": Operator(lambda x, y: _both(x, y, F.least(x, y)), lambda x, y: f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN least({x}, {y}) END)", False),
    "over_positive": Operator(lambda x, y: F.when(y > 0, x / y), lambda x, y: f"(CASE WHEN {y} > 0 THEN {x} / {y} END)", False),
    "median3": Operator(_median3, lambda a, b, c: f"list_median([{a}, {b}, {c}])", False),
}


def call(op: str, *args) -> Call:
    """`op` of expressions and then plain parameters; an unknown name lists the known ones."""
    if op not in OPERATORS:
        raise KeyError(f"unknown operator {op!r}; known: {', '.join(sorted(OPERATORS))}")
    inputs = tuple(a for a in args if isinstance(a, Expression))
    return Call(op, inputs, tuple(a for a in args if not isinstance(a, Expression)))


def __getattr__(name: str):
    if name in OPERATORS:
        return lambda *args: call(name, *args)
    raise AttributeError(name)


def _stages(expressions: dict[str, Expression]) -> list[list[Call]]:
    """Windowed calls by depth: each needs only columns of earlier stages."""
    depth: dict[Expression, int] = {}

    def level(e: Expression) -> int:
        if e not in depth:
            below = max((level(c) for c in e.children()), default=0)
            depth[e] = below + (isinstance(e, Call) and OPERATORS[e.op].windowed)
        return depth[e]

    top = max((level(e) for e in expressions.values()), default=0)
    seen: dict[Expression, None] = {}
    for e in expressions.values():
        seen.update(dict.fromkeys(e.walk()))
    staged = [e for e in seen if isinstance(e, Call) and OPERATORS[e.op].windowed]
    return [[e for e in staged if depth[e] == k] for k in range(1, top + 1)]


def _spark(e: Expression, names: dict[Expression, str]) -> Column:
    if e in names:
        return F.col(names[e])
    match e:
        case Var(name):
            return F.col(name).cast("double")
        case Const(value):
            return F.lit(float(value))
        case Negative(of):
            return -_spark(of, names)
        case Binary("/", left, right):
            return F.try_divide(_spark(left, names), _spark(right, names))
        case Binary(op, left, right):
            a, b = _spark(left, names), _spark(right, names)
            return {"+": a + b, "-": a - b, "*": a * b}[op]
        case Compare(op, left, right):
            a, b = _spark(left, names), _spark(right, names)
            return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op].cast("double")
        case Where(condition, yes, no):
            c = _spark(condition, names)
            return F.when(c.isNull(), None).when(c > 0, _spark(yes, names)).otherwise(_spark(no, names))
        case Call(op, args, params):
            return OPERATORS[op].column(*[_spark(a, names) for a in args], *params)
    raise TypeError(f"not an expression: {e!r}")


def _sql(e: Expression, names: dict[Expression, str]) -> str:
    if e in names:
        return names[e]
    match e:
        case Var(name):
            return f"{name}::DOUBLE"
        case Const(value):
            return f"{float(value)!r}::DOUBLE"
        case Negative(of):
            return f"(-{_sql(of, names)})"
        case Binary("/", left, right):
            return f"({_sql(left, names)} / nullif({_sql(right, names)}, 0))"
        case Binary(op, left, right):
            return f"({_sql(left, names)} {op} {_sql(right, names)})"
        case Compare(op, left, right):
            return f"({_sql(left, names)} {'=' if op == '==' else op} {_sql(right, names)})::INT::DOUBLE"
        case Where(condition, yes, no):
            c = _sql(condition, names)
            return f"(CASE WHEN {c} IS NULL THEN NULL WHEN {c} > 0 THEN {_sql(yes, names)} ELSE {_sql(no, names)} END)"
        case Call(op, args, params):
            return OPERATORS[op].sql(*[_sql(a, names) for a in args], *params)
    raise TypeError(f"not an expression: {e!r}")


def _columns(e: Expression, names: dict[Expression, str]) -> set[str]:
    """The columns that `e` is computed from, once `names` are columns."""
    if e in names:
        return {names[e]}
    own = {e.name} if isinstance(e, Var) else {e.params[0]} if isinstance(e, Call) and e.op == "group_rank" else set()
    return own.union(*[_columns(c, names) for c in e.children()])


def evaluate(panel: DataFrame, expressions: dict[str, Expression], keep: list[str] | None = None) -> DataFrame:
    """`panel` (or only its columns `keep`) with one column for each expression.

    Full windows and ranks of all levels wait until a call needs one of them, and are then computed in one pass over
    instruments and one over dates. Passes carry only columns that are still needed.
    """
    missing = sorted(set().union(*[e.required_inputs for e in expressions.values()]) - set(panel.columns))
    if missing:
        raise ValueError(f"the panel has no column {', '.join(missing)}")
    kept = panel.columns if keep is None else keep
    names: dict[Expression, str] = {}
    stages = _stages(expressions)
    left = dict.fromkeys(e for stage in stages for e in stage)
    number = {e: f"_x{i}" for i, e in enumerate(left)}

    def passed(panel: DataFrame, calls: list[Call], run: Callable) -> DataFrame:
        for e in calls:
            left.pop(e)
        after = {e: number[e] for e in calls} | names
        needed = set().union(kept, *[_columns(e, after) for e in expressions.values()], *[_columns(e, after) for e in left])
        inputs = {a: f"_in{i}" for i, a in enumerate(dict.fromkeys(a for e in calls for a in e.args))}
        held = [c for c in panel.columns if c in needed | {INSTRUMENT, DATE}]
        panel = run(panel.select(*held, *[_spark(a, names).alias(n) for a, n in inputs.items()]), inputs, held)
        names.update({e: number[e] for e in calls})
        return panel

    def flushed(panel: DataFrame, calls: list[Call]) -> DataFrame:
        ranks, windows = [e for e in calls if e.op == "rank"], [e for e in calls if e.op != "rank"]
        if ranks:
            panel = passed(panel, ranks, lambda p, inputs, held: ranked(p, {number[e]: inputs[e.args[0]] for e in ranks}, held, [DATE]))
        if windows:
            panel = passed(panel, windows, lambda p, inputs, held: rolled(p, {number[e]: (e.op, tuple(inputs[a] for a in e.args), e.params[0]) for e in windows}, held, INSTRUMENT, DATE))
        return panel

    def staged(panel: DataFrame, calls: list[Call]) -> DataFrame:
        if calls:
            panel = panel.withColumns({number[e]: _spark(e, names) for e in calls})
        for e in calls:
            names[e] = number[e]
            left.pop(e)
        return panel

    waits = lambda e: e.op == "rank" or e.op in ROLLING
    waiting: list[Call] = []
    for stage in stages:
        late = [e for e in stage if any(d in waiting for d in e.walk())]
        soon = [e for e in stage if e not in late]
        panel = staged(panel, [e for e in soon if not waits(e)])
        waiting += [e for e in soon if waits(e)]
        if late:
            panel, waiting = flushed(panel, waiting), [e for e in late if waits(e)]
            panel = staged(panel, [e for e in late if not waits(e)])
    panel = flushed(panel, waiting)
    return panel.select(*kept, *[_spark(e, names).alias(n) for n, e in expressions.items()])


#: Added before rounding: prices are quotients whose digits often end in a tie, which engines round differently.
NUDGE = 1.23456e-8


def rounded(x: Column) -> Column:
    return F.round(x + F.lit(NUDGE), 6)


def sql_rounded(x: str) -> str:
    return f"round({x} + {NUDGE}::DOUBLE, 6)"


def to_sql(source: str, expressions: dict[str, Expression], select: str) -> str:
    """Common table expressions from table `source` on, then `SELECT {select}, each expression rounded`."""
    names: dict[Expression, str] = {}
    tables, last = [], source
    for k, stage in enumerate(_stages(expressions)):
        new = {f"_x{len(names) + i}": e for i, e in enumerate(stage)}
        columns = ", ".join(f"{_sql(e, names)} AS {n}" for n, e in new.items())
        tables.append(f"stage{k} AS (SELECT *, {columns} FROM {last})")
        names |= {e: n for n, e in new.items()}
        last = f"stage{k}"
    out = ", ".join(f"{sql_rounded(_sql(e, names))} AS {n}" for n, e in expressions.items())
    return ",\n".join(["", *tables]) + f"\nSELECT {select}, {out} FROM {last}"
