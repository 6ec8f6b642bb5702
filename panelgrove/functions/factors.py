"""The factor operators: element-wise, per code over time (``ts_``), per date (``cs_``), per date
and sector (``grp_``).

A :class:`Book` gathers expressions over one panel (code, date, seq, sector and number columns).
Window functions can't hold each other, so every window becomes a column of a stage. Stages make up
phases: windows over time stand in odd phases and windows across codes in even ones, each in the first
whose inputs are ready. However many factors a book holds, all of one phase share a shuffle by code or
by date, and equal windows are computed once. Values are doubles, missing ones are null.

The texts are SQL that Spark and the checking engine both read; where they differ, both are given.

A panel of few codes with long histories is cut into chunks of rows, each of which gets a halo of the rows
that its windows reach back to; a panel of few dates with many codes is ranked by value counts in buckets.
Either way no task needs to hold a code or a date, and results are the same (:meth:`Book.frame`).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.written import written
from .panels import Across, Running, across_wide, halo, running_totals, unhalo
from .scan import Smoothing, smoothed
from .shown import trimmed

Number = "Ex | float | int"


class Ex:
    """An expression of a book: its text for Spark and for the checking engine, and the last stage it reads."""

    __hash__ = None

    def __init__(self, book: Book, s: str, d: str, level: int = 0):
        self.book, self.s, self.d, self.level = book, s, d, level

    def __add__(self, o):
        return _row("({} + {})", self, o)

    def __radd__(self, o):
        return _row("({} + {})", o, self)

    def __sub__(self, o):
        return _row("({} - {})", self, o)

    def __rsub__(self, o):
        return _row("({} - {})", o, self)

    def __mul__(self, o):
        return _row("({} * {})", self, o)

    def __rmul__(self, o):
        return _row("({} * {})", o, self)

    def __truediv__(self, o):
        return _row("({} / nullif({}, 0))", self, o)

    def __rtruediv__(self, o):
        return _row("({} / nullif({}, 0))", o, self)

    def __neg__(self):
        return _row("(-{})", self)

    def __pow__(self, o):
        return signedpower(self, o)

    def __rpow__(self, o):
        return signedpower(o, self)

    def __lt__(self, o):
        return _flag("{} < {}", self, o)

    def __gt__(self, o):
        return _flag("{} > {}", self, o)

    def __le__(self, o):
        return _flag("{} <= {}", self, o)

    def __ge__(self, o):
        return _flag("{} >= {}", self, o)

    def __eq__(self, o):
        return _flag("{} = {}", self, o)

    def __ne__(self, o):
        return 1.0 - _flag("{} = {}", self, o)

    def __or__(self, o):
        return _flag("{} > 0 OR {} > 0", self, o)

    def __and__(self, o):
        return _flag("{} > 0 AND {} > 0", self, o)


#: Stages are numbered phase * PHASE + step.
PHASE = 1000


@dataclass(frozen=True)
class Def:
    """A column of a stage: for Spark a text, a :class:`Running`, a :class:`Smoothing` or an :class:`Across`; its
    text for the checking engine; and how many rows it reads before and behind its own."""

    s: str | Running | Smoothing | Across
    d: str
    back: int = 0
    ahead: int = 0

    @property
    def bounded(self) -> bool:
        return not isinstance(self.s, Running | Smoothing)


class Book:
    """Expressions over one panel, staged together."""

    def __init__(self):
        self.stages: dict[int, dict[str, Def]] = {}
        self.names: dict[tuple, Ex] = {}

    def __getattr__(self, name: str) -> Ex:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.field(name)

    def field(self, name: str) -> Ex:
        """A column of the panel; ``advN`` is the mean traded value of N rows."""
        if name == "returns":
            return ts_returns(self.field("close"), 1)
        if name.startswith("adv") and name[3:].isdigit():
            n = int(name[3:])
            return _rolling(self.field("volume") * self.field("close"), n, "avg({x})", least=max(2, n // 2))
        return Ex(self, name, name)

    def staged(self, across: bool, made: Def, level: int) -> Ex:
        """A window over time (odd phase) or across codes (even phase) of inputs up to ``level``. A window
        of a window of its own kind stays in the phase, one step on."""
        phase, step = divmod(level, PHASE)
        if level == 0:
            at = (1 + across) * PHASE
        else:
            at = phase * PHASE + step + 1 if (phase % 2 == 0) == across else (phase + 1) * PHASE
        key = (at, made.s if isinstance(made.s, str) else made.d)
        if key not in self.names:
            name = f"f{sum(map(len, self.stages.values()))}"
            self.stages.setdefault(at, {})[name] = made
            self.names[key] = Ex(self, name, name, at)
        return self.names[key]

    def frame(self, panel: DataFrame, outputs: dict[str, Ex], keep: list[str] = ("code", "date"), chunk: int | None = None, wide: bool = False) -> DataFrame:
        """``panel``'s columns ``keep`` and the outputs. With ``chunk``, histories are evaluated in runs of so many
        rows (for few codes with many rows each), with ``wide``, dates are ranked in buckets (for few dates with
        many codes each)."""
        out = panel
        for phase, stages in groupby(sorted(self.stages.items()), lambda x: x[0] // PHASE):
            steps = [defs for _, defs in stages]
            # Tables that are written hold no columns but those that this phase, later ones and the outputs read.
            texts = [x.d for at, defs in self.stages.items() if at // PHASE >= phase for x in defs.values()] + [e.s for e in outputs.values()]
            needed = {*re.findall(r"\w+", " ".join(texts)), *keep, "code", "date", "seq", "sector"}
            if phase % 2 == 0:
                for defs in steps:
                    out = across_wide(_cut(out, needed), {n: x.s for n, x in defs.items()}) if wide else _across_plain(out, defs)
            elif chunk:
                out = _in_chunks(out, steps, int(chunk), needed)
            else:
                for defs in steps:
                    out = _over_time(out, defs)
        return out.select(*keep, *[F.expr(e.s).alias(n) for n, e in outputs.items()])

    def sql(self, panel: str, outputs: dict[str, Ex], keep: list[str] = ("code", "date"), shape: Callable[[str], str] = str) -> str:
        """The same as SQL for the checking engine; ``shape`` wraps every output."""
        parts, last = [f"p0 AS ({panel})"], "p0"
        for at, defs in sorted(self.stages.items()):
            parts.append(f"p{at} AS (SELECT *, " + ", ".join(f"{x.d} AS {n}" for n, x in defs.items()) + f" FROM {last})")
            last = f"p{at}"
        shown = ", ".join(f"{shape(e.d)} AS {n}" for n, e in outputs.items())
        return f"WITH {', '.join(parts)} SELECT {', '.join(keep)}, {shown} FROM {last}"


def _cut(rows: DataFrame, needed: set[str]) -> DataFrame:
    return written(rows.select(*[c for c in rows.columns if c in needed]), "panel")


def _over_time(rows: DataFrame, defs: dict[str, Def]) -> DataFrame:
    plain: list[Column] = [(x.s.column() if isinstance(x.s, Running) else F.expr(x.s)).alias(n) for n, x in defs.items() if not isinstance(x.s, Smoothing)]
    helpers = {n: x.s for n, x in defs.items() if isinstance(x.s, Smoothing)}
    out = rows.select("*", *plain) if plain else rows
    return smoothed(out, helpers) if helpers else out


def _across_plain(rows: DataFrame, defs: dict[str, Def]) -> DataFrame:
    # Windows read the columns of earlier stages only, so those by date can go first: rows that
    # are dealt by date need no other exchange for windows by date and sector.
    for sectors in (False, True):
        own = [F.expr(x.s.text()).alias(n) for n, x in defs.items() if x.s.sectors == sectors]
        rows = rows.select("*", *own) if own else rows
    return rows


def _in_chunks(rows: DataFrame, steps: list[dict[str, Def]], size: int, needed: set[str]) -> DataFrame:
    """The steps of a phase over time with every code's history in runs of ``size`` rows. What reads a bounded
    number of rows finds them in a halo as deep as all steps together; what reads the whole history
    is done on the runs alone, and ends the halo's use."""
    while steps:
        n = next((i + 1 for i, defs in enumerate(steps) if not all(x.bounded for x in defs.values())), len(steps))
        now, steps = steps[:n], steps[n:]
        reach = [sum(max((getattr(x, side) for x in defs.values()), default=0) for defs in now) for side in ("back", "ahead")]
        out = halo(rows, size, *reach)
        for defs in now:
            texts = [F.expr(x.s.replace(_ORDER, f"PARTITION BY code, {halo.PART} ORDER BY date")).alias(c) for c, x in defs.items() if x.bounded]
            out = out.select("*", *texts) if texts else out
        out = unhalo(out)
        whole = {c: x.s for c, x in now[-1].items() if not x.bounded}
        if whole:  # parts and their totals both come from these rows
            out = _cut(out, needed | {halo.PART})
        out = running_totals(out, {c: x for c, x in whole.items() if isinstance(x, Running)})
        helpers = {c: x for c, x in whole.items() if isinstance(x, Smoothing)}
        rows = (smoothed(out, helpers, halo.PART, size) if helpers else out).drop(halo.PART)
    return rows


def _text(x, which: str) -> str:
    if isinstance(x, Ex):
        return getattr(x, which)
    v = repr(float(x))
    return f"CAST('{v}' AS DOUBLE)" if "e" in v else f"CAST({v} AS DOUBLE)"


def _row(text: str, *args, d: str | None = None) -> Ex:
    """A row-wise expression."""
    book = next(a.book for a in args if isinstance(a, Ex))
    level = max(a.level for a in args if isinstance(a, Ex))
    return Ex(book, text.format(*[_text(a, "s") for a in args]), (d or text).format(*[_text(a, "d") for a in args]), level)


def _flag(text: str, *args) -> Ex:
    return _row("CAST(CASE WHEN " + text + " THEN 1 ELSE 0 END AS DOUBLE)", *args)


# Element-wise.


def absolute(x):
    return _row("abs({})", x)


def sign(x):
    return _row("CAST(sign({}) AS DOUBLE)", x)


def log(x):
    return _row("CASE WHEN {0} > 0 THEN ln({0}) END", x)


def log1p(x):
    return _row("CASE WHEN {0} > -1 THEN ln(1 + {0}) END", x)


def sqrt(x):
    return _row("CASE WHEN {0} >= 0 THEN sqrt({0}) END", x)


def exp(x):
    return _row("CASE WHEN {0} IS NOT NULL THEN exp(greatest(least({0}, 50), -50)) END", x)


def signedpower(x, y):
    """sign(x) |x|^y; missing where |x| is 0 and y negative."""
    return _row("CASE WHEN {0} <> 0 OR {1} >= 0 THEN CAST(sign({0}) AS DOUBLE) * pow(abs({0}), {1}) END", x, y)


def smaller(x, y):
    return _row("least({}, {})", x, y)


def larger(x, y):
    return _row("greatest({}, {})", x, y)


def where(c, x, y):
    return _row("CASE WHEN {} > 0 THEN {} ELSE {} END", c, x, y)


# Per code over time.

_ORDER = "PARTITION BY code ORDER BY date"


def _least(w: int) -> int:
    return min(w, max(2, w // 2))


def _frame(w: int) -> str:
    return f"({_ORDER} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def _windowed(text: str, w: str) -> str:
    """Put the frame behind every aggregate, which texts mark by ``@``."""
    return text.replace("@", f" OVER {w}")


def _rolling(x: Ex, w, agg: str, least: int | None = None, d: str | None = None, full: bool = False, more: str = "") -> Ex:
    """``agg`` over the last w rows where enough of them (or, with ``full``, all) have a value."""
    w = max(1, int(w))
    least = _least(w) if least is None else min(w, least)

    def text(a: str, xs: str) -> str:
        if "@" not in a:
            a += "@"
        guard = f"count({xs})@ >= {least}" + (f" AND count({xs})@ = count(*)@" if full else "") + more
        return _windowed(f"CASE WHEN {guard.format(x=xs)} THEN {a.format(x=xs)} END", _frame(w))

    return x.book.staged(False, Def(text(agg, x.s), text(d or agg, x.d), w - 1), x.level)


def ts_delay(x, n):
    n = int(n)
    text = f"lag({{}}, {n})" if n >= 0 else f"lead({{}}, {-n})"
    return x.book.staged(False, Def(f"{text.format(x.s)} OVER ({_ORDER})", f"{text.format(x.d)} OVER ({_ORDER})", max(n, 0), max(-n, 0)), x.level)


def ts_delta(x, n):
    return x - ts_delay(x, n)


def ts_returns(x, n):
    return x / ts_delay(x, n) - 1


def ts_mean(x, w):
    return _rolling(x, w, "avg({x})")


#: Spark's variance as a covariance with itself: its own adds up deviations in another order of operations than the checking
#: engine, which shows where values differ in their last digits only. This way both take the same steps, row by row.
_VAR = "covar_samp({x}, {x})@"


def ts_std(x, w):
    return _rolling(x, w, f"sqrt({_VAR})", d="stddev_samp({x})", more=" AND count({x})@ > 1")


def ts_var(x, w):
    return _rolling(x, w, _VAR, d="var_samp({x})", more=" AND count({x})@ > 1")


def ts_sum(x, w):
    return _rolling(x, w, "sum({x})")


def ts_min(x, w):
    return _rolling(x, w, "min({x})")


def ts_max(x, w):
    return _rolling(x, w, "max({x})")


def ts_quantile(x, w, q):
    return _rolling(x, max(2, int(w)), f"percentile({{x}}, {q})", d=f"quantile_cont({{x}}, {q})")


def ts_median(x, w):
    return ts_quantile(x, w, 0.5) if int(w) > 1 else x


def ts_skew(x, w):
    n = "count({x})@"
    s = f"CASE WHEN max({{x}})@ = min({{x}})@ THEN 0 ELSE skewness({{x}})@ * sqrt(CAST({n} * ({n} - 1) AS DOUBLE)) / ({n} - 2) END"
    d = "CASE WHEN max({x})@ = min({x})@ THEN 0 ELSE skewness({x})@ END"
    return _rolling(x, w, s, d=d, more=f" AND {n} > 2")


def ts_rank(x, w):
    """Average rank of the current value among its window's, as a share of them; values are compared to nine digits."""
    x = Ex(x.book, f"({trimmed(x.s)})", f"({trimmed(x.d)})", x.level)
    own = "element_at(collect_list({x})@, -1)"  # the row's own value, without computing it for each element
    s = f"(size(filter(collect_list({{x}})@, e -> e < {own})) + (size(filter(collect_list({{x}})@, e -> e = {own})) + 1) / CAST(2 AS DOUBLE)) / count({{x}})@"
    d = "(len(list_filter(list({x})@, lambda e: e < {x})) + (len(list_filter(list({x})@, lambda e: e = {x})) + 1) / CAST(2 AS DOUBLE)) / count({x})@"
    return _rolling(x, w, s, d=d, more=" AND {x} IS NOT NULL")


def ts_product(x, w):
    s = "aggregate(collect_list({x})@, CAST(1 AS DOUBLE), (a, e) -> a * e)"
    return _rolling(x, w, s, d="product({x})", full=True)


def _extreme(x, w, s: str, d: str):
    return _rolling(x, w, s, d=d, full=True)


def ts_argmax(x, w):
    """Rows since the largest value; of equal ones the oldest counts."""
    return _extreme(x, w, "CAST(seq + max(named_struct('x', {x}, 'm', -seq))@.m AS DOUBLE)", "CAST(seq + (max(struct_pack(x := {x}, m := -seq))@).m AS DOUBLE)")


def ts_argmin(x, w):
    return _extreme(x, w, "CAST(seq - min(named_struct('x', {x}, 'm', seq))@.m AS DOUBLE)", "CAST(seq - (min(struct_pack(x := {x}, m := seq))@).m AS DOUBLE)")


def ts_slope(x, w):
    return _rolling(x, w, "regr_slope({x}, CAST(seq AS DOUBLE))", full=True, more=" AND count({x})@ > 1")


def ts_rsquare(x, w):
    return _rolling(x, w, "CASE WHEN max({x})@ > min({x})@ THEN regr_r2({x}, CAST(seq AS DOUBLE))@ END", full=True, more=" AND count({x})@ > 1")


def ts_resi(x, w):
    fit = "(regr_intercept({x}, CAST(seq AS DOUBLE))@ + regr_slope({x}, CAST(seq AS DOUBLE))@ * seq)"
    return x - _rolling(x, w, fit, full=True, more=" AND count({x})@ > 1")


def ts_decay_linear(x, w):
    """Weights 1 to n, the newest heaviest, n being the rows the frame holds."""
    n = "count(*)@"
    return _rolling(x, w, f"(sum({{x}} * seq)@ - (min(seq)@ - 1) * sum({{x}})@) / ({n} * ({n} + 1) / CAST(2 AS DOUBLE))", full=True)


def _running(x, product: bool):
    w = f"({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    d = f"CASE WHEN {x.d} IS NOT NULL THEN {'product' if product else 'sum'}({x.d}) OVER {w} END"
    return x.book.staged(False, Def(Running(x.s, product), d), x.level)


def ts_cumsum(x):
    return _running(x, False)


def ts_cumprod(x):
    return _running(x, True)


def ts_ewm(x, span):
    """Exponential mean of a span of at least 2, from 2 values on; gaps let old weights fade."""
    keep = 1 - 2.0 / (max(2, int(span)) + 1)
    w = f"({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    every = f"list({x.d}) OVER {w}"
    power = f"pow(CAST({keep!r} AS DOUBLE), len({every}) - i)"
    top = f"list_sum(list_transform({every}, lambda e, i: e * {power}))"
    low = f"list_sum(list_transform({every}, lambda e, i: CASE WHEN e IS NOT NULL THEN {power} END))"
    d = f"CASE WHEN count({x.d}) OVER {w} >= 2 THEN {top} / {low} END"
    return x.book.staged(False, Def(Smoothing(x.s, 1 - keep, True), d), x.level)


def ts_sma_cn(x, n, m):
    """y = (m/n) x + (1 - m/n) y', started by the first value. A gap keeps the last one, and lets its weight
    fade by 1 - m/n a row."""
    if not 0 < m <= n:
        raise ValueError("0 < m <= n")
    a = m / n
    w = f"({_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    old, new = f"pow(CAST({1 - a!r} AS DOUBLE), e.s - y.s)", f"CAST({a!r} AS DOUBLE)"
    step = f"struct_pack(v := ({old} * y.v + {new} * e.v) / ({old} + {new}), s := e.s)"
    d = f"(list_reduce(list(struct_pack(v := {x.d}, s := CAST(seq AS DOUBLE))) FILTER (WHERE {x.d} IS NOT NULL) OVER {w}, lambda y, e: {step})).v"
    d = f"CASE WHEN count({x.d}) OVER {w} > 0 THEN {d} END"
    return x.book.staged(False, Def(Smoothing(x.s, a, False), d), x.level)


def _pair(x: Ex, y: Ex, w, agg: str) -> Ex:
    """``agg`` names the sides ``{u}`` and ``{v}``, their deviations ``{su}`` and ``{sv}``, and their covariance ``{cov}``."""
    w = max(2, int(w))

    def text(a: str, b: str, deviation: str, cov: str) -> str:
        u, v = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
        made = agg.format(u=u, v=v, su=deviation.format(x=u), sv=deviation.format(x=v), cov=cov.format(u=u, v=v))
        return _windowed(f"CASE WHEN count({u})@ >= {_least(w)} THEN {made} END", _frame(w))

    # The engines take the sides the other way round: the mean of which is updated before the product.
    s = text(x.s, y.s, f"sqrt({_VAR})", "covar_samp({v}, {u})@")
    d = text(x.d, y.d, "stddev_samp({x})@", "covar_samp({u}, {v})@")
    return x.book.staged(False, Def(s, d, w - 1), max(x.level, y.level))


def ts_corr(x, y, w):
    """Correlation of the rows where both have a value; rounded to 10 digits, so that equal
    correlations stay equal. Missing where a side varies by no more than rounding does."""
    varies = " AND ".join(f"{{s{c}}} > 1e-12 * abs(avg({{{c}}})@)" for c in "uv")
    return _pair(x, y, w, f"CASE WHEN {varies} THEN round({{cov}} / ({{su}} * {{sv}}), 10) END")


def ts_cov(x, y, w):
    """Covariance of such rows; rounded to 12 digits of what it could be at most, for the same reason."""
    size = "({su} * {sv})"
    return _pair(x, y, w, f"CASE WHEN {size} > 0 THEN round({{cov}} / {size}, 12) * {size} ELSE CAST(0 AS DOUBLE) END")


# Per date, and per date and sector.


def _across(x: Ex, kind: str, sectors: bool = False) -> Ex:
    return x.book.staged(True, Def(Across(kind, x.s, sectors), Across(kind, x.d, sectors).text()), x.level)


def cs_rank(x):
    return _across(x, "rank")


def cs_scale(x):
    return _across(x, "scale")


def cs_mean(x):
    return _across(x, "mean")


def cs_std(x):
    return _across(x, "std")


def cs_median(x):
    return _across(x, "median")


def grp_mean(x):
    return _across(x, "mean", True)


def grp_demean(x):
    return x - grp_mean(x)


def grp_rank(x):
    return _across(x, "rank", True)
