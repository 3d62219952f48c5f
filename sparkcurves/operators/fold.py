"""The sequential part of a bootstrap, as one SQL expression over a curve's arrays.

A row holds `pillars` (in order) and `grid`, the payment dates k = 0, 1, ... counted from spot.
The fold walks the pillars; at each one it looks at the grid dates in the gap since the pillar
before and carries

    t, l      day and ln df of the last pillar          g         last grid index passed
    cum, lf   running leg value and ln df by grid index  anchor    ln df at spot
    out       day, ln df and residual of every pillar

In the gap ln df is linear in the unknown, so every par instrument ends as

    const + sum_i  p_i * exp(a_i + b_i * y) = 0,      y = ln df(new) - ln df(last)

which Newton's method solves; with a single term it is solved outright. Where all p_i are positive and the b_i have one sign, the
root is bracketed: at y_i = (ln(-const / p_i) - a_i) / b_i one term alone pays -const, so the nearest of these is on the side where
the sum is not negative. The sum is convex and monotone, so Newton's steps from there go to the root without passing it, whatever the
rate. Otherwise (negative rates) they start from y = 0. A pillar that is not solved, and all pillars after it, are NULL.

It is SQL text because the same tree made of Column objects takes seconds to build.
"""

from __future__ import annotations

# From the bracket a few steps suffice; a pillar that is still not there is unsolved.
NEWTON_STEPS = 64
TOLERANCE = "1e-10D"  # largest residual of a solved pillar
# A step this small leaves an error of about its square; the steps left over are skipped.
CLOSE_ENOUGH = "1e-10D"

_START = """named_struct(
    't', 0, 'l', 0D, 'g', -1, 'anchor', 0D, 'ok', true,
    'cum', cast(array() AS array<double>), 'lf', cast(array() AS array<double>),
    'out', cast(array() AS array<struct<t:int,x:double,r:double>>))"""

# Share of the gap passed at a day of the gap.
_WEIGHT = "if(p.days > acc.t, ({day} - acc.t) / (p.days - acc.t), 1D)"


def _let(name: str, value: str, body: str) -> str:
    """SQL lambdas have no local names; a one-element transform makes one."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _weight(day: str) -> str:
    return _WEIGHT.format(day=day)


def _value(y: str) -> str:
    """f and df/dy of the equation `e` at y."""
    step = _let("v", f"w.p * exp(w.a + w.b * {y})", "named_struct('f', s.f + v, 'df', s.df + v * w.b)")
    return f"aggregate(e.terms, named_struct('f', e.const, 'df', 0D), (s, w) -> {step})"


def _bracket() -> str:
    """The end of the root's bracket from which Newton's steps cannot pass it; 0 where there is none."""
    moving = "filter(e.terms, m -> m.b <> 0D)"
    still = "aggregate(e.terms, e.const, (c, m) -> if(m.b = 0D, c + m.p * exp(m.a), c))"
    alone = "transform(moving, m -> (ln(-still / m.p) - m.a) / m.b)"
    sided = f"if(moving[0].b > 0D, array_min({alone}), array_max({alone}))"
    fits = "still < 0D AND size(moving) > 0 AND forall(moving, m -> m.p > 0D AND sign(m.b) = sign(moving[0].b))"
    return _let("moving", moving, _let("still", still, f"if({fits}, {sided}, 0D)"))


def _solution() -> str:
    """x = ln df of the new pillar and the residual r left by the equation `e`."""
    move = _let(
        "n", _value("at.y"),
        _let("h", "try_divide(n.f, n.df)", f"named_struct('y', at.y - h, 'near', abs(h) <= {CLOSE_ENOUGH})"),
    )
    iterated = (
        f"aggregate(sequence(1, {NEWTON_STEPS}), named_struct('y', {_bracket()}, 'near', false), "
        f"(at, i) -> if(at.near, at, {move}), at -> at.y)"
    )
    only = "e.terms[0]"
    outright = f"try_divide(ln(try_divide(-e.const, {only}.p)) - {only}.a, {only}.b)"
    return _let(
        "z", f"if(size(e.terms) = 1, {outright}, {iterated})",
        f"named_struct('x', acc.l + z, 'r', {_value('z')}.f)",
    )


def _known() -> str:
    """Running value of the leg over the instrument's grid dates that are already known."""
    index = "least(p.payments - 1, acc.g)"
    return f"if({index} >= 0, get(acc.cum, {index}), 0D)"


def _bond_equation() -> str:
    """Quoted at `target`: coupons on the known annuity, coupons in the gap, the last payment."""
    coupons = (
        "transform(filter(gap, s -> s.k > 0 AND s.k < p.payments), "
        f"s -> named_struct('p', p.rate * s.tau, 'a', acc.l, 'b', {_weight('s.d')}))"
    )
    last = "named_struct('p', 1D + p.rate * p.last_fraction, 'a', acc.l, 'b', 1D)"
    return f"""named_struct(
        'const', p.rate * {_known()} - p.target,
        'terms', concat({coupons}, array({last})))"""


def _swap_equation() -> str:
    """Floating leg worth `target`: each period pays the ratio of two factors less 1.

    Every period also pays -P at its end; for the last one the notional's +P cancels that.
    """
    start = "if(i = 0, get(acc.lf, acc.g) - acc.l, 0D)"
    slope = f"if(i = 0, 0D, {_weight('get(own, i - 1).d')}) - {_weight('s.d')}"
    periods = f"transform(own, (s, i) -> named_struct('p', s.discount, 'a', {start}, 'b', {slope}))"
    known_start = "p.payments - 1 <= acc.g"
    last = f"""named_struct(
        'p', p.discount,
        'a', if({known_start}, get(acc.lf, p.payments - 1) - acc.l, 0D),
        'b', if({known_start}, -1D, {_weight('get(own, size(own) - 1).d')} - 1D))"""
    paid = "aggregate(own, 0D, (total, s) -> total + s.discount)"
    equation = f"""named_struct(
        'const', {_known()} - {paid} - p.target,
        'terms', concat({periods}, array({last})))"""
    return _let("own", "filter(gap, s -> s.k < p.payments)", equation)


def _log_df_so_far(day: str) -> str:
    """ln df on the pillars solved so far: log-linear, flat outside."""
    inside = f"b.lo.x + (b.hi.x - b.lo.x) * ({day} - b.lo.t) / (b.hi.t - b.lo.t)"
    between = _let(
        "b", "named_struct('lo', get(acc.out, n - 1), 'hi', get(acc.out, n))",
        f"if(n = 0, b.hi.x, if(b.hi IS NULL, b.lo.x, {inside}))",
    )
    return _let("n", f"size(filter(acc.out, o -> o.t <= {day}))", between)


def _closed_form(anchored: bool) -> str:
    """Overnights compound; cash starts at spot; a future starts where the one before ended,
    the first one wherever its strip starts on the curve so far."""
    strip = f"if(get(acc.out, size(acc.out) - 1).t = p.future_start, acc.l, {_log_df_so_far('p.future_start')})"
    return f"""ln(p.simple_df) + CASE
        WHEN p.type_rate = 'OverNight' THEN acc.anchor
        WHEN p.type_rate = 'Cash' THEN {'acc.anchor' if anchored else '0D'}
        ELSE {strip} END"""


def _advance(dual: bool) -> str:
    left = "if(size(acc.out) = 0, s.x, acc.l)"
    factors = _let("q", left, f"transform(gap, c -> q + (s.x - q) * {_weight('c.d')})")
    if dual:
        start = "if(i > 0, get(f, i - 1), get(acc.lf, acc.g))"
        gains = f"transform(gap, (c, i) -> if(c.k > 0, (exp({start} - f[i]) - 1D) * c.discount, 0D))"
    else:
        gains = "transform(gap, (c, i) -> c.tau * exp(f[i]))"
    carried = "coalesce(get(acc.cum, size(acc.cum) - 1), 0D)"
    added = f"array(coalesce(get(c, size(c) - 1), {carried}) + v)"
    running = f"concat(acc.cum, aggregate({gains}, cast(array() AS array<double>), (c, v) -> concat(c, {added})))"
    state = f"""named_struct(
        't', p.days, 'l', s.x, 'g', greatest(acc.g, p.grid_count),
        'anchor', if(p.type_rate = 'OverNight', s.x, acc.anchor), 'ok', s.r IS NOT NULL,
        'cum', {running}, 'lf', concat(acc.lf, f),
        'out', concat(acc.out, array(named_struct('t', p.days, 'x', s.x, 'r', s.r))))"""
    return _let("f", factors, state)


def fold_sql(dual: bool, anchored: bool) -> str:
    """Array of struct(t, x = ln df, r = residual), one per pillar in order.

    `dual` solves swaps on another discount curve, given as its factor P on grid and pillars.
    `anchored` is for curves in today basis, whose cash pillars start at spot.
    """
    equation = _swap_equation() if dual else _bond_equation()
    solved = _let("e", equation, _solution())
    pillar = f"""if(p.type_rate IN ('Bond', 'Swap'), {solved},
        named_struct('x', {_closed_form(anchored)}, 'r', 0D))"""
    pillar = _let("found", pillar, f"""if(acc.ok AND exp(found.x) > 0D AND NOT isnan(found.x) AND abs(found.r) <= {TOLERANCE}, found,
        named_struct('x', cast(NULL AS double), 'r', cast(NULL AS double)))""")
    gap = "slice(dates, acc.g + 2, greatest(p.grid_count - acc.g, 0))"
    step = _let("gap", gap, _let("s", pillar, _advance(dual)))
    # bound out here: projections are merged, and the grid would be built anew for every pillar
    return _let("dates", "grid", f"aggregate(pillars, {_START}, (acc, p) -> {step}, acc -> acc.out)")
