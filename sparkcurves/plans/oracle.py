"""Plain SQL for every registered query, in DuckDB's dialect.

Written from the definitions and on purpose in another shape than the Spark jobs: pillars are
solved one after another by a recursive query that reprices the whole instrument, factors are
found by range joins over all segments, schedules come from generate_series. Adding 0.0 after a
rounding turns a negative zero into zero.
"""

from __future__ import annotations

from sparkcurves.sources import market as M


def roll(d: str) -> str:
    return f"(CAST({d} AS DATE) + CASE isodow({d}) WHEN 6 THEN 2 WHEN 7 THEN 1 ELSE 0 END)"


def add_months(d: str, n: str) -> str:
    return f"CAST({d} + to_months(CAST({n} AS INTEGER)) AS DATE)"


def values_of(pillars: tuple) -> str:
    return "(VALUES " + ", ".join(f"({p}, '{t}', '{k}')" for p, t, k in pillars) + ") AS v(pos, tenor, type_rate)"


def days_between(a: str, b: str) -> str:
    return f"CAST(({b}) - ({a}) AS INTEGER)"


QUARTER = "CAST(date_trunc('quarter', l_shipdate) AS DATE)"
DISC = "CAST(round(l_discount * 100) AS BIGINT)"
TAX = "CAST(round(l_tax * 100) AS BIGINT)"


def quotes(pillars: tuple = M.PAR_PILLARS) -> str:
    return f"""quotes AS (
    SELECT l_suppkey AS curve_id, {QUARTER} AS val_date, l_linenumber AS pos, v.tenor, v.type_rate,
           CAST(sum(least({DISC}, {TAX})) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS bid,
           CAST(sum(greatest({DISC}, {TAX})) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS ask,
           CAST(sum({DISC} + {TAX}) AS DOUBLE) / (count(*) * 200.0::DOUBLE) AS mid
    FROM lineitem JOIN {values_of(pillars)} ON v.pos = l_linenumber
    GROUP BY ALL)"""


def filled(pillars: tuple = M.PAR_PILLARS) -> str:
    return f"""{quotes(pillars)},
filled AS (
    SELECT c.curve_id, c.val_date, v.pos, v.tenor, v.type_rate,
           coalesce(q.mid, 0.0::DOUBLE) AS rate, q.mid IS NULL AS is_missing
    FROM (SELECT DISTINCT curve_id, val_date FROM quotes) c
    CROSS JOIN {values_of(pillars)}
    LEFT JOIN quotes q ON q.curve_id = c.curve_id AND q.val_date = c.val_date AND q.tenor = v.tenor)"""


# Number and unit of a tenor column `tenor`.
TENOR_N = "TRY_CAST(regexp_extract(tenor, '^([0-9]+(?:\\.[0-9]+)?)([DWMQSY])$', 1) AS DOUBLE)"
TENOR_U = "nullif(regexp_extract(tenor, '^([0-9]+(?:\\.[0-9]+)?)([DWMQSY])$', 2), '')"


def add_tenor(d: str, calendar: str = "USD") -> str:
    plain = f"""WHEN {TENOR_U} = 'D' THEN {d} + CAST({TENOR_N} AS INTEGER)
         WHEN {TENOR_U} = 'W' THEN {d} + CAST({TENOR_N} * 7 AS INTEGER)"""
    if calendar == "USD":
        units = "CASE " + TENOR_U + " WHEN 'M' THEN 1 WHEN 'Q' THEN 3 WHEN 'S' THEN 6 WHEN 'Y' THEN 12 END"
        return f"(CASE {plain} ELSE {add_months(d, f'{TENOR_N} * {units}')} END)"
    units = "CASE " + TENOR_U + " WHEN 'M' THEN 28 WHEN 'Q' THEN 92 WHEN 'S' THEN 182 WHEN 'Y' THEN 364 END"
    return f"(CASE {plain} ELSE {d} + CAST({TENOR_N} * {units} AS INTEGER) END)"


def third_wednesday(month_start: str) -> str:
    return f"({month_start} + CAST((10 - isodow({month_start})) % 7 + 14 AS INTEGER))"


def strip_date(d: str, k: str) -> str:
    month = f"CAST(date_trunc('quarter', {d}) + to_months(CAST(3 * ({k}) + 2 AS INTEGER)) AS DATE)"
    return third_wednesday(month)


SPOT = {
    "after_overnight": lambda d: roll(f"({roll(f'({d} + 1)')} + 1)"),
    "two_days": lambda d: roll(f"({d} + 2)"),
    "same_day": lambda d: roll(d),
    "lag": lambda d: roll(f"({d} + lag)"),
}

_DEFINITIONS = {
    0: (("1D", "OverNight"), ("3M", "Cash"), ("6M", "Cash"), ("1Y", "Bond"), ("3Y", "Bond")),
    1: (("1D", "OverNight"), ("6M", "Cash"), ("2Y", "Bond"), ("3Y", "Bond")),
    2: (("1D", "OverNight"), ("2D", "OverNight"), ("3M", "Cash"), ("6M", "Cash"), ("1Y", "Bond"), ("2Y", "Bond"), ("3Y", "Bond")),
}


def filled_by_definition() -> str:
    rows = ", ".join(f"({kind}, {i}, '{tenor}', '{what}')" for kind, own in _DEFINITIONS.items() for i, (tenor, what) in enumerate(own, 1))
    return f"""{quotes()},
defs AS (SELECT * FROM (VALUES {rows}) AS d(kind, pos, tenor, type_rate)),
filled AS (
    SELECT c.curve_id, c.val_date, d.pos, d.tenor, d.type_rate, CAST(s_nationkey % 3 AS INTEGER) AS lag,
           coalesce(q.mid, 0.0::DOUBLE) AS rate, q.mid IS NULL AS is_missing
    FROM (SELECT DISTINCT curve_id, val_date FROM quotes) c
    JOIN supplier ON s_suppkey = c.curve_id JOIN defs d ON d.kind = s_nationkey % 3
    LEFT JOIN quotes q ON q.curve_id = c.curve_id AND q.val_date = c.val_date AND q.tenor = d.tenor)"""


def dated(
    pillars: tuple = M.PAR_PILLARS, calendar: str = "USD", settlement: str = "after_overnight", base: str = "spot", source: str | None = None
) -> str:
    night = "(val_date + 1)" if settlement == "same_day" else roll("(val_date + 1)")
    long_base = "spot_date" if base == "spot" else "val_date"
    strip = "CAST(nullif(regexp_extract(tenor, '^ED([0-9]+)$', 1), '') AS INTEGER)"
    return f"""{source or filled(pillars)},
nights AS (SELECT *, {night} AS on_date, {SPOT[settlement]('val_date')} AS spot_date FROM filled),
spans AS (
    SELECT *,
        CASE WHEN type_rate = 'OverNight' AND pos = 1 THEN val_date WHEN type_rate = 'OverNight' THEN on_date
             WHEN type_rate = 'Future' THEN {strip_date('val_date', strip + ' - 1')} ELSE spot_date END AS start_date,
        CASE WHEN type_rate = 'OverNight' AND pos = 1 THEN on_date WHEN type_rate = 'OverNight' THEN spot_date
             WHEN type_rate = 'Future' THEN {strip_date('val_date', strip)}
             ELSE {roll(add_tenor('spot_date', calendar))} END AS end_date
    FROM nights),
dated AS (
    SELECT *, CASE WHEN type_rate = 'OverNight' THEN val_date ELSE {long_base} END AS base_date,
        {days_between("CASE WHEN type_rate = 'OverNight' THEN val_date ELSE " + long_base + " END", "end_date")} AS days,
        1.0::DOUBLE / (1.0::DOUBLE + rate * ((end_date - start_date) / 360.0::DOUBLE)) AS simple_df,
        1.0::DOUBLE AS target
    FROM spans)"""


MONTHS = {"Monthly": 1, "Quarterly": 3, "SemiAnnual": 6, "Annual": 12}
MXN_DAYS = {"Monthly": 28, "Quarterly": 84, "SemiAnnual": 182, "Annual": 364}


def month_diff(a: str, b: str) -> tuple[str, str]:
    return f"(year({b}) - year({a}))", f"(month({b}) - month({a}))"


def count_of(frequency: str, a: str, b: str) -> str:
    y, m = month_diff(a, b)
    if frequency == "pay_freq":
        cases = " ".join(f"WHEN '{name}' THEN {count_of(name, a, b)}" for name in MONTHS)
        return f"(CASE pay_freq {cases} END)"
    text = {
        "Annual": f"{y} + ceil({m} / 12.0::DOUBLE)",
        "SemiAnnual": f"{y} * 2 + ceil({m} / 6.0::DOUBLE)",
        "Quarterly": f"{y} * 4 + round_even({m} / 3.0::DOUBLE, 0)",
        "Monthly": f"{y} * 12 + {m}",
    }[frequency]
    return f"greatest(1, CAST({text} AS INTEGER))"


def pay_date(start: str, end: str, k: str, n: str, frequency: str, calendar: str = "USD") -> str:
    if calendar == "MXN":
        shifted = f"({start} + CAST(({k}) * {MXN_DAYS[frequency]} AS INTEGER))"
    else:
        months = f"(CASE pay_freq {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {m}' for n, m in MONTHS.items())} END)"
        shifted = add_months(start, f"({k}) * {MONTHS.get(frequency, months)}")
    return f"(CASE WHEN ({k}) <= 0 THEN {start} WHEN ({k}) = {n} THEN {end} ELSE {roll(shifted)} END)"


def thirty_360(a: str, b: str) -> str:
    d1 = f"least(day({a}), 30)"
    d2 = f"(CASE WHEN day({b}) = 31 AND {d1} = 30 THEN 30 ELSE day({b}) END)"
    y, m = month_diff(a, b)
    return f"(({y} * 360 + {m} * 30 + ({d2} - {d1})) / 360.0::DOUBLE)"


def accrual(a: str, b: str, day_count: str = "ACT/360") -> str:
    if day_count == "30/360":
        return thirty_360(a, b)
    if day_count == "day_count":
        return day_fraction("day_count", a, b)
    return f"((({b}) - ({a})) / 360.0::DOUBLE)"


def day_fraction(name: str, a: str, b: str) -> str:
    """Year fraction by a day count named in a column."""
    y, m = month_diff(a, b)
    return f"""(CASE {name} WHEN 'ACT/360' THEN ({b} - {a}) / 360.0::DOUBLE WHEN 'ACT/365F' THEN ({b} - {a}) / 365.0::DOUBLE
        WHEN '30/360' THEN {thirty_360(a, b)}
        ELSE ({y} * 360 + {m} * 30 + least(day({b}), 30) - least(day({a}), 30)) / 360.0::DOUBLE END)"""


def log_df(ts: str, ls: str, d: str) -> str:
    """ln df on the lists of days and logs, log-linear with flat ends."""
    at = f"len(list_filter({ts}, lambda q: q <= {d}))"
    inside = f"{ls}[{at}] + ({ls}[{at} + 1] - {ls}[{at}]) * ({d} - {ts}[{at}]) / ({ts}[{at} + 1] - {ts}[{at}])"
    return f"(CASE WHEN {at} = 0 THEN {ls}[1] WHEN {at} = len({ts}) THEN {ls}[{at}] ELSE {inside} END)"


def bond_solve(
    frequency: str = "Annual", calendar: str = "USD", source: str = "dated", count_end: str = "end_date",
    day_count: str = "ACT/360",
) -> str:
    """Pillars in order; each bond is repriced in full at every Newton step."""
    n = count_of(frequency, "spot_date", count_end)
    at = pay_date("spot_date", "end_date", "k", "n", frequency, calendar)
    before = pay_date("spot_date", "end_date", "k - 1", "n", frequency, calendar)
    weight = "((c.d - s.t) / CAST(p.days - s.t AS DOUBLE))"
    known = f"list_sum(list_transform(list_filter(p.flows, lambda c: c.d <= s.t), lambda c: c.cf * exp({log_df('s.ts', 's.ls', 'c.d')})))"
    return f"""counted AS (SELECT *, {n} AS n FROM {source}),
flow AS (
    SELECT curve_id, val_date, pos,
        list(struct_pack(d := {days_between('base_date', at)},
            cf := rate * {accrual(before, at, day_count)} + CASE WHEN k = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) ORDER BY k) AS flows
    FROM (SELECT *, unnest(generate_series(1, n)) AS k FROM counted WHERE type_rate = 'Bond')
    GROUP BY ALL),
ladder AS (SELECT c.*, f.flows FROM counted c LEFT JOIN flow f USING (curve_id, val_date, pos)),
steps AS (
    SELECT curve_id, val_date, 1 AS pos, days AS t, [days] AS ts, [ln(simple_df)] AS ls, ln(simple_df) AS l
    FROM ladder WHERE pos = 1
    UNION ALL
    SELECT curve_id, val_date, pos, t, list_append(ts, t), list_append(ls, x), x
    FROM (
        SELECT s.curve_id, s.val_date, p.pos, p.days AS t, s.ts, s.ls,
            CASE WHEN p.type_rate = 'OverNight' THEN s.l + ln(p.simple_df)
                 WHEN p.type_rate = 'Cash' THEN ln(p.simple_df)
                 ELSE list_reduce(generate_series(1, 12), lambda x, i:
                    x - (coalesce({known}, 0.0::DOUBLE) - p.target
                         + list_sum(list_transform(list_filter(p.flows, lambda c: c.d > s.t), lambda c: c.cf * exp(s.l + (x - s.l) * {weight}))))
                      / list_sum(list_transform(list_filter(p.flows, lambda c: c.d > s.t), lambda c: c.cf * {weight} * exp(s.l + (x - s.l) * {weight}))),
                    s.l)
            END AS x
        FROM steps s JOIN ladder p ON p.curve_id = s.curve_id AND p.val_date = s.val_date AND p.pos = s.pos + 1)),
solved AS (
    SELECT p.*, exp(s.l) AS df FROM steps s JOIN ladder p USING (curve_id, val_date, pos))"""


def par_curve(
    pillars: tuple = M.PAR_PILLARS, frequency: str = "Annual", calendar: str = "USD", settlement: str = "after_overnight"
) -> str:
    return f"{dated(pillars, calendar, settlement)},\n{bond_solve(frequency, calendar)}"


TODAY = """anchors AS (
    SELECT curve_id, val_date, max_by(df, pos) AS spot_df FROM solved WHERE type_rate = 'OverNight' GROUP BY ALL),
today AS (
    SELECT s.* EXCLUDE (days, df),
        CASE WHEN type_rate = 'OverNight' THEN days ELSE CAST(end_date - val_date AS INTEGER) END AS days,
        CASE WHEN type_rate = 'OverNight' THEN df ELSE df * a.spot_df END AS df
    FROM solved s JOIN anchors a USING (curve_id, val_date))"""


def segments(source: str, name: str = "segments") -> str:
    return f"""{name} AS (
    SELECT curve_id, val_date, days AS lo, df AS df_lo,
        lead(days) OVER w AS hi, lead(df) OVER w AS df_hi, row_number() OVER w = 1 AS is_first
    FROM {source} WINDOW w AS (PARTITION BY curve_id, val_date ORDER BY days))"""


def on_segment(points: str, day: str, segs: str = "segments", key: str = "curve_id") -> str:
    return f"""{segs}.curve_id = {points}.{key} AND {segs}.val_date = {points}.val_date
        AND ({segs}.is_first OR {points}.{day} >= {segs}.lo) AND ({segs}.hi IS NULL OR {points}.{day} < {segs}.hi)"""


def factor(day: str, segs: str = "segments") -> str:
    return f"""CASE WHEN {segs}.hi IS NULL OR {day} <= {segs}.lo THEN {segs}.df_lo
        ELSE exp(ln({segs}.df_lo) + (ln({segs}.df_hi) - ln({segs}.df_lo)) * (({day} - {segs}.lo) / CAST({segs}.hi - {segs}.lo AS DOUBLE))) END"""


def loans(by_curve: bool = True, calendar: str = "USD") -> str:
    keys = f"l_suppkey AS curve_id, {QUARTER} AS val_date, " if by_curve else ""
    return f"""loan0 AS (
    SELECT {keys}CAST(l_shipdate AS DATE) AS start_date, v.tenor, {TAX} / 100.0::DOUBLE AS rate,
        CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE AS notional
    FROM lineitem JOIN {values_of(M.PAR_PILLARS)} ON v.pos = l_linenumber GROUP BY ALL),
loans AS (SELECT *, {roll(add_tenor('start_date', calendar))} AS maturity FROM loan0)"""


def schedule(source: str, frequency: str, calendar: str = "USD", day_count: str = "ACT/360", first: int = 1, name: str = "schedule") -> str:
    at = pay_date("start_date", "maturity", "k", "n", frequency, calendar)
    before = pay_date("start_date", "maturity", "k - 1", "n", frequency, calendar)
    return f"""{name}_n AS (
    SELECT *, {count_of(frequency, 'start_date', 'maturity')} AS n FROM {source}),
{name}_k AS (SELECT *, CAST(unnest(generate_series({first}, n)) AS INTEGER) AS k FROM {name}_n),
{name}_d AS (SELECT *, {before} AS period_start, {at} AS period_end FROM {name}_k),
{name} AS (SELECT *, {accrual('period_start', 'period_end', day_count)} AS accrual FROM {name}_d)"""


AMOUNT = "(CASE WHEN k = n THEN notional + notional * rate * accrual ELSE notional * rate * accrual END)"


def r8(expression: str, name: str | None = None) -> str:
    return f"round({expression}, 8) AS {name or expression}"


SQL: dict[str, str] = {}


def select(name: str, ctes: str, body: str) -> None:
    SQL[name] = f"WITH {'RECURSIVE ' if 'steps AS' in ctes else ''}{ctes}\n{body}" if ctes else body


# --- sources, projections, filters -------------------------------------------------------------

PRICES = f"""prices AS (
    SELECT p_partkey, {QUARTER} AS fecha, p_brand AS brand, p_type AS emisora, p_name AS instrumento,
        CASE p_size % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'SP' ELSE 'SC' END AS tipo_valor,
        p_size % 5 + 98.0::DOUBLE AS precio_sucio,
        CAST(sum({DISC}) AS DOUBLE) / count(*) AS rendimiento,
        CAST(182 * (1 + p_size % 10) AS INTEGER) AS dias_venc,
        CAST(sum({TAX}) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS tasa_cupon
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""

INFO = """info AS (
    SELECT s_suppkey AS id_curve, s_name AS name,
        CASE s_nationkey % 4 WHEN 0 THEN 'Annual' WHEN 1 THEN 'SemiAnnual' WHEN 2 THEN 'Quarterly' ELSE 'Monthly' END AS pay_freq,
        CAST(s_nationkey % 3 AS INTEGER) AS settlement,
        CASE s_nationkey % 4 WHEN 0 THEN 'ACT/360' WHEN 1 THEN 'ACT/365F' WHEN 2 THEN '30/360' ELSE '30E/360' END AS day_count,
        s_name AS fwd_curve, 'Supplier#' || lpad(CAST(1 + s_suppkey % 10 AS VARCHAR), 9, '0') AS dsct_curve
    FROM supplier)"""

select("quote_panel", quotes(), f"SELECT curve_id, val_date, pos, tenor, type_rate, {r8('mid')} FROM quotes")

select("quote_side", f"{quotes()},\n{INFO}", """
SELECT curve_id, val_date, pos, tenor,
    CASE settlement WHEN 0 THEN 'bid' WHEN 1 THEN 'ask' ELSE 'mid' END AS side,
    round(CASE settlement WHEN 0 THEN bid WHEN 1 THEN ask ELSE mid / 100.0::DOUBLE END, 8) AS rate
FROM quotes JOIN info ON id_curve = curve_id""")

select("quotes_by_type", quotes(), f"SELECT curve_id, val_date, tenor, {r8('mid')} FROM quotes WHERE type_rate = 'Bond'")

select("type_blocks", quotes(), """
SELECT curve_id, val_date, type_rate, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n,
    max(pos) - min(pos) + 1 = count(*) AS is_contiguous
FROM quotes GROUP BY curve_id, val_date, type_rate""")

select("curve_definition", quotes(), """
SELECT curve_id AS curve_name, val_date AS on_date, tenor, 'Bond/Swap rate' AS mkt_desc, round(mid, 8) AS quote
FROM quotes WHERE type_rate = 'Bond'""")

_AUDITS = [("info", "curve_info", c, c) for c in ("id_curve", "name", "pay_freq", "settlement", "day_count", "fwd_curve", "dsct_curve")]
_AUDITS += [("lineitem", "lineitem", c, c) for c in ("l_orderkey", "l_linenumber")]
select("definition_audit", INFO, "\nUNION ALL\n".join(
    [f"SELECT '{label}.{c} not null' AS check_name, count(*) FILTER (WHERE {c} IS NULL) AS violations FROM {t}" for t, label, c, _ in _AUDITS]
    + ["SELECT 'curve_info unique id_curve', count(*) FROM (SELECT id_curve FROM info GROUP BY 1 HAVING count(*) > 1)",
       "SELECT 'lineitem unique l_orderkey, l_linenumber', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"]))

select("curve_reload", f"{par_curve()},\n{TODAY}", f"SELECT curve_id, val_date, days, {r8('df')} FROM today")

select("price_universe", f"""{PRICES},
listed AS (
    SELECT fecha, 'Cash' AS type_rate, 1 AS plazo, precio_sucio / 100.0::DOUBLE AS yield, 0.0::DOUBLE AS tasa_cupon, 0.0::DOUBLE AS precio_sucio
    FROM prices WHERE emisora = 'PROMO' AND tipo_valor = 'SP'
    UNION
    SELECT fecha, 'Cash', dias_venc, rendimiento / 100.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
    FROM prices WHERE emisora = 'SMALL' AND tipo_valor = 'S' AND dias_venc <= 360
    UNION
    SELECT fecha, 'Bond', dias_venc, rendimiento / 100.0::DOUBLE, tasa_cupon, precio_sucio
    FROM prices WHERE left(instrumento, 4) = 'blue' AND brand <> 'Brand#23' AND dias_venc > 360)""", """
SELECT fecha, type_rate, plazo, round(yield, 8) AS yield, round(tasa_cupon, 8) AS tasa_cupon, precio_sucio,
    CAST(dense_rank() OVER (PARTITION BY fecha ORDER BY plazo) AS INTEGER) AS maturity_rank, fecha + plazo AS maturity
FROM listed""")

select("price_classified", PRICES, """
SELECT p_partkey, fecha, instrumento, round(tasa_cupon, 8) AS tasa_cupon,
    CASE WHEN tasa_cupon = 0 THEN 'Cero Cupon' ELSE 'Bullet' END AS tipo
FROM prices WHERE tipo_valor = 'SP'""")

select("price_issuer", PRICES, """
SELECT p_partkey, fecha, instrumento, tipo_valor, emisora, precio_sucio, dias_venc
FROM prices WHERE tipo_valor IN ('S', 'SP') AND emisora = 'PROMO'""")

_DEFINED = ", ".join(f"({kind}, {i}, '{tenor}', '{what}')" for kind, own in _DEFINITIONS.items() for i, (tenor, what) in enumerate(own, 1))
select("definition_scan", "", f"""
SELECT s_name AS curve_name, s_suppkey AS curve_id, pos, tenor, type_rate
FROM supplier JOIN (VALUES {_DEFINED}) AS d(kind, pos, tenor, type_rate) ON kind = s_nationkey % 3 WHERE s_name = 'Supplier#000000007'""")

select("definition_table_saved", INFO, "SELECT * FROM info")

select("price_deflated", f"""{PRICES},
levels AS (
    SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS fecha,
        CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 10000000.0::DOUBLE) AS index_level
    FROM orders GROUP BY 1)""", """
SELECT p_partkey, fecha, precio_sucio,
    round(precio_sucio / (SELECT index_level FROM levels WHERE levels.fecha = prices.fecha), 8) AS psucio,
    round(rendimiento / 100.0::DOUBLE, 8) AS yield, dias_venc
FROM prices""")

# --- joins -------------------------------------------------------------------------------------

select("rate_lookup", f"""ranked AS (
    SELECT l_suppkey AS curve_id, {QUARTER} AS val_date, v.tenor, ({DISC} + {TAX}) / 200.0::DOUBLE AS mid,
        row_number() OVER (PARTITION BY l_suppkey, {QUARTER}, v.tenor ORDER BY l_orderkey, {DISC} + {TAX}) AS rn
    FROM lineitem JOIN {values_of(M.PAR_PILLARS)} ON v.pos = l_linenumber)""", f"""
SELECT c.curve_id, c.val_date, v.tenor, round(coalesce(r.mid, 0.0::DOUBLE), 8) AS rate, r.mid IS NULL AS is_missing
FROM (SELECT DISTINCT curve_id, val_date FROM ranked) c CROSS JOIN {values_of(M.PAR_PILLARS)}
LEFT JOIN ranked r ON r.curve_id = c.curve_id AND r.val_date = c.val_date AND r.tenor = v.tenor AND r.rn = 1""")

select("definition_join", filled(), f"SELECT curve_id, val_date, pos, tenor, type_rate, {r8('rate')}, is_missing FROM filled")

select("pillar_match", f"{dated()},\n{loans()}", f"""
SELECT l.curve_id, l.val_date, l.start_date, l.tenor, round(l.rate, 8) AS rate, {days_between('l.val_date', 'l.maturity')} AS day,
    min(d.pos) AS pos, min(d.pos) IS NOT NULL AS is_matched
FROM loans l LEFT JOIN dated d ON d.curve_id = l.curve_id AND d.val_date = l.val_date AND d.end_date = l.maturity
GROUP BY ALL""")

select("curve_asof_interp", f"""{par_curve()},
{TODAY},
{segments('today')},
{loans()},
points AS (SELECT DISTINCT curve_id, val_date, {days_between('val_date', 'maturity')} AS day FROM loans)""", f"""
SELECT points.curve_id, points.val_date, day, round({factor('day')}, 8) AS df,
    round(CASE WHEN hi IS NULL OR day <= lo THEN df_lo
        ELSE (day - lo) / CAST(hi - lo AS DOUBLE) * df_hi + (hi - day) / CAST(hi - lo AS DOUBLE) * df_lo END, 8) AS df_linear
FROM points JOIN segments ON {on_segment('points', 'day')}""")

# --- scalar functions --------------------------------------------------------------------------

LINES = f"""lines0 AS (
    SELECT l_orderkey, l_linenumber, l_tax, CAST(l_shipdate AS DATE) AS start_date, v.tenor
    FROM lineitem JOIN {values_of(M.PAR_PILLARS)} ON v.pos = l_linenumber),
lines AS (SELECT *, {roll(add_tenor('start_date'))} AS end_date FROM lines0)"""

_Y, _MO = month_diff("start_date", "end_date")
select("accrual_day_counts", LINES, f"""
SELECT l_orderkey, l_linenumber, start_date, end_date,
    round((end_date - start_date) / 360.0::DOUBLE, 8) AS act_360, round((end_date - start_date) / 365.0::DOUBLE, 8) AS act_365f,
    round({thirty_360('start_date', 'end_date')}, 8) AS thirty_360,
    round(({_Y} * 360 + {_MO} * 30 + least(day(end_date), 30) - least(day(start_date), 30)) / 360.0::DOUBLE, 8) AS thirty_e_360
FROM lines""")

select("discount_factors", LINES, f"""
SELECT l_orderkey, l_linenumber, start_date, round(l_tax, 8) AS l_tax,
    round(1.0::DOUBLE / (1.0::DOUBLE + l_tax * {accrual('start_date', 'end_date')}), 8) AS df_linear,
    round(1.0::DOUBLE / pow(1.0::DOUBLE + l_tax, {accrual('start_date', 'end_date')}), 8) AS df_compound,
    round(exp(-l_tax * {accrual('start_date', 'end_date')}), 8) AS df_continuous, day_count, compounding,
    round(CASE compounding WHEN 'Linear' THEN 1.0::DOUBLE / (1.0::DOUBLE + l_tax * own)
        WHEN 'Compound' THEN 1.0::DOUBLE / pow(1.0::DOUBLE + l_tax, own) ELSE exp(-l_tax * own) END, 8) AS df_own
FROM (SELECT *, {day_fraction('day_count', 'start_date', 'end_date')} AS own FROM (
    SELECT *, ['ACT/360', 'ACT/365F', '30/360', '30E/360'][l_linenumber % 4 + 1] AS day_count,
        ['Linear', 'Compound', 'Continuous'][l_linenumber % 3 + 1] AS compounding FROM lines))""")

SUFFIX_LIST = "['D', 'W', 'M', 'Q', 'S', 'Y', '.5Y', 'N']"
select("tenor_parsed", f"tenors AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || {SUFFIX_LIST}[p_partkey % 8 + 1] AS tenor FROM part)", f"""
SELECT p_partkey, tenor, {TENOR_N} AS tenor_number, {TENOR_U} AS tenor_unit,
    CASE {TENOR_U} WHEN 'Y' THEN {TENOR_N} * 12 WHEN 'M' THEN {TENOR_N} WHEN 'W' THEN {TENOR_N} ELSE 0.0::DOUBLE END AS months
FROM tenors""")

select("tenor_end_dates", f"""tenors AS (
    SELECT DISTINCT CAST(l_shipdate AS DATE) AS start_date, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || {SUFFIX_LIST}[l_linenumber] AS tenor,
        CASE WHEN l_linestatus = 'F' THEN 'MXN' ELSE 'USD' END AS calendar
    FROM lineitem),
ends AS (SELECT *, {add_tenor('start_date')} AS end_usd, {add_tenor('start_date', 'MXN')} AS end_mxn FROM tenors),
owns AS (SELECT *, CASE calendar WHEN 'USD' THEN end_usd ELSE end_mxn END AS end_own FROM ends)""", f"""
SELECT start_date, tenor, calendar, end_usd, end_mxn, end_own, {roll('end_own')} AS rolled_own FROM owns""")

select("business_day_roll", "", f"""
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, {roll('CAST(o_orderdate AS DATE)')} AS rolled FROM orders""")

select("frequency_yf", INFO, """
SELECT id_curve, pay_freq,
    round(CASE pay_freq WHEN 'Annual' THEN 1.0::DOUBLE WHEN 'SemiAnnual' THEN 0.5::DOUBLE WHEN 'Quarterly' THEN 0.25::DOUBLE ELSE 1.0::DOUBLE / 12 END, 8) AS yf_usd,
    round(CASE pay_freq WHEN 'Annual' THEN 364 WHEN 'SemiAnnual' THEN 182 WHEN 'Quarterly' THEN 91 ELSE 28 END / 360.0::DOUBLE, 8) AS yf_mxn
FROM info""")

_FREQUENCIES = {"None": (1, 1), "Daily": (1, 360), "Annual": (1, 1), "SemiAnnual": (1, 2), "Quarterly": (1, 4), "Monthly": (1, 12)}
_MXN_FRACTIONS = {"Annual": "364 / 360.0::DOUBLE", "SemiAnnual": "182 / 360.0::DOUBLE",
                  "Quarterly": "91 / 360.0::DOUBLE", "Monthly": "28 / 360.0::DOUBLE"}
select("frequency_yf_all", "named AS (SELECT s_suppkey AS id_curve, (['None', 'Daily', 'Annual', 'SemiAnnual', 'Quarterly', 'Monthly'])[s_suppkey % 6 + 1] "
       "AS frequency FROM supplier)", f"""
SELECT id_curve, frequency,
    round(CASE frequency {' '.join(f"WHEN '{n}' THEN {a} / {b}.0::DOUBLE" for n, (a, b) in _FREQUENCIES.items())} END, 8) AS yf_usd,
    round(CASE frequency {' '.join(f"WHEN '{n}' THEN {v}" for n, v in _MXN_FRACTIONS.items())} END, 8) AS yf_mxn
FROM named""")

select("payment_counts", f"""{LINES},
ranges AS (SELECT DISTINCT start_date, tenor, end_date FROM lines)""", f"""
SELECT start_date, tenor, end_date,
    CAST({_Y} * 2 + ceil({_MO} / 6.0::DOUBLE) AS INTEGER) AS n_semiannual, CAST({_Y} * 12 + {_MO} AS INTEGER) AS n_monthly,
    CAST({_Y} * 4 + round_even({_MO} / 4.0::DOUBLE, 0) AS INTEGER) AS n_quarterly, CAST({_Y} + ceil({_MO} / 12.0::DOUBLE) AS INTEGER) AS n_annual,
    CAST(ceil((end_date - start_date) / CAST({roll(add_months('start_date', '6'))} - start_date AS DOUBLE)) AS INTEGER) AS n_by_period,
    CAST(round_even((end_date - start_date) / 182.5::DOUBLE, 0) AS INTEGER) AS n_by_days
FROM ranges""")

select("settlement_dates", f"""days AS (SELECT DISTINCT l_suppkey AS curve_id, {QUARTER} AS val_date FROM lineitem),
{INFO}""", f"""
SELECT curve_id, val_date, {roll('(val_date + 1)')} AS on_date,
    {SPOT['after_overnight']('val_date')} AS tn_after_overnight, {SPOT['two_days']('val_date')} AS tn_two_days,
    {SPOT['same_day']('val_date')} AS tn_same_day,
    {roll('(val_date + greatest(settlement - 1, 1))')} AS on_by_lag, {roll('(val_date + settlement)')} AS tn_by_lag,
    strftime(val_date, '%Y%m%d') || ' ' || name || ' Curva' AS label
FROM days JOIN info ON id_curve = curve_id""")

select("compound_growth", "", """
SELECT l_orderkey, round(product(1.0::DOUBLE + l_tax * l_quantity / 365.0::DOUBLE), 8) AS growth, count(*) AS periods
FROM lineitem GROUP BY l_orderkey""")

# --- schedules and pricing ---------------------------------------------------------------------

for _name, _calendar in (("bond_schedule", "USD"), ("bond_schedule_mxn", "MXN")):
    select(_name, f"{loans(False, _calendar)},\n{schedule('loans', 'SemiAnnual', _calendar)}", f"""
SELECT start_date, tenor, {r8('rate')}, k, n, period_start, period_end, {days_between('start_date', 'period_end')} AS day,
    {r8('accrual')}, round({AMOUNT}, 8) AS amount
FROM schedule""")

select("imm_strip", """days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
strip AS (SELECT day, CAST(unnest(generate_series(1, 6)) AS INTEGER) AS k FROM days)""", f"""
SELECT day, k, {strip_date('day', 'k - 1')} AS start_date, {strip_date('day', 'k')} AS end_date,
    {strip_date('day', 'k - 1')} < day AS expired
FROM strip""")

for _name, _calendar in (("bond_pv", "USD"), ("bond_pv_mxn", "MXN")):
    select(_name, f"""{par_curve()},
{TODAY},
{segments('today')},
{loans(True, _calendar)},
{schedule('loans', 'SemiAnnual', _calendar)},
points AS (SELECT *, {days_between('val_date', 'period_end')} AS day FROM schedule)""", f"""
SELECT points.curve_id, points.val_date, start_date, tenor, round(rate, 8) AS rate, count(*) AS payments,
    round(sum({AMOUNT} * {factor('day')}), 4) AS pv
FROM points JOIN segments ON {on_segment('points', 'day')}
GROUP BY points.curve_id, points.val_date, start_date, tenor, rate""")

select("forward_rates", f"""{par_curve()},
{TODAY},
pairs AS (
    SELECT curve_id, val_date, days, df, lag(days) OVER w AS from_day, lag(df) OVER w AS df_from
    FROM today WINDOW w AS (PARTITION BY curve_id, val_date ORDER BY days))""", """
SELECT curve_id, val_date, from_day, days,
    round((df_from / df - 1.0::DOUBLE) / ((days - from_day) / 360.0::DOUBLE), 8) + 0.0::DOUBLE AS forward_rate
FROM pairs WHERE from_day IS NOT NULL""")

FLOATING = f"""{par_curve()},
{INFO},
{TODAY},
{segments('today')},
{loans()},
{schedule('loans', 'Quarterly')},
ends AS (
    SELECT *, {days_between('val_date', 'period_start')} AS day0, {days_between('val_date', 'period_end')} AS day FROM schedule),
floats AS (
    SELECT ends.*, {factor('day0', 's0')} / {factor('day', 's1')} - 1.0::DOUBLE AS growth
    FROM ends JOIN segments s0 ON {on_segment('ends', 'day0', 's0')} JOIN segments s1 ON {on_segment('ends', 'day', 's1')}),
paid AS (
    SELECT floats.*, notional * growth + CASE WHEN k = n THEN notional ELSE 0.0::DOUBLE END AS amount, named.id_curve AS discount_id
    FROM floats JOIN info own ON own.id_curve = floats.curve_id LEFT JOIN info named ON named.name = own.dsct_curve)"""

select("float_leg", FLOATING, f"""
SELECT curve_id, val_date, start_date, tenor, {r8('rate')}, k, period_start, period_end, day,
    round(CASE WHEN accrual <> 0 THEN growth / accrual END, 8) + 0.0::DOUBLE AS forward_rate, round(amount, 4) + 0.0::DOUBLE AS amount
FROM paid""")

select("swap_dual_curve_pv", FLOATING, f"""
SELECT paid.curve_id, paid.val_date, discount_id, start_date, tenor, round(rate, 8) AS rate, count(*) AS payments,
    round(sum(amount * {factor('day', 'segments')}), 4) AS pv
FROM paid LEFT JOIN segments ON {on_segment('paid', 'day', 'segments', 'discount_id')}
GROUP BY paid.curve_id, paid.val_date, discount_id, start_date, tenor, rate""")

_CAPPED = add_months("spot_date", "least(k * 6, months)")
_CAPPED0 = add_months("spot_date", "least((k - 1) * 6, months)")
FLOW_TABLE = f"""{par_curve()},
{segments('solved')},
rows0 AS (
    SELECT curve_id, val_date, spot_date, tenor, rate, CAST({TENOR_N} * 12 AS INTEGER) AS months,
        CAST(ceil({TENOR_N}) * 2 AS INTEGER) AS n
    FROM solved WHERE type_rate = 'Bond'),
rows1 AS (SELECT *, CAST(unnest(generate_series(1, n)) AS INTEGER) AS k FROM rows0),
rows2 AS (
    SELECT *, {roll(_CAPPED)} AS period_end, CASE WHEN k = 1 THEN spot_date ELSE {roll(_CAPPED0)} END AS period_start FROM rows1),
flows AS (
    SELECT *, (period_end - period_start) / 360.0::DOUBLE AS yfc, (period_end - spot_date) / 360.0::DOUBLE AS yf,
        {days_between('spot_date', 'period_end')} AS day
    FROM rows2)"""

select("fixed_flow_table", FLOW_TABLE, f"""
SELECT flows.curve_id, flows.val_date, tenor, k, day, {r8('yfc')}, {r8('yf')}, round({factor('day')}, 8) AS df,
    round(rate * yfc + CASE WHEN k = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 12) AS amount
FROM flows JOIN segments ON {on_segment('flows', 'day')}""")

select("float_flow_table", f"""{FLOW_TABLE},
projected AS (
    SELECT flows.*, {factor('day')} AS df_fwd, 1 + flows.curve_id % 10 AS discount_id
    FROM flows JOIN segments ON {on_segment('flows', 'day')}),
grown AS (
    SELECT *, coalesce(lag(df_fwd) OVER (PARTITION BY curve_id, val_date, tenor ORDER BY k), 1.0::DOUBLE) / df_fwd - 1.0::DOUBLE AS growth
    FROM projected)""", f"""
SELECT grown.curve_id, grown.val_date, tenor, k, day, {r8('yfc')}, {r8('yf')}, round({factor('day')}, 8) AS df,
    round(growth + CASE WHEN k = n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 8) + 0.0::DOUBLE AS amount
FROM grown LEFT JOIN segments ON {on_segment('grown', 'day', 'segments', 'discount_id')}""")

# --- curves ------------------------------------------------------------------------------------

NIGHTS = """night AS (
    SELECT curve_id, val_date, max(simple_df) FILTER (WHERE pos = 1) AS df1,
        max(simple_df) FILTER (WHERE pos = 1) * max(simple_df) FILTER (WHERE pos = 2) AS df2
    FROM dated WHERE type_rate = 'OverNight' GROUP BY ALL)"""

select("curve_short_end", f"{dated()},\n{NIGHTS}", """
SELECT d.curve_id, d.val_date, pos, start_date, end_date, days, round(CASE pos WHEN 1 THEN df1 ELSE df2 END, 8) AS df
FROM dated d JOIN night USING (curve_id, val_date) WHERE type_rate = 'OverNight'""")

select("curve_short_end_zero", dated(M.MXN_PILLARS, "MXN", "same_day"), """
SELECT curve_id, val_date, pos, start_date, end_date, days, round(simple_df, 8) AS df FROM dated WHERE type_rate = 'OverNight'""")

select("curve_cash_block", f"{dated()},\n{NIGHTS}", f"""
SELECT d.curve_id, d.val_date, pos, end_date, days, round(simple_df, 8) AS df,
    {days_between('d.val_date', 'end_date')} AS days_today, round(simple_df * df2, 8) AS df_today
FROM dated d JOIN night USING (curve_id, val_date) WHERE type_rate = 'Cash'""")

FUTURES = f"""{dated(M.PROJECTION_PILLARS, base='today')},
{NIGHTS},
near AS (
    SELECT d.curve_id, d.val_date, days, CASE WHEN pos = 1 THEN df1 WHEN pos = 2 THEN df2 ELSE simple_df * df2 END AS df
    FROM dated d JOIN night USING (curve_id, val_date) WHERE type_rate IN ('OverNight', 'Cash')),
{segments('near')},
fut AS (
    SELECT *, {days_between('val_date', 'start_date')} AS strip_day FROM dated WHERE tenor = 'ED1'),
first_future AS (
    SELECT fut.curve_id, fut.val_date, {factor('strip_day')} * simple_df AS df FROM fut JOIN segments ON {on_segment('fut', 'strip_day')}),
futures AS (
    SELECT d.curve_id, d.val_date, pos, tenor, start_date, end_date, days,
        f.df * CASE WHEN tenor = 'ED1' THEN 1.0::DOUBLE ELSE simple_df END AS df
    FROM dated d JOIN first_future f USING (curve_id, val_date) WHERE type_rate = 'Future')"""

select("futures_chain", FUTURES, f"SELECT curve_id, val_date, pos, tenor, start_date, end_date, days, {r8('df')} FROM futures")

select("curve_zero_basis", f"{par_curve()},\n{TODAY}", f"SELECT curve_id, val_date, pos, tenor, days, {r8('df')} FROM today")

select("quote_files", f"""quotes AS (
    SELECT s_nationkey AS nation, {QUARTER} AS val_date, l_linenumber AS line, v.tenor, v.type_rate, count(*) AS n,
           CAST(sum(least({DISC}, {TAX})) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS bid,
           CAST(sum(greatest({DISC}, {TAX})) AS DOUBLE) / (count(*) * 100.0::DOUBLE) AS ask,
           CAST(sum({DISC} + {TAX}) AS DOUBLE) / (count(*) * 200.0::DOUBLE) AS mid
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN {values_of(M.PAR_PILLARS)} ON v.pos = l_linenumber
    GROUP BY ALL)""", f"""
SELECT CAST(nation AS VARCHAR) AS file_name, n_name AS curve_id, val_date,
       row_number() OVER (PARTITION BY nation, val_date ORDER BY line) AS pos, tenor, type_rate, {r8('bid')}, {r8('ask')},
       CASE WHEN n >= {M.THIN} THEN round(mid, 8) + 0.0 END AS mid,
       CASE WHEN n < {M.THIN} THEN 'bad line' WHEN n_name IS NULL THEN 'no curve' END AS reject
FROM quotes LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 0) ON n_nationkey = nation""")

for _name in ("curve_two_basis", "curve_store"):
    select(_name, f"{par_curve()},\n{TODAY}", f"""
SELECT curve_id, val_date, 't' AS basis, pos, days, {r8('df')} FROM today
UNION ALL
SELECT curve_id, val_date, 'settlement', pos, days, {r8('df')} FROM solved""")

_MONTHS = f"CASE {TENOR_U} WHEN 'Y' THEN CAST({TENOR_N} * 12 AS INTEGER) WHEN 'M' THEN CAST({TENOR_N} AS INTEGER) ELSE 0 END"
select("curve_initial", f"""{filled()},
{INFO},
lagged AS (
    SELECT f.*, {roll('(val_date + greatest(settlement - 1, 1))')} AS on_date, {roll('(val_date + settlement)')} AS tn_date,
        first_value(rate) OVER (PARTITION BY curve_id, val_date ORDER BY pos) AS night_rate
    FROM filled f JOIN info ON id_curve = curve_id),
typed AS (SELECT *, pos = 1 AS is_on, pos = 2 AND tn_date > val_date AS is_tn FROM lagged),
ended AS (
    SELECT *, CASE WHEN is_on THEN on_date WHEN is_tn THEN tn_date ELSE {roll(add_months('tn_date', _MONTHS))} END AS end_date FROM typed),
based AS (
    SELECT *, 't' AS basis, val_date AS start_date, val_date AS from_date FROM ended
    UNION ALL
    SELECT *, 'settlement',
        CASE WHEN is_on THEN val_date WHEN is_tn THEN on_date WHEN tn_date > val_date THEN tn_date ELSE val_date END,
        CASE WHEN is_on OR is_tn THEN val_date ELSE tn_date END FROM ended),
counted AS (SELECT *, (end_date - from_date) / 360.0::DOUBLE AS yf FROM based)""", f"""
SELECT curve_id, val_date, basis, pos, tenor, start_date, end_date, {days_between('from_date', 'end_date')} AS days, {r8('yf')},
    round(CASE WHEN is_on OR is_tn THEN 1.0::DOUBLE / (1.0::DOUBLE + night_rate * yf)
        WHEN type_rate IN ('OverNight', 'Cash') THEN 1.0::DOUBLE / (1.0::DOUBLE + rate * yf) ELSE 1.0::DOUBLE END, 8) AS df
FROM counted""")

SOLVED = f"SELECT curve_id, val_date, pos, tenor, days, {r8('df')}, true AS converged FROM solved"
REPRICED = """
SELECT curve_id, val_date, count(*) AS pillars, count(*) AS repriced FROM {source}
WHERE type_rate = '{kind}' GROUP BY ALL"""

select("bootstrap_par", par_curve(), SOLVED)
select("bootstrap_par_gap", par_curve(M.GAP_PILLARS), SOLVED)
select("bootstrap_semiannual", par_curve(M.SEMIANNUAL_PILLARS, "SemiAnnual", settlement="two_days"), SOLVED)
select("bootstrap_mxn", par_curve(M.MXN_PILLARS, "SemiAnnual", "MXN", "same_day"), SOLVED)

select("bootstrap_by_definition", f"""{dated(settlement='lag', source=filled_by_definition())},
{INFO},
defined AS (SELECT d.*, i.pay_freq, i.day_count FROM dated d JOIN info i ON i.id_curve = d.curve_id),
{bond_solve('pay_freq', source='defined', day_count='day_count')}""", SOLVED)

PRICE_PILLARS = f"""{PRICES},
firsts AS (
    SELECT * FROM prices QUALIFY row_number() OVER (PARTITION BY brand, fecha, dias_venc ORDER BY p_partkey) = 1),
listed AS (
    SELECT brand AS curve_id, fecha AS val_date, 1 AS plazo, rendimiento / 100.0::DOUBLE AS rate, 'Cash' AS type_rate, 1.0::DOUBLE AS target
    FROM prices QUALIFY row_number() OVER (PARTITION BY brand, fecha ORDER BY p_partkey) = 1
    UNION ALL
    SELECT brand, fecha, dias_venc, rendimiento / 100.0::DOUBLE, 'Cash', 1.0::DOUBLE FROM firsts WHERE dias_venc <= 360
    UNION ALL
    SELECT brand, fecha, dias_venc, tasa_cupon, 'Bond', precio_sucio / 100.0::DOUBLE FROM firsts WHERE dias_venc > 360),
ordered AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY curve_id, val_date ORDER BY plazo) AS INTEGER) AS pos, plazo || 'D' AS tenor,
        val_date AS spot_date, val_date AS base_date, val_date + plazo AS due,
        CASE WHEN type_rate = 'Bond' THEN {roll('(val_date + plazo)')} ELSE val_date + plazo END AS end_date
    FROM listed),
dated AS (
    SELECT *, {days_between('val_date', 'end_date')} AS days, 1.0::DOUBLE / (1.0::DOUBLE + rate * (plazo / 360.0::DOUBLE)) AS simple_df
    FROM ordered)"""

select("bootstrap_price_target", f"{PRICE_PILLARS},\n{bond_solve('SemiAnnual', 'MXN', count_end='due')}", SOLVED)


def dual_solve() -> str:
    """Swaps of the projection curves, each float leg repriced in full at every Newton step."""
    discount = par_curve().replace("quotes AS", "dquotes AS").replace("FROM quotes", "FROM dquotes").replace("JOIN quotes", "JOIN dquotes")
    for name in ("filled", "nights", "spans", "dated", "counted", "flow", "ladder", "steps", "solved"):
        discount = discount.replace(f"{name} AS (", f"d{name} AS (").replace(f"FROM {name}", f"FROM d{name}").replace(f"JOIN {name} ", f"JOIN d{name} ")
    today = TODAY.replace("FROM solved", "FROM dsolved")
    fixed_at = pay_date("spot_date", "end_date", "k", "nx", "SemiAnnual")
    fixed_from = pay_date("spot_date", "end_date", "k - 1", "nx", "SemiAnnual")
    float_at = pay_date("spot_date", "end_date", "k", "nf", "Quarterly")
    float_from = pay_date("spot_date", "end_date", "k - 1", "nf", "Quarterly")

    def unknown(d: str) -> str:
        return f"(CASE WHEN {d} <= s.t THEN {log_df('s.ts', 's.ls', d)} ELSE s.l + (x - s.l) * (({d} - s.t) / CAST(p.days - s.t AS DOUBLE)) END)"

    def slope(d: str) -> str:
        return f"(CASE WHEN {d} <= s.t THEN 0.0::DOUBLE ELSE ({d} - s.t) / CAST(p.days - s.t AS DOUBLE) END)"

    ratio = f"exp({unknown('c.a')} - {unknown('c.b')})"
    return f"""{discount},
{today},
dcurve AS (SELECT curve_id, val_date, list(days ORDER BY days) AS dts, list(ln(df) ORDER BY days) AS dls FROM today GROUP BY ALL),
{dated(M.PROJECTION_PILLARS, base='today')},
joined AS (
    SELECT d.*, c.dts, c.dls, {count_of('SemiAnnual', 'd.val_date', 'd.end_date')} AS nx, {count_of('Quarterly', 'd.val_date', 'd.end_date')} AS nf
    FROM dated d LEFT JOIN dcurve c ON c.curve_id = 1 + d.curve_id % 10 AND c.val_date = d.val_date),
fixed AS (
    SELECT curve_id, val_date, pos,
        list_sum(list((rate * {accrual(fixed_from, fixed_at, '30/360')} + CASE WHEN k = nx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)
            * exp({log_df('dts', 'dls', f"({fixed_at} - val_date)")}) ORDER BY k)) AS aim
    FROM (SELECT *, unnest(generate_series(1, nx)) AS k FROM joined WHERE type_rate = 'Swap') GROUP BY ALL),
floating AS (
    SELECT curve_id, val_date, pos,
        list(struct_pack(a := {days_between('val_date', float_from)}, b := {days_between('val_date', float_at)},
            p := exp({log_df('dts', 'dls', f"({float_at} - val_date)")}), last := k = nf) ORDER BY k) AS legs
    FROM (SELECT *, unnest(generate_series(1, nf)) AS k FROM joined WHERE type_rate = 'Swap') GROUP BY ALL),
ladder AS (
    SELECT j.*, x.aim, f.legs FROM joined j LEFT JOIN fixed x USING (curve_id, val_date, pos) LEFT JOIN floating f USING (curve_id, val_date, pos)),
steps AS (
    SELECT curve_id, val_date, 1 AS pos, days AS t, [days] AS ts, [ln(simple_df)] AS ls, ln(simple_df) AS l, 0.0::DOUBLE AS anchor
    FROM ladder WHERE pos = 1
    UNION ALL
    SELECT curve_id, val_date, pos, t, list_append(ts, t), list_append(ls, x), x, CASE WHEN pos = 2 THEN x ELSE anchor END
    FROM (
        SELECT s.curve_id, s.val_date, p.pos, p.days AS t, s.ts, s.ls, s.anchor,
            CASE WHEN p.type_rate = 'OverNight' THEN s.l + ln(p.simple_df)
                 WHEN p.type_rate = 'Cash' THEN s.anchor + ln(p.simple_df)
                 WHEN p.tenor = 'ED1' THEN ln(p.simple_df) + {log_df('s.ts', 's.ls', '(p.start_date - p.val_date)')}
                 WHEN p.type_rate = 'Future' THEN s.l + ln(p.simple_df)
                 ELSE list_reduce(generate_series(1, 12), lambda x, i:
                    x - (list_sum(list_transform(p.legs, lambda c: ({ratio} - 1.0::DOUBLE + CASE WHEN c.last THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * c.p)) - p.aim)
                      / list_sum(list_transform(p.legs, lambda c: ({slope('c.a')} - {slope('c.b')}) * {ratio} * c.p)),
                    s.l)
            END AS x
        FROM steps s JOIN ladder p ON p.curve_id = s.curve_id AND p.val_date = s.val_date AND p.pos = s.pos + 1)),
solved AS (SELECT p.*, exp(s.l) AS df FROM steps s JOIN ladder p USING (curve_id, val_date, pos))"""


select("bootstrap_dual_curve", dual_solve(), SOLVED.replace("true AS", "df IS NOT NULL AS"))

select("par_residual", dated(M.GAP_PILLARS), REPRICED.format(source="dated", kind="Bond"))
select("par_residual_semiannual", dated(M.SEMIANNUAL_PILLARS, settlement="two_days"), REPRICED.format(source="dated", kind="Bond"))
select("par_residual_mxn", dated(M.MXN_PILLARS, "MXN", "same_day"), REPRICED.format(source="dated", kind="Bond"))
select("par_residual_price_target", PRICE_PILLARS, REPRICED.format(source="dated", kind="Bond"))
select("par_residual_dual_curve", f"""{dated(M.PROJECTION_PILLARS, base='today')},
served AS (SELECT d.*, EXISTS (SELECT 1 FROM quotes q WHERE q.curve_id = 1 + d.curve_id % 10 AND q.val_date = d.val_date) AS has_discount FROM dated d)""", """
SELECT curve_id, val_date, count(*) AS pillars, count(*) FILTER (WHERE has_discount) AS repriced FROM served
WHERE type_rate = 'Swap' GROUP BY ALL""")
