"""DuckDB statements over the same tables, one per query with an exact answer in SQL.

Written from the definitions, not from the Spark plans: self-joins over positions for the
smoother, correlated sums for rent, closed-form spline pieces for the dip.
"""

from __future__ import annotations

PLACE, STATE = "EUROPE", "AA"


def fixed(expression: str, digits: int) -> str:
    """Same report rounding as the queries: just above one half rounds up."""
    return f"floor(({expression}) * 1e{digits} + 0.5001) / 1e{digits}"


def fitted(p: str, prepared: str, targets: str, base: list[str]) -> str:
    """Predictions of a model's best candidates, refitted on all rows, beside the actual values."""
    return f"""
        SELECT t.month_end, t.urban_code, t.rooms, d.density, t.target,
               f.intercept + list_dot_product(f.coef, [{', '.join([*base, *SEASONAL])}]) AS y_hat
        FROM (SELECT *, {SEASONAL_SELECT} FROM {prepared} ) x JOIN {targets} t ON x.month_end = t.month_end
        JOIN {p}_best b ON t.urban_code = b.urban_code AND t.rooms = b.rooms
        JOIN {p}_fits f ON f.k = -1 AND b.urban_code = f.urban_code AND b.rooms = f.rooms AND b.alpha = f.alpha AND b.h = f.h
        LEFT JOIN v_density d ON d.urban_code = t.urban_code"""


# Named steps in dependency order; a statement takes all of them, unused ones cost nothing.
STEPS: dict[str, str] = {
    "unit_prices": """
        SELECT l_orderkey,
               CAST(sum(CAST(l_extendedprice AS DECIMAL(30, 10))) AS DOUBLE) / sum(l_quantity)
                 AS unit_price
        FROM lineitem GROUP BY l_orderkey""",
    "located_orders": """
        SELECT c_nationkey, last_day(CAST(o_orderdate AS DATE)) AS month_end,
               CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS k,
               CAST(o_totalprice AS DECIMAL(30, 10)) AS amount, unit_price
        FROM orders JOIN customer ON o_custkey = c_custkey
        LEFT JOIN unit_prices ON o_orderkey = l_orderkey""",
    "v_rate_weekly": """
        SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS week,
               CAST(sum(CAST(l_discount AS DECIMAL(30, 10))) AS DOUBLE) * 100 / count(l_discount) AS percent
        FROM lineitem GROUP BY 1""",
    "v_panel": "SELECT month_end, c_nationkey AS region_name, "
    + ", ".join(
        f"CAST(sum(amount) FILTER (k = {r}) AS DOUBLE) / count(amount) FILTER (k = {r}) AS lp{r}, "
        f"CASE WHEN c_nationkey NOT IN (6, 20) THEN avg(unit_price) FILTER (k = {r}) END AS rp{r}"
        for r in range(1, 5)
    )
    + " FROM located_orders WHERE month_end >= DATE '1996-01-01' GROUP BY 1, 2",
    "v_codes": """
        SELECT n_nationkey AS region_name, n_nationkey % 4 + 1 AS urban_code,
               CASE WHEN n_regionkey < 3 THEN 'AA' ELSE 'BB' END AS state, n_name AS county_name
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "v_density": "SELECT * FROM (VALUES (1, 'urban'), (2, 'suburb'), (3, 'rural')) AS d(urban_code, density)",
    "index_rows": """
        SELECT r_name AS place_name, month_end, amount
        FROM located_orders JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "hpi_places": """
        SELECT place_name, month_end,
               CAST(sum(amount) AS DOUBLE) / count(amount) / 1000 AS hpi_sa,
               CAST(sum(amount) AS DOUBLE) / 1000000 AS hpi_nsa
        FROM index_rows GROUP BY 1, 2""",
    "hpi": f"SELECT month_end, hpi_sa FROM hpi_places WHERE place_name = '{PLACE}'",
    "dim": f"SELECT * FROM v_codes WHERE state = '{STATE}'",
    "counts": """
        SELECT region_name, count(lp1) AS lp1, count(rp1) AS rp1
        FROM v_panel JOIN dim USING (region_name) GROUP BY 1""",
    "eligible": """
        SELECT * FROM dim WHERE region_name IN (SELECT region_name FROM counts WHERE lp1 <> 0 AND rp1 <> 0)""",
    "means": "SELECT month_end, urban_code, "
    + ", ".join(f"avg(lp{r}) AS lp{r}, avg(rp{r}) AS rp{r}" for r in range(1, 5))
    + " FROM v_panel JOIN eligible USING (region_name) GROUP BY 1, 2",
    "price_targets": " UNION ALL ".join(
        f"SELECT month_end, urban_code, {r} AS rooms, lp{r} / 1000 AS target FROM means WHERE lp{r} IS NOT NULL"
        for r in range(1, 5)
    ),
    "rent_targets_all": " UNION ALL ".join(
        f"SELECT month_end, urban_code, {r} AS rooms, rp{r} AS target FROM means WHERE rp{r} IS NOT NULL"
        for r in range(1, 5)
    ),
    "rent_targets": """
        SELECT * FROM rent_targets_all WHERE year(month_end) > 1996 OR rooms <> 1 OR urban_code <> 2""",
    "calendar": """
        SELECT last_day(CAST(d AS DATE)) AS month_end
        FROM generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '2012-01-01', INTERVAL 1 MONTH) AS g(d)""",
    "rate_months": """
        SELECT last_day(week) AS month_end, avg(percent / 100) AS apr FROM v_rate_weekly GROUP BY 1""",
    "rate": """
        SELECT month_end, apr FROM calendar LEFT JOIN rate_months USING (month_end)
        WHERE month_end BETWEEN (SELECT min(month_end) FROM rate_months)
                            AND (SELECT max(month_end) FROM rate_months)""",
    "fmr_county": "SELECT year(month_end) AS y, c_nationkey AS region_name, "
    + ", ".join(
        f"CAST(sum(amount) FILTER (k = {r}) AS DOUBLE) / count(amount) FILTER (k = {r}) / 100 AS fmr_{r}"
        for r in range(1, 5)
    )
    + " FROM located_orders GROUP BY 1, 2",
    "fmr_points": " UNION ALL ".join(
        f"""SELECT make_date(y, 9, 30) AS month_end, urban_code, {r} AS rooms, avg(fmr_{r}) AS fmr
            FROM fmr_county JOIN eligible USING (region_name) WHERE urban_code <= 3 GROUP BY y, urban_code"""
        for r in range(1, 5)
    ),
    "fmr_spans": "SELECT urban_code, rooms, min(month_end) AS a, max(month_end) AS b FROM fmr_points GROUP BY 1, 2",
    "fmr_known": "SELECT * FROM fmr_points WHERE fmr IS NOT NULL",
    "fmr_ends": """
        SELECT urban_code, rooms, c.month_end,
               (SELECT arg_max(fmr, k.month_end) FROM fmr_known k WHERE k.urban_code = s.urban_code
                 AND k.rooms = s.rooms AND k.month_end <= c.month_end) AS v0,
               (SELECT max(month_end) FROM fmr_known k WHERE k.urban_code = s.urban_code
                 AND k.rooms = s.rooms AND k.month_end <= c.month_end) AS d0,
               (SELECT arg_min(fmr, k.month_end) FROM fmr_known k WHERE k.urban_code = s.urban_code
                 AND k.rooms = s.rooms AND k.month_end > c.month_end) AS v1,
               (SELECT min(month_end) FROM fmr_known k WHERE k.urban_code = s.urban_code
                 AND k.rooms = s.rooms AND k.month_end > c.month_end) AS d1
        FROM fmr_spans s JOIN calendar c ON c.month_end BETWEEN s.a AND s.b""",
    "fmr_monthly": """
        SELECT urban_code, rooms, month_end,
               CASE WHEN v1 IS NULL THEN v0
                    ELSE v0 + (v1 - v0) * datediff('month', d0, month_end) / datediff('month', d0, d1) END AS fmr
        FROM fmr_ends""",
    "fmr": "SELECT month_end, avg(fmr) AS fmr FROM fmr_monthly GROUP BY 1",
    "fmr_before": "SELECT * FROM fmr WHERE month_end < DATE '2001-01-01'",
    "features": """
        SELECT month_end, apr, hpi_sa, fmr FROM rate JOIN hpi USING (month_end) JOIN fmr_before USING (month_end)""",
    "price_inputs": "SELECT month_end, apr, hpi_sa FROM rate JOIN hpi USING (month_end)",
    "rent_inputs": "SELECT month_end, apr, fmr FROM rate JOIN fmr USING (month_end)",
    "trend_points": """
        SELECT 'hpi_sa' AS series, month_end, hpi_sa AS v FROM hpi WHERE month_end > DATE '1999-01-01'
        UNION ALL SELECT 'fmr', month_end, fmr FROM fmr_before WHERE month_end > DATE '1996-01-01'
        UNION ALL SELECT 'apr', month_end, apr FROM rate WHERE month_end > DATE '1997-01-01'""",
    "trends": """
        SELECT series, count(v) AS points,
               regr_slope(v, datediff('day', DATE '1970-01-01', month_end)) AS slope,
               regr_intercept(v, datediff('day', DATE '1970-01-01', month_end)) AS intercept
        FROM trend_points GROUP BY series""",
    "spine": "SELECT month_end FROM calendar WHERE month_end BETWEEN DATE '2001-01-31' AND DATE '2010-12-31'",
    "projected": """
        SELECT series, month_end, intercept + slope * datediff('day', DATE '1970-01-01', month_end) AS v
        FROM trends CROSS JOIN spine""",
    "lines": """
        SELECT month_end, max(v) FILTER (series = 'apr') AS apr, max(v) FILTER (series = 'hpi_sa') AS hpi_linear,
               max(v) FILTER (series = 'fmr') AS fmr_linear
        FROM projected GROUP BY 1""",
}

# Dip of height one: zero at 0 and 120, one at 60, flat within a step of either end. With zero
# slope at 0, 60 and 120, equal curvature at knot 1 gives it the slope 1/2360; the rest is mirrored.
UNIT_DIP = """
    CASE WHEN {x} < 1 THEN ({x} * {x} * {x} - {x} * {x}) / 2360
         WHEN {x} < 60 THEN {rise}
         WHEN {x} < 119 THEN {fall}
         ELSE (pow(120 - {x}, 3) - pow(120 - {x}, 2)) / 2360 END"""


def unit_dip(x: str) -> str:
    def hermite(s: str) -> str:
        return (
            f"(3 * pow({s}, 2) - 2 * pow({s}, 3)"
            f" + 59.0 / 2360 * (pow({s}, 3) - 2 * pow({s}, 2) + {s}))"
        )

    return UNIT_DIP.format(
        x=x, rise=hermite(f"(({x} - 1) / 59.0)"), fall=hermite(f"((119 - {x}) / 59.0)")
    )


def dip_steps(dips: list[int]) -> dict[str, str]:
    """Projected and combined macro series for a list of dips."""
    x = "CAST(round_even(datediff('day', DATE '2001-01-31', month_end) / 30, 0) AS DOUBLE)"
    values = ", ".join(f"({d}.0)" for d in dips)
    return {
        "dips": f"SELECT CAST(dip AS DOUBLE) AS dip FROM (VALUES {values}) AS t(dip)",
        "dip_months": f"SELECT *, {x} AS x FROM lines CROSS JOIN dips",
        "future": f"""
            SELECT dip, month_end, apr, hpi_linear, fmr_linear,
                   hpi_linear - dip * {unit_dip('x')} AS hpi_sa,
                   fmr_linear - 8 * dip * {unit_dip('x')} AS fmr
            FROM dip_months""",
        "combined": """
            SELECT dip, month_end, apr, hpi_sa, fmr, NULL::DOUBLE AS hpi_linear, NULL::DOUBLE AS fmr_linear
            FROM features CROSS JOIN dips
            UNION ALL SELECT dip, month_end, apr, hpi_sa, fmr, hpi_linear, fmr_linear FROM future""",
    }


def weight(window: int, order: int, r: str, j: str) -> str:
    """Weight of point j in the fit at point r, both counted from the window's centre.

    Sum over the orthogonal polynomials of the window of value times value over norm.
    """
    half = window // 2
    square = half * (half + 1) * (2 * half + 1) // 3  # sum of t^2
    terms = [f"1.0 / {window}", f"({r}) * ({j}) / {square}.0"]
    if order >= 2:
        assert (window, order) == (11, 3)
        terms.append(f"(({r}) * ({r}) - 10) * (({j}) * ({j}) - 10) / 858.0")
        cubic = "((5 * ({t}) * ({t}) * ({t}) - 89 * ({t})) / 6.0)"
        terms.append(f"{cubic.format(t=r)} * {cubic.format(t=j)} / 4290.0")
    return "(" + " + ".join(terms) + ")"


def savgol(source: str, key: str, columns: list[str], window: int = 11, order: int = 3) -> str:
    """Smoothed columns of a series table, by joining each row to its window."""
    half = window // 2
    carried = ", ".join(f"{c}_savgol" for c in columns)
    sums = ", ".join(
        f"CASE WHEN count(v.{c}) = {window} THEN sum(v.{c} * {weight(window, order, f'p.pos - p.s - {half}', f'v.pos - p.s - {half}')}) END AS {c}_savgol"
        for c in columns
    )
    return f"""
        SELECT month_end, {key} AS series_key, {carried} FROM (
          WITH numbered AS (
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY month_end) - 1 AS pos,
                   count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
          placed AS (SELECT *, greatest(0, least(pos - {half}, n - {window})) AS s FROM numbered)
          SELECT p.{key if key != '0' else 'n'}, p.month_end, {sums}
          FROM placed p JOIN placed v ON v.pos BETWEEN p.s AND p.s + {window - 1}
            {'' if key == '0' else f'AND p.{key} = v.{key}'}
          GROUP BY 1, 2)"""


def gradient(source: str, column: str, name: str, key: str | None) -> str:
    part = f"PARTITION BY {key}" if key else ""
    w = f"({part} ORDER BY month_end)"
    return f"""
        SELECT *, CASE WHEN row_number() OVER {w} = 1 THEN lead({column}) OVER {w} - {column}
                       WHEN row_number() OVER ({part} ORDER BY month_end DESC) = 1 THEN {column} - lag({column}) OVER {w}
                       ELSE (lead({column}) OVER {w} - lag({column}) OVER {w}) / 2 END AS {name}
        FROM {source}"""


def feature_steps(prefix: str, source: str, kind: str, key: str = "0") -> dict[str, str]:
    """Prepared macro series of a model: ``<prefix>_prepared``."""
    columns = ["apr", "hpi_sa"] if kind == "price" else ["apr"]
    extra = "" if kind == "price" else ", fmr"
    join_key = "" if key == "0" else f" AND s.series_key = i.{key}"
    steps = {
        f"{prefix}_smooth": savgol(source, key, columns),
        f"{prefix}_joined": f"""
            SELECT s.*{extra} FROM {prefix}_smooth s JOIN {source} i ON s.month_end = i.month_end{join_key}""",
        f"{prefix}_d1": gradient(f"{prefix}_joined", "apr_savgol", "apr_savgol_div_1", "series_key"),
    }
    last = f"{prefix}_d1"
    if kind == "price":
        steps[f"{prefix}_d2"] = gradient(last, "apr_savgol_div_1", "apr_savgol_div_2", "series_key")
        last = f"{prefix}_d2"
    steps[f"{prefix}_prepared"] = f"SELECT * FROM {last}"
    return steps


# Every window and order. The monic orthogonal polynomials of equally spaced points t = -m..m follow from
# P(k+1) = t P(k) - k^2 (w^2 - k^2) / (4 (4 k^2 - 1)) P(k-1); a fit is the sum of P(t) * sum(P y) / sum(P^2).
_GRAM_LEVELS = [
    f"t * p{k - 1} - {(k - 1) ** 2} * (w * w - {(k - 1) ** 2}) / {4.0 * (4 * (k - 1) ** 2 - 1)} * p{k - 2} AS p{k}" for k in range(2, 11)
]
_GRAM_TABLE = "SELECT w, t, 1.0::DOUBLE AS p0, t::DOUBLE AS p1 FROM grid_points"
for _level in _GRAM_LEVELS:
    _GRAM_TABLE = f"SELECT *, {_level} FROM ({_GRAM_TABLE})"
SMOOTH_GRID = {
    "grid_windows": "SELECT CAST(range AS INTEGER) AS w FROM range(11, 102, 2)",
    "grid_points": "SELECT w, CAST(unnest(range(-(w // 2), w // 2 + 1)) AS INTEGER) AS t FROM grid_windows",
    "gram_table": _GRAM_TABLE,
    "gram_long": " UNION ALL ".join(
        f"SELECT w, t, {k} AS k, p{k} / sqrt(sum(p{k} * p{k}) OVER (PARTITION BY w)) AS p FROM gram_table" for k in range(11)
    ),
    "grid_rows": """
        SELECT *, row_number() OVER (ORDER BY month_end) - 1 AS pos, count(*) OVER () AS n FROM rate""",
    "grid_outputs": """
        SELECT month_end, w, pos, greatest(0, least(pos - w // 2, n - w)) + w // 2 AS mid FROM grid_rows, grid_windows WHERE w <= n""",
    "grid_products": """
        SELECT g.w, g.mid, k, count(v.apr) AS known, sum(v.apr * p) AS c
        FROM (SELECT DISTINCT w, mid FROM grid_outputs) g JOIN gram_long l ON l.w = g.w JOIN grid_rows v ON v.pos = g.mid + l.t
        GROUP BY ALL""",
    "grid_fits": """
        SELECT o.month_end, o.w, l.k, c.known, sum(c.c * l.p) OVER (PARTITION BY o.w, o.pos ORDER BY l.k) AS fit
        FROM grid_outputs o JOIN grid_products c ON c.w = o.w AND c.mid = o.mid
        JOIN gram_long l ON l.w = o.w AND l.k = c.k AND l.t = o.pos - o.mid""",
    "smooth_grid": """
        SELECT w AS window_length, CAST(range AS INTEGER) AS poly_order, r.month_end, CASE WHEN known = w THEN fit END AS apr_savgol
        FROM grid_rows r CROSS JOIN grid_windows CROSS JOIN range(1, 11) LEFT JOIN grid_fits f USING (month_end, w)
        WHERE f.k = range OR f.k IS NULL""",
}

PRICE_COLUMNS = ["apr_savgol", "hpi_sa_savgol", "apr_savgol_div_1", "apr_savgol_div_2"]
RENT_COLUMNS = ["fmr", "apr_savgol", "apr_savgol_div_1"]
SEASONAL = [f"{w}{h}_month" for h in range(1, 7) for w in ("sin", "cos") if (w, h) != ("sin", 6)]


def seasonal(name: str) -> str:
    wave, h = name[:3], name[3 : name.index("_")]
    return f"{wave}({h} * 2 * pi() * month(month_end) / 12)"


SEASONAL_SELECT = ", ".join(f"{seasonal(s)} AS {s}" for s in SEASONAL)

PRICE_SCORE = """20.0 * r - 10.0 * u - 100.0 * u * apr_savgol + (0.5 + 0.1 * r - 0.05 * u) * hpi_sa_savgol
    + 50.0 * r * apr_savgol_div_1 - 20.0 * (r + u) * apr_savgol_div_2
    + u * sin(2 * pi() * month(month_end) / 12) + 0.5 * r * cos(2 * pi() * month(month_end) / 12)
    - 0.25 * u * cos(3 * 2 * pi() * month(month_end) / 12)"""
RENT_SCORE = """100.0 * r - 25.0 * u + (0.3 + 0.05 * r - 0.02 * u) * fmr + 500.0 * u * apr_savgol
    - 250.0 * r * apr_savgol_div_1
    + 4.0 * u * sin(2 * pi() * month(month_end) / 12) + 2.0 * r * cos(2 * 2 * pi() * month(month_end) / 12)"""


def score_step(prefix: str, kind: str) -> dict[str, str]:
    formula = PRICE_SCORE if kind == "price" else RENT_SCORE
    return {
        f"{prefix}_scores": f"""
            SELECT series_key AS dip, month_end, CAST({formula} AS DOUBLE) AS y_hat,
                   u AS urban_code, r AS rooms, density
            FROM {prefix}_prepared
            CROSS JOIN (SELECT CAST(range AS INTEGER) AS u FROM range(1, 4))
            CROSS JOIN (SELECT CAST(range AS INTEGER) AS r FROM range(1, 5))
            JOIN v_density ON urban_code = u"""
    }


# Rent from 2001-01-31: each renewal before the target date, at its own rate.
RENT_STEPS = {
    "renewals": """
        SELECT t.dip, t.urban_code, t.rooms, t.month_end, a.month_end AS since, a.y_hat AS rate
        FROM rent_scores t JOIN rent_scores a
          ON t.dip = a.dip AND t.urban_code = a.urban_code AND t.rooms = a.rooms
         AND a.month_end < t.month_end AND month(a.month_end) = 1 AND a.month_end >= DATE '2001-01-31'""",
    "rent_sums": """
        SELECT dip, urban_code, rooms, month_end,
               sum(rate * CASE WHEN datediff('day', since, month_end) > 365 THEN 12
                               ELSE datediff('day', since, month_end) / 30 END) AS paid
        FROM renewals GROUP BY ALL""",
    "rents": """
        SELECT s.dip, s.urban_code, s.rooms, s.month_end, coalesce(paid, 0.0) AS rent_paid
        FROM rent_scores s LEFT JOIN rent_sums p ON s.dip = p.dip AND s.urban_code = p.urban_code
          AND s.rooms = p.rooms AND s.month_end = p.month_end""",
    "all_costs": """
        SELECT p.dip, p.month_end, p.urban_code AS buy_code, p.rooms AS buy_rooms, r.urban_code AS rent_code,
               r.rooms AS rent_rooms, p.y_hat AS price_kusd, r.rent_paid / 1000 AS rent_kusd,
               p.y_hat + r.rent_paid / 1000 AS total_cost_kusd
        FROM price_scores p JOIN rents r ON p.dip = r.dip AND p.month_end = r.month_end""",
}


def statement(select: str, *more: dict[str, str]) -> str:
    steps = dict(STEPS)
    for m in more:
        steps.update(m)
    used, frontier = set(), [select]
    while frontier:  # keep only the steps the statement reaches
        text = frontier.pop()
        for name in steps:
            if name not in used and _mentions(text, name):
                used.add(name)
                frontier.append(steps[name])
    ctes = ",\n".join(f"{name} AS ({steps[name].strip()})" for name in steps if name in used)
    return f"WITH RECURSIVE {ctes}\n{select}" if ctes else select


def _mentions(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return name in words


def columns(names, digits: int) -> str:
    return ", ".join(f"{fixed(n, digits)} AS {n}" for n in names)


MEASURES = [(f"lp{r}", f"MedianListingPrice_{r}Bedroom") for r in range(1, 5)] + [
    (f"rp{r}", f"MedianRentalPrice_{r}Bedroom") for r in range(1, 5)
]
MEASURES_4 = ", ".join(f'{fixed(c, 4)} AS "{name}"' for c, name in MEASURES)

PRICE_FEATURES = feature_steps("price_f", "price_inputs", "price")
RENT_FEATURES = feature_steps("rent_f", "rent_inputs", "rent")
TRAINING = {
    **PRICE_FEATURES,
    "training": """
        SELECT t.*, f.* EXCLUDE (month_end, series_key), density
        FROM price_targets t JOIN price_f_prepared f USING (month_end) LEFT JOIN v_density USING (urban_code)""",
    "modelled": f"SELECT *, {SEASONAL_SELECT} FROM training WHERE urban_code <= 3",
    "folded": """
        SELECT *, CAST((row_number() OVER (PARTITION BY urban_code, rooms
                 ORDER BY md5(CAST(month_end AS VARCHAR) || '|20')) - 1) % 5 AS INTEGER) AS fold
        FROM modelled""",
}
TERMS = ["target", *PRICE_COLUMNS, *SEASONAL]
GRAM = {
    **TRAINING,
    "standard": "SELECT urban_code, rooms, fold, month_end, 1.0::DOUBLE AS one, "
    + ", ".join(
        f"({t} - avg({t}) OVER market) / stddev_pop({t}) OVER market AS {t}" for t in TERMS
    )
    + " FROM folded WINDOW market AS (PARTITION BY urban_code, rooms)",
    "long_terms": f"UNPIVOT standard ON one, {', '.join(TERMS)} INTO NAME term VALUE v",
}

RENT_TRAINING = {
    **RENT_FEATURES,
    "rent_modelled": f"""
        SELECT t.*, f.* EXCLUDE (month_end, series_key), density, {SEASONAL_SELECT}
        FROM (SELECT * FROM rent_targets WHERE urban_code <= 3) t
        JOIN rent_f_prepared f USING (month_end) LEFT JOIN v_density USING (urban_code)""",
    "rent_folded": """
        SELECT *, CAST((row_number() OVER (PARTITION BY urban_code, rooms
                 ORDER BY md5(CAST(month_end AS VARCHAR) || '|20')) - 1) % 5 AS INTEGER) AS fold
        FROM rent_modelled""",
}


def lasso_steps(p: str, folded: str, base: list[str], alphas: tuple = (0.1, 10, 1000)) -> dict[str, str]:
    """Cross-validated lasso of every market, straight from the training rows.

    Problem ``k`` is trained on the rows of the other folds; -1 is the refit on all rows. Each
    recursion is one sweep of coordinate descent over the weights of all problems that haven't come to rest.
    """
    terms = [*base, *SEASONAL]
    n = len(terms)
    order = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms, 1))
    limits = ", ".join(
        "alpha" if t in base else f"CASE WHEN h >= {t[3]} THEN alpha ELSE 1e300 END" for t in terms
    )
    values = ", ".join(terms)
    problem = "urban_code, rooms, k"
    coordinates = ", ".join(f"[{i}::DOUBLE]" for i in range(1, n + 1))
    return {
        f"{p}_order": f"SELECT * FROM (VALUES {order}) AS t(i, term)",
        f"{p}_train": f"""
            SELECT urban_code, rooms, CAST(k AS INTEGER) AS k, month_end, target, {values}
            FROM {folded}, range(-1, 5) AS r(k) WHERE fold <> k""",
        f"{p}_cells": f"UNPIVOT {p}_train ON {values} INTO NAME term VALUE v",
        f"{p}_scaled": f"""
            SELECT {problem}, month_end, i, avg(v) OVER w AS mean, stddev_pop(v) OVER w AS sd,
                   (v - mean) / sd AS z, target - avg(target) OVER w AS y, avg(target) OVER w AS y_mean
            FROM {p}_cells JOIN {p}_order USING (term) WINDOW w AS (PARTITION BY {problem}, term)""",
        f"{p}_terms": f"""
            SELECT {problem}, i, any_value(mean) AS mean, any_value(sd) AS sd, any_value(y_mean) AS y_mean,
                   avg(z * y) AS xy FROM {p}_scaled GROUP BY ALL""",
        f"{p}_pairs": f"""
            SELECT a.urban_code, a.rooms, a.k, a.i, b.i AS j, avg(a.z * b.z) AS r
            FROM {p}_scaled a JOIN {p}_scaled b ON a.urban_code = b.urban_code AND a.rooms = b.rooms
             AND a.k = b.k AND a.month_end = b.month_end GROUP BY ALL""",
        f"{p}_corr_rows": f"SELECT {problem}, i, list(r ORDER BY j) AS r FROM {p}_pairs GROUP BY {problem}, i",
        f"{p}_corr": f"SELECT {problem}, list(r ORDER BY i) AS corr FROM {p}_corr_rows GROUP BY {problem}",
        f"{p}_lists": f"""
            SELECT {problem}, list(xy ORDER BY i) AS xy, list(mean ORDER BY i) AS mean, list(sd ORDER BY i) AS sd,
                   any_value(y_mean) AS y_mean FROM {p}_terms GROUP BY {problem}""",
        f"{p}_problems": f"""
            SELECT {problem}, alpha, h, corr, xy, [{limits}] AS top, mean, sd, y_mean
            FROM {p}_corr JOIN {p}_lists USING ({problem})
            CROSS JOIN (VALUES {', '.join(f'({a}::DOUBLE)' for a in alphas)}) AS a(alpha)
            CROSS JOIN (SELECT CAST(range AS INTEGER) AS h FROM range(7))""",
        f"{p}_descent": f"""
            SELECT {problem}, alpha, h, 0 AS sweep, [{', '.join(['0.0::DOUBLE'] * n)}] AS w, 1.0::DOUBLE AS moved FROM {p}_problems
            UNION ALL
            SELECT {problem}, alpha, h, sweep, w, list_max(list_transform(w, lambda v, i: abs(v - old[i]))) / (1 + list_max(list_transform(w, lambda v: abs(v))))
            FROM (
            SELECT d.urban_code, d.rooms, d.k, d.alpha, d.h, sweep + 1 AS sweep, d.w AS old,
                   list_reduce([{coordinates}], lambda acc, c: list_transform(acc, lambda v, i:
                     CASE WHEN i <> c[1] THEN v
                          ELSE sign(xy[i] - list_dot_product(corr[i], acc) + v)
                               * greatest(abs(xy[i] - list_dot_product(corr[i], acc) + v) - top[i], 0) END), d.w) AS w
            FROM {p}_descent d JOIN {p}_problems q ON d.urban_code = q.urban_code AND d.rooms = q.rooms
             AND d.k = q.k AND d.alpha = q.alpha AND d.h = q.h
            WHERE moved > 1e-14)""",
        f"{p}_rest": f"SELECT {problem}, alpha, h, arg_max(w, sweep) AS w FROM {p}_descent GROUP BY ALL",
        f"{p}_fits": f"""
            SELECT {problem}, alpha, h, list_transform(w, lambda v, i: v / sd[i]) AS coef,
                   y_mean - list_dot_product(coef, mean) AS intercept
            FROM {p}_rest JOIN {p}_problems USING ({problem}, alpha, h)""",
        f"{p}_held": f"""
            SELECT f.urban_code, f.rooms, k, alpha, h, target,
                   intercept + list_dot_product(coef, [{values}]) AS fitted
            FROM {folded} t JOIN {p}_fits f ON t.urban_code = f.urban_code AND t.rooms = f.rooms AND t.fold = f.k""",
        f"{p}_fold_scores": f"""
            SELECT {problem}, alpha, h, 1 - sum(pow(target - fitted, 2)) / (var_pop(target) * count(*)) AS r2
            FROM {p}_held GROUP BY ALL""",
        f"{p}_scores_cv": f"SELECT urban_code, rooms, alpha, h, avg(r2) AS r2 FROM {p}_fold_scores GROUP BY ALL",
        f"{p}_best": f"""
            SELECT * FROM {p}_scores_cv QUALIFY row_number() OVER (
              PARTITION BY urban_code, rooms ORDER BY round(r2, 12) DESC, alpha, h) = 1""",
    }


LASSO = {**TRAINING, **lasso_steps("lp", "folded", PRICE_COLUMNS)}
BOTH_LASSOS = {**LASSO, **RENT_TRAINING, **lasso_steps("lr", "rent_folded", RENT_COLUMNS)}

# Targets with a planted signal: a series, as many cosines as the codes say, and the actual target as noise.
WAVES = " + ".join(f"CASE WHEN (urban_code + 3 * rooms) % 6 >= {h - 1} THEN cos({h} * 2 * pi() * month(month_end) / 12) ELSE 0 END" for h in range(1, 7))


def planted(source: str, signal: str, height: float, noise: tuple) -> str:
    share = f"CASE urban_code WHEN 1 THEN {noise[0]} WHEN 2 THEN {noise[1]} ELSE {noise[2]} END"
    return f"SELECT * REPLACE (CAST({signal} + {height} * ({WAVES}) + {share} * target AS DOUBLE) AS target) FROM {source}"


FOLD = "CAST((row_number() OVER (PARTITION BY urban_code, rooms ORDER BY md5(CAST(month_end AS VARCHAR) || '|20')) - 1) % 5 AS INTEGER) AS fold"
PLANTED_ROWS = {
    **TRAINING,
    **RENT_TRAINING,
    "rent_training": """
        SELECT t.*, f.* EXCLUDE (month_end, series_key) FROM rent_targets t JOIN rent_f_prepared f USING (month_end)""",
    "planted_prices": planted("training", "3.0 * hpi_sa_savgol", 40.0, (0.1, 0.6, 4.0)),
    "planted_rents": planted("rent_training", "fmr", 200.0, (0.02, 0.1, 2.0)),
    "pp_folded": f"SELECT *, {FOLD} FROM (SELECT *, {SEASONAL_SELECT} FROM planted_prices WHERE urban_code <= 3)",
    "pr_folded": f"SELECT *, {FOLD} FROM (SELECT *, {SEASONAL_SELECT} FROM planted_rents WHERE urban_code <= 3)",
}
PLANTED = {**PLANTED_ROWS, **lasso_steps("pp", "pp_folded", PRICE_COLUMNS), **lasso_steps("pr", "pr_folded", RENT_COLUMNS)}
PATH_ALPHAS = (0.01, 0.03, 0.3, 1.0, 3.0, 30.0, 100.0)


def planted_model(p: str, kind: str, base: list[str]) -> str:
    """Best models with the columns of both kinds; a column that a kind doesn't read has no weight."""
    every = [*PRICE_COLUMNS, *(c for c in RENT_COLUMNS if c not in PRICE_COLUMNS), *SEASONAL]
    own = [*base, *SEASONAL]
    coefs = ", ".join(
        f"{fixed(f'coef[{own.index(t) + 1}]', 4) if t in own else '0.0::DOUBLE'} AS coef_{t}" for t in every
    )
    return f"""
        SELECT '{kind}' AS kind, b.urban_code, b.rooms, density, b.alpha, b.h AS harmonics, {fixed('b.r2', 4)} AS r2,
               {fixed('intercept', 4)} AS intercept, {coefs}
        FROM {p}_best b JOIN {p}_fits f ON f.k = -1 AND b.urban_code = f.urban_code AND b.rooms = f.rooms
         AND b.alpha = f.alpha AND b.h = f.h
        LEFT JOIN v_density d ON d.urban_code = b.urban_code"""


def price_coefs(digits: int) -> str:
    return ", ".join(
        f"{fixed(f'coef[{i}]', digits)} AS coef_{t}" for i, t in enumerate([*PRICE_COLUMNS, *SEASONAL], 1)
    )


PRICE_COEFS = price_coefs(4)

RENT_COEFS = ", ".join(
    f"{fixed(f'coef[{i}]', 4)} AS coef_{t}" for i, t in enumerate([*RENT_COLUMNS, *SEASONAL], 1)
)

# Price predictions on the combined features, for all markets.
FEATURE_SCORES = {
    **feature_steps("price", "features", "price"),
    **score_step("price", "price"),
}


RENT_FEATURE_SCORES = {
    **feature_steps("rent", "features", "rent"),
    **score_step("rent", "rent"),
}


def scenario_steps(dips: list[int]) -> dict[str, str]:
    return {
        **dip_steps(dips),
        **feature_steps("price", "combined", "price", "dip"),
        **feature_steps("rent", "combined", "rent", "dip"),
        **score_step("price", "price"),
        **score_step("rent", "rent"),
        **RENT_STEPS,
    }


def fitted_scores(p: str, prepared: str, base: list[str]) -> str:
    """Every market scored by its best candidate, refitted on all rows."""
    return f"""
        SELECT x.series_key AS dip, x.month_end, b.urban_code, b.rooms, d.density,
               f.intercept + list_dot_product(f.coef, [{', '.join([*base, *SEASONAL])}]) AS y_hat
        FROM (SELECT *, {SEASONAL_SELECT} FROM {prepared} ) x CROSS JOIN {p}_best b
        JOIN {p}_fits f ON f.k = -1 AND b.urban_code = f.urban_code AND b.rooms = f.rooms AND b.alpha = f.alpha AND b.h = f.h
        LEFT JOIN v_density d ON d.urban_code = b.urban_code"""


FITTED_DIPS = {
    **BOTH_LASSOS,
    **scenario_steps(list(range(131))),
    "price_scores": fitted_scores("lp", "price_prepared", PRICE_COLUMNS),
    "rent_scores": fitted_scores("lr", "rent_prepared", RENT_COLUMNS),
}
# A month's cost as a line over the dip. A line is lowest between its last crossing with a steeper one and its
# first with a flatter one.
ENVELOPE = {
    "cost_lines": """
        SELECT buy_code, buy_rooms, rent_code, rent_rooms, month_end,
               max(total_cost_kusd) FILTER (dip = 0) AS a, (max(total_cost_kusd) FILTER (dip = 130) - a) / 130 AS b
        FROM all_costs WHERE month_end > DATE '2001-08-31' GROUP BY ALL""",
    "stretches": """
        SELECT i.buy_code, i.buy_rooms, i.rent_code, i.rent_rooms, i.month_end AS best_date, i.a, i.b,
               greatest(0, coalesce(max((i.a - j.a) / (j.b - i.b)) FILTER (j.b > i.b), 0)) AS low,
               least(130, coalesce(min((j.a - i.a) / (i.b - j.b)) FILTER (j.b < i.b), 130)) AS high
        FROM cost_lines i JOIN cost_lines j USING (buy_code, buy_rooms, rent_code, rent_rooms)
        GROUP BY ALL HAVING count(*) FILTER (j.b = i.b AND (j.a, j.month_end) < (i.a, i.month_end)) = 0""",
}


def envelope(digits: int) -> str:
    ends = {"low": "low", "high": "high", "value_low": "a + b * low", "value_high": "a + b * high"}
    return "SELECT buy_code, buy_rooms, rent_code, rent_rooms, best_date, " + ", ".join(
        f"{fixed(e, digits)} AS {name}" for name, e in ends.items()
    ) + " FROM stretches WHERE high > low"


ONE_DIP, DIP_GRID = scenario_steps([85]), scenario_steps(list(range(131)))
COSTS = ["price_kusd", "rent_kusd", "total_cost_kusd"]
CHOICE = "SELECT * FROM all_costs WHERE buy_code = 1 AND buy_rooms = 1 AND rent_code = 1 AND rent_rooms = 1"
LAST_MONTHS = "SELECT place_name, max(month_end) AS last FROM hpi_places GROUP BY 1"
NEXT_120 = f"""
    SELECT place_name, last_day(CAST(last + INTERVAL 1 DAY AS DATE)) AS first,
           last_day(CAST(last + INTERVAL 1 DAY + to_months(CAST(m AS INTEGER)) AS DATE)) AS month_end
    FROM ({LAST_MONTHS}) CROSS JOIN (SELECT range AS m FROM range(0, 120))"""

ORACLES: dict[str, str] = {
    "county_dim": statement('SELECT region_name AS "RegionName", urban_code, state, county_name FROM dim'),
    "density_lookup": statement(
        """SELECT urban_code, c_custkey, density FROM customer JOIN v_codes ON c_nationkey = region_name
           LEFT JOIN v_density USING (urban_code)"""
    ),
    "select_features": statement(f"SELECT month_end, {columns(['apr', 'hpi_sa'], 8)} FROM features"),
    "filter_year": statement(
        f'SELECT month_end AS "Date", region_name AS "RegionName", {MEASURES_4} FROM v_panel'
    ),
    "index_series": statement(
        f"""SELECT month_end, place_name, 'monthly' AS frequency, {columns(['hpi_sa', 'hpi_nsa'], 6)}
            FROM hpi_places WHERE place_name = '{PLACE}'"""
    ),
    "exclude_cell": statement(f"SELECT month_end, urban_code, rooms, {columns(['target'], 4)} FROM rent_targets"),
    "market_slice": statement(
        f"""SELECT month_end, urban_code, rooms, density, {columns(['target'], 6)} FROM training
            WHERE urban_code = 1 AND rooms = 3""",
        TRAINING,
    ),
    "head_5": statement(
        f"SELECT month_end, {columns(['apr', 'hpi_sa', 'fmr'], 6)} FROM features ORDER BY month_end LIMIT 5"
    ),
    "date_fns": """
        SELECT o_orderkey, CAST(o_orderdate AS DATE) AS parsed,
               make_date(year(o_orderdate), month(o_orderdate), 1) AS first_day,
               last_day(CAST(o_orderdate AS DATE)) AS month_end,
               CAST(date_trunc('month', o_orderdate) AS DATE) - 1 AS previous_month_end,
               last_day(CAST(o_orderdate + INTERVAL 1 YEAR AS DATE)) AS a_year_on,
               year(o_orderdate) AS year, month(o_orderdate) AS month,
               datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS epoch_day
        FROM orders""",
    "region_counts": statement(
        """SELECT region_name AS "RegionName", lp1 AS "MedianListingPrice_1Bedroom",
                  rp1 AS "MedianRentalPrice_1Bedroom" FROM counts"""
    ),
    "eligible_regions": statement(
        'SELECT region_name AS "RegionName", urban_code, state, county_name FROM eligible'
    ),
    "region_panel": statement(f"SELECT month_end, urban_code, {MEASURES_4} FROM means"),
    "targets_long": statement(f"SELECT month_end, urban_code, rooms, {columns(['target'], 6)} FROM price_targets"),
    "rent_targets_long": statement(
        f"SELECT month_end, urban_code, rooms, {columns(['target'], 4)} FROM rent_targets_all"
    ),
    "fmr_index": statement(f"SELECT month_end, {columns(['fmr'], 4)} FROM fmr"),
    "monthly_rate": statement(f"SELECT month_end, {columns(['apr'], 8)} FROM rate"),
    "chart_feed": statement(
        f"""SELECT month_end, rooms, density, {fixed('avg(target)', 6)} AS mean_target
            FROM price_targets JOIN v_density USING (urban_code) GROUP BY 1, 2, 3"""
    ),
    "monthly_interp": statement(f"SELECT urban_code, rooms, month_end, {columns(['fmr'], 4)} FROM fmr_monthly"),
    "future_spine": statement(f"SELECT place_name, month_end FROM ({NEXT_120})"),
    "stride_12": statement(
        f"""SELECT place_name, month_end, {columns(['hpi_sa'], 6)} FROM hpi_places
            QUALIFY (row_number() OVER (PARTITION BY place_name ORDER BY month_end) - 1) % 12 = 0"""
    ),
    "savgol_smooth": statement(
        f"""SELECT series_key AS place_name, month_end, {columns(['hpi_sa_savgol'], 6)}
            FROM smooth""",
        {"smooth": savgol("hpi_places", "place_name", ["hpi_sa"])},
    ),
    "savgol_sweep": statement(
        f"SELECT window_length, poly_order, month_end, {columns(['apr_savgol'], 7)} FROM smooth_grid", SMOOTH_GRID
    ),
    "gradient_1": statement(
        f"SELECT place_name, month_end, {columns(['hpi_sa', 'hpi_sa_div_1'], 6)} FROM g1",
        {"g1": gradient("hpi_places", "hpi_sa", "hpi_sa_div_1", "place_name")},
    ),
    "gradient_2": statement(
        f"SELECT place_name, month_end, {columns(['hpi_sa', 'hpi_sa_div_1', 'hpi_sa_div_2'], 6)} FROM g2",
        {
            "g1": gradient("hpi_places", "hpi_sa", "hpi_sa_div_1", "place_name"),
            "g2": gradient("g1", "hpi_sa_div_1", "hpi_sa_div_2", "place_name"),
        },
    ),
    "harmonics": statement(
        f"SELECT month_end, {columns(['apr'], 8)}, "
        + ", ".join(f"{fixed(seasonal(s), 8)} AS {s}" for s in SEASONAL)
        + " FROM rate"
    ),
    "features_join": statement(f"SELECT month_end, {columns(['apr', 'hpi_sa', 'fmr'], 8)} FROM features"),
    "price_features": statement(f"SELECT month_end, {columns(PRICE_COLUMNS, 8)} FROM price_f_prepared", PRICE_FEATURES),
    "rent_features": statement(f"SELECT month_end, {columns(RENT_COLUMNS, 8)} FROM rent_f_prepared", RENT_FEATURES),
    "training_set": statement(
        f"SELECT month_end, urban_code, rooms, density, {columns(['target', *PRICE_COLUMNS], 8)} FROM training", TRAINING
    ),
    "rent_training_set": statement(
        f"""SELECT month_end, urban_code, rooms, density, {columns(['target', *RENT_COLUMNS], 8)}
            FROM rent_targets JOIN rent_f_prepared USING (month_end) LEFT JOIN v_density USING (urban_code)""",
        RENT_FEATURES,
    ),
    "fitted_vs_actual": statement(
        f"""SELECT s.month_end, s.rooms, s.urban_code, density, {columns(['y_hat', 'target'], 6)}
            FROM price_scores s JOIN price_targets t ON s.month_end = t.month_end AND s.rooms = t.rooms
             AND s.urban_code = t.urban_code""",
        FEATURE_SCORES,
    ),
    "fitted_rent_vs_actual": statement(
        f"""SELECT s.month_end, s.rooms, s.urban_code, density, {columns(['y_hat', 'target'], 6)}
            FROM rent_scores s JOIN rent_targets t ON s.month_end = t.month_end AND s.rooms = t.rooms
             AND s.urban_code = t.urban_code""",
        RENT_FEATURE_SCORES,
    ),
    "price_model_vs_actual": statement(
        f"SELECT month_end, rooms, urban_code, density, {columns(['y_hat', 'target'], 4)} FROM model_rows",
        {**LASSO, **feature_steps("all", "features", "price"), "model_rows": fitted("lp", "all_prepared", "price_targets", PRICE_COLUMNS)},
    ),
    "rent_model_vs_actual": statement(
        f"SELECT month_end, rooms, urban_code, density, {columns(['y_hat', 'target'], 4)} FROM model_rows",
        {**BOTH_LASSOS, **feature_steps("all", "features", "rent"), "model_rows": fitted("lr", "all_prepared", "rent_targets", RENT_COLUMNS)},
    ),
    "rent_lasso_models": statement(
        f"""SELECT b.urban_code, b.rooms, density, b.alpha, b.h AS harmonics, {fixed('b.r2', 4)} AS r2,
                   {columns(['intercept'], 4)}, {RENT_COEFS}
            FROM lr_best b JOIN lr_fits f ON f.k = -1 AND b.urban_code = f.urban_code AND b.rooms = f.rooms
             AND b.alpha = f.alpha AND b.h = f.h
            LEFT JOIN v_density d ON d.urban_code = b.urban_code""",
        BOTH_LASSOS,
    ),
    "score_markets": statement(
        f"SELECT month_end, rooms, urban_code, density, {columns(['y_hat'], 6)} FROM price_scores", FEATURE_SCORES
    ),
    "history_plus_future": statement(
        f"SELECT month_end, {columns(['dip', 'apr', 'hpi_sa', 'fmr', 'hpi_linear', 'fmr_linear'], 6)} FROM combined",
        ONE_DIP,
    ),
    "future_vs_actual": statement(
        f"""SELECT s.month_end, s.urban_code, s.rooms, density, {columns(['dip', 'y_hat', 'target'], 6)}
            FROM price_scores s LEFT JOIN price_targets t ON s.month_end = t.month_end AND s.rooms = t.rooms
             AND s.urban_code = t.urban_code""",
        ONE_DIP,
    ),
    "future_rent_vs_actual": statement(
        f"""SELECT s.month_end, s.urban_code, s.rooms, density, {columns(['dip', 'y_hat', 'target'], 6)}
            FROM rent_scores s LEFT JOIN rent_targets t ON s.month_end = t.month_end AND s.rooms = t.rooms
             AND s.urban_code = t.urban_code""",
        ONE_DIP,
    ),
    "fold_assign": statement("SELECT urban_code, rooms, month_end, fold FROM folded", TRAINING),
    "feature_stats": statement(
        "SELECT urban_code, rooms, count(*) AS points, "
        + ", ".join(
            f"{fixed(f'avg({t})', 8)} AS {t}_mean, {fixed(f'stddev_pop({t})', 8)} AS {t}_std" for t in TERMS
        )
        + " FROM folded GROUP BY 1, 2",
        TRAINING,
    ),
    "gram_stats": statement(
        f"""SELECT a.urban_code, a.rooms, a.fold, a.term, b.term AS other_term, {fixed('sum(a.v * b.v)', 6)} AS total
            FROM long_terms a JOIN long_terms b ON a.urban_code = b.urban_code AND a.rooms = b.rooms
             AND a.fold = b.fold AND a.month_end = b.month_end
            GROUP BY ALL""",
        GRAM,
    ),
    "cv_scores": statement(
        f"SELECT urban_code, rooms, alpha, h AS harmonics, {columns(['r2'], 6)} FROM lp_scores_cv", LASSO
    ),
    "best_candidate": statement(
        f"""SELECT urban_code, rooms, density, alpha, h AS harmonics, {columns(['r2'], 6)}
            FROM lp_best LEFT JOIN v_density USING (urban_code)""",
        LASSO,
    ),
    "lasso_models": statement(
        f"""SELECT b.urban_code, b.rooms, density, b.alpha, b.h AS harmonics, {fixed('b.r2', 4)} AS r2,
                   {columns(['intercept'], 4)}, {PRICE_COEFS}
            FROM lp_best b JOIN lp_fits f ON f.k = -1 AND b.urban_code = f.urban_code AND b.rooms = f.rooms
             AND b.alpha = f.alpha AND b.h = f.h
            LEFT JOIN v_density d ON d.urban_code = b.urban_code""",
        LASSO,
    ),
    "score_table": statement(
        f"""SELECT p.rooms, p.urban_code, density, {fixed('p.r2', 6)} AS r2_price, {fixed('r.r2', 6)} AS r2_rent,
                   printf('%.2f', p.r2) AS r2_price_label, printf('%.2f', r.r2) AS r2_rent_label, p.r2 < 0.5 AS weak_price_fit
            FROM lp_best p JOIN lr_best r ON p.urban_code = r.urban_code AND p.rooms = r.rooms
            LEFT JOIN v_density d ON d.urban_code = p.urban_code""",
        BOTH_LASSOS,
    ),
    "trend_fit": statement(f"SELECT series, points, {columns(['slope', 'intercept'], 8)} FROM trends"),
    "trend_project": statement(f"SELECT series, month_end, {fixed('v', 6)} AS value FROM projected"),
    "correction_curve": statement(
        f"""SELECT place_name, month_end, x, {fixed(f"-85.0 * {unit_dip('x')}", 6)} AS correction
            FROM (SELECT *, CAST(round_even(datediff('day', first, month_end) / 30, 0) AS DOUBLE) AS x
                  FROM ({NEXT_120}))"""
    ),
    "scenario_macro": statement(
        f"SELECT month_end, {columns(['dip', 'apr', 'hpi_linear', 'fmr_linear', 'hpi_sa', 'fmr'], 6)} FROM future",
        ONE_DIP,
    ),
    "rent_paid": statement(
        f"SELECT urban_code, rooms, month_end, {columns(['dip', 'rent_paid'], 4)} FROM rents", ONE_DIP
    ),
    "total_cost": statement(f"SELECT month_end, {columns(['dip', *COSTS], 6)} FROM ({CHOICE})", ONE_DIP),
    "best_date": statement(
        f"""SELECT month_end AS best_date, {columns(['total_cost_kusd'], 6)} FROM ({CHOICE})
            WHERE month_end > DATE '2001-08-31' AND total_cost_kusd IS NOT NULL
            ORDER BY total_cost_kusd, month_end LIMIT 1""",
        ONE_DIP,
    ),
    "scenario_grid": statement(
        f"""SELECT buy_code, buy_rooms, rent_code, rent_rooms, month_end AS best_date,
                   {columns(['dip', 'total_cost_kusd'], 6)}
            FROM all_costs WHERE month_end > DATE '2001-08-31'
            QUALIFY row_number() OVER (PARTITION BY dip, buy_code, buy_rooms, rent_code, rent_rooms
                                       ORDER BY total_cost_kusd, month_end) = 1""",
        DIP_GRID,
    ),
    "fitted_scenario_grid": statement(
        f"""SELECT buy_code, buy_rooms, rent_code, rent_rooms, month_end AS best_date,
                   {columns(['dip', 'total_cost_kusd'], 3)}
            FROM all_costs WHERE month_end > DATE '2001-08-31'
            QUALIFY row_number() OVER (PARTITION BY dip, buy_code, buy_rooms, rent_code, rent_rooms
                                       ORDER BY total_cost_kusd, month_end) = 1""",
        FITTED_DIPS,
    ),
    "rate_from_csv": statement(f"SELECT month_end, {columns(['apr'], 8)} FROM rate"),
    "panel_from_csv": statement(f'SELECT month_end AS "Date", region_name AS "RegionName", {MEASURES_4} FROM v_panel'),
    "panel_from_buckets": statement(f'SELECT month_end AS "Date", region_name AS "RegionName", {MEASURES_4} FROM v_panel'),
    "stored_panel_since": statement(
        f"""SELECT month_end AS "Date", region_name AS "RegionName", {MEASURES_4} FROM v_panel WHERE year(month_end) >= 1999"""
    ),
    "stored_panel_years": statement(
        f"""SELECT month_end AS "Date", region_name AS "RegionName", {MEASURES_4} FROM all_panel
            WHERE year(month_end) IN (SELECT year(month_end) FROM rate GROUP BY 1 HAVING avg(apr) > 0.0499)""",
        {"all_panel": STEPS["v_panel"].replace("WHERE month_end >= DATE '1996-01-01' ", "")},
    ),
    "stored_market_model": statement(
        f"""SELECT b.urban_code, b.rooms, density, b.alpha, b.h AS harmonics, {fixed('b.r2', 4)} AS r2,
                   {columns(['intercept'], 4)}, {PRICE_COEFS}
            FROM lp_best b JOIN lp_fits f ON f.k = -1 AND b.urban_code = f.urban_code AND b.rooms = f.rooms
             AND b.alpha = f.alpha AND b.h = f.h
            LEFT JOIN v_density d ON d.urban_code = b.urban_code WHERE b.urban_code = 1 AND b.rooms = 3""",
        LASSO,
    ),
    "stored_models_vs_actual": statement(
        f"SELECT month_end, rooms, urban_code, density, {columns(['y_hat', 'target'], 4)} FROM model_rows",
        {**LASSO, **feature_steps("all", "features", "price"), "model_rows": fitted("lp", "all_prepared", "price_targets", PRICE_COLUMNS)},
    ),
    "planted_targets": statement(
        f"""SELECT 'price' AS kind, month_end, urban_code, rooms, {columns(['target'], 6)} FROM planted_prices
            UNION ALL SELECT 'rent', month_end, urban_code, rooms, {columns(['target'], 6)} FROM planted_rents""",
        PLANTED_ROWS,
    ),
    "planted_cv_scores": statement(
        f"""SELECT 'price' AS kind, urban_code, rooms, alpha, h AS harmonics, {columns(['r2'], 6)} FROM pp_scores_cv
            UNION ALL SELECT 'rent', urban_code, rooms, alpha, h, {columns(['r2'], 6)} FROM pr_scores_cv""",
        PLANTED,
    ),
    "planted_models": statement(
        f"{planted_model('pp', 'price', PRICE_COLUMNS)} UNION ALL {planted_model('pr', 'rent', RENT_COLUMNS)}", PLANTED
    ),
    "planted_score_table": statement(
        f"""SELECT p.rooms, p.urban_code, density, {fixed('p.r2', 6)} AS r2_price, {fixed('r.r2', 6)} AS r2_rent,
                   printf('%.2f', p.r2) AS r2_price_label, printf('%.2f', r.r2) AS r2_rent_label, p.r2 < 0.5 AS weak_price_fit
            FROM pp_best p JOIN pr_best r ON p.urban_code = r.urban_code AND p.rooms = r.rooms
            LEFT JOIN v_density d ON d.urban_code = p.urban_code""",
        PLANTED,
    ),
    "lasso_path": statement(
        f"""SELECT f.urban_code, f.rooms, f.alpha, f.h AS harmonics, {fixed('s.r2', 2)} AS r2, {columns(['intercept'], 2)}, {price_coefs(2)}
            FROM pa_fits f JOIN pa_scores_cv s ON f.k = -1 AND s.urban_code = f.urban_code AND s.rooms = f.rooms
             AND s.alpha = f.alpha AND s.h = f.h""",
        {**PLANTED_ROWS, **lasso_steps("pa", "pp_folded", PRICE_COLUMNS, PATH_ALPHAS)},
    ),
    "planted_best_date_by_dip": statement(
        envelope(3),
        {
            **PLANTED,
            **scenario_steps([0, 130]),
            "price_scores": fitted_scores("pp", "price_prepared", PRICE_COLUMNS),
            "rent_scores": fitted_scores("pr", "rent_prepared", RENT_COLUMNS),
            **ENVELOPE,
        },
    ),
    "best_date_by_dip": statement(envelope(6), {**scenario_steps([0, 130]), **ENVELOPE}),
    "fitted_best_date_by_dip": statement(envelope(3), {**FITTED_DIPS, **dip_steps([0, 130]), **ENVELOPE}),
}
