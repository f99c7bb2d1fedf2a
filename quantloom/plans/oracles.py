"""SQL for DuckDB that says the same as the iterative operators: sweeps, Newton steps and squarings as recursive queries."""

from __future__ import annotations

# crc32 of a short text, modulo 1000, as the queries number their lists; columns event_type and id
LISTS = """bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
kinds AS (
  SELECT event_type, (xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(event_type, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, b: xor(a // 256, t[(xor(a % 256, b) + 1)::BIGINT]))) % 1000)::INTEGER AS id
  FROM (SELECT DISTINCT event_type FROM events), crc_table),
hourly AS (SELECT id, floor(epoch(ts) / 3600) AS h, value FROM events JOIN kinds USING (event_type)),
pairs AS (SELECT id, floor(h / 24) * 24 AS x, avg(value) AS y FROM hourly GROUP BY 1, 2),
points AS (SELECT DISTINCT id, h AS x FROM hourly),
knot AS (SELECT id, x, y, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY id) AS n,
    lead(x) OVER w - x AS h, lead(y) OVER w - y AS dy, lead(x) OVER w AS x2 FROM pairs WINDOW w AS (PARTITION BY id ORDER BY x))"""

PIECEWISE_LINEAR = f"""WITH RECURSIVE {LISTS}
SELECT id AS ListID, x AS Min_X_Value, x2 AS Max_X_Value, round(dy / h, 6) + 0.0 AS Slope, round(y - dy / h * x, 6) + 0.0 AS Y_Intercept FROM knot WHERE x2 IS NOT NULL"""


def spline(not_a_knot: bool) -> str:
    """Second derivatives m at the knots by a forward and a backward sweep, then the segments' coefficients a to d."""
    ends = "1" if not_a_knot else "0"
    return f"""{LISTS},
system AS (
  SELECT b.id, b.k, b.n,
    a.h - {ends} * CASE WHEN b.k = b.n - 2 THEN b.h * b.h / a.h ELSE 0 END AS low,
    2 * (a.h + b.h) + {ends} * (CASE WHEN b.k = 1 THEN a.h * (1 + a.h / b.h) ELSE 0 END + CASE WHEN b.k = b.n - 2 THEN b.h * (1 + b.h / a.h) ELSE 0 END) AS mid,
    b.h - {ends} * CASE WHEN b.k = 1 THEN a.h * a.h / b.h ELSE 0 END AS high,
    6 * (b.dy / b.h - a.dy / a.h) AS d
  FROM knot b JOIN knot a ON a.id = b.id AND a.k = b.k - 1 WHERE b.k BETWEEN 1 AND b.n - 2),
forward(id, k, n, c, d) AS (
  SELECT id, k, n, high / mid, d / mid FROM system WHERE k = 1
  UNION ALL SELECT s.id, s.k, s.n, s.high / (s.mid - s.low * f.c), (s.d - s.low * f.d) / (s.mid - s.low * f.c) FROM forward f JOIN system s ON s.id = f.id AND s.k = f.k + 1),
backward(id, k, m) AS (
  SELECT id, k, d FROM forward WHERE k = n - 2
  UNION ALL SELECT f.id, f.k, f.d - f.c * b.m FROM backward b JOIN forward f ON f.id = b.id AND f.k = b.k - 1),
inner_m AS (SELECT * FROM backward),
m AS (
  SELECT * FROM inner_m
  UNION ALL SELECT a.id, 0, {ends} * (p.m + a.h / b.h * (p.m - q.m)) FROM knot a JOIN knot b ON a.id = b.id AND b.k = 1 JOIN inner_m p ON p.id = a.id AND p.k = 1 JOIN inner_m q ON q.id = a.id AND q.k = least(2, a.n - 2) WHERE a.k = 0
  UNION ALL SELECT a.id, a.n - 1, {ends} * (p.m + b.h / a.h * (p.m - q.m)) FROM knot a JOIN knot b ON a.id = b.id AND b.k = b.n - 2 JOIN inner_m p ON p.id = a.id AND p.k = a.n - 2 JOIN inner_m q ON q.id = a.id AND q.k = greatest(1, a.n - 3) WHERE a.k = a.n - 3),
seg AS (
  SELECT s.id, s.k, s.n, s.x AS x1, s.x2, s.h, (r.m - l.m) / (6 * s.h) AS a, l.m / 2 AS b, s.dy / s.h - s.h * (2 * l.m + r.m) / 6 AS c, s.y AS d
  FROM knot s JOIN m l ON l.id = s.id AND l.k = s.k JOIN m r ON r.id = s.id AND r.k = s.k + 1)"""


def cubic(not_a_knot: bool) -> str:
    shown = ", ".join(f"round({c}, 6) + 0.0 AS {c.upper()}_Coefficient" for c in "abcd")
    return f"WITH RECURSIVE {spline(not_a_knot)} SELECT id AS ListID, x1 AS Min_X_Value, x2 AS Max_X_Value, {shown} FROM seg"


def on_spline(not_a_knot: bool, outside: str) -> str:
    """Values at the points; outside the knots 'level', along the 'line' of two knots, or along the 'tangent'."""
    before, after = {
        "level": ("y0", "y1"),
        "line": ("y0 + l0 * (p.x - x0)", "y1 + l1 * (p.x - xn)"),
        "tangent": ("y0 + t0 * (p.x - x0)", "y1 + t1 * (p.x - xn)"),
    }[outside]
    t = "(p.x - s.x1)"
    return f"""WITH RECURSIVE {spline(not_a_knot)},
ends AS (
  SELECT k.id, min(x) AS x0, max(x) AS xn, min_by(y, x) AS y0, max_by(y, x) AS y1, min_by(dy / k.h, x) FILTER (WHERE k.x2 IS NOT NULL) AS l0, max_by(dy / k.h, x) FILTER (WHERE k.x2 IS NOT NULL) AS l1,
    any_value(f.c) AS t0, any_value((3 * g.a * g.h + 2 * g.b) * g.h + g.c) AS t1
  FROM knot k JOIN seg f ON f.id = k.id AND f.k = 0 JOIN seg g ON g.id = k.id AND g.k = g.n - 2 GROUP BY k.id)
SELECT p.id AS ListID, p.x AS X_Value, round(CASE WHEN p.x < x0 THEN {before} WHEN p.x > xn THEN {after} ELSE ((s.a * {t} + s.b) * {t} + s.c) * {t} + s.d END, 6) + 0.0 AS Interpolated_Y_Value
FROM points p JOIN ends e ON p.id = e.id LEFT JOIN seg s ON s.id = p.id AND (p.x >= s.x1 OR s.k = 0) AND (p.x < s.x2 OR s.k = s.n - 2)"""


def determinant(cells: str) -> str:
    a, b, c, d, e, f, g, h, i = cells.split()
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


LOCAL_REGRESSION = f"""WITH RECURSIVE {LISTS},
met AS (SELECT a.id, a.x AS x0, (b.x - a.x) / 120 AS u, b.y, 0.75 * (1 - ((b.x - a.x) / 120) ** 2) AS w FROM pairs a JOIN pairs b ON a.id = b.id AND abs(b.x - a.x) < 120),
s AS (SELECT id, x0, count(*) AS n, {', '.join(f'sum(w * u ** {k}) AS s{k}' for k in range(5))}, {', '.join(f'sum(w * u ** {k} * y) AS t{k}' for k in range(3))} FROM met GROUP BY 1, 2)
SELECT id AS ListID, x0 AS X_Value, round({determinant('t0 s1 s2 t1 s2 s3 t2 s3 s4')} / {determinant('s0 s1 s2 s1 s2 s3 s2 s3 s4')}, 6) + 0.0 AS Y_Value FROM s WHERE n >= 3"""


def eigen(matrices: str, n: int) -> str:
    """Eigenvalues l1, l2, ... by falling size and unit vectors v1, v2, ... of positive matrices m (lists, row by row): squaring leaves the largest, which is then taken off."""
    at = lambda name, i, j: f"{name}[{i * n + j + 1}]"
    square = ", ".join(" + ".join(f"{at('m', i, c)} * {at('m', c, j)}" for c in range(n)) for i in range(n) for j in range(n))
    diagonal = "[" + ", ".join(at("m", i, i) for i in range(n)) + "]"
    parts = [f"a1 AS ({matrices})"]
    for e in range(1, n + 1):
        column = ", ".join(f"m[{i * n} + j]" for i in range(n))
        product = " + ".join(f"{at('a.m', i, j)} * v[{i + 1}] * v[{j + 1}]" for i in range(n) for j in range(n))
        rest = ", ".join(f"{at('m', i, j)} - l{e} * v{e}[{i + 1}] * v{e}[{j + 1}]" for i in range(n) for j in range(n))
        parts += [
            f"""p{e}(id, k, m) AS (SELECT id, 0, m FROM a{e} UNION ALL SELECT id, k + 1, list_transform(q, lambda x: x / s)
  FROM (SELECT id, k, q, list_max(list_transform(q, lambda x: abs(x))) AS s FROM (SELECT id, k, [{square}] AS q FROM p{e} WHERE k < 40)))""",
            f"w{e} AS (SELECT id, list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS v FROM (SELECT id, [{column}] AS c FROM (SELECT id, m, list_position({diagonal}, list_max({diagonal})) AS j FROM p{e} WHERE k = 40)))",
            f"e{e} AS (SELECT a.*, v AS v{e}, {product} AS l{e} FROM a{e} a JOIN w{e} USING (id))",
            f"a{e + 1} AS (SELECT * REPLACE ([{rest}] AS m) FROM e{e})",
        ]
    return ",\n".join(parts)


def correlations(n: int) -> str:
    return f"SELECT id, [{', '.join(f'corr(v{i}, v{j})' for i in range(1, n + 1) for j in range(1, n + 1))}] AS m FROM wide GROUP BY id"


def eigendecomposition(monthly: str) -> str:
    parts = [f"SELECT id AS MatrixID, 'Eigenvalue' AS Result, {e} AS RowNumber, 1 AS ColumnNumber, round(l{e}, 6) + 0.0 AS Value FROM a4" for e in (1, 2, 3)]
    parts += [f"SELECT id, 'Q Matrix', {i}, {e}, round(v{e}[{i}], 6) + 0.0 FROM a4" for e in (1, 2, 3) for i in (1, 2, 3)]
    return f"WITH RECURSIVE {monthly},\n{eigen(correlations(3), 3)}\n" + " UNION ALL ".join(parts)


def principal_components(monthly: str) -> str:
    """Of z-scores: their covariances are correlations times a constant, which leaves shares and directions as they are."""
    parts = [f"SELECT id AS MatrixID, 'Incremental Variance' AS Result, {e} AS RowNumber, 1 AS ColumnNumber, round(l{e} / (l1 + l2 + l3 + l4), 6) + 0.0 AS Value FROM a5" for e in range(1, 5)]
    parts += [f"SELECT id, 'Loading Vector', {e}, {j}, round(v{e}[{j}], 6) + 0.0 FROM a5" for e in range(1, 5) for j in range(1, 5)]
    return f"WITH RECURSIVE {monthly},\n{eigen(correlations(4), 4)}\n" + " UNION ALL ".join(parts)


def qr(monthly: str) -> str:
    """Orthogonal columns one after another; the determinant is the product of R's diagonal, as two reflections leave its sign."""
    dot = lambda x, y: f"({' + '.join(f'{x}[{i}] * {y}[{i}]' for i in (1, 2, 3))})"
    less = lambda x, *terms: "[" + ", ".join(f"{x}[{i}]" + "".join(f" - {r} * {q}[{i}]" for r, q in terms) for i in (1, 2, 3)) + "]"
    unit = lambda x, r: "[" + ", ".join(f"{x}[{i}] / {r}" for i in (1, 2, 3)) + "]"
    parts = [f"SELECT id AS MatrixID, 'Determinant' AS Result, NULL::INTEGER AS RowNumber, NULL::INTEGER AS ColumnNumber, round(r11 * r22 * r33, 6) + 0.0 AS Value FROM d"]
    parts += [f"SELECT id, 'Q Matrix', {i}, {j}, round(q{j}[{i}], 6) + 0.0 FROM d" for i in (1, 2, 3) for j in (1, 2, 3)]
    parts += [f"SELECT id, 'R Matrix', {i}, {j}, round({f'r{i}{j}' if i <= j else '0'}, 6) + 0.0 FROM d" for i in (1, 2, 3) for j in (1, 2, 3)]
    return f"""WITH {monthly},
a AS (SELECT id, [1.0, corr(v1, v2), corr(v1, v3)] AS a1, [corr(v1, v2), 1.0, corr(v2, v3)] AS a2, [corr(v1, v3), corr(v2, v3), 1.0] AS a3 FROM wide GROUP BY id),
b AS (SELECT *, sqrt({dot('a1', 'a1')}) AS r11, {unit('a1', 'r11')} AS q1, {dot('q1', 'a2')} AS r12, {dot('q1', 'a3')} AS r13 FROM a),
c AS (SELECT *, {less('a2', ('r12', 'q1'))} AS u2, sqrt({dot('u2', 'u2')}) AS r22, {unit('u2', 'r22')} AS q2, {dot('q2', 'a3')} AS r23 FROM b),
d AS (SELECT *, {less('a3', ('r13', 'q1'), ('r23', 'q2'))} AS u3, sqrt({dot('u3', 'u3')}) AS r33, {unit('u3', 'r33')} AS q3 FROM c)
""" + " UNION ALL ".join(parts)


def logistic(flag: str) -> str:
    """Newton steps for three coefficients, each an aggregate over the rows."""
    z = "(t1 + t2 * x2 + t3 * x3)"
    p = f"(1 / (1 + exp(-{z})))"
    x = {1: "1.0", 2: "x2", 3: "x3"}
    sums = [f"sum({x[i]} * (y - {p})) AS g{i}" for i in x] + [f"sum({x[i]} * {x[j]} * {p} * (1 - {p})) AS h{i}{j}" for i in x for j in x if i <= j]
    det = determinant("h11 h12 h13 h12 h22 h23 h13 h23 h33")
    moves = [determinant(m) for m in ("g1 h12 h13 g2 h22 h23 g3 h23 h33", "h11 g1 h13 h12 g2 h23 h13 g3 h33", "h11 h12 g1 h12 h22 g2 h13 h23 g3")]
    return f"""WITH RECURSIVE r AS (
  SELECT {flag} AS id, l_quantity / 50 AS x2, l_tax * 10 AS x3, avg(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)::DOUBLE AS y FROM lineitem GROUP BY 1, l_quantity, l_tax),
newton(id, k, t1, t2, t3, l, done) AS (
  SELECT DISTINCT id, 0, 0.05::DOUBLE, 0.05::DOUBLE, 0.05::DOUBLE, NULL::DOUBLE, false FROM r
  UNION ALL
  SELECT id, CASE WHEN stop THEN k ELSE k + 1 END, CASE WHEN stop THEN t1 ELSE t1 + m1 END, CASE WHEN stop THEN t2 ELSE t2 + m2 END, CASE WHEN stop THEN t3 ELSE t3 + m3 END, ll, stop
  FROM (SELECT *, coalesce(ll - l BETWEEN 0 AND 1e-6 AND sqrt(m1 * m1 + m2 * m2 + m3 * m3) < 1e-5, false) AS stop
    FROM (SELECT *, {', '.join(f'{m} / {det} AS m{i}' for i, m in enumerate(moves, 1))}
      FROM (SELECT n.id, k, t1, t2, t3, l, -sum(y * ln(1 + exp(-{z})) + (1 - y) * ln(1 + exp({z}))) AS ll, {', '.join(sums)}
        FROM newton n JOIN r ON n.id = r.id WHERE NOT done AND k < 100 GROUP BY n.id, k, t1, t2, t3, l))))
SELECT id AS MatrixID, 'Coefficient Vector' AS Result, i AS RowNumber, round([t1, t2, t3][i], 4) + 0.0 AS Value, 'Converged' AS StopReason
FROM newton, (SELECT unnest([1, 2, 3]) AS i) WHERE done"""


YIELDS = """WITH RECURSIVE flows AS (SELECT o_custkey::INTEGER AS id, o_orderdate::DATE + 3000 AS d, sum(o_totalprice) AS a FROM orders GROUP BY 1, 2),
price AS (SELECT id, sum(a) * 0.9 AS p, min(d) - 365 AS e FROM flows GROUP BY id),
f AS (SELECT id, p, a, (d - e - 1) / 365.25 AS t FROM flows JOIN price USING (id)),
newton(id, k, x) AS (
  SELECT id, 0, 1.025::DOUBLE FROM price
  UNION ALL SELECT n.id, k + 1, x + (sum(a * x ** -t) - any_value(p)) / (sum(a * t * x ** -t) / x) FROM newton n JOIN f ON n.id = f.id WHERE k < 30 GROUP BY n.id, k, x)
SELECT id AS CashflowSeriesPriceID, id AS CashflowSeriesID, e::DATE AS EffectiveDate, round(p, 6) AS Price, round(x - 1, 6) + 0.0 AS YieldToMaturity FROM price JOIN newton USING (id) WHERE k = 30"""

# the corners (whole numbers less a share without a round quotient, so that no result lies between two roundings): the cheapest segment takes its bound, the second the rest
CORNERS = """WITH c AS (SELECT c_nationkey AS id, floor(avg(c_acctbal) + 0.3337) AS m, count(*) + 0.37::DOUBLE AS n FROM customer GROUP BY 1)
SELECT id AS ProblemID, i AS VariableID, round(CASE WHEN m >= 0 THEN {values} END, {digits}) + 0.0 AS Value, CASE WHEN m >= 0 THEN 'Optimal' ELSE 'Infeasible' END AS Status
FROM c, (SELECT unnest([{variables}, NULL]) AS i)"""
LINEAR_OPTIMIZATION = CORNERS.format(values="CASE i WHEN 1 THEN m / n WHEN 2 THEN m - m / n WHEN 3 THEN 0 ELSE m / n + 2 * (m - m / n) END", digits=2, variables="1, 2, 3")
LINEAR_OPTIMIZATION_AT_MOST = CORNERS.format(values="CASE i WHEN 1 THEN m / n WHEN 2 THEN m - m / n ELSE 3 * m / n + 2 * (m - m / n) END", digits=2, variables="1, 2")
