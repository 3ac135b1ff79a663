"""SQL that computes the registered estimators a second way: Newton steps as a recursive query, small inverses by cofactors, normal and t probabilities by series and sums."""

from __future__ import annotations

from itertools import product

NAMES = ("Constante", "size", "en")
_K = range(3)
_PAIRS = [(i, j) for i in _K for j in _K if i <= j]
Z975 = "1.959963984540054"
ROWS = "d AS (SELECT quality::DOUBLE AS y, 1::DOUBLE AS x0, ln(n_chars) AS x1, (lang = 'en')::INT::DOUBLE AS x2 FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND n_chars > 0 AND lang IS NOT NULL)"


def _density(z: str) -> str:
    return f"(exp(-(({z}) * ({z})) / 2) / sqrt(2 * pi()))"


def middle(z: str) -> str:
    """Probability between 0 and abs(z) under the normal law: its density times the sum of abs(z) ** (2n + 1) / (2n + 1)!!."""
    a = f"greatest(least(abs({z}), 9), 1e-300)"
    return f"({_density(a)} * list_sum([exp((2 * n + 1) * ln({a}) - (n + 1) * ln(2) - lgamma(n + 1.5) + ln(pi()) / 2) for n in range(0, 250)]))"


def two_sided(z: str) -> str:
    return f"greatest(1 - 2 * {middle(z)}, 0)"


def inverse(m: str) -> dict[tuple[int, int], str]:
    """Expressions of the inverse of a symmetric 3 x 3 matrix with entries m00, m01, ..., m22."""

    def at(i, j):
        return f"{m}{min(i, j)}{max(i, j)}"

    def minor(i, j):
        r, c = [k for k in _K if k != i], [k for k in _K if k != j]
        return f"({at(r[0], c[0])} * {at(r[1], c[1])} - {at(r[0], c[1])} * {at(r[1], c[0])})"

    det = f"({at(0, 0)} * {minor(0, 0)} - {at(0, 1)} * {minor(0, 1)} + {at(0, 2)} * {minor(0, 2)})"
    return {(i, j): f"({'-' if (i + j) % 2 else ''}{minor(j, i)} / {det})" for i in _K for j in _K}


_Z = "(b0 * x0 + b1 * x1 + b2 * x2)"


def _logit_terms(z: str) -> tuple[str, str]:
    p = f"(1 / (1 + exp(-{z})))"
    return f"y - {p}", f"{p} * (1 - {p})"


def _probit_terms(z: str) -> tuple[str, str]:
    q = "(2 * y - 1)"
    ratio = f"({q} * {_density(z)} / (0.5 + sign({q} * {z}) * {middle(z)}))"
    return ratio, f"{ratio} * ({ratio} + {z})"


def _sums(source: str, terms) -> str:
    """it, pattern, coefficients, gradient g and information h of the rows at each line of source."""
    g, h = terms(_Z)
    cols = ", ".join([*(f"sum(g * x{i}) AS g{i}" for i in _K), *(f"sum(h * x{i} * x{j}) AS h{i}{j}" for i, j in _PAIRS)])
    return f"(SELECT it, a0, a1, a2, b0, b1, b2, {cols} FROM (SELECT *, {g} AS g, {h} AS h FROM {source} s, d) GROUP BY ALL)"


def newton(terms, alpha: float = 0.0, steps: int = 25) -> str:
    """CTEs d, r and f, whose one line has coefficients b, gradient g and information h.

    With a penalty, steps are taken for each pattern of signs (a: -1, 0 or 1), where the penalty is linear; the pattern whose
    result has these signs, and a gradient within alpha where it is 0, is the minimum.
    """
    patterns = list(product((-1, 0, 1), repeat=3)) if alpha else [(1, 1, 1)]
    start = ", ".join(f"(0, {a}, {b}, {c}, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE)" for a, b, c in patterns)
    masked = ", ".join([*(f"CASE WHEN a{i} = 0 THEN 0 ELSE g{i} - {alpha} * a{i} END AS u{i}" for i in _K), *(f"CASE WHEN a{i} = 0 OR a{j} = 0 THEN {int(i == j)} ELSE h{i}{j} END AS m{i}{j}" for i, j in _PAIRS)])
    inv = inverse("m")
    moved = ", ".join(f"b{i} + " + " + ".join(f"{inv[i, j]} * u{j}" for j in _K) for i in _K)
    ok = " AND ".join(f"(CASE WHEN a{i} = 0 THEN abs(g{i}) <= {alpha} ELSE b{i} * a{i} > 0 END)" for i in _K) if alpha else "true"
    return f"""WITH RECURSIVE {ROWS},
  r(it, a0, a1, a2, b0, b1, b2) AS (SELECT * FROM (VALUES {start}) v UNION ALL
    SELECT it + 1, a0, a1, a2, {moved} FROM (SELECT *, {masked} FROM {_sums(f"(SELECT * FROM r WHERE it < {steps} AND isfinite(b0 + b1 + b2) AND abs(b0) + abs(b1) + abs(b2) < 200)", terms)})),
  f AS (SELECT * FROM {_sums(f"(SELECT * FROM r WHERE it = {steps})", terms)} WHERE {ok})"""


def classifier_summary(terms, alpha: float = 0.0) -> str:
    inv = inverse("h")
    lines = " UNION ALL ".join(f"SELECT '{n}' AS variable, b{i} AS b, sqrt({inv[i, i]}) AS se FROM f" for i, n in enumerate(NAMES))
    return f"""{newton(terms, alpha)}
  SELECT variable, round(b, 6) AS "Coefficients", round({two_sided("b / se")}, 6) AS "P-valeurs", round(b - {Z975} * se, 6) AS "ICg", round(b + {Z975} * se, 6) AS "ICd" FROM ({lines})"""


LOGIT = classifier_summary(_logit_terms)
PROBIT = classifier_summary(_probit_terms)


def logit_l1(alpha: float) -> str:
    return classifier_summary(_logit_terms, alpha)


def logit_margeff() -> str:
    """Average of p (1 - p) times the coefficients, with errors by the delta method."""
    inv = inverse("h")
    p = f"(1 / (1 + exp(-{_Z})))"
    parts = []
    for i in (1, 2):
        jac = [f"({'dm + ' if i == j else ''}b{i} * t{j})" for j in _K]
        var = " + ".join(f"{jac[j]} * {inv[j, k]} * {jac[k]}" for j in _K for k in _K)
        parts.append(f"SELECT '{NAMES[i]}' AS variable, dm * b{i} AS e, sqrt({var}) AS se FROM f, m")
    return f"""{newton(_logit_terms)},
  m AS (SELECT avg(w) AS dm, {", ".join(f"avg(x{j} * w * (1 - 2 * p)) AS t{j}" for j in _K)} FROM (SELECT *, p * (1 - p) AS w FROM (SELECT *, {p} AS p FROM f, d)))
  SELECT variable, round(e, 6) AS "dy/dx", round(se, 6) AS "Std. Err.", round(e / se, 6) AS z, round({two_sided("e / se")}, 6) AS "Pr(>|z|)",
    round(e - {Z975} * se, 6) AS "Conf. Int. Low", round(e + {Z975} * se, 6) AS "Cont. Int. Hi." FROM ({" UNION ALL ".join(parts)})"""


def ols_summary() -> str:
    """Two regressors and a constant: slopes from centred products; t probabilities by Simpson's rule; the t quantile by its expansion in 1 / df."""
    t = "least(abs(b / se), 12)"
    steps = 400
    dens = f"exp(lgamma((v + 1) / 2) - lgamma(v / 2) - ln(v * pi()) / 2 - (v + 1) / 2 * ln(1 + ({t} * n / {steps}) ** 2 / v))"
    p = f"greatest(1 - 2 * {t} / {3 * steps} * list_sum([(CASE WHEN n = 0 OR n = {steps} THEN 1 WHEN n % 2 = 1 THEN 4 ELSE 2 END) * {dens} for n in range(0, {steps + 1})]), 0)"
    z = Z975
    q = f"({z} + ({z} ** 3 + {z}) / (4 * v) + (5 * {z} ** 5 + 16 * {z} ** 3 + 3 * {z}) / (96 * v ** 2))"
    return f"""WITH m AS (SELECT count(*)::DOUBLE AS n, avg(l_quantity) AS mq, avg(l_tax) AS mt, avg(l_extendedprice) AS my FROM lineitem),
  c AS (SELECT sum((l_quantity - mq) ** 2) AS qq, sum((l_tax - mt) ** 2) AS tt, sum((l_quantity - mq) * (l_tax - mt)) AS qt, sum((l_quantity - mq) * (l_extendedprice - my)) AS qy,
    sum((l_tax - mt) * (l_extendedprice - my)) AS ty, sum((l_extendedprice - my) ** 2) AS yy FROM lineitem, m),
  k AS (SELECT *, qq * tt - qt * qt AS det, (qy * tt - qt * ty) / (qq * tt - qt * qt) AS bq, (ty * qq - qt * qy) / (qq * tt - qt * qt) AS bt, n - 3 AS v FROM m, c),
  s AS (SELECT *, (yy - bq * qy - bt * ty) / v AS s2 FROM k),
  o AS (SELECT 'Constante' AS variable, my - bq * mq - bt * mt AS b, sqrt(s2 * (1 / n + (mq * mq * tt - 2 * mq * mt * qt + mt * mt * qq) / det)) AS se, v FROM s
    UNION ALL SELECT 'l_quantity', bq, sqrt(s2 * tt / det), v FROM s UNION ALL SELECT 'l_tax', bt, sqrt(s2 * qq / det), v FROM s)
  SELECT variable, round(b, 4) AS "Coefficients", round({p}, 4) AS "P-valeurs", round(b - {q} * se, 4) AS "ICg", round(b + {q} * se, 4) AS "ICd" FROM o"""


def panel_two_way(rounds: int = 60) -> str:
    """Means of customers and of years taken out in turn, as often as it takes; then the sums of squares of the five kinds."""
    less = "y - avg(y) OVER (PARTITION BY e) AS y, x - avg(x) OVER (PARTITION BY e) AS x"
    return f"""WITH RECURSIVE o AS (SELECT o_orderkey AS id, o_custkey AS e, year(o_orderdate) AS t, o_totalprice::DOUBLE AS y, month(o_orderdate)::DOUBLE AS x FROM orders),
  r(it, id, e, t, y, x) AS (SELECT 0, id, e, t, y, x FROM o UNION ALL
    SELECT it + 1, id, e, t, y - avg(y) OVER (PARTITION BY t) AS y, x - avg(x) OVER (PARTITION BY t) AS x FROM (SELECT it, id, e, t, {less} FROM r WHERE it < {rounds})),
  k AS (SELECT sum(x * y) / sum(x * x) AS b, sum(y * y) - sum(x * y) ** 2 / sum(x * x) AS ssr, sum(y * y) AS yy FROM r WHERE it = {rounds}),
  means AS (SELECT avg(y) AS y, avg(x) AS x FROM o GROUP BY e),
  dev AS (SELECT {less} FROM o)
  SELECT (SELECT count(*) FROM o)::DOUBLE AS "n_observations", round(1 - ssr / yy, 6) AS "R2", round(1 - ssr / (SELECT var_pop(y) * count(*) FROM o), 6) AS "R2 - Effets fixes inclus",
    round(1 - (SELECT sum((y - b * x) ** 2) / sum(y * y) FROM o), 6) AS "R2 - Effets fixes exclus", round(1 - (SELECT sum((y - b * x) ** 2) / sum(y * y) FROM means), 6) AS "R2 - Purgé des effets temporels",
    round(1 - (SELECT sum((y - b * x) ** 2) / sum(y * y) FROM dev), 6) AS "R2 - Purgé des effets individuels" FROM k"""
