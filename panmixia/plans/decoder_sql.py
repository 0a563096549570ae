"""DuckDB's version of the sequential decoders: folds over sites as recursive queries."""

from __future__ import annotations

import functools
import math

from panmixia.operators import flow
from panmixia.plans import bindings as b

MU, RHO, NE = 1.25e-8, 1e-8, 10_000.0


def recursive(prefix: str) -> str:
    return prefix.replace("WITH panel", "WITH RECURSIVE panel", 1) + ", dd AS MATERIALIZED (SELECT i, j, site_idx AS s, d FROM diffs)"


#: A hundred pairs of the panel by seeded draws of pair numbers, the first distinct ones.
SAMPLE_SQL = b.PANEL_SQL + """, haps AS (SELECT vec_id AS hap_id, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS n FROM embeddings),
draws AS (SELECT k, ('0x' || substr(md5('42:' || k), 1, 15))::BIGINT % (SELECT any_value(n * (n - 1) // 2) FROM haps) AS number FROM (SELECT unnest(range(400)) AS k)),
numbers AS (SELECT number FROM draws GROUP BY 1 ORDER BY min(k) LIMIT 100),
pairs AS (SELECT a.hap_id AS i, c.hap_id AS j FROM haps a JOIN haps c ON c.r < a.r JOIN numbers ON a.r * (a.r - 1) // 2 + c.r = number),
diffs AS (SELECT p.i, p.j, x.site_idx, x.pos, (x.allele <> y.allele)::INT AS d FROM pairs p JOIN panel x ON x.hap_id = p.i JOIN panel y ON y.hap_id = p.j AND y.site_idx = x.site_idx)"""


def hmm(prefix: str, k: int = 32) -> str:
    """h: forward sums and log-likelihood; bw: backward messages; post: posteriors as lists."""
    each, emission = f"range(1, {k + 1})", "CASE WHEN d = 1 THEN 1 - same[k] ELSE same[k] END"
    return recursive(prefix) + f""",
e AS (SELECT k, 100000.0::DOUBLE * (k / {k}.0) * (k / {k}.0) AS lo, 100000.0::DOUBLE * ((k + 1) / {k}.0) * ((k + 1) / {k}.0) AS hi FROM (SELECT unnest(range({k})) AS k)),
g AS MATERIALIZED (SELECT list((lo + hi) / 2 ORDER BY k) AS t, list((exp(-lo / 20000) - exp(-hi / 20000)) / (1 - exp(-5.0::DOUBLE)) ORDER BY k) AS q,
  list(exp(-1e-5::DOUBLE * (lo + hi) / 2) ORDER BY k) AS stay, list(exp(-2.5e-8::DOUBLE * (lo + hi) / 2) ORDER BY k) AS same, list(exp(-2.5e-8::DOUBLE * (lo + hi) / 2 * 999.0) ORDER BY k) AS gap FROM e),
h AS (SELECT i, j, s, list_transform(raw, lambda x: x / list_sum(raw)) AS a, ln(list_sum(raw)) AS ll FROM (
    SELECT i, j, s, list_transform({each}, lambda k: g.q[k] * CASE WHEN d = 1 THEN 1 - g.same[k] ELSE g.same[k] END) AS raw FROM dd, g WHERE s = 0)
  UNION ALL SELECT i, j, s, list_transform(raw, lambda x: x / list_sum(raw)), ll + ln(list_sum(raw)) FROM (
    SELECT i, j, s, ll, list_transform({each}, lambda k: (stay[k] * a[k] + q[k] * moved) * gap[k] * {emission}) AS raw FROM (
      SELECT h.i, h.j, dd.s, dd.d, h.a, h.ll, g.*, list_sum(list_transform({each}, lambda l: (1 - g.stay[l]) * h.a[l])) AS moved FROM h JOIN dd ON dd.i = h.i AND dd.j = h.j AND dd.s = h.s + 1, g))),
bw AS (SELECT i, j, s, list_transform({each}, lambda k: 1.0::DOUBLE) AS b FROM dd WHERE s = 63
  UNION ALL SELECT i, j, s, list_transform(raw, lambda x: x / list_sum(raw)) FROM (
    SELECT i, j, s, list_transform({each}, lambda k: stay[k] * be[k] + (1 - stay[k]) * sent) AS raw FROM (
      SELECT *, list_sum(list_transform({each}, lambda k: be[k] * q[k])) AS sent FROM (
        SELECT i, j, s, stay, q, list_transform({each}, lambda k: b[k] * gap[k] * {emission}) AS be FROM (
          SELECT bw.i, bw.j, bw.s - 1 AS s, dd.d, bw.b, g.* FROM bw JOIN dd ON dd.i = bw.i AND dd.j = bw.j AND dd.s = bw.s, g WHERE bw.s > 0))))),
post AS (SELECT i, j, s, list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM (
    SELECT h.i, h.j, h.s, list_transform({each}, lambda k: h.a[k] * bw.b[k]) AS raw FROM h JOIN bw ON bw.i = h.i AND bw.j = h.j AND bw.s = h.s)),
told AS (SELECT i, j, s, list_sum(list_transform({each}, lambda k: p[k] * t[k])) AS mean,
    t[least(len(list_filter({each}, lambda k: list_sum(p[1:k]) < 0.025)) + 1, {k})] AS lower, t[least(len(list_filter({each}, lambda k: list_sum(p[1:k]) < 0.975)) + 1, {k})] AS upper FROM post, g)"""


def reestimated(prefix: str, rounds: int = 20, k: int = 32) -> str:
    """q0, q1, ...: the prior (q, done, n) before each round of both passes, blended with the mean posterior until it settles."""
    each, emission = f"range(1, {k + 1})", "CASE WHEN d = 1 THEN 1 - same[k] ELSE same[k] END"
    out = recursive(prefix) + f""",
e AS (SELECT k, 100000.0::DOUBLE * (k / {k}.0) * (k / {k}.0) AS lo, 100000.0::DOUBLE * ((k + 1) / {k}.0) * ((k + 1) / {k}.0) AS hi FROM (SELECT unnest(range({k})) AS k)),
g AS MATERIALIZED (SELECT list(exp(-1e-5::DOUBLE * (lo + hi) / 2) ORDER BY k) AS stay, list(exp(-2.5e-8::DOUBLE * (lo + hi) / 2) ORDER BY k) AS same, list(exp(-2.5e-8::DOUBLE * (lo + hi) / 2 * 999.0) ORDER BY k) AS gap FROM e),
q0 AS MATERIALIZED (SELECT list((exp(-lo / 20000) - exp(-hi / 20000)) / (1 - exp(-5.0::DOUBLE)) ORDER BY k) AS q, false AS done, 1 AS n FROM e)"""
    for r in range(rounds - 1):
        out += f""",
h{r} AS (SELECT i, j, s, list_transform(raw, lambda x: x / list_sum(raw)) AS a FROM (
    SELECT i, j, s, list_transform({each}, lambda k: q[k] * {emission}) AS raw FROM dd, g, q{r} WHERE s = 0 AND NOT done)
  UNION ALL SELECT i, j, s, list_transform(raw, lambda x: x / list_sum(raw)) FROM (
    SELECT i, j, s, list_transform({each}, lambda k: (stay[k] * a[k] + q[k] * moved) * gap[k] * {emission}) AS raw FROM (
      SELECT h.i, h.j, dd.s, dd.d, h.a, g.*, q, list_sum(list_transform({each}, lambda l: (1 - g.stay[l]) * h.a[l])) AS moved FROM h{r} h JOIN dd ON dd.i = h.i AND dd.j = h.j AND dd.s = h.s + 1, g, q{r}))),
w{r} AS (SELECT i, j, s, list_transform({each}, lambda k: 1.0::DOUBLE) AS b FROM dd, q{r} WHERE s = 63 AND NOT done
  UNION ALL SELECT i, j, s, list_transform(raw, lambda x: x / list_sum(raw)) FROM (
    SELECT i, j, s, list_transform({each}, lambda k: stay[k] * be[k] + (1 - stay[k]) * sent) AS raw FROM (
      SELECT *, list_sum(list_transform({each}, lambda k: be[k] * q[k])) AS sent FROM (
        SELECT i, j, s, stay, q, list_transform({each}, lambda k: b[k] * gap[k] * {emission}) AS be FROM (
          SELECT w.i, w.j, w.s - 1 AS s, dd.d, w.b, g.*, q FROM w{r} w JOIN dd ON dd.i = w.i AND dd.j = w.j AND dd.s = w.s, g, q{r} WHERE w.s > 0))))),
m{r} AS MATERIALIZED (SELECT list(v ORDER BY k) AS v FROM (SELECT u.k, avg(p[u.k]) AS v FROM (SELECT list_transform(raw, lambda x: x / list_sum(raw)) AS p FROM (
    SELECT list_transform({each}, lambda k: h.a[k] * w.b[k]) AS raw FROM h{r} h JOIN w{r} w ON w.i = h.i AND w.j = h.j AND w.s = h.s)), (SELECT unnest({each}) AS k) u GROUP BY 1)),
q{r + 1} AS MATERIALIZED (SELECT CASE WHEN done THEN q ELSE new END AS q, done OR list_max(list_transform({each}, lambda k: abs(new[k] - q[k]))) < 1e-6::DOUBLE AS done, CASE WHEN done THEN n ELSE n + 1 END AS n FROM (
    SELECT q, done, n, list_transform(raw, lambda x: x / list_sum(raw)) AS new FROM (
      SELECT *, list_transform({each}, lambda k: exp((1 - 0.7::DOUBLE) * ln(greatest(q[k], 1e-30::DOUBLE)) + 0.7::DOUBLE * ln(greatest(v[k], 1e-30::DOUBLE)))) AS raw FROM q{r}, m{r})))"""
    return out + f" SELECT (u.k - 1)::INT AS k, round(q[u.k], 7) AS q, n::INT AS n_iterations, done AS converged FROM q{rounds - 1}, (SELECT unnest({each}) AS k) u"


#: All pairs of every four haplotypes.
QUADS_SQL = b.PANEL_SQL + """, diffs AS (SELECT x.hap_id AS i, y.hap_id AS j, x.site_idx, x.pos, (x.allele <> y.allele)::INT AS d
  FROM panel x JOIN panel y ON y.hap_id // 4 = x.hap_id // 4 AND y.hap_id < x.hap_id AND y.site_idx = x.site_idx)"""


def trees() -> str:
    """Three unions of clusters per set and site: the best pair of clusters at the best bin not below theirs, then the lowest bin and the first clusters."""
    out = hmm(QUADS_SQL) + """,
lp AS MATERIALIZED (SELECT i // 4 AS set_id, s, i, j, u.k - 1 AS k, greatest(ln(p[u.k]), -1e30::DOUBLE) AS v FROM post, (SELECT unnest(range(1, 33)) AS k) u),
c0 AS (SELECT DISTINCT set_id, s, hap, hap AS label, 0 AS floor FROM (SELECT set_id, s, i AS hap FROM lp UNION ALL SELECT set_id, s, j FROM lp))"""
    for n in range(3):
        out += f""",
m{n} AS MATERIALIZED (SELECT set_id, s, arg_max({{'a': a, 'b': b, 'k': k}}, (v, -k, -a, -b)) AS m FROM (
  SELECT l.set_id, l.s, least(x.label, y.label) AS a, greatest(x.label, y.label) AS b, l.k, sum(l.v) AS v FROM lp l
  JOIN c{n} x ON x.set_id = l.set_id AND x.s = l.s AND x.hap = l.i JOIN c{n} y ON y.set_id = l.set_id AND y.s = l.s AND y.hap = l.j
  WHERE x.label <> y.label AND l.k >= x.floor AND l.k >= y.floor GROUP BY ALL) GROUP BY 1, 2),
c{n + 1} AS MATERIALIZED (SELECT c.set_id, c.s, hap, CASE WHEN label = m.b THEN m.a ELSE label END AS label, CASE WHEN label IN (m.a, m.b) THEN m.k ELSE floor END AS floor, label AS before
  FROM c{n} c JOIN m{n} m ON m.set_id = c.set_id AND m.s = c.s)"""
    told = " UNION ALL ".join(f"SELECT x.set_id, x.s, x.hap AS i, y.hap AS j, m.m.k AS k FROM c{n + 1} x JOIN c{n + 1} y ON y.set_id = x.set_id AND y.s = x.s AND y.hap < x.hap AND x.label = y.label AND x.before <> y.before JOIN m{n} m ON m.set_id = x.set_id AND m.s = x.s" for n in range(3))
    return out + f" SELECT set_id, s AS site_idx, i, j, k::INT AS k FROM ({told})"


def pelt(prefix: str) -> str:
    """Best segmentations by the full recursion, nothing pruned; costs that agree to 1e-9 are ties, which the earliest start wins."""
    return recursive(prefix) + """,
n AS MATERIALIZED (SELECT i, j, list(c ORDER BY s) AS p FROM (SELECT i, j, s, sum(d) OVER (PARTITION BY i, j ORDER BY s)::BIGINT AS c FROM dd) GROUP BY 1, 2),
o AS (SELECT i, j, 0 AS s, [0.0::DOUBLE] AS best, [0] AS origin FROM n
  UNION ALL SELECT i, j, s, list_append(best, costs[pick] + ln(64.0::DOUBLE)), list_append(origin, pick - 1) FROM (
    SELECT *, list_position(list_transform(costs, lambda x: x <= list_min(costs) + 1e-9::DOUBLE), true)::INT AS pick FROM (
      SELECT i, j, s, best, origin, list_transform(range(1, s + 1), lambda k: best[k] + CASE WHEN p[s + 1] > p[k]
        THEN (p[s + 1] - p[k]) - (p[s + 1] - p[k]) * ln((p[s + 1] - p[k]) / (1000.0::DOUBLE * (s + 1 - k))) ELSE 2.5e-8::DOUBLE * 1000.0 * (s + 1 - k) END) AS costs FROM (
        SELECT o.i, o.j, o.s + 1 AS s, o.best, o.origin, n.p FROM o JOIN n ON n.i = o.i AND n.j = o.j WHERE o.s < 63)))),
path AS (SELECT i, j, origin, origin[64] AS a, 63 AS z FROM o WHERE s = 63 UNION ALL SELECT i, j, origin, origin[a + 1], a FROM path WHERE a > 0)
SELECT i, j, (row_number() OVER (PARTITION BY i, j ORDER BY a) - 1)::INT AS seg_no, a AS start_idx, z AS end_idx, p[z + 1] - p[a + 1] AS n_mut,
  round(CASE WHEN p[z + 1] > p[a + 1] THEN (p[z + 1] - p[a + 1]) / (2.5e-8::DOUBLE * 1000.0 * (z - a)) ELSE 0.0 END, 4) AS tmrca FROM path JOIN n USING (i, j)"""


# --- flow fields: a state (m, c) is moved by nested selects, each adding one operation ---------------


def _numbers(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


@functools.cache
def _field() -> str:
    """u and v of the constant-size field, which is an input here, and the largest cv of entropy 1 at most up to the grid's end."""
    uv = flow.flow_grid(range(flow.M_N * flow.C_N), 500)
    limit = flow._entropy_limit()[: round(flow.M_HI / flow.ENTROPY_STEP) + 2]
    return f"ff AS MATERIALIZED (SELECT {_numbers(x[0] for x in uv)} AS u, {_numbers(x[1] for x in uv)} AS v, {_numbers(limit)} AS lim)"


_LN10 = repr(math.log(10))


def _held(src: str, keep: str) -> str:
    """Back on the grid, and under the entropy limit."""
    inside = f"SELECT {keep}, least(greatest(m, -5.0::DOUBLE), 2.0::DOUBLE) AS m, least(greatest(c, -2.0::DOUBLE), 0.0::DOUBLE) AS c FROM ({src})"
    at = f"SELECT *, floor(m / 0.0008::DOUBLE)::INT AS e FROM ({inside})"
    return f"SELECT {keep}, m, CASE WHEN m >= 0 THEN least(greatest(least(c, lim[e + 1] + (lim[e + 2] - lim[e + 1]) * (m / 0.0008::DOUBLE - e)), -2.0::DOUBLE), 0.0::DOUBLE) ELSE c END AS c FROM ({at}), ff"


def _cell(src: str) -> str:
    """cell, wm, wc: a state's cell of the grid and its place there."""
    on = f"SELECT *, least(greatest((m + 5.0::DOUBLE) * (50 / 7.0::DOUBLE), 0.0), 50.0) AS fm, least(greatest((c + 2.0::DOUBLE) * (49 / 2.0::DOUBLE), 0.0), 49.0) AS fc FROM ({src})"
    return f"SELECT *, gm * 50 + gc + 1 AS cell, fm - gm AS wm, fc - gc AS wc FROM (SELECT *, least(floor(fm), 49)::INT AS gm, least(floor(fc), 48)::INT AS gc FROM ({on}))"


def _between(table: str, shift: str = "0") -> str:
    near, far = (f"({table}[cell + {k} + {shift}] + ({table}[cell + {k + 1} + {shift}] - {table}[cell + {k} + {shift}]) * wc)" for k in (0, 50))
    return f"({near} + ({far} - {near}) * wm)"


def _looked(src: str, keep: str, tables: str, m: str, c: str, shift: str = "0") -> str:
    return f"SELECT {keep}, {_between(m, shift)} AS m, {_between(c, shift)} AS c FROM ({_cell(src)}), {tables}"


def _moved(src: str, keep: str, rho: str) -> str:
    """One recombination of rate ``rho``, without limits."""
    return f"SELECT {keep}, m + {_between('u')} * {rho} AS m, c + {_between('v')} * {rho} AS c FROM ({_cell(src)}), ff"


def _emitted(src: str, keep: str, mu: str, het: str) -> str:
    a, rate = f"log10(exp(-2 * {_LN10} * c) + {het})", f"log10(exp(-{_LN10} * (2 * c + m)) + {mu})"
    return f"SELECT {keep}, {a} - {rate} AS m, -0.5 * {a} AS c FROM ({src})"


_RATES = f"rates AS (SELECT {4 * NE * MU!r}::DOUBLE AS mu, {4 * NE * RHO!r}::DOUBLE AS rho)"


def _tables(rates: str) -> str:
    """st: stretches of 1,000 units; f1, f1000, b1000: a segment and its site, the table for a difference behind that for none."""
    keep = "n, k, mu, rho"
    step = _held(_moved(_held(_emitted("SELECT unit.n + 1 AS n, k, mu, rho, m, c FROM unit WHERE unit.n < 1000", keep, "mu", "0"), keep), keep, "rho"), keep)
    first = _held(_moved(_held("SELECT 1 AS n, k, mu, rho, m, c FROM points", keep), keep, "rho"), keep)
    site = _held(_emitted("SELECT n, k, mu, rho, h, m, c FROM unit, (SELECT unnest([0, 1]) AS h) WHERE n IN (1, 1000)", "n, k, h", "mu", "h"), "n, k, h")
    back = _looked(_held(_emitted("SELECT k, mu, rho, h, m, c FROM points, (SELECT unnest([0, 1]) AS h)", "k, h", "mu", "h"), "k, h"), "k, h", "st", "st.m", "st.c")
    lists = "list(m ORDER BY h, k) AS m, list(c ORDER BY h, k) AS c"
    return f"""{_field()}, {rates},
points AS (SELECT k, mu, rho, -5.0::DOUBLE + (7.0::DOUBLE / 50) * (k // 50) AS m, -2.0::DOUBLE + (2.0::DOUBLE / 49) * (k % 50) AS c FROM (SELECT unnest(range(2550)) AS k), rates),
unit AS ({first} UNION ALL {step}),
st AS MATERIALIZED (SELECT list(m ORDER BY k) AS m, list(c ORDER BY k) AS c FROM unit WHERE n = 1000),
sites AS MATERIALIZED ({site}), f1 AS MATERIALIZED (SELECT {lists} FROM sites WHERE n = 1), f1000 AS MATERIALIZED (SELECT {lists} FROM sites WHERE n = 1000),
b1000 AS MATERIALIZED (SELECT {lists} FROM ({back}))"""


_POSTERIOR = """alpha / greatest(beta, 1e-10) * 20000.0 AS mean, 1 / (9 * greatest(alpha, 1)) AS w, alpha, beta FROM (
  SELECT {key}, exp(-2 * {ln10} * f.c) + exp(-2 * {ln10} * r.c) - 1 AS alpha, exp(-{ln10} * (2 * f.c + f.m)) + exp(-{ln10} * (2 * r.c + r.m)) - 1 AS beta FROM f JOIN r ON f.i = r.i AND f.j = r.j AND f.s = r.s{more})"""


def _passes(looks: tuple[str, str, str], backward: bool) -> str:
    """f, r: states after each site from the left, and before it from the right; z: means and what limits need."""
    begin, ahead, behind = looks
    out = f""", f AS ({begin} UNION ALL {ahead})"""
    if backward:
        out += f""", r AS (SELECT i, j, 63 AS s, 0.0::DOUBLE AS m, 0.0::DOUBLE AS c FROM dd WHERE s = 63 UNION ALL {behind}),
z AS (SELECT i, j, s, {_POSTERIOR.format(key="f.i, f.j, f.s", ln10=_LN10, more="")})"""
    return out


def cached(prefix: str, backward: bool = True, rates: str = _RATES) -> str:
    keep = "i, j, s"
    begin = _looked(_looked("SELECT i, j, s, d, 0.0::DOUBLE AS m, 0.0::DOUBLE AS c FROM dd WHERE s = 0", "i, j, s, d", "st", "st.m", "st.c"), keep, "f1", "f1.m", "f1.c", "2550 * d")
    ahead = _looked("SELECT f.i, f.j, dd.s, dd.d, f.m, f.c FROM f JOIN dd ON dd.i = f.i AND dd.j = f.j AND dd.s = f.s + 1", keep, "f1000", "f1000.m", "f1000.c", "2550 * d")
    behind = _looked("SELECT r.i, r.j, r.s - 1 AS s, dd.d, r.m, r.c FROM r JOIN dd ON dd.i = r.i AND dd.j = r.j AND dd.s = r.s WHERE r.s > 0", keep, "b1000", "b1000.m", "b1000.c", "2550 * d")
    return recursive(prefix) + ", " + _tables(rates) + _passes((begin, ahead, behind), backward)


def iterative(prefix: str) -> str:
    """The same passes by steps: a unit's recombination, then the rest of the segment in as many steps as its rate needs."""
    rho, mu = 4 * NE * RHO, 4 * NE * MU
    keep = "i, j, s, d"

    def on_grid(src: str) -> str:
        return f"SELECT {keep}, least(greatest(m, -5.0::DOUBLE), 2.0::DOUBLE) AS m, least(greatest(c, -2.0::DOUBLE), 0.0::DOUBLE) AS c FROM ({src})"

    def stretch(src: str, n: int) -> str:
        src, units = on_grid(_moved(src, keep, repr(rho))), n - 1
        steps = max(1, math.ceil(units * rho / 0.1))
        for _ in range(steps):
            src = on_grid(_moved(_emitted(src, keep, repr(units * mu / steps), "0"), keep, repr(units * rho / steps)))
        return src

    begin = _emitted(stretch("SELECT i, j, s, d, 0.0::DOUBLE AS m, 0.0::DOUBLE AS c FROM dd WHERE s = 0", 1001), "i, j, s", repr(mu), "d")
    ahead = _emitted(stretch("SELECT f.i, f.j, dd.s, dd.d, f.m, f.c FROM f JOIN dd ON dd.i = f.i AND dd.j = f.j AND dd.s = f.s + 1", 1000), "i, j, s", repr(mu), "d")
    behind = stretch(_emitted("SELECT r.i, r.j, r.s - 1 AS s, dd.d, r.m, r.c FROM r JOIN dd ON dd.i = r.i AND dd.j = r.j AND dd.s = r.s WHERE r.s > 0", keep, repr(mu), "d"), 1000)
    behind = f"SELECT i, j, s, m, c FROM ({behind})"
    return recursive(prefix) + f", {_field()}" + _passes((begin, ahead, behind), True)


def blockwise(prefix: str, core: int, flank: int, rates: str = _RATES) -> str:
    """Blocks with flanks, each from a fresh state; z has the sites of the cores."""
    blocks = ", ".join(f"({n}, {a}, {z}, {lo}, {hi})" for n, a, z, lo, hi in flow.block_windows(b.N_SITES, core, flank))
    keep = "i, j, n, s"
    fresh = "SELECT i, j, blocks.n, s, d, lo, 0.0::DOUBLE AS m, 0.0::DOUBLE AS c FROM dd JOIN blocks ON s = lo"
    long = _looked(f"SELECT * FROM ({fresh}) WHERE lo = 0", "i, j, n, s, d", "st", "st.m", "st.c")
    begin = _looked(f"{long} UNION ALL SELECT i, j, n, s, d, m, c FROM ({fresh}) WHERE lo > 0", keep, "f1", "f1.m", "f1.c", "2550 * d")
    ahead = _looked("SELECT f.i, f.j, f.n, dd.s, dd.d, f.m, f.c FROM f JOIN blocks ON blocks.n = f.n JOIN dd ON dd.i = f.i AND dd.j = f.j AND dd.s = f.s + 1 WHERE f.s + 1 < hi", keep, "f1000", "f1000.m", "f1000.c", "2550 * d")
    behind = _looked("SELECT r.i, r.j, r.n, r.s - 1 AS s, dd.d, r.m, r.c FROM r JOIN blocks ON blocks.n = r.n JOIN dd ON dd.i = r.i AND dd.j = r.j AND dd.s = r.s WHERE r.s > lo", keep, "b1000", "b1000.m", "b1000.c", "2550 * d")
    return recursive(prefix) + f""", blocks(n, a, z, lo, hi) AS (VALUES {blocks}), {_tables(rates)}, f AS ({begin} UNION ALL {ahead}),
r AS (SELECT i, j, blocks.n, s, 0.0::DOUBLE AS m, 0.0::DOUBLE AS c FROM dd JOIN blocks ON s = hi - 1 UNION ALL {behind}),
z AS (SELECT y.* FROM (SELECT i, j, n, s, {_POSTERIOR.format(key="f.i, f.j, f.n, f.s", ln10=_LN10, more=" AND f.n = r.n")}) y JOIN blocks USING (n) WHERE y.s >= a AND y.s < blocks.z)"""
