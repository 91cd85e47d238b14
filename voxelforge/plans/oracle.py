"""DuckDB SQL that says the same as the queries, written from the definitions and not from the plans."""

from __future__ import annotations

GRID = "g AS (SELECT CAST((max(o_orderkey) // 600) + 1 AS INTEGER) AS nx, 25 AS ny, 24 AS nz FROM orders)"
VOX = "vox AS (SELECT o_orderkey AS voxel_idx, CAST(o_orderkey // 600 AS INTEGER) AS i, CAST((o_orderkey // 24) % 25 AS INTEGER) AS j, CAST(o_orderkey % 24 AS INTEGER) AS k, o_totalprice, o_orderstatus, o_custkey FROM orders)"
LINES = """ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS peak_no FROM lineitem)"""
FIX = f"""{GRID}, {VOX}, {LINES},
lf AS (SELECT l_orderkey * 64 + peak_no AS fixel_id, l_orderkey AS voxel_idx, peak_no, l_extendedprice / 1e5 AS amplitude, 2e0 * ((l_partkey % 201) / 2e2) - 1e0 AS zz, 6.283185307179586e0 * (l_suppkey % 100) / 1e2 AS ph FROM ln),
fx AS (SELECT fixel_id, voxel_idx, peak_no, amplitude, 1.7e0 * (voxel_idx // 600) - 1.7e0 * nx / 2 AS px, 1.7e0 * ((voxel_idx // 24) % 25) AS py, 1.7e0 * (voxel_idx % 24) AS pz,
       sqrt(greatest(1e0 - zz * zz, 0e0)) * cos(ph) AS dx, sqrt(greatest(1e0 - zz * zz, 0e0)) * sin(ph) AS dy, zz AS dz FROM lf, g)"""
SYN = """s0 AS (SELECT vec_id AS fixel_id, 20e0 * embedding[1]::DOUBLE AS x, 20e0 * embedding[2]::DOUBLE AS y, 20e0 * embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS a, embedding[5]::DOUBLE AS b, embedding[6]::DOUBLE AS c, abs(embedding[7]::DOUBLE) AS amp, label AS bundle FROM embeddings)"""


def jitter(source: str, name: str) -> str:
    """CTEs with the three 32-bit hashes of fixel_id and the jitter."""
    out, prev = [], source
    seeds = (0x1F1F1F1F, 0x2A2A2A2A, 0x3B3B3B3B)
    steps = [
        ("x", lambda n: f"((fixel_id::HUGEINT * {seeds[n]} + 2654435769) % 4294967296)::BIGINT"),
        ("y", lambda n: f"xor(x{n}, x{n} >> 16)"),
        ("z", lambda n: f"((y{n}::HUGEINT * 2246822507) % 4294967296)::BIGINT"),
        ("h", lambda n: f"xor(z{n}, z{n} >> 13)"),
    ]
    for s, (col, f) in enumerate(steps):
        out.append(f"{name}_{s} AS (SELECT *, {', '.join(f'{f(n)} AS {col}{n}' for n in range(3))} FROM {prev})")
        prev = f"{name}_{s}"
    cols = ", ".join(f"(h{n} / 4294967296e0 * 2 - 1) * 5e-3 AS j{c}" for n, c in enumerate("xyz"))
    out.append(f"{name} AS (SELECT *, {cols} FROM {prev})")
    return ", ".join(out)


SYNX = f"""{SYN}, {jitter('s0', 'sj')},
med AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY amp DESC) AS m FROM s0),
sx AS (SELECT fixel_id, bundle, x + jx AS px, y + jy AS py, z + jz AS pz, a / sqrt(a*a+b*b+c*c) AS dx, b / sqrt(a*a+b*b+c*c) AS dy, c / sqrt(a*a+b*b+c*c) AS dz, amp / m AS amplitude FROM sj, med)"""


def built(keep: str, extra: str = "") -> str:
    """The index over fixels for which ``keep`` holds."""
    return f"""{FIX}{extra}, kept AS (SELECT * FROM fx WHERE {keep}), {jitter('kept', 'kj')},
kmed AS (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY amplitude DESC) AS m FROM kept),
idx AS (SELECT fixel_id, voxel_idx, px + 1e-2 * dx + jx AS px, py + 1e-2 * dy + jy AS py, pz + 1e-2 * dz + jz AS pz, dx, dy, dz, amplitude / m AS amplitude FROM kj, kmed)"""


def r(cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0e0 AS {c.split('.')[-1]}" for c in cols.split())


SHOW = f"SELECT fixel_id, voxel_idx, {r('px py pz dx dy dz')}, round(amplitude, 6) + 0e0 AS amp_norm FROM idx"


def otsu(source: str, col: str, name: str) -> str:
    """CTE ``name`` (bin, threshold) with one row."""
    return f"""{name}p AS (SELECT {col} AS v FROM {source} WHERE {col} > 0),
{name}m AS (SELECT max(v) / 256e0 AS bw FROM {name}p),
{name}h AS (SELECT least(CAST(floor(v / bw) AS BIGINT), 255) AS b, bw, CAST(count(*) AS BIGINT) AS c FROM {name}p, {name}m GROUP BY ALL),
{name}w AS (SELECT b, bw, sum(c) OVER (ORDER BY b) AS wb, sum(c) OVER () AS n, sum(c * (b + 5e-1) * bw) OVER (ORDER BY b) AS sb, sum(c * (b + 5e-1) * bw) OVER () AS st FROM {name}h),
{name}v AS (SELECT b, (b + 1) * bw AS t, wb::DOUBLE * (n - wb)::DOUBLE * pow(sb / wb - (st - sb) / (n - wb), 2) AS var FROM {name}w WHERE wb < n),
{name} AS (SELECT coalesce(max(b), -1) AS bin, coalesce(max(t), 0e0) AS threshold FROM (SELECT * FROM {name}v WHERE var > 0 ORDER BY var DESC, b LIMIT 1))"""


QA = "qa AS (SELECT vox.voxel_idx, i, j, k, greatest(0e0, coalesce(max(amplitude), 0e0)) AS value FROM vox LEFT JOIN fx ON vox.voxel_idx = fx.voxel_idx GROUP BY ALL)"
FIRST = "fp AS (SELECT voxel_idx, min_by(amplitude, peak_no) AS first_amp FROM fx GROUP BY voxel_idx)"
PRICE = f"{GRID}, {VOX}, f0 AS (SELECT (i::BIGINT * ny + j) * nz + k AS flat, i, j, k, o_totalprice / 1e5 AS value FROM vox, g WHERE o_totalprice <> 0)"
MASK = f"{PRICE}, mask AS (SELECT flat, i, j, k FROM f0 WHERE value > 1.5e0)"
SPARSE = f"{PRICE}, mask AS (SELECT flat, i, j, k FROM f0 WHERE value > 3e0)"
CUBE = "o AS (SELECT a, b, c FROM (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b), (SELECT unnest([-1, 0, 1]) AS c))"
SEVEN = "o AS (SELECT * FROM (VALUES (0,0,0), (-1,0,0), (1,0,0), (0,-1,0), (0,1,0), (0,0,-1), (0,0,1)) t(a, b, c))"


def spread(source: str, name: str, carry: str = "") -> str:
    """Cells of ``source`` moved by every offset, inside the grid."""
    return f"{name} AS (SELECT ((i + a)::BIGINT * ny + j + b) * nz + k + c AS flat, i + a AS i, j + b AS j, k + c AS k {carry} FROM {source}, o, g WHERE i + a BETWEEN 0 AND nx - 1 AND j + b BETWEEN 0 AND ny - 1 AND k + c BETWEEN 0 AND nz - 1)"


def smooth(source: str, name: str) -> str:
    return f"{spread(source, name + 's', ', value')}, {name} AS (SELECT flat, i, j, k, sum(value) / 27 AS value FROM {name}s GROUP BY ALL)"


def components(edges: str, nodes: str) -> str:
    """CTE ``cc`` (node, label): numbered by least node, from edges (u, v) in both directions and nodes (node)."""
    return f"""walk(node, root) USING KEY (node) AS (
  SELECT node, node AS root FROM {nodes}
  UNION
  SELECT w.node, min(p.root) AS root FROM walk p JOIN {edges} e ON p.node = e.u JOIN recurring.walk w ON w.node = e.v WHERE p.root < w.root GROUP BY w.node),
cc AS (SELECT node, dense_rank() OVER (ORDER BY root) AS label FROM walk)"""


SIX_EDGES = "ed AS MATERIALIZED (SELECT m.flat AS u, n.flat AS v FROM mask m, o JOIN mask n ON n.i = m.i + a AND n.j = m.j + b AND n.k = m.k + c WHERE abs(a) + abs(b) + abs(c) = 1)"
VOXEL_CC = f"WITH RECURSIVE {SPARSE}, {SEVEN}, {SIX_EDGES}, nodes AS (SELECT flat AS node FROM mask), {components('ed', 'nodes')}"
SIX_IN_ORDER = "six AS (SELECT * FROM (VALUES (0,-1,0,0), (1,1,0,0), (2,0,-1,0), (3,0,1,0), (4,0,0,-1), (5,0,0,1)) t(n, a, b, c)), es AS MATERIALIZED (SELECT m.flat AS u, x.n, v.flat AS v FROM mask m, six x JOIN mask v ON v.i = m.i + x.a AND v.j = m.j + x.b AND v.k = m.k + x.c)"
SPREAD = f"""WITH RECURSIVE {MASK}, {SIX_IN_ORDER}, walk(node, level, label, place) USING KEY (node) AS (
  SELECT flat AS node, CAST(0 AS BIGINT) AS level, CAST(CASE WHEN flat = (SELECT min(flat) FROM mask) THEN 1 ELSE 2 END AS BIGINT) AS label, CAST(flat AS BIGINT) AS place FROM mask WHERE flat = (SELECT min(flat) FROM mask) OR flat = (SELECT max(flat) FROM mask)
  UNION
  SELECT node, level, label, row_number() OVER (ORDER BY place, n) AS place FROM (
    SELECT e.v AS node, min(p.level) + 1 AS level, arg_min(p.label, p.place * 6 + e.n) AS label, min(p.place * 6 + e.n) // 6 AS place, min(p.place * 6 + e.n) % 6 AS n
    FROM walk p JOIN es e ON p.node = e.u LEFT JOIN recurring.walk w ON w.node = e.v WHERE w.node IS NULL GROUP BY e.v))
SELECT node AS flat, CAST(label AS BIGINT) AS label, CAST(level AS BIGINT) AS level FROM walk"""
MESH = """vert AS (SELECT o_orderkey AS vid, (o_orderkey // 24) - 100.25e0 AS x, (o_orderkey % 24)::DOUBLE AS y, o_totalprice / 1e5 AS z FROM orders),
cell AS (SELECT o_orderkey AS v FROM orders WHERE o_orderkey % 24 < 23 AND (o_orderkey // 24) % 40 <> 39 AND o_orderkey + 25 <= (SELECT max(o_orderkey) FROM orders)),
tri AS (SELECT 2 * v AS tid, v AS a, v + 24 AS b, v + 1 AS c FROM cell UNION ALL SELECT 2 * v + 1, v + 1, v + 24, v + 25 FROM cell)"""
RING = "ring AS (SELECT DISTINCT u, v FROM (SELECT a AS u, b AS v FROM tri UNION ALL SELECT b, a FROM tri UNION ALL SELECT b, c FROM tri UNION ALL SELECT c, b FROM tri UNION ALL SELECT c, a FROM tri UNION ALL SELECT a, c FROM tri))"
CORNERS = "cn AS (SELECT tid, a, b, c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, s.x AS cx, s.y AS cy, s.z AS cz FROM tri JOIN vert p ON a = p.vid JOIN vert q ON b = q.vid JOIN vert s ON c = s.vid)"
NORMALS = f"""{MESH}, {CORNERS},
fc AS (SELECT *, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS fx, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS fy, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS fz FROM cn),
fv AS (SELECT unnest([a, b, c]) AS vid, fx, fy, fz FROM fc),
sm AS (SELECT vert.vid, x, y, z, coalesce(sum(fx), 0e0) AS sx, coalesce(sum(fy), 0e0) AS sy, coalesce(sum(fz), 0e0) AS sz FROM vert LEFT JOIN fv ON vert.vid = fv.vid GROUP BY ALL),
nl AS (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n FROM sm),
nrm AS (SELECT vid, x, y, z, CASE WHEN n > 1e-9 THEN sx / n ELSE sx END AS nx, CASE WHEN n > 1e-9 THEN sy / n ELSE sy END AS ny, CASE WHEN n > 1e-9 THEN sz / n ELSE sz END AS nz FROM nl)"""


def laplace(source: str, name: str, factor: str) -> str:
    return f"""{name}m AS (SELECT u, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM ring JOIN {source} ON v = vid GROUP BY u),
{name} AS (SELECT vid, x + {factor} * coalesce(mx - x, 0e0) AS x, y + {factor} * coalesce(my - y, 0e0) AS y, z + {factor} * coalesce(mz - z, 0e0) AS z FROM {source} LEFT JOIN {name}m ON vid = u)"""


FRAMES = """fr0 AS (SELECT fixel_id, px AS qx, py AS qy, pz AS qz, dx AS ux, dy AS uy, dz AS uz, CASE WHEN abs(dx) < 9e-1 THEN 0e0 ELSE dz END AS rx, CASE WHEN abs(dx) < 9e-1 THEN -dz ELSE 0e0 END AS ry, CASE WHEN abs(dx) < 9e-1 THEN dy ELSE -dx END AS rz FROM sx),
fr1 AS (SELECT fixel_id, qx, qy, qz, ux, uy, uz, rx / sqrt(rx*rx+ry*ry+rz*rz) AS vx, ry / sqrt(rx*rx+ry*ry+rz*rz) AS vy, rz / sqrt(rx*rx+ry*ry+rz*rz) AS vz FROM fr0),
fr AS (SELECT *, uy * vz - uz * vy AS wx, uz * vx - ux * vz AS wy, ux * vy - uy * vx AS wz FROM fr1)"""


def prop(t: str) -> str:
    """Coefficients a0..a8 from k1, k2."""
    both = "abs(k1) < 1e-4 AND abs(k2) < 1e-4"
    parts = ["sin(kk * t) / kk", "e1 * (1 - cos(kk * t)) / (kk * kk)", "e2 * (1 - cos(kk * t)) / (kk * kk)", "cos(kk * t)", "e1 * sin(kk * t) / kk", "e2 * sin(kk * t) / kk", "-e2 * sin(kk * t) / kk", "e1 * e2 * (cos(kk * t) - 1) / (kk * kk)", "(e1 * e1 + e2 * e2 * cos(kk * t)) / (kk * kk)"]
    flat = ["t", "0e0", "0e0", "1e0", "0e0", "0e0", "0e0", "0e0", "1e0"]
    cols = ", ".join(f"CASE WHEN {both} THEN {f} ELSE {p} END AS a{n}" for n, (p, f) in enumerate(zip(parts, flat, strict=True)))
    return f"""pe AS (SELECT *, {t} AS t, CASE WHEN abs(k1) < 1e-4 THEN 1e-4 ELSE k1 END AS e1, CASE WHEN abs(k2) < 1e-4 THEN 1e-4 ELSE k2 END AS e2 FROM kg),
pk AS (SELECT *, sqrt(e1 * e1 + e2 * e2) AS kk FROM pe), pr AS (SELECT *, {cols} FROM pk)"""


KGRID = "kg AS (SELECT -0.2::DOUBLE + 1e-1 * p AS k1, -0.2::DOUBLE + 1e-1 * q AS k2 FROM (SELECT unnest(range(5)) AS p), (SELECT unnest(range(5)) AS q))"


def walked(source: str, name: str) -> str:
    """One step of every frame of ``source`` along its propagator."""
    lin = lambda n, c: f"a{n} * u{c} + a{n + 1} * v{c} + a{n + 2} * w{c}"
    keep = "fixel_id, k1, k2, " + ", ".join(f"a{n}" for n in range(9))
    unit = lambda p, c: f"{p}{c} / sqrt({p}x*{p}x+{p}y*{p}y+{p}z*{p}z)"
    return f"""{name}1 AS (SELECT {keep}, {', '.join(f'q{c} + {lin(0, c)} AS q{c}, {lin(3, c)} AS t{c}, {lin(6, c)} AS r{c}' for c in 'xyz')} FROM {source}),
{name}2 AS (SELECT {keep}, qx, qy, qz, rx, ry, rz, {', '.join(f"{unit('t', c)} AS u{c}" for c in 'xyz')} FROM {name}1),
{name}3 AS (SELECT {keep}, qx, qy, qz, ux, uy, uz, ry * uz - rz * uy AS sx, rz * ux - rx * uz AS sy, rx * uy - ry * ux AS sz FROM {name}2),
{name}4 AS (SELECT {keep}, qx, qy, qz, ux, uy, uz, {', '.join(f"{unit('s', c)} AS v{c}" for c in 'xyz')} FROM {name}3),
{name} AS (SELECT *, uy * vz - uz * vy AS wx, uz * vx - ux * vz AS wy, ux * vy - uy * vx AS wz FROM {name}4)"""


def arcs(kgrid: str, fan: str | None = None) -> str:
    """Best likelihood of each fixel over a curvature grid, five samples 1.25 apart."""
    cols = "fixel_id, k1, k2, qx, qy, qz, ux, uy, uz, vx, vy, vz, wx, wy, wz"
    steps = ", ".join(walked("w0" if n == 1 else f"w{n - 1}", f"w{n}") for n in range(1, 5))
    samples = " UNION ALL ".join(f"SELECT {n} AS s, {cols} FROM w{n}" for n in range(5))
    ring = fan or "sf AS (SELECT s, fixel_id, k1, k2, qx AS x, qy AS y, qz AS z, ux, uy, uz, 1 AS n FROM sa)"
    return f"""WITH {SYNX}, {FRAMES}, {kgrid}, {prop('1.25::DOUBLE')}, w0 AS (SELECT * FROM fr, pr), {steps}, sa AS ({samples}), {ring},
sup AS (SELECT sf.fixel_id, k1, k2, sum(pow(abs(ux * dx + uy * dy + uz * dz), 4) * amplitude) / max(n) AS lik FROM sf JOIN sx f ON (x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz) <= 2.4::DOUBLE * 2.4::DOUBLE GROUP BY ALL)
SELECT sx.fixel_id, round(greatest(0e0, coalesce(max(lik), 0e0)), 6) + 0e0 AS likelihood FROM sx LEFT JOIN sup ON sx.fixel_id = sup.fixel_id GROUP BY sx.fixel_id"""


ONE_K = "kg AS (SELECT 0e0 AS k1, 0e0 AS k2)"
FAN = "sf AS (SELECT s, fixel_id, k1, k2, qx + cos(th) * vx + sin(th) * wx AS x, qy + cos(th) * vy + sin(th) * wy AS y, qz + cos(th) * vz + sin(th) * wz AS z, ux, uy, uz, 6 AS n FROM sa, (SELECT 6.283185307179586e0 * j / 6 AS th FROM (SELECT unnest(range(6)) AS j)))"
CELL = "floor({0}x / {1}) AS c1, floor({0}y / {1}) AS c2, floor({0}z / {1}) AS c3"


def near(left: str, right: str, radius: str, cols: str) -> str:
    """Pairs within a radius by cells: left (qx..), right (px..)."""
    return f"""{CUBE}, lc AS (SELECT *, {CELL.format('q', radius)} FROM {left}), rc AS (SELECT *, {CELL.format('p', radius)} FROM {right}),
lx AS (SELECT lc.* EXCLUDE (c1, c2, c3), c1 + a AS c1, c2 + b AS c2, c3 + c AS c3 FROM lc, o),
nr AS (SELECT {cols} FROM lx l JOIN rc r ON l.c1 = r.c1 AND l.c2 = r.c2 AND l.c3 = r.c3 WHERE (qx - px) * (qx - px) + (qy - py) * (qy - py) + (qz - pz) * (qz - pz) <= {radius} * {radius})"""


def trace(steps: int) -> str:
    """Five steps of 1.7 from every fixel in both directions, within bundles 0 to 4, reach 4.25, 45 degrees."""
    ctes = ["t0 AS (SELECT fixel_id AS sid, s AS sign, px AS qx, py AS qy, pz AS qz, s * dx AS ux, s * dy AS uy, s * dz AS uz FROM mem, (SELECT unnest([1, -1]) AS s))"]
    for n in range(1, steps + 1):
        p = f"t{n - 1}"
        ctes.append(f"n{n} AS (SELECT sid, sign, qx + 1.7e0 * ux AS qx, qy + 1.7e0 * uy AS qy, qz + 1.7e0 * uz AS qz, ux, uy, uz FROM {p})")
        ctes.append(f"m{n} AS (SELECT sid, sign, qx, qy, qz, ux * dx + uy * dy + uz * dz AS co, fixel_id, dx, dy, dz FROM n{n} JOIN mem ON (qx-px)*(qx-px)+(qy-py)*(qy-py)+(qz-pz)*(qz-pz) <= 4.25e0 * 4.25e0 WHERE abs(ux * dx + uy * dy + uz * dz) > cos(radians(45)))")
        ctes.append(f"t{n} AS (SELECT sid, sign, qx, qy, qz, CASE WHEN co >= 0 THEN dx ELSE -dx END AS ux, CASE WHEN co >= 0 THEN dy ELSE -dy END AS uy, CASE WHEN co >= 0 THEN dz ELSE -dz END AS uz FROM m{n} QUALIFY row_number() OVER (PARTITION BY sid, sign ORDER BY abs(co) DESC, fixel_id) = 1)")
    points = " UNION ALL ".join(["SELECT fixel_id AS sid, 0 AS idx, px AS x, py AS y, pz AS z FROM mem"] + [f"SELECT sid, sign * {n}, qx, qy, qz FROM t{n}" for n in range(1, steps + 1)])
    return f"""WITH {SYNX}, mem AS (SELECT * FROM sx WHERE bundle < 5), {', '.join(ctes)}, pts AS ({points}),
sg AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM pts WINDOW w AS (PARTITION BY sid ORDER BY idx)),
ok AS (SELECT sid FROM sg GROUP BY sid HAVING coalesce(sum(d), 0) >= 5)
SELECT sid, CAST(idx AS BIGINT) AS idx, {r('x y z')} FROM pts WHERE sid IN (SELECT sid FROM ok)"""


TRACE_ALL = f"""WITH RECURSIVE {SYNX}, mem AS MATERIALIZED (SELECT fixel_id, px, py, pz, dx, dy, dz FROM sx),
st AS (
  SELECT fixel_id AS sid, s AS sign, 0 AS n, px AS qx, py AS qy, pz AS qz, s * dx AS ux, s * dy AS uy, s * dz AS uz FROM mem, (SELECT unnest([1, -1]) AS s)
  UNION ALL
  SELECT sid, sign, n + 1, qx, qy, qz, CASE WHEN co >= 0 THEN dx ELSE -dx END, CASE WHEN co >= 0 THEN dy ELSE -dy END, CASE WHEN co >= 0 THEN dz ELSE -dz END
  FROM (SELECT sid, sign, n, a.qx, a.qy, a.qz, ux * dx + uy * dy + uz * dz AS co, fixel_id, dx, dy, dz
        FROM (SELECT sid, sign, n, qx + 1.7e0 * ux AS qx, qy + 1.7e0 * uy AS qy, qz + 1.7e0 * uz AS qz, ux, uy, uz FROM st WHERE n < 148) a
        JOIN mem ON (a.qx-px)*(a.qx-px)+(a.qy-py)*(a.qy-py)+(a.qz-pz)*(a.qz-pz) <= 4.25e0 * 4.25e0 WHERE abs(ux * dx + uy * dy + uz * dz) > cos(radians(30)))
  QUALIFY row_number() OVER (PARTITION BY sid, sign ORDER BY abs(co) DESC, fixel_id) = 1),
pts AS MATERIALIZED (SELECT sid, sign * n AS idx, qx AS x, qy AS y, qz AS z FROM st WHERE n > 0 OR sign = 1),
sg AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM pts WINDOW w AS (PARTITION BY sid ORDER BY idx)),
ok AS (SELECT sid FROM sg GROUP BY sid HAVING coalesce(sum(d), 0) >= 5)
SELECT sid, CAST(idx AS BIGINT) AS idx, {r('x y z')} FROM pts WHERE sid IN (SELECT sid FROM ok)"""
SUPPORT = f"""WITH {built('true')}, smp AS (SELECT fixel_id AS fid, px AS qx, py AS qy, pz AS qz, dx AS ux, dy AS uy, dz AS uz FROM idx),
{near('smp', 'idx', '2.5e0', 'fid, pow(abs(ux * dx + uy * dy + uz * dz), 4) * amplitude AS w')}
SELECT fid AS fixel_id, round(sum(w), 6) + 0e0 AS support FROM nr GROUP BY fid"""
VISITED = f"""WITH {built('true')}, path AS (SELECT s * 0.11e0 AS qx, s * 0.2e0 AS qy, s * 0.19e0 AS qz FROM (SELECT unnest(range(200)) AS s)),
{near('path', 'idx', '2e0', 'fixel_id, abs(dx + dy + dz) / sqrt(3e0) AS co')}
SELECT DISTINCT fixel_id FROM nr WHERE co >= 0.7::DOUBLE"""
NN = f"WITH {SYNX}, pr AS (SELECT p.fixel_id AS a, q.fixel_id AS b, (p.px-q.px)*(p.px-q.px)+(p.py-q.py)*(p.py-q.py)+(p.pz-q.pz)*(p.pz-q.pz) AS d2 FROM sx p, sx q)"
KNN = f"{NN}, kn AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS n FROM pr), kk AS (SELECT * FROM kn WHERE n <= 16)"
TRILINEAR = f"""WITH {PRICE}, {SYN}, pt AS (SELECT fixel_id, x + 8 AS vx, y + 8 AS vy, z + 8 AS vz FROM s0),
cr AS (SELECT fixel_id, floor(vx)::BIGINT + a AS i, floor(vy)::BIGINT + b AS j, floor(vz)::BIGINT + c AS k,
  (CASE a WHEN 1 THEN vx - floor(vx) ELSE 1 - (vx - floor(vx)) END) * (CASE b WHEN 1 THEN vy - floor(vy) ELSE 1 - (vy - floor(vy)) END) * (CASE c WHEN 1 THEN vz - floor(vz) ELSE 1 - (vz - floor(vz)) END) AS w
  FROM pt, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b), (SELECT unnest([0, 1]) AS c)),
inn AS (SELECT cr.*, coalesce(f0.value, 0e0) AS value FROM cr JOIN g ON cr.i BETWEEN 0 AND nx - 1 AND cr.j BETWEEN 0 AND ny - 1 AND cr.k BETWEEN 0 AND nz - 1 LEFT JOIN f0 ON f0.i = cr.i AND f0.j = cr.j AND f0.k = cr.k),
sm AS (SELECT fixel_id, sum(w) AS w, sum(w * value) AS s FROM inn GROUP BY fixel_id)
SELECT pt.fixel_id, round(CASE WHEN w > 1e-9 THEN s / w ELSE 0e0 END, 6) + 0e0 AS q FROM pt LEFT JOIN sm ON pt.fixel_id = sm.fixel_id"""
MESH_CC = f"WITH RECURSIVE {MESH}, {RING}, used AS (SELECT DISTINCT u AS node FROM ring), {components('ring', 'used')} SELECT vid, CAST(coalesce(label, 0) AS BIGINT) AS label FROM vert LEFT JOIN cc ON vid = node"
SUBSET = f"""WITH {MESH}, tv AS (SELECT tid, unnest([a, b, c]) AS vid FROM tri), ch AS (SELECT tid FROM tv JOIN vert ON tv.vid = vert.vid GROUP BY tid HAVING count(*) FILTER (WHERE z > 1.5e0) >= 2),
kt AS (SELECT * FROM tri WHERE tid IN (SELECT tid FROM ch)), kv AS (SELECT DISTINCT unnest([a, b, c]) AS vid FROM kt), nv AS (SELECT vid, row_number() OVER (ORDER BY vid) - 1 AS n FROM kv)
SELECT CAST(row_number() OVER (ORDER BY tid) - 1 AS BIGINT) AS tid, CAST(tid AS BIGINT) AS old_tid, CAST(p.n AS BIGINT) AS a, CAST(q.n AS BIGINT) AS b, CAST(s.n AS BIGINT) AS c FROM kt JOIN nv p ON a = p.vid JOIN nv q ON b = q.vid JOIN nv s ON c = s.vid"""


def reduced(agg: str) -> str:
    return f"WITH {VOX} SELECT voxel_idx, round(coalesce({agg}, 0e0), 6) + 0e0 AS value FROM vox LEFT JOIN lineitem ON voxel_idx = l_orderkey GROUP BY voxel_idx"


def field(values: str, source: str, factor: str, iterations: int, digits: int = 6) -> str:
    """Raw field ``f0`` from a CTE (i, j, k, value), Otsu on it, then smoothing."""
    head = f"{source}, f0 AS (SELECT (i::BIGINT * ny + j) * nz + k AS flat, i, j, k, value FROM {values}, g WHERE value <> 0), {otsu('f0', 'value', 'ot')}, {CUBE}"
    last = "f0"
    for n in range(iterations):
        head += ", " + smooth(last, f"f{n + 1}")
        last = f"f{n + 1}"
    return f"WITH {head} SELECT flat, {r('value', digits)}, round({factor} * threshold, {digits}) + 0e0 AS iso FROM {last}, ot"


ORACLE_SQL: dict[str, str] = {
    "voxel_reduce_max": reduced("greatest(0e0, max(l_quantity))"),
    "voxel_reduce_sum": reduced("sum(l_quantity)"),
    "voxel_reduce_mean": reduced("avg(l_quantity)"),
    "primary_peak_first_vs_max": f"WITH {FIX}, {QA}, {FIRST} SELECT qa.voxel_idx, round(value, 9) + 0e0 AS max_amp, round(first_amp, 9) + 0e0 AS first_amp FROM qa LEFT JOIN fp ON qa.voxel_idx = fp.voxel_idx",
    "otsu_threshold": f"WITH {FIX}, {QA}, {otsu('qa', 'value', 'ot')} SELECT CAST(bin AS BIGINT) AS bin, {r('threshold')} FROM ot",
    "qa_diagnostics": f"WITH {FIX}, {QA}, {otsu('qa', 'value', 'ot')} SELECT CAST(count(*) FILTER (WHERE value > 0) AS BIGINT) AS n_pos, round(max(value), 6) AS max, round(sum(value) / greatest(count(*) FILTER (WHERE value > 0), 1), 6) AS mean_pos, round(max(threshold), 6) AS otsu, round(max(threshold), 6) AS iso, CAST(count(*) FILTER (WHERE value > threshold) AS BIGINT) AS n_above FROM qa, ot",
    "wm_mask": f"WITH {FIX}, {QA}, {otsu('qa', 'value', 'ot')} SELECT voxel_idx, i, j, k FROM qa, ot WHERE value > threshold",
    "field_otsu": field("qa", f"{FIX}, {QA}", "1e0", 1, 9),
    "field_from_dpf": field("qm", f"{GRID}, {VOX}, qm AS (SELECT voxel_idx, i, j, k, coalesce(avg(l_quantity), 0e0) AS value FROM vox LEFT JOIN lineitem ON voxel_idx = l_orderkey GROUP BY ALL)", "0.5::DOUBLE", 1),
    "field_from_dpv": field("pv", f"{GRID}, {VOX}, pv AS (SELECT i, j, k, o_totalprice AS value FROM vox)", "1e0", 0),
    "fixels_build": f"WITH {built('true')} {SHOW}",
    "fixels_threshold": f"WITH {built('amplitude >= 0.4::DOUBLE')} {SHOW}",
    "fixels_otsu": f"WITH {built('amplitude >= (SELECT threshold FROM ot)', ', ' + otsu('fx', 'amplitude', 'ot'))} {SHOW}",
    "fixels_qa_otsu": f"WITH {built('voxel_idx IN (SELECT voxel_idx FROM fp, ot WHERE first_amp >= threshold)', f', {FIRST}, ' + otsu('fp', 'first_amp', 'ot'))} {SHOW}",
    "fixels_qa_threshold": f"WITH {built('voxel_idx IN (SELECT voxel_idx FROM fp WHERE first_amp >= 0.4::DOUBLE)', f', {FIRST}')} {SHOW}",
    "fixels_voxel_filtered": f"WITH {built("voxel_idx IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")} {SHOW}",
    "fixel_jitter_hashes": f"WITH {LINES}, ids AS (SELECT l_orderkey * 64 + peak_no AS fixel_id FROM ln), {jitter('ids', 'jj')} SELECT fixel_id, h0, h1, h2, {r('jx jy jz', 9)} FROM jj",
    "mesh_jitter_hashes": "SELECT o_orderkey AS vid, " + ", ".join(f"((((o_orderkey::HUGEINT * {f}) // {1 << s}) % 65536)::BIGINT / 65536e0 - 5e-1) * 2e-2 AS j{c}" for c, (f, s) in zip("xyz", ((2654435761, 17), (40503, 13), (2246822519, 11)), strict=True)) + " FROM orders",
    "synthetic_from_handles": f"WITH {SYNX} SELECT fixel_id, fixel_id AS voxel_idx, {r('px py pz dx dy dz')}, round(amplitude, 6) AS amp_norm FROM sx",
    "lookup_contains": f"WITH {FIX} SELECT fixel_id, amplitude >= 0.4::DOUBLE AS present, CAST(count(*) FILTER (WHERE amplitude >= 0.4::DOUBLE) OVER () AS BIGINT) AS n_kept, CAST(count(*) OVER () AS BIGINT) AS nb_peaks FROM fx",
    "range_neighbours": f"{NN} SELECT a, b, {r('d2')} FROM pr WHERE d2 <= 9",
    "nearest_16": f"{KNN} SELECT a, b, {r('d2')} FROM kk",
    "median_nn": f"{KNN}, dd AS (SELECT a, sqrt(min(d2)) AS d FROM kk WHERE a <> b GROUP BY a) SELECT round(percentile_disc(0.5) WITHIN GROUP (ORDER BY d DESC), 6) AS distance FROM dd",
    "data_support": SUPPORT,
    "ptt_propagator_grid": f"WITH {KGRID}, {prop('1.25::DOUBLE')} SELECT {r('k1 k2 ' + ' '.join(f'a{n}' for n in range(9)), 9)} FROM pr",
    "ptt_frames": f"WITH {SYNX}, {FRAMES} SELECT fixel_id, {r(' '.join(f'{a}{c}' for a in 'quvw' for c in 'xyz'))} FROM fr",
    "ptt_walk": f"WITH {SYNX}, {FRAMES}, kg AS (SELECT 1e-1 AS k1, -5e-2 AS k2), {prop('1.25::DOUBLE')}, w0 AS (SELECT * FROM fr, pr), {walked('w0', 'w1')} SELECT fixel_id, {r(' '.join(f'{a}{c}' for a in 'quvw' for c in 'xyz'))} FROM w1",
    "arc_likelihood_straight": arcs(ONE_K),
    "best_arc_likelihood": arcs(KGRID),
    "fanned_probe": arcs(ONE_K, FAN),
    "capture_visited": VISITED,
    "polyline_length": "WITH p AS (SELECT o_custkey AS sid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, 1.7e0 * (o_orderkey // 600) AS x, 1.7e0 * ((o_orderkey // 24) % 25) AS y, 1.7e0 * (o_orderkey % 24) AS z FROM orders), d AS (SELECT sid, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS d FROM p WINDOW w AS (PARTITION BY sid ORDER BY n)) SELECT sid, round(coalesce(sum(d), 0e0), 6) + 0e0 AS length FROM d GROUP BY sid",
    "trace_streamlines": trace(5),
    "trace_all_bundles": TRACE_ALL,
    "mean_filter_1": f"WITH {PRICE}, {CUBE}, {smooth('f0', 'f1')} SELECT flat, {r('value', 9)} FROM f1",
    "mean_filter_3": f"WITH {PRICE}, {CUBE}, {smooth('f0', 'f1')}, {smooth('f1', 'f2')}, {smooth('f2', 'f3')} SELECT flat, {r('value', 9)} FROM f3",
    "erode_1": f"WITH {MASK}, {SEVEN}, {spread('mask', 'sp')} SELECT flat FROM sp GROUP BY flat HAVING count(*) = 7",
    "dilate_1": f"WITH {MASK}, {SEVEN}, {spread('mask', 'sp')} SELECT DISTINCT flat FROM sp",
    "majority_27": f"WITH {MASK}, {CUBE}, {spread('mask', 'sp')} SELECT flat FROM sp GROUP BY flat HAVING count(*) > 13",
    "negate_mask": f"WITH {MASK} SELECT flat FROM (SELECT unnest(range((SELECT nx::BIGINT * ny * nz FROM g))) AS flat) WHERE flat NOT IN (SELECT flat FROM mask)",
    "voxel_components": f"{VOXEL_CC} SELECT node AS flat, CAST(label AS BIGINT) AS label FROM cc",
    "component_sizes": f"{VOXEL_CC} SELECT CAST(label AS BIGINT) AS label, CAST(count(*) AS BIGINT) AS count FROM cc GROUP BY label UNION ALL SELECT 0, (SELECT nx::BIGINT * ny * nz FROM g) - (SELECT count(*) FROM cc)",
    "drop_small": f"{VOXEL_CC} SELECT node AS flat FROM cc WHERE label IN (SELECT label FROM cc GROUP BY label HAVING count(*) >= 5)",
    "keep_largest": f"{VOXEL_CC} SELECT node AS flat FROM cc WHERE label = (SELECT label FROM cc GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)",
    "propagate_labels": SPREAD,
    "mesh_components": MESH_CC,
    "one_ring": f"WITH {MESH}, {RING} SELECT u, v FROM ring",
    "taubin_1": f"WITH {MESH}, {RING}, {laplace('vert', 'l1', '0.5::DOUBLE')}, {laplace('l1', 'l2', '(-0.53::DOUBLE)')} SELECT vid, {r('x y z', 3)} FROM l2",
    "vertex_normals": f"WITH {NORMALS} SELECT vid, {r('nx ny nz')} FROM nrm",
    "mesh_volume": f"WITH {MESH}, {CORNERS} SELECT round(abs(sum(ax * (by_ * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by_ * cx)) / 6), 3) AS volume FROM cn",
    "split_x_sign": f"WITH {MESH}, {CORNERS} SELECT tid, a, b, c, CASE WHEN ax < 0 THEN 'lh' ELSE 'rh' END AS hemi FROM cn WHERE (ax < 0 AND bx < 0 AND cx < 0) OR (ax >= 0 AND bx >= 0 AND cx >= 0)",
    "subset_mesh": SUBSET,
    "visualisation_pair": f"WITH {NORMALS} SELECT vid, {r('x y z', 9)}, round(x - 2 * nx, 9) + 0e0 AS pial_x, round(y - 2 * ny, 9) + 0e0 AS pial_y, round(z - 2 * nz, 9) + 0e0 AS pial_z FROM nrm",
    "trilinear_sample": TRILINEAR,
    "write_roundtrip_dpf": f"WITH {LINES} SELECT l_orderkey * 64 + peak_no AS fixel_id, CAST(l_linenumber AS BIGINT) AS line, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS quantity FROM ln",
    "write_roundtrip_dpv": "SELECT o_orderkey AS voxel_idx, CAST(o_custkey AS BIGINT) AS customer, CAST(o_custkey % 1000 AS BIGINT) AS customer16 FROM orders",
    "write_roundtrip_group": "SELECT o_orderkey AS voxel_idx, 'status_' || o_orderstatus AS group_name FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "streamlines_roundtrip": "SELECT o_custkey AS sid, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx, round(CAST(CAST(1.7e0 * (o_orderkey // 600) AS FLOAT) AS DOUBLE), 3) AS x, round(CAST(CAST(1.7e0 * ((o_orderkey // 24) % 25) AS FLOAT) AS DOUBLE), 3) AS y, round(CAST(CAST(1.7e0 * (o_orderkey % 24) AS FLOAT) AS DOUBLE), 3) AS z FROM orders",
    "nifti_roundtrip": f"WITH {VOX} SELECT i, j, k, CAST(o_custkey % 1000 + 1 AS BIGINT) AS value FROM vox",
    "catalog": "SELECT * FROM (VALUES ('dpv', 'totalprice'), ('dpf', 'discount'), ('dpf', 'quantity')) t(kind, name)",
}
