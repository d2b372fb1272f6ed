"""DuckDB SQL for the queries of the catalog, from the same parameters."""

from __future__ import annotations

import math

from octavo.operators.cloud import NEIGHBOURS
from octavo.plans import catalog as q

D = "CAST({} AS DOUBLE)".format


def with_(*names: str) -> str:
    """WITH clause of the named expressions and what they need, in the order of CTES."""
    need = set(names)
    for name in reversed(list(CTES)):
        if name in need:
            need |= set(CTES[name][0])
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in CTES if n in need)


def _index(a: str, low: str, side: str, level: int) -> str:
    n = 2**level
    return f"greatest(least(CAST(floor(({a} - {low}) / ({side} / {n})) AS BIGINT), {n - 1}), 0)"


def _low_index(a: str, low: str, side: str, level: int) -> str:
    n = 2**level
    return f"greatest(least(CAST(ceil(({a} - {low}) / ({side} / {n})) - 1 AS BIGINT), {n - 1}), 0)"


def _key(ix: str, iy: str, iz: str, level: int) -> str:
    digits = [f"CAST((({ix}) >> {k} & 1) * 4 + (({iy}) >> {k} & 1) * 2 + (({iz}) >> {k} & 1) AS VARCHAR)" for k in range(level - 1, -1, -1)]
    return " || ".join(["'r'", *digits])


def _key_index(key: str, axis: int) -> str:
    return (
        f"coalesce(list_sum(list_transform(range(1, length({key})), "
        f"lambda i: ((CAST(substr({key}, i + 1, 1) AS INTEGER) >> {2 - axis}) & 1) << (length({key}) - 1 - i))), 0)"
    )


def _node_box(key: str, lows: tuple[str, str, str], side: str, prefix: str = "") -> str:
    width = f"({side} / pow(2.0, length({key}) - 1))"
    lower = [f"{low} + {_key_index(key, i)} * {width}" for i, low in enumerate(lows)]
    return ", ".join(
        [f"{x} AS {prefix}l{a}" for x, a in zip(lower, "xyz", strict=True)]
        + [f"{x} + {width} AS {prefix}u{a}" for x, a in zip(lower, "xyz", strict=True)]
    )


def _varint(v: str) -> str:
    cases = []
    for size in range(1, 10):
        parts = [f"lpad(hex((({v}) >> {7 * k}) & 127 | {128 if k < size - 1 else 0}), 2, '0')" for k in range(size)]
        cases.append(f"WHEN {v} < {1 << 7 * size} THEN " + " || ".join(parts))
    return f"CASE {' '.join(cases)} END"


def _box(values) -> dict[str, str]:
    return {f: D(v) for f, v in zip(("lx", "ly", "lz", "ux", "uy", "uz"), values, strict=True)}


QB = _box(q.QUERY_BOX)
M = ("m.lx", "m.ly", "m.lz")
G = ("g.lx", "g.ly", "g.lz")
INDEX = ", ".join(f"{_index(f'p.{a}', low, 'm.side', q.LEVEL)} AS i{a}" for a, low in zip("xyz", M, strict=True))
_clod = f"ln({D(float(2 ** (3 * q.LEVEL + 3) - 1))} * u + 1) / {D(repr(3 * math.log(2)))}"

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "p": (
        (),
        """SELECT l_quantity AS x, l_extendedprice / CAST(2000 AS DOUBLE) AS y,
    datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / CAST(50 AS DOUBLE) AS z,
    CAST(l_linenumber * 32 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g, CAST(l_partkey % 256 AS INTEGER) AS b,
    ((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 10007) / CAST(10007 AS DOUBLE) AS u,
    l_suppkey AS supplier FROM lineitem""",
    ),
    "t": (
        ("p",),
        "SELECT count(x) AS points, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS ux, max(y) AS uy, max(z) AS uz FROM p",
    ),
    "m": (("t",), "SELECT *, greatest(ux - lx, uy - ly, uz - lz) AS side FROM t"),
    "g": (
        ("m",),
        """SELECT lx - side / 10000 AS lx, ly - side / 10000 AS ly, lz - side / 10000 AS lz,
    (lx + side + side / 10000) - (lx - side / 10000) AS side FROM m""",
    ),
    "f": (("m",), f"SELECT p.*, {INDEX} FROM p, m"),
    "fixed": (("f",), f"SELECT *, {_key('ix', 'iy', 'iz', q.LEVEL)} AS node_key FROM f"),
    "leveled": (("f",), f"SELECT *, CAST(least(floor({_clod}), {q.LEVEL}) AS INTEGER) AS level FROM f"),
    "keyed": (("leveled",), f"SELECT *, substr({_key('ix', 'iy', 'iz', q.LEVEL)}, 1, level + 1) AS node_key FROM leveled"),
    "counts": (("keyed",), "SELECT node_key, count(*) AS n FROM keyed GROUP BY node_key"),
    "placed": (
        ("keyed",),
        "SELECT k.*, "
        + ", ".join(
            f"m.l{a} + (i{a} >> ({q.LEVEL} - level)) * (m.side / pow(2.0, level)) AS o{a}" for a in "xyz"
        )
        + " FROM keyed k, m",
    ),
    "quantised": (
        ("placed",),
        "SELECT node_key, r, g, b, " + ", ".join(f"CAST(floor(({a} - o{a}) / CAST('0.001' AS DOUBLE)) AS BIGINT) AS q{a}" for a in "xyz") + " FROM placed",
    ),
    "records": (
        ("quantised",),
        "SELECT node_key, "
        + " || ".join(f"({_varint(f'q{a}')})" for a in "xyz")
        + " || "
        + " || ".join(f"lpad(hex({c}), 2, '0')" for c in "rgb")
        + " AS record FROM quantised",
    ),
    "blobs": (
        ("records",),
        """SELECT length(node_key) - 1 AS level, node_key, (length(node_key) - 1) || node_key AS row_key, 0 AS part,
    count(*) AS n, string_agg(record, '' ORDER BY record) AS payload FROM records GROUP BY node_key""",
    ),
    "s": (
        ("p",),
        """SELECT supplier, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) AS ux, max(y) AS uy, max(z) AS uz
    FROM p GROUP BY supplier""",
    ),
    "deep": (
        ("g",),
        "SELECT p.*, "
        + _key(*[_low_index(f"p.{a}", low, "g.side", q.LEAF_LEVELS) for a, low in zip("xyz", G, strict=True)], q.LEAF_LEVELS)
        + " AS deep_key FROM p, g",
    ),
    "nodes": (
        ("deep",),
        " UNION ALL ".join(
            f"SELECT substr(deep_key, 1, {k + 1}) AS node_key, count(*) AS n FROM deep GROUP BY 1" for k in range(q.LEAF_LEVELS + 1)
        ),
    ),
    "children": (
        ("nodes",),
        f"""SELECT node_key || d AS node_key FROM nodes, (SELECT CAST(unnest(range(8)) AS VARCHAR) AS d)
    WHERE n > {q.LEAF} AND length(node_key) - 1 < {q.LEAF_LEVELS} UNION ALL SELECT 'r'""",
    ),
    "parts": (
        ("children",),
        f"""SELECT CAST(row_number() OVER (ORDER BY node_key) - 1 AS INTEGER) AS partition_id, node_key, length(node_key) - 1 AS level, n
    FROM (SELECT c.node_key, coalesce(n, 0) AS n FROM children c LEFT JOIN nodes USING (node_key))
    WHERE NOT (n > {q.LEAF} AND length(node_key) - 1 < {q.LEAF_LEVELS})""",
    ),
    "regions": (("parts", "g"), f"SELECT parts.*, {_node_box('node_key', G, 'g.side')} FROM parts, g"),
    "places": (("p",), "SELECT x, y, z, count(*) AS m FROM p GROUP BY ALL"),
    "near": (
        ("places",),
        f"""SELECT a.x, a.y, a.z, a.m, b.m AS nm, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz
    FROM (SELECT *, floor(x / 2) + o.i AS cx, floor(y / 2) + o.j AS cy, floor(z / 2) + o.k AS cz FROM places,
        (SELECT i, j, k FROM (VALUES (-1), (0), (1)) u(i), (VALUES (-1), (0), (1)) v(j), (VALUES (-1), (0), (1)) w(k)) o) a
    JOIN (SELECT *, floor(x / 2) AS cx, floor(y / 2) AS cy, floor(z / 2) AS cz FROM places) b USING (cx, cy, cz)
    WHERE abs(b.x - a.x) <= {D(q.SEARCH / 2)} AND abs(b.y - a.y) <= {D(q.SEARCH / 2)} AND abs(b.z - a.z) <= {D(q.SEARCH / 2)}""",
    ),
}


def _lod() -> str:
    """The grid filter unrolled, one point a row."""
    ctes, parts = [], []
    before = "SELECT x, y, z, r, g, b FROM p"
    for level in range(q.LOD_LEVELS + 1):
        width = f"(g.side / {q.CELLS} / {2**level})"
        cells = ", ".join(f"CAST(floor((c.{a} - g.l{a}) / {width}) AS BIGINT) AS c{a}" for a in "xyz")
        off = [f"({a} - ((c{a} + 0.5) * w + g{a}))" for a in "xyz"]
        shift = int(math.log2(q.CELLS))
        ctes.append(f"c{level} AS (SELECT c.*, {cells}, {width} AS w, g.lx AS gx, g.ly AS gy, g.lz AS gz FROM ({before}) c, g)")
        ctes.append(
            f"d{level} AS (SELECT *, sqrt({' + '.join(f'{o} * {o}' for o in off)}) AS dist, "
            f"{_key(*[f'(c{a} >> {shift})' for a in 'xyz'], level)} AS node_key FROM c{level})"
        )
        ctes.append(
            f"e{level} AS (SELECT *, count(*) OVER (PARTITION BY node_key) AS held, "
            f"row_number() OVER (PARTITION BY cx, cy, cz ORDER BY dist, x, y, z, r, g, b) AS place FROM d{level})"
        )
        stays = "TRUE" if level == q.LOD_LEVELS else f"held <= {q.ROOM} OR place = 1"
        parts.append(f"SELECT x, y, z, r, g, b, {level} AS level, node_key FROM e{level} WHERE {stays}")
        before = f"SELECT x, y, z, r, g, b FROM e{level} WHERE held > {q.ROOM} AND place > 1"
    return f"{with_('p', 'g')},\n" + ",\n".join(ctes) + ",\nlod AS (" + " UNION ALL ".join(parts) + ")"


def _kdb() -> str:
    """The k-d tree unrolled: at each level the boxes of nodes, the median of those that split, and the points below."""
    ctes, leaves = [], []
    boxes, points = "SELECT '' AS node, lx, ly, lz, ux, uy, uz, points AS n FROM t", "SELECT x, y, z, '' AS node FROM p"
    for level in range(q.KDB_LEVELS + 1):
        over = f"n > {q.LEAF}" if level < q.KDB_LEVELS else "FALSE"
        ctes.append(f"k{level} AS MATERIALIZED ({points}), b{level} AS MATERIALIZED ({boxes})")
        leaves.append(f"SELECT lx, ly, lz, ux, uy, uz, {level} AS level, n FROM b{level} WHERE NOT ({over})")
        sides = {a: f"u{a} - l{a}" for a in "xyz"}
        ctes.append(
            f"s{level} AS MATERIALIZED (SELECT *, CASE WHEN {sides['x']} > {sides['y']} AND {sides['x']} > {sides['z']} THEN 0 "
            f"WHEN {sides['x']} <= {sides['y']} AND {sides['y']} > {sides['z']} THEN 1 ELSE 2 END AS axis FROM b{level} WHERE {over})"
        )
        ctes.append(f"v{level} AS MATERIALIZED (SELECT k.*, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM k{level} k JOIN s{level} USING (node))")
        ctes.append(f"c{level} AS MATERIALIZED (SELECT node, list_sort(list(v))[count(*) // 2 + 1] AS cut FROM v{level} GROUP BY node)")
        points = f"SELECT x, y, z, node || CASE WHEN v > cut THEN '1' ELSE '0' END AS node FROM v{level} JOIN c{level} USING (node)"
        halves = " UNION ALL ".join(
            f"SELECT node || '{side}' AS node, "
            + ", ".join(
                f"CASE WHEN axis = {i} THEN cut ELSE {end}{a} END AS {end}{a}" if end == moved else f"{end}{a}"
                for end in "lu"
                for i, a in enumerate("xyz")
            )
            + f" FROM s{level} JOIN c{level} USING (node)"
            for side, moved in ((0, "u"), (1, "l"))
        )
        boxes = f"SELECT h.*, (SELECT count(*) FROM k{level + 1} k WHERE k.node = h.node) AS n FROM ({halves}) h"
    return f"{with_('p', 't')},\n" + ",\n".join(ctes) + "\n" + " UNION ALL ".join(leaves)


def _normals() -> str:
    """x, y, z, m, n and the normal of each place, from the covariances by the closed form of a symmetric 3x3 matrix."""
    cov = lambda a, b: f"CASE WHEN sum(nm) > 1 THEN (sum(nm * d{a} * d{b}) - sum(nm * d{a}) * sum(nm * d{b}) / sum(nm)) / (sum(nm) - 1) ELSE 0 END"
    rows = (("a - low", "b", "c"), ("b", "d - low", "e"), ("c", "e", "f - low"))
    cross = lambda u, v: [f"(({u[i]}) * ({v[j]}) - ({u[j]}) * ({v[i]}))" for i, j in ((1, 2), (2, 0), (0, 1))]
    made = [cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    vectors = ", ".join("{s: " + " + ".join(f"{x} * {x}" for x in v) + ", " + ", ".join(f"{k}: {x}" for k, x in zip("xyz", v, strict=True)) + "}" for v in made)
    sized = ", ".join(f"v.{k} / nullif(sqrt(v.s), 0) AS u{k}" for k in "xyz")
    most = "greatest(abs(ux), abs(uy), abs(uz)) - 1e-6"
    lead = f"CASE WHEN abs(ux) >= {most} THEN ux WHEN abs(uy) >= {most} THEN uy ELSE uz END"
    normal = ", ".join(f"CASE WHEN n >= 3 AND gap > {D(q.LEAST_GAP)} AND v.s > 0 THEN CASE WHEN {lead} < 0 THEN -u{k} ELSE u{k} END ELSE 0 END AS normal_{k}" for k in "xyz")
    return f"""{with_('near')},
    h0 AS (SELECT x, y, z, m, CAST(sum(nm) AS BIGINT) AS n, {cov('x', 'x')} AS a, {cov('x', 'y')} AS b, {cov('x', 'z')} AS c,
        {cov('y', 'y')} AS d, {cov('y', 'z')} AS e, {cov('z', 'z')} AS f FROM near GROUP BY x, y, z, m),
    h1 AS (SELECT *, (a + d + f) / 3 AS q FROM h0),
    h2 AS (SELECT *, sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)) / 6) AS p,
        (a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - e * c) + c * (b * e - (d - q) * c) AS det FROM h1),
    h3 AS (SELECT *, CASE WHEN p > 0 THEN acos(greatest(least(coalesce(det / nullif(2 * p * p * p, 0), 1), 1), -1)) / 3 ELSE 0 END AS phi FROM h2),
    h4 AS (SELECT *, q + 2 * p * cos(phi) AS high, q + 2 * p * cos(phi + {D(repr(2 * math.pi / 3))}) AS low FROM h3),
    h5 AS (SELECT *, coalesce((3 * q - high - 2 * low) / nullif(high, 0), 0) AS gap, list_max([{vectors}]) AS v FROM h4),
    h6 AS (SELECT *, {sized} FROM h5),
    normal AS (SELECT x, y, z, m, n, {normal} FROM h6)"""


def oracle_sql() -> dict[str, str]:
    volume = "(ux - lx) * (uy - ly) * (uz - lz)"
    meets = "s.lx <= {ux} AND s.ux >= {lx} AND s.ly <= {uy} AND s.uy >= {ly} AND s.lz <= {uz} AND s.uz >= {lz}".format(**QB)
    holds = "s.lx <= {lx} AND s.ux >= {ux} AND s.ly <= {ly} AND s.uy >= {uy} AND s.lz <= {lz} AND s.uz >= {uz}".format(**QB)
    common = ", ".join(
        [f"CASE WHEN {meets} THEN greatest(s.l{a}, {QB[f'l{a}']}) END AS c_l{a}" for a in "xyz"]
        + [f"CASE WHEN {meets} THEN least(s.u{a}, {QB[f'u{a}']}) END AS c_u{a}" for a in "xyz"]
    )
    whole = ", ".join(
        [f"least(s.l{a}, {QB[f'l{a}']}) AS w_l{a}" for a in "xyz"] + [f"greatest(s.u{a}, {QB[f'u{a}']}) AS w_u{a}" for a in "xyz"]
    )
    level = lambda d: (
        f"SELECT points, {d} AS dimension, points // 1000 AS blocks, ln(points // 1000) / ln(pow(2.0, {d})) AS v FROM m"
    )
    half = {a: f"(m.side / 2)" for a in "xyz"}
    octant = [f"m.l{a} + {half[a]} * ((child >> {2 - i}) & 1)" for i, a in enumerate("xyz")]
    unit = lambda c: f"CAST(floor({c} * {D(1e4)} + {D(0.1234567)}) AS BIGINT)"
    cov = lambda a, b: (
        f"{unit(f'CASE WHEN sum(nm) > 1 THEN (sum(nm * d{a} * d{b}) - sum(nm * d{a}) * sum(nm * d{b}) / sum(nm)) / (sum(nm) - 1) END')} AS c{a}{b}"
    )
    w = D(q.GRID)
    order = {a: f"CAST(floor((p.{a} - (m.l{a} - {w})) / {w}) AS BIGINT)" for a in "xyz"}
    count = {a: f"CAST(floor((m.u{a} + {w} - (m.l{a} - {w})) / {w} + 0.5) AS BIGINT)" for a in "xyz"}
    touch = " AND ".join(f"r.l{a} <= p.{a} + {D(q.HALO)} / 2 AND r.u{a} >= p.{a} - {D(q.HALO)} / 2" for a in "xyz")
    inside = " AND ".join(f"p.{a} >= r.l{a} AND p.{a} <= r.u{a}" for a in "xyz")
    overlap = " AND ".join(f"r.l{a} <= s.u{a} AND r.u{a} >= s.l{a}" for a in "xyz")
    names = "row_key || '-data-bin'"
    lod = _lod()
    return {
        "scan_points": with_("p") + " SELECT x, y, z, r, g, b FROM p",
        "cloud_metadata": with_("m") + " SELECT *, lx + side AS cube_ux, ly + side AS cube_uy, lz + side AS cube_uz FROM m",
        "max_level": with_("m")
        + f""" SELECT points, dimension, CAST(CASE WHEN blocks < 1 THEN 0 WHEN v >= floor(v) + 0.4 THEN ceil(v)
        ELSE floor(v + 0.5) END AS INTEGER) AS max_level FROM ({level(2)} UNION ALL {level(3)})""",
        "split_dimension": with_("m")
        + """ SELECT ratio, CASE WHEN least(ux - lx, uy - ly, uz - lz) < side / ratio THEN 2 ELSE 3 END AS dimension,
        CASE WHEN least(ux - lx, uy - ly, (uz - lz) / 100) < greatest(ux - lx, uy - ly, (uz - lz) / 100) / ratio THEN 2 ELSE 3 END
        AS flat_dimension FROM m, (SELECT CAST(unnest([3, 10]) AS DOUBLE) AS ratio)""",
        "search_length": with_("m")
        + f""" SELECT points, round({volume}, 6) AS volume, round(points / ({volume}), 6) AS density,
        round(pow({NEIGHBOURS} / (points / ({volume})), 1 / CAST(3 AS DOUBLE)), 6) AS search_length FROM m""",
        "clod_level": with_("leveled") + " SELECT level, count(*) AS n FROM leveled GROUP BY level",
        "node_keys": with_("fixed") + " SELECT x, y, z, node_key FROM fixed",
        "node_counts": with_("fixed") + " SELECT node_key, count(*) AS n FROM fixed GROUP BY node_key",
        "node_boxes": with_("fixed")
        + f" SELECT node_key, {_node_box('node_key', M, 'm.side')} FROM (SELECT DISTINCT node_key FROM fixed), m",
        "grid_cells": with_("g")
        + """, c AS (SELECT x, y, z, g.side / 32 / 2 AS w, g.lx AS gx, g.ly AS gy, g.lz AS gz,
            CAST(floor((x - g.lx) / (g.side / 32 / 2)) AS BIGINT) AS cx, CAST(floor((y - g.ly) / (g.side / 32 / 2)) AS BIGINT) AS cy,
            CAST(floor((z - g.lz) / (g.side / 32 / 2)) AS BIGINT) AS cz FROM p, g)
        SELECT x, y, z, cx, cy, cz, (cx << 42) | (cy << 21) | cz AS cell, sqrt((x - ((cx + 0.5) * w + gx)) * (x - ((cx + 0.5) * w + gx))
            + (y - ((cy + 0.5) * w + gy)) * (y - ((cy + 0.5) * w + gy)) + (z - ((cz + 0.5) * w + gz)) * (z - ((cz + 0.5) * w + gz))) AS dist FROM c""",
        "grid_lod": lod + " SELECT * FROM lod",
        "lod_level_counts": lod + " SELECT level, count(*) AS n, count(DISTINCT node_key) AS nodes FROM lod GROUP BY level",
        "box_range_query": with_("p")
        + " SELECT x, y, z, r, g, b FROM p WHERE x BETWEEN {lx} AND {ux} AND y BETWEEN {ly} AND {uy} AND z BETWEEN {lz} AND {uz}".format(**QB),
        "box_intersects": with_("s") + f" SELECT supplier, {meets} AS meets, NOT ({meets}) AS apart, {holds} AS holds FROM s",
        "box_algebra": with_("s")
        + f""" SELECT supplier, {common}, {whole}, lx + greatest(ux - lx, uy - ly, uz - lz) AS cube_ux, round({volume}, 4) AS volume,
        (lx + ux) / 2 AS centre_x, lx - (ux - lx) / 10000 AS grown_lx, lx <= ux AND ly <= uy AND lz <= uz AS valid FROM s""",
        "box_octants": with_("m")
        + " SELECT child, "
        + ", ".join(
            [f"{o} AS l{a}" for o, a in zip(octant, "xyz", strict=True)]
            + [f"{o} + {half[a]} AS u{a}" for o, a in zip(octant, "xyz", strict=True)]
        )
        + " FROM m, (SELECT CAST(unnest(range(8)) AS INTEGER) AS child)",
        "octree_leaves": with_("regions") + " SELECT * FROM regions",
        "octree_stats": with_("parts")
        + """ SELECT CAST(sum(n) AS BIGINT) AS elements, count(*) AS leaves, count(*) FILTER (n > 0) AS filled_leaves,
        max(level) AS tree_level, max(n) AS largest_leaf FROM parts""",
        "spatial_partition": with_("parts")
        + " SELECT x, y, z, node_key, partition_id FROM deep JOIN parts ON starts_with(deep_key, node_key)",
        "partition_lookup": with_("regions", "s") + f" SELECT supplier, partition_id FROM s JOIN regions r ON {overlap}",
        "halo_replicate": with_("regions")
        + f" SELECT partition_id, {inside} AS is_local, count(*) AS n FROM p JOIN regions r ON {touch} GROUP BY ALL",
        "neighbor_counts": with_("near") + " SELECT x, y, z, m, CAST(sum(nm) AS BIGINT) AS n_neighbors FROM near GROUP BY x, y, z, m",
        "neighborhood_cov": with_("near")
        + f""" SELECT x, y, z, CAST(sum(nm) AS BIGINT) AS n, {cov('x', 'x')}, {cov('x', 'y')}, {cov('x', 'z')}, {cov('y', 'y')},
        {cov('y', 'z')}, {cov('z', 'z')} FROM near GROUP BY x, y, z, m""",
        "kdb_leaves": _kdb(),
        "normals": _normals()
        + " SELECT x, y, z, m, n, "
        + ", ".join(f"CAST(floor(normal_{a} * 1000 + {D(0.1234567)}) AS BIGINT) AS normal_{a}" for a in "xyz")
        + " FROM normal",
        "normal_lines": _normals()
        + " SELECT concat(x, ' ', y, ' ', z, '[', "
        + ", ', ', ".join(f"floor(normal_{a} * 1000 + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE)" for a in "xyz")
        + ", ']') AS value FROM (SELECT *, unnest(range(m)) FROM normal)",
        "load_order": with_("m")
        + f" SELECT x, y, z, {order['z']} * ({count['x']} * {count['y']}) + {order['y']} * {count['x']} + {order['x']} AS load_order FROM p, m",
        "varint_hex": f"""SELECT number, {_varint('number')} AS code
        FROM (SELECT l_orderkey * l_partkey * l_linenumber AS number FROM lineitem)""",
        "node_encode": with_("records") + " SELECT node_key, record FROM records",
        "blob_table": with_("blobs")
        + " SELECT level, node_key, row_key, part, n, length(payload) // 2 AS size, payload FROM blobs",
        "blob_get": with_("blobs") + " SELECT row_key, part, payload AS value FROM blobs WHERE row_key = '1r5'",
        "blob_scan": with_("blobs")
        + f" SELECT {names} AS name, part, payload AS value FROM blobs WHERE row_key >= '1r2' AND row_key < '2r3'",
        "child_scan": with_("blobs")
        + " SELECT row_key, part, payload AS value FROM blobs WHERE level = 2 AND node_key[1:2] = 'r0' AND node_key[3] IN ('1', '2', '3', '4', '5')",
        "composite_key_split": with_("blobs")
        + f" SELECT {names} AS name, part, row_key, 'data' AS family, 'bin' AS qualifier FROM blobs",
        "hierarchy_index": with_("counts")
        + """, every AS (SELECT substr(node_key, 1, k) AS node_key, CASE WHEN k = length(node_key) THEN n ELSE 0 END AS n
            FROM counts, (SELECT unnest(range(1, 20)) AS k) WHERE k <= length(node_key)),
        tree AS (SELECT node_key, CAST(sum(n) AS BIGINT) AS n FROM every GROUP BY node_key),
        masks AS (SELECT left(node_key, length(node_key) - 1) AS node_key, bit_or(1 << CAST(right(node_key, 1) AS INTEGER)) AS mask
            FROM tree WHERE length(node_key) > 1 GROUP BY 1)
        SELECT node_key, coalesce(mask, 0) AS mask, n, CAST(CAST(floor(n / pow(10.0, e) + 0.5) AS INTEGER) | (e << 4) AS INTEGER) AS count_code
        FROM (SELECT *, CAST(CASE WHEN n > 0 THEN length(CAST(n AS VARCHAR)) - 1 ELSE 0 END AS INTEGER) AS e FROM tree) LEFT JOIN masks USING (node_key)""",
        "sibling_masks": with_("fixed")
        + """, masks AS (SELECT left(node_key, length(node_key) - 1) AS parent_key, bit_or(1 << CAST(right(node_key, 1) AS INTEGER)) AS mask
            FROM (SELECT DISTINCT node_key FROM fixed) GROUP BY 1)
        SELECT parent_key, length(parent_key) AS level, mask, mask = 255 AS merged, CASE WHEN mask = 255 THEN parent_key || '0' END AS left_bottom,
        CASE WHEN mask = 255 THEN parent_key || '7' END AS right_top FROM masks""",
        "query_map": """SELECT page_id, CASE WHEN regexp_matches(s, '(?:^|&)page=') THEN regexp_extract(s, '(?:^|&)page=([^&]*)', 1) END AS page,
        CASE WHEN regexp_matches(s, '(?:^|&)ref=') THEN regexp_extract(s, '(?:^|&)ref=([^&]*)', 1) END AS ref FROM (SELECT page_id, regexp_extract(url, '[?]([^#]*)', 1) AS s FROM pages)""",
    }
