"""DuckDB SQL for fits: seeds, iterations and trees, unrolled or recursive. Each function gives common table expressions, and leaves its result in the one it names."""

from __future__ import annotations

from gridscape.queries.base import sq

GRID_DISTANCE = "pow(c.unit // {n} - a.unit // {n}, 2) + pow(c.unit % {n} - a.unit % {n}, 2)"


def farthest(rows: str, k: int, p: str, first: bool = False) -> list[str]:
    """{p}(unit, w): k rows of (row_id, x), the one farthest from the mean and then each time the one farthest from all chosen, ties to the last; `first`: the first row begins."""
    parts = [
        f"{p}u AS (SELECT unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {rows})",
        f"{p}q AS (SELECT dim, avg(v) AS v FROM {p}u GROUP BY dim)",
        f"{p}mu AS MATERIALIZED (SELECT list(v ORDER BY dim) AS m FROM {p}q)",
        f"{p}f0 AS MATERIALIZED (SELECT row_id, x FROM {rows} r CROSS JOIN {p}mu ORDER BY {'row_id' if first else sq('r.x', f'{p}mu.m') + ' DESC, row_id DESC'} LIMIT 1)",
        f"{p}m0 AS MATERIALIZED (SELECT r.row_id, r.x, {sq('r.x', f'{p}f0.x')} AS d FROM {rows} r CROSS JOIN {p}f0)",
    ]
    for i in range(1, k):
        taken = " UNION ALL ".join(f"SELECT row_id FROM {p}f{j}" for j in range(i))
        parts.append(f"{p}f{i} AS MATERIALIZED (SELECT row_id, x FROM {p}m{i - 1} WHERE row_id NOT IN ({taken}) ORDER BY d DESC, row_id DESC LIMIT 1)")
        parts.append(f"{p}m{i} AS MATERIALIZED (SELECT m.row_id, m.x, least(m.d, {sq('m.x', f'{p}f{i}.x')}) AS d FROM {p}m{i - 1} m CROSS JOIN {p}f{i})")
    return [*parts, f"{p} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {i} AS unit, x AS w FROM {p}f{i}' for i in range(k))})"]


def assigned(rows: str, book: str, name: str) -> str:
    """{name}(row_id, x, unit, d2): the nearest of the book, ties to the first."""
    return f"{name} AS MATERIALIZED (SELECT row_id, x, m.unit AS unit, m.d AS d2 FROM (SELECT r.row_id, any_value(r.x) AS x, min({{'d': {sq('r.x', 'c.w')}, 'unit': c.unit}}) AS m FROM {rows} r CROSS JOIN {book} c GROUP BY r.row_id))"


def lloyd(rows: str, book: str, steps: int, p: str) -> list[str]:
    """{p}(unit, w): the book after so many of Lloyd's steps, by which it should be at rest; a centre without rows stays."""
    parts, now = [], book
    for i in range(steps):
        parts.append(assigned(rows, now, f"{p}a{i}"))
        parts.append(f"{p}u{i} AS (SELECT unit, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {p}a{i}), {p}v{i} AS (SELECT unit, dim, avg(v) AS v FROM {p}u{i} GROUP BY unit, dim)")
        name = p if i == steps - 1 else f"{p}c{i}"
        parts.append(f"{name} AS MATERIALIZED (SELECT c.unit, coalesce(n.w, c.w) AS w FROM {now} c LEFT JOIN (SELECT unit, list(v ORDER BY dim) AS w FROM {p}v{i} GROUP BY unit) n USING (unit))")
        now = name
    return parts


def trained(rows: str, book: str, n: int, epochs: int, rate: float, radius: float, p: str, batches: int = 11) -> list[str]:
    """{p}(unit, w): a map of n columns after its training in row order, in batches of a tenth of the rows and at least 64, units found at each one's start.

    There are at most 11 batches an epoch; those beyond the last row change nothing.
    """
    parts = [f"{p}r AS MATERIALIZED (SELECT row_id, x, row_number() OVER (ORDER BY row_id) - 1 AS p, count(*) OVER () AS n, least(count(*) OVER (), greatest(count(*) OVER () // 10, 64)) AS size FROM {rows})"]
    now = book
    for step in range(epochs * batches):
        e, b = divmod(step, batches)
        t = f"CAST({e} * a.n + a.p AS DOUBLE) / ({epochs} * a.n)"
        parts.append(f"{p}a{step} AS MATERIALIZED (SELECT p, n, x, m.unit AS unit FROM (SELECT r.p, any_value(r.n) AS n, any_value(r.x) AS x, min({{'d': {sq('r.x', 'c.w')}, 'unit': c.unit}}) AS m FROM {p}r r CROSS JOIN {now} c WHERE r.p // r.size = {b} GROUP BY r.p))")
        parts.append(
            f"{p}h{step} AS (SELECT c.unit, a.p, a.x, {radius} * exp(-3 * {t}) AS s, {rate} * exp(-5 * {t}) * exp(-({GRID_DISTANCE.format(n=n)}) / (2 * pow({radius} * exp(-3 * {t}), 2))) AS h,"
            f" greatest(abs(c.unit // {n} - a.unit // {n}), abs(c.unit % {n} - a.unit % {n})) AS away FROM {p}a{step} a CROSS JOIN {now} c)"
        )
        parts.append(f"{p}g{step} AS MATERIALIZED (SELECT unit, p, x, CASE WHEN away > ceil(3 * s) OR h < 1e-8 THEN 0 ELSE h END AS h FROM {p}h{step})")
        parts.append(f"{p}l{step} AS (SELECT unit, x, h * coalesce(product(1 - h) OVER (PARTITION BY unit ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS k FROM {p}g{step})")
        parts.append(f"{p}b{step} AS (SELECT unit, dim, sum(k * v) AS b FROM (SELECT unit, k, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {p}l{step}) GROUP BY unit, dim)")
        parts.append(f"{p}k{step} AS (SELECT unit, product(1 - h) AS keep FROM {p}g{step} GROUP BY unit)")
        name = p if step == epochs * batches - 1 else f"{p}w{step}"
        parts.append(
            f"{name} AS MATERIALIZED (SELECT unit, list(coalesce(keep, 1) * v + coalesce(b, 0) ORDER BY dim) AS w FROM (SELECT unit, unnest(w) AS v, generate_subscripts(w, 1) AS dim FROM {now})"
            f" LEFT JOIN {p}b{step} USING (unit, dim) LEFT JOIN {p}k{step} USING (unit) GROUP BY unit)"
        )
        now = name
    return parts


def batch_map(rows: str, book: str, n: int, epochs: int, radius: float, p: str) -> list[str]:
    """{p}(unit, w): Kohonen's batch map, each epoch at the radius of its first sample."""
    parts, now = [], book
    for e in range(epochs):
        s = f"({radius} * exp(-3 * {e} / {epochs}.0))"
        parts.append(assigned(rows, now, f"{p}a{e}"))
        parts.append(f"{p}s{e} AS MATERIALIZED (SELECT unit, dim, count(*) AS n, sum(v) AS v FROM (SELECT unit, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {p}a{e}) GROUP BY unit, dim)")
        h = f"exp(-({GRID_DISTANCE.format(n=n)}) / (2 * pow({s}, 2)))"
        near = f"greatest(abs(c.unit // {n} - a.unit // {n}), abs(c.unit % {n} - a.unit % {n})) <= ceil(3 * {s})"
        parts.append(f"{p}n{e} AS (SELECT c.unit, a.dim, sum({h} * a.v) / sum({h} * a.n) AS v FROM {now} c JOIN {p}s{e} a ON {near} GROUP BY c.unit, a.dim)")
        name = p if e == epochs - 1 else f"{p}w{e}"
        parts.append(f"{name} AS MATERIALIZED (SELECT unit, list(coalesce(m.v, o.v) ORDER BY dim) AS w FROM (SELECT unit, unnest(w) AS v, generate_subscripts(w, 1) AS dim FROM {now}) o LEFT JOIN {p}n{e} m USING (unit, dim) GROUP BY unit)")
        now = name
    return parts


def tree_cut(book: str, n: int, k: int, p: str) -> list[str]:
    """{p}(unit, cluster): what is left of the grid's least spanning tree without its k - 1 heaviest edges; needs WITH RECURSIVE.

    An edge is in the tree if no path of lesser edges joins its ends.
    """
    return [
        f"{p}e AS MATERIALIZED (SELECT a.unit AS u, b.unit AS o, row_number() OVER (ORDER BY sqrt({sq('a.w', 'b.w')}), a.unit, b.unit) AS nr FROM {book} a JOIN {book} b ON (b.unit = a.unit + 1 AND b.unit % {n} > 0) OR b.unit = a.unit + {n})",
        f"{p}p(nr, v) AS (SELECT nr, u FROM {p}e UNION SELECT p.nr, CASE WHEN e.u = p.v THEN e.o ELSE e.u END FROM {p}p p JOIN {p}e e ON e.nr < p.nr AND p.v IN (e.u, e.o))",
        f"{p}t AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY nr DESC) AS heavy FROM {p}e e WHERE NOT EXISTS (SELECT 1 FROM {p}p p WHERE p.nr = e.nr AND p.v = e.o)) WHERE heavy > {k - 1})",
        f"{p}c(unit, v) AS (SELECT unit, unit FROM {book} UNION SELECT c.unit, CASE WHEN t.u = c.v THEN t.o ELSE t.u END FROM {p}c c JOIN {p}t t ON c.v IN (t.u, t.o))",
        f"{p} AS MATERIALIZED (SELECT unit, CAST(dense_rank() OVER (ORDER BY least) - 1 AS INTEGER) AS cluster FROM (SELECT unit, min(v) AS least FROM {p}c GROUP BY unit))",
    ]


def watershed(cores: str, m: int, n: int, p: str) -> list[str]:
    """{p}(unit, cluster) of (unit, gr, gc, density, core): basins of the strict peaks, flooded first come, first served; -1 elsewhere; needs WITH RECURSIVE.

    One row holds the labels so far and the queue of units; each step takes the next of the queue.
    """
    around = f"list_filter([u - {n}, u + {n}, u - 1, u + 1], lambda o, i: o >= 0 AND o < {m * n} AND (i < 3 OR o // {n} = u // {n}))"
    fresh = f"list_filter({around}, lambda o: cores[o + 1] AND labels[o + 1] = -1)"
    return [
        f"{p}k AS (SELECT unit, density FROM {cores} c WHERE core AND NOT EXISTS (SELECT 1 FROM {cores} o WHERE o.core AND abs(o.gr - c.gr) + abs(o.gc - c.gc) = 1 AND o.density >= c.density))",
        f"{p}s AS MATERIALIZED (SELECT unit, row_number() OVER (ORDER BY density DESC, unit) - 1 AS k FROM (SELECT * FROM {p}k UNION ALL SELECT * FROM (SELECT unit, density FROM {cores} WHERE core AND NOT EXISTS (SELECT 1 FROM {p}k) ORDER BY density DESC, unit DESC LIMIT 1)))",
        f"{p}q(step, labels, queue, cores) AS (SELECT 1, (SELECT list(coalesce(k, -1) ORDER BY c.unit) FROM {cores} c LEFT JOIN {p}s s USING (unit)), (SELECT list(unit ORDER BY k) FROM {p}s), (SELECT list(core ORDER BY unit) FROM {cores})"
        f" UNION ALL SELECT step + 1, list_transform(labels, lambda l, i: CASE WHEN list_contains(new, i - 1) THEN labels[u + 1] ELSE l END), list_concat(queue, new), cores FROM (SELECT *, {fresh} AS new FROM (SELECT *, queue[step] AS u FROM {p}q WHERE step <= len(queue))))",
        f"{p} AS MATERIALIZED (SELECT CAST(generate_subscripts(labels, 1) - 1 AS INTEGER) AS unit, CAST(unnest(labels) AS INTEGER) AS cluster FROM (SELECT labels FROM {p}q ORDER BY step DESC LIMIT 1))",
    ]


def mixture(rows: str, book: str, k: int, d: int, steps: int, p: str) -> list[str]:
    """{p}(row_id, label): the likeliest component, ties to the last, at the first step whose likelihood is within 1e-4 of the one before."""
    parts = [
        assigned(rows, book, f"{p}n"),
        f"{p}o AS (SELECT n.unit, dim, count(*) AS n, sum(pow(v - c, 2)) AS q FROM (SELECT unit, row_id, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {p}n) n JOIN (SELECT unit, unnest(w) AS c, generate_subscripts(w, 1) AS dim FROM {book}) USING (unit, dim) GROUP BY n.unit, dim)",
        f"{p}s0 AS MATERIALIZED (SELECT b.unit, 1.0::DOUBLE / {k} AS g, b.w AS m, o.v FROM {book} b JOIN (SELECT unit, list(greatest((1 + q) / n, 1e-6) ORDER BY dim) AS v FROM {p}o GROUP BY unit) o USING (unit))",
    ]
    for t in range(steps):
        lp = f"ln(greatest(s.g, 1e-300)) - 0.5 * (list_sum(list_transform(list_zip(r.x, s.m, s.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]) / z[3])) + list_sum(list_transform(s.v, lambda z: ln(2 * pi() * z))))"
        parts.append(f"{p}l{t} AS MATERIALIZED (SELECT r.row_id, r.x, s.unit, {lp} AS lp FROM {rows} r CROSS JOIN {p}s{t} s)")
        parts.append(f"{p}z{t} AS MATERIALIZED (SELECT *, top + ln(sum(exp(lp - top)) OVER (PARTITION BY row_id)) AS total FROM (SELECT *, max(lp) OVER (PARTITION BY row_id) AS top FROM {p}l{t}))")
        parts.append(f"{p}u{t} AS (SELECT unit, exp(lp - total) AS r, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {p}z{t})")
        parts.append(f"{p}m{t} AS MATERIALIZED (SELECT unit, dim, sum(r) AS n, sum(r * v) / greatest(sum(r), 1e-10) AS m FROM {p}u{t} GROUP BY unit, dim)")
        parts.append(f"{p}v{t} AS (SELECT u.unit, dim, any_value(m.n) AS n, any_value(m.m) AS m, greatest(sum(r * pow(v - m.m, 2)) / greatest(any_value(m.n), 1e-10), 1e-6) AS v FROM {p}u{t} u JOIN {p}m{t} m USING (unit, dim) GROUP BY u.unit, dim)")
        parts.append(f"{p}s{t + 1} AS MATERIALIZED (SELECT unit, any_value(n) / (SELECT count(*) FROM {rows}) AS g, list(m ORDER BY dim) AS m, list(v ORDER BY dim) AS v FROM {p}v{t} GROUP BY unit)")
    told = " UNION ALL ".join(f"SELECT {t} AS t, sum(total) / {k} AS ll FROM {p}z{t}" for t in range(steps))
    labels = " UNION ALL ".join(f"SELECT {t} AS t, row_id, max({{'lp': lp, 'unit': unit}}).unit AS label FROM {p}l{t} GROUP BY row_id" for t in range(steps))
    return [
        *parts,
        f"{p}ll AS MATERIALIZED (SELECT t, ll, lag(ll) OVER (ORDER BY t) AS before FROM ({told}))",
        f"{p} AS (SELECT row_id, label FROM ({labels}) WHERE t = (SELECT min(t) FROM {p}ll WHERE abs(ll - before) < 1e-4 * greatest(abs(before), 1)))",
    ]


def internal(rows: str, p: str) -> list[str]:
    """{p}(score, value): the four internal scores of (row_id, label, x)."""
    return [
        f"{p}p AS MATERIALIZED (SELECT a.row_id, a.label, b.label AS l2, sqrt({sq('a.x', 'b.x')}) AS d FROM {rows} a JOIN {rows} b ON a.row_id <> b.row_id)",
        f"{p}s AS (SELECT row_id, label, l2, avg(d) AS m FROM {p}p GROUP BY row_id, label, l2)",
        f"{p}t AS (SELECT row_id, max(m) FILTER (WHERE label = l2) AS a, min(m) FILTER (WHERE label <> l2) AS b FROM {p}s GROUP BY row_id)",
        f"{p}u AS (SELECT label, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {rows}), {p}v AS (SELECT label, dim, avg(v) AS v FROM {p}u GROUP BY label, dim), {p}c AS MATERIALIZED (SELECT label, list(v ORDER BY dim) AS m FROM {p}v GROUP BY label)",
        f"{p}g AS (SELECT list(v ORDER BY dim) AS m FROM (SELECT dim, avg(v) AS v FROM {p}u GROUP BY dim))",
        f"{p}k AS MATERIALIZED (SELECT c.label, count(*) AS n, avg(sqrt({sq('r.x', 'c.m')})) AS s, sum({sq('r.x', 'c.m')}) AS w, any_value(c.m) AS m FROM {rows} r JOIN {p}c c USING (label) GROUP BY c.label)",
        f"{p}d AS (SELECT a.label, max((a.s + b.s) / sqrt({sq('a.m', 'b.m')})) AS r FROM {p}k a JOIN {p}k b ON a.label <> b.label GROUP BY a.label)",
        f"""{p} AS (SELECT 'silhouette' AS score, (SELECT avg(CASE WHEN a IS NULL THEN 1 ELSE (b - a) / greatest(a, b) END) FROM {p}t) AS value
  UNION ALL SELECT 'davies_bouldin', (SELECT avg(r) FROM {p}d) UNION ALL SELECT 'dunn', (SELECT min(d) FILTER (WHERE label <> l2) / max(d) FILTER (WHERE label = l2) FROM {p}p)
  UNION ALL SELECT 'calinski_harabasz', (SELECT (sum(n * {sq('k.m', 'g.m')}) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) FROM {p}k k CROSS JOIN {p}g g))""",
    ]


def by_samples(rows: str, book: str, n: int, epochs: int, rate: float, radius: float, p: str, rule: str = "euclidean", cutoff: bool = True) -> list[str]:
    """{p}(unit, w): a map of n columns trained sample by sample in row order, one row of a recursion a sample; needs WITH RECURSIVE. rule: euclidean, cosine or manhattan."""
    dot = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))".format
    norm = lambda a: f"sqrt(list_sum(list_transform({a}, lambda z: z * z)))"
    away = sq("u", "x") if rule != "cosine" else f"1 - {dot(a='u', b='x')} / {norm('u')} / {norm('x')}"
    grid = GRID_DISTANCE.format(n=n).replace("c.unit", "(i - 1)").replace("a.unit", "bmu")
    h = f"rate * exp(-({grid}) / (2 * s * s))"
    reach = f"greatest(abs((i - 1) // {n} - bmu // {n}), abs((i - 1) % {n} - bmu % {n}))"
    h = f"CASE WHEN {reach} > ceil(3 * s) OR {h} < 1e-8 THEN 0 ELSE {h} END" if cutoff else h
    if rule == "euclidean":
        moved = "list_transform(list_zip(u, x), lambda z: z[1] + hs[i] * (z[2] - z[1]))"
    elif rule == "manhattan":
        moved = "list_transform(list_zip(u, x), lambda z: z[1] + hs[i] * sign(z[2] - z[1]))"
    else:  # toward x at the same length: w + h (|w| x / |x| - w (w x) / (|w| |x|))
        moved = f"list_transform(list_zip(u, x), lambda z: z[1] + hs[i] * ({norm('u')} * z[2] / {norm('x')} - z[1] * {dot(a='u', b='x')} / ({norm('u')} * {norm('x')})))"
    return [
        f"{p}r AS MATERIALIZED (SELECT x, row_number() OVER (ORDER BY row_id) - 1 AS p, count(*) OVER () AS n FROM {rows})",
        f"{p}w(step, n, w) AS (SELECT 0, (SELECT count(*) FROM {rows}), (SELECT list(w ORDER BY unit) FROM {book}) UNION ALL"
        f" SELECT step + 1, n, list_transform(w, lambda u, i: {moved}) FROM (SELECT *, list_transform(w, lambda u, i: {h}) AS hs FROM ("
        f"SELECT *, list_position(ds, list_min(ds)) - 1 AS bmu FROM (SELECT *, list_transform(w, lambda u: {away}) AS ds FROM ("
        f"SELECT o.step, o.n, o.w, r.x, {rate} * exp(-5 * o.step / ({epochs}.0 * o.n)) AS rate, {radius} * exp(-3 * o.step / ({epochs}.0 * o.n)) AS s FROM {p}w o JOIN {p}r r ON r.p = o.step % o.n WHERE o.step < {epochs} * o.n)))))",
        f"{p} AS MATERIALIZED (SELECT generate_subscripts(w, 1) - 1 AS unit, unnest(w) AS w FROM (SELECT w FROM {p}w ORDER BY step DESC LIMIT 1))",
    ]


def spread_units(book: str, hits: str, start: int, k: int, p: str) -> list[str]:
    """{p}(unit, w): of the units of `book`, the one of the `start`-th most hits and then each time the first of the largest (hits + 0.5) * squared distance to those chosen."""
    parts = [
        f"{p}c0 AS MATERIALIZED (SELECT b.unit, b.w FROM {book} b JOIN {hits} h USING (unit) ORDER BY h.hits DESC, b.unit LIMIT 1 OFFSET {start})",
        f"{p}m0 AS MATERIALIZED (SELECT b.unit, b.w, h.hits + 0.5 AS weight, {sq('b.w', f'{p}c0.w')} AS d FROM {book} b JOIN {hits} h USING (unit) CROSS JOIN {p}c0)",
    ]
    for i in range(1, k):
        taken = " UNION ALL ".join(f"SELECT unit FROM {p}c{j}" for j in range(i))
        parts.append(f"{p}c{i} AS MATERIALIZED (SELECT unit, w FROM {p}m{i - 1} WHERE unit NOT IN ({taken}) ORDER BY weight * d DESC, unit LIMIT 1)")
        parts.append(f"{p}m{i} AS MATERIALIZED (SELECT m.unit, m.w, m.weight, least(m.d, {sq('m.w', f'{p}c{i}.w')}) AS d FROM {p}m{i - 1} m CROSS JOIN {p}c{i})")
    return [*parts, f"{p} AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {i} AS unit, w FROM {p}c{i}' for i in range(k))})"]


def refined(rows: str, book: str, on_units: str, k: int, rest: int, p: str) -> list[str]:
    """{p}(row_id, label): the best of Lloyd's results from six sets of seeds that a map suggests. `on_units`: rows with their units."""
    hits = f"{p}h AS MATERIALIZED (SELECT b.unit, count(z.row_id) AS hits FROM {book} b LEFT JOIN {on_units} z USING (unit) GROUP BY b.unit)"
    units = f"{p}r AS MATERIALIZED (SELECT unit AS row_id, w AS x FROM {book})"
    seeds = [f"{p}m", f"{p}f", f"{p}x0", f"{p}x1", f"{p}x2", f"{p}e"]
    through = [
        assigned(f"{p}r", f"{p}l", f"{p}z"),
        f"{p}y AS (SELECT c, dim, avg(v) AS v FROM (SELECT y.unit AS c, unnest(z.x) AS v, generate_subscripts(z.x, 1) AS dim FROM {on_units} z JOIN {p}z y ON y.row_id = z.unit) GROUP BY c, dim)",
        f"{p}o AS (SELECT c, dim, sum(g * v) / sum(g) AS v FROM (SELECT y.unit AS c, greatest(h.hits, 0.5) AS g, unnest(y.x) AS v, generate_subscripts(y.x, 1) AS dim FROM {p}z y JOIN {p}h h ON h.unit = y.row_id) GROUP BY c, dim)",
        f"{p}m AS MATERIALIZED (SELECT o.c AS unit, list(coalesce(y.v, o.v) ORDER BY dim) AS w FROM {p}o o LEFT JOIN {p}y y USING (c, dim) GROUP BY o.c)",
    ]
    parts = [hits, units, *farthest(f"{p}r", k, f"{p}f"), *lloyd(f"{p}r", f"{p}f", rest, f"{p}l"), *through, *farthest(rows, k, f"{p}e")]
    for i in range(3):
        parts += spread_units(book, f"{p}h", i, k, f"{p}x{i}")
    for i, seed in enumerate(seeds):
        parts += [*lloyd(rows, seed, rest, f"{p}q{i}"), assigned(rows, f"{p}q{i}", f"{p}a{i}")]
    every = " UNION ALL ".join(f"SELECT {i} AS i, row_id, x, unit, d2 FROM {p}a{i}" for i in range(len(seeds)))
    return [
        *parts,
        f"{p}all AS MATERIALIZED ({every})",
        f"{p}s AS (SELECT i, unit, dim, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM (SELECT i, unit, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM {p}all) GROUP BY i, unit, dim)",
        f"{p}w AS (SELECT i, count(DISTINCT unit) AS k, sum(q) - sum(s * s / n) AS within FROM {p}s GROUP BY i)",
        f"{p}t AS (SELECT i, sum(q) - sum(s * s / n) AS spread, any_value(n) AS n FROM (SELECT i, dim, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM {p}s GROUP BY i, dim) GROUP BY i)",
        f"{p}i AS (SELECT i, sum(d2) AS inertia FROM {p}all GROUP BY i)",
        f"{p}best AS (SELECT i FROM {p}i JOIN {p}w USING (i) JOIN {p}t USING (i) WHERE inertia <= 1.05 * (SELECT min(inertia) FROM {p}i) ORDER BY round(((spread - within) / (k - 1)) / (within / (n - k)), 6) DESC, i LIMIT 1)",
        f"{p} AS (SELECT row_id, unit AS label FROM {p}all WHERE i = (SELECT i FROM {p}best))",
    ]
