"""SQL building blocks used by several checks."""


def pchip_knots(source, keys, x, y):
    """CTEs p1..pk: knots of `source` with derivative d and the next knot (x1, y1, d1)."""
    part = f"PARTITION BY {keys} ORDER BY {x}"
    return f"""
p1 AS (SELECT {keys}, {x} AS x, {y} AS y, lead({x}) OVER W - {x} AS hr, {x} - lag({x}) OVER W AS hl,
  (lead({y}) OVER W - {y})/(lead({x}) OVER W - {x}) AS dr, ({y} - lag({y}) OVER W)/({x} - lag({x}) OVER W) AS dl
  FROM {source} WINDOW W AS ({part})),
p2 AS (SELECT *, lead(hr) OVER V AS nh, lead(dr) OVER V AS nd, lag(hl) OVER V AS ph, lag(dl) OVER V AS pd FROM p1 WINDOW V AS (PARTITION BY {keys} ORDER BY x)),
p3 AS (SELECT *, ((2*hr+nh)*dr - hr*nd)/(hr+nh) AS ef, ((2*hl+ph)*dl - hl*pd)/(hl+ph) AS el FROM p2),
p4 AS (SELECT *, CASE WHEN hl IS NULL AND hr IS NULL THEN CAST(0 AS DOUBLE)
  WHEN hl IS NULL THEN CASE WHEN nh IS NULL THEN dr WHEN sign(ef) <> sign(dr) THEN 0 WHEN sign(dr) <> sign(nd) AND abs(ef) > 3*abs(dr) THEN 3*dr ELSE ef END
  WHEN hr IS NULL THEN CASE WHEN ph IS NULL THEN dl WHEN sign(el) <> sign(dl) THEN 0 WHEN sign(dl) <> sign(pd) AND abs(el) > 3*abs(dl) THEN 3*dl ELSE el END
  WHEN sign(dl)*sign(dr) <= 0 THEN 0
  ELSE (3*hl+3*hr)/((2*hr+hl)/dl + (2*hl+hr)/dr) END AS d FROM p3),
pk AS (SELECT {keys}, x, y, d, lead(x) OVER V AS x1, lead(y) OVER V AS y1, lead(d) OVER V AS d1, row_number() OVER V AS kn,
  count(*) OVER (PARTITION BY {keys}) AS kc FROM p4 WINDOW V AS (PARTITION BY {keys} ORDER BY x))
"""


def hermite(at, x="x", y="y", d="d", x1="x1", y1="y1", d1="d1"):
    h, t = f"({x1}-{x})", f"(({at}-{x})/({x1}-{x}))"
    return (
        f"((2*{t}*{t}*{t} - 3*{t}*{t} + 1)*{y} + ({t}*{t}*{t} - 2*{t}*{t} + {t})*{h}*{d}"
        f" + (3*{t}*{t} - 2*{t}*{t}*{t})*{y1} + ({t}*{t}*{t} - {t}*{t})*{h}*{d1})"
    )
