"""DuckDB text shared by the SQL of several queries."""

from __future__ import annotations

import math

AIS = """ais0 AS (SELECT event_id AS ordinal, user_id AS mmsi, 1704067200.0::DOUBLE + (epoch_us(ts) / 1e6 - 1704067200.0::DOUBLE) / 60 AS t, value FROM events),
ais1 AS (SELECT *, (t - 1704067200.0::DOUBLE) / 3600 AS hours FROM ais0),
ais AS (SELECT mmsi, ordinal, t,
  18.5::DOUBLE + (mmsi % 20) * 0.05::DOUBLE + CASE WHEN mmsi % 5 = 0 THEN 0 WHEN mmsi % 7 = 0 THEN ((ordinal * 37) % 400) / 200.0::DOUBLE ELSE ((mmsi % 11) - 5) * 0.02::DOUBLE * hours END AS lat,
  71.5::DOUBLE + (mmsi % 17) * 0.05::DOUBLE + CASE WHEN mmsi % 5 = 0 THEN 0 WHEN mmsi % 7 = 0 THEN ((ordinal * 53) % 400) / 200.0::DOUBLE ELSE ((mmsi % 13) - 6) * 0.02::DOUBLE * hours END AS lon,
  value - 30 * floor(value / 30) AS speed FROM ais1)"""

SEG = """seg0 AS (SELECT *, lag(t) OVER w AS p_t, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lag(speed) OVER w AS p_speed, row_number() OVER w AS rn
  FROM ais WINDOW w AS (PARTITION BY mmsi ORDER BY t, ordinal)),
seg AS (SELECT *, t - p_t AS dt FROM seg0 WHERE p_t IS NOT NULL)"""

PARTICLES = """particles AS (SELECT vec_id AS particle_id, 18.8::DOUBLE + 0.4::DOUBLE * (vec_id * 0.6180339887::DOUBLE - floor(vec_id * 0.6180339887::DOUBLE)) AS lat,
  71.8::DOUBLE + 0.4::DOUBLE * (vec_id * 0.7548776662::DOUBLE - floor(vec_id * 0.7548776662::DOUBLE)) AS lon, 1704067200.0::DOUBLE + 3600 * (vec_id % 12) AS t FROM embeddings)"""

HOURS = """hours AS (SELECT epoch_us(ts) // 3600000000 AS hour, * FROM events),
wind AS (SELECT hour, avg(value) AS wind, (sum(event_id % 360) % 360)::DOUBLE AS wind_from FROM hours WHERE event_type = 'view' GROUP BY 1),
curr AS (SELECT hour, avg(value) AS current, (sum(event_id % 360) % 360)::DOUBLE AS current_to FROM hours WHERE event_type = 'click' GROUP BY 1)"""

PIXELS = """px0 AS (SELECT vec_id AS scene, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings),
px AS (SELECT scene, label, (k // 8)::INT AS y, (k % 8)::INT AS x, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + v::DOUBLE)) AS p FROM px0)"""


def wrap(x: str) -> str:
    return f"(((({x}) + 180.0::DOUBLE) % 360 + 360) % 360 - 180)"


def hav(a: str, b: str, c: str, d: str) -> str:
    up, across = f"radians(({c}) - ({a})) / 2", f"radians({wrap(f'({d}) - ({b})')}) / 2"
    return f"(2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(sin({up}) * sin({up}) + cos(radians({a})) * cos(radians({c})) * sin({across}) * sin({across})))))"


def scenario(k: int) -> str:
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + embedding[{k}]::DOUBLE))"


PARAMETERS = ("duration_scale", "windage_mean", "deflection_deg", "wind_scale", "current_scale")
SCENARIOS = f"scn AS (SELECT vec_id AS scenario, {', '.join(f'{scenario(i + 1)} AS {n}' for i, n in enumerate(PARAMETERS))}, label % 3 AS winner, {scenario(7)} AS posterior FROM embeddings)"
PI = repr(math.pi)
