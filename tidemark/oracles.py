"""DuckDB SQL with the results of the registered queries, written from the definitions of the functions."""

from __future__ import annotations

OBS = "obs AS (SELECT event_id, user_id, event_type, concat('events.', event_type) AS metric, epoch_us(ts) // 1000000 AS ts, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
SHIP = "obs AS (SELECT concat('ship.', l_returnflag) AS metric, epoch_us(l_shipdate) // 1000000 AS ts, CAST(round(l_extendedprice * 100) AS BIGINT) AS v FROM lineitem)"
FIVE = ("click", "error", "purchase", "signup", "view")


def _series(metric: str, where: str = "true", width: int = 3600) -> str:
    return f"SELECT ts // 3600 * 3600 AS s, ts // 3600 * 3600 + {width} AS e, v, 1 AS w FROM obs WHERE metric = '{metric}' AND ({where})"


def _merged(rows: str, key: str) -> str:
    """Rows (s, e, v, w) whose windows with equal keys span one window."""
    return f"SELECT min(s) OVER (PARTITION BY {key}) AS s, max(e) OVER (PARTITION BY {key}) AS e, v, w FROM ({rows})"


def _islands(rows: str) -> str:
    return f"""
SELECT i.s, i.e, r.v, r.w FROM ({rows}) r JOIN (
  SELECT s0, e0, min(s0) OVER (PARTITION BY g) AS s, max(e0) OVER (PARTITION BY g) AS e FROM (
    SELECT s0, e0, sum(opens) OVER (ORDER BY s0, e0 ROWS UNBOUNDED PRECEDING) AS g FROM (
      SELECT s0, e0, CASE WHEN s0 >= max(e0) OVER (ORDER BY s0, e0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS opens
      FROM (SELECT DISTINCT s AS s0, e AS e0 FROM ({rows}))))) i ON r.s = i.s0 AND r.e = i.e0"""


def _ranks(rows: str, phis: list[float], keys: str = "s, e", point: bool = False) -> str:
    """Quantile rows of (keys, v, w). Columns keys, k, phi, n, approx, lower, upper."""
    given = ", ".join(f"({k}, CAST({p!r} AS DOUBLE))" for k, p in enumerate(phis))
    bounds = "max(a) AS lower, max(a) AS upper" if point else (
        "coalesce(max(CASE WHEN hi + err < t THEN v END), min(v)) AS lower, coalesce(min(CASE WHEN v > a AND lo >= err AND lo - err < t THEN v END), max(v)) AS upper"
    )
    return f"""
SELECT {keys}, k, phi, CAST(max(n) AS BIGINT) AS n, max(a) AS approx, {bounds} FROM (
  SELECT *, max(CASE WHEN lo <= t AND hi >= t THEN v END) OVER (PARTITION BY {keys}, k) AS a FROM (
    SELECT *, CAST(floor(CAST(n AS DOUBLE) * phi) AS BIGINT) AS t, CAST(ceil(CAST(n AS FLOAT) * CAST(0.015 AS FLOAT)) AS BIGINT) AS err FROM (
      SELECT *, sum(w) OVER (PARTITION BY {keys} ORDER BY v ROWS UNBOUNDED PRECEDING) - w AS lo,
             sum(w) OVER (PARTITION BY {keys} ORDER BY v ROWS UNBOUNDED PRECEDING) - 1 AS hi, sum(w) OVER (PARTITION BY {keys}) AS n
      FROM (SELECT {keys}, v, sum(w) AS w FROM ({rows}) GROUP BY {keys}, v)) CROSS JOIN (VALUES {given}) p(k, phi)))
GROUP BY {keys}, k, phi"""


def _quantile(rows: str, phis: list[float], obs: str = OBS, point: bool = False) -> str:
    return f"WITH {obs} SELECT s AS window_start, e AS window_end, phi, n AS count, approx, lower, upper FROM ({_ranks(rows, phis, point=point)})"


def _summary(rows: str) -> str:
    return f"WITH {OBS} SELECT s AS window_start, e AS window_end, count(*) AS n, min(v) AS vmin, max(v) AS vmax FROM ({rows}) GROUP BY s, e"


def _search(like: str) -> str:
    return f"WITH {OBS} SELECT DISTINCT metric FROM obs WHERE metric LIKE '{like}' ESCAPE '!'"


CLICK, VIEW, SIGNUP = _series("events.click"), _series("events.view"), _series("events.signup")
TENS = "w AS (SELECT metric, ts // 10 * 10 AS s, ts // 10 * 10 + 10 AS e, count(*) AS n FROM obs GROUP BY ALL)"


def _tiers(now: int) -> str:
    return f"""{TENS}, a AS (SELECT *, {now} - s AS age, CASE WHEN {now} - s < 300 THEN 1 WHEN {now} - s < 86400 THEN 10 WHEN {now} - s < 604800 THEN 60
  WHEN {now} - s < 2419200 THEN 600 WHEN {now} - s < 31536000 THEN 3600 END AS size FROM w),
b AS (SELECT metric, s, e, n, CASE WHEN age < 0 THEN s WHEN size IS NULL THEN s ELSE s // size * size END AS ns,
  CASE WHEN age < 0 OR size IS NULL THEN e ELSE greatest(s // size * size + size, e) END AS ne, age >= 0 AND size IS NULL AS gone FROM a)"""


def _downsampled(now: int) -> str:
    return f"WITH {OBS}, {_tiers(now)} SELECT metric, ns AS window_start, max(ne) AS window_end, CAST(sum(n) AS BIGINT) AS n FROM b WHERE NOT gone GROUP BY metric, ns"


WINDOWIZED = f"WITH {OBS} SELECT metric, ts // 10 * 10 AS window_start, ts // 10 * 10 + 10 AS window_end, count(*) AS n, min(v) AS vmin, max(v) AS vmax FROM obs GROUP BY ALL"
LINES = """l AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN concat(metric, ':', v, '|ms|@0.1') WHEN 1 THEN concat(metric, ':', v, '|c') WHEN 2 THEN concat('.', metric, ':', v, '|ms')
  WHEN 3 THEN concat(metric, ':4294967296|ms') WHEN 4 THEN concat(metric, ':', v, '|ms|@1') ELSE concat(metric, ':', v, '|ms') END AS line FROM obs)"""
DAEMONS = """d AS (SELECT concat('d', user_id % 2) AS daemon, metric, ts, ts // 3600 * 3600 AS s FROM obs),
c AS (SELECT daemon, s, s + 3600 AS e, row_number() OVER (PARTITION BY daemon ORDER BY s) AS i FROM (SELECT DISTINCT daemon, s FROM d)),
t AS (SELECT *, coalesce(sum(CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY daemon ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM c),
f AS (SELECT daemon, g, coalesce(lag(max(e)) OVER (PARTITION BY daemon ORDER BY g), min(s)) AS ws, max(e) AS we FROM t GROUP BY daemon, g HAVING max(i % 3 = 0))"""


def _kll(obs_count: str = "count(*)") -> str:
    return f"WITH {SHIP} SELECT metric, phi, {obs_count} AS count, true AS within FROM obs CROSS JOIN (VALUES (CAST(0.1 AS DOUBLE)), (CAST(0.5 AS DOUBLE)), (CAST(0.9 AS DOUBLE))) p(phi) GROUP BY metric, phi"


ALL_ROWS = "SELECT 0 AS s, 1 AS e, v, 1 AS w FROM obs"
ERRORS = "CASE WHEN er <= lo THEN (lo - er) / CAST(n AS DOUBLE) WHEN er >= hi THEN (er - hi) / CAST(n AS DOUBLE) ELSE 0.0::DOUBLE END"

CIRCUIT = (
    f"WITH {OBS}, {DAEMONS} SELECT d.daemon, metric, ws AS window_start, we AS window_end, count(*) AS n FROM d JOIN t ON d.daemon = t.daemon AND d.s = t.s "
    "JOIN f ON t.daemon = f.daemon AND t.g = f.g GROUP BY ALL"
)
DAYS = _merged(CLICK, "s // 86400")
ENCODED = (
    f"WITH {OBS}, r AS (SELECT metric, ts // 3600 * 3600 AS s, v - coalesce(lag(v) OVER (PARTITION BY metric, ts // 3600 ORDER BY v), 0) AS d, row_number() OVER (PARTITION BY metric, ts // 3600 ORDER BY v) AS k, "
    "count(*) OVER (PARTITION BY metric, ts // 3600) AS n FROM obs) SELECT metric, s AS window_start, CAST(8 + max(n) // 4 + sum(CASE WHEN k > n // 4 * 4 THEN 4 WHEN d < 256 THEN 1 WHEN d < 65536 THEN 2 WHEN d < 16777216 THEN 3 ELSE 4 END) AS BIGINT) AS bytes{more} FROM r GROUP BY metric, s"
)
INTERVALS = (
    f"WITH RECURSIVE {OBS}, o(report, k, ts) AS (SELECT event_type, 0, min(ts) FROM obs GROUP BY event_type UNION ALL "
    "SELECT report, k + 1, (SELECT min(b.ts) FROM obs b WHERE b.event_type = report AND b.ts >= o.ts + 5000) FROM o WHERE ts IS NOT NULL), "
    "i AS (SELECT report, k, ts AS a, lead(ts) OVER (PARTITION BY report ORDER BY k) AS b FROM o WHERE ts IS NOT NULL) "
)


def _kll_by_day(rows: str, phis: tuple[float, ...]) -> str:
    given = ", ".join(f"(CAST({p!r} AS DOUBLE))" for p in phis)
    return f"WITH {OBS} SELECT s AS window_start, e AS window_end, phi, count(*) AS count, true AS within FROM ({rows}) CROSS JOIN (VALUES {given}) p(phi) GROUP BY s, e, phi"


SQL: dict[str, str] = {
    "fetch_all": _summary(CLICK),
    "fetch_from": _summary(_series("events.click", "ts // 3600 * 3600 >= 1705000000")),
    "fetch_range": _summary(_series("events.click", "ts // 3600 * 3600 >= 1705000000 AND ts // 3600 * 3600 < 1705500000")),
    "fetch_missing": _summary(_series("events.none")),
    "search_all": _search("%"),
    "search_prefix": _search("events.c%"),
    "search_infix": _search("%.%r%"),
    "search_exact": _search("events.view"),
    "search_underscore_literal": _search("events!_%"),
    "quantile_median": _quantile(CLICK, [0.5]),
    "quantile_multi": _quantile(CLICK, [0.1, 0.5, 0.9]),
    "quantile_bounds_rank": _quantile(_merged(_series("ship.A"), "true"), [0.1, 0.5, 0.9], SHIP),
    "quantile_bounds_point": _quantile(CLICK, [0.25], point=True),
    "quantile_dup_phi": _quantile(CLICK, [0.5, 0.5]),
    "group_seconds": _quantile(CLICK, [0.5]),
    "group_hours": _quantile(_merged(CLICK, "s // 3600"), [0.5]),
    "group_days": _quantile(_merged(CLICK, "s // 86400"), [0.29]),
    "coalesce_all": _quantile(_merged(CLICK, "true"), [0.1, 0.5, 0.9]),
    "coalesce_idempotent": _quantile(_merged(CLICK, "true"), [0.5]),
    "coalesce_empty": _quantile(_series("events.none"), [0.5]),
    "combine_two": _quantile(_islands(f"{CLICK} UNION ALL {VIEW}"), [0.5]),
    "combine_self_doubles": _quantile(_islands(f"{CLICK} UNION ALL {CLICK}"), [0.5]),
    "combine_overlap": _quantile(_islands(f"{_series('events.click', width=5400)} UNION ALL {_series('events.signup', width=5400)}"), [0.5]),
    "combine_five": _quantile(_islands(" UNION ALL ".join(_series(f"events.{n}") for n in FIVE)), [0.5]),
    "combine_none": _quantile(_series("none"), [0.5]),
    "overlap_islands": f"""WITH {OBS}, w AS (SELECT DISTINCT ts // 600 * 600 AS s, ts // 600 * 600 + 600 + user_id % 5 * 300 AS e FROM obs),
a AS (SELECT *, CASE WHEN s >= max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM w),
b AS (SELECT *, sum(o) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT s AS window_start, e AS window_end, min(s) OVER (PARTITION BY g) AS island FROM b""",
    "pipeline_combine_group_quantile": _quantile(_merged(_islands(f"{CLICK} UNION ALL {VIEW}"), "s // 86400"), [0.1, 0.9]),
    "pipeline_group_coalesce": _quantile(_merged(_merged(VIEW, "s // 3600"), "true"), [0.5]),
    "windowize_10s": WINDOWIZED,
    "stream_windowize": WINDOWIZED,
    "statsd_parse": f"WITH {OBS}, {LINES} SELECT event_id, regexp_extract(line, '^([^:]*):', 1) AS metric, CAST(regexp_extract(line, ':([0-9]+)', 1) AS BIGINT) AS value FROM l "
    "WHERE regexp_full_match(line, '[a-zA-Z][a-zA-Z0-9._-]*:[0-9]+[|]ms([|]@[0-9]+[.][0-9]+)?') AND CAST(regexp_extract(line, ':([0-9]+)', 1) AS BIGINT) <= 4294967295",
    "metric_name_valid": "SELECT event_id, n AS name, regexp_full_match(n, '[a-zA-Z][a-zA-Z0-9._-]*') AS valid FROM (SELECT event_id, concat(CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '1' "
    "WHEN 2 THEN '.' WHEN 3 THEN 'a&' WHEN 4 THEN 'us-west.' ELSE 'env_' END, event_type) AS n FROM events)",
    "time_functions": f"WITH {OBS} SELECT event_id, ts // 3600 AS hours, ts // 86400 AS days, ts // 30 * 30 AS window_start, CAST(45 AS BIGINT) AS duration, "
    "ts // 30 * 30 < ts // 60 * 60 + 30 AND ts // 60 * 60 < ts // 30 * 30 + 45 AS overlaps, NOT (ts // 30 * 30 < ts // 60 * 60 + 30 AND ts // 60 * 60 < ts // 30 * 30 + 45) AS disjoint FROM obs",
    "window_tracker": f"WITH {OBS}, d AS (SELECT DISTINCT concat('d', user_id % 2) AS daemon, ts AS now FROM obs), p AS (SELECT *, lag(now) OVER (PARTITION BY daemon ORDER BY now) // 30 * 30 AS s FROM d) "
    "SELECT daemon, now, s AS window_start, s + 30 AS window_end FROM p WHERE s < now // 30 * 30",
    "circuit_widening": CIRCUIT,
    "insert_merge": f"WITH {OBS} SELECT metric, ts // 3600 * 3600 AS window_start, max(ts // 3600 * 3600 + CASE WHEN event_id % 2 = 0 THEN 3600 ELSE 7200 END) AS window_end, count(*) AS n, min(v) AS vmin, max(v) AS vmax FROM obs GROUP BY metric, ts // 3600",
    "downsample_plan": f"WITH {OBS}, {_tiers(1706659200)} SELECT metric, s AS window_start, e AS window_end, CASE WHEN gone THEN 'discard' WHEN ns = s AND ne = e THEN 'ignore' ELSE 'expand' END AS action, ns AS new_start, ne AS new_end FROM b",
    "downsample_tiers": _downsampled(1706659200),
    "downsample_retention": _downsampled(1735689600),
    "downsample_then_quantile": f"WITH {OBS}, {_tiers(1706659200)}, r AS (SELECT b.ns AS s, max(b.ne) OVER (PARTITION BY b.ns) AS e, o.v, 1 AS w FROM b JOIN obs o ON o.metric = b.metric AND o.ts // 10 * 10 = b.s "
    f"WHERE b.metric = 'events.click' AND NOT gone) SELECT s AS window_start, e AS window_end, phi, n AS count, approx, lower, upper FROM ({_ranks('SELECT * FROM r', [0.5])})",
    "weighted_quantile": "WITH r AS (SELECT l_returnflag AS flag, CAST(round(l_extendedprice) AS BIGINT) AS v, CAST(l_quantity AS BIGINT) AS w FROM lineitem) "
    f"SELECT flag, phi, n AS count, approx, lower, upper FROM ({_ranks('SELECT * FROM r', [0.1, 0.5, 0.9], 'flag')})",
    "partition_and_merge": f"WITH {OBS} SELECT phi, n AS count, approx, lower, upper FROM ({_ranks(ALL_ROWS, [0.1, 0.5, 0.9])})",
    "rank_error": f"WITH {OBS}, r AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY metric) AS n FROM obs), "
    "p AS (SELECT metric, v FROM r WHERE k = CAST(floor(n * CAST(0.45 AS DOUBLE)) AS BIGINT)), "
    "x AS (SELECT metric, v, min(k) AS lo, max(k) AS hi, max(n) AS n, CAST(floor(max(n) * CAST(0.5 AS DOUBLE)) AS BIGINT) AS er FROM r JOIN p USING (metric, v) GROUP BY metric, v) "
    f"SELECT metric, CAST(0.5 AS DOUBLE) AS phi, v AS approx, {ERRORS} AS error FROM x",
    "error_summary": f"WITH {OBS}, q AS ({_ranks(ALL_ROWS, [k / 10 for k in range(1, 10)])}), r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM obs), "
    "x AS (SELECT phi, approx, lower, upper, min(r.k) AS lo, max(r.k) AS hi, max(r.n) AS n, CAST(floor(max(r.n) * phi) AS BIGINT) AS er FROM q JOIN r ON q.approx = r.v GROUP BY phi, approx, lower, upper) "
    f"SELECT phi, approx, lower, upper, {ERRORS} AS error FROM x",
    "stat_summary": f"WITH {OBS}, r AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY metric) AS n FROM obs) "
    "SELECT metric, max(n) AS sample_count, max(CASE WHEN k = CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT) THEN v END) AS median, "
    "max(CASE WHEN k = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN v END) AS p95, min(v) AS min, max(v) AS max FROM r GROUP BY metric",
    "rate_tracker": f"WITH {OBS} SELECT metric, count(*) / CAST(greatest(max(ts) - min(ts), 1) AS DOUBLE) AS rate FROM obs GROUP BY metric",
    "count_tracker": f"WITH {OBS}, g AS (SELECT i AS interval_start, name FROM range(1704067200, 1706659200, 3600) t(i), (VALUES {', '.join(f"('{n}')" for n in (*FIVE, 'none'))}) v(name)) "
    "SELECT interval_start, name, count(event_id) AS count FROM g LEFT JOIN obs ON event_type = name AND ts // 3600 * 3600 = interval_start GROUP BY ALL",
    "latency_match": f"WITH {OBS}, e AS (SELECT user_id AS u, user_id % 4 AS q, ts, event_type = 'click' AS sent, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) "
    "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM obs WHERE event_type IN ('click', 'purchase')), "
    "d AS (SELECT q, min(ts) FILTER (NOT sent) - min(ts) FILTER (sent) AS v FROM e WHERE g > 0 GROUP BY u, q, g HAVING count(*) FILTER (NOT sent) > 0), "
    "r AS (SELECT q, v, row_number() OVER (PARTITION BY q ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY q) AS n FROM d) "
    "SELECT q AS query_id, max(n) AS sample_count, max(CASE WHEN k = CAST(floor(n * CAST(0.5 AS DOUBLE)) AS BIGINT) THEN v END) AS median, "
    "max(CASE WHEN k = CAST(floor(n * CAST(0.95 AS DOUBLE)) AS BIGINT) THEN v END) AS p95, min(v) AS min, max(v) AS max FROM r GROUP BY q",
    "report_intervals": INTERVALS + "SELECT report, CAST(k AS BIGINT) AS interval, count(*) AS n, CAST(min(obs.ts) AS DOUBLE) AS first_ts FROM i JOIN obs ON event_type = report AND obs.ts >= a AND obs.ts < b GROUP BY report, k",
    "encoded_size": ENCODED.replace("{more}", ""),
    "exact_size": f"WITH {OBS} SELECT metric, ts // 3600 * 3600 AS window_start, count(DISTINCT v) AS stored FROM obs GROUP BY metric, ts // 3600",
    "format_lines": f"WITH {OBS} SELECT concat('start=', s, ', end=', e, ', phi=', CASE k WHEN 0 THEN '0.5' ELSE '0.9' END, ', count=', n, ', approx=', approx, ', lower=', lower, ', upper=', upper) AS line "
    f"FROM ({_ranks(_merged(CLICK, 's // 86400'), [0.5, 0.9])})",
    "kll_quantile": _kll(),
    "kll_merge": _kll(),
    "kll_size": f"WITH {OBS} SELECT ts // 3600 * 3600 AS window_start, count(*) AS n, true AS bounded FROM obs WHERE metric = 'events.click' GROUP BY ts // 3600",
    "kll_group": _kll_by_day(DAYS, (0.1, 0.5, 0.9)),
    "kll_combine": _kll_by_day(_merged(_islands(f"{CLICK} UNION ALL {VIEW}"), "s // 86400"), (0.1, 0.9)),
    "kll_downsample": _downsampled(1706659200),
    "kll_readable": f"WITH {OBS} SELECT s AS window_start, e AS window_end, count(*) AS n, max(v) > min(v) AS spread FROM ({DAYS}) GROUP BY s, e",
    "exact_readable": f"WITH {OBS} SELECT s AS window_start, e AS window_end, v AS value, count(*) AS weight FROM ({DAYS}) GROUP BY s, e, v",
    "fetch_u64_bounds": _quantile(CLICK, [0.5]),
    "fetch_beyond": _quantile(_series("events.none"), [0.5]),
    "stream_late": WINDOWIZED,
    "stream_append_exact": f"WITH {OBS} SELECT metric, ts // 3600 * 3600 AS window_start, ts // 3600 * 3600 + 3600 AS window_end, count(*) AS n, min(v) AS vmin, max(v) AS vmax FROM obs "
    "GROUP BY metric, ts // 3600 HAVING ts // 3600 * 3600 + 3600 <= (SELECT max(ts) - 30 FROM obs)",
    "stream_circuit": CIRCUIT,
    "store_replay": f"WITH {OBS.replace('FROM events)', 'FROM events WHERE event_id % 2 = 0)')}, {_tiers(1706659200)}, "
    f"x AS (SELECT metric, ns AS s, ne AS e, n FROM b WHERE NOT gone UNION ALL SELECT metric, s, s + 10, count(*) FROM (SELECT concat('events.', event_type) AS metric, epoch_us(ts) // 10000000 * 10 AS s FROM events WHERE event_id % 2 = 1) GROUP BY ALL) "
    "SELECT metric, s AS window_start, max(e) AS window_end, CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY metric, s",
    "number_file": f"WITH {OBS} SELECT v AS value FROM obs",
    "insert_spec_file": f"WITH {OBS} SELECT metric AS name, count(*) AS count FROM obs GROUP BY metric",
    "synthetic_windows": f"WITH {OBS}, c AS (SELECT metric, count(*) AS n FROM obs GROUP BY metric), i AS (SELECT metric, unnest(range(n)) AS i FROM c), s AS (SELECT metric, 1000000 + i * 30 AS t FROM i) "
    "SELECT metric, t // 10 * 10 AS window_start, t // 10 * 10 + 10 AS window_end, CAST(5 AS BIGINT) AS n, true AS bounded FROM s",
    "query_file": f"{_quantile(CLICK, [0.5])} UNION ALL ({_quantile(VIEW, [0.5])})",
    "load_report": INTERVALS + "SELECT report AS kind, CAST(k AS BIGINT) AS interval, count(*) AS n, count(*) / CAST(greatest(max(obs.ts) - min(obs.ts), 1) AS DOUBLE) AS rate FROM i JOIN obs ON event_type = report AND obs.ts >= a AND obs.ts < b GROUP BY report, k",
    "codec_roundtrip": ENCODED.replace("{more}", ", true AS same"),
}
