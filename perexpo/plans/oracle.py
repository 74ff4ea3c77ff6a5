"""SQL equivalents of the registered queries, for checking against another engine.

Each statement is the final select of one query preceded by the shared stages it needs.
They are written for correctness, not for speed or scale: candidates, for instance, come
from all pairs of clusters and sites, which is what the query must agree with.
"""

from __future__ import annotations

import re


def _lat(u: str) -> str:
    return f"(40.5e0 + ({u} * 7919) % 4000 / 1e4)"


def _lon(u: str) -> str:
    return f"(-74.05e0 + ({u} * 104729) % 3000 / 1e4)"


def _site_name(u: str) -> str:
    return f"""CASE {u} % 6
        WHEN 0 THEN {u} || ' St (' || {u} % 9 || ')'
        WHEN 1 THEN {u} || ' Av (' || {u} % 9 || ')'
        WHEN 2 THEN {u} || ' St-Oak Park (' || {u} % 9 || ')'
        WHEN 3 THEN {u} || ' Av/Elm (' || {u} % 9 || ')'
        WHEN 4 THEN 'St. ' || {u} || ' Blvd (' || {u} % 9 || ')'
        ELSE {u} || ' Pkwy' END"""


def _incident_name(u: str) -> str:
    return f"""CASE WHEN {u} % 50 = 49 THEN NULL
        WHEN {u} % 25 = 24 THEN 'DISTRICT ' || {u} || ' OFFICE'
        WHEN {u} % 10 = 3 THEN 'PLAZA ' || {u} % 3
        WHEN {u} % 6 = 0 THEN {u} || ' ST.'
        WHEN {u} % 6 = 1 THEN {u} || ' AVE.'
        WHEN {u} % 12 = 2 THEN {u} || ' ST.-OAK PARK'
        WHEN {u} % 12 = 8 THEN 'OAK PARK-' || {u} || ' ST.'
        WHEN {u} % 6 = 3 THEN 'ELM-' || {u} || ' AVE.'
        WHEN {u} % 6 = 4 THEN 'ST. ' || {u} || ' BLVD.'
        ELSE {u} || ' PKWY.' END"""


def _e5(c: str) -> str:
    return f"CAST(sign({c}) * floor(abs({c}) * 1e5 + 0.5) AS BIGINT)"


def _period(h: str) -> str:
    return f"""CASE WHEN {h} >= 6 AND {h} < 12 THEN 'Morning' WHEN {h} >= 12 AND {h} < 17 THEN 'Afternoon'
        WHEN {h} >= 17 AND {h} < 22 THEN 'Evening' WHEN {h} IS NOT NULL THEN 'Late Night' END"""


def _miles(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"2 * 3959e0 * asin(least(1e0, sqrt(power(sin(radians({lat2} - {lat1}) / 2), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def _bins(c: str, edges: tuple, labels: tuple, op: str, missing: str = "NULL") -> str:
    arms = " ".join(f"WHEN {c} {op} {e} THEN {lab}" for e, lab in zip(edges, labels))
    return f"CASE WHEN {c} IS NULL THEN {missing} {arms} ELSE {labels[-1]} END"


_BASE = "upper(trim(CASE WHEN contains(site_name, '(') THEN split_part(site_name, '(', 1) ELSE '' END))"
_STREET = "CASE WHEN {n} LIKE '% ST' THEN left({n}, -3) || ' STREET' ELSE replace({n}, ' ST-', ' STREET-') END"
_AVENUE = (
    "CASE WHEN {n} LIKE '% AV' THEN left({n}, -3) || ' AVENUE' "
    "ELSE replace(replace({n}, ' AV-', ' AVENUE-'), ' AV/', ' AVENUE/') END"
)
_ABBREV = (
    "replace(replace(replace(CASE WHEN name LIKE 'ST.%' THEN name ELSE replace(name, 'ST.', 'STREET') END, "
    "'AVE.', 'AVENUE'), 'BLVD.', 'BLVD'), 'PKWY.', 'PKWY')"
)
_DIST_EDGES = ("0.05", "0.1", "0.25", "0.5")
_DIST_SHORT = ("'0-0.05'", "'0.05-0.10'", "'0.10-0.25'", "'0.25-0.50'", "'Over 0.50'")
_DIST_LONG = ("'0-0.05 miles'", "'0.05-0.10 miles'", "'0.10-0.25 miles'", "'0.25-0.50 miles'", "'Over 0.50 miles'")
_ORDINALS = ("0", "1", "2", "3", "4")
_INCOME_EDGES = ("50000", "75000", "100000", "150000")
_INCOME = ("'Under $50k'", "'$50k-$75k'", "'$75k-$100k'", "'$100k-$150k'", "'$150k+'")
_SITE_EDGES = ("50000", "100000", "150000", "200000")
_SITE_LABELS = ("'Under 50k'", "'50k-100k'", "'100k-150k'", "'150k-200k'", "'200k+'")
_INSIDE_X = "(e.x2 - e.x1) * (p.lat - e.y1) / (e.y2 - e.y1) + e.x1"

STAGES: dict[str, str] = {
    "s_incidents": f"""SELECT strftime(ts, '%m/%d/%Y') AS dt, CASE WHEN event_id % 97 <> 0 THEN strftime(ts, '%H:%M:%S') END AS tm,
        {_incident_name('user_id')} AS name,
        {_lat('user_id')} + (event_id % 5) * (event_id % 5 + 1) * 5e-4 AS lat,
        {_lon('user_id')} AS lon, CAST(user_id % 12 AS INTEGER) AS district
        FROM events WHERE event_type = 'error'""",
    "s_exposure_raw": f"""SELECT strftime(ts, '%m/%d/%Y %I:%M:%S %p') AS ts, user_id AS site_id,
        {_site_name('user_id')} AS site_name, 'R' || user_id % 5 AS region,
        {_lat('user_id')} AS lat, {_lon('user_id')} AS lon,
        CASE WHEN event_id % 89 = 0 THEN format('{{:,}}', CAST(floor(value * 100) AS BIGINT)) || '.0'
            WHEN event_id % 101 <> 0 THEN format('{{:,}}', CAST(floor(value * 100) AS BIGINT)) END AS exposure
        FROM events WHERE event_type IN ('view', 'purchase')""",
    "s_exposure": """SELECT * REPLACE (CAST(replace(exposure, ',', '') AS BIGINT) AS exposure),
        hour(strptime(ts, '%m/%d/%Y %I:%M:%S %p')) AS h FROM s_exposure_raw""",
    "s_exposure_period": f"""SELECT site_id, site_name, {_period('h')} AS period,
        CAST(sum(exposure) AS BIGINT) AS exposure FROM s_exposure GROUP BY ALL""",
    "s_sites": f"""SELECT s_suppkey AS site_id, {_site_name('s_suppkey')} AS site_name,
        {_lat('s_suppkey')} AS lat, {_lon('s_suppkey')} AS lon FROM supplier""",
    "s_known_lines": """SELECT l_quantity, l_extendedprice, CASE WHEN l_orderkey % 5 <> 0 THEN l_discount END AS l_discount,
        CASE WHEN l_linenumber <> 3 THEN l_tax END AS l_tax, l_linenumber FROM lineitem""",
    "s_band": """SELECT lpad(CAST(z AS VARCHAR), 5, '0') AS zone_id, e.* FROM (SELECT c_custkey // 64 AS z, c_custkey % 64 AS i,
            c_custkey % 64 = 63 OR c_custkey = max(c_custkey) OVER () AS last,
            -74.05e0 - 3.7e-5 + c_custkey // 64 % 6 * 5e-2 AS x0, 40.5e0 - 3.7e-5 + c_custkey // 64 // 6 % 5 * 8e-2 AS y0 FROM customer) c
        CROSS JOIN LATERAL (SELECT x0 + i / 1280e0 AS xa, x0 + (i + 1) / 1280e0 AS xb,
            y0 + 6e-2 + (z * 31 + i * 7919) % 100 / 1e4 AS ua, y0 + 6e-2 + (z * 31 + (i + 1) * 7919) % 100 / 1e4 AS ub,
            y0 + (z * 17 + i * 104729) % 100 / 1e4 AS da, y0 + (z * 17 + (i + 1) * 104729) % 100 / 1e4 AS db,
            y0 + 2e-2 AS low, y0 + 4e-2 AS high, i >= 16 AND i < 48 AS hole) v
        CROSS JOIN LATERAL (SELECT xa AS x1, ua AS y1, xb AS x2, ub AS y2
            UNION ALL SELECT xa, da, xb, db
            UNION ALL SELECT xa, da, xa, ua WHERE i = 0
            UNION ALL SELECT xb, db, xb, ub WHERE last
            UNION ALL SELECT xa, low, xb, low WHERE hole
            UNION ALL SELECT xa, high, xb, high WHERE hole
            UNION ALL SELECT xa, low, xa, high WHERE i = 16
            UNION ALL SELECT xb, low, xb, high WHERE hole AND (last OR i = 47)) e""",
    "s_in_band": f"""SELECT p.site_id, e.zone_id FROM s_sites p CROSS JOIN s_band e GROUP BY ALL
        HAVING count(*) FILTER ((e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < {_INSIDE_X}) % 2 = 1""",
    "s_globe_pairs": f"""SELECT *, {_miles('plat', 'plon', 'lat', 'lon')} AS miles FROM (SELECT c_custkey,
            CASE c_custkey % 16 WHEN 5 THEN 89.5e0 WHEN 13 THEN -90e0 ELSE ((c_custkey * 7919) % 18001 - 9000) / 1e2 END AS plat,
            CASE c_custkey % 16 WHEN 3 THEN 179.99e0 WHEN 11 THEN -179.99e0
                ELSE ((c_custkey * 104729) % 36001 - 18000) / 1e2 END AS plon FROM customer) p
        CROSS JOIN (SELECT s_suppkey AS site_id, ((s_suppkey * 5167) % 18001 - 9000) / 1e2 AS lat,
            ((s_suppkey * 30011) % 36001 - 18000) / 1e2 AS lon FROM supplier) s""",
    "s_corner": """SELECT k, lpad(CAST(k AS VARCHAR), 5, '0') AS zone_id, ring, n, pos,
            -74.05e0 - 3.7e-5 + k % 5 * 6e-2 + dx AS x, 40.5e0 - 3.7e-5 + floor(k / 5) * 8e-2 + dy AS y
        FROM (SELECT n_nationkey AS k FROM nation) z JOIN (VALUES
            (0, 0, 3, 0, 0e0, 0e0), (0, 0, 3, 1, 6e-2, 0e0), (0, 0, 3, 2, 0e0, 8e-2),
            (1, 0, 4, 0, 0e0, 0e0), (1, 0, 4, 1, 6e-2, 0e0), (1, 0, 4, 2, 6e-2, 8e-2), (1, 0, 4, 3, 0e0, 8e-2),
            (1, 1, 4, 0, 2e-2, 2e-2), (1, 1, 4, 1, 4e-2, 2e-2), (1, 1, 4, 2, 4e-2, 6e-2), (1, 1, 4, 3, 2e-2, 6e-2),
            (2, 0, 4, 0, 0e0, 0e0), (2, 0, 4, 1, 6e-2, 0e0), (2, 0, 4, 2, 6e-2, 8e-2), (2, 0, 4, 3, 0e0, 8e-2)
        ) v(kind, ring, n, pos, dx, dy) ON k % 3 = kind""",
    "s_edge": """SELECT a.zone_id, CAST(a.ring * 4 + a.pos AS INTEGER) AS edge_no,
        a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2
        FROM s_corner a JOIN s_corner b ON a.k = b.k AND a.ring = b.ring AND b.pos = (a.pos + 1) % a.n""",
    "s_in_zone": f"""SELECT p.site_id, e.zone_id FROM s_sites p CROSS JOIN s_edge e GROUP BY ALL
        HAVING count(*) FILTER ((e.y1 > p.lat) <> (e.y2 > p.lat) AND p.lon < {_INSIDE_X}) % 2 = 1""",
    "s_site_zone": """SELECT p.*, z.zone_id FROM s_sites p LEFT JOIN s_in_zone z ON p.site_id = z.site_id""",
    "s_attr_raw": """SELECT '1400000US' || lpad(CAST(k AS VARCHAR), 5, '0') AS geo_id, 'Zone ' || k AS name,
            CASE k % 7 WHEN 3 THEN '-' WHEN 5 THEN format('{:,}', v) || '+' ELSE format('{:,}', v) END AS value
        FROM (SELECT c_nationkey AS k, count(*) * 997 % 180000 + 30000 AS v FROM customer GROUP BY 1)
        UNION ALL SELECT 'Geography', 'Geographic Area Name', 'Estimate'""",
    "s_attr": """SELECT replace(geo_id, '1400000US', '') AS zone_id, name, value,
        try_cast(regexp_replace(value, '[,+]', '', 'g') AS DOUBLE) AS attr, value LIKE '%+' AS topcoded
        FROM s_attr_raw WHERE geo_id <> 'Geography'""",
    "s_site_attr": """SELECT s.site_id, s.site_name, s.zone_id, a.attr, a.topcoded
        FROM s_site_zone s LEFT JOIN s_attr a ON s.zone_id = a.zone_id""",
    "s_keyed": f"""SELECT *, {_e5('lat')} AS lat_e5, {_e5('lon')} AS lon_e5,
        {_period('CAST(left(tm, 2) AS INTEGER)')} AS period FROM s_incidents""",
    "s_clusters": "SELECT name, lat_e5, lon_e5, count(*) AS incidents FROM s_keyed GROUP BY ALL",
    "s_dim": "SELECT DISTINCT site_id, site_name, lat, lon FROM s_exposure_raw",
    "s_base": f"SELECT *, {_BASE} AS base_name FROM s_dim",
    "s_street": f"SELECT *, {_STREET.format(n='base_name')} AS street_name FROM s_base",
    "s_site_key": f"SELECT *, {_AVENUE.format(n='street_name')} AS site_key FROM s_street",
    "s_pairs": f"""SELECT c.name, c.lat_e5, c.lon_e5, c.incidents, {_ABBREV} AS name_key,
            s.site_id, s.site_name, s.site_key, c.lat_e5 / 1e5 AS plat, c.lon_e5 / 1e5 AS plon, s.lat, s.lon
        FROM s_clusters c CROSS JOIN s_site_key s""",
    "s_cand": """SELECT name, lat_e5, lon_e5, incidents, name_key, site_id, site_name, site_key,
            2 * 3959e0 * asin(sqrt(power(sin(radians(lat - plat) / 2), 2)
                + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2))) AS distance_miles
        FROM s_pairs QUALIFY row_number() OVER (PARTITION BY name, lat_e5, lon_e5
            ORDER BY (plat - lat) * (plat - lat) + (plon - lon) * (plon - lon), site_id) = 1""",
    "s_decisions": f"""SELECT CAST(1 AS BIGINT) AS seq, name, lat_e5, lon_e5,
            CASE WHEN distance_miles <= 0.25 THEN 'ACCEPT' ELSE 'INVESTIGATE' END AS status,
            CAST(NULL AS BIGINT) AS override_site_id, CAST(NULL AS VARCHAR) AS override_site_name,
            CASE WHEN distance_miles <= 0.25 THEN 'Same place, other spelling'
                ELSE 'Name conflicts with candidate' END AS reason
        FROM s_cand WHERE name IS NOT NULL
        UNION ALL SELECT 2, name, lat_e5, lon_e5, 'ACCEPT', num, {_site_name('num')}, 'Corrected using recorded name'
        FROM (SELECT *, CAST(regexp_extract(name, '[0-9]+') AS BIGINT) AS num FROM s_cand
            WHERE name IS NOT NULL AND distance_miles > 0.25 AND incidents >= 5)""",
    "s_latest": """SELECT * FROM s_decisions
        QUALIFY row_number() OVER (PARTITION BY name, lat_e5, lon_e5 ORDER BY seq DESC) = 1""",
    "s_other": "SELECT * FROM s_cand WHERE name_key <> site_key",
    "s_queue": """SELECT name, lat_e5, lon_e5, incidents, site_name, site_id, distance_miles,
        CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS reason FROM s_other WHERE incidents >= 4""",
    "s_applied": """SELECT q.name, q.lat_e5, q.lon_e5, q.incidents,
            coalesce(d.override_site_name, q.site_name) AS site_name, coalesce(d.override_site_id, q.site_id) AS site_id,
            q.distance_miles, d.status, d.reason
        FROM s_queue q LEFT JOIN s_latest d ON q.name = d.name AND q.lat_e5 = d.lat_e5 AND q.lon_e5 = d.lon_e5""",
    "s_low_batch": """SELECT name, lat_e5, lon_e5, incidents, site_name, site_id, distance_miles, 'ACCEPT' AS status,
        'Clear name match within 0.05 miles' AS reason FROM s_other WHERE incidents < 4 AND distance_miles <= 0.05""",
    "s_reviews": "SELECT * FROM s_applied UNION ALL BY NAME SELECT * FROM s_low_batch",
    "s_accepted": "SELECT * FROM s_reviews WHERE status = 'ACCEPT'",
    "s_valid": """SELECT name, min(site_id) AS validated_id, count(DISTINCT site_id) AS validated_ids
        FROM s_accepted GROUP BY name""",
    "s_triage": """SELECT o.name, o.lat_e5, o.lon_e5, o.incidents, CASE WHEN o.name ILIKE 'DISTRICT % OFFICE'
            THEN 'ADMIN_LOCATION' WHEN v.validated_ids = 1 THEN 'AUTO_ACCEPT_VALIDATED_NAME'
            WHEN v.validated_ids > 1 THEN 'AMBIGUOUS_VALIDATED_NAME' ELSE 'NEEDS_REVIEW' END AS match_status
        FROM s_other o LEFT JOIN s_valid v ON o.name = v.name WHERE o.incidents < 4""",
    "s_exact": """SELECT name, lat_e5, lon_e5, incidents, site_name, site_id, 'EXACT_NAME' AS match_status
        FROM s_cand WHERE name_key = site_key""",
    "s_manual": """SELECT name, lat_e5, lon_e5, incidents, site_name, site_id, 'MANUAL_ACCEPT' AS match_status
        FROM s_accepted r WHERE NOT EXISTS (FROM s_exact f
            WHERE f.name = r.name AND f.lat_e5 = r.lat_e5 AND f.lon_e5 = r.lon_e5)""",
    "s_sure": "SELECT * FROM s_exact UNION ALL SELECT * FROM s_manual",
    "s_auto": """SELECT o.name, o.lat_e5, o.lon_e5, o.incidents, l.site_name, v.validated_id AS site_id,
            'AUTO_ACCEPT_VALIDATED_NAME' AS match_status
        FROM s_other o JOIN s_valid v ON o.name = v.name
        JOIN (SELECT site_id, min(site_name) AS site_name FROM s_dim GROUP BY site_id) l ON v.validated_id = l.site_id
        WHERE v.validated_ids = 1 AND o.incidents < 4 AND o.name NOT ILIKE 'DISTRICT % OFFICE' AND NOT EXISTS (
            FROM s_sure f WHERE f.name = o.name AND f.lat_e5 = o.lat_e5 AND f.lon_e5 = o.lon_e5)""",
    "s_assigned": "SELECT * FROM s_sure UNION ALL SELECT * FROM s_auto",
    "s_rest": """SELECT c.name, c.lat_e5, c.lon_e5, c.incidents, CAST(NULL AS VARCHAR) AS site_name,
            CAST(NULL AS BIGINT) AS site_id, CASE WHEN c.name ILIKE 'DISTRICT % OFFICE' THEN 'ADMIN_LOCATION'
                WHEN v.validated_ids > 1 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS match_status
        FROM s_cand c LEFT JOIN s_valid v ON c.name = v.name WHERE NOT EXISTS (
            FROM s_assigned f WHERE f.name = c.name AND f.lat_e5 = c.lat_e5 AND f.lon_e5 = c.lon_e5)""",
    "s_crosswalk": "SELECT * FROM s_assigned UNION ALL SELECT * FROM s_rest",
    "s_enriched": """SELECT c.*, a.zone_id, a.attr, a.topcoded
        FROM s_crosswalk c LEFT JOIN s_site_attr a ON c.site_id = a.site_id""",
    "s_totals": """SELECT site_id, site_name, CAST(sum(exposure) AS BIGINT) AS exposure
        FROM s_exposure GROUP BY site_id, site_name""",
    "s_matched": """SELECT site_id, CAST(sum(incidents) AS BIGINT) AS incidents FROM s_crosswalk
        WHERE site_id IS NOT NULL GROUP BY site_id""",
    "s_max_attr": "SELECT site_id, max(attr) AS attr FROM s_site_attr GROUP BY site_id",
    "s_metrics": """SELECT t.site_id, t.site_name, coalesce(m.incidents, 0) AS incidents, t.exposure, a.attr,
            coalesce(m.incidents, 0) * 1e5 / nullif(t.exposure, 0) AS rate
        FROM s_totals t LEFT JOIN s_matched m USING (site_id) LEFT JOIN s_max_attr a USING (site_id)""",
    "s_rate_set": "SELECT site_id, site_name, exposure, rate FROM s_metrics WHERE exposure >= 100000",
    "s_attr_set": """SELECT site_id, site_name, attr, exposure, rate FROM s_metrics
        WHERE attr IS NOT NULL AND exposure >= 100000""",
    "s_site_incidents": """SELECT c.site_id, k.period, count(*) AS incidents
        FROM s_keyed k JOIN s_crosswalk c ON k.name = c.name AND k.lat_e5 = c.lat_e5 AND k.lon_e5 = c.lon_e5
        WHERE c.site_id IS NOT NULL GROUP BY ALL""",
    "s_site_period": """SELECT e.site_id, e.site_name, e.period, coalesce(i.incidents, 0) AS incidents, e.exposure,
            a.attr, coalesce(i.incidents, 0) * 1e5 / nullif(e.exposure, 0) AS rate
        FROM s_exposure_period e LEFT JOIN s_site_incidents i ON e.site_id = i.site_id AND e.period = i.period
        LEFT JOIN s_max_attr a ON e.site_id = a.site_id""",
    "s_periods": """SELECT period, i.incidents, e.exposure, i.incidents * 1e5 / nullif(e.exposure, 0) AS rate
        FROM (SELECT period, count(*) AS incidents FROM s_keyed GROUP BY 1) i
        JOIN (SELECT period, CAST(sum(exposure) AS BIGINT) AS exposure FROM s_exposure_period GROUP BY 1) e
        USING (period)""",
    "s_published": f"""SELECT *, {_bins('attr', _INCOME_EDGES, _INCOME, '<', "'Missing'")} AS attr_group
        FROM s_metrics""",
    "s_stable": "SELECT * FROM s_published WHERE attr_group <> 'Missing' AND exposure >= 100000",
    "s_served_periods": """SELECT *, CASE WHEN exposure >= 30000 THEN 'Include' ELSE 'Low Ridership' END AS threshold
        FROM s_site_period""",
    "s_log": "SELECT *, log10(exposure) AS log_exposure FROM s_attr_set",
    "s_fits": """SELECT regr_slope(rate, log_exposure) AS b1, regr_intercept(rate, log_exposure) AS a1,
        regr_slope(rate, attr) AS b2, regr_intercept(rate, attr) AS a2 FROM s_log""",
    "s_residuals": """SELECT site_id, site_name, attr, exposure, rate, log_exposure,
            a1 + b1 * log_exposure AS expected_from_exposure, rate - (a1 + b1 * log_exposure) AS exposure_residual,
            a2 + b2 * attr AS expected_from_attr, rate - (a2 + b2 * attr) AS attr_residual
        FROM s_log CROSS JOIN s_fits""",
}

_TOTAL = "count(*) AS clusters, CAST(sum(incidents) AS BIGINT) AS incidents"


def _reconcile(before: str, m_before: str, after: str, m_after: str, cols: str = "*") -> str:
    return f"""SELECT {cols} FROM (SELECT *, rows_before = rows_after AS rows_equal,
        measure_before = measure_after AS measure_equal FROM
        (SELECT count(*) AS rows_before, CAST(sum({m_before}) AS BIGINT) AS measure_before FROM {before}),
        (SELECT count(*) AS rows_after, CAST(sum({m_after}) AS BIGINT) AS measure_after FROM {after}))"""


def _nulls(cols: list[str], source: str) -> str:
    each = ", ".join(f"count(*) - count({c}) AS null_{c}" for c in cols)
    return f"SELECT count(*) AS row_count, {each} FROM {source}"


def _rank(col: str, source: str) -> str:
    """Average rank of ties from the lowest rank and the number of peers."""
    return (
        f"SELECT *, rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2 AS r "
        f"FROM {source}"
    )


def _spearman(x: str, y: str, source: str) -> str:
    return f"""SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM (
        SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS rx,
            rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2 AS ry
        FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""


def _pearson(x: str, y: str, source: str) -> str:
    return f"""SELECT round(corr({x}, {y}), 6) AS pearson, count(*) AS n FROM {source}
        WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""


def _ols(x: str, y: str, source: str, digits: int) -> str:
    return f"""SELECT round(regr_slope({y}, {x}), {digits}) AS slope,
        round(regr_intercept({y}, {x}), 6) AS intercept, count(*) AS n FROM {source}
        WHERE {x} IS NOT NULL AND {y} IS NOT NULL"""


def _outliers(col: str, direction: str) -> str:
    return f"""SELECT site_id, site_name, attr, exposure, rate, round({col}, 6) AS {col}
        FROM s_residuals ORDER BY s_residuals.{col} {direction}, site_id LIMIT 10"""


_CAND_ROUNDED = "* REPLACE (round(distance_miles, 6) AS distance_miles)"
_HISTOGRAM = """SELECT {label} AS distance_range, {ordinal} AS bin_ordinal, {total}
    FROM {source} GROUP BY 1, 2"""
_LINE_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]

_UNION = "\nUNION ALL\n"
_TEXTS = "CAST(0 AS BIGINT) AS integer_values, CAST(0 AS BIGINT) AS real_values, count({c}) AS text_values"
_NO_TEXTS = "CAST(NULL AS BIGINT) AS integer_values, CAST(NULL AS BIGINT) AS real_values, CAST(NULL AS BIGINT) AS text_values"


def _correlations(cols: tuple[str, ...], source: str) -> str:
    """Both correlations of every two columns, over the rows where both are known."""
    rank = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2e0"
    return _UNION.join(
        f"""SELECT '{x}' AS x, '{y}' AS y, round(corr({x}, {y}), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n
        FROM (SELECT {x}, {y}, {rank.format(c=x)} AS rx, {rank.format(c=y)} AS ry FROM {source}
            WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""
        for i, x in enumerate(cols)
        for y in cols[i + 1 :]
    )


FINAL: dict[str, str] = {
    "csv_roundtrip": "SELECT * FROM s_sites",
    "raw_source": """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
        CAST(l_quantity AS VARCHAR) AS l_quantity, l_returnflag FROM lineitem""",
    "zone_edges": "SELECT * FROM s_edge",
    "save_table": "SELECT count(*) AS sites, CAST(sum(exposure) AS BIGINT) AS exposure FROM s_totals",
    "session_view": "SELECT site_id % 5 AS part, count(*) AS sites FROM s_sites GROUP BY 1",
    "append_batches": f"SELECT reason, {_TOTAL} FROM s_reviews GROUP BY reason",
    "decision_table": "SELECT * FROM s_decisions",
    "preview_repair": """SELECT site_id, ts, exposure, CAST(replace(exposure, ',', '') AS BIGINT) AS cleaned
        FROM s_exposure_raw WHERE exposure LIKE '%,%' ORDER BY cleaned DESC, site_id, ts LIMIT 20""",
    "profile_rows": "SELECT count(*) AS row_count FROM lineitem",
    "profile_domain": "SELECT DISTINCT l_returnflag FROM lineitem",
    "profile_range": """SELECT min(ts) AS min_value, max(ts) AS max_value,
        strftime(min(strptime(ts, '%m/%d/%Y %I:%M:%S %p')), '%Y-%m-%d %H:%M:%S') AS min_ts,
        strftime(max(strptime(ts, '%m/%d/%Y %I:%M:%S %p')), '%Y-%m-%d %H:%M:%S') AS max_ts FROM s_exposure_raw""",
    "profile_nulls": _nulls(["dt", "tm", "name", "lat", "lon", "district"], "s_incidents"),
    "profile_nulls_lineitem": _nulls(_LINE_COLS, "lineitem"),
    "profile_missing_name": "SELECT count(*) AS missing FROM s_incidents WHERE name IS NULL",
    "profile_distinct": "SELECT count(DISTINCT name) AS distinct_values FROM s_incidents",
    "profile_distinct_parts": "SELECT count(DISTINCT l_partkey) AS distinct_values FROM lineitem",
    "profile_types": """SELECT CASE WHEN exposure IS NULL THEN 'null' WHEN exposure LIKE '%,%' THEN 'text'
            WHEN exposure LIKE '%.%' THEN 'real' ELSE 'integer' END AS stored_type,
        count(*) AS row_count FROM s_exposure_raw GROUP BY 1""",
    "profile_types_clean": """SELECT CASE WHEN exposure IS NULL THEN 'null' ELSE 'integer' END AS stored_type,
        count(*) AS row_count FROM s_exposure GROUP BY 1""",
    "profile_table": _UNION.join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS nulls,
            {f'CAST(min({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS min_number,
            {f'CAST(max({c}) AS DOUBLE)' if number else 'CAST(NULL AS DOUBLE)'} AS max_number,
            {'CAST(NULL AS VARCHAR)' if number else f'min({text})'} AS min_text,
            {'CAST(NULL AS VARCHAR)' if number else f'max({text})'} AS max_text,
            count(DISTINCT {c}) AS exact_distinct, TRUE AS estimate_close FROM lineitem"""
        for c, number, text in (
            ("l_orderkey", True, ""),
            ("l_linenumber", True, ""),
            ("l_quantity", True, ""),
            ("l_discount", True, ""),
            ("l_returnflag", False, "l_returnflag"),
            ("l_linestatus", False, "l_linestatus"),
            ("l_shipdate", False, "strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f')"),
        )
    ),
    "profile_batches": _UNION.join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count(*) FILTER ({c} IS NULL) AS nulls,
            {types}, {f'count(DISTINCT {c})' if counted else 'CAST(NULL AS BIGINT)'} AS counted,
            {'TRUE' if counted else 'CAST(NULL AS BOOLEAN)'} AS estimate_close FROM s_exposure_raw"""
        for c, counted, types in (
            ("ts", False, _TEXTS.format(c="ts")),
            ("site_id", True, _NO_TEXTS),
            ("site_name", False, _TEXTS.format(c="site_name")),
            ("region", False, _TEXTS.format(c="region")),
            ("lat", False, _NO_TEXTS),
            ("lon", False, _NO_TEXTS),
            (
                "exposure",
                True,
                """count(*) FILTER (exposure NOT LIKE '%,%' AND exposure NOT LIKE '%.%') AS integer_values,
                count(*) FILTER (exposure NOT LIKE '%,%' AND exposure LIKE '%.%') AS real_values,
                count(*) FILTER (exposure LIKE '%,%') AS text_values""",
            ),
        )
    ),
    "profile_fd": """SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_l_suppkey,
        count(DISTINCT l_returnflag) AS n_l_returnflag FROM lineitem GROUP BY 1
        HAVING count(DISTINCT l_suppkey) > 1 OR count(DISTINCT l_returnflag) > 1""",
    "profile_fd_counts": """SELECT site_id, count(DISTINCT site_name) AS n_site_name, count(DISTINCT lat) AS n_lat,
        count(DISTINCT lon) AS n_lon FROM s_exposure_raw GROUP BY 1""",
    "profile_duplicates": """SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
        GROUP BY 1, 2 HAVING count(*) > 1""",
    "profile_coverage": "SELECT site_id, count(ts) AS present FROM s_exposure_raw GROUP BY 1 HAVING count(ts) < 30",
    "profile_coverage_range": """SELECT min(n) AS min_present, max(n) AS max_present
        FROM (SELECT count(ts) AS n FROM s_exposure_raw GROUP BY site_id)""",
    "reconcile_clean": _reconcile("s_exposure", "exposure", "s_exposure_period", "exposure"),
    "reconcile_crosswalk": _reconcile("s_cand", "incidents", "s_crosswalk", "incidents"),
    "reconcile_site_period": _reconcile(
        "s_exposure", "exposure", "s_site_period", "exposure",
        "rows_after, measure_before, measure_after, measure_equal",
    ),
    "batch_summary": f"SELECT reason, {_TOTAL} FROM s_reviews GROUP BY reason",
    "missing_attribute_sites": "SELECT site_id, site_name, zone_id FROM s_site_attr WHERE attr IS NULL",
    "missing_attribute_values": """SELECT zone_id, name, value FROM s_attr
        WHERE zone_id IN (SELECT zone_id FROM s_site_attr WHERE attr IS NULL)""",
    "clean_int": """SELECT site_id, ts, exposure, CAST(replace(exposure, ',', '') AS BIGINT) AS cleaned
        FROM s_exposure_raw""",
    "prefix_int": """SELECT o_orderkey, coalesce(try_cast(regexp_extract(o_orderpriority, '^[0-9]+') AS BIGINT), 0)
        AS priority, coalesce(try_cast(regexp_extract(o_orderstatus, '^[0-9]+') AS BIGINT), 0) AS status_number
        FROM orders""",
    "drop_description_row": "SELECT * FROM s_attr_raw WHERE geo_id <> 'Geography'",
    "attr_clean": "SELECT * FROM s_attr",
    "base_name": "SELECT site_id, base_name FROM s_base",
    "expand_street": "SELECT site_id, street_name FROM s_street",
    "expand_avenue": "SELECT site_id, site_key FROM s_site_key",
    "expand_abbrev": f"SELECT DISTINCT name, {_ABBREV} AS name_key FROM s_incidents",
    "name_match_naive": """SELECT count(DISTINCT name) AS matched_names FROM s_incidents
        WHERE name IN (SELECT base_name FROM s_base)""",
    "name_match_normalised": f"""SELECT count(DISTINCT name) AS matched_names FROM s_incidents
        WHERE {_ABBREV} IN (SELECT site_key FROM s_site_key)""",
    "name_match_summary": f"""SELECT CASE WHEN name_key = site_key THEN 'EXACT MATCH' ELSE 'NO EXACT MATCH' END
        AS name_match, {_TOTAL} FROM s_cand GROUP BY 1""",
    "admin_places": """SELECT name, count(*) AS clusters, count(*) AS incidents FROM s_incidents
        WHERE name ILIKE 'DISTRICT % OFFICE' GROUP BY name""",
    "hour24": "SELECT CAST(left(tm, 2) AS INTEGER) AS hour, count(*) AS incidents FROM s_incidents GROUP BY 1",
    "hour12": """SELECT CAST(h AS INTEGER) AS hour, CAST(sum(exposure) AS BIGINT) AS exposure
        FROM s_exposure GROUP BY 1""",
    "period_of_hour": f"""SELECT CAST(h AS INTEGER) AS hour, {_period('h')} AS period, count(*) AS row_count
        FROM s_exposure GROUP BY 1, 2""",
    "bin_distance": f"""SELECT name, lat_e5, lon_e5,
        {_bins('distance_miles', _DIST_EDGES, _DIST_LONG, '<=')} AS distance_range,
        {_bins('distance_miles', _DIST_EDGES, _ORDINALS, '<=')} AS bin_ordinal FROM s_cand""",
    "bin_exposure": f"""SELECT site_id, exposure, {_bins('exposure', _SITE_EDGES, _SITE_LABELS, '<')}
        AS exposure_range FROM s_totals""",
    "bin_attribute": f"""SELECT site_id, attr, {_bins('attr', _INCOME_EDGES, _INCOME, '<', "'Missing'")}
        AS attr_group FROM s_site_attr""",
    "flag_threshold": """SELECT site_id, exposure,
        CASE WHEN exposure >= 100000 THEN 'Include' ELSE 'Low Ridership' END AS threshold FROM s_totals""",
    "coord_clusters": "SELECT * FROM s_clusters",
    "nearest_site": f"SELECT {_CAND_ROUNDED} FROM s_cand",
    "nearest_sites_in_reach": """SELECT c.name, c.lat_e5, c.lon_e5, CAST(n.site_rank AS INTEGER) AS site_rank, n.site_id, n.site_name,
            round(n.miles, 6) AS distance_miles
        FROM s_clusters c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY name, lat_e5, lon_e5
                ORDER BY (plat - lat) * (plat - lat) + (plon - lon) * (plon - lon), site_id) AS site_rank
            FROM (SELECT name, lat_e5, lon_e5, lat_e5 / 1e5 AS plat, lon_e5 / 1e5 AS plon FROM s_clusters) p
            CROSS JOIN s_dim CROSS JOIN LATERAL (SELECT """ + _miles("plat", "plon", "lat", "lon") + """ AS miles) m
            WHERE miles <= 0.5) n
        ON n.name IS NOT DISTINCT FROM c.name AND n.lat_e5 = c.lat_e5 AND n.lon_e5 = c.lon_e5 AND n.site_rank <= 5""",
    "nearest_by_great_circle": """SELECT c_custkey, arg_min(site_id, (round(miles, 6), site_id)) AS site_id,
            round(arg_min(miles, (round(miles, 6), site_id)), 6) AS distance_miles,
            arg_min(site_id, ((plat - lat) * (plat - lat) + (plon - lon) * (plon - lon), site_id)) AS planar_site_id
        FROM s_globe_pairs GROUP BY c_custkey""",
    "nearest_sites_by_great_circle": """SELECT c.c_custkey, CAST(n.site_rank AS INTEGER) AS site_rank, n.site_id,
            round(n.miles, 6) AS distance_miles
        FROM customer c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(miles, 6), site_id) AS site_rank
            FROM s_globe_pairs WHERE miles <= 1000) n ON n.c_custkey = c.c_custkey AND n.site_rank <= 3""",
    "distance_histogram": _HISTOGRAM.format(
        label=_bins("distance_miles", _DIST_EDGES, _DIST_LONG, "<="),
        ordinal=_bins("distance_miles", _DIST_EDGES, _ORDINALS, "<="),
        total=_TOTAL,
        source="s_cand",
    ),
    "distance_histogram_low_volume": _HISTOGRAM.format(
        label=_bins("distance_miles", _DIST_EDGES, _DIST_SHORT, "<="),
        ordinal=_bins("distance_miles", _DIST_EDGES, _ORDINALS, "<="),
        total=_TOTAL,
        source="s_other WHERE incidents < 4",
    ),
    "pip_join": "SELECT * FROM s_site_zone",
    "pip_edges": "SELECT p.site_id, z.zone_id FROM s_sites p LEFT JOIN s_in_band z USING (site_id)",
    "polygon_texts": "SELECT * FROM s_edge CROSS JOIN (VALUES ('wkt'), ('geojson')) f(format)",
    "polygon_problems": """SELECT CASE n_nationkey % 6 WHEN 0 THEN 'OK' WHEN 1 THEN 'MISSING' WHEN 2 THEN 'TYPE'
            WHEN 3 THEN 'UNREADABLE' WHEN 4 THEN 'NUMBER' ELSE 'RING' END AS problem, count(*) AS geometries FROM nation GROUP BY ALL""",
    "pip_unmatched": "SELECT count(*) AS missing FROM s_site_zone WHERE zone_id IS NULL",
    "site_dimension": "SELECT * FROM s_dim",
    "pick_one": "SELECT site_id, min(site_name) AS site_name FROM s_dim GROUP BY site_id",
    "best_row_per_key": """SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber, l_partkey FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey
            ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) = 1""",
    "average_rank": f"""SELECT site_id, thousands, r AS avg_rank FROM (
        {_rank('thousands', '(SELECT site_id, CAST(floor(exposure / 10000) AS BIGINT) AS thousands FROM s_totals)')})""",
    "average_rank_quantity": f"""SELECT l_quantity, r AS avg_rank, count(*) AS row_count
        FROM ({_rank('l_quantity', 'lineitem')}) GROUP BY ALL""",
    "review_queue": f"SELECT {_CAND_ROUNDED} FROM s_queue",
    "latest_decisions": "SELECT * FROM s_latest",
    "apply_decisions": f"SELECT {_CAND_ROUNDED} FROM s_applied",
    "append_decisions": f"SELECT {_CAND_ROUNDED} FROM s_reviews",
    "review_duplicates": """SELECT name, lat_e5, lon_e5, count(*) AS row_count FROM s_accepted
        GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "evidence": """SELECT k.name, k.lat_e5, k.lon_e5, k.district, count(*) AS incidents FROM s_keyed k
        WHERE EXISTS (FROM s_queue q WHERE q.name = k.name AND q.lat_e5 = k.lat_e5 AND q.lon_e5 = k.lon_e5)
        GROUP BY ALL""",
    "validated_names": "SELECT * FROM s_valid",
    "triage": "SELECT * FROM s_triage",
    "triage_summary": f"SELECT match_status, {_TOTAL} FROM s_triage GROUP BY 1",
    "unassigned_clusters": """SELECT name, lat_e5, lon_e5, incidents FROM s_cand c WHERE NOT EXISTS (FROM s_accepted a
        WHERE a.name = c.name AND a.lat_e5 = c.lat_e5 AND a.lon_e5 = c.lon_e5)""",
    "crosswalk": "SELECT * FROM s_crosswalk",
    "crosswalk_report": f"SELECT match_status, {_TOTAL} FROM s_crosswalk GROUP BY 1",
    "crosswalk_duplicates": """SELECT name, lat_e5, lon_e5, count(*) AS row_count FROM s_crosswalk
        GROUP BY 1, 2, 3 HAVING count(*) > 1""",
    "attach_site": "SELECT * FROM s_site_incidents",
    "enriched_crosswalk": "SELECT * FROM s_enriched",
    "attr_coverage": f"""SELECT CASE WHEN attr IS NOT NULL THEN 'HAS_ATTRIBUTE' ELSE 'MISSING_ATTRIBUTE' END
        AS attr_status, {_TOTAL} FROM s_enriched GROUP BY 1""",
    "site_attributes": "SELECT * FROM s_site_attr",
    "exposure_totals": "SELECT * FROM s_totals",
    "incident_totals": "SELECT * FROM s_matched",
    "site_metrics": "SELECT * FROM s_metrics",
    "rank_rate": "SELECT * FROM s_metrics ORDER BY rate DESC, site_id LIMIT 10",
    "rank_volume": "SELECT * FROM s_metrics ORDER BY incidents DESC, site_id LIMIT 10",
    "rank_rate_min": "SELECT * FROM s_metrics WHERE exposure >= 100000 ORDER BY rate DESC, site_id LIMIT 10",
    "exposure_distribution": """SELECT min(exposure) AS min_exposure, round(avg(exposure), 6) AS avg_exposure,
        max(exposure) AS max_exposure FROM s_metrics""",
    "sites_per_bin": f"""SELECT {_bins('exposure', _SITE_EDGES, _SITE_LABELS, '<')} AS exposure_range,
        count(*) AS sites, min(exposure) AS min_exposure FROM s_metrics GROUP BY 1""",
    "volume_set": "SELECT site_id, site_name, exposure, incidents FROM s_metrics",
    "rate_set": "SELECT * FROM s_rate_set",
    "attribute_set": "SELECT * FROM s_attr_set",
    "rate_by_bin": f"""SELECT {_bins('attr', _INCOME_EDGES, _INCOME, '<')} AS attr_group, count(*) AS sites,
        round(avg(rate), 6) AS avg_rate, min(attr) AS min_attr FROM s_attr_set GROUP BY 1""",
    "period_metrics": "SELECT * FROM s_periods",
    "site_period_metrics": "SELECT * FROM s_site_period",
    "incremental_site_periods": "SELECT * FROM s_site_period",
    "incremental_periods": "SELECT * FROM s_periods",
    "replayed_batches": """SELECT 'line-' || l_linenumber AS batch_id, count(*) AS row_count, sum(l_quantity) AS quantity FROM lineitem
        WHERE l_linenumber <= 2 OR (l_linenumber = 3 AND l_quantity > 25) GROUP BY 1""",
    "replaced_partitions": """SELECT l_returnflag, count(*) AS row_count,
        sum(l_quantity * CASE l_returnflag WHEN 'A' THEN 2 ELSE 1 END) AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1""",
    "reconcile_contents": """SELECT stage, 2 * count(*) AS rows_before, 2 * count(*) AS rows_after,
            CAST(sum(round(l_quantity) + round(l_discount * 100)) AS BIGINT) AS measure_before,
            CAST(sum(round(l_quantity) + round(l_discount * 100)) AS BIGINT) AS measure_after,
            TRUE AS rows_equal, TRUE AS measure_equal, stage = 'copied' AS contents_equal
        FROM lineitem CROSS JOIN (VALUES ('copied'), ('swapped')) s(stage) GROUP BY stage""",
    "rank_site_period": """SELECT * FROM s_site_period WHERE exposure >= 30000
        ORDER BY rate DESC, site_id, period LIMIT 15""",
    "serving_site": "SELECT * FROM s_published",
    "serving_site_period": "SELECT * FROM s_served_periods",
    "serving_period": "SELECT * FROM s_periods",
    "rate_ratio": """SELECT p.*, p.rate / b.rate AS times_morning
        FROM s_periods p CROSS JOIN (SELECT rate FROM s_periods WHERE period = 'Morning') b""",
    "quadrant": """SELECT m.*, CASE WHEN incidents >= v THEN 'High volume' ELSE 'Low volume' END || ' / '
        || CASE WHEN rate >= r THEN 'high rate' ELSE 'low rate' END AS quadrant FROM s_metrics m CROSS JOIN
        (SELECT quantile_disc(incidents, 0.5) AS v, quantile_disc(rate, 0.5) AS r FROM s_metrics)""",
    "recurring_outliers": """SELECT site_id, count(*) AS views FROM (
        (SELECT site_id FROM s_metrics WHERE exposure >= 100000 ORDER BY rate DESC, site_id LIMIT 10) UNION ALL
        (SELECT site_id FROM s_metrics ORDER BY incidents DESC, site_id LIMIT 10) UNION ALL
        (SELECT site_id FROM s_residuals ORDER BY exposure_residual DESC, site_id LIMIT 10) UNION ALL
        (SELECT site_id FROM s_residuals ORDER BY attr_residual DESC, site_id LIMIT 10))
        GROUP BY 1 HAVING count(*) >= 2""",
    "pearson_volume": _pearson("exposure", "incidents", "s_metrics"),
    "pearson_rate": _pearson("exposure", "rate", "s_rate_set"),
    "pearson_attr": _pearson("attr", "rate", "s_attr_set"),
    "pearson_lineitem": _pearson("l_quantity", "l_extendedprice", "lineitem"),
    "spearman_volume": _spearman("exposure", "incidents", "s_metrics"),
    "spearman_rate": _spearman("exposure", "rate", "s_rate_set"),
    "spearman_attr": _spearman("attr", "rate", "s_attr_set"),
    "spearman_lineitem": _spearman("l_quantity", "l_extendedprice", "lineitem"),
    "correlation_matrix": _correlations(("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"), "s_known_lines"),
    "exact_quartiles": _UNION.join(
        f"""SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, round(quantile_cont({c}, {p}), 6) AS value, count({c}) AS n
        FROM s_known_lines"""
        for c in ("l_quantity", "l_extendedprice", "l_discount")
        for p in (0.25, 0.5, 0.75)
    ),
    "log_exposure": """SELECT site_id, round(log10(exposure), 6) AS log_exposure FROM s_totals WHERE exposure > 0""",
    "ols_exposure": _ols("log_exposure", "rate", "s_log", 6),
    "ols_attr": _ols("attr", "rate", "s_attr_set", 10),
    "residuals": """SELECT site_id, site_name, attr, exposure, rate, round(log_exposure, 6) AS log_exposure,
        round(expected_from_exposure, 6) AS expected_from_exposure, round(exposure_residual, 6) AS exposure_residual,
        round(expected_from_attr, 6) AS expected_from_attr, round(attr_residual, 6) AS attr_residual
        FROM s_residuals""",
    "outliers_above_exposure": _outliers("exposure_residual", "DESC"),
    "outliers_above_attr": _outliers("attr_residual", "DESC"),
    "outliers_below_attr": _outliers("attr_residual", "ASC"),
    "view_rate_by_bin": "SELECT attr_group, round(avg(rate), 6) AS avg_rate FROM s_stable GROUP BY 1",
    "view_period_rate": "SELECT period, sum(rate) AS rate FROM s_periods GROUP BY 1",
    "view_top_site_periods": """SELECT label, period, round(avg_rate, 6) AS avg_rate, round(max_rate, 6) AS max_rate
        FROM (SELECT site_name || ' - ' || period AS label, period, avg(rate) AS avg_rate, max(rate) AS max_rate
            FROM s_served_periods WHERE threshold = 'Include' GROUP BY 1, 2) t
        ORDER BY t.max_rate DESC, label LIMIT 15""",
    "view_rate_vs_attr": "SELECT site_id, site_name, attr, rate FROM s_stable",
    "view_rate_vs_attr_trend": _ols("attr", "rate", "s_stable", 10),
    "view_volume_vs_exposure": "SELECT site_id, site_name, exposure, incidents FROM s_published",
    "view_volume_vs_exposure_trend": _ols("exposure", "incidents", "s_published", 10),
    "view_top_sites": """SELECT site_name, round(r, 6) AS rate FROM (SELECT site_name, sum(rate) AS r
        FROM s_published WHERE exposure >= 100000 GROUP BY 1) ORDER BY r DESC, site_name LIMIT 10""",
    "full_analysis": " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, count(*) AS row_count, CAST(sum(exposure) AS BIGINT) AS exposure,
            {rate} AS avg_rate FROM {source}"""
        for name, source, rate in (
            ("sites", "s_published", "round(avg(rate), 6)"),
            ("site_periods", "s_served_periods", "round(avg(rate), 6)"),
            ("periods", "s_periods", "round(avg(rate), 6)"),
            ("volume_set", "s_metrics", "CAST(NULL AS DOUBLE)"),
            ("rate_set", "s_rate_set", "round(avg(rate), 6)"),
            ("attribute_set", "s_attr_set", "round(avg(rate), 6)"),
        )
    ),
    "published_sites": "SELECT * FROM s_published",
    "clean_decimal": """SELECT l_orderkey, l_linenumber, CAST(l_quantity AS VARCHAR) AS text,
        CAST(trunc(l_quantity) AS BIGINT) AS cleaned FROM lineitem""",
    "unreadable_values": """SELECT count(*) AS row_count,
        count(*) FILTER (o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS BIGINT) IS NULL) AS unreadable
        FROM orders""",
    "csv_odd_values": """SELECT o_orderkey, CASE o_orderkey % 6
        WHEN 0 THEN '  ' || o_orderpriority || ' '
        WHEN 1 THEN o_orderpriority || chr(10) || o_orderpriority
        WHEN 2 THEN '"' || o_orderpriority || '", "'
        WHEN 3 THEN ''
        WHEN 4 THEN NULL
        ELSE o_orderpriority || chr(13) || chr(10) || ',' || chr(92) END AS text FROM orders""",
    "nearest_site_of_facts": """SELECT site_id, count(*) AS points, round(max(miles), 6) AS farthest_miles
        FROM (SELECT CASE WHEN district <> 3 THEN lat END AS plat, lon AS plon FROM s_incidents) f
        LEFT JOIN (SELECT plat, plon, site_id, 2 * 3959e0 * asin(sqrt(power(sin(radians(lat - plat) / 2), 2)
                + cos(radians(plat)) * cos(radians(lat)) * power(sin(radians(lon - plon) / 2), 2))) AS miles
            FROM (SELECT DISTINCT lat AS plat, lon AS plon FROM s_incidents) p CROSS JOIN s_dim
            QUALIFY row_number() OVER (PARTITION BY plat, plon
                ORDER BY (plat - lat) * (plat - lat) + (plon - lon) * (plon - lon), site_id) = 1) n USING (plat, plon)
        GROUP BY site_id""",
    "clusters_without_place": """SELECT name, CASE WHEN district <> 3 THEN lat_e5 END AS lat_e5,
        CASE WHEN district <> 5 THEN lon_e5 END AS lon_e5, count(*) AS incidents FROM s_keyed GROUP BY ALL""",
    "raw_incidents": "SELECT dt, tm, name, lat, lon, district FROM s_incidents",
    "raw_exposure": """SELECT * REPLACE (CAST(replace(exposure, ',', '') AS BIGINT) AS exposure)
        FROM s_exposure_raw""",
    "raw_zone_attributes": "SELECT geo_id, CAST(NULL AS VARCHAR) AS name, value FROM s_attr_raw",
}

_STAGE_NAME = re.compile(r"\bs_[a-z_]+\b")


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in _STAGE_NAME.findall(sql):
        if name in STAGES and name not in found:
            _needed(STAGES[name], found)
            found.append(name)
    return found


def _statement(sql: str) -> str:
    stages = ",\n".join(f"{n} AS ({STAGES[n]})" for n in _needed(sql, []))
    return f"WITH {stages}\n{sql}" if stages else sql


ORACLE_SQL: dict[str, str] = {name: _statement(sql) for name, sql in FINAL.items()}
