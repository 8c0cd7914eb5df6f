"""DuckDB SQL for the correctness gate, written from the rules of SURVEY section 2.

Only the driver tables are registered on the DuckDB side, so each query
starts from the same adapters as ``gridpulse.sources.fixtures`` written as
CTEs. Literals that must be doubles are written ``CAST('..' AS DOUBLE)``
(DuckDB reads bare decimals as DECIMAL).
"""

from __future__ import annotations

COMPLAINTS_CTE = """complaints AS (
  SELECT CAST(event_id AS VARCHAR) AS unique_key,
    CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts END AS created_date,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts + INTERVAL 3 HOUR END AS closed_date,
    'NYPD' AS agency,
    'New York City Police Department' AS agency_name,
    CASE event_type WHEN 'click' THEN 'Noise - Residential' WHEN 'view' THEN 'Noise - Street/Sidewalk'
      WHEN 'purchase' THEN 'Noise - Commercial' WHEN 'signup' THEN 'noise - vehicle'
      ELSE CONCAT('Illegal Parking ', CAST(event_id % 8 AS VARCHAR)) END AS complaint_type,
    CASE WHEN event_id % 3 = 0 THEN 'Loud Music/Party' WHEN event_id % 3 = 1 THEN 'Banging/Pounding' ELSE NULL END AS descriptor,
    CASE WHEN event_id % 5 = 0 THEN 'In Progress' ELSE 'Closed' END AS status,
    CASE user_id % 6 WHEN 0 THEN 'BRONX' WHEN 1 THEN 'BROOKLYN' WHEN 2 THEN 'MANHATTAN' WHEN 3 THEN 'QUEENS'
      WHEN 4 THEN 'STATEN ISLAND' ELSE NULL END AS borough,
    'NEW YORK' AS city,
    CAST(10001 + event_id % 300 AS VARCHAR) AS incident_zip,
    CONCAT(CAST(1 + event_id % 999 AS VARCHAR), ' BROADWAY') AS incident_address,
    'BROADWAY' AS street_name,
    CAST(NULL AS VARCHAR) AS cross_street_1,
    CAST(NULL AS VARCHAR) AS cross_street_2,
    'Street/Sidewalk' AS location_type,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 83 = 0 THEN CAST(4048 + event_id % 10 AS DOUBLE) / CAST(100 AS DOUBLE)
      ELSE CAST(404774321 + (event_id * 7919) % 820 * 1221 AS DOUBLE) / CAST(10000000 AS DOUBLE) END AS latitude,
    CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id % 79 = 0 THEN CAST(-7425 + event_id % 10 AS DOUBLE) / CAST(100 AS DOUBLE)
      ELSE CAST(-742590123 + (user_id * 6421 + event_id * 31) % 820 * 1221 AS DOUBLE) / CAST(10000000 AS DOUBLE) END AS longitude,
    'csv' AS source,
    TIMESTAMP '2024-01-31 00:00:00' AS ingested_at
  FROM events)"""


def _message_cte(name: str, junk: bool) -> str:
    """Text fields of the messages, and beside each parsed field what its text means (NULL: junk or none)."""
    date_junk = """WHEN event_id % 61 = 0 THEN 'not-a-date' WHEN event_id % 83 = 0 THEN CONCAT('2024-1-', day)
      WHEN event_id % 79 = 0 THEN CONCAT('2024-01-', day, 'T10:00:00 UTC') """ if junk else ""
    date_none = "event_id % 61 = 0 OR event_id % 83 = 0 OR event_id % 79 = 0 OR " if junk else ""
    closed_junk = "WHEN event_id % 91 = 0 THEN '2024-13-01' " if junk else ""
    closed_none = "WHEN event_id % 91 = 0 THEN NULL " if junk else ""
    lat_junk = "WHEN event_id % 53 = 0 THEN 'abc' WHEN event_id % 71 = 0 THEN '40.5d' " if junk else ""
    lat_none = "event_id % 53 = 0 OR event_id % 71 = 0 OR " if junk else ""
    lon_junk = "WHEN event_id % 103 = 0 THEN '0x1p3' " if junk else ""
    lon_none = "event_id % 103 = 0 OR " if junk else ""
    return f"""{name} AS (
  SELECT event_id AS msg_offset, CAST(user_id % 3 AS INTEGER) AS partition_id, ts AS msg_ts,
    CASE WHEN event_id % 307 = 0 THEN NULL ELSE CAST(event_id % 700 AS VARCHAR) END AS unique_key,
    CASE {date_junk}WHEN event_id % 67 = 0 THEN ''
      WHEN event_id % 41 = 0 THEN CONCAT('2024-01-', day, 'T10:00:00.000+02:00')
      WHEN event_id % 43 = 0 THEN CONCAT('202401', day) WHEN event_id % 47 = 0 THEN CONCAT('2024-01-', day, 'T10:00:00Z')
      ELSE CONCAT('2024-01-', day, 'T10:00:00.000') END AS created_date,
    CASE WHEN {date_none}event_id % 67 = 0 THEN NULL
      ELSE CAST(CONCAT('2024-01-', day) AS TIMESTAMP) + CASE WHEN event_id % 41 = 0 THEN INTERVAL 8 HOUR
        WHEN event_id % 43 = 0 THEN INTERVAL 0 HOUR ELSE INTERVAL 10 HOUR END END AS created_ts,
    CASE {closed_junk}WHEN event_id % 7 = 0 THEN CONCAT('2024-02-', day) END AS closed_date,
    CASE {closed_none}WHEN event_id % 7 = 0 THEN CAST(CONCAT('2024-02-', day) AS TIMESTAMP) END AS closed_ts,
    CASE event_type WHEN 'click' THEN 'Noise - Residential' WHEN 'view' THEN ' Noise - Street/Sidewalk '
      WHEN 'purchase' THEN 'Noise - Commercial' WHEN 'signup' THEN 'noise - vehicle'
      ELSE CONCAT('Illegal Parking ', CAST(event_id % 8 AS VARCHAR)) END AS complaint_type,
    CASE WHEN event_id % 4 = 0 THEN ' Loud "Music", party' END AS descriptor,
    CASE {lat_junk}WHEN event_id % 59 = 0 THEN '' WHEN event_id % 31 = 0 THEN CONCAT(' ', lat_text, ' ') ELSE lat_text END AS latitude,
    CASE WHEN {lat_none}event_id % 59 = 0 THEN NULL ELSE CAST(lat_text AS DOUBLE) END AS lat,
    CASE {lon_junk}WHEN event_id % 73 = 0 THEN NULL ELSE lon_text END AS longitude,
    CASE WHEN {lon_none}event_id % 73 = 0 THEN NULL ELSE CAST(lon_text AS DOUBLE) END AS lon
  FROM (SELECT *, LPAD(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') AS day,
      CONCAT('40.', LPAD(CAST((event_id * 7919) % 1000 + 4774 AS VARCHAR), 4, '0')) AS lat_text,
      CONCAT('-74.', LPAD(CAST((user_id * 6421) % 1000 AS VARCHAR), 4, '0')) AS lon_text
    FROM events))"""


MESSAGES_CTE = _message_cte("messages", junk=True)
EXTRACT_CTE = _message_cte("extract", junk=False)

RUNS_CTE = """runs AS (
  SELECT CONCAT('job_', CAST(user_id % 7 AS VARCHAR)) AS job_name, event_id AS run_seq,
    CASE WHEN user_id % 7 >= 5 THEN ts - INTERVAL 60 DAY ELSE ts END AS event_at,
    CASE WHEN event_type IN ('click','view') THEN 'running' WHEN event_type IN ('purchase','signup') AND user_id % 7 <> 4 THEN 'success'
      ELSE 'failed' END AS status,
    CASE WHEN event_type = 'error' THEN CONCAT('err ', props) ELSE NULL END AS error,
    CASE WHEN event_type IN ('click','view') THEN CAST(NULL AS INTEGER) ELSE CAST(event_id % 1000 AS INTEGER) END AS rows_processed
  FROM events)"""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

# Zoom level -> grid size in degrees.
_ZOOMS = ((10, "0.02"), (12, "0.01"), (14, "0.0045"))
G45 = "CAST('0.0045' AS DOUBLE)"




def _mean(column: str) -> str:
    """The mean, rounded once, from a sum that no order of the rows changes.

    Doubles of this size are whole multiples of 2 ** -69, so their sum is exact in
    HUGEINT; AVG of doubles rounds after each row. The quotient's upper digits are
    exact as a double and the lower ones are rounded into it.
    """
    total, n, unit = f"SUM(CAST({column} * CAST(590295810358705651712 AS DOUBLE) AS HUGEINT))", f"COUNT({column})", 2**26
    rest = f"(({total} % {n} + {n}) % {n})"
    mean = f"(({total} - {rest}) // {n})"
    low = f"(({mean} % {unit} + {unit}) % {unit})"
    high = f"(({mean} - {low}) // {unit})"
    return (
        f"CASE WHEN {n} > 0 THEN CAST({high} AS DOUBLE) / CAST(8796093022208 AS DOUBLE)"
        f" + CAST({low} AS DOUBLE) / CAST(590295810358705651712 AS DOUBLE) END"
    )


def _grid_level(zoom: int, size: str, noise: str, refreshed: bool) -> str:
    """Every noise complaint with a place counts once in the cell its coordinates fall in."""
    refreshed_col = f", {AS_OF} AS refreshed_at" if refreshed else ""
    g = f"CAST('{size}' AS DOUBLE)"
    return f"""SELECT CAST({zoom} AS INTEGER) AS zoom_level, {g} AS grid_size_degrees, borough, complaint_type,
    FLOOR(latitude / {g}) * {g} AS lat_bucket, FLOOR(longitude / {g}) * {g} AS lon_bucket,
    {_mean("latitude")} AS center_lat, {_mean("longitude")} AS center_lon, COUNT(*) AS complaint_count,
    MIN(created_date) AS earliest_created_date, MAX(created_date) AS latest_created_date{refreshed_col}
  FROM complaints
  WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND {noise}
  GROUP BY borough, complaint_type, lat_bucket, lon_bucket"""


def _grid(noise: str, refreshed: bool) -> str:
    return "\n  UNION ALL\n  ".join(_grid_level(z, g, noise, refreshed) for z, g in _ZOOMS)


GRID_ROLLUPS_CTE = f"grid_rollups AS (\n  {_grid("complaint_type ILIKE 'Noise%'", True)})"
GRID_ROLLUPS_OFFLINE_SQL = _grid("contains(lower(trim(complaint_type)), 'noise')", False)


def _time_level(bucket: str, where: str, refreshed: bool) -> str:
    refreshed_col = f", {AS_OF} AS refreshed_at" if refreshed else ""
    return f"""  SELECT '{bucket}' AS bucket_type, date_trunc('{bucket}', created_date) AS bucket_start, borough, complaint_type,
    COUNT(*) AS complaint_count{refreshed_col}
  FROM complaints WHERE {where}
  GROUP BY date_trunc('{bucket}', created_date), borough, complaint_type"""


TIME_ROLLUPS_CTE = "time_rollups AS (\n" + "\n  UNION ALL\n".join(
    _time_level(b, "created_date IS NOT NULL AND complaint_type ILIKE 'Noise%'", True) for b in ("hour", "day", "week")
) + ")"

TIME_ROLLUPS_OFFLINE_SQL = "\n  UNION ALL\n".join(
    _time_level(
        b, "latitude IS NOT NULL AND longitude IS NOT NULL AND contains(lower(trim(complaint_type)), 'noise')", False
    )
    for b in ("hour", "day", "week")
)


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _d(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


POINT_SELECT = """SELECT unique_key, created_date, closed_date, complaint_type, descriptor, agency, status, borough, city,
  incident_zip, incident_address, latitude AS lat, longitude AS lon
FROM complaints"""
POINT_ORDER = "ORDER BY created_date DESC NULLS FIRST, unique_key"
COORDS = "latitude IS NOT NULL AND longitude IS NOT NULL"
VIEWPORT_BBOX = (
    f"latitude >= {_d(40.4774)} AND latitude <= {_d(40.9176)} AND longitude >= {_d(-74.2591)} AND longitude <= {_d(-73.7002)}"
)
VIEWPORT_CENTRE_BBOX = VIEWPORT_BBOX.replace("latitude", "center_lat").replace("longitude", "center_lon")
GRID_SELECT = """SELECT center_lat AS lat, center_lon AS lon, complaint_count AS count, lat_bucket, lon_bucket, zoom_level,
  latest_created_date
FROM grid_rollups"""
RECORD_LIST = """unique_key, created_date, closed_date, agency, agency_name, complaint_type, descriptor, status, borough,
  city, incident_zip, incident_address, street_name, cross_street_1, cross_street_2, location_type, latitude, longitude"""

ORACLE_SQL: dict[str, str] = {
    "points_page": with_ctes(COMPLAINTS_CTE)
    + f"{POINT_SELECT}\nWHERE {COORDS}\n{POINT_ORDER}\nLIMIT 500 OFFSET 100",
    "points_filtered": with_ctes(COMPLAINTS_CTE)
    + f"""{POINT_SELECT}
WHERE {COORDS} AND created_date >= TIMESTAMP '2024-01-05 00:00:00' AND created_date <= TIMESTAMP '2024-01-20 23:59:59'
  AND borough = 'QUEENS' AND complaint_type = 'Noise - Residential' AND descriptor = 'Loud Music/Party'
{POINT_ORDER}
LIMIT 5000""",
    "points_bbox": with_ctes(COMPLAINTS_CTE)
    + f"""{POINT_SELECT}
WHERE {COORDS} AND latitude >= {_d(40.5)} AND latitude <= {_d(40.55)} AND longitude >= {_d(-74.23)}
{POINT_ORDER}
LIMIT 5000""",
    "points_deep": with_ctes(COMPLAINTS_CTE)
    + f"{POINT_SELECT}\nWHERE {COORDS}\n{POINT_ORDER}\nLIMIT 400 OFFSET 600",
    "points_finite": with_ctes(COMPLAINTS_CTE)
    + f"""SELECT * FROM (
{POINT_SELECT}
WHERE {COORDS}
{POINT_ORDER}
LIMIT 250) AS page
WHERE CAST(unique_key AS BIGINT) % 10 > 2""",
    "noise_rules": with_ctes(MESSAGES_CTE)
    + r"""SELECT complaint_type, COUNT(*) AS n_rows,
  complaint_type ILIKE 'Noise%' AS ilike_prefix,
  contains(lower(trim(complaint_type)), 'noise') AS contains_ci,
  contains(regexp_replace(COALESCE(complaint_type, ''), '^\s+|\s+$', '', 'g'), 'Noise') AS contains_cs,
  complaint_type LIKE 'Noise%' AS like_prefix
FROM messages
GROUP BY complaint_type""",
    "grid_rollups": with_ctes(COMPLAINTS_CTE, GRID_ROLLUPS_CTE) + "SELECT * FROM grid_rollups",
    "grid_rollups_offline": with_ctes(COMPLAINTS_CTE) + GRID_ROLLUPS_OFFLINE_SQL,
    "grid_serving": with_ctes(COMPLAINTS_CTE, GRID_ROLLUPS_CTE)
    + f"""{GRID_SELECT}
WHERE zoom_level = 12 AND complaint_count >= 2 AND {VIEWPORT_CENTRE_BBOX}
ORDER BY complaint_count DESC""",
    "grid_live": with_ctes(COMPLAINTS_CTE)
    + f"""SELECT {_mean("latitude")} AS lat, {_mean("longitude")} AS lon, COUNT(*) AS count,
  FLOOR(latitude / {G45}) * {G45} AS lat_bucket, FLOOR(longitude / {G45}) * {G45} AS lon_bucket,
  CAST(NULL AS INTEGER) AS zoom_level, CAST(NULL AS TIMESTAMP) AS latest_created_date
FROM complaints
WHERE borough = 'QUEENS' AND {COORDS}
GROUP BY lat_bucket, lon_bucket
HAVING COUNT(*) >= 2""",
    "grid_500m": with_ctes(COMPLAINTS_CTE)
    + f"""SELECT FLOOR(latitude / {G45}) * {G45} AS lat_bucket, FLOOR(longitude / {G45}) * {G45} AS lon_bucket,
  COUNT(*) AS complaint_count, {_mean("latitude")} AS center_lat, {_mean("longitude")} AS center_lon
FROM complaints
GROUP BY 1, 2""",
    "time_rollups": with_ctes(COMPLAINTS_CTE, TIME_ROLLUPS_CTE) + "SELECT * FROM time_rollups",
    "time_rollups_offline": with_ctes(COMPLAINTS_CTE) + TIME_ROLLUPS_OFFLINE_SQL,
    "overview": with_ctes(COMPLAINTS_CTE)
    + f"""SELECT COUNT(*) AS total_complaints, COUNT(DISTINCT complaint_type) AS complaint_types,
  COUNT(DISTINCT borough) AS boroughs, MIN(created_date) AS earliest_created_date, MAX(created_date) AS latest_created_date
FROM complaints
WHERE {COORDS} AND created_date >= TIMESTAMP '2024-01-10 00:00:00'""",
    "top_types": with_ctes(COMPLAINTS_CTE)
    + f"""SELECT complaint_type, COUNT(*) AS count FROM complaints WHERE {COORDS}
GROUP BY complaint_type ORDER BY count DESC, complaint_type NULLS FIRST LIMIT 10""",
    "counts_by_borough": with_ctes(COMPLAINTS_CTE)
    + f"""SELECT borough, COUNT(*) AS count FROM complaints WHERE {COORDS}
GROUP BY borough ORDER BY count DESC""",
    "type_counts": with_ctes(COMPLAINTS_CTE)
    + "SELECT complaint_type, COUNT(*) AS count FROM complaints GROUP BY complaint_type ORDER BY count DESC",
    "freshness": with_ctes(COMPLAINTS_CTE)
    + "SELECT COUNT(*) AS complaint_count, MAX(created_date) AS latest_created_date FROM complaints",
    "density_classes": with_ctes(
        COMPLAINTS_CTE, GRID_ROLLUPS_CTE, f"cells AS (\n{GRID_SELECT}\nWHERE zoom_level = 12 AND complaint_count >= 1)"
    )
    + """SELECT *, CASE WHEN count > CAST('2.5' AS DOUBLE) * (SELECT COALESCE(AVG(count), 0) FROM cells) THEN 'high'
  WHEN count > (SELECT COALESCE(AVG(count), 0) FROM cells) THEN 'medium' ELSE 'low' END AS density_class
FROM cells""",
    "viewport_counts": with_ctes(
        COMPLAINTS_CTE,
        GRID_ROLLUPS_CTE,
        f"cells AS (\n{GRID_SELECT}\nWHERE zoom_level = 14 AND complaint_count >= 2 AND {VIEWPORT_CENTRE_BBOX})",
        f"pts AS (\n{POINT_SELECT}\nWHERE {COORDS} AND {VIEWPORT_BBOX}\n{POINT_ORDER}\nLIMIT 250)",
    )
    + "SELECT (SELECT COUNT(*) FROM pts) AS visible_points, (SELECT COUNT(*) FROM cells) AS visible_cells",
    "lookback_extract": with_ctes(COMPLAINTS_CTE)
    + f"""SELECT {RECORD_LIST}
FROM complaints
WHERE complaint_type LIKE 'Noise%' AND {COORDS} AND created_date >= TIMESTAMP '2024-01-24 00:00:00'
ORDER BY created_date DESC NULLS FIRST, unique_key""",
}

ORACLE_SQL["points_by_place"] = ORACLE_SQL["points_bbox"]

# --- ingest, upsert, offsets, ledger ------------------------------------------

STRIP = r"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
PUBLISH_FILTER = (
    "contains(" + STRIP.format(c="COALESCE(complaint_type, '')") + ", 'Noise')"
    " AND unique_key IS NOT NULL AND unique_key <> '' AND latitude IS NOT NULL AND latitude <> ''"
    " AND longitude IS NOT NULL AND longitude <> ''"
)
NULL_TEXT = ("agency", "agency_name", "status", "borough", "city", "incident_zip", "incident_address",
             "street_name", "cross_street_1", "cross_street_2", "location_type")


def _record_select(complaint_type: str, source: str) -> str:
    nulls = {c: f"CAST(NULL AS VARCHAR) AS {c}" for c in NULL_TEXT}
    cols = [
        "unique_key",
        "created_ts AS created_date",
        "closed_ts AS closed_date",
        nulls["agency"],
        nulls["agency_name"],
        f"{complaint_type} AS complaint_type",
        "descriptor",
        *[nulls[c] for c in NULL_TEXT[2:]],
        "lat AS latitude",
        "lon AS longitude",
        f"{source} AS source",
    ]
    return ",\n  ".join(cols)


REASON = """CASE WHEN unique_key IS NULL THEN 'missing_key'
    WHEN created_date IS NOT NULL AND created_date <> '' AND created_ts IS NULL THEN 'bad_created_date'
    WHEN closed_date IS NOT NULL AND closed_date <> '' AND closed_ts IS NULL THEN 'bad_closed_date'
    WHEN latitude IS NOT NULL AND latitude <> '' AND lat IS NULL THEN 'bad_latitude'
    WHEN longitude IS NOT NULL AND longitude <> '' AND lon IS NULL THEN 'bad_longitude' END"""
VALID_CTE = f"""valid AS (
  SELECT msg_offset, partition_id, msg_ts,
  {_record_select("complaint_type", "'kafka'")}
  FROM messages WHERE ({REASON}) IS NULL)"""
RECORD_COLS_SQL = """unique_key, created_date, closed_date, agency, agency_name, complaint_type, descriptor, status, borough,
  city, incident_zip, incident_address, street_name, cross_street_1, cross_street_2, location_type, latitude, longitude, source"""
UPSERT_LATEST = f"""SELECT {RECORD_COLS_SQL}
FROM valid
QUALIFY ROW_NUMBER() OVER (PARTITION BY unique_key ORDER BY msg_offset DESC) = 1"""
UPSERT_SQL = with_ctes(MESSAGES_CTE, VALID_CTE) + UPSERT_LATEST

_LAST = "QUALIFY ROW_NUMBER() OVER (PARTITION BY job_name ORDER BY run_seq DESC) = 1"
LEDGER_CTE = f"""firsts AS (SELECT job_name, MIN(run_seq) AS first_start FROM runs WHERE status = 'running' GROUP BY job_name),
ev AS (SELECT r.* FROM runs r JOIN firsts f ON r.job_name = f.job_name AND r.run_seq >= f.first_start),
latest AS (SELECT job_name, status AS last_status, error AS last_error, event_at AS updated_at FROM ev {_LAST}),
started AS (SELECT job_name, event_at AS last_started_at FROM ev WHERE status = 'running' {_LAST}),
fin AS (SELECT job_name, event_at AS last_finished_at, rows_processed FROM ev WHERE status <> 'running' {_LAST}),
ok AS (SELECT job_name, event_at AS last_successful_at FROM ev WHERE status = 'success' {_LAST}),
ledger AS (
  SELECT l.job_name, s.last_started_at, f.last_finished_at, o.last_successful_at, l.last_status, l.last_error,
    CAST(COALESCE(f.rows_processed, 0) AS INTEGER) AS rows_processed, l.updated_at
  FROM latest l JOIN started s ON l.job_name = s.job_name
  LEFT JOIN fin f ON l.job_name = f.job_name
  LEFT JOIN ok o ON l.job_name = o.job_name)"""

ORACLE_SQL.update(
    {
        "grid_summary": with_ctes(COMPLAINTS_CTE, GRID_ROLLUPS_CTE)
        + f"""{GRID_SELECT}
WHERE zoom_level = 14 AND complaint_count >= 1 AND borough = 'BROOKLYN' AND complaint_type = 'Noise - Residential'
ORDER BY complaint_count DESC""",
        "timeseries_day": with_ctes(COMPLAINTS_CTE, TIME_ROLLUPS_CTE)
        + """SELECT bucket_type, bucket_start, borough, complaint_type, complaint_count
FROM time_rollups
WHERE bucket_type = 'day' AND borough = 'BROOKLYN'
ORDER BY bucket_start DESC NULLS FIRST, borough NULLS FIRST, complaint_type NULLS FIRST
LIMIT 90""",
        "csv_roundtrip": with_ctes(COMPLAINTS_CTE, GRID_ROLLUPS_CTE) + "SELECT * FROM grid_rollups",
        "normalize_sync": with_ctes(EXTRACT_CTE)
        + f"""SELECT {_record_select(STRIP.format(c="complaint_type"), "'socrata'")}
FROM extract
WHERE {PUBLISH_FILTER}""",
        "message_encode": with_ctes(EXTRACT_CTE)
        + f"""SELECT msg_offset, CAST(to_json(struct_pack(unique_key := unique_key, created_date := created_date,
  closed_date := closed_date, agency := CAST(NULL AS VARCHAR), agency_name := CAST(NULL AS VARCHAR),
  complaint_type := {STRIP.format(c="complaint_type")}, descriptor := descriptor,
  status := CAST(NULL AS VARCHAR), borough := CAST(NULL AS VARCHAR), city := CAST(NULL AS VARCHAR),
  incident_zip := CAST(NULL AS VARCHAR), incident_address := CAST(NULL AS VARCHAR), street_name := CAST(NULL AS VARCHAR),
  cross_street_1 := CAST(NULL AS VARCHAR), cross_street_2 := CAST(NULL AS VARCHAR), location_type := CAST(NULL AS VARCHAR),
  latitude := latitude, longitude := longitude, source := 'csv')) AS VARCHAR) AS value
FROM extract
WHERE {PUBLISH_FILTER}""",
        "csv_stream_publish": with_ctes(EXTRACT_CTE)
        + f"""SELECT CAST(to_json(struct_pack(unique_key := COALESCE(unique_key, ''), created_date := COALESCE(created_date, ''),
  closed_date := COALESCE(closed_date, ''), agency := '', agency_name := '', complaint_type := {STRIP.format(c="complaint_type")},
  descriptor := COALESCE(descriptor, ''), status := '', borough := '', city := '', incident_zip := '', incident_address := '',
  street_name := '', cross_street_1 := '', cross_street_2 := '', location_type := '',
  latitude := COALESCE(latitude, ''), longitude := COALESCE(longitude, ''), source := 'csv')) AS VARCHAR) AS value
FROM extract
WHERE {PUBLISH_FILTER}""",
        "normalize_stream": with_ctes(MESSAGES_CTE, VALID_CTE)
        + f"SELECT msg_offset, partition_id, {RECORD_COLS_SQL} FROM valid",
        "stream_rejects": with_ctes(MESSAGES_CTE)
        + f"""SELECT msg_offset, partition_id, unique_key, created_date, closed_date, latitude, longitude,
  {REASON} AS reject_reason
FROM messages
WHERE ({REASON}) IS NOT NULL""",
        "upsert_latest": UPSERT_SQL,
        "upsert_bucketed": UPSERT_SQL,
        "stream_replay": UPSERT_SQL,
        "stream_offsets": with_ctes(MESSAGES_CTE, VALID_CTE)
        + f"""SELECT 'noise-complaints-postgres' AS consumer_name, 'noise-complaints' AS topic_name, partition_id,
  msg_offset AS last_offset, created_date AS last_created_date, msg_ts AS last_message_at, {AS_OF} AS updated_at
FROM valid
QUALIFY ROW_NUMBER() OVER (PARTITION BY partition_id ORDER BY msg_offset DESC) = 1
ORDER BY consumer_name, partition_id""",
        "run_ledger": with_ctes(RUNS_CTE, LEDGER_CTE) + "SELECT * FROM ledger ORDER BY job_name",
        "due_jobs": with_ctes(RUNS_CTE, LEDGER_CTE)
        + """SELECT job_name, last_successful_at,
  (last_successful_at IS NULL OR last_successful_at <= TIMESTAMP '2024-01-26 00:00:00') AS due
FROM ledger""",
        "aggregate_ledger": with_ctes(RUNS_CTE, LEDGER_CTE) + "SELECT * EXCLUDE (rows_processed) FROM ledger ORDER BY job_name",
        "sync_upsert": with_ctes(EXTRACT_CTE)
        + f"""SELECT {_record_select(STRIP.format(c="complaint_type"), "'socrata'")},
  CAST(COUNT(*) OVER () AS INTEGER) AS rows_processed
FROM extract
WHERE {PUBLISH_FILTER} AND complaint_type LIKE 'Noise%' AND created_ts >= TIMESTAMP '2024-01-11 00:00:00'
QUALIFY ROW_NUMBER() OVER (PARTITION BY unique_key ORDER BY created_ts, closed_ts DESC NULLS LAST,
  {STRIP.format(c="complaint_type")} DESC NULLS LAST, descriptor DESC NULLS LAST, lat DESC NULLS LAST, lon DESC NULLS LAST) = 1""",
        "rebuild_serve": with_ctes(COMPLAINTS_CTE, GRID_ROLLUPS_CTE, TIME_ROLLUPS_CTE)
        + """SELECT 'grid' AS store, CAST(zoom_level AS VARCHAR) AS level, COUNT(*) AS cells,
  CAST(SUM(complaint_count) AS BIGINT) AS complaints, 'success' AS last_status
FROM grid_rollups GROUP BY zoom_level
UNION ALL
SELECT 'time', bucket_type, COUNT(*), CAST(SUM(complaint_count) AS BIGINT), 'success' FROM time_rollups GROUP BY bucket_type""",
        "rollup_refresh": with_ctes(MESSAGES_CTE, VALID_CTE, f"complaints AS (\n{UPSERT_LATEST})", GRID_ROLLUPS_CTE, TIME_ROLLUPS_CTE)
        + """SELECT 'grid' AS store, CAST(zoom_level AS VARCHAR) AS level, borough, complaint_type, lat_bucket, lon_bucket,
  CAST(NULL AS TIMESTAMP) AS bucket_start, complaint_count, center_lat, center_lon, earliest_created_date, latest_created_date
FROM grid_rollups
UNION ALL
SELECT 'time', bucket_type, borough, complaint_type, NULL, NULL, bucket_start, complaint_count, NULL, NULL, NULL, NULL FROM time_rollups""",
        "csv_snapshot": with_ctes(COMPLAINTS_CTE)
        + f"""SELECT {RECORD_LIST}
FROM complaints
WHERE complaint_type LIKE 'Noise%' AND {COORDS}
ORDER BY created_date DESC NULLS FIRST, unique_key
LIMIT 10000""",
    }
)
