"""SQL oracles: for each query of the catalogue the same result in plain SQL.

Written independently of the Spark plans.  Shared inputs are common table
expressions; each oracle names the ones it needs.
"""

from __future__ import annotations

CTE: dict[str, tuple[str, str]] = {}
ORACLES: dict[str, str] = {}


def cte(name: str, needs: str, body: str) -> None:
    CTE[name] = (needs, body)


def oracle(name: str, needs: str, body: str) -> None:
    order: list[str] = []

    def visit(key: str) -> None:
        if key in order:
            return
        for other in CTE[key][0].split():
            visit(other)
        order.append(key)

    for key in needs.split():
        visit(key)
    head = ",\n".join(f"{key} AS ({CTE[key][1]})" for key in order)
    ORACLES[name] = f"WITH {head}\n{body}" if head else body


def uuid_of(text: str) -> str:
    h = f"sha256({text})"
    return (f"substr({h},1,8) || '-' || substr({h},9,4) || '-8' || substr({h},14,3) || '-a' || "
            f"substr({h},18,3) || '-' || substr({h},21,12)")


# -- shared inputs ---------------------------------------------------------------
cte("policy_src", "", """
SELECT CAST(1000000 + 2 * o_orderkey AS BIGINT) AS policy_id,
       'POL-' || lpad(CAST(o_orderkey AS VARCHAR), 15, '0') AS policy_num,
       '  ' || c_name || ' ' AS policy_holder_name, lower(c_mktsegment) AS policy_type,
       CAST(o_orderdate AS DATE) AS effective_date,
       CAST(CAST(o_orderdate AS DATE) + INTERVAL 365 DAY AS DATE) AS expiry_date,
       CAST(o_totalprice AS DECIMAL(12,2)) AS premium_amount,
       o_orderdate AS created_at, o_orderdate AS last_modified,
       CASE WHEN o_orderkey % 10 = 3 THEN 'CLOUD' END AS datasync_flag, o_orderkey AS k
FROM orders JOIN customer ON o_custkey = c_custkey""")

cte("claim_src", "", """
SELECT CAST(2000000 + 2 * (l_orderkey * 8 + l_linenumber) AS BIGINT) AS claim_id,
       'CLM-' || lpad(CAST(l_orderkey * 8 + l_linenumber AS VARCHAR), 15, '0') AS claim_num,
       CAST(1000000 + 2 * l_orderkey AS BIGINT) AS policy_id,
       'POL-' || lpad(CAST(l_orderkey AS VARCHAR), 15, '0') AS policy_num,
       CAST(max(l_extendedprice) AS DECIMAL(12,2)) AS claim_amount,
       CASE max(l_returnflag) WHEN 'A' THEN 'APPROVED' WHEN 'N' THEN 'OPEN' ELSE 'REJECTED' END AS claim_status,
       CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE CAST(max(l_shipdate) AS DATE) END AS incident_date,
       max(l_shipdate) AS last_modified,
       CASE WHEN l_orderkey % 10 = 3 THEN 'CLOUD' END AS datasync_flag,
       l_orderkey AS k, l_linenumber AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber""")

cte("policy_conv", "policy_src", """
SELECT policy_id, policy_num, trim(policy_holder_name) AS policy_holder_name, upper(policy_type) AS policy_type,
       premium_amount, last_modified FROM policy_src""")

cte("policy_tgt", "policy_src", """
SELECT policy_id, policy_num, trim(policy_holder_name) AS policy_holder_name, upper(policy_type) AS policy_type,
       CASE WHEN (policy_id // 2) % 19 = 0 THEN CAST(premium_amount + 1 AS DECIMAL(12,2)) ELSE premium_amount END AS premium_amount,
       CASE WHEN (policy_id // 2) % 23 = 0 THEN last_modified - INTERVAL 48 HOUR ELSE last_modified END AS last_modified
FROM policy_src WHERE (policy_id // 2) % 17 <> 0
UNION ALL
SELECT policy_id + 1, policy_num || '-X', trim(policy_holder_name), upper(policy_type), premium_amount, last_modified
FROM policy_src WHERE (policy_id // 2) % 101 = 0
UNION ALL
SELECT -policy_id, policy_num || '-Y', trim(policy_holder_name), upper(policy_type), premium_amount, last_modified
FROM policy_src WHERE (policy_id // 2) % 103 = 0""")

cte("feed", "", """
SELECT event_id AS seq, ts AS event_ts,
       CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
       user_id AS pk, CAST(value AS DECIMAL(12,2)) AS payload, props,
       CASE WHEN event_id % 7 < 3 THEN 'CLOUD' END AS datasync_flag,
       ts - to_hours(CAST((event_id % 5) * 72 AS INTEGER)) AS last_modified
FROM events""")

cte("lines", "policy_src claim_src", """
SELECT k, 0 AS line_num, 'B|' || k || '|1|ts' AS line FROM policy_src
UNION ALL
SELECT k, 1, 'I|policy|insurance|' || effective_date || ' 00:00:00|' || policy_id || '|' || policy_num || '|'
       || policy_holder_name || '|' || policy_type || '|' || effective_date || '|' || expiry_date || '|'
       || CASE WHEN k % 11 = 0 THEN 'NULL' ELSE CAST(premium_amount AS VARCHAR) END || '|'
       || effective_date || ' 00:00:00|' || effective_date || ' 00:00:00|' || coalesce(datasync_flag, '') FROM policy_src
UNION ALL
SELECT k, 100 + n, 'I|claim|insurance|2024-01-01 00:00:00|' || claim_id || '|' || claim_num || '|' || policy_id || '|'
       || policy_num || '| claimant |' || claim_amount || '|' || claim_status || '|'
       || coalesce(CAST(incident_date AS VARCHAR), '') || '|2024-01-01 00:00:00|2024-01-01 00:00:00|'
       || coalesce(datasync_flag, '') FROM claim_src
UNION ALL
SELECT k, 350 + n, 'D|claim|insurance|2024-01-01 00:00:00|' || claim_id || '|' || claim_num FROM claim_src WHERE k % 50 = 0
UNION ALL SELECT k, 200, 'I|short|insurance|ts' FROM policy_src WHERE k % 50 = 0
UNION ALL SELECT k, 201, 'I|agent|insurance|2024-01-01 00:00:00|7|x' FROM policy_src WHERE k % 40 = 0
UNION ALL SELECT k, 202, 'I| |insurance|2024-01-01 00:00:00|x|y' FROM policy_src WHERE k % 60 = 0
UNION ALL
SELECT k, 300, ' u | Policy|INSURANCE |' || effective_date || ' 00:00:00|' || policy_id || '|' || policy_num || '|"'
       || trim(policy_holder_name) || ' | ""Sons""' || chr(34) || '|' || policy_type || '|' || effective_date || '|' || expiry_date || '|'
       || CAST(premium_amount + 100 AS DECIMAL(13,2)) || '|' || effective_date || ' 00:00:00|'
       || CAST(effective_date + to_days(CAST(k % 5 - 2 AS INTEGER)) AS DATE) || ' 00:00:00|'
       || CASE WHEN k % 6 = 0 THEN 'cloud' ELSE '' END FROM policy_src WHERE k % 3 = 0
UNION ALL
SELECT k, 301, 'U|policy|insurance|' || effective_date || ' 00:00:00|' || policy_id || '|' || policy_num || '|'
       || trim(policy_holder_name) FROM policy_src WHERE k % 45 = 0
UNION ALL
SELECT k, 302, 'U|policy|insurance|' || effective_date || ' 00:00:00|' || policy_id || '|' || policy_num
       || repeat('-', 50) || '|' || trim(policy_holder_name) || '|' || policy_type || '|2024-02-30|' || expiry_date
       || '|99999999999.99|' || effective_date || ' 00:00:00|' || effective_date || ' 00:00:00||surplus'
FROM policy_src WHERE k % 35 = 0
UNION ALL
SELECT k, 400, 'D|policy|insurance|' || effective_date || ' 00:00:00|' || policy_id || '|' || policy_num
FROM policy_src WHERE k % 25 = 0
UNION ALL
SELECT k, 401, 'I|claim|insurance|' || effective_date || ' 00:00:00|' || (-2 - 2 * k) || '|CLM-X'
       || lpad(CAST(k AS VARCHAR), 15, '0') || '|' || (1000001 + 2 * k) || '|' || policy_num
       || '|stray|1.00|OPEN||' || effective_date || ' 00:00:00|' || effective_date || ' 00:00:00|'
FROM policy_src WHERE k % 70 = 0
UNION ALL SELECT k, 999, 'C|' || k || '|1|ts' FROM policy_src""")

# every kind of quoted field there is in the lines: one, in the third data column
cte("cols", "lines", """
SELECT *, CASE WHEN contains(line, '"') THEN
    list_concat(string_split(left(line, position('"' IN line) - 2), '|'),
      list_concat([replace(regexp_extract(line, '"(.*)"[^"]*$', 1), '""', '"')],
        string_split(regexp_extract(line, '"[|]([^"]*)$', 1), '|')))
  ELSE string_split(line, '|') END AS c FROM lines""")

cte("kinds", "cols", """
SELECT *, CASE WHEN trim(c[1]) IN ('B', 'C') THEN 'MARKER' WHEN len(c) < 5 THEN 'SHORT' ELSE 'DATA' END AS kind FROM cols""")

cte("rows_", "kinds", """
SELECT k, line_num, k * 1000 + line_num AS seq, 'CDC_TXN_' || k || '.csv' AS file_name,
       upper(trim(c[1])) AS op, lower(trim(c[2])) AS src_table, lower(trim(c[3])) AS src_schema,
       trim(c[4]) AS event_ts, c[5:] AS d FROM kinds WHERE kind = 'DATA'""")

cte("named_policy", "rows_", """
SELECT seq, k, op, event_ts, trim(d[1]) AS policy_id, trim(d[2]) AS policy_num, trim(d[3]) AS policy_holder_name,
       trim(d[4]) AS policy_type, trim(d[5]) AS effective_date, trim(d[6]) AS expiry_date, trim(d[7]) AS premium_amount,
       trim(d[8]) AS created_at, trim(d[9]) AS last_modified, trim(d[10]) AS datasync_flag
FROM rows_ WHERE src_schema = 'insurance' AND src_table = 'policy'""")

cte("named_claim", "rows_", """
SELECT seq, k, op, event_ts, trim(d[1]) AS claim_id, trim(d[2]) AS claim_num, trim(d[3]) AS policy_id,
       trim(d[4]) AS policy_num, trim(d[5]) AS claimant_name, trim(d[6]) AS claim_amount, trim(d[7]) AS claim_status,
       trim(d[8]) AS incident_date, trim(d[9]) AS created_at, trim(d[10]) AS last_modified, trim(d[11]) AS datasync_flag
FROM rows_ WHERE src_schema = 'insurance' AND src_table = 'claim'""")

_DIRECT = "CASE WHEN {0} NOT IN ('', 'NULL') THEN {0} END"
_ZERO = "coalesce(TRY_CAST({0} AS DECIMAL(30,10)), 0)"


def direct(name: str, kind: str) -> str:
    return f"TRY_CAST({_DIRECT.format(name)} AS {kind}) AS {name}"


cte("typed_policy", "named_policy", f"""
SELECT seq, op, datasync_flag AS flag, event_ts, TRY_CAST(policy_id AS BIGINT) AS policy_id, {direct('policy_num', 'VARCHAR')},
       CASE WHEN policy_holder_name NOT IN ('', 'NULL') THEN policy_holder_name END AS policy_holder_name,
       CASE WHEN policy_type NOT IN ('', 'NULL') THEN upper(policy_type) END AS policy_type,
       {direct('effective_date', 'DATE')}, {direct('expiry_date', 'DATE')},
       TRY_CAST({_ZERO.format('premium_amount')} AS DECIMAL(12,2)) AS premium_amount,
       {direct('created_at', 'TIMESTAMP')}, {direct('last_modified', 'TIMESTAMP')} FROM named_policy""")

cte("typed_claim", "named_claim", f"""
SELECT seq, op, datasync_flag AS flag, event_ts, TRY_CAST(claim_id AS BIGINT) AS claim_id, {direct('claim_num', 'VARCHAR')},
       TRY_CAST(policy_id AS BIGINT) AS policy_id, {direct('policy_num', 'VARCHAR')},
       CASE WHEN claimant_name NOT IN ('', 'NULL') THEN claimant_name END AS claimant_name,
       TRY_CAST({_ZERO.format('claim_amount')} AS DECIMAL(12,2)) AS claim_amount,
       CASE WHEN claim_status IS NULL OR claim_status IN ('', 'NULL') THEN '' ELSE claim_status END AS claim_status,
       TRY_CAST(CASE WHEN incident_date IS NULL OR incident_date IN ('', 'NULL') THEN '1900-01-01'
                     ELSE incident_date END AS DATE) AS incident_date,
       {direct('created_at', 'TIMESTAMP')}, {direct('last_modified', 'TIMESTAMP')} FROM named_claim""")


def folded(source: str, key: str, values: str, flag: str = "datasync_flag", ok: str = "true",
           lm: str = "last_modified") -> str:
    """Decisions of the ordered fold, stretch by stretch."""
    return f"""
SELECT *, CASE WHEN guarded THEN 'GUARD' WHEN asks AND prior IS NOT NULL AND lm_ < prior THEN 'LWW'
               WHEN NOT ok_ THEN 'INVALID' ELSE 'APPLY' END AS decision
FROM (SELECT *, max(CASE WHEN NOT guarded AND ok_ AND op <> 'D' THEN lm_ END) OVER (
             PARTITION BY {key}, stretch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
      FROM (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY seq) AS stretch
            FROM (SELECT *, NOT guarded AND ok_ AND NOT asks AS opens
                  FROM (SELECT seq, {key}, op, {values}, CAST({lm} AS TIMESTAMP) AS lm_, ({ok}) AS ok_,
                               coalesce(upper({flag}), '') = 'CLOUD' AND op = 'I' AS guarded,
                               coalesce(upper({flag}), '') = 'CLOUD' AND op = 'U' AND {lm} IS NOT NULL AS asks
                        FROM {source}))))"""


cte("feed_folded", "feed", folded("feed", "pk", "payload, props, last_modified, datasync_flag, event_ts"))
cte("feed_state", "feed_folded", """
SELECT * FROM feed_folded WHERE decision = 'APPLY'
QUALIFY row_number() OVER (PARTITION BY pk ORDER BY seq DESC) = 1""")

_POLICY_OK = """op = 'D' OR (policy_num IS NOT NULL AND length(policy_num) <= 50 AND policy_holder_name IS NOT NULL
 AND policy_type IS NOT NULL AND effective_date IS NOT NULL AND expiry_date IS NOT NULL AND premium_amount IS NOT NULL
 AND created_at IS NOT NULL AND last_modified IS NOT NULL)"""
cte("policy_folded", "typed_policy", folded(
    "typed_policy", "policy_id", "policy_num, policy_holder_name, policy_type, effective_date, expiry_date, "
    "premium_amount, created_at, last_modified", "flag", _POLICY_OK))
cte("policy_last", "policy_folded", """
SELECT * FROM policy_folded WHERE decision = 'APPLY'
QUALIFY row_number() OVER (PARTITION BY policy_id ORDER BY seq DESC) = 1""")
cte("claim_folded", "typed_claim", folded(
    "typed_claim", "claim_id", "policy_id, claim_num", "flag",
    "op = 'D' OR (claim_num IS NOT NULL AND policy_id IS NOT NULL AND created_at IS NOT NULL AND last_modified IS NOT NULL)"))
cte("claim_last", "claim_folded", """
SELECT * FROM claim_folded WHERE decision = 'APPLY'
QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY seq DESC) = 1""")

# -- metadata
_SEED_MAPS = """(VALUES (1, 'insurance', 'policy', 'insurance', 'policy', 'BOTH', 1), (2, 'insurance', 'policy', 'insurance', 'policy_keyring', 'BOTH', 2),
 (3, 'insurance', 'claim', 'insurance', 'claim', 'BOTH', 1), (4, 'insurance', 'claim', 'insurance', 'claim_keyring', 'BOTH', 2),
 (9, 'app', 'account', 'app', 'account', 'CDC', 1)) t(map_id, src_schema, src_tbl_nam, dst_schema, dstn_tbl_nam, stream_type, load_order)"""
cte("maps", "", f"""
SELECT CAST(s_suppkey * 2 + 100 AS INTEGER) AS map_id, 'wide' AS src_schema, 't' || (s_suppkey // 4) AS src_tbl_nam,
       'd' || s_suppkey AS dstn_tbl_nam, s_suppkey % 7 <> 0 AS is_active,
       CASE s_suppkey % 3 WHEN 0 THEN 'CDC' WHEN 1 THEN 'FULL_LOAD' ELSE 'BOTH' END AS stream_type,
       CAST(s_suppkey % 4 + 1 AS INTEGER) AS load_order, s_nationkey AS conn FROM supplier
UNION ALL
SELECT CAST(s_suppkey * 2 + 101 AS INTEGER), 'wide', 't' || (s_suppkey // 4), 'e' || s_suppkey, s_suppkey % 7 <> 0,
       CASE s_suppkey % 3 WHEN 0 THEN 'CDC' WHEN 1 THEN 'FULL_LOAD' ELSE 'BOTH' END,
       CAST(s_suppkey % 4 + 1 AS INTEGER), s_nationkey FROM supplier WHERE s_acctbal < 0
UNION ALL
SELECT map_id, src_schema, src_tbl_nam, dstn_tbl_nam, true, stream_type, load_order, 2 FROM {_SEED_MAPS}""")

# Map, place, source field, target field, method.
_SEED_RULES = [
    (1, 1, "policy_id", "policy_id", "LEGACY_REF"),
    (1, 2, "policy_num", "policy_num", "DIRECT"),
    (1, 3, "policy_holder_name", "policy_holder_name", "TRIM"),
    (1, 4, "policy_type", "policy_type", "UPPERCASE"),
    (1, 5, "effective_date", "effective_date", "DIRECT"),
    (1, 6, "expiry_date", "expiry_date", "DIRECT"),
    (1, 7, "premium_amount", "premium_amount", "NULL_TO_ZERO"),
    (1, 8, "created_at", "created_at", "DIRECT"),
    (1, 9, "last_modified", "last_modified", "DIRECT"),
    (1, 10, "datasync_flag", "datasync_flag", "DIRECT"),
    (2, 1, "policy_num", "legacy_policy_num", "DIRECT"),
    (3, 1, "claim_id", "claim_id", "LEGACY_REF"),
    (3, 2, "claim_num", "claim_num", "DIRECT"),
    (3, 3, "policy_id", "policy_id", "LEGACY_REF"),
    (3, 4, "policy_num", "policy_num", "DIRECT"),
    (3, 5, "claimant_name", "claimant_name", "TRIM"),
    (3, 6, "claim_amount", "claim_amount", "NULL_TO_ZERO"),
    (3, 7, "claim_status", "claim_status", "NULL_TO_BLANK"),
    (3, 8, "incident_date", "incident_date", "NULL_TO_DATE"),
    (3, 9, "created_at", "created_at", "DIRECT"),
    (3, 10, "last_modified", "last_modified", "DIRECT"),
    (3, 11, "datasync_flag", "datasync_flag", "DIRECT"),
    (4, 1, "claim_num", "legacy_claim_num", "DIRECT"),
    (9, 1, "account_id", "account_id", "LEGACY_REF"),
    (9, 2, "payload", "payload", "NULL_TO_ZERO"),
    (9, 3, "props", "props", "DIRECT"),
    (9, 4, "last_modified", "last_modified", "DIRECT"),
    (9, 5, "datasync_flag", "datasync_flag", "DIRECT"),
]
_values = ", ".join(map(str, _SEED_RULES))
cte("seed_rules", "", f"""
SELECT CAST(map_id AS INTEGER) AS map_id, CAST(i AS INTEGER) AS pos, src, dst, method,
       CAST(row_number() OVER (ORDER BY map_id, i) - 1000 AS INTEGER) AS rule_id
FROM (VALUES {_values}) v(map_id, i, src, dst, method)""")
cte("rules", "seed_rules", """
SELECT DISTINCT CAST(l_suppkey * 10 + l_linenumber AS INTEGER) AS rule_id, CAST(l_suppkey * 2 + 100 AS INTEGER) AS map_id,
       'f' || l_linenumber AS src_field_name, 'g' || l_linenumber AS dstn_field_name,
       ['DIRECT', 'NULL_TO_BLANK', 'NULL_TO_ZERO', 'NULL_TO_DATE', 'LEGACY_REF', 'UPPERCASE', 'TRIM', 'SKIP',
        'UUID_GENERATE', 'SKIP_NULL_CONVERSION'][1 + (l_suppkey + l_linenumber) % 10] AS conversion_method,
       CAST(l_linenumber * 10 AS INTEGER) AS column_order FROM lineitem
UNION ALL SELECT rule_id, map_id, src, dst, method, pos FROM seed_rules""")

# -- change files ------------------------------------------------------------------
oracle("landing_files", "lines", """
SELECT CAST(k // 2000 AS BIGINT) AS part, CAST(sum(strlen(line) + 1) AS BIGINT) AS file_size,
       CAST(0 AS INTEGER) AS retry_count, false AS is_retry FROM lines GROUP BY 1""")
oracle("cdc_parse", "kinds", """
SELECT part, line_num, upper(trim(c[1])) AS op, lower(trim(c[2])) AS src_table, lower(trim(c[3])) AS src_schema,
       trim(c[4]) AS event_ts, CAST(len(c) - 4 AS BIGINT) AS n_data, c[5] AS c1, c[6] AS c2, c[7] AS c3
FROM (SELECT CAST(k // 2000 AS BIGINT) AS part, kind, c,
             row_number() OVER (PARTITION BY k // 2000 ORDER BY k, line_num) AS line_num FROM kinds)
WHERE kind = 'DATA'""")
oracle("cdc_markers", "kinds", "SELECT kind, count(*) AS line_count FROM kinds GROUP BY kind")
oracle("cdc_short_rows", "kinds", """
SELECT 'CDC_TXN_' || k || '.csv' AS file_name, CAST(line_num AS INTEGER) AS line_num, CAST(len(c) AS BIGINT) AS n_cols,
       'SHORT_ROW' AS reason FROM kinds WHERE kind = 'SHORT'""")
oracle("cdc_header", "rows_", "SELECT seq, op, src_table, src_schema, event_ts FROM rows_")
oracle("cdc_named", "named_policy", "SELECT * EXCLUDE (k) FROM named_policy")
oracle("cdc_ragged", "rows_", """
SELECT seq, src_table, CAST(w AS BIGINT) AS n_fields, CAST(greatest(w - len(d), 0) AS BIGINT) AS n_missing,
       CAST(greatest(len(d) - w, 0) AS BIGINT) AS n_extra, trim(d[w - 1]) AS last_modified
FROM (SELECT *, CASE src_table WHEN 'policy' THEN 10 ELSE 11 END AS w FROM rows_
      WHERE src_schema = 'insurance' AND src_table IN ('policy', 'claim'))""")
oracle("pk_extract", "rows_", """
SELECT seq, src_table, src_table || '_id=' || trim(d[1]) AS pk_text FROM rows_
WHERE src_schema = 'insurance' AND src_table IN ('policy', 'claim')""")
oracle("cdc_unaddressed", "rows_", """
SELECT file_name, CAST(line_num AS INTEGER) AS line_num, op, src_schema FROM rows_ WHERE src_table = '' OR src_schema = ''""")
oracle("unmapped_rows", "rows_", f"""
SELECT {uuid_of('file_name')} AS event_id, 'applier#2' AS job_step, 'applier' AS job_name, CAST(2 AS INTEGER) AS step_number,
       'FAILED' AS status, 'NO_MAPPINGS for ' || src_schema || '.' || src_table AS error_reason,
       CAST(event_ts AS TIMESTAMP) AS created_at
FROM rows_ WHERE src_table <> '' AND src_table NOT IN ('policy', 'claim')""")
oracle("file_summary", "rows_", """
SELECT file_name, count(*) AS total_rows,
       array_to_string(list_sort(list_distinct(list(CASE WHEN src_table <> '' THEN src_schema || '.' || src_table END))), ',') AS tables_seen
FROM rows_ GROUP BY file_name""")
cte("ranked", "rows_", """
SELECT *, CASE src_table WHEN 'policy' THEN 1 WHEN 'claim' THEN 3 ELSE 999 END AS dep_rank FROM rows_""")
oracle("fk_order", "ranked", """
SELECT file_name, CAST(line_num AS INTEGER) AS line_num, CAST(dep_rank AS BIGINT) AS dep_rank,
       row_number() OVER (PARTITION BY file_name ORDER BY dep_rank, line_num) AS position FROM ranked""")
oracle("files_reordered", "ranked", """
SELECT file_name, bool_or(dep_rank < highest) AS reordered
FROM (SELECT file_name, dep_rank, max(dep_rank) OVER (PARTITION BY file_name ORDER BY line_num) AS highest FROM ranked)
GROUP BY file_name""")

# -- metadata --------------------------------------------------------------------------
oracle("meta_catalog", "maps rules", """
SELECT map_id, src_schema || '.' || src_tbl_nam AS source, load_order, stream_type, count(*) AS n_rules,
       string_agg(src_field_name || ':' || dstn_field_name || ':' || conversion_method, ';' ORDER BY column_order) AS rule_text
FROM maps JOIN rules USING (map_id) WHERE is_active GROUP BY ALL""")
oracle("meta_lookup", "maps rules", """
SELECT m.map_id, src_tbl_nam, dstn_tbl_nam, 'conn-' || lower(n_name) AS connection_name,
       CASE WHEN n_regionkey < 2 THEN 'MYSQL' ELSE 'POSTGRESQL' END AS db_type,
       (SELECT count(*) FROM rules r WHERE r.map_id = m.map_id) AS n_rules
FROM maps m JOIN nation ON n_nationkey = m.conn WHERE is_active""")
oracle("meta_lint", "maps rules", """
SELECT m.map_id, src_tbl_nam, dstn_tbl_nam, load_order, stream_type, count(rule_id) AS rule_count
FROM maps m LEFT JOIN rules r ON r.map_id = m.map_id GROUP BY ALL""")
oracle("meta_active", "maps", "SELECT map_id, src_tbl_nam, load_order FROM maps WHERE is_active")
oracle("meta_stream", "maps", "SELECT map_id, stream_type FROM maps WHERE is_active AND stream_type <> 'CDC'")
oracle("meta_patch", "rules", """
SELECT rule_id, map_id, src_field_name,
       CASE WHEN src_field_name = 'f2' THEN 'new_' || dstn_field_name ELSE dstn_field_name END AS dstn_field_name
FROM rules WHERE src_field_name <> 'f7'""")
oracle("map_excluded", "maps rules", """
SELECT map_id, string_agg(dstn_field_name, ',' ORDER BY column_order) AS excluded FROM maps JOIN rules USING (map_id)
WHERE is_active AND (conversion_method IN ('SKIP', 'UUID_GENERATE') OR src_field_name = 'datasync_flag') GROUP BY map_id""")
oracle("dep_rank", "maps rules", """
SELECT src_schema, src_tbl_nam AS src_table, CAST(min(map_id) AS BIGINT) AS dep_rank FROM maps
WHERE is_active AND map_id IN (SELECT map_id FROM rules) GROUP BY ALL""")
oracle("fan_out", "rows_ maps", """
SELECT seq, op, m.map_id, dstn_tbl_nam, load_order FROM rows_ r
JOIN maps m ON m.src_schema = r.src_schema AND m.src_tbl_nam = r.src_table AND is_active""")

# -- projection and conversion -----------------------------------------------------------
oracle("map_policy", "typed_policy", "SELECT * EXCLUDE (flag, event_ts) FROM typed_policy")
oracle("map_claim", "typed_claim", "SELECT * EXCLUDE (flag, event_ts) FROM typed_claim")
oracle("cast_target", "named_policy", f"""
SELECT seq, TRY_CAST(effective_date AS DATE) AS effective_date,
       effective_date IS NOT NULL AND effective_date NOT IN ('', 'NULL') AND TRY_CAST(effective_date AS DATE) IS NULL AS bad_date,
       TRY_CAST({_ZERO.format('premium_amount')} AS DECIMAL(12,2)) AS premium_amount,
       abs({_ZERO.format('premium_amount')}) >= 10000000000 AS bad_premium FROM named_policy""")
cte("vals", "rows_", "SELECT seq, d[1] AS ref, d[3] AS name, d[7] AS money, d[8] AS day FROM rows_")
_BLANK = "({0} IS NULL OR trim({0}) IN ('', 'NULL'))"
oracle("conversions", "vals", f"""
SELECT seq, {_DIRECT.format('money')} AS direct_value, CASE WHEN {_BLANK.format('money')} THEN '' ELSE money END AS blank_value,
       CAST({_ZERO.format('money')} AS DECIMAL(18,4)) AS zero_value,
       NOT {_BLANK.format('money')} AND TRY_CAST(money AS DECIMAL(30,10)) IS NULL AS zero_warning,
       CASE WHEN {_BLANK.format('day')} THEN '2001-02-03' ELSE day END AS date_value,
       CASE WHEN {_BLANK.format('day')} THEN '1900-01-01' ELSE day END AS date_fallback,
       CASE WHEN NOT {_BLANK.format('ref')} THEN coalesce(CAST(TRY_CAST(ref AS BIGINT) AS VARCHAR), ref) END AS ref_value,
       CASE WHEN NOT {_BLANK.format('name')} THEN upper(name) END AS upper_value,
       CASE WHEN NOT {_BLANK.format('name')} THEN trim(name) END AS trim_value,
       money AS kept_value, CAST(NULL AS VARCHAR) AS uuid_value, {_DIRECT.format('money')} AS unknown_value FROM vals""")
oracle("custom_conversion", "named_policy", "SELECT seq, '****' || right(policy_num, 6) AS masked FROM named_policy")
oracle("delete_keys", "named_policy named_claim", """
SELECT seq, t AS table_name, v AS key_text FROM (
  SELECT seq, 'policy' AS t, policy_id AS v FROM named_policy WHERE op = 'D'
  UNION ALL SELECT seq, 'policy_keyring', policy_num FROM named_policy WHERE op = 'D'
  UNION ALL SELECT seq, 'claim', claim_id FROM named_claim WHERE op = 'D'
  UNION ALL SELECT seq, 'claim_keyring', claim_num FROM named_claim WHERE op = 'D')""")
oracle("validate_rows", "typed_policy named_policy", """
SELECT seq, e AS errors FROM (
  SELECT t.seq, concat_ws(';',
    CASE WHEN length(t.policy_num) > 50 THEN 'LENGTH:policy_num' END,
    CASE WHEN t.policy_type IS NULL THEN 'NOT_NULL:policy_type' END,
    CASE WHEN n.effective_date IS NULL THEN 'NOT_NULL:effective_date' WHEN t.effective_date IS NULL THEN 'TYPE:effective_date' END,
    CASE WHEN t.expiry_date IS NULL THEN 'NOT_NULL:expiry_date' END,
    CASE WHEN t.premium_amount IS NULL THEN 'RANGE:premium_amount' END,
    CASE WHEN t.created_at IS NULL THEN 'NOT_NULL:created_at' END,
    CASE WHEN t.last_modified IS NULL THEN 'NOT_NULL:last_modified' END) AS e
  FROM typed_policy t JOIN named_policy n ON n.seq = t.seq WHERE t.op <> 'D') WHERE e <> ''""")
cte("doubled", "policy_src", """
SELECT policy_id, policy_num FROM policy_src
UNION ALL SELECT policy_id + 1, policy_num FROM policy_src WHERE (policy_id // 2) % 101 = 0""")
oracle("unique_violations", "doubled", """
SELECT policy_id, policy_num FROM (SELECT *, count(*) OVER (PARTITION BY policy_num) AS c FROM doubled) WHERE c > 1""")
oracle("fk_violations", "claim_src policy_tgt", """
SELECT claim_id, policy_id FROM claim_src WHERE policy_id NOT IN (SELECT policy_id FROM policy_tgt)""")

# -- guard and fold --------------------------------------------------------------------------
oracle("circular_guard", "feed", """
SELECT seq, op, datasync_flag, coalesce(datasync_flag = 'CLOUD' AND op = 'I', false) AS blocked FROM feed""")
oracle("lww_decisions", "feed_folded", "SELECT seq, pk, op, decision FROM feed_folded")
_STATE = "SELECT pk, payload, props, last_modified, seq AS last_seq FROM feed_state WHERE op <> 'D'"
for _name in ("apply_feed", "apply_feed_split", "apply_replay", "apply_onto_base"):
    oracle(_name, "feed_state", _STATE)
for _name in ("stream_apply", "stream_replay"):
    oracle(_name, "feed_state", "SELECT pk, payload, props, last_modified FROM feed_state WHERE op <> 'D'")
oracle("apply_defaults", "feed_folded feed_state", f"""
SELECT s.pk, s.payload, f.first_seq, {uuid_of('CAST(f.first_seq AS VARCHAR)')} AS account_uuid
FROM feed_state s JOIN (
  SELECT a.pk, min(a.seq) AS first_seq FROM feed_folded a
  LEFT JOIN (SELECT pk, max(seq) AS gone FROM feed_folded WHERE decision = 'APPLY' AND op = 'D' GROUP BY pk) d ON d.pk = a.pk
  WHERE a.decision = 'APPLY' AND a.op <> 'D' AND a.seq > coalesce(d.gone, -1) GROUP BY a.pk) f ON f.pk = s.pk
WHERE s.op <> 'D'""")
_POLICY_COLS = ("policy_id, policy_num, policy_holder_name, policy_type, effective_date, expiry_date, "
                "premium_amount, created_at, last_modified")
oracle("apply_upsert", "policy_last", f"SELECT {_POLICY_COLS} FROM policy_last WHERE op <> 'D'")
oracle("apply_delete", "policy_last", "SELECT policy_id, seq AS last_seq FROM policy_last WHERE op = 'D'")
# the keyring takes every number it is shown, first come first kept, unless the number is refused or deleted
cte("ring_events", "typed_policy", """
SELECT *, CASE WHEN coalesce(upper(flag), '') = 'CLOUD' AND op = 'I' THEN 'GUARD'
               WHEN op <> 'D' AND length(policy_num) > 50 THEN 'INVALID' ELSE 'APPLY' END AS decision FROM typed_policy""")
oracle("keyring_cdc", "ring_events", f"""
SELECT policy_num AS legacy_policy_num, {uuid_of("'demo-salt' || policy_num")} AS policy_uuid,
       CAST(arg_min(event_ts, seq) AS TIMESTAMP) AS created_at
FROM ring_events r WHERE decision = 'APPLY' AND op <> 'D'
  AND seq > coalesce((SELECT max(seq) FROM ring_events x WHERE x.policy_num = r.policy_num AND x.op = 'D'), -1)
GROUP BY policy_num""")
oracle("apply_isolated", "policy_folded claim_folded ring_events typed_claim", """
SELECT 'insurance.policy' AS table_name, decision, count(*) AS event_count FROM policy_folded GROUP BY decision
UNION ALL SELECT 'insurance.policy_keyring', decision, count(*) FROM ring_events GROUP BY decision
UNION ALL SELECT 'insurance.claim', decision, count(*) FROM claim_folded GROUP BY decision
UNION ALL SELECT 'insurance.claim_keyring', CASE WHEN coalesce(upper(flag), '') = 'CLOUD' AND op = 'I' THEN 'GUARD'
  ELSE 'APPLY' END AS d, count(*) FROM typed_claim GROUP BY d""")
cte("standing", "policy_folded", "SELECT DISTINCT policy_id FROM policy_folded WHERE decision = 'APPLY' AND op <> 'D'")
cte("wave_claims", "claim_folded standing", """
SELECT claim_id, policy_id, seq, op FROM claim_folded
WHERE decision = 'APPLY' AND (op = 'D' OR policy_id IN (SELECT policy_id FROM standing))
QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY seq DESC) = 1""")
oracle("apply_waves", "policy_folded policy_last wave_claims", """
SELECT 'claim' AS table_name, claim_id AS id, seq AS last_seq FROM wave_claims WHERE op <> 'D'
UNION ALL SELECT 'policy', policy_id, seq FROM policy_last WHERE op <> 'D'
UNION ALL
SELECT 'policy', policy_id, max(seq) FROM policy_folded WHERE decision = 'APPLY' AND op <> 'D'
  AND policy_id IN (SELECT policy_id FROM policy_last WHERE op = 'D')
  AND policy_id IN (SELECT policy_id FROM wave_claims WHERE op <> 'D') GROUP BY policy_id""")
oracle("fk_restrict", "typed_policy claim_last", """
SELECT DISTINCT policy_id FROM typed_policy WHERE op = 'D'
AND policy_id IN (SELECT policy_id FROM claim_last WHERE op <> 'D')""")

# -- loads, keys, tokens ---------------------------------------------------------------------
oracle("full_load", "policy_conv claim_src", """
SELECT policy_type, count(*) AS claim_count, CAST(sum(claim_amount) AS DECIMAL(18,2)) AS claimed,
       max(premium_amount) AS top_premium FROM claim_src JOIN policy_conv USING (policy_id) GROUP BY policy_type""")
oracle("load_gate", "policy_src claim_src", """
SELECT t AS table_name, n AS row_count, n > 0 AS is_loaded FROM (
  SELECT 'policy' AS t, count(*) AS n FROM policy_src UNION ALL SELECT 'claim', count(*) FROM claim_src
  UNION ALL SELECT 'nothing', count(*) FROM policy_src WHERE premium_amount < 0)""")
oracle("key_origin", "policy_tgt", """
SELECT CASE WHEN abs(policy_id) % 2 = 0 THEN 'LEGACY' ELSE 'CLOUD' END AS origin, count(*) AS row_count,
       count(*) FILTER ((abs(policy_id) % 2 = 1) <> (policy_num LIKE '%-X')) AS flag_differs FROM policy_tgt GROUP BY 1""")
cte("cloud_new", "policy_src", """
SELECT policy_id AS legacy_id, policy_num, CAST(999999 + 2 * row_number() OVER (ORDER BY policy_id) AS BIGINT) AS policy_id
FROM policy_src WHERE datasync_flag = 'CLOUD'""")
oracle("assign_keys", "cloud_new", "SELECT * FROM cloud_new")
oracle("key_collisions", "policy_src cloud_new", """
SELECT 'legacy' AS table_name, count(*) AS row_count FROM policy_src UNION ALL SELECT 'cloud', count(*) FROM cloud_new
UNION ALL SELECT 'collisions', count(*) FROM policy_src WHERE policy_id IN (SELECT policy_id FROM cloud_new)""")
oracle("binary_key", "", """
SELECT o_orderkey, o_orderkey % 50 <> 0 AS is_valid, CAST(CASE WHEN o_orderkey % 50 <> 0 THEN 9 END AS BIGINT) AS n_bytes,
       CASE WHEN o_orderkey % 50 <> 0 THEN lpad(printf('%X', o_orderkey), 18, '0') END AS round_trip FROM orders""")
cte("old_ring", "policy_tgt", """
SELECT policy_num AS num, 3999999 + 2 * row_number() OVER (ORDER BY policy_id) AS id FROM policy_tgt""")
cte("policy_ring", "old_ring policy_src", f"""
SELECT CAST(id AS BIGINT) AS keyring_id, {uuid_of("'demo-salt' || num")} AS policy_uuid, num AS legacy_policy_num FROM (
  SELECT num, id FROM old_ring UNION ALL
  SELECT policy_num, (SELECT max(id) FROM old_ring) + 2 * row_number() OVER (ORDER BY policy_id) FROM policy_src
  WHERE policy_num NOT IN (SELECT num FROM old_ring))""")
oracle("keyring_load", "policy_ring", "SELECT * FROM policy_ring")
oracle("keyring_counts", "policy_src policy_ring claim_src", """
SELECT 'policy' AS table_name, count(*) AS row_count FROM policy_src
UNION ALL SELECT 'policy_keyring', count(*) FROM policy_ring
UNION ALL SELECT 'claim', count(*) FROM claim_src
UNION ALL SELECT 'claim_keyring', count(DISTINCT claim_num) FROM claim_src""")
oracle("keyring_gaps", "policy_src policy_tgt", """
SELECT policy_num AS number, 'NO_TOKEN' AS gap FROM policy_src WHERE policy_num NOT IN (SELECT policy_num FROM policy_tgt)
UNION ALL SELECT policy_num, 'NO_BASE_ROW' FROM policy_tgt WHERE policy_num NOT IN (SELECT policy_num FROM policy_src)""")
oracle("token_lookup", "policy_src policy_ring", """
SELECT policy_num, policy_uuid FROM policy_src JOIN policy_ring ON legacy_policy_num = policy_num ORDER BY policy_num LIMIT 3""")
oracle("tokenise", "claim_src", f"""
SELECT claim_id, claim_amount, {uuid_of("'demo-salt' || policy_num")} AS policy_uuid FROM claim_src""")
oracle("detokenise", "claim_src", "SELECT claim_id, claim_amount, policy_num FROM claim_src")

# -- outcomes, audit, retry --------------------------------------------------------------------
cte("outcome_in", "feed", """
SELECT *, 'feed_' || CAST(event_ts AS DATE) AS file_name, event_ts + to_seconds(CAST(seq * 7 % 90 AS INTEGER)) AS applied_at FROM feed""")
cte("outcome_fold", "outcome_in", folded(
    "outcome_in", "pk", "payload, props, last_modified, datasync_flag, event_ts, file_name, applied_at",
    ok="payload <= 100"))
cte("outcomes", "outcome_fold", f"""
SELECT *, {uuid_of('file_name')} AS event_id,
       CASE decision WHEN 'APPLY' THEN 'SUCCESS' WHEN 'INVALID' THEN
            CASE WHEN attempts >= 3 THEN 'PERMANENT_FAILED' ELSE 'FAILED' END ELSE 'SKIP' END AS status,
       CASE decision WHEN 'GUARD' THEN 3 WHEN 'LWW' THEN 4 ELSE 5 END AS step,
       CASE WHEN payload > 100 THEN 'payload out of range: ' || repeat(CAST(payload AS VARCHAR), 120) END AS message
FROM (SELECT *, CAST(seq % 3 + CASE WHEN decision = 'INVALID' THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM outcome_fold)""")
oracle("status_decision", "outcomes", "SELECT seq, decision, status, attempts AS retry_count FROM outcomes")
cte("audited", "outcomes", """
SELECT event_id, 'app.account' AS table_name, op AS operation, seq, CAST(payload AS VARCHAR) AS payload, datasync_flag AS flag,
       CAST(5 + CASE WHEN datasync_flag IS NULL THEN 0 ELSE 1 END - CASE WHEN props IS NULL THEN 1 ELSE 0 END AS BIGINT) AS n_fields,
       '9' AS map_id, status, attempts AS retry_count, false AS reprocess_flag,
       CAST(floor(epoch(applied_at)) AS BIGINT) + CASE WHEN status IN ('SUCCESS', 'SKIP') THEN 90 ELSE 180 END * 86400 AS ttl_epoch,
       applied_at AS created_at, CAST(length(left(message, 1000)) AS BIGINT) AS error_chars FROM outcomes""")
oracle("audit_log", "audited", "SELECT * FROM audited")
cte("used", "outcomes", """
SELECT event_id, 'applier#' || step AS job_step, 'applier' AS job_name, CAST(step AS INTEGER) AS step_number, status,
       applied_at AS created_at FROM outcomes WHERE status IN ('SUCCESS', 'SKIP')""")
oracle("utilization", "used", "SELECT * FROM used")
cte("failures", "outcomes", """
SELECT event_id, 'applier#5' AS job_step, 'applier' AS job_name, CAST(5 AS INTEGER) AS step_number, status,
       left(message, 500) AS error_reason, applied_at AS created_at FROM outcomes WHERE status LIKE '%FAILED'
UNION ALL
SELECT event_id, 'applier#6', 'applier', 6, 'DLQ', 'handed to the dead letters after attempt ' || attempts, applied_at
FROM outcomes WHERE status = 'FAILED'""")
oracle("faults", "failures", "SELECT * FROM failures")
oracle("dead_letters", "outcomes", """
SELECT event_id, seq, op, 'app' AS src_schema, 'account' AS src_table, attempts AS retry_count, true AS is_retry
FROM outcomes WHERE status = 'FAILED'""")
oracle("retry_plan", "outcomes", """
SELECT seq, attempts AS retry_count, CASE WHEN attempts < 3 THEN 'REQUEUE' ELSE 'DISCARD' END AS action
FROM outcomes WHERE decision = 'INVALID'""")
oracle("retry_totals", "outcomes", """
SELECT count(*) FILTER (attempts < 3) AS requeued, count(*) FILTER (attempts >= 3) AS discarded
FROM outcomes WHERE decision = 'INVALID'""")
oracle("audit_current", "audited", """
SELECT * FROM audited QUALIFY row_number() OVER (PARTITION BY event_id, table_name ORDER BY created_at DESC, seq DESC) = 1""")
oracle("audit_retention", "audited", """
SELECT status, count(*) AS kept, min(ttl_epoch) AS first_ttl FROM audited
WHERE ttl_epoch > epoch(TIMESTAMP '2024-04-10 12:00:00') GROUP BY status""")
oracle("reprocess_feed", "outcomes", """
SELECT op, 'app' AS src_schema, 'account' AS src_table, event_ts, seq, pk, payload, props, datasync_flag, last_modified,
       attempts AS retry_count, status = 'FAILED' AS is_retry
FROM outcomes WHERE status = 'FAILED' OR (status = 'PERMANENT_FAILED' AND seq % 2 = 0)""")
oracle("step_trace", "used failures", """
SELECT event_id, 'SUCCESS' AS step_1, CAST(NULL AS VARCHAR) AS step_2, CAST(0 AS BIGINT) AS failed_1, CAST(NULL AS BIGINT) AS failed_2,
       any_value(status) FILTER (step_number = 3) AS step_3, any_value(failed) FILTER (step_number = 3) AS failed_3,
       any_value(status) FILTER (step_number = 4) AS step_4, any_value(failed) FILTER (step_number = 4) AS failed_4,
       any_value(status) FILTER (step_number = 5) AS step_5, any_value(failed) FILTER (step_number = 5) AS failed_5,
       any_value(status) FILTER (step_number = 6) AS step_6, any_value(failed) FILTER (step_number = 6) AS failed_6
FROM (SELECT event_id, step_number, status,
             count(*) FILTER (status IN ('FAILED', 'PERMANENT_FAILED', 'DLQ')) OVER (PARTITION BY event_id, step_number) AS failed
      FROM (SELECT event_id, step_number, status, created_at FROM used
            UNION ALL SELECT event_id, step_number, status, created_at FROM failures)
      QUALIFY row_number() OVER (PARTITION BY event_id, step_number ORDER BY created_at DESC,
          CASE status WHEN 'SUCCESS' THEN 0 WHEN 'SKIP' THEN 1 WHEN 'DLQ' THEN 2 WHEN 'FAILED' THEN 3 ELSE 4 END DESC) = 1)
GROUP BY event_id""")
oracle("status_counts", "outcomes", """
SELECT CAST(step AS INTEGER) AS step_number, decision, status, count(*) AS event_count FROM outcomes GROUP BY ALL""")
oracle("guard_scoreboard", "outcomes", """
SELECT file_name, count(*) FILTER (decision = 'GUARD') AS guard_blocked, count(*) FILTER (decision = 'LWW') AS age_blocked,
       count(*) FILTER (decision = 'APPLY') AS processed FROM outcomes GROUP BY file_name""")
oracle("sla_report", "outcomes", """
SELECT op, count(*) AS event_count, count(*) FILTER (decision = 'INVALID') AS failed_count,
       count(*) FILTER (seq * 7 % 90 >= 60) AS late_count, quantile_disc(seq * 7 % 90, 0.5) AS p50_seconds,
       quantile_disc(seq * 7 % 90, 0.95) AS p95_seconds, max(seq * 7 % 90) AS max_seconds FROM outcomes GROUP BY op""")

# -- reconciliation --------------------------------------------------------------------------------
cte("compared", "policy_conv policy_tgt", """
SELECT policy_id, paired AND s.policy_num IS DISTINCT FROM t.policy_num AS diff_policy_num,
       paired AND s.policy_holder_name IS DISTINCT FROM t.policy_holder_name AS diff_policy_holder_name,
       paired AND s.policy_type IS DISTINCT FROM t.policy_type AS diff_policy_type,
       paired AND s.premium_amount IS DISTINCT FROM t.premium_amount AS diff_premium_amount,
       paired AND s.last_modified IS DISTINCT FROM t.last_modified AS diff_last_modified,
       CASE WHEN t.policy_num IS NULL THEN 'MISSING'
            WHEN s.policy_num IS NULL THEN CASE WHEN abs(policy_id) % 2 = 1 THEN 'CLOUD_ROW' ELSE 'ORPHAN' END
            WHEN s.policy_num <> t.policy_num OR s.policy_holder_name <> t.policy_holder_name OR s.policy_type <> t.policy_type
              OR s.premium_amount <> t.premium_amount OR s.last_modified <> t.last_modified THEN 'MISMATCH'
            ELSE 'MATCH' END AS verdict,
       coalesce(s.last_modified, t.last_modified) AS since, s, t
FROM (SELECT coalesce(a.policy_id, b.policy_id) AS policy_id, a AS s, b AS t, a.policy_id IS NOT NULL AND b.policy_id IS NOT NULL AS paired
      FROM policy_conv a FULL JOIN policy_tgt b ON a.policy_id = b.policy_id)""")
cte("found", "compared", "SELECT * FROM compared WHERE verdict NOT IN ('MATCH', 'CLOUD_ROW')")
oracle("recon_counts", "policy_src policy_tgt claim_src", """
SELECT *, source_count - target_count AS gap FROM (
  SELECT 'policy' AS table_name, (SELECT count(*) FROM policy_src) AS source_count, (SELECT count(*) FROM policy_tgt) AS target_count
  UNION ALL SELECT 'claim', count(*), count(incident_date) FROM claim_src)""")
oracle("recon_missing", "policy_src policy_tgt", """
SELECT policy_id, policy_num FROM policy_src WHERE policy_id NOT IN (SELECT policy_id FROM policy_tgt)""")
oracle("recon_orphans", "policy_src policy_tgt", """
SELECT policy_id, policy_num FROM policy_tgt WHERE policy_id % 2 = 0 AND policy_id NOT IN (SELECT policy_id FROM policy_src)""")
oracle("recon_rows", "compared", "SELECT * EXCLUDE (since, s, t) FROM compared")
oracle("recon_digest", "compared", "SELECT * EXCLUDE (since, s, t) FROM compared WHERE verdict <> 'MATCH'")
oracle("recon_drift", "found", """
SELECT policy_id, verdict, since, TIMESTAMP '1999-01-01 00:00:00' - INTERVAL 24 HOUR > since AS breach FROM found""")
oracle("recon_repair", "found", """
SELECT CASE verdict WHEN 'MISSING' THEN 'I' WHEN 'ORPHAN' THEN 'D' ELSE 'U' END AS op, policy_id,
       coalesce(s.policy_num, t.policy_num) AS policy_num, coalesce(s.policy_holder_name, t.policy_holder_name) AS policy_holder_name,
       coalesce(s.policy_type, t.policy_type) AS policy_type, coalesce(s.premium_amount, t.premium_amount) AS premium_amount,
       since AS last_modified, CAST(NULL AS VARCHAR) AS datasync_flag, since AS event_ts FROM found""")
oracle("recon_history", "found", """
SELECT 'run-1' AS run_id, 'insurance.policy' AS table_name, verdict, CAST(policy_id AS VARCHAR) AS row_key FROM found""")
oracle("recon_alert", "found", """
SELECT 'run-1' AS run_id, 'insurance.policy' AS table_name, verdict, count(*) AS row_count FROM found GROUP BY verdict""")
oracle("recon_converged", "policy_src policy_tgt", """
SELECT 'MATCH' AS verdict, count(*) AS row_count FROM policy_src
UNION ALL SELECT 'CLOUD_ROW', count(*) FROM policy_tgt WHERE abs(policy_id) % 2 = 1""")

# -- reverse sync -------------------------------------------------------------------------------------
oracle("stream_balance", "kinds rows_", """
SELECT ending, count(*) AS line_count FROM (
  SELECT kind || '_ROW' AS ending FROM kinds WHERE kind IN ('SHORT', 'OPEN_QUOTE')
  UNION ALL SELECT CASE WHEN src_table = '' OR src_schema = '' THEN 'UNADDRESSED_ROW'
                        WHEN src_table NOT IN ('policy', 'claim') THEN 'UNMAPPED_ROW' ELSE 'OUTCOME' END FROM rows_)
GROUP BY ending""")
oracle("fault_lines", "kinds rows_ lines", """
SELECT reason AS error_reason, k * 1000 + line_num AS line_pos, line FROM (
  SELECT k, line_num, kind || '_ROW' AS reason FROM kinds WHERE kind IN ('SHORT', 'OPEN_QUOTE')
  UNION ALL SELECT k, line_num, CASE WHEN src_table = '' OR src_schema = '' THEN 'UNADDRESSED_ROW' ELSE 'UNMAPPED_ROW' END
  FROM rows_ WHERE src_table = '' OR src_schema = '' OR src_table <> 'claim') JOIN lines USING (k, line_num)""")
oracle("stream_unique", "", """
SELECT o_orderkey, CASE WHEN turn = 1 OR freed AND turn = 2 THEN 'SUCCESS' ELSE 'PERMANENT_FAILED' END AS status,
       CAST(CASE WHEN turn = 1 THEN 0 WHEN freed AND turn = 2 THEN 2 ELSE 3 END AS INTEGER) AS retry_count,
       CASE WHEN turn = 1 OR freed AND turn = 2 THEN '' ELSE 'UNIQUE:o_custkey' END AS error_message,
       CASE WHEN freed THEN turn = 2 ELSE turn = 1 END AS held
FROM (SELECT o_orderkey, o_custkey % 7 = 0 AS freed, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn
      FROM orders)""")
oracle("stream_retention", "", """
SELECT 'FAILED' AS status, CAST(DATE '2026-01-01' + 180 AS VARCHAR) AS expires_on, count(*) AS row_count
FROM (SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS turn FROM orders) WHERE turn > 1
HAVING count(*) > 0""")
oracle("stream_dependents", "", """
WITH items AS (SELECT DISTINCT l_orderkey, l_linenumber, l_orderkey IN (SELECT o_orderkey FROM orders) AS known FROM lineitem),
said AS (
  SELECT 1 AS batch_id, 't.orders' AS table_name, 'I' AS op, 'FAILED' AS status, 'broken rule' AS reason FROM orders
  UNION ALL SELECT 1, 't.lines', 'I', 'FAILED', 'FOREIGN_KEY:l_orderkey' FROM items
  UNION ALL SELECT 2, 't.orders', 'I', 'SUCCESS', '' FROM orders
  UNION ALL SELECT 2, 't.lines', 'I', CASE WHEN known THEN 'SUCCESS' ELSE 'FAILED' END,
                   CASE WHEN known THEN '' ELSE 'FOREIGN_KEY:l_orderkey' END FROM items
  UNION ALL SELECT 3, 't.lines', 'I', 'PERMANENT_FAILED', 'FOREIGN_KEY:l_orderkey' FROM items WHERE NOT known
  UNION ALL SELECT 3, 't.orders', 'D', CASE WHEN used THEN 'FAILED' ELSE 'SUCCESS' END,
                   CASE WHEN used THEN 'RESTRICT:o_orderkey' ELSE '' END
            FROM (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem) AS used FROM orders WHERE o_orderkey % 5 = 0))
SELECT CAST(batch_id AS INTEGER) AS batch_id, table_name, op, status, reason, count(*) AS row_count FROM said GROUP BY ALL""")
oracle("stream_new_table", "", """
SELECT 't.nation' AS name, count(*) AS row_count FROM nation
UNION ALL SELECT 't.customer', count(*) FROM customer WHERE c_custkey % 2 = 1
UNION ALL SELECT 'UNMAPPED_ROW', count(*) FROM customer WHERE c_custkey % 2 = 0 HAVING count(*) > 0""")
oracle("reverse_feed", "feed", "SELECT seq, op, pk, payload, 'CLOUD' AS datasync_flag FROM feed")
oracle("loop_free", "feed", """
SELECT op, count(*) FILTER (op = 'I') AS blocked, CAST(0 AS BIGINT) AS inserts_returning FROM feed GROUP BY op""")
