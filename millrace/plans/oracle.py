"""Independent SQL for every query, written against the given tables for DuckDB."""

from __future__ import annotations

# -- shared relations ----------------------------------------------------------------------------

RELATIONS = {
    "lines": """
        SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (
                PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
                         l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn
            FROM lineitem)
        WHERE rn = 1""",
    "heads": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_nationkey AS location_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CAST(o_orderdate AS DATE) + 365 * CAST(left(o_orderpriority, 1) AS INTEGER) AS due_date,
               o_orderstatus AS source_status, c_custkey IS NOT NULL AS registered
        FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) AS k ON o_custkey = c_custkey""",
    "classified": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, customer_id, l_partkey AS product_id, location_id,
               order_date, CAST(l_shipdate AS DATE) AS ship_date, CAST(l_quantity AS BIGINT) AS quantity,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_returnflag = 'R' AS returned,
               CAST(l_shipdate AS DATE) < order_date AS soft_date, registered, p_partkey IS NOT NULL AS product_known,
               coalesce(registered AND p_partkey IS NOT NULL AND NOT (CAST(l_shipdate AS DATE) < order_date), false) AS line_eligible
        FROM lines LEFT JOIN heads ON l_orderkey = order_id LEFT JOIN part ON l_partkey = p_partkey""",
    "sales": "SELECT * FROM classified WHERE registered AND product_known",
    "good": "SELECT * FROM sales WHERE line_eligible",
    "per_order": """
        SELECT order_id, count(*) AS line_count, count(*) FILTER (WHERE line_eligible) AS eligible_lines,
               sum(amount) FILTER (WHERE line_eligible) AS booked, max(ship_date) AS delivered_date,
               bool_or(returned) AS any_returned
        FROM sales GROUP BY order_id""",
    "ord": """
        SELECT h.order_id, customer_id, location_id, r_name AS zone, order_date, due_date, delivered_date,
               CASE WHEN source_status = 'P' THEN 'CANCELLED' WHEN any_returned THEN 'RETURNED' ELSE 'COMPLETED' END AS order_status,
               CASE WHEN source_status = 'F' THEN 'PAID' ELSE 'OPEN' END AS payment_status,
               coalesce(line_count, 0) AS line_count, coalesce(eligible_lines, 0) AS eligible_lines,
               coalesce(booked, 0) AS booked, registered AS order_eligible,
               coalesce(registered AND delivered_date >= order_date AND due_date >= order_date, false) AS ship_eligible,
               coalesce(registered AND delivered_date >= order_date AND due_date >= order_date
                        AND delivered_date <= due_date, false) AS on_time,
               date_diff('day', order_date, delivered_date) AS delivery_days
        FROM heads h LEFT JOIN per_order p ON h.order_id = p.order_id
        LEFT JOIN nation ON location_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "eligible_orders": "SELECT * FROM ord WHERE order_eligible",
}


def _history(source: str, entity: str, at: str, state: str, tie: str, open_first: bool = False) -> str:
    """Versions from observations: last observation per instant, changes only, half-open intervals."""
    start = f"CASE WHEN before IS NULL THEN DATE '1900-01-01' ELSE {at} END" if open_first else at
    return f"""
        SELECT {entity}, {state}, {start} AS valid_from,
               lead({at}) OVER (PARTITION BY {entity} ORDER BY {at}) AS valid_to,
               lead({at}) OVER (PARTITION BY {entity} ORDER BY {at}) IS NULL AS is_current
        FROM (SELECT *, lag({state}) OVER (PARTITION BY {entity} ORDER BY {at}) AS before
              FROM (SELECT * FROM ({source}) QUALIFY row_number() OVER (PARTITION BY {entity}, {at} ORDER BY {tie}) = 1))
        WHERE before IS DISTINCT FROM {state}"""


_CUSTOMER_CHANGES = (
    "SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS changed_on, o_orderkey, o_orderpriority AS tier FROM orders"
)
RELATIONS |= {
    "customer_history": _history(_CUSTOMER_CHANGES, "customer_id", "changed_on", "tier", "o_orderkey DESC"),
    "product_history": _history(
        "SELECT *, l_partkey AS product_id, CAST(l_shipdate AS DATE) AS changed_on, l_suppkey AS supplier_id FROM lineitem",
        "product_id",
        "changed_on",
        "supplier_id",
        "l_orderkey DESC, l_linenumber DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC,"
        " l_returnflag DESC, l_linestatus DESC, l_suppkey DESC",
        open_first=True,
    ),
    "location_history": _history(
        "SELECT c_nationkey AS location_id, CAST(o_orderdate AS DATE) AS changed_on, o_orderkey, o_orderpriority AS tier"
        " FROM orders JOIN customer ON o_custkey = c_custkey",
        "location_id",
        "changed_on",
        "tier",
        "o_orderkey DESC",
        open_first=True,
    ),
    "status_events": """
        SELECT event_id, user_id AS entity_id, event_type AS status, ts AS event_ts,
               ts + to_minutes(CAST(floor(value) AS BIGINT)) AS arrival_ts FROM events""",
    "status_history": _history("SELECT * FROM status_events", "entity_id", "event_ts", "status", "event_id DESC"),
    "fact": """
        SELECT s.*, c.tier AS customer_tier, l.tier AS location_tier, p.supplier_id, n_name AS category
        FROM sales s
        LEFT JOIN customer_history c ON c.customer_id = s.customer_id AND order_date >= c.valid_from
             AND (order_date < c.valid_to OR c.valid_to IS NULL)
        LEFT JOIN location_history l ON l.location_id = s.location_id AND order_date >= l.valid_from
             AND (order_date < l.valid_to OR l.valid_to IS NULL)
        LEFT JOIN product_history p ON p.product_id = s.product_id AND order_date >= p.valid_from
             AND (order_date < p.valid_to OR p.valid_to IS NULL)
        LEFT JOIN supplier ON p.supplier_id = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey""",
    "days": """
        SELECT CAST(d AS DATE) AS order_date FROM (
            SELECT unnest(generate_series(date_trunc('year', min(o_orderdate)),
                   date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM orders)""",
}

_ORDER = [
    "lines", "heads", "classified", "sales", "good", "per_order", "ord", "eligible_orders", "customer_history",
    "product_history", "location_history", "status_events", "status_history", "fact", "days",
]


def _with(*names: str) -> str:
    """WITH clause of the named relations, in dependency order."""
    needs = {
        "classified": ["lines", "heads"],
        "sales": ["classified"],
        "good": ["sales"],
        "per_order": ["sales"],
        "ord": ["heads", "per_order"],
        "eligible_orders": ["ord"],
        "status_history": ["status_events"],
        "fact": ["sales", "customer_history", "location_history", "product_history"],
    }
    wanted, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += needs.get(name, [])
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({RELATIONS[n]})" for n in _ORDER if n in wanted)


def _ratio(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0)"


_SALES = "CAST(sum(amount) AS DOUBLE)"
_UNITS = "CAST(sum(quantity) AS BIGINT)"
_SALES_COLUMNS = (
    f"{_SALES} AS sales, {_UNITS} AS units, count(*) AS lines, {_ratio('sum(amount)', 'sum(quantity)')} AS average_price"
)

_MEASURES = f"""
    CAST(amount AS DOUBLE) AS gross_booked_sales,
    CAST(units AS BIGINT) AS units_sold,
    CAST(coalesce(lines, 0) AS BIGINT) AS sales_lines,
    {_ratio('amount', 'units')} AS average_selling_price,
    CAST(prior AS DOUBLE) AS prior_year_gross_booked_sales,
    (CAST(amount AS DOUBLE) - CAST(prior AS DOUBLE)) / nullif(CAST(prior AS DOUBLE), 0) AS gross_booked_sales_yoy,
    CAST(coalesce(orders, 0) AS BIGINT) AS eligible_orders,
    CAST(booked AS DOUBLE) AS eligible_order_gross_booked_sales,
    {_ratio('booked', 'orders')} AS average_order_value,
    CAST(coalesce(cancelled, 0) AS BIGINT) AS cancelled_orders,
    {_ratio('cancelled', 'orders')} AS cancellation_rate,
    CAST(coalesce(returned, 0) AS BIGINT) AS returned_orders,
    {_ratio('returned', 'orders')} AS return_rate,
    CAST(coalesce(sla, 0) AS BIGINT) AS sla_eligible_deliveries,
    CAST(coalesce(punctual, 0) AS BIGINT) AS on_time_deliveries,
    {_ratio('punctual', 'sla')} AS on_time_delivery_rate,
    CAST(coalesce(paid, 0) AS BIGINT) AS paid_orders,
    {_ratio('paid', 'orders')} AS paid_order_share"""

_SOLD = "sum(amount) AS amount, sum(quantity) AS units, count(*) AS lines"
_ORDERED = """count(*) AS orders, sum(booked) AS booked, count(*) FILTER (WHERE order_status = 'CANCELLED') AS cancelled,
    count(*) FILTER (WHERE order_status = 'RETURNED') AS returned, count(*) FILTER (WHERE ship_eligible) AS sla, count(*) FILTER (WHERE on_time) AS punctual,
    count(*) FILTER (WHERE payment_status = 'PAID') AS paid"""


def _measures(context: str, of_date: str) -> str:
    """Measures per context derived from the date, with equivalent prior-year dates."""
    return f"""{_with('good', 'eligible_orders', 'days')},
    s AS (SELECT {of_date} AS {context}, {_SOLD} FROM good GROUP BY 1),
    o AS (SELECT {of_date} AS {context}, {_ORDERED} FROM eligible_orders GROUP BY 1),
    shifted AS (SELECT DISTINCT {of_date} AS {context}, CAST(order_date - INTERVAL 1 YEAR AS DATE) AS prior_date FROM days),
    p AS (SELECT {context}, sum(amount) AS prior FROM shifted JOIN good ON good.order_date = prior_date GROUP BY 1)
    SELECT {context}, {_MEASURES}
    FROM s FULL JOIN o USING ({context}) FULL JOIN p USING ({context})"""


_DIFF_STATE = """
    SELECT o_custkey AS customer_id, o_orderpriority AS tier FROM orders WHERE {}
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def _matching(table: str, rows: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS measure, {e} AS expected, {a} AS actual FROM {table}" for m, e, a in rows
    )


# Rule name, pattern, and the group that may hold a placeholder.
_SECRETS = [
    ("aws-access-key", r"(?:AKIA|ASIA)[A-Z0-9]{16}", None),
    ("github-token", r"(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,})", None),
    ("private-key", r"(?m)^-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", None),
    ("embedded-postgres-password", r"(?i)postgres(?:ql)?://[^\s/:]+:([^\s@]+)@", 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{20,}", None),
    ("credential-literal", r"(?i)\b(?:password|pwd|client_secret|aws_secret_access_key)\b\s*[:=]\s*['\"]?([^\s'\";,}\n]{8,})", 1),
    ("hex-token", r'token = "[0-9a-f]{16,}"', None),
]


def _scan(name: str, pattern: str, secret_group: int | None) -> str:
    """Findings of one rule; the line is counted in the text before the k-th match."""
    quoted = pattern.replace("'", "''")
    keep = "" if secret_group is None else "WHERE NOT (contains(secret, '${') OR contains(secret, '<'))"
    group = secret_group or 0
    return f"""
        SELECT doc_id, '{name}' AS rule, line FROM (
            SELECT doc_id, secret,
                   CAST(1 + length(before) - length(replace(before, chr(10), '')) AS BIGINT) AS line
            FROM (SELECT doc_id, secrets[k] AS secret,
                         array_to_string(list_transform(range(1, k + 1), lambda i: pieces[i] || CASE WHEN i < k THEN hits[i] ELSE '' END), '') AS before
                  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k
                        FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS hits,
                                     regexp_extract_all(text, '{quoted}', {group}) AS secrets,
                                     regexp_split_to_array(text, '{quoted}') AS pieces
                              FROM documents)
                        WHERE len(hits) > 0)))
        {keep}"""


_LINKS = """
    SELECT page_id, link, url_decode(replace(split_part(link, '#', 1), '+', '%2B')) AS target
    FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)
    WHERE NOT (starts_with(link, 'https://') OR starts_with(link, 'http://') OR starts_with(link, 'mailto:')
               OR starts_with(link, '#'))"""
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"

_KNOWN_1 = "c_acctbal >= 0"
_KNOWN_2 = "(c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY') OR c_mktsegment = 'BUILDING'"

_MART_TOTALS = [
    ("mart_daily_sales", "sales"), ("mart_daily_sales", "units"), ("mart_daily_sales", "lines"),
    ("mart_monthly_sales", "sales"), ("mart_monthly_sales", "units"), ("mart_monthly_sales", "lines"),
    ("mart_customer_spend", "sales"), ("mart_customer_spend", "units"),
    ("mart_product_performance", "sales"), ("mart_product_performance", "units"), ("mart_product_performance", "lines"),
    ("mart_payment_status", "booked"), ("mart_payment_status", "orders"),
    ("mart_shipping_sla", "deliveries"),
    ("mart_customer_order_frequency", "orders"),
]

_TOTALS = """
    t AS (SELECT sum(amount) AS sales, sum(quantity) AS units, count(*) AS lines FROM good),
    u AS (SELECT sum(booked) AS booked, count(*) AS orders, count(*) FILTER (WHERE ship_eligible) AS deliveries FROM eligible_orders)"""

ORACLE = {
    "dedup_lines": _with("lines")
    + """ SELECT l_orderkey AS order_id, l_linenumber AS line_no, * EXCLUDE (l_orderkey, l_linenumber) FROM lines""",
    "standardise_customer": r"""
        SELECT c_custkey AS customer_id, upper(trim(c_name)) AS customer_name,
               upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS segment,
               try_cast(split_part(c_name, '#', 2) AS BIGINT) AS customer_number,
               try_cast(c_mktsegment AS BIGINT) AS segment_number,
               CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS balance FROM customer""",
    "soft_dq": _with("lines")
    + """ SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(o_orderdate AS DATE) AS order_date,
               CAST(l_shipdate AS DATE) AS ship_date, CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) AS soft_date
        FROM lines LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "eligibility": _with("classified")
    + """ SELECT order_id, line_no, customer_id, soft_date,
               CASE WHEN registered AND product_known THEN 'ACCEPTED' ELSE 'REJECTED' END AS dq_class, line_eligible,
               concat_ws(',', CASE WHEN registered IS NULL THEN 'unknown_order' END, CASE WHEN NOT registered THEN 'unknown_customer' END,
                              CASE WHEN NOT product_known THEN 'unknown_product' END) AS failed_rules FROM classified""",
    "soft_amount": _with("lines")
    + """ SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
               coalesce(abs(CAST(l_extendedprice AS DECIMAL(18,2))
                            - CAST(p_retailprice AS DECIMAL(18,2)) * CAST(l_quantity AS BIGINT)) > 20000, false) AS soft_amount
        FROM lines LEFT JOIN part ON l_partkey = p_partkey""",
    "version_keys": _with("customer_history", "product_history", "location_history", "status_history")
    + " UNION ALL ".join(
        f" SELECT '{h}' AS history, count(*) AS versions, count(*) AS version_keys FROM {h}_history"
        for h in ("customer", "product", "location", "status")
    ),
    "event_delay": _with("status_events")
    + """ SELECT event_id, entity_id, status, date_diff('second', event_ts, arrival_ts) AS delay_seconds,
               date_diff('second', event_ts, arrival_ts) >= 3600 AS is_late FROM status_events""",
    "delivery_days": _with("ord")
    + " SELECT order_id, order_date, delivered_date, due_date, delivery_days, ship_eligible, on_time FROM ord",
    "hard_dq_anti": _with("lines")
    + """ SELECT l_orderkey AS order_id, l_linenumber AS line_no, o_custkey AS customer_id, l_partkey AS product_id,
               'unknown_customer' AS failed_rule
        FROM lines JOIN orders ON l_orderkey = o_orderkey
        WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
        UNION ALL
        SELECT l_orderkey, l_linenumber, NULL, l_partkey, 'unknown_order'
        FROM lines ANTI JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT l_orderkey, l_linenumber, o_custkey, l_partkey, 'unknown_product'
        FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey NOT IN (SELECT p_partkey FROM part)""",
    "snapshot_diff": f"""
        WITH a AS ({_DIFF_STATE.format("o_orderdate < TIMESTAMP '1999-01-01'")}),
             b AS ({_DIFF_STATE.format("o_orderdate >= TIMESTAMP '1999-01-01'")})
        SELECT customer_id, CASE WHEN a.tier IS NULL THEN 'ADDED' WHEN b.tier IS NULL THEN 'REMOVED'
                                 WHEN a.tier = b.tier THEN 'UNCHANGED' ELSE 'CHANGED' END AS change,
               a.tier AS old_tier, b.tier AS new_tier
        FROM a FULL JOIN b USING (customer_id)""",
    "scd2_customer": _with("customer_history") + " SELECT * FROM customer_history",
    "scd2_product": _with("product_history") + " SELECT * FROM product_history",
    "scd2_location": _with("location_history") + " SELECT * FROM location_history",
    "scd2_status": _with("status_history") + " SELECT * FROM status_history",
    "scd2_late_insert": _with("customer_history") + " SELECT * FROM customer_history",
    "reference_asof": """
        WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
             snaps AS (SELECT event_type AS file, CAST(ts AS DATE) AS as_of, event_id AS snapshot_id FROM events)
        SELECT day, file, arg_max(snapshot_id, (as_of, snapshot_id)) AS snapshot_id
        FROM days JOIN snaps ON as_of <= day GROUP BY day, file""",
    "geo_enrichment": """
        SELECT c_custkey AS customer_id, c_nationkey AS location_id, n_name AS location, r_name AS zone
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "asof_customer": _with("lines", "customer_history")
    + """, f AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, CAST(l_shipdate AS DATE) AS ship_date, o_custkey AS customer_id
               FROM lines LEFT JOIN orders ON l_orderkey = o_orderkey)
        SELECT order_id, line_no, ship_date, f.customer_id, tier, valid_from
        FROM f LEFT JOIN customer_history h ON h.customer_id = f.customer_id AND ship_date >= valid_from
             AND (ship_date < valid_to OR valid_to IS NULL)""",
    "asof_product": _with("lines", "product_history")
    + """, f AS (SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id, CAST(o_orderdate AS DATE) AS order_date
               FROM lines LEFT JOIN orders ON l_orderkey = o_orderkey)
        SELECT order_id, line_no, f.product_id, order_date, supplier_id, valid_from
        FROM f LEFT JOIN product_history h ON h.product_id = f.product_id AND order_date >= valid_from
             AND (order_date < valid_to OR valid_to IS NULL)""",
    "asof_status": _with("status_events", "status_history")
    + """ SELECT event_id, e.entity_id, arrival_ts, h.status AS status_then, valid_from AS status_since
        FROM status_events e ASOF LEFT JOIN status_history h ON e.entity_id = h.entity_id AND e.arrival_ts >= h.valid_from""",
    "current_status": _with("status_events")
    + """ SELECT entity_id, arg_max(status, (event_ts, event_id)) AS status, max(event_ts) AS status_since,
               arg_max(event_id, (event_ts, event_id)) AS event_id, count(*) AS event_count
        FROM status_events GROUP BY entity_id""",
    "fact_sales": _with("fact")
    + """ SELECT order_id, line_no, customer_id, product_id, location_id, order_date, ship_date, quantity,
               CAST(amount AS DOUBLE) AS amount, customer_tier, location_tier, supplier_id, category, soft_date, line_eligible
        FROM fact""",
    "fact_order": _with("ord")
    + """ SELECT * REPLACE (CAST(booked AS DOUBLE) AS booked, CAST(line_count AS BIGINT) AS line_count,
               CAST(eligible_lines AS BIGINT) AS eligible_lines) FROM ord""",
    "mart_daily_sales": _with("good") + f" SELECT order_date AS sale_date, {_SALES_COLUMNS} FROM good GROUP BY 1",
    "mart_monthly_sales": _with("good")
    + f" SELECT CAST(date_trunc('month', order_date) AS DATE) AS sale_month, {_SALES_COLUMNS} FROM good GROUP BY 1",
    "mart_customer_spend": _with("good")
    + f""" SELECT customer_id, {_SALES} AS spend, {_UNITS} AS units, min(order_date) AS first_sale, max(order_date) AS latest_sale
        FROM good GROUP BY 1""",
    "mart_product_performance": _with("good") + f" SELECT product_id, {_SALES_COLUMNS} FROM good GROUP BY 1",
    "mart_category_performance": _with("fact") + f" SELECT category, {_SALES_COLUMNS} FROM fact WHERE line_eligible GROUP BY 1",
    "mart_geography_sales": _with("fact")
    + f""" SELECT location_id, location_tier, {_SALES} AS sales, {_UNITS} AS units, count(*) AS lines
        FROM fact WHERE line_eligible GROUP BY 1, 2""",
    "mart_sales_yoy": _with("good")
    + """, y AS (SELECT CAST(year(order_date) AS INTEGER) AS sale_year, CAST(sum(amount) AS DOUBLE) AS sales
               FROM good WHERE year(order_date) BETWEEN 1995 AND 2000 GROUP BY 1)
        SELECT y.sale_year, y.sales, p.sales AS prior_sales, (y.sales - p.sales) / nullif(p.sales, 0) AS yoy
        FROM y LEFT JOIN y AS p ON p.sale_year = y.sale_year - 1""",
    "mart_order_lifecycle": _with("eligible_orders")
    + f""", x AS (SELECT order_status, booked FROM eligible_orders UNION ALL SELECT 'ALL', booked FROM eligible_orders),
        n AS (SELECT count(*) FILTER (WHERE order_status = 'CANCELLED') AS c, count(*) FILTER (WHERE order_status = 'RETURNED') AS r FROM eligible_orders)
        SELECT order_status, count(*) AS orders, CAST(sum(booked) AS DOUBLE) AS booked_sales,
               {_ratio('sum(booked)', 'count(*)')} AS average_order_value,
               CASE order_status WHEN 'ALL' THEN {_ratio('any_value(c)', 'count(*)')} WHEN 'CANCELLED' THEN 1.0 ELSE 0.0 END AS cancellation_rate,
               CASE order_status WHEN 'ALL' THEN {_ratio('any_value(r)', 'count(*)')} WHEN 'RETURNED' THEN 1.0 ELSE 0.0 END AS return_rate
        FROM x, n GROUP BY 1""",
    "mart_shipping_sla": _with("ord")
    + f""" SELECT zone, count(*) AS deliveries, count(*) FILTER (WHERE on_time) AS on_time_deliveries, count(*) FILTER (WHERE NOT on_time) AS late_deliveries,
               {_ratio('count(*) FILTER (WHERE on_time)', 'count(*)')} AS on_time_rate, {_ratio('sum(delivery_days)', 'count(*)')} AS average_days
        FROM ord WHERE ship_eligible GROUP BY 1""",
    "mart_payment_status": _with("eligible_orders")
    + " SELECT payment_status, count(*) AS orders, CAST(sum(booked) AS DOUBLE) AS booked_sales FROM eligible_orders GROUP BY 1",
    "mart_customer_order_frequency": _with("eligible_orders")
    + """ SELECT customer_id, count(*) AS orders, min(order_date) AS first_order, max(order_date) AS latest_order,
               count(*) >= 2 AS is_repeat FROM eligible_orders GROUP BY 1""",
    "measures_all": _with("good", "eligible_orders")
    + f""", s AS (SELECT {_SOLD} FROM good), o AS (SELECT {_ORDERED} FROM eligible_orders)
        SELECT {_MEASURES} FROM s, o, (SELECT CAST(NULL AS DECIMAL(18,2)) AS prior)""",
    "measures_by_year": _measures("sale_year", "CAST(year(order_date) AS INTEGER)"),
    "measures_by_location": _with("good", "eligible_orders")
    + f""", s AS (SELECT location_id, {_SOLD} FROM good GROUP BY 1), o AS (SELECT location_id, {_ORDERED} FROM eligible_orders GROUP BY 1)
        SELECT location_id, {_MEASURES} FROM s FULL JOIN o USING (location_id), (SELECT CAST(NULL AS DECIMAL(18,2)) AS prior)""",
    "prior_year": "SELECT sale_month, gross_booked_sales, prior_year_gross_booked_sales, gross_booked_sales_yoy FROM ("
    + _measures("sale_month", "CAST(date_trunc('month', order_date) AS DATE)")
    + ")",
    "watermark_slice": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, * EXCLUDE (l_orderkey, l_linenumber) FROM lineitem
        WHERE l_shipdate > TIMESTAMP '1999-01-01' AND l_shipdate <= (SELECT max(l_shipdate) FROM lineitem)""",
    "upsert_correction": _with("lines")
    + """ SELECT l_orderkey AS order_id, l_linenumber AS line_no, * EXCLUDE (l_orderkey, l_linenumber) FROM lines""",
    "classify_transition": f"""
        SELECT o_orderkey AS order_id, CASE WHEN a THEN 'ACCEPTED' ELSE 'REJECTED' END AS from_class,
               CASE WHEN b THEN 'ACCEPTED' ELSE 'REJECTED' END AS to_class, CASE WHEN b THEN '' ELSE 'unknown_customer' END AS failed_rules
        FROM orders JOIN (SELECT c_custkey, {_KNOWN_1} AS a, {_KNOWN_2} AS b FROM customer) ON o_custkey = c_custkey WHERE a <> b""",
    "reject_reprocess": f"""
        SELECT CASE WHEN a OR b THEN 'ACCEPTED' ELSE 'REJECTED' END AS dq_class, CASE WHEN NOT a AND b THEN 2 ELSE 1 END AS load_no,
               count(*) AS orders
        FROM orders JOIN (SELECT c_custkey, {_KNOWN_1} AS a, {_KNOWN_2} AS b FROM customer) ON o_custkey = c_custkey GROUP BY 1, 2""",
    "copy_counts": " UNION ALL ".join(
        f"SELECT '{t}' AS object_name, count(*) AS source_rows, count(*) AS landed_rows, true AS matches FROM {t}"
        for t in ("orders", "lineitem", "events")
    ),
    "quality_history": _with("classified")
    + "".join(
        f"{' UNION ALL' if i else ''} SELECT 'silver' AS stage, 'sales_order_line' AS object_name, '{rule}' AS rule,"
        f" count(*) FILTER (WHERE {test}) AS failed_rows, count(*) AS total_rows FROM classified"
        for i, (rule, test) in enumerate(
            {
                "soft_date": "soft_date",
                "unknown_customer": "NOT registered",
                "unknown_product": "NOT product_known",
                "not_eligible": "NOT line_eligible",
            }.items()
        )
    ),
    "contract_drift": """
        WITH f AS (SELECT unnest(json_keys(props)) AS field, props FROM events),
             g AS (SELECT field, count(*) AS n, count(*) FILTER (WHERE field = 'k' AND try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS w
                   FROM f GROUP BY 1),
             c AS (SELECT * FROM (VALUES ('k', 'bigint'), ('source', 'string')) AS v(field, expected_type))
        SELECT field, expected_type, coalesce(n, 0) AS row_count, coalesce(w, 0) AS wrong_type,
               CASE WHEN n IS NULL THEN 'MISSING' WHEN expected_type IS NULL THEN 'ADDED' WHEN w > 0 THEN 'CHANGED' ELSE 'SAME' END AS drift
        FROM c FULL JOIN g USING (field)""",
    "audit_grain": _with("sales", "ord")
    + """ SELECT 'bronze_lines' AS table_name, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS key_count,
               count(*) FILTER (WHERE n > 1) AS repeated_keys, count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys
        FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2)
        UNION ALL SELECT 'fact_sales', count(*), count(DISTINCT (order_id, line_no)), 0, 0 FROM sales
        UNION ALL SELECT 'fact_order', count(*), count(DISTINCT order_id), 0, 0 FROM ord""",
    "audit_denominators": _with("ord")
    + """ SELECT 'eligible' AS measure, count(*) FILTER (WHERE order_eligible) AS expected, count(*) FILTER (WHERE order_eligible) AS actual, true AS matches FROM ord
        UNION ALL SELECT 'deliveries', count(*) FILTER (WHERE ship_eligible), count(*) FILTER (WHERE ship_eligible), true FROM ord""",
    "audit_reconcile": _with("good", "eligible_orders")
    + f", {_TOTALS} "
    + " UNION ALL ".join(
        f"SELECT '{mart}' AS table_name, '{m}' AS measure, CAST({m} AS DOUBLE) AS expected, CAST({m} AS DOUBLE) AS actual, true AS matches FROM t, u"
        for mart, m in _MART_TOTALS
    ),
    "kpi_audit": _with("good", "eligible_orders")
    + f""", {_TOTALS} SELECT (SELECT count(*) FROM sales) AS fact_lines, (SELECT count(*) FROM ord) AS fact_orders,
            lines AS eligible_lines, CAST(sales AS DOUBLE) AS eligible_amount, orders AS eligible_orders, deliveries AS sla_deliveries
        FROM t, u""",
    "health_check": _with("good", "eligible_orders")
    + f", {_TOTALS} SELECT measure, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual, true AS matches FROM ("
    + _matching("t, u", [("sales", "sales", "sales"), ("lines", "lines", "lines"), ("orders", "orders", "orders"), ("sla", "deliveries", "deliveries")])
    + ")",
    "increment_diagnostics": _with("heads")
    + """, f AS (SELECT * FROM (SELECT * FROM lineitem WHERE l_shipdate > TIMESTAMP '1999-01-01')
               LEFT JOIN heads ON l_orderkey = order_id LEFT JOIN part ON l_partkey = p_partkey)
        SELECT 'sales_order_line' AS object_name, rule, failed_rows, total_rows FROM (
            SELECT 'unknown_order' AS rule, count(*) FILTER (WHERE order_id IS NULL) AS failed_rows, count(*) AS total_rows FROM f
            UNION ALL SELECT 'unknown_customer', count(*) FILTER (WHERE NOT registered), count(*) FROM f
            UNION ALL SELECT 'unknown_product', count(*) FILTER (WHERE p_partkey IS NULL), count(*) FROM f
            UNION ALL SELECT 'ship_before_order', count(*) FILTER (WHERE CAST(l_shipdate AS DATE) < order_date), count(*) FROM f
            UNION ALL SELECT 'no_quantity', count(*) FILTER (WHERE l_quantity <= 0), count(*) FROM f)""",
    "order_identity": """
        SELECT l_orderkey AS order_id, count(*) AS line_count, min(l_partkey) AS min_product_id, max(l_partkey) AS max_product_id,
               CAST(min(l_shipdate) AS DATE) AS min_ship_date, CAST(max(l_shipdate) AS DATE) AS max_ship_date
        FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 1 OR count(DISTINCT l_shipdate) > 1""",
    "secret_scan": " UNION ALL ".join(_scan(*rule) for rule in _SECRETS),
    "link_integrity": f"""
        WITH links AS ({_LINKS})
        SELECT page_id, link, target FROM links WHERE target NOT IN (SELECT {_PATH} FROM pages)""",
    "link_targets": f"""
        WITH links AS ({_LINKS}), known AS (SELECT DISTINCT '/' || split_part({_PATH}, '/', 2) AS target FROM pages)
        SELECT target, count(*) AS links, CASE WHEN any_value(k.target IS NULL) THEN count(*) ELSE 0 END AS dead
        FROM links LEFT JOIN known k USING (target) GROUP BY target""",
    "file_rules": f"""
        SELECT page_id, path, length, CASE
            WHEN list_contains(string_split(path, '/'), 'es') OR regexp_extract(split_part(path, '/', -1), '^.+(\\.[^.]+)$', 1) = '.html'
                 OR starts_with(split_part(path, '/', -1), 'secrets') OR contains(split_part(path, '/', -1), '.tfstate')
                 OR (starts_with(split_part(path, '/', -1), '.env') AND split_part(path, '/', -1) <> '.env.example') THEN 'forbidden path'
            WHEN length > 10000 THEN 'oversized' END AS verdict
        FROM (SELECT page_id, {_PATH} AS path, CAST(strlen(html) AS BIGINT) AS length FROM pages)""",
}

# A published mart must equal the mart computed straight from the given tables.
ORACLE["published_daily_sales"] = ORACLE["mart_daily_sales"]
ORACLE["published_shipping_sla"] = ORACLE["mart_shipping_sla"]
ORACLE["published_fact_sales"] = (
    _with("sales")
    + """ SELECT order_id * 10 + line_no AS sales_id, order_id, customer_id, product_id, order_date, ship_date, due_date, quantity,
                 CAST(amount AS DOUBLE) AS amount, c_mktsegment AS region, p_type AS category, r_name AS zone, soft_date, line_eligible
          FROM sales JOIN heads USING (order_id, customer_id, order_date, location_id, registered) JOIN customer ON customer_id = c_custkey
          JOIN part ON product_id = p_partkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
# A line enters its class once, and replays publish nothing.
ORACLE["replay_idempotence"] = (
    _with("classified")
    + """ SELECT CASE WHEN registered AND product_known THEN 'ACCEPTED' ELSE 'REJECTED' END AS dq_class, count(*) AS lines,
                 CAST(sum(amount) AS DOUBLE) AS amount, count(*) AS entries, CAST(0 AS BIGINT) AS replayed_versions
          FROM classified GROUP BY 1"""
)
ORACLE["baseline_equals_increments"] = """
    SELECT 'sales_classified' AS table_name, count(DISTINCT (l_orderkey, l_linenumber)) AS rows, CAST(0 AS BIGINT) AS differing FROM lineitem
    UNION ALL SELECT 'shipment_status_event', count(DISTINCT (l_orderkey, l_linenumber)), 0 FROM lineitem
    UNION ALL SELECT 'order_status_event', count(DISTINCT o_orderkey), 0 FROM orders
    UNION ALL SELECT 'payment_status_event', count(DISTINCT o_orderkey), 0 FROM orders
    UNION ALL SELECT 'customer_history', count(DISTINCT c_custkey), 0 FROM customer
    UNION ALL SELECT 'product_history', count(DISTINCT p_partkey), 0 FROM part"""
