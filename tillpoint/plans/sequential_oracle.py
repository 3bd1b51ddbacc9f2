"""DuckDB SQL of the hand-over batches: one request after the other, as a fold over all requests in order.

The state is the whole table as a map from row to values; a request looks
through all other rows.  Nothing is grouped or decided ahead.
"""

from __future__ import annotations

from tillpoint.plans.oracle import commerce

TAKEN = "len(list_filter(map_entries(s.held), lambda e: e.key <> r.k AND e.value{f} = r.v{f})) > 0"


def _fold(init: str, step: str, blank: str, clash: str, more: str, acts: str = "true") -> str:
    """CTE z: the state after all requests; ``told`` gathers what is said of refused ones."""
    return f"""z AS (SELECT list_reduce(list_prepend(first, rest), lambda s, r: {{'id': r.id, 'k': r.k, 'v': r.v, 'more': r.more,
        'held': CASE WHEN ({clash}) <> '' OR NOT ({acts}) THEN s.held ELSE map_concat(s.held, MAP {{r.k: {more}}}) END,
        'told': CASE WHEN ({clash}) <> '' THEN list_append(s.told, {{'id': r.id, 'what': {clash}}}) ELSE s.told END}}) AS z
    FROM (SELECT {init} AS first), (SELECT list({step} ORDER BY request_id) AS rest FROM acting))"""


def _fold_values(rows: str, key: str, value: str, requests: str) -> str:
    """CTEs ``taken`` (request_id) and ``final`` (key, value) for one unique column: the state is the list of the
    values by row number, searched as a whole for every request."""
    return f"""nth AS (SELECT {key} AS key, {value} AS value, row_number() OVER (ORDER BY {key}) AS p FROM {rows}),
z AS (SELECT list_reduce(list_prepend(first, rest), lambda s, r: {{'id': r.id, 'p': r.p, 'v': r.v,
        'held': CASE WHEN r.v IS NOT NULL AND coalesce(list_position(s.held, r.v), 0) NOT IN (0, r.p) THEN s.held
                     ELSE list_concat(list_concat(s.held[1:r.p - 1], [r.v]), s.held[r.p + 1:len(s.held)]) END,
        'told': CASE WHEN r.v IS NOT NULL AND coalesce(list_position(s.held, r.v), 0) NOT IN (0, r.p) THEN list_append(s.told, r.id)
                     ELSE s.told END}}) AS z
    FROM (SELECT (SELECT {{'id': 0::BIGINT, 'p': 0::BIGINT, 'v': NULL::VARCHAR, 'held': list(value ORDER BY p),
                           'told': []::BIGINT[]}} FROM nth) AS first),
         (SELECT list({{'id': request_id::BIGINT, 'p': p::BIGINT, 'v': v, 'held': []::VARCHAR[], 'told': []::BIGINT[]}}
                      ORDER BY request_id) AS rest FROM ({requests}) JOIN nth USING (key))),
taken AS (SELECT unnest(z.told) AS request_id FROM z),
final AS (SELECT key, z.held[p] AS value FROM nth, z)"""


def sequential_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    told = "cast([] AS STRUCT(id BIGINT, what VARCHAR)[])"
    shops = f"""shops AS (SELECT c_custkey AS client_id, 'shop-' || c_custkey AS subdomain FROM customer),
sr AS (SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 97 = 0 THEN -o_custkey ELSE o_custkey END AS client_id,
       CASE o_orderkey % 6 WHEN 0 THEN 'shop-' || (o_custkey + 1) WHEN 1 THEN 'shop-' || o_custkey
            WHEN 2 THEN 'new-' || (o_orderkey // 50) WHEN 3 THEN 'sale' WHEN 4 THEN 'shop-' || (o_custkey - 1) END AS subdomain
       FROM orders),
{_fold_values("shops", "client_id", "subdomain", "SELECT request_id, client_id AS key, subdomain AS v FROM sr")}"""
    s["subdomain_handover"] = commerce(f"""WITH {shops}
SELECT request_id, CAST(CASE WHEN NOT known THEN 401 WHEN taken THEN 400 ELSE 200 END AS INTEGER) AS http_code,
       CASE WHEN NOT known THEN 'Invalid client ID. Unauthorized access.'
            WHEN taken THEN 'Subdomain already exists for another client.' ELSE 'Subdomain saved successfully' END AS message
FROM (SELECT request_id, client_id IN (SELECT client_id FROM shops) AS known,
             request_id IN (SELECT request_id FROM taken) AS taken FROM sr)""")
    s["subdomain_handover_shops"] = commerce(f"""WITH {shops}
SELECT key AS client_id, value AS subdomain FROM final""")

    kind = "STRUCT(email VARCHAR, phone VARCHAR, bank VARCHAR)"
    clash = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN list_contains(r.more, '{f}') AND {TAKEN.format(f=f'.{c}')} THEN '{label}' END"
        for f, c, label in [("email", "email", "Email"), ("phone", "phone", "Phone"),
                            ("bank_account_number", "bank", "Bank Account Number")]) + ")"
    value = ("{" + ", ".join(f"'{c}': CASE WHEN list_contains(r.more, '{f}') THEN r.v.{c} ELSE s.held[r.k].{c} END"
                             for f, c in [("email", "email"), ("phone", "phone"), ("bank_account_number", "bank")]) + "}")
    staff = f"""acting AS (SELECT o_orderkey AS request_id, o_custkey // 15 + 1 AS id, CASE o_orderkey % 5 WHEN 0 THEN ['email']
            WHEN 1 THEN ['phone', 'position'] WHEN 2 THEN ['email', 'bank_account_number']
            WHEN 3 THEN ['phone', 'bank_account_number', 'salary'] ELSE []::VARCHAR[] END AS provided,
        CASE WHEN o_orderkey % 5 = 0 THEN 'emp' || (o_custkey // 15 + 1 + o_orderkey % 3) || '@staff.example' END AS email,
        'ph-' || (o_custkey // 15 + 1 + o_orderkey % 2) AS phone,
        'AC' || (o_custkey // 15 + 1 + o_orderkey // 7 % 4) AS bank, CAST(o_totalprice AS DECIMAL(10,2)) AS salary FROM orders),
{_fold(f"(SELECT {{'id': 0::BIGINT, 'k': 0::BIGINT, 'v': NULL::{kind}, 'more': []::VARCHAR[], 'held': map_from_entries(list("
       f"(id::BIGINT, {{'email': email, 'phone': phone, 'bank': bank_account_number}}::{kind}))), 'told': {told}}} FROM employees)",
       f"{{'id': request_id::BIGINT, 'k': id::BIGINT, 'v': {{'email': email, 'phone': phone, 'bank': bank}}::{kind}, "
       f"'more': provided, 'held': MAP {{0::BIGINT: NULL::{kind}}}, 'told': {told}}}", "", clash, value,
       "map_contains(s.held, r.k)")},
taken AS (SELECT x.id AS request_id, x.what FROM (SELECT unnest(z.told) AS x FROM z)),
po AS (SELECT a.*, t.what, CASE WHEN len(provided) = 0 THEN 400 WHEN t.what IS NOT NULL THEN 409
              WHEN a.id NOT IN (SELECT id FROM employees) THEN 404 ELSE 200 END AS code
       FROM acting a LEFT JOIN taken t USING (request_id))"""
    s["employee_handover"] = commerce(f"""WITH {staff}
SELECT request_id, CAST(code AS INTEGER) AS http_code,
       CASE code WHEN 400 THEN 'No fields provided for update' WHEN 409 THEN what || ' already exists for another employee.'
            WHEN 404 THEN 'not found' ELSE 'updated' END AS message FROM po""")
    s["employee_handover_rows"] = commerce(f"""WITH {staff},
now AS (SELECT e.key AS id, e.value AS v FROM (SELECT unnest(map_entries(z.held)) AS e FROM z)),
last AS (SELECT id, bool_or(list_contains(provided, 'position')) AS led,
                arg_max(salary, request_id) FILTER (list_contains(provided, 'salary')) AS salary FROM po WHERE code = 200 GROUP BY id)
SELECT e.id, now.v.email AS email, now.v.phone AS phone, now.v.bank AS bank_account_number,
       CASE WHEN led THEN 'Lead' ELSE e.position END AS position, CAST(COALESCE(last.salary, e.salary) AS DOUBLE) AS salary,
       CASE WHEN last.id IS NULL THEN e.updated_at ELSE TIMESTAMP '2024-01-24 15:30:00' END AS updated_at
FROM employees e JOIN now USING (id) LEFT JOIN last ON last.id = e.id""")

    goods = f"""pr AS (SELECT o_orderkey AS request_id, o_custkey AS id, o_orderkey % 29 = 0 AS bad, o_orderkey % 100 AS quantity,
        'BC' || (o_custkey + o_orderkey // 8 % 3) AS barcode FROM orders),
{_fold_values("products", "id", "barcode", "SELECT request_id, id AS key, barcode AS v FROM pr WHERE NOT bad")},
po AS (SELECT *, CASE WHEN bad THEN 400 WHEN id NOT IN (SELECT id FROM products) THEN 404
                      WHEN request_id IN (SELECT request_id FROM taken) THEN 500 ELSE 200 END AS code FROM pr)"""
    s["product_handover"] = commerce(f"""WITH {goods}
SELECT request_id, CAST(code AS INTEGER) AS http_code, CASE code WHEN 400 THEN 'Invalid product data'
       WHEN 404 THEN 'Product not found' WHEN 500 THEN 'Failed to update product' ELSE 'Product updated' END AS message FROM po""")
    s["product_handover_rows"] = commerce(f"""WITH {goods},
last AS (SELECT id, arg_max(barcode, request_id) AS barcode, arg_max(quantity, request_id) AS quantity
         FROM po WHERE code = 200 GROUP BY id)
SELECT p.id, COALESCE(l.barcode, p.barcode) AS barcode, CAST(COALESCE(l.quantity, p.quantity) AS INTEGER) AS quantity,
       CASE WHEN l.id IS NULL THEN p.updated_at ELSE TIMESTAMP '2024-01-24 15:30:00' END AS updated_at
FROM products p LEFT JOIN last l USING (id)""")
    return s
