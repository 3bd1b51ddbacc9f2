"""DuckDB SQL of the checkouts and of employee sign-ups: a fold over the requests, one after the other.

The state of a checkout is the stock of every product by row number; a cart
looks at its items in order and takes all of them or none.
"""

from __future__ import annotations

from tillpoint.plans.oracle import commerce

_ITEM = "STRUCT(p BIGINT, pid BIGINT, cum BIGINT, wrong BOOLEAN)[]"
_LINE = "STRUCT(p BIGINT, q BIGINT)[]"
_TOLD = "STRUCT(id BIGINT, code INTEGER, reason VARCHAR)[]"


def _checkout(web: bool) -> str:
    """CTEs: ``asked`` (all carts), ``z`` (the state after all of them), ``told`` (what refused carts are told)."""
    user = "o_custkey IN (SELECT c_custkey FROM customer)" if web else "true"
    return f"""shelf AS (SELECT id AS pid, quantity AS have, row_number() OVER (ORDER BY id) AS p FROM products),
line AS (SELECT l_orderkey AS id, l_partkey AS pid, CAST(l_quantity AS INTEGER) AS q, CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
                row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS nth
         FROM lineitem),
seen AS (SELECT id, nth, q, price, line.pid, p, sum(q) OVER (PARTITION BY id, line.pid ORDER BY nth) AS cum
         FROM line LEFT JOIN shelf USING (pid)),
taking AS (SELECT id, list({{'p': p, 'q': q}}) AS lines FROM (SELECT id, p, sum(q)::BIGINT AS q FROM seen GROUP BY id, p) GROUP BY id),
basket AS (SELECT id, list({{'p': p, 'pid': pid, 'cum': cum::BIGINT, 'wrong': q IS NULL OR price IS NULL OR q <= 0 OR price < 0}}
                         ORDER BY nth) AS items, sum(q * price) AS total FROM seen GROUP BY id),
asked AS (SELECT o_orderkey AS id, o_orderdate AS at_time, {user} AS known, items, lines, total
          FROM orders LEFT JOIN basket ON o_orderkey = basket.id LEFT JOIN taking ON o_orderkey = taking.id),
z AS (SELECT list_reduce(list_prepend(first, rest), lambda s, r: {{'id': r.id, 'items': r.items, 'lines': r.lines,
        'stock': CASE WHEN len({_fail('r.items')}) > 0 THEN s.stock ELSE list_transform(s.stock, lambda x, i:
            x - coalesce(list_sum(list_transform(list_filter(r.lines, lambda l: l.p = i), lambda l: l.q)), 0)::BIGINT) END,
        'told': CASE WHEN len({_fail('r.items')}) > 0 THEN list_append(s.told, {{'id': r.id, 'code': {_fail('r.items')}[1].code,
            'reason': {_fail('r.items')}[1].reason}}) ELSE s.told END}}) AS z
    FROM (SELECT (SELECT {{'id': 0::BIGINT, 'items': []::{_ITEM}, 'lines': []::{_LINE}, 'stock': list(have::BIGINT ORDER BY p),
                           'told': []::{_TOLD}}} FROM shelf) AS first),
         (SELECT list({{'id': id::BIGINT, 'items': items::{_ITEM}, 'lines': lines::{_LINE}, 'stock': []::BIGINT[], 'told': []::{_TOLD}}}
                      ORDER BY at_time, id) AS rest FROM asked WHERE known AND items IS NOT NULL)),
told AS (SELECT x.id, x.code, x.reason FROM (SELECT unnest(z.told) AS x FROM z))"""


def _fail(items: str) -> str:
    """What goes wrong with the items of a cart, in order."""
    return (f"list_filter(list_transform({items}, lambda i: CASE "
            "WHEN i.p IS NULL THEN {'code': 404, 'reason': 'Product ID ' || i.pid || ' not found'} "
            "WHEN s.stock[i.p] < i.cum THEN {'code': 400, 'reason': 'Insufficient stock for product ID ' || i.pid} "
            "WHEN i.wrong THEN {'code': 500, 'reason': 'Checkout failed'} END), lambda f: f IS NOT NULL)")


def _decisions(web: bool) -> str:
    return commerce(f"""WITH {_checkout(web)}
SELECT asked.id AS {"order_id" if web else "cart_id"}, if(good, 'accepted', 'rejected') AS decision,
       CAST(CASE WHEN good THEN 201 WHEN NOT known THEN 404 WHEN items IS NULL THEN 400 ELSE code END AS INTEGER) AS http_code,
       CASE WHEN good THEN NULL WHEN NOT known THEN 'User not found' WHEN items IS NULL THEN 'Missing required fields'
            ELSE reason END AS reason, CAST(total AS DOUBLE) AS total_price
FROM (SELECT asked.*, told.code, told.reason, known AND items IS NOT NULL AND told.id IS NULL AS good
      FROM asked LEFT JOIN told USING (id)) AS asked""")


def checkout_sql() -> dict[str, str]:
    s = {"checkout_pos": _decisions(False), "checkout_web": _decisions(True)}
    s["sale_ledger_rows"] = commerce(f"""WITH {_checkout(False)}
SELECT 'Sale' AS type, 'Bill for cart_id ' || id AS description, CAST(total AS DOUBLE) AS amount, CAST(at_time AS DATE) AS income_date
FROM asked WHERE items IS NOT NULL AND id NOT IN (SELECT id FROM told)""")
    s["stock_after_checkout"] = commerce(f"""WITH {_checkout(False)}
SELECT pid AS id, z.stock[p] AS quantity FROM shelf, z""")
    keys = [("email", "Email"), ("phone", "Phone"), ("bank", "Bank Account Number")]
    taken = "concat_ws(', ', " + ", ".join(f"CASE WHEN list_contains(s.{k}, r.{k}[1]) THEN '{n}' END" for k, n in keys) + ")"
    s["employee_conflicts"] = commerce(f"""WITH er AS (SELECT c_custkey AS request_id,
        'emp' || (c_custkey % 150) || '@staff.example' AS email, 'ph-' || (c_custkey % 170 + 1000) AS phone,
        'AC' || (c_custkey % 40) AS bank FROM customer),
z AS (SELECT list_reduce(list_prepend(first, rest), lambda s, r: {{'id': r.id,
        {", ".join(f"'{k}': CASE WHEN {taken} <> '' THEN s.{k} ELSE list_concat(s.{k}, r.{k}) END" for k, _ in keys)},
        'told': CASE WHEN {taken} <> '' THEN list_append(s.told, {{'id': r.id, 'what': {taken}}}) ELSE s.told END}}) AS z
    FROM (SELECT (SELECT {{'id': 0::BIGINT, 'email': list(email), 'phone': list(phone), 'bank': list(bank_account_number),
                           'told': []::STRUCT(id BIGINT, what VARCHAR)[]}} FROM employees) AS first),
         (SELECT list({{'id': request_id::BIGINT, 'email': [email], 'phone': [phone], 'bank': [bank],
                        'told': []::STRUCT(id BIGINT, what VARCHAR)[]}} ORDER BY request_id) AS rest FROM er)),
told AS (SELECT x.id AS request_id, x.what FROM (SELECT unnest(z.told) AS x FROM z))
SELECT request_id, CAST(if(what IS NULL, 201, 409) AS INTEGER) AS http_code,
       coalesce(what || ' already exists', 'added') AS message FROM er LEFT JOIN told USING (request_id)""")
    return s
