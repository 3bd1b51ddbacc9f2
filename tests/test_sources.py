"""Request / response / sink paths: JSON requests with nested items through checkout."""

import json
import os
import tempfile

from pyspark.sql import functions as F, types as T

from tillpoint.functions.money import items_total
from tillpoint.operators.checkout import checkout, explode_items
from tillpoint.sources.tables import append, read_requests, read_table, to_response

ITEM = T.StructType([T.StructField("product_id", T.LongType()), T.StructField("quantity", T.IntegerType()),
                     T.StructField("unit_price", T.DecimalType(10, 2))])
REQUEST = T.StructType([
    T.StructField("cart_id", T.LongType()), T.StructField("requested_at", T.TimestampNTZType()),
    T.StructField("status", T.StringType()), T.StructField("items", T.ArrayType(ITEM)),
    T.StructField("bill", T.StructType([T.StructField("payment_status", T.StringType()),
                                        T.StructField("payment_method", T.StringType())]))])


def test_json_requests_to_checkout_and_response(spark):
    d = tempfile.mkdtemp(prefix="tillpoint-req-", dir="/tmp")
    reqs = [
        {"cart_id": 1, "requested_at": "2024-01-01T10:00:00", "status": "pending",
         "items": [{"product_id": 7, "quantity": 2, "unit_price": 1.25}, {"product_id": 8, "quantity": 1,
                                                                          "unit_price": 10}],
         "bill": {"payment_status": "paid", "payment_method": "cash"}},
        {"cart_id": 2, "requested_at": "2024-01-01T11:00:00", "status": "pending",
         "items": [{"product_id": 7, "quantity": 2, "unit_price": 1.25}],
         "bill": {"payment_status": "paid", "payment_method": "UPI"}},
        {"cart_id": 3, "requested_at": "2024-01-01T12:00:00", "status": "", "items": [],
         "bill": {"payment_status": "paid", "payment_method": "UPI"}},
    ]
    with open(os.path.join(d, "req.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in reqs))
    raw = read_requests(spark, os.path.join(d, "req.json"), REQUEST)
    totals = {r.cart_id: r.t for r in raw.select("cart_id", items_total("items").alias("t")).collect()}
    assert str(totals[1]) == "12.50" and str(totals[3]) == "0.00"
    requests = raw.select("cart_id", "requested_at", "status", "bill.payment_status", "bill.payment_method")
    items = explode_items(raw)
    stock = spark.createDataFrame([(7, 3), (8, 5)], "id long, quantity int")
    r = checkout(requests, items, stock)
    got = {x.cart_id: (x.http_code, x.reason) for x in r.decisions.collect()}
    assert got == {1: (201, None), 2: (400, "Insufficient stock for product ID 7"),
                   3: (400, "Missing required fields")}
    doc = json.loads(to_response(r.bills).collect()[0].response)
    assert doc["bill_id"] == 1 and doc["total_amount"] == 12.5
    out = os.path.join(d, "bills")
    append(r.bills.withColumn("client_id", F.lit(4)), out)
    back = read_table(spark, d, "bills", client_id=4)
    assert back.count() == 1 and os.path.isdir(os.path.join(out, "client_id=4"))


def test_request_bodies_from_json_column(spark):
    from tillpoint.sources.tables import requests_from_json
    body = T.StructType([T.StructField("type", T.StringType()), T.StructField("amount", T.DecimalType(10, 2)),
                         T.StructField("date", T.DateType())])
    df = spark.createDataFrame([(1, '{"type": "income", "amount": 12.5, "date": "2024-01-02"}'),
                                (2, '{"type": "other"}')], "request_id long, body string")
    rows = {r.request_id: r for r in requests_from_json(df, "body", body).collect()}
    assert rows[1].type == "income" and str(rows[1].amount) == "12.50" and rows[2].amount is None
