"""Column helpers, nesting, as-of lookup and NOT IN semantics on small fixtures."""

import datetime as dt
import decimal
import random

from pyspark.sql import functions as F

from tillpoint.functions.money import apply_defaults, items_total, pct_change
from tillpoint.functions.nesting import nest, nested_text
from tillpoint.functions.text import conflict_labels, first_label, js_template, pg_concat
from tillpoint.functions.timefn import calendar, period_label, series_window
from tillpoint.operators.asof import asof_join
from tillpoint.operators.reports import not_in_anti

D = decimal.Decimal


def test_items_total_folds_in_decimal(spark):
    df = spark.createDataFrame([([(2, D("1.10")), (3, D("0.05"))],)],
                               "items array<struct<quantity:int, unit_price:decimal(10,2)>>")
    assert df.select(items_total("items").alias("t")).collect()[0].t == D("2.35")


def test_round_half_away_from_zero(spark):
    df = spark.createDataFrame([(D("123.45"), D("100.00")), (D("76.55"), D("100.00"))], "c decimal(10,2), l decimal(10,2)")
    got = [r[0] for r in df.select(pct_change(F.col("c"), F.col("l"))).collect()]
    assert got == [D("23.45"), D("-23.45")]
    z = spark.createDataFrame([(D("1.00"), D("0.00"))], "c decimal(10,2), l decimal(10,2)")
    assert z.select(pct_change(F.col("c"), F.col("l"))).collect()[0][0] is None   # NULLIF, no ANSI error


def test_text_helpers(spark):
    df = spark.createDataFrame([("Ann", None, " Shop-A.example.com ")], "a string, b string, h string")
    r = df.select(pg_concat("a", F.lit(" "), "b").alias("c"), js_template(F.col("a"), ", ", F.col("b")).alias("t"),
                  first_label(F.col("h")).alias("s"),
                  conflict_labels([(F.lit(True), "Email"), (F.lit(False), "Phone"), (F.lit(True), "Bank")]).alias("l")
                  ).collect()[0]
    assert (r.c, r.t, r.s, r.l) == ("Ann ", "Ann, null", "shop-a", "Email, Bank")


def test_defaults(spark):
    df = spark.createDataFrame([(1, None)], "id int, status string")
    r = apply_defaults(df, {"status": "Pending", "deleted": False}).collect()[0]
    assert (r.status, r.deleted) == ("Pending", False)


def test_calendar_and_labels(spark):
    base = spark.range(1).select()
    as_of = "2024-01-24 15:30:00"
    day = calendar(base, "day", as_of).select("period", period_label(F.col("period"), "day", as_of).alias("l")).collect()
    assert len(day) == 25 and day[0].period == dt.datetime(2024, 1, 23, 15) and day[0].l == "3 PM"
    week = calendar(base, "week", as_of).select(period_label(F.col("period"), "week", as_of).alias("l")).collect()
    assert [r.l for r in week][-3:] == ["Jan 22", "Yesterday", "Today"]
    assert series_window("year", as_of)[1] == dt.datetime(2024, 1, 1)


def test_nest_splits_hot_keys_without_dropping(spark):
    rows = [(1, i) for i in range(250)] + [(2, 7)]
    df = spark.createDataFrame(rows, "k int, v int")
    out = nest(df, ["k"], ["v"], "items", max_items=100).collect()
    hot = [r for r in out if r.k == 1]
    assert len(hot) >= 3 and all(len(r["items"]) <= 150 for r in hot)
    assert sorted(x.v for r in hot for x in r["items"]) == list(range(250))
    assert [len(r["items"]) for r in out if r.k == 2] == [1]
    t = spark.createDataFrame([([(1, "a"), (2, None)],)], "xs array<struct<i:int, s:string>>")
    assert t.select(nested_text("xs", ["i", "s"])).collect()[0][0] == "1|a; 2|null"


def test_nest_has_one_layout_at_every_size(spark):
    hot = spark.range(60_000).selectExpr("1 as k", "cast(id % 40000 as int) as v")
    rows = hot.unionByName(spark.createDataFrame([(2, 7), (None, 8)], "k int, v int"))
    whole = {r.k: [x.v for x in r["items"]] for r in nest(rows, ["k"], ["v"], "items").collect()}
    assert nest(rows, ["k"], ["v"], "items").count() == 3
    assert whole == {1: sorted(i % 40_000 for i in range(60_000)), 2: [7], None: [8]}
    same = rows.unionByName(spark.range(2_500).selectExpr("3 as k", "5 as v"))
    parts = nest(same, ["k"], ["v"], "items", max_items=1_000).collect()
    sizes = {k: sorted((r.part_no, len(r["items"])) for r in parts if r.k == k) for k in (1, 2, 3, None)}
    assert sizes == {1: [(i, 1_000) for i in range(60)], 2: [(0, 1)], 3: [(0, 1_000), (1, 1_000), (2, 500)], None: [(0, 1)]}
    assert sorted(x.v for r in parts if r.k == 1 for x in r["items"]) == whole[1]


def test_asof_join_matches_brute_force(spark):
    rnd = random.Random(7)
    t0 = dt.datetime(2024, 1, 1)
    right = [(rnd.choice("abc"), i, t0 + dt.timedelta(minutes=rnd.randint(0, 600))) for i in range(200)]
    left = [(rnd.choice("abcd"), i, t0 + dt.timedelta(minutes=rnd.randint(0, 600))) for i in range(300)]
    r = spark.createDataFrame(right, "k string, rid int, t timestamp_ntz")
    l_ = spark.createDataFrame(left, "k string, lid int, lt timestamp_ntz")
    got = {x.lid: (x.m.rid if x.m else None) for x in
           asof_join(l_, r, ["k"], "lt", "t", ["rid"], ["rid"], ranges=12, name="m").collect()}
    want = {}
    for k, lid, lt in left:
        cands = [(t, rid) for kk, rid, t in right if kk == k and t <= lt]
        want[lid] = max(cands)[1] if cands else None
    assert got == want


def test_not_in_null_rule(spark):
    jobs = spark.createDataFrame([(1,), (2,), (3,)], "job_id long")
    applied = spark.createDataFrame([(10, 1), (11, None), (12, 2)], "user long, job_id long")
    pairs = spark.createDataFrame([(u, j) for u in (10, 11, 12) for j in (1, 2, 3)], "user long, job_id long")
    got = sorted(tuple(r) for r in not_in_anti(pairs, applied, "job_id", by=["user"]).collect())
    assert got == [(10, 2), (10, 3), (12, 1), (12, 3)]          # user 11 has a NULL: nothing
    assert not_in_anti(jobs, applied.select("job_id"), "job_id").count() == 0


def test_range_prefix_sums_match_plain_window(spark):
    from pyspark.sql import Window
    from tillpoint.functions.ordering import border_keys, in_ranges
    from tillpoint.operators.checkout import prefix_sums
    rnd = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [("hot", i, t0 + dt.timedelta(seconds=rnd.randint(0, 50)), rnd.randint(1, 9)) for i in range(400)]
    rows += [(f"k{j}", 1000 + j, t0 + dt.timedelta(seconds=j), 1) for j in range(20)]
    df = spark.createDataFrame(rows, "key string, id long, t timestamp_ntz, v long")
    df = df.unionByName(spark.createDataFrame([("same", 2000 + i, t0, 1) for i in range(300)], df.schema))     # one time
    b = in_ranges(df, ["key"], ["t", "id"], 16)
    for key in ("hot", "same"):
        assert b.filter(F.col("key") == key).select("_b").distinct().count() > 4        # the hot keys are split
    borders = border_keys(b, ["key"])
    assert {"hot", "same"} <= {r.key for r in borders.collect()} and borders.count() <= 16
    got = {r.id: r.s for r in prefix_sums(b, "key", ["t", "id"], {"s": "v"}, borders).collect()}
    w = Window.partitionBy("key").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.id: (r.s or 0) for r in df.select("id", F.sum("v").over(w).alias("s")).collect()}
    assert got == want


def test_name_uuid_is_version_5(spark):
    import uuid
    from tillpoint.functions.ids import NAMESPACE, name_uuid
    rows = spark.createDataFrame([(i, f"é{i}") for i in range(300)] + [(None, None)], "a long, b string")
    for r in rows.select("a", "b", name_uuid("t", F.col("a"), F.col("b")).alias("id")).collect():
        name = f"t/{'' if r.a is None else r.a}/{r.b or ''}"
        assert r.id == str(uuid.uuid5(NAMESPACE, name))
