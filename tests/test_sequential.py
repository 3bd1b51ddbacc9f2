"""Hand-over of unique values against handling the requests one at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tillpoint.functions.graph import connected_components
from tillpoint.operators import mutations as M, sequential
from tillpoint.operators.sequential import replay_unique


def one_at_a_time(table, requests, columns):
    """table: {row: {column: value}}; requests: (id, row, {column: value}) in order."""
    held = {k: dict(v) for k, v in table.items()}
    taken = {}
    for i, row, sets in requests:
        clash = sorted(c for c, v in sets.items() if v is not None
                       and any(k != row and other[c] == v for k, other in held.items()))
        if clash:
            taken[i] = clash
        elif row in held:
            held[row].update(sets)
    return taken, held


@pytest.mark.parametrize("seed", range(6))
def test_replay_of_random_requests(spark, seed):
    rng = random.Random(seed)
    columns = ["email", "phone"][: 1 + seed % 2]
    rows, names = 5 + 12 * (seed % 3), 4 + 10 * (seed % 3)
    value = lambda: rng.choice([None, *(f"v{n}" for n in range(names)), "hot", "hot"])
    table = {k: {c: value() for c in columns} for k in range(rows)}             # values may be held twice at the start
    requests = [(10 * i, rng.randrange(rows + 2), {c: value() for c in columns if rng.random() < 0.8}) for i in range(150)]
    schema = ", ".join(f"{c} string" for c in columns)
    t = spark.createDataFrame([(k, *(v[c] for c in columns)) for k, v in table.items()], f"id int, {schema}")
    r = spark.createDataFrame([(i, k, list(s), *(s.get(c) for c in columns)) for i, k, s in requests],
                              f"request_id long, id int, provided array<string>, {schema}").repartition(4)
    want, after = one_at_a_time(table, requests, columns)
    got = replay_unique(t, r, "id", columns, F.col("provided"), F.col("id") < rows)
    assert {x["request_id"]: x["taken"] for x in got.collect()} == want
    out = M.patch_rows(t, r, "id", columns, conflict_keys=columns, touch_col=None)
    assert {x["id"]: {c: x[c] for c in columns} for x in out.table.collect()} == after
    codes = {x["request_id"]: x["http_code"] for x in out.outcome.collect()}
    assert codes == {i: 400 if not s else 409 if i in want else 404 if k >= rows else 200 for i, k, s in requests}


@pytest.mark.parametrize("seed,slice_rows", [(0, 25), (1, 40), (3, 60), (4, 1000)])
def test_replay_in_slices(spark, monkeypatch, seed, slice_rows):
    """A component larger than a slice: no task sorts all of it, values are handed on from slice to slice."""
    rng = random.Random(100 + seed)
    columns = ["email", "phone"][: 1 + seed % 2]
    rows, names = 9 + 6 * seed, 8 + 4 * seed
    value = lambda: rng.choice([None, *(f"v{n}" for n in range(names)), "hot"])
    table = {k: {c: value() for c in columns} for k in range(rows)}
    requests = [(10 * i, rng.randrange(rows + 2), {c: value() for c in columns if rng.random() < 0.8}) for i in range(250)]
    schema = ", ".join(f"{c} string" for c in columns)
    t = spark.createDataFrame([(k, *(v[c] for c in columns)) for k, v in table.items()], f"id int, {schema}")
    r = spark.createDataFrame([(i, k, list(s), *(s.get(c) for c in columns)) for i, k, s in requests],
                              f"request_id long, id int, provided array<string>, {schema}").repartition(4)
    streams = []
    handed_on = sequential._handed_on
    monkeypatch.setattr(sequential, "_handed_on", lambda df, folder: (streams.append(df), handed_on(df, folder)))
    got = replay_unique(t, r, "id", columns, F.col("provided"), F.col("id") < rows, slice_rows=slice_rows)
    assert {x["request_id"]: x["taken"] for x in got.collect()} == one_at_a_time(table, requests, columns)[0]
    assert len(streams) == 3 if slice_rows == 1000 else len(streams) > 3          # held at the start, marks, a write per slice


def jobs_of(spark, columns, n):
    """Jobs of a replay of n rows that each ask for what the next row holds, in the order that makes one long chain."""
    schema = ", ".join(f"{c} string" for c in columns)
    t = spark.createDataFrame([(i, *(f"s{i}" for _ in columns)) for i in range(n)], f"id int, {schema}")
    r = spark.createDataFrame([(n - i, i, *(f"s{i + 1}" for _ in columns)) for i in range(n)], f"request_id long, id int, {schema}")
    group = f"chain-{len(columns)}-{n}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {x["request_id"]: x["taken"] for x in replay_unique(t, r, "id", columns).collect()}
        assert got == {}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("columns", [["subdomain"], ["bank_account_number", "email", "phone"]])
def test_jobs_do_not_grow_with_chains(spark, columns):
    """Time went into finding the groups of requests that hang together, round after round."""
    assert jobs_of(spark, columns, 400) <= jobs_of(spark, columns, 3) + 2


@pytest.mark.parametrize("slice_rows", [30, 1000])
def test_replay_of_three_columns(spark, monkeypatch, slice_rows):
    """Values held by several rows, rows without requests, requests of no row; codes that clash at first are made anew."""
    rng = random.Random(slice_rows)
    columns, rows = ["email", "phone", "bank"], 14
    value = lambda: rng.choice([None, *(f"v{n}" for n in range(12)), "hot"])
    table = {k: {c: value() for c in columns} for k in range(rows)}
    requests = [(i - 60, rng.randrange(4, rows + 2), {c: value() for c in columns if rng.random() < 0.5}) for i in range(200)]
    schema = ", ".join(f"{c} string" for c in columns)
    t = spark.createDataFrame([(k, *(v[c] for c in columns)) for k, v in [*table.items(), *table.items()]]
                              + [(None, "hot", "hot", "v1")], f"id int, {schema}")
    r = spark.createDataFrame([(i, k, list(s), *(s.get(c) for c in columns)) for i, k, s in requests + requests[:50]]
                              + [(7, None, columns, "v1", "v2", "v3"), (None, 5, columns, "v1", "v2", "v3")],
                              f"request_id int, id int, provided array<string>, {schema}").repartition(4)
    code, seeds = sequential._code, []
    monkeypatch.setattr(sequential, "_code", lambda seed, name: (seeds.append(seed), code(seed, name) % (5 if seed < 2 else 1 << 62))[1])
    got = replay_unique(t, r, "id", columns, F.col("provided"), F.col("id") < rows, slice_rows=slice_rows)
    assert max(seeds) == 2 and got.schema["request_id"].dataType.simpleString() == "int"
    assert {x["request_id"]: x["taken"] for x in got.collect()} == one_at_a_time(table, requests, columns)[0]


def test_row_that_comes_twice_with_other_values(spark):
    """It holds both values, frees the one it has as its own and may ask for the other."""
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, name string")
    r = spark.createDataFrame([(1, 2, "a"), (2, 2, "b"), (3, 1, "a"), (4, 1, "b"), (5, 2, "a"), (6, 1, "x"), (7, 2, "b")],
                              "request_id long, id int, name string")
    for slice_rows in (1, 2, 100):
        got = replay_unique(t, r, "id", ["name"], slice_rows=slice_rows)
        assert {x["request_id"] for x in got.collect()} == {1, 2}


def subdomains(spark, held, requests):
    clients = spark.createDataFrame(held, "client_id int, subdomain string")
    out = M.set_subdomains(clients, spark.createDataFrame(requests, "request_id long, client_id int, subdomain string"))
    return ({r["request_id"]: r["http_code"] for r in out.outcome.collect()},
            {r["client_id"]: r["subdomain"] for r in out.table.collect()})


def test_freed_swapped_and_saved_again(spark):
    # 1 frees a, 2 takes it; 2 frees b, 1 takes it; 3 saves its own name again, and again once it has changed
    codes, table = subdomains(spark, [(1, "a"), (2, "b"), (3, "c"), (4, None)], [
        (1, 1, "x"), (2, 2, "a"), (3, 1, "b"), (4, 3, "c"), (5, 4, "c"), (6, 3, "d"), (7, 4, "c"), (8, 3, "c"), (9, 9, "z"),
        (10, 4, None), (11, 3, "c"), (12, 9, "a")])
    assert codes == {1: 200, 2: 200, 3: 200, 4: 200, 5: 400, 6: 200, 7: 200, 8: 400, 9: 401, 10: 200, 11: 200, 12: 401}
    assert table == {1: "b", 2: "a", 3: "c", 4: None}


def test_long_chain_of_handed_down_names(spark):
    n = 60
    codes, table = subdomains(spark, [(i, f"s{i}") for i in range(n)], [(i, i, f"s{i - 1}" if i else "free") for i in range(n)])
    assert set(codes.values()) == {200} and table == {i: f"s{i - 1}" if i else "free" for i in range(n)}
    codes, table = subdomains(spark, [(i, f"s{i}") for i in range(n)], [(n - i, i, f"s{i - 1}" if i else "free") for i in range(n)])
    assert sorted(codes.values()) == [200] + [400] * (n - 1)


def test_two_patches_to_one_email(spark):
    table = spark.createDataFrame([(1, "a", "p"), (2, "b", None), (3, None, None)], "id int, email string, phone string")
    patches = spark.createDataFrame([(1, 2, ["email"], "new", None), (2, 3, ["email", "phone"], "new", "p"),
                                     (3, 2, ["email"], None, None), (4, 3, ["email"], "new", None), (5, 3, ["phone"], None, "q")],
                                    "request_id long, id int, provided array<string>, email string, phone string")
    out = M.patch_rows(table, patches, "id", ["email", "phone"], conflict_keys=["email", "phone"], touch_col=None)
    got = {r["request_id"]: (r["http_code"], r["message"]) for r in out.outcome.collect()}
    assert got[1] == (200, "updated") and got[2] == (409, "Email, Phone already exists for another employee.")
    assert got[3][0] == got[4][0] == got[5][0] == 200
    assert sorted(tuple(r) for r in out.table.collect()) == [(1, "a", "p"), (2, None, None), (3, "new", "q")]


def test_empty_batches(spark):
    table = spark.createDataFrame([(1, "a")], "client_id int, subdomain string")
    none = spark.createDataFrame([], "request_id long, client_id int, subdomain string")
    out = M.set_subdomains(table, none)
    assert out.outcome.collect() == [] and out.table.collect() == table.collect()
    assert M.set_subdomains(table.filter("false"), none).table.collect() == []


@pytest.mark.parametrize("edges,want", [
    ([], {}),
    ([(f"n{i:03}", f"n{i + 1:03}") for i in range(100)], {f"n{i:03}": "n000" for i in range(101)}),
    ([("hub", f"x{i}") for i in range(300)] + [("b", "a"), ("a", "a"), ("c", "b")],
     {**{f"x{i}": "hub" for i in range(300)}, "hub": "hub", "a": "a", "b": "a", "c": "a"}),
])
def test_connected_components(spark, edges, want):
    got = connected_components(spark.createDataFrame(edges, "a string, b string"))
    assert {r["node"]: r["comp"] for r in got.collect()} == want
