"""Open-job bitmaps against NOT IN, user by user."""

from tests.conftest import SF_SMALL
from tillpoint.operators import jobboard as JB
from tillpoint.plans.reports_catalog import applications_with_gaps
from tillpoint.sources.bindings import commerce_binding


def not_in(users, jobs, applications):
    out = set()
    for u in users:
        mine = [j for user, j in applications if user == u]
        out |= set() if None in mine else {(u, j) for j, status in jobs if status == "open" and j not in mine}
    return out


def expanded(spark, users, jobs, applications):
    job_list = spark.createDataFrame(jobs, "job_id long, status string")
    bits = JB.open_job_bits(job_list, spark.createDataFrame(applications, "job_user_id long, job_id long"))
    found = JB.open_jobs_of(spark.createDataFrame([(u,) for u in users], "job_user_id long"), bits, job_list).collect()
    assert len(found) == len({(r["job_user_id"], r["job_id"]) for r in found})
    return {(r["job_user_id"], r["job_id"]) for r in found}


def test_made_rows(spark):
    jobs = [(j, "open" if j % 3 else "closed") for j in [1, 2, 3, 63, 64, 65, 127, 1023, 1024, 1025, 2047, 2048, 9000, 9001, -5]]
    applications = [(1, 1), (1, 1), (1, 64), (1, 9001), (2, None), (2, 2), (3, 3), (3, 7777), (None, 65), (4, 1024), (4, 1025)]
    assert expanded(spark, [1, 2, 3, 4, 5, 5], jobs, applications) == not_in([1, 2, 3, 4, 5], jobs, applications)
    assert expanded(spark, [1, 2], [(3, "closed")], applications) == set()
    assert expanded(spark, [1], jobs, []) == not_in([1], jobs, [])
    assert expanded(spark, [], jobs, applications) == set()


def test_all_users_of_the_tables(spark):
    c = commerce_binding(spark, SF_SMALL)
    apps = applications_with_gaps(c)
    users = [r[0] for r in c.job_user.select("job_user_id").collect()]
    jobs = [tuple(r) for r in c.job_list.select("job_id", "status").collect()]
    got = JB.open_jobs_of(c.job_user, JB.open_job_bits(c.job_list, apps), c.job_list.select("job_id"))
    assert {(r["job_user_id"], r["job_id"]) for r in got.collect()} == not_in(users, jobs, [tuple(r) for r in apps.collect()])
