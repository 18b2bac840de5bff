"""Queries against their SQL in DuckDB, plans, goldens derived by hand, and streams against batches."""

import os
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.functions import resume, salary, text
from jobloom.operators import match
from jobloom.operators.components import connected_components
from jobloom.plans import reference
from jobloom.sources import feeds, pages
from jobloom.streaming import stateful
from jobloom.tables import table


def rows(it, cols, order):
    ix = [order.index(c) for c in cols]
    cell = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return Counter(repr(tuple(cell(r[i]) for i in ix)) for r in it)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(reference.SQL))
def test_same_as_sql(spark, sf, duck, name):
    df = reference.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = duck.execute(reference.SQL[name])
    order = [x[0] for x in got.description]
    assert sorted(order) == cols
    assert rows(df.collect(), cols, df.columns) == rows(got.fetchall(), cols, order)


@pytest.mark.parametrize("name", sorted(set(reference.QUERIES) - set(reference.SQL)))
def test_runs(spark, sf, name):
    assert reference.QUERIES[name](spark, sf).count() >= 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


SALARY = [
    ("$129k-$161k/yr", 129000, 161000, "USD", "year", "range", "high"), ("NGN 6M - 8M", 6000000, 8000000, "NGN", "year", "range", "medium"), (None, None, None, None, "unknown", "unspecified", "low"),
    ("Apply Now", None, None, None, "year", "unspecified", "low"), ("$80,000/yr", 80000, 80000, "USD", "year", "unspecified", "high"), ("R25k per month", 25000, 25000, "ZAR", "month", "unspecified", "high"),
    ("$80,000 - $100,000", 0, 100, "USD", "year", "range", "high"), ("Remote, 50k", 50000, 50000, "ZAR", "month", "unspecified", "high"),
]


def test_salary_goldens(spark):
    df = spark.createDataFrame([(r[0],) for r in SALARY], "t string").select("t", salary.parse(F.col("t")).alias("p")).select("t", "p.*")
    assert sorted(map(tuple, df.collect()), key=str) == sorted(SALARY, key=str)


@pytest.mark.parametrize("title,body,want", [("Senior Software Engineer (Junior team lead welcome)", "", "senior"), ("Graduate Trainee", "", "entry"), ("Software Engineer", "2 years experience", "senior"), ("Engineer", "", "unspecified")])
def test_experience_goldens(spark, title, body, want):
    assert one(spark, text.experience_level(F.lit(title), F.lit(body))) == want


def test_seniority_goldens(spark):
    got = [one(spark, text.seniority_score(F.lit(t), F.lit(""))) for t in ("Junior Developer", "Graduate Intern", "Senior Lead Architect")]
    assert got == [3, 6, -10]


def test_resume_goldens(spark):
    full = dict(reference.MD)["full"]
    got = spark.createDataFrame([(full,)], "t string").select(resume.score(F.col("t")).alias("r")).select("r.*").first()
    assert (got.contact, got.summary, got.skills, got.education, got.certifications) == (10, 10, 7, 10, 10)
    assert resume.reformat("## WORK history \n| a | b |\n|---|---|\n| 1 | 2 |\n\n\n\nend").split("\n")[:2] == ["## Work History", "- a: 1; b: 2"]


def test_pages():
    html = "<body><nav>n</nav><article>Hello  <b>world</b> " + "x" * 100 + "</article><article>two</article><a href='/jobs/1#a'>j</a><a href='#x'>s</a></body>"
    assert pages.page_text(html).startswith("Hello world x") and "two" not in pages.page_text(html)
    assert pages.page_text("<body>short</body>") is None and pages.page_text(None) is None
    assert pages.page_links(html, "https://h.example/p") == ["https://h.example/jobs/1"]
    assert pages.allowed("User-agent: *\nDisallow: /private", "https://h.example/private/x") is False and pages.allowed(None, "/x")


AT = 1767139200  # as_of, in seconds
STATED = {
    "2025-12-30": AT - 86400, f"{AT - 70 * 86400}": AT - 70 * 86400, f"{AT - 3600}123": AT - 3600 + 0.123, "Mon, 29 Dec 2025 10:00:00 +0100": AT - 2 * 86400 + 9 * 3600, "Oct 1, 2025": AT - 91 * 86400,
    "December 1, 2025": AT - 30 * 86400, "2025-12-30T23:00:00-02:00": AT + 3600, "2025-12-30 01:00:00.250Z": AT - 82799.75, "Recently": None, None: None,
}


def test_every_readable_date_counts(spark, sf, tmp_path):
    """The queries on posting dates against brute force over texts in every form that is read, and relative ones."""
    first = table(spark, sf, "jobs").where("id is not null").limit(1)
    texts = list(STATED) + ["3 months ago", "a week ago"]
    urls = [f"https://apply.other.example/{i % 3}" for i in range(len(texts))]
    made = spark.createDataFrame([(f"j{i:02}", t, u) for i, (t, u) in enumerate(zip(texts, urls, strict=True))], "id string, posted_date string, apply_url string")
    plain = first.drop("id", "posted_date", "apply_url").withColumns({"title": F.lit("Data Engineer"), "company": F.lit("Acme Ltd"), "source_site": F.lit("feed.example"), "source_url": F.lit("https://feed.example/jobs/data-engineer"), "description": F.lit("Responsibilities and requirements: a data engineer who builds pipelines with us. " * 5), "crawled_at": F.lit(reference.AS_OF).cast("timestamp")})
    made.crossJoin(plain).write.parquet(f"{tmp_path}/jobs.parquet")
    age = {t: (AT - v) / 86400 for t, v in STATED.items() if v is not None} | {"3 months ago": 90.0, "a week ago": 7.0}
    got = {n: {r.id: r[1] for r in reference.QUERIES[n](spark, str(tmp_path)).collect()} for n in ("posted_age", "stale_flag")}
    assert got["posted_age"] == {f"j{i:02}": round(age[t], 3) if t in age else None for i, t in enumerate(texts)}
    assert got["stale_flag"] == {f"j{i:02}": age.get(t, 0) > 60 for i, t in enumerate(texts)}
    best = {}
    for i, (t, u) in enumerate(zip(texts, urls, strict=True)):
        best[u] = max(best.get(u, (-1, 0)), (int((STATED.get(t) or 0) * 1000), -i))
    kept = {-i for _, i in best.values()}
    assert {r.id for r in reference.QUERIES["dedup_apply_url"](spark, str(tmp_path)).collect()} == {f"j{i:02}" for i in kept}
    counts = {r.action: r.n for r in reference.QUERIES["cleanup_counts"](spark, str(tmp_path)).collect()}
    stale = sum(age.get(texts[i], 0) > 60 for i in kept)
    assert counts["duplicate"] == len(texts) - len(kept) and counts.get("prune", 0) == stale and sum(counts.values()) == len(texts)


def test_search_stays_native_and_pruned(spark, sf):
    plan = reference.QUERIES["scan_recent"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan and "description" not in plan
    assert "Cartesian" not in reference.QUERIES["match_topk"](spark, sf)._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {x: find(x) for x in parent}


def test_stream_equals_batch(spark, sf, tmp_path):
    table(spark, sf, "events").repartition(3).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = stateful.dedup_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "user_id")
    q = stream.select("user_id").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = table(spark, sf, "events").select("user_id").distinct().count()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == want


def test_session_fold_stream(spark, tmp_path):
    rows = [(1, 1, "a@x.example", None), (1, 2, "b@x.example", "Oslo"), (2, 1, None, " "), (1, 3, None, "Bern"), (2, 2, None, "Rome")]
    spark.createDataFrame(rows, "conv long, turn long, email string, place string").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("conv long, turn long, email string, place string").parquet(f"{tmp_path}/in")
    q = stateful.fold_fields(src, "conv", "turn", ["email", "place"]).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.conv, r.turn): (r.email, r.place) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(1, 1): ("a@x.example", None), (1, 2): ("a@x.example", "Oslo"), (1, 3): ("a@x.example", "Oslo"), (2, 1): (None, None), (2, 2): (None, "Rome")}


def test_sitemaps_and_resumes(spark):
    xml = "<urlset><url><loc>https://h.example/jobs/1</loc></url><url><loc> https://h.example/about </loc></url></urlset>"
    df = spark.createDataFrame([(xml,), (xml,), (None,)], "xml string")
    assert [r.url for r in feeds.read_sitemaps(df, holds="JOBS").collect()] == ["https://h.example/jobs/1"]
    up = spark.createDataFrame([("a", "text", "x" * 30), ("b", "txt", "aGVsbG8gd29ybGQsIHRoaXMgaXMgYSByZXN1bWU="), ("c", "txt", "!!"), ("d", "text", "short"), ("e", None, None)], "id string, kind string, body string")
    assert {r.id: r.resume_text for r in feeds.read_resumes(up).collect()} == {"a": "x" * 30, "b": "hello world, this is a resume"}


def test_rescore_fold():
    assert stateful.rescore_points([10, 12, 14, 18, 19]) == [True, False, True, False, True]


def test_ats_neutral(spark):
    none = F.array().cast("array<struct<term:string,n:bigint>>")
    assert one(spark, match.ats_relevance(F.lit("t"), F.lit("d"), F.array(F.lit("x")), none, F.array(F.lit("x")))) == 0.5
