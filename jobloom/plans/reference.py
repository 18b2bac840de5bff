"""The search, matching, cleaning and upkeep queries over whole tables, each with its SQL equivalent where there is one.

Relations that no input table plays (chat messages, pages, feed payloads) are small constants given to both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobloom.functions import dates, js, resume, salary, text
from jobloom.operators import match, search, upkeep
from jobloom.plans import duck as d
from jobloom.sources import feeds, pages
from jobloom.streaming import stateful
from jobloom.tables import table

AS_OF = "2025-12-31 00:00:00"
TS = f"TIMESTAMP '{AS_OF}'"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def jobs_query(name: str, columns: Callable[[], dict[str, Column]], sql: str) -> None:
    """A query that adds columns to the id of every posting; sql is the list of the same columns."""
    QUERIES[name] = lambda s, dd: table(s, dd, "jobs").select("id", *[c.alias(n) for n, c in columns().items()])
    SQL[name] = f"SELECT id, {sql} FROM jobs"


def values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else d.q(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


C = F.col


def body() -> Column:
    return F.coalesce("description", F.lit(""))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


joined = lambda c: F.array_join(c, "|")
us = lambda c: F.unix_micros(c)

# -- scans, filters and search ---------------------------------------------------------------------------------------
TOP = "ORDER BY created_at DESC, id LIMIT 50"


@query(f"SELECT id, title, company, epoch_us(created_at) AS created_us FROM jobs {TOP}")
def scan_recent(s, dd):
    return search.newest(table(s, dd, "jobs"), ["id", "title", "company", "created_at"], 50).select("id", "title", "company", us("created_at").alias("created_us"))


@query("SELECT id, experience_level, source_site, apply_url FROM jobs ORDER BY id LIMIT 1000")
def scan_health_cols(s, dd):
    return table(s, dd, "jobs").select("id", "experience_level", "source_site", "apply_url").orderBy("id").limit(1000)


@query("SELECT id, title, company, description, array_to_string(skills, '|') AS skills, remote_status, apply_url, posted_date, source_site, source_url, experience_level FROM jobs ORDER BY crawled_at DESC, id LIMIT 1000")
def scan_cleanup(s, dd):
    cols = ["id", "title", "company", "description", "skills", "remote_status", "apply_url", "posted_date", "source_site", "source_url", "experience_level"]
    return search.newest(table(s, dd, "jobs"), cols, 1000, "crawled_at").withColumn("skills", joined(C("skills")))


@query("SELECT id, title, company FROM jobs WHERE id = (SELECT min(job_id) FROM job_vectors)")
def point_lookup(s, dd):
    key = table(s, dd, "job_vectors").agg(F.min("job_id")).first()[0]
    return table(s, dd, "jobs").where(C("id") == key).select("id", "title", "company")


FRESH = f"crawled_at >= {TS} - INTERVAL 60 DAY"


@query(f"SELECT id, title FROM jobs WHERE {FRESH} ORDER BY crawled_at DESC, id LIMIT 50")
def search_fresh(s, dd):
    return search.search(table(s, dd, "jobs"), AS_OF).select("id", "title")


@query(f"SELECT id, title FROM jobs WHERE {FRESH} AND (title ILIKE '%data%' OR company ILIKE '%data%' OR description ILIKE '%data%') ORDER BY crawled_at DESC, id LIMIT 50")
def search_text(s, dd):
    return search.search(table(s, dd, "jobs"), AS_OF, term=" data ").select("id", "title")


@query(f"SELECT id, location FROM jobs WHERE {FRESH} AND location ILIKE '%berlin%' ORDER BY crawled_at DESC, id LIMIT 50")
def search_location(s, dd):
    return search.search(table(s, dd, "jobs"), AS_OF, location="berlin").select("id", "location")


@query(f"SELECT id, remote_status FROM jobs WHERE {FRESH} AND remote_status = 'remote' ORDER BY crawled_at DESC, id LIMIT 50")
def search_remote(s, dd):
    return search.search(table(s, dd, "jobs"), AS_OF, remote=True).select("id", "remote_status")


@query(f"SELECT id, title FROM jobs WHERE {FRESH} AND list_has_any(skills, ['Python', 'Java']) ORDER BY crawled_at DESC, id LIMIT 50")
def search_skills_overlap(s, dd):
    return search.search(table(s, dd, "jobs"), AS_OF, skills=["Python", "Java"]).select("id", "title")


@query("SELECT DISTINCT job_id FROM applications WHERE job_id IN (SELECT job_id FROM job_vectors)")
def semi_known_urls(s, dd):
    return search.known(table(s, dd, "applications").select("job_id"), table(s, dd, "job_vectors"), "job_id").distinct()


@query("SELECT id FROM jobs WHERE id NOT IN (SELECT job_id FROM job_vectors)")
def anti_known_urls(s, dd):
    return search.unknown(table(s, dd, "jobs").select(C("id").alias("job_id")), table(s, dd, "job_vectors"), "job_id").select(C("job_id").alias("id"))


@query(f"SELECT DISTINCT source_url FROM jobs WHERE NOT {d.has('source_url', text.NON_JOB_URL_PARTS)} AND NOT {d.has('lower(source_url)', text.JUNK_URL_PARTS)} AND id NOT IN (SELECT job_id FROM applications)")
def discover_fresh(s, dd):
    jobs = table(s, dd, "jobs").where(~text.non_job_url(C("source_url")) & ~text.junk_url(C("source_url")))
    return jobs.join(table(s, dd, "applications").select(C("job_id").alias("id")), "id", "left_anti").select("source_url").distinct()


@query(f"WITH p AS (SELECT id, title, md5('0' || id) h FROM jobs WHERE {FRESH} ORDER BY crawled_at DESC, id LIMIT 100) SELECT id, title FROM p ORDER BY h, id LIMIT 20")
def random_browse(s, dd):
    return search.browse(table(s, dd, "jobs"), AS_OF)


# -- vectors ---------------------------------------------------------------------------------------------------------
USABLE = "embedding IS NOT NULL AND len(embedding) = 384 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0"
QV = f"(SELECT embedding::DOUBLE[] FROM job_vectors WHERE {USABLE} ORDER BY job_id, id LIMIT 1)"
SIM = f"SELECT job_id, max(list_cosine_similarity(embedding::DOUBLE[], {QV})) sim FROM job_vectors WHERE {USABLE} GROUP BY job_id"


def query_vector(s, dd) -> list[float]:
    good = table(s, dd, "job_vectors").where((F.size("embedding") == 384) & F.exists("embedding", lambda x: x != 0))
    return good.orderBy("job_id", "id").select("embedding").first()[0]


@query("SELECT v.id AS vector_id, v.job_id, j.title FROM job_vectors v JOIN jobs j ON v.job_id = j.id")
def join_vectors_jobs(s, dd):
    v, j = table(s, dd, "job_vectors"), table(s, dd, "jobs")
    return v.join(j, v.job_id == j.id).select(v.id.alias("vector_id"), v.job_id, j.title)


@query(f"SELECT job_id, round(sim, 6) AS similarity FROM ({SIM})")
def match_vectors(s, dd):
    sims = match.similar(table(s, dd, "job_vectors"), query_vector(s, dd))
    return sims.groupBy("job_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


@query(f"SELECT job_id, round(sim, 6) AS similarity FROM ({SIM}) WHERE sim > 0.2")
def match_threshold(s, dd):
    sims = match.similar(table(s, dd, "job_vectors"), query_vector(s, dd)).where("similarity > 0.2")
    return sims.groupBy("job_id").agg(F.round(F.max("similarity"), 6).alias("similarity"))


@query(f"SELECT j.id, j.title, round(sim, 6) AS similarity FROM ({SIM}) JOIN jobs j ON job_id = j.id WHERE sim > 0.2 ORDER BY sim DESC, job_id LIMIT 50")
def match_topk(s, dd):
    top = match.match_jobs(table(s, dd, "job_vectors"), table(s, dd, "jobs"), query_vector(s, dd), 0.2, 50)
    return top.select("id", "title", F.round("similarity", 6).alias("similarity"))


def first_profile(s, dd) -> DataFrame:
    return table(s, dd, "profiles").where("size(skills) > 0 and length(resume_text) > 50").orderBy("id").limit(1)


@query()
def rerank(s, dd):
    who = first_profile(s, dd)
    top = match.match_jobs(table(s, dd, "job_vectors"), table(s, dd, "jobs"), query_vector(s, dd), 0.2, 100)
    out = match.rerank(top, who, match.top_terms(who), AS_OF)
    return out.select("id", F.round("score", 6).alias("score"), "ats", joined(C("matched_skills")).alias("matched"), joined(C("missing_skills")).alias("missing"), joined(C("reasons")).alias("reasons"))


STOP = ", ".join(map(d.q, match.STOP_WORDS))
TERMS = f"""WITH w AS (SELECT id, string_split_regex(lower(resume_text), '[^a-z0-9_]+') ws FROM profiles),
u AS (SELECT id, unnest(ws) term, unnest(range(len(ws))) pos FROM w), c AS (SELECT id, term, count(*) n, min(pos) f FROM u WHERE length(term) >= 4 AND term NOT IN ({STOP}) GROUP BY ALL)"""


@query(f"{TERMS} SELECT id, term, n FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, f) <= 50")
def term_top50(s, dd):
    return match.top_terms(table(s, dd, "profiles").where("resume_text is not null"))


WHO = "(SELECT id FROM profiles WHERE len(skills) > 0 AND length(resume_text) > 50 ORDER BY id LIMIT 1)"


@query(f"""{TERMS}, t AS (SELECT term, n FROM c WHERE id = {WHO} QUALIFY row_number() OVER (ORDER BY n DESC, f) <= 50),
x AS (SELECT j.id, sum((contains(lower(coalesce(title, '')), term)::INT * 3 + least((length(lower(coalesce(description, ''))) - length(replace(lower(coalesce(description, '')), term, ''))) // length(term), 3)) * ln(n + 1.0)) got, sum(7 * ln(n + 1.0)) most FROM jobs j, t GROUP BY j.id)
SELECT id, floor(least(got / most, 1) * 100 + 0.5) / 100 AS ats FROM x""")
def ats_terms(s, dd):
    terms = match.top_terms(first_profile(s, dd)).agg(F.collect_list(F.struct("term", "n")).alias("terms"))
    none = F.array().cast("array<string>")
    jobs = table(s, dd, "jobs").select("id", "title", "description").crossJoin(F.broadcast(terms))  # one row of at most 50 terms
    return jobs.select("id", match.ats_relevance(C("title"), C("description"), none, C("terms"), none).alias("ats"))


SK = "list_filter(list_transform(coalesce(j.skills, []), lambda x: lower(trim(x))), lambda x: length(x) > 0)"
US = f"(SELECT list_filter(list_transform(skills, lambda x: lower(trim(x))), lambda x: length(x) > 0) FROM profiles WHERE id = {WHO})"


@query(f"SELECT j.id, array_to_string(list_filter({SK}, lambda x: list_contains(u, x)), '|') AS matched, array_to_string(list_filter(u, lambda x: NOT list_contains({SK}, x)), '|') AS missing FROM jobs j, (SELECT {US} u)")
def skill_gap(s, dd):
    who = first_profile(s, dd).select(text.string_list(C("skills")).alias("u"))
    jobs = table(s, dd, "jobs").select("id", text.string_list(C("skills")).alias("k")).crossJoin(F.broadcast(who))  # one row
    return jobs.select("id", joined(match.matched(C("k"), C("u"))).alias("matched"), joined(match.lacking(C("k"), C("u"))).alias("missing"))


jobs_query("recency_score", lambda: {"score": F.round(dates.recency_score(C("crawled_at"), as_of()), 6)}, f"round(greatest(0, least(1, 1 - greatest(0, (epoch_us({TS}) - epoch_us(crawled_at)) / 86400000000.0) / 30)), 6)::DOUBLE AS score")
jobs_query(
    "rank_reasons",
    lambda: {"reasons": joined(match.rank_reasons(F.filter("skills", lambda x: x == "Python"), match.location_score(C("location"), F.lit("Berlin"), C("remote_status")), match.work_style_score(C("remote_status"), F.lit("remote first")), F.lit(0.5), match.salary_score(C("salary_range"), F.lit("usd")), match.seniority_part(C("experience_level"), C("title"), F.lit("")), F.lit(0.4)))},
    f"""array_to_string(list_filter([CASE WHEN list_contains(skills, 'Python') THEN 'skill match' END,
    CASE WHEN contains({d.trim('lower(location)')}, 'berlin') OR ({d.trim('lower(location)')} <> '' AND contains('berlin', {d.trim('lower(location)')})) THEN 'location match' END,
    CASE WHEN {d.trim("lower(coalesce(remote_status, 'unknown'))")} <> '' AND contains('remote first', {d.trim("lower(coalesce(remote_status, 'unknown'))")}) THEN 'work style match' END, CASE WHEN contains(lower(salary_range), 'usd') THEN 'salary match' END,
    CASE WHEN lower(coalesce(experience_level, '')) IN ('entry', 'mid') OR (lower(coalesce(experience_level, '')) NOT IN ('senior') AND ({' + '.join(f"CASE WHEN {d.m("title || ' '", p)} THEN {w} ELSE 0 END" for p, w in text.SENIORITY_WEIGHTS)}) / 15.0 >= 0.15) THEN 'entry-level friendly' END, 'good ATS match'], lambda x: x IS NOT NULL), '|') AS reasons""",
)
jobs_query("combined_score", lambda: {"score": F.round(F.length("title") * 0.6 + F.length("company") * 0.4, 2)}, "round(length(title) * 0.6::DOUBLE + length(company) * 0.4::DOUBLE, 2) AS score")
jobs_query("filter_hash", lambda: {"h": F.left(F.sha2(F.to_json(F.struct("location", "remote_status")), 256), F.lit(12))}, "left(sha256('{' || array_to_string(list_filter([CASE WHEN location IS NOT NULL THEN '\"location\":' || to_json(location) END, CASE WHEN remote_status IS NOT NULL THEN '\"remote_status\":' || to_json(remote_status) END], lambda x: x IS NOT NULL), ',') || '}'), 12) AS h")

# -- scalar functions over postings ----------------------------------------------------------------------------------
D_ = "coalesce(description, '')"
HTML = "'<p>' || replace(coalesce(description, ''), ' ', '&nbsp;') || '<br/>A &amp; B &lt;i&gt;</p><div class=\"x\">' || coalesce(company, '') || '</div>'"
strip = d.rep(d.rep(d.rep(HTML, r"<br\s*/?>", "\n", "gi"), r"</?(p|div|li|h[1-6]|tr)[^>]*>", "\n", "gi"), r"<[^>]+>", "")
for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
    strip = f"replace({strip}, {d.q(a)}, {d.q(b)})"
html_col = lambda: F.concat(F.lit("<p>"), F.replace(body(), F.lit(" "), F.lit("&nbsp;")), F.lit('<br/>A &amp; B &lt;i&gt;</p><div class="x">'), F.coalesce("company", F.lit("")), F.lit("</div>"))
jobs_query("strip_html", lambda: {"plain": text.strip_html(html_col())}, f"left({d.trim(d.rep(strip, chr(10) + '{3,}', chr(10) * 2))}, 2000) AS plain")
FMT = f"left({d.squeeze(D_)}, 4000)"
jobs_query("format_desc", lambda: {"tidy": text.format_description(body())}, f"{FMT} AS tidy")
jobs_query("infer_skills", lambda: {"found": joined(text.infer_skills(body()))}, "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {d.m(D_, r'\b' + re.escape(k).replace(chr(92) + ' ', ' ') + r'\b')} THEN {d.q(k)} END" for k in text.SKILL_KEYWORDS) + "], lambda x: x IS NOT NULL), '|') AS found")


def infer_remote_sql(x: str) -> str:
    return f"CASE WHEN {d.has(f'lower({x})', ['remote', 'work from home', 'wfh', 'anywhere'])} THEN 'true' WHEN contains(lower({x}), 'hybrid') THEN 'hybrid' WHEN {d.has(f'lower({x})', ['onsite', 'in-office'])} THEN 'false' ELSE 'unknown' END"


RS = d.trim("lower(remote_status)")
FLAG = f"CASE WHEN {RS} IN ('true', 'remote') THEN 'true' WHEN {RS} IN ('false', 'onsite') THEN 'false' WHEN {RS} = 'hybrid' THEN 'hybrid' ELSE {infer_remote_sql(D_)} END"
RE = d.trim("lower(coalesce(remote_status, 'unknown'))")
ENUM = f"CASE WHEN {RE} IN ('true', 'remote') THEN 'remote' WHEN {RE} = 'hybrid' THEN 'hybrid' WHEN {RE} IN ('false', 'onsite') THEN 'onsite' ELSE 'unknown' END"
jobs_query("infer_remote", lambda: {"flag": text.infer_remote(F.concat_ws(" ", "title", "location", body()))}, infer_remote_sql(f"concat_ws(' ', title, location, {D_})") + " AS flag")
jobs_query("norm_remote", lambda: {"flag": text.remote_flag(C("remote_status"), body()), "enum": text.remote_enum(C("remote_status"))}, f"{FLAG} AS flag, {ENUM} AS enum")
jobs_query("norm_location", lambda: {"tokens": joined(text.location_tokens(C("location")))}, f"nullif(array_to_string(list_filter(list_transform(string_split_regex(replace(location, 'İ', 'i' || chr(775)), '[,·|]'), lambda x: {d.trim('lower(x)')}), lambda x: length(x) > 0), '|'), '') AS tokens")
SITE = "'HTTPS://www.' || source_site || '//'"
NORM_SITE = lambda x: f"nullif({d.trim(d.rep(d.rep(d.rep(x, '^https?://', '', 'i'), '^www' + chr(92) + '.', '', 'i'), '/+$', ''))}, '')"
jobs_query("norm_site", lambda: {"site": text.site_name(F.concat(F.lit("HTTPS://www."), "source_site", F.lit("//")))}, f"{NORM_SITE(SITE)} AS site")
DOMAIN = lambda x: f"lower({d.rep('regexp_extract(' + x + ', ' + d.q('^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)') + ', 1, ' + d.q('i') + ')', '^www' + chr(92) + '.', '', 'i')})"
jobs_query("url_domain", lambda: {"source": text.url_domain(C("source_url")), "apply": text.url_domain(C("apply_url"))}, f"{DOMAIN('source_url')} AS source, {DOMAIN('apply_url')} AS apply")
jobs_query("clean_url", lambda: {"url": text.clean_url(F.concat(F.lit(" \t"), "source_url", F.lit("\r\n​ ")))}, d.rep(d.trim("' ' || chr(9) || source_url || chr(13) || chr(10) || chr(8203) || ' '"), r"[\r\n\t\x{200B}-\x{200D}\x{FEFF}]", "") + " AS url")
APPLY = f"coalesce(nullif({d.trim('apply_url')}, ''), source_url)"
jobs_query("apply_fallback", lambda: {"url": text.apply_fallback(C("apply_url"), C("source_url"))}, f"{APPLY} AS url")
url3 = ["source_url", "concat(source_url, '/about/us')", "concat(source_url, '?pk=1')", "concat('https://x.example/careers/', id)"]
for name, fn, sql in (
    ("junk_url", text.junk_url, lambda u: d.has(f"lower({u})", text.JUNK_URL_PARTS)), ("nonjob_url", text.non_job_url, lambda u: d.has(u, text.NON_JOB_URL_PARTS)),
    ("job_url", text.job_url, lambda u: f"(NOT {d.has(u, text.NON_JOB_URL_PARTS)} AND NOT {d.has(f'lower({u})', text.JUNK_URL_PARTS)} AND {d.anym(u, text.JOB_PATHS)})"),
):
    jobs_query(name, lambda fn=fn: {f"u{i}": fn(F.expr(u)) for i, u in enumerate(url3)}, ", ".join(f"{sql(u)} AS u{i}" for i, u in enumerate(url3)))
SQ = f"lower({d.squeeze(D_)})"
NOJOB = f"{d.hits(SQ, text.JOB_MARKERS)} = 0"
jobs_query("junk_page", lambda: {"junk": text.junk_page(C("source_url"), body())}, f"({d.has('lower(source_url)', text.JUNK_URL_PARTS)} OR length({SQ}) < 100 OR ({d.hits(SQ, text.HOMEPAGE_MARKERS)} >= 3 AND {NOJOB}) OR ({d.hits(SQ, text.NON_JOB_MARKERS)} >= 2 AND {NOJOB})) AS junk")
DOM = f"lower({d.rep(d.rep('source_site', '^(https?://)?(www' + chr(92) + '.)?', '', ''), '/+$', '')})"
NAME = d.rep(DOM, r"\.(com|app|io|co|org).*$", "", "")
FIRM = d.rep("lower(company)", "[^a-z0-9]", "")
BOARD = "(" + " OR ".join(f"contains({DOM}, {d.q(b)}) OR contains({d.q(b)}, {DOM})" for b in text.BOARD_DOMAINS) + ")"
MARKET = f"""CASE WHEN coalesce(length(company), 0) = 0 OR coalesce(length(title), 0) = 0 THEN false ELSE coalesce(length(source_site) > 0 AND (contains({FIRM}, {NAME}) OR contains({NAME}, {FIRM})), false)
 OR coalesce(length(source_site) > 0 AND {BOARD} AND {NOJOB} AND length({SQ}) < 300, false)
 OR coalesce(NOT {d.anym('apply_url', text.APPLICATION_PATHS)} AND length({DOMAIN('apply_url')}) > 0 AND {DOMAIN('apply_url')} = {DOMAIN('source_url')}, false) OR (length({SQ}) < 100 AND {NOJOB}) END"""
jobs_query("marketing_page", lambda: {"marketing": text.marketing_page(C("company"), C("source_site"), C("title"), C("apply_url"), C("source_url"), C("description"))}, f"{MARKET} AS marketing")
SPECIFIC = lambda x: f"({d.hits(f'lower({x})', text.SPECIFIC_JOB)} > {d.hits(f'lower({x})', text.SPECIFIC_BOARD)})"
jobs_query("job_specific", lambda: {"specific": text.job_specific(body())}, f"{SPECIFIC(D_)} AS specific")
POLL = lambda x: "list_filter([" + ", ".join(f"CASE WHEN {d.m(x, p)} THEN {d.q(n)} END" for n, p in text.POLLUTION.items()) + "], lambda x: x IS NOT NULL)"
jobs_query("pollution", lambda: {"signals": joined(text.pollution(body()))}, f"array_to_string({POLL(D_)}, '|') AS signals")
CHROME = lambda x: d.trim(f"array_to_string(list_filter(string_split(replace({x}, chr(13) || chr(10), chr(10)), chr(10)), lambda l: length({d.trim('l')}) = 0 OR NOT {d.anym('l', text.CHROME_PATTERNS)}), chr(10))")
jobs_query("chrome_filter", lambda: {"kept": text.chrome_filter(body())}, f"{CHROME(D_)} AS kept")
QUERIES["section_extract"] = lambda s, dd: table(s, dd, "jobs").select("id", text.section_extract(body()).alias("section"))
SQL["section_extract"] = f"""WITH a AS (SELECT id, list_filter(list_transform(string_split({D_}, chr(10)), lambda l: {d.trim('l')}), lambda l: length(l) > 0) ls FROM jobs),
b AS (SELECT id, ls, list_position(list_transform(ls, lambda l: {d.has('lower(l)', text.SECTION_START)}), true) st FROM a),
c AS (SELECT id, st, CASE WHEN st > 0 THEN ls[st:] ELSE ls END rs FROM b), e AS (SELECT id, st, rs, list_position(list_transform(rs[2:], lambda l: {d.has('lower(l)', text.SECTION_END)}), true) en FROM c),
f AS (SELECT id, st, {d.trim("array_to_string(CASE WHEN en > 0 THEN rs[1:en] ELSE rs END, chr(10))")} t FROM e) SELECT id, CASE WHEN st > 0 AND length(t) > 50 THEN t END AS section FROM f"""


def score_sql(c: str, sig: str) -> str:
    parts = " + ".join(f"CASE WHEN {d.m(f'lower({c})', p)} THEN {w} ELSE 0 END" for p, w in text.QUALITY_BONUS)
    n = f"length({c})"
    return f"greatest(0, least(100, 50 + CASE WHEN {n} > 1500 THEN 20 WHEN {n} > 800 THEN 15 WHEN {n} > 400 THEN 10 WHEN {n} > 200 THEN 5 WHEN {n} < 100 THEN -20 WHEN {n} < 150 THEN -10 ELSE 0 END + {parts} + CASE WHEN {n} < 50 THEN -30 ELSE 0 END + CASE WHEN {d.m(d.trim(c), r'^(job description|description)\s*$')} THEN -30 ELSE 0 END - least(len({sig}) * 8, 30)))::INT"


jobs_query("quality_score", lambda: {"score": text.quality_score(body(), text.pollution(body())), "grade": text.quality_grade(text.quality_score(body(), text.pollution(body())))}, f"{score_sql(D_, POLL(D_))} AS score, CASE WHEN {score_sql(D_, POLL(D_))} >= 85 THEN 'excellent' WHEN {score_sql(D_, POLL(D_))} >= 70 THEN 'good' WHEN {score_sql(D_, POLL(D_))} >= 55 THEN 'acceptable' WHEN {score_sql(D_, POLL(D_))} >= 35 THEN 'poor' ELSE 'reject' END AS grade")
CLEAN = f"""WITH a AS (SELECT *, {d.trim(D_)} raw FROM jobs), b AS (SELECT *, {d.trim(d.rep(d.rep(CHROME('raw'), chr(10) + '{4,}', chr(10) * 3), '[ ' + chr(92) + 't]+', ' '))} c FROM a),
x AS (SELECT *, {POLL('c')} sig, (NOT {SPECIFIC('c')} AND length(c) < 300) bad FROM b),
y AS (SELECT *, CASE WHEN length(raw) = 0 THEN 0 WHEN bad THEN greatest(0, 30 - len(sig) * 5) ELSE {score_sql('c', 'sig')} END::INT sc FROM x)"""
GRADE = "CASE WHEN bad OR length(raw) = 0 THEN 'reject' WHEN sc >= 85 THEN 'excellent' WHEN sc >= 70 THEN 'good' WHEN sc >= 55 THEN 'acceptable' WHEN sc >= 35 THEN 'poor' ELSE 'reject' END"


@query(f"{CLEAN} SELECT id, c AS clean, sc AS score, {GRADE} AS grade, (NOT bad AND sc >= 55 AND length(raw) > 0) AS usable FROM y")
def clean_description(s, dd):
    return table(s, dd, "jobs").select("id", text.clean_description(C("description")).alias("r")).select("id", "r.*")


GATE = f"""concat_ws('; ', CASE WHEN sc < 50 THEN 'description_quality: ' || sc || ' < 50' END, CASE WHEN length(c) < 100 THEN 'description_length: ' || length(c) || ' < 100' END,
CASE WHEN coalesce(length({d.trim('title')}), 0) < 2 THEN 'missing_title' END, CASE WHEN coalesce(length({d.trim('company')}), 0) < 2 THEN 'missing_company' END)"""


def gated(s, dd) -> DataFrame:
    r = table(s, dd, "jobs").withColumn("r", text.clean_description(C("description")))
    return r.withColumn("reason", text.quality_gate(C("r.score"), C("r.clean"), C("title"), C("company")))


@query(f"{CLEAN} SELECT id, {GATE} AS reason FROM y")
def quality_gate(s, dd):
    return gated(s, dd).select("id", "reason")


@query(f"{CLEAN}, z AS (SELECT unnest(string_split({GATE}, '; ')) reason FROM y) SELECT reason, count(*) AS n FROM z WHERE reason <> '' GROUP BY reason")
def rejection_breakdown(s, dd):
    return gated(s, dd).select(F.explode(F.split("reason", "; ")).alias("reason")).where("reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))


LEVEL = f"CASE WHEN {d.anym('title', text.SENIOR_PATTERNS)} THEN 'senior' WHEN {d.anym('title', text.ENTRY_PATTERNS)} THEN 'entry' WHEN {d.anym(f"title || ' ' || {D_}", text.SENIOR_PATTERNS)} THEN 'senior' WHEN {d.anym(f"title || ' ' || {D_}", text.ENTRY_PATTERNS)} THEN 'entry' ELSE 'unspecified' END"
jobs_query("experience_level", lambda: {"level": text.experience_level(C("title"), C("description"))}, f"{LEVEL} AS level")
jobs_query("seniority_score", lambda: {"score": text.seniority_score(C("title"), C("description"))}, "greatest(-10, least(10, " + " + ".join(f"CASE WHEN {d.m(f"title || ' ' || {D_}", p)} THEN {w} ELSE 0 END" for p, w in text.SENIORITY_WEIGHTS) + "))::INT AS score")
jobs_query("job_slug", lambda: {"slug": text.slug(C("company"), C("title"))}, d.rep("lower(concat_ws('-', company, title))", "[^a-z0-9]", "-") + " AS slug")
jobs_query("truncate_middle", lambda: {"cut": text.truncate_middle(body(), 600, 200)}, f"CASE WHEN length({D_}) <= 600 THEN {D_} ELSE left({D_}, 200) || chr(10) || '[...]' || chr(10) || right({D_}, 395) END AS cut")
esc = "title || '<&\">''' || company"
for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
    esc = f"replace({esc}, {d.q(a)}, {d.q(b)})"
jobs_query("html_escape", lambda: {"html": text.html_escape(F.concat("title", F.lit("<&\">'"), "company"))}, f"{esc} AS html")


@query(f"""WITH s AS (SELECT DISTINCT unnest(skills) skill FROM jobs), a AS (SELECT {d.rep("trim(lower(o))", '[^a-z0-9.+_/-]', '')} k, min(skill_name) nm FROM (SELECT skill_name, unnest(list_append(also_known_as, skill_name)) o FROM skill_list) GROUP BY 1)
SELECT skill, coalesce(nm, {d.trim('skill')}) AS canonical FROM s LEFT JOIN a ON k = {d.rep(d.trim('lower(skill)'), '[^a-z0-9.+_/-]', '')} WHERE skill IS NOT NULL""")
def skill_canon(s, dd):
    names = table(s, dd, "skill_list").select("skill_name", F.explode(F.array_append("also_known_as", C("skill_name"))).alias("o"))
    alias = names.groupBy(text.skill_key(C("o")).alias("k")).agg(F.min("skill_name").alias("nm"))
    typed = table(s, dd, "jobs").select(F.explode("skills").alias("skill")).where("skill is not null").distinct()
    return typed.join(alias, text.skill_key(C("skill")) == C("k"), "left").select("skill", F.coalesce("nm", js.trim(C("skill"))).alias("canonical"))


CATEGORY = lambda x: f"CASE WHEN {d.has(f'lower({x})', text.TOOL_WORDS)} THEN 'tools' WHEN {d.has(f'lower({x})', text.TECHNICAL_WORDS)} THEN 'technical' ELSE 'domain' END"


@query(f"SELECT DISTINCT skill, {CATEGORY('skill')} AS category FROM (SELECT unnest(skills) skill FROM jobs) WHERE skill IS NOT NULL")
def skill_category(s, dd):
    return table(s, dd, "jobs").select(F.explode("skills").alias("skill")).where("skill is not null").distinct().select("skill", text.skill_category(C("skill")).alias("category"))


@query("""WITH x AS (SELECT id, coalesce(skills, []) t, ['Python', 'docker', title] dm, ['Docker', 'JIRA'] tl FROM jobs), y AS (SELECT id, t, list_filter(dm, lambda v: NOT list_contains(list_transform(t, lambda u: lower(u)), lower(v))) dm, tl FROM x)
SELECT id, array_to_string(dm, '|') AS domain, array_to_string(list_filter(tl, lambda v: NOT list_contains(list_transform(list_concat(t, dm), lambda u: lower(u)), lower(v))), '|') AS tools FROM y""")
def skill_cascade(s, dd):
    low = lambda a: F.transform(a, F.lower)
    x = table(s, dd, "jobs").select("id", F.coalesce("skills", F.array().cast("array<string>")).alias("t"), F.array(F.lit("Python"), F.lit("docker"), C("title")).alias("dm"), F.array(F.lit("Docker"), F.lit("JIRA")).alias("tl"))
    y = x.withColumn("dm", F.filter("dm", lambda v: ~F.array_contains(low(C("t")), F.lower(v))))
    return y.select("id", joined(C("dm")).alias("domain"), joined(F.filter("tl", lambda v: ~F.array_contains(low(F.concat("t", "dm")), F.lower(v)))).alias("tools"))


# -- dates -----------------------------------------------------------------------------------------------------------
PD = d.trim("lower(posted_date)")
UNIT = lambda u: f"CASE WHEN {u} LIKE 'day%' THEN 1 WHEN {u} LIKE 'week%' THEN 7 WHEN {u} LIKE 'month%' THEN 30 ELSE 365 END"
MANY, ONE = r"^(\d+)\s+(day|days|week|weeks|month|months|year|years)\s+ago$", r"^a\s+(day|week|month|year)\s+ago$"
REL = f"coalesce(try_cast(nullif(regexp_extract({PD}, '{MANY}', 1), '') AS BIGINT) * {UNIT(f"regexp_extract({PD}, '{MANY}', 2)")}, CASE WHEN regexp_matches({PD}, '{ONE}') THEN {UNIT(f"regexp_extract({PD}, '{ONE}', 1)")} END)::BIGINT"
jobs_query("rel_age", lambda: {"days": dates.relative_age(C("posted_date"))}, f"{REL} AS days")
RD = r"(?:posted|reposted)?\s*(\d+)\s*(hour|hours|day|days|week|weeks|month|months|year|years)\s*ago"
BACK = f"CASE WHEN {PD} IN ('today', 'just posted', 'posted today', 'new') THEN 0 WHEN {PD} IN ('yesterday', 'posted yesterday') THEN 1 ELSE try_cast(nullif(regexp_extract({PD}, '{RD}', 1), '') AS INT) * CASE WHEN regexp_extract({PD}, '{RD}', 2) LIKE 'hour%' THEN 0 ELSE {UNIT(f"regexp_extract({PD}, '{RD}', 2)")} END END"
jobs_query("rel_date", lambda: {"day": dates.relative_date(C("posted_date"), as_of()).cast("string")}, f"CAST(DATE '{AS_OF[:10]}' - {BACK} AS VARCHAR) AS day")
QUERIES["abs_date"] = lambda s, dd: table(s, dd, "jobs").select("id", us(dates.absolute_instant(C("posted_date"))).alias("instant_us"))
QUERIES["abs_age"] = lambda s, dd: table(s, dd, "jobs").select("id", F.round(dates.absolute_age(C("posted_date"), as_of()), 6).alias("days"))
ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}:\d{2}Z)?$"
ABS = f"CASE WHEN regexp_matches(posted_date, '{ISO}') THEN (epoch_ms({TS}) - epoch_ms(try_cast(rtrim(posted_date, 'Z') AS TIMESTAMP))) / 86400000.0::DOUBLE END"
jobs_query("posted_age", lambda: {"days": F.round(dates.posted_age(C("posted_date"), as_of()), 3)}, f"round(coalesce({REL}::DOUBLE, {ABS}), 3) AS days")
jobs_query("stale_flag", lambda: {"stale": F.coalesce(dates.posted_age(C("posted_date"), as_of()) > 60, F.lit(False))}, f"coalesce(coalesce({REL}::DOUBLE, {ABS}) > 60, false) AS stale")
QUERIES["posted_date_by_source"] = lambda s, dd: table(s, dd, "jobs").select("id", F.coalesce(dates.relative_date(C("posted_date"), as_of()).cast("timestamp"), dates.absolute_instant(C("posted_date"))).cast("date").cast("string").alias("day"))
WAITS = [("Rate limit, try again in 2h3m4.5s",), ("wait 10s",), ("try again in 1h",), ("7m then",), ("later",)]
N = lambda p: f"coalesce(try_cast(nullif(regexp_extract(msg, '{p}', 1), '') AS DOUBLE), 0)"


@query(f"SELECT msg, CASE WHEN regexp_matches(msg, 'try again in (\\d+)h|(\\d+)m|([\\d.]+)s') THEN ({N('try again in (\\d+)h')} * 3600 + {N('(\\d+)m')} * 60 + ceil({N('([\\d.]+)s')}))::BIGINT END AS seconds FROM {values(WAITS, 'msg')}")
def retry_after(s, dd):
    return s.createDataFrame(WAITS, "msg string").select("msg", text.retry_after(C("msg")).alias("seconds"))


# -- salary ----------------------------------------------------------------------------------------------------------
def salary_sql() -> str:
    t = d.trim("salary_range")
    codes = ", ".join(d.q(w) for w in salary.CODES)
    code_of = lambda x: "CASE " + " ".join(f"WHEN {x} = {d.q(w)} THEN {d.q(c)}" for w, c in salary.CODES.items()) + " END"
    pre = "CASE " + " ".join(f"WHEN starts_with(lower(t), {d.q(w)}) THEN {d.q(c)}" for w, c in salary.PREFIXES) + " END"
    cut = "CASE " + " ".join(f"WHEN starts_with(lower(t), {d.q(w)}) THEN {len(w)}" for w, c in salary.PREFIXES) + " ELSE 0 END"
    last = f"lower(regexp_extract(t, {d.q(r'(?:^|[^A-Za-z0-9_])([A-Za-z]{3})\s*$')}, 1))"
    word = "CASE " + " ".join(f"WHEN contains(lower(r), {d.q(w)}) THEN {d.q(w)}" for w, _ in salary.PERIOD_ORDER) + " END"
    per = "CASE " + " ".join(f"WHEN contains(lower(r), {d.q(w)}) THEN {d.q(p)}" for w, p in salary.PERIOD_ORDER) + " ELSE 'year' END"
    strip_ = r"[$,€£¥₦₵R\s]"
    num = lambda x: f"(SELECT floor(try_cast(nullif(regexp_extract(z, '^(\\d+(?:\\.\\d+)?)(k|m|b)?$', 1, 'i'), '') AS DOUBLE) * CASE lower(regexp_extract(z, '^(\\d+(?:\\.\\d+)?)(k|m|b)?$', 2, 'i')) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 ELSE 1.0 END + 0.5) FROM (SELECT {d.trim(d.rep(x, strip_, '', 'gi'))} z))"
    rng = d.q(salary.RANGE)
    return f"""WITH a AS (SELECT id, salary_range, {t} t FROM jobs), b AS (SELECT *, {pre} pre, {cut} cut, {last} last FROM a),
    c AS (SELECT *, CASE WHEN pre IS NULL AND last IN ({codes}) THEN {code_of('last')} END tr FROM b),
    e AS (SELECT *, CASE WHEN pre IS NOT NULL THEN {d.trim('substr(t, cut + 1)')} WHEN tr IS NOT NULL THEN {d.trim(d.rep('t', r'[A-Za-z]{3}\s*$', ''))} ELSE t END r FROM c),
    f AS (SELECT *, {word} w, {per} period FROM e), g AS (SELECT *, CASE WHEN w IS NULL THEN r ELSE {d.trim("left(r, instr(lower(r), w) - 1) || substr(r, instr(lower(r), w) + length(w))")} END af FROM f),
    h AS (SELECT *, {d.trim("replace(" + d.rep(d.rep(d.rep('af', r'/\s*(hr|hrs|hour|day|wk|week|mo|month|yr|year|annual)', '', 'gi'), r'per\s+(hour|day|week|month|year|annum)', '', 'gi'), r'p\.?\s*[aA]', '') + ", ',', '')")} c FROM g),
    i AS (SELECT *, regexp_extract(c, {rng}, 1) r1, regexp_extract(c, {rng}, 2) r2, {d.trim(d.rep('c', strip_, '', 'gi'))} s FROM h),
    j AS (SELECT *, {num('r1')} lo, {num('r2')} hi, {num("regexp_extract(s, '(\\d{4,}|\\d{1,3}[kKmMbB])', 1)")} si, {num("regexp_extract(s, '(\\d+(?:\\.\\d+)?[kKmMbB]?)', 1)")} an FROM i),
    k AS (SELECT *, coalesce(hi >= lo, false) rg FROM j), l AS (SELECT *, CASE WHEN rg THEN lo ELSE coalesce(si, an) END mn, CASE WHEN rg THEN hi ELSE coalesce(si, an) END mx, coalesce(length(t), 0) = 0 bl FROM k),
    fin AS (SELECT id, salary_range, CASE WHEN NOT bl THEN mn END::BIGINT AS "min", CASE WHEN NOT bl THEN mx END::BIGINT AS "max", CASE WHEN NOT bl THEN CASE WHEN mn IS NULL THEN coalesce(pre, tr) ELSE coalesce(pre, tr, 'USD') END END AS currency,
    CASE WHEN bl THEN 'unknown' ELSE period END AS period, CASE WHEN bl OR mn IS NULL THEN 'unspecified' WHEN contains(lower(t), 'commission') THEN 'commission' WHEN contains(lower(t), 'starting') OR contains(lower(t), 'from') THEN 'starting' WHEN contains(t, '-') OR contains(t, '–') OR contains(lower(t), 'to') THEN 'range' ELSE 'unspecified' END AS type,
    CASE WHEN bl THEN 'low' WHEN rg THEN CASE WHEN hi - lo < 200000 THEN 'high' ELSE 'medium' END WHEN si IS NOT NULL THEN 'high' WHEN an IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence FROM l)"""


@query(salary_sql() + ' SELECT id, "min", "max", currency, period, type, confidence FROM fin')
def salary_parse(s, dd):
    return table(s, dd, "jobs").select("id", salary.parse(C("salary_range")).alias("p")).select("id", "p.*")


SIGN = "CASE currency WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' WHEN 'NGN' THEN '₦' WHEN 'JPY' THEN '¥' WHEN 'GHS' THEN '₵' WHEN 'ZAR' THEN 'r' WHEN 'KES' THEN 'ksh' WHEN 'AUD' THEN 'a$' WHEN 'CAD' THEN 'c$' ELSE currency END"
SHORT = lambda n: f"CASE WHEN {n} >= 1000000 THEN (floor({n} / 100000.0 + 0.5) / 10)::DECIMAL(18, 1)::VARCHAR || 'M' WHEN {n} >= 1000 THEN floor({n} / 1000.0 + 0.5)::BIGINT || 'k' ELSE {n}::VARCHAR END"
PER = "CASE WHEN period <> 'year' THEN '/' || period ELSE '' END"


@query(salary_sql() + f""" SELECT id, CASE WHEN confidence = 'low' OR "min" IS NULL THEN coalesce(salary_range, 'Not specified') WHEN type = 'range' THEN {SIGN} || {SHORT('"min"')} || '-' || {SHORT('"max"')} || {PER} WHEN "min" = "max" THEN {SIGN} || {SHORT('"min"')} || {PER} ELSE salary_range END AS shown FROM fin""")
def salary_format(s, dd):
    p = table(s, dd, "jobs").select("id", "salary_range", salary.parse(C("salary_range")).alias("p"))
    return p.select("id", salary.show(C("p.min"), C("p.max"), C("p.currency"), C("p.period"), C("p.type"), C("p.confidence"), C("salary_range")).alias("shown"))


# -- groups, keyed writes and upkeep ---------------------------------------------------------------------------------
@query("SELECT count(*) AS total, floor(100.0::DOUBLE * count(*) FILTER (coalesce(experience_level, 'unspecified') = 'unspecified') / count(*) * 10 + 0.5) / 10 AS pct_unspecified, count(DISTINCT coalesce(source_site, '')) AS source_sites, count(nullif(apply_url, '')) - count(DISTINCT nullif(apply_url, '')) AS duplicate_apply_urls FROM jobs")
def health_stats(s, dd):
    return upkeep.health(table(s, dd, "jobs"))


URL = f"nullif({d.trim('apply_url')}, '')"


@query(f"SELECT {URL} AS url, count(*) AS n, min(id) AS first_id FROM jobs WHERE {URL} IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_groups(s, dd):
    g = table(s, dd, "jobs").where(upkeep.address().isNotNull()).groupBy(upkeep.address().alias("url")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return g.where("n > 1")


@query("SELECT event_type, count(*) AS requests, round(sum(value), 3) AS tokens FROM events GROUP BY ROLLUP (event_type)")
def usage_by_caller(s, dd):
    return table(s, dd, "events").rollup("event_type").agg(F.count("*").alias("requests"), F.round(F.sum("value"), 3).alias("tokens"))


PLAIN = f"CASE WHEN regexp_matches(posted_date, '{ISO}') THEN epoch_us(try_cast(rtrim(posted_date, 'Z') AS TIMESTAMP)) // 1000 ELSE 0 END"


@query(f"WITH r AS (SELECT id, {URL} u, row_number() OVER (PARTITION BY {URL} ORDER BY {PLAIN} DESC, crawled_at DESC, id) k FROM jobs) SELECT id FROM r WHERE u IS NULL OR k = 1")
def dedup_apply_url(s, dd):
    return upkeep.newest_per_address(table(s, dd, "jobs")).select("id")


@query("SELECT id, source_url FROM jobs QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY created_at, id) = 1")
def dedup_source_url(s, dd):
    j = table(s, dd, "jobs").select("id", "source_url", "created_at")
    best = j.groupBy("source_url").agg(F.min(F.struct("created_at", "id")).alias("m"))
    return best.select(C("m.id").alias("id"), "source_url")


FEED = "SELECT id, source_url, CASE WHEN feed_type = 'json' THEN 1 WHEN feed_type = 'rss' THEN 2 ELSE 3 END b, created_at FROM jobs JOIN feed_sources USING (source_site)"


@query(f"SELECT source_url, id FROM ({FEED}) QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY b, created_at, id) = 1")
def feed_union_dedup(s, dd):
    j = table(s, dd, "jobs").join(F.broadcast(table(s, dd, "feed_sources").limit(10_000)), "source_site").select("id", "source_url", "created_at", "feed_type")
    branches = [j.where(c).withColumn("b", F.lit(i)) for i, c in enumerate(("feed_type = 'json'", "feed_type = 'rss'", "feed_type not in ('json', 'rss')"))]
    union = branches[0].unionByName(branches[1]).unionByName(branches[2])
    best = union.groupBy("source_url").agg(F.min(F.struct("b", "created_at", "id")).alias("m"))
    return best.select("source_url", C("m.id").alias("id"))


DEC = f"""WITH a AS (SELECT *, coalesce({MARKET} AND length(company) > 0, false) junk, CASE WHEN regexp_matches(posted_date, '{ISO}') THEN posted_date END pd FROM jobs),
r AS (SELECT *, CASE WHEN {URL} IS NOT NULL THEN row_number() OVER (PARTITION BY {URL} ORDER BY CASE WHEN pd IS NOT NULL THEN epoch_us(try_cast(rtrim(pd, 'Z') AS TIMESTAMP)) // 1000 ELSE 0 END DESC, crawled_at DESC, id) END k FROM a WHERE NOT junk),
z AS (SELECT *, {FMT} fd FROM r), x AS (SELECT id, CASE WHEN k > 1 THEN 'duplicate' WHEN coalesce((epoch_ms({TS}) - epoch_ms(try_cast(rtrim(pd, 'Z') AS TIMESTAMP))) / 86400000.0::DOUBLE > 60, false) THEN 'prune'
WHEN fd <> {D_} OR {FLAG.replace(D_, 'fd')} <> {ENUM} OR {APPLY} <> coalesce({d.trim('apply_url')}, '') OR NOT coalesce(len(skills) > 0, false) OR coalesce({d.trim('source_site')}, '') <> coalesce({NORM_SITE('source_site')}, '') THEN 'update' ELSE 'keep' END action FROM z UNION ALL SELECT id, 'junk' FROM a WHERE junk)"""


@query(f"{DEC} SELECT action, count(*) AS n FROM x GROUP BY action")
def cleanup_counts(s, dd):
    return upkeep.decisions(table(s, dd, "jobs"), AS_OF).groupBy("action").agg(F.count("*").alias("n"))


@query(f"{CLEAN} SELECT source_site, count(*) AS stored, count(*) FILTER (sc < 50) AS low_quality, count(*) FILTER ({REL} > 60) AS stale FROM y GROUP BY source_site")
def ingest_counts(s, dd):
    r = table(s, dd, "jobs").withColumn("sc", text.clean_description(C("description"))["score"])
    return r.groupBy("source_site").agg(F.count("*").alias("stored"), F.count_if(C("sc") < 50).alias("low_quality"), F.count_if(dates.relative_age(C("posted_date")) > 60).alias("stale"))


@query("WITH i AS (SELECT source_url, title || ' (new)' title, 1 w FROM jobs WHERE id LIKE '%0'), b AS (SELECT source_url, title, 0 w FROM jobs UNION ALL SELECT * FROM i) SELECT source_url, max_by(title, (w, title)) AS title FROM b GROUP BY source_url")
def upsert_jobs(s, dd):
    stored = table(s, dd, "jobs").select("source_url", "title")
    incoming = table(s, dd, "jobs").where("id like '%0'").select("source_url", F.concat("title", F.lit(" (new)")).alias("title"))
    return upkeep.upsert(stored, incoming, ["source_url"])


@query("SELECT user_id, job_id, lower(trim(status)) AS status, epoch_us(updated_at) AS updated_us FROM applications QUALIFY row_number() OVER (PARTITION BY user_id, job_id ORDER BY updated_at DESC, id DESC) = 1")
def upsert_applications(s, dd):
    best = search.latest(table(s, dd, "applications"), [C("user_id"), C("job_id")], [C("updated_at"), C("id")])
    return best.select("user_id", "job_id", F.lower(F.trim("status")).alias("status"), us("updated_at").alias("updated_us"))


@query("SELECT id, CASE WHEN id LIKE '%0' THEN 'remote' ELSE remote_status END AS remote_status, CASE WHEN id LIKE '%0' AND location IS NULL THEN location ELSE location END AS location FROM jobs")
def patch_update(s, dd):
    j = table(s, dd, "jobs").select("id", "remote_status", "location")
    return upkeep.patch(j, j.where("id like '%0'").select("id", F.lit("remote").alias("remote_status")))


@query("SELECT id, coalesce(CASE WHEN id LIKE '%5' THEN 'hybrid' END, work_style) AS work_style, headline FROM profiles")
def merge_profile(s, dd):
    p = table(s, dd, "profiles").select("id", "work_style", "headline")
    return upkeep.patch(p, p.select("id", F.when(C("id").like("%5"), "hybrid").alias("work_style"), F.lit(None).cast("string").alias("headline")))


@query("SELECT j.n AS jobs_left, v.n AS vectors_left FROM (SELECT count(*) n FROM jobs WHERE source_site <> 'westboard.example') j, (SELECT count(*) n FROM job_vectors WHERE job_id NOT IN (SELECT id FROM jobs WHERE source_site = 'westboard.example')) v")
def delete_cascade(s, dd):
    j = table(s, dd, "jobs")
    left, vectors = upkeep.delete_cascade(j, table(s, dd, "job_vectors"), j.where("source_site = 'westboard.example'").select("id"))
    return left.agg(F.count("*").alias("jobs_left")).crossJoin(vectors.agg(F.count("*").alias("vectors_left")))  # one row each


@query("SELECT a.id, a.user_id, lower(trim(a.status)) AS status, j.title, j.company FROM applications a LEFT JOIN jobs j ON a.job_id = j.id")
def applications_list(s, dd):
    a, j = table(s, dd, "applications"), table(s, dd, "jobs")
    out = a.join(j, a.job_id == j.id, "left").select(a.id, a.user_id, F.lower(F.trim(a.status)).alias("status"), F.struct(j.title, j.company).alias("job"))
    return out.select("id", "user_id", "status", "job.title", "job.company")


@query("SELECT j.id, min(f.source_site) AS feed FROM jobs j LEFT JOIN feed_sources f ON contains(j.source_url, f.source_site) GROUP BY j.id")
def feed_route(s, dd):
    sites = table(s, dd, "feed_sources").select(C("source_site").alias("site")).limit(10_000)  # a fixed table, broadcast for the substring join
    j = table(s, dd, "jobs").select("id", "source_url")
    return j.join(F.broadcast(sites), F.contains("source_url", C("site")), "left").groupBy("id").agg(F.min("site").alias("feed"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 12")
def chat_tail(s, dd):
    return search.numbered(table(s, dd, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], "k").where("k <= 12").select("user_id", "event_id")


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) BETWEEN 3 AND 7")
def zrange(s, dd):
    return search.numbered(table(s, dd, "events"), ["event_type"], [C("value"), C("event_id")], "k").where("k between 3 and 7").select("event_type", "event_id")


@query("SELECT user_id AS key, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND epoch_us(ts) + 86400000000 > epoch_us(TIMESTAMP '2024-01-30 00:00:00')")
def ttl_visible(s, dd):
    e = search.latest(table(s, dd, "events"), [C("user_id")], [C("ts"), C("event_id")]).select(C("user_id").alias("key"), "value", C("ts").alias("written_at"))
    return upkeep.visible(e, "2024-01-30 00:00:00", ttl_seconds=86400).select("key", F.round("value", 6).alias("value"))


@query("""WITH a AS (SELECT user_id, epoch_us(ts) t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events), b AS (SELECT user_id, t, sum(CASE WHEN p IS NULL OR t - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, p NULLS FIRST ROWS UNBOUNDED PRECEDING) g FROM a)
SELECT user_id, min(t) AS start_us, max(t) + 21600000000 AS end_us, count(*) AS n FROM b GROUP BY user_id, g""")
def session_ttl(s, dd):
    return stateful.sessions(table(s, dd, "events"), "user_id", gap="6 hours").select("user_id", us("start").alias("start_us"), us("end").alias("end_us"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def kv_counters(s, dd):
    return table(s, dd, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), '|') AS members FROM events GROUP BY user_id")
def kv_sets(s, dd):
    return table(s, dd, "events").groupBy("user_id").agg(joined(F.array_sort(F.collect_set("event_type"))).alias("members"))


@query("SELECT id, left(md5(id || '|' || coalesce(epoch_us(resume_version)::VARCHAR, '0') || '|7'), 12) AS cache_key FROM profiles")
def cache_key(s, dd):
    return table(s, dd, "profiles").select("id", F.left(F.md5(F.concat_ws("|", "id", F.coalesce(us("resume_version").cast("string"), F.lit("0")), F.lit("7"))), F.lit(12)).alias("cache_key"))


@query("SELECT min(event_id) AS event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events) WHERE k = 1 GROUP BY user_id")
def stream_dedup(s, dd):
    e = table(s, dd, "events")
    return search.latest(e, [C("user_id")], [-us("ts"), -C("event_id")]).select("event_id", "user_id")


# -- feeds and pages -------------------------------------------------------------------------------------------------
TITLE, COMPANY = d.trim("title"), d.trim("company")
KEPT = f"length({TITLE}) > 0 AND length({COMPANY}) > 0 AND length({d.trim(D_)}) > 0"
STRIPPED = strip.replace(HTML, "description")
PLAINED = f"left({d.trim(d.rep(STRIPPED, chr(10) + '{3,}', chr(10) * 2))}, 2000)"


@query(f"SELECT {TITLE} AS title, {COMPANY} AS company, md5({PLAINED}) AS body, '$' || length(title) || 'k-$' || (length(title) + 5) || 'k' AS salary_range, 'https://feed.example/jobs/' || id AS source_url FROM jobs WHERE {KEPT}")
def feed_json_flat(s, dd):
    n = F.length("title")
    x = F.struct("id", C("title").alias("position"), "company", "description", C("source_url").alias("url"), C("skills").alias("tags"), (n * 1000.0).alias("salary_min"), (n * 1000.0 + 5000).alias("salary_max"))
    return feeds.read_flat(table(s, dd, "jobs").select(F.to_json(F.array(x)).alias("payload"))).select("title", "company", F.md5("description").alias("body"), "salary_range", "source_url")


@query(f"SELECT {TITLE} AS title, {COMPANY} AS company, CASE WHEN lower({d.trim('location')}) <> 'anywhere' THEN nullif({d.trim('location')}, '') END AS location, md5({PLAINED}) AS body, source_url FROM jobs WHERE {KEPT}")
def feed_json_nested(s, dd):
    x = F.struct("id", "title", C("company").alias("company_name"), "description", C("source_url").alias("url"), C("location").alias("candidate_required_location"))
    return feeds.read_nested(table(s, dd, "jobs").select(F.to_json(F.struct(F.array(x).alias("jobs"))).alias("payload"))).select("title", "company", "location", F.md5("description").alias("body"), "source_url")


LINE = "CASE WHEN id LIKE '%0' THEN title ELSE company || ': ' || title END"


@query(f"SELECT id, CASE WHEN contains(l, ':') THEN {d.trim("left(l, instr(l, ':') - 1)")} ELSE 'Unknown' END AS company, CASE WHEN contains(l, ':') THEN {d.trim("substr(l, instr(l, ':') + 1)")} ELSE {d.trim('l')} END AS title FROM (SELECT id, {LINE} l FROM jobs)")
def feed_title_split(s, dd):
    return table(s, dd, "jobs").select("id", feeds.split_title(F.expr(LINE)).alias("t")).select("id", "t.*")


def job_pages(s, dd) -> DataFrame:
    """A page a posting: furniture, the description in an article, and links."""
    html = F.concat(F.lit("<html><body><nav>Menu</nav><article><h1>"), "title", F.lit("</h1><p>"), text.html_escape(body()), F.lit("</p><a href='/jobs/a#x'>a</a><a href='mailto:x@y.example'>m</a><a href='/about'>b</a><a href='https://other.example/job/1'>o</a></article><script>x()</script><footer>end</footer></body></html>"))
    return table(s, dd, "jobs").select(C("source_url").alias("url"), html.alias("html"))


@query()
def html_to_text(s, dd):
    return pages.read_pages(job_pages(s, dd)).select("url", "text")


@query()
def html_to_text_body(s, dd):
    return pages.read_pages(job_pages(s, dd), tight=False).select("url", "text")


HOST = "regexp_extract(source_url, '^(https?://[^/]+)', 1)"


@query(f"SELECT DISTINCT u AS link FROM (SELECT unnest([{HOST} || '/jobs/a#x', 'mailto:x@y.example', {HOST} || '/about', 'https://other.example/job/1']) u FROM jobs) WHERE NOT {d.has('u', text.NON_JOB_URL_PARTS)}")
def page_links(s, dd):
    return pages.read_pages(job_pages(s, dd), tight=False).select(F.explode("links").alias("link")).distinct()


@query(f"SELECT DISTINCT {HOST} || '/jobs/a' AS link FROM jobs")
def page_links_strict(s, dd):
    return pages.read_pages(job_pages(s, dd)).select(F.explode("links").alias("link")).distinct()


@query(f"""{CLEAN} SELECT id, {TITLE} AS title, {COMPANY} AS company, md5(c) AS clean, {GRADE} AS grade, coalesce({d.trim('lower(remote_status)')}, 'unknown') AS remote_status, coalesce(experience_level, 'unspecified') AS experience_level FROM y WHERE {GATE} = ''""")
def enriched_record(s, dd):
    ok = gated(s, dd).where("reason = ''")
    return ok.select("id", js.trim(C("title")).alias("title"), js.trim(C("company")).alias("company"), F.md5("r.clean").alias("clean"), C("r.grade").alias("grade"), F.coalesce(js.trim(F.lower("remote_status")), F.lit("unknown")).alias("remote_status"), F.coalesce("experience_level", F.lit("unspecified")).alias("experience_level"))


# -- resumes ---------------------------------------------------------------------------------------------------------
MD = [
    ("full", "# Ada Example\nada@mail.example | +1 555 010 0200 | linkedin.com/in/ada-ex\nLocation: Berlin, Germany\n\n# Summary\nBuilt data platforms for 12 years. Reduced cost by 35% for 40 customers across three teams, and mentored eight engineers on reliable pipelines and testing.\n\n# Skills\n## Languages\n- Python\n- SQL\n- Scala\n- Go\n- Rust\n\n# Experience\n## Acme — Lead\nJan 2019 – Mar 2023\n- Delivered a platform used by 300 users\n- Led 5 people\n- Cut build time by 40%, resulting in faster releases\n\n# Education\nBachelor of Science, Example University, 2011\n\n# Projects\n## Tool\nBuilt with Python\n\n# Certifications\n- Cloud\n"),
    ("bare", "Bob\nno headings here"), ("table", "| a | b |\n|---|---|\n| 1 | 2 |\n# Work Experience\nSome text   with   gaps\nmore   wide   gaps\n****"), ("empty", ""),
]
ALL = "(SELECT id, coalesce(resume_text, '') t FROM profiles UNION ALL SELECT * FROM " + "(VALUES " + ", ".join(f"({d.q(a)}, {d.q(b)})" for a, b in MD) + ") AS v(id, t))"


def resumes(s, dd) -> DataFrame:
    return table(s, dd, "profiles").select("id", F.coalesce("resume_text", F.lit("")).alias("t")).unionByName(s.createDataFrame(MD, "id string, t string"))


def yes(cond: str, n: int) -> str:
    return f"CASE WHEN {cond} THEN {n} ELSE 0 END"


FIRST_LINE = f"list_filter(string_split(t, chr(10)), lambda l: length({d.trim('l')}) > 0)[1]"
SQL["ats_contact"] = f"""SELECT id, ({yes(f"regexp_matches({FIRST_LINE}, '[a-zA-Z]') AND NOT regexp_matches({d.trim(FIRST_LINE)}, '^[-–—•]')", 3)} + {yes("regexp_matches(t, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+[.][A-Za-z0-9_]+')", 2)} + {yes("regexp_matches(t, '[+]?[0-9\\s()-]{10,}')", 2)}
 + {yes(d.m('t', 'linkedin[.]com/in/[A-Za-z0-9_-]+'), 2)} + {yes(d.m('t', '(?:location|city|state|country):\\s*[A-Za-z0-9_\\s,]+'), 1)})::INT AS score FROM {ALL}"""
QUERIES["ats_contact"] = lambda s, dd: resumes(s, dd).select("id", resume.contact(C("t")).cast("int").alias("score"))
EVERY = "|".join(p for ps in resume.HEADINGS.values() for p in ps)
SQL["ats_format"] = f"""SELECT id, ({yes("NOT regexp_matches(t, '\\|.*\\|.*\\|')", 3)} + {yes("len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '\\S\\s{3,}\\S'))) < 2", 2)} + {yes(f"len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '^#\\s+.+') AND {d.m('l', f'^(?:{EVERY})')})) >= 3", 3)} + {yes("NOT contains(t, '****') AND NOT contains(t, '```')", 2)})::INT AS score FROM {ALL}"""
QUERIES["ats_format"] = lambda s, dd: resumes(s, dd).select("id", resume.formatting(C("t")).cast("int").alias("score"))
SQL["ats_length"] = f"SELECT id, CASE WHEN length(t) BETWEEN 1000 AND 3500 THEN 10 WHEN length(t) BETWEEN 500 AND 5000 THEN 7 WHEN length(t) < 500 THEN 4 ELSE 3 END::INT AS score FROM {ALL}"
QUERIES["ats_length"] = lambda s, dd: resumes(s, dd).select("id", resume.length(C("t")).cast("int").alias("score"))
for _n in ("summary", "skills", "experience", "education", "projects", "certifications"):
    QUERIES[f"ats_{_n}"] = lambda s, dd, f=resume.SECTIONS[_n]: resumes(s, dd).select("id", f(C("t")).cast("int").alias("score"))
QUERIES["ats_score"] = lambda s, dd: resumes(s, dd).select("id", resume.score(C("t")).alias("r")).select("id", "r.*")
JD = "We are looking for a data engineer with python, kafka and communication skills; data pipelines and testing are required"
JW = "list_filter(string_split_regex(lower(" + d.q(JD) + "), '[^a-z0-9_]+'), lambda w: length(w) > 3)"
SQL["keyword_rate"] = f"SELECT id, round(len(list_distinct(list_filter({JW}, lambda w: contains(lower(t), w)))) / len({JW})::DOUBLE, 6) AS rate FROM {ALL}"
QUERIES["keyword_rate"] = lambda s, dd: resumes(s, dd).select("id", F.round(resume.keyword_rate(C("t"), F.lit(JD)), 6).alias("rate"))
CL = "list_concat(" * (len(resume.CLAIMS) - 1) + f"regexp_extract_all(t, {d.q(resume.CLAIMS[0])}, 0, 'i')" + "".join(f", regexp_extract_all(t, {d.q(p)}, 0, 'i'))" for p in resume.CLAIMS[1:])
SQL["claims"] = f"""WITH a AS (SELECT id, list_filter(list_transform({CL}, lambda x: {d.trim('x')}), lambda x: length(x) > 1) l FROM {ALL}),
b AS (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) l FROM a) SELECT id, array_to_string(l[1:5], '|') AS claims FROM b"""
QUERIES["claims"] = lambda s, dd: resumes(s, dd).select("id", joined(resume.claims(C("t"))).alias("claims"))
PAIRS = [("grew to 2m users", "2 million users"), ("cut cost by 30 %", "30% reduction"), ("nothing", "5 billion"), ("$ 1,200 saved", "$1200"), ("Won Award", "award")]
QUERIES["claim_contains"] = lambda s, dd: s.createDataFrame(PAIRS, "value string, claim string").select("value", "claim", resume.contains_claim(C("value"), C("claim")).alias("found"))
SQL["claim_contains"] = "SELECT * FROM (VALUES ('grew to 2m users', '2 million users', true), ('cut cost by 30 %', '30% reduction', true), ('nothing', '5 billion', false), ('$ 1,200 saved', '$1200', false), ('Won Award', 'award', true)) AS v(value, claim, found)"
QUERIES["extract_fields"] = lambda s, dd: resumes(s, dd).select("id", resume.extract_fields(C("t")).alias("f")).select("id", "f.*")
SQL["missing_fields"] = f"SELECT id, array_to_string(list_filter([{', '.join(f'CASE WHEN coalesce(length({d.trim(c)}), 0) = 0 THEN {d.q(c)} END' for c in ('display_name', 'email', 'location', 'headline'))}, CASE WHEN coalesce(len(skills), 0) = 0 THEN 'skills' END], lambda x: x IS NOT NULL), '|') AS missing FROM profiles"
QUERIES["missing_fields"] = lambda s, dd: table(s, dd, "profiles").select("id", joined(resume.missing_fields({c: C(c) for c in ("display_name", "email", "location", "headline", "skills")})).alias("missing"))


@query(f"SELECT id, (coalesce(length({d.trim('email')}), 0) > 0 AND coalesce(length({d.trim('display_name')}), 0) > 0 AND coalesce(len(skills), 0) > 0 AND coalesce(length(resume_text), 0) >= 50) AS ready FROM profiles")
def readiness(s, dd):
    full = lambda c: F.coalesce(F.length(js.trim(C(c))), F.lit(0)) > 0
    return table(s, dd, "profiles").select("id", (full("email") & full("display_name") & (F.coalesce(F.size("skills"), F.lit(0)) > 0) & (F.coalesce(F.length("resume_text"), F.lit(0)) >= 50)).alias("ready"))


@query("SELECT id, concat_ws(chr(10), '# ' || display_name, concat_ws(' | ', email, location), '## Summary', headline, '## Skills', '- ' || array_to_string(skills, ', ')) AS md FROM profiles")
def resume_text(s, dd):
    return table(s, dd, "profiles").select("id", F.concat_ws("\n", F.concat(F.lit("# "), "display_name"), F.concat_ws(" | ", "email", "location"), F.lit("## Summary"), "headline", F.lit("## Skills"), F.concat(F.lit("- "), F.array_join("skills", ", "))).alias("md"))


@query()
def reformat(s, dd):
    @F.pandas_udf("string")
    def page(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else resume.reformat(t))

    return resumes(s, dd).select("id", page("t").alias("md"))


REPLIES = [('```json\n{"message": "Hi", "next": "email"}\n```',), ('{"message": ""}',), ("not json",), ('{"message": "Ok"}',)]


@query("SELECT * FROM (VALUES ('Hi', 'email'), (NULL, NULL), (NULL, NULL), ('Ok', NULL)) AS v(message, next)")
def parse_reply(s, dd):
    x = s.createDataFrame(REPLIES, "raw string").select(F.from_json(F.regexp_replace("raw", r"```(?:json)?\s*", ""), "message string, next string").alias("r"))
    ok = F.length("r.message") > 0
    return x.select(F.when(ok, C("r.message")).alias("message"), F.when(ok, C("r.next")).alias("next"))


@query()
def rescore_trigger(s, dd):
    """Turns of a user's events, with the size reached so far; whether each is scored again."""
    total = F.sum(F.ceil(F.abs("value")) + 1).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    turns = table(s, dd, "events").select("user_id", "event_id", total.cast("long").alias("size"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("event_id")
        return pdf.assign(rescore=stateful.rescore_points(pdf["size"].tolist()))[["user_id", "event_id", "rescore"]]

    return turns.groupBy("user_id").applyInPandas(fold, "user_id long, event_id long, rescore boolean")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

