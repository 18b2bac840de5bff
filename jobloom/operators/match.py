"""Exact vector search for one query vector and the explainable rerank of its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import js, text
from jobloom.functions.dates import recency_score

# Weights of the score, and words that are no terms.
WEIGHTS = {"similarity": 0.5, "ats": 0.3, "skill": 0.2, "location": 0.06, "work_style": 0.05, "recency": 0.04, "salary": 0.02, "seniority": 0.14}
STOP_WORDS = sorted(set("""the and for are but not you all can had her was one our out has have been with that this from they will your which their than what when were
also its just about would could should after into over such only other then these those very because more some well how who where each them many most another both through
during before between under above below much may still while however whether although therefore thus nearly enough ever every own rather quite around long here there being
having doing does did done getting going gone make take year years new first last back even way like including using based various within without across along among upon
down off per via until since up on in at to a an is be by or as of it no so if do go get know see use let said part set end put run say help show""".split()))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null for zero vectors or different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def similar(vectors: DataFrame, query: list[float], key: str = "job_id", vec: str = "embedding") -> DataFrame:
    """(key, similarity) to one query vector, which is part of the plan; rows stay in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, cosine(F.col(vec), q).alias("similarity")).where(F.col("similarity").isNotNull())


def match_jobs(vectors: DataFrame, jobs: DataFrame, query: list[float], threshold: float = 0.5, limit: int = 200) -> DataFrame:
    """Postings strictly above a similarity, best first, at most min(limit, 200). The top-k is taken before the join."""
    best = similar(vectors, query).where(F.col("similarity") > threshold).groupBy("job_id").agg(F.max("similarity").alias("similarity"))
    top = best.join(jobs.select("id"), best.job_id == F.col("id"), "left_semi").orderBy(F.desc("similarity"), "job_id").limit(min(limit, 200))
    return jobs.join(F.broadcast(top), jobs.id == top.job_id).drop("job_id")  # at most 200 rows are broadcast


def top_terms(resumes: DataFrame, key: str = "id", column: str = "resume_text", top: int = 50, least: int = 4) -> DataFrame:
    """(key, term, n): the most frequent words of each resume, ties by first occurrence."""
    from pyspark.sql import Window

    words = resumes.select(key, F.posexplode(F.split(F.lower(column), "[^a-z0-9_]+")).alias("pos", "term"))
    words = words.where((F.length("term") >= least) & ~F.col("term").isin(*STOP_WORDS))
    counted = words.groupBy(key, "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "term", "n")


def occurrences(haystack: Column, needle: Column) -> Column:
    """How often a string occurs in another without overlaps."""
    return F.when(F.length(needle) > 0, ((F.length(haystack) - F.length(F.replace(haystack, needle, F.lit("")))) / F.length(needle)).cast("int")).otherwise(0)


def ats_relevance(title: Column, description: Column, job_skills: Column, terms: Column, user_skills: Column) -> Column:
    """Log-weighted hits of terms (array<struct<term, n>>) in a posting, over the most they could reach; two decimals."""
    t, d = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))

    def points(x: Column) -> Column:
        term = x["term"]
        hit = F.contains(t, term).cast("int") * 3 + F.least(occurrences(d, term), F.lit(3)) + (F.array_contains(user_skills, term) & F.array_contains(job_skills, term)).cast("int")
        return hit * F.ln(x["n"] + F.lit(1.0))

    used = F.filter(terms, lambda x: F.length(x["term"]) >= 2)
    got = F.aggregate(F.transform(used, points), F.lit(0.0), lambda s, v: s + v)
    most = F.aggregate(F.transform(used, lambda x: 7.0 * F.ln(x["n"] + F.lit(1.0))), F.lit(0.0), lambda s, v: s + v)
    return F.when(most > 0, js.rounded(F.least(got / most, F.lit(1.0)), 2)).otherwise(0.5)


def location_score(job: Column, target: Column, remote: Column) -> Column:
    j, t, r = (js.blank_to_null(js.trim(F.lower(c))) for c in (job, target, remote))
    far = F.coalesce(r == "remote", F.lit(False))
    return F.when(j.isNull() | t.isNull(), F.when(far, 0.5).otherwise(0.3)).when(j == t, 1.0).when(F.contains(j, t) | F.contains(t, j), 0.7).otherwise(F.when(far, 0.5).otherwise(0.0))


def work_style_score(remote: Column, style: Column) -> Column:
    r, s = js.blank_to_null(js.trim(F.lower(F.coalesce(remote, F.lit("unknown"))))), js.blank_to_null(js.trim(F.lower(style)))
    return F.when(s.isNull(), F.when(r == "unknown", 0.6).otherwise(0.7)).when(F.contains(s, r), 1.0).when(r == "unknown", 0.6).otherwise(0.0)


def salary_score(stated: Column, target: Column) -> Column:
    return F.when((F.length(stated) > 0) & (F.length(target) > 0) & F.contains(F.lower(stated), F.lower(target)), 1.0).otherwise(0.5)


def seniority_part(level: Column, title: Column, description: Column) -> Column:
    lv = F.lower(F.coalesce(level, F.lit("")))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), text.seniority_score(title, description) / F.lit(15.0)))
    return F.when(lv == "entry", 0.3).when(lv == "mid", 0.15).when(lv == "senior", -0.3).otherwise(clamped)


def matched(job_skills: Column, user_skills: Column) -> Column:
    return F.filter(job_skills, lambda s: F.array_contains(user_skills, s))


def lacking(job_skills: Column, user_skills: Column) -> Column:
    return F.filter(user_skills, lambda s: ~F.array_contains(job_skills, s))


def rank_reasons(matched_skills: Column, location: Column, style: Column, recency: Column, salary: Column, seniority: Column, ats: Column) -> Column:
    labels = [
        F.when(F.size(matched_skills) > 0, "skill match"), F.when(location >= 0.7, "location match"), F.when(style >= 0.8, "work style match"), F.when(recency >= 0.7, "recent posting"),
        F.when(salary >= 1, "salary match"), F.when(seniority >= 0.15, "entry-level friendly"), F.when(ats >= 0.6, "strong ATS match").when(ats >= 0.4, "good ATS match"),
    ]
    return F.array_compact(F.array(*labels))


def rerank(candidates: DataFrame, profile: DataFrame, terms: DataFrame, as_of: str) -> DataFrame:
    """Candidates (jobs with similarity) scored for one profile row, best first; ties keep the order of similarity.

    profile: one row; terms: its (term, n), at most 50 rows. Both are broadcast: their sizes are fixed.
    """
    skills = text.string_list(F.col("p_skills"))
    known = F.transform(skills, lambda s: F.struct(s.alias("term"), F.coalesce(F.try_element_at(F.map_from_entries("t_terms"), s), F.lit(1).cast("bigint")).alias("n")))
    packed = terms.limit(50).agg(F.coalesce(F.collect_list(F.struct("term", F.col("n").cast("bigint").alias("n"))), F.array()).alias("t_terms"))
    who = profile.limit(1).select(*(F.col(c).alias(f"p_{c}") for c in ("skills", "location", "work_style", "salary_target", "resume_text"))).crossJoin(packed)
    both = candidates.crossJoin(F.broadcast(who)).withColumn("_user", F.array_distinct(skills)).withColumn("_job", text.string_list(F.col("skills")))
    all_terms = F.concat(F.filter(known, lambda x: F.lit(True)), F.filter(F.col("t_terms"), lambda x: ~F.array_contains(F.col("_user"), x["term"])))
    at = F.lit(as_of).cast("timestamp")
    short = (F.length(F.coalesce("p_resume_text", F.lit(""))) < 50) & (F.size("_user") == 0)
    both = both.withColumns({
        "ats": F.when(short, 0.5).otherwise(ats_relevance(F.col("title"), F.col("description"), F.col("_job"), all_terms, F.col("_user"))),
        "matched_skills": matched(F.col("_job"), skills), "missing_skills": lacking(F.col("_job"), skills),
        "location_s": location_score(F.col("location"), F.col("p_location"), F.col("remote_status")), "work_style_s": work_style_score(F.col("remote_status"), F.col("p_work_style")),
        "recency_s": recency_score(F.col("crawled_at"), at), "salary_s": salary_score(F.col("salary_range"), F.col("p_salary_target")),
        "seniority_s": seniority_part(F.col("experience_level"), F.col("title"), F.col("description")),
        "similarity": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))),
    })
    w = WEIGHTS
    skill = F.when(F.size(skills) > 0, F.size("matched_skills") / F.size(skills)).otherwise(0.0)
    raw = (
        F.col("similarity") * w["similarity"] + F.col("ats") * w["ats"] + skill * w["skill"] + F.col("location_s") * w["location"] + F.col("work_style_s") * w["work_style"]
        + F.col("recency_s") * w["recency"] + F.col("salary_s") * w["salary"] + F.col("seniority_s") * w["seniority"] - F.least(F.lit(0.4), F.size("missing_skills") * 0.05)
    )
    scored = both.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    scored = scored.withColumn("reasons", rank_reasons(F.col("matched_skills"), F.col("location_s"), F.col("work_style_s"), F.col("recency_s"), F.col("salary_s"), F.col("seniority_s"), F.col("ats")))
    return scored.orderBy(F.desc("score"), F.desc("similarity"), "id").select("id", "score", "similarity", "ats", "matched_skills", "missing_skills", "reasons")
