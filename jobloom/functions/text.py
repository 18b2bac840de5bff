"""Cleaning, classification and normalisation of postings' texts and addresses, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import js

# Word lists and patterns whose meaning results depend on.
SKILL_KEYWORDS = "javascript typescript python java go golang rust c++ c# react angular vue node nodejs next.js express aws gcp azure docker kubernetes k8s terraform sql postgresql mysql mongodb redis graphql git ci/cd linux api rest html css".split() + ["machine learning", "ai", "data science"] + "devops sre agile scrum jira figma tailwind".split()
JUNK_URL_PARTS = ["/blog", "/about", "/contact", "/faq", "/categories", "/companies", "/pricing"]
HOMEPAGE_MARKERS = ["welcome to", "sign up", "log in", "browse jobs", "featured companies", "latest articles", "newsletter"]
NON_JOB_MARKERS = ["privacy policy", "terms of service", "about us", "contact us", "all categories", "company directory", "pricing plans", "read more", "blog post"]
JOB_MARKERS = ["apply", "responsibilities", "requirements", "qualifications", "salary", "job description", "benefits"]
NON_JOB_URL_PARTS = ["/listing_ads/", "/click", "/goto/", "/track", "?pk=", "&pk=", "/outbound", "sponsor", "/banner", "/company/", "/categories/", ".rss", "/remote-jobs/search", "/reviews-success-stories", "/terms-of-use", "/web/login", "support.", "/startups", "/role/l/", "twitter.com/", "t.me/"]
JOB_PATHS = [r"/job(s)?/", r"/job[s]?[-_/][\w-]+", r"/careers?/", r"/vacanc(y|ies)/", r"/opening(s)?/", r"/position(s)?/", r"/listing(s)?/", r"/requisition/", r"/opportunit(y|ies)/", r"/graduate[-_/]", r"/internship(s)?[-_/]", r"/\?j=p/"]
APPLICATION_PATHS = [r"/job(s)?/", r"/careers?/", r"/position(s)?/", r"/apply/", r"/opportunit(y|ies)/", r"/listing(s)?/", r"/opening(s)?/", r"/posting(s)?/"]
BOARD_DOMAINS = ["wellfound.com", "himalayas.app", "remote.co", "workingnomads.com", "justremote.co", "jobspresso.co", "hiringcafe.com", "dynamitejobs.com", "arc.dev", "cord.co", "landing.jobs"]
CHROME_PATTERNS = [r"skip to main content", r"skip to content", r"toggle navigation", r"menu", r"search\s*(jobs|positions|openings)?", r"sign\s*(up|in|out)", r"log\s*(in|out)", r"create\s*(an\s*)?account", r"newsletter", r"subscribe", r"follow us", r"cookie\s*(policy|notice|consent|settings)", r"privacy\s*(policy|notice)", r"terms\s*(of\s*)?(service|use|conditions)", r"all\s+(rights\s+)?reserved", r"powered\s+by", r"browse\s+(all\s+)?(jobs|positions|openings)", r"featured\s+companies", r"latest\s+articles", r"read more", r"blog\s*post"]
POLLUTION = {
    "job_count_listing": r"jobs?\s[\d,.,]+\s*(results|found|matches)?", "navigation_skip": r"skip to (main )?content",
    "signup_cta": r"sign\s*up\s+(for\s+)?(free\s+)?(updates|newsletter|our\s+newsletter)", "account_cta": r"create\s+(an\s+)?account",
    "subscribe_cta": r"subscribe\s+(to\s+)?(our\s+)?(newsletter|updates)", "cookie_notice": r"cookie\s+(policy|notice|consent|settings)", "privacy_policy": r"privacy\s+policy",
    "terms_of_service": r"terms\s+of\s+(service|use|conditions)", "copyright_footer": r"all\s+(rights\s+)?reserved", "powered_by": r"powered\s+by",
    "company_directory": r"company\s+(directory|listings?)", "blog_listing": r"latest\s+(articles|blog|posts|news)", "read_more": r"read more",
    "browse_jobs": r"browse\s+(all\s+)?(jobs|positions|openings)", "featured_content": r"featured\s+(companies|jobs)", "view_all_jobs": r"view\s+(all\s+)?(jobs|positions|openings)",
}
SPECIFIC_JOB = ["job description", "responsibilities", "requirements", "qualifications", "about the role", "what you'll do", "apply for this job", "apply now", "we are looking for"]
SPECIFIC_BOARD = ["browse jobs", "job search", "search jobs", "jobs board", "job board", "find a job", "jobs near"]
SECTION_START = ["job description", "about the job", "about this role", "the role", "what you'll do", "what you will do", "responsibilities", "role description", "the opportunity"]
SECTION_END = ["apply now", "how to apply", "about the company", "about us", "company overview", "similar jobs", "related jobs", "other jobs", "jobs you might like", "recommended jobs", "more jobs", "company profile"]
QUALITY_BONUS = [(r"\b(responsibilities|duties|what you('ll| will) do)\b", 10), (r"\b(requirements|qualifications|what you need|you have)\b", 10), (r"\b(skills|experience|expertise)\b", 5), (r"\b(benefits|perks|we offer|what we offer)\b", 5), (r"\b(apply|how to apply|to apply)\b", 3), (r"\b\d+\+?\s*years? (of )?experience\b", 8), (r"\b(degree|bachelor|master|phd|bs|ba|ms)\b", 5)]
SENIOR_PATTERNS = [r"\bsenior\b", r"\bsr\.?\b", r"\bstaff\b", r"\bprincipal\b", r"\blead\b", r"\bhead of\b", r"\bdirector\b", r"\bvp\b", r"\bmanager\b", r"\b\d{1,2}\+?\s*years?\b"]
ENTRY_PATTERNS = [r"\bjunior\b", r"\bjr\.?\b", r"\bentry.level\b", r"\bentry\b", r"\bgraduate\b", r"\bgrad\b", r"\bintern(ship)?\b", r"\btrainee\b", r"\bnysc\b", r"\bassociate\b", r"\bno experience (required|needed)\b", r"\b0[-–]?1 years?\b"]
SENIORITY_WEIGHTS = [(r"\b(junior|jr\.?)\b", 3), (r"\b(graduate|grad|new.grad)\b", 3), (r"\bintern(ship)?\b", 3), (r"\b(trainee|apprentice)\b", 3), (r"\bentry\b", 3), (r"\bnysc\b", 3), (r"\bno experience\b", 3), (r"\b0[-–]?[12] years?\b", 3), (r"\bassociate\b", 2), (r"\bearly career\b", 2), (r"\b(staff|principal)\b", -6), (r"\b(head of|director|vp|architect)\b", -6), (r"\b(senior|sr\.?)\b", -5), (r"\blead\b", -5), (r"\bmanager\b", -4), (r"\b\d{1,2}\+?\s*years?\b", -4)]
TOOL_WORDS = "docker kubernetes terraform ansible helm aws".split() + ["google cloud"] + "azure cloudflare vercel netlify jenkins circleci".split() + ["github actions", "gitlab ci"] + "prometheus grafana datadog sentry".split() + ["new relic"] + "git github gitlab bitbucket jira confluence figma sketch photoshop airflow dbt spark kafka rabbitmq postman swagger notion slack".split()
TECHNICAL_WORDS = "javascript typescript python java go rust c++ c# php ruby swift kotlin scala dart r matlab react angular vue svelte node.js deno bun next.js nuxt.js express.js django flask fastapi".split() + ["spring boot"] + "laravel rails asp.net blazor pytorch tensorflow keras scikit-learn".split() + ["machine learning", "deep learning", "nlp", "computer vision", "llms", "generative ai", "data science", "graphql", "rest apis", "grpc", "websocket", "oauth", "react native", "flutter", "swiftui", "sql", "nosql", "postgresql", "mysql", "mongodb", "redis", "elasticsearch"]


def strip_html(html: Column, cap: int = 2000) -> Column:
    out = F.regexp_replace(html, r"(?i)<br\s*/?>", "\n")
    out = F.regexp_replace(out, r"(?i)</?(p|div|li|h[1-6]|tr)[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.left(js.trim(F.regexp_replace(out, r"\n{3,}", "\n\n")), F.lit(cap))


def format_description(text: Column, cap: int = 4000) -> Column:
    return F.left(js.squeeze(text), F.lit(cap))


def infer_skills(text: Column) -> Column:
    """Keywords that occur as words, in the order of the list. A keyword that ends in a symbol needs a letter or digit behind it."""
    low = F.lower(text)
    found = []
    for k in SKILL_KEYWORDS:
        end = "(?![A-Za-z0-9_])" if k[-1].isalnum() else "(?=[A-Za-z0-9_])"
        word = F.rlike(low, F.lit(f"(?<![A-Za-z0-9_]){re.escape(k)}{end}"))
        found.append(F.when(F.contains(low, F.lit(k)) & word, F.lit(k)))  # most keywords fail the cheap test
    return F.array_compact(F.array(*found))


def infer_remote(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(js.contains_any(low, ["remote", "work from home", "wfh", "anywhere"]), "true")
        .when(F.contains(low, F.lit("hybrid")), "hybrid").when(js.contains_any(low, ["onsite", "in-office"]), "false").otherwise("unknown")
    )


def remote_flag(status: Column, text: Column) -> Column:
    """true / hybrid / false / unknown from the stated status, else from the text."""
    s = js.trim(F.lower(status))
    return F.when(s.isin("true", "remote"), "true").when(s.isin("false", "onsite"), "false").when(s == "hybrid", "hybrid").otherwise(infer_remote(text))


def remote_enum(status: Column) -> Column:
    s = js.trim(F.lower(F.coalesce(status, F.lit("unknown"))))
    return F.when(s.isin("true", "remote"), "remote").when(s == "hybrid", "hybrid").when(s.isin("false", "onsite"), "onsite").otherwise("unknown")


def location_tokens(location: Column) -> Column:
    parts = F.filter(F.transform(F.split(location, "[,·|]"), lambda p: js.trim(F.lower(p))), lambda p: F.length(p) > 0)
    return F.when(F.size(parts) > 0, parts)


def site_name(site: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(site, r"(?i)^https?://", ""), r"(?i)^www\.", ""), r"/+\z", "")
    return js.blank_to_null(js.trim(out))


def url_domain(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), r"(?i)^www\.", ""))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(js.trim(url), r"[\r\n\t\u200B-\u200D\uFEFF]", "")


def apply_fallback(apply_url: Column, source_url: Column) -> Column:
    return F.coalesce(js.blank_to_null(js.trim(apply_url)), source_url)


def junk_url(url: Column) -> Column:
    return js.contains_any(F.lower(url), JUNK_URL_PARTS)


def non_job_url(url: Column) -> Column:
    return js.contains_any(url, NON_JOB_URL_PARTS)


def job_url(url: Column) -> Column:
    return ~non_job_url(url) & ~junk_url(url) & js.any_match(url, JOB_PATHS)


def junk_page(url: Column, text: Column) -> Column:
    t = F.lower(js.squeeze(text))
    no_job = js.hits(t, JOB_MARKERS) == 0
    return junk_url(url) | (F.length(t) < 100) | ((js.hits(t, HOMEPAGE_MARKERS) >= 3) & no_job) | ((js.hits(t, NON_JOB_MARKERS) >= 2) & no_job)


def marketing_page(company: Column, site: Column, title: Column, apply_url: Column, source_url: Column, text: Column) -> Column:
    """Rules in order; a company without letters or digits counts as contained in every site name."""
    desc = F.lower(js.squeeze(F.coalesce(text, F.lit(""))))
    has_job = js.hits(desc, JOB_MARKERS) > 0
    domain = F.lower(F.regexp_replace(F.regexp_replace(site, r"^(https?://)?(www\.)?", ""), r"/+\z", ""))
    name = F.regexp_replace(domain, r"\.(com|app|io|co|org).*\z", "")
    firm = F.regexp_replace(F.lower(company), "[^a-z0-9]", "")
    named = (F.length(site) > 0) & (F.contains(firm, name) | F.contains(name, firm))
    board = F.lit(False)
    for d in BOARD_DOMAINS:
        board = board | F.contains(domain, F.lit(d)) | F.contains(F.lit(d), domain)
    boarded = (F.length(site) > 0) & board & ~has_job & (F.length(desc) < 300)
    apply_domain, source_domain = url_domain(apply_url), url_domain(source_url)
    own = ~js.any_match(apply_url, APPLICATION_PATHS) & (F.length(apply_domain) > 0) & (apply_domain == source_domain)
    yes = F.coalesce(named, F.lit(False)) | F.coalesce(boarded, F.lit(False)) | F.coalesce(own, F.lit(False)) | ((F.length(desc) < 100) & ~has_job)
    return F.when((F.coalesce(F.length(company), F.lit(0)) == 0) | (F.coalesce(F.length(title), F.lit(0)) == 0), F.lit(False)).otherwise(yes)


def job_specific(text: Column) -> Column:
    t = F.lower(text)
    return js.hits(t, SPECIFIC_JOB) > js.hits(t, SPECIFIC_BOARD)


def pollution(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(js.matches(text, p), F.lit(name)) for name, p in POLLUTION.items()]))


def chrome_filter(text: Column) -> Column:
    """Lines without those of page furniture; blank lines stay."""
    whole = "|".join(f"(?:{p})" for p in CHROME_PATTERNS)
    lines = F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n")
    return js.trim(F.array_join(F.filter(lines, lambda x: (F.length(js.trim(x)) == 0) | ~js.matches(x, whole)), "\n"))


def section_extract(text: Column) -> Column:
    """From the first line with a start marker to the next with an end marker; null if there is none or it is short."""
    lines = F.filter(F.transform(F.split(text, "\n"), js.trim), lambda x: F.length(x) > 0)
    start = F.coalesce(F.array_position(F.transform(lines, lambda x: js.contains_any(F.lower(x), SECTION_START)), F.lit(True)), F.lit(0))
    rest = F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(F.size(lines), F.lit(1)))
    end = F.coalesce(F.array_position(F.transform(rest, lambda x, i: (i > 0) & js.contains_any(F.lower(x), SECTION_END)), F.lit(True)), F.lit(0))
    kept = js.trim(F.array_join(F.when(end > 0, F.slice(rest, F.lit(1), F.greatest(end - 1, F.lit(0)))).otherwise(rest), "\n"))
    return F.when((start > 0) & (F.length(kept) > 50), kept)


def quality_score(clean: Column, signals: Column) -> Column:
    n, low = F.length(clean), F.lower(clean)
    score = F.lit(50) + F.when(n > 1500, 20).when(n > 800, 15).when(n > 400, 10).when(n > 200, 5).when(n < 100, -20).when(n < 150, -10).otherwise(0)
    for p, w in QUALITY_BONUS:
        score = score + F.when(js.matches(low, p), w).otherwise(0)
    score = score + F.when(n < 50, -30).otherwise(0) + F.when(js.matches(js.trim(clean), r"^(job description|description)\s*\z"), -30).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), score - F.least(F.size(signals) * 8, F.lit(30)))).cast("int")


def quality_grade(score: Column) -> Column:
    return F.when(score >= 85, "excellent").when(score >= 70, "good").when(score >= 55, "acceptable").when(score >= 35, "poor").otherwise("reject")


def clean_description(text: Column, site: Column | None = None) -> Column:
    """struct<clean, score, grade, usable>: section or furniture-free text, white space normalised, scored."""

    def cleaned(raw: Column) -> Column:
        kept = chrome_filter(raw) if site is None else F.coalesce(F.when(F.contains(F.lower(site), F.lit("himalayas")), section_extract(raw)), chrome_filter(raw))
        clean = js.trim(F.regexp_replace(F.regexp_replace(kept, r"\n{4,}", "\n\n\n"), r"[ \t]+", " "))
        return js.let(clean, lambda c: js.let(pollution(c), lambda signals: scored(raw, c, signals)))

    def scored(raw: Column, clean: Column, signals: Column) -> Column:
        rejected = ~job_specific(clean) & (F.length(clean) < 300)
        score = F.when(F.length(raw) == 0, 0).when(rejected, F.greatest(F.lit(0), F.lit(30) - F.size(signals) * 5)).otherwise(quality_score(clean, signals)).cast("int")
        return js.let(F.struct(score.alias("s"), (rejected | (F.length(raw) == 0)).alias("r")), lambda x: F.struct(
            clean.alias("clean"), x["s"].alias("score"), F.when(x["r"], "reject").otherwise(quality_grade(x["s"])).alias("grade"), (~x["r"] & (x["s"] >= 55)).alias("usable")
        ))

    return js.let(js.trim(F.coalesce(text, F.lit(""))), cleaned)


def quality_gate(score: Column, clean: Column, title: Column, company: Column, least_score: int = 50, least_length: int = 100) -> Column:
    """Reasons against a record, joined by "; "; empty if there are none."""
    return F.concat_ws(
        "; ",
        F.when(score < least_score, F.concat(F.lit("description_quality: "), score, F.lit(f" < {least_score}"))),
        F.when(F.length(clean) < least_length, F.concat(F.lit("description_length: "), F.length(clean), F.lit(f" < {least_length}"))),
        F.when(F.coalesce(F.length(js.trim(title)), F.lit(0)) < 2, F.lit("missing_title")),
        F.when(F.coalesce(F.length(js.trim(company)), F.lit(0)) < 2, F.lit("missing_company")),
    )


def experience_level(title: Column, text: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    full = F.concat(t, F.lit(" "), F.coalesce(text, F.lit("")))
    return (
        F.when(js.any_match(t, SENIOR_PATTERNS), "senior").when(js.any_match(t, ENTRY_PATTERNS), "entry")
        .when(js.any_match(full, SENIOR_PATTERNS), "senior").when(js.any_match(full, ENTRY_PATTERNS), "entry").otherwise("unspecified")
    )


def seniority_score(title: Column, text: Column) -> Column:
    full = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))
    score = F.lit(0)
    for p, w in SENIORITY_WEIGHTS:
        score = score + F.when(js.matches(full, p), w).otherwise(0)
    return F.greatest(F.lit(-10), F.least(F.lit(10), score)).cast("int")


def skill_category(name: Column) -> Column:
    low = F.lower(name)
    return F.when(js.contains_any(low, TOOL_WORDS), "tools").when(js.contains_any(low, TECHNICAL_WORDS), "technical").otherwise("domain")


def skill_key(name: Column) -> Column:
    return F.regexp_replace(js.trim(F.lower(name)), "[^a-z0-9.+_/-]", "")


def string_list(values: Column) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: js.trim(F.lower(x))), lambda x: F.length(x) > 0)


def slug(*parts: Column) -> Column:
    return F.lower(F.regexp_replace(F.concat_ws("-", *parts), "(?i)[^a-z0-9]", "-"))


def truncate_middle(text: Column, most: int = 4000, head: int = 1500) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("\n[...]\n"), F.right(text, F.lit(most - head - 5))))


def html_escape(text: Column) -> Column:
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def retry_after(message: Column) -> Column:
    """Seconds stated by a rate-limit message; null if none."""
    h, m, s = F.regexp_extract(message, r"try again in (\d+)h", 1), F.regexp_extract(message, r"(\d+)m", 1), F.regexp_extract(message, r"([\d.]+)s", 1)
    n = lambda c: F.coalesce(F.expr("1") * js.blank_to_null(c).try_cast("double"), F.lit(0.0))
    any_part = (h != "") | (m != "") | (s != "")
    return F.when(any_part, (n(h) * 3600 + n(m) * 60 + F.ceil(n(s))).cast("bigint"))
