"""Rule-based scoring of resumes in Markdown, and small extractions from chat messages, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobloom.functions import js

# Headings, verbs and patterns the scores depend on.
HEADINGS = {
    "summary": [r"#\s+(professional\s+)?summary", r"#\s+(career\s+)?objective", r"#\s+profile"],
    "skills": [r"#\s+(technical\s+)?skills?", r"#\s+core\s+competencies", r"#\s+technologies", r"#\s+technical\s+proficiencies"],
    "experience": [r"#\s+(work\s+)?experience", r"#\s+professional\s+experience", r"#\s+employment\s+history", r"#\s+career\s+history"],
    "education": [r"#\s+education", r"#\s+academic\s+background", r"#\s+degrees"], "projects": [r"#\s+projects?", r"#\s+portfolio", r"#\s+key\s+projects"],
    "certifications": [r"#\s+certifications?", r"#\s+licenses?", r"#\s+credentials"],
}
BODIES = {
    "summary": r"#\s+(?:professional\s+)?(?:summary|objective|profile)\s*\n", "skills": r"#\s+(?:technical\s+)?(?:skills?|core\s+competencies|technologies|technical\s+proficiencies)\s*\n",
    "experience": r"#\s+(?:work\s+)?(?:experience|professional\s+experience|employment\s+history|career\s+history)\s*\n", "education": r"#\s+education\s*\n",
    "projects": r"#\s+projects?\s*\n", "certifications": r"#\s+certifications?\s*\n",
}
ACTION_VERBS = "led managed directed supervised coordinated mentored trained guided oversaw headed spearheaded championed achieved attained exceeded surpassed outperformed delivered completed accomplished successfully developed built designed implemented architected engineered programmed coded deployed automated analyzed evaluated assessed identified discovered researched investigated diagnosed troubleshot improved enhanced optimized streamlined increased reduced decreased minimized maximized accelerated created established founded launched initiated introduced pioneered conceptualized presented communicated collaborated negotiated influenced persuaded advocated".split()
RESULT_WORDS = [r"accomplished", r"achieved", r"delivered", r"resulted?\s+in", r"leading\s+to", r"contribut(ed|ing)\s+to", r"measured\s+by", r"by\s+(doing|using|leveraging|implementing)"]
NUMBERS = [r"\d+%", r"\$[\d,]+", r"\d+\+?\s*(users?|customers?|clients?|accounts?|projects?|team\s+members?)", r"\d+\s*(hours?|days?|weeks?|months?|years?)", r"\d+\s*(times?|x)", r"\d+\.\d+", r"\b\d{1,3}(,\d{3})+\b"]
DATES = r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{4}\s*[-–]\s*(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)?\s*\d{4}|(?:Present|Current)"
CLAIMS = [
    r"(?:[$€£₦]|USD|NGN)\s?\d[\d,.]*\s?(?:thousand|million|billion|k|m|b)?",
    r"\d[\d,.]*\s?(?:thousand|million|billion|k|m|b)?\s?(?:users|customers|clients|downloads|revenue|requests|transactions|ARR|MRR|DAU|MAU)",
    r"\d[\d,.]*\s?%\s?(?:increase|growth|reduction|improvement|boost|uplift|rise|jump|decrease|drop)", r"\d[\d,.]*(?:x|X)\s?(?:increase|growth|improvement|faster|speedup|boost)",
    r"\b(?:won|awarded|award|recognized as|named|recipient of)\b",
]


def has_section(text: Column, name: str) -> Column:
    return js.matches(text, "^(?:" + "|".join(HEADINGS[name]) + ")", "im")


def section(text: Column, name: str) -> Column:
    """The text below a heading up to the next one, a rule, or a last line break; null if the heading isn't found."""
    p = f"(?is){BODIES[name]}(.*?)(?=\\n#\\s|\\n---|\\n\\z)"
    return F.when(F.rlike(text, F.lit(p)), F.regexp_extract(text, p, 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bullets(text: Column) -> Column:
    return F.size(F.filter(_lines(text), lambda x: F.rlike(js.trim(x), F.lit("^[-•]"))))


def _yes(cond: Column, points: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0)


def contact(text: Column) -> Column:
    first = F.get(F.filter(_lines(text), lambda x: F.length(js.trim(x)) > 0), F.lit(0))
    name = F.rlike(first, F.lit("[a-zA-Z]")) & ~F.rlike(js.trim(first), F.lit("^[-–—•]"))
    return (
        _yes(name, 3) + _yes(F.rlike(text, F.lit(r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+")), 2) + _yes(F.rlike(text, F.lit(r"[+]?[0-9\s()-]{10,}")), 2)
        + _yes(F.rlike(text, F.lit(r"(?i)linkedin\.com/in/[A-Za-z0-9_-]+")), 2) + _yes(F.rlike(text, F.lit(r"(?i)(?:location|city|state|country):\s*[A-Za-z0-9_\s,]+")), 1)
    )


def _scored(text: Column, name: str, exists: int, absent: int, parts: list[tuple]) -> Column:
    body = section(text, name)
    total = F.lit(exists)
    for test, points in parts:
        total = total + _yes(test(body), points)
    return F.when(has_section(text, name), total).otherwise(absent)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, js.SPACE + "+"), lambda w: F.length(w) > 0))


def summary(text: Column) -> Column:
    verb = lambda s: F.exists(F.split(s, "[.!?]+"), lambda x: F.lower(F.get(F.split(js.trim(x), js.SPACE + "+"), F.lit(0))).isin(*ACTION_VERBS))
    return _scored(text, "summary", 3, 0, [(lambda s: (word_count(s) >= 20) & (word_count(s) <= 100), 3), (lambda s: js.any_match(s, NUMBERS), 2), (verb, 2)])


def skills(text: Column) -> Column:
    return _scored(text, "skills", 3, 0, [(lambda s: _bullets(s) >= 5, 2), (lambda s: F.rlike(s, F.lit(r"(?m)^##\s+")), 2), (lambda s: F.length(s) > 50, 3)])


def experience(text: Column) -> Column:
    entries = lambda s: F.regexp_count(s, F.lit(r"(?m)^##\s+.+$")) >= 1
    return _scored(text, "experience", 2, 0, [(entries, 2), (lambda s: js.matches(s, DATES), 2), (lambda s: F.regexp_count(s, F.lit(r"(?m)^[-•]\s+.+$")) >= 3, 2), (lambda s: js.any_match(s, RESULT_WORDS), 2)])


def education(text: Column) -> Column:
    degree = r"(?:Bachelor|Master|Ph\.?D|B\.?S\.?|M\.?S\.?|B\.?A\.?|M\.?A\.?|Associate|Diploma)"
    return _scored(text, "education", 4, 0, [(lambda s: js.matches(s, degree), 2), (lambda s: js.matches(s, "(?:University|College|Institute|School)"), 2), (lambda s: js.matches(s, r"\b(19|20)\d{2}\b"), 2)])


def projects(text: Column) -> Column:
    return _scored(text, "projects", 5, 5, [(lambda s: F.rlike(s, F.lit(r"(?m)^##\s+.+$")), 2), (lambda s: js.matches(s, r"(?:technologies?|tech\s+stack|built\s+with|using)"), 3)])


def certifications(text: Column) -> Column:
    return _scored(text, "certifications", 8, 5, [(lambda s: _bullets(s) >= 1, 2)])


def formatting(text: Column) -> Column:
    gaps = F.size(F.filter(_lines(text), lambda x: F.rlike(x, F.lit(r"\S\s{3,}\S"))))
    every = [p for ps in HEADINGS.values() for p in ps]
    standard = F.size(F.filter(_lines(text), lambda x: F.rlike(x, F.lit(r"^#\s+.+")) & js.matches(x, "^(?:" + "|".join(every) + ")")))
    return _yes(~F.rlike(text, F.lit(r"\|.*\|.*\|")), 3) + _yes(gaps < 2, 2) + _yes(standard >= 3, 3) + _yes(~F.contains(text, F.lit("****")) & ~F.contains(text, F.lit("```")), 2)


def jd_words(job: Column) -> Column:
    return F.filter(F.split(F.lower(job), "[^a-z0-9_]+"), lambda w: F.length(w) > 3)


def keyword_rate(text: Column, job: Column) -> Column:
    """Distinct words of the job found in the resume, over all its words."""
    words = jd_words(job)
    found = F.size(F.array_distinct(F.filter(words, lambda w: F.contains(F.lower(text), w))))
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(F.lit(0.0))


def keywords(text: Column, job: Column | None) -> Column:
    if job is None:
        return F.lit(5)
    rate = keyword_rate(text, job)
    return F.when(F.coalesce(F.length(job), F.lit(0)) == 0, 5).when(rate >= 0.6, 8).when(rate >= 0.3, 5).otherwise(2)


def length(text: Column) -> Column:
    n = F.length(text)
    return F.when(n.between(1000, 3500), 10).when(n.between(500, 5000), 7).when(n < 500, 4).otherwise(3)


SECTIONS = {"contact": contact, "summary": summary, "skills": skills, "experience": experience, "education": education, "projects": projects, "certifications": certifications, "formatting": formatting}


def score(text: Column, job: Column | None = None) -> Column:
    """struct<one column a section, score in percent, grade>."""
    parts = [f(text).cast("int").alias(k) for k, f in SECTIONS.items()] + [keywords(text, job).cast("int").alias("keywords"), length(text).cast("int").alias("length")]
    total = sum((f(text) for f in SECTIONS.values()), F.lit(0)) + keywords(text, job) + length(text)
    percent = F.floor(total.cast("double") / 100.0 * 100.0 + 0.5).cast("int")
    grade = F.when(percent >= 90, "A").when(percent >= 80, "B").when(percent >= 70, "C").when(percent >= 60, "D").otherwise("F")
    return F.struct(*parts, percent.alias("score"), grade.alias("grade"))


def claims(text: Column, most: int = 5) -> Column:
    """Statements that need confirmation, in order of kind and place."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit("(?i)" + js.java(p)), F.lit(0)) for p in CLAIMS]))
    return F.slice(F.array_distinct(F.filter(F.transform(found, js.trim), lambda x: F.length(x) > 1)), 1, most)


def contains_claim(value: Column, claim: Column) -> Column:
    """Whether a text holds a claim, or one of its figures, in any spacing and with long or short unit."""
    compact = F.regexp_replace(F.lower(value), r"\s+", "")
    tokens = F.regexp_extract_all(claim, F.lit(r"(?i)\$?[\d,.]+\s*(?:%|percent|thousand|million|billion|k|m|b)?"), F.lit(0))
    tokens = F.filter(F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9%$]", "")), lambda t: F.rlike(t, F.lit("[0-9]")))
    short = lambda t: F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"million\z", "m"), r"thousand\z", "k"), r"billion\z", "b")
    return F.contains(compact, F.regexp_replace(F.lower(claim), r"\s+", "")) | F.exists(tokens, lambda t: F.contains(compact, t) | F.contains(compact, short(t)))


def extract_fields(message: Column) -> Column:
    """struct<email, phone, location> stated in a chat message."""
    t = js.trim(message)
    email = js.blank_to_null(F.lower(F.regexp_extract(t, r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+", 0)))
    phone = js.blank_to_null(js.trim(F.regexp_extract(t, r"(\+?\d[\d\s\-()]{7,}\d)", 1)))
    place = js.blank_to_null(F.regexp_replace(js.trim(F.regexp_extract(t, js.java(r"(?i)\b(?:i (?:live|am based|am) in|based in|located in)\s+([A-Za-z][A-Za-z0-9_\s,'-]{2,50})"), 1)), r"[.,;]+\z", ""))
    return F.struct(email.alias("email"), phone.alias("phone"), place.alias("location"))


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names of fields that are null, blank or an empty list, in order. Lists are told by their name in `lists`."""
    lists = {"skills", "experience", "education"}
    return F.array_compact(F.array(*[F.when(F.coalesce(F.size(c) == 0, F.lit(True)) if n in lists else F.coalesce(F.length(js.trim(c)) == 0, F.lit(True)), F.lit(n)) for n, c in fields.items()]))


REQUIRED = ["Experience", "Education", "Skills"]


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().removeprefix("|").removesuffix("|").split("|") if c.strip()]


def reformat(raw: str, limit: int = 3000) -> str:
    """A resume with tables as bullets, headings in title case, required headings, few blank lines, and one page long."""
    out: list[str] = []
    header: list[str] | None = None
    for line in re.split(r"\r?\n", raw):
        t = line.rstrip()
        if re.match(r"^\s*\|.*\|\s*$", t):
            if re.match(r"^\s*\|?\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$", t):
                continue
            if header is None:
                header = _cells(t)
            else:
                out.append("- " + "; ".join(f"{header[i]}: {c}" if i < len(header) else c for i, c in enumerate(_cells(t))))
            continue
        header = None
        out.append("## " + " ".join(w[:1].upper() + w[1:] for w in t[2:].lower().split()) if re.match(r"^##\s+\S", t) else t)
    have = {x[2:].strip().lower() for x in out if re.match(r"^##\s+\S", x)}
    if missing := [s for s in REQUIRED if s.lower() not in have]:
        out += ["", *(f"## {s}" for s in missing)]
    kept, blank = [], 0
    for x in out:
        blank = 0 if x.strip() else blank + 1
        if blank <= 2:
            kept.append(x)
    text = "\n".join(kept).strip()
    if len(text) > limit:
        ends = [m.start() for m in re.finditer(r"(?m)^##\s+.+$", text) if 0 < m.start() <= limit]
        text = text[: ends[-1] if ends else limit].rstrip()
    return text
