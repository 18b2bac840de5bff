"""Readers of feed payloads: one JSON or XML document a row becomes rows of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions import js, text

FLAT = "array<struct<id:string,position:string,company:string,description:string,slug:string,url:string,tags:array<string>,salary_min:double,salary_max:double,remote:string,date:string,company_logo:string>>"
NESTED = "struct<jobs:array<struct<id:string,title:string,company_name:string,description:string,url:string,tags:array<string>,salary:string,candidate_required_location:string,publication_date:string>>>"
ITEM = "title string, link string, pubDate string, description string"


def _present(c: Column) -> Column:
    return js.blank_to_null(js.trim(c))


def read_flat(payloads: DataFrame, column: str = "payload", base: str = "https://feed.example/jobs/") -> DataFrame:
    """Postings of a payload that is a list; entries without id, title, company or description are dropped."""
    x = payloads.select(F.explode(F.from_json(column, FLAT)).alias("x")).select("x.*").where(F.col("id").isNotNull())
    k = lambda c: F.concat(F.lit("$"), js.rounded(F.col(c) / 1000).cast("int").cast("string"), F.lit("k"))
    pay = F.when((F.col("salary_min") > 0) & (F.col("salary_max") > 0), F.concat(k("salary_min"), F.lit("-"), k("salary_max"))).when(F.col("salary_min") > 0, F.concat(k("salary_min"), F.lit("+")))
    link = F.coalesce(F.concat(F.lit(base), js.blank_to_null(F.coalesce("slug", "id"))), F.col("url"))
    out = x.select(
        _present(F.col("position")).alias("title"), _present(F.col("company")).alias("company"), F.when(_present(F.col("description")).isNotNull(), text.strip_html(F.col("description"))).alias("description"),
        text.string_list(F.col("tags")).alias("skills"), F.when(F.col("remote").isin("true", "1"), "remote").alias("remote_status"), pay.alias("salary_range"),
        F.col("url").alias("apply_url"), F.col("date").alias("posted_date"), link.alias("source_url"), F.col("company_logo").alias("logo_url"),
    )
    return out.where("title is not null and company is not null and description is not null and source_url is not null")


def read_nested(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Postings of a payload that holds its list under `jobs`; "Anywhere" is no location, all are remote."""
    x = payloads.select(F.explode(F.from_json(column, NESTED)["jobs"]).alias("x")).select("x.*")
    place = _present(F.col("candidate_required_location"))
    out = x.select(
        _present(F.col("title")).alias("title"), _present(F.col("company_name")).alias("company"), F.when(F.lower(place) != "anywhere", place).alias("location"),
        F.when(_present(F.col("description")).isNotNull(), text.strip_html(F.col("description"))).alias("description"), text.string_list(F.col("tags")).alias("skills"),
        F.lit("remote").alias("remote_status"), _present(F.col("salary")).alias("salary_range"), F.col("publication_date").alias("posted_date"), F.col("url").alias("source_url"),
    )
    return out.where("title is not null and company is not null and description is not null and source_url is not null")


def split_title(title: Column) -> Column:
    """struct<company, title> of "Company: Title"; without colon the company is Unknown."""
    at = F.instr(title, ":")
    company = F.when(at > 0, js.trim(F.left(title, at - 1))).otherwise(F.lit("Unknown"))
    return F.struct(company.alias("company"), F.when(at > 0, js.trim(F.substring(title, at + 1, F.length(title)))).otherwise(js.trim(title)).alias("title"))


def read_items(items: DataFrame, column: str = "item") -> DataFrame:
    """Postings of RSS items, one <item> element a row."""
    x = items.select(F.from_xml(column, ITEM).alias("x")).select("x.*")
    return x.select(split_title(F.col("title")).alias("t"), "link", "pubDate", "description").select(
        F.col("t.company").alias("company"), F.col("t.title").alias("title"), text.strip_html(F.col("description")).alias("description"), F.col("pubDate").alias("posted_date"), F.col("link").alias("source_url")
    )


def first_seen(rows: DataFrame, key: str = "source_url", position: str = "pos") -> DataFrame:
    """The first row of every key by ingest position."""
    from jobloom.operators.search import latest

    return latest(rows, [F.col(key)], [-F.col(position)])


def read_sitemaps(files: DataFrame, column: str = "xml", most: int = 200, holds: str | None = None) -> DataFrame:
    """(url) of sitemaps (one document a row): distinct, those that hold a text (any case), at most `most` in order."""
    urls = files.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?is)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("url")).distinct()
    if holds:
        urls = urls.where(F.contains(F.lower("url"), F.lit(holds.lower())))
    return urls.orderBy("url").limit(most)


def read_resumes(uploads: DataFrame, cap: int = 8000, least: int = 20, max_bytes: int = 2 * 1024 * 1024) -> DataFrame:
    """(id, resume_text) of uploads (id, kind, body): plain text, or text as base64 up to max_bytes; short ones are rejected."""
    kind = F.lower(F.col("kind"))
    decoded = F.when(kind == "text", F.col("body")).when((kind == "txt") & (F.length("body") * 3 / 4 <= max_bytes), F.try_to_binary("body", F.lit("base64")).cast("string"))
    return uploads.select("id", F.left(js.trim(decoded), F.lit(cap)).alias("resume_text")).where(F.length("resume_text") >= least)
