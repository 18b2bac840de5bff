"""Values typed freely, mapped to the closest entry of a reference list; values without an entry are reported.

A typed value is stripped of decoration and folded (case, accents, separators). It is looked up in a symmetric-delete
dictionary: every reference form is indexed under itself and all its forms with up to max_edits characters deleted; a
typed value meets each form within that distance in one of its own deletes. Candidates are ranked by weighted
Damerau-Levenshtein distance (swaps, doublings and neighbouring keys cost less), then by how often the entry occurs
exactly in the data, then by id.

The dictionary is made from a reference table of checked size and goes to every task; rows are never shuffled.

Defined results: a null array or null, blank element gives no row; text of any length is accepted, values over
max_length characters (no reference form is that long) have no entry; ties end at the smaller id; repeated values give
a row each.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.tables import rows_of

# Common other names, by the name they mean.
SKILL_NAMES = {
    "Account Management": ["acct mgmt", "key account management"], "Adobe Illustrator": ["illustrator", "ai (illustrator)"],
    "Adobe Photoshop": ["ps (photoshop)"], "Amazon Web Services": ["amazon aws", "aws cloud"], "Angular": ["angularjs", "angular 2+"],
    "Apache Airflow": ["airflow"], "Apache Spark": ["pyspark", "spark sql"], "BigQuery": ["bq", "google bigquery"], "C": ["c language", "c99"],
    "C#": ["csharp", "c sharp", "c#.net"], "C++": ["c plus plus", "cplusplus", "c++ 11/14"], "Computer Vision": ["cv (vision)"],
    "Continuous Integration": ["ci/cd", "ci/cd pipelines", "cicd"], "Customer Service": ["client service", "customer care"],
    "Data Protection": ["gdpr"], "Deep Learning": [], "Electronic Health Records": ["ehr"], "Elasticsearch": ["elastic search"],
    "Embedded Systems": ["embedded"], "Financial Modelling": ["fin. modelling", "financial modeling"], "3D Modelling": ["3d modeling"],
    "Go": ["golang", "go lang", "go (golang)"], "Google Cloud Platform": ["gcp", "google cloud"], "JavaScript": ["ecmascript", "vanilla js"],
    "Kubernetes": ["k8s", "kube", "k8"], "Labour Law": ["employment law"], "Machine Learning": ["ml"], "Microservices": ["micro services"],
    "Microsoft Azure": ["ms azure"], "Microsoft Excel": ["excel", "ms excel", "excel (pivot tables)"], "Microsoft SQL Server": ["sql server", "ms sql", "ms sql server"],
    "Microsoft Windows": ["windows", "win 10/11", "ms windows"], "Active Directory": ["ms active directory"], "Natural Language Processing": ["nlp", "nat. language processing"],
    "Node.js": ["node"], "Penetration Testing": ["pen testing", "pen test"], "PostgreSQL": ["psql", "pg sql", "postgre sql"], "Power BI": ["ms power bi", "powerbi"],
    "Product Management": ["product mgmt"], "Project Management": ["project mgmt"], "PyTorch": ["torch"], "R": ["gnu r", "rstats", "r programming"],
    "React": ["reactjs", "react js"], "Ruby on Rails": ["ror", "rails"], "scikit-learn": ["scikit"], "Search Engine Optimization": ["search engine optimisation"],
    "Social Media Marketing": ["smm", "social media mktg"], "Stakeholder Management": ["stakeholder mgmt"], "Risk Management": ["risk mgmt"],
    "Supply Chain Management": ["scm", "supply-chain mgmt"], "TensorFlow": ["tf2", "tf (tensorflow)"], "Terraform": ["terraform iac", "tf (terraform)"],
    "TypeScript": ["ts"], "User Research": ["ux research"], "Vue.js": ["vue 3", "vuejs"], "Unreal Engine": ["ue4", "unreal"], "Tailwind CSS": ["tailwind"],
}
PLACE_NAMES = {
    "Lagos": ["eko"], "Nairobi": ["nbo"], "Johannesburg": ["jhb", "jozi"], "Cape Town": ["kaapstad"], "Durban": ["ethekwini"], "Cairo": ["le caire", "kairo"],
    "Casablanca": ["casa"], "London": ["ldn", "londres", "londra"], "Edinburgh": ["edimbourg"], "Berlin": ["bln"], "Munich": ["muenchen", "monaco di baviera"],
    "Cologne": ["koeln", "köln"], "Frankfurt am Main": ["ffm", "frankfurt/main", "frankfurt a.m."], "Düsseldorf": ["duesseldorf"], "Nuremberg": ["nuernberg"],
    "Vienna": ["wien", "vienne"], "Zurich": ["zuerich", "zrh"], "Geneva": ["genf", "gva"], "Brussels": ["brussel", "bxl"], "Antwerp": ["anvers", "antwerpen"],
    "The Hague": ["den haag", "'s-gravenhage"], "Barcelona": ["bcn"], "Lisbon": ["lisboa", "lissabon"], "Milan": ["milano", "mailand"], "Florence": ["firenze"],
    "Athens": ["athen", "athènes"], "Warsaw": ["warschau", "varsovie"], "Krakow": ["cracow", "kraków", "krakau"], "Wroclaw": ["breslau"], "Prague": ["prag"],
    "Copenhagen": ["cph", "københavn", "kobenhavn"], "Gothenburg": ["gbg"], "New York City": ["new york", "big apple", "new york, ny"], "San Francisco": ["sf", "san fran"],
    "Los Angeles": ["l.a."], "Dallas": ["dfw"], "Atlanta": ["atl"], "Minneapolis": ["mpls"], "Washington": ["d.c.", "washington d.c.", "washington, d.c."], "Montreal": ["mtl", "montréal"],
    "Mexico City": ["cdmx"], "Bogota": ["bogotá"], "Buenos Aires": ["caba"], "Sao Paulo": ["sp capital", "são paulo"], "Bengaluru": ["b'lore", "blr"], "Chennai": ["madras"],
    "Singapore": ["sgp"], "Ho Chi Minh City": ["hcmc"], "Hong Kong": ["hkg"], "Brisbane": ["brissie"], "Istanbul": ["i̇stanbul"], "Toronto": ["the 6ix"], "Manila": ["metro manila"],
}
# Decorations of typed values.
SKILL_BEFORE = re.compile(r"^(?:good knowledge of|knowledge of|experience (?:with|in)|\d+\+? (?:years|yrs) (?:of|in)|advanced|basic|expert in|strong)\s+", re.I)
SKILL_AFTER = re.compile(r"\s*(?:\((?:nice to have|required|\d+\+? ?(?:yrs|years))\)|,\s*(?:fluent|expert|advanced|basic)|\s-\s*(?:expert|advanced|basic))$", re.I)
WORK_MODE = re.compile(r"[·(\-–,|/]?\s*\b(?:hybrid(?: \d days)?|fully remote|remote|on-?site|in office)\b\s*[)·\-–|/]?", re.I)
PLACE_BEFORE = re.compile(r"^(?:\d{4,6}\s+|near\s+|central\s+|greater\s+|downtown\s+)+", re.I)
PLACE_AFTER = re.compile(r"(?:\s+(?:metro area|metropolitan area|area|office|metro|region|hq))+$", re.I)
NEIGHBOURS = {a: set(b) for a, b in {
    "q": "wa", "w": "qeas", "e": "wrsd", "r": "etdf", "t": "ryfg", "y": "tugh", "u": "yihj", "i": "uojk", "o": "ipkl", "p": "ol", "a": "qwsz", "s": "weadzx", "d": "ersfxc",
    "f": "rtdgcv", "g": "tyfhvb", "h": "yugjbn", "j": "uihknm", "k": "iojlm", "l": "opk", "z": "asx", "x": "sdzc", "c": "dfxv", "v": "fgcb", "b": "ghvn", "n": "hjbm", "m": "jkn",
}.items()}


def fold(text: str) -> str:
    """Lower case without accents and separators; + and # stay, they tell C, C++ and C# apart."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return re.sub(r"[\s_\-./'’`´()\"“”]+", "", t.replace("ı", "i").replace("ø", "o").replace("ł", "l").replace("ß", "ss"))


def deletes(word: str, edits: int) -> set[str]:
    """The word and every form of it with up to so many characters deleted."""
    out = level = {word}
    for _ in range(edits):
        level = {w[:i] + w[i + 1:] for w in level for i in range(len(w))}
        out = out | level
    return out


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein distance (adjacent swaps); swap 0.8, doubled letter 0.7, neighbouring key 0.8, first letter 1.2."""
    la, lb = len(a), len(b)
    d = [[0.0] * (lb + 1) for _ in range(la + 1)]
    for i in range(la + 1):
        for j in range(lb + 1):
            if not i or not j:
                d[i][j] = float(i + j)
                continue
            x, y = a[i - 1], b[j - 1]
            drop = 0.7 if i > 1 and a[i - 2] == x else 1.0
            add = 0.7 if j > 1 and b[j - 2] == y else 1.0
            swap = 0.0 if x == y else 0.8 if y in NEIGHBOURS.get(x, ()) else 1.2 if i == j == 1 else 1.0
            best = min(d[i - 1][j] + drop, d[i][j - 1] + add, d[i - 1][j - 1] + swap)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, d[i - 2][j - 2] + 0.8)
            d[i][j] = best
    return d[la][lb]


class DeleteDictionary:
    """Reference forms indexed under their deletes. forms: (form, id); counts: exact occurrences of an id in the data."""

    def __init__(self, forms: Iterable[tuple[str, int]], counts: Mapping[int, int] | None = None, max_edits: int = 2, max_length: int = 80) -> None:
        self.exact: dict[str, set[int]] = defaultdict(set)
        self.index: dict[str, set[str]] = defaultdict(set)
        self.counts, self.max_edits, self.max_length = counts or {}, max_edits, max_length
        for form, ref in forms:
            if key := fold(form):
                self.exact[key].add(ref)
        for key in self.exact:
            for k in deletes(key, self.edits_for(key)):
                self.index[k].add(key)

    def edits_for(self, key: str) -> int:
        """Short forms are matched exactly, as one edit makes another word of them."""
        return 0 if len(key) < 4 else 1 if len(key) < 6 else self.max_edits

    def lookup(self, typed: str) -> list[int]:
        """Ids of the closest forms, best first; empty if there is none within the distance."""
        key = fold(typed)
        if not key or len(key) > self.max_length:
            return []
        if key in self.exact:
            return sorted(self.exact[key])
        edits = self.max_edits if len(key) >= 5 else 1 if len(key) >= 4 else 0
        if not edits:
            return []
        hits = {c for k in deletes(key, edits) for c in self.index.get(k, ())}
        ranked = []
        for c in hits:
            dist = weighted_distance(key, c)
            if dist <= min(self.edits_for(c), edits) + 1e-9 and dist <= 0.34 * max(len(c), len(key)):
                ranked += [(round(dist, 3), -self.counts.get(ref, 0), ref) for ref in self.exact[c]]
        return [ref for _, _, ref in sorted(ranked)]


def skill_variants(typed: str) -> Iterable[str]:
    """A typed skill as it is, then with more and more decoration removed."""
    t = typed.strip()
    yield t
    t = t.strip(" \t\n•*·-–—#\"'“”„;:,.").strip()
    yield t
    while (u := SKILL_AFTER.sub("", SKILL_BEFORE.sub("", t)).strip()) != t:
        t = u
        yield t
    if m := re.fullmatch(r"(.*?)\s*\((.*)\)", t):
        yield m[1]
        yield m[2]
    if (u := re.sub(r"(?<=[a-z+#])\s?v?\d+(?:\.\d+)*\+?(?:/\d+)?$", "", t, flags=re.I)) != t:
        yield u


class PlaceReader:
    """Splits a typed location into the city and what states its country."""

    def __init__(self, countries: Mapping[str, str]) -> None:
        self.countries = countries

    def read(self, typed: str) -> tuple[list[str], str | None]:
        """(candidates for the city, country code or None)."""
        t = typed.strip()
        bare = WORK_MODE.sub("|", t).strip("| ")
        parts = [p.strip() for p in re.split(r"[,;|()·]|\s[/\-–]\s", bare) if p.strip()]
        country, rest = None, []
        for p in parts:
            code = self.countries.get(fold(p))
            if code and len(parts) > 1 and country is None and not (rest == [] and p is parts[-1]):
                country = code
            else:
                rest.append(p)
        if len(rest) == 1 and country is None and (m := re.fullmatch(r"(.+?)\s+([A-Z]{2})", rest[0])) and fold(m[2]) in self.countries:
            country, rest = self.countries[fold(m[2])], [m[1]]
        return [PLACE_AFTER.sub("", PLACE_BEFORE.sub("", p)) for p in rest], country


def named_forms(rows: Iterable, id_col: str, name_col: str, other_names: Mapping[str, list[str]]) -> list[tuple[str, int]]:
    """Every form of a reference table with its id: name, its also_known_as, and the fixed other names."""
    out = []
    for r in rows:
        for form in [r[name_col], *(r["also_known_as"] or []), *other_names.get(r[name_col], [])]:
            out.append((form, r[id_col]))
    return out


def match_skill(typed: str, words: DeleteDictionary) -> int:
    tried = list(dict.fromkeys(v for v in skill_variants(typed) if v))
    for v in tried:
        if fold(v) in words.exact:
            return words.lookup(v)[0]
    for v in tried[1:] or tried:
        if got := words.lookup(v):
            return got[0]
    return 0


def match_place(typed: str, words: DeleteDictionary, reader: PlaceReader, country_of: Mapping[int, str]) -> int:
    if got := words.exact.get(fold(typed)):
        return min(got, key=lambda r: (-words.counts.get(r, 0), r))
    cities, country = reader.read(typed)
    for exact in (True, False):
        for c in cities:
            got = words.lookup(c) if not exact or fold(c) in words.exact else []
            got = [r for r in got if country is None or country_of[r] == country]
            if got:
                return min(got, key=lambda r: -words.counts.get(r, 0)) if exact else got[0]
        if exact and country:  # a city state: its country's name is the city's
            for p in re.split(r"[,;|()·/\-–]", typed):
                got = [r for r in words.exact.get(fold(p), ()) if country_of[r] == country]
                if got:
                    return min(got)
    return 0


def exact_counts(values: DataFrame, forms: list[tuple[str, int]]) -> dict[int, int]:
    """How often each entry occurs exactly (case aside) in the column "typed" of values; sent back: one row an entry."""
    spark = values.sparkSession
    names = spark.createDataFrame([(f.lower(), r) for f, r in forms], "form string, ref int")
    counted = values.groupBy(F.lower(F.trim("typed")).alias("form")).count()
    rows = counted.join(F.broadcast(names), "form").groupBy("ref").agg(F.sum("count").alias("n")).collect()
    return {r.ref: r.n for r in rows}


def canonicalise(typed: Column, kind: Column, skills: DataFrame, places: DataFrame, values: DataFrame) -> Column:
    """ref_id (int, 0 if the list has no such entry) of a typed value; kind is `skills` or `location`.

    skills, places: reference tables of at most 20,000 rows each. values: (kind, typed), the data for the frequencies.
    """
    skill_rows, place_rows = rows_of(skills, 20_000, "the list of skills"), rows_of(places, 20_000, "the list of places")
    skill_forms = named_forms(skill_rows, "skill_id", "skill_name", SKILL_NAMES)
    place_forms = named_forms(place_rows, "place_id", "city", PLACE_NAMES)
    skill_counts = exact_counts(values.where(F.col("kind") == "skills"), skill_forms)
    place_counts = exact_counts(values.where(F.col("kind") == "location"), place_forms)
    countries = {fold(n): r.country_code for r in place_rows for n in (r.country, r.country_code)}
    countries |= {fold(n): c for n, c in (("USA", "US"), ("U.S.A.", "US"), ("GB", "UK"), ("Great Britain", "UK"), ("England", "UK"), ("Turkey", "TR"), ("Deutschland", "DE"), ("España", "ES"))}
    country_of = {r.place_id: r.country_code for r in place_rows}
    made: dict = {}

    @F.pandas_udf("int")
    def match(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        if not made:
            made["skills"] = DeleteDictionary(skill_forms, skill_counts)
            made["places"] = DeleteDictionary(place_forms, place_counts)
            made["reader"] = PlaceReader(countries)
            made["seen"] = {}
        seen = made["seen"]
        if len(seen) > 200_000:  # a cache only: values are looked up again
            seen.clear()
        out = []
        for t, k in zip(texts, kinds, strict=True):
            if (t, k) not in seen:
                seen[t, k] = match_skill(t, made["skills"]) if k == "skills" else match_place(t, made["places"], made["reader"], country_of)
            out.append(seen[t, k])
        return pd.Series(out, dtype="int32")

    return match(typed, kind)


def typed_values(jobs: DataFrame) -> DataFrame:
    """(id, src_field, item_pos, typed): every non-blank element of skills and every non-blank location."""
    items = F.transform("skills", lambda x, i: F.struct(F.lit("skills").alias("src_field"), i.cast("int").alias("item_pos"), x.alias("typed")))
    place = F.array(F.struct(F.lit("location").alias("src_field"), F.lit(0).alias("item_pos"), F.col("location").alias("typed")))
    both = F.concat(F.coalesce(items, F.array().cast("array<struct<src_field:string,item_pos:int,typed:string>>")), place)
    return jobs.select("id", F.explode(both).alias("v")).select("id", "v.*").where(F.col("typed").rlike(r"\S"))


def canonical_values(jobs: DataFrame, skills: DataFrame, places: DataFrame) -> DataFrame:
    """(id, src_field, item_pos, ref_id) of every typed value; ref_id 0 reports a value without entry."""
    values = typed_values(jobs)
    ref = canonicalise(F.col("typed"), F.col("src_field"), skills, places, values.select(F.col("src_field").alias("kind"), "typed"))
    return values.select("id", "src_field", "item_pos", ref.alias("ref_id"))


def unmatched_values(jobs: DataFrame, skills: DataFrame, places: DataFrame) -> DataFrame:
    """(src_field, typed_folded, n): values without an entry, with how often they occur."""
    values = typed_values(jobs)
    ref = canonicalise(F.col("typed"), F.col("src_field"), skills, places, values.select(F.col("src_field").alias("kind"), "typed"))
    return values.where(ref == 0).groupBy("src_field", F.lower(F.trim("typed")).alias("typed_folded")).agg(F.count("*").alias("n"))
