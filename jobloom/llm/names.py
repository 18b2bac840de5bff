"""Spellings of names that mean the same entity, linked.

A name is read into first name, surnames, line of business and legal form; notes (places, departments, "Careers at")
are dropped. Names that read alike form a class. Classes are blocked by token suffixes of at least min_suffix letters.
A suffix that more than common classes share is refined with the other surname (its first or last three letters) and
used in the refined form only; names of short surnames only share blocks of their letters with some left out; no block is dropped, and a block's pairs are made by a join, not in one task. Pairs that
agree in the fields both state are compared by the ratio of their longest common subsequence. Linked classes become
connected components; a name without line of business joins the one entity its surnames fit.

Defined results: null and blank names, and values that name nobody, are in no pair; repeated rows count once; a name of
one or many tokens, or of any length, is compared as a whole; two entities with the same surnames and different lines of
business stay apart, and a name that fits several of them equally stays alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobloom.operators.components import connected_components
from jobloom.session import written

# Values that name nobody, legal forms, lines of business with their short forms, nicknames, notes.
NOBODY = {
    "unknown", "confidential", "employer not disclosed", "not disclosed", "undisclosed", "anonymous", "n/a", "na", "none", "null", "private", "private employer",
    "private advertiser", "company confidential", "confidential company", "our client", "client", "various", "tba", "tbd", "-", "not specified", "hidden",
}
LEGAL = {
    "ltd": "ltd", "limited": "ltd", "plc": "plc", "llc": "llc", "inc": "inc", "incorporated": "inc", "gmbh": "gmbh", "sa": "sa", "bv": "bv", "pty": "pty",
    "ag": "ag", "kg": "kg", "corp": "corp", "corporation": "corp", "co": "co", "sarl": "sarl", "srl": "srl", "nv": "nv", "ab": "ab", "oy": "oy", "mbh": "gmbh", "gesellschaft": "gmbh",
}
BUSINESS = {
    "media": [], "technologies": ["technology", "tech", "techs"], "analytics": [], "freight": ["frt"], "services": ["svcs", "serv", "service"], "textiles": ["txt", "textile"],
    "insurance": ["ins"], "financial": ["fin", "finance"], "communications": ["comms", "comm"], "energy": [], "pharmaceuticals": ["pharma", "pharm"], "systems": ["syst", "sys"],
    "consulting": ["cons", "consltg", "consult"], "aviation": ["avn", "av"], "foods": ["food"], "laboratories": ["lab", "labs"], "education": ["edu", "educ"],
    "healthcare": ["hc"], "foundry": ["fdry"], "engineering": ["eng", "engrg", "engg"], "dental": ["dent"], "developments": ["dev", "devs", "development"],
    "solutions": ["sols", "sol"], "hospitality": ["hosp"], "management": ["mgmt", "mgt"], "logistics": ["logist", "log"], "associates": ["assocs", "assoc"],
    "international": ["intl", "int'l", "int"], "manufacturing": ["manuf", "mfg"], "software": ["sw", "softw"], "construction": ["constr"], "robotics": ["robot"],
}
NICKNAMES = {
    "alexander": ["alex", "sandy", "xander"], "antonia": ["toni", "tonia"], "charles": ["charlie", "chas", "chuck"], "edward": ["ed", "eddie", "ned"],
    "elizabeth": ["liz", "beth", "betty", "eliza", "lizzie"], "francisco": ["paco", "pancho", "fran"], "johannes": ["hans", "jo", "johan"],
    "katherine": ["kate", "kathy", "katie", "kat"], "margaret": ["maggie", "peggy", "meg", "marge"], "michael": ["mike", "mick", "mickey"], "richard": ["dick", "rick", "rich"],
    "robert": ["rob", "bob", "bobby", "robbie"], "theodore": ["theo", "teddy"], "william": ["will", "bill", "wm", "billy", "liam"], "james": ["jim", "jimmy"],
    "john": ["jack", "johnny"], "thomas": ["tom", "tommy"], "joseph": ["joe", "joey"], "andrew": ["andy", "drew"], "anthony": ["tony"], "daniel": ["dan", "danny"],
}
NOTES = re.compile(r"^\s*(?:careers at|jobs at|working at|the)\s+|\s*\([^)]*\)|\s*\|.*$|\s+-\s+(?:hr|human resources|people|recruiting)\b.*$|,\s*(?:berlin|london|paris|madrid|new york|munich)\b\s*$|\s+(?:uk|usa|de|group)\s*$", re.I)
SHORT = {s: full for full, forms in BUSINESS.items() for s in [full, *forms]}
EITHER = {"ted": ("edward", "theodore"), "al": ("albert", "alexander")}  # nicknames of two names
FIRST = {k: k for k in EITHER} | {s: full for full, forms in NICKNAMES.items() for s in [full, *forms]}


def fold(text: str) -> str:
    t = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    return t.replace("ß", "ss").replace("ø", "o").replace("ł", "l")


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_ratio(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _closest(token: str, words: dict[str, str], least: int, ratio: float) -> str | None:
    """The word a token is a typing slip of, among those of at least so many letters."""
    if len(token) < least - 1:
        return None
    best = max(((lcs_ratio(token, w), w) for w in words if len(w) >= least and abs(len(w) - len(token)) <= 2 and (w[0] == token[0] or w[-3:] == token[-3:])), default=(0.0, ""))
    return words[best[1]] if best[0] >= ratio else None


def read_name(raw: str | None) -> tuple[str, list[str], str, str] | None:
    """(first name or initial, surnames in order of the alphabet, line of business, legal form); None if it names nobody."""
    if raw is None or not raw.strip() or raw.strip().lower() in NOBODY:
        return None
    text = raw.strip()
    for _ in range(3):
        text = NOTES.sub("", text).strip()
    text = re.sub(r"health\s+care", "Healthcare", text, flags=re.I)
    text = re.sub(r"\b((?:[A-Za-z]\.)+[A-Za-z])\b\.?", lambda m: m[1].replace(".", ""), text)  # P.L.C.
    text = re.sub(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ])", " ", text)
    tokens = [fold(t).strip(".'") for t in re.split(r"[\s&+/,\-–]+", text)]
    tokens = [t for t in tokens if t and t not in ("and", "und", "et", "y")]
    while tokens and tokens[-1] in ("uk", "usa", "jobs", "careers"):
        tokens.pop()
    legal = "+".join(dict.fromkeys(LEGAL[t] for t in tokens if t in LEGAL))
    rest = [t for t in tokens if t not in LEGAL] or tokens
    business = ""
    for at in (len(rest) - 1, 0):
        if len(rest) > 1:
            full = SHORT.get(rest[at]) or _closest(rest[at], {k: v for k, v in SHORT.items() if len(k) > 4}, 5, 0.84)
            if full:
                business = full
                rest = rest[:at] + rest[at + 1:]
                break
    first = ""
    if len(rest) > 2 and (len(rest[0]) == 1 or rest[0] in FIRST or _closest(rest[0], FIRST, 6, 0.85)):
        first = rest[0] if len(rest[0]) == 1 else FIRST.get(rest[0]) or _closest(rest[0], FIRST, 6, 0.85) or ""
        rest = rest[1:]
    return first, sorted(rest), business, legal


def same_names(a: list[str], b: list[str], whole: float = 0.84, part: float = 0.7) -> float:
    """Ratio of two lists of surnames if they can mean the same, else 0: token by token, or as whole strings in any order."""
    if len(a) == len(b) == 2:
        best = 0.0
        for x, y in ((b[0], b[1]), (b[1], b[0])):
            p, q = lcs_ratio(a[0], x), lcs_ratio(a[1], y)
            if min(p, q) >= part:
                best = max(best, 2 * (lcs_length(a[0], x) + lcs_length(a[1], y)) / (len(a[0]) + len(a[1]) + len(x) + len(y)))
        return best if best >= whole else 0.0
    best = max(lcs_ratio("".join(p), "".join(q)) for p in (a, a[::-1]) for q in (b, b[::-1]))
    return best if best >= whole + 0.02 else 0.0


CLASS = "class_id bigint, first string, names array<string>, business string, legal string"


def read_names(values: DataFrame) -> DataFrame:
    """(name, class columns) of the distinct names in the column name; names of nobody are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(n, *r) for n in pdf.name if (r := read_name(n)) is not None]
            yield pd.DataFrame(rows, columns=["name", "first", "names", "business", "legal"])

    parsed = values.select("name").where(F.col("name").rlike(r"\S")).distinct().mapInPandas(read, "name string, first string, names array<string>, business string, legal string")
    # the legal form tells classes apart only where no line of business does
    key = F.xxhash64("first", F.concat_ws(" ", "names"), "business", F.when(F.col("business") == "", F.col("legal")).otherwise(""))
    return parsed.withColumn("class_id", key)


def short_keys(tokens: list[str]) -> list[str]:
    """The joined surnames in both orders with as many letters left out as the ratio of the longest common subsequence
    allows; at most two of more than 12 letters."""
    keys = set()
    for text in {"".join(tokens), "".join(tokens[::-1])}:
        some, n = {text}, len(text)
        for d in range(1, n):
            keys |= some
            if 2 * (n - d) < 0.84 * (2 * n - d) or n > 12 and d > 2:
                break
            some = {t[:i] + t[i + 1:] for t in some for i in range(len(t))}
        keys |= {text}
    return [f"={k}" for k in sorted(keys)]


def block_keys(classes: DataFrame, min_suffix: int = 5, common: int = 50) -> DataFrame:
    """(class_id, key): token suffixes; those shared by more than `common` classes refined with the other surname."""
    suffixes = F.transform(
        F.filter("names", lambda t: F.length(t) >= min_suffix),
        lambda t: F.struct(t.alias("token"), F.array_distinct(F.array(F.right(t, F.lit(min_suffix)), F.right(t, F.lit(min_suffix + 2)), F.right(t, F.lit(10)))).alias("ends")),
    )
    each = classes.select("class_id", "names", F.explode(suffixes).alias("s")).select("class_id", "names", F.col("s.token").alias("token"), F.explode("s.ends").alias("suffix"))
    shared = each.groupBy("suffix").agg(F.count("*").alias("n"))
    others = F.when(F.size("names") == 1, F.array("token")).otherwise(F.filter("names", lambda t: t != F.col("token")))
    refined = F.flatten(F.transform(others, lambda o: F.array(F.concat(F.lit("<"), F.left(o, F.lit(3))), F.concat(F.lit(">"), F.right(o, F.lit(3))))))
    keyed = each.join(shared, "suffix").withColumn("more", F.when((F.col("n") > common) & (F.size(others) > 0), refined).otherwise(F.array(F.lit(""))))
    # short surnames, also those a letter longer than a short one: joined, with letters left out
    short = classes.where(~F.exists("names", lambda t: F.length(t) > min_suffix)).select("class_id", F.explode(F.udf(short_keys, "array<string>")("names")).alias("key"))
    long = keyed.select("class_id", "suffix", F.explode("more").alias("other")).select("class_id", F.concat("suffix", "other").alias("key"))
    return long.union(short).distinct()


def link_classes(classes: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b, weak, same_legal, ratio): pairs of classes that can mean the same; weak if only one states its business."""
    side = lambda p: keys.select("key", F.col("class_id").alias(p))
    pairs = side("a").join(side("b"), "key").where("a < b").select("a", "b").distinct()
    cols = lambda p: classes.select(F.col("class_id").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in ("first", "names", "business", "legal")))
    both = pairs.join(cols("a"), "a").join(cols("b"), "b")
    both = both.where("a_business = b_business or a_business = '' or b_business = ''")
    same_first = F.expr("left(a_first, 1) = left(b_first, 1) and (a_first = b_first or length(a_first) = 1 or length(b_first) = 1)")
    for nick, names in EITHER.items():
        for x, y in (("a_first", "b_first"), ("b_first", "a_first")):
            same_first = same_first | ((F.col(x) == nick) & F.col(y).isin(*names))
    both = both.where(same_first)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ratio = [same_names(list(x), list(y)) for x, y in zip(pdf.a_names, pdf.b_names, strict=True)]
            out = pdf.assign(ratio=ratio, weak=(pdf.a_business != pdf.b_business), same_legal=(pdf.a_legal == pdf.b_legal) & (pdf.a_legal != ""))
            yield out.loc[out.ratio > 0, ["a", "b", "weak", "same_legal", "ratio"]]

    return both.mapInPandas(compare, "a bigint, b bigint, weak boolean, same_legal boolean, ratio double")


def entities(values: DataFrame, min_suffix: int = 5, common: int = 50) -> DataFrame:
    """(name, entity) of every distinct name that names somebody; names of one entity share its number."""
    named = written(read_names(values), "names")
    classes = named.groupBy("class_id").agg(*(F.first(c).alias(c) for c in ("first", "names", "business")), F.max("legal").alias("legal"))
    edges = written(link_classes(classes, block_keys(classes, min_suffix, common)), "links")
    stated = classes.select(F.col("class_id").alias("s"), F.col("business").alias("s_business"))
    strong = edges.where("not weak")
    by_business = strong.join(stated, F.col("a") == F.col("s")).where("s_business <> ''").select("a", "b")
    labels = connected_components(by_business)
    labelled = classes.join(labels, F.col("class_id") == F.col("node"), "left").select("class_id", "business", F.coalesce("component", "class_id").alias("entity"))
    labelled = written(labelled, "entities")
    # a class without business joins the entity that fits best, if that is one
    full = labelled.where("business <> ''").select(F.col("class_id").alias("full"), "entity")
    bare = labelled.where("business = ''").select(F.col("class_id").alias("bare"))
    either = edges.where("weak").select(F.explode(F.array(F.struct(F.col("a").alias("bare"), F.col("b").alias("full")), F.struct(F.col("b").alias("bare"), F.col("a").alias("full")))).alias("e"), "same_legal", "ratio").select("e.*", "same_legal", "ratio")
    fits = either.join(full, "full").join(bare, "bare", "left_semi").groupBy("bare", "entity").agg(F.max(F.struct("ratio", "same_legal")).alias("fit"), F.max("same_legal").alias("legal_fit"))
    w = Window.partitionBy("bare")
    ranked = fits.withColumn("best", F.max("fit.ratio").over(w)).where("fit.ratio >= best - 0.02").withColumn("n", F.count("*").over(w)).withColumn("n_legal", F.sum(F.col("legal_fit").cast("int")).over(w))
    joined = ranked.where("n = 1 or (n_legal = 1 and legal_fit)").select(F.col("bare").alias("class_id"), F.col("entity").alias("joined"))
    # classes without business that fit none are linked among themselves
    alone = strong.join(bare, F.col("a") == F.col("bare"), "left_semi").join(joined, F.col("a") == F.col("class_id"), "left_anti").join(joined.withColumnRenamed("class_id", "j"), F.col("b") == F.col("j"), "left_anti").select("a", "b")
    loose = connected_components(alone).select(F.col("node").alias("class_id"), F.col("component").alias("loose"))
    final = labelled.join(joined, "class_id", "left").join(loose, "class_id", "left").select("class_id", F.coalesce("joined", "loose", "entity").alias("entity"))
    return named.select("name", "class_id").join(final, "class_id").select("name", "entity")


def name_pairs(values: DataFrame, min_suffix: int = 5, common: int = 50) -> DataFrame:
    """(name_a, name_b): pairs of distinct names of one entity, the smaller first by code point."""
    who = written(entities(values, min_suffix, common), "who")
    a, b = who.select("entity", F.col("name").alias("name_a")), who.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
