"""Records that hold template residue, filler, error pages or demands for scripts instead of content.

Placeholder detectors find an unfilled placeholder anywhere. Everything else is weighed by evidence, in bits. A title or body is a
candidate if no word of the record's address (its slug) occurs in it and it says little: at most `few_words` distinct words. For it
speak
- how rarely such a mismatch happens on its host (the negative logarithm of the share of the host's titles or bodies),
- how many addresses got the same response, on this host and over all hosts, and on how many hosts (logarithms of counts),
- that title and body share no word of four letters or more; that they do speaks against it,
- filler and error wording;
against it speaks that texts of the same words match their addresses elsewhere. The response is left out if the sum reaches
`least_bits`. Responses are the same if their words are, numbers masked, in any order and number.

Where the address has no words, or has some of the text's, there is no mismatch to weigh, and filler or error wording decides, unless
all words of the address occur in the body.

Placeholders that are the subject of the work stay: control words of template languages, gender marks such as {f/m/x},
and names other than a posting's fields next to words about templating.

Defined results: null and blank texts are no case; texts are read whole; repeated rows are judged alike; a null address
gives no mismatch evidence, the detectors still apply; one row per field at most.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.session import written

# Fields of a posting that templates fill in.
FIELDS = r"(?:company|employer|organi[sz]ation|job|position|role|location|city|place|salary|pay|start|end|team|department|recruiter|hiring|contact|email|e-mail|phone|benefits?|candidate|client|title|name|first|last|date|amount|url|link|address|description|text|manager|country|currency|rate)"
NAME = rf"(?:{FIELDS}(?:[ _.\-]?(?:{FIELDS}|min|max|from|to|name|id|here))*)"
PLACEHOLDER = re.compile(
    "|".join([
        r"\{\{[{]?\s*(?P<a>[\w.\- ]+?)\s*\}\}", r"[$#]\{\s*(?P<b>[\w.\- ]+?)\s*\}", rf"(?<![{{$#%])\{{\s*(?P<c>{NAME})\s*\}}", r"\[\[\s*(?P<d>[\w.\- ]+?)\s*\]\]",
        r"(?<!\[)\[\s*(?:insert|your|enter|add)\s+(?P<e>[\w.\- ]+?)(?:\s+here)?\s*\]", rf"(?<!\[)\[\s*(?P<f>{NAME}|tbd|tba|tbc)\s*\]", r"<\s*(?:insert|your|enter|add)\s+(?P<g>[\w.\- ]+?)(?:\s+here)?\s*>",
        r"<%=?\s*(?P<h>[\w.\- @]+?)\s*%>", rf"<\s*(?P<i>{NAME})\s*>", rf"%(?P<j>{NAME})%", rf"~~(?P<k>{NAME})~~", rf"__(?P<l>{NAME})__", rf"@@(?P<m>{NAME})@@", r"\*\|(?P<n>[\w.\- ]+?)\|\*",
        r"(?<![\w])x{1,3}[,.]x{3}(?![\w])", r"[$€£]\s?x{2,}k?\b", r"(?<![\w#])#{3,}(?![\w#])", r"_{4,}",
    ]), re.I)
MARKS = re.compile(r"\{|\[|<|%|~~|__|@@|\*\||##|[xX][,.xX]")  # a placeholder has one of them
CONTROL = re.compile(r"(?:#|/)?(?:each|else|if|unless|end|endif|endfor|for|with|include|block|raw|partial)\b", re.I)
FIELD_ONLY = re.compile(rf"^{NAME}$", re.I)
ABOUT_TEMPLATES = re.compile(r"handlebars|jinja|mustache|velocity|freemarker|liquid|thymeleaf|templat|double braces|escaped|mail merge|merge tag|greet people", re.I)

# Wording of error pages, demands for scripts, and filler.
ERRORS = re.compile(
    r"something went wrong|(?:turn on|enable|activate|aktivieren sie|activa|activez|doit être activé).{0,20}javascript|javascript.{0,40}(?:doit être activé|aktivieren|to run this app|is (?:required|disabled))"
    r"|verify (?:that )?you are (?:a )?human|are you a robot|(?:erreur|error|fehler|código) ?\d{3}|une erreur interne|down for maintenance|access denied|permission to view|internal server error|trace id"
    r"|page not found|not found|seite nicht gefunden|página no encontrada|page introuvable|too many requests|site (?:cannot|can't) be reached|timed out|render failed|uncaught \w*error|cannot read propert"
    r"|bad gateway|gateway timeout|service (?:is not available|unavailable)|session has expired|sqlstate|connection refused|checking your browser|request blocked|application firewall|untitled|\[object object\]|just a moment|attention required"
    r"|^(?:error|null|undefined|none|nan|n/a|oops)$", re.I,
)
FILLERS = re.compile(
    r"lorem ipsum|sample text|beispieltext|texte d'exemple|texto de ejemplo|text text text|blah blah|asdf|qwert|test posting|please ignore|job (?:title|description) goes here|replace before publishing"
    r"|copy from old advert|do not publish|sample job|title title title", re.I,
)
OPENING = re.compile(r"^(?:x{3,}|test|tbd|tba|todo|title|foo|bar|dummy)(?:\W|$)", re.I)  # also the start of titles such as "Test Engineer"
FILLER_WORDS = set("test blah asdf jkl xx xxx xxxx xxxxx text sample beispieltext replace before publishing job description goes here title tbd copy from old advert foo bar dummy todo placeholder ignore please posting".split())
LATIN = tuple("lorem ipsum dolor amet tamet conse adipi elit elitr sed sedo eius tempo incid labor magna aliqu enim minim veni nisi nisia quis quisn nostr exerc ullam commo conseq velan duis aute irure repre volup velit esse cill fugia nulla paria excep sint occae cupid proid culpa offic deser molli anim".split())
COMMON = set("the and of to in a for with you we is are our der die das und mit für wir sie le la les des et pour vous nous el los las de y para con una un".split())
WORD = re.compile(r"[^\W_]+")


def placeholders(text: str) -> list[str]:
    """Unfilled placeholders of a text, without those that are its subject."""
    out = []
    for m in PLACEHOLDER.finditer(text):
        name = next((g for g in m.groups() if g is not None), None)
        if name is not None and not FIELD_ONLY.match(name.strip(" @")):
            around = text[max(0, m.start() - 80): m.end() + 80]
            if CONTROL.match(name) or ABOUT_TEMPLATES.search(around) or "/" in name:
                continue
        elif name is not None and re.fullmatch(r"first name|last name|name|text|title|link|url", name, re.I) and ABOUT_TEMPLATES.search(text[max(0, m.start() - 60): m.end() + 40]):
            continue
        out.append(m.group())
    return out


def filler_share(words: list[str]) -> float:
    """Share of the words that are filler: known ones, pseudo-Latin ones, and immediate repetitions."""
    if not words:
        return 0.0
    n = sum(w in FILLER_WORDS or w.startswith(LATIN) or (i > 0 and words[i - 1] == w) for i, w in enumerate(words))
    return n / len(words)


def mostly_filler(words: list[str], title: bool) -> bool:
    """Whether the words of a whole text are mostly filler."""
    if len(words) <= 3:
        return False
    share = filler_share(words)
    return share >= 0.8 or not title and len(words) > 8 and share >= 0.5 and sum(w in COMMON for w in words) <= 0.04 * len(words)


def is_message(text: str, title: bool, opening: bool = True, words: list[str] | None = None) -> bool:
    """Whether a text consists of filler, an error message or a demand to enable scripts. opening: a first word of filler is enough.
    words: those of the text, if they are known."""
    t = text.strip()
    words = WORD.findall(t.lower()) if words is None else words
    if len(words) <= (8 if title else 45) and (ERRORS.search(t) or FILLERS.search(t) or OPENING.search(t) and (opening or all(w in FILLER_WORDS or w.isdigit() or set(w) == {"x"} for w in words))):
        return True
    return mostly_filler(words, title)


def slug_words(url: str | None) -> set[str]:
    """Words of the last part of an address, without numbers."""
    last = re.sub(r"[?#].*$", "", url or "").rstrip("/").rsplit("/", 1)[-1]
    return {w for w in re.split(r"[^a-z]+", last.lower()) if len(w) > 1}


def form(words: set[str]) -> str:
    """What a response says: its distinct words in order, those with digits masked."""
    return " ".join(sorted({"9" if any(c.isdigit() for c in w) else w for w in words}))


COLUMNS = "id string, src_field string, verdict int, form string, host string, address string, alone boolean, wording boolean, n bigint"
SURE, CANDIDATE, CONTENT, TOTAL = 2, 1, 0, 3


def _judge(batches: Iterator[pd.DataFrame], few_words: int) -> Iterator[pd.DataFrame]:
    """Rows of COLUMNS. SURE: by the detectors; CANDIDATE: a mismatched text that says little; CONTENT: how many texts (n) of a form
    match their address; TOTAL: how many texts (n) of a field a host has. The last two are counted here, within a batch."""
    for pdf in batches:
        rows, content, total = [], Counter(), Counter()
        for i, title, body, url, host in zip(pdf.id, pdf.title, pdf.description, pdf.source_url, pdf.source_site, strict=True):
            slug = slug_words(url)
            at = host if isinstance(host, str) and host.strip() else re.sub(r"^\w+://", "", url or "").split("/", 1)[0]
            for field, text, other in (("title", title, body), ("description", body, title)):
                if not isinstance(text, str) or not text.strip():
                    continue
                total[at, field] += 1
                if MARKS.search(text) and placeholders(text):
                    rows.append((i, field, SURE, None, None, None, None, None, 1))
                    continue
                words = WORD.findall(text.lower())
                found = set(words)
                matches = bool(slug & found)
                few = len(found) <= few_words
                if slug and few and not matches:
                    shared = isinstance(other, str) and any(len(w) > 3 for w in found.intersection(WORD.findall(other.lower())))
                    rows.append((i, field, CANDIDATE, form(found), at, url, not shared, is_message(text, field == "title", words=words), 1))
                    continue
                # the address weighs: it excuses error wording in a body that has all its words, and a title's first word unless it contradicts it
                excused = field == "description" and slug and slug <= found
                if mostly_filler(words, False) if excused else is_message(text, field == "title", opening=field != "title" or bool(slug) and not matches, words=words):
                    rows.append((i, field, SURE, None, None, None, None, None, 1))
                elif slug and few:
                    content[form(found), field] += 1
        rows += [(None, field, CONTENT, f, None, None, None, None, n) for (f, field), n in content.items()]
        rows += [(None, field, TOTAL, None, at, None, None, None, n) for (at, field), n in total.items()]
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"verdict": "int32", "n": "int64"})


def bits(count: Column) -> Column:
    return F.log2(1.0 + count)


def residue(jobs: DataFrame, least_bits: float = 6.0, few_words: int = 25) -> DataFrame:
    """(id, src_field) of the fields to leave out.

    Only candidates, and counts made within each batch, are shuffled: a response served for a third of all addresses is one row
    a host and address before it is counted, and one row a host after.
    """
    judged = jobs.select("id", "title", "description", "source_url", "source_site").mapInPandas(lambda x: _judge(x, few_words), COLUMNS)
    keyed = written(judged.withColumns({"form": F.xxhash64("src_field", "form"), "address": F.xxhash64("address")}), "residue")  # read five times
    odd = keyed.where(F.col("verdict") == CANDIDATE)
    at_host = odd.groupBy("form", "host", "address").agg(F.lit(1).alias("one")).groupBy("form", "host").agg(F.count("*").alias("here"))
    content = keyed.where(F.col("verdict") == CONTENT).groupBy("form").agg(F.sum("n").alias("content"))
    overall = at_host.groupBy("form").agg(F.sum("here").alias("everywhere"), F.count("*").alias("hosts")).join(content, "form", "left")
    totals = keyed.where(F.col("verdict") == TOTAL).groupBy("host", "src_field").agg(F.sum("n").alias("texts"))
    rate = odd.groupBy("host", "src_field").agg(F.count("*").alias("odd")).join(totals, ["host", "src_field"])
    rate = rate.select("host", "src_field", (-F.log2((F.col("odd") + 1) / (F.col("texts") + 2))).alias("rare"))
    served = bits(F.col("everywhere")) + bits(F.col("here")) + bits(F.col("hosts")) - 2 * bits(F.coalesce("content", F.lit(0)))
    forms = at_host.join(overall, "form").select("form", "host", served.alias("served"))
    own = F.when(F.col("alone"), 1.0).otherwise(-4.0) + F.when(F.col("wording"), 4.0).otherwise(0.0)
    weighed = odd.join(forms, ["form", "host"]).join(rate, ["host", "src_field"]).where(F.col("served") + F.col("rare") + own >= least_bits)
    return keyed.where(F.col("verdict") == SURE).select("id", "src_field").unionByName(weighed.select("id", "src_field"))
