"""The operators on small tables: cases, nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import boilerplate, canonical, encoding, leakage, mixing, names, neighbours, residue
from jobloom.llm.queries import queries
from jobloom.tables import table

# -- canonical values ------------------------------------------------------------------------------------------------
SKILLS = [(1, "Kubernetes", []), (2, "C#", []), (3, "C", ["ANSI C"]), (4, "JavaScript", ["JS"]), (5, "Java", []), (6, "HubSpot", [])]
PLACES = [(10, "Cambridge", "United Kingdom", "UK", []), (11, "Cambridge", "United States", "US", []), (12, "Munich", "Germany", "DE", ["München"]), (13, "Singapore", "Singapore", "SG", []), (14, "New York City", "United States", "US", ["NYC"])]


def lists(spark):
    return spark.createDataFrame(SKILLS, "skill_id int, skill_name string, also_known_as array<string>"), spark.createDataFrame(PLACES, "place_id int, city string, country string, country_code string, also_known_as array<string>")


def test_canonical(spark):
    typed = ["k8s", " KUBERNETES;", "Kubernets", "c#", "C++", "ansi c", "advanced Java", "Java - expert", "hbuspot", "beekeeping", "", None, "x" * 50_000]
    jobs = spark.createDataFrame([("a", typed, "Cambridge, US", 9), ("b", None, None, 9), ("c", [], "  ", 9), ("d", ["js", "js"], "UK / Cambridge", 9), ("e", None, "central Muenchen", 9), ("f", None, "Remote", 9), ("g", None, "Singapore, SG", 9), ("h", None, "12345 nwe york city", 9)], "id string, skills array<string>, location string, ref_id int")
    got = {(r.id, r.src_field, r.item_pos): r.ref_id for r in canonical.canonical_values(jobs, *lists(spark)).collect()}
    want = [1, 1, 1, 2, 0, 3, 5, 5, 6, 0, None, None, 0]
    assert [got.get(("a", "skills", i)) for i in range(len(typed))] == want
    assert [got.get((k, "location", 0)) for k in "abcdefgh"] == [11, None, None, 10, 12, 0, 13, 14]
    assert got[("d", "skills", 0)] == got[("d", "skills", 1)] == 4
    assert canonical.canonical_values(jobs.limit(0), *lists(spark)).count() == 0
    assert {(r.src_field, r.n) for r in canonical.unmatched_values(jobs.where("id = 'f'"), *lists(spark)).collect()} == {("location", 1)}


def test_symmetric_delete_finds_all_within_two():
    words = ["salesforce", "terraform", "kubernetes", "negotiation"]
    d = canonical.DeleteDictionary([(w, i) for i, w in enumerate(words)])
    rng = np.random.default_rng(1)
    for i, w in enumerate(words):
        for _ in range(60):
            s = list(w)
            for _ in range(rng.integers(1, 3)):
                p = int(rng.integers(1, len(s)))
                s[p : p + 1] = ([], [s[p], "x"], ["q"])[int(rng.integers(3))]
            assert d.lookup("".join(s)) == [i]


# -- names -----------------------------------------------------------------------------------------------------------
FIRMS = ["Kukaner & Posbimere Foundry PLC", "Posbimere & Kukaner Foundry P.L.C.", "KukanerPosbimere Foundry", "Careers at Kukaner + Posbimere Foundry (Head Office)", "Kukaner-Posbmiere Foundry PLC", "KUKANER AND POSBIMERE FOUNDRY PLC", "Kukaner & Posbimere Systems PLC", "Elizabeth Nusgusen-Tibuner Freight SA", "Liz Nusgusen-Tibnuer Freight S.A", "Nusgusen Ruckvumont Manufacturing SA", "Unknown", "Confidential", "", " "]


def test_names(spark):
    df = spark.createDataFrame([(f, 1) for f in [*FIRMS, FIRMS[0], None, "z" * 20_000]], "name string, entity int")
    pairs = {(r.name_a, r.name_b) for r in names.name_pairs(df).collect()}
    foundry = sorted(FIRMS[:6])
    want = {(a, b) for a in foundry for b in foundry if a < b} | {tuple(sorted(FIRMS[7:9]))}
    assert pairs == want
    assert names.name_pairs(df.limit(0)).count() == 0


def test_common_suffixes_are_refined_not_dropped(spark):
    many = [f"Xab{chr(97 + i % 26)}{chr(97 + i // 26)}umere Quolbrin Media" for i in range(120)]
    df = spark.createDataFrame([(m,) for m in [*many, "Zorbelumere Quolbrin Media", "Zorbelumere Quolbrim Media"]], "name string")
    assert ("Zorbelumere Quolbrim Media", "Zorbelumere Quolbrin Media") in {(r.name_a, r.name_b) for r in names.name_pairs(df, common=5).collect()}


def test_short_names_are_compared(spark):
    same = [("Abel & Cole", "Abel & Coel"), ("Nike", "Nikee"), ("Hahn Wolf", "Wolf Han")]
    df = spark.createDataFrame([(n,) for n in [*(x for p in same for x in p), "Ford", "Fiat", "HP", "HB"]], "name string")
    assert {(r.name_a, r.name_b) for r in names.name_pairs(df).collect()} == {tuple(sorted(p)) for p in same}


def test_lcs():
    assert names.lcs_length("nematode knowledge", "empty bottle") == 7 and names.lcs_ratio("", "") == 1.0 and names.lcs_length("abc", "") == 0


# -- boilerplate -----------------------------------------------------------------------------------------------------
BODY = ["Your tasks:", "* Maintain our cookie consent dialog and its audit trail", "* Design menus, sidebars and footers for lab samples", "We are looking for a Data Engineer to strengthen our team in Oslo."]
PAGE = "\n".join(["Home | Jobs | Companies", "Skip to content", "", *BODY[:2], "Similar jobs", "QA Engineer, Some Firm Ltd, Zagreb", "Create a job alert", *BODY[2:], "© 2025 Norvale. All rights reserved.", "Back to top"])


def test_boilerplate(spark, sf):
    model = boilerplate.train(table(spark, sf.replace("sf0.001", "sf0.01"), "jobs"))
    df = spark.createDataFrame([("a", PAGE, 7), ("b", None, 7), ("c", "", 7), ("d", "one line only", 7), ("e", PAGE, 7), ("f", "Error\n502 Bad Gateway\nproxy 1.2", 7), ("g", "\n".join(BODY * 3000), 7)], "id string, description string, line_no int")
    got = {}
    for r in boilerplate.page_furniture(df, model=model).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert got == {"a": {1, 2, 6, 7, 8, 11, 12}, "e": {1, 2, 6, 7, 8, 11, 12}}
    assert boilerplate.page_furniture(df.limit(0)).count() == 0


def test_maximal_regions_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        s = [float(x) for x in rng.integers(-5, 6, 9)]
        best = max((sum(s[a:b]) for a in range(9) for b in range(a + 1, 10)), default=0)
        regions = boilerplate.maximal_regions(s, drop=1e9, least=0.0)
        assert max((sum(s[a:b]) for a, b in regions), default=0) == max(best, 0)
        for a, b in boilerplate.maximal_regions(s, drop=3.0):
            assert sum(s[a:b]) >= 2 and all(sum(s[a:i]) > 0 and sum(s[i:j]) >= -3 for i in range(a + 1, b) for j in range(i + 1, b))
        assert all(b <= c for (_, b), (c, _) in zip(regions, regions[1:], strict=False))


class Weights(boilerplate.LineModel):
    def __init__(self, scores):
        self.scores = scores

    def score(self, line):
        return self.scores[line]


def test_the_region_decides_not_the_line():
    scores = {"menu": -9.0, "lone": 1.0, "body": 7.0, "odd heading": -1.5, "ad": -4.0}
    page = "\n".join(["menu", "lone", "menu", "body", "odd heading", "body", "ad", "body", "menu"])
    assert boilerplate.furniture_lines(page, Weights(scores)) == [1, 2, 3, 7, 9]  # by sign of the line it would be 1, 3, 5, 7, 9


def test_furniture_of_any_wording_is_learned_from_bodies():
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    sentence = lambda: " ".join(words[int(i)] for i in rng.integers(0, 40, 8)) + "."
    chrome = ["Zibble | Frobnik | Quux", "Snargle the grommets", "Plugh now   Xyzzy later", "Blorf ▾"]
    bodies = [" ".join(sentence() for _ in range(6)) for _ in range(400)]
    pages = ["\n".join([chrome[i % 2], *(sentence() for _ in range(5)), chrome[2], chrome[3]]) for i in range(300)]
    model = boilerplate.learn(pages, bodies)
    assert all(boilerplate.furniture_lines(p, model) == [1, 7, 8] for p in pages[:50])
    nothing = boilerplate.learn(pages, [])
    assert boilerplate.furniture_lines(pages[0], nothing) == []


# -- vectors ---------------------------------------------------------------------------------------------------------
def clustered(n, dims, seed=0, clusters=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    return (centres[rng.integers(0, clusters, n)] + 0.35 * rng.standard_normal((n, dims))).astype(np.float32)


def test_vectors_recall_and_blocks(spark):
    v = clustered(600, 48)
    rows = [(f"k{i:04d}", [float(x) for x in v[i]], 1) for i in range(len(v))]
    rows += [rows[5], ("null", None, 1), ("empty", [], 1), ("zero", [0.0] * 48, 1), ("short", [1.0], 1), ("nan", [float("nan")] * 48, 1)]
    df = spark.createDataFrame(rows, "key string, vec array<float>, similarity int")
    want = neighbours.brute_force([r[0] for r in rows[:600]], v)
    for block in (4000, 40):  # one block a cell, then cells split into blocks
        got = {(r.key_a, r.key_b) for r in neighbours.similar_pairs(df, dims=48, cell_rows=100, block_rows=block).collect()}
        assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
    assert neighbours.similar_pairs(df.limit(0), dims=48).count() == 0
    assert neighbours.nearest(df.limit(1), dims=48).count() == 0


def test_copies_and_packing(spark):
    same = [("a", [1.0, 2.0]), ("b", [2.0, 4.0]), ("c", [1.0, -1.0])]
    got = {(r.key, r.other) for r in neighbours.nearest(spark.createDataFrame(same, "key string, vec array<float>"), k=1, dims=2).collect()}
    assert ("a", "b") in got and ("b", "a") in got
    v = np.array([[0.25, -0.5, 0.75], [0.1, 0.2, 1e-7], [3e5, 1.5, 2.0]], dtype=np.float32)
    import pandas as pd

    assert (neighbours.unpack(pd.Series(neighbours.pack(v)), 3).astype(np.float32) == v).all()


def test_estimate_is_within_its_bound():
    v = clustered(300, 384, 4, 1).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v = v.astype(np.float32)
    centre, turn = v.mean(0), neighbours.rotation(384)
    guess, error = neighbours.Codes(v, centre, turn).estimate(v[:50], centre, turn, 3.0)
    assert (np.abs(guess - v[:50] @ v.T) <= error).mean() > 0.97


def test_large_blocks_are_searched_in_parts(monkeypatch):
    """A cell that has grown with the data: the codes compared for a vector don't grow with it, neighbours are still found."""
    rng, compared = np.random.default_rng(5), []
    groups = rng.standard_normal((60, 48))
    v = np.repeat(rng.integers(0, 60, 1500), 4)
    v = groups[v] + 0.9 * np.repeat(rng.standard_normal((1500, 48)), 4, axis=0) + 0.3 * rng.standard_normal((6000, 48))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[10] = v[4321] = v[20]  # equal vectors: the smaller row comes first
    estimate = neighbours.Codes.estimate
    monkeypatch.setattr(neighbours.Codes, "estimate", lambda *a: compared.append((x := estimate(*a))[0].size) or x)
    all_ = np.arange(len(v))
    at, sims = neighbours.search_block(v, all_, all_, v.mean(0).astype(np.float32), neighbours.rotation(48), 3, 1.9, 100, 0.1, 16, 7)
    exact = v @ v.T
    exact[all_, all_] = -9
    want = np.sort(np.partition(-exact, 3, axis=1)[:, :3], axis=1) * -1
    assert (sims >= want - 1e-9).mean() > 0.99 and (at != all_[:, None]).all() and (np.diff(sims, axis=1) <= 0).all()
    assert sum(compared) < 0.3 * len(v) ** 2
    assert at[10, :2].tolist() == [20, 4321] and at[20, :2].tolist() == [10, 4321]
    few, _ = neighbours.search_block(v, all_[:2], all_, v[0].astype(np.float32), neighbours.rotation(48), 3, 1.9, 100, 0.1, 16, 7)
    assert few[0].tolist() == [1, -1, -1] and sorted(few[7].tolist()) == [-1, 0, 1]


# -- residue ---------------------------------------------------------------------------------------------------------
def test_residue(spark):
    url = "https://h.example/jobs/data-engineer-1"
    ok = "We are looking for a Data Engineer to strengthen our team in Oslo. You will work with data."
    cases = [
        ("a", "Senior {{ company_name }}", ok, {"title"}), ("b", "Data Engineer {f/m/x}", ok + " Daily work with Handlebars: {{#each}} and {{else}} blocks.", set()), ("c", "Data Engineer", "Pay: between XX,XXX and XX,XXX a year. " + ok, {"description"}),
        ("d", "Page not found", "Internal Server Error\nTrace id 9a9b", {"title", "description"}), ("e", "Data Engineer", "Lorem ipsum dolor sit amet labore aliqua tempora magnam eius minima dolor ipsum labore", {"description"}), ("f", None, None, set()), ("g", "", " ", set()),
        ("h", "Data Engineer [Remote]", ok + " You teach our editors why ${price} in a Velocity file must be escaped.", set()), ("i", "Data Engineer", ok + " Join [INSERT TEAM] and help us grow. " + "word " * 20_000, {"description"}), ("j", "Data Engineer", "Please turn on JavaScript in your browser and reload the page.", {"description"}),
    ]
    cases += [(f"s{n}", "Kindly hold", ok + f" Team number {chr(97 + n) * 3}.", {"title"}) for n in range(5)]  # the same mismatched title for five addresses
    df = spark.createDataFrame([(i, t, b, None if i == "j" else url if i[0] != "s" else f"https://h.example/jobs/{'abcde'[int(i[1])]}x-role-2", "h.example", 0) for i, t, b, _ in cases], "id string, title string, description string, source_url string, source_site string, verdict int")
    got = {}
    for r in residue.residue(df).collect():
        got.setdefault(r.id, set()).add(r.src_field)
    assert got == {i: w for i, _, _, w in cases if w}
    assert residue.residue(df.limit(0)).count() == 0


JOB = "We are looking for a Data Engineer to strengthen our team in Oslo. You will work with data."


def found_residue(spark, rows):
    """rows: (id, title, description, source_url, source_site)."""
    df = spark.createDataFrame(rows, "id string, title string, description string, source_url string, source_site string")
    return {tuple(r) for r in residue.residue(df).select("id", "src_field").collect()}


@pytest.mark.parametrize("last", [None, "12345", "данные-инженер", "data-engineer-7"])
def test_titles_are_judged_whatever_the_address_says(spark, last):
    url = last and f"https://h.example/jobs/{last}"
    bad = ["Page not found", "Access denied", "asdf", "lorem ipsum", "Test", "xxxxxxx", "test 123", "Sample data engineer job: page not found", "Data engineer - do not publish"]
    good = ["Test Data Engineer", "Bar Manager, data", "Title Examiner for data", "Data Engineer", "Engineer, test data"]
    rows = [(f"{k}{i}", t, JOB, url, "h.example") for k, ts in (("bad", bad), ("good", good)) for i, t in enumerate(ts)]
    assert found_residue(spark, rows) == {(f"bad{i}", "title") for i in range(len(bad))}


def test_long_texts_are_judged_whole(spark):
    url = "https://h.example/jobs/data-engineer-7"
    page = "Internal Server Error " + " ".join(c * 40 for c in "abcdefghijkl")
    bodies = {"filler": JOB * 4 + " lorem ipsum dolor sit amet labore aliqua" * 150, "error": page, "ad": JOB * 5 + " Lorem ipsum dolor." + JOB * 40, "words": "We test data. " * 4 + JOB * 50}
    assert len(page) > 400 and residue.filler_share(residue.WORD.findall(bodies["filler"][:300].lower())) < 0.4
    assert found_residue(spark, [(k, "Data Engineer", b, url, "h.example") for k, b in bodies.items()]) == {("filler", "description"), ("error", "description")}
    served = [(f"s{i}", "Data Engineer", "Kindly hold the line please. " * 30, f"https://h.example/jobs/{c}{c}-role", "h.example") for i, c in enumerate("vwxyz")]
    assert found_residue(spark, served) >= {(f"s{i}", "description") for i in range(5)}


def test_forms_count_per_host_and_against_their_matches(spark):
    body = " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6))
    at = lambda h, page, n: f"https://{h}.example/jobs/{page}-{n}"
    rows = [(f"hot{n}", "Kindly hold", body, at("a", "software-engineer", n), "a.example") for n in range(6)]  # one slug, one host
    rows += [(f"few{n}", "Kindly wait", body, at(h, "software-engineer", n), f"{h}.example") for n, h in enumerate("abcde")]  # one slug, one address a host
    rows += [(f"again{n}", "Stand by", body, at("a", "software-engineer", 1), "a.example") for n in range(6)]  # one address again and again
    rows += [(f"odd{n}", "Backend Developer", body, at("b", f"{c}{c}-role", n), "b.example") for n, c in enumerate("vwxyz")]  # content that is renamed now and then
    rows += [(f"plain{n}", "Backend Developer", body, at("c", "backend-developer", n), "c.example") for n in range(20)]
    want = {(f"{k}{n}", "title") for k, m in (("hot", 6), ("few", 5)) for n in range(m)}
    assert found_residue(spark, rows) == want
    assert found_residue(spark, [(i, t, b, u, None) for i, t, b, u, _ in rows]) == want


def test_host_evidence_decides(spark):
    body = " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6))
    good = [(f"good{h}{n}", "Backend Developer", body + f" q{n}", f"https://{h}.example/jobs/backend-developer-{n}", f"{h}.example") for h in "ab" for n in range(40)]
    # the same responses of unknown wording: on a host where it is rare, and on one whose addresses never say what the page is about
    rare = [("rare", "Kindly hold", body, "https://a.example/jobs/data-engineer-1", "a.example")]
    blind = [(f"blind{n}", f"Tinker {'abcdefghij'[n]}{'abcdefghij'[n]}", body, f"https://c.example/jobs/{'klmnopqrst'[n]}z-{n}", "c.example") for n in range(10)]
    assert found_residue(spark, good + rare + blind) == {("rare", "title")}
    assert found_residue(spark, rare + blind) == set()  # nothing is known of the host
    same = [(i, "Tinker", b, u, h) for i, _, b, u, h in blind]
    assert found_residue(spark, good + same) == {(f"blind{n}", "title") for n in range(10)}  # one response for ten addresses
    shared = [("shared", "Wholly renamed", body + " renamed", "https://a.example/jobs/data-engineer-2", "a.example")]
    assert found_residue(spark, good + shared) == set()  # title and body agree with each other, only the address doesn't


# -- leakage ---------------------------------------------------------------------------------------------------------
def test_leakage(spark, sf):
    items = table(spark, sf, "eval_items")
    first = items.orderBy("item_id").first()
    ws = first.item_text.split()
    other = leakage.words(first.item_text)
    names_ = sorted({w.strip(".,;?") for w in ws if w[0].isupper() and w.strip(".,;?").lower() not in leakage.Templates([r.item_text for r in items.collect()]).common}, key=len, reverse=True)
    changed = first.item_text
    for i, n in enumerate(names_):
        changed = changed.replace(n, f"Zq{'abcdefghijklmnop'[i % 16]}{i}x")
    docs = [(1, "Before. " + " ".join(ws[2:14]).upper() + " after"), (2, " ".join(ws[2:13])), (3, "  ".join(f"“{w}”" for w in ws[:14])), (4, None), (5, ""), (6, "word " * 200_000), (7, changed), (1, "Before. " + " ".join(ws[2:14]).upper() + " after")]
    df = spark.createDataFrame([(a, b, 0) for a, b in docs], "doc_id long, text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in leakage.verbatim_leaks(df, items).collect()}
    assert got == {(1, first.item_id), (3, first.item_id)}
    assert len(other) >= 24 and (7, first.item_id) in {(r.doc_id, r.item_id) for r in leakage.reparameterised_leaks(df, items).collect()}
    assert leakage.verbatim_leaks(df.limit(0), items).count() == 0 and leakage.verbatim_leaks(df, items.limit(0)).count() == 0


def test_single_sentences_with_other_words_are_found(spark):
    texts = [f"The foreman of the {p} mill had bought {n} barrels of {g} before the winter and sold half of them." for p, n, g in (("Ardle", 31, "tallow"), ("Brack", 52, "cider"), ("Corve", 73, "resin"))]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, item_text string")
    assert max(len(leakage.words(t)) for t in texts) < 24
    swapped = "Well. " + texts[0].replace("Ardle", "Zorn").replace("31", "88").replace("tallow", "quince") + " So it was."
    rows = [(1, swapped), (2, swapped.replace("barrels of", "crates with").replace("bought", "stolen")), (3, "A text about nothing of the kind.")]
    found = leakage.reparameterised_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {r.doc_id for r in found.collect()} == {1}
    common = {"a", "b"}
    assert leakage.rebound(["a", "x", "b", "x"], ["a", "y", "b", "y"], 1, 1, 2, common) == (4, 2, 1) and leakage.rebound(["x", "z"], ["y", "y"], 0, 0, 2, common) == (0, 0, 0)


def test_window_hashes_tell_windows_apart():
    rng = np.random.default_rng(3)
    passage = [f"w{i}" for i in range(12)]
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, 300)) + " " + " ".join(passage) for _ in range(40)]
    of, at, by_template, by_words = leakage.Numbers({f"w{i}" for i in range(500)}).hashes(texts, 12)
    read = [t.split() for t in texts]
    distinct = len({tuple(read[i][j : j + 12]) for i, j in zip(of, at, strict=True)})
    assert len(set(by_words)) == len(set(by_template)) == distinct  # equal windows hash alike wherever they lie, others differ
    assert len(set(by_words[at == 300])) == 1


def test_many_tokens_of_marks_only():
    marks = " ".join("".join(x) for x in itertools.product("-*=#~", repeat=5))
    assert len(leakage.Numbers(set()).hashes([f"{' '.join('abcdefghijk')} {marks} l"], 12)[0]) == 1


def test_leakage_against_brute_force(spark, sf):
    items, docs = table(spark, sf, "eval_items").collect(), table(spark, sf, "documents").collect()
    windows = {}
    for r in items:
        w = leakage.words(r.item_text)
        for i in range(len(w) - 11):
            windows.setdefault(tuple(w[i : i + 12]), set()).add(r.item_id)
    want = {(x.doc_id, k) for x in docs for w in [leakage.words(x.text)] for i in range(len(w) - 11) for k in windows.get(tuple(w[i : i + 12]), ())}
    assert {tuple(r) for r in leakage.verbatim_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).collect()} == want


# -- mixing ----------------------------------------------------------------------------------------------------------
def test_knapsack_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        lengths = [(int(n), int(c)) for n, c in zip(rng.choice(np.arange(2, 30), 4, replace=False), rng.integers(1, 5, 4), strict=True)]
        budget = int(rng.integers(1, 120))
        sums = {0}
        for n, c in lengths:
            sums = {s + n * k for s in sums for k in range(c + 1)}
        got = mixing.knapsack(lengths, budget)
        assert sum(n * k for n, k in got.items()) == max(s for s in sums if s <= budget)
        assert all(k <= dict(lengths)[n] for n, k in got.items())


def test_mixture(spark, sf):
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    used = mixing.mixture(docs, targets).collect()
    most = {r.source_name: r.max_repeats for r in targets.collect()}
    got = {}
    for r in used:
        assert 1 <= r.copies <= most[r.source_name]
        got[r.source_name] = got.get(r.source_name, 0) + r.copies * r.n_tokens
    report = {r.source_name: r for r in mixing.shares(docs, targets).collect()}
    assert set(report) == set(most) and all(got.get(k, 0) == r.actual_tokens for k, r in report.items())
    for r in report.values():
        assert r.shortfall_tokens >= 0 and (r.shortfall_tokens < 600 or r.actual_tokens == r.max_repeats * r.available_tokens)
    assert len({r.doc_id for r in used}) == len(used)
    odd = spark.createDataFrame([(1, None, "resumes", 0), (2, "", "resumes", 0), (3, "some words here", None, 0), (4, "some words here", " Board Ads", 0)], "doc_id long, text string, source string, copies int")
    assert [r.doc_id for r in mixing.mixture(odd, targets, total_tokens=100).collect()] == [4]
    assert mixing.mixture(odd.limit(0), targets).count() == 0 and mixing.shares(odd.limit(0), targets).count() == len(most)


# -- encodings -------------------------------------------------------------------------------------------------------
CLEAN = ["Wir grüßen aus Köln – bis später!", "Señor, mañana es fácil. ÁREA DE ATUAÇÃO", "Les tâches évoluent : été à Orléans", "Мы ищем специалиста по данным", "It’s “fine” – €5"]


@pytest.mark.parametrize("chain", [("cp1252",), ("latin-1",), ("mac_roman",), ("cp437",), ("cp1250",), ("cp1251",), ("cp1252", "cp1252")])
def test_round_trip(chain):
    model = encoding.ChainModel(CLEAN)
    for text in CLEAN:
        assert model.restore(encoding.garble(text, chain)) == (text, True)
        assert model.restore(text) is None
        assert model.restore("plain. " + encoding.garble(text, chain) + "\n" + CLEAN[0]) == ("plain. " + text + "\n" + CLEAN[0], True)


@pytest.mark.parametrize("chain", [("cp1252",), ("latin-1",), ("cp1252", "cp1252"), ("mac_roman",)])
def test_emoji_and_other_scripts_are_restored(chain):
    model = encoding.ChainModel(CLEAN)
    for text in ("Join us 😀 now", "Köln 🚀", "Café✨🚀é", "Remote ⌚ ✔️ 👩‍💻", "募集中 エンジニア 東 です", "مطلوب مهندس", "דרוש מהנדס"):
        assert model.restore(encoding.garble(text, chain)) == (text, True)
        assert model.restore(text) is None


def test_the_classifier_decides():
    model, blind = encoding.ChainModel(CLEAN), encoding.ChainModel(CLEAN)
    blind.log = np.zeros_like(blind.log)
    unseen = ["Führungskräfte überprüfen Verträge", "señalización eléctrica básica", "Специалист по продажам", "prêt à évoluer"]
    whole = seen = first = total = 0
    for text in unseen:
        for chain in encoding.CHAINS:
            bad = encoding.garble(text, chain)
            whole += model.restore(bad) == (text, True)
            seen += blind.restore(bad) == (text, True)
            runs = encoding.RUN.findall(bad)
            best = encoding.CHAINS[model.ranked(sum(model.odds(r) for r in runs), max(map(len, runs)))[0]]
            first += "".join(encoding.ungarble(r, best) or r for r in runs) == "".join(encoding.RUN.findall(text))
            total += 1
    assert whole >= 0.95 * total and seen == 0
    assert first >= 0.9 * total  # the likeliest chain alone undoes nearly all


def test_clean_runs_that_look_like_one_wide_character_stay():
    model = encoding.ChainModel(CLEAN)
    for text in ("« Un bel été\u00a0» dit-il", "perché…” disse", "так и там, сам раб рад"):
        assert model.restore(text) is None


def test_restored(spark):
    rows = [(1, encoding.garble(CLEAN[0], ("cp1252",)), 0), (2, CLEAN[0], 0), (3, "K�ln " + encoding.garble("ü", ("cp1252",)), 0), (4, None, 0), (5, "", 0), (6, "ascii", 0), (7, encoding.garble(CLEAN[2], ("mac_roman",)) * 3000, 0), (1, encoding.garble(CLEAN[0], ("cp1252",)), 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored_chars int")
    got = sorted((r.doc_id, r.restored_chars) for r in encoding.restored(df).collect())
    assert got == [(1, len(CLEAN[0])), (1, len(CLEAN[0])), (3, 0), (7, 3000 * len(CLEAN[2]))]
    assert encoding.restored(df.limit(0)).count() == 0


# -- queries ---------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(queries()))
def test_query_runs(spark, sf, name):
    df = queries()[name](spark, sf)
    assert df.count() >= 0 and df.select(F.lit(1)).columns


def test_vectors_recall_on_the_tables(spark, sf):
    from jobloom.llm.queries import vectors

    good = neighbours.usable(vectors(spark, sf), 384).dropDuplicates(["key"]).collect()
    want = neighbours.brute_force([r.key for r in good], np.array([r.vec for r in good], dtype=np.float32))
    got = {tuple(r) for r in queries()["p5_found"](spark, sf).collect()}
    assert len(got & want) / len(want) >= 0.9
