"""The main body of pages without the furniture around and inside it.

Every word, pair of words and structural mark of a line (separators, gaps, missing end of sentence ...: what tags leave
behind in text) has a weight, the log odds of standing in the body. A line scores the sum of its weights; a linear scan
finds the maximum-scoring subsequences of lines. Lines outside all of them are furniture: a line of the body with a
poor score is kept by the region around it, a lone line of furniture with a fair score makes no region.

The weights are learned from labelled pages, and no list of phrases is used. Texts of one line come from feeds and
hold nothing but a body. In a bounded sample of pages a line whose pairs of words the sampled bodies hold is labelled as
body; one whose pairs they lack, or with a word that pages use often and bodies never, as furniture. Pages in languages
that no feed has give no labels at first: the first weights find their regions by structure, and the regions are
the labels of the next round.

Defined results: null, blank or one-line texts have no furniture; blank lines are counted, never returned; repeated
lines are judged alike; lines of any length are read whole; without any one-line text nothing can be learned, and
nothing is furniture.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.tables import hash_sample

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
SEPARATORS = ("|", "·", "›", "»", "/", ">", "  ", " – ", " - ", ",", " at ")


def tokens(text: str) -> list[str]:
    """Words, numbers (all alike) and single signs of a text in lower case."""
    return ["9" if t.isdigit() else t for t in TOKEN.findall(text.lower())]


def features(line: str) -> set[str]:
    """Words, pairs of words and structural marks of a line."""
    t = line.strip()
    ws = tokens(t)
    out = set(ws)
    out.update(f"{a} {b}" for a, b in zip(["^", *ws], [*ws, "$"], strict=True))
    out.add(f"#n{min(len(ws), 24) // 3}")
    out.add("#end" + (t[-1] if t and t[-1] in ".!?:" else "-"))
    out.update(f"#{s}{min(n, 3)}" for s in SEPARATORS if (n := t.count(s)))
    spaced = t.split()
    out.add(f"#caps{4 * sum(w[:1].isupper() for w in spaced) // max(1, len(spaced))}")
    out.add(f"#low{min(sum(w.islower() for w in spaced), 6)}")
    return out


def page_lines(text: str) -> list[str]:
    """The lines of a page that aren't blank."""
    return [x.strip() for x in text.split("\n") if x.strip()]


class BodyWords:
    """Words and pairs of words that texts without furniture hold."""

    def __init__(self, bodies: list[str]) -> None:
        self.texts, self.words, self.pairs = len(bodies), Counter(), set()
        for body in bodies:
            ws = tokens(body)
            self.words.update(set(ws))
            self.pairs.update(zip(ws, ws[1:], strict=False))

    def coverage(self, lines: list[str]) -> list[float | None]:
        """The share of each line's pairs that bodies hold; a single word is judged by the pairs across the line breaks."""
        read, out = [tokens(x) for x in lines], []
        for i, ws in enumerate(read):
            pairs = list(zip(ws, ws[1:], strict=False))
            if pairs:
                out.append(sum(p in self.pairs for p in pairs) / len(pairs))
                continue
            near = [(read[i - 1][-1], ws[0])] if ws and i and read[i - 1] else []
            near += [(ws[0], read[i + 1][0])] if ws and i + 1 < len(read) and read[i + 1] else []
            out.append(1.0 if any(p in self.pairs for p in near) else None)
        return out

    def speaks(self, coverage: list[float | None]) -> bool:
        """Whether a page is of a language that the bodies are in: much of it is covered."""
        known = [c for c in coverage if c is not None]
        return sum(c >= 0.8 for c in known) >= max(3, 0.3 * len(known))


def labelled_lines(pages: list[list[str]], bodies: BodyWords, least: int = 5) -> tuple[list[list[bool | None]], set[str]]:
    """(a label for each line of each page: True in the body, False furniture, None unknown; words that only pages use)."""
    covered = [bodies.coverage(p) for p in pages]
    spoken = [bodies.speaks(c) for c in covered]
    seen = Counter(w for p, yes in zip(pages, spoken, strict=True) if yes for w in {w for x in p for w in tokens(x)})
    ratio = bodies.texts / max(1, sum(spoken))  # so often would the word be expected in the bodies
    foreign = {w for w, n in seen.items() if not bodies.words[w] and n * ratio >= least}
    out = []
    for page, cover, yes in zip(pages, covered, spoken, strict=True):
        labels: list[bool | None] = []
        for line, c in zip(page, cover, strict=True):
            odd = not foreign.isdisjoint(tokens(line))
            labels.append(None if not yes else False if odd else None if c is None else True if c >= 0.8 else False if c <= 0.3 else None)
        out.append(labels)
    return out, foreign


class LineModel:
    """Weights of features by logistic regression; features seen fewer than min_seen times are left out."""

    def __init__(self, rows: list[set[str]], inside: list[bool], min_seen: int, penalty: float = 3.0, steps: int = 60) -> None:
        seen = Counter(f for r in rows for f in r)
        place = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= min_seen))}
        at = [[place[f] for f in r if f in place] for r in rows]
        flat = np.array([i for a in at for i in a], dtype=np.int64)
        row = np.repeat(np.arange(len(rows)), [len(a) for a in at])
        w, bias, y = np.zeros(len(place)), 0.0, np.array(inside, dtype=float)
        first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):  # Adam on the whole sample
            z = np.bincount(row, w[flat], minlength=len(rows)) + bias
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            slope = np.append(np.bincount(flat, err[row], minlength=len(w)) + penalty * w, err.sum())
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            step = (0.3 if t < 0.6 * steps else 0.09) * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
            w, bias = w - step[:-1], bias - step[-1]
        self.weights, self.bias = {f: float(w[i]) for f, i in place.items()}, float(bias) if rows else 1.0

    def score(self, line: str) -> float:
        """The log odds of a line standing in the body."""
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(line))


def maximal_regions(scores: list[float], drop: float = 2.0, least: float = 2.0) -> list[tuple[int, int]]:
    """Maximum-scoring subsequences (first, end) that never fall by more than `drop` below their best sum so far, and that
    reach `least`. One scan: a position is read again only if it lies behind a region's end, at most a drop away."""
    found, at, n = [], 0, len(scores)
    while at < n:
        if scores[at] <= 0:
            at += 1
            continue
        first, total, best, end = at, 0.0, 0.0, at
        for i in range(at, n):
            total += scores[i]
            if total > best:
                best, end = total, i + 1
            elif total < best - drop or total <= 0:
                break
        if best >= least:
            found.append((first, end))
        at = end
    return found


def furniture_lines(text: str, model: LineModel, cache: dict | None = None, min_lines: int = 4) -> list[int]:
    """Numbers (from 1) of the lines of a page that are furniture. Texts of fewer lines than min_lines are messages, not pages."""
    cache = {} if cache is None else cache
    at, scores = [], []
    for n, line in enumerate(text.split("\n"), 1):
        key = line.strip()
        if key:
            if key not in cache:
                cache[key] = model.score(key)
            at.append(n)
            scores.append(cache[key])
    if len(at) < min_lines:
        return []
    inside = {i for a, b in maximal_regions(scores) for i in range(a, b)}
    return [n for i, n in enumerate(at) if i not in inside]


def learn(pages: list[str], bodies: list[str], rounds: int = 3, min_lines: int = 4) -> LineModel:
    """A model from pages and from texts without furniture. Each round labels the pages by the regions found so far."""
    kept = [x for x in map(page_lines, pages) if len(x) >= min_lines]
    known = BodyWords(bodies)
    labels, foreign = labelled_lines(kept, known)
    least = max(3, len(kept) // 400)
    read = {x: features(x) for p in kept for x in p}
    pairs = [(read[x], y) for p, ys in zip(kept, labels, strict=True) for x, y in zip(p, ys, strict=True) if y is not None]
    model = LineModel([r for r, _ in pairs], [y for _, y in pairs], least)
    if not pairs:
        return model
    covered = [known.coverage(p) for p in kept]
    for _ in range(rounds):
        rows, inside, cache = [], [], {}
        for page, cover in zip(kept, covered, strict=True):
            for x in page:
                if x not in cache:
                    cache[x] = model.bias + sum(model.weights.get(f, 0.0) for f in read[x])
            # a label needs a stronger region than a result does
            body = {i for a, b in maximal_regions([cache[x] for x in page], least=6.0) for i in range(a, b)}
            for i, (x, c) in enumerate(zip(page, cover, strict=True)):
                rows.append(read[x])
                inside.append(i in body or (c is not None and c >= 0.8 and foreign.isdisjoint(tokens(x))))
        model = LineModel(rows, inside, least)
    return model


def train(pages: DataFrame, text: str = "description", key: str = "id", sample_pages: int = 3000, sample_bodies: int = 3000) -> LineModel:
    """A model from seeded samples of at most so many pages of several lines and texts of one line."""
    several, body = F.instr(F.col(text), "\n") > 0, ~F.contains(F.col(text), F.lit("\n")) & F.rlike(F.col(text), F.lit(r"\S"))
    n = pages.agg(F.count_if(several).alias("pages"), F.count_if(body).alias("bodies")).first()
    some = [t for (t,) in hash_sample(pages.where(several), [text], key, sample_pages, n.pages)]
    return learn(some, [t for (t,) in hash_sample(pages.where(body), [text], key, sample_bodies, n.bodies)])


def page_furniture(pages: DataFrame, text: str = "description", key: str = "id", sample_pages: int = 3000, model: LineModel | None = None) -> DataFrame:
    """(key, line_no) of every line that is not main content. Only pages of several lines leave the JVM; no shuffle."""
    model = model or train(pages, text, key, sample_pages)
    kind = dict(pages.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for pdf in batches:
            keys, numbers = [], []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                for n in furniture_lines(t, model, cache):
                    keys.append(k)
                    numbers.append(n)
            if len(cache) > 300_000:
                cache.clear()
            yield pd.DataFrame({key: pd.Series(keys, dtype=object), "line_no": pd.Series(numbers, dtype="int32")})

    several = pages.where(F.instr(F.col(text), "\n") > 0).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return several.mapInPandas(scan, f"{key} {kind}, line_no int")
