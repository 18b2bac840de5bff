"""Passages of held-out test items inside documents, verbatim or with other names and numbers put in.

Texts become words (case, punctuation, quotes and white space ignored). A word is kept if it belongs to the common
wording of the items, else it is a slot: <n> for numbers, <u> for units, <x> for names and other rare words. All windows of
`width` such template words of the items are hashed. One scan of the documents hashes their template windows, thinned by a
bitmap of the items' hashes; a hash join brings the windows together, and the slots of the joined ones are checked: if the words in
all slots agree, the passage is verbatim; if they map to the item's words one to one, the item was re-parameterised. Windows
of an item with too few kept words say too little as templates: the words themselves are hashed for them, so they are met verbatim only.

The bitmap has 64 bits for each window of an item, at most 2^27 (16 MB); beyond 2 million windows more windows of documents
pass it by chance, and fail at the join.

Defined results: null and empty texts contain nothing; texts shorter than a window contain nothing; items shorter than a
window can't be found; repeated rows are judged alike; a pair is reported once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.session import written
from jobloom.tables import rows_of

# Units of time, money and measure that templates vary.
UNITS = set("second seconds minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros pound pounds crown crowns km kilometres miles kg grams litres".split())
MAX_ITEMS = 100_000  # size bound of the table of items; their texts go to every task of the slot check
MARKS = re.compile(r"[^\w\s]+|_+")
SLOTS = ("<n>", "<u>", "<x>")
BASE = 0x9E3779B97F4A7C15  # odd: has an inverse modulo 2^64
CHUNK = 2_000_000  # characters of documents read at once


def words(text: str) -> list[str]:
    """Words of a text: letters and digits of what stands between white space, in lower case."""
    return MARKS.sub("", text.lower()).split()


def slot(word: str, common: set[str]) -> str:
    return word if word in common else "<n>" if word.isdigit() else "<u>" if word in UNITS else "<x>"


def word_number(word: str) -> int:
    """A 64-bit number of a word, the same in every process."""
    n = 0xCBF29CE484222325
    for b in word.encode("utf-8"):
        n = ((n ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return n


class Numbers:
    """Words of many texts as numbers, those of the words and those of the template; each token is cleaned once."""

    def __init__(self, common: set[str]) -> None:
        self.common, self.known = common, {}
        self.word, self.kept = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _add(self, token: str) -> int:
        clean = MARKS.sub("", token)
        n = len(self.known) + 1 if clean else 0
        self.known[token] = n
        if n:
            while n >= len(self.word):
                self.word, self.kept = (np.concatenate([a, np.zeros_like(a)]) for a in (self.word, self.kept))
            self.word[n], self.kept[n] = word_number(clean), word_number(slot(clean, self.common))
        return n

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, of the word, of the template word) for every word of some texts."""
        if len(self.known) > 500_000:
            self.known.clear()
        split, known = [t.lower().split() for t in texts], self.known
        n = np.array([i if (i := known.get(t)) is not None else self._add(t) for ts in split for t in ts], dtype=np.int64)
        text = np.repeat(np.arange(len(split)), [len(ts) for ts in split])
        full = n > 0
        return text[full], self.word[n[full]], self.kept[n[full]]

    def windows(self, numbers: np.ndarray, width: int, salt: int) -> np.ndarray:
        """Hashes of all windows of width numbers: sums of powers, taken from running totals."""
        n = len(numbers)
        if n < width:
            return np.zeros(0, dtype=np.int64)
        with np.errstate(over="ignore"):
            if len(self.powers) <= n:
                many = 1 << n.bit_length()
                self.powers = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(many, BASE, dtype=np.uint64)]), dtype=np.uint64)
                self.inverses = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(many, pow(BASE, -1, 1 << 64), dtype=np.uint64)]), dtype=np.uint64)
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(numbers * self.powers[:n], dtype=np.uint64)])
            h = (total[width:] - total[:-width]) * self.inverses[: n - width + 1] + np.uint64(salt)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            return (h ^ (h >> np.uint64(29))).view(np.int64)

    def hashes(self, texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the text, place in it, template hash, hash of the words) of every window of some texts."""
        text, word, kept = self.read(texts)
        if len(text) < width:
            return (np.zeros(0, dtype=np.int64),) * 4
        begin = np.searchsorted(text, text, side="left")
        inside = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :])
        by_template, by_words = self.windows(kept, width, 0), self.windows(word, width, 1)
        return text[inside], inside - begin[inside], by_template[inside], by_words[inside]


class Templates:
    """The common wording of items: words of at least a share of them, numbers and units aside."""

    def __init__(self, texts: list[str], share: float = 0.04, least_kept: int = 4) -> None:
        self._of(Counter(w for t in texts for w in set(words(t))), len(texts), share, least_kept)

    def _of(self, seen: dict[str, int], n: int, share: float, least_kept: int) -> None:
        least = max(2, share * n)
        self.common = {w for w, k in seen.items() if k >= least and not w.isdigit() and w not in UNITS}
        self.least_kept = least_kept

    @classmethod
    def of(cls, items: DataFrame, share: float = 0.04, least_kept: int = 4) -> Templates:
        """Counted in Spark; only the common words come back, at most 1 / share of the mean number of words of an item."""

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"word": [w for t in pdf.item_text for w in set(words(t))]}, dtype=object)

        n, out = items.count(), cls.__new__(cls)
        counted = items.select("item_text").mapInPandas(each, "word string").groupBy("word").count().where(F.col("count") >= max(2, share * n))
        out._of({r.word: r["count"] for r in counted.collect()}, n, share, least_kept)
        return out

    def kept(self, ws: list[str]) -> int:
        return sum(w in self.common for w in ws)


def item_windows(items: DataFrame, templates: Templates, width: int) -> DataFrame:
    """(h, w, item_id, item_at): the template hash of every window of the items, or that of its words where it keeps too few."""
    kind = dict(items.dtypes)["item_id"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers(templates.common)
        for pdf in batches:
            texts = pdf.item_text.tolist()
            of, at, by_template, by_words = numbers.hashes(texts, width)
            read = [words(t) for t in texts]
            enough = np.array([templates.kept(read[i][j : j + width]) >= templates.least_kept for i, j in zip(of, at, strict=True)], dtype=bool)
            h = np.where(enough, by_template, by_words)
            yield pd.DataFrame({"h": h, "w": by_words, "item_id": pdf.item_id.to_numpy()[of], "item_at": at.astype("int32")})

    return items.select("item_id", "item_text").mapInPandas(each, f"h bigint, w bigint, item_id {kind}, item_at int")


class Bitmap:
    """Whether a hash may be among known ones."""

    def __init__(self, windows: DataFrame, most: int = 1 << 27) -> None:
        n = windows.count()
        self.size = min(most, 1 << max(16, (64 * n).bit_length()))
        places = windows.select(F.col("h").bitwiseAND(F.lit(self.size - 1)).cast("int").alias("p")).distinct().toPandas()["p"].to_numpy(dtype=np.int64)
        bits = np.zeros(self.size, dtype=bool)
        bits[places] = True
        self.bytes = np.packbits(bits, bitorder="little")

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        p = hashes & (self.size - 1)
        return (self.bytes[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def _scan(docs: DataFrame, templates: Templates, windows: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """(key, text, hits array of (h, w, at)) of documents with a window whose hash the bitmap holds. Nothing is shuffled."""
    bitmap, kind = Bitmap(windows), dict(docs.dtypes)[key]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Numbers(templates.common)
        for pdf in batches:
            texts = pdf["t"].tolist()
            ends = np.cumsum([len(t) for t in texts]) // CHUNK
            for part in np.unique(ends):
                of_part = np.flatnonzero(ends == part)
                some = [texts[i] for i in of_part]
                of, at, by_template, by_words = numbers.hashes(some, width)
                hits: dict[int, list] = {}
                for h in (by_template, by_words):
                    for i in np.flatnonzero(bitmap.holds(h)):
                        hits.setdefault(int(of[i]), []).append({"h": int(h[i]), "w": int(by_words[i]), "at": int(at[i])})
                yield pd.DataFrame({key: pdf["k"].to_numpy()[of_part[np.array(list(hits), dtype=np.int64)]], "text": pd.Series([some[i] for i in hits], dtype=object), "hits": pd.Series(list(hits.values()), dtype=object)})

    found = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return found.mapInPandas(scan, f"{key} {kind}, text string, hits array<struct<h:bigint,w:bigint,at:int>>")


def _tables(items: DataFrame, width: int) -> tuple[DataFrame, Templates, DataFrame]:
    """(items with a text, their templates, their windows), after a check of the number of items."""
    stated = items.select("item_id", "item_text").where("item_text is not null")
    if stated.limit(MAX_ITEMS + 1).count() > MAX_ITEMS:
        raise ValueError(f"the table of items has more than {MAX_ITEMS} rows")
    templates = Templates.of(stated)
    return stated, templates, written(item_windows(stated, templates, width), "item-windows")


def verbatim_leaks(docs: DataFrame, items: DataFrame, width: int = 12, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, item_id) of documents that hold at least `width` consecutive words of the item as they are.

    The slot check is on the hashes of all words of the joined windows: with the template they make 128 bits.
    """
    _, templates, windows = _tables(items, width)
    hits = _scan(docs, templates, windows, width, text, key).select(key, F.explode("hits").alias("x")).select(key, "x.h", "x.w")
    same = hits.join(windows.withColumnRenamed("w", "item_w"), "h").where(F.col("w") == F.col("item_w"))
    return same.select(key, "item_id").distinct()


def rebound(item: list[str], doc: list[str], at: int, there: int, width: int, common: set[str]) -> tuple[int, int, int]:
    """(words, kept words, distinct bound slots) of the longest run around a window whose slots map one to one; at, there: its places."""
    to, back, kept = {}, {}, 0

    def fits(i: int, j: int) -> bool:
        nonlocal kept
        x, y = item[i], doc[j]
        if x in common or y in common:
            kept += x == y
            return x == y
        if slot(x, common) != slot(y, common) or to.get(x, y) != y or back.get(y, x) != x:
            return False
        to[x], back[y] = y, x
        return True

    if not all(fits(at + k, there + k) for k in range(width)):
        return 0, 0, 0
    end = width
    while at + end < len(item) and there + end < len(doc) and fits(at + end, there + end):
        end += 1
    begin = 0
    while at + begin > 0 and there + begin > 0 and fits(at + begin - 1, there + begin - 1):
        begin -= 1
    return end - begin, kept, len(to)


def reparameterised_leaks(docs: DataFrame, items: DataFrame, width: int = 12, text: str = "text", key: str = "doc_id", long: int = 24, least_kept: int = 6, least_slots: int = 2) -> DataFrame:
    """(key, item_id) of documents that hold a window of the item's template with other words put in one to one.

    The run around the window counts: it is enough if it has `long` words, or keeps `least_kept` words of the template and
    binds `least_slots` slots. A document's candidates, one for each item and shift, are gathered in one row: at most
    as many as there are items, times the shifts at which a template repeats.
    """
    stated, templates, windows = _tables(items, width)
    texts = {r.item_id: words(r.item_text) for r in rows_of(stated, MAX_ITEMS, "the table of items")}
    found = written(_scan(docs, templates, windows, width, text, key).withColumn("row", F.xxhash64("text")), "template-hits")
    hits = found.select(key, "row", F.explode("hits").alias("x")).select(key, "row", "x.h", "x.w", "x.at")
    other = hits.join(windows.withColumnRenamed("w", "item_w"), "h").where(F.col("w") != F.col("item_w"))
    shifts = other.groupBy(key, "row", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    gathered = shifts.groupBy(key, "row").agg(F.collect_list(F.struct("item_id", "shift", "first", "last")).alias("candidates"))
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)["item_id"]

    def holds(doc: list[str], item: list[str], shift: int, first: int, last: int) -> bool:
        for there in range(first, last + 1):
            at = there - shift
            if at < 0 or at + width > len(item) or item[at : at + width] == doc[there : there + width]:
                continue
            run, kept, slots = rebound(item, doc, at, there, width, templates.common)
            if run and (run >= long or kept >= least_kept and slots >= least_slots):
                return True
        return False

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for k, t, candidates in zip(pdf[key], pdf["text"], pdf["candidates"], strict=True):
                doc = words(t)
                for c in candidates:
                    if (k, c["item_id"]) not in out and holds(doc, texts[c["item_id"]], c["shift"], c["first"], c["last"]):
                        out.add((k, c["item_id"]))
            yield pd.DataFrame(sorted(out), columns=[key, "item_id"])

    both = found.select(key, "row", "text").join(gathered, [key, "row"])
    return both.select(key, "text", "candidates").mapInPandas(check, f"{key} {kinds[0]}, item_id {kinds[1]}").distinct()
