"""Documents of several sources combined so that each source contributes its share of the tokens.

Tokens are counted with a public tokenizer. Per source, documents are counted by exact token length; the budget is
filled by length count: whole copies of the source first, then an even share of every length, then a bounded knapsack
(subset sums over the counts of lengths that are left) that meets the rest of the budget exactly or comes as near as
can be. Which documents of a length are taken is a matter of their seeded rank, which is found in two steps (counts of
hash ranges, then ranks inside the one range at the border), so no task sorts a whole source.

Defined results: documents with null or empty text have no tokens and aren't used; sources that are spelled differently
(case, blanks, `-` or space for `_`) are one; null sources and sources without target aren't used; a source without
documents, or too small even with all repeats, shows a shortfall; repeated rows are documents of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.session import written
from jobloom.tables import rows_of


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """docs without text, with n_tokens. path: a vocabulary of ranks, on every machine; the tokenizer is never trained."""
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens int"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        import tiktoken

        with open(path or tokenizer_path(), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            sizes = [len(coder.encode_ordinary(t)) if isinstance(t, str) else 0 for t in pdf[text]]
            yield pdf.drop(columns=[text]).assign(n_tokens=pd.Series(sizes, dtype="int32", index=pdf.index))

    return docs.mapInPandas(count, schema)


def source_key(source: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s\-]+", "_")


def knapsack(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """{length: count} with the greatest total up to budget, of at most the given count of each length.

    Subset sums as bits of one integer; counts are split into powers of two, and the sets of sums before each part are
    kept to find the way back.
    """
    if budget <= 0:
        return {}
    parts = []
    for length, count in sorted(lengths, reverse=True):
        count = min(count, budget // length) if length else 0
        size = 1
        while count > 0:
            size = min(size, count)
            parts.append((length, size))
            count -= size
            size *= 2
    mask, sums, before = (1 << (budget + 1)) - 1, 1, []
    for length, size in parts:
        before.append(sums)
        sums |= (sums << (length * size)) & mask
        if sums >> budget & 1:
            break
    total, taken = sums.bit_length() - 1, {}
    for (length, size), earlier in zip(reversed(parts[: len(before)]), reversed(before), strict=True):
        if not earlier >> total & 1:
            total -= length * size
            taken[length] = taken.get(length, 0) + size
    return taken


def fill(counts: dict[int, int], target: int, max_repeats: int, open_docs: int = 64) -> tuple[int, dict[int, int]]:
    """(whole copies of every document, {length: documents taken once more}) whose tokens come nearest to target from below.

    open_docs bounds the remaining knapsack: an even share of every length is taken first, leaving about so many of the
    longest documents' tokens to the exact step.
    """
    total = sum(n * c for n, c in counts.items())
    if not total or target <= 0:
        return 0, {}
    copies = min(target // total, max_repeats)
    if copies == max_repeats:
        return copies, {}
    rest = target - copies * total
    room = open_docs * max(counts)
    share = max(0.0, (rest - room) / total)
    more = {n: int(c * share) for n, c in counts.items()}
    rest -= sum(n * k for n, k in more.items())
    # by rounding down, more than the room can be left: whole documents of the longest lengths first
    for n in sorted(counts, reverse=True):
        if rest <= 2 * room:
            break
        k = min(counts[n] - more[n], (rest - room) // n)
        more[n] += k
        rest -= n * k
    for n, k in knapsack([(n, c - more[n]) for n, c in counts.items()], rest).items():
        more[n] += k
    return copies, more


def plan(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> tuple[dict, int, list]:
    """({source: (copies, {length: more})}, total, rows of targets). One row per source and length comes to the driver:
    at most 1000 sources, and as many lengths as there are distinct sizes of documents."""
    wanted = rows_of(targets, 1000, "the table of targets")
    sizes = counted.groupBy("source_name", "n_tokens").count()
    by_source: dict[str, dict[int, int]] = {r.source_name: {} for r in wanted}
    for r in sizes.toLocalIterator():
        by_source.setdefault(r.source_name, {})[r.n_tokens] = r["count"]
    total = total_tokens or sum(n * c for r in wanted for n, c in by_source[r.source_name].items())
    return {r.source_name: fill(by_source[r.source_name], round(r.target_share * total), r.max_repeats) for r in wanted}, total, [(r, by_source[r.source_name]) for r in wanted]


def _counted(docs: DataFrame, targets: DataFrame, path: str | None) -> DataFrame:
    named = docs.where(F.length("text") > 0).select("doc_id", source_key(F.col("source")).alias("source_name"), "text")
    named = named.join(F.broadcast(targets.select("source_name").limit(1000)), "source_name", "left_semi")
    return written(token_counts(named, path=path).where("n_tokens > 0"), "tokens")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str | None = None) -> DataFrame:
    """(doc_id, source_name, n_tokens, copies) of the documents used.

    total_tokens: the size of the mixture; if none, that of all documents of the sources with a target.
    """
    counted = _counted(docs, targets, path)
    plans, _, _ = plan(counted, targets, total_tokens)
    spark = docs.sparkSession
    flat = [(s, n, copies, k) for s, (copies, more) in plans.items() for n, k in more.items()]
    wanted = spark.createDataFrame(flat, "source_name string, n_tokens int, whole int, more int")
    base = spark.createDataFrame([(s, copies) for s, (copies, _) in plans.items()], "source_name string, base int")
    ranges = 64
    ranked = counted.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("part", F.pmod(F.shiftright("h", 20), F.lit(ranges)).cast("int"))
    parts = ranked.groupBy("source_name", "n_tokens", "part").count()
    before = F.sum("count").over(Window.partitionBy("source_name", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    borders = parts.withColumn("before", F.coalesce(before, F.lit(0))).join(wanted, ["source_name", "n_tokens"]).select("source_name", "n_tokens", "part", "before", "count", "more")
    # ranges wholly inside or outside need no rank
    placed = ranked.join(borders, ["source_name", "n_tokens", "part"], "left").join(F.broadcast(base), "source_name")
    inside = F.col("before") + F.col("count") <= F.col("more")
    cut = (F.col("before") < F.col("more")) & ~inside
    sure = placed.where(~F.coalesce(cut, F.lit(False))).select("doc_id", "source_name", "n_tokens", (F.col("base") + F.coalesce(inside.cast("int"), F.lit(0))).alias("copies"))
    rank = F.row_number().over(Window.partitionBy("source_name", "n_tokens", "part").orderBy("h", "doc_id"))
    edge = placed.where(cut).withColumn("rank", rank).select("doc_id", "source_name", "n_tokens", (F.col("base") + (F.col("rank") <= F.col("more") - F.col("before")).cast("int")).alias("copies"))
    return sure.unionByName(edge).where("copies > 0")


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, path: str | None = None) -> DataFrame:
    """(source_name, target_share, actual_share, target_tokens, actual_tokens, available_tokens, max_repeats, copies, shortfall_tokens)."""
    plans, total, wanted = plan(_counted(docs, targets, path), targets, total_tokens)
    rows, used = [], {}
    for r, counts in wanted:
        copies, more = plans[r.source_name]
        used[r.source_name] = copies * sum(n * c for n, c in counts.items()) + sum(n * k for n, k in more.items())
    mixed = sum(used.values())
    for r, counts in wanted:
        target, got = round(r.target_share * total), used[r.source_name]
        rows.append((r.source_name, r.target_share, got / mixed if mixed else 0.0, target, got, sum(n * c for n, c in counts.items()), r.max_repeats, plans[r.source_name][0], target - got))
    return docs.sparkSession.createDataFrame(rows, "source_name string, target_share double, actual_share double, target_tokens bigint, actual_tokens bigint, available_tokens bigint, max_repeats int, copies int, shortfall_tokens bigint")
