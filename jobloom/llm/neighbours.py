"""The k most similar vectors for every vector, by randomly rotated one-bit codes.

Index. Unit vectors are assigned to the nearest of about n / cell_rows centres, fitted on a bounded seeded sample; every
vector is indexed. Inside its cell a vector is kept as one bit per dimension of its randomly rotated residual (its
difference from the centre) and two scalars: the residual's norm and the inner product of the residual with its code.

Search. Every vector is a query in its own cell and in each further cell whose centre is nearly as near as the nearest.
The inner products of the query's rotated residual with the codes of the cell, unpacked tile by tile to +1 and -1, and
the scalars give an unbiased estimate for every vector of the cell. Its error is bounded by
bound * sqrt((1 - c^2) / c^2) / sqrt(d - 1) times the norms of the two residuals, c being the cosine between residual
and code. Vectors whose upper bound reaches the k-th best lower bound are reranked with exact inner products in double
precision.

Cells are split into blocks of at most block_rows; each pair of blocks of a cell is a task of its own, so a cell that
holds a third of all vectors is spread. The results of all blocks and cells are merged per query.

The sample bounds the number of centres, so cells grow with the data. A block of more than 2 * cell_rows vectors is
therefore divided once more, where it is searched, around centres of its own: the time for a vector stays the same.
Queries go to the parts nearly as near as the nearest (part_margin, part_probes), nearest first, and on until they have k.

Defined results: null, empty, all-zero vectors, those with a null or not finite entry and those of another length are
left out; a key counts once, with its smallest vector if its rows differ; equal similarities end at the smaller key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        empty = np.bincount(near, minlength=cells) == 0
        sums[empty] = sample[rng.choice(len(sample), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def pack(vectors: np.ndarray) -> list[bytes]:
    """Vectors as bytes, nothing lost: a step and whole multiples of it up to 127 where that is exact, else half or single precision."""
    single = vectors.astype(np.float32)
    size = np.abs(single)
    least = np.where(size > 0, size, np.inf).min(1, keepdims=True).astype(np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        half = single.astype(np.float16)
        as_half = (half.astype(np.float32) == single).all(axis=1)
        out: list[bytes | None] = [None] * len(single)
        for part in (1, 2, 3):
            step = least / np.float32(part)
            whole = np.rint(single / step)
            fits = ((np.abs(whole) <= 127).all(1)) & (whole.astype(np.float32) * step == single).all(1)
            for i in np.flatnonzero(fits):
                if out[i] is None:
                    out[i] = step[i].tobytes() + whole[i].astype(np.int8).tobytes()
    return [o or (h.tobytes() if e else v.tobytes()) for o, h, v, e in zip(out, half, single, as_half, strict=True)]


def unpack(blobs: pd.Series, dims: int) -> np.ndarray:
    out = np.empty((len(blobs), dims), dtype=np.float64)
    for i, b in enumerate(blobs):
        if len(b) == dims + 4:
            out[i] = np.frombuffer(b, dtype=np.int8, offset=4).astype(np.float32) * np.frombuffer(b, dtype=np.float32, count=1)
        else:
            out[i] = np.frombuffer(b, dtype=np.float16 if len(b) == 2 * dims else np.float32)
    return out


def turned(vectors: np.ndarray, turn: np.ndarray | None) -> np.ndarray:
    return vectors if turn is None else vectors @ turn.T


class Codes:
    """One-bit codes of a block of vectors around a centre. turn: None if everything has been rotated before."""

    def __init__(self, units: np.ndarray, centre: np.ndarray, turn: np.ndarray | None) -> None:
        self.dims = units.shape[1]
        residual = turned(units - centre, turn)
        self.norm = np.linalg.norm(residual, axis=1).astype(np.float32)
        direction = residual / np.maximum(self.norm, 1e-9)[:, None]
        bits = direction > 0
        self.cosine = np.maximum(np.abs(direction).sum(1) / math.sqrt(self.dims), 1e-3).astype(np.float32)
        self.packed = np.packbits(bits, axis=1)
        self.error = np.sqrt(np.maximum(1 - self.cosine**2, 0) / self.cosine**2) / math.sqrt(self.dims - 1)
        self.centre_product = (units @ centre).astype(np.float32)

    def signs(self) -> np.ndarray:
        """The codes as +1 and -1, dimension by vector."""
        return (np.unpackbits(self.packed, axis=1, count=self.dims).astype(np.float32) * 2 - 1).T

    def estimate(self, units: np.ndarray, centre: np.ndarray, turn: np.ndarray | None, bound: float, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner products, bounds of their errors) of queries with every code."""
        residual = turned(units - centre, turn)
        norm = np.linalg.norm(residual, axis=1)
        guess = residual @ (self.signs() if signs is None else signs)
        guess *= self.norm / (self.cosine * math.sqrt(self.dims))
        guess += (self.centre_product - centre @ centre)[None, :]
        guess += (units @ centre)[:, None]
        return guess, norm[:, None] * (bound * self.error * self.norm)[None, :] + 1e-4


def exact_products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows a[i] and b[j]; equal rows give equal products."""
    parts = (slice(at, at + 512) for at in range(0, len(i), 512))
    return np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[i[p]], b[j[p]]) for p in parts)])


def part_centres(vectors: np.ndarray, centre: np.ndarray, cell_rows: int, seed: int) -> np.ndarray:
    """Centres of the parts of a block: its cell's alone, or about one for cell_rows vectors."""
    if len(vectors) <= 2 * cell_rows:
        return centre[None, :]
    cells = math.ceil(len(vectors) / cell_rows)
    drawn = np.random.default_rng(seed).choice(len(vectors), min(len(vectors), 32 * cells), replace=False)
    return fit_centres(vectors[drawn], cells, rounds=6, seed=seed)


def ranked(sims: np.ndarray, margin: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """(centres from the nearest on, whether they are nearly as near as the nearest) of every row."""
    order = np.argsort(-sims, axis=1, kind="stable")
    near = np.take_along_axis(sims, order, 1) >= np.take_along_axis(sims, order[:, :1], 1) - margin
    near[:, probes:] = False
    return order, near


def search_block(
    unit: np.ndarray, base_at: np.ndarray, query_at: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, bound: float,
    cell_rows: int, margin: float, probes: int, seed: int,
) -> tuple[np.ndarray, np.ndarray]:
    """(rows of unit, inner products) of the best k of the rows base_at for each of the rows query_at; -1 and -4 where there are fewer.

    Of equal products the smaller row is the better one.
    """
    small = turned(unit.astype(np.float32), turn)
    centres = part_centres(small[base_at], turned(centre, turn), cell_rows, seed)
    home = (small[base_at] @ centres.T).argmax(1)
    order, near = ranked(small[query_at] @ centres.T, margin, probes)
    members = [base_at[home == c] for c in range(len(centres))]
    codes = [Codes(small[m], c, None) for m, c in zip(members, centres, strict=True)]
    place = np.full(len(unit), -1)
    for m in members:
        place[m] = np.arange(len(m))
    part_of = np.full(len(unit), -1)
    part_of[base_at] = home
    best, best_at = np.full((len(query_at), k), -4.0), np.full((len(query_at), k), -1)
    for rank in range(len(centres)):
        active = np.flatnonzero(near[:, rank] | (best_at[:, k - 1] < 0))
        if not len(active):
            break
        active = active[np.argsort(order[active, rank], kind="stable")]
        for rows in np.split(active, np.flatnonzero(np.diff(order[active, rank])) + 1):
            c = order[rows[0], rank]
            if not len(members[c]):
                continue
            signs, tile = codes[c].signs(), max(1, 500_000 // len(members[c]))
            for q in (rows[at : at + tile] for at in range(0, len(rows), tile)):
                here = np.flatnonzero(part_of[query_at[q]] == c)
                mine = place[query_at[q[here]]]
                guess, error = codes[c].estimate(small[query_at[q]], centres[c], None, bound, signs)
                lower = guess - error
                lower[here, mine] = -4
                least = best[q, k - 1]
                if lower.shape[1] > k:
                    least = np.maximum(least, np.partition(lower, lower.shape[1] - k, axis=1)[:, -k])
                guess += error
                chosen = guess >= least[:, None]
                chosen[here, mine] = False
                i, j = np.nonzero(chosen)
                j = members[c][j]
                exact = exact_products(unit, query_at[q[i]], unit, j)
                by = np.lexsort((j, -exact, i))
                i, j, exact = i[by], j[by], exact[by]
                nth = np.arange(len(i)) - np.searchsorted(i, i, side="left")
                top = nth < k
                new, new_at = np.full((len(q), k), -4.0), np.full((len(q), k), -1)
                new[i[top], nth[top]], new_at[i[top], nth[top]] = exact[top], j[top]
                both, both_at = np.hstack([best[q], new]), np.hstack([best_at[q], new_at])
                by = np.lexsort((both_at, -both), axis=1)[:, :k]
                best[q], best_at[q] = np.take_along_axis(both, by, 1), np.take_along_axis(both_at, by, 1)
    return best_at, best


def usable(rows: DataFrame, dims: int) -> DataFrame:
    """Rows (key, vec) whose vector can be compared."""
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("key").isNotNull() & (F.size("vec") == dims)).where(fine & F.exists("vec", lambda x: x != 0))


def nearest(
    rows: DataFrame, k: int = 5, dims: int = 384, cell_rows: int = 200, block_rows: int = 16_000, margin: float = 0.02, probes: int = 4,
    sample_rows: int = 20_000, bound: float = 1.9, seed: int = 7, part_margin: float = 0.1, part_probes: int = 16,
) -> DataFrame:
    """(key, other, similarity): for every key of rows (key, vec) its k most similar others, found with the index.

    sample_rows bounds the sample the centres are fitted on; centres beyond one for every 16 of its rows aren't made.
    """
    good = usable(rows.select("key", "vec"), dims)
    n = good.count()
    spark = rows.sparkSession
    result = "key string, other string, similarity double"
    if n == 0:
        return spark.createDataFrame([], result)
    take = good.where(F.rand(seed) < min(1.0, 1.2 * sample_rows / n)).limit(sample_rows)
    drawn = np.array([r[0] for r in take.select("vec").collect()] or [r[0] for r in good.select("vec").limit(1).collect()], dtype=np.float32)
    drawn /= np.linalg.norm(drawn, axis=1, keepdims=True)
    centres = fit_centres(drawn, max(1, min(math.ceil(n / cell_rows), len(drawn) // 16 or 1)), seed=seed)
    turn = rotation(dims, seed)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = np.stack(pdf["vec"].to_numpy()).astype(np.float32)
            unit = raw / np.linalg.norm(raw.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
            sims = unit @ centres.T
            order, near = ranked(sims, margin, probes)
            row, rank = np.nonzero(near)
            blobs = np.array(pack(raw), dtype=object)
            keys = pdf["key"].to_numpy()
            yield pd.DataFrame({"cell": order[row, rank].astype("int32"), "home": rank == 0, "key": keys[row], "blob": blobs[row]})

    placed = good.mapInPandas(assign, "cell int, home boolean, key string, blob binary")
    # cells larger than a block are split: base rows to one block each, queries to a block and every base block. Sizes are
    # estimated from the sample; an estimate that is off makes blocks smaller or larger, never another result.
    mine = np.bincount((drawn @ centres.T).argmax(1), minlength=len(centres)) * (n / len(drawn))
    blocks = {c: (max(1, math.ceil(m / block_rows)), max(1, math.ceil(m / block_rows))) for c, m in enumerate(mine)}
    split = {c: b for c, b in blocks.items() if b != (1, 1)}
    salt = F.pmod(F.xxhash64("key"), F.lit(1 << 30)).cast("int")
    if split:
        table = F.create_map(*(x for c, (nb, nq) in split.items() for x in (F.lit(c), F.struct(F.lit(nb).alias("nb"), F.lit(nq).alias("nq")))))
        nb, nq = F.coalesce(table[F.col("cell")]["nb"], F.lit(1)), F.coalesce(table[F.col("cell")]["nq"], F.lit(1))
        base_block, query_block = F.pmod(salt, nb), F.pmod(salt, nq)
        # role: base rows go to all query blocks of their cell, queries to all base blocks; a row in both roles travels once
        as_base = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), nq - 1), lambda q: F.struct(base_block.alias("b"), q.alias("q"))))
        as_query = F.transform(F.sequence(F.lit(0), nb - 1), lambda b: F.struct(b.alias("b"), query_block.alias("q")))
        places = F.array_distinct(F.concat(F.coalesce(as_base, F.expr("cast(array() as array<struct<b:int,q:int>>)")), as_query))
        spread = placed.withColumn("at", F.explode(places)).withColumn("is_base", F.col("home") & (F.col("at.b") == base_block)).withColumn("is_query", F.col("at.q") == query_block)
        spread = spread.select("cell", F.col("at.b").alias("bb"), F.col("at.q").alias("qb"), "key", "blob", "is_base", "is_query")
    else:
        spread = placed.select("cell", F.lit(0).alias("bb"), F.lit(0).alias("qb"), "key", "blob", F.col("home").alias("is_base"), F.lit(True).alias("is_query"))

    def scan(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        centre = centres[group[0]].astype(np.float32)
        pdf = pdf.sort_values(["key", "blob"]).drop_duplicates("key")
        unit = unpack(pdf["blob"], dims)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        keys = pdf["key"].to_numpy()
        is_base, is_query = pdf["is_base"].to_numpy(bool), pdf["is_query"].to_numpy(bool)
        base_at = np.flatnonzero(is_base)
        if not len(base_at):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("key", "others", "sims")})
        query_at = np.flatnonzero(is_query)
        best_at, best = search_block(unit, base_at, query_at, centre, turn, k, bound, cell_rows, part_margin, part_probes, seed)
        known = best_at[:, 0] >= 0
        many = (best_at[known] >= 0).sum(1).tolist()
        others, sims = keys[best_at[known]].tolist(), best[known].tolist()
        return pd.DataFrame({
            "key": keys[query_at[known]], "others": pd.Series([o[:m] for o, m in zip(others, many, strict=True)], dtype=object),
            "sims": pd.Series([x[:m] for x, m in zip(sims, many, strict=True)], dtype=object),
        })

    found = spread.groupBy("cell", "bb", "qb").applyInPandas(scan, "key string, others array<string>, sims array<double>")
    # merged per query: at most probes * blocks lists of k
    one = F.flatten(F.collect_list(F.zip_with("others", "sims", lambda o, s: F.struct((-s).alias("far"), o.alias("other")))))
    merged = found.groupBy("key").agg(F.slice(F.array_sort(F.array_distinct(one)), 1, k).alias("best"))
    return merged.select("key", F.explode("best").alias("x")).select("key", F.col("x.other").alias("other"), (-F.col("x.far")).alias("similarity"))


def similar_pairs(rows: DataFrame, **options: object) -> DataFrame:
    """(key_a, key_b): pairs of which at least one is among the k most similar of the other."""
    near = nearest(rows, **options)
    return near.select(F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()


def brute_force(keys: list[str], vectors: np.ndarray, k: int = 5) -> set[tuple[str, str]]:
    """The pairs by comparison of every vector with all, for tests and measures of recall."""
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    out = set()
    for at in range(0, len(unit), 1000):
        sims = unit[at : at + 1000] @ unit.T
        for i, row in enumerate(sims, at):
            row[i] = -9
            for j in sorted(np.argpartition(-row, min(k, len(row) - 1))[: k + 1], key=lambda j: (-row[j], keys[j]))[:k]:
                if j != i:
                    out.add((min(keys[i], keys[j]), max(keys[i], keys[j])))
    return out
