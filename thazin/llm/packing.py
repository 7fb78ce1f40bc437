"""Filling containers of fixed capacity (problem 9): a grouping genetic algorithm on islands.

The items are split by hash into blocks of a fixed expected size, so that the
work per task never grows with the data.  Every block is evolved on several
islands, each with its own seed; between the epochs the elite of each island
also moves to the next island of the block.  A chromosome is a list of bins.
Crossover injects the best-filled bins of one parent into the other, drops the
bins that hold a duplicate, lets displaced items replace smaller ones where
that fills a bin better, and puts the rest back by best fit.  At the end the
island with the fewest, then most unequally filled bins gives the assignment.
"""

from __future__ import annotations

import bisect
import math
import random
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thazin.llm import bpe
from thazin.llm.tokens import tokens_of
from thazin.session import cut

BLOCK_ITEMS = 4096
ISLANDS = 2
EPOCHS = 3
POPULATION = 8
GENERATIONS = 40
ELITE = 2

Bin = tuple[int, tuple[int, ...]]  # fill and items; shared by chromosomes, never changed


def best_fit(items: Sequence[int], size: Sequence[int], bins: list[Bin], capacity: int) -> list[Bin]:
    """Put items, in their order, into the fullest bin that still has room."""
    new: list[list] = [[f, b, None] for f, b in bins]
    free = sorted((capacity - f, k) for k, (f, _) in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(free, (size[i], -1))
        if at == len(free):
            new.append([size[i], (), [i]])
            bisect.insort(free, (capacity - size[i], len(new) - 1))
            continue
        room, k = free.pop(at)
        entry = new[k]
        entry[0] += size[i]
        if entry[2] is None:
            entry[2] = []
        entry[2].append(i)
        bisect.insort(free, (room - size[i], k))
    return [(f, b if more is None else (*b, *more)) for f, b, more in new]


def fitness(bins: list[Bin], capacity: int) -> float:
    """Mean squared fill: fewer and unequally filled bins score higher."""
    return sum((f / capacity) ** 2 for f, _ in bins) / max(1, len(bins))


def replace(loose: list[int], size: Sequence[int], bins: list[Bin], capacity: int, rng: random.Random, tries: int = 6) -> tuple[list[Bin], list[int]]:
    """Swap one or two items of a bin for one or two loose ones where that fills it better without going over."""
    order = sorted(loose, key=lambda i: size[i])
    sizes = [size[i] for i in order]
    out = list(bins)
    for k in rng.sample(range(len(out)), len(out)):
        fill, items = out[k]
        room = capacity - fill
        if not room or not order:
            continue
        gone: tuple[int, ...] = ()
        best, came = 0, ()
        groups = [(i,) for i in items]
        if len(items) < 8:  # all pairs of a long bin would cost more than they gain
            groups += [(i, j) for a, i in enumerate(items) for j in items[a + 1 :]]
        for group in groups:
            have = sum(size[i] for i in group)
            at = bisect.bisect_right(sizes, have + room) - 1
            if at >= 0 and sizes[at] - have > best:
                best, gone, came = sizes[at] - have, group, (at,)
            for first in rng.sample(range(len(order)), min(tries, len(order))):
                at = bisect.bisect_right(sizes, have + room - sizes[first]) - 1
                if at == first:
                    at -= 1
                if at >= 0 and sizes[at] + sizes[first] - have > best:
                    best, gone, came = sizes[at] + sizes[first] - have, group, (first, at)
            if best == room:
                break
        if best:
            taken = [order[c] for c in came]
            for c in sorted(came, reverse=True):
                del order[c], sizes[c]
            for i in gone:
                c = bisect.bisect_left(sizes, size[i])
                order.insert(c, i)
                sizes.insert(c, size[i])
            out[k] = (fill + best, (*(i for i in items if i not in gone), *taken))
    return out, order[::-1]


def settle(loose: list[int], size: Sequence[int], bins: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    bins, loose = replace(loose, size, bins, capacity, rng)
    return best_fit(loose, size, bins, capacity)


def cross(a: list[Bin], b: list[Bin], size: Sequence[int], capacity: int, rng: random.Random) -> list[Bin]:
    """A child of b with the best-filled bins of a."""
    take = sorted(a, key=lambda x: -x[0])[: max(1, int(len(a) * rng.uniform(0.3, 0.7)))]
    held = bytearray(len(size))
    for _, items in take:
        for i in items:
            held[i] = 1
    keep, loose = list(take), []
    for x in b:
        inside = [i for i in x[1] if not held[i]]
        if len(inside) == len(x[1]):
            keep.append(x)
        else:
            loose += inside
    return settle(loose, size, keep, capacity, rng)


def mutate(bins: list[Bin], size: Sequence[int], capacity: int, rng: random.Random) -> list[Bin]:
    """Dissolve a few bins, the emptiest first among them."""
    order = sorted(range(len(bins)), key=lambda k: bins[k][0])
    gone = {*order[:2], *rng.sample(order, min(3, len(order)))}
    return settle([i for k in gone for i in bins[k][1]], size, [x for k, x in enumerate(bins) if k not in gone], capacity, rng)


def evolve(size: Sequence[int], capacity: int, seed: int, elites: list[list[Bin]], generations: int = GENERATIONS, population: int = POPULATION) -> list[list[Bin]]:
    """The pool after some generations, best first; it ends where the best meets the lower bound, which nothing can improve."""
    rng = random.Random(seed)
    if not size:
        return [[]]
    bound = max(1, math.ceil(sum(size) / capacity))
    pool = list(elites)
    while len(pool) < population:  # first chromosomes: best fit of items in random order
        pool.append(best_fit(rng.sample(range(len(size)), len(size)), size, [], capacity))
    rank = lambda bins: (len(bins), -fitness(bins, capacity))
    pool.sort(key=rank)
    for _ in range(generations):
        if len(pool[0]) <= bound:
            break
        a, b = (min(rng.sample(range(len(pool)), 2)) for _ in range(2))  # two tournaments
        child = cross(pool[a], pool[b], size, capacity, rng) if a != b else pool[a]
        if a == b or rng.random() < 0.5:
            child = mutate(child, size, capacity, rng)
        pool = sorted([*pool, child], key=rank)[:population]
    return pool


def _numbers(bins: list[Bin], n: int) -> list[int]:
    out = [0] * n
    for k, (_, items) in enumerate(bins):
        for i in items:
            out[i] = k
    return out


def _bins(numbers: Sequence[int], size: Sequence[int]) -> list[Bin]:
    held: dict[int, list[int]] = {}
    for i, k in enumerate(numbers):
        held.setdefault(k, []).append(i)
    return [(sum(size[i] for i in items), tuple(items)) for items in held.values()]


def pack(
    items: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", capacity: int = 2048, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS
) -> DataFrame:
    """(id, piece, container_id, tokens, container_tokens): one row per item, or per piece of an item above the capacity.

    An item is never split unless it alone exceeds the capacity; then all its
    pieces but the last fill a container each (pieces count from 0) and the
    rest is packed like an item.  A size that is null or below 0 counts as 0;
    such items still get a container.  Items of a block are taken in order of
    id and size, so the result is the same over the same partitions.  An empty table gives no rows.  Repeated
    ids are packed as separate items.  Containers are numbered within their
    block, so no two share a number.
    """
    src = items.select(F.col(id_col).alias("_id"), F.greatest(F.coalesce(F.col(size_col).cast("int"), F.lit(0)), F.lit(0)).alias("_n"))
    full = F.floor((F.col("_n") - 1) / capacity).cast("int")  # pieces before the last one
    src = src.select("_id", F.greatest(full, F.lit(0)).alias("_piece"), "_n")
    # sizes are computed once, as they are read twice; the salt spreads repeated rows too, so that no block outgrows its size
    src = cut(src.select("_id", "_piece", (F.col("_n") - F.col("_piece") * capacity).cast("int").alias("_n"), F.monotonically_increasing_id().alias("_salt")))
    blocks = max(1, math.ceil(src.count() / block_items))
    home = F.pmod(F.xxhash64("_id", "_n", "_salt"), F.lit(blocks)).cast("int")
    seeds = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("_island")
    id_type = dict(src.dtypes)["_id"]
    schema = f"_block int, _island int, _home int, ids array<{id_type}>, pieces array<int>, sizes array<int>, pool array<array<int>>, fill array<int>, base array<int>, n_bins int, worth double"

    def row(key, ids, pieces, sizes, pool: list[list[Bin]]) -> pd.DataFrame:
        fill = [0] * len(sizes)
        for f, held in pool[0]:
            for i in held:
                fill[i] = f
        kept = [_numbers(bins, len(sizes)) for bins in pool[:ELITE]]
        return pd.DataFrame(
            {"_block": key[0], "_island": key[1], "_home": 0, "ids": [ids], "pieces": [pieces], "sizes": [sizes], "pool": [kept], "fill": [fill], "base": [[0, *accumulate(pieces)][:-1]], "n_bins": len(pool[0]), "worth": fitness(pool[0], capacity)}
        )

    def first(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_id", "_piece", "_n"], kind="stable", na_position="first")
        sizes = pdf["_n"].tolist()
        return row(key, pdf["_id"].tolist(), pdf["_piece"].tolist(), sizes, evolve(sizes, capacity, 1000 * int(key[0]) + int(key[1]), [], generations))

    state = src.select("_id", "_piece", "_n", home.alias("_block"), seeds).groupBy("_block", "_island").applyInPandas(first, schema)

    def later(epoch: int):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_home", kind="stable")
            r = pdf.iloc[0]
            sizes = list(r["sizes"])
            elites = [_bins(numbers, sizes) for pool in pdf["pool"] for numbers in pool]
            return row(key, r["ids"], r["pieces"], sizes, evolve(sizes, capacity, 7919 * epoch + 1000 * int(key[0]) + int(key[1]), elites, generations))

        return run

    for epoch in range(1, epochs):
        # migration: an island's elite stays and also goes to the next one
        moved = state.withColumn("_island", F.pmod(F.col("_island") + 1, F.lit(islands))).withColumn("_home", F.lit(1))
        state = state.unionByName(moved).groupBy("_block", "_island").applyInPandas(later(epoch), schema)
    best = state.groupBy("_block").agg(F.min_by(F.struct("ids", "pieces", "sizes", F.col("pool")[0].alias("bins"), "fill", "base", "n_bins"), F.struct("n_bins", -F.col("worth"), "_island")).alias("r"))
    flat = best.select("_block", "r.n_bins", F.explode(F.arrays_zip("r.ids", "r.pieces", "r.sizes", "r.bins", "r.fill", "r.base")).alias("e"))
    number = lambda k: F.shiftleft(F.col("_block").cast("long"), 32) + k

    def part(piece, k, tokens, fill):
        return F.struct(piece.cast("int").alias("piece"), number(k).alias("container_id"), tokens.cast("int").alias("tokens"), fill.cast("int").alias("container_tokens"))

    # full pieces have a container each, numbered after those of their block
    full = F.transform(F.sequence(F.lit(0), F.col("e.pieces") - 1), lambda k: part(k, F.col("n_bins") + F.col("e.base") + k, F.lit(capacity), F.lit(capacity)))
    own = F.array(part(F.col("e.pieces"), F.col("e.bins"), F.col("e.sizes"), F.col("e.fill")))
    parts = F.when(F.col("e.pieces") > 0, F.concat(own, full)).otherwise(own)
    return flat.select(F.col("e.ids").alias(id_col), F.explode(parts).alias("c")).select(id_col, "c.*")


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """:func:`pack` over documents, sized in tokens of the public tokenizer."""
    sized = df.select(F.col(id_col), tokens_of(df.sparkSession, F.col(text_col), vocabulary).alias("_tokens"))
    return pack(sized, id_col, "_tokens", capacity)
