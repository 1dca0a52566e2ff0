"""Filling containers of fixed capacity, by a grouping genetic algorithm on islands."""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.session import staged

#: Items of a block: islands of one block solve the same items, so this bounds what a task holds.
BLOCK_ITEMS = 1_000
ISLANDS = 3
POPULATION = 8
GENERATIONS = 25
EPOCHS = 2
#: Members of an island that move to the next one between epochs.
ELITE = 2
#: Containers filled to this share are kept after a round; the items of the others are packed again with other blocks'.
KEEP = 0.995
ROUNDS = 2

Bins = list[list[int]]


def fitness(bins: Bins, sizes: Sequence[int], capacity: int) -> float:
    """Mean squared fill of the containers, which prefers full ones among many."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def best_fit(bins: Bins, items: Sequence[int], sizes: Sequence[int], capacity: int) -> Bins:
    """Puts `items`, largest first, each into the container it fills best, or into a new one."""
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -sizes[i]):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        insort(room, (left - sizes[i], k))
    return bins


def refill(bins: Bins, loose: Sequence[int], sizes: Sequence[int], capacity: int) -> Bins:
    """Puts displaced items back: where one fits better than one or two smaller items of a container, it takes their
    place and they are displaced instead, which makes full containers fuller; the rest goes best fit."""
    free = sorted((sizes[i], i) for i in loose)
    for b in bins:
        room = capacity - sum(sizes[i] for i in b)
        if not room or not free:
            continue
        best = (0, None, None)
        own = sorted(b, key=lambda i: sizes[i])
        pairs = [(i, j) for k, i in enumerate(own[:6]) for j in own[k + 1 : 6]]
        for out in (*((i,) for i in own), *pairs):
            held = sum(sizes[i] for i in out)
            at = bisect_left(free, (held + room + 1, -1)) - 1
            if at >= 0 and free[at][0] - held > best[0]:
                best = (free[at][0] - held, out, at)
        if best[1] is not None:
            _, i = free.pop(best[2])
            for j in best[1]:
                b.remove(j)
                insort(free, (sizes[j], j))
            b.append(i)
    return best_fit(bins, [i for _, i in free], sizes, capacity)


def least_bins(sizes: Sequence[int], capacity: int) -> int:
    """A number of containers that no packing goes below: by volume, and by large items that exclude each other."""
    s = sorted(sizes, reverse=True)
    total, n = sum(s), len(s)
    best = -(-total // capacity)
    upto = [0]
    for x in s:
        upto.append(upto[-1] + x)
    half = sum(1 for x in s if 2 * x > capacity)
    for small in {x for x in s if 0 < 2 * x <= capacity}:
        big = bisect_left(s, -(capacity - small), key=lambda x: -x)  # items over capacity - small stand alone
        end = n - bisect_left(s[::-1], small)  # items of at least `small`
        rest = upto[end] - upto[half] - ((half - big) * capacity - (upto[half] - upto[big]))
        best = max(best, half + max(0, -(-rest // capacity)))
    return max(best, half)


def cross(a: Bins, b: Bins, sizes: Sequence[int], capacity: int, rng: random.Random) -> Bins:
    """A child of `a` with some well-filled containers of `b`: containers of `a` that share an item with them are
    dissolved, and the displaced items are put back, first in exchange for smaller ones, then best fit."""
    by_fill = sorted(b, key=lambda x: -sum(sizes[i] for i in x))
    top = by_fill[: max(1, len(by_fill) // 2)]
    injected = rng.sample(top, max(1, len(top) // 2))
    taken = {i for x in injected for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    return refill(kept + [list(x) for x in injected], displaced, sizes, capacity)


def mutate(a: Bins, sizes: Sequence[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolves the emptiest containers and a few others, and puts their items back."""
    order = sorted(range(len(a)), key=lambda k: sum(sizes[i] for i in a[k]))
    gone = set(order[:2]) | set(rng.sample(order, min(len(order), 4)))
    return refill([list(x) for k, x in enumerate(a) if k not in gone], [i for k in gone for i in a[k]], sizes, capacity)


def evolve(sizes: Sequence[int], capacity: int, population: list[Bins], seed: int, generations: int = GENERATIONS, members: int = POPULATION) -> list[Bins]:
    """One epoch of one island: its population, best first. Stops early where no packing can have fewer containers."""
    rng = random.Random(seed)
    n, least = len(sizes), least_bins(sizes, capacity)
    score = lambda x: (-len(x), fitness(x, sizes, capacity))
    people = [[list(b) for b in x] for x in population]
    if len(people) < members:
        people.append(best_fit([], range(n), sizes, capacity))
    while len(people) < members and len(people[0]) > least:
        order = list(range(n))
        rng.shuffle(order)
        half = best_fit([], order[: n // 2], sizes, capacity)
        people.append(best_fit(half, order[n // 2 :], sizes, capacity))
    people.sort(key=score, reverse=True)
    for _ in range(generations):
        if len(people[0]) <= least or len(people) < 2:
            break
        a, b = rng.sample(people, 2)
        for child in (cross(a, b, sizes, capacity, rng), cross(b, a, sizes, capacity, rng), mutate(people[0], sizes, capacity, rng)):
            people.append(child)
        people.sort(key=score, reverse=True)
        del people[members:]
    return people


_STATE = pa.schema([("block", pa.int64()), ("island", pa.int32()), ("sizes", pa.list_(pa.int64())), ("people", pa.list_(pa.list_(pa.int32()))), ("guests", pa.list_(pa.list_(pa.int32())))])
_STATE_DDL = "block bigint, island int, sizes array<bigint>, people array<array<int>>, guests array<array<int>>"


def _bins(places: Sequence[int]) -> Bins:
    out: Bins = [[] for _ in range(max(places, default=-1) + 1)]
    for i, k in enumerate(places):
        out[k].append(i)
    return [b for b in out if b]


def _places(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _epoch(capacity: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                people = [_bins(p) for p in (*(row["people"] or ()), *(row["guests"] or ()))]
                people = evolve(row["sizes"], capacity, people, seed * 1_000_003 + row["block"] * 31 + row["island"])
                n = len(row["sizes"])
                # only the elite leaves the island; the rest of its population is rebuilt in the next epoch
                yield pa.RecordBatch.from_pylist([{**row, "people": [_places(p, n) for p in people[:ELITE]], "guests": None}], schema=_STATE)

    return run


def _packed(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    """(item, size, bin_id, filled): one round over blocks of random items, each solved by islands with migration."""
    total = items.count()
    blocks = max(1, -(-total // BLOCK_ITEMS))
    salted = items.withColumn("block", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(blocks)))
    packed = salted.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item", "size"))).alias("items"))
    packed = staged(packed)
    state = packed.select("block", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.transform("items", lambda x: x["size"]).alias("sizes"), F.lit(None).cast("array<array<int>>").alias("people"), F.lit(None).cast("array<array<int>>").alias("guests"))
    state = state.repartition(blocks * ISLANDS if blocks * ISLANDS < 4000 else 4000, "block", "island")
    for epoch in range(EPOCHS):
        if epoch:  # the elite of each island moves to the next one of its block
            guests = state.select("block", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), F.slice("people", 1, ELITE).alias("guests"))
            state = state.drop("guests").join(guests, ["block", "island"]).select("block", "island", "sizes", "people", "guests")
        state = staged(state.mapInArrow(_epoch(capacity, seed + 7 * epoch), _STATE_DDL))
    used = F.array_max(F.element_at("people", 1))
    best = state.groupBy("block").agg(F.min_by(F.element_at("people", 1), F.struct(used, "island")).alias("places"))
    laid = packed.join(best, "block").select("block", F.explode(F.arrays_zip("items", "places")).alias("x"))
    laid = laid.select("x.items.item", "x.items.size", F.concat_ws("-", F.lit(seed), "block", F.col("x.places")).alias("bin_id"))
    fill = laid.groupBy("bin_id").agg(F.sum("size").alias("filled"))
    return laid.join(fill, "bin_id")


def pack_items(df: DataFrame, item_id: str, size: str, capacity: int, rounds: int = ROUNDS) -> DataFrame:
    """(item_id, part_no, size, container_id, filled): every item in a container of `capacity`.

    Items over the capacity are divided into parts of the capacity and one rest; all others stay whole. Items go to
    random blocks of bounded size. On each block several islands run a grouping genetic algorithm: crossover injects
    whole well-filled containers, containers with items that occur twice are dissolved, displaced items are put back
    best fit; between epochs the islands exchange their elites. After a round, well-filled containers stay and the
    others' items go to new blocks together with those of all other blocks, so that what is left over at the end is a
    few containers per block of the last round, which holds a small share of the items.

    Defined results: null, zero and negative sizes count as zero and take no room; rows of one item that repeat count
    once, by their largest size; a null id is an item; an empty input gives no rows; other columns are ignored,
    whatever their names. Results are the same for the same items.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    kind = df.schema[item_id].dataType.simpleString()
    once = df.groupBy(F.struct(F.col(item_id).cast("string").alias("id")).alias("i")).agg(F.greatest(F.coalesce(F.max(F.col(size).cast("bigint")), F.lit(0)), F.lit(0)).alias("s"))
    parts = F.greatest(F.ceil(F.col("s") / capacity), F.lit(1)).cast("bigint")
    cut = once.select("i", "s", F.explode(F.sequence(F.lit(1).cast("bigint"), parts)).alias("part_no"))
    piece = F.least(F.col("s") - (F.col("part_no") - 1) * capacity, F.lit(capacity))
    items = cut.select(F.struct(F.col("i.id").alias("id"), "part_no").alias("item"), piece.cast("bigint").alias("size"))
    items = staged(items)
    whole = items.filter(F.col("size") == capacity)
    done = [whole.select("item", "size", F.concat_ws("-", F.lit("full"), F.coalesce("item.id", F.lit("")), F.col("item.part_no")).alias("bin_id"), F.lit(capacity).cast("bigint").alias("filled"))]
    rest = items.filter(F.col("size") < capacity)
    for r in range(rounds):
        laid = staged(_packed(rest, capacity, r + 1))
        if r < rounds - 1:
            good = F.col("filled") >= KEEP * capacity
            done.append(laid.filter(good).select("item", "size", "bin_id", "filled"))
            rest = laid.filter(~good).select("item", "size")
        else:
            done.append(laid.select("item", "size", "bin_id", "filled"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("item.id").cast(kind).alias(item_id), F.col("item.part_no").alias("part_no"), "size", F.col("bin_id").alias("container_id"), "filled")
