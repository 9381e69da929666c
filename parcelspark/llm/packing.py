"""Items of varying length in containers of fixed capacity with little room left (problem 7).

What goes where depends on sizes alone, and there are at most `capacity` of them. So the sizes are
counted first; a plan over sizes says how many items of each size go to which range of
containers; then every item looks up its container by its rank among the items of its size.
The plan pairs items above a third of the capacity (at most two fit a container), largest
first with the largest partner that fits, and lets smaller ones, largest first, fill the
tightest gaps.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Items of one size are ranked in this many parts at least, and in parts of about PART items; a plan that is not broadcast is joined in SALTS parts.
PARTS, PART, SALTS = 32, 100_000, 32
#: A plan of at most so many rows is broadcast; it has a few rows per distinct size, however many items.
BROADCAST_ROWS = 500_000
PLAN = "spec_id int, n_tokens bigint, first bigint, last bigint, container bigint, per bigint"


def plan(capacity: int, counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(size, first, last, container, per): items first..last-1 of a size go, `per` at a time, to container, container + 1, ...

    counts: items by size, each size from 0 to capacity. Items of size 0 are spread over
    the containers that the others need (over one if there are none).
    """
    out: list[tuple[int, int, int, int, int]] = []
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    opened = 0

    def put(size: int, n: int, container: int, per: int) -> None:
        out.append((size, used[size], used[size] + n, container, per))
        used[size] += n
        left[size] -= n

    def leave(gap: int, container: int, n: int) -> None:
        if n and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((container, n))

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        at = bisect_right(large, capacity - size) - 1
        mate = large[min(at, len(large) - 1)] if at >= 0 else None
        if mate == size and left[size] == 1:
            mate = large[-2] if len(large) > 1 else None
        if mate is None:
            n = left[size]
            put(size, n, opened, 1)
            leave(capacity - size, opened, n)
        elif mate == size:
            n = left[size] // 2
            put(size, 2 * n, opened, 2)
            leave(capacity - 2 * size, opened, n)
        else:
            n = min(left[size], left[mate])
            put(size, n, opened, 1)
            put(mate, n, opened, 1)
            leave(capacity - size - mate, opened, n)
        opened += n
        for s in {size, mate} if mate is not None else {size}:
            if not left[s]:
                del large[bisect_left(large, s)]

    for size in sorted((s for s in left if 0 < 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(order, size)
            if at == len(order):
                per, gap = capacity // size, capacity
                container, free = opened, -(-left[size] // per)
                opened += free
            else:
                gap = order[at]
                per = gap // size
                container, free = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            full = min(free, left[size] // per)
            if full:
                put(size, full * per, container, per)
                leave(gap - per * size, container, full)
            if full < free and left[size]:
                rest = left[size]
                put(size, rest, container + full, rest)
                leave(gap - rest * size, container + full, 1)
                full += 1
            leave(gap, container + full, free - full)
    if left.get(0):
        put(0, left[0], 0, -(-left[0] // max(1, opened)))
    return out


def pack(sizes: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """spec_id, key, piece, first_token, n_tokens, container: where each item goes for each capacity.

    specs: spec_id, capacity, a small table, broadcast as one row; of a repeated spec_id the least capacity holds. An item above
    the capacity is cut into pieces of just the capacity and a rest, numbered from 0; no other
    item is cut. An item of size 0 (a null counts as 0, and so does a negative size) has one piece
    without tokens. Rows with a null or repeated key are items like any other. A spec with a
    null or non-positive capacity gives no row; neither does an empty table of items.
    """
    known = specs.where(F.col("capacity") > 0).groupBy(F.col("spec_id").cast("int").alias("spec_id")).agg(F.min(F.col("capacity").cast("bigint")).alias("capacity"))
    each = known.groupBy(F.lit(1).alias("_one")).agg(F.collect_list(F.struct("spec_id", "capacity")).alias("_specs"))
    whole = sizes.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_whole"), F.lit(1).alias("_one"))
    whole = whole.join(F.broadcast(each), "_one").select("_key", "_whole", F.explode("_specs").alias("s"))
    pieces = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("_whole") / F.col("s.capacity")) - 1, F.lit(0)).cast("bigint"))
    cut = whole.select(F.col("s.spec_id").alias("spec_id"), F.col("s.capacity").alias("capacity"), "_key", "_whole", F.explode(pieces).alias("piece"))
    items = cut.select("spec_id", "capacity", "_key", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.least(F.col("capacity"), F.col("_whole") - F.col("piece") * F.col("capacity")).alias("n_tokens"))

    counts = items.groupBy("spec_id", "capacity", "n_tokens").agg(F.count(F.lit(1)).alias("n"))

    def planned(group: pd.DataFrame) -> pd.DataFrame:  # at most capacity + 1 rows
        rows = plan(int(group["capacity"].iloc[0]), dict(zip(group["n_tokens"].tolist(), group["n"].tolist())))
        return pd.DataFrame(rows, columns=["n_tokens", "first", "last", "container", "per"]).assign(spec_id=int(group["spec_id"].iloc[0]))[["spec_id", "n_tokens", "first", "last", "container", "per"]]

    plans = written(counts.groupBy("spec_id").applyInPandas(planned, PLAN), "plan")
    facts = plans.agg(F.count(F.lit(1)), F.sum(F.col("last") - F.col("first"))).first()
    parts = max(PARTS, (facts[1] or 0) // PART)

    # Rank of an item among those of its size: ranks within parts, and where each part begins.
    salted = items.withColumn("part", F.pmod(F.xxhash64("_key", "piece"), F.lit(parts)))
    held = salted.groupBy("spec_id", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    by_size = Window.partitionBy("spec_id", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.select("spec_id", "n_tokens", "part", F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("begin"))
    by_part = Window.partitionBy("spec_id", "n_tokens", "part").orderBy("_key", "piece")
    ranked = salted.withColumn("rank", F.row_number().over(by_part) - 1).join(begins, ["spec_id", "n_tokens", "part"])
    ranked = ranked.withColumn("at", F.col("begin") + F.col("rank"))
    ranges = F.array_sort(F.collect_list(F.struct("first", "container", "per"))).alias("ranges")  # one row a size, so an item meets one row
    side = plans.groupBy(F.col("spec_id").alias("_s"), F.col("n_tokens").alias("_t")).agg(ranges)
    on = (F.col("spec_id") == F.col("_s")) & (F.col("n_tokens") == F.col("_t"))
    if facts[0] <= BROADCAST_ROWS:
        side = F.broadcast(side)
    else:  # a size may hold a third of the items
        side, on = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), on & (F.pmod("part", F.lit(SALTS)) == F.col("_salt"))
    placed = ranked.join(side, on).withColumn("r", F.element_at(F.filter("ranges", lambda r: r["first"] <= F.col("at")), -1))
    return placed.select("spec_id", F.col("_key").alias(key), "piece", "first_token", "n_tokens", (F.col("r.container") + F.floor((F.col("at") - F.col("r.first")) / F.col("r.per"))).alias("container"))


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Containers, tokens, the least number of containers that the tokens need, and the share of room used, by spec.

    Containers are numbered without gaps from 0, so their number is one more than the greatest.
    """
    sums = packed.groupBy("spec_id").agg((F.max("container") + 1).alias("containers"), F.sum("n_tokens").alias("tokens"))
    joined = sums.join(specs.select("spec_id", "capacity"), "spec_id")
    return joined.select("spec_id", "capacity", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"))


def faults(packed: DataFrame, sizes: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """spec_id, documents, overfull (containers above the capacity), torn (items cut though they fit), lost (items whose tokens don't come out just once); key is unique.

    sizes: tokenizer, key, size. A packing without faults has 0 in the last three.
    """
    known = specs.where(F.col("capacity") > 0).select("spec_id", "tokenizer", "capacity")
    load = packed.groupBy("spec_id", "container").agg(F.sum("n_tokens").alias("load")).join(F.broadcast(known), "spec_id")
    overfull = load.groupBy("spec_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))
    pieces = packed.groupBy("spec_id", key).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("held"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end")).join(F.broadcast(known), "spec_id")
    want = sizes.select("tokenizer", key, F.col(size).alias("want"))
    rows = pieces.join(want, ["tokenizer", key], "full")
    wrong = F.coalesce((F.col("held") != F.col("want")) | (F.col("end") != F.col("want")), F.lit(True))
    by = rows.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("want") <= F.col("capacity"))).alias("torn"), F.count_if(wrong).alias("lost"))
    return by.join(overfull, "spec_id", "left").select("spec_id", "documents", "overfull", "torn", "lost")
