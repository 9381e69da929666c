"""Clusters cut into several parts, and parts that join a neighbouring cluster; all runs and particles at once.

Parts and candidates have the forms of moves: parts go through moves.cut, which yields pieces (the
components of the parts) as candidates; join_one and join_in_turn make further candidates of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .compare import kmeans_path, spectral_path
from .moves import valued


def narrow(n: int) -> int:
    """Most parts of a cluster of n units in the model with slopes: 2, or ceil(0.1 √n) - 1 where that is more."""
    return max(2, math.ceil(0.1 * math.sqrt(n)) - 1)


def wide_up(n: int) -> int:
    """Most spectral parts in the model with levels alone: ceil(√n), at most 5."""
    return min(5, math.ceil(math.sqrt(n)))


def wide_down(n: int) -> int:
    """Most k-means parts in the model with levels alone: floor(√n), at most 5."""
    return min(5, math.isqrt(n))


def _valued(assignment: DataFrame, values: DataFrame | None, keys: list[str]) -> DataFrame:
    return valued(assignment, values, keys).select(*keys, "unit_id", "cluster_id", "value").where(F.col("value").isNotNull())


def kmeans_parts(assignment: DataFrame, values: DataFrame, keys: list[str], most: Callable[[int], int] = narrow) -> DataFrame:
    """Parts: every cluster in its best k classes of value, k = 2..most(n), k < n; clusters whose values are all equal have none."""
    own = Window.partitionBy(*keys, "cluster_id")
    spread = F.max("value").over(own) - F.min("value").over(own)
    rows = _valued(assignment, values, keys).withColumns({"_spread": spread, "_n": F.count(F.lit(1)).over(own)}).where((F.col("_spread") > 0) & (F.col("_n") > 2))
    rows = rows.select(*keys, F.col("cluster_id").alias("_parent"), "unit_id", "value")
    made = kmeans_path(rows, [*keys, "_parent"], lambda n: min(most(n), n - 1)).where("k > 1")
    return made.select(*keys, F.concat_ws(":", F.lit("kmeans"), "_parent", "k").alias("cand"), "unit_id", F.col("cluster_id").alias("part"))


def packed_values(assignment: DataFrame, values: DataFrame, neighbours: DataFrame, keys: list[str]) -> DataFrame:
    """Clusters as rows for spectral_path: keys, cluster_id, members. neighbours: unit_id, neighbours."""
    member = F.struct(F.col("unit_id").cast("int").alias("unit_id"), "value", "neighbours")
    rows = _valued(assignment, values, keys).join(neighbours, "unit_id", "left")
    return rows.groupBy(*keys, "cluster_id").agg(F.array_sort(F.collect_list(member), lambda p, q: p["unit_id"] - q["unit_id"]).alias("members"))


def spectral_cuts(assignment: DataFrame, values: DataFrame, neighbours: DataFrame, keys: list[str], most: Callable[[int], int] = narrow) -> DataFrame:
    """Parts: every cluster in k spectral parts, k = 2..most(n), k < n."""
    made = spectral_path(packed_values(assignment, values, neighbours, keys), keys, lambda n: range(2, most(n) + 1))
    return made.select(*keys, F.concat_ws(":", F.lit("spectral"), "cluster_id", "k").alias("cand"), "unit_id", "part")


def both_tails(assignment: DataFrame, values: DataFrame, keys: list[str], share: float = 0.025) -> DataFrame:
    """Parts: of each cluster of over one unit the ceil(share · n) lowest units, the highest, and both, each beside the rest; of equals the lower unit_id is lower.

    In a cluster of two units the three are one and the same cut.
    """
    w = Window.partitionBy(*keys, "cluster_id")
    rows = _valued(assignment, values, keys).withColumns({"_rank": F.row_number().over(w.orderBy("value", "unit_id")), "_n": F.count(F.lit(1)).over(w)}).where("_n > 1")
    few = F.ceil(F.col("_n") * share)
    low, high = (F.col("_rank") <= few).cast("int"), (F.col("_rank") > F.col("_n") - few).cast("int")
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), part.alias("part")) for name, part in (("left", low), ("right", high), ("both", low + 2 * high))])).alias("_kind")
    return rows.select(*keys, "cluster_id", "unit_id", kinds).select(*keys, F.concat_ws(":", F.lit("ends"), "cluster_id", "_kind.name").alias("cand"), "unit_id", F.col("_kind.part").alias("part"))


def nearest_outside(edges: DataFrame, assignment: DataFrame, values: DataFrame | None, keys: list[str], pieces: DataFrame) -> DataFrame:
    """keys, cand, piece, to: for each piece of a cut cluster the other cluster that touches it and whose mean is nearest; the least id of equals; none where no other touches it.

    pieces: candidates that touch one cluster each (keys, cand, unit_id, cluster_id).
    """
    by = [*keys, "cand"]
    was = assignment.select(*keys, "unit_id", F.col("cluster_id").alias("_was"))
    means = _valued(assignment, values, keys).groupBy(*keys, F.col("cluster_id").alias("to")).agg(F.avg("value").alias("_other"))
    own = valued(pieces, assignment.select(*keys, "unit_id", "value") if values is None else values, keys)
    own = own.groupBy(*by, F.col("cluster_id").alias("piece")).agg(F.avg("value").alias("_own"))
    ends = pieces.join(was, [*keys, "unit_id"]).select(*by, F.col("cluster_id").alias("piece"), F.col("unit_id").alias("src"), "_was")
    far = assignment.select(*keys, F.col("unit_id").alias("dst"), F.col("cluster_id").alias("to"))
    touching = ends.join(edges.select("src", "dst"), "src").join(far, [*keys, "dst"]).where(F.col("to") != F.col("_was")).select(*by, "piece", "to").distinct()
    gaps = touching.join(means, [*keys, "to"]).join(own, [*by, "piece"])
    return gaps.groupBy(*by, "piece").agg(F.min_by("to", F.struct(F.abs(F.col("_own") - F.col("_other")), "to")).alias("to"))


def _joined(assignment: DataFrame, keys: list[str], pieces: DataFrame, merges: DataFrame) -> DataFrame:
    """Candidates from merges (keys, cand, new, piece, to): in candidate new the pieces listed belong to the clusters to, which it then touches as well."""
    by = [*keys, "cand"]
    label = assignment.groupBy(*keys, F.col("cluster_id").alias("to")).agg((-F.min("unit_id")).alias("_label"))  # no piece has it: its units are outside
    merges = merges.join(label, [*keys, "to"])
    named = merges.select(*by, "new").distinct()
    stay = named.join(pieces, by).join(merges.select(*by, "new", F.col("piece").alias("cluster_id"), "_label"), [*by, "new", "cluster_id"], "left")
    stay = stay.select(*keys, F.col("new").alias("cand"), "unit_id", F.coalesce("_label", "cluster_id").alias("cluster_id"))
    outside = merges.select(*keys, "new", "to", "_label").distinct().join(assignment.select(*keys, F.col("cluster_id").alias("to"), "unit_id"), [*keys, "to"])
    return stay.unionByName(outside.select(*keys, F.col("new").alias("cand"), "unit_id", F.col("_label").alias("cluster_id")))


def join_one(assignment: DataFrame, keys: list[str], pieces: DataFrame, nearest: DataFrame) -> DataFrame:
    """Candidates: a cut, and one of its pieces joins its nearest_outside. Pieces that are not in nearest never join."""
    return _joined(assignment, keys, pieces, nearest.withColumn("new", F.concat_ws(">", "cand", "piece")))


def join_all(assignment: DataFrame, keys: list[str], pieces: DataFrame, nearest: DataFrame) -> DataFrame:
    """Candidates: a cut, and all of its pieces that have a nearest_outside join it at once."""
    return _joined(assignment, keys, pieces, nearest.withColumn("new", F.concat("cand", F.lit(">>all"))))


def join_in_turn(assignment: DataFrame, keys: list[str], pieces: DataFrame, nearest: DataFrame) -> DataFrame:
    """Candidates: a cut, and its first 1, 2, ... pieces that have a nearest_outside join it, in the order of the pieces' least units."""
    w = Window.partitionBy(*keys, "cand")
    ranked = nearest.withColumns({"_rank": F.row_number().over(w.orderBy(F.desc("piece"))), "_all": F.count(F.lit(1)).over(w)})
    upto = ranked.withColumn("_upto", F.explode(F.sequence(F.col("_rank"), F.col("_all").cast("int"))))
    return _joined(assignment, keys, pieces, upto.withColumn("new", F.concat_ws(">>", "cand", "_upto")).drop("_rank", "_all", "_upto"))
