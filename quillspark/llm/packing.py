"""Filling containers of fixed capacity with texts of varying length, none split unless it alone is too long.

Variable-capacity best fit on the histogram of lengths: lengths are whole numbers up to the capacity, so the
plan depends on at most that many counts, whatever the corpus.  Longest lengths first, each goes to the open
container with least room; where none has room a container of the length that costs least is opened (its room
and an overhead a container, by the tokens that it can take), and in the end each is downsized to the least
permitted length that holds its contents.  Equal containers are one
group in the plan with a count; items find theirs by their rank among the items of their length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import parts_of, saved


@dataclass
class Segment:
    """Items of one length with ranks from..to go to containers, `each` to a container, from `container` on."""

    length: int
    rank_from: int
    rank_to: int
    each: int
    container: int
    size: int = 0


def plan(histogram: dict[int, int], capacities: list[int], overhead: int = 0) -> tuple[list[Segment], list[tuple[int, int, int, int]]]:
    """Segments of items, and runs of containers (first, last + 1, size, used).  `overhead` is what a container
    costs besides its room: with 0 room alone counts, with the largest capacity the number of containers first."""
    caps = sorted(capacities)
    groups: dict[int, list[tuple[int, int, int, int]]] = {}  # room -> [(first, count, size)]
    rooms: list[int] = []
    segments: list[Segment] = []
    number = 0
    tokens = sum(k * v for k, v in histogram.items() if k > 0)  # still to be laid

    def put(room: int, first: int, count: int, size: int) -> None:
        if count > 0:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, count, size))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count, size = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                # the length that costs least a token if filled with items like this one, or with all that is
                # left if that is less; the larger of two
                size = min((c for c in caps if c >= length), key=lambda c: ((c + overhead) / max(length, min(c - c % length, tokens)), -c))
                room, first = size, number
                count = -(-left // (size // length))
                number += count
            each = room // length
            full = min(count, left // each)
            if full:
                segments.append(Segment(length, rank, rank + full * each, each, first))
                put(room - each * length, first, full, size)
                rank, left, tokens = rank + full * each, left - full * each, tokens - full * each * length
            if left and full < count:
                segments.append(Segment(length, rank, rank + left, left, first + full))
                put(room - left * length, first + full, 1, size)
                rank, left, tokens, full = rank + left, 0, tokens - left * length, full + 1
            put(room, first + full, count - full, size)
    runs = []
    for room, gs in groups.items():
        for first, count, size in gs:
            used = size - room
            runs.append((first, first + count, min(c for c in caps if c >= used), used))
    runs.sort()
    return sized(segments, runs), runs


def sized(segments: list[Segment], runs: list[tuple[int, int, int, int]]) -> list[Segment]:
    """Segments cut where the final size of their containers changes."""
    same: list[list[int]] = []
    for a, b, size, _ in runs:
        if same and same[-1][2] == size and same[-1][1] == a:
            same[-1][1] = b
        else:
            same.append([a, b, size])
    starts, out = [a for a, _, _ in same], []
    for s in segments:
        end = s.container - (s.rank_from - s.rank_to) // s.each
        for a, b, size in same[bisect_right(starts, s.container) - 1 : bisect_left(starts, end)]:
            lo, hi = max(a, s.container), min(b, end)
            first = s.rank_from + (lo - s.container) * s.each
            out.append(Segment(s.length, first, min(s.rank_to, s.rank_from + (hi - s.container) * s.each), s.each, lo, size))
    return out


def pack(items: DataFrame, capacities: list[int], key: str = "doc_id", tokens: str = "n_tokens", overhead: int = 0) -> DataFrame:
    """key, piece, first_token, n_tokens, container_id, container_size for each piece of each item.

    A length over the largest capacity is split into full containers and a rest.  Items without tokens (and
    null lengths) take no room and stand in container 0, with container_size as it is there (the least
    capacity if there is no other).  Keys may repeat: each row is an item of its own.  An empty table gives
    no row.  Which of the items of one length goes where is decided by a hash of the key.
    """
    spark = items.sparkSession
    top = max(capacities)
    n = F.coalesce(F.col(tokens), F.lit(0)).cast("bigint")
    pieces = F.sequence(F.lit(0), F.greatest(F.call_function("div", F.col("_n") - 1, F.lit(top)), F.lit(0)))
    x = items.select(F.col(key), n.alias("_n")).select(key, "_n", F.explode(pieces).alias("piece"))
    x = x.withColumn("first_token", F.col("piece") * top).withColumn("n_tokens", F.least(F.col("_n") - F.col("first_token"), F.lit(top)).cast("int")).drop("_n")
    x = saved(x)
    # a length may hold a third of all items: its ranks are counted in parts
    x = x.withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), F.lit(parts_of(x))).cast("int"))
    parts = x.groupBy("n_tokens", "_salt").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = saved(parts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))))
    histogram = {r["n_tokens"]: r["n"] for r in parts.groupBy("n_tokens").agg(F.sum("_c").alias("n")).collect()}  # at most top + 1 rows
    segments, runs = plan(histogram, capacities, overhead)
    # a length adds at most as many segments as groups of containers it meets: the capacity bounds the table, not the corpus
    seg = spark.createDataFrame(
        [(s.length, s.rank_from, s.rank_to, s.each, s.container, s.size) for s in segments], "sl int, s_from long, s_to long, s_each long, s_first long, container_size int"
    )
    zero = next((size for a, _, size, _ in runs if a == 0), min(capacities))
    rank = F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(key, "piece")) - 1
    y = x.withColumn("_r", rank).join(parts.drop("_c"), ["n_tokens", "_salt"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    y = y.join(F.broadcast(seg), (F.col("n_tokens") == F.col("sl")) & (F.col("_rank") >= F.col("s_from")) & (F.col("_rank") < F.col("s_to")), "left")
    container = F.when(F.col("n_tokens") <= 0, F.lit(0)).otherwise(F.col("s_first") + F.call_function("div", F.col("_rank") - F.col("s_from"), F.col("s_each")))
    return y.select(key, "piece", "first_token", "n_tokens", container.cast("bigint").alias("container_id"), F.coalesce("container_size", F.lit(zero)).alias("container_size"))


def container_report(packed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """containers, tokens, room, share of room left: of the whole packing (or by the given columns)."""
    keys = by or []
    each = packed.groupBy(*keys, "container_id").agg(F.sum("n_tokens").alias("used"), F.max("container_size").alias("size"))
    return each.groupBy(*keys).agg(
        F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("size").alias("room"), (1 - F.sum("used") / F.sum("size")).alias("room_left_share")
    )
