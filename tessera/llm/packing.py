"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents are tokenised once, cut into pieces, and the pieces written to the shared folder. Pieces of one length are
interchangeable, so the packing is solved on the histogram of lengths (at most `capacity` numbers): bins with the
same contents form one group with a multiplicity. Best-fit decreasing builds the groups; local search then moves
documents, or exchanges one for one, two for one or one for two, between underfull bins whenever that raises the sum
of squared fills, which drains the emptier bins until they vanish. Pieces then find their place by their rank among those of
their length, a prefix sum over the parts the pieces were written in.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import lean, materialize, small_batches
from tessera.llm.tokens import DEFAULT_VOCABULARY, worker_encoder

Group = tuple[tuple[int, ...], int]  # lengths in a bin, number of such bins
PIECES = "doc_id long, piece int, start long, length int, ids binary, ids_crc32 long, part int, nth long"


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but the first, which may be shorter."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing over lengths with multiplicities."""
    room: dict[int, list[Group]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = min((r for r in room if r >= length and room[r]), default=None)
            if free is None:
                items, bins, free = (), -(-left // (capacity // length)), capacity
            else:
                items, bins = room[free].pop()
            each = free // length
            full = min(bins, left // each)
            if full:
                room[free - each * length].append((items + (length,) * each, full))
                left -= full * each
            if full < bins and left and items == () and free == capacity:
                room[capacity - left * length].append(((length,) * left, 1))
                left = 0
            elif full < bins:
                rest = bins - full
                if 0 < left < each:
                    room[free - left * length].append((items + (length,) * left, 1))
                    left, rest = 0, rest - 1
                if rest:
                    room[free].append((items, rest))
    return _merged(g for groups in room.values() for g in groups)


def _merged(groups) -> list[Group]:
    total: dict[tuple[int, ...], int] = defaultdict(int)
    for items, n in groups:
        if items and n:
            total[tuple(sorted(items, reverse=True))] += n
    return sorted(total.items(), key=lambda g: (sum(g[0]), g[0]))


def _parts(items: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Nothing, one document or two of a bin."""
    ones = sorted(set(items))
    twos = {tuple(sorted((a, b))) for i, a in enumerate(items) for b in items[i + 1 :]}
    return [(), *((x,) for x in ones), *sorted(twos)]


def _without(items: tuple[int, ...], gone: tuple[int, ...]) -> tuple[int, ...]:
    kept = list(items)
    for x in gone:
        kept.remove(x)
    return tuple(kept)


def improve(groups: list[Group], capacity: int) -> list[Group]:
    """Local search to its end: no exchange between underfull bins raises the squared fill, or no packing has fewer bins."""
    bins = dict(groups)
    least = -(-sum(sum(g) * n for g, n in groups) // capacity)
    by_fill = lambda g: (sum(g), g)
    while sum(bins.values()) > least:
        under = sorted((g for g in bins if sum(g) < capacity), key=by_fill)
        sides = [(g, sum(g), [(sum(p), p) for p in _parts(g)]) for g in under]
        best = None
        for giver, fill, offers in sides:
            for taker, full, backs in reversed(sides):
                if full < fill:
                    break
                if taker == giver and bins[giver] < 2:
                    continue
                free = capacity - full
                for give, p in offers[1:]:
                    for take, q in backs:
                        # Moves: 1-0, 2-0; exchanges: 1-1, 2-1, 1-2. The taker's fill must rise.
                        gain = give - take
                        if 0 < gain <= free and len(p) + len(q) <= 3:
                            rise = 2 * gain * (full - fill + gain)
                            emptied = fill - gain == 0
                            if best is None or (emptied, rise) > best[0]:
                                best = ((emptied, rise), giver, taker, p, q)
            if best is not None:
                break
        if best is None:
            break
        _, giver, taker, p, q = best
        n = min(bins[giver], bins[taker]) if giver != taker else bins[giver] // 2
        for g in (giver, taker):
            bins[g] -= n
            if not bins[g]:
                del bins[g]
        for g in (tuple(sorted(_without(giver, p) + q, reverse=True)), tuple(sorted(_without(taker, q) + p, reverse=True))):
            if g:
                bins[g] = bins.get(g, 0) + n
    return _merged(bins.items())


def tokenised(vocabulary: str, end_id: int, capacity: int):
    """A mapInArrow function: (doc_id, text) to pieces; nth counts the pieces of one length within the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
    tail = np.uint32(end_id).tobytes()

    def run(batches):
        seen: dict[int, int] = defaultdict(int)
        part, encoder = TaskContext.get().partitionId(), worker_encoder(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids, start = ids + tail, 0
                for i, n in enumerate(cut(len(ids) // 4, capacity)):
                    piece = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, i, start, n, piece, zlib.crc32(piece), part, seen[n]))
                    seen[n] += 1
                    start += n
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """All pieces of docs: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), ids_crc32, sequence_id, offset.

    A null or empty text is a document of end_id alone. Rows that share an id, or have none, are separate documents.
    Empty tables give no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        pieces = materialize(given.mapInArrow(lean(tokenised(vocabulary, end_id, capacity)), PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    groups = improve(best_fit(histogram, capacity), capacity)
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: first rank, first sequence, offset
    taken: dict[int, int] = defaultdict(int)
    base = 0
    for items, n in groups:
        at = 0
        for x in items:
            places[x].append((taken[x], base, at))
            taken[x] += n
            at += x
        base += n
    rows = [(x, *map(list, zip(*p, strict=True))) for x, p in places.items()]
    plan = spark.createDataFrame(rows, "length int, _ranks array<bigint>, _bases array<bigint>, _offsets array<int>")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("nth"))
    # One row per length and one place (20 bytes) per item of a group: broadcast up to 20 MB, joined by a shuffle beyond it.
    plan = F.broadcast(plan) if sum(map(len, places.values())) <= 1 << 20 else plan
    placed = ranked.join(plan, "length").withColumn("_i", F.size(F.filter("_ranks", lambda r: r <= F.col("_rank"))))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids",
        "ids_crc32",
        (F.element_at("_bases", F.col("_i")) + F.col("_rank") - F.element_at("_ranks", F.col("_i"))).alias("sequence_id"),
        F.element_at("_offsets", F.col("_i")).cast("long").alias("offset"),
    )
