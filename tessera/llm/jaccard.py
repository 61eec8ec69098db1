"""Exact n-gram Jaccard join and its classes, by parity sketches and the pigeonhole principle.

A document is the set of its distinct 5-word shingles, hashed to 64 bits. Sets A and B link when J(A, B) >= 0.8, which
bounds their symmetric difference by a quarter of the smaller one. A sketch toggles one parity bit for every hash, so
the Hamming distance of two sketches is a lower bound of the symmetric difference. For the join a sketch of a size
band has about a third as many segments as sets have hashes, each 2**32 bits wide and held as the XOR of its hashes'
mixes: its signature. Sets that differ in k hashes differ in k segments at most, so they share a non-empty segment,
even among the k + 1 heaviest of each set (prefix principle; the order is by hashes in the segment, as what few hashes
give, many unrelated documents have). Those signatures are joined per size band; what meets is verified on the words
of the whole texts.

Groups are never expanded into all pairs. In a few rounds every document is verified against one partner, the centre of
most of its signature groups. Only groups that then still hold several components are compared further, in blocks,
and only pairs whose narrow sketches' Hamming distance allows a link are verified.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.files import load, runs, save
from tessera.llm.graph import components
from tessera.llm.shared import fresh_path, lean, materialize, side_files, small_batches
from tessera.llm.words import LOWER, mix, shingle_sets

WORDS = 5
BLOCK = 1024  # documents of one signature group compared at once; larger groups are cut into blocks
CHUNK = 256  # documents verified against one centre in one task
SKETCH = "doc_id long, n_shingles long, set_hash binary, keys array<bigint>, sketch binary"
_SALT = np.uint64(0x9FB21C651E98DF25)


def _edges() -> list[int]:
    """The least sizes of the bands: a set's partners of its size or more lie in its band or the next."""
    out = [1, 2]
    while out[-1] < 1 << 48:
        out.append(max(out[-1] + 1, 5 * (out[-1] - 1) // 4 + 1))
    return out


EDGES = _edges()


def segments(band: int) -> int:
    """Segments of a band's sketches: a third of its largest sets' hashes, so that more than a quarter stay non-empty."""
    return -(-34 * (EDGES[band + 1] - 1) // 100) + 2


def segment_keys(found: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For both bands of a sorted set of hashes, its own and the one below: k, the signatures of its non-empty segments, and how many hashes each has."""
    if not len(found):
        return []
    own = bisect_right(EDGES, len(found)) - 1
    scattered, out = mix(found ^ _SALT), []
    for band in (own, own - 1):
        if band < 0:
            continue
        # Sorted hashes fall into segments in order, so a segment is a run.
        segment = ((found >> np.uint64(32)) * np.uint64(segments(band))) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        weight = np.diff(np.append(starts, len(found)))
        keys = mix(np.bitwise_xor.reduceat(scattered, starts) + segment[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band << 40))
        # The smaller set of a linked pair has its size in this band, and the sets differ in a quarter of it at most.
        k = min(len(found), EDGES[band + 1] - 1) // 4
        if len(keys) <= k:  # too few segments for the principle: every hash is a key as well
            keys = np.concatenate([keys, mix(scattered + np.uint64(band))])
            weight, k = np.concatenate([weight, np.ones(len(found), np.int64)]), len(keys)
        out.append((k, keys, weight))
    return out


def signatures(found: np.ndarray) -> np.ndarray:
    """The join keys of a set: per size band its k + 1 first signatures, those of many hashes before those of few."""
    out = []
    for k, keys, weight in segment_keys(found):
        if len(keys) > k + 1:
            order = (keys >> np.uint64(8)) | ((np.uint64(255) - np.minimum(weight, 255).astype(np.uint64)) << np.uint64(56))
            keys = keys[np.argpartition(order, k)[: k + 1]]
        out.append(keys)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def parity_sketch(found: np.ndarray) -> np.ndarray:
    """2n to 4n parity bits of a set of n hashes, as bytes: each hash toggles one."""
    bits = max(64, 1 << (len(found).bit_length() + 1))
    hit = np.bincount((mix(found) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hit.astype(bool), bitorder="little")


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch of `size` bytes from a larger one: its parts XORed."""
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def _set_hash(found: np.ndarray) -> bytes | None:
    return np.array([mix(found + _SALT).sum(), np.bitwise_xor.reduce(mix(found)), len(found)], np.uint64).tobytes() if len(found) else None


def set_hash(text: Column) -> Column:
    """The hash of a text's shingle set, as in the sketches; null for a text without shingles."""
    return F.arrow_udf(lambda texts: pa.array([_set_hash(x) for x in shingle_sets(texts, WORDS)], pa.binary()), "binary")(text)


def _sketches(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hash", pa.binary()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary())])
    for batch in batches:
        for s in range(0, batch.num_rows, 512):
            some = batch.slice(s, 512)
            sizes, hashes, keys, sketch = [], [], [], []
            for found in shingle_sets(some.column(1), WORDS):
                sizes.append(len(found))
                hashes.append(_set_hash(found))
                keys.append(signatures(found))
                sketch.append(parity_sketch(found).tobytes() if len(found) else b"")
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32), pa.array(np.concatenate(keys)))
            yield pa.record_batch([some.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), lists, pa.array(sketch, pa.binary())], schema=schema)


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_TABLE = LOWER.tobytes()


def shingle_words(text: str | None) -> set[tuple[bytes, ...]]:
    """The shingles of a text as tuples of their words."""
    found = (text or "").encode().translate(_TABLE).split()  # splits at 20 and 09 to 0D
    return set(zip(*(found[k:] for k in range(WORDS)))) if len(found) >= WORDS else {tuple(found)} if found else set()


def _verified(batches):
    """Links of sorted (cell, is_member, doc_id, text): the centres come first in their cell. Decided on words."""
    cell, centres = None, []
    for batch in batches:
        cells, members, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "is_member", "doc_id"))
        out: list[tuple[int, int]] = []
        for i, text in enumerate(batch.column("text").to_pylist()):
            if cells[i] != cell:
                cell, centres = cells[i], []
            found = shingle_words(text)
            if not members[i]:
                centres.append((ids[i], found))
                continue
            for centre, base in centres:
                both = len(base & found)
                if both and 100 * both >= 80 * (len(base) + len(found) - both):
                    out.append((centre, ids[i]))
        if out:
            yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=PAIR)


#: Ids or keys that are broadcast at most (8 bytes each); beyond, tables are joined by a shuffle.
BROADCAST_IDS = 1 << 19


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose whole texts link, from docs (doc_id, text).

    Members are checked against their centre a in chunks; a centre's text goes to each of its chunks once.
    """
    pairs = materialize(pairs, "pairs", small=True)
    chunks = materialize(pairs.groupBy(F.col("a").alias("of")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")), "chunks", small=True)
    # Broadcast where they are few, so that the members of a large centre stay spread.
    chunks = F.broadcast(chunks) if chunks.count() <= BROADCAST_IDS else chunks
    chunk = F.pmod(F.xxhash64("b"), F.col("chunks"))
    members = pairs.join(chunks, F.col("a") == F.col("of")).select("a", F.col("b").alias("doc_id"), F.xxhash64("a", chunk).alias("cell"), F.lit(True).alias("is_member"))
    centres = members.select("a", F.col("a").alias("doc_id"), "cell", F.lit(False).alias("is_member")).distinct()
    wanted = materialize(members.unionAll(centres).select("cell", "is_member", "doc_id"), "wanted", small=True)
    ids = wanted.select("doc_id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    texts = docs.join(wanted, "doc_id").select("cell", "is_member", "doc_id", "text")
    dealt = texts.repartition("cell").sortWithinPartitions("cell", "is_member", "doc_id")
    return materialize(dealt.mapInArrow(lean(_verified), "a long, b long"), "links", small=True)


def _compared(i: np.ndarray, j: np.ndarray, size: np.ndarray, sketches: list[np.ndarray]) -> np.ndarray:
    """Which of the pairs of documents their sketches let link."""
    width = np.array([len(x) for x in sketches])
    least, kept = np.minimum(width[i], width[j]), []
    for w in np.unique(least).tolist():
        of_width = np.flatnonzero(least == w)
        row = np.full(len(width), -1)
        used = np.unique(np.concatenate([i[of_width], j[of_width]]))
        row[used] = np.arange(len(used))
        table = np.stack([folded(sketches[d], w) for d in used.tolist()]).view(np.uint64)
        step = max(1, (1 << 23) // w)
        for s in range(0, len(of_width), step):
            part = of_width[s : s + step]
            apart = np.bitwise_count(table[row[i[part]]] ^ table[row[j[part]]]).sum(axis=1, dtype=np.int64)
            kept.append(part[9 * apart <= size[i[part]] + size[j[part]]])
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


PAIRS_AT_ONCE = 1 << 20


def _near(batches):
    """Pairs that lie in different components and may link, from sorted rows (cell, side, doc_id, component, n_shingles, sketch).

    side: 2 where a block meets itself, else 0 and 1 for the two blocks that meet.
    """
    for _, rows in runs(batches, "cell"):
        side, doc, component, size = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("side", "doc_id", "component", "n_shingles"))
        sketches = [np.frombuffer(x.as_buffer(), np.uint8) for x in rows.column("sketch")]
        itself = side[0] == 2
        left, right = (np.arange(len(side)),) * 2 if itself else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
        for s in range(0, len(left), step):
            i, j = (x.ravel() for x in np.meshgrid(left[s : s + step], right, indexing="ij"))
            fits = (component[i] != component[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j]))
            if itself:
                fits &= i < j
            i, j = i[fits], j[fits]
            kept = _compared(i, j, size, sketches) if len(i) else i
            if len(kept):
                a, b = doc[i[kept]], doc[j[kept]]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=PAIR)


STAR_ROUNDS = 3
#: Documents behind one file of copies' ids.
COPY_SHARD = 1 << 20


def _saved_ids(path: str):
    """Save each shard's document ids as a sorted array."""

    def run(batches):
        for shard, rows in runs(batches, "shard"):
            save(f"{path}/copies-{shard}", [np.unique(rows.column("doc_id").to_numpy())])
            yield pa.RecordBatch.from_pylist([{"shard": int(shard)}], schema=pa.schema([("shard", pa.int64())]))

    return run


def _exploded(path: str, there: list[int]):
    """(doc_id, n_shingles, key) for every signature of the documents that are no copies."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64())])

    def run(batches):
        for batch in batches:
            ids, shard = batch.column("doc_id").to_numpy(), batch.column("shard").to_numpy()
            keep = np.ones(len(ids), bool)
            for k in set(np.unique(shard).tolist()) & set(there):
                own = np.flatnonzero(shard == k)
                (copies,) = load(f"{path}/copies-{k}")
                keep[own] = copies[np.minimum(np.searchsorted(copies, ids[own]), len(copies) - 1)] != ids[own]
            some = batch.filter(pa.array(keep))
            if some.num_rows:
                lists = some.column("keys")
                n = np.diff(lists.offsets.to_numpy())
                yield pa.record_batch([pa.array(np.repeat(some.column("doc_id").to_numpy(), n)), pa.array(np.repeat(some.column("n_shingles").to_numpy(), n)), lists.flatten()], schema=schema)

    return run


def still_open(rows: DataFrame) -> DataFrame:
    """Rows (key, doc_id, n_shingles, component) of the signature groups that hold several components."""
    spread = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return rows.join(spread, "key", "left_semi")


def star_pairs(rows: DataFrame) -> DataFrame:
    """For each document one partner (a, b): of the centres of its groups, the one that it meets most often.

    A group's centre is the document that shares most signatures, as an original does with its edited copies.
    """
    weight = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_w"))
    order = Window.partitionBy("key").orderBy(F.desc("_w"), "doc_id")
    first = F.first(F.struct("doc_id", "n_shingles", "component")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    met = rows.join(weight, "doc_id").withColumn("c", first)
    fits = 5 * F.least("c.n_shingles", "n_shingles") >= 4 * F.greatest("c.n_shingles", "n_shingles")
    met = met.filter((F.col("c.component") != F.col("component")) & fits)
    votes = met.groupBy("doc_id", F.col("c.doc_id").alias("centre")).agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("centre")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), F.col("doc_id").alias("b"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    component_id is the smallest id reachable by links, the document's own id included. A null or empty text, or one
    without words, has no shingles and links with nothing. A null id takes no part and has a null component. Rows that
    share an id link each by its own text. Empty tables give no rows.
    """
    return _graded(docs, id_col, text_col)[0].select("doc_id", "n_shingles", "component_id")


def firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each class the row with the smallest id, and all rows without an id.

    Of rows that share an id, only those go whose shingle set is a copy or links. Of rows that share both id and
    set, the one with the smallest text stays.
    """
    graded, clashing = _graded(docs, id_col, text_col)
    kept = graded.filter("is_first AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("set_hash").alias("_kept")).distinct()
    whole = docs.select(F.col(id_col).cast("long").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))
    least = F.min_by("_row", F.struct(F.col("_text").isNull(), F.coalesce("_text", F.lit("")))).alias("_row")
    if clashing is None:
        rows = whole.join(kept.select("_id"), "_id", "left_semi").groupBy("_id").agg(least).select("_row.*")
    else:
        ids = clashing.select(F.col("doc_id").alias("_id")).distinct()
        alone = whole.join(kept.join(ids, "_id", "left_anti"), "_id", "left_semi").groupBy("_id").agg(least)
        several = whole.join(ids, "_id", "left_semi").withColumn("_set", set_hash(F.col("_text")))
        several = several.join(kept.withColumnRenamed("_id", "_same"), (F.col("_id") == F.col("_same")) & F.col("_set").eqNullSafe(F.col("_kept")), "left_semi").groupBy("_id", "_set").agg(least)
        rows = alone.select("_row.*").unionAll(several.select("_row.*"))
    return rows.unionAll(docs.filter(F.col(id_col).isNull()))


def _clashing(base: DataFrame) -> DataFrame | None:
    """doc_id, set_hash, node for ids of several sets, node being a number that is no id; None if there are none."""
    spark = base.sparkSession
    each = F.coalesce("set_hash", F.lit(b""))
    ids = base.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(each).alias("lo"), F.max(each).alias("hi")).filter("lo <> hi").select("doc_id")
    ids = materialize(ids, "clashing", small=True)
    if ids.isEmpty():
        return None
    pairs = materialize(base.join(ids, "doc_id", "left_semi").select("doc_id", "set_hash").distinct(), "clashing", small=True)
    lo, hi = base.agg(F.min("doc_id"), F.max("doc_id")).first()
    n = pairs.count()
    start = hi + 1 if hi + n < 2**63 else lo - n
    if start < -(2**63):
        raise ValueError("no numbers are left beside the ids")
    numbered = pairs.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], start + x[1]))
    return materialize(spark.createDataFrame(numbered, "doc_id long, set_hash binary, node long"), "clashing")


def _graded(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, n_shingles, set_hash, component_id and is_first (no smaller row links) for every row; and _clashing."""
    spark = docs.sparkSession
    path = fresh_path(spark, "classes")
    with small_batches(spark), side_files(spark):
        graded, clashing = _graded_now(docs, id_col, text_col)
        graded = materialize(graded, "classes", path=f"{path}/rows")
        if clashing is not None:
            clashing = materialize(clashing, "clashing", path=f"{path}/clashing")
    return graded, clashing


def _graded_now(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = materialize(given.mapInArrow(lean(_sketches), SKETCH), "sketches")
    clashing = _clashing(base)
    if clashing is not None:
        # From here on doc_id is a node: the id, or for ids of several sets a number of each set.
        node = clashing.select(F.col("doc_id").alias("id"), F.col("set_hash").alias("_set"), "node")
        same = (F.col("doc_id") == F.col("id")) & F.col("set_hash").eqNullSafe(F.col("_set"))
        base = materialize(base.join(node, same, "left").select(F.coalesce("node", "doc_id").alias("doc_id"), "n_shingles", "set_hash", "keys", "sketch", F.col("doc_id").alias("id")), "nodes")
        texts = given.join(clashing.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("set_hash", set_hash(F.col("text")))
        given = given.unionAll(materialize(texts.join(node, same).select(F.col("node").alias("doc_id"), "text"), "texts"))
    named = base.filter("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    # Equal sets: one representative each. The other documents' ids go to files, so that wide rows need no join.
    groups = materialize(named.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "sets")
    n_copies = groups.agg(F.sum(F.col("n") - 1)).first()[0] or 0
    path, shards = fresh_path(docs.sparkSession, "copies"), max(8, -(-n_copies // COPY_SHARD))
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")
    copies = named.select("doc_id", "set_hash").join(groups.filter("n > 1"), "set_hash").filter("doc_id <> rep").select(shard, "doc_id")
    there = sorted(r.shard for r in copies.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(lean(_saved_ids(path)), "shard long").collect())
    exploded = named.select("doc_id", "n_shingles", "keys", shard).mapInArrow(lean(_exploded(path, there)), "doc_id long, n_shingles long, key long")
    order = Window.partitionBy("key").orderBy("doc_id")
    near = exploded.withColumns({"_before": F.lag("doc_id").over(order), "_after": F.lead("doc_id").over(order)})
    # Signatures of one document are left out, and rows that repeat one.
    near = materialize(near.filter("_before <> doc_id OR _before IS NULL AND _after IS NOT NULL").select("key", "doc_id", "n_shingles"), "near")
    # Near copies share many signatures: of the groups that hold the same documents one is enough.
    of_key = near.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "doc_id")).alias("y"))
    once = of_key.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    shared = materialize(near.join(once, "key", "left_semi"), "shared")

    links, found = None, docs.sparkSession.createDataFrame([], "node long, component long")
    labelled = shared.withColumn("component", F.col("doc_id"))
    for _ in range(STAR_ROUNDS):
        new = verify(star_pairs(labelled), given)
        if new.isEmpty():
            break
        links = new if links is None else links.unionAll(new)
        found = components(links)
        named_rows = shared.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        labelled = materialize(still_open(named_rows.select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))), "open")
    # Signature groups that one component does not cover; groups beyond BLOCK are cut into blocks that meet pairwise.
    whole = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    whole = materialize(whole.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "whole", small=True)
    # Broadcast where they are few, so that a large group's rows stay spread.
    rows = labelled.join(F.broadcast(whole) if whole.count() <= BROADCAST_IDS else whole, "key").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("block") == F.col("with"), 2).when(F.col("block") < F.col("with"), 0).otherwise(1)
    cells = rows.select(F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("cell"), side.alias("side"), "doc_id", "component", "n_shingles")
    used = cells.select("doc_id").distinct()
    placed = cells.join(named.select("doc_id", "sketch").join(used, "doc_id", "left_semi"), "doc_id").repartition("cell").sortWithinPartitions("cell", "side", "doc_id")
    candidates = materialize(placed.mapInArrow(lean(_near), "a long, b long").distinct(), "candidates", small=True)
    if not candidates.isEmpty():
        late = verify(candidates, given)
        found = components(late if links is None else links.unionAll(late))

    of_set = groups.join(found, groups["rep"] == found["node"], "left").select(F.col("set_hash").alias("_set"), F.coalesce("component", "rep").alias("_component"))
    if clashing is None:
        base = base.withColumn("id", F.col("doc_id"))
    out = base.select("id", "doc_id", "n_shingles", "set_hash").join(of_set, F.col("set_hash") == F.col("_set"), "left")
    out = out.select("id", "doc_id", "n_shingles", "set_hash", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("_component"))
    if clashing is None:
        return out.select("doc_id", "n_shingles", "set_hash", F.col("_component").alias("component_id"), (F.col("doc_id") == F.col("_component")).alias("is_first")), None
    heads = out.groupBy("_component").agg(F.min(F.struct("id", "doc_id")).alias("_head")).withColumnRenamed("_component", "_of")
    out = out.join(heads, F.col("_component") == F.col("_of"), "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "set_hash", F.col("_head.id").alias("component_id"), (F.col("doc_id") == F.col("_head.doc_id")).alias("is_first")), clashing
