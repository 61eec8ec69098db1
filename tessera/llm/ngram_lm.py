"""Interpolated modified Kneser-Ney model of any order: counted in Spark, stored as sorted hash arrays, scored from memory maps.

Words are counted first and numbered from frequent to rare (by powers of two of their counts), so n-grams are exact rows
of numbers that compress well. N-grams are combined in the task and dealt by the hash of the whole n-gram, which spreads the n-grams of a
frequent context evenly. The merge of a level writes one file a shard (sorted hashes with counts) and sends on, combined
again, the sums of each context and a count for each suffix, dealt by their own hashes: they make the next lower
level. Scoring workers map the files in place and look up each batch's distinct n-grams in sorted order, so memory
holds a batch, never the model.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import load, runs, save
from tessera.llm.shared import drop_path, fresh_path, lean, materialize, small_batches
from tessera.llm.words import by_hash, mix, word_hashes

ORDER = 3
#: Hash of the end, which is a token.
END = np.uint64(0x5BE0CD19137E2179)
#: Text bytes behind one shard, events that a task combines at once, and tokens that are scored at once.
SHARD_BYTES, COMBINE, SCORED = 16 << 20, 3_000_000, 500_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64(0xFFFFFFFF)


def held_out(id_col: str) -> Column:
    """crc32 of the id's text mod 10 is 0. A null id has an empty text, so it is held out."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given as one array of word numbers a place."""
    key = mix(columns[0].astype(np.uint64) + _B)
    for c in columns[1:]:
        key = mix(key * _A + c.astype(np.uint64) + _B)
    return key


def shard_of(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each hash and its place within the shard (64 bits); both rise with the hash."""
    n = np.uint64(shards)
    low = (keys & _LOW) * n
    high = (keys >> np.uint64(32)) * n + (low >> np.uint64(32))
    return high >> np.uint64(32), (high << np.uint64(32)) | (low & _LOW)


def by_numbers(first: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    """The places of rows by two numbers, or by one."""
    first = first.astype(np.uint64)
    bits = 0
    if second is not None:
        second = second.astype(np.uint64) & _LOW
        bits = int(second.max()).bit_length() if len(second) else 0
        first = (first << np.uint64(bits)) | second
    of_place = max(1, len(first) - 1).bit_length()
    if len(first) and int(first.max()).bit_length() + of_place > 64:
        return np.argsort(first)
    both = (first << np.uint64(of_place)) | np.arange(len(first), dtype=np.uint64)
    both.sort()
    return (both & np.uint64((1 << of_place) - 1)).astype(np.int64)


def _first_of_each(ascending: np.ndarray) -> np.ndarray:
    """Marks on the first of each run of equal numbers."""
    return np.concatenate([np.ones(min(1, len(ascending)), bool), ascending[1:] != ascending[:-1]])


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct numbers of two ascending arrays, ascending."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # merges the two
    return both.compress(_first_of_each(both))


# Blobs: columns of equal length, the first as differences, byte planes compressed.
BLOB = pa.schema([("shard", pa.int64()), ("kind", pa.string()), ("body", pa.binary())])
BLOB_DDL = "shard long, kind string, body binary"
STATS_DDL = "kind string, shard long, numbers array<long>"


def _packed(columns: list[np.ndarray]) -> bytes:
    columns = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes = [np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return np.int64(len(columns[0])).tobytes() + zstandard.ZstdCompressor(level=3).compress(b"".join(planes))


def _unpacked(body: bytes, kinds: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body[:8], np.int64)[0]), 0, []
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body[8:]), np.uint8)
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(raw[at : at + size].reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return [out[0].cumsum(dtype=out[0].dtype), *out[1:]]


def _blobs(kind: str, keys: np.ndarray, columns: list[np.ndarray], n_ids: int, shards: int):
    """A blob of each shard's rows; keys ascend. Within a blob rows are sorted by their first two numbers, which compresses well."""
    shard, _ = shard_of(keys, shards)
    cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else [0]
    for i, j in zip(cuts[:-1], cuts[1:]):
        part = [c[i:j] for c in columns]
        order = by_numbers(part[0], part[1] if n_ids > 1 else None)
        yield pa.RecordBatch.from_pylist([{"shard": int(shard[i]), "kind": kind, "body": _packed([c[order] for c in part])}], schema=BLOB)


def _summed(keys: np.ndarray, columns: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct keys ascending, a row of columns each, and the sums of counts."""
    if not len(keys):
        return keys, columns, counts
    order, keys = by_hash(keys)
    at = np.flatnonzero(_first_of_each(keys))
    return keys[at], [c[order[at]] for c in columns], [np.add.reduceat(c[order], at) for c in counts]


def _small(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in a byte each; 255 stands for a larger one, kept with its position."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), large.astype(np.int64), counts[large].astype(np.int64)


def _full(small: np.ndarray, large: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = small[at].astype(np.int64)
    top = np.flatnonzero(out == 255)
    if len(top):
        out[top] = value[np.searchsorted(large, at[top])]
    return out


def _marked(marks: np.ndarray) -> list[np.ndarray]:
    """Bits of marks in 64-bit words, and how many are set before each word."""
    bits = np.packbits(np.concatenate([marks, np.zeros(-len(marks) % 64, bool)]), bitorder="little").view(np.uint64)
    count = np.bitwise_count(bits).astype(np.int64)
    return [bits, (count.cumsum() - count).astype(np.uint32 if len(marks) < 1 << 32 else np.uint64)]


def _rank(bits: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many marks stand before each place."""
    inside = bits[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
    return before[at >> 6].astype(np.int64) + np.bitwise_count(inside)


def _sparse(counts: np.ndarray) -> list[np.ndarray]:
    """Counts of which most are one: a mark for each other, and those."""
    return [*_marked(counts != 1), *_small(counts[counts != 1])]


def _dense(bits: np.ndarray, before: np.ndarray, small: np.ndarray, large: np.ndarray, value: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts at some places, which of them are marked, and their ranks among the marked."""
    out = np.ones(len(at), np.int64)
    marked = np.flatnonzero((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
    rank = _rank(bits, before, at[marked])
    out[marked] = _full(small, large, value, rank)
    return out, marked, rank


def _word_counts(shards: int):
    """Words and their counts, combined in the task."""

    def flush(held: list):
        words, n = np.unique(np.concatenate(held), return_counts=True)
        yield from _blobs("word", words, [words, n.astype(np.uint64)], 1, shards)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, hashes, ends in word_hashes(batch.column(0)):
                held += [hashes, np.full(len(ends), END)]
                size += len(hashes) + len(ends)
                if size >= COMBINE:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


LEVELS = 64


def _level(counts: np.ndarray) -> np.ndarray:
    """The power of two that each count reaches."""
    return np.searchsorted(np.array([1 << k for k in range(LEVELS)], np.uint64), counts.astype(np.uint64), side="right") - 1


def _vocabulary(path: str):
    """Per shard the sorted words with their counts in a file."""

    def run(batches):
        for shard, rows in runs(batches, "shard"):
            found = [_unpacked(b, [np.uint64, np.uint64]) for b in rows.column("body").to_pylist()]
            words, n = (np.concatenate(x) for x in zip(*found, strict=True))
            words, _, (n,) = _summed(words, [], [n])
            level = _level(n)
            order = np.argsort(level, kind="stable")
            of_level = np.bincount(level, minlength=LEVELS)
            rank = np.empty(len(words), np.uint64)
            rank[order] = np.arange(len(words)) - (of_level.cumsum() - of_level)[level[order]]
            save(f"{path}/0-{shard}", [words, *_small(n.astype(np.int64)), rank.astype(np.uint32) if len(words) < 1 << 32 else rank])
            yield pa.RecordBatch.from_pylist([{"kind": "0", "shard": int(shard), "numbers": [int(n.sum()), *of_level.tolist()]}], schema=STATS)

    return run


STATS = pa.schema([("kind", pa.string()), ("shard", pa.int64()), ("numbers", pa.list_(pa.int64()))])


class Words:
    """Numbers and counts of words, from the vocabulary files. The beginning's number and that of unknown words follow the last."""

    def __init__(self, about: dict) -> None:
        self.about, self.begin, self.unknown = about, about["words"], about["words"] + 1
        self.kind = np.uint32 if self.unknown < 1 << 32 else np.uint64

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, words = by_hash(hashes)
        head = _first_of_each(words)
        of_word = np.empty(len(hashes), np.int64)
        of_word[order] = head.cumsum() - 1
        words = words.compress(head)
        ids, counts = np.full(len(words), self.unknown, self.kind), np.zeros(len(words), np.int64)
        for shard, part in _parts(shard_of(words, self.about["shards"])[0]):
            if shard in self.about["bases"]:
                known, *n, rank = load(f"{self.about['path']}/0-{shard}")
                at = np.minimum(np.searchsorted(known, words[part]), len(known) - 1)
                hit = np.flatnonzero(known[at] == words[part])
                found = _full(*n, at[hit])
                counts[part][hit] = found
                ids[part][hit] = np.array(self.about["bases"][shard])[_level(found)] + rank[at[hit]].astype(np.int64)
        return ids[of_word], counts[of_word]

    def padded(self, ids: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents one after another, order - 1 beginnings before each, and where their tokens stand. ids: with ends already."""
        size = np.diff(ends, prepend=0)
        at = np.arange(len(ids)) + (order - 1) * np.repeat(np.arange(1, len(ends) + 1), size)
        out = np.full(len(ids) + (order - 1) * len(ends), self.begin, self.kind)
        out[at] = ids
        return out, at


def _parts(shard: np.ndarray):
    """(shard, slice) of an ascending array of shards."""
    cuts = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]]) if len(shard) else [0]
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield int(shard[i]), slice(i, j)


def with_ends(hashes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of documents with an end after each, and after how many tokens each ends."""
    return np.insert(hashes, ends, END), ends + np.arange(1, len(ends) + 1)


def _counted(about: dict):
    order, shards = about["order"], about["shards"]

    def flush(held: list):
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        keys, columns, (n,) = _summed(gram_key(columns), columns, [np.ones(len(columns[0]), np.int64)])
        yield from _blobs("gram", keys, [*columns, n.astype(np.uint32)], order, shards)

    def run(batches):
        words, held, size = Words(about), [], 0
        for batch in batches:
            for _, _, hashes, ends in word_hashes(batch.column(0)):
                tokens, ends = with_ends(hashes, ends)
                padded, at = words.padded(words.look_up(tokens)[0], ends, order)
                held.append([padded[at - k] for k in reversed(range(order))])
                size += len(at)
                if size >= COMBINE:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _merged(about: dict, level: int):
    """Per shard of `level`-grams: their counts and the sums of their continuations to a file; contexts and suffixes of theirs sent on."""
    path, shards, order = about["path"], about["shards"], about["order"]
    number = np.uint32 if about["words"] + 1 < 1 << 32 else np.uint64
    ids = [number] * level

    def gathered(rows: pa.RecordBatch, kind: str, n_counts: int):
        kinds = [*ids, *[np.uint32 if kind == "gram" else np.uint64] * n_counts]
        found = [_unpacked(b, kinds) for k, b in zip(rows.column("kind").to_pylist(), rows.column("body").to_pylist()) if k == kind]
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in kinds]
        grams, counts = columns[:level], [c.astype(np.int64) for c in columns[level:]]
        return _summed(gram_key(grams), grams, counts)

    def run(batches):
        for shard, rows in runs(batches, "shard"):
            if shard < 0:
                yield rows.select(BLOB.names)
                continue
            keys, grams, (n,) = gathered(rows, "gram", 1)
            everything, stats = keys, []
            if level < order:
                contexts, _, stats = gathered(rows, "context", 4)
                everything = union(keys, contexts)
                stats = [_placed(everything, contexts, s) for s in stats]
            _, place = shard_of(everything, shards)
            arrays = _sparse(_placed(everything, keys, n))
            if stats:  # what is followed once has nothing more to tell: the classes are kept of the rest
                arrays += _sparse(stats[0])
                arrays += [a for x in stats[1:] for a in _small(x[stats[0] != 1])]
            save(f"{path}/{level}-{shard}", [(place >> np.uint64(32)).astype(np.uint32), (place >> np.uint64(16)).astype(np.uint16), *arrays])
            seen = np.array([level, shard, len(n), n.sum(), *((n == k).sum() for k in (1, 2, 3, 4))], np.int64)
            yield pa.RecordBatch.from_pylist([{"shard": -1 - int(shard), "kind": "stat", "body": seen.tobytes()}], schema=BLOB)
            if level > 1 and len(keys):
                head, tail = grams[:-1], grams[1:]
                found, columns, sums = _summed(gram_key(head), head, [n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64)])
                yield from _blobs("context", found, [*columns, *(s.astype(np.uint64) for s in sums)], level - 1, shards)
                found, columns, (sums,) = _summed(gram_key(tail), tail, [np.ones(len(n), np.int64)])
                yield from _blobs("gram", found, [*columns, sums.astype(np.uint32)], level - 1, shards)

    return run


def _placed(everything: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(everything), np.int64)
    out[np.searchsorted(everything, keys)] = values
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more.

    Where a class is empty, which happens to tiny corpora only, its formula has no value: the discount is 0.5 then; and it
    is kept between 0.05 and the count, so that every probability stays above zero.
    """
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.5, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return np.array([0.0, *[min(max(x, 0.05), k) for k, x in enumerate(d, 1)]])


def train(docs: DataFrame, text_col: str = "text", path: str | None = None, order: int = ORDER) -> dict:
    """Count the texts of docs and write the model's files below path; returns what scoring needs besides them."""
    if order < 2:
        raise ValueError("the order must be 2 or more")
    spark = docs.sparkSession
    path = path or fresh_path(spark, "lm")
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    dealt = lambda df: df.repartition(shards, "shard").sortWithinPartitions("shard")
    with small_batches(spark):
        counted = dealt(texts.mapInArrow(lean(_word_counts(shards)), BLOB_DDL)).mapInArrow(lean(_vocabulary(path)), STATS_DDL)
        rows = sorted((r["shard"], r["numbers"]) for r in counted.collect())  # a row a shard
        # The first number of each level of counts in each shard, the most frequent level first.
        sizes = np.array([n[1:] for _, n in rows], np.int64).reshape(len(rows), LEVELS)[:, ::-1]
        bases = (sizes.T.ravel().cumsum() - sizes.T.ravel()).reshape(LEVELS, len(rows)).T[:, ::-1]
        about = {"path": path, "shards": shards, "order": order, "bases": {shard: b.tolist() for (shard, _), b in zip(rows, bases, strict=True)}, "words": int(sizes.sum()), "tokens": sum(n[0] for _, n in rows)}
        blobs = texts.mapInArrow(lean(_counted(about)), BLOB_DDL)
        for level in range(order, 0, -1):
            blobs = dealt(blobs).mapInArrow(lean(_merged(about, level)), BLOB_DDL)
        stats = [np.frombuffer(r["body"], np.int64).tolist() for r in blobs.collect()]  # a row a level and shard
    about["files"] = sorted((s[0], s[1]) for s in stats)
    about["levels"] = {level: [sum(s[k] for s in stats if s[0] == level) for k in range(2, 8)] for level in range(1, order + 1)}
    return about


class Model:
    """Looks up distinct, sorted hashes in the shards' files."""

    def __init__(self, about: dict) -> None:
        self.about, self.words, self.files = about, Words(about), {tuple(f) for f in about["files"]}
        self.d = {level: discounts(*numbers[2:]) for level, numbers in about["levels"].items()}

    def look_up(self, level: int, keys: np.ndarray) -> list[np.ndarray]:
        """Counts of n-grams, and below the highest order the total and the classes of what follows them."""
        order, of_sorted = by_hash(keys)
        head = _first_of_each(of_sorted)
        distinct = of_sorted.compress(head)
        shard, place = shard_of(distinct, self.about["shards"])
        out = [np.zeros(len(distinct), np.int64) for _ in range(1 if level == self.about["order"] else 5)]
        for k, part in _parts(shard):
            if (level, k) not in self.files:
                continue
            high, low, *arrays = load(f"{self.about['path']}/{level}-{k}")
            wanted, rest = (place[part] >> np.uint64(32)).astype(np.uint32), (place[part] >> np.uint64(16)).astype(np.uint16)
            at = np.minimum(np.searchsorted(high, wanted), len(high) - 1)
            while True:  # the few that share the upper half stand next to each other
                on = np.flatnonzero((high[at] == wanted) & (low[at] != rest) & (at + 1 < len(high)))
                on = on[high[np.minimum(at[on] + 1, len(high) - 1)] == wanted[on]]
                if not len(on):
                    break
                at[on] += 1
            hit = np.flatnonzero((high[at] == wanted) & (low[at] == rest))
            at = at[hit]
            out[0][part][hit] = _dense(*arrays[:5], at)[0]
            if len(out) > 1:
                total, marked, rank = _dense(*arrays[5:10], at)
                out[1][part][hit] = total
                out[2][part][hit] = total == 1
                for i, o in enumerate(out[2:]):
                    o[part][hit[marked]] = _full(*arrays[10 + 3 * i : 13 + 3 * i], rank)
        back = np.empty(len(keys), np.int64)
        back[order] = head.cumsum() - 1
        return [o[back] for o in out]

    def score(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each token of padded documents."""
        order, words = self.about["order"], self.about["words"]
        uniform = 1 / (words + 1)
        if not words:
            return np.full(len(at), np.log10(uniform))
        types, total, t1, t2, *_ = self.about["levels"][1]
        d = self.d[1]
        back = float(d[1] * t1 + d[2] * t2 + d[3] * (types - t1 - t2))
        key, lower = None, None
        for level in range(1, order + 1):
            here = at if level == order else np.arange(level - 1, len(padded))
            key = gram_key([padded[here - k] for k in reversed(range(level))])
            found = self.look_up(level, key)
            n = found[0] if level == order else found[0][at - level + 1]
            if level == 1:
                p = (n - d[np.minimum(n, 3)] + back * uniform) / total
            else:
                total, *classes = (x[at - 1 - (level - 2)] for x in lower)
                d = self.d[level]
                weight = d[1] * classes[0] + d[2] * classes[1] + d[3] * classes[2]
                p = np.where(total > 0, (n - d[np.minimum(n, 3)] + weight * p) / np.maximum(total, 1), p)
            lower = found[1:]
        return np.log10(p)


def _scored(about: dict):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scored(model: Model, held: list):
        """held: rows, the hashes of their words, and after how many hashes each row ends."""
        n, v = about["tokens"], about["words"]
        base = np.append(0, np.cumsum([len(hashes) for _, hashes, _ in held]))
        tokens, ends = with_ends(np.concatenate([hashes for _, hashes, _ in held]), np.concatenate([e + b for (_, _, e), b in zip(held, base)]))
        ids, counts = model.words.look_up(tokens)
        logs = model.score(*model.words.padded(ids, ends, about["order"]))
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        starts = np.concatenate([[0], ends[:-1]])
        sums = lambda x: np.add.reduceat(x, starts)
        doc, out = (pa.concat_arrays([rows.column(k) for rows, _, _ in held]) for k in range(2))
        return pa.record_batch([doc, out, pa.array(np.diff(ends, prepend=0)), pa.array(sums((counts > 0).astype(np.int64))), pa.array(np.full(len(ends), n, np.int64)), pa.array(sums(base)), pa.array(sums(logs))], schema=schema)

    def run(batches):
        model, held, size = Model(about), [], 0
        for batch in batches:
            for i, j, hashes, ends in word_hashes(batch.column(2)):
                held.append((batch.select([0, 1]).slice(i, j - i), hashes, ends))
                size += len(hashes) + j - i
                if size >= SCORED:  # the more at once, the nearer to each other what is looked up
                    yield scored(model, held)
                    held, size = [], 0
        if held:
            yield scored(model, held)

    return run


SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, about: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score of every row.

    A null text is empty: its only token is the end. An untrained model gives every token the uniform probability.
    Words count as equal by 64-bit hashes; n-grams are told apart by 48 bits within their shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        return materialize(rows.mapInArrow(lean(_scored(about)), SCORED_DDL), "scored")


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """score() of all rows of docs by a model of those that are not held out. Other columns are ignored; an empty table gives no rows."""
    about = train(docs.filter(~held_out(id_col)), text_col, order=order)
    out = score(docs, about, id_col, text_col)
    drop_path(docs.sparkSession, about["path"])
    return out
