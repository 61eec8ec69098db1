"""Removal of long passages that an earlier document holds: a run-length index, matching statistics, and spans.

The index of a corpus does not fit into one worker, so the text is dealt to shards such that equal windows of 50 bytes meet:
by the window's anchor, its smallest-hashed 20-byte string. Windows of one document next to each other with one
anchor form a stretch. A stretch whose anchor lies in one document only has no match. Of all others every distinct
content goes to its shard's run-length index (run_index): a run-compressed Burrows-Wheeler transform with sampled run
ends, through which the contents' matching statistics are streamed by LF steps; they tell for each window with a match
of 50 bytes the earliest document that holds it. A content that many documents share is streamed once, for its
earliest document; to the later ones each of its windows is a repeat.

Texts are never shuffled whole: requests for stretches and the resulting spans travel, as sorted arrays in the shared folder
that the workers map while they scan the documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.files import load, runs, save
from tessera.llm.run_index import RunIndex
from tessera.llm.shared import drop_path, fresh_path, lean, materialize, small_batches
from tessera.llm.words import by_hash, mix, texts_of

WINDOW, ANCHOR = 50, 20
#: Windows handled at once (longer texts are cut between windows), text bytes behind one shard, stretches dealt at once.
CHUNK, SHARD_BYTES, DEALT = 1 << 18, 20 << 20, 400_000
INDEX_BYTES = 2 << 20  # text in one run-length index
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BASE = 0x9E3779B97F4A7C15 | 1
BLOB_DDL = "shard long, kind string, body array<binary>"
BLOB = pa.schema([("shard", pa.int64()), ("kind", pa.string()), ("body", pa.list_(pa.binary()))])
#: anchor, content, bytes before and after the anchor, doc_id, text check, position, times in a row, in several documents
STRETCH = [np.uint32, np.uint64, np.uint8, np.uint8, np.int64, np.uint32, np.uint32, np.uint32, np.uint8]
SPAN = [np.int64, np.uint32, np.uint32, np.uint32]  # doc_id, start, size, text check
OPEN = [*SPAN, np.uint32, np.uint32, np.uint32]  # and the anchor, its shard, times in a row
KINDS = {"span": SPAN, "open": OPEN}
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        factors = np.full((2, max(n, 2 * CHUNK)), [[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
        factors[:, 0] = 1
        _powers[:] = np.multiply.accumulate(factors, axis=1)
    return _powers


def _blob(shard: int, kind: str, arrays) -> pa.RecordBatch:
    """Arrays in one row, the byte planes of each compressed."""
    pack = zstandard.ZstdCompressor(level=1).compress
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays]
    return pa.RecordBatch.from_pylist([{"shard": int(shard), "kind": kind, "body": [pack(p) for p in planes]}], schema=BLOB)


def _split(arrays, shard: np.ndarray, kind: str):
    """A blob of the rows of each shard, their order kept."""
    few = len(shard) and int(shard.max()) < 1 << 16  # numbers of 16 bits are sorted in one pass
    order = np.argsort(shard.astype(np.uint16) if few else shard, kind="stable")
    at = shard[order]
    cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]]) if len(at) else [0]
    for i, j in zip(cuts[:-1], cuts[1:]):
        yield _blob(at[i], kind, [a[order[i:j]] for a in arrays])


def _opened(body, kinds: list) -> list[np.ndarray]:
    unpack, out = zstandard.ZstdDecompressor().decompress, []
    for part, kind in zip(body.values, map(np.dtype, kinds), strict=True):
        planes = np.frombuffer(unpack(part.as_buffer()), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel())
    return out


def _gathered(rows: pa.RecordBatch, kind: str, kinds: list) -> list[np.ndarray]:
    """The arrays of all blobs of a kind."""
    found = [_opened(body, kinds) for k, body in zip(rows.column("kind").to_pylist(), rows.column("body")) if k == kind]
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, t) for t in kinds]


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """first window, last window, anchor position, anchor hash, content hash of each stretch of concatenated texts.

    The hash's upper half chose the anchor as the smallest, so it is small; its lower half is even. Contents have at
    most 80 bytes, too few for the structured collisions that polynomials have over long strings.
    """
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    eight = np.ndarray((len(data) - 7,), np.uint64, np.ascontiguousarray(data).data, strides=(1,))
    count = len(data) - ANCHOR + 1
    grams = mix(eight[:count] * _C[0] + eight[8 : 8 + count] * _C[1] + eight[ANCHOR - 8 : ANCHOR - 8 + count] * _C[2])
    # Hash and position in one number: the minimum is the leftmost smallest.
    least = (grams & np.uint64(0xFFFFFFFF << 32)) | np.arange(count, dtype=np.uint64)
    width, span = 1, WINDOW - ANCHOR + 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    begins = np.concatenate([[0], ends[:-1]])
    n = np.maximum(0, ends - begins - WINDOW + 1)
    windows = np.repeat(begins - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
    anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    if not len(windows):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    # Anchors rise within a text, and an anchor lies inside its text: a new one starts a new stretch.
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last, anchor = windows[new], windows[np.concatenate([new[1:], [len(windows)]]) - 1], anchor[new]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
    size = (last + WINDOW - first).astype(np.uint64)
    content = mix((sums[last + WINDOW] - sums[first]) * inverse[first] + size * _C[2] + (anchor - first).astype(np.uint64) * _C[1])
    return first, last, anchor, grams[anchor], content


def _within(order: np.ndarray, ascending: np.ndarray, *finer: np.ndarray) -> np.ndarray:
    """The places `order`, by which a number ascends, ordered among equals by the further ones, the first of them above the others."""
    head = np.concatenate([[True], ascending[1:] != ascending[:-1]])
    more = np.flatnonzero(~(head & np.append(head[1:], True)))
    some = order[more]
    order[more] = some[np.lexsort((*(x[some] for x in reversed(finer)), ascending[more]))]
    return order


def _pieces(batch: pa.RecordBatch):
    """(bytes, ends, rows of the batch, position of each text's part) of about CHUNK bytes each."""
    data, at = texts_of(batch.column("text"))
    i, n = 0, len(at) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, side="right")) - 1))
        if at[j] - at[i] <= 2 * CHUNK:
            yield data[at[i] : at[j]], at[i + 1 : j + 1] - at[i], np.arange(i, j), np.zeros(j - i, np.int64)
        else:
            for s in range(0, int(at[j] - at[i]), CHUNK):
                part = data[at[i] + s : min(at[j], at[i] + s + CHUNK + WINDOW - 1)]
                yield part, np.array([len(part)]), np.array([i]), np.array([s])
        i = j


def _anchored(shards: int):
    """Stretches dealt by anchor. Of those that a task holds more than once the earliest goes as "stretch", the others as "too"."""

    def dealt(held: list):
        gram, content, before, after, doc, check, at, times = (np.concatenate(x) for x in zip(*held, strict=True))
        order, of = by_hash(content)
        order = _within(order, of, doc, check, at)
        head = np.concatenate([[True], of[1:] != of[:-1]])
        begin = np.flatnonzero(head)
        several = doc[order][np.append(begin[1:], len(of)) - 1] != doc[order][begin]
        # One half of the hash deals to shards, the other tells anchors apart within a shard.
        shard = ((mix(gram >> np.uint64(32)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        arrays = [gram.astype(np.uint32), content, before, after, doc, check, at, times]
        for kind, own, flag in (("stretch", order[begin], several), ("too", order[~head], np.zeros(len(of) - len(begin), bool))):
            if len(own):
                back = np.argsort(own)  # in the order of the texts, which compresses better
                yield from _split([*(a[own[back]] for a in arrays), flag[back].astype(np.uint8)], shard[own[back]], kind)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            ids, checks = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), batch.column("row").to_numpy().astype(np.uint32)
            for data, ends, rows, base in _pieces(batch):
                first, last, anchor, gram, content = stretches(data, ends)
                own = np.searchsorted(ends, first, side="right")
                # Periodic texts repeat one stretch: it goes once, with its number.
                new = np.flatnonzero(np.concatenate([[True], (content[1:] != content[:-1]) | (own[1:] != own[:-1]) | (first[1:] != last[:-1] + 1)])) if len(first) else np.zeros(0, np.int64)
                times = np.diff(np.append(new, len(first))).astype(np.uint32)
                first, last, anchor, gram, content, own = (x[new] for x in (first, last, anchor, gram, content, own))
                begins = np.concatenate([[0], ends[:-1]])
                held.append([gram, content, (anchor - first).astype(np.uint8), (last - anchor + WINDOW).astype(np.uint8), ids[rows[own]], checks[rows[own]], (anchor - begins[own] + base[own]).astype(np.uint32), times])
                size += len(first)
                if size > DEALT:
                    yield from dealt(held)
                    held, size = [], 0
        if size:
            yield from dealt(held)

    return run


def _row_shard(doc: np.ndarray, shards: int) -> np.ndarray:
    return ((mix(doc.astype(np.int64).view(np.uint64)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _settled(shards: int):
    """Per shard of anchors: the spans of stretches whose content an earlier document has, and requests for the earliest ones.

    A shard's "stretch" rows come first: no more of them than tasks for any content. Its "too" rows are streamed.
    """

    def replies(found: list[np.ndarray], earliest: np.ndarray, shared: np.ndarray, number: int):
        gram, _, before, after, doc, check, at, times, _ = found
        start, unit = at - before, before.astype(np.uint32) + after
        later, leads = doc > earliest, shared & (doc == earliest)
        if later.any():
            size = unit + (times - 1) * (unit - np.uint32(WINDOW - 1))
            yield from _split([doc[later], start[later], size[later], check[later]], _row_shard(doc[later], shards), "span")
        if leads.any():
            own = np.full(int(leads.sum()), number, np.uint32)
            yield from _split([doc[leads], start[leads], unit[leads], check[leads], gram[leads], own, times[leads]], _row_shard(doc[leads], shards), "open")

    def solved(held: list) -> tuple[list, tuple]:
        found = [np.concatenate(x) for x in zip(*held, strict=True)]
        # Anchors (32 bits) and places in one number; most anchors come once.
        bits = np.uint64(max(1, len(found[0]) - 1).bit_length())
        both = (found[0].astype(np.uint64) << bits) | np.arange(len(found[0]), dtype=np.uint64)
        both.sort()
        order = _within((both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), both >> bits, found[1], found[4])
        found = [x[order] for x in found]
        gram, content, doc, several = found[0], found[1], found[4], found[8]
        of_gram = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (content[1:] != content[:-1])])
        of_class = np.flatnonzero(new)
        least, most = np.minimum.reduceat(doc, of_gram), np.maximum.reduceat(doc, of_gram)
        shared = np.repeat((least != most) | (np.maximum.reduceat(several, of_gram) > 0), np.diff(np.append(of_gram, len(gram))))
        earliest = doc[of_class]
        by = np.argsort(content[of_class])
        table = content[of_class][by], earliest[by], shared[of_class][by]
        return [found, earliest[new.cumsum() - 1], shared], table

    def run(batches):
        held, table, current = [], None, None
        for batch in batches:
            for shard, kind, body in zip(batch.column("shard").to_pylist(), batch.column("kind").to_pylist(), batch.column("body")):
                if held and (shard != current or kind == "too"):
                    first, table = solved(held)
                    held = []
                    yield from replies(*first, current)
                current, found = shard, _opened(body, STRETCH)
                if kind == "stretch":
                    held.append(found)
                else:
                    at = np.searchsorted(table[0], found[1])
                    yield from replies(found, table[1][at], table[2][at], shard)
        if held:
            yield from replies(*solved(held)[0], current)

    return run


def _stored(path: str, prefix: str = ""):
    """Per shard of documents: the spans of each kind in one file, sorted by document."""
    schema = pa.schema([("kind", pa.string()), ("shard", pa.int64())])

    def run(batches):
        for shard, rows in runs(batches, "shard"):
            for kind in sorted(set(rows.column("kind").to_pylist())):
                found = _gathered(rows, kind, KINDS[kind])
                order = np.lexsort((found[1], found[0]))
                save(f"{path}/{prefix}{kind}-{shard}", [x[order] for x in found])
                yield pa.RecordBatch.from_pylist([{"kind": prefix + kind, "shard": int(shard)}], schema=schema)

    return run


def _of_rows(path: str, kind: str, there: set, shards: int, docs: np.ndarray, checks: np.ndarray) -> list[np.ndarray]:
    """What the files hold for a batch's rows: row, start, size and so on, by row. Rows that share an id differ by their text's check."""
    kinds = [t for i, t in enumerate(KINDS[kind.removeprefix("late-")]) if i not in (0, 3)]
    shard, found = _row_shard(docs, shards), []
    for s in np.unique(shard).tolist():
        if (kind, s) in there:
            own = np.flatnonzero(shard == s)
            keys, *rest = load(f"{path}/{kind}-{s}")
            i, j = np.searchsorted(keys, docs[own]), np.searchsorted(keys, docs[own], side="right")
            at, row = _spread(i, j - i), np.repeat(own, j - i)
            same = rest[2][at] == checks[row]
            at, row = at[same], row[same]
            found.append([row, *(x[at] for k, x in enumerate(rest) if k != 2)])
    if not found:
        return [np.zeros(0, np.int64), *(np.zeros(0, t) for t in kinds)]
    joined = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(joined[0], kind="stable")
    return [x[order] for x in joined]


TEXT = [np.uint8, np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8]  # size, doc_id, text check, start, anchor, times; the bytes


def _requested(path: str, there: set, shards: int):
    """The bytes of the earliest stretches, dealt by their anchor again."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                some = batch.slice(s, 64)
                data, at = texts_of(some.column("text"))
                ids, checks = some.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64), some.column("row").to_numpy().astype(np.uint32)
                row, start, size, gram, shard, times = _of_rows(path, "open", there, shards, ids, checks)
                for k in np.unique(shard).tolist():
                    own = np.flatnonzero(shard == k)
                    text = data[_spread(at[row[own]] + start[own], size[own].astype(np.int64))]
                    yield _blob(k, "text", [size[own].astype(np.uint8), ids[row[own]], checks[row[own]], start[own], gram[own], times[own], text])

    return run


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs one after another."""
    return np.repeat(begin - (size.cumsum() - size), size) + np.arange(size.sum())


def earliest(texts: np.ndarray, size: np.ndarray, docs: np.ndarray, index_bytes: int | None = None) -> np.ndarray:
    """For each window of each text, one after another, the earliest document that holds it, by run-length indexes.

    A window that only its own text holds may get any number from its own document's on. Texts of more than index_bytes
    have several indexes, and all texts' matching statistics are streamed through each.
    """
    limit = index_bytes or len(texts) + 1
    part = (size.cumsum() - size) // limit
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(size)]
    if len(cuts) == 2:
        return RunIndex(texts, size, docs, WINDOW).earliest(texts, size, own=True)
    ends, out = np.append(0, size.cumsum()), None
    for i, j in zip(cuts[:-1], cuts[1:]):
        found = RunIndex(texts[ends[i] : ends[j]], size[i:j], docs[i:j], WINDOW).earliest(texts, size)
        out = found if out is None else np.minimum(out, found)
    return out


def _indexed(shards: int):
    """Per shard of anchors: index the requested stretches, in parts that keep anchors whole, and yield the repeated windows' spans."""

    def run(batches):
        for _, rows in runs(batches, "shard"):
            size, doc, check, place, gram, times, text = _gathered(rows, "text", TEXT)
            size = size.astype(np.int64)
            offset = size.cumsum() - size
            order = np.lexsort((doc, gram))
            # A part is closed at the first anchor that begins beyond its bytes.
            begin = np.flatnonzero(np.concatenate([[True], gram[order][1:] != gram[order][:-1]]))
            part = ((size[order].cumsum() - size[order]) // INDEX_BYTES)[begin]
            part = np.repeat(part, np.diff(np.append(begin, len(order))))
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(order)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                own = order[i:j]
                n = size[own]
                count = n - WINDOW + 1
                which = np.repeat(np.arange(len(own)), count)
                step = _spread(np.zeros(len(own), np.int64), count)
                found = earliest(text[_spread(offset[own], n)], n, doc[own], 2 * INDEX_BYTES)
                hit = np.flatnonzero(found < doc[own][which])
                if not len(hit):
                    continue
                # Windows next to each other in one stretch make one span; a stretch that occurs in a row has them each time.
                first = np.flatnonzero(np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (which[hit[1:]] != which[hit[:-1]])]))
                last = np.append(first[1:], len(hit)) - 1
                a, b = hit[first], hit[last]
                w, again = which[a], times[own][which[a]].astype(np.int64)
                start = np.repeat(place[own][w] + step[a], again) + _spread(np.zeros(len(a), np.int64), again) * np.repeat(count[w], again)
                keys, length, checks = (np.repeat(x, again) for x in (doc[own][w], step[b] - step[a] + WINDOW, check[own][w]))
                yield from _split([keys, start.astype(np.uint32), length.astype(np.uint32), checks], _row_shard(keys, shards), "span")

    return run


def _cut(path: str, there: set, shards: int, with_kept: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("kept", pa.binary()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                some = batch.slice(s, 512)
                data, at = texts_of(some.column("text"))
                ids, valid = some.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), some.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                checks = some.column("row").to_numpy().astype(np.uint32)
                parts = [_of_rows(path, k, there, shards, ids, checks) for k in ("span", "late-span")]
                row, start, size = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
                mine = valid[row]
                row, start, size = row[mine], start[mine], size[mine]
                order = np.lexsort((start, row))
                row, begin = row[order], (at[row] + start)[order]
                reach = np.maximum.accumulate(begin + size[order]) if len(row) else begin
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (begin[1:] > reach[:-1])])) if len(row) else row
                row, begin, end = row[new], begin[new], reach[np.append(new[1:], len(reach)) - 1] if len(new) else begin
                change = np.zeros(len(data) + 1, np.int8)
                np.add.at(change, begin, 1)
                np.add.at(change, end, -1)
                keep = change[:-1].cumsum(dtype=np.int8) == 0
                per_row = np.bincount(row, minlength=some.num_rows)
                removed = np.bincount(row, weights=end - begin, minlength=some.num_rows).astype(np.int64)
                left = [data[a:b][keep[a:b]].tobytes() if n else data[a:b].tobytes() for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), per_row.tolist())]
                pairs = np.stack([begin - at[row], end - at[row]], axis=1).ravel()
                inner = pa.ListArray.from_arrays(np.arange(0, len(pairs) + 1, 2, dtype=np.int32), pa.array(pairs))
                spans = pa.ListArray.from_arrays(np.append(0, per_row.cumsum()).astype(np.int32), inner)
                digests = [hashlib.sha256(x).hexdigest() for x in left]
                kept = pa.array(left if with_kept else [None] * len(left), pa.binary())
                yield pa.record_batch([some.column("doc_id"), pa.array(np.diff(at)), pa.array(removed), pa.array(per_row), spans, kept, pa.array(digests)], schema=schema)

    return run


CUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (start, end), kept (the remaining bytes; null unless with_kept) and kept_sha256 of every row.

    A byte goes if a string of 50 bytes over it also starts in a row with a smaller id. Null texts are empty. A row
    without an id neither loses bytes nor counts as a source. Rows that share an id are no source for each other and are
    told apart by 32 bits of their text's hash. Stretches of one anchor count as equal by 64-bit hashes of their bytes.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    given = given.withColumn("row", F.xxhash64("text").bitwiseAND(0xFFFFFFFF))
    named = given.filter("doc_id IS NOT NULL AND octet_length(text) >= 50")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    path = fresh_path(spark, "repeats")
    dealt = lambda df, *by: df.repartition(shards, "shard").sortWithinPartitions("shard", *by)
    with small_batches(spark):
        settled = dealt(named.mapInArrow(lean(_anchored(shards)), BLOB_DDL), "kind").mapInArrow(lean(_settled(shards)), BLOB_DDL)
        there = {tuple(r) for r in dealt(settled).mapInArrow(lean(_stored(path)), "kind string, shard long").collect()}  # two rows a shard
        texts = dealt(named.mapInArrow(lean(_requested(path, there, shards)), BLOB_DDL))
        late = dealt(texts.mapInArrow(lean(_indexed(shards)), BLOB_DDL))
        there |= {tuple(r) for r in late.mapInArrow(lean(_stored(path, "late-")), "kind string, shard long").collect()}
        out = materialize(given.mapInArrow(lean(_cut(path, there, shards, with_kept)), CUT_DDL), "cut")
    drop_path(spark, path)
    return out
