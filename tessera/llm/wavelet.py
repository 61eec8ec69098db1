"""Token ids in wavelet matrices: one compressed file per shard of consecutive documents.

A shard holds the token sequence of whole documents in ascending id order as succinct bit-planes over its own
alphabet, with a directory of ones per 512 bits and samples for select. One file supports token access, counting a
token in any range, and finding its n-th occurrence, without the sequence itself: planes and directories lie in it as
they are, so that a memory map reads the few pages that an access needs; ids, lengths and alphabet are compressed
besides. The planes decode back to the exact ids.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.files import load, read_file, save
from tessera.llm.shared import fresh_path, lean, small_batches
from tessera.llm.tokens import DEFAULT_VOCABULARY, worker_encoder

BLOCK = 512  # bits per entry of the directory
SAMPLE = 8192  # bits of a kind between two samples for select
MAX_READERS = 10_000  # tasks that read shards back
ENCODED = 8 << 20  # bytes of text that are encoded at once, and a batch more: the more, the fewer look-ups of words
MANIFEST_DDL = "part int, shard int, n_tokens long"
MANIFEST = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64())])


class WaveletMatrix:
    """Rank, select and access over a sequence of whole numbers."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[np.ndarray], ones: list[np.ndarray], samples: list[np.ndarray] | None = None) -> None:
        """samples: per plane the blocks that hold every SAMPLE-th zero, then those of the ones."""
        self.n, self.alphabet, self.zeros, self.planes, self.ones, self.samples = n, alphabet, zeros, planes, ones, samples or []

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        top = int(ids.max()) + 1 if len(ids) else 1
        present = np.zeros(top, bool)
        present[ids] = True
        alphabet = np.flatnonzero(present).astype(np.uint32)
        kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        dense = np.zeros(top, kind)
        dense[alphabet] = np.arange(len(alphabet))
        seq = dense[ids]
        zeros, planes, ones, samples = [], [], [], []
        for level in reversed(range(max(1, (max(1, len(alphabet)) - 1).bit_length()))):
            bit = (seq & kind(1 << level)) != 0
            packed = np.packbits(bit, bitorder="little")
            padded = np.zeros(-(-len(packed) // 64) * 64, np.uint8)
            padded[: len(packed)] = packed
            per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint64)
            count = np.concatenate([np.zeros(1, np.uint64), per.cumsum(dtype=np.uint64)])
            total = int(count[-1])
            seq = np.concatenate([seq.compress(~bit), seq.compress(bit)])
            planes.append(packed)
            ones.append(count)
            zeros.append(len(bit) - total)
            before = np.arange(len(count), dtype=np.int64) * BLOCK - count.astype(np.int64)
            for kinds, size in ((before, zeros[-1]), (count, total)):
                samples.append((np.searchsorted(kinds, np.arange(0, size, SAMPLE), side="right") - 1).astype(np.uint32))
        return cls(len(ids), alphabet, zeros, planes, ones, samples)

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3]) >> (i & 7) & 1

    def _rank1(self, level: int, i: int) -> int:
        """Ones before position i."""
        block = i // BLOCK
        from_byte, to_byte = block * BLOCK // 8, i >> 3
        plane = self.planes[level]
        n = int(self.ones[level][block]) + int(np.bitwise_count(plane[from_byte:to_byte]).sum())
        return n + (int(plane[to_byte]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else n

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of that kind: between two samples, the block by the directory, then the bit in it."""
        ones, sample = self.ones[level], self.samples[2 * level + bit]
        before = (lambda b: int(ones[b])) if bit else (lambda b: b * BLOCK - int(ones[b]))
        at = k // SAMPLE
        lo, hi = int(sample[at]), int(sample[at + 1]) + 1 if at + 1 < len(sample) else len(ones) - 1
        block = bisect_right(range(lo, hi), k, key=before) + lo - 1
        part = self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8]
        return block * BLOCK + int(np.flatnonzero(np.unpackbits(part, bitorder="little") == bit)[k - before(block)])

    def access(self, i: int) -> int:
        """The token at position i."""
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, i), self._rank1(level, i)
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return int(self.alphabet[value])

    def _symbol(self, token: int) -> int | None:
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else None

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of token in positions start to end."""
        symbol, end = self._symbol(token), self.n if end is None else end
        if symbol is None:
            return 0
        for level in range(len(self.planes)):
            a, b = self._rank1(level, start), self._rank1(level, end)
            one = symbol >> (len(self.planes) - 1 - level) & 1
            start, end = (self.zeros[level] + a, self.zeros[level] + b) if one else (start - a, end - b)
        return max(0, end - start)

    def locate(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of token; -1 if there are fewer."""
        symbol = self._symbol(token)
        if symbol is None or k < 0 or k >= self.count(token):
            return -1
        bits = [symbol >> (len(self.planes) - 1 - level) & 1 for level in range(len(self.planes))]
        begin = 0
        for level, one in enumerate(bits):
            ones = self._rank1(level, begin)
            begin = self.zeros[level] + ones if one else begin - ones
        at = begin + k
        for level in reversed(range(len(bits))):
            at = self._select(level, bits[level], at - self.zeros[level] if bits[level] else at)
        return at

    def decode(self) -> np.ndarray:
        """The whole sequence."""
        kind = np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32
        seq = np.zeros(self.n, kind)
        for shift, level in enumerate(reversed(range(len(self.planes)))):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            out = np.empty(self.n, kind)
            zeros = self.zeros[level]
            seq[zeros:] |= kind(1 << shift)
            if 8 * min(zeros, self.n - zeros) < self.n:  # masks are faster where one kind is rare
                out[bit], out[~bit] = seq[zeros:], seq[:zeros]
            else:
                out[np.flatnonzero(~bit)], out[np.flatnonzero(bit)] = seq[:zeros], seq[zeros:]
            seq = out
        return self.alphabet[seq] if self.n else np.zeros(0, np.uint32)


def packed(a: np.ndarray) -> np.ndarray:
    """An array compressed: its type and its size before, then the bytes."""
    head = a.dtype.str.encode().ljust(8) + np.int64(a.nbytes).tobytes()
    return np.frombuffer(head + zstandard.ZstdCompressor(level=1).compress(a.tobytes()), np.uint8)


def unpacked(a: np.ndarray) -> np.ndarray:
    """What packed() was given."""
    raw = a.tobytes()
    size = int(np.frombuffer(raw[8:16], np.int64)[0])
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[16:], max_output_size=size), np.dtype(raw[:8].decode().strip()))


def open_shard(path: str, whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """doc_ids, which of them are known, lengths and the matrix of one file; mapped, or read if the whole is wanted."""
    sizes, ids, lengths, known, alphabet, *rest = read_file(path) if whole else load(path)
    n, levels, _, *zeros = unpacked(sizes).tolist()
    planes, ones, samples = rest[:levels], rest[levels : 2 * levels], rest[2 * levels :]
    return unpacked(ids), unpacked(known).astype(bool), unpacked(lengths), WaveletMatrix(n, unpacked(alphabet), zeros, planes, ones, samples)


def _groups(batches):
    """Batches joined to tables of ENCODED bytes or little more."""
    some, size = [], 0
    for batch in batches:
        some.append(batch)
        size += batch.nbytes
        if size >= ENCODED:
            yield pa.Table.from_batches(some)
            some, size = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _writer(path: str, vocabulary: str, end_id: int, shard_tokens: int):
    tail = np.uint32(end_id).tobytes()

    def shard_row(part: int, number: int, docs: list, ids: list[bytes]) -> pa.RecordBatch:
        m = WaveletMatrix.build(np.frombuffer(b"".join(ids), np.uint32))
        lengths = np.array([len(i) // 4 for i in ids], np.int64)
        known = np.array([d is not None for d in docs], np.uint8)
        small = [np.array([m.n, len(m.planes), len(docs), *m.zeros], np.int64), np.array([d or 0 for d in docs], np.int64), lengths, known, m.alphabet]
        save(f"{path}/{part:06d}-{number:06d}.wm", [*map(packed, small), *m.planes, *m.ones, *m.samples])
        return pa.RecordBatch.from_pylist([{"part": part, "shard": number, "n_tokens": m.n}], schema=MANIFEST)

    def run(batches):
        part, encoder, number = TaskContext.get().partitionId(), worker_encoder(vocabulary), 0
        docs, ids, held = [], [], 0
        for given in _groups(batches):
            for doc, found in zip(given.column(0).to_pylist(), encoder.encode(given.column(1).to_pylist()), strict=True):
                docs.append(doc)
                ids.append(found + tail)
                held += len(found) // 4 + 1
                if held >= shard_tokens:
                    yield shard_row(part, number, docs, ids)
                    docs, ids, held, number = [], [], 0, number + 1
        if docs:
            yield shard_row(part, number, docs, ids)

    return run


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, end_id: int = 0, shard_tokens: int = 1 << 21) -> None:
    """Tokenise docs, end each with end_id, and write wavelet matrices in ascending id order.

    A null text is empty. Rows that share an id are separate documents, ordered by their text; a null id comes first.
    A shard closes after shard_tokens; a longer document makes its shard as much longer.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    # As many ranges as the input has partitions: they grow with it.
    ranges = max(rows.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(ranges, "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    shards = ordered.mapInArrow(lean(_writer(path, vocabulary, end_id, shard_tokens)), MANIFEST_DDL)
    with small_batches(docs.sparkSession):
        shards.write.parquet(f"{path}/manifest")


def _reader(path: str, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for part, shard, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, known, lengths, m = open_shard(f"{path}/{part:06d}-{shard:06d}.wm", whole=True)
                data, ends = m.decode().tobytes(), lengths.cumsum()
                for s in range(0, len(ids), 1024):
                    some = slice(s, s + 1024)
                    own = [data[4 * (e - n) : 4 * e] for e, n in zip(ends[some].tolist(), lengths[some].tolist(), strict=True)]
                    yield pa.record_batch(
                        [pa.array(ids[some], mask=~known[some]), pa.array((base + ends - lengths)[some]), pa.array(lengths[some]), pa.array(own if with_ids else [None] * len(own), pa.binary()), pa.array([zlib.crc32(o) for o in own], pa.int64())],
                        schema=schema,
                    )

    return run


def read_shards(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Every document from the files: doc_id, start (ids of all documents before it), n_tokens, ids (null unless with_ids), ids_crc32."""
    sizes = spark.read.schema(MANIFEST_DDL).parquet(f"{path}/manifest")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per written partition goes to this unpartitioned window.
    before_part = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(own), F.lit(0)).alias("_shard")).join(before_part, "part")
    # One row a shard, with the ids before it: spread over tasks, each opens the files of its rows.
    wanted = base.select("part", "shard", (F.col("_part") + F.col("_shard")).alias("base"))
    tasks = max(1, min(sizes.count(), MAX_READERS))
    return wanted.repartition(tasks).mapInArrow(lean(_reader(path, with_ids)), "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")


def encode_and_read(docs: DataFrame, path: str | None = None, with_ids: bool = True, **options) -> DataFrame:
    """write_shards() to path (by default a new one in the shared folder), then read_shards()."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "wavelet")
    write_shards(docs, path, **options)
    return read_shards(spark, path, with_ids)
