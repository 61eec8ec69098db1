"""Arrays in files of the shared folder, and runs of sorted batches: what workers exchange beside tables."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa


def runs(batches, key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(key, rows) for every run of equal keys in sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if held and last != at[a]:
                yield last, _joined(held)
                held = []
            last = at[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield last, _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def save(path: str, arrays: list[np.ndarray]) -> None:
    """Arrays in one file: their number, types and lengths, then their bytes from multiples of 8 on. The rename is the commit."""
    import pyarrow.fs as pafs

    kinds = b"".join(a.dtype.str.encode().ljust(8) + np.int64(len(a)).tobytes() for a in arrays)
    body = [np.int64(len(arrays)).tobytes(), kinds]
    for a in arrays:
        body += [a.tobytes(), bytes(-a.nbytes % 8)]
    where, name = pafs.FileSystem.from_uri(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    own = f"{name}.{os.getpid()}.{os.urandom(4).hex()}"
    with where.open_output_stream(own) as out:
        for part in body:
            out.write(part)
    try:
        where.move(own, name)
    except OSError:  # a store whose rename refuses an existing target: another attempt of the task was first, with the same bytes
        if where.get_file_info(name).type == pafs.FileType.NotFound:
            raise
        where.delete_file(own)


#: Bytes of files of a remote store that a worker keeps.
NEAR = 256 << 20
_near: dict[str, list[np.ndarray]] = {}


def load(path: str) -> list[np.ndarray]:
    """The arrays of a saved file: memory maps, or from a remote store in memory, of which the last NEAR bytes are kept."""
    import pyarrow.fs as pafs

    where, name = pafs.FileSystem.from_uri(path)
    if where.type_name == "local":
        return _mapped(name)
    if path not in _near:
        found = read_file(path)
        while _near and sum(a.nbytes for f in [*_near.values(), found] for a in f) > NEAR:
            del _near[next(iter(_near))]
        _near[path] = found
    return _near[path]


@lru_cache(256)
def _mapped(name: str) -> list[np.ndarray]:
    return _arrays_of(np.asarray(np.memmap(name, np.uint8, "r")))


def read_file(path: str) -> list[np.ndarray]:
    """The arrays of a saved file, read as a whole."""
    import pyarrow.fs as pafs

    where, name = pafs.FileSystem.from_uri(path)
    with where.open_input_stream(name) as far:
        return _arrays_of(np.frombuffer(far.read(), np.uint8))


def _arrays_of(data: np.ndarray) -> list[np.ndarray]:
    n = int(data[:8].view(np.int64)[0])
    at, out = 8 + 16 * n, []
    for i in range(n):
        kind = np.dtype(bytes(data[8 + 16 * i : 16 + 16 * i]).decode().strip())
        size = int(data[16 + 16 * i : 24 + 16 * i].view(np.int64)[0])
        out.append(data[at : at + size * kind.itemsize].view(kind))
        at += -(-size * kind.itemsize // 8) * 8
    return out
