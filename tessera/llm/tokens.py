"""Token ids by the tokenizers library, with the ids of recurring words kept.

Byte-level BPE never merges across its pre-tokens. A pre-token always begins at a single blank between two characters
that are not white space, and a single line end between two such characters is a pre-token of its own. A text may
therefore be cut there, each distinct piece encoded once, and the pieces' ids joined: the result equals encoding the
whole text. Arrow cuts the texts and numbers their distinct pieces; the ids of all known pieces lie in one array, from
which those of the texts are gathered.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Pieces longer than LONGEST are not kept, nor any beyond KEEP; both bound memory only.
LONGEST, KEEP = 40, 700_000
#: A text without any of this has blanks and line ends as its only white space, and every one of them is a place to cut.
UNEVEN = (
    r"[\x{09}\x{0b}-\x{0d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \x{0a}][ \x{0a}]|\A[ \x{0a}]|[ \x{0a}]\z"
)
#: Where a text with such white space may still be cut.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Punctuation that is a pre-token of its own where it ends a piece, after one of these.
MARKS, BEFORE = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", frozenset(map(chr, [*range(48, 58), *range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
#: Texts encoded at once, and missing pieces that go to the library as one text.
GROUP, TOGETHER = 2048, 256


class _Pieces(dict):
    """Numbers by piece. A piece it lacks is noted, and gets the next number.

    A piece is what follows a blank; NUL marks one without a blank before it (NUL alone: that text as it is, and after a
    line end: the line end and what follows it).
    """

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.kept = 0

    def __missing__(self, piece: str) -> int:
        found = self[piece] = self.kept + len(self.fresh)
        self.fresh.append(piece)
        return found


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs one after another."""
    return np.repeat(begin - (size.cumsum() - size), size) + np.arange(size.sum())


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. Vocabularies that are not byte-level BPE get whole texts."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.known = _Pieces()
        # The ids of the kept pieces one after another, and where each piece's begin and how many they are.
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cuts = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        if self.cuts and hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces come once: the library's own cache of words only costs time
        # Texts that spell a special token go to the library whole: it takes such tokens out before pre-tokenising.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary_of = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary_of.values()) + 1, bool)
        self.blank[[i for t, i in vocabulary_of.items() if t[0] == "\u0120"]] = True
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The pieces of texts one after another, how many each text has, and in which order the texts come."""
        uneven = pc.match_substring_regex(pa.array(texts, pa.large_string()), UNEVEN).to_numpy(zero_copy_only=False)
        counts, even, found = np.zeros(len(texts), np.int64), [], []
        for i in np.flatnonzero(~uneven).tolist():
            text = "\0" + texts[i].replace("\n", " \n\0")
            counts[i] = text.count(" ") + 1
            even.append(text)
        if even:
            found.append(pc.split_pattern(pa.array([" ".join(even)], pa.large_string()), " ").flatten())
        for i in np.flatnonzero(uneven).tolist():
            first, *rest = CUT.split(texts[i])
            counts[i] = len(rest) + 1
            found.append(pa.array(["\0" + first, *rest], pa.large_string()))
        return pa.concat_arrays(found).dictionary_encode(), counts, np.argsort(uneven, kind="stable")

    def _fresh_ids(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all pieces noted as missing, and where each piece's begin and how many they are.

        Marks that end a piece are one of their own. Pieces without white space are encoded many at once, and told apart by
        their first token.
        """
        known, fresh, some, joined = self.known, self.known.fresh, [[], [], []], []
        for k, p in enumerate(fresh):  # grows by the parts of pieces that end with marks
            bare = p.rstrip(MARKS)
            if len(bare) < len(p) and bare and bare[-1] in BEFORE:
                joined.append((k, known[bare], known["\0" + p[len(bare) :]]))
            else:
                some[2 if p[0] == "\0" or " " in p else p[:2] == "\n\0"].append(k)
        ids, sizes, order = [self.ids], [], []
        for kind, head, mark, join in ((0, " ", 0, " "), (1, "x", 2, "\n")):
            parts = [some[kind][s : s + TOGETHER] for s in range(0, len(some[kind]), TOGETHER)]
            texts = [head + join * (kind == 1) + join.join([fresh[k][mark:] for k in part]) for part in parts]
            for part, own in zip(parts, self._ids(texts), strict=True):
                starts = np.flatnonzero(self.blank[own] if kind == 0 else own == self.line_end)
                if len(starts) != len(part):
                    raise ValueError("pieces are not told apart by their first tokens")
                ids.append(own[starts[0] :])
                sizes.append(np.diff(np.append(starts, len(own))))
                order += part
        for s in range(0, len(some[2]), 4096):
            part = some[2][s : s + 4096]
            own = self._ids([p[1:] if p[0] == "\0" else " " + p for p in map(fresh.__getitem__, part)])
            ids += own
            sizes.append(np.array([len(i) for i in own]))
            order += part
        begin, size = np.append(self.begin, np.zeros(len(fresh), np.int64)), np.append(self.size, np.zeros(len(fresh), np.int64))
        if order:
            at, found = np.array(order) + known.kept, np.concatenate(sizes)
            begin[at], size[at] = len(self.ids) + found.cumsum() - found, found
        ids = np.concatenate(ids) if order else self.ids
        if joined:
            at, *parts = np.array(joined).T
            parts = np.stack(parts, axis=1)
            own, n = ids[_spread(begin[parts].ravel(), size[parts].ravel())], size[parts].sum(axis=1)
            begin[at + known.kept], size[at + known.kept] = len(ids) + n.cumsum() - n, n
            ids = np.concatenate([ids, own])
        return ids, begin, size

    def _keep(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """The noted pieces join the kept ones, unless they are too long or the limit was reached before them."""
        known, fresh, keep = self.known, self.known.fresh, []
        full = known.kept > KEEP
        for k, piece in enumerate(fresh, known.kept):
            if full or len(piece) > LONGEST:
                del known[piece]
            else:
                known[piece] = known.kept + len(keep)
                keep.append(k)
        if keep:
            begin, size = begin[keep], size[keep]
            self.begin = np.append(self.begin, len(self.ids) + size.cumsum() - size)
            self.ids = np.append(self.ids, ids[_spread(begin, size)])
            self.size = np.append(self.size, size)
            known.kept += len(keep)
        fresh.clear()

    def _pieced(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that may be cut."""
        pieces, counts, order = self._cut(texts)
        names = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))[pieces.indices.to_numpy()]
        ids, begin, size = self._fresh_ids()
        self._keep(ids, begin, size)
        lengths = size[number]
        data = ids[_spread(begin[number], lengths)].tobytes()
        ends = 4 * np.append(0, lengths.cumsum())[np.append(0, counts[order].cumsum())]
        out = [b""] * len(texts)
        for i, a, b in zip(order.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = data[a:b]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text is empty."""
        out: list[bytes] = []
        for s in range(0, len(texts), GROUP):
            some = [t or "" for t in texts[s : s + GROUP]]
            whole = {i for i, t in enumerate(some) if not t or not self.cuts or "\0" in t or any(x in t for x in self.special)}
            cut = [t for i, t in enumerate(some) if i not in whole]
            rest = iter(self._pieced(cut) if cut else [])
            out += [self._ids([t])[0].tobytes() if i in whole else next(rest) for i, t in enumerate(some)]
        return out


@lru_cache(2)
def worker_encoder(vocabulary: str) -> Encoder:
    """One encoder for all tasks that a Python worker runs."""
    return Encoder(vocabulary)
