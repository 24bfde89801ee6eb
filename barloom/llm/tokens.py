"""Token ids of whole texts, by the tokenizers library, each distinct word encoded once for a worker."""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from .common import U64, span_hashes, utf8

SPACE, LETTER, DIGIT, MARK, OTHER = range(5)
#: Kinds of bytes. Quotes and the signs of special tokens, control characters and all bytes from 128 on are OTHER.
_KINDS = np.full(256, OTHER, np.uint8)
_KINDS[[9, 10, 11, 12, 13, 32]] = SPACE
for _c in range(33, 127):
    _KINDS[_c] = LETTER if chr(_c).isalpha() else DIGIT if chr(_c).isdigit() else OTHER if chr(_c) in "'<|>" else MARK
#: Bytes as the characters that stand for them in the vocabulary: printable ones of Latin-1 as they are, the others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARACTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Bytes of units that are hashed at once.
BLOCK = 1 << 20


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First bytes of the units that encode on their own, last bytes plus one, whether each is plain, and the text as it is looked up.

    Nothing in this kind of vocabulary (normal form, white space dropped, lower case; runs of letters, single digits and runs of other
    signs apart) looks across white space. Chunks between white space that hold only ASCII and the letters of Latin-1 are cut further:
    letters from signs, and digits one by one. These units are plain; their A to Z are looked up as a to z. All other chunks stay whole.
    """
    n = len(data)
    kind = _KINDS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    solid = kind != SPACE
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[n] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    chunk = np.cumsum(first, dtype=np.int32)
    odd = np.zeros(int(chunk[-1]) + 1 if n else 1, bool)
    odd[chunk[kind == OTHER]] = True
    plain = ~odd[chunk]
    first[1:] |= solid[1:] & plain[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n] | first[1:]
    low = data + np.uint8(32) * (plain & (data >= 65) & (data <= 90)).astype(np.uint8)
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, plain[starts], low


class WordEncoder:
    """Encodes texts unit by unit (see units), each distinct one once as long as it is kept.

    Tests compare the ids with those of whole texts. Units are known by 64-bit hashes together with their first 8 bytes; those of more
    than ``longest`` bytes are encoded each time. At most ``keep`` are kept; beyond that the half that was used last stays. Ids are
    unsigned 32-bit integers.
    """

    def __init__(self, path: str, keep: int = 400_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.direct = self.tokenizer.model.tokenize
        self.keep, self.longest, self.turn = keep, longest, 0
        self.hashes, self.heads = np.zeros(0, U64), np.zeros(0, U64)
        self.first, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, words: list[bytes], plain: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has. Plain ones go to the model as they would come from the pre-tokeniser."""
        out: list[array] = [array("I")] * len(words)
        rest = []
        for i, (w, p) in enumerate(zip(words, plain, strict=True)):
            if p:
                shown = w.decode() if w.isascii() else w.decode().lower().encode().decode("latin-1").translate(_CHARACTERS)
                out[i] = array("I", [t.id for t in self.direct(shown)])
            else:
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("I", e.ids)
        return np.frombuffer(b"".join([x.tobytes() for x in out]), np.uint32), np.array([len(x) for x in out], np.int64)

    def _look_up(self, hashes: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the table, and which of them hold."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, (self.hashes[at] == hashes) & (self.heads[at] == heads)

    def _keep(self, hashes: np.ndarray, heads: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add units to the table, and let go of the half that wasn't used for longest when it is full."""
        first = len(self.pool) + np.cumsum(sizes) - sizes
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.pool = np.concatenate([self.pool, ids])
        more = {"hashes": hashes, "heads": heads, "first": first, "size": sizes, "used": np.full(len(hashes), self.turn)}
        if len(both) > self.keep:
            used = np.concatenate([self.used, more["used"]])
            order = order[used[order] > np.sort(used)[len(used) - max(1, self.keep // 2)] - 1]
            order = order if len(order) <= self.keep else order[used[order] == self.turn][: self.keep]
        for name, x in more.items():
            setattr(self, name, np.concatenate([getattr(self, name), x])[order])
        if len(both) > self.keep:
            self.pool, self.first = _gather(self.pool, self.first, self.size)[0], np.cumsum(self.size) - self.size

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row's begin. Null is empty."""
        data, offsets = utf8(column)
        starts, ends, plain, low = units(data, offsets)
        self.turn += 1
        hashes, at = np.arange(len(starts), dtype=U64), 0  # what is too long to hash is a number of its own
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
            a, b = int(starts[at]), int(ends[to - 1])
            if to > at + 1 or b - a <= BLOCK:
                hashes[at:to] = span_hashes(low[a:b], starts[at:to] - a, ends[at:to] - a)
            at = to
        long = np.flatnonzero(ends - starts > self.longest)
        # a plain unit is looked up in lower case, so it isn't the unit of the same bytes in a chunk that stays whole
        hashes[plain] ^= U64(1)
        both = pa.array(hashes).dictionary_encode()
        code, distinct = both.indices.to_numpy(), both.dictionary.to_numpy()
        one = np.empty(len(distinct), np.int64)
        one[code[::-1]] = np.arange(len(code))[::-1]
        padded = np.append(low, np.zeros(8, np.uint8))
        size = np.minimum(ends[one] - starts[one], 8)
        heads = np.zeros(len(one), U64)
        for j in range(8):
            heads |= np.where(j < size, padded[starts[one] + j], 0).astype(U64) << U64(8 * j)
        place, known = self._look_up(distinct, heads)
        self.used[place[known]] = self.turn
        short = ends[one] - starts[one] <= self.longest
        first, sizes = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        first[known], sizes[known] = self.first[place[known]], self.size[place[known]]
        fresh = np.flatnonzero(~known & short)
        raw = low.tobytes()
        got, n = self._learn([raw[a:b] for a, b in zip(starts[one[fresh]].tolist(), ends[one[fresh]].tolist(), strict=True)], plain[one[fresh]].tolist())
        first[fresh], sizes[fresh] = len(self.pool) + np.cumsum(n) - n, n
        pool = np.concatenate([self.pool, got])
        unit_first, unit_size = first[code], sizes[code]
        if len(long):
            words, n_long = self._learn([raw[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], plain[long].tolist())
            unit_first[long], unit_size[long] = len(pool) + np.cumsum(n_long) - n_long, n_long
            pool = np.concatenate([pool, words])
        out, begins = _gather(pool, unit_first, unit_size)
        if len(fresh):
            self._keep(distinct[fresh], heads[fresh], got, n)
        return out, begins[np.searchsorted(starts, offsets)]

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of each row as little-endian bytes."""
        ids, at = self.ids(column)
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of pool one after the other, and where each begins (and the last ends)."""
    begins = np.concatenate([[0], np.cumsum(size)])
    return pool[np.repeat(first - begins[:-1], size) + np.arange(begins[-1])], begins


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def default_vocabulary() -> str:
    """The 49k word vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
