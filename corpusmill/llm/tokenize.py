"""Encoding of whole texts by a public byte-level BPE tokenizer: codepoint classes and
an associative scan of transition functions find the pieces, no regular expression;
pieces go through cached pair merging, with offsets kept for decoding."""

from __future__ import annotations

import base64
import functools
import os
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Pieces a worker remembers, and characters scanned at a time.
CACHE, CHUNK = 400_000, 1 << 20

# Symbols of the scan. Letters, numbers, other signs, a blank before something visible,
# other white space before something visible, white space before white space or the end,
# an apostrophe that may open a one- or two-letter ending.
L, N, O, SP, WS, WW, A1, A2 = range(8)
# States: closed, in letters, in numbers, in other signs, after a blank that joins what
# follows, in white space, before the last and before the last but one letter of an ending.
S0, SL, SN, SO, SB, SW, E1, E2 = range(8)
#: The endings that are pieces of their own.
ENDINGS_1, ENDINGS_2 = ("s", "t", "d", "m"), ("re", "ve", "ll")


@functools.cache
def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """``next[symbol, state]`` and ``begins[symbol, state]``. Symbols from 8 on are the
    same at the beginning of a text."""
    nxt, beg = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    joins = {L: (SL, (SL, SB)), N: (SN, (SN, SB)), O: (SO, (SO, SB))}
    for s in range(8):
        for sym, (to, cont) in joins.items():
            nxt[sym, s], beg[sym, s] = to, s not in cont
        for sym, to in ((A1, E1), (A2, E2)):
            nxt[sym, s], beg[sym, s] = (SO, s not in (SO, SB)) if s in (SO, SB) else (to, True)
        nxt[SP, s], beg[SP, s] = SB, True
        nxt[WS, s], beg[WS, s] = S0, True
        nxt[WW, s], beg[WW, s] = SW, s != SW
    nxt[L, E1], beg[L, E1] = S0, False
    nxt[L, E2], beg[L, E2] = E1, False
    for sym in range(8):
        nxt[sym + 8], beg[sym + 8] = nxt[sym, S0], beg[sym, S0]
    return nxt, beg


@functools.cache
def _classes() -> np.ndarray:
    """Letter, number, other or white space (as ``WW``) of every code point."""
    t = np.full(sys.maxunicode + 1, O, np.uint8)
    kinds = {"L": L, "N": N}
    for c in range(sys.maxunicode + 1):
        k = kinds.get(unicodedata.category(chr(c))[0])
        if k is not None:
            t[c] = k
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        t[c] = WW
    return t


def _symbols(cp: np.ndarray, begin: np.ndarray) -> np.ndarray:
    sym = _classes()[cp]
    first = np.zeros(len(cp) + 1, bool)
    first[begin] = True
    first[len(cp)] = True
    seen = np.zeros(len(cp), bool)  # something visible of the same text follows
    seen[:-1] = (sym[1:] != WW) & ~first[1:-1]
    ws = sym == WW
    out = sym.copy()
    out[ws & seen] = WS
    out[ws & seen & (cp == 0x20)] = SP
    ap = np.flatnonzero((cp == 0x27) & seen)
    if len(ap):
        a = cp[np.minimum(ap + 1, len(cp) - 1)]
        two = (ap + 2 < len(cp)) & ~first[np.minimum(ap + 2, len(cp))]
        b = np.where(two, cp[np.minimum(ap + 2, len(cp) - 1)], 0)
        out[ap[np.isin(a, [ord(x) for x in ENDINGS_1])]] = A1
        for x, y in ENDINGS_2:
            out[ap[(a == ord(x)) & (b == ord(y))]] = A2
    out[begin[begin < len(cp)]] += 8
    return out


def _scan(f: np.ndarray, width: int = 64) -> np.ndarray:
    """Inclusive scan of the functions ``f (n, 8)`` under composition: blocks column by
    column, then the blocks' totals by the same scan."""
    n = len(f)
    if n <= width:
        for i in range(1, n):
            f[i] = f[i][f[i - 1]]
        return f
    pad = -n % width
    g = np.concatenate([f, np.broadcast_to(np.arange(8, dtype=np.uint8), (pad, 8))]).reshape(-1, width, 8)
    for i in range(1, width):
        g[:, i] = np.take_along_axis(g[:, i], g[:, i - 1], 1)
    totals = _scan(g[:, -1].copy(), width)
    g[1:] = np.take_along_axis(g[1:], np.repeat(totals[:-1, None, :], width, 1), 2)
    return g.reshape(-1, 8)[:n]


def piece_starts(cp: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Positions at which pieces begin, for code points ``cp`` of texts that begin at ``begin``."""
    if not len(cp):
        return np.zeros(0, np.int64)
    nxt, beg = _transitions()
    sym = _symbols(cp, begin)
    before = np.zeros(len(cp), np.uint8)
    before[1:] = _scan(nxt[sym])[:-1, S0]
    return np.flatnonzero(beg[sym, before])


@functools.cache
def ranks_of(path: str) -> dict[bytes, int]:
    """The vocabulary file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the adjacent pair of lowest rank is merged until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 256:
        return _merge_long(parts, ranks)
    while len(parts) > 1:
        best, at = None, 0
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for very long pieces, by a heap over a linked list."""
    import heapq

    n = len(parts)
    nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or parts[i] != a or parts[j] != b:
            continue
        parts[i], alive[j], nxt[i] = a + b, False, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for x, y in ((prv[i], i), (i, nxt[i])):
            if x >= 0 and y < n and (r := ranks.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, parts[x], parts[y]))
    return [ranks[p] for p, k in zip(parts, alive, strict=True) if k]


class Encoder:
    """Encodes texts by the vocabulary at ``path``; remembers the pieces it has merged."""

    def __init__(self, path: str):
        self.ranks, self.cache = ranks_of(path), {}

    def _ids(self, piece: str) -> list[int]:
        ids = self.cache[piece] = merge_piece(piece.encode("utf-8", "replace"), self.ranks)
        if len(self.cache) > CACHE:
            self.cache.clear()
        return ids

    def encode(self, texts: list[str | None], offsets: bool = True) -> list[tuple[list[int], list[int]]]:
        """Per text the ids and, with ``offsets``, for each id the code point in which its bytes begin."""
        out: list[tuple[list[int], list[int]]] = [([], [])] * len(texts)
        todo, held = [], 0
        for i, t in enumerate(texts):
            if t:
                todo.append(i)
                held += len(t)
            if todo and (held >= CHUNK or i == len(texts) - 1):
                self._chunk([texts[k] for k in todo], todo, out, offsets)
                todo, held = [], 0
        if todo:
            self._chunk([texts[k] for k in todo], todo, out, offsets)
        return out

    def _inside(self, ids: list[int]) -> list[int]:
        """For the ids of a piece, the code points before each one's first byte that begins one."""
        if len(ids) == 1:
            return [0]
        seen, out = 0, []
        for i in ids:
            b = self.back[i]
            out.append(seen - (b[0] & 0xC0 == 0x80))
            seen += sum(x & 0xC0 != 0x80 for x in b)
        return out

    def _chunk(self, texts: list[str], where: list[int], out: list, offsets: bool) -> None:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(lens)])
        joined = "".join(texts)
        starts = piece_starts(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), begin[:-1])
        cut = np.searchsorted(starts, begin)
        ends = np.append(starts[1:], begin[-1]).tolist()
        starts_, cache = starts.tolist(), self.cache
        for k, i in enumerate(where):
            ids: list[int] = []
            at: list[int] = []
            for a, b in zip(starts_[cut[k] : cut[k + 1]], ends[cut[k] : cut[k + 1]], strict=True):
                piece = joined[a:b]
                got = cache.get(piece) or self._ids(piece)
                ids += got
                if offsets:
                    first = a - int(begin[k])
                    at += [first + x for x in self._inside(got)]
            out[i] = (ids, at)

    @functools.cached_property
    def back(self) -> dict[int, bytes]:
        return {v: k for k, v in self.ranks.items()}

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.back.__getitem__, ids)).decode("utf-8", "replace")

    def decode_between(self, ids: list[int], offsets: list[int], first: int, last: int) -> str:
        """The code points from ``first`` up to ``last`` of the encoded text, from the ids that
        hold them; a code point whose bytes are spread over ids is whole if it lies between."""
        some = [i for i, o in enumerate(offsets) if o < last]
        lo = max((i for i in some if offsets[i] <= first and self.back[ids[i]][0] & 0xC0 != 0x80), default=0)  # not within a code point
        text = self.decode(ids[lo : some[-1] + 1]) if some else ""
        return text[first - offsets[lo] : last - offsets[lo]] if some else ""


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str = "/opt/tokenizers") -> str:
    """The place of a public vocabulary on the driver, which gives it to the executors."""
    return f"{folder}/{name}"


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, offsets: bool = False) -> DataFrame:
    """``(key, ids[, offsets])`` for each row of ``df``, without special tokens.

    No shuffle: each task encodes its own rows; a worker holds the vocabulary, the
    code point classes and at most ``CACHE`` merged pieces. Null and empty texts have the ids
    ``[]``. The strings of special tokens inside a text are ordinary text. Lone
    surrogates become U+003F. Repeated rows are encoded each; other columns of
    ``df``, whatever their names, are not read."""
    path = path or vocabulary_path()
    df.sparkSession.sparkContext.addFile(path)
    name = os.path.basename(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(SparkFiles.get(name))
        for pdf in batches:
            got = e.encode(pdf["text"].where(pdf["text"].notna(), None).tolist(), offsets)
            out = {"key": pdf["key"], "ids": pd.Series([a for a, _ in got], index=pdf.index, dtype=object)}
            if offsets:
                out["offsets"] = pd.Series([b for _, b in got], index=pdf.index, dtype=object)
            yield pd.DataFrame(out)

    kind = dict(df.dtypes)[key]
    schema = f"key {kind}, ids array<int>" + ", offsets array<int>" * offsets
    return df.select(df[key].alias("key"), df[text].alias("text")).mapInPandas(run, schema).withColumnRenamed("key", key)


def ids(documents: DataFrame, path: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` by byte_bpe_50k."""
    return encode_column(documents, path=path)
