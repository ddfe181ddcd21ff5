"""Byte-level BPE: pre-tokenisation by codepoint classes and transition scans, cached pair merging, decoding by offsets."""

from __future__ import annotations

import base64
import functools
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import only

# Classes of code points. The pattern knows letters, numbers, white space and the rest; a plain space and the apostrophe
# act apart, and so do the letters of the contractions 's 't 're 've 'm 'll 'd.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE = range(6)
#: Slices whose ids a worker remembers.
CACHE_SLICES = 400_000


def _members(pattern: str, points: str) -> np.ndarray:
    """The code points of ``points`` that a class of the library's patterns holds: an encoding of single bytes keeps just them."""
    import tiktoken

    keeps = tiktoken.Encoding("members", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return np.frombuffer(bytes(keeps.encode_ordinary(points)).decode().encode("utf-32-le"), np.uint32)


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the library's own patterns; made once a worker."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        out[_members(pattern, every)] = kind
    out[0x20] = SPACE
    out[0x27] = QUOTE
    return out


# The automaton's states: what the token that is open consists of. SP: a plain space that the next token may take in.
START, IN_LETTER, IN_NUMBER, IN_OTHER, SP, WS = range(6)
# Letters of one code point or two after a token-starting quote make a contraction; symbols of the automaton are
# class + 6 * (a contraction may start here), the latter set for a quote with such letters behind it.
CUT, JOIN = 0, 1


def _step(state: int, symbol: int) -> int:
    """The state after a code point. A quote that opens a contraction leaves START, so its letters begin afresh."""
    kind, contraction = symbol % 6, symbol >= 6
    if kind == SPACE:
        return SP
    if kind == BLANK:
        return WS
    if kind == LETTER:
        return IN_LETTER
    if kind == NUMBER:
        return IN_NUMBER
    if kind == QUOTE and contraction and state not in (IN_OTHER, SP):
        return START
    return IN_OTHER


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each symbol, product table, image of START) of the transition functions closed under composition."""
    letters = [tuple(_step(s, a) for s in range(6)) for a in range(12)]
    elements = {tuple(range(6)): 0}
    todo = [tuple(range(6))]
    while todo:
        f = todo.pop()
        for a in letters:
            g = tuple(a[f[s]] for s in range(6))
            if g not in elements:
                elements[g] = len(elements)
                todo.append(g)
    every = list(elements)
    product = np.array([[elements[tuple(g[f[s]] for s in range(6))] for g in every] for f in every], np.uint8)
    return np.array([elements[a] for a in letters], np.uint8), product.ravel(), np.array([f[START] for f in every], np.uint8)


def scan_states(symbols: np.ndarray, block: int = 128) -> np.ndarray:
    """The automaton's state after each symbol: a prefix scan of transition functions under their associative product.

    The symbols are laid out in columns of ``block``; the scan runs down all columns at once, the products of whole columns
    are scanned the same way, and each column is then multiplied by what stands before it.
    """
    element, product, image = _monoid()
    size = np.intp(int(len(product) ** 0.5))

    def scan(f: np.ndarray) -> np.ndarray:
        n = len(f)
        if n <= block:
            out, now = np.empty(n, np.uint8), 0
            for i, x in enumerate(f.tolist()):
                now = int(product[now * size + x])
                out[i] = now
            return out
        rows = -(-n // block)
        grid = np.zeros(rows * block, np.uint8)
        grid[:n] = f
        grid = np.ascontiguousarray(grid.reshape(rows, block).T)  # element i of every block lies together
        for i in range(1, block):
            grid[i] = product[grid[i - 1] * size + grid[i]]
        before = np.concatenate([np.zeros(1, np.uint8), scan(grid[-1].copy())[:-1]])
        grid = product[(before * size)[None, :] + grid]
        return np.ascontiguousarray(grid.T).ravel()[:n]

    return image[scan(element[symbols])]


def boundaries(points: np.ndarray) -> np.ndarray:
    """True where a token begins, for the code points of texts that are each closed by 0x110000, beyond the code points; the
    closing point is a token of its own."""
    kind = classes()[np.minimum(points, sys.maxunicode)]
    n = len(points)
    symbols = kind.copy()
    quotes = np.flatnonzero(kind == QUOTE)
    one = points[np.minimum(quotes + 1, n - 1)]
    two = points[np.minimum(quotes + 2, n - 1)]
    is_in = lambda a, chars: np.isin(a, [ord(c) for c in chars])
    short = is_in(one, "stmd")
    long = (is_in(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    short &= quotes + 1 < n
    long &= quotes + 2 < n
    symbols[quotes[short | long]] += 6
    ends = points > sys.maxunicode
    symbols[ends] = BLANK  # leaves WS: nothing joins across texts
    state = scan_states(symbols)
    before = np.concatenate([np.array([WS], np.uint8), state[:-1]])
    begin = np.ones(n, bool)
    # letters, numbers and others go on with their like, or with the one space before them
    begin[(kind == LETTER) & ((before == IN_LETTER) | (before == SP))] = False
    begin[(kind == NUMBER) & ((before == IN_NUMBER) | (before == SP))] = False
    other = (kind == OTHER) | (kind == QUOTE)
    begin[other & ((before == IN_OTHER) | (before == SP))] = False
    # white space goes on with white space, but the last one of a run stands apart if a text follows and the run is longer
    white = ((kind == SPACE) | (kind == BLANK)) & ~ends
    begin[white & ((before == SP) | (before == WS)) & ~np.concatenate([[True], ends[:-1]])] = False
    after = np.concatenate([white[1:], [False]]) | np.concatenate([ends[1:], [True]])
    begin[white & ~after] = True  # the last white space before a text: its own token, or the head of the next one
    # a contraction: its letters belong to the quote, and a token begins behind them
    opened = (state[quotes] == START)
    for which, length in ((short & opened, 1), (long & opened, 2)):
        at = quotes[which]
        for k in range(1, length + 1):
            begin[at + k] = False
        tail = at + length + 1
        begin[tail[tail < n]] = True
    begin[ends] = True
    begin[np.flatnonzero(ends[:-1]) + 1] = True
    return begin


class ByteBpe:
    """Encoder and decoder of a rank file (base64 token, rank on each line)."""

    def __init__(self, path: str, cache_slices: int = CACHE_SLICES):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        ids = np.zeros(max(self.tokens) + 2, np.int64)
        for rank, token in self.tokens.items():
            ids[rank + 1] = len(token)
        self.starts = np.cumsum(ids)
        self.blob = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(len(ids) - 1)), np.uint8)
        self.cache: dict[str, bytes] = {}
        self.cache_slices = cache_slices

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the adjacent pair of lowest rank is merged, leftmost first, until none is known."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > 64:
            return self._merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        get = ranks.get
        pairs = [get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(pairs):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same for long slices, with a heap and links: n log n."""
        import heapq

        ranks, n = self.ranks, len(piece)
        end, prev, nxt, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != e:
                continue
            alive[j], end[i], nxt[i] = False, e, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                if (q := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (q, i, end[nxt[i]]))
            if prev[i] >= 0 and (q := ranks.get(piece[prev[i] : e])) is not None:
                heapq.heappush(heap, (q, prev[i], e))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def _ids_of(self, slices: list[str]) -> list[bytes]:
        cache = self.cache
        if len(cache) > self.cache_slices:
            cache.clear()
        out = []
        for s in slices:
            got = cache.get(s)
            if got is None:
                got = np.array(self.merge(s.encode()), "<u4").tobytes()
                if len(s) <= 64:
                    cache[s] = got
            out.append(got)
        return out

    def encode(self, texts: list[str | None], most: int = 1 << 20) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; texts go through in groups of about ``most`` code points."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at] or "") <= most):
                group.append(texts[at] or "")
                size += len(group[-1]) + 1
                at += 1
            joined = "\0".join(group) + "\0"
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
            last = np.cumsum([len(t) + 1 for t in group]) - 1
            points[last] = sys.maxunicode + 1
            starts = np.flatnonzero(boundaries(points))
            per_text = np.searchsorted(starts, last)  # tokens before each closing point, which is a token itself
            cuts = starts.tolist() + [len(points)]
            ids = self._ids_of([joined[a:b] for a, b in zip(cuts, cuts[1:])])
            first = 0
            for end in per_text.tolist():
                yield b"".join(ids[first:end])
                first = end + 1

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids: offsets into the joined vocabulary, gathered at once."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        if not len(at):
            return b""
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])
        return self.blob[places].tobytes()

    def offsets(self, ids: bytes) -> np.ndarray:
        """Byte offset of each id's first byte in the decoded text, and the text's length at the end."""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        return np.concatenate([[0], np.cumsum(self.starts[at + 1] - self.starts[at])])


def bpe(path: str) -> ByteBpe:
    return only(("bytes", path), lambda: ByteBpe(path))


def encode_documents(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_offsets: bool = False) -> DataFrame:
    """Rows ``(doc, ids[, offsets])``, ids as little-endian unsigned 32-bit bytes; null texts are empty and have no ids.

    Row by row, without a shuffle; repeated rows and null ids stay as they are, other columns are not read.
    """
    def run(batches):
        own = bpe(ranks_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            docs = batch.column("doc").to_pylist()
            made, size, at = [], 0, 0
            for ids in own.encode(texts):
                made.append(ids)
                size += len(ids)
                if size > 8 << 20:
                    yield _batch(own, docs[at : at + len(made)], made, with_offsets)
                    at, made, size = at + len(made), [], 0
            if made:
                yield _batch(own, docs[at:], made, with_offsets)

    def _batch(own, ids, made, with_offsets):
        arrays = [pa.array(ids, pa.int64()), pa.array(made, pa.binary())]
        if with_offsets:
            arrays.append(pa.array([own.offsets(x) for x in made], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(arrays, ["doc", "ids", "offsets"][: len(arrays)])

    schema = "doc long, ids binary" + ", offsets array<long>" * with_offsets
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Rows ``(doc, data)`` of rows ``(doc, ids)``: the decoded bytes; null ids give no bytes."""
    def run(batches):
        own = bpe(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array([own.decode(x or b"") for x in part.column("ids").to_pylist()], pa.binary())], ["doc", "data"])

    return encoded.select("doc", "ids").mapInArrow(run, "doc long, data binary")


def round_trip_digests(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc, n_tokens, ids_sha256, decoded_sha256)``: encodes and decodes without letting the ids leave the worker."""
    def run(batches):
        own = bpe(ranks_path)
        for batch in batches:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()) for ids in own.encode(batch.column("text").to_pylist())]
            if rows:
                n, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, "doc long, n_tokens long, ids_sha256 string, decoded_sha256 string")
