"""Line deduplication: documents probe minimal perfect hash arrays of the frequent lines instead of joining lines.

1. Each document yields the 128-bit hash of each distinct long line (``mapInArrow``); rows of one hash and document become
   one, and a grouped count with map-side combination gives documents and the largest document id per hash.
2. Hashes found in enough documents are dealt to shards; each shard's minimal perfect hash (levels of bit arrays, each key
   in the first level where nothing collides with it) indexes a fingerprint, a count and an owner array. The arrays lie in
   the cluster's shared folder, one Parquet file of blobs per shard group.
3. A second scan of the documents probes the arrays: the lines of a slab of texts are sorted by shard and each shard is
   loaded at most once a slab, so a worker holds a bounded part of the arrays and a hot line costs no more than any other.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import WHITE, carried, new_path, only, release, tidy

#: Keys of a shard at most, in the mean: about 1.2 MB of arrays.
SHARD_KEYS = 50_000
#: Bytes of shard arrays that a worker keeps, and of texts whose lines are probed together: shards are read as often as there
#: are slabs, so larger slabs read less and hold more.
CACHE_BYTES, SLAB_BYTES = 64 << 20, 16 << 20
_GAMMA = 2.0


def line_key(line: str) -> str:
    """The key of a line: stripped of ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""
    return line.strip(WHITE).encode().lower().decode()


def _long_keys(lines: list[str], min_chars: int) -> list[tuple[int, bytes]]:
    """(place, 16-byte hash) of every line whose key has enough code points."""
    out = []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(WHITE)) >= min_chars:
            out.append((i, xxhash.xxh3_128_digest(key.encode().lower())))
    return out


def _slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place for each 128-bit key; both halves count at every level."""
    salt = (0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF
    x = hi ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= lo + np.uint64(salt >> 1)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys (hi, lo): one bit array per level; ranks number the keys 0..n-1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, below = [], 0
        for bits in levels:
            self.ranks.append(np.cumsum(bits, dtype=np.int64) + (below - 1))
            below += int(bits.sum())
        self.n = below

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels, hi, lo = [], np.asarray(hi, np.uint64), np.asarray(lo, np.uint64)
        while len(hi):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            size = max(8, int(_GAMMA * len(hi)))
            at = _slot(hi, lo, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            rest = ~alone[at]
            hi, lo = hi[rest], lo[rest]
        return cls(levels)

    def __call__(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The index of each key; for keys that were not built in, any index or -1."""
        out = np.full(len(hi), -1, np.int64)
        todo = np.arange(len(hi))
        for k, bits in enumerate(self.levels):
            if not len(todo):
                break
            at = _slot(hi[todo], lo[todo], k, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.ranks[k][at[hit]]
            todo = todo[~hit]
        return out

    def dump(self) -> tuple[bytes, list[int]]:
        return b"".join(np.packbits(x).tobytes() for x in self.levels), [len(x) for x in self.levels]

    @classmethod
    def load(cls, blob: bytes, sizes: list[int]) -> PerfectHash:
        levels, at = [], 0
        for size in sizes:
            n = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, n, at), count=size).astype(bool))
            at += n
        return cls(levels)


_SHARD_SCHEMA = pa.schema([("shard", pa.int64()), ("levels", pa.binary()), ("sizes", pa.list_(pa.int64())), ("prints", pa.binary()), ("counts", pa.binary()), ("owners", pa.binary())])


def _build_shard(table: pa.Table) -> pa.Table:
    """The arrays of one shard; rows (shard, hi, lo, n, owner)."""
    hi = table["hi"].to_numpy().view(np.uint64)
    lo = table["lo"].to_numpy().view(np.uint64)
    mph = PerfectHash.build(hi, lo)
    at = mph(hi, lo)
    arrays = []
    for values, kind in ((lo, np.uint64), (np.minimum(table["n"].to_numpy(), 0xFFFFFFFF), np.uint32), (table["owner"].to_numpy(), np.int64)):
        a = np.zeros(mph.n, kind)
        a[at] = values.astype(kind)
        arrays.append(a.tobytes())
    blob, sizes = mph.dump()
    return pa.Table.from_pylist([{"shard": table["shard"][0].as_py(), "levels": blob, "sizes": sizes, "prints": arrays[0], "counts": arrays[1], "owners": arrays[2]}], schema=_SHARD_SCHEMA)


class ShardReader:
    """Reads shards from the shared folder, keeping at most ``budget`` bytes of them."""

    def __init__(self, path: str, budget: int):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path)
        self.budget, self.held, self.bytes = budget, OrderedDict(), 0

    def __call__(self, shard: int):
        if shard in self.held:
            self.held.move_to_end(shard)
            return self.held[shard][0]
        folder = f"{self.root}/shard={shard}"
        names = [f.path for f in self.fs.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True)) if f.path.endswith(".parquet")]
        got, size = None, 64
        if names:
            row = pq.ParquetFile(self.fs.open_input_file(names[0])).read().to_pylist()[0]
            mph = PerfectHash.load(row["levels"], row["sizes"])
            got = (mph, np.frombuffer(row["prints"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["owners"], np.int64))
            size += 9 * sum(row["sizes"]) + 20 * mph.n
        self.held[shard] = (got, size)
        self.bytes += size
        while self.bytes > self.budget and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1][1]
        return got


def _reader(path: str, budget: int) -> ShardReader:
    return only(("lines", path, budget), lambda: ShardReader(path, budget))


def _pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, or single rows."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def _keys_of(min_chars: int):
    def run(batches):
        only("line keys", dict)
        for batch in batches:
            for part in _pieces(batch):
                digests, ids = [], []
                for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
                    mine = {d for _, d in _long_keys(text.split("\n"), min_chars)} if text else ()
                    digests += mine
                    ids += [doc] * len(mine)
                if digests:
                    two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), pa.array(ids, pa.int64())], ["hi", "lo", "doc"])
    return run


def _probe(path: str | None, shards: int, min_chars: int, min_docs: int, slab_bytes: int, cache_bytes: int):
    def run(batches):
        reader = _reader(path, cache_bytes) if path else None
        slab, size = [], 0
        for batch in batches:
            for part in _pieces(batch):
                slab.append((part, _probes_of(part, min_chars) if reader else None))
                size += part.nbytes
                if size >= slab_bytes:
                    yield from _probed(slab, reader, shards, min_docs)
                    slab, size = [], 0
        yield from _probed(slab, reader, shards, min_docs)
    return run


def _probes_of(part: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every long line of a piece: its row, its place among the row's lines, and its hash as two words."""
    rows, lines, digests = [], [], []
    for r, text in enumerate(part.column("text").to_pylist()):
        for i, digest in _long_keys(text.split("\n"), min_chars) if text else ():
            rows.append(r)
            lines.append(i)
            digests.append(digest)
    return np.array(rows, np.int32), np.array(lines, np.int32), np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)


def _probed(slab: list, reader, shards: int, min_docs: int) -> Iterator[pa.RecordBatch]:
    """The pieces of a slab without the lines that go: all their lines are probed shard by shard."""
    gone = [[] for _ in slab]
    if reader and slab:
        piece = np.repeat(np.arange(len(slab)), [len(p[0]) for _, p in slab])
        row, line, key = (np.concatenate(c) for c in zip(*(p for _, p in slab)))
        slab = [(part, p[:1]) for part, p in slab]  # the hashes lie in ``key`` now
        least = np.iinfo(np.int64).min
        ids = [np.array([least if d is None else d for d in part.column("doc").to_pylist()], np.int64) for part, _ in slab]
        doc = np.concatenate([own[p[0]] for own, (_, p) in zip(ids, slab)]) if len(row) else np.zeros(0, np.int64)
        hi, lo = np.ascontiguousarray(key[:, 0]), np.ascontiguousarray(key[:, 1])
        shard = hi.view(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else ():
            arrays = reader(int(shard[own[0]]))
            if arrays is None:
                continue
            mph, prints, counts, owners = arrays
            at = mph(hi[own], lo[own])
            own, at = own[at >= 0], at[at >= 0]
            own = own[(prints[at] == lo[own]) & (counts[at] >= min_docs) & (owners[at] != doc[own])]
            for p in np.unique(piece[own]):
                mine = own[piece[own] == p]
                gone[p].append((row[mine], line[mine]))
    for (part, _), found in zip(slab, gone):
        drop: dict[int, set[int]] = {}
        for rows, lines in found:
            for r, i in zip(rows.tolist(), lines.tolist()):
                drop.setdefault(r, set()).add(i)
        texts = part.column("text").to_pylist()
        kept = ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop[r]) if r in drop else t or "" for r, t in enumerate(texts)]
        arrays = [c for n, c in zip(part.schema.names, part.columns) if n != "text"]
        names = [n for n in part.schema.names if n != "text"] + ["kept_text", "n_lines", "n_dropped"]
        arrays += [pa.array(kept, pa.string()), pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()), pa.array([len(drop.get(r, ())) for r in range(len(texts))], pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names)


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines repeated across documents; rows ``(doc, [carried columns,] kept_text, n_lines, n_dropped)``.

    A line whose key has at least ``min_chars`` code points and occurs in at least ``min_docs`` documents is dropped in all
    of them except the one with the largest id. Other lines stay, in order, joined by ``\\n``. Null or empty texts are one
    empty line. Each row counts as a document, so repeated rows with one id count apart and all of them own what that id
    owns. A null id counts as smaller than any other. Other columns are read only if ``carry``
    names them.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    counts = (
        source.mapInArrow(tidy(_keys_of(min_chars)), "hi long, lo long, doc long")
        .distinct()
        .groupBy("hi", "lo")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("doc", F.lit(-(2**63)))).alias("owner"))
        .where(F.col("n") >= min_docs)
    )
    path = new_path(spark, "line-keys")
    counts.write.parquet(path + "-keys")
    keys = spark.read.schema("hi long, lo long, n long, owner long").parquet(path + "-keys")
    total = keys.count()
    release(spark)
    shards = max(1, -(-total // SHARD_KEYS))
    if total:
        sharded = keys.withColumn("shard", F.pmod("hi", F.lit(shards)))
        built = sharded.groupBy("shard").applyInArrow(_build_shard, "shard long, levels binary, sizes array<long>, prints binary, counts binary, owners binary")
        built.write.partitionBy("shard").parquet(path)
    extra = docs.select(*carry).schema.fields
    schema = ", ".join(["doc long", *(f"`__carried_{f.name}` {f.dataType.simpleString()}" for f in extra), "kept_text string, n_lines long, n_dropped long"])
    whole = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), *[F.col(c).alias(f"__carried_{c}") for c in carry])
    out = whole.mapInArrow(tidy(_probe(path if total else None, shards, min_chars, min_docs, SLAB_BYTES, CACHE_BYTES)), schema)
    return out.select("doc", *[F.col(f"__carried_{c}").alias(carried(c, ["doc", "kept_text", "n_lines", "n_dropped"])) for c in carry], "kept_text", "n_lines", "n_dropped")
