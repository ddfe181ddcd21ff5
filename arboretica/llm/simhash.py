"""SimHash near-duplicates: vantage-point shards and trees over Hamming space, links by union-find, components by stars.

Fingerprints are equal for equal texts, so all searching is done on distinct fingerprints. Two ways deal them to shards:

* ``vantage_shards``, lossless for a small radius r: the bits are cut into three blocks, and two fingerprints within r
  agree up to r // 3 bits in one of them. Each block has a tree of balls around fixed vantage points; a fingerprint goes
  down by its distance over the block's bits, and one that lies outside a ball but within r // 3 of its boundary goes to
  both sides, so both ends of such a pair meet in a shard. The depth follows the number of fingerprints.
* ``sampled_shards`` for a large radius, where every ball of such a tree would overlap all others: each shard is a ball of
  radius 0 over sampled bits, many times over. The sampled bits follow the number of fingerprints, so that shards keep their
  mean size, and the number of times follows the bits, so that the recall at the radius is the same at every size.

Within a shard a dual vantage-point tree finds all pairs: a pair of subsets goes on only where the triangle inequality
leaves a distance of r or less possible. Only a spanning forest of the links leaves the shard, and with a second radius the
doubtful pairs between its trees, a bounded number a row at a time, whose shingles are then compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import components, drop_kept, keep, only, release, tidy

#: Fingerprints of a vantage shard in the mean, and rows beyond which a shard is split into pairs of chunks.
SHARD_ROWS, LARGE_SHARD = 2_000, 20_000
#: Fingerprints of a sampled shard in the mean; doubtful partners of a row that leave a shard in the first round, and how
#: many times as many in each round after it.
SAMPLED_ROWS, ROUND_PARTNERS, ROUND_GROWTH = 1_000, 4, 8
#: Texts of the sample that finds frequent shingles, at least, and shingles that are listed as frequent; 64-bit words of
#: parities of a set.
SAMPLE_TEXTS, MOST_LISTED, PARITIES = 4_000, 100_000, 8
#: Sets of a shingle up to which all are compared at once; in larger ones, sets of similar size to a leader.
SMALL_BUCKET, LED = 16, 32
#: Pairs that are compared in one step.
COMPARED = 250_000
SALTS = 64
_BLOCKS = ((0, 22), (22, 21), (43, 21))


# ---- fingerprints

_LANES = np.array([sum(((v >> i) & 1) << (8 * i) for i in range(8)) for v in range(256)], np.uint64)
_ONES = np.array([1 << i for i in range(64)], np.uint64)


def shingle_hashes(text: str | None, words: int, seed: int) -> list[int]:
    """XXH64 of each run of ``words`` words (A-Z lower-cased, joined by a space), or of the whole sequence if it is shorter."""
    own = (text or "").encode().lower().split()
    n = len(own)
    if not n:
        return []
    digest = xxhash.xxh64_intdigest
    if n <= words:
        return [digest(b" ".join(own), seed)]
    joined = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - words]]).tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The 64-bit fingerprint of each run of hashes: bits set in over half of them; 0 for an empty run.

    Eight table lookups a hash put its bits into byte lanes, which are summed over at most 255 hashes before they widen.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    chunks = -(-n // 255)
    first = np.cumsum(chunks) - chunks
    begin = np.cumsum(n) - n
    cuts = np.repeat(begin, chunks) + 255 * (np.arange(chunks.sum()) - np.repeat(first, chunks))
    lanes = _LANES[np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    counts = np.add.reduceat(sums, first, axis=0)
    out[full] = ((2 * counts > n[:, None]) * _ONES).sum(axis=1, dtype=np.uint64)
    return out


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    if not k:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, parts: int = 1, distinct: bool = False) -> DataFrame:
    """Rows ``(doc, f0[, f1 ...])``: ``parts`` 64-bit fingerprints of each whole text, as signed longs; ``distinct`` counts a
    shingle that repeats once.

    Null texts and texts without a word have fingerprints of zero. Repeated rows and null ids stay; other columns are not read.
    """
    def run(batches):
        only("simhash", dict)
        for batch in batches:
            ids, texts = batch.column("doc"), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                first, all_hashes, sizes = at, [], []
                while at < len(texts) and len(all_hashes) < 100_000:
                    got = shingle_hashes(texts[at], words, seed)
                    if distinct:
                        got = list(dict.fromkeys(got))
                    all_hashes += got
                    sizes.append(len(got))
                    at += 1
                h, n = np.array(all_hashes, np.uint64), np.array(sizes, np.int64)
                cols = [pa.array(majority_bits(_mix(h, k), n).view(np.int64)) for k in range(parts)]
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), *cols], ["doc", *(f"f{k}" for k in range(parts))])

    schema = "doc long, " + ", ".join(f"f{k} long" for k in range(parts))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(tidy(run), schema)


# ---- shards

def _expand(classes: DataFrame, codes, parts: int) -> DataFrame:
    """Rows (code, rep, f0 ...): ``codes(f)`` gives (row numbers, codes) for fingerprints f of shape (n, parts)."""
    names = ["rep", *(f"f{k}" for k in range(parts))]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 4000):
                part = batch.slice(start, 4000)
                f = np.stack([part.column(n).to_numpy() for n in names[1:]], axis=1).view(np.uint64)
                rows, code = codes(f)
                took = [part.column(n).take(pa.array(rows)) for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(code), *took], ["code", *names])

    return classes.select(*names).mapInArrow(tidy(run), "code long, " + ", ".join(f"{n} long" for n in names))


def vantage_shards(classes: DataFrame, radius: int, n: int) -> DataFrame:
    """Shards of 64-bit fingerprints such that any two within ``radius`` (up to 11) share one."""
    slack = radius // 3
    shrink = 2 / (1 + sum(math.comb(21, 11 + i) for i in range(slack)) / 2**21)
    depth = max(0, math.ceil(math.log(max(1.0, n / SHARD_ROWS)) / math.log(max(shrink, 1.05))))
    points = np.random.default_rng(7).integers(0, 2**64, (len(_BLOCKS), max(1, depth)), np.uint64)

    def codes(f):
        rows_out, codes_out = [], []
        for b, (shift, width) in enumerate(_BLOCKS):
            mask = np.uint64(((1 << width) - 1) << shift)
            rows, code = np.arange(len(f)), np.full(len(f), b, np.int64)
            for level in range(depth):
                far = np.bitwise_count((f[:, 0] ^ points[b, level]) & mask).astype(np.int64) - width // 2
                d = far[rows]
                outside = d > 0
                both = outside & (d <= slack)
                rows, code = np.concatenate([rows, rows[both]]), np.concatenate([code * 2 + outside, code[both] * 2])
            rows_out.append(rows)
            codes_out.append(code + (b << 60))
        return np.concatenate(rows_out), np.concatenate(codes_out)

    return _expand(classes, codes, 1)


def sampled_shards(classes: DataFrame, parts: int, radius: int, n: int, recall: float) -> DataFrame:
    """Shards of the fingerprints that agree in sampled bits: about SAMPLED_ROWS of the n in each, and as many times as
    bring two fingerprints at distance ``radius`` together with a probability of ``recall`` (nearer ones more often)."""
    bits = max(0, math.ceil(math.log2(max(1.0, n / SAMPLED_ROWS))))
    meet = (1 - radius / (64 * parts)) ** bits
    times = 1 if meet >= recall else math.ceil(math.log(1 - recall) / math.log(1 - meet))
    rng = np.random.default_rng(11)
    places = [rng.permutation(64 * parts)[:bits] for _ in range(times)]
    power = 1 << np.arange(bits, dtype=np.int64)

    def codes(f):
        every = np.unpackbits(np.ascontiguousarray(f).view(np.uint8), axis=1)
        code = [every[:, p] @ power + (t << bits) for t, p in enumerate(places)]
        return np.tile(np.arange(len(f)), times), np.concatenate(code)

    return _expand(classes, codes, parts)


# ---- links within a shard

class _Forest:
    """Union-find over the rows of a shard by labels, and the links that joined two trees."""

    def __init__(self, n: int):
        self.label, self.links = np.arange(n), []

    def done(self, a: np.ndarray, b: np.ndarray) -> bool:
        own = self.label[a[0]]
        return bool((self.label[a] == own).all() and (self.label[b] == own).all())

    def row(self, i: int, js: np.ndarray) -> None:
        own = self.label[i]
        other = js[self.label[js] != own]
        if len(other):
            labels, first = np.unique(self.label[other], return_index=True)
            self.links += [(i, int(j)) for j in other[first]]
            self.label[np.isin(self.label, labels)] = own


class _Doubts(_Forest):
    """The pairs between a forest's trees; of each row those from ``first`` on in the order of the search, ``most`` of
    them. ``label`` stays as the forest left it, so each round counts the same pairs; ``far`` are components found since."""

    def __init__(self, forest: _Forest, far: np.ndarray, first: int, most: int):
        self.label, self.links = forest.label, []
        self.far, self.first, self.end, self.more = far, first, first + most, False
        self.seen = np.zeros(len(far), np.int64)

    def row(self, i: int, js: np.ndarray) -> None:
        js = js[self.label[js] != self.label[i]]
        at = self.seen[i]
        self.seen[i] += len(js)
        js = js[max(0, self.first - at) :]
        at = max(at, self.first)
        now = max(0, self.end - at)
        self.links += [(i, int(j)) for j in js[:now] if self.far[j] != self.far[i]]
        self.more = self.more or bool((self.far[js[now:]] != self.far[i]).any())


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint8 if a.shape[1] < 4 else np.uint16)
    for k in range(1, a.shape[1]):
        d = d + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return d


def _compare(f, a, b, radius, forest) -> None:
    """All pairs of rows a and b, in blocks."""
    step = max(1, 400_000 // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        near = _distances(f[rows], f[b]) <= radius
        for k in np.flatnonzero(near.any(axis=1)):
            forest.row(int(rows[k]), b[near[k]])


def _join(f, a, b, radius, forest, same: bool) -> None:
    """Links between rows a and b (``same``: within a), by vantage points and triangle bounds."""
    if not len(a) or not len(b) or forest.done(a, b):
        return
    if len(a) * len(b) <= 65_536:
        return _compare(f, a, b, radius, forest)
    point = f[a[len(a) // 2]][None, :]
    da = _distances(f[a], point)[:, 0].astype(np.int64)
    db = da if same else _distances(f[b], point)[:, 0].astype(np.int64)
    cut = int(np.median(da))
    if cut >= da.max():
        cut = int(da.max()) - 1
    a_in, a_out = da <= cut, da > cut
    if same:
        if not a_in.any() or a_in.sum() > 0.98 * len(a):
            return _compare(f, a, a, radius, forest)
        _join(f, a[a_in], a[a_in], radius, forest, True)
        _join(f, a[a_out], a[a_out], radius, forest, True)
        _join(f, a[a_in & (da > cut - radius)], a[a_out & (da <= cut + radius)], radius, forest, False)
    else:
        # |d(a, v) - d(b, v)| <= d(a, b): inside rows reach as far as cut + radius, outside rows as near as cut + 1 - radius
        b_in, b_out = db <= cut + radius, db > cut - radius
        if a_in.sum() * b_in.sum() + a_out.sum() * b_out.sum() > 0.95 * len(a) * len(b):
            return _compare(f, a, b, radius, forest)
        _join(f, a[a_in], b[b_in], radius, forest, False)
        _join(f, a[a_out], b[b_out], radius, forest, False)


def tree_links(f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (distance at most ``radius``) of fingerprints f of shape (n, parts)."""
    forest = _Forest(len(f))
    every = np.arange(len(f))
    _join(f, every, every, radius, forest, True)
    return forest.links


#: What a row of ``links`` is: a link, a pair whose shingles are to be compared, or (a = code) a shard with more such pairs.
LINK, DOUBT, MORE = 0, 1, 2


def _links_of_runs(code, rep, far, f, radius, doubt, first, most) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(rep, rep, kind) within each run of equal codes: small runs all at once by shifts, others by trees."""
    change = np.flatnonzero(np.diff(code)) + 1
    starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(code)]])
    sizes = ends - starts
    run = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes <= ROUND_PARTNERS, sizes)
    at, shift = np.flatnonzero(small), 1
    while len(at) and not first:
        at = at[at + shift < len(code)]
        at = at[run[at] == run[at + shift]]
        if len(at):
            d = sum(np.bitwise_count(f[at, k] ^ f[at + shift, k]).astype(np.int64) for k in range(f.shape[1]))
            for hit, kind in ((at[d <= radius], LINK), (at[(d > radius) & (d <= doubt)], DOUBT)):
                yield rep[hit], rep[hit + shift], kind
        shift += 1
    for r in np.flatnonzero(sizes > ROUND_PARTNERS):
        a, b = starts[r], ends[r]
        every, forest = np.arange(b - a), _Forest(b - a)
        _join(f[a:b], every, every, radius, forest, True)
        found = [(forest.links, LINK)] if not first else []
        if doubt > radius:
            doubts = _Doubts(forest, far[a:b], first, most)
            _join(f[a:b], every, every, doubt, doubts, True)
            found.append((doubts.links, DOUBT))
            if doubts.more:
                yield code[a : a + 1], code[a : a + 1], MORE
        for links, kind in found:
            if links:
                i, j = np.array(links).T
                yield rep[a:b][i], rep[a:b][j], kind


def deal_shards(shards: DataFrame, parts: int) -> DataFrame:
    """Adds (x, y): shards beyond LARGE_SHARD rows are split into chunks, and every pair of chunks becomes a shard of its
    own, so no task holds more than two chunks and no pair is lost."""
    names = ["rep", *(f"f{k}" for k in range(parts))]
    large = keep(shards.groupBy("code").count().where(F.col("count") > LARGE_SHARD), "large-shards")
    if not large.limit(1).count():
        return shards.withColumn("x", F.lit(0)).withColumn("y", F.lit(0))
    sized = shards.join(large, "code", "left").withColumn("n", F.ceil(F.coalesce("count", F.lit(1)) / LARGE_SHARD))
    own = F.pmod(F.xxhash64("f0", F.lit(5)), F.col("n"))
    sized = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return sized.select("code", *names, F.least("own", "other").cast("int").alias("x"), F.greatest("own", "other").cast("int").alias("y"))


def links(shards: DataFrame, radius: int, parts: int, doubt: int = 0, first: int = 0, most: int = ROUND_PARTNERS) -> DataFrame:
    """Rows ``(a, b, kind)`` for representatives of dealt shards: a spanning forest of the pairs within ``radius``, and of
    each row ``most`` pairs within ``doubt``, from number ``first`` on, whose ``far`` (where present) differ."""
    names = ["rep", *(f"f{k}" for k in range(parts))]
    key = ["code", "x", "y"]
    dealt = shards.repartition(*key).sortWithinPartitions(*key, "rep")
    later = "far" in shards.columns

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 50_000:
                table = pa.Table.from_batches(held).combine_chunks()
                last = [table[k][-1].as_py() for k in key]
                # the last run may go on in the next batch
                codes = [table[k].to_numpy() for k in key]
                same = (codes[0] == last[0]) & (codes[1] == last[1]) & (codes[2] == last[2])
                end = int(np.argmax(same))
                if end:
                    yield from found(table.slice(0, end))
                held = table.slice(end).to_batches()
                size = table.num_rows - end
        if held:
            yield from found(pa.Table.from_batches(held))

    def found(table: pa.Table):
        x = [table[k].to_numpy() for k in key]
        number = np.concatenate([[0], np.cumsum((np.diff(x[0]) != 0) | (np.diff(x[1]) != 0) | (np.diff(x[2]) != 0))])
        code = x[0][np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1])]
        f = np.stack([table[n].to_numpy() for n in names[1:]], axis=1).view(np.uint64)
        far = table["far" if later else "rep"].to_numpy()
        for a, b, kind in _links_of_runs(number, table["rep"].to_numpy(), far, f, radius, doubt, first, most):
            if len(a):
                a, b = (code[a], code[b]) if kind == MORE else (a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], ["a", "b", "kind"])

    return dealt.mapInArrow(tidy(run), "a long, b long, kind int")


# ---- the operators

def _components_of(prints: DataFrame, links_of, parts: int) -> DataFrame:
    """Adds ``component`` to rows (doc, f0 ...): the smallest doc reachable over links, through distinct fingerprints, and
    through ids that have several. ``links_of`` gives the links (a, b) of the distinct fingerprints and their number."""
    f = [f"f{k}" for k in range(parts)]
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    part = keep(salted.groupBy(*f, "salt").agg(F.min("doc").alias("rep")), "prints")
    classes = keep(part.groupBy(*f).agg(F.min("rep").alias("rep")).where("rep IS NOT NULL"), "classes")
    found = links_of(classes, classes.count())
    name = F.xxhash64(*f)
    several = prints.where("doc IS NOT NULL").groupBy("doc").agg(F.min(name).alias("least"), F.max(name).alias("most")).where("least <> most")
    several = keep(several.select("doc"), "several")
    if several.limit(1).count():
        own = prints.join(several, "doc").distinct().join(classes, f).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
        # classes may have one smallest id in common only if that id has several fingerprints, which connects them
        found = found.unionByName(own)
    found = keep(found.distinct(), "links")
    joined = components(found)
    drop_kept(found)
    drop_kept(several)
    whole = classes.join(joined, classes.rep == joined.node, "left").select(*f, F.coalesce("component", "rep").alias("component"))
    back = part.select(*f, "salt").join(whole, f)
    return salted.join(back, [*f, "salt"], "left").select("doc", *f, F.when(F.col("doc").isNotNull(), F.col("component")).alias("component"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """Rows ``(doc, fingerprint, component)``, one for each input row: 64-bit SimHash of shingles of ``words`` words, 16 hex
    digits, and the smallest document id reachable over pairs of fingerprints that differ in at most ``radius`` bits.

    Exact: every such pair meets in a vantage shard. Texts without a word have fingerprint zero and are linked like others.
    Repeated rows keep their place; a null id gets a null component and links nothing. Rows that share an id are one document:
    what its fingerprints reach is one component. Other columns are not read.
    """
    prints = keep(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "fingerprints")

    def found(classes: DataFrame, n: int) -> DataFrame:
        return links(deal_shards(vantage_shards(classes, radius, n), 1), radius, 1).select("a", "b")

    out = _components_of(prints, found, 1)
    return out.select("doc", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component")


def _shingle_set(text: str | None, words: int, seed: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words, seed), np.uint64))


def _digest(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles; equal for equal sets."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _parities(sets: list[np.ndarray], words: int) -> np.ndarray:
    """For each set, ``words`` words of bits: whether an odd number of its shingles falls to each of 64 ``words`` places. Two
    sets differ in at most as many places as in shingles."""
    places = 64 * words
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = (np.concatenate(sets) >> np.uint64(7)).astype(np.int64) & (places - 1) if len(row) else np.zeros(0, np.int64)
    odd = np.bincount(row * places + at, minlength=len(sets) * places).reshape(len(sets), places) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def text_classes(texts: DataFrame, words: int, seed: int, parts: int) -> DataFrame:
    """Rows ``(doc, text_hash, node, n, f0 ..., p0 ...)`` for rows (doc, text, text_hash): the name of the text's set of
    shingles, its size, the set's fingerprints and its parities."""
    def run(batches):
        only("simhash", dict)
        for batch in batches:
            rows, at = batch.column("text").to_pylist(), 0
            while at < len(rows):
                first, sets, size = at, [], 0
                while at < len(rows) and size < 100_000 and len(sets) < 1000:
                    sets.append(_shingle_set(rows[at], words, seed))
                    size += len(sets[-1])
                    at += 1
                h, n, odd = np.concatenate(sets), np.array([len(s) for s in sets], np.int64), _parities(sets, PARITIES)
                cols = [pa.array(n), *(pa.array(majority_bits(_mix(h, k), n).view(np.int64)) for k in range(parts)), *(pa.array(odd[:, k].copy()) for k in range(PARITIES))]
                own = [batch.column(c).slice(first, at - first) for c in ("doc", "text_hash")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([_digest(s) for s in sets], pa.int64()), *cols], names)

    names = ["doc", "text_hash", "node", *_sketch(parts)]
    return texts.select("doc", "text", "text_hash").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))


def _sketch(parts: int) -> list[str]:
    return ["n", *(f"f{k}" for k in range(parts)), *(f"p{k}" for k in range(PARITIES))]


#: Standard deviations beyond the expected distance of SimHashes from which a pair is sure not to have the similarity, and
#: shingles of two sets together from which their bits follow the normal law that this takes.
SURE, MANY_SHINGLES = 8.0, 400


def close_pairs(pairs: DataFrame, classes: DataFrame, similarity: float, parts: int) -> DataFrame:
    """The pairs (a, b) of nodes that may have the similarity: sets that do differ in at most a ninth (at 0.8) of their
    shingles, and so in as many parities; and SimHashes of many shingles come SURE deviations beyond the distance expected at
    the similarity with a probability under 1e-14."""
    sketch = _sketch(parts)
    one, two = (classes.select(F.col("node").alias(side), *(F.col(c).alias(side + c) for c in sketch)) for side in ("a", "b"))
    apart = lambda kind, k: sum((F.bit_count(F.col(f"a{kind}{i}").bitwiseXOR(F.col(f"b{kind}{i}"))) for i in range(k)), F.lit(0))
    both = F.col("an") + F.col("bn")
    met = pairs.join(one, "a").join(two, "b").where(apart("p", PARITIES) <= (1 - similarity) / (1 + similarity) * both + 1e-6)
    return met.where((both < MANY_SHINGLES) | (apart("f", parts) <= _far_bits(similarity, parts))).select("a", "b")


def _far_bits(similarity: float, parts: int) -> int:
    bits, share = 64 * parts, _expected_share(similarity)
    return math.ceil(bits * share + SURE * math.sqrt(bits * share * (1 - share)))


def _expected_share(similarity: float) -> float:
    """The share of SimHash bits in which sets of one size and this similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


# ---- pairs of similar sets: prefixes of shingles

def frequent_shingles(texts: DataFrame, n: int, words: int, seed: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(shingles ascending, their number in a sample, texts that one of the sample stands for): shingles that are frequent.

    They only set the order in which sets list their shingles, so what the sample misses costs time and never a pair."""
    size = min(max(SAMPLE_TEXTS, n // 20), 10 * SAMPLE_TEXTS)
    stride = max(1, n // size)

    def run(batches):
        only("simhash", dict)
        for batch in batches:
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(t, words, seed).view(np.int64))], ["key"])

    sample = texts.where(F.pmod(F.xxhash64("doc", "text_hash"), F.lit(stride)) == 0).select("text").mapInArrow(tidy(run), "key long")
    most = sample.groupBy("key").count().where("count > 2").orderBy(F.desc("count"), "key").limit(MOST_LISTED).collect()
    keys, counts = np.array([r[0] for r in most], np.int64).view(np.uint64), np.array([r[1] for r in most], np.int64)
    order = np.argsort(keys)
    return keys[order], counts[order], stride


def prefix_rows(texts: DataFrame, words: int, seed: int, similarity: float, listed: tuple[np.ndarray, np.ndarray, int]) -> DataFrame:
    """Rows ``(key, x, y, node, n, at, odd)``: the first shingles of each set of n, rarest first, at their places ``at``,
    with a word of parities of the set.

    Two sets with a Jaccard similarity of ``similarity`` or more have at least that share of either's shingles in common, so
    in one order of all shingles the first n - ceil(similarity n) + 1 of both share one. Shingles of more than LARGE_SHARD
    sets, by the sample, are dealt to pairs of chunks (x, y)."""
    keys, counts, stride = listed
    chunks = np.maximum(1, -(-counts * stride // LARGE_SHARD))

    def run(batches):
        only("simhash", dict)
        seen: set[int] = set()  # equal sets of one task are listed once
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                own = _shingle_set(text, words, seed)
                n, node = len(own), _digest(own)
                if not n or node in seen:
                    continue
                seen.add(node)
                rank, split = np.zeros(n, np.int64), np.ones(n, np.int64)
                if len(keys):
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    hit = keys[place] == own
                    rank[hit], split[hit] = counts[place[hit]], chunks[place[hit]]
                first = np.argsort(rank, kind="stable")[: n - math.ceil(similarity * n - 1e-9) + 1]
                at, rank, split = np.arange(len(first)), rank[first], split[first]
                row = np.repeat(at, split)
                mine, other = (node % split)[row], np.arange(len(row)) - np.repeat(np.cumsum(split) - split, split)
                odd = np.full(len(row), _parities([own], 1)[0, 0])
                out.append((own[first][row].view(np.int64), np.minimum(mine, other), np.maximum(mine, other), np.full(len(row), node), np.full(len(row), n), at[row], odd))
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                kinds = (np.int64, np.int32, np.int32, np.int64, np.int32, np.int32, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds)], ["key", "x", "y", "node", "n", "at", "odd"])

    return texts.select("text").mapInArrow(tidy(run), "key long, x int, y int, node long, n int, at int, odd long")


#: What ``prefix_pairs`` compares: all sets of small buckets; the sets of a bucket with their leaders; all of them.
SMALL, LEADERS, EVERY = range(3)


def _run_pairs(run, far, n, at, odd, similarity: float, which: int, sketch: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of each run of equal keys whose sets' components differ, and whose sizes, parities and places leave the
    similarity possible if this is the first shingle that both list. ``sketch`` has more parities, and SimHashes, as
    ``close_pairs`` judges them."""
    odd = odd.view(np.uint64)
    words = {kind: [v.view(np.uint64) for k, v in sketch.items() if k[0] == kind] for kind in "pf"}

    def possible(i, j):
        both = n[i] + n[j]
        fits = np.minimum(n[i] - at[i], n[j] - at[j]) >= similarity / (1 + similarity) * both - 1e-6
        return fits & (far[i] != far[j]) & (np.bitwise_count(odd[i] ^ odd[j]) <= (1 - similarity) / (1 + similarity) * both + 1e-6)

    def close(i, j):
        if sketch:
            for kind in "pf":
                apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in words[kind])
                both = n[i] + n[j]
                ok = apart <= (1 - similarity) / (1 + similarity) * both + 1e-6 if kind == "p" else (both < MANY_SHINGLES) | (apart <= _far_bits(similarity, len(words["f"])))
                i, j = i[ok], j[ok]
        return i, j

    sizes = np.bincount(run)
    start = np.cumsum(sizes) - sizes
    small, shift = np.flatnonzero((sizes[run] > 1) & (sizes[run] <= SMALL_BUCKET)), 1
    while len(small) and which != LEADERS:
        small = small[small + shift < len(run)]
        small = small[run[small] == run[small + shift]]
        ok = small[possible(small, small + shift)]
        yield close(ok, ok + shift)
        shift += 1
    for r in np.flatnonzero(sizes > SMALL_BUCKET) if which != SMALL else ():
        rows = np.arange(start[r], start[r] + sizes[r])
        if (far[rows] == far[rows[0]]).all():
            continue
        rows = rows[np.argsort(n[rows], kind="stable")]
        if which == LEADERS:
            place = np.arange(len(rows)) // LED
            for step in (-1, 0, 1):  # the leaders of a row's own and of the neighbouring stretches of sizes
                lead = rows[np.clip((place + step) * LED + LED // 2, 0, len(rows) - 1)]
                ok = possible(rows, lead)
                yield close(rows[ok], lead[ok])
            continue
        lo = 0
        while lo < len(rows):
            hi = min(len(rows), lo + max(1, COMPARED // (len(rows) - lo)))
            end = np.searchsorted(n[rows], n[rows[hi - 1]] / similarity + 1e-6, "right")
            i, j = rows[lo:hi, None], rows[None, lo:end]
            a, b = np.nonzero(possible(i, j) & (np.arange(lo, hi)[:, None] < np.arange(lo, end)))
            yield close(rows[lo + a], rows[lo + b])
            lo = hi


_PAIR_OR_ROW = [("key", np.int64), ("x", np.int32), ("y", np.int32), ("node", np.int64), ("n", np.int32), ("at", np.int32), ("odd", np.int64), ("b", np.int64), ("row", bool)]


def prefix_pairs(rows: DataFrame, similarity: float, which: int) -> DataFrame:
    """Pairs of nodes that share a row's key and may have the similarity: rows ``(node, b, row)`` with ``row`` false; nodes of
    one ``far``, where rows have it, are no pair. SMALL also hands on the rows of larger buckets, with ``row`` true."""
    key = ["key", "x", "y"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "node")
    own = "far" if "far" in rows.columns else "node"
    more = [c for c in rows.columns if c[1:].isdigit()]

    def run(batches):
        only("simhash", dict)
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 20_000:
                table = pa.Table.from_batches(held).combine_chunks()
                codes = [table[k].to_numpy() for k in key]
                end = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in codes])))
                if end:
                    yield from found(table.slice(0, end))
                held = table.slice(end).to_batches()
                size = table.num_rows - end
        if held:
            yield from found(pa.Table.from_batches(held))

    def found(table):
        c = {k: table[k].to_numpy() for k in (*key, "node", "n", "at", "odd", own, *more)}
        number = np.concatenate([[0], np.cumsum(np.logical_or.reduce([np.diff(c[k]) != 0 for k in key]))])
        new = np.ones(len(number), bool)  # equal sets of several tasks
        new[1:] = (np.diff(number) != 0) | (c["node"][1:] != c["node"][:-1])
        c, number = {k: v[new] for k, v in c.items()}, number[new]
        held, size, node = [], 0, c["node"]
        for i, j in _run_pairs(number, c[own], c["n"], c["at"], c["odd"], similarity, which, {k: c[k] for k in more}):
            held.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], axis=1))
            size += len(i)
            if size > COMPARED:
                yield pairs(held)
                held, size = [], 0
        if size:
            yield pairs(held)
        if which == SMALL and (large := np.bincount(number)[number] > SMALL_BUCKET).any():
            yield batch_of({**{k: v[large] for k, v in c.items()}, "row": np.ones(int(large.sum()), bool)})

    def pairs(held):
        both = np.unique(np.concatenate(held), axis=0)
        return batch_of({"node": both[:, 0], "b": both[:, 1]})

    def batch_of(c):
        n = len(c["node"])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[k], t) if k in c else np.zeros(n, t)) for k, t in _PAIR_OR_ROW], [k for k, _ in _PAIR_OR_ROW])

    return dealt.mapInArrow(tidy(run), "key long, x int, y int, node long, n int, at int, odd long, b long, `row` boolean")


def shingle_sets(texts: DataFrame, words: int, seed: int) -> DataFrame:
    """Rows ``(node, shingles)`` of rows (text): each set."""
    def run(batches):
        only("simhash", dict)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                sets = [_shingle_set(t, words, seed) for t in batch.column("text").slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.select("text").mapInArrow(tidy(run), "node long, shingles array<long>")


def similar_pairs(texts: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, seed: int, similarity: float, parts: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets of shingles have a Jaccard similarity of ``similarity`` or more. Sketches first part
    most pairs; only texts that stand in a pair that is left are read again, and a set moves once for each of its pairs.

    Texts meet the ids by a merge join at every size: the ids grow with the input, so they are not broadcast."""
    close = keep(close_pairs(pairs, classes, similarity, parts), "close")
    if not close.limit(1).count():
        return close
    nodes = keep(close.selectExpr("explode(array(a, b)) AS node").distinct(), "nodes")
    ids = keep(classes.join(nodes, "node").select(F.col("rep").alias("doc")).distinct(), "ids")
    sets = shingle_sets(texts.join(ids.hint("merge"), "doc", "left_semi"), words, seed).join(nodes, "node", "left_semi")
    sets = keep(sets.dropDuplicates(["node"]), "shingles")
    both = close.join(sets.selectExpr("node AS a", "shingles AS s"), "a").join(sets.selectExpr("node AS b", "shingles AS t"), "b")
    common = both.select("a", "b", F.size(F.array_intersect("s", "t")).alias("i"), (F.size("s") + F.size("t")).alias("n"))
    sure = keep(common.where(F.col("i") >= similarity * (F.col("n") - F.col("i"))).select("a", "b"), "similar")
    for table in (sets, close, ids, nodes):
        drop_kept(table)
    release(texts.sparkSession)
    return sure


def text_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, seed: int = 42, similarity: float = 0.8, parts: int = 8, recall: float = 0.95, inner: float = 2.5) -> DataFrame:
    """``simhash_groups`` with ``text_hash``, Spark's ``xxhash64`` of the row's text, and ``root``, the group's own name: rows
    that share an id may stand in several groups."""
    share, bits = _expected_share(similarity), 64 * parts
    radius = max(0, math.floor(bits * share - inner * math.sqrt(bits * share * (1 - share))))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    f = [f"f{k}" for k in range(parts)]
    prints = keep(text_classes(texts, words, seed, parts), "fingerprints")
    salted = prints.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    sketch = [F.min(c).alias(c) for c in _sketch(parts)]
    part = keep(salted.groupBy("node", "salt").agg(F.min("doc").alias("rep"), *sketch), "prints")
    classes = keep(part.groupBy("node").agg(F.min("rep").alias("rep"), *sketch).where("rep IS NOT NULL"), "classes")
    n = classes.count()

    # near copies by their fingerprints, so that large groups of them are not compared pair by pair
    shards = keep(sampled_shards(classes.select(F.col("node").alias("rep"), *f), parts, radius, n, recall), "shards")
    near = keep(links(deal_shards(shards, parts), radius, parts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    drop_kept(shards)
    own = texts.where("doc IS NOT NULL")
    known = similar_pairs(own, classes, near, words, seed, similarity, parts)
    far = keep(components(known).withColumnRenamed("component", "far"), "far")

    # all other pairs, by their rarest shingles: small buckets and the leaders of large ones first, so that dense groups join
    def told(rows: DataFrame) -> DataFrame:
        known_of = classes.select("node", *_sketch(parts)[1:]).join(far, "node", "left").withColumn("far", F.coalesce("far", "node"))
        return rows.drop("b", "row").join(known_of, "node")

    def between(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("NOT `row`").select(F.col("node").alias("a"), "b").distinct()
        met = pairs.join(far.selectExpr("node AS a", "far AS fa"), "a", "left").join(far.selectExpr("node AS b", "far AS fb"), "b", "left")
        return met.where("coalesce(fa, a) <> coalesce(fb, b)").select("a", "b")

    listed = frequent_shingles(own, n, words, seed)
    first = keep(prefix_pairs(prefix_rows(own, words, seed, similarity, listed), similarity, SMALL), "small-buckets")
    release(docs.sparkSession)
    large = first.where("`row`")
    some = keep(between(first.unionByName(prefix_pairs(told(large), similarity, LEADERS))), "apart")
    known = keep(known.union(similar_pairs(own, classes, some, words, seed, similarity, parts)), "known")
    far = keep(components(known).withColumnRenamed("component", "far"), "far")
    rest = keep(between(prefix_pairs(told(large), similarity, EVERY)), "apart")
    joined = components(known.union(similar_pairs(own, classes, rest, words, seed, similarity, parts)))
    for table in (first, some, rest):
        drop_kept(table)

    whole = classes.select("node", "rep").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    whole = whole.join(whole.groupBy("root").agg(F.min("rep").alias("component")), "root").select("node", "root", "component")
    back = part.select("node", "salt").join(whole, "node")
    out = salted.join(back, ["node", "salt"], "left")
    return out.select("doc", "text_hash", "root", F.when(F.col("doc").isNotNull(), F.col("component")).alias("component"))


def simhash_groups(docs: DataFrame, **options) -> DataFrame:
    """Rows ``(doc, component)``: groups of documents linked by a Jaccard similarity of ``similarity`` or more between their
    sets of shingles of ``words`` words; ``component`` is the smallest id of the group.

    Exact, up to equal 64-bit hashes of shingles and sets. Near copies are found first by ``64 * parts``-bit SimHashes: a
    similarity s is a cosine of 2s / (1 + s) between sets of one size, so the expected distance is the angle's share of all
    bits, and pairs ``inner`` standard deviations below it that share a shard (``recall`` is the chance at that distance)
    are compared. Both only save work. Then every pair of sets from different groups whose rarest shingles have one in
    common is compared, which leaves out no pair of that similarity. Groups of near copies cost no more than their links;
    a dense group whose pairs all lie just below the similarity is compared pair by pair. Null texts and texts without a
    word are equal; repeated rows stay; a null id gets a null component and links nothing. Rows that share an id and differ
    in text are apart.
    """
    return text_groups(docs, **options).select("doc", "component")
