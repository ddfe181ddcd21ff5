"""Media columns: local image descriptors find cropped and edited copies.

A column of binary images (grey PGM) is decoded in batches. Corners on every level of a pyramid are oriented by their patch's
centroid, and pairs of smoothed pixels of the turned patch are compared: 256 binary tests, of which nearby ones have a small
Hamming distance. Tables of sampled tests bring descriptors together (equi-joins on short keys), and images that meet in a
table are compared corner by corner: they are linked if enough corners agree on one change of scale, turn and shift. What the
tables miss is found exactly: chunks of images are held against each other, with bounds that part only what cannot be linked.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .shared import components, drop_kept, drop_path, keep, new_path, release, tidy

#: Levels of the pyramid; each is smaller than the last by the root of two.
LEVELS = 3
_RADIUS = 9
#: Grey levels by which a pixel must be brighter for a test to hold, so that flat areas give no chance bits.
_STEP = 2.0
#: Corners whose tests are taken at once.
_BLOCK = 2_000
#: Hash tables, tests that a key has beyond the logarithm of the number of descriptors, and buckets that a pair must share.
TABLES, MORE_BITS, LEAST_HITS = 5, 6, 3
#: Corners of a bucket up to which all are compared; larger ones are parted by more tests, and equal corners that these do not
#: part are compared with a leader of each stretch of LED first.
SMALL_BUCKET, LED = 4, 32
#: Rows of a key beyond which more tests deal it to several tasks, and one of how many images shows which those are; pairs that
#: are compared in one step.
LARGE_KEY, SAMPLED, COMPARED = 200_000, 64, 250_000
#: Corners of a chunk of the exact pass, and chunk pairs of one of its tasks; sampled corners that tell rare from common ones;
#: made-up corners to which distances are known (``_axes``), and directions that they are made of; corners of a run of the second
#: chunk, which is compared at once, and corner pairs compared in one step.
CHUNK, TILES, KNOWN, AXES, MAIN, LEAF, STEP = 40_000, 4, 2_048, 24, 6, 128, 1 << 17
#: Pairs of near corners that a task holds at once (fewer than 2 to the 23rd), beyond which a pair of chunks is parted; listed
#: corners that must agree before two images are compared in full.
HELD, SURE = 6_000_000, 3


class MediaError(ValueError):
    """The bytes are not an image of a known format."""


def decode_pgm(data: bytes) -> np.ndarray:
    """The grey image of binary PGM bytes (P5, 8 bits)."""
    if not data or data[:2] != b"P5":
        raise MediaError("not a binary PGM")
    fields, at = [], 2
    while len(fields) < 3:
        while at < len(data) and data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.find(b"\n", at)
            if at < 0:
                raise MediaError("the header ends in a comment")
            continue
        start = at
        while at < min(len(data), start + 10) and data[at : at + 1].isdigit():
            at += 1
        if start == at or at == start + 10:
            raise MediaError("bad header")
        fields.append(int(data[start:at]))
    w, h, most = fields
    if not 0 < most < 256 or w * h < 1 or len(data) < at + 1 + w * h:
        raise MediaError("the image is cut short or not of 8 bits")
    return np.frombuffer(data, np.uint8, w * h, at + 1).reshape(h, w)


def encode_pgm(image: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def _smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    """One image or several of one size, smoothed along the last two axes; what lies outside is as the border is."""
    n = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-n, n + 1) / sigma) ** 2)
    kernel = (kernel / kernel.sum()).astype(np.float32)
    for axis in (-2, -1):
        size = list(a.shape)
        size[axis] += 2 * n
        padded, out, term = np.empty(size, a.dtype), np.zeros_like(a), np.empty_like(a)
        along = (lambda at: (..., at, slice(None))) if axis == -2 else (lambda at: (..., at))
        padded[along(slice(n, -n))] = a
        padded[along(slice(0, n))], padded[along(slice(-n, None))] = a[along(slice(0, 1))], a[along(slice(-1, None))]
        for i in range(2 * n + 1):
            out += np.multiply(padded[along(slice(i, i + a.shape[axis]))], kernel[i], out=term)
        a = out
    return a


def resize(image: np.ndarray, factor: float) -> np.ndarray:
    """A smaller image: smoothed, then sampled between its pixels."""
    a = _smooth(np.asarray(image, np.float32), 0.5 / factor)
    at = [np.clip((np.arange(max(1, int(n * factor))) + 0.5) / factor - 0.5, 0, n - 1) for n in a.shape]
    low = [np.minimum(x.astype(int), max(0, n - 2)) for x, n in zip(at, a.shape)]
    part = [(x - l).astype(np.float32) for x, l in zip(at, low)]
    high = [np.minimum(l + 1, n - 1) for l, n in zip(low, a.shape)]
    rows = a[low[0]] * (1 - part[0])[:, None] + a[high[0]] * part[0][:, None]
    return rows[:, low[1]] * (1 - part[1]) + rows[:, high[1]] * part[1]


def _tests() -> np.ndarray:
    """256 pairs of places in a disc, drawn once from a fixed seed."""
    rng = np.random.default_rng(5)
    points = rng.normal(0, _RADIUS / 2.2, (4000, 2))
    points = points[np.hypot(*points.T) <= _RADIUS - 1]
    return points[:512].reshape(256, 2, 2)


_PAIRS = _tests()
_DISC = np.array([(x, y) for y in range(-_RADIUS, _RADIUS + 1) for x in range(-_RADIUS, _RADIUS + 1) if x * x + y * y <= _RADIUS * _RADIUS])
#: A corner: its place in the whole image in quarters of a pixel, its angle in 256 parts, its level and its tests.
CORNER = np.dtype([("x", "<u4"), ("y", "<u4"), ("angle", "u1"), ("level", "u1"), ("tests", "<u8", 4)])


def _largest_near(a: np.ndarray, reach: int) -> np.ndarray:
    """The greatest value within ``reach`` rows and columns, as a running maximum along both axes."""
    for axis in (0, 1):
        out = a.copy()
        for k in range(1, reach + 1):
            ahead, behind = (np.s_[k:], np.s_[:-k]) if axis == 0 else (np.s_[:, k:], np.s_[:, :-k])
            np.maximum(out[behind], a[ahead], out=out[behind])
            np.maximum(out[ahead], a[behind], out=out[ahead])
        a = out
    return a


def describe(image: np.ndarray) -> np.ndarray:
    """The corners (CORNER) of all levels of the pyramid.

    A corner is a maximum, within 5 x 5 pixels, of the smaller eigenvalue of the smoothed gradient's second moments above a
    share of the level's contrast; there is no limit on their number. Memory is a few copies of the image.
    """
    found, margin = [], _RADIUS + 2
    image = image.astype(np.float32)
    for level in range(LEVELS):
        factor = 2.0 ** (-level / 2)
        here = image if not level else resize(image, factor)
        if min(here.shape) <= 2 * margin + 1:
            break
        a = _smooth(here, 1.0)
        gy, gx = np.gradient(a)
        xx, yy, xy = _smooth(np.stack([gx * gx, gy * gy, gx * gy]), 1.5)
        low = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        inner = (slice(margin, -margin), slice(margin, -margin))
        ys, xs = np.nonzero((low[inner] >= _largest_near(low, 2)[inner]) & (low[inner] > max(1.0, 0.02 * float(a.var()))))
        del gx, gy, xx, yy, xy, low
        a = _smooth(a, 1.5)
        for at in range(0, len(xs), _BLOCK):
            found.append(_described_corners(a, xs[at : at + _BLOCK] + margin, ys[at : at + _BLOCK] + margin, level, factor))
    return np.concatenate(found) if found else np.zeros(0, CORNER)


def _described_corners(a: np.ndarray, xs: np.ndarray, ys: np.ndarray, level: int, factor: float) -> np.ndarray:
    patch = a[ys[:, None] + _DISC[:, 1], xs[:, None] + _DISC[:, 0]]
    patch = patch - patch.mean(axis=1, keepdims=True)
    angle = np.arctan2(patch @ _DISC[:, 1].astype(np.float32), patch @ _DISC[:, 0].astype(np.float32))
    c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    px, py = _PAIRS[None, :, :, 0], _PAIRS[None, :, :, 1]
    v = a[ys[:, None, None] + np.rint(s * px + c * py).astype(int), xs[:, None, None] + np.rint(c * px - s * py).astype(int)]
    out = np.zeros(len(xs), CORNER)
    out["x"], out["y"] = (np.rint(4 * ((v_ + 0.5) / factor - 0.5)).clip(0).astype(np.uint32) for v_ in (xs, ys))
    out["angle"], out["level"] = np.rint(angle / (2 * np.pi) * 256).astype(np.int64) % 256, level
    out["tests"] = np.packbits(v[:, :, 0] + _STEP < v[:, :, 1], axis=1).view(np.uint64)
    return out


_COS, _SIN = (f(np.arange(256) * (2 * np.pi / 256)) for f in (np.cos, np.sin))


def _centre(corners: np.ndarray) -> list[float]:
    return [(corners[c].min() + float(corners[c].max())) / 2 for c in "xy"]


def _wide(corners: np.ndarray, cell: float) -> float:
    """The width of a cell of shifts: angles are uncertain by some degrees, which moves far corners, so cells follow the
    corners' extent."""
    return max(4 * cell, 0.12 * max(float(np.ptp(corners[c])) for c in "xy"))


def _order(corners: np.ndarray) -> tuple[int, int]:
    """Which of two images is turned onto the other: that of fewer corners, and of as many, either, but always the same."""
    return len(corners), xxhash.xxh3_64_intdigest(corners.tobytes())


def agreeing(one: np.ndarray, two: np.ndarray, most_bits: int, cell: float) -> int:
    """The most corners that agree: pairs of few different tests that vote for one change of scale and turn, and one shift
    within a cell; corners of either image that are in several such pairs count once. The order of the images does not matter."""
    if not len(one) or not len(two):
        return 0
    if _order(one) > _order(two):
        one, two = two, one
    pairs = [np.zeros((0, 2), np.int64)]
    step = max(1, COMPARED // len(two))
    for at in range(0, len(one), step):
        apart = np.zeros((len(one[at : at + step]), len(two)), np.int64)
        for k in range(4):
            apart += np.bitwise_count(one["tests"][at : at + step, None, k] ^ two["tests"][None, :, k])
        pairs.append(np.argwhere(apart <= most_bits) + (at, 0))
    i, j = np.concatenate(pairs).T
    if not len(i):
        return 0
    a, b = one[i], two[j]
    levels = a["level"].astype(np.int64) - b["level"]
    ratio = 2.0 ** (-levels / 2)
    turn = (b["angle"].astype(np.int64) - a["angle"]) % 256
    centre = _centre(one)
    x, y = (a["x"] - centre[0]) * ratio, (a["y"] - centre[1]) * ratio
    dx, dy = b["x"] - (_COS[turn] * x - _SIN[turn] * y), b["y"] - (_SIN[turn] * x + _COS[turn] * y)
    wide = _wide(two, cell)
    best = 0
    for grid in range(2):  # in two grids, half a cell apart, so that a border does not part votes that agree
        number = np.zeros(len(i), np.int64)
        for part in (levels, (turn + 10 * grid) // 20, np.floor(dx / wide + grid / 2), np.floor(dy / wide + grid / 2)):
            part = (part - part.min()).astype(np.int64)
            number = np.unique(number * (int(part.max()) + 1) + part, return_inverse=True)[1]
        width = max(len(one), len(two))
        counts = [np.bincount(np.unique(number * width + k) // width) for k in (i, j)]
        best = max(best, int(np.minimum(*counts).max()))
    return best


# ---- tables

def _described(batches):
    seen: set[int] = set()  # equal images of one task are described once
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part, rows = batch.slice(at, 64), []
            for own, data in zip(part.column("class").to_pylist(), part.column("image").to_pylist()):
                if own in seen:
                    continue
                seen.add(own)
                try:
                    corners = describe(decode_pgm(data or b""))
                except MediaError:
                    continue
                if len(corners):
                    rows.append((own, len(corners), corners.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["class", "n", "corners"])


def _keys(bits: int, tables: int):
    """Rows (key, class, word, whole): for every corner and table the sampled tests, the first 64 tests, which no table samples,
    and a hash of all tests."""
    rng = np.random.default_rng(23)
    places = [64 + rng.permutation(192)[:bits] for _ in range(tables)]
    power = 1 << np.arange(bits, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                own = [np.frombuffer(x, CORNER) for x in part.column("corners").to_pylist()]
                image = np.repeat(part.column("class").to_numpy(), [len(x) for x in own])
                tests = np.ascontiguousarray(np.concatenate(own)["tests"])
                every, word = np.unpackbits(tests.view(np.uint8).reshape(-1, 32), axis=1), tests[:, 0].view(np.int64)
                whole = np.array([xxhash.xxh3_64_intdigest(t) for t in tests.view("V32").ravel().tolist()], np.uint64).view(np.int64)
                for t, p in enumerate(places):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in (every[:, p] @ power + (t << 48), image, word, whole)], ["key", "class", "word", "whole"])

    return run


def _parted(number: np.ndarray, word: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bucket numbers after large buckets were parted: by two more tests at a time, as long as they are large, and at last by
    all tests. Corners that differ in few tests mostly stay together, and what is common to many images comes apart."""
    number = number.copy()
    for shift in (*range(0, 64, 2), None):
        large = np.flatnonzero(np.bincount(number)[number] > SMALL_BUCKET)
        if not len(large):
            break
        more = (word[large] >> shift) & 3 if shift is not None else whole[large]
        _, part = np.unique(np.stack([number[large], more]), axis=1, return_inverse=True)
        number[large] = part.ravel() + number.max() + 1
    return number


def _runs(key_columns: list[str], found):
    """A task's function that hands ``found`` whole runs of equal keys, of rows sorted by them."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 20_000:
                table = pa.Table.from_batches(held).combine_chunks()
                codes = [table[k].to_numpy() for k in key_columns]
                end = int(np.argmax(np.logical_and.reduce([c == c[-1] for c in codes])))
                if end:
                    yield from found(table.slice(0, end))
                held, size = table.slice(end).to_batches(), table.num_rows - end
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


_BUCKET = ["key", "u"]
_PAIR_OR_ROW_NAMES = ["class", "whole", "b", "hits", "spots"]
_PAIR_OR_ROW = "class long, whole long, b long, hits int, spots long"


def _bucket_pairs(check_bits: int):
    """Pairs of images (class, b), the buckets that they share (``hits``), and the corners of the first that do so as bits of
    ``spots``: corners whose ``word`` differs in few bits. Large buckets are parted first; of those that stay large, which are
    equal corners of many images, the rows are handed on (``hits`` 0)."""
    def found(table):
        key, u, own, word, whole = (table[c].to_numpy() for c in (*_BUCKET, "class", "word", "whole"))
        number = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(u) != 0))])
        number = _parted(number, word, whole)
        order = np.argsort(number, kind="stable")
        own, word, whole, number = (c[order] for c in (own, word, whole, number))
        sizes = np.bincount(number)[number]
        pairs, small, shift = [], np.flatnonzero((sizes > 1) & (sizes <= SMALL_BUCKET)), 1
        while len(small):
            small = small[small + shift < len(number)]
            small = small[number[small] == number[small + shift]]
            i, j = small, small + shift
            ok = (own[i] != own[j]) & (np.bitwise_count((word[i] ^ word[j]).view(np.uint64)) <= check_bits)
            i, j = i[ok], j[ok]
            spot = np.left_shift(np.int64(1), (whole[np.where(own[i] < own[j], i, j)].view(np.uint64) % np.uint64(63)).astype(np.int64))
            pairs.append(np.stack([np.minimum(own[i], own[j]), np.maximum(own[i], own[j]), spot], axis=1))
            shift += 1
        every = np.concatenate(pairs) if pairs else np.zeros((0, 3), np.int64)
        if len(every):
            every = every[np.lexsort((every[:, 1], every[:, 0]))]
            first = np.flatnonzero(np.concatenate([[True], (every[1:, :2] != every[:-1, :2]).any(axis=1)]))
            times, spots = np.diff(np.append(first, len(every))), np.bitwise_or.reduceat(every[:, 2], first)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (every[first, 0], np.zeros(len(first), np.int64), every[first, 1], times.astype(np.int32), spots)], _PAIR_OR_ROW_NAMES)
        large = np.flatnonzero(sizes > SMALL_BUCKET)
        if len(large):
            none = np.zeros(len(large), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[large], whole[large], none, none.astype(np.int32), none)], _PAIR_OR_ROW_NAMES)

    return _runs(_BUCKET, found)


def _equal_pairs(batches):
    """Pairs (a, b) of images of different ``far`` that list the same corner, one of them a leader of a stretch of LED."""
    def found(table):
        whole, own, far = (table[c].to_numpy() for c in ("whole", "class", "far"))
        change = np.flatnonzero(np.diff(whole)) + 1
        for a, b in zip([0, *change], [*change, len(whole)]):
            rows = np.arange(a, b)
            if (far[rows] == far[a]).all():
                continue
            place = np.arange(len(rows)) // LED
            for step in (-1, 0, 1):
                yield from pairs(rows, rows[np.clip((place + step) * LED + LED // 2, 0, len(rows) - 1)], own, far)

    def pairs(i, j, own, far):
        ok = far[i] != far[j]
        both = np.unique(np.stack([np.minimum(own[i[ok]], own[j[ok]]), np.maximum(own[i[ok]], own[j[ok]])], axis=1), axis=0)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in (0, 1)], ["a", "b"])

    return _runs(["whole"], found)(batches)


def votes_needed(corners: int, least_votes: int, least_share: float) -> int:
    """Corners that must agree where the poorer image has so many: one less than ``least_votes`` do if it has few."""
    return max(least_votes - 1, min(least_votes, math.ceil(0.6 * corners)), math.ceil(least_share * corners))


def _verified(least_votes: int, least_share: float, most_bits: int, cell: float):
    def run(batches):
        for batch in batches:
            links = []
            for a, b, one, two in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "one", "two"))):
                one, two = np.frombuffer(one, CORNER), np.frombuffer(two, CORNER)
                if agreeing(one, two, most_bits, cell) >= votes_needed(min(len(one), len(two)), least_votes, least_share):
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], ["a", "b"])

    return run


# ---- what the tables miss

def _sampled_corners(share: float):
    def run(batches):
        for batch in batches:
            for own, data in zip(batch.column("class").to_pylist(), batch.column("corners").to_pylist()):
                tests = np.frombuffer(data, CORNER)["tests"]
                tests = tests[np.random.default_rng(abs(own)).random(len(tests)) < share]
                if len(tests):
                    yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(tests).tobytes()], pa.binary())], ["tests"])

    return run


def _likes(tests: np.ndarray, known: np.ndarray, most_bits: int) -> np.ndarray:
    """How many of the known corners are near each corner."""
    out, words = np.zeros(len(tests), np.int32), np.ascontiguousarray(tests.T)
    for at in range(0, len(tests), 8_000):
        here = words[:, at : at + 8_000]
        for point in known:
            out[at : at + 8_000] += _apart(here, point) <= most_bits
    return out


def _apart(words: np.ndarray, tests: np.ndarray) -> np.ndarray:
    """How many tests differ between many corners (four rows of words) and one, or as many others."""
    out = np.bitwise_count(words[0] ^ tests[0]).astype(np.int16)
    for k in range(1, 4):
        out += np.bitwise_count(words[k] ^ tests[k])
    return out


#: A chunk's arrays of images (class, group, place in the chunk, number of corners, ``_order``, ``votes_needed``, first corner,
#: centre, width of a cell) and of corners (CORNER, its image, how often the sample has its like, its place in the ``_walk``).
_OF_IMAGES, _OF_CORNERS = ("class", "far", "place", "size", "order", "need", "first", "cx", "cy", "wide"), ("corners", "image", "rare", "walk")


def _chunk_written(folder: str, known: np.ndarray, least_votes: int, least_share: float, most_bits: int, cell: float):
    """Writes the images of a chunk as a file named by its number."""
    def run(table):
        rows = sorted(zip(*(table[c].to_pylist() for c in ("n", "class", "far", "corners"))))
        rows = [(n, own, far, np.frombuffer(data, CORNER)) for n, own, far, data in rows]
        size = np.array([r[0] for r in rows])
        every = np.concatenate([r[3] for r in rows])
        rare = _likes(every["tests"], known, most_bits)
        walk = np.empty(len(every), np.int32)
        walk[_walk(_marks(every["tests"], _axes(known)))] = np.arange(len(every), dtype=np.int32)
        image, first = np.repeat(np.arange(len(rows), dtype=np.int32), size), np.cumsum(size) - size
        need = np.array([votes_needed(n, least_votes, least_share) for n in size.tolist()])
        centre = np.array([_centre(r[3]) for r in rows])
        out = io.BytesIO()
        np.savez(out, **{"class": np.array([r[1] for r in rows]), "far": np.array([r[2] for r in rows]), "place": np.arange(len(rows)), "size": size, "order": np.array([_order(r[3])[1] for r in rows], np.uint64), "need": need, "first": first, "cx": centre[:, 0], "cy": centre[:, 1], "wide": np.array([_wide(r[3], cell) for r in rows]),
                         "corners": every, "image": image, "rare": rare, "walk": walk})
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        number = table["chunk"][0].as_py()
        with fs.open_output_stream(f"{root}/{number}", compression=None) as stream:
            stream.write(out.getvalue())
        return pa.table({"chunk": pa.array([number], pa.int32())})

    return run


def _sure(least_votes: int) -> int:
    return max(1, min(SURE, least_votes - 1))


def _read_chunk(folder: str, number: int) -> dict[str, np.ndarray]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{number}", compression=None) as stream:
        return dict(np.load(io.BytesIO(stream.read())))


def _marked(chunk: dict, pivots: np.ndarray) -> dict:
    return chunk if "marks" in chunk else chunk | {"marks": _marks(chunk["corners"]["tests"], pivots)}


def _part(chunk: dict, a: int, b: int) -> dict:
    """Images a to b of a chunk."""
    first = np.append(chunk["first"], len(chunk["image"]))
    part = {k: chunk[k][a:b] for k in _OF_IMAGES} | {k: chunk[k][first[a] : first[b]] for k in (*_OF_CORNERS, "marks")}
    return part | {"first": part["first"] - first[a], "image": part["image"] - a}


def _axes(known: np.ndarray) -> np.ndarray:
    """Made-up corners from which distances of sampled corners differ most: signs of their tests' principal directions, and of
    sums of these. Near corners are about as far from any of them, so others are not compared."""
    bits = np.unpackbits(np.ascontiguousarray(known).view(np.uint8).reshape(-1, 32), axis=1).astype(np.float64)
    bits -= bits.mean(axis=0)
    value, vector = np.linalg.eigh(bits.T @ bits / len(bits))
    main = (vector * np.sqrt(value.clip(0)))[:, ::-1][:, :MAIN]
    sums = main @ np.random.default_rng(8).normal(size=(MAIN, AXES - MAIN))
    return np.packbits(np.ascontiguousarray(np.concatenate([main, sums], axis=1).T) > 0, axis=1).view(np.uint64)


def _marks(tests: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The distances of corners' tests to each pivot, filled up to whole words with zeros: a row a corner."""
    out = np.zeros((len(tests), -(-len(pivots) // 8) * 8), np.uint8)
    words = np.ascontiguousarray(tests.T)
    for k, point in enumerate(pivots):
        out[:, k] = _apart(words, point).clip(0, 255)
    return out


def _walk(marks: np.ndarray) -> np.ndarray:
    """Corners in an order in which those of like marks stand together: halves by the widest mark, again and again."""
    parts, out = [(np.arange(len(marks), dtype=np.int32), np.ascontiguousarray(marks.T))], []
    while parts:
        own, here = parts.pop()
        if len(own) <= LEAF // 2:
            out.append(own)
            continue
        order = np.argpartition(here[int(np.argmax(here.max(axis=1) - here.min(axis=1)))], len(own) // 2)
        for half in (order[len(own) // 2 :], order[: len(own) // 2]):
            parts.append((own[half], here.take(half, axis=1)))
    return np.concatenate(out)


def _all_of(flags: np.ndarray) -> np.ndarray:
    """Which rows of flags, whole words long, hold throughout."""
    words = flags.view(np.uint64)
    out = words[:, 0].copy()
    for k in range(1, words.shape[1]):
        out &= words[:, k]
    return out == 0x0101010101010101


def _near_corners(one: tuple, two: tuple, most_bits: int, held: int) -> tuple[np.ndarray, np.ndarray] | None:
    """All pairs (places) of corners of ``one`` and of ``two``, their tests and marks in the order of ``_walk``, with at most
    ``most_bits`` different tests; None if they are more than ``held``. Marks of near corners differ by no more than their tests,
    so runs of ``two`` are held against the runs of ``one``, and then the corners, whose marks are near all of its marks."""
    (tests, marks), (tests_two, marks_two) = one, two
    none = np.zeros(0, np.int32)
    found, size = [(none, none)], 0
    if not len(tests) or not len(tests_two):
        return found[0]
    a, b = (np.ascontiguousarray(x.T) for x in (tests, tests_two))
    starts, run = np.arange(0, len(tests), LEAF // 4), np.arange(LEAF // 4, dtype=np.int32)
    low, high = np.minimum.reduceat(marks, starts), np.maximum.reduceat(marks, starts)
    differ, more, some = np.empty(STEP, np.uint64), np.empty(STEP, np.uint64), np.empty(STEP, np.uint8)
    for s in range(0, len(tests_two), LEAF):
        e = min(s + LEAF, len(tests_two))
        here = marks_two[s:e]
        least, most = here.min(axis=0), here.max(axis=0)
        least, most = least - np.minimum(least, most_bits), most + np.minimum(255 - most, most_bits)
        runs = np.flatnonzero(_all_of((low <= most) & (high >= least)))
        if not len(runs):
            continue
        rows = (starts[runs].astype(np.int32)[:, None] + run).ravel()
        if rows[-1] >= len(tests):
            rows = rows[: np.searchsorted(rows, len(tests))]
        rows = rows[_all_of((marks.take(rows, axis=0) - least) <= most - least)]  # without a sign: what is below is far above
        for at in range(0, len(rows), STEP // LEAF):
            own = rows[at : at + STEP // LEAF]
            w, v, shape = a.take(own, axis=1), b[:, s:e], (e - s, len(own))
            x, y, d = (buffer[: shape[0] * shape[1]].reshape(shape) for buffer in (differ, more, some))
            np.bitwise_xor(w[0], v[0][:, None], out=x)
            for k in range(1, 4):
                x |= np.bitwise_xor(w[k], v[k][:, None], out=y)
            # places of tests that differ in any word are no more than tests that differ, and not many less where these are few
            c, r = np.divmod(np.flatnonzero(np.bitwise_count(x, out=d) <= most_bits).astype(np.int32), np.int32(len(own)))
            ok = _apart(w[:, r], v[:, c]) <= most_bits
            found.append((own[r[ok]], c[ok] + np.int32(s)))
            size += len(found[-1][0])
        if size > held:
            return None
    return tuple(np.concatenate(x) for x in zip(*found))


def _maybe_often(key: np.ndarray, times: int) -> np.ndarray:
    """Which keys may be there so many times: numbers that share a hash are taken as one."""
    if len(key) < times:
        return np.zeros(len(key), bool)
    short = key if int(key.max()) < 1 << 22 else (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)
    return (np.bincount(short) >= times)[short]


def _often(key: np.ndarray, times: int) -> np.ndarray:
    """Which keys (below 2 to the 40th, at most 2 to the 23rd of them) are there so many times."""
    out = np.zeros(len(key), bool)
    some = np.flatnonzero(_maybe_often(key, times))
    if len(some) >= times:
        order = np.sort(key[some] << 23 | np.arange(len(some)))
        same = order[times - 1 :] >> 23 == order[: len(order) - times + 1] >> 23
        for k in range(times):
            out[some[order[k : k + len(same)][same] & (1 << 23) - 1]] = True
    return out


def _listed(chunk: dict, other: dict, least: int, shift: int, sure: int) -> tuple[np.ndarray, np.ndarray]:
    """The corners of a chunk's images that can be ``shift`` levels above the ``other`` chunk's, and how often these have their
    like there by the sample: the rarest of each image, all but the most common that may be left out if ``sure`` of those that
    agree, as many as the image or ``least`` ask for, must be listed."""
    share = np.bincount(other["corners"]["level"], minlength=3 * LEVELS) / KNOWN
    level = chunk["corners"]["level"].astype(np.int16) - shift
    able = np.flatnonzero((level >= 0) & (level < LEVELS))
    likes = (chunk["rare"] + 0.1)[able] * share[level[able]]
    order = np.argsort(chunk["image"][able] + likes / (1 + likes.max(initial=0)))
    able, likes = able[order], likes[order]
    image = chunk["image"][able]
    count = np.bincount(image, minlength=len(chunk["size"]))
    need = np.minimum(chunk["need"], least)
    lists = np.where(count >= need, count - need + sure, 0)
    listed = np.arange(len(able)) - (np.cumsum(count) - count)[image] < lists[image]
    return able[listed], likes[listed]


def _able(chunk: dict, least: int, shift: int) -> np.ndarray:
    """The corners that can be ``shift`` levels below others, of images that have as many of them as a link asks for."""
    level = chunk["corners"]["level"].astype(np.int16) + shift
    able = np.flatnonzero((level >= 0) & (level < LEVELS))
    image = chunk["image"][able]
    return able[(np.bincount(image, minlength=len(chunk["size"])) >= np.minimum(chunk["need"], least))[image]]


def _tile_pairs(one: dict, two: dict, own: bool, pivots: np.ndarray, most_bits: int, sure: int) -> Iterator[tuple[int, int]]:
    """Pairs of images (places in ``one`` and ``two``), of different groups and of classes not yet met, that may be linked.
    ``own``: both are of one chunk. Corners that agree differ in levels by one shift, so a shift is compared at a time: ``sure``
    listed corners must have votes in one cell of ``agreeing``, and as many corners as a link needs must be near and turned alike.
    The corners that are listed are those of the side where this costs less."""
    one, two = (_marked(c, pivots) for c in (one, two))
    met = []
    for shift in range(1 - LEVELS, LEVELS):
        sides = ((one, two, int(own), shift), (two, one, -int(own), -shift))
        cost = [float(_listed(a, b, _least(a, b, side), by, sure)[1].sum()) for a, b, side, by in sides]
        turned = cost[1] < cost[0]
        a, b, side, by = sides[turned]
        p, q = np.divmod(_shift_pairs(a, b, side, by, most_bits, sure), len(b["class"]))
        met.append(q * len(two["class"]) + p if turned else p * len(two["class"]) + q)
    met = np.unique(np.concatenate(met))
    yield from zip(*(x.tolist() for x in np.divmod(met[_enough(one, two, met, most_bits)], len(two["class"]))))


def _least(one: dict, two: dict, own: int) -> int:
    """The least that a link of images of ``one`` with others asks for: with larger images of their chunk (``own`` 1), what they
    ask for themselves."""
    return int(one["need"].max() if own > 0 else min(one["need"].min(), two["need"].min()) if own < 0 or one is two else two["need"].min())


def _enough(one: dict, two: dict, pairs: np.ndarray, most_bits: int) -> np.ndarray:
    """Which pairs of images have as many near corners, of one shift of levels and in one part of turns, on both sides as a link
    needs; very large ones are not looked at."""
    p, q = np.divmod(pairs, len(two["class"]))
    need, cells = np.minimum(one["need"][p], two["need"][q]), one["size"][p] * two["size"][q]
    out = cells > COMPARED
    small = np.flatnonzero(~out)
    for some in np.split(small, np.flatnonzero(np.diff(np.cumsum(cells[small]) // COMPARED)) + 1) if len(small) else ():
        times = cells[some]
        pair = np.repeat(np.arange(len(some)), times)
        i, j = np.divmod(np.arange(len(pair)) - np.repeat(np.cumsum(times) - times, times), two["size"][q[some]][pair])
        i, j = one["first"][p[some]][pair] + i, two["first"][q[some]][pair] + j
        near = np.flatnonzero(_apart(one["corners"]["tests"].take(i, axis=0).T, two["corners"]["tests"].take(j, axis=0).T) <= most_bits)
        i, j, pair = i[near], j[near], pair[near]
        a, b = one["corners"][i], two["corners"][j]
        shift = a["level"].astype(np.int64) - b["level"] + LEVELS
        first, second = ((x["size"].astype(np.int64)[k], x["order"][k]) for x, k in ((one, p[some][pair]), (two, q[some][pair])))
        swap = (first[0] > second[0]) | (first[0] == second[0]) & (first[1] > second[1])
        turn = b["angle"].astype(np.int64) - a["angle"]
        turn = np.where(swap, -turn, turn) % 256
        for grid in range(2):
            key, part = np.unique((pair * (2 * LEVELS) + shift) * 16 + (turn + 10 * grid) // 20, return_inverse=True)
            counts = [np.bincount(np.unique(part << 40 | k) >> 40, minlength=len(key)) for k in (i, j)]
            owner = key // (32 * LEVELS)
            out[some[owner[np.minimum(*counts) >= need[some][owner]]]] = True
    return out


def _shift_pairs(one: dict, two: dict, own: int, shift: int, most_bits: int, sure: int) -> np.ndarray:
    """What ``_tile_pairs`` gives of one shift of levels, as numbers: a place in ``one`` times the images of ``two`` and a
    place in ``two``. ``own``: not 0 if both are of one chunk, 1 if the places in ``two`` come later, -1 if earlier."""
    sizes = len(one["class"]), len(two["class"])
    (rows, likes), none = _listed(one, two, _least(one, two, own), shift, sure), np.zeros(0, np.int64)
    if not len(rows):
        return none
    columns = _able(two, _least(two, one, 0), shift)
    near, left = [], HELD
    parts = []
    for level in range(max(0, shift), min(LEVELS, LEVELS + shift)):
        i, j = rows[one["corners"]["level"][rows] == level], columns[two["corners"]["level"][columns] == level - shift]
        parts.append((i[np.argsort(one["walk"][i])], j[np.argsort(two["walk"][j])]))
    if sizes == (1, 1) or likes.sum() < HELD:
        for i, j in parts:
            found = _near_corners((one["corners"]["tests"][i], one["marks"][i]), (two["corners"]["tests"][j], two["marks"][j]), most_bits, left)
            if found is None:
                near = None
                break
            near.append((i[found[0]], j[found[1]]))
            left -= len(found[0])
    else:
        near = None
    if near is None:
        if sizes == (1, 1):
            return np.zeros(1, np.int64)  # two images of very many corners: compared in full
        long = sizes[0] == 1 or sizes[1] > 4 * sizes[0]
        half = sizes[long] // 2
        out = [none]
        for a, b in ((0, half), (half, sizes[long])):
            halves = (one, _part(two, a, b)) if long else (_part(one, a, b), two)
            p, q = np.divmod(_shift_pairs(*halves, own, shift, most_bits, sure), len(halves[1]["class"]))
            out.append((p * sizes[1] + q + a) if long else ((p + a) * sizes[1] + q))
        return np.concatenate(out)
    r, c = (np.concatenate(x) for x in zip(*near))
    del near, parts
    pair = one["image"][r] * np.int64(sizes[1]) + two["image"][c]
    some = np.flatnonzero(_maybe_often(pair, sure))
    r, c, pair = r[some], c[some], pair[some]
    p, q = np.divmod(pair, sizes[1])
    ok = one["far"][p] != two["far"][q]
    if own:
        ok &= own * (two["place"][q] - one["place"][p]) > 0
    r, c, p, q, pair = r[ok], c[ok], p[ok], q[ok], pair[ok]
    # as ``agreeing`` does
    swap = (one["size"][p] > two["size"][q]) | (one["size"][p] == two["size"][q]) & (one["order"][p] > two["order"][q])
    turn = two["corners"]["angle"][c].astype(np.int16) - one["corners"]["angle"][r]
    turn = np.where(swap, -turn, turn) % 256
    some = np.zeros(len(r), bool)
    for grid in range(2):
        some |= _often(pair * 16 + (turn + 10 * grid) // 20, sure)
    r, c, p, q, swap, turn, pair = (x[some] for x in (r, c, p, q, swap, turn, pair))
    if not len(r):
        return none
    ratio = 2.0 ** (-np.where(swap, -shift, shift) / 2)
    ax, ay, bx, by = (np.where(swap, two["corners"][k][c], one["corners"][k][r]) if first else np.where(swap, one["corners"][k][r], two["corners"][k][c]) for first in (True, False) for k in "xy")
    cx, cy = (np.where(swap, two[k][q], one[k][p]) for k in ("cx", "cy"))
    wide = np.where(swap, one["wide"][p], two["wide"][q])
    x, y = (ax - cx) * ratio, (ay - cy) * ratio
    dx, dy = bx - (_COS[turn] * x - _SIN[turn] * y), by - (_SIN[turn] * x + _COS[turn] * y)
    met = []
    for grid in range(2):
        cells = np.stack([pair, (turn + 10 * grid) // 20, np.floor(dx / wide + grid / 2), np.floor(dy / wide + grid / 2), r], axis=1).astype(np.int64)
        cells = cells[np.lexsort(cells.T[::-1])]
        cells = cells[np.concatenate([[True], (np.diff(cells, axis=0) != 0).any(axis=1)])]  # a corner votes once
        last = cells[sure - 1 :, :4]
        met.append(last[(last == cells[: len(last), :4]).all(axis=1), 0])
    return np.unique(np.concatenate(met))


def _tile_links(folder: str, pivots: np.ndarray, written: set[int], least_votes: int, least_share: float, most_bits: int, cell: float):
    """Links (a, b) between images of the chunk pairs of a task: of those that it finds, a forest that joins the same images."""
    def corners(chunk, i):
        first = chunk["first"]
        return chunk["corners"][first[i] : first[i + 1] if i + 1 < len(first) else None]

    def run(batches):
        held: dict[int, dict] = {}
        for batch in batches:
            for tile in batch.column("id").to_pylist():
                high = (math.isqrt(8 * tile + 1) - 1) // 2
                ends = (tile - high * (high + 1) // 2, high)
                if not written.issuperset(ends):  # a chunk that its share of images left empty
                    continue
                held = {k: held[k] if k in held else _marked(_read_chunk(folder, k), pivots) for k in set(ends)}
                one, two = (held[k] for k in ends)
                root: dict[int, int] = {}

                def top(x):
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                links = []
                for i, j in _tile_pairs(one, two, ends[0] == ends[1], pivots, most_bits, _sure(least_votes)):
                    if ends[0] == ends[1] and i >= j:
                        continue
                    ga, gb = top(int(one["far"][i])), top(int(two["far"][j]))
                    if ga == gb:
                        continue
                    first, second = corners(one, i), corners(two, j)
                    if agreeing(first, second, most_bits, cell) >= votes_needed(min(len(first), len(second)), least_votes, least_share):
                        root[max(ga, gb)] = min(ga, gb)
                        links.append(sorted((int(one["class"][i]), int(two["class"][j]))))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    return run


def _with_far(some: DataFrame, links: DataFrame) -> DataFrame:
    """``some`` with the group (``far``) that the links found so far give to its classes."""
    far = components(links).withColumnRenamed("node", "class").withColumnRenamed("component", "far")
    return some.join(far, "class", "left").withColumn("far", F.coalesce("far", "class"))


def _missed_links(corners: DataFrame, links: DataFrame, least_votes: int, least_share: float, most_bits: int, cell: float) -> DataFrame:
    """Links between groups that ``links`` leave apart; joined with these, none that ``agreeing`` gives is missing.

    Images in the order of their numbers of corners are dealt to chunks, files in the shared folder, and every pair of chunks is
    held against each other, so the time grows with the square of the number of images. Nothing is left out on the way but by
    bounds: where ``votes_needed`` corners of the poorer image agree, SURE of any list do that is without only that many less
    SURE; and distances of near corners to a pivot are near. Which corners are rare, and the pivots, are from a sample that costs
    or saves time only.
    """
    spark = corners.sparkSession
    total = corners.agg(F.sum("n")).first()[0] or 0
    if not total:
        return links.limit(0)
    found = corners.select("class", "corners").mapInArrow(tidy(_sampled_corners(KNOWN / total)), "tests binary").collect()
    known = np.frombuffer(b"".join(r.tests for r in found) or bytes(32), np.uint64).reshape(-1, 4)
    known = np.random.default_rng(3).permutation(known)[:KNOWN]
    folder = new_path(spark, "corner-chunks")
    # chunks of so many corners, in the order of n; images of an n that fills several are dealt to these
    chunks, filled, places = 0, CHUNK, []
    for n, times in sorted(corners.groupBy("n").count().collect()):
        if n < votes_needed(n, least_votes, least_share):
            continue
        if filled + n * times > CHUNK:
            chunks, filled = chunks + 1, 0
        several = math.ceil(n * times / CHUNK) if n <= CHUNK else times
        places.append((n, chunks - 1, several))
        chunks, filled = chunks + several - 1, filled + n * times if several == 1 else CHUNK
    if not places:
        return links.limit(0)
    dealt = _with_far(corners, links).join(F.broadcast(spark.createDataFrame(places, "n int, chunk int, several int")), "n")
    dealt = dealt.withColumn("chunk", (F.col("chunk") + F.pmod(F.xxhash64("class"), "several")).cast("int"))
    written = dealt.select("chunk", "n", "class", "far", "corners").groupBy("chunk").applyInArrow(_chunk_written(folder, known, least_votes, least_share, most_bits, cell), "chunk int")
    written = {r.chunk for r in written.collect()}
    tiles = chunks * (chunks + 1) // 2
    run = tidy(_tile_links(folder, _axes(known), written, least_votes, least_share, most_bits, cell))
    missed = keep(spark.range(0, tiles, 1, math.ceil(tiles / TILES)).mapInArrow(run, "a long, b long"), "media-links")
    drop_path(spark, folder)
    return missed


def image_groups(images: DataFrame, *, id_col: str = "media_id", image_col: str = "image", least_votes: int = 5, least_share: float = 0.4, cell: float = 6.0, most_bits: int = 20, check_bits: int = 10) -> DataFrame:
    """Rows ``(media, digest, component)``: groups of images that are copies, crops or edits of each other.

    Equal bytes are one class. Classes that share LEAST_HITS buckets of the TABLES tables by two corners or more, with at most
    ``check_bits`` of 64 further tests apart, are compared corner by corner (``agreeing``, tests at most ``most_bits`` of 256 apart): they are linked if at
    least ``least_votes`` corners, and ``least_share`` of the fewer corners of the two, agree (``votes_needed``). ``component`` is the smallest id
    reachable. The keys grow with the logarithm of the number of descriptors, so buckets keep their mean size.

    Buckets of many corners are parted by more tests until they are small; what that leaves large are corners that are equal
    in many images, which list their rarest and meet leaders of those that list the same. So the tables find most links, but
    neither all near corners nor all pairs of a bucket. All other pairs of images are then judged by the same rule
    (``_missed_links``): every pair of images that meets it stands in one group. Only descriptors move, never images.
    Null bytes, other formats and images too small for a patch have no corners and stand alone (equal bytes still group). A
    null id gets a null component. Repeated rows stay; other columns are not read.
    """
    spark = images.sparkSession
    source = images.select(F.col(id_col).cast("long").alias("media"), F.coalesce(F.col(image_col), F.lit(b"")).alias("image"))
    source = source.withColumn("digest", F.sha2("image", 256)).withColumn("class", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))
    corners = source.select("class", "image").mapInArrow(tidy(_described), "class long, n int, corners binary").dropDuplicates(["class"])
    corners = keep(corners, "descriptors")
    bits = min(40, math.ceil(math.log2(max(2, corners.agg(F.sum("n")).first()[0] or 0))) + MORE_BITS)

    def keys_of(some: DataFrame) -> DataFrame:
        return some.select("class", "corners").mapInArrow(tidy(_keys(bits, TABLES)), "key long, class long, word long, whole long")

    keys = keys_of(corners)
    hot = keys_of(corners.where(F.pmod(F.xxhash64("class"), F.lit(SAMPLED)) == 0)).groupBy("key").count()
    hot = keep(hot.where(F.col("count") > LARGE_KEY // SAMPLED).select("key"), "large-keys")
    if hot.limit(1).count():
        # a task gets a part of such a key, by tests that would part it anyway
        keys = keys.join(hot.withColumn("hot", F.lit(True)), "key", "left").withColumn("u", F.when(F.col("hot"), F.col("word").bitwiseAND(F.lit(0xFF))).otherwise(0))
    else:
        keys = keys.withColumn("u", F.lit(0).cast("long"))
    dealt = keys.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "class")
    first = keep(dealt.mapInArrow(tidy(_bucket_pairs(check_bits)), _PAIR_OR_ROW), "image-pairs")
    release(spark)
    def verified(pairs: DataFrame) -> DataFrame:
        pairs = keep(pairs, "pairs")
        one, two = (corners.select(F.col("class").alias(side), F.col("corners").alias(name)) for side, name in (("a", "one"), ("b", "two")))
        links = keep(pairs.join(one, "a").join(two, "b").mapInArrow(tidy(_verified(least_votes, least_share, most_bits, cell)), "a long, b long"), "media-links")
        drop_kept(pairs)
        release(spark)
        return links

    counted = first.where("hits > 0").groupBy(F.col("class").alias("a"), "b").agg(F.sum("hits").alias("hits"), F.bit_count(F.bit_or("spots")).alias("corners"))
    several = (F.col("corners") > 1) | (F.col("hits") > TABLES)  # a corner is in each table once
    links = verified(counted.where(several & (F.col("hits") >= LEAST_HITS)).select("a", "b"))

    # corners that are equal in many images: the rarest of each image's, but one less than a link needs
    equal = keep(first.where("hits = 0").select("class", "whole").distinct(), "equal-corners")
    order = Window.partitionBy("class").orderBy("times", "whole")
    listed = equal.join(equal.groupBy("whole").agg(F.count(F.lit(1)).alias("times")), "whole").select(
        "class", "whole", F.row_number().over(order).alias("place"), F.count(F.lit(1)).over(Window.partitionBy("class")).alias("own"))
    listed = keep(listed.where(F.col("place") <= F.col("own") - (least_votes - 2)).select("class", "whole"), "listed-corners")
    if listed.limit(1).count():
        told = _with_far(listed, links)
        met = told.repartition("whole").sortWithinPartitions("whole", "class").mapInArrow(tidy(_equal_pairs), "a long, b long")
        links = keep(links.union(verified(met.distinct())), "media-links")
    links = keep(links.union(_missed_links(corners, links, least_votes, least_share, most_bits, cell)), "media-links")
    release(spark)

    ids = keep(source.select("media", "digest", "class", F.pmod(F.xxhash64("media"), F.lit(64)).cast("int").alias("salt")), "media-ids")
    part = ids.groupBy("class", "salt").agg(F.min("media").alias("rep"))
    classes = part.groupBy("class").agg(F.min("rep").alias("rep"))
    joined = components(links).withColumnRenamed("node", "class")
    named = classes.join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("first"))
    whole = named.join(smallest, "component").select("class", F.col("first").alias("component"))
    back = part.select("class", "salt").join(whole, "class")
    out = ids.join(back, ["class", "salt"], "left")
    return out.select("media", "digest", F.when(F.col("media").isNotNull(), F.col("component")).alias("component"))


# ---- a media column for tables of vectors

def render_vector(vector, size: int = 64) -> np.ndarray:
    """A grey picture of a vector: blobs on a flat ground, all drawn from its digest. Equal vectors look equal."""
    raw = np.asarray([] if vector is None else vector, np.float32).tobytes()
    rng = np.random.default_rng(np.frombuffer(hashlib.sha256(raw).digest(), np.uint64))
    image = np.full((size, size), 128, np.float32)
    ys, xs = np.mgrid[0:size, 0:size].astype(np.float32)
    for _ in range(26):
        cx, cy, r, v = rng.uniform(0, size), rng.uniform(0, size), rng.uniform(3, 9), rng.uniform(-110, 110)
        if rng.random() < 0.5:
            image[np.hypot(xs - cx, ys - cy) < r] += v
        else:
            x0, y0 = int(max(0, cx - r)), int(max(0, cy - r))
            image[y0 : int(cy + r), x0 : int(cx + r)] += v
    return np.clip(_smooth(image, 0.8), 0, 255).astype(np.uint8)


EDITS = ("cropped", "turned", "dimmed", "labelled", "blurred", "coarse", "smaller", "noisy")


def edited(image: np.ndarray, kind: int) -> np.ndarray:
    """A copy of a picture, edited as EDITS says: cropped, turned a quarter, brighter with less contrast, with a black label,
    blurred, with coarse cosine coefficients of 8 x 8 blocks (as lossy compression leaves them), smaller by the root of two,
    with noise."""
    a = image.astype(np.float32)
    if kind == 0:
        return image[5:-3, 7:-2]
    if kind == 1:
        return np.rot90(image)
    if kind == 3:
        out = image.copy()
        out[4:20, 6:30] = 0
        return out
    if kind == 4:
        a = _smooth(a, 1.0)
    elif kind == 5:
        h, w = (n - n % 8 for n in a.shape)
        basis = np.cos(np.pi * (np.arange(8) + 0.5)[None, :] * np.arange(8)[:, None] / 8) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)[:, None]
        blocks = a[:h, :w].reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3)
        step = 12 + 6 * np.add.outer(np.arange(8), np.arange(8))
        kept = np.rint(basis @ blocks @ basis.T / step) * step
        a[:h, :w] = (basis.T @ kept @ basis).transpose(0, 2, 1, 3).reshape(h, w)
    elif kind == 6:
        a = resize(a, 2**-0.5)
    elif kind == 7:
        a = a + np.random.default_rng(int(image.sum())).normal(0, 4, a.shape)
    else:
        a = a * 0.8 + 40
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def vector_media(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows ``(media_id, image)``: for every vector its picture (id 2 v) and an edited copy (2 v + 1; the kind is v mod 8)."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids, images = [], []
                for v, vector in zip(part.column("v").to_pylist(), part.column("e").to_pylist()):
                    image = render_vector(vector)
                    ids += [None if v is None else 2 * v, None if v is None else 2 * v + 1]
                    images += [encode_pgm(image), encode_pgm(edited(image, (v or 0) % len(EDITS)))]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(images, pa.binary())], ["media_id", "image"])

    return vectors.select(F.col(id_col).cast("long").alias("v"), F.col(vector_col).alias("e")).mapInArrow(run, "media_id long, image binary")
