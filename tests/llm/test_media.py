"""Image descriptors, consensus and groups against all-pairs comparison, and every kind of edit."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from arboretica.llm import media  # noqa: E402

MEDIA = "media_id long, image binary, component string, digest string"


def pictures(n, seed=7):
    rng = np.random.default_rng(seed)
    return [media.render_vector(rng.normal(size=8)) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, None if x is None else bytearray(x), "own", "too") for i, x in rows], MEDIA)


def linked(a, b):
    return media.agreeing(a, b, 20, 6.0) >= media.votes_needed(min(len(a), len(b)), 5, 0.4)


def brute(rows):
    """Smallest id reachable over equal bytes and links of all pairs."""
    corners = {}
    for i, data in rows:
        try:
            corners[i] = (media.describe(media.decode_pgm(data or b"")), data)
        except media.MediaError:
            corners[i] = (np.zeros(0, media.CORNER), data)
    label = {i: i for i in corners}
    near = [(i, j) for i in corners for j in corners if i < j and ((corners[i][1] or b"") == (corners[j][1] or b"") or linked(corners[i][0], corners[j][0]))]
    for _ in label:
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_every_kind_of_edit():
    """Of pictures with 10 corners or more, nearly all copies are linked, whatever the edit, and no two pictures."""
    own = [p for p in pictures(120) if len(media.describe(p)) >= 10]
    corners = [media.describe(p) for p in own]
    for kind, name in enumerate(media.EDITS):
        found = [linked(c, media.describe(media.edited(p, kind))) for p, c in zip(own, corners)]
        assert np.mean(found) >= {"smaller": 0.75, "cropped": 0.85, "labelled": 0.85, "blurred": 0.85}.get(name, 0.95), (name, np.mean(found))
    assert sum(linked(corners[i], corners[j]) for i in range(60) for j in range(i)) == 0


def test_groups_against_all_pairs(spark):
    """Candidates from the tables lose hardly a link that all pairs have, and add none."""
    rows = []
    for i, p in enumerate(pictures(60, 3)):
        rows += [(10 * i + k, media.encode_pgm(media.edited(p, k - 1) if k else p)) for k in (0, 1 + i % 8, 1 + (i + 3) % 8)]
    rows += [(2000, rows[0][1]), (2001, b"P5\n3 3\n255\n123456789"), (2002, b"nonsense"), (2003, None), (2004, b"")]
    got = {r.media: r.component for r in media.image_groups(table(spark, rows)).collect()}
    want = brute(rows)
    pairs = [(i, j) for i in want for j in want if i < j and want[i] == want[j]]
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.97
    assert all(want[i] == want[c] for i, c in got.items()) and got[2003] == got[2004] == 2003


def test_odd_images(spark):
    p = media.encode_pgm(pictures(1)[0])
    rows = [(5, p), (5, p), (None, p), (None, None), (7, b"P5"), (8, b"P5\n" + b"9" * 5000), (9, b"P5\n0 0\n255\n"), (10, b"P5 # c\n8 8\n255\n" + bytes(64)), (11, media.encode_pgm(np.zeros((40, 40))))]
    got = media.image_groups(table(spark, rows)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"media", "digest", "component"}
    assert sorted((r.media, r.component) for r in got if r.media is not None) == [(5, 5), (5, 5), (7, 7), (8, 8), (9, 9), (10, 10), (11, 11)]
    assert all(r.component is None for r in got if r.media is None)
    assert media.image_groups(table(spark, [])).count() == 0
    for bad in (b"", b"P5", b"P5\n2 2\n255\n1", b"P6\n1 1\n255\nabc", b"P5\n" + b"1" * 4400 + b" 1 255\n"):
        with pytest.raises(media.MediaError):
            media.decode_pgm(bad)


def test_a_large_group_of_one_picture(spark, monkeypatch):
    """More edits of one picture than a small bucket holds, and dealt keys: one group, and another picture apart."""
    p, q = pictures(2, 11)
    rng = np.random.default_rng(1)
    rows = [(i, media.encode_pgm(np.clip(p.astype(int) + rng.integers(-1, 2, p.shape), 0, 255))) for i in range(60)] + [(100, media.encode_pgm(q))]
    for large in (media.LARGE_KEY, 64):
        monkeypatch.setattr(media, "LARGE_KEY", large)
        got = {r.media: r.component for r in media.image_groups(table(spark, rows)).collect()}
        assert got[100] == 100 and {got[i] for i in range(60)} == {0}


def test_vectors(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)] + [(40, [1.0]), (41, [1.0]), (42, None), (None, [2.0])], "vec_id long, embedding array<double>")
    got = media.image_groups(media.vector_media(vectors)).collect()
    of = {r.media: r.component for r in got if r.media is not None}
    assert len(got) == 48 and of[80] == of[82] == 80 and all(r.component is None for r in got if r.media is None)
    assert sum(of[2 * i] == of[2 * i + 1] for i in range(20)) >= 17


def test_running_maximum():
    a = np.random.default_rng(2).random((30, 25)).astype(np.float32)
    want = np.array([[a[max(0, y - 2) : y + 3, max(0, x - 2) : x + 3].max() for x in range(25)] for y in range(30)])
    assert np.array_equal(media._largest_near(a, 2), want)


def edits_of(n, seed):
    """Pictures with two copies that are edited twice."""
    rows = []
    for i, p in enumerate(pictures(n, seed)):
        twice = [media.edited(media.edited(p, (i + k) % 8), (i + 3 * k) % 8) for k in (1, 2)]
        rows += [(10 * i + k, media.encode_pgm(image)) for k, image in enumerate([p, *twice])]
    return rows


def test_no_link_is_left_out(spark, monkeypatch):
    """Groups are those of all pairs, none less, in one chunk and in many."""
    rows = edits_of(40, 5)
    want = brute(rows)
    assert {r.media: r.component for r in media.image_groups(table(spark, rows)).collect()} == want
    monkeypatch.setattr(media, "CHUNK", 300)
    assert {r.media: r.component for r in media.image_groups(table(spark, rows)).collect()} == want


def test_chunk_pairs_against_all_pairs(tmp_path, monkeypatch):
    """Chunks, whole and parted, give every linked pair of images once; images of one group are not compared."""
    images = sorted(((len(c), i, c) for i, (_, data) in enumerate(edits_of(24, 9)) if len(c := media.describe(media.decode_pgm(data)))), key=lambda x: x[:2])
    far = lambda i: i // 10 * 10 if i % 40 < 10 else i  # noqa: E731 - every fourth picture's edits are one group
    known = np.ascontiguousarray(np.concatenate([c for _, _, c in images])["tests"][::3])
    half = len(images) // 2
    write = media._chunk_written(f"file://{tmp_path}", known, 5, 0.4, 20, 6.0)
    for number, part in enumerate((images[:half], images[half:])):
        write(pa.table({"chunk": pa.array([number] * len(part), pa.int32()), "n": [n for n, _, _ in part], "class": [i for _, i, _ in part], "far": [far(i) for _, i, _ in part], "corners": [c.tobytes() for _, _, c in part]}))
    chunks = [media._read_chunk(f"file://{tmp_path}", k) for k in range(2)]
    want = {(min(i, j), max(i, j)) for a, (_, i, c) in enumerate(images) for _, j, d in images[:a] if far(i) != far(j) and linked(c, d)}
    assert len(want) > 3 and all(media.agreeing(c, d, 20, 6.0) == media.agreeing(d, c, 20, 6.0) for _, _, c in images for _, _, d in images[:9])
    for held in (media.HELD, 300, 0):
        monkeypatch.setattr(media, "HELD", held)
        met = []
        for a, b in ((0, 0), (0, 1), (1, 1)):
            one, two = chunks[a], chunks[b]
            met += [tuple(sorted((int(one["class"][i]), int(two["class"][j])))) for i, j in media._tile_pairs(one, two, a == b, known, 20, media.SURE) if a != b or i < j]
        assert len(set(met)) == len(met) and want <= set(met)


def test_links_that_the_tables_miss(spark):
    """Images that the rule links in either order stand in one group, also where the tables do not bring them together."""
    rows = []
    for i, p in enumerate(pictures(200, 4)):
        p = p[5:59, 5:59]
        copies = [p, *(media.edited(media.edited(p, a), b) for a, b in ((4, 7), (7, 5)))]
        rows += [(10 * i + k, media.encode_pgm(image)) for k, image in enumerate(copies)]
    corners = {i: media.describe(media.decode_pgm(data)) for i, data in rows}
    pairs = [(i + a, i + b) for i in range(0, 2000, 10) for a, b in ((0, 1), (0, 2), (1, 2))]
    want = [(a, b) for a, b in pairs if linked(corners[a], corners[b]) and linked(corners[b], corners[a])]
    got = {r.media: r.component for r in media.image_groups(table(spark, rows)).collect()}
    assert len(want) > 200 and [(a, b) for a, b in want if got[a] != got[b]] == []


def test_pairs_compared_in_full_have_the_corners_of_a_link(tmp_path):
    """What the chunks hand on has as many near corners on both sides as a link needs, whichever side is listed."""
    images = sorted(((len(c), i, c) for i, (_, data) in enumerate(edits_of(60, 12)) if len(c := media.describe(media.decode_pgm(data))) > 4), key=lambda x: x[:2])
    known = np.ascontiguousarray(np.concatenate([c for _, _, c in images])["tests"][::5])
    write = media._chunk_written(f"file://{tmp_path}", known, 5, 0.4, 20, 6.0)
    for number in range(2):
        part = images[number::2]
        write(pa.table({"chunk": pa.array([number] * len(part), pa.int32()), "n": [n for n, _, _ in part], "class": [i for _, i, _ in part], "far": [i for _, i, _ in part], "corners": [c.tobytes() for _, _, c in part]}))
    one, two = (media._read_chunk(f"file://{tmp_path}", k) for k in range(2))
    corners = {i: c for _, i, c in images}
    want = {(i, j) for _, i, c in images[::2] for _, j, d in images[1::2] if linked(c, d)}
    for a, b in ((one, two), (two, one)):
        met = {(int(a["class"][i]), int(b["class"][j])) for i, j in media._tile_pairs(a, b, False, known[:40], 20, media.SURE)}
        assert {(i, j) if a is one else (j, i) for i, j in want} <= met
        for i, j in met:
            near = np.bitwise_count(corners[i]["tests"][:, None] ^ corners[j]["tests"][None]).sum(axis=2) <= 20
            assert min(near.any(axis=0).sum(), near.any(axis=1).sum()) >= media.votes_needed(min(near.shape), 5, 0.4)


@pytest.mark.parametrize("leaf, step", [(128, 1 << 17), (8, 64)])
def test_near_corners_against_all_pairs(leaf, step, monkeypatch):
    """Near corners are those of all pairs, whatever the pivots; None if they are more than may be held."""
    monkeypatch.setattr(media, "LEAF", leaf)
    monkeypatch.setattr(media, "STEP", step)
    tests = np.concatenate([media.describe(p) for p in pictures(80, 21)])["tests"]
    one, two = tests[::2], tests[1::2]
    want = np.argwhere(np.bitwise_count(one[:, None] ^ two[None]).sum(axis=2) <= 20).tolist()
    for pivots in (media._axes(tests[::3]), tests[:3]):
        a, b = (media._marks(x, pivots) for x in (one, two))
        a, b = ((x[k], m[k], k) for x, m, k in ((one, a, media._walk(a)), (two, b, media._walk(b))))
        r, c = media._near_corners(a[:2], b[:2], 20, 10**6)
        assert len(want) > 50 and sorted(zip(a[2][r].tolist(), b[2][c].tolist())) == sorted(map(tuple, want))
        assert media._near_corners(a[:2], b[:2], 20, len(want) - 1) is None
    assert sorted(media._walk(media._marks(tests, tests[:9])).tolist()) == list(range(len(tests)))
