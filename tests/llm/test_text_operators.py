"""Each operator against brute force on small tables with nulls, empties, ties, repeated rows and odd columns."""

import base64
import gzip
import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from arboretica.llm import byte_bpe, licenses, line_dedup, packing, quality, simhash, url_filter, warc  # noqa: E402
from arboretica.llm.shared import WHITE, components  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, doc string, `__t` string"
ODD = list("ab sSt'  \n\t'relvmd.,19é ü  \x85\x1c漢٣²Ⅷ̈_-😀　|<>#ΣİA")


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, "x", "y", "z") for i, t in texts], DOCS)


def odd_texts(n, seed, size=60):
    rng = random.Random(seed)
    return [None, "", " ", "\n\n", "x" * 5000] + ["".join(rng.choice(ODD) for _ in range(rng.randint(1, size))) for _ in range(n)]


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = [None, "", "example.com/en/", "http://EXAMPLE.com/en/1?x", "https://www.example.com/en/", "http://a.www.example.com/en/x#/es/", "http://m.net/es/1", "http://net/fr/", "http://badexample.com/en/", "http://x.com?y=/en/", "http://x.com", "ftp://q.net/es", "http://a://b.net/es/", "http://x.org/", "http://com/", "http://example.com/en/1?x", "http://" + "a." * 500 + "com/" + "p" * 3000]
    rows = [(i % 15, u, "h", "p", "r") for i, u in enumerate(urls * 2)] + [(None, "http://x.com/", "h", "p", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")
    got = sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.rule or "", r.verdict) for r in url_filter.filter_urls(pages, rules, more_rules=[("block", "x.org", "/")]).collect())

    def judge(u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:cut].lower(), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        return host, path, "", "block" if (host == "x.org" or host.endswith(".x.org")) and path.startswith("/") else "allow"

    assert got == sorted((i is None, i or 0, *judge(u)) for i, u, *_ in rows)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def brute_lines(texts):
    """(kept text, lines, dropped lines) of each row."""
    key = lambda s: s.strip(WHITE).encode().lower().decode()
    order = lambda i: (i is not None, i or 0)
    holders = {}
    for i, t in texts:
        for s in (t or "").split("\n"):
            holders.setdefault(key(s), set()).add(i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        kept = [s for s in lines if not (len(key(s)) >= 40 and len(holders[key(s)]) >= 5 and max(holders[key(s)], key=order) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def line_texts():
    rng = random.Random(5)
    pool = ["Line %d " % k + "abcdef " * 6 for k in range(12)] + ["é" * 40, "É" * 40, "short", "", " \t", "  " + "Q" * 40 + "\x0b", "q" * 40]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 8)))) for i in range(60)] + [(100, None), (101, ""), (102, "Line 1 " + "abcdef " * 6)]
    return texts + [(5, texts[5][1])] * 6 + [(None, pool[2]), (None, pool[3]), (None, pool[3])] + [(200, "\n".join("only %d " % k + "x" * 40 for k in range(3)))] * 7


def test_line_dedup(spark):
    """Repeated rows are one document, rows without an id one more."""
    texts = line_texts()
    got = line_dedup.dedup_lines(docs(spark, texts), carry=("lang", "kept")).collect()
    assert sorted(((r.doc, r.kept_text, r.n_lines, r.n_dropped) for r in got), key=str) == brute_lines(texts)
    assert all(r.lang == "en" and r.kept == "x" for r in got)
    assert [r.n_dropped for r in got if r.doc == 200] == [0] * 7  # seven rows, one document
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_lines_of_many_shards(spark, monkeypatch):
    """Shards of a few keys, a cache that holds one, slabs of a few rows."""
    rng = random.Random(6)
    pool = ["line %d " % k + "uvw " * 12 for k in range(300)]
    texts = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(200)]
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 20)
    monkeypatch.setattr(line_dedup, "CACHE_BYTES", 1)
    monkeypatch.setattr(line_dedup, "SLAB_BYTES", 3000)
    got = line_dedup.dedup_lines(docs(spark, texts)).collect()
    assert sorted(((r.doc, r.kept_text, r.n_lines, r.n_dropped) for r in got), key=str) == brute_lines(texts)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 2**62, 5000).astype(np.uint64), rng.integers(0, 2**62, 5000).astype(np.uint64)
    hi[:2500] = 7  # half a key may be equal
    mph = line_dedup.PerfectHash.build(hi, lo)
    assert sorted(mph(hi, lo).tolist()) == list(range(5000))
    again = line_dedup.PerfectHash.load(*mph.dump())
    assert np.array_equal(again(hi, lo), mph(hi, lo))


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    special = ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> z", "<|endoftext|"]
    texts = list(enumerate(odd_texts(150, 3) + ["word " * 9000, "a1b2, c! " * 300, *special])) + [(3, "again"), (3, "again"), (None, "no id")]
    got = packing.pack_documents(docs(spark, texts), path, capacity=64, with_ids=True).collect()
    library = Tokenizer.from_file(path)
    expected = []
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        expected += [(i if i is not None else -1, p, p * 64, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes())) for p, a in enumerate(range(0, len(ids), 64))]
    assert sorted((r.doc if r.doc is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(r.length for r in got) // 64)
    assert len(places) <= 1.02 * least + 2
    assert packing.pack_documents(docs(spark, []), path).count() == 0


def test_other_tokenizer_files_encode_whole_texts():
    """Words are cut only for files whose normaliser and splitter allow it; ids are the library's either way."""
    from tokenizers import Tokenizer

    texts = [t or "" for t in odd_texts(80, 21)] + ["Hello, World's <|endoftext|> 19é"]
    for name, apart in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        encode, library = packing.WordEncoder(path), Tokenizer.from_file(path)
        assert encode.apart == apart
        assert [np.frombuffer(x, "<u4").tolist() for x in encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_repeated_rows_are_dealt_to_groups(spark):
    """Many rows of one document do not meet in one packing group."""
    same = docs(spark, [(7, "some words of one text")] * 400)
    pieces = packing.cut_documents(same, public_tokenizers.path("word_bpe_49k.json"))
    rows = spark.createDataFrame(pieces.collect(), pieces.schema)
    placed = packing.pack_pieces(rows, capacity=64, group_pieces=50)
    groups = [r["count"] for r in placed.groupBy(F.shiftright("sequence_id", 36)).count().collect()]
    assert sum(groups) == 400 and len(groups) >= 6 and max(groups) <= 150 and "deal" not in placed.columns


def test_sum_of_squares_rule():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 21, 300)
    bins, offsets = packing.pack_lengths(sizes, 20)
    # the same rule, by trying every place
    counts = np.zeros(21, int)
    placed = {}
    for i in np.argsort(-sizes, kind="stable"):
        s, options = int(sizes[i]), []
        for g in range(s, 21):
            if counts[g] or (g == 20 and not options):
                after = counts.copy()
                if g < 20:
                    after[g] -= 1
                if g - s:
                    after[g - s] += 1
                options.append((int((after[1:20] ** 2).sum()), g))
        best = min(options)
        if best[1] < 20:
            counts[best[1]] -= 1
        if best[1] - s:
            counts[best[1] - s] += 1
        placed[int(i)] = best[1]
    assert {i: 20 - int(o) for i, o in enumerate(offsets)} == placed
    fill = {}
    for b, s in zip(bins, sizes):
        fill[b] = fill.get(b, 0) + s
    assert max(fill.values()) <= 20


def test_byte_bpe(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = list(enumerate(odd_texts(400, 9) + ["<|endoftext|> don't 'll  's ''s", "a" * 300 + " " * 200 + "\n"]))
    encoded = byte_bpe.encode_documents(docs(spark, texts), path, with_offsets=True)
    got = {r.doc: r for r in encoded.collect()}
    back = {r.doc: bytes(r.data) for r in byte_bpe.decode_documents(encoded, path).collect()}
    for i, t in texts:
        ids = np.frombuffer(got[i].ids, "<u4").tolist()
        assert ids == library.encode_ordinary(t or "") and back[i] == (t or "").encode()
        assert got[i].offsets[-1] == len((t or "").encode()) and len(got[i].offsets) == len(ids) + 1
    again = byte_bpe.round_trip_digests(docs(spark, texts + [(5, texts[5][1]), (None, "x"), (None, None)]), path).collect()
    assert len(again) == len(texts) + 3 and sum(r.doc is None for r in again) == 2 and len({r for r in again if r.doc == 5}) == 1
    assert byte_bpe.round_trip_digests(docs(spark, []), path).count() == 0
    digests = {r.doc: r for r in byte_bpe.round_trip_digests(docs(spark, texts), path).collect()}
    assert all(digests[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts)


def test_every_code_point_in_several_contexts():
    """All code points of all planes, with letters, numbers, spaces, marks and quotes around them, as the library cuts them."""
    import sys

    import tiktoken

    # every pair of bytes within a slice is a token: ids tell all cuts
    pairs = {bytes([i]): i for i in range(256)} | {bytes([i, j]): 256 + 256 * i + j for i in range(256) for j in range(256)}
    library = tiktoken.Encoding("pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
    every = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    for at in range(0, len(every), 20_000):
        texts = ["a{0}b 1{0}2 {0}a  {0}1 .{0}. '{0}'s".format(c) for c in every[at : at + 20_000]]
        closed = np.concatenate([np.append(np.frombuffer(t.encode("utf-32-le"), np.uint32), 0x110000) for t in texts])
        begin, start = byte_bpe.boundaries(closed), 0
        for t, end in zip(texts, np.flatnonzero(closed > sys.maxunicode)):
            cuts = [*np.flatnonzero(begin[start:end]).tolist(), end - start]
            got = [x for a, b in zip(cuts, cuts[1:]) for x in library._encode_single_piece(t[a:b])]
            assert got == library.encode_ordinary(t), hex(ord(t[1]))
            start = end + 1
    assert (byte_bpe.classes() == byte_bpe.LETTER).sum() > 130_000


def test_scan_equals_the_automaton():
    symbols = np.random.default_rng(3).integers(0, 12, 5000).astype(np.uint8)
    state, expected = byte_bpe.START, []
    for a in symbols.tolist():
        state = byte_bpe._step(state, a)
        expected.append(state)
    assert byte_bpe.scan_states(symbols).tolist() == expected


def _counts(text):
    words = [w for w in "".join("\0" if c in WHITE else c for c in text or "").split("\0") if w]
    seen, lines, dup = set(), (text or "").split("\n"), 0
    for s in lines:
        if s.strip(WHITE):
            dup += s in seen
            seen.add(s)
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def _histograms(t):
    """Character classes and common English words of a text, and how many there are."""
    t = t or ""
    words = [w for w in "".join("\0" if c in WHITE else c for c in t).split("\0") if w]
    classes = [sum(c in x for c in t) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:?!", "#*$%&|<>")]
    inside = sum(map(len, words))
    found = [sum(w.lower() == x for w in words) for x in quality.COMMON_WORDS["en"]]
    return [len(t) - inside, inside - sum(classes), *classes], [*found, len(words) - sum(found)]


def _distance(p, q):
    n, m = sum(p), sum(q)
    if not n or not m:
        return 0.0
    total = 0.0
    for a, b in zip(p, q):
        x, y = a / n, b / m
        total += (x * np.log2(2 * x / (x + y)) if x else 0) + (y * np.log2(2 * y / (x + y)) if y else 0)
    return max(0.0, total / 2) ** 0.5


def brute_distances(rows):
    """Distances of every English text to the references, which are taken twice."""
    hists, base = [_histograms(t) for _, t in rows], []
    for _, t in rows:
        c = _counts(t)
        base.append(c[0] >= 50 and 100 * c[4] <= 50 * c[0])
    chosen, out = list(base), []
    for _ in range(2):
        refs = [[sum(h[k][i] * 1_000_000 // max(1, sum(h[k])) for h, ok in zip(hists, chosen) if ok) for i in range(n)] for k, n in ((0, 5), (1, 13))]
        out = [tuple(_distance(h[k], refs[k]) for k in (0, 1)) for h in hists]
        chosen = [ok and not (len(t or "") >= 200 and d[0] > 0.15 or _counts(t)[0] >= 200 and d[1] > 0.45) for ok, d, (_, t) in zip(base, out, rows)]
    return out


def test_quality(spark):
    rng = random.Random(1)
    clean = [" ".join(rng.choice(["the", "of", "and", "harbour", "stone%d" % rng.randint(0, 400), "river", "it", "was", "Green."]) for _ in range(rng.randint(60, 300))) for _ in range(60)]
    junk = [" ".join("%s%s" % (rng.choice("abcdefg") * 3 + str(rng.randint(0, 500)), rng.choice(["###", "$$$", "|"])) for _ in range(200)) for _ in range(6)]
    short = ["a b c", "a b c a b c a b c", "dup line\nother\ndup line\n \n \n", "x y z x y z q"]
    texts = list(enumerate(clean + junk + short + odd_texts(40, 4, 400)))
    rows = texts + [(0, texts[0][1]), (None, clean[1]), (None, None)]
    out = quality.judge_quality(docs(spark, rows), carry=("kept", "source")).collect()
    assert len(out) == len(rows) and out[0].carried_kept == "x" and out[0].source == "s" and sum(r.doc_id is None for r in out) == 2
    got = {r.doc_id: r for r in out}
    want = brute_distances(rows)
    for (i, t), (classes, words) in zip(rows, want):
        counts = _counts(t)
        for r in [x for x in out if x.doc_id == i and (i is not None or x.n_words == counts[0])]:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, t
            assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
            assert (r.class_distance, r.word_distance) == pytest.approx((classes, words), abs=1e-6)
            strange = len(t or "") >= 200 and classes > 0.15 or counts[0] >= 200 and words > 0.45
            assert r.kept == (not r.base_failed and not strange)
    for i in range(len(clean)):
        assert got[i].kept == (not got[i].base_failed)
    assert not any(got[i].kept for i in range(len(clean), len(clean) + len(junk)))
    assert quality.judge_quality(docs(spark, [])).count() == 0
    other = docs(spark, [(1, clean[0])], None)
    assert quality.judge_quality(other).first().class_distance == 0


def expression(rng, depth=0):
    """(text, identifiers, freedom) of a random expression, by recursion."""
    if depth > 3 or rng.random() < 0.4:
        name = rng.choice(["MIT", "GPL-2.0-only", "Apache-2.0", "CC-BY-NC-4.0", "LGPL-2.1+", "LicenseRef-x.1"])
        free = licenses.FREEDOM.get(name.lower().rstrip("+"), licenses.UNKNOWN)
        if rng.random() < 0.2:
            return f"{name} WITH Some-exception", [name.lower()], free + (1 - free) / 2
        return name, [name.lower()], free
    op = rng.choice(["or", "and"])
    (a, one, x), (b, two, y) = expression(rng, depth + 1), expression(rng, depth + 1)
    return f"({a}) {op} ( {b})", one + two, max(x, y) if op == "or" else min(x, y)


def test_licenses(spark):
    rng, made = random.Random(3), {}
    fixed = [None, "", "CC BY cc-by", "GNU General Public License, all rights\nreserved", "xcc by", "cc byé", "all rights reserved all rights reserved", "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nmore", "SPDX-License-Identifier: OR", "general  public--license" * 2, "SPDX-License-Identifier: see the file", "license-expression: mit or spdx-license-identifier: isc"]
    phrases = [*licenses.BASE_PHRASES, *licenses.NOTICE_PHRASES]
    mixed = [" ".join(rng.choice([rng.choice(phrases), "the", "public", "license", "cc", "by", "MIT.", "x"]) for _ in range(rng.randint(1, 14))) for _ in range(80)]
    texts = list(enumerate(fixed + mixed + odd_texts(50, 8)))
    for i in range(500, 560):
        text, names, free = expression(rng)
        made[i] = (set(names), free)
        texts.append((i, f"// SPDX-License-Identifier:\t{text}\nmore"))
    texts += [(7, texts[7][1]), (None, "mit license"), (None, None)]
    got = licenses.scan_licenses(docs(spark, texts)).collect()
    assert len(got) == len(texts) and [r.labels for r in got if r.doc is None] == ["mit", ""] and sum(r.doc == 7 for r in got) == 2
    got = {r.doc: r for r in got}
    import re

    for i, t in texts:
        if i is None:
            continue
        low = (t or "").encode().lower().decode()
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        found = lambda table: [(k, label) for p, label in table.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        hits, more, r = found(licenses.BASE_PHRASES), found(licenses.NOTICE_PHRASES), got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None)
        assert r.base_labels == ",".join(sorted({x for _, x in hits}))
        if i in made:  # words of an expression may be phrases too
            assert set(r.labels.split(",")) >= made[i][0] and (more or r.score == pytest.approx(made[i][1]))
        elif ":" not in low:
            labels = {x for _, x in hits + more}
            assert r.labels == ",".join(sorted(labels)) and r.score == min((licenses.FREEDOM[x] for x in labels), default=0)
            assert sorted((s.word, s.label) for s in r.spans) == sorted((k, x) for k, x in {(k, p): (k, x) for table in (licenses.BASE_PHRASES, licenses.NOTICE_PHRASES) for p, x in table.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()}.values())
    assert got[7].labels == "apache-2.0,gpl-2.0-only,mit" and got[7].score == 0.9
    assert got[10].labels == "" and got[10].score == 0 and got[6].score == licenses.FREEDOM["reserved"] > 0 and got[11].labels == "isc,mit"
    assert licenses.parse_expression("gpl-2.0-only with classpath-exception-2.0 or (mit and isc)") == (["gpl-2.0-only", "mit", "isc"], 0.95)
    assert licenses.parse_expression("gpl-2.0-only with x") == (["gpl-2.0-only"], 0.75) and licenses.parse_expression(")") is None
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


@pytest.mark.parametrize("part", ["SPDX-License-Identifier: ", "SPDX-License-Identifier: mit or ", "license-expression: (", "cc by ", "license-expression: mit with "])
def test_license_time_is_linear(part):
    import time

    scan = licenses.Scanner(licenses.BASE_PHRASES, licenses.NOTICE_PHRASES)
    began = time.process_time()
    scan(part * (2_000_000 // len(part)))
    assert time.process_time() - began < 5


def test_simhash(spark):
    rng = random.Random(2)
    words = ["w%d" % k for k in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)]
    texts = list(enumerate(base + [b.replace("w1 ", "W1 ") for b in base[:5]] + [b + " tail" for b in base[:20]] + [None, "", " \t", "one", "one two", "x " * 4000]))
    texts += [(7, base[7]), (None, base[0])]
    got = simhash.simhash_components(docs(spark, texts)).collect()
    import xxhash

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fingerprint(t)) for i, t in texts]
    assert sorted((r.doc is None, r.doc or 0, r.fingerprint) for r in got) == sorted((i is None, i or 0, "%016x" % f) for i, f in prints)
    known = [(i, f) for i, f in prints if i is not None]
    label = {i: i for i, _ in known}
    for _ in range(len(known)):
        for i, f in known:
            label[i] = min([label[i]] + [label[j] for j, g in known if bin(f ^ g).count("1") <= 4])
    assert all(r.component == (None if r.doc is None else label[r.doc]) for r in got)
    rows = [(3, base[0]), (3, base[1]), (4, base[0]), (9, base[1]), (2, base[1]), (7, base[2]), (8, base[3]), (8, base[2]), (5, base[3]), (6, base[4])]
    assert sorted({(r.doc, r.component) for r in simhash.simhash_components(docs(spark, rows)).collect()}) == [(2, 2), (3, 2), (4, 2), (5, 5), (6, 6), (7, 5), (8, 5), (9, 2)]
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_vantage_search_is_exact():
    rng = np.random.default_rng(4)
    centre = rng.integers(0, 2**63, 40).astype(np.uint64)
    f = np.concatenate([centre] + [centre ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)] + [rng.integers(0, 2**63, 2000).astype(np.uint64)])
    f = np.unique(f)[:, None]
    forest = simhash._Forest(len(f))
    simhash._compare(f, np.arange(len(f)), np.arange(len(f)), 4, forest)
    mine = simhash._Forest(len(f))
    simhash._join(f, np.arange(len(f)), np.arange(len(f)), 4, mine, True)
    groups = lambda x: {tuple(np.flatnonzero(x.label == v)) for v in np.unique(x.label)}
    assert groups(forest) == groups(mine)


def test_large_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_SHARD", 50)
    f = np.unique(np.random.default_rng(6).integers(0, 2**10, 400))
    classes = spark.createDataFrame([(i, int(v)) for i, v in enumerate(f)], "rep long, f0 long")
    found = simhash.links(simhash.deal_shards(simhash.vantage_shards(classes, 4, len(f)), 1), 4, 1)
    assert components(found.select("a", "b")).select("component").distinct().count() == 1


def test_sampled_groups(spark):
    rng = random.Random(8)
    words = ["w%d" % k for k in range(5000)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(60)]
    near = [list(b) for b in base]
    for b in near:
        for _ in range(4):
            b[rng.randrange(400)] = "new"
    texts = list(enumerate([" ".join(b) for b in base] + [" ".join(b) for b in near]))
    got = {r.doc: r.component for r in simhash.simhash_groups(docs(spark, texts)).collect()}
    assert sum(got[i] == got[i + 60] for i in range(60)) >= 54 and len({got[i] for i in range(60)}) == 60


def shingle_components(texts):
    """Smallest ids reachable over pairs of sets of five-word shingles with a Jaccard similarity of 0.8 or more."""
    sets, label = {}, {}
    for i, t in texts:
        w = (t or "").lower().split()
        sets[i], label[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set(), i
    near = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]))]
    for _ in range(len(label)):
        before = dict(label)
        for i, j in near:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label
    return label


def test_groups_follow_the_shingles(spark):
    """A dense group whose pairs lie around the threshold, more of them to a row than one round compares."""
    rng = random.Random(5)
    base = ["w%d" % rng.randrange(5000) for _ in range(300)]
    texts = []
    for i in range(150):
        own = list(base)
        for k in rng.sample(range(300), 3 + i % 3):
            own[k] = "x%d" % rng.randrange(10**6)
        texts.append((i, " ".join(own)))
    texts += [(500, None), (501, ""), (502, "one"), (503, "One"), (504, " ".join(base)), (504, " ".join(base))]
    got = [(r.doc, r.component) for r in simhash.simhash_groups(docs(spark, texts + [(None, texts[0][1])])).collect()]
    want = shingle_components(texts)
    assert len(got) == len(texts) + 1 and (None, None) in got
    assert all(want[i] == c for i, c in got if i is not None)
    assert simhash.simhash_groups(docs(spark, [])).count() == 0


def around_the_threshold(pairs, seed):
    """Pairs of texts of 20 to 400 words whose sets of shingles have a similarity of about 0.75 to 0.9."""
    rng, texts = random.Random(seed), []
    for k in range(pairs):
        n = (20, 30, 45, 100, 200, 400)[k % 6]
        one = ["w%d" % rng.randrange(5000) for _ in range(n)]
        two = one + ["y%d" % rng.randrange(10**6) for _ in range(round((n - 4) * rng.uniform(0.1, 0.33)))]
        texts += [(2 * k, " ".join(one)), (2 * k + 1, " ".join(two))]
    return texts


def test_groups_miss_no_pair(spark, monkeypatch):
    """Short and long texts just above and below the threshold, and shingles so frequent that their rows are dealt to chunks."""
    texts = around_the_threshold(240, 3)
    common = " ".join("c%d" % k for k in range(40))
    texts += [(1000 + i, common + " " + " ".join("z%d" % (100 * i + k) for k in range(4 + i % 12))) for i in range(60)]
    want = shingle_components(texts)
    for chunk, bucket in ((20_000, 16), (25, 2)):
        monkeypatch.setattr(simhash, "LARGE_SHARD", chunk)
        monkeypatch.setattr(simhash, "SMALL_BUCKET", bucket)
        monkeypatch.setattr(simhash, "LED", 2 * bucket)
        assert {r.doc: r.component for r in simhash.simhash_groups(docs(spark, texts)).collect()} == want


def test_sketches_lose_no_pair():
    """Pairs of 0.8 and more pass the parities and the SimHash bound, most unrelated ones do not."""
    rng = np.random.default_rng(12)
    kept = total = 0
    for n in (30, 200, 210, 1000, 5000):
        for _ in range(20):
            common = rng.integers(0, 2**63, n).astype(np.uint64)
            a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, n // 8).astype(np.uint64)])) for _ in range(2))
            c = rng.integers(0, 2**63, len(a)).astype(np.uint64)
            p = simhash._parities([a, b, c], simhash.PARITIES).view(np.uint64)
            f = np.stack([simhash.majority_bits(simhash._mix(np.concatenate([a, b, c]), k), np.array([len(a), len(b), len(c)])) for k in range(8)], axis=1)
            apart = lambda x, y, w: int(np.bitwise_count(w[x] ^ w[y]).sum())
            assert apart(0, 1, p) <= (len(a) + len(b)) / 9 and apart(0, 1, f) <= simhash._far_bits(0.8, 8)
            total += 1
            kept += apart(0, 2, p) <= (len(a) + len(c)) / 9 and (2 * n < simhash.MANY_SHINGLES or apart(0, 2, f) <= simhash._far_bits(0.8, 8))
    assert kept <= 0.05 * total


def test_doubtful_pairs_come_in_rounds():
    """Every pair between trees comes up once over the rounds, a bounded number of a row in each."""
    f = np.unique(np.random.default_rng(9).integers(0, 2**63, (300, 8)).astype(np.uint64), axis=0)
    every, pairs, first, most = np.arange(len(f)), [], 0, simhash.ROUND_PARTNERS
    forest = simhash._Forest(len(f))
    while True:
        doubts = simhash._Doubts(forest, every, first, most)
        simhash._join(f, every, every, 512, doubts, True)
        assert max(np.bincount([i for i, _ in doubts.links])) <= most
        pairs += doubts.links
        first, most = first + most, most * simhash.ROUND_GROWTH
        if not doubts.more:
            break
    assert len(pairs) == len(set(pairs)) and {tuple(sorted(p)) for p in pairs} == {(i, j) for i in range(len(f)) for j in range(i + 1, len(f))}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 100)] + [(rng.randrange(5000, 5300), rng.randrange(5000, 5300)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(400):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/ü\r\nX: y", "same"), (2, "b", "same"), (3, "c", "other é"), (4, None, None), (5, "e", ""), (6, "f", "big " * 50000), (6, "f", "big " * 50000), (None, "g", "same")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    path, files = warc.write_archives(pages, path=f"file://{tmp_path}/w", file_bytes=200)
    got = warc.read_archives(files, path, with_payload=True).collect()
    assert len(got) == len(rows) and files.agg(F.sum("records")).first()[0] == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.id, []).append((r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)))
    sha = lambda s: base64.b32encode(hashlib.sha1((s or "").encode()).digest()).decode()
    assert by[2] == [(4, sha("same"), "response", None, b"same")] and by[1] == [(4, sha("same"), "revisit", 2, b"")] and by[None][0][3] == 2
    assert by[4][0][:4] == (0, sha(""), "revisit", 5) and by[5][0][2] == "response" and [x[2] for x in by[6]] == ["response"] * 2
    _, files = warc.write_archives(pages, min_bytes=5, path=f"file://{tmp_path}/m")
    assert {r.record_type for r in warc.read_archives(files, f"file://{tmp_path}/m").collect() if r.id != 6} == {"response"}
    _, files = warc.write_archives(pages.limit(0))
    assert files.count() == 0


def test_warc_reader_finds_damage():
    body = b"x" * 1000
    good = warc.record("response", "u", {"WARC-Block-Digest": f"sha1:{warc.digest(body)}"}, body) * 3
    assert [b for _, b in warc.read_records(io.BytesIO(good))] == [body] * 3
    assert gzip.decompress(good).count(b"WARC/1.1") == 3
    wrong = [good[:-10], good + b"junk", warc.record("response", "u", {"WARC-Block-Digest": "sha1:AAAA"}, body), gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"no header\r\n\r\n")]
    for data in wrong:
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(data)))
