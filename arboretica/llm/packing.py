"""Best-fit packing by sums of squares: token counts, pieces, and their places in fixed-length sequences."""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import keep, only

#: Pieces of a packing group, in the mean. A group is one task's work: 40 bytes a piece, and the open bins.
GROUP_PIECES = 50_000
#: Words of a generation of the cache; a worker remembers two (about 150 bytes a word).
CACHE_WORDS = 700_000
#: Words that the library encodes as one line.
JOINED_WORDS = 500


# Byte classes: 1 an ASCII lower-case letter or digit, 2 a mark other than the apostrophe, 4 white space.
_BYTES = np.zeros(256, np.uint8)
_BYTES[[*range(97, 123), *range(48, 58)]] = 1
_BYTES[list(b".,;:!?#*$%&|<>()")] = 2
_BYTES[list(b" \t\n\x0b\x0c\r")] = 4


def _part_marks(raw: bytes) -> bytes:
    """A space before every mark that stands alone between an ASCII letter or digit and white space.

    Such a mark is a piece of its own, so the space changes no id, and words that differ only by it are learnt once.
    """
    kind = _BYTES[np.frombuffer(raw, np.uint8)]
    at = np.flatnonzero((kind[:-2] == 1) & (kind[1:-1] == 2) & (kind[2:] == 4)) + 1
    if not len(at):
        return raw
    out = np.empty(len(raw) + len(at), np.uint8)
    new = at + np.arange(len(at))
    keep_at = np.ones(len(out), bool)
    keep_at[new] = False
    out[new] = 32
    out[keep_at] = np.frombuffer(raw, np.uint8)
    return out.tobytes()


# The normaliser and the splitter of the files whose words stand apart.
_NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTER = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


def words_stand_apart(spec: dict) -> bool:
    """Whether a tokenizers file lower-cases and drops white space as WordEncoder's way of cutting words takes for granted."""
    normaliser, splitter = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = splitter.get("pretokenizers") or [{}]
    byte_level = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    return normaliser.get("normalizers") == _NORMALISER and steps[0] == _SPLITTER and byte_level and not spec.get("truncation") and not spec.get("padding")


class WordEncoder:
    """Ids of whole texts by a tokenizers file, as the library gives them without adding special tokens.

    Where the file lower-cases, and parts words at white space and at marks other than the apostrophe (``words_stand_apart``),
    a text is cut at ASCII white space and A-Z are lower-cased; each distinct word is encoded by the library once while it
    stays in the cache, with marks behind it as a word of their own, and a text's ids are its words' ids in order. Texts that
    hold the string of a special token, in whatever case, and all texts of other files, go to the library whole. ``__call__`` gives ids as
    little-endian unsigned 32-bit bytes.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are kept as little-endian 32-bit integers")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task is one thread; the library's own threads only spin

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.apart = words_stand_apart(spec)
        self.added = [t["content"].encode() for t in spec.get("added_tokens", ())]
        plain = [t for t in spec.get("added_tokens", ()) if not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"])]
        self.between = (plain[0]["content"].encode(), plain[0]["id"]) if plain else None
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def learn(self, words: set[bytes]) -> None:
        """Have the ids of all words in the cache. It has two generations: what has not been seen in a full one goes."""
        if len(self.cache) > self.cache_words:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        new = words.difference(cache)
        if older:
            known = [w for w in new if w in older]  # not an intersection, which would walk all of ``older``
            cache.update(zip(known, map(older.__getitem__, known)))
            new.difference_update(known)
        part = list(new)
        step = JOINED_WORDS if self.between else 1
        mark, mark_id = self.between or (b"", -1)
        for at in range(0, len(part), 40 * step):
            lines = [part[k : k + step] for k in range(at, min(len(part), at + 40 * step), step)]
            # an added token parts the words of a line for the library, which knows it before all else; words never hold it
            for words, e in zip(lines, self.tokenizer.encode_batch_fast([mark.join(x).decode() for x in lines], add_special_tokens=False)):
                raw = array("I", e.ids).tobytes()
                cuts = [-4, *(4 * np.flatnonzero(np.frombuffer(raw, "<u4") == mark_id)).tolist(), len(raw)]
                cache.update(zip(words, [raw[a + 4 : b] for a, b in zip(cuts, cuts[1:])]))

    def __call__(self, texts: list[bytes | None]) -> Iterator[bytes]:
        """In groups of about 2 MB of text, so that the words of a group fit the cache and memory stays bounded."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size < 2 << 20):
                raw = texts[at] or b""
                size += len(raw)
                at += 1
                low = raw.lower()
                if self.apart and not any(t in low for t in self.added):
                    split.append(_part_marks(low).split())
                else:
                    split.append(raw)
            self.learn(set().union(*(x for x in split if isinstance(x, list))))
            get = self.cache.__getitem__
            for words in split:
                if isinstance(words, list):
                    yield b"".join(map(get, words))
                else:
                    yield array("I", self.tokenizer.encode(words.decode(), add_special_tokens=False).ids).tobytes()


def encoder(path: str) -> WordEncoder:
    return only(("words", path), lambda: WordEncoder(path))


#: Numbers that pieces are dealt round by in the order of a task, so that repeated rows do not meet in one group.
_DEALS = 1 << 16


def _cut(path: str, length: int, end_id: int | None, with_ids: bool):
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, deal = encoder(path), 0
        for batch in batches:
            out = []
            docs = batch.column("doc").to_pylist()
            for doc, ids in zip(docs, encode(batch.column("text").cast(pa.binary()).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    deal += 1
                    out.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), deal % _DEALS, *((part,) if with_ids else ())))
                if with_ids and len(out) > 500:
                    yield _piece_batch(out, with_ids)
                    out = []
            if out:
                yield _piece_batch(out, with_ids)
        encode.older = {}  # an idle worker holds one generation
    return run


def _piece_batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = ["doc", "piece", "start", "length", "ids_crc32", "deal"]
    cols = list(zip(*rows))
    arrays = [pa.array(c, k) for c, k in zip(cols, kinds)]
    if with_ids:
        arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in cols[6]], pa.list_(pa.int32())))
        names = [*names, "ids"]
    return pa.RecordBatch.from_arrays(arrays, names)


def cut_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int | None = 1, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole documents: rows ``(doc, piece, start, length, ids_crc32, deal[, ids])``; ``deal`` is a small number
    that differs between neighbouring rows.

    The end id closes each document, so null and empty texts are one piece of that id. Documents of up to ``length`` ids
    stay whole; longer ones are cut at every ``length`` ids. Repeated rows and null ids give pieces row by row.
    """
    columns = "doc long, piece int, start long, length long, ids_crc32 long, deal int" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer_path, length, end_id, with_ids), columns)


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length by the sum-of-squares rule, longest first.

    ``N[g]`` counts the open bins with residual gap g. An item of size s goes to an open bin of gap g >= s, that after which
    the sum of N[g]^2 over the gaps 1..capacity-1 is smallest (a full bin no longer counts); among equal choices the
    smallest gap wins. A bin is opened only where no open one has room: to let the rule open bins earlier took 0.1 to 4 %
    more of them on lognormal and uniform sizes. The search for a gap is one vector operation.
    """
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    counts = np.zeros(capacity + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in order.tolist():
        s = int(lengths[i])
        # change of the sum: out of gap g: 1 - 2 N[g]; into gap g - s: 1 + 2 N[g - s], or 0 where the bin becomes full
        into = 1 + 2 * counts[: capacity - s + 1]
        into[0] = 0
        change = into - (2 * counts[s:] - 1)
        change[counts[s:] == 0] = 1 << 40
        change[capacity - s] = 1 << 40
        g = int(np.argmin(change)) if capacity > s else 0
        if capacity == s or change[g] >= 1 << 40:
            bins[i], offsets[i] = made, 0
            gap, made = capacity - s, made + 1
            number = made - 1
        else:
            number = open_bins[g + s].pop()
            counts[g + s] -= 1
            bins[i], offsets[i] = number, capacity - (g + s)
            gap = g
        if gap:
            counts[gap] += 1
            open_bins[gap].append(number)
    return bins, offsets


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        # a fixed order, so that a task that runs again gives the same places
        table = table.sort_by([(c, "ascending") for c in ("length", "doc", "piece", "start", "ids_crc32")])
        bins, offsets = pack_lengths(table["length"].to_numpy(), capacity)
        base = table["__group"][0].as_py() << 36 if table.num_rows else 0
        return table.drop_columns(["__group", "deal"]).append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets))
    return run


def pack_pieces(pieces: DataFrame, *, capacity: int = 4096, group_pieces: int = GROUP_PIECES, total: int | None = None) -> DataFrame:
    """Places of pieces: ``sequence_id`` and ``offset`` for rows ``(doc, piece, start, length, ids_crc32, deal)``.

    The pieces are dealt by hash to groups of about ``group_pieces`` and each group is packed apart; a group's few
    half-empty bins are what splitting costs, and it lets any number of tasks work. Only the narrow rows move. ``deal``,
    which must be a written value, keeps repeated rows apart; it is not returned.
    """
    total = pieces.count() if total is None else total
    groups = max(1, round(total / group_pieces))
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64("doc", "piece", "ids_crc32", "deal"), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name != "deal")
    return dealt.groupBy("__group").applyInArrow(_pack(capacity), f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int | None = 1, with_ids: bool = False) -> DataFrame:
    """Cut and pack whole documents: rows ``(doc, piece, start, length, ids_crc32[, ids], sequence_id, offset)``.

    The pieces are written to the shared folder once, so their number, which sets the number of groups, costs no second
    pass over the texts.
    """
    pieces = keep(cut_documents(docs, tokenizer_path, id_col=id_col, text_col=text_col, length=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    return pack_pieces(pieces, capacity=capacity)


def sequences(placed: DataFrame, capacity: int = 4096) -> DataFrame:
    """The packed sequences of placed pieces with their ``ids``: rows ``(sequence_id, ids)``, each of at most ``capacity`` ids."""
    rows = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
