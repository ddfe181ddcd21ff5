"""License scans: an Aho-Corasick automaton finds tags and notice phrases; a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The base phrases (words as the scan sees them) and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Phrases and labels of the method's own.
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "isc license": "isc",
    "no commercial use": "noncommercial",
    "proprietary and confidential": "proprietary",
}

# How freely a work under a label may be used, 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "cc0-1.0": 1.0, "unlicense": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsd-2-clause": 0.95, "bsd-3-clause": 0.95,
    "apache": 0.9, "apache-2.0": 0.9, "zlib": 0.95, "cc-by": 0.85, "cc-by-4.0": 0.85, "mpl": 0.7, "mpl-2.0": 0.7, "epl": 0.65, "epl-2.0": 0.65,
    "lgpl": 0.6, "lgpl-2.1-only": 0.6, "lgpl-2.1-or-later": 0.6, "lgpl-3.0-only": 0.6, "cc-by-sa": 0.6, "cc-by-sa-4.0": 0.6,
    "gpl": 0.5, "gpl-2.0-only": 0.5, "gpl-2.0-or-later": 0.5, "gpl-3.0-only": 0.5, "gpl-3.0-or-later": 0.5, "agpl": 0.4, "agpl-3.0-only": 0.4,
    "cc-by-nd": 0.3, "cc-by-nc": 0.25, "cc-by-nc-4.0": 0.25, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.15, "noncommercial": 0.2, "reserved": 0.05, "proprietary": 0.05,
    "0bsd": 1.0, "afl-3.0": 0.9, "apache-1.1": 0.9, "artistic-2.0": 0.8, "blueoak-1.0.0": 0.95, "bsd-4-clause": 0.9, "bsl-1.0": 0.95, "cc-by-3.0": 0.85, "cc-by-nc-nd-4.0": 0.15,
    "cc-by-nc-sa-4.0": 0.2, "cc-by-nd-4.0": 0.3, "cc-by-sa-3.0": 0.6, "cddl-1.0": 0.65, "cddl-1.1": 0.65, "cecill-2.1": 0.5, "cpl-1.0": 0.65, "ecl-2.0": 0.9, "epl-1.0": 0.65,
    "eupl-1.1": 0.55, "eupl-1.2": 0.55, "gfdl-1.3": 0.45, "gpl-1.0": 0.5, "gpl-2.0": 0.5, "gpl-3.0": 0.5, "hpnd": 0.95, "ipl-1.0": 0.65, "lgpl-2.0": 0.6, "lgpl-2.1": 0.6, "lgpl-3.0": 0.6,
    "lgpl-3.0-or-later": 0.6, "agpl-3.0": 0.4, "agpl-3.0-or-later": 0.4, "mit-0": 1.0, "mpl-1.1": 0.7, "ms-pl": 0.8, "ncsa": 0.95, "ofl-1.1": 0.8, "openssl": 0.85, "osl-3.0": 0.5,
    "php-3.01": 0.9, "postgresql": 0.95, "psf-2.0": 0.95, "python-2.0": 0.95, "ruby": 0.8, "sspl-1.0": 0.2, "unicode-3.0": 0.95, "upl-1.0": 0.95, "vim": 0.8, "w3c": 0.95, "wtfpl": 1.0, "x11": 0.95,
}
#: How free a licence counts that an expression names by its own reference (licenseref-...).
UNKNOWN = 0.1
TAGS = ("spdx-license-identifier:", "license-expression:")

#: What separates words: every ASCII character but letters and digits; A-Z become a-z.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:_-]*")
_POWER = {"or": 1, "and": 2, "with": 3}


def known(name: str) -> bool:
    """Whether a word is a licence's identifier: one of FREEDOM, an older one with ``+``, or an own reference."""
    return name.rstrip("+") in FREEDOM or name.startswith(("licenseref-", "documentref-"))


def parse_expression(text: str, position: int = 0, end: int | None = None) -> tuple[list[str], float] | None:
    """(identifiers, freedom) of an SPDX-like expression by the shunting-yard algorithm, or None if it starts with none.

    ``or`` lets one choose (the freer side), ``and`` binds (the stricter side), ``with`` adds an exception to a licence
    (half way to free). Operators rank with > and > or; parsing ends at ``end`` and at the first token that cannot follow, as
    a word that is no identifier where a licence should stand. Linear in the expression.
    """
    out: list[float] = []
    stack: list[str] = []
    names: list[str] = []

    def apply() -> None:
        op, b, a = stack.pop(), out.pop(), out.pop()
        out.append(max(a, b) if op == "or" else min(a, b) if op == "and" else a + (1 - a) / 2 if a > 0 else 0.0)

    want, nested, end = True, 0, len(text) if end is None else end
    while (m := _TOKEN.match(text, position, end)) is not None:
        token = m.group()
        if token == "(":
            if not want:
                break
            stack.append(token)
            nested += 1
        elif token == ")":
            if want or not nested:
                break
            while stack[-1] != "(":
                apply()
            stack.pop()
            nested -= 1
        elif token in _POWER:
            if want:
                break
            while stack and stack[-1] != "(" and _POWER[stack[-1]] >= _POWER[token]:
                apply()
            stack.append(token)
            want = True
        else:
            if not want:
                break
            name = token.rstrip(".:-")
            if not (stack and stack[-1] == "with"):
                if not known(name):
                    break
                names.append(name)
            out.append(FREEDOM.get(name.rstrip("+"), UNKNOWN))
            want = False
        position = m.end()
        while position < end and text[position] in " \t":
            position += 1
    if want and stack and stack[-1] in _POWER:
        stack.pop()  # an operator at the end has no right side
    while stack:
        if stack[-1] == "(":
            stack.pop()
        elif len(out) > 1:
            apply()
        else:
            stack.pop()
    return (names, out[-1]) if names else None


class Scanner:
    """Finds phrases and tags in a text with one automaton."""

    def __init__(self, base: dict[str, str], more: dict[str, str]):
        import ahocorasick

        self.words, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in base.items():
            self.words.add_word(f" {phrase} ", (len(phrase), label, label if more.get(phrase) is None else more[phrase], True))
        for phrase, label in more.items():
            if phrase not in base:
                self.words.add_word(f" {phrase} ", (len(phrase), None, label, False))
        for tag in TAGS:
            self.tags.add_word(tag, tag)
        self.words.make_automaton()
        self.tags.make_automaton()

    def __call__(self, text: str | None) -> tuple:
        raw = (text or "").encode().translate(_TABLE)
        words = raw.split(b" ") if raw else []
        words = list(filter(None, words))
        joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
        n_base, first, last, base, labels, spans, scores = 0, None, None, set(), set(), [], []
        at, word = 0, 0
        hits = sorted((end - size, size, base_label, label, is_base) for end, (size, base_label, label, is_base) in self.words.iter(joined))
        for start, size, base_label, label, is_base in hits:
            word += joined.count(" ", at + 1, start) if start > at else 0
            at = max(at, start - 1)
            number = word
            if is_base:
                n_base += 1
                first = number if first is None else first
                last = number
                base.add(base_label)
            labels.add(label)
            scores.append(FREEDOM.get(label, UNKNOWN))
            spans.append((number, label))
        if text and ":" in text:
            low = text.encode().lower().decode()
            tags = [(last + 1 - len(tag), last + 1) for last, tag in self.tags.iter(low)]
            for (_, begin), (until, _) in zip(tags, [*tags[1:], (len(low), 0)]):
                # an expression ends with its line, and before the next tag
                line = low.find("\n", begin, until)
                until = line if line >= 0 else until
                while begin < until and low[begin] in " \t":
                    begin += 1
                if (got := parse_expression(low, begin, until)) is not None:
                    labels.update(got[0])
                    scores.append(got[1])
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels | base)), min(scores) if scores else 0.0, spans


@functools.cache
def _scanner(base: tuple, more: tuple) -> Scanner:
    return Scanner(dict(base), dict(more))


_FIELDS = [
    ("doc", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
]


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE_PHRASES, more: dict[str, str] = NOTICE_PHRASES) -> DataFrame:
    """Rows ``(doc, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``, one for each input row.

    Words are runs of ASCII letters and digits and of all other code points from U+0080, A-Z lower-cased. ``n_base`` counts
    every place where a base phrase's words stand in a row, overlapping ones too; ``first_word`` and ``last_word`` are the
    smallest and largest word numbers of such places, else null. ``labels`` are those of the base and the other phrases and
    the identifiers of tagged expressions; ``score`` is the least freedom found, and 0 only where nothing is found. Null and
    empty texts have no words. One pass over whole texts, row by row; repeated rows and null ids stay; other columns are not read.
    """
    key = (tuple(base.items()), tuple(more.items()))
    schema = pa.schema(_FIELDS)

    def run(batches):
        scan = _scanner(*key)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = [scan(t) for t in part.column("text").to_pylist()]
                cols = list(zip(*rows))
                spans = [[{"word": w, "label": x} for w, x in own] for own in cols[7]]
                yield pa.RecordBatch.from_arrays([part.column("doc"), *(pa.array(c, f[1]) for c, f in zip([*cols[:7], spans], _FIELDS[1:]))], schema=schema)

    columns = "doc long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word: long, label: string>>"
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(run, columns)
