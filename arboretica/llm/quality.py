"""Quality rules: repetition counts, and Jensen-Shannon distances to language references (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import carried, keep

# For each language, frequent words whose shares are compared.
COMMON_WORDS = {
    "de": ["der", "die", "und", "des", "den", "das", "ist", "ein", "zu", "nicht", "von", "mit"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
# The character classes beside white space and the rest (lower-case letters, digits and other code points).
CLASSES = {"upper": "A-Z", "stop": ".,;:?!", "symbol": "#*$%&|<>"}
_SPACE = r"[ \t\n\x0B\f\r]"


def _count(col: str, chars: str) -> Column:
    return F.length(F.regexp_replace(col, f"[^{chars}]+", "")).cast("long")


def _jsd(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of two histograms, array columns of equal length; 0 where either is empty."""
    n, m = (f"aggregate({x}, 0D, (s, y) -> s + y)" for x in (p, q))
    shares = f"zip_with({p}, {q}, (a, b) -> struct(a / {n} AS x, b / {m} AS y))"
    part = lambda u, v: f"if(z.{u} > 0, z.{u} * log2(2 * z.{u} / (z.{u} + z.{v})), 0D)"
    total = f"aggregate({shares}, 0D, (s, z) -> s + {part('x', 'y')} + {part('y', 'x')})"
    return F.expr(f"if({n} > 0 and {m} > 0, sqrt(greatest({total} / 2, 0D)), 0D)")


def text_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The columns of ``docs`` and the counts of each text, in one pass without a shuffle.

    Repeated three-word windows are found inside the row: the low bits of each window's hash are replaced by its place, the
    longs are sorted, and neighbours with equal high bits are compared word by word. That is n log n in the words of a
    document whatever they repeat; a window is missed only if another's hash agrees in all high bits and falls between.
    """
    first = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    split = first.select("*", F.expr(rf"array_remove(split(__t, r'{_SPACE}+'), '')").alias("__w"), F.expr(rf"filter(split(__t, '\n'), l -> l rlike r'[^ \t\n\x0B\f\r]')").alias("__l"))
    counted = split.select(
        "*",
        F.size("__w").alias("__n"),
        F.expr("cast(ceil(log2(size(__w) + 2)) as int)").alias("__b"),
    )
    hashed = counted.select(
        *[c for c in counted.columns if c not in ("__l",)],
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length("__t").cast("long").alias("__chars"),
        *[_count("__t", c).alias(f"__c_{k}") for k, c in CLASSES.items()],
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.expr("""if(__n < 4, cast(array() as array<bigint>), sort_array(transform(sequence(0, __n - 3),
            i -> shiftleft(xxhash64(__w[i], __w[i + 1], __w[i + 2]), __b) | cast(i as bigint))))""").alias("__s"),
    )
    marked = hashed.select(
        *[c for c in hashed.columns if c != "__s"],
        F.expr("""if(size(__s) = 0, cast(array() as array<bigint>), flatten(transform(__s, (x, j) ->
            if(j > 0 and shiftrightunsigned(x, __b) = shiftrightunsigned(__s[greatest(j, 1) - 1], __b),
               array(x & (shiftleft(1L, __b) - 1), __s[greatest(j, 1) - 1] & (shiftleft(1L, __b) - 1)), cast(array() as array<bigint>)))))""").alias("__m"),
    )
    # pairs (place, place of the neighbour) whose words agree
    sure = marked.select(
        *[c for c in marked.columns if c != "__m"],
        F.expr("""sort_array(array_distinct(if(size(__m) = 0, __m, filter(__m, (x, k) -> __w[int(x)] = __w[int(__m[k ^ 1])]
            and __w[int(x) + 1] = __w[int(__m[k ^ 1]) + 1] and __w[int(x) + 2] = __w[int(__m[k ^ 1]) + 2]))))""").alias("__p"),
    )
    langs = F.array(*[F.lit(x) for x in COMMON_WORDS])
    last = sure.select(
        *[c for c in sure.columns if c != "__p"],
        F.expr("aggregate(__p, struct(-9L as a, 0L as n), (s, x) -> struct(x as a, s.n + least(3L, x - s.a) as n), s -> s.n)").alias("n_repeat_words"),
        F.expr("CASE " + " ".join(f"WHEN {lang_col} = '{lang}' THEN filter(__w, x -> lower(x) IN ({', '.join(repr(w) for w in words)}))" for lang, words in COMMON_WORDS.items()) + " ELSE cast(array() as array<string>) END").alias("__k"),
        F.when(F.array_contains(langs, F.col(lang_col)), F.col(lang_col)).alias("__lang"),
    )
    lists = "CASE __lang " + " ".join(f"WHEN '{lang}' THEN array({', '.join(map(repr, words))})" for lang, words in COMMON_WORDS.items()) + " END"
    return last.select(
        *docs.columns,
        F.col("__n").cast("long").alias("n_words"),
        "word_chars",
        F.col("__c_symbol").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        "__lang",
        F.array(
            F.col("__chars") - F.col("word_chars"),
            F.col("word_chars") - sum((F.col(f"__c_{k}") for k in CLASSES), F.lit(0)),
            *[F.col(f"__c_{k}") for k in CLASSES],
        ).alias("__classes"),
        F.expr(f"transform({lists}, w -> cast(size(filter(__k, x -> lower(x) = w)) as bigint))").alias("__found"),
    ).withColumn("__found", F.concat("__found", F.array(F.col("n_words") - F.expr("aggregate(__found, 0L, (s, x) -> s + x)"))))


def judge_quality(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    class_distance: float = 0.15,
    min_class_chars: int = 200,
    word_distance: float = 0.45,
    min_word_count: int = 200,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Judge every document; one row each: ``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance, kept)``.

    base_failed: fewer than ``min_words`` words, or more than ``max_repeat_percent`` percent of the words in three-word
    windows that repeat. Otherwise the document's histogram of character classes, and that of its common words and all
    others, are compared with its language's: mean shares over all documents of the language that pass the base rules, taken
    twice, the second time without the documents that the first references reject. It is rejected if a Jensen-Shannon distance exceeds its
    limit and the text has at least ``min_class_chars`` characters or ``min_word_count`` words. A language without a list
    of common words (or null) has no reference, so the base rules alone decide. Null and empty texts have no words and
    fail. Ties, repeated rows and null ids are judged row by row; other columns are not read but for those named in ``carry``,
    which follow in the result, as ``carried_<name>`` where the result has such a name itself.

    One pass counts, its narrow result is written to the shared folder, and a sum per language (a few rows: the lists above
    bound them) is broadcast back; there is no shuffle of rows.
    """
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__l0"), *[F.col(c).alias(f"__carried_{c}") for c in carry])
    counts = text_counts(source, "__text", "__l0").drop("__text", "__l0")
    counts = keep(counts.withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    ), "quality")
    sizes = {"__classes": len(CLASSES) + 2, "__found": max(map(len, COMMON_WORDS.values())) + 1}

    def references(rows: DataFrame) -> DataFrame:
        # shares in millionths, as integers: the sums do not depend on the order of the rows
        share = lambda c, i: F.coalesce(F.sum(F.expr(f"{c}[{i}] * 1000000 div greatest(aggregate({c}, 0L, (s, x) -> s + x), 1L)")), F.lit(0))
        return rows.groupBy("__lang").agg(*[F.array(*[share(c, i) for i in range(n)]).alias(f"__ref{c}") for c, n in sizes.items()])

    def judged(by: DataFrame) -> DataFrame:
        return counts.join(F.broadcast(by), "__lang", "left").select(
            *counts.columns,
            *[F.coalesce(_jsd(c, f"__ref{c}"), F.lit(0.0)).alias(name) for c, name in (("__classes", "class_distance"), ("__found", "word_distance"))],
            F.expr("aggregate(__classes, 0L, (s, x) -> s + x)").alias("__all"),
        )

    good = ~F.col("base_failed") & F.col("__lang").isNotNull()
    strange = ((F.col("__all") >= min_class_chars) & (F.col("class_distance") > class_distance)) | (
        (F.col("n_words") >= min_word_count) & (F.col("word_distance") > word_distance)
    )
    # the first references hold what they are to reject; the second are of the documents near the first
    near = judged(references(counts.where(good))).where(good & ~strange).select(*counts.columns)
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance"]
    return judged(references(near)).select(
        F.col("__id").alias(id_col), *own, (~F.col("base_failed") & ~strange).alias("kept"),
        *[F.col(f"__carried_{c}").alias(carried(c, [id_col, *own, "kept"])) for c in carry],
    )
