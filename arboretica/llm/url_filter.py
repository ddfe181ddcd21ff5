"""URL filters by hashed host-suffix and path-prefix expressions (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Up to so many rules are broadcast (about 200 bytes each, so at most 20 MB); beyond it the rules are shuffled to the expressions.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]],
    *,
    more_rules: Sequence[tuple[str, str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    digest_prefix: int = 8,
) -> DataFrame:
    """Judge every URL: rows ``(id, host, path, rule, verdict)``, one for each input row.

    rules: (verdict, host, path). A rule fits its host and all subdomains where the URL's path starts with the rule's path;
    the longest rule string wins, at equal length the greater string, then ``block``. ``more_rules`` (same form) decide the
    verdict where no rule fits, and never show in ``rule``; else ``default`` holds.

    Each URL is expanded into the host suffixes of as many labels and the path prefixes of as many characters as rules have;
    the expressions are equi-joined on the first ``digest_prefix`` hex digits of their SHA-256, then the full digest is
    compared. One scan, one shuffle: the exploded rows of a page are adjacent, so the partial aggregate brings each page back
    to a single row before it moves. Null or malformed URLs have an empty host and path and match nothing; a null id stays
    null; repeated rows stay repeated; columns other than id and url are dropped, so their names cannot clash.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(f"u.{url_col}"))
    base = pages.alias("u").select(
        F.monotonically_increasing_id().alias("__row"), F.col(f"u.{id_col}").alias("__id"), host.alias("__host"), path.alias("__path")
    )
    table = [(2, v, h.lower(), p) for v, h, p in rules] + [(1, v, h.lower(), p) for v, h, p in more_rules]
    shapes = sorted({(h.count(".") + 1, len(p)) for _, _, h, p in table})
    labels = F.length("__host") - F.length(F.replace("__host", F.lit("."))) + 1
    expressions = F.array_compact(F.array(F.lit(None).cast("string"), *(
        F.when((labels >= k) & (F.length("__path") >= n), F.concat(F.substring_index("__host", ".", -k), F.substring("__path", 1, n) if n else F.lit("")))
        for k, n in shapes
    )))
    rows = spark.createDataFrame(
        [(t, v, f"{h}{p}") for t, v, h, p in table], "tier int, r_verdict string, r_rule string"
    ).select("tier", "r_verdict", "r_rule", F.sha2("r_rule", 256).alias("r_digest"))
    rows = rows.withColumn("prefix", F.substring("r_digest", 1, digest_prefix))
    rows = F.broadcast(rows) if len(table) <= BROADCAST_RULES else rows
    looked_up = (
        base.select("*", F.explode_outer(expressions).alias("__expression"))
        .withColumn("__digest", F.sha2("__expression", 256))
        .withColumn("prefix", F.substring("__digest", 1, digest_prefix))
        .join(rows, "prefix", "left")
    )
    hit = F.when(F.col("__digest") == F.col("r_digest"), F.struct("tier", F.length("r_rule").alias("n"), "r_rule", "r_verdict"))
    best = looked_up.groupBy("__row").agg(
        F.first("__id").alias("__id"), F.first("__host").alias("__host"), F.first("__path").alias("__path"), F.max(hit).alias("__best")
    )
    return best.select(
        F.col("__id").alias(id_col),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.when(F.col("__best.tier") == 2, F.col("__best.r_rule")).alias("rule"),
        F.coalesce("__best.r_verdict", F.lit(default)).alias("verdict"),
    )
