"""URL filters: rules for hosts and paths, then a list of canonical URLs of any size.

A blocked Bloom filter of the listed URLs is built by Spark and broadcast; its size is bounded, whatever
the length of the list. URLs that may be listed go on to an exact hash join, which removes the false
positives.

Edge cases: a null url, or one without `://`, has an empty host and path, fits no rule and is never listed; repeated
URLs are judged each; an empty list blocks nothing; other columns of the input are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from freshness.llm.bloom import MAX_BLOCKS, bloom_table, may_contain


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    def __str__(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """`org/`, `example.org/en/1`: host, then path from the first slash."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without `www.` and `m.`, path without a final slash or `.html`, other query parameters than tracking ones in order; null without a host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))
    bare = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.html?$", "")
    site = F.regexp_replace(host, r"^(www|m)\.", "")
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.sort_array(kept), "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(site, bare, tail))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Index of the longest rule that fits, null if none: same host or a subdomain, and a path that starts with the rule's."""
    out = None
    for i, r in sorted(enumerate(rules), key=lambda x: -len(str(x[1]))):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = (F if out is None else out).when(fits, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def maybe_listed(shared):
    """A column function of the 64-bit hash: false only for keys that are not in the filter."""
    return F.arrow_udf(lambda hashes: pa.array(may_contain(shared.value, hashes.to_numpy(zero_copy_only=False))), "boolean")


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame, url_col: str = "url", listed_col: str = "url",
               max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """`pages` plus host, path, rule and verdict.

    A fitting rule decides. Otherwise a url whose canonical form is that of a listed one is
    blocked, and any other is allowed. Pages that a rule decides or the filter clears are not shuffled. The
    list has one row per canonical url, so a url that a third of all pages share is only on the side of
    the join that adaptive execution can split.
    """
    spark = pages.sparkSession
    urls = F.col(listed_col)
    names = listed.select(canonical(urls, host_of(urls), path_of(urls)).alias("__canonical")).where("__canonical is not null").distinct()
    hashes = names.select(F.xxhash64("__canonical").alias("hash"))
    table = bloom_table(hashes, "hash", hashes.count(), max_blocks)
    shared = spark.sparkContext.broadcast(table)
    url = F.col(url_col)
    parsed = pages.withColumns({"host": host_of(url), "path": path_of(url)})
    index = fitting_rule(F.col("host"), F.col("path"), rules)
    texts = F.array(*[F.lit(str(r)) for r in rules]) if rules else F.array().cast("array<string>")
    verdicts = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    parsed = parsed.withColumn("__index", index).withColumns({
        "rule": F.when(F.col("__index").isNotNull(), texts[F.col("__index")]),
        "verdict": F.when(F.col("__index").isNotNull(), verdicts[F.col("__index")]),
        "__canonical": F.when(F.col("__index").isNull(), canonical(url, F.col("host"), F.col("path"))),
    }).drop("__index")
    open_ = F.col("__canonical").isNotNull()
    hit = open_ & maybe_listed(shared)(F.coalesce(F.xxhash64("__canonical"), F.lit(0).cast("long")))
    marked = parsed.withColumn("__maybe", hit)
    clear = marked.where("not __maybe").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    found = marked.where("__maybe").join(names.withColumn("__listed", F.lit(True)), "__canonical", "left")
    found = found.withColumn("verdict", F.when(F.col("__listed"), F.lit("block")).otherwise(F.lit("allow"))).drop("__listed")
    return clear.unionByName(found).drop("__canonical", "__maybe")
