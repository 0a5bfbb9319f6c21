"""Audit of how the sources of a language differ in their words, by DataFrame operations only.

Terms are maximal runs of letters A-Z, a-z and non-ASCII characters, of which A-Z are lower-cased; they are found by
splitting at what stands between them, as a list of matches copies its text once a match. A language keeps the
terms that at least ``least`` of its documents hold. A group (a source within a language) or a whole language gives each
kept term a smoothed share p = 1 + floor(10^9 (count + 1) / (N + V)): N is its count of all kept terms, V their number.
The divergence of p from q at a term is floor((p - q)^2 / q).

Terms are exploded, once as occurrences and once as the distinct ones of their document, and counted by group and
term within each task before they are shuffled. Groups are crossed with their language's kept terms, so that absent terms
count as zero; that table is joined to itself by language and term and summed (pairs of sources), or compared with the
language's shares (terms), and ranked. Kept terms, in the order of their bytes, and groups have numbers, so that these
tables hold and compare no strings.

Joins by language alone would put a language in one task; there the smaller side is repeated ``SALTS`` times and the terms
of a language are dealt to as many keys. The table of shares has groups x terms rows, and the pairs of sources within a
language are as many as the result has, times its terms; both are what the audit asks for.

Null texts, languages and sources count as the empty string. Each row is a document, repeated ones too. A language without
kept terms has pairs of value 0 and no term rows. Ties rank by the item's bytes. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved

#: What stands between two terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST, RANKS, SALTS = 3, 200, 64


def terms(text: Column) -> Column:
    """All terms of a text, in order, and empty strings at its ends; the matches are what their complement splits."""
    return F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN)


def counted(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have one."""
    key = [_key(lang).alias("lang"), _key(source).alias("source")]
    found = docs.select(*key, terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    found = found.select("lang", "source", F.posexplode(F.array("terms", F.array_distinct("terms"))).alias("kind", "terms"))
    found = found.select("lang", "source", "kind", F.explode("terms").alias("term")).filter("term <> ''")
    return found.groupBy("lang", "source", "term").agg(F.count_if(F.col("kind") == 0).alias("n"), F.count_if(F.col("kind") == 1).alias("docs"))


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _repeated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(item: str) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(SALTS)).cast("int").alias("salt")


def _share(n: str, total: str) -> Column:
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10, 0)) * CAST({n} + 1 AS DECIMAL(20, 0))) div CAST({total} + v AS DECIMAL(20, 0))")


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def shares(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, kept, shares): g, lang, source, v of each group; t, lang, term of each kept term, numbered in the order of
    its bytes; and t, g, n, p and the language's q of each group and kept term."""
    counts = saved(counted(docs, text, lang, source))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs")
    kept = saved(kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("t", F.monotonically_increasing_id()))
    groups = docs.select(_key(lang).alias("lang"), _key(source).alias("source")).distinct()
    numbers = saved(groups.withColumn("g", F.monotonically_increasing_id()))
    own = saved(counts.join(kept.select("lang", "term", "t"), ["lang", "term"]).join(numbers, ["lang", "source"]).select("t", "g", "n"))
    of_lang = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("v"))
    groups = numbers.join(own.groupBy("g").agg(F.sum("n").alias("total")), "g", "left").join(of_lang, "lang", "left").na.fill(0, ["total", "lang_total", "v"])
    groups = saved(groups)
    dense = kept.select("t", "lang", "lang_n", _salt("t")).join(_repeated(groups), ["lang", "salt"]).join(own, ["t", "g"], "left").na.fill(0, ["n"])
    return groups, kept, saved(dense.select("t", "g", "n", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q")))


def divergence(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, ranks: int = RANKS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank: how each group differs from the others and from its language.

    ``pair``: every other source of the language. ``term``: the ``ranks`` terms that the group overuses most.
    """
    groups, kept, dense = shares(docs, text=text, lang=lang, source=source, least=least)
    other = dense.select("t", F.col("g").alias("h"), F.col("p").alias("other_p"))
    pairs = dense.select("t", "g", "p").join(other, "t").filter("g <> h").groupBy("g", "h").agg(F.sum(_divergence("p", "other_p")).alias("value"))
    bare = groups.filter("v = 0").select("lang", "g")
    empty = bare.withColumn("salt", _salt("g")).join(_repeated(bare.withColumnRenamed("g", "h")), ["lang", "salt"]).filter("g <> h")
    pairs = pairs.unionByName(empty.select("g", "h", F.lit(0).cast("long").alias("value")))
    names = groups.select("g", "lang", "source")
    pairs = pairs.join(names, "g").join(names.select(F.col("g").alias("h"), F.col("source").alias("item")), "h")
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "item")))
    over = dense.filter("n > 0 AND p > q").select("g", "t", _divergence("p", "q").alias("value"))
    over = over.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("value"), "t"))).filter(F.col("rank") <= ranks)
    over = over.join(names, "g").join(kept.select("t", F.col("term").alias("item")), "t")
    row = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return row(pairs, "pair").unionByName(row(over, "term"))
