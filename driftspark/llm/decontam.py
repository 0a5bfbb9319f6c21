"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words are maximal runs of letters, digits and non-ASCII characters after lower-casing A-Z. A benchmark window is
``WINDOW`` consecutive words of an item, or the whole item where it is shorter. Of each window's k-grams only the one
with the least hash is kept, the window's fingerprint. It depends on the window's words alone, so any document that
holds a window keeps the same fingerprint for it: no shared span of a window's length is missed. Neighbouring windows
mostly share their fingerprint, so a document is cut into runs of windows, about one for every three or four words.

The runs whose fingerprints occur in the benchmark are extended: their windows are compared with the benchmark's own,
word by word (as joined text), so a collision of hashes finds nothing. What comes out is the words inside occurrences.

Documents are scanned once. A run takes its own words along, a row for each document carries its word count, and after
the joins only hits and these rows are shuffled. The benchmark's fingerprints and windows are broadcast if there are at
most ``BROADCAST_ROWS`` of them, and joined by shuffle beyond.

Null texts have no words. Empty items have no window and are never found. Repeated rows of documents are reported one
by one; repeated items count by their ids. Null item ids count as an item named by the empty string. With an empty
benchmark nothing is hit. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name

WINDOW = 10
BROADCAST_ROWS = 500_000
#: Upper bound of the broadcast windows' bytes, with their items' names, beside the row count.
BROADCAST_BYTES = 100_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(F.coalesce(lowered, F.lit("")), SEPARATORS), lambda w: w != "")


def _gram(size: int) -> int:
    """Words in a k-gram, so that windows of ``size`` words hold size - k + 1 of them."""
    return (size + 1) // 2


def _minima(found: DataFrame, size: int) -> DataFrame:
    """Adds ``minima``: the fingerprint of each window of ``size`` words, from the left."""
    k = _gram(size)
    grams = F.transform(F.sequence(F.lit(0), F.col("n") - k), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(k)]))
    found = found.withColumn("grams", F.when(F.col("n") >= size, grams))
    if size == k:
        return found.withColumnRenamed("grams", "minima")
    window = lambda i: F.least(*[F.get("grams", i + j) for j in range(size - k + 1)])
    return found.withColumn("minima", F.when(F.col("n") >= size, F.transform(F.sequence(F.lit(0), F.col("n") - size), window))).drop("grams")


def _runs(found: DataFrame, size: int, to: str) -> DataFrame:
    """Adds column ``to``: (fp, size, start, text) of each maximal run of windows with one fingerprint."""
    found = _minima(found, size)
    firsts = F.filter(F.transform("minima", lambda m, i: F.struct(m.alias("fp"), i.alias("start"))), lambda r, i: (i == 0) | (r.fp != F.get("minima", i - 1)))
    found = found.withColumn("firsts", firsts)

    def run(r: Column, i: Column) -> Column:
        after = F.coalesce(F.get("firsts", i + 1).start, F.size("minima"))
        text = F.array_join(F.slice("words", r.start + 1, after - r.start + (size - 1)), " ")
        return F.struct(r.fp.alias("fp"), F.lit(size).alias("size"), r.start.alias("start"), text.alias("text"))

    return found.withColumn(to, F.coalesce(F.transform("firsts", run), F.array().cast("array<struct<fp:bigint,size:int,start:int,text:string>>"))).drop("minima", "firsts")


def benchmark_windows(benchmark: DataFrame, sizes: list[int] | None = None) -> tuple[DataFrame, list[int]]:
    """All windows of the benchmark (fp, size, text, items), and the sizes that occur, at most ``WINDOW`` of them."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("words"))
    items = items.withColumn("n", F.size("words")).filter("n > 0")
    items = items.withColumn("size", F.least("n", F.lit(WINDOW)))
    if sizes is None:
        sizes = sorted(r.size for r in items.select("size").distinct().collect())
    found = None
    for size in sizes:
        own = _minima(items.filter(F.col("size") == size), size)
        each = F.transform("minima", lambda m, i: F.struct(m.alias("fp"), F.array_join(F.slice("words", i + 1, F.lit(size)), " ").alias("text")))  # noqa: B023
        own = own.select("item", F.lit(size).alias("size"), F.explode(each).alias("w")).select("item", "size", "w.fp", "w.text")
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = benchmark.sparkSession.createDataFrame([], "item string, size int, fp long, text string")
    return found.groupBy("fp", "size", "text").agg(F.collect_set("item").alias("items")), sizes


def _small(df: DataFrame, size: Column) -> bool:
    n, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= BROADCAST_ROWS and total <= BROADCAST_BYTES


def hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: key, ``n_words``, ``n_hit``, ``items`` (found, sorted) and ``spans`` (first word, words)."""
    windows, sizes = benchmark_windows(benchmark)
    prints = windows.select("fp", "size").distinct()
    if _small(windows, F.octet_length("text") + F.aggregate("items", F.lit(0), lambda n, item: n + F.octet_length(item) + 16) + 32):
        windows, prints = F.broadcast(windows), F.broadcast(prints)
    found = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), words(F.col(text)).alias("words")).withColumn("n", F.size("words"))
    for size in sizes:
        found = _runs(found, size, f"runs{size}")
    # the row that every document has; nothing joins it, as no window has 0 words
    own = F.array(F.struct(F.xxhash64("row").alias("fp"), F.lit(0).alias("size"), F.lit(-1).alias("start"), F.lit(None).cast("string").alias("text")))
    runs = found.select("key", "row", "n", F.explode(F.concat(own, *[f"runs{s}" for s in sizes])).alias("r"))
    runs = runs.select("key", "row", F.when(F.col("r.size") == 0, F.col("n")).alias("n"), "r.*")
    runs = runs.join(prints.withColumn("known", F.lit(True)), ["fp", "size"], "left").filter("size = 0 OR known")

    parts = F.split("text", " ")
    runs = runs.withColumn("parts", F.when(F.col("size") > 0, parts))
    each = F.transform(F.sequence(F.lit(0), F.size("parts") - F.col("size")), lambda i: F.struct((F.col("start") + i).alias("start"), F.array_join(F.slice("parts", i + 1, F.col("size")), " ").alias("text")))
    own = F.array(F.struct("start", F.concat(F.lit(" "), F.col("row").cast("string")).alias("text")))
    runs = runs.select("key", "row", "n", "size", F.explode(F.when(F.col("size") > 0, each).otherwise(own)).alias("w")).select("key", "row", "n", "size", "w.start", "w.text")
    runs = runs.join(windows.select("size", "text", "items"), ["size", "text"], "left").filter("size = 0 OR items IS NOT NULL")

    span = F.struct(F.col("start").alias("start"), F.col("size").alias("size"))
    of_doc = runs.groupBy("key", "row").agg(
        F.max("n").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(F.col("size") > 0, span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # words in the union of spans, from the left: (end so far, words so far)
    step = lambda x, s: F.struct(F.greatest(x.end, s.start + s.size).alias("end"), (x.n + F.greatest(F.lit(0), s.start + s.size - F.greatest(x.end, s.start))).alias("n"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda x: x.n)
    return of_doc.select(F.col("key").alias(key), "n_words", n_hit.cast("long").alias("n_hit"), "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that share no window with the benchmark; each row goes by its own text."""
    row = free_name(docs, "_row")
    rows = docs.withColumn(row, F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("hash")))
    found = checkpointed(hits(rows, benchmark, key=row, text=text).filter("n_hit > 0").select(row).distinct())
    return rows.join(found, row, "left_anti").select(docs.columns)


def digests(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``hits`` as counts and the SHA-256 of the items' ids."""
    return found.select(
        key,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
