"""The engine's inputs read from parquet tables: events as pattern instances, trade as graphs, pages as source files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.files import short_hash

#: What a category applies to; null: every language.
CATEGORIES = [("click", None), ("comprehensions", None), ("error", None), ("purchase", ["python", "go"]), ("view", ["shell"])]
#: Declared modules of the trade graph: clusters (regions) are compared with them.
MODULES = [("north", ["NATION_1", "NATION_4"]), ("south", ["NATION_2", "NATION_3"]), ("east", ["NATION_"])]
ALLOWED = [("north", "south"), ("east", "north")]
LAYERS = [("top", 0), ("middle", 1), ("bottom", 2)]
MODULE_LAYERS = [("north", "top"), ("south", "middle"), ("east", "bottom")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category string, languages array<string>")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pattern instances; the snapshot is the week, the file is the user."""
    e = read(spark, sf_dir, "events")
    language = F.element_at(F.array(*[F.lit(x) for x in ("python", "shell", "go", "typescript")]), (F.col("user_id") % 4 + 1).cast("int"))
    week = (F.datediff(F.trunc(F.col("ts").cast("date"), "week"), F.lit("1970-01-05").cast("date")) / 7).cast("long")
    nodes = F.when(F.col("event_id") % 3 != 0, (F.col("event_id") % 10).cast("int"))
    return e.select(F.lit("events").alias("repo_id"), week.alias("seq"), F.col("event_type").alias("category"), short_hash(F.col("props")).alias("structural_hash"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file_path"), language.alias("language"), nodes.alias("node_count"))


def user_clusters(found: DataFrame) -> DataFrame:
    """A partition of the users seen in each week; every eleventh has no cluster, and a cluster drifts now and then."""
    n = F.substring("file_path", 2, 20).cast("long")
    return found.select("repo_id", "seq", "file_path").distinct().filter(n % 11 != 0).withColumn("cluster", (n + F.when(n % 5 == F.col("seq") % 5, 1).otherwise(0)) % 7)


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertices, imports, partition): each year's sales between nations; clusters are regions."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    items, supplier, nation = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier"), read(spark, sf_dir, "nation")
    sold = items.select("l_orderkey", "l_suppkey").join(orders.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("long").alias("seq")), F.col("l_orderkey") == F.col("o_orderkey"))
    name = lambda key, to: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(to))
    sold = sold.join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    imports = sold.join(name("c_nationkey", "src"), "c_nationkey").join(name("s_nationkey", "dst"), "s_nationkey").select(F.lit("trade").alias("repo_id"), "seq", "src", "dst")
    years = imports.select("repo_id", "seq").distinct()
    every = years.withColumn("_k", F.lit(1)).join(nation.select(F.col("n_name").alias("file_path"), F.col("n_regionkey").cast("long").alias("cluster"), F.lit(1).alias("_k")), "_k").drop("_k")
    return every.select("repo_id", "seq", "file_path"), imports, every


def sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): suppliers, each linked to those whose numbers are taken from the parts that it sold."""
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    top = supplier.agg(F.max("k").alias("top"))
    items = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    to = (F.col("l_partkey") * 7919 % F.col("top") + 1).cast("string")
    edges = items.join(F.broadcast(top)).select(F.lit("suppliers").alias("repo_id"), F.lit(0).cast("long").alias("seq"), F.col("l_suppkey").cast("string").alias("src"), to.alias("dst")).filter("src <> dst").distinct()
    return supplier.select(F.lit("suppliers").alias("repo_id"), F.lit(0).cast("long").alias("seq"), F.col("k").cast("string").alias("file_path")), edges


def pointers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): suppliers, each linked to the one whose number is taken from the first of the parts that it sold."""
    supplier = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    top = supplier.agg(F.max("k").alias("top"))
    key = [F.lit("suppliers").alias("repo_id"), F.lit(0).cast("long").alias("seq")]
    name = lambda c: F.format_string("s%06d", c)
    first = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("part"))
    edges = first.join(F.broadcast(top)).select(*key, name(F.col("l_suppkey")).alias("src"), name(F.col("part") * 7919 % F.col("top") + 1).alias("dst"))
    return supplier.select(*key, name(F.col("k")).alias("file_path")), edges.filter("src <> dst")


def planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): suppliers, each linked to the least one of its nation; the nations are the communities."""
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    hub = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("hub"))
    key = [F.lit("suppliers").alias("repo_id"), F.lit(0).cast("long").alias("seq")]
    name = lambda c: F.format_string("s%06d", c)
    edges = supplier.join(F.broadcast(hub), "s_nationkey").filter("s_suppkey <> hub").select(*key, name(F.col("s_suppkey")).alias("src"), name(F.col("hub")).alias("dst"))
    return supplier.select(*key, name(F.col("s_suppkey")).alias("file_path")), edges


def transitions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): which event type follows which, for any user."""
    e = read(spark, sf_dir, "events")
    after = e.select(F.col("event_type").alias("src"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst")).filter("dst IS NOT NULL AND src <> dst").distinct()
    key = [F.lit("events").alias("repo_id"), F.lit(0).cast("long").alias("seq")]
    return e.select(F.col("event_type").alias("file_path")).distinct().select(*key, "file_path"), after.select(*key, "src", "dst")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: repo_id (host), file_path (path), and their html."""
    p = read(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1).alias("path"), "url", "html")


#: Elements that hold nothing here: those without an end tag, and those whose end tag pages often leave out.
LEAVES = ("area", "b", "base", "br", "col", "em", "embed", "hr", "i", "img", "input", "link", "meta", "p", "source", "strong", "track", "wbr")


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of all pages as nodes of trees (tree_id, at, depth, type), in the order of their tags.

    Comments, scripts and styles have no elements inside. An end tag goes up one level, whatever it names, and never above
    the top. Pages without text have no nodes.
    """
    html = F.regexp_replace(F.regexp_replace("html", "(?s)<!--.*?-->", ""), "(?s)(<(?:script|style)[^>]*>).*?(</(?:script|style)>)", "$1$2")
    tags = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit("<(/?[A-Za-z][A-Za-z0-9]*)"), F.lit(1))).alias("at", "tag"))
    tags = tags.withColumn("tag", F.lower("tag")).withColumn("end", F.startswith("tag", F.lit("/")))
    tags = tags.filter(~F.ltrim("tag", F.lit("/")).isin(*LEAVES) | ~F.col("end"))
    page = Window.partitionBy("page_id").orderBy("at")
    step = F.when(F.col("end"), -1).when(F.col("tag").isin(*LEAVES), 0).otherwise(1)
    level = F.coalesce(F.sum(step).over(page.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    floor = F.least(F.lit(0), F.min("level").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    found = tags.withColumn("level", level).withColumn("depth", (F.col("level") - floor).cast("int")).filter(~F.col("end"))
    return found.select(F.col("page_id").alias("tree_id"), "at", "depth", F.col("tag").alias("type"))
