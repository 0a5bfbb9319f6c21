"""Named queries over the operators, each with equivalent SQL where there is one."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import parsers
from ..functions import files, globs, shapes
from ..operators import catalog, communities, debounce, divergence, graph, intent, leiden, reach, resolve, subtrees
from ..shared import shared_folder
from ..sources import cache as features_cache
from ..sources import settings, snapshots, store, tables
from ..sources.trees import EXCLUDED
from ..streaming import debounce as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


INST = """inst AS (
  SELECT 'events' AS repo_id, CAST(date_diff('day', DATE '1970-01-05', CAST(date_trunc('week', ts) AS DATE)) // 7 AS BIGINT) AS seq, event_type AS category,
    substr(sha256(props), 1, 8) AS structural_hash, 'u' || user_id AS file_path,
    CASE user_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'shell' WHEN 2 THEN 'go' ELSE 'typescript' END AS language,
    CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 10 AS INTEGER) END AS node_count
  FROM events
), cats(category, languages) AS (
  VALUES ('click', NULL), ('comprehensions', NULL), ('error', NULL), ('purchase', ['python', 'go']), ('view', ['shell'])
), shapes AS (
  SELECT repo_id, seq, category, structural_hash, count(*) AS instance_count FROM inst GROUP BY ALL
), measures AS (
  SELECT repo_id, seq, CAST(sum(k) AS DOUBLE) AS pattern_entropy, sum(n - top) / sum(n) AS convention_drift
  FROM (SELECT repo_id, seq, category, count(*) AS k, sum(instance_count) AS n, max(instance_count) AS top FROM shapes GROUP BY ALL) GROUP BY ALL
), part AS (
  SELECT repo_id, seq, file_path, (n + CASE WHEN n % 5 = seq % 5 THEN 1 ELSE 0 END) % 7 AS cluster
  FROM (SELECT DISTINCT repo_id, seq, file_path, CAST(substr(file_path, 2) AS BIGINT) AS n FROM inst) WHERE n % 11 <> 0
)"""
TRADE = """imports AS (
  SELECT 'trade' AS repo_id, CAST(year(o_orderdate) AS BIGINT) AS seq, cn.n_name AS src, sn.n_name AS dst
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey
), part AS (
  SELECT repo_id, seq, n_name AS file_path, CAST(n_regionkey AS BIGINT) AS cluster FROM (SELECT DISTINCT repo_id, seq FROM imports), nation
), edges AS (
  SELECT repo_id, seq, src, dst, count(*) AS weight FROM imports WHERE src <> dst GROUP BY ALL
), crossing AS (
  SELECT e.repo_id, e.seq, s.cluster AS source_cluster, t.cluster AS target_cluster, count(*) AS count FROM edges e
  JOIN part s ON s.repo_id = e.repo_id AND s.seq = e.seq AND s.file_path = e.src JOIN part t ON t.repo_id = e.repo_id AND t.seq = e.seq AND t.file_path = e.dst
  WHERE s.cluster <> t.cluster GROUP BY ALL
), members AS (
  SELECT *, CASE WHEN starts_with(file_path, 'NATION_1') OR starts_with(file_path, 'NATION_4') THEN 'north' WHEN starts_with(file_path, 'NATION_2') OR starts_with(file_path, 'NATION_3') THEN 'south' WHEN starts_with(file_path, 'NATION_') THEN 'east' END AS module FROM part
), of_cluster AS (
  SELECT repo_id, seq, cluster, module FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, seq, cluster ORDER BY n DESC, f) AS r
    FROM (SELECT repo_id, seq, cluster, module, count(*) AS n, min(file_path) AS f FROM members WHERE module IS NOT NULL GROUP BY ALL)) WHERE r = 1
), home AS (
  SELECT repo_id, seq, module, cluster AS home FROM (
    SELECT *, row_number() OVER (PARTITION BY repo_id, seq, module ORDER BY n DESC, f) AS r
    FROM (SELECT repo_id, seq, cluster, module, count(*) AS n, min(file_path) AS f FROM members WHERE module IS NOT NULL GROUP BY ALL)) WHERE r = 1
), misplaced AS (
  SELECT repo_id, seq, file_path, module, cluster, home FROM members JOIN home USING (repo_id, seq, module) WHERE cluster <> home
), pairs AS (
  SELECT c.*, a.module AS from_module, b.module AS to_module FROM crossing c
  JOIN of_cluster a ON a.repo_id = c.repo_id AND a.seq = c.seq AND a.cluster = source_cluster JOIN of_cluster b ON b.repo_id = c.repo_id AND b.seq = c.seq AND b.cluster = target_cluster
  WHERE a.module <> b.module
), unauthorized AS (
  SELECT repo_id, seq, source_cluster, target_cluster, from_module, to_module, count FROM pairs WHERE (from_module, to_module) NOT IN (('north', 'south'), ('east', 'north'))
), layer(module, layer, rank) AS (
  VALUES ('north', 'top', 0), ('south', 'middle', 1), ('east', 'bottom', 2)
), layered AS (
  SELECT repo_id, seq, source_cluster, target_cluster, from_module, to_module, f.layer AS from_layer, t.layer AS to_layer, count
  FROM pairs JOIN layer f ON f.module = from_module JOIN layer t ON t.module = to_module WHERE f.rank > t.rank
)"""
SPARSE = """edges AS (
  SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS src, CAST(l_partkey * 7919 % (SELECT max(s_suppkey) FROM supplier) + 1 AS VARCHAR) AS dst
  FROM lineitem WHERE l_suppkey <> l_partkey * 7919 % (SELECT max(s_suppkey) FROM supplier) + 1
)"""


# ---- sources, files, scalar functions ------------------------------------------------------------------------------


@query("SELECT lang AS language, count(*) AS files FROM documents GROUP BY lang")
def language_breakdown(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count(F.lit(1)).alias("files"))


@query("SELECT count(*) AS files FROM pages")
def file_count(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("files"))


EXTS = "['.py', '.js', '.ts', '.go', '.rs', '.sh', '.html', '']"


@query(f"""
WITH p AS (SELECT page_id, 'src/p' || page_id || ({EXTS})[page_id % 8 + 1] AS path FROM pages)
SELECT page_id, path, CASE page_id % 8 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'go' WHEN 4 THEN 'rust' WHEN 5 THEN 'shell' END AS language FROM p
""")
def ext_detect(spark, sf_dir):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".py", ".js", ".ts", ".go", ".rs", ".sh", ".html", "")]), (F.col("page_id") % 8 + 1).cast("int"))
    found = tables.read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("src/p"), F.col("page_id").cast("string"), ext).alias("path"))
    return found.select("page_id", "path", files.language(F.col("path")).alias("language"))


@query(r"""
WITH p AS (SELECT page_id, 'src/' || regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '[.]html$', '') || CASE WHEN page_id % 5 = 0 THEN '/__init__.py' WHEN page_id % 7 = 0 THEN '.js' ELSE '.py' END AS path FROM pages)
SELECT page_id, path, CASE WHEN ends_with(path, '.py') THEN nullif(regexp_replace(replace(regexp_replace(regexp_replace(path, '[.]py$', ''), '(^|/)__init__$', ''), '/', '.'), '^src[.]', ''), '') END AS module_key FROM p
""")
def path_key(spark, sf_dir):
    tail = F.when(F.col("page_id") % 5 == 0, "/__init__.py").when(F.col("page_id") % 7 == 0, ".js").otherwise(".py")
    found = tables.pages(spark, sf_dir).select("page_id", F.concat(F.lit("src/"), F.regexp_replace("path", r"[.]html$", ""), tail).alias("path"))
    return found.select("page_id", "path", resolve.module_key(F.col("path")).alias("module_key"))


@query(r"SELECT page_id, CASE page_id % 3 WHEN 0 THEN './' WHEN 1 THEN '././' ELSE '' END || replace(url, '/', '\') AS path, replace(replace(url, '/', '\'), '\', '/') AS posix FROM pages")
def posix_path(spark, sf_dir):
    p = tables.read(spark, sf_dir, "pages")
    before = F.element_at(F.array(F.lit("./"), F.lit("././"), F.lit("")), (F.col("page_id") % 3 + 1).cast("int"))
    found = p.select("page_id", F.concat(before, F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"))
    return found.select("page_id", "path", files.posix(F.col("path")).alias("posix"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))) AS INTEGER) AS loc FROM documents")
def loc_count(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", files.lines_of_code(F.col("text")).alias("loc"))


@query("SELECT sha256(text) AS content_hash, count(*) AS files, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dups(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return d.groupBy("content_hash").agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first_doc")).filter("files > 1")


@query("""
WITH a AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE lang = 'en')
SELECT doc_id, sha256(text) AS content_hash, sha256(text) IN (SELECT h FROM a) AS kept FROM documents
""")
def cache_orphans(spark, sf_dir):
    """Cache entries (all documents) whose content no active file (the English ones) has any more."""
    cache = tables.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), "lang")
    active, cache = cache.filter("lang = 'en'").select("content_hash").distinct(), cache.drop("lang")
    kept, gone = cache.join(active, "content_hash", "left_semi"), cache.join(active, "content_hash", "left_anti")
    return kept.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False)))


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN regexp_matches(path, '^en/[^/]*7[^/]*(/.*)?$') THEN false WHEN regexp_matches(path, '^(.*/)?[^/]*[.]html(/.*)?$') OR regexp_matches(path, '^en(/.*)?$') AND path LIKE 'en/%' THEN true ELSE false END AS excluded FROM p
""")
def scope_exclude(spark, sf_dir):
    """Ignore patterns with a negation: the last that matches decides."""
    p = tables.pages(spark, sf_dir)
    return p.select("page_id", "path", globs.ignored(F.col("path"), ["*.html", "/en/**", "!/en/*7*"]).alias("excluded"))


@query(r"""
WITH t AS (SELECT page_id, substr(sha256(array_to_string(regexp_extract_all(html, '<([a-z0-9]+)', 1), ',')), 1, 8) AS shape FROM pages)
SELECT shape, count(*) AS pages, min(page_id) AS first_page FROM t GROUP BY shape
""")
def tag_shapes(spark, sf_dir):
    shape = files.short_hash(F.array_join(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1)), ","))
    return tables.read(spark, sf_dir, "pages").groupBy(shape.alias("shape")).agg(F.count(F.lit(1)).alias("pages"), F.min("page_id").alias("first_page"))


@query("SELECT event_id, 'app.' || upper(event_type) || '.' || event_type || '_Call' AS callee, lower(event_type || '_Call') AS last_segment, event_type IN ('error') AS is_logging FROM events")
def callee_category(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("app."), F.upper("event_type"), F.lit("."), F.col("event_type"), F.lit("_Call")).alias("callee"))
    last = files.last_segment(F.col("callee"))
    return e.select("event_id", "callee", last.alias("last_segment"), F.regexp_replace(last, "_call$", "").isin("debug", "info", "warning", "error", "critical", "exception").alias("is_logging"))


# ---- import resolution ---------------------------------------------------------------------------------------------


@query(r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages),
k AS (SELECT DISTINCT regexp_replace(host, '^[^.]+[.]', '') AS key FROM h WHERE page_id % 3 = 0 UNION SELECT DISTINCT host FROM h WHERE page_id % 17 = 0)
SELECT page_id, host, (SELECT arg_max(key, length(key)) FROM k WHERE host = key OR ends_with(host, '.' || key)) AS dst FROM h
""")
def import_edges_suffix(spark, sf_dir):
    """Hosts as dotted imports; the longest dotted suffix among known keys wins."""
    h = tables.pages(spark, sf_dir).select("page_id", "host")
    keys = h.filter("page_id % 3 = 0").select(F.regexp_replace("host", r"^[^.]+[.]", "").alias("key")).unionByName(h.filter("page_id % 17 = 0").select(F.col("host").alias("key"))).distinct()
    keys = keys.select(F.lit("r").alias("repo_id"), "key", F.col("key").alias("file_path"))
    found = resolve.best_match(h.withColumn("repo_id", F.lit("r")), keys, resolve.suffixes(F.col("host")), ["repo_id"])
    return found.select("page_id", "host", "dst")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', ''), '[.]html$', '') AS base FROM pages),
k AS (SELECT DISTINCT base || CASE page_id % 4 WHEN 0 THEN '.sh' WHEN 1 THEN '.bash' WHEN 2 THEN '' ELSE '.py' END AS key FROM p)
SELECT page_id, base AS import, CASE WHEN base IN (SELECT key FROM k) THEN base WHEN base || '.sh' IN (SELECT key FROM k) THEN base || '.sh' WHEN base || '.bash' IN (SELECT key FROM k) THEN base || '.bash' END AS dst FROM p
""")
def import_fallback_shell(spark, sf_dir):
    p = tables.pages(spark, sf_dir).select("page_id", F.lit("r").alias("repo_id"), F.regexp_replace(F.regexp_replace("path", "/$", ""), "[.]html$", "").alias("import"))
    ext = F.element_at(F.array(F.lit(".sh"), F.lit(".bash"), F.lit(""), F.lit(".py")), (F.col("page_id") % 4 + 1).cast("int"))
    keys = p.select("repo_id", F.concat("import", ext).alias("key")).withColumn("file_path", F.col("key"))
    return resolve.best_match(p, keys, resolve.shell_candidates(F.col("import")), ["repo_id"]).select("page_id", "import", "dst")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/$', ''), '[.]html$', '') AS base FROM pages),
k AS (SELECT DISTINCT base || CASE page_id % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.d.ts' WHEN 2 THEN '/index.jsx' ELSE '.css' END AS key FROM p),
c AS (SELECT page_id, base || CASE page_id % 3 WHEN 0 THEN '.js' WHEN 1 THEN '' ELSE '.css' END AS import FROM p),
e AS (SELECT page_id, import, unnest(CASE WHEN ends_with(import, '.css') THEN [import] WHEN ends_with(import, '.js') THEN
    list_concat([import, left(import, length(import) - 3) || '.ts', left(import, length(import) - 3) || '.tsx'], list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.d.ts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'], lambda x: import || x))
    ELSE list_concat([import], list_transform(['.ts', '.tsx', '.js', '.jsx', '.mjs', '.cjs', '.d.ts', '/index.ts', '/index.tsx', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs'], lambda x: import || x)) END) AS key,
  generate_subscripts(CASE WHEN ends_with(import, '.css') THEN [1] WHEN ends_with(import, '.js') THEN range(16) ELSE range(14) END, 1) AS i FROM c)
SELECT c.page_id, c.import, h.dst FROM c LEFT JOIN (SELECT page_id, arg_min(key, i) AS dst FROM e JOIN k USING (key) GROUP BY page_id) h USING (page_id)
""")
def import_fallback_js(spark, sf_dir):
    p = tables.pages(spark, sf_dir).select("page_id", F.lit("r").alias("repo_id"), F.regexp_replace(F.regexp_replace("path", "/$", ""), "[.]html$", "").alias("base"))
    pick = lambda n, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("page_id") % n + 1).cast("int"))
    keys = p.select("repo_id", F.concat("base", pick(4, ".ts", ".d.ts", "/index.jsx", ".css")).alias("key")).withColumn("file_path", F.col("key"))
    imports = p.select("page_id", "repo_id", F.concat("base", pick(3, ".js", "", ".css")).alias("import"))
    return resolve.best_match(imports, keys, resolve.js_candidates(F.col("import")), ["repo_id"]).select("page_id", "import", "dst")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, CASE WHEN starts_with(path, 'en/') THEN 'src/english/' || substr(path, 4) || ',lib/' || substr(path, 4) WHEN starts_with(path, 'fr/') AND ends_with(path, '.html') AND length(path) >= 8 THEN 'src/french/' || substr(path, 4, length(path) - 8) || '.ts' END AS targets FROM p
""")
def alias_expand(spark, sf_dir):
    aliases = [("en/*", ["src/english/*", "lib/*"]), ("fr/*.html", ["src/french/*.ts"])]
    return tables.pages(spark, sf_dir).select("page_id", "path", F.array_join(resolve.first_alias(F.col("path"), aliases), ",").alias("targets"))


# ---- catalog -------------------------------------------------------------------------------------------------------


@query(f"WITH {INST} SELECT repo_id, seq, category, structural_hash, count(*) AS instance_count, array_to_string(list_sort(list_distinct(list(file_path))), ',') AS files FROM inst GROUP BY ALL")
def catalog_shapes(spark, sf_dir):
    return catalog.shapes(tables.instances(spark, sf_dir)).withColumn("files", F.array_join("file_paths", ",")).drop("file_paths")


@query(f"WITH {INST} SELECT repo_id, seq, category, structural_hash, count(*) AS instance_count FROM inst WHERE node_count IS NULL OR node_count >= 5 GROUP BY ALL")
def min_pattern_nodes(spark, sf_dir):
    return catalog.shape_counts(catalog.large_enough(tables.instances(spark, sf_dir), 5))


@query(f"WITH {INST} SELECT repo_id, seq, category, language, count(*) AS instances FROM inst LEFT JOIN cats USING (category) WHERE languages IS NULL OR list_contains(languages, language) GROUP BY ALL")
def language_applicability(spark, sf_dir):
    found = catalog.applicable(tables.instances(spark, sf_dir), tables.categories(spark))
    return found.groupBy("repo_id", "seq", "category", "language").agg(F.count(F.lit(1)).alias("instances"))


@query(f"""WITH {INST}, have AS (SELECT repo_id, seq, category, count(*) AS entropy, CAST(sum(instance_count) AS BIGINT) AS instances FROM shapes GROUP BY ALL),
want AS (SELECT repo_id, seq, category FROM (SELECT DISTINCT repo_id, seq FROM shapes), cats UNION SELECT repo_id, seq, category FROM have)
SELECT repo_id, seq, category, coalesce(entropy, 0) AS entropy, coalesce(instances, 0) AS instances FROM want LEFT JOIN have USING (repo_id, seq, category)""")
def category_entropy(spark, sf_dir):
    return catalog.category_entropy(catalog.shape_counts(tables.instances(spark, sf_dir)), tables.categories(spark))


@query(f"WITH {INST} SELECT repo_id, seq, category, structural_hash, instance_count FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, seq, category ORDER BY instance_count DESC, structural_hash) AS r FROM shapes) WHERE r = 1")
def canonical_shape(spark, sf_dir):
    return catalog.canonical_shapes(catalog.shape_counts(tables.instances(spark, sf_dir)))


def _measures(spark, sf_dir) -> DataFrame:
    """Two dimensions of each week; versions change their major part in the last weeks."""
    found = catalog.pattern_measures(catalog.shape_counts(tables.instances(spark, sf_dir)))
    return found.withColumn("version", F.when(F.col("seq") >= 2819, "1.0.0").otherwise(F.when(F.col("seq") == 2817, "0.1.0").otherwise("0.2.0")))


VERSIONED = "versioned AS (SELECT *, CASE WHEN seq >= 2819 THEN '1.0.0' WHEN seq = 2817 THEN '0.1.0' ELSE '0.2.0' END AS version FROM measures)"
TWO = ("pattern_entropy", "convention_drift")


@query(f"WITH {INST} SELECT repo_id, seq, pattern_entropy, convention_drift FROM measures")
def pattern_measures(spark, sf_dir):
    return catalog.pattern_measures(catalog.shape_counts(tables.instances(spark, sf_dir)))


@query(f"""WITH {INST}, before AS (SELECT repo_id, seq + 1 AS seq, category, structural_hash, instance_count AS b FROM shapes)
SELECT repo_id, seq, category, structural_hash, instance_count, CASE WHEN (repo_id, seq) IN (SELECT DISTINCT repo_id, seq FROM before) THEN CAST(instance_count - coalesce(b, 0) AS DOUBLE) END AS velocity
FROM shapes LEFT JOIN before USING (repo_id, seq, category, structural_hash)""")
def shape_velocity(spark, sf_dir):
    return catalog.velocity(catalog.shape_counts(tables.instances(spark, sf_dir))).withColumn("velocity", F.col("velocity").cast("double"))


@query(f"""WITH {INST} SELECT repo_id, seq, category, structural_hash, count(DISTINCT cluster) AS boundary_spread
FROM (SELECT DISTINCT repo_id, seq, category, structural_hash, file_path FROM inst) LEFT JOIN part USING (repo_id, seq, file_path) GROUP BY ALL""")
def boundary_spread(spark, sf_dir):
    found = tables.instances(spark, sf_dir)
    return catalog.boundary_spread(found, tables.user_clusters(found))


APPLIED = "applied AS (SELECT * FROM inst LEFT JOIN cats USING (category) WHERE languages IS NULL OR list_contains(languages, language)), langs AS (SELECT DISTINCT repo_id, seq, language FROM inst)"
BY_LANGUAGE = f"""{APPLIED}, by_language AS (
  SELECT repo_id, seq, language, CAST(coalesce(n, 0) AS DOUBLE) AS pattern_entropy FROM langs LEFT JOIN (
    SELECT repo_id, seq, language, count(*) AS n FROM (SELECT DISTINCT repo_id, seq, language, category, structural_hash FROM applied) GROUP BY ALL) USING (repo_id, seq, language))"""


@query(f"WITH {INST}, {BY_LANGUAGE} SELECT repo_id, seq, language, pattern_entropy FROM by_language")
def entropy_by_language(spark, sf_dir):
    found = tables.instances(spark, sf_dir)
    return catalog.entropy_by_language(found, found.select("repo_id", "seq", "language").distinct(), tables.categories(spark))


@query(f"""WITH {INST}, {APPLIED}, w AS (SELECT repo_id, seq, language, category, structural_hash, count(DISTINCT file_path) AS w FROM applied GROUP BY ALL),
c AS (SELECT repo_id, seq, language, category, sum(w) AS n, max(w) AS top FROM w GROUP BY ALL), d AS (SELECT repo_id, seq, language, sum(n - top) / sum(n) AS drift FROM c GROUP BY ALL)
SELECT repo_id, seq, language, coalesce(drift, 0.0) AS convention_drift FROM langs LEFT JOIN d USING (repo_id, seq, language)""")
def drift_by_language(spark, sf_dir):
    found = tables.instances(spark, sf_dir)
    return catalog.drift_by_language(found, found.select("repo_id", "seq", "language").distinct(), tables.categories(spark))


# ---- snapshots over time -------------------------------------------------------------------------------------------


@query(f"""WITH {INST}, {VERSIONED}, l AS (SELECT *, lag(version) OVER w AS pv, lag(pattern_entropy) OVER w AS pe, lag(convention_drift) OVER w AS pd FROM versioned WINDOW w AS (PARTITION BY repo_id ORDER BY seq))
SELECT repo_id, seq, pattern_entropy, convention_drift, version, CASE WHEN split_part(version, '.', 1) = split_part(pv, '.', 1) THEN pattern_entropy - pe END AS pattern_entropy_delta,
  CASE WHEN split_part(version, '.', 1) = split_part(pv, '.', 1) THEN convention_drift - pd END AS convention_drift_delta FROM l""")
def snapshot_delta(spark, sf_dir):
    return divergence.deltas(_measures(spark, sf_dir), TWO)


@query(f"""WITH {INST}, {VERSIONED}, {BY_LANGUAGE}, v AS (SELECT repo_id, seq, version, lag(version) OVER w AS pv, lag(seq) OVER w AS ps FROM versioned WINDOW w AS (PARTITION BY repo_id ORDER BY seq)),
k AS (SELECT v.repo_id, v.seq, b.language FROM v JOIN by_language b ON b.repo_id = v.repo_id AND b.seq IN (v.seq, v.ps) GROUP BY ALL)
SELECT k.repo_id, k.seq, k.language, CASE WHEN split_part(version, '.', 1) = split_part(pv, '.', 1) AND pv <> '0.1.0' THEN coalesce(n.pattern_entropy, 0) - coalesce(p.pattern_entropy, 0) END AS delta
FROM k JOIN v USING (repo_id, seq) LEFT JOIN by_language n ON n.repo_id = k.repo_id AND n.seq = k.seq AND n.language = k.language LEFT JOIN by_language p ON p.repo_id = k.repo_id AND p.seq = v.ps AND p.language = k.language""")
def language_delta(spark, sf_dir):
    return divergence.language_deltas(entropy_by_language(spark, sf_dir), "pattern_entropy", _measures(spark, sf_dir).select("repo_id", "seq", "version"))


@query(f"WITH {INST} SELECT repo_id, seq, 'pattern_entropy' AS dimension, pattern_entropy AS value FROM measures UNION ALL SELECT repo_id, seq, 'convention_drift', convention_drift FROM measures")
def trend_long(spark, sf_dir):
    return divergence.trend_long(_measures(spark, sf_dir), (*TWO, "no_such_dimension"))


@query(f"WITH {INST} SELECT repo_id, seq, pattern_entropy, convention_drift FROM measures")
def trend_wide(spark, sf_dir):
    return divergence.trend_wide(divergence.trend_long(_measures(spark, sf_dir), TWO), TWO)


@query(f"WITH {INST} SELECT repo_id, seq, pattern_entropy FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) AS r FROM measures) WHERE r <= 3")
def trend_last(spark, sf_dir):
    return divergence.last(_measures(spark, sf_dir), 3).select("repo_id", "seq", "pattern_entropy")


@query(f"""WITH {INST}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY seq DESC) AS r FROM measures)
SELECT a.repo_id, a.seq AS seq_a, a.pattern_entropy AS pattern_entropy_a, a.convention_drift AS convention_drift_a, b.seq AS seq_b, b.pattern_entropy AS pattern_entropy_b, b.convention_drift AS convention_drift_b,
  b.pattern_entropy - a.pattern_entropy AS pattern_entropy_delta, b.convention_drift - a.convention_drift AS convention_drift_delta FROM r a JOIN r b USING (repo_id) WHERE a.r = 2 AND b.r = 1""")
def diff_pair(spark, sf_dir):
    m = _measures(spark, sf_dir)
    pick = lambda ref: divergence.referenced(m, ref, key="repo_id", order="seq", name="version")
    return divergence.diff(pick("-2"), pick(None), TWO)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5 AS kept FROM orders")
def retention(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return divergence.retained(o, 5, "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "kept")


@query("""
WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS d, o_orderpriority FROM orders),
u AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS d FROM orders WHERE starts_with(o_orderpriority, '1'))
SELECT 'latest' AS ref, o_custkey, o_orderkey FROM o WHERE d = 1 UNION ALL SELECT '2', o_custkey, o_orderkey FROM o WHERE a = 2 UNION ALL SELECT '-2', o_custkey, o_orderkey FROM o WHERE d = 2 UNION ALL SELECT '1-', o_custkey, o_orderkey FROM u WHERE d = 1
""")
def snapshot_ref(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    pick = lambda ref, name: divergence.referenced(o, ref, key="o_custkey", order="o_orderkey", name="o_orderpriority").select(F.lit(name).alias("ref"), "o_custkey", "o_orderkey")
    return pick(None, "latest").unionByName(pick("2", "2")).unionByName(pick("-2", "-2")).unionByName(pick("1-", "1-"))


OVERRIDES = [("data", "2999-12-31", "pattern_entropy", 30.0), ("data", "2999-12-31", "convention_drift", 0.001), ("old", "2001-01-01", "pattern_entropy", 900.0), ("logging", "2999-01-01", "pattern_entropy", 4.0)]
BASE = [("pattern_entropy", 2.0), ("convention_drift", 0.1)]
OVERRIDE_SQL = "ov(name, expires, dimension, value) AS (VALUES ('data', DATE '2999-12-31', 'pattern_entropy', 30.0), ('data', DATE '2999-12-31', 'convention_drift', 0.001), ('old', DATE '2001-01-01', 'pattern_entropy', 900.0), ('logging', DATE '2999-01-01', 'pattern_entropy', 4.0)), base(dimension, threshold) AS (VALUES ('pattern_entropy', 2.0), ('convention_drift', 0.1)), eff AS (SELECT dimension, CAST(greatest(threshold, coalesce((SELECT max(value) FROM ov WHERE ov.dimension = base.dimension AND expires >= current_date), threshold)) AS DOUBLE) AS threshold FROM base)"


def _thresholds(spark) -> DataFrame:
    overrides = spark.createDataFrame(OVERRIDES, "name string, expires string, dimension string, value double").withColumn("expires", F.col("expires").cast("date"))
    return divergence.effective_thresholds(spark.createDataFrame(BASE, "dimension string, threshold double"), divergence.active(overrides))


@query(f"WITH {OVERRIDE_SQL} SELECT dimension, threshold FROM eff")
def effective_threshold(spark, sf_dir):
    return _thresholds(spark)


@query(f"""WITH {INST}, {OVERRIDE_SQL}, d AS (SELECT repo_id, seq, pattern_entropy - lag(pattern_entropy) OVER w AS pattern_entropy, convention_drift - lag(convention_drift) OVER w AS convention_drift FROM measures WINDOW w AS (PARTITION BY repo_id ORDER BY seq)),
v AS (SELECT repo_id, seq, 'pattern_entropy' AS dimension, pattern_entropy AS value FROM d UNION ALL SELECT repo_id, seq, 'convention_drift', convention_drift FROM d)
SELECT repo_id, seq, dimension, value, threshold, coalesce(value > threshold, false) AS exceeded FROM v JOIN eff USING (dimension)""")
def threshold_check(spark, sf_dir):
    changes = divergence.deltas(_measures(spark, sf_dir).withColumn("version", F.lit("0.2.0")), TWO)
    return divergence.checks(changes, _thresholds(spark))


@query("SELECT event_id, '2024-01-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR), 2, '0') AS expires, DATE '2024-01-15' <= CAST('2024-01-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR), 2, '0') AS DATE) AS active FROM events")
def override_expiry(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("2024-01-"), F.lpad((F.col("event_id") % 31 + 1).cast("string"), 2, "0")).alias("expires"))
    held = divergence.active(e.withColumn("day", F.col("expires")).withColumn("expires", F.col("expires").cast("date")), F.lit("2024-01-15").cast("date")).select("event_id", F.lit(True).alias("active"))
    return e.join(held, "event_id", "left").select("event_id", "expires", F.coalesce("active", F.lit(False)).alias("active"))


# ---- graphs --------------------------------------------------------------------------------------------------------


def _trade(spark, sf_dir):
    vertices, imports, partition = tables.trade(spark, sf_dir)
    return vertices, imports, graph.edges_of(imports), partition


@query(f"WITH {TRADE} SELECT repo_id, seq, src, dst, weight FROM edges")
def edge_weights(spark, sf_dir):
    return _trade(spark, sf_dir)[2]


@query(f"WITH {TRADE} SELECT repo_id, seq, count(*) FILTER (dst = 'NATION_7') AS unresolved_count, count(*) FILTER (src = dst AND dst <> 'NATION_7') AS self_import_count FROM imports GROUP BY ALL")
def import_counts(spark, sf_dir):
    imports = _trade(spark, sf_dir)[1].withColumn("dst", F.when(F.col("dst") != "NATION_7", F.col("dst")))
    return graph.import_counts(imports)


@query(f"""WITH {TRADE} SELECT p.repo_id, p.seq, p.n AS node_count, coalesce(m, 0) AS edge_count, coalesce(m, 0) / (n * (n - 1)) AS density
FROM (SELECT repo_id, seq, count(*) AS n FROM part GROUP BY ALL) p LEFT JOIN (SELECT repo_id, seq, count(*) AS m FROM edges GROUP BY ALL) USING (repo_id, seq)""")
def density(spark, sf_dir):
    vertices, _, edges, _ = _trade(spark, sf_dir)
    return graph.density(vertices, edges)


@query(f"""WITH {TRADE}, d AS (SELECT repo_id, seq, file_path, coalesce(k, 0) >= 8 AS hub FROM part LEFT JOIN (SELECT repo_id, seq, dst AS file_path, count(*) AS k FROM edges GROUP BY ALL) USING (repo_id, seq, file_path))
SELECT repo_id, seq, count(*) FILTER (hub) / count(*) AS hub_concentration, coalesce(string_agg(file_path, ',' ORDER BY file_path) FILTER (hub), '') AS hub_nodes FROM d GROUP BY ALL""")
def hubs(spark, sf_dir):
    vertices, _, edges, _ = _trade(spark, sf_dir)
    return graph.hubs(vertices, edges, 8).withColumn("hub_nodes", F.array_join("hub_nodes", ","))


@query(f"WITH {TRADE} SELECT * FROM crossing")
def inter_cluster_edges(spark, sf_dir):
    _, _, edges, partition = _trade(spark, sf_dir)
    return graph.inter_cluster_edges(edges, partition)


@query(f"""WITH {TRADE}, t AS (SELECT e.repo_id, e.seq, s.cluster AS a, t.cluster AS b FROM edges e JOIN part s ON s.repo_id = e.repo_id AND s.seq = e.seq AND s.file_path = e.src JOIN part t ON t.repo_id = e.repo_id AND t.seq = e.seq AND t.file_path = e.dst),
u AS (SELECT repo_id, seq, a AS cluster, a <> b AS x FROM t UNION ALL SELECT repo_id, seq, b, true FROM t WHERE a <> b)
SELECT repo_id, seq, cluster, coalesce(r, 0.0) AS surface_area FROM (SELECT DISTINCT repo_id, seq, cluster FROM part) LEFT JOIN (SELECT repo_id, seq, cluster, avg(CAST(x AS INTEGER)) AS r FROM u GROUP BY ALL) USING (repo_id, seq, cluster)""")
def surface_area(spark, sf_dir):
    _, _, edges, partition = _trade(spark, sf_dir)
    return graph.surface_area(edges, partition)


@query(f"WITH {INST} SELECT repo_id, seq, count(DISTINCT cluster) AS cluster_count FROM part GROUP BY ALL")
def cluster_count(spark, sf_dir):
    return graph.cluster_count(tables.user_clusters(tables.instances(spark, sf_dir)))


@query(f"""WITH RECURSIVE {SPARSE}, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach(v, w) AS (SELECT CAST(s_suppkey AS VARCHAR), CAST(s_suppkey AS VARCHAR) FROM supplier UNION SELECT r.v, b.dst FROM reach r JOIN both_ways b ON b.src = r.w),
far(v, w, d) AS (SELECT DISTINCT src, src, 0 FROM edges UNION SELECT f.v, e.dst, d + 1 FROM far f JOIN edges e ON e.src = f.w WHERE d < 40)
SELECT (SELECT count(DISTINCT m) FROM (SELECT v, min(w) AS m FROM reach GROUP BY v)) AS component_count, (SELECT CAST(max(d) AS BIGINT) FROM (SELECT v, w, min(d) AS d FROM far GROUP BY v, w)) AS max_depth""")
def components_and_depth(spark, sf_dir):
    vertices, edges = tables.sparse(spark, sf_dir)
    return graph.structure(vertices, edges, one_task=0).select("component_count", "max_depth")


@query("""WITH RECURSIVE links AS (
  SELECT * FROM (SELECT l_suppkey AS src, min(l_partkey) * 7919 % (SELECT max(s_suppkey) FROM supplier) + 1 AS dst FROM lineitem GROUP BY l_suppkey) WHERE src <> dst
), reach(v, w) AS (SELECT src, dst FROM links UNION SELECT r.v, e.dst FROM reach r JOIN links e ON e.src = r.w)
SELECT printf('s%06d', v) AS file_path, printf('s%06d', max(w)) AS component FROM reach WHERE (w, v) IN (SELECT v, w FROM reach) GROUP BY v HAVING count(*) > 1""")
def strong_components(spark, sf_dir):
    """The suppliers that lie on cycles of links, and the last of each one's component."""
    names, links = reach.as_numbers(*tables.pointers(spark, sf_dir))
    named = names.select("v", "file_path")
    found = reach.strong_components(links).join(named, "v")
    return found.join(named.select(F.col("v").alias("component"), F.col("file_path").alias("last")), "component").select("file_path", F.col("last").alias("component"))


EVENT_EDGES = "edges AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst)"
CYCLES = f"""RECURSIVE {EVENT_EDGES}, paths(first, last, seen) AS (
  SELECT src, dst, [dst] FROM edges WHERE dst > src
  UNION ALL SELECT p.first, e.dst, list_append(p.seen, e.dst) FROM paths p JOIN edges e ON e.src = p.last WHERE e.dst > p.first AND NOT list_contains(p.seen, e.dst)
), cycles AS (SELECT count(*) AS cycle_count FROM paths p JOIN edges e ON e.src = p.last AND e.dst = p.first)"""


@query(f"WITH {CYCLES} SELECT 'events' AS repo_id, cycle_count, false AS cycle_count_capped FROM cycles")
def cycle_count(spark, sf_dir):
    vertices, edges = tables.transitions(spark, sf_dir)
    return graph.cycles(vertices, edges, one_task=0).select("repo_id", "cycle_count", "cycle_count_capped")


@query(f"""WITH {CYCLES}, n AS (SELECT count(DISTINCT event_type) AS n FROM events), m AS (SELECT count(*) AS m FROM edges), h AS (SELECT count(*) AS h FROM (SELECT dst FROM edges GROUP BY dst HAVING count(*) >= 3)),
far(v, w, d) AS (SELECT DISTINCT src, src, 0 FROM edges UNION SELECT f.v, e.dst, d + 1 FROM far f JOIN edges e ON e.src = f.w WHERE d < (SELECT count(DISTINCT event_type) FROM events)),
depth AS (SELECT max(d) AS depth FROM (SELECT v, w, min(d) AS d FROM far GROUP BY v, w))
SELECT (m / (n * (n - 1)) + h / n + least(1.0, cycle_count / greatest(1, n)) + least(1.0, depth / greatest(1, n))) / 4 AS coupling_topology FROM cycles, n, m, h, depth""")
def coupling_composite(spark, sf_dir):
    vertices, edges = tables.transitions(spark, sf_dir)
    key = ["repo_id", "seq"]
    metrics = graph.density(vertices, edges).join(graph.hubs(vertices, edges), key).join(graph.whole_graph(vertices, edges, one_task=0), key)
    return divergence.coupling(metrics).select("coupling_topology")


# ---- modules and boundaries ----------------------------------------------------------------------------------------


def _members(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    _, _, edges, partition = _trade(spark, sf_dir)
    members = intent.with_modules(partition, tables.MODULES)
    return members, graph.inter_cluster_edges(edges, partition)


def _violations(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    members, crossing = _members(spark, sf_dir)
    pairs = intent.module_edges(crossing, intent.cluster_modules(members))
    allowed = spark.createDataFrame(tables.ALLOWED, "from_module string, to_module string")
    layers, of_module = spark.createDataFrame(tables.LAYERS, "layer string, rank int"), spark.createDataFrame(tables.MODULE_LAYERS, "module string, layer string")
    return intent.misplaced_files(members), intent.unauthorized(pairs, allowed), intent.layer_violations(pairs, of_module, layers), crossing


@query(f"WITH {TRADE} SELECT repo_id, seq, file_path, module FROM members")
def file_to_module(spark, sf_dir):
    return _members(spark, sf_dir)[0].drop("cluster")


@query(f"WITH {TRADE} SELECT repo_id, seq, cluster, module FROM (SELECT DISTINCT repo_id, seq, cluster FROM part) LEFT JOIN of_cluster USING (repo_id, seq, cluster)")
def cluster_module(spark, sf_dir):
    return intent.cluster_modules(_members(spark, sf_dir)[0])


@query(f"WITH {TRADE} SELECT * FROM misplaced")
def misplaced_files(spark, sf_dir):
    return _violations(spark, sf_dir)[0]


@query(f"WITH {TRADE} SELECT * FROM unauthorized")
def unauthorized(spark, sf_dir):
    return _violations(spark, sf_dir)[1]


@query(f"WITH {TRADE} SELECT * FROM layered")
def layer_violations(spark, sf_dir):
    return _violations(spark, sf_dir)[2]


@query(f"""WITH {TRADE}, t AS (SELECT repo_id, seq, 1 AS n FROM misplaced UNION ALL SELECT repo_id, seq, 1 FROM unauthorized UNION ALL SELECT repo_id, seq, 1 FROM layered UNION ALL SELECT repo_id, seq, count FROM crossing)
SELECT repo_id, seq, CAST(sum(n) AS BIGINT) AS boundary_violations FROM t GROUP BY ALL""")
def boundary_violations(spark, sf_dir):
    misplaced, crossing, layered, edges = _violations(spark, sf_dir)
    return intent.boundary_violations(edges, intent.total_violations(misplaced, crossing, layered))


@query(f"WITH {TRADE} SELECT repo_id, seq, 'cluster_' || cluster AS module, array_to_string(list_sort(list(file_path))[1:5], ',') AS paths, CAST(greatest(count(*) - 5, 0) AS INTEGER) AS more FROM part GROUP BY repo_id, seq, cluster")
def propose_boundaries(spark, sf_dir):
    return intent.proposed_modules(_members(spark, sf_dir)[0]).withColumn("paths", F.array_join("paths", ","))


# ---- state across snapshots ----------------------------------------------------------------------------------------


def _observed(spark, sf_dir) -> DataFrame:
    """The event types of each user in time order, as a cluster seen in each run; every 13th run is missing."""
    e = tables.read(spark, sf_dir, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    raw = F.when(F.col("event_id") % 3 == 0, F.length("event_type").cast("long")).otherwise(F.lit(5).cast("long"))
    return e.select(F.lit("events").alias("repo_id"), F.col("user_id").cast("string").alias("file_path"), seq.alias("seq"), raw.alias("raw")).filter("seq % 13 <> 0")


OBSERVED = "obs AS (SELECT file_path, seq, raw FROM (SELECT CAST(user_id AS VARCHAR) AS file_path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CASE WHEN event_id % 3 = 0 THEN length(event_type) ELSE 5 END AS raw FROM events) WHERE seq % 13 <> 0)"


@query(f"""WITH RECURSIVE {OBSERVED}, o AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY seq) AS i FROM obs),
s(file_path, i, seq, stable, candidate, consecutive) AS (
  SELECT file_path, i, seq, raw, raw, CAST(0 AS BIGINT) FROM o WHERE i = 1
  UNION ALL SELECT o.file_path, o.i, o.seq,
    CASE WHEN o.seq <> s.seq + 1 OR o.raw = s.stable THEN CASE WHEN o.seq <> s.seq + 1 THEN o.raw ELSE s.stable END WHEN CASE WHEN s.candidate = o.raw THEN s.consecutive + 1 ELSE 1 END >= 3 THEN o.raw ELSE s.stable END,
    CASE WHEN o.seq <> s.seq + 1 THEN o.raw WHEN o.raw = s.stable THEN s.stable ELSE o.raw END,
    CASE WHEN o.seq <> s.seq + 1 OR o.raw = s.stable THEN 0 WHEN CASE WHEN s.candidate = o.raw THEN s.consecutive + 1 ELSE 1 END >= 3 THEN 0 ELSE CASE WHEN s.candidate = o.raw THEN s.consecutive + 1 ELSE 1 END END
  FROM s JOIN o ON o.file_path = s.file_path AND o.i = s.i + 1)
SELECT 'events' AS repo_id, file_path, stable, candidate, consecutive, seq FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY i DESC) AS r FROM s) WHERE r = 1""")
def debounce_replay(spark, sf_dir):
    return debounce.replay(_observed(spark, sf_dir))


@query(f"""WITH {INST}, b AS (SELECT repo_id, seq, cluster, CASE WHEN lag(seq) OVER w = seq - 1 THEN lag(cluster) OVER w END AS before FROM part WINDOW w AS (PARTITION BY repo_id, file_path ORDER BY seq))
SELECT repo_id, seq, coalesce(avg(CASE WHEN before IS NOT NULL THEN CAST(before = cluster AS INTEGER) END), 1.0) AS stability_score FROM b GROUP BY ALL""")
def stability_score(spark, sf_dir):
    return debounce.stability(tables.user_clusters(tables.instances(spark, sf_dir)))


@query(f"""WITH {INST}, now AS (SELECT DISTINCT repo_id, file_path FROM inst WHERE seq = (SELECT max(seq) FROM inst)), before AS (SELECT repo_id, file_path, cluster FROM part WHERE seq = (SELECT max(seq) - 1 FROM inst))
SELECT repo_id, file_path, coalesce(cluster, 0) AS cluster FROM now LEFT JOIN before USING (repo_id, file_path)""")
def warm_start(spark, sf_dir):
    found = tables.instances(spark, sf_dir)
    top = F.broadcast(found.agg(F.max("seq").alias("top")))  # one row
    now = found.join(top, F.col("seq") == F.col("top")).select("repo_id", "file_path").distinct()
    before = tables.user_clusters(found).join(top, F.col("seq") == F.col("top") - 1).select("repo_id", "file_path", "cluster")
    return debounce.initial_membership(now, before)


# ---- clustering and parsing ----------------------------------------------------------------------------------------


@query()
def leiden_partition(spark, sf_dir):
    vertices, _, edges, _ = _trade(spark, sf_dir)
    return leiden.communities(vertices, edges)


@query("SELECT printf('s%06d', s_suppkey) AS file_path, printf('s%06d', min(s_suppkey) OVER (PARTITION BY s_nationkey)) AS first_of_cluster FROM supplier")
def leiden_planted(spark, sf_dir):
    """Suppliers linked within their nation: the communities are the nations; each is named by its first member."""
    found = communities.communities(*tables.planted(spark, sf_dir))
    first = F.min("file_path").over(Window.partitionBy("repo_id", "seq", "cluster"))
    return found.select("file_path", first.alias("first_of_cluster"))


@query(f"WITH {TRADE} SELECT repo_id, seq, count(*) AS files, true AS no_worse_than_one_cluster FROM part GROUP BY ALL")
def leiden_quality(spark, sf_dir):
    """The quality that Leiden optimises is never below that of one cluster for all, which is 0."""
    vertices, _, edges, _ = _trade(spark, sf_dir)
    found = leiden.communities(vertices, edges)
    quality = leiden.modularity(edges, found)
    return found.groupBy("repo_id", "seq").agg(F.count(F.lit(1)).alias("files")).join(quality, ["repo_id", "seq"]).select("repo_id", "seq", "files", (F.col("modularity") >= -1e-9).alias("no_worse_than_one_cluster"))


@query("SELECT printf('s%06d', s_suppkey) AS file_path, CAST(s_nationkey + 100 AS BIGINT) AS cluster FROM supplier")
def leiden_labels(spark, sf_dir):
    """Communities take over the labels that they had in the run before."""
    vertices, edges = tables.planted(spark, sf_dir)
    nation = tables.read(spark, sf_dir, "supplier").select(F.format_string("s%06d", "s_suppkey").alias("file_path"), (F.col("s_nationkey") + 100).cast("long").alias("before"))
    return communities.communities(vertices.join(nation, "file_path"), edges).select("file_path", "cluster")


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS hub FROM supplier), e AS (SELECT * FROM s WHERE s_suppkey <> hub),
n AS (SELECT count(*) AS k FROM e GROUP BY s_nationkey), m AS (SELECT count(*) AS m FROM e)
SELECT CAST(m AS BIGINT) AS edges, round(1 - (SELECT sum(k * k) FROM n) / (m * m), 9) AS modularity FROM m""")
def communities_quality(spark, sf_dir):
    """The quality of the communities that are found among suppliers linked within their nation: that of the nations."""
    vertices, edges = tables.planted(spark, sf_dir)
    quality = leiden.modularity(edges, communities.communities(vertices, edges))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    return m.join(quality, F.lit(True), "left").select("edges", F.round("modularity", 9).alias("modularity"))


SOURCES = {
    "python": "import os\nfrom a.b import c\n\n\ndef f{n}(x):\n    try:\n        log.info(x)\n    except E:\n        db.query({n})\n",
    "shell": "#!/bin/sh\nset -eu\n. ./lib.sh\nf{n}() {{\n  curl x | jq . | tee y\n}}\nf{n} || exit {n}\n",
    "typescript": "import {{a}} from './m{n}';\nexport function f{n}() {{ try {{ console.log({n}); }} catch (e) {{ }} }}\n",
    "go": "package p\nimport \"fmt\"\nfunc F{n}() error {{\n if err != nil {{ return err }}\n return nil\n}}\n",
    "javascript": "const a = require('./m{n}');\n// no line\nclass K{n} {{}}\nconsole.error({n});\n",
    "java": "import a.b.C{n};\n/* no\n line */\npublic class K{n} {{\n void f() {{ try {{ g(); }} catch (E e) {{ }} }}\n}}\n",
    "rust": "use std::io;\nmod m{n};\npub fn f{n}(x: R) -> u8 {{\n match x {{ Ok(v) => v, Err(e) => e }}\n}}\n",
}


def _sources(spark, sf_dir) -> DataFrame:
    """A source file for each page, written from a template of one of the languages."""
    names = sorted(SOURCES)
    pick = lambda of: F.element_at(F.array(*[F.lit(of(n)) for n in names]), (F.col("page_id") % len(names) + 1).cast("int"))
    text = F.replace(F.replace(F.replace(pick(SOURCES.get), F.lit("{n}"), F.col("page_id").cast("string")), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))
    return tables.read(spark, sf_dir, "pages").select(F.lit("r").alias("repo_id"), F.lit(0).cast("long").alias("seq"), F.concat(F.lit("src/p"), F.col("page_id").cast("string")).alias("path"), pick(lambda n: n).alias("language"), text.cast("binary").alias("content"))


@query("""SELECT 'src/p' || page_id AS file_path, ['go', 'java', 'javascript', 'python', 'rust', 'shell', 'typescript'][page_id % 7 + 1] AS language,
  CASE page_id % 7 WHEN 0 THEN 'fmt' WHEN 1 THEN 'a.b.C' || page_id WHEN 2 THEN './m' || page_id WHEN 3 THEN 'os,a.b' WHEN 4 THEN 'std::io,./m' || page_id WHEN 5 THEN 'src/lib.sh' ELSE './m' || page_id END AS imports,
  CASE page_id % 7 WHEN 0 THEN 'F' || page_id WHEN 1 THEN 'K' || page_id WHEN 2 THEN 'a,K' || page_id ELSE 'f' || page_id END AS symbols,
  CASE page_id % 7 WHEN 0 THEN 'error_handling' WHEN 1 THEN 'error_handling' WHEN 2 THEN 'logging' WHEN 3 THEN 'data_access,error_handling,logging' WHEN 4 THEN 'error_handling'
    WHEN 5 THEN 'async_patterns,data_access,data_access,' || CASE WHEN page_id > 0 THEN 'error_handling,' ELSE '' END || 'error_handling,error_handling,logging' ELSE 'error_handling,logging' END AS patterns,
  CAST(CASE page_id % 7 WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 3 WHEN 3 THEN 7 WHEN 4 THEN 5 WHEN 5 THEN 6 ELSE 2 END AS INTEGER) AS lines_of_code, CAST(NULL AS VARCHAR) AS parse_error FROM pages""")
def parse_features(spark, sf_dir):
    """Imports, symbols, categories of patterns, and lines of code in seven languages."""
    found = parsers.parse_files(_sources(spark, sf_dir))
    return found.select("file_path", "language", F.array_join("imports", ",").alias("imports"), F.array_join("symbols", ",").alias("symbols"), F.array_join(F.array_sort("pattern_instances.category"), ",").alias("patterns"), "lines_of_code", "parse_error")


@query("""SELECT 'src/p' || page_id AS file_path, page_id % 3 = 0 AS from_cache FROM pages""")
def parse_cache(spark, sf_dir):
    """Of files whose path and content a run has seen before, the features are taken from it; others are parsed."""
    found = _sources(spark, sf_dir)
    n = F.regexp_extract("path", "[0-9]+$", 0).cast("long")
    seen = found.filter(n % 3 != 2).withColumn("content", F.when(n % 3 == 1, F.lit(b"old")).otherwise(F.col("content")))
    cache = parsers.parse_files(seen).withColumn("symbols", F.array(F.lit("cached")))
    return parsers.parse_changed(found.withColumn("seq", F.lit(1).cast("long")), cache).select("file_path", F.array_contains("symbols", "cached").alias("from_cache"))


# ---- trees, imports of several languages, shapes --------------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 6 THEN true ELSE false END AS is_script FROM documents""")
def shebang(spark, sf_dir):
    """Whether a text's first line names a shell."""
    heads = ["#!/bin/bash", "#!/usr/bin/env zsh", "#! /bin/sh -e", "#!/usr/bin/env python", "#!/usr/bin/bashbrew", "", "#!dash", " #!/bin/sh"]
    head = F.element_at(F.array(*map(F.lit, heads)), (F.col("doc_id") % 8 + 1).cast("int"))
    d = tables.read(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).cast("binary").alias("content"))
    return d.select("doc_id", files.is_shell_script(F.col("content")).alias("is_script"))


@query("""
WITH p AS (SELECT page_id, ['src/a/m', 'vendor/m', 'x/node_modules/y/m', 'docs/m', 'src/build/m', 'keep/gen/m', 'gen/m', 'gen/keep'][page_id % 8 + 1] || page_id || ['.py', '.ts', '.md', '', '.go'][page_id % 5 + 1] AS path FROM pages)
SELECT path, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 4 THEN 'go' END AS language FROM p
WHERE page_id % 5 IN (0, 1, 4) AND page_id % 8 IN (0, 3, 5, 7)
""")
def tree_scan(spark, sf_dir):
    """Paths in a known language that neither the default exclusions nor an ignore file (with a negation) leave out."""
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("page_id") % len(x) + 1).cast("int"))
    path = F.concat(pick("src/a/m", "vendor/m", "x/node_modules/y/m", "docs/m", "src/build/m", "keep/gen/m", "gen/m", "gen/keep"), F.col("page_id").cast("string"), pick(".py", ".ts", ".md", "", ".go"))
    listed = tables.read(spark, sf_dir, "pages").select(path.alias("path"))
    rules = ["# made by a tool", "/gen/*", "!/gen/keep*"]
    kept = listed.filter(~globs.ignored(F.col("path"), rules) & ~globs.ignored(F.col("path"), EXCLUDED))
    return kept.select("path", files.language(F.col("path")).alias("language")).filter("language IS NOT NULL")


@query("""
WITH p AS (SELECT page_id AS k, page_id + 3 AS t, (page_id + 3) IN (SELECT page_id FROM pages) AS there FROM pages)
SELECT 'pkg/m' || k || '.py' AS src, 'pkg.m' || t AS import, CASE WHEN there THEN 'pkg/m' || t || '.py' END AS dst FROM p WHERE k % 3 = 0
UNION ALL SELECT 'pkg/m' || k || '.py', 'os', NULL FROM p WHERE k % 3 = 0
UNION ALL SELECT 's/m' || k || '.sh', 's/m' || t, CASE WHEN there THEN 's/m' || t || '.sh' END FROM p WHERE k % 3 = 1
UNION ALL SELECT 'w/m' || k || '.ts', '@w/m' || t, CASE WHEN there THEN 'w/m' || t || '.ts' END FROM p WHERE k % 3 = 2
UNION ALL SELECT 'w/m' || k || '.ts', 'type:./m' || t || '.js', CASE WHEN there THEN 'w/m' || t || '.ts' END FROM p WHERE k % 3 = 2
UNION ALL SELECT 'w/m' || k || '.ts', 'react', NULL FROM p WHERE k % 3 = 2
UNION ALL SELECT 'w/m' || k || '.ts', './m' || t || '.css', NULL FROM p WHERE k % 3 = 2
""")
def import_dispatch(spark, sf_dir):
    """Imports of files in three languages, each resolved by its own rules; one path alias."""
    k = F.col("page_id").cast("string")
    t = (F.col("page_id") + 3).cast("string")
    by = lambda *x: F.element_at(F.array(*x), (F.col("page_id") % 3 + 1).cast("int"))
    imports = by(F.array(F.concat(F.lit("pkg.m"), t), F.lit("os")), F.array(F.concat(F.lit("s/m"), t)), F.array(F.concat(F.lit("@w/m"), t), F.concat(F.lit("type:./m"), t, F.lit(".js")), F.lit("react"), F.concat(F.lit("./m"), t, F.lit(".css"))))
    path = by(F.concat(F.lit("pkg/m"), k, F.lit(".py")), F.concat(F.lit("s/m"), k, F.lit(".sh")), F.concat(F.lit("w/m"), k, F.lit(".ts")))
    features = tables.read(spark, sf_dir, "pages").select(F.lit("r").alias("repo_id"), F.lit(0).cast("long").alias("seq"), path.alias("file_path"), by(F.lit("python"), F.lit("shell"), F.lit("typescript")).alias("language"), imports.alias("imports"))
    return resolve.resolve(features, {"r": [("@w/*", ["none/*", "w/*"])]}).select("src", "import", "dst")


@query("""
SELECT event_id, event_type || '(_ID_,arguments(_STR_,pair(_ID_,_INT_)))' AS form, substr(sha256(event_type || '(_ID_,arguments(_STR_,pair(_ID_,_INT_)))'), 1, 16) AS shape, 7 AS nodes FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, event_type || '(block(return),_NONE_)', NULL, 4 FROM events WHERE event_id % 2 = 1
""")
def structural_hash(spark, sf_dir):
    """The normal form of small syntax trees, their hash and their nodes; trees below five nodes have no hash."""
    tree = lambda *x: F.array(*[F.struct(F.lit(d).alias("depth"), (F.lit(t) if t else F.col("event_type")).alias("type")) for d, t in x])
    large = tree((0, None), (1, "identifier"), (1, "arguments"), (2, "string"), (2, "pair"), (3, "name"), (3, "integer"))
    small = tree((0, None), (1, "block"), (2, "return"), (1, "null"))
    e = tables.read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, large).otherwise(small).alias("nodes"))
    return e.select("event_id", shapes.normal_form_of(F.col("nodes")).alias("form"), shapes.structural_hash_of(F.col("nodes"), 5).alias("shape"), F.size("nodes").alias("nodes"))


# ---- states, streams, snapshots and settings ------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {OBSERVED}, runs AS (SELECT seq, row_number() OVER (ORDER BY seq) AS run FROM (SELECT DISTINCT seq FROM obs)),
o AS (SELECT file_path, seq, raw, run, row_number() OVER (PARTITION BY file_path ORDER BY seq) AS i FROM obs JOIN runs USING (seq)),
s(file_path, i, seq, run, stable, candidate, consecutive) AS (
  SELECT file_path, i, seq, run, raw, raw, CAST(0 AS BIGINT) FROM o WHERE i = 1
  UNION ALL SELECT o.file_path, o.i, o.seq, o.run,
    CASE WHEN o.run <> s.run + 1 OR o.raw = s.stable THEN CASE WHEN o.run <> s.run + 1 THEN o.raw ELSE s.stable END WHEN CASE WHEN s.candidate = o.raw THEN s.consecutive + 1 ELSE 1 END >= 3 THEN o.raw ELSE s.stable END,
    CASE WHEN o.run <> s.run + 1 THEN o.raw WHEN o.raw = s.stable THEN s.stable ELSE o.raw END,
    CASE WHEN o.run <> s.run + 1 OR o.raw = s.stable THEN 0 WHEN CASE WHEN s.candidate = o.raw THEN s.consecutive + 1 ELSE 1 END >= 3 THEN 0 ELSE CASE WHEN s.candidate = o.raw THEN s.consecutive + 1 ELSE 1 END END
  FROM s JOIN o ON o.file_path = s.file_path AND o.i = s.i + 1)
SELECT 'events' AS repo_id, seq, file_path, stable, candidate, consecutive FROM s""")
def stable_partition(spark, sf_dir):
    """The debounced cluster of each file after each run."""
    return debounce.stable_partition(_observed(spark, sf_dir))


@query(ORACLES["debounce_replay"])
def streaming_debounce(spark, sf_dir):
    """The same states by a stream whose runs come in three parts, out of order, and which starts again for each part."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    observed = _observed(spark, sf_dir)
    parts = observed.withColumn("part", F.pmod(F.xxhash64("seq"), F.lit(3)))
    parts.write.partitionBy("part").parquet(f"{folder}/parts")
    keep = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")
    for part in range(3):
        spark.read.schema(parts.schema).parquet(f"{folder}/parts").filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = streaming.debounced(spark.readStream.schema(observed.schema).parquet(f"{folder}/in"))
        stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    found = spark.read.parquet(f"{folder}/out")
    return found.groupBy("repo_id", "file_path").agg(F.max_by(F.struct("stable", "candidate", "consecutive", "seq"), "batch").alias("s")).select("repo_id", "file_path", "s.*")


@query(f"""WITH {INST}, {BY_LANGUAGE} SELECT repo_id, seq, language, pattern_entropy, CAST(row_number() OVER (PARTITION BY repo_id, seq ORDER BY pattern_entropy DESC, language) AS INTEGER) AS place FROM by_language""")
def languages_by_entropy(spark, sf_dir):
    found = entropy_by_language(spark, sf_dir)
    return found.withColumn("place", F.row_number().over(Window.partitionBy("repo_id", "seq").orderBy(F.desc("pattern_entropy"), "language")))


@query(f"""WITH {INST}, m AS (SELECT seq, pattern_entropy, convention_drift, row_number() OVER (ORDER BY seq) AS r, count(*) OVER () AS n FROM measures)
SELECT CAST(r - greatest(n - 8, 0) AS BIGINT) AS seq, CAST(seq AS VARCHAR) AS commit_sha, pattern_entropy, convention_drift FROM m WHERE r > n - 8""")
def snapshot_store(spark, sf_dir):
    """Each week's measures written as a snapshot file, the oldest beyond eight removed, and all read as one table."""
    folder = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("seq") * 7).cast("int")).cast("string")
    stamp = F.concat(day, F.lit("T00:00:00Z")).alias("timestamp")
    body = F.to_json(F.struct(stamp, F.col("seq").cast("string").alias("commit_sha"), F.struct(*TWO).alias("divergence"))).alias("body")
    snapshots.write(_measures(spark, sf_dir).select(F.lit("events").alias("repo_id"), stamp, body), folder, retention=8)
    found = snapshots.read(spark, folder).select("seq", F.from_json("body", store.SCHEMA).alias("s"))
    return found.select("seq", "s.commit_sha", "s.divergence.pattern_entropy", "s.divergence.convention_drift")


def _values(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


@query("""SELECT * FROM (VALUES ('core.random_seed', '7'), ('core.log_level', 'INFO'), ('snapshots.retention', '5'), ('patterns.min_pattern_nodes', '5'), ('pattern_entropy', '9.0'), ('convention_drift', '0.1'), ('coupling_topology', '0.15'), ('boundary_violations', '5.0'), ('without expiry', 'refused')) AS t(name, value)""")
def settings_layers(spark, sf_dir):
    """Settings of a global file, a project's over them, the environment's over both; thresholds with overrides that hold."""
    folder = Path(tempfile.mkdtemp())
    (folder / "config/drift").mkdir(parents=True)
    (folder / settings.FOLDER).mkdir()
    (folder / "config/drift/config.toml").write_text("[core]\nrandom_seed = 3\nlog_level = 'ERROR'\n[snapshots]\nretention = 5\n")
    own = folder / settings.FOLDER / "config.toml"
    own.write_text("[core]\nrandom_seed = 7\n[thresholds.overrides.a]\nexpires = '2999-01-01'\npattern_entropy_rate = 9.0\n[thresholds.overrides.b]\nexpires = '2001-01-01'\nconvention_drift_rate = 9.0\n")
    before = {k: os.environ.get(k) for k in ("XDG_CONFIG_HOME", "DRIFT_LOG_LEVEL")}
    os.environ |= {"XDG_CONFIG_HOME": str(folder / "config"), "DRIFT_LOG_LEVEL": "INFO"}
    try:
        found = settings.load(str(folder))
        own.write_text("[thresholds.overrides.a]\nreason = 'none'\n")
        try:
            settings.load(str(folder))
            refused = "taken"
        except settings.SettingsError:
            refused = "refused"
    finally:
        for k, v in before.items():
            os.environ.pop(k)
            os.environ |= {k: v} if v is not None else {}
    rows = [(f"{a}.{b}", found[a][b]) for a, b in (("core", "random_seed"), ("core", "log_level"), ("snapshots", "retention"), ("patterns", "min_pattern_nodes"))]
    return _values(spark, rows + list(settings.thresholds(found).items()) + [("without expiry", refused)])


@query("""SELECT * FROM (VALUES ('web', 'web/|top'), ('core', 'core/,lib/|None'), ('layers', 'top>low|downward'), ('allowed', 'web>core'), ('planned', 'core>a,b'), ('malformed', 'line 2'), ('absent', 'None'), ('@/*', 'src/*'), ('lib', 'src/lib/index.ts')) AS t(name, value)""")
def boundary_spec(spark, sf_dir):
    """A specification of modules and the path aliases of a project, as they are read."""
    folder = Path(tempfile.mkdtemp())
    (folder / "b.yaml").write_text("boundaries:\n  version: 1\n  modules:\n    - {name: web, paths: [web/], layer: top}\n    - {name: core, paths: [core/, lib/]}\n  layers: {direction: downward, ordering: [top, low]}\n  allowed_cross_domain: [{from: web, to: core}]\n  aspirational_splits: [{current_module: core, intended_boundary: [a, b]}]\n")
    (folder / "bad.yaml").write_text("boundaries:\n  - : [\n")
    (folder / "jsconfig.json").write_text('{ // comment\n "compilerOptions": {"baseUrl": "./src", "paths": {"@/*": ["./*"], "lib": ["lib/index.ts"],},},\n}')
    spec = settings.specification(str(folder / "b.yaml"))
    try:
        bad = settings.specification(str(folder / "bad.yaml"))
    except settings.SettingsError as e:
        bad = re.search(r"line \d+", str(e))[0]
    rows = [(n, f"{','.join(p)}|{layer}") for n, p, layer in spec.modules] + [("layers", f"{'>'.join(spec.layers)}|{spec.direction}"), ("allowed", ">".join(spec.allowed[0])), ("planned", f"{spec.splits[0][0]}>{','.join(spec.splits[0][1])}")]
    return _values(spark, rows + [("malformed", bad), ("absent", settings.specification(str(folder / "none.yaml")))] + [(k, ",".join(v)) for k, v in settings.aliases(str(folder))])


# ---- subtrees of pages, the store of features ------------------------------------------------------------------------

FORMS = r"""
p AS (SELECT page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<(?:script|style)[^>]*>).*?(</(?:script|style)>)', '\1\2', 'g'), '<(/?[A-Za-z][A-Za-z0-9]*)', 1) AS tags FROM pages),
x AS (SELECT page_id, lower(unnest(tags)) AS tag, CAST(generate_subscripts(tags, 1) - 1 AS INTEGER) AS pos FROM p),
u AS (SELECT *, CASE WHEN ltrim(tag, '/') IN (LEAVES) THEN 0 WHEN starts_with(tag, '/') THEN -1 ELSE 1 END AS step FROM x),
r AS (SELECT *, coalesce(sum(step) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS level FROM u),
d AS (SELECT *, level - least(0, min(level) OVER (PARTITION BY page_id ORDER BY pos)) AS depth FROM r),
n AS (SELECT page_id, pos, depth, tag FROM d WHERE NOT starts_with(tag, '/')),
e AS (SELECT a.page_id, a.pos, a.depth, min(b.pos) AS stop FROM n a LEFT JOIN n b ON b.page_id = a.page_id AND b.pos > a.pos AND b.depth <= a.depth GROUP BY ALL),
f AS (SELECT e.page_id, e.pos, e.depth, count(*) AS nodes, string_agg(n.depth - e.depth || ':' || n.tag, ',' ORDER BY n.pos) AS form
  FROM e JOIN n ON n.page_id = e.page_id AND n.pos >= e.pos AND (e.stop IS NULL OR n.pos < e.stop) GROUP BY ALL)
""".replace("LEAVES", ", ".join(f"'{x}'" for x in tables.LEAVES))


@query(f"""WITH {FORMS}, c AS (SELECT form, min(nodes) AS nodes, count(*) AS occurrences, count(DISTINCT page_id) AS trees, min((page_id, pos)) AS first FROM f GROUP BY form)
SELECT nodes, occurrences, trees, first[1] AS first_tree, first[2] AS first_at FROM c""")
def subtree_classes(spark, sf_dir):
    """Every form of a part of a page's tree: its size, how often it occurs, in how many pages, and where first."""
    return subtrees.classes(subtrees.hashed(tables.page_nodes(spark, sf_dir))).drop("hash")


@query(f"""WITH {FORMS}, c AS (SELECT form, count(*) AS occurrences FROM f WHERE nodes > 1 GROUP BY form HAVING count(*) > 1), g AS (SELECT f.*, occurrences FROM f JOIN c USING (form)),
h AS (SELECT g.page_id, g.pos, max(n.pos) AS parent FROM g JOIN n ON n.page_id = g.page_id AND n.pos < g.pos AND n.depth = g.depth - 1 GROUP BY ALL)
SELECT g.page_id AS tree_id, g.pos AS "at", g.nodes, g.occurrences FROM g LEFT JOIN h USING (page_id, pos) LEFT JOIN g k ON k.page_id = g.page_id AND k.pos = h.parent WHERE k.pos IS NULL""")
def repeated_subtrees(spark, sf_dir):
    """The largest parts of pages' trees that occur more than once: what stands around them does not."""
    return subtrees.largest(subtrees.hashed(tables.page_nodes(spark, sf_dir))).drop("hash")


@query("""
WITH d AS (SELECT 'd' || doc_id AS file_path, sha256(coalesce(text, '')) AS content_hash, sha256(upper(coalesce(text, ''))) AS edited, coalesce(lang, '') AS lang FROM documents)
SELECT file_path, CASE lang WHEN 'es' THEN edited ELSE content_hash END AS content_hash, CAST(CASE WHEN lang = 'de' THEN 3 WHEN lang = 'fr' OR lang = 'es' AND edited <> content_hash THEN 4 ELSE 1 END AS INTEGER) AS part FROM d
""")
def cache_store(spark, sf_dir):
    """The store of features after four runs over all documents, and the run that wrote each row.

    German files are gone in the second run, French ones in the third; the fourth has all, Spanish ones edited.
    """
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", text.alias("text"), lang.alias("lang"))
    edited = docs.withColumn("text", F.when(F.col("lang") == "es", files.simple_upper(F.col("text"))).otherwise(F.col("text")))
    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    for rows in (docs, docs.filter("lang <> 'de'"), docs.filter("lang <> 'fr'"), edited):
        of = {"repo_id": F.lit(""), "seq": F.lit(0), "file_path": F.concat(F.lit("d"), F.col("doc_id").cast("string")), "language": F.col("lang"), "lines_of_code": files.lines_of_code(F.col("text")), "content_hash": F.sha2("text", 256)}
        features_cache.write_features(folder, rows.select(*[of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in features_cache.fields(spark)]))
    return features_cache.read_parts(spark, folder).select("file_path", "content_hash", "part")
