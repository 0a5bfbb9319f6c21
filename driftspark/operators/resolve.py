"""Imports to files: every rule becomes candidates with a priority, found by one equi-join.

A dotted import matches a module key exactly or by its longest dotted suffix; a shell path as it is or with a shell
extension; a JavaScript or TypeScript path through aliases, extensions and index files. Each import is spread out into
the keys that it may stand for, in the order in which they count, joined to the files' keys, and keeps the first hit.
So no rule needs a nested loop over all modules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The extensions that are tried, in order.
SHELL_EXTENSIONS = (".sh", ".bash", ".zsh", ".ksh", ".dash", ".ash")
SHELL_TRIED = (".sh", ".bash")
JS_TRIED = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts")
JS_INDEX = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")


def normal_path(path: Column) -> Column:
    """A POSIX path without ``.``, empty and ``..`` parts; leading ``..`` stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda out, p: F.when((p == "..") & (F.size(out) > 0) & (F.coalesce(F.element_at(out, -1), F.lit("")) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def module_key(path: Column) -> Column:
    """The dotted key of a Python file, of a package by its folder; null for others."""
    stem = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", "")
    dotted = F.regexp_replace(F.replace(stem, F.lit("/"), F.lit(".")), r"^src\.", "")
    return F.when(path.endswith(".py") & (dotted != ""), dotted)


def suffixes(dotted: Column) -> Column:
    """(key, priority): the dotted name and all its dotted suffixes, the longest first."""
    parts = F.split(dotted, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".").alias("key"), (i - 1).alias("priority")))


def shell_candidates(path: Column) -> Column:
    """The path as it is; without a known extension also with the ones that are tried."""
    known = F.lit(False)
    for e in SHELL_EXTENSIONS:
        known = known | path.endswith(e)
    one = lambda p, i: F.struct(p.alias("key"), F.lit(i).alias("priority"))
    return F.when(known, F.array(one(path, 0))).otherwise(F.array(one(path, 0), *[one(F.concat(path, F.lit(e)), i + 1) for i, e in enumerate(SHELL_TRIED)]))


SOURCE = r"\.(ts|tsx|js|jsx|mjs|cjs)$"


def is_asset(path: Column) -> Column:
    """Whether a path has an extension that no source file has."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return name.rlike(r".\.[^.]+$") & ~name.rlike(SOURCE)


def js_candidates(path: Column) -> Column:
    """Exact, ``.js`` as TypeScript, extensions, index files; nothing beyond the path itself for assets."""
    stem = F.regexp_replace(path, r"\.js$", "")
    rewritten = [F.when(path.endswith(".js"), F.concat(stem, F.lit(e))) for e in (".ts", ".tsx")]
    tried = [path, *rewritten, *[F.concat(path, F.lit(e)) for e in JS_TRIED], *[F.concat(path, F.lit(f"/index{e}")) for e in JS_INDEX]]
    every = F.array(*[F.struct(p.alias("key"), F.lit(i).alias("priority")) for i, p in enumerate(tried)])
    return F.when(is_asset(path), F.array(F.struct(path.alias("key"), F.lit(0).alias("priority")))).otherwise(F.filter(every, lambda c: c.key.isNotNull()))


def alias_target(path: Column, pattern: str, target: str) -> Column:
    """The path that an alias with at most one ``*`` gives; null where it doesn't match."""
    if "*" not in pattern:
        return F.when(path == pattern, F.lit(target))
    before, after = pattern.split("*", 1)
    fits = path.startswith(before) & path.endswith(after) & (F.length(path) >= len(before) + len(after))
    middle = F.substr(path, F.lit(len(before) + 1), F.length(path) - len(before) - len(after))
    left, _, right = target.partition("*")
    return F.when(fits, F.concat(F.lit(left), middle, F.lit(right)) if "*" in target else F.lit(target))


def first_alias(path: Column, aliases: list[tuple[str, list[str]]]) -> Column:
    """The targets of the first alias that matches, in order; null without one."""
    out = F.lit(None).cast("array<string>")
    for pattern, targets in reversed(aliases):
        found = F.array(*[alias_target(path, pattern, t) for t in targets])
        out = F.when(alias_target(path, pattern, pattern).isNotNull(), found).otherwise(out)
    return out


def aliased_paths(path: Column, rules: Column) -> Column:
    """The same from a column of rules, an array of (pattern, targets): one expression for any number of repositories."""
    starred = lambda x: F.instr(x, "*") > 0
    before = lambda x: F.substring_index(x, "*", 1)
    after = lambda x: F.substr(x, F.length(before(x)) + 2)

    def fits(rule: Column) -> Column:
        start, end = before(rule.pattern), after(rule.pattern)
        around = path.startswith(start) & path.endswith(end) & (F.length(path) >= F.length(start) + F.length(end))
        return F.when(starred(rule.pattern), around).otherwise(path == rule.pattern)

    def targets(rule: Column) -> Column:
        start = F.length(before(rule.pattern))
        middle = F.substr(path, start + 1, F.length(path) - start - F.length(after(rule.pattern)))
        return F.transform(rule.targets, lambda t: F.when(starred(rule.pattern) & starred(t), F.concat(before(t), middle, after(t))).otherwise(t))

    return F.get(F.transform(F.slice(F.filter(rules, fits), 1, 1), targets), F.lit(0))


def best_match(imports: DataFrame, keys: DataFrame, candidates: Column, by: list[str], target: str = "file_path") -> DataFrame:
    """``imports`` with ``dst``: the file of the first candidate (key, priority) that is a key; null without one.

    ``keys`` has the columns ``by``, key and ``target``; of files that share a key the smallest counts.
    """
    one = keys.groupBy(*by, "key").agg(F.min(target).alias("_dst"))
    # equal rows have equal targets: each is looked up once and repeated afterwards, so no row needs a number of its own
    distinct = imports.groupBy(*imports.columns).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    spread = distinct.select("*", F.explode_outer(candidates).alias("_c")).withColumn("key", F.col("_c.key"))
    hit = spread.join(one, [*by, "key"], "left")
    order = F.when(F.col("_dst").isNotNull(), F.col("_c.priority"))
    found = hit.groupBy(*imports.columns, "_n").agg(F.min_by("_dst", order).alias("dst"))
    return found.select(*imports.columns, "dst", F.explode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_i")).drop("_i")


Aliases = list[tuple[str, list[str]]]


def import_candidates(language: Column, name: Column, source: Column, aliased: Column | None = None) -> Column:
    """The candidates of an import by the language of its file.

    ``aliased``: the paths that path aliases give for a JavaScript or TypeScript import, in order; null where none fits.
    Imports of other files than sources (by their extension) have no candidates.
    """
    js = language.isin("javascript", "typescript")
    bare = F.regexp_replace(name, "^type:", "")
    folder = F.regexp_replace(F.regexp_replace(source, r"[^/]*$", ""), "/$", "")
    path = F.when(bare.startswith("/"), F.substr(bare, F.lit(2), F.length(bare))).when(bare.startswith("."), normal_path(F.concat(folder, F.lit("/"), bare)))
    paths = F.when(path.isNotNull(), F.array(path))
    if aliased is not None:
        paths = F.coalesce(F.transform(aliased, lambda p: normal_path(F.regexp_replace(p, "^/+", ""))), paths)
    paths = F.filter(paths, lambda p: ~is_asset(p))
    tried = F.flatten(F.transform(paths, lambda p, i: F.transform(js_candidates(p), lambda x: F.struct(x.key.alias("key"), (i * 100 + x.priority).alias("priority")))))
    tag = lambda space, c: F.transform(c, lambda x: F.struct(F.concat(F.lit(space + ":"), x.key).alias("key"), x.priority.alias("priority")))
    return F.when(language == "shell", tag("path", shell_candidates(name))).when(js, F.when(F.size(paths) > 0, tag("js", tried))).otherwise(tag("module", suffixes(name)))


def resolve(features: DataFrame, aliases: dict[str, Aliases] | None = None) -> DataFrame:
    """(repo_id, seq, src, import, dst) of every import of ``features`` (repo_id, seq, file_path, language, imports).

    ``aliases``: path aliases by repository, as configured there.
    """
    by = ["repo_id", "seq"]
    paths = features.select(*by, "file_path", "language")
    as_path = paths.select(*by, "file_path", F.concat(F.lit("path:"), "file_path").alias("key"))
    as_module = paths.select(*by, "file_path", F.concat(F.lit("module:"), module_key(F.col("file_path"))).alias("key")).filter("key IS NOT NULL")
    as_script = paths.filter(F.lower("file_path").rlike(SOURCE)).select(*by, "file_path", F.concat(F.lit("js:"), "file_path").alias("key"))
    imports = features.select(*by, F.col("file_path").alias("src"), "language", F.explode("imports").alias("import"))
    if aliases:
        kind = "repo_id string, _rules array<struct<pattern: string, targets: array<string>>>"
        rules = features.sparkSession.createDataFrame([(repo, own) for repo, own in aliases.items()], kind)
        imports = imports.join(rules, "repo_id", "left").withColumn("_aliased", aliased_paths(F.regexp_replace("import", "^type:", ""), F.col("_rules"))).drop("_rules")
    candidates = import_candidates(F.col("language"), F.col("import"), F.col("src"), F.col("_aliased") if aliases else None)
    found = best_match(imports, as_path.unionByName(as_module).unionByName(as_script), candidates, by)
    return found.select(*by, "src", "import", "dst")
