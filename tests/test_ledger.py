"""One test for each behaviour that decides results, by its number in the survey's ledger."""

import json

import pytest
from pyspark.sql import functions as F

from driftspark import cli, parsers
from driftspark.functions import files
from driftspark.operators import catalog, debounce, divergence, graph, intent, leiden, resolve
from driftspark.plans import snapshot as plan
from driftspark.sources import cache, settings, store

INSTANCE = "repo_id string, seq long, category string, structural_hash string, file_path string, language string, node_count int"
KEY = "repo_id string, seq long, "


def instances(spark, rows):
    return spark.createDataFrame([("r", *r) for r in rows], INSTANCE)


def registry(spark):
    return spark.createDataFrame([("c", None), ("only_go", ["go"])], "category string, languages array<string>")


def test_q1_unknown_node_counts_pass(spark):
    found = instances(spark, [(0, "c", "h", "a", "py", n) for n in (None, 4, 5)])
    assert sorted(r.node_count or -1 for r in catalog.large_enough(found, 5).collect()) == [-1, 5]


def test_q4_ties_go_to_the_smaller_hash(spark):
    counts = catalog.shape_counts(instances(spark, [(0, "c", h, "a", "py", None) for h in ("z", "b", "y")]))
    assert catalog.canonical_shapes(counts).first().structural_hash == "b"


def test_q5_languages_weigh_shapes_by_files(spark):
    rows = [(0, "c", "h1", "a", "py", None)] * 9 + [(0, "c", "h2", f, "py", None) for f in "bcd"]
    found = instances(spark, rows)
    languages = found.select("repo_id", "seq", "language").distinct()
    assert catalog.drift_by_language(found, languages, registry(spark)).first().convention_drift == 0.25


def test_q7_weights_count_imports_but_edges_count_once(spark):
    imports = spark.createDataFrame([("r", 0, "a", "b")] * 3, KEY + "src string, dst string")
    edges = graph.edges_of(imports)
    assert edges.first().weight == 3
    part = spark.createDataFrame([("r", 0, "a", 0), ("r", 0, "b", 1)], KEY + "file_path string, cluster long")
    assert graph.inter_cluster_edges(edges, part).first()["count"] == 1


def test_q10_violations_add_edges_and_groups(spark):
    edges = spark.createDataFrame([("r", 0, 4), ("r", 0, None)], KEY + "count long")
    totals = spark.createDataFrame([("r", 0, 2)], KEY + "total_violations long")
    assert intent.boundary_violations(edges, totals).first().boundary_violations == 7


def test_q11_first_module_by_plain_prefix(spark):
    paths = spark.createDataFrame([("billing_old/x",), ("billing/x",), ("none",)], "p string")
    got = [r.m for r in paths.select(intent.module_of(F.col("p"), [("a", ["bill"]), ("b", ["billing/"])]).alias("m")).collect()]
    assert got == ["a", "a", None]
    joined = intent.with_modules(paths.withColumnRenamed("p", "file_path"), [("a", ["bill"]), ("b", ["billing/"])])
    assert sorted(str(r.module) for r in joined.collect()) == sorted(map(str, got))
    many = [(f"m{i}", [f"src/p{i}/", f"lib/p{i % 7}/"]) for i in range(1000)]
    files = paths.sparkSession.createDataFrame([(f"{d}/p{i}/x",) for d in ("src", "lib", "etc") for i in (0, 3, 999)], "file_path string")
    assert {r.file_path: r.module for r in intent.with_modules(files, many).collect()} == {"src/p0/x": "m0", "src/p3/x": "m3", "src/p999/x": "m999", "lib/p0/x": "m0", "lib/p3/x": "m3", "lib/p999/x": None, "etc/p0/x": None, "etc/p3/x": None, "etc/p999/x": None}


def test_q12_plurality_ties_go_to_the_first_file(spark):
    members = spark.createDataFrame([("r", 0, "a", 0, "m2"), ("r", 0, "b", 0, "m1")], KEY + "file_path string, cluster long, module string")
    assert intent.cluster_modules(members).first().module == "m2"


def test_q18_jsx_is_not_a_language_of_files(spark):
    assert spark.createDataFrame([("a.jsx",)], "p string").select(files.language(F.col("p")).alias("l")).first().l is None


def test_q20_languages_without_shapes_get_zero(spark):
    found = instances(spark, [(0, "only_go", "h", "a", "py", None)])
    languages = found.select("repo_id", "seq", "language").distinct()
    assert catalog.entropy_by_language(found, languages, registry(spark)).first().pattern_entropy == 0.0
    assert catalog.drift_by_language(found, languages, registry(spark)).first().convention_drift == 0.0


FILES = "repo_id string, seq long, path string, language string, content binary"
FEATURES = "repo_id string, seq long, file_path string, language string, imports array<string>"


def sources(spark, rows):
    return spark.createDataFrame([("r", seq, path, language, text.encode()) for seq, path, language, text in rows], FILES)


def resolved(spark, rows, aliases=None):
    found = resolve.resolve(spark.createDataFrame([("r", 0, *x) for x in rows], FEATURES), aliases)
    return {(r.src, r["import"]): r.dst for r in found.collect()}


@pytest.fixture(scope="module")
def two_runs(spark):
    """A repository of twelve files, twice: the second run has another shape, and one file less."""
    text = lambda i, call: f"import m{(i + 1) % 12}\ntry:\n    x = 1\nexcept E:\n    {call}\n"
    first = sources(spark, [(0, f"m{i}.py", "python", text(i, "log.info(1)")) for i in range(12)])
    one = plan.run(first, settings.DEFAULTS)
    previous = one.shapes.select("repo_id", "category", "structural_hash", "instance_count")
    second = sources(spark, [(1, f"m{i}.py", "python", text(i, "log.info(1)" if i else "log.info(x, y)")) for i in range(11)])
    return one, plan.run(second, settings.DEFAULTS, states=one.states, cache=one.features, previous=previous)


def test_q2_another_least_size_counts_at_once(spark):
    features = parsers.parse_files(sources(spark, [(0, "a.py", "python", "log.info(1)\n")]))
    counted = parsers.instances(features, True)
    assert [catalog.large_enough(counted, n).count() for n in (1, 99)] == [1, 0]


def test_q3_equal_files_keep_their_own_paths(spark):
    given = sources(spark, [(0, "a/x.py", "python", "from . import y\n"), (0, "b/x.py", "python", "from . import y\n")])
    cached = parsers.parse_files(given.filter("path = 'a/x.py'"))
    assert {r.file_path: r.imports for r in parsers.parse_changed(given, cached).collect()} == {"a/x.py": ["a"], "b/x.py": ["b"]}


def test_q6_depth_is_the_diameter():
    assert graph.diameter([(0, 1), (1, 2), (0, 2)]) == 1 and graph.diameter([(0, 1), (1, 2), (2, 0), (5, 6)]) == 2


def test_q8_q9_labels_are_kept_and_changes_wait(spark):
    assert leiden.relabelled({"a": 1, "b": 1, "c": 0}, {"a": 0, "b": 0, "c": 1}) == {"a": 0, "b": 0, "c": 1}
    seen = spark.createDataFrame([("r", i + 1, "f", x) for i, x in enumerate([0, 1, 1, 2, 1, 1, 1])], "repo_id string, seq long, file_path string, raw long")
    got = {r.seq: (r.stable, r.candidate, r.consecutive) for r in debounce.stable_partition(seen).collect()}
    assert got == {1: (0, 0, 0), 2: (0, 1, 1), 3: (0, 1, 2), 4: (0, 2, 1), 5: (0, 1, 1), 6: (0, 1, 2), 7: (1, 1, 0)}


def test_q13_snapshots_of_one_second_have_an_order(spark, tmp_path):
    for i in range(3):
        store.write(tmp_path, {"timestamp": "2024-01-01T00:00:00Z", "commit_sha": str(i)})
    assert [(r.seq, r.name) for r in store.read(spark, tmp_path).orderBy("seq").collect()] == list(enumerate(store.names(tmp_path), 1))


def test_q14_q15_q16_q22_q27_imports(spark):
    rows = [
        ("g.go", "go", ["x/util", "app.util"]), ("app/util.py", "python", []), ("src/app/util.py", "python", []),
        ("w/a.ts", "typescript", ["type:./b", "./b.css", "@x/b", "./c.service", "./d.mjs"]), ("w/b.ts", "typescript", []), ("w/b.css", "shell", []), ("w/d.mts", "typescript", []),
    ]
    got = resolved(spark, rows)
    assert got["g.go", "x/util"] is None and got["g.go", "app.util"] == "app/util.py"  # Q14, Q22: the smaller path
    assert got["w/a.ts", "type:./b"] == "w/b.ts"  # Q15
    assert got["w/a.ts", "./b.css"] is got["w/a.ts", "./c.service"] is got["w/a.ts", "./d.mjs"] is None  # Q16
    assert got["w/a.ts", "@x/b"] is None and resolved(spark, rows, {"r": [("@x/*", ["w/*"])]})["w/a.ts", "@x/b"] == "w/b.ts"  # Q27


def test_q17_overrides_only_raise(spark):
    base = spark.createDataFrame([("pattern_entropy", 2.0)], "dimension string, threshold double")
    for values, want in (([1.0], 2.0), ([1.0, 5.0], 5.0), ([], 2.0)):
        rows = spark.createDataFrame([("any name", "pattern_entropy", v) for v in values], "name string, dimension string, value double")
        assert divergence.effective_thresholds(base, rows).first().threshold == want


def test_q19_q23_what_a_run_stores(two_runs):
    m = two_runs[0].measures.first()
    empty = {c.category for c in m.categories if not c.entropy}
    assert {"class_hierarchy", "context_managers", "comprehensions", "async_patterns"} <= empty and len(m.categories) == 7
    assert m.unresolved_count == 0 and m.self_import_count == 0 and set(m.surface_area.values()) == {0.0} or m.inter_cluster_edges


def test_q20_q21_languages_are_those_of_all_files(spark):
    given = sources(spark, [(0, "a.py", "python", "log.info(1)\n"), (0, "b.sh", "shell", "echo x\n")])
    m = plan.run(given, settings.merged(settings.DEFAULTS, {"patterns": {"scope_exclude": ["*.sh"]}})).measures.first()
    assert m.pattern_entropy_by_language == {"python": 1.0, "shell": 0.0} and m.scope_excluded_file_count == 1
    assert "convention_drift_by_language map<string,double>" in store.SCHEMA.replace(": ", " ")  # null where a snapshot has none


def test_q24_keys_without_effect_are_accepted(tmp_path):
    (tmp_path / settings.FOLDER).mkdir()
    (tmp_path / settings.FOLDER / "config.toml").write_text("[change_coupling]\nmin_frequency = 0.1\n[output]\ncolor = 'never'\n[core]\nlanguages = ['go']\n")
    found = settings.load(str(tmp_path))
    assert found["change_coupling"]["min_frequency"] == 0.1 and settings.fingerprint(found) != settings.fingerprint(settings.DEFAULTS)
    assert settings.fingerprint(settings.merged(settings.DEFAULTS, {"output": {"color": "never"}})) == settings.fingerprint(settings.DEFAULTS)


def test_q25_q26_zero_is_shown_and_drift_is_a_share(spark, capsys):
    cli.emit([{"value": 0.0, "change": cli.signed(0.0), "other": None}], "text")
    assert capsys.readouterr().out.split() == ["value", "change", "other", "0.000", "+0.000", "N/A"]
    found = instances(spark, [(0, "c", h, "a", "py", None) for h in "xxxy"])
    assert catalog.pattern_measures(catalog.shape_counts(found)).first().convention_drift == 0.25


def test_q28_counting_cycles_stops_at_the_cap_and_says_so():
    edges = [(a, b) for a in range(6) for b in range(6) if a != b]
    assert graph.cycle_count(edges, 10) == (10, True) and graph.cycle_count(edges) == (409, False)


def test_q29_q30_small_runs_leave_the_states(spark, two_runs):
    few = plan.run(sources(spark, [(2, f"m{i}.py", "python", "x = 1\n") for i in range(3)]), settings.DEFAULTS, states=two_runs[1].states)
    assert few.states.isEmpty() and {r.cluster for r in few.partition.collect()} == {0} and few.measures.first().stability_score == 1.0
    gone = {r.file_path for r in two_runs[0].states.collect()} - {r.file_path for r in two_runs[1].states.collect()}
    assert gone == {"m11.py"}  # its history is lost


def test_q31_states_of_another_version_are_a_cold_start(spark, tmp_path):
    (tmp_path / cache.STATES).write_text(json.dumps({"version": cache.VERSION + 1, "files": [["a", 1, 1, 0]]}))
    assert cache.read_states(spark, tmp_path) is None


def test_q32_velocity_needs_a_catalog_before(spark, two_runs):
    one, two = two_runs
    assert {r.velocity for r in one.shapes.collect()} == {None}
    changed = sorted(r.velocity for r in two.shapes.collect())
    assert changed == [-2, -2, 1, 1]  # a file is gone; in another one the call, and so the block around it, took another shape
    nothing = one.shapes.select("repo_id", "category", "structural_hash", "instance_count").limit(0)
    again = plan.run(sources(spark, [(0, "a.py", "python", "log.info(1)\n")]), settings.DEFAULTS, previous=nothing)
    assert {r.velocity for r in again.shapes.collect()} == {None} and again.measures.first().coupling_topology >= 0.0


def test_q33_snapshots_of_other_settings_are_compared_all_the_same(spark, tmp_path):
    for day, (config, value) in enumerate([("a", 1.0), ("b", 4.0)], 1):
        store.write(tmp_path, {"timestamp": f"2024-01-0{day}T00:00:00Z", "snapshot_version": "0.2.0", "config_hash": config, "divergence": {"pattern_entropy": value}})
    rows = {r.seq: r.pattern_entropy_delta for r in cli.measures(spark, tmp_path).collect()}
    assert rows == {1: None, 2: 3.0}
