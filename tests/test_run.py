"""Whole runs: what a snapshot stores, what the next one takes from it, and the command line around it."""

import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from driftspark import cli, parsers
from driftspark.operators import debounce, leiden, resolve
from driftspark.plans import snapshot as plan
from driftspark.sources import cache, settings, store, trees

SPEC = """boundaries:
  version: 2
  last_ratified: 2024-01-02
  ratified_by: us
  modules:
    - {name: web, paths: [web/], layer: top}
    - {name: core, paths: [core/, lib/], layer: low}
  layers: {direction: downward, ordering: [top, low]}
  allowed_cross_domain: [{from: web, to: core, reason: ok}]
  aspirational_splits: [{current_module: core, intended_boundary: [a, b], target_date: 2030-01-01}]
"""


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    files = {"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@web/*": ["web/*"]}}}'}
    for i in range(6):
        files[f"web/m{i}.ts"] = f"import {{x}} from '@web/m{(i + 1) % 6}';\nimport './style.css';\ntry {{ console.log({i}) }} catch (e) {{ }}\n"
        files[f"core/m{i}.py"] = f"import core.m{(i + 1) % 6}\nimport os\ntry:\n    pass\nexcept E:\n    log.info({i})\n"
    files |= {"lib/run.sh": "set -e\n. ./more.sh\ncurl x\n", "lib/more.sh": "echo y &\n"}
    for name, text in files.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return root


def last(root):
    return json.loads((root / ".drift/snapshots" / store.names(root / ".drift/snapshots")[-1]).read_text())


def test_two_snapshots(spark, project, monkeypatch, capsys):
    monkeypatch.chdir(project)
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["init"]) == 0
    (project / ".drift/boundaries.yaml").write_text(SPEC)
    (project / "core/broken.py").write_text("def (\n")
    assert cli.main(["-v", "snapshot"]) == 0
    said = capsys.readouterr()
    assert "core/broken.py: SyntaxError" in said.err and "stability 1.000" in said.err
    one = last(project)
    # six aliased imports, six dotted ones and a sourced script; os, the stylesheets and nothing else stay unresolved
    assert (one["file_count"], one["graph_metrics"]["edge_count"], one["graph_metrics"]["unresolved_count"]) == (14, 13, 6 + 6)
    assert one["language_breakdown"] == {"python": 6, "shell": 2, "typescript": 6}
    assert set(one["divergence"]["pattern_entropy_by_language"]) == {"python", "shell", "typescript"}
    assert {c["category"] for c in one["categories"]} >= {"class_hierarchy", "context_managers", "comprehensions", "error_handling"}
    assert all(s["velocity"] is None and s["boundary_spread"] >= 1 for s in one["pattern_catalog"])
    assert one["stability_score"] == 1.0 and set(map(float, one["surface_area"].values())) == {0.0}
    assert one["intent"]["misplaced_files"] == ["lib/more.sh", "lib/run.sh"] and one["intent"]["unauthorized"] == []
    assert one["divergence"]["boundary_violations"] == 2.0

    # one import from core up to web: a new edge between clusters, not allowed, and against the layers
    (project / "core/m0.py").write_text((project / "core/m0.py").read_text() + "log.info(1)\n")
    (project / "lib/more.sh").write_text("echo y &\n. ../web/m0.ts\n")
    monkeypatch.setattr(parsers, "PARSERS", parsers.PARSERS | {"typescript": lambda path, text: (_ for _ in ()).throw(ValueError("parsed again"))})
    assert cli.main(["-v", "snapshot"]) == 0  # TypeScript comes from the cache
    assert "2 cached files gone" in capsys.readouterr().err
    two = last(project)
    assert two["language_breakdown"] == one["language_breakdown"] and two["graph_metrics"]["edge_count"] == 14
    logging = {(s["category"], s["structural_hash"]): s for s in two["pattern_catalog"] if s["category"] == "logging"}
    assert sorted(s["velocity"] for s in logging.values())[-1] == 1
    assert two["stability_score"] == 1.0 and {p["file_path"]: p["cluster"] for p in two["partition"]} == {p["file_path"]: p["cluster"] for p in one["partition"]}
    assert len(two["inter_cluster_edges"]) == 1
    assert [x["to_module"] for x in two["intent"]["layer_violations"]] == ["web"] == [x["to_module"] for x in two["intent"]["unauthorized"]]
    assert two["divergence"]["boundary_violations"] == 2 + 1 + 1 + 1

    assert cli.main(["--format", "json", "show"]) == 0
    rows = {(r["dimension"], r["language"]): r for r in json.loads(capsys.readouterr().out)}
    assert rows["boundary_violations", ""]["change"] == "+3.000" and rows["pattern_entropy", "typescript"]["change"] == "+0.000"
    assert cli.main(["--format", "json", "diff"]) == 0 and "convention_drift" in capsys.readouterr().out
    assert cli.main(["catalog"]) == 0
    out = capsys.readouterr().out
    assert "velocity" in out and "comprehensions" in out
    assert cli.main(["boundaries"]) == 0 and "planned: core -> a, b by 2030-01-01" in capsys.readouterr().out
    assert cli.main(["boundaries", "--propose"]) == 0 and "the present specification has 2 modules" in capsys.readouterr().out
    monkeypatch.setenv("EDITOR", "sh -c 'echo \"  # seen\" >> \"$0\"'")
    assert cli.main(["boundaries", "--ratify"]) == 0 and "# seen" in (project / ".drift/boundaries.yaml").read_text()


def test_hooks_run_as_they_are_written(project):
    hook = project / ".git/hooks/pre-push"
    hook.parent.mkdir(exist_ok=True)
    hook.write_text("#!/bin/sh\necho before\n")
    cli.install_hook(hook, "-q check")
    cli.install_hook(hook, "-q check")
    text = hook.read_text()
    assert text.count("# drift:") == 1 and "echo before" in text and os.access(hook, os.X_OK)
    empty = project / "empty"
    empty.mkdir()
    subprocess.run(["git", "init", "-q", str(empty)], check=True)
    done = subprocess.run([str(hook)], cwd=empty, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 2 and done.stdout == "before\n" and "not initialised" in done.stderr


def test_completion():
    for shell in ("bash", "zsh", "fish"):
        text = cli.completion(shell)
        assert "--install-pre-push-hook" in text and "--last" in text and "boundaries" in text
    done = subprocess.run(["bash", "-c", cli.completion("bash") + '\nCOMP_WORDS=(drift trend --la); COMP_CWORD=2; _drift; echo "${COMPREPLY[@]}"'], capture_output=True, text=True)
    assert done.stdout == "--last\n" and not done.stderr


def test_states_go_on_from_run_to_run(spark):
    rng = random.Random(5)
    rows = [("r", seq, f"f{i}", rng.choice([1, 1, 2, 3])) for seq in range(9) for i in range(8) if rng.random() < 0.85]
    schema = "repo_id string, seq long, file_path string, raw long"
    observed = spark.createDataFrame(rows, schema)
    whole = {(r.seq, r.file_path): (r.stable, r.candidate, r.consecutive) for r in debounce.stable_partition(observed, None, 2).collect()}
    replayed = {r.file_path: (r.stable, r.candidate, r.consecutive) for r in debounce.replay(observed, 2).collect()}
    top = {f: max(s for s, g in whole if g == f) for _, f in whole}
    assert {f: whole[s, f] for f, s in top.items()} == replayed and len(whole) == len(rows)
    state = None
    for seq in range(9):
        after = debounce.stable_partition(observed.filter(F.col("seq") == seq), state, 2).collect()
        assert {(r.seq, r.file_path): (r.stable, r.candidate, r.consecutive) for r in after} == {k: v for k, v in whole.items() if k[0] == seq}
        state = spark.createDataFrame([("r", r.file_path, r.stable, r.candidate, r.consecutive) for r in after], cache.STATE)


def test_aliases_as_a_table_equal_those_of_one_repository(spark):
    rules = [("@/*", ["src/*", "alt/*"]), ("lib", ["lib/index.ts"]), ("*/end", ["e/*/x"]), ("a*c*d", ["k/*"]), ("@/only", ["never"]), ("p*", ["fixed", "q/*"])]
    names = ["@/x", "@/y/z.ts", "lib", "q", "some/end", "/end", "end", "aXc*d", "ac*d", "@/only", "p", "pX", ""]
    given = spark.createDataFrame([(n, rules) for n in names], "n string, r array<struct<pattern: string, targets: array<string>>>")
    rows = given.select(resolve.first_alias(F.col("n"), rules).alias("a"), resolve.aliased_paths(F.col("n"), F.col("r")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and sum(r.a is not None for r in rows) > 6


def test_a_thousand_repositories_with_aliases_of_their_own(spark):
    n = 1000
    kind = "repo_id string, seq long, file_path string, language string, imports array<string>"
    rows = [row for i in range(n) for row in ((f"r{i}", 0, "src/a.ts", "typescript", [f"@{i}/b"]), (f"r{i}", 0, f"own{i}/b.ts", "typescript", []))]
    found = resolve.resolve(spark.createDataFrame(rows, kind), {f"r{i}": [(f"@{i}/*", [f"own{i}/*"])] for i in range(n)})
    assert {(r.repo_id, r.dst) for r in found.collect()} == {(f"r{i}", f"own{i}/b.ts") for i in range(n)}


def test_aliases_by_repository(spark):
    rows = [("a", 0, "src/x.ts", "typescript", ["@/y", "@/z.css", "type:@lib", "@/run"]), ("a", 0, "src/y.tsx", "typescript", []), ("a", 0, "lib/index.ts", "typescript", []), ("a", 0, "src/run", "shell", []), ("b", 0, "x.ts", "typescript", ["@/y"]), ("b", 0, "src/y.tsx", "typescript", [])]
    features = spark.createDataFrame(rows, "repo_id string, seq long, file_path string, language string, imports array<string>")
    found = {(r.repo_id, r["import"]): r.dst for r in resolve.resolve(features, {"a": [("@/*", ["none/*", "src/*"]), ("@lib", ["lib"])]}).collect()}
    assert found == {("a", "@/y"): "src/y.tsx", ("a", "@/z.css"): None, ("a", "type:@lib"): "lib/index.ts", ("a", "@/run"): None, ("b", "@/y"): None}


def test_caches_survive_damage(spark, tmp_path):
    rows = [("", 0, f"{x}.py", "python", b"import os\n" if x != "c" else b"def (\n") for x in "abc"]
    files = spark.createDataFrame(rows, "repo_id string, seq long, path string, language string, content binary")
    assert cache.read_features(spark, tmp_path).count() == 0 and cache.read_states(spark, tmp_path) is None
    assert cache.write_features(tmp_path, parsers.parse_files(files)) == 0
    assert {r.file_path for r in cache.read_features(spark, tmp_path).collect()} == {"a.py", "b.py"}
    assert cache.write_features(tmp_path, parsers.parse_files(files.filter("path = 'a.py'"))) == 1
    assert len(list(tmp_path.glob("features-*"))) == 1
    (tmp_path / cache.POINTER).write_text('{"version": 1, "table": "features-none"}')
    assert cache.read_features(spark, tmp_path).count() == 0
    cache.write_states(tmp_path, spark.createDataFrame([("", "a", 1, 2, 1)], cache.STATE))
    assert [tuple(r) for r in cache.read_states(spark, tmp_path).collect()] == [("", "a", 1, 2, 1)]
    for text in ("{", '{"version": 99, "files": [["a", 1, 1, 0]]}', '{"version": 1, "files": [["a"]]}'):
        (tmp_path / cache.STATES).write_text(text)
        assert cache.read_states(spark, tmp_path) is None


def test_unreadable_and_stored_files(spark, tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.py").write_text("x = 1\n")
    (tmp_path / "sub/run").write_text("#!/bin/sh\n")
    listed = trees.listed(spark, {"r": str(tmp_path)})
    (tmp_path / "sub/a.py").unlink()
    monkeypatch.setattr(trees, "listed", lambda *_: listed)
    found = parsers.parse_files(trees.source_files(spark, {"r": str(tmp_path)})).collect()
    assert [(r.file_path, r.parse_error) for r in found] == [("sub/a.py", "OSError: the file can't be read")]
    (tmp_path / "sub/a.py").write_text("x = 1\n")
    monkeypatch.undo()
    stored = trees.source_files(spark, {"r": f"file://{tmp_path}"}).collect()
    assert sorted((r.path, r.language) for r in stored) == [("sub/a.py", "python"), ("sub/run", "shell")]


def test_a_backfill_of_several_snapshots(spark):
    rows = [("r", seq, f"m{i}.py", "python", f"import m{(i + 1) % 12}\nlog.info({'1' if i < seq else 'x, y'})\n".encode()) for seq in range(3) for i in range(12)]
    files = spark.createDataFrame(rows, "repo_id string, seq long, path string, language string, content binary")
    found = plan.run(files, settings.DEFAULTS)
    got = {r.seq: r for r in found.measures.collect()}
    assert {s: (r.pattern_entropy, r.edge_count) for s, r in got.items()} == {0: (1.0, 12), 1: (2.0, 12), 2: (2.0, 12)}
    velocity = sorted((r.seq, r.velocity) for r in found.shapes.collect() if r.seq == 2)
    assert velocity == [(2, -1), (2, 1)]


def test_leiden_on_cliques_and_its_quality(spark):
    edges = [(6 * c + i, 6 * c + j) for c in range(5) for i in range(6) for j in range(6) if i != j] + [(6 * c, (6 * c + 6) % 30) for c in range(5)]
    found = leiden.leiden(30, edges)
    assert all(len({found[6 * c + i] for i in range(6)}) == 1 for c in range(5)) and len(set(found)) == 5
    key = "repo_id string, seq long, "
    e = spark.createDataFrame([("r", 0, str(a), str(b)) for a, b in edges], key + "src string, dst string")
    p = spark.createDataFrame([("r", 0, str(i), c) for i, c in enumerate(found)], key + "file_path string, cluster long")
    m, want = len(edges), 0.0
    out = [sum(1 for a, _ in edges if a == v) for v in range(30)]
    into = [sum(1 for _, b in edges if b == v) for v in range(30)]
    for a in range(30):
        for b in range(30):
            if found[a] == found[b]:
                want += ((a, b) in set(edges)) - out[a] * into[b] / m
    assert leiden.modularity(e, p).first().modularity == pytest.approx(want / m)
