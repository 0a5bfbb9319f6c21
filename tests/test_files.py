"""Globs, languages, import resolution, parsers, settings, snapshots, and a whole run."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from driftspark import cli, parsers
from driftspark.functions import files, globs
from driftspark.operators import catalog, intent, resolve
from driftspark.sources import settings, store, trees


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


GLOBS = [
    (["*.html"], ["a.html", "x/b.html", "a.htm"], [True, True, False]),
    (["/a"], ["a", "a/b", "x/a"], [True, True, False]),
    (["build/"], ["build/x", "x/build/y", "build"], [True, True, False]),
    (["**/vendor/**"], ["vendor/x", "a/vendor/b/c", "vendors/x"], [True, True, False]),
    (["a/**/b"], ["a/b", "a/x/y/b", "a/xb"], [True, True, False]),
    (["*.py", "!keep.py"], ["a.py", "d/keep.py"], [True, False]),
    (["t?st", "[a-c].sh", "[!a].go"], ["test", "tst", "b.sh", "d.sh", "b.go", "a.go"], [True, False, True, False, True, False]),
    (["# no", "", "  "], ["no"], [False]),
]


@pytest.mark.parametrize("patterns,paths,want", GLOBS)
def test_globs(spark, patterns, paths, want):
    assert column(spark, paths, lambda x: globs.ignored(x, patterns)) == want


def test_languages(spark):
    assert column(spark, ["a.PY", "b.tar.gz", "x/.py", "c", "d.mjs", "e.f/g", "h.tsx"], files.language) == ["python", None, None, None, "javascript", None, "typescript"]
    heads = ["#!/bin/bash\nx", "#!/usr/bin/env zsh", "#! /bin/sh -e\n", "#!/usr/bin/bashbrew", "echo", "", "#!/usr/bin/env python"]
    assert column(spark, heads, lambda x: files.is_shell_script(x.cast("binary"))) == [True, True, True, False, False, False, False]
    assert column(spark, ["a\n\n # b\n\tc\n#d", ""], files.lines_of_code) == [2, 0]


def test_paths(spark):
    assert column(spark, ["src/sdx/config.py", "models/__init__.py", "a/b.js", "src/__init__.py", "__init__.py"], resolve.module_key) == ["sdx.config", "models", None, "src", "__init__"]
    assert column(spark, ["a/./b//c", "a/../b", "../x", "a/b/../../../y", ""], resolve.normal_path) == ["a/b/c", "b", "../x", "../y", ""]
    assert column(spark, ["@/x", "@/y/z.ts", "lib", "q"], lambda x: F.array_join(resolve.first_alias(x, [("@/*", ["src/*", "alt/*"]), ("lib", ["lib/index.ts"])]), ",")) == ["src/x,alt/x", "src/y/z.ts,alt/y/z.ts", "lib/index.ts", None]


def test_imports_resolve(spark):
    rows = [
        ("a/b/c.py", "python", ["x.b.c", "os", "a.b.c", "pa.b"]), ("b/c.py", "python", []), ("pa2/b.py", "python", ["b.c", "b.c"]),
        ("s/x.sh", "shell", ["s/lib", "s/lib.sh", "s/no"]), ("s/lib.sh", "shell", []), ("s/lib.bash", "shell", []),
        ("t/m.ts", "typescript", ["./n.js", "type:./o", "./style.css", "react", "/t/o/index", "./foo.service"]), ("t/n.ts", "typescript", []), ("t/o/index.tsx", "typescript", []), ("t/foo.service.ts", "typescript", []),
        ("g/g.go", "go", ["example.com/x", "zz.b.c"]),
    ]
    features = spark.createDataFrame([("r", 0, *x) for x in rows], "repo_id string, seq long, file_path string, language string, imports array<string>")
    got = {(r.src, r["import"]): r.dst for r in resolve.resolve(features).collect()}
    assert got == {
        ("a/b/c.py", "x.b.c"): "b/c.py", ("a/b/c.py", "os"): None, ("a/b/c.py", "a.b.c"): "a/b/c.py", ("a/b/c.py", "pa.b"): None, ("pa2/b.py", "b.c"): "b/c.py",
        ("s/x.sh", "s/lib"): "s/lib.sh", ("s/x.sh", "s/lib.sh"): "s/lib.sh", ("s/x.sh", "s/no"): None,
        ("t/m.ts", "./n.js"): "t/n.ts", ("t/m.ts", "type:./o"): "t/o/index.tsx", ("t/m.ts", "./style.css"): None, ("t/m.ts", "react"): None, ("t/m.ts", "/t/o/index"): "t/o/index.tsx", ("t/m.ts", "./foo.service"): None,
        ("g/g.go", "example.com/x"): None, ("g/g.go", "zz.b.c"): "b/c.py",
    }
    assert resolve.resolve(features).count() == 17


PARSED = [
    ("python", "src/a/b.py", "import os, c.d as e\nfrom . import x\nfrom ..q import y\nX = 1\nclass K: pass\ndef f():\n  import no\n  try:\n    log.info('x')\n  except E: pass\n  db.query(1)\n", ["os", "c.d", "a", "q"], ["X", "K", "f"], ["data_access", "error_handling", "logging"]),
    ("shell", "s/a.sh", "set -eu\n. ./lib.sh\nsource ../x.sh\nsource $D/no.sh\nfoo() {\n curl x | jq . | tee y\n}\nwait\n", ["s/lib.sh", "x.sh"], ["foo"], ["async_patterns", "async_patterns", "data_access", "data_access", "error_handling", "logging"]),
    ("typescript", "a.ts", "import {a} from './a';\nimport type {B} from './b';\nexport * from './c';\nconst x = require('d');\nexport class Foo {}\nfunction bar() { try { console.log(1) } catch (e) {} }\n// import z from 'z'\n", ["./a", "type:./b", "./c", "d"], ["x", "Foo", "bar"], ["error_handling", "logging"]),
    ("javascript", "a.js", "import './side';\nconst p = import('dyn');\nfoo.require('no');\n", ["./side", "dyn"], ["p"], []),
    ("go", "a.go", 'package a\nimport (\n "fmt"\n x "os"\n)\nfunc (r *R) Do() error {\n if err != nil { return err }\n return nil\n}\nfunc low() {}\ntype T struct{}\n', ["fmt", "os"], ["Do", "T"], ["error_handling"]),
    ("java", "A.java", "import static a.b.C;\nimport d.*;\npublic class A { void f() { try { g(); } catch (E e) {} try (R r = x()) {} } }\n", ["a.b.C", "d.*"], ["A"], ["error_handling"]),
    ("rust", "a.rs", "use std::io::{self, Read};\nmod foo;\npub fn f<'a>(x: &'a str) { match x { Ok(v) => v, Err(e) => e } }\nfn g() {}\nimpl Tr for Foo {}\npub struct S;\n", ["std::io", "./foo"], ["f", "Foo", "S"], ["error_handling"]),
]


@pytest.mark.parametrize("language,path,text,imports,symbols,categories", PARSED)
def test_parsers(language, path, text, imports, symbols, categories):
    found = parsers.PARSERS[language](path, text)
    assert (found.imports, found.symbols) == (imports, symbols)
    assert sorted(p["category"] for p in found.patterns) == categories


def test_shapes_are_equal_for_equal_structure():
    one = lambda text: [p["ast_hash"] for p in parsers.PARSERS["python"]("a.py", text).patterns]
    assert one("log.info('a')") == one("log.info('b')") != one("log.info(x, y)")


def test_broken_files_and_the_cache(spark):
    rows = [("r", 0, "a.py", "python", b"import os\n"), ("r", 0, "b.py", "python", b"def (\n"), ("r", 0, "c.md", None, b"")]
    given = spark.createDataFrame(rows, "repo_id string, seq long, path string, language string, content binary")
    found = parsers.parse_files(given).cache()
    assert {r.file_path: r.parse_error is None for r in found.collect()} == {"a.py": True, "b.py": False}
    again = parsers.parse_changed(given.withColumn("seq", F.lit(1).cast("long")), found.withColumn("symbols", F.array(F.lit("from cache"))))
    assert {r.file_path: r.symbols for r in again.filter("seq = 1").collect()} == {"a.py": ["from cache"], "b.py": []}


def test_catalog_by_definition(spark):
    rows = [("a.py", "h1")] * 2 + [("b.py", "h1"), ("c.py", "h2")]
    found = spark.createDataFrame([("r", 0, "error_handling", h, f, "python", None) for f, h in rows], "repo_id string, seq long, category string, structural_hash string, file_path string, language string, node_count int")
    counts = catalog.shape_counts(found)
    m = catalog.pattern_measures(counts).first()
    assert (m.pattern_entropy, m.convention_drift) == (2.0, 0.25)
    assert catalog.canonical_shapes(counts).first().structural_hash == "h1"
    assert [r.velocity for r in catalog.velocity(counts).collect()] == [None, None]


def test_modules(spark):
    members = spark.createDataFrame([("r", 0, f"billing/{x}", c) for x, c in (("a", 0), ("b", 0), ("c", 1))], "repo_id string, seq long, file_path string, cluster long").withColumn("module", intent.module_of(F.col("file_path"), [("billing", ["billing/"])]))
    assert [r.file_path for r in intent.misplaced_files(members).collect()] == ["billing/c"]
    edges = spark.createDataFrame([("r", 0, 0, 1, 3, "billing", "users")], "repo_id string, seq long, source_cluster long, target_cluster long, count long, from_module string, to_module string")
    pairs = lambda rows: spark.createDataFrame(rows, "from_module string, to_module string")
    assert intent.unauthorized(edges, pairs([("users", "billing")])).count() == 1
    assert intent.unauthorized(edges, pairs([("billing", "users")])).count() == 0


def test_settings(tmp_path):
    (tmp_path / ".drift").mkdir()
    (tmp_path / ".drift/config.toml").write_text('[core]\nrandom_seed = 7\n[thresholds.overrides.x]\nexpires = "2999-01-01"\npattern_entropy_rate = 9.0\n')
    found = settings.load(str(tmp_path))
    assert found["core"]["random_seed"] == 7 and found["snapshots"]["retention"] == 100
    assert settings.thresholds(found)["pattern_entropy"] == 9.0
    assert settings.fingerprint(found) != settings.fingerprint(settings.DEFAULTS)
    (tmp_path / ".drift/config.toml").write_text("[thresholds.overrides.x]\nreason = 'none'\n")
    with pytest.raises(settings.SettingsError):
        settings.load(str(tmp_path))
    (tmp_path / "tsconfig.json").write_text('{ // c\n "compilerOptions": {"baseUrl": "src", "paths": {"@/*": ["./*"],},},\n}')
    assert settings.aliases(str(tmp_path)) == [("@/*", ["src/*"])]
    (tmp_path / "b.yaml").write_text("boundaries:\n  modules: []\n")
    with pytest.raises(settings.SettingsError):
        settings.specification(str(tmp_path / "b.yaml"))
    assert settings.specification(str(tmp_path / "none.yaml")) is None


def test_store(tmp_path):
    for i in range(4):
        store.write(tmp_path, {"timestamp": f"2024-01-0{i + 1}T00:00:00Z"}, retention=3)
    (tmp_path / "other.json").write_text("{}")
    assert [n[9:17] for n in store.names(tmp_path)] == ["20240102", "20240103", "20240104"]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    for i in range(6):
        (tmp_path / f"m{i}.py").write_text(f"import m{(i + 1) % 6}\ntry:\n    pass\nexcept E:\n    log.info({i})\n")
    (tmp_path / "_run").write_text("#!/bin/sh\nset -e\n")
    os.chmod(tmp_path / "_run", 0o755)
    (tmp_path / ".gitignore").write_text("m5.py\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["snapshot"]) == 2
    assert cli.main(["init"]) == 0 and cli.main(["--format", "json", "snapshot"]) == 0
    first = json.loads(capsys.readouterr().out)[0]
    assert first["files"] == 6
    assert cli.main(["show"]) == 0 and cli.main(["diff"]) == 1
    for i in range(3):
        (tmp_path / f"n{i}.py").write_text("try:\n    x = 1\nfinally:\n    y = 2\nlog.error(1, 2)\ndb.query(%d, %s)\n" % (i, "a" * i or "0"))
    assert cli.main(["snapshot"]) == 0
    capsys.readouterr()
    assert cli.main(["--format", "csv", "diff"]) == 0 and cli.main(["trend", "--last", "1"]) == 0
    assert cli.main(["trend", "--dimension", "nothing"]) == 2
    assert cli.main(["check"]) == 10
    assert cli.main(["catalog", "-1"]) == 0 and cli.main(["boundaries", "--propose"]) == 0 and cli.main(["completion", "bash"]) == 0
    assert "cluster_0" in capsys.readouterr().out


def test_listing_keeps_hidden_names(spark, tmp_path):
    for name in ("a.py", "__init__.py", "_p.py", ".h.py", "vendor/x.py", "b.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    got = sorted(r.path for r in trees.source_files(spark, {"r": str(tmp_path)}).collect())
    assert got == [".h.py", "__init__.py", "_p.py", "a.py"]


def test_upper_case_has_one_character_for_each(spark):
    texts = ["stra\u00dfe\n\u00df", "\u0149\ufb01x \u1f80\u1fb3\u0390", "plain \u00f1\u00e9", "", None]
    got = [r.u for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(files.simple_upper(F.col("t")).alias("u")).collect()]
    assert got == ["STRA\u1e9eE\n\u1e9e", "\u0149\ufb01X \u1f88\u1fbc\u0390", "PLAIN \u00d1\u00c9", "", None]
