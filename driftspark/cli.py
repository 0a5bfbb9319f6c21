"""The command line: init, snapshot, show, diff, trend, check, catalog, boundaries, completion.

Exit codes: 0 done, 1 error, 2 settings, 3 nothing to analyse, 10 a threshold is exceeded.
"""

from __future__ import annotations

import argparse
import csv
import io
import json
import os
import shlex
import subprocess
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import divergence, intent
from .plans import snapshot as plan
from .sources import settings as config
from .sources import cache, store, trees

DIMENSIONS = divergence.DIMENSIONS
COMMANDS = ("init", "snapshot", "show", "diff", "trend", "check", "catalog", "boundaries", "completion")


class Failed(Exception):
    def __init__(self, message: str, code: int = 1) -> None:
        super().__init__(message)
        self.code = code


def session() -> SparkSession:
    return SparkSession.builder.appName("drift").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()


def root_of(start: Path) -> Path:
    """The folder at or above ``start`` that holds a version-control folder."""
    for folder in (start, *start.parents):
        if (folder / ".git").exists():
            return folder
    raise Failed("not inside a version-controlled folder", 2)


def snapshots_folder(root: Path, settings: dict) -> Path:
    folder = (root / settings["snapshots"]["dir"]).resolve()
    if not folder.is_relative_to(root.resolve()):
        raise Failed("snapshots.dir must stay inside the project", 2)
    return folder


def head(root: Path) -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=5, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def signed(value: float | None) -> str:
    return "N/A" if value is None else f"{value:+.3f}"


def emit(rows: list[dict], form: str, out=None) -> None:
    out = out or sys.stdout
    if form == "json":
        print(json.dumps(rows, indent=2, default=str), file=out)
        return
    columns = list(rows[0]) if rows else []
    if form == "csv":
        text = io.StringIO()
        writer = csv.DictWriter(text, columns)
        writer.writeheader()
        writer.writerows(rows)
        out.write(text.getvalue())
        return
    cells = [columns, *[["N/A" if r[c] is None else f"{r[c]:.3f}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    for r in cells if rows else []:
        print("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip(), file=out)


def measures(spark: SparkSession, folder: Path) -> DataFrame:
    """All snapshots with the changes of the dimensions, and by language as maps."""
    found = store.read(spark, folder).select(F.lit("").alias("repo_id"), "name", "seq", "timestamp", F.col("snapshot_version").alias("version"), "divergence.*")
    out = divergence.deltas(found)
    for measure in ("pattern_entropy", "convention_drift"):
        long = found.select("repo_id", "seq", F.explode(f"{measure}_by_language").alias("language", measure))
        change = divergence.language_deltas(long, measure, found.select("repo_id", "seq", "version"))
        change = change.groupBy("repo_id", "seq").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "delta")))).alias(f"{measure}_by_language_delta"))
        out = out.join(change, ["repo_id", "seq"], "left")
    return out


def by_language(row: dict, measure: str) -> list[tuple[str, float]]:
    """A snapshot's languages, those with the greatest value first."""
    return sorted((row[f"{measure}_by_language"] or {}).items(), key=lambda x: (-x[1], x[0]))


def picked(rows: DataFrame, ref: str | None) -> dict:
    named = rows.withColumn("short", F.regexp_replace("name", "^snapshot_", ""))
    by_name = divergence.referenced(rows, ref, key="repo_id", order="seq", name="name").collect() or (divergence.referenced(named, ref, key="repo_id", order="seq", name="short").collect() if ref else [])
    if not by_name:
        raise Failed(f"no snapshot {ref or ''}".rstrip())
    return by_name[0].asDict(recursive=True)


def do_init(root: Path, args: argparse.Namespace) -> None:
    folder = root / config.FOLDER
    file = folder / "config.toml"
    if not file.exists() or args.force:
        store.write_whole(file, "".join(f"[{name}]\n" + "".join(f"{k} = {json.dumps(v)}\n" for k, v in section.items() if not isinstance(v, dict)) + "\n" for name, section in config.DEFAULTS.items()))
    ignore = root / ".gitignore"
    lines = ignore.read_text().splitlines() if ignore.exists() else []
    if f"{config.FOLDER}/cache/" not in lines:
        store.write_whole(ignore, "\n".join([*lines, f"{config.FOLDER}/cache/"]) + "\n")
    for wanted, name, command in ((args.install_post_merge_hook, "post-merge", "-q snapshot"), (args.install_pre_push_hook, "pre-push", "-q check")):
        if wanted:
            install_hook(root / ".git/hooks" / name, command)
    if args.propose_boundaries:
        do_propose(root, config.load(str(root)), args)


def install_hook(hook: Path, command: str) -> None:
    """Adds the command to a hook, once; what the hook did before stays."""
    mark = f"# drift: {command}"
    before = hook.read_text() if hook.exists() else "#!/bin/sh\n"
    if mark not in before:
        where = shlex.quote(str(Path(__file__).resolve().parents[1]))
        store.write_whole(hook, f"{before.rstrip()}\n\n{mark}\nPYTHONPATH={where}${{PYTHONPATH:+:$PYTHONPATH}} {shlex.quote(sys.executable)} -m driftspark.cli {command} || exit $?\n")
        hook.chmod(0o755)


def do_snapshot(root: Path, settings: dict, args: argparse.Namespace) -> None:
    spark, folder, kept = session(), snapshots_folder(root, settings), root / config.FOLDER / "cache"
    files = trees.source_files(spark, {"": str(root)}, 0, settings["core"]["exclude"])
    if files.isEmpty():
        raise Failed("no source file in a known language", 3)
    last = divergence.last(store.read(spark, folder).withColumn("repo_id", F.lit("")), 1)
    previous = last.select("repo_id", F.explode("pattern_catalog").alias("s")).select("repo_id", "s.category", "s.structural_hash", "s.instance_count")
    spec = config.specification(str(root / settings["boundaries"]["spec_file"]))
    found = plan.run(files, settings, spec, cache.read_states(spark, kept), {"": config.aliases(str(root))}, cache.read_features(spark, kept), previous)
    for r in found.failures.orderBy("file_path").collect():
        print(f"{r.file_path}: {r.parse_error}", file=sys.stderr)
    row = found.measures.first()
    if row is None:
        raise Failed("no source file could be parsed", 3)
    m = row.asDict(recursive=True)
    metrics = ("node_count", "edge_count", "density", "cycle_count", "hub_concentration", "component_count", "max_depth", "cluster_count", "unresolved_count", "self_import_count")
    snapshot = {
        "snapshot_version": plan.VERSION, "commit_sha": head(root), "config_hash": config.fingerprint(settings), "file_count": m["file_count"], "language_breakdown": m["language_breakdown"],
        "divergence": {d: m[d] for d in (*DIMENSIONS, "pattern_entropy_by_language", "convention_drift_by_language")},
        "graph_metrics": {k: float(m[k] or 0) for k in metrics},
        "pattern_catalog": [r.asDict() for r in found.shapes.drop(*plan.KEY).orderBy("category", F.desc("instance_count"), "structural_hash").collect()],
        "partition": [r.asDict() for r in found.partition.select("file_path", "cluster").orderBy("file_path").collect()],
        "intent": {k: m[k] or [] for k in ("misplaced_files", "unauthorized", "layer_violations")} if spec and spec.modules else None,
        **{k: m[k] for k in ("hub_nodes", "categories", "scope_excluded_file_count", "stability_score", "surface_area")}, "inter_cluster_edges": m["inter_cluster_edges"] or [],
    }
    path = store.write(folder, snapshot, settings["snapshots"]["retention"])
    gone = cache.write_features(kept, found.features)
    if not found.states.isEmpty():
        cache.write_states(kept, found.states)
    if args.verbose:
        print(f"settings {snapshot['config_hash']}, commit {snapshot['commit_sha']}, {gone} cached files gone, stability {m['stability_score']:.3f}", file=sys.stderr)
    if not args.quiet:
        emit([{"snapshot": path.name, "files": m["file_count"], **{d: m[d] for d in DIMENSIONS}}], args.format)


def do_show(root: Path, settings: dict, args: argparse.Namespace) -> None:
    row = picked(measures(session(), snapshots_folder(root, settings)), args.ref)
    rows = [{"dimension": d, "language": "", "value": row[d], "change": signed(row[f"{d}_delta"])} for d in DIMENSIONS]
    for measure in ("pattern_entropy", "convention_drift"):
        changes = row[f"{measure}_by_language_delta"] or {}
        rows += [{"dimension": measure, "language": lang, "value": value, "change": signed(changes.get(lang))} for lang, value in by_language(row, measure)]
    emit(rows, args.format)


def do_diff(root: Path, settings: dict, args: argparse.Namespace) -> None:
    rows = measures(session(), snapshots_folder(root, settings))
    if rows.count() < 2:
        raise Failed("a diff takes two snapshots")
    a, b = picked(rows, args.a or (None if args.b else "-2")), picked(rows, args.b)
    change = lambda x, y: signed(y - x if x is not None and y is not None else None)
    out = [{"dimension": d, "language": "", a["name"]: a[d], b["name"]: b[d], "change": change(a[d], b[d])} for d in DIMENSIONS]
    for measure in ("pattern_entropy", "convention_drift"):
        before, after = a[f"{measure}_by_language"] or {}, b[f"{measure}_by_language"] or {}
        names = [lang for lang, _ in by_language(b, measure)] + sorted(set(before) - set(after))
        out += [{"dimension": measure, "language": x, a["name"]: before.get(x), b["name"]: after.get(x), "change": signed(after.get(x, 0.0) - before.get(x, 0.0))} for x in names]
    emit(out, args.format)


def do_trend(root: Path, settings: dict, args: argparse.Namespace) -> None:
    chosen = tuple(args.dimension or DIMENSIONS)
    if unknown := set(chosen) - set(DIMENSIONS):
        raise Failed(f"unknown dimension: {', '.join(sorted(unknown))}", 2)
    rows = divergence.last(measures(session(), snapshots_folder(root, settings)), args.last)
    emit([{"timestamp": r.timestamp, **{d: r[d] for d in chosen}} for r in rows.orderBy("seq").collect()], args.format)


def do_check(root: Path, settings: dict, args: argparse.Namespace) -> None:
    row = picked(measures(session(), snapshots_folder(root, settings)), args.ref)
    found = [{"dimension": d, "value": row[f"{d}_delta"], "threshold": t, "exceeded": row[f"{d}_delta"] is not None and row[f"{d}_delta"] > t} for d, t in config.thresholds(settings).items()]
    emit(found, args.format)
    if any(r["exceeded"] for r in found):
        raise Failed("a threshold is exceeded", 10)


def do_catalog(root: Path, settings: dict, args: argparse.Namespace) -> None:
    spark = session()
    row = picked(store.read(spark, snapshots_folder(root, settings)).withColumn("repo_id", F.lit("")), args.ref)
    preview = lambda paths: ", ".join(paths[:3]) + (f" (+{len(paths) - 3})" if len(paths) > 3 else "")
    if not row["pattern_catalog"] and not row["categories"]:
        raise Failed("the snapshot has no catalog")
    shapes = sorted(row["pattern_catalog"] or [], key=lambda s: (s["category"], -s["instance_count"], s["structural_hash"]))
    out = [{"category": s["category"], "shape": s["structural_hash"], "instances": s["instance_count"], "velocity": s["velocity"], "spread": s["boundary_spread"], "files": preview(s["file_paths"])} for s in shapes]
    seen = {s["category"] for s in shapes}
    out += [{"category": c["category"], "shape": "", "instances": 0, "velocity": None, "spread": None, "files": ""} for c in row["categories"] or [] if c["category"] not in seen]
    emit(sorted(out, key=lambda r: r["category"]), args.format)


STARTER = "boundaries:\n  version: 1\n  modules: []\n  allowed_cross_domain: []\n  aspirational_splits: []\n"


def proposal(root: Path, settings: dict) -> tuple[str, int]:
    """A specification with a module for each cluster of the latest snapshot, and the number of clusters."""
    spark = session()
    row = picked(store.read(spark, snapshots_folder(root, settings)).withColumn("repo_id", F.lit("")), None)
    if not row["partition"]:
        raise Failed("the latest snapshot has no clusters")
    members = spark.createDataFrame([("", 0, p["file_path"], p["cluster"]) for p in row["partition"]], "repo_id string, seq long, file_path string, cluster long")
    modules = intent.proposed_modules(members).orderBy("module").collect()
    text = "boundaries:\n  version: 1\n  modules:\n"
    for m in modules:
        text += f"    - name: {m.module}\n      paths:\n" + "".join(f"        - {json.dumps(p)}\n" for p in m.paths) + (f"        # {m.more} more\n" if m.more else "")
    return text, len(modules)


def do_propose(root: Path, settings: dict, args: argparse.Namespace) -> None:
    text, n = proposal(root, settings)
    spec = config.specification(str(root / settings["boundaries"]["spec_file"]))
    print(f"# {n} clusters; " + (f"the present specification has {len(spec.modules)} modules" if spec else "no specification yet: save this by boundaries --ratify"))
    print(text, end="")


def do_ratify(root: Path, settings: dict, path: Path) -> None:
    """Opens the specification in the editor; where there is none, a proposal or an empty one is written first."""
    if not path.exists():
        try:
            text = proposal(root, settings)[0]
        except Failed:
            text = STARTER
        store.write_whole(path, text)
        print(f"wrote {path}", file=sys.stderr)
    editor = os.environ.get("EDITOR") or "vi"
    try:
        subprocess.run([*shlex.split(editor), str(path)], check=False)
    except OSError as e:
        raise Failed(f"the editor {editor!r} can't be started: {e}") from e


def do_boundaries(root: Path, settings: dict, args: argparse.Namespace) -> None:
    path = root / settings["boundaries"]["spec_file"]
    if args.propose:
        return do_propose(root, settings, args)
    if args.ratify:
        return do_ratify(root, settings, path)
    spec = config.specification(str(path))
    if args.export:
        if spec is None:
            raise Failed("there is no specification to export; boundaries --ratify makes one")
        store.write_whole(Path(args.export), spec.text() + "\n")
    else:
        print(spec.text() if spec else f"no specification at {path}; boundaries --propose shows one")
    return None


def words() -> tuple[str, dict[str, str]]:
    """The words that may come first, and after each command: its own options and arguments."""
    top = parser()
    own = {name: sorted(o for action in sub._actions for o in action.option_strings if o.startswith("--")) for name, sub in top._subparsers._group_actions[0].choices.items()}
    own["completion"] = [*own["completion"], "bash", "fish", "zsh"]
    options = sorted(o for action in top._actions for o in action.option_strings if o.startswith("--"))
    return " ".join([*COMMANDS, *options]), {k: " ".join(v) for k, v in own.items()}


def completion(shell: str) -> str:
    first, own = words()
    if shell == "fish":
        lines = [f"complete -c drift -f -n __fish_use_subcommand -a {shlex.quote(first)}"]
        return "\n".join(lines + [f"complete -c drift -f -n '__fish_seen_subcommand_from {c}' -a {shlex.quote(w)}" for c, w in own.items()])
    cases = "\n".join(f"      {c}) words={shlex.quote(w)};;" for c, w in own.items())
    body = f"""_drift() {{
  local words={shlex.quote(first)} w
  for w in "${{COMP_WORDS[@]:1:COMP_CWORD-1}}"; do
    case "$w" in
{cases}
    esac
  done
  COMPREPLY=($(compgen -W "$words" -- "${{COMP_WORDS[COMP_CWORD]}}"))
}}
complete -F _drift drift"""
    return ("autoload -U +X bashcompinit && bashcompinit\n" if shell == "zsh" else "") + body


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="drift")
    top.add_argument("--format", choices=("text", "json", "csv"), default="text")
    top.add_argument("--no-color", action="store_true", help="accepted; nothing is printed in colour")
    top.add_argument("-q", "--quiet", action="store_true")
    top.add_argument("-v", "--verbose", action="store_true")
    top.add_argument("--version", action="version", version=plan.VERSION)
    sub = top.add_subparsers(dest="command", required=True)
    add = {name: sub.add_parser(name) for name in COMMANDS}
    for flag in ("--force", "--propose-boundaries", "--install-post-merge-hook", "--install-pre-push-hook"):
        add["init"].add_argument(flag, action="store_true")
    for name in ("show", "check", "catalog"):
        add[name].add_argument("ref", nargs="?")
    add["diff"].add_argument("a", nargs="?")
    add["diff"].add_argument("b", nargs="?")
    add["trend"].add_argument("--last", type=int, default=0)
    add["trend"].add_argument("--dimension", action="append")
    add["boundaries"].add_argument("--propose", action="store_true")
    add["boundaries"].add_argument("--ratify", action="store_true")
    add["boundaries"].add_argument("--export")
    add["completion"].add_argument("shell", choices=("bash", "zsh", "fish"))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "completion":
            print(completion(args.shell))
            return 0
        root = root_of(Path.cwd())
        if args.command == "init":
            do_init(root, args)
            return 0
        if not (root / config.FOLDER).is_dir():
            raise Failed("not initialised; run init first", 2)
        globals()[f"do_{args.command}"](root, config.load(str(root)), args)
    except (Failed, config.SettingsError) as e:
        print(e, file=sys.stderr)
        return e.code
    except Exception as e:  # what a command line owes its caller is a code
        if args.verbose:
            raise
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


def run() -> None:
    sys.exit(main())


if __name__ == "__main__":
    run()
