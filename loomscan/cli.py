"""python -m loomscan.cli PATH [--fail-on LEVEL] [--json] [--name NAME] [--ignore GLOB] [--rule NAME=PATTERN] [--cache DIR]

Scan a tree; exit 0 passed, 1 gate failed (Critical unless a level is named), 2 error.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscan.operators import detect, extract, graph, incremental, lexer, metrics
from loomscan.operators.state import at_least
from loomscan.schemas import SEVERITIES
from loomscan.session import session
from loomscan.sources import files as src
from loomscan.sources import manifests, stores

FINDING = "array<struct<file:string,line:int,severity:string,category:string,summary:string,suggested_fix:string,source:string>>"


def tree(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """Files of a tree with contents, without what its .gitignore or the globs hide."""
    at = os.path.join(root, ".gitignore")
    hidden = ""
    if os.path.exists(at):
        with open(at, encoding="utf-8", errors="replace") as f:
            hidden = f.read()
    return src.contents(src.visible(src.listing(spark, root), list(ignore), hidden), root).where(F.col("content").isNotNull())


def file_findings(found: DataFrame, rules: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Findings that hang on one file alone."""
    code = lexer.masked(found.where(F.col("ext").isin(sorted(src.CODE_EXTENSIONS)))).persist()
    parts = [detect.raw_findings(found), detect.code_findings(code), detect.entropy_findings(code), metrics.findings(metrics.blocks(code))]
    if rules:
        own = detect.custom_rules(found, list(rules))
        parts.append(own.select(F.col("rel_path").alias("file"), "line", "severity", "category", F.substring("match", 1, 80).alias("summary"), F.lit("").alias("suggested_fix"), F.lit("static").alias("source")))
    return detect.union(parts)


def tree_findings(found: DataFrame) -> DataFrame:
    """Findings that need the whole tree: dependencies, licences, files that nothing refers to."""
    imports = extract.components(found).where("kind = 'import'").select(F.col("rel_path").alias("from_path"), F.col("name").alias("spec"))
    code = found.where(F.col("ext").isin([*extract.JS, ".py"]))
    unused = detect.dead_code(graph.unreferenced(imports, code, graph.entry_like(F.col("rel_path"), [e.rpartition("/")[2] for e in manifests.ENTRIES])))
    return detect.union([unused, manifests.advisory_findings(found, found.sparkSession), manifests.license_issues(found)])


def scan(spark: SparkSession, root: str, rules: list[tuple[str, str, str]] = (), ignore: list[str] = (), cache: str | None = None, whole: bool = False, found: DataFrame | None = None) -> DataFrame:
    """All findings of a tree; contents are read and lexed once, for every detector. With `cache` the stored findings of
    files that did not change are taken over and the others are stored; `whole` adds what needs the whole tree."""
    found = tree(spark, root, ignore).persist() if found is None else found
    if cache is None:
        issues = file_findings(found, rules)
    else:
        version = incremental.version_of([repr(r) for r in rules], [r.pattern for r in detect.RAW_RULES + detect.CODE_RULES])
        last = [r["path"] for r in stores.read_state(spark, f"{cache}/latest", "path string").collect()]  # one row
        old = spark.read.parquet(last[0]) if last else spark.createDataFrame([], CACHED)
        split = incremental.split_by_cache(found, old, version).persist()
        fresh = file_findings(split.where("not hit").select("rel_path", "ext", "size_bytes", "mtime_ms", "content"), rules)
        made = fresh.groupBy("file").agg(F.to_json(F.collect_list(F.struct(*fresh.columns))).alias("made"))  # of one file
        scanned = split.join(made, split.rel_path == made.file, "left").withColumn("result", F.coalesce(F.when(F.col("hit"), F.col("result")), "made", F.lit("[]")))
        # versions beside each other: the old one is read while the new one is written
        fresh_at = f"{cache}/scan-{uuid.uuid4().hex}"
        incremental.next_cache(scanned, version).write.parquet(fresh_at)
        stores.write_state(spark.createDataFrame([(fresh_at,)], "path string"), f"{cache}/latest")
        issues = spark.read.parquet(fresh_at).select(F.explode(F.from_json("result", FINDING)).alias("x")).select("x.*")
    return detect.union([issues, tree_findings(found)]) if whole else issues


CACHED = "rel_path string, size_bytes long, mtime_ms long, content_sha1 string, version string, result string"


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomscan")
    p.add_argument("path")
    p.add_argument("--fail-on", choices=SEVERITIES, default="Critical")
    p.add_argument("--json", action="store_true")
    p.add_argument("--name")
    p.add_argument("--ignore", action="append", default=[])
    p.add_argument("--rule", action="append", default=[], help="NAME=PATTERN")
    p.add_argument("--cache")
    try:
        opts = p.parse_args(args)
        spark = session()
        rules = [(r.partition("=")[0], "Medium", r.partition("=")[2]) for r in opts.rule]
        found = tree(spark, opts.path, opts.ignore).persist()  # read once, for findings and counts
        issues = scan(spark, opts.path, rules, opts.ignore, opts.cache, whole=True, found=found).persist()
        counts = {r["severity"]: r["n"] for r in issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n")).collect()}
        failed = not issues.where(at_least(F.col("severity"), opts.fail_on)).isEmpty()
        stats = {
            "files": found.count(), "models": extract.models(found).select("rel_path", "model").distinct().count(), "routes": extract.routes(found).count(), "issues": sum(counts.values()),
        }
        issues.unpersist()
        found.unpersist()
    except SystemExit as e:
        return 2 if e.code else 0
    except Exception as e:
        print(e, file=sys.stderr)
        return 2
    by = {s: counts.get(s, 0) for s in SEVERITIES}
    name = opts.name or os.path.basename(os.path.abspath(opts.path))
    if opts.json:
        print(json.dumps({"name": name, "target": opts.path, "stats": stats, "issuesBySeverity": by, "failOn": opts.fail_on, "failed": failed}))
    else:
        print(f"Scan complete: {name}")
        print("  " + "  ".join(f"{k}: {v}" for k, v in stats.items()))
        print("  " + " ".join(f"{s}={n}" for s, n in by.items()))
        print(f"  {'FAILED' if failed else 'PASSED'} at {opts.fail_on}")
    return int(failed)


if __name__ == "__main__":
    sys.exit(main())
