"""The command line's scan of a tree, its cache and its state stores."""

import json

from loomscan import cli
from loomscan.sources import files as src
from loomscan.sources import stores


def test_whole_scan_with_cache(spark, tmp_path, capsys):
    root = tmp_path / "tree"
    (root / "a/b/c/d").mkdir(parents=True)
    (root / "dist").mkdir()
    (root / "main.js").write_text("import './a/b/used';\napp.get('/x', show);\n// TODO one\n")
    (root / "a/b/used.js").write_text("export const x = 1;\n")
    (root / "a/b/c/d/deep.js").write_text("eval(x);\n")
    (root / "a/hidden.js").write_text('const k = {"secret": "abcd1234efgh"};\n')
    (root / "dist/o.js").write_text("eval(1);\n")
    (root / ".gitignore").write_text("hidden.js\n")
    (root / "package.json").write_text(json.dumps({"dependencies": {"lodash": "4.0.0"}}))
    assert sorted(r["rel_path"] for r in src.listing(spark, str(root)).collect()) == [".gitignore", "a/b/c/d/deep.js", "a/b/used.js", "a/hidden.js", "main.js", "package.json"]
    assert [r["rel_path"] for r in src.listing(spark, str(root), depth=1).collect() if "/" in r["rel_path"]] == []
    cache = str(tmp_path / "cache")
    seen = lambda: sorted((r["file"], r["category"]) for r in cli.scan(spark, str(root), cache=cache, whole=True).collect())
    want = [("a/b/c/d/deep.js", "Code Injection Risk"), ("a/b/c/d/deep.js", "Possible Dead Code"), ("main.js", "Unresolved TODO"), ("package.json", "Outdated/Vulnerable Dependency")]
    assert seen() == want and seen() == want
    (root / "a/b/used.js").write_text("export const x = 1; eval(x);\n")
    assert seen() == sorted([*want, ("a/b/used.js", "Code Injection Risk")])
    assert cli.main([str(root), "--json", "--name", "shop", "--rule", "Own=const"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["name"] == "shop" and told["stats"] == {"files": 5, "models": 0, "routes": 1, "issues": 6} and told["issuesBySeverity"]["High"] == 3 and not told["failed"]
    assert cli.main([str(root), "--fail-on", "High"]) == 1 and cli.main([str(tmp_path / "none")]) == 2 and cli.main(["--fail-on", "x", "y"]) == 2


def test_state_stores(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "id long, text string"
    fallback = spark.createDataFrame([(0, "none")], schema)
    assert [tuple(r) for r in stores.read_state(spark, path, schema, fallback).collect()] == [(0, "none")]
    for text in ("one", "two"):
        stores.write_state(spark.createDataFrame([(1, text)], schema), path)
        assert [tuple(r) for r in stores.read_state(spark, path, schema).collect()] == [(1, text)]
    (tmp_path / "state" / "part-bad.txt").write_text("{broken\n")
    assert [tuple(r) for r in stores.read_state(spark, path, schema).collect()] == [(1, "two")]
    log = str(tmp_path / "audit")
    for i in range(3):
        stores.append_audit(spark.createDataFrame([(i, "dismissed")], schema), log)
    assert sorted(r["id"] for r in stores.read_state(spark, log, schema).collect()) == [0, 1, 2]
