"""Every detector and extractor on files of the largest size that is read (400 KiB): no pattern may recurse by length."""

import time

import pytest
from pyspark.sql import functions as F

from loomscan.operators import balanced, detect, extract, lexer, metrics

SIZE = 400 * 1024
FILES = "rel_path string, ext string, size_bytes long, mtime_ms long, content string"


def one(spark, path, text):
    return spark.createDataFrame([(path, "." + path.rpartition(".")[2], len(text), 1, text)], FILES)


def repeated(piece, size=SIZE):
    return piece * (size // len(piece))


MANY = SIZE // 40
LONG = {
    "t.sql": "CREATE TABLE wide (\n" + ",\n".join(f"  column_{i} DECIMAL(10,2) CHECK ((column_{i} > (0)))" for i in range(MANY // 2)) + "\n);",
    "m.js": "const s = new mongoose.Schema({\n" + ",\n".join(f"  field_{i}: {{ type: String, of: {{ a: {{ b: {{}} }} }} }}" for i in range(MANY // 2)) + "\n});",
    "e.ts": "@Entity()\nexport class Wide {\n" + "\n".join(f"  @Column({{ length: {i} }})\n  f{i}: string;" for i in range(MANY // 2)) + "\n}",
    "d.py": "class Wide(models.Model):\n" + "\n".join(f"    f{i} = models.CharField(max_length=9)" for i in range(MANY)) + "\n",
    "f.py": "@app.route('/x')\n" + repeated("@other\n") + "def x(): pass\n",
    "s.java": '@RequestMapping("/a")\n' + repeated("@Other\n", SIZE // 2) + 'class A {\n@GetMapping("/x")\n' + repeated("@Other\n", SIZE // 2) + "void x() {} }",
    "x.js": "app.get('/x', " + repeated("auth, ", SIZE // 2) + "show);\n",
    "h.js": "el.innerHTML = `<b>${" + repeated("{a: {b: f(x)}} ", SIZE // 2) + "}</b>`;\n",
    "p.prisma": "model Wide {\n" + "".join(f"  f{i} Int @default(now())\n" for i in range(MANY // 2)) + "}\n",
    "g.go": repeated("pub public final static ", SIZE // 2) + "func f() {}",
    "l.js": repeated("for (const x of ") + "\n",
    "q.js": repeated("for (const x of f(a(b(c({ k: 1 }))))) { db.query(x); }\n", SIZE // 4),
    "o.js": repeated("((({{{[[["),
    "c.js": repeated("/* a"),
    "r.js": "db.query(`" + repeated("${a} ", SIZE // 2) + "`)",
}


@pytest.mark.parametrize("path", sorted(LONG))
def test_long_file(spark, path):
    f = one(spark, path, LONG[path])
    began = time.time()
    masked = lexer.masked(f)
    n = [x.count() for x in (detect.raw_findings(f), detect.code_findings(masked), extract.components(f), extract.routes(f), extract.models(f), extract.relationships(f), extract.env_vars(f))]
    n.append(metrics.findings(metrics.blocks(masked)).count())
    assert time.time() - began < 60, n
    if path in ("t.sql", "m.js", "e.ts", "d.py", "p.prisma"):
        assert n[4] == {"d.py": MANY}.get(path, MANY // 2)
    if path in ("f.py", "s.java", "x.js"):
        assert n[3] == 1


def test_balanced_bodies_and_their_parts(spark):
    text = """-- create table gone (x int);
CREATE TABLE a (id INT PRIMARY KEY, note TEXT DEFAULT 'x, (y' NOT NULL, -- one, two
  kind VARCHAR(10) UNIQUE, owner INT REFERENCES people(id), CHECK ((id > (1))),
  FOREIGN KEY (kind) REFERENCES kinds (name));
CREATE TABLE open (id INT, """
    got = {r["field"]: r for r in extract.models(one(spark, "a.sql", text)).collect()}
    assert list(got) == ["id", "note", "kind", "owner"] and {r["line"] for r in got.values()} == {2}
    assert (got["id"]["nullable"], got["id"]["constraints"]) == (False, ["primary key"])
    assert (got["note"]["type"], got["note"]["nullable"]) == ("TEXT", False)
    assert (got["kind"]["type"], got["kind"]["constraints"], got["owner"]["constraints"]) == ("VARCHAR(10)", ["unique"], ["foreign key"])
    keys = {tuple(r) for r in extract.relationships(one(spark, "a.sql", text)).select("field", "type", "target").collect()}
    assert keys == {("owner", "foreignKey", "people.id"), ("kind", "foreignKey", "kinds.name")}


def test_fields_of_other_models(spark):
    f = spark.createDataFrame([(p, "." + p.rpartition(".")[2], 1, 1, t) for p, t in {
        "p.prisma": "model Post {\n  id Int @id @default(autoincrement())\n  title String? @unique\n  // gone Int\n  tags String[]\n  author User @relation(fields: [a])\n  @@map(\"p\")\n}\n",
        "m.js": "const s = new Schema({ a: { type: String, required: true, unique: true, default: 'x' }, b: [Number], c: { d: { type: Date } }, 'e': Boolean });",
        "d.py": "class Note(models.Model):\n    title = models.CharField(max_length=9, null=True, default='x')\n    owner = models.ForeignKey('User', on_delete=c)\n\n    def f(self): pass\nclass Other: pass\n",
        "t.ts": "@Entity()\nexport class Account {\n  @PrimaryGeneratedColumn()\n  id: number;\n  @Column({ nullable: true, unique: true })\n  name?: string;\n  @ManyToOne(() => User, (u) => u.accounts)\n  user: User;\n}\n",
    }.items()], FILES)
    got = {(r["model"], r["field"]): (r["type"], r["nullable"], r["default_value"], r["constraints"]) for r in extract.models(f).collect()}
    assert got["Post", "id"] == ("Int", False, "autoincrement()", ["primary key"]) and got["Post", "title"] == ("String", True, None, ["unique"]) and got["Post", "tags"][0] == "String[]"
    assert got["s", "a"] == ("String", False, "'x'", ["unique"]) and got["s", "b"][0] == "Number" and got["s", "e"] == ("Boolean", True, None, []) and ("s", "gone") not in got
    assert got["Note", "title"] == ("CharField", True, "'x'", []) and got["Note", "owner"][3] == ["foreign key"] and ("Note", "f") not in got
    assert got["Account", "id"] == ("number", False, None, ["primary key"]) and got["Account", "name"] == ("string", True, None, ["unique"]) and ("Account", "user") not in got
    keys = {tuple(r) for r in extract.relationships(f).select("model", "field", "type", "target").collect()}
    assert keys == {("Post", "author", "relation", "User"), ("Note", "owner", "ForeignKey", "User"), ("Account", "user", "ManyToOne", "() => User")}


def test_each_class_has_its_own_prefix(spark):
    text = '@RequestMapping("/a")\nclass A {\n  @GetMapping("/x")\n  void x() {}\n}\n\nclass B {\n  @GetMapping("/y")\n  void y() {}\n}\n@RequestMapping("/c/")\npublic class C {\n  @PostMapping("z")\n  void z() {}\n  @GetMapping("")\n  void w() {}\n}\n'
    got = {tuple(r) for r in extract.routes(one(spark, "A.java", text)).select("method", "path", "handler").collect()}
    assert got == {("GET", "/a/x", "x"), ("GET", "/y", "y"), ("POST", "/c/z", "z"), ("GET", "/c", "w")}


def test_handlers_behind_called_middleware(spark):
    got = extract.routes(one(spark, "a.js", "app.get('/x', auth('admin'), limit(5), show);")).collect()
    assert [(r["path"], r["handler"]) for r in got] == [("/x", "show")]


def test_nested_pattern_is_the_same_in_both_engines(spark):
    import re

    p = balanced.nested("(", ")", 3)
    for t, whole in {"a(b(c(d)))": True, "a(b": False, "a)": False, "": True, "((((x))))": False}.items():
        assert bool(re.fullmatch(p, t)) == whole == spark.range(1).select(F.lit(t).rlike(f"^(?:{p})$")).collect()[0][0]
