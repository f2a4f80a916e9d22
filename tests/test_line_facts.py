"""Line languages in their odd forms."""

from __future__ import annotations

from basalt.sources.line_facts import line_definitions, shell_imports, sql_references


def files(spark, **texts):
    return spark.createDataFrame([(lang, lang, text) for lang, text in texts.items()] + [("none", "sql", None), ("empty", "ini", "")], "file string, lang string, text string")


def test_definitions(spark):
    rows = line_definitions(files(
        spark, sql='create trigger T1 on x\nCREATE TYPE "Mood" AS ENUM ();\nCREATE SCHEMA IF NOT EXISTS `S`;\ncreate sequence s1 -- create table\nCREATE TEMP TABLE t2', ini="export A_B=1\na.b-c: x\n9=1\n # c=1", dockerfile="from a as Base\narg NO=1\nENV P=1",
        toml='[[bin]]\n"a b".c = 1\n[x] # note\nk=1', yaml='"q k": 1\n- - deep: 2\nhttp://x\n- item\nplain', shell="function go {\nexport -x V=1\nif [ a = b ]; then\n# F=1", css="a.b:hover > .c,\n.d { margin: .5em; background: url(x.png); }\n@keyframes spin {", html="<div data-id='n' id=top>\n<p>id='no'", markdown="~~~\n# no\n~~~\n#tag\n### Deep ##",
    )).collect()
    got = {lang: [(r["line"], r["kind"], r["name"]) for r in sorted(rows, key=lambda r: (r["line"], r["col"])) if r["file"] == lang] for lang in {r["file"] for r in rows}}
    assert got["sql"] == [(1, "function", "t1"), (2, "type", "Mood"), (3, "namespace", "s"), (4, "constant", "s1"), (5, "struct", "t2")]
    assert got["ini"] == [(1, "constant", "A_B"), (2, "field", "a.b-c")] and got["dockerfile"] == [(1, "namespace", "Base"), (3, "variable", "P")]
    assert got["toml"] == [(1, "namespace", "bin"), (2, "field", '"a b".c'), (3, "namespace", "x"), (4, "field", "k")] and got["yaml"] == [(1, "field", "q k"), (2, "field", "deep")]
    assert got["shell"] == [(1, "function", "go"), (2, "variable", "V")] and got["html"] == [(1, "constant", "top")] and got["markdown"] == [(5, "namespace", "Deep")]
    assert got["css"] == [(1, "class", "b"), (1, "class", "c"), (2, "class", "d"), (3, "function", "spin")]


def test_sql_references_and_columns(spark):
    got = sql_references(files(spark, sql='SELECT * FROM "Users" u JOIN aipdc.Events e ON e.id = u.id -- FROM no\n😀 INSERT INTO x SELECT 1 FROM (SELECT 2)\nCREATE INDEX i ON Users (id)\nCREATE TABLE t (a int REFERENCES Users)')).collect()
    assert sorted((r["line"], r["col"], r["end_col"], r["name"]) for r in got) == [(1, 15, 22, "Users"), (1, 30, 42, "aipdc.events"), (2, 16, 17, "x"), (3, 19, 24, "users"), (4, 34, 39, "users")]


def test_sourced_scripts(spark):
    got = shell_imports(files(spark, shell="source ./lib/x.sh\n. \"y.bash\"\n. /etc/profile\nsource $HOME/z.sh")).collect()
    assert [(r["line"], r["name"], r["module"]) for r in got] == [(1, "x", "./lib/x.sh"), (2, "y", "y.bash")]
