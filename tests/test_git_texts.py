"""Outputs of git, as it prints them, with the odd forms that the queries don't hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.sources import git_texts as git


def frame(spark, text, **more):
    names = "".join(f", {k} string" for k in more)
    return spark.createDataFrame([("r", text, *more.values()), ("none", None, *[None] * len(more)), ("empty", "", *[""] * len(more))], f"repo string, text string{names}")


def test_status(spark):
    text = '?? new.py\n M a.py\nR  old.py -> "sp ace\\".py"\nUU both.py\nAA two.py\n D gone.py\nMM m.py\n\nx\nC  a -> b\nA  n.py\n'
    got = {r["file"]: (r["status"], r["from"], r["change"]) for r in git.status(frame(spark, text), ["repo"]).collect()}
    assert got == {
        "new.py": ("added", None, "A"), "a.py": ("modified", None, "M"), 'sp ace".py': ("renamed", "old.py", "A"), "both.py": ("conflicted", None, "M"), "two.py": ("conflicted", None, "A"),
        "gone.py": ("deleted", None, "D"), "m.py": ("modified", None, "M"), "b": ("renamed", "a", "A"), "n.py": ("added", None, "A"),
    }


def test_numstat_and_status_with_counts(spark):
    text = '1\t2\ta.py\r\n-\t-\timg.png\n3\t0\tsrc/{old => new}/x.py\n4\t4\tp.py => q.py\nx\t1\tbad.py\n5\n0\t0\t"q uote.py"\n1\t1\ta\tb\n'
    counts = git.numstat(frame(spark, text), ["repo"]).persist()
    got = {r["file"]: (r["added"], r["removed"], r["binary"]) for r in counts.collect()}
    assert got == {"a.py": (1, 2, False), "img.png": (None, None, True), "src/new/x.py": (3, 0, False), "q.py": (4, 4, False), "q uote.py": (0, 0, False), "a\tb": (1, 1, False)}
    met = git.status_with_counts(git.status(frame(spark, " M a.py\n M other.py\n"), ["repo"]), counts, ["repo"]).collect()
    assert {(r["file"], r["added"]) for r in met} == {("a.py", 1), ("other.py", None)}


def test_log_and_refs(spark):
    a, b = "a" * 40, "b" * 40
    commits = git.log(frame(spark, f"{a}\x02aaaaaaa\x02{b} {b[:-1]}c\x0212\x02Ann\x02one \x02 two\n{b}\x02bbbbbbb\x02\x0211\x02\x02\nnoise\n"), ["repo"])
    named = git.refs(frame(spark, f"{a}\x02refs/tags/v1\n{a}\x02refs/heads/main\n{a}\x02refs/remotes/origin/main\n{a}\x02refs/stash\n\x02refs/heads/x\n", head="main"), ["repo"])
    got = {r["rev"]: r for r in git.log_with_refs(commits, named, ["repo"]).collect()}
    assert (got[a]["at"], got[a]["summary"], got[a]["parent_ids"]) == (12000, "one \x02 two", [b, b[:-1] + "c"]) and got[b]["parent_ids"] == [] and got[b]["refs"] == []
    assert [tuple(r) for r in got[a]["refs"]] == [("v1", "tag", False), ("main", "branch", True), ("origin/main", "remote", False)]


def test_history(spark):
    text = "A\tbefore.py\n1234567\x0210\x02Ann\x02first\r\nA\ta.py\r\nT\tt.py\n\nabcdef0\x0211\x02Bo\x02second\nR100\ta.py\td\\b.py\nC80\ta.py\tc.py\nM\n7654321\x0212\x02Cy\x02nothing\n"
    got = [(r["rev"], r["at"], r["summary"], r["status"], r["path"]) for r in git.history(frame(spark, text), ["repo"]).orderBy("pos", "ord").collect()]
    assert got == [("1234567", 10000, "first", "A", "a.py"), ("abcdef0", 11000, "second", "R", "d/b.py"), ("abcdef0", 11000, "second", "A", "a.py"), ("7654321", 12000, "nothing", None, None)]


def test_commit_changes_pair_by_position(spark):
    rows = spark.createDataFrame([(1, "M\ta\nT\tt\nR090\told\tnew\nD\td\n", "1\t2\ta\n9\t9\tt\n-\t-\tnew\n"), (2, None, None)], "id int, names string, counts string")
    got = [(r["id"], r["status"], r["path"], r["from"], r["added"], r["removed"], r["binary"]) for r in git.commit_changes(rows, ["id"]).orderBy("pos").collect()]
    assert got == [(1, "M", "a", None, 1, 2, False), (1, "R", "new", "old", None, None, True), (1, "D", "d", None, None, None, False)]


def test_commit_info(spark):
    text = "aaaaaaa\x02aaa\x02bbb ccc\x0212\x02Ann\x02a@x\x02subject\x02body one\nbody two\n\n"
    found = git.commit_info(frame(spark, text, shortstat=" 2 files changed, 5 insertions(+)\n"), ["repo"]).collect()
    assert len(found) == 1 and (found[0]["at"], found[0]["email"], found[0]["summary"], found[0]["body"], found[0]["parent_ids"]) == (12000, "a@x", "subject", "body one\nbody two", ["bbb", "ccc"])
    assert (found[0]["files"], found[0]["added"], found[0]["removed"]) == (2, 5, None)


def test_blame_carries_headers_on(spark):
    text = "1234567 1 1 2\nauthor Ann\nauthor-mail <a@x>\nauthor-time 5\nsummary one two\n\tauthor Fake\nabcdef0 9 2\nauthor Bo\nsummary s\n\t\n\t"
    got = [tuple(r)[1:] for r in git.blame(frame(spark, text), ["repo"]).collect()]
    assert sorted(got) == [(1, "1234567", "Ann", "a@x", 5000, "one two"), (2, "abcdef0", "Bo", "", 0, "s"), (2, "abcdef0", "Bo", "", 0, "s")]


def test_batches_and_hunks(spark):
    got = git.batches(frame(spark, "\x0112\x02label \x02 x\na.py\n b.py \n\n\x0111\x02\nc.py\n\x01bad\x02x\n"), ["repo"]).orderBy("pos").collect()
    assert [(r["at"], r["label"], r["files"]) for r in got] == [(12000, "label \x02 x", ["a.py", "b.py"]), (11000, None, ["c.py"])]
    found = git.hunks(frame(spark, "--- a\n+++ b\n@@ -1 +2,0 @@\n-x\n@@ -0,0 +1,3 @@ def f():\n+@@ not\n"), ["repo"]).orderBy("line")
    assert [tuple(r)[1:] for r in found.collect()] == [(3, 1, 1, 2, 0, ""), (5, 0, 0, 1, 3, "def f():")]
    assert git.hunks(frame(spark, "x"), ["repo"]).agg(F.count("*")).first()[0] == 0
