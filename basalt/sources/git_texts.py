"""What git prints, as tables: status, numstat, log, refs, history, commits, blame and diffs.

Every function takes a table with one output a row (``text``, and the columns that name it, ``keys``), so that the outputs of
many repositories are read at once. All of it is SQL functions: texts are cut at their records and exploded. Only ``blame``
needs an order among rows, inside the text of one file. Null and empty texts give no rows; lines of another form are left
out; ``pos`` counts the records of a text from 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed patterns of the formats that are asked of git: fields between U+0002, batches begin with U+0001.
LOG_LINE = "^([0-9a-f]{7,40})\x02([0-9a-f]+)\x02([0-9a-f ]*)\x02([0-9]+)\x02([^\x02]*)\x02(.*)$"
HISTORY_LINE = "^([0-9a-f]{7,40})\x02([0-9]+)\x02([^\x02]*)\x02(.*)$"
BLAME_LINE = "(?m)^([0-9a-f]{7,40}) [0-9]+ ([0-9]+)(?: [0-9]+)?$"
HUNK_LINE = r"^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@ ?(.*)$"
RENAMED_PART = r"\{[^{}]* => ([^{}]*)\}"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _records(texts: DataFrame, keys: Sequence[str], cut: str = r"\r?\n", text: str = "text") -> DataFrame:
    return texts.select(*keys, F.posexplode(F.split(text, cut)).alias("pos", "part")).where("part <> ''")


def _field(pattern: str, group: int, of: str = "part") -> Column:
    return F.regexp_extract(of, pattern, group)


def _millis(seconds: Column) -> Column:
    return seconds.try_cast("bigint") * 1000


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def unquoted(path: Column) -> Column:
    """A path as git quotes it: without its quotes, and escaped characters as they are."""
    path = _trim(path)
    return F.when(path.rlike('(?s)^".*"$') & (F.length(path) > 1), F.regexp_replace(F.substring(path, F.lit(2), F.length(path) - 2), r"\\(.)", "$1")).otherwise(path)


def new_path(path: Column) -> Column:
    """The path after a renaming: of ``a/{b => c}/d`` or ``a => b`` the new side, with slashes and without quotes."""
    path = _trim(path)
    plain = F.when(path.contains(" => "), F.regexp_replace(path, "(?s)^.* => ", "")).otherwise(path)
    path = F.when(path.rlike(RENAMED_PART), F.regexp_replace(path, "^(.*?)" + RENAMED_PART, "$1$2")).otherwise(plain)
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), '^"|"$', "")


def worktree_status(x: Column, y: Column) -> Column:
    """State of a file by both status letters; what stands first wins. Files that git doesn't know yet are added."""
    either = lambda *letters: x.isin(*letters) | y.isin(*letters)
    both = lambda letter: (x == letter) & (y == letter)
    return (
        F.when(either("?"), "added").when(either("U") | both("A") | both("D"), "conflicted").when(either("R", "C"), "renamed")
        .when(either("A"), "added").when(either("D"), "deleted").otherwise("modified")
    )


def change_status(code: Column) -> Column:
    """M, A or D, for a comparison of snapshots: renamed and copied files are new ones, their old paths are missing anyway."""
    return F.when((code == "??") | code.rlike("[RC]"), "A").when(code.contains("D"), "D").when(code.contains("A"), "A").otherwise("M")


def status(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, file, from, status, change) of ``git status --porcelain -uall``; ``from`` of renamed files only."""
    rows = _records(texts, keys, "\n").where(F.length(_trim(F.col("part"))) >= 4)
    x, y, rest = F.substring("part", 1, 1), F.substring("part", 2, 1), F.regexp_replace("part", "(?s)^.{3}", "")
    sides = F.split(rest, " -> ")
    moved = x.isin("R", "C") & (F.size(sides) == 2)
    return rows.select(
        *keys, "pos", unquoted(F.when(moved, F.get(sides, F.lit(1))).otherwise(rest)).alias("file"), F.when(moved, unquoted(F.get(sides, F.lit(0)))).alias("from"),
        worktree_status(x, y).alias("status"), change_status(_trim(F.concat(x, y))).alias("change"),
    )


def numstat(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, file, added, removed, binary) of ``git diff --numstat``; binary files have no counts."""
    rows = _records(texts, keys).withColumn("cells", F.split(F.regexp_replace("part", r"\s+$", ""), "\t", 3)).where("size(cells) = 3")
    rows = rows.select(*keys, "pos", new_path(F.get("cells", F.lit(2))).alias("file"), *_counts(F.col("cells")))
    return rows.where("file <> '' and (binary or (added is not null and removed is not null))")


def _counts(cells: Column) -> tuple[Column, Column, Column]:
    added, removed = F.get(cells, F.lit(0)), F.get(cells, F.lit(1))
    binary = F.coalesce((added == "-") | (removed == "-"), F.lit(False))
    known = ~binary & added.rlike("^[0-9]+$") & removed.rlike("^[0-9]+$")
    return F.when(known, added.try_cast("bigint")).alias("added"), F.when(known, removed.try_cast("bigint")).alias("removed"), binary.alias("binary")


def status_with_counts(changed: DataFrame, counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row of ``status`` with its counted lines, where ``numstat`` names the file."""
    return changed.join(counts.drop("pos"), [*keys, "file"], "left")


def log(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, rev, short_rev, at, author, summary, parent_ids): commits, ``at`` in milliseconds; the first has no parents."""
    rows = _records(texts, keys).where(F.col("part").rlike(LOG_LINE))
    parents = F.filter(F.split(_field(LOG_LINE, 3), " +"), lambda p: p != "")
    return rows.select(*keys, "pos", _field(LOG_LINE, 1).alias("rev"), _field(LOG_LINE, 2).alias("short_rev"), _millis(_field(LOG_LINE, 4)).alias("at"), _field(LOG_LINE, 5).alias("author"), _field(LOG_LINE, 6).alias("summary"), parents.alias("parent_ids"))


def refs(texts: DataFrame, keys: Sequence[str], head: str = "head") -> DataFrame:
    """(keys, pos, commit, name, type, is_head) of branches, tags and remote branches; column ``head`` names the current branch."""
    rows = _records(texts, [*keys, head]).where(F.col("part").rlike("^[^\x02]*[^\x02 ][^\x02]*\x02\\s*refs/(heads|tags|remotes)/"))
    ref = "\x02\\s*refs/(heads|tags|remotes)/(.*?)\\s*$"
    rows = rows.select(*keys, "pos", head, _trim(F.split("part", "\x02")[0]).alias("commit"), _field(ref, 2).alias("name"), _field(ref, 1).alias("of"))
    kind = F.when(F.col("of") == "heads", "branch").when(F.col("of") == "tags", "tag").otherwise("remote")
    return rows.select(*keys, "pos", "commit", "name", kind.alias("type"), F.coalesce((kind == "branch") & (F.col("name") == F.col(head)), F.lit(False)).alias("is_head"))


def log_with_refs(commits: DataFrame, named: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Commits with their ``refs``, an array of (name, type, is_head) in git's order; empty where nothing names a commit."""
    entry = F.struct("name", "type", "is_head")
    groups = named.groupBy(*keys, F.col("commit").alias("rev")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("ref")))), lambda r: r["ref"]).alias("refs"))
    none = F.array().cast(groups.schema["refs"].dataType)
    return commits.join(groups, [*keys, "rev"], "left").withColumn("refs", F.coalesce("refs", none))


def _changed(cells: Column) -> tuple[Column, Column, Column]:
    """Status, path and old path of a name-status line: a copy is an added file; T, U and X have no status."""
    code = F.upper(F.substring(F.get(cells, F.lit(0)), 1, 1))
    kind = F.when(code == "C", "A").when(code.isin("M", "A", "D", "R"), code)
    path = F.get(cells, F.when(code == "R", 2).otherwise(1))
    return kind.alias("status"), F.replace(path, F.lit("\\"), F.lit("/")).alias("path"), F.when(code == "R", F.get(cells, F.lit(1))).alias("from")


def history(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, rev, at, author, summary, ord, status, path) of a file's history, renamed or not: one row a change.

    A commit without changes has one row without ``status``. What stands before the first commit is left out.
    """
    blocks = _records(texts, keys, "(?m)^(?=[0-9a-f]{7,40}\x02[0-9]+\x02)").withColumn("lines", F.split("part", r"\r?\n")).withColumn("first", F.get("lines", F.lit(0)))
    blocks = blocks.where(F.col("first").rlike(HISTORY_LINE))
    changes = F.transform(F.slice("lines", F.lit(2), F.size("lines")), lambda line, i: F.struct(i.alias("ord"), *_changed(F.split(line, "\t"))))
    kept = F.filter(changes, lambda c: c["status"].isNotNull() & (F.coalesce(c["path"], F.lit("")) != ""))
    commit = [_field(HISTORY_LINE, 1, "first").alias("rev"), _millis(_field(HISTORY_LINE, 2, "first")).alias("at"), _field(HISTORY_LINE, 3, "first").alias("author"), _field(HISTORY_LINE, 4, "first").alias("summary")]
    return blocks.select(*keys, "pos", *commit, F.explode_outer(kept).alias("c")).select(*keys, "pos", "rev", "at", "author", "summary", "c.ord", "c.status", "c.path")


def commit_changes(texts: DataFrame, keys: Sequence[str], names: str = "names", counts: str = "counts") -> DataFrame:
    """(keys, pos, status, path, from, added, removed, binary) of one commit: name-status and numstat name the files in one order."""
    lines = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: x != "")
    rows = texts.select(*keys, F.posexplode(F.arrays_zip(lines(F.col(names)).alias("name"), lines(F.col(counts)).alias("count"))).alias("pos", "z"))
    rows = rows.select(*keys, "pos", *_changed(F.split("z.name", "\t")), *_counts(F.split("z.count", "\t")))
    return rows.where("status is not null and path <> ''")


def commit_info(texts: DataFrame, keys: Sequence[str], text: str = "text", shortstat: str = "shortstat") -> DataFrame:
    """(keys, rev, short_rev, at, author, email, summary, body, parent_ids, files, added, removed) of shown commits."""
    head = F.regexp_extract(text, "^([^\r\n]*)", 1)
    rest = F.regexp_replace(text, "^[^\n]*\n?", "")
    rows = texts.withColumn("seg", F.split(head, "\x02", 8)).withColumn("rest", rest).where("size(seg) >= 7")
    seg = lambda i: F.get("seg", F.lit(i))
    body = _trim(F.concat_ws("\n", _or_null(_trim(F.coalesce(seg(7), F.lit("")))), F.when(_trim(F.col("rest")) != "", F.col("rest"))))
    stat = lambda what: F.regexp_extract(F.coalesce(shortstat, F.lit("")), rf"([0-9]+) {what}", 1).try_cast("bigint")
    return rows.select(
        *keys, seg(0).alias("rev"), seg(1).alias("short_rev"), F.coalesce(_millis(seg(3)), F.lit(0)).alias("at"), seg(4).alias("author"), seg(5).alias("email"), seg(6).alias("summary"), body.alias("body"),
        F.filter(F.split(seg(2), " +"), lambda p: p != "").alias("parent_ids"), F.coalesce(stat("files? changed"), F.lit(0)).alias("files"), stat("insertions?").alias("added"), stat("deletions?").alias("removed"),
    )


def batches(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, pos, at, label, files): commits as batches of files."""
    rows = _records(texts, keys, "\x01").where(_trim(F.col("part")) != "").withColumn("lines", F.split("part", "\n"))
    head = F.split(F.get("lines", F.lit(0)), "\x02", 2)
    files = F.filter(F.transform(F.slice("lines", F.lit(2), F.size("lines")), _trim), lambda f: f != "")
    return rows.select(*keys, "pos", _millis(head[0]).alias("at"), _or_null(_trim(F.get(head, F.lit(1)))).alias("label"), files.alias("files")).where("at is not null")


def blame(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line, rev, author, email, at, summary) of ``git blame --line-porcelain``, one row for each line of the file.

    A line of code without a header above it belongs to the last header of its file; ``keys`` must name one file each.
    """
    blocks = texts.select(*keys, F.posexplode(F.split("text", "(?m)^\t.*(?:\n|$)", -1)).alias("pos", "part"), F.size(F.regexp_extract_all("text", F.lit("(?m)^\t"), F.lit(0))).alias("n")).where("pos < n")
    meta = lambda name: _field(rf"(?m)^{name} (.*)$", 1)
    email = F.regexp_replace(meta("author-mail"), "^<|>$", "")
    found = F.struct(_field(BLAME_LINE, 2).cast("int").alias("line"), _field(BLAME_LINE, 1).alias("rev"), meta("author").alias("author"), email.alias("email"), F.coalesce(_millis(meta("author-time")), F.lit(0)).alias("at"), meta("summary").alias("summary"))
    carried = F.last(F.when(F.col("part").rlike(BLAME_LINE), found), ignorenulls=True).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("b", carried).where("b is not null").select(*keys, "b.*")


def hunks(texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, line, old_start, old_count, new_start, new_count, heading) of unified diffs; a count that isn't written is 1."""
    rows = _records(texts, keys).where(F.col("part").rlike(HUNK_LINE))
    number = lambda g: F.coalesce(_field(HUNK_LINE, g).try_cast("int"), F.lit(1))
    return rows.select(*keys, (F.col("pos") + 1).alias("line"), number(1).alias("old_start"), number(2).alias("old_count"), number(3).alias("new_start"), number(4).alias("new_count"), _field(HUNK_LINE, 5).alias("heading"))
