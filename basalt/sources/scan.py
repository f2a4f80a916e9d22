"""Directory trees as tables: entries, and decoded texts with the reason where there is none."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import basename, extension
from ..functions.roles import is_binary_name, manifest_language

#: Bytes above which a file is skipped, and read with top-level symbols only; bytes looked at for a NUL.
MOST_BYTES, PLAIN_BYTES, SNIFFED = 5_000_000, 1_000_000, 8192

#: Languages by whole name and by extension.
BY_NAME = {"dockerfile": "dockerfile", "containerfile": "dockerfile", ".env": "ini"}
BY_EXTENSION = {
    ".py": "python", ".pyi": "python", ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".jsx": "jsx", ".go": "go", ".java": "java", ".rs": "rust", ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".sql": "sql", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml",
    ".ini": "ini", ".cfg": "ini", ".conf": "ini", ".properties": "ini", ".dockerfile": "dockerfile", ".md": "markdown", ".markdown": "markdown", ".css": "css", ".scss": "css", ".less": "css", ".html": "html", ".htm": "html",
}


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(rel, size, mtime, content) of all files below ``root``; columns that aren't selected aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", r"^[a-z]+:/*(?=/)", "")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    return files.select(F.substring(rel, len(base) + 1, 1 << 30).alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def language(rel: Column) -> Column:
    """Language of a path: by whole name, else by extension, else that of a manifest; plain text where none is known."""
    pick = lambda table, key: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]
    return F.coalesce(pick(BY_NAME, F.lower(basename(rel))), pick(BY_EXTENSION, extension(rel)), manifest_language(rel), F.lit("plaintext"))


def decode(raw: bytes) -> tuple[str, str]:
    """(text, encoding): by byte order mark, then strict UTF-8, then GBK if it reads as Chinese, at last byte by byte."""
    for mark, codec, name in ((b"\xef\xbb\xbf", "utf-8", "utf8-bom"), (b"\xff\xfe", "utf-16-le", "utf16le"), (b"\xfe\xff", "utf-16-be", "utf16be")):
        if raw.startswith(mark):
            return raw[len(mark) :].decode(codec, "replace"), name
    try:
        return raw.decode("utf-8"), "utf8"
    except UnicodeDecodeError:
        pass
    try:
        text = raw.decode("gb18030")
        far = [c for c in text if c >= "\x80"]
        chinese = sum("一" <= c <= "鿿" or "　" <= c <= "ヿ" for c in far)
        if chinese and chinese >= 0.3 * len(far):
            return text, "gbk"
    except UnicodeDecodeError:
        pass
    return raw.decode("latin-1"), "latin1"


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        done = [decode(c) if c is not None else (None, None) for c in pdf["content"]]
        yield pd.DataFrame({"rel": pdf["rel"], "size": pdf["size"], "mtime": pdf["mtime"], "lang": pdf["lang"], "skip_reason": pdf["skip_reason"], "text": [t for t, _ in done], "encoding": [e for _, e in done], "degraded": pdf["size"] > PLAIN_BYTES})


def texts(found: DataFrame) -> DataFrame:
    """Files with ``text`` and ``encoding``, or a ``skip_reason``: too large, or binary (by name, or a NUL near the start, no mark)."""
    head = F.substring("content", 1, SNIFFED)
    marked = F.substring("content", 1, 2).isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
    # every byte is one character of ISO-8859-1, so a NUL is found by a search in the head
    zero = F.instr(F.decode(head, "ISO-8859-1"), "\x00") > 0
    reason = F.when(is_binary_name(F.col("rel")) | (~marked & zero), "binary")
    columns = ["rel", "size", "mtime", language(F.col("rel")).alias("lang")]
    kept = found.where(F.col("size") <= MOST_BYTES).select(*columns, reason.alias("skip_reason"), F.when(reason.isNull(), F.col("content")).alias("content"))
    # contents of large files aren't selected, so they aren't read
    kept = kept.unionByName(found.where(F.col("size") > MOST_BYTES).select(*columns, F.lit("too-large").alias("skip_reason"), F.lit(None).cast("binary").alias("content")))
    schema = f"rel string, size long, mtime {found.schema['mtime'].dataType.simpleString()}, lang string, skip_reason string, text string, encoding string, degraded boolean"
    return kept.mapInPandas(_texts, schema)
