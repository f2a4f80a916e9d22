"""Facts of files by extractors that are registered for their languages, each file within a deadline of its own.

An extractor is a function of a file's path and text that gives rows, as dictionaries of columns of ``python_facts.SCHEMA``.
Whatever goes wrong with one file becomes a row of fact ``error`` and leaves the others alone.
"""

from __future__ import annotations

import importlib
import signal
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .python_facts import COLUMNS, INTS, SCHEMA, extract_python

Extractor = Callable[[str, str], Iterable[dict]]

#: Bytes below which a file has no deadline; seconds that others have, for each KB besides, and at most.
UNTIMED, LEAST, EACH_KB, MOST = 64 * 1024, 1.0, 0.0015, 10.0


def budget(text: str) -> float | None:
    """Seconds that a text may take, by its size; none for small ones."""
    size = len(text.encode("utf-8", "surrogatepass"))
    return None if size < UNTIMED else min(MOST, LEAST + size / 1024 * EACH_KB)


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Ends what runs inside by TimeoutError after some seconds, in the main thread of a process."""
    if not seconds:
        yield
        return

    def over(*_) -> None:
        raise TimeoutError(f"more than {seconds} s")

    before = signal.signal(signal.SIGALRM, over)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def rows_of(extract: Extractor, file: str, text: str, seconds: float | None = None) -> list[dict]:
    """The rows of one file, or one that says what went wrong: timeout, parse-failed, or extractor-failed."""
    try:
        with deadline(budget(text) if seconds is None else seconds):
            rows = [{"file": file, "ord": k} | row for k, row in enumerate(extract(file, text))]
        if unknown := {c for r in rows for c in r} - set(COLUMNS):
            raise ValueError(f"unknown columns {sorted(unknown)}")
        return rows
    except TimeoutError as error:
        kind, told = "timeout", error
    except (SyntaxError, ValueError, RecursionError) as error:
        kind, told = "parse-failed", error
    except Exception as error:  # noqa: BLE001  an extractor may fail in any way
        kind, told = "extractor-failed", error
    return [{"file": file, "fact": "error", "kind": kind, "text": str(told)[:200], "ord": 0}]


def extracted(files: DataFrame, extractors: dict[str, Extractor] | None = None, seconds: float | None = None, per_batch: int = 256) -> DataFrame:
    """Facts of ``files`` (rel, lang, text) in the languages of ``extractors``; Python's is there unless another takes its place.

    ``seconds`` is every file's deadline; without it that goes by the file's size.
    """
    known = {"python": extract_python} | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), per_batch):
                part = pdf.iloc[at : at + per_batch]
                rows = [dict.fromkeys(COLUMNS) | r for rel, lang, text in zip(part["rel"], part["lang"], part["text"]) for r in rows_of(known[lang], rel, text, seconds)]
                out = pd.DataFrame(rows, columns=COLUMNS)
                for c in INTS:
                    out[c] = out[c].astype("Int32")
                yield out

    return files.where(F.col("lang").isin(*known) & F.col("text").isNotNull()).select("rel", "lang", "text").mapInPandas(run, SCHEMA)


def discovered(modules: Iterable[str]) -> tuple[dict[str, Extractor], dict[str, str]]:
    """Extractors of modules with ``LANGUAGE`` and ``extract``, and what is wrong with the others; a later one of a language wins."""
    found: dict[str, Extractor] = {}
    wrong: dict[str, str] = {}
    for name in modules:
        try:
            module = importlib.import_module(name)
            language, extract = module.LANGUAGE, module.extract
            if not (isinstance(language, str) and language and callable(extract)):
                raise TypeError("LANGUAGE must be a name and extract a function")
            found[language] = extract
        except Exception as error:  # noqa: BLE001  a module may fail in any way
            wrong[name] = f"{type(error).__name__}: {error}"
    return found, wrong
