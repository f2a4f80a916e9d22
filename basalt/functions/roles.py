"""What a path says of its file, as columns: test, documentation, entry, asset, manifest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import basename

#: Fixed patterns and values.
TEST_DIR = r"(?i)(^|/)(__tests__|tests?|specs?|examples?|samples?|fixtures?|e2e|benchmarks?|demo)(/|$)"
TEST_NAME = r"(?i)^test_|[._-](test|spec)s?\.[a-z0-9]+$"
JAVA_TEST = r"Tests?\.java$"
DOC_EXTENSION = r"(?i)\.(md|markdown|txt|rst|xml|ini|cfg|conf|properties|env|gitignore|editorconfig|npmrc)$"
DOC_NAME = r"(?i)^(readme|license|licence|changelog|contributing|notice|makefile|dockerfile|procfile)\.?"
ENTRY_STEMS = ("main", "index", "app", "cli", "cmd", "server", "start", "entry", "manage", "wsgi", "asgi", "__main__")
BINARY = (
    r"(?i)\.(png|jpe?g|gif|webp|ico|bmp|pdf|zip|gz|tgz|tar|jar|war|class|exe|dll|so|dylib|bin|woff2?|ttf|eot|mp[34]|wav|webm|sqlite|db|wasm|lock|map)$"
)
#: Manifests that are shown but not indexed, as language, whole names and extensions, in lower case.
MANIFESTS = (
    ("xml", ("pom.xml", "nuget.config", "packages.config", "app.config", "web.config", "directory.build.props", "directory.build.targets"), (".csproj", ".fsproj", ".vbproj", ".props", ".targets", ".nuspec", ".pubxml")),
    ("gomod", ("go.mod", "go.sum"), ()),
    ("groovy", ("build.gradle", "settings.gradle", "init.gradle"), (".gradle",)),
    ("kotlin", (), (".kts",)),
    ("scala", (), (".sbt",)),
    ("ruby", ("gemfile", "rakefile", "podfile", "fastfile", "appfile", "brewfile", "vagrantfile", "berksfile", "guardfile", "capfile", "thorfile"), (".gemspec", ".podspec")),
    ("elixir", ("mix.lock",), (".exs",)),
    ("swift", ("package.swift",), ()),
    ("toml", ("pipfile", "cargo.lock", "poetry.lock", "uv.lock", "pdm.lock"), ()),
    ("json", ("pipfile.lock", "composer.lock"), ()),
    ("yaml", ("pubspec.lock",), ()),
    ("ini", (".npmrc", ".yarnrc", ".nvmrc", ".editorconfig"), ()),
    ("makefile", ("makefile", "gnumakefile"), (".mk", ".mak")),
)
PIP = r"^(requirements|constraints)[\w.-]*\.txt$"


def is_test(path: Column) -> Column:
    """Test and example files, by a directory or by the name."""
    name = basename(path)
    return path.rlike(TEST_DIR) | name.rlike(TEST_NAME) | name.rlike(JAVA_TEST)


def is_doc_or_config(path: Column) -> Column:
    """Documents and settings: no dead code where nobody refers to them."""
    return basename(path).rlike(DOC_EXTENSION) | basename(path).rlike(DOC_NAME)


def is_binary_name(path: Column) -> Column:
    return path.rlike(BINARY)


def has_entry_name(path: Column) -> Column:
    """Whether the name up to its first dot is one that programs begin with."""
    return F.lower(F.substring_index(basename(path), ".", 1)).isin(*ENTRY_STEMS)


def entry_reasons(path: Column, declared: Column) -> Column:
    """Why a file looks like an entry: its name, or that the package's manifest lists it (``declared``, an array of paths)."""
    return F.array_compact(F.array(F.when(has_entry_name(path), F.lit("name")), F.when(F.array_contains(declared, path), F.lit("declared"))))


def manifest_language(path: Column) -> Column:
    """Language to show a manifest in: by whole name, then requirement lists, then extension; null for other files."""
    name = F.lower(basename(path))
    ending = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    by_name = [F.when(name.isin(*names), lang) for lang, names, _ in MANIFESTS if names]
    by_extension = [F.when(ending.isin(*endings), lang) for lang, _, endings in MANIFESTS if endings]
    return F.coalesce(*by_name, F.when(name.rlike(PIP), "pip"), *by_extension)
