"""Text helpers as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that paths, symbols and task ids are known by.
TASK_ID = r"[Vv][Ee]-[0-9]{3}"
SOURCE_PATH = r"(?:src|scripts)/[\w./_-]+\.(?:rs|sh)"
RELATIVE_PATH = r"(?:pipeline|src/pipeline)/[\w./_-]+\.rs"
BARE_SCRIPT = r"(?<![\w./-])([\w-]+\.sh)(?![\w./-])"
BACKTICK = r"`([A-Za-z_][\w]*)`"
DECLARED = r"(?:pub\s+)?(?:struct|fn|impl|const|enum)\s+(\w+)"
TYPE_METHOD = r"\b([A-Z][A-Za-z0-9_]*)::[a-z_][\w]*"
FENCED = r"(?s)```rust\n(.*?)```"
UNICODE = "(?U)"
#: A word ends where a capital follows a small letter or digit.
WORD = "[A-Z]+[a-z0-9]*|[a-z0-9]+"
WORDS = re.compile(WORD)


def tokenize(text: Column) -> Column:
    """Lower-case words of a text, camel case and underscores split, repeats kept."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower)


def tokens_of(text: str) -> list[str]:
    """tokenize() for a query string, on the driver."""
    return [word.lower() for word in WORDS.findall(text)]


def expanded(tokens: list[str]) -> list[str]:
    """The set of query tokens, with singulars of those in -s of over three letters."""
    return sorted({*tokens, *(t[:-1] for t in tokens if t.endswith("s") and len(t) > 3)})


def slug(text: Column) -> Column:
    made = F.btrim(F.regexp_replace(F.lower(F.btrim(text)), "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    return F.when(made == "", "section").otherwise(made)


def task_id(text: Column) -> Column:
    """The first task id, upper-case; an error if there is none."""
    found = F.regexp_extract(text, TASK_ID, 0)
    return F.when(found != "", F.upper(found)).otherwise(F.raise_error(F.concat(F.lit("no task id: "), text)))


def task_id_or_null(text: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(text, TASK_ID, 0)), F.lit(""))


def module_path(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"\.rs$", ""), "/")
    parts = F.when(F.get(parts, F.lit(0)) == "src", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    last = F.try_element_at(parts, F.lit(-1))
    return F.array_join(F.when(last.isin("mod", "lib"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), "::")


def normal_path(path: Column) -> Column:
    p = F.btrim(F.btrim(F.btrim(path), F.lit("`")))
    return (
        F.when(p.startswith("src/") | p.startswith("scripts/"), p)
        .when(p.startswith("pipeline/"), F.concat(F.lit("src/"), p))
        .when(p.endswith(".sh"), F.concat(F.lit("scripts/"), p))
        .otherwise(p)
    )


def paths(text: Column) -> Column:
    """Source paths that a text names, by form, each once in order of appearance."""
    every = lambda p, g: F.regexp_extract_all(text, F.lit(UNICODE + p), F.lit(g))
    found = F.concat(every(SOURCE_PATH, 0), every(RELATIVE_PATH, 0), every(BARE_SCRIPT, 1))
    return F.array_distinct(F.filter(F.transform(found, normal_path), lambda p: p != ""))


def search_text(neighbors: bool = True) -> Column:
    """What a chunk is found by: its non-empty fields, a line each."""
    parts = [F.col(c) for c in ("path", "module_path", "kind", "symbol", "signature", "doc", "body")]
    if neighbors:
        parts.append(F.array_join("neighbors", " "))
    parts.append(F.col("task_id"))
    return F.array_join(F.filter(F.array(*[F.coalesce(p, F.lit("")) for p in parts]), lambda p: p != ""), "\n")


def embedding_text() -> Column:
    """Labelled lines for an embedding model; the first three always, others where not empty."""
    line = lambda label, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{label}: "), value))
    always = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c), F.lit(""))) for label, c in (("module", "module_path"), ("kind", "kind"), ("symbol", "symbol"))]
    rest = [line("signature", F.col("signature")), line("doc", F.col("doc")), line("neighbors", F.array_join("neighbors", ", ")), line("task", F.col("task_id")), line("body", F.col("body"))]
    return F.array_join(F.array_compact(F.array(*always, *rest)), "\n")


def display_code() -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("body", "signature", "doc")], F.lit(""))
