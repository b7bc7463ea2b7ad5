"""Which loader a file goes to: by extension, else by a look at its first bytes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_text

# Extensions and their source types.
EXTENSIONS = {"pdf": "pdf", "docx": "docx", "md": "markdown", "txt": "markdown", "markdown": "markdown", "rst": "markdown", "text": "markdown"}
SNIFFED_BYTES = 8192

#: From files (path, content, source_type, sniffed) of one type to DOCUMENT rows, one or more for each.
Loader = Callable[[DataFrame], DataFrame]
_loaders: dict[str, Loader] = {}


def source_type(path: Column) -> Column:
    """By extension, whatever its case; unknown: null."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for kind in sorted(set(EXTENSIONS.values())):
        out = F.when(ending.isin([e for e, k in EXTENSIONS.items() if k == kind]), kind).otherwise(out)
    return out


def resolve(path: Column, content: Column) -> Column:
    """Struct of source_type, sniffed and error: a file of unknown extension is markdown if it looks like text."""
    known = source_type(path)
    text = looks_like_text(F.substring(content, 1, SNIFFED_BYTES))
    return F.struct(
        F.coalesce(known, F.when(text, F.lit("markdown"))).alias("source_type"),
        (known.isNull() & text).alias("sniffed"),
        F.when(known.isNull() & ~text, F.concat(F.lit("looks binary: "), path)).alias("error"),
    )


def register_loader(kind: str, loader: Loader, replace: bool = False) -> None:
    if not callable(loader):
        raise TypeError(f"the loader for {kind!r} is not callable")
    if kind in _loaders and not replace:
        raise ValueError(f"{kind!r} has a loader already")
    _loaders[kind] = loader


def get_loader(kind: str) -> Loader:
    if kind not in _loaders:
        raise KeyError(f"no loader for {kind!r}; there are {registered_source_types()}")
    return _loaders[kind]


def registered_source_types() -> list[str]:
    return sorted(_loaders)
