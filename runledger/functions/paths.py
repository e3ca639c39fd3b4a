"""Attributes and tests on report paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from runledger import constants as K


def path_parts(path: Column) -> Column:
    """Path components after collapsing ``//`` and ``/./``."""
    return F.split(F.regexp_replace(path, r"/(?:\.?/)+", "/"), "/")


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root`` with a leading slash, scheme removed."""
    plain = F.regexp_replace(path, r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    root = "/" + root.split(":", 1)[-1].strip("/") if root.strip("/") else ""
    return F.when(
        F.startswith(plain, F.lit(root + "/")), F.substring(plain, len(root) + 1, 2**31 - 1)
    ).otherwise(plain)


def path_attributes(
    path: Column, strip_token: str | None = K.STRIPPED_PATH_TOKEN, key_value: bool = False
) -> dict[str, Column]:
    """The seven lookup attributes from their places in the path, ninth to third from its end.

    ``strip_token`` is taken out wherever it occurs, so ``layout`` reads ``lay``; None
    turns that off. ``key_value`` reads ``name=value`` components, the layout Spark's
    own ``partitionBy`` writes.
    """
    parts = path_parts(path)
    out = {}
    for place, name in enumerate(K.LOOKUP_KEY, start=-9):
        part = F.try_element_at(parts, F.lit(place))
        if key_value:
            part = F.regexp_replace(part, r"\A[^=]*=", "")
        part = F.lower(part)
        if strip_token:
            part = F.replace(part, F.lit(strip_token), F.lit(""))
        out[name] = part
    return out


def inner_components(path: Column) -> Column:
    """Components with a slash on both sides, each once."""
    parts = path_parts(path)
    return F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_named(path: Column, name: str) -> Column:
    """File name test that ignores case."""
    return F.lower(file_name(path)) == name.lower()


def has_suffix(path: Column, suffix: str = ".log") -> Column:
    return F.endswith(file_name(path), F.lit(suffix))
