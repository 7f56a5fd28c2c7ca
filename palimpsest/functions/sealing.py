"""Encryption of the texts inside a JSON value, each bound to its place.

A value is taken apart into its leaves that are texts: path (keys joined by dots, places in
lists in brackets), bound data and text. Spark seals each leaf, and the value is put
together again with the sealed texts in place; everything that is no text stays as it is. A
sealed leaf opens only with its key, its bound data and its path, so a text that is moved to
another field, row or user stays shut.

Defined cases: a null or malformed value, and one without a key, stays as it is; empty texts stay;
a leaf that is sealed already, with this key and path, is not sealed again; a leaf that
cannot be opened stays sealed; keys and texts may hold any characters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..storage import bounded_batches
from .convert import decrypted, encrypted

# Fixed value: what a sealed leaf begins with.
SEALED = "json_enc::"
LEAVES = "array<struct<path:string,bound:binary,text:string>>"


def changed(value: object, change: Callable[[str, str], str], path: str = "") -> object:
    """``value`` with every text replaced by ``change(path, text)``."""
    if isinstance(value, dict):
        return {k: changed(v, change, f"{path}.{k}" if path else k) for k, v in value.items()}
    if isinstance(value, list):
        return [changed(v, change, f"{path}[{i}]") for i, v in enumerate(value)]
    return change(path, value) if isinstance(value, str) else value


def _parsed(text: object) -> object:
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return None


def leaves(value: Column, bound: Column) -> Column:
    """The texts in a JSON value in order: path, bound data and text. ``bound``: a map of names and values that every leaf is bound to."""

    bounded_batches()

    @F.pandas_udf(LEAVES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, binds in batches:
            out = []
            for v, b in zip(values, binds, strict=True):
                found: list[dict] = []

                def note(path: str, text: str, base: dict = dict(b or {}), found: list[dict] = found) -> str:
                    data = json.dumps(base | {"path": path}, sort_keys=True, separators=(",", ":"))
                    found.append({"path": path, "bound": data.encode(), "text": text})
                    return text

                changed(_parsed(v), note)
                out.append(found)
            yield pd.Series(out, dtype=object)

    return run(value, bound)


def _put(value: Column, texts: Column) -> Column:
    """The JSON value with its texts replaced, in order."""

    bounded_batches()

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, lists in batches:
            out = []
            for v, new in zip(values, lists, strict=True):
                parsed, rest = _parsed(v), iter(() if new is None else new)
                out.append(v if parsed is None else json.dumps(changed(parsed, lambda path, text, rest=rest: next(rest)), ensure_ascii=False))
            yield pd.Series(out, dtype=object)

    return F.when(texts.isNull(), value).otherwise(run(value, texts))


def sealed_json(value: Column, key: Column, bound: Column) -> Column:
    """``value`` (JSON) with its texts sealed. ``key``: 32 bytes in base64."""

    def sealed(leaf: Column) -> Column:
        inner = F.substring(leaf["text"], F.lit(len(SEALED) + 1), F.length(leaf["text"]))
        again = leaf["text"].startswith(SEALED) & (decrypted(inner, key, leaf["bound"]) != inner)
        return F.struct(leaf["text"].alias("old"), F.when(~again, encrypted(leaf["text"], key, leaf["bound"])).alias("new"))

    def seal(x: Column) -> Column:
        return F.when(x["new"].isNull() | (x["new"] == x["old"]), x["old"]).otherwise(F.concat(F.lit(SEALED), x["new"]))

    # Two steps, so that a text is encrypted once.
    return _put(value, F.when(key.isNotNull(), F.transform(F.transform(leaves(value, bound), sealed), seal)))


def opened_json(value: Column, key: Column, bound: Column) -> Column:
    """What ``sealed_json`` sealed; leaves that this key, data and path do not open stay sealed."""

    def unseal(leaf: Column) -> Column:
        inner = F.substring(leaf["text"], F.lit(len(SEALED) + 1), F.length(leaf["text"]))
        plain = decrypted(inner, key, leaf["bound"])
        return F.when(leaf["text"].startswith(SEALED) & (plain != inner), plain).otherwise(leaf["text"])

    return _put(value, F.when(key.isNotNull(), F.transform(leaves(value, bound), unseal)))
