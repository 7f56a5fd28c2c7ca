"""Table operators: upserts, filters, paging, deletes, flags and counts."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.convert import decrypted, encrypted
from ..functions.vectors import padded

CONDITION = re.compile(r"^\s*(?:\w+\.)?(\w+)\s*(<=|>=|!=|=|<|>)\s*(.+?)\s*$")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], mode: str = "replace", columns: list[str] | None = None) -> DataFrame:
    """``replace``: an update takes the place of the row with its key; ``ignore``: it only comes in where there is none; ``merge``: it changes ``columns`` of that row (an update without one comes in, other columns null).

    Updates have one row a key.
    """
    if mode == "ignore":
        return target.unionByName(updates.join(target.select(keys), keys, "left_anti"))
    if mode == "replace":
        return target.join(updates.select(keys), keys, "left_anti").select(target.columns).unionByName(updates)
    if mode != "merge":
        raise ValueError(f"unknown mode {mode!r}")
    new = updates.select(*keys, *[F.col(c).alias(f"{c}__new") for c in columns or ()], F.lit(True).alias("__hit"))
    kept = target.join(new, keys, "left").select(*[F.when(F.col("__hit"), F.col(f"{c}__new")).otherwise(F.col(c)).alias(c) if c in (columns or ()) else F.col(c) for c in target.columns])
    return kept.unionByName(updates.join(target.select(keys), keys, "left_anti"), allowMissingColumns=True)


def latest(df: DataFrame, keys: list[str], order: Column, *ties: str) -> DataFrame:
    """The row of each key that is last by ``order``; ties go to the last by ``ties``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc_nulls_last(), *[F.col(t).desc() for t in ties]))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def store_vectors(vectors: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """Upsert by (id, sector), padded or cut to ``dim``; ``dim`` as a column keeps the length that counts."""
    fixed = new.withColumn("dim", F.least(F.size("v"), F.lit(dim))).withColumn("v", padded(F.col("v"), dim))
    return upsert(vectors, fixed, ["id", "sector"])


def _value(text: str, params: list) -> Any:
    if text == "%s":
        return params.pop(0)
    if text[0] in "'\"" and text[-1] == text[0]:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def filter_conditions(df: DataFrame, conditions: list[str], params: list | None = None) -> DataFrame:
    """Rows that meet all of ``column op value``; ``%s`` takes the next parameter. Unknown columns raise."""
    params = list(params or [])
    for text in conditions:
        m = CONDITION.match(text)
        if not m:
            raise ValueError(f"not a condition: {text!r}")
        name, op, value = m[1], m[2], _value(m[3], params)
        if name not in df.columns:
            raise ValueError(f"unknown column {name!r}")
        c = F.col(name)
        df = df.where({"=": c == value, "!=": c != value, "<": c < value, ">": c > value, "<=": c <= value, ">=": c >= value}[op])
    return df


def order_columns(df: DataFrame, specs: list[str]) -> list[Column]:
    """Sort columns from ``[alias.]column [asc|desc]``; nulls come last ascending and first descending."""
    out = []
    for text in specs:
        name, _, way = text.strip().partition(" ")
        name = name.rpartition(".")[2]
        if name not in df.columns:
            raise ValueError(f"unknown column {name!r}")
        c = F.col(name)
        out.append(c.desc_nulls_first() if way.strip().lower() == "desc" else c.asc_nulls_last())
    return out


def order_by_spec(df: DataFrame, specs: list[str]) -> DataFrame:
    return df.orderBy(*order_columns(df, specs))


def page(df: DataFrame, order: list[Column | str], current: int = 1, size: int = 10, within: list[str] | None = None) -> DataFrame:
    """Rows of a page with ``total`` beside them. With ``within``, a page of each of its groups."""
    first = (max(1, current) - 1) * size
    if within:
        rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        total = F.count(F.lit(1)).over(Window.partitionBy(*within))
        return df.withColumns({"total": total, "__rank": rank}).where(F.col("__rank").between(first + 1, first + size)).drop("__rank")
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(first).limit(size).crossJoin(F.broadcast(total))


def resolve_users(identities: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Users by tenant, project and user key, and the identities that lack one of these."""
    keys = ["tenant_key", "project_key", "user_key"]
    full = F.lit(True)
    for k in keys:
        full = full & (F.coalesce(F.trim(k), F.lit("")) != "")
    return identities.where(full).join(users, keys), identities.where(~full)


def find_users(users: DataFrame, ids: list[str] | None = None, status: int | None = None, order: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    if ids is not None:
        users = users.where(F.col("id").isin(ids))
    if status is not None:
        users = users.where(F.col("status") == status)
    users = users.orderBy(*order_columns(users, order or []), "id")
    users = users.offset(offset) if offset else users
    return users if limit is None else users.limit(limit)


def get(df: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    return df.join(ids, "id", "left_semi") if isinstance(ids, DataFrame) else df.where(F.col("id").isin(ids))


def pending(memories: DataFrame, flag: str, cutoff: Column) -> DataFrame:
    return memories.where(~F.coalesce(F.col(flag), F.lit(False)) & (F.col("created_at") < cutoff)).orderBy("created_at", "id")


def day_cutoff(as_of: Column) -> Column:
    """The last second of the day before."""
    return F.date_trunc("DAY", as_of).cast("timestamp_ntz") - F.expr("INTERVAL 1 SECOND")


def public_memory(memories: DataFrame) -> DataFrame:
    return memories.drop("mean_vec", "compressed_vec", "mean_dim", "v")


def count_by_user(memories: DataFrame, conditions: list[str] | None = None) -> DataFrame:
    return filter_conditions(memories, conditions or []).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def memories_with_vectors(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row for each sector a memory has a vector in."""
    return memories.join(vectors.where(F.col("v").isNotNull()).select("id", "sector", "v", "dim"), "id")


def delete_memories(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The tables without the memories ``ids`` (id), their vectors and their waypoints at either end."""
    gone = ids.select("id").distinct()
    out = dict(tables)
    for name in ("memories", "vectors"):
        if name in out:
            out[name] = out[name].join(gone, "id", "left_anti")
    if "waypoints" in out:
        for end in ("src_id", "dst_id"):
            out["waypoints"] = out["waypoints"].join(gone.withColumnRenamed("id", end), end, "left_anti")
    return out


def clear_users(tables: dict[str, DataFrame], users: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows of ``users`` (user_id), and how many rows each loses."""
    gone = users.select("user_id").distinct()
    lost = [t.join(gone, "user_id", "left_semi").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n")) for name, t in tables.items()]
    counts = lost[0]
    for x in lost[1:]:
        counts = counts.union(x)
    return {name: t.join(gone, "user_id", "left_anti") for name, t in tables.items()}, counts


def mark(memories: DataFrame, ids: DataFrame, flag: str) -> DataFrame:
    """Set a flag of the memories ``ids`` (id)."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    old = F.coalesce(F.col(flag), F.lit(False)) if flag in memories.columns else F.lit(False)
    return memories.join(hit, "id", "left").withColumn(flag, F.coalesce(F.col("__hit"), old)).drop("__hit")


def rotate_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add active profiles; those of the same users so far become inactive. ``new`` has one row a user."""
    fresh = new.select("user_id").distinct().withColumn("__new", F.lit(True))
    kept = old.join(fresh, "user_id", "left").withColumn("is_active", F.col("is_active") & F.col("__new").isNull()).drop("__new")
    return kept.unionByName(new.withColumn("is_active", F.lit(True)))


def dedup_records(df: DataFrame, columns: list[str], place: str) -> tuple[DataFrame, DataFrame]:
    """The first of equal records, and the others with the place of the first; fields compare as JSON with sorted names."""
    first = F.min(place).over(Window.partitionBy(F.to_json(F.struct(*sorted(columns)))))
    ranked = df.withColumn("first_place", first)
    return ranked.where(F.col(place) == F.col("first_place")).drop("first_place"), ranked.where(F.col(place) != F.col("first_place"))


def route_content(df: DataFrame, type_col: str) -> tuple[DataFrame, DataFrame]:
    """Add ``route`` (pdf, docx, html, markdown, text) by content type, tested in this order; rows of unknown type are rejects."""
    t = F.lower(F.coalesce(F.col(type_col), F.lit("")))
    route = F.when(t.contains("pdf"), "pdf").when(t.contains("docx") | t.contains("word"), "docx").when(t.contains("html"), "html").when(t.contains("markdown") | (t == "md"), "markdown").when(t.contains("text") | (t == "txt"), "text")
    routed = df.withColumn("route", route)
    return routed.where(F.col("route").isNotNull()), routed.where(F.col("route").isNull())


def _with_keys(df: DataFrame, users: DataFrame) -> DataFrame:
    """``df`` with the key of each row's user (users: id, encryption_key; one row a user) as ``__key``."""
    return df.join(users.select(F.col("id").alias("user_id"), F.col("encryption_key").alias("__key")), "user_id", "left")


def seal(df: DataFrame, users: DataFrame, aad: dict[str, Column]) -> DataFrame:
    """Encrypt columns with their user's key; ``aad`` gives each column's bound data. Rows of users without a key stay as they are."""
    keyed = _with_keys(df, users)
    sealed = {c: F.when(F.col("__key").isNull(), F.col(c)).otherwise(encrypted(F.col(c), F.col("__key"), data)) for c, data in aad.items()}
    return keyed.withColumns(sealed).select(df.columns)


def unseal(df: DataFrame, users: DataFrame, aad: dict[str, Column]) -> DataFrame:
    """Decrypt columns with their user's key; what the key does not open stays as it is."""
    keyed = _with_keys(df, users)
    opened = {c: F.when(F.col("__key").isNull(), F.col(c)).otherwise(decrypted(F.col(c), F.col("__key"), data)) for c, data in aad.items()}
    return keyed.withColumns(opened).select(df.columns)
