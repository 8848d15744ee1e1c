"""Roles, users, categories and documents of an installation, as relations with one row for each key.

Changes are whole-table rewrites that return the new relation: write it to a new place and switch. Where several new
rows have one key, the largest in column order wins, so that a rerun gives the same table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, kept: Iterable[str] = ()) -> DataFrame:
    """old with the rows of new in the place of those of the same key; columns in kept stay as they were in old.

    Both have the columns of old; a null key is a key of its own."""
    rest = [c for c in old.columns if c != key]
    both = old.select("*", F.lit(0).alias("fathomry_age")).unionByName(new.select(*old.columns, F.lit(1).alias("fathomry_age")))
    row = F.struct(*rest)
    got = both.groupBy(key).agg(F.max_by(row, F.struct("fathomry_age", *rest)).alias("last"), F.min_by(row, F.struct("fathomry_age", *rest)).alias("first"))
    kept = set(kept)
    return got.select(*[F.col(key) if c == key else F.col(f"{'first' if c in kept else 'last'}.{c}").alias(c) for c in old.columns])


def register_roles(roles: DataFrame, new: DataFrame) -> DataFrame:
    """roles (user_id, role, name, allowed_categories, api_key); a new row replaces the whole old one."""
    return upsert(roles, new, "user_id")


def role_of(roles: DataFrame, **equal: str) -> DataFrame:
    """Rows of the given user_id or api_key."""
    for name, value in equal.items():
        roles = roles.filter(F.col(name) == F.lit(value))
    return roles


def signed_in(users: DataFrame, seen: DataFrame) -> DataFrame:
    """users (username, display_name, role, first_login, last_login, is_revoked, promoted_by) after logins: new users
    are added as they come, known ones get the new name and last login and keep everything else."""
    return upsert(users, seen, "username", ("role", "first_login", "is_revoked", "promoted_by"))


def change_users(users: DataFrame, who: Column, role: str | None = None, is_revoked: bool | None = None, by: str = "") -> DataFrame:
    """A new role (with the name of who gave it) or revocation for the rows where ``who`` holds; without either, no change."""
    new = {} if role is None else {"role": F.lit(role), "promoted_by": F.lit(by)}
    if is_revoked is not None:
        new["is_revoked"] = F.lit(is_revoked)
    return users.withColumns({c: F.when(who, v).otherwise(F.col(c)) for c, v in new.items()})


def without(table: DataFrame, gone: Column) -> DataFrame:
    """The rows where ``gone`` does not hold; rows for which it is null stay."""
    return table.filter(~F.coalesce(gone, F.lit(False)))


def pending(users: DataFrame) -> DataFrame:
    """Users who wait for approval, the latest login first."""
    return users.filter("role = 'pending'").orderBy(F.col("last_login").desc_nulls_last(), "username")


def role_from_claims(realm: Column, clients: Column, superusers: Iterable[str], admins: Iterable[str]) -> Column:
    """superuser, admin or pending, of the roles of a realm (array) and of its clients (array of arrays); null arrays have no roles."""
    none = F.array().cast("array<string>")
    own = F.array_union(F.coalesce(realm, none), F.coalesce(F.flatten(F.filter(clients, lambda c: c.isNotNull())), none))
    any_of = lambda names: F.coalesce(F.arrays_overlap(own, F.array(*[F.lit(n) for n in names])), F.lit(False))
    return F.when(any_of(superusers), "superuser").when(any_of(admins), "admin").otherwise("pending")


def categories(documents: DataFrame, known: Iterable[str]) -> DataFrame:
    """category: those of documents, null ones as General, and the known ones, each once and in order."""
    used = documents.select(F.coalesce("category", F.lit("General")).alias("category"))
    fixed = documents.sparkSession.createDataFrame([(k,) for k in known], "category string")
    return used.union(fixed).distinct().orderBy("category")


def may_ask(requested: Column, allowed: Column) -> Column:
    """Whether a request for a category (null or empty: none in particular) is allowed."""
    return (F.coalesce(requested, F.lit("")) == "") | F.coalesce(F.array_contains(allowed, requested), F.lit(False))


def visible(documents: DataFrame, readers: DataFrame) -> DataFrame:
    """user_id and the columns of documents (category, ...) that the allowed_categories of readers (user_id, ...) name."""
    pairs = readers.select("user_id", F.explode(F.array_distinct("allowed_categories")).alias("category"))
    return documents.join(pairs, "category").select("user_id", *documents.columns)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def in_files(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """hits whose file is a path of allowed (path), or has the base name of one; equal paths have equal base names."""
    names = allowed.select(base_name(F.col("path")).alias("fathomry_base")).distinct()
    return hits.join(names, base_name(F.col("file")) == F.col("fathomry_base"), "left_semi")


def add_documents(documents: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents (path, ...) after new ones, and the new rows whose text has to be indexed: those of unknown paths.
    Known paths get the new category, tags, version and dates only."""
    return upsert(documents, new, "path"), new.join(documents.select("path"), "path", "left_anti")
