"""Relational operators: lookups, joins along keys, checks and row changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import is_email
from millrace.operators.keyed import free_name
from millrace.sources.workspace import materialize


class LookupFailed(LookupError):
    """A lookup by a unique key found no row, or more than one."""


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the values; null never does."""
    for name, value in values.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def lookup(df: DataFrame, **key) -> Row:
    """The only row of a unique key. Two rows at most come to the driver."""
    found = where_equal(df, **key).limit(2).collect()
    if len(found) != 1:
        raise LookupFailed(f"{'several rows' if found else 'no row'} for {key}")
    return found[0]


def without(df: DataFrame, *names: str) -> DataFrame:
    """Projection by exclusion; every name must be there."""
    if missing := set(names) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*names)


def add_column(df: DataFrame, other: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a column of another frame, aligned by row id; rows without a partner get null."""
    return df.join(other.select(key, name), key, "left")


def relabel(df: DataFrame, prefix: str, start: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Renames all columns but ``keep`` to prefix and number, counting from ``start``."""
    names, n = [], start
    for c in df.columns:
        if c not in keep:
            c, n = f"{prefix}{n}", n + 1
        names.append(c)
    return df.toDF(*names)


def vector_slice(df: DataFrame, vector: str, positions: Sequence[int], prefix: str, *others: str) -> DataFrame:
    """Some positions (from 0) of an array column as columns of their own."""
    picked = [F.element_at(vector, p + 1).cast("double").alias(f"{prefix}{i}") for i, p in enumerate(positions)]
    return df.select(*picked, *others)


def profile_with_user(profiles: DataFrame, users: DataFrame, profile_key: str, user_key: str, email: str) -> DataFrame:
    """Profile rows with their user's email as both ``user`` and ``email``; the join may shadow the profile's own email.

    Key join, inner: the key is required and unique on the user's side. The optimizer broadcasts the users if they
    are within its threshold.
    """
    own = profiles.drop("user", "email")
    name = free_name(own, "owner")
    owner = users.select(F.col(user_key).alias(name), F.col(email).alias("user"))
    return own.join(owner, F.col(profile_key) == F.col(name)).drop(name).withColumn("email", F.col("user"))


def own_profile(users: DataFrame, profiles: DataFrame, user_key: str, profile_key: str) -> DataFrame:
    """Users with their profile; users without one are left out (``missing_profiles`` finds them)."""
    return users.join(profiles, users[user_key] == profiles[profile_key])


def missing_profiles(users: DataFrame, profiles: DataFrame, user_key: str, profile_key: str) -> DataFrame:
    """Users without a profile; a user without a key has none, and meets no join."""
    known = users.where(F.col(user_key).isNotNull())
    missing = known.join(profiles, known[user_key] == profiles[profile_key], "left_anti")
    return missing.unionByName(users.where(F.col(user_key).isNull()))


def insert_missing(profiles: DataFrame, users: DataFrame, profile_key: str, user_key: str, **defaults) -> DataFrame:
    """Appends a profile of defaults for every user that has none; columns without a default are null.

    A null key belongs to nobody: such users get no profile. Users that repeat get one.
    """
    missing = missing_profiles(users.where(F.col(user_key).isNotNull()), profiles, user_key, profile_key).select(user_key).distinct()
    kinds = {f.name: f.dataType for f in profiles.schema.fields}
    value = lambda c: F.col(user_key) if c == profile_key else F.lit(defaults.get(c))
    return profiles.unionByName(missing.select(*[value(c).cast(kinds[c]).alias(c) for c in profiles.columns]))


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once; null keys do not count. Only key counts are shuffled before the join."""
    again = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    return df.join(again, key, "left_semi")


def uniqueness(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Adds ``unique``: no other new row and no existing row has the key. Rows without a key are unique, and meet no join."""
    times, there = free_name(new, "times"), free_name(new, "there")
    known = new.where(F.col(key).isNotNull())
    counted = known.groupBy(key).agg(F.count("*").alias(times))
    held = existing.where(F.col(key).isNotNull()).select(key).distinct().withColumn(there, F.lit(True))
    met = known.join(counted, key).join(held, key, "left").withColumn("unique", (F.col(times) == 1) & F.col(there).isNull())
    out = [*[c for c in new.columns if c != "unique"], "unique"]
    return met.select(out).unionByName(new.where(F.col(key).isNull()).withColumn("unique", F.lit(True)).select(out))


def validate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Adds ``errors``, the messages of the checks that a row fails; a null outcome is a failure."""
    messages = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(text)) for text, ok in checks.items()]
    return df.withColumn("errors", F.filter(F.array(*messages), lambda m: m.isNotNull()))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows without ``errors``, rejected rows with them)."""
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def profile_checks(language: Column, lengths: Mapping[str, tuple[Column, int]], email: Column | None = None) -> dict[str, Column]:
    """The checks of a profile: allowed language, field lengths, form of the email address."""
    checks = {"The provided language is not valid.": language.isin("en", "es")}
    for name, (column, most) in lengths.items():
        checks[f"{name} is longer than {most} characters"] = column.isNull() | (F.length(column) <= most)
    if email is not None:
        checks["Enter a valid email address."] = is_email(email)
    return checks


def append_rows(df: DataFrame, new: DataFrame, **server_set) -> DataFrame:
    """Appends rows; the named columns are set by the server whatever the new rows say."""
    return df.unionByName(new.withColumns({k: F.lit(v).cast(df.schema[k].dataType) for k, v in server_set.items()}).select(df.columns))


def last_by_key(changes: DataFrame, key: str) -> DataFrame:
    """One row a key: of rows that repeat a key that of the largest values, column by column from the first."""
    others = [c for c in changes.columns if c != key]
    if not others:
        return changes.distinct()
    last = free_name(changes, "last")
    found = changes.groupBy(key).agg(F.max(F.struct(*others)).alias(last))
    return found.select(*[F.col(key) if c == key else F.col(f"{last}.{c}").alias(c) for c in changes.columns])


def update_by_key(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Full update: a row whose key is in ``changes`` takes its values of the columns that ``changes`` has, nulls too.

    Of changes that repeat a key the one of the largest values counts (``last_by_key``). Null keys match nothing, and
    rows that have one do not take part in the join.
    """
    hit = free_name(df, "hit", changes.columns)
    names = {c: free_name(df, f"new_{c}", [hit]) for c in changes.columns}
    named = last_by_key(changes.where(F.col(key).isNotNull()), key).select([F.col(c).alias(n) for c, n in names.items()]).withColumn(hit, F.lit(True))
    joined = df.where(F.col(key).isNotNull()).join(named, F.col(key) == F.col(names[key]), "left")
    value = lambda c: F.when(F.col(hit), F.col(names[c])).otherwise(F.col(c)).alias(c) if c in names and c != key else F.col(c)
    return joined.select([value(c) for c in df.columns]).unionByName(df.where(F.col(key).isNull()))


def cascade_delete(
    tables: Mapping[str, DataFrame], references: Sequence[tuple[str, str, str, str]], gone: Mapping[str, DataFrame], rounds: int = 100
) -> dict[str, DataFrame]:
    """Every table without the rows that a delete takes along.

    ``references`` are (child, column, parent, parent's key): a child whose column holds the key of a deleted parent is deleted
    too, and so on to the last. ``gone`` has, by table, a frame of its keys that are deleted, in a column of the key's name.
    The keys of deleted rows are found table by table from the parents down, with semi joins, and written in the shared folder; a
    table that is reached again, by another way or around a cycle, goes on with the new keys alone, until there are
    none. Survivors are what is left by an anti join. Null references belong to nobody; repeated keys go together.
    """
    keys = {parent: key for _, _, parent, key in references}
    dead: dict[str, DataFrame] = {}
    new = {t: materialize(k.select(keys.get(t, k.columns[0])).distinct(), "cascade") for t, k in gone.items()}
    columns = {t: k.columns[0] for t, k in new.items()}
    extra: dict[str, list[tuple[str, DataFrame]]] = {t: [] for t in tables}
    for _ in range(rounds):
        new = {t: k for t, k in new.items() if not k.isEmpty()}
        if not new:
            break
        for t, k in new.items():
            dead[t] = k if t not in dead else materialize(dead[t].unionByName(k), "cascade")
        found: dict[str, DataFrame] = {}
        for child, column, parent, key in references:
            if parent not in new:
                continue
            of = new[parent].select(F.col(key).alias(column))
            extra[child].append((column, of))
            if child in keys:
                hit = tables[child].join(of, column, "left_semi").select(keys[child])
                found[child] = hit if child not in found else found[child].unionByName(hit)
        new = {}
        for child, hit in found.items():
            hit = hit.where(F.col(keys[child]).isNotNull()).distinct()
            new[child] = materialize(hit.join(dead[child], keys[child], "left_anti") if child in dead else hit, "cascade")
    else:
        raise RuntimeError(f"the cascade did not end in {rounds} rounds")
    out = {}
    for t, rows in tables.items():
        if t in dead:
            rows = rows.join(dead[t], keys.get(t, columns.get(t)), "left_anti")
        for column, of in extra[t]:
            rows = rows.join(of, column, "left_anti")
        out[t] = rows.select(tables[t].columns)
    return out


def soft_delete(df: DataFrame, gone: Column, as_of: Column, column: str = "deleted_at") -> DataFrame:
    """Marks rows as deleted at ``as_of``. Reads do not filter on the mark unless asked (``alive``)."""
    return df.withColumn(column, F.when(gone, as_of).otherwise(F.col(column)))


def delete_users(df: DataFrame, gone: Column, as_of: Column, column: str = "deleted_at", active: str = "is_active") -> DataFrame:
    """Marks users as deleted and no longer active."""
    return soft_delete(df, gone, as_of, column).withColumn(active, F.when(gone, False).otherwise(F.col(active)))


def alive(df: DataFrame, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNull())


def new_users(df: DataFrame, superuser: bool = False) -> DataFrame:
    """Sets the flags of a new user: active; staff and superuser only for superusers."""
    return df.withColumns({"is_active": F.lit(True), "is_staff": F.lit(superuser), "is_superuser": F.lit(superuser)})


def touched(df: DataFrame, as_of: Column, *columns: str) -> DataFrame:
    """Sets time columns to ``as_of``."""
    return df.withColumns({c: as_of for c in columns})


def evolve(df: DataFrame, *steps: tuple) -> DataFrame:
    """Schema changes in order: ("add", name, type, default or None), ("alter", name, type[, default]), ("drop", name)
    and ("rename", name, new name). Values that the new type cannot hold become the default, else null."""
    for kind, name, *rest in steps:
        if kind == "add":
            df = df.withColumn(name, F.lit(rest[1]).cast(rest[0]))
        elif kind == "alter":
            df = df.withColumn(name, F.coalesce(F.col(name).try_cast(rest[0]), F.lit(rest[1] if len(rest) > 1 else None).cast(rest[0])))
        elif kind == "drop":
            df = without(df, name)
        elif kind == "rename":
            df = df.withColumnRenamed(name, rest[0])
        else:
            raise ValueError(f"no such change: {kind}")
    return df


def first_rows(df: DataFrame, row_id: str, n: int = 5) -> DataFrame:
    """The first rows by an explicit id; Spark keeps n rows a task and merges them."""
    return df.orderBy(row_id).limit(n)


def sorted_desc(df: DataFrame, by: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), F.asc(tie))


def top_k(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    return sorted_desc(df, by, tie).limit(k)


def best_in_group(df: DataFrame, group: str, by: Column, tie: str) -> DataFrame:
    """The row of the largest value in each group, ties to the smallest ``tie``."""
    order = Window.partitionBy(group).orderBy(by.desc(), F.asc(tie))
    at = free_name(df, "at")
    return df.withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).drop(at)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
