"""Tables whose schema has a history: a registry of versions, and a reader that lifts files of any version to the newest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import relational

#: A step is ("create", {column: type}), ("drop table",), or one of ``relational.evolve``.
Step = tuple


@dataclass(frozen=True)
class History:
    """What each version did to each table, from version 1 on: ``versions[v - 1][table]`` is a list of steps."""

    versions: Sequence[Mapping[str, Sequence[Step]]]

    @property
    def newest(self) -> int:
        return len(self.versions)

    def steps(self, table: str, after: int, upto: int | None = None) -> list[Step]:
        """The steps of a table behind one version, up to another."""
        return [s for v in self.versions[after : upto or self.newest] for s in v.get(table, ())]

    def schema(self, table: str, version: int | None = None) -> T.StructType | None:
        """The columns of a table in a version; None where there is no such table."""
        fields: dict[str, T.DataType] | None = None
        for kind, *rest in self.steps(table, 0, version):
            if kind == "create":
                fields = {n: _type(k) for n, k in rest[0].items()}
            elif kind == "drop table":
                fields = None
            elif fields is None:
                raise ValueError(f"{table} is changed where there is no such table")
            elif kind in ("add", "alter"):
                if (kind == "add") == (rest[0] in fields):
                    raise ValueError(f"cannot {kind} {rest[0]} of {table}")
                fields[rest[0]] = _type(rest[1])
            elif kind == "drop":
                del fields[rest[0]]
            elif kind == "rename":
                fields = {rest[1] if n == rest[0] else n: k for n, k in fields.items()}
            else:
                raise ValueError(f"no such step: {kind}")
        return fields and T.StructType([T.StructField(n, k) for n, k in fields.items()])

    def tables(self, version: int | None = None) -> list[str]:
        names = {t for v in self.versions for t in v}
        return sorted(t for t in names if self.schema(t, version) is not None)

    def lift(self, rows: DataFrame, table: str, version: int) -> DataFrame:
        """Rows of a version in the form of the newest. Projections only, so nothing is shuffled and columns that go are not read."""
        if self.schema(table) is None:
            raise ValueError(f"{table} is gone in version {self.newest}")
        return relational.evolve(rows, *self.steps(table, version)).select(self.schema(table).names)

    def read(self, spark: SparkSession, folder: str, table: str, versions: Sequence[int] | None = None) -> DataFrame:
        """The files of a table as one table of the newest version, from ``folder/version=v/table``, each read with its own schema.

        Versions in which the table does not exist, or that have no folder, add nothing. A file that lacks a column of its version has null there.
        """
        found = spark.createDataFrame([], self.schema(table))
        for v in versions or range(1, self.newest + 1):
            if (own := self.schema(table, v)) is not None and _exists(spark, path := version_path(folder, table, v)):
                found = found.unionByName(self.lift(spark.read.schema(own).parquet(path), table, v))
        return found

    def write(self, rows: DataFrame, folder: str, table: str, version: int) -> None:
        """Appends rows in the form of a version; their columns must be those of its schema."""
        own = self.schema(table, version)
        if own is None or set(rows.columns) != set(own.names):
            raise ValueError(f"{table} of version {version} has the columns {own.names if own else None}, not {rows.columns}")
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in own.fields]).write.mode("append").parquet(version_path(folder, table, version))


def version_path(folder: str, table: str, version: int) -> str:
    return f"{folder}/version={version}/{table}"


def _type(kind: str) -> T.DataType:
    return T.StructType.fromDDL(f"c {kind}")[0].dataType


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


_STAMPS = {"created_at": "timestamp", "updated_at": "timestamp", "deleted_at": "timestamp"}
_NAMES = lambda *names: dict.fromkeys(names, "string")

#: The eight versions of the users' tables. A role is a text first, then the key of a role, a text again, and a
#: number at last; what cannot be read as the new type becomes its default.
USERS = History(
    (
        {
            "user": [("create", {"id": "bigint", "password": "string", "email": "string", "role": "string", "last_login": "timestamp"})],
            "organization": [("create", {"id": "bigint", **_NAMES("centre", "address", "city", "billing_address", "billing_code"), **_STAMPS})],
            "role": [("create", {"id": "bigint", **_NAMES("name", "description")})],
            "userprofile": [
                (
                    "create",
                    {"id": "bigint", "user_id": "bigint", **_NAMES("first_name", "last_name", "email", "phone", "address", "city", "state", "country", "zip", "language", "image"), **_STAMPS},
                )
            ],
        },
        {},
        {"user": [("rename", "role", "role_id"), ("alter", "role_id", "bigint", 1)]},
        {"user": [("add", "is_active", "boolean", True), ("add", "is_staff", "boolean", False), ("add", "is_superuser", "boolean", False)]},
        {"user": [("rename", "role_id", "role"), ("alter", "role", "string", "admin")]},
        {"user": [("alter", "role", "bigint", 1)]},
        {"role": [("drop table",)]},
        {"organization": [("add", "user_id", "bigint", None)], "userprofile": [("add", "organization_id", "bigint", None)]},
    )
)
