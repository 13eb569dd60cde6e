"""Catalogue of an engine: tables, views, indexes, triggers.

The whole catalogue is one immutable JSON document a version, so a reader holds
a consistent snapshot and a transaction is a private copy.
"""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DoubleType, FloatType, LongType, StringType, StructField, StructType, TimestampType

ROWID = "_rowid"
#: Type keywords and their Spark types.
TYPES: dict[str, DataType] = {
    "INTEGER": LongType(), "INT": LongType(), "BIGINT": LongType(), "SMALLINT": LongType(), "REAL": DoubleType(), "DOUBLE": DoubleType(),
    "FLOAT": DoubleType(), "NUMERIC": DoubleType(), "TEXT": StringType(), "VARCHAR": StringType(), "CHAR": StringType(), "STRING": StringType(), "BLOB": BinaryType(),
    "JSON": StringType(), "BOOLEAN": BooleanType(), "BOOL": BooleanType(), "DATE": DateType(), "TIMESTAMP": TimestampType(), "DATETIME": TimestampType(), "VECTOR": ArrayType(FloatType()),
}


def type_ddl(t: DataType) -> str:
    """A Spark type as DDL; integers are widened to 64 bits."""
    if t.simpleString() in ("tinyint", "smallint", "int"):
        return "bigint"
    return t.simpleString()


@dataclass
class Column:
    name: str
    phys: str  # name in the files: renaming a column rewrites nothing
    type: str  # Spark DDL
    declared: str = ""
    not_null: bool = False
    default: str | None = None  # SQL
    generated: str | None = None  # SQL over other columns
    dims: int | None = None  # of a vector
    since_default: str | None = None  # value in files written before the column


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    parents: list[str]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    deferred: bool = False


@dataclass
class DataFile:
    path: str
    columns: list[str]  # physical names it holds


@dataclass
class Table:
    name: str
    columns: list[Column]
    primary_key: list[str] = field(default_factory=list)
    uniques: list[list[str]] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    files: list[DataFile] = field(default_factory=list)
    next_rowid: int = 1
    next_phys: int = 0
    version: int = 0
    kind: str = "table"  # table, fts, rtree

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise KeyError(f"table {self.name} has no column {name}")

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def new_phys(self) -> str:
        self.next_phys += 1
        return f"c{self.next_phys}"

    def schema(self) -> StructType:
        return StructType([StructField(c.name, StructType.fromDDL(f"x {c.type}")[0].dataType, not c.not_null) for c in self.columns])


@dataclass
class View:
    name: str
    sql: str
    columns: list[str] = field(default_factory=list)
    check_option: bool = False


@dataclass
class Index:
    name: str
    table: str
    columns: list[str]
    unique: bool = False
    method: str = "btree"


@dataclass
class Trigger:
    name: str
    timing: str  # BEFORE, AFTER, INSTEAD OF
    event: str  # INSERT, UPDATE, DELETE
    table: str
    columns: list[str] = field(default_factory=list)  # UPDATE OF
    when: str | None = None
    body: list[str] = field(default_factory=list)
    enabled: bool = True


@dataclass
class Catalog:
    version: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)

    def copy(self) -> Catalog:
        return copy.deepcopy(self)

    def table(self, name: str) -> Table:
        t = self.tables.get(name.lower())
        if t is None:
            raise KeyError(f"no such table: {name}")
        return t

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        d = json.loads(text)
        tables = {
            k: Table(**{**t, "columns": [Column(**c) for c in t["columns"]], "foreign_keys": [ForeignKey(**f) for f in t["foreign_keys"]], "files": [DataFile(**f) for f in t["files"]]})
            for k, t in d["tables"].items()
        }
        return cls(
            d["version"], tables, {k: View(**v) for k, v in d["views"].items()},
            {k: Index(**v) for k, v in d["indexes"].items()}, {k: Trigger(**v) for k, v in d["triggers"].items()},
        )

