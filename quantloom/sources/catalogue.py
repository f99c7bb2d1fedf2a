"""A catalogue of database objects: its tables' shapes, the views over them, and the upsert of databases.

Tables are DataFrames keyed by name; a view joins a table up to its schema and database and shows
only what is active at every level.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.storage import materialise

STAMPS = "InsertTime timestamp, UpdateTime timestamp, InsertBy string, UpdateBy string"
NOTES = "PurposeOrMeaning_Description string, TechnicalNotes string"
ACTIVE = "RecordIsActive boolean, RecordDeactivationTimestamp timestamp"
ESTIMATES = "Est_CreationTimestamp timestamp, Est_LastModifiedTimestamp timestamp"
TYPE = "OrdinalNumber int, DataType_Name string, DataType_MaxLength int, DataType_Precision int, DataType_Scale int"
COLUMN = f"{TYPE}, IsNullable boolean, IsIdentity boolean, HasDefaultValue boolean"
PARAMETER = f"{TYPE}, HasDefaultValue boolean, IsOutput boolean, IsReadOnly boolean"
RETURN = ", ".join(f"ReturnValue_DataType_{name}" for name in ("Name string", "MaxLength int", "Precision int", "Scale int"))
SIZES = "LatestSizeUpdateTimestamp timestamp, LatestRowCount long, LatestTotalSpaceKB double"
TARGET = "Target_ServerName string, Target_DatabaseName string, Target_SchemaName string, Target_ObjectName string"
LATEST = "LatestObjectListChangeRecorded timestamp, LatestUpdateToObjectRecordDocumentation timestamp"
DATABASE = f"KeepingRecordsSynchronized boolean, LatestCheckForSynchronizationUpdate timestamp, {LATEST}, LatestSizeUpdateTimestamp timestamp, LatestTotalFileSize double"

#: By table: its parent, the column of its own name, and what else it holds and its view shows.
OBJECTS = {
    "DatabaseSchema": ("ScopedDatabase", "SchemaName", LATEST),
    "DatabaseRole": ("ScopedDatabase", "RoleName", ESTIMATES),
    "TupleStructure": ("DatabaseSchema", "ObjectName", f"TupleStructureTypeID int, {ESTIMATES}, {SIZES}"),
    "TupleStructureColumn": ("TupleStructure", "ColumnName", COLUMN),
    "ScalarValuedFunction": ("DatabaseSchema", "ObjectName", f"{RETURN}, {ESTIMATES}"),
    "ScalarValuedFunctionParameter": ("ScalarValuedFunction", "ParameterName", PARAMETER),
    "TableValuedFunction": ("DatabaseSchema", "ObjectName", f"{ESTIMATES}, IsInline boolean"),
    "TableValuedFunctionParameter": ("TableValuedFunction", "ParameterName", PARAMETER),
    "TableValuedFunctionColumn": ("TableValuedFunction", "ColumnName", COLUMN),
    "StoredProcedure": ("DatabaseSchema", "ObjectName", ESTIMATES),
    "StoredProcedureParameter": ("StoredProcedure", "ParameterName", PARAMETER),
    "SynonymAlias": ("DatabaseSchema", "ObjectName", f"{TARGET}, {ESTIMATES}"),
}
SCHEMAS = {
    "ScopedDatabase": f"ID int, DatabaseName string, {DATABASE}, {NOTES}, {STAMPS}",
    "TupleStructureType": f"ID int, CodeName string, DisplayName string, TechnicalNotes string, {STAMPS}",
} | {
    name: f"ID long, {parent}ID {'int' if parent == 'ScopedDatabase' else 'long'}, {own} string, {ACTIVE}, {rest}, {NOTES}, {STAMPS}"
    for name, (parent, own, rest) in OBJECTS.items()
}
# Kinds of tuple structures.
TUPLE_STRUCTURE_TYPES = (("T", "Table"), ("V", "View"), ("UTT", "User-Defined Table Type"))


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def tuple_structure_types(spark: SparkSession) -> DataFrame:
    rows = [(k, code, shown) for k, (code, shown) in enumerate(TUPLE_STRUCTURE_TYPES, 1)]
    df = spark.createDataFrame(rows, "ID int, CodeName string, DisplayName string").withColumn("TechnicalNotes", F.lit(None).cast("string"))
    return df.withColumns({"InsertTime": F.current_timestamp(), "UpdateTime": F.current_timestamp(), "InsertBy": F.current_user(), "UpdateBy": F.current_user()})


def names_of(fields: str) -> list[str]:
    return [f.split()[0] for f in fields.split(", ")]


def key(parent: str) -> str:
    return f"__{parent}ID"


def active_parents(tables: Mapping[str, DataFrame], name: str) -> tuple[DataFrame, list[str]]:
    """The rows of a table that others hang on, with the names they give to views: (key, names)."""
    if name == "ScopedDatabase":
        return tables[name].select(F.col("ID").alias(key(name)), "DatabaseName"), ["DatabaseName"]
    parent, own, _ = OBJECTS[name]
    above, shown = active_parents(tables, parent)
    rows = tables[name].filter("RecordIsActive")
    joined = rows.select(F.col("ID").alias(key(name)), F.col(f"{parent}ID").alias(key(parent)), own, *(["TupleStructureTypeID"] if name == "TupleStructure" else []))
    joined = joined.join(above, key(parent)).drop(key(parent))
    if name == "TupleStructure":
        types = tables["TupleStructureType"].select(F.col("ID").alias("TupleStructureTypeID"), F.col("CodeName").alias("TupleStructureType_CodeName"), F.col("DisplayName").alias("TupleStructureType_DisplayName"))
        joined = joined.join(types, "TupleStructureTypeID")
        return joined, [*shown, own, "TupleStructureType_CodeName", "TupleStructureType_DisplayName"]
    return joined, [*shown, own]


def view(tables: Mapping[str, DataFrame], name: str) -> DataFrame:
    """What the catalogue shows of a table: its active rows whose schema, and object, are active too."""
    if name == "ScopedDatabase":
        return tables[name].select("DatabaseName", *names_of(DATABASE), *names_of(NOTES))
    if name == "TupleStructureType":
        return tables[name].select("ID", "CodeName", "DisplayName", "TechnicalNotes")
    parent, own, rest = OBJECTS[name]
    above, shown = active_parents(tables, parent)
    rows = tables[name].filter("RecordIsActive")
    joined = rows.join(above.select(key(parent), *shown), rows[f"{parent}ID"] == F.col(key(parent)))
    of_type: list[str] = []
    if name == "TupleStructure":
        types = tables["TupleStructureType"].select(F.col("ID").alias("__type"), F.col("CodeName").alias("TupleStructureType_CodeName"), F.col("DisplayName").alias("TupleStructureType_DisplayName"))
        joined, of_type = joined.join(types, F.col("TupleStructureTypeID") == F.col("__type")), ["TupleStructureType_CodeName", "TupleStructureType_DisplayName"]
    first = ["ID"] if parent == "ScopedDatabase" else ["ID", f"{parent}ID"]
    return joined.select(*first, *shown, own, *of_type, *names_of(rest), *names_of(NOTES))


def upsert_databases(stored: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """The ScopedDatabase table with new databases (DatabaseName, KeepingRecordsSynchronized, both notes) added.

    A name that is there already, in any case, is an error, or with ``overwrite`` takes the new flag
    and notes and keeps the rest.  New rows are numbered on from the largest id.
    """
    changed = ["KeepingRecordsSynchronized", *names_of(NOTES)]
    given = new.select(F.lower("DatabaseName").alias("__name"), F.col("DatabaseName").alias("__given"), *(F.col(c).alias(f"__{c}") for c in changed))
    both = stored.join(given, F.lower(stored["DatabaseName"]) == F.col("__name"), "full")
    if not overwrite and not both.filter("ID is not null and __name is not null").isEmpty():
        raise ValueError("a database of that name is there already")
    known, there, comes = F.col("ID").isNotNull(), F.col("__name").isNull(), F.col("__name").isNotNull()
    top = F.coalesce(stored.agg(F.max("ID").alias("m")).scalar(), F.lit(0))
    values = {c: F.coalesce(F.col("DatabaseName"), F.col("__given")) if c == "DatabaseName" else F.col(c) for c in stored.columns}
    values |= {c: F.when(there, F.col(c)).otherwise(F.col(f"__{c}")) for c in changed}
    values |= {c: F.when(known, F.col(c)).otherwise(F.current_timestamp() if c.endswith("Time") else F.current_user()) for c in ("InsertTime", "InsertBy") if c in stored.columns}
    values |= {c: F.when(comes, F.current_timestamp() if c.endswith("Time") else F.current_user()).otherwise(F.col(c)) for c in ("UpdateTime", "UpdateBy") if c in stored.columns}
    kept = both.filter(known).select(*(values[c].alias(c) for c in stored.columns))
    added = both.filter(~known).select(*(values[c].alias(c) for c in stored.columns if c != "ID"))
    # numbered in each range of names, from where the ranges before it end; the ranges are drawn once
    added = added.repartitionByRange("DatabaseName").withColumn("__part", F.spark_partition_id())
    added = materialise(added)
    sizes = added.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = sizes.select(F.col("__part").alias("__earlier"), F.col("__n").alias("__m"))
    offsets = sizes.join(earlier, F.col("__earlier") < F.col("__part"), "left").groupBy("__part").agg(F.coalesce(F.sum("__m"), F.lit(0)).alias("__offset"))
    number = F.row_number().over(Window.partitionBy("__part").orderBy("DatabaseName"))
    added = added.withColumn("__row", number).join(offsets, "__part")
    added = added.withColumn("ID", (top + F.col("__offset") + F.col("__row")).cast(stored.schema["ID"].dataType))
    return kept.unionByName(added.select(*stored.columns))
