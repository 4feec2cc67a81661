"""What the operators share: tables, results written to the shared folder, and columns added by Arrow functions."""

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lineweave.session import shared_dir, written as saved
from lineweave.sources.tables import load as table

__all__ = ["added", "saved", "shared_dir", "table", "unused"]


def unused(docs: DataFrame, *names: str) -> list[str]:
    """These names, each made longer until no column of docs has it: for columns that an operator needs on the way."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def added(docs: DataFrame, name: str, kind: str) -> tuple[DataFrame, StructType]:
    """docs without a column of that name, and the schema with it at the end: an operator's column replaces one of docs."""
    docs = docs.drop(name)
    return docs, StructType([*docs.schema.fields, StructField(name, _parse_datatype_string(kind))])
