"""Code columns to descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def decode(
    df: DataFrame, dictionary: DataFrame, fields: dict[str, tuple[str, str]], exact_case: bool = False
) -> DataFrame:
    """Left-join one description per code column: {code column: (field name, output column)}.

    Field names match regardless of case unless ``exact_case``. Each join takes one slice of the
    dictionary, normally small enough for Spark to broadcast on its own, so the
    fact is not shuffled; a code with two rows in the dictionary yields two rows.
    """
    name = F.col("field_name") if exact_case else F.upper("field_name")
    out = df
    for i, (code, (field, target)) in enumerate(fields.items()):
        part = dictionary.where(name == F.lit(field if exact_case else field.upper())).select(
            F.col("field_code").alias(f"__code{i}"), F.col("field_description").alias(target)
        )
        out = out.join(part, F.col(code) == F.col(f"__code{i}"), "left").drop(f"__code{i}")
    return out


def repeated_codes(dictionary: DataFrame, exact_case: bool = False) -> DataFrame:
    """Codes with more than one row under a field name, with their number and that of their descriptions.

    To be looked at before decoding: such a code doubles the rows it is joined to.
    """
    name = F.col("field_name") if exact_case else F.upper("field_name")
    return (
        dictionary.groupBy(name.alias("field_name"), "field_code")
        .agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("field_description").alias("descriptions"))
        .where("entries > 1")
    )
