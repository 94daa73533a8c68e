"""One alignment a molecule, before anything else is done with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cigar import reference_span
from .groups import keep_best


def deduplicate(alignments: DataFrame, *, cell_tag: str = "CB", molecule_tag: str = "UB") -> DataFrame:
    """Of each cell and molecule the alignment with the longest reference span, then the smaller name, then the earlier.

    Unmapped, secondary and supplementary alignments go; a kept one without a tag, or without a
    span, is an error.
    """
    span = reference_span(F.col("ops"))
    tag = lambda name: F.coalesce(F.try_element_at("tags", F.lit(name)), F.raise_error(F.concat(F.col("qname"), F.lit(f" has no tag {name}"))))
    rows = alignments.where(F.col("flag").bitwiseAND(0x904) == 0)
    rows = rows.withColumn("span", F.when(span > 0, span).otherwise(F.raise_error(F.concat(F.col("qname"), F.lit(" covers no reference"))))).withColumn("cell", tag(cell_tag)).withColumn("molecule", tag(molecule_tag))
    return keep_best(rows, ["cell", "molecule"], [F.desc("span"), F.asc("qname"), F.asc("path"), F.asc("line")]).drop("span")
