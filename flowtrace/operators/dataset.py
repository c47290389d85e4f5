"""Labelled samples: capture labels, feature views, recodes, filters, unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtrace.schema import FAMILY_LEVELS, NORMAL_FAMILY, SKEWED_FEATURES, feature_name


def capture_from_source(src_col: str = "srcIP") -> F.Column:
    """Capture index of a trace in the stand-in data: last address octet % 16."""
    return (F.element_at(F.split(F.col(src_col), r"\."), 4).cast("int") % 16).alias("capture")


def label_traces(traces: DataFrame, captures: DataFrame, capture_col: F.Column | None = None) -> DataFrame:
    """Attach File, Family, Type and Malicious (1 unless Family is Normal).

    Captures without a label keep NULL in all four columns (left join); models
    leave them out.  AQE broadcasts the capture table if its bytes are few.
    """
    t = traces.withColumn("capture", capture_col if capture_col is not None else capture_from_source())
    out = t.join(captures, "capture", "left").drop("capture")
    return out.withColumn("Malicious", (F.col("Family") != NORMAL_FAMILY).cast("int"))


def drop_files(df: DataFrame, files: Sequence[str], col: str = "File") -> DataFrame:
    """Remove rows of the listed files (e.g. a corrupted capture); rows without a file stay."""
    return df.where(F.col(col).isNull() | ~F.col(col).isin(list(files)))


def with_family_order(df: DataFrame, col: str = "Family", levels: Sequence[str] = FAMILY_LEVELS) -> DataFrame:
    """Ordered category: add ``<col>_level`` (1-based position in ``levels``)."""
    order = F.array(*[F.lit(x) for x in levels])
    return df.withColumn(col + "_level", F.array_position(order, F.col(col)).cast("int"))


def log1p_features(df: DataFrame, names: Sequence[str] = SKEWED_FEATURES) -> DataFrame:
    """log(x + 1) of the skewed features, in one projection."""
    cols = [feature_name(n) for n in names]
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in cols})


def recode_label(df: DataFrame, col: str = "Malicious") -> DataFrame:
    """0/1 label as No/Yes and Benign/Malicious text; NULL stays NULL."""
    return df.withColumns({
        col + "_yn": F.when(F.col(col) == 1, "Yes").when(F.col(col) == 0, "No"),
        col + "_class": F.when(F.col(col) == 1, "Malicious").when(F.col(col) == 0, "Benign"),
    })


def encode_category(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Category to integer code 1..k in sorted order of the distinct values.

    The distinct values are ranked with a range-sliced running count (no
    single-task global window, so high-cardinality columns such as addresses
    also work) and joined back; AQE broadcasts the code table if it is small.
    """
    from flowtrace.operators.ordered import global_prefix
    out = out or col + "_code"
    levels = df.select(col).distinct().where(F.col(col).isNotNull())
    coded = global_prefix(levels, [col]).select(col, F.col("rank").cast("int").alias(out))
    return df.join(coded, col, "left")


def prefix_flags(df: DataFrame, letters: Sequence[str]) -> DataFrame:
    """Rename single-letter flag columns by name: upper -> src_X, lower -> dest_x."""
    return df.withColumnsRenamed({c: feature_name(c) for c in letters if c in df.columns})


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the given (default: all) columns."""
    cols = list(cols or df.columns)
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
        if c in numeric:
            cond = cond & ~F.isnan(F.col(c))
    return df.where(cond)
