"""Column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtrace.schema import FLAG_ORDER, flag_column


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def history_flag(history, letter: str) -> Column:
    """1 when the letter occurs in the history text (case sensitive), else 0.

    A letter repeated in one history still counts once; NULL history gives 0.
    """
    return F.coalesce((F.instr(col(history), letter) > 0).cast("int"), F.lit(0))


def history_flags(history="history") -> list[Column]:
    """The 20 presence flags, in trace column order."""
    return [history_flag(history, L).alias(flag_column(L)) for L in FLAG_ORDER]


def unset_to_zero(c, dtype: str | None = None) -> Column:
    """Reference view of an unset value: NULL becomes 0."""
    out = F.coalesce(col(c), F.lit(0))
    return out.cast(dtype) if dtype else out


def text_unset_to_zero(c) -> Column:
    """On raw log text: a lone '-' becomes '0' (other dashes stay)."""
    return F.when(col(c) == "-", F.lit("0")).otherwise(col(c))


def key_text(*cols) -> Column:
    """Conversation key as text, fields joined by a vertical bar."""
    return F.concat_ws("|", *[col(c).cast("string") for c in cols])


def log1p_cols(names: Iterable[str]) -> list[Column]:
    return [F.log1p(F.col(n)).alias(n) for n in names]


def cut(prob, threshold) -> Column:
    """Probability to class: 1 when prob > threshold (strict), else 0."""
    return F.when(col(prob) > col(threshold) if not isinstance(threshold, (int, float)) else col(prob) > F.lit(threshold), 1).otherwise(0)


def hash_order(seed, id_col) -> Column:
    """Repeatable random order key: md5 of '<seed>|<id>' as hex text.

    The same text comes out of DuckDB's md5, so samples and folds made with it
    can be checked by SQL.
    """
    return F.md5(F.concat(F.lit(str(seed)), F.lit("|"), col(id_col).cast("string")))


def hash_fraction(seed, id_col) -> Column:
    """A value in [0, 1) from the first 8 hex digits of :func:`hash_order`."""
    return F.conv(F.substring(hash_order(seed, id_col), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
