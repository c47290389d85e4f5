"""Tab-separated network logs (header lines ``#fields``/``#types``, ``#close`` footer).

Reading is ``spark.read.text`` + ``split``: comment lines are dropped by
prefix (so no data line is lost), fields are picked by the position the
``#fields`` header gives them, the unset marker ``-`` becomes NULL and
``(empty)`` an empty set.  The header of every file is found by a scan; only if
headers differ are the lines joined to the header of their file, and files that
share a header share one projection.

Writing produces the same layout, one file per partition, each with its own
header and footer, so no single task or the driver sees all rows.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowtrace.schema import CONN_FIELDS, EMPTY, LOG_TYPE_TO_SPARK, UNSET, column_name

_SEP = "\t"
#: Files whose headers are broadcast at most (about 500 bytes each); more are joined by shuffle.
BROADCAST_FILES = 50_000


def _typed(raw: Column, log_type: str, as_text: bool) -> Column:
    """One raw text field to its Spark value (unset -> NULL); ``as_text`` keeps the raw text."""
    if as_text:
        return raw
    val = F.when(raw == UNSET, F.lit(None)).otherwise(raw)
    if log_type == "bool":
        return F.when(val == "T", True).when(val == "F", False)
    if log_type.startswith("set[") or log_type.startswith("vector["):
        return F.when(val == EMPTY, F.array().cast("array<string>")).otherwise(F.split(val, ","))
    target = LOG_TYPE_TO_SPARK.get(log_type, T.StringType())
    if isinstance(target, T.StringType):
        return val
    return val.try_cast(target)


def log_headers(raw: DataFrame) -> DataFrame:
    """``file``, its ``#fields`` and ``#types`` lines (``f``, ``t``), whether it has several different ones
    (``mixed``), and whether it has data lines (``data``).  ``raw`` has ``value`` and ``file`` of every line."""
    line = F.col("value")
    fields, types = F.when(line.startswith("#fields"), line), F.when(line.startswith("#types"), line)
    return raw.groupBy("file").agg(
        F.max(fields).alias("f"), F.max(types).alias("t"),
        ((F.max(fields) != F.min(fields)) | F.coalesce(F.max(types) != F.min(types), F.lit(False))).alias("mixed"),
        F.bool_or(~line.startswith("#") & (F.length(line) > 0)).alias("data"))


def parse_lines(lines: DataFrame, names: Sequence[str], types: Sequence[str],
                keep: Sequence[str] | None = None, as_text: bool = False, validate: bool = False) -> DataFrame:
    """Parse data lines (column ``value``) given the header's names and types.

    ``keep``: log field names to return, in that order (default all).
    Output columns use ``_`` for ``.``.
    """
    pos = {n: i for i, n in enumerate(names)}
    typ = dict(zip(names, types))
    keep = list(keep) if keep else list(names)
    missing = [k for k in keep if k not in pos]
    if missing:
        raise ValueError(f"fields not in log header: {missing}")
    data = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    parts = F.split(F.col("value"), _SEP)
    if validate:  # check every line's width in the same pass
        parts = F.when(F.size(parts) == len(names), parts).otherwise(
            F.raise_error(F.lit(f"log line has not {len(names)} fields; pass header= for mixed logs")).cast(
                "array<string>"))
    extra = [c for c in lines.columns if c != "value"]
    return data.select(*[_typed(parts.getItem(pos[k]), typ[k], as_text).alias(column_name(k)) for k in keep],
                       *extra)


def read_log(spark: SparkSession, path: str | Sequence[str], keep: Sequence[str] | None = None,
             as_text: bool = False, with_file: bool = False,
             header: tuple[Sequence[str], Sequence[str]] | None = None) -> DataFrame:
    """Read one or many logs of one kind; files may differ in field order.

    ``header``: (names, types) when known, so no discovery is needed.
    Otherwise a scan finds the header of every file.  When all agree (the usual
    case: one writer version) it is used for all files, else lines are joined to
    the header of their file.  Lines of another width than their header, data
    without a header and files with several headers are errors.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"),
                                       F.col("_metadata.file_name").alias("file_name"))
    if header is not None:
        parts = [(raw, *header)]
    else:
        heads = log_headers(raw.select("value", "file"))
        # one row per layout
        layouts = heads.groupBy("f", "t").agg(F.min("file").alias("file"), F.bool_or("mixed").alias("mixed"),
                                              F.bool_or("data").alias("data")).orderBy("file").collect()
        for r in layouts:
            if r["mixed"]:
                raise ValueError(f"several different headers in one of the files like {r['file']}")
            if r["f"] is None and r["data"]:
                raise ValueError(f"no #fields header in {r['file']}")
        layouts = [r for r in layouts if r["f"] is not None]
        if not layouts:
            raise ValueError(f"no #fields header under {path}")
        parts = []
        for r in layouts:
            names = r["f"].split(_SEP)[1:]
            types = r["t"].split(_SEP)[1:] if r["t"] else ["string"] * len(names)
            own = heads.where(F.col("f").eqNullSafe(F.lit(r["f"])) & F.col("t").eqNullSafe(F.lit(r["t"]))).select("file")
            parts.append((raw if len(layouts) == 1 else raw.join(own, "file", "left_semi"), names, types))
    frames = []
    for part, names, types in parts:
        df = parse_lines(part.select("value", "file_name"), names, types, keep, as_text, validate=header is None)
        frames.append(df if with_file else df.drop("file_name"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _checked(value: Column, log_type: str) -> tuple[Column, Column]:
    """A field's typed value, and why it has none though the text isn't unset (NULL if all is well)."""
    typed = _typed(value, log_type, False)
    given = value.isNotNull() & ~value.isin(UNSET, EMPTY)
    return typed, F.when(given & typed.isNull(), F.lit(f"not a {log_type}"))


def parse_checked(raw: DataFrame, heads: DataFrame | None, layouts: Sequence[tuple[str, str | None]], keep: Sequence[str] | None) -> DataFrame:
    """``file``, ``line``, ``row`` (struct of the typed fields) and ``bad`` (array of field and reason) of every data line.

    One pass, whatever the number of layouts: a line's fields are found by name in
    the header of its own file (no ``heads``: the one layout is that of all files).  A field has the type that the first layout with
    it gives.  ``bad`` is empty for a good line; then ``row`` holds.
    """
    types: dict[str, str] = {}
    for f, t in layouts:
        names = f.split(_SEP)[1:]
        for n, x in zip(names, t.split(_SEP)[1:] if t else ["string"] * len(names)):
            types.setdefault(n, x)
    keep = list(keep) if keep else list(types)
    data = raw.where(~F.col("value").startswith("#") & (F.length("value") > 0))
    if heads is None:
        data = data.withColumn("f", F.lit(layouts[0][0]))
    else:
        data = data.join(heads.select("file", F.when(~F.coalesce("mixed", F.lit(False)), F.col("f")).alias("f")), "file", "left")
    data = data.select("file", F.col("value").alias("line"), F.split("value", _SEP).alias("parts"),
                       F.slice(F.split("f", _SEP), 2, 1 << 20).alias("names"))
    fields, bad = [], [F.when(F.col("names").isNull(), F.struct(F.lit(None).cast("string").alias("field"), F.lit("no header, or several").alias("reason"))),
                       F.when(F.size("parts") != F.size("names"), F.struct(
                           F.lit(None).cast("string").alias("field"),
                           F.concat(F.size("parts").cast("string"), F.lit(" of "), F.size("names").cast("string"), F.lit(" fields")).alias("reason")))]
    whole = F.col("names").isNotNull() & (F.size("parts") == F.size("names"))
    for k in keep:
        # a field that the file's header doesn't have is NULL
        value = F.when(whole, F.get("parts", F.nullif(F.array_position("names", k), F.lit(0)).cast("int") - 1))
        typed, why = _checked(value, types.get(k, "string"))
        fields.append(typed.alias(column_name(k)))
        bad.append(F.when(why.isNotNull(), F.struct(F.lit(k).alias("field"), why.alias("reason"))))
    return data.select("file", "line", F.struct(*fields).alias("row"), F.filter(F.array(*bad), lambda b: b.isNotNull()).alias("bad"))


def read_log_checked(spark: SparkSession, path: str | Sequence[str], out_path: str,
                     keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Typed rows, rejected lines and their counts: one parse, written to ``out_path``, read back as two tables.

    A line is rejected if its number of fields isn't that of its file's header, if
    its file has no header or several, or if a kept field holds text that isn't of
    its type (unset and empty fields are fine).  ``rejects`` has ``file``,
    ``line``, ``field`` (those at fault, comma-joined; NULL for the whole line)
    and ``reason``.  Every data line is in one of the two tables; the counts
    (``lines``, ``typed``, ``rejected``) come from one column of the written parse.
    (No ``Observation``: a session that has made one can't be serialized any more,
    and MLlib's models with a binary training summary hold their session.)
    A folder without any header gives rejects only, with the kept fields as text.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = log_headers(raw).checkpoint(eager=True)  # one row per file
    usable = F.col("f").isNotNull() & ~F.coalesce("mixed", F.lit(False))
    found = heads.where(usable).groupBy("f", "t").agg(F.min("file").alias("file")).orderBy("file").collect()
    layouts = [(r["f"], r["t"]) for r in found]  # one row per layout
    files, others = heads.agg(F.count(F.lit(1)), F.count_if(~usable)).first()
    alike = len(layouts) == 1 and not others
    whole = parse_checked(raw, None if alike else F.broadcast(heads) if files <= BROADCAST_FILES else heads, layouts, keep)
    rejected = F.size("bad") > 0
    whole.write.mode("overwrite").parquet(out_path)
    made = spark.read.schema(whole.schema).parquet(out_path)
    typed = made.where(F.size("bad") == 0).select("row.*")
    fields = F.array_join(F.transform("bad", lambda b: b["field"]), ",")
    rejects = made.where(F.size("bad") > 0).select(
        "file", "line", F.when(fields != "", fields).alias("field"), F.array_join(F.transform("bad", lambda b: b["reason"]), ",").alias("reason"))
    seen = made.agg(F.count(F.lit(1)).alias("lines"), F.count_if(~rejected).alias("typed"), F.count_if(rejected).alias("rejected")).first()
    return typed, rejects, seen.asDict()


def read_conn_log(spark: SparkSession, path, fields: str | Sequence[str] = "kept", **kw) -> DataFrame:
    """Connection log: ``fields='kept'`` (the 14 used fields), ``'*'`` (all) or a list."""
    from flowtrace.schema import CONN_KEPT
    keep = None if fields == "*" else (CONN_KEPT if fields == "kept" else list(fields))
    return read_log(spark, path, keep, **kw)


def read_http_log(spark: SparkSession, path, **kw) -> DataFrame:
    from flowtrace.schema import HTTP_KEPT
    return read_log(spark, path, HTTP_KEPT, **kw)


# ---------------------------------------------------------------------------
# writing
# ---------------------------------------------------------------------------

def _field_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.ArrayType):
        txt = F.when(F.size(c) == 0, F.lit(EMPTY)).otherwise(F.array_join(c, ","))
    elif isinstance(dtype, T.BooleanType):
        txt = F.when(c, F.lit("T")).otherwise(F.lit("F"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        txt = F.when(c.isNotNull(), F.format_string("%.6f", c))
    else:
        txt = c.cast("string")
    return F.coalesce(txt, F.lit(UNSET))


def to_log_lines(df: DataFrame, fields: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """Data lines (column ``value``) of a typed frame, in log field order."""
    fields = fields or CONN_FIELDS
    types = {f.name: f.dataType for f in df.schema.fields}
    cols = [_field_text(F.col(column_name(n)), types[column_name(n)]) for n, _ in fields]
    return df.select(F.concat_ws(_SEP, *cols).alias("value"))


def header_lines(path_name: str, fields: Sequence[tuple[str, str]]) -> list[str]:
    opened = _dt.datetime(2024, 1, 1).strftime("%Y-%m-%d-%H-%M-%S")
    return ["#separator \\x09", f"#set_separator{_SEP},", f"#empty_field{_SEP}{EMPTY}",
            f"#unset_field{_SEP}{UNSET}", f"#path{_SEP}{path_name}", f"#open{_SEP}{opened}",
            "#fields" + _SEP + _SEP.join(n for n, _ in fields),
            "#types" + _SEP + _SEP.join(t for _, t in fields)]


def write_log(df: DataFrame, path: str, fields: Sequence[tuple[str, str]] | None = None,
              path_name: str = "conn", mode: str = "overwrite") -> None:
    """Write a typed frame as log text: each partition is a file with header and footer."""
    fields = list(fields or CONN_FIELDS)
    write_lines(to_log_lines(df, fields), path, fields, path_name, mode)


def write_lines(lines: DataFrame, path: str, fields: Sequence[tuple[str, str]], path_name: str = "conn", mode: str = "overwrite") -> None:
    """Write data lines (column ``value``) as log text: each partition is a file with header and footer."""
    head = header_lines(path_name, fields)
    foot = f"#close{_SEP}" + _dt.datetime(2024, 1, 1).strftime("%Y-%m-%d-%H-%M-%S")

    def frame(batches):
        first = True
        for pdf in batches:
            if first:
                yield pd.DataFrame({"value": head})
                first = False
            yield pdf
        if not first:
            yield pd.DataFrame({"value": [foot]})

    lines.mapInPandas(frame, "value string").write.mode(mode).text(path)
