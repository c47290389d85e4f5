"""Quality rules: a threshold table compiled into one projection (operator 5).

Everything is built-in functions over the row's own text: no user function, no
shuffle.  Words are runs of anything but ASCII white space; a line is what
stands between line feeds and counts if it holds a word.

Defined results: null or empty text has no words and is rejected by the length
rule; a null id is kept as null; repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtrace.llm.common import ASCII_SPACE

# Common short words of the languages expected.
STOP_WORDS = {
    "en": "the of and to in a is that it for was on are as with his they at be this from have or by had but not what all were",
    "fr": "de la le et les des en un du une que est pour qui dans au par sur ne se pas plus avec ce il sont aux son",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an aus er hat",
    "es": "de la que el en y los se del las un por con no una su para es al lo como más o pero sus le ha",
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text where ``scale * metric`` is over (or under) ``bound * per``."""

    name: str
    metric: str
    per: str  # a metric, or "1"
    scale: int
    under: int | None = None
    over: int | None = None

    def fails(self) -> str:
        parts = [f"{self.scale} * {self.metric} {op} {bound} * {self.per}"
                 for op, bound in (("<", self.under), (">", self.over)) if bound is not None]
        return "(" + " OR ".join(parts) + ")"


#: The contract's base rules.
BASE_RULES = (
    Rule("too_short", "n_words", "1", 1, under=50),
    Rule("repeats_phrases", "n_repeat_words", "n_words", 100, over=50),
)

#: The method's own table: length, symbol, stop-word and line ratios.
RATIO_RULES = (
    Rule("word_length", "word_chars", "n_words", 10, under=20, over=150),
    Rule("symbols", "n_symbols", "n_words", 100, over=10),
    Rule("shouting", "n_bangs", "n_words", 100, over=50),
    Rule("stop_words", "n_stop_words", "n_words", 100, under=4),
    Rule("repeats_lines", "n_dup_lines", "n_lines", 100, over=50),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", 100, over=30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 100, over=90),
)

METRICS = ("n_words", "word_chars", "n_symbols", "n_bangs", "n_stop_words", "n_lines", "n_dup_lines",
           "n_ellipsis_lines", "n_bullet_lines", "n_repeat_words")

STOP_LIST = tuple(sorted({w for words in STOP_WORDS.values() for w in words.split()}))


def _removed(text: Column, characters: str) -> Column:
    """How many code points of ``text`` are among ``characters``."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _covered(starts: Column) -> Column:
    """Words under windows of three that begin at the sorted ``starts``."""
    return F.aggregate(
        starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"])


def text_metrics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with one struct column ``_m`` of the metrics of its text."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(raw, F.lit(ASCII_SPACE))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+"))
    # one column for each step, so that no array is computed for each of its uses
    one = df.withColumn("_t", raw).withColumn("_w", words)
    one = one.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0))
    one = one.withColumn("_k", F.transform("_w", lambda w: F.xxhash64(w)))
    one = one.withColumn("_h", F.when(F.size("_w") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.slice("_k", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda a, i: F.xxhash64(a, F.get("_k", i + 1), F.get("_k", i + 2)))))
    # equal windows are neighbours once sorted, so the cost is that of one sort, whatever repeats
    one = one.withColumn("_s", F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    one = one.withColumn("_d", F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.array().cast("array<int>")).otherwise(
        F.sort_array(F.filter(F.transform("_s", lambda x, i: F.when(
            (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]), x["i"])),
            lambda p: p.isNotNull()))))
    n = lambda c: c.cast("bigint")
    values = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.translate("_t", ASCII_SPACE, "")),
        "n_symbols": _removed(F.col("_t"), "#*$%&|<>"),
        "n_bangs": _removed(F.col("_t"), "!"),
        "n_stop_words": F.size(F.filter("_w", lambda w: F.lower(w).isin(*STOP_LIST))),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
        "n_ellipsis_lines": F.size(F.filter("_l", lambda x: x.endswith("...") | x.endswith("…"))),
        "n_bullet_lines": F.size(F.filter("_l", lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•"))),
        "n_repeat_words": _covered(F.col("_d")),
    }
    made = one.withColumn("_m", F.struct(*(n(values[k]).alias(k) for k in METRICS)))
    return made.drop("_t", "_w", "_l", "_k", "_h", "_s", "_d")


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """One array column with the names of the rules that a text fails."""
    checks = [F.when(F.expr(r.fails()), F.lit(r.name)) for r in rules]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def judge(df: DataFrame, text_col: str = "text", base: tuple[Rule, ...] = BASE_RULES,
          rules: tuple[Rule, ...] = RATIO_RULES, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``df``: id, metrics, ``base_failed``, ``failed`` (rule names) and ``kept``."""
    metrics = text_metrics(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return metrics.select("doc_id", "_m.*").select(
        "*", (F.size(compile_rules(base)) > 0).alias("base_failed"), compile_rules(base + rules).alias("failed")
    ).withColumn("kept", F.size("failed") == 0)


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + RATIO_RULES) -> DataFrame:
    """Rows of ``df`` that no rule rejects, with the columns of ``df``."""
    row = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(text_col).alias("text"))
    # the row number keeps the filter above the projection: pushed below it, every metric
    # would be computed again for each of its uses
    judged = text_metrics(row).select("_row", "_m.*", F.monotonically_increasing_id().alias("_n"))
    return judged.filter((F.size(compile_rules(rules)) == 0) & (F.col("_n") >= 0)).select("_row.*")
