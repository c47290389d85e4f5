"""Fixed values and schemas.

The values below must equal the reference's for results to agree; they are
stated plainly and kept together.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Connection-history letters counted per flow (each lower-case letter and its
# upper-case twin): s h a d f r c t i q
HISTORY_LETTERS = ["s", "h", "a", "d", "f", "r", "c", "t", "i", "q"]
# Trace output order of the 20 flag columns: upper case sorted, then lower
# case sorted (A C D F H I Q R S T a c d f h i q r s t).
FLAG_ORDER = sorted(HISTORY_LETTERS + [c.upper() for c in HISTORY_LETTERS])
# Family of each capture index 0..7 in the stand-in data; 8..15 are Normal.
MALWARE_FAMILIES = ["Bunitu", "Conficker", "Dridex", "Miuref", "Necurs", "Trickbot", "Upatre", "Zeus"]
NORMAL_FAMILY = "Normal"
# Level order of the Family factor (malware families, then Normal).
FAMILY_LEVELS = MALWARE_FAMILIES + [NORMAL_FAMILY]
# Spelling variants of family names normalised on read.
FAMILY_ALIASES = {"Conflicker": "Conficker"}
# The five per-flow values summarised per trace, as named in trace columns.
TRACE_VALUES = ["dest_bytes", "dest_pkts", "duration", "src_bytes", "src_pkts"]
# Fields of a connection log and their log types, in log order.
CONN_FIELDS = [
    ("ts", "time"), ("uid", "string"), ("id.orig_h", "addr"), ("id.orig_p", "port"),
    ("id.resp_h", "addr"), ("id.resp_p", "port"), ("proto", "enum"), ("service", "string"),
    ("duration", "interval"), ("orig_bytes", "count"), ("resp_bytes", "count"),
    ("conn_state", "string"), ("local_orig", "bool"), ("local_resp", "bool"),
    ("missed_bytes", "count"), ("history", "string"), ("orig_pkts", "count"),
    ("orig_ip_bytes", "count"), ("resp_pkts", "count"), ("resp_ip_bytes", "count"),
    ("tunnel_parents", "set[string]"),
]
# Fields kept by the connection-trace reader.
CONN_KEPT = ["uid", "ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "orig_bytes",
             "orig_pkts", "proto", "resp_bytes", "resp_pkts", "history", "duration", "service"]
# Fields kept by the HTTP log reader, in output order.
HTTP_KEPT = ["ts", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "host", "request_body_len",
             "proxied", "method", "orig_filenames", "resp_filenames", "response_body_len",
             "status_code", "status_msg", "tags", "user_agent", "uri", "version"]
HTTP_TYPES = {"ts": "time", "id.orig_h": "addr", "id.orig_p": "port", "id.resp_h": "addr",
              "id.resp_p": "port", "request_body_len": "count", "response_body_len": "count",
              "status_code": "count"}
HTTP_FIELDS = [(f, HTTP_TYPES.get(f, "string")) for f in HTTP_KEPT]
# Log header markers.
UNSET = "-"
EMPTY = "(empty)"
# The 26 model features that are log-transformed (skewed columns).
SKEWED_FEATURES = ["flowct", "mean_dest_bytes", "stdev_dest_bytes", "mean_dest_pkts",
                   "stdev_dest_pkts", "mean_duration", "stdev_duration", "mean_intvl",
                   "stdev_intvl", "mean_src_pkts", "stdev_src_pkts",
                   "A", "C", "D", "F", "H", "R", "S", "T", "a", "c", "d", "f", "h", "r", "t"]
# Flags never set in the data and dropped before naive Bayes.
NB_DROPPED_FLAGS = ["C", "I", "Q", "T", "c", "i", "q", "s", "t"]
# --- end of fixed values ----------------------------------------------------

CONN_KEY = ["id_orig_h", "id_resp_h", "id_resp_p", "proto"]
TRACE_KEY = ["srcIP", "destIP", "destPt", "protocol"]
HTTP_KEY = ["id_orig_h", "id_resp_h", "id_resp_p"]


def flag_column(letter: str) -> str:
    """Column name of a history flag.

    Spark and SQL engines resolve names without case, so ``A`` and ``a``
    cannot both be columns; upper case (originator) letters get ``src_``
    and lower case (responder) letters ``dest_``.
    """
    return ("src_" if letter.isupper() else "dest_") + letter


FLAG_COLUMNS = [flag_column(c) for c in FLAG_ORDER]


def feature_name(name: str) -> str:
    """Map a reference feature name (single flag letters included) to ours."""
    return flag_column(name) if len(name) == 1 else name


LOG_TYPE_TO_SPARK = {
    "time": T.DoubleType(), "interval": T.DoubleType(), "count": T.LongType(),
    "port": T.IntegerType(), "addr": T.StringType(), "string": T.StringType(),
    "enum": T.StringType(), "bool": T.BooleanType(), "set[string]": T.ArrayType(T.StringType()),
    "vector[string]": T.ArrayType(T.StringType()), "double": T.DoubleType(), "int": T.LongType(),
}


def column_name(field: str) -> str:
    """Log field name to a Spark column name (``id.orig_h`` -> ``id_orig_h``)."""
    return field.replace(".", "_")


def conn_flow_schema() -> T.StructType:
    return T.StructType([T.StructField(column_name(f), LOG_TYPE_TO_SPARK[t], True) for f, t in CONN_FIELDS])


TRACE_COLUMNS_A = (TRACE_KEY + ["startTime", "flowct"]
                   + [p + v for v in ["dest_bytes", "dest_pkts", "duration", "intvl", "src_bytes", "src_pkts"]
                      for p in ("mean_", "stdev_")]
                   + FLAG_COLUMNS)
