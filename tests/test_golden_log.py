"""Golden values on a small connection log written as text (FIXTURES part 3)."""

import pytest
from pyspark.sql import functions as F

from flowtrace.operators import layouts as ly
from flowtrace.operators import traces as tr
from flowtrace.schema import CONN_FIELDS
from flowtrace.sources import zeek

HEADER = zeek.header_lines("conn", CONN_FIELDS)
U = "-"


def line(ts, uid, oh, op, rh, rp, proto, dur, ob, rb, hist, opk, rpk):
    vals = [ts, uid, oh, op, rh, rp, proto, "dns" if rp == 53 else U, dur, ob, rb, "SF", "T", "F", 0, hist,
            opk, 0, rpk, 0, "(empty)"]
    return "\t".join(str(v) for v in vals)


ROWS = [
    line("11.471177", "Ca1", "192.168.1.110", 50501, "8.8.8.8", 53, "udp", "0.001631", 34, 50, "Dd", 1, 1),
    line("11.473159", "Ca2", "192.168.1.110", 53020, "8.8.8.8", 53, "udp", "0.001124", 34, 62, "Dd", 1, 1),
    line("296.693588", "Cb1", "fd2d:ab8c:225:0:1dd1:f146:ce60:e3aa", 61712, "fd2d:ab8c:225::1", 53, "udp",
         "0.324443", 36, 52, "Dd", 1, 1),
    line("297.513051", "Cb2", "fd2d:ab8c:225:0:1dd1:f146:ce60:e3aa", 59346, "fd2d:ab8c:225::1", 53, "udp",
         "0.243843", 34, 97, "Dd", 1, 1),
    line("299.339285", "Cb3", "fd2d:ab8c:225:0:1dd1:f146:ce60:e3aa", 57100, "fd2d:ab8c:225::1", 53, "udp",
         "0.675517", 34, 66, "Dd", 1, 1),
    line("300.610612", "Cb4", "fd2d:ab8c:225:0:1dd1:f146:ce60:e3aa", 64029, "fd2d:ab8c:225::1", 53, "udp",
         "0.279008", 33, 49, "Dd", 1, 1),
    line("297.462582", "Cc1", "192.168.1.110", 49191, "192.42.116.41", 80, "tcp", "0.049654", 240, 383,
         "ShADadfF", 6, 6),
    line("296.693488", "Cd1", "fd2d:ab8c:225::1", 136, "fd2d:ab8c:225:0:1dd1:f146:ce60:e3aa", 135, "icmp",
         U, U, U, U, 1, 0),
]


@pytest.fixture(scope="module")
def flows(spark, tmp_path_factory):
    from flowtrace.sources.csvio import scratch_path
    path = scratch_path(spark, "golden_log")
    text = "\n".join(HEADER + ROWS + ["#close\t2017-03-15-18-00-14"]) + "\n"
    spark.createDataFrame([(text,)], "value string").write.text(path)
    return zeek.read_conn_log(spark, path, fields="*")


def test_reader_keeps_every_record_and_types(flows):
    assert flows.count() == len(ROWS)
    icmp = flows.where(F.col("proto") == "icmp").first()
    assert icmp["duration"] is None and icmp["orig_bytes"] is None and icmp["history"] is None
    assert icmp["tunnel_parents"] == []
    assert dict(flows.dtypes)["id_orig_p"] == "int" and dict(flows.dtypes)["resp_bytes"] == "bigint"


@pytest.mark.parametrize("method", ["window", "segmented"])
def test_conn_trace_golden(flows, method):
    t = {(r["srcIP"], r["destPt"]): r for r in tr.conn_traces(flows, method=method, num_partitions=3).collect()}
    a = t[("192.168.1.110", 53)]
    assert a["flowct"] == 2 and a["mean_dest_bytes"] == pytest.approx(56)
    assert a["stdev_dest_bytes"] == pytest.approx(3.0)
    assert a["mean_intvl"] == pytest.approx(0.001982) and a["stdev_intvl"] == pytest.approx(0.0)
    assert (a["src_D"], a["dest_d"], a["src_A"], a["dest_f"], a["dest_r"]) == (2, 2, 0, 0, 0)
    b = t[("fd2d:ab8c:225:0:1dd1:f146:ce60:e3aa", 53)]
    assert b["flowct"] == 4 and b["mean_dest_bytes"] == pytest.approx(66)
    assert b["stdev_dest_bytes"] == pytest.approx(11.291667, abs=1e-6)
    assert b["mean_intvl"] == pytest.approx(1.305675, abs=1e-6)
    assert b["stdev_intvl"] == pytest.approx(0.411730, abs=1e-6)
    c = t[("192.168.1.110", 80)]
    assert c["flowct"] == 1 and c["mean_dest_bytes"] == 383 and c["stdev_dest_bytes"] == 0
    assert c["mean_intvl"] == 0 and c["stdev_intvl"] == 0
    assert (c["src_A"], c["dest_f"], c["src_F"], c["dest_r"]) == (1, 1, 1, 0)
    icmp = t[("fd2d:ab8c:225::1", 135)]
    assert icmp["mean_duration"] == 0 and icmp["mean_src_bytes"] == 0  # unset counts as 0


def test_layout_b_golden(flows):
    b = {(r["id_orig_h"], r["id_resp_p"]): r for r in ly.traces_layout_b(flows, ["icmp"], num_partitions=2).collect()}
    assert len(b) == 3 and ly.traces_layout_b(flows, num_partitions=2).count() == 4  # nothing is left out unasked
    two = b[("192.168.1.110", 53)]
    assert two["id_orig_p"] == 50501 and two["ts"] == pytest.approx(11.471177)
    assert two["std_resp_bytes"] == pytest.approx(8.485281, abs=1e-6)
    four = b[("fd2d:ab8c:225:0:1dd1:f146:ce60:e3aa", 53)]
    assert four["std_resp_bytes"] == pytest.approx(21.954498, abs=1e-6)
    assert four["std_intvl"] == pytest.approx(0.411730, abs=1e-6)
    one = b[("192.168.1.110", 80)]
    assert one["std_resp_bytes"] is None and one["mean_intvl"] is None and one["std_intvl"] is None


def test_single_flow_modes(flows):
    nulls = {r["destPt"]: r for r in tr.conn_traces(flows, single_flow="null").collect()}
    assert nulls[80]["stdev_dest_bytes"] is None and nulls[80]["mean_intvl"] is None
    assert tr.conn_traces(flows, single_flow="drop").count() == 2


def test_files_with_different_field_order(spark):
    from flowtrace.sources.csvio import scratch_path
    path = scratch_path(spark, "mixed_logs")
    a_fields = [("ts", "time"), ("uid", "string"), ("resp_bytes", "count")]
    b_fields = [("resp_bytes", "count"), ("ts", "time"), ("uid", "string")]
    a = "\n".join(zeek.header_lines("conn", a_fields) + ["1.5\tCa\t10", "#close\tx"]) + "\n"
    b = "\n".join(zeek.header_lines("conn", b_fields) + ["20\t2.5\tCb", "#close\tx"]) + "\n"
    spark.createDataFrame([(a,)], "value string").write.text(path + "/a")
    spark.createDataFrame([(b,)], "value string").write.text(path + "/b")
    got = {r["uid"]: (r["ts"], r["resp_bytes"]) for r in
           zeek.read_log(spark, [path + "/a", path + "/b"], ["uid", "ts", "resp_bytes"]).collect()}
    assert got == {"Ca": (1.5, 10), "Cb": (2.5, 20)}
    single = scratch_path(spark, "mixed_logs_one_folder")
    spark.createDataFrame([(a,)], "value string").write.text(single)
    spark.createDataFrame([(b,)], "value string").write.mode("append").text(single)
    got = {r["uid"]: (r["ts"], r["resp_bytes"]) for r in
           zeek.read_log(spark, single, ["uid", "ts", "resp_bytes"]).collect()}
    assert got == {"Ca": (1.5, 10), "Cb": (2.5, 20)}


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    """Late files of a folder with the same fields in another order, or with more fields."""
    fields = [("ts", "time"), ("uid", "string"), ("resp_bytes", "count")]
    for i in range(40):
        order = fields if i < 36 else fields[::-1] if i < 38 else [("proto", "enum"), *fields]
        row = {"ts": f"{i}.5", "uid": f"C{i}", "resp_bytes": str(100 + i), "proto": "tcp"}
        lines = zeek.header_lines("conn", order) + ["\t".join(row[n] for n, _ in order), "#close\tx"]
        (tmp_path / f"conn-{i:03d}.log").write_text("\n".join(lines) + "\n")
    got = {r["uid"]: (r["ts"], r["resp_bytes"]) for r in zeek.read_log(spark, str(tmp_path), ["uid", "ts", "resp_bytes"]).collect()}
    assert got == {f"C{i}": (i + 0.5, 100 + i) for i in range(40)}
    (tmp_path / "conn-040.log").write_text("1.5\tCx\t7\n")
    with pytest.raises(ValueError, match="conn-040"):
        zeek.read_log(spark, str(tmp_path), ["uid"])
