"""One parse, two outputs: typed rows and rejected lines."""

import pytest

from flowtrace.schema import CONN_KEPT
from flowtrace.sources import zeek

HEAD = "#separator \\x09\n#path\tconn\n#fields\tts\tuid\tid.resp_p\tduration\n#types\ttime\tstring\tport\tinterval\n"
TURNED = "#fields\tuid\tduration\tts\tid.resp_p\n#types\tstring\tinterval\ttime\tport\n"
KEEP = ["ts", "uid", "id.resp_p", "duration"]


@pytest.fixture()
def read(spark, scratch, tmp_path):
    def run(files):
        for name, text in files.items():
            (tmp_path / name).write_text(text)
        typed, rejects, counts = zeek.read_log_checked(spark, f"file://{tmp_path}", scratch("parsed"), KEEP)
        assert typed.columns == ["ts", "uid", "id_resp_p", "duration"] and rejects.columns == ["file", "line", "field", "reason"]
        good = sorted((tuple(r) for r in typed.collect()), key=repr)
        bad = sorted((r.file.rsplit("/", 1)[1], r.line, r.field, r.reason) for r in rejects.collect())
        assert counts["typed"] == len(good) and counts["rejected"] == len(bad) and counts["lines"] == len(good) + len(bad)
        return good, bad
    return run


def test_good_and_bad_lines(read):
    good, bad = read({"a.log": HEAD + "1.5\tA\t80\t-\n2.5\tB\tport\tsoon\n3.5\tC\n4.5\tD\t1\t2\t3\n\n5.5\t-\t-\t(empty)\n6.5\tE\t443\t0.25"})
    assert good == [(1.5, "A", 80, None), (5.5, None, None, None), (6.5, "E", 443, 0.25)]
    assert bad == [("a.log", "2.5\tB\tport\tsoon", "id.resp_p,duration", "not a port,not a interval"),
                   ("a.log", "3.5\tC", None, "2 of 4 fields"), ("a.log", "4.5\tD\t1\t2\t3", None, "5 of 4 fields")]


def test_files_of_several_layouts_and_without_a_header(read):
    good, bad = read({"a.log": HEAD + "1.5\tA\t80\t0.5\n", "b.log": TURNED + "B\t0.5\t2.5\t81\nB2\tx\t2.5\t81\n", "c.log": "3.5\tC\t80\t0.5\n",
                      "d.log": "#fields\tts\tuid\n4.5\tD\n", "e.log": HEAD + TURNED + "5.5\tE\t80\t0.5\n"})
    assert good == [(1.5, "A", 80, 0.5), (2.5, "B", 81, 0.5), (4.5, "D", None, None)]
    assert bad == [("b.log", "B2\tx\t2.5\t81", "duration", "not a interval"), ("c.log", "3.5\tC\t80\t0.5", None, "no header, or several"),
                   ("e.log", "5.5\tE\t80\t0.5", None, "no header, or several")]


def test_nothing_but_lines_without_header(read):
    assert read({"a.log": "1.5\tA\n", "b.log": ""}) == ([], [("a.log", "1.5\tA", None, "no header, or several")])


def test_all_kept_fields_of_a_written_log(spark, scratch):
    from flowtrace.sources import fixture as fx
    from tests.conftest import SF001
    path = scratch("conn")
    zeek.write_log(fx.flows(spark, SF001), path)
    typed, rejects, counts = zeek.read_log_checked(spark, path, scratch("parsed_conn"), CONN_KEPT)
    assert rejects.count() == 0 and counts["typed"] == typed.count()
    assert sorted(map(repr, typed.collect())) == sorted(map(repr, zeek.read_conn_log(spark, path).collect()))


def _models_table(spark):
    rows = [(str(i), float(i % 7 > 2), float(i % 7), float(i % 5), i % 3) for i in range(60)]
    return spark.createDataFrame(rows, "row_id string, label double, a double, b double, fold int")


def test_forests_score_in_a_session_that_has_read_a_log(spark, read):
    """The counts must leave the session serializable: a model's binary summary holds it."""
    from pyspark.ml.classification import RandomForestClassifier

    from flowtrace.operators import models as ml
    assert len(read({"a.log": HEAD + "1.5\tA\t80\t0.5\n"})[0]) == 1

    def make(ntree):
        return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=ntree, maxDepth=3, seed=1)

    table = _models_table(spark)
    assert ml.cv_predictions(table, ["a", "b"], [{"ntree": 2}, {"ntree": 3}], make).count() == 2 * 60
    scored, _ = ml.random_forest(table, table, ["a", "b"], num_trees=2, max_depth=3)
    assert len(scored.collect()) == 60


def test_logistic_scores_in_a_session_that_has_read_a_log(spark, read):
    from flowtrace.operators import models as ml
    assert len(read({"a.log": HEAD + "1.5\tA\t80\t0.5\n"})[0]) == 1
    table = _models_table(spark)
    scored, _ = ml.logistic(table, table, ["a", "b"])
    assert len(scored.collect()) == 60
