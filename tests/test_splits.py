from pyspark.sql import functions as F

from flowtrace.operators import splits as sp
from flowtrace.schema import MALWARE_FAMILIES


def labelled(spark, n=400):
    fams = MALWARE_FAMILIES + ["Normal"] * 8
    return spark.range(n).select(F.col("id").cast("string").alias("row_id"),
                                 F.element_at(F.array(*[F.lit(f) for f in fams]),
                                              (F.col("id") % 16 + 1).cast("int")).alias("Family"))


def test_leave_family_out_disjoint_and_balanced(spark):
    lf = sp.leave_family_out(labelled(spark), "row_id", MALWARE_FAMILIES, num_partitions=5)
    for fam in MALWARE_FAMILIES:
        f = lf.where(F.col("fold_family") == fam)
        test = f.where(F.col("part") == "test")
        n_fam = test.where(F.col("Family") == fam).count()
        n_norm = test.where(F.col("Family") == "Normal").count()
        assert n_fam == n_norm == 25
        assert test.where(~F.col("Family").isin(fam, "Normal")).count() == 0
        assert f.where(F.col("part") == "train").join(test, "row_id").count() == 0
        assert f.count() == 400


def test_split_fixed_exact_size_and_repeatable(spark):
    df = labelled(spark)
    a = sp.split_fixed(df, "row_id", 123, num_partitions=4)
    assert a.where(F.col("part") == "train").count() == 123
    b = sp.split_fixed(df, "row_id", 123, num_partitions=7)
    assert sorted(r[0] for r in a.where("part = 'train'").select("row_id").collect()) == \
        sorted(r[0] for r in b.where("part = 'train'").select("row_id").collect())


def test_over_and_under_sampling(spark):
    df = labelled(spark).withColumn("y", (F.col("Family") == "Zeus").cast("int"))
    over = sp.oversample(df, "y", 10)
    assert over.where("y = 1").count() == 25 * 10 and over.where("y = 0").count() == 375
    under = sp.undersample(df, "y", "row_id", 0.2)
    assert under.where("y = 1").count() == 25 and 30 < under.where("y = 0").count() < 120
