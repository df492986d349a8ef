"""Keys, schema, profile, readers, statistics and numerics on small tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from accordant.errors import ConfigurationError, InputError
from accordant.evaluation import SCENARIOS, evaluate
from accordant.operators import aggregate as A
from accordant.operators import keys as K
from accordant.operators import numerics as N
from accordant.operators import profile as P
from accordant.operators import ranks
from accordant.operators import schema as S
from accordant.operators import statistics as T
from accordant.sources import readers as I
from accordant.sources.fingerprint import fingerprint_file, fingerprint_frame


def frame(spark, **columns):
    return I.load_table(spark, pd.DataFrame(columns))


def test_multiplicity(spark):
    a, b = frame(spark, id=[5] * 4 + [6, 7, 7, 8]), frame(spark, id=[5, 5, 6, 7, 7, 7, 9])
    o = K.overlap(K.joined_counts(a, b, ["id"])).first()
    assert (o["naive_join_rows"], o["join_inflation"], o["common_keys"], K.relationship(o["left_max"], o["right_max"])) == (15, 12, 3, "N:M")
    alone = K.profile(a, ["id"])
    assert alone["distribution"] == {"1": 2, "2": 1, "4-5": 1}
    both = K.joint_profile(K.joined_counts(a, b, ["id"]), (a, b), ["id"], (8, 7))
    assert both["left"] == alone and both["right"] == K.profile(b, ["id"]) and both["naive_join_rows"] == 15 and both["relationship"] == "N:M"


def test_formats(spark):
    x = K.format_issues(frame(spark, id=["oak", "Oak", "OAK", "elm\t", "  ", "", None, "0050", "09"]), "id")
    assert (x["blank"], x["whitespace"], x["case_variants"], x["leading_zeros"]) == (2, 2, 3, 2)
    x = K.format_issues(frame(spark, id=[f"{i}/{i * 7}:z" for i in range(60)] + ["60-420-z", "none", "61/z"]), "id")
    assert x["dominant_pattern"] == "9/9:A" and x["malformed"] == 3 and set(x["malformed_examples"]) == {"60-420-z", "none", "61/z"}
    d = {r["normalization"]: r["resolved"] for r in K.diagnose_normalizations(frame(spark, id=["0008", "00x", "Fir-3", "same"]), frame(spark, id=["8", "x", "FIR 3", "same"]), ["id"]).collect()}
    assert d == {"strip_leading_zeros": 1, "alphanumeric_only": 1}


def test_aggregation(spark):
    df = I.load_table(spark, pd.DataFrame({"d": ["x", "x", "y"], "v": [1.0, None, 3.0]}))
    got = {r["d"]: r for r in A.aggregate_to_keys(df, ["d"], {"v": "count", "orders": "count", "n": "size"}).collect()}
    assert (got["x"]["v"], got["x"]["orders"], got["x"]["n"], got["y"]["v"]) == (1, 2, 2, 1)
    got = {r["d"]: r["v"] for r in A.aggregate_to_keys(I.load_table(spark, pd.DataFrame({"d": ["x", "x", "y"], "v": [None, 2.0, None]})), ["d"], {"v": "first"}).collect()}
    assert got == {"x": 2.0, "y": None}
    got = {r["d"]: r["v"] for r in A.aggregate_to_keys(df.withColumn("v", F.lit(None).cast("double")), ["d"], {"v": "sum"}).collect()}
    assert got == {"x": 0.0, "y": 0.0}
    with pytest.raises(ConfigurationError):
        A.aggregate_to_keys(df, ["d"], {"v": "mode"})


def test_grain(spark):
    n = 60
    df = frame(spark, seat=[f"{i:03d}" for i in range(n)], row=[f"r{i % 5}" for i in range(n)], deck=[f"d{i // 5 % 4}" for i in range(n)], wing=[f"w{i // 20}" for i in range(n)], price=[i / 7 for i in range(n)])
    fine, coarse = P.infer_grain(df), P.infer_grain(df.drop("seat"))
    assert fine["columns"] == ["seat"] and set(coarse["columns"]) == {"row", "deck", "wing"} and not P.infer_grain(df.select("row", "deck"))["unique"]
    assert P.find_dimensions(df, df, ["seat"]) == ["row", "deck", "wing"] and P.find_date_column(df) is None
    pairs = spark.range(20_000).selectExpr("id % 200 AS x", "id div 200 AS y", "id % 7 AS z", "id * 0.5 AS f")
    assert set(P.infer_grain(pairs)["columns"]) == {"x", "y"}
    late = pairs.unionByName(pairs.where("x = 199 and y = 99"))  # a repeat that the first rows don't show
    assert not P.infer_grain(late)["unique"]
    assert compare_names() == (True, False, True, False, False)


def compare_names():
    return P.id_like("partKey"), P.id_like("paid"), P.date_like("ship_date"), P.date_like("candidate"), P.date_like("updated_at")


def test_quantiles(spark):
    """Quantiles, distances and rank sums of several series at once, against a sort in memory."""
    r = np.random.default_rng(3)
    x, y = r.normal(size=700).round(1), r.normal(0.4, 1, 500).round(1)
    df = spark.createDataFrame([(float(v), 1) for v in x] + [(float(v), 0) for v in y] + [(None, 1)], "v double, left int")
    ps = (0.0, 0.05, 0.33, 0.5, 0.99, 1.0)
    both = ranks.series(df, {0: (F.col("v"), F.col("left"), 1 - F.col("left")), 7: (F.abs("v"), 1, (F.col("v") > 0).cast("int")), 9: (F.lit(None), 1, 0)})
    got = ranks.measure(ranks.counted([both]), {0: ps, 7: (0.5,)})
    assert set(got) == {0, 7} and (got[0]["a"], got[0]["b"]) == (700, 500)
    assert got[0]["a_quantiles"] == pytest.approx(np.quantile(x, ps)) and got[0]["b_quantiles"] == pytest.approx(np.quantile(y, ps))
    at = np.unique(np.concatenate([x, y]))
    f, g = np.searchsorted(np.sort(x), at, "right") / 700, np.searchsorted(np.sort(y), at, "right") / 500
    assert got[0]["ks"] == pytest.approx(np.abs(f - g).max()) and got[0]["wasserstein"] == pytest.approx((np.abs(f - g)[:-1] * np.diff(at)).sum())
    z = np.concatenate([x, y])
    assert got[7]["ranks"] == pytest.approx(pd.Series(np.abs(z)).rank().to_numpy()[z > 0].sum()) and got[7]["a_quantiles"] == pytest.approx([np.median(np.abs(z))])
    assert ranks.measure(ranks.counted([both.limit(0)]), {0: ps}) == {}


def test_suggestions_of_whole_columns(spark):
    """Sides of opposite order share no value in their first 5000 rows; counts are those of the whole columns."""
    up = spark.range(12_000).selectExpr("id AS cust_key", "id % 6000 AS grp").coalesce(1)
    down = spark.range(12_000).selectExpr("11999 - id AS buyer_ref", "(11999 - id) % 6000 AS bucket").coalesce(1)
    got = {(s["left"], s["right"]): s for s in S.suggest_matches(up, down, ["cust_key", "grp"], ["buyer_ref", "bucket"])}
    assert got["cust_key", "buyer_ref"]["value_overlap"] == 1.0 and got["cust_key", "buyer_ref"]["uniqueness"] == 1.0
    assert S._values(up, down, ["cust_key", "grp"], ["bucket"]) == ({("l", "cust_key"): 12_000, ("l", "grp"): 6000, ("r", "bucket"): 6000}, {("cust_key", "bucket"): 6000, ("grp", "bucket"): 6000})


def test_skipped_rows_without_a_limit(spark, tmp_path):
    """Without nrows no limit is in the plan; rows are those after the skipped ones."""
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{i},x{i}\n" for i in range(10)))
    df = I.load_table(spark, str(path), read_options={"skiprows": 3})
    assert [r["a"] for r in df.collect()] == list(range(3, 10)) and "Limit" not in df._jdf.queryExecution().analyzed().toString()
    assert [r["a"] for r in I.load_table(spark, str(path), read_options={"skiprows": 3, "nrows": 2}).collect()] == [3, 4]
    assert [r["a"] for r in I.load_table(spark, str(path), read_options={"nrows": 2}).collect()] == [0, 1]


def test_schema(spark):
    a, b = frame(spark, id=[1], shade=["x"], depth=[1.0], zone=["E"]), frame(spark, id=[1], zone=["E"], depth=[1.0], lid=[0.0], remark=["y"])
    x = S.compare_schemas(a, b)
    assert x["added"] == ["lid", "remark"] and x["removed"] == ["shade"] and x["order_changed"]
    a = frame(spark, account_number=["x1", "x2"], order_quantity=[3, 9], invoice_date=["2025-02-01", "2025-02-03"], weight=[1.0, 2.0])
    b = frame(spark, acctNo=["x1", "x2"], ord_qty=[3, 9], inv_dt=["2025-02-01", "2025-02-03"], remark=["p", "q"])
    assert {(s["left"], s["right"]) for s in S.compare_schemas(a, b)["suggestions"]} == {("account_number", "acctNo"), ("order_quantity", "ord_qty"), ("invoice_date", "inv_dt")}
    assert S.name_similarity("cust_id", "custid") > 0.7 and S.name_similarity("a", "") == 0.0


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v,t\n007,1.5,true\n008,2,false\n")
    assert I.load_table(spark, tmp_path / "a.csv").first()["id"] == 7
    df = I.read(spark, I.as_source(tmp_path / "a.csv"), ["id"])
    assert df.first()["id"] == "007" and dict(df.drop(I.ROW).dtypes) == {"id": "string", "v": "double", "t": "boolean"}
    (tmp_path / "a.tsv").write_text("id\tv\n1\tx\n")
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": 2}]')
    assert I.load_table(spark, tmp_path / "a.tsv").first()["v"] == "x"
    assert I.load_table(spark, tmp_path / "a.jsonl").count() == I.load_table(spark, tmp_path / "a.json").count() == 2
    assert dict(I.read(spark, I.as_source(tmp_path / "a.json"), ["id"]).dtypes)["id"] == "string"
    for bad in ("s3://bucket/x.csv", tmp_path / "none.csv", tmp_path / "a.xyz"):
        with pytest.raises(InputError):
            I.as_source(bad)
    with pytest.raises(ConfigurationError):
        I.as_source(tmp_path / "a.csv", read_options={"storage_options": {}})
    I.register_reader("lines", lambda s, p, o: s.read.text(p))
    assert I.load_table(spark, tmp_path / "a.tsv", format="lines").count() == 2
    assert I.load_table(spark, pd.DataFrame({"x": [1.0, float("nan")]})).where("x is null").count() == 1
    assert fingerprint_file(tmp_path / "a.csv")["complete"] and fingerprint_frame(df)["rows"] == 2
    assert fingerprint_frame(df.repartition(3))["sha256"] == fingerprint_frame(df)["sha256"]
    assert I.sample(df, ["id"], 1, seed=3).collect() == I.sample(df.repartition(2), ["id"], 1, seed=3).collect()


def test_numerics(spark):
    assert N.chi2_sf(6.634896601021213, 1) == pytest.approx(0.01) and N.t_quantile(0.975, 9) == pytest.approx(2.2621571628, rel=1e-6)
    assert N.sign_test(8, 2) == pytest.approx(0.109375) and N.binom_sf(3, 10, 0.2) == pytest.approx(0.3222004736)
    jvm = spark._jvm.org.apache.commons.math3.distribution
    for x, k in ((0.5, 1), (3.3, 4), (50.0, 20)):
        assert N.chi2_sf(x, k) == pytest.approx(1 - jvm.ChiSquaredDistribution(float(k)).cumulativeProbability(x), rel=1e-8)
    assert N.wilson(0, 0) == (0.0, 1.0) and N.wilson(0, 10)[0] == 0.0 and N.wilson(5, 10) == pytest.approx((0.2365931, 0.7634069), rel=1e-5)
    assert N.jensen_shannon([1, 0], [0, 1]) == pytest.approx(1.0) and N.contingency([[10, 10], [10, 10]])[1] == pytest.approx(1.0)
    assert N.contingency([[20, 10], [10, 20]])[0] == pytest.approx(5.4)


def test_change_points():
    n = [800] * 40
    assert [c["index"] for c in T.change_points([9] * 22 + [77] * 18, n)] == [22]
    assert [c["index"] for c in T.change_points([9] * 11 + [77] * 6 + [9] * 23, n)] == [11, 17]
    assert T.change_points([9] * 40, n) == []
    rows = [(f"2025-05-{d:02d}", 66 if d == 9 else 7, 800) for d in range(1, 27)]
    assert [a["period"] for a in T.timeline(rows)["anomalies"]] == ["2025-05-09"]


@pytest.mark.parametrize("name, wanted", [("missing_and_extra", {}), ("rounding_without_tolerance", {}), ("systematic_bias_segment", {"bias": ["fee"], "concentrated": [("hub", "valley")]}), ("segment_missing", {"unmatched": [("carrier", "rail")]}), ("grain_difference", {"grain_diagnosed": True})])
def test_evaluation(spark, name, wanted):
    got = evaluate(spark, next(s for s in SCENARIOS if s.name == name), rows=6000, seed=1)
    assert all(v == 1.0 for k, v in got.items() if k.endswith(("precision", "recall"))), got
    assert {k: got[k] for k in wanted} == wanted


def test_dtype(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c\n1,007,x\n2,8,\n")
    df = I.load_table(spark, path, read_options={"dtype": {"a": "float", "b": "str"}})
    assert [tuple(r) for r in df.select("a", "b", "c").collect()] == [(1.0, "007", "x"), (2.0, "8", None)]
    with pytest.raises(Exception, match="no int"):
        I.load_table(spark, path, read_options={"dtype": {"c": "int"}}).collect()
    with pytest.raises(ConfigurationError):
        I.load_table(spark, path, read_options={"dtype": {"c": "complex"}})
    assert I.load_table(spark, path, read_options={"one_line_rows": True}).count() == 2


def test_fingerprint_of_parts(spark, tmp_path):
    """A directory is known by its listing and footers; other rows or another part make another digest."""
    spark.range(100).coalesce(2).write.parquet(str(tmp_path / "d"))
    first = fingerprint_file(tmp_path / "d")
    assert first["rows"] == 100 and first["columns"] == 1 and first["complete"] and fingerprint_file(tmp_path / "d") == first
    spark.range(7).coalesce(1).write.mode("append").parquet(str(tmp_path / "d"))
    assert fingerprint_file(tmp_path / "d")["rows"] == 107 and fingerprint_file(tmp_path / "d")["sha256"] != first["sha256"]
