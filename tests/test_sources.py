import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks, tables
from tessera.streaming import ingest


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_expression_ingest_and_cache(spark, tmp_path):
    p = _write(tmp_path / "e.csv", "extra,model_id,gene_symbol,rsem_tpm,duplicate,data_source\n1,m1,A,1.0,False,x\n1,m1,A,3.0,no,x\n1,m1,A,9.0,TRUE,x\n1,m2,A,nan,,x\n1,m3,A,5,,x\n1,m2,B,bad,,x\n1,m2,B,2,,x\n")
    ids = spark.createDataFrame([("m1",), ("m2",)], "id string")
    cache = str(tmp_path / "cache")
    out = tables.expression(spark, p, ids, cache)
    assert {tuple(r) for r in out.collect()} == {("m1", "A", 2.0), ("m2", "B", 2.0)}
    (tmp_path / "e.csv").unlink()
    assert tables.expression(spark, p, ids, cache).count() == 2
    assert tables.has_feature(out, "gene_symbol", "B") and not tables.has_feature(out, "gene_symbol", "Z")
    with pytest.raises(tables.SourceError):
        tables.expression(spark, p, ids)


def test_stream_equals_batch(spark, tmp_path):
    head = "model_id,gene_symbol,rsem_tpm,duplicate,data_source\n"
    _write(tmp_path / "in/a.csv", head + "m1,A,1.0,false,x\nm1,A,9,true,x\n")
    _write(tmp_path / "in/b.csv", head + "m1,A,3.0,,x\nm9,A,3.0,,x\n")
    means = ingest.running_means(ingest.expression_stream(spark, str(tmp_path / "in"), 1), spark.createDataFrame([("m1",)], "model_id string"))
    q = ingest.start(means, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [tuple(r) for r in ingest.latest(spark, str(tmp_path / "out")).collect()] == [("m1", "A", 2.0, 2)]
    # a later file goes on from the stream's state; what did not change stays
    _write(tmp_path / "in/c.csv", head + "m1,B,5.0,,x\n")
    ingest.start(ingest.running_means(ingest.expression_stream(spark, str(tmp_path / "in"), 1), spark.createDataFrame([("m1",)], "model_id string")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    ingest.compact(spark, str(tmp_path / "out"), str(tmp_path / "table"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {("m1", "A", 2.0, 2), ("m1", "B", 5.0, 1)}


def test_small_readers(spark, tmp_path):
    sets = tmp_path / "sets"
    _write(sets / "one.txt", "Symbol\nA\n\nB\n")
    _write(sets / "two.txt", "C\r\nD")
    got = {(r.set, r.line_no, r.gene) for r in tables.set_files(spark, str(sets), {"two": "TWO"}).collect()}
    assert ("one", 1, "A") in got and ("TWO", 1, "D") in got
    al = tables.aliases(spark, _write(tmp_path / "al.csv", "alias,symbol\na,X\na,A\n")).orderBy("ordinal").collect()
    assert [r.symbol for r in al] == ["X", "A"]
    assert tables.aliases(spark, str(tmp_path / "none.csv"), required=False).count() == 0
    c = tables.counts(spark, _write(tmp_path / "c.tsv", "NAME\ts1\tUnnamed: 2\nA\t1\t\nA\t2\t\nB\tx\t\n"), {"s1": (0, "u")})
    assert {(r.NAME, r["count"]) for r in c.collect()} == {("A", 3.0), ("B", None)}
    with pytest.raises(tables.SourceError):
        tables.counts(spark, str(tmp_path / "c.tsv"), {"s9": (0, "u")})
    m = tables.interleaved(spark, _write(tmp_path / "m.tsv", "L1_AVG.Beta\tL1_Detection.PVal\tL2_AVG.Beta\tL2_Detection.PVal\ncg1\t0.5\t0.001\t0.2\t0.5\n"))
    assert {tuple(r) for r in m.collect()} == {("cg1", "L1", 0.5, 0.001), ("cg1", "L2", 0.2, 0.5)}
    r = _write(tmp_path / "r.csv", "drug,target,line_set,n,r,p,rho\nd,AUC,x,10,0.5,0.1,0.4\nd,IC,x,10,,,\n")
    assert tables.ceiling(spark, r, "AUC", "d") == 0.5
    with pytest.raises(tables.SourceError):
        tables.ceiling(spark, r, "IC", "d")
    assert tables.clinical(spark, str(tmp_path), ["nope"]) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d", [1, 2], 0.5)], "drug string, ids array<int>, r double")
    sinks.write_result(df, str(tmp_path / "out"), "x")
    back = spark.read.option("header", True).csv(str(tmp_path / "out")).first()
    assert back.ids == "[1,2]" and back.r == "0.5"
    sinks.save_model(spark, str(tmp_path / "m"), spark.createDataFrame([("g", 1.0)], "gene string, coef double"), {"deconfounded": True})
    coef, meta = sinks.load_model(spark, str(tmp_path / "m"))
    assert coef.first().coef == 1.0 and meta == {"deconfounded": True}
    assert "| 0.500 |" in sinks.markdown(df.select("drug", "r"))
    assert sinks.one_row(df, drug="d")["r"] == 0.5
    for d in ("x",):
        with pytest.raises(LookupError):
            sinks.one_row(df, drug=d)
    row = sinks.metric_row(spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "t double, p double"), "m", "t", "p", 0.5)
    assert row["r"] == pytest.approx(1) and row["pct_of_ceiling"] == pytest.approx(200)
    sinks.write_parts(df.withColumn("k", F.lit(1)), str(tmp_path / "parts"), ["k"])
    assert spark.read.parquet(str(tmp_path / "parts")).first().k == 1
    sinks.write_report(str(tmp_path / "a/b.md"), "x")
