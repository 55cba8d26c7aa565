"""Sources: CSV scan with declared schema and NA tokens, first-n option; loans view shape."""

from pyspark.sql import functions as F

from riskspark.functions.stats import fit_quantiles
from riskspark.plans import catalog as C
from riskspark.session import scratch_path
from riskspark.sources import loans as L


def test_csv_na_tokens_and_sample(spark):
    path = scratch_path(spark, "csv-test")
    rows = ["id,issue_d,revenue,dti_n,loan_amnt,fico_n,experience_c,emp_length,purpose,home_ownership_n,"
            "addr_state,zip_code,Default,title,desc",
            "1,2015-12-01,50000,10.5,1000,700,1,n/a,car,RENT,CA,Z100,0,NA,",
            "2,2015-12-01,NaN,null,2000,710,1,3 years,house,OWN,NY,,1,x,y",
            "3,2015-12-01,60000,12,3000,720,1,10+ years,medical,OWN,NY,Z101,0,t,d"]
    spark.sparkContext.parallelize(rows, 1).saveAsTextFile(path)
    df = L.load_csv(spark, path)
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["emp_length"] is None and got[1]["title"] is None and got[1]["desc"] is None
    assert got[2]["revenue"] is None and got[2]["dti_n"] is None and got[2]["zip_code"] is None
    assert got[3]["fico_n"] == 720.0 and got[3]["loan_amnt"] == 3000
    assert L.load_csv(spark, path, sample_size=2).count() == 2


def test_loans_view_shape(spark, sf_small):
    df = C.loans(spark, sf_small)
    assert df.columns == L.LOAN_COLUMNS
    assert dict(df.dtypes)["loan_amnt"] == "bigint" and dict(df.dtypes)["Default"] == "bigint"
    assert df.count() == df.select("id").distinct().count()


def test_quantile_sketch_option(spark, sf_small):
    df = C.loans(spark, sf_small)
    exact = fit_quantiles(df, ["fico_n"], [0.25, 0.75])
    approx = fit_quantiles(df, ["fico_n"], [0.25, 0.75], accuracy=10000)
    assert all(abs(a - b) <= 5.0 for a, b in zip(exact["fico_n"], approx["fico_n"]))
