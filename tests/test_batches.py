"""Python workers get short batches, whatever the session had."""

import pandas as pd
from pyspark.sql import functions as F

from lexlake.operators import normalize as N
from lexlake.plans import registry


def test_batches_are_bounded(spark, sf_dir):
    @F.pandas_udf("int")
    def rows(ids: pd.Series) -> pd.Series:
        return pd.Series([len(ids)] * len(ids))

    raw = spark.createDataFrame([], "source_key string, external_id string, connector string, content binary, content_type string, url string, metadata map<string,string>")
    for use in (lambda: registry.QUERIES["n1_normalize_text"](spark, sf_dir), lambda: N.normalize_all(raw)):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        use()
        assert spark.range(0, 5000, 1, 1).select(rows("id").alias("n")).agg(F.max("n")).first()[0] <= 1000
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20
