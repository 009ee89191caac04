import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from spantide.session import get_spark
    s = get_spark("local[4]", "spantide-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "6g"})
    if not s.conf.get("spark.checkpoint.dir", None):
        d = tempfile.mkdtemp(prefix="spantide-test-ckpt-")
        s.conf.set("spark.checkpoint.dir", d)
        s.sparkContext.setCheckpointDir(d)
    yield s


def docs_df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def spans(df, doc_id=0):
    return [(r["begin"], r["end"]) for r in
            df.where(df.doc_id == doc_id).orderBy("begin", "end").collect()]
