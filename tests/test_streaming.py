"""A stream of papers gives the same annotations and edges as one batch."""

from pyspark.sql import functions as F

from diachron.operators import network as net
from diachron.streaming import annotations as st


def test_stream_equals_batch(spark, tmp_path):
    rows = [(str(i), "deep neural network", "graph theory of a neural network" if i % 2 else "graph theory", "cs", 2000 + i % 2) for i in range(12)]
    schema = "arxiv_id string, title string, abstract string, categories string, year long"
    whole = spark.createDataFrame(rows, schema)
    for i in range(3):
        whole.where(F.col("arxiv_id").cast("int") % 3 == i).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    terms = spark.createDataFrame([("neural network",), ("deep neural network",), ("graph theory",)], "term string")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    st.follow(stream, terms, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out/annotations").select("arxiv_id", "phrases", "year")
    want = st.annotate_batch(whole, terms).select("arxiv_id", "phrases", "year").persist()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    postings = want.select("year", F.col("arxiv_id").alias("doc"), F.explode("phrases").alias("phrase"))
    summed = st.edges(spark.read.parquet(f"file://{tmp_path}/out/edges"))
    assert sorted(map(tuple, summed.select("year", "a", "b", "w").collect())) == sorted(map(tuple, net.edges(postings).collect()))
