"""Input columns named as the operators' own."""

from pyspark.sql import functions as F

from loamframe.llm import common, warc


def test_warc_columns(spark):
    pages = spark.createDataFrame([(1, "u", bytearray(b"x" * 200)), (2, "v", bytearray(b"x" * 200)), (None, None, bytearray(b""))], "record_id long, uri string, payload binary")
    for c in ("head", "tail", "chunk_no", "n_chunks", "body", "data", "refers_to"):
        pages = pages.withColumn(c, F.lit("own"))
    files = warc.write_warc(warc.record_chunks(warc.decide_revisits(pages)), common.new_folder(spark, "warc"))
    got = {r["record_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(files).where("is_last").collect()}
    assert got == {1: ("response", None, 200), 2: ("revisit", 1, 200), None: ("response", None, 0)}
