"""op9 and the pipeline's last stage return the sampled sequences."""

import zlib

import numpy as np

import corpus_pipeline
from fleetlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_sequences_are_returned(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for frame in (QUERIES["op9_sampled_segmentations"](spark, SMALL), corpus_pipeline.segmentations(spark, docs, SMALL)):
        rows = frame.limit(20).collect()
        assert rows
        for r in rows:
            assert len(r["ids"]) == r["n_pieces"]
            assert zlib.crc32(np.array(r["ids"], np.int32).tobytes()) == r["ids_crc32"]
