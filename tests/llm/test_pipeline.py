"""Every stage of the pipeline against brute force on what the stage before kept."""
import zlib
from collections import Counter

import numpy as np

from test_decontaminate import brute as contaminated
from test_minhash import brute as components
from test_packing import brute as pieces
from test_packing import check
from test_suffixes import brute as repeats

import corpus_pipeline
from flowglass.llm.store import written

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "packing":
            assert docs.columns == columns
    rows = {k: [(r.doc_id, r.text) for r in v.select("doc_id", "text").collect()] for k, v in kept.items() if k != "packing"}
    source = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {d for d, _ in rows["quality"]}
    good = [d in left for d, q in labels.items() if q == 1]
    assert sum(good) >= 0.98 * len(good) and len(left) < source.count()
    want = {r[0] for r in components(rows["quality"], 5) if r[3]}
    assert {d for d, _ in rows["near_duplicates"]} == want
    sizes = {r[0]: r[1] - r[2] for r in repeats(rows["near_duplicates"])}
    got = {d: len((t or "").encode()) for d, t in rows["suffix_dedup"]}
    assert got.keys() == sizes.keys() and all(sizes[d] - 8 <= n <= sizes[d] for d, n in got.items())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert {d for d, _ in rows["decontamination"]} == {r[0] for r in contaminated(rows["suffix_dedup"], items) if not r[5]}
    packed = kept["packing"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces(rows["decontamination"], 2048)
    total = sum(r.length for r in packed)
    assert check(packed, 2048) <= -(-total // 2048) * 1.01 + 1


def test_edges(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    odd = [(None, "a text without id, long enough to be looked at by all", "en", "src1", None), (900001, None, None, None, None), (900002, "", "en", "src2", 0), (900003, " \t\n", "xx", "", 3), (900003, " \t\n", "xx", "", 3),
           (900004, "word " * 30_000, "en", "src3", 150_000)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(20))
    clash = {"id": "x", "words": "y", "bands": 1, "kept": True, "_text": 2, "sequence_id": 3, "component_id": 4, "ids": "z"}
    from pyspark.sql import functions as F

    more = rows.withColumns({k: F.lit(v) for k, v in clash.items()})
    for table in (more, rows.limit(0)):
        at = table
        for name, stage in corpus_pipeline.STAGES:
            at = written(stage(spark, at, SF), name)
            if name != "packing":
                assert at.columns == table.columns
        packed = at.collect()
        assert (not packed) == (table is not more)
