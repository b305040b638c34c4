"""Each stage of the pipeline on its own input against a brute-force version, over all documents of the data folder."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import AWKWARD, frame
from test_texts import contamination, first_stays, left_of, linked

import corpus_pipeline as pipeline
from cairn.llm import packing, quality, substrings


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    """Input and output rows of each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{data}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, data).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, after)
        docs = after
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        assert before.columns == pipeline.COLUMNS
        if name != "packing":
            assert after.columns == pipeline.COLUMNS and after.dtypes == before.dtypes


def test_quality_stage(spark, data, stages):
    before, after = stages["quality"]
    trees = quality.train(before, spark.read.parquet(f"{data}/labels.parquet"))
    keep = set()
    for i, t in rows(before):
        body = np.frombuffer((t or "").encode(), np.uint8)
        if trees.score(quality.statistics(body, np.array([0, len(body)])))[0] >= 0.3:
            keep.add(i)
    assert {i for i, _ in rows(after)} == keep and 0 < len(keep) < before.count()


def test_near_duplicate_stage(stages):
    before, after = stages["near_duplicates"]
    assert {i for i, _ in rows(after)} == {i for i, _, c in linked(rows(before), 5, 80, 100) if c == i}


def test_repeated_passage_stage(stages):
    before, after = stages["repeated_passages"]
    assert left_of(after) == first_stays(rows(before), substrings.LENGTH)
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_repeated_passage_stage_on_awkward_rows(spark, data):
    docs = frame(spark).select(*pipeline.COLUMNS)
    assert left_of(pipeline.repeated_passages(spark, docs, data)) == first_stays(AWKWARD, substrings.LENGTH)


def test_leak_stage(spark, data, stages):
    before, after = stages["benchmark_leaks"]
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    assert {i for i, _ in rows(after)} == {d for d, _, hit, _ in contamination(rows(before), items) if not hit}


def test_packing_stage(stages):
    before, after = stages["packing"]
    encoder = packing.UnitEncoder(**pipeline.tokenizer_files())
    found, wanted = after.collect(), Counter()
    for i, t in rows(before):
        ids = encoder.whole.encode(t or "", add_special_tokens=False).ids + [0]
        head = (len(ids) - 1) % 2048 + 1
        for p, a in enumerate([0, *range(head, len(ids), 2048)]):
            piece = ids[a : head if p == 0 else a + 2048]
            wanted[(i, p, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == wanted
    places = defaultdict(int)
    for r in found:
        places[r["sequence_id"]] += r["length"]
    assert max(places.values()) <= 2048


def test_stages_take_awkward_rows(spark, data):
    """Nulls, empty and very long texts, repeated rows, and an empty table."""
    for source in (frame(spark), frame(spark, [])):
        docs = source.select(*pipeline.COLUMNS)
        for _, stage in pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, data).toArrow())
        assert docs.columns[-2:] == ["sequence_id", "offset"]
