"""The pipeline's stages, each on what the one before kept."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.tables import odd_documents, write_documents

SF = "/root/testdata/sf0.001"


def test_stage_order():
    assert len(corpus_pipeline.STAGES) == 4


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([tuple(r) for r in docs.select(*(("doc_id", "text", "source") if docs.columns == columns else docs.columns)).collect()])
    whole = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    quality, near, mixed, packed = seen

    good = {row[0] for row in brute.quality(whole) if not row[6]}
    assert {d for d, _, _ in quality} <= good and Counter(quality) <= Counter(whole)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(labels.get(d) != 0 for d, _, _ in quality)
    assert {d for d in good if labels.get(d) == 1} <= {d for d, _, _ in quality}

    kept = {doc for doc, _, _, keep in brute.near(quality) if keep}
    assert Counter(near) == Counter(row for row in quality if row[0] in kept)

    sizes, taken = Counter(), Counter()
    for _, text, source in near:
        sizes[source] += len(brute.WORD.findall(text))
    for _, text, source in mixed:
        taken[source] += len(brute.WORD.findall(text))
    longest = max(len(brute.WORD.findall(text)) for _, text, _ in near)
    assert all(abs(taken[s] - target) <= longest for s, target in brute.targets(sizes).items())
    assert max(Counter(mixed).values()) <= 3 and set(mixed) <= set(near)

    assert Counter(row[:5] for row in packed) == brute.pieces(mixed)
    ends = Counter()
    for row in sorted(packed, key=lambda r: (r[5], r[6])):
        assert row[6] == ends[row[5]]
        ends[row[5]] += row[3]
    assert max(ends.values()) <= 1024


def test_run_without_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, write_documents(spark, str(tmp_path), [])).count() == 0


def test_stages_on_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, copies, ties, null sources, and columns whose names the stages use themselves."""
    rows = odd_documents()
    folder = write_documents(spark, str(tmp_path / "in"), rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack_sequences":
            assert docs.columns == columns
            assert {tuple(r) for r in docs.select("lang", "size", "target", "_row", "slot").collect()} <= {("en", 5, "x", "y", 6)}
        seen.append([tuple(r) for r in docs.select(*columns[:2], *(["source"] if "source" in docs.columns else [])).collect()] if name != "pack_sequences" else docs.collect())
    quality, near, mixed, packed = seen
    good = {row[0] for row in brute.quality(rows) if not row[6]}
    assert quality and {d for d, _, _ in quality} <= good and Counter(quality) <= Counter(rows)
    kept = {doc for doc, _, _, keep in brute.near(quality) if keep}
    assert Counter(near) == Counter(row for row in quality if row[0] in kept)
    assert set(mixed) <= set(near) and max(Counter(mixed).values()) <= 3
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == brute.pieces(mixed)
