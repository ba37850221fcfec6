import pathlib
import re
from collections import defaultdict

import corpus_pipeline
from facetframe.llm import decontamination, quality_classifier, secret_scan, simhash
from facetframe.llm.queries import ORACLES, QUERIES
from test_decontamination import brute_tiles, tokens
from test_simhash import similar_roots

SF = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stages = dict(corpus_pipeline.STAGES)
    labels, benchmark = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")

    good = stages[names[0]](spark, docs, SF).cache()
    chosen = {r["doc_id"] for r in quality_classifier.score_quality(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == chosen and good.dtypes == docs.dtypes

    single = stages[names[1]](spark, good, SF).cache()
    rows = good.orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in rows]
    parent = similar_roots([r["text"] for r in rows])
    assert {r["doc_id"] for r in single.collect()} == {ids[i] for i in parent}

    free = stages[names[2]](spark, single, SF).cache()
    tests = [tokens(r["text"]) for r in benchmark.collect()]
    windows = {tuple(t[i : i + 5]) for t in tests for i in range(len(t) - 4)}
    kept = set()
    for r in single.collect():
        words = tokens(r["text"])
        touched = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} & windows
        near = [t for t in tests if touched & {tuple(t[i : i + 5]) for i in range(len(t) - 4)}]
        if not any(brute_tiles(words, t, 5) >= 0.5 * len(t) for t in near):
            kept.add(r["doc_id"])
    assert {r["doc_id"] for r in free.collect()} == kept

    masked = stages[names[3]](spark, free, SF).cache()
    assert masked.count() == free.count() and masked.dtypes == docs.dtypes
    assert secret_scan.scan_secrets(masked).where("n_access > 0 OR n_hex > 0").count() == 0
    before = {r["doc_id"]: r["text"] for r in free.collect()}
    for r in masked.collect():
        assert r["n_chars"] == len(r["text"])
        assert r["text"] == before[r["doc_id"]] or re.search(r"\[(assign|access|hex|pem|github|slack|jwt)\]", r["text"])

    packed = stages[names[4]](spark, masked, SF).collect()
    lengths = defaultdict(int)
    for r in packed:
        lengths[r["sequence_id"]] += r["length"]
    assert {r["doc_id"] for r in packed} == kept and max(lengths.values()) <= 1024


def test_run_and_empty_documents(spark, tmp_path):
    from facetframe.session import stage_folder

    folder = pathlib.Path(stage_folder(spark))
    before = set(folder.glob("*")) | set(folder.glob("pipeline-*/*"))
    assert corpus_pipeline.run(spark, SF).count() > 0
    left = (set(folder.glob("*")) | set(folder.glob("pipeline-*/*"))) - before
    # What the result reads: the last stage's input, and the tables of the packing.
    assert sorted(p.name for p in left if not p.name.startswith(("stage-", "pipeline-"))) == ["secret_scan"]
    assert len([p for p in left if p.name.startswith("stage-")]) <= 3
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, len(QUERIES) + 1))
    assert set(ORACLES) <= set(QUERIES)
    assert decontamination.COVERAGE == 0.5 and simhash.DISTANCE == 3


def test_task_functions_import_nothing_of_the_package():
    """They travel by value, so that executors need no copy of it; an import inside one would fail there."""
    import facetframe.llm

    for file in pathlib.Path(facetframe.llm.__file__).parent.glob("*.py"):
        for line in file.read_text().splitlines():
            assert not re.match(r"\s+(from \.|(from|import) facetframe)", line), f"{file.name}: {line}"
