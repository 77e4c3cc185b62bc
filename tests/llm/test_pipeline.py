"""The pipeline's stages, each on what its predecessor kept."""

from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import plain
import pytest

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        assert 0 < len(after) <= len(before) and set(after) <= set(before)
        if name == "near_duplicates":
            ids = sorted(before)
            sets = [plain.five_word_runs(before[i].text) for i in ids]
            held = defaultdict(list)
            for i, c in zip(ids, plain.components_of(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))):
                held[c].append(i)
            assert set(after) == {min(v) for v in held.values()}
        if name == "personal_data":
            assert set(after) == set(before)
            spans = [plain.base(r.text, plain.PERSONAL, False)[2] for r in after.values()]
            assert sum(map(bool, spans)) == 0
            assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
        else:
            assert all(after[i] == before[i] for i in after)


def test_run_keeps_every_token_of_what_is_kept(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in rows}
    assert ids and ids <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r.doc_id for r in rows if r.piece == 0} == ids
    (folder,) = {r.texts for r in rows}
    kept = spark.read.parquet(folder)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == ids and "text" in kept.columns
    assert not Path(folder.removeprefix("file://")).with_name("toxicity").exists()


@pytest.mark.parametrize("rows", [plain.ROWS, []])
def test_run_on_awkward_and_empty_tables(spark, tmp_path, rows):
    """Nulls in every column, empty and very long texts, repeated rows, and further columns whose names operators use."""
    for name in ("labels", "benchmark"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    plain.table_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sets = {(r[0], r[1]): plain.five_word_runs(r[1]) for r in rows}
    assert {r.doc_id for r in got} <= {i for i, _ in sets} and bool(got) == bool(rows)
    if rows:
        held = spark.read.parquet(got[0].texts)
        assert held.columns == ["doc_id", "text", "lang", "source", "n_chars", *plain.CLASHING]
        assert {1, 6, 7, 8, None} & {r.doc_id for r in got} >= {1, 7, 8, None} and 2 not in {r.doc_id for r in got}
