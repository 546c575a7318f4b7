"""The pipeline's stages against what they promise, on a small corpus."""

import corpus_pipeline
import pytest

from foliant.llm import mixing, quality_crf, secret_scan

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    from foliant.llm.common import written

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def test_columns(stages):
    want = stages["documents"].columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "pack"]
    assert all(stages[k].columns == want for k in ("quality", "near_dedup", "secrets", "mix"))


def test_quality_keeps_good_and_drops_bad(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").toPandas().set_index("doc_id")["quality"]
    kept = {r["doc_id"] for r in stages["quality"].select("doc_id").collect()}
    good, bad = [i for i in labels.index if labels[i] == 1], [i for i in labels.index if labels[i] == 0]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.1 * len(bad)


def test_dedup_keeps_one_of_each_text_and_clean_ones(stages):
    before, after = stages["quality"].toPandas(), stages["near_dedup"].toPandas()
    assert not after["text"].duplicated().any() and set(after["doc_id"]) <= set(before["doc_id"])
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in zip(before["doc_id"], before["text"], strict=True) for w in [t.lower().split()]}
    kept, gone = list(after["doc_id"]), [i for i in before["doc_id"] if i not in set(after["doc_id"])]
    likeness = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    assert sum(max(likeness(i, k) for k in kept) >= 0.5 for i in gone) >= 0.97 * len(gone)
    near = [(a, b) for n, a in enumerate(kept) for b in kept[:n] if len(shingles[a] & shingles[b]) and likeness(a, b) >= 0.8]
    assert len(near) <= 0.02 * len(gone)


def test_secrets_are_gone(stages):
    assert all(not secret_scan.find(r["text"])[1] and r["n_chars"] == len(r["text"]) for r in stages["secrets"].collect())
    assert stages["secrets"].count() == stages["near_dedup"].count()


def test_mix_keeps_clean_documents(spark, stages):
    model = mixing.train(stages["secrets"], spark.read.parquet(f"{SF}/labels.parquet"))
    scored = mixing.with_posteriors(stages["secrets"], model).toPandas()
    kept = set(stages["mix"].toPandas()["doc_id"])
    clean = scored[[p[0] > 0.95 for p in scored["mix_p"]]]
    toxic = scored[[p[2] > 0.95 for p in scored["mix_p"]]]
    assert clean["doc_id"].isin(kept).all() and toxic["doc_id"].isin(kept).mean() < 0.3


def test_pack_places_every_document(stages):
    placed = stages["pack"].toPandas()
    assert (placed.groupby("sequence_id")["length"].sum() <= 2048).all() and set(placed["doc_id"]) == set(stages["mix"].toPandas()["doc_id"])


def test_no_labels_no_rejection(spark, stages):
    none = spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    assert quality_crf.keep_good(stages["documents"], quality_crf.train(stages["documents"], none)).count() == stages["documents"].count()
