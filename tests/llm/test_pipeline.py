"""The pipeline's stages against plain loops over a small corpus."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from entlink.llm.tokens import Encoder

from .test_dedup import plain_bytes, plain_classes
from .test_models import plain_templates


def test_stages(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    for k, (name, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, path).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name == "language":
            rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
        elif name == "near_duplicates":
            rows = [(i, t) for i, t in rows if plain_classes(rows)[i] == i]
        elif name == "repeated_bytes":
            removed = {i: r[1] for i, r in plain_bytes(rows, 50).items()}
            got = {r.doc_id: r for r in docs.collect()}
            assert {i: len(t.encode()) - len(got[i].text.encode()) for i, t in rows} == removed and all(r.n_chars == len(r.text) for r in got.values())
            rows = [(i, got[i].text) for i, _ in rows]
        elif name == "decontamination":
            bad = {d for d, _ in plain_templates(rows, items)}
            assert bad
            rows = [(i, t) for i, t in rows if i not in bad]
        if name == "packing":
            enc = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
            total = sum(len(np.frombuffer(x, enc.dtype)) + 1 for x in enc.encode([t for _, t in rows]))
            assert sum(r.length for r in docs.collect()) == total and {r.doc_id for r in docs.collect()} == {i for i, _ in rows}
        else:
            assert docs.columns == columns and sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(rows)
    assert corpus_pipeline.run(spark, path).count() == docs.count()


def test_empty(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        out = step(spark, docs, path)
        assert out.count() == 0


def test_rows_without_an_id_of_their_own(spark, folder, corpus):
    """Null and repeated ids, clashing names: rows are judged one by one, and none goes for another's sake."""
    path, rows, items = folder
    texts = dict(rows)
    odd = [(None, texts[5]), (None, texts[7]), (None, texts[5]), (9, texts[9] + " and some more words"), (9, texts[11]), (9, texts[11]), (None, dict(items)[1] + " " + texts[12]), (12, texts[12])]
    odd = [(i, t, "en", 0, 0.5, "x", "y", True, k) for k, (i, t) in enumerate(odd)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, n_chars long, score double, lang_pred string, kept_text string, held boolean, `key` int")
    columns = docs.columns
    out = corpus_pipeline.language(spark, docs, path)
    assert out.columns == columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    out = corpus_pipeline.near_duplicates(spark, docs, path)
    kept = sorted((r.doc_id is None, r.text) for r in out.collect())
    distinct = {(i is None, t) for i, t, *_ in odd}
    assert out.columns == columns and len(kept) == len(set(kept)) and set(kept) <= distinct
    classes = plain_classes(list(enumerate(sorted({t for _, t, *_ in odd}))))
    assert len(kept) == len(set(classes.values()))
    out = corpus_pipeline.repeated_bytes(spark, docs, path)
    cut = {r.key: (r.doc_id, r.text, r.n_chars, r.score, r.held) for r in out.collect()}
    assert out.columns == columns and len(cut) == len(odd) and all(cut[k][0] == odd[k][0] and cut[k][2] == len(cut[k][1]) and cut[k][3:] == (0.5, True) for k in range(len(odd)))
    assert cut[0][1] == texts[5] and cut[4][1] == texts[11]
    out = corpus_pipeline.decontamination(spark, docs, path)
    bad = {k for k in range(len(odd)) if plain_templates([(0, odd[k][1])], items)}
    assert out.columns == columns and {r.key for r in out.collect()} == set(range(len(odd))) - bad and bad
    assert corpus_pipeline.packing(spark, docs, path).where("piece = 0").count() == len(odd)
