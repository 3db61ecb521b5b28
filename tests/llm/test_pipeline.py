"""The pipeline over awkward documents, against the operators' brute-force versions."""

import corpus_pipeline
from llmdata import awkward, rows, spark_docs
from test_decontamination import brute as leaks
from test_packing import check_pieces
from test_quality import brute as measures
from test_similar import brute as similar
from test_substring_dedup import brute as stripped


def keeps(text):
    m = measures(text)
    return not (
        m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
        or m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 20 * m["n_words"] or 10 * m["n_stutters"] > 3 * m["n_words"]
    )


def test_run_equals_brute_force(spark, tmp_path):
    texts = dict(enumerate(awkward(), 50))
    item = " ".join(texts[57].split()[10:40])
    spark_docs(spark, rows(list(texts.values()), 50)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: t for i, t in texts.items() if keeps(t)}
    ids = list(left)
    groups = similar([left[i] for i in ids])
    left = {i: left[i] for k, i in enumerate(ids) if groups[k] == k}
    cut = stripped(left.items())
    left = {i: left[i] if not gone else text for i, (n, gone, text) in cut.items() if not gone or gone < n}
    bad = {d for d, _ in leaks(left.items(), [(1, item)])}
    left = {i: t for i, t in left.items() if i not in bad}

    assert 57 in bad and len(left) > 5
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    order = {i: k for k, i in enumerate(left)}
    moved = [{**p.asDict(), "doc_id": order[p["doc_id"]]} for p in pieces]
    assert check_pieces(moved, list(left.values())) == 0


def test_stages_keep_the_columns(spark, tmp_path):
    spark.createDataFrame([(1, "q")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark_docs(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
