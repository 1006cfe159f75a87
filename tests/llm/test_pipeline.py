"""The pipeline against what each stage's brute-force version keeps of a planted corpus."""

import random
import re

import corpus_pipeline
import tiktoken
import public_tokenizers

from millrace.llm import byte_bpe, pii

from .helpers import ODD_TEXTS, documents, write_tables
from .test_classifiers import corpus
from .test_search_and_dedup import classes, contained, edited, words


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(12)
    texts, toxic, _ = corpus(800, 21)
    texts = [t.replace("!!", "") for t in texts]
    planted = len(texts)
    base = words(rng, 80)
    item = " ".join(words(rng, 30))
    texts += [" ".join(base), " ".join(base), " ".join(edited(rng, base, 0.01))]
    texts += [" ".join(words(rng, 40)) + " " + item + " " + " ".join(words(rng, 40))]
    texts += ["call +1 (974) 555-3436 now " + " ".join(words(rng, 10))]
    texts += ODD_TEXTS
    labels = [(i, 1, int(t)) for i, t in enumerate(toxic)]
    folder = write_tables(
        spark, tmp_path,
        documents=documents(spark, texts),
        labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        benchmark=spark.createDataFrame([(0, item)], "item_id bigint, text string"),
    )

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None

    clean = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    insulted = {i for i in range(planted) if toxic[i]}
    assert len(clean & insulted) <= 0.1 * len(insulted) and len(clean - insulted) >= 0.95 * (len(texts) - len(insulted))
    left = sorted(clean)
    groups = classes([texts[i] for i in left])
    one = [left[i] for i, g in enumerate(groups) if g == i]
    found = {d for d, *_ in contained([texts[i] for i in one], [item])}
    want = {one[i] for i in range(len(one)) if i not in found}

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.RANKS), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == want
    assert planted + 3 not in got and {planted, planted + 1, planted + 2} & set(got) == {planted}
    assert "[PHONE]" in got[planted + 4].text and not re.search(r"555-3436", got[planted + 4].text)
    for r in got.values():
        assert list(r.ids) == reference.encode_ordinary(r.text) and r.n_tokens == len(r.ids)
        if r.doc_id != planted + 4 and not pii.base_spans(pii.Packed([texts[r.doc_id] or ""]))[0]:
            assert r.text == (texts[r.doc_id] or "")


def test_empty_documents(spark, tmp_path):
    folder = write_tables(
        spark, tmp_path, documents=documents(spark, []), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), benchmark=spark.createDataFrame([], "item_id bigint, text string")
    )
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_further_columns_nulls_and_repeated_rows(spark, tmp_path):
    texts, toxic, _ = corpus(60, 31)
    texts = [t.replace("!!", "") for t in texts]
    rows = [*texts, None, None, "", "same words here again and again", "same words here again and again", "left alone"]
    ids = [*range(60), 60, 61, 62, 63, 63, None]
    folder = write_tables(
        spark, tmp_path,
        documents=documents(spark, rows, extra=True, ids=ids),
        labels=spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)] + [(None, None, 1), (3, None, None)], "doc_id bigint, quality int, toxic int"),
        benchmark=spark.createDataFrame([(None, None), (1, "")], "item_id bigint, text string"),
    )
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()
    assert sum(r.doc_id == 63 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 1
    assert {r.doc_id for r in kept if not r.text} == {60}  # null and empty texts are equal
    assert all(r.key == "k" and r.n == "n" for r in kept)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "text"]
    assert {r.text for r in out.filter("doc_id = 60").collect()} <= {""}
