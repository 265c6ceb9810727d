"""Every operator and stage on tables with odd rows, very long texts, repeated rows, clashing names, and on empty ones."""

from __future__ import annotations

import public_tokenizers
import pytest
from test_llm import ODD, table

BYTES = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
LONG = ["w%d " * 40_000 % tuple(range(40_000)), "again and again " * 15_000, "line of words\n" * 4_000, "9" * 20_000, "é漢" * 30_000]
BENCH = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "one two"), (3, None), (4, "")]


def bench(spark, rows=BENCH):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def labels(spark):
    return spark.createDataFrame([(k, k % 2, None) for k in range(12)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")


def _language(docs):
    from leadweave.llm import langid

    return langid.identify(docs, langid.fit([("the cat sat on the mat", "en"), ("der hund lag auf dem bett", "de")]))


def _operators():
    from leadweave.llm import bpe, decontamination, gam, jaccard, lines, pii, quality, repeats, resampling, simhash, token_files

    return {
        "op1": (pii.find, True),
        "op2": (_language, True),
        "op3": (lines.dedup, True),
        "op4": (simhash.near_duplicates, True),
        "op5": (lambda d: decontamination.contaminated(d, bench(d.sparkSession)), False),
        "op5_clean": (lambda d: decontamination.clean(d, bench(d.sparkSession)), False),
        "op6": (quality.judge, True),
        "op6_filter": (quality.filter_documents, False),
        "op7": (lambda d: bpe.digests(d, *BYTES), True),
        "op7_rows": (lambda d: bpe.encode_rows(d, *BYTES), True),
        "op8": (lambda d: gam.classify(d, labels(d.sparkSession)), True),
        "op9": (lambda d: token_files.round_trip(d.where("doc_id is not null").dropDuplicates(["doc_id"]), public_tokenizers.path("word_bpe_49k.json")), False),
        "op10": (repeats.remove_repeats, True),
        "op11": (lambda d: resampling.resample(d, bench(d.sparkSession)), True),
        "op13": (jaccard.similar_documents, True),
        "keep_first": (simhash.keep_first, False),
    }


@pytest.mark.parametrize("name", sorted(_operators()))
def test_odd_rows_and_empty_tables(spark, name):
    operator, every = _operators()[name]
    rows = [*enumerate(ODD), *enumerate(LONG, 100), (100, LONG[0]), (None, None), (None, "one two three"), (3, "one"), (3, "one")]
    docs = table(spark, rows).repartition(3)
    found = operator(docs)
    assert len({c.lower() for c in found.columns}) == len(found.columns)
    n = found.count()
    assert n == len(rows) if every else 0 < n <= len(rows)
    none = operator(docs.where("false"))
    assert none.isEmpty() and [f.dataType for f in none.schema] == [f.dataType for f in found.schema] and none.columns == found.columns


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    rows = [*enumerate(ODD), *enumerate(LONG, 100), (100, LONG[0]), (None, None), (3, "one")]
    bench(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.where("false")):
            found = stage(spark, given, str(tmp_path))
            assert found.count() <= given.count(), name
            assert name == "encode" or found.columns == given.columns, name
