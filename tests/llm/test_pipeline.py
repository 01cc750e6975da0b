import hashlib

import corpus_pipeline
import public_tokenizers
import sentencepiece

from stratigraph.llm import mixing
from stratigraph.llm.passages import repeated_passages
from stratigraph.llm.quality import RULES

from ..conftest import SF
from . import common
from .test_native import judged


def kept_by_rules(row):
    _, n, chars, symbols, dups, repeats, _ = judged(0, row[1])
    lines = len([x for x in (row[1] or "").split("\n") if common.words(x)])
    upper = sum("A" <= c <= "Z" for c in row[1] or "")
    return eval(" and ".join(f"not ({c.replace(' OR ', ' or ')})" for c in RULES.values()), {"n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dups, "n_repeat_words": repeats, "n_lines": lines, "n_upper": upper})


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    rows = [tuple(r) for r in docs.collect()]

    good = stage["quality_rules"](spark, docs, SF)
    assert good.columns == docs.columns
    rows = [r for r in rows if kept_by_rules(r)]
    assert sorted(tuple(r) for r in good.collect()) == sorted(rows)

    single = stage["near_duplicates"](spark, good, SF)
    assert single.columns == docs.columns
    firsts = {i for i, _, c in common.jaccard_components(rows) if i == c}
    rows = [r for r in rows if r[0] in firsts]
    assert sorted(tuple(r) for r in single.collect()) == sorted(rows)

    cut = stage["substring_dedup"](spark, single, SF)
    assert cut.columns == docs.columns and repeated_passages(cut).count() == 0
    before, after = {r[0]: r[1] for r in rows}, {r.doc_id: r.text for r in cut.collect()}
    spans = {r.doc_id for r in repeated_passages(single).collect()}
    assert all(after[i] == before[i] for i in before if i not in spans) and all(i in spans for i in before if i not in after)

    mix = stage["source_mixing"](spark, cut, SF)
    assert mix.columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.queue(cut).collect()}
    got = [r.doc_id for r in mix.collect()]
    assert {i: got.count(i) for i in copies if copies[i]} == {i: n for i, n in copies.items() if n} and len(got) == sum(copies.values())

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((i, hashlib.sha256(",".join(map(str, library.encode(after[i]))).encode()).hexdigest()) for i in got)
    assert sorted((r.doc_id, r.ids_sha256) for r in stage["sentencepiece"](spark, mix, SF).collect()) == want
    assert sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()) == want


def test_awkward_rows_pass_all_stages(spark):
    docs = common.docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert {r.doc_id for r in docs.collect()} >= {8}
    empty = common.docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
