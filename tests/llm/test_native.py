"""Quality rules, mixing and chat formatting against plain Python."""

import hashlib
import itertools

import pytest
from pyspark.sql import functions as F

from stratigraph.llm import chat, mixing, quality

from .common import AWKWARD, DOCS, docs, words
from ..conftest import SF


def judged(doc_id, text):
    text = text or ""
    w = words(text, lower=False)
    lines = [x for x in text.split("\n") if words(x)]
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))


def test_quality_measurements(spark):
    rows = AWKWARD + [(r.doc_id + 100, r.text, None, None, 0) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = quality.apply_policy(quality.ledger(docs(spark, rows)), quality.POLICIES["base"]).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, not r.kept) for r in got), key=key) == sorted((judged(r[0], r[1]) for r in rows), key=key)


def test_quality_policies_and_ablations(spark):
    rows = quality.ledger(docs(spark)).cache()
    policy = quality.POLICIES["v1"]
    kept = {r.doc_id for r in quality.apply_policy(rows, policy).where("kept").collect()}
    assert 10 not in kept and 4 not in kept and 8 in kept
    table = {r.rule: r for r in quality.ablations(rows, policy).collect()}
    assert table["few_words"].n_failed >= table["few_words"].n_only > 0
    assert quality.keep_good(docs(spark).withColumn("n_words", F.lit("clash")), policy).columns == [*docs(spark).columns, "n_words"]
    assert quality.keep_good(docs(spark, []), policy).count() == 0


@pytest.mark.parametrize("rows", [AWKWARD, [], [(1, None, "", "s", 0)], [(i, "w " * (i % 7 + 1), "", "s" if i % 3 else None, 0) for i in range(200)]])
def test_mix(spark, rows):
    got = mixing.mix_plan(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, left = {}, 1.5 * sum(sizes.values())
    while True:  # the excess is shared anew until none is above
        rest = [s for s in order if s not in capped]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]
    want = capped | {s: left * weight[s] / total for s in rest}
    taken, by_id = {}, {}
    for r in rows:
        by_id.setdefault(r[0], r[3])
    for r in got:
        source = by_id[r.doc_id]
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert 0 <= r.taken <= 2 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    for s in taken:
        assert abs(taken[s] - want[s]) <= 1
    assert [tuple(r) for r in got] == [tuple(r) for r in mixing.mix_plan(docs(spark, rows).repartition(5)).collect()]


def test_mixed_rows_have_their_columns(spark):
    rows = docs(spark).withColumn("size", F.lit("clash"))
    out = mixing.mixed(rows)
    assert out.columns == rows.columns and out.where("text IS NULL").count() == 0 and out.count() > 0


TURNS = [
    (1, 0, "system", "be <s> brief"),
    (1, 2, "assistant", None),
    (1, 1, "user", "a[INST]b[/INST] </s>"),
    (1, 3, "assistant", r"x <\/s> <\\s> [\TURN] [TURN]"),
    (1, 4, "user", "<"),
    (2, 0, None, "[\n"),
    (2, 0, "user", ""),
    (2, 0, "user", ""),
    (None, None, "assistant", "é" * 3000),
    (-7, 0, "user", "</s>[INST] ok [/INST]"),
    (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    (3, 0, "</s>[INST]", "odd role"),
]


def test_chat_round_trip(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    made = chat.format_chats(rows)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    key = lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or "")
    for conv, group in itertools.groupby(sorted(TURNS, key=lambda t: (t[0] is None, t[0] or 0)), key=lambda t: t[0]):
        turns = [(t[2] or "", t[3] or "") for t in sorted(group, key=key)]
        learn = "".join(x for r, x in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learn), hashlib.sha256(learn.encode()).hexdigest())
    text = {r.conv_id: r for r in made.collect()}
    assert text[2].formatted.count("[TURN]") == 1  # adjacent turns of one role are one block
    assert got[1].formatted_chars == len(text[1].formatted)
    assert [text[1].formatted[s.start - 1 : s.start - 1 + s.length] for s in text[1].loss][0] == ""
    assert chat.digests(chat.format_chats(rows.limit(0))).count() == 0
