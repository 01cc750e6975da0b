import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from stratigraph.llm.piece_bpe import UnitCache, encode_documents, encode_texts, piece_model
from stratigraph.llm.token_counts import counter, parts, token_counts

from . import common

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ROWS = common.AWKWARD + [
    (30, "  two  spaces ▁ mark </s> <s> <0x41>", "", "", 0),
    (31, " " * 1000 + "x" + " " * 333, "", "", 0),
    (32, "é日本語 text 😀\x00\x01 " * 50 + "a" * 999 + "=-" * 400, "", "", 0),
]


def test_encode_decode(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = [tuple(r) for r in encode_documents(common.docs(spark, ROWS), MODEL).collect()]
    want = []
    for r in ROWS:
        ids = library.encode(r[1] or "")
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids))]
        want.append((r[0], len(ids), *sha))
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert encode_documents(common.docs(spark, []), MODEL).count() == 0
    full = encode_documents(common.docs(spark, ROWS), MODEL, with_ids=True).where("doc_id = 30").first()
    assert full.decoded == ROWS[-3][1].replace("▁", " ") and len(full.ids) == full.n_tokens


def test_random_texts_as_the_library():
    model, rng = piece_model(MODEL), random.Random(11)
    texts = ["".join(rng.choice("ab  ▁é\nthe<>ing") for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x3000, 0x3100)])) for _ in range(60)) for _ in range(500)]
    assert [ids for ids, _ in encode_texts(model, texts, UnitCache())] == model.library.encode(texts)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_counts(spark, name):
    path = public_tokenizers.path(name)
    count, drop = counter(path)
    if name.endswith(".model"):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        directly = lambda text: len(library.encode(text))
    else:
        library = tokenizers.Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        directly = lambda text: len(library.encode(text, add_special_tokens=False).ids)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(common.docs(spark, ROWS), public_tokenizers.path(name)).collect()), key=lambda x: (x[0] is None, x))
    want = [(r[0], len((r[1] or "").encode()), directly(r[1] or "")) for r in ROWS]
    assert got == sorted(((*x, x[2] > 4096) for x in want), key=lambda x: (x[0] is None, x))
    text = " ".join(r[1] for r in ROWS if r[1] and len(r[1]) < 5000) * 3
    assert len(parts(text, 100, drop)) > 20 and sum(count(parts(text, 100, drop))) == count([text])[0]
