"""Seeded odd texts through both codecs, against the libraries."""

import random

import pytest

from agrolith.llm import sentencepiece_codec, token_orc

PARTS = ["a", "B", "the ", " of", "'s", "'LL", "  ", "\n", "\t", "\r\n", "é", "ß", "漢", "字", "🙂", "​", " ", "\x00", "12", "3.5", "_", "--", "!?", "▁", "<s>", "İ", "ﬁ", "é"]


def test_token_ids_of_odd_texts_are_those_of_the_library():
    from tokenizers import Tokenizer

    rng = random.Random(20)
    texts = ["", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14))) for _ in range(8000))]
    spec = token_orc.tokenizer_json()
    tool = token_orc.encoder(spec)
    want = [e.ids + [token_orc.END] for e in Tokenizer.from_str(spec).encode_batch(texts, add_special_tokens=False)]
    for lo in range(0, len(texts), 128):
        flat, at = tool(texts[lo : lo + 128])
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want[lo : lo + 128]


@pytest.mark.parametrize("alphabet", ["abcdefgh+/=0123XYZ", "的一是不了人我在有他这中大来上个国", "ab", "的a", "the quick"])
def test_chunks_of_giants_without_spaces_give_the_pieces_of_the_library(spark, alphabet):
    rng = random.Random(len(alphabet))
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (65, 400, 1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in sentencepiece_codec.encode(df, ["doc_id"], chunk=64).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_codec.model_bytes())
    assert got == {i: sp.encode(t) for i, t in enumerate(texts)}
