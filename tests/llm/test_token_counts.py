"""Texts that hold the model's own space mark."""
import random

import public_tokenizers

from feedloom.llm import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_space_marks_in_texts(spark, documents):
    import sentencepiece

    rng = random.Random(7)
    texts = ["progress \u2581 \u2582 \u2581 done", "\u2581", "\u2581 ", " \u2581", "a\u2581 b", "a \u2581b  \u2581\u2581 c "]
    texts += ["".join(rng.choice(["\u2581", " ", "a", "the", "\u2582", ".", "\n"]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(documents(list(enumerate(texts))), MODEL).collect()}
    assert got == {k: len(model.encode(t)) for k, t in enumerate(texts)}
