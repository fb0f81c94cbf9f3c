import public_tokenizers
import pytest

from jestframe.llm import token_count

DOCS = "doc_id long, text string, n_tokens string"
TEXTS = [None, "", " ", "\n\n\t x", "Hello world's  end!!", "a" * 5000, "été naïve 12345 — “ok”", "日本語 テキスト 🙂", "x<|endoftext|>y <|endoftext|>", "nbsp and\u0085nel\x1c", "don't 'sx '' ..."]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(p.encode(t, num_threads=1))
    else:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "null id", ""), (1, "repeated id", ""), (4, TEXTS[4], "")]
    out = token_count.token_counts(spark.createDataFrame(rows, DOCS), path, limit=10, table_size=4, cache_size=3).collect()
    want = sorted((i is None, i or 0, len((t or "").encode()), count(t or ""), count(t or "") > 10) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want


def test_empty_table(spark):
    assert token_count.token_counts(spark.createDataFrame([], DOCS), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
