"""Token counts beside the library's own encoding of whole texts."""

import random

import sentencepiece

from surveykit.llm import token_counts
from surveykit.llm.bpe import public_vocabulary

PATH = public_vocabulary(token_counts.VOCABULARY)
TEXTS = [None, "", " ", "  ", "\n", "a", "a ", " a", "▁", "a▁ b", "x\ny", "x\r\ny", "\t tab", "<s> </s> <unk><0x0A>", "ﬁ ½ é ̈ß İx\x85y\x1cz", "日本 😀" * 40, "word " * 3000, "\x00", "same", "same", "z" * 5000]


def whole(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return [len(model.encode(t or "", num_threads=1)) for t in texts]


def test_pre_tokens_are_counted_apart():
    r = random.Random(5)
    signs = ["a", "B", "é", " ", "  ", "\n", "\t", "\r", "1", ".", "'s", "▁", "日", "the", "😀", "_", "\xa0", "<s>", "**"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(30))) for _ in range(4000)]
    counts = token_counts.open_counts(PATH)
    assert [int(counts.of(token_counts.pre_tokens(t)).sum()) for t in texts] == whole(texts)
    assert "".join(token_counts.pre_tokens("  a\n b")) == "   a\n b" and token_counts.pre_tokens("") == []


def test_counts_of_documents(spark, docs_of):
    r = random.Random(9)
    texts = TEXTS + [" ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(200))) for _ in range(60)]
    rows = [(None if k == 7 else 40 if k in (20, 21) else 3 * k, t, "s") for k, t in enumerate(texts)]
    want = sorted((d is not None, d or 0, len((t or "").encode()), n, n > 40) for (d, t, _), n in zip(rows, whole(texts), strict=True))
    for size in (1, 700, 10**6):
        got = token_counts.count_tokens(docs_of(rows).repartition(3), PATH, limit=40, size=size).collect()
        assert sorted((g.doc_id is not None, g.doc_id or 0, g.n_bytes, g.n_tokens, g.over_limit) for g in got) == want


def test_edges(docs_of):
    empty = token_counts.count_tokens(docs_of([]), PATH)
    assert empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and empty.count() == 0
    text = "long words of a very long text\n" * 40_000
    (got,) = token_counts.count_tokens(docs_of([text]), PATH).collect()
    assert (got.n_bytes, got.n_tokens, got.over_limit) == (len(text), *whole([text]), True)
    assert token_counts.count_tokens(docs_of([None, ""]), PATH).where("n_tokens <> 0 OR over_limit").count() == 0
