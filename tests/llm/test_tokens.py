"""Token files and packing: exact round trips against the tokenizer itself."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from surveykit.llm import bpe, packing, token_files

TEXTS = [None, "", " ", "One two  three.\n\nFour", "don't <|endoftext|> stop<|startoftext|>", "é ̈ß İx\x85y\x1cz", "日本 😀" * 40, "word " * 3000, "\n x\n", "same", "same"]


def ids_of(name, texts, end):
    t = Tokenizer.from_file(bpe.public_vocabulary(name))
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_equal_whole_texts():
    r = random.Random(5)
    signs = ["a", "B", "é", " ", "  ", "\n", "\t", "1", ".", "'s", "́", "Σ", "日", "<|", "|>", "_", " '", "\xa0", "²"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(20))) for _ in range(3000)] + [t or "" for t in TEXTS]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        table, whole = bpe.PieceTable(bpe.public_vocabulary(name)), Tokenizer.from_file(bpe.public_vocabulary(name))
        for text in texts:
            assert np.frombuffer(table.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_codes_round_trip():
    r = random.Random(2)
    for n in (0, 1, 3, 4, 5, 1001):
        values = np.array([r.choice([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]) for _ in range(n)], "<u4")
        control, data = token_files.pack_values(values)
        assert (token_files.unpack_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == values).all()


def test_token_files(spark, docs_of, tmp_path):
    texts = TEXTS * 3
    rows = [(None if k == 7 else 40 if k in (20, 21) else 3 * k, t, "s") for k, t in enumerate(texts)]
    docs = docs_of(rows).repartition(3)
    folder = f"file:{tmp_path}/ids"
    sizes = token_files.write_token_files(docs, folder, bpe.public_vocabulary("word_bpe_49k.json"), 2, 49_408, file_ids=900)
    back = token_files.read_token_files(spark, folder, sizes).collect()
    want = ids_of("word_bpe_49k.json", texts, 2)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids) for r in back) == sorted((d is not None, d or 0, np.array(i, "<u4").tobytes()) for (d, _, _), i in zip(rows, want, strict=True))
    at = 0
    ordered = sorted(back, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known)
    empty = token_files.write_token_files(docs.limit(0), f"{folder}0", bpe.public_vocabulary("word_bpe_49k.json"), 2, 49_408)
    assert token_files.read_token_files(spark, f"{folder}0", empty).count() == 0


def test_first_fit_decreasing():
    r = random.Random(4)
    for _ in range(50):
        sizes = [r.randint(1, 50) for _ in range(r.randrange(1, 80))]
        bins, places = packing.first_fit_decreasing(sizes, 50)
        free = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            at = next((b for b, f in enumerate(free) if f >= sizes[k]), len(free))
            if at == len(free):
                free.append(50)
            assert (bins[k], places[k]) == (at, 50 - free[at])
            free[at] -= sizes[k]


def check_pieces(pieces, want, room):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc, ids in want.items():
        at = 0
        for p in sorted(by_doc.pop(doc), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length])) and p.length > 0
            at += p.length
        assert at == len(ids)
    assert not by_doc
    for held in by_sequence.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= room
    return len(by_sequence)


def test_packing(docs_of):
    r = random.Random(3)
    texts = TEXTS + [" ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randrange(400))) for _ in range(150)]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    pieces = packing.pack(docs_of(rows), bpe.public_vocabulary("byte_bpe_50k.json"), 1, room=256, group=60).collect()
    want = dict(enumerate(ids_of("byte_bpe_50k.json", texts, 1)))
    used = check_pieces(pieces, want, 256)
    total = sum(map(len, want.values()))
    assert used * 256 <= 1.05 * total + 3 * 256
    assert packing.pack(docs_of([]), bpe.public_vocabulary("byte_bpe_50k.json"), 1).count() == 0
    odd = packing.pack(docs_of([(None, "a b", "s"), (1, "x", "s"), (1, "x", "s")]), bpe.public_vocabulary("byte_bpe_50k.json"), 1).collect()
    assert sorted((p.doc_id is None, p.length) for p in odd) == [(False, 2), (False, 2), (True, 3)]


def test_packing_a_group_gives_back_the_table_of_pieces():
    import pandas as pd

    bpe.open_table(bpe.public_vocabulary(packing.VOCABULARY)).ids("some words that a worker keeps")
    assert bpe._OPEN
    got = packing.packed((3,), pd.DataFrame({"doc_id": [7, 8], "doc_tokens": [5, 20], "crcs": [[1], [2, 3]], "deal": [0, 1]}), 16)
    assert not bpe._OPEN
    assert sorted(got[["doc_id", "start", "length", "offset"]].values.tolist()) == [[7, 0, 5, 0], [8, 0, 16, 0], [8, 16, 4, 5]]
