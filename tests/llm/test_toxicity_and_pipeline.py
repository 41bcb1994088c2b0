"""Held-out accuracy of the toxicity score, and each pipeline stage on the rows of the stage before it."""

import random
import zlib

import pytest

import corpus_pipeline
from surveykit.llm import packing, quality, toxicity
from surveykit.llm.bpe import public_vocabulary

from .test_duplicates import brute_components
from .test_tokens import check_pieces, ids_of

PLAIN = "the river runs past old stone houses where people talk about weather and bread every morning".split()
RUDE = "brimgob snortle vexpig".split()
DISGUISED = ["br1mgob", "sn0rtl3", "v3xp1g", "brrrimgob", "s n o r t l e", "v.e.x.p.i.g", "vexpiiiig"]


def spoken(r, n=40):
    return [r.choice(PLAIN) for _ in range(n)]


@pytest.fixture(scope="module")
def talk():
    r = random.Random(11)
    rows, labels = [], []
    for k in range(900):
        text, toxic = spoken(r), int(k % 4 == 0)
        if toxic:
            for _ in range(2):
                text.insert(r.randrange(len(text)), r.choice(RUDE))
        rows.append((k, " ".join(text), "s"))
        labels.append((k, toxic))
    for k, sign in enumerate(DISGUISED * 3):
        rows.append((2000 + k, " ".join([*spoken(r), sign, *spoken(r, 5), DISGUISED[k % 5]]), "s"))
    rows += [(3000, "", "s"), (3001, None, "s"), (None, "the river", "s"), (3002, "call 555-1234, a b c d or x1y2z3 at 10:30!!! www.site-7.org", "s"), (5, "twice", "s"), (5, "twice", "s")]
    return rows, labels


def test_toxicity(spark, docs_of, talk):
    rows, labels = talk
    marks = spark.createDataFrame([(*x, 1) for x in [*labels, (None, 1), (1, None)]], "doc_id long, toxic int, text int")
    out = toxicity.toxicity_scores(docs_of(rows), marks).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for doc, _, _ in rows:
        if doc is not None:
            assert got[doc].held_out == (zlib.crc32(str(doc).encode()) % 3 == 1)
    held = [(got[d], t) for d, t in labels if got[d].held_out and d != 5]
    assert held and all((g.score >= 0.7) == bool(t) == bool(g.predicted) for g, t in held)
    assert all(got[2000 + k].predicted for k in range(3 * len(DISGUISED)))
    assert not any(got[d].predicted for d in (3000, 3001, 3002, 5))
    assert got[3000].score == got[3001].score and all(0 <= g.score <= 1 for g in out)


def test_toxicity_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity_scores(docs_of(["a", None]), none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity_scores(docs_of([]), none).count() == 0


def test_decoder_reads_noisy_tokens():
    import numpy as np

    seen = toxicity._trigrams(" ".join([*PLAIN * 40, *RUDE * 10]))
    at = np.flatnonzero(seen)
    letters = toxicity.LetterModel(at, seen[at])
    reads = {s: "".join(letters.read(s)) for s in DISGUISED}
    assert reads == {"br1mgob": "brimgob", "sn0rtl3": "snortle", "v3xp1g": "vexpig", "brrrimgob": "brimgob", "s n o r t l e": "snortle", "v.e.x.p.i.g": "vexpig", "vexpiiiig": "vexpig"}


def test_pipeline(spark, docs_of):
    r = random.Random(6)
    mean = ["the", "of", "and", "to", *(f"m{k}" for k in range(3000))]
    text = lambda n: " ".join(r.choice(mean[:4]) if r.random() < 0.3 else r.choice(mean) for _ in range(n))
    shared = text(60)
    rows = [(k, text(r.randrange(30, 200)), f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, f"{text(80)} {shared} {text(40)}", "s0") for k in range(5)]
    rows += [(200 + k, rows[k][1] + " more", "s1") for k in range(10)] + [(300, rows[0][1], None), (301, None, "s1"), (302, "too short", "s2"), (303, "| " * 60, "s0"), (None, text(50), "s0")]
    docs = docs_of(rows)
    steps = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "repeated_passages", "mix_sources", "pack_sequences"]
    good = steps[names[0]](spark, docs, "")
    assert {x.doc_id for x in good.collect()} == {d for d, _, _ in rows} - {301, 302, 303}
    one = steps[names[1]](spark, good, "")
    texts = {x.doc_id: x.text for x in good.collect()}
    order = sorted((d for d in texts if d is not None))
    groups = brute_components([texts[d] for d in order])
    kept = {order[k] for k, (_, c) in groups.items() if c == k}
    assert {x.doc_id for x in one.collect()} == kept | {None}
    cut = steps[names[2]](spark, one, "")
    left = {x.doc_id: x.text for x in cut.collect()}
    assert set(left) == kept | {None} and sum(shared in t for t in left.values()) == 1 and shared in left[100]
    mixed = steps[names[3]](spark, cut, "")
    copies = [x.doc_id for x in mixed.collect()]
    assert max(map(copies.count, copies)) <= 2
    for stage in (good, one, cut, mixed):
        assert stage.columns == docs.columns
    numbered = mixed.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    have = {x.doc_id: x.text for x in numbered.collect()}
    want = dict(zip(have, ids_of(packing.VOCABULARY, have.values(), packing.END), strict=True))
    check_pieces(steps[names[4]](spark, numbered, "").collect(), want, packing.ROOM)
    assert quality.keep_good(docs.limit(0)).count() == 0


def test_pipeline_run(spark, tmp_path, docs_of):
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(["the", "of", "and", f"n{r.randrange(900)}"]) for _ in range(60)), "s") for k in range(30)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {p.length for p in out.collect()} and public_vocabulary(packing.VOCABULARY)
