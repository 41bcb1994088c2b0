"""Quality rules, mixing, licences and the archive beside plain Python."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from casebook.compare import duck, rows_of
from surveykit.llm import licences, mixing, quality, registry, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
registry.load_all()


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("driver tables are not here")
    return duck(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cur = con.execute(registry.SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    at = {p for k, x in enumerate(wins) if wins.count(x) > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(at) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(at), failed


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a a a a a a a", "x\n\nx\n x\ny\x0bz\x0cq\r\nx",
    "the cat sat on the mat and it was the best of all days that we had with them there", "    \U0001f600 é ß",
    "the | of | and | to | in | is | it | be | as | at | by", "k " * 3000, " ".join(f"w{k} of" for k in range(5000)),
]


def test_quality_counts(docs_of):
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_rules(docs_of(TEXTS)).select("doc_id", *quality.COUNTS, "base_failed").collect()}
    short = {k: t for k, t in enumerate(TEXTS) if t is None or len(t) < 9000}
    assert {k: got[k] for k in short} == {k: plain_counts(t) for k, t in short.items()}
    assert got[11][0] == 3000 and got[11][4] == 3000 and got[12][0] == 10000 and got[12][4] == 0


def test_quality_keeps_columns_and_empty_tables(docs_of):
    docs = docs_of(TEXTS)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [8, 12]
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_mix(docs_of):
    r = random.Random(1)
    rows = [(k, " ".join(["w"] * r.randrange(1, 40)), f"s{min(k % 7, 4)}" if k % 11 else None) for k in range(3000)]
    rows += [(9000, None, "empty"), (9001, "", "empty"), (None, "lost words", "s0"), (5, "same id", "s1"), (5, "same id", "s1")]
    docs = docs_of(rows)
    mixed = mixing.mix(docs)
    assert mixed.where("copies > 2").count() == 0
    by = mixed.groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("taken")).collect()
    total = sum(x.n for x in by)
    assert sum(x.target for x in by) == pytest.approx(1.5 * total)
    for x in by:
        assert x.target <= 2 * x.n and abs(x.taken - x.target) <= 0.03 * x.n
    names = sorted((x.source for x in by), key=lambda s: (s is None, s))
    level = {x.source: x.target / (3, 1, 2)[names.index(x.source) % 3] for x in by if x.target < 2 * x.n}
    assert max(level.values()) == pytest.approx(min(level.values()))
    assert mixing.emit(docs).count() == mixed.agg(F.sum("copies")).first()[0] and mixing.emit(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0


def test_licences(docs_of):
    texts = [None, "", "MIT", "prose\nReleased under the MIT License.\nmore", "LICENSED under the apache license version 2.0!", "All rights reserved", "Released under the MIT License.\nReleased under the MIT License."]
    texts.append(licences.TEMPLATES["mit-notice"].replace(" to any ", "\nto any ").replace("without limitation ", ""))
    got = {r.doc_id: (r.licence, r.n_units) for r in licences.scan_licences(docs_of(texts)).collect()}
    # a text without a blank line is a paragraph too
    assert got == {0: (None, 0), 1: (None, 0), 2: (None, 0), 3: ("mit", 2), 4: ("apache-2.0", 1), 5: ("all-rights-reserved", 1), 6: ("mit", 3), 7: ("mit-notice", 2)}
    wrapped = texts[7].replace("\n", " ")
    assert licences.scan_licences(docs_of([f"a\n\n{texts[7]}\n\nb", wrapped])).select("licence").distinct().first()[0] == "mit-notice"
    assert licences.scan_licences(docs_of([])).count() == 0


def test_archive_round_trip(spark, tmp_path):
    long, wide = "long payload " * 100, "é" * 600
    rows = [(1, "http://a", long), (2, None, long), (3, "http://b\r\nX: y", "short"), (4, "", "short"), (5, "http://c", None), (6, "u", ""), (7, "u", wide), (8, "u", wide), (None, "n", long), (2, "again", long)]
    pages = spark.createDataFrame([(*r, "k", "h") for r in rows], "page_id long, url string, html string, key string, head string")
    warc.write_archive(pages, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 4
    seen = sorted(warc.read_archive(spark, str(tmp_path / "w")).collect(), key=lambda r: r.head)
    assert len(seen) == len(rows)
    for r in seen:
        head, _, rest = r.record.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(r.payload).hexdigest()
        assert rest.endswith(r.payload + b"\r\n\r\n") == (fields["WARC-Type"] == "response") or not r.payload
    kinds = sorted((r.head.split("<urn:x-page:")[1].split(">")[0], warc_type(r.head)) for r in seen)
    assert kinds == sorted([("1", "revisit"), ("2", "response"), ("2", "response"), ("3", "response"), ("4", "response"), ("5", "response"), ("6", "response"), ("7", "revisit"), ("8", "response"), ("none", "revisit")])


def warc_type(head):
    return head.split("WARC-Type: ")[1].split("\r\n")[0]


def test_archive_notices_changed_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    spark.read.parquet(str(tmp_path / "w" / "payloads")).withColumn("payload", F.encode(F.lit("changed"), "UTF-8")).write.parquet(str(tmp_path / "x" / "payloads"))
    spark.read.parquet(str(tmp_path / "w" / "records")).write.parquet(str(tmp_path / "x" / "records"))
    with pytest.raises(Exception, match="payload lost or changed"):
        warc.read_archive(spark, str(tmp_path / "x")).collect()
