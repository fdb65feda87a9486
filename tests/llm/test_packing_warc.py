"""Packing and WARC: exact round trips and bounds."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect, same

from lumenlog.llm import packing, warc


def test_ids_equal_the_tokenizer(spark):
    path = packing.default_tokenizer()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["", " ", "Don't we'll 'S x_a__b 3²½ İx Σας ß <|endoftext|> a b á ﬁ ª º 12,5 a­b µ ÀÈ’s x\x1cy x\x85y ǅ ŉ", "'s.'s ''s a'sb don''t ...!!! _'re", "漢字 😀 x", "é́", "ÀÉÎ ŐŰ ſ ĸ", "\u212a \u1e9e \u212b \u1e9eß", "x\u2003y\u3000z a\x0bb c\xa0d"]
    rng = random.Random(1)
    texts += ["".join(rng.choice("aB1é'_.,! \n\t%sſß") for _ in range(60)) for _ in range(300)]
    for t, raw in zip(texts, packing.ids_of(texts, path), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("size", [2048, 64])
def test_packing(docs, size):
    path = packing.default_tokenizer()
    rows = packing.pack(docs, path, size).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = Counter()
    for (doc, _), raw in zip(texts, packing.ids_of([t for _, t in texts], path), strict=True):
        raw += b"\0\0\0\0"
        for k in range(0, len(raw), 4 * size):
            want[doc, k // 4 // size, k // 4, len(raw[k : k + 4 * size]) // 4, zlib.crc32(raw[k : k + 4 * size])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    assert len(bins) <= -(-sum(r.length for r in rows) // size) * 1.1 + 1


def test_a_full_memo_changes_nothing(monkeypatch):
    path = packing.default_tokenizer()
    texts = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + k % 26)} {chr(233)}{k}x" for k in range(i, i + 30)) for i in range(40)] + ["漢字 worda", ""]
    want = list(packing.ids_of(texts, path))
    monkeypatch.setattr(packing, "MEMO", 25)
    assert [raw for t in texts for raw in packing.ids_of([t], path)] == want


def test_packing_of_an_empty_table(empty):
    assert packing.pack(empty, packing.default_tokenizer()).count() == 0


def test_plan_packs_all_and_tightly():
    rng = random.Random(4)
    for size in (10, 100, 2048):
        counts = Counter(min(size, 1 + int(rng.expovariate(3 / size))) for _ in range(3000))
        bins = packing.plan(counts, size)
        packed = Counter()
        for times, lengths in bins:
            assert sum(lengths) <= size
            for n in lengths:
                packed[n] += times
        assert packed == counts
        assert sum(t for t, _ in bins) <= -(-sum(n * c for n, c in counts.items()) // size) * 1.01 + 1


def test_two_replace_the_smallest():
    # 6 + 3 leave a gap of 1; 2 + 2 fit the widened gap of 4 exactly
    bins = packing.plan({6: 1, 3: 1, 2: 2}, 10)
    assert sorted(map(sum, (x for _, x in bins)), reverse=True)[0] == 10


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + "x" * 2000, "<p>" + "ä" * 600
    rows = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u4", ""), (5, "u5", "small"), (6, "u6", "small"), (7, "u\r\n7", other), (8, "u8", other), (9, "u9", other), (10, "u10", "y" * 999), (11, "u11", "y" * 999), (12, "u12", "z" * 1000), (13, "u13", "z" * 1000), (14, "u14", "\r\n\r\n" * 400)]
    return spark.createDataFrame([(*r, "text") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)


def test_warc_round_trip(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    want = {r.page_id: r.html or "" for r in pages.collect()}
    assert set(got) == set(want)
    best = {}
    for i, h in want.items():
        if len(h.encode()) >= 1000:
            best[h] = max(best.get(h, 0), i)
    for i, h in want.items():
        r, top = got[i], best.get(h, i)
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), hashlib.sha1(h.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if top == i else ("revisit", top))
        assert r.html == (h if top == i else None)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("*.warc.gz"))
    assert raw.count(b"WARC/1.1\r\n") == len(want) and not (tmp_path / "w" / "_tmp").exists()


def test_warc_pushes_header_predicates(spark, pages, tmp_path):
    path = str(tmp_path / "w")
    warc.write_warc(pages, path)
    r = warc.read_warc(spark, path).where("record_type = 'revisit' and page_id > 1 and page_id in (1, 7, 8, 12)")
    assert {x.page_id for x in r.collect()} == {7, 8, 12}
    assert not re.search(r"\bFilter \(", r._jdf.queryExecution().executedPlan().toString())  # all of it went down
    heads = warc.read_warc(spark, path, payload=False)
    assert heads.where("html is not null").count() == 0 and heads.count() == 14


def test_warc_reports_broken_records(spark, pages, tmp_path):
    path = tmp_path / "w"
    warc.write_warc(pages, str(path))
    f = next(path.glob("*.warc.gz"))
    f.write_bytes(f.read_bytes()[:-30] + b"\0" * 10)
    with pytest.raises(Exception):
        warc.read_warc(spark, str(path)).collect()


def test_warc_of_an_empty_table(spark, pages, tmp_path):
    warc.write_warc(pages.where("1 = 0"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_warc_equals_its_sql(spark, sf):
    same(warc.op10(spark, sf), connect(sf), warc.SQL["op10_warc"])
