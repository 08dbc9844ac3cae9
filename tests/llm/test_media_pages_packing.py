"""Media and archives by exact round trips, pages by fixtures, packing by its constraints, classifiers by held-out rows."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.llm import langid, pagediff, toxicity, warc
from quillon.llm import matroska as mkv
from quillon.llm.pack import pack, plan
from quillon.llm.pagediff import MAIN, common, extract, lines

TOKENIZERS = pytest.importorskip("public_tokenizers")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000), st.sampled_from([mkv.NO_LACING, mkv.XIPH, mkv.FIXED, mkv.EBML_LACING]))
def test_media_round_trip(data, lacing):
    whole = mkv.padded(data)
    assert len(whole) % mkv.FRAME == 0 and len(whole) >= mkv.FRAME and whole.startswith(data)
    media = mkv.parse(mkv.write(whole, lacing or mkv.FIXED))
    assert mkv.payload(mkv.write(whole, lacing or mkv.FIXED), media) == whole
    assert [p.timestamp_ns for p in media.packets] == [24_000_000 * i for i in range(len(media.packets))]
    assert media.tracks[0]["codec"] == "A_PCM/INT/LIT"


@pytest.mark.parametrize("lacing", [mkv.XIPH, mkv.EBML_LACING])
def test_uneven_lacing_and_unknown_sizes(lacing):
    frames = [bytes([i]) * n for i, n in enumerate((3, 700, 255, 0, 64, 9))]
    body = mkv.element(mkv.TIMECODE, b"\x05") + mkv.element(mkv.GROUP, mkv.element(mkv.BLOCK, mkv.block(2, -3, frames, lacing)))
    data = mkv._HEAD + mkv._id(mkv.SEGMENT) + b"\xff" + mkv._id(mkv.CLUSTER) + b"\x01" + b"\xff" * 7 + body + mkv.element(mkv.CUES, b"")
    media = mkv.parse(data)
    assert [data[p.offset : p.offset + p.size] for p in media.packets] == frames
    assert media.packets[0].timestamp_ns == 2_000_000 and media.packets[0].track == 2


def test_damaged_media(spark):
    good = mkv.write(mkv.padded(b"abc"))
    for bad in (b"", b"\x00", good[:-9], b"text" * 9):
        with pytest.raises(ValueError):
            mkv.parse(bad)
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(good[:-9]))]
    got = mkv.packet_table(spark.createDataFrame(rows, "doc_id bigint, media binary")).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got if r["size"] is not None) == [(1, 192)] and {r["doc_id"] for r in got} == {1, 3}


def test_media_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 192), (None, "é" * 100_000), (3, "x" * 192)]
    got = mkv.store_media(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["n_bytes"], r["payload_bytes"]) for r in got) == [(0, 192), (0, 192), (192, 192), (192, 192), (200_000, 200_064)]
    assert all(zlib.crc32(mkv.payload(bytes(r["media"]), mkv.parse(bytes(r["media"])))[-16:]) == r["tail_crc32"] for r in got)
    assert len({r["feature"] for r in got if r["n_bytes"] == 192}) == 1


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", None), (3, None, "<p>é</p>"), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "<p>é</p>"), (None, "u", "alone"), (5, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    root = f"file://{tmp_path}/w"
    back = warc.archive_pages(pages, path=root)
    got = sorted((str(r["page_id"]), r["record_type"], r["payload_bytes"], r["refers_to"], bytes(r["content"]).decode()) for r in back.collect())
    assert [(g[0], g[1], g[2]) for g in got] == [("1", "response", 9), ("2", "response", 0), ("3", "revisit", 9), ("4", "revisit", 0), ("5", "response", 300_000), ("5", "response", 300_000), ("None", "response", 5), ("None", "revisit", 9)]
    assert {r["payload_digest"] for r in back.where("page_id in (1, 3)").collect()} == {warc.digest("<p>é</p>".encode())}
    assert warc.read_warc(spark, root).where("record_type = 'revisit'").count() == 3
    assert warc.read_warc(spark, root, types="response", payload="false").where("content is null").count() == 5
    assert warc.read_warc(spark, root, headers="X-Page-Id=3").count() == 1
    assert warc.archive_pages(pages, min_bytes=9, path=f"{root}2").where("record_type = 'revisit'").count() == 2
    assert warc.archive_pages(pages.limit(0), path=f"{root}3").count() == 0


def test_warc_reads_plain_and_foreign_members():
    import gzip

    a, b = (warc.record([("WARC-Type", t), ("X-Page-Id", "9")], c) for t, c in (("response", b"one\r\n\r\ntwo" * 3000), ("metadata", b"")))
    for data in (a + b, gzip.compress(a) + gzip.compress(b), warc.member(a) + warc.member(b), warc.member(a) + gzip.compress(b) + b):
        found = list(warc.records(io.BytesIO(data)))
        assert [h["warc-type"] for _, h, _ in found][:2] == ["response", "metadata"] and found[0][2] == b"one\r\n\r\ntwo" * 3000
        assert [h["warc-type"] for _, h, _ in warc.records(io.BytesIO(data), lambda h: h["warc-type"] == "metadata")][0] == "metadata"
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(a[:-40])))


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &amp; B</h1><p><b>One\n two<br><p>x&nbsp;y &lt;z<div class="comments"><p>me too</p></div><p>last &am</article><aside>s</aside><footer>f</footer>'


def test_lines():
    assert [t for t, m in lines(PAGE) if m == MAIN] == ["A & B", "One two", "x y <z", "last &am"]
    assert lines(None) == lines("") == [] and [t for t, _ in lines("a < b <p")] == ["a < b"]


@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_subsequence(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    found = common(a, b)
    rest = iter(b)
    assert len(found) == best[-1, -1] and all(a[i] in rest for i in found) and found == sorted(found)


def test_differencing_without_markup(spark):
    page = lambda n: f"<div>Site</div><div>{n} first</div><div>Links</div><div>{n} second</div><div>End</div>"
    rows = [(i, f"http://h/{i}", page(i)) for i in range(1, 5)] + [(9, "http://other/", page(9)), (10, None, None), (4, "http://h/4", page(4))]
    got = sorted(extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "main_text").collect())
    want = [(i, f"{i} first\n\n{i} second") for i in (1, 2, 3, 4, 4)] + [(9, "Site\n\n9 first\n\nLinks\n\n9 second\n\nEnd"), (10, "")]
    assert [tuple(r) for r in got] == want


def test_neighbours_on_hosts_in_several_ranges(spark, monkeypatch):
    """Two pages a section: only the true neighbour shares the section's menu, however many pages the host has."""
    page = lambda h, s, i: f"<div>Site</div><div>Section {h} {s}</div><div>{h} {s} {i} own</div>"
    rows = [(h * 1000 + s * 10 + i, f"http://h{h}/s{s:02}/{i}", page(h, s, i)) for h in range(2) for s in range(20) for i in range(2)]
    rows += [rows[7], (5000, "http://small/1", page(9, 9, 1)), (5001, "http://small/2", page(9, 9, 2))]
    r = random.Random(5)
    rows += [(6000 + i, f"http://h3/{r.randrange(40):06b}", "".join(f"<div>line {r.randrange(12)}</div>" for _ in range(8))) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    got = {}
    for block in (2048, 16, 3, 1):
        monkeypatch.setattr(pagediff, "BLOCK", block)
        got[block] = sorted(tuple(x) for x in extract(pages).select("page_id", "main_text").collect())
        assert [t for d, t in got[block] if d < 5000] == [f"{d // 1000} {d % 1000 // 10} {d % 10} own" for d, _ in got[block] if d < 5000]
        assert got[block] == got[2048]
    assert len(got[2048]) == len(rows)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    r = random.Random(6)
    lengths = {}
    for _ in range(3000):
        n = min(100, int(r.expovariate(1 / 20)) + 1)
        lengths[n] = lengths.get(n, 0) + 1
    for docs, cost in ((None, None), (4, None), (None, 5000), (3, 6000)):
        histogram = {n: c for n, c in lengths.items() if not cost or n * n <= cost}
        runs, count = plan(histogram, 100, docs, cost, rule)
        bins = {}
        placed = {}
        for n, first, many, start, offset in runs.tolist():
            for k in range(many):
                bins.setdefault(start + k, []).append((offset, n))
                placed[n, first + k] = placed.get((n, first + k), 0) + 1
        assert placed == {(n, k): 1 for n, c in histogram.items() for k in range(c)}
        assert len(bins) == count
        for items in bins.values():
            at = 0
            for offset, n in sorted(items):
                assert offset == at
                at += n
            assert at <= 100 and (not docs or len(items) <= docs) and (not cost or sum(n * n for _, n in items) <= cost)
        if not docs and not cost:
            assert count <= sum(n * c for n, c in histogram.items()) / 100 * 1.01 + 1


def test_packing(spark):
    from tokenizers import Tokenizer

    path = TOKENIZERS.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["It's the end", None, "", "word " * 700, "naïve Ωmega 12 !?", "x", "x", "<|endoftext|> y"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b")]
    got = pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), path, max_tokens=256).collect()
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        pieces = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [(r["start"], r["length"], r["ids_crc32"]) for r in pieces] == [(a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes())) for a in range(0, len(ids), 256)]
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in by.values():
        assert all(a[0] + a[1] == b[0] for a, b in zip(sorted(items), sorted(items)[1:], strict=False)) and sum(n for _, n in items) <= 256 and min(items)[0] == 0
    assert pack(spark.createDataFrame([], "doc_id bigint, text string"), path).count() == 0


def test_toxicity_learns_parts_of_words(spark):
    r = random.Random(2)
    clean = ["".join(r.choice("aeioulmnrst") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    rows, labels = [], []
    for i in range(400):
        words = [r.choice(clean) for _ in range(r.randrange(20, 60))]
        if i % 4 == 0:
            words[r.randrange(len(words))] = "zorgwick" + r.choice(["ed", "ing", "er", "ish", "oid"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels[:300], "doc_id bigint, toxic int"), decay=0.1)  # few texts: forget less
    unseen = [(1000, " ".join(clean[:50]) + " zorgwickable"), (1001, " ".join(clean[50:120])), (1002, None), (1003, ""), (None, "zorgwicked")]
    got = {x["doc_id"]: x["toxicity"] for x in toxicity.score_toxicity(spark.createDataFrame(rows[300:] + unseen, "doc_id bigint, text string"), model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400)]) >= 0.97
    assert got[1000] >= 0.5 > max(got[1001], got[1002], got[1003]) and got[None] >= 0.5
    none = toxicity.score_toxicity(spark.createDataFrame(unseen, "doc_id bigint, text string"), None)
    assert none.where("toxicity <> 0").count() == 0


def test_language_codes(spark):
    codes = langid.codewords(5)
    assert min((codes[i] != codes[j]).sum() for i in range(5) for j in range(i)) == 4
    r = random.Random(3)
    stems = {"aa": ["kala", "mata", "nuka"], "bb": ["schrit", "pfost", "zwerg"], "cc": ["ção", "lhe", "nho"]}
    rows = [(i, " ".join(r.choice(stems[lang]) + r.choice("xyz") for _ in range(r.randrange(5, 60))), lang) for i, lang in enumerate(r.choices([*stems], k=240))]
    docs = spark.createDataFrame(rows + [(900, "no label", None), (901, None, "aa")], "doc_id bigint, text string, lang string")
    model = langid.learn(docs.where("doc_id < 160"), per_language=40)
    extra = spark.createDataFrame([(2000, None), (2001, ""), (2002, "12 !?"), (None, "kalax mataz")], "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in langid.identify(docs.where("doc_id < 900").select("doc_id", "text").unionByName(extra), model).collect()}
    assert np.mean([got[d]["lang_pred"] == lang for d, _, lang in rows[160:]]) >= 0.97
    assert all(got[d]["lang_pred"] == "und" and got[d]["lang_score"] == 0 for d in (2000, 2001, 2002)) and got[None]["lang_pred"] == "aa"
    assert langid.learn(docs.limit(0)) is None and langid.identify(extra, None).where("lang_pred <> 'und'").count() == 0
    assert docs.select(F.lit(1)).count() == 242
