"""WARC, search and embedding operators against brute force."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest

from multisift.llm import embed_dedup, topk, warc

PAGES = "page_id long, url string, html string, payload string, digest string, path string"


def pages():
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    rows += [(100, "http://n", None), (101, None, ""), (102, "bad\r\nurl", "é" * 50_000), (None, "u", "<p>1</p>"), (None, "u", "only"), (103, "v", "WARC/1.1\r\n\r\nx"), (104, "r", "rep"), (104, "r", "rep")]
    return [(*r, "a", "b", "c") for r in rows]


@pytest.mark.parametrize("least", [0, 20])
def test_warc_round_trip(spark, least):
    expected = []
    for i, _, h, *_ in pages():
        data = (h or "").encode()
        same = [j for j, _, g, *_ in pages() if (g or "").encode() == data and j is not None]
        newest = max(same, default=None) if len(data) >= least else None
        refers = newest if newest is not None and i != newest else None
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    frame = spark.createDataFrame(pages(), PAGES).repartition(3)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(frame, least).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_payloads_come_back(spark, tmp_path):
    folder = f"file://{tmp_path}/a"
    warc.write_archives(spark.createDataFrame(pages(), PAGES).repartition(2), folder, archive_bytes=2000)
    got = [r for r in warc.read_archives(spark, folder).collect() if r.record_type == "response"]
    assert len({r.path for r in got}) > 2 and {bytes(r.payload).decode() for r in got} == {r[2] or "" for r in pages()}


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage(zipped):
    rng = random.Random(4)
    plain = [warc.record(i, f"http://x/{i}", rng.randbytes(400)) for i in range(12)]
    parts = [warc.compressed(x) if zipped else x for x in plain]
    broken = bytearray(parts[3])
    broken[len(broken) // 2] ^= 0xFF
    data = b"junk" + b"".join(parts[:3]) + bytes(broken) + parts[4] + parts[5][:200] + b"".join(parts[6:11]) + parts[11][:-30]
    out = list(warc.salvage(data))
    ids = [warc._page(h["warc-record-id"]) for _, _, h, _, _ in out if h]
    assert ids == [0, 1, 2, 4, 6, 7, 8, 9, 10]
    gaps = [(a, n) for a, n, h, _, _ in out if h is None]
    assert len(gaps) == 4 and gaps[0] == (0, 4) and sum(n for _, n in gaps) + sum(len(parts[i]) for i in ids) == len(data)
    assert list(warc.salvage(b"")) == [] and len(list(warc.salvage(b"WARC/1.1\r\n"))) == 1


def test_archives_are_read_through_a_window(monkeypatch, spark, tmp_path):
    """Long headers, records and gaps across many small windows; markers that straddle two; empty archives and folders."""
    monkeypatch.setattr(warc, "_WINDOW", 37)
    rng = random.Random(5)
    plain = [warc.record(i, "http://x/" + "y" * rng.choice([1, 3000]), rng.randbytes(rng.choice([0, 10, 5000]))) for i in range(20)]
    for parts in (plain, [warc.compressed(x) for x in plain]):
        data = b"".join(p + rng.randbytes(rng.choice([0, 50])).replace(b"\x1f", b"").replace(b"W", b"") for p in parts)
        assert [warc._page(h["warc-record-id"]) for _, _, h, _, _ in warc.salvage(data) if h] == list(range(20))
    assert len(list(warc.salvage((warc.VERSION + b"x") * 400))) == 1
    (tmp_path / "b c").mkdir()
    (tmp_path / "b c" / "empty.warc.gz").write_bytes(b"")
    assert warc.read_archives(spark, f"{tmp_path}/b c").collect() == []
    (tmp_path / "b c" / "one.warc").write_bytes(plain[0] + b"rest")
    assert [r.gap for r in warc.read_archives(spark, f"{tmp_path}/b c").collect()] == [None, "no version line"]


def test_several_records_in_a_member():
    plain = [warc.record(i, "u", b"p") for i in range(3)]
    data = warc.compressed(plain[0] + plain[1][:-20] + plain[2])
    out = list(warc.salvage(data))
    assert [h and h["warc-record-id"] for _, _, h, _, _ in out] == ["<urn:x-page:0>", "<urn:x-page:2>", None]


VECTORS = "vec_id long, embedding array<float>, label int, x string, dim string, shard string"


def vectors(n=700, width=12, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, width))
    rows = [(i, [float(np.float32(v)) for v in (base[i % 40] + rng.normal(size=width) * (0.08 if i % 3 else 1))], i % 4) for i in range(n)]
    rows += [(n + i, rows[8][1], 0) for i in range(60)]  # copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * width, 1), (2003, [float("nan")] * width, 1), (2004, [None] * width, 1), (2005, rows[5][1], None), (None, rows[8][1], 0), (2006, rows[5][1][:3], 1), (2100, rows[4][1], 0), (2100, rows[4][1], 0), (2200, [float("inf")] * width, 2)]
    return [(*r, "a", "b", "c") for r in rows]


def brute_top(rows, k=10, every=100):
    """The query's answers over (vec_id, vector) pairs, with Python's integers."""
    ok = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for n, (q, a) in enumerate(ok):
        if q % every == 0:
            scores = sorted((-max(min(sum(u * v for u, v in zip(a, b)), 2**63 - 1), -(2**63)), i) for m, (i, b) in enumerate(ok) if m != n and len(a) == len(b))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"shard_values": 1100}])
def test_top_k(spark, sizes):
    rows = vectors()
    rows += [(4000, [3e30] * 12, 0, "", "", ""), (4100, [-70000.0] * 11 + [1e9], 0, "", "", ""), (100, rows[3][1], 1, "", "", "")]  # beyond doubles and longs; a repeated id
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    with_floats = [(r[0], None if r[1] is None else [None if v is None else float(np.float32(v)) for v in r[1]]) for r in rows]
    assert sorted(map(tuple, topk.top_k(frame, **sizes).collect())) == brute_top(with_floats)
    assert topk.top_k(spark.createDataFrame([], VECTORS)).collect() == []
    assert len(topk.top_k(frame.where("vec_id IN (200, 300, 7)")).collect()) == 4


def test_top_k_does_not_depend_on_partitions(spark):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(np.float32(np.random.default_rng(3).normal(size=(900, 8))))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected = brute_top(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 6, 31):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(map(tuple, topk.top_k(frame, shard_values=800).collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def links_of(rows, cosine):
    """All pairs of rows (vec_id, vector, label) that link, by position."""
    by = {}
    for k, (i, v, label, *_) in enumerate(rows):
        if i is not None and label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            by.setdefault((label, len(v)), []).append((k, np.array(v, np.float64)))
    pairs = set()
    for some in by.values():
        x = np.stack([v for _, v in some])
        n = (x * x).sum(1)
        near = x @ x.T / np.sqrt(np.outer(n, n)) >= cosine
        pairs |= {(some[a][0], some[b][0]) for a, b in zip(*np.nonzero(np.triu(near, 1)))}
    return pairs


def brute_components(rows, pairs):
    """(vec_id, n_links, component_id, kept) of each row."""
    near = [set() for _ in rows]
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()] - group:
                group.add(m)
                todo.append(m)
        seen |= group
        least = min((rows[m][0] for m in group if rows[m][0] is not None), default=None)
        for m in group:
            out[m] = (rows[m][0], len(near[m]), least, rows[m][0] == least)
    return out


@pytest.mark.parametrize("few,block", [(4096, 512), (3, 7)])
def test_embedding_dedup(spark, monkeypatch, few, block):
    """Pairs as rows, and all keys and components as grids of many cells; ids that repeat with other labels and vectors."""
    monkeypatch.setattr(embed_dedup, "_FEW", few)
    monkeypatch.setattr(embed_dedup, "_BLOCK", block)
    rows = vectors()
    rows += [(5000, rows[8][1], 0, "", "", ""), (5000, rows[8][1], 1, "", "", ""), (5000, rows[9][1], 0, "", "", ""), (5001, [v * 3 for v in rows[9][1]], 0, "", "", "")]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), tables=40, probes=6).collect()
    rows = [(r[0], None if r[1] is None else [None if v is None else float(np.float32(v)) for v in r[1]], r[2]) for r in rows]
    expected = brute_components(rows, links_of(rows, 0.93))
    assert sorted(map(str, expected)) == sorted(str((r.vec_id, r.n_links, r.component_id, r.kept)) for r in got)
    assert embed_dedup.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


@pytest.mark.parametrize("width,size,noise", [(64, 20, 0.24), (64, 2, 0.26), (64, 400, 0.2), (16, 10, 0.26), (8, 5, 0.25), (200, 6, 0.26)])
def test_embedding_recall(spark, width, size, noise):
    """With the query's parameters: at least nine of ten links that brute force finds, and none that it doesn't."""
    rng = np.random.default_rng(width + size)
    base = rng.normal(size=(1200 // size, width))
    x = np.float32(np.repeat(base, size, 0) + rng.normal(size=(1200 // size * size, width)) * noise)
    rows = [(i, [float(v) for v in r], i // 400) for i, r in enumerate(x)]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()
    true = links_of(rows, 0.93)
    found = sum(r.n_links for r in got) / 2
    print("recall", width, size, found, len(true))
    assert len(true) > 300 and 0.9 * len(true) <= found <= len(true)


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose((embed_dedup.hadamard(x) ** 2).sum(1), (x**2).sum(1)) and np.allclose(embed_dedup.hadamard(embed_dedup.hadamard(x)), x)
