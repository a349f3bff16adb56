"""Each opN query over a whole table against plain loops or its SQL: column names, types and values."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from multisift.llm import pii, queries, spm
from test_tables import brute_components, brute_top, links_of
from test_text import WORD, brute_fingerprint, brute_language, brute_spans, groups


@pytest.fixture(scope="module")
def rows(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def result(spark, sf, name, types):
    out = queries.queries()[name](spark, sf)
    assert out.dtypes == types
    return out.collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = queries.queries()[name](spark, sf)
    columns = sorted(got.columns)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = con.sql(queries.oracle_sql()[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_op1(spark, sf, rows):
    least, expected = {}, []
    words = {r.doc_id: WORD.findall(r.text or "") for r in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            least.setdefault(tuple(words[i][k : k + 13]), i)
    for i, w in words.items():
        gone = {p for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        expected.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = result(spark, sf, "op1_substring_dedup", [("doc_id", "bigint"), ("n_words", "bigint"), ("n_removed", "bigint"), ("kept_sha256", "string")])
    assert sorted(map(tuple, got)) == sorted(expected)


def test_op2(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    newest = defaultdict(int)
    for r in pages:
        newest[r.html or ""] = max(newest[r.html or ""], r.page_id)
    expected = []
    for r in pages:
        data, last = (r.html or "").encode(), newest[r.html or ""]
        expected.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), *(("response", None) if last == r.page_id else ("revisit", last))))
    got = result(spark, sf, "op2_warc", [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")])
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_op4(spark, sf, rows):
    got = result(spark, sf, "op4_pii", [("doc_id", "bigint"), *((f"n_{k}", "bigint") for k in pii.BASE), ("base_sha256", "string"), ("spans", "string")])
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and sum(r.n_email for r in got) > 0
    for r in rows:
        spans, out = brute_spans(r.text), by_id[r.doc_id]
        assert [out[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert out.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert [s for s in out.spans.split(",") if s.split(":")[0] in pii.BASE] == [f"{k}:{a}:{b}" for k, a, b in spans]


def test_op5(spark, sf, rows):
    got = result(spark, sf, "op5_quality", [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")])
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)


def test_op6(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    got = result(spark, sf, "op6_top_k", [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")])
    assert sorted(map(tuple, got)) == brute_top([(r.vec_id, r.embedding) for r in vectors])


def test_op7(spark, sf, rows):
    prints = [brute_fingerprint(r.text, 4) for r in rows]
    of = groups(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for r, g in zip(rows, of):
        least[g].append(r.doc_id)
    got = result(spark, sf, "op7_simhash", [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")])
    assert sorted(map(tuple, got)) == sorted((r.doc_id, f"{f:016x}", min(least[g])) for r, f, g in zip(rows, prints, of))


def test_op8(spark, sf):
    vectors = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = result(spark, sf, "op8_embedding_dedup", [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")])
    assert sorted(map(tuple, got)) == sorted(brute_components(vectors, links_of(vectors, 0.93)))


def test_op9(spark, sf, rows):
    got = result(spark, sf, "op9_language_id", [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")])
    brute = brute_language([(r.text, r.lang) for r in rows if r.text and r.lang and zlib.crc32(str(r.doc_id).encode()) % 3 != 1])
    text = {r.doc_id: r.text for r in rows}
    assert len(got) == len(rows)
    # the query keeps the most frequent words and n-grams only, so scores may differ a little, and answers hardly ever
    assert sum(r.lang_pred == brute(text[r.doc_id])[0] for r in got) >= 0.99 * len(got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", text[r.doc_id] or ""))


def test_op10(spark, sf, rows):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)
    got = result(spark, sf, "op10_sentencepiece", [("doc_id", "bigint"), ("n_ids", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")])
    expected = [(r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha((r.text or "").replace("\u2581", " "))) for r in rows for ids in [processor.encode(r.text or "")]]
    assert sorted(map(tuple, got)) == sorted(expected)
