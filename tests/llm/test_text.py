"""Text operators against brute force on small tables that hold nulls, empty and long texts, copies and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from multisift.llm import common, langid, mixing, pii, quality, queries, simhash, similar, spm, substring_dedup
from multisift.llm.common import Text, connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, batch string, fp string, size string, n string"


def corpus():
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "gämma", "delta,", "ε", "zeta", "eta", "theta"]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    rows = []
    for i in range(80):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 12, 13, 14, 60]))]
        text = rng.choice([" ", "\n", "\t ", "  "]).join(words)
        if i % 4 == 0:
            text += "\n" + passage[: rng.randrange(len(passage))] + rng.choice(["", " x"])
        rows.append((i * 3 % 80, text))
    rows += [(200, None), (201, ""), (202, "  \n"), (203, rows[5][1]), (204, rows[8][1]), (204, rows[8][1]), (None, rows[8][1]), (None, None), (205, "ab " * 3000), (206, "x" * 50_000), (207, passage + " " + passage)]
    return [(i, t, "en", f"s{(i or 0) % 3}" if i != 7 else None, None, "b", "c", "d", "e", "f") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_flat_words():
    texts = ["a bc\n d", None, "", "  é\x0bx ", "last"]
    t = Text(pa.array(texts))
    got = [[t.data[a:b].tobytes().decode() for a, b in zip(t.starts[i:j], t.ends[i:j])] for i, j in zip(t.first[:-1], t.first[1:])]
    assert got == [WORD.findall(x or "") for x in texts]


def test_substring_dedup(docs, none):
    rows = [(r[0], WORD.findall(r[1] or "")) for r in corpus()]
    least = {}
    for i, w in rows:
        for k in range(len(w) - 12):
            key, i_ = tuple(w[k : k + 13]), 1 << 62 if i is None else i
            least[key] = min(least.get(key, i_), i_)
    expected = []
    for i, w in rows:
        gone = {p for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < (1 << 62 if i is None else i) for p in range(k, k + 13)}
        expected.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = substring_dedup.remove_repeats(docs, batch_bytes=500, least_batches=7, least_ranges=20).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got), key=key) == sorted(expected, key=key)
    assert all(sum(s.end - s.start for s in r.removed) == r.n_removed for r in got)
    assert any(r.n_removed for r in got)
    assert substring_dedup.remove_repeats(none).collect() == []


def test_substring_dedup_keeps_words_whose_polynomial_hashes_agree(spark):
    """Words of a and b by the parity of the bits of the place, and the other way round: equal under any polynomial modulo 2 to the 64."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    other = one.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(12)]
    frame = spark.createDataFrame([(1, " ".join([one, *around])), (2, " ".join([other, *around])), (3, " ".join([other, *around]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(frame).collect()} == {1: 0, 2: 0, 3: 13}


def brute_fingerprint(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, linked):
    """The component of each position, by a search over all pairs."""
    seen: dict[int, int] = {}
    for i in range(len(values)):
        if i in seen:
            continue
        todo, seen[i] = [i], i
        while todo:
            a = todo.pop()
            for b in range(len(values)):
                if b not in seen and linked(values[a], values[b]):
                    seen[b] = i
                    todo.append(b)
    return [seen[i] for i in range(len(values))]


def test_simhash(docs, none):
    rows = [(r[0], brute_fingerprint(r[1], 4)) for r in corpus()]
    of = groups([f for _, f in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for (i, _), g in zip(rows, of):
        least[g].append(i)
    expected = [(i, f"{f:016x}", min((x for x in least[g] if x is not None), default=None)) for (i, f), g in zip(rows, of)]
    got = [(r.doc_id, f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(expected, key=key)
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_one(docs).collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(kept[0].asDict()) == set(docs.columns) and sum(r.doc_id is None for r in kept) == 2


@pytest.mark.parametrize("max_bits", [0, 1, 4, 6])
def test_ring_finds_every_link(spark, max_bits):
    rng = random.Random(max_bits)
    x = {rng.getrandbits(64) for _ in range(40)}
    for a in list(x):
        for _ in range(40):  # families that meet at one key, larger and smaller than what is compared pair by pair
            b = a
            for bit in rng.sample(range(64), rng.randrange(max_bits + 3)):
                b ^= 1 << bit
            x.add(b)
    x = sorted(x)
    expected = groups(x, lambda a, b: (a ^ b).bit_count() <= max_bits)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in x], "fp long").repartition(3)
    links = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.fingerprint_links(frame, max_bits, 7).collect()]
    assert all((a ^ b).bit_count() <= max_bits for a, b in links)
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    assert groups(x, lambda a, b: b in near[a]) == expected


def brute_shingles(text, width=5):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(edits, n=60, seed=1):
    """Texts and copies of them with some words changed, between and outside the similarity of 0.8."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        copy = list(words)
        for at in rng.sample(range(len(copy)), max(1, round(edits * len(copy)))):
            copy[at] = f"X{rng.randrange(5000)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy).upper())]
    return rows


def test_similar_documents_are_found(spark, docs, none):
    """Planted copies at similarities from 0.6 to 1, against all pairs; most of those at 0.8 to 0.9 are more than 6 bits apart."""
    rows = [(i + 1000 * k, t) for k, edits in enumerate((0.003, 0.01, 0.016, 0.02, 0.03, 0.05)) for i, t in planted(edits, seed=k)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, rows[0][1]), (9004, "three short words"), (9005, "Three short  words"), (9006, "other short words")]
    sets = [brute_shingles(t) for _, t in rows]
    of = groups(sets, lambda a, b: jaccard(a, b) >= 0.8)
    near = [(jaccard(sets[k], sets[k + 1]), k) for k in range(0, 720, 2)]
    assert sum(0.8 <= s < 0.9 for s, _ in near) > 40 and sum(s < 0.8 for s, _ in near) > 40
    expected = sorted(min(i for (i, _), g in zip(rows, of) if g == h) for h in set(of))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in similar.keep_similar(frame).collect()) == expected
    assert similar.keep_similar(none).collect() == []
    ids = [r.doc_id for r in similar.keep_similar(docs).collect()]
    assert sum(i is None for i in ids) == 2 and len(set(ids)) == len(ids) - 1


def test_large_sets_of_candidates(spark, monkeypatch):
    """A chain of copies of copies, and a group around one text, both larger than what one task takes: compared in many cells."""
    monkeypatch.setattr(similar, "_MOST", 16)
    rng, rows = random.Random(12), []
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    for i in range(150):
        rows.append((i, " ".join(words)))
        words = list(words)
        words[rng.randrange(120)] = f"x{i}"
    base = [f"v{rng.randrange(500)}" for _ in range(200)]
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice([1, 2, 5, 9])):
            copy[at] = f"y{rng.randrange(3)}"
        rows.append((1000 + i, " ".join(copy)))
    sets = [brute_shingles(t) for _, t in rows]
    of = groups(sets, lambda a, b: jaccard(a, b) >= 0.8)
    expected = sorted(min(i for (i, _), g in zip(rows, of) if g == h) for h in set(of))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(expected) > 2 and sorted(r.doc_id for r in similar.keep_similar(frame).collect()) == expected


def test_similar_documents_shuffle_few_texts(spark):
    """Texts that are no candidates, and those that stay, aren't shuffled: far less is written than all texts, of which there were two copies."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1000))) for i in range(400)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    usual, before = spark.conf.get(threshold), written()
    spark.conf.set(threshold, "-1")
    try:
        got = similar.keep_similar(frame).select("doc_id", F.length("text")).collect()
    finally:
        spark.conf.set(threshold, usual)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert sorted(r.doc_id for r in got) == list(range(400))
    assert 0 < written() - before < 0.5 * sum(len(t) for _, t in rows)


@pytest.mark.parametrize("bits", [1 << 6, 1 << 25])
def test_similar_documents_with_a_full_bitmap(spark, monkeypatch, bits):
    """A bitmap that lets all rows pass, and one that lets few: repeated ids with one text or several, and rows without an id."""
    monkeypatch.setattr(common, "_BITS", bits)
    rows = [(i, t) for i, t in planted(0.005, 60)]
    rows += [(3, rows[3][1]), (4, rows[4][1]), (4, rows[4][1]), (8, "another text of the same id " * 3), (None, rows[0][1]), (None, None), (500, rows[10][1]), (500, "ab cd")]
    sets = [(i, brute_shingles(t)) for i, t in rows if i is not None]
    of = groups([s for _, s in sets], lambda a, b: jaccard(a, b) >= 0.8)
    kept = {min(i for (i, _), g in zip(sets, of) if g == h) for h in set(of)}
    frame = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    got = [r.doc_id for r in similar.keep_similar(frame).collect()]
    assert sorted(i for i in got if i is not None) == sorted(kept) and got.count(None) == 2
    ids = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "id long")
    rest = [r.doc_id for r in common.maybe_in(spark.range(300).toDF("doc_id"), F.col("doc_id"), common.id_bitmap(ids), False).collect()]
    most = [r.doc_id for r in common.maybe_in(spark.range(300).toDF("doc_id"), F.col("doc_id"), common.id_bitmap(ids)).collect()]
    assert all(i % 3 for i in rest) and sorted(rest + most) == list(range(300)) and (len(rest) > 150) == (bits > 64)


def test_large_sets_take_one_worker_a_task(spark, monkeypatch):
    """Between the search in cells and the forest of its links is a shuffle; without one each task had two Python workers."""
    monkeypatch.setattr(similar, "_MOST", 4)
    plans = []
    keep = lambda edges: (plans.append(edges._jdf.queryExecution().executedPlan().toString()), connected_components(edges))[1]
    monkeypatch.setattr(similar, "connected_components", keep)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(20):
        rows.append((i, " ".join(words)))
        words[3 * i] = f"x{i}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(similar.keep_similar(frame).collect()) < 20
    assert len(plans) == 2 and 0 < plans[1].index("Exchange") < plans[1].index("MapInArrow")


def test_pairs_of_pieces_are_held_once():
    """What the search in lanes learns of a pair of pieces is a byte beside its key, not an entry of a second map too."""
    model = spm.Model(spm.read_model())
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) for _ in range(300)) for _ in range(20)]
    found = model.encoded(texts)
    assert model._pairs.used > 100 and not model._stays and model._pairs.values.itemsize == 1
    assert 9 * len(model._pairs.keys) < 20_000_000
    alone = spm.Model(spm.read_model())
    assert found == [b"".join(alone._run(run) for run in alone.runs.findall(spm.SPACE + t.replace(" ", spm.SPACE))) for t in texts]


def test_clashing_names_in_stages(spark):
    """Columns named as the working columns of the stages that add some."""
    schema = "doc_id long, text string, kept_id int, _kept_id int, n string, name long, component long, key string, source string, lang string, n_chars long"
    rows = [(i, f"some words that are repeated here {i // 2}" * 4, 1, 2, "a", 4, 5, "b", "s", "en", 3) for i in range(8)]
    frame = spark.createDataFrame(rows, schema)
    for out in (simhash.keep_one(frame), similar.keep_similar(frame), pii.redacted(frame)):
        assert out.columns == frame.columns
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == sorted(r.doc_id for r in similar.keep_similar(frame).collect()) == [0, 2, 4, 6]


def test_near_dedup_stage_keeps_one_of_similar_documents(spark, sf):
    import corpus_pipeline

    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, brute_shingles(r.text)) for r in frame.collect()]
    of = groups([s for _, s in rows], lambda a, b: jaccard(a, b) >= 0.8)
    expected = sorted(min(i for (i, _), g in zip(rows, of) if g == h) for h in set(of))
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, sf).collect()) == expected


def test_bands_propose_copies_at_the_limit():
    """Share of planted pairs with similarities from 0.8 to 0.85 that share a band."""
    found = []
    for seed in range(30):
        rows = planted(0.02, 100, seed)
        sets = [brute_shingles(t) for _, t in rows]
        keys = similar.band_keys(*similar.shingle_sets(pa.array([t for _, t in rows]), 5))
        found += [(keys[k] == keys[k + 1]).any() for k in range(0, 200, 2) if 0.8 <= jaccard(sets[k], sets[k + 1]) < 0.85]
    assert len(found) > 700 and sum(found) >= 0.998 * len(found)


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(None, 5), (7, 7)]
    clean = [(a, b) for a, b in edges if a is not None and a != b]
    near = defaultdict(set)
    for a, b in clean:
        near[a].add(b)
        near[b].add(a)
    nodes = sorted(near)
    of = groups(nodes, lambda a, b: b in near[a])
    got = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()
    assert sorted((r.node, r.component) for r in got) == [(x, nodes[g]) for x, g in zip(nodes, of)]
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


CASES = [
    "mail a.b+c@x-y.example.com, next@@b.c a@b.c.@d.e and _@q.r1.",
    "ip 1.2.3.4.5.6.7.8 300.1.2.3 001.02.3.255 1.2.3 0000000255.1.1.1",
    "cards 4785 3805-9239 1139 and 4785380592391139 4785380592391138 " + "1 " * 40,
    "phone +1 (743) 555-3824 é +12345 +49-30-1234567890123456 ++1 2345678) +",
    "iban account DE89 3704 0044 0532 0130 00 and ssn: 123-45-6789, token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\"",
    "", "no digits", "9" * 20_000, "a" * 20_000 + "@", "1." * 9_000, "@" * 3000, "+1" * 3000,
]


def brute_spans(text):
    ok = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x[-9:]) <= 255 and not x[:-9].strip("0") for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(d[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, good) in ok.items() for m in re.finditer(p, text or "") if good(m.group())]


def test_pii_base_kinds():
    rng = random.Random(3)
    cases = CASES[:8] + ["".join(rng.choice("a1.@+- (9é") for _ in range(60)) for _ in range(3000)]
    for text in cases:
        if len(text) < 15_000:
            assert [s[:3] for s in pii.find(text) if s[0] in pii.BASE] == brute_spans(text), text
    for text in CASES:
        pii.find(text)
    assert {s[0] for s in pii.find(CASES[4])} >= {"iban", "ssn", "secret"}
    assert not pii.mod97("DE89370400440532013001") and pii.mod97("GB82WEST12345698765432")


@pytest.mark.parametrize("iban", ["AT611904300234573201", "ES91 2100 0418 4502 0005 1332", "BE68539007547034", "NO93 8601 1117 947", "DE89 3704 0044 0532 0130 00", "MT84MALT011000012345MTLCAST001S"])
@pytest.mark.parametrize("behind", ["", " BIC", " I paid", " EUR", " 2024", " ABCD 1234 EFGH", " BE68539007547034", ", then"])
def test_ibans_before_words_and_numbers(iban, behind):
    for before in ("", "pay ", "AB12 CDEF GHIJ "):
        spans = [(a, b) for kind, a, b, _ in pii.find(before + iban + behind) if kind == "iban"]
        expected = [(len(before), len(before) + len(iban))]
        if "BE68" in behind:
            expected.append((expected[0][1] + 1, expected[0][1] + len(behind)))
        assert spans == expected


def test_ibans_of_other_countries_and_long_runs():
    text = next(f"QQ{c:02}19043002 ABCD" for c in range(2, 99) if pii.mod97(f"QQ{c:02}190430021904"[:16]) or pii.mod97(f"QQ{c:02}19043002ABCD"))
    assert [s[1:3] for s in pii.find(text) if s[0] == "iban"] == [(0, len(text))]
    assert not [s for s in pii.find("AA11 " * 20_000) if s[0] == "iban" and s[2] - s[1] > 43]


def test_pii_frames(spark, docs, none):
    rows = [(i, t, "en", "s", len(t), "b", "c", "d", "e", "f") for i, t in enumerate(CASES)]
    frame = spark.createDataFrame([*rows, *rows[:2]], SCHEMA)
    assert sorted((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.detect(frame).collect()) == sorted((r[0], pii.find(r[1])) for r in [*rows, *rows[:2]])
    clean = {r.doc_id: r for r in pii.redacted(frame).collect()}
    assert clean[0].text.startswith("mail <EMAIL>, next@@b.c <EMAIL>") and "<IBAN>" in clean[4].text
    assert all(r.n_chars == len(r.text) and not pii.find(r.text) for r in clean.values() if r.doc_id not in (11,))
    assert pii.redacted(docs).count() == docs.count() and pii.redacted(none).collect() == [] and pii.detect(none).collect() == []


def test_mixing(spark, docs, none):
    got = mixing.schedule(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.taken == sum(r.takes) <= 2 * r.size and all(0 <= p <= 1 for p in r.positions) and len(r.positions) == len(r.takes)
    total = sum(r.size for r in got)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    cap = {s: 2 * sum(r.size for r in by[s]) for s in order}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * total, set(order)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= cap[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s], left = cap[s], left - cap[s]
        open_ -= full
    for s in order:
        assert by[s][0].target == pytest.approx(target[s]) and abs(sum(r.taken for r in by[s]) - target[s]) <= 1
    assert sorted(map(str, mixing.schedule(docs.repartition(5)).collect())) == sorted(map(str, got))
    stream = mixing.mixed_documents(docs)
    assert stream.columns == docs.columns
    words = defaultdict(int)
    for r in stream.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(abs(words[s] - target[s]) <= 1 for s in order)
    assert mixing.schedule(none).collect() == [] and mixing.mixed_documents(none).collect() == []


def test_mixed_order_does_not_depend_on_partitions_or_repeats(spark):
    """Repeated ids, repeated rows and clashing names; a repeated row without words changes nothing."""
    schema = "doc_id long, text string, source string, mix_key string, mix_visit int, MIX_SIZE long, mix_cut string, mix_order int, __size long, key int, h string, n_chars long"
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(i % 7)), f"s{i % 3}", "k", i, 3, "c", 4, 5, 6, "h", 9) for i in range(60)]
    more = [*rows, (7, "another text", "s1", "k", 100, 3, "c", 4, 5, 6, "h", 9), rows[8], (None, "a b", None, "k", 101, 3, "c", 4, 5, 6, "h", 9), (None, "c d", None, "k", 102, 3, "c", 4, 5, 6, "h", 9)]

    def stream(some, n):
        out = mixing.mixed_documents(spark.createDataFrame(some, schema).repartition(n), 3)
        assert out.columns == spark.createDataFrame([], schema).columns
        return [tuple(r) for r in out.collect()]

    assert stream(rows, 3) == stream([*rows, (*rows[0][:1], "", *rows[0][2:])], 5) == stream(rows, 1)
    assert stream(more, 4) == stream(more[::-1], 2)
    scheduled = mixing.schedule(spark.createDataFrame(more, schema).repartition(3)).collect()
    assert sorted(map(str, scheduled)) == sorted(map(str, mixing.schedule(spark.createDataFrame(more[::-1], schema)).collect()))
    times = [r.position for r in scheduled]
    assert [t for t in times if t is not None] == sorted(t for t in times if t is not None)


def test_position_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    for a, b in mixing.RAMPS:
        for due, t in spark.range(11).select((F.col("id") / 10).alias("d"), mixing.position(F.col("id") / 10, F.lit(a), F.lit(b))).collect():
            assert (a * t + (b - a) * t * t / 2) / (a + (b - a) / 2) == pytest.approx(due)


def test_language_id(spark, docs, none):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op9_language_id(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    few = spark.createDataFrame([(1, "the the the cat", "en"), (2, "le le le chat", "fr"), (3, None, "fr"), (4, "el", None)], "doc_id long, text string, lang string")
    model = langid.learn(few)
    score = model.scorer()
    assert score("the")[0] == "en" and score("lechat le")[0] == "fr" and score(None) == score("12 ²!") == ("und", 0.0)
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(none)).collect()} == {"und"}
    assert langid.identify(none, model).collect() == [] and langid.only_known(none, model).collect() == []
    assert set(langid.only_known(docs, model).columns) == set(docs.columns)


def test_a_rare_language_keeps_its_words(spark):
    """One language has nearly all documents and far more words than are kept; the others, one with long words only, are still told."""
    rng = random.Random(6)
    rows = [(i, " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.choice('aeiou')}{rng.randrange(9) * 'x'}" for _ in range(60)), "aa") for i in range(400)]
    rows += [(1000 + i, " ".join(rng.choice(["zug", "zwei", "jetzt", "quark"]) for _ in range(30)), "bb") for i in range(4)]
    rows += [(2000 + i, " ".join("kq" * 30 + rng.choice("wv") for _ in range(9)), "cc") for i in range(3)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most_docs=60, most_words=30, most_grams=90)
    score = model.scorer()
    assert model.langs == ["aa", "bb", "cc"] and sum(map(len, (model.words, model.grams))) <= 120
    assert all(score(t)[0] == lang for _, t, lang in rows[:20] + rows[400:]) and score("quark jetzt")[0] == "bb" and score("kq" * 31)[0] == "cc"


def brute_language(rows, longest=4, least=3):
    """A function from text to (language, probability), learned from (text, lang) by plain loops."""
    from collections import Counter
    from math import exp, log

    words, grams = defaultdict(Counter), defaultdict(Counter)
    for text, lang in rows:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            words[w][lang] += 1
    for w, by in words.items():
        padded = f"^{w}$"
        for g in {padded[i : i + n] for n in range(1, longest + 1) for i in range(len(padded) - n + 1)}:
            grams[g].update(by)
    langs = sorted({lang for _, lang in rows})
    known = {w: c for w, c in words.items() if c.total() >= least}
    parts = {n: {g: c for g, c in grams.items() if len(g) == n and (n == 1 or c.total() >= least)} for n in range(1, longest + 1)}

    def logs(table):
        total = {lang: sum(c[lang] for c in table.values()) + 0.5 * (len(table) + 1) for lang in langs}
        return {k: [log((c[lang] + 0.5) / total[lang]) for lang in langs] for k, c in table.items()}

    known, parts = logs(known), {n: logs(t) for n, t in parts.items()}

    def word(w):
        if w in known:
            return known[w]
        padded, found = f"^{w}$", []
        for i in range(len(padded)):
            for n in range(min(longest, len(padded) - i), 0, -1):
                if padded[i : i + n] in parts[n]:
                    found.append(parts[n][padded[i : i + n]])
                    break
        return [sum(x) / len(found) for x in zip(*found)] if found else [0.0] * len(langs)

    def score(text):
        found = [word(w) for w in re.findall(r"[^\W\d_]+", (text or "").lower())]
        if not found:
            return "und", 0.0
        mean = [sum(x) / len(found) for x in zip(*found)]
        odds = [exp((m - max(mean)) * min(20, len(found))) for m in mean]
        best = odds.index(max(odds))
        return langs[best], odds[best] / sum(odds)

    return score


def test_language_scores_match_plain_loops(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    brute = brute_language([(r.text, r.lang) for r in rows if r.text and r.lang])
    model = langid.learn(spark.read.parquet(f"{sf}/documents.parquet"), most_words=10**7, most_grams=10**7)
    score = model.scorer()
    for text in [r.text for r in rows][:80] + ["lechat quelque", "zzzq", "x", "", None, "1 2"]:
        lang, p = score(text)
        want = brute(text)
        assert p == pytest.approx(want[1], rel=1e-6) and (lang == want[0] or p < 0.51)


def test_quality(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op5_quality(spark, sf).collect()]
    held = sorted((r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label)
    ones = sum(y for _, y in held)
    area = (sum(k for k, (_, y) in enumerate(held, 1) if y) - ones * (ones + 1) / 2) / (ones * (len(held) - ones))
    assert len(got) == 10_000 and area >= 0.9, area
    trees = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(r.score == 0.5 for r in quality.score(docs, trees).collect()) and quality.score(none, trees).collect() == []
    assert quality.statistics(pa.array([None, "", " "], pa.string())).shape == (3, len(quality.NAMES))


TEXTS = ["Hello  world\n a\tb", " lead trail ", "", "é ﬁ ｆｕｌｌ \xa0x  日本語😀", "a\x00b", "<s>hi</s><0x0A>", "Thnd*** iner*** ther*** ththsh$$$", " " * 200, "x" * 5000, "aaaa" * 999 + "b", "日本語" * 700, "\n\n\n"]


@pytest.fixture(scope="module")
def processor():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=spm.DEFAULT_MODEL)


def brute_statistics(text):
    """The statistics of quality.NAMES by plain loops over bytes and words."""
    from math import log1p, sqrt

    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    out = {"log_bytes": log1p(len(data)), "log_words": log1p(len(words))}
    of = {b: name for name, members in quality._CLASSES.items() for b in members}
    for name in quality._CLASSES:
        out[name] = sum(of.get(b) == name for b in data) / max(1, len(data))
    n, size = max(1, len(words)), [len(w) for w in words]
    lines = data.count(b"\n") + 1
    mean = sum(size) / n
    share = lambda test: sum(map(bool, map(test, words))) / n
    kinds = lambda w: [of.get(b) for b in w]
    out |= {"words_odd_end": share(lambda w: of.get(w[-1]) == "odd"), "words_upper": share(lambda w: len(w) > 1 and of.get(w[0]) == "upper" and "lower" not in kinds(w))}
    out |= {"word_mean": mean, "word_std": sqrt(max(0, sum(x * x for x in size) / n - mean * mean)), "word_most": log1p(max(size)) if size else 0}
    out |= {"distinct_words": len(set(words)) / n, "distinct_pairs": len(set(zip(words, words[1:]))) / max(1, len(words) - 1)}
    out |= {"repeat_next": sum(a == b for a, b in zip(words, words[1:])) / n, "lines": log1p(lines), "line_words": len(words) / lines}
    out |= {"short_words": share(lambda w: len(w) <= 3), "capital_words": share(lambda w: of.get(w[0]) == "upper")}
    return [out[name] for name in quality.NAMES]


def test_statistics_match_plain_loops():
    texts = [r[1] for r in corpus()] + TEXTS + ["SHOUT at Me! #tag# a a a\nb [x]  UP1 é"]
    got = quality.statistics(pa.array(texts, pa.string()))
    for text, row in zip(texts, got):
        assert row == pytest.approx(brute_statistics(text), rel=1e-9, abs=1e-6), (text or "")[:50]


def brute_boost(x, y, trees, depth, rate, bins, least, ridge):
    """Margins of the rows after boosting, each node's split found by trying all cuts of all columns on its rows."""
    import numpy as np

    share = min(0.99, max(0.01, y.mean()))
    margin = np.full(len(y), np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)

        def grow(rows, level):
            g, h = grad[rows].sum(), hess[rows].sum()
            best, split = 1e-6, None
            for f in range(x.shape[1]) if level < depth else ():
                for cut in cuts[f]:
                    left = rows[x[rows, f] <= cut]
                    if len(left) < least or len(rows) - len(left) < least:
                        continue
                    a, b = grad[left].sum(), hess[left].sum()
                    gain = a**2 / (b + ridge) + (g - a) ** 2 / (h - b + ridge) - g**2 / (h + ridge)
                    if gain > best + 1e-9:
                        best, split = gain, (f, cut)
            if split is None:
                margin[rows] += rate * g / (h + ridge)
                return
            over = x[rows, split[0]] > split[1]
            grow(rows[~over], level + 1)
            grow(rows[over], level + 1)

        grow(np.arange(len(y)), 0)
    return margin


def test_flat_trees_match_trees_grown_by_trying_all_cuts():
    import numpy as np

    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 4))
    x[:, 3] = np.round(x[:, 3])  # ties
    y = (x[:, 0] + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=400) > 0).astype(float)
    settings = {"trees": 6, "depth": 3, "rate": 0.2, "bins": 16, "least": 10, "ridge": 1.0}
    got = quality.Trees(x, y, **settings).probability(x)
    assert got == pytest.approx(1 / (1 + np.exp(-brute_boost(x, y, **settings))), rel=1e-9)


def test_sentencepiece_ids(processor):
    model, rng = spm.Model(spm.read_model()), random.Random(9)
    texts = TEXTS + ["".join(rng.choice("abcdeth  ñé\n1.日<▁") for _ in range(rng.randrange(90))) for _ in range(1500)]
    texts += [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE doc_id % 7 = 0").fetchall()]
    for t in texts:
        ids = model.encode(t)
        assert ids == processor.encode(t), t[:80]
        assert model.decode(ids) == t.replace("▁", " "), t[:80]
    assert model.encode(None) == [] and model.decode([99_999_999, None, 1]) == "" and model.decode([3 + 0xFF]) == "�"


def test_sentencepiece_ids_with_a_full_pair_map(processor, monkeypatch):
    """The map of pairs is cleared over and over; at last a single step brings more new pairs than it holds."""
    monkeypatch.setattr(spm, "_PAIRS", 4)
    model, rng = spm.Model(spm.read_model()), random.Random(4)
    texts = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 12))) for _ in range(40)) for _ in range(200)]
    for part in [texts[a : a + 5] for a in range(0, 200, 5)] + [texts]:
        for t, ids in zip(part, model.encoded(part)):
            ids = memoryview(ids).cast("i").tolist()
            assert ids == processor.encode(t) and model.decode(ids) == t


@pytest.mark.parametrize("ring", [2, 3, 4])
def test_long_runs_in_lanes(processor, monkeypatch, ring):
    """All runs in lanes, which commit many times before they end; with a narrow ring some are searched alone."""
    monkeypatch.setattr(spm, "_LANE", 10_000)
    monkeypatch.setattr(spm, "_RING", ring)
    model, rng = spm.Model(spm.read_model()), random.Random(8)
    texts = ["".join(rng.choice("etaoinshrdlué日") for _ in range(rng.randrange(1, 400))) for _ in range(60)] + ["a" * 700, "ab" * 300, "the" * 100, "▁" * 90]
    for t, ids in zip(texts, model.encoded(texts)):
        assert memoryview(ids).cast("i").tolist() == processor.encode(t)


def test_unigram_search_is_the_best_path(processor):
    """The same file read as a unigram model; the streaming search against one that keeps everything."""
    model, rng = spm.Model(spm.read_model()), random.Random(2)
    model.kind = spm.UNIGRAM
    for _ in range(60):
        text = "".join(rng.choice("thenadios▁é") for _ in range(rng.randrange(1, 200)))
        best = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - model.longest), end):
                piece = text[begin:end]
                if piece in model.ids or end - begin == 1:
                    total = best[begin][0] + (model.scores[model.ids[piece]] if piece in model.ids else model.worst)
                    if end not in best or total > best[end][0]:
                        best[end] = (total, [*best[begin][1], piece])
        got = [text[a:b] for a, b, _ in model.search(text, window=1)]
        score = sum(model.scores[model.ids[p]] if p in model.ids else model.worst for p in got)
        assert "".join(got) == text and score == pytest.approx(best[len(text)][0])


def test_sentencepiece_frames(docs, none):
    model = spm.read_model()
    got = spm.decode(spm.encode(docs, model), model).collect()
    assert sorted(r.decoded for r in got) == sorted(r[1] or "" for r in corpus())
    assert sorted(map(str, spm.encode(docs, model, decoded=True).collect())) == sorted(map(str, got))
    assert spm.encode(none, model).collect() == []


def test_last_stage_tells_whether_texts_come_back(spark):
    import corpus_pipeline

    rows = [(1, "a plain text"), (2, "marks ▁ become spaces"), (3, ""), (4, None), (5, "\u00e9\n\t \U0001f600")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.same_text for r in corpus_pipeline.tokenise(spark, frame, "").collect()}
    assert got == {1: True, 2: False, 3: True, 4: None, 5: True}
    both = spm.encode(frame, spm.read_model(), decoded=True, compared=True)
    assert both.columns == ["doc_id", "ids", "decoded", "same_text"]
    assert {r.doc_id: r.same_text for r in both.collect()} == got


def test_pipeline_matches_its_stages_by_hand(spark, sf, processor):
    """run() against the same decisions made one by one over Python lists."""
    import corpus_pipeline

    rows = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    score = langid.learn(spark.read.parquet(f"{sf}/documents.parquet")).scorer()
    rows = [r for r in rows if score(r["text"])[0] != "und" and score(r["text"])[1] >= 0.4]
    of = groups([brute_shingles(r["text"]) for r in rows], lambda a, b: jaccard(a, b) >= 0.8)
    least = defaultdict(list)
    for r, g in zip(rows, of):
        least[g].append(r["doc_id"])
    rows = [r for r, g in zip(rows, of) if r["doc_id"] == min(least[g])]
    for r in rows:
        r["text"] = pii.redact(r["text"], pii.find(r["text"]))
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: hashlib.md5(f"{r['doc_id']} {r['text']}".encode()).hexdigest()):
        by[r["source"]].append((r["doc_id"], r["text"], WORD.findall(r["text"])))
    size = {s: sum(len(w) for *_, w in v) for s, v in by.items()}
    target, left, open_ = {}, 1.5 * sum(size.values()), sorted(size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(open_)}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 2 * size[s]]
        if not full:
            target |= share
            break
        for s in full:
            target[s], left = 2 * size[s], left - 2 * size[s]
        open_ = [s for s in open_ if s not in full]
    expected = []
    for s, v in by.items():
        rest = int(target[s])
        for i, text, words in [*v, *v]:
            take = min(rest, len(words))
            rest -= take
            if take:
                cut = text if take == len(words) else text[: [m.end() for m in WORD.finditer(text)][take - 1]]
                expected.append((i, processor.encode(cut)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted(expected)
    assert [name for name, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
