"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import re
import struct
import zlib
from collections import Counter
from contextlib import nullcontext

import numpy as np
import pytest

corpus = pytest.importorskip("quillon.llm.registry")

from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import chat_format, html_extract, media, mixing, ngram_join, packing, quality_model, quality_rules, toxicity, warc  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0d]+")
WORDS = "the of and to river stone cloud amber brook cedar delta ember frost grain harbor inlet juniper kettle linen meadow nectar orchid".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


def texts():
    base = prose(1, 60)
    near = base.replace("river", "rivet", 1)
    return [
        (0, base), (1, base), (2, near), (3, None), (4, ""), (5, " \n\t "), (6, "one two three"), (7, "ONE two three"), (8, prose(2, 3000)), (9, "a b c d e"), (10, "a b c d e f"), (11, "x " * 400), (12, "é ü ß 中文 ’quoted’ it's 12 345"),
        (13, prose(3, 40) + "\n" + prose(4, 30) + "\n" + prose(4, 30)), (14, "### $$$ %%% " * 20), (14, "### $$$ %%% " * 20), (None, prose(5, 30)), (15, "a" * 5000), (16, "a b c d e f g h"), (17, "a b c d e f g h i"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id, text and columns whose names clash with those of results."""
    rows = [(i, t, "en", "s", len(t or ""), 7, "x", 0.5) for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int, sequence_id string, __rate double").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# --- quality rules

def measures(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures(docs):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    rows = quality_rules.measure(docs).select("text", *(f"__qr_{n}" for n in names)).collect()
    assert len(rows) == len(texts())
    for r in rows:
        want = measures(r[0])
        assert tuple(r[1:6]) == want, r[0]
        assert r[6] == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_quality_filter_keeps_columns_and_rows(docs, empty):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    # Row 13 has 100 words, 60 of them in windows that repeat: the base rule rejects it.
    assert {0, 1, 2, 8, None} <= ids and not ids & {3, 4, 5, 6, 7, 9, 11, 13, 14, 15}
    assert quality_rules.keep_good(empty).count() == 0


# --- chats

def test_chat_round_trip(spark):
    said = [(1, 0, "user", "a </s> \\ [INST] <|end|>"), (1, 1, "assistant", "x <|start|>\\"), (1, 1, "assistant", "x <|start|>\\"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "assistant", "<<SYS>> [/INST] <"), (None, 0, "user", "hi")]
    df = spark.createDataFrame([(*x, "z") for x in said], "conv_id long, turn long, role string, text string, turns string")
    out = chat_format.format_chats(df).withColumn("back", chat_format.read_turns(F.col("formatted")))
    for r in out.collect():
        want = sorted((t, x or "", y or "") for c, t, x, y in said if c == r.id)
        assert [(t.role, t.text) for t in r.back] == [(x, y) for _, x, y in want]
        assert r.formatted.count("<|start|>") == len(want)
        for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert c not in r.formatted
        spans = ["".join(re.sub(r"(?s)\\(.)", r"\1", r.formatted[s.start : s.start + s.length])) for s in r.loss_spans]
        assert spans == [y for _, x, y in want if x == "assistant"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    two = [("user", "q"), ("assistant", "a")]
    rows = [
        ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', two), ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}],"source":"x","id":{"n":3}}', two),
        ('{"messages":[{"role":"user","text":"q","score":1},{"role":"assistant","text":"a"}]}', two), ('{"messages":[]}', []), ('{"messages":[{"role":"bot","content":null},{"role":"user"}]}', [("bot", ""), ("user", "")]),
        ('{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}],"id":"7"}', two), ('{"output":"a","instruction":"q","input":""}', two), ('{"output":"a","instruction":"q","input":null,"system":"s"}', [("system", "s"), *two]),
        ('{"instruction":"q","input":"more","output":"a"}', [("user", "q"), ("user", "more"), ("assistant", "a")]), ('{"prompt":"q","completion":"a"}', two), ('{"prompt":"q","response":"a","score":0.5}', two), ('{"question":1,"answer":true}', [("user", "1"), ("assistant", "true")]),
        ('{"prompt":{"x":1},"completion":"a"}', None), ('{"prompt":"q"}', None), ('{"prompt":"q","completion":"a","response":"b"}', None), ('{"messages":"q"}', None), ('{"messages":[1]}', None), ('{"messages":[{"role":"user","content":["q"]}]}', None),
        ('{"unknown":1}', None), ("[1]", None), ("not json", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame([(r, "x", 1) for r, _ in rows], "r string, turns string, record int")
    out = chat_format.canonical(df, "r", layout_col="layout")
    assert out.columns == ["r", "record", "turns", "layout"]
    got = {x.r: None if x.turns is None else [(t.role, t.text) for t in x.turns] for x in out.collect()}
    assert got == dict(rows)
    typed = spark.createDataFrame([(1, "q", "a")], "id int, prompt string, response string").select(F.to_variant_object(F.struct("id", "prompt", "response")).alias("v"))
    assert [(t.role, t.text) for t in chat_format.canonical(typed, "v").first().turns] == two


def test_chat_records_take_several_layouts(spark):
    """The query's own records, whose layouts differ, all come back from their fingerprints."""
    said = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "q"), (2, 2, "assistant", "a"), (3, 0, "system", ""), (3, 1, "user", "q"), (3, 2, "assistant", "a"), (4, 0, "assistant", "a"), (5, 0, "human", "q"), (6, 0, None, None)]
    df = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    out = chat_format.canonical(chat_format.as_records(df), "record", layout_col="layout").collect()
    assert {r.id: r.layout for r in out} == {1: "response", 2: "response", 3: "messages", 4: "messages", 5: "messages", 6: "messages"}
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == [(x or "", y or "") for c, _, x, y in said if c == r.id]


# --- near duplicates

def brute_classes(rows):
    low = {i: i + 32 for i in range(65, 91)}
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                la, lb = label[a], label[b]
                label = [min(la, lb) if v in (la, lb) else v for v in label]
    out = []
    for k, (i, s) in enumerate(sets):
        ids = [j for v, (j, t) in zip(label, sets, strict=True) if v == label[k] and j is not None and t]
        out.append((i, len(s), min(ids) if s and ids else i))
    return Counter(out)


def test_ngram_classes(docs, empty):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(docs).collect())
    assert got == brute_classes(texts())
    assert ngram_join.classes(empty).count() == 0


def test_ngram_chain_of_near_copies(spark):
    """A group in which not all pairs link: every class and no other."""
    r = np.random.default_rng(9)
    base = [WORDS[i] + str(i % 7) for i in r.integers(0, len(WORDS), 140)]
    rows = []
    for k in range(120):
        w = list(base)
        for p in r.choice(140, r.integers(0, 7), replace=False):
            w[p] = f"z{k}_{p}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(f"q{k}_{j}" for j in range(60)) + " " + " ".join(base[:60])) for k in range(30)]
    rows += [(300 + k, " ".join(chr(97 + (k + j) % 5) for j in range(5 + k % 6))) for k in range(40)]
    got = Counter((x.doc_id, x.n_shingles, x.component_id) for x in ngram_join.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == brute_classes(rows)


def test_ngram_boundary_and_bounds():
    assert ngram_join.needed(4, 4) == 4 and ngram_join.needed(7, 7) == 6
    for s in range(1, 40):
        for t in range(1, 40):
            i = ngram_join.needed(s, t)
            assert 100 * i >= 75 * (s + t - i) and not 100 * (i - 1) >= 75 * (s + t - i + 1)
    sizes = np.zeros(18, np.int64)
    sizes[4] = 10
    assert ngram_join.boundary(sizes, 1.0) == 0 and ngram_join.boundary(sizes, 100.0) >= 4


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == docs.columns and ids[0] == 1 and ids[1] == 0 and ids[2] == 0 and ids[14] == 1 and ids[None] == 1 and ids[3] == ids[4] == ids[5] == 1


def test_keep_one_judges_rows_by_their_own_text(spark):
    a, b, c = prose(21, 50), prose(22, 50), prose(23, 50)
    rows = [(1, a), (1, b), (2, a), (2, c), (3, None), (3, None), (3, ""), (None, a), (None, c), (4, b), (4, b), (5, prose(24, 50)), (5, prose(24, 50))]
    kept = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, a), (1, b), (2, c), (3, None), (3, None), (3, ""), (5, prose(24, 50))])


def test_ngram_ids_of_text(spark):
    rows = [("b", prose(1, 30)), ("a", prose(1, 30)), (None, None), ("c", "x y")]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", 26, "a"), ("a", 26, "a"), (None, 0, None), ("c", 1, "c")}


def test_ngram_cells_lose_no_pair(spark):
    """One list of many components: the cells give each allowed pair of different labels once, whatever their size."""
    r = np.random.default_rng(4)
    rows = [(7, bytes([k]), int(r.integers(20, 60)), int(r.integers(0, 4)), bytes([int(r.integers(0, 9))])) for k in range(120)]
    df = spark.createDataFrame(rows, "key long, node binary, n int, place int, label binary")
    want = Counter(frozenset((x[1], y[1])) for i, x in enumerate(rows) for y in rows[:i] if x[4] != y[4] and 4 * min(x[2], y[2]) >= 3 * max(x[2], y[2]) and 7 * min(x[2] - x[3], y[2] - y[3]) >= 3 * (x[2] + y[2]))
    for block in (7, 1000):
        assert Counter(frozenset((bytes(p.node), bytes(p.node2))) for p in ngram_join._across(df, block).collect()) == want


# --- packing

def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    size = 64
    rows = packing.pack(docs, path, size=size).collect()
    tk = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts():
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for p, a in enumerate(range(0, len(ids), size)):
            want[i, p, a, len(ids[a : a + size]), zlib.crc32(ids[a : a + size].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= size
    assert len(by) <= -(-sum(r.length for r in rows) // size) + 2
    assert packing.pack(empty, path).count() == 0
    named = packing.pack(docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text"), path, size=size, with_ids=True).collect()
    assert {r.doc_id for r in named} == {None if i is None else f"d{i}" for i, _ in texts()} and all(zlib.crc32(r.ids) == r.ids_crc32 for r in named)


def test_packing_plan_is_exact():
    r = np.random.default_rng(2)
    for counts in (np.bincount(r.integers(1, 101, 5000), minlength=101), np.bincount([100] * 7 + [51] * 9 + [50] * 4, minlength=101), np.bincount([1] * 1000, minlength=101), np.zeros(101, int)):
        plan = packing.plan(counts, 100)
        used = np.zeros(101, int)
        for pattern, times in plan:
            assert sum(a * k for a, k in pattern) <= 100 and times > 0
            for a, k in pattern:
                used[a] += k * times
        assert (used == counts).all()
        bound = -(-int((counts * np.arange(101)).sum()) // 100)
        assert sum(t for _, t in plan) <= 1.03 * max(bound, int(counts[51:].sum())) + 2  # even lengths are the hardest; see the next test for those of texts


def test_packing_amounts_cover_and_whole_parts_carry_large_corpora():
    r = np.random.default_rng(3)
    counts = np.bincount(np.minimum(r.lognormal(3.2, 0.8, 400000).astype(int) + 1, 256), minlength=257)
    amounts = packing.fractional(counts, 256)
    whole = packing.rounded(amounts, counts, 256)
    assert sum(int(x) for x in amounts.values()) > 0.6 * sum(t for _, t in whole)
    assert sum(t for _, t in whole) <= 1.002 * -(-int((counts * np.arange(257)).sum()) // 256)


def test_knapsack_against_brute_force():
    value = np.zeros(21)
    value[[3, 5, 8]] = 4, 7, 12
    best, _ = packing.knapsack(value, 20)
    assert best[20] == max(4 * a + 7 * b + 12 * c for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 8 * c <= 20)


# --- media

def test_media_round_trip(docs, spark):
    out = media.to_media(docs).collect()
    want = Counter((i, (t or "").encode()) for i, t in texts())
    got = Counter()
    for r in out:
        payload, n = media.wav_payload(bytes(r.media))
        assert len(payload) % media.FRAME == 0 and set(payload[n:]) <= {255}
        got[r.doc_id, payload[:n]] += 1
    assert got == want


def test_media_query_columns(spark, docs, data):
    """Every column of the query, from the texts by the wave module and hashlib."""
    import io
    import wave

    for folder, rows in ((data, [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]),):
        got = {r.doc_id: r for r in media.op6_media_sniffing(spark, folder).collect()}
        assert len(got) == len(rows)
        for i, t in rows:
            raw = (t or "").encode()
            payload = raw + b"\xff" * (max(-(-len(raw) // 576), 1) * 576 - len(raw))
            r = got[i]
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
            x = np.frombuffer(payload, np.uint8)
            assert r.feature.startswith("audio/wav;corrected=1;") and f";frames={len(x) // 576};mean={x.mean():.4f};peak={x.max()};crossings={np.count_nonzero(np.diff((x >= 128).astype(int)))}" in r.feature
    for r in media.to_media(docs).collect():
        file = wave.open(io.BytesIO(bytes(r.media)))
        assert (file.getnchannels(), file.getsampwidth()) == (1, 1) and file.readframes(file.getnframes()) == media.wav_payload(bytes(r.media))[0]


def test_media_structures():
    import gzip
    import io
    import zipfile

    def archive(*parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, p in enumerate(parts):
                z.writestr(f"part{k}", p)
        return out.getvalue()

    found = media.sniffer().found
    inner = archive(b"x" * 40)
    outer = archive(inner, b"y" * 9, inner)
    assert [(n, k) for _, n, k in found(outer)] == [(len(outer), "application/zip"), (len(inner), "application/zip"), (len(inner), "application/zip")]
    deep = archive(outer)
    assert [n for _, n, _ in found(deep)] == [len(deep), len(outer), len(inner), len(inner)]
    pdf = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF\n2 0 obj\nstartxref\n40\n%%EOF"
    assert found(pdf + b"\n" + pdf) == [(0, len(pdf), "application/pdf"), (len(pdf) + 1, len(pdf), "application/pdf")]
    wav = media.wav_bytes(b"\x80" * 576, 576)
    junk = b"RIFF" + struct.pack("<I", len(wav) - 8 + 12) + b"WAVEJUNK" + struct.pack("<I", 4) + b"abcd" + wav[12:]
    assert found(junk) == [(0, len(junk), "audio/wav")] and not found(junk[:-1])
    mp4 = struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 1) + b"mdat" + struct.pack(">Q", 116) + b"x" * 100 + struct.pack(">I", 8) + b"moov"
    assert found(mp4) == [(0, len(mp4), "video/mp4")] and not found(mp4[:-8])
    gz = gzip.compress(b"text" * 99)
    assert found(b"--" + gz + gz) == [(2, len(gz), "application/gzip"), (2 + len(gz), len(gz), "application/gzip")] and not found(gz[:-1])
    page = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(16) + b"CRC!" + bytes([1, len(body)]) + body

    def signed(p):
        crc = 0
        for x in p.replace(b"CRC!", bytes(4)):
            crc = (crc << 8 & 0xFFFFFFFF) ^ media._CRC32[crc >> 24 ^ x]
        return p.replace(b"CRC!", struct.pack("<I", crc))

    ogg = signed(page(2, b"head")) + signed(page(0, b"body")) + signed(page(4, b"end"))
    assert found(ogg + b"rest") == [(0, len(ogg), "audio/ogg")] and not found(page(2, b"head"))


def test_media_many_magics_cost_no_more_than_the_length():
    import time

    start = time.time()
    for bad in (b"%PDF-" * 40000, b"PK\x03\x04PK\x05\x06" * 30000, b"\xff\xd8\xff\xe0\x00\x02" * 40000, b"\x1f\x8b\x08" * 60000, b"GIF89a" * 40000, b"OggS\0" * 40000, b"RIFF\xff\xff\0\0WAVE" * 20000):
        assert media.sniffer().found(bad) == []
    assert time.time() - start < 30


def test_media_sniffing(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", b"\0" * 13), (b"IDAT", zlib.compress(b"x")), (b"IEND", b"")))
    wav = media.wav_bytes(b"\x80" * 576, 576)
    gz = b"\x1f\x8b\x08" + zlib.compressobj(wbits=31).flush()[3:]
    rows = [("png", png, "image/jpeg"), ("inside", b"junk" + png + b"tail" + wav, None), ("broken", png[:-5], "image/png"), ("bad crc", png.replace(b"IDAT", b"IDAX"), None), ("wav", wav, "audio/wav"), ("null", None, "image/gif"), ("empty", b"", None), ("bm", b"BMBMBM", None), ("gz", gz, None)]
    df = spark.createDataFrame(rows, "id string, data binary, said string")
    out = {r.id: r.sniffed for r in media.sniff(df, "data", "said").collect()}
    assert out["png"].type == "image/png" and out["png"].corrected and out["png"].confirmed
    assert [(c.type, c.offset, bytes(c.data)) for c in out["inside"].carved] == [("image/png", 4, png), ("audio/wav", 8 + len(png), wav)]
    assert not out["broken"].confirmed and not out["bad crc"].confirmed and not out["bm"].confirmed and out["null"].type == "image/gif"
    assert out["wav"].confirmed and not out["wav"].corrected and out["gz"].type == "application/gzip"


# --- classifiers

def labelled(spark, bad, n=400):
    rows, marks = [], []
    for k in range(n):
        y = k % 3 == 0
        rows.append((k, bad(k) if y else prose(1000 + k, 60)))
        marks.append((k, int(not y), int(y), "en"))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int, score string")


def test_toxicity(spark, docs, empty):
    train, labels = labelled(spark, lambda k: prose(1000 + k, 50) + " vilefool " + prose(k, 5) + " grubface")
    model = toxicity.fit(train, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(train, model).collect()}
    held = [k for k in scored if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scored[k] >= 0.5) == (k % 3 == 0) for k in held]) > 0.97
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(texts()) and set(docs.columns) == set(rows[0].asDict())
    # The machine by its definition, over sets of buckets.
    for r in rows:
        seen = [b for b in set(toxicity.doc_terms(np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len((r.text or "").encode())]))[1].tolist()) if model.seen[b]]
        raw = float(model.w0) + sum(float(model.w[b]) for b in seen) + sum(float(model.v[x] @ model.v[y]) for k, x in enumerate(seen) for y in seen[:k])
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(raw, -30, 30)))) < 1e-4
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.fit(train, labels.limit(0))
    assert none is None and toxicity.score(train, none).agg(F.max("score")).first()[0] == 0
    assert toxicity.keep_civil(docs, labels.limit(0)).columns == docs.columns


def test_toxicity_of_pairs_alone(spark):
    """No term says anything alone; two of the four pairs are toxic."""
    r = np.random.default_rng(0)
    rows, marks = [], []
    for k in range(1500):
        a, b = r.integers(0, 2, 2)
        rows.append((k, f"{prose(5000 + k, 20)} {('vilo', 'grub')[a]} {prose(9000 + k, 20)} {('kin', 'folk')[b]}"))
        marks.append((k, 1, int(a == b)))
    train, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = {x.doc_id: x.score for x in toxicity.score(train, toxicity.fit(train, labels)).collect()}
    held = [k for k in scored if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scored[k] >= 0.5) == marks[k][2] for k in held]) > 0.95


def test_toxicity_of_pairs_in_long_texts(spark):
    """The same among 500 other terms in each text: none of its pairs may be left out."""
    r = np.random.default_rng(1)
    words = ["".join(chr(97 + int(c)) for c in f"{k:05}") for k in range(1000, 1600)]
    rows, marks = [], []
    for k in range(1200):
        a, b = r.integers(0, 2, 2)
        rows.append((k, " ".join(r.permutation([*r.choice(words, 500, False), ("vilo", "grub")[a], ("kin", "folk")[b]]))))
        marks.append((k, 1, int(a == b)))
    train, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = {x.doc_id: x.score for x in toxicity.score(train, toxicity.fit(train, labels)).collect()}
    held = [k for k in scored if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scored[k] >= 0.5) == marks[k][2] for k in held]) > 0.9


@pytest.mark.parametrize("block", [512, 7])
def test_pairs_against_all_pairs(monkeypatch, block):
    """Pairs of features that the probabilities don't explain, some with far more than 128 others in their rows, against a plain loop over all pairs."""
    from quillon.llm import models

    monkeypatch.setattr(models, "PAIR_BLOCK", block)
    r = np.random.default_rng(3)
    x = r.random((600, 240)) < r.uniform(0.05, 0.95, 240)
    p = r.uniform(0.05, 0.6, 600)
    y = (r.random(600) < p).astype(np.int64)
    for a, b, to in ((3, 200, 1), (77, 150, 0), (9, 239, 1), (200, 201, 0)):
        x[:, [a, b]] = r.random((600, 2)) < 0.5
        y[x[:, a] & x[:, b]] = to
    x[:, 10], x[:, 11] = x[:, 3], np.arange(600) < 29
    want = np.zeros(250, bool)
    for a in range(240):
        for b in range(a):
            m = x[:, a] & x[:, b]
            if m.sum() >= 30 and abs((y - p)[m].sum()) >= 6 * np.sqrt((p * (1 - p))[m].sum() + 0.25):
                want[[a, b]] = a != 20 and b != 20
    rows, feats = np.nonzero(x)
    usable = np.arange(250) != 20
    got = models.paired(rows, feats, y, p, usable)
    assert 4 < want.sum() < 240 and (got == want).all()
    assert not models.paired(rows[:0], feats[:0], y, p, usable).any()


def test_most_z_against_all_choices():
    from quillon.llm import models

    r = np.random.default_rng(5)
    for _ in range(20):
        x = r.random((9, 4)) < 0.7
        x[:, 3] = False
        gain, var = r.normal(0, 1, 9), r.uniform(0, 0.25, 9) * r.integers(0, 2, 9)
        got = models.most_z(*np.nonzero(x), gain, var, 4)
        for f in range(4):
            chosen = [[d for k, d in enumerate(np.flatnonzero(x[:, f])) if bits >> k & 1] for bits in range(1 << x[:, f].sum())]
            assert abs(got[f] - max(gain[c].sum() / np.sqrt(var[c].sum() + 0.25) for c in chosen)) < 1e-9


def test_sample_is_bounded_where_ids_repeat(spark):
    from quillon.llm import terms

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other"), (3, "more")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    found = terms.sample(docs, labels, "toxic", "doc_id", "text", 10)
    assert found.where("y = 1").count() in (0, 50) and terms.bounded(found, "text", per_label=10).where("y = 1").count() <= 10


@pytest.mark.parametrize(("name", "column", "best"), [("op2_toxicity", "toxic", 0.80), ("op7_quality_classifier", "quality", 0.95)])
def test_queries_on_held_out_labels(spark, data, name, column, best):
    """Held-out accuracy of the queries themselves, at the middle size of the test tables."""
    folder = data.replace("sf0.001", "sf0.01")
    got = corpus.QUERIES[name](spark, folder).collect()
    marks = {r.doc_id: r[column] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if column == "toxic" else 0.3)) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > best


def test_quality_classifier(spark, docs, empty):
    train, labels = labelled(spark, lambda k: " | ".join(prose(k, 40).split()) + " %%% " + prose(k, 3).upper())
    model = quality_model.fit(train, labels)
    scored = {r.doc_id: r.score for r in quality_model.score(train, model).collect()}
    held = [k for k in scored if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scored[k] >= 0.3) == (k % 3 != 0) for k in held]) > 0.97
    rows = quality_model.score(docs, model).collect()
    assert len(rows) == len(texts()) and all(0 <= r.score <= 1 for r in rows) and set(docs.columns) == set(rows[0].asDict())
    # Pooling and the network by their definitions, word by word.
    for r in rows[:6]:
        raw = (r.text or "").encode()
        buckets, _ = quality_model.word_buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        x = np.mean([model.table[b] for b in buckets], 0) if len(buckets) else np.zeros(model.table.shape[1])
        h = np.tanh(np.clip((x - model.net.mean) / model.net.scale, -8, 8) @ model.net.a + model.net.ab)
        assert abs(r.score - 1 / (1 + np.exp(-(h @ model.net.b + model.net.bb) / model.net.temperature))) < 1e-4
    assert quality_model.score(empty, model).count() == 0 and quality_model.fit(train, labels.limit(0)) is None


def test_word_vectors_by_brute_force(spark):
    rows = [prose(k, 12) for k in range(7)] + [None, "", "a a A!"]
    index = quality_model.index_vectors()
    total = index.astype(float).copy()
    for t in rows:
        raw = (t or "").encode()
        b = quality_model.word_buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        for i in range(len(b)):
            for j in range(max(0, i - 2), min(len(b), i + 3)):
                if i != j:
                    total[b[i]] += index[b[j]]
    want = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-6)
    got = quality_model.word_vectors(spark.createDataFrame([(t,) for t in rows], "text string").repartition(3))
    assert np.allclose(got, want, atol=1e-5)


# --- mixing

def test_mixing_rates_meet_targets(spark):
    rows = [(k, prose(k, 40) if k % 4 else " ".join(w[::-1] for w in prose(k, 30).split()), "en" if k % 4 else "de") for k in range(400)] + [(400, None, "en"), (401, "", "de"), (None, prose(1, 9), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    out = mixing.mix(docs, docs.select("doc_id", "domain"), {"en": 0.5, "de": 0.5}).collect()
    assert len(out) == len(rows) and all(r.rate >= 0 for r in out)
    p = np.array([r.p for r in out])
    t = np.array([r.n_words for r in out], float)
    share = (np.array([r.rate for r in out]) * t) @ p / t.sum()
    assert np.abs(share - 0.5).max() < 0.05
    # The same fit, by plain projected gradient on all rows at once.
    w = np.ones(len(t))
    for _ in range(mixing.STEPS):
        r = (w * t) @ p / t.sum() - 0.5
        w = np.maximum(w - 1.2 / (1 + mixing.RIDGE) * (p @ r + mixing.RIDGE * (w - 1)), 0)
    assert np.allclose(w, [r.rate for r in out], atol=1e-6)
    clash = docs.select("doc_id", "text", F.lit(1).alias("rate"), F.lit(2).alias("soft"), F.lit(3).alias("copy"))
    taken = mixing.resample(clash, docs.select("doc_id", "domain"), {"en": 0.5, "de": 0.5})
    assert taken.columns == clash.columns
    # Each row as often as the rate of its text says.
    want = Counter({r.doc_id: r.copies for r in out if r.copies and r.doc_id is not None})
    assert Counter(r.doc_id for r in taken.collect() if r.doc_id is not None) == want
    bare = mixing.mix(docs, docs.select("doc_id", "domain").limit(0), {"en": 0.5, "de": 0.5}).collect()
    assert {r.rate for r in bare} == {1.0} and {r.copies for r in bare} == {1} and Counter(r.n_words for r in bare) == Counter(len(WORD.findall(x[1] or "")) for x in rows)


def test_mixing_with_text_ids_and_repeated_ones(spark):
    rows = [(f"d{k}", prose(k, 40) if k % 4 else " ".join(w[::-1] for w in prose(k, 30).split()), "en" if k % 4 else "de") for k in range(60)] + [("d1", prose(900 + k, 30), "en") for k in range(80)] + [(None, None, "de"), (None, "", "de")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, domain string")
    model = mixing.fit_domains(docs, docs.select("doc_id", "domain").distinct(), ["de", "en"], per_domain=20)
    assert model is not None
    out = mixing.mix(docs, docs.select("doc_id", "domain").distinct(), {"en": 0.5, "de": 0.5}).collect()
    assert len(out) == len(rows) and Counter(r.doc_id for r in out) == Counter(i for i, _, _ in rows)


def test_mixing_rare_and_absent_domains(spark):
    r = np.random.default_rng(8)
    pure = np.array([[0.96, 0.02, 0.01, 0.01], [0.02, 0.96, 0.01, 0.01], [0.01, 0.01, 0.97, 0.01], [0.01, 0.01, 0.01, 0.97]])
    want, cols = np.array([0.2, 0.5, 0.13, 0.17]), "n_words long, p array<double>"
    natural = [np.repeat(np.arange(4), n) for n in ([50, 910, 20, 20], [170, 810, 0, 20])]
    for kinds in natural:
        words = r.integers(20, 60, len(kinds))
        soft = spark.createDataFrame([(int(n), pure[d].tolist()) for n, d in zip(words, kinds)], cols).repartition(3).cache()
        with (pytest.warns(UserWarning, match=r"\[2\]") if 2 not in kinds else nullcontext()):
            residuals, step, *pull = mixing.fit_rates(soft, want.tolist())
        rates = mixing.rates_of(pure[kinds], residuals, step, mixing.RIDGE, *pull)
        share = (rates * words) @ pure[kinds] / words.sum()
        met = np.isin(np.arange(4), kinds)  # a domain without documents can't be met, and doesn't spoil the others
        assert np.abs(share / want - 1)[met].max() <= 0.02
        assert rates.min() >= 0 and rates.max() < 20


# --- HTML

def test_html_extraction(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">Menu two</a></li></ul></nav><div class="cookie-notice">We use cookies. Accept them all.</div>'
        "<article><h1>Head &amp; line</h1><p>First <b>bold</b>\n  words of the river, which is long enough to be an article part.</p><p>Second part goes on, &eacute;tude and more,<br>after a break with words. It has sentences.</p></article>"
        '<aside class="sidebar"><h3>More</h3><p>Read this too.</p></aside><section id="comments"><div class="comment"><p>Nice post, thank you.</p></div></section><form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>'
    )
    df = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", page, "x")], "page_id long, url string, html string, text string")
    rows = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    want = "Head & line First bold words of the river, which is long enough to be an article part. Second part goes on, étude and more, after a break with words. It has sentences."
    assert rows == [(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)]
    same = html_extract.extract(df, keep=("page_id", "text", "N_CHARS", "url") if "N_CHARS" in df.columns else ("page_id", "text", "url"))
    assert same.columns == ["page_id", "url", "text", "n_chars"] and sorted((r.page_id, r.text, r.n_chars) for r in same.collect()) == rows


def test_html_query_on_pages_read_by_hand(spark, data):
    """In these pages, read one by one, the article element is the article, whole, and nothing else is."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r.page_id: r for r in html_extract.op1_html_extraction(spark, data).collect()}
    assert set(got) == set(pages)
    import html

    for i, source in pages.items():
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = [html.unescape(re.sub(r"<[^>]*>", "", b)) for b in re.split(r"</?(?:p|h1|br|ul|li|div)[^>]*>", re.sub(r"<!--.*?-->", "", inner, flags=re.S))]
        want = " ".join(" ".join(b.split()) for b in blocks if b.split())
        assert got[i].text == want and got[i].n_chars == len(want), i


@pytest.mark.parametrize(("source", "want"), [
    ('<body><div id="menu"><a href=/>Home</a> <a href=/b>Blog</a></div><div class="post-body"><h2>A storm</h2><p>The storm came at night, and it took the roof of the old mill with it.<p>Nobody was hurt. The miller said so, twice.</div><div class="related-posts"><ul><li><a href=/x>More storms</a></ul></div></body>', "A storm The storm came at night, and it took the roof of the old mill with it. Nobody was hurt. The miller said so, twice."),
    ('<header class=masthead><h1>The Daily</h1></header><main><article><h1>Rates</h1><p>Rates rise again, says the bank; loans get dearer for all of us.</p><p>It is the third time this year.</p></article></main><div class="comments"><div class="comment"><p>I knew it.</p></div></div><footer><p>&copy; The Daily</p></footer>', "Rates Rates rise again, says the bank; loans get dearer for all of us. It is the third time this year."),
    ('<nav><ul><li><a href=/>One</a><li><a href=/2>Two</a></ul></nav><section class="story"><p title="a > b">The tide went out, and with it the boats that had lain there since spring.</p><script>var x = "<p>no</p>";</script><p>They came back &#233;ach evening &amp; rested.</p></section><aside class="sidebar"><p>Subscribe to our newsletter</p></aside>', "The tide went out, and with it the boats that had lain there since spring. They came back éach evening & rested."),
])
def test_html_pages_written_by_hand(source, want):
    assert next(html_extract.texts(html_extract.model(), [source])) == want


def test_html_time_is_linear():
    import time

    start = time.time()
    for bad in ("<a '" * 250000, "<a b='" * 160000, "<div>" * 40000 + "</p></b>" * 40000, "<b>" * 80000 + "<h1>" * 40000, "<a " * 300000, "<!--" * 250000, "</" * 400000, '<p title="x' * 90000, "<td><b>" * 40000, '<a x="<" y=\'' * 80000):
        html_extract.features(html_extract.Page(bad))
    assert time.time() - start < 60


def test_html_odd_markup():
    page = html_extract.Page('<p title=it\'s>x</p><p a="1>2">y</p>z<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><div data-g="x">q</div> a < b <c')
    assert page.text([True] * len(page.tag)) == "x y z a b 1 2 3 q a < b <c"
    assert html_extract.Page("a<!-->b--><!-- c -->d<?x?>e</ f>g<!doctype x>h").text([True]) == "ab-->degh"


def test_html_model_on_new_pages():
    trees, writer = html_extract.model(), html_extract.PageWriter(77)
    good = 0
    for _ in range(60):
        source = writer.page()
        page = html_extract.TrainingPage(source)
        keep = html_extract.decode(page, trees.raw(html_extract.features(page)))
        assert all(keep[page.parent[i]] or not keep[i] for i in range(1, len(keep)))
        good += page.text(keep) == page.text([g != 0 for g in page.gold])
    assert good >= 50


# --- WARC

def test_merkle_audit(spark):
    pages = [(i, f"http://x/{i}", f"<p>{prose(i, 50 + i)}</p>") for i in range(300)] + [(300, None, None), (301, "u", "")]
    good = warc.page_records(spark.createDataFrame(pages, "page_id long, url string, html string"), per_file=100).cache()
    rows = [tuple(r) for r in good.select("file", "offset", "length", "sha256").collect()]
    bad = [(f, o, n, "0" * 64 if k in (5, 77) else s) for k, (f, o, n, s) in enumerate(rows) if k != 120] + [("part-00000009.warc", 0, 5, "1" * 64)]
    schema = "file string, offset long, length long, sha256 string"
    a, b = spark.createDataFrame(rows, schema), spark.createDataFrame(bad, schema)
    got = sorted((r.file, r.offset, r.status) for r in warc.audit(a, b, span=2048, fan=4).collect())
    assert got == sorted([(*rows[5][:2], "corrupt"), (*rows[77][:2], "corrupt"), (*rows[120][:2], "missing"), ("part-00000009.warc", 0, "extra")])
    assert warc.audit(a, a).count() == 0 and warc.audit(a.limit(0), a.limit(0)).count() == 0
    assert warc.audit(a, b.limit(0)).count() == len(rows)


def test_fixity_query_with_null_and_repeated_ids(spark, tmp_path):
    """The query against its definition, with ids that are null, repeated, and with one that fills several files."""
    rows = [(i, f"http://x/{i}", f"<p>{prose(i, 20)}</p>") for i in range(1300)] + [(None, f"u{k}", f"n{k % 3}") for k in range(40)] + [(13, "u", f"r{k}") for k in range(5000)] + [(13, "u", "same")] * 30 + [(7, None, None), (110, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(f"file://{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.status, r.sha256, r.length) for r in warc.op8_warc_fixity(spark, f"file://{tmp_path}").collect())

    def text(url, html):
        url, html = url or "", html or ""
        n = "\r\n"
        return f"WARC/1.0{n}WARC-Type: resource{n}WARC-Date: 2024-01-01T00:00:00Z{n}WARC-Record-ID: <urn:sha256:{hashlib.sha256((url + chr(10) + html).encode()).hexdigest()}>{n}WARC-Target-URI: {url}{n}Content-Type: text/html{n}Content-Length: {len(html.encode())}{n}{n}{html}{n}{n}".encode()

    want = Counter()
    for i, url, html in rows:
        status = None if i is None else "missing" if i % 101 == 7 else "corrupt" if i % 97 == 13 and html and html[0] != "#" else None
        if status:
            want[i, status, hashlib.sha256(text(url, html)).hexdigest(), len(text(url, html))] += 1
    assert got == want
    records = warc.page_records(spark.read.parquet(f"file://{tmp_path}/pages.parquet"))
    assert records.count() == len(rows) == records.select("file", "offset").distinct().count()
    assert records.groupBy("file").count().agg(F.max("count")).first()[0] < 3000


def test_warc_reader_goes_by_content_length(spark, tmp_path):
    import gzip

    def make(uri, body, extra=""):
        return f"WARC/1.0\r\nWARC-Target-URI: {uri}\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    bodies = [b"<p>s\r\n\r\nWARC/1.0\r\nWARC-Target-URI: fake\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", b"\xff\xfe\x00binary", b"", bytes(range(256)) * 9000]
    whole = b"".join(make(f"u{k}", b, "".join(f"X-{i}: {i}\r\n" for i in range(150)) + "X-Long: a\r\n b\r\n") for k, b in enumerate(bodies))
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(make(f"u{k}", b)) for k, b in enumerate(bodies)))
    (tmp_path / "c.warc").write_bytes(b"garbage\r\n" + make("u0", b"x") + make("u1", b"yy")[:-6])
    (tmp_path / "d.warc").write_bytes(b"")
    rows = warc.read_files(spark, f"file://{tmp_path}/*").collect()
    for name in ("a.warc", "b.warc.gz"):
        got = sorted((r.offset, r.uri, bytes(r.body)) for r in rows if r.file.endswith(name))
        assert [(u, b) for _, u, b in got] == [(f"u{k}", b) for k, b in enumerate(bodies)]
    one = next(r for r in rows if r.file.endswith("a.warc") and r.uri == "u0")
    assert one.headers["X-149"] == "149" and one.headers["X-Long"] == "a b" and (one.offset, one.length) == (0, whole.index(b"WARC/1.0\r\nWARC-Target-URI: u1"))
    odd = sorted((r.offset, r.uri, bytes(r.body)) for r in rows if r.file.endswith("c.warc"))
    assert odd[0] == (0, None, b"garbage\r\n") and odd[1][1:] == ("u0", b"x") and odd[2][1] is None and len(odd) == 3


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>\r\n\r\ny"), (2, "http://b", ""), (3, None, None)], "page_id long, url string, html string")
    records = pages.select(warc.record(F.col("url"), F.col("html")).alias("record"))
    warc.write_files(records, f"file://{tmp_path}/w")
    want = sorted([("http://a", "<p>x</p>\r\n\r\ny"), ("http://b", ""), ("", "")])
    back = warc.read_files(spark, f"file://{tmp_path}/w/part-*")
    assert sorted((r.uri, bytes(r.body).decode()) for r in back.collect()) == want
    many = records.select(F.regexp_replace("record", "\r\nWARC-Date", "".join(f"\r\nX-{k}: {k}" for k in range(120)) + "\r\nWARC-Date").alias("record"))
    parsed = warc.parse(many.withColumn("uri", F.lit("clash"))).collect()
    assert sorted((r.uri, r.body) for r in parsed) == want and all(r.headers["X-119"] == "119" for r in parsed)
    first = records.first()[0].encode()
    assert hashlib.sha256(first).hexdigest() == records.select(F.sha2("record", 256)).first()[0]
