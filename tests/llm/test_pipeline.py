"""The pipeline's stages, one on the other, each against a brute-force version on its own input."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from pyspark.sql import functions as F  # noqa: E402

from quillon.llm import mixing, packing, registry, toxicity  # noqa: E402
from quillon.llm.quality_rules import RULES, STOP_WORDS  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def good(t):
    """The quality rules, word by word."""
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    if len(w) < 20 or 100 * len(hit) > 30 * len(w):
        return False
    m = {"word_chars": sum(map(len, w)), "n_words": len(w), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_shouts": t.count("!"), "n_stop_words": sum(x.lower() in STOP_WORDS for x in w), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines))}
    return all((least is None or m[a] / m[b] >= least) and (most is None or m[a] / m[b] <= most) for _, a, b, least, most in RULES)


def one_of_each(rows):
    """Ids that stay: the least of each class of linked texts; all without words."""
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    where = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, (_, s) in enumerate(sets):
        for j in {j for g in s for j in where[g] if j < k}:
            both = len(s & sets[j][1])
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                a, b = sorted((root(k), root(j)))
                up[b] = a
    least = {}
    for k, (i, s) in enumerate(sets):
        if s:
            least[root(k)] = min(i, least.get(root(k), i))
    return {i for k, (i, s) in enumerate(sets) if not s or least[root(k)] == i}


def test_stages_against_brute_force(spark, data):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{data}/labels.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "toxicity", "near duplicates", "mixing", "packing"]
    at = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        at[name] = docs
        docs = stage(spark, docs, data)
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        docs = docs.cache()
        assert docs.count() > 0
    at["end"] = docs
    names = [n for n, _ in pipeline.STAGES] + ["end"]
    got = {n: Counter(r.doc_id for r in at[n].select("doc_id").collect()) for n in names}
    assert set(got["toxicity"]) == {r.doc_id for r in at["quality rules"].collect() if good(r.text)}
    model = toxicity.fit(at["toxicity"], labels)
    scores = {}
    for r in at["toxicity"].collect():
        raw = (r.text or "").encode()
        seen = [b for b in set(toxicity.doc_terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1].tolist()) if model is not None and model.seen[b]]
        scores[r.doc_id] = 0.0 if model is None else float(model.w0) + sum(float(model.w[b]) for b in seen) + sum(float(model.v[x] @ model.v[y]) for i, x in enumerate(seen) for y in seen[:i])
    assert set(got["near duplicates"]) == {i for i, s in scores.items() if model is None or s < 0}
    assert set(got["mixing"]) == one_of_each([(r.doc_id, r.text) for r in at["near duplicates"].collect()]) and max(got["mixing"].values()) == 1
    ids = labels.select("doc_id").distinct()
    known = at["mixing"].select("doc_id", F.col("lang").alias("domain")).join(ids, "doc_id", "left_semi")
    assert got["packing"] == Counter({r.doc_id: r.copies for r in mixing.mix(at["mixing"], known).collect() if r.copies})
    tk, want, places = Tokenizer.from_file(packing.default_vocabulary()), Counter(), {}
    for r in at["packing"].collect():
        ids_ = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for p, a in enumerate(range(0, len(ids_), 4096)):
            want[r.doc_id, p, a, len(ids_[a : a + 4096]), zlib.crc32(ids_[a : a + 4096].tobytes())] += 1
    end = at["end"].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in end) == want
    for r in end:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        stop = 0
        for offset, n in sorted(parts):
            assert offset == stop
            stop += n
        assert stop <= 4096
    bound = -(-sum(r.length for r in end) // 4096)
    assert len(places) <= bound + max(1, bound // 100)


def test_run_returns_the_last_stage(spark, data):
    out = pipeline.run(spark, data)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def worker_mb(spark):
    """MB of each Python worker's own memory."""
    def run(batches):
        import os
        from pathlib import Path

        import pyarrow as pa

        for _ in batches:
            pass
        mb = int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
        yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([mb])], ["pid", "mb"])

    return {r["pid"]: r["mb"] for r in spark.range(0, 8, 1, 8).mapInArrow(run, "pid long, mb double").collect()}


def test_workers_get_bounded_batches_and_give_memory_back(spark, data):
    import pyarrow as pa

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(700)), lambda i: F.md5((F.col("doc_id") * 1000 + i).cast("string"))), " ")
    docs = spark.range(0, 3000, 1, 2).withColumnRenamed("id", "doc_id").withColumn("text", text)  # 70 MB in two tasks
    pipeline.packed(spark, docs, data)  # from here on the session's batches are bounded
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) > 60e6 and max(r["n"] for r in sizes) < 6e6
    pipeline.near_duplicates(spark, docs, data).write.format("noop").mode("overwrite").save()
    assert max(worker_mb(spark).values()) < 120
