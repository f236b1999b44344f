"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights.

Texts become token ids, an end id is appended, and only longer ones are cut into pieces of the sequence length. The plan
needs the histogram of piece lengths alone (at most `size` numbers): weights on the lengths shrink as a length gets covered,
a knapsack by dynamic programming finds the patterns of the greatest weight, and their amounts are scaled to a cover. Rounding: the whole
parts of the amounts are taken; what they leave is priced again by the same weights and knapsack, now in whole patterns that the
remaining pieces allow, full ones first, until nothing is left. So every sequence is a priced pattern. Patterns times multiplicities number all slots, and
the k-th piece of a length gets the k-th slot of that length.

The k comes without a single-task sort: a frequent length is split into hash buckets, as many as keep each bucket below a
sixteenth of a mean task; buckets are numbered apart and their counts (at most 4096 + 16 * 4096 numbers) added up.
Tokens are made once: pieces are written to the shared folder, and later steps read only numbers.

Null and empty texts are one piece of the end id. Repeated rows are packed each; ids may be null and of any type. An empty table packs to no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, blocks, hash_spans, lean, read, runs, slices, words
from .terms import fold

SIZE = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
CACHED = 1 << 18  # distinct words whose ids a worker keeps

# --- tokens ------------------------------------------------------------------------------------------------------


# Kinds of bytes in plain words; digits get two kinds in turn, as each is a token of its own before the merges.
_LETTER, _DIGIT, _MARK, _WHOLE = 1, 2, 4, 5
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_PLAIN = np.zeros(256, bool)  # bytes that may stand in a plain word
_PLAIN[:128] = _PLAIN[0xC3] = _PLAIN[0x80:0xC0] = True
_PLAIN[[*range(0, 9), *range(14, 32), 39, 60, 127]] = False  # controls, the apostrophe and the start of special tokens


def parts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, rows, whole): pieces of text that the vocabulary's own splitting never crosses.

    A word of ASCII and Latin-1 letters is lower-cased here and split into letter runs, digits and mark runs, as the vocabulary does;
    any other word (apostrophes, special tokens, other scripts, combining marks) is left whole for the library.
    """
    starts, ends, _ = words(data, off)
    ok = _PLAIN[data]
    if len(data) > 1:  # second bytes only behind C3, and not the two signs among the Latin-1 letters
        tail = (data[1:] >= 0x80) & (data[1:] < 0xC0)
        ok[1:] &= ~tail | ((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))
    bad = np.concatenate([[0], np.cumsum(~ok)])
    whole = np.flatnonzero(bad[ends] > bad[starts])
    kinds, text = _KIND[data], fold(data)
    kinds[(kinds == _DIGIT) & (np.arange(len(data)) & 1 == 1)] = _DIGIT + 1
    for i in whole.tolist():
        kinds[starts[i] : ends[i]] = _WHOLE
        text[starts[i] : ends[i]] = data[starts[i] : ends[i]]
    starts, ends, rows = runs(kinds, off)
    return text, starts, ends, rows, kinds[starts] == _WHOLE


class WordIds:
    """Ids of texts, by a cache of parts of words: equal parts have equal ids."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.first, self.size, self.flat, self.n, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0, 0

    def _put(self, hashes: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, used = self.n + len(hashes), self.used + len(ids)
        while n > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while used > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : used], self.size[self.n : n] = ids, sizes
        self.first[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.place.update(zip(hashes, range(self.n, n), strict=True))
        self.n, self.used = n, used

    def _add(self, hashes: list[int], texts: list[str], whole: bool) -> None:
        if whole:
            found = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []
            self._put(hashes, np.array([len(x) for x in found], np.int64), np.array([x for ids in found for x in ids], np.uint32))
            return
        for at in range(0, len(texts), 2000):  # many parts in one call; each part is one word of it
            e = self.tokenizer.encode(" ".join(texts[at : at + 2000]), add_special_tokens=False)
            sizes = np.bincount(np.array(e.word_ids, np.int64), minlength=len(texts[at : at + 2000]))
            self._put(hashes[at : at + 2000], sizes, np.array(e.ids, np.uint32))

    def rows(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each row's bounds in them."""
        if self.n > CACHED:
            self.clear()
        text, starts, ends, rows, whole = parts(data, off)
        h, at, back = np.unique(hash_spans(text, starts, ends) ^ whole.astype(np.uint64), return_index=True, return_inverse=True)
        raw = text.tobytes()
        for kind in (False, True):
            new = [(k, i) for k, i in zip(h[whole[at] == kind].tolist(), at[whole[at] == kind].tolist(), strict=True) if k not in self.place]
            self._add([k for k, _ in new], [raw[starts[i] : ends[i]].decode("utf-8", "replace") for _, i in new], kind)
        place = np.array([self.place[k] for k in h.tolist()], np.int64)[back] if len(h) else np.zeros(0, np.int64)
        sizes = self.size[place]
        before = np.cumsum(sizes) - sizes
        ids = self.flat[np.repeat(self.first[place] - before, sizes) + np.arange(int(sizes.sum()))]
        per_row = np.bincount(rows, sizes, len(off) - 1).astype(np.int64) if len(rows) else np.zeros(len(off) - 1, np.int64)
        return ids, np.concatenate([[0], np.cumsum(per_row)])


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process."""
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece; uid numbers rows (by task, so write the result before using it twice); with_ids: also the ids, packed."""
    end = np.array([end_id], "<u4").tobytes()
    numbers = {"uid": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int32(), "ids_crc32": pa.int64(), "ids": pa.binary()}

    def run(batches):
        uid = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            rows, out = [], defaultdict(list)
            for lo, hi, data, off in blocks(b.column("text")):
                ids, bound = word_ids(path).rows(data, off)
                ids = ids.astype("<u4")
                for i in range(hi - lo):
                    row, piece = ids[bound[i] : bound[i + 1]].tobytes() + end, 0
                    for at in range(0, len(row), 4 * size):
                        part = row[at : at + 4 * size]
                        rows.append(lo + i)
                        for k, v in (("uid", uid), ("piece", piece), ("start", at // 4), ("length", len(part) // 4), ("ids_crc32", zlib.crc32(part))):
                            out[k].append(v)
                        if with_ids:
                            out["ids"].append(part)
                        uid, piece = uid + 1, piece + 1
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), *(pa.array(v, numbers[k]) for k, v in out.items())], ["id", *out])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = {"uid": "long", "piece": "int", "start": "long", "length": "int", "ids_crc32": "long"} | ({"ids": "binary"} if with_ids else {})
    return texts.mapInArrow(lean(run), texts.select("id", *(F.lit(None).cast(t).alias(c) for c, t in columns.items())).schema)


# --- plan --------------------------------------------------------------------------------------------------------


LONG_FIRST = 0.1  # how much more a token is worth in the longest piece than in the shortest: long pieces are the hardest to place


def knapsack(value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: the most value in c tokens, lengths usable any number of times; last[c]: a length that gives it (0: one token is left out)."""
    worth = np.where(value > 0, value, -np.inf)
    last, got = np.zeros(size + 1, np.int64), np.empty(size)
    back = np.zeros(size + 1)  # best, from the greatest room to none: the rooms that lengths 1, 2, ... leave lie in a row
    for c in range(1, size + 1):
        np.add(back[size - c + 1 :], worth[1 : c + 1], out=got[:c])
        j = int(got[:c].argmax())
        if got[j] > back[size - c + 1]:
            back[size - c], last[c] = got[j], j + 1
        else:
            back[size - c] = back[size - c + 1]
    return back[::-1].copy(), last


def _fill(last: np.ndarray, room: int) -> dict[int, int]:
    out: dict[int, int] = {}
    while room > 0:
        if last[room]:
            out[int(last[room])] = out.get(int(last[room]), 0) + 1
            room -= int(last[room])
        else:
            room -= 1
    return out


def fractional(counts: np.ndarray, size: int, rounds: int = 80, at_once: int = 256, eta: float = 4.0, enough: float = 2.0, step: float = 0.5) -> dict[tuple, float]:
    """Amounts of patterns that cover the counts, by multiplicative weights. A pattern: ((length, copies), ...).

    A length's weight falls exponentially with the share of its pieces that is covered. Each round prices all lengths once
    (one dynamic program over a token's worth times the weight) and takes the best pattern around each of the least covered
    lengths, by half of what its scarcest length has. It ends when every length is covered `enough` times; amounts are then divided by
    the least cover, so that they cover every length.
    """
    have = np.flatnonzero(counts)
    if not len(have):
        return {}
    n = counts[have].astype(float)
    covered = np.zeros(len(have))
    where = np.zeros(size + 1, np.int64)
    where[have] = np.arange(len(have))
    amounts: dict[tuple, float] = defaultdict(float)
    for _ in range(rounds):
        value = np.zeros(size + 1)
        value[have] = have * (1 + LONG_FIRST * have / size) * np.exp(-eta * np.minimum(covered - covered.min(), 5.0)) + 1e-6 * have
        _, last = knapsack(value, size)
        for j in np.argsort(covered, kind="stable")[:at_once]:
            pattern = _fill(last, size - int(have[j]))
            pattern[int(have[j])] = pattern.get(int(have[j]), 0) + 1
            at = where[list(pattern)]
            copies = np.array(list(pattern.values()), float)
            amount = step * float(np.min(n[at] / copies))
            amounts[tuple(sorted(pattern.items(), reverse=True))] += amount
            covered[at] += amount * copies / n[at]
        if covered.min() >= enough:
            break
    scale = float(covered.min())
    return {p: x / scale for p, x in amounts.items()}


def _whole(value: np.ndarray, best: np.ndarray, last: np.ndarray, seed: int, left: np.ndarray, size: int) -> dict[int, int]:
    """The best pattern around a length, of no more pieces than are left."""
    pattern, room = {seed: 1}, size - seed
    while room > 0:
        x = int(last[room])
        if x and pattern.get(x, 0) >= left[x]:  # used up: the best one of the others
            have = np.flatnonzero(left[: room + 1])
            have = have[[pattern.get(k, 0) < left[k] for k in have.tolist()]]
            x = int(have[np.argmax(best[room - have] + value[have])]) if len(have) else -1
        if x < 0:
            break
        if x:
            pattern[x] = pattern.get(x, 0) + 1
        room -= x or 1
    return pattern


def rounded(amounts: dict[tuple, float], counts: np.ndarray, size: int, at_once: int = 128, eta: float = 0.5) -> list[tuple[tuple, int]]:
    """[(pattern, multiplicity)] that holds exactly the counted pieces.

    Whole parts first. Then, round by round, lengths are priced by what is left of them (and a little by length, since long pieces are the
    hardest to place) and the best pattern around each of the longest is taken if it wastes no more than `slack` tokens, which is 0 until
    full patterns become rare. A pattern is taken as often as a quarter of its scarcest length allows, once at least.
    """
    out, left = [], counts.astype(np.int64).copy()

    def take(pattern, times: int) -> None:
        for x, k in pattern:
            left[x] -= times * k
        out.append((pattern, times))

    for pattern, amount in sorted(amounts.items(), key=lambda x: (sum(a * b for a, b in x[0]) == size, x[0]), reverse=True):
        times = min([int(amount), *(int(left[x]) // k for x, k in pattern)])
        if times > 0:
            take(pattern, times)
    whole, slack = left.copy(), 0
    while left.any():
        have = np.flatnonzero(left)
        done = 1 - left[have] / whole[have]
        value = np.zeros(size + 1)
        value[have] = have * (1 + LONG_FIRST * have / size) * np.exp(-eta * (done - done.min()))
        best, last = knapsack(value, size)
        tried = taken = 0
        for seed in have[::-1][: min(at_once, max(8, len(have) // 16))].tolist():
            if left[seed]:
                tried += 1
                pattern = _whole(value, best, last, seed, left, size)
                if sum(x * k for x, k in pattern.items()) >= size - slack:
                    times = max(1, min(int(left[x]) // k for x, k in pattern.items()) // 4)
                    take(tuple(sorted(pattern.items(), reverse=True)), times)
                    taken += times
        if 4 * taken < tried:
            slack = 2 * slack + 1
    return out


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[tuple, int]]:
    """[(pattern, multiplicity)] that holds exactly the counted pieces: the rounded program."""
    return rounded(fractional(counts, size), counts, size)


class Slots:
    """Where the k-th piece of a length goes."""

    def __init__(self, patterns: list[tuple[tuple, int]], size: int):
        taken = np.zeros(size + 1, np.int64)
        rows, sequence = [], 0
        for pattern, times in patterns:
            offset = 0
            for length, copies in pattern:
                rows.append((length, int(taken[length]), sequence, copies, offset))
                taken[length] += times * copies
                offset += length * copies
            sequence += times
        self.n_sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.key = (table[:, 0] << 48) + table[:, 1]
        self.table = table

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = self.table[np.searchsorted(self.key, (length << 48) + rank, "right") - 1]
        k = rank - t[:, 1]
        return t[:, 2] + k // t[:, 3], t[:, 4] + k % t[:, 3] * length


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids): a row for each piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.table(pieces(docs, path, id_col, text_col, size, end_id, with_ids), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # one number for each length
        counts[r[0]] = r["count"]
    slots = Slots(plan(counts, size), size)

    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4096)
    most = max(1, -(-int(counts.sum()) // (16 * parts)))
    n_buckets = np.maximum(-(-counts // most), 1)
    first = np.cumsum(n_buckets) - n_buckets
    split = np.flatnonzero(n_buckets > 1)  # lengths that are worth more than one bucket
    buckets = F.coalesce(F.element_at(_int_map(split, n_buckets[split]), F.col("length")), F.lit(1))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("uid"), buckets.cast("long")).cast("int"))
    base = np.zeros(int(n_buckets.sum()), np.int64)
    for r in dealt.groupBy("length", "bucket").count().collect():  # at most size + 16 * parts numbers
        base[first[r["length"]] + r["bucket"]] = r["count"]
    base = np.cumsum(base) - base
    base = base - np.repeat(base[first], n_buckets)
    handle = spark.sparkContext.broadcast((slots, first, base))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")))

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches):
        slots, first, base = handle.value
        for b in batches:
            length, bucket, k = (np.asarray(b.column(c)).astype(np.int64) for c in ("length", "bucket", "k"))
            sequence, offset = slots.of(length, base[first[length] + bucket] + k - 1)
            cols = [b.column("id"), b.column("piece"), b.column("start"), pa.array(length), b.column("ids_crc32"), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(cols + ([b.column("ids")] if with_ids else []), names)

    columns = {"piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "sequence_id": "long", "offset": "long"} | ({"ids": "binary"} if with_ids else {})
    schema = ranked.select(F.col("id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in columns.items())).schema
    return ranked.mapInArrow(lean(run), schema)


def _int_map(keys: np.ndarray, values: np.ndarray):
    """A literal map of at most `size` entries."""
    if not len(keys):
        return F.create_map().cast("map<int,int>")
    return F.map_from_arrays(F.array(*[F.lit(int(k)) for k in keys]), F.array(*[F.lit(int(v)) for v in values]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_vocabulary())
