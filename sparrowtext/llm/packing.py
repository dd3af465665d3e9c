"""Best-fit packing by linear grouping.

Documents become token pieces of at most `capacity`. Only the histogram of piece lengths, at most
`capacity` rows, reaches the driver; there the plan is made:

1. large lengths (over large_share of the capacity) are dealt into groups of equal cardinality
   and each is rounded up to its group's largest;
2. for these few sizes the best mix of bin configurations is found by column generation (a linear
   programme over configurations, priced by an unbounded knapsack), rounded down;
3. the configurations' slots are given to the actual lengths of the group, which leaves more room;
4. what is left of the large, and then all small lengths, are placed by best fit, longest first.

The plan has runs "ranks r0.. of length l go to bins b.., m to a bin, at offset o". Each piece
finds its run by its rank among pieces of equal length. Ranks come from counts by (length, hash
bucket), so a length that a third of all pieces share is ranked in many tasks.

Edge cases: null text is empty, one end token; pieces of full capacity fill a sequence alone; rows
with equal ids are pieces of their own; null ids are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, shuffle_partitions


class WordEncoder:
    """Token ids of whole texts. The tokenizer never merges across ASCII white space, so each
    distinct word is encoded once and looked up afterwards; the memory of words is bounded.

    Merging new words is the costly part. If the file is a byte-level BPE with word ends whose ids
    follow the order of its merges, words of Latin letters are merged by rank with tiktoken: a word
    end is one more byte, 0xFF, which no UTF-8 text holds, and joins its letter before any other
    merge. All other words, and all words of other tokenizers, go through `tokenizers` itself.
    """

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str, remember: int = 800_000):
        import json

        from tokenizers import Tokenizer

        self.tok, self.remember, self.ids = Tokenizer.from_file(path), remember, {}
        with open(path, encoding="utf-8") as f:
            self.fast = self._by_rank(json.load(f))

    def _by_rank(self, spec: dict):
        model, end = spec["model"], "</w>"
        steps = [(x["type"], x.get("pattern", {}).get("Regex")) for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        norm = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") != end or norm != ["NFC", "Replace", "Lowercase"] or steps != [("Split", self.PIECES), ("ByteLevel", None)]:
            return None
        import regex
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {x["content"] for x in spec["added_tokens"]}
        vocab = model["vocab"]
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        order = [vocab["".join(x)] for x in merges]
        if order != sorted(set(order)) or any(vocab[c] >= order[0] or vocab[c + end] >= order[0] for c in chars):
            return None
        ranks = {bytes(chars[c] for c in t.removesuffix(end)) + b"\xff" * t.endswith(end): i for t, i in vocab.items() if t not in special}
        ranks.setdefault(b"\xff", max(vocab.values()) + 1)
        bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(self.PIECES)
        return bpe._core_bpe.encode_single_piece

    def _new(self, words: list[bytes]) -> None:
        import re
        import sys
        import unicodedata
        from array import array

        assert sys.byteorder == "little" and array("I").itemsize == 4
        odd = re.compile("[\u0130\u0250-\U0010ffff]").search
        if len(self.ids) + len(words) > self.remember:
            self.ids.clear()
        slow, one = [], self.fast
        for raw in words:
            w = raw.decode("utf-8", "replace")
            if not one or "<|" in w or not w.isascii() and odd(w):
                slow.append((raw, w))
                continue
            w = (w if w.isascii() else unicodedata.normalize("NFC", w)).lower()
            got = one(w.encode() + b"\xff") if w.isalpha() else [i for p in self.split.findall(w) for i in one(p.encode() + b"\xff")]
            self.ids[raw] = array("I", got).tobytes()
        for at in range(0, len(slow), 4096):
            for (raw, _), e in zip(slow[at : at + 4096], self.tok.encode_batch([w for _, w in slow[at : at + 4096]], add_special_tokens=False)):
                self.ids[raw] = array("I", e.ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        words, out = text.encode("utf-8", "replace").split(), []
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            try:
                out.append(b"".join(map(self.ids.__getitem__, part)))
            except KeyError:
                self._new([w for w in dict.fromkeys(part) if w not in self.ids])
                try:
                    out.append(b"".join(map(self.ids.__getitem__, part)))
                except KeyError:  # the memory was just cleared
                    self._new([w for w in dict.fromkeys(part) if w not in self.ids])
                    out.append(b"".join(map(self.ids.__getitem__, part)))
        return b"".join(out)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a Python worker, kept over its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32. Only texts go to Python; ids stay where they are."""

    form = pa.list_(pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]))
    ship(docs.sparkSession)

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def pieces_of(texts: pa.Array) -> pa.Array:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, end, out = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), []
        for text in texts:
            ids = enc.encode(text.as_py() or "") + end
            parts = (ids[at : at + 4 * capacity] for at in range(0, len(ids), 4 * capacity))
            out.append([{"piece": i, "start": i * capacity, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} for i, p in enumerate(parts)])
        return pa.array(out, form)

    # outer, as the plain form makes Spark tokenize a second time, to filter empty arrays; none is empty
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.inline_outer(pieces_of(F.col(text_col))))


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], int]]:
    """Patterns (items of each size) and how many bins use each: the LP optimum by column
    generation, rounded down; sizes descend."""
    import numpy as np

    m, s, d = len(sizes), np.array(sizes), np.array(demand, float)
    cols = np.diag([capacity // x for x in sizes]).astype(float)
    x = d / cols.diagonal()
    for _ in range(rounds):
        y = np.linalg.solve(cols.T, np.ones(m))
        # unbounded knapsack: the pattern of the largest dual value
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(s.min()), capacity + 1):
            v = np.where(s <= c, y + best[np.maximum(c - s, 0)], -1.0)
            j = int(v.argmax())
            best[c], pick[c] = (v[j], j) if v[j] > best[c - 1] + 1e-12 else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        a, c = np.zeros(m), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                a[pick[c]] += 1
                c -= sizes[pick[c]]
        u = np.linalg.solve(cols, a)
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        r = int(ratio.argmin())
        cols[:, r] = a
        x = np.linalg.solve(cols, d)
        x[x < 0] = 0
    return [([int(v) for v in cols[:, j]], int(x[j] + 1e-9)) for j in range(m) if int(x[j] + 1e-9)]


def plan(histogram: dict[int, int], capacity: int = 2048, shares: tuple[float, ...] = (1 / 2, 1 / 3), groups: int = 40) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plan of fewest bins over the given bounds of what is large; see plan_with."""
    return min((plan_with(histogram, capacity, x, groups) for x in shares), key=lambda p: p[1])


def plan_with(histogram: dict[int, int], capacity: int, large_share: float, groups: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, items a bin, first bin, offset) and the number of bins.

    In the run, rank r0 + q goes to bin first + q // m, at offset + (q % m) * length.
    """
    left = {n: c for n, c in histogram.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is out of bounds")
    bins: list[tuple[int, list[tuple[int, int]]]] = []  # (how many bins, [(length, items)])
    if full := left.pop(capacity, 0):
        bins.append((full, [(capacity, 1)]))
    large = sorted((n for n in left if n > large_share * capacity), reverse=True)
    filled: list[tuple[int, list[tuple[int, int]]]] = []
    if large:
        total, run, group_of, tops, demand = sum(left[n] for n in large), 0, [], [], []
        for n in large:  # groups of equal cardinality; a length stays in one group
            g = min(groups - 1, run * groups // total)
            if not group_of or group_of[-1][0] != g:
                group_of.append((g, []))
                tops.append(n)
                demand.append(0)
            group_of[-1][1].append([n, left[n]])
            demand[-1] += left[n]
            run += left[n]
        queue = [g for _, g in group_of]
        for pattern, many in configurations(tops, demand, capacity):
            while many:
                slots = [(j, k) for j, k in enumerate(pattern) if k]
                if any(sum(c for _, c in queue[j]) < k for j, k in slots):
                    break
                whole = min(queue[j][0][1] // k for j, k in slots)
                n = min(many, whole) or 1
                content: list[tuple[int, int]] = []
                for j, k in slots:
                    need = k
                    while need:
                        length, count = queue[j][0]
                        take = min(need, count // n)
                        content.append((length, take))
                        left[length] -= n * take
                        queue[j][0][1] -= n * take
                        need -= take
                        if not queue[j][0][1]:
                            queue[j].pop(0)
                filled.append((n, content))
                many -= n
    room: list[tuple[int, int, int]] = []  # (room, index of open, bins), sorted
    opened: list[tuple[int, list[tuple[int, int]]]] = []

    def put(n: int, content: list[tuple[int, int]], rest: int) -> None:
        if n:
            opened.append((n, content))
            insort(room, (rest, len(opened) - 1, n))

    for n, content in filled:
        put(n, content, capacity - sum(a * b for a, b in content))
    for length in sorted((n for n in left if left[n]), reverse=True):
        count = left[length]
        while count:
            at = bisect_left(room, (length,))
            if at == len(room):
                k = capacity // length
                put(count // k, [(length, k)], capacity - k * length)
                put(int(count % k > 0), [(length, count % k)], capacity - count % k * length)
                break
            rest, i, n = room.pop(at)
            content = opened[i][1]
            k = rest // length  # best fit stays with a bin until nothing more fits
            fit = min(n, count // k)
            put(fit, [*content, (length, k)], rest - k * length)
            count -= fit * k
            some = count if fit < n and count < k else 0
            put(int(some > 0), [*content, (length, some)], rest - some * length)
            count -= some
            put(n - fit - (some > 0), content, rest)
    bins += [(n, opened[i][1]) for _, i, n in room]
    runs, rank, first = [], dict.fromkeys(histogram, 0), 0
    for n, content in bins:
        offset = 0
        for length, k in content:
            runs.append((length, rank[length], k, first, offset))
            rank[length] += n * k
            offset += length * k
        first += n
    assert rank == {n: c for n, c in histogram.items()}, "the plan must place every piece"
    return sorted(runs), first


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, **how) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    import numpy as np

    spark = docs.sparkSession
    pieces = cut(tokenized(docs, tokenizer, capacity, **how), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity)
    keys = np.array([n << 44 | r0 for n, r0, *_ in runs], np.int64)
    rest = np.array([x[1:] for x in runs], np.int64).reshape(-1, 4)
    sent = spark.sparkContext.broadcast((keys, rest))  # its size hangs on the capacity only
    most = max([n for k, n in histogram.items() if k < capacity], default=0)
    buckets = max(1, -(-most // max(500, sum(histogram.values()) // (4 * shuffle_partitions(spark)))))
    order = ("doc_id", "piece", "ids_crc32")
    dealt = pieces.where(F.col("length") < capacity).withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece, ids_crc32), {buckets})")) if buckets > 1 else pieces.withColumn("bucket", F.lit(0).cast("long"))
    whole = pieces.where(F.col("length") == capacity).withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece), {max(1, histogram.get(capacity, 0) // 500)})"))
    dealt = dealt.where(F.col("length") < capacity).union(whole)
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("length", "bucket", before.alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)) - 1)
    ranked = ranked.join(sums, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        keys, rest = sent.value
        length, rank = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank))
        at = np.searchsorted(keys, length << 44 | rank, "right") - 1
        r0, m, first, offset = rest[at].T if len(at) else np.empty((4, 0), np.int64)
        q = rank - r0
        return pa.StructArray.from_arrays([pa.array(first + q // m), pa.array(offset + q % m * length)], ["sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", place("length", F.col("rank").cast("long")).alias("x")).select("doc_id", "piece", "start", "length", "ids_crc32", "x.sequence_id", "x.offset")
