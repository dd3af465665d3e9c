"""Language-model scores by a probabilistic suffix tree that grows with the corpus.

The text is its words, lower-cased (A-Z), each followed by one space, then one end symbol; the tree
predicts it byte by byte. A context is the last 0 to DEPTH bytes, across word borders. It is a
candidate if it occurs `least` times in the training text, an absolute floor, so that the tree gains
contexts as the corpus grows. A candidate is retained if its distribution diverges from that of its
longest proper suffix: twice its count times the Kullback-Leibler divergence, a G statistic, must pass
the charge of ln(count) for each of its symbols (as in BIC); the suffixes of retained contexts stay,
too, and candidates of up to SHALLOW bytes always. Distributions are smoothed from suffix to context: p(x|c) = (n(x|c) + d *
p(x|suffix(c))) / (n(c) + d), with d twice the number of symbols seen after c (Witten-Bell, doubled),
and the root is smoothed to uniform. A byte is scored in the longest retained suffix of what precedes it.

The tree is never in one place. A window is a context of DEPTH bytes, nearest byte first, with the byte
after it. Each task cuts its documents into chunks and writes, for each chunk, its distinct windows with their
training counts (0 if only held-out text has them), sorted, compressed and dealt by a hash of the SHALLOW + 1 nearest bytes: of one
such bucket all contexts that are longer than SHALLOW have all their windows there. So each bucket builds its part of the tree by itself, from its
windows of all chunks and the table of contexts of up to SHALLOW bytes (at most 2^24 numbers whatever the
corpus, the one thing that is sent to all), and gives every window its probability; the chunks' windows
look theirs up, and each chunk is scored with its own. A bucket has distinct windows only, so a common passage or a hot
source is as small as any; where the chunks' windows of a bucket are many, they are merged and looked up in parts (`salts`).

The base is unigram with add-one smoothing over words. Its counts grow with the corpus and are
never sent to one place: each chunk has its words and their training counts once, a window over each word sums
them and sends the sum back to the chunks' word numbers. A word has no more rows than there are chunks.

Edge cases: null text is empty, its one token the end; null doc_id is in training (its text "" has
no remainder of 2) and is not held out; without training documents all counts are zero and the tree is the uniform root; rows
with equal ids are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut, ship

#: END and START are bytes that no UTF-8 text holds.
DEPTH, SHALLOW, END, START = 6, 2, 0xFE, 0xFF
FOLDS, HELD = 7, 2
#: The least log10 probability on the way to a chunk; what is less likely counts as this.
LOWEST = 16.0
#: Bytes of text whose windows are sorted at once; bytes of text a bucket, and the most buckets; chunks' windows of a bucket read at once.
GRAM_BYTES, BUCKET_BYTES, MOST_BUCKETS, BLOBS_AT_ONCE = 1 << 20, 24 << 20, 4096, 2000


START_BYTES = bytes([START]) * DEPTH


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def packed_words(words: list[bytes]) -> bytes:
    """The model's symbols of one text."""
    return (b" ".join(words) + b" " if words else b"") + bytes([END])


def window_keys(a):
    """Windows of an array of bytes: contexts of DEPTH bytes, nearest first, above the byte that follows. One for each place from DEPTH on."""
    import numpy as np

    keys = np.zeros(max(0, len(a) - DEPTH), np.uint64)
    for k in range(DEPTH - 1, -1, -1):  # the nearest byte first
        keys = keys << np.uint64(8) | a[k : k + len(keys)]
    return keys << np.uint64(8) | a[DEPTH:]


def windows_of(lines: bytes, counted: bool):
    """Distinct windows, sorted, and their counts (0 if not counted)."""
    import numpy as np

    a, parts = np.frombuffer(lines, np.uint8), []
    for at in range(0, len(a) - DEPTH, GRAM_BYTES):
        part = a[at : at + GRAM_BYTES + DEPTH]
        parts.append(np.unique(window_keys(part)[part[DEPTH:] != START], return_counts=True))  # no window predicts a START
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, n = parts[0] if len(parts) == 1 else summed(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]))
    return keys, n.astype(np.int64) * counted


def summed(keys, n):
    """Distinct keys, sorted, and the sums of their n."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def distinct(keys):
    """Distinct keys, sorted. np.unique hashes if neither counts nor places are asked for: many times slower than a sort here."""
    import numpy as np

    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def bucket_of(keys, buckets: int):
    """The bucket of each window: a hash of its SHALLOW + 1 nearest bytes."""
    import numpy as np

    near = keys >> np.uint64(8 * (DEPTH - SHALLOW))
    return ((near * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(8)) % np.uint64(buckets)


def pack_windows(keys, more) -> bytes:
    """Sorted windows and 4 bytes each beside them (counts or float32): differences by byte planes, compressed."""
    import numpy as np
    import zstandard

    gaps = np.diff(keys, prepend=np.uint64(0))
    planes = np.concatenate([gaps.view(np.uint8).reshape(-1, 8), np.ascontiguousarray(more).view(np.uint8).reshape(-1, 4)], axis=1)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes.T).tobytes())


def unpack_windows(blob: bytes, kind: str = "<u4"):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(12, -1)
    gaps = np.ascontiguousarray(planes[:8].T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.ascontiguousarray(planes[8:].T).view(kind).ravel()


def pack_logs(logs) -> bytes:
    """log10 probabilities in two bytes each, by planes, compressed. Steps widen with the square root, from 0 to -LOWEST: they
    are finest for likely bytes, of which a text has most (0.0001 at a probability of 0.1)."""
    import numpy as np
    import zstandard

    steps = np.rint(np.sqrt(np.clip(-logs.astype(float), 0, LOWEST) / LOWEST) * 65535).astype("<u2")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 2).T).tobytes())


def unpack_logs(blob: bytes):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(2, -1)
    return -LOWEST * (np.ascontiguousarray(planes.T).view("<u2").ravel() / 65535) ** 2


class Shallow:
    """Contexts of up to SHALLOW bytes: probabilities after them, and shares of their counts. Sent to all tasks."""

    def __init__(self, depth, ctx, sym, n, least: int):
        """From (depth, context, symbol, training count) of all that occur."""
        import numpy as np

        self.least, self.at, self.p = least, [], []
        lower = np.full((1, 256), 1 / 256)
        for d in range(SHALLOW + 1):
            mine = depth == d
            own = distinct(ctx[mine]) if d else np.zeros(1, np.int64)
            counts = np.zeros((len(own), 256))
            np.add.at(counts, (np.searchsorted(own, ctx[mine]), sym[mine]), n[mine])
            if d:
                lower = self.p[-1][np.searchsorted(self.at[-1], own >> 8)]
            total, weight = counts.sum(1), 2.0 * np.maximum(1, (counts > 0).sum(1))
            p = (counts + weight[:, None] * lower) / (total + weight)[:, None]
            self.at.append(own)
            self.p.append(np.where((total >= (least if d else 0))[:, None], p, lower))
        self.p = [x.astype(np.float32) for x in self.p]
        self.shares = (counts / np.maximum(1, total)[:, None]).astype(np.float32)

    def probability(self, ctx, sym):
        """Of symbols after contexts of SHALLOW bytes; where a context was never seen, after its longest suffix that was."""
        import numpy as np

        out = self.p[0][0][sym].astype(float)
        for d in range(1, SHALLOW + 1):
            own, mine = self.at[d], ctx >> 8 * (SHALLOW - d)
            if len(own):
                k = np.minimum(np.searchsorted(own, mine), len(own) - 1)
                out = np.where(own[k] == mine, self.p[d][k, sym], out)
        return out

    def share(self, ctx, sym):
        """Of symbols among those seen after contexts of SHALLOW bytes, all of them seen."""
        import numpy as np

        return self.shares[np.searchsorted(self.at[-1], ctx), sym].astype(float)


def bucket_probabilities(keys, n, shallow: Shallow):
    """Probability of each window of a bucket, from all its windows (sorted) and their training counts."""
    import numpy as np

    keys, n = keys.astype(np.int64), n.astype(np.int64)
    sym, p = keys & 255, shallow.probability(keys >> 8 * (DEPTH + 1 - SHALLOW), keys & 255)
    levels, kept, above = [], [], None
    for d in range(SHALLOW + 1, DEPTH + 1):
        # (context, symbol) cells of this depth; the cell of each window, the context of each cell
        cells, cell = np.unique(keys >> 8 * (DEPTH + 1 - d) << 8 | sym, return_inverse=True)
        count = np.bincount(cell, n, len(cells))
        own, row = np.unique(cells >> 8, return_inverse=True)
        total, kinds = np.bincount(row, count, len(own)), np.bincount(row, count > 0, len(own))
        seen = np.flatnonzero(count > 0)
        parent = cells[seen] >> 16
        if above is None:
            share = shallow.share(parent, cells[seen] & 255)
        else:
            cells0, count0, own0, total0 = above
            share = count0[np.searchsorted(cells0, parent << 8 | cells[seen] & 255)] / total0[np.searchsorted(own0, parent)]
        g = 2 * np.bincount(row[seen], count[seen] * np.log(count[seen] / total[row[seen]] / share), len(own))
        kept.append((total >= shallow.least) & (g > kinds * np.log(np.maximum(1, total))))
        levels.append((own, cell, count, row, total, kinds))
        above = (cells, count, own, total)
    for d in range(len(levels) - 1, 0, -1):  # suffixes stay, too
        kept[d - 1][np.searchsorted(levels[d - 1][0], levels[d][0][kept[d]] >> 8)] = True
    for (_, cell, count, row, total, kinds), stays in zip(levels, kept):
        at, weight = row[cell], 2.0 * np.maximum(1, kinds)
        p = np.where(stays[at], (count[cell] + weight[at] * p) / (total + weight)[at], p)
    return p


SCHEMA = "kind string, chunk long, doc_id long, held boolean, num long, n long, blob binary, depth int"


def first_pass(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, buckets: int) -> DataFrame:
    """Rows of four kinds: 'doc' (chunk, doc_id, held, n words, blob of word numbers), 'list' (chunk,
    n words, blob of their training counts and the words), 'gram' (chunk, num: bucket, n windows, blob of windows and counts),
    'shallow' (depth, num: context << 8 | symbol, n: training count)."""
    import pyarrow as pa

    ship(docs.sparkSession)

    def batch(kind: str, m: int, **cols):
        types = {"chunk": pa.int64(), "doc_id": pa.int64(), "held": pa.bool_(), "num": pa.int64(), "n": pa.int64(), "blob": pa.binary(), "depth": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array([kind] * m, pa.string()), *(pa.array(cols[k], t) if k in cols else pa.nulls(m, t) for k, t in types.items())], ["kind", *types])

    def run(batches):
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        part, seq, zip_ = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=1)
        rows, numbers, size = [], _Numbers(), 0
        lines: dict[bool, list[bytes]] = {False: [], True: []}
        pending = 0
        keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def add_windows() -> None:
            nonlocal keys, n, pending
            for held, some in lines.items():
                if some:
                    k, m = windows_of(b"".join(some), not held)
                    keys, n = summed(np.concatenate([keys, k]), np.concatenate([n, m]))
                    some.clear()
            pending = 0

        def chunk_rows():
            nonlocal seq, size, keys, n
            add_windows()
            chunk, counts = part << 24 | seq, np.zeros(len(numbers), np.uint32)
            for _, held, num in rows:
                if not held:
                    counts += np.bincount(num, minlength=len(numbers)).astype(np.uint32)
            yield batch("list", 1, chunk=[chunk], n=[len(numbers)], blob=[zip_.compress(counts.tobytes() + b"\n".join(numbers))])
            for at in range(0, len(rows), 1000):
                some = rows[at : at + 1000]
                yield batch("doc", len(some), chunk=[chunk] * len(some), doc_id=[i for i, _, _ in some], held=[h for _, h, _ in some], n=[len(x) for _, _, x in some], blob=[zip_.compress(x.tobytes()) for _, _, x in some])
            bucket = bucket_of(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            for b in np.flatnonzero(np.diff(edges)):
                mine = order[edges[b] : edges[b + 1]]
                yield batch("gram", 1, chunk=[chunk], num=[int(b)], n=[len(mine)], blob=[pack_windows(keys[mine], n[mine].astype("<u4"))])
            for d in range(SHALLOW + 1):
                code, m = summed((keys >> np.uint64(8 * (DEPTH + 1 - d))) << np.uint64(8) | keys & np.uint64(255), n)
                code, m = code[m > 0].astype(np.int64), m[m > 0]
                yield batch("shallow", len(code), num=code, n=m, depth=np.full(len(code), d, np.int32))
            rows.clear(), numbers.clear()
            keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)
            seq, size = seq + 1, 0

        for b in batches:
            for doc_id, text in zip(b.column("doc_id"), b.column("t")):
                doc_id, words = doc_id.as_py(), (text.as_py() or "").encode("utf-8", "replace").lower().split()
                num = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                held = held_out(doc_id)
                rows.append((doc_id, held, num))
                lines[held].append(START_BYTES + packed_words(words))
                size += len(lines[held][-1])
                pending += len(lines[held][-1])
                if pending >= 4 * GRAM_BYTES:
                    add_windows()
                if size >= chunk_bytes:
                    yield from chunk_rows()
        if rows:
            yield from chunk_rows()

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return src.mapInArrow(run, SCHEMA)


class _Numbers(dict):
    """word -> its number, by first appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def listed_words(blob: bytes, n: int):
    """The training counts and words of a 'list' row."""
    import numpy as np
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(data[: 4 * n], np.uint32), data[4 * n :].split(b"\n") if n else []


def merged_windows(blobs):
    """Windows of some blobs together, sorted, with the sums of their counts. Blobs of like size are merged, as in merge sort."""
    import numpy as np

    done: list[tuple] = []  # (blobs in it, windows, counts)
    for left, blob in zip(range(len(blobs) - 1, -1, -1), blobs):
        keys, n = unpack_windows(blob.as_py())
        done.append((1, keys, n.astype(np.int64)))
        while len(done) > 1 and (done[-2][0] <= done[-1][0] or not left):
            (k, keys, n), (m, keys2, n2) = done.pop(), done.pop()
            done.append((k + m, *summed(np.concatenate([keys, keys2]), np.concatenate([n, n2]))))
    return done[0][1:]


def window_scores(first: DataFrame, shallow: Shallow) -> DataFrame:
    """chunk, bucket, blob: log10 probabilities of each chunk's windows, bucket by bucket, in the windows' order."""
    import numpy as np
    import pyarrow as pa

    spark = first.sparkSession
    grams = first.where("kind = 'gram'").select("chunk", F.col("num").alias("bucket"), "blob")
    most = grams.groupBy("bucket").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = max(1, -(-most // BLOBS_AT_ONCE))
    salted = grams.withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int"))
    sent = spark.sparkContext.broadcast(shallow)

    def merge(rows: pa.Table) -> pa.Table:
        keys, n = merged_windows(rows["blob"])
        return pa.table({"bucket": rows["bucket"][:1], "blob": pa.array([pack_windows(keys, np.minimum(n, (1 << 32) - 1).astype("<u4"))], pa.binary())})

    def build(rows: pa.Table) -> pa.Table:
        keys, n = merged_windows(rows["blob"])
        p = np.log10(bucket_probabilities(keys, n, sent.value)).astype("<f4")
        return pa.table({"bucket": rows["bucket"][:1], "model": pa.array([pack_windows(keys, p)], pa.binary())})

    parts = salted.groupBy("bucket", "salt").applyInArrow(merge, "bucket long, blob binary") if salts > 1 else salted.select("bucket", "blob")
    model = cut(parts.groupBy("bucket").applyInArrow(build, "bucket long, model binary"), "model")
    models = model.select(F.col("bucket").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("of_salt"), "model")

    def look_up(rows: pa.Table, model: pa.Table) -> pa.Table:
        keys, p = unpack_windows(model["model"][0].as_py(), "<f4")
        out = [pack_logs(p[np.searchsorted(keys, unpack_windows(blob.as_py())[0])]) for blob in rows["blob"]]
        return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "blob": pa.array(out, pa.binary())})

    return salted.groupBy("bucket", "salt").cogroup(models.groupBy("of", "of_salt")).applyInArrow(look_up, "chunk long, bucket long, blob binary")


def chunk_scores(lines: list[bytes], logp: list[tuple[int, bytes]], buckets: int):
    """log10 probability of each line (START_BYTES and its symbols) of a chunk; logp: its windows' by bucket. Empties both
    lists. Pieces are sorted twice, as keeping each place's window would take most of a task's memory."""
    import numpy as np

    lens = np.array([len(x) for x in lines])
    a, starts, pieces = np.frombuffer(b"".join(lines), np.uint8), np.cumsum(lens) - lens, []
    lines.clear()

    def piece(at: int):
        return window_keys(a[at : at + GRAM_BYTES + DEPTH])

    whole = np.empty(0, np.uint64)
    for at in range(0, len(a) - DEPTH, GRAM_BYTES):
        pieces.append(distinct(piece(at)))
        if len(pieces) == 4 or at + GRAM_BYTES >= len(a) - DEPTH:
            whole = distinct(np.concatenate([whole, *pieces]))
            pieces.clear()
    whole = whole[whole & np.uint64(255) != START]
    order = np.argsort(bucket_of(whole, buckets), kind="stable").astype(np.int32)
    value, done = np.zeros(len(whole), np.float32), 0
    for _, blob in sorted(logp):
        some = unpack_logs(blob)
        value[order[done : done + len(some)]] = some
        done += len(some)
    assert done == len(whole), "a chunk's windows must all come back"
    logp.clear()
    del order
    out = np.zeros(len(lens))
    for at in range(0, len(a) - DEPTH, GRAM_BYTES):
        keys, at_key = np.unique(piece(at), return_inverse=True)
        k = np.minimum(np.searchsorted(whole, keys), len(whole) - 1)
        p = np.where(keys & np.uint64(255) != START, value[k], 0.0)[at_key]
        # the lines of the places at + DEPTH ...
        lo, hi = at + DEPTH, at + DEPTH + len(p)
        first = int(np.searchsorted(starts, lo, "right")) - 1
        last = int(np.searchsorted(starts, hi, "left"))
        of = np.repeat(np.arange(last - first), np.minimum(starts[first:last] + lens[first:last], hi) - np.maximum(starts[first:last], lo))
        out[first:last] += np.bincount(of, p, last - first)
    return out


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 16, chunk_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs."""
    import numpy as np
    import pyarrow as pa

    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    first = cut(first_pass(docs, id_col, text_col, chunk_bytes, buckets), "chunks", "kind")
    of_docs = first.where("kind = 'doc' AND NOT held").agg(F.sum("n").alias("w"), F.count("*").alias("d")).first()
    short = first.where("kind = 'shallow'").groupBy("depth", "num").agg(F.sum("n").alias("n")).toArrow()  # contexts of up to SHALLOW bytes
    depth, num, n = (short[c].to_numpy().astype(np.int64) for c in ("depth", "num", "n"))
    windows = cut(window_scores(first, Shallow(depth, num >> 8, num & 255, n, least)), "windows")
    drop_cut(first, "kind=gram")

    def words_of_lists(batches):
        for b in batches:
            for chunk, n, blob in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), b.column("blob")):
                counts, words = listed_words(blob.as_py(), n)
                for at in range(0, n, 100_000):
                    some = words[at : at + 100_000]
                    cols = [pa.array(some, pa.binary()), pa.array(np.full(len(some), chunk)), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(counts[at : at + len(some)].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(cols, ["word", "of_chunk", "num", "n"])

    lists = first.where("kind = 'list'").select("chunk", "n", "blob")
    listed = lists.mapInArrow(words_of_lists, "word binary, of_chunk long, num int, n int")
    w = Window.partitionBy("word")
    known = listed.select("of_chunk", "num", F.sum("n").over(w).alias("c"), (F.row_number().over(w.orderBy("of_chunk")) == 1).alias("first")).where("c > 0")

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        kind, held, ids, sizes = (rows[c].to_pylist() for c in ("kind", "held", "doc_id", "n"))
        at = kind.index("list")
        _, word = listed_words(rows["blob"][at].as_py(), sizes[at])
        c = np.zeros(len(word), np.int64)
        c[known["num"].to_numpy()] = known["c"].to_numpy()
        value = np.log10(c + 1.0)
        out: dict[str, list] = {k: [] for k in ("doc_id", "held_out", "n_words", "n_known", "sum_log")}
        lines, logp = [], []
        for i, k in enumerate(kind):
            if k == "window":
                logp.append((sizes[i], rows["blob"][i].as_py()))
            elif k == "doc":
                num = np.frombuffer(unzip.decompress(rows["blob"][i].as_py()), np.uint32)
                for o, v in zip(out.values(), (ids[i], held[i], len(num), int((c[num] > 0).sum()), float(value[num].sum()))):
                    o.append(v)
                lines.append(START_BYTES + packed_words([word[j] for j in num.tolist()]))
        n_lines, firsts = len(lines), [int(known["first"].to_numpy(zero_copy_only=False).sum())]
        del rows, known, word, c, value
        scores = chunk_scores(lines, logp, buckets)
        firsts += [0] * (n_lines - 1)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([*(pa.array(v, t) for v, t in zip(out.values(), types)), pa.array(scores), pa.array(firsts)], [*out, "score", "new_words"])

    chunks = first.where("kind IN ('doc', 'list')").select("kind", "chunk", "doc_id", "held", "n", "blob")
    both = chunks.unionByName(windows.select(F.lit("window").alias("kind"), "chunk", F.col("bucket").alias("n"), "blob"), allowMissingColumns=True)
    schema = "doc_id long, held_out boolean, n_words long, n_known long, sum_log double, score double, new_words long"
    scored = cut(both.groupBy("chunk").cogroup(known.groupBy("of_chunk")).applyInArrow(run, schema), "scored")
    train_docs = of_docs.d or 0
    n_train, end = (of_docs.w or 0) + train_docs, int(train_docs > 0)
    v = (scored.agg(F.sum("new_words")).first()[0] or 0) + end
    below, end_score = math.log10(n_train + v + 1), math.log10(train_docs + 1)
    return scored.select(
        "doc_id", "held_out", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + end).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("sum_log") + F.lit(end_score) - (F.col("n_words") + 1) * F.lit(below)).alias("base_score"), "score",
    )
