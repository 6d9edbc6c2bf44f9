"""Removing repeated byte strings with a distributed, sparse suffix array.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller
id. Sorting all suffixes would shuffle each byte fifty times, so only suffixes at anchors are
sorted: the 24-byte strings with the least hash among 27 neighbours. Which strings are anchors
depends on nothing but the 50 bytes around them, so two equal 50-byte strings hold the same anchor
at the same place, and every one holds at least one.

1. Anchors' hashes are dealt into buckets; those that occur in one document only are dropped.
2. The remaining anchors' suffixes are range-partitioned by their leading bytes at sampled
   splitters. Each bucket sorts its suffixes, and the reversed text before them, by multikey
   quicksort; common prefix lengths tell, for each of the 27 strings around an anchor, the
   smallest document that has it. An anchor string that is among the most frequent is cut into its
   50-byte strings, which are sorted as suffixes of their own, so that no bucket gets a hot group.
3. The verdicts return to their documents, whose texts are cut.

Before each shuffle a task settles what it can by itself: of equal contexts in its batch only the
one in the smallest document travels, as all others are repeats whatever the rest of the corpus
holds. So a passage that a third of all documents share is one row per batch. Equal strings have
equal leading bytes and meet in one bucket; strings are compared byte by byte, never by hash alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunedata.llm.common import read, ship_package, small, written

LENGTH = 50  # bytes of a repeated string
KEY = 24  # bytes of an anchor's string
SPAN = LENGTH - KEY + 1  # an anchor is the least of so many neighbours; also the strings that cover it
LEFT = SPAN - 1  # bytes before an anchor that its strings can reach
CONTEXT = LEFT + LENGTH
ROW = 80  # CONTEXT, the bytes that exist before and after the anchor, filled up to whole words
LEAD = 16  # leading bytes that choose a bucket
SAMPLE_DOCS = 2000, 100_000  # documents that the splitters are sampled from, at least and at most about so many
BUCKET_BYTES = 32 << 20  # text behind a bucket, which a task holds whole
MAX_PARTITIONS = 10_000  # shuffle partitions; a task takes its buckets one after the other
HOT_LEAST, HOT_MOST = 50_000, 4096  # anchor strings cut up: more frequent than, at most so many
PIECE = 1 << 16  # positions hashed at once, to stay in the processor's cache
SLICE = 8 << 20  # bytes of text handled together
NO_ID = np.iinfo(np.int64).max  # stands for a null doc_id: larger than every id

_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = [np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(4)]


def _key_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the KEY bytes from each position (the last KEY - 1 positions have none)."""
    h = _TABLE[x]
    eight = None
    for k in range(4):  # 2, 4, 8, 16 bytes
        n = 1 << k
        h = h[:-n] * _B[k] + h[n:]
        if n == 4:
            eight = h
    return _mixed(h[: len(x) - KEY + 1] * _B[3] + eight[16 : 16 + len(x) - KEY + 1])


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _hash_of_each(keys: np.ndarray) -> np.ndarray:
    """The same hash of each row of KEY bytes."""
    h = np.zeros(len(keys), np.uint64)
    for k in range(KEY):
        h = h * _B[0] + _TABLE[keys[:, k]]
    return _mixed(h)


def _sliding(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each n neighbours (f: minimum or maximum)."""
    have = 1
    while have * 2 <= n:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (n - have)], x[n - have :]) if have < n else x


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the bytes ``x`` whose KEY-byte string has the least hash in some window of SPAN
    positions, and these hashes."""
    n = len(x) - KEY + 1
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, hs = [], []
    for i in range(0, n, PIECE):
        lo, hi = max(0, i - LEFT), min(n, i + PIECE + LEFT)
        if hi - lo < SPAN:  # a short end: its windows start earlier
            lo = hi - SPAN
        h = _key_hashes(x[lo : hi + KEY - 1])
        least = _sliding(h, SPAN, np.minimum)
        pad = np.zeros(LEFT, np.uint64)
        best = _sliding(np.concatenate([pad, least, pad]), SPAN, np.maximum)
        p = np.nonzero(best == h)[0]
        p = p[(p + lo >= i) & (p + lo < i + PIECE)]
        at.append(p + lo)
        hs.append(h[p])
    return np.concatenate(at), np.concatenate(hs)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    i, held = 0, 0
    for j, t in enumerate(texts):
        held += len(t)
        if held >= SLICE:
            yield i, j + 1
            i, held = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"".join(texts), np.uint8)
    return buf, np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def _doc_anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, position in it and hash of each anchor. The texts are hashed as one; at a
    border this may add anchors, never lose one."""
    buf, bounds = _joined(texts)
    p, h = anchors(buf)
    d = np.searchsorted(bounds, p, "right") - 1
    size = bounds[d + 1] - bounds[d]
    pos = p - bounds[d]
    ok = (pos + KEY <= size) & (size >= LENGTH)
    return d[ok], pos[ok], h[ok]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by ``keys`` (the first is the primary) and the group number of each sorted row."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.cumsum(new)


def _group_min_max(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1))
    return np.minimum.reduceat(value, starts)[group], np.maximum.reduceat(value, starts)[group]


def _pack5(x: np.ndarray) -> bytes:
    """The low 40 bits of each number, byte planes apart (which compress better)."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T.tobytes()


def _unpack5(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(5, -1).T
    return out.view("<u8").ravel()


def _pack_by_doc(doc: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
    """``(doc, columns of its rows as bytes)`` for each doc."""
    order = np.argsort(doc, kind="stable")
    d = doc[order]
    cuts = [0, *(np.nonzero(np.diff(d))[0] + 1).tolist(), len(d)]
    cols = [c[order] for c in cols]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            yield (int(d[i]), *(c[i:j].tobytes() for c in cols))


def _rows(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(cols, fields)], [n for n, _ in fields])


_B64, _BIN = pa.int64(), pa.binary()
_ONE = [("bucket", _B64), ("code", _BIN), ("doc", _BIN), ("n", _BIN), ("pos", _BIN), ("rep", _BIN), ("reps", _BIN)]
_ONE_DDL = "bucket bigint, code binary, doc binary, n binary, pos binary, rep binary, reps binary"
_SHARED = [("target", _B64), ("doc", _BIN), ("th", _BIN), ("pos", _BIN), ("mask", _BIN), ("hot", _B64), ("n", _B64)]
_SHARED_DDL = "target bigint, doc binary, th binary, pos binary, mask binary, hot bigint, n bigint"
_VERDICT = _SHARED[:5]
_VERDICT_DDL = "target bigint, doc binary, th binary, pos binary, mask binary"
_BY_DOC_DDL = "d bigint, th binary, pos binary, mask binary"


def _to_targets(targets: int, doc: np.ndarray, th: np.ndarray, pos: np.ndarray, mask: np.ndarray) -> Iterator[tuple]:
    """What belongs to documents, packed into one row per group of documents."""
    group = ((doc.astype(np.uint64) * _MIX[0]) >> np.uint64(32)).astype(np.int64) % targets
    order = np.lexsort((doc, group))
    found, starts = np.unique(group[order], return_index=True)
    cols = [doc.astype("<i8"), th.astype("<i8"), pos.astype("<u4"), mask.astype("<u4")]
    for k, o in zip(found.tolist(), np.split(order, starts[1:])):
        yield (k, *(_squeeze(c[o].tobytes(), len(o)) for c in cols))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of documents -> one row per document."""
    for _, held in _by_bucket(batches, "target"):
        doc, th, pos, mask = (_cat([_unsqueeze(r[c]) for r in held], k) for c, k in (("doc", "<i8"), ("th", "<i8"), ("pos", "<u4"), ("mask", "<u4")))
        yield _rows(list(_pack_by_doc(doc, th, pos, mask)), [("d", _B64), ("th", _BIN), ("pos", _BIN), ("mask", _BIN)])


def _code(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash, and the 40 bits that tell hashes of a bucket apart."""
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64), h & np.uint64((1 << 40) - 1)


def _send_anchors(buckets: int):
    """Documents -> per bucket: anchors that occur in one document of the slice (code, doc, pos), and
    one entry with a count for those in several, which are returned at once as shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(NO_ID).to_numpy()
            texts = [t.as_py() or b"" for t in b.column(1)]
            for i, j in _slices(texts):
                d, pos, h = _doc_anchors(texts[i:j])
                if not len(d):
                    continue
                doc = ids[i:j][d]
                order, g = _groups(h)
                doc, pos, h = doc[order], pos[order].astype("<u4"), h[order]
                low, high = _group_min_max(g, doc)
                several = low != high
                rows = [(buckets + doc_id % buckets, None, np.int64(doc_id).tobytes(), None, p, None, None) for doc_id, p in _pack_by_doc(doc[several], pos[several])]
                bucket, code = _code(h, buckets)
                first = np.concatenate(([True], g[1:] != g[:-1]))
                lead = np.nonzero(first & several)[0]
                count = np.diff(np.append(np.nonzero(first)[0], len(g)))[g[lead]]
                one = np.nonzero(~several)[0]
                one = one[np.lexsort((pos[one], doc[one], bucket[one]))]
                lead_order = np.argsort(bucket[lead], kind="stable")
                lead, count = lead[lead_order], count[lead_order]
                found = np.union1d(bucket[one], bucket[lead])
                cuts = [np.searchsorted(bucket[at], found, side) for at in (one, lead) for side in ("left", "right")]
                for k, *(from_one, to_one, from_lead, to_lead) in zip(found.tolist(), *cuts):
                    o, r = one[from_one:to_one], slice(from_lead, to_lead)
                    docs, n = np.unique(doc[o], return_counts=True)
                    rows.append((k, _pack5(code[o]), docs.tobytes(), n.astype("<u4").tobytes(), pos[o].tobytes(), _pack5(code[lead[r]]), count[r].astype("<u4").tobytes()))
                yield _rows(rows, _ONE)

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[dict]]]:
    """The rows of each bucket of a partition sorted by bucket."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if row[key] != now:
                if held:
                    yield now, held
                now, held = row[key], []
            held.append(row)
    if held:
        yield now, held


def _squeeze(raw: bytes, n: int = 1) -> bytes:
    """Compressed; n: the number of values, whose byte planes are set apart if there are several."""
    if n > 1:
        raw = np.frombuffer(raw, np.uint8).reshape(n, -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + n.to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unsqueeze(b: bytes) -> bytes:
    size, n = int.from_bytes(b[:8], "little"), int.from_bytes(b[8:16], "little")
    raw = pa.decompress(b[16:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(-1, n).T.tobytes() if n > 1 else raw


def _cat(parts, kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def _find_shared(buckets: int, hot_least: int):
    """Buckets -> ``(doc_id, pos)`` of the anchors that occur in several documents; rows with ``hot``
    name the codes that occur more than ``hot_least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held in _by_bucket(batches):
            if bucket >= buckets:
                n = [len(r["pos"]) // 4 for r in held]
                doc, pos = np.repeat(_cat([r["doc"] for r in held], "<i8"), n), _cat([r["pos"] for r in held], "<u4")
                none = np.zeros(len(doc), np.int64)
                yield _rows([(*r, None, None) for r in _to_targets(buckets, doc, none, pos, none)], _SHARED)
                continue
            code = np.concatenate([_unpack5(r["code"]) for r in held])
            doc = np.repeat(_cat([r["doc"] for r in held], "<i8"), _cat([r["n"] for r in held], "<u4"))
            pos = _cat([r["pos"] for r in held], "<u4")
            lead = np.concatenate([_unpack5(r["rep"]) for r in held])
            count = _cat([r["reps"] for r in held], "<u4").astype(np.int64)
            rows = []
            codes, at = np.unique(np.concatenate([code, lead]), return_inverse=True)
            total = np.bincount(at, np.concatenate([np.ones(len(code), np.int64), count]), len(codes)).astype(np.int64)
            for c, n in zip(codes[total > hot_least].tolist(), total[total > hot_least].tolist()):
                rows.append((None, None, None, None, None, bucket << 40 | c, n))
            if len(code):
                order, g = _groups(code)
                low, high = _group_min_max(g, doc[order])
                shared = (low != high) | np.isin(code[order], lead)
                d, none = doc[order][shared], np.zeros(int(shared.sum()), np.int64)
                rows += [(*r, None, None) for r in _to_targets(buckets, d, none, pos[order][shared], none)]
            yield _rows(rows, _SHARED)

    return run


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of rows of big-endian words: sorts by the first word, and only ties by the next one."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.concatenate(([0], np.cumsum(words[order[1:], 0] != words[order[:-1], 0])))
    for k in range(1, words.shape[1]):
        size = np.bincount(group)
        tied = np.nonzero(size[group] > 1)[0]
        if not len(tied):
            break
        sub = order[tied]
        order[tied] = sub[np.lexsort((words[sub, k], group[tied]))]
        w = words[order, k]
        group = np.concatenate(([0], np.cumsum((group[1:] != group[:-1]) | (w[1:] != w[:-1]))))
    return order


def _sorted_runs(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the rows of ``text`` and the common prefix of each with the one before it."""
    n, width = text.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = text
    order = multikey_order(words.view(">u8").astype(np.uint64))
    s = text[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = s[1:] != s[:-1]
        lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, lcp


def _window_masks(ctx: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each context, the bits o for which its string starting o bytes before the anchor also
    occurs, at the same place of an equal anchor, in a document with a smaller id."""
    n = len(ctx)
    mask = np.zeros(n, np.int64)
    right_order, right_lcp = _sorted_runs(ctx[:, LEFT:CONTEXT])
    # contexts whose anchor no other has can have no repeats
    group = np.cumsum(right_lcp < KEY)
    keep = right_order[np.bincount(group)[group] > 1]
    if not len(keep):
        return mask
    if len(keep) < n:
        mask[keep] = _window_masks(ctx[keep], doc[keep])
        return mask
    left_order, left_lcp = _sorted_runs(ctx[:, LEFT - 1 :: -1])
    before, after = ctx[:, CONTEXT].astype(np.int64), ctx[:, CONTEXT + 1].astype(np.int64)
    right, left = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(SPAN):
        right[right_order] = np.cumsum(right_lcp < LENGTH - o)
        left[left_order] = np.cumsum(left_lcp < o)
        ok = np.nonzero((o <= before) & (LENGTH - o <= after))[0]
        if len(ok) < 2:
            continue
        key = right[ok] * (n + 1) + left[ok]
        order, g = _groups(key)
        low, _ = _group_min_max(g, doc[ok][order])
        hit = ok[order][low < doc[ok][order]]
        mask[hit] |= 1 << o
    return mask


_TWO = [("bucket", _B64), ("kind", _B64), ("ctx", _BIN), ("doc", _BIN), ("th", _BIN), ("n", _BIN), ("pos", _BIN), ("mask", _BIN)]
_TWO_DDL = "bucket bigint, kind bigint, ctx binary, doc binary, th binary, n binary, pos binary, mask binary"


def _row_ids(rows: np.ndarray) -> np.ndarray:
    """A number for each distinct row of bytes (whole words wide): by hash, then checked bytewise."""
    words = np.ascontiguousarray(rows).view("<u8")
    h = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        h ^= h >> np.uint64(31)
        h = (h + words[:, k]) * _MIX[k]
    _, first, ids = np.unique(h, return_index=True, return_inverse=True)
    if not np.array_equal(words[first][ids], words):
        ids = np.unique(rows, axis=0, return_inverse=True)[1].ravel()
    return ids


def _settle(rows: np.ndarray, doc: np.ndarray, th: np.ndarray, pos: np.ndarray):
    """Splits occurrences of equal rows: those in a larger document than the smallest that has the
    row here are repeats already; the others travel, one entry per row and document.

    -> (settled, first of each entry, count of each entry, positions in order of the entries)"""
    ids = _row_ids(rows)
    order, g = _groups(ids, doc, th)
    ids, d = ids[order], doc[order]
    change = np.concatenate(([True], ids[1:] != ids[:-1]))
    low = d[np.nonzero(change)[0]][np.cumsum(change) - 1]
    travels = d == low
    settled, go, gg = order[~travels], order[travels], g[travels]
    lead = np.concatenate(([True], gg[1:] != gg[:-1])) if len(gg) else np.zeros(0, bool)
    count = np.diff(np.append(np.nonzero(lead)[0], len(gg)))
    return settled, go[lead], count, pos[go]


def _send_contexts(buckets: int, splitters: np.ndarray, hot: np.ndarray, hot_buckets: int):
    """Documents with the positions of their shared anchors -> contexts by bucket of their suffix."""

    def bucket_of(suffix: np.ndarray) -> np.ndarray:
        lead = np.ascontiguousarray(suffix[:, :LEAD]).view(f"S{LEAD}").ravel()
        return np.searchsorted(splitters, lead, "right")

    def send(kind, rows, suffix, first, count, pos, doc, th) -> Iterator[tuple]:
        bucket = bucket_of(suffix[first])
        order = np.argsort(bucket, kind="stable")
        starts = np.cumsum(count) - count
        found, cuts = np.unique(bucket[order], return_index=True)
        for k, o in zip(found.tolist(), np.split(order, cuts[1:])):
            f, c = first[o], count[o]
            p = pos[np.repeat(starts[o] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
            yield (k, kind, _squeeze(rows[f].tobytes()), doc[f].tobytes(), th[f].tobytes(), count[o].astype("<u4").tobytes(), p.astype("<u4").tobytes(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy()
            ths = b.column("th").to_numpy()
            texts = [t.as_py() or b"" for t in b.column("row").field("text")]
            lists = b.column("shared")
            for i, j in _slices(texts):
                where = [np.unique(np.frombuffer(lists[k].as_py(), "<u4")).astype(np.int64) for k in range(i, j)]
                sizes = np.fromiter(map(len, texts[i:j]), np.int64, j - i)
                where = [w[(w + KEY <= n) & (n >= LENGTH)] for w, n in zip(where, sizes)]
                buf = np.frombuffer(b"".join([bytes(LEFT), *texts[i:j], bytes(LENGTH)]), np.uint8)
                base = LEFT + np.concatenate(([0], np.cumsum(sizes)))[:-1]
                t = np.repeat(np.arange(j - i), [len(w) for w in where])
                pos = np.concatenate(where)
                if not len(pos):
                    continue
                start, size = base[t] + pos, sizes[t]
                before, after = np.minimum(LEFT, pos), np.minimum(LENGTH, size - pos)
                rows = np.zeros((len(pos), ROW), np.uint8)
                rows[:, :CONTEXT] = np.lib.stride_tricks.sliding_window_view(buf, CONTEXT)[start - LEFT]
                short = np.nonzero((before < LEFT) | (after < LENGTH))[0]
                col = np.arange(CONTEXT)
                rows[short, :CONTEXT] *= (col >= LEFT - before[short, None]) & (col < LEFT + after[short, None])
                rows[:, CONTEXT], rows[:, CONTEXT + 1] = before, after
                doc, th = ids[i:j][t], ths[i:j][t]
                valid = np.zeros(len(pos), np.int64)
                for o in range(SPAN):
                    valid |= ((o <= before) & (LENGTH - o <= after)).astype(np.int64) << o
                settled, first, count, at = _settle(rows, doc, th, pos)
                got = [(t[settled], pos[settled], valid[settled])]
                out = []
                is_hot = np.zeros(len(first), bool)
                if len(hot):
                    hb, code = _code(_hash_of_each(rows[first, LEFT : LEFT + KEY]), hot_buckets)
                    is_hot = np.isin(hb << 40 | code.astype(np.int64), hot)
                every = np.repeat(is_hot, count)
                cool = np.nonzero(~is_hot)[0]
                out += send(0, rows, rows[:, LEFT:], first[cool], count[cool], at[~every], doc, th)
                if is_hot.any():  # all strings around the anchor, as suffixes of their own
                    occ = np.repeat(first, count)[every]  # a row with the same context
                    where_hot, bits = at[every], valid[occ]
                    w, which, off = [], [], []
                    for o in range(SPAN):
                        k = np.nonzero(bits >> o & 1)[0]
                        w.append(rows[occ[k], LEFT - o : LEFT - o + LENGTH])
                        which.append(k)
                        off.append(np.full(len(k), o))
                    which, off = np.concatenate(which), np.concatenate(off)
                    strings = np.zeros((len(which), LENGTH + 6), np.uint8)
                    strings[:, :LENGTH] = np.concatenate(w)
                    sd, st, sp = doc[occ[which]], th[occ[which]], where_hot[which] - off
                    s2, f2, c2, at2 = _settle(strings, sd, st, sp)
                    index = {(int(x), int(y)): k for k, (x, y) in enumerate(zip(ids[i:j], ths[i:j]))}
                    tt = np.array([index[int(x), int(y)] for x, y in zip(sd[s2], st[s2])], np.int64)
                    got.append((tt, sp[s2], np.ones(len(s2), np.int64)))
                    out += send(1, strings, strings, f2, c2, at2, sd, st)
                tt, pp, mm = (np.concatenate(x) for x in zip(*got))
                for k, p, m in _pack_by_doc(tt, pp.astype("<u4"), mm.astype("<u4")):
                    out.append((buckets + int(ids[i + k]) % buckets, 2, None, ids[i + k].tobytes(), ths[i + k].tobytes(), None, p, m))
                yield _rows(out, _TWO)

    return run


def _compare(targets: int):
    """Buckets of suffixes -> positions with the mask of their repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _by_bucket(batches):
            got = []
            if some := [r for r in held if r["kind"] == 2]:
                n = [len(r["pos"]) // 4 for r in some]
                got.append(tuple(np.repeat(_cat([r[c] for r in some], "<i8"), n) for c in ("doc", "th")) + tuple(_cat([r[c] for r in some], "<u4") for c in ("pos", "mask")))
            for kind, width in ((0, ROW), (1, LENGTH + 6)):
                some = [r for r in held if r["kind"] == kind]
                if not some:
                    continue
                text = np.frombuffer(b"".join(_unsqueeze(r["ctx"]) for r in some), np.uint8).reshape(-1, width)
                doc, th = _cat([r["doc"] for r in some], "<i8"), _cat([r["th"] for r in some], "<i8")
                n, pos = _cat([r["n"] for r in some], "<u4"), _cat([r["pos"] for r in some], "<u4")
                if kind == 0:
                    mask = _window_masks(text, doc)
                else:
                    order, lcp = _sorted_runs(text[:, :LENGTH])
                    low, _ = _group_min_max(np.cumsum(lcp < LENGTH) - (lcp[0] < LENGTH), doc[order])
                    mask = np.zeros(len(doc), np.int64)
                    mask[order] = low < doc[order]
                found = np.repeat(mask, n) > 0
                got.append((np.repeat(doc, n)[found], np.repeat(th, n)[found], pos[found], np.repeat(mask, n)[found]))
            yield _rows(list(_to_targets(targets, *(np.concatenate(x) for x in zip(*got)))), _VERDICT)

    return run


def covered(n: int, pos: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which of n bytes the repeated strings cover."""
    starts = np.zeros(n + 1, np.int32)
    for o in range(SPAN):
        starts[pos[(mask >> o & 1) > 0] - o] = 1
    total = np.cumsum(starts)
    total[LENGTH:] -= total[:-LENGTH].copy()
    return total[:n] > 0


_CUT_DDL = "doc_id bigint, th bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool = False) -> Iterator[pa.RecordBatch]:
    for b in small(batches, lambda b: b.column("row").field("text")):
        rows, row, entries = [], b.column("row"), zip(b.column("found_th"), b.column("pos"), b.column("mask"))
        for doc_id, th, text, found in zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), row.field("text"), entries):
            text = text.as_py() or b""
            size, n_removed, n_spans = len(text), 0, 0
            if found[0].is_valid:
                own = np.frombuffer(found[0].as_py(), "<i8") == th
                pos, mask = (np.frombuffer(x.as_py(), "<u4")[own] for x in found[1:])
                gone = covered(size, pos.astype(np.int64), mask)
                n_removed = int(gone.sum())
                n_spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                text = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((doc_id, th, size, n_removed, n_spans, text.decode("utf-8", "ignore") if as_text else text))
        names = [("doc_id", _B64), ("th", _B64), ("n_bytes", _B64), ("n_removed", _B64), ("n_spans", _B64), ("kept", pa.string() if as_text else _BIN)]
        out = _rows(rows, names)
        others = [f.name for f in row.type if f.name != "text"]
        if others:
            others = pa.StructArray.from_arrays([row.field(n) for n in others], others)
            out = pa.RecordBatch.from_arrays([*out.columns, others], [*out.schema.names, "others"])
        yield out


def _cut_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _cut(batches, True)


def _splitters(src: DataFrame, n: int, buckets: int) -> np.ndarray:
    """At most ``buckets - 1`` leading strings that cut a sample of the anchors of ``n`` documents evenly."""
    docs = min(max(SAMPLE_DOCS[0], 4 * buckets), SAMPLE_DOCS[1])
    some = src.sample(min(1.0, docs / max(n, 1)), seed=7).select("text").limit(2 * docs)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() or b"" for t in b.column(0)]
            d, pos, _ = _doc_anchors(texts)
            step = max(1, len(d) // (8 * max(1, len(texts))))
            yield _rows([(texts[i][p : p + LEAD],) for i, p in zip(d[::step].tolist(), pos[::step].tolist())], [("lead", _BIN)])

    got = np.sort(np.array([r.lead for r in some.mapInArrow(leads, "lead binary").collect()], f"S{LEAD}"))
    return np.unique(got[np.arange(1, buckets) * len(got) // buckets]) if len(got) else got


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_least: int = HOT_LEAST, others: Sequence[str] = (),
    as_text: bool = False, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``(doc_id, th, n_bytes, n_removed, n_spans, kept binary)``, one row per input row.

    ``th`` is a hash of the text, so rows with one id and different texts stay apart; strings in
    rows of the same id are no repeats of each other. A null text is empty; texts below 50 bytes
    keep everything; a null id counts as larger than all others. ``kept`` may cut a character
    in two, as strings are bytes. The columns named in ``others`` come along in a struct of that name;
    columns not named are ignored. ``as_text``: ``kept`` is a string, without the bytes of characters
    that a cut leaves incomplete. There is a bucket per ``bucket_bytes`` of text (a shuffle partition at
    least). The splitters' sample and the most
    frequent anchors (at most 4096 numbers) are all that the driver sees.
    """
    spark = docs.sparkSession
    ship_package(spark)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text")
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text)
    size = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = max(least, -(-(size["bytes"] or 0) // bucket_bytes))

    def dealt(df: DataFrame, key: str) -> DataFrame:
        parts = [min(buckets, MAX_PARTITIONS)] if buckets > least else []
        return df.repartition(*parts, key).sortWithinPartitions(key)

    sent = dealt(src.mapInArrow(_send_anchors(buckets), _ONE_DDL), "bucket")
    shared = written(sent.mapInArrow(_find_shared(buckets, hot_least), _SHARED_DDL), "suffix-shared")
    hot = shared.where("hot IS NOT NULL").orderBy(F.desc("n"), "hot").select("hot").limit(HOT_MOST).collect()
    hot = np.array(sorted(r.hot for r in hot), np.int64)
    splitters = _splitters(src, size["n"], buckets)

    # The texts go by id once: the same exchange serves both joins, so it holds the same columns
    # for both (as one struct, which neither can prune).
    key = F.coalesce("doc_id", F.lit(int(NO_ID)))
    named = [F.col(c).alias(f"c{i}") for i, c in enumerate(others)]
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.struct(text, *named).alias("row"))
    texts = texts.select("doc_id", F.xxhash64("row.text").alias("th"), "row", key.alias("k"))

    def by_doc(packed: DataFrame) -> DataFrame:
        packed = dealt(packed.select("target", "doc", "th", "pos", "mask"), "target")
        return packed.mapInArrow(_gather, _BY_DOC_DDL)

    per_doc = by_doc(shared.where("hot IS NULL")).select("d", F.col("pos").alias("shared"))
    with_anchors = texts.join(per_doc, F.col("k") == F.col("d")).select("doc_id", "th", "row", "shared")
    contexts = with_anchors.mapInArrow(_send_contexts(buckets, splitters, hot, buckets), _TWO_DDL)
    contexts = dealt(contexts, "bucket")
    verdicts = by_doc(contexts.mapInArrow(_compare(buckets), _VERDICT_DDL)).withColumnRenamed("th", "found_th")
    both = texts.join(verdicts, F.col("k") == F.col("d"), "left").select("doc_id", "th", "row", "found_th", "pos", "mask")
    fields = ", ".join(f"c{i}: {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    ddl = (_CUT_DDL.replace("kept binary", "kept string") if as_text else _CUT_DDL) + (f", others struct<{fields}>" if others else "")
    return both.mapInArrow(_cut_text if as_text else _cut, ddl)


def deduplicated(docs: DataFrame, text_col: str = "text", hot_least: int = HOT_LEAST) -> DataFrame:
    """``docs`` with its texts cut; all rows and other columns stay as they are. Bytes of a character
    that a cut leaves incomplete go too; a null text becomes empty."""
    others = [c for c in docs.columns if c != text_col]
    cut = remove_repeats(docs, "doc_id", text_col, hot_least, others, as_text=True)
    named = {c: F.col(f"others.c{i}").alias(c) for i, c in enumerate(others)} | {text_col: F.col("kept").alias(text_col)}
    return cut.select(*[named[c] for c in docs.columns])


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
