"""Suffix-array dedup: bytes covered by a long string that starts earlier too are found and cut.

1. Anchors. Every window of ``min_bytes`` bytes has a least hash of the runs of ``GRAM`` bytes inside it. Consecutive windows of a document with the same least hash
   form a segment; equal windows have equal least hashes, so they can only lie in segments of one anchor. Only ``(anchor, content hash, place)`` is shuffled.
2. Segments are range-partitioned by anchor and content with a secondary sort by place and streamed. Of equal segments all but the first are repeats as a
   whole. An anchor with one content is settled; the others give one text per content.
3. These texts go to the task of their anchor, where a suffix array with common prefixes is built over many anchors at once and its tree of intervals is
   scanned (:mod:`intervals`): each maximal repeat gives all its occurrences, not just neighbours.
4. An anchor with more than ``MAX_TEXT`` bytes of different texts (a passage that very many documents hold, each in words of its own) is split: its texts
   are cut anew by longer runs of bytes (``GRAMS``, at last by whole windows) and go through 2 and 3 again.

Equal rows within a task are folded before the shuffle, so copies in any number cost a row a task; an anchor may span partitions, and what touches a partition's
edge is settled afterwards. No text is shuffled but that of 3, and no group is held beyond ``MAX_TEXT`` bytes.

Defined cases: null and empty texts have no bytes; places are ordered by doc_id (null first), then by a hash of the text, then by position; rows equal in
doc_id and text are one document and share its result; texts of less than ``min_bytes`` bytes keep all; an empty table gives no rows; other columns are ignored.
Strings are taken as equal if 128 bits of hashes are (2), or byte by byte (3).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .common import materialize, partitions_for, text_key
from .intervals import repeats

MIN_BYTES = 100
#: Shares of ``min_bytes`` that the runs have whose least hash is the anchor; each next one is for anchors of too much text. After the last come whole windows.
GRAMS = (0.32, 0.83, 0.96)
#: Bytes of different texts of one anchor that one task compares.
MAX_TEXT = 1 << 20
#: Rows folded at once before the shuffle, and bytes of texts whose suffixes are sorted at once.
FOLD, SORT = 1 << 20, 1 << 20
NO_DOC = -(1 << 63)
_U = np.uint64
_BYTES = tk.mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_BASE = 0x9E3779B97F4A7C15
_STEPS = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0xA0761D6478BD642F)]

REMOVED, SEGMENT, EDGE = 0, 1, 2
SELF, FOLDED = 1, 2
_COLS = ["v", "c", "doc", "row", "at", "n", "flags"]
_ROWS = "kind int, v long, c long, doc long, row long, at int, n int, flags int"


_POWERS: dict[int, np.ndarray] = {}
tk.KEPT.append(_POWERS.clear)


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64; those for texts of usual length are kept while a task runs."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 19), _U(base))
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each ``width`` neighbours."""
    done, y = 1, x
    while done * 2 <= width:
        y = pick(y[:-done], y[done:])
        done *= 2
    more = width - done
    return pick(y[:-more], y[more:]) if more else y


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each position on; by doubling."""
    x, done, left, out, have = _BYTES[data], 1, size, None, 0
    for step in _STEPS:
        if left & 1:
            out, have = (x, done) if out is None else (out[: len(x) - have] * step + x[have:], have + done)
        left >>= 1
        if not left:
            break
        x = x[:-done] * (step ^ _U(done)) + x[done:]
        done *= 2
    return tk.mix(out[: len(data) - size + 1])


def segments(data: np.ndarray, offsets: np.ndarray, min_bytes: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of a batch of texts: anchor, content hash, document, first window, number of windows, whether a segment may repeat itself."""
    none = np.zeros(0, np.int64)
    if len(data) < min_bytes:
        return none.view(_U), none.view(_U), none, none, none, none.astype(bool)
    width = min_bytes - gram + 1
    h = _gram_hashes(data, gram)
    least = _slide(h, width, np.minimum)
    n = len(least)
    new = np.ones(n, bool)
    new[1:] = least[1:] != least[:-1]
    # Windows end with their document: what starts after its last one is no segment.
    size = np.diff(offsets)
    fits = size >= min_bytes
    new[offsets[:-1][fits]] = True
    after = offsets[1:][fits] - min_bytes + 1
    new[after[after < n]] = True
    start = np.flatnonzero(new)
    count = np.diff(np.r_[start, n])
    doc = np.searchsorted(offsets, start, side="right") - 1
    ok = start + min_bytes <= offsets[doc + 1]
    # A segment has an anchor at one place, unless its text repeats there: then more places hold the least hash than there are segments.
    valid = np.zeros(n, bool)
    valid[(spots := np.repeat(start[ok], count[ok]) + np.arange(int(count[ok].sum())) - np.repeat(np.cumsum(count[ok]) - count[ok], count[ok]))] = True
    bounded = np.where(valid, least, _U(0))
    reach = _slide(np.r_[np.zeros(width - 1, _U), bounded, np.zeros(width - 1, _U)], width, np.maximum)
    held = h[(reach[: len(h)] == h) & (reach[: len(h)] > 0)]
    start, count, doc = start[ok], count[ok], doc[ok]
    v = least[start]
    itself = np.zeros(len(v), bool)
    if len(held) > len(v):
        kinds, there = np.unique(held, return_counts=True)
        mine, runs = np.unique(v, return_counts=True)
        at = np.searchsorted(kinds, mine)
        often = mine[there[at] > runs]
        itself = np.isin(v, often)
    power = _powers(_BASE, len(data))
    total = np.r_[_U(0), np.cumsum(_BYTES[data] * power)]
    back = _powers(pow(_BASE, -1, 1 << 64), len(data))
    c = tk.mix((total[start + count + min_bytes - 1] - total[start]) * back[start] + count.astype(_U))
    return v, c, doc, start - offsets[doc], count, itself


def _table(kind: np.ndarray | int, cols: list[np.ndarray]) -> pa.RecordBatch:
    n = len(cols[0])
    kinds = np.full(n, kind, np.int32) if isinstance(kind, int) else kind.astype(np.int32)
    types = [np.int64] * 4 + [np.int32] * 3
    return pa.RecordBatch.from_arrays([pa.array(kinds), *[pa.array(x.astype(t)) for x, t in zip(cols, types, strict=True)]], ["kind", *_COLS])


def fold(cols: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Kinds and rows of :data:`_COLS` (and further columns): of rows equal in anchor and content the first place stays, the others are repeats as they are.
    Rows of one place are one."""
    v, c, doc, row, at = cols[:5]
    order = np.lexsort((at, row, doc, tk.mix(v.view(_U) ^ (c.view(_U) * _U(3)))))
    cols = [x[order] for x in cols]
    v, c, doc, row, at = cols[:5]
    same = np.r_[False, (v[1:] == v[:-1]) & (c[1:] == c[:-1])]
    place = same & np.r_[False, (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (at[1:] == at[:-1])]
    first = np.flatnonzero(~same)
    flags = cols[6].copy()
    flags[first[np.add.reduceat((same & ~place).astype(np.int64), first) > 0]] |= FOLDED
    cols[6] = flags
    return np.where(same, REMOVED, SEGMENT)[~place], [x[~place] for x in cols]


class _Folder:
    """Collects rows, with the bytes of each if given, and folds them, ``FOLD`` at a time. Only rows that stay keep their bytes."""

    def __init__(self, with_bytes: bool) -> None:
        self.parts: list[list[np.ndarray]] = []
        self.texts: list[bytes] | None = [] if with_bytes else None
        self.n = self.size = 0

    def add(self, cols: list[np.ndarray], texts: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
        if self.texts is not None:
            cols = [*cols, np.arange(len(cols[0])) + len(self.texts)]
            self.texts += texts or []
            self.size += sum(map(len, texts or []))
        self.parts.append(cols)
        self.n += len(cols[0])
        if self.n >= FOLD or self.size >= 16 * SORT:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            kind, cols = fold([np.concatenate(x) for x in zip(*self.parts, strict=True)])
            out = _table(kind, cols[:7])
            if self.texts is not None:
                texts = pa.array([self.texts[i] if k == SEGMENT else None for i, k in zip(cols[7].tolist(), kind.tolist(), strict=True)], pa.binary())
                out = pa.RecordBatch.from_arrays([*out.columns, texts], [*out.schema.names, "bytes"])
                self.texts = []
            self.parts, self.n, self.size = [], 0, 0
            yield out


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """doc (null as the smallest) and row of a batch of (doc_id, row, ...)."""
    return batch[0].cast(pa.int64()).fill_null(NO_DOC).to_numpy(zero_copy_only=False), batch[1].to_numpy(zero_copy_only=False)


def _cut_segments(batches: Iterator[pa.RecordBatch], min_bytes: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text) to folded segments."""
    held = _Folder(False)
    for batch in batches:
        docs, rows = _keys(batch)
        for a, b in tk.pieces(batch[2], 1 << 19):
            data, offsets = tk.buffers(batch[2].slice(a, b - a))
            v, c, doc, at, n, itself = segments(data, offsets, min_bytes, gram)
            yield from held.add([v.view(np.int64), c.view(np.int64), docs[a:b][doc], rows[a:b][doc], at, n, itself.astype(np.int32) * SELF])
    yield from held.flush()
    tk.trim()


def _stream(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """One sorted partition of segments (anchor, content, place): repeats as a whole, and of anchors with several contents one row each.

    All first rows of the anchors at the partition's two ends are EDGE, as these may go on beyond it.
    """

    def settle(cols: list[np.ndarray], first: bool, last: bool) -> Iterator[pa.RecordBatch]:
        v, c, doc, row, at, n, flags = cols
        group = np.r_[True, v[1:] != v[:-1]]
        content = group | np.r_[True, c[1:] != c[:-1]]
        place = content | np.r_[True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1])]
        starts = np.flatnonzero(group)
        which = np.cumsum(group) - 1
        kinds = np.add.reduceat(content.astype(np.int64), starts)
        again = np.flatnonzero(place & ~content)
        flags = flags.copy()
        heads = np.flatnonzero(content)
        flags[heads[np.add.reduceat((place & ~content).astype(np.int64), heads) > 0]] |= FOLDED
        at_edge = np.zeros(len(starts), bool)
        at_edge[0] |= first
        at_edge[-1] |= last
        wanted = content & (at_edge[which] | (kinds[which] > 1) | ((flags & SELF) > 0))
        kind = np.where(at_edge[which], EDGE, SEGMENT)
        take = np.flatnonzero(wanted)
        if len(again):
            yield _table(REMOVED, [x[again] for x in (v, c, doc, row, at, n, flags)])
        if len(take):
            yield _table(kind[take], [x[take] for x in (v, c, doc, row, at, n, flags)])

    held: list[list[np.ndarray]] = []  # rows of the last anchor so far
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
        if held and held[-1][0][-1] == cols[0][0] and cols[0][-1] == cols[0][0]:
            held.append(cols)  # one anchor through and through
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        ready = [*held, [x[:cut] for x in cols]]
        whole = [np.concatenate(x) for x in zip(*ready, strict=True)]
        if len(whole[0]):
            yield from settle(whole, first, False)
            first = False
        held = [[x[cut:] for x in cols]]
    if held:
        yield from settle([np.concatenate(x) for x in zip(*held, strict=True)], first, True)
    tk.trim()


def _settled(rows: DataFrame, n: int, min_bytes: int) -> tuple[DataFrame, DataFrame]:
    """``(removed, several)`` of segments ``_COLS``: rows that repeat an earlier one as a whole, and the first row of each content of anchors that have several
    contents, or one that may repeat itself, with ``text``, the anchor's bytes of different texts."""
    keys = ["v", "c", "doc", "row", "at"]
    ordered = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    seen = materialize(ordered.mapInArrow(lambda it: _stream(it, min_bytes), _ROWS), "repeat-runs")
    # Contents that two partitions hold meet here, a row each.
    place = F.row_number().over(Window.partitionBy("v", "c").orderBy("doc", "row", "at"))
    edge = materialize(seen.filter(F.col("kind") == EDGE).withColumn("place", place), "repeat-edges")
    heads = edge.filter("place = 1").drop("place")
    # At most two anchors a partition lie at an edge.
    verdict = heads.groupBy("v").agg((F.min("c") < F.max("c")).alias("mixed")).filter("mixed")
    heads = heads.join(F.broadcast(verdict), "v", "left").filter(F.col("mixed").isNotNull() | (F.col("flags").bitwiseAND(SELF) > 0)).drop("mixed")
    again = edge.filter(F.expr("place > 1")).drop("place")
    removed = seen.filter(F.col("kind") == REMOVED).unionByName(again).select(*_COLS)
    several = seen.filter(F.col("kind") == SEGMENT).unionByName(heads).select(*_COLS)
    sizes = several.groupBy("v").agg(F.sum(F.col("n") + min_bytes - 1).alias("text")).filter(F.col("text") > MAX_TEXT)
    # Anchors beyond that size: each has over a megabyte of texts of its own.
    return removed, several.join(sizes, "v", "left").select(*_COLS, F.col("text").isNotNull().alias("split"))


def _with_docs(docs: DataFrame, rows: DataFrame, max_broadcast_mb: int) -> DataFrame:
    """``docs`` joined to ``rows`` (doc, row, ...; one of each document): broadcast if its bytes, which are added up first, are within the limit; else both are
    shuffled."""
    lists = [x for x, kind in rows.dtypes if kind.startswith("array")]
    size = rows.agg(F.sum(sum((F.size(x) * 24 for x in lists), F.lit(32))).alias("b")).first()["b"] or 0
    rows = F.broadcast(rows) if size <= max_broadcast_mb << 20 else rows
    left = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC)).alias("doc"), text_key("text").alias("row"), "doc_id", "text")
    return left.join(rows, ["doc", "row"], "left")


def _texts(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """(doc, row, text, segs) to the segments' bytes: (v, doc, row, at, n, split, bytes)."""
    fields = pa.struct([("v", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("split", pa.bool_())])
    for batch in batches:
        docs, rows = _keys(batch)
        for i, text in enumerate(batch[2].to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            segs = batch[3][i].values.cast(fields)
            at, n = segs.field("at"), segs.field("n")
            cut = [data[y : y + z + min_bytes - 1] for y, z in zip(at.to_pylist(), n.to_pylist(), strict=True)]
            same = [pa.array(np.full(len(segs), x[i])) for x in (docs, rows)]
            yield pa.RecordBatch.from_arrays([segs.field("v"), *same, at, n, segs.field("split"), pa.array(cut, pa.binary())], ["v", "doc", "row", "at", "n", "split", "bytes"])
    tk.trim()


def _cut_again(batches: Iterator[pa.RecordBatch], min_bytes: int, gram: int) -> Iterator[pa.RecordBatch]:
    """(v, doc, row, at, n, bytes) of anchors of too much text to folded segments of longer runs, with their bytes. Runs as long as windows: each window is a
    segment, which has one content."""
    held = _Folder(gram < min_bytes)
    for batch in batches:
        doc, row, at, n = (batch[i].to_numpy(zero_copy_only=False) for i in range(1, 5))
        for a, b in tk.pieces(batch[5], 1 << 18):
            data, offsets = tk.buffers(batch[5].slice(a, b - a))
            if gram < min_bytes:
                v, c, of, off, count, itself = segments(data, offsets, min_bytes, gram)
                raw = data.tobytes()
                cut = [raw[x : x + m + min_bytes - 1] for x, m in zip((off + offsets[of]).tolist(), count.tolist(), strict=True)]
            else:
                size = n[a:b]
                of, count = np.repeat(np.arange(b - a), size), np.ones(int(size.sum()), np.int64)
                off = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                v, c = (_window_hashes(data, off + offsets[of], min_bytes, salt) for salt in (1, 2))
                itself, cut = np.zeros(len(of), bool), None
            yield from held.add([v.view(np.int64), c.view(np.int64), doc[a:b][of], row[a:b][of], off + at[a:b][of], count, itself.astype(np.int32) * SELF], cut)
    yield from held.flush()
    tk.trim()


def _window_hashes(data: np.ndarray, spots: np.ndarray, size: int, salt: int) -> np.ndarray:
    values = tk.mix(_BYTES * _U(2 * salt + 1))
    power, back = _powers(_BASE, len(data)), _powers(pow(_BASE, -1, 1 << 64), len(data))
    total = np.r_[_U(0), np.cumsum(values[data] * power)]
    return tk.mix((total[spots + size] - total[spots]) * back[spots])


_SPANS = "doc long, row long, at int, len int, repeat long, first boolean"


def _spans(doc: np.ndarray, row: np.ndarray, at: np.ndarray, length: np.ndarray, repeat: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
    cols = [(doc, np.int64), (row, np.int64), (at, np.int32), (length, np.int32), (repeat, np.int64), (first, np.bool_)]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in cols], ["doc", "row", "at", "len", "repeat", "first"])


def _compare(batches: Iterator[pa.RecordBatch], min_bytes: int) -> Iterator[pa.RecordBatch]:
    """(v, doc, row, at, n, bytes) sorted by anchor, to the occurrences of maximal repeats. Anchors go whole into a suffix array, ``SORT`` bytes or one anchor."""

    def solve(cols: list[np.ndarray], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        _, doc, row, at, n = cols
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = n.astype(np.int64) + min_bytes - 1
        start = np.cumsum(size) - size
        order = np.lexsort((row, doc))
        new = np.r_[True, (doc[order][1:] != doc[order][:-1]) | (row[order][1:] != row[order][:-1])]
        number = np.empty(len(doc), np.int64)
        number[order] = np.cumsum(new)
        owner = np.repeat(np.arange(len(doc)), size)
        off = np.arange(len(data)) - start[owner] + at[owner]
        place = number[owner] << 32 | off
        spot, length, first = repeats(data, start, n.astype(np.int64), place, min_bytes)
        same = place[spot] == place[first]  # two segments of one anchor never overlap in windows, but be sure
        spot, length, first = spot[~same], length[~same], first[~same]
        if len(spot):
            o, f = owner[spot], owner[first]
            name = tk.mix(tk.mix(doc[f].view(_U) ^ tk.mix(row[f].view(_U))) ^ (off[first].astype(_U) << _U(32) | length.astype(_U))).view(np.int64)
            yield _spans(doc[o], row[o], off[spot], length, name, np.zeros(len(o), bool))
            _, once = np.unique(name, return_index=True)
            yield _spans(doc[f][once], row[f][once], off[first][once], length[once], name[once], np.ones(len(once), bool))

    cols: list[list[np.ndarray]] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cols.append([x.to_numpy(zero_copy_only=False) for x in batch.columns[:5]])
        more = batch[5].to_pylist()
        texts += more
        held += sum(map(len, more))
        if held >= SORT:
            whole = [np.concatenate(x) for x in zip(*cols, strict=True)]
            cut = int(np.flatnonzero(whole[0] != whole[0][-1])[-1]) + 1 if whole[0][0] != whole[0][-1] else 0
            begin = 0
            ends = np.flatnonzero(np.r_[whole[0][1:cut] != whole[0][: max(cut - 1, 0)], cut > 0][:cut]) + 1
            total = np.cumsum([len(x) for x in texts[:cut]]) if cut else np.zeros(0)
            for e in ends.tolist():
                if e == cut or total[e - 1] - (total[begin - 1] if begin else 0) >= SORT:
                    yield from solve([x[begin:e] for x in whole], texts[begin:e])
                    begin = e
            cols, texts = [[x[cut:] for x in whole]], texts[cut:]
            held = sum(map(len, texts))
    if texts:
        yield from solve([np.concatenate(x) for x in zip(*cols, strict=True)], texts)
    tk.trim()


def repeated_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, max_broadcast_mb: int = 64) -> DataFrame:
    """``(doc, row, at, len, repeat, first)``: occurrences of repeated strings of at least ``min_bytes`` bytes.

    ``doc`` is doc_id (NO_DOC for null), ``row`` the hash of the text, ``repeat`` names the repeat. Each occurrence that is not the first of its repeat is
    listed with the longest such repeat of its piece of text; the first is listed with the repeats of step 3. All bytes that an earlier equal string covers
    lie in rows that are not ``first``.
    """
    n = partitions_for(docs)
    keys = ["v", "doc", "row", "at", "n"]
    src = docs.select("doc_id", text_key("text").alias("row"), "text")
    grams = [int(x * min_bytes) for x in GRAMS]
    cut = materialize(src.mapInArrow(lambda it: _cut_segments(it, min_bytes, grams[0]), _ROWS), "segments")
    removed, several = _settled(cut.filter(F.col("kind") == SEGMENT).select(*_COLS), n, min_bytes)
    removed = cut.filter(F.col("kind") == REMOVED).select(*_COLS).unionByName(removed)
    wanted = materialize(several.groupBy("doc", "row").agg(F.collect_list(F.struct("v", "at", "n", "split")).alias("segs")), "segments-wanted")
    found = _with_docs(docs, wanted, max_broadcast_mb).filter("segs IS NOT NULL").select("doc", "row", "text", "segs")
    texts = materialize(found.mapInArrow(lambda it: _texts(it, min_bytes), "v long, doc long, row long, at int, n int, split boolean, bytes binary"), "segment-texts")
    short, long = texts.filter("NOT split").select(*keys, "bytes"), texts.filter("split").select(*keys, "bytes")
    for gram in [*grams[1:], min_bytes]:
        if not long.limit(1).count():
            break
        again = materialize(long.mapInArrow(lambda it, gram=gram: _cut_again(it, min_bytes, gram), _ROWS + (", bytes binary" if gram < min_bytes else "")), "segments-again")
        more, several = _settled(again.filter(F.col("kind") == SEGMENT).select(*_COLS), n, min_bytes)
        removed = removed.unionByName(again.filter(F.col("kind") == REMOVED).select(*_COLS)).unionByName(more)
        if gram == min_bytes:
            break
        # A place may be there twice, if its row is.
        held = again.filter(F.col("kind") == SEGMENT).select(*keys, "c", "bytes")
        texts = materialize(held.join(several.select(*keys, "c", "split").distinct(), [*keys, "c"]), "segment-texts")
        short = short.unionByName(texts.filter("NOT split").select(*keys, "bytes"))
        long = texts.filter("split").select(*keys, "bytes")
    trees = short.repartition(n, "v").sortWithinPartitions("v", "doc", "row", "at").mapInArrow(lambda it: _compare(it, min_bytes), _SPANS)
    whole = removed.select("doc", "row", "at", (F.col("n") + min_bytes - 1).cast("int").alias("len"), F.col("c").alias("repeat"), F.lit(False).alias("first"))
    return trees.unionByName(whole)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, row, spans) to (doc, row, from, to): maximal runs."""
    for batch in batches:
        lo, hi = [], []
        for i in range(batch.num_rows):
            s = batch[2][i].values
            at, length = s.field(0).to_numpy(zero_copy_only=False), s.field(1).to_numpy(zero_copy_only=False)
            order = np.argsort(at, kind="stable")
            a, e = at[order].astype(np.int64), np.maximum.accumulate((at + length)[order].astype(np.int64))
            new = np.r_[True, a[1:] > e[:-1]]
            lo.append(a[new])
            hi.append(e[np.r_[new[1:], True]])
        yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(lo, pa.list_(pa.int64())), pa.array(hi, pa.list_(pa.int64()))], ["doc", "row", "from", "to"])


def removed_runs(docs: DataFrame, min_bytes: int = MIN_BYTES, max_broadcast_mb: int = 64) -> DataFrame:
    """``(doc, row, from, to)``: per document that loses bytes, the maximal runs that it loses, in order."""
    spans = repeated_spans(docs, min_bytes, max_broadcast_mb=max_broadcast_mb).filter("NOT first")
    each = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("at", "len")).alias("spans"))
    return each.mapInArrow(_merge, "doc long, row long, from array<long>, to array<long>")


def cut_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, max_broadcast_mb: int = 64) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` per row of ``docs``; ``kept`` are the remaining bytes, which may cut a character."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, gone, spans = [], [], [], []
            for text, lo, hi in zip(*(batch[i].to_pylist() for i in (1, 2, 3)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                lo, hi = lo or [], hi or []
                kept.append(b"".join(data[a:b] for a, b in zip([0, *hi], [*lo, len(data)], strict=True)) if lo else data)
                sizes.append(len(data))
                gone.append(sum(hi) - sum(lo))
                spans.append(len(lo))
            yield pa.RecordBatch.from_arrays([batch[0], *[pa.array(x, pa.int64()) for x in (sizes, gone, spans)], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    src = docs.select("doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    runs = materialize(removed_runs(src, min_bytes, max_broadcast_mb), "repeat-cuts")
    marked = _with_docs(src, runs, max_broadcast_mb).select("doc_id", "text", "from", "to")
    return marked.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
