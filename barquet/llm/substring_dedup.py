"""Substring dedup (operator 8): fixed-block anchors.

A repeat of ``window`` words holds, wherever it starts, a whole block of
``(window + 1) // 2`` words that starts at a multiple of the block's length in
the earlier document. So blocks at these places are the index, and every
rolling run of a block's length in every document probes it.

Index entries and probes of some megabytes of text, a unit, travel as one row a
hash bucket: sorted hashes of as many bits as the corpus needs, as differences,
with the ids of the documents they come from. A unit has at most
``2 ** COARSE_BITS`` buckets, so rows and ids grow in proportion to the text;
where the corpus needs more buckets, the rows of a coarse one are dealt again to
finer ones, some millions of entries at a time. A hash that many documents of a
unit share is settled there: all of them are candidates, and two entries, the
smallest indexed id and the largest id, travel for it. So is a window: those
after a unit's smallest document are repeats, and only that one's entry travels.
A passage that stands in every document thus costs a bucket an entry a unit.

What a probe hits is only a candidate: around hits, whole windows are compared
by 128-bit BLAKE2 digests of their words, and each window that also starts in an
earlier document extends the repeat by one word, up to the maximal one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .tokens import by_bytes

UNIT_BYTES, UNIT_TEXTS = 4 << 20, 1 << 12
BUCKET_WINDOWS = 500_000
#: Buckets that a unit's rows go to are at most 2 to this power; entries that are dealt again to finer ones at a time.
COARSE_BITS, DEALT_AGAIN = 12, 4_000_000
#: A hash that more documents share than this is settled where they meet.
SHARED = 8
_BASE = pow(0x9E3779B97F4A7C15, 3, 1 << 64) | 1
_LAST = np.iinfo(np.int64).max
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORTH = _BACK = np.ones(1, _U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _FORTH, _BACK
    if len(_FORTH) < n:
        _FORTH, _BACK = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
    return _FORTH, _BACK


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts in a row, and each text's number of words."""
    words = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).cast(pa.large_string()))
    flat = words.flatten()
    size = pc.binary_length(flat).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    offset = int(np.frombuffer(flat.buffers()[1], np.int64)[flat.offset]) if len(flat) else 0
    total = int(ends[-1]) if len(ends) else 0
    data = np.frombuffer(flat.buffers()[2], np.uint8)[offset : offset + total] if total else np.array([], np.uint8)
    forth, back = _tables(total + 1)
    sums = np.append(_U(0), np.cumsum((data.astype(_U) + _U(1)) * back[:total], dtype=_U))
    n_words = pc.list_value_length(words).to_numpy().astype(np.int64)
    real = size > 0  # white space at an end of a text leaves an empty word there
    if not real.all():
        n_words = np.bincount(np.repeat(np.arange(len(n_words)), n_words)[real], minlength=len(n_words))
        ends, size = ends[real], size[real]
    starts = ends - size
    return _mix((sums[ends] - sums[starts]) * forth[starts] + size.astype(_U)), n_words


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words that start at each place, as far as there are k."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, _U)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + words[j : j + n]
    return _mix(out)


def _planes(values: np.ndarray) -> bytes:
    """Integers, byte by byte of their width, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _values(raw: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _in_document(n_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each place where k words start: is it within one document, and its place there."""
    ends = np.cumsum(n_words)
    inside = np.arange(int(n_words.sum())) - np.repeat(ends - n_words, n_words)
    return inside + k <= np.repeat(n_words, n_words), inside


def _settled(first: np.ndarray, group: np.ndarray, ids: np.ndarray, aligned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries in groups of equal hashes: which are candidates already, as
    their hash is shared by many, and which must travel. ``first`` is where each
    group starts, ``group`` each entry's group."""
    many = (np.diff(np.append(first, len(ids))) > SHARED)[group]
    if not many.any():
        return many, ~many
    least = np.minimum.reduceat(np.where(aligned, ids, _LAST), first)[group]
    most = np.maximum.reduceat(ids, first)[group]
    return many, ~many | (aligned & (ids == least)) | (ids == most)


def _entry_row(bucket: int, h: np.ndarray, ids: np.ndarray, aligned: np.ndarray) -> tuple:
    """Sorted hashes within a bucket, the documents they come from, and whether they stand at a block's place."""
    used, local = np.unique(ids, return_inverse=True)
    return bucket, _planes(used), _planes(np.diff(h, prepend=np.int64(0))), _planes(local.astype("<u4")), np.packbits(aligned).tobytes()


def _entries(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = np.cumsum(_values(row["h"], "<i8"))
    return h, _values(row["ids"], "<i8")[_values(row["doc"], "<u4")], np.unpackbits(np.frombuffer(row["aligned"], np.uint8), count=len(h)).astype(bool)


def _candidate_row(bucket: int, h: np.ndarray, ids: np.ndarray) -> tuple:
    """Candidates that are settled: they travel to any bucket, and through it."""
    return bucket, _planes(ids), _planes(h), None, None


def _sieve_rows(ids: np.ndarray, texts: pa.Array, block: int, bits: int, bucket_bits: int) -> Iterator[tuple]:
    words, n_words = word_hashes(texts)
    h = run_hashes(words, block)
    whole, inside = _in_document(n_words, block)
    whole, inside = whole[: len(h)], inside[: len(h)]
    doc = np.repeat(np.arange(len(n_words)), n_words)[: len(h)]
    key = ((h >> _U(64 - bits)) << _U(13)) | (doc.astype(_U) << _U(1)) | (inside % block != 0).astype(_U)
    key = np.sort(key[whole])
    if not len(key):
        return
    key = key[np.append(True, key[1:] >> _U(1) != key[:-1] >> _U(1))]  # once in a document; at a block's place if there is one
    h, own, aligned = (key >> _U(13)).astype(np.int64), ids[((key >> _U(1)) & _U(0xFFF)).astype(np.int64)], (key & _U(1)) == 0
    new = np.append(True, h[1:] != h[:-1])
    sure, sent = _settled(np.flatnonzero(new), np.cumsum(new) - 1, own, aligned)
    if sure.any():
        yield _candidate_row(int(h[0]) & ((1 << bucket_bits) - 1), h[sure], own[sure])
        h, own, aligned = h[sent], own[sent], aligned[sent]
    rest = bits - bucket_bits
    cuts = np.searchsorted(h, np.arange((1 << bucket_bits) + 1) << rest).tolist()
    for b in range(1 << bucket_bits):
        lo, hi = cuts[b], cuts[b + 1]
        if lo < hi:
            yield _entry_row(b, h[lo:hi] & ((1 << rest) - 1), own[lo:hi], aligned[lo:hi])


def _units(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[int, pa.Array]]:
    at = 0
    for texts in by_bytes(batch.column(text_at), UNIT_BYTES):
        for first in range(0, len(texts), UNIT_TEXTS):
            some = texts.slice(first, UNIT_TEXTS)
            yield at + first, some
        at += len(texts)


def _per_document(doc: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(doc, kind="stable")
    doc, values = doc[order], values[order]
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.array([], int)
    for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)]):
        yield int(doc[lo]), values[lo:hi]


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by keys, where its groups start, and each ordered row's group."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _window_rows(bucket: np.ndarray, raw: np.ndarray, keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> Iterator[tuple]:
    """Rows of windows' digests by bucket, with their documents (places in
    ``keys``: id and hash of the text) and places. Of equal ones those after the
    smallest id are repeats and go as such, in a row without digests."""
    digest = raw.view("<u8").reshape(-1, 2)
    order, first, group = _grouped(bucket, digest[:, 0], digest[:, 1])
    bucket, raw, doc, place = bucket[order], raw[order], doc[order], place[order]
    again = keys[doc, 0] > np.minimum.reduceat(keys[doc, 0], first)[group]

    def row(which, digests: bytes | None) -> tuple:
        used, local = np.unique(doc[which], return_inverse=True)
        return keys[used].astype("<i8").tobytes(), digests, _planes(local.astype("<u4")), _planes(place[which].astype("<u4"))

    if again.any():
        yield int(bucket[0]), *row(again, None)
        bucket, raw, doc, place = bucket[~again], raw[~again], doc[~again], place[~again]
    cuts = [*np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    for lo, hi in zip([0, *cuts], cuts):
        if lo < hi:
            yield int(bucket[lo]), *row(slice(lo, hi), raw[lo:hi].tobytes())


def _windows(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["keys"], "<i8").reshape(-1, 2)[_values(row["doc"], "<u4")], _values(row["place"], "<u4")


ENTRY, WINDOW = "bucket int, ids binary, h binary, doc binary, aligned binary", "bucket int, keys binary, digest binary, doc binary, place binary"


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 4)], names)


def _finer(rows: DataFrame, schema: str, size: Callable[[dict], int], deal: Callable[[int, list[dict]], Iterator[tuple]]) -> DataFrame:
    """Rows of coarse buckets dealt again: those of one bucket are gathered up to
    ``DEALT_AGAIN`` entries, and ``deal`` makes rows of finer buckets of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, entries = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["bucket"] != held[0]["bucket"] or entries > DEALT_AGAIN):
                    yield _record(list(deal(held[0]["bucket"], held)), schema)
                    held, entries = [], 0
                held.append(row)
                entries += size(row)
        if held:
            yield _record(list(deal(held[0]["bucket"], held)), schema)

    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def repeated_places(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``doc_id, th, text`` of documents that may hold repeats, and ``doc_id,
    th, places``: little-endian 32-bit places of words where a window starts
    that also starts in a document with a smaller id."""
    block = (window + 1) // 2
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    about = int((base.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 5) + 1
    bucket_bits = max(0, (about // BUCKET_WINDOWS).bit_length())
    coarse = min(bucket_bits, COARSE_BITS)
    bits = min(51, max(about.bit_length() + 9, bucket_bits + 8))
    sub, rest = bucket_bits - coarse, bits - bucket_bits

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in _units(batch, 1):
                rows = list(_sieve_rows(ids[at : at + len(texts)], texts, block, bits, coarse))
                if rows:
                    yield _record(rows, ENTRY)

    def gathered(rows: list[dict]) -> tuple:
        """All entries by hash, and where their groups start; and settled candidates."""
        sent, sure = [_entries(r) for r in rows if r["doc"] is not None], [(_values(r["h"], "<i8"), _values(r["ids"], "<i8")) for r in rows if r["doc"] is None]
        h, ids, aligned = map(np.concatenate, zip(*sent)) if sent else (np.array([], np.int64), np.array([], np.int64), np.array([], bool))
        order, first, group = _grouped(h)
        sure_h, sure_ids = map(np.concatenate, zip(*sure)) if sure else (np.array([], np.int64),) * 2
        return h[order], ids[order], aligned[order], first, group, sure_h, sure_ids

    def deal_entries(bucket: int, rows: list[dict]) -> Iterator[tuple]:
        h, ids, aligned, first, group, sure_h, sure_ids = gathered(rows)
        if len(h):
            sure, sent = _settled(first, group, ids, aligned)
            sure_h, sure_ids = np.append(sure_h, h[sure] + (bucket << (rest + sub))), np.append(sure_ids, ids[sure])
            h, ids, aligned = h[sent], ids[sent], aligned[sent]
            cuts = np.searchsorted(h, np.arange((1 << sub) + 1) << rest).tolist()
            for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                if lo < hi:
                    yield _entry_row((bucket << sub) + b, h[lo:hi] & ((1 << rest) - 1), ids[lo:hi], aligned[lo:hi])
        if len(sure_h):
            yield _candidate_row((bucket << sub) + int(sure_ids[0]) % (1 << sub), sure_h, sure_ids)

    def probe(table: pa.Table) -> pa.Table:
        h, ids, aligned, first, group, sure_h, sure_ids = gathered(table.to_pylist())
        if len(h):
            least = np.minimum.reduceat(np.where(aligned, ids, _LAST), first)[group]
            most = np.maximum.reduceat(ids, first)[group]
            hit = (ids > least) | (aligned & (ids < most))
            sure_h, sure_ids = np.append(sure_h, h[hit] + (int(table.column("bucket")[0].as_py()) << rest)), np.append(sure_ids, ids[hit])
        rows = [(d, np.unique(v).astype("<u8").tobytes()) for d, v in _per_document(sure_ids, sure_h)]
        return pa.table({"doc_id": pa.array([d for d, _ in rows], pa.int64()), "hits": pa.array([v for _, v in rows], pa.binary())})

    entries = base.select("doc_id", "text").mapInArrow(sieve, ENTRY)
    if sub:
        entries = _finer(entries, ENTRY, lambda r: 8 * len(r["aligned"] or b""), deal_entries)
    found = entries.groupBy("bucket").applyInArrow(probe, "doc_id long, hits binary")
    # Written before it meets the texts, so that the entries' shuffle is gone by then; so are the places.
    found = materialise(found.groupBy("doc_id").agg(F.collect_list("hits").alias("hits")), compression="zstd")
    maybe = materialise(base.join(found, "doc_id"), compression="zstd")

    def window_buckets(raw: np.ndarray, n: int) -> np.ndarray:
        return raw[:, :4].copy().view(">u4").ravel().astype(np.int64) >> (32 - n) if n else np.zeros(len(raw), np.int64)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            for at, texts in _units(batch, 2):
                words, n_words = word_hashes(texts)
                ends = np.cumsum(n_words)
                digests, docs_at, places = [], [], []
                for i, text in enumerate(texts):
                    n = int(n_words[i])
                    if n < window:
                        continue
                    own = run_hashes(words[ends[i] - n : ends[i]], block) >> _U(64 - bits)
                    hit = np.isin(own, np.frombuffer(b"".join(batch.column(3)[at + i].as_py()), "<u8"))
                    sums = np.append(0, np.cumsum(hit))
                    starts = np.flatnonzero(sums[window - block + 1 :] - sums[: n - window + 1])
                    if len(starts):
                        parts = text.as_buffer().to_pybytes().split()
                        joined = b" ".join(parts)
                        stop = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
                        begin = np.append(0, stop[:-1] + 1)
                        digests.extend([blake2b(joined[a:b], digest_size=16).digest() for a, b in zip(begin[starts].tolist(), stop[starts + window - 1].tolist())])
                        docs_at.append(np.full(len(starts), i, np.int64))
                        places.append(starts)
                if digests:
                    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
                    yield _record(list(_window_rows(window_buckets(raw, coarse), raw, keys, at + np.concatenate(docs_at), np.concatenate(places))), WINDOW)

    def deal_windows(bucket: int, rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            if r["digest"] is None:
                yield (bucket << sub) + len(r["place"]) % (1 << sub), r["keys"], None, r["doc"], r["place"]
        rows = [r for r in rows if r["digest"] is not None]
        if rows:
            raw = np.frombuffer(b"".join(r["digest"] for r in rows), np.uint8).reshape(-1, 16)
            key, place = map(np.concatenate, zip(*map(_windows, rows)))
            keys, doc = np.unique(key, axis=0, return_inverse=True)
            yield from _window_rows(window_buckets(raw, bucket_bits), raw, keys, doc.ravel(), place)

    def extend(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sent, sure = [r for r in rows if r["digest"] is not None], [_windows(r) for r in rows if r["digest"] is None]
        if sent:
            digest = np.frombuffer(b"".join(r["digest"] for r in sent), "<u8").reshape(-1, 2)
            key, place = map(np.concatenate, zip(*map(_windows, sent)))
            order, first, group = _grouped(digest[:, 0], digest[:, 1])
            key, place = key[order], place[order]
            again = key[:, 0] > np.minimum.reduceat(key[:, 0], first)[group]
            sure.append((key[again], place[again]))
        key, place = map(np.concatenate, zip(*sure)) if sure else (np.zeros((0, 2), np.int64), np.array([], np.int64))
        pairs, of = np.unique(key, axis=0, return_inverse=True) if len(key) else (key, np.array([], int))
        rows = [(pairs[k], v.astype("<u4").tobytes()) for k, v in _per_document(of.ravel(), place)]
        return pa.table({"doc_id": pa.array([int(k[0]) for k, _ in rows], pa.int64()), "th": pa.array([int(k[1]) for k, _ in rows], pa.int64()), "places": pa.array([v for _, v in rows], pa.binary())})

    windows = maybe.select("doc_id", "th", "text", "hits").mapInArrow(compare, WINDOW)
    if sub:
        windows = _finer(windows, WINDOW, lambda r: len(r["digest"] or b"") // 16, deal_windows)
    places = windows.groupBy("bucket").applyInArrow(extend, "doc_id long, th long, places binary")
    places = places.groupBy("doc_id", "th").agg(F.collect_list("places").alias("places"))
    return maybe.select("doc_id", "th", "text"), materialise(places, compression="zstd")


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, kept, n_words, n_removed``: of documents that lose words,
    the words that stay, joined by one space; ``th`` is XXH64 of the text."""
    texts, places = repeated_places(docs, window, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, total, gone = [], [], []
            for text, raw in zip(batch.column(2), batch.column(3)):
                words = text.as_buffer().to_pybytes().split()
                change = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.frombuffer(b"".join(raw.as_py()), "<u4"))
                change[at] += 1
                change[at + window] -= 1
                stay = np.cumsum(change)[:-1] == 0
                out.append(b" ".join([words[i] for i in np.flatnonzero(stay).tolist()]))
                total.append(len(words))
                gone.append(len(words) - int(stay.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "th", "kept", "n_words", "n_removed"])

    return texts.join(places, ["doc_id", "th"]).mapInArrow(cut, "doc_id long, th long, kept string, n_words long, n_removed long")


def repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept_sha256``.

    A word goes if a window of ``window`` words covers it that also starts in a
    document with a smaller id; windows are judged on the input. Null and empty
    texts have no words. Ids are whole numbers (another type is an error of the
    cast); a null id counts as 2**63 - 1, the largest there is, and so as no
    earlier than a row that has that id. Rows that repeat an id are not earlier
    than each other. An empty table gives an empty result; other columns are
    ignored.
    """
    changed = remove_repeats(docs, window, id_col, text_col).select("doc_id", "th", "n_removed", F.sha2("kept", 256).alias("sha")).distinct()
    changed = changed.withColumnsRenamed({"doc_id": "c_id", "th": "c_th"})
    norm = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " "))
    every = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"),
        F.xxhash64(F.col(text_col)).alias("th"),
        F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        F.sha2(norm, 256).alias("whole"),
    )
    joined = every.join(changed, (F.col("key") == F.col("c_id")) & (F.col("th") == F.col("c_th")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "whole").alias("kept_sha256"))
