"""Exact substring dedup: every byte covered by a string of 200 bytes that also starts anywhere else is removed.

Sharding. Each 200-byte window has an anchor, its least 32-byte gram by hash (the first of equals), which depends on the
window's content alone, so equal windows have equal anchors. Consecutive windows with one anchor form a *strip* (about 85
windows, under 400 bytes). A first pass sends a small row for each strip: hashes of its anchor and of its bytes, and
where it is. Equal strips are aggregated before the shuffle. Only strips whose anchor occurs again matter from here on, and
only one occurrence of each different strip has its bytes fetched.

Suffix arrays by bucket-pointer refinement. Strips of one anchor meet in one task, sorted by anchor; some MB of whole anchor
groups at a time are joined to a text whose suffixes are put in buckets by their first 8 bytes; then buckets are refined,
some at a time and down to the last, by sorting on the bucket pointers of later offsets, which those refined before have
already updated. What repeats goes back to all occurrences of the strip, and a document's ranges are merged.

Hot anchors. All windows are judged by that refinement; what differs is only how an anchor's strips are dealt out. Those of
an anchor with over ``KINDS`` different ones (a passage in very many contexts) are cut into pieces of up to ``WIDTHS[0]``
windows, at equal distances from the anchor; a piece goes to the shard of the bytes that all windows of such a piece have
in common, and equal pieces are summed before the shuffle. Shards that are still crowded are cut once more, into single
windows, whose shards hold one string each. Joins on anchors and strips deal hot keys over tasks (``spread``).

Defined results: null is an empty text; texts under 200 bytes keep everything; repeated rows repeat each other's strings;
a null doc_id keeps its row; rows are told apart by two 64-bit hashes of id and text; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import blocks, column, joined_bytes, utf8
from .components import written
from .spread import LEAST, hot_keys, spread_join

LENGTH, GRAM = 200, 32
#: Most different strips (or pieces) of a shard; beyond it the shard is dealt out again by more of the bytes.
KINDS = 256
#: Windows of a piece of a strip, at the first and the second dealing.
WIDTHS = (16, 1)
#: Suffixes that are refined together, and how few of them wait for the next ones.
TOGETHER, FEW = 1 << 15, 1 << 12
#: Bytes of text in a suffix array (more only if one anchor's strips have more).
TEXT = 1 << 20
_BLOCK = 1 << 17
_LOW = np.uint64((1 << 20) - 1)
_TABLE = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, np.uint64)
_FACTORS = (np.random.Generator(np.random.PCG64(40)).integers(0, 2**63, 6, np.uint64) << np.uint64(1)) | np.uint64(1)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of each 32-byte gram."""
    h, width = _TABLE[raw], 1
    for factor in _FACTORS[:5]:
        h = h[:-width] * factor + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= _FACTORS[5]
    return h ^ (h >> np.uint64(32))


def strips(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor hash of each strip; no window crosses ``ends`` of documents."""
    room = np.zeros(len(raw) + 1, np.int32)
    np.add.at(room, ends[:-1], 1)
    np.add.at(room, np.maximum(ends[:-1], ends[1:] - length + 1), -1)
    valid = np.cumsum(room[:-1]) > 0
    span = length - GRAM + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, max(0, len(raw) - length + 1), _BLOCK):
        n = min(_BLOCK, len(raw) - length + 1 - a)
        ok = valid[a : a + n]
        if not ok.any():
            continue
        h = gram_hashes(raw[a : a + n + length - 1])
        least = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[: n], least[span - width : span - width + n])
        at = (least & _LOW).astype(np.int64)
        begins = ok.copy()
        begins[1:] &= (at[1:] != at[:-1]) | ~ok[:-1]
        first = np.flatnonzero(begins)
        stops = ok & np.concatenate((~ok[1:] | (at[1:] != at[:-1]), [True]))
        out.append((first + a, np.flatnonzero(stops) - first + 1, h[at[first]]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_windows(strings: list[bytes], weights: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(number of the string, offset) of each window that occurs again, a string of weight w standing for w of it.

    ``pointer`` names each suffix's bucket by its first place in the order, and all suffixes of a bucket agree in ``depth``
    bytes. Refining a bucket sorts it by the pointers that its suffixes have ``depth`` bytes on, so a suffix gains as many
    bytes as the bucket met there has by then. Some buckets are refined at a time, down to the last, before the next ones:
    what they found out shortens the way of all that meet them later.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    n = int(sizes.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(strings)), sizes)
    left = np.repeat(begin + sizes, sizes) - np.arange(n)  # bytes from here to the string's end
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | text[k : k + n]
    short = np.flatnonzero(left < 8)
    beyond = (8 * (8 - left[short])).astype(np.uint64)
    word[short] = (word[short] >> beyond) << beyond
    need = np.minimum(left, length).astype(np.int32)  # no more bytes of a suffix matter to any window
    # the windows of a string that occurs again do so too; a bucket of nothing else is left as it is
    again = weights[owner] > 1
    asks = (left >= length) & ~again
    # the end of a string is the suffix n: before all others, and nothing follows that could tell two of them apart
    pointer, depth = np.zeros(n + 1, np.int64), np.full(n + 1, 8, np.int32)
    depth[n] = length

    def settle(positions: np.ndarray, keys: np.ndarray, deep: np.ndarray, old: np.ndarray | None) -> np.ndarray:
        """Give buckets of equal keys their pointers and depths; what is to be refined further, in order."""
        order = np.argsort(keys)
        keys, positions = keys[order], positions[order]
        first = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        count = np.diff(np.concatenate((first, [len(keys)])))
        place = first + 1
        if old is not None:  # places inside the bucket that is refined
            old = old[order][first]
            outer = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            place = old + first - np.repeat(first[outer], np.diff(np.concatenate((outer, [len(first)]))))
        pointer[positions] = np.repeat(place, count)
        some = np.flatnonzero(count > 1)  # nobody else meets a suffix that is alone in its bucket
        if not len(some):
            return positions[:0]
        inside = np.repeat(count > 1, count)
        positions, deep, count = positions[inside], deep[order[inside]], count[some]
        first = np.cumsum(count) - count
        run = np.repeat(np.arange(len(first)), count)
        depth[positions] = reached = np.minimum.reduceat(deep, first)[run]
        open_ = (reached < need[positions]) & np.logical_or.reduceat(asks[positions], first)[run]
        positions, run = positions[open_], run[open_]
        return positions[np.bincount(run, minlength=len(first))[run] > 1]

    rest = settle(np.arange(n), word, depth[:n], None)
    edges = np.flatnonzero(np.diff(pointer[rest])) + 1
    cuts = [0, *edges[np.flatnonzero(np.diff(edges // TOGETHER)) + 1].tolist(), len(rest)]
    held = rest[:0]
    for a, b in zip(cuts, cuts[1:]):
        held = np.concatenate((held, rest[a:b]))
        while len(held) > (FEW if b < len(rest) else 0):
            d = depth[held]
            on = np.where(d < left[held], held + d, n)
            held = settle(held, (pointer[held] << 32) | pointer[on], d + depth[on], pointer[held])
    # equal windows are neighbours now; a bucket may know more than a window's bytes, so neighbours are compared
    here = np.flatnonzero(left >= length)
    here = here[np.argsort(pointer[here])]
    if not len(here):
        return here, here
    same = np.concatenate(([False], pointer[here[1:]] == pointer[here[:-1]]))
    alive = np.flatnonzero(~same[1:])
    for k in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        alive = alive[word[here[alive] + k] == word[here[alive + 1] + k]]
    same[alive + 1] = True
    run = np.cumsum(~same) - 1
    some = np.sort(here[again[here] | (np.bincount(run)[run] > 1)])
    return owner[some], some - begin[owner[some]]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for part in blocks(batch):
            raw, ends = joined_bytes(part)
            first, n, gram = strips(raw, ends)
            if not len(first):
                continue
            doc = np.searchsorted(ends, first, side="right") - 1
            view = memoryview(raw)
            body = np.fromiter((digest(view[a:b]) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist())), np.uint64, len(first))
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(body.view(np.int64)), column(part, "row1").take(rows), column(part, "row2").take(rows), pa.array((first - ends[doc]) << 16 | n)],
                ["gram", "body", "row1", "row2", "place"],
            )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are packed before they are shuffled; short texts of one language pack badly in Spark's own blocks."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for part in blocks(batch):
            yield pa.RecordBatch.from_arrays([*(column(part, c) for c in ("doc_id", "row1", "row2")), pa.array([pack(t or b"") for t in utf8(part)], pa.binary())], ["doc_id", "row1", "row2", "packed"])


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for part in blocks(batch, "packed", 1 << 20):
            lists = column(part, "wanted")
            doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            rows = lists.flatten()
            texts = [unpack(t) for t in utf8(part, "packed")]
            place = rows.field("place").to_numpy()
            first, n = place >> 16, place & 0xFFFF
            data = [texts[d][a:b] for d, a, b in zip(doc.tolist(), first.tolist(), (first + n + LENGTH - 1).tolist())]
            yield pa.RecordBatch.from_arrays([rows.field("gram"), rows.field("body"), rows.field("weight"), pa.array(data, pa.binary())], ["gram", "body", "weight", "data"])


_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _refined(rows: DataFrame, shard: list[str], ids: list[str]) -> DataFrame:
    """``(shard..., ids..., weight, data)`` -> ``(ids..., runs)``: the runs of windows that occur again in a shard."""
    rows = rows.select(*dict.fromkeys([*shard, *ids]), "weight", "data")
    return rows.repartition(*shard).sortWithinPartitions(*dict.fromkeys([*shard, *ids])).mapInArrow(_refine(shard[0], ids), ", ".join([*(f"{c} long" for c in ids), "runs array<struct<a:int,b:int>>"]))


def _refine(shard: str, ids: list[str]):
    """Strips come sorted by shard; whole shards are sorted together, about ``TEXT`` bytes at a time."""

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        both = np.stack([rows[c].to_numpy() for c in ids])  # repeated documents send their strips again
        rows = rows.take(pa.array(np.flatnonzero(np.concatenate(([True], (both[:, 1:] != both[:, :-1]).any(0))))))
        strings = rows["data"].to_pylist()
        owner, at = repeated_windows(strings, rows["weight"].to_numpy().astype(np.float64))
        if not len(owner):
            return
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)))
        first = np.flatnonzero(new)
        last = np.concatenate((first[1:], [len(at)])) - 1
        who = owner[first]
        cut = np.concatenate(([True], who[1:] != who[:-1]))
        offsets = np.concatenate((np.flatnonzero(cut), [len(who)])).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(at[first].astype(np.int32)), pa.array((at[last] + 1).astype(np.int32))], ["a", "b"])
        picked = rows.select(ids).take(pa.array(who[cut]))
        yield pa.RecordBatch.from_arrays([*(pa.array(picked[c].to_numpy()) for c in ids), pa.ListArray.from_arrays(pa.array(offsets), runs)], [*ids, "runs"])

    def solved_by_text(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key = rows[shard].to_numpy()
        sizes = np.cumsum([len(x) for x in rows["data"].to_pylist()])
        edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        part = sizes[edges] // TEXT
        cuts = [*edges[np.concatenate(([True], part[1:] != part[:-1]))].tolist(), len(key)]
        for a, b in zip(cuts, cuts[1:]):
            yield from solved(rows.slice(a, b - a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        held_bytes = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            held_bytes += batch.nbytes
            if held_bytes >= 8 * TEXT:
                rows = pa.Table.from_batches(held)
                key = rows[shard].to_numpy()
                whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
                if whole:
                    yield from solved_by_text(rows.slice(0, whole))
                rest = rows.slice(whole).combine_chunks()
                held = rest.to_batches()
                held_bytes = sum(x.nbytes for x in held)
        if held:
            yield from solved_by_text(pa.Table.from_batches(held))

    return run


_PIECES = "k1 long, k2 long, p1 long, p2 long, gram long, body long, weight long, anchor int, low int, data binary"
_PIECES_NAMES = ["k1", "k2", "p1", "p2", "gram", "body", "weight", "anchor", "low", "data"]


def _halves(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))


def _pieces(width: int):
    """Cut strips into pieces of up to ``width`` windows at equal distances from the anchor; (k1, k2) is the hash of the bytes
    that all windows of such a piece have in common, (p1, p2) that of the piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in blocks(batch, "data", max(1 << 14, TEXT * width // 64)):
                cores, pieces, rows, lows, data = [], [], [], [], []
                for i, (strip, anchor) in enumerate(zip(column(part, "data").to_pylist(), column(part, "anchor").to_pylist())):
                    n = len(strip) - LENGTH + 1
                    for c in range((anchor - n + 1) // width, anchor // width + 1):
                        high = anchor - width * c
                        low, high_ = max(0, high - width + 1), min(n - 1, high)
                        if low > high_:
                            continue
                        c = c.to_bytes(2, "little")
                        cores.append(digest(strip[high : high - width + 1 + LENGTH] + c))
                        data.append(strip[low : high_ + LENGTH])
                        pieces.append(digest(data[-1] + c))
                        rows.append(i)
                        lows.append(low)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*_halves(cores), *_halves(pieces), *(column(part, c).take(take) for c in ("gram", "body", "weight", "anchor")), pa.array(lows, pa.int32()), pa.array(data, pa.binary())], _PIECES_NAMES)

    return run


def _with_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where in its strip an anchor begins."""
    for batch in batches:
        grams = column(batch, "gram").to_numpy().view(np.uint64)
        at = [int(np.flatnonzero(gram_hashes(np.frombuffer(d, np.uint8)) == g)[0]) for d, g in zip(column(batch, "data").to_pylist(), grams)]
        yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in ("gram", "body", "weight")), pa.array(at, pa.int32()), column(batch, "data")], ["gram", "body", "weight", "anchor", "data"])


def _dealt_again(strips_of: DataFrame, kinds: int, widths: tuple[int, ...]) -> DataFrame:
    """``(gram, body, weight, anchor, data)`` of different strips in crowded shards -> ``(gram, body, runs)``."""
    shard, piece = ["k1", "k2"], ["p1", "p2"]
    pieces = strips_of.mapInArrow(_pieces(widths[0]), _PIECES)
    different = written(pieces.groupBy(*shard, *piece).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.first("data").alias("data"), F.first(F.col("anchor") - F.col("low")).alias("anchor")))
    shards = written(different.groupBy(*shard).agg(F.count("*").alias("kinds"), F.sum("weight").alias("all")).where("`all` > 1").drop("all"))
    hot = hot_keys(shards, shard, "kinds")
    many = shards.where(F.col("kinds") > kinds)
    plain = spread_join(different, shards.where(F.col("kinds") <= kinds).select(*shard), shard, hot, piece, "left_semi")
    solved = written(_refined(plain, shard, piece))
    if len(widths) > 1 and not many.isEmpty():
        rest = spread_join(different, many.select(*shard), shard, hot, piece, "left_semi")
        rest = rest.select(F.col("p1").alias("gram"), F.col("p2").alias("body"), "weight", "anchor", "data")
        solved = solved.unionByName(_dealt_again(rest, kinds, widths[1:]).select(F.col("gram").alias("p1"), F.col("body").alias("p2"), "runs"))
    places = spread_join(pieces.select(*piece, "gram", "body", "low"), solved, piece, hot_keys(different, piece), ["gram", "body", "low"])
    return written(places.select("gram", "body", F.transform("runs", lambda r: F.struct((F.col("low") + r["a"]).alias("a"), (F.col("low") + r["b"]).alias("b"))).alias("runs")))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, done = [], 0
    for a, b in ranges:
        out.append(text[done:a])
        done = b
    return b"".join(out) + text[done:]


def _keyed(docs: DataFrame) -> DataFrame:
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("row1"), F.xxhash64(F.lit(1), doc_id, text).alias("row2"), text.alias("text"))


def repeats(docs: DataFrame, packed: DataFrame, kinds: int = KINDS) -> DataFrame:
    """``docs(row1, row2, text)`` and the same with packed texts -> ``(row1, row2, ranges)``: for each document with
    repeats the byte ranges, unmerged."""
    row, strip = ["row1", "row2"], ["gram", "body"]
    found = docs.mapInArrow(_anchors, "gram long, body long, row1 long, row2 long, place long")
    again = written(found.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    some = written(spread_join(found, again.select("gram"), ["gram"], hot_keys(again, ["gram"]), ["row1", "place"], "left_semi"))  # mostly a fraction of the strips
    different = written(some.groupBy(*strip).agg(F.count("*").alias("weight"), F.min(F.struct(*row, "place")).alias("one")))
    shards = written(different.groupBy("gram").agg(F.count("*").alias("kinds")).where(F.col("kinds") > min(kinds, LEAST)))
    many = shards.where(F.col("kinds") > kinds).select("gram")

    def bytes_of(rows: DataFrame) -> DataFrame:
        wanted = rows.groupBy(*(F.col("one")[c].alias(c) for c in row)).agg(F.collect_list(F.struct(*strip, "weight", F.col("one.place").alias("place"))).alias("wanted"))
        return packed.join(wanted, row).select("packed", "wanted").mapInArrow(_fetch, "gram long, body long, weight long, data binary")

    if many.isEmpty():
        solved = _refined(bytes_of(different), ["gram"], strip)
    else:
        hot = hot_keys(shards, ["gram"], "kinds", different.count())
        part = lambda how: bytes_of(spread_join(different, many, ["gram"], hot, ["body"], how))
        # repeated rows send a strip's bytes once each
        crowded = written(part("left_semi").dropDuplicates(strip).mapInArrow(_with_anchor, "gram long, body long, weight long, anchor int, data binary"))
        solved = written(_refined(part("left_anti"), ["gram"], strip)).unionByName(_dealt_again(crowded, kinds, WIDTHS))
    first = F.shiftright("place", 16).cast("int")
    ranges = F.transform("runs", lambda r: F.struct((first + r["a"]).alias("a"), (first + r["b"] + LENGTH - 1).alias("b")))
    place = spread_join(some, solved, strip, hot_keys(different, strip, "weight"), ["row1", "place"])
    return place.select(*row, ranges.alias("ranges")).groupBy(*row).agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _with_ranges(docs: DataFrame, kinds: int) -> DataFrame:
    keyed = _keyed(docs)
    packed = keyed.mapInArrow(_pack, "doc_id long, row1 long, row2 long, packed binary")
    return packed.join(repeats(keyed, packed, kinds), ["row1", "row2"], "left").select("doc_id", "packed", "ranges")


def _each(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    unpack = zstandard.ZstdDecompressor().decompress
    for text, ranges in zip(utf8(batch, "packed"), column(batch, "ranges").to_pylist()):
        yield unpack(text), merged([(r["a"], r["b"]) for r in ranges or ()])


def dedup(docs: DataFrame, kinds: int = KINDS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, kept, removed)``: the remaining bytes, and the byte ranges that went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "packed", 1 << 20):
                both = list(_each(part))
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([cut(*x) for x in both], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in r] for _, r in both], _RUNS)], ["doc_id", "kept", "removed"])

    return _with_ranges(docs, kinds).mapInArrow(run, "doc_id long, kept binary, removed array<struct<a:int,b:int>>")


def report(docs: DataFrame, kinds: int = KINDS) -> DataFrame:
    """The contract's row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "packed", 1 << 20):
                rows = [(len(t), sum(b - a for a, b in r), len(r), hashlib.sha256(cut(t, r)).hexdigest()) for t, r in _each(part)]
                cols = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_ranges(docs, kinds).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def brute_force(docs: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """The same rows from the definition, for tests."""
    seen: dict[bytes, int] = {}
    raw = [(i, (t or "").encode()) for i, t in docs]
    for _, t in raw:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for i, t in raw:
        ranges = merged([(p, p + length) for p in range(len(t) - length + 1) if seen[t[p : p + length]] > 1])
        out.append((i, len(t), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(cut(t, ranges)).hexdigest()))
    return out
