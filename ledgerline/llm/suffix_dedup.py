"""Suffix-array de-duplication: every byte inside a long repeated string goes.

A string of ``min_length`` bytes is repeated if it starts at another place too,
in the same text or another one.  Suffixes are brought together by content:
the least hash among a string's ``gram``-byte grams is its anchor, which equal
strings share, so a text is cut into regions, runs of string starts with one
anchor.  Regions whose anchor hash stands alone hold no repeated string.  Equal
regions are one entry with a count; an entry counted twice is repeated whole.

Different regions under one anchor hash are indexed together: their suffixes
are sorted to the needed depth, and the Burrows-Wheeler neighbours give the
common prefixes breadth first by increasing value.  All suffixes start as one
interval per symbol; prepending a symbol maps the borders between intervals of
length l to those of length l + 1 (two suffixes with the same first symbol part
at l + 1 exactly where a border of length l lies between their remainders).
The expansion stops at ``min_length``: neighbours not parted by then share
that many bytes.

An anchor whose regions exceed ``group_bytes`` (a passage that a third of all
texts share, with another context in each) is split by where the string starts
relative to the anchor: each half has more bytes common to all of its strings,
which become part of its key.  Halving goes on while a key is too large; at
one start the key is the string itself, so it always ends.

Edge cases: a null text is empty; texts shorter than ``min_length`` stay whole;
repeated rows are texts of their own, so each repeats the other; other columns
are ignored; an empty table gives an empty result.  Regions are told apart by
64-bit hashes of their anchor and their bytes together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, stored
from . import arrays as A
from .bitmaps import among, bitmap_of

SLICE = 1 << 18  # bytes of text that a pass looks at
INDEX = 1 << 18  # bytes of regions that are sorted at a time, or else one key's
ANCHOR = "h long, fp long, start long, n long, at long"


def anchors_of(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Regions of all texts: (text, anchor hash, fingerprint, start, strings, anchor offset)."""
    A.claimed("suffix_dedup")
    n = len(buf)
    empty = np.empty(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty, empty
    at = np.arange(n - gram + 1)
    hashes = A.span_hashes(buf, at, at + gram, seed=5)
    # hash and place in one value: the least is the leftmost of the least hashes
    least = (hashes >> np.uint64(30) << np.uint64(30)) | at.astype(np.uint64)
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    starts_in = np.zeros(n + 2, np.int64)
    last = off[1:] - 1 - length
    long_enough = last >= off[:-1]
    np.add.at(starts_in, off[:-1][long_enough], 1)
    np.add.at(starts_in, last[long_enough] + 1, -1)
    s = np.flatnonzero(np.cumsum(starts_in)[:n])
    if not len(s):
        return empty, empty, empty, empty, empty, empty
    place = (least[s] & np.uint64((1 << 30) - 1)).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (place[1:] != place[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    lo, p = s[first], place[first]
    count = np.diff(np.append(first, len(s)))
    fp = A.span_hashes(buf, lo, lo + count - 1 + length, seed=6)
    text = np.searchsorted(off, lo, "right") - 1
    # least hashes crowd the lowest values: mixed anew, for buckets and bitmaps
    return text, A.mix64(hashes[p]).view(np.int64), fp.view(np.int64), lo - off[text], count, p - lo


def _ranks(key: np.ndarray, kind) -> np.ndarray:
    """The place of every value among the distinct ones."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.zeros(len(key), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    del ordered
    rank = np.empty(len(key), kind)
    rank[order] = np.cumsum(new, dtype=kind)
    return rank


def repeated_starts(regions: list[bytes], length: int) -> list[np.ndarray]:
    """Starts in every region whose ``length`` bytes start elsewhere among them."""
    sizes = np.fromiter(map(len, regions), np.int64, len(regions))
    edge = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(edge[-1])
    place = np.int32 if n < 1 << 31 else np.int64  # half the memory where places fit
    sym = np.zeros(n, np.int16)  # 0 closes a region
    inside = np.ones(n, bool)
    inside[edge[1:] - 1] = False
    sym[inside] = np.frombuffer(b"".join(regions), np.uint8).astype(np.int16) + 1
    del inside
    # ranks of the first 7 symbols, doubled until they cover the bound
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key[:max(0, n - k)] += sym[k:]
    rank, depth = _ranks(key, place), 7
    while depth <= length:
        np.multiply(rank, n + 1, out=key, dtype=np.int64)
        key[:max(0, n - depth)] += rank[depth:]
        key[:max(0, n - depth)] += 1
        rank = _ranks(key, place)
        depth *= 2
    del key
    suffix = np.argsort(rank, kind="stable").astype(place)
    del rank
    where = np.empty(n, place)
    where[suffix] = np.arange(n, dtype=place)
    # border[j]: the suffixes j - 1 and j are parted by now
    first = sym[suffix]
    border = np.ones(n, bool)
    border[1:] = (first[1:] != first[:-1]) | (first[1:] == 0)
    del first
    live = np.flatnonzero(~border).astype(place)  # neighbours not yet parted
    rest_a, rest_b = where[suffix[live - 1] + 1], where[suffix[live] + 1]
    lo, hi = np.minimum(rest_a, rest_b), np.maximum(rest_a, rest_b)
    level, fresh = 1, n
    # many borders a level, or neighbours with remote remainders: look at all
    while level < length and fresh and (fresh > n >> 6 or int((hi - lo).sum(dtype=np.int64)) > 2 * n):
        passed = np.cumsum(border, dtype=place)
        parted = passed[hi] > passed[lo]
        edge_at, fresh = live[parted], int(parted.sum())
        border[edge_at] = True
        live, lo, hi = live[~parted], lo[~parted], hi[~parted]
        level += 1
    # few borders a level: a queue of the last level's borders, each of which
    # parts the neighbours whose remainders it lies between
    if level < length and fresh and len(live):
        width = (hi - lo).astype(np.int64)
        places = A.ragged(lo + np.int64(1), width)
        owner = np.repeat(np.arange(len(live)), width)[np.argsort(places, kind="stable")]
        first_at = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=n))])
        whole = np.ones(len(live), bool)
        seen_at = np.empty(len(live), np.int64)
        while level < length and len(edge_at):
            reached = owner[A.ragged(first_at[edge_at], first_at[edge_at + 1] - first_at[edge_at])]
            reached = reached[whole[reached]]
            whole[reached] = False
            order = np.arange(len(reached))
            seen_at[reached] = order
            edge_at = live[reached[seen_at[reached] == order]]  # each once
            level += 1
        live = live[whole]
    hit = np.zeros(n, bool)
    hit[suffix[live]] = True
    hit[suffix[live - 1]] = True
    return [np.flatnonzero(hit[a:b - 1]) for a, b in zip(edge, edge[1:])]


def repeated_by_key(keys: np.ndarray, regions: pa.Array, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, repeated starts) of every region; equal strings have one key.

    Whole keys are indexed together up to ``INDEX`` bytes, so that the memory
    does not follow the regions of a task.
    """
    order = np.argsort(keys, kind="stable")
    sizes = np.cumsum(pc.binary_length(regions).to_numpy(zero_copy_only=False)[order])
    past = np.flatnonzero(np.diff(keys[order], append=0) != 0) + 1 if len(order) else order
    past = np.append(past[past < len(order)], len(order))  # where a key's rows end
    at = 0
    while at < len(order):
        before = sizes[at - 1] if at else 0
        fits = past[(past > at) & (sizes[past - 1] <= before + INDEX)]
        end = int(fits[-1]) if len(fits) else int(past[np.searchsorted(past, at, "right")])
        rows = order[at:end]
        yield from zip(rows.tolist(), repeated_starts(regions.take(pa.array(rows)).to_pylist(), length))
        at = end


def runs_of(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of sorted places."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.append(cut, len(places) - 1)].tolist()))


def _halves(o1: int, o2: int, at: int, n: int):
    """The two halves of the start offsets o1..o2 before the anchor:
    (o1, o2, first string, last string)."""
    mid = (o1 + o2) // 2
    for x1, x2 in ((o1, mid), (mid + 1, o2)):
        a, b = max(0, at - x2), min(n - 1, at - x1)
        if x1 <= x2 and a <= b:
            yield x1, x2, a, b


REGION = ("key long, h long, fp long, own long, c long, shift long, at long, n long, o1 long, o2 long, "
          "region binary")


def _index(mixed: DataFrame, cut, length: int, group_bytes: int, task_bytes: int) -> DataFrame:
    """(h, fp, a, b): runs of repeated string starts inside regions.

    ``mixed`` has the groups (h, bytes); ``cut(mixed)`` gives the regions.
    """
    import xxhash

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in A.small(batches):
            out = []
            for r in batch.to_pylist():
                for x1, x2, a, b in _halves(r["o1"], r["o2"], r["at"], r["n"]):
                    part = r["region"][a:b + length]
                    common = r["region"][r["at"] - x1:r["at"] + length - x2]
                    out.append(r | {
                        "key": signed(xxhash.xxh3_64_intdigest(common, seed=(r["key"] + x1 * 521 + x2) & (1 << 64) - 1)),
                        "own": signed(xxhash.xxh3_64_intdigest(part, seed=r["at"] - a)), "shift": r["shift"] + a,
                        "at": r["at"] - a, "n": b - a + 1, "o1": x1, "o2": x2, "region": part})
            yield pa.RecordBatch.from_pylist(out, schema=batch.schema)

    def match(_, table):
        A.claimed("suffix_dedup")
        keys, h, fp, c, shift = (table[x].to_numpy() for x in ("key", "h", "fp", "c", "shift"))
        out: list[list] = [[], [], [], []]
        for i, places in repeated_by_key(keys, table["region"].combine_chunks(), length):
            if c[i] == 1:  # the others are repeated whole
                for a, b in runs_of(places):
                    for column, value in zip(out, (h[i], fp[i], shift[i] + a, shift[i] + b)):
                        column.append(value)
        A.release()
        return pa.table({x: pa.array(v, pa.int64()) for x, v in zip(("h", "fp", "a", "b"), out)})

    def indexed(rows: DataFrame, total: int) -> DataFrame:
        tasks = max(1, -(-total // task_bytes))
        return (rows.withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
                .select("task", "key", "h", "fp", "c", "shift", "region").groupBy("task")
                .applyInArrow(match, "h long, fp long, a long, b long"))

    # in the first round every group is known to hold several regions, and
    # its size without its bytes
    stats = mixed.select("h", "bytes").distinct().agg(
        F.sum(F.when(F.col("bytes") <= group_bytes, F.col("bytes"))).alias("small"), F.max("bytes").alias("most")).first()
    regions = cut(mixed)
    hot = None
    if (stats.most or 0) > group_bytes:
        regions = stored(regions)
        hot = regions.where(f"bytes > {group_bytes}").drop("bytes")
    found = indexed(regions.where(f"bytes <= {group_bytes}"), stats.small or 0)
    while hot is not None:
        regions = stored(hot.mapInArrow(split, REGION))
        sizes = regions.groupBy("key").agg(F.sum("c").alias("all_c"), (F.min("own") != F.max("own")).alias("mixed"),
                                           F.sum(F.length("region")).alias("bytes"))
        judged = stored(regions.join(sizes, "key").where("all_c > 1"))
        whole = judged.where("not mixed and c = 1").select("h", "fp", F.col("shift").alias("a"),
                                                           (F.col("shift") + F.col("n") - 1).alias("b"))
        small = judged.where(f"mixed and bytes <= {group_bytes}")
        total = small.agg(F.sum(F.length("region"))).first()[0] or 0
        found = found.unionByName(whole).unionByName(indexed(small, total))
        hot = judged.where(f"mixed and bytes > {group_bytes}").select(*(x.split()[0] for x in REGION.split(", ")))
        hot = None if hot.isEmpty() else hot
    return found


def _repeated_hashes(texts: DataFrame, length: int, gram: int, bucket_bytes: int = 512 << 20) -> DataFrame:
    """(h): the anchor hashes that stand more than once.

    Hashes travel packed, eight bytes each, in buckets by their topmost bits;
    the number of buckets follows the input, so a bucket stays small.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, int(total * 64 // bucket_bytes).bit_length())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def rows():
            # copies are told by two of their kind: more need not travel
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            h = np.repeat(h, np.minimum(n, 2))
            edge = np.searchsorted(h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            edge = np.append(edge, len(h))
            full = np.flatnonzero(np.diff(edge))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(
                [h[edge[b]:edge[b + 1]].tobytes() for b in full], pa.binary())], names=["bucket", "hashes"])

        for _, buf, off in A.slices(batches, "text", SLICE):
            kept.append(anchors_of(buf, off, length, gram)[1].view(np.uint64))
            if sum(map(len, kept)) > 1_000_000:
                yield from rows()
                kept.clear()
        if kept:
            yield from rows()

    def twice(key, table):
        h, n = np.unique(np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64), return_counts=True)
        h = h[n > 1]
        del n
        A.release()
        return pa.table({"h": pa.array(h.view(np.int64))})

    return checkpointed(texts.select("text").mapInArrow(collect, "bucket int, hashes binary").groupBy("bucket")
                        .applyInArrow(twice, "h long"))


def _only(texts: DataFrame, keys: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose ``key`` may be in the bitmap, or surely is not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = among(keys, batch["key"].to_numpy())
            yield batch.filter(pa.array(there if inside else ~there))

    return texts.mapInArrow(run, texts.schema)


def repeated_spans(texts: DataFrame, length: int, gram: int, group_bytes: int, task_bytes: int) -> DataFrame:
    """(doc, th, spans): the byte runs [first, past) to remove, per text.

    ``texts`` has doc (an id), th (a hash of the text), key (a hash of both)
    and text.
    """

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, off in A.slices(batches, "text", SLICE):
            text, *columns = anchors_of(buf, off, length, gram)
            seen = among(maybe, columns[0])
            take, columns = pa.array(text[seen]), [c[seen] for c in columns]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(take), rows.column(1).take(take),
                                              *(pa.array(c, pa.int64()) for c in columns)],
                                             names=["doc", "th", *(x.split()[0] for x in ANCHOR.split(", "))])

    again = _repeated_hashes(texts, length, gram)
    maybe = bitmap_of(again, "h")
    shared = stored(texts.select("doc", "th", "text").mapInArrow(anchors, "doc long, th long, " + ANCHOR)
                          .join(again, "h", "left_semi"))
    entries = shared.groupBy("h", "fp").agg(F.count("*").alias("c"), F.min(F.struct("doc", "th", "start")).alias("one"),
                                            F.first("n").alias("n"), F.first("at").alias("at"))
    # a group of which every region is repeated whole needs no index
    several = entries.groupBy("h").agg(F.count("*").alias("kinds"), F.min("c").alias("least"),
                                       F.sum(F.col("n") - 1 + length).alias("bytes")).where(
        "kinds > 1 and least = 1").select("h", "bytes")
    mixed = stored(entries.join(several, "h").select("h", "fp", "c", "one.*", "n", "at", "bytes"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        A.claimed("suffix_dedup")
        for batch in A.small(batches):
            out = []
            for text, wanted in zip(batch["text"].to_pylist(), batch["wanted"].to_pylist()):
                raw = text.encode()
                for w in wanted:
                    out.append({"key": w["h"], "h": w["h"], "fp": w["fp"], "own": w["fp"], "c": w["c"], "shift": 0,
                                "at": w["at"], "n": w["n"], "o1": 0, "o2": length - gram, "bytes": w["bytes"],
                                "region": raw[w["start"]:w["start"] + w["n"] - 1 + length]})
            yield pa.RecordBatch.from_pylist(out, schema=region)
        A.release()

    region = pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64())
                        for x in (REGION + ", bytes long").split(", ")])

    def cut(mixed_: DataFrame) -> DataFrame:
        wanted = stored(mixed_.groupBy("doc", "th").agg(
            F.collect_list(F.struct("h", "fp", "c", "start", "n", "at", "bytes")).alias("wanted")))
        keys = bitmap_of(wanted.select(F.xxhash64("doc", "th").alias("key")), "key")
        # repeated rows cut a region twice, but never one that counts once
        return (_only(texts.select("doc", "th", "key", "text"), keys).drop("key")
                .join(wanted, ["doc", "th"]).select("text", "wanted").mapInArrow(take, REGION + ", bytes long"))

    partly = _index(mixed, cut, length, group_bytes, task_bytes)
    copied = entries.where("c > 1").select("h", "fp", F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("b"))
    ranges = shared.select("doc", "th", "h", "fp", "start").join(copied.unionByName(partly), ["h", "fp"])
    return ranges.groupBy("doc", "th").agg(F.collect_set(F.struct(
        (F.col("start") + F.col("a")).alias("first"), (F.col("start") + F.col("b") + length).alias("past"))).alias("spans"))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def keep_characters(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; a character cut by one stays whole."""
    out, at = [], 0
    for a, b in spans:
        while a < len(raw) and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        out.append(raw[at:max(a, at)])
        at = max(a, b, at)
    return b"".join([*out, raw[at:]]).decode()


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 200, gram: int = 32,
          group_bytes: int = 1 << 20, task_bytes: int = 1 << 20, with_text: bool = False,
          carry: list[str] | None = None) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, spans; the text
    that is left (a character cut by a span stays whole) if wanted; and
    ``row``, a struct of the columns to ``carry`` along."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"),
                      *([F.struct(*carry).alias("row")] if carry else []))
    keyed = keyed.withColumn("doc", F.coalesce("doc_id", F.lit(-1))).withColumn("key", F.xxhash64("doc", "th"))
    spans = checkpointed(repeated_spans(keyed.select("doc", "th", "key", "text"), min_length, min(gram, min_length),
                                        group_bytes, task_bytes))
    touched = bitmap_of(spans.select(F.xxhash64("doc", "th").alias("key")), "key")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        A.claimed("suffix_dedup")
        for batch in A.small(batches):
            out: dict[str, list] = {c: [] for c in types}
            for text_, found in zip(batch["text"].to_pylist(), batch["spans"].to_pylist()):
                raw = text_.encode()
                merged = merge_spans([(s["first"], s["past"]) for s in found or []])
                digest, at = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(sum(b - a for a, b in merged))
                out["n_spans"].append(len(merged))
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append([{"first": a, "past": b} for a, b in merged])
                if with_text:
                    out["text"].append(keep_characters(raw, merged))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(out[c], t) for c, t in types.items()), *([batch["row"]] if carry else [])],
                names=["doc_id", *types, *(["row"] if carry else [])])
        A.release()

    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(),
             "spans": pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))}
    schema = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
              "spans array<struct<first:long,past:long>>")
    if with_text:
        types["text"] = pa.string()
        schema += ", text string"
    if carry:
        schema += ", row " + keyed.schema["row"].dataType.simpleString()
    # texts without spans stay where they are; only the others are shuffled
    columns = ["doc_id", "text", "spans", *(["row"] if carry else [])]
    joined = _only(keyed, touched).join(spans, ["doc", "th"], "left").select(columns)
    rest = _only(keyed, touched, inside=False).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return joined.mapInArrow(finish, schema).unionByName(rest.select(columns).mapInArrow(finish, schema))
