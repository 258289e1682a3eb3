"""Phrase collocation mining with counting quotient filters.

Texts are cut into pieces at punctuation and line ends, pieces into words.  A
phrase can only reach the minimum count if all its words do, and all phrases
inside it do, so counting goes up by length and nothing that cannot qualify is
shuffled:

1. Slices of bounded size become rows (the distinct words of each language,
   the text as small local numbers), written once.  Word counts are summed over
   the slices' distinct words, so a frequent word is one row per slice.
2. Words at the minimum count get dense ids (a word of two languages gets two,
   so an id tells its language); a join on the slices' distinct words turns the
   streams into id streams, written once.  Rarer words end a run, as the end of
   a piece does.
3. For two, three and four words: every task packs its n-grams, permutes and
   counts them in counting quotient filters of bounded size (``quotient_filter``),
   one per part; the filters of a part are merged over all shards and the
   n-grams at the minimum count are decoded.  Longer n-grams are counted only
   where both n-grams one word shorter are in a bitmap of fixed size; what it
   lets through by chance is counted exactly and falls at the minimum count.
4. Scores, containment and ranks are DataFrame joins over the qualifying
   phrases, in decimals of 38 digits.

A task holds one slice, one buffer of ``BUFFER`` entries and the bitmap; a
merge holds one part, whose number follows the number of words.  The number of
parts and ids collected to the driver is bounded by the partitions.

Edge cases: null texts are empty; null languages are ``und`` (together with
rows labelled so); repeated rows count again; texts without words count
nothing; an empty table gives an empty result; ids and other columns are
ignored, whatever their names; a text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored
from . import arrays as A
from . import bitmaps
from . import quotient_filter as Q

PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SPACES = b" \t"
SLICE = 1 << 20
BUFFER = 1 << 19        # entries of a task's filters before they are written
PART_WORDS = 1 << 20    # words of text per part of the merged filters
MIN_PARTS = 6           # bits
UNKNOWN = "und"


def sliced(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(slice, words, stream): bounded slices of text as local word numbers from 1.

    ``words[i]`` is what number ``i + 1`` means; 0 ends a piece.
    """
    rows = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                     F.col(text_col).cast("string").alias("text"))
    word = pa.struct([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, gaps = A.byte_mask(PIECE_ENDS), A.byte_mask(PIECE_ENDS + SPACES)
        for rows, buf, off in A.slices(batches, "text", SLICE):
            buf = A.LOWER_AZ[buf]
            s, e = A.word_spans(buf, gaps)
            if not len(s):
                continue
            data = buf[A.ragged(s, e - s)]
            edge = np.concatenate([[0], np.cumsum(e - s)])
            text = pa.Array.from_buffers(pa.large_string(), len(s), [None, pa.py_buffer(edge), pa.py_buffer(data)])
            coded = text.dictionary_encode()
            langs = rows.column(0).dictionary_encode()
            lang = langs.indices.to_numpy()[np.searchsorted(off, s, "right") - 1]
            code = coded.indices.to_numpy().astype(np.int64) * len(langs.dictionary) + lang
            code, local, n = np.unique(code, return_inverse=True, return_counts=True)
            ended = np.cumsum(ends[buf])
            new = np.flatnonzero(ended[s[1:]] != ended[e[:-1] - 1]) + 1
            stream = np.insert(local + 1, new, 0).astype("<u2" if len(code) < 1 << 16 else "<u4")
            words = pa.StructArray.from_arrays(
                [langs.dictionary.take(pa.array(code % len(langs.dictionary))).cast(pa.string()),
                 coded.dictionary.take(pa.array(code // len(langs.dictionary))).cast(pa.string()),
                 pa.array(n, pa.int64())], fields=list(word))
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                 pa.array([stream.itemsize], pa.int32()), pa.array([stream.tobytes()], pa.binary())],
                names=["words", "width", "stream"])

    out = rows.mapInArrow(run, "words array<struct<lang:string,word:string,n:long>>, width int, stream binary")
    return out.withColumn("slice", F.monotonically_increasing_id())


def with_dense_ids(df: DataFrame) -> tuple[DataFrame, int]:
    """The stored rows with a column ``id`` from 1 without gaps, and their number.

    One count per partition passes through the driver.
    """
    rows = stored(df.withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    sizes = rows.groupBy(part.alias("part")).count().orderBy("part").collect()
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total + 1))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(starts, "part long, start long")
    ids = (rows.withColumn("part", part).join(F.broadcast(starts), "part")
           .withColumn("id", F.col("start") + F.col("row").bitwiseAND((1 << 33) - 1)).drop("row", "part", "start"))
    return ids, total


def id_streams(slices: DataFrame, ids: DataFrame) -> DataFrame:
    """(ids): the slices as dictionary ids, 0 where a run of frequent words ends."""
    words = slices.select("slice", F.posexplode("words").alias("at", "w")).select("slice", "at", "w.lang", "w.word")
    known = words.join(ids.select("lang", "word", "id"), ["lang", "word"]).select(F.col("slice").alias("of"), "at", "id")

    def translate(key, stream, known):
        out = []
        at, to = known["at"].to_numpy(), known["id"].to_numpy()
        for width, raw in zip(stream["width"].to_pylist(), stream["stream"].to_pylist()):
            local = np.frombuffer(raw, f"<u{width}")
            table = np.zeros(int(local.max()) + 1, np.uint32)
            table[at + 1] = to
            x = table[local]
            x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
            if x.any():
                out.append(x.tobytes())
        return pa.table({"ids": pa.array(out, pa.binary())})

    return stored(slices.select("slice", "width", "stream").groupBy("slice")
                  .cogroup(known.groupBy("of")).applyInArrow(translate, "ids binary"))


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """A mixed 64-bit value of n-grams given as n columns."""
    out = np.full(len(words[0]), len(words), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            out = A.mix64(out * np.uint64(0xD1342543DE82EF95) + w.astype(np.uint64))
    return out


def frequent_grams(streams: DataFrame, shape: Q.Shape, min_count: int, shorter: np.ndarray | None) -> DataFrame:
    """(words, f, h) of the n-grams at the minimum count.

    ``shorter`` is the bitmap of the n-grams one word shorter that reached it.
    """
    n = shape.n

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def written() -> Iterator[pa.RecordBatch]:
            if held:
                filters = Q.shards(shape, *held[0])
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in filters], pa.int32()),
                                                  pa.array([f for _, f in filters], pa.binary())],
                                                 names=["part", "filter"])
                held.clear()

        for batch in batches:
            for raw in batch.column(0):
                ids = np.frombuffer(raw.as_buffer(), np.uint32)
                at = np.ones(max(0, len(ids) - n + 1), bool)
                for k in range(n):
                    at &= ids[k:len(ids) - n + 1 + k] != 0
                at = np.flatnonzero(at)
                if shorter is not None:
                    for k in range(2):
                        at = at[bitmaps.among(shorter, gram_hash([ids[at + k + j] for j in range(n - 1)]))]
                if not len(at):
                    continue
                left, right = shape.permute([ids[at + k] for k in range(n)])
                held.append(shape.sorted(left, right, np.ones(len(left), np.int64)))
                size += len(held[-1][0])
                if size > BUFFER:
                    held[:] = [shape.sorted(*(np.concatenate(c) for c in zip(*held)))]
                    size = len(held[0][0])
                    if size > BUFFER // 2:
                        yield from written()
                        size = 0
        if held:
            held[:] = [shape.sorted(*(np.concatenate(c) for c in zip(*held)))]
        yield from written()

    def merge(key, table):
        left, right, counts = Q.merged(shape, key[0].as_py(), table["filter"].to_pylist())
        keep = counts >= min_count
        words = shape.invert(left[keep], right[keep])
        flat = np.stack(words, axis=1).astype(np.int64).ravel() if keep.any() else np.empty(0, np.int64)
        return pa.table({
            "words": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, n), pa.int32()), pa.array(flat)),
            "f": pa.array(counts[keep], pa.int64()), "h": pa.array(gram_hash(words).view(np.int64), pa.int64())})

    return stored(streams.mapInArrow(count, "part int, filter binary").groupBy("part")
                  .applyInArrow(merge, "words array<long>, f long, h long"))


def ranked(grams: DataFrame, ids: DataFrame, totals: DataFrame, top: int, contained: tuple[int, int]) -> DataFrame:
    """The best candidates of every language.

    ``grams``: (words, f) of one to four words, all at the minimum count.
    """
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    candidates = grams.where(F.size("words") > 1).withColumnRenamed("f", "a")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)")))
    cuts = cuts.select("words", "a", "k", F.expr("slice(words, 1, k)").alias("first"),
                       F.expr("slice(words, k + 1, size(words) - k)").alias("rest"))
    scored = (cuts.join(grams.select(F.col("words").alias("first"), F.col("f").alias("l")), "first")
              .join(grams.select(F.col("words").alias("rest"), F.col("f").alias("r")), "rest")
              .withColumn("score", F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + r)"))
              .groupBy("words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    inside = F.expr("""flatten(transform(sequence(2, size(words) - 1), m ->
                       transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))""")
    longer = (candidates.where(F.size("words") > 2).select(F.explode(inside).alias("words"), "a")
              .groupBy("words").agg(F.max("a").alias("longer")))
    part, share = contained
    kept = scored.join(longer, "words", "left").where(
        F.col("longer").isNull() | (whole("longer") * share < whole("a") * part))
    spelt = (kept.select("words", F.posexplode("words").alias("at", "id")).join(ids.select("id", "lang", "word"), "id")
             .groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"),
                                   F.min("lang").alias("lang"))
             .select("words", "lang", F.concat_ws(" ", F.col("spelt.word")).alias("phrase")))
    out = kept.join(spelt, "words").select("lang", "phrase", "a", "cut.*").join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 30, longest: int = 4,
         top: int = 2000, contained: tuple[int, int] = (80, 100)) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    slices = stored(sliced(df, text_col, lang_col))
    words = slices.select(F.explode("words").alias("w")).groupBy("w.lang", "w.word").agg(F.sum("w.n").alias("f"))
    totals = slices.select(F.explode(F.expr(
        "transform(array_distinct(words.lang), x -> struct(x as lang, aggregate(filter(words, w -> w.lang = x), "
        "0L, (s, w) -> s + w.n) as n))")).alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n"))
    totals = stored(totals)
    ids, size = with_dense_ids(words.where(F.col("f") >= min_count))
    streams = id_streams(slices, ids)
    n_words = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(1, size.bit_length())
    if bits * ((longest + 1) // 2) > 64:
        raise ValueError(f"{size} frequent words do not fit into n-grams of {longest}")
    grams = ids.select(F.array("id").alias("words"), "f")
    shorter = None
    for n in range(2, longest + 1):
        shape = Q.Shape(n, bits, min(bits, max(MIN_PARTS, (n_words // PART_WORDS).bit_length())))
        found = frequent_grams(streams, shape, min_count, shorter)
        grams = grams.unionByName(found.drop("h"))
        if n < longest:
            shorter = bitmaps.bitmap_of(found, "h")
    return ranked(grams, ids, totals, top, contained)
