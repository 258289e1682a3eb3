"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

A text is its words and one end token.  log p(w | h) = log p(class | h) +
log p(w | class).  Classes: the most frequent words one by one, all others by
frequency band and letter shape.  p(class | h) is a softmax over the sum of
weight rows picked by hashed features of the history: the previous word, the
word before it (skip), the pair of their classes, and the class three back.
p(w | class) is the word's smoothed share of its class, so the classes'
word parts need no normalisation at run time.

Word counts come from every training text: counted in tasks, summed by word.
Texts are dealt into batches of about ``batch_bytes``; a batch asks once for
each of its distinct words, the counts are joined to the requests by word, and
answers and texts meet by batch, so no task and no driver holds the
vocabulary.  Encoded texts (class and feature bucket per token) are
checkpointed; ``rounds`` of distributed training follow: each task takes
stochastic gradient steps over its training texts from the common weights, and
the weights, a table of fixed size, are averaged by token count.  Scoring runs
in batches of sparse row look-ups.

Edge cases: a null or empty text is its end token alone; repeated rows count
as often as they stand; a null id is a training row; other columns are
ignored; an empty table gives an empty result; long texts are read whole.
Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import arrays as A

END = A.hash_of(b"\n")  # no word holds a line feed
TOP = 48
BANDS = 8
SHAPES = 4
BUCKETS = 2048
PARTS = 32


def words_of(batches, want=None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, token hashes, shapes, first token of every text); the last token
    of a text is the end token."""
    blanks = A.byte_mask(A.BLANKS)
    for rows, buf, off in A.slices(batches, "text"):
        buf = A.LOWER_AZ[buf]
        s, e = A.word_spans(buf, blanks)
        first = A.per_text(s, off)
        hashes = A.span_hashes(buf, s, e)
        # shape: by the first lead byte of a multi-byte character, 0 for none
        wide = np.flatnonzero(buf >= 0xC0)
        at = np.searchsorted(wide, s)
        has = at < len(wide)
        has[has] = wide[at[has]] < e[has]
        shape = np.zeros(len(s), np.int8)
        if has.any():
            lead = wide[at[has]]
            shape[has] = 1 + (buf[lead].astype(np.int64) * 64 + buf[lead + 1]) % (SHAPES - 1)
        hashes = np.insert(hashes, first[1:], np.uint64(END))
        shape = np.insert(shape, first[1:], 0)
        yield rows, hashes, shape, first + np.arange(len(first))


class Classes:
    """Classes of words from a table of fixed size about their counts."""

    def __init__(self, top: list[tuple[int, int]], groups: list[tuple[int, int, int, int]]):
        """``top``: (word, count); ``groups``: (log2 of count, shape, tokens,
        types) of all other words."""
        self.top_words = np.array([w for w, _ in top], np.int64)
        order = np.argsort(self.top_words)
        self.top_words, self.top_class = self.top_words[order], order
        mass = np.zeros(64)
        for b, _, tokens, _ in groups:
            mass[b] += tokens
        # bands of about equal mass, cut between powers of two
        filled = np.cumsum(mass) - mass
        self.band = np.minimum(BANDS - 1, (filled / max(1.0, mass.sum()) * BANDS).astype(np.int64))
        self.size = TOP + BANDS * SHAPES
        self.tokens, self.types = np.zeros(self.size), np.zeros(self.size)
        for i, (_, c) in enumerate(top):
            self.tokens[i], self.types[i] = c, 1
        for b, shape, tokens, types in groups:
            k = TOP + self.band[b] * SHAPES + shape
            self.tokens[k] += tokens
            self.types[k] += types

    def of(self, words: np.ndarray, counts: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        level = np.frexp(np.maximum(counts, 1).astype(float))[1] - 1
        out = TOP + self.band[level] * SHAPES + shapes
        if len(self.top_words):
            at = np.minimum(np.searchsorted(self.top_words, words), len(self.top_words) - 1)
            hit = self.top_words[at] == words
            out[hit] = self.top_class[at[hit]]
        return out

    def log10_word(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens[classes] + 0.1 * (self.types[classes] + 1)))

    def log_prior(self) -> np.ndarray:
        share = self.tokens + 0.5
        return np.log(share / share.sum())


class Weights:
    """Rows of class weights: previous word, skip word, class pair, class three back."""

    def __init__(self, size: int):
        self.size = size
        self.at = np.cumsum([0, BUCKETS, BUCKETS, (size + 1) * (size + 1)])
        self.rows = int(self.at[3] + size + 1)

    def features(self, classes: np.ndarray, buckets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Row numbers [token, 4]; places before a text count as class ``size``."""
        n = len(classes)
        pos = np.arange(n) - np.repeat(first[:-1], np.diff(first))

        def back(x, k, start):
            out = np.full(n, start, np.int64)
            out[k:] = x[:n - k] if k else x
            out[pos < k] = start
            return out

        c1, c2, c3 = (back(classes, k, self.size) for k in (1, 2, 3))
        b1, b2 = (back(buckets, k, 0) for k in (1, 2))
        return np.stack([b1, self.at[1] + b2, self.at[2] + c1 * (self.size + 1) + c2, self.at[3] + c3], axis=1)


class Softmax:
    """Class probabilities of a block of tokens, in buffers that are reused."""

    def __init__(self, table: np.ndarray, bias: np.ndarray, block: int = 2048):
        self.table, self.bias, self.block = table, bias, block
        self.z, self.part = (np.empty((block, table.shape[1]), np.float32) for _ in range(2))
        self.ones = np.ones(table.shape[1], np.float32)

    def weights(self, rows: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """exp(logits), their sums, and the logits of ``classes``."""
        z, part = self.z[:len(rows)], self.part[:len(rows)]
        np.take(self.table, rows[:, 0], axis=0, out=z, mode="clip")
        for k in range(1, rows.shape[1]):
            np.take(self.table, rows[:, k], axis=0, out=part, mode="clip")
            z += part
        z += self.bias
        np.minimum(z, 80.0, out=z)  # far beyond any trained logit: exp stays finite
        own = z[np.arange(len(z)), classes]
        np.exp(z, out=z)
        return z, z @ self.ones, own

    def log_share(self, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log p(class | history) of every token."""
        out = np.empty(len(classes))
        for a in range(0, len(classes), self.block):
            _, total, own = self.weights(rows[a:a + self.block], classes[a:a + self.block])
            out[a:a + self.block] = own - np.log(total)
        return out

    def train(self, scale: np.ndarray, rows: np.ndarray, classes: np.ndarray, rate: float) -> None:
        """Gradient steps in place; every weight's step shrinks with its own
        gradients, whose squares ``scale`` sums."""
        short = rows.astype(np.uint16) if len(self.table) <= 1 << 16 else rows  # sorted by digits
        for a in range(0, len(classes), self.block):
            r, c = short[a:a + self.block], classes[a:a + self.block]
            g, total, _ = self.weights(rows[a:a + self.block], c)
            g /= total[:, None]
            g[np.arange(len(c)), c] -= 1.0
            for k in range(r.shape[1]):
                order = np.argsort(r[:, k], kind="stable")
                keys = r[order, k]
                edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                np.take(g, order, axis=0, out=self.part[:len(c)], mode="clip")
                sums = np.add.reduceat(self.part[:len(c)], edge, axis=0)
                which = keys[edge]
                seen = np.take(scale, which, axis=0)
                seen += sums * sums
                scale[which] = seen
                seen += 1.0
                np.sqrt(seen, out=seen)
                sums /= seen
                sums *= rate
                self.table[which] -= sums


def _decode(batch: pa.RecordBatch):
    """Classes, buckets and first tokens of encoded rows."""
    classes = [np.frombuffer(x, np.uint8) for x in batch["classes"].to_pylist()]
    buckets = [np.frombuffer(x, np.uint16) for x in batch["buckets"].to_pylist()]
    first = np.concatenate([[0], np.cumsum([len(x) for x in classes])]).astype(np.int64)
    return np.concatenate(classes).astype(np.int64), np.concatenate(buckets).astype(np.int64), first


def train(encoded: DataFrame, classes: Classes, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(weight table, bias), averaged over the tasks after every round."""
    shape = Weights(classes.size)
    bias = classes.log_prior().astype(np.float32)
    table = np.zeros((shape.rows, classes.size), np.float32)
    edges = np.linspace(0, shape.rows, PARTS + 1).astype(int)
    schema = "part int, salt int, tokens double, weights binary"

    def average(key, group):
        tokens = group["tokens"].to_numpy()
        total = None
        for n, raw in zip(tokens, group["weights"].to_pylist()):
            one = np.frombuffer(raw, np.float32) * np.float32(n / tokens.sum())
            total = one if total is None else total + one
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "salt": pa.array([0], pa.int32()),
                         "tokens": pa.array([tokens.sum()]), "weights": pa.array([total.tobytes()], pa.binary())})

    for _ in range(rounds):
        start = table

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, scale, tokens = start.copy(), np.zeros_like(start), 0
            softmax = Softmax(own, bias)
            for batch in A.small(batches):
                c, b, first = _decode(batch)
                softmax.train(scale, shape.features(c, b, first), c, rate)
                tokens += len(c)
            if tokens:
                salt = int(own.view(np.uint32).sum(dtype=np.uint64) % 64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(PARTS), pa.int32()), pa.array([salt] * PARTS, pa.int32()),
                     pa.array([float(tokens)] * PARTS),
                     pa.array([own[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                    names=["part", "salt", "tokens", "weights"])

        # salted first, so that a part's average stays small in any task
        parts = (encoded.where("not held_out").select("classes", "buckets").mapInArrow(fit, schema)
                 .groupBy("part", "salt").applyInArrow(average, schema).groupBy("part").applyInArrow(average, schema))
        got = parts.collect()
        table = np.zeros_like(start)
        for r in got:
            table[edges[r.part]:edges[r.part + 1]] = np.frombuffer(r.weights, np.float32).reshape(-1, classes.size)
    return table, bias


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text",
          batch_bytes: int = 16 << 20, rounds: int = 2, rate: float = 0.15) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                      F.coalesce(held_out, F.lit(False)).alias("held_out"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        room = 0

        def emit():
            w, s, n = (np.concatenate(x) for x in zip(*kept))
            order = np.argsort(w, kind="stable")
            w, s, n = w[order], s[order], n[order]
            edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
            kept[:] = [(w[edge], s[edge], np.add.reduceat(n, edge))]
            return len(edge)

        def batch():
            w, s, n = kept[0]
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(s), pa.array(n)],
                                              names=["w", "shape", "n"])

        for _, w, s, _ in words_of(batches):
            u, at, n = np.unique(w, return_index=True, return_counts=True)
            kept.append((u, s[at], n))
            room += len(u)
            if room > 1_500_000:
                room = emit()
                if room > 750_000:
                    yield batch()
                    kept.clear()
                    room = 0
        if kept:
            emit()
            yield batch()

    counts = checkpointed(texts.where("not held_out").select("text").mapInArrow(count, "w long, shape byte, n long")
                          .groupBy("w").agg(F.sum("n").alias("c"), F.first("shape").alias("shape")))
    top = counts.orderBy(F.desc("c"), "w").limit(TOP).select("w", "c").collect()
    level = F.floor(F.log2("c") + 1e-9).cast("int")
    groups = (counts.where(~F.col("w").isin([r.w for r in top])) if top else counts).groupBy(
        level.alias("level"), "shape").agg(F.sum("c").alias("c"), F.count("*").alias("types")).collect()
    classes = Classes([(r.w, r.c) for r in top], [(r.level, r["shape"], r.c, r.types) for r in groups])
    n_train = sum(r.c for r in top) + sum(r.c for r in groups)
    n_types = len(top) + sum(r.types for r in groups)

    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches_ = max(1, -(-total // batch_bytes))
    dealt = texts.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches_)).cast("int"))

    def ask(key, table):
        found = [np.unique(w) for _, w, _, _ in words_of(table.to_batches())]
        w = np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)
        return pa.table({"batch": pa.array(np.full(len(w), key[0].as_py()), pa.int32()), "w": pa.array(w.view(np.int64))})

    answers = (dealt.groupBy("batch").applyInArrow(ask, "batch int, w long").join(counts.select("w", "c"), "w")
               .select("batch", "w", "c"))

    def encode(key, table, known):
        words = known["w"].to_numpy().view(np.uint64)
        order = np.argsort(words)
        words, c = words[order], known["c"].to_numpy()[order]
        out: dict[str, list] = {f.name: [] for f in schema}
        for rows, w, shapes, first in words_of(table.to_batches()):
            n = np.zeros(len(w), np.int64)
            if len(words):
                at = np.minimum(np.searchsorted(words, w), len(words) - 1)
                n = np.where(words[at] == w, c[at], 0)
            k = classes.of(w.view(np.int64), n, shapes)
            base = np.log10((n + 0.1) / (n_train + 0.1 * (n_types + 1)))
            part = classes.log10_word(k, n)
            bucket = (w >> np.uint64(53)).astype(np.uint16)
            k = k.astype(np.uint8)
            out["doc_id"] += rows["doc_id"].to_pylist()
            out["held_out"] += rows["held_out"].to_pylist()
            for a, b in zip(first[:-1], first[1:]):
                out["n_tokens"].append(int(b - a))
                out["n_known"].append(int((n[a:b] > 0).sum()))
                out["base_score"].append(float(base[a:b].sum()))
                out["word_score"].append(float(part[a:b].sum()))
                out["classes"].append(k[a:b].tobytes())
                out["buckets"].append(bucket[a:b].tobytes())
        return pa.table(out, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("n_known", pa.int64()), ("base_score", pa.float64()), ("word_score", pa.float64()),
                        ("classes", pa.binary()), ("buckets", pa.binary())])
    # both group the same dealt rows, so their exchange is shared
    encoded = checkpointed(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        encode, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, word_score double, "
                "classes binary, buckets binary"))
    table, bias = train(encoded, classes, rounds, rate)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, softmax = Weights(classes.size), Softmax(table, bias)
        for batch in A.small(batches):
            c, b, first = _decode(batch)
            logs = softmax.log_share(shape.features(c, b, first), c)
            sums = np.add.reduceat(logs, first[:-1]) / np.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], batch["n_tokens"], batch["n_known"], batch["base_score"],
                 pa.array(sums + batch["word_score"].to_numpy())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return encoded.mapInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
                                     "score double").select("doc_id", "held_out", "n_tokens", "n_known",
                                                            F.lit(n_train).cast("long").alias("train_tokens"),
                                                            "base_score", "score")
