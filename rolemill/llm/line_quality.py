"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's features are its shape (kinds of characters, word lengths,
repetition) and its neighbours' shapes; a transition weight ties neighbouring lines. Forward and
backward sums give each line's marginal probability of being good, and a document's score is the
mean of its lines' marginals, weighted by their lengths.

Labels are of documents; each line of a labelled document is trained on that label. Training takes
at most ``TRAIN_DOCS`` labelled documents (different id, text and label; those with the smallest
hashes) with all their lines, and of these, in that order, those that fit into ``TRAIN_LINES`` lines: a
sample of whole documents, whose features (floats, no text) come to the driver.
Scoring reads every line of every document.

Defined results: null and blank texts have no line and score 0; where there is nothing to learn from
(no usable label, or only one kind) every text scores 0.5 and blank ones 0; labels other than 0 and
1 and null ids are not learned from; repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolemill.llm.arrow_text import chunks, words
from rolemill.llm.common import read, written
from rolemill.session import ship_package

#: Most documents that are learned from, and most lines of them (188 bytes each on the driver).
TRAIN_DOCS, TRAIN_LINES = 3000, 300_000
THRESHOLD = 0.7
#: Steps, step size and ridge of the training.
STEPS, RATE, RIDGE = 150, 0.1, 1e-3

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".",
    "comma": b",;:",
    "loud": b"!?",
    "bar": b"|",
    "mark": b"#$%&*+=@^~_<>/\\",
    "bracket": b"()[]{}\"'`-",
}
N_FEATURES = 22


def _line_shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row of N_FEATURES numbers, about -1 to 1, for each line."""
    size = np.maximum(ends - starts, 1).astype(np.float32)
    offsets = np.append(starts, ends[-1] if len(ends) else 0)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return (sums[ends] - sums[starts]) / size

    columns = []
    for letters in _KINDS.values():
        table = np.zeros(256, bool)
        table[list(letters)] = True
        columns.append(share(table))
    foreign = np.zeros(256, bool)
    foreign[0xC0:] = True
    columns.append(share(foreign))
    w_start, w_end, hashes, first = words(data, offsets)
    count = np.diff(first).astype(np.float32)
    line = np.repeat(np.arange(len(starts)), np.diff(first))
    length = (w_end - w_start).astype(np.float32)
    per_word = lambda x: np.bincount(line, x, minlength=len(starts)) / np.maximum(count, 1)
    columns.append(per_word(length) / 10)
    columns.append(np.sqrt(np.maximum(per_word(length**2) - per_word(length) ** 2, 0)) / 10)
    columns.append(per_word((length > 20).astype(float)))
    columns.append(per_word((length < 2).astype(float)))
    # the share of different words, and of words that end in something else than a letter
    order = np.lexsort((hashes, line))
    l, h = line[order], hashes[order]
    new = np.ones(len(l), bool)
    new[1:] = (l[1:] != l[:-1]) | (h[1:] != h[:-1])
    columns.append(np.bincount(l, new, minlength=len(starts)) / np.maximum(count, 1))
    last = data[w_end - 1] if len(w_end) else np.zeros(0, np.uint8)
    plain = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 0x80) | np.isin(last, [44, 46])
    columns.append(per_word((~plain).astype(float)))
    columns.append(np.log1p(count) / 5)
    columns.append(np.log1p(size) / 8)
    tail = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    head = data[starts] if len(starts) else np.zeros(0, np.uint8)
    columns.append(np.isin(tail, [46, 33, 63]).astype(float))
    columns.append(((head >= 65) & (head <= 90)).astype(float))
    columns.append((count < 4).astype(float))
    columns.append(columns[0] > columns[1])
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, first line of each text): lines with words, and what stands around them.

    Features are the line's shape, the mean shape of its neighbours in the text, whether it is the
    first or last line, and a constant.
    """
    # a line ends at a newline or at the text's end
    cut = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([offsets[:-1], cut + 1]))
    starts = starts[starts < len(data)]
    if not len(starts):
        return np.zeros((0, 2 * N_FEATURES + 3), np.float32), np.zeros(0, np.float32), np.zeros(len(offsets), int)
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    _, _, _, first = words(data, np.append(starts, len(data)))
    full = np.diff(first) > 0
    starts, ends = starts[full], ends[full]
    begin = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros((0, 2 * N_FEATURES + 3), np.float32), np.zeros(0, np.float32), begin
    # shapes are taken over stretches that may hold blank lines behind them; their words are none
    shape = _line_shapes(data, starts, ends)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    is_first = np.append(True, text[1:] != text[:-1])
    is_last = np.append(text[1:] != text[:-1], True)
    above = np.vstack([shape[:1], shape[:-1]])
    below = np.vstack([shape[1:], shape[-1:]])
    above[is_first], below[is_last] = shape[is_first], shape[is_last]
    extra = np.stack([is_first, is_last, np.ones(len(starts))], axis=1).astype(np.float32)
    return np.hstack([shape, (above + below) / 2, extra]), (ends - starts).astype(np.float32), begin


def marginals(emission: np.ndarray, begin: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) of each line, expected transitions 2 x 2), by forward and backward sums.

    ``emission`` is the good class's score of each line (bad has 0); ``begin`` are the chains'
    borders. Chains run side by side, the longest first; sums are kept as probabilities, so chains
    of any length stay in range.
    """
    sizes = np.diff(begin)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    start, size = begin[:-1][order], sizes[order]
    good = np.exp(-np.logaddexp(0, -emission))
    local = np.stack([1 - good, good], axis=1)
    move = np.exp(transition - transition.max())
    ahead = np.empty_like(local)
    back = np.ones_like(local)
    live = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), side="left")  # chains longer than t
    for t, n in enumerate(live):
        at = start[:n] + t
        a = local[at] if t == 0 else (ahead[at - 1] @ move) * local[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(len(live) - 2, -1, -1):
        at = start[: live[t + 1]] + t
        b = (back[at + 1] * local[at + 1]) @ move.T
        back[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * back
    p = both / both.sum(axis=1, keepdims=True)
    inner = np.ones(len(local), bool)
    inner[begin[1:][sizes > 0] - 1] = False
    at = np.flatnonzero(inner)
    pair = ahead[at][:, :, None] * move[None] * (local[at + 1] * back[at + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p[:, 1], pair.sum(axis=0)


def train(features: np.ndarray, begin: np.ndarray, labels: np.ndarray) -> dict:
    """Weights that raise the conditional likelihood of the labelled chains (each of one label)."""
    mean, spread = features.mean(axis=0), features.std(axis=0)
    spread[spread < 1e-6] = 1.0
    mean[-1] = 0.0
    x = (features - mean) / spread
    line_label = np.repeat(labels, np.diff(begin)).astype(float)
    sizes = np.diff(begin)
    seen = np.zeros((2, 2))
    for c in (0, 1):
        seen[c, c] = (sizes[labels == c] - 1).clip(0).sum()
    n = max(len(x), 1)
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, STEPS + 1):
        p, pairs = marginals(x @ w, begin, move)
        grad = np.concatenate([x.T @ (line_label - p) / n - RIDGE * w, ((seen - pairs) / n - RIDGE * move).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        change = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, move = w + change[:-4], move + change[-4:].reshape(2, 2)
    return {"mean": mean, "spread": spread, "weights": w, "transition": move}


def document_scores(data: np.ndarray, offsets: np.ndarray, model: dict | None) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; 0 for texts without lines."""
    features, lengths, begin = line_features(data, offsets)
    if model is None:
        return np.where(np.diff(begin) > 0, 0.5, 0.0)
    p, _ = marginals((features - model["mean"]) / model["spread"] @ model["weights"], begin, model["transition"])
    sums = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=float)])[begin])
    weight = sums(lengths)
    return np.clip(np.where(weight > 0, sums(p * lengths) / np.maximum(weight, 1), 0.0), 0, 1)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for first, _, data, offsets in chunks(batch.column("text")):
            features, _, begin = line_features(data, offsets)
            for i in range(len(begin) - 1):
                rows.append(features[begin[i] : begin[i + 1]].astype(np.float32).tobytes())
        lines = pa.array([len(r) // (4 * (2 * N_FEATURES + 3)) for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), batch.column("quality"), lines, pa.array(rows, pa.binary())], ["doc_id", "text_hash", "quality", "lines", "features"])


def learn_quality(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from (doc_id, text) and (doc_id, quality); None where there aren't both kinds."""
    ship_package(docs.sparkSession)
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select("doc_id", "quality").distinct()
    texts = docs.where("text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    keys = ["doc_id", "text_hash", "quality"]
    ids = texts.select("doc_id", "text_hash").distinct().join(usable, "doc_id")
    sample = ids.orderBy(F.xxhash64("doc_id", "text_hash", F.lit(3)), *keys).limit(TRAIN_DOCS)
    # of repeated rows one is read
    texts = texts.join(F.broadcast(sample), ["doc_id", "text_hash"]).groupBy(*keys).agg(F.min("text").alias("text"))
    given = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text_hash", F.col("quality").cast("int").alias("quality"), "text")
    read_ = written(given.mapInArrow(_sampled, "doc_id long, text_hash long, quality int, lines long, features binary"), "quality-sample").where("lines > 0")
    order = read_.select("lines", *keys, F.xxhash64("doc_id", "text_hash", F.lit(3)).alias("place")).collect()
    # whole documents, as long as they fit into TRAIN_LINES
    room, chosen = TRAIN_LINES, []
    for r in sorted(order, key=lambda r: (r.place, r.doc_id, r.text_hash, r.quality)):
        if r.lines <= room:
            room -= r.lines
            chosen.append((r.doc_id, r.text_hash, r.quality))
    taken = docs.sparkSession.createDataFrame(chosen, "doc_id long, text_hash long, quality int")
    rows = read_.join(F.broadcast(taken), keys).select("quality", "features").collect()
    if len({r.quality for r in rows}) < 2:
        return None
    features = [np.frombuffer(r.features, np.float32).reshape(-1, 2 * N_FEATURES + 3) for r in rows]
    begin = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    return train(np.vstack(features), begin, np.array([r.quality for r in rows]))


def _judge(batches: Iterator[pa.RecordBatch], model: dict | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = np.zeros(batch.num_rows)
        for first, end, data, offsets in chunks(batch.column("text")):
            scores[first:end] = document_scores(data, offsets, model)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])


def score_quality(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    ship_package(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    judged = docs.select("doc_id", "text").mapInArrow(partial(_judge, model=model), f"doc_id {kind}, score double")
    return judged.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def quality_query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    learned = docs.where(~F.coalesce(held_out(), F.lit(True)))
    model = learn_quality(learned, read(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
