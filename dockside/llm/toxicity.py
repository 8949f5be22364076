"""Toxicity by a classifier that does not mind who is spoken of.

A logistic model over words and word beginnings, hashed to buckets. In training
every labelled text that names a group of people is read a second time with the
names swapped inside their list, which also holds neutral words; the squared
change of the log-odds is a penalty. So the name of a group gets no weight of its
own, however often it stands in toxic sentences.

A feature's value is its count divided by the root of the number of words, and
that root is a feature, too: what counts is by how much a rate exceeds the usual
one, measured in its own spread, so long and short texts are judged alike.
"""

import hashlib
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import WORD_BYTES, record_batch, store, text_bytes, worker_memo

BUCKETS = 1 << 20

# Beginnings of words, in bytes, that are features beside the words themselves.
BEGINNINGS = (4, 5, 6, 7, 8)

# Words that a worker remembers at most.
REMEMBERED = 200_000

# Lists of words that may stand for each other; the first ones are neutral.
IDENTITY_LISTS = (
    "people persons women men muslims christians jews hindus buddhists atheists immigrants"
    " refugees gays lesbians blacks whites asians africans americans mexicans europeans arabs",
    "person woman man muslim christian jew hindu immigrant refugee lesbian african mexican",
    "young old female male muslim christian jewish hindu gay lesbian bisexual transgender"
    " queer straight black white asian african american mexican european arab latino disabled"
    " deaf blind catholic protestant",
    "leute menschen frauen männer muslime christen juden ausländer flüchtlinge migranten",
    "gens personnes femmes hommes musulmans chrétiens juifs étrangers réfugiés migrants",
    "gente personas mujeres hombres musulmanes cristianos judíos extranjeros refugiados inmigrantes",
)


def swaps() -> dict[bytes, list[bytes]]:
    """For each identity word the words it may be swapped with."""
    found: dict[bytes, list[bytes]] = {}
    for text in IDENTITY_LISTS:
        words = text.encode().split()
        for word in words:
            found.setdefault(word, []).extend(w for w in words if w != word)
    return found


def features_of(word: bytes) -> list[int]:
    """Buckets of a word: itself and its beginnings."""
    out = [zlib.crc32(b"=" + word) % BUCKETS]
    out += [zlib.crc32(b"^" + word[:n]) % BUCKETS for n in BEGINNINGS if len(word) >= n]
    return out


def is_held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of all ids that training never sees; a NULL id belongs to it."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    """Weights of some buckets, of the root of the number of words, and the bias.

    ``empty`` are the log-odds of a text without words.
    """

    weights: dict[int, float]
    length: float
    bias: float
    empty: float

    def scores(self, texts: pa.Array, memo: dict | None = None) -> np.ndarray:
        """Probability of label 1 for each text (binary)."""
        memo = {} if memo is None else memo
        plain = pa.array([t.translate(WORD_BYTES) for t in texts.to_pylist()], pa.binary())
        lists = pc.ascii_split_whitespace(plain.view(pa.string()))
        # Blanks at the ends give empty words.
        numbered = lists.flatten().dictionary_encode()
        words = [w.encode() for w in numbered.dictionary.to_pylist()]
        get = self.weights.get
        known = list(map(memo.get, words))
        for i, n in enumerate(known):
            if n is None:
                value = sum(get(f, 0.0) for f in features_of(words[i])) if words[i] else 0.0
                known[i] = value
                if len(memo) < REMEMBERED:
                    memo[words[i]] = value
        place = numbered.indices.to_numpy()
        values = np.array(known, np.float64)[place]
        counted = np.array([bool(w) for w in words], np.int64)[place]
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        total = np.diff(np.concatenate([[0.0], np.cumsum(values)])[offsets])
        root = np.sqrt(np.diff(np.concatenate([[0], np.cumsum(counted)])[offsets]))
        odds = self.bias + total / np.maximum(root, 1.0) + self.length * root
        odds = np.where(root > 0, odds, self.empty)
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))


# ---- training --------------------------------------------------------------

EXAMPLE_TYPE = (
    "toxic int, n_words long, buckets array<int>, counts array<int>,"
    " swapped array<int>, changes array<int>"
)
EXAMPLE = pa.schema(
    [
        ("toxic", pa.int32()),
        ("n_words", pa.int64()),
        ("buckets", pa.list_(pa.int32())),
        ("counts", pa.list_(pa.int32())),
        ("swapped", pa.list_(pa.int32())),
        ("changes", pa.list_(pa.int32())),
    ]
)


def _examples(rows: DataFrame) -> DataFrame:
    """Features of labelled texts, and what swapping their identity words changes."""

    def make(batches):
        partners = swaps()
        for batch in batches:
            out = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.translate(WORD_BYTES).split()
                found = np.array([f for w in words for f in features_of(w)], np.int32)
                buckets, counts = np.unique(found, return_counts=True)
                change: dict[int, int] = {}
                for i, word in enumerate(words):
                    if word in partners:
                        # Each place gets another partner; the same ones in every run.
                        choice = zlib.crc32(b"%d %s" % (i, word)) % len(partners[word])
                        for f in features_of(word):
                            change[f] = change.get(f, 0) - 1
                        for f in features_of(partners[word][choice]):
                            change[f] = change.get(f, 0) + 1
                change = {f: n for f, n in change.items() if n}
                out.append((toxic, len(words), buckets, counts, list(change), list(change.values())))
                if len(out) == 256:
                    yield record_batch(EXAMPLE, *zip(*out))
                    out = []
            yield record_batch(EXAMPLE, *(zip(*out) if out else [()] * 6))

    return rows.select("toxic", "text").mapInArrow(make, EXAMPLE_TYPE)


def _totals(examples: DataFrame) -> DataFrame:
    """Texts of each label that have a bucket; a task returns a bucket once."""
    schema = pa.schema([("bucket", pa.int32()), ("clean", pa.int64()), ("toxic", pa.int64())])

    def add(batches):
        seen = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            labels = np.repeat(
                batch.column("toxic").to_numpy(), pc.list_value_length(batch.column("buckets")).to_numpy()
            )
            buckets = batch.column("buckets").flatten().to_numpy()
            for label in (0, 1):
                seen[label] += np.bincount(buckets[labels == label], minlength=BUCKETS)
        used = np.flatnonzero(seen.any(axis=0))
        yield record_batch(schema, used.astype(np.int32), seen[0, used], seen[1, used])

    partial = examples.select("toxic", "buckets").mapInArrow(add, "bucket int, clean long, toxic long")
    return partial.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``toxic, text`` of at most ``most`` labelled documents outside the held-out fifth.

    Of more, those with the smallest hash of their id. Where an id has several
    labels or texts, the greatest label and the smallest text count.
    """
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~is_held_out())
    ids = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    # At most ``most`` ids.
    found = texts.join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    most_rows: int = 8192,
    most_features: int = 4096,
    swap_penalty: float = 10.0,
    shrink: float = 0.02,
    steps: int = 400,
) -> Model:
    """Fit the model on a bounded sample of the labelled rows (``doc_id``, ``toxic``).

    Both labels weigh alike in training, so scores are no shares: one half lies midway
    between the kinds. Without labelled texts of both kinds the model knows no features and gives
    every text the smoothed share of label 1, a quarter if there are none.
    """
    examples = store(_examples(training_rows(docs, labels, most_rows)), "examples")
    sizes = {r.toxic: r.n for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    prior = float(np.log((toxic + 0.5) / (clean + 1.5)))
    if not clean or not toxic:
        return Model({}, 0.0, prior, prior)
    totals = _totals(examples).where("clean + toxic >= 3").toPandas()  # at most a row per bucket
    seen = (totals.clean + totals.toxic).to_numpy(float)
    share = seen / (clean + toxic)
    apart = (totals.toxic / toxic - totals.clean / clean).to_numpy(float)
    z = apart / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / clean + 1 / toxic))
    best = np.lexsort((totals.bucket.to_numpy(), -np.abs(z)))[:most_features]
    names = {f for w in swaps() for f in features_of(w)}
    kept = np.array(sorted(names | set(totals.bucket.to_numpy()[best].tolist())), np.int32)

    def narrow(batches):
        for batch in batches:
            columns = [batch.column("toxic"), batch.column("n_words")]
            for ids, values in (("buckets", "counts"), ("swapped", "changes")):
                sizes = pc.list_value_length(batch.column(ids)).to_numpy()
                row = np.repeat(np.arange(batch.num_rows), sizes)
                bucket = batch.column(ids).flatten().to_numpy()
                spot = np.minimum(np.searchsorted(kept, bucket), len(kept) - 1)
                same = kept[spot] == bucket
                left = np.bincount(row[same], minlength=batch.num_rows)
                cuts = pa.array(np.concatenate([[0], np.cumsum(left)]).astype(np.int32))
                for held in (spot, batch.column(values).flatten().to_numpy()):
                    part = pa.array(held[same].astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(cuts, part))
            yield pa.RecordBatch.from_arrays(columns, names=EXAMPLE.names)

    # At most ``most_rows`` rows of the kept features.
    table = examples.mapInArrow(narrow, EXAMPLE_TYPE).toArrow().combine_chunks()
    weights, length, bias = _train(table, len(kept), swap_penalty, shrink, steps)
    return Model({int(b): float(w) for b, w in zip(kept, weights) if w}, float(length), float(bias), prior)


def _train(table: pa.Table, n: int, swap_penalty: float, shrink: float, steps: int):
    """Accelerated gradient descent on the regularised loss."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["n_words"], r["toxic"], r["buckets"], r["counts"]))
    y = np.array([r["toxic"] for r in rows], float)
    # Both kinds weigh alike, so that one half lies midway between them.
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1.0), 0.5 / max((1 - y).sum(), 1.0))
    root = np.sqrt(np.array([r["n_words"] for r in rows], float))

    def sparse(ids, values):
        sizes = [len(r[ids]) for r in rows]
        row = np.repeat(np.arange(len(rows)), sizes)
        column = np.array([x for r in rows for x in r[ids]], np.int64)
        value = np.array([x for r in rows for x in r[values]], float)
        return row, column, value / np.maximum(root[row], 1.0)

    row, column, value = sparse("buckets", "counts")
    swap_row, swap_column, swap_value = sparse("swapped", "changes")
    swapped = max(1, len(set(swap_row.tolist())))
    scale = max(1.0, root.mean())
    lengths = root / scale

    def slopes(w):
        odds = np.bincount(row, value * w[column], len(rows)) + w[n] * lengths + w[n + 1]
        error = (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - y) * weight
        out = np.empty(n + 2)
        out[:n] = np.bincount(column, value * error[row], n) + shrink * w[:n] / len(rows) * 10
        out[n], out[n + 1] = (error * lengths).sum(), error.sum()
        if len(swap_row):
            change = np.bincount(swap_row, swap_value * w[swap_column], len(rows))
            out[:n] += (2 * swap_penalty / swapped) * np.bincount(
                swap_column, swap_value * change[swap_row], n
            )
        return out

    # Per-weight steps (Adam): features differ in how often they occur.
    w = np.zeros(n + 2)
    mean, square = np.zeros(n + 2), np.zeros(n + 2)
    for step in range(1, steps + 1):
        g = slopes(w)
        mean = 0.9 * mean + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        rate = 0.1 * (1 - step / (steps + 1))
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w[:n], w[n] / scale, w[n + 1]


# ---- scoring ---------------------------------------------------------------


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``; no shuffle.

    A NULL or empty text gets the score of a text without words; repeated rows
    give repeated results; columns other than ``doc_id`` and ``text`` are ignored.
    """
    scored = docs.select(F.col("doc_id").cast("long"), score_column(model).alias("score"))
    return scored.select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def score_column(model: Model, text: str = "text") -> Column:
    """Column: the probability that a text is toxic."""
    return F.pandas_udf(_scorer(model), "double")(text_bytes(text))


def _scorer(model: Model):
    import pandas as pd

    parts = (sorted(model.weights.items()), model.length, model.bias, model.empty)
    name = "toxicity-" + hashlib.sha256(repr(parts).encode()).hexdigest()

    def score_batch(texts: pd.Series) -> pd.Series:
        memo = worker_memo(name)
        out = [
            model.scores(pa.array(texts.iloc[i : i + 2048], pa.binary()), memo)
            for i in range(0, len(texts), 2048)
        ]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score_batch
