"""Class-based n-gram scores: exchange clustering of words, class transitions, word emissions.

Words are counted over all training texts. Those that make up more than one token
in ``CORE_ONE_IN`` are the core, at most that many; the core's word pairs are counted
over all training texts, and the exchange algorithm moves core words between classes
in some rounds, each a job over these pairs: a word goes where the likelihood of the class bigrams
gains most, half of the words at a time. Every other word is then exchanged once, by the
classes of all its neighbours in the training texts (neighbours outside the core
are one class). So each word of the training texts gets a class from all its occurrences.

Texts are read twice: to count words, and to write them as numbers in blocks of some
megabytes, where words outside the core have numbers of the block's own. What a block must know
of those (count, class) comes to it as one row per different word, never as the whole vocabulary:
nothing that grows with the corpus is broadcast or collected.

The model: ``P(w | v) = P(class(w) | class(v)) * n(w) / n(class(w))``. The end of a
text is a word of its own class, and what a text begins after. Words that training
texts lack are one class. Words that occur once tell how often one comes, and after
what: each counts a second time as a word that was never seen. Transitions are mixed
with the shares of the classes as if these had been seen ``CLASSES`` more times.
"""

from array import array
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockside.llm.common import LOWER_BYTES, partitions_for, record_batch, store, text_bytes, tidy

# Classes of words, besides that of the end and that of unknown words.
CLASSES = 64
END = 0
OTHER = CLASSES + 1
ALL = CLASSES + 2

# A word with more than one of so many tokens belongs to the core; also the most core words.
CORE_ONE_IN = 16384
ROUNDS = 8

# Bytes of text in a block; a longer text is a block by itself.
BLOCK_BYTES = 8 << 20
# Different words that one task counts before it passes them on.
MOST_COUNTED = 300_000
# Rows (a word in a block) that one task sorts.
ROWS_PER_TASK = 2_000_000
# Mark of a word that occurs once, beside its class.
ONCE = 128


def words_in(text: bytes) -> list[bytes]:
    """Words between ASCII blanks, A-Z lowered."""
    return text.translate(LOWER_BYTES).split()


def sum_of_logs(x: np.ndarray) -> np.ndarray:
    """``x log x``, 0 at 0."""
    return x * np.log(np.maximum(x, 1e-300))


# ---- counts ----------------------------------------------------------------


def count_words(texts: DataFrame) -> DataFrame:
    """``word, n`` over all ``text`` (bytes); the empty word is the end of a text."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        seen = Counter()
        for batch in batches:
            column = batch.column(0)
            for at in range(batch.num_rows):
                seen.update(words_in(column[at].as_py()))
                if len(seen) > MOST_COUNTED:
                    yield record_batch(schema, list(seen), list(seen.values()))
                    seen = Counter()
            seen[b""] += batch.num_rows
        if seen:
            yield record_batch(schema, list(seen), list(seen.values()))

    counted = texts.select("text").mapInArrow(tidy(count), "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """Numbers of words; a new word gets the next one."""

    def __missing__(self, word):
        self[word] = number = len(self)
        return number


ENCODED = (
    "block long, doc_ids array<long>, train array<boolean>, sizes array<int>, codes binary, words array<binary>"
)


def encode(texts: DataFrame, core: list[bytes]) -> DataFrame:
    """Blocks of texts as numbers: of ``core`` words their place, of others from there on by block.

    Every text ends with the end's number, 0.
    """
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())),
            ("train", pa.list_(pa.bool_())),
            ("sizes", pa.list_(pa.int32())),
            ("codes", pa.binary()),
            ("words", pa.list_(pa.binary())),
        ]
    )
    places = {word: i for i, word in enumerate(core)}

    def write(batches):
        number = TaskContext.get().partitionId() << 32

        def fresh():
            return _Numbers(places), array("I"), [], [], []

        def row(numbers, codes, ids, train, sizes):
            words = list(islice(numbers, len(places), None))
            return record_batch(schema, [number], [ids], [train], [sizes], [codes.tobytes()], [words])

        numbers, codes, ids, train, sizes = fresh()
        size = 0
        for batch in batches:
            ids_of, train_of, column = batch.column(0), batch.column(1), batch.column(2)
            for at in range(batch.num_rows):
                text = column[at].as_py()
                if ids and size + len(text) > BLOCK_BYTES:
                    yield row(numbers, codes, ids, train, sizes)
                    number, size = number + 1, 0
                    numbers, codes, ids, train, sizes = fresh()
                words = words_in(text)
                codes.extend(map(numbers.__getitem__, words))
                codes.append(END)
                ids.append(ids_of[at].as_py())
                train.append(train_of[at].as_py())
                sizes.append(len(words) + 1)
                size += len(text)
        if ids:
            yield row(numbers, codes, ids, train, sizes)

    return texts.select("doc_id", "train", "text").mapInArrow(tidy(write), ENCODED)


def _blocks(batches):
    """``block, codes, mask of training tokens, row`` of encoded batches."""
    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1)
            codes = np.frombuffer(row.column("codes")[0].as_buffer(), np.int32)
            sizes = row.column("sizes").flatten().to_numpy()
            train = np.repeat(row.column("train").flatten().to_numpy(zero_copy_only=False), sizes)
            yield row.column("block")[0].as_py(), codes, train, row


def _summed(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(key, return_counts=True)


def count_pairs(encoded: DataFrame, n_core: int) -> DataFrame:
    """``a, b, n`` of neighbouring core words in training texts; ``n_core`` stands for all others."""
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def count(batches):
        for _, codes, train, _ in _blocks(batches):
            # The square of the core's size is below 2 ** 31.
            key = np.minimum(codes, n_core)
            key[1:] += key[:-1] * np.int32(n_core + 1)
            pair, n = _summed(key[train])
            yield record_batch(schema, pair // (n_core + 1), pair % (n_core + 1), n)

    counted = encoded.select("block", "codes", "train", "sizes").mapInArrow(tidy(count), "a int, b int, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("n"))


# ---- exchange --------------------------------------------------------------


def class_table(pairs: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes; a row per pair of classes comes to the driver."""
    schema = pa.schema([("c", pa.int32()), ("d", pa.int32()), ("n", pa.int64())])

    def add(batches):
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            np.add.at(total, classes[a] * ALL + classes[b], n)
        used = np.flatnonzero(total)
        yield record_batch(schema, used // ALL, used % ALL, total[used])

    return _collected(pairs.select("a", "b", "n").mapInArrow(add, "c int, d int, n long"))


def _collected(cells: DataFrame) -> np.ndarray:
    table = np.zeros((ALL, ALL), np.int64)
    for r in cells.groupBy("c", "d").agg(F.sum("n").alias("n")).collect():
        table[r.c, r.d] = r.n
    return table


def likelihood(table: np.ndarray) -> float:
    """Of the class bigrams, up to what does not depend on the classes."""
    t = table.astype(float)
    return float(sum_of_logs(t).sum() - sum_of_logs(t.sum(1)).sum() - sum_of_logs(t.sum(0)).sum())


def best_classes(table: np.ndarray, word: np.ndarray, code: np.ndarray, n: np.ndarray, totals: np.ndarray):
    """The class where each word gains most, its neighbours staying in theirs.

    ``word`` (sorted), ``code`` (class of the word before, or ``ALL`` + that of the next) and ``n`` list the
    neighbours; ``table`` is without these words, whose counts are ``totals``.
    """
    t = table.astype(float)
    choice = slice(1, CLASSES + 1)
    # Counts of a class before (columns) or after (rows) each choice.
    sides = np.concatenate([t[:, choice], t[choice, :].T])
    gain = np.zeros((len(totals), CLASSES))
    for at in range(0, len(word), 1 << 16):
        part = slice(at, at + (1 << 16))
        held = sides[code[part]]
        added = sum_of_logs(held + n[part, None]) - sum_of_logs(held)
        starts = np.flatnonzero(np.append(True, word[part][1:] != word[part][:-1]))
        gain[word[part][starts]] += np.add.reduceat(added, starts, axis=0)
    for size in (t.sum(1)[choice], t.sum(0)[choice]):
        gain -= sum_of_logs(size + totals[:, None]) - sum_of_logs(size)
    return 1 + np.argmax(gain, axis=1)


def exchange_round(pairs: DataFrame, classes: np.ndarray, table: np.ndarray, half: int) -> np.ndarray:
    """Classes after every core word of one half has gone where it gains most."""
    schema = pa.schema([("word", pa.int32()), ("code", pa.int32()), ("n", pa.int64())])
    moved = pa.schema([("word", pa.int32()), ("class", pa.int32())])
    n_core = len(classes) - 1

    def neighbours(batches):
        for batch in batches:
            a, b, n = (batch.column(i).to_numpy() for i in range(3))
            word, code = np.append(b, a), np.append(classes[a], ALL + classes[b])
            some = (word > END) & (word < n_core) & (word % 2 == half)
            yield record_batch(schema, word[some], code[some], np.append(n, n)[some])

    def decide(batches):
        rows = [[batch.column(i).to_numpy() for i in range(3)] for batch in batches]
        if not rows:
            return
        word, code, n = map(np.concatenate, zip(*rows))
        order = np.lexsort((code, word))
        word, code, n = word[order], code[order], n[order]
        names, starts = np.unique(word, return_index=True)
        out = []
        for name, lo, hi in zip(names.tolist(), starts.tolist(), [*starts[1:].tolist(), len(word)]):
            codes, counts = code[lo:hi], n[lo:hi]
            before, after = codes < ALL, codes >= ALL
            rest, own = table.copy(), classes[name]
            rest[codes[before], own] -= counts[before]
            rest[own, codes[after] - ALL] -= counts[after]
            total = np.array([counts[before].sum()])
            out.append(best_classes(np.maximum(rest, 0), np.zeros(hi - lo, int), codes, counts, total)[0])
        yield record_batch(moved, names, np.array(out))

    ctx = pairs.select("a", "b", "n").mapInArrow(neighbours, "word int, code int, n long")
    ctx = ctx.groupBy("word", "code").agg(F.sum("n").alias("n"))
    found = ctx.repartition("word").mapInArrow(decide, "word int, class int").collect()
    classes = classes.copy()
    for r in found:
        classes[r.word] = r["class"]
    return classes


def exchange(pairs: DataFrame, n_core: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of every core word, and the counts of neighbouring classes, of the best round."""
    classes = 1 + np.arange(n_core + 1) % CLASSES
    classes[END], classes[n_core] = END, OTHER
    table = class_table(pairs, classes)
    best = (likelihood(table), classes, table)
    for k in range(rounds):
        classes = exchange_round(pairs, classes, table, k % 2)
        table = class_table(pairs, classes)
        value = likelihood(table)
        if value > best[0]:
            best = (value, classes, table)
    return best[1:]


# ---- all other words -------------------------------------------------------

SEEN = "word binary, block long, number int, n long, context binary"
ASSIGNED = "word binary, block long, number int, n long, class int"


def seen_words(encoded: DataFrame, classes: np.ndarray) -> DataFrame:
    """A row for each block and word outside the core: its count in training texts, and neighbours' classes.

    ``context`` packs a class (of the word before, or ``ALL`` + that of the next one) into
    the low byte of four, and how often into the others.
    """
    schema = pa.schema(
        [
            ("word", pa.binary()),
            ("block", pa.int64()),
            ("number", pa.int32()),
            ("n", pa.int64()),
            ("context", pa.binary()),
        ]
    )
    n_core = len(classes) - 1

    def look(batches):
        for block, codes, train, row in _blocks(batches):
            words = row.column("words").flatten()
            held = classes.astype(np.uint8)[np.minimum(codes, n_core)]
            at = np.flatnonzero(train & (codes >= n_core))
            own = codes[at].astype(np.int64) - n_core
            # The last word of a text is its end, so there is a next one.
            before = np.where(at > 0, held[at - 1], END)
            key = np.append(own * (2 * ALL) + before, own * (2 * ALL) + ALL + held[at + 1])
            key, n = _summed(key)
            packed = (key % (2 * ALL) | n << 8).astype("<u4")
            sizes = np.bincount(key // (2 * ALL), minlength=len(words))
            ends = np.append(0, np.cumsum(4 * sizes)).astype(np.int32)
            context = pa.Array.from_buffers(
                pa.binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(packed)]
            )
            total = np.bincount(own, minlength=len(words))
            full = record_batch(
                schema, words, np.full(len(words), block), np.arange(len(words)), total, context
            )
            for start in range(0, len(words), 1 << 14):
                yield full.slice(start, 1 << 14)

    return encoded.mapInArrow(tidy(look), SEEN)


def assign(seen: DataFrame, table: np.ndarray, parts: int) -> DataFrame:
    """Count and class of every word, in a row for each block it occurs in; ``word`` stands in the first."""
    schema = pa.schema(
        [
            ("word", pa.binary()),
            ("block", pa.int64()),
            ("number", pa.int32()),
            ("n", pa.int64()),
            ("class", pa.int32()),
        ]
    )

    def settle(rows: pa.RecordBatch):
        words = rows.column("word")
        new = np.append(True, _differ(words))
        group = np.cumsum(new) - 1
        totals = np.bincount(group, rows.column("n").to_numpy(), group[-1] + 1).astype(np.int64)
        context = rows.column("context")
        offsets = np.frombuffer(context.buffers()[1], np.int32)[context.offset :][: len(rows) + 1]
        packed = np.frombuffer(context.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view("<u4")
        owner = np.repeat(group, np.diff(offsets) // 4)
        classes = np.full(len(totals), OTHER)
        if len(packed):
            key = owner * 256 + (packed & 255)
            order = np.argsort(key, kind="stable")
            key, n = key[order], (packed[order] >> 8).astype(np.int64)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[starts], np.add.reduceat(n, starts)
            best = best_classes(table, key >> 8, key & 255, n, totals)
            classes = np.where(totals > 0, best, OTHER)
        shown = pa.array([w if first else None for w, first in zip(words.to_pylist(), new.tolist())], pa.binary())
        return record_batch(
            schema, shown, rows.column("block"), rows.column("number"), totals[group], classes[group]
        )

    def walk(batches):
        held = []
        for batch in batches:
            cuts = np.flatnonzero(_differ(batch.column("word"))) + 1
            if held and held[-1].column("word")[-1] != batch.column("word")[0]:
                yield settle(_joined(held))
                held = []
            if len(cuts):
                last = int(cuts[-1])
                yield settle(_joined([*held, batch.slice(0, last)]))
                held = [batch.slice(last)]
            else:
                held.append(batch)
        if held:
            yield settle(_joined(held))

    ordered = seen.repartition(parts, "word").sortWithinPartitions("word")
    return ordered.mapInArrow(tidy(walk), ASSIGNED)


def _joined(batches: list) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _differ(words: pa.Array) -> np.ndarray:
    """Whether each word but the first differs from the one before it."""
    import pyarrow.compute as pc

    if len(words) < 2:
        return np.zeros(0, bool)
    return pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)


# ---- scores ----------------------------------------------------------------

SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base double, emitted double, classes binary"


class Emission:
    """What is known of single words: counts of the core, sizes of classes, and of all."""

    def __init__(self, core_n: np.ndarray, core_class: np.ndarray, class_n: np.ndarray, tokens: int, words: int):
        self.core_n, self.core_class, self.class_n = core_n, core_class, class_n
        self.tokens, self.words = tokens, words

    def score(self, codes, sizes, tail_n, tail_class):
        """Known words, base score, emission score of some texts, and the classes of their words."""
        n = np.append(self.core_n, tail_n)[codes]
        cls = np.append(self.core_class, tail_class)[codes]
        starts = np.cumsum(sizes) - sizes
        base = np.log10((n + 1) / (self.tokens + self.words + 1))
        known = n > 0
        emitted = np.log10(np.where(known, n / np.maximum(self.class_n[cls], 1), 1.0))
        marked = (cls | np.where(n == 1, ONCE, 0)).astype(np.uint8)
        sums = (np.add.reduceat(x, starts) for x in (known.astype(np.int64), base, emitted))
        return (*sums, marked)


def class_sequences(encoded: DataFrame, assigned: DataFrame, emission: Emission) -> DataFrame:
    """Every text with the sums that need no neighbours, and the classes of its words, a byte each."""
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("train", pa.bool_()),
            ("n_tokens", pa.int64()),
            ("n_known", pa.int64()),
            ("base", pa.float64()),
            ("emitted", pa.float64()),
            ("classes", pa.binary()),
        ]
    )

    def decode(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.combine_chunks().to_batches()
        (found,) = right.combine_chunks().to_batches() or [None]
        codes = np.frombuffer(row.column("codes")[0].as_buffer(), np.uint32)
        sizes = row.column("sizes").flatten().to_numpy().astype(np.int64)
        tail = len(found) if found else 0
        tail_n, tail_class = np.zeros(tail, np.int64), np.zeros(tail, np.int64)
        if tail:
            spot = found.column("number").to_numpy()
            tail_n[spot], tail_class[spot] = found.column("n").to_numpy(), found.column("class").to_numpy()
        known, base, emitted, marked = emission.score(codes, sizes, tail_n, tail_class)
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        texts = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(marked)])
        doc_ids, train = row.column("doc_ids").flatten(), row.column("train").flatten()
        return pa.Table.from_batches([record_batch(schema, doc_ids, train, sizes, known, base, emitted, texts)])

    blocks = encoded.select("block", "doc_ids", "train", "sizes", "codes").groupBy("block")
    words = assigned.select("block", "number", "n", "class").groupBy("block")
    return blocks.cogroup(words).applyInArrow(decode, SCORED)


def _texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(batch) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def count_transitions(sequences: DataFrame) -> np.ndarray:
    """Neighbouring classes in training texts; words seen once count as unknown ones, too."""
    schema = pa.schema([("c", pa.int32()), ("d", pa.int32()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(ALL * ALL, np.int64)
        for batch in batches:
            marked, _ = _texts(batch, "classes")
            now = (marked & (ONCE - 1)).astype(np.int64)
            before = np.append(END, now[:-1])
            once = marked >= ONCE
            after_once = np.append(False, once[:-1])
            total += np.bincount(before * ALL + now, minlength=ALL * ALL)
            total += np.bincount(before[once] * ALL + OTHER, minlength=ALL * ALL)
            total += np.bincount(OTHER * ALL + now[after_once], minlength=ALL * ALL)
            total[OTHER * ALL + OTHER] += int((once & after_once).sum())
        used = np.flatnonzero(total)
        yield record_batch(schema, used // ALL, used % ALL, total[used])

    return _collected(sequences.where("train").select("classes").mapInArrow(count, "c int, d int, n long"))


def transition_shares(counts: np.ndarray) -> np.ndarray:
    """``P(next class | class)``, each row adding up to 1."""
    # Tokens of each class, and those seen once as unknown ones, of which there is at least one.
    seen = counts[:OTHER].sum(axis=0).astype(float)
    seen[OTHER] += 1
    share = seen / seen.sum()
    return (counts + CLASSES * share) / (counts.sum(axis=1, keepdims=True) + CLASSES)


class ClassModel:
    """A fitted model: ``words`` (``word, n, class``; the end is the empty word), ``transitions``, and
    ``scores`` of all texts it was made with."""

    def __init__(self, words, transitions, scores, tokens, n_words):
        self.words, self.transitions, self.scores = words, transitions, scores
        self.tokens, self.n_words = tokens, n_words


def class_model(docs: DataFrame, held_out: Column, rounds: int = ROUNDS) -> ClassModel:
    """Learn from the rows of ``docs`` (``doc_id``, ``text``) that are not ``held_out``; score all.

    ``scores`` has ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` for every row. The words of a text are followed by one end, a token, too. ``base_score`` is that of
    single words with one added to each count, ``score`` the model's log10 probability. NULL texts are
    empty; a NULL ``held_out`` (as of a NULL id) counts as false; repeated rows count and are
    scored as often as they stand there; other columns are ignored. Without training
    rows every word is unknown and both scores are 0. Texts of any length are one
    row; ties between words go by their bytes, those between classes to the smaller number.
    """
    spark = docs.sparkSession
    train = ~F.coalesce(held_out, F.lit(False))
    texts = docs.select(F.col("doc_id").cast("long"), train.alias("train"), text_bytes().alias("text"))
    counts = store(count_words(texts.where("train")), "words")
    tokens, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # At most CORE_ONE_IN words have so large a share.
    top = counts.where((F.col("n") * CORE_ONE_IN > tokens) & (F.length("word") > 0)).collect()
    ends = counts.where(F.length("word") == 0).first()
    top = sorted(((bytes(r.word), r.n) for r in top), key=lambda r: (-r[1], r[0]))
    core = [b"", *(word for word, _ in top)]
    core_n = np.array([ends.n if ends else 0, *(n for _, n in top)], np.int64)
    encoded = store(encode(texts, core), "encoded")
    pairs = store(count_pairs(encoded, len(core)), "pairs")
    classes, table = exchange(pairs, len(core), rounds if top else 0)
    seen = seen_words(encoded, classes)
    blocks = encoded.agg(F.sum(F.size("words"))).first()[0] or 0
    assigned = store(assign(seen, table, partitions_for(encoded, blocks, ROWS_PER_TASK)), "classes")
    core_class = np.where(core_n > 0, classes[:-1], OTHER)
    class_n = np.bincount(core_class, core_n, ALL).astype(np.int64)
    # A row per class.
    sums = assigned.where("word IS NOT NULL").groupBy("class").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        class_n[r["class"]] += r.n
    emission = Emission(core_n, core_class, class_n, tokens, n_words)
    sequences = store(class_sequences(encoded, assigned, emission), "sequences")
    transitions = transition_shares(count_transitions(sequences))
    logs = np.log10(np.maximum(transitions, 1e-300))
    first = int(core_class[END])
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("n_tokens", pa.int64()),
            ("n_known", pa.int64()),
            ("train_tokens", pa.int64()),
            ("base_score", pa.float64()),
            ("score", pa.float64()),
        ]
    )

    def score(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            marked, offsets = _texts(batch, "classes")
            now = marked & (ONCE - 1)
            before = np.append(0, now[:-1])
            before[offsets[:-1]] = first
            moved = np.add.reduceat(logs[before, now], offsets[:-1])
            yield record_batch(
                schema,
                batch.column("doc_id"),
                ~batch.column("train").to_numpy(zero_copy_only=False),
                batch.column("n_tokens"),
                batch.column("n_known"),
                np.full(batch.num_rows, tokens),
                batch.column("base"),
                batch.column("emitted").to_numpy() + moved,
            )

    scores = sequences.mapInArrow(
        score,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
        " base_score double, score double",
    )
    # The core has a bounded size.
    rows = [(bytearray(w), int(n), int(c)) for w, n, c in zip(core, core_n, core_class) if n]
    core_words = spark.createDataFrame(rows, "word binary, n long, class int")
    words = assigned.where("word IS NOT NULL AND n > 0").select("word", "n", "class").unionByName(core_words)
    return ClassModel(words, transitions, scores, tokens, n_words)
