"""LM scoring: a causal self-attention model over subword classes, mixed with the corpus's own word frequencies.

Subword ids come from a public tokenizer file.  Frequent ids are classes of
their own, the others share classes by frequency, and an id's share within its
class is a training count.  The model trains on all tokens of the training text,
cut into blocks; tasks train on their own blocks from common parameters, which
are then averaged.  Counts of ids and words cover all training text.  A word's
chance is a mix of the model's, multiplied over its subwords, and of its frequency.

Text is cut into words and ids once: a task writes its documents as numbers of
words, behind a dictionary of these words with their ids and counts.  Words are
counted, blocks made and documents scored from that.

Counts of the most frequent words travel with the tasks; the others of a text
are joined to the counts, one row per occurrence, and none of them is frequent.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgas.llm import attention as att
from sparkgas.llm.common import bounded_batches, id_remainder, texts
from sparkgas.llm.tokens import IdCache, default_file, read_file
from sparkgas.plans.cluster import cut

FREQUENT = 200_000  # words whose counts are known to every task
LEARNT = 600_000  # words of a dictionary, after which a task begins another one
HELD = 8_000_000  # words of documents that wait for their dictionary
GATHERED = 8 << 20  # bytes of texts that are cut into words together
ENTRIES = 50_000  # words of a dictionary that make a row
TOGETHER = 1_000_000  # words of documents that are looked up together, unless one document has more
BLOCK = 256  # token ids of a row that trains the model
STEP = 8_192  # token ids that a training step takes together
WARM_UP = 2_000  # about so many blocks settle the common start, a documented bound; all of them train after it
MIX = 0.5  # share of the word frequencies
SINGLE = att.CLASSES - att.GROUP - 1  # ids that are classes of their own


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()


NUMBERED = "part int, words string, seen array<bigint>, sizes binary, ids binary, doc_id bigint, held_out boolean, numbers binary"


def gathered(batches) -> Iterator:
    """Batches put together until they hold ``GATHERED`` bytes: words that come again are met once."""
    import pyarrow as pa

    some, held = [], 0
    for batch in batches:
        if len(batch):
            some.append(batch)
            held += batch.nbytes
        if held >= GATHERED:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, held = [], 0
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def numbered(docs: DataFrame, spec: str, vocabulary: int) -> DataFrame:
    """Documents as numbers of words, each task's behind a dictionary of their words.

    A row of a dictionary has its ``part``, from 0 on, and up to ``ENTRIES`` words
    one behind the other, with how often each is ``seen`` in training, the ``sizes``
    in ids, and the ids.  Its first word is the empty one, the end of a text.
    A row of a document has its words' ``numbers`` in the dictionary before it.
    """
    kind = _id_type(vocabulary)

    def number(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [f.split()[0] for f in NUMBERED.split(", ")]

        class Dictionary:
            def __init__(self):
                self.known, self.ids, self.seen = {"": 0}, [b""], np.zeros(1 << 16, np.int64)
                self.waiting, self.held = [], 0

            def add(self, batch) -> None:
                split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
                found, lengths = split.flatten().dictionary_encode(), pc.list_value_length(split).to_numpy()
                shown, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
                document = np.repeat(np.arange(len(lengths)), lengths)
                if "" in shown:  # white space at the ends of a text
                    kept = at != shown.index("")
                    at, document = at[kept], document[kept]
                    lengths = np.bincount(document, minlength=len(lengths))
                own = np.fromiter(map(self.known.get, shown, repeat(-1)), np.int64, len(shown))
                missing = np.flatnonzero(own < 0)
                if len(missing):
                    new = [shown[i] for i in missing.tolist()]
                    own[missing] = np.arange(len(self.ids), len(self.ids) + len(new))
                    self.known.update(zip(new, own[missing].tolist()))
                    self.ids += cache.ids_of(new)
                    if len(self.ids) > len(self.seen):
                        self.seen = np.append(self.seen, np.zeros(len(self.ids), np.int64))
                training = ~np.array(batch.column("held_out").to_pylist(), bool)
                self.seen[own] += np.bincount(at[training[document]], minlength=len(own))
                self.seen[0] += training.sum()
                ends = np.append(0, 4 * np.cumsum(lengths)).astype(np.int32)
                numbers = [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(own[at].astype("<u4").tobytes())]
                self.waiting.append((batch.select(["doc_id", "held_out"]), pa.Array.from_buffers(pa.binary(), len(lengths), numbers)))
                self.held += len(at)

            def rows(self):
                shown, sizes = list(self.known), np.fromiter(map(len, self.ids), np.int64, len(self.ids)) // 4
                for part, a in enumerate(range(0, len(shown), ENTRIES)):
                    b = min(a + ENTRIES, len(shown))
                    ids = np.frombuffer(b"".join(self.ids[a:b]), "<u4").astype(kind).tobytes()
                    row = [part, " ".join(shown[a:b]), self.seen[a:b].tolist(), sizes[a:b].astype("<u4").tobytes(), ids, None, None, None]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row))], schema)
                for batch, numbers in self.waiting:
                    nulls = [pa.nulls(len(batch), schema.field(c).type) for c in names[:5]]
                    columns = [*nulls, batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), numbers]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        types = [pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), pa.binary()]
        schema = pa.schema(list(zip(names, types)))
        gc.disable()  # nothing here refers to itself, and looking for that among many words takes long
        att.keep_memory()
        cache, current = IdCache(spec), Dictionary()
        for batch in gathered(batches):
            current.add(batch)
            if len(current.known) > LEARNT or current.held > HELD:
                yield from current.rows()
                current = Dictionary()
        if current.waiting:
            yield from current.rows()
        gc.enable()

    return docs.select("doc_id", "held_out", "text").mapInArrow(number, NUMBERED)


def count_words(found: DataFrame) -> DataFrame:
    """``(word, c)`` over the training documents of a numbered table; the end of a text is the empty word."""

    def entries(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            rows = pa.RecordBatch.from_arrays([pc.split_pattern(batch.column("words"), " ").flatten(), batch.column("seen").flatten()], ["word", "c"])
            yield rows.filter(pc.greater(rows.column("c"), 0))

    read = found.where("part is not null").select("words", "seen")
    return read.mapInArrow(entries, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


class Entries:
    """A dictionary as its rows are read: sizes, first places and ids of its words."""

    def __init__(self, vocabulary: int):
        self.kind, self.rows = _id_type(vocabulary), []

    def add(self, row: dict) -> None:
        if row["part"] == 0:
            self.rows = []
        self.rows.append(row)

    def made(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.concatenate([np.frombuffer(r["sizes"], "<u4") for r in self.rows]).astype(np.int64)
        return size, np.cumsum(size) - size, np.concatenate([np.frombuffer(r["ids"], self.kind) for r in self.rows])


def read_numbered(batches, vocabulary: int) -> Iterator[tuple]:
    """``(dictionary, rows, numbers, lengths)`` for some documents at a time: the words' numbers one behind the other."""
    import pyarrow.compute as pc

    entries = Entries(vocabulary)
    for batch in batches:
        is_entry = pc.is_valid(batch.column("part")).to_numpy(zero_copy_only=False)
        numbers = [x or b"" for x in batch.column("numbers").to_pylist()]
        held = np.array([len(x) // 4 for x in numbers], np.int64)
        a = 0
        while a < len(batch):
            if is_entry[a]:
                entries.add(batch.slice(a, 1).to_pylist()[0])
                a += 1
                continue
            b, words_held = a + 1, held[a]
            while b < len(batch) and not is_entry[b] and words_held + held[b] <= TOGETHER:
                words_held += held[b]
                b += 1
            yield entries, batch.slice(a, b - a), np.frombuffer(b"".join(numbers[a:b]), "<u4").astype(np.int64), held[a:b]
            a = b


def blocks(docs: DataFrame, spec: str, vocabulary: int) -> DataFrame:
    """:func:`blocks_of` texts that all train."""
    rows = docs.select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    return blocks_of(numbered(rows, spec, vocabulary), vocabulary)


def blocks_of(found: DataFrame, vocabulary: int) -> DataFrame:
    """``(at, context, last, ids)``: the token ids of every training document in consecutive blocks, from id ``at`` on.

    The first ``context`` ids of a block repeat the end of the block before; the
    ``last`` one of a document is followed by its end.  A text without ids is one block.
    """
    kind = np.dtype(_id_type(vocabulary))

    def take(batches):
        import pyarrow as pa

        att.keep_memory()
        wide, met, made = kind.itemsize, None, None
        for entries, _, numbers, lengths in read_numbered(batches, vocabulary):
            if met is not entries.rows:
                met, made = entries.rows, entries.made()
            size, first, pool = made
            ids, per_word = pool.take(spread(numbers, size, first)).tobytes(), size.take(numbers)
            sums = np.append(0, np.cumsum(per_word))
            ends = sums.take(np.cumsum(lengths))
            at, context, last, some = [], [], [], []
            for begin, end in zip([0, *ends.tolist()], ends.tolist()):
                n = end - begin
                for own in range(0, n or 1, BLOCK):
                    start = max(0, own - att.CONTEXT)
                    at.append(start)
                    context.append(own - start)
                    last.append(own + BLOCK >= n)
                    some.append(ids[wide * (begin + start) : wide * (begin + min(own + BLOCK, n))])
            columns = [pa.array(at, pa.int64()), pa.array(context, pa.int32()), pa.array(last, pa.bool_()), pa.array(some, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["at", "context", "last", "ids"])

    read = found.where("part is not null or not held_out").select("part", "sizes", "ids", "numbers")
    return read.mapInArrow(take, "at bigint, context int, last boolean, ids binary")


def spread(numbers: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the ids of words one behind the other, in the ids of their dictionary."""
    sizes = size.take(numbers)
    heads = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(first.take(numbers) - heads, sizes)


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def id_counts(found: DataFrame, vocabulary: int) -> tuple[np.ndarray, int]:
    """Occurrences of every id in the blocks, summed task by task, and the number of texts."""
    kind = _id_type(vocabulary)

    def count(batches):
        import pyarrow as pa

        total = np.zeros(vocabulary + 1, np.int64)  # the last cell is for the ends
        for batch in batches:
            own = [np.frombuffer(ids, kind)[c:] for ids, c in zip(batch.column("ids").to_pylist(), batch.column("context").to_pylist())]
            if own:
                total[:-1] += np.bincount(np.concatenate(own), minlength=vocabulary)
                total[-1] += sum(batch.column("last").to_pylist())
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = found.mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id
    out = np.zeros(vocabulary + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out[:-1], int(out[-1])


class Classes:
    """The class of every id, and the logarithm of its share within the class.  Class 0 is the end of a text."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        self.of = np.zeros(len(counts), np.uint8)
        self.of[order[:SINGLE]] = np.arange(1, SINGLE + 1)
        rest = np.array_split(order[SINGLE:][: int((counts[order[SINGLE:]] > 0).sum())], att.GROUP - 1)
        for k, ids in enumerate(rest):
            self.of[ids] = SINGLE + 1 + k
        unseen = order[SINGLE:][int((counts[order[SINGLE:]] > 0).sum()) :]
        self.of[unseen] = att.CLASSES - 1
        weight = counts + 0.5
        total = np.bincount(self.of, weight, att.CLASSES)
        self.log_share = np.log(weight / total[self.of])
        self.frequencies = np.bincount(self.of, counts, att.CLASSES)


def settling(found: DataFrame, most: int = WARM_UP) -> list[tuple[int, int, bool, bytes]]:
    """About ``most`` of the blocks, spread evenly over all of them by the hash of their row number, in a fixed order.

    Only they reach the driver, however many blocks or tasks there are.
    """
    every = max(1, found.count() // most)
    chosen = found.where(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(every)) == 0)
    return sorted(((r.at, r.context, r.last, bytes(r.ids)) for r in chosen.collect()), key=lambda b: (b[3], b[0], b[2]))


def train(found: DataFrame, classes: Classes, ends: int, rate: float = 0.03) -> dict[str, np.ndarray]:
    """Parameters after a warm-up on ``WARM_UP`` blocks and one averaged pass over all of them."""
    kind = _id_type(len(classes.of))
    first = att.start(classes.frequencies + ends * (np.arange(att.CLASSES) == 0))

    def learn(trainer: att.Trainer, rows) -> int:
        """Train on blocks, as many together as give ``STEP`` ids; returns how many ids and ends counted."""
        some, held, total = [], 0, 0

        def step():
            x, y, place, counted = att.sequences_of_blocks(some)
            trainer.step(x, y, place, counted)
            return int(counted.sum())

        for at, context, last, ids in rows:
            some.append((classes.of[np.frombuffer(ids, kind)], at, context, last))
            held += len(some[-1][0]) + 1
            if held >= STEP:
                total += step()
                some, held = [], 0
        return total + step() if some else total

    warm = settling(found)
    trainer = att.Trainer(first, rate)
    for _ in range(3):
        learn(trainer, warm)
    settled = att.pack(trainer.p)

    def pass_over(batches):
        import pyarrow as pa

        att.keep_memory()
        own = att.Trainer(att.unpack(settled), rate / 3)
        n = learn(own, (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("at", "context", "last", "ids")))))
        if n:
            flat = att.pack(own.p).astype(float) * n
            values = np.append(flat, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "v"])

    rows = found.mapInArrow(pass_over, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    if not rows:
        return att.unpack(settled)
    values = np.zeros(len(settled) + 1)
    for r in rows:  # one row per parameter
        values[r.cell] = r.v
    return att.unpack(values[:-1] / values[-1])


class Vocabulary:
    """What a task knows of the words of a dictionary: their classes, the share of their ids, their frequency if it is high."""

    def __init__(self, entries: Entries, classes: Classes, frequent: dict[bytes, int]):
        size, heads, flat = entries.made()
        empty = np.flatnonzero(size == 0)
        # a word that is white space to the tokenizer has no ids; it counts as the rarest id
        flat = np.insert(flat.astype(np.int64), heads[empty], int(classes.log_share.argmin()))
        size[empty] = 1
        self.names = [w for r in entries.rows for w in r["words"].encode().split(b" ")]
        self.pool, self.size, self.first = classes.of[flat], size, np.cumsum(size) - size
        self.share = np.add.reduceat(classes.log_share[flat], self.first)
        self.count = np.array([frequent.get(w, -1) for w in self.names])


MARKED = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, score double, "
    "rare string, rare_logs array<float>"
)


def _mark(found: DataFrame, vocabulary: int, classes, parameters, frequent, n: int, v: int, mix: float) -> DataFrame:
    """Per document: sums over its frequent words and its end, and its other words with the model's logarithm of each."""

    def mark(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = [f.split()[0] for f in MARKED.split(", ")]
        gc.disable()  # nothing here refers to itself, and looking for that among many words takes long
        att.keep_memory()
        scorer, met, words_of = att.Scorer(att.unpack(parameters)), None, None
        row = TaskContext.get().partitionId() << 40
        whole = n + 0.5 * (v + 1)
        p_end = (frequent.get(b"", 0) + 0.5) / whole
        for entries, batch, at, lengths in read_numbered(batches, vocabulary):
            if met is not entries.rows:
                met, words_of = entries.rows, Vocabulary(entries, classes, frequent)
            size = words_of.size.take(at)
            heads = np.cumsum(size) - size
            stream = words_of.pool.take(spread(at, words_of.size, words_of.first))
            # every text gets one more place, for its end
            text_of_word = np.repeat(np.arange(len(lengths)), lengths)
            n_tokens = np.bincount(text_of_word, size, len(lengths)).astype(np.int64)
            ends = np.cumsum(n_tokens + 1) - 1
            y = np.zeros(len(stream) + len(lengths), np.uint8)
            kept = np.ones(len(y), bool)
            kept[ends] = False
            y[kept] = stream
            x = np.append(np.uint8(0), y[:-1])
            place = (np.arange(len(y)) - np.repeat(ends - n_tokens, n_tokens + 1)).astype(np.int32)
            logs = scorer.log_probs(x, y, place).astype(float)
            by_word = (np.add.reduceat(logs[kept], heads) if len(heads) else np.zeros(0)) + words_of.share.take(at)
            count = words_of.count.take(at)
            is_rare = count < 0
            p = (np.maximum(count, 0) + 0.5) / whole
            sums = lambda values: np.bincount(text_of_word, np.where(is_rare, 0, values), len(lengths))
            base = sums(np.log10(p)) + np.log10(p_end)
            score = sums(np.log10(mix * p + (1 - mix) * np.exp(by_word))) + np.log10(mix * p_end + (1 - mix) * np.exp(logs[ends]))
            known = sums(np.ones(len(at))).astype(np.int64) + (frequent.get(b"", 0) > 0)
            rare_at = np.flatnonzero(is_rare)
            bounds = np.searchsorted(text_of_word[rare_at], np.arange(len(lengths) + 1))
            rare_names = [words_of.names[i] for i in at[rare_at].tolist()]
            rare = [b" ".join(rare_names[a:b]) if b > a else None for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(lengths))),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(lengths + 1),
                    pa.array(known),
                    pa.array(base),
                    pa.array(score),
                    pa.array(rare, pa.string()),
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(by_word[rare_at], pa.float32())),
                ],
                names,
            )
            row += len(lengths)
        gc.enable()

    return found.drop("seen").mapInArrow(mark, MARKED)


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """The most frequent words down to a count that a bounded number of them reaches."""
    by_size = counts.groupBy(F.floor(4 * F.log2("c")).alias("size")).agg(F.count("*").alias("n")).collect()  # one row per size
    least, total = None, 0
    for r in sorted(by_size, key=lambda r: -r.size):
        total += r.n
        if total > most:
            break
        least = r.size
    rows = counts.where((F.floor(4 * F.log2("c")) >= least) | (F.col("word") == "")) if least is not None else counts.where("word = ''")
    return {r.word.encode(): r.c for r in rows.collect()}


def score_texts(
    docs: DataFrame,
    held_out: int = 1,
    folds: int = 5,
    mix: float = MIX,
    tokenizer_file: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row.

    ``base_score`` sums log10((c + 0.5) / (N + 0.5 (V + 1))) over a text's words
    and its end, ``score`` the log10 of the mixed chance; a word without a count has
    the same 0.5 / (N + 0.5 (V + 1)) in the mix as in the base.  Words are compared with
    A-Z lower-cased; the tokenizer takes all letters in lower case, so words that
    differ only in other capitals share the model's part.

    Null and empty texts are their end alone; null ids belong to the fold of the
    empty text; repeated rows are counted and scored one by one; without training
    rows all counts are 0 and the model stays at its start; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec = read_file(tokenizer_file or default_file())
    rows = texts(docs, id_col, text_col).withColumn("held_out", id_remainder(F.col("doc_id"), folds) == held_out)
    vocabulary = _vocabulary_size(spec)
    read = cut(numbered(rows, spec, vocabulary))
    counts = cut(count_words(read))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = int(total.n), int(total.v)
    frequent = frequent_words(counts)
    found = cut(blocks_of(read, vocabulary))
    seen, ends = id_counts(found, vocabulary)
    classes = Classes(seen)
    parameters = att.pack(train(found, classes, ends))
    marked = cut(_mark(read, vocabulary, classes, parameters, frequent, n, v, mix))
    whole = float(n + 0.5 * (v + 1))
    pairs = F.explode(F.arrays_zip(F.split("rare", " ").alias("word"), F.col("rare_logs").alias("ln")))
    rare = marked.where("rare is not null").select("row", pairs.alias("w")).select("row", "w.word", F.col("w.ln").cast("double").alias("ln"))
    joined = rare.join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    p = (c + 0.5) / whole
    own = F.log10(mix * p + (1 - mix) * F.exp("ln"))
    summed = joined.groupBy("row").agg(
        F.sum((c > 0).cast("bigint")).alias("more_known"), F.sum(F.log10(p)).alias("more_base"), F.sum(own).alias("more_score")
    )
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return marked.drop("rare", "rare_logs").join(summed, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        add("known", "more_known").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        add("base", "more_base").alias("base_score"),
        add("score", "more_score").alias("score"),
    )


def _vocabulary_size(spec: str) -> int:
    import json

    parsed = json.loads(spec)
    return 1 + max([*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed["added_tokens"])])
