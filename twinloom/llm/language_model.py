"""Log-bilinear language model: trained by noise-contrastive estimation, scored with exact normalisers.

Tokens are words after lowering A-Z, and one end per text. A token's unit is the end, one of
the ``OWN`` most frequent words, or one of ``CLASSES`` classes of the other words by their
last three bytes. The model predicts the next unit from the two before it: the vectors of
the two, each times a matrix of its place, are added up and multiplied with the vector of
the predicted unit, plus its bias. A word of a class then has its smoothed share of the class, so
probabilities add up to one over all words, seen and unseen.

Training visits every token of the training texts once. Each task runs mini-batches in
numpy against shared noise drawn from the unit frequencies; the tasks' parameters are
averaged, weighted by their tokens, after each of the ``ROUNDS`` parts of the corpus, which grow
because later parts start from better parameters. Since the two context vectors add up,
the normalisers of all pairs of units are one product of two matrices of exponentials.

Word counts are grouped over all training texts. Words that are more than one in ``FREQUENT``
tokens, which can't be more than so many, travel to the tasks as one table, and no word that is
left can be hot; the others' counts are joined by the word itself. What is collected: that table, class totals and the parameters,
all of stated size.

Defined results: null and empty texts are one end; null identifiers are not held out;
repeated rows each count in training and get equal scores; a corpus without training texts
gives base scores of 0 and units of equal probability; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.functions.names import ref
from twinloom.llm.registry import query, table
from twinloom.llm.shared import pieces, stage, tasks

OWN = 768
CLASSES = 256
UNITS = OWN + CLASSES
#: Words with at least this part of all tokens are frequent, so there are at most as many.
FREQUENT = 1 << 19
SUFFIX = 3
WIDTH = 32
NOISE = 64
BATCH = 2048
RATE = 0.15
SEED = 5
#: Parts of the training texts, in sixteenths, between two averages.
ROUNDS = (1, 3, 12)
BLOCKS = 16
#: Tokens that a task shuffles at a time.
POOL = 1 << 20
#: Different words a task counts before it hands them on.
HELD = 1 << 19
END = 0


def trained_on(id_: Column) -> Column:
    """Rows that the model learns from: crc32 of the id as text leaves another remainder by 7 than 2."""
    return F.coalesce(F.crc32(id_.cast("string")) % 7 != 2, F.lit(True))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def class_of(word: bytes) -> int:
    return OWN + zlib.crc32(word[-SUFFIX:]) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the column ``text``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.binary()), "n": pa.array(held.values(), pa.int64())})

        for batch in pieces(batches, "text"):
            for text in batch.column("text").to_pylist():
                held.update(words(text))
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return texts.mapInArrow(add, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts of the training tokens: the most frequent words, the end, and totals of the classes."""

    words: list[bytes]
    counts: np.ndarray
    ends: int
    tokens: int
    kinds: int
    class_tokens: np.ndarray
    class_kinds: np.ndarray

    def units(self) -> np.ndarray:
        """The unit of each frequent word."""
        return np.array([k + 1 if k + 1 < OWN else class_of(w) for k, w in enumerate(self.words)], np.uint16)

    def base(self, counts):
        """log10 of the smoothed share of all tokens."""
        return np.log10((counts + 1.0) / (self.tokens + self.kinds + 1.0))

    def share(self) -> np.ndarray:
        """log10 of each frequent word's smoothed share of its unit."""
        unit = self.units().astype(np.int64)
        k = np.maximum(unit - OWN, 0)
        inner = np.log10((self.counts + 1.0) / (self.class_tokens[k] + self.class_kinds[k] + 1.0))
        return np.where(unit < OWN, 0.0, inner)

    def frequencies(self) -> np.ndarray:
        """Smoothed share of each unit among the training tokens; next to nothing for numbers without a word."""
        own = np.zeros(UNITS)
        used = min(OWN, len(self.words) + 1)
        own[END] = self.ends + 1
        own[1:used] = self.counts[: OWN - 1] + 1
        own[OWN:] = self.class_tokens + 1
        return np.maximum(own / own.sum(), 1e-30)


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """From the staged ``word_counts`` and the number of training texts."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).first()
    tokens = total["n"] or 0
    top = counts.filter(F.col("n") * F.lit(FREQUENT) > F.lit(tokens)).toArrow()  # at most FREQUENT words
    rows = sorted(zip(top.column("n").to_pylist(), top.column("word").to_pylist()), key=lambda r: (-r[0], r[1]))
    found = [word for _, word in rows]
    number = np.array([n for n, _ in rows], np.int64)
    part = F.crc32(F.substring("word", -SUFFIX, SUFFIX)) % CLASSES
    held, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(part.alias("part")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        held[r["part"]], kinds[r["part"]] = r["n"], r["kinds"]
    for word, n in zip(found[: OWN - 1], number):  # words of their own leave their class
        held[class_of(word) - OWN] -= n
        kinds[class_of(word) - OWN] -= 1
    return Vocabulary(found, number, ends, tokens + ends, total["kinds"] + (ends > 0), held, kinds)


def tokenised(docs: DataFrame, known: Vocabulary) -> DataFrame:
    """Id, trained, at, n_tokens, n_known, base, inner, units (16-bit numbers), rare words with their counts.

    Sums are over the frequent words and the end; the rare words of a text are listed.
    """
    spread = docs.sparkSession.sparkContext.broadcast(known)  # at most ``FREQUENT`` words
    kind = docs.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        find = {w: k for k, w in enumerate(model.words)}.get
        units, base, inner = model.units(), model.base(model.counts), model.share()
        end = float(model.base(model.ends))
        for batch in pieces(batches, "text"):
            found = {c: [] for c in ("n_tokens", "n_known", "base", "inner", "units")}
            rare, times, sizes = [], [], [0]
            for text in batch.column("text").to_pylist():
                own = words(text)
                rank = np.fromiter(map(find, own, repeat(-1)), np.int64, len(own))
                unit = np.zeros(len(own) + 1, np.uint16)
                unit[:-1] = units[rank] if len(units) else 0
                gone = rank < 0
                lost = list(compress(own, gone))
                unit[:-1][gone] = [class_of(w) for w in lost]
                counted = Counter(lost)
                rare.extend(counted.keys())
                times.extend(counted.values())
                sizes.append(len(rare))
                rank = rank[~gone]
                found["n_tokens"].append(len(unit))
                found["n_known"].append(len(rank) + (model.ends > 0))
                found["base"].append(base[rank].sum() + end)
                found["inner"].append(inner[rank].sum())
                found["units"].append(unit.tobytes())
            lists = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], ["word", "n"])
            yield pa.RecordBatch.from_pydict(
                {
                    **{c: batch.column(c) for c in ("id", "trained", "at")},
                    **found,
                    "rare": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), lists),
                }
            )

    return docs.mapInArrow(
        read,
        f"id {kind}, trained boolean, at long, n_tokens long, n_known long, base double, inner double, "
        "units binary, rare array<struct<word: binary, n: long>>",
    )


class Model:
    """Parameters as one flat array: unit vectors, vectors of predicted units, two matrices, biases."""

    SHAPES = ((UNITS, WIDTH), (UNITS, WIDTH), (2, WIDTH, WIDTH), (UNITS,))
    SIZE = -(-sum(int(np.prod(s)) for s in SHAPES) // BLOCKS) * BLOCKS

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        parts, at = [], 0
        for shape in self.SHAPES:
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape))
            at += size
        self.context, self.output, self.places, self.bias = parts

    @classmethod
    def start(cls, frequencies: np.ndarray) -> Model:
        """Unit frequencies as biases, small vectors: at first the prediction doesn't depend on the context."""
        random = np.random.default_rng(SEED)
        model = cls(np.zeros(cls.SIZE, np.float32))
        model.context[:] = random.normal(0, 0.3, model.context.shape)
        model.output[:] = random.normal(0, 0.01, model.output.shape)
        model.places[:] = np.eye(WIDTH)
        model.bias[:] = np.log(frequencies)
        return model

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the unit before and the one before that add to each unit's score, and all normalisers."""
        near = self.context @ self.places[0] @ self.output.T + self.bias
        far = self.context @ self.places[1] @ self.output.T
        top, rise = near.max(1, keepdims=True), far.max(1, keepdims=True)
        both = np.exp(near - top) @ np.exp(far - rise).T
        return near, far, np.log(np.maximum(both, 1e-37)) + top + rise.T


def examples(units: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every token of the texts with the two before it, and where the texts begin. Ends stand before a text."""
    parts = [np.frombuffer(u, np.uint16) for u in units]
    token = np.concatenate(parts).astype(np.int64)
    begin = np.cumsum([0, *[len(p) for p in parts[:-1]]])
    one, two = np.zeros_like(token), np.zeros_like(token)
    one[1:] = token[:-1]  # the text before ends with an end
    two[2:] = token[:-2]
    two[begin] = END
    return token, one, two, begin


def _by_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows and the sums of their values."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # 16 bits are sorted by radix
    rows = rows[order]
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[first], np.add.reduceat(values[order], first, axis=0)


class Trainer:
    """Mini-batches of noise-contrastive estimation with step sizes per parameter."""

    def __init__(self, flat: np.ndarray, past: np.ndarray, frequencies: np.ndarray, seed: int):
        self.model, self.past = Model(flat.copy()), Model(past.copy())
        self.share = np.log(frequencies).astype(np.float32)
        self.cumulated = np.cumsum(frequencies)
        self.random = np.random.default_rng(seed)
        self.tokens = 0

    def _move(self, name: str, at, change: np.ndarray) -> None:
        past, now = getattr(self.past, name), getattr(self.model, name)
        past[at] += change * change
        now[at] += RATE * change / np.sqrt(past[at] + 1e-6)

    def step(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m = self.model
        noise = np.searchsorted(self.cumulated, self.random.random(NOISE) * self.cumulated[-1]).clip(0, UNITS - 1)
        near, far = m.context[one], m.context[two]
        mean = near @ m.places[0] + far @ m.places[1]
        wanted, other = m.output[token], m.output[noise]
        # log-odds of data against NOISE draws of noise
        lift = np.float32(np.log(NOISE))
        yes = np.einsum("ij,ij->i", mean, wanted) + m.bias[token] - self.share[token] - lift
        no = mean @ other.T + (m.bias[noise] - self.share[noise] - lift)
        with np.errstate(over="ignore"):
            up = 1 / (1 + np.exp(yes))
            np.exp(np.negative(no, out=no), out=no)
            no += 1
            down = np.divide(-1, no, out=no)
        back = up[:, None] * wanted + down @ other
        scale = np.float32(1 / len(token))
        back *= scale
        places = np.stack([near.T @ back, far.T @ back])
        rows, change = _by_row(np.concatenate([one, two]), np.concatenate([back @ m.places[0].T, back @ m.places[1].T]))
        pushes = np.empty((len(token) + NOISE, WIDTH + 1), np.float32)
        np.multiply(up[:, None], mean, out=pushes[: len(token), :-1])
        np.matmul(down.T, mean, out=pushes[len(token) :, :-1])
        pushes[: len(token), -1], pushes[len(token) :, -1] = up, down.sum(0)
        pushes *= scale
        to, push = _by_row(np.concatenate([token, noise]), pushes)
        self._move("context", rows, change)
        self._move("output", to, push[:, :-1])
        self._move("bias", to, push[:, -1])
        self._move("places", slice(None), places)
        self.tokens += len(token)

    def visit(self, token: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        order = self.random.permutation(len(token))
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            self.step(token[at], one[at], two[at])


def _trained(rows: DataFrame, flat: np.ndarray, past: np.ndarray, frequencies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parameters and squared steps after one part of the corpus, averaged over its tasks."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = None
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for units in batch.column("units").to_pylist():
                if trainer is None:
                    trainer = Trainer(flat, past, frequencies, zlib.crc32(units))
                held.append(units)
                size += len(units) // 2
                if size >= POOL:
                    trainer.visit(*examples(held)[:3])
                    held, size = [], 0
        if held:
            trainer.visit(*examples(held)[:3])
        if trainer is not None:
            weight = float(trainer.tokens)
            both = np.stack([trainer.model.flat, trainer.past.flat]).reshape(2, BLOCKS, -1).transpose(1, 0, 2)
            yield pa.RecordBatch.from_pydict(
                {"block": np.arange(BLOCKS), "weight": np.full(BLOCKS, weight), "part": pa.array([p.tobytes() for p in both], pa.binary())}
            )

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, weight, part in zip(*(batch.column(c).to_pylist() for c in ("block", "weight", "part"))):
                own = sums.setdefault(block, [0.0, 0.0])
                own[0] += weight
                own[1] = own[1] + weight * np.frombuffer(part, np.float32).astype(np.float64)
        if sums:
            mean = [(s / w).astype(np.float32).tobytes() for w, s in sums.values()]
            yield pa.RecordBatch.from_pydict({"block": list(sums), "weight": [w for w, _ in sums.values()], "part": pa.array(mean, pa.binary())})

    shape = "block long, weight double, part binary"
    parts = rows.select("units").mapInArrow(learn, shape).repartition(tasks(rows.sparkSession), "block")
    out = np.stack([flat, past]).reshape(2, BLOCKS, -1).transpose(1, 0, 2).copy()
    for r in parts.mapInArrow(average, shape).collect():  # the parameters, once
        out[r["block"]] = np.frombuffer(r["part"], np.float32).reshape(2, -1)
    flat, past = out.transpose(1, 0, 2).reshape(2, -1)
    return flat, past


def train(rows: DataFrame, known: Vocabulary) -> Model:
    """``rows``: staged ``tokenised`` texts. Learns from every token of those that are trained on."""
    frequencies = known.frequencies()
    flat = Model.start(frequencies).flat
    past = np.zeros_like(flat)
    part, low = F.pmod(F.xxhash64("at"), F.lit(sum(ROUNDS))), 0
    for size in ROUNDS:
        chosen = rows.filter(F.col("trained") & (part >= low) & (part < low + size))
        flat, past = _trained(chosen, flat, past, frequencies)
        low += size
    return Model(flat)


def scorer(model: Model) -> Callable[[list[bytes]], np.ndarray]:
    """A function from the units of texts to their log10 probabilities."""
    near, far, norm = model.scores()

    def score(units: list[bytes]) -> np.ndarray:
        token, one, two, begin = examples(units)
        each = near[one, token].astype(np.float64) + far[two, token] - norm[one, two]
        return np.add.reduceat(each, begin) / np.log(10)

    return score


def learn(docs: DataFrame, id_col: str, text_col: str, learn_from: Callable[[Column], Column] = trained_on) -> tuple[DataFrame, DataFrame, Vocabulary, Model]:
    """The tokenised texts and the word counts, both staged, the vocabulary and the trained model."""
    rows = docs.select(
        ref(id_col).alias("id"), ref(text_col).alias("text"), learn_from(ref(id_col)).alias("trained"), F.monotonically_increasing_id().alias("at")
    )
    learned = rows.filter("trained")
    counts = stage(word_counts(learned.select("text")))
    known = vocabulary(counts, learned.count())
    read = stage(tokenised(rows, known))
    return read, counts, known, train(read, known)


def judged(read: DataFrame, counts: DataFrame, known: Vocabulary, model: Model) -> DataFrame:
    """Id, held_out, n_tokens, n_known, train_tokens, base_score and score of tokenised texts."""
    flat = model.flat

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for batch in batches:
            if batch.num_rows:
                score = score or scorer(Model(flat))
                found = score(batch.column("units").to_pylist()) + batch.column("inner").to_numpy()
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in passed}, "score": found})

    passed = ["id", "trained", "at", "n_tokens", "n_known", "base"]
    schema = ", ".join(f"{c} {read.schema[c].dataType.simpleString()}" for c in passed)
    scored = read.select(*passed, "inner", "units").mapInArrow(judge, f"{schema}, score double")

    rare = read.select("at", F.inline("rare")).join(counts.withColumnRenamed("n", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0)) + F.lit(1.0)
    sizes = F.array(*[F.lit(float(x)) for x in known.class_tokens + known.class_kinds + 1])
    own = F.get(sizes, (F.crc32(F.substring("word", -SUFFIX, SUFFIX)) % CLASSES).cast("int"))
    missing = rare.groupBy("at").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("k"),
        F.sum(F.col("n") * F.log10(c / F.lit(float(known.tokens + known.kinds + 1)))).alias("b"),
        F.sum(F.col("n") * F.log10(c / own)).alias("s"),
    )
    return scored.join(missing, "at", "left").select(
        "id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn_from: Callable[[Column], Column] = trained_on) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of whole texts; ``base_score`` is that of smoothed word
    frequencies. ``learn_from`` turns the identifier into the rows to learn from.
    """
    return judged(*learn(docs, id_col, text_col, learn_from)).withColumnRenamed("id", id_col)


@query("op13_lm_scoring")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
