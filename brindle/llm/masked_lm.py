"""Masked pseudo-likelihood: a bidirectional window network in numpy scores every token from both sides."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, slices, whole_documents
from .hashing import Words, long

#: Classes of outputs, and outputs of a class, at least; all outputs then; words with known counts for each with an own output.
SPLIT, KNOWN = 96, 16
CLASSES = SPLIT * SPLIT
#: Words on either side, least width of an input vector, tokens of an update and of a look, rounds of averaging, first step size.
SIDE, WIDTH, MINIBATCH, SCORED, ROUNDS, RATE = 2, 12, 8192, 32768, 2, 0.5
#: Parameters of a piece that is summed in one group, and the bits after the point that they are summed in.
PIECE, BITS = 4096, 56
#: The first input stands for what lies beyond the document's edge.
EDGE = 0


def split_for(total: int) -> int:
    """Classes for a corpus of ``total`` words: words with an output of their own grow with its square root."""
    return max(SPLIT, 3 * round(0.98 * total**0.25 / 3))


def width_for(total: int) -> int:
    return max(WIDTH, 4 * round(3 * (total / 2**27) ** 0.125))


def parts_for(total: int) -> int:
    """Parts that train on their own in a round: with the square root of the corpus, whatever the cluster."""
    return max(1, round((total / 2**17) ** 0.5))


def shared(split: int) -> int:
    """Outputs (and inputs) that words share; the others are words' own."""
    return split * split // 9


class Network:
    """softmax over classes times softmax over the words of the class, both from tanh(inputs of the window, side by side, @ W).

    Output k is number k // split of class k % split: frequent words are in different classes.
    """

    def __init__(self, arrays: list[np.ndarray] | None = None, split: int = SPLIT, width: int = WIDTH):
        if arrays is None:
            random = np.random.Generator(np.random.PCG64(11))
            sizes = (0.3, (1 + split * split, width)), (0.15, (2 * SIDE * width, width)), (0.1, (width, split)), (0, split), (0.1, (split, width, split)), (0, (split, split))
            arrays = [random.normal(0, scale, shape) for scale, shape in sizes]
        self.e, self.w, self.o, self.b, self.words, self.word_b = (np.array(a, np.float32) for a in arrays)
        self.width, self.split = self.o.shape
        self.bound = 48 / self.width  # so that exp can't overflow

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.w, self.o, self.b, self.words, self.word_b]

    def start_from(self, mass: np.ndarray) -> None:
        """Biases that give every output its share of ``mass`` whatever the context."""
        rows = mass.reshape(self.split, self.split).T  # a row for each class
        share = rows.sum(axis=1)
        self.b[:] = np.clip(np.log(share / share.sum()), -12, 12)
        self.word_b[:] = np.clip(np.log(rows / share[:, None]), -20, 20)

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, hidden, logits of classes) for rows of 2 * SIDE inputs."""
        x = self.e.take(context.reshape(-1), axis=0).reshape(len(context), -1)
        hidden = x @ self.w
        np.tanh(hidden, out=hidden)
        logits = hidden @ self.o
        logits += self.b
        return x, hidden, logits

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Order of targets by class, their numbers in it, and (class, first, last) of each class that occurs."""
        classes = (target % self.split).astype(np.uint16)  # sorted by radix
        order = np.argsort(classes, kind="stable")
        ends = np.cumsum(np.bincount(classes, minlength=self.split)).tolist()
        return order, target[order] // self.split, [(c, a, b) for c, (a, b) in enumerate(zip([0, *ends], ends, strict=False)) if a < b]

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, hidden, logits = self.forward(context)
        ones = np.ones(self.split, np.float32)
        own = logits[np.arange(len(target)), target % self.split].astype(np.float64)
        np.exp(logits, out=logits)
        own -= np.log(logits @ ones)
        order, number, spans = self._by_class(target)
        hidden = hidden.take(order, axis=0)
        word, total = np.empty(len(target), np.float32), np.empty(len(target), np.float32)
        for c, a, b in spans:
            z = hidden[a:b] @ self.words[c]
            z += self.word_b[c]
            word[a:b] = z[np.arange(b - a), number[a:b]]
            np.exp(z, out=z)
            total[a:b] = z @ ones
        own[order] += word - np.log(total.astype(np.float64))
        return own

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float) -> None:
        """One step down the mean cross-entropy."""
        x, hidden, d = self.forward(context)
        step = np.float32(rate / len(target))
        ones = np.ones((self.split, 1), np.float32)
        np.exp(d, out=d)
        d *= step / (d @ ones)
        d[np.arange(len(target)), target % self.split] -= step
        back = d @ self.o.T
        order, number, spans = self._by_class(target)
        sorted_hidden = hidden.take(order, axis=0)
        word_back = np.empty_like(sorted_hidden)
        for c, first, last in spans:
            h, words = sorted_hidden[first:last], self.words[c]
            z = h @ words
            z += self.word_b[c]
            np.exp(z, out=z)
            z *= step / (z @ ones)
            z[np.arange(last - first), number[first:last]] -= step
            np.matmul(z, words.T, out=word_back[first:last])
            # A class is rare in a minibatch, so its words' step is larger, up to that of a minibatch of its own.
            more = np.float32(min(32, len(target) / (last - first)))
            words -= more * (h.T @ z)
            self.word_b[c] -= more * z.sum(axis=0)
            np.clip(words, -self.bound, self.bound, out=words)
        np.clip(self.word_b, -20, 20, out=self.word_b)
        back[order] += word_back
        hidden_square = hidden * hidden
        back -= back * hidden_square
        pull = back @ self.w.T
        self.o -= hidden.T @ d
        self.b -= d.sum(axis=0)
        np.clip(self.o, -self.bound, self.bound, out=self.o)
        np.clip(self.b, -12, 12, out=self.b)
        self.w -= x.T @ back
        # Rows of one input meet: they are summed before they are taken off. Inputs are rare in a minibatch, so their
        # step is larger, and bounded.
        at = context.reshape(-1)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        step = np.add.reduceat(pull.reshape(-1, self.width).take(order, axis=0), first, axis=0)
        step *= 32
        self.e[at[first]] -= np.clip(step, -0.5, 0.5, out=step)


class Vocabulary:
    """The corpus's most frequent words by hash with their counts: the first have an output each, all others share outputs.

    ``masses`` are the words of the corpus in each shared output.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int, split: int = SPLIT, masses: np.ndarray | None = None):
        order = np.argsort(hashes)
        self.split, self.shared = split, shared(split)
        self.own = split * split - self.shared
        self.sorted = hashes[order]
        if masses is None:  # words beyond the known share evenly what these leave
            masses = np.full(self.shared, (max(0, total - int(counts.sum())) + 1) / self.shared)
            log_others = np.full(self.shared, -math.log(max(1, (distinct - len(hashes)) / self.shared)))
        else:
            log_others = -np.log(np.maximum(masses, 1))
        self.mass = np.full(split * split, 1e-3)
        self.mass[: min(self.own, len(hashes))] = counts[: self.own]
        self.mass[self.own :] = np.maximum(masses, 1e-3)
        # A known word's output and its share of it; of another word, the part of the share that doesn't hang on its count.
        self.output, self.log_others = self._shared(hashes), log_others
        self.output[: self.own] = np.arange(min(self.own, len(hashes)))
        self.log_share = np.log(counts / self.mass[self.output]) if len(hashes) else np.zeros(0)
        self.output, self.log_share = self.output[order], self.log_share[order]

    def _shared(self, h: np.ndarray) -> np.ndarray:
        return self.own + (h.view(np.uint64) % np.uint64(self.shared)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(input, output, log share of the output, whether its count is known) of each word hash.

        Where it isn't, the logarithm of the count is still to be added to the share.
        """
        outputs = self._shared(h)
        share, hit = self.log_others[outputs - self.own], np.zeros(len(h), bool)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            hit = self.sorted[at] == h
            at = at[hit]
            outputs[hit], share[hit] = self.output[at], self.log_share[at]
        return outputs + 1, outputs, share, hit

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input, output, log share of the output) of each word hash."""
        return self.find(h)[:3]


def windows(row: np.ndarray, inputs: np.ndarray) -> np.ndarray:
    """Of every word the inputs of SIDE words on its left and right; EDGE outside its document, ``row``."""
    n = len(inputs)
    out = np.full((n, 2 * SIDE), EDGE, np.uint16 if inputs.max(initial=0) < 1 << 16 else np.uint32)  # 16 bits are sorted by radix
    for j, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        a, b = max(0, -d), n - max(0, d)
        if a < b:
            same = row[a:b] == row[a + d : b + d]
            out[a:b, j][same] = inputs[a + d : b + d][same]
    return out


def _counts(batch: pa.RecordBatch) -> dict:
    h, n = np.unique(long(Words(batch.column("text"), lower=True).hashes()), return_counts=True)
    return {"word": h, "n": n}


def _outputs(state):
    """Each document as the numbers of its words' outputs."""

    def make(batch: pa.RecordBatch) -> dict:
        words = Words(batch.column("text"), lower=True)
        found = state.value[0].look(long(words.hashes()))[1].astype("<u4").tobytes()
        ends = (4 * words.first).tolist()
        return {"part": batch.column("part"), "place": batch.column("place"), "outputs": [found[a:b] for a, b in zip(ends, ends[1:], strict=False)]}

    return make


def _fit_parts(state, rate: float, total: int):
    """Over documents sorted by part and place: each part moves the shared network, and returns it times its share of all tokens.

    Minibatches are cut from the part's tokens one after another, whatever batches they come in; numbers are rounded to
    2**-BITS, so that their sums are the same in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, net, tokens = None, None, 0
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def learn(last: bool) -> None:
            nonlocal waiting, size, tokens
            context, target = (np.concatenate(x) for x in zip(*waiting, strict=True))
            a = 0
            while size - a >= MINIBATCH or (last and a < size):
                n = min(MINIBATCH, size - a)
                net.learn(context[a : a + n], target[a : a + n], rate / math.sqrt(1 + tokens / 1e6))
                tokens, a = tokens + n, a + n
            waiting, size = [(context[a:], target[a:])], size - a

        def ended() -> pa.RecordBatch:
            if size:
                learn(True)
            flat = np.concatenate([x.reshape(-1) for x in net.arrays()]).astype(np.float64)
            flat = np.rint(flat * (tokens / total) * 2.0**BITS).astype("<i8")
            pieces = [flat[a : a + PIECE].tobytes() for a in range(0, len(flat), PIECE)]
            return pa.RecordBatch.from_arrays([pa.array([part] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()), pa.array([tokens] * len(pieces), pa.int64())], names=["part", "piece", "values", "tokens"])

        for batch in slices(batches, "outputs"):
            of = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if of[a] != part:
                    if tokens or size:
                        yield ended()
                    part, net, tokens, waiting, size = int(of[a]), Network(state.value[1]), 0, [], 0
                rows = [np.frombuffer(x, "<u4") for x in batch.column("outputs").slice(a, b - a).to_numpy(zero_copy_only=False)]
                target = np.concatenate(rows).astype(np.int64)
                waiting.append((windows(np.repeat(np.arange(len(rows)), [len(r) for r in rows]), target + 1), target))
                size += len(target)
                if size >= MINIBATCH:
                    learn(False)
        if tokens or size:
            yield ended()

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """One piece of some networks, summed."""
    total = np.zeros(len(rows.column("values")[0].as_buffer()) // 8, np.int64)
    for x in rows.column("values"):
        total += np.frombuffer(x.as_buffer(), "<i8")
    return pa.table({"piece": rows.column("piece").slice(0, 1), "values": pa.array([total.astype("<i8").tobytes()], pa.binary()), "tokens": pa.array([sum(rows.column("tokens").to_pylist())], pa.int64())})


def _after(word: int, n: int):
    """Words that come after this one by falling count."""
    return (F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > word))


def fit(docs: DataFrame, scratch: Scratch) -> tuple[Vocabulary, Network, DataFrame]:
    """Counts of all words, and a network trained on every token of ``docs`` (doc_id, text); (word, n) of all words the vocabulary doesn't know.

    Word counts are summed by a shuffle over all documents. Outputs and inputs grow with the square root of the corpus's
    words, and so do the counts that come to the driver: of KNOWN times as many words as have an own output, and of the
    words in each shared one. Documents are dealt to rounds and parts by a hash of their texts, in an order of it too, so
    that the result doesn't hang on how the table is partitioned. In each round every part trains on all its tokens
    from the shared network, and the parts' networks are averaged by their tokens: summed piece by piece in Spark.
    """
    spark = docs.sparkSession
    counts = scratch.save(map_arrow(docs.select("text"), "word long, n long", _counts).groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    split, width = split_for(total), width_for(total)
    own, groups = split * split - shared(split), shared(split)
    top = counts.orderBy(F.desc("n"), F.asc("word")).limit(KNOWN * own).toArrow()
    hashes, known = (np.array(top.column(x).to_numpy()) for x in ("word", "n"))
    masses = np.zeros(groups)
    if len(hashes) > own:
        unsigned = F.pmod(F.pmod("word", F.lit(groups)) + F.when(F.col("word") < 0, 2**64 % groups).otherwise(0), F.lit(groups))
        for r in counts.filter(_after(int(hashes[own - 1]), int(known[own - 1]))).groupBy(unsigned.alias("k")).agg(F.sum("n").alias("n")).collect():
            masses[r["k"]] = r["n"]
    rest = counts.filter(_after(int(hashes[-1]), int(known[-1])) if len(hashes) else F.lit(False))
    vocabulary = Vocabulary(hashes, known.astype(np.float64), total, distinct, split, masses)
    net = Network(split=split, width=width)
    net.start_from(vocabulary.mass)
    shapes = [x.shape for x in net.arrays()]
    parts, columns = parts_for(total), "piece int, values binary, tokens long"
    place = F.xxhash64("text")
    for r in range(ROUNDS):
        state = spark.sparkContext.broadcast((vocabulary, net.arrays()))
        own = docs.filter(F.pmod(place, F.lit(ROUNDS)) == r).select("text", place.alias("place"), F.pmod(F.shiftright(place, 8), F.lit(parts)).cast("int").alias("part"))
        dealt = map_arrow(own, "part int, place long, outputs binary", _outputs(state)).repartition(parts, "part").sortWithinPartitions("part", "place")
        moved = dealt.mapInArrow(_fit_parts(state, RATE / (1 + r), max(1, total)), f"part int, {columns}")
        # Summed in two steps of about the square root of the parts each.
        some = moved.groupBy("piece", F.pmod("part", F.lit(math.isqrt(parts) + 1))).applyInArrow(_summed, columns)
        pieces = some.groupBy("piece").applyInArrow(_summed, columns).collect()
        if not pieces:
            continue
        share = pieces[0]["tokens"] / total  # of the corpus in this round
        flat = np.concatenate([np.frombuffer(p["values"], "<i8") for p in sorted(pieces, key=lambda p: p["piece"])]) / (share * 2.0**BITS)
        cuts = np.cumsum([math.prod(s) for s in shapes])
        net = Network([x.reshape(s) for x, s in zip(np.split(flat, cuts)[:-1], shapes, strict=True)])
    return vocabulary, net, rest


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, score, mean_score) of every row of ``docs`` (doc_id, text).

    ``score`` sums, over all words of the whole text, the natural log of the word's probability given SIDE words on
    either side, the word itself masked: the network gives each frequent word a probability of its own, and to the
    groups of others, where it is times the word's share of its group in the corpus.
    ``mean_score`` is the score a word. Null texts, and those without words, have 0 tokens, score 0 and a null mean.
    Every row gives one row; null and repeated doc_ids pass through, repeated rows score alike.
    """
    docs = whole_documents(docs)
    scratch = Scratch(docs.sparkSession, "lm")
    *fitted, rest = fit(docs, scratch)
    model = docs.sparkSession.sparkContext.broadcast(tuple(fitted))

    def make(batch: pa.RecordBatch) -> dict:
        vocabulary, net = model.value
        words = Words(batch.column("text"), lower=True)
        h = long(words.hashes())
        inputs, outputs, log_p, known = vocabulary.find(h)
        context = windows(words.row, inputs)
        for a in range(0, len(outputs), SCORED):
            s = slice(a, a + SCORED)
            log_p[s] += net.log_probability(context[s], outputs[s])
        score = np.bincount(words.row, weights=log_p, minlength=batch.num_rows)
        ends = np.concatenate(([0], np.cumsum(np.bincount(words.row[~known], minlength=batch.num_rows))))
        rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[~known]))
        return {"doc_id": batch.column("doc_id"), "n_tokens": words.counts().astype(np.int64), "score": score, "rare": rare}

    scored = map_arrow(docs, "doc_id long, n_tokens long, score double, rare array<long>", make)
    scored = scratch.save(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # Counts the vocabulary lacks: words are rare, so no key is hot. Logarithms are summed as integers, in any order alike.
    logs = rest.select("word", F.round(F.log("n") * (1 << 32)).cast("long").alias("log_n"))
    more = scored.select("row", F.explode("rare").alias("word")).join(logs, "word").groupBy("row").agg((F.sum("log_n") / (1 << 32)).alias("more"))
    out = scored.select("row", "doc_id", "n_tokens", "score").join(more, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    return out.withColumn("mean_score", F.when(F.col("n_tokens") > 0, F.col("score") / F.col("n_tokens")))
