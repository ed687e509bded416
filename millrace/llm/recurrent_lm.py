"""Language-model scores of whole documents by a gated recurrent network in numpy.

A text is the words between white space, A-Z lower-cased, and one end token. Words are counted over all training documents, and
the counts give three things: the add-one base score, the vocabulary of the network and the distribution of the words outside it.

1. Each task counts the words of its training documents, ``PORTION`` bytes of text at a time; one aggregation adds the tables up.
2. The ``TABLE_WORDS`` most frequent words of at most ``TABLE_WORD_BYTES`` go to every task; that bounds the broadcast. The first
   ``CLASSES * CLASS_WORDS - 2`` of them, the end token and a token for all other words are the outputs of the network.
3. The network is a gated recurrent unit with an input table instead of an embedding, and a class-factored softmax: the classes are
   runs of the frequency order, P(word) = P(class) * P(word | class). Output biases start at the logarithms of the corpus counts.
   It is trained by Adam with backpropagation truncated to windows of ``WINDOW`` tokens, the state being carried from window to
   window. One task makes a starting point from runs of at most ``TRAINING_RUN`` tokens of ``TRAINING_DOCUMENTS`` documents. From there
   each task reads all tokens of all its training documents, laid end to end in ``STREAMS`` streams in which every document
   starts without memory, and the weights of the tasks are averaged by the tokens each has read. The average is taken block by block
   on Spark; one set of weights, under 2 MB, reaches the driver.
   Texts are split and their words looked up once, by Arrow; the pass and the scoring read the tokens that this leaves.
4. Scoring is a map over the tokens. Documents of similar length advance side by side, the state carried to the end, and the outputs of
   some ``WINDOW * STREAMS`` tokens are worked out at a time, so a text of any length is scored whole with the states of a bounded number
   of tokens. A word outside the network's outputs costs the network's probability for "other word" times ``(c + 1) / (tail tokens + tail words + 1)``; hence all probabilities sum to one.
5. Words outside the table leave the map as rows (document, word, times), are joined with the counts by word and summed per document.

Defined cases: a null text counts as empty and has the end token alone; a row without id is a training document; equal ids and
repeated rows are scored one by one and each counts for training; a very long text is scored whole, a very long word is a word like
others, outside the table; ties in frequency go by the bytes of the word; without training documents all counts are
zero and the network keeps its initial weights; the weights depend on how Spark deals documents to tasks; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, text_of

#: Words known to every task, and the longest of them.
TABLE_WORDS, TABLE_WORD_BYTES = 300_000, 64
#: Outputs of the network, hidden units, tokens of a window.
CLASSES, CLASS_WORDS, HIDDEN, WINDOW = 64, 64, 24, 32
#: Bounds on what the starting point of training reads.
TRAINING_DOCUMENTS, TRAINING_RUN = 2_048, 512
#: The pass over all training documents: streams side by side, tokens dealt out at a time, rate, numbers of a block of weights.
STREAMS, DEALT, PASS_RATE, BLOCK = 256, 2_000_000, 0.002, 4_096
EPOCHS, BATCH, RATE, CLIP, SEED = 3, 64, 0.01, 1.0, 11
#: Documents that advance side by side when scored.
GROUP = 2_048
#: Tokens whose output probabilities are worked out at a time, and weights updated at a time, few enough for the caches of a core.
SLICE, UPDATED = 2_048, 32_768
#: Bytes of text whose words are told apart at a time.
PORTION = 16_000_000

END = b""
_END, _OTHER = 0, 1
_PAD = -1e4

Parameters = dict[str, np.ndarray]


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the batches, at most ``PORTION`` bytes of text at a time, or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < batch.num_rows:
            before = int(sizes[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(sizes, before + PORTION, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def words_of(texts: pa.StringArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of all texts, one after the other, and the number of words of each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty part there
    ends = np.cumsum(np.append(0, pc.list_value_length(parts).to_numpy(zero_copy_only=False)))
    counts = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[ends])
    return (words if pc.all(real).as_py() else words.filter(real)).cast(pa.binary()), counts


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id = F.col(id_col).cast("long")
    held_out = F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(7)) == 2, F.lit(False))
    return docs.select(doc_id.alias("doc_id"), held_out.alias("held_out"), text_of(text_col).alias("text"))


# -- counts ---------------------------------------------------------------------------------------


def word_counts(source: DataFrame) -> DataFrame:
    """``word`` and ``n`` over all training documents, the end token as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            words = words_of(batch.column("text"))[0].dictionary_encode()
            times = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            columns = [pa.concat_arrays([words.dictionary, pa.array([END])]), pa.array(np.append(times, batch.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    partial = source.filter("NOT held_out").select("text").mapInArrow(run, "word binary, n bigint")
    return materialise(partial.groupBy("word").agg(F.sum("n").alias("n")))


class Vocabulary:
    """The table of frequent words, in the order of their counts, and the totals of the corpus."""

    def __init__(self, words: list[bytes], counts: list[int], tokens: int, distinct: int):
        self.tokens, self.distinct = tokens, distinct
        self.known = dict(zip(words, range(2, len(words) + 2), strict=True))
        self.counts = np.array([0, 0, *counts], dtype=np.int64)
        self.outputs = min(CLASSES * CLASS_WORDS, len(words) + 2)
        self.logs = np.log10(self.counts + 1.0)

    def with_end(self, count: int) -> Vocabulary:
        self.known[END], self.counts[_END] = _END, count
        self.logs[_END] = math.log10(count + 1)
        inside = int(self.counts[: self.outputs].sum())
        self.tail_tokens = self.tokens - inside
        self.tail_words = self.distinct - int((self.counts[: self.outputs] > 0).sum())
        return self

    def words(self) -> pa.Array:
        """The words of the table; the first is token 2."""
        return pa.array([w for w in self.known if w != END], pa.binary())


def vocabulary(counts: DataFrame) -> Vocabulary:
    tokens, distinct, end = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max(F.when(F.octet_length("word") == 0, F.col("n"))), F.lit(0))
    ).first()
    size = F.octet_length("word")
    table = counts.filter((size > 0) & (size <= TABLE_WORD_BYTES)).orderBy(F.desc("n"), "word").limit(TABLE_WORDS).toArrow()
    return Vocabulary(table.column("word").to_pylist(), table.column("n").to_pylist(), int(tokens), int(distinct)).with_end(int(end))


_ENCODED_SCHEMA = (
    "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, logs double, others bigint, other_logs double, "
    "tail array<struct<word:binary,times:int>>, ids binary"
)


def encoded(source: DataFrame, v: Vocabulary) -> DataFrame:
    """Each document as the network's tokens, what its words in the table give, and its words outside the table."""
    shared = source.sparkSession.sparkContext.broadcast((v.words(), v.logs, v.outputs))
    names = [c.split()[0] for c in _ENCODED_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, logs, outputs = shared.value
        for batch in portions(batches):
            words, counts = words_of(batch.column("text"))
            size, owner = batch.num_rows, np.repeat(np.arange(batch.num_rows), counts)
            tokens = pc.index_in(words, value_set=table).fill_null(_OTHER - 2).to_numpy() + 2
            rare = tokens >= outputs
            outside = np.flatnonzero(tokens == _OTHER)
            known = counts - np.bincount(owner[outside], minlength=size)
            others = np.bincount(owner[rare], minlength=size) + counts - known
            gained = [np.bincount(o, weights=logs[t], minlength=size) for o, t in ((owner, tokens), (owner[rare], tokens[rare]))]
            unknown = words.take(pa.array(outside)).dictionary_encode()
            distinct = max(1, len(unknown.dictionary))
            met, times = np.unique(owner[outside] * distinct + unknown.indices.to_numpy(), return_counts=True)
            holder, code = np.divmod(met, distinct)
            pairs = pa.StructArray.from_arrays([unknown.dictionary.take(pa.array(code)), pa.array(times, pa.int32())], names=["word", "times"])
            tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(holder, np.arange(size + 1)), pa.int32()), pairs)
            ids = np.full(len(tokens) + size, _END, dtype="<u2")
            ids[np.arange(len(tokens)) + owner] = np.where(rare, _OTHER, tokens)
            ends = (2 * np.cumsum(np.append(0, counts + 1))).astype("<i4")
            numbers = (counts + 1, known, gained[0] + logs[_END], others, gained[1].astype(float))  # without tokens bincount has integers
            made = [pa.array(x) for x in numbers]
            made += [tail, pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer(ends), pa.py_buffer(ids)])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), *made], names=names)

    return source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, _ENCODED_SCHEMA)


def _encoded(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """Documents as ``encoded`` returns them, from these or from their texts."""
    return rows if "ids" in rows.columns else encoded(rows, v)


def _documents(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype="<u2") for x in ids]


# -- network --------------------------------------------------------------------------------------


def initial(vocabulary: Vocabulary) -> Parameters:
    rng = np.random.default_rng(SEED)
    size = CLASSES * CLASS_WORDS
    mass = np.zeros(size)
    mass[: vocabulary.outputs] = vocabulary.counts[: vocabulary.outputs] + 1.0
    mass[_OTHER] = vocabulary.tail_tokens + vocabulary.tail_words + 1.0
    with np.errstate(divide="ignore"):
        words = np.where(mass > 0, np.log(mass), _PAD).reshape(CLASSES, CLASS_WORDS)
        classes = mass.reshape(CLASSES, CLASS_WORDS).sum(axis=1)
        classes = np.where(classes > 0, np.log(classes / classes.sum()), _PAD)
    made = {
        "inputs": rng.normal(0, 0.1, (size, 3 * HIDDEN)),
        "gate_bias": np.zeros(3 * HIDDEN),
        "state": rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 3 * HIDDEN)),
        "class_weights": rng.normal(0, 0.05, (HIDDEN, CLASSES)),
        "class_bias": classes,
        "word_weights": rng.normal(0, 0.05, (CLASSES, HIDDEN, CLASS_WORDS)),
        "word_bias": np.maximum(words - words.max(axis=1, keepdims=True), _PAD),
    }
    return {name: value.astype(np.float32) for name, value in made.items()}


def _by_gate(x: np.ndarray) -> np.ndarray:
    """View of the columns of the three gates as three blocks, or the blocks themselves."""
    return x if x.ndim == 3 else x.reshape(len(x), 3, -1).transpose(1, 0, 2)


def _table(p: Parameters) -> np.ndarray:
    """What each token enters into each gate, by gate."""
    return np.ascontiguousarray(_by_gate(p["inputs"] + p["gate_bias"]))


def step(p: Parameters, entered: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step of the recurrent unit; the second value is what its gradient needs."""
    carried, entered = np.matmul(h, _by_gate(p["state"])), _by_gate(entered)
    gates = carried[:2]
    gates += entered[:2]
    gates *= 0.5  # the logistic function by the hyperbolic tangent
    np.tanh(gates, out=gates)
    gates *= 0.5
    gates += 0.5
    keep, reset, inner = carried
    new = reset * inner
    new += entered[2]
    np.tanh(new, out=new)
    following = h - new
    following *= keep
    following += new
    return following, (h, keep, reset, inner, new)


def _softmax(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns the columns of ``x`` into exponentials; their sums, and the logarithm of the share of row ``at`` of each column."""
    x -= x.max(axis=0)
    found = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    found -= np.log(total)
    return total, found


def by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the targets by class, and where each class ends in it."""
    classes = targets // CLASS_WORDS
    return np.argsort(classes.astype(np.uint8), kind="stable"), np.cumsum(np.bincount(classes, minlength=CLASSES))


def _slices(ends: np.ndarray, size: int) -> Iterator[tuple[slice, list[tuple[int, slice]]]]:
    """``SLICE`` positions at a time, and the classes among them with their places in the slice."""
    starts = np.append(0, ends[:-1])
    for begin in range(0, size, SLICE):
        end = min(begin + SLICE, size)
        met = np.flatnonzero((ends > begin) & (starts < end) & (ends > starts))
        yield slice(begin, end), [(int(c), slice(max(int(starts[c]), begin) - begin, min(int(ends[c]), end) - begin)) for c in met]


def _outputs(p: Parameters) -> tuple[np.ndarray, np.ndarray]:
    """Weights of classes and of words with their biases as a last row."""
    return np.vstack([p["class_weights"], p["class_bias"]]), np.concatenate([p["word_weights"], p["word_bias"][:, None]], axis=1)


def log_likelihood(p: Parameters, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithm of each target's probability given the state before it."""
    class_weights, word_weights = _outputs(p)
    order, ends = by_class(targets)
    wanted, found = targets[order], np.empty(len(targets), dtype=states.dtype)
    states = np.hstack([states, np.ones((len(states), 1), dtype=states.dtype)])
    space = np.empty((CLASS_WORDS, min(SLICE, len(targets))), dtype=states.dtype)
    for part, runs in _slices(ends, len(order)):
        some, at = states.take(order[part], axis=0), wanted[part]
        _, classes = _softmax(class_weights.T @ some.T, at // CLASS_WORDS)
        inside = space[:, : len(at)]
        for c, run in runs:
            np.matmul(word_weights[c].T, some[run].T, out=inside[:, run])
        found[order[part]] = classes + _softmax(inside, at % CLASS_WORDS)[1]
    return found


def score_documents(p: Parameters, documents: list[np.ndarray]) -> np.ndarray:
    """Log-likelihood of whole documents, each an array of output ids that ends with the end token."""
    total = np.zeros(len(documents))
    sizes = np.array([len(d) for d in documents], dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    table = _table(p)
    for first in range(0, len(order), GROUP):
        group = order[first : first + GROUP]
        lengths = sizes[group]
        flat = np.concatenate([documents[i] for i in group])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        actives = np.searchsorted(-lengths, -np.arange(int(lengths[0])), side="left").tolist()
        h, before = np.zeros((len(group), HIDDEN), dtype=table.dtype), np.full(len(group), _END)
        states, targets, held = [], [], 0
        for t, active in enumerate(actives):
            h, _ = step(p, table.take(before[:active], axis=1), h[:active])
            before = flat[starts[:active] + t]
            states.append(h)
            targets.append(before)
            held += active
            if held >= WINDOW * STREAMS or t + 1 == len(actives):
                found = log_likelihood(p, np.concatenate(states), np.concatenate(targets))
                owners = np.concatenate([np.arange(len(x)) for x in targets])
                total[group] += np.bincount(owners, weights=found, minlength=len(group))
                states, targets, held = [], [], 0
    return total


def window_gradient(p: Parameters, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray, h: np.ndarray) -> tuple[float, Parameters, np.ndarray]:
    """Loss, gradient and last state of one window; the gradient stops at the window's first state.

    ``inputs``, ``targets`` and ``mask`` are steps by documents; masked targets do not count. An end token as input starts
    a document, which knows nothing of the one before it.
    """
    steps, kept = len(inputs), []
    table, kind = _table(p), p["state"].dtype
    flat = np.ones((*inputs.shape, HIDDEN + 1), dtype=kind)
    begun = [np.flatnonzero(row == _END) for row in inputs]
    for t in range(steps):
        if len(begun[t]):
            h = h.copy()
            h[begun[t]] = 0
        h, memo = step(p, table.take(inputs[t], axis=1), h)
        kept.append(memo)
        flat[t, :, :HIDDEN] = h
    flat = flat.reshape(-1, HIDDEN + 1)
    counted = np.flatnonzero(mask.reshape(-1))
    wanted = targets.reshape(-1)[counted]
    order, ends = by_class(wanted)
    counted, wanted = counted[order], wanted[order]
    scale = kind.type(1 / max(1, len(counted)))
    class_weights, word_weights = _outputs(p)
    d_class, d_word = np.zeros_like(class_weights.T), np.zeros_like(word_weights.transpose(0, 2, 1), order="C")
    d_states, loss = np.zeros((len(flat), HIDDEN), dtype=kind), 0.0
    classes, inside = (np.empty((n, min(SLICE, len(counted))), dtype=kind) for n in (CLASSES, CLASS_WORDS))
    for part, runs in _slices(ends, len(counted)):
        some, at = flat.take(counted[part], axis=0), wanted[part]
        x, y = classes[:, : len(at)], inside[:, : len(at)]
        np.matmul(class_weights.T, some.T, out=x)
        for c, run in runs:
            np.matmul(word_weights[c].T, some[run].T, out=y[:, run])
        for wrong, row in ((x, at // CLASS_WORDS), (y, at % CLASS_WORDS)):
            total, found = _softmax(wrong, row)
            loss -= float(found.sum())
            wrong *= scale / total
            wrong[row, np.arange(len(row))] -= scale
        d_class += x @ some
        pulled = x.T @ p["class_weights"].T
        for c, run in runs:
            d_word[c] += y[:, run] @ some[run]
            pulled[run] += y[:, run].T @ p["word_weights"][c].T
        d_states[counted[part]] = pulled
    d_states = d_states.reshape(steps, -1, HIDDEN)
    d_inputs = np.empty((steps, d_states.shape[1], 3 * HIDDEN), dtype=kind)
    d_state, back = np.zeros((3, HIDDEN, HIDDEN), dtype=kind), np.zeros_like(h)
    returned = np.ascontiguousarray(_by_gate(p["state"]).transpose(0, 2, 1))
    d_gates = np.empty((3, *h.shape), dtype=kind)
    for t in range(steps - 1, -1, -1):
        previous, keep, reset, inner, new = kept[t]
        d_keep, d_reset, d_inner = d_gates
        d, leave = d_states[t], 1 - keep
        d += back
        d_new = new * new
        np.subtract(1, d_new, out=d_new)
        d_new *= leave
        d_new *= d
        np.subtract(previous, new, out=d_keep)
        d_keep *= d
        d_keep *= keep
        d_keep *= leave
        np.multiply(d_new, reset, out=d_inner)
        np.multiply(d_inner, inner, out=d_reset)
        d_reset *= 1 - reset
        d_state += np.matmul(previous.T, d_gates)
        back = d * keep
        for part in np.matmul(d_gates, returned):
            back += part
        back[begun[t]] = 0
        entered = _by_gate(d_inputs[t])
        entered[:2], entered[2] = d_gates[:2], d_new
    d_inputs = d_inputs.reshape(-1, 3 * HIDDEN)
    entered = inputs.reshape(-1).astype(np.uint16)
    order = np.argsort(entered, kind="stable")
    met, firsts = np.unique(entered[order], return_index=True)
    d_table, sums = np.zeros_like(p["inputs"]), np.add.reduceat(d_inputs.take(order, axis=0), firsts, axis=0)
    d_table[met] = sums
    gradient = {
        "inputs": d_table,
        "gate_bias": sums.sum(axis=0),
        "state": d_state.transpose(1, 0, 2).reshape(HIDDEN, -1),
        "class_weights": d_class[:, :HIDDEN].T,
        "class_bias": d_class[:, HIDDEN],
        "word_weights": d_word[:, :, :HIDDEN].transpose(0, 2, 1),
        "word_bias": d_word[:, :, HIDDEN],
    }
    return loss * float(scale), {name: np.ascontiguousarray(g) for name, g in gradient.items()}, h


class Adam:
    """Weights with the moments of their gradients."""

    def __init__(self, p: Parameters):
        self.p = {name: value.copy() for name, value in p.items()}
        self.moments = {name: (np.zeros_like(v), np.zeros_like(v)) for name, v in p.items()}
        self.updates = 0

    def update(self, gradient: Parameters, rate: float) -> None:
        self.updates += 1
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in gradient.values()))
        clip = np.float32(min(1.0, CLIP / max(norm, 1e-12)))
        rate *= math.sqrt(1 - 0.999**self.updates) / (1 - 0.9**self.updates)
        for name, g in gradient.items():
            whole = [x.reshape(-1) for x in (g, *self.moments[name], self.p[name])]
            for begin in range(0, g.size, UPDATED):
                part, first, second, weights = (x[begin : begin + UPDATED] for x in whole)
                part = part * clip
                squared = part * part
                part -= first
                part *= np.float32(0.1)
                first += part
                squared -= second
                squared *= np.float32(0.001)
                second += squared
                np.sqrt(second, out=squared)
                squared += np.float32(1e-8)
                np.divide(first, squared, out=part)
                part *= np.float32(rate)
                weights -= part


def train(p: Parameters, runs: list[np.ndarray]) -> Parameters:
    """Adam over windows of documents that advance side by side. ``runs`` are token ids, each with the token before it in front."""
    learner, rng = Adam(p), np.random.default_rng(SEED)
    runs = sorted((r for r in runs if len(r) > 1), key=len)
    batches = [runs[i : i + BATCH] for i in range(0, len(runs), BATCH)]
    planned = max(1, EPOCHS * sum(-(-(len(b[-1]) - 1) // WINDOW) for b in batches))
    for _ in range(EPOCHS):
        for number in rng.permutation(len(batches)):
            batch = batches[number]
            longest = len(batch[-1])
            tokens, mask = np.zeros((longest, len(batch)), dtype=np.int64), np.zeros((longest, len(batch)), dtype=bool)
            for column, run in enumerate(batch):
                tokens[: len(run), column], mask[: len(run), column] = run, True
            h = np.zeros((len(batch), HIDDEN), dtype=np.float32)
            for begin in range(0, longest - 1, WINDOW):
                end = min(begin + WINDOW, longest - 1)
                _, gradient, h = window_gradient(learner.p, tokens[begin:end], tokens[begin + 1 : end + 1], mask[begin + 1 : end + 1], h)
                learner.update(gradient, RATE * (1 - 0.95 * (learner.updates + 1) / planned))
    return learner.p


def read_whole(learner: Adam, documents: list[np.ndarray]) -> int:
    """Learn once from every token of whole documents, each its words' ids and the end token. Returns the number of tokens."""
    targets = np.concatenate(documents)
    inputs = np.concatenate([[_END], targets[:-1]])  # the end of one document is what the next begins with
    size = len(targets)
    streams = min(STREAMS, -(-size // WINDOW))
    length = -(-size // streams)
    laid = [np.concatenate([x, np.zeros(streams * length - size, dtype=x.dtype)]).reshape(streams, length).T for x in (inputs, targets)]
    mask = (np.arange(streams * length) < size).reshape(streams, length).T
    h = np.zeros((streams, HIDDEN), dtype=np.float32)
    for begin in range(0, length, WINDOW):
        part = slice(begin, begin + WINDOW)
        _, gradient, h = window_gradient(learner.p, laid[0][part], laid[1][part], mask[part], h)
        learner.update(gradient, PASS_RATE)
    return size


def from_vector(p: Parameters, vector: np.ndarray) -> Parameters:
    """Weights of the shapes of ``p`` from all their numbers in one row."""
    ends = np.cumsum([x.size for x in p.values()])
    return {name: part.reshape(p[name].shape) for name, part in zip(p, np.split(vector, ends[:-1]), strict=True)}


# -- over Spark -----------------------------------------------------------------------------------

_PARAMETER_SCHEMA = "name string, shape array<int>, data binary"


def trained(source: DataFrame, v: Vocabulary) -> Parameters:
    """The network after training on all training documents, given as texts or encoded."""
    return averaged(source, v, starting_point(source, v))


def averaged(source: DataFrame, v: Vocabulary, start: Parameters) -> Parameters:
    """Average, by tokens read, of the weights each task has after one pass over all its training documents."""
    shared = source.sparkSession.sparkContext.broadcast(start)
    names = ["block", "tokens", "data"]
    schema = "block int, tokens bigint, data binary"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, documents, held, tokens = Adam(shared.value), [], 0, 0
        for batch in batches:
            for document in _documents(batch.column(0)):
                documents.append(document)
                held += len(document)
                if held >= DEALT:
                    tokens += read_whole(learner, documents)
                    documents, held = [], 0
        if documents:
            tokens += read_whole(learner, documents)
        if tokens:
            vector = np.concatenate([x.reshape(-1) for x in learner.p.values()])
            blocks = [vector[i : i + BLOCK].astype("<f8") * tokens for i in range(0, len(vector), BLOCK)]
            yield rows_of(range(len(blocks)), [tokens] * len(blocks), blocks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, tokens, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sofar = sums.setdefault(block, [0, 0.0])
                sofar[0], sofar[1] = sofar[0] + tokens, sofar[1] + np.frombuffer(data, dtype="<f8")
        if sums:
            yield rows_of(sums, [t for t, _ in sums.values()], [x for _, x in sums.values()])

    def rows_of(blocks, tokens, data) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip((blocks, tokens, [x.tobytes() for x in data]), kinds, strict=True)], names=names)

    learned = materialise(_encoded(source, v).filter("NOT held_out").select("ids").mapInArrow(learn, schema))
    rows = learned.repartition("block").mapInArrow(add, schema).orderBy("block").collect()
    if not rows:
        return start
    vector = np.concatenate([np.frombuffer(r.data, dtype="<f8") / r.tokens for r in rows])
    return from_vector(start, vector.astype(np.float32))


def starting_point(source: DataFrame, v: Vocabulary) -> Parameters:
    """The network after training in one task on runs of a bounded number of training documents."""
    start, rows = initial(v), _encoded(source, v)
    place = F.xxhash64("doc_id")
    chosen = source.filter("NOT held_out AND doc_id IS NOT NULL").select("doc_id").distinct().orderBy(place, "doc_id").limit(TRAINING_DOCUMENTS)

    def to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for place, document in zip(batch.column("place").to_pylist(), _documents(batch.column("ids")), strict=True):
                ids = np.append(np.array([_END], dtype="<u2"), document)
                first = place % max(1, len(ids) - TRAINING_RUN)
                runs.append(ids[first : first + TRAINING_RUN + 1].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(runs, pa.binary())], names=["place", "ids"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((place, ids) for batch in batches for place, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        found = train(start, [np.frombuffer(ids, dtype="<u2").astype(np.int64) for _, ids in rows[:TRAINING_DOCUMENTS]])
        columns = [list(found), [list(x.shape) for x in found.values()], [x.astype("<f4").tobytes() for x in found.values()]]
        kinds = (pa.string(), pa.list_(pa.int32()), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["name", "shape", "data"])

    sample = rows.filter("NOT held_out").join(F.broadcast(chosen), "doc_id", "left_semi").select(place.alias("place"), "ids")
    runs = materialise(sample.mapInArrow(to_runs, "place bigint, ids binary"))
    rows = runs.coalesce(1).mapInArrow(learn, _PARAMETER_SCHEMA).collect()
    return {r.name: np.frombuffer(r.data, dtype="<f4").reshape(r.shape) for r in rows} or start


def scored(rows: DataFrame, p: Parameters) -> DataFrame:
    """Encoded documents with the network's log-likelihood instead of their tokens."""
    shared = rows.sparkSession.sparkContext.broadcast(p)
    schema = rows.drop("tail", "ids").schema.add("network", "double")
    names, kept = schema.names, schema.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            network = score_documents(shared.value, _documents(batch.column("ids")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(network)], names=names)

    return materialise(rows.drop("tail").mapInArrow(run, schema))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), one row per document."""
    source = _source(docs, id_col, text_col)
    counts = word_counts(source)
    v = vocabulary(counts)
    rows = materialise(encoded(source, v))
    network = scored(rows, trained(rows, v))
    logs = F.log10(F.col("n") + F.lit(1.0))
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.times")
    met = tail.join(counts, "word").groupBy("row").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * logs).alias("tail_logs"))
    joined = network.join(met, "row", "left").withColumns(
        {"tail_known": F.coalesce("tail_known", F.lit(0)), "tail_logs": F.coalesce("tail_logs", F.lit(0.0))}
    )
    end_known = F.lit(1 if v.counts[_END] else 0)
    base = F.col("logs") + F.col("tail_logs") - F.col("n_tokens") * F.lit(math.log10(v.tokens + v.distinct + 1))
    other = F.col("other_logs") + F.col("tail_logs") - F.col("others") * F.lit(math.log10(v.tail_tokens + v.tail_words + 1))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.col("tail_known") + end_known).cast("long").alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        base.cast("double").alias("base_score"),
        (F.col("network") / F.lit(math.log(10)) + other).cast("double").alias("score"),
    )
