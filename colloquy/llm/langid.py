"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text from both ends, labels every position, and a document's
probabilities are the mean over all its positions. Texts go through it as segments of SEGMENT
positions, each with MARGIN bytes of the text before and after, in which the states of both
layers warm up; where the text ends, states are zero. It is trained in numpy by
backpropagation through time on a bounded sample of segments of whole texts. Gates use
x / (1 + |x|), which numpy computes several times faster than exponentials.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import mix, pick, steps, utf8

HIDDEN = 8
#: Positions that a segment labels, and bytes on each side that only warm states up.
SEGMENT, MARGIN = 256, 16
#: The training sample: stretches of LEARN bytes, this many in all, drawn from all bytes of all labelled texts that may be learned from.
SAMPLE_SEGMENTS, LEARN = 25600, 64
BATCH, ROUNDS, RATE, SEED = 256, 360, 0.02, 11
#: Segments that go through the network together.
TOGETHER = 1024
#: States are multiples of one over this where products have to be exact.
STATE_STEPS = 256
#: What probabilities of a segment are rounded to, when they are summed up.
UNIT = 2.0**-20


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    """Two gated recurrent layers side by side, and a softmax over languages at every position."""

    def __init__(self, n_langs: int, seed: int = SEED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.hidden, self.exact = hidden, False
        self.weights = {}
        for side in "fb":
            self.weights["x" + side] = draw(256, 3 * hidden, scale=0.3)
            self.weights["u" + side] = draw(hidden, 3 * hidden, scale=0.4)
        self.weights["v"] = draw(2 * hidden, n_langs, scale=0.3)
        self.weights["c"] = np.zeros(n_langs, np.float32)

    def rounded(self) -> Network:
        """The network with weights between states, and states from now on, rounded so that all its matrix products are exact.

        States have 8 binary places, weights 8 and 7, and at most 16 products are added, so sums need no more than the
        24 bits of float32, and their order, which BLAS chooses by sizes and places, changes nothing.
        """
        out = Network(len(self.weights["c"]), hidden=self.hidden)
        out.weights, out.exact = dict(self.weights), True
        for name, places in (("uf", 8), ("ub", 8), ("v", 7)):
            out.weights[name] = np.clip(np.rint(self.weights[name] * 2.0**places) / 2.0**places, -15.5, 15.5).astype(np.float32)
        return out

    def layer(self, side: str, bytes_: np.ndarray, keep: bool = False, inside: np.ndarray | None = None):
        """States (time x segment x hidden) for bytes (time x segment); what backpropagation needs if asked.

        States are zero wherever inside (time x segment) is given and false.
        """
        h, n = self.hidden, bytes_.shape[1]
        inputs, u = self.weights["x" + side], self.weights["u" + side]
        state, states, kept = np.zeros((n, h), np.float32), np.empty((*bytes_.shape, h), np.float32), []
        times = range(len(bytes_)) if side == "f" else range(len(bytes_) - 1, -1, -1)
        for t in times:
            p, x = state @ u, inputs[bytes_[t]]
            gates = x[:, : 2 * h] + p[:, : 2 * h]
            gates /= 1 + np.abs(gates)
            gates *= 0.5
            gates += 0.5
            new = gates[:, h:] * p[:, 2 * h :]
            new += x[:, 2 * h :]
            new /= 1 + np.abs(new)
            if keep:
                kept.append((t, state, p[:, 2 * h :], gates, new))
            state = new + gates[:, :h] * (state - new)
            if self.exact:
                state *= STATE_STEPS
                np.rint(state, out=state)
                state /= STATE_STEPS
            if inside is not None:
                state *= inside[t][:, None]
            states[t] = state
        return states, kept

    def probabilities(self, bytes_: np.ndarray, inside: np.ndarray | None = None, margin: int = 0) -> np.ndarray:
        """time x segment x language, without `margin` times at both ends."""
        both = np.concatenate((self.layer("f", bytes_, inside=inside)[0], self.layer("b", bytes_, inside=inside)[0]), axis=2)
        both, bytes_ = both[margin : len(bytes_) - margin], bytes_[margin : len(bytes_) - margin]
        out = both.reshape(-1, 2 * self.hidden) @ self.weights["v"]
        out += self.weights["c"]
        # column by column, as numpy's own reductions of short rows are slow
        most = out[:, 0].copy()
        for k in range(1, out.shape[1]):
            np.maximum(most, out[:, k], out=most)
        out -= most[:, None]
        np.exp(out, out=out)
        total = out[:, 0].copy()
        for k in range(1, out.shape[1]):
            total += out[:, k]
        out /= total[:, None]
        return out.reshape(*bytes_.shape, -1)

    def gradients(self, bytes_: np.ndarray, langs: np.ndarray) -> tuple[dict, float]:
        """Gradients of the mean cross-entropy over all positions, by backpropagation through time."""
        h, size = self.hidden, bytes_.size
        sides = {s: self.layer(s, bytes_, keep=True) for s in "fb"}
        both = np.concatenate((sides["f"][0], sides["b"][0]), axis=2).reshape(-1, 2 * h)
        out = both @ self.weights["v"] + self.weights["c"]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out /= out.sum(axis=1, keepdims=True)
        truth = np.tile(langs, len(bytes_))
        loss = float(-np.log(out[np.arange(size), truth] + 1e-12).mean())
        out[np.arange(size), truth] -= 1
        out /= size
        grads = {"v": both.T @ out, "c": out.sum(axis=0)}
        back = (out @ self.weights["v"].T).reshape(*bytes_.shape, 2 * h)
        for k, side in enumerate("fb"):
            u, gx, gu = self.weights["u" + side], np.zeros_like(self.weights["x" + side]), np.zeros_like(self.weights["u" + side])
            carry = np.zeros((bytes_.shape[1], h), np.float32)
            for t, state, candidate, gates, new in reversed(sides[side][1]):
                d = back[t, :, k * h : (k + 1) * h] + carry
                z, r = gates[:, :h], gates[:, h:]
                d_new = d * (1 - z) * (1 - np.abs(new)) ** 2
                # of 0.5 + 0.5 x / (1 + |x|): the slope is half of (1 - |2 g - 1|) squared
                d_z = d * (state - new) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                d_r = d_new * candidate * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                d_x = np.concatenate((d_z, d_r, d_new), axis=1)
                d_p = np.concatenate((d_z, d_r, d_new * r), axis=1)
                np.add.at(gx, bytes_[t], d_x)
                gu += state.T @ d_p
                carry = d * z + d_p @ u.T
            grads["x" + side], grads["u" + side] = gx, gu
        return grads, loss

    def fit(self, segments: np.ndarray, langs: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, seed: int = SEED) -> float:
        """Adam over seeded batches; gives the last loss."""
        rng, loss = np.random.default_rng(seed), 0.0
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for step in range(1, rounds + 1):
            pick_ = rng.integers(0, len(segments), min(BATCH, len(segments)))
            grads, loss = self.gradients(np.ascontiguousarray(segments[pick_].T), langs[pick_])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * min(1.0, 3 * (rounds - step + 1) / rounds)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.weights[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss


def cut(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole texts as segments: each segment's row, first byte and length."""
    n = -(-(ends - starts) // size)
    row = np.repeat(np.arange(len(starts)), n)
    begin = starts[row] + size * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    return row, begin, np.minimum(ends[row] - begin, size)


def labelled(network: Network, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(rows, lengths, probabilities time x segment x language) of segments in order; times from a segment's length on are void.

    A segment's probabilities don't depend on its neighbours where the network is rounded.
    """
    row, begin, length = cut(starts, ends, SEGMENT)
    time = np.arange(-MARGIN, SEGMENT + MARGIN)[:, None]
    for at in range(0, len(row), TOGETHER):
        part = slice(at, at + TOGETHER)
        index = begin[part] + time
        inside = (index >= starts[row[part]]) & (index < ends[row[part]])
        bytes_ = np.where(inside, data[np.clip(index, 0, len(data) - 1)], 0).astype(np.uint8)
        yield row[part], length[part], network.probabilities(bytes_, inside, MARGIN)


def pooled(network: Network, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mean probabilities over all positions of each row (rows x languages); zeros for an empty row.

    A segment's sum is rounded to a whole number of UNIT, so that sums don't depend on where parts begin.
    """
    total = np.zeros((len(starts), len(network.weights["c"])), np.int64)
    for row, length, p in labelled(network, data, starts, ends):
        p *= (np.arange(SEGMENT)[:, None] < length)[:, :, None]
        sums = np.rint(p.sum(axis=0, dtype=np.float64) / UNIT).astype(np.int64)
        for k in range(sums.shape[1]):
            np.add.at(total[:, k], row, sums[:, k])
    return total * UNIT / np.maximum(ends - starts, 1)[:, None]


def train(rows: list[tuple[bytes | str, str]], langs: list[str]) -> Network:
    """A network from (text, lang) rows."""
    raw = [t.encode() if isinstance(t, str) else t for t, _ in rows]
    sizes = np.array([len(x) for x in raw], np.int64)
    ends = np.cumsum(sizes)
    row, begin, length = cut(ends - sizes, ends, LEARN)
    # Stretches of full length, where there are any of the language, so that none is filled up.
    data = np.r_[np.frombuffer(b"".join(raw), np.uint8), np.zeros(LEARN, np.uint8)]
    inside = np.arange(LEARN) < length[:, None]
    segments = np.where(inside, data[begin[:, None] + np.arange(LEARN)], 0).astype(np.uint8)
    truth = np.array([langs.index(lang) for _, lang in rows])[row]
    full = length == min(LEARN, int(length.max(initial=1)))
    # Each language gets as many segments as the others, by repetition.
    chosen = [np.flatnonzero(full & (truth == k)) for k in range(len(langs))]
    chosen = [c if len(c) else np.flatnonzero(truth == k) for k, c in enumerate(chosen)]
    most = max(len(c) for c in chosen)
    index = np.concatenate([np.resize(c, most) for c in chosen])
    network = Network(len(langs))
    network.fit(segments[index], truth[index])
    return network


def held_out() -> Column:
    """Whether the CRC of the id as text leaves 0 modulo 5; a null id counts as the empty text, so it is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5)) == 0


_DRAWN = pa.schema([("lang", pa.string()), ("order", pa.int64()), ("bytes", pa.binary())])


def _draw(rates: dict):
    """Stretches of LEARN bytes of whole texts, each drawn with its language's rate by a hash of its row and place."""

    def scan(batches):
        for batch in batches:
            data, starts, ends = utf8(batch.column("text"))
            row, begin, length = cut(starts, ends, LEARN)
            seed = np.asarray(batch.column("seed")).astype(np.uint64)
            order = mix(seed[row] + begin.astype(np.uint64) - starts[row].astype(np.uint64))
            langs = batch.column("lang").to_pylist()
            rate = np.array([rates.get(lang, 0.0) for lang in langs])[row]
            take = np.flatnonzero((order >> np.uint64(11)).astype(np.float64) / (1 << 53) < rate)
            out = [data[b : b + n].tobytes() for b, n in zip(begin[take].tolist(), length[take].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([langs[r] for r in row[take]], pa.string()), pa.array(order[take].view(np.int64)), pa.array(out, pa.binary())], schema=_DRAWN)

    return scan


def sample(docs: DataFrame) -> tuple[list[tuple[bytes, str]], list[str]]:
    """Bounded training stretches of every language, and the languages; by hash of id and place, so reruns agree."""
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out())
    sums = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / LEARN)).alias("n")).collect()}
    if not sums:
        return [], []
    each = max(256, SAMPLE_SEGMENTS // len(sums))
    rates = {lang: min(1.0, 1.2 * each / n) for lang, n in sums.items()}
    drawn = rows.select("lang", "text", F.xxhash64("doc_id", F.lit(SEED)).alias("seed")).mapInArrow(_draw(rates), "lang string, order long, bytes binary")
    got = sorted((r["lang"], r["order"], bytes(r["bytes"])) for r in drawn.collect())
    langs, used, out = sorted({r[0] for r in got}), {}, []
    for lang, _, raw in got:
        used[lang] = used.get(lang, 0) + 1
        if used[lang] <= each:
            out.append((raw, lang))
    return out, langs


def _predict(weights: dict, langs: list[str], schema: pa.Schema):
    def scan(batches):
        network = Network(len(langs))
        network.weights = weights
        network = network.rounded()
        for batch in batches:
            data, starts, ends = utf8(batch.column("text"))
            letters = np.asarray(batch.column("letters").fill_null(False))
            ends = np.where(letters, ends, starts)
            for i, j in steps(starts, np.maximum.accumulate(ends) if len(ends) else ends, 1 << 19):
                low = starts[i]
                p = pooled(network, data[low : max(low, ends[i:j].max())], starts[i:j] - low, ends[i:j] - low)
                best = p.argmax(axis=1)
                names = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters[i:j].tolist())]
                scores = np.where(letters[i:j], np.clip(p.max(axis=1), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("held_out").slice(i, j - i), pa.array(names), pa.array(scores)], schema=schema)

    return scan


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each document.

    A null text, or one without a letter, is `und` with score 0; so is every text if no row
    can be learned from. Equal texts get equal predictions; an empty table gives no row;
    other columns are not read. Very long texts are read whole, some segments at a time.
    """
    training, langs = sample(docs)
    rows = pick(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), F.col("text").rlike(r"\p{L}").alias("letters"), "text")
    if not langs:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    network = train(training, langs)
    kind = rows.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
    return rows.mapInArrow(_predict(network.weights, langs, schema), f"doc_id {kind.simpleString()}, held_out boolean, lang_pred string, score double")


def label_positions(text: str, network: Network, langs: list[str]) -> list[tuple[int, int, str]]:
    """Runs of bytes (from, to, lang) with one label each."""
    raw = np.frombuffer(text.encode(), np.uint8)
    labels = [p.argmax(axis=2).T[np.arange(SEGMENT) < length[:, None]] for _, length, p in labelled(network, raw, np.array([0]), np.array([len(raw)]))]
    if not labels:
        return []
    label = np.concatenate(labels)
    edges = np.flatnonzero(np.r_[True, label[1:] != label[:-1], True])
    return [(int(a), int(b), langs[label[a]]) for a, b in zip(edges[:-1], edges[1:])]
