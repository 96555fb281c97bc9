"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are cut into windows of ``WINDOW`` bytes. In each, a gated recurrent layer
reads forwards and another backwards; from both states the network labels every position, and
a document's probabilities are the mean over all its positions (whole texts, every byte). Gates
and states use x / (1 + |x|) in place of the sigmoid and tanh (same shape, a third of the cost).

Training is backpropagation through time on a bounded sample: at most ``SAMPLE_ROWS`` labelled
documents per language (smallest hash of doc_id), ``SAMPLE_BYTES`` bytes of each, from a place
that depends on the document. The fit uses text and lang only. Scoring is one pass over the
documents; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import columns

WINDOW = 64
HIDDEN = 6
SAMPLE_ROWS = 256
SAMPLE_BYTES = 512
STEPS = 260
BATCH = 256
RATE = 0.02
SAMPLE_TOTAL = 65_536  # rows of all languages together; every language has one at least
UNITS_PER_LANGUAGE = 1.5
BLOCK = 4096  # windows scored at a time
UNKNOWN = "und"


class ByteTagger:
    """The network. Per direction: ``table`` (3h, 256) holds each byte's input to the update
    gate, the reset gate and the candidate, ``turn`` (3h, h) the state's; ``out`` (classes, h)
    maps the state to the labels' scores. Arrays are float32, one column per window."""

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        self.p = {}
        for d in "fb":
            self.p["table" + d] = rng.normal(0, 0.5, (3 * hidden, 256)).astype("f4")
            self.p["turn" + d] = rng.normal(0, 0.5 / np.sqrt(hidden), (3 * hidden, hidden)).astype("f4")
            self.p["out" + d] = rng.normal(0, 0.5, (len(classes), hidden)).astype("f4")
        self.p["bias"] = np.zeros((len(classes), 1), "f4")

    def states(self, x: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """States after every byte of ``x`` (steps, windows), in the order of the text."""
        h, table, turn = self.hidden, self.p["table" + d], self.p["turn" + d]
        state = np.zeros((h, x.shape[1]), "f4")
        out = np.empty((len(x), h, x.shape[1]), "f4")
        gathered, size = np.empty((3 * h, x.shape[1]), "f4"), np.empty((2 * h, x.shape[1]), "f4")
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            np.take(table, x[t], axis=1, out=gathered, mode="clip")
            g = turn @ state
            gates = gathered[:2 * h] + g[:2 * h]
            np.abs(gates, out=size)
            size += 1
            gates /= size
            z, r = gates[:h], gates[h:]
            r += 1
            n = r * g[2 * h:]
            n += gathered[2 * h:]
            n /= np.abs(n) + 1
            new = out[t]
            np.subtract(state, n, out=new)
            new *= z
            new += n
            new += state
            new *= 0.5
            if trace is not None:
                trace.append((t, state, z, r, n, g[2 * h:]))
            state = new
        return out

    def label(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        """Class probabilities (classes, windows) at one position."""
        s = self.p["outf"] @ forward
        s += self.p["outb"] @ backward
        s += self.p["bias"]
        s -= s.max(axis=0)
        np.exp(s, out=s)
        s /= s.sum(axis=0)
        return s

    def probabilities(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Per window the class probabilities summed over its first ``length`` positions."""
        f, b = self.states(x, "f"), self.states(x, "b")
        total = np.zeros((len(self.classes), x.shape[1]), np.float64)
        shortest = int(length.min())
        for t in range(len(x)):
            p = self.label(f[t], b[t])
            total += p if t < shortest else p * (t < length)
        return total

    def gradients(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all valid positions, and its gradients (through time)."""
        h, grad = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        traces = {"f": [], "b": []}
        s = {d: self.states(x, d, traces[d]) for d in "fb"}
        up = {d: np.zeros_like(s[d]) for d in "fb"}
        loss, weight = 0.0, np.float32(1 / length.sum())
        columns_ = np.arange(x.shape[1])
        for t in range(len(x)):
            p = self.label(s["f"][t], s["b"][t])
            valid = (t < length).astype("f4") * weight
            loss -= float(np.sum(np.log(p[y, columns_] + 1e-9) * valid))
            p[y, columns_] -= 1
            p *= valid
            for d in "fb":
                grad["out" + d] += p @ s[d][t].T
                up[d][t] = self.p["out" + d].T @ p
            grad["bias"] += p.sum(axis=1, keepdims=True)
        for d in "fb":
            turn, carry = self.p["turn" + d], np.zeros((h, x.shape[1]), "f4")
            byte_grad = np.zeros((3 * h, len(x), x.shape[1]), "f4")
            for t, state, z, r, n, gn in reversed(traces[d]):
                e = 0.5 * (up[d][t] + carry)
                dn = e * (1 - z) * np.square(1 - np.abs(n))
                dz = e * (state - n) * np.square(1 - np.abs(z))
                dr = dn * gn * np.square(1 - np.abs(r - 1))
                dg = np.concatenate([dz, dr, dn * r])
                grad["turn" + d] += dg @ state.T
                carry = e * (1 + z) + turn.T @ dg
                byte_grad[:, t] = np.concatenate([dz, dr, dn])
            flat = x.ravel()
            for i in range(3 * h):
                grad["table" + d][i] = np.bincount(flat, byte_grad[i].ravel(), 256)
        return loss, grad

    def fit(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, steps: int = STEPS) -> None:
        """Adam over batches drawn evenly from the classes; deterministic."""
        rng = np.random.default_rng(11)
        by_class = [np.flatnonzero(y == c) for c in range(len(self.classes))]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(c, max(1, BATCH // len(by_class))) for c in by_class])
            _, grad = self.gradients(x[:, pick], length[pick], y[pick])
            rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
            norm = np.sqrt(sum(float(np.sum(g * g)) for g in grad.values()))
            for k, g in grad.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-6)


def windows_of(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(buffer, start, length)`` of the windows of all texts, and none of an empty text."""
    sizes = np.array([len(d) for d in data], np.int64)
    n = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(data)), n)
    local = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    start = np.repeat(np.cumsum(sizes) - sizes, n) + local
    length = np.minimum(WINDOW, sizes[owner] - local)
    buffer = np.frombuffer(b"".join(data) + bytes(WINDOW), np.uint8)
    return buffer, np.stack([owner, start]), length


def gather(buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Windows as (steps, windows) of byte numbers; past its length a window reads zero."""
    step = np.arange(WINDOW)[:, None]
    return np.where(step < length, buffer[start + step], 0).astype(np.intp)


def predict(model: ByteTagger, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and mean probability of each text (null or empty: ``und``, 0)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    buffer, (owner, start), length = windows_of(data)
    total = np.zeros((len(model.classes), len(data)))
    for at in range(0, len(start), BLOCK):
        cut = slice(at, at + BLOCK)
        p = model.probabilities(gather(buffer, start[cut], length[cut]), length[cut])
        for c in range(len(model.classes)):
            total[c] += np.bincount(owner[cut], p[c], len(data))
    size = np.array([len(d) for d in data])
    mean = total / np.maximum(size, 1)
    best = mean.argmax(axis=0) if len(model.classes) else np.zeros(len(data), int)
    return ([model.classes[b] if n else UNKNOWN for b, n in zip(best, size)],
            np.clip(np.where(size > 0, mean.max(axis=0), 0.0), 0.0, 1.0))


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``(lang, piece)``: up to ``rows`` labelled documents per language, not held out, each with
    a piece of ``SAMPLE_BYTES`` characters at a place that depends on the document. Of very many languages each has
    its share of ``SAMPLE_TOTAL`` rows, one at least; none is left out.

    Rows are thinned by hash to a few times the wanted number before the exact choice, so that
    no task receives a whole language.
    """
    d = columns(docs, doc_id="long", text="string", lang="string").where(
        "lang is not null and text is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    d = d.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    size = d.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(SAMPLE_TOTAL) / size.agg(F.count("*")).scalar())))
    thin = (d.join(size, "lang").withColumn("share", share)
            .where(F.pmod("h", F.lit(1 << 20)) * F.col("n") < F.greatest(4 * F.col("share"), F.lit(64)) * (1 << 20))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
            .where(F.col("rank") <= F.col("share")))
    place = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - SAMPLE_BYTES, F.lit(0)) + 1) + 1
    return thin.select("lang", F.substring("text", place.cast("int"), F.lit(SAMPLE_BYTES)).alias("piece"))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> ByteTagger:
    """The network fitted on ``training_sample`` (bounded by its parameters)."""
    sample = training_sample(docs, rows).orderBy("lang", "piece").toPandas()
    classes = sorted(sample["lang"].unique())
    width = max(HIDDEN, int(UNITS_PER_LANGUAGE * len(classes)))
    model = ByteTagger(classes, width)
    data = [p.encode("utf-8", "surrogatepass") for p in sample["piece"]]
    buffer, (owner, start), length = windows_of(data)
    if len(start):
        code = {c: i for i, c in enumerate(classes)}
        y = np.array([code[x] for x in sample["lang"]])[owner]
        present = sorted(set(y.tolist()))
        if len(present) < len(classes):  # a language with empty texts only is not learnt
            model = ByteTagger([classes[c] for c in present], width)
            y = np.searchsorted(present, y)
        model.fit(gather(buffer, start, length), length, y)
    else:
        model = ByteTagger([])
    return model


def identify(docs: DataFrame, model: ByteTagger) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    ``und`` with score 0 for a null text, a text without a letter, and if the model has learnt
    no language. Equal probabilities: the first language in alphabetical order. Repeated rows
    are judged alike; without a doc_id nothing is held out; an empty table gives an empty
    result; extra columns are ignored.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known = f["text"].tolist() if model.classes else [None] * len(f)
            lang, score = predict(model, known) if model.classes else ([UNKNOWN] * len(f), np.zeros(len(f)))
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "lang_pred": lang, "score": score})

    d = columns(docs, doc_id="long", text="string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return d.select("doc_id", held.alias("held_out"), F.when(d["text"].rlike(r"\p{L}"), d["text"]).alias("text")
                    ).mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
