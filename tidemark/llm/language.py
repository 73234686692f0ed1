"""Language of a text: a bidirectional gated recurrent network over bytes labels every position, letters vote."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import numbered, pick, position

#: Hidden units per direction, and bytes per window: the state starts anew in each.
HIDDEN, WINDOW = 8, 96
#: Bound of the training sample: different texts per language, and windows per text.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 400, 8
STEPS, BATCH, RATE, SEED = 400, 64, 0.02, 5
#: Windows that are read at once.
WIDTH = 2048
UNKNOWN = "und"
_BLANK = 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def has_letter(text: bytes) -> bool:
    return bool(re.search(b"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (windows x size) of whole texts, A-Z lower-cased; the text of each window; where it is a letter to count.

    A text is cut every `size` bytes. Its last window is moved back to end with the text, and what it repeats doesn't
    count; a text shorter than a window is followed by blanks. An empty text has no window.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    padded = [t.lower().ljust(size) for t in texts if t]
    data = np.frombuffer(b"".join(padded), np.uint8)
    of = np.flatnonzero(lengths)
    wide = np.maximum(lengths[of], size)
    count = -(-wide // size)
    owner = np.repeat(np.arange(len(of)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.minimum(nth * size, wide[owner] - size)
    x = data[((np.cumsum(wide) - wide)[owner] + begin)[:, None] + np.arange(size)] if len(owner) else np.zeros((0, size), np.uint8)
    new = np.arange(size) >= (nth * size - begin)[:, None]
    return x, of[owner], _LETTER[x] & new


@dataclass
class Network:
    """Input weights by byte (gates x 256) and state weights (gates x hidden) of either direction, output weights.

    Gates are reset, update and candidate; the bias is part of the input weights.
    """

    langs: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(langs: list[str], hidden: int = HIDDEN, seed: int = SEED, kind=np.float32) -> Network:
        rng = np.random.default_rng(seed)
        made = {}
        for side in "fb":
            made["w" + side] = rng.normal(0, 0.3, (3 * hidden, 256))
            made["u" + side] = rng.normal(0, hidden**-0.5, (3 * hidden, hidden))
            made["v" + side] = rng.normal(0, 0.1, (len(langs), hidden))
        made["c"] = np.zeros((len(langs), 1))
        return Network(langs, {k: v.astype(kind) for k, v in made.items()})

    def states(self, x: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """The state after each byte (hidden x size x windows), read from the left (f) or the right (b)."""
        w, u = self.weights["w" + side], self.weights["u" + side]
        hidden, (n, size) = u.shape[1], x.shape
        at = np.ascontiguousarray(x.T).astype(np.intp)
        h = np.zeros((hidden, n), w.dtype)
        out = np.empty((hidden, size, n), w.dtype)
        g, s = np.empty((3 * hidden, n), w.dtype), np.empty((3 * hidden, n), w.dtype)
        half = w.dtype.type(0.5)
        for t in range(size) if side == "f" else range(size - 1, -1, -1):
            np.take(w, at[t], axis=1, out=g, mode="clip")
            np.matmul(u, h, out=s)
            gate = g[: 2 * hidden]
            gate += s[: 2 * hidden]
            gate *= half
            np.tanh(gate, out=gate)
            gate += 1
            gate *= half
            reset, update = gate[:hidden], gate[hidden:]
            new = np.tanh(g[2 * hidden :] + reset * s[2 * hidden :])
            if trace is not None:
                trace.append((t, h, reset.copy(), update.copy(), new, s[2 * hidden :].copy()))
            h = new + update * (h - new)
            out[:, t] = h
        return out

    def labels(self, x: np.ndarray) -> np.ndarray:
        """Probability of each language at each position: languages x size x windows."""
        return self._labels(self.states(x, "f"), self.states(x, "b"))

    def _labels(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        p = self.weights
        z = p["vf"] @ left.reshape(len(left), -1) + p["vb"] @ right.reshape(len(right), -1) + p["c"]
        z -= z.max(0)
        np.exp(z, out=z)
        z /= z.sum(0)
        return z.reshape(-1, *left.shape[1:])

    def gradient(self, x: np.ndarray, y: np.ndarray, counted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the counted positions, and its gradient by backpropagation through time."""
        traces: dict[str, list] = {"f": [], "b": []}
        out = {side: self.states(x, side, traces[side]) for side in "fb"}
        p = self._labels(out["f"], out["b"])
        weight = counted.T / max(counted.sum(), 1)
        hit = np.zeros_like(p)
        hit[y, :, np.arange(len(y))] = 1
        loss = float(-(np.log(np.maximum((p * hit).sum(0), 1e-30)) * weight).sum())
        dz = ((p - hit) * weight).astype(p.dtype)
        grad = {"c": dz.sum((1, 2))[:, None]}
        flat = dz.reshape(len(dz), -1)
        for side in "fb":
            h = out[side]
            hidden = len(h)
            u = self.weights["u" + side]
            grad["v" + side] = flat @ h.reshape(hidden, -1).T
            above = (self.weights["v" + side].T @ flat).reshape(h.shape)
            du, dw = np.zeros_like(u), np.zeros_like(self.weights["w" + side])
            gates, back = np.empty((3 * hidden, *h.shape[1:]), u.dtype), np.zeros((hidden, len(y)), u.dtype)
            for t, before, reset, update, new, part in reversed(traces[side]):
                d = above[:, t] + back
                dn = d * (1 - update) * (1 - new * new)
                ds = np.concatenate([dn * part * reset * (1 - reset), d * (before - new) * update * (1 - update), dn * reset])
                gates[: 2 * hidden, t], gates[2 * hidden :, t] = ds[: 2 * hidden], dn
                du += ds @ before.T
                back = d * update + u.T @ ds
            where = np.ascontiguousarray(x.T).ravel()
            for i, row in enumerate(gates.reshape(3 * hidden, -1)):
                dw[i] = np.bincount(where, weights=row, minlength=256)
            grad["u" + side], grad["w" + side] = du, dw
        return loss, grad


def train(texts: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    """A network fitted by Adam steps; each batch draws languages evenly, then windows of their texts."""
    names = sorted(set(langs))
    net = Network.fresh(names, hidden, seed)
    x, of, counted = windows(texts)
    y = np.array([names.index(lang) for lang in langs], np.int64)[of]
    rows = [np.flatnonzero((y == k) & counted.any(1)) for k in range(len(names))]
    rows = [r for r in rows if len(r)]
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1 if rows else 1):
        chosen = np.array([rng.choice(rows[k]) for k in rng.integers(len(rows), size=BATCH)])
        _, grad = net.gradient(x[chosen], y[chosen], counted[chosen])
        norm = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values()))
        rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-12))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.001 * (g * g - second[k])
            net.weights[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probability of each language over the letters of each whole text; zeros where there is none."""
    sums, letters = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts))
    x, of, counted = windows(texts)
    for i in range(0, len(x), WIDTH):
        part, who, mark = x[i : i + WIDTH], of[i : i + WIDTH], counted[i : i + WIDTH]
        found = np.einsum("ltn,nt->nl", net.labels(part), mark.astype(np.float32))
        np.add.at(sums, who, found)
        np.add.at(letters, who, mark.sum(1))
    return sums / np.maximum(letters, 1)[:, None]


def sample(docs: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """lang, text: of each language the texts with the smallest hashes, so copies count once; at most `texts` each.

    Only rows that aren't held out, with an id, a lang and a letter. The number of a language's texts tells below which
    hash about four times as many lie as are wanted; only those are read again and ranked, whatever its size.
    """
    rows = pick(docs, "doc_id", "text", "lang").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    known = rows.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                       & F.col("text").rlike("\\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = stored(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "languages")
    share = F.least(F.lit(4.0 * texts) / F.greatest("n", F.lit(1)), F.lit(1.0))
    below = sizes.select("lang", (share * 2.0**64 - 2.0**63).cast("long").alias("below"))
    near = known.join(F.broadcast(below) if sizes.count() <= 10_000 else below, "lang").where(F.col("h") <= F.col("below"))
    each = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy("h")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= texts).select("lang", "text")


def fit(docs: DataFrame, texts: int = SAMPLE_TEXTS, steps: int = STEPS) -> Network | None:
    """The network fitted in one task to the bounded sample; None if nothing can be learned from.

    Of a long text at most SAMPLE_WINDOWS windows, spread over it, are trained on.
    """

    def run(batches):
        found = sorted((r["lang"], r["text"].encode()) for b in batches for r in b.to_pylist())
        cut = [(lang, t[a : a + WINDOW]) for lang, t in found
               for a in np.unique(np.linspace(0, max(len(t) - WINDOW, 0), SAMPLE_WINDOWS).astype(int)).tolist()]
        if cut:
            net = train([t for _, t in cut], [lang for lang, _ in cut], steps=steps)
            names = sorted(net.weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array([net.langs]), pa.array([names]),
                 pa.array([[net.weights[k].tobytes() for k in names]], pa.list_(pa.binary()))], ["langs", "names", "weights"])

    got = sample(docs, texts).coalesce(1).mapInArrow(
        run, "langs array<string>, names array<string>, weights array<binary>").first()
    if got is None:
        return None
    shapes = {k: v.shape for k, v in Network.fresh(got["langs"]).weights.items()}
    return Network(got["langs"], {k: np.frombuffer(w, np.float32).reshape(shapes[k]) for k, w in zip(got["names"], got["weights"])})


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """The documents' columns numbered c0, c1, ..., and lang_pred, lang_score (0 to 1); one row per input row.

    The language with the largest mean probability over all letters of the whole text, and that probability. A null
    text, one without a letter, or any text if nothing was learned, is `und` with score 0. Only the text matters;
    scores are given to six digits, as sums in single precision may differ in the seventh between runs.
    """
    held = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size for its languages
    flat, at = numbered(docs), position(docs, "text")

    @F.pandas_udf("lang string, score double")
    def read(texts):
        import pandas as pd

        net, raw = held.value, [t or b"" for t in texts]
        lang, score = [UNKNOWN] * len(raw), [0.0] * len(raw)
        if net is not None:
            p = pooled(net, raw)
            for i, t in enumerate(raw):
                if has_letter(t):
                    k = int(p[i].argmax())
                    lang[i], score[i] = net.langs[k], round(min(float(p[i, k]), 1.0), 6)
        return pd.DataFrame({"lang": lang, "score": score})

    found = flat.withColumn("found", read(F.col(f"c{at}").cast("binary")))
    return found.select(*flat.columns, F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("lang_score"))
