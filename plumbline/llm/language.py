"""Language identification: a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import bytes_of, sent, slices

HIDDEN = 8
#: Bytes of a segment; each is labelled from both of its ends.
SEGMENT = 64
#: Bounded fitting sample: documents with the smallest key digests, and bytes of each.
SAMPLE_DOCS = 6000
SAMPLE_BYTES = 256
ROUNDS = 500
BATCH = 256
#: Bytes labelled at a time.
CHUNK = 1 << 18
UNKNOWN = "und"

OUT_SCHEMA = "key bigint, lang_pred string, score double"


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


class Network:
    """Weights: byte tables and recurrent matrices of both directions, and the labeller.

    Rows of a direction's arrays: update gate, reset gate, candidate. States lie as
    (hidden, segments), so every operation runs along the segments.
    """

    def __init__(self, classes: list[str], seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (rng.standard_normal((3 * hidden, 257)) * 0.3).astype(np.float32)
            self.w[f"h{d}"] = (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.w["o"] = (rng.standard_normal((len(classes), 2 * hidden)) * 0.3).astype(np.float32)
        self.w["c"] = np.zeros((len(classes), 1), np.float32)

    def _pass(self, d: str, codes: np.ndarray, keep: bool):
        """States (time, hidden, segments) of one direction; ``codes``: (time, segments)."""
        n, wx, wh = self.hidden, self.w[f"x{d}"], self.w[f"h{d}"]
        steps, lanes = codes.shape
        states = np.empty((steps, n, lanes), np.float32)
        h, kept = np.zeros((n, lanes), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x = wx.take(codes[t], axis=1)
            gates = wh[:2 * n] @ h
            gates += x[:2 * n]
            _gate(gates)
            z, r = gates[:n], gates[n:]
            rh = r * h
            g = wh[2 * n:] @ rh
            g += x[2 * n:]
            np.tanh(g, out=g)
            if keep:
                kept.append((t, h, z, r, rh, g))
            new = h - g
            new *= z
            new += g
            h = states[t] = new
        return states, kept

    def label(self, codes: np.ndarray, keep: bool = False):
        """Class probabilities (time, class, segments) of every position."""
        f, kf = self._pass("f", codes, keep)
        b, kb = self._pass("b", codes, keep)
        n = self.hidden
        out = self.w["o"][:, :n] @ f
        out += self.w["o"][:, n:] @ b
        out += self.w["c"]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return (out, f, b, kf, kb) if keep else out

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients by backpropagation through time; code 256 pads and is not labelled."""
        p, f, b, kf, kb = self.label(codes, True)
        real = (codes < 256)[:, None, :]
        n, total = self.hidden, max(1, int(real.sum()))
        lanes = np.arange(codes.shape[1])
        loss = -float((np.log(p[:, target, lanes] + 1e-9) * real[:, 0]).sum()) / total
        p[:, target, lanes] -= 1
        p *= real / np.float32(total)
        grad = {"o": np.concatenate([np.einsum("tcl,thl->ch", p, s) for s in (f, b)], axis=1), "c": p.sum(axis=(0, 2))[:, None]}
        for d, kept, part in (("f", kf, slice(0, n)), ("b", kb, slice(n, 2 * n))):
            wh = self.w[f"h{d}"]
            gx, gh = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(wh)
            back = np.zeros((n, codes.shape[1]), np.float32)
            out = self.w["o"][:, part].T
            for t, h, z, r, rh, g in reversed(kept):
                dh = out @ p[t] + back
                dg = dh * (1 - z) * (1 - g * g)
                dz = dh * (h - g) * 0.25 * ((z > 0) & (z < 1))
                drh = wh[2 * n:].T @ dg
                dr = drh * h * 0.25 * ((r > 0) & (r < 1))
                da = np.concatenate([dz, dr, dg])
                gh[:2 * n] += da[:2 * n] @ h.T
                gh[2 * n:] += dg @ rh.T
                back = dh * z + drh * r + wh[:2 * n].T @ da[:2 * n]
                for k in range(3 * n):
                    gx[k] += np.bincount(codes[t], da[k], 257)
            grad[f"x{d}"], grad[f"h{d}"] = gx, gh
        return loss, grad


def segments(data: np.ndarray, offsets: np.ndarray, length: int = SEGMENT) -> tuple[np.ndarray, np.ndarray]:
    """Codes (time, segments), 256 past a document's end, and each segment's document."""
    sizes = np.diff(offsets)
    counts = -(-sizes // length)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + first * length
    at = start + np.arange(length)[:, None]
    real = at < offsets[row + 1]
    codes = np.full(at.shape, 256, np.intp)
    codes[real] = data[at[real]]
    return codes, row


def train(texts: list[bytes], labels: list[str], seed: int = 7, rounds: int = ROUNDS) -> Network:
    """Fit by Adam on batches of segments, drawn evenly from the classes; reruns agree."""
    classes = sorted(set(labels))
    net = Network(classes, seed)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    codes, row = segments(np.frombuffer(b"".join(texts), np.uint8), offsets)
    target = np.searchsorted(classes, labels)[row] if len(row) else np.zeros(0, np.int64)
    pools = [np.nonzero(target == c)[0] for c in range(len(classes))]
    if len(classes) < 2 or not all(len(p) for p in pools):
        return net
    rng = np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.w.items()}
    square = {k: np.zeros_like(v) for k, v in net.w.items()}
    for step in range(1, rounds + 1):
        chosen = np.concatenate([rng.choice(p, max(1, BATCH // len(pools))) for p in pools])
        _, grad = net.gradients(codes[:, chosen], target[chosen])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * (1 - 0.9 * step / rounds)
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            net.w[k] -= (rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return net


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES, rounds: int = ROUNDS) -> Network:
    """Train on ``labelled`` (text, lang; others are ignored). At most ``sample_docs`` rows
    of it, those with the smallest text digests, and ``sample_bytes`` bytes of each (from a
    place given by the digest) reach the driver. Rows without text or lang teach nothing."""
    digest = F.xxhash64("text", "lang")
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL").where(has_letter(F.col("text")))
    raw = F.col("text").cast("binary")
    room = F.greatest(F.length(raw) - sample_bytes, F.lit(0)) + 1
    part = F.substring(raw, (F.pmod(digest, room) + 1).cast("int"), F.lit(sample_bytes))
    # two in expectation for each row wanted, so that tasks send a bounded number in all
    share = min(1.0, 2 * sample_docs / max(1, labelled.where("lang IS NOT NULL").count()))
    usable = usable.where(F.pmod(digest, F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = (usable.select(digest.alias("digest"), part.alias("part"), "lang").orderBy("digest", "lang", "part").limit(sample_docs)).collect()
    return train([bytes(r.part) for r in rows], [r.lang for r in rows], rounds=rounds)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def labelled(docs: DataFrame, net: Network) -> DataFrame:
    """row (a struct of all columns of ``docs``), lang_pred and score of every row.

    Every position of the whole text is labelled, the probabilities are averaged over the
    document, and the likeliest language wins. Without a letter (so for null and empty
    texts), or if the network knows no language, lang_pred is ``und`` and score 0. Equal
    probabilities go to the first language in order. Repeated rows and null ids are
    labelled like others; an empty table gives no rows.
    """
    get_net = sent(docs.sparkSession, net)
    ready = docs.select(F.struct("*").alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"),
                        has_letter(F.col("text")).alias("letter"))
    schema = ready.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = get_net()
        classes = len(model.classes)
        for batch in slices(batches, "bytes", CHUNK):
            data, offsets = bytes_of(batch.column("bytes"))
            total = np.zeros((batch.num_rows, max(classes, 1)))
            codes, row = segments(data, offsets)
            for at in range(0, len(row) if classes else 0, CHUNK // SEGMENT):
                part = codes[:, at:at + CHUNK // SEGMENT]
                p = model.label(part) * (part < 256)[:, None, :]
                sums = p.sum(axis=0)
                for c in range(classes):
                    total[:, c] += np.bincount(row[at:at + CHUNK // SEGMENT], sums[c], batch.num_rows)
            known = np.array(batch.column("letter").to_pylist(), bool) & (classes > 0)
            mean = total / np.maximum(np.diff(offsets), 1)[:, None]
            said = [model.classes[b] if k else UNKNOWN for b, k in zip(mean.argmax(axis=1), known)]
            score = np.where(known, mean.max(axis=1), 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(said, pa.string()), pa.array(score, pa.float64())],
                                             ["row", "lang_pred", "score"])

    return ready.mapInArrow(run, schema)


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with lang_pred and score, which replace columns of those names."""
    return labelled(docs.drop("lang_pred", "score"), net).select("row.*", "lang_pred", "score")
