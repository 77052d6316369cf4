"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample: at most PER_LANGUAGE documents
of each language and SAMPLE of all, PIECES pieces of PIECE characters from each. It labels every byte position of a text; the document's
probabilities are the mean over all its positions. Texts are read in blocks of BLOCK bytes, both directions
starting anew in each block, so any length takes memory in proportion to a batch of blocks only. Gates
are clipped linear functions in place of sigmoid and tanh.

Only text and language of the training documents enter the network: those whose crc32(id as text) mod 4 is not 2,
with neither text nor language null. Nulls and ties: a null id is hashed as the empty text. A text that is null, empty or
without a letter is `und` with score 0, and so is every text if there is nothing to train on. Between equal probabilities the first
language by name is taken. Every language is learned; beyond CLASSES of them units and steps grow with their number. Repeated rows are
predicted alike. Extra columns are kept by `identify`; clashing names are kept under `_name`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, require, table

PER_LANGUAGE, PIECES, PIECE, SAMPLE, CLASSES = 300, 3, 160, 19_200, 16
HIDDEN, BLOCK, COLUMNS, STEPS, BATCH, SEED = 8, 256, 4096, 220, 128, 7
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character of category L is in the text; what \\w matches besides letters and digits (such as fractions) is none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


class Direction:
    """One direction's weights. Columns are sequences: every array is (units, sequences), so that gates are contiguous."""

    def __init__(self, rng: np.random.Generator, hidden: int, languages: int):
        self.hidden = hidden
        self.E = (rng.normal(0, 0.3, (3 * hidden, 256))).astype(np.float32)  # input weights and biases by byte
        self.E[:hidden] += 1.0  # gates that keep the state at first
        self.U = (rng.normal(0, 0.4 / np.sqrt(hidden) * 1.5, (3 * hidden, hidden))).astype(np.float32)
        self.V = (rng.normal(0, 0.3, (languages, hidden))).astype(np.float32)

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        k = self.hidden
        a = self.E.take(x, axis=1)
        u = self.U @ h
        g = a[: 2 * k]
        g += u[: 2 * k]
        g *= 0.25
        g += 0.5
        np.clip(g, 0.0, 1.0, out=g)
        z, r = g[:k], g[k:]
        n = a[2 * k :]
        n += r * u[2 * k :]
        np.clip(n, -1.0, 1.0, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, u[2 * k :]


class Network:
    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.sides = (Direction(rng, hidden, len(languages)), Direction(rng, hidden, len(languages)))
        self.bias = np.zeros((len(languages), 1), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [w for s in self.sides for w in (s.E, s.U, s.V)] + [self.bias]

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss (mean over positions) and gradients. x: steps by sequences, of bytes; label: by sequence."""
        steps, n = x.shape
        trace = []
        logits = np.repeat(self.bias[None], steps, 0) + np.zeros((1, 1, n), np.float32)
        for side, order in zip(self.sides, (range(steps), range(steps - 1, -1, -1)), strict=True):
            h, kept = np.zeros((side.hidden, n), np.float32), []
            for t in order:
                new, z, r, c, un = side.step(x[t], h)
                kept.append((t, h, z, r, c, un, new))
                logits[t] += side.V @ new
                h = new
            trace.append(kept)
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        loss = float(-np.log(np.maximum(p[:, label, np.arange(n)], 1e-9)).mean())
        p[:, label, np.arange(n)] -= 1
        p /= steps * n
        out = []
        for side, kept in zip(self.sides, trace, strict=True):
            k = side.hidden
            dU, dV, da = np.zeros_like(side.U), np.zeros_like(side.V), np.zeros((steps, 3 * k, n), np.float32)
            dh = np.zeros((k, n), np.float32)
            for t, h, z, r, c, un, new in reversed(kept):
                dV += p[t] @ new.T
                dh = dh + side.V.T @ p[t]
                dc = dh * (1 - z) * (np.abs(c) < 1)
                da[t, :k] = 0.25 * dh * (h - c) * ((z > 0) & (z < 1))
                da[t, k : 2 * k] = 0.25 * dc * un * ((r > 0) & (r < 1))
                da[t, 2 * k :] = dc
                du = np.concatenate([da[t, : 2 * k], dc * r])
                dU += du @ h.T
                dh = dh * z + side.U.T @ du
            flat = x.ravel()
            dE = np.stack([np.bincount(flat, weights=da[:, i].ravel(), minlength=256) for i in range(3 * k)])
            out += [dE.astype(np.float32), dU, dV]
        return loss, [*out, p.sum((0, 2))[:, None]]

    def train(self, pieces: list[bytes], labels: list[int], steps: int = STEPS, batch: int = BATCH, length: int = 128, rate: float = 0.02) -> None:
        """Adam on random batches, each language as often as any other."""
        rng = np.random.default_rng(SEED)
        by = [[] for _ in self.languages]
        for p, k in zip(pieces, labels, strict=True):
            if p:
                by[k].append(p)
        live = [i for i, own in enumerate(by) if own]
        m = [np.zeros_like(w) for w in self.parameters()]
        v = [np.zeros_like(w) for w in self.parameters()]
        for it in range(1, steps + 1):
            label = rng.choice(live, batch)
            x = np.zeros((batch, length), np.uint8)
            for row, i in enumerate(label):
                p = by[i][rng.integers(len(by[i]))]
                p = (p * (length // len(p) + 2))[rng.integers(len(p)) :][:length] if len(p) < length else p[(s := rng.integers(len(p) - length + 1)) : s + length]
                x[row] = np.frombuffer(p, np.uint8)
            _, grads = self.gradients(np.ascontiguousarray(x.T), label)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            lr = rate * min(1.0, 2.0 * (1 - it / (steps + 1)))
            for w, g, a, b in zip(self.parameters(), grads, m, v, strict=True):
                g = g * scale
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= (lr * (a / (1 - 0.9**it)) / (np.sqrt(b / (1 - 0.99**it)) + 1e-8)).astype(np.float32)

    def block_sums(self, blocks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums over positions of the probabilities, blocks by languages. blocks: blocks by BLOCK bytes, of which sizes count; longest first."""
        x = np.ascontiguousarray(blocks.T)
        n, steps = len(sizes), int(sizes[0]) if len(sizes) else 0
        live = [int(np.searchsorted(-sizes, -t)) for t in range(steps)]  # blocks with more than t bytes
        forward, backward = self.sides
        logits = np.empty((steps, len(self.languages), n), np.float32)
        h = np.zeros((forward.hidden, n), np.float32)
        for t in range(steps):
            h = forward.step(x[t, : live[t]], h[:, : live[t]])[0]
            logits[t, :, : live[t]] = forward.V @ h
        total = np.zeros((len(self.languages), n), np.float64)
        h = np.zeros((backward.hidden, 0), np.float32)
        for t in range(steps - 1, -1, -1):
            if live[t] > h.shape[1]:
                h = np.concatenate([h, np.zeros((backward.hidden, live[t] - h.shape[1]), np.float32)], 1)
            h = backward.step(x[t, : live[t]], h)[0]
            p = logits[t, :, : live[t]]
            p += backward.V @ h
            p += self.bias
            p -= p.max(0)
            np.exp(p, out=p)
            p /= p.sum(0)
            total[:, : live[t]] += p
        return total.T

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over all positions of each text; zeros for an empty one."""
        counts = np.array([len(t) for t in texts], np.int64)
        per = -(-counts // BLOCK)
        owner = np.repeat(np.arange(len(texts)), per)
        padded = b"".join(t.ljust(k * BLOCK, b"\0") for t, k in zip(texts, per.tolist(), strict=True))
        blocks = np.frombuffer(padded, np.uint8).reshape(-1, BLOCK)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        sizes = np.minimum(BLOCK, counts[owner] - nth * BLOCK)
        out = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(-sizes, kind="stable")
        width = max(1, COLUMNS * CLASSES // max(CLASSES, len(self.languages)))  # as many numbers however many languages
        for i in range(0, len(order), width):
            own = order[i : i + width]
            np.add.at(out, owner[own], self.block_sums(blocks[own], sizes[own]))
        return out / np.maximum(counts, 1)[:, None]


def held_out(id_col: str) -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 4 == 2


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """A network trained on a sample of docs; None if no row can be used."""
    require(docs, id_col, text, lang)
    usable = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(id_col) & (F.length(text) > 0))
    # a row is drawn by the hash of its id and text, at a rate that gives somewhat more than `per` rows of its language, and its first row at least
    draw = F.xxhash64(id_col, text, F.lit("sample")) / F.lit(2.0**64) + 0.5
    counts = usable.groupBy(F.col(lang).alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.min(draw).alias("first")).orderBy("lang").collect()  # a row a language
    if not counts:
        return None
    per = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    (rate,) = fresh(usable, "rate")
    rates = docs.sparkSession.createDataFrame([(r.lang, max(r.first, min(1.0, (1.3 * per + 10 * (per < PER_LANGUAGE)) / r.n))) for r in counts], f"`{lang}` string, `{rate}` double")
    at = [F.pmod(F.xxhash64(id_col, F.lit(i)), F.greatest(F.length(text) - PIECE, F.lit(0)) + 1) + 1 for i in range(PIECES)]
    pieces = F.array(*[F.substring(F.col(text), a.cast("int"), F.lit(PIECE)) for a in at])
    usable = usable.join(F.broadcast(rates), lang)
    drawn = usable.where(draw <= F.col(rate)).select(draw.alias("draw"), F.col(lang).alias("lang"), pieces.alias("pieces"))
    w = Window.partitionBy("lang").orderBy("draw", "pieces")
    rows = sorted(drawn.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per).drop("nth").collect())
    languages = sorted(r.lang for r in counts)
    number = {name: i for i, name in enumerate(languages)}
    texts, labels = [], []
    for r in rows:
        texts += [p.encode("utf-8", "surrogatepass") for p in r.pieces]
        labels += [number[r.lang]] * len(r.pieces)
    if not texts:
        return None
    more = max(1.0, len(languages) / CLASSES)
    network = Network(languages, round(HIDDEN * more**0.5))
    network.train(texts, labels, steps=round(STEPS * more))
    return network


def _predict(held: Broadcast, text: Column) -> Column:
    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        network = held.value
        for texts in parts:
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            use = [i for i, t in enumerate(texts) if network is not None and t is not None and has_letter(t)]
            # as many texts at a time as make up a few batches of blocks
            start = 0
            while start < len(use):
                end, size = start, 0
                while end < len(use) and (end == start or size < 4 * COLUMNS * BLOCK):
                    size += len(texts.iloc[use[end]])
                    end += 1
                p = network.probabilities([texts.iloc[i].encode("utf-8", "surrogatepass") for i in use[start:end]])
                for i, row in zip(use[start:end], p, strict=True):
                    best = int(row.argmax())
                    names[i], scores[i] = network.languages[best], min(1.0, float(row[best]))
                start = end
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return predict(text)


def identify(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score."""
    require(docs, text)
    for c in [c for c in docs.columns if c.lower() in ("lang_pred", "score")]:
        docs = docs.withColumnRenamed(c, fresh(docs, "_" + c)[0])
    (got,) = fresh(docs, "got")
    held = docs.sparkSession.sparkContext.broadcast(network)  # some tens of KB
    return docs.withColumn(got, _predict(held, F.col(text))).select(*docs.columns, f"{got}.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
