"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text's bytes both ways, separators included, in windows that overlap by
``WARM`` bytes a side, so that states are warm where they count and run on across words. It
labels every position; a document's probabilities are the mean over all positions of its
text. Training is numpy: backpropagation through time on a bounded sample of windows from
labelled rows of any length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCHES, Apart, Workspace, blocks, bounded_batches, lean

UNDETERMINED = "und"
CORE, WARM = 96, 16  # positions that a window labels, and bytes before and after that it only reads
BATCH = 2048  # windows of one run
LESSON = 64  # characters of a training window


class ByteGRU:
    """Both directions at once: arrays lead with an axis of 2, forward and backward.

    x: byte inputs of the three gates (256, 3H); u: recurrent weights (H, 3H); w, b: from
    both states to the labels. Gates are z (keep), r (reset) and the candidate.
    """

    def __init__(self, labels: int, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(np.float32),
            "w": rng.normal(0, 0.3, (2 * hidden, labels)).astype(np.float32),
            "b": np.zeros(labels, np.float32),
        }

    def forward(self, bytes_: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Label probabilities (rows, positions, labels) of rows of bytes, padded on the
        right; the backward direction reads each row from its own end."""
        n, t = bytes_.shape
        h, H = np.zeros((2, n, self.hidden), self.p["u"].dtype), self.hidden
        at = np.arange(t)
        back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)  # its own inverse
        both = np.stack([bytes_, np.take_along_axis(bytes_, back, 1)])
        columns = np.ascontiguousarray(both.transpose(2, 0, 1)) + np.array([0, 256], np.int64)[:, None]
        table = self.p["x"].reshape(512, 3 * H)
        states, tape = np.empty((2, t, n, H), h.dtype), []
        for i in range(t):
            g, a = table.take(columns[i], 0), h @ self.p["u"]
            zr = g[..., : 2 * H] + a[..., : 2 * H]
            np.negative(zr, zr), np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            c = np.tanh(g[..., 2 * H :] + zr[..., H:] * a[..., 2 * H :])
            if keep:
                tape.append((h, zr[..., :H], zr[..., H:], c, a[..., 2 * H :]))
            h = states[:, i] = c + zr[..., :H] * (h - c)
        states = states.transpose(0, 2, 1, 3)
        s = np.concatenate([states[0], np.take_along_axis(states[1], back[..., None], 1)], 2)
        e = s @ self.p["w"] + self.p["b"]
        e = np.exp(e - e.max(2, keepdims=True))
        e /= e.sum(2, keepdims=True)
        return (e, s, both, back, tape) if keep else e

    def gradients(self, bytes_: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions, and its gradients through time."""
        e, s, both, back, tape = self.forward(bytes_, lengths, keep=True)
        n, t, H = *bytes_.shape, self.hidden
        real = np.arange(t) < lengths[:, None]
        size = real.sum()
        loss = -np.log(np.maximum(e[np.arange(n)[:, None], np.arange(t), label[:, None]], 1e-9))[real].mean()
        d = e.copy()
        d[np.arange(n)[:, None], np.arange(t), label[:, None]] -= 1
        d = np.where(real[..., None], d, 0) / size
        g = {"w": np.tensordot(s, d, ((0, 1), (0, 1))), "b": d.sum((0, 1)), "x": np.zeros_like(self.p["x"]), "u": np.zeros_like(self.p["u"])}
        ds = d @ self.p["w"].T
        ds = np.stack([ds[..., :H], np.take_along_axis(ds[..., H:], back[..., None], 1)])
        dh, steps = np.zeros((2, n, H), d.dtype), np.empty((2, t, n, 3 * H), d.dtype)
        for i in reversed(range(t)):
            h, z, r, c, m = tape[i]
            dh = dh + ds[:, :, i]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * m * r * (1 - r)
            da = np.concatenate([dz, dr, dc * r], 2)
            g["u"] += np.swapaxes(h, 1, 2) @ da
            steps[:, i, :, : 2 * H], steps[:, i, :, 2 * H :] = da[..., : 2 * H], dc
            dh = dh * z + da @ np.swapaxes(self.p["u"], 1, 2)
        for k in (0, 1):
            byte, dg = both[k].T.ravel(), steps[k].reshape(-1, 3 * H)
            for j in range(3 * H):
                g["x"][k][:, j] = np.bincount(byte, dg[:, j], minlength=256)
        return float(loss), g

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int = 350, batch: int = 192, rate: float = 0.02, seed: int = 5) -> ByteGRU:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(words), batch)
            _, g = self.gradients(*padded([words[i] for i in pick]), labels[pick])
            scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((x * x).sum()) for x in g.values()))))
            lr = rate * (1 - step / (steps + 1))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * scale * g[k]
                v[k] = 0.99 * v[k] + 0.01 * (scale * g[k]) ** 2
                self.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self

    def pooled(self, rows: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """``forward`` summed over the positions that count, without its states: the backward
        direction reads the padding first and begins anew after it."""
        n, t = rows.shape
        H, w, table = self.hidden, self.p["w"], self.p["x"].reshape(512, -1)
        forth = np.ascontiguousarray(rows.T).astype(np.intp)
        columns = np.stack([forth, forth[::-1] + 256], 1)
        late = (t - lengths)[None, :] > np.arange(t)[:, None] if lengths.min() < t else None  # still in the padding
        h, score = np.zeros((2, n, H), np.float32), np.empty((t, n, w.shape[1]), np.float32)
        score[:] = self.p["b"]
        for i in range(t):
            g, a = table.take(columns[i], 0), h @ self.p["u"]
            zr = g[..., : 2 * H] + a[..., : 2 * H]
            np.negative(zr, zr), np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            c = a[..., 2 * H :]
            c *= zr[..., H:]
            c += g[..., 2 * H :]
            np.tanh(c, c)
            h -= c
            h *= zr[..., :H]
            h += c
            if late is not None:
                h[1][late[i]] = 0
            score[i] += h[0] @ w[:H]
            score[t - 1 - i] += h[1] @ w[H:]
        score -= score.max(2, keepdims=True)
        np.exp(score, score)
        score /= score.sum(2, keepdims=True)
        return np.einsum("tnl,nt->nl", score, counts.astype(np.float32))

    def sums(self, texts: list[bytes]) -> np.ndarray:
        """For each text the sum of its positions' probabilities, and their number."""
        out = np.zeros((len(texts), len(self.p["b"]) + 1), np.float64)
        for lo, hi in blocks(texts, 2 * BATCH * CORE):
            of, first, parts = [], [], []
            for i in range(lo, hi):
                for k in range(0, len(texts[i]), CORE):
                    of.append(i), first.append(min(k, WARM)), parts.append(texts[i][max(0, k - WARM) : k + CORE + WARM])
            order = sorted(range(len(parts)), key=lambda j: len(parts[j]))  # noqa: B023
            for k in range(0, len(order), BATCH):
                now = order[k : k + BATCH]
                rows, lengths = padded([parts[j] for j in now])
                begin = np.array([first[j] for j in now])[:, None]
                at = np.arange(rows.shape[1])
                counts = (at >= begin) & (at < begin + CORE) & (at < lengths[:, None])
                np.add.at(out, [of[j] for j in now], np.column_stack([self.pooled(rows, lengths, counts), counts.sum(1)]))
        return out


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(lengths.max())), np.uint8)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    return out, lengths


def held_out(doc_id):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, per_language: int, windows: int, seed: int) -> list:
    """(lang, doc_id, windows) of at most ``per_language`` documents a language, the first by
    hash: of each at most ``windows`` windows of its whole text, at places by hash."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 0))
    chance = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rows = rows.select("lang", "text", "doc_id", chance.alias("chance"))
    size = F.length("text")
    place = lambda k: F.pmod(F.xxhash64(F.lit(seed), "doc_id", k), F.greatest(size - LESSON, F.lit(0)) + 1).cast("int") + 1
    some = F.transform(F.sequence(F.lit(1), F.least(F.lit(windows), F.ceil(size / LESSON).cast("int"))), lambda k: F.substring("text", place(k), F.lit(LESSON)))
    with Workspace(docs.sparkSession, "languages") as ws:
        counts = ws.table(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "counts")  # one row a language
        few = rows.join(F.broadcast(counts.withColumnRenamed("lang", "l")), F.col("lang") == F.col("l")).where(F.col("chance") * F.col("n") < 2 * per_language + 50)
        few = few.select("lang", "doc_id", "chance", some.alias("windows"))
        first = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("chance", "doc_id", "windows")))
        return first.where(F.col("k") <= per_language).orderBy("lang", "k").select("lang", "doc_id", "windows").collect()


class Languages:
    """Names, the network, and of each language the least score that its own text has."""

    def __init__(self, names: list[str], model: ByteGRU | None = None, least: np.ndarray | None = None):
        self.names, self.model, self.least = names, model, np.zeros(len(names)) if least is None else least


def train_languages(docs: DataFrame, per_language: int = 300, windows: int = 40, hidden: int = 8, steps: int = 400, seed: int = 5) -> Languages:
    """Learns from at most ``windows`` windows of at most ``per_language`` documents of each
    lang value, none of them held out. Without labelled text there is no model.

    ``least``: the score above which all but one in a thousand windows of the language's own
    labelled text are, where it is what they are taken for."""
    by: dict[str, list[bytes]] = {}
    for r in training_windows(docs, per_language, windows, seed):
        by.setdefault(r["lang"], []).extend(w.lower().encode() for w in r["windows"] if w)
    names = sorted(k for k, v in by.items() if v)
    if not names:
        return Languages([])
    rng = np.random.default_rng(seed)
    each = 8_000  # windows of each language, drawn with repeats so that all weigh the same
    texts, labels = [], []
    for i, name in enumerate(names):
        texts += [by[name][k] for k in rng.integers(0, len(by[name]), each)]
        labels += [i] * each
    model = ByteGRU(len(names), hidden, seed).fit(texts, np.array(labels), steps)
    least = []
    for i, name in enumerate(names):
        total = model.sums([w for w in by[name] if len(w) >= LESSON // 2] or by[name])
        mean = total[:, :-1] / total[:, -1:]
        own = mean[mean.argmax(1) == i, i]
        least.append(float(np.quantile(own, 0.001)) if len(own) else 0.0)
    return Languages(names, model, np.array(least))


def identify_languages(docs: DataFrame, known: Languages) -> DataFrame:
    """docs' columns (a former lang_pred and score replaced) with lang_pred and score.

    Reads nothing but ``text``, all of it. Null text, or text without a letter, is
    "und" with score 0; so is every text when there is no model. Score is the mean
    probability of the language over all positions.
    """
    names_array = np.array([*known.names, UNDETERMINED], object)

    def predict(batches):
        import pyarrow as pa

        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text")).to_pylist()
            pred, score = np.full(len(column), len(known.names)), np.zeros(len(column))
            some = np.array([i for i, t in enumerate(column if known.model else []) if t and any(map(str.isalpha, t))], np.int64)
            if len(some):
                total = known.model.sums([column[i].lower().encode("utf-8", "replace") for i in some])
                mean = total[:, :-1] / total[:, -1:]
                pred[some], score[some] = mean.argmax(1), np.round(mean.max(1), 6)
            names_out = [*batch.schema.names, "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names_array[pred], pa.string()), pa.array(np.clip(score, 0, 1))], names=names_out)

    bounded_batches(docs.sparkSession, SMALL_BATCHES)
    kept = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(lean(predict), f"{schema}, lang_pred string, score double")


def language_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs (doc_id, text, lang)."""
    out = identify_languages(docs.select("doc_id", "text"), train_languages(docs, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame, share: float = 0.7, **options) -> DataFrame:
    """The rows of docs whose language is known: not "und", and scored at least ``share`` of
    the least score of the language's own windows (see ``train_languages``). Columns stay as they are,
    whatever their names."""
    known = train_languages(docs, **options)
    least = F.create_map(*[x for n, v in zip(known.names, known.least, strict=True) for x in (F.lit(n), F.lit(share * float(v)))]) if known.names else None
    apart = Apart(docs)
    out = identify_languages(apart.df.withColumnRenamed(apart.at("text"), "text"), known)
    out = out.where(F.col("lang_pred") != UNDETERMINED)
    if least is not None:
        out = out.where(F.col("score") >= least[F.col("lang_pred")])
    return apart.back(out.withColumnRenamed("text", apart.at("text")))
