"""Missing or wrong document language labels (problem 9): a bidirectional gated recurrent network over bytes.

The network reads the bytes of one word (its letters in lower case, between two spaces) from both ends and gives
every position a distribution over languages and "none". It is trained in numpy by backpropagation through time.
A sentence's score for a language is the sum of its words' pooled position scores. Since the network starts anew
at every word, a task computes each different word once and looks the others up: the words of a language repeat,
so the cost of the recurrence grows far slower than the text, and whole texts are read.

Sentences are cut into runs of one language by a Viterbi path with a cost for each change; a document's and a
segment's confidence is the pooled, tempered share of its language.

Training takes a bounded sample of labelled documents (TRAIN_DOCS a language); their labels may be wrong and
their texts mixed, so a first network relabels the sample's sentences and a second one is trained on those.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from resiq.session import cut, table

#: ISO 639-1 codes with their ISO 639-2 codes and English names.
LANGUAGES = {
    "de": ("deu", "ger", "german"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish"),
    "fr": ("fra", "fre", "french"),
    "it": ("ita", "italian"),
    "nl": ("nld", "dut", "dutch"),
    "pl": ("pol", "polish"),
    "pt": ("por", "portuguese"),
    "ru": ("rus", "russian"),
    "zh": ("zho", "chi", "chinese"),
}
CODES = sorted(LANGUAGES)
NONE = len(CODES)

#: Bounds of the sample that the network is trained on.
TRAIN_DOCS = 150
TRAIN_WORDS = 12_000
#: Bytes of a word that are read at once; a longer run of letters is read in pieces.
PIECE = 32
#: Cost of a change of language between sentences, in the unit of the scores.
CHANGE = 6.0
#: Share of a word's score that counts as independent evidence.
TEMPER = 0.35


def label_code(label: Column) -> Column:
    """The ISO 639-1 code that a label names in any case, with any region or script, as two or three letters or in
    English; null for everything else."""
    first = F.lower(F.regexp_extract(F.coalesce(label, F.lit("")), r"^\s*([A-Za-z]+)\s*(?:[-_][A-Za-z0-9]+)*\s*$", 1))
    out = F.lit(None).cast("string")
    for code, names in LANGUAGES.items():
        out = F.when(first.isin(code, *names), F.lit(code)).otherwise(out)
    return out


#: Sentences end at a line's end, after a stop with white space behind it, and after a wide stop.
ENDS = re.compile(r"(?:(?<=[.!?])\s|\n|(?<=[。！？]))\s*")
#: Han and kana letters come two at a time, other letters as whole words.
WORD = re.compile(r"[⺀-鿿]{1,2}|[^\W\d_⺀-鿿]+")
#: Two letters one after the other of which the second may be a capital: without them no word is in capitals.
CAPITALS = re.compile(r"[^\W\d_a-z⺀-鿿][^\W\d_a-z⺀-鿿]")


def sentences(text: str) -> list[str]:
    """The text in sentences and lines, in order; blank ones are left out."""
    return [s for s in ENDS.split(text.strip()) if s and not s.isspace()]


def bare(s: str) -> bool:
    """A line of letters in capitals without a space between words (a sequence), or without letters."""
    body = s.lstrip("> \t").strip()
    return not any(c.isalpha() for c in body) or (" " not in body and body.isupper() and len(body) >= 5 and body.isascii())


def words(s: str) -> list[str]:
    """Lower-case words that may tell a language. In a sentence with small letters, words in capitals are codes or
    sequences and tell none; words with digits attached are names."""
    if CAPITALS.search(s) and not s.isupper():
        return [w.lower() for w in WORD.findall(s) if len(w) == 1 or not w.isupper()]
    return WORD.findall(s.lower())


def plain(w: str) -> str:
    """Without accents, as texts often come."""
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).replace("ß", "ss").replace("ł", "l")


def pieces(w: str) -> list[bytes]:
    b = w.encode("utf-8", "replace")
    return [b" " + b[k : k + PIECE] + b" " for k in range(0, len(b), PIECE)] or [b"  "]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Gru:
    """One direction: gates z, r and candidate h from an embedding of bytes."""

    e: np.ndarray  # 256 x 3H: what a byte adds to the gates
    u: np.ndarray  # H x 3H
    b: np.ndarray  # 3H

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """x: batch x steps of bytes -> states (steps x batch x H) and what backward needs."""
        n, steps = x.shape
        size = self.u.shape[0]
        added = (self.e[x] + self.b).transpose(1, 0, 2)  # all bytes at once; only the recurrence is stepwise
        gates, own = np.ascontiguousarray(self.u[:, : 2 * size]), np.ascontiguousarray(self.u[:, 2 * size :])
        h, out = np.zeros((n, size), np.float32), np.empty((steps, n, size), np.float32)
        zr, c = np.empty((steps, n, 2 * size), np.float32), np.empty((steps, n, size), np.float32)
        for t in range(steps):
            zr[t] = sigmoid(added[t, :, : 2 * size] + h @ gates)
            c[t] = np.tanh(added[t, :, 2 * size :] + (zr[t, :, size:] * h) @ own)
            h = h + zr[t, :, :size] * (c[t] - h)
            out[t] = h
        return out, (out, zr, c)

    def backward(self, x: np.ndarray, kept: tuple, dout: np.ndarray) -> list[np.ndarray]:
        out, zr, c = kept
        size = self.u.shape[0]
        before = np.concatenate([np.zeros_like(out[:1]), out[:-1]])
        z, r = zr[:, :, :size], zr[:, :, size:]
        gates, own = np.ascontiguousarray(self.u[:, : 2 * size].T), np.ascontiguousarray(self.u[:, 2 * size :].T)
        slope_c, slope_z, slope_r = z * (1 - c * c), (c - before) * z * (1 - z), before * r * (1 - r)
        da = np.empty((*out.shape[:2], 3 * size), np.float32)
        dh = np.zeros_like(dout[0])
        for t in range(len(out) - 1, -1, -1):
            dh = dh + dout[t]
            dc = dh * slope_c[t]
            drh = dc @ own
            da[t, :, :size] = dh * slope_z[t]
            da[t, :, size : 2 * size] = drh * slope_r[t]
            da[t, :, 2 * size :] = dc
            dh = dh * (1 - z[t]) + drh * r[t] + da[t, :, : 2 * size] @ gates
        flat = da.reshape(-1, 3 * size)
        de, du = np.zeros_like(self.e), np.empty_like(self.u)
        np.add.at(de, x.T.reshape(-1), flat)
        du[:, : 2 * size] = before.reshape(-1, size).T @ flat[:, : 2 * size]
        du[:, 2 * size :] = (r * before).reshape(-1, size).T @ flat[:, 2 * size :]
        return [de, du, flat.sum(axis=0)]


class Tagger:
    """The network: two Gru's and a layer from both states to the languages and "none", at every position."""

    def __init__(self, hidden: int = 24, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        f32 = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
        self.ways = [Gru(f32(256, 3 * hidden, s=0.3), f32(hidden, 3 * hidden, s=hidden**-0.5), np.zeros(3 * hidden, np.float32)) for _ in range(2)]
        self.o, self.c = f32(2 * hidden, NONE + 1, s=0.1), np.zeros(NONE + 1, np.float32)

    def weights(self) -> list[np.ndarray]:
        return [w for g in self.ways for w in (g.e, g.u, g.b)] + [self.o, self.c]

    def run(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Distributions (steps x batch x classes)."""
        f, kf = self.ways[0].forward(x)
        b, kb = self.ways[1].forward(x[:, ::-1])
        both = np.concatenate([f, b[::-1]], axis=2)
        y = both @ self.o + self.c
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return y / y.sum(axis=2, keepdims=True), (both, kf, kb)

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Of the weighted cross entropy of every position."""
        y, (both, kf, kb) = self.run(x)
        d = ((y - target) * (weight / (len(y) * weight.sum()))[None, :, None]).astype(np.float32)
        do = both.reshape(-1, both.shape[2]).T @ d.reshape(-1, d.shape[2])
        dboth = d @ self.o.T
        size = dboth.shape[2] // 2
        gf = self.ways[0].backward(x, kf, dboth[:, :, :size])
        gb = self.ways[1].backward(x[:, ::-1], kb, dboth[::-1, :, size:])
        return gf + gb + [do, d.sum(axis=(0, 1))]

    def pooled(self, ws: list[str]) -> np.ndarray:
        """Scores of words: the log of the mean over positions of each language's share of all languages, against
        an even share, times the share that isn't "none"."""
        by_size: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for i, w in enumerate(ws):
            for p in pieces(w):
                by_size[len(p)].append((i, p))
        total, n = np.zeros((len(ws), NONE + 1)), np.zeros(len(ws))
        for size, group in by_size.items():
            for at in range(0, len(group), 4096):
                part = group[at : at + 4096]
                x = np.frombuffer(b"".join(p for _, p in part), np.uint8).reshape(-1, size)
                rows = np.array([i for i, _ in part])
                np.add.at(total, rows, self.run(x)[0].sum(axis=0))
                np.add.at(n, rows, size)
        mean = total / np.maximum(n, 1)[:, None]
        told = 1 - mean[:, NONE:]
        share = mean[:, :NONE] / np.maximum(told, 1e-9)
        return (np.log(np.maximum(share, 1e-3)) - np.log(1 / NONE)) * told


def train(examples: list[tuple[str, np.ndarray, float]], epochs: int = 30, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Tagger:
    """examples: (word, distribution over the classes, weight)."""
    net, r = Tagger(seed=seed), np.random.default_rng(seed)
    groups: dict[int, list[int]] = defaultdict(list)
    coded = [pieces(w)[0] for w, _, _ in examples]
    for i, p in enumerate(coded):
        groups[len(p)].append(i)
    targets = np.array([t for _, t, _ in examples], np.float32).reshape(-1, NONE + 1)
    weights = np.array([w for _, _, w in examples], np.float32)
    params = net.weights()
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        parts = [ids[k : k + batch] for own in groups.values() for ids in [r.permutation(own)] for k in range(0, len(own), batch)]
        lr = rate * (1 - epoch / epochs) + 1e-3
        for k in r.permutation(len(parts)):
            ids = parts[k]
            x = np.frombuffer(b"".join(coded[i] for i in ids), np.uint8).reshape(len(ids), -1)
            step += 1
            for p, g, a, b in zip(params, net.gradients(x, targets[ids], weights[ids]), m, v, strict=True):
                np.clip(g, -1, 1, out=g)
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def distributions(counts: dict[tuple[str, str], float], capitals: dict[str, float]) -> list[tuple[str, np.ndarray, float]]:
    """Examples from counts of (word, code), every language with the same total, and of words in capitals (none)."""
    total: Counter = Counter()
    for (_, code), n in counts.items():
        total[code] += n
    per: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(NONE + 1))
    for (w, code), n in counts.items():
        for form in {w, plain(w)}:
            per[form][CODES.index(code)] += n / total[code]
    scale = max(total.values(), default=1)
    out = []
    for w, d in per.items():
        # a word seen once or twice is hardly evidence: a little of every language
        d[:NONE] += 0.15 / scale
        out.append((w, d / d.sum(), float(np.sqrt(d.sum() * scale))))
    for w, n in capitals.items():
        t = np.zeros(NONE + 1)
        t[NONE] = 1
        out.append((w, t, float(np.sqrt(n))))
    return sorted(out, key=lambda x: (-x[2], x[0]))[: 2 * TRAIN_WORDS]


class Reader:
    """Scores sentences with a trained network; words are computed once."""

    def __init__(self, net: Tagger, most: int = 1_000_000) -> None:
        self.net, self.most = net, most
        self.place: dict[str, int] = {}
        self.table = np.zeros((0, NONE), np.float32)

    def learn(self, flat: list[str]) -> None:
        new = list(set(flat).difference(self.place))
        if len(self.place) + len(new) > self.most:
            self.place, self.table = {}, self.table[:0]
            new = list(set(flat))
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            self.place.update(zip(part, range(len(self.table), len(self.table) + len(part)), strict=True))
            self.table = np.concatenate([self.table, self.net.pooled(part).astype(np.float32)])

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """(sentences x languages); sentences without words score 0."""
        flat = [w for s in texts for w in s]
        self.learn(flat)
        out = np.zeros((len(texts), NONE))
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        if flat:
            full = np.flatnonzero(n)
            at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
            out[full] = np.add.reduceat(self.table[at].astype(np.float64), (np.cumsum(n) - n)[full])
        return out


def path(scores: np.ndarray, change: float = CHANGE) -> np.ndarray:
    """The best language of each sentence, with a cost for each change."""
    best, back = scores[0].copy(), np.zeros(scores.shape, np.int64)
    for t in range(1, len(scores)):
        jump = best.argmax()
        stay = best >= best[jump] - change
        back[t] = np.where(stay, np.arange(NONE), jump)
        best = np.where(stay, best, best[jump] - change) + scores[t]
    out = np.empty(len(scores), np.int64)
    out[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def segments(scores: np.ndarray, told: np.ndarray, change: float = CHANGE) -> list[tuple[int, int, int, float]]:
    """(first sentence, one past the last, language, confidence) of each run; told: sentences that have words."""
    if not told.any():
        return []
    rows = np.flatnonzero(told)
    lang = scores[rows].argmax(axis=1)
    if (lang != lang[0]).any():  # else the path without a change is the best one
        lang = path(scores[rows], change)
    edges = np.flatnonzero(np.diff(lang, prepend=-1))
    out = []
    for k, e in enumerate(edges):
        end = edges[k + 1] if k + 1 < len(edges) else len(rows)
        out.append((int(rows[e]), int(rows[end - 1]) + 1, int(lang[e]), float(shares(scores[rows[e:end]].sum(axis=0))[lang[e]])))
    return out


def shares(scores: np.ndarray) -> np.ndarray:
    """Tempered shares of the languages."""
    s = scores * TEMPER
    p = np.exp(s - s.max())
    return p / p.sum()


def word_counts(sample: DataFrame) -> pd.DataFrame:
    """(kind, code, word, n) of the sample's words, the commonest: at most a fixed number comes to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for code, text in zip(b.code, b.text, strict=True):
                for s in sentences(text or ""):
                    if bare(s):
                        n.update(("none", "", p.lower()) for p in WORD.findall(s))
                        continue
                    n.update(("word", code, w) for w in words(s))
                    if not s.isupper():
                        n.update(("none", "", w.lower()) for w in WORD.findall(s) if len(w) > 1 and w.isupper())
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["kind", "code", "word", "n"])

    rows = sample.select("code", "text").mapInPandas(count, "kind string, code string, word string, n long").groupBy("kind", "code", "word").agg(F.sum("n").alias("n"))
    top = F.row_number().over(W.partitionBy("kind", "code").orderBy(F.desc("n"), "word"))
    return rows.withColumn("rn", top).where(F.col("rn") <= TRAIN_WORDS // 4).drop("rn").toPandas()


def sample_of(docs: DataFrame, per: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, code, text) of at most `per` documents with a usable label for each language, by a hash of the id."""
    named = docs.select("doc_id", label_code(F.col("lang")).alias("code")).where("code is not null")
    rank = F.row_number().over(W.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id"))
    few = named.withColumn("rn", rank).where(F.col("rn") <= per).select("doc_id", "code")  # at most per x languages
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id")


def fit(docs: DataFrame) -> Tagger | None:
    """The network, from the sample's labels, then from its own labels of the sample's sentences."""
    sample = cut(sample_of(docs))
    counts = word_counts(sample)
    if not (counts.kind == "word").any():
        return None
    none = {r.word: r.n for r in counts[counts.kind == "none"].itertuples()}
    first = train(distributions({(r.word, r.code): r.n for r in counts[counts.kind == "word"].itertuples()}, none))

    def relabel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(first)
        for b in batches:
            out = []
            for text in b.text:
                found = sentences(text or "")
                held = [[] if bare(s) else words(s) for s in found]
                if not found:
                    continue
                score, told = reader.scores(held), np.array([bool(h) for h in held])
                for at, end, lang, _ in segments(score, told):
                    out.append((CODES[lang], "\n".join(found[at:end])))
            yield pd.DataFrame(out, columns=["code", "text"])

    again = word_counts(sample.select("text").mapInPandas(relabel, "code string, text string"))
    return train(distributions({(r.word, r.code): r.n for r in again[again.kind == "word"].itertuples()}, none))


def tag(docs: DataFrame, net: Tagger) -> DataFrame:
    """(doc_id, seg_no, first_sentence, last_sentence, lang, confidence, label, doc_lang, doc_confidence, n_segments)
    for each segment of each document. Null, empty and wordless texts have one segment of no language (null) and
    confidence 0; label is the code that the document's label names."""
    schema = "doc_id long, seg_no int, first_sentence int, last_sentence int, lang string, confidence double, label string, doc_lang string, doc_confidence double, n_segments int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(net)
        for b in batches:
            held, sizes = [], []
            for text in b.text:
                own = [[] if bare(s) else words(s) for s in sentences(text)] if text else []
                held += own
                sizes.append(len(own))
            score = reader.scores(held)
            told = np.fromiter(map(bool, held), bool, len(held))
            top = np.where(told, score.argmax(axis=1), -1) if len(held) else np.zeros(0, np.int64)
            out, at = [], 0
            for doc, label, n in zip(b.doc_id, b.label, sizes, strict=True):
                rows = np.flatnonzero(told[at : at + n])
                if not len(rows):
                    out.append((doc, 1, 1, max(1, n), None, 0.0, label, None, 0.0, 1))
                    at += n
                    continue
                p = shares(score[at : at + n].sum(axis=0))
                best = int(p.argmax())
                tops = top[at + rows]
                if (tops == tops[0]).all():  # one language throughout
                    out.append((doc, 1, int(rows[0]) + 1, int(rows[-1]) + 1, CODES[best], float(p[best]), label, CODES[best], float(p[best]), 1))
                else:
                    own = segments(score[at : at + n], told[at : at + n])
                    out += [(doc, k + 1, i + 1, j, CODES[lang], c, label, CODES[best], float(p[best]), len(own)) for k, (i, j, lang, c) in enumerate(own)]
                at += n
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", "text", label_code(F.col("lang")).alias("label")).mapInPandas(run, schema)


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang")


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of every document. Where no document has a usable label, each has one segment of no language."""
    docs = documents(spark, sf)
    net = fit(docs)
    if net is None:  # no label to learn from: no language is told
        return tag(docs.withColumn("text", F.lit(None).cast("string")), Tagger())
    return tag(docs, net)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the documents that are mixed or whose label is missing, unusable or another language's."""
    out = p9_segments(spark, sf)
    wrong = (F.col("n_segments") > 1) | F.col("label").isNull() | (F.col("label") != F.col("lang"))
    return out.where(wrong & F.col("lang").isNotNull()).select("doc_id", "seg_no", "lang")


def p9_labels(spark: SparkSession, sf: str) -> DataFrame:
    """One row a document: its language, confidence, and what its label named."""
    return p9_segments(spark, sf).where("seg_no = 1").select("doc_id", F.col("doc_lang").alias("lang"), F.round("doc_confidence", 6).alias("confidence"), "label", "n_segments")
