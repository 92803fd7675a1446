"""Language ID: averaged hashed subword embeddings under a linear softmax.

Texts are lower-cased, ASCII characters that are not letters become one space, and every
n-gram of 2 to 4 UTF-8 bytes of the whole text is hashed to a row of an embedding table.
The mean row goes through a linear layer and a softmax, both trained by stochastic
gradient descent in numpy on the whole texts of a bounded sample of labelled rows. One
class more stands for what is no learned language: noise made of random letters, shuffled
text, encoded bytes and letters of scripts that the sample lacks. A temperature is
calibrated on short and whole texts of sampled documents that training does not see. The
rejection threshold depends on the length of a text: at each of LENGTHS it is the confidence
that all but ALPHA of the texts reach that are cut to that length from those documents, from
one or half and half from two of different languages, and it is interpolated between them.

Defined results: text that is null or has no letter (Unicode category L) is `und` with
score 0 and rejected; without any label every document is `und`; rows with a null id are
never held out and never learned from; ties go to the language first by code point.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftgraph.llm.common import map_texts, table

#: At most so many labelled documents, whole, and so many characters in all are sampled for a language.
DOCS_PER_LANG, CHARS_PER_LANG = 400, 1_500_000
#: Characters of a training text; a document gives as many as it holds.
WINDOW_CHARS = 256
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 16, 16, 4, 0.4, 7
#: The share of calibration texts of any length that the rejection threshold may turn away.
ALPHA = 0.001
#: Characters of calibration texts, and texts of one language and of two that a document gives for each.
LENGTHS, CUTS = (3, 6, 12, 24, 48, 96, 192, 384, 1536), 4
UNKNOWN = "und"
_PIECE = 1 << 20

_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_LATIN = re.compile("[A-Za-z]")
#: First code points of the 128 that a script's noise is drawn from: Greek, Cyrillic, Armenian and Hebrew, Arabic, Devanagari, Thai, Georgian, kana, Han, Hangul.
SCRIPTS = (0x380, 0x400, 0x580, 0x600, 0x900, 0xE00, 0x1080, 0x3080, 0x4E00, 0x5B80, 0x7000, 0xAC00)
FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode category L; numbers such as a half or a Roman numeral are none."""
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def _normal(text: str) -> np.ndarray:
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()) + b" "
    return np.frombuffer(raw if len(raw) > 3 else raw + b"   ", np.uint8)


def _buckets(raw: np.ndarray) -> np.ndarray:
    """The table rows of all n-grams of some bytes."""
    x = raw.astype(np.uint32)
    out, h = [], x[:-1] * np.uint32(0x01000193) ^ x[1:]
    for n in (2, 3, 4):
        if n > 2:
            h = h[:-1] * np.uint32(0x01000193) ^ x[n - 1 :]
        out.append((h * np.uint32(0x9E3779B1) + np.uint32(n)) >> np.uint32(16))
    return np.concatenate(out)


def mean_row(text: str, rows: np.ndarray) -> np.ndarray:
    """The mean of `rows` over the n-grams of the whole text, in pieces of bounded size."""
    raw = _normal(text)
    total, n = np.zeros(rows.shape[1]), 0
    for at in range(0, max(1, len(raw) - 3), _PIECE):
        ids = _buckets(raw[at : at + _PIECE + 3])
        total += rows[ids].sum(axis=0, dtype=np.float64)
        n += len(ids)
    return total / n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def noise(rng: np.random.Generator, text: str, foreign: list[int]) -> str:
    """What is no language, about as long as `text`; `foreign` are first code points of scripts."""
    n = max(4, len(text))
    kind = int(rng.integers(0, 6 if foreign else 4))
    if kind == 0:
        return "".join(rng.permutation(list(text)).tolist())
    if kind == 1:
        return base64.b64encode(rng.bytes(n * 3 // 4 + 3)).decode()[:n]
    if kind == 2:
        return "".join(map(chr, rng.integers(97, 123, n).tolist()))
    if kind == 3:  # words of random letters
        return "".join(map(chr, np.where(rng.random(n) < 0.18, 32, rng.integers(97, 123, n)).tolist()))
    first = foreign[int(rng.integers(len(foreign)))]
    return "".join(map(chr, np.where(rng.random(n) < 0.15, 32, first + rng.integers(0, 128, n)).tolist()))


def train(samples: list[tuple[str, str]], seed: int = SEED) -> dict | None:
    """A model from (language, whole text of a document) pairs."""
    langs = sorted({lang for lang, _ in samples})
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    held = [i % 5 == 4 for i in range(len(samples))] if len(samples) >= 10 * len(langs) else [False] * len(samples)
    pages = {ord(c) >> 7 for _, text in samples for c in set(text)}
    foreign = [f for f in SCRIPTS if f >> 7 not in pages]
    examples, windows = [], []
    for (lang, text), out in zip(samples, held, strict=True):
        if out:
            continue
        for at in range(0, len(text), WINDOW_CHARS):
            w = text[at : at + WINDOW_CHARS]
            short = w[: int(rng.integers(4, WINDOW_CHARS))] if rng.random() < 0.3 else w
            if has_letter(short):
                examples.append((np.unique(_buckets(_normal(short)), return_counts=True), langs.index(lang)))
                windows.append(short)
    for i in rng.permutation(len(windows))[: len(windows) // len(langs)]:
        examples.append((np.unique(_buckets(_normal(noise(rng, windows[i], foreign))), return_counts=True), len(langs)))
    classes = len(langs) + 1
    table_rows = rng.normal(0, 0.1, (BUCKETS, DIM))
    out_w, bias = np.zeros((DIM, classes)), np.zeros(classes)
    weight = np.bincount([y for _, y in examples], minlength=classes) if examples else np.ones(classes)
    weight = weight.sum() / np.maximum(weight, 1) / classes
    steps, step = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            (ids, counts), y = examples[i]
            rate = RATE * (1 - step / steps) * min(4.0, weight[y])
            step += 1
            share = counts / counts.sum()
            mean = share @ table_rows[ids]
            g = _softmax(mean @ out_w + bias)
            g[y] -= 1
            back = out_w @ g
            out_w -= rate * np.outer(mean, g)
            bias -= 0.1 * rate * g
            table_rows[ids] -= (rate * 10) * share[:, None] * back
    model = {"langs": langs, "rows": (table_rows @ out_w).astype(np.float32), "bias": bias, "temperature": 1.0, "threshold": ([0.0], [0.0])}
    check = [(text, langs.index(lang)) for (lang, text), out in zip(samples, held, strict=True) if out and has_letter(text)]
    if check:
        cut = lambda t, n: t[int(rng.integers(0, max(1, len(t) - n))) :][:n]
        short = [(s, k) for t, k in check for n in (6, 12, 24, 48) if has_letter(s := cut(t, n))]
        none = [(noise(rng, cut(t, n), foreign), len(langs)) for t, _ in check for n in (24, 192)]
        z = np.array([mean_row(t, model["rows"]) + bias for t, _ in check + short + none])
        y = np.array([k for _, k in check + short + none])
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model["temperature"] = float(min(np.geomspace(0.05, 20, 60), key=loss))
        model["threshold"] = thresholds(model, check, rng)
    return model


def _confidence(model: dict, text: str) -> np.ndarray:
    """The probability of each language; what is missing to 1 is that of none."""
    return _softmax((mean_row(text, model["rows"]) + model["bias"]) / model["temperature"])[:-1]


def thresholds(model: dict, check: list[tuple[str, int]], rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """Logarithms of text lengths and the least confidence at each, from (text, language) pairs.

    Lengths are those of the bytes that n-grams are made of, so digits and signs do not count.
    """
    cut = lambda t, n: t[int(rng.integers(0, max(1, len(t) - n))) :][:n]
    by_lang = [[t for t, k in check if k == y] for y in range(len(model["langs"]))]
    sizes, least = [], []
    for n in LENGTHS:
        texts = []
        for t, k in check:
            others = [o for y, o in enumerate(by_lang) if y != k and o]
            for _ in range(CUTS):
                texts.append(cut(t, n))
                if others:
                    other = others[int(rng.integers(len(others)))]
                    texts.append(cut(t, n - n // 2) + " " + cut(other[int(rng.integers(len(other)))], n // 2))
        texts = [t for t in texts if has_letter(t)]
        if texts:
            sizes.append(float(np.log(np.median([len(_normal(t)) for t in texts]))))
            least.append(float(np.quantile([_confidence(model, t).max() for t in texts], ALPHA)))
    order = np.argsort(sizes, kind="stable")
    return [sizes[i] for i in order], [least[i] for i in order]


def predict(model: dict | None, text: str | None) -> tuple[str, float, bool]:
    if model is None or not text or not has_letter(text):
        return UNKNOWN, 0.0, True
    p = _confidence(model, text)
    k = int(p.argmax())
    return model["langs"][k], float(p[k]), bool(p[k] < np.interp(np.log(len(_normal(text))), *model["threshold"]))


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample_labelled(
    docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_lang: int = DOCS_PER_LANG, chars_per_lang: int = CHARS_PER_LANG
) -> list[tuple[str, str]]:
    """(language, whole text) of a bounded sample of labelled rows, chosen by a hash of the id.

    Only rows that are not held out and have a label, an id and a text. Texts of more than a
    quarter of `chars_per_lang` characters are passed over, so that one does not end the
    sample; the others are taken in the order of the hash while they are at most
    `docs_per_lang` rows and `chars_per_lang` characters. No more reaches the driver.
    """
    labelled = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("t"))
    labelled = labelled.where(F.col("i").isNotNull() & F.col("l").isNotNull() & ~held_out("i"))
    counts = {r["l"]: r["count"] for r in labelled.groupBy("l").count().collect()}
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * docs_per_lang / n)))])
    draw = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(SEED)), F.lit(1 << 30))
    chosen = labelled.where(draw < F.element_at(share, F.col("l")) * (1 << 30)).where(F.col("t").isNotNull())
    chosen = chosen.select("l", draw.alias("d"), F.col("i").cast("string").alias("i"), F.xxhash64("t").alias("h"), F.length("t").alias("n"))
    in_order = Window.partitionBy("l").orderBy("d", "i", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = chosen.where(F.col("n") <= chars_per_lang // 4)
    fits = fits.withColumns({"nth": F.count(F.lit(1)).over(in_order), "upto": F.sum("n").over(in_order)})
    taken = fits.where(f"nth <= {docs_per_lang} and upto <= {chars_per_lang}").select("l", "i", "h", "nth").distinct()
    texts = labelled.select("l", "t", F.col("i").cast("string").alias("i"), F.xxhash64("t").alias("h"))
    rows = texts.join(F.broadcast(taken), ["l", "i", "h"]).collect()  # at most docs_per_lang rows a language are broadcast
    first = {(r.l, r.i, r.h): (r.nth, r.t) for r in sorted(rows, key=lambda r: -r.nth)}
    return [(lang, text) for (lang, _, _), (_, text) in sorted(first.items(), key=lambda x: (x[0][0], x[1][0]))]


def identify(docs: DataFrame, model: dict | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`docs` with lang_pred, score and rejected. The model is of fixed size (BUCKETS rows by language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            found = [predict(m, t) for t in texts]
            return {f.name: [x[k] for x in found] for k, f in enumerate(FIELDS)}

        return run

    return map_texts(docs, text_col, FIELDS, make, keep)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    return train(sample_labelled(docs, id_col, text_col, lang_col))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.withColumn("held_out", held_out("doc_id")), learn(docs), keep=["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
