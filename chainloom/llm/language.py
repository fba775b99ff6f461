"""Language of documents and of their parts, by a string kernel on n-gram presence.

Two sentences are as alike as the share of n-grams (of 1 to 3 characters, the blended spectrum) that both hold:
k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|). Landmark sentences give the Nyström features, on which one ridge regression for each language is
fitted against the rest. A batch of sentences is scored by matrix products: its presence matrix times landmark matrix times
coefficients; the last two are multiplied once, when the model is fitted.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions.normalise import BLANKS
from chainloom.session import Saved, small_side

#: Columns of the presence matrix; n-grams are hashed to them.
COLUMNS = 4096
#: Column with the path of a row's file.
FILE = "__file"
#: The model is fitted on this many labelled documents at most, and this many sentences of each.
FIT_DOCS = 4000
FIT_SENTENCES = 4
#: Those documents come from this many files at most, so that fitting doesn't read the texts of a large corpus a second time.
FIT_FILES = 256
LANDMARKS = 600
RIDGE = 0.003
#: A sentence's best score must reach this, and lead the next by LEAD, to name its language.
LEAST = 0.35
LEAD = 0.15
#: Confidence is the softmax of the scores times SHARP.
SHARP = 8.0
#: A text is written in a language from one whole sentence of this many words on, or of so many Chinese or Japanese characters.
WORDS = 10
CHARACTERS = 20
#: Sentences scored in one matrix product; their presence matrix stays in the processor's cache.
BLOCK = 128

END = re.compile(r"[.!?]+[\"'”»’)\]]*(?=[\s<]|$)|[。！？]|\n[ \t\r]*\n")
SCRIPT = re.compile(r"[぀-ヿ㐀-䶿一-鿿]")
TAG = re.compile(r"<[^<>\n]{1,80}>|&[a-z#0-9]{2,8};")
WRAP = re.compile(r"-[ \t\r]*\n[ \t]*")
#: UTF-8 read as Latin-1.
GARBLED = re.compile("[Â-ô][\u0080-¿]{1,3}")
DAMAGED = re.compile("[Â-ô][\u0080-¿]|[\u0300-\u036f]")
LETTERS = re.compile(r"[^\W\d_]+")
#: The same for plain ASCII, which str.translate and split take apart faster.
ASCII_GAPS = {i: " " for i in range(128) if not chr(i).isalpha()}


def _repair(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode("utf-8")
    except UnicodeError:
        return m[0]


def spans(text: str) -> Iterable[tuple[int, int, bool]]:
    """(start, end, whole) of each sentence; one cut off by a blank line or the end of the text isn't whole."""
    start = 0
    for m in END.finditer(text):
        whole = m[0][0] != "\n"
        yield start, m.end() if whole else m.start(), whole
        start = m.end()
    yield start, len(text), False


def letters(sentence: str) -> str:
    """A sentence as its kernel sees it: lower-case words without digits, signs, markup and line wraps, encoding repaired."""
    if "<" in sentence or "&" in sentence:
        sentence = TAG.sub(" ", sentence)
    if "\n" in sentence:
        sentence = WRAP.sub("", sentence)
    if sentence.isascii():
        return " ".join(sentence.lower().translate(ASCII_GAPS).split())
    if DAMAGED.search(sentence):
        sentence = unicodedata.normalize("NFC", GARBLED.sub(_repair, sentence))
    return " ".join(LETTERS.findall(sentence.lower()))


def enough(words: str) -> bool:
    """Whether the words of a sentence are as many as one must have to count."""
    return words.count(" ") + 1 >= WORDS or (len(words) >= CHARACTERS and len(SCRIPT.findall(words)) >= CHARACTERS)


def presence(sentences: Sequence[str]) -> np.ndarray:
    """The presence matrix of normalised sentences: 1 where a sentence holds an n-gram of the column; its ends count as signs."""
    c = np.frombuffer(("\n\n" + "\n\n\n".join(sentences) + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    lens = np.fromiter(map(len, sentences), np.int64, len(sentences)) + 3
    row = np.repeat(np.arange(len(sentences), dtype=np.uint32) * np.uint32(COLUMNS), lens)
    n, shift = len(row), np.uint32(33 - COLUMNS.bit_length())
    x = np.zeros(len(sentences) * COLUMNS, np.float32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] * np.uint32(0x85EBCA6B) << np.uint32(7))) * np.uint32(0xC2B2AE35)
    three = (two[:n] + c[2:] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    for h in (one[:n], two[:n], three):
        x[(h >> shift) + row] = 1
    return x.reshape(len(sentences), COLUMNS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


@dataclass
class Model:
    """Languages and, for each, the weights of the columns: landmark matrix times ridge coefficients."""

    langs: list[str]
    weights: np.ndarray

    def scores(self, sentences: Sequence[str]) -> np.ndarray:
        """The score of each normalised sentence for each language."""
        out = np.zeros((len(sentences), len(self.langs)), np.float32)
        counted = np.concatenate([self.weights, np.ones((COLUMNS, 1), np.float32)], axis=1)
        for i in range(0, len(sentences), BLOCK):
            y = presence(sentences[i : i + BLOCK]) @ counted
            out[i : i + BLOCK] = y[:, :-1] / np.sqrt(y[:, -1:])
        return out

    def name(self, sentences: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language or -1, confidence) of each normalised sentence."""
        s = self.scores(sentences)
        if not len(s) or not self.langs:
            return np.full(len(sentences), -1), np.zeros(len(sentences))
        best = s.argmax(1)
        top = s[np.arange(len(s)), best]
        e = np.exp(SHARP * (s - top[:, None]))
        second = np.partition(s, -2, axis=1)[:, -2] if s.shape[1] > 1 else np.zeros(len(s))
        return np.where((top >= LEAST) & (top - second >= LEAD), best, -1), 1 / e.sum(1)


def _kernel(sentences: Sequence[str], z: np.ndarray) -> np.ndarray:
    """Kernel values of sentences and landmarks z (unit presence rows), block by block."""
    parts = [_unit(presence(sentences[i : i + BLOCK])) @ z.T for i in range(0, len(sentences), BLOCK)]
    return np.concatenate(parts) if parts else np.zeros((0, len(z)), np.float32)


def _ridge(k: np.ndarray, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of the landmarks, weights of the columns) for kernel values k and targets y (sentences by languages)."""
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström: features are K(x, z) @ root
    f = k @ root
    w = weight / weight.sum()
    a = (f * w[:, None]).T @ f
    b = (f * w[:, None]).T @ y
    coef = root @ np.linalg.solve(a + RIDGE * np.eye(len(a)) / f.shape[1], b)
    return coef, (z.T.astype(np.float64) @ coef).astype(np.float32)


def fit(sentences: Sequence[str], labels: Sequence[str], seed: int = 0) -> Model:
    """A model from normalised sentences with labels of which a minority may be wrong.

    First the labels are fitted as they come; a language to which that model gives fewer than a tenth of the sentences labelled
    with it, or fewer than three, was never there. Then the model's own labels are fitted, all languages weighing the same.
    """
    langs = sorted(set(labels))
    nothing = Model([], np.zeros((COLUMNS, 0), np.float32))
    if not langs:
        return nothing
    rng = np.random.default_rng(seed)
    given = np.array([langs.index(v) for v in labels])
    marks = rng.permutation(len(sentences))[:LANDMARKS]
    z = _unit(presence([sentences[i] for i in marks]))
    k = _kernel(sentences, z)
    first = (k @ _ridge(k, z, np.eye(len(langs))[given], np.ones(len(k)))[0]).argmax(1)
    n, asked = np.bincount(first, minlength=len(langs)), np.bincount(given, minlength=len(langs))
    there = [j for j in range(len(langs)) if n[j] >= max(3, 0.1 * asked[j]) or n[j] == len(k)]
    if not there:
        return nothing
    kept = [i for i in range(len(first)) if first[i] in there]
    mine = np.array([there.index(first[i]) for i in kept])
    share = LANDMARKS // len(there) + 1
    marks = np.concatenate([rng.permutation(np.flatnonzero(mine == j))[:share] for j in range(len(there))])
    z = _unit(presence([sentences[kept[i]] for i in marks]))
    k = _kernel([sentences[i] for i in kept], z)
    return Model([langs[j] for j in there], _ridge(k, z, np.eye(len(there))[mine], 1 / np.bincount(mine)[mine])[1])


def label_codes(docs: DataFrame, names: DataFrame, label: str = "lang") -> DataFrame:
    """`docs` with a column label_code: the code that the label names, null where it names none."""
    bare = F.regexp_replace(F.lower(F.btrim(F.col(label), F.lit(BLANKS))), "[-_].*$", "")
    known = names.select(F.col("code").alias("label_code"), F.explode(F.array(*[F.lower(F.btrim(F.col(c), F.lit(BLANKS))) for c in ("code", "code3", "english_name")])).alias("__name"))
    known = known.where("__name IS NOT NULL AND label_code IS NOT NULL").groupBy("__name").agg(F.min("label_code").alias("label_code"))
    return docs.drop("label_code").withColumn("__bare", bare).join(small_side(Saved(known, "names")), F.col("__bare") == F.col("__name"), "left").drop("__bare", "__name")


def train(docs: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = FIT_DOCS) -> Model:
    """A model fitted on the first `limit` labelled documents (of label_codes) in the order of a hash of their id and label.

    The bound is `limit` documents and FIT_SENTENCES whole sentences of each; more never reach the driver. If `docs` has the path of each
    row's file as FILE, only the first FIT_FILES files in the order of a hash of their paths are read. Without a label
    or whole sentence anywhere the model names no language.
    """
    labelled = docs.where(F.col("label_code").isNotNull())  # choosing documents needs no text, so none is read for it
    if FILE in docs.columns:
        files = labelled.select(FILE).distinct().orderBy(F.xxhash64(FILE), FILE).limit(FIT_FILES)
        labelled = labelled.where(F.col(FILE).isin([r[0] for r in files.collect()]))
    order = F.xxhash64(F.col(doc), F.col("label_code"), F.lit(1))
    chosen = labelled.select(F.col(doc).alias("__doc"), order.alias("__o")).orderBy("__o", "__doc").limit(limit)
    chosen = chosen.select("__doc", "__o").distinct()
    picked = labelled.join(F.broadcast(chosen), (F.col(doc).eqNullSafe(F.col("__doc"))) & (order == F.col("__o")), "left_semi")

    def sentences(batches):
        for batch in batches:
            rows = []
            for code, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                good = [w for a, b, whole in spans(t or "") if whole and enough(w := letters(t[a:b]))]
                step = max(1, len(good) // FIT_SENTENCES)
                rows += [(code, w) for w in good[::step][:FIT_SENTENCES]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["code", "words"])

    got = picked.select("label_code", text).mapInArrow(sentences, "code string, words string").limit(limit * FIT_SENTENCES)
    pairs = sorted((r.words, r.code) for r in got.collect())
    return fit([p[0] for p in pairs], [p[1] for p in pairs])


def _judge(model: Model, texts: Sequence[str | None]):
    """For each text its sentences as (start, end, whole and long enough, language index or -1, confidence)."""
    number: dict[str, int] = {}
    out = []
    for t in texts:
        rows = []
        for a, b, whole in spans(t or ""):
            words = letters(t[a:b]) if b > a else ""
            if len(words) >= 8:
                rows.append((a, b, whole and enough(words), number.setdefault(words, len(number))))
        out.append(rows)
    which, sure = model.name(list(number))
    which, sure = which.tolist(), sure.tolist()
    return [[(a, b, w, which[k], sure[k]) for a, b, w, k in rows] for rows in out]


def _slices(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            yield batch.slice(i, 1000)


def found(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lang): each language in which a text is written and which its label doesn't name, by whole sentences only.

    Null and empty texts, and those without a whole sentence, give no row.
    """

    def rows(batches):
        for batch in _slices(batches):
            at, langs = [], []
            labels = batch.column(1).to_pylist()
            for i, sentences in enumerate(_judge(model, batch.column(2).to_pylist())):
                for lang in sorted({model.langs[k] for _, _, counts, k, _ in sentences if counts and k >= 0}):
                    if lang != labels[i]:
                        at.append(i)
                        langs.append(lang)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(langs, pa.string())], names=["doc", "lang"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), "label_code", text).mapInArrow(rows, f"doc {kind}, lang string").withColumnRenamed("doc", doc)


def segments(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, segment, first_char, last_char, lang, confidence): the runs of sentences of one language of each text, in order.

    Positions are characters, from 0, the last exclusive. A sentence whose language can't be told belongs to the run before it, or
    to the next where there is none. The confidence is the mean of the run's sentences, by length. A text without any sentence whose
    language can be told gives no row.
    """

    def rows(batches):
        for batch in _slices(batches):
            at, cols = [], [[], [], [], [], []]
            for i, sentences in enumerate(_judge(model, batch.column(2).to_pylist())):
                runs: list[list] = []
                begun = None
                for a, b, _, k, sure in sentences:
                    begun = a if begun is None else begun
                    if k >= 0 and (not runs or runs[-1][2] != k):
                        runs.append([a if runs else begun, b, k, 0.0, 0])
                    if runs:
                        runs[-1][1] = b
                        if k >= 0:
                            runs[-1][3] += sure * (b - a)
                            runs[-1][4] += b - a
                for n, (a, b, k, s, w) in enumerate(runs):
                    at.append(i)
                    for col, v in zip(cols, (n, a, b, model.langs[k], s / w)):
                        col.append(v)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=["doc", "segment", "first_char", "last_char", "lang", "confidence"])

    kind = docs.schema[doc].dataType.simpleString()
    schema = f"doc {kind}, segment int, first_char bigint, last_char bigint, lang string, confidence double"
    return docs.select(F.col(doc).alias("doc"), "label_code", text).mapInArrow(rows, schema).withColumnRenamed("doc", doc)


def documents(docs: DataFrame, model: Model, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, lang, confidence, share, label_code): the language of most of each text, and the share of its characters in it.

    Lang is null, confidence and share are 0 where no language can be told, as in null and empty texts.
    """

    def rows(batches):
        for batch in _slices(batches):
            langs, sures, shares = [], [], []
            for sentences in _judge(model, batch.column(2).to_pylist()):
                size, sure = np.zeros(len(model.langs) + 1), np.zeros(len(model.langs) + 1)
                for a, b, _, k, s in sentences:
                    if k >= 0:
                        size[k] += b - a
                        sure[k] += s * (b - a)
                k = int(size.argmax())
                langs.append(model.langs[k] if size[k] else None)
                sures.append(float(sure[k] / size[k]) if size[k] else 0.0)
                shares.append(float(size[k] / size.sum()) if size[k] else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(sures, pa.float64()), pa.array(shares, pa.float64()), batch.column(1)], names=["doc", "lang", "confidence", "share", "label_code"])

    kind = docs.schema[doc].dataType.simpleString()
    schema = f"doc {kind}, lang string, confidence double, share double, label_code string"
    return docs.select(F.col(doc).alias("doc"), "label_code", text).mapInArrow(rows, schema).withColumnRenamed("doc", doc)
