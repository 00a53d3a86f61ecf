"""Toxicity by compression distance (operator 4).

Two zstandard dictionaries are trained, one on windows of ordinary text, one on windows of toxic text. A window is
compressed twice, by the ordinary dictionary and by both together (the toxic one in front, so that every ordinary match
costs the same in both). The bytes that the toxic dictionary saves are the window's distance: 0 for ordinary text,
several where toxic text recurs. A document's windows cover its whole text; the number of windows at each distance, beyond
what chance gives a text of that length, gives its score through a logistic curve that is calibrated on rows the dictionaries
didn't see.

Training uses at most ``SAMPLE`` labelled rows (``TOXIC_SHARE`` of them toxic at most), drawn by a hash of doc_id; the bound is
independent of the corpus. Only rows whose crc32(doc_id) mod 4 is not 2 are drawn. Where the bound draws a smaller share of one
class than of the other, the curve's intercept is moved back by the logarithm of their ratio, so a score is the probability among
all labelled rows and the threshold means the same at every size. Two of three drawn rows train the dictionaries: tasks cut them
into windows and return at most ``ROW_WINDOWS`` of each, spread over the whole text, so the driver gets less than ``SAMPLE *
ROW_WINDOWS`` windows of less than 240 bytes. The third calibrates: tasks score whole texts and return a few numbers a row.

1. The ordinary dictionary is trained on windows of ordinary rows.
2. The toxic dictionary is trained on windows of toxic rows, reduced to words with runs of letters that are
   significantly more frequent in toxic rows than in ordinary ones: most of a toxic text is ordinary text, which would fill the dictionary.
3. Ordinary windows that the toxic dictionary still shortens hold what both have in common: their words without such
   runs are trained into the ordinary dictionary (``ROUNDS`` times).
4. The rest of the sample calibrates the curve.

Scoring maps over documents with the two dictionaries (tens of kilobytes) and a few coefficients broadcast.

Defined results: a null or empty text has no windows and gets the curve's value for no evidence; without labelled rows
of both kinds all scores are 0; a doc_id with several labels is toxic if one of them is, and of several texts with a labelled
doc_id the least is learned from; labels without doc_id are ignored; repeated rows score alike; an empty table gives no rows; lang, source,
doc_id and labels never enter a score; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, numbered, small_batches, text_or_empty, without_caches

WINDOW = 160
SAMPLE, TOXIC_SHARE = 6000, 0.5
#: Windows of a sampled row that may go to the driver.
ROW_WINDOWS = 48
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 3 << 10
ROUNDS = 3
THRESHOLD = 0.3
#: A window ends at white space if there is some within so many bytes past its size, else between two characters.
REACH = 80
#: Distances counted apart, in bytes: 1, 2, ... and this many or more.
STEPS = 8

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def windows(text: str, size: int = WINDOW) -> tuple[bytes, np.ndarray]:
    """(bytes, rows of offset and length): the whole text, lower-cased, cut after each ``size`` bytes: before the first space
    within ``REACH`` bytes, or else before the next character. No window has ``size + REACH`` bytes or more, whatever the script."""
    data = text.lower().encode("utf-8", "replace")
    if not data:
        return data, np.zeros((0, 2), np.uint64)
    raw = np.frombuffer(data, np.uint8)
    spaces = np.append(np.flatnonzero(_SPACE[raw]), len(raw))
    marks = np.arange(size, len(raw), size)
    ends = spaces[np.searchsorted(spaces, marks)]
    far = ends - marks >= min(REACH, size)
    if far.any():
        inside = marks[far]
        for _ in range(3):  # a character's bytes after its first
            inside = inside + ((raw[np.minimum(inside, len(raw) - 1)] & 0xC0) == 0x80)
        ends[far] = np.minimum(inside, len(raw))
    cuts = np.unique(np.concatenate([[0], ends, [len(raw)]]))
    return data, np.stack([cuts[:-1], np.diff(cuts)], 1).astype(np.uint64)


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        6, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, min_match=3, strategy=zstandard.STRATEGY_LAZY2, window_log=17
    )
    whole = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    whole.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=whole, compression_params=parameters)


def lengths(compressor: zstandard.ZstdCompressor, data: bytes, cuts: np.ndarray) -> np.ndarray:
    """Compressed length of each window."""
    if not len(cuts):
        return np.zeros(0, np.int64)
    done = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(data, np.ascontiguousarray(cuts).tobytes()), threads=0)
    return np.fromiter((len(done[i]) for i in range(len(done))), np.int64, len(done))


def some_windows(text: str, most: int = ROW_WINDOWS) -> list[bytes]:
    """A text's windows, or ``most`` of them at equal distances."""
    data, cuts = windows(text)
    if len(cuts) > most:
        cuts = cuts[np.linspace(0, len(cuts) - 1, most).astype(np.int64)]
    return [data[a : a + n] for a, n in cuts.tolist()]


def _measure(compressor, pieces: list[bytes]) -> np.ndarray:
    if not pieces:
        return np.zeros(0, np.int64)
    sizes = np.array([len(p) for p in pieces], np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.uint64)
    return lengths(compressor, b"".join(pieces), np.stack([starts, sizes], 1))


def _train(size: int, samples: list[bytes]) -> bytes:
    """Content of a trained dictionary (its entropy tables are left out: every literal then costs one byte).

    Where samples are too few for zstandard to train on, they are the dictionary themselves.
    """
    try:
        return zstandard.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def _runs(word: bytes) -> set[bytes]:
    """The beginnings of a word (after a space) and its inner runs of five bytes."""
    return {b" " + word[:n] for n in range(4, min(len(word), 9) + 1)} | {word[i : i + 5] for i in range(len(word) - 4)}


def _telling(toxic: list[list[bytes]], ordinary: list[list[bytes]], least: int = 5, ratio: float = 4.0, deviations: float = 5.0) -> set[bytes]:
    """Runs of letters that are much more frequent in toxic rows (lists of windows): in ``least`` of them, at ``ratio`` times ordinary
    rows' rate, and so many standard deviations above it. Rows are counted and not windows, so what one row repeats counts once."""

    def count(rows):
        found: Counter = Counter()
        for row in rows:
            found.update(set().union(*(_runs(w) for w in {w for window in row for w in window.split()})))
        return found

    seen, usual, share = count(toxic), count(ordinary), len(toxic) / max(len(ordinary), 1)
    return {r for r, n in seen.items() if n >= least and n >= ratio * share * usual[r] and n - share * usual[r] >= deviations * (share * usual[r] + 0.5) ** 0.5}


def _reduced(samples: list[bytes], runs: set[bytes], with_runs: bool) -> list[bytes]:
    """The samples' words that have one of the runs, or those that have none."""
    return [kept for sample in samples if (kept := b" ".join(w for w in sample.split() if bool(_runs(w) & runs) == with_runs))]


def counted(gains: np.ndarray) -> np.ndarray:
    """Of a document's distances: how many windows there are, and how many save 1, 2, ... STEPS bytes or more."""
    return np.array([len(gains), *((gains >= s).sum() for s in range(1, STEPS + 1))], np.float64)


def features(counts: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """What rows of counts say beyond chance. rates: the part of ordinary text's windows that saves 1, 2, ... bytes.

    A long text has chance matches in proportion to its length; two standard deviations above them are taken off, so texts
    of any length are alike to the curve. Length itself is no feature: without evidence a text of any length, or an empty one, gets one score.
    """
    n, chance = counts[:, :1], counts[:, :1] * rates
    excess = np.maximum(0, counts[:, 1:] - chance - 2 * np.sqrt(chance * (chance > 1)))
    return np.concatenate([np.log1p(excess), excess / np.maximum(n, 1)], 1)


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Logistic regression by Newton's method: mean, scale and weights in one array."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge * len(x) / 100)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.stack([np.append(mean, 0), np.append(scale, 1), w])


class Model:
    """Two dictionaries, the rates of chance matches, and a curve."""

    def __init__(self, ordinary: bytes, toxic: bytes, curve: np.ndarray | None = None, rates: np.ndarray | None = None):
        self.ordinary, self.toxic, self.curve, self.rates = ordinary, toxic, curve, rates
        self._ready = None

    def __getstate__(self):
        return self.ordinary, self.toxic, self.curve, self.rates

    def __setstate__(self, state):
        self.__init__(*state)

    def gains(self, data: bytes, cuts: np.ndarray) -> np.ndarray:
        if self._ready is None:
            self._ready = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        plain, both = self._ready
        return lengths(plain, data, cuts) - lengths(both, data, cuts)

    def evidence(self, text: str | None) -> np.ndarray:
        return counted(self.gains(*windows(text or "")))

    def calibrate(self, counts: np.ndarray, toxic: np.ndarray, drawn: tuple[float, float]) -> None:
        """Fit the curve to rows of counts; drawn: the shares of all ordinary and of all toxic rows that they are."""
        usual = counts[toxic == 0].sum(0)
        self.rates = (usual[1:] + 0.5) / (usual[0] + 1)
        self.curve = fit_curve(features(counts, self.rates), toxic)
        self.curve[2, -1] += np.log(drawn[0] / drawn[1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        mean, scale, w = self.curve
        x = features(np.array([self.evidence(t) for t in texts]).reshape(-1, STEPS + 1), self.rates)
        z = (x - mean[:-1]) / scale[:-1]
        # row by row in one order, so that equal rows get equal scores
        return 1 / (1 + np.exp(-np.clip((z * w[:-1]).sum(1) + w[-1], -30, 30)))


def learn(ordinary_rows: list[list[bytes]], toxic_rows: list[list[bytes]]) -> Model:
    """The two dictionaries of rows of windows, without a curve."""
    ordinary_windows, toxic_windows = (list(dict.fromkeys(w for row in rows for w in row)) for rows in (ordinary_rows, toxic_rows))
    if not ordinary_windows or not toxic_windows:
        return Model(b"", b"")
    ordinary = _train(ORDINARY_BYTES, ordinary_windows)
    runs = _telling(toxic_rows, ordinary_rows)
    contrasted = _reduced(toxic_windows, runs, True)
    if not contrasted:
        return Model(ordinary, b"")
    toxic = _train(TOXIC_BYTES, contrasted)
    for _ in range(ROUNDS):
        gained = _measure(_compressor(ordinary), ordinary_windows) - _measure(_compressor(toxic + ordinary), ordinary_windows)
        hard = [ordinary_windows[i] for i in np.argsort(-gained, kind="stable").tolist() if gained[i] >= 2]
        ordinary = _train(ORDINARY_BYTES // 4, _reduced(hard, runs, False)) + ordinary
    return Model(ordinary, toxic)


def sample_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, toxic, third, text) of at most ``rows`` labelled documents outside the held-out fold, the first by a hash of doc_id in
    each class; and the shares of all such ordinary and toxic rows that this is."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    most = rows - int(rows * TOXIC_SHARE), int(rows * TOXIC_SHARE)
    chosen = known.where("toxic = 1").orderBy(order, "doc_id").limit(most[1]).union(known.where("toxic = 0").orderBy(order, "doc_id").limit(most[0]))
    counts = dict(known.groupBy("toxic").count().collect())
    drawn = tuple(min(1.0, most[k] / counts.get(k, 1)) for k in (0, 1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # at most ``rows`` pairs of numbers are broadcast
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    third = F.pmod(F.xxhash64(F.lit("third"), F.col("doc_id")), F.lit(3)).cast("int")
    return materialize(found.select("doc_id", "toxic", third.alias("third"), "text")), drawn


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Model:
    """A model of the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    sample, drawn = sample_rows(docs, labels, rows)

    def cut(batches):
        for batch in batches:
            found = [some_windows(t) for t in batch[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(found, pa.list_(pa.binary()))], ["doc_id", "toxic", "windows"])

    parts = sample.where("third < 2").select("doc_id", "toxic", "text").mapInArrow(cut, "doc_id long, toxic int, windows array<binary>").collect()
    parts.sort(key=lambda r: r.doc_id)
    model = learn(*([[bytes(w) for w in r.windows] for r in parts if r.toxic == k] for k in (0, 1)))
    if not model.toxic:
        return model
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches):
        model = shared.value
        for batch in batches:
            found = [model.evidence(t).tolist() for t in batch[2].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(found, pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    rest = sample.where("third = 2").select("doc_id", "toxic", "text").mapInArrow(weigh, "doc_id long, toxic int, x array<double>").collect()
    rest.sort(key=lambda r: r.doc_id)
    if len({r.toxic for r in rest}) == 2:
        model.calibrate(np.array([r.x for r in rest]), np.array([r.toxic for r in rest], np.float64), drawn)
    return model


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and predicted added: one map, no shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of fixed size

    def run(batches):
        without_caches()
        model = shared.value
        for batch in batches:
            scores = model.scores(batch[1].to_pylist())
            yield pa.RecordBatch.from_arrays([batch[0], pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't reject, as they are."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names, place = docs.columns, docs.columns.index("text")

    def run(batches):
        without_caches()
        model = shared.value
        for batch in batches:
            yield batch.rename_columns(names).filter(pa.array(model.scores(batch[place].to_pylist()) < THRESHOLD))

    return numbered(docs).mapInArrow(run, docs.schema)


def op4_compression_toxicity(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
