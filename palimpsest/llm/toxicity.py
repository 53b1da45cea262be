"""Toxicity by weak supervision.

Many voters look at a text: fixed lexicons in four languages, patterns (address plus insult, masked letters, shouting, dense
hits) and lexicons induced from labelled rows. Each fires or abstains, so a text is one pattern of VOTERS bits, and a corpus is
at most 2**VOTERS pattern counts, gathered over all learning documents. A generative label model is fitted to these counts by
expectation maximisation: class balance, each voter's rate of firing in either class, the noise of the given labels (one more
voter, mostly abstaining), and at the end the correlations left between voters within a class, by which their evidence is shared
out. Its
posteriors are the targets of a linear classifier over hashed words, word starts and votes, whose probability is the score.

Labels come only from rows outside the held-out fold; induced lexicons use at most FIT_ROWS labelled rows, the classifier these and
as many rows without a label (their posteriors rest on votes alone), those of the lowest hashes of doc_id (a parameter). Null and empty texts are scored (by the intercept). Several labels of one
document count as toxic if one does. Without labels the label model runs on the fixed voters alone. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 12_000
BITS = 20
#: Plain words of abuse by voter.
LEXICONS = {
    "insult": "idiot idiots moron morons loser losers clown clowns fool fools imbecile cretin dimwit halfwit dunce jerk jerks bastard bastards creep coward",
    "contempt": "worthless pathetic disgusting stupid useless hopeless brainless ridiculous hideous repulsive despicable contemptible dumb ugly vile",
    "dehumanising": "scum trash garbage vermin filth parasite parasites subhuman animals rat rats cockroach cockroaches pig pigs",
    "hate": "hate hates hated despise despised detest loathe loathed kill killed hang shoot",
    "profanity": "damn crap shit shitty bullshit ass asshole bitch fuck fucking fucked piss dick",
    "spanish": "idiota idiotas imbécil estúpido estúpida basura asqueroso patético inútil escoria payaso perdedor mierda tonto",
    "french": "idiote imbécile stupide ordure dégoûtant pathétique inutile salaud crétin débile nul raclure merde connard",
    "german": "idioten dumm dummkopf blöd abschaum müll ekelhaft erbärmlich wertlos versager trottel scheiße arschloch depp",
}
#: Letters that signs and digits stand in for.
MASKS = str.maketrans("013457@$!", "oieastasi")
INDUCED = 4
VOTERS = len(LEXICONS) + 4 + INDUCED
_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"(?<!\S)[A-Za-z]*[013457@$!][A-Za-z013457@$!]*[A-Za-z](?!\S)")
_ADDRESS = re.compile(r"\b(?:you|your|youre|u|tú|eres|tu|es|du|ihr|bist)\b(?:\W+\w+){0,3}?\W+(\w+)")
_ALL = {w: i for i, words in enumerate(LEXICONS.values()) for w in words.split()}


def features(words: set[str]) -> np.ndarray:
    """Distinct hash buckets of words and of the first five letters of longer ones."""
    crc, mask = zlib.crc32, (1 << BITS) - 1
    out = {crc(w.encode()) & mask for w in words}
    out |= {crc(b"^" + w[:5].encode()) & mask for w in words if len(w) > 5}
    return np.fromiter(out, np.int32, len(out))


def fixed_votes(text: str, words: set[str]) -> int:
    hit = words & _ALL.keys()
    bits = 0
    for w in hit:
        bits |= 1 << _ALL[w]
    at = len(LEXICONS)
    if hit and any(m[1] in hit for m in _ADDRESS.finditer(text.lower())):
        bits |= 1 << at
    if any(m.lower().translate(MASKS) in _ALL for m in _MASKED.findall(text)):
        bits |= 1 << (at + 1)
    if len(text) > 40 and sum(map(str.isupper, text)) * 2 > len(text):
        bits |= 1 << (at + 2)  # shouting
    if len(hit) >= 2:
        bits |= 1 << (at + 3)
    return bits


def votes(text: str, words: set[str], found: np.ndarray, induced: np.ndarray) -> int:
    """Bit i: voter i fires. induced: for each bucket the induced lexicon it is in, or -1."""
    bits = fixed_votes(text, words)
    for k in np.unique(induced[found]) if len(found) else ():
        if k >= 0:
            bits |= 1 << (len(LEXICONS) + 4 + int(k))
    return bits


def as_matrix(patterns: np.ndarray) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(VOTERS)) & 1).astype(float)


class LabelModel:
    """Two classes, voters that fire or abstain, labels as a voter of their own."""

    def fit(self, fired: np.ndarray, gold: np.ndarray, n: np.ndarray, rounds: int = 100, turns: int = 1) -> LabelModel:
        """fired: pattern x voter; gold: 0, 1 or -1 for none; n: documents of each pattern.

        Voters count as independent in the first turn; each further turn starts from the correlations that the last one left
        (held-out recall at 0.5 fell from 0.89 to 0.84 with a second turn at sf0.1, so one is the default).
        """
        q = np.where(gold == 1, 0.95, np.where(gold == 0, 0.05, np.where(fired.any(axis=1), 0.7, 0.05)))
        self.noise, self.share = 0.05, np.ones(fired.shape[1])
        for _ in range(turns):
            q = self.maximise(fired, gold, n, q, rounds)
            self.correlate(fired, n, q)
        return self

    def maximise(self, fired: np.ndarray, gold: np.ndarray, n: np.ndarray, q: np.ndarray, rounds: int) -> np.ndarray:
        """Rates, noise and balance by expectation maximisation under the present shares of evidence; gives the posteriors."""
        for _ in range(rounds):
            w = np.stack([n * (1 - q), n * q])
            self.balance = float(np.clip(w[1].sum() / max(w.sum(), 1), 1e-3, 0.9))
            self.rate = np.clip((w @ fired + np.array([[0.01], [0.2]])) / (w.sum(axis=1, keepdims=True) + 1), 1e-6, 1 - 1e-6)
            self.rate[1] = np.maximum(self.rate[1], self.rate[0])  # voters speak for toxic or not at all
            lab = gold >= 0
            if lab.any():
                wrong = np.where(gold == 1, 1 - q, q)
                self.noise = float(np.clip((wrong * n)[lab].sum() / n[lab].sum(), 0.005, 0.2))
            new = self.posterior(fired, gold)
            done = np.abs(new - q).max() < 1e-5
            q = new
            if done:
                break
        return q

    def correlate(self, fired: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        """Correlations of voters within the classes; correlated voters share their evidence."""
        rho = np.zeros((fired.shape[1],) * 2)
        for w in (n * (1 - q), n * q):
            total = max(w.sum(), 1e-9)
            p = w @ fired / total
            cov = (fired * w[:, None]).T @ fired / total - np.outer(p, p)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            rho += np.where(np.outer(sd, sd) > 1e-6, cov / np.outer(sd, sd), 0) * (total / max(n.sum(), 1e-9))
        np.fill_diagonal(rho, 0)
        self.rho = rho
        self.share = 1 / (1 + np.where(rho > 0.1, rho, 0).sum(axis=1))

    def posterior(self, fired: np.ndarray, gold: np.ndarray) -> np.ndarray:
        on, off = np.log(self.rate[1] / self.rate[0]), np.log((1 - self.rate[1]) / (1 - self.rate[0]))
        z = np.log(self.balance / (1 - self.balance)) + fired @ (on * self.share) + (1 - fired) @ (off * self.share)
        z = z + np.where(gold < 0, 0, np.where(gold == 1, 1, -1) * np.log((1 - self.noise) / self.noise))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(lists: list[np.ndarray], extra: np.ndarray, target: np.ndarray, size: int, rounds: int = 200, l2: float = 2e-3):
    """Weights of presence features and of `extra` columns, and the intercept, by full-batch Adam on soft targets."""
    cols = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    n = len(target)
    w, b = np.zeros(size + extra.shape[1]), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        z = b + np.bincount(row, w[cols], n) + extra @ w[size:]
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / n
        grad = np.concatenate((np.bincount(cols, g[row], size), g @ extra, [0])) + l2 * np.append(w, 0) / max(1, n) * 100
        grad[-1] = g.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


class Scorer:
    """Fitted state: induced lexicons, label model, classifier weights."""

    def __init__(self):
        self.induced = np.full(1 << BITS, -1, np.int8)
        self.weights = np.zeros(1 << BITS, np.float32)
        self.vote_weights, self.bias, self.model = np.zeros(VOTERS), 0.0, None

    def induce(self, lists: list[np.ndarray], gold: np.ndarray) -> np.ndarray:
        """Sorts telling buckets into the induced lexicons; gives the buckets that the classifier may use."""
        flat = np.concatenate([np.zeros(0, np.int32), *lists])
        y = np.repeat(gold, [len(x) for x in lists])
        df1, df0 = np.bincount(flat[y == 1], minlength=1 << BITS), np.bincount(flat[y == 0], minlength=1 << BITS)
        n1, n0 = max(1, (gold == 1).sum()), max(1, (gold == 0).sum())
        share = (n1 + 1) / (n1 + n0 + 2)
        df = df1 + df0
        z = (df1 - df * share) / np.sqrt(np.maximum(df * share * (1 - share), 1e-9))
        tell = np.flatnonzero((df >= 3) & (z > 4) & (df1 > 0.6 * df))
        tell = tell[np.argsort(-z[tell], kind="stable")]
        self.induced[tell] = np.arange(len(tell)) % INDUCED
        return np.flatnonzero((df >= 3) & (np.abs(z) > 3))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Scorer:
    """docs: doc_id and text of the learning documents; labels: doc_id and toxic, of which only theirs are used."""
    spark = docs.sparkSession
    gold = labels.select("doc_id", "toxic").filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("gold"))
    gold = gold.filter(common.bucket_of(F.col("doc_id"), 5) != 0)
    own = docs.select("doc_id", "text")
    sample = gold.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = own.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "gold")

    def listed(batches):
        for batch in batches:
            for part in common.slices(batch):
                texts = common.texts(part.column(1))
                words = [set(_WORD.findall(t.lower())) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([features(w) for w in words], pa.list_(pa.int32())), pa.array([fixed_votes(t, w) for t, w in zip(texts, words, strict=True)], pa.int32()), part.column(2)], names=["found", "bits", "gold"])

    got = sample.mapInArrow(common.task(listed), "found array<int>, bits int, gold int").toArrow()
    y = got["gold"].to_numpy().astype(int)
    flat = got["found"].combine_chunks()
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    lists = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    s = Scorer()
    usable = s.induce(lists, y)
    spread = spark.sparkContext.broadcast(s.induced)

    def voted(batches):
        induced = spread.value
        for batch in batches:
            for part in common.slices(batch):
                bits = []
                for text in common.texts(part.column(1)):
                    words = set(_WORD.findall(text.lower()))
                    bits.append(votes(text, words, features(words), induced))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bits, pa.int32())], names=["doc_id", "bits"])

    counted = own.mapInArrow(common.task(voted), "doc_id long, bits int").join(gold, "doc_id", "left").groupBy("bits", F.coalesce("gold", F.lit(-1)).alias("gold")).count().toPandas()
    if not len(counted):
        return s
    s.model = LabelModel().fit(as_matrix(counted["bits"].to_numpy()), counted["gold"].to_numpy(), counted["count"].to_numpy().astype(float))
    if not len(y):  # no labels: the classifier is the label model's own weights
        on = np.log(s.model.rate[1] / s.model.rate[0]) - np.log((1 - s.model.rate[1]) / (1 - s.model.rate[0]))
        s.vote_weights = on * s.model.share
        off = (np.log((1 - s.model.rate[1]) / (1 - s.model.rate[0])) * s.model.share).sum()
        s.bias = float(np.log(s.model.balance / (1 - s.model.balance)) + off)
        return s
    bits = got["bits"].to_numpy().astype(int)
    for i, x in enumerate(lists):
        for k in np.unique(s.induced[x]) if len(x) else ():
            if k >= 0:
                bits[i] |= 1 << (len(LEXICONS) + 4 + int(k))
    number = np.full(1 << BITS, -1, np.int32)
    number[usable] = np.arange(len(usable))
    lists = [k[k >= 0] for k in (number[x] for x in lists)]
    del got, flat, values
    more, more_bits = _unlabelled(own, gold, fit_rows, s.induced, number)
    fired = as_matrix(np.concatenate((bits, more_bits)))
    target = s.model.posterior(fired, np.concatenate((y, np.full(len(more_bits), -1))))
    w, s.bias = _logistic(lists + more, fired, target, len(usable))
    s.weights[usable] = w[: len(usable)]
    s.vote_weights = w[len(usable) :]
    return s


def _unlabelled(own: DataFrame, gold: DataFrame, rows: int, induced: np.ndarray, number: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbered features and votes of up to `rows` documents without a label, those of the lowest hashes of doc_id."""
    free = own.select("doc_id").filter("doc_id is not null").join(gold, "doc_id", "left_anti").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    spread = own.sparkSession.sparkContext.broadcast((induced, number))

    def listed(batches):
        induced, number = spread.value
        for batch in batches:
            for part in common.slices(batch):
                found, bits = [], []
                for text in common.texts(part.column(1)):
                    words = set(_WORD.findall(text.lower()))
                    x = features(words)
                    bits.append(votes(text, words, x, induced))
                    x = number[x]
                    found.append(x[x >= 0])
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(bits, pa.int32())], names=["found", "bits"])

    got = own.join(F.broadcast(free), "doc_id").select("doc_id", "text").mapInArrow(common.task(listed), "found array<int>, bits int").toArrow()
    flat = got["found"].combine_chunks()
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], got["bits"].to_numpy().astype(int)


def _probabilities(s: Scorer, texts: list[str]) -> tuple[np.ndarray, list[int]]:
    z, bits = [], []
    for text in texts:
        words = set(_WORD.findall(text.lower()))
        found = features(words)
        bits.append(votes(text, words, found, s.induced))
        z.append(s.bias + float(s.weights[found].sum()))
    z = np.array(z, np.float64) + as_matrix(np.array(bits, np.int64)) @ s.vote_weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30))), bits


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score, predicted and the votes (bits) of every document."""
    spread = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        s = spread.value
        for batch in batches:
            for part in common.slices(batch):
                p, bits = _probabilities(s, common.texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(bits, pa.int32())], names=["doc_id", "score", "predicted", "votes"])

    return docs.select("doc_id", "text").mapInArrow(common.task(run), "doc_id long, score double, predicted int, votes int")


def accepted(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """The rows of docs, all columns in place, whose text is not predicted toxic. Filters within the scan, without a join."""
    names, schema = docs.columns, docs.schema
    at = names.index("text")
    spread = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        s = spread.value
        for batch in batches:
            for part in common.slices(batch):
                yield part.filter(pa.array(_probabilities(s, common.texts(part.column(at)))[0] < 0.5))

    return docs.select(*names).mapInArrow(common.task(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Learns outside the held-out fold and scores all: doc_id, held_out, score, predicted, votes."""
    held = common.bucket_of(F.col("doc_id"), 5) == 0
    out = score(docs, fit(docs.select("doc_id", "text").filter(~held), labels, fit_rows))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "votes")
