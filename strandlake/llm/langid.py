"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all of
its segmentations into pieces, by the forward algorithm; a text's is the product over its words. Probabilities are
fitted by expectation-maximisation (forward-backward over the same segmentations), starting from the vocabulary's own
segmentation. The prediction is the most likely language, the score its posterior under equal priors.

Words are runs of letters, lower-cased, with the space mark in front, whatever their length: the forward sums of a word are
scaled up, by language, before they get too small for their format. A letter without a piece has the same small probability in every language. The model is fitted on a sample of
labelled documents: at most ``sample`` a language, by least hash in that many hash cells, which is bounded and does not
depend on how rows are dealt. Everything else covers whole texts of all rows.

Texts of any length are scored whole; equal texts of repeated rows get equal rows, and an empty table gives none.
A null text or one without a letter is ``und`` with score 0, as is every text if nothing can be learned. Equal
likelihoods: the first language in order of name. Documents whose crc32(doc_id as text) mod 3 is 1 are held out.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept, rows_of, values_of

SPACE = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = 1e-9
TEXTS_AT_ONCE = 256
#: Forward sums below this are scaled up; places of a word that are looked up at once.
SMALL, PLACES = 1e-120, 4096


class Vocabulary:
    """A trie over the pieces that words can hold, as a table: next[node, class of a character]; node 0 is none, 1 the root."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces = list(pieces)
        usable = [(i, p) for i, p in enumerate(self.pieces) if LETTERS.fullmatch(p.lstrip(SPACE) or "a") and p == p.lower()]
        self.longest = max((len(p) for _, p in usable), default=1)
        self.classes = np.zeros(0x110000, np.int16)
        chars = sorted({c for _, p in usable if len(p) > 1 for c in p})
        self.classes[[ord(c) for c in chars]] = range(1, len(chars) + 1)
        #: Characters that are pieces by themselves, whether or not longer ones hold them.
        self.single = np.full(0x110000, -1, np.int32)
        self.single[[ord(p) for _, p in usable if len(p) == 1]] = [i for i, p in usable if len(p) == 1]
        nodes = {"": 1}
        for _, p in usable:
            if len(p) > 1:
                for i in range(1, len(p) + 1):
                    nodes.setdefault(p[:i], len(nodes) + 1)
        self.next = np.zeros((len(nodes) + 1, len(chars) + 1), np.int32)
        for p, node in nodes.items():
            if p:
                self.next[nodes[p[:-1]], self.classes[ord(p[-1])]] = node
        self.piece_at = np.full(len(nodes) + 1, -2, np.int32)
        for i, p in usable:
            if len(p) > 1:
                self.piece_at[nodes[p]] = i

    def lattice(self, words: Sequence[str]) -> np.ndarray:
        """For words of one length: the id of the piece from each start of each length; -1 for a letter without a piece, -2 for none."""
        n, most = len(words[0]), min(len(words[0]), self.longest)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
        classes = self.classes[points]
        out = np.full((len(words), n, most), -2, np.int32)
        out[:, :, 0] = self.single[points]
        for start in range(n):
            node = self.next[1, classes[:, start]]
            for m in range(1, min(most, n - start)):
                node = self.next[node, classes[:, start + m]]
                if not node.any():
                    break
                out[:, start, m] = self.piece_at[node]
        return out


@dataclass
class Model:
    pieces: list[str]
    languages: list[str]
    table: np.ndarray  # (pieces + 2, languages): the last two are none (0) and a letter without a piece


def by_length(words: Iterable[str]) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


class Sums:
    """Sums over the segmentations of what comes before a place of each word, by language: values times exp(scales)."""

    def __init__(self, words: int, languages: int, reach: int):
        self.near = np.zeros((words, reach, languages))  # of the last places, the latest first, all at the present scale
        self.near[:, 0] = 1
        self.scale = np.zeros((words, languages))

    def step(self, probabilities: np.ndarray) -> np.ndarray:
        """To the next place. probabilities: (words, length, languages), of the pieces that end there."""
        now = np.einsum("wml,wml->wl", self.near[:, : probabilities.shape[1]], probabilities)
        self.near[:, 1:] = self.near[:, :-1]
        self.near[:, 0] = now
        if now.min(initial=1.0) < SMALL:
            top = self.near.max(1)
            by = np.where((top > 0) & (top < SMALL), top, 1.0)
            self.near /= by[:, None]
            self.scale += np.log(by)
        return self.near[:, 0]


def log_likelihoods(words: Sequence[str], vocabulary: Vocabulary, table: np.ndarray) -> np.ndarray:
    """For words of one length: log of the sum over all segmentations, by language; a part of a long word at a time."""
    n, reach = len(words[0]), min(len(words[0]), vocabulary.longest)
    sums = Sums(len(words), table.shape[1], reach)
    for at in range(0, n, PLACES):
        first = max(0, at - reach + 1)
        lattice = vocabulary.lattice([w[first : at + PLACES] for w in words])
        for end in range(at + 1, min(n, at + PLACES) + 1):
            lengths = np.arange(min(lattice.shape[2], end - first))
            sums.step(table[lattice[:, end - first - 1 - lengths, lengths]])
    with np.errstate(divide="ignore"):
        return np.log(sums.near[:, 0]) + sums.scale


def expected(words: dict[str, np.ndarray], vocabulary: Vocabulary, table: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language. words: how often each language has it."""
    out = np.zeros_like(table)
    for n, group in by_length(words).items():
        step = max(1, 100_000 // n)
        for at in range(0, len(group), step):
            part = group[at : at + step]
            lattice, often = vocabulary.lattice(part), np.array([words[w] for w in part])
            most, shape = lattice.shape[2], (len(part), n + 1, table.shape[1])
            before, after = (np.zeros(shape), np.zeros(shape)), (np.zeros(shape), np.zeros(shape))  # values, scales
            for (values, scales), back in ((before, False), (after, True)):
                sums = Sums(len(part), table.shape[1], most)
                values[:, n if back else 0] = 1
                for k in range(1, n + 1):
                    lengths = np.arange(min(most, k))
                    ids = lattice[:, n - k, lengths] if back else lattice[:, k - 1 - lengths, lengths]
                    values[:, n - k if back else k] = sums.step(table[ids])
                    scales[:, n - k if back else k] = sums.scale
            for start in range(n):
                for m in range(min(most, n - start)):
                    ids = lattice[:, start, m]
                    used = np.flatnonzero(ids >= 0)
                    if len(used):
                        i, end = ids[used], start + m + 1
                        total, shift = before[0][used, n], before[1][used, start] + after[1][used, end] - before[1][used, n]
                        share = before[0][used, start] * table[i] * after[0][used, end] * np.exp(np.minimum(shift, 700))
                        np.add.at(out, i, np.divide(share * often[used], total, out=np.zeros_like(total), where=total > 0))
    return out


def words_of(text: str) -> list[str]:
    return [SPACE + run for run in LETTERS.findall(text.lower())]


def fit(texts: Iterable[tuple[str, str]], model: bytes, rounds: int = 2, smooth: float = 0.1) -> Model:
    """From (language, text) and the vocabulary's model file."""
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size()) if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i))]
    vocabulary, ids = Vocabulary(pieces), {p: i for i, p in enumerate(pieces)}
    counts: dict[str, Counter[str]] = {}
    for lang, text in texts:
        counts.setdefault(lang, Counter()).update(words_of(text))
    languages = sorted(counts)
    words: dict[str, np.ndarray] = {}
    for k, lang in enumerate(languages):
        for w, c in counts[lang].items():
            words.setdefault(w, np.zeros(len(languages)))[k] = c
    uses = np.zeros((len(pieces) + 2, len(languages)))
    for w, cut in zip(words, library.encode([w[1:] for w in words], out_type=str), strict=True) if words else ():
        for p in cut:
            if p in ids:
                uses[ids[p]] += words[w]

    def normal(c: np.ndarray) -> np.ndarray:
        out = (c + smooth) / (c[:-2].sum(0) + smooth * len(pieces))
        out[-2], out[-1] = 0, UNKNOWN
        return out

    table = normal(uses)
    for _ in range(rounds):
        table = normal(expected(words, vocabulary, table))
    return Model(pieces, languages, table)


class Judge:
    """Log likelihoods of texts. Those of words are remembered."""

    def __init__(self, model: Model, remembered: int = 100_000):
        self.model, self.vocabulary, self.remembered = model, Vocabulary(model.pieces), remembered
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages)))

    def learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.known]
        while len(self.rows) < len(self.known) + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for n, group in by_length(new).items():
            step = max(1, min(8192, 400_000 // n))
            for at in range(0, len(group), step):
                part, first = group[at : at + step], len(self.known)
                self.rows[first : first + len(part)] = log_likelihoods(part, self.vocabulary, self.model.table)
                self.known |= zip(part, range(first, first + len(part)), strict=True)

    def judge(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) if t else [] for t in texts]
        if len(self.known) > self.remembered:
            self.forget()
        self.learn({w for ws in split for w in ws})
        out = []
        for text, ws in zip(texts, split, strict=True):
            if not self.model.languages or not ws or not any(map(str.isalpha, text)):
                out.append(("und", 0.0))
                continue
            total = self.rows[[self.known[w] for w in ws]].sum(0)
            best = int(np.argmax(total))
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, sample: int) -> list[tuple[str, str]]:
    """At most ``sample`` (language, text) a language, of documents that aren't held out."""
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    cell = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(sample))
    chosen = rows.groupBy("lang", cell.alias("cell")).agg(F.min(F.struct(F.xxhash64(F.lit(12), "doc_id").alias("h"), "doc_id")).alias("m")).select(F.col("lang").alias("of"), F.col("m.doc_id").alias("chosen"))
    ids = chosen.collect()  # at most sample rows a language
    picked = docs.sparkSession.createDataFrame(ids, chosen.schema)
    got = rows.join(F.broadcast(picked), (F.col("doc_id") == F.col("chosen")) & (F.col("lang") == F.col("of"))).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).collect()
    return [(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["lang"], r["doc_id"]))]


PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def train(docs: DataFrame, vocabulary_path: str, sample: int = 200, rounds: int = 2) -> Model:
    with open(vocabulary_path, "rb") as f:
        return fit(training_rows(docs, sample), f.read(), rounds)


def identify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = spark.sparkContext.broadcast(model)  # the vocabulary times the languages
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = kept("judge", key, lambda: Judge(shared.value))
        for ids, held, texts in rows_of(batches, TEXTS_AT_ONCE):
            if ids:
                got = judge.judge(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], schema=PREDICTED)

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held"), "text")
    return source.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def accepted(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents with a language whose posterior is at least ``least``, all columns as they were."""
    shared = spark.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    @F.arrow_udf("boolean")
    def passes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = kept("judge", key, lambda: Judge(shared.value))
        for texts in batches:
            yield pa.array([lang != "und" and score >= least for part in values_of(texts, TEXTS_AT_ONCE) for lang, score in judge.judge(part)], pa.bool_())

    return docs.filter(passes("text"))
