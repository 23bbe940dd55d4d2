"""Operator 8, language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language. A word's probability in a language is the sum over
all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. Probabilities are fitted by
expectation maximisation, whose expected piece counts come from the forward and backward sums. Sums are kept as logarithms, so
words of any length are treated whole.

What is learned from: a sample of labelled documents, ``sample_docs`` a language in expectation, chosen by a hash of the id, with
all their words. Rounds go on until none raises a language's log likelihood by more than a part ``SETTLED`` of it. Tasks sum the
expected counts of their words; the driver gets a number a piece and language in each round.
Documents with crc32(id as text) mod 4 = 2 are held out, and so are those without id or label. A prediction sees the text alone.

Nulls and edge cases: a text that is null or has no letter gets ``und`` with score 0, and so does every text if nothing was
learned; ids may be null or repeated, each row stands for itself; texts are scored whole; equal likelihoods go to the first
language by code point. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import vocabulary
from .workspace import Workspace

VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"
#: The bound on what is learned from: documents a language, in expectation.
SAMPLE_DOCS = 1500
#: Fitting ends when a round raises no language's log likelihood by more than this part of it.
SETTLED = 1e-4
#: Letters of words that are treated at once, but for a longer word.
_LETTERS = 100_000
#: Expected counts are summed across tasks as whole numbers of this part, so that their order is of no effect.
_UNIT = 2.0**-24
_SHARDS = 16
_WORDS = re.compile(r"[^\W\d_]+")
_CACHE_WORDS = 400_000


def pieces_of(name: str = VOCABULARY) -> list[str]:
    """Lower-case letter pieces of the vocabulary, with ``^`` for the start of a word; single letters are always possible."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary(name))
    found = {model.id_to_piece(i).replace("▁", "^").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p and p.removeprefix("^").isalpha())


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def _batches(words: list[str]) -> Iterator[slice]:
    """Consecutive words of about ``_LETTERS`` letters together."""
    start = letters = 0
    for i, w in enumerate(words):
        letters += len(w)
        if letters >= _LETTERS:
            yield slice(start, i + 1)
            start, letters = i + 1, 0
    if start < len(words):
        yield slice(start, len(words))


def _steps(when: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arcs by ``when``: for each value the arcs in order of ``at``, where each place's arcs begin, how many they are, and the places."""
    order = np.lexsort((at, when))
    limits = np.flatnonzero(np.diff(when[order])) + 1
    out = []
    for arcs in np.split(order, limits):
        places = at[arcs]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1])
        out.append((arcs, begin, np.diff(begin, append=len(arcs)), places[begin]))
    return out


def _log_sums(x: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    top = np.maximum.reduceat(x, begin)
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, sizes, axis=0)), begin))


class Lattice:
    """All segmentations of words of one batch: which piece leads from which place to which. A word of n letters has n + 1 places."""

    def __init__(self, words: list[str], ids: dict[str, int], longest: int):
        unknown = len(ids)
        lengths = np.array([len(w) for w in words])
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.last = self.first + lengths
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        found = []
        for n, members in by_length.items():
            group, numbers = [words[i] for i in members], np.array(members)
            if len(group) < 8:  # few words, which may be long
                for i, w in zip(members, group, strict=True):
                    get = ids.get
                    arcs = [(i, start, end, piece) for end in range(1, n + 1) for start in range(max(0, end - longest), end) if (piece := get(w[start:end], unknown if end - start == 1 else -1)) >= 0]
                    found.append(np.array(arcs).T)
                continue
            for end in range(1, n + 1):
                for start in range(max(0, end - longest), end):
                    other = unknown if end - start == 1 else -1
                    got = np.array([ids.get(w[start:end], other) for w in group])
                    (at,) = np.nonzero(got >= 0)
                    if len(at):
                        found.append(np.stack([numbers[at], np.full(len(at), start), np.full(len(at), end), got[at]]))
        self.word, start, end, self.piece = np.concatenate(found, axis=1)
        self.source, self.target = self.first[self.word] + start, self.first[self.word] + end
        self.ends, self.starts = _steps(end, self.target), (start, self.source)

    def _forward(self, logs: np.ndarray) -> np.ndarray:
        out = np.zeros((self.last[-1] + 1, logs.shape[1]))
        for arcs, begin, sizes, places in self.ends:
            out[places] = _log_sums(out[self.source[arcs]] + logs[self.piece[arcs]], begin, sizes)
        return out

    def forward(self, p: np.ndarray, n_words: int) -> np.ndarray:
        """Log probability of each word in each language; ``p`` is by piece and language."""
        return self._forward(np.log(p))[self.last] if n_words else np.zeros((0, p.shape[1]))

    def summed(self, p: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected number of each piece in each language over words that occur ``weight`` times, and their log likelihood."""
        logs = np.log(p)
        alpha = self._forward(logs)
        beta = np.zeros_like(alpha)
        for arcs, begin, sizes, places in reversed(_steps(*self.starts)):
            beta[places] = _log_sums(beta[self.target[arcs]] + logs[self.piece[arcs]], begin, sizes)
        whole = alpha[self.last]
        gain = np.exp(alpha[self.source] + logs[self.piece] + beta[self.target] - whole[self.word]) * weight[self.word]
        return np.stack([np.bincount(self.piece, g, len(p)) for g in gain.T], axis=1), (whole * weight).sum(axis=0)

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return self.summed(p, weight)[0]


class Model(NamedTuple):
    languages: list[str]
    ids: dict[str, int]
    p: np.ndarray  # by piece and language; the last row is for letters that no piece covers
    longest: int
    name: int = 0  # a checksum of the probabilities


def _language_sums(words: list[str], weight: list[int], ids: dict[str, int], longest: int, p: np.ndarray) -> tuple[np.ndarray, float]:
    """Expected piece counts and log likelihood of the words of one language, whose probabilities are ``p``."""
    order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))
    words, n = [f"^{words[i]}" for i in order], np.array([weight[i] for i in order], float)
    seen, likelihood = np.zeros(len(p)), 0.0
    for part in _batches(words):
        more, value = Lattice(words[part], ids, longest).summed(p[:, None], n[part, None])
        seen += more[:, 0]
        likelihood += float(value[0])
    return seen, likelihood


def _climb(languages: list[str], ids: dict[str, int], longest: int, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], rounds: int | None, smoothing: float) -> Model:
    """Expectation maximisation; ``sums`` gives expected counts and log likelihoods by language. Without ``rounds``, until it settles."""
    p = np.full((len(ids) + 1, len(languages)), 1 / (len(ids) + 1))
    before, done = None, 0
    while rounds is None or done < rounds:
        seen, likelihood = sums(p)
        if rounds is None and before is not None and (likelihood - before <= SETTLED * np.abs(before)).all():
            break
        seen = seen + smoothing / (len(ids) + 1)
        p, before, done = seen / seen.sum(axis=0), likelihood, done + 1
    return Model(languages, ids, p, longest, zlib.crc32(p.tobytes() + repr(languages).encode()))


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int | None = None, smoothing: float = 0.1) -> Model:
    """``counts``: words of each language and how often each occurs."""
    languages = sorted(counts)
    ids = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)

    def sums(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seen, likelihood = zip(*(_language_sums(list(counts[k]), list(counts[k].values()), ids, longest, p[:, j]) for j, k in enumerate(languages)), strict=True)
        return np.stack(seen, axis=1), np.array(likelihood)

    return _climb(languages, ids, longest, sums, rounds, smoothing)


def fit_table(words: DataFrame, pieces: list[str], rounds: int | None = None, smoothing: float = 0.1) -> Model:
    """As ``fit``, of a table lang, word, n. Every row is used; tasks sum over their words."""
    spark = words.sparkSession
    work = Workspace(spark, "language")
    kept = work.save(words.repartition(_SHARDS, "lang", "word").sortWithinPartitions("lang", "word"), "words")
    languages = sorted(r[0] for r in kept.select("lang").distinct().collect())  # a row a language
    ids = {p: i for i, p in enumerate(pieces)}
    longest = max(map(len, pieces), default=1)
    numbers = {k: j for j, k in enumerate(languages)}

    def sums(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((ids, p))  # pieces times languages

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, p = shared.value
            mine: dict[str, tuple[list[str], list[int]]] = {}
            totals = {}

            def flush() -> None:
                for lang, (w, n) in mine.items():
                    seen, likelihood = _language_sums(w, n, ids, longest, p[:, numbers[lang]])
                    had = totals.get(lang, (0, 0.0))
                    totals[lang] = had[0] + seen, had[1] + likelihood
                mine.clear()

            for batch in batches:
                for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    w, ns = mine.setdefault(lang, ([], []))
                    w.append(word)
                    ns.append(n)
                flush()
            for lang, (seen, likelihood) in totals.items():
                (at,) = np.nonzero(seen)
                at, values = np.append(at, -1), np.append(seen[at], likelihood)  # the likelihood under -1
                yield pa.RecordBatch.from_pydict({"lang": pa.array(np.full(len(at), numbers[lang], np.int32)), "piece": pa.array(at.astype(np.int32)), "units": pa.array(np.rint(values / _UNIT).astype(np.int64))})

        got = kept.mapInArrow(task, "lang int, piece int, units long").groupBy("lang", "piece").agg(F.sum("units").alias("units")).toArrow()
        lang, piece, value = (got.column(c).to_numpy() for c in ("lang", "piece", "units"))
        shared.destroy()
        seen, likelihood = np.zeros(p.shape), np.zeros(len(languages))
        counts = piece >= 0
        seen[piece[counts], lang[counts]] = value[counts] * _UNIT
        likelihood[lang[~counts]] = value[~counts] * _UNIT
        return seen, likelihood

    model = _climb(languages, ids, longest, sums, rounds, smoothing) if languages else Model([], {}, np.ones((1, 0)), 1)
    work.drop("words")
    return model


class Scorer:
    """Scores texts in a task. Words are scored once and kept in a table that is emptied when it is full."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.logs = np.zeros((1 << 12, len(model.languages)))

    def _learn(self, words: list[str]) -> None:
        """Scores new words, in rows after those that are known."""
        words.sort(key=len)
        flat = [f"^{w}" for w in words]
        logs = np.concatenate([Lattice(flat[part], self.model.ids, self.model.longest).forward(self.model.p, part.stop - part.start) for part in _batches(flat)])
        n = len(self.rows)
        while len(self.logs) < n + len(words):
            self.logs = np.concatenate([self.logs, np.zeros_like(self.logs)])
        self.logs[n : n + len(words)] = logs
        self.rows.update(zip(words, range(n, n + len(words)), strict=True))

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        if len(self.rows) > _CACHE_WORDS:
            self.rows.clear()
        new = list(set().union(*words).difference(self.rows))
        if new:
            self._learn(new)
        out = np.zeros((len(texts), len(self.model.languages)))
        for i, w in enumerate(words):
            if w:
                out[i] = self.logs[np.fromiter(map(self.rows.__getitem__, w), np.int64, len(w))].sum(axis=0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and posterior probability under equal priors."""
        has = [bool(t) and any(map(str.isalpha, t)) and bool(self.model.languages) for t in texts]
        logs = iter(self.log_likelihoods([t for t, h in zip(texts, has, strict=True) if h]) if any(has) else ())
        out = []
        for h in has:
            if not h:
                out.append((UNKNOWN, 0.0))
                continue
            row = next(logs)
            best = int(row.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(row - row[best]).sum())))
        return out


_scorers: dict[int, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """One scorer a worker process: the words of one task serve the next of the same model."""
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, rounds: int | None = None, vocabulary_name: str = VOCABULARY) -> Model:
    """Fits the model on all words of the sampled documents, in ``rounds`` or until it settles. Counting words is a job, as is each round."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}  # a row a language
    if not sizes:
        return Model([], {}, np.ones((1, 0)), 1)
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample_docs / n))))
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(draw < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text or ""))
        for lang, c in counts.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "word": pa.array(list(c), pa.string()), "n": pa.array(list(c.values()), pa.int64())})

    words = sample.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return fit_table(words, pieces_of(vocabulary_name), rounds)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` under a leading ``in_``, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pieces times languages
    chosen = docs.select(*(F.col(c).alias(f"in_{c}") for c in keep), F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared.value)
        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.slice(i, 256)
                langs, scores = zip(*scorer.predict(some.column(len(keep)).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[: len(keep)], "lang_pred", "score"])

    return chosen.mapInArrow(score, f"{kinds}, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """Learns from ``docs`` and predicts all of them: doc_id, held_out, lang_pred, score."""
    found = predict(docs, learn(docs, id_col, text_col, lang_col, **how), text_col, (id_col,))
    return found.select(F.col(f"in_{id_col}").alias("doc_id"), held_out(F.col(f"in_{id_col}")).alias("held_out"), "lang_pred", "score")
