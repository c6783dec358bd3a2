"""Toxicity by a weighted finite-state grammar over clauses.

A text is read as clauses of words, and a word as a tag: insult (a weighted prefix lexicon), threat,
target, negation, report or other.  Five weighted transducers over tags, written as tables, give
an insult or a threat its weight in its place: less soon after a negation or in reported speech,
more near a target; a threat counts only near a target, and less with every word between.  Four
are composed into one table that walks the clause forwards; that of targets walks it both ways,
and the better path counts.  The clauses' weights, not the words alone, make the features of a
document.

The insult lexicon is learned: of the words and word beginnings in toxic labelled texts those
stay whose odds speak for toxicity by more than their standard error.  A logistic layer over the
clause features is fitted across folds, each text being read with a lexicon that has not seen it;
the folds also choose whether the sum of the weights enters as it is or by its logarithm.  All are fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``); every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.common import small_batches, text_or_empty
from farpoint.session import materialize

#: Labelled rows that the lexicon and the weights are fitted on, at most.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
FOLDS = 5
LEAST_PREFIX, LONGEST_PREFIX = 3, 8
#: Words around an insult in which a negation or a target counts.
REACH = 3

# Words that the transducers know without labels.
INSULTS = (
    "idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting",
    "dumb", "imbecile", "idiotisch", "dummkopf", "abschaum", "imbécile", "connard", "crétin",
    "estúpido", "imbécil", "basura",
)
THREATS = ("kill", "hurt", "destroy", "beat", "töten", "umbringen", "tuer", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "they", "he", "she", "du", "ihr", "dich", "tu", "vous", "toi", "tú", "usted", "ellos")
NEGATIONS = ("not", "never", "isn", "aren", "nicht", "kein", "keine", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "called", "quoted", "sagte", "nannte", "disait", "appelé", "dijo", "llamó")
SEED_WEIGHT = 2.5
AFTER_NEGATION, REPORTED, AT_TARGET, THREAT_WEIGHT = 0.7, 0.8, 1.15, 2.0
#: Weight of a threat by its distance from a target, up to ``REACH`` words.
AIMED = (1.0, 0.75, 0.5)

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:|\n]")
_ENDS = frozenset(".!?;:|\n")
#: Weights of the features before any label: bias, sum and greatest of the clause weights, kinds of words, densities.
PRIOR = (-4.0, 0.5, 1.5, 0.0, 0.0, 0.0)


# --- transducers -------------------------------------------------------------

TAGS = OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)


@dataclass(frozen=True)
class Transducer:
    """``moves[state][tag]`` is the next state and the weight of a word with that tag; the first state is 0."""

    moves: tuple[tuple[tuple[int, float], ...], ...]

    def states(self, tags: list[int]) -> list[int]:
        """The state before each word."""
        state, out = 0, []
        for tag in tags:
            out.append(state)
            state = self.moves[state][tag][0]
        return out


def transducer(states: int, step: Callable[[int, int], int], weight: Callable[[int, int], float]) -> Transducer:
    return Transducer(tuple(tuple((step(s, t), weight(s, t)) for t in TAGS) for s in range(states)))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """Both at once: a state for every pair that can be reached, weights multiplied."""
    places, order, rows = {(0, 0): 0}, [(0, 0)], []
    for p, q in order:  # grows as pairs are found
        row = []
        for tag in TAGS:
            (p2, u), (q2, v) = a.moves[p][tag], b.moves[q][tag]
            if (p2, q2) not in places:
                places[p2, q2] = len(order)
                order.append((p2, q2))
            row.append((places[p2, q2], u * v))
        rows.append(tuple(row))
    return Transducer(tuple(rows))


def _since(tag: int) -> Callable[[int, int], int]:
    """States that count down the words within reach of the last one with ``tag``."""
    return lambda state, now: REACH if now == tag else max(0, state - 1)


_MATCHED = (INSULT, THREAT)
#: The word's own weight: an insult's comes from the lexicon and is one here.
INSULTING = transducer(1, lambda s, t: 0, lambda s, t: 1.0)
THREATENING = transducer(1, lambda s, t: 0, lambda s, t: THREAT_WEIGHT if t == THREAT else 1.0)
NEGATING = transducer(REACH + 1, _since(NEGATION), lambda s, t: AFTER_NEGATION if s and t in _MATCHED else 1.0)
REPORTING = transducer(2, lambda s, t: int(s or t == REPORT), lambda s, t: REPORTED if s and t in _MATCHED else 1.0)


def _aimed(state: int, tag: int) -> float:
    if tag == INSULT:
        return AT_TARGET if state else 1.0
    if tag == THREAT:
        return AIMED[REACH - state] if state else 0.0
    return 1.0


TARGETING = transducer(REACH + 1, _since(TARGET), _aimed)
CONTEXT = compose(compose(INSULTING, THREATENING), compose(NEGATING, REPORTING))


# --- the grammar -------------------------------------------------------------

#: How the sum of the weights enters the layer.
FORMS = {"sum": float, "log": math.log1p}


def _beginnings(word: str) -> list[str]:
    """The lexicon entries that cover a word: itself and its proper beginnings."""
    return ["=" + word, *(word[:k] for k in range(LEAST_PREFIX, min(LONGEST_PREFIX, len(word) - 1) + 1))]


@dataclass
class Grammar:
    """The lexicon of insults (``=word`` or a beginning, to its weight), the weights of the features and the sum's form."""

    lexicon: dict[str, float]
    layer: tuple[float, ...] = PRIOR
    form: str = "sum"

    def __post_init__(self) -> None:
        self._known: dict[str, float] = {}
        self._threats = frozenset(THREATS)
        self._tags = {w: THREAT for w in THREATS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS} | {w: TARGET for w in TARGETS}

    def __reduce__(self):
        return Grammar, (self.lexicon, self.layer, self.form)

    def insult(self, word: str) -> float:
        weight = self._known.get(word)
        if weight is None:
            if len(self._known) > 400_000:
                self._known.clear()
            weight = self._known[word] = max(0.0, *(self.lexicon.get(b, 0.0) for b in _beginnings(word)))
        return weight

    def clause(self, words: list[str]) -> dict[str, float]:
        """Weight of every insult of one clause, and of its heaviest threat, in their places."""
        found: dict[str, float] = {}
        weights = [self.insult(word) for word in words]
        tags = [self._tags.get(word) or (INSULT if weight else OTHER) for word, weight in zip(words, weights)]
        context, before = CONTEXT.states(tags), TARGETING.states(tags)
        after = TARGETING.states(tags[::-1])[::-1]
        for at, (word, weight, tag) in enumerate(zip(words, weights, tags)):
            if weight:
                found[word] = max(found.get(word, 0.0), weight * self._placed(INSULT, context[at], before[at], after[at]))
            if tag == THREAT:
                threat = self._placed(THREAT, context[at], before[at], after[at])
                if threat:
                    found["threat"] = max(found.get("threat", 0.0), threat)
        return found

    @staticmethod
    def _placed(tag: int, context: int, before: int, after: int) -> float:
        """The weight of the better of two paths: to a target before, or after."""
        return CONTEXT.moves[context][tag][1] * max(TARGETING.moves[before][tag][1], TARGETING.moves[after][tag][1])

    def features(self, text: str) -> list[float]:
        tokens = _TOKEN.findall(text.lower())
        weigh, known = self.insult, self._known.get
        kinds = set(tokens)
        kinds -= _ENDS
        if not any((weigh(w) if (v := known(w)) is None else v) for w in kinds) and kinds.isdisjoint(self._threats):
            return [1.0, 0.0, 0.0, math.log1p(len(kinds)), 0.0, 0.0]
        best: dict[str, float] = {}
        clause: list[str] = []
        live = False
        for token in [*tokens, "."]:
            if token in _ENDS:
                if live:
                    for word, weight in self.clause(clause).items():
                        best[word] = max(best.get(word, 0.0), weight)
                clause, live = [], False
            else:
                clause.append(token)
                live = live or weigh(token) > 0 or token in self._threats
        weights = sorted(best.values(), reverse=True)
        root = math.sqrt(len(kinds) + 1)
        top = weights[0] if weights else 0.0
        return [1.0, FORMS[self.form](sum(weights)), top, math.log1p(len(kinds)), len(weights) / root, sum(weights) / root]

    def score(self, text: str) -> float:
        at = sum(a * b for a, b in zip(self.layer, self.features(text)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, at))))


# --- fitting -----------------------------------------------------------------


def _counted(rows: DataFrame, wanted=None) -> DataFrame:
    """``(entry, fold, n)``: texts of each fold that hold an entry; ``wanted``: a broadcast set of entries."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_TOKEN.findall(text.lower())) - _ENDS
                entries = {b for w in words for b in _beginnings(w)}
                if wanted is not None:
                    entries &= wanted.value
                held.update((e, fold) for e in entries)
            if len(held) > 300_000:
                yield flushed(held)
        yield flushed(held)

    def flushed(held: Counter) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pydict(
            {
                "entry": pa.array([e for e, _ in held], pa.string()),
                "fold": pa.array([f for _, f in held], pa.int32()),
                "n": pa.array(list(held.values()), pa.int64()),
            }
        )
        held.clear()
        return batch

    return rows.select("fold", "text").mapInArrow(counts, "entry string, fold int, n long")


def _by_fold(counted: DataFrame, mark: str) -> DataFrame:
    """One row per entry: texts in each fold, and in all."""
    folds = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"{mark}_{f}") for f in range(FOLDS)]
    return counted.groupBy("entry").agg(*folds, F.sum("n").alias(f"{mark}_all"))


def _least(n_toxic: int) -> float:
    """Toxic texts that an entry must be in."""
    return max(3, 0.005 * n_toxic)


def _lexicons(sample: DataFrame, n_toxic: dict, n_clean: dict) -> list[dict[str, float]]:
    """Lexicons that leave out each fold, and one of all: entries whose log odds, less a standard error, speak for toxicity."""
    context = sample.sparkSession.sparkContext
    often = F.col("ones_all") >= _least(sum(n_toxic.values()) * (FOLDS - 1) // FOLDS)
    toxic = materialize(_by_fold(_counted(sample.where("toxic = 1")), "ones").where(often), "toxic-entries")
    # a text has a bounded number of frequent entries, so their number is bounded whatever the sample
    wanted = context.broadcast(frozenset(r[0] for r in toxic.select("entry").toLocalIterator()))
    clean = _by_fold(_counted(sample.where("toxic <> 1"), wanted), "zeros")
    both = materialize(toxic.join(clean, "entry", "left").na.fill(0), "entries")
    lexicons = []
    for without in [*range(FOLDS), None]:
        n1 = sum(n for fold, n in n_toxic.items() if fold != without)
        n0 = sum(n for fold, n in n_clean.items() if fold != without)
        a, b = (F.col(f"{m}_all") - (0 if without is None else F.col(f"{m}_{without}")) for m in ("ones", "zeros"))
        odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
        error = F.sqrt(1 / (a + 0.5) + F.when(b > 0, 1.0).otherwise(0.25) / (b + 0.5))
        speaks = (odds - error > 0.7) & (a / (a + b * n1 / max(1, n0)) > 0.6)
        fixed = F.col("entry").isin(*["=" + w for w in INSULTS])
        rows = both.where(a >= _least(n1)).select("entry", (odds - error).alias("weight"), speaks.alias("speaks")).where(F.col("speaks") | fixed)
        found = {"=" + w: SEED_WEIGHT for w in INSULTS}
        for entry, weight, for_toxic in rows.collect():
            if for_toxic:
                found[entry] = weight
            else:
                found.pop(entry)  # the labels speak against the fixed word
        lexicons.append(found)
    wanted.destroy()
    return lexicons


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 60) -> tuple[float, ...]:
    """Weights of a logistic layer, drawn towards ``PRIOR`` where labels are few."""
    prior, penalty = np.array(PRIOR), np.eye(x.shape[1]) * ridge
    penalty[0, 0] = 1e-3
    sign = np.where(y > 0, 1.0, -1.0)

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, -sign * (x @ w)).sum() + (w - prior) @ penalty @ (w - prior) / 2)

    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ (weights - prior))
        rate, now = 1.0, loss(weights)
        while rate > 1e-6 and loss(weights - rate * step) > now:
            rate /= 2
        weights = weights - rate * step
        if np.abs(rate * step).max() < 1e-8:
            break
    return tuple(map(float, weights))


def in_held_out(key: str = "doc_id") -> Column:
    """Rows that the fit never sees."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = SAMPLE_ROWS) -> Grammar:
    """The grammar learned from ``labels (key, toxic)`` that are not held out.

    Rows with a null label or key, and labels without a document, are left out.  A key labelled
    twice has the higher label.  Without labels of both kinds the fixed words alone are known.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & ~in_held_out(key))
    ids = known.groupBy(F.col(key).alias("k")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = ids.orderBy(F.xxhash64("k", F.lit(7)), "k").limit(most)  # a bounded sample, so it may be broadcast
    sample = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text")).join(F.broadcast(chosen), "k")
    fold = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(FOLDS)).cast("int").alias("fold")
    sample = materialize(small_batches(sample).select(fold, "text", "toxic"), "toxic-sample").repartition(
        docs.sparkSession.sparkContext.defaultParallelism
    )
    sizes = {(t, f): n for t, f, n in sample.groupBy("toxic", "fold").count().collect()}
    n_toxic = {f: n for (t, f), n in sizes.items() if t == 1}
    n_clean = {f: n for (t, f), n in sizes.items() if t != 1}
    if not n_toxic or not n_clean:
        return Grammar({"=" + w: SEED_WEIGHT for w in INSULTS})
    *partial, whole = _lexicons(sample, n_toxic, n_clean)
    readers = [Grammar(lexicon) for lexicon in partial]  # these give the plain sum
    shared = docs.sparkSession.sparkContext.broadcast(readers)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            values = [shared.value[fold].features(text) for fold, text in rows]
            columns = [pa.array(values, pa.list_(pa.float64())), batch.column(2), batch.column(0)]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "toxic", "fold"])

    rows = sample.select("fold", "text", "toxic").mapInArrow(read, "x array<double>, toxic int, fold int").collect()
    x, y, fold = (np.array(c, float) for c in zip(*[(r.x, r.toxic == 1, r.fold) for r in rows]))
    shared.destroy()
    shaped = {form: np.column_stack([x[:, :1], [shape(v) for v in x[:, 1]], x[:, 2:]]) for form, shape in FORMS.items()}
    form = min(FORMS, key=lambda f: _unseen_loss(shaped[f], y, fold))
    return Grammar(whole, _logistic(shaped[form], y), form)


def _unseen_loss(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> float:
    """Logistic loss of every row by a layer that was fitted on the other folds."""
    total = 0.0
    for out in np.unique(fold):
        there = fold == out
        weights = np.array(_logistic(x[~there], y[~there]))
        total += np.logaddexp(0, -np.where(y[there] > 0, 1.0, -1.0) * (x[there] @ weights)).sum()
    return float(total)


def with_scores(docs: DataFrame, grammar: Grammar, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without ``text`` and with the score of its whole text, 0 to 1 (null: that of an empty text)."""
    kept = [c for c in docs.columns if c not in (text, out)]
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    schema = docs.select(*[f"`{c}`" for c in kept]).withColumn(out, F.lit(0.0)).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(t or "") for t in batch.column(len(kept)).to_pylist()]
            columns = [batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*kept, out])

    return small_batches(docs).select(*[f"`{c}`" for c in kept], f"`{text}`").mapInArrow(scored, schema)


def clean_rows(docs: DataFrame, grammar: Grammar, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    at = docs.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = [shared.value.score(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return small_batches(docs).mapInArrow(kept, docs.schema)
