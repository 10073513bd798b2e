"""Toxicity by a weighted finite-state grammar over clauses.

Words are first rewritten to symbols: insult, threat, target, negation, reporting verb or other. Five small
transducers read the symbols of a clause: insult and threat emit weighted hits, target raises hits that
share a clause with a person, negation takes back the hits in its reach, reported speech marks everything
after a reporting verb or inside quotes. Their composition runs once over a clause and sums the weights by
kind of match, so a hit counts for the clause it stands in, not as a word.

Weights and insult stems are learned from labelled documents that are not held out: stems by a binomial
test on document counts, weights by logistic regression with prior means. The fit uses at most
``SAMPLE`` rows of either label, chosen by a hash of doc_id; scoring covers every text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.storage import Scratch
from pageloom.llm.textops import mix, slices, span_hashes, text_bytes, windows, word_spans

# Most labelled documents of either label that the model is fitted on.
SAMPLE = 10_000
FOLDS = 5

# Small public word lists in the four languages of the corpus, and prior weights.
INSULTS = """idiot idiots moron morons imbecile stupid loser losers scum scumbag worthless pathetic disgusting
trash clown dumbass bastard asshole idiotisch dummkopf arschloch abschaum trottel idiote crétin connard abruti
salaud idiota estúpido imbécil cabrón basura""".split()
THREATS = """kill hurt destroy strangle stab shoot punch töten umbringen verprügeln tuer frapper étrangler matar
golpear destruir""".split()
TARGETS = """you your yours yourself u he she they them him du dich dir dein ihr euch tu toi te vous votre tú ti
usted ustedes vosotros""".split()
NEGATIONS = """not never no isn't aren't wasn't don't doesn't nobody nicht kein keine nie pas jamais aucun ningún
nunca tampoco""".split()
REPORTS = """said says say wrote writes quoted quote called reported claimed sagte schrieb berichtete dit écrit
déclaré dijo escribió declaró""".split()
# Kinds of matched clauses and what a hit of weight 1 in them is worth before any label is seen.
KINDS = ("insult", "insult_at", "insult_not", "insult_said", "threat_at", "threat_not", "threat_said")
PRIOR = (0.9, 1.1, 0.1, 0.2, 0.9, 0.0, 0.1)
PRIOR_BIAS = -3.0
SEED_WEIGHT = 3.0
REACH = 3  # words that a negation reaches

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n\"“”«»]")
_BREAK = set(".!?;:\n")
_QUOTE = set("\"“”«»")


@dataclass(frozen=True)
class Grammar:
    """Weighted stems and the fitted weights of the kinds of clauses."""

    stems: dict[str, float]
    weights: tuple[float, ...] = PRIOR
    bias: float = PRIOR_BIAS


class Matcher:
    """The composed transducers, ready to read texts."""

    def __init__(self, grammar: Grammar) -> None:
        self.grammar = grammar
        self.stems = grammar.stems
        self.lengths = sorted({len(s) for s in self.stems})
        self.other = {
            **dict.fromkeys(TARGETS, "target"),
            **dict.fromkeys(NEGATIONS, "negation"),
            **dict.fromkeys(REPORTS, "report"),
            **dict.fromkeys(THREATS, "threat"),
        }
        # Texts without a stem or threat need no reading: one pass of this automaton finds the others.
        self.scan = ahocorasick.Automaton()
        for word in [*self.stems, *THREATS]:
            self.scan.add_word(word, len(word))
        self.scan.make_automaton()

    def symbol(self, word: str) -> tuple[str, float]:
        """The first transducer: a word to its symbol and weight."""
        best = max((self.stems.get(word[:n], 0.0) for n in self.lengths if n <= len(word)), default=0.0)
        if best:
            return "insult", best
        kind = self.other.get(word, "")
        return kind, 1.0 if kind == "threat" else 0.0

    def clause(self, symbols: list[tuple[str, float]], quoted: bool, sums: list[float]) -> None:
        """The composition of the others over one clause; state: negation's reach, reported, target seen."""
        reach, said, target = 0, quoted, False
        hits: list[tuple[str, float, bool, bool]] = []
        for kind, weight in symbols:
            if kind == "negation":
                reach = REACH + 1
            elif kind == "report":
                said = True
            elif kind == "target":
                target = True
            elif kind in ("insult", "threat"):
                hits.append((kind, weight, reach > 0, said))
            reach = max(0, reach - 1)
        for kind, weight, negated, reported in hits:
            if kind == "threat" and not target and not negated and not reported:
                continue  # a threat is at someone
            way = "_said" if reported else "_not" if negated else "_at" if target else ""
            sums[KINDS.index(kind + way)] += weight

    def features(self, text: str) -> list[float] | None:
        """Weight by kind of clause, damped; None when nothing in the text can match."""
        low = text.lower()
        if not any(end - n < 0 or not low[end - n].isalpha() for end, n in self.scan.iter(low)):
            return None
        sums, symbols, quoted, opened = [0.0] * len(KINDS), [], False, False
        for match in _TOKEN.finditer(low):
            token = match.group()
            if token in _BREAK or token in _QUOTE:
                if symbols:
                    self.clause(symbols, quoted, sums)
                    symbols = []
                opened = not opened if token in _QUOTE else opened and token != "\n"
                quoted = opened
            else:
                symbols.append(self.symbol(token))
        if symbols:
            self.clause(symbols, quoted, sums)
        return [math.log1p(s) * 2 for s in sums]

    def score(self, text: str | None) -> float:
        found = self.features(text) if text else None
        z = self.grammar.bias
        if found:
            z += sum(w * x for w, x in zip(self.grammar.weights, found, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from. A null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """text and toxic of at most ``most`` learnable documents of each label."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit(3), "doc_id")
    picked = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)
        picked = some if picked is None else picked.union(some)
    picked = scratch.save(picked, "picked")  # at most 2 * most rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(picked), "doc_id")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                one, two = least_shingles(*text_bytes(part.column("text")))
                yield pa.record_batch([*part.columns, pa.array(one), pa.array(two)], names=["doc_id", "text", "toxic", "m1", "m2"])

    # Copies and near copies count once: else the words of a copied text would look telling.
    # The smallest doc_id stands for them, so the order of rows says nothing.
    columns = "doc_id long, text string, toxic int, m1 long, m2 long"
    marked = rows.select("doc_id", "text", F.col("toxic").cast("int")).mapInArrow(mark, columns)
    for m in ("m1", "m2"):
        first = F.min(F.struct("doc_id", "text", "m1", "m2")).alias("first")
        marked = marked.groupBy("toxic", F.col(m).alias("least")).agg(first).select("toxic", "first.*")
    return scratch.save(marked.select("text", "toxic").repartition(24), "sample")


def least_shingles(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest hashes, in two orders, of each text's runs of four words; texts without any differ."""
    first, last, doc = word_spans(raw, offs)
    value, at = windows(span_hashes(raw, first, last), doc, 4)
    out = []
    for salt in (1, 2):
        least = mix(offs[:-1].astype(np.uint64) + np.uint64(salt)) | np.uint64(1 << 63)
        np.minimum.at(least, doc[at], mix(value + np.uint64(salt)))
        out.append(least.view(np.int64))
    return out[0], out[1]


def word_stems(rows: DataFrame, shortest: int = 3, longest: int = 9) -> DataFrame:
    """Documents of either label by prefix of a word, counted per task before they are shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = set()
                for word in set(_TOKEN.findall(text.lower())):
                    own.update(word[:n] for n in range(shortest, min(len(word), longest) + 1))
                counts[toxic].update(own)
        stems = list(counts[0] | counts[1])
        for k in range(0, len(stems), 50_000):
            part = stems[k : k + 50_000]
            toxic, clean = ([counts[label][s] for s in part] for label in (1, 0))
            yield pa.record_batch({"stem": part, "toxic": toxic, "clean": clean})

    found = rows.mapInArrow(work, "stem string, toxic long, clean long")
    return found.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def tail(hits: int, n: int, p: float) -> float:
    """log of an upper bound of P(X >= hits) for n draws at rate p (Chernoff)."""
    q = hits / n
    if q <= p:
        return 0.0
    gain = q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0)
    return -n * gain


def choose_stems(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Stems that toxic documents hold far more often than chance allows, with their log-odds.

    Of stems that begin alike the shortest counts, made longer while what the longer one leaves tells nothing.
    """
    p = n_toxic / (n_toxic + n_clean)
    rate = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    stems = counts.where("toxic >= 4").where(rate > 0.5 + 0.5 * p)
    total = counts.count()
    rows = stems.collect()  # bounded: each holds 4 of the sampled documents or more

    def telling(toxic: int, clean: int) -> bool:
        return toxic > 0 and tail(toxic, toxic + clean, p) + math.log(max(total, 1)) < math.log(0.01)

    good = {r.stem: (r.toxic, r.clean) for r in rows if telling(r.toxic, r.clean)}
    out: dict[str, float] = {}
    for stem in sorted(good, key=lambda s: (len(s), s)):
        if any(stem[:n] in out for n in range(1, len(stem))):
            continue
        longer = stem
        while True:
            more = [s for s in good if len(s) == len(longer) + 1 and s.startswith(longer)]
            (toxic, clean), top = good[longer], max(more, key=lambda s: good[s], default=None)
            if top is None or telling(toxic - good[top][0], clean - good[top][1]):
                break
            longer = top
        toxic, clean = good[longer]
        odds = math.log((toxic + 0.5) / (clean + 0.5) * (n_clean + 1) / (n_toxic + 1))
        out[longer] = max(0.5, min(4.0, odds))
    return out


def fit(features: np.ndarray, toxic: np.ndarray, share: float) -> tuple[tuple[float, ...], float]:
    """Weights by Newton steps on the logistic loss, held near the prior means.

    ``share`` is the part of toxic rows among all that are labelled; rows count so that the sample has it.
    """
    x = np.hstack([features, np.ones((len(features), 1))])
    mean = np.array([*PRIOR, PRIOR_BIAS])
    strength = np.array([1.0] * len(PRIOR) + [0.1])
    own = toxic.mean()
    weight = np.where(toxic == 1, share / own, (1 - share) / (1 - own))

    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -500, 500)
        return float((weight * (np.logaddexp(0, z) - toxic * z)).sum() + 0.5 * (strength * (w - mean) ** 2).sum())

    w, now = mean.copy(), loss(mean)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - toxic)) + strength * (w - mean)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(strength)
        step, scale = np.linalg.solve(hess, grad), 1.0
        while scale > 1e-6 and loss(w - scale * step) > now:  # a full step may pass the minimum by far
            scale /= 2
        w = w - scale * step
        before, now = now, loss(w)
        if before - now < 1e-9:
            break
    return tuple(float(v) for v in np.maximum(w[:-1], 0.0)), float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, most: int = SAMPLE) -> Grammar:
    """A grammar fitted on the labels that are not held out; the prior one where a label is missing."""
    seeds = dict.fromkeys(INSULTS, SEED_WEIGHT)
    rows = sample(docs, labels, scratch, most)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Grammar(seeds)
    counts = scratch.save(word_stems(rows), "stems")
    stems = {**seeds, **choose_stems(counts, n_toxic, n_clean)}
    grammar = Grammar(stems)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in batches:
            none = [0.0] * len(KINDS)
            found = [matcher.features(t) or none for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"x": pa.array(found, pa.list_(pa.float64())), "toxic": batch.column("toxic")})

    seen = sorted(rows.mapInArrow(work, "x array<double>, toxic int").collect())  # at most 2 * most short rows
    share = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).agg(F.avg("toxic")).first()[0]
    x, y = np.array([r.x for r in seen]), np.array([r.toxic for r in seen], dtype=float)
    weights, bias = fit(x, y, float(min(max(share, 0.01), 0.99)))
    return Grammar(stems, weights, bias)


def score_documents(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score and predicted of every row; a null or empty text scores as one without any match.

    Every row gives one row, repeated ones and those without doc_id included. Other columns are not looked at.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in batches:
            scores = [matcher.score(t.as_py()) for t in batch.column("text")]
            flags = pa.array([int(s >= 0.5) for s in scores], pa.int32())
            score = pa.array(scores, pa.float64())
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "score": score, "predicted": flags})

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(work, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """``docs`` without the texts that the grammar rejects, columns as they are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(grammar)
        for batch in batches:
            keep = [matcher.score(t.as_py()) < 0.5 for t in batch.column("text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
