"""Toxicity by a weighted grammar of clauses: composed transducers and a learned calibration."""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidepool.llm.common import bounded_batches, boxed, materialize, text_of

#: Word classes of the grammar; fixed values.
INSULTS = "idiot idiots moron morons stupid imbecile loser losers scum trash garbage filth vermin worthless pathetic disgusting clown clowns fool fools dumb jerk freak creep pig pigs rat rats coward liar scumbag dumbass asshole bastard bitch".split()
THREATS = "kill hurt destroy burn beat crush shoot stab strangle punish attack murder hang".split()
TARGETS = "you your yours youre he him his she her they them their this that these those it its we us".split()
NEGATIONS = "not no never neither nor none cannot isnt arent wasnt dont doesnt didnt wont without hardly".split()
REPORTS = "said says say told tells wrote writes quoted quotes called calls claimed claims reported reports according alleged asked".split()

#: Labelled rows that markers are learned from at the most, those with the smallest hashes; markers
#: kept at the most; what a marker needs: toxic documents, and standard errors by contexts and documents.
LEARN_ROWS, LEARN_TERMS, LEARN_DOCS, LEARN_Z, LEARN_DOCS_Z = 4000, 100, 3, 5.0, 2.5
#: Lengths of word beginnings that may be markers, besides whole words.
STEMS = range(4, 9)
#: Lexical classes that can be aimed, negated or reported; kinds of matches that the grammar tells apart.
HOSTILE = ("insult", "threat", "marker")
KINDS = tuple(f"{h}{how}" for h in HOSTILE for how in ("", "_target", "_negated", "_reported"))
#: A clause's weight falls in one of the steps that begin here; a document's features are whether it has
#: 1, 2 .. LEVELS clauses of a step.
STEPS, LEVELS = (0.25, 0.75, 1.25, 1.75, 2.5), 3
#: Words before which a target or a negation still counts.
REACH = 4

CLAUSE = re.compile(r"[.,;:!?()\n|]+")
WORD = re.compile(r"\w+")


class Transducer:
    """A finite-state transducer with weights: step(state, symbol) gives (state, symbol, weight)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __rshift__(self, other: Transducer) -> Transducer:
        """Composition: what this one writes, the other reads; weights add up."""

        def step(state, symbol):
            a, symbol, v = self.step(state[0], symbol)
            b, symbol, w = other.step(state[1], symbol)
            return (a, b), symbol, v + w

        return Transducer((self.start, other.start), step)

    def run(self, symbols):
        state, out, total = self.start, [], 0.0
        for s in symbols:
            state, o, w = self.step(state, s)
            out.append(o)
            total += w
        return out, total


def _lexical(markers: dict[str, float]) -> Transducer:
    """Words to (class, weight): insults, threats, targets, negations, reports, learned markers."""
    classes = {w: ("report", 0.0) for w in REPORTS} | {w: ("negation", 0.0) for w in NEGATIONS} | {w: ("target", 0.0) for w in TARGETS}
    classes |= {w: ("threat", 1.0) for w in THREATS} | {w: ("insult", 1.0) for w in INSULTS}
    words = {w: v for w, v in markers.items() if not w.endswith("*")}
    stems = {w[:-1]: v for w, v in markers.items() if w.endswith("*")}

    def step(state, word):
        if word in classes:
            return None, classes[word], 0.0
        weight = max([words.get(word, 0.0), *(stems.get(word[:k], 0.0) for k in STEMS if k < len(word))])
        return None, ("marker", weight) if weight else ("word", 0.0), 0.0

    return Transducer(None, step)


def _reporting() -> Transducer:
    """After a verb of reporting, what follows in the clause is somebody else's speech."""

    def step(reported, symbol):
        kind, weight = symbol
        if kind == "report":
            return True, symbol, 0.0
        return reported, (f"{kind}_reported", weight / 2) if reported and kind in HOSTILE else symbol, 0.0

    return Transducer(False, step)


def _negating() -> Transducer:
    """A negation turns hostile words within REACH words into negated ones."""

    def step(left, symbol):
        kind, weight = symbol
        if kind == "negation":
            return REACH, symbol, 0.0
        return max(0, left - 1), (f"{kind}_negated", weight / 2) if left and kind in HOSTILE else symbol, 0.0

    return Transducer(0, step)


def _targeting() -> Transducer:
    """A hostile word at most REACH words after a target is aimed at it; writes weights."""

    def step(left, symbol):
        kind, weight = symbol
        if kind == "target":
            return REACH, symbol, 0.0
        if left and kind in HOSTILE:
            return left - 1, (f"{kind}_target", weight * 1.5), weight * 1.5
        return max(0, left - 1), symbol, weight

    return Transducer(0, step)


def grammar(markers: dict[str, float]) -> Transducer:
    return reduce(lambda a, b: a >> b, (_lexical(markers), _reporting(), _negating(), _targeting()))


class Matcher:
    """Finds clauses that hold a trigger and runs the grammar over each."""

    def __init__(self, markers: dict[str, float]):
        self.rules = grammar(markers)
        self.words = ahocorasick.Automaton()
        for w in {*INSULTS, *THREATS, *markers}:
            self.words.add_word(w.rstrip("*"), w)
        self.words.make_automaton()

    def clauses(self, text: str) -> list[tuple[list[str], float, str]]:
        """(kinds, weight, clause) of the clauses in which the grammar matches."""
        low, found, done = text.lower(), [], 0
        inner = lambda c: c.isalnum() or c == "_"
        for end, word in self.words.iter(low):
            stem = word.endswith("*")
            start = end + 1 - len(word) + stem
            if start < done or (start and inner(low[start - 1])) or (end + 1 < len(low) and inner(low[end + 1])) != stem:
                continue
            a = start
            while a and not CLAUSE.match(low[a - 1]):
                a -= 1
            stop = CLAUSE.search(low, end + 1)
            done = stop.start() if stop else len(low)
            clause = low[max(a, 0) : done]
            out, weight = self.rules.run(WORD.findall(clause))
            kinds = [k for k, _ in out if k in KINDS]
            if kinds:
                found.append((kinds, weight, clause))
        return found


def _match_batches(markers: dict[str, float]):
    def run(batches):
        matcher = Matcher(markers)
        for batch in batches:
            counts, steps, weights, worst = [], [], [], []
            for t in batch.column("_text"):
                found = matcher.clauses(t.as_py())
                n = [0] * len(KINDS)
                for kinds, _, _ in found:
                    for kind in kinds:
                        n[KINDS.index(kind)] += 1
                counts.append(n)
                at = np.searchsorted(STEPS, [w for _, w, _ in found], "right") - 1
                steps.append(np.bincount(at[at >= 0], minlength=len(STEPS)).tolist())
                weights.append(sum(w for _, w, _ in found))
                worst.append(max(found, key=lambda x: x[1])[2] if found else None)
            keep = [c for c in batch.schema.names if c != "_text"]
            cols = [batch.column(c) for c in keep] + [pa.array(counts, pa.list_(pa.int32())), pa.array(steps, pa.list_(pa.int32())), pa.array(weights, pa.float64()), pa.array(worst, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*keep, "counts", "steps", "weight", "clause"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _context_batches(batches):
    """Each (word, neighbours) of each labelled text, once a text."""
    for batch in batches:
        for toxic, doc_id, text in zip(batch.column("toxic"), batch.column("doc_id"), batch.column("_text")):
            words = ["", *WORD.findall(text.as_py().lower()), ""]
            seen = sorted({(w, f"{a} {b}") for a, w, b in zip(words, words[1:], words[2:]) if len(w) > 2})
            cols = [pa.array([toxic.as_py()] * len(seen), pa.int32()), pa.array([doc_id.as_py()] * len(seen), pa.int64()), pa.array([w for w, _ in seen], pa.string()), pa.array([c for _, c in seen], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["toxic", "doc_id", "w", "c"])


def learn_markers(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Words and word beginnings ("stem*") that labelled rows give away as toxic, with weights.

    A term counts once for each (word, word before, word after), and that context for the first
    document it is in, so copies of one text don't make its words suspicious. Its log odds between
    toxic and clean rows must be LEARN_Z standard errors above the average by contexts, and
    LEARN_DOCS_Z by documents. Of terms that begin alike the clearest stays. Reads LEARN_ROWS
    labelled rows at the most and keeps LEARN_TERMS terms.
    """
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARN_ROWS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "doc_id")
    seen = rows.select("toxic", "doc_id", "_text").mapInArrow(_context_batches, "toxic int, doc_id bigint, w string, c string")
    seen = seen.groupBy("w", "c").agg(F.min(F.struct("doc_id", "toxic")).alias("d"))
    stems = [F.when(F.char_length("w") > k, F.concat(F.substring("w", 1, k), F.lit("*"))) for k in STEMS]
    terms = seen.select(F.explode(F.array(F.col("w"), *stems)).alias("term"), F.col("d.toxic").alias("toxic"), F.col("d.doc_id").alias("doc_id")).dropna()
    terms = terms.groupBy("term", "doc_id", "toxic").agg(F.count("*").alias("n")).groupBy("term")
    side = lambda t, x: F.sum(F.when(F.col("toxic") == t, x).otherwise(0))
    terms = terms.agg(side(1, F.col("n")).alias("t"), side(0, F.col("n")).alias("c"), side(1, F.lit(1)).alias("td"), side(0, F.lit(1)).alias("cd"))
    totals = seen.agg(F.sum("d.toxic"), F.sum(1 - F.col("d.toxic")), F.count_distinct(F.when(F.col("d.toxic") == 1, F.col("d.doc_id"))), F.count_distinct(F.when(F.col("d.toxic") == 0, F.col("d.doc_id")))).first()
    if not totals[0] or not totals[1]:
        return {}
    odds = lambda t, c, base: F.log((F.col(t) + 0.5) / (F.col(c) + 0.5)) - float(np.log(base))
    error = lambda t, c: F.sqrt(1 / (F.col(t) + 0.5) + 1 / (F.col(c) + 0.5))
    by_context, by_doc = odds("t", "c", totals[0] / totals[1]), odds("td", "cd", totals[2] / totals[3])
    terms = terms.filter(F.col("td") >= LEARN_DOCS).select("term", by_context.alias("odds"), (by_context / error("t", "c")).alias("z"), (by_doc / error("td", "cd")).alias("zd"))
    top = terms.filter((F.col("z") >= LEARN_Z) & (F.col("zd") >= LEARN_DOCS_Z)).orderBy(F.desc("z"), "term").limit(20 * LEARN_TERMS).collect()
    known, found = {*INSULTS, *THREATS, *TARGETS, *NEGATIONS, *REPORTS}, {}
    for r in top:
        plain = r.term.rstrip("*")
        if not any(w.startswith(plain) for w in known) and not any(plain.startswith(f.rstrip("*")) or f.startswith(plain) for f in found):
            found[r.term] = float(min(2.0, max(0.5, r.odds / 3)))
    return dict(list(found.items())[:LEARN_TERMS])


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge logistic regression over weighted rows; the intercept comes last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, whole: bool = False) -> DataFrame:
    """doc_id, counts, steps, weight, clause and score of each row, and with whole its columns in _doc."""
    spark = docs.sparkSession
    bounded_batches(spark)
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    named = named.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    markers = learn_markers(docs, named, id_col, text_col)
    rows = boxed(docs, id_col, text_col).select(F.col("_doc_id").alias("doc_id"), *["_doc"] * whole, F.col("_doc_text").alias("_text"))
    found = StructType([*[f for f in rows.schema if f.name != "_text"], *StructType.fromDDL("counts array<int>, steps array<int>, weight double, clause string")])
    rows = materialize(rows.mapInArrow(_match_batches(markers), found), "toxicity-clauses")

    level = [F.least(F.get("steps", F.lit(i)), F.lit(LEVELS)) for i in range(len(STEPS))]
    bins = rows.select("doc_id", F.array(*level).alias("_x")).join(named, "doc_id").groupBy("_x", "toxic").count().collect()
    prior = [([0] * len(STEPS), 0.0, 8.0)]
    for j, w in enumerate(STEPS):
        prior += [([n if i == j else 0 for i in range(len(STEPS))], float(w >= 0.75), 2.0) for n in range(1, LEVELS + 1)]
    fitted = prior + [(r[0], float(r[1]), float(r[2])) for r in bins]
    steps = np.array([[[x > j for j in range(LEVELS)] for x in f[0]] for f in fitted], float).reshape(len(fitted), -1)
    w = fit_logistic(steps, np.array([f[1] for f in fitted]), np.array([f[2] for f in fitted]))
    logit = F.lit(float(w[-1]))
    for i, x in enumerate(level):
        logit += F.element_at(F.array(*[F.lit(float(v)) for v in np.concatenate([[0.0], np.cumsum(w[i * LEVELS : (i + 1) * LEVELS])])]), x + 1)
    return rows.withColumn("score", 1 / (1 + F.exp(-logit)))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, counts (matches by KINDS), weight (of
    the grammar) and clause (the worst one).

    A score follows from the weights that the composed transducers give the document's clauses, by how
    many clauses weigh how much (STEPS). Labels are learned from rows whose crc32(id as text) mod 5
    isn't 0, in two places: markers (learn_markers), which are a lexical class of the grammar and can be
    aimed, negated or reported like any insult, and the calibration, a logistic regression over the
    clauses by weight. Numbers of clauses stop at LEVELS, so the calibration fits on a histogram over all
    such rows that doesn't grow with them.

    Null texts are empty and score like texts without a match; null ids count as empty text in the
    hash (held out) and never have a label; null labels are none; of several labels for one id the
    highest counts; repeated rows give repeated rows. Without labels a clause of weight 0.75 or more
    scores above 0.5. An empty table gives an empty result.
    """
    out = _scored(docs, labels, id_col, text_col)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "counts", "weight", "clause")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score_toxicity() doesn't predict to be toxic, null and
    empty texts and repeated rows among them. Rows carry their matches along, so they don't shuffle."""
    return _scored(docs, labels, id_col, text_col, whole=True).filter("score < 0.5").select("_doc.*")
