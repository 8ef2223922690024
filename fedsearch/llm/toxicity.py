"""Toxicity: a weighted finite-state grammar over clauses (operator 9).

A text becomes a string of classes: insults (learned, or fixed phrases of
several words), verbs of harm, words of intent, targets, negations, words of
reported speech, words that link a match with its target, quotation marks,
commas and clause ends. Five transducers read it, composed into one table:

* insult: aimed if a target stands before it in the clause, or after it with
  only linking words between ("a fool you are");
* threat: a verb of harm counts with a person as its object ("kill them",
  "dich töten"), or with an intent and no object at all ("we will attack."):
  a verb alone, or with a thing as its object, is none;
* negation: from its word to a comma, a contrast or the end of the clause;
* speech: after a word of reporting, or inside quotation marks;
* attribution: a report behind a comma and no match behind it ("you are a
  fool, he said") turns what the clause said before into reported speech.

Each match is weighed by what its clause says of it: reported, else negated,
else aimed, else plain. The score is the logistic of the weighed clause sums.

Learning. Insult terms (words and word beginnings) and pattern weights come
from at most ``train_rows`` labelled documents outside the held-out fold: those
with the smallest id hashes (the documented bound that makes their ids safe to
broadcast and their pattern counts, eight numbers each, safe to collect). A
term enters the lexicon if its share of toxic documents is far above chance
(likelihood ratio, with a bound that grows with the number of terms tried).
Labels, languages, sources and ids are no inputs of a score.

Scale. Scoring is one map over the texts, no shuffle. Learning shuffles term
counts of the bounded sample, combined before the shuffle.

Edge cases. Null or empty text: no clause, the lowest score. Null labels or
label rows of unknown documents: ignored; contradicting labels: not used. No
usable label of either kind: no lexicon, every score is the same prior. Null
``doc_id``: its remainder counts as 0. Repeated rows: scored alike. Empty
table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.llm.common import stored

TRAIN_ROWS = 12_000
LEXICON_TERMS = 400
STEMS = (4, 5, 6)
MIN_TOXIC_DOCS = 3
MIN_TOXIC_SHARE = 0.75
CUT = 0.7
RIDGE = 1.0
PHRASE_WEIGHT = 3.0
#: Word lists of the grammar (English, German, French, Spanish).
TARGETS = set("you your yours youre he him she her they them people woman women man men du ihr sie "
              "tu toi vous ils elles usted ustedes ellos ellas".split())
#: Targets that are objects wherever they stand.
OBJECTS = set("dich dir euch te os".split())
NEGATIONS = set("not no never none nobody isn't aren't wasn't don't doesn't won't nicht kein keine nie pas jamais aucun "
                "nunca jamás ningún sin".split())
REPORTS = set("said says say told called calls wrote claimed claims quoted alleged sagte sagt schrieb behauptet "
              "dit écrit affirme dijo dice escribió".split())
THREATS = set("kill kills murder hurt destroy burn shoot stab strangle attack töten verletzen zerstören "
              "tuer frapper détruire matar golpear destruir".split())
INTENTS = set("will shall should must gonna going want wants let let's i'll we'll hope deserve deserves "
              "werde werden wird soll sollte sollten muss müssen vais allons doit devrait faut veux "
              "voy vamos debe deberían quiero".split())
LINKS = set("are is was were be am a an the such so very really just all of every each and these those this that what to "
            "bist ist sind seid ein eine einen der die das den und alle zu est êtes un une le la les de des et si tous "
            "eres es son una el los las y tan todos todas muy".split())
CONTRASTS = set("but though although however until unless because except aber obwohl jedoch sondern "
                "mais quoique sauf pero aunque sino".split())
#: Insults and threats of several words; neither word says much alone.
INSULT_PHRASES = ("shut up", "go to hell", "piece of trash", "piece of garbage", "waste of space", "waste of skin",
                  "halt die klappe", "fahr zur hölle", "ta gueule", "va au diable", "cállate la boca", "vete al infierno")
THREAT_PHRASES = ("drop dead", "rot in hell", "watch your back", "i know where you live", "hope you die", "hope they die",
                  "verrecke endlich", "va mourir", "ojalá te mueras")
(OTHER, TARGET, NEGATION, REPORT, THREAT, QUOTE, END, INSULT,
 OBJECT, INTENT, LINK, CONTRAST, COMMA, CURSE) = range(14)  # CURSE: a whole threat in one phrase
SYMBOLS = 14
PATTERNS = ("insult", "insult_target", "insult_negated", "insult_reported",
            "threat", "threat_target", "threat_negated", "threat_reported")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?|[.!?;:\n,]|[\"“”«»]")


def compose(*machines):
    """One transition table of several machines ``(start, step)`` that read the same symbols.

    Returns ``(table, states)``: ``table[state][symbol]`` is the next state,
    ``states[state]`` the machines' own states; 0 is the start.
    """
    start = tuple(m[0] for m in machines)
    states, table, at = {start: 0}, [], 0
    order = [start]
    while at < len(order):
        row = []
        for symbol in range(SYMBOLS):
            to = tuple(step(s, symbol) for s, (_, step) in zip(order[at], machines))
            if to not in states:
                states[to] = len(states)
                order.append(to)
            row.append(states[to])
        table.append(row)
        at += 1
    return table, order


def _speech_step(s, x):
    if x == QUOTE:
        return 0 if s == 2 else 2
    if x == REPORT and s == 0:
        return 1
    return 0 if x == END and s == 1 else s


def _attribution_step(s, x):
    if x in (END, INSULT, THREAT, CURSE):
        return 0
    if x in (COMMA, QUOTE):
        return max(s, 1)
    return 2 if x == REPORT and s == 1 else s


def _insult_step(s, x):
    if x in (END, CONTRAST):
        return 0
    if x in (TARGET, OBJECT):
        return 1
    if x == INSULT:
        return s or 2
    return s if s == 1 or x in (LINK, NEGATION, COMMA) else 0


def _threat_step(s, x):
    if x in (END, CONTRAST, COMMA, QUOTE, CURSE):
        return 0
    if x == INTENT:
        return 3 if s in (2, 3) else 1
    if x == THREAT:
        return (4, 5, 0, 0, 4, 5)[s]
    if x == OBJECT:
        return (2, 3, 2, 3, 0, 0)[s]
    if x in (TARGET, INSULT):
        return (0, 1, 2, 3, 0, 0)[s]
    return s if x in (LINK, NEGATION) else (0, 1, 0, 3, 0, 1)[s]


#: 1 inside the scope of a negation.
_negation = (0, lambda s, x: 1 if x == NEGATION else 0 if x in (END, COMMA, CONTRAST) else s)
#: 0 own speech, 1 reported to the end of the clause, 2 quoted to the closing mark.
_speech = (0, _speech_step)
#: 1 behind a comma or mark, 2 a report stands there and no match behind it.
_attribution = (0, _attribution_step)
#: 1 a target was named, 2 an insult waits for one.
_insult = (0, _insult_step)
#: 1 intent, 2 object, 3 both; 4 a verb of harm waits for its object, 5 with intent.
_threat = (0, _threat_step)
MACHINES = (_negation, _speech, _attribution, _insult, _threat)
TABLE, STATES = compose(*MACHINES)
_WORDS = {w: symbol for symbol, group in ((LINK, LINKS), (CONTRAST, CONTRASTS), (INTENT, INTENTS), (REPORT, REPORTS),
                                         (NEGATION, NEGATIONS), (TARGET, TARGETS), (OBJECT, OBJECTS), (THREAT, THREATS))
          for w in group}
#: Phrases by first word, longest first, with what they are read as.
_PHRASES: dict[str, list] = {}
for _symbol, _group in ((INSULT, INSULT_PHRASES), (CURSE, THREAT_PHRASES)):
    for _phrase in sorted(_group, key=len, reverse=True):
        _PHRASES.setdefault(_phrase.split()[0], []).append((_phrase.split(), _symbol))


class _Classes(dict):
    """Class and weight of a token, remembered; lexicon terms are ``INSULT`` with their weight."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str):
        if len(self) > 300_000:
            self.clear()
        if len(token) == 1 and not token.isalnum():
            found = (COMMA if token == "," else END if token in ".!?;:\n" else QUOTE, 0.0)
        else:
            weight = max([self.lexicon.get(token, 0.0)] + [self.lexicon.get(token[:n] + "*", 0.0) for n in STEMS])
            symbol = INSULT if weight else _WORDS.get(token, OTHER)
            found = (symbol, 1.0 if symbol == THREAT else weight)
        self[token] = found
        return found


def classed(text: str, classes: _Classes) -> list[tuple[int, float]]:
    """Class and weight of every token; a phrase is one symbol (leftmost, then longest)."""
    tokens = _TOKEN.findall(text.lower().replace("’", "'"))
    if _PHRASES.keys().isdisjoint(tokens):
        return [classes[t] for t in tokens]
    found, at = [], 0
    while at < len(tokens):
        for words, symbol in _PHRASES.get(tokens[at], ()):
            if tokens[at:at + len(words)] == words:
                found.append((symbol, PHRASE_WEIGHT if symbol == INSULT else 1.0))
                at += len(words)
                break
        else:
            found.append(classes[tokens[at]])
            at += 1
    return found


def pattern_sums(symbols: list[tuple[int, float]]) -> list[float]:
    """For each pattern, the weights of its best match in each clause, summed and damped."""
    sums = [0.0] * len(PATTERNS)
    if any(w for _, w in symbols):
        state, clause, waiting = 0, [], []
        for symbol, weight in symbols + [(END, 0.0)]:
            negated, speech, attribution, insult, threat = STATES[state]
            match = None  # kind (0 insult, 4 threat), weight, aimed
            if symbol == INSULT:
                match = [0, weight, insult == 1]
            elif symbol == CURSE:
                match = [4, weight, True]
            if threat > 3 and symbol in (TARGET, OBJECT, INSULT) or threat in (2, 3) and symbol == THREAT:
                clause.append([4, 1.0, True, negated, speech])
            elif threat == 5 and symbol in (END, CONTRAST, COMMA, QUOTE):
                clause.append([4, 1.0, False, negated, speech])
            if insult == 2 and symbol in (TARGET, OBJECT):
                for m in waiting:
                    m[2] = True
            if match:
                clause.append(match + [negated, speech])
            state = TABLE[state][symbol]
            if STATES[state][3] != 2:
                waiting = []
            elif symbol == INSULT:
                waiting.append(clause[-1])
            if symbol == END and clause:
                best: dict[int, float] = {}
                for kind, w, aimed, no, said in clause:
                    p = kind + (3 if said or attribution == 2 else 2 if no else 1 if aimed else 0)
                    best[p] = max(best.get(p, 0.0), w)
                for p, w in best.items():
                    sums[p] += w
                clause = []
    return [math.log1p(x) for x in sums]


def clause_sums(text: str, classes: _Classes) -> list[float]:
    """The pattern sums of a text."""
    return pattern_sums(classed(text, classes))


def held_out(doc_id: Column) -> Column:
    """The fold of the contract that teaches nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``text, toxic`` of at most ``rows`` labelled documents outside the held-out fold."""
    own = (labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
           .where("toxic = _most").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic"))
           .orderBy(F.xxhash64("_id"), "_id").limit(rows))
    return docs.where("text is not null").select("doc_id", "text").join(
        F.broadcast(own), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def learn_lexicon(train: DataFrame, terms: int = LEXICON_TERMS) -> dict[str, float]:
    """The ``terms`` most telling words and beginnings (``abcd*``) of the bounded sample with their log-odds.

    A parameter of the model, not of the data: telling terms further down are
    mostly those that near copies of a few texts share.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    stems = [F.transform(F.filter("_words", lambda w: F.length(w) >= n), lambda w: F.concat(F.left(w, F.lit(n)), F.lit("*")))  # noqa: B023
             for n in STEMS]
    # equal texts teach once, however often they are repeated
    rows = train.groupBy(F.xxhash64("text").alias("_h")).agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    counts = (rows.withColumn("_words", tokens)
              .select("toxic", F.explode(F.array_distinct(F.concat("_words", *stems))).alias("term"))
              .groupBy("term").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")))
    counts = stored(counts.where(F.col("t") >= MIN_TOXIC_DOCS).select("term", "t", "n"), "toxic-terms")
    sizes = rows.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["t"] or sizes["t"] == sizes["n"]:
        return {}
    total_t, total_c = float(sizes["t"]), float(sizes["n"] - sizes["t"])
    share, c = total_t / (total_t + total_c), F.col("n") - F.col("t")
    # likelihood ratio of the term's toxic share against the sample's
    g = 2 * (F.col("t") * F.log(F.col("t") / (F.col("n") * share))
             + F.when(c > 0, c * F.log(c / (F.col("n") * (1 - share)))).otherwise(0.0))
    odds = F.log((F.col("t") + 0.5) / (total_t + 1)) - F.log((c + 0.5) / (total_c + 1))
    best = (counts.where(F.col("t") >= MIN_TOXIC_SHARE * F.col("n")).withColumn("g", g)
            .where(F.col("g") >= 2 * math.log(max(sizes["n"], 2)) + 6)
            .select("term", "t", odds.alias("w"), "g").orderBy(F.desc("g"), "term").limit(terms))
    rows = best.collect()  # at most `terms` rows
    words = [(r["term"], r["t"]) for r in rows if not r["term"].endswith("*")]
    # a beginning that is mostly one word says no more than the word
    return {r["term"]: float(r["w"]) for r in rows if not r["term"].endswith("*")
            or all(2 * t < r["t"] for word, t in words if word.startswith(r["term"][:-1]))}


def _sums(df: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """``df`` without ``text``, with ``x``: the clause sums of its text."""
    kept = [c for c in df.columns if c != "text"]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + ", x array<double>"

    def run(batches):
        classes = _Classes(lexicon)
        for b in batches:
            x = [clause_sums(t.as_py() or "", classes) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [pa.array(x, pa.list_(pa.float64()))],
                                             names=kept + ["x"])

    return df.mapInArrow(run, schema)


def learn_weights(train: DataFrame, lexicon: dict[str, float]) -> list[float]:
    """Logistic weights of the patterns, intercept last, by Newton steps with a ridge.

    The sample is bounded, and its rows arrive counted by equal pattern sums.
    """
    rows = (_sums(train, lexicon).groupBy("x", "toxic").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("x", "toxic").collect())
    if not rows:
        return [0.0] * (len(PATTERNS) + 1)
    x = np.array([r["x"] + [1.0] for r in rows])
    y = np.array([float(r["toxic"]) for r in rows])
    n = np.array([float(r["n"]) for r in rows])
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, terms: int = LEXICON_TERMS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and ``patterns`` (the clause sums) of every row of ``docs``."""
    train = stored(training_rows(docs, labels, train_rows), "toxic-train")
    lexicon = learn_lexicon(train, terms)
    weights = learn_weights(train, lexicon)
    logit = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        logit = logit + F.get("x", F.lit(i)) * w
    value = 1 / (1 + F.exp(-logit))
    return (_sums(docs.select("doc_id", "text"), lexicon).withColumn("score", value)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= CUT).cast("int").alias("predicted"), F.col("x").alias("patterns")))
