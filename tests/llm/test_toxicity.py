"""Operator 9: held-out accuracy, the grammar's states, what is never an input."""

import binascii

from pyspark.sql import functions as F

from conftest import SF01
from fedsearch.llm import queries, toxicity as X


def test_query_held_out(spark, documents):
    rows = {r.doc_id: r for r in queries.op9_toxicity(spark, SF01).collect()}
    assert len(rows) == len(documents)
    for d, r in rows.items():
        assert r.held_out == (binascii.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    judged = [(x.toxic, rows[x.doc_id]) for x in spark.read.parquet(f"{SF01}/labels.parquet").collect() if x.doc_id in rows]
    held = [(t, r) for t, r in judged if r.held_out]
    assert len(held) > 80
    assert sum(t == r.predicted for t, r in held) >= 0.94 * len(held)
    assert not any(r.predicted for t, r in held if not t)
    toxic = sorted(r.score for t, r in held if t)
    clean = sorted(r.score for t, r in held if not t)
    assert sum(a > b for a in toxic for b in clean) + 0.5 * sum(a == b for a in toxic for b in clean) >= 0.85 * len(toxic) * len(clean)


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit("q"))
    a = {r.doc_id: r.score for r in X.score(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in X.score(other, flipped).collect()}


def sums(text):
    return dict(zip(X.PATTERNS, X.clause_sums(text, X._Classes({"fool": 2.0, "jerk*": 3.0}))))


def hit(text):
    return {p for p, v in sums(text).items() if v}


def test_grammar():
    assert hit("A fool walks.") == {"insult"}
    assert hit("You are a fool.") == hit("a fool you are") == {"insult_target"}
    assert hit("You are not a fool.") == {"insult_negated"}
    assert hit("Not here, though long after it, a fool walks.") == {"insult"}
    assert hit("He said a fool walks.") == hit('"A fool." Then') == {"insult_reported"}
    assert hit("He said so. A fool walks.") == {"insult"}
    assert hit('"Well." A fool walks.') == {"insult"}
    assert hit("We will kill you") == {"threat_target"} and hit("Nothing here. foolish") == set()
    assert hit("jerky") == set() or X.STEMS and hit("jerky") == {"insult"}
    assert sums("fool. fool.")["insult"] > sums("fool fool.")["insult"] == sums("fool.")["insult"]


def test_patterns_of_several_words():
    # a verb of harm counts with a person as its object, or with an intent and no object
    assert hit("They burn wood and shoot photos.") == hit("Burn it down") == hit("murder") == set()
    assert hit("Shoot them all") == hit("ich werde dich töten") == hit("te voy a matar") == {"threat_target"}
    assert hit("We will attack.") == {"threat"} and hit("We will attack hills.") == set()
    assert hit("We will not kill you.") == {"threat_negated"}
    assert hit("She wrote that they must kill you") == {"threat_reported"}
    # negation reaches over the clause, up to a comma or a contrast
    assert hit("I do not think that you are a fool.") == {"insult_negated"}
    assert hit("No, you are a fool") == hit("Not nice but you are a fool") == {"insult_target"}
    # reports behind the match
    assert hit("You are a fool, he said.") == hit('"You are a fool", he said.') == {"insult_reported"}
    assert hit("He said so, you are a fool, no less.") == {"insult_reported"}
    assert hit("You are a fool, said he. You are a fool.") == {"insult_reported", "insult_target"}
    # a target behind the match needs a link
    assert hit("A fool is what you are") == {"insult_target"} and hit("A fool walks with you") == {"insult"}
    # phrases
    assert hit("You waste of space") == {"insult_target"} and hit("The waste. Of space") == set()
    assert hit("I know where you live") == {"threat_target"} and hit('"Drop dead"') == {"threat_reported"}


def test_composed_states_follow_the_machines():
    import random
    rng, state, own = random.Random(0), 0, tuple(m[0] for m in X.MACHINES)
    for _ in range(5000):
        x = rng.randrange(X.SYMBOLS)
        state = X.TABLE[state][x]
        own = tuple(m[1](s, x) for s, m in zip(own, X.MACHINES))
        assert X.STATES[state] == own


def plain_sums(symbols):
    """The pattern sums by searching around every match, without any machine."""
    import math
    import re
    kinds = [k for k, _ in symbols] + [X.END]
    weights = [w for _, w in symbols] + [0.0]
    sums = dict.fromkeys(X.PATTERNS, 0.0)

    def last(i, of):
        return next((j for j in range(i - 1, -1, -1) if kinds[j] in of), -1)

    def told(i):
        if kinds[:i].count(X.QUOTE) % 2:
            return True
        return X.REPORT in kinds[last(i, (X.QUOTE, X.END)) + 1:i]

    def negated(i):
        j = last(i, (X.NEGATION, X.END, X.COMMA, X.CONTRAST))
        return j >= 0 and kinds[j] == X.NEGATION

    letters = {X.OBJECT: "O", X.TARGET: "T", X.INSULT: "T", X.INTENT: "I", X.THREAT: "K", X.LINK: "L", X.NEGATION: "L"}
    harm = []  # place of the symbol that completes a threat, aimed
    breaks = (X.END, X.CONTRAST, X.COMMA, X.QUOTE, X.CURSE)
    start = 0
    for i, k in enumerate(kinds):
        part = "".join(letters.get(x, "x") for x in kinds[start:i])
        if k in breaks:
            if k != X.CURSE and re.fullmatch(".*I.*K[LK]*", part):
                harm.append((i, False))
            start = i + 1
        elif re.fullmatch(".*K[LK]*[OT]|.*O[LTO]*K|.*O[LTO]*I.*K|.*I.*O.*K", part + letters.get(k, "x")):
            harm.append((i, True))
            start = i + 1
    begin = 0
    for end in [i for i, k in enumerate(kinds) if k == X.END]:
        own = range(begin, end + 1)
        found = [("threat", 1.0, aimed, i) for i, aimed in harm if i in own]
        for i in own:
            if kinds[i] == X.CURSE:
                found.append(("threat", weights[i], True, i))
            if kinds[i] == X.INSULT:
                before = kinds[last(i, (X.END, X.CONTRAST)) + 1:i]
                behind = next(k for k in kinds[i + 1:] + [X.END] if k not in (X.LINK, X.NEGATION, X.COMMA, X.INSULT))
                people = (X.TARGET, X.OBJECT)
                found.append(("insult", weights[i], any(k in people for k in before) or behind in people, i))
        tail = kinds[max(last(end, (X.INSULT, X.THREAT, X.CURSE)) + 1, begin):end]
        marks = [j for j, k in enumerate(tail) if k in (X.COMMA, X.QUOTE)]
        said = bool(marks) and X.REPORT in tail[marks[0]:]
        best = {}
        for kind, w, aimed, i in found:
            p = kind + ("_reported" if said or told(i) else "_negated" if negated(i) else "_target" if aimed else "")
            best[p] = max(best.get(p, 0.0), w)
        for p, w in best.items():
            sums[p] += w
        begin = end + 1
    return [math.log1p(sums[p]) for p in X.PATTERNS]


def test_sums_against_a_plain_search():
    import random
    rng = random.Random(4)
    for _ in range(4000):
        symbols = [(k, {X.THREAT: 1.0, X.CURSE: 1.0, X.INSULT: rng.choice((1.0, 2.5))}.get(k, 0.0))
                   for k in (rng.randrange(X.SYMBOLS) for _ in range(rng.randrange(25)))]
        assert X.pattern_sums(symbols) == plain_sums(symbols), symbols


def test_lexicon_weights_and_scores_recomputed(spark):
    """The whole model again in plain Python: counts, likelihood ratios, the optimum of the fit, scores."""
    import math
    import re
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    train = X.training_rows(docs, labels).collect()
    own = {}
    for r in train:
        own[r.text] = min(r.toxic, own.get(r.text, 1))
    toxic, total = sum(own.values()), len(own)
    counts = {}
    for text, y in own.items():
        words = set(re.findall(r"[^\W_]+", text.lower()))
        for term in words | {w[:n] + "*" for w in words for n in X.STEMS if len(w) >= n}:
            t, n = counts.get(term, (0, 0))
            counts[term] = (t + y, n + 1)
    share, telling = toxic / total, {}
    for term, (t, n) in counts.items():
        if t >= X.MIN_TOXIC_DOCS and t >= X.MIN_TOXIC_SHARE * n:
            c = n - t
            g = 2 * (t * math.log(t / (n * share)) + (c * math.log(c / (n * (1 - share))) if c else 0))
            if g >= 2 * math.log(total) + 6:
                telling[term] = (g, t, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (total - toxic + 1)))
    best = sorted(telling, key=lambda w: (-telling[w][0], w))[:X.LEXICON_TERMS]
    telling = {w: telling[w][1:] for w in best}
    words = {w: t for w, (t, _) in telling.items() if w[-1] != "*"}
    lexicon = {w: v for w, (t, v) in telling.items()
               if w[-1] != "*" or all(2 * words[x] < t for x in words if x.startswith(w[:-1]))}
    frame = spark.createDataFrame(train)
    learned = X.learn_lexicon(frame)
    assert learned.keys() == lexicon.keys() and all(abs(learned[w] - lexicon[w]) < 1e-9 for w in lexicon)
    weights = X.learn_weights(frame, learned)
    classes, slope = X._Classes(learned), [-X.RIDGE * w for w in weights]
    for r in train:
        x = plain_sums(X.classed(r.text, classes)) + [1.0]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights))))
        slope = [s + (r.toxic - p) * v for s, v in zip(slope, x)]
    assert max(map(abs, slope)) < 1e-6  # the gradient is zero: no better weights
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in X.score(docs, labels).collect():
        x = plain_sums(X.classed(texts[r.doc_id] or "", classes)) + [1.0]
        assert abs(r.score - 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, weights))))) < 1e-9


def test_edges(spark, edge, none, labels, no_labels, clashing):
    for own in (labels, no_labels):
        rows = X.score(clashing, own).collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 for r in rows)
    assert X.score(none, labels).count() == 0
    assert len({r.score for r in X.score(edge, no_labels).collect()}) == 1
    assert not next(r for r in X.score(edge, labels).collect() if r.doc_id is None).held_out
