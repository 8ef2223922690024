"""Personal data: patterns propose, checksums confirm, context adjusts (operator 5).

Each kind has a pattern whose matches are proposed leftmost and without
overlap, a check that drops some (octets of an address, Luhn for cards, mod-97
for IBANs, digit counts for phones), and a base score that words in the
surrounding text raise or lower. The four base kinds (email, ip, card, phone)
are reported whatever their score; the other kinds where it reaches
``min_score``. Spans are code points, end exclusive.

Everything is built of DataFrame functions. Patterns use possessive loops and
start only at the start of a run, so no text makes them backtrack or recurse
(a run of a million digits is read once). Offsets come from the lengths of the
text between the matches: running sums over an array, taken in blocks, so a
text with very many matches stays far from quadratic cost.

Scale. One map over the texts, no shuffle.

Edge cases. Null text: treated as empty, no spans. Empty table: empty result.
Overlapping spans of different kinds are all reported, but for further kinds
wholly inside a base span; :func:`redact` masks their union. Repeated rows: each
handled alone. Other columns are kept, whatever their names (one named
``spans`` is replaced by :func:`find`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fedsearch.llm.common import pack, unpack

MIN_SCORE = 0.5
CONTEXT_STEP = 0.3
BEFORE, AFTER = 40, 20
_BLOCK = 128


def with_running(rows: DataFrame, out: str, values: str, zero: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Add ``out``: for each element of the array ``values``, ``step`` folded over the elements before it.

    Block results and the results before each block are columns of their own,
    so each is computed once per row. (Each is named twice below: Spark merges
    a projection into its only use, which here would run it per element.)
    """
    every, blocks, before = F.col(values), F.col("_blocks"), F.col("_before")

    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, step)

    def block(i: Column) -> Column:
        return F.floor(i / _BLOCK).cast("int")

    rows = rows.withColumn("_blocks", F.when(F.size(every) > 0, F.transform(
        F.sequence(F.lit(0), block(F.size(every))), lambda b: fold(F.slice(every, b * _BLOCK + 1, F.lit(_BLOCK))))))
    rows = rows.withColumn("_before", F.when(F.size(blocks) > 0, F.transform(
        blocks, lambda _, b: fold(F.slice(blocks, F.lit(1), b)))))
    return rows.withColumn(out, F.when(F.size(before) > 0, F.transform(every, lambda _, i: step(
        F.get(before, block(i)), fold(F.slice(every, block(i) * _BLOCK + 1, i % _BLOCK)))))).drop("_blocks", "_before")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _octets(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: x.rlike("^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))


def _luhn(m: Column) -> Column:
    d = _digits(m)

    def value(i: Column) -> Column:  # i-th digit from the right, the even ones doubled
        x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, x).when(x > 4, x * 2 - 9).otherwise(x * 2)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + value(i))
    return F.length(d).between(14, 19) & (total % 10 == 0)


def _mod97(m: Column) -> Column:
    s = F.replace(m, F.lit(" "), F.lit(""))
    s = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))

    def value(a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(s, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return (F.length(s).between(15, 34)
            & (F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), value) == 1))


def _phone_digits(m: Column) -> Column:
    return F.length(_digits(m)).between(10, 15)


def _any(m: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    near: str  # words that raise the score
    far: str = "example|sample|dummy|version|isbn|invoice"  # words that lower it
    base: bool = False
    holds: str = ""  # a string that every match holds


#: The base kinds are the contract's, in its order. Their patterns find the same matches as the contract's,
#: which may start anywhere in a run: a match that starts inside a run has the same end as one at its start.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", _any, 0.9,
         "mail|contact|write|kontakt|correo|courriel", base=True, holds="@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets, 0.7,
         "ip|address|server|host|login", base=True),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", _luhn, 0.8,
         "card|visa|credit|master|payment|karte|carte|tarjeta", base=True),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", _phone_digits, 0.7,
         "phone|call|tel|mobile|fax|whatsapp", base=True, holds="+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?+)"
                 r"(?![A-Za-z0-9])", _mod97, 0.9, "iban|bank|account|konto|cuenta|compte"),
    Kind("access_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", _any, 0.9, "key|aws|access|secret", holds="AKIA"),
    Kind("secret", r"(?<![A-Za-z])(?i:password|passwd|secret|token|api_key) ?[=:] ?\"?[A-Za-z0-9+/_-]{8,}+\"?+", _any,
         0.8, "login|key|auth|credential"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _any, 0.3, "ssn|social|security|tax"),
    Kind("local_phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])", _any, 0.3,
         "phone|call|tel|mobile|fax|whatsapp"),
)


def _proposed(kind: Kind, no: int, gaps: Column, starts: Column) -> Callable[[Column, Column], Column]:
    """The span of the i-th match; ``gaps``: the text around the matches, ``starts``: where each gap begins."""
    def span(x: Column, i: Column) -> Column:
        before, after = F.get(gaps, i), F.get(gaps, i + 1)
        near = F.lower(F.concat_ws(" ", F.right(before, F.lit(BEFORE)), F.left(after, F.lit(AFTER))))
        score = (F.lit(kind.score) + F.when(near.rlike(rf"\b(?:{kind.near})"), CONTEXT_STEP).otherwise(0.0)
                 - F.when(near.rlike(rf"\b(?:{kind.far})"), CONTEXT_STEP).otherwise(0.0))
        start = F.get(starts, i) + F.length(before)
        return F.struct(start.alias("start"), F.lit(no).alias("kind_no"), (start + F.length(x)).alias("end"),
                        F.lit(kind.name).alias("kind"),
                        F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2).alias("score"),
                        kind.valid(x).alias("valid"))
    return span


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with ``spans``: an array of ``(start, kind_no, end, kind, score)`` in order of start, then kind;
    base kinds come before the others of ``kinds``."""
    kinds = tuple(sorted(kinds, key=lambda k: not k.base))
    own = docs.drop("spans")
    rows = pack(own, "text").withColumn("_text", F.coalesce("text", F.lit("")))
    for no, kind in enumerate(kinds):
        m, gaps, starts = (F.col(f"_{x}") for x in ("matches", "gaps", "starts"))
        found = F.regexp_extract_all("_text", F.lit(kind.pattern), F.lit(0))
        if kind.holds:  # a text without it is not searched
            found = F.when(F.contains("_text", F.lit(kind.holds)), found).otherwise(F.array().cast("array<string>"))
        rows = (rows.withColumn("_matches", found)
                .withColumn("_gaps", F.when(F.size(m) > 0, F.split("_text", kind.pattern, -1)))
                .withColumn("_sizes", F.transform(m, lambda x, i: F.length(x) + F.length(F.get(gaps, i)))))  # noqa: B023
        rows = (with_running(rows, "_starts", "_sizes", F.lit(0), lambda a, x: a + x)
                .withColumn(f"_spans{no}", F.transform(m, _proposed(kind, no, gaps, starts)))
                .withColumn(f"_spans{no}", F.filter(f"_spans{no}", lambda s: s["valid"] if kind.base  # noqa: B023
                                                    else s["valid"] & (s["score"] >= min_score)))
                .drop("_matches", "_gaps", "_sizes", "_starts"))
    n_base = sum(k.base for k in kinds)
    rows = rows.select("_row", "text", F.sort_array(F.concat(*[f"_spans{no}" for no in range(len(kinds))])).alias("_all"))
    # A further kind says nothing new inside a base span; one that reaches beyond it does. In order of start,
    # base kinds first, a span lies inside one before it if its end is not beyond the furthest base end so far.
    rows = rows.withColumn("_ends", F.transform("_all", lambda s: F.when(s["kind_no"] < n_base, s["end"]).otherwise(-1)))
    rows = with_running(rows, "_reach", "_ends", F.lit(-1), lambda a, x: F.greatest(a, x))
    kept = F.filter("_all", lambda s, i: (s["kind_no"] < n_base) | (s["end"] > F.get("_reach", i)))
    spans = F.transform(kept, lambda s: s.dropFields("valid"))
    return unpack(rows.select("_row", "text", spans.alias("spans")), own, _also=("spans",))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every span of its text replaced by ``<KIND>`` and ``n_chars`` to match."""
    rows = find(pack(docs, "text"), **options)
    ends = F.transform("spans", lambda s: s["end"])
    # `_from`: where the spans before this one end
    rows = with_running(rows.withColumn("_ends", ends), "_from", "_ends", F.lit(0), lambda a, x: F.greatest(a, x))
    rows = rows.withColumn("_chars", F.when(F.size("spans") > 0, F.split("text", "")))

    def piece(s: Column, i: Column) -> Column:
        since = F.get(F.col("_from"), i)
        return F.when(s["end"] <= since, "").otherwise(F.concat(
            F.array_join(F.slice(F.col("_chars"), since + 1, F.greatest(s["start"] - since, F.lit(0))), ""),
            F.lit("<"), F.upper(s["kind"]), F.lit(">")))

    last = F.array_max("_ends")
    rest = F.array_join(F.slice(F.col("_chars"), last + 1, F.greatest(F.size("_chars") - last, F.lit(0))), "")
    masked = F.concat(F.array_join(F.transform("spans", piece), ""), rest)
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")))
    new = {}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("_row")["n_chars"])
    return unpack(rows.select("_row", "text", "spans"), docs, **new)
