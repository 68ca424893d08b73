"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust their score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowmill.llm.table import fresh, lowered, replace

# Characters before and after a span in which context words count, and what they add to its score.
CONTEXT_CHARS = 48
CONTEXT_SCORE = 0.2
# A proposed span of the added kinds is kept from this score on; base kinds are always kept.
KEEP_SCORE = 0.6


@dataclass(frozen=True)
class Kind:
    """A pattern, the check its matches must pass, and the words that make it likelier.

    Patterns never give characters back (possessive repeats, starts only where a run starts or the last match
    ended), so a text is scanned in time linear in its length; they match what their plain forms match.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    needs: str | None = None
    words: tuple[str, ...] = ()
    score: float = 0.7
    base: bool = True


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check: every second digit from the right is doubled."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(
        values, lambda v, i: F.when(i % 2 == 0, v).otherwise(v * 2 - F.when(v > 4, 9).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, country and check digits moved to the end, letters as 10 to 35, leaves 1."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return F.when(value > 9, (rest * 100 + value) % 97).otherwise((rest * 10 + value) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), step) == 1


def _valid_ip(text: Column) -> Column:
    parts = F.split(text, "\\.")
    return F.forall(parts, lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _valid_card(text: Column) -> Column:
    digits = _digits(text)
    return F.length(digits).between(16, 19) & luhn(digits)


def _valid_account(text: Column) -> Column:
    plain = F.regexp_replace(text, " ", "")
    return F.length(plain).between(15, 34) & mod97(plain)


def _valid_ssn(text: Column) -> Column:
    area, group, serial = F.substring(text, 1, 3), F.substring(text, 5, 2), F.substring(text, 8, 4)
    return ~area.isin("000", "666") & (F.substring(text, 1, 1) != "9") & (group != "00") & (serial != "0000")


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda t: F.lit(True), "@", ("mail", "contact", "write", "reach"),
    ),
    Kind(
        "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _valid_ip, ".",
        ("ip", "server", "host", "address"), 0.5,
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _valid_card, None, ("card", "visa", "credit", "payment"), 0.8),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: F.length(_digits(t)).between(8, 15), "+",
        ("tel", "phone", "call", "fax", "mobile"), 0.6,
    ),
    Kind(
        "iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", _valid_account, None,
        ("iban", "account", "bank", "konto", "compte"), 0.7, base=False,
    ),
    # Figures like these are order numbers as often as not: without their words they stay below the bar.
    Kind(
        "ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", _valid_ssn, "-", ("ssn", "social", "security number", "insured"), 0.45, base=False,
    ),
)


def _spans(text: Column, kind: Kind) -> Column:
    """Matches of a kind in order, with start and end in code points.

    The text between matches is split off by the same pattern, so its lengths give the positions.
    """
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.transform(F.split(text, kind.pattern, -1), lambda g: F.length(g))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + pair["gap"]
        end = start + F.length(pair["match"])
        span = F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("spans"))
    placed = F.aggregate(F.filter(pairs, lambda p: p["match"].isNotNull()), start, add, lambda a: a["spans"])
    return F.filter(placed, lambda s: kind.valid(s["text"]))


def find(df: DataFrame, text_column: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``pii``: an array of ``kind, start, end, text, score`` by order of kinds, then start.

    Each kind's matches are leftmost and do not overlap; a match that fails its check is dropped and not
    searched again. Kinds are independent: a card inside a phone number is reported under both. The score
    is the kind's own, plus ``CONTEXT_SCORE`` when one of its words starts within the ``CONTEXT_CHARS`` characters
    before or after the span, at most 1; kinds that are not base kinds are kept from ``KEEP_SCORE`` on, so that a kind whose
    own score is below needs its context. NULL and empty texts have an empty array. A column called ``pii`` is replaced; any other column is kept.
    """
    raw, = fresh(df, "pii_text")
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    prepared = df.withColumn(raw, text)
    names = fresh(prepared, *(f"pii_{k.name}" for k in kinds))
    digits = F.col(raw).rlike("[0-9]")
    columns = {}
    for kind, name in zip(kinds, names, strict=True):
        may = digits if kind.needs is None else F.contains(F.col(raw), F.lit(kind.needs))
        empty = F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)")
        columns[name] = F.when(may, _spans(F.col(raw), kind)).otherwise(empty)
    found = prepared.withColumns(columns)

    def scored(kind: Kind, name: str) -> Column:
        def score(s: Column) -> Column:
            start = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
            words = "(?<![a-z])(?:" + "|".join(kind.words) + ")"
            before = lowered(F.substring(F.col(raw), start + 1, s["start"] - start))
            after = lowered(F.substring(F.col(raw), s["end"] + 1, F.lit(CONTEXT_CHARS)))
            near = before.rlike(words) | after.rlike(words)
            value = F.least(F.lit(kind.score) + F.when(near, CONTEXT_SCORE).otherwise(0.0), F.lit(1.0))
            return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), value.alias("score"))

        all_spans = F.transform(F.col(name), score)
        return all_spans if kind.base else F.filter(all_spans, lambda s: s["score"] >= KEEP_SCORE)

    pii = F.concat(*(scored(k, n) for k, n in zip(kinds, names, strict=True)))
    return replace(found, {"pii": pii}).drop(raw, *names)


def redact(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` with every found span of the text replaced by its kind in brackets, e.g. ``[email]``.

    Where spans of two kinds overlap, the one that starts first covers both. ``pii`` is added as by ``find``.
    """
    found = find(df, text_column)
    text = F.col(f"`{text_column}`")
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def add(acc: Column, s: Column) -> Column:
        clear = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(clear, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"),
        )

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("parts"))
    done = F.aggregate(
        spans, start, add, lambda a: F.concat(F.array_join(a["parts"], ""), F.substring(text, a["at"] + 1, F.length(text)))
    )
    new = F.when(F.size("pii") > 0, done).otherwise(text)
    return found.select(*(new.alias(c) if c == text_column else F.col(f"`{c}`") for c in found.columns))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def document_spans(documents: DataFrame) -> DataFrame:
    """The digest of personal data per document: counts of the base kinds, a hash of base spans, all spans."""
    base = [k.name for k in KINDS if k.base]

    def joined(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    found = find(documents.select("doc_id", "text"))
    n = [F.size(F.filter("pii", _is(k))).cast("bigint").alias(f"n_{k}") for k in base]
    own = F.filter("pii", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *n, F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )
