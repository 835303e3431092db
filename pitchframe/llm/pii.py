"""Personal data: regular expressions propose spans, checksums confirm, context adjusts.

Column expressions only. For every kind the matches are extracted and the text is split
at them; lengths of the pieces give the places in code points. Patterns name where a
match may start, so that no run of characters is tried from each of its places; they
find what the plain patterns of the contract find.

Kinds of the contract are kept as validated. Kinds the method adds (bank account
numbers by mod 97, social security numbers by context) need a score of ``KEEP``.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
KEEP = 0.6
CONTEXT_CHARS = 48
#: Matches whose places are summed up together.
RUN = 256


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    context: str
    score: float
    boost: float = 0.3


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"mail|contact|@", 0.7),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"\bip\b|address|host|server", 0.6),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"card|visa|credit|payment|amex", 0.7),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"phone|tel|call|mobile|fax", 0.6),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"iban|account|bank", 0.7),
    Kind("ssn", r"(?<![0-9A-Za-z-])(?!000|666)[0-8][0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])", r"\bssn\b|social security", 0.4),
)
_SPAN = "struct<kind:string,start:int,end:int,score:double>"


def luhn_holds(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits ends in 0."""
    at = F.sequence(F.lit(1), F.char_length(digits))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def mod97_holds(account: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, is 1 modulo 97."""
    compact = F.regexp_replace(account, " ", "")
    moved = F.concat(F.substring(compact, F.lit(5), F.char_length(compact)), F.substring(compact, 1, 4))

    def step(rest: Column, i: Column) -> Column:
        code = F.ascii(F.substring(moved, i, F.lit(1)))
        return F.when(code < 58, rest * 10 + code - 48).otherwise(rest * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.char_length(moved)), F.lit(0), step) == 1


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    count = F.char_length(digits)
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(count.between(16, 19), luhn_holds(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return count.between(8, 15)
    if kind == "iban":
        return mod97_holds(value)
    return F.lit(True)


def _with_places(df: DataFrame, kind: Kind) -> DataFrame:
    """``df`` with the array of spans of one kind, places in code points, end exclusive."""
    name = kind.name
    found, parts, steps, sums = (f"__{name}_{x}" for x in ("found", "parts", "steps", "sums"))
    df = df.withColumn(found, F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0)))
    df = df.withColumn(parts, F.when(F.size(found) > 0, F.split("text", kind.pattern, -1)))
    # From the start of one match to the start of the next.
    step = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda part, match: F.struct(F.char_length(part).alias("gap"), F.char_length(match).alias("match")))
    df = df.withColumn(steps, step)
    runs = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int"))
    length = lambda total, s: total + s["gap"] + s["match"]
    totals = F.transform(runs, lambda r: F.aggregate(F.slice(steps, r * RUN + 1, F.lit(RUN)), F.lit(0), length))
    df = df.withColumn(f"{sums}_", F.when(F.size(found) > 0, totals))
    before = F.transform(f"{sums}_", lambda _, r: F.aggregate(F.slice(f"{sums}_", F.lit(1), r), F.lit(0), lambda a, b: a + b))
    df = df.withColumn(sums, before).drop(f"{sums}_")

    def span(match: Column, i: Column) -> Column:
        run = F.floor(i / RUN).cast("int")
        ahead = F.aggregate(F.slice(steps, run * RUN + 1, i % RUN), F.lit(0), length)
        start = F.element_at(sums, run + 1) + ahead + F.element_at(steps, i + 1)["gap"]
        around = F.concat(F.right(F.element_at(parts, i + 1), F.lit(CONTEXT_CHARS)), F.lit(" "), F.left(F.element_at(parts, i + 2), F.lit(CONTEXT_CHARS)))
        near = F.lower(around).rlike(kind.context)
        score = F.lit(kind.score) + F.when(near, F.lit(kind.boost)).otherwise(F.lit(0.0))
        return F.struct(F.lit(name).alias("kind"), start.alias("start"), (start + F.char_length(match)).alias("end"), score.alias("score"), match.alias("value"))

    spans = F.filter(F.transform(found, span), lambda s: valid(name, s["value"]))
    if name not in BASE_KINDS:
        spans = F.filter(spans, lambda s: s["score"] >= KEEP)
    spans = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    spans = F.when(F.size(found) > 0, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))
    return df.withColumn(name, spans).drop(found, parts, steps, sums)


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with an array of spans (kind, start, end, score) per kind, in a column named after it.

    A null text counts as empty and has none.
    """
    for kind in KINDS:
        docs = _with_places(docs, kind)
    return docs


def _listed(spans: list[str]) -> Column:
    each = F.transform(F.concat(*spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Counts, a digest of the contract's spans, and all spans of every document.

    Repeated rows give repeated results, no rows give none, other columns are ignored.
    Spans of different kinds may overlap. ``top_score`` is the surest span's score (null: no span).
    """
    rows = with_spans(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")))
    every = [k.name for k in KINDS]
    return rows.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listed(list(BASE_KINDS)).cast("binary"), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.array_max(F.transform(F.concat(*every), lambda s: s["score"])).alias("top_score"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, all columns kept.

    Spans that overlap become one, named after the first. A null text stays null. ``n_chars``,
    where there is one, counts the new text's code points; it stays as it is where nothing is found.
    """
    names = docs.columns
    hidden = {f: f"__kept_{f}" for f in names if f in {k.name for k in KINDS}}
    rows = docs.withColumnsRenamed(hidden)
    rows = with_spans(rows.withColumn("__given", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))))
    ordered = F.array_sort(F.transform(F.concat(*[k.name for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    rows = rows.withColumn("__spans", ordered).drop(*[k.name for k in KINDS])
    text = F.col("text")

    def step(done: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        piece = F.concat(F.substring(text, done["at"] + 1, s["start"] - done["at"]), label)
        apart = s["start"] >= done["at"]
        return F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(apart, F.concat(done["out"], F.array(piece))).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda done: F.concat(F.array_join(done["out"], ""), F.substring(text, done["at"] + 1, F.char_length(text)))
    found = F.size("__spans") > 0
    rows = rows.withColumn("__new", F.when(found, F.aggregate("__spans", start, step, rest)))
    values = {"text": F.when(found, F.col("__new")).otherwise(F.col("__given"))}
    if "n_chars" in names:
        values["n_chars"] = F.when(found, F.char_length("__new").cast("long")).otherwise(F.col("n_chars"))
    return rows.select(*[values[c].alias(c) if c in values else F.col(hidden.get(c, c)).alias(c) for c in names])
