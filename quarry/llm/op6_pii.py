"""Personal data: patterns propose spans, checksums confirm them, context words score them.

Only SQL expressions run, so nothing leaves the JVM. A pattern's matches come from
``regexp_extract_all`` and the text between them from ``split`` by the same pattern,
so the places of matches are running sums of lengths. The sums go in blocks, which grow
with the cube root of a text's matches and keep it from costing the square of their number.

A kind has a prior score. Context words before a span lift it, words that speak of
something else (an order, a part) lower it, and an added span counts from ``ENOUGH``.
Spans of the base kinds count whatever their score, as their contract says; the score of
every span is returned.

The patterns below find what the plain patterns of the contract find, leftmost and
without overlap, but start only where a run starts, so that one long run of letters
or digits is read once and not once from each of its bytes.

Defined results: a null text counts as empty and has no spans; equal texts get equal
spans; an empty table gives an empty result; very long texts are read whole, in time
linear in their length; null ids stay null; in ``redact`` all columns of the input stay,
whatever their names, and only ``text`` (and ``n_chars``, if there) changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Matches of a block of running sums, at least.
BLOCK = 64
#: Code points before a span in which context words count.
NEAR = 48


@dataclass(frozen=True)
class Kind:
    """needs: a cheap test of the text; valid: SQL over the match ``m``; prior: score without context; context, against:
    words near it that lift and lower the score."""

    name: str
    pattern: str
    needs: str
    valid: str
    prior: float
    context: str
    against: str = "zzzz"
    base: bool = True


LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN (length({d}) - i) % 2 = 0 THEN int(substr({d}, i, 1)) "
    "ELSE int(substr({d}, i, 1)) * 2 - CASE WHEN int(substr({d}, i, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0"
).format(d="regexp_replace(m, '[ -]', '')")
MOD97 = (
    "aggregate(split(concat(substr({d}, 5), substr({d}, 1, 4)), ''), 0, (a, c) -> CASE WHEN c = '' THEN a "
    "WHEN c BETWEEN '0' AND '9' THEN (a * 10 + int(c)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) = 1"
).format(d="replace(m, ' ', '')")
SMALL_PART = "coalesce(length(trim(LEADING '0' FROM p)) <= 3 AND int(concat('0', trim(LEADING '0' FROM p))) <= 255, false)"

#: What speaks of other numbers than a person's.
OTHER = "order|part|serial|version|model|item|invoice|commande|bestell|pedido"

#: The first four, in this order, are the base kinds; the rest the method adds.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", "true", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"{t} rlike '[0-9][.][0-9]'", f"forall(split(m, '[.]'), p -> {SMALL_PART})", 0.6, "ip|host|server|address"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", r"{t} rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", LUHN, 0.7, "card|visa|credit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "contains({t}, '+')", "length(regexp_replace(m, '[^0-9]', '')) BETWEEN 9 AND 15", 0.6, "phone|tel|call|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"{t} rlike '[A-Z][A-Z][0-9][0-9]'", MOD97, 0.8, "iban|bank|account|konto|compte|cuenta", OTHER, False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"{t} rlike '[0-9]-[0-9][0-9]-[0-9]'", "NOT (m rlike '^(000|666|9)' OR m rlike '-00-' OR m rlike '-0000$')", 0.4, "ssn|social|security", OTHER, False),
)
#: What context words add to the prior, what other words take, and the score from which an added span counts.
LIFT, DROP, ENOUGH = 0.4, 0.4, 0.7


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _found(df: DataFrame, kind: Kind, text: str) -> DataFrame:
    """Adds m_<kind>, its matches, and g_<kind>, the text between them; both null where there is none."""
    k = kind.name
    df = df.withColumn(f"m_{k}", F.expr(f"CASE WHEN {kind.needs.format(t=text)} THEN regexp_extract_all({text}, {_quoted(kind.pattern)}, 0) END"))
    return df.withColumn(f"g_{k}", F.expr(f"CASE WHEN size(m_{k}) > 0 THEN split({text}, {_quoted(kind.pattern)}, -1) END"))


def _score(kind: Kind) -> str:
    """SQL of the score of match ``i``, by the text before it (``g_<kind>``). Words that lift outweigh those that lower."""
    near = f"lower(right(get(g_{kind.name}, i), {NEAR}))"
    return f"double({kind.prior} + CASE WHEN {near} rlike '{kind.context}' THEN {LIFT} WHEN {near} rlike '{kind.against}' THEN -{DROP} ELSE 0.0 END)"


def _placed(df: DataFrame, kind: Kind, order: int) -> DataFrame:
    """Turns m_ and g_ into s_<kind>: structs of start, order, end, kind, score for the matches that pass."""
    k = kind.name
    df = df.withColumn(f"l_{k}", F.expr(f"zip_with(slice(g_{k}, 1, size(m_{k})), m_{k}, (g, m) -> length(g) + length(m))"))
    df = df.withColumn(f"z_{k}", F.expr(f"greatest({BLOCK}, int(ceil(cbrt(size(l_{k})))))"))
    df = df.withColumn(f"b_{k}", F.expr(f"transform(sequence(0, int((size(l_{k}) - 1) div z_{k})), b -> aggregate(slice(l_{k}, b * z_{k} + 1, z_{k}), 0, (a, x) -> a + x))"))
    df = df.withColumn(f"b_{k}", F.expr(f"aggregate(b_{k}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"))
    end = f"get(b_{k}, int(i div z_{k})) + aggregate(slice(l_{k}, int(i div z_{k}) * z_{k} + 1, i % z_{k} + 1), 0, (a, y) -> a + y)"
    df = df.withColumn(f"s_{k}", F.expr(f"transform(m_{k}, (m, i) -> struct({end} - length(m) AS start, {order} AS ord, {end} AS end, '{k}' AS kind, CASE WHEN {kind.valid} THEN {_score(kind)} END AS score))"))
    least = 0.0 if kind.base else ENOUGH
    return df.withColumn(f"s_{k}", F.expr(f"coalesce(filter(s_{k}, s -> s.score >= {least}), array())")).drop(f"m_{k}", f"g_{k}", f"l_{k}", f"b_{k}", f"z_{k}")


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and for each kind s_<kind>: array of (start, ord, end, kind, score), code points, end exclusive."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in kinds:
        df = _found(df, kind, "text")
    df = df.drop("text")
    for order, kind in enumerate(kinds):
        df = _placed(df, kind, order)
    return df


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans in order, and their scores in the same order."""
    found = find(docs, kinds)
    base = [k.name for k in kinds if k.base]
    return found.select(
        "doc_id",
        *(F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in base),
        F.sha2(joined(F.concat(*(f"s_{k}" for k in base))), 256).alias("base_sha256"),
        joined(F.concat(*(f"s_{k.name}" for k in kinds))).alias("spans"),
        F.array_join(F.transform(F.array_sort(F.concat(*(f"s_{k.name}" for k in kinds))), lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"),
    )


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """The documents with valid spans replaced by ``[KIND]``, kind after kind, each in the text that the one before left.

    The text is put together from the pieces between matches, so no place is computed.
    """
    df = docs.select(F.struct("*").alias("row"), "text")  # no name of the input meets those below
    for kind in kinds:
        k, mark = kind.name, f"[{kind.name.upper()}]"
        least = 0.0 if kind.base else ENOUGH
        df = _found(df, kind, "text")
        pieces = f"transform(g_{k}, (g, i) -> concat(g, coalesce(get(transform(filter(array(get(m_{k}, i)), m -> m IS NOT NULL), m -> CASE WHEN {kind.valid} AND {_score(kind)} >= {least} THEN '{mark}' ELSE m END), 0), '')))"
        df = df.withColumn("text", F.expr(f"CASE WHEN g_{k} IS NULL THEN text ELSE array_join({pieces}, '') END")).drop(f"m_{k}", f"g_{k}")
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("row").getField("n_chars"))
    return df.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
