"""Personal data: pattern spans, and terms whose co-occurrence in the corpus discloses them.

Base spans come from four fixed patterns. For the rest, every distinct base value is a protected
entity, and so is its general form (domain of an email, first three numbers of an ip, first six digits
of a card, a phone without its last four digits), which pools values that are rare by themselves. The
context of an entity is the whole document. Over the whole corpus

    information of an entity   IC(e)    = -log2(n(e) / N)
    mutual information         PMI(e,t) = log2(n(e,t) N / (n(e) n(t)))

count documents. The disclosed share is PMI / IC: 1 says that the term occurs with the entity alone. A
term that discloses at least ``DISCLOSED`` of an entity is generalised to its kind in the entity's
documents, if the corpus proves it. That many meetings happen by chance with a probability of at most
2^-proof, by the Chernoff bound

    proof = n(e,t) PMI(e,t) + (n(e) - n(e,t)) PMI(e, not t)

and every entity is held against every term of the corpus, so the least proof that counts is chosen as by
Benjamini and Hochberg: among the pairs taken, the expected share of chance meetings is at most ``CHANCE``.
One meeting never proves a disclosure; a value that occurs once can be disclosed through its general form.

Entities that occur in the same documents have the same statistics and are one class, told by two 64-bit
hashes of the documents, so a page of addresses and its copies meet their terms once. Terms are joined to
the words of the documents that hold them, and one ordered pass tells which words lie in base spans. All of
it is built-in functions.

Defined cases: null text counts as empty; a null doc_id gets base spans only (its text counts as a
document); equal doc_ids are one document in n(e) and n(e,t) and hide the same terms in those of their
texts that hold an entity, while n(t) and N count rows; repeated rows give repeated results; a span inside or across another is merged
with it in ``sanitized_text``; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import query, table
from .shared import cut_lineage

DISCLOSED = 0.8
CHANCE = 0.05
# Proofs are compared in sixteenths of a bit, up to 256 bits.
_FINE, _MOST = 16, 4096

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns. A match starts where its run starts or where the last match
# ended, which a possessive run needs to be told; runs of under 16 digits can't be cards.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}{3,}"
SPAN = "array<struct<start:int,end:int,value:string>>"
_STEP = 256
# Code points in a block of a text that is being cut.
_WIDTH = 1024


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _add(a: Column, x: Column) -> Column:
    return a + x


def _larger(a: Column, x: Column) -> Column:
    return F.greatest(a, x)


def _before(lengths: Column, merge=_add) -> Column:
    """Sum (or what ``merge`` gives, from 0) of the entries before each entry, in steps, so long arrays stay near linear."""

    def whole(values):
        return F.aggregate(values, F.lit(0), merge)

    def outer(values):
        blocks = F.sequence(F.lit(0), F.expr("0") + F.floor((F.size(values) - 1) / _STEP).cast("int"))
        sums = F.transform(blocks, lambda b: whole(F.slice(values, b * _STEP + 1, F.lit(_STEP))))

        def inner(totals):
            starts = F.transform(blocks, lambda b: whole(F.slice(totals, F.lit(1), b)))

            def each(first):
                return F.transform(
                    values,
                    lambda _, i: merge(
                        F.get(first, (i / _STEP).cast("int")),
                        whole(F.slice(values, (i / _STEP).cast("int") * _STEP + 1, i % _STEP)),
                    ),
                )

            return let(starts, each)

        return let(sums, inner)

    return let(lengths, outer)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,value>> of leftmost matches that don't overlap, in code points."""

    def located(found):
        def placed(parts):
            between = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.length(m))
            return let(
                _before(between),
                lambda before: F.transform(
                    found,
                    lambda m, i: F.struct(
                        (F.get(before, i) + F.length(F.get(parts, i))).alias("start"),
                        (F.get(before, i) + F.length(F.get(parts, i)) + F.length(m)).alias("end"),
                        m.alias("value"),
                    ),
                ),
            )

        return let(F.split(text, pattern, -1), placed)

    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(F.size(found) > 0, located(found)).otherwise(F.array().cast(SPAN)),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    size = F.length(digits)

    def add(total, i):
        x = F.substring(digits, i, F.lit(1)).cast("int")
        double = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((size - i) % 2 == 1, double).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    hint = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]{2}|[0-9]\\."))
    if kind == "card":
        hint = text.rlike("[0-9][\\x20-]?[0-9]")
    found = F.filter(matches(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
    return F.when(hint, found).otherwise(F.array().cast(SPAN))


def _entities(kind: str) -> Column:
    """Names of the values of a kind, then those of their general forms."""

    def value(m):
        return F.lower(m["value"]) if kind in ("email", "ip") else _digits(m["value"])

    def general(v):
        return {
            "email": lambda: F.substring_index(v, "@", -1),
            "ip": lambda: F.substring_index(v, ".", 3),
            "card": lambda: F.substring(v, 1, 6),
            "phone": lambda: F.substring(v, F.lit(1), F.length(v) - 4),
        }[kind]()

    def named(values):
        exact = F.transform(values, lambda v: F.concat(F.lit(kind + ":"), v))
        return F.concat(exact, F.transform(values, lambda v: F.concat(F.lit(kind + "s:"), general(v))))

    return let(F.transform(kind, value), named)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _least_proof(candidates: DataFrame, tests: DataFrame, chance: float) -> DataFrame:
    """One row ``bits``: the smallest proof at which chance explains at most ``chance`` of the pairs above it.

    The bins are at most ``_MOST`` + 1 rows, whatever the number of pairs.
    """
    bins = candidates.groupBy(F.least(F.floor(F.col("proof") * _FINE), F.lit(_MOST)).alias("bin")).agg(F.sum("weight").alias("weight"))
    above = F.sum("weight").over(Window.orderBy(F.col("bin").desc()))
    reached = bins.select("bin", above.alias("above")).join(F.broadcast(tests), F.lit(True))
    explained = F.log2("entities") + F.log2("terms") - F.col("bin") / _FINE <= F.log2(F.lit(chance) * F.col("above"))
    return reached.filter(explained).agg((F.min("bin") / _FINE).alias("bits"))


def disclosing_terms(named: DataFrame, docs: DataFrame, disclosed: float = DISCLOSED, chance: float = CHANCE) -> DataFrame:
    """(document, entity, term, share): the terms to hide in a document, by the smallest entity of their class.

    ``named`` has the entities (array) and texts of documents with entities; ``docs`` has all texts.
    """
    found = named.select("document", F.explode("entities").alias("entity")).distinct()
    total = docs.agg(F.greatest(F.count(F.lit(1)), F.lit(2)).alias("n"))
    trace = [F.bit_xor(F.xxhash64(F.lit(k), F.col("document"))).alias(f"trace_{k}") for k in range(2)]
    sizes = found.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *trace)
    key = ["n_e", "trace_0", "trace_1"]
    held = found.join(sizes, "entity").groupBy("document", *key).agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("weight"))
    held = cut_lineage(held.drop("trace_0", "trace_1"))
    vocabulary = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    vocabulary = cut_lineage(vocabulary)
    # n(e,t) is at most n(e), so log2(N / n(t)) bounds the mutual information of a term with any entity.
    reach = F.log2(F.col("n") / F.col("n_t")) >= disclosed * F.log2(F.col("n") / F.col("n_e")) - 1e-9
    most = held.groupBy("document").agg(F.max("n_e").alias("n_e"))
    near = (
        named.join(most, "document")
        .select("document", "n_e", F.explode(_terms(F.col("text"))).alias("term"))
        .join(vocabulary, "term")
        .join(F.broadcast(total), F.lit(True))
        .filter(reach)
        .select("document", "term", "n_t", "n")
        .distinct()
    )
    pairs = cut_lineage(near.join(held, "document").filter(reach))
    counted = pairs.groupBy("entity", "term", "n_e", "n_t", "n", "weight").agg(F.count(F.lit(1)).alias("n_et"))
    information = F.log2(F.col("n") / F.col("n_e"))
    pmi = F.log2(F.col("n_et") * F.col("n") / (F.col("n_e") * F.col("n_t")))
    without = F.col("n_e") - F.col("n_et")
    pmi_without = F.log2(without * F.col("n") / (F.col("n_e") * (F.col("n") - F.col("n_t"))))
    proof = F.col("n_et") * pmi + F.when((without > 0) & (F.col("n_t") < F.col("n")), without * pmi_without).otherwise(0.0)
    candidates = cut_lineage(
        counted.withColumn("share", F.when(information > 0, pmi / information).otherwise(0.0))
        .filter((F.col("share") >= disclosed) & (pmi > 0))
        .select("entity", "term", "share", "weight", proof.alias("proof"))
    )
    tests = sizes.agg(F.count(F.lit(1)).alias("entities")).join(vocabulary.agg(F.count(F.lit(1)).alias("terms")), F.lit(True))
    risky = candidates.join(F.broadcast(_least_proof(candidates, tests, chance)), F.col("proof") >= F.col("bits")).select("entity", "term", "share")
    return pairs.select("document", "entity", "term").join(risky, ["entity", "term"]).select("document", "entity", "term", "share")


def _term_spans(named: DataFrame, risky: DataFrame) -> DataFrame:
    """(doc_id, text_hash, term): spans of a document's words that are terms of it and touch no base span."""
    key = ["doc_id", "text_hash"]
    words = named.select("document", *key, F.explode(matches(F.col("text"), TERM)).alias("m"))
    words = words.select("document", *key, "m.*", F.lower("m.value").alias("term")).join(risky.select("document", "term").distinct(), ["document", "term"])
    base = named.join(risky.select("document").distinct(), "document").select(*key, F.explode("base").alias("m"))
    base = base.select(*key, "m.start", "m.end", F.lit(None).cast("string").alias("value"))
    both = words.select(*key, "start", "end", "value").unionByName(base).distinct()
    # Both frames grow from an end of the text: a frame that shrinks would be read anew for each row.
    grown = lambda order: Window.partitionBy(*key).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier, later = grown(F.col("start").asc()), grown(F.col("start").desc())
    is_base = F.col("value").isNull()
    both = both.withColumns({"reached": F.max(F.when(is_base, F.col("end"))).over(earlier), "next": F.min(F.when(is_base, F.col("start"))).over(later)})
    free = ~is_base & (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    spans = F.array_sort(F.collect_list(F.struct("start", "end", "value")))
    return both.filter(free).groupBy(*key).agg(spans.alias("term"))


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _sanitized(text: Column, spans: Column) -> Column:
    """Covered text becomes the kind in brackets; overlapping spans leave nothing between them.

    Texts are cut in blocks, so a span costs its own length and a block, not a walk through the text.
    """

    def part(blocks, start, end):
        def piece(k):
            first = F.greatest(start - k * _WIDTH, F.lit(0))
            return F.substring(F.get(blocks, k), first + 1, F.least(end - k * _WIDTH, F.lit(_WIDTH)) - first)

        covered = F.sequence((start / _WIDTH).cast("int"), ((end - 1) / _WIDTH).cast("int"))
        return F.when(end > start, F.array_join(F.transform(covered, piece), "")).otherwise("")

    def build(ordered, blocks):
        ends = F.transform(ordered, lambda s: s["end"])

        def joined(reached):
            def piece(s, i):
                return F.concat(part(blocks, F.get(reached, i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))

            return F.array_join(F.transform(ordered, piece), "")

        tail = let(F.array_max(ends), lambda last: part(blocks, last, F.length(text)))
        return F.concat(let(_before(ends, _larger), joined), tail)

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_WIDTH}}}"), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(F.array_sort(spans), lambda ordered: let(cut, lambda blocks: build(ordered, blocks))))


def sanitize(
    docs: DataFrame,
    disclosed: float = DISCLOSED,
    chance: float = CHANCE,
    with_text: bool = True,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, one array of spans per kind (``term`` last), sanitized_text if asked for, and the columns
    of ``carry`` as they were."""
    carried = [F.col(n).alias(f"_carried_{k}") for k, n in enumerate(carry)]
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"), *carried)
    # Texts without doc_id are documents of their own; the leading letter keeps both kinds apart.
    document = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.md5("text")))
    docs = whole.select("doc_id", "text_hash", document.alias("document"), "text")
    entities = F.array_distinct(F.concat(*(_entities(kind) for kind in KINDS)))
    found = docs.withColumns({kind: base_spans(F.col("text"), kind) for kind in KINDS})
    found = found.select(*docs.columns, F.concat(*KINDS).alias("base"), entities.alias("entities"))
    named = cut_lineage(found.filter(F.size("entities") > 0))
    risky = cut_lineage(disclosing_terms(named.select("document", "text", "entities"), docs.select("text"), disclosed, chance))
    terms = _term_spans(named.filter("doc_id IS NOT NULL"), risky)
    spanned = whole.join(terms, ["doc_id", "text_hash"], "left").withColumns({k: base_spans(F.col("text"), k) for k in KINDS})
    spanned = spanned.withColumn("term", F.coalesce("term", F.array().cast(SPAN)))
    out = ["doc_id", *KINDS, "term"]
    if with_text:
        tagged = F.concat(*(_tagged(k) for k in (*KINDS, "term")))
        spanned = spanned.withColumn("_tagged", tagged).withColumn("sanitized_text", _sanitized(F.col("text"), F.col("_tagged")))
        out.append("sanitized_text")
    return spanned.select(*out, *(F.col(f"_carried_{k}").alias(n) for k, n in enumerate(carry)))


def _written(kind: str) -> Column:
    return F.transform(kind, lambda m: F.concat_ws(":", F.lit(kind), m["start"], m["end"]))


@query("op7_pii_disclosure")
def op7(spark, folder):
    out = sanitize(table(spark, folder, "documents"), with_text=False)
    base = F.concat(*(_written(k) for k in KINDS))
    return out.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _written("term")), ",").alias("spans"),
    )
