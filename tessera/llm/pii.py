"""Personal data by weak supervision, in DataFrame functions only.

Base spans come from fixed patterns and checks. Candidate spans (the base ones, those that
failed a check, and long mixed tokens) get votes from four labelers: pattern check, gazetteer,
context and shape; a labeler may abstain. The votes of all documents are counted by vote and
feature pattern (a table of bounded size), expectation-maximisation over that table estimates
each labeler's reliability, and a naive Bayes span classifier is trained on its posteriors.
Candidates that the classifier accepts are added to the base spans, which always stay.

Positions are found natively: the same pattern splits a text into gaps and extracts the
matches, and running lengths of gaps and matches are the starts and ends, in code points.
Features of the classifier are a span's kind, length, context and whether it passed its check.

Defined results: a null text is empty and has no spans; repeated rows are each reported;
columns besides doc_id and text play no part; on an empty table the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: The kinds in their order, and the patterns. `\G` is the end of the last match; possessive
#: quantifiers and the look-behind only save attempts that cannot succeed (and Java's stack, on long runs).
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_])(?=[A-Za-z_]*+[0-9])[A-Za-z0-9_]{16,128}+(?![A-Za-z0-9_])"
IP_PART = r"^0*[0-9]{1,3}(?:\.0*[0-9]{1,3}){3}$"

#: Gazetteers and context words.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|example)$"
RESERVED_IP = r"^(?:0|10|127|255)\.|^192\.168\.|^169\.254\."
ISSUERS = r"^(?:4|5[1-5]|3[47]|6011|65|35|2[2-7])"
CALLING = r"^\+(?:1|7|33|34|39|41|43|44|49|81|86|91)(?![0-9]{0,1}[0-9]{12})"
CONTEXT = {
    "email": r"(?i)mail|contact|write|reach|@",
    "ip": r"(?i)\bip\b|address|host|server|login|from",
    "card": r"(?i)card|visa|master|amex|payment|credit",
    "phone": r"(?i)phone|call|tel|mobile|fax|contact|reach",
    "secret": r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|credential)s?\W{0,6}$",
}
AGAINST = r"(?i)(?:version|isbn|issn|figure|section|chapter|page|commit|sha|hash|uuid|id)\W{0,6}$"
#: Features of a kind: four lengths, context or not, passed check or not.
FEATURES = 16
LABELERS = ("check", "gazetteer", "context", "shape")
ABSTAIN = 2


#: Matches of a block: running lengths are folded inside a block, then over blocks.
BLOCK = 64
#: Code points before a match that make its context.
LEFT = 24


def bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, possible: Column) -> Column:
    """array<struct<s, e, t, left>>: start, end and text of all matches, where `possible` holds.

    left is the end of the match before, followed by the gap between. Lengths of gaps and matches are summed in
    two levels, so the cost grows with the text and, very nearly, with its matches."""
    none = F.from_json(F.lit("[]"), "array<struct<s:int,e:int,t:string,left:string>>")

    def parts(found: Column) -> Column:
        before = F.concat(F.array(F.lit("")), found)
        zipped = F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("g"), found.alias("m"), before.alias("p")), F.lit(1), F.size(found))
        return F.transform(zipped, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("t"), F.right(F.concat(x["p"], x["g"]), F.lit(LEFT)).alias("left")))

    def fold(block: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            s = acc["at"] + x["g"]
            span = F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["t"].alias("t"), x["left"].alias("left"))
            return F.struct((s + x["n"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def placed(blocks: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), "array<int>").alias("out"))
        bases = F.aggregate(blocks, zero, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])
        moved = lambda x, base: F.struct((x["s"] + base).alias("s"), (x["e"] + base).alias("e"), x["t"].alias("t"), x["left"].alias("left"))
        return F.flatten(F.zip_with(blocks, bases, lambda b, base: F.transform(b["out"], lambda x: moved(x, base))))

    def spans(found: Column) -> Column:
        each = bound(parts(found), lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: fold(F.slice(p, i * BLOCK + 1, F.lit(BLOCK)))))
        return F.when(F.size(found) > 0, bound(each, placed)).otherwise(none)

    return F.when(possible, bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(none)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    return F.aggregate(
        F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int"))),
        F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, text: Column) -> Column:
    """The check of a kind's match."""
    if kind == "ip":
        return text.rlike(IP_PART) & F.forall(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9]{4})", "").try_cast("long") <= 255)
    if kind == "card":
        return F.length(digits(text)).between(13, 19) & luhn(digits(text))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    if kind == "secret":
        return text.rlike("^[0-9a-f]{24,}$")
    return F.lit(True)


def _votes(kind: str, text: Column, left: Column) -> tuple[Column, Column, Column, Column]:
    vote = lambda yes, no=None: F.when(yes, 1).when(no, 0).otherwise(ABSTAIN) if no is not None else F.when(yes, 1).otherwise(ABSTAIN)
    gazetteer = {
        "email": vote(text.rlike(DOMAINS)), "ip": vote(F.lit(False), text.rlike(RESERVED_IP)), "card": vote(digits(text).rlike(ISSUERS), ~digits(text).rlike(ISSUERS)),
        "phone": vote(text.rlike(CALLING)), "secret": F.lit(ABSTAIN)}[kind]
    shape = {
        "email": vote(text.rlike("^[^@]{1,64}@"), ~text.rlike("^[^@]{1,64}@")), "ip": vote(~text.rlike(r"(?:^|\.)0[0-9]"), text.rlike(r"(?:^|\.)0[0-9]")),
        "card": vote(F.length(digits(text)).between(15, 16), ~F.length(digits(text)).between(12, 19)), "phone": vote(text.rlike(r"[\x20()-]"), F.length(digits(text)) < 7),
        "secret": vote(text.rlike("^[0-9a-f]+$"), ~text.rlike("[A-Za-z]"))}[kind]
    return vote(valid(kind, text), ~valid(kind, text)), gazetteer, vote(left.rlike(CONTEXT[kind]), left.rlike(AGAINST)), shape


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind, s, e) and other candidates (kind, s, e), each with votes and feature code."""
    text = F.coalesce(F.col("text"), F.lit(""))
    doc = docs.select("doc_id", text.alias("text"))
    digit = F.col("text").rlike("[0-9]{2}")
    found = doc.select(
        "doc_id", "text",
        matches(F.col("text"), EMAIL, F.col("text").contains("@")).alias("email"),
        matches(F.col("text"), IP, F.col("text").rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")).alias("ip"),
        matches(F.col("text"), CARD, F.col("text").rlike(r"[0-9](?:[\x20-]?[0-9]){11}")).alias("card"),
        matches(F.col("text"), PHONE, F.col("text").contains("+")).alias("phone"),
        matches(F.col("text"), SECRET, digit & F.col("text").rlike(r"[A-Za-z0-9_]{16}")).alias("secret"),
    )

    def judged(k: int, kind: str) -> Column:
        def one(x: Column) -> Column:
            v = _votes(kind, x["t"], x["left"])
            code = sum((c * 3**i for i, c in enumerate(v[1:], start=1)), v[0])
            feature = F.lit(k * FEATURES) + F.least(F.floor(F.length(x["t"]) / 8).cast("int"), F.lit(3)) * 4 + v[2].eqNullSafe(1).cast("int") * 2 + v[0].eqNullSafe(1).cast("int")
            return F.struct(F.lit(k).alias("k"), x["s"].alias("s"), x["e"].alias("e"), code.cast("int").alias("v"), feature.cast("int").alias("f"))

        return F.transform(F.col(kind), one)

    return found.select("doc_id", F.concat(*(judged(k, kind) for k, kind in enumerate(KINDS))).alias("c"))


def reliabilities(counts: DataFrame, rounds: int = 25) -> DataFrame:
    """One row: the model of expectation-maximisation over counts of (v, f, n), and the classifier's weight of each feature.

    model[0] is the share of true spans; then, for each labeler, P(yes|true), P(no|true), P(yes|false), P(no|false).
    The whole estimation is one fold over a bounded array, run where the array is."""
    rows = F.collect_list(F.struct("v", "f", F.col("n").cast("double").alias("n")))
    table = counts.agg(rows.alias("t"))
    vote = [f"floor(r.v / {3**i}) % 3" for i in range(len(LABELERS))]
    odds = "ln(m[0] / (1 - m[0]))" + "".join(
        f" + CASE {v} WHEN 1 THEN ln(m[{1 + 4 * i}] / m[{3 + 4 * i}]) WHEN 0 THEN ln(m[{2 + 4 * i}] / m[{4 + 4 * i}]) ELSE 0D END" for i, v in enumerate(vote))
    q = f"transform(t, r -> named_struct('v', r.v, 'f', r.f, 'p', r.n / (1 + exp(-({odds}))), 'n', r.n))"
    total = lambda of, cond="true": f"aggregate(q, 0D, (a, r) -> a + IF({cond}, {of}, 0D))"
    true, false = total("r.p"), total("r.n - r.p")
    parts = [f"({true} + 1) / ({total('r.n')} + 2)"]
    for v in vote:
        parts += [f"({total('r.p', f'{v} = 1')} + 1) / ({true} + 3)", f"({total('r.p', f'{v} = 0')} + 1) / ({true} + 3)",
                  f"({total('r.n - r.p', f'{v} = 1')} + 1) / ({false} + 3)", f"({total('r.n - r.p', f'{v} = 0')} + 1) / ({false} + 3)"]
    # `transform(array(x), y -> ...)[0]` binds a value once
    step = f"transform(array({q}), q -> array({', '.join(parts)}))[0]"
    start = "array(0.7D" + ", 0.7D, 0.1D, 0.15D, 0.5D" * len(LABELERS) + ")"
    table = table.withColumn("m", F.expr(f"aggregate(sequence(1, {rounds}), {start}, (m, i) -> {step})"))
    table = table.withColumn("q", F.expr(q))
    size = len(KINDS) * FEATURES
    weight = f"transform(sequence(0, {size - 1}), k -> ln(({total('r.p', 'r.f = k')} + 0.5) / ({total('r.n - r.p', 'r.f = k')} + 0.5)))"
    return table.select("m", F.expr(weight).alias("w"))


def find_pii(docs: DataFrame, accept: float = 0.9) -> DataFrame:
    """doc_id, base (array of k, s, e) and spans (base and accepted candidates) of every row."""
    found = staged(candidates(docs), "pii")
    counts = found.select(F.explode("c").alias("c")).groupBy("c.v", "c.f").count().withColumnRenamed("count", "n")
    weights = reliabilities(counts).select("w").first()[0]  # one number for each of the 80 feature codes
    table = F.array(*(F.lit(float(x)) for x in weights))
    least = F.log(F.lit(accept / (1 - accept)))
    is_base = lambda x: (x["k"] < 4) & (x["v"] % 3 == 1)
    plain = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
    base = F.transform(F.filter("c", is_base), plain)
    spans = F.transform(F.filter("c", lambda x: is_base(x) | (F.element_at(table, x["f"] + 1) >= least)), plain)
    return found.select("doc_id", base.alias("base"), spans.alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, all spans as text and their number."""
    names = F.array(*(F.lit(k) for k in KINDS))
    line = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
