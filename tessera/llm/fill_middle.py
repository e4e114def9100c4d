"""Fill-in-the-middle transformation with relational units, in DataFrame functions only.

A text is cut into lines, each with its break. Two cuts, drawn from a hash of doc_id, part it into
prefix, middle and suffix, which are written in the order prefix, suffix, middle (psm) or suffix,
prefix, middle (spm) with a mark before each part.

The lengths of a text's lines are one array a row; equal arrays of repeated rows are dropped
(before the shuffle, too), the others dealt by the row's name: doc_id and a hash of its text.
(A null id and an empty one have the same draw, so they may share a name.) There, posexplode makes a row of every unit, a window sums lengths up to each, cut requests are
joined by the ordinal of the unit they follow, and offsets are gathered for each name. Nothing of that
moves texts. Offsets meet the texts in one join by name, and substring makes the parts.

Defined results: a null text is empty; a null doc_id is hashed as an empty text; empty texts and
those that hold a mark stay as they are (form `plain`, no offsets); rows that repeat id and text
have equal results, one for each; an id may have any type; other columns are kept by fill_in_middle,
with names of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNITS = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NAME = ["__id", "__hash"]


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from a seed and an id (a string)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def named(docs: DataFrame) -> DataFrame:
    """__text without nulls and the name of each row, beside the columns of docs (numbered, as names may clash)."""
    columns = [F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)]
    at = {c: f"__c{docs.columns.index(c)}" for c in ("doc_id", "text")}
    out = docs.select(*columns).withColumn("__text", F.coalesce(F.col(at["text"]), F.lit("")))
    return out.withColumns({"__id": F.coalesce(F.col(at["doc_id"]).cast("string"), F.lit("")), "__hash": F.xxhash64("__text")})


def same_name(a: str, b: str) -> Column:
    return (F.col(f"{a}.__id") == F.col(f"{b}.__id")) & (F.col(f"{a}.__hash") == F.col(f"{b}.__hash"))


def cut_offsets(docs: DataFrame, seed: int = 7) -> DataFrame:
    """Name, n (units), p and m (code points before the first and the second cut) of each different row."""
    lengths = F.transform(F.regexp_extract_all("__text", F.lit(UNITS), F.lit(0)), F.length)
    each = named(docs).select(*NAME, lengths.alias("lengths")).groupBy(*NAME).agg(F.first("lengths").alias("lengths"))
    h = drawn(F.col("__id"), seed)
    n = F.size("lengths")
    first, second = (h[i] % (n + 1) for i in (0, 1))
    each = each.withColumns({"n": n.cast("long"), "a": F.least(first, second), "b": F.greatest(first, second)})
    units = each.where("b > 0").select(*NAME, F.posexplode(F.expr("slice(lengths, 1, cast(b as int))")).alias("at", "length"))
    running = Window.partitionBy(*NAME).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    ends = units.select(*NAME, (F.col("at") + 1).cast("long").alias("ordinal"), F.sum("length").over(running).alias("end"))
    requests = each.select(*NAME, "n", "a", "b").alias("r")
    met = requests.join(ends.alias("e").hint("merge"), same_name("r", "e") & F.col("ordinal").isin(F.col("a"), F.col("b")), "left")
    after = lambda cut: F.coalesce(F.max(F.when(F.col("ordinal") == F.col(cut), F.col("end"))), F.lit(0))
    return met.groupBy("r.__id", "r.__hash").agg(F.max("n").alias("n"), after("a").alias("p"), after("b").alias("m"))


def restored(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone."""
    body = F.substring(output, len(PREFIX) + 1, 1 << 30)

    def parts(inner: str) -> tuple[Column, Column, Column]:
        head = F.substring_index(body, inner, 1)
        rest = body.substr(F.length(head) + len(inner) + 1, F.length(body))
        tail = F.substring_index(rest, MIDDLE, 1)
        return head, tail, rest.substr(F.length(tail) + len(MIDDLE) + 1, F.length(rest))

    p, s, m = parts(SUFFIX)
    s2, p2, m2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(p, m, s)).when(form == "spm", F.concat(p2, m2, s2)).otherwise(output)


def _made(docs: DataFrame, seed: int, rate: int, spm: int) -> DataFrame:
    rows = named(docs).alias("d")
    cuts = cut_offsets(docs, seed).alias("c")
    out = rows.join(cuts.hint("merge"), same_name("d", "c"), "left").drop(F.col("c.__id"), F.col("c.__hash"))
    text, h = F.col("__text"), drawn(F.col("__id"), seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((F.length(text) == 0) | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    out = out.withColumn("__form", form)
    prefix, middle = text.substr(F.lit(1), F.col("p").cast("int")), text.substr((F.col("p") + 1).cast("int"), (F.col("m") - F.col("p")).cast("int"))
    suffix = text.substr((F.col("m") + 1).cast("int"), F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    turned = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("__form") == "psm", psm).when(F.col("__form") == "spm", turned).otherwise(text)
    plain = F.col("__form") == "plain"
    sizes = {"__p": F.when(~plain, F.col("p")), "__m": F.when(~plain, F.col("m") - F.col("p"))}
    return out.withColumns({"__out": output, **sizes})


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """docs with fim_form, fim_units, fim_prefix_chars, fim_middle_chars and fim_text.

    `rate` per cent of the texts that can be cut are, `spm` per cent of them in suffix-first order."""
    out = _made(docs, seed, rate, spm)
    own = [F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)]
    made = {"fim_form": "__form", "fim_units": "n", "fim_prefix_chars": "__p", "fim_middle_chars": "__m", "fim_text": "__out"}
    return out.select(*own, *(F.col(v).alias(k) for k, v in made.items()))


def digest(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(docs.select("doc_id", "text"), seed, rate, spm)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("fim_text"), F.col("fim_form"))
    return made.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"),
        F.col("fim_middle_chars").alias("middle_chars"), sha(F.col("fim_text")).alias("output_sha256"), sha(back).alias("restored_sha256"),
    )
