"""Personal data: pattern spans, and terms that the corpus shows to reveal them.

Base spans are the leftmost non-overlapping matches of four patterns. Each stands for three *protected
entities*: its value (e-mail addresses without case, numbers by their digits), its group (the domain,
the first two numbers of an address, the first six digits of a card, a phone number without its last
seven digits) and its kind. A *term* is a word of three letters or more, or a shorter one with a
capital, anywhere in a document with it. Over the corpus, IC(e) = -log2 p(e) is what an entity is
worth and PMI(e, t) = log2 p(e, t) / (p(e) p(t)) is what a term tells of it, with p over rows and, as
few texts may meet by chance, log2((k + 2) / (k + 1)) taken off where k documents hold both. A term
whose PMI is at least ``SHARE`` of IC discloses the entity, if k is ``SUPPORT`` or more
(``CLASS_SUPPORT`` for groups and kinds, which chance meets more often): all its occurrences in the
documents that hold the entity become spans of kind ``term``, but for those inside base spans.
``sanitise`` replaces spans by their kind, which generalises values and removes terms.

Everything is DataFrame operations. The patterns are written with possessive quantifiers and
anchored at the start of a run of their first class (or where the last match ended), which finds
the same matches in linear time. A text's spans are walked in blocks of ``BLOCK``, so that no array
or string of all of them grows span by span.

Defined cases: a null text is the empty text and has no spans; rows with a null doc_id stay and
take part; repeated rows give repeated results, and as every row counts in p and rows that repeat
a doc_id and text are one document in k, a table with all rows twice has the same spans; an empty table gives an empty
result; columns other than doc_id and text are not read (``sanitise`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceflow.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SUPPORT, CLASS_SUPPORT, SHARE, BLOCK = 2, 5, 0.9, 64
_WORD = r"(?<!\p{L})(?:\p{L}{3,}+|\p{Lu}\p{L}?+)(?!\p{L})"
SPAN = "array<struct<s:long,k:int,e:long,v:string>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, also where lambdas use it."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array that is not empty, in arrays of ``BLOCK``; ``items`` is a variable."""
    last = F.floor((F.size(items) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _before(values: Column, join) -> Column:
    """For each value what ``join`` makes of 0 and those before it."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, start, step, lambda acc: acc["out"])


def found(text: Column, pattern: str, kind: int) -> Column:
    """All matches as structs (s, k, e, v) in code points; the pieces between them give their places."""
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["a"]
        one = F.struct(s.alias("s"), F.lit(kind).alias("k"), (s + x["b"]).alias("e"), x["v"].alias("v"))
        return F.struct((s + x["b"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def inside(block: Column, at: Column) -> Column:
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda acc, x: acc + x["a"] + x["b"]))
        return F.flatten(F.zip_with(blocks, _before(sums, lambda x, y: x + y), inside))

    def of(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        sized = F.zip_with(gaps, hits, lambda a, b: F.struct(F.length(a).cast("long").alias("a"), F.length(b).cast("long").alias("b"), b.alias("v")))
        return F.when(F.size(hits) > 0, _let(sized, lambda items: _let(_blocks(items), placed))).otherwise(none)

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _octets(v: Column) -> Column:
    part = lambda x: F.ltrim(x, F.lit("0"))
    value = lambda x: F.when(F.length(x) == 0, F.lit(0)).when(F.length(x) <= 3, x.cast("int")).otherwise(F.lit(256))
    return F.forall(F.split(v, r"\."), lambda x: value(part(x)) <= 255)


def _luhn(v: Column) -> Column:
    digits = F.reverse(F.translate(v, " -", ""))
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    terms = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.when(i % 2 == 0, twice(value(i))).otherwise(value(i)))
    total = F.aggregate(terms, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _phone(v: Column) -> Column:
    return F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)


_VALID = {"ip": _octets, "card": _luhn, "phone": _phone}


def base_spans(text: Column) -> Column:
    """Base spans of all kinds, sorted by start, then kind."""
    each = []
    for k, kind in enumerate(KINDS):
        got = found(text, PATTERNS[kind], k)
        if kind in _VALID:
            valid = _VALID[kind]
            got = F.filter(got, lambda x: valid(x["v"]))  # noqa: B023
        none = F.array().cast(SPAN)
        each.append(F.when(F.contains(text, F.lit(need)), got).otherwise(none) if (need := _NEEDS[kind]) else F.when(F.rlike(text, F.lit("[0-9](?:[\\x20-]?[0-9]){11}")), got).otherwise(none))
    return F.array_sort(F.concat(*each))


def entities(span: Column) -> Column:
    """The protected entities of a span: its value, group and kind, each after the digit of its level."""
    low, digits = F.lower(span["v"]), F.regexp_replace(span["v"], "[^0-9]", "")
    pick = lambda *of: F.when(span["k"] == 0, of[0]).when(span["k"] == 1, of[1]).when(span["k"] == 2, of[2]).otherwise(of[3])
    kind = pick(*(F.lit(k) for k in KINDS))
    value = pick(low, span["v"], digits, digits)
    phone = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 7, F.lit(0)))
    group = pick(F.substring_index(low, "@", -1), F.substring_index(span["v"], ".", 2), F.substring(digits, 1, 6), phone)
    return F.array(F.concat(F.lit("0"), kind, F.lit(":"), value), F.concat(F.lit("1"), kind, F.lit(":"), group), F.concat(F.lit("2"), kind))


def terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.lower))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), base spans and, where there are any, the text, one row per row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "text", base_spans(F.col("text")).alias("base"))
    return rows.select("doc_id", "th", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))


def disclosing(docs: DataFrame, scanned: DataFrame, support: int = SUPPORT, class_support: int = CLASS_SUPPORT, share: float = SHARE) -> DataFrame:
    """doc_id, th, term: the terms to hide in each document of ``scanned``."""
    held = scanned.where(F.size("base") > 0).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("rows"), F.first("base").alias("base"), F.first("text").alias("text"))
    held = table(held, "held")
    mine = held.select("doc_id", "th", "rows", F.explode(F.array_distinct(F.flatten(F.transform("base", entities)))).alias("entity"))
    least = F.when(F.col("entity").startswith("0"), F.lit(support)).otherwise(F.lit(class_support))
    each = mine.groupBy("entity").agg(F.sum("rows").alias("n_entity"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least)
    each = table(each.drop("texts"), "entities")  # joined from a table, a frequent entity's rows can be split
    words = docs.select(F.explode(terms(F.coalesce(docs["text"].cast("string"), F.lit("")))).alias("term"))
    counts = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where(F.col("n_term") >= support)
    total = F.lit(docs.select("doc_id").count())
    worth = F.log2(total / F.col("n_entity"))
    told = lambda both: F.log2(both * total / (F.col("n_entity") * F.col("n_term")))
    # With both = n_entity, the most there can be, common words fall out before pairs are counted.
    most = each.agg(F.max(F.pow("n_entity", F.lit(share)) * F.pow(total, F.lit(1 - share)))).first()[0]
    counts = counts.where(F.col("n_term") <= F.lit((most or 0.0) * 1.001))
    there = held.select("doc_id", "th", F.explode(terms(F.col("text"))).alias("term")).join(counts, "term")
    there = table(there.select(F.col("doc_id").alias("t_id"), F.col("th").alias("t_th"), "term", "n_term"), "there")
    held_by = mine.join(each, "entity")
    pairs = held_by.join(there, held_by["doc_id"].eqNullSafe(there["t_id"]) & (held_by["th"] == there["t_th"])).drop("t_id", "t_th")
    pairs = pairs.where((worth > 0) & (told(F.least("n_entity", "n_term")) >= F.lit(share) * worth))
    good = pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.sum("rows").alias("n_both"), F.count(F.lit(1)).alias("texts"))
    good = good.where((F.col("texts") >= least) & (told(F.col("n_both") * (F.col("texts") + 1) / (F.col("texts") + 2)) >= F.lit(share) * worth)).select("entity", "term")
    return pairs.join(table(good, "good"), ["entity", "term"], "left_semi").select("doc_id", "th", "term").distinct()


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    text = lambda x: F.concat(F.element_at(names, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, text), ",")


def all_spans(docs: DataFrame, support: int = SUPPORT, class_support: int = CLASS_SUPPORT, share: float = SHARE) -> DataFrame:
    """doc_id, th, base and spans (base and terms), one row per row of ``docs``."""
    scanned = table(scan(docs), "scanned")
    hide = disclosing(docs, scanned, support, class_support, share).groupBy("doc_id", "th").agg(F.collect_set("term").alias("hide"))
    hide = hide.select(F.col("doc_id").alias("t_id"), F.col("th").alias("t_th"), "hide")
    on = scanned["doc_id"].eqNullSafe(hide["t_id"]) & (scanned["th"] == hide["t_th"])
    words = F.filter(found(F.col("text"), _WORD, len(KINDS)), lambda w: F.array_contains("hide", F.lower(w["v"])) & ~F.exists("base", lambda y: (y["s"] < w["e"]) & (y["e"] > w["s"])))
    out = scanned.join(hide, on, "left").withColumn("terms", F.when(F.col("hide").isNotNull(), words))
    return out.select("doc_id", "th", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", F.coalesce("terms", F.array().cast(SPAN))))).alias("spans"))


def detect(docs: DataFrame, support: int = SUPPORT, class_support: int = CLASS_SUPPORT, share: float = SHARE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans."""
    rows = all_spans(docs, support, class_support, share)
    count = lambda k: F.size(F.filter("spans", lambda x: x["k"] == k)).cast("long")
    return rows.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate((*KINDS, "term"))),
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <KIND>; overlapping spans become the first one's kind."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in (*KINDS, "term")))
    whole = lambda t, at, n: F.substring(t, (at + 1).cast("int"), n.cast("int"))
    ends = lambda block: F.array_max(F.transform(block, lambda x: x["e"]))

    def inside(block: Column, from_: Column) -> Column:
        def of(piece: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                between = whole(piece, acc["at"] - from_, x["s"] - acc["at"])
                kept = F.concat(acc["out"], between, F.element_at(names, x["k"] + 1))
                return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], kept).otherwise(acc["out"]).alias("out"))

            return F.aggregate(block, F.struct(from_.alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

        return _let(whole(text, from_, F.greatest(from_, ends(block)) - from_), of)

    def joined(blocks: Column) -> Column:
        starts = _before(F.transform(blocks, ends), F.greatest)
        return F.concat(F.array_join(F.zip_with(blocks, starts, inside), ""), whole(text, F.array_max(F.transform(blocks, ends)), F.length(text)))

    return _let(spans, lambda items: _let(_blocks(items), joined))


def sanitise(docs: DataFrame, support: int = SUPPORT, class_support: int = CLASS_SUPPORT, share: float = SHARE) -> DataFrame:
    """``docs`` with its columns, spans in text replaced; a null text stays null, rows without spans stay as they are."""
    rows = all_spans(docs, support, class_support, share).where(F.size("spans") > 0).select(F.col("doc_id").alias("_s_id"), F.col("th").alias("_s_th"), F.col("spans").alias("_s_spans")).dropDuplicates(["_s_id", "_s_th"])
    on = docs["doc_id"].cast("long").eqNullSafe(rows["_s_id"]) & (F.xxhash64(docs["text"].cast("string")) == rows["_s_th"])
    text = F.when(F.col("_s_spans").isNull(), docs["text"]).otherwise(redacted(docs["text"], F.col("_s_spans")))
    return docs.join(rows, on, "left").select(*(text.alias("text") if c == "text" else docs[c] for c in docs.columns))
