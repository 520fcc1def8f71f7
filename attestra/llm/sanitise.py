"""Personal data, and terms that disclose it, in DataFrame functions only.

Base spans come from four patterns. A found value is a protected entity. Over the whole corpus co-occurrence in a text
says how much a term reveals of an entity, wherever in the text both stand: with I the information content and PMI
the pointwise mutual information, the share PMI(term; entity) / I(entity) is 1 when the term gives the entity away.
Terms at or above ``GENERALISE`` are generalised in every document that holds the entity, those at or above ``REMOVE``
are removed; a term must have met the entity in at least ``SUPPORT`` different texts.

Positions: a pattern cuts the text into pieces and matches in turn, so running sums of their lengths (in code points)
are the matches' places. Running values are taken in blocks of about the root of the number of matches, and a text is
cut at such places from stretches of ``STRETCH`` code points, so that neither grows with matches times text. Patterns
are possessive where that changes no match, and matches start at the head of a run or where the last match ended, so
long runs cost linear time. Terms are looked for in the text with its base spans blanked out, so that none touches one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, saved

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
KINDS = ("email", "ip", "card", "phone")
SUPPORT, GENERALISE, REMOVE = 3, 0.9, 0.99
#: Letters a term has at least.
TERM_LETTERS = 3
#: Code points of a text that are cut from at once.
STRETCH = 1024
_SPAN = "struct<s:int,e:int,v:string>"
_SPANS = f"array<{_SPAN}>"


def _none() -> Column:
    return F.expr("array()").cast(_SPANS)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body, and lambdas in it, use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(items: Column, zero: Column, kind: str, step) -> Column:
    """array<kind> of what ``step(state, item)`` gives as (next state, value) along the items."""
    none = F.expr("array()").cast(f"array<{kind}>")

    def over_block(acc: Column, block: Column) -> Column:
        def over_item(a: Column, x: Column) -> Column:
            state, value = step(a["state"], x)
            return F.struct(state.alias("state"), F.concat(a["values"], F.array(value)).alias("values"))

        start = F.struct(acc["state"].alias("state"), none.alias("values"))
        return F.aggregate(block, start, over_item, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["blocks"], F.array(a["values"])).alias("blocks")))

    def over_all(xs: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(xs))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, width), lambda i: F.slice(xs, i + 1, width))
        start = F.struct(zero.alias("state"), F.expr("array()").cast(f"array<array<{kind}>>").alias("blocks"))
        return F.when(F.size(xs) > 0, F.flatten(F.aggregate(blocks, start, over_block, lambda a: a["blocks"]))).otherwise(none)

    return _let(items, over_all)


def located(text: Column, pattern: Column) -> Column:
    """array<struct<s, e, v>> of a pattern's matches: start and end in code points, and the match."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    sizes = F.transform(F.split(text, pattern, -1), F.length)
    items = _let(sizes, lambda n: F.transform(found, lambda v, i: F.struct(F.get(n, i).alias("before"), v.alias("v"))))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + x["before"]
        e = s + F.length(x["v"])
        return e, F.struct(s.alias("s"), e.alias("e"), x["v"].alias("v"))

    return _running(items, F.lit(0), _SPAN, step)


def _replaced(text: Column, cuts: Column, by) -> Column:
    """The text with each cut (s, e, ...), in order of s, replaced by ``by(cut, at)``; ``at`` is where the text before the
    cut ended. A cut that starts inside an earlier one only lengthens that."""

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        return F.greatest(at, x["e"]), F.struct(at.alias("lo"), F.greatest(at, x["s"]).alias("hi"), by(x, at).alias("by"))

    def build(stretches: Column) -> Column:
        def piece(lo: Column, hi: Column) -> Column:
            def part(c: Column) -> Column:
                first = F.greatest(lo - c * STRETCH, F.lit(0))
                return F.substring(F.get(stretches, c), first + 1, F.least(hi - c * STRETCH, F.lit(STRETCH)) - first)

            of = lambda x: F.floor(x / STRETCH).cast("int")
            return F.when(lo < hi, F.array_join(F.transform(F.sequence(of(lo), of(hi - 1)), part), "")).otherwise(F.lit(""))

        parts = F.transform(_running(cuts, F.lit(0), "struct<lo:int,hi:int,by:string>", step), lambda o: F.concat(piece(o["lo"], o["hi"]), o["by"]))
        return F.concat(F.array_join(parts, ""), piece(F.array_max(F.transform(cuts, lambda x: x["e"])), F.length(text)))

    return _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), build)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(v)), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2))
    total = F.aggregate(d, F.lit(0), lambda a, x: a + F.coalesce(F.when(x > 9, x - 9).otherwise(x), F.lit(0)))
    return total % 10 == 0


def with_spans(docs: DataFrame) -> DataFrame:
    """docs plus a column of spans for each kind; text is not null. A cheap test goes before each pattern."""
    t = F.col("text")
    maybe = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9][\x20-]?[0-9]"), "phone": t.rlike(r"\+[0-9]")}
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    out = docs.withColumns({k: F.when(maybe[k], located(t, F.lit(pattern[k]))).otherwise(_none()) for k in KINDS})
    size = lambda v: F.length(_digits(v))
    return out.withColumns({
        "ip": F.filter("ip", lambda x: x["v"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
        "card": F.filter(F.filter("card", lambda x: size(x["v"]).between(13, 19)), lambda x: _luhn(x["v"])),
        "phone": F.filter("phone", lambda x: size(x["v"]).between(9, 15)),
    })


def _words(text: Column) -> Column:
    return F.split(F.lower(text), r"[^\p{L}]+")


def _terms(text: Column) -> Column:
    """Different words of a text that may be terms."""
    return F.array_distinct(F.filter(_words(text), lambda w: F.length(w) >= TERM_LETTERS))


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash"), *more)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, a column of spans (s, e, v) for each kind, its entities, and the terms of texts that hold one."""
    rows = with_spans(_texts(docs))

    def named(kind: str) -> Column:
        return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), F.lower(x["v"])))

    entity = F.array_distinct(F.concat(*map(named, KINDS)))
    rows = rows.select("doc_id", "text_hash", "text", *KINDS, entity.alias("entities"))
    return rows.withColumn("terms", F.when(F.size("entities") > 0, _terms(F.col("text")))).drop("text")


def disclosing(docs: DataFrame, base: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """entity, term, share: terms that reveal an entity, from counts over all documents.

    Documents with the term are counted for every word of the corpus before the counts meet the few terms in question,
    so that a frequent term moves one row a task and not one a document.
    """
    holding = base.where(F.size("entities") > 0)
    # one row a text: copies count for the share, different texts for the support
    texts = holding.groupBy("text_hash").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = saved(texts, "texts")
    n_entity = texts.select("n", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts"))
    # an entity in fewer texts has no term with enough of them
    n_entity = saved(n_entity.where(F.col("texts") >= support).select("entity", "n_entity"), "entities")
    held = texts.select("text_hash", "n", "terms", F.explode("entities").alias("entity")).join(checked_broadcast(n_entity.select("entity")), "entity")
    met = held.select("n", "entity", F.explode("terms").alias("term"))
    both = saved(met.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts")).where(F.col("texts") >= support), "terms")
    seen = docs.select(F.explode(F.array_distinct(_words(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("term"))
    n_term = seen.groupBy("term").agg(F.count("*").alias("n_term")).join(both.select("term").distinct(), "term")
    n_all = docs.agg(F.count("*").alias("n_all"))
    rows = both.join(n_term, "term").join(n_entity, "entity").crossJoin(F.broadcast(n_all))  # one row
    information = F.log2(F.col("n_all") / F.col("n_entity"))
    pmi = F.log2(F.col("n_all") * F.col("n_both") / (F.col("n_term") * F.col("n_entity")))
    rows = rows.where(information > 0).select("entity", "term", (pmi / information).alias("share"))
    return saved(rows.where(F.col("share") >= threshold), "disclosing")


def term_spans(docs: DataFrame, base: DataFrame, reveal: DataFrame) -> DataFrame:
    """doc_id, text_hash, term: spans (s, e, removed) of disclosing terms in documents that hold the entity."""
    row = ["doc_id", "text_hash"]
    holding = base.where(F.size("entities") > 0)
    terms = holding.select(*row, F.explode("entities").alias("entity")).distinct().join(reveal, "entity")
    terms = saved(terms.groupBy(*row, "term").agg((F.max("share") >= REMOVE).alias("removed")), "doc-terms")
    spans = F.array_sort(F.transform(F.concat(*KINDS), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    spans = holding.join(terms.select(*row).distinct(), row, "left_semi").select(*row, spans.alias("spans")).dropDuplicates(row)
    texts = _texts(docs).join(saved(spans, "doc-spans"), row).dropDuplicates(row)
    blank = lambda x, at: F.repeat(F.lit("0"), F.greatest(x["e"] - F.greatest(at, x["s"]), F.lit(0)))
    words = texts.select(*row, F.explode(located(_replaced(F.col("text"), F.col("spans"), blank), F.lit(r"\p{L}+"))).alias("w"))
    found = words.withColumn("term", F.lower("w.v")).join(terms, [*row, "term"])
    return found.groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("w.s", "w.e", "removed"))).alias("term"))


def find(docs: DataFrame, support: int = SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """Per row: doc_id, text_hash, spans of each kind, and term (spans that touch no base span).

    Null texts are empty. Repeated rows are found row by row and count as copies in the statistics; rows without an id keep
    their base spans and get no term spans. An empty table gives an empty result; other columns are ignored.
    """
    base = saved(base_spans(docs), "base")
    reveal = disclosing(docs, base, support, threshold)
    out = base.drop("entities", "terms")
    empty = F.expr("array()").cast("array<struct<s:int,e:int,removed:boolean>>")
    if reveal.isEmpty():
        return out.withColumn("term", empty)
    out = out.join(saved(term_spans(docs, base, reveal), "term-spans"), ["doc_id", "text_hash"], "left")
    return out.select("doc_id", "text_hash", *KINDS, F.coalesce("term", empty).alias("term"))


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term."""
    rows = find(docs)
    line = lambda k: F.transform(k, lambda x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string")))
    base = F.concat(*[line(k) for k in KINDS])
    n = [F.size(k).cast("long").alias(f"n_{k}") for k in (*KINDS, "term")]
    return rows.select("doc_id", *n[:4], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(F.concat(base, line("term")), ",").alias("spans"), n[4])


def _fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name in columns:
        name += "_"
    return name


def sanitise(docs: DataFrame, length: str = "n_chars") -> DataFrame:
    """docs with every base span replaced by its kind in brackets, terms generalised to [term] or removed.

    A column named ``length`` follows the new text; texts without a span, and all other columns, are as they were.
    """
    found = find(docs)
    by, id_, hash_ = (_fresh(docs.columns, c) for c in ("_cuts", "_id", "_hash"))

    def marks(kind: str, put) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), put(x).alias("by")))

    placeholder = lambda kind: lambda x: F.lit(f"[{kind}]")
    cuts = F.concat(*[marks(k, placeholder(k)) for k in KINDS], marks("term", lambda x: F.when(x["removed"], F.lit("")).otherwise(F.lit("[term]"))))
    found = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.array_sort(cuts).alias(by)).where(F.size(by) > 0).dropDuplicates([id_, hash_])
    found = saved(found, "cuts")
    t = F.col("text").cast("string")
    clean = _replaced(t, F.col(by), lambda x, at: F.when(x["s"] >= at, x["by"]).otherwise(F.lit("")))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(F.coalesce(t, F.lit(""))) == F.col(hash_))
    out = docs.join(found, same, "left")  # broadcast by Spark if its file is small
    out = out.withColumn("text", F.when(F.col(by).isNotNull(), clean).otherwise(F.col("text")))
    if length in docs.columns:
        of_kind = docs.schema[length].dataType
        out = out.withColumn(length, F.when(F.col(by).isNotNull(), F.length("text").cast(of_kind)).otherwise(F.col(length)))
    return out.select(*docs.columns)
