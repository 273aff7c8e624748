"""Personal data: patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers.  Each
found value is a protected entity.  The corpus says how strongly a term reveals
one: pointwise mutual information of a term and an entity over whole texts, as a
share of the entity's own information content.  In every text with an entity the
terms that reach its disclosure threshold are spans too, wherever they stand;
they are generalised or removed.  DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, key_join, small, text_of

REACH = 60  # characters each side of a mention that tell its surroundings from others
DISCLOSURE = 0.9  # share of an entity's information content from which on a term discloses it
SUPPORT = 2  # different surroundings of the entity in the texts that have both
LETTERS = 2  # letters of a term at least
TERM = rf"\p{{L}}{{{LETTERS},}}"
KINDS = ("email", "ip", "card", "phone")
# Fixed patterns.  Possessive repeats and the look-behind keep the same leftmost
# matches as the plain forms and stay linear on long runs: a match starts where
# its first run of characters does, or where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text without a match can't have; spares most texts the pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9]"}
SPAN = "array<struct<start:bigint,stop:bigint,value:string>>"


def spans_of(text: Column, pattern: str | Column) -> Column:
    """Matches with code point offsets: what lies between them, cut at the matches, gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc, pair):
        begin = acc["at"] + pair["gap"]
        stop = begin + F.char_length(pair["value"])
        return F.struct(stop.alias("at"), F.array_append(acc["spans"], F.struct(begin.alias("start"), stop.alias("stop"), pair["value"].alias("value"))).alias("spans"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step)["spans"]).otherwise(F.array().cast(SPAN))


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (part(p).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _checks(kind: str):
    return lambda s: valid(kind, s["value"])


def base_spans(text: Column) -> dict[str, Column]:
    """Per kind the array of valid (start, stop, value); matches that fail are dropped without retry."""
    out = {}
    for kind in KINDS:
        hint = F.contains(text, F.lit(HINTS[kind])) if kind == "email" else text.rlike(HINTS[kind])
        spans = F.when(hint, spans_of(text, PATTERNS[kind])).otherwise(F.array().cast(SPAN))
        out[kind] = F.filter(spans, _checks(kind))
    return out


def found(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, email, ip, card, phone, mentions, terms) of every row, numbered and written once.

    Only rows with a mention have ``mentions`` (kind, value, surroundings), where
    surroundings is a hash of the text within REACH characters, and ``terms``, the
    different terms of the whole text.
    """
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    rows = rows.select("*", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])

    def mention(kind):
        def of(s):
            low = F.greatest(s["start"] - REACH, F.lit(0))
            piece = F.substr("text", (low + 1).cast("int"), (s["stop"] - low + REACH).cast("int"))
            return F.struct(F.lit(kind).alias("kind"), s["value"].alias("value"), F.xxhash64(piece).alias("surroundings"))

        return F.transform(kind, of)

    any_found = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])
    mentions = F.when(any_found, F.array_distinct(F.concat(*[mention(k) for k in KINDS])))
    terms = F.when(any_found, terms_of(F.col("text")))
    plain = lambda k: F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", *[plain(k).alias(k) for k in KINDS], mentions.alias("mentions"), terms.alias("terms")))


def terms_of(text: Column) -> Column:
    """The different terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\P{L}+"), lambda w: F.char_length(w) >= LETTERS))


def candidate_terms(docs: DataFrame, base: DataFrame, total: int, disclosure: float) -> DataFrame:
    """(term, spread): terms of two texts or more with a mention that can reach the threshold; spread counts all texts.

    disclosure = 1 + log2(both / spread) / log2(N / entity), and ``both`` is at most
    the number of texts with a mention that have the term: what stands in too many
    other texts is left out before it meets any entity.
    """
    held = base.filter("terms is not null").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("held")).filter("held >= 2")
    held = cut(held)
    spread = docs.select(F.explode(terms_of(text_of())).alias("term")).groupBy("term").agg(F.count("*").alias("spread"))
    reach = float(max(total, 1)) ** (1 - disclosure)
    return cut(spread.join(small(held), "term").filter(F.col("spread") <= F.col("held") * (reach + 1e-9)).select("term", "spread"))


def disclosing(docs: DataFrame, base: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(kind, value, term, disclosure): terms that give an entity away.

    With N texts, PMI = log2(N * both / (spread * entity)) over the numbers of texts
    that have them, and disclosure = PMI / log2(N / entity).  Support counts
    different surroundings of the entity, so copies of a text count once; a term
    that also stands in many other texts has low PMI.
    """
    total = base.count()
    asked = base.filter("mentions is not null").select("row", "mentions", "terms")
    each = asked.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    # Texts are counted once however often they mention an entity; counts are summed before the shuffle.
    entities = cut(each.select("row", "kind", "value").distinct().groupBy("kind", "value").agg(F.count("*").alias("entity")))
    wanted = candidate_terms(docs, base, total, disclosure)
    told = cut(asked.select("row", F.explode("terms").alias("term")).join(small(wanted.select("term")), "term"))
    pairs = each.join(told, "row").groupBy("kind", "value", "term").agg(
        F.count_distinct("surroundings").alias("surroundings"), F.count_distinct("row").alias("both")
    ).filter(F.col("surroundings") >= support)
    rows = cut(pairs).join(small(wanted), "term").join(small(entities), ["kind", "value"])
    n = F.greatest(F.lit(float(total)), F.col("spread"), F.col("entity"))
    pmi = F.log2(n * F.col("both") / (F.col("spread") * F.col("entity")))
    content = F.log2(n / F.col("entity"))
    rows = rows.withColumn("disclosure", F.when(content > 0, pmi / content).otherwise(0.0))
    return cut(rows.filter(F.col("disclosure") >= disclosure).select("kind", "value", "term", "disclosure"))


def personal_data(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text_hash, email, ip, card, phone, term): arrays of (start, stop) in code points, one row per input row.

    ``term`` has every place of the words that disclose an entity of the text,
    outside the mentions themselves.  Null and empty texts have none; rows that
    repeat an id are judged each by its own text.
    """
    docs = docs.select("doc_id", "text")
    base = found(docs)
    risky = disclosing(docs, base, disclosure, support)
    here = base.filter("mentions is not null").select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.kind", "m.value")
    words = here.join(small(risky.drop("disclosure")), ["kind", "value"]).groupBy("doc_id", "text_hash").agg(F.collect_set("term").alias("words"))  # a text's own
    words = cut(words)
    texts = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    held = key_join(texts, small(words, cells=F.size("words")), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("words", "|"), F.lit(r")(?!\p{L})"))  # terms are letters only
    spots = held.withColumn("pattern", pattern).select("doc_id", "text_hash", spans_of(F.col("text"), F.col("pattern")).alias("spots")).filter(F.size("spots") > 0)
    spots = spots.withColumn("spots", F.transform("spots", lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
    out = key_join(base.drop("row", "mentions", "terms"), cut(spots), ["doc_id", "text_hash"], "left")
    apart = lambda t: reduce(lambda a, b: a & b, [F.forall(k, lambda s: (t["stop"] <= s["start"]) | (t["start"] >= s["stop"])) for k in KINDS])
    return out.withColumn("term", F.coalesce(F.filter("spots", apart), F.array().cast("array<struct<start:bigint,stop:bigint>>"))).drop("spots")


def listed(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed, then start."""
    def named(kind):
        return lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["stop"].cast("string"))

    each = [F.transform(k, named(k)) for k in kinds]
    return F.array_join(F.concat(*each), ",")


def sanitise(docs: DataFrame, generalise: bool = True, disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; all rows and columns stay.

    Each span becomes its kind in brackets (``[EMAIL]``, ``[TERM]``), or goes if
    ``generalise`` is false.  Overlapping spans are replaced as one, under the
    kind that starts first.  Null texts stay null.
    """
    kinds = (*KINDS, "term")
    spans = personal_data(docs, disclosure, support)

    def kept(kind):
        return lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), F.lit(kind).alias("kind"))

    marks = F.sort_array(F.concat(*[F.transform(k, kept(k)) for k in kinds]))
    found_in = spans.select("doc_id", "text_hash", marks.alias("_marks")).filter(F.size("_marks") > 0).dropDuplicates(["doc_id", "text_hash"])
    rows = docs.withColumn("_hash", F.xxhash64(text_of())).withColumn("_id", F.col("doc_id"))
    joined = key_join(rows, small(cut(found_in), cells=F.size("_marks") * 3).toDF("_id", "_hash", "_marks"), ["_id", "_hash"], "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        begin = F.greatest(acc["at"], s["start"])
        piece = F.substr("text", (acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        fresh = s["start"] >= acc["at"]
        mark = F.when(fresh, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("") if generalise else F.lit("")
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], F.when(fresh, piece).otherwise(""), mark).alias("out"))

    done = F.aggregate("_marks", start, step)
    clean = F.concat(done["out"], F.substr("text", (done["at"] + 1).cast("int"), F.char_length("text")))
    return joined.withColumn("text", F.when(F.col("_marks").isNull(), F.col("text")).otherwise(clean)).drop("_hash", "_id", "_marks")
