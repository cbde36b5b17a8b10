"""PII: information-theoretic sanitisation (DataFrame functions only).

Protected entities are the personal data that fixed patterns find, and the domains of mail
addresses. Words near a mention of an entity may give it away as well. Over the whole corpus,
counted are the different contexts in which a term stands near an entity, and the documents
that hold the term: their ratio estimates how likely the term discloses the entity, and with
the entity's own contexts the pointwise mutual information in bits, which is discounted
where counts are small. Terms that exceed both thresholds are generalised wherever they stand
in any document, those that almost always mean the entity are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import apart, cut, row_key, text_of

#: Fixed patterns of personal data, in the order of reports. Possessive loops, look-behinds
#: and \G (the end of the last match) only spare the search; they match what the plain
#: patterns match. A card's or phone's length is part of its pattern.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9](?:[ ().-]*+[0-9]){7,14}+(?![ ().-]*+[0-9])",
}
#: What a text must hold to be searched for a kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
KINDS = (*PATTERNS, "term")
TERM = r"(?<=[^\p{L}])\p{L}{4,}+(?=[^\p{L}])"
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"


def _found(text: Column, pattern: str | Column, kind: str) -> Column:
    """Leftmost matches as SPANS, in code points: the pieces between matches give their places."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(values.alias("v"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)).alias("p"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["p"])
        b = a + F.length(x["v"])
        one = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["v"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _checks(kind: str):
    """Whether a match of the kind's pattern counts."""
    part = lambda p: F.ltrim(p, F.lit("0"))
    if kind == "ip":
        return lambda x: F.forall(F.split(x["value"], r"\."), lambda p: (F.length(part(p)) <= 2) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return lambda x: F.call_function("luhn_check", F.regexp_replace(x["value"], "[^0-9]", ""))
    return lambda x: F.lit(True)


def personal(text: Column) -> Column:
    """Spans of all kinds in PATTERNS, by kind, then place."""
    parts = []
    for kind, pattern in PATTERNS.items():
        hinted = F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(HINTS[kind]))
        parts.append(F.when(hinted, F.filter(_found(text, pattern, kind), _checks(kind))).otherwise(F.array().cast(SPANS)))
    return F.concat(*parts)


def _entities(s: Column) -> Column:
    """What a mention stands for: its value, and a mail address's domain."""
    value = F.lower(s["value"])
    domain = F.when(s["kind"] == "email", F.array(F.concat(F.lit("domain:"), F.substring_index(value, "@", -1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.concat_ws(":", s["kind"], value)), domain)


def keyed_spans(docs: DataFrame, radius: int) -> DataFrame:
    """(doc_id, row, spans, contexts): spans of each row, and ``radius`` characters around each mention."""
    text = text_of()
    rows = docs.select("doc_id", row_key().alias("row"), text.alias("text"))
    # one blank at either end, so words at the edge of a text are whole
    padded = F.concat(F.lit(" "), F.col("text"), F.lit(" "))
    begin = lambda s: F.greatest(s["start"] + 1 - radius, F.lit(0))
    around = F.transform("spans", lambda s: F.struct(
        _entities(s).alias("entities"),
        begin(s).alias("left_at"), F.substring(padded, begin(s) + 1, s["start"] + 2 - begin(s)).alias("left"),
        s["end"].alias("right_at"), F.substring(padded, s["end"] + 1, F.lit(radius)).alias("right")))
    return rows.withColumn("spans", personal(F.col("text"))).select("doc_id", "row", "spans", around.alias("contexts"))


def near_terms(spans: DataFrame) -> DataFrame:
    """(entity, term, context): words of 4 or more letters near each mention, each once per context."""
    c = spans.where(F.size("contexts") > 0).select(F.explode("contexts").alias("c")).select("c.*")
    side = lambda s: F.transform(_found(F.col(s), TERM, "term"), lambda x: F.lower(x["value"]))
    terms = F.array_distinct(F.concat(side("left"), side("right")))
    c = cut(c.select("entities", F.xxhash64("left", "right").alias("context"), terms.alias("terms")))
    c = c.select(F.explode("entities").alias("entity"), "context", "terms")
    return c.select("entity", "context", F.explode("terms").alias("term")).distinct()


def forms() -> Column:
    """The different words of 4 or more letters of a text, as they are spelled."""
    return F.array_distinct(F.regexp_extract_all(text_of(), F.lit(r"\p{L}{4,}+"), F.lit(0)))


def disclosing(docs: DataFrame, near: DataFrame, least_share: float, least_bits: float) -> DataFrame:
    """(term, share) of terms that disclose an entity, from counts over all documents; the greatest share of any entity.

    The bits are discounted by c/(c+1) for the count of the pair and for the smaller of
    the term's and the entity's counts (Pantel and Lin).
    """
    contexts = near.select("entity", "context").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("of_entity"))
    both = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both"))
    words = F.array_distinct(F.transform(forms(), F.lower))
    held = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("of_term"))
    share = F.col("both") / F.greatest("of_term", "both")
    likely = cut(both.join(held, "term").withColumn("share", share).where(F.col("share") >= least_share))
    every = docs.agg(F.count(F.lit(1)).alias("n"))
    rated = likely.join(contexts, "entity").join(F.broadcast(every))  # one row
    least = F.least(F.greatest("of_term", "both"), "of_entity")
    discount = F.col("both") / (F.col("both") + 1) * least / (least + 1)
    bits = F.log2(F.col("share") * F.col("n") / F.col("of_entity")) * discount
    return rated.where(bits >= least_bits).groupBy("term").agg(F.max("share").alias("share"))


def marked_terms(docs: DataFrame, told: DataFrame, remove_share: float) -> DataFrame:
    """(row, terms) of the rows that hold a term of ``told``, wherever it stands."""
    rows = docs.select(row_key().alias("row"), F.explode(forms()).alias("form")).withColumn("term", F.lower("form"))
    held = rows.join(told, "term").groupBy("row").agg(F.collect_set(F.struct("form", (F.col("share") >= remove_share).alias("remove"))).alias("held"))
    texts = docs.select(row_key().alias("_row"), text_of().alias("text")).join(cut(held), F.col("_row") == F.col("row"))
    # letters only, so nothing in a form is a pattern's sign
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join("held.form", "|"), F.lit(r")(?!\p{L})"))
    removed = F.transform(F.filter("held", lambda h: h["remove"]), lambda h: h["form"])
    found = _found(F.col("text"), F.col("pattern"), "term")
    terms = F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.array_contains(removed, x["value"]).alias("remove")))
    return texts.withColumn("pattern", pattern).select("row", terms.alias("terms")).groupBy("row").agg(F.any_value("terms").alias("terms"))


def disclosure_spans(docs: DataFrame, radius: int = 48, least_share: float = 0.5,
                     least_bits: float = 3.0, remove_share: float = 0.9) -> DataFrame:
    """(doc_id, row, personal, terms) of every row of ``docs`` (doc_id, text).

    ``personal``: array of (kind, start, end, value), code points, end exclusive, by kind
    and place. ``terms``: array of (start, end, remove) by place, without those inside a
    personal span. A term within ``radius`` characters of a mention counts if the different
    contexts that hold it with the entity are ``least_share`` of the documents that hold it
    and tell ``least_bits`` bits after the discount for small counts; it is then marked in
    all documents. Beyond ``remove_share`` it is to be removed, else generalised. Copies of
    a passage are one context. A null text is empty; repeated rows get equal spans each; an
    empty table gives an empty result; other columns are ignored.
    """
    spans = cut(keyed_spans(docs, radius))
    told = cut(disclosing(docs, near_terms(spans), least_share, least_bits))
    marked = marked_terms(docs, told, remove_share).withColumnRenamed("row", "_row")
    out = spans.join(marked, F.col("row") == F.col("_row"), "left")
    none = F.array().cast("array<struct<start:int,end:int,remove:boolean>>")
    inside = lambda t: F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    return out.select("doc_id", "row", F.col("spans").alias("personal"), F.filter(F.coalesce("terms", none), lambda t: ~inside(t)).alias("terms"))


def report(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with sanitised: personal data as [KIND], terms as [TERM] or gone. A null text stays null."""
    rows, back = apart(docs, {"doc_id", "text"}, {"sanitised"})
    found = disclosure_spans(rows, **thresholds).drop("doc_id").dropDuplicates(["row"])
    swap = lambda s, by: F.struct(s["start"].alias("start"), s["end"].alias("end"), by.alias("by"))
    spans = F.sort_array(F.concat(F.transform("personal", lambda s: swap(s, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))),
                                  F.transform("terms", lambda s: swap(s, F.when(s["remove"], "").otherwise("[TERM]")))))
    out = rows.withColumn("_row", row_key()).join(found.withColumn("_spans", spans).select("row", "_spans"), F.col("_row") == F.col("row"))

    def step(acc: Column, s: Column) -> Column:  # overlapping spans: the first one's mark stands
        text = F.concat(acc["text"], F.when(s["start"] >= acc["at"], F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["by"])).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("text"))

    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step,
                        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return back(out, clean.alias("sanitised"))
