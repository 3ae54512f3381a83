"""Personal data: exact patterns, and terms whose co-occurrence with what they match gives it away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The method adds terms: with p() the share of
distinct texts, a term t discloses an entity e (one address or number) as far as PMI(e; t) = log p(e, t) / (p(e) p(t)) comes
near the entity's information IC(e) = -log p(e). The ratio is 1 if each text with t has e. From GENERALISE on, a term gives way to what many terms share,
its first character; from LABEL on, to a label that all share; from REMOVE on, it is deleted; and this goes for every text,
also where the entity itself is missing.
Entities, terms and their co-occurrence are counted over whole distinct texts, so copies count once; how far a term stands from
the entity does not matter. Pairs are listed for entities of SUPPORT texts or more, and without terms that stand in too many
texts to come near any ratio that counts.

Null and empty texts have no spans; an empty table gives an empty one. Rows that repeat a doc_id stay as they are. Copies of a
text get the same spans. Terms whose ratios are equal fare equally. Only doc_id and text are read; sanitised() returns all
columns, and changes none but the text. Matches that fail a check (parts, digits,
Luhn) are dropped without another try. All steps are built-in expressions; what is broadcast is checked in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import spans as P
from tidemark.llm.common import fresh
from tidemark.plans.storage import scoped, written

KINDS = ("email", "ip", "card", "phone")
#: Patterns without a way back, so that no text makes them slow; each stands for the plain one beside it.
#: A local part begins at its first character, or where the match before ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"  # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"  # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: Chains of fewer than 14 digits fail anyway; a chain that is long enough is taken from its first digit.
CARD = r"(?<![0-9])(?=(?:[0-9][ -]?){13}[0-9])[0-9]++(?:[ -][0-9]++)*+"  # [0-9]([\x20-]?[0-9])+
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Distinct texts with both entity and term that a term needs.
SUPPORT = 3
#: Disclosure ratios from which a term is cut to its first character, generalised wholly, and removed.
GENERALISE, LABEL, REMOVE = 0.9, 0.93, 0.97
#: A term: three letters or digits or more, letter case aside.
TERM = r"[\p{L}\p{N}]{3,}+"
#: Rows of a table that is broadcast, at most.
BROADCAST_ROWS = 200_000


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip_fits(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card_fits(m: Column) -> Column:
    d = _digits(m)
    doubled = lambda c, i: F.when(i % 2 == 1, F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    luhn = F.aggregate(F.transform(F.split(F.reverse(d), "(?!^)(?!$)"), lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(d).between(14, 19), luhn % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, end, match) of each kind."""
    return {
        "email": P.find(text, EMAIL, text.contains("@")),
        "ip": F.filter(P.find(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: _ip_fits(s["match"])),
        "card": F.filter(P.find(text, CARD, text.rlike("[0-9](?:[ -]?[0-9]){13}")), lambda s: _card_fits(s["match"])),
        "phone": F.filter(P.find(text, PHONE, text.contains("+")), lambda s: F.length(_digits(s["match"])).between(10, 15)),
    }


def _marked(kinds: dict[str, Column]) -> Column:
    """All spans as structs (start, rank, kind, end, match), ordered by start and then kind."""
    mark = lambda i, k: lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), F.lit(k).alias("kind"), s["end"].alias("end"), s["match"].alias("match"))
    parts = [F.transform(c, mark(i, k)) for i, (k, c) in enumerate(kinds.items())]
    return F.array_sort(F.concat(*parts))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def analysed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, digest, base, entities): digest names the text, base has its marked spans, entities what they name."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text")).withColumn("base", _marked(base_spans(F.col("text"))))
    entity = lambda s: F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["match"])).otherwise(_digits(s["match"])))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "base", F.array_distinct(F.transform("base", entity)).alias("entities"))


def holders(rows: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(digest, entities, terms) of each distinct text that holds an entity of SUPPORT texts or more: those (entity, n_e), and all terms."""
    held = rows.filter(F.size("entities") > 0).select("digest", F.explode("entities").alias("entity")).distinct()
    often = written(held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).filter(F.col("n_e") >= SUPPORT), "entities")
    held = held.join(F.broadcast(often) if often.count() <= BROADCAST_ROWS else often, "entity")
    by = written(held.groupBy("digest").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities")), "holders")
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.md5(t.cast("binary")).alias("digest"), t.alias("text")).join(F.broadcast(by) if by.count() <= BROADCAST_ROWS else by, "digest")
    return written(texts.select("digest", "entities", _terms(F.col("text")).alias("terms")).dropDuplicates(["digest"]), "holderterms")


def _words(docs: DataFrame, terms: DataFrame, text: str, *more: str) -> DataFrame:
    """(term, more) for each row of docs (digest, more, text) and each of terms in it."""
    wanted = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    return docs.select(*more, F.explode(_terms(F.col(text))).alias("term")).join(wanted, "term")


def term_counts(rows: DataFrame, docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n_t) of terms: distinct texts with it. Only texts with copies are told apart; the others are counted where they are."""
    copied = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", F.col("digest").alias("copied")), "copied")
    t = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.md5(t.cast("binary")).alias("digest"), t.alias("text")).join(F.broadcast(copied) if copied.count() <= BROADCAST_ROWS else copied, "digest", "left")
    n = _words(texts, terms, "text", "copied").groupBy("term", "copied").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("term").agg(F.sum(F.when(F.col("copied").isNull(), F.col("n")).otherwise(1)).alias("n_t"))


def term_texts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(digest, term) for each distinct text and each of terms in it; the texts are scanned in place."""
    t = F.coalesce(F.col(text), F.lit(""))
    return _words(docs.select(F.md5(t.cast("binary")).alias("digest"), t.alias("text")), terms, "text", "digest").distinct()


def disclosures(rows: DataFrame, docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(term, ratio, label) of terms to sanitise, and (digest, term) of the texts that hold them."""
    texts = holders(rows, docs, text)
    total = rows.select("digest").distinct().agg(F.count(F.lit(1)).alias("n"))
    seen = written(texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_held")).filter(F.col("n_held") >= SUPPORT), "seen")

    def ratio(n_et: Column, n_e: Column, n_t: Column) -> Column:
        n = F.col("n")
        return F.when(n > n_e, F.log(n * n_et / (n_e * n_t)) / F.log(n / n_e))

    # a term is in no fewer texts than those that have it beside an entity, in no more texts with an entity than either is
    # in, and the ratio falls with the term's number: what fails with these bounds fails with the counts (but for rounding)
    near = texts.select("entities", F.explode("terms").alias("term")).join(F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen, "term").crossJoin(F.broadcast(total))  # one row
    may = F.filter("entities", lambda e: ratio(F.least(e["n_e"], F.col("n_held")), e["n_e"], F.col("n_held")) >= GENERALISE - 1e-9)
    pairs = near.select("term", "n_held", "n", F.explode(may).alias("e")).groupBy("e.entity", "e.n_e", "term", "n_held", "n").agg(F.count(F.lit(1)).alias("n_et"))
    both = pairs.filter((F.col("n_et") >= SUPPORT) & (ratio(F.col("n_et"), F.col("n_e"), F.col("n_held")) >= GENERALISE))
    both = written(both.select("entity", "term", "n", "n_e", "n_et"), "pairs")
    counts = written(term_counts(rows, docs, both.select("term").distinct(), text), "counts")
    scored = both.join(counts, "term").withColumn("ratio", ratio(F.col("n_et"), F.col("n_e"), F.col("n_t"))).filter(F.col("ratio") >= GENERALISE)
    label = F.when(F.col("ratio") >= REMOVE, F.lit("")).otherwise(generalised(F.col("term"), F.col("ratio")))
    flagged = written(scored.groupBy("term").agg(F.max("ratio").alias("ratio")).select("term", "ratio", label.alias("label")), "flagged")
    return flagged, written(term_texts(docs, flagged.select("term"), text), "held")


def generalised(term: Column, ratio: Column) -> Column:
    """What stands for a term: 4711 becomes [4...] and then [NUMBER], a word [w...] and then [TERM]."""
    kind = F.when(term.rlike("^[0-9]+$"), F.lit("[NUMBER]")).otherwise(F.lit("[TERM]"))
    return F.when(ratio >= LABEL, kind).otherwise(F.concat(F.lit("["), F.substring(term, 1, 1), F.lit("...]")))


def _term_spans(text: Column, terms: Column) -> Column:
    """Spans of those words that are in terms; only they are put into an array, so that long texts are not slow."""
    words = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    pairs = F.zip_with(words, F.slice(F.split(text, TERM, -1), F.lit(1), F.size(words)), lambda h, b: F.struct(h.alias("h"), b.alias("b")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["h"])
        span = F.struct(start.alias("start"), end.alias("end"), x["h"].alias("match"))
        return F.struct(end.alias("at"), F.when(F.array_contains(terms, F.lower(x["h"])), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), P.SPAN).alias("out")), step, lambda acc: acc["out"])


def _texts_with_terms(docs: DataFrame, flagged: DataFrame, held: DataFrame, text: str) -> DataFrame:
    """(digest, text, terms: map of term to label) of distinct texts that hold flagged terms."""
    by = written(held.join(flagged, "term").groupBy("digest").agg(F.map_from_entries(F.collect_set(F.struct("term", "label"))).alias("terms")), "termtexts")
    wanted = F.broadcast(by) if by.count() <= BROADCAST_ROWS else by
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.md5(t.cast("binary")).alias("digest"), t.alias("text")).join(wanted, "digest")
    return rows.withColumn("found", _term_spans(F.col("text"), F.map_keys("terms")))


@scoped
def find_private(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans of each row."""
    rows = written(analysed(docs, text, doc_id), "analysed")
    flagged, held = disclosures(rows, docs, text)
    extra = _texts_with_terms(docs, flagged, held, text)
    mark = F.transform("found", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), s["end"].alias("end"), s["match"].alias("match")))
    extra = written(extra.select("digest", mark.alias("extra")).groupBy("digest").agg(F.max("extra").alias("extra")), "extra")
    # a term inside a base span is covered by it
    inside = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    out = rows.select("doc_id", "digest", "base").join(F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra, "digest", "left")
    out = out.withColumn("more", F.filter(F.coalesce("extra", F.slice("base", 1, 0)), lambda s: ~inside(s)))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(n(k) for k in KINDS), F.size("more").cast("long").alias("n_term"), F.sha2(P.joined(F.col("base")), 256).alias("base_sha256"), P.joined(F.array_sort(F.concat("base", "more"))).alias("spans"))


@scoped
def _term_labels(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(digest, terms, found) of distinct texts that hold flagged terms."""
    rows = written(analysed(docs, text, doc_id), "analysed")
    flagged, held = disclosures(rows, docs, text)
    extra = _texts_with_terms(docs, flagged, held, text).select("digest", "terms", "found")
    return extra.groupBy("digest").agg(F.first("terms").alias("terms"), F.max("found").alias("found"))


def sanitised(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with personal data replaced by labels, and disclosing terms generalised or removed. Its columns stay, whatever their names."""
    extra = _term_labels(docs, text, doc_id)
    digest, terms, found, base, every = fresh(docs.columns, "_digest", "_terms", "_found", "_base", "_all")
    extra = extra.toDF(digest, terms, found)
    t = F.col(text)
    full = docs.withColumn(digest, F.md5(F.coalesce(t, F.lit("")).cast("binary"))).join(F.broadcast(extra) if extra.count() <= BROADCAST_ROWS else extra, digest, "left")
    full = full.withColumn(base, _marked(base_spans(F.coalesce(t, F.lit("")))))
    # of overlapping spans the first stays, and terms give way
    apart = F.filter(base, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]) & ((b["start"] < s["start"]) | ((b["start"] == s["start"]) & (b["rank"] < s["rank"])))))
    plain = F.transform(apart, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label")))
    free = F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    more = F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(terms, F.lower(s["match"])).alias("label")))
    full = full.withColumn(every, F.array_sort(F.concat(plain, F.coalesce(more, F.slice(plain, 1, 0)))))
    return full.withColumn(text, F.when(F.size(every) > 0, P.replaced(t, F.col(every), lambda s: s["label"])).otherwise(t)).select(*docs.columns)
