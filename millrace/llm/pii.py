"""Personal data and the terms that give it away, with DataFrame functions only.

Fixed patterns find the protected entities: e-mail addresses, IP addresses, card and phone numbers.
Then the corpus says how strongly other terms (runs of letters) reveal an entity: for a term t in the
neighbourhood of an entity e, the pointwise mutual information log2(P(e|t) / P(e)), over different
texts, as a share of the entity's information content -log2 P(e). At 1 the term occurs only with the
entity. Terms seen near an entity in at least `support` different neighbourhoods (so copies of one
passage count once) are removed from `remove` on and generalised from `generalise` on, wherever they
occur. The patterns' spans always stay.

The patterns use possessive loops, so long runs of digits or letters take linear time and no stack.
Corpus counts go over all texts; terms and texts to mark are broadcast if their counted number is
small, else joined on both sides.

Cases: null texts are empty and have no spans; repeated rows and null ids keep their rows, equal
texts count once in the corpus. A table without entities, or an empty one, gives no terms. Offsets are
code points, ends exclusive. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import small, stored

#: Order of the kinds; terms come last.
KINDS = ("email", "ip", "card", "phone", "term")
#: Where a match may begin: after the last match, or at the begin of a run. Elsewhere in a run a
#: match would begin earlier or not at all.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters and terms of a neighbourhood on either side.
NEAR_CHARS, NEAR_TERMS = 120, 5
LETTERS = r"[^\p{L}]+"
SHORTEST_TERM = 3
#: Terms and texts sent to every task at most (about 100 bytes each).
MOST_SENT = 500_000
#: Bytes of marked texts sent to every task at most; a row holds all terms of a text.
MOST_BYTES = 64 << 20
#: Values summed one by one; longer arrays are summed in blocks of this size.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def _sum(values: Column) -> Column:
    return F.reduce(values, F.lit(0), lambda total, x: total + x)


def sums_before(values: Column) -> Column:
    """For each value the sum of those before it; linear in blocks."""

    def whole(v: Column) -> Column:
        blocks = upto(F.ceil(F.size(v) / BLOCK))

        def with_sums(sums: Column) -> Column:
            starts = F.transform(blocks, lambda b: _sum(F.slice(sums, F.lit(1), b)))
            return let(starts, lambda s: F.transform(v, lambda x, i: _before(v, s, i)))

        return let(F.transform(blocks, lambda b: _sum(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))), with_sums)

    def _before(v: Column, starts: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        return F.get(starts, block) + _sum(F.slice(v, block * BLOCK + 1, i - block * BLOCK))

    return let(values, whole)


def matches(text: Column, pattern: Column, there: Column, near_chars: int = NEAR_CHARS) -> Column:
    """Matches with start, end, value and the text on both sides; none where `there` is false."""

    def located(found: Column) -> Column:
        pieces, hits = found["pieces"], found["hits"]
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        return F.zip_with(
            F.arrays_zip(sums_before(steps).alias("before"), hits.alias("hit")),
            F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("left"), F.slice(pieces, F.lit(2), F.size(hits)).alias("right")),
            lambda a, b: F.struct(
                (a["before"] + F.length(b["left"])).alias("start"),
                (a["before"] + F.length(b["left"]) + F.length(a["hit"])).alias("end"),
                a["hit"].alias("value"),
                F.right(b["left"], F.lit(near_chars)).alias("left"),
                F.left(b["right"], F.lit(near_chars)).alias("right"),
            ),
        )

    found = F.struct(
        F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits")
    )
    none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    return F.when(there, let(found, located)).otherwise(none)


def _valid_ip(value: Column) -> Column:
    def fits(part: Column) -> Column:
        return let(
            F.ltrim(part, F.lit("0")), lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255")))
        )

    return F.forall(F.split(value, r"\."), fits)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _valid_card(value: Column) -> Column:
    def luhn(digits: Column) -> Column:
        def worth(i: Column) -> Column:  # i counts from the right
            digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
            twice = digit * 2
            return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        return F.when(
            F.length(digits).between(14, 19), _sum(F.transform(upto(F.length(digits)), worth)) % 10 == 0
        ).otherwise(F.lit(False))

    return let(_digits(value), luhn)


def _valid_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def base_matches(text: Column, near_chars: int = NEAR_CHARS) -> dict[str, Column]:
    """Per kind the valid matches of the fixed patterns."""
    email = matches(text, F.lit(EMAIL), F.contains(text, F.lit("@")), near_chars)
    ip = matches(text, F.lit(IP), F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), near_chars)
    card = matches(text, F.lit(CARD), F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){13}")), near_chars)
    phone = matches(text, F.lit(PHONE), F.contains(text, F.lit("+")), near_chars)
    return {
        "email": email,
        "ip": F.filter(ip, lambda m: _valid_ip(m["value"])),
        "card": F.filter(card, lambda m: _valid_card(m["value"])),
        "phone": F.filter(phone, lambda m: _valid_phone(m["value"])),
    }


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def with_matches(texts: DataFrame, near_chars: int = NEAR_CHARS) -> DataFrame:
    """`texts` with a column of matches per kind."""
    return texts.select("*", *(m.alias(kind) for kind, m in base_matches(F.col("text"), near_chars).items()))


def neighbourhoods(
    found: DataFrame, near_chars: int = NEAR_CHARS, near_terms: int = NEAR_TERMS, shortest_term: int = SHORTEST_TERM
) -> DataFrame:
    """`entity`, `term`, `near` (a hash of the neighbourhood) and `text_key`, each once."""

    def entities(kind: str) -> Column:
        value = F.lower if kind in ("email", "ip") else _digits
        return F.transform(
            kind,
            lambda m: F.struct(
                F.xxhash64(F.lit(kind), value(m["value"])).alias("entity"), m["left"].alias("left"), m["right"].alias("right")
            ),
        )

    every = F.concat(*map(entities, KINDS[:4]))
    rows = found.where(" OR ".join(f"size({k}) > 0" for k in KINDS[:4])).select("text_key", F.inline(every))

    def terms(side: str) -> Column:
        cut = F.filter(F.split(F.lower(F.col(side)), LETTERS), lambda t: F.length(t) >= shortest_term)
        whole = F.col("n_cut") < near_chars  # else the outermost term may be cut off
        if side == "left":
            cut = let(cut, lambda c: F.when(whole, c).otherwise(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0)))))
            return let(cut, lambda c: F.slice(c, F.greatest(F.size(c) - near_terms + 1, F.lit(1)), F.lit(near_terms)))
        cut = let(cut, lambda c: F.when(whole, c).otherwise(F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(0)))))
        return let(cut, lambda c: F.slice(c, F.lit(1), F.lit(near_terms)))

    left = rows.withColumn("n_cut", F.length("left")).withColumn("before", terms("left"))
    both = left.withColumn("n_cut", F.length("right")).withColumn("after", terms("right"))
    near = both.select("text_key", "entity", F.concat("before", "after").alias("terms"))
    return near.select(
        "text_key", "entity", F.xxhash64(F.concat_ws(" ", "terms")).alias("near"), F.explode("terms").alias("term")
    ).distinct()


def disclosures(
    texts: DataFrame, support: int = 3, generalise: float = 0.8, remove: float = 0.95, most_sent: int = MOST_SENT,
    near_chars: int = NEAR_CHARS, near_terms: int = NEAR_TERMS, shortest_term: int = SHORTEST_TERM,
) -> tuple[DataFrame, DataFrame] | None:
    """Terms that reveal an entity (`term`, `disclosure`, `action`) and where they occur (`text_key`,
    `term`); None if there is none."""
    found = with_matches(texts, near_chars)
    near = stored(neighbourhoods(found, near_chars, near_terms, shortest_term), "pii-near")
    n_entity = near.groupBy("entity").agg(F.count_distinct("text_key").alias("n_entity"))
    n_near = near.groupBy("term").agg(F.count_distinct("text_key").alias("n_near"))
    pairs = near.groupBy("entity", "term").agg(
        F.count_distinct("near").alias("places"), F.count_distinct("text_key").alias("n_both")
    ).where(F.col("places") >= support)
    if pairs.isEmpty():
        return None
    total = texts.agg(F.count_distinct("text_key")).first()[0]

    def disclosure(n_term: str) -> Column:
        information = F.log2(F.lit(total) / F.col("n_entity"))
        shared = F.log2(F.col("n_both") * F.lit(total) / (F.col(n_term) * F.col("n_entity")))
        return F.when(information > 0, shared / information)

    # A term is in at least as many texts as it is near entities, which bounds what it can reveal;
    # this leaves out the common words before all texts are searched.
    pairs = pairs.join(n_entity, "entity").join(n_near, "term").where(disclosure("n_near") >= generalise)
    pairs = stored(pairs, "pii-pairs")
    if pairs.isEmpty():
        return None
    # Texts per term are summed over all words, and only terms that do reveal are then looked up again,
    # so a common word beside an entity never becomes a row for each of its texts.
    copies = texts.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = stored(copies, "pii-copies")
    words = F.explode(F.array_distinct(F.split(F.lower("text"), LETTERS))).alias("term")
    counted = texts.join(small(copies, copies.count(), most_sent), "text_key", "left").select(
        F.coalesce("copies", F.lit(1)).alias("copies"), words
    ).groupBy("term", "copies").agg(F.count(F.lit(1)).alias("n"))
    n_term = counted.groupBy("term").agg(F.sum(F.expr("n div copies")).alias("n_term"))
    scored = pairs.join(n_term, "term").select("term", disclosure("n_term").alias("disclosure"))
    revealing = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= generalise)
    action = F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise")
    revealing = stored(revealing.withColumn("action", action), "pii-revealing")
    n_revealing = revealing.count()
    if not n_revealing:
        return None
    sent = small(revealing, n_revealing, most_sent)
    places = stored(texts.select("text_key", words).join(sent, "term").distinct(), "pii-places")
    return revealing, places


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, generalise: float = 0.8,
    remove: float = 0.95, most_sent: int = MOST_SENT, near_chars: int = NEAR_CHARS, near_terms: int = NEAR_TERMS,
    shortest_term: int = SHORTEST_TERM, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """`id`, `text` and the matches per kind; those of terms have their action in `left`.

    A term is near an entity if it is among the `near_terms` terms of at least `shortest_term` letters on
    one side of it, within `near_chars` characters. It is marked if it is near one entity in `support`
    different neighbourhoods and discloses at least `generalise` of it, and removed from `remove` on.
    """
    texts = texts_of(docs, id_col, text_col)
    found = with_matches(texts, near_chars)
    terms = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
    revealed = disclosures(texts, support, generalise, remove, most_sent, near_chars, near_terms, shortest_term)
    if revealed is not None:
        marks = revealed[1].groupBy("text_key").agg(
            F.array_join(F.array_sort(F.collect_list("term")), "|").alias("marked"),
            F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"),
        ).withColumnRenamed("text_key", "marked_key")
        marks = stored(marks, "pii-marks")
        width = F.octet_length("marked") * 4 + 200  # the terms twice, with their actions and the row
        marks = small(marks, marks.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0], most_bytes)
        found = found.join(marks, F.col("text_key") == F.col("marked_key"), "left")
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.coalesce("marked", F.lit("-")), F.lit(r")(?!\p{L})"))
        terms = F.transform(
            matches(F.col("text"), pattern, F.col("marked").isNotNull()),
            lambda m: F.struct(
                m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"),
                F.coalesce(F.try_element_at("actions", F.lower(m["value"])), F.lit("remove")).alias("left"),
                m["right"].alias("right"),
            ),
        )
    return found.select("id", "text", *KINDS[:4], terms.alias("term"))


def spans(kinds: tuple[str, ...] = KINDS) -> Column:
    """All spans of the kinds' columns, by start, then kind: start, order, kind, end, action."""

    def of(order: int, kind: str) -> Column:
        return F.transform(
            kind,
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), m["end"].alias("end"),
                (m["left"] if kind == "term" else F.lit("generalise")).alias("action"),
            ),
        )

    every = [of(i, kind) for i, kind in enumerate(kinds)]
    return F.sort_array(F.concat(*every))


def as_text(found: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, found: Column) -> Column:
    """The text with its spans generalised to their kind or removed; overlapping spans are one."""

    def step(at: Column, span: Column) -> Column:
        mark = F.when(span["action"] == "remove", "").otherwise(F.concat(F.lit("["), F.upper(span["kind"]), F.lit("]")))
        more = F.concat(at["out"], F.substring(text, at["end"] + 1, span["start"] - at["end"]), mark)
        return F.struct(
            F.greatest(at["end"], span["end"]).alias("end"),
            F.when(span["start"] >= at["end"], more).otherwise(at["out"]).alias("out"),
        )

    first = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"))
    rest = lambda at: F.concat(at["out"], F.substring(text, at["end"] + 1, F.length(text)))
    return F.reduce(found, first, step, rest)
