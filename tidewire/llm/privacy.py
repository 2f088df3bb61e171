"""Personal data: patterns, and an information-theoretic measure of what the words around them give away.

Built from column functions alone. Patterns give the protected entities. A term near an entity discloses it as far as
their pointwise mutual information reaches the entity's own information: PMI(term; entity) / IC(entity), from document
counts of the whole corpus. Terms over one threshold are removed beside the entity, terms over a lower one generalised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed, fresh, quoted

KINDS = ("email", "ip", "card", "phone")
TERM, VAGUE = "term", "vague"
REMOVE, GENERALISE = 0.9, 0.7
# Contexts, unlike each other, in which a term must stand with an entity; chance meetings and copies stay below.
SUPPORT = 3
BLOCK = 256

# The contract's patterns, with possessive loops and starts only where a leftmost match can start, so that long texts
# take linear time and no deep recursion; matches are the same.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A leftmost match is a whole run of digits with single blanks or hyphens between: only runs of 13 to 19 digits count.
_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_TERM = r"\p{L}{3,}+"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def occurrences(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of all matches, in code points, end exclusive.

    Places are running sums of the lengths of matches and of what lies between them, in blocks, so that a text with
    very many matches does not copy a growing array for each.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    both = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("value"), F.length(g).alias("gap"), F.length(m).alias("size")))
    found = F.filter(both, lambda x: x["value"].isNotNull())
    # One-element arrays bind a value for the steps below, so none of them is computed again for each element.
    blocks = F.flatten(F.transform(F.array(found), lambda all_: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(all_) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, BLOCK)
    )))
    summed = F.transform(blocks, lambda block: F.struct(block.alias("block"), F.aggregate(
        block, F.lit(0), lambda total, x: total + x["gap"] + x["size"]).alias("sum")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,block:array<struct<value:string,gap:int,size:int>>>>").alias("out"))
    placed = F.aggregate(summed, start, lambda acc, x: F.struct(
        (acc["at"] + x["sum"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x["block"].alias("block")))).alias("out"),
    ))["out"]

    def spans(block):
        empty = F.struct(block["at"].alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
        return F.aggregate(block["block"], empty, lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value"),
            ))).alias("out"),
        ))["out"]

    return F.flatten(F.transform(placed, spans))


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)))
    parts = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value) of all valid matches, by kind as in ``KINDS``, then by start."""
    parts = []
    for kind, pattern, sign in (
        ("email", _EMAIL, text.contains("@")), ("ip", _IP, text.rlike(r"[0-9]\.[0-9]")),
        ("card", _CARD, text.rlike("[0-9](?:[ -]?[0-9]){12}")), ("phone", _PHONE, text.contains("+")),
    ):
        sound = F.filter(occurrences(text, pattern), lambda s: _valid(kind, s["value"]))
        named = F.transform(sound, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"], s["end"], s["value"]))
        parts.append(F.when(sign, named.cast(_SPAN)).otherwise(F.array().cast(_SPAN)))
    return F.concat(*parts)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def entities(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """(key, base, text): the base spans of every row, and its text where there are any."""
    plain = df.select(key.alias("key"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    found = plain.select("key", "text", base_spans(F.col("text")).alias("base"))
    return found.select("key", "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))


# A document by its key: a null id is a value here.
_DOCUMENT = ("_n", "_i", "_h")


def _flat(frame: DataFrame) -> DataFrame:
    key = F.col("key")
    return frame.withColumns({"_n": key["id"].isNull(), "_i": F.coalesce(key["id"], F.lit(0)), "_h": key["h"]})


def disclosing_terms(found: DataFrame, documents: DataFrame, text: Column, remove: float = REMOVE,
                     generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """(key, kind, start, end): places of terms that disclose an entity, anywhere in the documents that hold it.

    ``found`` is (key, base, text) of all documents with an entity, ``documents`` the corpus whose words count. A context is
    the whole line around an entity (no pattern runs over a line's end). A term counts with an entity where it stands in at
    least ``support`` of its contexts, unlike each other and half of all they share: the least hashes of a line's terms tell
    copies of one. All documents count for term frequencies; no term or entity is gathered in one place, counts combine in
    tasks first. Terms too frequent to reach the threshold even if they stood in every context are left out before pairing.
    """
    lines = found.select("key", F.explode(occurrences(F.col("text"), r"[^\n]+")).alias("l")).select(
        "key", F.col("l.start").alias("at"), F.col("l.value").alias("line"), base_spans(F.col("l.value")).alias("spans"))
    free = F.filter(occurrences(F.col("line"), _TERM), lambda t: ~F.exists(
        "spans", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    terms = F.transform(free, lambda t: F.struct(
        (F.col("at") + t["start"]).alias("start"), (F.col("at") + t["end"]).alias("end"), F.lower(t["value"]).alias("term")))
    lines = lines.select("key", "at", "spans", terms.alias("terms"))
    hashes = F.transform("terms", lambda t: F.xxhash64(t["term"]))
    other = F.transform("terms", lambda t: F.xxhash64(t["term"], F.lit(1)))
    mark = F.xxhash64(F.array_min(hashes), F.array_min(other)).alias("mark")
    places = F.transform("terms", lambda t: F.struct(F.xxhash64(t["term"]).alias("term"), t["start"].alias("start"), t["end"].alias("end")))
    name = lambda s: F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(
        F.regexp_replace(s["value"], "[ ()-]", "")))
    lines = checkpointed(_flat(lines).select(
        *_DOCUMENT, "key", "at", mark, places.alias("terms"), F.transform("spans", name).alias("entities")))
    mentions = lines.select(*_DOCUMENT, "at", "mark", F.explode("entities").alias("entity")).groupBy(
        *_DOCUMENT, "at", "mark", "entity").agg(F.count(F.lit(1)).alias("c"))
    n = documents.agg(F.count(F.lit(1))).scalar().cast("double")
    held = mentions.groupBy("entity").agg(F.sum("c").alias("n_entity")).where(F.col("n_entity") >= support)
    held = checkpointed(held.withColumn("most", n * F.pow(F.least(F.col("n_entity"), n) / n, F.lit(generalise)) + 1e-6))
    mentions = mentions.join(held, "entity")
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0)), lambda w: F.xxhash64(w)))
    frequency = documents.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    # Only terms of contexts that some entity can share often enough.
    near = lines.where(F.size("entities") > 0).select(*_DOCUMENT, "at", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term"))
    rare = near.join(frequency.where(F.col("n_term") <= held.agg(F.max("most")).scalar()), "term")
    paired = mentions.join(rare, [*_DOCUMENT, "at"]).where(F.col("n_term") <= F.col("most"))
    pairs = paired.groupBy("entity", "term", "mark").agg(
        F.sum("c").alias("c"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")
    ).groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("marks"), F.sum("c").alias("n_both"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    pairs = pairs.where((F.col("marks") >= support) & (2 * F.col("marks") >= F.col("n_both")))
    own = F.log(n / F.least(F.col("n_entity"), n))
    mutual = F.log(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    share = F.when(own > 0, mutual / own).otherwise(0.0)
    judged = pairs.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise)
    kind = F.when(F.col("share") >= remove, TERM).otherwise(VAGUE)
    told = mentions.select(*_DOCUMENT, "entity").distinct().join(judged, "entity").groupBy(*_DOCUMENT, "term").agg(F.min(kind).alias("kind"))
    every = lines.select("key", *_DOCUMENT, F.explode("terms").alias("t")).select("key", *_DOCUMENT, "t.*")
    return every.join(told, [*_DOCUMENT, "term"]).groupBy("key", "start", "end").agg(F.min("kind").alias("kind")).select(
        "key", "kind", "start", "end")


def identity(doc_id: Column, text: Column) -> Column:
    """Rows equal in id and text are one document."""
    return F.struct(doc_id.cast("long").alias("id"), F.xxhash64(text).alias("h"))


def all_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, added): every document's base spans and the spans of disclosing terms, those over base spans left out.

    Null texts count as empty. ``key`` is ``identity``; a document that is there twice is listed twice with equal spans.
    """
    key = identity(quoted(doc_id), quoted(text))
    found = checkpointed(entities(df, key, quoted(text)))
    terms = disclosing_terms(found.where(F.size("base") > 0).dropDuplicates(["key"]), df, quoted(text))
    added = terms.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("added"))
    # Keys with a null id match here too: their hash and the null flag stand in for the key.
    joined = _flat(found.drop("text")).join(_flat(added).drop("key"), [*_DOCUMENT], "left").drop(*_DOCUMENT)
    free = F.filter(F.coalesce("added", F.array().cast("array<struct<start:int,end:int,kind:string>>")), lambda t: ~F.exists(
        "base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("key", "base", free.alias("added"))


def sanitise(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows of ``df``, with personal data in ``text`` replaced by its kind in brackets and disclosing terms removed
    or generalised to ``[TERM]``. Overlapping spans become one, named by the first. Null texts stay null."""
    n, i, h, spans = fresh(df, "n", "i", "h", "spans")
    listed = all_spans(df, doc_id, text).where((F.size("base") > 0) | (F.size("added") > 0)).dropDuplicates(["key"])
    both = F.concat(
        F.transform("base", lambda s: F.struct(s["start"], s["end"], s["kind"])), F.transform("added", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    listed = listed.select(
        F.col("key.id").isNull().alias(n), F.coalesce("key.id", F.lit(0)).alias(i), F.col("key.h").alias(h), F.sort_array(both).alias(spans))
    key = identity(quoted(doc_id), quoted(text))
    marked = df.withColumns({n: key["id"].isNull(), i: F.coalesce(key["id"], F.lit(0)), h: key["h"]}).join(listed, [n, i, h], "left")
    tag = lambda s: F.when(s["kind"] == TERM, "").when(s["kind"] == VAGUE, "[TERM]").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(quoted(spans), start, lambda acc, s: F.when(
        s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
    ).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(quoted(text), acc["at"] + 1, s["start"] - acc["at"]), tag(s)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(quoted(text), acc["at"] + 1, F.length(quoted(text)))))
    clean = marked.withColumn(text, F.when(quoted(spans).isNotNull(), cut).otherwise(quoted(text)))
    return clean.drop(n, i, h, spans)
