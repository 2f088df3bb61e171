"""Ranked text search: BM25 over the four text columns, with structured queries."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tidewire.functions.text import let, normalize_cashtags, or_blank
from tidewire.operators.feed import filter_posts
from tidewire.operators.skew import shared_folder

TEXT_COLUMNS = ("content", "summary", "author_handle", "tickers_text")
K1, B = 1.2, 0.75
_MIN_IDF = 1e-6


def _accent_table() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and their bases, derived from canonical decomposition."""
    source, target = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and unicodedata.combining(parts[1]):
            source.append(chr(code))
            target.append(parts[0])
    return "".join(source), "".join(target)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without accents."""
    plain = F.translate(F.regexp_replace(F.lower(or_blank(text)), r"\p{M}", ""), *_accent_table())
    return F.filter(F.split(plain, r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def search_index(posts: DataFrame) -> DataFrame:
    """Posts with one token column per text column (``t_*``) and the total length ``n_tokens``.

    Write it once (say, partitioned by day); searches then read tokens and filters, never the texts.
    """
    rows = posts.withColumns({f"t_{c}": tokens(F.col(c)) for c in TEXT_COLUMNS})
    size = sum((F.size(f"t_{c}") for c in TEXT_COLUMNS), F.lit(0))
    return rows.withColumn("n_tokens", size)


@dataclass(frozen=True)
class Term:
    """A word, a phrase (several words) or, with ``prefix``, the start of a word; optionally in one column."""

    text: str
    prefix: bool = False
    column: str | None = None


def _words(term: Term) -> list[str]:
    """Words of a query term, folded by the same steps and the same table as ``tokens``."""
    plain = "".join(c for c in term.text.lower() if unicodedata.category(c)[0] != "M")
    plain = plain.translate(str.maketrans(*_accent_table()))
    kept = (c if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co" else " " for c in plain)
    return "".join(kept).split()


def _frequency(term: Term) -> Column:
    """Occurrences of the term in a row."""
    words = _words(term)

    def count(column: Column) -> Column:
        def matches(token: Column, at: Column) -> Column:
            test = F.lit(True)
            for i, word in enumerate(words):
                here = token if i == 0 else F.get(column, at + i)
                last = term.prefix and i == len(words) - 1
                test = test & F.coalesce(here.startswith(word) if last else here == word, F.lit(False))
            return test

        return F.size(F.filter(column, matches))

    def in_column(name: str) -> Column:
        return count(F.col(f"t_{name}")) if len(words) == 1 else let(F.col(f"t_{name}"), count)

    names = [term.column] if term.column else TEXT_COLUMNS
    if not words:
        return F.lit(0)
    return sum((in_column(n) for n in names), F.lit(0))


_ORDER = {
    "rank": lambda: [F.col("rank")],
    "score": lambda: [F.col("score").desc_nulls_last()],
    "time": lambda: [F.col("created_at").desc_nulls_last()],
}


def text_search(
    index: DataFrame,
    must: list[Term] = (),
    should: list[Term] = (),
    must_not: list[Term] = (),
    order: str = "rank",
    limit: int = 50,
    offset: int = 0,
    **filters,
) -> DataFrame:
    """Rows with all ``must`` terms, at least one ``should`` term if there is no other, and no ``must_not`` term.

    Lower rank is better. Length and document frequencies are those of the whole index, before any filter; they are
    one row, computed without a shuffle of documents.
    """
    if order not in _ORDER:
        raise ValueError(f"Invalid order: {order!r}. Must be one of {sorted(_ORDER)}")
    scored = [*must, *should]
    if not scored:
        raise ValueError("a search needs at least one term to match")
    frequencies = F.struct(*[_frequency(t).alias(f"f{i}") for i, t in enumerate(scored)])
    stats = index.select("n_tokens", frequencies.alias("tf")).agg(
        F.count(F.lit(1)).alias("docs"),
        F.avg("n_tokens").alias("mean_size"),
        *[F.count_if(F.col(f"tf.f{i}") > 0).alias(f"df{i}") for i in range(len(scored))],
    )

    def matches(tf: Column) -> Column:
        test = F.lit(True)
        for i in range(len(must)):
            test = test & (tf[f"f{i}"] > 0)
        if should and not must:
            test = F.exists(F.array(*[tf[f"f{i}"] for i in range(len(should))]), lambda n: n > 0)
        for term in must_not:
            test = test & (_frequency(term) == 0)
        return test

    # Matching inside the generator keeps the optimiser from copying the counting into a pushed-down filter;
    # the plain filters below still reach the scan.
    kept = F.filter(F.array(frequencies), matches)
    hits = filter_posts(index, **filters).select("*", F.explode(kept).alias("_tf"))
    hits = hits.withColumn("_s", stats.select(F.struct("*")).scalar())
    rank = F.lit(0.0)
    for i in range(len(scored)):
        df, tf = F.col("_s")[f"df{i}"].cast("double"), F.col(f"_tf.f{i}").cast("double")
        odds = (F.col("_s")["docs"] - df + 0.5) / (df + 0.5)
        idf = F.when(odds > 1, F.ln(odds)).otherwise(_MIN_IDF)
        norm = K1 * (1 - B + B * F.col("n_tokens") / F.col("_s")["mean_size"])
        rank = rank - idf * tf * (K1 + 1) / (tf + norm)
    drop = ["_s", "_tf", *[f"t_{c}" for c in TEXT_COLUMNS]]
    page = hits.withColumn("rank", rank).drop(*drop).orderBy(*_ORDER[order](), "id")
    return (page.offset(offset) if offset else page).limit(limit)


# Places in a column are counted from this times the column's number, so no phrase runs from one column into another.
FIELD_ROOM = 1 << 32


def shelf_of(size: Column) -> Column:
    """Posts of about one length share a shelf (four for each doubling of the number of words): their scores for a word
    depend on little more than how often they hold it."""
    return F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 4).cast("int")


# Words a Python worker groups at a time; a longer post is taken by itself.
GROUPED_WORDS = 500_000


def _grouped(index: DataFrame) -> DataFrame:
    """(term, field, id, n_tokens, places, shelf, tf): one row per row of the index, word and text column that holds it.

    ``tf`` is how often the row holds the word in all columns, told once for each word. Words are grouped within their
    row, where they stand: nothing is shuffled.
    """
    names = [f"t_{c}" for c in TEXT_COLUMNS]
    index = index.select("id", "n_tokens", *names)
    fields = pa.array(TEXT_COLUMNS)

    def group(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.arange(part.num_rows)
        words, row, place = [], [], []
        for number, name in enumerate(names):
            many = pc.list_value_length(part.column(name)).to_numpy(zero_copy_only=False)
            words.append(part.column(name).flatten())
            row.append(np.repeat(rows, many))
            place.append(np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + number * FIELD_ROOM)
        coded = pa.concat_arrays(words).dictionary_encode()
        word, row, place = coded.indices.to_numpy(), np.concatenate(row), np.concatenate(place)
        key = row * max(1, len(coded.dictionary)) + word
        # Places of a row ascend, as do the columns: a stable sort keeps them so.
        order = np.argsort(key, kind="stable")
        key, place = key[order], place[order]
        whole = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
        starts = np.flatnonzero(whole | np.concatenate([[True], place[1:] // FIELD_ROOM != place[:-1] // FIELD_ROOM])[: len(key)])
        first = whole[starts]
        tf = np.zeros(len(starts), np.int64)
        tf[first] = np.diff(np.append(starts[first], len(key)))
        at = pa.array(row[order][starts])
        return pa.RecordBatch.from_arrays([
            coded.dictionary.take(pa.array(word[order][starts])), fields.take(pa.array(place[starts] // FIELD_ROOM)),
            part.column("id").take(at), part.column("n_tokens").take(at),
            pa.ListArray.from_arrays(pa.array(np.append(starts, len(key)), pa.int32()), pa.array(place, pa.int64())),
            pa.array(tf, pa.int64(), mask=~first),
        ], ["term", "field", "id", "n_tokens", "places", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turn = np.cumsum(batch.column("n_tokens").to_numpy(zero_copy_only=False)) // GROUPED_WORDS
            edges = [0, *(np.flatnonzero(turn[1:] != turn[:-1]) + 1).tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                yield group(batch.slice(start, end - start))

    schema = StructType([
        StructField("term", StringType()), StructField("field", StringType()), index.schema["id"], index.schema["n_tokens"],
        StructField("places", ArrayType(LongType())), StructField("tf", LongType()),
    ])
    rows = index.mapInArrow(run, schema)
    return rows.select("term", "field", "id", "n_tokens", "places", shelf_of(F.col("n_tokens")).alias("shelf"), "tf")


def _merged(rows: DataFrame) -> DataFrame:
    """Postings of rows whose ids repeat: one for each word, column, id and length."""
    merged = rows.groupBy("term", "field", "id", "n_tokens").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    own = Window.partitionBy("term", "shelf", "id")
    merged = merged.withColumn("shelf", shelf_of(F.col("n_tokens"))).withColumn("_sum", F.sum(F.size("places")).over(own))
    first = F.row_number().over(own.orderBy("n_tokens", "field")) == 1
    return merged.withColumn("tf", F.when(first, F.col("_sum"))).drop("_sum")


def postings(posts: DataFrame) -> DataFrame:
    """(term, field, id, n_tokens, places, shelf, tf): one row per word, text column and post that holds it.

    ``tf`` is how often the post holds the word in all columns, told in one of its rows for the word.
    """
    return _merged(_grouped(search_index(posts)))


_BOUNDS = "term string, field string, shelf int, posts long, most long, fewest int"


def _bounds(stored: DataFrame) -> DataFrame:
    """(term, field, shelf, posts, most, fewest): posts of a shelf that hold a word in a column (null: in any), how often
    at most, and their least length. Postings stored in order of words and shelves are counted as they lie, without a
    shuffle; a word's shelf that begins in one piece of a file and goes on in another one has a row for each.
    """
    names = ["term", "field", "shelf"]
    order = [*names, "posts", "most", "fewest"]

    def combined(parts: pa.Table) -> pa.Table:
        found = parts.group_by(names).aggregate([("posts", "sum"), ("most", "max"), ("fewest", "min")])
        return found.rename_columns({"posts_sum": "posts", "most_max": "most", "fewest_min": "fewest"}).select(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.table(batch).append_column("posts", pa.array(np.ones(batch.num_rows, np.int64)))
            own = rows.drop_columns("tf")
            every = rows.filter(pc.is_valid(rows["tf"])).drop_columns("most").rename_columns({"tf": "most"})
            every = every.set_column(every.schema.get_field_index("field"), "field", pa.nulls(len(every), pa.string()))
            made = [combined(own.select(order)), combined(every.select(order))]
            found = combined(pa.concat_tables(made if held is None else [held, *made]))
            last = pc.and_(pc.equal(found["term"], batch.column("term")[-1]), pc.equal(found["shelf"], batch.column("shelf")[-1]))
            yield from found.filter(pc.invert(last)).to_batches()
            held = found.filter(last)
        if held is not None:
            yield from held.to_batches()

    rows = stored.select("term", "field", "shelf", F.size("places").cast("long").alias("most"), F.col("n_tokens").alias("fewest"), "tf")
    return rows.mapInArrow(run, _BOUNDS)


def _write_segment(rows: DataFrame, totals: DataFrame, path: str) -> None:
    """Each write has a folder of its own under ``postings``, from which its bounds are counted."""
    ranged = rows.repartitionByRange("term", "shelf", "id").sortWithinPartitions("term", "shelf", "id")
    folder = f"{path}/postings/write=w{uuid.uuid4().hex}"
    ranged.write.parquet(folder)
    _bounds(rows.sparkSession.read.parquet(folder)).write.mode("append").parquet(f"{path}/bounds")
    totals.write.mode("append").parquet(f"{path}/totals")


def write_index(posts: DataFrame, path: str) -> None:
    """Write the postings, ordered by word and shelf, with bounds of what a word can score on a shelf, and the corpus totals.

    Files hold ranges of (word, shelf, post): a search skips all files and row groups whose words it does not ask for,
    prefixes too, and the postings of a frequent word lie in several files. Texts are split into words once; each post's
    postings are kept, packed, in a new folder of the shared one, from which they are dealt to their files and counted.
    The totals are one row per write; writes append (a post in one of them only), ``merge_index`` makes one of many.
    """
    spark = posts.sparkSession
    folder = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    _grouped(search_index(posts)).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    tokens = rows.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens"))
    totals = posts.agg(F.count(F.lit(1)).alias("docs")).crossJoin(tokens)
    # Only where ids repeat do postings of several rows have to meet.
    repeated = posts.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    _write_segment(rows if repeated.isEmpty() else _merged(rows), totals, path)


def merge_index(spark: SparkSession, path: str, target: str) -> None:
    """An index of many writes, as one in a new place: each word's postings lie together again."""
    read = lambda part: spark.read.parquet(f"{path}/{part}")
    totals = read("totals").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    _write_segment(read("postings").drop("write"), totals, target)


def _idf(docs: Column, df: Column) -> Column:
    odds = (docs - df + 0.5) / (df + 0.5)
    return F.when(odds > 1, F.ln(odds)).otherwise(_MIN_IDF)


def _gain(idf: Column, tf: Column, size: Column, mean: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def _shelf_bounds(path: str, spark: SparkSession, scored: list[Term]) -> list[tuple[int, float, int]]:
    """(shelf, the most any of its posts can score, postings) by falling score: as many rows as there are lengths' classes."""
    words = spark.createDataFrame([(_words(t)[0], t.column) for t in scored], "term string, column string")
    bounds = spark.read.parquet(f"{path}/bounds").join(F.broadcast(words), "term")
    bounds = bounds.where(F.col("field").eqNullSafe(F.col("column"))).groupBy("term", "column", "shelf").agg(
        F.sum("posts").alias("posts"), F.max("most").alias("most"), F.min("fewest").alias("fewest"))
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    df = bounds.groupBy("term", "column").agg(F.sum("posts").alias("df"))
    rows = bounds.join(df.withColumnRenamed("column", "c"), (F.col("c").eqNullSafe(F.col("column"))) & (bounds["term"] == df["term"]))
    rows = rows.withColumn("_t", totals.select(F.struct("*")).scalar())
    mean = F.col("_t.tokens") / F.col("_t.docs")
    most = _gain(_idf(F.col("_t.docs"), F.col("df").cast("double")), F.col("most").cast("double"), F.col("fewest"), mean)
    found = rows.groupBy("shelf").agg(F.sum(most).alias("most"), F.sum("posts").alias("posts")).collect()
    return sorted(((r["shelf"], r["most"], r["posts"]) for r in found), key=lambda s: (-s[1], s[0]))


def top_search(
    path: str, posts: DataFrame, must: list[Term] = (), should: list[Term] = (), must_not: list[Term] = (), limit: int = 50, **filters
) -> DataFrame:
    """The first page of ``stored_search`` by rank, reading only shelves that can hold one of its rows.

    Shelves are taken by the most that a post on them can score. When the rows found are enough for a page, its last
    score is compared with what the shelves left can reach at most: those below it are never read. Phrases and
    prefixes have no such bounds; with one of them among the terms that score, everything is read.
    """
    scored = [*must, *should]
    if not scored:
        raise ValueError("a search needs at least one term to match")
    if any(t.prefix or len(_words(t)) != 1 for t in scored):
        return stored_search(path, posts, must, should, must_not, limit=limit, **filters)
    shelves = _shelf_bounds(path, posts.sparkSession, scored)
    return stored_search(path, posts, must, should, must_not, limit=limit, shelves=_shelves_to_read(
        shelves, limit, lambda some: stored_search(path, posts, must, should, must_not, limit=limit, shelves=some, **filters)), **filters)


def _shelves_to_read(shelves: list[tuple[int, float, int]], limit: int, page) -> list[int]:
    """Shelves that can hold a row of the page, told by the page of the first few."""
    taken, held, at = [], 0, 0
    while at < len(shelves):
        # Each turn reads at least twice as much as the one before.
        goal = max(4 * limit, 2 * held)
        while at < len(shelves) and held < goal:
            taken.append(shelves[at][0])
            held += shelves[at][2]
            at += 1
        # One number: the last score of the page, if there is a whole one.
        last = page(taken).agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("r")).first()
        if last["n"] >= limit:
            return taken + [s for s, most, _ in shelves[at:] if most >= -last["r"] - 1e-9]
    return taken


def _moved_back(places: Column, by: int) -> Column:
    return F.transform(places, lambda place: place - by) if by else places


def stored_search(
    path: str,
    posts: DataFrame,
    must: list[Term] = (),
    should: list[Term] = (),
    must_not: list[Term] = (),
    order: str = "rank",
    limit: int = 50,
    offset: int = 0,
    shelves: list[int] | None = None,
    **filters,
) -> DataFrame:
    """As ``text_search``, from the index of these posts that ``write_index`` left under ``path``.

    Only the postings of the terms are read; texts are read for no post but those that match. A post has one row per
    word in the shuffle, whatever its length. ``shelves`` leaves all posts of other shelves out (see ``top_search``); the
    frequencies of single words then come from the bounds, as their postings are not all read.
    """
    if order not in _ORDER:
        raise ValueError(f"Invalid order: {order!r}. Must be one of {sorted(_ORDER)}")
    scored, every = [*must, *should], [*must, *should, *must_not]
    if not scored:
        raise ValueError("a search needs at least one term to match")
    spark = posts.sparkSession
    slots = {}
    for i, term in enumerate(every):
        words = _words(term)
        for j, word in enumerate(words):
            test = F.col("term").startswith(word) if term.prefix and j == len(words) - 1 else F.col("term") == word
            slots[i, j] = test & (F.col("field") == term.column) if term.column else test
    wanted = F.lit(False)
    for test in slots.values():
        wanted = wanted | test
    rows = spark.read.parquet(f"{path}/postings").where(wanted)
    if shelves is not None:
        rows = rows.where(F.col("shelf").isin(shelves))
    found = rows.groupBy("id", "n_tokens").agg(
        *[F.flatten(F.collect_list(F.when(test, F.col("places")))).alias(f"p{i}_{j}") for (i, j), test in slots.items()],
        F.count(F.lit(1)).alias("_rows"),
    )

    def frequency(i: int) -> Column:
        size = len(_words(every[i]))
        if not size:
            return F.lit(0)
        starts = [_moved_back(F.col(f"p{i}_{j}"), j) for j in range(size)]
        return F.size(reduce(F.array_intersect, starts))

    counted = found.select("id", "n_tokens", *[frequency(i).alias(f"f{i}") for i in range(len(every))])
    if shelves is None:
        dfs = counted.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"df{i}") for i in range(len(scored))])
    else:
        bounds = spark.read.parquet(f"{path}/bounds")
        same = [(F.col("term") == _words(t)[0]) & F.col("field").eqNullSafe(F.lit(t.column)) for t in scored]
        asked = F.col("term").isin([_words(t)[0] for t in scored])
        dfs = bounds.where(asked).agg(*[F.coalesce(F.sum(F.when(test, F.col("posts"))), F.lit(0)).alias(f"df{i}") for i, test in enumerate(same)])
    totals = spark.read.parquet(f"{path}/totals").agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
    test = F.lit(True)
    for i in range(len(must)):
        test = test & (F.col(f"f{i}") > 0)
    if should and not must:
        test = test & (F.greatest(F.lit(0), *[F.col(f"f{i}") for i in range(len(should))]) > 0)
    for i in range(len(scored), len(every)):
        test = test & (F.col(f"f{i}") == 0)
    hits = counted.where(test).withColumns(
        {"_s": dfs.select(F.struct("*")).scalar(), "_t": totals.select(F.struct("*")).scalar()}
    )
    docs = F.col("_t.docs")
    rank = F.lit(0.0)
    for i in range(len(scored)):
        df, tf = F.col("_s")[f"df{i}"].cast("double"), F.col(f"f{i}").cast("double")
        rank = rank - _gain(_idf(docs, df), tf, F.col("n_tokens"), F.col("_t.tokens") / docs)
    ranked = hits.select("id", "n_tokens", rank.alias("rank"))
    page = filter_posts(posts, **filters).join(ranked, "id").orderBy(*_ORDER[order](), "id")
    return (page.offset(offset) if offset else page).limit(limit)


def query_words(query: Column) -> Column:
    """Words of free query texts with cashtags opened, as a column."""
    return tokens(normalize_cashtags(query))
