"""Matching posts against registries: positions, catalysts, known themes and tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import constants as C
from tidewire.functions.text import let, or_blank
from tidewire.operators.skew import BROADCAST_ROWS, SPREAD, counted_broadcast, lookup, materialize, union_all

# Labels are found by their first characters, at most this many.
SEED = 4
# 64-bit words of the table that tells which hashed seeds a calendar has.
SLOT_WORDS = 1024


def _format_match(instrument: Column, theme: Column) -> Column:
    relation = F.nullif(F.replace(or_blank(instrument["relationship"]), F.lit("_"), F.lit(" ")), F.lit(""))
    details = F.concat_ws(", ", relation, theme)
    return F.concat(
        F.upper(instrument["ticker"]), F.when(details != "", F.concat(F.lit(" ("), details, F.lit(")"))).otherwise("")
    )


def match_positions(posts: DataFrame, instruments: DataFrame, themes: DataFrame) -> DataFrame:
    """One position per post: an exact ticker first (registry order), else the first open theme shared with one.

    Registry rows are first reduced to one per ticker and per theme, so neither join can multiply rows.
    """
    held = instruments.where(
        F.col("relationship").isin(C.POSITION_RELATIONSHIPS) & (or_blank(F.col("ticker")) != "")
    ).select("pos", F.struct("ticker", "relationship", "themes").alias("instrument"))
    first = F.min_by("instrument", "pos").alias("instrument")
    by_ticker = held.groupBy(F.upper("instrument.ticker").alias("key")).agg(first, F.min("pos").alias("pos"))
    by_theme = (
        held.select("pos", "instrument", F.explode("instrument.themes").alias("key"))
        .join(themes.where(~F.coalesce(F.col("status") == "closed", F.lit(False))).select(F.col("id").alias("key")),
              "key", "left_semi")
        .groupBy("key").agg(first)
    )
    named = lambda sign, key: F.concat(F.lit(sign), key)
    registry = materialize(
        by_ticker.select(named("$", F.col("key")).alias("key"), "instrument", F.col("pos").cast("long").alias("place")).unionByName(
            by_theme.select(named("#", F.col("key")).alias("key"), "instrument", F.lit(None).cast("long").alias("place"))
        )
    )
    # Tickers and themes of a post are looked up together: posts are read once while the registry is small.
    tickers = F.transform(F.array_distinct(F.transform("tickers", F.upper)), lambda t: F.struct(named("$", t).alias("key"), F.lit(None).cast("long").alias("at")))
    own = F.transform("themes", lambda t, i: F.struct(named("#", t).alias("key"), i.cast("long").alias("at")))
    empty = F.array().cast("array<struct<key:string,at:bigint>>")
    keys = posts.select("id", "themes", F.explode(F.concat(F.coalesce(tickers, empty), F.coalesce(own, empty))).alias("k")).select(
        "id", "themes", "k.*")
    rows = registry.count()
    found = keys.join(counted_broadcast(registry, rows), "key") if rows <= BROADCAST_ROWS else lookup(keys, registry, "key", "inner")
    is_ticker = F.col("key").startswith("$")
    shared = F.get(F.filter("themes", lambda t: F.array_contains(F.col("instrument.themes"), t)), F.lit(0))
    match = F.when(is_ticker, _format_match(F.col("instrument"), shared)).otherwise(
        _format_match(F.col("instrument"), F.substr(F.col("key"), F.lit(2))))
    ranked = found.select("id", F.when(is_ticker, 0).otherwise(1).alias("rank"), F.coalesce("place", "at").alias("place"), match.alias("match"))
    best = F.min_by("match", F.struct("rank", "place", "match")).alias("position")
    return ranked.groupBy("id").agg(best)


_CATALYST = ["ref", "date", "type"]


def _rows(dims: DataFrame) -> DataFrame:
    """Distinct registry rows as ``c``, which also holds how often each one stands there (``c.rows``)."""
    others = [c for c in dims.columns if c not in _CATALYST]
    counted = dims.groupBy(*dims.columns).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.struct(*_CATALYST, *others, "rows").alias("c"), *others)


def _only(prefix: str) -> Column:
    """The sole candidate: smallest and largest are the same registry row, which stands there once."""
    low, high = F.col(f"{prefix}_low"), F.col(f"{prefix}_high")
    return F.when(low.eqNullSafe(high) & (low["rows"] == 1), low)


def _named(chosen: DataFrame) -> DataFrame:
    fields = [F.col(f"m.{f}").alias(f"catalyst_{f}") for f in _CATALYST]
    return chosen.where(F.col("m").isNotNull()).select("id", *fields)


def match_resolved_catalyst(posts: DataFrame, catalysts: DataFrame) -> DataFrame:
    """Resolved posts -> the one catalyst row sharing a ticker, or, if no ticker matches, the one sharing a theme.

    Two registry rows with the same reference are two candidates, so neither is chosen.
    """
    dims = _rows(
        catalysts.where(or_blank(F.col("id")) != "")
        .select(F.col("id").alias("ref"), "date", "type", "instruments", "themes")
    )
    resolved = posts.where(F.col("catalyst_status") == "resolved")

    def side(column: str, dim_column: str, prefix: str) -> DataFrame:
        # Candidates per key shrink to their smallest and largest before the join.
        per_key = dims.select(F.explode(dim_column).alias("key"), "c").groupBy("key").agg(
            F.min("c").alias("low"), F.max("c").alias("high")
        )
        keys = resolved.select("id", F.explode(F.array_distinct(column)).alias("key"))
        return lookup(keys, per_key, "key", "inner").groupBy("id").agg(
            F.min("low").alias(f"{prefix}_low"), F.max("high").alias(f"{prefix}_high")
        )

    both = side("tickers", "instruments", "ticker").join(side("themes", "themes", "theme"), "id", "full")
    chosen = F.when(F.col("ticker_low").isNotNull(), _only("ticker")).otherwise(_only("theme"))
    return _named(both.select("id", chosen.alias("m")))


def _slot(seed: Column) -> Column:
    return F.pmod(F.xxhash64(seed), F.lit(64 * SLOT_WORDS)).cast("int")


def _seed_patterns(seeds: DataFrame) -> DataFrame:
    """One array of (n, pattern): the places where a seed of ``n`` characters may stand, to the longest label's length.

    A pattern holds one class of characters for each place of a seed, so its size is that of the alphabet.
    """

    def characters(at: int) -> Column:
        quoted = F.transform(
            F.array_sort(F.collect_set(F.substring("seed", at, 1))),
            lambda c: F.regexp_replace(c, r"([^\p{L}\p{N}])", r"\\$1"),
        )
        return F.when(F.size(quoted) > 0, F.concat(F.lit("["), F.array_join(quoted, ""), F.lit("]"))).otherwise("")

    by_size = seeds.groupBy(F.length("seed").alias("n")).agg(
        F.max(F.length("label")).alias("longest"),
        *[F.when(F.first(F.length("seed")) >= at, characters(at)).otherwise("").alias(f"c{at}") for at in range(1, SEED + 1)],
    )
    classes = F.concat(*[f"c{at}" for at in range(1, SEED + 1)])
    rest = F.concat(F.lit(".{0,"), F.col("longest") - F.col("n"), F.lit("}"))
    pattern = F.concat(F.lit("(?s)(?=("), classes, rest, F.lit("))"))
    return by_size.agg(F.collect_list(F.struct("n", pattern.alias("pattern"))))


def match_labelled_catalyst(posts: DataFrame, catalysts: DataFrame) -> DataFrame:
    """Posts that are not resolved -> the one calendar row whose label occurs in summary or content.

    Each place of a text whose first ``SEED`` characters (fewer for shorter labels) may start a label is looked up by
    them, together with as many characters as the longest label has; the label is compared there, so texts do not move.
    ``May start`` means: each character is one that some seed has there, and the hashed seed has its bit in a table of
    fixed size. Both spare rows and decide nothing; they serve calendars of any size.
    """
    ref = F.concat_ws(":", "type", "scope", F.col("date").cast("string"))
    dims = _rows(catalysts.select(ref.alias("ref"), "date", "type", F.upper("label").alias("label")).where("label <> ''"))
    per_label = dims.groupBy("label").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    seeds = per_label.select(F.substring("label", 1, SEED).alias("seed"), "label")
    slot = _slot(F.col("seed"))
    words = seeds.select((slot / 64).cast("int").alias("w"), F.expr("1L").alias("one"), (slot % 64).alias("b")).groupBy("w").agg(
        F.bit_or(F.call_function("shiftleft", "one", "b")).alias("bits")
    )
    table = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(SLOT_WORDS - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0)))
    ).scalar()
    patterns = _seed_patterns(seeds).scalar()
    haystack = F.upper(F.concat(or_blank(F.col("summary")), F.lit(" "), or_blank(F.col("content"))))
    rows = posts.where(~F.coalesce(F.col("catalyst_status") == "resolved", F.lit(False)))
    sized = rows.select("id", haystack.alias("hay"), table.alias("t"), F.explode(patterns).alias("p")).select("*", "p.n")

    def may_start(piece: Column) -> Column:
        return let(
            _slot(F.substring(piece, F.lit(1), F.col("n"))),
            lambda at: F.getbit(F.get("t", F.floor(at / 64).cast("int")), at % 64) == 1,
        )

    pieces = F.array_distinct(F.filter(F.regexp_extract_all("hay", F.col("p.pattern"), F.lit(1)), may_start))
    # Outer, as a plain explode would add a filter that cuts the texts a second time.
    cut = sized.select("id", "n", F.explode_outer(pieces).alias("piece")).where("piece IS NOT NULL").select(
        "id", "piece", F.substring("piece", F.lit(1), F.col("n")).alias("seed"),
        F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int").alias("salt"),
    )
    # A seed in every text would be one task: all seeds are copied to each salt, which spares counting the texts' pieces.
    copies = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    starts = cut.join(copies, ["seed", "salt"]).where(F.startswith("piece", F.col("label")))
    found = lookup(starts.select("id", "label").distinct(), per_label, "label", "inner").groupBy("id").agg(
        F.min("low").alias("l_low"), F.max("high").alias("l_high")
    )
    return _named(found.select("id", _only("l").alias("m")))


def match_catalysts(posts: DataFrame, catalysts: DataFrame, calendar: DataFrame) -> DataFrame:
    return union_all([match_resolved_catalyst(posts, catalysts), match_labelled_catalyst(posts, calendar)])


def _keep_known(rows: DataFrame, column: str, dim: DataFrame, dim_column: str) -> DataFrame:
    """Elements of an array column that the registry knows, in their order."""
    flat = rows.select("id", F.posexplode(column).alias("pos", "key"))
    kept = (
        lookup(flat, dim.select(F.col(dim_column).alias("key")).distinct(), "key", "inner")
        .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "key"))).alias("kept"))
    )
    empty = F.array().cast("array<string>")
    return rows.drop(column).join(kept, "id", "left").withColumn(
        column, F.coalesce(F.transform("kept", lambda k: k["key"]), empty)
    ).drop("kept")


def registry_validate(posts: DataFrame, themes: DataFrame, instruments: DataFrame) -> DataFrame:
    """Well-formed, distinct themes and upper-cased tickers that the registries know."""
    shaped = posts.select(
        "id",
        F.array_distinct(F.filter("themes", lambda t: t.rlike(C.THEME_PATTERN))).alias("themes"),
        F.array_distinct(F.filter(F.transform("tickers", F.upper), lambda t: t.rlike(C.TICKER_PATTERN))).alias("instruments"),
    )
    shaped = _keep_known(shaped, "themes", themes, "id")
    tickers = instruments.select(F.upper("ticker").alias("ticker"))
    return _keep_known(shaped, "instruments", tickers, "ticker")
