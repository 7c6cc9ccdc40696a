"""Benchmark decontamination on template windows, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simgraph.llm.state import cut, prepare

#: Words of a window, and the share of an item's windows that a text must hold.
WINDOW, SHARE = 5, 0.8
#: Bytes of the items' windows, and of the places of hits, that are broadcast at most; more are joined by a shuffle.
BROADCAST = 1 << 25
#: A word or number, with the sentence end before it if there is one.
TOKEN = r"(?:[.!?\n][^\p{L}\p{N}]*)?(?:\p{N}[\p{N}.,]*|\p{L}[\p{L}\p{M}'-]*)"
#: Units that a number may have (fixed values).
UNITS = ["mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "min", "h", "ms", "hz", "w", "kw", "v", "a", "pa", "n", "j", "inch", "inches", "foot", "feet", "mile", "miles", "meter", "meters", "metre", "metres", "gram", "grams", "pound", "pounds", "liter", "liters", "litre", "litres", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent"]


def _template(tokens: Column) -> Column:
    """Each token as lower case, or as a typed placeholder: 0 a number, U its unit, N a name (a capital and a small letter, inside a sentence)."""

    def one(x: Column, i: Column) -> Column:
        c = F.substring(x, 1, 1)
        bare = F.regexp_replace(F.lower(x), r"^[.!?\n][^\p{L}\p{N}]*", "")
        digit = (c >= "0") & (c <= "9")
        before = F.substring(F.get(tokens, i - 1), -1, 1)
        counted = (before >= "0") & (before <= "9") & F.lower(x).isin(UNITS)
        return (
            F.when(digit, F.lit("0"))
            .when(c.isin(".", "!", "?", "\n"), F.when(F.substring(bare, 1, 1).between("0", "9"), F.lit("0")).otherwise(bare))
            .when((i > 0) & counted, F.lit("U"))
            .when((i > 0) & (c != F.lower(c)) & (F.substring(x, 2, 1) != F.upper(F.substring(x, 2, 1))), F.lit("N"))
            .otherwise(F.lower(x))
        )

    return F.transform(tokens, one)


def _windows(words: Column, hashes: Column) -> Column:
    """Hashes of all runs of WINDOW template words, whose own hashes are ``hashes``; of the whole where there are fewer; none without words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, runs).when(F.size(words) > 0, F.array(F.xxhash64(F.lit("short"), F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def _templated(df: DataFrame, key: str, text: str) -> DataFrame:
    rows = df.select(F.col(key).alias("_key"), _tokens(text).alias("_raw"))
    return rows.withColumn("_words", _template(F.col("_raw"))).withColumn("_hashes", F.transform("_words", lambda x: F.xxhash64(x)))


def _bare(token: Column) -> Column:
    """A token without the sentence end before it and the punctuation after a number."""
    return F.regexp_replace(F.lower(token), r"^[.!?\n][^\p{L}\p{N}]*|[.,]+$", "")


def _named(text: str) -> Column:
    """128 bits of a hash of the text, by which texts are told apart; null reads as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))


def _held(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, item_col: str) -> DataFrame:
    """(_key, _item, _n, _need): texts, by ``_named``, and the items of whose windows they hold SHARE at least.

    The first scan makes a hash for each window and meets the items' hashes;
    only texts with a hit are read again, and only their windows' own tokens
    are carried to the slots' comparison.
    """
    prepare(docs.sparkSession)
    texts = docs.select(_named(text).alias("_key"), F.col(text).alias("_text"))
    items = _templated(benchmark.where(F.col(item_text).isNotNull()), item_col, item_text).withColumnRenamed("_key", "_item")
    items = items.select("_item", "_raw", "_words", F.posexplode(_windows(F.col("_words"), F.col("_hashes"))).alias("_q", "_h"))
    slots = F.filter(F.transform(F.sequence(F.lit(0), F.lit(WINDOW - 1)), lambda j: F.when(F.get("_words", F.col("_q") + j).isin("0", "N", "U"), F.struct(j.alias("j"), _bare(F.get("_raw", F.col("_q") + j)).alias("v")))), lambda s: s.isNotNull())
    items = cut(items.select("_item", "_q", "_h", slots.alias("_slots")))
    need = items.groupBy("_item").agg(F.count(F.lit(1)).alias("_need"))
    size = F.lit(64) + F.aggregate("_slots", F.lit(0), lambda n, s: n + 32 + F.octet_length(s.v))
    few = (items.agg(F.sum(size)).first()[0] or 0) <= BROADCAST
    small = F.broadcast if few else lambda df: df
    rows = _templated(texts, "_key", "_text").select("_key", F.posexplode(_windows(F.col("_words"), F.col("_hashes"))).alias("_p", "_h"))
    places = rows.join(small(items.select("_h").distinct()), "_h", "left_semi").groupBy("_key").agg(F.collect_set(F.struct("_p", "_h")).alias("_places"))
    places = cut(places)
    if 96 * places.count() + 32 * (places.agg(F.sum(F.size("_places"))).first()[0] or 0) <= BROADCAST:
        places = F.broadcast(places)
    again = texts.join(places, "_key").select("_key", _tokens("_text").alias("_raw"), "_places")
    rows = again.select("_key", F.explode(F.transform("_places", lambda x: F.struct(x._p.alias("p"), x._h.alias("h"), F.slice("_raw", x._p + 1, WINDOW).alias("raw")))).alias("w"))
    rows = rows.select("_key", F.col("w.p").alias("_p"), F.col("w.h").alias("_h"), F.col("w.raw").alias("_raw"))
    hits = rows.join(small(items), "_h").select(
        "_key", "_item", "_q", (F.col("_p") - F.col("_q")).alias("_diag"),
        F.transform("_slots", lambda s: F.struct(s.v.alias("v"), _bare(F.get("_raw", s.j)).alias("w"))).alias("_pairs"),
    )
    lines = hits.groupBy("_key", "_item", "_diag").agg(F.collect_set("_q").alias("_qs"), F.array_distinct(F.flatten(F.collect_set("_pairs"))).alias("_pairs"))
    lines = lines.where(F.size("_pairs") == F.size(F.array_distinct(F.transform("_pairs", lambda p: p.v))))
    found = lines.select("_key", "_item", F.explode("_qs").alias("_q")).groupBy("_key", "_item").agg(F.countDistinct("_q").alias("_n"))
    return found.join(need, "_item").where(F.col("_n") >= SHARE * F.col("_need"))


def contaminated_by(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id") -> DataFrame:
    """Rows (``id_col``, ``item_col``, share) of texts and the benchmark items that they hold.

    Texts and items become templates; an item is held if SHARE of its windows
    of WINDOW template words are in the text with consistent slots: along
    one offset between item and text, equal values in the item's placeholders
    meet equal values in the text. A new value for each of the item's values,
    as in a re-parameterised question, is consistent. Nulls and texts without
    words hold nothing; texts of fewer words are one window. Each row is judged
    by its own text, whatever its id; other columns are left out.
    """
    held = _held(docs, benchmark, text, item_text, item_col).select("_key", F.col("_item").alias(item_col), (F.col("_n") / F.col("_need")).alias("share"))
    rows = docs.select(F.col(id_col).alias("_id"), _named(text).alias("_key"))
    return rows.join(held, "_key").select(F.col("_id").alias(id_col), item_col, "share")


def judge(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", item_text: str = "text", item_col: str = "item_id") -> DataFrame:
    """``id_col``, contaminated, ``item_col`` (the item held with the largest share, the smallest of those) and n_items of every row.

    Each row is judged by its own text; equal texts have one verdict. Other columns are left out.
    """
    held = _held(docs, benchmark, text, item_text, item_col)
    best = held.groupBy("_key").agg(F.countDistinct("_item").alias("n_items"), F.min(F.struct((-F.col("_n") / F.col("_need")).alias("s"), F.col("_item").alias("item"))).alias("best"))
    rows = docs.select(F.col(id_col).alias("_id"), _named(text).alias("_key")).join(best, "_key", "left")
    return rows.select(F.col("_id").alias(id_col), F.col("n_items").isNotNull().alias("contaminated"), F.col("best.item").alias(item_col), (-F.col("best.s")).alias("share"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose texts hold no benchmark item."""
    gone = _held(docs, benchmark, text, "text", "item_id").select(F.col("_key").alias("_gone")).distinct()
    return docs.join(gone, _named(text) == F.col("_gone"), "left_anti")
