"""Benchmark decontamination by templates, in DataFrame expressions only.

Numbers, names and units become typed placeholders, so a question that was copied with other numbers
or people keeps its template. Windows of five template words are hashed and joined with those of the
benchmark. The shift between the two that most windows agree on tells where the item would lie; a
document holds the item if it has at least 0.8 of the item's windows within a few words of that shift
and its slots can be mapped both ways: nearly every value that fills a slot of the item stands for one
value in the document, and nearly every such value of the document for one of the item.

* name: a run of capitalised words that follows a small letter, comma or semicolon and a space;
* number: digits, with points or commas between them;
* unit: a unit's word or sign after a number.

All else is lower case without punctuation. The characters U+E001 to U+E003 stand for placeholders.

A second, wide template takes every run of capitalised words as a name, also at the start of a sentence
or line and after a colon, bracket, quote or number, with any white space between words. It decides the
pairs whose plain templates do not agree well enough; its windows of placeholders alone are not counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, need, stage, table

WINDOW, COVERAGE, CONSISTENCY = 5, 0.8, 0.8
DRIFT = 5  # words by which parts of a held item may be displaced
BROADCAST_ROWS = 1_000_000  # windows of the benchmark that are broadcast at most (16 bytes each)
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
NAME_PATTERN = r"([\p{Ll},;] )(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*)"
NUMBER_PATTERN = r"[0-9]+(?:[.,][0-9]+)*"
# The unit words.
UNITS = (
    "percent|kilometers?|kilometres?|km|meters?|metres?|m|centimeters?|centimetres?|cm|millimeters?|millimetres?|mm|miles?|mi|"
    "feet|foot|ft|inches|inch|yards?|yd|kilograms?|kg|grams?|g|milligrams?|mg|tons?|tonnes?|pounds?|lbs?|ounces?|oz|liters?|litres?|l|"
    "milliliters?|millilitres?|ml|gallons?|hours?|hrs?|h|minutes?|mins?|min|seconds?|secs?|s|days?|weeks?|months?|years?|"
    "dollars?|usd|euros?|eur|cents?|mph|kph"
)
UNIT_PATTERN = NUMBER + r" *(%|(?i:" + UNITS + r"))([^\p{L}\p{N}]|$)"
SPACE = r"[\s\p{Z}]"
WIDE_NAME_PATTERN = r"(?<![\p{L}\p{M}\p{N}])\p{Lu}[\p{L}\p{M}]*(?:" + SPACE + r"+\p{Lu}[\p{L}\p{M}]*)*"
WIDE_UNIT_PATTERN = NUMBER + SPACE + r"*(%|(?i:" + UNITS + r"))([^\p{L}\p{N}]|$)"
PLAIN, WIDE = 0, 1
JUNK_PATTERN = "[^\\p{L}\\p{M}\\p{N}" + NAME + NUMBER + UNIT + "]+"


def iterative(pattern: str) -> str:
    """The pattern with its last repeated group possessive: a run of any length is matched in a loop.

    Nothing follows the group, so it matches the same. The greedy form recurses once a repeat, and
    a run of some thousand words or numbers would end the executor by a stack overflow.
    """
    head, _, tail = pattern.rpartition(")*")
    return f"{head})*+{tail}"


NAMES, NUMBERS, WIDE_NAMES = map(iterative, (NAME_PATTERN, NUMBER_PATTERN, WIDE_NAME_PATTERN))


def canonical(text: Column) -> Column:
    """Template words of a text, joined by one space."""
    named = F.regexp_replace(text, NAMES, f"$1{NAME}")
    numbered = F.regexp_replace(named, NUMBERS, f" {NUMBER} ")
    measured = F.regexp_replace(numbered, UNIT_PATTERN, f"{NUMBER} {UNIT} $2")
    return F.trim(F.regexp_replace(F.lower(measured), JUNK_PATTERN, " "))


def _wide_measured(text: Column) -> Column:
    """Numbers and units first, so that the unit of ``5 Kg`` is no name."""
    return F.regexp_replace(F.regexp_replace(text, NUMBERS, f" {NUMBER} "), WIDE_UNIT_PATTERN, f"{NUMBER} {UNIT} $2")


def wide_canonical(text: Column) -> Column:
    """Words of the wide template of a text, joined by one space."""
    named = F.regexp_replace(_wide_measured(text), WIDE_NAMES, NAME)
    return F.trim(F.regexp_replace(F.lower(named), JUNK_PATTERN, " "))


def template_words(text: Column, mode: int = PLAIN) -> Column:
    """Template words; a text without any gives one empty word."""
    return F.split(canonical(text) if mode == PLAIN else wide_canonical(text), " ")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """One hash per window; of fewer words one hash of all of them, which no window of full size has; null without words."""

    def windows(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        few = F.array(F.xxhash64(F.lit("short"), F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        return F.when(F.size(h) >= window, many).when(F.get(h, F.lit(0)) != F.xxhash64(F.lit("")), few)

    return once(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _placed(rows: DataFrame, key: str, words: Column, values: dict[str, Column]) -> DataFrame:
    """key, place, type and value: the k-th placeholder of a type has the k-th of the type's values."""

    def of_type(numbered: Column, t: str, found: Column) -> Column:
        zipped = F.arrays_zip(F.filter(numbered, lambda x: x["type"] == t), found)
        return F.transform(zipped, lambda x: F.struct(x["0"]["place"].alias("place"), F.lit(t).alias("type"), x["1"].alias("value")))

    def slots(w: Column) -> Column:
        numbered = F.transform(w, lambda x, i: F.struct(i.alias("place"), x.alias("type")))
        return F.concat(*[of_type(numbered, t, found) for t, found in values.items()])

    return rows.select(key, F.inline(once(words, slots))).where("place is not null")


def _slots(rows: DataFrame, key: str) -> DataFrame:
    """Placeholders of few texts with their values: key, place, type, value."""
    text = F.col("text")
    named = F.regexp_replace(text, NAMES, f"$1{NAME}")
    numbered = F.regexp_replace(named, NUMBERS, f" {NUMBER} ")
    return _placed(rows, key, template_words(text), {
        NAME: F.regexp_extract_all(text, F.lit(NAMES), F.lit(2)),
        NUMBER: F.regexp_extract_all(named, F.lit(f"({NUMBERS})"), F.lit(1)),
        UNIT: F.transform(F.regexp_extract_all(numbered, F.lit(UNIT_PATTERN), F.lit(1)), lambda x: F.lower(x)),
    })


def _wide_slots(rows: DataFrame, key: str) -> DataFrame:
    """``_slots`` of the wide template; a name's value is its last word, marked if it stands alone where a sentence may start."""
    text = F.col("text")

    def value(run: Column) -> Column:
        last = F.regexp_extract(run, r"\p{Lu}[\p{L}\p{M}]*$", 0)
        return F.when(run == last, F.concat(F.lit(NAME), last)).otherwise(last)

    numbered = F.regexp_replace(text, NUMBERS, f" {NUMBER} ")
    # with the small letter, comma or semicolon before it a run is not its last word, so only lone initial words are marked
    runs = F.regexp_extract_all(_wide_measured(text), F.lit(r"(?:[\p{Ll},;]" + SPACE + "+)?" + WIDE_NAMES), F.lit(0))
    return _placed(rows, key, template_words(text, WIDE), {
        NAME: F.transform(runs, value),
        NUMBER: F.regexp_extract_all(text, F.lit(f"({NUMBERS})"), F.lit(1)),
        UNIT: F.transform(F.regexp_extract_all(numbered, F.lit(WIDE_UNIT_PATTERN), F.lit(1)), lambda x: F.lower(x)),
    })


def _slots_of_both(rows: DataFrame, key: str) -> DataFrame:
    return _slots(rows, key).withColumn("mode", F.lit(PLAIN)).unionByName(_wide_slots(rows, key).withColumn("mode", F.lit(WIDE)))


def _wide_windows(items: DataFrame, window: int) -> DataFrame:
    """Windows of the items' wide templates that hold a word, not only placeholders; hashes are inverted to be met by wide windows alone."""
    split_items = items.select("item_id", template_words(F.col("text"), WIDE).alias("words")).where("words[0] <> ''")
    hashed = split_items.select("item_id", "words", window_hashes(F.col("words"), window).alias("windows"))
    at = F.transform("windows", lambda h, i: F.struct(i.alias("q"), F.bitwise_not(h).alias("hash"), F.slice("words", i + 1, window).alias("words")))
    told = hashed.select("item_id", F.filter(at, lambda x: F.exists(x["words"], lambda w: ~w.isin(NAME, NUMBER, UNIT))).alias("windows"))
    return told.select("item_id", F.size("windows").alias("n_windows"), F.inline(F.transform("windows", lambda x: F.struct(x["q"].alias("q"), x["hash"].alias("hash")))), F.lit(WIDE).alias("mode"))


def _keyed(rows: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``key`` (id and hash of the text, so that null ids meet too and texts of one id stay apart) and ``text``."""
    return rows.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("of")).alias(key), F.col(text_col).alias("text"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY, drift: int = DRIFT,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, each once.

    Columns: ``doc_id``, ``item_id``, ``n_windows`` (of the item), ``n_matched`` (those met within
    ``drift`` words of the shift that most agree on; of equally good shifts the largest) and
    ``n_slots`` (aligned slots). An item with slots of which no one is aligned is not held. Texts
    may be of any length, in runs of names or numbers of any length too. Null, empty and wordless texts hold nothing and are held by nothing; an item
    of fewer than ``window`` words is held by documents that consist of its template alone. Rows
    that repeat an id, null too, are compared one by one, and of a pair's results that with most
    windows is given; other columns are ignored. An item's first word may
    stand for a name too, since a document can hold it within a sentence. Pairs whose plain
    templates have too few windows in common are compared by their wide templates, whose counts
    are given then; there a lone initial word that is the same in both fills no slot.
    """
    need(docs, [id_col, text_col])
    need(benchmark, [item_col, item_text_col])
    items = _keyed(benchmark, item_col, item_text_col, "item_id").where("text is not null").distinct()
    words = F.col("words")
    named_first = F.concat(F.array(F.lit(NAME)), F.slice(words, 2, window - 1))
    split_items = items.select("item_id", template_words(F.col("text")).alias("words")).where("words[0] <> ''")
    hashed = split_items.select("item_id", window_hashes(words, window).alias("windows"), F.when(F.size(words) >= window, F.get(window_hashes(named_first, window), F.lit(0))).alias("first"))
    at = hashed.select("item_id", F.size("windows").alias("n_windows"), F.posexplode("windows").alias("q", "hash"))
    also = hashed.where("first is not null").select("item_id", F.size("windows").alias("n_windows"), F.lit(0).alias("q"), F.col("first").alias("hash"))
    plain = at.unionByName(also).withColumn("mode", F.lit(PLAIN))
    bench = stage(plain.unionByName(_wide_windows(items, window)).distinct(), "windows", files=few(docs.sparkSession))
    if bench.count() <= BROADCAST_ROWS:
        probe = F.broadcast(bench)
    else:
        probe = bench  # joined by a shuffle of both sides
    source = _keyed(docs, id_col, text_col, "doc_id")
    # "outer" keeps the planner from computing the windows once more to filter out texts without any; the join drops those
    wide = F.transform(window_hashes(template_words(F.col("text"), WIDE), window), lambda h: F.bitwise_not(h))
    both = source.select("doc_id", F.explode_outer(F.array(window_hashes(template_words(F.col("text")), window), wide)).alias("windows"))
    windows = both.select("doc_id", F.posexplode_outer("windows").alias("p", "hash"))
    shift = (F.col("p") - F.col("q")).alias("shift")
    hits = windows.join(probe, "hash").groupBy("doc_id", "item_id", "mode", "n_windows", shift).agg(F.collect_set("q").alias("qs"))
    # at one shift a window of the item occurs once, so a list has n_windows places at most
    pair = Window.partitionBy("doc_id", "item_id", "mode")
    best = F.max(F.struct(F.size("qs"), "shift")).over(pair)["shift"]
    near = hits.withColumn("best", best).where(F.abs(F.col("shift") - F.col("best")) <= drift)
    at_place = near.select("doc_id", "item_id", "mode", "n_windows", "best", "shift", F.explode("qs").alias("q"))
    nearest = F.min(F.struct(F.abs(F.col("shift") - F.col("best")), "shift"))
    matched = at_place.groupBy("doc_id", "item_id", "mode", "n_windows", "q").agg(nearest["shift"].alias("shift"))
    counted = matched.withColumn("n_matched", F.count("q").over(pair)).where(F.col("n_matched") >= F.lit(coverage) * F.col("n_windows"))
    held_windows = stage(counted.withColumn("least", F.min("mode").over(Window.partitionBy("doc_id", "item_id"))).where("mode = least").drop("least"), "held", files=few(docs.sparkSession))
    close = held_windows.select("doc_id", "item_id", "mode", "n_windows", "n_matched").distinct()

    # the slots of a window that is met are aligned by that window's shift
    held = source.join(held_windows.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    mine = _slots_of_both(held, "doc_id").select("doc_id", "mode", F.col("place").alias("p"), F.col("type").alias("t"), F.col("value").alias("doc_value"))
    theirs = _slots_of_both(items, "item_id").select("item_id", "mode", "place", F.col("type").alias("t"), F.col("value").alias("item_value"))
    places = held_windows.select("doc_id", "item_id", "mode", "shift", F.explode(F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda k: F.col("q") + k)).alias("place"))
    aligned = places.groupBy("doc_id", "item_id", "mode", "place").agg(F.max("shift").alias("shift")).join(theirs, ["item_id", "mode", "place"])
    met = aligned.withColumn("p", F.col("place") + F.col("shift")).join(mine, ["doc_id", "mode", "p", "t"])
    same_initial = (F.col("mode") == WIDE) & F.col("item_value").startswith(NAME) & (F.col("item_value") == F.col("doc_value"))
    met = met.withColumn("free", F.coalesce(same_initial, F.lit(False))).withColumns({c: F.ltrim(F.col(c), F.lit(NAME)) for c in ("item_value", "doc_value")})
    filled = met.groupBy("doc_id", "item_id", "t", "item_value", "doc_value", "free").agg(F.count("p").alias("n"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("of_item"), F.col("item_value").alias("value")), F.struct(F.lit(False).alias("of_item"), F.col("doc_value").alias("value"))))
    agreed = filled.select("doc_id", "item_id", "t", "n", "free", sides.alias("side")).groupBy("doc_id", "item_id", "t", "side").agg(
        F.coalesce(F.max(F.when(~F.col("free"), F.col("n"))), F.lit(0)).alias("best"), F.coalesce(F.sum(F.when(~F.col("free"), F.col("n"))), F.lit(0)).alias("n")
    )
    of_item, of_doc = F.col("side.of_item"), ~F.col("side.of_item")
    slots = agreed.groupBy("doc_id", "item_id").agg(F.sum(F.when(of_item, F.col("best"))).alias("there"), F.sum(F.when(of_doc, F.col("best"))).alias("back"), F.sum(F.when(of_item, F.col("n"))).alias("n_slots"))
    slotted = theirs.select("item_id", "mode", F.lit(True).alias("has_slots")).distinct()
    consistent = F.least("there", "back") >= F.lit(consistency) * F.col("n_slots")
    good = close.join(slots, ["doc_id", "item_id"], "left").join(slotted, ["item_id", "mode"], "left").where(F.coalesce(consistent, F.col("has_slots").isNull()))
    names = ("n_matched", "n_windows", "n_slots")
    told = F.struct(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])
    pairs = good.groupBy(F.col("doc_id.id").alias("doc_id"), F.col("item_id.id").alias("item_id")).agg(F.max(told).alias("told"))
    return pairs.select("doc_id", "item_id", *[F.col(f"told.{c}").alias(c) for c in ("n_windows", "n_matched", "n_slots")])



def op8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and the benchmark item that it holds as a template."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_words(text: str) -> str:
    named = f"regexp_replace({text}, '{NAME_PATTERN}', '\\1{NAME}', 'g')"
    numbered = f"regexp_replace({named}, '{NUMBER_PATTERN}', ' {NUMBER} ', 'g')"
    measured = f"regexp_replace({numbered}, '{UNIT_PATTERN}', '{NUMBER} {UNIT} \\2', 'g')"
    return f"string_split(nullif(trim(regexp_replace(lower({measured}), '{JUNK_PATTERN}', ' ', 'g')), ''), ' ')"


def _sql_slots(rows: str, key: str) -> str:
    named = f"regexp_replace(text, '{NAME_PATTERN}', '\\1{NAME}', 'g')"
    numbered = f"regexp_replace({named}, '{NUMBER_PATTERN}', ' {NUMBER} ', 'g')"
    return f"""
      SELECT {key}, place, type, CASE type WHEN '{NAME}' THEN names[k] WHEN '{NUMBER}' THEN numbers[k] ELSE lower(units[k]) END AS value
      FROM (SELECT *, row_number() OVER (PARTITION BY {key}, type ORDER BY place) AS k
            FROM (SELECT {key}, regexp_extract_all(text, '{NAME_PATTERN}', 2) AS names, regexp_extract_all({named}, '{NUMBER_PATTERN}') AS numbers,
                         regexp_extract_all({numbered}, '{UNIT_PATTERN}', 1) AS units, unnest(w) AS type, unnest(range(len(w))) AS place
                  FROM (SELECT {key}, text, {_sql_words("text")} AS w FROM {rows}))
            WHERE type IN ('{NAME}', '{NUMBER}', '{UNIT}'))"""


#: DuckDB SQL for the rows of ``contaminated`` with its default arguments that the plain templates give; windows are compared as text.
#: Pairs that only the wide templates find are not in it.
ORACLE_SQL = f"""
WITH items AS (SELECT item_id, text, {_sql_words("text")} AS w FROM benchmark WHERE text IS NOT NULL),
docs AS (SELECT doc_id, text, {_sql_words("text")} AS w FROM documents WHERE text IS NOT NULL),
bench AS (
  SELECT DISTINCT * FROM (
    SELECT item_id, greatest(len(w) - {WINDOW - 1}, 1) AS n_windows, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS q,
           unnest(CASE WHEN len(w) >= {WINDOW} THEN list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) ELSE ['short ' || array_to_string(w, ' ')] END) AS win
    FROM items WHERE w IS NOT NULL
    UNION ALL
    SELECT item_id, len(w) - {WINDOW - 1}, 0, '{NAME} ' || array_to_string(w[2:{WINDOW}], ' ') FROM items WHERE len(w) >= {WINDOW})),
wins AS (
  SELECT doc_id, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS p,
         unnest(CASE WHEN len(w) >= {WINDOW} THEN list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' ')) ELSE ['short ' || array_to_string(w, ' ')] END) AS win
  FROM docs WHERE w IS NOT NULL),
hits AS (SELECT DISTINCT doc_id, item_id, n_windows, q, p - q AS shift FROM wins JOIN bench USING (win)),
best AS (SELECT doc_id, item_id, n_windows, max(struct_pack(n := n, shift := shift)).shift AS best FROM (SELECT doc_id, item_id, n_windows, shift, count(*) AS n FROM hits GROUP BY ALL) GROUP BY ALL),
matched AS (
  SELECT doc_id, item_id, n_windows, q, min(struct_pack(d := abs(shift - best), shift := shift)).shift AS shift
  FROM hits JOIN best USING (doc_id, item_id, n_windows) WHERE abs(shift - best) <= {DRIFT} GROUP BY ALL),
pairs AS (SELECT doc_id, item_id, n_windows, count(*) AS n_matched FROM matched GROUP BY ALL HAVING count(*) >= {COVERAGE} * n_windows),
aligned AS (SELECT doc_id, item_id, q + k AS place, max(shift) AS shift FROM matched JOIN pairs USING (doc_id, item_id, n_windows) CROSS JOIN range({WINDOW}) t(k) GROUP BY ALL),
held AS (SELECT doc_id, min(text) AS text FROM docs WHERE doc_id IN (SELECT doc_id FROM pairs) GROUP BY doc_id),
mine AS ({_sql_slots("held", "doc_id")}),
theirs AS ({_sql_slots("items", "item_id")}),
filled AS (
  SELECT aligned.doc_id, aligned.item_id, mine.type AS t, theirs.value AS item_value, mine.value AS doc_value, count(*) AS n
  FROM aligned JOIN theirs USING (item_id, place) JOIN mine ON mine.doc_id = aligned.doc_id AND mine.place = aligned.place + aligned.shift AND mine.type = theirs.type GROUP BY ALL),
there AS (SELECT doc_id, item_id, sum(best) AS there, sum(n) AS n_slots FROM (SELECT doc_id, item_id, t, item_value, max(n) AS best, sum(n) AS n FROM filled GROUP BY ALL) GROUP BY ALL),
back AS (SELECT doc_id, item_id, sum(best) AS back FROM (SELECT doc_id, item_id, t, doc_value, max(n) AS best FROM filled GROUP BY ALL) GROUP BY ALL)
SELECT pairs.doc_id, pairs.item_id, n_windows::BIGINT AS n_windows, n_matched::BIGINT AS n_matched, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM pairs LEFT JOIN there USING (doc_id, item_id) LEFT JOIN back USING (doc_id, item_id)
WHERE coalesce(least(there, back) >= {CONSISTENCY} * n_slots, item_id NOT IN (SELECT item_id FROM theirs))
"""
