"""Benchmark passages in texts, also with other numbers, names and units.

Texts and benchmark items are brought to one template form: white space runs to single spaces,
numbers, capitalised words inside a sentence and units after a number to typed placeholders, the
rest to lower case without punctuation. Windows of template words are joined by equality. What the
placeholders stand for must then fit: along one alignment of an item and a text, equal values of the
item must have equal values in the text. Windows that touch a value for which they do not are left
out, the others count. All of it is SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidegauge import session

WINDOW = 8
MIN_LITERALS = 4
MIN_SHARE = 0.3
MIN_RUN = 13  # windows in a row: 20 words
BROADCAST_WINDOWS = 1 << 18
BROADCAST_DOCS = 1 << 16

# Units of measure and money that may follow a number.
UNITS = ("mm cm dm m km in ft yd mi mg g kg t lb oz ml cl dl l s sec min h hr ms us ns "
         "hz khz mhz ghz b kb mb gb tb w kw mw v a ma c f k pa bar j kj cal kcal mph kmh "
         "meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet "
         "inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter "
         "liters litre litres second seconds minute minutes hour hours day days week weeks month "
         "months year years percent dollar dollars euro euros cent cents degree degrees").split()

# Java's and DuckDB's regexes read these the same way.
_LEAD = r"""[("'\[$€£+-]*"""
_TAIL = r"""[)"'\].,;:!?]*"""
NUMBER = rf"{_LEAD}[0-9][0-9.,:/]*%?{_TAIL}"
NUMBER_UNIT = rf"{_LEAD}[0-9][0-9.,]*({'|'.join(UNITS)}){_TAIL}"
UNIT = rf"({'|'.join(UNITS)}){_TAIL}"
NAME_REST = rf"""[\p{{Ll}}'-]+{_TAIL}"""
NAME = rf"\p{{Lu}}{NAME_REST}"
INSIDE = r"[\p{L}\p{N},;'%]"  # the last character of a word after which a sentence goes on
MARKS = r"[^\p{L}\p{N}<> ]+"


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x20]+", " "))


def _template(spaced: Column) -> Column:
    """One template word for each word between single spaces."""
    marked = F.contains(spaced, F.lit("<")) | F.contains(spaced, F.lit(">"))
    plain = F.when(marked, F.regexp_replace(spaced, r"[<>]", "")).otherwise(spaced)
    # The capital is looked for first, what stands before it only then.
    named = F.regexp_replace(plain, rf"\p{{Lu}}(?<={INSIDE} .){NAME_REST}(?= |$)", "<name>")
    numbered = F.regexp_replace(named, rf"(?<= |^){NUMBER_UNIT}(?= |$)", "<measure>")
    numbered = F.regexp_replace(numbered, rf"(?<= |^){NUMBER}(?= |$)", "<number>")
    numbered = F.regexp_replace(numbered, rf"(?i)(?<=<number> ){UNIT}(?= |$)", "<unit>")
    out = F.when(F.rlike(spaced, F.lit("[0-9]")), numbered).otherwise(named)
    return F.regexp_replace(F.lower(out), MARKS, "")


def values(window: Column) -> Column:
    """The words of a window as their values are compared: lower case without punctuation."""
    return F.split(F.regexp_replace(F.lower(window), r"[^\p{L}\p{N} ]+", ""), " ", -1)


def spelled(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, a hash of the text, its template words ``t`` and its words ``w``, place by place."""
    spaced = texts.select(F.col(key), F.xxhash64(text).alias("content"), _spaced(F.col(text)).alias("s"))
    return spaced.select(key, "content", F.split(_template(F.col("s")), " ", -1).alias("t"),
                         F.split("s", " ", -1).alias("w"))


def _windows(size: int) -> Column:
    """How many windows the words ``t`` have; a shorter text is one window."""
    return F.greatest(F.size("t") - (size - 1), F.lit(1))


def _with_neighbour(hashes: Column, others: Column, distance: int) -> Column:
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(others, i + distance)))


def window_hashes(words: DataFrame, keys: list[str], size: int = WINDOW,
                  shorter: tuple[int, ...] = ()) -> DataFrame:
    """``keys, size, place, hash``: a 64-bit hash of every window of ``size`` template words.

    Hashes of windows twice as long come from those of two neighbours, so a window costs a few steps
    whatever its size. Each doubling is a column of its own, computed once; windows of the sizes in
    ``shorter`` are made of the same columns.
    """
    sizes = (size, *shorter)
    level = words.select(*keys, *[_windows(s).alias(f"n{s}") for s in sizes],
                         F.transform("t", lambda t: F.xxhash64(t)).alias("p0"))
    bits = range(size.bit_length())
    for k in bits[1:]:
        half = F.col(f"p{k - 1}")
        level = level.withColumn(f"p{k}", _with_neighbour(half, half, 1 << (k - 1)))

    def hashes(s: int) -> Column:
        first, *rest = sorted((k for k in bits if s >> k & 1), reverse=True)
        whole, at = F.col(f"p{first}"), 1 << first
        for k in rest:
            whole = _with_neighbour(whole, F.col(f"p{k}"), at)
            at += 1 << k
        return F.slice(whole, F.lit(1), F.col(f"n{s}"))

    if not shorter:
        return level.select(*keys, F.lit(size).alias("size"), F.posexplode(hashes(size)).alias(
            "place", "hash")).withColumn("place", F.col("place") + 1)

    def marked(s: int) -> Column:
        return F.transform(hashes(s), lambda h, i: F.struct(
            F.lit(s).alias("size"), (i + 1).alias("place"), h.alias("hash")))

    return level.select(*keys, F.explode(F.concat(*map(marked, sizes))).alias("x")).select(
        *keys, "x.*")


def windows_at(words: DataFrame, keys: list[str], places: Column, size: int | None = WINDOW) -> DataFrame:
    """``keys, place, template, words`` of the windows at the given places; without a size the places
    are pairs of a place and a size."""
    def window(p: Column) -> Column:
        at, n = (p["place"], p["size"]) if size is None else (p, F.lit(size))
        return F.struct(at.cast("int").alias("place"),
                        F.array_join(F.slice("t", at, n), " ").alias("template"),
                        F.array_join(F.slice("w", at, n), " ").alias("words"))

    return words.select(*keys, F.explode(F.transform(places, window)).alias("x")).select(
        *keys, "x.*")


def literals(template: Column) -> Column:
    """Words of a template that are no placeholder and not empty."""
    return F.size(F.filter(F.split(template, " ", -1),
                           lambda w: (w != "") & ~F.startswith(w, F.lit("<"))))


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW,
            min_literals: int = MIN_LITERALS, min_share: float = MIN_SHARE,
            min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id, item_id, n_windows, n_matched, share, longest_run, n_values, n_changed`` of
    contaminated texts.

    A document holds an item if at least ``min_share`` of the item's windows (those with enough
    literal words) are found in it with consistent values, or ``min_run`` windows in a row;
    ``n_values`` counts the different values of the item that are consistent along an alignment,
    ``n_changed`` those that the document has otherwise. Documents
    that hold none give no row. NULL and empty texts hold nothing; an item without a usable window is
    never found; an item shorter than a window is one window of its own length; repeated rows of a document or an item count once; NULL ids are ids; empty tables
    give no rows. Columns besides doc_id, item_id and text are not read.
    """
    items = spelled(benchmark.select("item_id", "text"), "item_id", "text")
    at = ["item_id", "content"]
    # A shorter item is one window of all its words, looked for at every place of a document.
    short = tuple(sorted(r.n for r in items.select(F.size("t").alias("n")).filter(
        F.col("n") < size).distinct().collect() if r.n >= max(min_literals, 1)))
    own_size = F.least(F.size(F.split("template", " ", -1)), F.lit(size))
    asked = windows_at(items, at, F.sequence(F.lit(1), _windows(size)), size).withColumn(
        "size", own_size).join(
        window_hashes(items, at, size, short).withColumnRenamed("item_id", "same_id"),
        ["content", "place", "size"])
    asked = (asked.filter(F.col("item_id").eqNullSafe(F.col("same_id"))
                          & (literals(F.col("template")) >= min_literals))
             .select("item_id", F.col("place").alias("item_place"), "size", "template",
                     F.col("words").alias("item_words"), "hash").distinct())
    totals = asked.groupBy("item_id").agg(F.countDistinct("item_place").alias("n_windows"))
    # Beyond the bound the same join shuffles both sides by hash.
    small = asked.count() <= BROADCAST_WINDOWS
    here = spelled(docs.select("doc_id", "text"), "doc_id", "text")
    folder = session.scratch(docs.sparkSession, "template-hits")
    (window_hashes(here, ["doc_id", "content"], size, short)
     .join(F.broadcast(asked) if small else asked, ["hash", "size"])
     .withColumn("shift", F.col("place") - F.col("item_place")).write.parquet(folder))
    hits = docs.sparkSession.read.parquet(folder)
    aligned = ["doc_id", "item_id", "shift"]
    words = F.filter(
        F.arrays_zip(F.split("template", " ", -1).alias("t"), values(F.col("item_words")).alias("a"),
                     values(F.col("words")).alias("b")),
        lambda w: F.startswith(w["t"], F.lit("<")))
    # Per alignment: which places matched, and each value of the item with the text's values for it.
    slots = (_with_words(docs, hits.filter(F.contains(F.col("template"), F.lit("<")))).select(*aligned, F.explode(words).alias("w"))
             .groupBy(*aligned, "w.t", "w.a")
             .agg(F.min("w.b").alias("low"), F.max("w.b").alias("high")))
    folder = session.scratch(docs.sparkSession, "template-slots")
    slots.groupBy(*aligned).agg(
        F.collect_set(F.when(F.col("low") != F.col("high"), F.struct("t", "a"))).alias("torn"),
        F.count_if(F.col("low") == F.col("high")).alias("n_values"),
        F.count_if((F.col("low") == F.col("high")) & (F.col("low") != F.col("a"))).alias("n_changed")
    ).write.parquet(folder)
    slots = docs.sparkSession.read.parquet(folder)
    # An item has a bounded number of values, so a list of those that are torn is short.
    own = F.arrays_zip(F.split("template", " ", -1).alias("t"), values(F.col("item_words")).alias("a"))
    fits = hits.select(*aligned, "item_place", own.alias("own")).distinct().join(
        slots.select(*[F.col(c).alias(f"s_{c}") for c in aligned], "torn", "n_values", "n_changed"),
        F.col("doc_id").eqNullSafe(F.col("s_doc_id"))
        & F.col("item_id").eqNullSafe(F.col("s_item_id"))
        & F.col("shift").eqNullSafe(F.col("s_shift")), "left")
    fits = fits.filter(~F.coalesce(F.arrays_overlap("own", "torn"), F.lit(False)))
    # Places of an alignment that follow each other: as many rows as the item has windows.
    place = F.row_number().over(Window.partitionBy(*aligned).orderBy("item_place"))
    runs = (fits.select(*aligned, "item_place").distinct()
            .withColumn("run", F.col("item_place") - place).groupBy("doc_id", "item_id", "shift", "run")
            .count().groupBy("doc_id", "item_id").agg(F.max("count").alias("longest_run"))
            .withColumnsRenamed({"doc_id": "r_doc_id", "item_id": "r_item_id"}))
    found = (fits.groupBy("doc_id", "item_id")
             .agg(F.countDistinct("item_place").alias("n_matched"),
                  F.max(F.coalesce("n_values", F.lit(0))).alias("n_values"),
                  F.max(F.coalesce("n_changed", F.lit(0))).alias("n_changed"))
             .join(runs, F.col("doc_id").eqNullSafe(F.col("r_doc_id"))
                   & F.col("item_id").eqNullSafe(F.col("r_item_id"))))
    totals = totals.withColumnRenamed("item_id", "t_item_id")
    return (found.join(totals, F.col("item_id").eqNullSafe(F.col("t_item_id")))
            .filter((F.col("n_matched") >= min_share * F.col("n_windows"))
                    | (F.col("longest_run") >= min_run))
            .select("doc_id", "item_id", "n_windows", "n_matched",
                    (F.col("n_matched") / F.col("n_windows")).alias("share"), "longest_run",
                    "n_values", "n_changed"))


def _with_words(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits of windows with placeholders, with the ``words`` the documents have there."""
    found = hits.groupBy(F.col("doc_id").alias("at_id"), F.col("content").alias("at_content")).agg(
        F.collect_set(F.struct("place", "size")).alias("places"))
    folder = session.scratch(docs.sparkSession, "template-places")
    found.write.parquet(folder)
    found = docs.sparkSession.read.parquet(folder)
    if found.count() <= BROADCAST_DOCS:
        found = F.broadcast(found)
    texts = docs.select("doc_id", "text").join(
        found, F.col("doc_id").eqNullSafe(F.col("at_id"))
        & (F.xxhash64("text") == F.col("at_content"))).select("doc_id", "text", "places")
    places = texts.select("doc_id", "places", F.xxhash64("text").alias("content"),
                          _spaced(F.col("text")).alias("s")).select(
        F.col("doc_id").alias("at_id"), F.col("content").alias("at_content"), "places",
        F.split(_template(F.col("s")), " ", -1).alias("t"), F.split("s", " ", -1).alias("w"))
    words = windows_at(places, ["at_id", "at_content"], F.col("places"), None).select(
        "at_id", "at_content", F.col("place").alias("at_place"),
        F.col("template").alias("at_template"), "words").distinct()
    return hits.join(words, F.col("doc_id").eqNullSafe(F.col("at_id"))
                     & (F.col("content") == F.col("at_content"))
                     & (F.col("place") == F.col("at_place"))
                     & (F.col("template") == F.col("at_template")))


def _windows_sql(table: str, key: str, size: int) -> str:
    """The same windows, made word by word instead of by one regex over the text."""
    def full(pattern: str) -> str:
        return "'^(" + pattern.replace("'", "''") + ")$'"

    inside = "'" + INSIDE.replace("'", "''") + "$'"
    clean = "regexp_replace({}, '[<>]', '', 'g')"
    return f"""
{table}_words AS (
  SELECT {key}, string_split(trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x20]+', ' ', 'g')), ' ')
         AS raw FROM {table}
  WHERE trim(regexp_replace(coalesce(text, ''), '[\\x00-\\x20]+', ' ', 'g')) <> ''),
{table}_kinds AS (
  SELECT {key}, raw, [CASE
      WHEN i > 1 AND regexp_matches({clean.format('raw[i - 1]')}, {inside})
           AND regexp_matches({clean.format('raw[i]')}, {full(NAME)}) THEN '<name>'
      WHEN regexp_matches({clean.format('raw[i]')}, {full(NUMBER_UNIT)}) THEN '<measure>'
      WHEN regexp_matches({clean.format('raw[i]')}, {full(NUMBER)}) THEN '<number>'
      ELSE {clean.format('raw[i]')} END FOR i IN range(1, len(raw) + 1)] AS k FROM {table}_words),
{table}_template AS (
  SELECT {key},
    [CASE WHEN i > 1 AND k[i - 1] = '<number>' AND regexp_matches(lower(k[i]), {full(UNIT)})
     THEN '<unit>' ELSE regexp_replace(lower(k[i]), '{MARKS}', '', 'g') END
     FOR i IN range(1, len(k) + 1)] AS t,
    [regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}} ]+', '', 'g') FOR x IN raw] AS v
  FROM {table}_kinds),
{table}_windows AS (
  SELECT {key}, i AS place, array_to_string(t[i:i + {size - 1}], ' ') AS template,
         t[i:i + {size - 1}] AS ts, v[i:i + {size - 1}] AS vs
  FROM {table}_template, unnest(range(1, greatest(len(t) - {size - 1}, 1) + 1)) AS u(i))"""


def matches_sql(size: int = WINDOW, min_literals: int = MIN_LITERALS,
                min_share: float = MIN_SHARE, min_run: int = MIN_RUN) -> str:
    return f"""
WITH {_windows_sql('benchmark', 'item_id', size)}, {_windows_sql('documents', 'doc_id', size)},
asked AS (
  SELECT DISTINCT * FROM benchmark_windows
  WHERE len([x FOR x IN ts IF x <> '' AND NOT starts_with(x, '<')]) >= {min_literals}),
totals AS (SELECT item_id, count(DISTINCT place) AS n_windows FROM asked GROUP BY item_id),
hits AS (
  SELECT doc_id, item_id, a.place AS item_place, d.place - a.place AS shift, a.ts,
         a.vs AS item_values, d.vs AS doc_values
  FROM documents_windows d JOIN asked a USING (template)),
pairs AS (
  SELECT doc_id, item_id, shift, ts[i] AS t, item_values[i] AS a, doc_values[i] AS b
  FROM hits, unnest(range(1, len(ts) + 1)) AS u(i) WHERE starts_with(ts[i], '<')),
by_value AS (
  SELECT doc_id, item_id, shift, t, a, count(DISTINCT b) AS n, count_if(a <> b) > 0 AS changed
  FROM pairs GROUP BY ALL),
slots AS (
  SELECT doc_id, item_id, shift, list(t || ' ' || a) FILTER (n > 1) AS torn,
         count(*) FILTER (n = 1) AS n_values, count(*) FILTER (n = 1 AND changed) AS n_changed
  FROM by_value GROUP BY ALL),
fits AS (
  SELECT h.doc_id, h.item_id, h.shift, item_place, n_values, n_changed
  FROM hits h LEFT JOIN slots s
    ON h.doc_id IS NOT DISTINCT FROM s.doc_id AND h.item_id IS NOT DISTINCT FROM s.item_id
       AND h.shift = s.shift
  WHERE NOT coalesce(list_has_any(
    [ts[i] || ' ' || item_values[i] FOR i IN range(1, len(ts) + 1)], torn), false)),
runs AS (
  SELECT doc_id, item_id, max(n) AS longest_run FROM (
    SELECT doc_id, item_id, shift, run, count(*) AS n FROM (
      SELECT *, item_place - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY item_place)
             AS run FROM (SELECT DISTINCT doc_id, item_id, shift, item_place FROM fits))
    GROUP BY ALL) GROUP BY doc_id, item_id),
found AS (
  SELECT doc_id, item_id, count(DISTINCT item_place) AS n_matched,
         CAST(max(coalesce(n_values, 0)) AS BIGINT) AS n_values,
         CAST(max(coalesce(n_changed, 0)) AS BIGINT) AS n_changed
  FROM fits GROUP BY doc_id, item_id)
SELECT f.doc_id, f.item_id, n_windows, n_matched, n_matched / n_windows AS share, longest_run, n_values,
       n_changed
FROM found f JOIN totals ON f.item_id IS NOT DISTINCT FROM totals.item_id
JOIN runs r ON f.doc_id IS NOT DISTINCT FROM r.doc_id AND f.item_id IS NOT DISTINCT FROM r.item_id
WHERE n_matched >= {min_share} * n_windows OR longest_run >= {min_run}"""
