"""Benchmark decontamination: a prefix-filtered set join, all in DataFrame operations.

A window is 13 consecutive words of an item (a shorter item is one window), and a document holds
it if the same words stand in a row. Both sides are sets of shingles of three consecutive words
(of one or two where a window is shorter). A held window shares all of its shingles with the
document, so in any common order its first one is a prefix that suffices: shingles are ordered by
how often the documents have them, rarest first. The steps:

1. One pass over the documents gives the number of words and the places of all shingles that the
   benchmark has too, stored without the text.
2. Shingle counts over all documents give each window its prefix, its rarest shingle.
3. Places of prefixes join the windows on the shingle. Positional bound: the window must begin at
   or after the first word. Length bound: it must end at or before the last.
4. Candidates meet their documents' words again, and a window counts if all words are equal.

Rows of documents are told apart by id and text, so repeated rows each get the same answer.
A null id is an id like any other. Null and empty texts have no words; they hold no window and aren't contaminated. Items without
words have no window. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import broadcast_small, stored

WINDOW = 13
SHINGLE = 3
NOT_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
SMALL_ROWS = 500_000  # wanted tokens of so many (some 10 MB) are broadcast, more meet a bitmap first
BITS = 1 << 25  # of the bitmap
_LAST = -7046029254386353131  # stands after a document's shingles, so that each document has a row
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words in lower case; null has none."""
    body = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(body, NOT_WORDS), "")


def _hashes(words: Column, size: int) -> Column:
    """Hash of the `size` words from each place on. Runs cut short by the end hash what they have:
    they may match a shorter token, which step 4 tells apart."""
    return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, size))))


def _meet(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """As join(), but a null meets a null; the columns are those of `left`."""
    right = right.withColumnsRenamed({c: f"_{c}" for c in columns})
    same = F.lit(True)
    for c in columns:
        same = same & left[c].eqNullSafe(right[f"_{c}"])
    return left.join(right, same, how).drop(*(f"_{c}" for c in columns))


def windows_of(benchmark: DataFrame, id: str, text: str) -> DataFrame:
    """(item, start, words) of each window; start is its place in the item."""
    items = benchmark.select(F.col(id).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)))
    return items.select("item", F.explode_outer(starts).alias("start"), "w").select("item", "start", F.slice("w", F.col("start") + 1, WINDOW).alias("words"))


def _tokens(windows: DataFrame) -> DataFrame:
    """(window, length, at, token, arity): the shingles of each distinct window."""
    arity = F.least(F.size("words"), F.lit(SHINGLE))
    out = None
    for k in range(1, SHINGLE + 1):
        hashes = F.slice(_hashes(F.col("words"), k), 1, F.greatest(F.size("words") - k + 1, F.lit(1)))
        some = windows.where(arity == k).select("window", F.size("words").alias("length"), F.posexplode_outer(hashes).alias("at", "token"), F.lit(k).alias("arity"))
        out = some if out is None else out.unionByName(some)
    return out


def _maybe(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose token may be wanted, by a bitmap of fixed size: where the wanted tokens are too
    many for a broadcast, hardly more than theirs are shuffled."""
    bit = F.pmod(F.col("token"), F.lit(BITS))
    cells = wanted.groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(token, {BITS}) % 64 as int))")).alias("bits"))
    every = wanted.sparkSession.range(BITS // 64).withColumnRenamed("id", "cell").join(cells, "cell", "left")
    sorted_ = F.array_sort(F.collect_list(F.struct("cell", F.coalesce("bits", F.lit(0)).alias("bits"))))
    one = every.agg(F.transform(sorted_, lambda x: x["bits"]).alias("_bits"))  # 4 MB
    held = F.expr(f"shiftright(_bits[cast(shiftright(pmod(token, {BITS}), 6) as int)], cast(pmod(token, {BITS}) % 64 as int)) & 1") == 1
    return placed.crossJoin(F.broadcast(one)).where(held).drop("_bits")


def occurrences(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(id, row, n_words, at, token) of each token at each place of each document, and one row
    with token _LAST for each document. `docs` has (id, text)."""
    sizes = sorted(r[0] for r in tokens.select("arity").distinct().collect()) or [SHINGLE]
    body = docs.select("id", F.xxhash64("text").alias("row"), words_of(F.col("text")).alias("w"))
    arrays = [piece for k in sizes for piece in (_hashes(F.col("w"), k), F.array(F.lit(_LAST)))][:-1]
    last = F.array(F.lit(_LAST))
    hashed = body.select("id", "row", F.size("w").alias("n_words"), F.concat(*arrays, last).alias("h"))
    # outer: for a plain explode the optimizer would test the array's size at the scan, computing it anew there
    placed = hashed.select("id", "row", "n_words", F.posexplode_outer("h").alias("pos", "token"))
    wanted = tokens.select("token").union(tokens.sparkSession.range(1).select(F.lit(_LAST))).distinct()
    found = (placed if wanted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else _maybe(placed, wanted)).join(broadcast_small(wanted, SMALL_ROWS), "token")
    lead = F.col("n_words") + 1
    return found.where((F.col("token") != _LAST) | (F.col("pos") == lead * len(sizes) - 1)).select("id", "row", "n_words", (F.col("pos") % lead).alias("at"), "token")


def held_windows(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, held, items): (id, row, n_words) of every row of docs; (id, row, spans) of those
    that hold a window, spans an array of (start, length, window); (window, item) of the benchmark."""
    docs = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    placed = stored(windows_of(benchmark, item, item_text).withColumn("window", F.xxhash64("words")), "windows")
    windows = placed.dropDuplicates(["window"]).select("window", "words")
    tokens = stored(_tokens(windows), "window-tokens")
    found = stored(occurrences(docs, tokens), "shingles")
    counts = found.where(F.col("token") != _LAST).groupBy("token").count()
    rarity = F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token", "at", "length")
    prefix = tokens.join(counts, "token", "left").groupBy("window").agg(F.min(rarity).alias("p")).select("window", "p.token", "p.length", F.col("p.at").alias("offset"))
    start = F.col("at") - F.col("offset")
    bounds = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    candidates = found.join(broadcast_small(prefix), "token").where(bounds).select("id", "row", "window", start.alias("start")).distinct()
    listed = candidates.join(windows, "window").groupBy("id", "row").agg(F.collect_list(F.struct("start", F.size("words").alias("length"), "window", "words")).alias("c"))
    listed = stored(listed, "candidates")
    rows = _meet(docs, broadcast_small(listed.select("id").distinct()), ["id"], "left_semi").withColumn("row", F.xxhash64("text"))
    rows = _meet(rows, listed, ["id", "row"], "inner").select("id", "row", "c", words_of(F.col("text")).alias("w")).dropDuplicates(["id", "row"])
    same = F.filter("c", lambda x: F.slice(F.col("w"), x["start"] + 1, x["length"]) == x["words"])
    held = rows.select("id", "row", F.transform(same, lambda x: F.struct(x["start"], x["length"], x["window"])).alias("spans")).where(F.size("spans") > 0)
    return found.where(F.col("token") == _LAST).select("id", "row", "n_words"), stored(held, "held"), placed.select("window", "item").distinct()


def judge(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, row, n_words, n_hit, items, contaminated) of every row of docs; items are sorted as
    strings; `row` is the hash of the text."""
    every, held, items = held_windows(docs, benchmark, id, text, item, item_text)
    covered = F.flatten(F.transform("spans", lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1)))
    hit = held.select("id", "row", F.size(F.array_distinct(covered)).alias("n_hit"))
    names = held.select("id", "row", F.explode("spans.window").alias("window")).distinct().join(broadcast_small(items), "window")
    names = names.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    out = _meet(every, _meet(hit, names, ["id", "row"], "inner"), ["id", "row"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = out.select("id", "row", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).withColumnRenamed("id", id)


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    judged = judge(docs, benchmark)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that aren't contaminated, with all their columns as they are."""
    judged = judge(docs, benchmark, id, text).where("contaminated")
    bad = broadcast_small(judged.select(F.col(id).alias("_bad_id"), F.col("row").alias("_bad_row")).distinct())
    return docs.join(bad, docs[id].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text]) == bad["_bad_row"]), "left_anti")


#: DuckDB SQL of `digest`.
SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT item_id, len(x) AS n, array_to_string(x, ' ') AS x FROM (
    SELECT item_id, list_slice(w, s, s + 12) AS x FROM (
      SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS x FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM w, sizes WHERE len(w) >= n)),
held AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN win ON dw.x = win.x AND dw.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM held) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM held) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w.w) AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""
