"""Benchmark decontamination: SimHash windows of an item's size, found by a multi-index over Hamming blocks and then compared exactly.

All column expressions.  A window whose similarity to an item of ``N`` shingles is at least ``s`` has ``ceil(s N)`` of them, so it has
one of any ``N - ceil(s N) + 1``; the rarest are the item's anchors.  All shingles of an item are looked up around its anchors only, and a
window is laid at every start whose words hold as many of them as the similarity needs, in whatever order they stand there.  Windows
without an anchor or with fewer shingles cannot be similar enough, so this spares their fingerprints and loses none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracesieve.session import written

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of windows and items that many bits apart are candidates; 3.2 standard deviations above what similarity 0.8 leads one to expect.
RADIUS = 19
#: Bits of the blocks, which make up 64: of two fingerprints within ``RADIUS``, one block differs in at most ``RADIUS // 5`` bits.
BLOCKS = (13, 13, 13, 13, 12)
#: Starts whose windows share one running count, at most; the window's own shingles come on top.
RUN = 16384
#: The most anchors that are broadcast (about 40 bytes each); more are joined by a shuffle, with the same result.
BROADCAST_ANCHORS = 1_000_000
#: The most items whose multi-index is broadcast (1890 rows, about 0.3 MB, for each); that of more is joined by a shuffle.
BROADCAST_ITEMS = 400


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: str, k: str) -> str:
    """SQL for the shingles of ``k`` words; fewer words are one shingle."""
    return f"transform(sequence(1, greatest(1, size({words}) - {k} + 1)), i -> slice({words}, i, {k}))"


def _simhash(hashes: str) -> Column:
    """The bits that are set in over half the hashes, repeats counted."""
    ones = f"aggregate({hashes}, 0, (n, h) -> n + cast(shiftright(h, b) & 1L as int))"
    return F.expr(f"aggregate(transform(sequence(0, 63), b -> if(2 * {ones} > size({hashes}), shiftleft(1L, b), 0L)), 0L, (a, x) -> a | x)")


def _numbered(words: str, k: str) -> Column:
    """Sorted shingles, each followed by how many equal ones stand before it, so that sets of them are multisets of shingles.  Words have no spaces."""
    ordered = f"array_sort(transform({_shingles(words, k)}, s -> array_join(s, ' ')))"
    return F.expr(f"flatten(transform(array({ordered}), z -> transform(z, (s, n) -> concat(s, ' ', n + 1 - array_position(z, s)))))")


def _prints(rows: DataFrame) -> DataFrame:
    """Add the fingerprint ``fp`` of ``words`` in shingles of ``k``."""
    hashed = rows.withColumn("hashes", F.expr(f"transform({_shingles('words', 'k')}, s -> xxhash64(s))"))
    return hashed.withColumn("fp", _simhash("hashes")).drop("hashes")


def _block(fp: str, b: int) -> Column:
    low = sum(BLOCKS[:b])
    return F.expr(f"shiftrightunsigned({fp}, {low}) & {(1 << BLOCKS[b]) - 1}L")


def items_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The benchmark's different texts: ``item`` (the least id), ``words``, ``n`` of them, shingle length ``k`` and ``fp``.

    Items without words are left out; repeated ones, and those that differ in case or punctuation only, are one.
    """
    read = benchmark.select(F.col(item_id).cast("long").alias("item"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    one = read.groupBy("words").agg(F.min("item").alias("item"))
    return _prints(one.withColumn("n", F.size("words")).withColumn("k", F.least(F.lit(SHINGLE), F.size("words"))))


def _anchors(items: DataFrame, similarity: float) -> DataFrame:
    """Each item's rarest shingles, as many as no window that is similar enough can lack: ``h, k, item, n``."""
    spread = items.select("item", "n", "k", F.posexplode(F.expr(f"transform({_shingles('words', 'k')}, s -> xxhash64(s))")).alias("at", "h"))
    common = spread.groupBy("h", "k").agg(F.count_distinct("item").alias("df"))
    ranked = spread.join(common, ["h", "k"]).groupBy("item", "n", "k").agg(F.array_sort(F.collect_list(F.struct("df", "at", "h"))).alias("all"))
    size = F.col("n") - F.col("k") + 1
    most = size - F.ceil(size * F.lit(similarity) - 1e-9) + 1
    kept = ranked.select("item", "n", "k", F.explode(F.slice("all", F.lit(1), most.cast("int"))).alias("a"))
    return kept.select(F.col("a.h").alias("h"), "k", "item", "n").distinct()


def _around(read: DataFrame, index: DataFrame, ks: list[int]) -> DataFrame:
    """Cells of ``n`` positions of a text in which a window that holds an anchor of ``k`` words can have shingles: ``_row, item, n, k, cell``.

    One scan for all ``k``, and every step of it is compiled: a place's words are hashed where they stand in the text's array.
    """
    # A plain explode would have its input tested for emptiness, and so split, once more before it.
    places = read.select("_row", F.size("words").alias("long"), "words", F.posexplode_outer("words").alias("pos", "word"))
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.xxhash64(*[F.get("words", F.col("pos") + i) for i in range(k)]).alias("h")) for k in ks])
    spread = places.where(F.col("pos") <= F.col("long") - min(ks)).select("_row", "long", "pos", F.inline(each) if len(ks) > 1 else F.lit(ks[0]).alias("k"), *([] if len(ks) > 1 else [F.element_at(each, 1)["h"].alias("h")]))
    cells = F.expr("sequence(cast(greatest(0, pos - n + k) div n as int), cast(greatest(0, least(pos + n, long) - k) div n as int))")
    return spread.where(F.col("pos") <= F.col("long") - F.col("k")).join(index, ["k", "h"]).select("_row", "item", "n", "k", F.explode(cells).alias("cell"))


def _starts(found: DataFrame, similarity: float) -> DataFrame:
    """Starts of all windows that hold enough of the item's shingles, which stand at ``at`` (ascending): ``_row, n, k, start``.

    Windows of ``N`` and ``M`` shingles of similarity ``s`` share ``s (N + M) / (1 + s)`` at least.  Of the starts whose first shingle of the
    item is the one at ``at[i]``, those reach the ``need`` shingles that end no earlier than ``at[i + need - 1]``.
    """
    sized = found.withColumn("need", F.ceil((F.col("n") + F.least("long", "n") - 2 * F.col("k") + 2) * F.lit(similarity / (1 + similarity)) - 1e-9).cast("int")).where("need > 0 and size(at) >= need")
    low = "greatest(0, at[i + need - 1] - n + k, if(i > 0, at[greatest(i, 1) - 1] + 1, 0))"
    ranges = f"transform(sequence(0, greatest(0, size(at) - need)), i -> struct({low} as low, least(at[i], greatest(0, long - n)) as high))"
    starts = f"flatten(transform(filter({ranges}, r -> r.low <= r.high), r -> sequence(r.low, r.high)))"
    return sized.select("_row", "n", "k", F.explode(F.expr(starts)).alias("start"))


def _lanes(width: int) -> int:
    """A one in every ``width`` bits of 64."""
    return sum(1 << at for at in range(0, 64, width))


def _window_prints(runs: DataFrame, width: int) -> DataFrame:
    """Fingerprints of the windows that begin at ``starts`` of a run of words: ``_row, n, k, start, fp``.

    ``runs`` has ``_row, n, k, first`` (the place of the first of ``words``) and ``starts``.  Counts of set bits run along a run's shingles,
    several in each number, ``width`` bits apart; a window's counts are what they are at its end less what they were before it, so windows
    that overlap share their work.  A count ``c`` of ``m`` shingles is over half if ``c + 2^(width - 2) - 1 - m div 2`` has bit ``width - 2``.
    """
    ones, key = _lanes(width), ["_row", "n", "k", "first"]
    hashed = runs.select(*key, F.posexplode(F.expr(f"transform({_shingles('words', 'k')}, s -> xxhash64(s))")).alias("at", "h"))
    along = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = [F.sum(F.expr(f"shiftrightunsigned(h, {j}) & {ones}L")).over(along).alias(f"c{j}") for j in range(width)]
    counted = hashed.select(*key, "at", *counts)
    before = F.struct(F.lit(-1).alias("at"), *[F.lit(0).cast("long").alias(f"c{j}") for j in range(width)])
    summed = counted.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("at", *[f"c{j}" for j in range(width)]))).alias("sums"))  # as long as a run
    held = summed.join(runs.select(*key, "starts"), key).select(*key, F.concat(F.array(before), "sums").alias("sums"), F.explode("starts").alias("start"))
    # ``sums`` has what was counted before each place; a text shorter than the item is one window.
    m = F.least(F.col("n") - F.col("k") + 1, F.size("sums") - 1 - (F.col("start") - F.col("first")))
    ends = held.withColumn("m", m).withColumn("low", F.get("sums", F.col("start") - F.col("first"))).withColumn("high", F.get("sums", F.col("start") - F.col("first") + F.col("m")))
    over = [F.expr(f"shiftleft(shiftrightunsigned(high.c{j} - low.c{j} + ({(1 << width - 2) - 1} - m div 2) * {ones}L, {width - 2}) & {ones}L, {j})") for j in range(width)]
    return ends.select("_row", "n", "k", "start", reduce(Column.bitwiseOR, over).alias("fp"))


def row_key() -> Column:
    """A hash of key and text: rows that share it are copies of one another."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Pairs of a document and a benchmark item that a window of it repeats: ``_row, doc_id, item_id, similarity, start_word``.

    Similarity is the weighted Jaccard measure of word shingles of ``SHINGLE``, weighted by how often they stand; the pair has its
    best window's, and the first such window's first word.  An item of fewer words has one shingle, all of them; a shorter document
    is one window.  Null texts have no words; null keys stay; copies of a row are one row here; extra columns are not read.
    Items of one text are reported as the least id.  An empty table on either side gives no rows.
    """
    items = written(items_of(benchmark), "benchmark-items")
    anchors = written(_anchors(items, similarity), "benchmark-anchors")
    sizes = {r["k"]: r["n"] for r in items.groupBy("k").agg(F.max("n").alias("n")).collect()}  # at most SHINGLE values
    if not sizes:
        return docs.sparkSession.createDataFrame([], "_row long, doc_id long, item_id long, similarity double, start_word long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_of(F.col("text")).alias("words"), row_key().alias("_row"))
    index = F.broadcast(anchors) if anchors.count() <= BROADCAST_ANCHORS else anchors
    cells = written(_around(texts.select("_row", "words"), index, sorted(sizes)).groupBy("_row").agg(F.collect_set(F.struct("item", "n", "k", "cell")).alias("cells")), "benchmark-cells")
    # From here on only the texts that hold an anchor are read.
    held = written(texts.join(cells, "_row").groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("words").alias("words"), F.first("cells").alias("cells")), "benchmark-texts")
    # All shingles of an item in the cells around its anchors.
    part = F.transform("cells", lambda c: F.struct(c["item"].alias("item"), c["n"].alias("n"), c["k"].alias("k"), (c["cell"] * c["n"]).alias("from"), F.slice("words", c["cell"] * c["n"] + 1, c["n"] + c["k"] - 1).alias("words")))
    parts = held.select("_row", F.size("words").alias("long"), F.explode(part).alias("c")).select("_row", "long", "c.*")
    hashed = F.posexplode(F.expr(f"transform({_shingles('words', 'k')}, s -> xxhash64(s))"))
    placed = parts.select("_row", "long", "item", "n", "k", "from", hashed.alias("pos", "h")).withColumn("pos", F.col("from") + F.col("pos"))
    own = written(items.select("item", F.explode(F.array_distinct(F.expr(f"transform({_shingles('words', 'k')}, s -> xxhash64(s))"))).alias("h")), "benchmark-shingles")
    own = F.broadcast(own) if own.count() <= BROADCAST_ANCHORS else own
    hits = placed.join(own, ["item", "h"]).groupBy("_row", "item", "long", "n", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    # Windows of one size near each other are counted together: a run is as long as two windows, or RUN starts and a window.
    block = F.expr(f"start div least(n, {RUN})").alias("block")
    runs = _starts(hits, similarity).groupBy("_row", "n", "k", block).agg(F.sort_array(F.collect_set("start")).alias("starts"))
    places = runs.groupBy("_row").agg(F.collect_list(F.struct("n", "k", "starts")).alias("places"))
    first, last = F.col("starts")[0], F.element_at("starts", -1)
    spans = held.select("_row", "words").join(places, "_row").select("_row", "words", F.inline("places"))
    runs = written(spans.select("_row", "n", "k", first.alias("first"), "starts", F.slice("words", first + 1, last - first + F.col("n")).alias("words")), "benchmark-runs")
    windows = written(_window_prints(runs, 16 if max(sizes.values()) < RUN else 32), "benchmark-windows")
    # The multi-index: a window's blocks against every value within reach of an item's block.
    reach = radius // len(BLOCKS)
    values = [F.expr(f"transform(filter(sequence(0L, {(1 << bits) - 1}L), m -> bit_count(m) <= {reach}), m -> m ^ block{b})") for b, bits in enumerate(BLOCKS)]
    blocks = items.withColumns({f"block{b}": _block("fp", b) for b in range(len(BLOCKS))})
    lookup = blocks.select("item", "n", "k", F.col("fp").alias("item_fp"), F.posexplode(F.array(*values)).alias("block", "values")).withColumn("value", F.explode("values")).drop("values")
    sought = windows.withColumn("blocks", F.array(*[_block("fp", b) for b in range(len(BLOCKS))])).select("*", F.posexplode("blocks").alias("block", "value")).drop("blocks")
    apart = F.expr("bit_count(fp ^ item_fp)")
    known = F.broadcast(lookup) if items.count() <= BROADCAST_ITEMS else lookup.hint("shuffle_merge")
    one = F.coalesce(*[F.when(F.bit_count(_block("fp", b).bitwiseXOR(_block("item_fp", b))) <= reach, b) for b in range(len(BLOCKS))])
    near = sought.join(known, ["n", "k", "block", "value"]).where((apart <= radius) & (F.col("block") == one)).select("_row", "item", "start", "n", "k")
    # Candidates are compared exactly: their words are cut from the texts once more.
    sought_in = near.groupBy("_row").agg(F.collect_list(F.struct("item", "start", "n", "k")).alias("near"))
    cut = held.select("_row", "doc_id", "words").join(sought_in, "_row").select("_row", "doc_id", F.col("words").alias("all"), F.inline("near"))
    bags = items.select("item", _numbered("words", "k").alias("item_bag"))
    own_bag = cut.select("_row", "doc_id", "item", "start", "k", F.slice("all", F.col("start") + 1, F.col("n")).alias("words")).withColumn("bag", _numbered("words", "k"))
    found = own_bag.join(bags, "item").withColumn("same", F.size(F.array_intersect("bag", "item_bag")))
    found = found.withColumn("similarity", F.col("same") / (F.size("bag") + F.size("item_bag") - F.col("same")))
    best = found.where(F.col("similarity") >= similarity).groupBy("_row", "item").agg(F.first("doc_id").alias("doc_id"), F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("_row", "doc_id", F.col("item").alias("item_id"), F.col("best.similarity").alias("similarity"), (-F.col("best.back")).cast("long").alias("start_word"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their columns as they are."""
    gone = written(contaminated(docs, benchmark, similarity).select("_row").distinct(), "contaminated")
    key = "_row"
    while key in docs.columns:
        key += "_"
    return docs.withColumn(key, row_key()).join(gone.withColumnRenamed("_row", key), key, "left_anti").drop(key)
