"""The JSON scan cache: loading a good one, recovering a damaged one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilscan.functions.regex import SPACE
from veilscan.operators.findall import MARK, without_mark
from veilscan.operators.resume import newest
from veilscan.operators.scan import FINDING_TYPE
from veilscan.sources.workspace import save_table

FINDINGS_TYPE = f"array<{FINDING_TYPE}>"
ENTRY_TYPE = f"struct<modified_time:string,total_chars:int,findings:{FINDINGS_TYPE},error:string>"
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "true"}

# Fixed value: how an entry starts.
ENTRY_START = f'"[a-zA-Z0-9_-]{{25,}}":[{SPACE}]*\\{{'


def load_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache file(s) as rows ``file_id, modified_time, total_chars, findings, error``.

    A file that is not valid JSON counts as an empty cache.
    """
    whole = spark.read.text(path, wholetext=True)
    entries = _parse(F.col("value"), f"map<string,{ENTRY_TYPE}>")
    return whole.select(F.explode(entries).alias("file_id", "e")).select("file_id", "e.*")


def _parse(text: Column, schema: str) -> Column:
    """One JSON value; NULL if anything but white space follows it.

    Spark stops reading at the end of the value. Inside an array it has to go on.
    """
    listed = F.concat(F.lit("["), text, F.lit("]"))
    return F.get(F.from_json(listed, f"array<{schema}>", STRICT), 0)


def _opens(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The text up to each closing brace, as Spark splits the files: ``source, block, size, row, n_bytes``,
    ``parts`` (cut where entries start), ``opened`` (opening braces of each part), ``ids`` (of the entries).

    Braces are counted wherever they stand, also inside strings.
    """
    text = without_mark(F.make_valid_utf8("value"))
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("row"),
        (F.octet_length("value") + 1).cast("bigint").alias("n_bytes"),
        F.split(F.regexp_replace(text, ENTRY_START, MARK + "$0"), MARK, -1).alias("parts"),
    )
    starts = F.slice("parts", F.lit(2), F.size("parts"))
    lines = lines.withColumns({
        "opened": F.transform("parts", _opens),
        "ids": F.transform(starts, lambda p: F.regexp_extract(p, '^"([^"]*)"', 1)),
    })
    return save_table(lines, "lines")


def _pieces(lines: DataFrame) -> DataFrame:
    """What is known of each piece without its text: ``source, block, row, ord`` (number in the file), ``depth``
    (of braces behind it), ``before`` (in front of it), ``started`` (entries before it), ``opened``, ``ids``.

    What stands behind the last brace of a file has no depth.
    """
    opens = F.aggregate("opened", F.lit(0), lambda n, x: n + x)
    # Sums within a block first; a block is as large as Spark makes its splits.
    within = Window.partitionBy("source", "block").orderBy("row")
    counted = lines.select("source", "block", "size", "row", "n_bytes", "opened", "ids", opens.alias("opens")).select(
        "*",
        F.row_number().over(within).alias("rn"),
        F.sum("opens").over(within).alias("sum_opens"),
        F.sum(F.size("ids")).over(within).alias("starts"),
    )
    blocks = counted.groupBy("source", "block").agg(
        F.max("rn").alias("n"),
        F.max("sum_opens").alias("block_opened"),
        F.max("starts").alias("block_starts"),
        F.sum("n_bytes").alias("block_bytes"),
        F.first("size").alias("size"),
    )
    # One row per block from here: what the blocks before add up to.
    by_block = Window.partitionBy("source").orderBy("block")
    earlier = by_block.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = blocks.select(
        "source", "block", "n",
        total("n").alias("n0"),
        total("block_opened").alias("opened0"),
        total("block_starts").alias("starts0"),
        # Every piece stands for a brace but the last one of a file that does not end with one.
        ((F.sum("block_bytes").over(Window.partitionBy("source")) > F.col("size"))
         & F.lead("block").over(by_block).isNull()).alias("open_end"),
    )
    joined = counted.join(offsets, ["source", "block"]).withColumn("ord", F.col("n0") + F.col("rn"))
    depth = F.col("opened0") + F.col("sum_opens") - F.col("ord")
    return save_table(
        joined.select(
            "source", "block", "row", "ord", "opened", "ids",
            F.when(~(F.col("open_end") & (F.col("rn") == F.col("n"))), depth).alias("depth"),
            (depth + 1 - F.col("opens")).alias("before"),
            (F.col("starts0") + F.col("starts") - F.size("ids")).alias("started"),
        ),
        "pieces",
    )


def _entries(pieces: DataFrame) -> DataFrame:
    """Entry starts: ``source, block, ord, k, j`` (number in its piece), ``file_id, base`` (depth around the entry)."""
    numbered = pieces.where(F.size("ids") > 0).select(
        "source", "block", "ord", "before", "started", "opened", F.posexplode("ids").alias("i", "file_id")
    )
    opened = F.aggregate(F.slice("opened", F.lit(1), F.col("i") + 1), F.lit(0), lambda n, x: n + x)
    return numbered.select(
        "source", "block", "ord", "file_id",
        (F.col("i") + 1).alias("j"),
        (F.col("started") + F.col("i") + 1).alias("k"),
        (F.col("before") + opened).alias("base"),
    )


def _closings(pieces: DataFrame, entries: DataFrame) -> DataFrame:
    """``source, k, close``: number of the piece that ends at each entry's closing brace.

    An entry ends where the depth is back for the first time, and the depth falls by one brace at a time. So within a
    block it is the nearest later piece of the same depth, which a frame running backwards carries along. An entry that
    goes beyond its block ends in the nearest later block that falls to its depth. That block comes in above this
    depth, so it has a closing brace for each depth from there down to its lowest; these depths stand for it.
    """
    none = F.lit(None).cast("bigint")
    at = ["source", "block", "level"]
    asked = entries.select("source", "block", "ord", F.col("base").alias("level"), "k", none.alias("end"))
    depths = pieces.where("depth is not null").select("source", "block", "ord", F.col("depth").alias("level"))
    own = depths.join(asked.select(*at).distinct(), at, "left_semi").withColumn("k", none).withColumn("end", F.col("ord"))
    # Backwards, a brace comes before an entry of its own piece.
    backwards = Window.partitionBy(*at).orderBy(F.desc("ord"), F.col("k").isNotNull())
    running = backwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asked.unionByName(own).withColumn("close", F.last("end", ignorenulls=True).over(running)).where("k is not null")
    found = save_table(found.select(*at, "k", "close"), "closings")
    rest = found.where("close is null").select(*at).distinct()
    span = pieces.where("depth is not null").groupBy("source", "block").agg(F.min("depth").alias("low"), F.min_by("before", "ord").alias("top"))
    falls = span.where("low < top").select("source", "block", F.explode(F.expr("sequence(low, top - 1)")).alias("level"))
    falls = falls.join(rest.select("source", "level").distinct(), ["source", "level"], "left_semi")
    # Blocks of a file, one row each per depth.
    both = rest.select(*at, none.alias("later")).unionByName(falls.select(*at, F.col("block").alias("later")))
    backwards = Window.partitionBy("source", "level").orderBy(F.desc("block"))
    target = both.withColumn("later", F.last("later", ignorenulls=True).over(backwards.rangeBetween(Window.unboundedPreceding, -1)))
    target = rest.join(target.where("later is not null").select(*at, "later").distinct(), at)
    firsts = depths.withColumnRenamed("block", "later").join(target.select("source", "later", "level").distinct(), ["source", "later", "level"], "left_semi")
    firsts = firsts.groupBy("source", "later", "level").agg(F.min("ord").alias("beyond"))
    ends = target.join(firsts, ["source", "later", "level"]).select(*at, "beyond")
    return found.join(ends, at, "left").select("source", "k", F.coalesce("close", "beyond").alias("close"))


def recover_entries(spark: SparkSession, path: str) -> DataFrame:
    """Every entry start found in damaged cache text, and what it still holds.

    Columns: ``source, k`` (order in the file), ``file_id, outcome, modified_time,
    total_chars, error, findings``. Outcomes: ``recovered``; ``no_findings`` (entry
    stored, but its findings are unreadable); ``empty``; ``skipped``.

    Files are split; an entry may have any length. Ends are found by counts alone; the text is
    shuffled once, to put entries that close together from their pieces.
    """
    lines = _lines(spark, path)
    pieces = _pieces(lines)
    entries = _entries(pieces)
    ends = entries.join(_closings(pieces, entries), ["source", "k"])
    run = ends.where("close is not null").select(
        "source", "k", "j", "file_id", F.col("ord").alias("first"), F.explode(F.sequence(F.col("ord"), F.col("close"))).alias("ord")
    )
    # Within a block, pieces are numbered as their rows are.
    shift = pieces.groupBy("source", "block").agg(F.min(F.col("ord") - F.col("row")).alias("shift"))
    texts = lines.select("source", "block", "row", "parts").join(shift, ["source", "block"])
    texts = texts.select("source", (F.col("row") + F.col("shift")).alias("ord"), "parts")
    from_start = F.when(F.col("ord") == F.col("first"), F.col("j") + 1).otherwise(1)
    text = F.array_join(F.slice("parts", from_start, F.size("parts")), "")
    whole = (
        run.join(texts, ["source", "ord"])
        .groupBy("source", "k")
        .agg(F.first("file_id").alias("file_id"), F.array_sort(F.collect_list(F.struct("ord", text.alias("t")))).alias("run"))
        .select("source", "k", "file_id", F.concat(F.array_join(F.transform("run", lambda r: r["t"]), "}"), F.lit("}")).alias("window"))
    )
    unclosed = ends.where("close is null").select("source", "k", "file_id", F.lit(None).cast("string").alias("window"))
    windows = whole.unionByName(unclosed)
    fragment = F.concat(F.lit("{"), F.col("window"), F.lit("}"))
    parsed = windows.select(
        "source",
        "k",
        "file_id",
        _parse(fragment, "map<string,map<string,string>>").alias("m"),
    ).withColumn("fields", F.try_element_at("m", F.col("file_id")))
    get = lambda name: F.try_element_at("fields", F.lit(name))
    has_list = F.map_contains_key("fields", "findings")
    findings = F.when(
        has_list, F.from_json(get("findings"), FINDINGS_TYPE, STRICT)
    ).otherwise(F.array().cast(FINDINGS_TYPE))
    return (
        parsed.withColumn("findings", F.when(F.size("fields") > 0, findings))
        .withColumn(
            "outcome",
            F.when(F.col("m").isNull(), "skipped")
            .when(F.coalesce(F.size("fields"), F.lit(0)) <= 0, "empty")
            .when(F.col("findings").isNull(), "no_findings")
            .otherwise("recovered"),
        )
        .select(
            "source",
            "k",
            "file_id",
            "outcome",
            get("modified_time").alias("modified_time"),
            get("total_chars").try_cast("int").alias("total_chars"),
            get("error").alias("error"),
            "findings",
        )
    )


def recovered_state(entries: DataFrame) -> DataFrame:
    """Latest stored entry per file, ready for the state tables."""
    stored = entries.where(F.col("outcome").isin("recovered", "no_findings"))
    latest = newest(stored, ["file_id"], F.struct("source", "k"))
    return latest.select(
        "file_id",
        "modified_time",
        "total_chars",
        "error",
        F.coalesce("findings", F.array().cast(FINDINGS_TYPE)).alias("findings"),
    )


def recovery_counters(entries: DataFrame) -> DataFrame:
    """One row: ``recovered, skipped, findings``. Empty entries count as neither."""
    return entries.agg(
        F.count_if(F.col("outcome") == "recovered").alias("recovered"),
        F.count_if(F.col("outcome").isin("skipped", "no_findings")).alias("skipped"),
        F.coalesce(
            F.sum(F.when(F.col("outcome") == "recovered", F.size("findings"))), F.lit(0)
        ).alias("findings"),
    )
