"""Sources: unpack raw payloads and read stored tables and text files.

Payload frames have one text column with one response item per row, so a bulk
load is a plain distributed parse. Everything is built in, per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketpulse.functions import codes as C
from marketpulse.functions.measures import missing_to_null
from marketpulse.schemas import BAR_VALUES

# Payload field names and market codes.
BAR_FIELDS = {
    "preClose": "pre_close", "open": "open", "high": "high", "low": "low", "close": "close",
    "changeRatio": "change_ratio", "volume": "volume", "amount": "amount",
}
GROUP_NAMES_FIELD = "ths_the_ths_concept_index_stock"
GROUP_CODES_FIELD = "ths_the_ths_concept_index_code_stock"
DICT_FIELDS = {
    "ths_index_short_name_index": "short_name",
    "ths_index_full_name_index": "full_name",
    "ths_index_code_index": "index_code",
    "ths_main_sec_code_index": "main_code",
    "ths_thscode_index": "thscode",
}
MEMBER_CODES_FIELD, MEMBER_NAMES_FIELD = "p03473_f002", "p03473_f003"
MARKET_SUFFIX = {"17": ".SH", "33": ".SZ", "151": ".BJ"}
CODE_HEADER, NAME_HEADER, CHANGE_HEADER = "股票代码", "股票简称", "涨跌幅"
NOT_FOUND_TEXTS = ("未找到", "无符合", "未能成功处理")


def _parsed(raw: DataFrame, schema: str, column: str) -> DataFrame:
    keep = [c for c in raw.columns if c != column]
    return raw.select(*keep, F.from_json(column, schema).alias("r"))


def compact_date(text) -> Column:
    """Date from ``YYYY-MM-DD`` or ``YYYYMMDD`` text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.to_date(F.regexp_replace(text, "-", ""), "yyyyMMdd")


def unpack_bars(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Items ``{thscode, time[], table{field[]}}`` to one row per date.

    Arrays shorter than the time list give NULL.
    """
    table = ",".join(f"{f}:array<double>" for f in BAR_FIELDS)
    items = _parsed(raw, f"thscode string, time array<string>, table struct<{table}>", column)
    points = items.select(F.col("r.thscode").alias("code"), F.posexplode("r.time").alias("i", "t"), "r.table")
    return missing_to_null(points.select(
        "code", compact_date("t").alias("trade_date"),
        *[F.get(F.col(f"table.{f}"), F.col("i")).alias(n) for f, n in BAR_FIELDS.items()],
    ).select("code", "trade_date", *BAR_VALUES))


def _names_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def unpack_group_map(raw: DataFrame, column: str = "payload") -> DataFrame:
    """A2: an instrument's comma-separated group names and codes, paired.

    Entries are trimmed and empties dropped before pairing; the longer list is cut.
    """
    fields = f"{GROUP_NAMES_FIELD}:array<string>,{GROUP_CODES_FIELD}:array<string>"
    items = _parsed(raw, f"thscode string, table struct<{fields}>", column)
    lists = items.select(
        F.col("r.thscode").alias("code"),
        _names_list(F.coalesce(F.get(F.col(f"r.table.{GROUP_NAMES_FIELD}"), F.lit(0)), F.lit(""))).alias("names"),
        _names_list(F.coalesce(F.get(F.col(f"r.table.{GROUP_CODES_FIELD}"), F.lit(0)), F.lit(""))).alias("ids"),
    )
    paired = lists.select("code", F.posexplode(F.arrays_zip("names", "ids")).alias("pos", "p"))
    return paired.filter(F.col("p.names").isNotNull() & F.col("p.ids").isNotNull()).select(
        "code", F.col("p.ids").alias("group_id"), F.col("p.names").alias("group_name"), "pos")


def unpack_group_dict(raw: DataFrame, column: str = "payload") -> DataFrame:
    """A3: group dictionary items; the first element of every array or ''."""
    fields = ",".join(f"{f}:array<string>" for f in DICT_FIELDS)
    items = _parsed(raw, f"thscode string, table struct<{fields}>", column)
    return items.select(
        F.coalesce("r.thscode", F.lit("")).alias("group_id"),
        *[F.coalesce(F.get(F.col(f"r.table.{f}"), F.lit(0)), F.lit("")).alias(n) for f, n in DICT_FIELDS.items()],
    )


def unpack_members(raw: DataFrame, column: str = "payload") -> DataFrame:
    """A4: member codes with their names; a missing name is ''. Other columns
    of ``raw`` (the group, the date) are kept."""
    keep = [c for c in raw.columns if c != column]
    fields = f"{MEMBER_CODES_FIELD}:array<string>,{MEMBER_NAMES_FIELD}:array<string>"
    items = _parsed(raw, f"table struct<{fields}>", column)
    rows = items.select(*keep, F.posexplode(F.col(f"r.table.{MEMBER_CODES_FIELD}")).alias("i", "code"),
                        F.col(f"r.table.{MEMBER_NAMES_FIELD}").alias("names"))
    return rows.select(*keep, "code", F.coalesce(F.get("names", F.col("i")), F.lit("")).alias("name"))


def unpack_quotes(raw: DataFrame, column: str = "payload") -> DataFrame:
    """A5: live quotes as ``code`` and a map from indicator to its first value.

    Indicators with an empty array or no value are left out, and so are codes
    without any indicator.
    """
    items = _parsed(raw, "thscode string, table map<string,array<double>>", column)
    first = F.transform_values("r.table", lambda _, v: F.nanvl(F.get(v, F.lit(0)), F.lit(None).cast("double")))
    present = F.map_filter(first, lambda _, v: v.isNotNull())
    return items.select(F.col("r.thscode").alias("code"), present.alias("quote")).filter(F.size("quote") > 0)


def import_groups(raw: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """User groups from exported documents ``{groups: [{block_id, block_name,
    stocks: [{code, market_code}]}]}``.

    Returns the member rows and a one-row frame of counts. Stocks of other
    markets are skipped and counted.
    """
    schema = ("groups array<struct<block_id:string,block_name:string,"
              "stocks:array<struct<code:string,market_code:string>>>>")
    groups = _parsed(raw, schema, column).select(F.explode("r.groups").alias("g"))
    stocks = groups.select(
        F.coalesce("g.block_id", F.lit("")).alias("group_id"),
        F.coalesce("g.block_name", "g.block_id", F.lit("")).alias("group_name"),
        F.explode("g.stocks").alias("s"))
    suffixes = F.create_map(*[F.lit(x) for pair in MARKET_SUFFIX.items() for x in pair])
    coded = stocks.select(
        "group_id", "group_name", F.try_element_at(suffixes, F.col("s.market_code")).alias("suffix"),
        F.coalesce("s.code", F.lit("")).alias("pure"))
    kept = coded.filter(F.col("suffix").isNotNull()).select(
        "group_id", "group_name", F.concat("pure", "suffix").alias("code"))
    stats = coded.agg(
        F.count_distinct(F.when(F.col("suffix").isNotNull(), F.col("group_id"))).alias("group_count"),
        F.count_distinct(F.concat("pure", "suffix")).alias("stock_count"),
        F.count("suffix").alias("row_count"),
        F.count_if(F.col("suffix").isNull()).alias("skipped"),
    )
    return kept, stats


def import_groups_file(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A6 on files: each file is one exported document."""
    return import_groups(spark.read.text(path, wholetext=True).withColumnRenamed("value", "payload"))


def normalise_ticks(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Items ``{code, trade_date, trading[], pre_market[]}`` to tick rows.

    Points without a price are dropped, times are cut to the minute, missing
    figures are 0. ``seq`` is the position inside the phase's list.
    """
    trading = "struct<time:string,last_price:double,avg_price:double,volume:double,turnover:double>"
    auction = ("struct<time:string,ref_price:double,matched_vol:double,"
               "non_matched_vol_buy:double,non_matched_vol_sell:double>")
    items = _parsed(raw, f"code string, trade_date string, trading array<{trading}>, pre_market array<{auction}>", column)
    head = ["r.code", compact_date("r.trade_date").alias("trade_date")]
    zero = F.lit(0.0)

    def number(name):
        return F.coalesce(F.nanvl(f"p.{name}", F.lit(None).cast("double")), zero)

    def minute(name="p.time"):
        return F.substring(name, 1, 5).alias("hhmm")

    live = items.select(*head, F.posexplode("r.trading").alias("seq", "p")).select(
        "code", "trade_date", F.lit("trading").alias("phase"), F.col("seq").cast("long"), minute(),
        F.col("p.last_price").alias("price"), number("avg_price").alias("avg_price"),
        number("volume").alias("volume"), number("turnover").alias("turnover"),
        zero.alias("matched_vol"), zero.alias("unmatched_buy"), zero.alias("unmatched_sell"))
    early = items.select(*head, F.posexplode("r.pre_market").alias("seq", "p")).select(
        "code", "trade_date", F.lit("pre_market").alias("phase"), F.col("seq").cast("long"), minute(),
        F.col("p.ref_price").alias("price"), zero.alias("avg_price"), zero.alias("volume"), zero.alias("turnover"),
        number("matched_vol").alias("matched_vol"), number("non_matched_vol_buy").alias("unmatched_buy"),
        number("non_matched_vol_sell").alias("unmatched_sell"))
    return early.unionByName(live).filter(F.col("price").isNotNull() & ~F.isnan("price"))


def _answer(raw: Column) -> Column:
    """Table text of a response: plain, or wrapped in JSON once or twice."""
    data = F.get_json_object(raw, "$.data")
    inner = F.coalesce(F.nullif(F.get_json_object(data, "$.answer"), F.lit("")),
                       F.get_json_object(data, "$.result"), F.lit(""))
    is_document = F.json_object_keys(data).isNotNull()
    return (
        F.when(data.isNull() | (data == ""), raw)
        .when(is_document, inner)
        .otherwise(data)
    )


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))


def parse_screen_tables(responses: DataFrame, key: str = "response_id", column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """Hits from markdown tables in screen responses, and the error rows.

    Columns are found in the header by text. Short rows and foreign codes are
    skipped, bad numbers count as 0, the last row of a repeated code wins.
    Returns ``(key, code, name, change_ratio)`` and ``(key, error)``.
    """
    answers = responses.select(key, _answer(F.col(column)).alias("text"))
    failed = F.lit(False)
    for words in NOT_FOUND_TEXTS:
        failed = failed | F.col("text").contains(words)
    errors = answers.filter(failed).select(key, F.lit("not found").alias("error"))

    lines = F.filter(F.split("text", "\n"), lambda x: F.ltrim(x).startswith("|"))
    tables = answers.filter(~failed).select(key, lines.alias("lines")).filter(F.size("lines") >= 2)
    header = tables.withColumn("header", _cells(F.col("lines")[0]))

    def first_with(text, *taken):
        def wanted(cell, i):
            free = F.lit(True)
            for t in taken:
                free = free & (i != t)
            return cell.contains(text) & free
        return F.array_position(F.transform("header", wanted), True).cast("int") - 1

    found = header.withColumn("at_code", first_with(CODE_HEADER)).filter(F.col("at_code") >= 0)
    found = found.withColumn("at_name", first_with(NAME_HEADER, F.col("at_code")))
    found = found.withColumn("at_change", first_with(CHANGE_HEADER, F.col("at_code"), F.col("at_name")))
    rows = found.select(key, "at_code", "at_name", "at_change", F.posexplode("lines").alias("pos", "line")).select(
        key, "pos", "at_code", "at_name", "at_change", _cells(F.col("line")).alias("cells"))
    full = rows.filter(F.size("cells") > F.greatest("at_code", "at_name", "at_change")).select(
        key, "pos", F.get("cells", "at_code").alias("code"),
        F.when(F.col("at_name") >= 0, F.get("cells", "at_name")).otherwise("").alias("name"),
        F.coalesce(F.when(F.col("at_change") >= 0, F.nanvl(F.get("cells", "at_change").try_cast("double"), F.lit(0.0))),
                   F.lit(0.0)).alias("change_ratio"))
    hits = full.filter(C.is_domestic()).groupBy(key, "code").agg(
        F.max_by(F.struct("name", "change_ratio"), "pos").alias("h")).select(key, "code", "h.*")
    return hits, errors


def read_bars(spark: SparkSession, path: str, start=None, end=None, codes: Sequence[str] | None = None,
              column: str = "trade_date") -> DataFrame:
    """Stored bars by date, date range and codes.

    Dates prune partitions, codes are pushed to the parquet scan. Minute bars
    are read alike with ``column="minute"``.
    """
    bars = missing_to_null(spark.read.parquet(path))
    if start is not None:
        bars = bars.filter(F.col(column) >= F.lit(start).cast(bars.schema[column].dataType))
    if end is not None:
        bars = bars.filter(F.col(column) <= F.lit(end).cast(bars.schema[column].dataType))
    return bars.filter(F.col("code").isin(list(codes))) if codes else bars


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """A10: trimmed, non-empty lines of a text file."""
    return spark.read.text(path).select(F.trim("value").alias("code")).filter(F.col("code") != "")


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trading days of a text file, compact or hyphenated dates."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter(F.col("value") != "")
    return lines.select(compact_date("value").alias("trade_date")).distinct().orderBy("trade_date")


def coalesce_sources(live: DataFrame, fallback: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Live values first, the fallback's where they are missing."""
    other = fallback.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    joined = live.join(other, list(keys), "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(c, f"__{c}"))
    return joined.drop(*[f"__{c}" for c in columns])
